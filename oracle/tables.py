"""DuckDB forms of the sample tables the queries run on."""

LINE = """
line AS (
  SELECT l_orderkey*1048576 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS sample_id,
         [l_quantity::DOUBLE + 0.0, l_extendedprice::DOUBLE + 0.0, l_discount::DOUBLE + 0.0, l_tax::DOUBLE + 0.0] AS f,
         (l_discount > 0.05 AND l_quantity > 20) AS label, l_returnflag, l_shipdate
  FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber
    ORDER BY l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag) = 1)
)"""

EVENT = """
event AS (
  SELECT event_id AS sample_id, event_id AS position,
         [value::DOUBLE + 0.0, hour(ts)::DOUBLE + 0.0, dayofweek(ts)::DOUBLE + 0.0,
          regexp_extract(props, '"k": ?([0-9]+)', 1)::DOUBLE + 0.0] AS f,
         (value > 40 AND hour(ts) BETWEEN 6 AND 17) AS label, event_type, user_id, value
  FROM events
)"""

DOC = """
doc AS (
  SELECT d.doc_id AS sample_id, d.doc_id AS position,
         [d.n_chars::DOUBLE + 0.0, len(w)::DOUBLE + 0.0,
          len(list_distinct(w))::DOUBLE / len(w)::DOUBLE + 0.0,
          (length(d.text) - length(regexp_replace(d.text, '[0-9]', '', 'g')))::DOUBLE
            / greatest(length(d.text), 1)::DOUBLE + 0.0] AS f,
         l.toxic = 1 AS label
  FROM (SELECT *, string_split(text, ' ') AS w FROM documents) d JOIN labels l USING (doc_id)
)"""

VECTOR = """
vec AS (
  SELECT vec_id AS sample_id, vec_id AS position,
         list_transform(embedding, lambda v: v::DOUBLE + 0.0) AS f, label >= 5 AS label
  FROM embeddings
)"""
