"""Registered queries of this package: (function, SQL for another engine or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]

Q: dict[str, tuple[Run, str | None]] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm.simhash_dedup import near_duplicates

    return near_duplicates(_table(spark, folder, "documents")).select(
        "doc_id", "fingerprint", "component_id"
    )


Q["op1_simhash_dedup"] = (op1_simhash_dedup, None)


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm.substring_dedup import remove_repeats

    kept = remove_repeats(_table(spark, folder, "documents"), window=35)
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


Q["op9_substring_dedup"] = (op9_substring_dedup, None)


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm.chat_format import format_conversations, loss_text, read_turns

    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    made = format_conversations(turns.unionByName(extra))
    back = made.select(
        "conv_id",
        "valid",
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("segments")).alias("trained"),
    )
    plain = F.concat_ws(
        "", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.char_length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


Q["op7_chat_format"] = (
    op7_chat_format,
    r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
steps AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end,
    length(role) + length(text) AS chars,
    length(role || text) - length(replace(replace(replace(replace(role || text, '\', ''), '#', ''), '<', ''), ':', '')) AS escaped
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + escaped + 14) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
    WHEN before IN ('system', 'assistant') THEN role = 'user'
    ELSE before = 'user' AND role = 'assistant' END)
  AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM steps GROUP BY conv_id""",
)


_SITE = r"^(?:www|m|blog)\."


def _page_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch times; a page's id gives a day between 2020 and 2023."""
    return pages.select(
        "page_id", "url", F.expr("date_add(DATE'2020-01-01', CAST(page_id * 7919 % 1461 AS INT))").alias("fetched")
    )


def _site_entries(pages: DataFrame) -> DataFrame:
    """A dated list derived from the sites in the pages table: spam and adult sites, and one in
    five others; most are taken off again, and some of these put back."""
    from lethewood.llm.url_filters import host

    sites = (
        pages.select(F.regexp_replace(host(F.col("url")), _SITE, "").alias("domain"))
        .dropna()
        .distinct()
        .withColumn("draw", F.expr("CAST(conv(substr(md5(domain), 1, 8), 16, 10) AS BIGINT)"))
        .withColumn(
            "list",
            F.expr("CASE WHEN domain LIKE '%spam%' THEN 'spam' WHEN domain LIKE '%adult%' THEN 'adult' WHEN draw % 5 = 0 THEN 'complaints' END"),
        )
        .where("list IS NOT NULL")
    )
    first = "DATE'2020-01-01'"
    return sites.selectExpr(
        "list",
        "domain",
        f"""inline(array_compact(array(
            struct('add' AS action, date_add({first}, CAST(draw % 600 AS INT)) AS day),
            IF(draw % 3 <> 0, struct('remove' AS action, date_add({first}, CAST(draw % 600 + 30 + draw % 301 AS INT)) AS day), NULL),
            IF(draw % 3 = 1, struct('add' AS action, date_add({first}, CAST(draw % 600 + 230 + draw % 301 AS INT)) AS day), NULL))))""",
    )


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm.url_filters import filter_urls

    pages = _table(spark, folder, "pages").select("page_id", "url")
    judged = filter_urls(_page_captures(pages), _site_entries(pages))
    return judged.select(
        "page_id",
        "host",
        F.col("fetched").cast("string").alias("fetched"),
        "blocked",
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["list"], m["domain"])), ",").alias("matches"),
    )


Q["op2_url_filters"] = (
    op2_url_filters,
    r"""
WITH captures AS (
  SELECT page_id, url, DATE '2020-01-01' + CAST(page_id * 7919 % 1461 AS INTEGER) AS fetched,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host
  FROM pages),
sites AS (
  SELECT domain, draw, CASE WHEN domain LIKE '%spam%' THEN 'spam' WHEN domain LIKE '%adult%' THEN 'adult'
    WHEN draw % 5 = 0 THEN 'complaints' END AS list
  FROM (SELECT domain, CAST('0x' || substr(md5(domain), 1, 8) AS BIGINT) AS draw
        FROM (SELECT DISTINCT regexp_replace(host, '^(?:www|m|blog)\.', '') AS domain FROM captures WHERE host IS NOT NULL))),
spans AS (
  SELECT list, domain, DATE '2020-01-01' + CAST(draw % 600 AS INTEGER) AS since,
    CASE WHEN draw % 3 <> 0 THEN DATE '2020-01-01' + CAST(draw % 600 + 30 + draw % 301 AS INTEGER) END AS until
  FROM sites WHERE list IS NOT NULL
  UNION ALL
  SELECT list, domain, DATE '2020-01-01' + CAST(draw % 600 + 230 + draw % 301 AS INTEGER), NULL
  FROM sites WHERE list IS NOT NULL AND draw % 3 = 1),
found AS (
  SELECT host, fetched, string_agg(DISTINCT list || ':' || domain, ',' ORDER BY list || ':' || domain) AS matches
  FROM captures JOIN spans ON (host = domain OR ends_with(host, '.' || domain))
    AND fetched >= since AND (until IS NULL OR fetched < until)
  GROUP BY host, fetched)
SELECT page_id, c.host, CAST(c.fetched AS VARCHAR) AS fetched, matches IS NOT NULL AS blocked, coalesce(matches, '') AS matches
FROM captures c LEFT JOIN found f ON c.host = f.host AND c.fetched = f.fetched""",
)


# Public vocabulary with log scores; a parameter, never copied into the repository.
PIECES = "file:///opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm.sentencepiece import MARK, encode

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    back = encode(docs, PIECES, decoded_col="decoded")
    return back.select(
        "doc_id",
        F.size("token_ids").alias("n_tokens"),
        "token_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.equal_null(F.col("decoded"), F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))).alias("exact"),
    )


Q["op6_sentencepiece"] = (op6_sentencepiece, None)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm import toxicity

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.train(docs, _table(spark, folder, "labels").where(~held_out))
    scored = toxicity.score_documents(docs, model, score_col="score")
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


Q["op3_toxicity"] = (op3_toxicity, None)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm.leak_search import find_leaks

    return find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


Q["op5_decontamination"] = (op5_decontamination, None)


def op4_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm.ann import nearest

    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


Q["op4_nearest_neighbours"] = (op4_nearest_neighbours, None)


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm.secret_scan import scan

    return scan(_table(spark, folder, "documents")).withColumnRenamed("path", "source")


Q["op8_secret_scan"] = (op8_secret_scan, None)


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm.quality_lm import classify

    docs = _table(spark, folder, "documents").select("doc_id", "lang", "text")
    trusted = _table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return classify(docs, trusted)


Q["op10_quality_classifier"] = (op10_quality_classifier, None)


_USABLE = """embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"""


def op12_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm.exact_search import top_k

    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


Q["op12_exact_top_k"] = (
    op12_exact_top_k,
    f"""
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS y
  FROM embeddings WHERE {_USABLE}),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.y, c.y) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score
FROM pairs WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10""",
)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm.vector_codes import compress, with_group_sum

    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    coded, books = compress(vectors, keep=["label"])
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return with_group_sum(coded, "label", "error", "label_error").select(
        "vec_id",
        F.concat_ws("", digits).alias("code"),
        "error",
        "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"),
    )


def _codes_sql(parts: int = 8, size: int = 16, rounds: int = 6) -> str:
    """The rounds written out one after the other."""
    found = """
a{i} AS MATERIALIZED (
  SELECT vec_id, part, entry, far FROM (
    SELECT vec_id, p.part, entry, sum((y - c) * (y - c)) AS far
    FROM p JOIN b{i} USING (part, pos) GROUP BY vec_id, p.part, entry)
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1)"""
    improved = """
s{i} AS MATERIALIZED (
  SELECT p.part, entry, pos, sum(y) AS s, count(*) AS n FROM p JOIN a{i} USING (vec_id, part) GROUP BY p.part, entry, pos),
b{j} AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c
  FROM b{i} LEFT JOIN s{i} USING (part, entry, pos))"""
    steps = [found.format(i=i) + "," + improved.format(i=i, j=i + 1) for i in range(rounds)]
    steps.append(found.format(i=rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS y
  FROM embeddings WHERE {_USABLE}),
p AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(y) // {parts}) AS part, (i - 1) % (len(y) // {parts}) AS pos, y[i] AS y
  FROM (SELECT vec_id, y, unnest(range(1, len(y) + 1)) AS i FROM v)),
b0 AS MATERIALIZED (
  SELECT part, entry, pos, y AS c FROM p JOIN
    (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {size}) USING (vec_id)),
{",".join(steps)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM a{rounds} JOIN v USING (vec_id) GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(c, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, books"""


Q["op13_vector_codes"] = (op13_vector_codes, _codes_sql())


# A public byte-level vocabulary; a parameter like PIECES.
BYTE_LEVEL = "file:///opt/tokenizers/byte_bpe_50k.json"


def op11_token_align(spark: SparkSession, folder: str) -> DataFrame:
    from lethewood.llm.token_align import align

    aligned, _ = align(_table(spark, folder, "documents"), BYTE_LEVEL, PIECES)
    groups = F.col("groups")
    return aligned.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        F.when(groups == "", "").otherwise(F.sha2(groups, 256)).alias("groups_sha256"),
    )


Q["op11_token_align"] = (op11_token_align, None)
