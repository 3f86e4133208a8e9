"""Secret scans: regular expressions propose, a random forest removes false positives.

Proposals are runs that mix digits with other characters, and values assigned to a key word.
A text is cut at its proposals, so each knows its offset and its neighbouring words. The
forest sees the proposal's length, its characters and the transitions between them, how much of it
dictionary words cover, the path of the document and the words before it. It is trained on
labelled findings: (path, before, value, after, label). Everything runs as DataFrame and SQL
expressions and the forest of ``pyspark.ml``.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethewood.sources.scratch import Scratch

KEYS = "password|passwd|pwd|secret|token|api_key|api-key|apikey|credential"
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z_+/-]{0,80}[0-9])[A-Za-z0-9+/_-]{12,}={0,2}"
_KEYED = rf"(?<=(?i:{KEYS})\s?[=:]\s?[\"']?)[^\s\"'=]{{6,}}"
PROPOSAL = f"{_KEYED}|{_RUN}"
# Every proposal needs a digit or a key word, which this looks for much faster.
_ANY = f"(?i)[0-9]|{KEYS}"
# Words this often in the corpus make the dictionary.
DICTIONARY_COUNT = 20
TRAINING_ROWS = 20_000
NEAR = 60
FEATURES = (
    "length",
    "digits",
    "upper",
    "lower",
    "other",
    "distinct",
    "class_changes",
    "transition",
    "coverage",
    "path_test",
    "path_depth",
    "keyed",
    "assigned",
    "quoted",
    "checksum",
    "neighbour",
)


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, path, number, start, value, before, after): every proposal of every text, with
    its code-point offset and up to ``NEAR`` characters on both sides. Null and empty texts
    have none; a null path counts as empty."""
    text = F.col(text_col)
    cut = docs.where(text.rlike(_ANY)).select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.regexp_extract_all(text, F.lit(PROPOSAL), 0).alias("values"),
        F.split(text, PROPOSAL, -1).alias("pieces"),
    )
    lengths = F.transform("pieces", lambda p, i: F.char_length(p) + F.coalesce(F.char_length(F.get("values", i)), F.lit(0)))
    return (
        cut.where(F.size("values") > 0)
        .withColumn(
            "starts",
            F.aggregate(
                lengths,
                F.array(F.lit(0)),
                lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)),
            ),
        )
        .select("doc_id", "path", "pieces", "starts", F.posexplode("values").alias("number", "value"))
        .select(
            "doc_id",
            "path",
            "number",
            (F.get("starts", F.col("number")) + F.char_length(F.get("pieces", F.col("number")))).alias("start"),
            "value",
            F.right(F.get("pieces", F.col("number")), F.lit(NEAR)).alias("before"),
            F.left(F.get("pieces", F.col("number") + 1), F.lit(NEAR)).alias("after"),
        )
    )


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, times): lower-case runs of letters seen ``DICTIONARY_COUNT`` times or more in
    all texts."""
    words = F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")
    return (
        docs.select(F.explode(words).alias("word"))
        .where(F.char_length("word") >= 3)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("times"))
        .where(F.col("times") >= DICTIONARY_COUNT)
    )


def transitions(words: DataFrame) -> DataFrame:
    """(pair, weight): log share of a letter after a letter in the dictionary's words. Pairs of
    the 36 ASCII letters and digits only, so the table has at most 1,296 rows."""
    pairs = (
        words.select("times", F.filter(F.split("word", ""), lambda c: c.rlike("^[a-z0-9]$")).alias("c"))
        .where(F.size("c") > 1)
        .select("times", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.element_at("c", i), F.element_at("c", i + 1)))).alias("pair"))
        .groupBy("pair")
        .agg(F.sum("times").alias("times"))
    )
    after = pairs.groupBy(F.left("pair", F.lit(1)).alias("first")).agg(F.sum("times").alias("total"))
    return pairs.join(F.broadcast(after), F.left("pair", F.lit(1)) == F.col("first")).select(
        "pair", F.log((F.col("times") + 1) / (F.col("total") + 36)).alias("weight")
    )


UNSEEN_TRANSITION = -9.0


def _share(value: Column, kind: str) -> Column:
    return F.regexp_count(value, F.lit(kind)) / F.char_length(value)


def _previous(before: Column) -> Column:
    """The last word before a proposal, in lower case, without punctuation."""
    return F.lower(F.regexp_extract(before, r"([\p{L}\p{N}_-]+)[^\p{L}\p{N}_-]*$", 1))


def features(findings: DataFrame, words: DataFrame, pairs: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``findings`` (path, before, value, after) with the columns ``FEATURES``. Distinct values
    are looked up once. ``pairs`` and ``neighbours`` are bounded by their makers and broadcast."""
    value = F.col("value")
    runs = F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}{3,}"), 0))
    values = findings.select("value").distinct()
    covered = (
        values.select("value", F.explode(runs).alias("word"))
        .join(words.select("word"), "word")
        .groupBy("value")
        .agg(F.sum(F.char_length("word")).alias("covered"))
    )
    chars = F.filter(F.split(F.lower(value), ""), lambda c: c.rlike("^[a-z0-9]$"))
    steps = (
        values.select("value", chars.alias("c"))
        .where(F.size("c") > 1)
        .select("value", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.element_at("c", i), F.element_at("c", i + 1)))).alias("pair"))
        .join(F.broadcast(pairs), "pair", "left")
        .groupBy("value")
        .agg(F.avg(F.coalesce("weight", F.lit(UNSEEN_TRANSITION))).alias("transition"))
    )
    known = values.join(covered, "value", "left").join(steps, "value", "left").select(
        "value",
        (F.coalesce("covered", F.lit(0)) / F.char_length("value")).alias("coverage"),
        F.coalesce("transition", F.lit(UNSEEN_TRANSITION)).alias("transition"),
    )
    path, before = F.col("path"), F.col("before")
    return (
        findings.join(known, "value")
        .withColumn("word", _previous(before))
        .join(F.broadcast(neighbours), "word", "left")
        .drop("word")
        .withColumns(
            {
                "length": F.char_length(value).cast("double"),
                "digits": _share(value, "[0-9]"),
                "upper": _share(value, "[A-Z]"),
                "lower": _share(value, "[a-z]"),
                "other": _share(value, "[^A-Za-z0-9]"),
                "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.char_length(value),
                "class_changes": F.regexp_count(
                    value,
                    F.lit(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
                )
                / F.char_length(value),
                "path_test": path.rlike("(?i)test|example|sample|fixture|mock").cast("double"),
                "path_depth": F.regexp_count(path, F.lit("/")).cast("double"),
                "keyed": before.rlike(rf"(?i)(?:{KEYS})\W{{0,4}}$").cast("double"),
                "assigned": before.rlike(r"[=:]\s?[\"']?$").cast("double"),
                "quoted": before.rlike("[\"']$").cast("double"),
                "checksum": before.rlike(r"(?i)(?:sha\d*|md5|commit|hash|uuid|guid|digest|checksum|revision)\W{0,4}$").cast("double"),
                "neighbour": F.coalesce("odds", F.lit(0.0)),
            }
        )
        .drop("odds")
    )


def neighbour_odds(labelled: DataFrame) -> DataFrame:
    """(word, odds): how much likelier a secret follows a word than a false positive, from the
    labelled findings; words seen under three times have none. The labelled findings are
    bounded, and so is this table."""
    return (
        labelled.select(_previous(F.col("before")).alias("word"), "label")
        .groupBy("word")
        .agg(F.sum("label").alias("yes"), F.count("label").alias("all"))
        .where(F.col("all") >= 3)
        .select("word", F.log((F.col("yes") + 0.5) / (F.col("all") - F.col("yes") + 0.5)).alias("odds"))
    )


def weak_label(found: DataFrame) -> DataFrame:
    """Findings whose nature is plain, as (path, before, value, after, label): provider formats
    and mixed values after a key word are secrets; numbers, values after a word for a
    checksum, and key words with a plain word for a value are not. Others are left out."""
    value, before = F.col("value"), F.col("before")
    keyed = before.rlike(rf"(?i)(?:{KEYS})\W{{0,4}}$")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.char_length(value) >= 12)
    label = (
        F.when(value.rlike("^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,})$"), 1)
        .when(value.rlike(r"^[0-9+/_-]+$"), 0)
        .when(before.rlike(r"(?i)(?:sha\d*|md5|commit|hash|uuid|guid|digest|checksum|revision)\W{0,4}$"), 0)
        .when(keyed & mixed, 1)
        .when(keyed & ~value.rlike("[0-9]"), 0)
    )
    return found.select("path", "before", "value", "after", label.alias("label")).dropna(subset=["label"])


def contrast_findings(docs: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Labelled findings written into the surroundings of real texts: for each of ``rows``
    documents, in the order of a hash of the id, secrets as they are assigned and, against
    them, checksums, identifiers and placeholders."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != "")
    drawn = (
        docs.select(F.col(id_col).cast("string").alias("i"))
        .dropna()
        .distinct()
        .orderBy(F.xxhash64("i"), "i")
        .limit(rows)
    )
    # The drawn ids, being few, go to the documents; of repeated ids the smallest row counts.
    row = F.struct(F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.slice(words, 1, 4).alias("w"))
    base = (
        docs.select(F.col(id_col).cast("string").alias("i"), row.alias("row"))
        .join(F.broadcast(drawn), "i")
        .groupBy("i")
        .agg(F.min("row").alias("row"))
        .select("i", "row.*")
        .select("path", F.sha2(F.concat_ws("|", "i", "path"), 256).alias("h"), "w")
        .select("path", "h", F.concat_ws(" ", "w").alias("prose"), F.coalesce(F.get("w", F.lit(1)), F.lit("value")).alias("one"))
    )
    kinds = [
        ("concat(prose, ' password=')", "substr(h, 1, 18)", 1),
        ("concat(prose, ' token = \"')", "substr(h, 5, 40)", 1),
        ("concat(prose, ' ')", "concat('AKIA', upper(translate(substr(h, 9, 16), '01', 'XY')))", 1),
        ("concat(prose, ' secret: ')", "base64(encode(substr(h, 3, 24), 'UTF-8'))", 1),
        ("concat(prose, ' commit ')", "substr(h, 1, 40)", 0),
        ("concat(prose, ' md5 ')", "substr(h, 20, 32)", 0),
        ("concat(prose, ' uuid ')", "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))", 0),
        ("concat(prose, ' password=')", "concat(one, 'password')", 0),
        ("concat(prose, ' token = \"')", "concat('example_', one, '_here')", 0),
        ("concat(prose, ' ')", "concat(one, '-', one, '-', substr(h, 1, 1), '2024')", 0),
        ("concat(prose, ' ')", "translate(substr(h, 1, 16), 'abcdef', '123456')", 0),
    ]
    entries = ", ".join(f"struct({b} AS before, {v} AS value, prose AS after, {y} AS label)" for b, v, y in kinds)
    return base.selectExpr("path", f"inline(array({entries}))").where(F.char_length("value") >= 6)


def train(labelled: DataFrame, words: DataFrame, pairs: DataFrame, neighbours: DataFrame) -> RandomForestClassificationModel | None:
    """A forest on labelled findings; None if they do not hold both labels."""
    table = features(labelled, words, pairs, neighbours).select(*FEATURES, F.col("label").cast("double"))
    if table.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    forest = RandomForestClassifier(numTrees=24, maxDepth=7, seed=7, featureSubsetStrategy="sqrt")
    rows = table.repartition(8, *FEATURES).sortWithinPartitions(*FEATURES, "label")
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))


def scan(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    training_rows: int = TRAINING_ROWS,
) -> DataFrame:
    """(doc_id, path, number, start, value, probability, is_secret), one row per proposal of each
    row of ``docs``; ``number`` counts the proposals of a text from zero, ``start`` is in code
    points.

    ``labelled``: (path, before, value, after, label) for training. Without it, plain cases
    among the proposals and contrast findings made from the documents are used, at most
    ``training_rows`` of each in hash order. The dictionary and letter transitions count all
    texts. Null and empty texts have no proposals; null ids and paths are carried; repeated
    rows are scanned each. An empty table gives no rows, and with one label only every
    proposal counts as a secret with probability one.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(id_col, text_col, path_col)
    found = scratch.write(proposals(source, id_col, text_col, path_col), "proposals")
    words = scratch.write(dictionary(source, text_col), "dictionary")
    pairs = scratch.write(transitions(words), "transitions")
    if labelled is None:
        plain = weak_label(found).distinct()
        labelled = plain.orderBy(F.xxhash64("value", "before"), "value", "before", "path", "after").limit(training_rows)
        labelled = labelled.unionByName(contrast_findings(source, training_rows // 10, id_col, text_col, path_col))
    labelled = scratch.write(labelled, "labelled")
    neighbours = scratch.write(neighbour_odds(labelled), "neighbours")
    model = train(labelled, words, pairs, neighbours)
    if model is None:
        return found.select(
            "doc_id", "path", "number", "start", "value", F.lit(1.0).alias("probability"), F.lit(True).alias("is_secret")
        )
    table = features(found, words, pairs, neighbours)
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table))
    return scored.withColumn("probability", vector_to_array("probability")[1]).select(
        "doc_id", "path", "number", "start", "value", "probability", (F.col("probability") >= 0.5).alias("is_secret")
    )


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets among ``findings`` (of the same rows) replaced by ``mark``.
    Texts without a proposal are not moved. Rows of one id are told apart by their text: a
    value found to be a secret in one row of an id is replaced in all rows of that id. All other
    columns are unchanged, whatever their names."""
    found = F.coalesce(F.col(text_col).rlike(_ANY), F.lit(False))
    rest = docs.where(~found)
    # A row travels as one struct, so its columns may have any name.
    touched = docs.where(found).select(F.struct("*").alias("row"), F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    secrets = (
        findings.where("is_secret")
        .groupBy(F.col("doc_id").alias("found_key"))
        .agg(F.collect_set("value").alias("secrets"))
    )
    text = F.col("text")
    values = F.regexp_extract_all(text, F.lit(PROPOSAL), 0)
    own = F.size(F.coalesce(values, F.array())) > 0
    pieces = F.split(text, PROPOSAL, -1)
    clean = F.concat_ws(
        "",
        F.transform(
            pieces,
            lambda p, i: F.concat(
                p,
                F.coalesce(
                    F.when(F.array_contains("secrets", F.get(values, i)), mark).otherwise(F.get(values, i)),
                    F.lit(""),
                ),
            ),
        ),
    )
    changed = touched.join(secrets, F.col("key").eqNullSafe(F.col("found_key")), "left").select(
        "row", F.when(F.col("secrets").isNotNull() & own, clean).otherwise(text).alias("text")
    )
    columns = [text if c.lower() == text_col.lower() else F.col("row").getField(c) for c in docs.columns]
    return changed.select(*(c.alias(name) for c, name in zip(columns, docs.columns, strict=True))).unionByName(rest)
