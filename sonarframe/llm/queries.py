"""The queries over the corpus tables: each applies an operator of this package to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, fill_in_middle, fingerprints, language_id, license_scan, line_dedup, lm_score, mixture, near_dedup, quality, spelling, toxicity
from .shared import sized, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs, labels.where(~language_id.held_out()))
    return toxicity.toxicity(docs, weights).select("doc_id", language_id.held_out().alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.classes(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's edited text ends in the beginning of the next document's, in descending order of doc_id."""
    docs = fingerprints.with_next(table(spark, sf_dir, "documents"))
    half = F.col("n_chars") - F.floor(F.col("n_chars") / 2)
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), half.cast("int")), F.substring("next_text", F.lit(1), (F.col("n_chars") - half).cast("int"))))
    own, edited, following = (fingerprints.fingerprint(F.col(c)) for c in ("text", "edited", "next_text"))
    docs = docs.withColumns({"own": own, "changed": edited, "following": following})
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text("own").alias("fingerprint"), fingerprints.as_text("changed").alias("edited_fingerprint"),
        fingerprints.likeness("own", "changed").alias("near_edited"), fingerprints.likeness("own", "following").alias("near_next"),
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good and not toxic; background: all documents."""
    docs = table(spark, sf_dir, "documents")
    good = written(table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id").distinct().withColumn("good", F.lit(True)), "good")
    return lm_score.scored(docs.select("doc_id", "text").join(sized(good), "doc_id", "left"), F.col("good"), "doc_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = language_id.train(docs.where(~language_id.held_out()))
    return language_id.identify(docs, trees, "doc_id").select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.transformed(table(spark, sf_dir, "documents"), "doc_id")
    restored = F.sha2(fill_in_middle.restored("output", "form"), 256).alias("restored_sha256")
    lengths = (F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle"))
    return found.select("doc_id", "n", "form", *lengths, F.sha2("output", 256).alias("output_sha256"), restored)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one run in 31, told by its hash, a letter is left out."""
    runs = spelling.runs(table(spark, sf_dir, "documents"), "doc_id")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, without).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.counted(words))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken(mixture.mixed(table(spark, sf_dir, "documents"))).drop("source")


QUERIES = {f.__name__: f for f in (op1_quality, op2_near_dedup, op3_decontaminate, op4_toxicity, op5_line_dedup, op6_fingerprints, op7_lm_score, op8_language_id, op9_license_scan, op10_byte_bpe, op11_fill_in_middle, op12_spelling, op13_mixture)}

ORACLE_SQL: dict[str, str] = {
    "op11_fill_in_middle": """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
    SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d FROM hashed),
formed AS (
    SELECT *, CASE WHEN text = '' OR c >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form,
           substr(text, 1, least(a, b)) AS prefix, substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(text, greatest(a, b) + 1) AS suffix FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM formed""",
    "op12_spelling": """
WITH RECURSIVE steps AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS step FROM range(256) AS r(i)),
runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hexed AS (SELECT id, run, count(*) AS n, hex(encode(id || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(list_transform(range(1, length(x), 2), lambda k: CAST('0x' || substr(x, k, 2) AS BIGINT)), lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS h FROM hexed, steps),
words AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cut AS (SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (
    SELECT a.word, b.word AS other FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION SELECT a.word, b.word FROM cut AS a JOIN words AS b ON a.rest = b.word
    UNION SELECT b.word, a.word FROM cut AS a JOIN words AS b ON a.rest = b.word),
best AS (
    SELECT p.word, count(*) AS n_near, max(o.n) AS form_n, list(p.other ORDER BY -o.n, encode(p.other))[1] AS form FROM pairs AS p JOIN words AS o ON o.word = p.other GROUP BY 1),
forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words AS w LEFT JOIN best AS b ON w.word = b.word),
chain(word, last) AS (
    SELECT word, word FROM forms
    UNION ALL SELECT c.word, f.form FROM chain AS c JOIN forms AS f ON c.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.last AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms AS f JOIN chain AS c ON f.word = c.word JOIN forms AS e ON c.last = e.word WHERE e.form IS NULL""",
}
