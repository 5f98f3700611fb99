"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import owning
from . import bagminhash, chat, exact, html, langid, lines, mixing, negatives, packing, quality, suffix, urls, whitening

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
             ("com/fr/", "allow"), ("com/de/", "block")]
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
MIX_SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query; its tables in the shared folder stay until `session.release(result)`."""
    def put(fn):
        QUERIES[name] = owning(fn)
        if sql:
            ORACLE[name] = sql
        return fn
    return put


@query("op2_url_filter")
def op2(spark, sf_dir):
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "decided_by", "trust", "distrust")


@query("op3_quality_rules")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule_no")


@query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact.group_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op9_source_mix", f"""
WITH RECURSIVE counted AS (
  SELECT source, count(*) AS n, CASE source {' '.join(f"WHEN '{s}' THEN {w}" for s, w in MIX_WEIGHTS.items())} ELSE 1.0 END::DOUBLE AS w
  FROM documents GROUP BY source),
rated AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM counted)::DOUBLE * w / (SELECT sum(w) FROM counted) / n AS rate FROM counted),
parts AS (SELECT source, greatest(1, ceil(rate / 64))::INT AS parts, rate / greatest(1, ceil(rate / 64))::INT AS mean FROM rated),
steps(source, mean, k, p, c) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM parts
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps
  WHERE k < ceil(mean + 12 * sqrt(mean) + 40)),
drawn AS (
  SELECT d.doc_id, d.source, ('0x' || substr(md5('{MIX_SEED}|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS j)),
found AS (SELECT doc_id, drawn.source, count(*) AS n FROM drawn JOIN steps s ON drawn.source IS NOT DISTINCT FROM s.source AND s.c <= drawn.u GROUP BY doc_id, drawn.source)
SELECT doc_id, source, i::INT AS copy, md5('order {MIX_SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || i) AS shuffle_key
FROM (SELECT doc_id, source, unnest(range(0, n)) AS i FROM found)""")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.poisson_mix(docs, MIX_WEIGHTS, seed=MIX_SEED).select("doc_id", "source", "copy", "shuffle_key")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def ids_crc32(ids):
    """CRC-32 of the ids as unsigned little-endian 32-bit numbers."""
    @F.arrow_udf("bigint")
    def crc(lists: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in lists], pa.int64())
    return crc(ids)


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    # The digest is taken where the ids lie, so that only narrow rows meet the plan of the bins.
    pieces = packing.written_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    narrow = pieces.withColumn("ids_crc32", ids_crc32("ids")).drop("ids")
    return packing.place_pieces(narrow).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op6_suffix_dedup")
def op6(spark, sf_dir):
    cut = suffix.repeated_spans(table(spark, sf_dir, "documents"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return cut.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept_bytes")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query("op5_bagminhash_dedup")
def op5(spark, sf_dir):
    return bagminhash.near_classes(table(spark, sf_dir, "documents"))


@query("op4_language_codes")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op8_prefix_chat")
def op8(spark, sf_dir):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.prefix_examples(turns.unionByName(extra)))


@query("op10_style_tree_text")
def op10(spark, sf_dir):
    pages = html.extract_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


_ASCII_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op13_line_dedup", f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, {_ASCII_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, line, i, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""")
def op13(spark, sf_dir):
    cut = lines.repeated_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op12_whitening")
def op12(spark, sf_dir):
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = white.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error",
                        F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "of"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"),
                       F.col("of.explained").alias("explained"), "identity_error")


@query("op11_hard_negatives", """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
    CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM valid a JOIN valid r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 10""")
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)
