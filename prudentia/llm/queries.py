"""The queries on the corpus tables, one per operator, and their SQL.

Each is a thin wrapper: it reads whole tables, applies an operator of this
subpackage and derives the columns asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = 40
SOURCE_WEIGHTS = [5.0, 2.0, 1.0]


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prudentia.llm.sharding import interleave

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = interleave(docs, SHARDS, "source", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prudentia.llm.mixing import mix, word_count
    from prudentia.llm.storage import written

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(written(docs, "sizes"), "source", "size", "doc_id", SOURCE_WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "source", "repeats")


def op1_merged_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prudentia.llm.suffix_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).drop("removed")


def op2_elias_fano_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from prudentia.llm.token_store import read_store, write_store

    docs = table(spark, sf_dir, "documents")
    return read_store(write_store(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json")))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prudentia.llm.archives import convert, page_of, warc_index, write_arcs

    pages = table(spark, sf_dir, "pages")
    version = F.when(F.col("page_id") % 2 == 0, F.lit(1)).otherwise(F.lit(2))  # both forms of the legacy format
    warcs = convert(write_arcs(pages, version), strict=True)
    return warc_index(warcs).select(page_of(F.col("url")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM k)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM m
"""


def piece_model() -> str:
    """Where the installed tokenizers keep the piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_piece_spans(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    from prudentia.llm.pieces import digest

    return digest(table(spark, sf_dir, "documents"), model or piece_model())


def op7_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prudentia.llm.perplexity import judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, keep_text=False)


def op8_wordpiece_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    from prudentia.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary or public_tokenizers.path("word_bpe_49k.json"), keep_text=False)


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prudentia.llm.permutation_index import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


def op10_chosen_path_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prudentia.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prudentia.llm.simhash import simhash_duplicates

    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op12_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prudentia.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op13's contract: every tenth checksum's text ends in a period
    of its own words.  Without a doc_id nothing is planted."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prudentia.llm.periodic_runs import periodic_runs

    docs = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False, rewrite=planted)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("inverse"))))
    shown = docs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return shown.select(
        "doc_id", "n_runs", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.inverse")).alias("period"),
        F.expr("best.length * 1000 div -best.inverse").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS dice
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3.0::DOUBLE AS cap
  FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.0::DOUBLE
             - coalesce(sum(cap) OVER below, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0.0::DOUBLE)) AS level
  FROM w
  WINDOW below AS (ORDER BY cap / weight, source_size, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT max(level) AS level FROM l WHERE level <= cap / weight),
t AS (SELECT l.source, l.source_size,
             CASE WHEN f.level IS NULL THEN l.cap ELSE least(l.cap, f.level * l.weight) END AS target
      FROM l, f),
r AS (
  SELECT d.doc_id, d.size, d.source, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.dice, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, target - whole * source_size AS rest, size > 0 AND before + size <= target - whole * source_size AS fits FROM r),
g AS (SELECT source, max(rest) - sum(CASE WHEN fits THEN size ELSE 0 END) AS gap FROM q GROUP BY source),
b AS (SELECT q.source, min({'off': abs(size - gap), 'at': before}) AS best
      FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source
      WHERE NOT fits AND size > 0 AND abs(size - gap) < gap GROUP BY q.source),
k AS (SELECT q.*, CAST(whole + CASE WHEN fits OR (size > 0 AND coalesce(before = b.best.at, false)) THEN 1 ELSE 0 END AS BIGINT) AS repeats
      FROM q LEFT JOIN b ON q.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(repeats * size AS BIGINT) AS taken, source, repeats FROM k
"""

OP4_SQL = f"""
WITH tab AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (
  SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
d AS (
  SELECT doc_id, source, size, CAST(xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
           lambda c, x: xor(xor(xor(c, x) >> 4, t[(xor(c, x) & 15) + 1]) >> 4, t[(xor(xor(c, x) >> 4, t[(xor(c, x) & 15) + 1]) & 15) + 1]))) AS BIGINT) AS text_crc32
  FROM b, tab),
h AS (SELECT *, ('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':' || size), 1, 15))::BIGINT AS dice FROM d),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY dice, doc_id NULLS FIRST, text_crc32, size) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS part FROM h),
p AS (
  SELECT *, row_number() OVER (ORDER BY part, source NULLS LAST, dice, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {SHARDS} // total AS INT) AS shard,
       CAST(place - (place * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source
FROM p
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP10_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS grams FROM w),
k AS (SELECT min(doc_id) AS class, grams FROM s WHERE len(grams) > 0 GROUP BY grams),
e AS (SELECT class, len(grams) AS n, unnest(grams) AS gram FROM k),
p AS (
  SELECT a.class AS a, b.class AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM e a JOIN e b ON a.gram = b.gram AND a.class < b.class GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (na + nb - common)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT class AS a, class AS b FROM k UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a),
c AS (SELECT a AS class, min(b) AS component FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id, s.doc_id = coalesce(c.component, s.doc_id) AS kept
FROM s LEFT JOIN k ON s.grams = k.grams LEFT JOIN c ON c.class = k.class
"""

OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merged_bwt_dedup": op1_merged_bwt_dedup,
    "op2_elias_fano_store": op2_elias_fano_store,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_stratified_shards": op4_stratified_shards,
    "op5_piece_spans": op5_piece_spans,
    "op6_source_mix": op6_source_mix,
    "op7_perplexity_bands": op7_perplexity_bands,
    "op8_wordpiece_counts": op8_wordpiece_counts,
    "op9_permutation_index": op9_permutation_index,
    "op10_chosen_path_dups": op10_chosen_path_dups,
    "op11_vantage_simhash": op11_vantage_simhash,
    "op12_svd_whitening": op12_svd_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(OPERATORS)


def oracle_sql() -> dict[str, str]:
    return {"op3_arc_to_warc": OP3_SQL, "op4_stratified_shards": OP4_SQL, "op6_source_mix": OP6_SQL, "op10_chosen_path_dups": OP10_SQL}
