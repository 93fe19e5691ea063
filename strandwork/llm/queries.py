"""The registered queries of this subpackage: each applies one operator to a whole table with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm import bpe, forest, lines, mixing, neardup, packing, quality, secrets, sharding, spelling, urltree, warc, whitening
from strandwork.llm.common import read_table, shared_dir


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def public_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_vocabulary, keep_ids=False)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return secrets.scan(docs).drop("path")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judge(docs).drop("text", "lang")


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return forest.nearest(vectors, vectors.where("vec_id % 50 = 0"))


URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op2_urltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number its url names (its html holds that document's text, and the language of its
    path is the document's), so the document's toxicity label is the page's."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    shown = pages.select("page_id", F.regexp_extract("url", r"/(\d+)(?:\.\w+|/)?(?:[?#].*)?$", 1).try_cast("long").alias("doc_id"))
    labels = shown.join(read_table(spark, sf_dir, "labels"), "doc_id").select("page_id", (F.col("toxic") == 1).alias("bad"))
    return urltree.judge(pages, labels, URL_RULES)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(read_table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.plan(read_table(spark, sf_dir, "documents"))
    return units.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key", "group_key")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.remove_repeated(docs, wrap=lines.WRAP).withColumn("n_chars_left", F.length("text"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_ranks)
    said = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    back = bpe.decode(held.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), "ids"), public_ranks)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {
    "op1_forest": op1_forest,
    "op2_urltree": op2_urltree,
    "op3_warc": op3_warc,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_neardup": op9_neardup,
    "op10_lines": op10_lines,
    "op11_spelling": op11_spelling,
    "op12_bpe": op12_bpe,
    "op13_whitening": op13_whitening,
}
#: Records with equal payloads of 1000 bytes or more: the largest page_id is the response.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""

def _round_sql(n: int) -> str:
    """One round of the mix: words still missing go to documents that fit, in rank order."""
    return f"""
f{n} AS (SELECT *, copies < least(floor(rate) + 1, 2) AND words <= missing AS fits FROM r{n - 1}),
o{n} AS (SELECT *, sum(CASE WHEN fits THEN words ELSE 0 END) OVER (PARTITION BY no ORDER BY place, doc_id NULLS FIRST, h NULLS FIRST, size, nth
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM f{n}),
g{n} AS (SELECT *, fits AND total <= missing AS got FROM o{n}),
r{n} AS (SELECT * EXCLUDE (copies, missing, fits, total, got), copies + got::INT AS copies,
  missing - sum(CASE WHEN got THEN words ELSE 0 END) OVER (PARTITION BY no) AS missing FROM g{n})"""


MIXING_SQL = rf"""
WITH w AS (SELECT doc_id, source, md5(text) AS h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
u AS (SELECT *, n * size AS words FROM (SELECT doc_id, source, h, size, count(*) AS n FROM w GROUP BY ALL)),
s AS (SELECT source, sum(words)::BIGINT AS source_size FROM u GROUP BY source),
m AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no, 2.0::DOUBLE * source_size AS most FROM s),
q AS (SELECT *, [5.0, 2.0, 1.0][(no - 1) % 3 + 1]::DOUBLE AS weight FROM m),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
t AS (SELECT source, source_size, no, least(most, weight * max(level) OVER ()) AS target FROM l),
v AS (SELECT u.doc_id, u.source, u.h, u.size, u.size AS words, unnest(range(1, u.n + 1)) AS nth, t.source_size, t.no, t.target, CASE WHEN size < 16 THEN 0.25 WHEN size < 64 THEN 0.5 WHEN size < 2048 THEN 1.0 ELSE 0.5 END::DOUBLE AS weight
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
c AS (SELECT no, target, weight, sum(words)::DOUBLE AS class_words FROM v GROUP BY ALL),
e AS (SELECT no, (target - coalesce(sum(class_words * 2.0::DOUBLE) OVER (PARTITION BY no ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / nullif(sum(class_words * weight) OVER (PARTITION BY no ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM c),
a AS (SELECT no, max(level) AS level FROM e GROUP BY no),
d AS (SELECT v.*, coalesce(least(weight * level, 2.0::DOUBLE), 0) AS rate,
  (('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '') || CASE WHEN nth = 1 AND doc_id IS NOT NULL THEN '' ELSE '|' || coalesce(h, '') || '|' || nth END), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS x FROM v JOIN a USING (no)),
p AS (SELECT *, floor(rate)::INT AS copies, rate - floor(rate) AS p FROM d),
k AS (SELECT *, CASE WHEN p > 0 THEN x / (1 - x) / (p / (1 - p)) END AS odds FROM p),
r0 AS (SELECT *, CASE WHEN p > 0 THEN odds / (1 + odds) ELSE 1 + x END AS place, target - sum(copies * words) OVER (PARTITION BY no) AS missing FROM k),
{_round_sql(1)},{_round_sql(2)},{_round_sql(3)}
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM r3
"""

#: Every pair that shares a shingle, then the least id by recursion over the links.
NEARDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 4, 1) END)) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT b, low FROM r JOIN both_ways ON a = doc_id),
m AS (SELECT doc_id, min(low) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
#: The others are judged by models, archives' offsets, checksums, edits, tokens or eigenvectors that SQL lacks; tests hold them to brute force.
ORACLES: dict[str, str] = {"op3_warc": WARC_SQL, "op5_mixing": MIXING_SQL, "op9_neardup": NEARDUP_SQL}
