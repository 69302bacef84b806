"""The corpus operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exactdedup, licenses, mixing, neardup, pii, quality, sharding, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source; rows and odd cases as mixing.mix() says."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by runs of three words at 0.85; odd cases as neardup.near_groups() says."""
    return neardup.near_groups(_table(spark, sf_dir, "documents"), width=3, least=85)


def op3_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds; odd cases as decontaminate.matches() says."""
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through archives and back; odd cases as warc.round_trip() says."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes; odd cases as sharding.byte_shards() says."""
    return sharding.byte_shards(_table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every url; odd cases as urlfilter.judge() says."""
    return urlfilter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data; odd cases as pii.find() says."""
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document; odd cases as quality.score() says."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op9_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document; odd cases as licenses.paragraphs() says."""
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; odd cases as exactdedup.exact_groups() says."""
    return exactdedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_systematic_mix, op2_tensored_minhash, op3_bm25_wand, op4_warc_segments, op5_byte_shards, op6_bloom_cascade, op7_pii_spans, op8_factorisation_machine, op9_licence_paragraphs, op10_chunk_recipes)}

ORACLE_SQL: dict[str, str] = {
    "op1_systematic_mix": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        k AS (SELECT source, source_size, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
                     source_size * 2.0::DOUBLE AS top, sum(source_size) OVER () * 1.5::DOUBLE AS everything FROM s),
        f AS (SELECT *, row_number() OVER w AS place,
                     (everything - coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM k WINDOW w AS (ORDER BY top / weight, source NULLS LAST)),
        t AS (SELECT source, source_size, coalesce(least(top, (SELECT arg_min(level, place) FROM f WHERE level <= top / weight) * weight), top) AS target,
                     ('0x' || substr(md5('mix-1|' || coalesce(source, chr(0))), 1, 8))::BIGINT AS start FROM f),
        e AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.start,
                     floor(CASE WHEN t.source_size > 0 THEN least(2.0::DOUBLE, t.target / t.source_size) ELSE 0.0 END * 4294967296)::BIGINT AS step
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY source ORDER BY size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before FROM e),
        c AS (SELECT *, ((((before + start) % 4294967296) + step) // 4294967296)::BIGINT AS copies FROM p)
        SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c""",
    "op2_tensored_minhash": r"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS MATERIALIZED (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.n >= 85 * (x.n + y.n - i.n)),
        both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.b),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op4_warc_segments": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY sha1(b)) AS first FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(hex, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, NULL::VARCHAR AS fault FROM h""",
    "op6_bloom_cascade": r"""
        WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
                             WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
                             WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
                             WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
                             WHEN ('.' || host) LIKE '%.org' THEN 'org/' END AS rule,
                     regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') AS listed FROM u)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op10_chunk_recipes": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare, length(coalesce(text, '')) AS n FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g""",
}
