"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .embedding_dedup import near_duplicates
from .line_dedup import dedup_lines
from .mixing import mix
from .ngram_join import similar_sets
from .packing import pack
from .quality import THRESHOLD, held_out, learn, score_documents
from .quotes import link_quotes
from .token_store import token_round_trip
from .topk import scaled_rows, top_k
from .warc import archive_round_trip


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quoting(messages: DataFrame) -> DataFrame:
    """Messages that quote, as the table's own don't: each begins with the last turn's text behind ``> `` marks (of turns that
    occur more than once, the least text; marks in a text make deeper levels)."""
    before = messages.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("said"))
    quote = F.concat(F.lit("> "), F.replace(F.col("said"), F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return messages.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.when(F.col("said").isNull(), F.col("text")).otherwise(quote).alias("text"))


def op4_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(quoting(table(spark, sf_dir, "conversations")))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(spark, table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "lines_in", "lines_out", "text")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents")).taken()


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return archive_round_trip(spark, table(spark, sf_dir, "pages")).select(*cols)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_top_k, op2_ngram_join, op3_quality, op4_quote_links, op5_token_store, op6_packing, op7_line_dedup, op8_embedding_dedup, op9_mixing, op10_warc)}

ORACLES = {
    "op1_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 10""",
    "op2_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
        g AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN c ON c.a = s.doc_id""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages),
        d AS (SELECT *, sha1(h) AS x FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, ((k // 4) * 5 + 1)::INT, 5))::BIGINT) >> (15 - 5 * (k % 4))::BIGINT) & 31)::INT + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
        FROM d""",
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
        r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
        SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
               coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
