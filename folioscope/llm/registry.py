"""Queries ``opN_<name>``: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_hash, embedding_dedup, filter_audit, hamming_search, html_extract, mixing, packing, simhash, substring_dedup, toxicity, url_filter, warc
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2_048)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without words that 35-word repeats cover."""
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35, digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every vector whose id is divisible by 100."""
    codes = hamming_search.sign_codes(table(spark, sf_dir, "embeddings"))
    found = hamming_search.top_k(codes, codes.filter("id % 100 = 0"), k=10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "distance")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "slots")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document at 4 bits of 64."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), distance=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.98 within its label."""
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings"))


def op11_context_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they and the next one's are."""
    return context_hash.edited_neighbours(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders over every document, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_html_text, op3_substring_dedup, op4_toxicity, op5_warc, op6_url_filter, op7_hamming_top_k, op8_source_mix, op9_simhash_dedup, op10_embedding_dedup, op11_context_hash, op12_filter_audit)}

ORACLES = {
    "op3_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), win AS (
            SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
        ), hit AS (
            SELECT doc_id, i FROM win SEMI JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) USING (s)
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hit
        ), words AS (
            SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op5_warc": """
        WITH p AS (
            SELECT page_id, url, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS x FROM pages
        ), five AS (  -- each five hexadecimal digits are four letters of base 32
            SELECT *, list_transform(range(8), lambda g: list_reduce(list_transform(range(1, 6), lambda i: instr('0123456789abcdef', x[g * 5 + i]) - 1), lambda a, c: a * 16 + c)) AS v FROM p
        ), digested AS (
            SELECT page_id, url, octet_length(b) AS n, array_to_string(list_transform(v, lambda k: array_to_string(list_transform([32768, 1024, 32, 1], lambda d: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(k // d) % 32 + 1]), '')), '') AS d FROM five
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY d ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY d) AS top FROM digested
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN r > 1 THEN top END AS refers_to, true AS intact
        FROM placed
    """,
    "op7_hamming_top_k": """
        WITH bits AS (
            SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings
        ), pairs AS (
            SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
                   list_sum(list_transform(list_zip(q.b, r.b), lambda z: CAST(z[1] <> z[2] AS INTEGER))) AS distance
            FROM bits q, bits r WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance
        FROM ranked WHERE rank <= 10
    """,
    "op10_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL
        ), pairs AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach(x, y) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
        ), least AS (SELECT x, min(y) AS c FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least.c AS component_id, e.vec_id = least.c AS kept
        FROM embeddings e JOIN least ON least.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
    """,
    "op12_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), fails AS (
            SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                   100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f
            FROM d
        ), marked AS (
            SELECT part, f, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
                   doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
            FROM fails
        ), groups AS (
            SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM marked GROUP BY part, f
        ), k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k), orders AS (
            SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e
            WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
        ), steps AS (SELECT o, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders), met AS (
            SELECT part, o, step, o[step] AS own, n, g, x, f[o[step]] AS fail,
                   len(list_filter(o[1:step - 1], lambda j: f[j])) > 0 AS gone,
                   len(list_filter(f, lambda b: b)) = 1 AS once
            FROM steps, groups
        ), counted AS (
            SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS removed,
                   coalesce(sum(n) FILTER (fail AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fail AND once), 0) AS unique_fails,
                   coalesce(sum(g) FILTER (fail AND NOT gone), 0) AS good_lost, coalesce(sum(x) FILTER (fail AND NOT gone), 0) AS toxic_lost
            FROM met GROUP BY part, o, step, own
        )
        SELECT part, array_to_string(list_transform(o, lambda j: 'ABCDE'[j]), '') AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM counted
    """,
}
