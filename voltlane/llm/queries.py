"""Registered queries ``opN_<name>`` over whole tables, and the SQL where SQL can state the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm import bpe, exact, forest, mixing, near, negatives, packing, pii, quality, repeats, rollups, secrets, trie
from voltlane.llm.common import documents


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_measures(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(documents(spark, sf_dir))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digests(documents(spark, sf_dir))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.maintained_totals(documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.write_and_read(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.hard_negatives(moved, F.col("id") % 100 == 0)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_quality, op2_near_dedup, op3_repeats, op4_personal_data, op5_exact_dedup, op6_mixing, op7_token_rollups, op8_bpe, op9_secrets, op10_token_files,
        op11_hard_negatives, op12_conversation_trie, op13_embedding_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS f
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.n AS a, a.vec_id AS anchor_id, b.n AS b, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.f, b.f)::BIGINT AS score
            FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 100 = 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) AS place FROM s WHERE same QUALIFY place <= 5),
        f AS (
            SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.id, s.b)::INTEGER AS rank
            FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM f WHERE rank <= 10
    """,
    # crc32 bit by bit: an entry of 0 or more is the next byte, each -1 a shift
    "op12_conversation_trie": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (
            SELECT conv_id, count(*) AS own, conv_id - conv_id % 100 AS base, xor(list_reduce(
                list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))::HUGEINT[]),
                lambda s, o: CASE WHEN o >= 0 THEN xor(s, o) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) % 6 AS head
            FROM t GROUP BY conv_id),
        k AS (SELECT c.conv_id, c.base, c.head, least(c.head, coalesce(b.own, 0)) AS shared, least(c.head, coalesce(b.own, 0)) + greatest(c.own - c.head, 0) AS n
              FROM c LEFT JOIN c b ON b.conv_id = c.base),
        r AS (
            SELECT k.conv_id, t.place, role, text FROM k JOIN t ON t.conv_id = k.base WHERE t.place < k.shared
            UNION ALL
            SELECT k.conv_id, t.place - k.head + k.shared, role, text FROM k JOIN t USING (conv_id) WHERE t.place >= k.head),
        p AS (
            SELECT conv_id, place + 1 AS depth, length(text) AS tokens, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (
                PARTITION BY conv_id ORDER BY place)) AS name FROM r
            UNION ALL SELECT conv_id, 0, 0, '' FROM k),
        g AS (
            SELECT depth, name, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(tokens) AS tokens,
                   sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (n = depth), '')) AS ends_sha256
            FROM p JOIN k ON k.conv_id = p.conv_id GROUP BY depth, name),
        m AS (SELECT p.conv_id, p.depth, g.conv_id AS node FROM p JOIN g USING (depth, name)),
        e AS (SELECT g.*, m.node AS parent_conv_id FROM g LEFT JOIN m ON m.conv_id = g.conv_id AND m.depth = g.depth - 1),
        d AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM e WHERE depth > 0 GROUP BY ALL),
        v AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN d ON d.conv_id = e.conv_id AND d.depth = e.depth),
        s AS (SELECT m.node AS conv_id, m.depth, sum((v.n_children = 0)::BIGINT) AS n_leaves, sum((v.n_convs - 1) * v.tokens) AS saved_tokens
              FROM v JOIN m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY ALL)
        SELECT v.conv_id::BIGINT AS conv_id, v.depth::BIGINT AS depth, parent_conv_id::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs,
               n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
        FROM v JOIN s ON s.conv_id = v.conv_id AND s.depth = v.depth
    """,
    "op13_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS e,
                   vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
            FROM embeddings),
        l AS (
            SELECT a.n AS a, b.n AS b, b.vec_id FROM v a JOIN v b ON a.label = b.label AND a.n <> b.n
            WHERE a.usable AND b.usable AND list_cosine_similarity(a.e, b.e) >= 0.93),
        r(n, vec_id) AS (SELECT n, vec_id FROM v UNION SELECT l.b, r.vec_id FROM r JOIN l ON l.a = r.n),
        c AS (SELECT n, min(vec_id) AS component_id FROM r GROUP BY n),
        d AS (SELECT a AS n, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
        FROM v JOIN c USING (n) LEFT JOIN d USING (n)
    """,
}
