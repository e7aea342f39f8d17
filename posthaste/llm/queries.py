"""The dealt queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthaste.llm import (
    clustering, decontaminate, importance, language, licenses, mixing, near_dup, nearest, personal, quality, secrets, sharding, url_filter)

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "text_crc32", F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0).cast("long")))
    return sharding.shard(docs, shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_held_out(table(spark, sf_dir, "documents"))


def op8_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = nearest.quantized(table(spark, sf_dir, "embeddings"), 256)
    return nearest.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.scan(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, centroids, _ = clustering.clustered(table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1)
    return clustering.with_totals(placed, centroids)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_shards, op3_url_rules, op4_contamination, op5_licenses, op6_quality,
    op7_language, op8_top_inner_products, op9_secrets, op10_mixture, op11_personal, op12_importance, op13_clusters, pipeline)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all(coalesce({_LOWER.format('text')}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_URL_RULES = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)

_DISTANCE = "list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"


def _rounds(rounds: int) -> str:
    """Assignment a0 to the centroids c0, the means c1 of its clusters, and so on to a<rounds>."""
    parts = []
    for r in range(rounds + 1):
        if r > 0:
            parts.append(f"""c{r} AS (
                SELECT c, coalesce(m.y, o.y) AS y FROM c{r - 1} o LEFT JOIN (
                    SELECT c, list(f ORDER BY i) AS y FROM (
                        SELECT c, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS f
                        FROM a{r - 1} JOIN v USING (line), range(1, 65) t(i) GROUP BY c, i) GROUP BY c) m USING (c))""")
        parts.append(f"""a{r} AS (
            SELECT line, arg_min(c, {_DISTANCE} * 16 + c) AS c, min({_DISTANCE}) AS d FROM v, c{r} GROUP BY line)""")
    return ", ".join(parts)


# Operators that are trained, packed or scheduled, or need checksums, have no SQL; tests hold
# them against plain versions.
SQL = {
    "op1_near_duplicates": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format('text')}, ''), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN list_slice(w, 1, 3) ELSE list_slice(w, i, i + 2) END AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
            FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (
            SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
            WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
        r AS (
            SELECT doc_id AS x, doc_id AS y FROM d
            UNION
            SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
        k AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)""",
    "op3_url_rules": f"""
        WITH rules(verdict, rule, h, p) AS (VALUES {_URL_RULES}),
        u AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
            FROM pages),
        s AS (
            SELECT page_id, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM u),
        f AS (
            SELECT s.*, (SELECT max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM rules
                         WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
            FROM s)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM f""",
    "op4_contamination": f"""
        WITH b AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
                coalesce({_LOWER.format('text')}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark),
        windows AS (
            SELECT DISTINCT item, list_slice(w, i, i + 12) AS g
            FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
        d AS (
            SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(
                coalesce({_LOWER.format('text')}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents),
        spots AS (
            SELECT line, i, n, list_slice(w, i, i + n - 1) AS g
            FROM (SELECT line, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM d, (SELECT DISTINCT len(g) AS n FROM windows))),
        found AS (SELECT line, i, n, item FROM spots JOIN windows USING (g)),
        hit AS (
            SELECT line, count(DISTINCT place) AS n_hit
            FROM (SELECT line, unnest(range(i, i + n)) AS place FROM found) GROUP BY 1),
        items AS (
            SELECT line, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT line, item FROM found) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (line) LEFT JOIN items USING (line)""",
    # CRC-32 by a table of 256 entries, over the bytes of each distinct word.
    "op12_importance": f"""
        WITH crcs AS (
            SELECT list(list_reduce(list_prepend(b, range(8)),
                                    lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS k
            FROM range(256) t(b)),
        d AS (SELECT row_number() OVER () AS line, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT unnest({_WORDS}) AS g FROM benchmark),
        f AS (SELECT line, unnest(w) AS g FROM d),
        words AS (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM f UNION SELECT g FROM b)),
        place AS (
            SELECT g, xor(list_reduce(
                list_prepend(4294967295, list_transform(range(0, len(h) // 2),
                    lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                lambda c, x: xor(c >> 8, k[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket
            FROM words, crcs),
        s AS (SELECT bucket, count(*) AS s FROM f JOIN place USING (g) GROUP BY 1),
        t AS (SELECT bucket, count(*) AS t FROM b JOIN place USING (g) GROUP BY 1),
        gain AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * CAST((SELECT count(*) FROM f) + 10000 AS DOUBLE)
                / ((s + 1) * CAST((SELECT count(*) FROM b) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (bucket)),
        weights AS (SELECT line, sum(gain) AS weight FROM f JOIN place USING (g) JOIN gain USING (bucket) GROUP BY 1),
        scored AS (
            SELECT line, doc_id, len(w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                   CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8)
                       AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM d LEFT JOIN weights USING (line)),
        ranked AS (
            SELECT line, row_number() OVER (ORDER BY score DESC, doc_id, n, weight) AS place, count(*) OVER () AS able
            FROM scored WHERE n >= 20)
        SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score,
               CASE WHEN place <= 10 * able // 100 THEN place END AS rank
        FROM scored LEFT JOIN ranked USING (line)""",
    "op13_clusters": f"""
        WITH v AS (
            SELECT row_number() OVER () AS line, vec_id,
                   list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS (
            SELECT nth - 1 AS c, x AS y FROM (
                SELECT x, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) AS nth
                FROM v)
            WHERE nth <= 16),
        {_rounds(3)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
               CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(y, ',')) AS centroid_sha256
        FROM a3 JOIN v USING (line) JOIN c3 USING (c)""",
    "op8_top_inner_products": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        p AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5""",
}
