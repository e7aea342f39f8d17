"""Named queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from posthaste import schemas
from posthaste.functions import clock, numeric, text
from posthaste.operators import (annotate, dedupe, encoding, filters, keywords, model, pooling, ranks,
                                 reports, rubric, splits, stats, training)
from posthaste.operators.rubric import CHOICES, NOUL, NUMERIC, QUESTIONS
from posthaste.plans import annotation, curate, train
from posthaste.session import release_shuffles, work_dir
from posthaste.sources import history, samples, tables
from posthaste.streaming import posts as streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name; without SQL only rows are checked."""
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return register


# --- parameters and the SQL form of the sample tables ---------------------

START, END = "2024-01-01 06:00:00", "2024-01-02 18:00:00"
RULES = filters.CandidateRules(min_len=50, max_len=5000, start=START, end=END, min_engagement=50)
CHUNK = 150
KEYWORDS = ["house", "then", "ing", "and th", "ouen", "nterti", "whou", "the"]

_WS = "||".join(f"chr({ord(c)})" for c in text.WHITESPACE)


def _strip(column: str) -> str:
    return f"trim({column}, {_WS})"


_SECOND = "strftime(created_ts, '%Y-%m-%d %H:%M:%S')"

POSTS = """posts AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS tweet_id, d.doc_id AS ord, d.text, d.lang,
         d.source AS query_source, strftime(e.ts, '%a %b %d %H:%M:%S +0000 %Y') AS created_at,
         e.ts AS created_ts, CAST(floor(e.value) AS BIGINT) AS likes,
         CAST(json_extract(e.props, '$.k') AS BIGINT) AS replies, e.user_id % 50 AS reposts
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""

# A post for every event; the documents take turns as texts.
EVENT_POSTS = POSTS.replace("ON e.event_id = d.doc_id", "ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)").replace(
    "CAST(d.doc_id AS VARCHAR) AS tweet_id, d.doc_id AS ord", "CAST(e.event_id AS VARCHAR) AS tweet_id, e.event_id AS ord")

_TWICE = """, arrivals AS (
  SELECT *, 1 AS arrival FROM posts
  UNION ALL
  SELECT * REPLACE (likes + 100 AS likes), 2 AS arrival FROM posts WHERE ord % 10 = 0)"""
ARRIVALS = POSTS + _TWICE
EVENT_ARRIVALS = EVENT_POSTS + _TWICE

_PASSES = f"""length({_strip('coalesce(text, chr(32))')}) BETWEEN 50 AND 5000
  AND date_trunc('second', created_ts) >= TIMESTAMP '{START}'
  AND date_trunc('second', created_ts) < TIMESTAMP '{END}'
  AND coalesce(likes, 0) + coalesce(replies, 0) + coalesce(reposts, 0) >= 50"""


def _sql_answer(question: str, factor: int) -> str:
    kind = QUESTIONS[question]["type"]
    if kind == "noul":
        return f"(n * {factor} % 101) / 1e2"
    if kind == "score":
        return f"CAST(n * {factor} % 5 AS DOUBLE)"
    options = ", ".join(f"'{o}'" for o in QUESTIONS[question]["criteria"])
    return f"list_extract([{options}], CAST(n * {factor} % 7 AS INTEGER) + 1)"


_ANSWERS_SQL = ", ".join(
    f"CASE WHEN ok THEN {e} END AS {name}" for name, e in
    {"input_tokens": "n", "output_tokens": "CAST(12 AS BIGINT)",
     **{q: _sql_answer(q, p) for q, p in zip(QUESTIONS, annotate.OFFLINE_FACTORS)}}.items())

ANNOTATED = f"""annotated AS (
  SELECT ord, text, {_ANSWERS_SQL}
  FROM (SELECT doc_id AS ord, text, CAST(length(text) AS BIGINT) AS n, doc_id % 37 <> 0 AS ok
        FROM documents))"""

CHUNKED = ANNOTATED + f""", chunked AS (
  SELECT *, CAST(floor((row_number() OVER (ORDER BY ord) - 1) / {CHUNK}) AS BIGINT) AS chunk_id
  FROM annotated)"""

TRAINING = """training AS (
  SELECT d.doc_id AS ord, d.text,
         8e-1 * l.toxic + 1e-1 * (1 - l.quality) + (length(d.text) % 11) / 11e1 AS score
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

PREDICTIONS = TRAINING + """, predictions AS (
  SELECT *, least(1e0, score * 9e-1 + 2e-2) AS p FROM training)"""


def _options_sql() -> str:
    rows = [f"('{q}', '{q2}')" for q, v in QUESTIONS.items()
            for q2 in (map(str, range(len(v["criteria"]))) if v["type"] == "score" else v["criteria"])]
    return f"options(question, option_key) AS (VALUES {', '.join(rows)})"


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text, for a comparison that does not depend on types."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _chunked(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_chunks(samples.annotated(spark, sf), CHUNK)


def _keyword_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(KEYWORDS)), "kw_id int, keyword string")


# --- sources and sinks ----------------------------------------------------

@query(f"WITH {POSTS} SELECT tweet_id, text, created_at, likes, replies, reposts FROM posts")
def scan_posts(spark, sf):
    return samples.posts(spark, sf).select(*schemas.POSTS_RAW.fieldNames())


@query("SELECT doc_id AS ord, text FROM documents")
def csv_round_trip(spark, sf):
    path = work_dir(spark, "posts") + ".csv"
    rows = samples.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return tables.read_table(spark, path, schemas.CLEANED)


@query(f"WITH {POSTS} SELECT min(ord) AS ord, {_strip('text')} AS text FROM posts GROUP BY {_strip('text')}")
def publish_replace(spark, sf):
    place = work_dir(spark, "cleaned")
    tables.publish(filters.select_text(samples.posts(spark, sf)), place)
    tables.publish(dedupe.clean(tables.read_published(spark, place, schemas.CLEANED)), place)
    return tables.read_published(spark, place, schemas.CLEANED)


@query(f"""WITH {PREDICTIONS}, errors AS (
  SELECT avg(abs(p - score)) AS mae, avg((p - score) * (p - score)) AS mse, count(*) AS n FROM predictions)
  SELECT CAST(i AS BIGINT) AS seed, n AS n_test, round(mae, 6) AS mae, round(sqrt(mse), 6) AS rmse
  FROM errors, range(2) r(i)""")
def run_history(spark, sf):
    place = work_dir(spark, "runs")
    rows = samples.predictions(spark, sf)
    found = stats.regression_metrics(rows, "score", "p").first().asDict()
    for seed in range(2):
        history.save_metadata(spark, place, {"run_id": str(seed), "test_metrics": found,
                                             "n_test": rows.count(), "seed": seed})
    runs = history.load_metadata(spark, place)
    return _rounded(runs.select("seed", "n_test", "test_metrics.mae", "test_metrics.rmse"))


# --- projections, filters, assertions -------------------------------------

@query(f"WITH {POSTS} SELECT ord, text FROM posts")
def project_text(spark, sf):
    return filters.select_text(samples.posts(spark, sf))


@query(f"WITH {ANNOTATED} SELECT * EXCLUDE (input_tokens, output_tokens) FROM annotated")
def drop_columns(spark, sf):
    return filters.drop_cols(samples.annotated(spark, sf), "input_tokens", "output_tokens")


@query(f"WITH {POSTS} SELECT ord FROM posts WHERE length({_strip('text')}) BETWEEN 50 AND 280")
def length_filter(spark, sf):
    return filters.length_between(samples.posts(spark, sf)).select("ord")


@query(f"WITH {EVENT_POSTS} SELECT ord FROM posts WHERE created_ts >= TIMESTAMP '{START}' AND created_ts < TIMESTAMP '{END}'")
def window_filter(spark, sf):
    return filters.in_window(samples.event_posts(spark, sf), START, END).select("ord")


@query(f"WITH {EVENT_POSTS} SELECT ord, likes, replies, reposts FROM posts WHERE likes + replies + reposts >= 50")
def engagement_filter(spark, sf):
    return filters.min_engagement(samples.event_posts(spark, sf)).select("ord", "likes", "replies", "reposts")


@query(f"""WITH {POSTS} SELECT tweet_id, {_strip('text')} AS text, created_at, {_SECOND} AS created_ts,
  likes, replies, reposts, likes + replies + reposts AS engagement_total, query_source
  FROM posts WHERE {_PASSES}""")
def candidate_posts(spark, sf):
    found = filters.candidates(samples.posts(spark, sf).drop("ord", "lang"), RULES)
    return _shown(found, "created_ts")


@query(f"""WITH {POSTS}, judged AS (SELECT CASE
    WHEN NOT length({_strip('text')}) BETWEEN 50 AND 5000 THEN 'length'
    WHEN NOT (date_trunc('second', created_ts) >= TIMESTAMP '{START}'
              AND date_trunc('second', created_ts) < TIMESTAMP '{END}') THEN 'date'
    WHEN likes + replies + reposts < 50 THEN 'engagement' ELSE 'kept' END AS reason FROM posts)
  SELECT reason, count(*) AS posts FROM judged GROUP BY reason""")
def candidate_funnel(spark, sf):
    return filters.candidate_funnel(samples.posts(spark, sf), RULES)


@query(f"WITH {POSTS}, t AS (SELECT ord, CASE WHEN ord % 5 = 0 THEN chr(8195) || chr(10) ELSE text END AS text FROM posts) "
       f"SELECT ord FROM t WHERE length({_strip('text')}) > 0")
def nonempty_text(spark, sf):
    blank = F.when(F.col("ord") % 5 == 0, " \n").otherwise(F.col("text"))
    return filters.nonempty(samples.posts(spark, sf).withColumn("text", blank)).select("ord")


_SHIFTED = f"""WITH {TRAINING}, shifted AS (SELECT ord, CASE WHEN ord % 9 = 0 THEN NULL
  WHEN ord % 9 = 1 THEN CAST('nan' AS DOUBLE) WHEN ord % 9 = 2 THEN score + 1 ELSE score END AS score FROM training)"""


def _shifted(spark, sf):
    turn = F.col("ord") % 9
    score = (F.when(turn == 0, None).when(turn == 1, float("nan"))
             .when(turn == 2, F.col("score") + 1).otherwise(F.col("score")))
    return samples.training(spark, sf).withColumn("score", score)


@query(f"""{_SHIFTED} SELECT count(*) AS n_rows,
  count(*) FILTER (WHERE score IS NULL OR isnan(score)) AS n_missing,
  count(*) FILTER (WHERE score IS NOT NULL AND NOT isnan(score) AND NOT score BETWEEN 0 AND 1) AS n_out_of_range
  FROM shifted""")
def score_check(spark, sf):
    return filters.score_check(filters.require_columns(_shifted(spark, sf), ["text", "score"]), "score")


@query(f"{_SHIFTED} SELECT ord, round(score, 6) AS score FROM shifted WHERE score IS NOT NULL AND NOT isnan(score)")
def drop_missing_scores(spark, sf):
    return _rounded(filters.drop_missing(_shifted(spark, sf), "score").select("ord", "score"))


@query(f"WITH {TRAINING} SELECT ord, round(score, 6) AS score FROM training WHERE score BETWEEN 0 AND 1")
def asserted_range(spark, sf):
    return _rounded(filters.assert_range(samples.training(spark, sf), "score").select("ord", "score"))


def _search_sql(table: str) -> str:
    return f"""hits AS (
  SELECT p.ord, k.kw_id, k.keyword FROM posts p JOIN {table} k ON contains(lower(p.text), lower(k.keyword))
  WHERE p.lang = 'en' AND p.likes >= 16 AND p.created_ts >= TIMESTAMP '{START}'
    AND p.created_ts < TIMESTAMP '{END}'),
  first_hit AS (SELECT ord, arg_min(keyword, kw_id) AS query_source FROM hits GROUP BY ord)"""


_KW_VALUES = "kw(kw_id, keyword) AS (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(KEYWORDS)) + ")"


@query(f"WITH {POSTS}, {_KW_VALUES}, {_search_sql('kw')} SELECT ord, query_source FROM first_hit")
def keyword_search(spark, sf):
    found = keywords.keyword_candidates(samples.posts(spark, sf), _keyword_table(spark), RULES)
    return found.select("ord", "query_source")


# Every word of the benchmark texts is a keyword, its ids repeat, and posts have repeated and NULL keys.
@query(f"""WITH {POSTS}, kw AS (SELECT item_id AS kw_id, unnest(string_split(text, ' ')) AS keyword FROM benchmark),
  one AS (SELECT lower(keyword) AS needle, min(struct_pack(kw_id := kw_id, keyword := keyword)) AS k
    FROM kw WHERE keyword <> '' GROUP BY 1),
  searched AS (SELECT *, CASE WHEN ord % 3 > 0 THEN ord // 4 END AS key FROM posts WHERE lang = 'en' AND likes >= 16
    AND created_ts >= TIMESTAMP '{START}' AND created_ts < TIMESTAMP '{END}'),
  best AS (SELECT tweet_id, key, min(k) AS k FROM searched JOIN one ON contains(lower(text), needle) GROUP BY ALL)
  SELECT tweet_id, key AS ord, k.keyword AS query_source FROM best""")
def keyword_search_many(spark, sf):
    return _search_benchmark(spark, sf)


# The same with anchors that are shuffled, as those of very many keywords are.
@query(SQL["keyword_search_many"])
def keyword_search_joined(spark, sf):
    return _search_benchmark(spark, sf, "merge")


def _search_benchmark(spark, sf, strategy: str | None = None) -> DataFrame:
    words = samples.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("kw_id"), F.explode(F.split("text", " ")).alias("keyword"))
    posts = samples.posts(spark, sf).withColumn("ord", F.when(F.col("ord") % 3 > 0, F.floor(F.col("ord") / 4)))
    found = keywords.keyword_candidates(posts, words, RULES, strategy=strategy)
    return found.select("tweet_id", "ord", "query_source")


@query(f"WITH {PREDICTIONS} SELECT ord, round(p, 6) AS p FROM predictions WHERE p >= 0.5")
def score_threshold(spark, sf):
    return _rounded(filters.filter_scored(samples.predictions(spark, sf), 0.5, "p").select("ord", "p"))


@query(f"WITH {POSTS} SELECT ord FROM posts ORDER BY ord LIMIT 600")
def take_to_target(spark, sf):
    return filters.take_until(samples.posts(spark, sf), target=1000, existing=400).select("ord")


# --- duplicates, unions, joins --------------------------------------------

@query(f"""WITH {ARRIVALS} SELECT tweet_id, ord, arrival, likes FROM arrivals
  QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY arrival, ord) = 1""")
def keep_first_arrival(spark, sf):
    return (dedupe.keep_first(samples.arrivals(spark, sf), ["tweet_id"], ["arrival", "ord"])
            .select("tweet_id", "ord", "arrival", "likes"))


@query(f"""WITH {POSTS} SELECT ord, {_strip('text')} AS text, likes FROM posts
  QUALIFY row_number() OVER (PARTITION BY {_strip('text')} ORDER BY ord) = 1""")
def dedupe_text(spark, sf):
    return dedupe.dedupe_text(samples.posts(spark, sf)).select("ord", "text", "likes")


@query(f"WITH {POSTS} SELECT min(ord) AS ord, {_strip('text')} AS text FROM posts GROUP BY {_strip('text')}")
def clean_text(spark, sf):
    return dedupe.clean(samples.posts(spark, sf))


@query(f"WITH {POSTS} SELECT ord, likes FROM posts WHERE tweet_id NOT IN (SELECT tweet_id FROM posts WHERE ord % 2 = 0)")
def exclude_seen(spark, sf):
    posts = samples.posts(spark, sf)
    return dedupe.exclude_seen(posts, posts.filter("ord % 2 = 0")).select("ord", "likes")


@query(f"""WITH {ARRIVALS} SELECT ord, likes, arrival FROM arrivals
  UNION ALL SELECT ord, likes, NULL FROM posts""")
def stack_rows(spark, sf):
    more = samples.posts(spark, sf).select("ord", "likes")
    return dedupe.stack(samples.arrivals(spark, sf).select("ord", "likes", "arrival"), more)


@query(f"""WITH {ARRIVALS} SELECT tweet_id, likes FROM posts WHERE ord % 2 = 0
  UNION ALL SELECT tweet_id, likes FROM (SELECT * FROM arrivals WHERE ord % 2 <> 0
    QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY arrival, ord) = 1)""")
def merge_existing(spark, sf):
    existing = samples.posts(spark, sf).filter("ord % 2 = 0")
    return dedupe.merge_keep_existing(existing, samples.arrivals(spark, sf), ["arrival", "ord"]).select("tweet_id", "likes")


@query(f"""WITH {ARRIVALS}, firsts AS (SELECT * FROM arrivals WHERE ord % 4 <> 0
    QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY arrival, ord) = 1)
  SELECT tweet_id, {_strip('text')} AS text, likes + replies + reposts AS engagement_total
  FROM firsts WHERE {_PASSES}""")
def collect_new(spark, sf):
    existing = samples.posts(spark, sf).filter("ord % 4 = 0")
    found = curate.collect(samples.arrivals(spark, sf), existing, ["arrival", "ord"], RULES)
    return found.select("tweet_id", "text", "engagement_total")


# Ids of every seventh post are missing, which counts as one id; the second run adds nothing.
@query(f"""WITH {ARRIVALS}, named AS (SELECT * REPLACE (CASE WHEN ord % 7 > 0 THEN tweet_id END AS tweet_id) FROM arrivals),
  firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY arrival, ord) = 1),
  kept AS (SELECT *, row_number() OVER (ORDER BY arrival, ord) - 1 AS position FROM firsts WHERE {_PASSES})
  SELECT tweet_id, likes, position AS ord, {_SECOND} AS created_ts FROM kept""")
def collect_twice(spark, sf):
    place = work_dir(spark, "collected")
    for _ in range(2):
        kept = curate.collect_into(place, _unnamed(spark, sf), ["arrival", "ord"], RULES)
    return _shown(kept.select("tweet_id", "likes", "ord", "created_ts"), "created_ts")


def _unnamed(spark, sf) -> DataFrame:
    return samples.arrivals(spark, sf).withColumn("tweet_id", F.when(F.col("ord") % 7 > 0, F.col("tweet_id")))


# From arrivals to the two batches without a key made by hand; collecting stops at a target.
@query(f"""WITH {ARRIVALS}, first AS (SELECT * FROM posts WHERE ord % 2 = 0 AND {_PASSES}),
  second AS (SELECT * FROM posts WHERE ord % 2 = 1 AND {_PASSES}),
  placed AS (SELECT text, row_number() OVER (ORDER BY ord) - 1 AS position FROM first
    UNION ALL SELECT text, (SELECT count(*) FROM first) + row_number() OVER (ORDER BY ord) - 1 FROM second),
  cleaned AS (SELECT {_strip('text')} AS text, min(position) AS ord FROM placed WHERE position < 300 GROUP BY 1)
  SELECT ord, text, CASE WHEN row_number() OVER (ORDER BY ord) <= 20 THEN 1 ELSE 2 END AS batch FROM cleaned""")
def collected_split(spark, sf):
    place, cleaned = work_dir(spark, "collected"), work_dir(spark, "cleaned")
    for part in (0, 1):
        new = samples.posts(spark, sf).filter(F.col("ord") % 2 == part)
        kept = curate.collect_into(place, new, "ord", RULES, target=300)
    head, rest = curate.clean_and_split(kept, cleaned, 20)
    return head.withColumn("batch", F.lit(1)).unionByName(rest.withColumn("batch", F.lit(2)))


@query(f"""WITH {POSTS}, {ANNOTATED} SELECT p.ord, p.likes, a.ragebait, a.content_type
  FROM posts p LEFT JOIN (SELECT * FROM annotated WHERE content_type <> 'other') a ON a.ord = p.ord""")
def attach_results(spark, sf):
    results = samples.annotated(spark, sf).filter("content_type <> 'other'").select("ord", "ragebait", "content_type")
    return dedupe.attach(samples.posts(spark, sf).select("ord", "likes"), results)


@query(f"""WITH {ANNOTATED} SELECT ord,
  CASE WHEN ragebait IS NULL THEN 25e-2 ELSE ragebait END AS ragebait,
  CASE WHEN ragebait IS NULL THEN 'claim' ELSE content_type END AS content_type
  FROM annotated""")
def patch_failed(spark, sf):
    base = samples.annotated(spark, sf).select("ord", "ragebait", "content_type")
    redo = base.select("ord", F.lit(0.25).alias("ragebait"), F.lit("claim").alias("content_type"))
    return dedupe.patch_results(base, redo, ["ragebait", "content_type"])


# --- splits, samples, chunks ----------------------------------------------

# Keys repeat sevenfold and every ninth is NULL; which of the tied posts go first is not compared.
@query(f"""WITH {POSTS}, k AS (SELECT CASE WHEN ord % 9 > 0 THEN ord // 7 END AS key FROM posts),
  r AS (SELECT key, CASE WHEN row_number() OVER (ORDER BY key NULLS LAST) <= 150 THEN 1 ELSE 2 END AS batch FROM k)
  SELECT key, batch, count(*) AS posts FROM r GROUP BY key, batch""")
def split_batches(spark, sf):
    keyed = samples.posts(spark, sf).withColumn("key", F.when(F.col("ord") % 9 > 0, F.floor(F.col("ord") / 7)))
    head, rest = splits.split_at(keyed, 150, "key")
    return (head.withColumn("batch", F.lit(1)).unionByName(rest.withColumn("batch", F.lit(2)))
            .groupBy("key", "batch").agg(F.count("*").alias("posts")))


def _seeded_rank(key: str = "ord") -> str:
    return f"row_number() OVER (ORDER BY md5('42:' || {key}), {key})"


@query(f"""WITH {TRAINING}, r AS (SELECT ord, {_seeded_rank()} AS nth, count(*) OVER () AS n FROM training)
  SELECT ord, CASE WHEN nth <= ceil(n * 5e-2) THEN 'test' ELSE 'train' END AS part FROM r""")
def holdout_split(spark, sf):
    rest, test = splits.holdout(samples.training(spark, sf))
    return (rest.select("ord", F.lit("train").alias("part"))
            .unionByName(test.select("ord", F.lit("test").alias("part"))))


@query(f"WITH {POSTS} SELECT ord, ntile(3) OVER (ORDER BY md5('42:' || ord), ord) - 1 AS fold FROM posts")
def kfold_assign(spark, sf):
    return splits.kfold(samples.posts(spark, sf)).select("ord", F.col("fold").cast("long").alias("fold"))


# A third of the rows share a key, others have none, and many are equal in all columns.
_TIED = f"""{POSTS}, tied AS (SELECT CASE WHEN ord % 3 = 0 THEN 1 WHEN ord % 7 > 0 THEN floor(ord / 4) END AS key,
    ord % 2 AS half FROM posts),
  r AS (SELECT key, row_number() OVER (ORDER BY md5(concat_ws(':', '42', CAST(CAST(key AS BIGINT) AS VARCHAR)))) AS nth,
    count(*) OVER () AS n FROM tied)"""


def _tied(spark: SparkSession, sf: str) -> DataFrame:
    """Stored, as cuts among many ties scan their rows once per step of the search."""
    key = F.when(F.col("ord") % 3 == 0, F.lit(1)).when(F.col("ord") % 7 > 0, F.floor(F.col("ord") / 4))
    rows = samples.posts(spark, sf).select(key.cast("long").alias("key"), (F.col("ord") % 2).alias("half"))
    return tables.stored(rows, "tied")


@query(f"""WITH {_TIED}, f AS (SELECT key, CASE WHEN nth <= (n // 3 + 1) * (n % 3) THEN (nth - 1) // (n // 3 + 1)
    ELSE n % 3 + (nth - 1 - (n // 3 + 1) * (n % 3)) // (n // 3) END AS fold FROM r)
  SELECT CAST(key AS BIGINT) AS key, CAST(fold AS BIGINT) AS fold, count(*) AS n_rows FROM f GROUP BY key, fold""")
def kfold_ties(spark, sf):
    return (splits.kfold(_tied(spark, sf), key="key").groupBy("key", F.col("fold").cast("long").alias("fold"))
            .agg(F.count("*").alias("n_rows")))


@query(f"""WITH {_TIED}, p AS (SELECT key, CASE WHEN nth <= ceil(n * 5e-2) THEN 'test' ELSE 'train' END AS part FROM r
    UNION ALL SELECT key, 'drawn' FROM r WHERE nth <= 120)
  SELECT CAST(key AS BIGINT) AS key, part, count(*) AS n_rows FROM p GROUP BY key, part""")
def sample_ties(spark, sf):
    rows = _tied(spark, sf)
    train, test = splits.holdout(rows, key="key")
    parts = {"train": train, "test": test, "drawn": splits.sample_n(rows, 120, key="key")}
    named = [df.select("key", F.lit(name).alias("part")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, named).groupBy("key", "part").agg(F.count("*").alias("n_rows"))


@query(f"WITH {POSTS} SELECT ord, text FROM posts ORDER BY md5('42:' || ord), ord LIMIT 298")
def pilot_sample(spark, sf):
    return splits.sample_n(samples.posts(spark, sf), 298).select("ord", "text")


@query(f"""WITH {POSTS} SELECT ord, CAST(floor((row_number() OVER (ORDER BY ord) - 1) / {CHUNK}) AS BIGINT) AS chunk_id
  FROM posts""")
def chunk_assign(spark, sf):
    return splits.assign_chunks(samples.posts(spark, sf), CHUNK).select("ord", "chunk_id")


@query(f"WITH {POSTS} SELECT ord, {_seeded_rank()} - 1 AS position FROM posts")
def shuffled_position(spark, sf):
    return ranks.with_ordinal(samples.posts(spark, sf).select("ord"), ranks.seeded(splits.SEED, "ord"), "position")


@query(f"WITH {POSTS} SELECT ord FROM posts")
def shuffled_rows(spark, sf):
    return splits.seeded_shuffle(samples.posts(spark, sf)).select("ord")


@query(f"""WITH {TRAINING}, f AS (SELECT ord, ntile(3) OVER (ORDER BY md5('42:' || ord), ord) - 1 AS fold FROM training)
  SELECT ord, CAST(i AS INTEGER) AS round, CASE WHEN fold = i THEN 'val' ELSE 'train' END AS role FROM f, range(3) r(i)""")
def fold_rounds(spark, sf):
    return splits.fold_pairs(splits.kfold(samples.training(spark, sf))).select("ord", "round", "role")


# --- scalar functions ------------------------------------------------------

@query(f"""WITH padded AS (SELECT doc_id AS ord,
    list_extract([{', '.join(f'chr({ord(c)})' for c in text.WHITESPACE)}, chr(8203), chr(65279)], CAST(doc_id % 31 AS INTEGER) + 1) AS pad, text
  FROM documents)
  SELECT ord, {_strip("pad || ' ' || text || chr(10) || pad")} AS text,
         length({_strip("pad || ' ' || text || chr(10) || pad")}) AS n_chars FROM padded""")
def strip_text(spark, sf):
    pads = F.lit([*text.WHITESPACE, "​", "﻿"])
    pad = F.get(pads, (F.col("doc_id") % 31).cast("int"))
    padded = F.concat(pad, F.lit(" "), F.col("text"), F.lit("\n"), pad)
    return (samples.table(spark, sf, "documents")
            .select(F.col("doc_id").alias("ord"), text.strip(padded).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))


@query(f"""WITH {POSTS} SELECT ord, CASE ord % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL
    WHEN 2 THEN strftime(created_ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') ELSE {_SECOND} END AS parsed
  FROM posts""")
def parse_created(spark, sf):
    at, turn = F.col("created_at"), F.col("ord") % 6
    written = (F.when(turn == 1, F.regexp_replace(at, r" 0(\d) ", " $1 "))
               .when(turn == 2, F.replace(at, F.lit("+0000"), F.lit("+0530")))
               .when(turn == 3, F.concat(F.lit("Xxx"), F.substring(at, 4, 100)))
               .when(turn == 4, "garbage").when(turn == 5, None).otherwise(at))
    parsed = samples.posts(spark, sf).select("ord", clock.parse_created_at(written).alias("parsed"))
    return _shown(parsed, "parsed")


@query("""SELECT doc_id AS ord, CASE doc_id % 10 WHEN 0 THEN n_chars / 1e1 WHEN 1 THEN n_chars / 1e1
    WHEN 2 THEN n_chars * 1e0 WHEN 3 THEN CAST('inf' AS DOUBLE)
    WHEN 8 THEN n_chars / 1e2 END AS number FROM documents""")
def coerce_number(spark, sf):
    n, turn = F.col("n_chars"), F.col("doc_id") % 10
    tenth = (n / F.lit(10.0)).cast("string")
    written = (F.when(turn == 0, tenth).when(turn == 1, F.concat(F.lit(" "), tenth, F.lit(" ")))
               .when(turn == 2, F.concat(n.cast("string"), F.lit("e0"))).when(turn == 3, "inf")
               .when(turn == 4, "nan").when(turn == 5, F.concat(n.cast("string"), F.lit("d")))
               .when(turn == 6, F.concat(F.lit("0x"), n.cast("string"))).when(turn == 7, "")
               .when(turn == 8, F.concat(n.cast("string"), F.lit("E-2"))).when(turn == 9, F.col("text")))
    return samples.table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"), text.to_number(written).alias("number"))


# A window holds the posts from its start on and before its end; posts outside all windows have none.
@query(f"""WITH {EVENT_POSTS}, w AS (SELECT i, TIMESTAMP '2024-01-01 06:00:00' + i * INTERVAL 2 DAY AS s,
    least(TIMESTAMP '2024-01-01 06:00:00' + (i + 1) * INTERVAL 2 DAY, TIMESTAMP '2024-01-06') AS e FROM range(3) r(i))
  SELECT ord, i AS window_index, strftime(s, '%Y-%m-%d %H:%M') AS window_start, strftime(e, '%Y-%m-%d %H:%M') AS window_end
  FROM posts LEFT JOIN w ON created_ts >= s AND created_ts < e""")
def search_windows(spark, sf):
    start, end = clock.utc("2024-01-01 06:00:00"), clock.utc("2024-01-06")
    first, last = clock.window_bounds(F.col("window_index"), start, end, 2)
    return (samples.event_posts(spark, sf)
            .select("ord", clock.window_index(F.col("created_ts"), start, 2, end).alias("window_index"))
            .withColumns({"window_start": F.date_format(first, "yyyy-MM-dd HH:mm"),
                          "window_end": F.date_format(last, "yyyy-MM-dd HH:mm")}))


_HEAD = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]


@query(f"""WITH z AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]),
    [{', '.join(f'CAST({w} AS DOUBLE)' for w in _HEAD)}]) + 25e-2 AS logit FROM embeddings)
  SELECT vec_id, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS probability FROM z""")
def linear_score(spark, sf):
    rows = samples.table(spark, sf, "embeddings").select(
        "vec_id", numeric.linear_head(F.col("embedding"), _HEAD, 0.25).alias("logit"))
    return _rounded(rows.withColumn("probability", numeric.sigmoid(F.col("logit"))))


@query("""WITH parts AS (SELECT CAST(floor(vec_id / 6) AS BIGINT) AS doc, unnest(range(64)) AS i,
    unnest(CAST(embedding AS DOUBLE[])) AS v, CASE WHEN vec_id % 4 = 0 OR vec_id % 60 < 6 THEN 0 ELSE 1 END AS mask
  FROM embeddings)
  SELECT doc, CAST(i AS INTEGER) AS i, round(sum(v * mask) / greatest(sum(mask), 1e-9), 6) AS pooled FROM parts GROUP BY doc, i""")
def mean_pooling(spark, sf):
    mask = F.when((F.col("vec_id") % 4 == 0) | (F.col("vec_id") % 60 < 6), 0).otherwise(1)
    rows = samples.table(spark, sf, "embeddings").withColumns({"mask": mask, "doc": F.floor(F.col("vec_id") / 6)})
    pooled = pooling.mean_pooled(rows, ["doc"], "embedding", "mask", 64)
    return _rounded(pooled.select("doc", F.posexplode("pooled").alias("i", "pooled")))


@query(f"""WITH {POSTS} SELECT ord, likes + replies + reposts AS engagement,
    round(CASE WHEN reposts > 0 THEN likes / reposts ELSE 0 END, 6) AS per_repost,
    round(likes / 1e9 * 42, 12) AS cost, sqrt(likes) AS root,
    CASE WHEN ord % 7 = 0 OR ord % 7 = 1 THEN 0e0 ELSE likes * 1e0 END AS statistic FROM posts""")
def numeric_functions(spark, sf):
    odd = (F.when(F.col("ord") % 7 == 0, float("nan")).when(F.col("ord") % 7 == 1, None)
           .otherwise(F.col("likes").cast("double")))
    return samples.posts(spark, sf).select(
        "ord", filters.total_engagement().alias("engagement"),
        F.round(numeric.ratio(F.col("likes"), F.col("reposts")), 6).alias("per_repost"),
        F.round(numeric.token_cost(F.col("likes")), 12).alias("cost"),
        F.sqrt("likes").alias("root"), numeric.nan_to_zero(odd).alias("statistic"))


# --- aggregates, statistics, reports ----------------------------------------

@query(f"WITH {POSTS} SELECT count(*) AS n_rows FROM posts")
def row_count(spark, sf):
    return reports.row_count(samples.posts(spark, sf))


@query(f"WITH {ANNOTATED} SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM annotated")
def token_totals(spark, sf):
    return reports.token_totals(samples.annotated(spark, sf))


@query(f"WITH {ANNOTATED} SELECT count(*) - count(ragebait) AS n_missing FROM annotated")
def missing_annotations(spark, sf):
    return reports.missing_count(samples.annotated(spark, sf))


@query(f"""WITH {CHUNKED} SELECT chunk_id, count(*) AS n_posts, count(*) - count(ragebait) AS n_failed,
  round((count(*) - count(ragebait)) / count(*), 6) AS failure_rate FROM chunked GROUP BY chunk_id""")
def chunk_report(spark, sf):
    return _rounded(reports.chunk_report(_chunked(spark, sf)))


@query(f"""WITH {POSTS}, c AS (SELECT created_ts, CAST(floor((row_number() OVER (ORDER BY ord) - 1) / {CHUNK}) AS BIGINT) AS chunk_id FROM posts),
  t AS (SELECT chunk_id, count(*) AS n_posts, (epoch_us(max(created_ts)) + 250000 - epoch_us(min(created_ts))) / 1e6 AS elapsed FROM c GROUP BY chunk_id)
  SELECT chunk_id, n_posts, round(elapsed, 3) AS elapsed, round(n_posts / elapsed, 4) AS posts_per_sec FROM t""")
def chunk_throughput(spark, sf):
    timed = (splits.assign_chunks(samples.posts(spark, sf), CHUNK)
             .withColumn("started_at", F.col("created_ts"))
             .withColumn("finished_at", F.col("created_ts") + F.expr("INTERVAL 0.25 SECOND")))
    return reports.chunk_throughput(timed).select(
        "chunk_id", "n_posts", F.round("elapsed", 3).alias("elapsed"),
        F.round("posts_per_sec", 4).alias("posts_per_sec"))


@query(f"""WITH {ANNOTATED} SELECT count(*) AS n_rows, count(*) - count(ragebait) AS n_missing,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  round(sum(input_tokens) / 1e9 * 42, 9) AS cost FROM annotated""")
def cost_report(spark, sf):
    return _rounded(reports.cost_report(samples.annotated(spark, sf)), 9)


@query(f"""WITH {EVENT_POSTS} SELECT query_source, date_diff('day', DATE '2024-01-01', CAST(created_ts AS DATE)) AS "window", count(*) AS posts
  FROM posts WHERE {_PASSES} GROUP BY ALL""")
def window_yield(spark, sf):
    return reports.yield_report(filters.candidates(samples.event_posts(spark, sf), RULES), "2024-01-01", 1)


@query(f"""WITH {POSTS}, {_KW_VALUES}, {_search_sql('kw')}
  SELECT query_source, count(*) AS posts FROM first_hit GROUP BY query_source""")
def keyword_yield(spark, sf):
    found = keywords.keyword_candidates(samples.posts(spark, sf), _keyword_table(spark), RULES)
    return reports.yield_report(found, START)


_SPEARMAN = """ra AS (SELECT {g} score, p,
    rank() OVER ({pg} ORDER BY score) + (count(*) OVER (PARTITION BY {g} score) - 1) / 2e0 AS ra,
    rank() OVER ({pg} ORDER BY p) + (count(*) OVER (PARTITION BY {g} p) - 1) / 2e0 AS rb FROM {t})"""
_METRICS_SQL = """round(avg(abs(p - score)), 6) AS mae, round(avg((p - score) * (p - score)), 6) AS mse,
  round(sqrt(avg((p - score) * (p - score))), 6) AS rmse, round(coalesce(corr(ra, rb), 0), 6) AS spearman"""


@query(f"WITH {PREDICTIONS}, {_SPEARMAN.format(g='', pg='', t='predictions')} SELECT {_METRICS_SQL} FROM ra")
def error_metrics(spark, sf):
    return _rounded(stats.evaluate(samples.predictions(spark, sf), "score", "p"))


@query(f"""WITH v AS (SELECT l_returnflag AS g, l_quantity AS score, l_extendedprice AS p FROM lineitem),
  {_SPEARMAN.format(g='g,', pg='PARTITION BY g', t='v')}
  SELECT g, round(coalesce(corr(ra, rb), 0), 6) AS spearman FROM ra GROUP BY g""")
def rank_correlation(spark, sf):
    rows = samples.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "g")
    return _rounded(stats.spearman(rows, "l_quantity", "l_extendedprice", ["g"]))


_TRIALS = f"""{TRAINING}, folded AS (SELECT score, ntile(3) OVER (ORDER BY md5('42:' || ord), ord) - 1 AS fold FROM training),
  tried AS (SELECT CAST(i AS INTEGER) AS trial, fold, score, least(1e0, score * (9e-1 + i * 3e-2) + 2e-2) AS p FROM folded, range(4) r(i)),
  {_SPEARMAN.format(g='trial, fold,', pg='PARTITION BY trial, fold', t='tried')},
  by_fold AS (SELECT trial, fold, avg(abs(p - score)) AS mae, avg((p - score) * (p - score)) AS mse,
    sqrt(avg((p - score) * (p - score))) AS rmse, coalesce(corr(ra, rb), 0) AS spearman FROM ra GROUP BY trial, fold)"""


def _trial_metrics(spark, sf):
    """Four fixed rules scored on each fold, in place of fitted models."""
    tried = (splits.kfold(samples.training(spark, sf)).withColumn("trial", F.explode(F.lit([0, 1, 2, 3])))
             .withColumn("p", F.least(F.lit(1.0), F.col("score") * (0.9 + F.col("trial") * 0.03) + 0.02)))
    return stats.evaluate(tried, "score", "p", ["trial", "fold"])


@query(f"""WITH {_TRIALS} SELECT trial, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std' for m in stats.METRICS)}
  FROM by_fold GROUP BY trial""")
def cv_summary(spark, sf):
    return _rounded(stats.cv_summary(_trial_metrics(spark, sf)))


@query(f"""WITH {_TRIALS}, m AS (SELECT trial, avg(mae) AS mean_mae FROM by_fold GROUP BY trial)
  SELECT trial, round(mean_mae, 6) AS mean_mae FROM m ORDER BY mean_mae, trial LIMIT 1""")
def best_config(spark, sf):
    return _rounded(stats.best_trial(_trial_metrics(spark, sf)))


_PROFILE = [("ord", "bigint"), ("text", "string"), ("input_tokens", "bigint"), ("output_tokens", "bigint"),
            *[(q, "string" if q in CHOICES else "double") for q in QUESTIONS]]


@query("WITH " + ANNOTATED + " " + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", count({c}) AS non_null, '{t}' AS type FROM annotated"""
    for i, (c, t) in enumerate(_PROFILE)))
def profile(spark, sf):
    return stats.profile(samples.annotated(spark, sf))


@query("WITH " + ANNOTATED + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM annotated" for a in NUMERIC for b in NUMERIC))
def correlation_matrix(spark, sf):
    return _rounded(stats.corr_matrix(samples.annotated(spark, sf), NUMERIC))


_BINNED = ["likes", "replies", "reposts"]
_BIN_SQL = ", ".join(
    f"least(CAST(floor(8e0 * ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) + 1) AS INTEGER), 8) AS {c}" for c in _BINNED)


@query(f"WITH {POSTS}, b AS (SELECT {_BIN_SQL} FROM posts) " + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {a} AS bin_x, {b} AS bin_y, count(*) AS n FROM b GROUP BY {a}, {b}"
    if a != b else f"SELECT '{a}' AS x, '{a}' AS y, {a} AS bin_x, {a} AS bin_y, count(*) AS n FROM b GROUP BY {a}"
    for i, a in enumerate(_BINNED) for b in _BINNED[i:]))
def pair_counts(spark, sf):
    return stats.pair_bins(samples.posts(spark, sf), _BINNED, 8)


_MOMENTS = """m AS (SELECT count(*) AS n, avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my,
    var_pop({a}) AS vaa, var_pop({b}) AS vbb, covar_pop({a}, {b}) AS vab,
    covar_pop({a}, {y}) AS vay, covar_pop({b}, {y}) AS vby, var_pop({y}) AS vyy FROM lineitem),
  s AS (SELECT *, vaa * vbb - vab * vab AS det FROM m)"""
_LINE = _MOMENTS.format(a="l_quantity", b="l_discount", y="l_extendedprice")


@query(f"""WITH {_LINE}
  SELECT 'const' AS variable, round(1 + (ma * ma * vbb - 2 * ma * mb * vab + mb * mb * vaa) / det, 6) AS vif FROM s
  UNION ALL SELECT 'l_quantity', round(vaa * vbb / det, 6) FROM s
  UNION ALL SELECT 'l_discount', round(vaa * vbb / det, 6) FROM s""")
def vif_two_columns(spark, sf):
    return _rounded(stats.vif(samples.table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]))


def _swept_sql(columns: list[str], table: str) -> str:
    """The covariances of ``columns`` in complete rows, swept by one column a step: (i, j, v) in ``swept``.

    A column that the ones before explain is passed over. It keeps a variance of
    0; beside it stand the slopes of what explains it.
    """
    p = len(columns)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    structs = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': covar_pop({a}, {b})}}"
                        for i, a in enumerate(columns) for j, b in enumerate(columns))
    steps = [f"complete AS MATERIALIZED (SELECT * FROM {table} WHERE {complete})",
             f"m0 AS MATERIALIZED (SELECT unnest(l, recursive := true) FROM (SELECT [{structs}] AS l FROM complete))"]
    for k in range(p):
        steps.append(f"""m{k + 1} AS MATERIALIZED (SELECT a.i, a.j, CASE
    WHEN d.v <= 1e-9 THEN a.v WHEN a.i = {k} AND a.j = {k} THEN 1 / d.v WHEN a.i = {k} THEN a.v / d.v WHEN a.j = {k} THEN -a.v / d.v
    ELSE a.v - c.v * r.v / d.v END AS v FROM m{k} a JOIN m{k} r ON r.i = {k} AND r.j = a.j
    JOIN m{k} c ON c.j = {k} AND c.i = a.i JOIN m{k} d ON d.i = {k} AND d.j = {k})""")
    return ", ".join(steps) + f", swept AS (SELECT * FROM m{p})"


_MEANS = ", ".join(f"({i}, '{c}', (SELECT avg({c}) FROM complete), (SELECT var_pop({c}) FROM complete))"
                   for i, c in enumerate(NUMERIC))


# The variance of a column times its cell of the inverse; infinite for a column that others explain or that
# takes part in explaining another.
@query(f"""WITH {ANNOTATED}, {_swept_sql(NUMERIC, 'annotated')}, c(i, variable, mean, var) AS (VALUES {_MEANS}),
  passed AS (SELECT i FROM swept WHERE i = j AND v <= 1e-9),
  bound AS (SELECT DISTINCT i FROM swept WHERE j IN (SELECT i FROM passed) AND abs(v) > 1e-9 UNION SELECT i FROM passed)
  SELECT 'const' AS variable, round(1 + sum(a.mean * v * b.mean), 6) AS vif FROM swept s
    JOIN c a ON a.i = s.i JOIN c b ON b.i = s.j
    WHERE s.i NOT IN (SELECT i FROM passed) AND s.j NOT IN (SELECT i FROM passed)
  UNION ALL SELECT variable, CASE WHEN c.i IN (SELECT i FROM bound) THEN CAST('inf' AS DOUBLE) ELSE round(var * v, 6) END
  FROM c JOIN swept s ON s.i = c.i AND s.j = c.i""")
def vif_answers(spark, sf):
    return _rounded(stats.vif(samples.annotated(spark, sf), NUMERIC))


_OLS = f"""WITH {_LINE}, b AS (SELECT *, (vay * vbb - vby * vab) / det AS ba, (vby * vaa - vay * vab) / det AS bb FROM s),
  f AS (SELECT *, my - ba * ma - bb * mb AS b0, vyy - ba * vay - bb * vby AS mse0 FROM b),
  g AS (SELECT *, mse0 * n / (n - 3) AS sigma2 FROM f),
  c AS (
  SELECT 'const' AS variable, b0 AS coef, sqrt(sigma2 / n * (1 + (ma * ma * vbb - 2 * ma * mb * vab + mb * mb * vaa) / det)) AS std_err FROM g
  UNION ALL SELECT 'l_quantity', ba, sqrt(sigma2 / n * vbb / det) FROM g
  UNION ALL SELECT 'l_discount', bb, sqrt(sigma2 / n * vaa / det) FROM g)"""


@query(f"{_OLS} SELECT variable, round(coef, 3) AS coef, round(std_err, 3) AS std_err, round(coef / std_err, 3) AS t FROM c")
def ols_coefficients(spark, sf):
    coefficients, _ = stats.ols(samples.table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return _rounded(coefficients.select("variable", "coef", "std_err", "t"), 3)


@query(f"""WITH {POSTS}, s AS (SELECT regr_slope(replies, likes) AS b, regr_intercept(replies, likes) AS a,
    regr_r2(replies, likes) AS r2, count(*) AS n FROM posts),
  e AS (SELECT ord, replies - a - b * likes AS e FROM posts, s),
  d AS (SELECT e, e - lag(e) OVER (ORDER BY ord) AS step FROM e),
  q AS (SELECT sum(e * e) AS rss, sum(step * step) AS steps, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4, count(*) AS n FROM d),
  o AS (SELECT r2, q.*, -n / 2e0 * (ln(2 * pi() * rss / n) + 1) AS ll, m3 / pow(m2, 15e-1) AS skew, m4 / (m2 * m2) AS kurtosis FROM q, (SELECT r2 FROM s))
  SELECT measure, round(value, 4) AS value FROM (
    SELECT 'n_obs' AS measure, n * 1e0 AS value FROM o UNION ALL SELECT 'r_squared', r2 FROM o
    UNION ALL SELECT 'adj_r_squared', 1 - (1 - r2) * (n - 1) / (n - 2) FROM o
    UNION ALL SELECT 'f_statistic', r2 / (1 - r2) * (n - 2) FROM o
    UNION ALL SELECT 'log_likelihood', ll FROM o UNION ALL SELECT 'aic', 4 - 2 * ll FROM o
    UNION ALL SELECT 'bic', 2 * ln(n) - 2 * ll FROM o UNION ALL SELECT 'rss', rss FROM o
    UNION ALL SELECT 'skew', skew FROM o UNION ALL SELECT 'kurtosis', kurtosis FROM o
    UNION ALL SELECT 'jarque_bera', n / 6e0 * (skew * skew + (kurtosis - 3) * (kurtosis - 3) / 4) FROM o
    UNION ALL SELECT 'durbin_watson', steps / rss FROM o)""")
def ols_summary(spark, sf):
    _, summary = stats.ols(samples.posts(spark, sf), "replies", ["likes"], order="ord")
    kept = ["n_obs", "r_squared", "adj_r_squared", "f_statistic", "log_likelihood", "aic", "bic", "rss",
            "skew", "kurtosis", "jarque_bera", "durbin_watson"]
    return _rounded(summary.filter(F.col("measure").isin(kept)), 4)


_PREDICTORS = ["const", "input_tokens", *[c for c in NUMERIC if c != "ragebait"],
               *[f"{q}_{c}" for q in CHOICES for c in sorted(QUESTIONS[q]["criteria"])[1:]]]


# The normal equations: the residuals are orthogonal to every predictor that is in the fit.
@query("SELECT variable, true AS orthogonal FROM (VALUES " + ", ".join(f"('{v}')" for v in _PREDICTORS) + ") v(variable)")
def ols_answers(spark, sf):
    encoded = encoding.dummies(samples.annotated(spark, sf).drop("text", "output_tokens"), CHOICES)
    predictors = [c for c in encoded.columns if c not in ("ord", "ragebait")]
    coefficients = {r["variable"]: r["coef"] for r in stats.ols(encoded, "ragebait", predictors, order="ord")[0].collect()}
    rows = encoding.add_const(stats.complete_cases(encoded, ["ragebait", *predictors]))
    error = F.col("ragebait") - sum((F.col(v) * F.lit(c) for v, c in coefficients.items()), F.lit(0.0))
    # A sum of products is zero beside the sum of what it adds up.
    sums = [F.struct(F.lit(v).alias("variable"), (F.abs(F.sum(F.col(v) * F.col("_e"))) <= 1e-8 * (
        F.sum(F.abs(F.col(v) * F.col("_e"))) + 1e-6)).alias("orthogonal")) for v in coefficients]
    return rows.withColumn("_e", error).agg(F.array(*sums).alias("sums")).select(F.inline("sums"))


@query(f"WITH {ANNOTATED} SELECT ord, ragebait, nicheness FROM annotated WHERE ragebait IS NOT NULL AND nicheness IS NOT NULL")
def complete_rows(spark, sf):
    return stats.complete_cases(samples.annotated(spark, sf).select("ord", "ragebait", "nicheness"), ["ragebait", "nicheness"])


@query("""WITH r AS (SELECT d.doc_id AS item, l.toxic AS h1, l.quality AS h2, length(d.text) % 2 AS m
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
  pairs AS (SELECT 'h1' AS rater_a, 'h2' AS rater_b, h1 AS la, h2 AS lb FROM r
    UNION ALL SELECT 'h1', 'm', h1, m FROM r UNION ALL SELECT 'h2', 'm', h2, m FROM r),
  s AS (SELECT rater_a, rater_b, count(*) AS n_items, avg(CASE WHEN la = lb THEN 1e0 ELSE 0e0 END) AS agreement,
    avg(la) * avg(lb) + (1 - avg(la)) * (1 - avg(lb)) AS expected FROM pairs GROUP BY rater_a, rater_b)
  SELECT rater_a, rater_b, n_items, round(agreement, 6) AS agreement, round((agreement - expected) / (1 - expected), 6) AS kappa FROM s""")
def rater_agreement(spark, sf):
    return _rounded(stats.agreement(samples.ratings(spark, sf), ["h1", "h2", "m"]))


# --- encoding and rubric ----------------------------------------------------

def _dummy_sql(column: str) -> str:
    return ", ".join(f"CASE WHEN {column} = '{c}' THEN 1 ELSE 0 END AS {column}_{c}"
                     for c in sorted(QUESTIONS[column]["criteria"])[1:])


@query(f"WITH {ANNOTATED} SELECT ord, {', '.join(_dummy_sql(c) for c in CHOICES)} FROM annotated")
def dummy_columns(spark, sf):
    return encoding.dummies(samples.annotated(spark, sf).select("ord", *CHOICES), CHOICES)


@query(f"WITH {ANNOTATED} SELECT 1e0 AS const, ord, ragebait FROM annotated")
def const_column(spark, sf):
    return encoding.add_const(samples.annotated(spark, sf).select("ord", "ragebait"))


# Answers with some of them out of their domain.
_SPOILED = f"""{ANNOTATED}, spoiled AS (SELECT * REPLACE (
  CASE WHEN ord % 11 = 0 THEN ragebait + 1 ELSE ragebait END AS ragebait,
  CASE WHEN ord % 13 = 0 THEN nicheness - 3 ELSE nicheness END AS nicheness,
  CASE WHEN ord % 17 = 0 AND content_type IS NOT NULL THEN 'rant' ELSE content_type END AS content_type) FROM annotated)"""


def _check_sql(question: str) -> str:
    keys = ", ".join(f"'{k}'" for k in QUESTIONS[question]["criteria"]) if question in CHOICES else ""
    unknown = f"count(*) FILTER (WHERE {question} NOT IN ({keys}))" if keys else "0"
    bounds = "0" if keys else f"count(*) FILTER (WHERE {question} NOT BETWEEN 0 AND {1 if question in NOUL else 4})"
    return (f"SELECT '{question}' AS question, count(*) AS answers, count(*) - count({question}) AS missing, "
            f"{unknown} AS unknown_choice, {bounds} AS out_of_bounds FROM spoiled")


@query(f"WITH {_SPOILED} " + " UNION ALL ".join(_check_sql(q) for q in QUESTIONS))
def validate_answers(spark, sf):
    o = F.col("ord")
    spoiled = samples.annotated(spark, sf).withColumns({
        "ragebait": F.when(o % 11 == 0, F.col("ragebait") + 1).otherwise(F.col("ragebait")),
        "nicheness": F.when(o % 13 == 0, F.col("nicheness") - 3).otherwise(F.col("nicheness")),
        "content_type": F.when((o % 17 == 0) & F.col("content_type").isNotNull(), "rant").otherwise(F.col("content_type"))})
    return rubric.validate_answers(spoiled, rubric.rubric_options(rubric.rubric(spark)))


@query(f"WITH {ANNOTATED} SELECT * EXCLUDE (text) FROM annotated")
def flatten_answers(spark, sf):
    nested = samples.annotated(spark, sf)
    return rubric.flatten_answers(nested.select("ord", rubric.reply_json(nested).alias("reply")))


@query(f"""WITH {ANNOTATED}, {_options_sql()}, given AS ({" UNION ALL ".join(
    f"SELECT '{q}' AS question, " + (q if q in CHOICES else f"CASE WHEN {q} >= 0.5 THEN 'true' ELSE 'false' END" if q in NOUL
    else f"CAST(CAST(round({q}) AS BIGINT) AS VARCHAR)") + f" AS option_key FROM annotated WHERE {q} IS NOT NULL" for q in QUESTIONS)})
  SELECT o.question, o.option_key, count(g.question) AS answers FROM options o
  LEFT JOIN given g ON g.question = o.question AND g.option_key = o.option_key GROUP BY o.question, o.option_key""")
def answer_distribution(spark, sf):
    return rubric.answer_distribution(samples.annotated(spark, sf), rubric.rubric_options(rubric.rubric(spark)))


# --- annotation, training, scoring -------------------------------------------

_SCORED_TEXT = ANNOTATED.replace("doc_id % 37 <> 0 AS ok", "true AS ok")


@query(f"WITH {_SCORED_TEXT} SELECT * EXCLUDE (text) FROM annotated")
def annotate_posts(spark, sf):
    rows = filters.select_text(samples.posts(spark, sf))
    return annotate.annotate(rows, annotate.offline_scorer, timed=False).drop("text")


@query(f"""WITH {_SCORED_TEXT} SELECT ord, ragebait, rhetorical_target,
  CAST(floor((row_number() OVER (ORDER BY ord) - 1) / {CHUNK}) AS BIGINT) AS chunk_id FROM annotated""")
def annotate_resumed(spark, sf):
    chunked = tables.stored(splits.assign_chunks(filters.select_text(samples.posts(spark, sf)), CHUNK), "chunked")
    out = work_dir(spark, "annotated")
    annotate.annotate_chunks(chunked.filter("chunk_id % 2 = 0"), out, annotate.offline_scorer)
    done = annotate.annotate_chunks(chunked, out, annotate.offline_scorer)
    return done.select("ord", "ragebait", "rhetorical_target", "chunk_id")


# The whole job, stopped after some chunks and run again: its report.
@query(f"""WITH {_SCORED_TEXT} SELECT count(*) AS n_rows, count(*) - count(ragebait) AS n_missing,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  round(sum(input_tokens) / 1e9 * 42, 9) AS cost, CAST(ceil(count(*) / {CHUNK}) AS BIGINT) AS chunks FROM annotated""")
def annotation_run(spark, sf):
    place = work_dir(spark, "annotation")
    rows = filters.select_text(samples.posts(spark, sf))
    annotation.run(rows, place, annotate.offline_scorer, CHUNK, only=F.col("chunk_id") < 2)
    return _rounded(annotation.run(rows, place, annotate.offline_scorer, CHUNK)["report"], 9)


@query(f"""WITH {CHUNKED} SELECT ord, chunk_id FROM chunked WHERE chunk_id NOT IN (SELECT chunk_id FROM chunked WHERE ord % 400 = 0)""")
def pending_chunks(spark, sf):
    chunked = _chunked(spark, sf)
    return annotate.pending(chunked, chunked.filter("ord % 400 = 0")).select("ord", "chunk_id")


@query(f"""WITH {TRAINING} SELECT min(ord) AS ord, {_strip('text')} AS text, round(arg_min(score, ord), 6) AS score
  FROM training GROUP BY {_strip('text')}""")
def prepare_training(spark, sf):
    return _rounded(training.prepare_training(samples.training(spark, sf)))


def _prepared(spark, sf):
    return tables.stored(training.prepare_training(samples.training(spark, sf)), "training")


_UNIQUE_TRAINING = f"""{TRAINING}, prepared AS (SELECT min(ord) AS ord, arg_min(score, ord) AS score
  FROM training GROUP BY {_strip('text')})"""


# Every post has a score inside [0, 1], and a model that was saved gives it again.
@query(f"WITH {POSTS} SELECT ord, true AS in_range, true AS same_after_reload FROM posts")
def fit_and_score(spark, sf):
    fitted = model.fit_regressor(_prepared(spark, sf))
    place = work_dir(spark, "model")
    history.save_model(fitted, place)
    first = model.score_posts(filters.select_text(samples.posts(spark, sf)), fitted)
    again = model.score_posts(first.withColumnRenamed(model.PREDICTION, "first"), history.load_model(place))
    return again.select("ord", F.col(model.PREDICTION).between(0, 1).alias("in_range"),
                        (F.abs(F.col(model.PREDICTION) - F.col("first")) < 1e-12).alias("same_after_reload"))


# Rows and metrics of every fold. A model without features is among those that a fit may return, so on
# the rows it learned from no fitted model has a greater loss than the best constant, the SQL's figure.
@query(f"""WITH {_UNIQUE_TRAINING}, f AS (SELECT score, ntile(3) OVER (ORDER BY md5('42:' || ord), ord) - 1 AS fold FROM prepared),
  m AS (SELECT i AS fold, avg(score) AS s FROM f, range(3) r(i) WHERE fold <> i GROUP BY i)
  SELECT fold, count(*) AS n_rows, true AS metrics_hold, true AS loss_bounded,
    any_value(round(-(s * ln(s) + (1 - s) * ln(1 - s)), 6)) AS constant_loss FROM f JOIN m USING (fold) GROUP BY fold""")
def cross_validation(spark, sf):
    folded = tables.stored(splits.kfold(_prepared(spark, sf)), "folded")
    found = model.cross_validate(folded)
    learned = tables.stored(model.training_scores(folded), "learned")
    p, s = F.col(model.PREDICTION), F.col("score")
    loss = F.avg(-(s * F.log(p) + (1 - s) * F.log(1 - p)))
    mean = F.avg("score")
    constant = -(mean * F.log(mean) + (1 - mean) * F.log(1 - mean))
    fits = learned.groupBy("fold").agg(constant.alias("constant"), (loss <= constant + 1e-9).alias("loss_bounded"))
    holds = F.col("mae").between(0, 1) & (F.abs(F.col("rmse") * F.col("rmse") - F.col("mse")) < 1e-9) & (
        F.col("mae") <= F.col("rmse") + 1e-9) & F.col("spearman").between(-1.000001, 1.000001)
    return (found.join(fits, "fold").join(folded.groupBy("fold").agg(F.count("*").alias("n_rows")), "fold")
            .select(F.col("fold").cast("long").alias("fold"), "n_rows", holds.alias("metrics_hold"), "loss_bounded",
                    F.round("constant", 6).alias("constant_loss")))


# Every trial of the default space meets every fold with the parameters that the seed draws.
@query("""SELECT CAST(t AS INTEGER) AS trial, CAST(f AS INTEGER) AS fold, true AS as_drawn, true AS in_range
  FROM range(12) a(t), range(3) b(f)""")
def param_search(spark, sf):
    drawn = model.sample_params(model.SEARCH_SPACE, model.N_TRIALS, splits.SEED)
    expected = spark.createDataFrame([(t, {k: float(v) for k, v in p.items()}) for t, p in enumerate(drawn)],
                                     "trial int, expected map<string,double>")
    found = model.search(splits.kfold(_prepared(spark, sf)))
    entries = [F.array_sort(F.map_entries(c)) for c in ("params", "expected")]
    return found.join(expected, "trial").select(
        "trial", "fold", (entries[0] == entries[1]).alias("as_drawn"), F.col("mae").between(0, 1).alias("in_range"))


# The counts of the run, and that the mean of the hold-out part is no better guess than its model.
@query(f"""WITH {_UNIQUE_TRAINING}, n AS (SELECT count(*) AS n, CAST(ceil(count(*) * 5e-2) AS BIGINT) AS t FROM prepared)
  SELECT n - t AS n_train_val, t AS n_test, least(500, n - t) AS n_hpo_rows, CAST(42 AS BIGINT) AS seed,
         (SELECT count(*) FROM documents) AS scored, true AS in_range FROM n""")
def train_model(spark, sf):
    place, scored = work_dir(spark, "trained"), work_dir(spark, "inferred")
    train.train(samples.training(spark, sf), place, hpo_subsample_size=500)
    kept = train.infer(samples.posts(spark, sf), f"{place}/model", scored, min_score=0.0)
    counts = kept.agg(F.count("*").alias("scored"), F.bool_and(F.col(model.PREDICTION).between(0, 1)).alias("in_range"))
    runs = history.load_metadata(spark, f"{place}/runs").select("n_train_val", "n_test", "n_hpo_rows", "seed")
    return runs.join(F.broadcast(counts))


@query("SELECT doc_id AS ord, length(text) / (1e2 + length(text)) AS inferred_ragebait FROM documents")
def score_plugin(spark, sf):
    def load():
        return lambda texts: [len(t) / (100.0 + len(t)) for t in texts]
    return model.score_with(samples.posts(spark, sf).select("ord", "text"), load).drop("text")


@query(f"WITH {PREDICTIONS} SELECT ord, round(p, 6) AS inferred_ragebait FROM predictions ORDER BY p DESC, ord LIMIT 20")
def top_posts(spark, sf):
    rows = samples.predictions(spark, sf).select("ord", F.col("p").alias(model.PREDICTION))
    return _rounded(model.top_scored(rows, 20))


# --- streams -------------------------------------------------------------------

_LANDED = "tweet_id string, text string, created_at string, likes long, replies long, reposts long, " \
          "query_source string, ord long, arrival int"


# Rows of a landing file at most, as far as ids differ, and files of a micro-batch.
LANDED_ROWS = 20_000
LANDED_PER_TRIGGER = 400
# Events that land at a time, and parts in which a table lands at most, as each part reads the documents anew.
PART_EVENTS = 400_000
MAX_PARTS = 8


def _landing_files(spark: SparkSession, sf: str, share: float = 1.0) -> int:
    """Files for a share of the events: three, or more as they grow, so that a task never writes or reads more."""
    return max(3, math.ceil(samples.table(spark, sf, "events").count() * share / LANDED_ROWS))


def _per_trigger(files: int) -> int:
    """Files of a micro-batch: two of three, and never so many that a batch grows with the table."""
    return min(math.ceil(files * 2 / 3), LANDED_PER_TRIGGER)


def _land(df: DataFrame, place: str, files: int) -> None:
    """Add arrivals to a landing folder, several files at a time; rows of an id share a file."""
    df.select("tweet_id", "text", "created_at", "likes", "replies", "reposts", "query_source", "ord", "arrival") \
      .repartition(files, "ord").write.mode("append").parquet(place)


def _part_count(events: DataFrame) -> int:
    return max(1, min(MAX_PARTS, math.ceil(events.count() / PART_EVENTS)))


def _parts_by_id(events: DataFrame) -> list[Column]:
    """Tests of which each event post meets one, all rows of an id the same."""
    parts = _part_count(events)
    return [F.pmod(F.xxhash64("ord"), F.lit(parts)) == part for part in range(parts)]


def _parts_by_time(events: DataFrame) -> list[Column]:
    """Tests of which each event post meets one, copies the same; no post of a later part is older.

    Posts of one second, and those without a time, are divided by a hash of their id.
    """
    def place(ts: str, key: str) -> Column:
        return F.coalesce(F.unix_seconds(ts), F.lit(0)) * 1024 + F.pmod(F.xxhash64(key), F.lit(1024))

    parts = _part_count(events)
    if parts == 1:
        return [F.lit(True)]
    shares = [part / parts for part in range(1, parts)]
    cuts = sorted(set(events.agg(F.percentile_approx(place("ts", "event_id"), shares)).first()[0]))
    at = place("created_ts", "ord")
    return ([at <= cuts[0]] + [(at > low) & (at <= high) for low, high in zip(cuts, cuts[1:])] + [at > cuts[-1]])


def _stream_in_parts(posts: DataFrame, sf: str, parts: list[Column], share: float, landing: str,
                     job: Callable[[DataFrame], StreamingQuery], whole: bool = False) -> None:
    """Land the posts part by part; a job takes each part and goes on from its checkpoint with the next.

    Of several parts each leaves the landing folder before the next arrives, and so do the shuffles it took: the disk
    holds one part, however many there are. A part is one micro-batch if it is one of several and has no more than
    ``LANDED_PER_TRIGGER`` files, or if the job needs it ``whole``.
    """
    spark = posts.sparkSession
    files = _landing_files(spark, sf, share / len(parts))
    per_trigger = files if whole else _per_trigger(files) if len(parts) == 1 else min(files, LANDED_PER_TRIGGER)
    for part in parts:
        _land(posts.filter(part), landing, files)
        release_shuffles(spark)
        stream = streams.landing_stream(spark, landing, _schema(_LANDED), files_per_trigger=per_trigger)
        job(stream).awaitTermination()
        if len(parts) > 1:
            tables.remove(spark, landing)
        release_shuffles(spark)


def _schema(ddl: str):
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl)


@query(f"""WITH {EVENT_ARRIVALS}, one AS (SELECT * FROM posts WHERE {_PASSES}),
  two AS (SELECT * FROM arrivals WHERE arrival = 2 AND {_PASSES} AND tweet_id NOT IN (SELECT tweet_id FROM one))
  SELECT tweet_id, text, likes FROM one UNION ALL SELECT tweet_id, text, likes FROM two""")
def stream_ingest_restarted(spark, sf):
    landing, out, state = (work_dir(spark, n) for n in ("landing", "accepted", "state"))
    first, events = _first_arrivals(spark, sf), samples.table(spark, sf, "events")
    for posts, arrived, share in ((first, events, 1.0), (_later_copies(first), events.filter("event_id % 10 = 0"), 0.1)):
        _stream_in_parts(posts, sf, _parts_by_id(arrived), share, landing,
                         lambda stream: streams.ingest_exact(stream, out, state, ["arrival", "ord"], RULES))
    return spark.read.schema(schemas.CANDIDATES).parquet(out).select("tweet_id", "text", "likes")


# All events, every tenth twice; the later copy has more likes, and it is the first that stays.
@query(f"WITH {EVENT_POSTS} SELECT tweet_id, likes, 1 AS arrival FROM posts")
def stream_dedupe(spark, sf):
    out, state = work_dir(spark, "unique"), work_dir(spark, "state")

    def job(stream: DataFrame) -> StreamingQuery:
        timed = stream.select("tweet_id", "likes", "arrival", clock.parse_created_at(F.col("created_at")).alias("created_ts"))
        unique = streams.dedupe_stream(timed, "60 days", order=["arrival"]).select("tweet_id", "likes", "arrival")
        return streams.to_parquet(unique, out, state)

    _stream_events(spark, sf, job)
    return spark.read.schema("tweet_id string, likes long, arrival int").parquet(out)


# Where the first copy fails, the later one must not take its place.
@query(f"WITH {EVENT_POSTS} SELECT tweet_id, likes + replies + reposts AS engagement_total FROM posts WHERE {_PASSES}")
def stream_candidates(spark, sf):
    out, state = work_dir(spark, "kept"), work_dir(spark, "state")

    def job(stream: DataFrame) -> StreamingQuery:
        kept = streams.candidate_stream(stream, "60 days", RULES, order=["arrival"])
        return streams.to_parquet(kept.select("tweet_id", "engagement_total"), out, state)

    _stream_events(spark, sf, job)
    return spark.read.schema("tweet_id string, engagement_total long").parquet(out)


def _first_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return samples.event_posts(spark, sf).withColumn("arrival", F.lit(1))


def _later_copies(first: DataFrame) -> DataFrame:
    """Copies of every tenth post with more likes."""
    return first.filter("ord % 10 = 0").withColumn("arrival", F.lit(2)).withColumn("likes", F.col("likes") + 100)


def _event_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """All events, and later copies of every tenth with more likes; events and documents are joined once."""
    copies = F.when(F.col("ord") % 10 == 0, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1)))
    return (samples.event_posts(spark, sf).withColumn("arrival", F.explode(copies))
            .withColumn("likes", F.when(F.col("arrival") == 2, F.col("likes") + 100).otherwise(F.col("likes"))))


def _stream_events(spark: SparkSession, sf: str, job: Callable[[DataFrame], StreamingQuery]) -> None:
    """All event arrivals in order of time, copies in the same files."""
    parts = _parts_by_time(samples.table(spark, sf, "events"))
    _stream_in_parts(_event_arrivals(spark, sf), sf, parts, 1.1, work_dir(spark, "landing"), job)


@query(f"""WITH {EVENT_POSTS}, w AS (SELECT *, date_trunc('day', created_ts) AS day FROM posts)
  SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(day + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
    query_source, count(*) AS posts, CAST(sum(likes + replies + reposts) AS BIGINT) AS engagement FROM w
  WHERE day + INTERVAL 1 DAY <= (SELECT date_trunc('second', max(created_ts)) - INTERVAL 1 HOUR FROM posts)
  GROUP BY day, query_source""")
def stream_windows(spark, sf):
    landing, out, state = (work_dir(spark, n) for n in ("landing", "windows", "state"))

    def totals(stream: DataFrame) -> DataFrame:
        timed = stream.withColumn("created_ts", clock.parse_created_at(F.col("created_at")))
        return streams.window_totals(timed, "2024-01-01", "1 hour", days=1)

    # A part is one micro-batch: the watermark of a first would drop the rows of a second.
    parts = _parts_by_time(samples.table(spark, sf, "events"))
    _stream_in_parts(_first_arrivals(spark, sf), sf, parts, 1.0, landing,
                     lambda stream: streams.to_parquet(totals(stream), out, state), whole=True)
    schema = totals(spark.createDataFrame([], _schema(_LANDED))).schema
    return _shown(spark.read.schema(schema).parquet(out), "window_start", "window_end")


# Scores of a stream are those of one batch with the same model.
@query(f"WITH {EVENT_ARRIVALS} SELECT ord, count(*) AS posts, true AS as_in_batch FROM arrivals GROUP BY ord")
def stream_scores(spark, sf):
    fitted = model.fit_regressor(_prepared(spark, sf))
    out, state = work_dir(spark, "scores"), work_dir(spark, "state")
    # Only the scores are read again, so the texts are not written a second time.
    _stream_events(spark, sf, lambda stream: streams.to_parquet(
        streams.score_stream(stream.select("ord", "text"), fitted).select("ord", model.PREDICTION), out, state))
    streamed = spark.read.schema(f"ord long, {model.PREDICTION} double").parquet(out)
    batch = model.score_posts(samples.event_posts(spark, sf).select("ord", "text"), fitted)
    same = F.bool_and(F.abs(F.col(model.PREDICTION) - F.col("expected")) < 1e-12)
    return (streamed.join(batch.select("ord", F.col(model.PREDICTION).alias("expected")), "ord", "left")
            .groupBy("ord").agg(F.count("*").alias("posts"), same.alias("as_in_batch")))
