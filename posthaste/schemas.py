"""Declared schemas; nothing is inferred from data."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
TIMESTAMP = T.TimestampType()

# One post as it arrives from a search.
POSTS_RAW = _struct(tweet_id=STRING, text=STRING, created_at=STRING,
                    likes=LONG, replies=LONG, reposts=LONG)

CANDIDATES = _struct(tweet_id=STRING, text=STRING, created_at=STRING,
                     likes=LONG, replies=LONG, reposts=LONG,
                     engagement_total=LONG, query_source=STRING,
                     # The instant of created_at, and the place in the order of collection.
                     created_ts=TIMESTAMP, ord=LONG, collected_at=TIMESTAMP)

CLEANED = _struct(ord=LONG, text=STRING)

TRAINING = _struct(ord=LONG, text=STRING, score=DOUBLE)

SCORED = _struct(ord=LONG, text=STRING, inferred_ragebait=DOUBLE)

# The columns an annotation adds to a row, in the order of the rubric.
ANSWERS = _struct(input_tokens=LONG, output_tokens=LONG,
                  ragebait=DOUBLE, controversial=DOUBLE,
                  time_sensitivity=DOUBLE, nicheness=DOUBLE,
                  emotional_intensity=DOUBLE, content_type=STRING,
                  context_dependence=DOUBLE, rhetorical_target=STRING,
                  generalization=DOUBLE, sarcasm_irony=DOUBLE)

ANNOTATED = T.StructType([
    *CLEANED.fields, T.StructField("chunk_id", LONG, True), *ANSWERS.fields,
    T.StructField("started_at", TIMESTAMP, True),
    T.StructField("finished_at", TIMESTAMP, True),
])

# The nested reply of a scorer, as JSON text.
REPLY = T.StructType([
    T.StructField("usage", _struct(input_tokens=LONG, output_tokens=LONG)),
    T.StructField("answers", T.MapType(STRING, _struct(noul=DOUBLE, score=DOUBLE, choice=STRING))),
])

_METRICS = _struct(mae=DOUBLE, mse=DOUBLE, rmse=DOUBLE, spearman=DOUBLE)

RUN_HISTORY = T.StructType([
    T.StructField("run_id", STRING),
    T.StructField("model_name", STRING),
    T.StructField("best_params", T.MapType(STRING, DOUBLE)),
    T.StructField("cv_summary", _struct(**{f"{m}_{s}": DOUBLE for s in ("mean", "std")
                                           for m in ("mae", "mse", "rmse", "spearman")})),
    T.StructField("test_metrics", _METRICS),
    T.StructField("n_train_val", LONG),
    T.StructField("n_test", LONG),
    T.StructField("hpo_subsample_size", LONG),
    T.StructField("n_hpo_rows", LONG),
    T.StructField("seed", LONG),
    T.StructField("saved_at", TIMESTAMP),
])
