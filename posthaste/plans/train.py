"""From scored texts to a saved model."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame

from posthaste import schemas
from posthaste.operators import filters, model, splits, stats, training
from posthaste.sources import history, tables

MODEL_NAME = "hashed-words-logit"


def train(df: DataFrame, output_dir: str, space: Mapping = model.SEARCH_SPACE,
          n_trials: int = model.N_TRIALS, n_folds: int = splits.FOLDS,
          test_size: float = splits.TEST_SHARE, seed: int = splits.SEED,
          hpo_subsample_size: int | None = None, parallelism: int = 4) -> dict:
    """Check, split, search, cross-validate, refit and test once; then save.

    The hold-out part is read only by the final test. The search may run on a
    subsample; everything after it uses all training rows.
    """
    spark = df.sparkSession
    # Stored once: the splits and fits below scan it many times.
    prepared = tables.stored(training.prepare_training(df), "training")

    train_val, test = splits.holdout(prepared, test_size, seed)
    searched = train_val
    if hpo_subsample_size is not None:
        searched = splits.sample_n(train_val, hpo_subsample_size, seed)
    trials = model.search(splits.kfold(searched, n_folds, seed), space, n_trials, n_folds, seed, parallelism)
    best = model.best_params(trials)

    folds = model.cross_validate(splits.kfold(train_val, n_folds, seed), best, n_folds, parallelism)
    summary = stats.cv_summary(folds, groups=()).first().asDict()
    final = model.fit_regressor(train_val, best)
    predicted = tables.stored(model.score_posts(test, final), "test")
    tested = stats.evaluate(predicted, "score", model.PREDICTION).first().asDict()

    history.save_model(final, f"{output_dir}/model")
    run = {"run_id": uuid.uuid4().hex, "model_name": MODEL_NAME, "best_params": best,
           "cv_summary": summary, "test_metrics": tested,
           "n_train_val": train_val.count(), "n_test": test.count(),
           "hpo_subsample_size": hpo_subsample_size, "n_hpo_rows": searched.count(), "seed": seed}
    history.save_metadata(spark, f"{output_dir}/runs", run)
    return {"model_dir": f"{output_dir}/model", "best_params": best,
            "cv_metrics": summary, "test_metrics": tested}


def infer(posts: DataFrame, model_dir: str, out_dir: str, min_score: float | None = None) -> DataFrame:
    """Score posts with a saved model, store them and return the stored table.

    With ``min_score`` only posts from that score on are kept.
    """
    scored = model.score_posts(posts.select("ord", "text"), history.load_model(model_dir))
    if min_score is not None:
        scored = filters.filter_scored(scored, min_score)
    tables.write_table(scored, out_dir)
    return tables.read_posts(posts.sparkSession, out_dir, schemas.SCORED)
