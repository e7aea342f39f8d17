"""Every registered query agrees with its SQL at the smallest scale."""

import pytest

import compare
from compare import contract
from posthaste.operators import model
from posthaste.plans import train
from posthaste.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return compare.database(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    assert compare.mismatch(spark, con, sf, name) is None


def test_entry(spark):
    rows = {r["reason"]: r["posts"] for r in contract.entry(spark).collect()}
    assert sum(rows.values()) == 200
    assert set(rows) <= {"kept", "length", "date", "engagement"}


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name, module, job, cut", [("train_model", train, "train", "n_trials"),
                                                    ("stream_scores", model, "fit_regressor", "max_iter")])
def test_models_are_fitted_with_the_defaults(spark, sf, monkeypatch, name, module, job, cut):
    class Called(Exception):
        pass

    def seen(*args, **named):
        raise Called(args[1:], named)

    monkeypatch.setattr(module, job, seen)
    with pytest.raises(Called) as call:
        QUERIES[name](spark, sf)
    assert cut not in str(call.value)
