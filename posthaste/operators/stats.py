"""Profiles, correlations, regression and agreement."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posthaste.functions import numeric, tails
from posthaste.operators import encoding, ranks
from posthaste.sources.tables import stored


def _number(column: str) -> Column:
    """A double with NaN turned into NULL, so aggregates skip it."""
    value = F.col(column).cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a number in every column, as doubles; other columns are kept."""
    return df.withColumns({c: _number(c) for c in columns}).dropna(subset=list(columns))


# --- error metrics -------------------------------------------------------

def regression_metrics(df: DataFrame, actual: str, predicted: str,
                       groups: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE and RMSE, for all rows or per group."""
    error = F.col(predicted).cast("double") - F.col(actual).cast("double")
    return (df.groupBy(*groups)
            .agg(F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"))
            .withColumn("rmse", F.sqrt("mse")))


def average_ranks(df: DataFrame, column: str, bounds: Sequence[float],
                  groups: Sequence[str] = ()) -> DataFrame:
    """Every distinct value with its 1-based rank in the group, ties averaged,
    and that rank less the mean rank.

    Works on value counts, so a value that a third of the rows share is one
    row. The ranges of values between ``bounds`` are ranked apart and shifted
    by the rows before them. A column ``_n`` tells how many rows a row stands for.
    """
    groups = list(groups)
    weight = F.sum("_n") if "_n" in df.columns else F.count("*")
    counts = (df.groupBy(*groups, column).agg(weight.alias("_n"))
              .withColumn("_at", F.col(column).cast("double")))
    ranged = ranks.with_range(counts, "_at", bounds, "_range")
    # At most MAX_RANGES rows per group from here to the join.
    by_range = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy(*groups, "_range").agg(F.sum("_n").alias("_rows"))
              .withColumn("_start", F.coalesce(F.sum("_rows").over(by_range), F.lit(0)))
              .withColumn("_total", F.sum("_rows").over(Window.partitionBy(*groups)))
              .drop("_rows"))
    by_value = (Window.partitionBy(*groups, "_range").orderBy(column)
                .rowsBetween(Window.unboundedPreceding, -1))
    before = F.col("_start") + F.coalesce(F.sum("_n").over(by_value), F.lit(0))
    rank = before + (F.col("_n") + 1) / F.lit(2.0)
    return (ranged.join(starts, [*groups, "_range"])
            .withColumn("rank", rank)
            .withColumn("centred_rank", F.col("rank") - (F.col("_total") + 1) / F.lit(2.0))
            .select(*groups, column, "rank", "centred_rank"))


def spearman(df: DataFrame, a: str, b: str, groups: Sequence[str] = (),
             rows_per_range: int = ranks.ROWS_PER_RANGE) -> DataFrame:
    """Rank correlation with averaged ties; 0.0 where it is undefined.

    One scan counts the pairs of values; both sets of ranks come from these
    counts. Counts and ranks are stored, so that Spark can split the pairs of a
    hot value in the joins.
    """
    groups = list(groups)
    rows = complete_cases(df.select(*groups, a, b), [a, b])
    pairs = stored(rows.groupBy(*groups, a, b).agg(F.count("*").alias("_n")), "pairs")
    n_pairs = pairs.count()
    cuts = ranks.range_bounds(pairs, [F.col(a), F.col(b)], n_pairs, ranks.range_count(pairs, n_pairs, rows_per_range))
    joined = pairs
    for column, name, bounds in ((a, "_ra", cuts[0]), (b, "_rb", cuts[1])):
        found = stored(average_ranks(pairs, column, bounds, groups), "ranks")
        joined = joined.join(found.select(*groups, column, F.col("centred_rank").alias(name)),
                             [*groups, column])
    n, ra, rb = F.col("_n"), F.col("_ra"), F.col("_rb")
    spread = F.sqrt(F.sum(n * ra * ra)) * F.sqrt(F.sum(n * rb * rb))
    rho = F.when(spread > 0, F.sum(n * ra * rb) / spread)
    return joined.groupBy(*groups).agg(numeric.nan_to_zero(rho).alias("spearman"))


def evaluate(df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """All four metrics, one row per group."""
    errors = regression_metrics(df, actual, predicted, groups)
    order = spearman(df, actual, predicted, groups)
    if groups:
        return errors.join(order, list(groups))
    return errors.withColumn("_one", F.lit(1)).join(order.withColumn("_one", F.lit(1)), "_one").drop("_one")


METRICS = ("mae", "mse", "rmse", "spearman")


def cv_summary(df: DataFrame, groups: Sequence[str] = ("trial",)) -> DataFrame:
    """Mean and population standard deviation over folds of each metric."""
    return df.groupBy(*groups).agg(*[
        f(m).alias(f"{m}_{name}") for name, f in (("mean", F.avg), ("std", F.stddev_pop)) for m in METRICS])


def best_trial(df: DataFrame, params: Sequence[str] = ()) -> DataFrame:
    """The trial with the least mean MAE over its folds; the lowest id on a tie."""
    mean = df.groupBy("trial", *params).agg(F.avg("mae").alias("mean_mae"))
    return mean.orderBy("mean_mae", "trial").limit(1)


# --- profiles ------------------------------------------------------------

def _present(field: T.StructField) -> Column:
    number = field.dataType.typeName() in ("double", "float")
    return F.count(_number(field.name) if number else F.col(field.name))


@dataclass
class Overview:
    """What one scan tells of every column: rows that have it, of numbers also the
    mean and the ends, and the values of category columns."""

    present: dict[str, int]
    mean: dict[str, float]
    ends: dict[str, tuple[float | None, float | None]]
    categories: dict[str, list[str]]


def overview(df: DataFrame, labels: Sequence[str] = (), most: int | None = None) -> Overview:
    """One scan, also for the categories: each label column is a grouping set
    beside that of all rows. More than ``most`` categories of all labels fail."""
    labels, numbers = list(labels), numeric_columns(df)
    most = encoding.MAX_CATEGORIES if most is None else most
    ends = [f(_number(c)).alias(f"_{name}{i}") for i, c in enumerate(numbers)
            for name, f in (("mean", F.avg), ("low", F.min), ("high", F.max))]
    # Labels as they are counted stand beside the copies that group.
    copies = df.withColumns({f"_label{i}": F.col(c).cast("string") for i, c in enumerate(labels)})
    keys = [f"_label{i}" for i in range(len(labels))]
    counted = [_present(f).alias(f"_n{i}") for i, f in enumerate(df.schema.fields)] + ends
    if labels:
        grouped = copies.groupingSets([[], *[[k] for k in keys]], *keys).agg(F.grouping_id().alias("_set"), *counted)
    else:
        grouped = copies.agg(F.lit(0).alias("_set"), *counted)
    rows = grouped.limit(most + len(labels) + 2).collect()
    if len(rows) > most + len(labels) + 1:
        raise ValueError(f"more than {most} categories in {labels}")
    # A bit is set for every key that a grouping set leaves out.
    everything = (1 << len(keys)) - 1
    total = next((r for r in rows if r["_set"] == everything), None)
    values: dict[str, list[str]] = {c: [] for c in labels}
    for r in rows:
        for i, c in enumerate(labels):
            if r["_set"] == everything - (1 << (len(keys) - 1 - i)) and r[keys[i]] is not None:
                values[c].append(r[keys[i]])

    def at(name: str, empty=None):
        return empty if total is None or total[name] is None else total[name]

    return Overview({f.name: at(f"_n{i}", 0) for i, f in enumerate(df.schema.fields)},
                    {c: at(f"_mean{i}", 0.0) for i, c in enumerate(numbers)},
                    {c: (at(f"_low{i}"), at(f"_high{i}")) for i, c in enumerate(numbers)},
                    {c: sorted(v) for c, v in values.items()})


def profile(df: DataFrame, seen: Overview | None = None) -> DataFrame:
    """Column, non-missing count and type, one row per column."""
    fields = df.schema.fields
    if seen is not None:
        return df.sparkSession.createDataFrame(
            [(i, f.name, seen.present[f.name], f.dataType.simpleString()) for i, f in enumerate(fields)],
            "position int, column string, non_null long, type string")
    counted = df.agg(*[_present(f).alias(f"_{i}") for i, f in enumerate(fields)])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.col(f"_{i}").alias("non_null"), F.lit(f.dataType.simpleString()).alias("type"))
        for i, f in enumerate(fields)])))


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [name for name, kind in df.dtypes if kind in kinds]


@dataclass
class PairSums:
    """Sums over the rows that have both of two columns, less a centre:
    ``n``, ``sx`` and ``sxx`` of the first column and ``sxy`` of their product."""

    columns: list[str]
    centre: np.ndarray
    n: np.ndarray
    sx: np.ndarray
    sxx: np.ndarray
    sxy: np.ndarray

    def moments(self) -> Moments:
        """Of complete rows: every cell has the same rows."""
        n = int(round(self.n[0, 0]))
        off = self.sx[:, 0] / max(n, 1)
        return Moments(n, self.centre + off, self.sxy - n * np.outer(off, off))


@dataclass(frozen=True)
class Among:
    """Columns whose sums are wanted, from complete rows or for each pair from the rows that have both."""

    columns: Sequence[str]
    complete: bool = True


def pair_sums(df: DataFrame, sets: Mapping[str, Among], centre: Mapping[str, float] | None = None) -> dict[str, PairSums]:
    """Sums of any number of column sets in one scan, or two if no centre near the means is given.

    Each task multiplies its Arrow batches and sends one small matrix a set; the
    driver gets their sums, never rows. One aggregate per pair in the JVM would
    make a method too long to be compiled from some eight columns on.
    """
    columns = list(dict.fromkeys(c for s in sets.values() for c in s.columns))
    rows = df.select(*[_number(c).alias(f"_{i}") for i, c in enumerate(columns)])
    if centre is None:
        means = rows.agg(*[F.avg(c) for c in rows.columns]).first()
        centre = {c: 0.0 if v is None else v for c, v in zip(columns, means)}
    middle = np.array([float(centre.get(c, 0.0)) for c in columns])
    wanted = [(name, [columns.index(c) for c in s.columns], s.complete) for name, s in sets.items()]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {name: np.zeros((4, len(at), len(at))) for name, at, _ in wanted}
        for batch in batches:
            every = batch.to_numpy(dtype=float) - middle
            for name, at, complete in wanted:
                x = every[:, at]
                present = ~np.isnan(x)
                if complete:
                    present &= present.all(axis=1, keepdims=True)
                x = np.where(present, x, 0.0)
                mask = present.astype(float)
                totals[name] += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
        for name, total in totals.items():
            i, j = np.indices(total.shape[1:])
            yield pd.DataFrame({"set": name, "i": i.ravel(), "j": j.ravel(),
                                **{k: t.ravel() for k, t in zip(("n", "sx", "sxx", "sxy"), total)}})

    kinds = "set string, i int, j int, n double, sx double, sxx double, sxy double"
    cells = rows.mapInPandas(products, kinds).groupBy("set", "i", "j").agg(
        *[F.sum(k).alias(k) for k in ("n", "sx", "sxx", "sxy")]).collect()
    sums = {name: np.zeros((4, len(at), len(at))) for name, at, _ in wanted}
    for c in cells:
        sums[c["set"]][:, c["i"], c["j"]] = c["n"], c["sx"], c["sxx"], c["sxy"]
    return {name: PairSums(list(sets[name].columns), middle[at], *sums[name]) for name, at, _ in wanted}


def corr_matrix(df: DataFrame, columns: Sequence[str], sums: PairSums | None = None) -> DataFrame:
    """Pearson r of every pair of columns, from the rows where both are present.

    r is NULL when one of the two does not vary.
    """
    columns = list(columns)
    s = sums or pair_sums(df, {"": Among(columns, complete=False)})[""]

    def r(i: int, j: int) -> float | None:
        n = s.n[i, j]
        if n < 2:
            return None
        spread = [max(0.0, s.sxx[a, b] - s.sx[a, b] ** 2 / n) for a, b in ((i, j), (j, i))]
        # Rounding leaves a trace of spread in a constant column.
        if any(v <= n * (1e-12 * s.centre[a]) ** 2 for v, a in zip(spread, (i, j))):
            return None
        found = (s.sxy[i, j] - s.sx[i, j] * s.sx[j, i] / n) / math.sqrt(spread[0] * spread[1])
        return float(min(1.0, max(-1.0, found)))

    p = len(columns)
    return df.sparkSession.createDataFrame(
        [(columns[i], columns[j], r(i, j)) for i in range(p) for j in range(p)], "a string, b string, r double")


def pair_bins(df: DataFrame, columns: Sequence[str], bins: int = 20, seen: Overview | None = None) -> DataFrame:
    """Counts for a scatter matrix: one histogram per column, a grid per pair.

    A column's bins have equal widths from its least to its greatest value.
    """
    rows = df.select(*[_number(c).alias(f"_{i}") for i, c in enumerate(columns)])
    ends = ([end for c in columns for end in seen.ends[c]] if seen is not None else
            rows.agg(*[f(f"_{i}") for i in range(len(columns)) for f in (F.min, F.max)]).first())

    def bin_of(i: int) -> Column:
        low, high = ends[2 * i], ends[2 * i + 1]
        if low is None or low == high:
            return F.when(F.col(f"_{i}").isNotNull(), 1)
        return F.least(F.width_bucket(F.col(f"_{i}"), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))

    binned = rows.select(*[bin_of(i).cast("int").alias(f"b{i}") for i in range(len(columns))])
    pairs = F.array(*[
        F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"),
                 F.col(f"b{i}").alias("bin_x"), F.col(f"b{j}").alias("bin_y"))
        for i, j in itertools.combinations_with_replacement(range(len(columns)), 2)])
    return (binned.select(F.inline(pairs)).dropna()
            .groupBy("x", "y", "bin_x", "bin_y").agg(F.count("*").alias("n")))


# --- least squares -------------------------------------------------------

@dataclass
class Moments:
    """Row count, means and centred cross products of some columns."""

    n: int
    mean: np.ndarray
    cross: np.ndarray


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Of the rows that have all columns: a scan for the centre, one for the sums."""
    return pair_sums(df, {"": Among(columns)})[""].moments()


def _scaled_inverse(cross: np.ndarray) -> tuple[np.ndarray, int]:
    """Pseudo-inverse and rank, found on unit-variance columns for stability."""
    scale = np.sqrt(np.diag(cross))
    scale[scale == 0] = 1.0
    unit = cross / np.outer(scale, scale)
    inverse = np.linalg.pinv(unit, rcond=1e-12, hermitian=True)
    return inverse / np.outer(scale, scale), int(np.linalg.matrix_rank(unit, tol=1e-12, hermitian=True))


def vif(df: DataFrame, columns: Sequence[str], sums: PairSums | None = None) -> DataFrame:
    """Variance inflation of the constant and of each column; inf if collinear."""
    m = sums.moments() if sums else moments(df, columns)
    inverse, _ = _scaled_inverse(m.cross)
    rows = [("const", float(1 + m.n * m.mean @ inverse @ m.mean))]
    for j, name in enumerate(columns):
        others = [k for k in range(len(columns)) if k != j]
        tss = m.cross[j, j]
        if tss == 0:
            rows.append((name, float("nan")))
            continue
        explained = 0.0
        if others:
            inner, _ = _scaled_inverse(m.cross[np.ix_(others, others)])
            explained = m.cross[j, others] @ inner @ m.cross[others, j] / tss
        unexplained = 1 - explained
        rows.append((name, float(1 / unexplained) if unexplained > 1e-12 else float("inf")))
    return df.sparkSession.createDataFrame(rows, "variable string, vif double")


def ols(df: DataFrame, y: str, xs: Sequence[str], order: str | None = None,
        confidence: float = 0.95, rows_per_range: int = ranks.ROWS_PER_RANGE,
        sums: PairSums | None = None) -> tuple[DataFrame, DataFrame]:
    """Least squares with a constant: (coefficient table, summary table).

    Rows with a missing value are left out. With ``order``, a unique numeric
    column, the summary has the Durbin-Watson statistic along it. ``sums`` are
    those of the complete rows of the ``xs`` and ``y``, in this order.
    """
    xs = list(xs)
    rows = complete_cases(df.select(*dict.fromkeys([y, *xs, *([order] if order else [])])), [y, *xs])
    m = sums.moments() if sums else moments(rows, [*xs, y])
    p = len(xs)
    inverse, rank = _scaled_inverse(m.cross[:p, :p])
    mean_x, mean_y, tss = m.mean[:p], m.mean[p], m.cross[p, p]
    slopes = (inverse @ m.cross[:p, p]).tolist()
    intercept = float(mean_y - mean_x @ slopes)

    fitted = F.lit(intercept)
    for name, slope in zip(xs, slopes):
        fitted = fitted + F.col(name) * F.lit(slope)
    residuals = rows.select((F.col(y) - fitted).alias("_e"), *([order] if order else []))
    if order:
        # Two numbers a row, read several times, in place of the table.
        residuals = stored(residuals, "residuals")
    shape = residuals.agg(F.sum(F.col("_e") * F.col("_e")).alias("rss"),
                          F.skewness("_e").alias("skew"), F.kurtosis("_e").alias("kurt")).first()
    rss = shape["rss"] or 0.0

    df_model, df_resid = rank, m.n - rank - 1
    if df_resid < 1:
        raise ValueError(f"{m.n} complete rows are too few for {rank + 1} coefficients")
    sigma2 = rss / df_resid
    variance = (sigma2 * np.array([1 / m.n + mean_x @ inverse @ mean_x, *np.diag(inverse)])).tolist()
    reach = tails.t_quantile(0.5 + confidence / 2, df_resid)
    table = []
    for name, coef, var in zip(["const", *xs], [intercept, *slopes], variance):
        err = math.sqrt(max(var, 0.0))
        t = coef / err if err > 0 else float("nan")
        table.append((name, coef, err, t, tails.t_two_sided(t, df_resid),
                      coef - reach * err, coef + reach * err))
    coefficients = df.sparkSession.createDataFrame(
        table, "variable string, coef double, std_err double, t double, p_value double, "
               "ci_low double, ci_high double")

    summary = _fit_summary(m, p, rss, tss, df_model, df_resid)
    summary.update(_residual_shape(m.n, shape["skew"], shape["kurt"]))
    if order:
        summary["durbin_watson"] = _durbin_watson(residuals, order, rss, m.n, rows_per_range)
    measures = df.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in summary.items()], "measure string, value double")
    return coefficients, measures


def _fit_summary(m: Moments, p: int, rss: float, tss: float, df_model: int, df_resid: int) -> dict:
    n, k = m.n, df_model + 1
    r2 = 1 - rss / tss if tss > 0 else float("nan")
    f = ((tss - rss) / df_model) / (rss / df_resid) if df_model and rss > 0 else float("nan")
    loglik = -n / 2 * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else float("inf")
    # Singular values of the design matrix with its constant column.
    gram = np.empty((p + 1, p + 1))
    gram[0, 0], gram[0, 1:], gram[1:, 0] = n, n * m.mean[:p], n * m.mean[:p]
    gram[1:, 1:] = m.cross[:p, :p] + n * np.outer(m.mean[:p], m.mean[:p])
    values = np.linalg.eigvalsh(gram)
    condition = math.sqrt(values[-1] / values[0]) if values[0] > 0 else float("inf")
    return {"n_obs": n, "df_model": df_model, "df_resid": df_resid,
            "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - 1) / df_resid,
            "f_statistic": f, "f_p_value": tails.f_upper(f, df_model, df_resid),
            "log_likelihood": loglik, "aic": 2 * k - 2 * loglik,
            "bic": k * math.log(n) - 2 * loglik, "rss": rss, "condition_number": condition}


def _residual_shape(n: int, skew: float | None, excess: float | None) -> dict:
    if skew is None or excess is None:
        return {}
    jarque_bera = n / 6 * (skew ** 2 + excess ** 2 / 4)
    found = {"skew": skew, "kurtosis": excess + 3, "jarque_bera": jarque_bera,
             "jarque_bera_p": tails.chi2_two_df_upper(jarque_bera)}
    if n >= 8:
        omnibus = tails.skew_z(skew, n) ** 2 + tails.kurtosis_z(excess + 3, n) ** 2
        found.update(omnibus=omnibus, omnibus_p=tails.chi2_two_df_upper(omnibus))
    return found


def _durbin_watson(residuals: DataFrame, order: str, rss: float, n: int, rows_per_range: int) -> float:
    """Squared steps between neighbours, within ranges and across their ends."""
    placed = residuals.withColumn("_at", F.col(order).cast("double"))
    [bounds] = ranks.range_bounds(placed, [F.col("_at")], n, ranks.range_count(residuals, n, rows_per_range))
    ranged = ranks.with_range(placed, "_at", bounds, "_range")
    inside = Window.partitionBy("_range").orderBy(order)
    step = F.col("_e") - F.lag("_e").over(inside)
    parts = (ranged.withColumn("_step", step).groupBy("_range")
             .agg(F.sum(F.col("_step") * F.col("_step")).alias("within"),
                  F.min_by("_e", order).alias("first"), F.max_by("_e", order).alias("last"))
             .orderBy("_range").collect())
    total = sum(r["within"] or 0.0 for r in parts)
    total += sum((b["first"] - a["last"]) ** 2 for a, b in zip(parts, parts[1:]))
    return total / rss if rss > 0 else float("nan")


# --- agreement -----------------------------------------------------------

def agreement(df: DataFrame, raters: Sequence[str], item: str = "item",
              rater: str = "rater", label: str = "label", order: str | None = None) -> DataFrame:
    """Per pair of the named raters: items both labelled, share of equal labels
    and Cohen's kappa.

    A rater's label of an item is the first by ``order``; without an order, the
    smallest of several.

    Items become rows with one column per rater, so each item meets each pair
    once; the rest works on label counts.
    """
    wide = df.groupBy(item).pivot(rater, list(raters)).agg(
        F.min(label) if order is None else F.min_by(label, F.when(F.col(label).isNotNull(), F.col(order))))
    pairs = F.array(*[F.struct(F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"),
                               F.col(f"`{a}`").alias("la"), F.col(f"`{b}`").alias("lb"))
                      for a, b in itertools.combinations(raters, 2)])
    cells = (wide.select(F.inline(pairs)).dropna()
             .groupBy("rater_a", "rater_b", "la", "lb").agg(F.count("*").alias("n")))
    pair = ["rater_a", "rater_b"]
    same = cells.groupBy(*pair).agg(
        F.sum("n").alias("n_items"),
        F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)).alias("n_equal"))
    by_a = cells.groupBy(*pair, F.col("la").alias("label")).agg(F.sum("n").alias("na"))
    by_b = cells.groupBy(*pair, F.col("lb").alias("label")).agg(F.sum("n").alias("nb"))
    chance = (by_a.join(by_b, [*pair, "label"])
              .groupBy(*pair).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("both")))
    observed = F.col("n_equal") / F.col("n_items")
    expected = F.coalesce("both", F.lit(0.0)) / (F.col("n_items").cast("double") * F.col("n_items"))
    kappa = F.when(F.col("expected") < 1, (F.col("percent") - F.col("expected")) / (1 - F.col("expected")))
    return (same.join(chance, pair, "left")
            .withColumn("percent", observed).withColumn("expected", expected)
            .select(*pair, "n_items", F.col("percent").alias("agreement"), kappa.alias("kappa")))
