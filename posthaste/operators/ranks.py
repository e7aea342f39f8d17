"""Exact row positions without sorting a table in one task.

A :class:`RowOrder` is a column to sort by and doubles that never decrease
along it. Quantiles of such a double give literal range bounds, so the range a
row falls in is a function of the row alone: a recomputed task (lost executor)
always puts it in the same range, and nothing has to be cached or checkpointed.
The driver only sees bounds and per-range counts.

Rows that tie go by a digest of the whole row. Rows equal in every column are
interchangeable: where a cut falls between them, both sides get as many copies
as are theirs.

The input is scanned more than once, so give a stored table or a cheap plan
over one; only the order columns are read in the extra scans.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from posthaste.sources.tables import staged

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 20_000
SAMPLED_PER_RANGE = 200
# Keys that may be sorted at once to read off one rank.
MAX_SORTED_KEYS = 100_000
# Positions of NULL and of the largest number.
_LAST, _LARGEST = 1.7976931348623157e308, 1.7976931348623155e308
# 13 hex digits are 52 bits, which a double holds exactly.
_HEAD = 2.0 ** 52
# Copies that one task makes at a time.
_COPIES = 1_000_000


@dataclass(frozen=True)
class RowOrder:
    """Ascending by ``column``, NULL last."""

    column: Column
    # The first never decreases along the order, each next one where those before are equal.
    positions: tuple[Column, ...]
    # Set when the first position is spread evenly over [0, uniform).
    uniform: float | None = None

    def before(self, key) -> Column:
        return self.column.isNotNull() if key is None else self.column < F.lit(key)

    def equal(self, key) -> Column:
        return self.column.isNull() if key is None else self.column == F.lit(key)


@dataclass(frozen=True)
class Cut:
    """The first ``rank`` rows: those where ``head`` holds, and ``rank - first``
    of the ``equal`` rows where ``same`` holds, which do not differ."""

    rank: int
    head: Column
    same: Column | None = None
    first: int = 0
    equal: int = 0


def by_column(name: str) -> RowOrder:
    """Ascending order of a numeric column, NULLs last."""
    column = F.col(name)
    coarse = column.cast("double")
    # What the double leaves of a long or decimal number.
    fine = (column - F.coalesce(coarse.try_cast("long"), F.lit(0))).cast("double")
    return RowOrder(column, (F.coalesce(F.least(coarse, F.lit(_LARGEST)), F.lit(_LAST)), F.coalesce(fine, F.lit(0.0))))


def seeded_digest(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def _by_digest(digest: Column) -> RowOrder:
    heads = [F.conv(F.substring(digest, start, 13), 16, 10).cast("double") for start in (1, 14)]
    return RowOrder(digest, tuple(heads), uniform=_HEAD)


def seeded(seed: int, key: str) -> RowOrder:
    """A random but repeatable order: by digest of seed and key."""
    return _by_digest(seeded_digest(seed, key))


def row_digest(df: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns])))


def range_count(df: DataFrame, rows: int, rows_per_range: int = ROWS_PER_RANGE) -> int:
    """Ranges of about ``rows_per_range`` rows, and at least one per task slot."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return min(MAX_RANGES, max(slots, 2, math.ceil(rows / rows_per_range)))


def range_bounds(df: DataFrame, positions: Sequence[Column], rows: int, ranges: int) -> list[list[float]]:
    """For each position at most ``ranges - 1`` increasing cut points of about
    equal row counts.

    They only balance the work, so a sample will do: every row is counted and
    placed afterwards. Sampling keeps the sketch that one task must merge small.
    """
    share = min(1.0, SAMPLED_PER_RANGE * ranges / max(rows, 1))
    drawn = df if share == 1.0 else df.sample(fraction=share, seed=0)
    probabilities = [i / ranges for i in range(1, ranges)]
    found = drawn.agg(*[F.percentile_approx(p, probabilities, max(10_000, 10 * ranges)) for p in positions]).first()
    return [sorted(set(cuts or []) - {float("inf")}) for cuts in found]


def _around(values: Sequence[float]) -> list[float]:
    """Bounds that give each of some values a range of its own, however many rows have it."""
    bounds = {b for value in values for b in (value, math.nextafter(value, math.inf))}
    return sorted(b for b in bounds if math.isfinite(b))


def _order_bounds(keys: DataFrame, order: RowOrder, rows: int, ranges: int) -> list[float]:
    if order.uniform:
        return [order.uniform * i / ranges for i in range(1, ranges)]
    return range_bounds(keys, [F.col("_at")], rows, ranges)[0]


def with_range(df: DataFrame, position: str, bounds: Sequence[float], name: str) -> DataFrame:
    """Add the number of the half-open range that holds ``position``."""
    if not bounds:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    marked = Bucketizer(splits=splits, inputCol=position, outputCol=name).transform(df)
    return marked.withColumn(name, F.col(name).cast("int"))


def _range_sizes(df: DataFrame, bounds: Sequence[float]) -> list[int]:
    counts = with_range(df, "_at", bounds, "_range").groupBy("_range").count().collect()
    sizes = [0] * (len(bounds) + 1)
    for row in counts:
        sizes[row["_range"]] = row["count"]
    return sizes


def _split_bounds(keys: DataFrame, order: RowOrder, rows: int, ranges: int) -> tuple[list[float], list[int]]:
    """Bounds on the first position, and into how many parts each range is to
    be split: a position that is the cut at several quantiles has a range of its own."""
    if order.uniform:
        return _order_bounds(keys, order, rows, ranges), [1] * ranges
    share = min(1.0, SAMPLED_PER_RANGE * ranges / max(rows, 1))
    drawn = keys if share == 1.0 else keys.sample(fraction=share, seed=0)
    probabilities = [i / ranges for i in range(1, ranges)]
    cuts = drawn.agg(F.percentile_approx("_at", probabilities, max(10_000, 10 * ranges))).first()[0] or []
    parts: dict[float, int] = {}
    for cut in cuts:
        parts[cut] = parts.get(cut, 0) + 1
    bounds: dict[float, int] = {}
    for cut, times in sorted(parts.items()):
        bounds[cut] = times + 1 if times > 1 else 1
        if times > 1 and cut < _LAST:
            bounds.setdefault(math.nextafter(cut, math.inf), 1)
    return sorted(bounds), [1, *[bounds[b] for b in sorted(bounds)]]


def with_ordinal(df: DataFrame, order: RowOrder, name: str = "ordinal",
                 rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add the 0-based position of every row: one shuffle, by range.

    Rows that tie go by their digest, and a value of many rows, NULL too, is
    dealt to several ranges by it. Rows equal in all columns share one range.
    """
    spark = df.sparkSession
    digest = row_digest(df)
    rows = df.count()
    bounds, parts = _split_bounds(df.select(order.positions[0].alias("_at")), order, rows,
                                  range_count(df, rows, rows_per_range))
    starts = [0, *itertools.accumulate(parts)]
    placed = with_range(df.withColumn("_at", order.positions[0]), "_at", bounds, "_range")
    if max(parts) > 1:
        of_range = F.get(F.lit(parts), F.col("_range"))
        spread = F.floor(_by_digest(digest).positions[0] * of_range / F.lit(_HEAD)).cast("int")
        placed = placed.withColumn("_range", F.get(F.lit(starts), F.col("_range"))
                                   + F.when(of_range > 1, spread).otherwise(0))
    offsets, total = [], 0
    for row in sorted(placed.groupBy("_range").count().collect()):
        offsets.append((row["_range"], total))
        total += row["count"]
    # One row per range, so at most a few times MAX_RANGES rows are broadcast.
    numbers = spark.createDataFrame(offsets, "_range int, _start long")
    inside = Window.partitionBy("_range").orderBy(order.column.asc_nulls_last(), digest)
    return (placed.join(F.broadcast(numbers), "_range")
            .withColumn(name, F.col("_start") + F.row_number().over(inside) - F.lit(1))
            .drop("_at", "_range", "_start"))


def with_position(df: DataFrame, order: Sequence[str], name: str) -> tuple[DataFrame, str]:
    """Add the 0-based position by columns of any type, NULLs last, and the
    path of the table in which the rows were laid down by ranges.

    A row's range is written with it, so rereading cannot change it.
    """
    columns = [F.col(c).asc_nulls_last() for c in order]
    placed, path = staged(df.repartitionByRange(*columns).withColumn("_range", F.spark_partition_id()), "ranges")
    offsets, total = [], 0
    for row in sorted(placed.groupBy("_range").count().collect()):
        offsets.append((row["_range"], total))
        total += row["count"]
    # One row per shuffle partition.
    starts = df.sparkSession.createDataFrame(offsets, "_range int, _start long")
    inside = Window.partitionBy("_range").orderBy(*columns, F.xxhash64(*df.columns))
    return (placed.join(F.broadcast(starts), "_range")
            .withColumn(name, F.col("_start") + F.row_number().over(inside) - F.lit(1))
            .drop("_range", "_start")), path


def cut_at(df: DataFrame, order: RowOrder, n: int, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows of an order and the rest, both filters of ``df``."""
    rows = df.count() if rows is None else rows
    if n <= 0 or n >= rows:
        return df.filter(F.lit(n > 0)), df.filter(F.lit(n <= 0))
    [cut] = cuts_at(df, order, [n], rows)
    after = ~F.coalesce(cut.head, F.lit(False))
    if cut.same is None:
        return df.filter(cut.head), df.filter(after)
    wanted = cut.rank - cut.first
    return (df.filter(cut.head).unionByName(_copies(df, cut.same, wanted)),
            df.filter(after & ~F.coalesce(cut.same, F.lit(False))).unionByName(_copies(df, cut.same, cut.equal - wanted)))


def with_part(df: DataFrame, order: RowOrder, starts: Sequence[int], name: str, rows: int | None = None) -> DataFrame:
    """Add the number of the part of the order that a row is in; part i+1 begins at ``starts[i]``."""
    rows = df.count() if rows is None else rows
    cuts = cuts_at(df, order, starts, rows)
    apart = {cut.first: cut for cut in cuts if cut.same is not None}
    part = reduce(Column.__add__, [F.when(cut.head, 0).otherwise(1) for cut in cuts], F.lit(0))
    found = df.withColumn(name, part)
    for first, cut in apart.items():
        found = found.filter(~F.coalesce(cut.same, F.lit(False)))
    for first, cut in apart.items():
        copies = _copies(df, cut.same, cut.equal, "_nth")
        place = reduce(Column.__add__, [(F.col("_nth") + first >= s).cast("int") for s in starts], F.lit(0))
        found = found.unionByName(copies.withColumn(name, place).drop("_nth"))
    return found


def _copies(df: DataFrame, same: Column, count: int, number: str | None = None) -> DataFrame:
    """``count`` copies of a row that stands for all rows where ``same`` holds."""
    one = df.filter(same).limit(1)
    last = F.least(F.col("_from") + (_COPIES - 1), F.lit(count - 1))
    dealt = one.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"),
                                                         F.lit(_COPIES).cast("long"))))
    if count > _COPIES:
        dealt = dealt.repartition("_from")
    made = dealt.withColumn("_copy", F.explode(F.sequence("_from", last))).drop("_from")
    return made.withColumnRenamed("_copy", number) if number else made.drop("_copy")


def cuts_at(df: DataFrame, order: RowOrder, ranks: Sequence[int], rows: int | None = None) -> list[Cut]:
    """How to tell the first rows of an order from the rest, for each rank.

    Counting rows per range finds the range that holds a rank, and only the
    keys of such ranges are sorted. Rows are compared with the key afterwards,
    so selecting by rank needs no shuffle of the rows. Only rows that tie with
    the key are told apart by a digest of the whole row.
    """
    total = df.count() if rows is None else rows
    found = _keys_at(df, order, ranks, total)
    inner = _by_digest(row_digest(df))
    split: dict = {}
    for rank in ranks:
        if 0 < rank < total and found[rank].first < rank:
            split.setdefault(found[rank].key, []).append(rank)
    # All cuts inside one key are looked up at once.
    among = {}
    for key, those in split.items():
        _, first, equal = found[those[0]]
        digests = _keys_at(df.filter(order.equal(key)), inner, [rank - first for rank in those], equal)
        among.update({rank: digests[rank - first] for rank in those})
    cuts = []
    for rank in ranks:
        if not 0 < rank < total:
            cuts.append(Cut(rank, F.lit(rank > 0)))
            continue
        key, first, equal = found[rank]
        if first == rank:
            cuts.append(Cut(rank, order.before(key)))
            continue
        digest, before, copies = among[rank]
        # A NULL key that is not before the cut counts as false.
        head = F.coalesce(order.before(key), F.lit(False)) | (order.equal(key) & inner.before(digest))
        if before == rank - first:
            cuts.append(Cut(rank, head))
        else:
            cuts.append(Cut(rank, head, order.equal(key) & inner.equal(digest), first + before, copies))
    return cuts


def _keys_at(df: DataFrame, order: RowOrder, ranks: Sequence[int], rows: int) -> dict[int, Row]:
    """For each 0-based rank the key found there, how many rows come before that key and how many have it."""
    keys = df.select(order.column.alias("_key"), *[p.alias(f"_p{i}") for i, p in enumerate(order.positions)])
    return _find(keys, order, 0, len(order.positions), rows, sorted({r for r in ranks if 0 <= r < rows}))


def _find(keys: DataFrame, order: RowOrder | None, level: int, levels: int, rows: int,
          ranks: list[int]) -> dict[int, Row]:
    """The keys at some ranks. Sampled positions have ranges of their own, so that each step down either
    leaves one position or has a small part of the rows."""
    if not ranks:
        return {}
    bounds: list[float] = []
    sizes = [rows]
    if rows > MAX_SORTED_KEYS and (order is None or level == levels):
        # A part that is one hot key needs no further step.
        low, high, known = keys.agg(F.min("_key"), F.max("_key"), F.count("_key")).first()
        if not known or (known == rows and low == high):
            return {rank: Row(key=low, first=0, equal=rows) for rank in ranks}
    if rows > MAX_SORTED_KEYS and level < levels:
        placed = keys.withColumn("_at", F.col(f"_p{level}"))
        ranges = range_count(keys, rows, MAX_SORTED_KEYS // 2)
        bounds = (_order_bounds(placed, order, rows, ranges) if order and order.uniform
                  else _around(range_bounds(placed, [F.col("_at")], rows, ranges)[0]))
        sizes = _range_sizes(placed, bounds)
        if max(sizes) == rows:
            low, high = placed.agg(F.min("_at"), F.max("_at")).first()
            if low == high:
                return _find(keys, None, level + 1, levels, rows, ranks)
            bounds = _around([low, high])
            sizes = _range_sizes(placed, bounds)
    starts = [0, *itertools.accumulate(sizes)]
    held: dict[int, list[int]] = {}
    for rank in ranks:
        held.setdefault(bisect.bisect_right(starts, rank) - 1, []).append(rank)

    found: dict[int, Row] = {}
    # Keys that no position tells apart are sorted however many they are.
    sortable = [r for r in held if sizes[r] <= MAX_SORTED_KEYS or level == levels]
    if sortable:
        wanted = F.lit(False)
        for r in sortable:
            nths = [rank - starts[r] + 1 for rank in held[r]]
            wanted = wanted | ((F.col("_range") == r) & F.col("_nth").isin(nths))
        inside = Window.partitionBy("_range").orderBy(F.col("_key").asc_nulls_last())
        placed = keys.withColumn("_at", F.col(f"_p{min(level, levels - 1)}"))
        rows_found = (with_range(placed, "_at", bounds, "_range").filter(F.col("_range").isin(sortable))
                      .withColumns({"_nth": F.row_number().over(inside), "_first": F.rank().over(inside),
                                    "_equal": F.count(F.lit(1)).over(Window.partitionBy("_range", "_key"))})
                      .filter(wanted).collect())
        for row in rows_found:
            start = starts[row["_range"]]
            found[start + row["_nth"] - 1] = Row(key=row["_key"], first=start + row["_first"] - 1, equal=row["_equal"])
    for r in set(held) - set(sortable):
        at = F.col(f"_p{level}")
        part = keys
        if r > 0:
            part = part.filter(at >= F.lit(bounds[r - 1]))
        if r < len(bounds):
            part = part.filter(at < F.lit(bounds[r]))
        lone = 0 < r < len(bounds) and bounds[r] == math.nextafter(bounds[r - 1], math.inf)
        deeper = _find(part, None, level + lone, levels, sizes[r], [rank - starts[r] for rank in held[r]])
        found.update({starts[r] + rank: Row(key=k.key, first=starts[r] + k.first, equal=k.equal)
                      for rank, k in deeper.items()})
    return found
