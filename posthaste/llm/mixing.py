"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Every source is shuffled and cut into blocks of equal numbers of words. A
golden-ratio sequence of points runs through the cumulative weights of the
sources, so that any stretch of the mix holds the sources in proportion; the
n-th point that falls to a source takes its block ``n``, and starts again from
the first when all are taken.

A source has ``BLOCKS`` blocks (fewer words: one word each), or more where they
would exceed ``BLOCK_WORDS``, so its words are within about two blocks of the
target. No block is taken more than ``repeats`` times.

Nulls and ties: a null text has no words; documents without words are returned
and never taken. A null source is a source, ordered last. Rows are ordered by
hashes of their values, so reruns agree; equal rows may swap places. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posthaste.sources.tables import stored

BLOCKS = 1024
BLOCK_WORDS = 1 << 20
# Rows of a source are summed in about so many cells per million rows.
CELLS = 64
CELL_ROWS = 200_000
MAX_CELLS = 65_536
# The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
WORD_GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Runs of characters that are not white space; none in a null."""
    inner = F.btrim(text, F.lit(SPACES))
    words = F.when(inner != "", F.size(F.split(inner, WORD_GAP)))
    return F.coalesce(words, F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150,
            repeats: int = 2) -> DataFrame:
    """``(source, source_size)`` -> also ``number``, ``weight`` and ``target``.

    Sources by code point, null last, weigh ``weights`` in turn. The targets
    share ``percent`` hundredths of all sizes; one above ``repeats`` times its
    source stops there, and the others share the rest by weight. As a source
    stops earlier the smaller it is for its weight, the stopping ones are the
    first ones by that ratio. One row per source passes through one task.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (sources.withColumn("number", F.row_number().over(everything) - 1)
              .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                 (F.col("number") % len(weights) + 1).cast("int")))
              .withColumn("most", F.lit(repeats) * F.col("source_size")))
    whole = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "number")
    before, all_rows = whole.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    # Words that are left, and the weight that shares them, once all earlier ones have stopped.
    left = (F.lit(percent) * F.sum("source_size").over(all_rows) / F.lit(100)
            - F.coalesce(F.sum("most").over(before), F.lit(0)))
    heavy = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    steps = ranked.withColumn("left", left).withColumn("heavy", heavy)
    going = F.col("left") * F.col("weight") < F.col("most") * F.col("heavy")
    first = steps.withColumn("rate", F.when(going, F.struct("left", "heavy")))
    # The first that does not stop sets the rate of all that follow.
    shared = F.first("rate", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    return (first.withColumn("shared", shared)
            .withColumn("target", F.coalesce(F.col("shared.left") * F.col("weight") / F.col("shared.heavy"),
                                             F.col("most").cast("double")))
            .select("source", "source_size", "number", "weight", "target"))


def _sources(words: DataFrame, weights: tuple[int, ...], percent: int, repeats: int) -> DataFrame:
    """Sizes, targets, blocks and stretches of the unit interval of all sources."""
    sums = words.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    aimed = targets(sums.select("source", "source_size"), weights, percent, repeats)
    cells = F.greatest(F.lit(CELLS), F.ceil(F.col("rows") / F.lit(CELL_ROWS)))
    sized = (aimed.join(sums.select(F.col("source").alias("_source"), "rows"),
                        F.col("source").eqNullSafe(F.col("_source")))
             .drop("_source").withColumn("cells", F.least(F.lit(MAX_CELLS), cells).cast("int"))
             .withColumn("width", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS),
                                                               F.ceil(F.col("source_size") / F.lit(BLOCKS)))))
             .withColumn("blocks", F.ceil(F.col("source_size") / F.col("width")).cast("long"))
             .withColumn("points", F.coalesce(
                 F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0))))
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    # Without any word there are no points and no stretches.
    ends = F.coalesce(F.try_divide(F.sum("points").over(upto), F.sum("points").over(Window.partitionBy(F.lit(0)))),
                      F.lit(0.0))
    return (sized.withColumn("end", ends)
            .withColumn("begin", F.lag("end", 1, 0.0).over(Window.orderBy("number"))).drop("rows"))


def schedule(sources: DataFrame, repeats: int = 2) -> DataFrame:
    """The mix as ``(position, number, block, epoch)``: which block comes when.

    Point ``position`` of the golden-ratio sequence falls to the source whose
    stretch ``[begin, end)`` holds it. Stretches and points meet by the cells
    of a grid, so this is an equi-join for any number of sources.
    """
    spark = sources.sparkSession
    count, points = sources.agg(F.count("*"), F.round(F.coalesce(F.sum("points"), F.lit(0.0))).cast("long")).first()
    grid = max(4096, count)
    turns = F.col("id") * F.lit(GOLDEN)
    slots = (spark.range(points).withColumn("point", turns - F.floor(turns))
             .withColumn("cell", F.floor(F.col("point") * grid)))
    stretches = sources.filter("points > 0").select(
        "number", "begin", "end", "blocks",
        F.explode(F.sequence(F.floor(F.col("begin") * grid), F.floor(F.col("end") * grid))).alias("cell"))
    fallen = stored(slots.join(stretches, "cell").filter("point >= begin and point < end")
                    .select(F.col("id").alias("position"), "number", "blocks",
                            F.floor(F.col("id") / F.lit(CELLS)).alias("chunk")), "slots")
    # The rank within a source, from counts per chunk of positions.
    counts = fallen.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select("number", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")),
                    "counts")
    inside = Window.partitionBy("number", "chunk").orderBy("position")
    ranked = (fallen.join(counts, ["number", "chunk"])
              .withColumn("rank", F.col("earlier") + F.row_number().over(inside) - 1))
    return (ranked.withColumn("block", F.col("rank") % F.col("blocks"))
            .withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")))
            .filter(F.col("epoch") < repeats).select("position", "number", "block", "epoch"))


def _placed(docs: DataFrame, weights: tuple[int, ...], percent: int, repeats: int) -> tuple[DataFrame, DataFrame]:
    """Documents with the word at which they start in their shuffled source, and the sources."""
    words = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                               F.xxhash64("doc_id", "text").alias("hash")), "words")
    sources = stored(_sources(words, weights, percent, repeats), "sources")
    known = sources.select(F.col("source").alias("_source"), "number", "source_size", "target", "cells", "width")
    dealt = (words.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
             .withColumn("cell", F.pmod(F.xxhash64("hash"), F.col("cells"))).drop("cells"))
    sums = dealt.groupBy("number", "cell").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("number").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sums.select("number", "cell", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset")),
                     "offsets")
    inside = (Window.partitionBy("number", "cell").orderBy("hash", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, 0))
    placed = (dealt.join(offsets, ["number", "cell"])
              .withColumn("start", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
              .drop("cell", "offset"))
    return stored(placed, "placed"), sources


def _pieces(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """The mix word by word: the stretch of a document that each position takes."""
    end = F.col("start") + F.col("size")
    cut = (placed.filter("size > 0")
           .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("width")),
                                                     F.floor((end - 1) / F.col("width")))))
           .withColumn("from", F.greatest(F.col("start"), F.col("block") * F.col("width")))
           .withColumn("words", F.least(end, (F.col("block") + 1) * F.col("width")) - F.col("from"))
           .withColumn("first_word", F.col("from") - F.col("start")))
    return slots.join(cut, ["number", "block"])


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, repeats: int = 2) -> DataFrame:
    """``docs(doc_id, text, source)`` -> the mix in order: ``(position, epoch, source, doc_id, first_word, words)``.

    Sort by ``position`` and, within, by ``start`` to read it.
    """
    placed, sources = _placed(docs, weights, percent, repeats)
    return _pieces(placed, schedule(sources, repeats)).select(
        "position", "epoch", "source", "doc_id", "start", "first_word", "words")


def taken(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, repeats: int = 2) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and ``taken``, the words the mix takes of it."""
    placed, sources = _placed(docs, weights, percent, repeats)
    sums = (_pieces(placed, schedule(sources, repeats)).groupBy("number", "start")
            .agg(F.sum("words").alias("taken")))
    # Documents with words start at different words of their source.
    keyed = placed.withColumn("key", F.when(F.col("size") > 0, F.col("start")))
    return (keyed.join(sums.withColumnRenamed("start", "key"), ["number", "key"], "left")
            .select("doc_id", "source", "hash", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).alias("taken")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, repeats: int = 2) -> DataFrame:
    """The documents of the mix: each as many times as its words are taken, to the nearest whole.

    Per source one document at most is taken in part. Rows that repeat doc_id,
    source and text share what they take. Documents without words are left out.
    """
    share = taken(docs, weights, percent, repeats).groupBy("doc_id", "source", "hash").agg(
        F.round(F.try_divide(F.sum("taken"), F.sum("size"))).cast("int").alias("_copies"))
    known = share.filter("_copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                                               F.col("hash").alias("_hash"), "_copies")
    same = (F.xxhash64("doc_id", "text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (
        F.col("source").eqNullSafe(F.col("_source")))
    return (docs.join(known, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*docs.columns))
