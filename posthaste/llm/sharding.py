"""Shards of near equal bytes: best-fit-decreasing packing of indivisible groups.

Rows with equal text are a group and stay in one shard. Groups are far too many
to pack one by one, so only the large ones are items of their own. There are at
most ``PARTS`` of them, because each holds at least that share of all bytes. The
small ones are dealt by hash to ``PARTS`` pallets, which are indivisible items
too. A group that is larger than a shard is cut by doc_id into pieces that are
at most a ``PARTS``-th of all bytes on average. So the packing itself sees a
bounded number of items whatever the input, and the rows are only counted,
labelled and numbered.

Nulls and ties: a null text has no bytes and counts as one; all null texts are
one group. Repeated rows are rows like any other. An empty table gives an empty
result; other columns are carried along, but for those named like an added one.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posthaste.llm.columns import by_name, by_place
from posthaste.sources.tables import stored

# Share of all bytes from which a group is packed by itself, and number of pallets for the rest.
PARTS = 4096
# Rows are numbered inside cells of at most about so many rows, or a PARTS-th of all rows if
# that is less; the number of cells is bounded as well.
CELL_ROWS = 200_000
MAX_CELLS = 65_536


class _Room:
    """Bins by remaining room in a height-balanced (AVL) search tree."""

    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key: tuple[int, int]):
        self.key, self.left, self.right, self.height = key, None, None, 1


def _height(node: _Room | None) -> int:
    return node.height if node else 0


def _turned(node: _Room, up: str, down: str) -> _Room:
    """The child on side ``up`` takes the place of its parent."""
    child = getattr(node, up)
    setattr(node, up, getattr(child, down))
    setattr(child, down, node)
    for x in (node, child):
        x.height = 1 + max(_height(x.left), _height(x.right))
    return child


def _balanced(node: _Room) -> _Room:
    node.height = 1 + max(_height(node.left), _height(node.right))
    for up, down in (("left", "right"), ("right", "left")):
        child = getattr(node, up)
        if _height(child) > _height(getattr(node, down)) + 1:
            if _height(getattr(child, down)) > _height(getattr(child, up)):
                setattr(node, up, _turned(child, down, up))
            return _turned(node, up, down)
    return node


def _added(node: _Room | None, key: tuple[int, int]) -> _Room:
    if node is None:
        return _Room(key)
    side = "left" if key < node.key else "right"
    setattr(node, side, _added(getattr(node, side), key))
    return _balanced(node)


def _removed(node: _Room, key: tuple[int, int]) -> _Room | None:
    if key != node.key:
        side = "left" if key < node.key else "right"
        setattr(node, side, _removed(getattr(node, side), key))
        return _balanced(node)
    if node.left is None or node.right is None:
        return node.left or node.right
    after = node.right
    while after.left:
        after = after.left
    node.key, node.right = after.key, _removed(node.right, after.key)
    return _balanced(node)


def _tightest(node: _Room | None, size: int) -> tuple[int, int] | None:
    """The smallest room that holds ``size``."""
    best = None
    while node:
        if node.key[0] >= size:
            best, node = node.key, node.left
        else:
            node = node.right
    return best


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each item; an item enters the tightest bin that holds it, the
    largest item first, and opens a new bin where none does.

    Items of equal size keep their order. An item above the capacity gets a bin
    of its own.
    """
    bins, tree, opened = [0] * len(sizes), None, 0
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = _tightest(tree, sizes[item])
        if room is None:
            room, opened = (max(capacity, sizes[item]), opened), opened + 1
        else:
            tree = _removed(tree, room)
        bins[item] = room[1]
        tree = _added(tree, (room[0] - sizes[item], room[1]))
    return bins


def fewest_bytes(sizes: Sequence[int], shards: int) -> list[int]:
    """The packing with the smallest capacity found that needs at most ``shards`` bins."""
    low = max(math.ceil(sum(sizes) / shards), max(sizes, default=0))
    # With this much room a new bin is opened only when all others are above the mean.
    high = math.ceil(sum(sizes) / shards) + max(sizes, default=0)
    best = best_fit_decreasing(sizes, high)
    while low < high:
        middle = (low + high) // 2
        bins = best_fit_decreasing(sizes, middle)
        if max(bins, default=0) < shards:
            best, high = bins, middle
        else:
            low = middle + 1
    return best


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)


def shard(docs: DataFrame, shards: int | None = 8, capacity: int | None = None,
          text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add ``size`` (UTF-8 bytes and one), ``shard`` and ``slot`` (0, 1, ... in the shard).

    Either a fixed number of ``shards`` of the least capacity, or as few shards
    as best fit needs for a fixed ``capacity``. A capacity that needs more than
    about 6,400 shards (``100 * PARTS // 64``) raises ValueError.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give a number of shards or a capacity")
    numbered, (text, key) = by_place(docs, text, key)
    body = F.col(text)
    sized = (numbered.withColumn("size", text_size(body))
             # 64 bits of one hash, 32 of another and the size: equal for equal texts only.
             .withColumn("_a", F.xxhash64(body))
             .withColumn("_b", F.coalesce(F.crc32(F.encode(body, "UTF-8")), F.lit(-1)))
             .withColumn("_at", F.xxhash64(F.col(key), F.lit(1))))
    facts = stored(sized.select("size", "_a", "_b", "_at"), "sizes")
    rows, total = facts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bound = capacity if capacity is not None else max(1, math.ceil(total / shards))
    least = max(1, math.ceil(total / PARTS)) if capacity is None else max(1, min(bound // 64, math.ceil(total / PARTS)))
    if total // least > 100 * PARTS:
        raise ValueError(f"a capacity of {capacity} needs more than {100 * PARTS // 64} shards")
    pallets = max(PARTS, math.ceil(total / least))
    groups = facts.groupBy("size", "_a", "_b").agg(F.count("*").alias("rows"))
    # At most total / least rows, by their size.
    large = [tuple(r) for r in groups.filter(F.col("size") * F.col("rows") >= least)
             .orderBy("size", "_a", "_b").collect()]

    cell_rows = max(math.ceil(rows / MAX_CELLS), min(CELL_ROWS, math.ceil(rows / PARTS)), 1)
    cells = max(1, rows // pallets // cell_rows)
    marks, items = [], 0
    for size, a, b, count in large:
        whole = size * count <= bound
        pieces = 1 if whole else min(count, math.ceil(size * count / least))
        marks.append((size, a, b, pallets + items, pieces, max(1, math.ceil(count / pieces / cell_rows))))
        items += pieces
    spark = docs.sparkSession
    known = spark.createDataFrame(marks, "size long, _a long, _b long, _item int, _pieces int, _cells int")

    def placed(df: DataFrame) -> DataFrame:
        """Add the item that a row belongs to, and the cell in which it is numbered."""
        spread = F.pmod(F.xxhash64("_at"), F.col("_cells")).cast("int")
        return (df.join(F.broadcast(known), ["size", "_a", "_b"], "left")
                .withColumn("_cells", F.coalesce("_cells", F.lit(cells)))
                .withColumn("_item", F.when(F.col("_item").isNull(), F.pmod("_a", F.lit(pallets)).cast("int"))
                            .otherwise(F.col("_item") + F.pmod("_at", F.col("_pieces")).cast("int")))
                .withColumn("_cell", spread).drop("_pieces", "_cells"))

    counted = sorted(tuple(r) for r in placed(facts).groupBy("_item", "_cell").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
    names = sorted({c[0] for c in counted})
    sizes = [0] * len(names)
    for item, _, size, _ in counted:
        sizes[bisect.bisect_left(names, item)] += size
    bins = fewest_bytes(sizes, shards) if capacity is None else best_fit_decreasing(sizes, capacity)
    taken: dict[int, int] = {}
    starts = []
    for item, cell, _, count in counted:
        home = bins[bisect.bisect_left(names, item)]
        starts.append((item, cell, home, taken.get(home, 0)))
        taken[home] = taken.get(home, 0) + count
    # One row per cell: at most PARTS pallets, as many large groups or pieces, and MAX_CELLS.
    homes = spark.createDataFrame(starts, "_item int, _cell int, shard int, _start long")
    inside = Window.partitionBy("_item", "_cell").orderBy("_at", key, "_a", "_b", "size")
    dealt = (placed(sized).withColumn("_nth", F.row_number().over(inside))
             .join(F.broadcast(homes), ["_item", "_cell"])
             .withColumn("slot", F.col("_start") + F.col("_nth") - F.lit(1)))
    return by_name(dealt, docs.columns, ["size", "shard", "slot"])
