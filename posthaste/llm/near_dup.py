"""Near-duplicate documents: SuperMinHash signatures, banding, checks on full sets, union-find.

A document is the set of its distinct word shingles. Documents with equal sets
are one node from the start, so a group of copies costs one row per task, not
pairs. Nodes that share a band of their signature are candidates; a candidate
link counts only if the full sets are similar enough.

The nodes of a bucket are not paired with each other at large:

1. All are checked against the most central of them (the one that meets most
   nodes in its buckets), and components are formed.
2. Where a bucket still holds several components, its nodes are checked against
   the most central node of another component.
3. What is left are nodes of different components that share a bucket. They are
   compared in tiles of about ``TILE`` nodes on a longer signature, each pair
   in the first band it shares; only pairs that may reach the threshold leave
   the tile, and their full sets are compared. Nodes of a bucket's largest
   component meet only nodes of others there.

So no link is given up, and the rows that move stay in proportion to nodes
unless the nodes themselves are within a whisker of the threshold.

Nulls and ties: a null or empty text has no shingles, links with nothing and is
its own component. Rows that share a doc_id are one document, so whatever they
link to is linked. A row without doc_id has a null component and is not kept.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posthaste.llm.components import components
from posthaste.llm.words import PIECE_BYTES, as_bytes, by_bytes, mix, numbered, shingle_sets
from posthaste.sources.tables import stored

# At a similarity of 0.8 two documents share no band with a chance of 0.672 ** 24 < 1e-4,
# at 0.85 of 0.556 ** 24 < 1e-6.
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
# Slots of the signature that pairs are compared on in tiles, and nodes along a tile's side.
LONG_SLOTS = 960
TILE = 1024
# A pair goes on unless its estimated similarity is so many standard errors below the threshold.
ERRORS = 5
_U = np.uint64
_FRACTION_BITS = 53


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash of non-empty sets: one row of ``slots`` values per set.

    Each element walks through its own random permutation of the slots; its
    value at step ``j`` is ``j`` plus a fraction. All elements take a step at a
    time; a set stops as soon as its largest value is below the next step, as
    later steps cannot lower any.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values = np.full(len(sets) * slots, np.iinfo(_U).max, dtype=_U)
    element = np.concatenate(sets) if sets else np.zeros(0, dtype=_U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    seeds = numbered(slots, slots)
    kind = np.uint8 if slots <= 256 else np.uint16
    ranks = None
    for step in range(slots):
        random = mix(element ^ seeds[step])
        drawn = (random % _U(slots - step)).astype(np.int64) + step
        if ranks is None:
            slot = drawn
        else:
            lines = np.arange(len(element))
            slot = ranks[lines, drawn].astype(np.int64)
            ranks[lines, drawn] = ranks[:, step]
        value = (_U(step) << _U(_FRACTION_BITS)) | (mix(random) >> _U(64 - _FRACTION_BITS))
        np.minimum.at(values, owner * slots + slot, value)
        worst = values.reshape(-1, slots).max(axis=1, initial=0)
        going = (worst >= (_U(step + 1) << _U(_FRACTION_BITS)))[owner]
        if not going.any():
            break
        if ranks is None:
            element, owner, drawn = element[going], owner[going], drawn[going]
            ranks = np.tile(np.arange(slots, dtype=kind), (len(element), 1))
            ranks[np.arange(len(element)), drawn] = 0
        elif 2 * going.sum() < len(going):
            element, owner, ranks = element[going], owner[going], ranks[going]
    return values.reshape(-1, slots)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; equal keys mean that all its slots are equal."""
    parts = values.reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(numbered(BANDS, 43), parts.shape[:2])
    for row in range(ROWS):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + parts[:, :, row])
    return keys.view(np.int64)


def _set_id(members: np.ndarray) -> bytes | None:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None


def _profile(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for piece in by_bytes(texts):
            sets = shingle_sets(texts[piece], width)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = dict(zip(full, band_keys(signatures([sets[i] for i in full], SLOTS)))) if full else {}
            yield pa.record_batch([
                batch.column("doc_id").slice(piece.start, len(sets)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_set_id(s) for s in sets], pa.binary()),
                pa.array([keys.get(i) for i in range(len(sets))], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_id", "bands"])


def _prints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Id of the set and one byte per slot of its short and of its long signature."""
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for piece in by_bytes(texts, PIECE_BYTES // 16):
            sets = shingle_sets(texts[piece], width)
            columns = [batch.column("doc_id").slice(piece.start, len(sets)),
                       pa.array([_set_id(s) for s in sets], pa.binary())]
            for slots in (SLOTS, LONG_SLOTS):
                marks = mix(signatures(sets, slots)).astype(np.uint8)
                columns.append(pa.array([m.tobytes() for m in marks], pa.binary()))
            yield pa.record_batch(columns, ["node", "set_id", "short", "long"])


def _least_equal(slots: int, percent: int) -> float:
    share = percent / 100
    return slots * share - ERRORS * math.sqrt(slots * share * (1 - share))


def _tile(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one tile after the other that may reach the threshold.

    Rows come sorted by tile, so at most two sides of a tile are held.
    """
    least_short, least_long = _least_equal(SLOTS, percent), _least_equal(LONG_SLOTS, percent)

    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        node, root, size = (table.column(c).to_numpy() for c in ("node", "root", "size"))
        side = table.column("side").to_numpy()
        short, long = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.uint8).reshape(len(node), -1)
                       for c in ("short", "long"))
        bands = np.array(table.column("bands").to_pylist(), dtype=np.int64)
        band = table.column("band")[0].as_py()
        diagonal = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i in np.flatnonzero(side == 0):
            other = np.arange(i + 1, len(node)) if diagonal else np.flatnonzero(side == 1)
            other = other[root[other] != root[i]]
            other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
            other = other[(short[other] == short[i]).sum(axis=1) >= least_short]
            other = other[(bands[other] == bands[i]).argmax(axis=1) == band]
            other = other[(long[other] == long[i]).sum(axis=1) >= least_long]
            left.append(np.full(len(other), node[i]))
            right.append(node[other])
        ends = np.concatenate(left), np.concatenate(right)
        return pa.record_batch([pa.array(np.maximum(*ends)), pa.array(np.minimum(*ends))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "high"))))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if keys[start] != current and held:
                yield pairs(held)
                held = []
            current = keys[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield pairs(held)


def _similar(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    last: tuple[bytes, np.ndarray] | None = None
    for batch in batches:
        left, right = as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b"))
        linked = np.zeros(batch.num_rows, dtype=bool)
        for piece in by_bytes(left):
            for i, mine in enumerate(shingle_sets(left[piece], width), piece.start):
                # Rows come sorted by b, so its set is often the one just made.
                if last is None or last[0] != right[i]:
                    last = (right[i], shingle_sets([right[i]], width)[0])
                other = last[1]
                small, large = min(len(mine), len(other)), max(len(mine), len(other))
                if 100 * small >= percent * large:
                    common = len(np.intersect1d(mine, other, assume_unique=True))
                    linked[i] = 100 * common >= percent * (len(mine) + len(other) - common)
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])


def _checked(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Whether the full sets of ``pairs(a, b)`` are similar: ``(a, b, linked)``."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(partial(_similar, width=width, percent=percent),
                                  "a long, b long, linked boolean"), "checked")


def _ordered(x: str, y: str) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _central_pairs(members: DataFrame) -> DataFrame:
    """Every node with the most central node of each of its buckets."""
    pivots = stored(members.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("pivot")), "pivots")
    return members.join(pivots, "bucket").filter("node != pivot").select(*_ordered("node", "pivot")).distinct()


def _second_pairs(members: DataFrame) -> DataFrame:
    """In buckets with several components: nodes against the most central node
    outside the component of the bucket's most central node."""
    order = F.struct("weight", "node")
    first = stored(members.groupBy("bucket").agg(F.max_by("root", order).alias("main"), F.min("root").alias("low"),
                                                 F.max("root").alias("high"))
                   .filter("low < high").select("bucket", "main"), "pivots")
    mixed = stored(members.join(first, "bucket"), "mixed")
    second = stored(mixed.filter("root != main").groupBy("bucket")
                    .agg(F.max_by(F.struct("node", "root"), order).alias("pivot")), "pivots")
    return (mixed.join(second, "bucket").filter("root != pivot.root")
            .select(*_ordered("node", "pivot.node")).distinct())


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with the bucket's
    largest component ``main`` and its number of rows ``most``.

    Buckets of three are complete after two pivots.
    """
    counts = members.filter("crowd > 3").groupBy("bucket", "root").agg(F.count("*").alias("n"))
    crowded = stored(counts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"),
                                                  F.max("n").alias("most"), F.sum("n").alias("all"))
                     .filter("most < all").drop("all"), "mixed")
    return members.join(crowded, "bucket")


def _dealt(rows: DataFrame) -> DataFrame:
    """Nodes of a bucket dealt to blocks; a tile is a pair of blocks.

    Blocks of the largest component meet those of the others but not each
    other, so a few strangers among very many linked nodes move each node as
    often as there are blocks of strangers.
    """
    side = F.lit(TILE // 2)
    main, strangers = F.ceil(F.col("most") / side), F.ceil((F.col("crowd") - F.col("most")) / side)
    spot = F.xxhash64("node", "bucket")
    placed = (rows.withColumn("inside", F.col("root") == F.col("main"))
              .withColumn("first", main.cast("int")).withColumn("last", (main + strangers - 1).cast("int"))
              .withColumn("block", F.when(F.col("inside"), F.pmod(spot, F.col("first")))
                          .otherwise(F.col("first") + F.pmod(spot, F.col("last") - F.col("first") + 1)).cast("int")))
    met = F.sequence(F.when(F.col("inside"), F.col("first")).otherwise(F.lit(0)), F.col("last"))
    return placed.withColumn("other", F.explode(met)).select(
        "node", "root", "bucket", "band", F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"))


def _tile_pairs(members: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs across components that share a bucket and may reach the threshold."""
    rows = stored(_mixed(members), "rows")
    wanted = rows.select(F.col("node").alias("doc_id")).distinct()
    prints = stored(texts.join(wanted, "doc_id", "left_semi")
                    .mapInArrow(partial(_prints, width=width), "node long, set_id binary, short binary, long binary")
                    .dropDuplicates(["node", "set_id"])
                    .join(nodes.select("node", "set_id", "size", "bands"), ["node", "set_id"]).drop("set_id"), "prints")
    # A node has several prints if its doc_id is repeated with other texts: only that of the bucket's own set counts.
    filled = (_dealt(rows).join(prints, "node").filter(F.get("bands", "band") == F.col("bucket"))
              .repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "side", "node"))
    return filled.mapInArrow(partial(_tile, percent=percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row per row.

    Documents whose ``width``-word shingle sets have an intersection of at
    least ``percent`` hundredths of their union are linked; ``component_id`` is
    the smallest doc_id that links reach, and only that document is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = stored(docs.mapInArrow(
        partial(_profile, width=width),
        "doc_id long, n_shingles long, set_id binary, bands array<long>"), "profile")
    # One node per distinct set, named by its smallest document.
    nodes = stored(profile.filter("set_id is not null and doc_id is not null").groupBy("set_id")
                   .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"),
                        F.first("bands").alias("bands")), "nodes")
    named = stored(profile.select("doc_id", "n_shingles", "set_id")
                   .join(nodes.select("set_id", "node"), "set_id", "left")
                   .select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node")), "named")
    # A repeated doc_id with different texts ties all their nodes to the smallest of them.
    several = (named.filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a"))
               .filter("a != b").select("doc_id", "b"))
    links = [stored(named.join(several, "doc_id").filter("node != b")
                    .select(F.col("node").alias("a"), "b").distinct(), "links")]

    placed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    crowded = stored(placed.groupBy("bucket").agg(F.count("*").alias("crowd")).filter("crowd > 1"), "crowded")
    meeting = stored(placed.join(crowded, "bucket"), "meeting")
    weights = meeting.groupBy("node").agg(F.sum("crowd").alias("weight"))
    members = stored(meeting.join(weights, "node"), "members")

    texts = None
    done: list[DataFrame] = []
    roots = components(links[0])
    for turn in range(3):
        if turn == 0:
            pairs = _central_pairs(members)
        else:
            rooted = stored(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
            pairs = (_second_pairs(rooted) if turn == 1 else
                     _tile_pairs(rooted, nodes, texts, width, percent))
        if done:
            pairs = pairs.join(reduce(DataFrame.unionByName, done), ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            # Without a bucket in the first turn there is none later; an empty second turn says nothing of the tiles.
            if turn == 0:
                break
            continue
        if texts is None:
            # Every node that shares a bucket is in a pair of the first turn.
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
            # As many ids as documents with a copy: never broadcast, so the plan is the same at every size.
            texts = stored(docs.filter("text is not null").join(wanted.hint("merge"), "doc_id", "left_semi"), "texts")
        checked = _checked(texts, pairs, width, percent)
        done.append(checked.select("a", "b"))
        found = checked.filter("linked").select("a", "b")
        if not found.isEmpty():
            links.append(found)
            roots = components(stored(reduce(DataFrame.unionByName, links), "links"))
    return (named.join(roots, "node", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def without_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; of a repeated
    doc_id the row whose text has the smallest digest, a null text last.

    Rows without doc_id cannot be told apart, so they all stay.
    """
    kept = near_duplicates(docs, width, percent).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.filter("doc_id is not null")
    placed = Window.partitionBy("doc_id").orderBy(F.md5(F.encode("text", "UTF-8")).asc_nulls_last(),
                                                  F.xxhash64(*docs.columns))
    once = (named.join(kept, F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
            .withColumn("_nth", F.row_number().over(placed)).filter("_nth = 1").drop("_nth"))
    return once.unionByName(docs.filter("doc_id is null"))
