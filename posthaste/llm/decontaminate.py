"""Benchmark decontamination in DataFrame functions only.

Every run of ``width`` words of a benchmark item is a window; a shorter item is
one window. The 64-bit hashes of all windows are broadcast as a set. The scan of
the documents hashes the words from every position on, once for each length that
windows have, and asks the set; what it finds is then verified word by word, so
equal hashes of other words give no hits.

The set is broadcast in blocks of at most ``MAX_BROADCAST_BYTES``, one scan of
the documents for each; only beyond some two million windows are there several.
Nothing but found windows and one row per document leaves the scan. Lists of
items go neither with windows nor with hits: equal lists have one number, and
the lists meet the numbers that a document has found.

Words are runs of letters a-z, digits and characters beyond ASCII; only A-Z are
lower-cased. Nulls and ties: a null or empty text has no words and no hits.
Items with equal id are one item; a null id counts as the empty id. Repeated
rows of a document stay, each with the same result. Empty tables on either side
give no hits; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthaste.sources.tables import stored

WIDTH = 13
MAX_BROADCAST_BYTES = 64 << 20
# What a key of a broadcast takes, and the least number of them in a block.
KEY_BYTES = 32
KEYS_AT_LEAST = 64
# Words as they are written, and what stands between them.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the quick way where a text is ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, lower))


def words(text: Column) -> Column:
    """The words as written; splitting is far cheaper than gathering matches."""
    return F.coalesce(F.array_remove(F.split(text, GAP), ""), F.array().cast("array<string>"))


def _key(said: Column) -> Column:
    return F.xxhash64(said)


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``benchmark(item_id, text)`` -> distinct windows: ``(words, key, items)``."""
    said = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                            F.transform(words(F.col("text")), lower_ascii).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - F.lit(width - 1)))
    cut = said.select("item", F.explode(starts).alias("at"), "all").select(
        "item", F.slice("all", F.col("at"), F.lit(width)).alias("words"))
    whole = cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return whole.select("words", _key(F.col("words")).alias("key"), "items")


def _numbered(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows ``(words, key, list)``, and the distinct lists of items ``(list, items)``."""
    lists = stored(found.select("items").distinct().withColumn("list", F.monotonically_increasing_id()), "items")
    return found.join(lists, "items").select("words", "key", "list"), lists


def spots(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` and windows -> ``(doc_id, text_hash, n_words, start, key, said)``.

    One row for each place where words have the hash of a window, and one with
    ``n_words`` alone for each row of ``docs``.
    """
    lengths = sorted(r[0] for r in found.select(F.size("words")).distinct().collect())
    # A-Z alone are lower-cased, here and in windows: what becomes of other letters can depend on their neighbours.
    told = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                       words(lower_ascii(F.col("text"))).alias("all"))
    at, size = F.col("start"), F.size("all")
    keys = {n: F.when(at + n <= size, _key(F.slice("all", at + 1, F.lit(n)))) for n in lengths or [1]}
    # The place behind the last word stands for the document itself, with the key 0.
    last = max(keys)
    keys[last] = F.when(at == size, F.lit(0)).otherwise(keys[last])
    probes = [F.struct(F.lit(n).alias("length"), key.alias("key")) for n, key in keys.items()]
    placed = told.select("*", F.explode(F.sequence(F.lit(0), size)).alias("start"))
    asked = placed.select("*", (F.explode(F.array(*probes)) if len(probes) > 1 else probes[0]).alias("probe"))
    blocks = 1 + (found.count() - 1) // max(KEYS_AT_LEAST, MAX_BROADCAST_BYTES // KEY_BYTES)
    sought = found.select("key").distinct()
    parts = []
    for block in range(max(1, blocks)):
        held = sought.filter(F.pmod("key", F.lit(blocks)) == block) if blocks > 1 else sought
        if block == 0:
            held = held.unionByName(held.sparkSession.range(1).select(F.lit(0).cast("long").alias("key")))
        met = asked.select("*", "probe.*").join(F.broadcast(held), "key", "left_semi").select(
            "doc_id", "text_hash", F.when(at == size, size).alias("n_words"), "start", "key",
            F.when(at < size, F.slice("all", at + 1, F.col("length"))).alias("said"))
        parts.append(stored(met, "spots"))
    return reduce(DataFrame.unionByName, parts)


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per distinct document: ``(doc_id, text_hash,
    copies, n_words, spans, items)``.

    ``spans`` are the (start, length) in words of all occurrences, ``items`` the
    ids found; ``copies`` tells how many rows are equal.
    """
    found = stored(windows(benchmark, width), "windows")
    numbered, lists = _numbered(found)
    near = spots(docs, found)
    same = F.col("said") == F.col("words")
    there = near.filter("said is not null").join(numbered, "key").filter(same).select(
        "doc_id", "text_hash", F.lit(None).cast("int").alias("n_words"),
        F.struct("start", F.size("said").alias("length")).alias("span"), "list")
    kinds = dict(there.dtypes)
    told = near.filter("n_words is not null").select(
        "doc_id", "text_hash", "n_words", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("span", "list")])
    by_document = told.unionByName(there).groupBy("doc_id", "text_hash").agg(
        F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("list").alias("lists"))
    listed = by_document.withColumn("list", F.explode_outer("lists")).join(lists, "list", "left")
    return listed.groupBy("doc_id", "text_hash").agg(
        *[F.first(c).alias(c) for c in ("copies", "n_words", "spans")],
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def covered(spans: Column) -> Column:
    """Number of words inside any of the sorted (start, length) spans."""
    nothing = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("total"))

    def add(state: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        fresh = F.greatest(F.lit(0), end - F.greatest(span["start"], state["upto"]))
        return F.struct(F.greatest(end, state["upto"]).alias("upto"), (state["total"] + fresh).alias("total"))

    return F.aggregate(spans, nothing, add, lambda state: state["total"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20) -> DataFrame:
    """``(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per document.

    A document is contaminated if at least one word in ``share`` is hit.
    """
    judged = (hits(docs, benchmark, width)
              .withColumn("n_hit", covered(F.col("spans")))
              .withColumn("n_words", F.col("n_words").cast("long")))
    return (judged.withColumn("n_items", F.size("items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "text_hash", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = (contamination(docs.select("doc_id", "text"), benchmark, width, share).filter("contaminated")
           .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (
        F.xxhash64("text") == F.col("_hash"))
    return docs.join(bad, same, "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with all hit words, and what separates them from the next word, cut from ``text``."""
    found = (hits(docs.select("doc_id", "text"), benchmark, width).filter(F.size("spans") > 0)
             .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (
        F.xxhash64("text") == F.col("_hash"))
    # What stands before, between and after the words.
    gaps = F.split("text", WORD)
    flat = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    kept = F.transform(words(F.col("text")), lambda w, i: F.when(
        F.array_contains(F.col("_hit"), i), F.lit("")).otherwise(F.concat(w, F.get(F.col("_gaps"), i + 1))))
    cut = F.concat(F.get(F.col("_gaps"), F.lit(0)), F.array_join(kept, ""))
    return (docs.join(found, same, "left").withColumn("_hit", F.array_distinct(flat)).withColumn("_gaps", gaps)
            .withColumn("text", F.when(F.col("_hash").isNotNull(), cut).otherwise(F.col("text")))
            .select(*docs.columns))
