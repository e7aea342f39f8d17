"""The search predicate: posts that contain a keyword.

Joins, whatever the number of keywords; neither table passes through the
driver. Texts are sets of tokens, what stands between blanks. The distinct
tokens of all posts, far fewer than their characters, meet the keywords first:
a keyword without a blank is found where a token contains it, and one with
blanks may be where a token contains its longest part. Tokens and parts meet by
an anchor, a run of at most ``ANCHOR`` characters that the fewest tokens have.
Posts then join the tokens that met, and only keywords with blanks, and of
these only those that would come first, are looked for in whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthaste.operators.filters import CandidateRules, in_window
from posthaste.sources.tables import stored

# Characters of an anchor; a shorter part is its own anchor.
ANCHOR = 4


def keyword_candidates(posts: DataFrame, keywords: DataFrame,
                       rules: CandidateRules = CandidateRules(), lang: str = "en",
                       strategy: str | None = None) -> DataFrame:
    """Posts a search for the keywords would return.

    Plain tests come first: language, likes of at least a third of the wanted
    engagement, dates. ``query_source`` is the keyword with the lowest
    ``kw_id`` that occurs in the text, case ignored; equal ids go by the
    keyword, a NULL id comes last. Empty and NULL keywords find nothing.
    ``keywords`` has (kw_id, keyword); posts need no key. Spark chooses how
    tokens meet by their number unless ``strategy`` names a join hint.
    """
    coarse = in_window(posts.drop("query_source"), rules.start, rules.end).filter(
        (F.col("lang") == lang) & (F.col("likes") >= rules.min_engagement // 3))
    # Every text has the empty token, where keywords of blanks alone are looked for.
    split = F.array_distinct(F.concat(F.split(F.lower("text"), " "), F.array(F.lit(""))))
    # Stored with a number for each post, so that no recomputed task deals other numbers.
    rows = stored(coarse.withColumns({"_post": F.monotonically_increasing_id(), "_tokens": split}), "posts")
    lowered = rows.select("_post", F.lower("text").alias("_text"))
    tokens = rows.select("_post", F.explode("_tokens").alias("token"))
    met = stored(_met(tokens.select("token").distinct(), _parts(keywords), strategy), "met")

    def joined(found: DataFrame) -> DataFrame:
        return tokens.join(found.hint(strategy) if strategy else found, "token")

    certain = met.filter("certain").groupBy("token").agg(F.min("first").alias("first"))
    sure = stored(joined(certain).groupBy("_post").agg(F.min("first").alias("_sure")), "sure")
    possible = met.filter("not certain").select("token", "needle", "first")
    verified = (joined(possible).drop("token").distinct().join(sure, "_post", "left")
                .filter(F.col("_sure").isNull() | (F.col("first") < F.col("_sure")))
                .join(lowered, "_post").filter(F.col("_text").contains(F.col("needle"))).select("_post", "first"))
    best = (verified.unionByName(sure.withColumnRenamed("_sure", "first"))
            .groupBy("_post").agg(F.min("first").alias("_best")))
    return (rows.drop("_tokens").join(best, "_post").withColumn("query_source", F.col("_best.keyword"))
            .select(*coarse.columns, "query_source"))


def _parts(keywords: DataFrame) -> DataFrame:
    """Distinct keywords in lower case, each with the first of its ids and
    spellings, its longest part and whether it is that part."""
    first = F.min(F.struct(F.col("kw_id").isNull().alias("unnumbered"), F.col("kw_id").cast("long").alias("kw_id"),
                           "keyword")).alias("first")
    longest = F.array_max(F.transform(F.split("needle", " "), lambda p: F.struct(F.length(p).alias("n"), p.alias("part"))))
    needles = (keywords.withColumn("needle", F.lower("keyword")).filter(F.length("needle") > 0)
               .groupBy("needle").agg(first))
    return needles.select("needle", "first", longest["part"].alias("part")).withColumn(
        "certain", F.col("part") == F.col("needle"))


def _runs(text: str, lengths: list[int]) -> Column:
    """The runs of so many characters: a look-ahead at every place, in one pass for each length."""
    runs = [F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1) for n in lengths if n > 0]
    return F.array_distinct(F.concat(F.array(F.lit("")), *runs) if 0 in lengths else F.concat(*runs))


def _met(vocabulary: DataFrame, parts: DataFrame, strategy: str | None) -> DataFrame:
    """``(token, needle, first, certain)``: tokens that contain the longest part of a keyword."""
    parts = stored(parts, "keywords")
    # At most ANCHOR + 1 lengths.
    lengths = sorted(r[0] for r in parts.select(F.least(F.length("part"), F.lit(ANCHOR))).distinct().collect())
    if not lengths:
        return parts.select(F.col("part").alias("token"), "needle", "first", "certain")
    found = stored(vocabulary.select("token", F.explode(_runs("token", lengths)).alias("run")), "runs")
    seen = found.groupBy("run").agg(F.count("*").alias("tokens"))
    own = F.when(F.length("part") > ANCHOR, _runs("part", [ANCHOR])).otherwise(F.array("part"))
    # A part of which some run is in no token is in none either.
    anchored = (parts.withColumn("run", F.explode(own)).join(seen, "run", "left")
                .groupBy("needle").agg(*[F.first(c).alias(c) for c in ("first", "part", "certain")],
                                       F.min_by("run", F.struct(F.coalesce("tokens", F.lit(0)), "run")).alias("run")))
    return (found.join(anchored.hint(strategy) if strategy else anchored, "run")
            .filter(F.col("token").contains(F.col("part")) & ((F.length("part") > 0) | (F.length("token") == 0)))
            .select("token", "needle", "first", "certain"))
