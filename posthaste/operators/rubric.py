"""The question rubric and checks of answers against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posthaste import schemas
from posthaste.functions import text

# The questions put to a scorer. ``criteria`` is a map of named
# options, or the list of levels of a score from low to high.
QUESTIONS = {
  "ragebait": {
    "type": "noul",
    "instructions": "Classify this post as ragebait only if its primary purpose appears to be provoking anger or outrage rather than informing, expressing a personal experience, or stating an opinion. Do not classify a post as ragebait merely because its subject matter is disturbing, controversial, political, or emotionally charged.",
    "criteria": {
      "true": "The post uses inflammatory editorializing, mocking or insulting language, slurs, deliberately exaggerated framing, unsupported sweeping claims, or other rhetorical techniques whose apparent purpose is to provoke anger or outrage. The inflammatory framing must be directed toward provoking a reaction, not merely describing an event",
      "false": "The post reports an event, summarizes a claim or news story, describes a personal experience, or expresses an opinion—even when the subject is controversial, offensive, disturbing, or emotionally charged—provided it does not add clear inflammatory editorializing, unsupported generalizations, or deliberate outrage-baiting framing."
    }
  },
  "controversial": {
    "type": "noul",
    "instructions": "Does this post address a polarizing, sensitive, or high-stakes topic in a way that naturally invites split opinions or intense debate, regardless of whether the author is intentionally provoking anger?",
    "criteria": {
      "true": "The content taps into a debate-heavy, polarizing, or sensitive topic likely to divide readers and generate high engagement through opposing viewpoints, including both earnest debate and intentional ragebait.",
      "false": "The post expresses a widely accepted view, a neutral factual observation, or a non-contentious personal statement that is unlikely to trigger significant disagreement or divided commentary."
    }
  },
  "time_sensitivity": {
    "type": "score",
    "instructions": "How dependent is this post's meaning or interpretability on the time in which it was posted? Judge whether a reader encountering the post without its original temporal context could still understand what it means, not whether the topic itself will remain relevant or interesting.",
    "criteria": [
      "Timeless: The post's meaning is essentially independent of when it was posted. A reader years later could understand it without knowing the original date or current events.",
      "Low: The post contains minor references to current events, trends, or circumstances, but its meaning remains mostly understandable without knowing when it was posted.",
      "Moderate: Understanding the post reasonably well requires some awareness of the period in which it was written, such as a contemporary event, trend, ongoing situation, or cultural moment.",
      "High: The post depends heavily on its original temporal context. Without knowing what was happening around the time it was posted, its meaning, implication, or reference would be difficult to understand.",
      "Ephemeral: The post is strongly tied to a moment-specific event, live situation, breaking news, reaction, trend, or rapidly changing circumstance and may become substantially unintelligible without the original context."
    ]
  },
  "nicheness": {
    "type": "score",
    "instructions": "How much specialized knowledge, cultural familiarity, community membership, or domain-specific context is required to understand the post's meaning or intended reference? Judge the accessibility of the post itself, not whether the underlying topic is popular.",
    "criteria": [
      "Broadly accessible: Most people can understand the post's meaning without specialized knowledge or familiarity with a particular community, hobby, profession, or subculture.",
      "Somewhat specialized: Most people can understand the general meaning, but familiarity with a particular interest, cultural reference, or common online context would improve comprehension.",
      "Niche: The post is primarily understandable to people familiar with a particular community, hobby, fandom, profession, game, platform culture, or specialized topic.",
      "Highly niche: Understanding the intended meaning or reference requires substantial specialized knowledge or familiarity with a specific community, subculture, technical field, or ongoing inside discussion.",
      "Extremely niche: The post is effectively directed at a very small or specialized audience and would be difficult to interpret correctly without insider knowledge or highly specific context."
    ]
  },
  "emotional_intensity": {
    "type": "score",
    "instructions": "How emotionally charged is the language of the post, regardless of whether the author is intentionally trying to provoke the reader?",
    "criteria": [
      "Neutral: Little or no emotionally charged language.",
      "Mild: Contains limited emotional language, but the overall tone remains restrained.",
      "Moderate: Noticeably emotional, with clear expressions of enthusiasm, frustration, sadness, anger, disgust, excitement, or similar emotion.",
      "High: Strong emotional language, emphatic wording, insults, profanity, or dramatic expression is prominent throughout the post.",
      "Extreme: The post is overwhelmingly emotionally charged, highly aggressive, explosive, or intensely expressive."
    ]
  },
  "content_type": {
    "type": "choice",
    "instructions": "What is the primary communicative function of the post?",
    "criteria": {
      "factual_report": "Primarily reports or describes an event, observation, or information.",
      "claim": "Primarily makes a factual or causal claim that could in principle be evaluated as true or false.",
      "opinion": "Primarily expresses a subjective judgment, preference, belief, or evaluation.",
      "personal_experience": "Primarily describes the author's own experience, feelings, or circumstances.",
      "question": "Primarily asks a question or solicits information rather than making a substantive claim.",
      "humor_or_entertainment": "Primarily attempts to entertain, joke, parody, or amuse rather than communicate a serious claim or opinion.",
      "other": "Does not fit the other categories clearly."
    }
  },
  "context_dependence": {
    "type": "score",
    "instructions": "How much external context is required to correctly understand the meaning or intended implication of the post?",
    "criteria": [
      "Self-contained: The post can be understood accurately on its own.",
      "Minor context: Some additional context would improve understanding, but the main meaning is clear.",
      "Moderate context: External information is needed to fully understand the reference, implication, or situation being discussed.",
      "High context: The post is difficult to interpret correctly without substantial knowledge of an external event, conversation, media, or preceding content.",
      "Extreme context: The post is largely unintelligible or highly ambiguous without very specific external context."
    ]
  },
  "rhetorical_target": {
    "type": "choice",
    "instructions": "Who or what is the post primarily directing its criticism, praise, mockery, or other rhetoric toward?",
    "criteria": {
      "none": "The post does not have a clear rhetorical target.",
      "individual": "A specific identifiable person is the primary target.",
      "group": "A demographic, social, political, professional, cultural, or other group is the primary target.",
      "organization": "A company, institution, government, media outlet, team, community, or other organization is the primary target.",
      "product_or_work": "A product, service, piece of media, game, artwork, or other specific work is the primary target.",
      "abstract_issue": "An idea, policy, behavior, event, phenomenon, or abstract concept is the primary target.",
      "multiple": "The post targets multiple distinct entities without one clearly being primary."
    }
  },
  "generalization": {
    "type": "score",
    "instructions": "How broadly does the post generalize beyond the specific person, event, or situation being discussed?",
    "criteria": [
      "Specific: The statement is limited to a particular person, event, situation, or clearly defined example.",
      "Limited generalization: The post makes a modest generalization but retains meaningful qualifications or limitations.",
      "Broad: The post generalizes across a substantial category of people, events, or situations.",
      "Sweeping: The post makes a broad, categorical, or absolute claim about a large group or class with little qualification.",
      "Extreme: The post makes an exceptionally broad or absolute generalization that reduces a complex subject to a simplistic categorical claim."
    ]
  },
  "sarcasm_irony": {
    "type": "score",
    "instructions": "To what extent does the post rely on sarcasm, irony, parody, or deliberately non-literal language to communicate its intended meaning?",
    "criteria": [
      "None: The post is substantially literal and does not rely on sarcasm or irony.",
      "Possible: The wording contains mild or ambiguous ironic elements, but the intended meaning remains substantially literal.",
      "Present: Sarcasm or irony is clearly used as part of the post's communication.",
      "Strong: Understanding the intended meaning requires recognizing substantial sarcasm, irony, parody, or deliberate reversal of the literal wording.",
      "Essential: The post's intended meaning is primarily dependent on interpreting its language non-literally."
    ]
  }
}

NOUL = [q for q, v in QUESTIONS.items() if v["type"] == "noul"]
SCORES = [q for q, v in QUESTIONS.items() if v["type"] == "score"]
CHOICES = [q for q, v in QUESTIONS.items() if v["type"] == "choice"]
NUMERIC = [q for q in QUESTIONS if q not in CHOICES]

SCHEMA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("instructions", T.StringType()),
    T.StructField("levels", T.ArrayType(T.StringType())),
    T.StructField("choices", T.MapType(T.StringType(), T.StringType())),
])


def rubric(spark: SparkSession) -> DataFrame:
    """One row per question."""
    rows = [(q, v["type"], v["instructions"],
             v["criteria"] if v["type"] == "score" else None,
             None if v["type"] == "score" else v["criteria"])
            for q, v in QUESTIONS.items()]
    return spark.createDataFrame(rows, SCHEMA)


def rubric_options(questions: DataFrame) -> DataFrame:
    """One row per option: levels by number, named options by name."""
    levels = questions.select("question", "type", F.posexplode("levels").alias("option_pos", "description"))
    named = questions.select("question", "type", F.posexplode("choices").alias("option_pos", "option_key", "description"))
    return (levels.withColumn("option_key", F.col("option_pos").cast("string"))
            .unionByName(named)
            .select("question", "type", "option_pos", "option_key", "description"))


def reply_json(answers: DataFrame) -> Column:
    """The nested reply, as JSON text, that the flat answer columns stand for."""
    def answer(question: str) -> list[Column]:
        kind = QUESTIONS[question]["type"]
        return [F.lit(question), F.struct(*[
            (F.col(question) if kind == name else F.lit(None)).cast(t).alias(name)
            for name, t in (("noul", "double"), ("score", "double"), ("choice", "string"))])]
    return F.to_json(F.struct(
        F.struct("input_tokens", "output_tokens").alias("usage"),
        F.create_map(*[c for q in QUESTIONS for c in answer(q)]).alias("answers")))


def flatten_answers(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Nested reply to two usage and ten answer columns; a bad reply gives NULLs."""
    parsed = df.withColumn("_r", F.from_json(F.col(reply), schemas.REPLY))
    usage = [F.col(f"_r.usage.{c}").alias(c) for c in ("input_tokens", "output_tokens")]
    answers = [F.col("_r.answers").getItem(q).getField(v["type"]).alias(q) for q, v in QUESTIONS.items()]
    return parsed.select(*[c for c in df.columns if c != reply], *usage, *answers)


def unpivot_answers(df: DataFrame) -> DataFrame:
    """(ord, question, number, choice): one row per answer."""
    pairs = [F.struct(F.lit(q).alias("question"),
                      (F.lit(None) if q in CHOICES else F.col(q)).cast("double").alias("number"),
                      (F.col(q) if q in CHOICES else F.lit(None)).cast("string").alias("choice"))
             for q in QUESTIONS]
    return df.select("ord", F.inline(F.array(*pairs)))


def validate_answers(df: DataFrame, options: DataFrame,
                     noul_range: tuple[float, float] = (0.0, 1.0),
                     first_level: float = 0.0) -> DataFrame:
    """Per question: answers, missing ones, unknown choices, numbers out of bounds.

    A score may lie between ``first_level`` and the last level counted from it.
    """
    # At most one row per question of the rubric, whatever frame the caller gives.
    domain = options.filter(F.col("question").isin(list(QUESTIONS))).groupBy("question", "type").agg(
        F.collect_set("option_key").alias("keys"), F.count("*").alias("n_options"))
    low = F.when(F.col("type") == "noul", noul_range[0]).otherwise(first_level)
    high = F.when(F.col("type") == "noul", noul_range[1]).otherwise(first_level + F.col("n_options") - 1)
    is_choice = F.col("type") == "choice"
    missing = F.when(is_choice, F.col("choice").isNull()).otherwise(text.is_missing(F.col("number")))
    return (unpivot_answers(df).join(F.broadcast(domain), "question", "left")
            .groupBy("question").agg(
                F.count("*").alias("answers"),
                F.count_if(missing).alias("missing"),
                F.count_if(is_choice & ~missing & ~F.array_contains("keys", F.col("choice")))
                .alias("unknown_choice"),
                F.count_if(~is_choice & ~missing & ~F.col("number").between(low, high))
                .alias("out_of_bounds")))


def answer_distribution(df: DataFrame, options: DataFrame, first_level: int = 0) -> DataFrame:
    """Answers per option, 0 for options nobody chose.

    A numeric answer counts for the nearest level; a noul for 'true' from 0.5.
    """
    level = F.round(F.col("number") - F.lit(first_level)).cast("long").cast("string")
    given = (unpivot_answers(df)
             .filter(F.col("choice").isNotNull() | ~text.is_missing(F.col("number")))
             .withColumn("option_key",
                         F.when(F.col("question").isin(NOUL),
                                F.when(F.col("number") >= 0.5, "true").otherwise("false"))
                         .when(F.col("question").isin(CHOICES), F.col("choice")).otherwise(level))
             .groupBy("question", "option_key").agg(F.count("*").alias("n")))
    return (options.select("question", "option_key").join(given, ["question", "option_key"], "left")
            .select("question", "option_key", F.coalesce("n", F.lit(0)).alias("answers")))
