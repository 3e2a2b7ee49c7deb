"""Row-wise annotations: language, token counts, sampling weights, generic maps and filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.functions.text import bound, computed_once, words

#: Frequent function words by language, for the scorer that needs no model.
STOP_WORDS = {
    "en": "the and of is was to in that it with for are",
    "de": "der die das und ist nicht ein zu den von mit im",
    "fr": "le la les et est des une du dans que pas au",
    "es": "el la los y es una del que en por con se",
}


def _count_in(tokens: Column, known: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(known)))


def stop_word_language(text: Column) -> Column:
    """Struct of language and score: the language of most stop words, and its share of all stop words found.

    Blank text, and text without any of them, is ``unknown`` with score 0.
    """
    tokens = words(F.lower(F.coalesce(text, F.lit(""))))
    counts = bound(tokens, lambda t: F.array(*[F.struct(_count_in(t, s.split()).alias("n"), F.lit(lang).alias("lang")) for lang, s in STOP_WORDS.items()]))

    def judge(scored: Column) -> Column:
        best = F.array_max(scored)
        total = F.aggregate(scored, F.lit(0), lambda a, x: a + x["n"])
        score = F.when(total > 0, F.round(best["n"] / total, 4)).otherwise(F.lit(0.0))
        return F.struct(F.when(total > 0, best["lang"]).otherwise(F.lit("unknown")).alias("language"), score.alias("language_score"))

    return bound(counts, judge)


def with_language(df: DataFrame, scorer: Callable[[Column], Column] = stop_word_language, text: str = "text") -> DataFrame:
    """Add ``language`` and ``language_score`` (4 decimals) by a scorer that returns a struct of both."""
    out = computed_once(df, "_l", scorer(F.col(text)))
    return out.withColumn("language", F.col("_l.language")).withColumn("language_score", F.round("_l.language_score", 4)).drop("_l")


def language_filter(df: DataFrame, target: str = "en", least: float = 0.65, reason: bool = False) -> DataFrame:
    """Keep documents of the target language whose score (missing: 0) is high enough; or mark why others go."""
    other, low = ~F.col("language").eqNullSafe(F.lit(target)), F.coalesce("language_score", F.lit(0.0)) < least
    if reason:
        return df.withColumn("reject_reason", F.when(other, F.concat(F.lit("language:"), F.coalesce("language", F.lit("unknown")))).when(low, F.lit("low_language_score")))
    return df.where(~other & ~low)


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("bigint")


def with_token_count(df: DataFrame, counter: Callable[[Column], Column] = word_count, text: str = "text") -> DataFrame:
    """Add ``token_count`` by any counter of a text column; by default words."""
    return df.withColumn("token_count", counter(F.col(text)))


def apply_filter(df: DataFrame, condition: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Keep the rows for which a condition holds; null does not."""
    return df.where(condition(df) if callable(condition) else condition)


def apply_map(df: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return df.transform(f)


def observed(df: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """Pass rows through and count them (and other aggregates) on the way."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *metrics)


def to_document(df: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """``id, text, metadata``: all other columns as one JSON object."""
    rest = [c for c in df.columns if c not in (id_col, text)]
    meta = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), meta.alias("metadata"))


def from_document(df: DataFrame, schema: str) -> DataFrame:
    """The inverse of ``to_document`` for a known metadata schema."""
    return df.withColumn("_m", F.from_json("metadata", schema)).select("id", "text", "_m.*")
