"""Rules for natural text: twelve scores per document, and a filter that all enabled rules must pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.functions.text import SPACE, computed_once, count_chars, lines, words


@dataclass(frozen=True)
class QualityConfig:
    max_word_rep: float = 0.2
    max_line_rep: float = 0.3
    max_paragraph_rep: float = 0.3
    max_char_rep: float = 0.2
    min_words: int = 50
    max_words: int = 100_000
    min_avg_word_length: float = 3.0
    max_avg_word_length: float = 10.0
    min_sentence_end: float = 0.1
    max_ellipsis: float = 0.1
    max_bullet: float = 0.9
    max_curly_brace: float = 0.05
    max_digit_ratio: float = 0.3
    min_alpha_ratio: float = 0.6
    rules: tuple[str, ...] = ()


RULES = (
    "word_rep", "line_rep", "char_rep", "min_words", "max_words", "avg_word_length",
    "sentence_end", "ellipsis", "bullet", "curly_brace", "digit_ratio", "alpha_ratio",
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def most_frequent_count(items: Column) -> Column:
    """How often the most frequent item of an array occurs: the longest run once sorted, without a shuffle."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sort_array(items), start, step)["best"]


def _share(kept: Column, all_: Column) -> Column:
    return _ratio(F.size(kept), F.size(all_))


def score_columns(text: Column, w: Column, ls: Column) -> dict[str, Column]:
    """Score of each rule from the text, its words and its lines that are not blank."""
    n, length = F.size(w), F.length(text)
    runs = F.regexp_count(text, F.lit(r"([^\n])\1{9,}"))
    return {
        "word_rep": F.when(n < 10, F.lit(0.0)).otherwise(_ratio(most_frequent_count(w), n)),
        "line_rep": F.when(F.size(ls) < 3, F.lit(0.0)).otherwise(_ratio(F.size(ls) - F.size(F.array_distinct(ls)), F.size(ls))),
        "char_rep": F.when(length < 100, F.lit(0.0)).otherwise(_ratio(runs * 10, length)),
        "min_words": n.cast("double"),
        "max_words": n.cast("double"),
        "avg_word_length": _ratio(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), n),
        "sentence_end": _share(F.filter(ls, lambda x: x.rlike(rf"[.!?][{SPACE}]*\z")), ls),
        "ellipsis": _share(F.filter(ls, lambda x: x.contains("...") | x.contains("…")), ls),
        "bullet": _share(F.filter(ls, lambda x: x.rlike(rf"^[{SPACE}]*[-*•◦▪▸►]")), ls),
        "curly_brace": _ratio(length - F.length(F.translate(text, "{}", "")), length),
        "digit_ratio": _ratio(count_chars(text, r"\p{Nd}"), length),
        "alpha_ratio": _ratio(count_chars(text, r"\p{L}"), length),
    }


def _passes(c: QualityConfig, s: Column, n_lines: Column) -> dict[str, Column]:
    return {
        "word_rep": s["word_rep"] <= c.max_word_rep,
        "line_rep": s["line_rep"] <= c.max_line_rep,
        "char_rep": s["char_rep"] <= c.max_char_rep,
        "min_words": s["min_words"] >= c.min_words,
        "max_words": s["max_words"] <= c.max_words,
        "avg_word_length": (s["min_words"] == 0) | s["avg_word_length"].between(c.min_avg_word_length, c.max_avg_word_length),
        "sentence_end": (n_lines == 0) | (s["sentence_end"] >= c.min_sentence_end),
        "ellipsis": s["ellipsis"] <= c.max_ellipsis,
        "bullet": s["bullet"] <= c.max_bullet,
        "curly_brace": s["curly_brace"] <= c.max_curly_brace,
        "digit_ratio": s["digit_ratio"] <= c.max_digit_ratio,
        "alpha_ratio": (s["length"] == 0) | (s["alpha_ratio"] >= c.min_alpha_ratio),
    }


def with_quality(df: DataFrame, config: QualityConfig = QualityConfig(), text: str = "text") -> DataFrame:
    """Add ``quality_scores`` (a struct of all twelve) and ``quality_failed`` (names of the enabled rules it fails).

    Unknown rule names are an error. A null text scores like an empty one.
    """
    enabled = config.rules or RULES
    if unknown := set(enabled) - set(RULES):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_words", words(body)).withColumn("_lines", lines(body))
    scores = score_columns(body, F.col("_words"), F.col("_lines"))
    out = computed_once(out, "_s", F.struct(*[c.alias(k) for k, c in scores.items()], F.length(body).alias("length"), F.size("_lines").alias("n_lines")))
    ok = _passes(config, F.col("_s"), F.col("_s.n_lines"))
    failed = F.filter(F.array(*[F.when(~ok[r], F.lit(r)) for r in RULES if r in enabled]), lambda x: x.isNotNull())
    return out.withColumn("quality_failed", failed).withColumn("quality_scores", F.struct(*[F.col(f"_s.{r}").alias(r) for r in RULES])).drop("_words", "_lines", "_s")


def quality_filter(df: DataFrame, config: QualityConfig = QualityConfig(), text: str = "text") -> DataFrame:
    """Keep the documents that fail no enabled rule, with their scores."""
    return with_quality(df, config, text).where(F.size("quality_failed") == 0)


def mean_quality(scores: str = "quality_scores", rules: tuple[str, ...] = ()) -> Column:
    """Mean of the scores of the enabled rules (none named: all twelve); word counts take part as they are, once for each rule that uses them."""
    rules = rules or RULES
    return sum((F.col(f"{scores}.{r}") for r in rules), F.lit(0.0)) / len(rules)


def paragraph_repetition(text: Column) -> Column:
    """Share of paragraphs (between blank lines) that repeat an earlier one; 0 for fewer than three."""
    parts = F.filter(F.split(text, rf"\n[{SPACE}]*\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return F.when(F.size(parts) < 3, F.lit(0.0)).otherwise(_ratio(F.size(parts) - F.size(F.array_distinct(parts)), F.size(parts)))


def length_filter(df: DataFrame, low: int = 0, high: int = 2**31 - 1, text: str = "text") -> DataFrame:
    """Keep texts whose number of words is in a range, both ends included."""
    return df.where(F.size(words(F.coalesce(F.col(text), F.lit("")))).between(low, high))


#: The score of each label.
LABEL_SCORES = {"high": 0.9, "medium": 0.5, "low": 0.2}


def label_quality_filter(df: DataFrame, threshold: float, label: str = "quality_label") -> DataFrame:
    """Keep rows whose label stands for at least ``threshold``; an unknown or null label counts as medium."""
    table = F.create_map(*[F.lit(x) for kv in LABEL_SCORES.items() for x in kv])
    return df.where(F.coalesce(F.try_element_at(table, F.lower(F.col(label))), F.lit(LABEL_SCORES["medium"])) >= threshold)
