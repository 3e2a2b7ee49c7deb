"""The language of a text by profiles of character trigrams, learnt from the documents that state one.

Stored codes are partly wrong, so the profiles are fitted twice: the second time without documents whose text is likelier under another
profile. A text gets a language if its trigrams are, on average, likelier by ``margin`` than under the second profile and not much less likely than the
language's own texts are; else it has none (null), and a stored code may stand. So a text of a language without a profile isn't taken for a neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.llm.shingles import mix
from loamworks.session import bounded_sample, bounded_texts

#: Frequent function words of each language that the others lack or rarely have.
WORDS = {
    "en": "the and of is was to in that it with for are were they this from by which has had not be on at their we you",
    "de": "der die das und ist nicht ein eine zu den von mit dem sich auf für im des es wird sind aus bei wenn nach vor",
    "fr": "le la les et est des une du dans que qui pas pour sur avec au il elle sont par ce ne se mais plus chez",
    "es": "el la los las y es una del que en por con para no se su al lo como más pero son está hay mi muy",
}


@dataclass(frozen=True)
class LanguageConfig:
    """``documents`` and ``text_bytes``: the most that profiles are learnt from. ``least``: documents that a language needs for a profile.

    ``bits``: of a trigram's hash. ``margin``: nats a trigram. ``slack``: a text may be so many nats a trigram below all but one in a hundred of its language's texts.
    """

    documents: int = 2000
    text_bytes: int = 10_000_000
    least: int = 15
    bits: int = 16
    margin: float = 0.3
    slack: float = 0.3


def clean_language(c: Column) -> Column:
    """The two letters of a stored language code, or null."""
    code = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.nullif(code, F.lit(""))


_LETTER: np.ndarray | None = None


def trigrams(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of three characters, anything but letters as one blank, and their number in each text."""
    global _LETTER
    if _LETTER is None:  # beyond these all characters count as letters
        _LETTER = np.append([chr(k).isalpha() for k in range(0x3000)], True)
    joined = "".join(f" {t.lower()} " if t else "  " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t.lower()) + 2 if t else 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), size)
    points = np.where(_LETTER[np.minimum(points, np.uint64(0x3000)).astype(np.int64)], points, np.uint64(32))
    # of a run of blanks one is kept
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32) | (owner[1:] != owner[:-1])
    points, owner = points[keep], owner[keep]
    if len(points) < 3:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    code = mix(points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9))
    whole = owner[:-2] == owner[2:]
    return (code[whole] >> np.uint64(64 - bits)).astype(np.int64), np.bincount(owner[:-2][whole], minlength=len(texts))


@dataclass(frozen=True)
class LanguageModel:
    """``table``: log chance of each trigram under each language; ``floor``: the least mean that a text of the language may have."""

    names: tuple[str, ...]
    table: np.ndarray
    floor: np.ndarray
    config: LanguageConfig

    def means(self, texts: list[str | None]) -> np.ndarray:
        codes, counts = trigrams(texts, self.config.bits)
        owner = np.repeat(np.arange(len(texts)), counts)
        sums = np.stack([np.bincount(owner, column[codes], len(texts)) for column in self.table], axis=1)
        return sums / np.where(counts > 0, counts, np.nan)[:, None]

    def guess(self, texts: list[str | None]) -> list[str | None]:
        """The language of each text, or None."""
        if not self.names:
            return [None] * len(texts)
        mean = self.means(texts)
        order = np.sort(mean, axis=1)
        best = np.argmax(np.nan_to_num(mean, nan=-np.inf), axis=1)
        lead = order[:, -1] - order[:, -2] if len(self.names) > 1 else np.full(len(mean), np.inf)
        # NaN (no letters) fails both
        sure = (lead >= self.config.margin) & (mean[np.arange(len(mean)), best] >= self.floor[best])
        return [self.names[b] if s else None for b, s in zip(best.tolist(), sure.tolist(), strict=True)]


def train(texts: list[str], codes: list[str], config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Profiles of the languages that at least ``config.least`` texts state."""
    known, n = np.unique(np.array(codes, dtype=object).astype(str), return_counts=True) if codes else (np.empty(0, str), np.empty(0, int))
    names = tuple(known[n >= config.least].tolist())
    number = {c: k for k, c in enumerate(names)}
    label = np.array([number.get(c, -1) for c in codes], np.int64)
    if not names:
        return LanguageModel((), np.zeros((0, 1), np.float32), np.zeros(0), config)
    grams, counts = trigrams(texts, config.bits)
    owner = np.repeat(np.arange(len(texts)), counts)

    def fit(label: np.ndarray) -> np.ndarray:
        table = np.empty((len(names), 2**config.bits), np.float32)
        for k in range(len(names)):
            n = np.bincount(grams[label[owner] == k], minlength=2**config.bits) + 0.1
            table[k] = np.log(n / n.sum())
        return table

    model = LanguageModel(names, fit(label), np.full(len(names), -np.inf), config)
    mean = model.means(texts)
    agree = np.where((label >= 0) & (np.nan_to_num(mean, nan=-np.inf).argmax(axis=1) == label), label, -1)
    model = LanguageModel(names, fit(agree), model.floor, config)
    mean = model.means(texts)
    own = [mean[agree == k, k] for k in range(len(names))]
    floor = np.array([np.quantile(x, 0.01) - config.slack if len(x) else -np.inf for x in own])
    return LanguageModel(names, model.table, floor, config)


def fit_language_model(documents: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Learn from about ``config.documents`` documents and ``config.text_bytes`` of text at most, chosen by hashes of their id."""
    texts = bounded_sample(documents.select("doc_id", "text", clean_language(F.col("lang")).alias("code")), "doc_id", config.documents, documents.count())
    rows = bounded_texts(texts.where("code IS NOT NULL AND length(trim(text)) > 0"), "doc_id", "text", config.text_bytes).toPandas().sort_values("doc_id")
    return train(rows.text.tolist(), rows.code.tolist(), config)
