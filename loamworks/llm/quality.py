"""Statistics of words, symbols and lines, and which part of a text is running prose.

Every line gets one of the labels prose, list, table and junk from a hidden Markov model over line statistics. The
labels' shares of a document's characters (without blanks) tell whether most of it is prose.

The model is trained here: rules label the clearest lines of a bounded sample of documents (``TrainConfig``), the
counts of labels, their succession and the statistics under each label give the first model, and a few rounds of relabelling
by the model itself (Viterbi) the final one. Ratings of the sample's documents, by majority and in any case, then
choose the share of other labels above which a document isn't prose; without usable ratings it is one half.

Null texts have null statistics, empty and blank ones zeros, and neither is ever reported as other than prose.
Whole texts are read. Statistics are computed for every row, repeated ones too; columns not named are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.llm.batches import pieces
from loamworks.llm.language import WORDS
from loamworks.llm.shingles import mix, word_ids
from loamworks.session import bounded_sample, bounded_texts

LABELS = ("prose", "list", "table", "junk")
#: Hidden states; ECHO is prose said again and again, and is reported as junk.
PROSE, LIST, TABLE, JUNK, ECHO = range(5)
STATES, _REPORTED = 5, np.array([PROSE, LIST, TABLE, JUNK, JUNK])
#: Articles stand before the nouns of lists and tables too, so they say nothing.
_ARTICLES = frozenset("the a an der die das ein eine el la los las un una le les une".split())
_COMMON = (frozenset(" ".join(WORDS.values()).split()) | frozenset("as but or if i he she my than who what when into so".split())) - _ARTICLES
_BULLETS = "-*•–—+·▪◦‣>"
_SEPARATORS = "|\t;,=/:>"
_TOP = 0x2600
_LETTER, _VOWEL, _DIGIT, _SPACE, _SYMBOL, _SEPARATOR, _STOP, _UPPER = (1 << k for k in range(8))


def _classes() -> np.ndarray:
    """Bits of each code point's classes; the last entry stands for all beyond."""
    out = np.zeros(_TOP + 1, np.uint16)
    for k in range(_TOP):
        c = chr(k)
        kind = unicodedata.category(c)
        base = unicodedata.normalize("NFD", c.lower())[:1]
        out[k] = (
            _LETTER * (kind[0] == "L") | _VOWEL * (kind[0] == "L" and base in "aeiouyæœ") | _DIGIT * (kind == "Nd") | _SPACE * c.isspace()
            | _SYMBOL * (kind[0] in "PSC" and not c.isspace() and c not in ".,!?'’\"") | _SEPARATOR * (c in _SEPARATORS) | _STOP * (c in ".!?…") | _UPPER * c.isupper()
        )
    out[_TOP] = _SYMBOL
    return out


_TABLE: np.ndarray | None = None
_STRIP = ".,;:!?…\"'«»()¿¡"
_SEEN: dict[frozenset, dict[str, bool]] = {}

#: Edges of the bins of each statistic of a line.
BINS = (
    ("words", (0.5, 2.5, 4.5, 7.5, 14.5)),
    ("common", (0.01, 0.08, 0.16, 0.25, 0.4)),
    ("known", (0.05, 0.2, 0.35, 0.5, 0.65, 0.8)),
    ("symbols", (0.005, 0.02, 0.05, 0.12, 0.3)),
    ("digits", (0.005, 0.03, 0.1, 0.3)),
    ("separators", (0.01, 0.1, 0.25, 0.5, 1.0)),
    ("gaps", (0.01, 0.15)),
    ("vowels", (0.05, 0.2, 0.3, 0.5)),
    ("length", (3.0, 4.0, 6.0, 8.0, 11.0)),
    ("repeated", (0.01, 0.3, 0.7)),
    ("first", (0.5, 1.5, 2.5, 3.5)),
    ("last", (0.5, 1.5)),
)
_REPEATED = [name for name, _ in BINS].index("repeated")
SIZES = tuple(len(edges) + 1 for _, edges in BINS)


@dataclass
class Lines:
    """The non-blank lines of a batch: owner (row), weight (characters without blanks), statistics."""

    owner: np.ndarray
    weight: np.ndarray
    values: np.ndarray
    documents: dict[str, np.ndarray]

    @property
    def codes(self) -> np.ndarray:
        return np.stack([np.searchsorted(np.array(e), self.values[:, k], side="right") for k, (_, e) in enumerate(BINS)], axis=1).astype(np.int8)


def _in(words: list[str], group: frozenset) -> np.ndarray:
    """Whether each word, without punctuation around it, is in the group; a worker remembers what it has seen."""
    seen = _SEEN.setdefault(group, {})
    if len(seen) > 1_000_000:
        seen.clear()
    try:
        return np.fromiter(map(seen.__getitem__, words), bool, len(words))
    except KeyError:
        for w in set(words):
            if w not in seen:
                seen[w] = w.strip(_STRIP) in group
        return np.fromiter(map(seen.__getitem__, words), bool, len(words))


def line_statistics(texts: list[str | None], vocabulary: frozenset = frozenset(), run: int = 6, often: int = 3) -> Lines:
    """Statistics of all lines of all texts. ``vocabulary``: the known words. A word is repeated if a run of ``run`` words that holds it occurs ``often`` times in its text."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _classes()
    texts = [(t or "").replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    kinds = _TABLE[np.minimum(points, _TOP)]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(size)
    space = (kinds & _SPACE) > 0
    breaks = np.flatnonzero(points == 10)
    line_start = np.concatenate([[0], breaks[:-1] + 1])
    text_of_line = np.searchsorted(ends, line_start, side="right")

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[breaks + 1] - total[line_start]

    filled = ~space
    word_start = filled.copy()
    word_start[1:] &= space[:-1]
    at = np.flatnonzero(word_start)
    words = joined.lower().split()
    if len(words) != len(at):  # a character whose lower case is several
        words = joined.split()
    weight, n_words = per_line(filled), per_line(word_start)
    common, known = np.zeros(len(points), bool), np.zeros(len(points), bool)
    common[at], known[at] = _in(words, _COMMON), _in(words, vocabulary)
    letters, digits = per_line((kinds & _LETTER) > 0), per_line((kinds & _DIGIT) > 0)
    symbols, separators = per_line((kinds & _SYMBOL) > 0), per_line((kinds & _SEPARATOR) > 0)
    vowels, stops = per_line((kinds & _VOWEL) > 0), per_line((kinds & _STOP) > 0)
    n_common, n_known = per_line(common), per_line(known)
    gap = np.zeros(len(points), bool)
    gap[1:-1] = space[1:-1] & space[:-2] & ~space[2:] & (points[1:-1] != 10)
    gaps = per_line(gap)

    # words in runs that occur often in their text
    owner = np.searchsorted(ends, at, side="right")
    repeated = np.zeros(len(points), bool)
    if len(words) >= run:
        ids = word_ids(words)
        key = mix(ids[: len(ids) - run + 1] + owner[: len(ids) - run + 1].astype(np.uint64))
        for k in range(1, run):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - run + 1 + k])
        whole = owner[: len(key)] == owner[run - 1 :]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        group = np.cumsum(new) - 1
        many = np.empty(len(key), bool)
        many[order] = np.bincount(group)[group] >= often
        edge = np.zeros(len(words) + 1, np.int64)
        hit = np.flatnonzero(many & whole)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + run, -1)
        repeated[at] = np.cumsum(edge[:-1]) > 0
    n_repeated = per_line(repeated)

    # first and last character that is not blank
    place = np.flatnonzero(filled)
    some = weight > 0
    first_at = place[np.minimum(np.searchsorted(place, line_start[some]), len(place) - 1)] if len(place) else np.empty(0, np.int64)
    last_at = place[np.searchsorted(place, breaks[some]) - 1] if len(place) else np.empty(0, np.int64)
    bullets = np.array([ord(c) for c in _BULLETS], np.uint32)
    head, tail = points[first_at], kinds[last_at]
    first = np.select(
        [np.isin(head, bullets), (kinds[first_at] & _DIGIT) > 0, head == ord("("), (kinds[first_at] & _SYMBOL) > 0, (kinds[first_at] & _UPPER) > 0], [4, 3, 3, 2, 1], 0
    )
    last = np.select([(tail & _STOP) > 0, (tail & _SYMBOL) > 0], [1, 2], 0)
    w, n, c = weight[some], n_words[some], np.maximum(weight[some], 1)
    one = np.maximum(n, 1)
    values = np.stack(
        [n, n_common[some] / one, n_known[some] / one, symbols[some] / c, digits[some] / c, separators[some] / one, gaps[some] / one,
         vowels[some] / np.maximum(letters[some], 1), c / one, n_repeated[some] / one, first, last], axis=1,
    )

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.bincount(text_of_line, x, len(texts))

    n_lines = np.bincount(text_of_line[some], minlength=len(texts))
    ended = np.bincount(text_of_line[some], last == 1, len(texts))
    counted, chars = per_text(n_words), per_text(weight)
    documents = {
        "n_words": counted.astype(np.int64),
        "n_lines": n_lines,
        "mean_word_length": per_text(letters + digits) / np.maximum(counted, 1),
        "symbol_ratio": per_text(symbols) / np.maximum(chars, 1),
        "digit_ratio": per_text(digits) / np.maximum(chars, 1),
        "stop_ratio": per_text(stops) / np.maximum(counted, 1),
        "lines_ending_in_punctuation": ended / np.maximum(n_lines, 1),
        "common_words": per_text(n_common) / np.maximum(counted, 1),
        "repeated_words": per_text(n_repeated) / np.maximum(counted, 1),
    }
    return Lines(text_of_line[some], w, values, documents)


def clear_labels(lines: Lines) -> np.ndarray:
    """Labels of lines that leave little doubt, -1 for the others."""
    v = {name: lines.values[:, k] for k, (name, _) in enumerate(BINS)}
    out = np.full(len(lines.owner), -1)
    spoken = (v["common"] >= 0.12) | (v["known"] >= 0.55)
    out[(v["words"] >= 5) & spoken & (v["symbols"] < 0.05) & (v["digits"] < 0.15) & (v["separators"] < 0.3)] = PROSE
    out[(v["words"] >= 5) & (out == PROSE) & (v["repeated"] > 0.7)] = ECHO
    out[(v["first"] >= 3) & (v["words"] <= 7)] = LIST
    out[(v["words"] <= 6) & (v["separators"] >= 0.15) & (v["digits"] < 0.1) & (v["symbols"] < 0.12) & (v["known"] < 0.5)] = LIST
    out[(v["separators"] >= 0.35) & (v["digits"] < 0.1) & (v["symbols"] < 0.12) & (v["known"] < 0.6)] = LIST
    out[((v["digits"] > 0.25) & (v["words"] >= 3)) | (v["gaps"] > 0.3) & (v["known"] < 0.4) | (v["separators"] >= 1) & (v["symbols"] < 0.3) & (v["digits"] > 0.1)] = TABLE
    out[(v["symbols"] >= 0.15) & (v["digits"] < 0.3) & (v["first"] != 4)] = JUNK
    out[(v["vowels"] < 0.1) & (v["words"] >= 2) & (v["digits"] < 0.2)] = JUNK
    out[(v["words"] >= 6) & (v["known"] < 0.1) & (v["common"] < 0.02) & (v["digits"] < 0.2) & (v["separators"] < 0.3)] = JUNK
    out[(v["length"] > 20) & (v["words"] <= 3)] = JUNK
    return out


@dataclass(frozen=True)
class LineModel:
    start: np.ndarray
    move: np.ndarray
    emit: tuple[np.ndarray, ...]
    vocabulary: frozenset = frozenset()
    threshold: float = 0.5

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.emit[k][codes[:, k]] for k in range(len(self.emit)))

    def label(self, lines: Lines) -> np.ndarray:
        """The most likely labels of each text's lines (Viterbi), all texts side by side."""
        if not len(lines.owner):
            return np.empty(0, np.int64)
        scores = self.scores(lines.codes)
        begin = np.flatnonzero(np.concatenate([[True], lines.owner[1:] != lines.owner[:-1]]))
        length = np.diff(np.append(begin, len(lines.owner)))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        back = np.zeros((len(scores), STATES), np.int8)
        now = self.start + scores[begin]
        final = np.empty(len(begin), np.int64)
        best = np.empty((len(begin), STATES))
        best[:] = now
        active = len(begin)
        for step in range(1, int(length[0])):
            active = int(np.searchsorted(-length, -step, side="left"))
            path = best[:active, :, None] + self.move[None]
            at = begin[:active] + step
            back[at] = path.argmax(axis=1)
            best[:active] = path.max(axis=1) + scores[at]
        final = best.argmax(axis=1)
        out = np.empty(len(scores), np.int64)
        out[begin + length - 1] = final
        for step in range(int(length[0]) - 1, 0, -1):
            active = int(np.searchsorted(-length, -step, side="left"))
            at = begin[:active] + step
            out[at - 1] = back[at, out[at]]
        out[(out == PROSE) & (lines.values[:, _REPEATED] > 0.7)] = ECHO
        return out


def known_words(texts: list[str], share: float = 0.006) -> frozenset:
    """Words that at least this share of the texts has (and three of them), mostly in lower case."""
    texts_with, small, total = Counter(), Counter(), Counter()
    for text in texts:
        found = Counter(w.strip(_STRIP) for w in text.split())
        shout = text.upper() == text
        seen = set()
        for w, n in found.items():
            low = w.lower()
            if w.isalpha() or "-" in w or "'" in w:
                seen.add(low)
                total[low] += n
                small[low] += n * (w == low or shout)
        texts_with.update(seen)
    least = max(3, share * len(texts))
    return frozenset(w for w, n in texts_with.items() if n >= least and small[w] >= 0.5 * total[w] and w not in _ARTICLES)


def _fit(lines: Lines, labels: np.ndarray, vocabulary: frozenset) -> LineModel:
    """Smoothed counts of labelled lines; unlabelled ones (-1) count nowhere."""
    codes, k = lines.codes, STATES
    known = labels >= 0
    emit = []
    for f, size in enumerate(SIZES):
        n = np.bincount(codes[known, f].astype(np.int64) * k + labels[known], minlength=size * k).reshape(size, k) + 2.0
        emit.append(np.log(n / n.sum(axis=0)))
    first = np.concatenate([[True], lines.owner[1:] != lines.owner[:-1]])
    start = np.bincount(labels[first & known], minlength=k) + 2.0
    pair = np.flatnonzero(~first[1:] & known[1:] & known[:-1])
    move = np.bincount(labels[pair] * k + labels[pair + 1], minlength=k * k).reshape(k, k) + 2.0
    return LineModel(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), tuple(emit), vocabulary)


def shares(lines: Lines, labels: np.ndarray, n: int) -> np.ndarray:
    """Share of the characters under each label, by text; zeros where there is no text."""
    total = np.bincount(lines.owner * len(LABELS) + _REPORTED[labels], lines.weight, n * len(LABELS)).reshape(n, -1)
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1)


@dataclass(frozen=True)
class TrainConfig:
    """``documents``: the most rated documents used for training, ``text_bytes``: of text at most in all (texts of over a hundredth of that are not used).

    ``rounds``: of relabelling. ``least``: with fewer rated documents others are added as texts, and the threshold stays at one half.
    """

    documents: int = 3000
    text_bytes: int = 30_000_000
    rounds: int = 3
    least: int = 30


def train(texts: list[str], rated: list[bool | None], config: TrainConfig = TrainConfig()) -> LineModel:
    """A model from texts and, where known, whether each is prose."""
    prose = [t for t, r in zip(texts, rated, strict=True) if r is not False]
    vocabulary = known_words(prose)
    lines = line_statistics(texts, vocabulary)
    clear = clear_labels(lines)
    model = _fit(lines, clear, vocabulary)
    for _ in range(config.rounds):
        found = model.label(lines)
        model = _fit(lines, np.where(clear >= 0, clear, found), vocabulary)
    other = 1 - shares(lines, model.label(lines), len(texts))[:, PROSE]
    truth = np.array([-1 if r is None else int(not r) for r in rated])
    use = truth >= 0
    if use.sum() < config.least:
        return model
    grid = np.arange(0.35, 0.66, 0.05)
    right = np.array([((other[use] > g) == (truth[use] == 1)).sum() for g in grid])
    middle = grid[right == right.max()]
    return replace(model, threshold=float(middle[np.argmin(np.abs(middle - 0.5))]))


def fit_line_model(documents: DataFrame, ratings: DataFrame, config: TrainConfig = TrainConfig()) -> LineModel:
    """Train on about ``config.documents`` documents and ``config.text_bytes`` of text at most, chosen by hashes of their id: rated ones, and others if few are rated."""
    votes = ratings.where("aspect = 'text_kind' AND doc_id IS NOT NULL").select("doc_id", F.lower(F.trim("rating")).alias("r")).where("r IN ('prose', 'other')")
    votes = votes.groupBy("doc_id").agg(F.avg((F.col("r") == "prose").cast("int")).alias("prose"))
    # at most ``documents`` rows, so they may be sent to all tasks
    chosen = F.broadcast(bounded_sample(votes, "doc_id", config.documents))
    texts = documents.select("doc_id", "text")
    rows = bounded_texts(texts.join(chosen, "doc_id").where("length(trim(text)) > 0"), "doc_id", "text", config.text_bytes).toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    if len(rows) < config.least:  # too few ratings: the model needs texts, not ratings
        more = bounded_texts(bounded_sample(texts.where("length(trim(text)) > 0"), "doc_id", min(300, config.documents)), "doc_id", "text", config.text_bytes).toPandas().sort_values("doc_id")
        more = more[~more.doc_id.isin(rows.doc_id)].assign(prose=np.nan)
        rows = pd.concat([more, rows]) if len(rows) else more
    if not len(rows):
        return train(["The text of a line."], [None], config)
    return train(rows.text.tolist(), [None if not p == p or p == 0.5 else p > 0.5 for p in rows.prose.tolist()], config)


STATISTICS = ("n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "stop_ratio", "lines_ending_in_punctuation", "common_words", "repeated_words")


def text_statistics(documents: DataFrame, model: LineModel) -> DataFrame:
    """doc_id, the statistics, ``prose``, ``list``, ``table``, ``junk`` (shares of characters) and ``is_prose``."""
    kinds = ["bigint", "bigint"] + ["double"] * (len(STATISTICS) - 2)
    schema = ", ".join(["doc_id bigint", *(f"{n} {k}" for n, k in zip(STATISTICS, kinds, strict=True)), *(f"{x} double" for x in LABELS), "is_prose boolean"])
    names = ["doc_id", *STATISTICS, *LABELS, "is_prose"]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1, 4096):
                texts = part.column(1).to_pylist()
                lines = line_statistics(texts, model.vocabulary)
                share = shares(lines, model.label(lines), len(texts))
                null = np.array([t is None for t in texts], bool)
                blank = lines.documents["n_words"] == 0
                columns = [pa.array(lines.documents[s], mask=null) for s in STATISTICS]
                columns += [pa.array(share[:, j], mask=null) for j in range(len(LABELS))]
                columns.append(pa.array(1 - share[:, PROSE] <= model.threshold, mask=null | blank))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def not_prose(statistics: DataFrame) -> DataFrame:
    """The documents most of whose text is not running prose."""
    return statistics.where("NOT is_prose").select("doc_id").distinct()
