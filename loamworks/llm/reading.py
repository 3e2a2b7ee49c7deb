"""The level of reading that a text demands: elementary, intermediate or advanced.

An interpolated trigram model of the words of each level is trained on all rated documents (counts are made by Spark, tables are files that workers map); the weights of trigram, bigram, unigram and
uniform part are fitted on texts held out (expectation maximization). A text is scored whole: in every run of ``window`` words each model has a mean
surprisal, and the text has the distributions of how much more surprised the easier of two neighbouring levels is than the harder one, told by
their quantiles and means, and the mean of the level that each run makes likely. A ridge regression, fitted on held-out texts, makes one difficulty of them, and isotonic regression maps it
monotonically to the graded level of the ratings (0, 1, 2); the grade is cut at one half and one and a half. Passages of another kind, such as quoted
questions or personal data, are few of many runs and move the quantiles little.

Null and blank texts have no level (null). Every row is scored, repeated ones too; columns not named are ignored.
Ratings count by majority per document, trimmed and in any case; documents whose ratings tie are not used. Fewer than 20 rated texts are too few to
hold some out: then the weights are those of ``ReadingConfig.weights`` and the difficulty is the mean over runs of the likeliest level.
"""

from __future__ import annotations

import functools
import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks import storage
from loamworks.llm import quality
from loamworks.llm.batches import pieces
from loamworks.llm.shingles import mix, word_ids
from loamworks.operators.similar_sets import filtered
from loamworks.session import materialize, scratch, step_path

BANDS = ("elementary", "intermediate", "advanced")
_WORD = re.compile(r"[^\W\d_]+")
_SPAN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ReadingConfig:
    """``weights``: of trigram, bigram and unigram before they are fitted; the rest is uniform."""

    weights: tuple[float, float, float] = (0.45, 0.35, 0.18)
    window: int = 24
    min_words: int = 60


#: Of the distributions over a text's runs.
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def word_sequence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, numbers left out, and the number of words of each text."""
    found = [_WORD.findall(t.lower()) if t else [] for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    return word_ids([w for words in found for w in words]), counts


def _grams(ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Hashes of the word, and of the word with one and two before it; a text begins with blanks."""
    owner = np.repeat(np.arange(len(counts)), counts)
    one = mix(ids)
    before = np.zeros_like(ids)
    before[1:] = np.where(owner[1:] == owner[:-1], ids[:-1], np.uint64(0))
    further = np.zeros_like(ids)
    further[2:] = np.where(owner[2:] == owner[:-2], ids[:-2], np.uint64(0))
    two = mix(one + mix(before + _SPAN))
    return [one, two, mix(two + mix(further ^ _SPAN) * np.uint64(3))]


class Table:
    """Values by 64-bit key. Keys are ordered by slot, those that meet in a slot follow each other, so each is kept; other keys have zeros."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        slot = self._slots(keys)
        order = np.argsort(slot, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=2**self.bits))]).astype(np.int32)
        # the last row stands for no key
        self.keys = np.append(keys[order], np.uint64(0))
        self.values = np.vstack([values[order], np.zeros((1, values.shape[1]))]).astype(np.float32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(2**self.bits - 1)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        at, end = self.first[slot], self.first[slot + 1]
        hit = self.keys[at] == keys  # a key of another slot is another key
        rest = np.flatnonzero(~hit & (at + 1 < end))
        while len(rest):
            at[rest] += 1
            hit[rest] = self.keys[at[rest]] == keys[rest]
            rest = rest[~hit[rest] & (at[rest] + 1 < end[rest])]
        return self.values[np.where(hit, at, len(self.keys) - 1)]


class MappedTable:
    """Values by 64-bit key in files that all workers share (``_written``); only pages that are used are in memory. Other keys have zeros.

    ``fold``: of the model without that part of the documents, -1: of the whole model.
    """

    def __init__(self, path: str, order: int, fold: int = -1):
        self.path, self.order, self.fold = path, order, fold

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        known, values = _mapped(self.path, self.order)
        out = np.zeros((len(keys), len(BANDS)), np.float32)
        if not len(known) or not len(keys):
            return out
        # sorted and once each: neighbours lie on the same pages
        asked, back = np.unique(keys.view(np.int64), return_inverse=True)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        hit = known[at] == asked
        first = len(BANDS) * (self.fold + 1)
        found = np.zeros((len(asked), len(BANDS)), np.float32)
        found[hit] = values[at[hit], first : first + len(BANDS)]
        return found[back]


@functools.cache
def _mapped(path: str, order: int) -> tuple[np.ndarray, np.ndarray]:
    files, top = storage.locate(path)
    parts = []
    for name, kind in (("keys", np.int64), ("values", np.float32)):
        at = f"{top}/{order}.{name}"
        if not files.get_file_info(at).size:
            parts.append(np.empty(0, kind))
            continue
        if not isinstance(files, fs.LocalFileSystem):
            local = os.path.join(tempfile.mkdtemp(prefix="loamworks-"), name)
            fs.copy_files(at, local, source_filesystem=files, destination_filesystem=fs.LocalFileSystem())
            at = local
        parts.append(np.memmap(at, kind, mode="r"))
    return parts[0], parts[1].reshape(len(parts[0]), -1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares rising fit by pooling adjacent violators: knots and their values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass(frozen=True)
class ReadingModel:
    """``scale``: mean and deviation of each figure of the distributions, ``slope``: its weight in the difficulty, the last one alone; None: no regression."""

    tables: tuple[Table | MappedTable, ...]
    config: ReadingConfig
    prior: np.ndarray
    floor: float
    knots: tuple[np.ndarray, np.ndarray]
    scale: tuple[np.ndarray, np.ndarray] | None = None
    slope: np.ndarray | None = None

    def parts(self, ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Chance of each word under each level's trigrams, bigrams, unigrams and no model."""
        found = [table(keys) for table, keys in zip(self.tables, _grams(ids, counts), strict=True)]
        return [*found[::-1], np.full((len(ids), len(BANDS)), self.floor, np.float32)]

    def surprisal(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Nats per word under each level's model."""
        w = (*self.config.weights, 1 - sum(self.config.weights))
        return -np.log(sum(np.float32(k) * p for k, p in zip(w, self.parts(ids, counts), strict=True)))

    def distributions(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: the figures of its distributions, the expected level over its runs, and the mean surprisal of the likelier level; NaN without words."""
        ids, counts = word_sequence(texts)
        k, width = len(texts), (len(QUANTILES) + 1) * (len(BANDS) - 1) + 1
        none = np.full(k, np.nan)
        if not len(ids):
            return np.full((k, width), np.nan), none, none
        s = self.surprisal(ids, counts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        place = np.arange(len(ids)) - np.repeat(first, counts)
        begin = np.flatnonzero(place % self.config.window == 0)
        sums = np.add.reduceat(s, begin, axis=0)
        n = np.diff(np.append(begin, len(ids)))
        owner = np.repeat(np.arange(k), counts)[begin]
        some = counts > 0
        words = np.where(some, counts, np.nan)
        low = sums.min(axis=1, keepdims=True)
        belief = np.exp(low - sums) * self.prior
        belief /= belief.sum(axis=1, keepdims=True)
        level = np.bincount(owner, n * (belief @ np.arange(len(BANDS))), k) / words
        runs = np.bincount(owner, minlength=k)
        start = np.concatenate([[0], np.cumsum(runs)[:-1]])
        figures = []
        for b in range(len(BANDS) - 1):
            gain = (sums[:, b] - sums[:, b + 1]) / n
            ordered = gain[np.lexsort((gain, owner))]
            for q in QUANTILES:
                at = start + q * np.maximum(runs - 1, 0)
                lo = np.minimum(at.astype(np.int64), len(ordered) - 1)
                hi = np.minimum(lo + (at > lo), len(ordered) - 1)
                figures.append(np.where(some, ordered[lo] + (at - lo) * (ordered[hi] - ordered[lo]), np.nan))
            figures.append(np.bincount(owner, sums[:, b] - sums[:, b + 1], k) / words)
        return np.stack([*figures, level], axis=1), level, np.bincount(owner, low[:, 0], k) / words

    def difficulty(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """One number for the distributions of each text, and the mean surprisal of its likelier level."""
        figures, level, surprisal = self.distributions(texts)
        return (level if self.slope is None else self.combined(figures)), surprisal

    def combined(self, figures: np.ndarray) -> np.ndarray:
        mean, deviation = self.scale
        return ((figures - mean) / deviation) @ self.slope[:-1] + self.slope[-1]

    def grade(self, difficulty: np.ndarray) -> np.ndarray:
        return np.interp(difficulty, *self.knots)


def fitted_weights(model: ReadingModel, texts: list[str], y: np.ndarray, rounds: int = 30) -> tuple[float, ...]:
    """Weights of trigram, bigram and unigram under which texts that the model has not seen are likeliest, each under its own level."""
    ids, counts = word_sequence(texts)
    return _weights(model.config, lambda: [_own_parts(model, ids, counts, y)] if len(ids) else [], rounds)


def _own_parts(model: ReadingModel, ids: np.ndarray, counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By word, its chances under the parts of its own level's model."""
    own = np.repeat(y, counts)
    return np.stack([x[np.arange(len(ids)), own] for x in model.parts(ids, counts)], axis=1).astype(float)


def _weights(config: ReadingConfig, chunks: Callable[[], Iterable[np.ndarray]], rounds: int = 30) -> tuple[float, ...]:
    """``chunks`` gives the words' chances anew in each round."""
    w = np.append(config.weights, 1 - sum(config.weights))
    for _ in range(rounds):
        total, words = np.zeros(len(w)), 0
        for p in chunks():
            part = p * w
            total += (part / part.sum(axis=1, keepdims=True)).sum(axis=0)
            words += len(p)
        if not words:
            return config.weights
        w = total / words
    # no part is given up, least of all the uniform one
    w = np.maximum(w, 1e-3)
    return tuple((w / w.sum())[:3].tolist())


def train(texts: list[str], levels: list[int], config: ReadingConfig = ReadingConfig(), folds: int = 4) -> ReadingModel:
    """Models of the levels, their weights, the regression and the rising map from difficulty to grade, all fitted on texts held out in turn."""
    y = np.array(levels, np.int64)
    model = _language_models(texts, y, config)
    if len(texts) < 5 * folds:
        return model
    held = None
    pick = lambda part: [t for t, p in zip(texts, part, strict=True) if p]
    for k in range(folds):
        part = np.arange(len(texts)) % folds == k
        rest = _language_models(pick(~part), y[~part], config)
        if k == 0:
            config = replace(config, weights=fitted_weights(rest, pick(part), y[part]))
            rest, model = replace(rest, config=config), replace(model, config=config)
        figures = rest.distributions(pick(part))[0]
        held = np.full((len(texts), figures.shape[1]), np.nan) if held is None else held
        held[part] = figures
    return _regressed(model, held, y)


def _regressed(model: ReadingModel, held: np.ndarray, y: np.ndarray) -> ReadingModel:
    """With the regression and the rising map for figures of held-out texts."""
    use = ~np.isnan(held).any(axis=1)
    if not use.any():
        return model
    x, t = held[use], y[use].astype(float)
    scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = (x - scale[0]) / scale[1]
    slope = np.linalg.solve(z.T @ z + len(z) * 0.1 * np.eye(z.shape[1]), z.T @ (t - t.mean()))
    model = replace(model, scale=scale, slope=np.append(slope, t.mean()))
    return replace(model, knots=isotonic(model.combined(x), t))


def _language_models(texts: list[str], y: np.ndarray, config: ReadingConfig) -> ReadingModel:
    ids, counts = word_sequence(texts)
    band = np.repeat(y, counts)
    grams = _grams(ids, counts)
    tables = []
    below = None
    for keys in grams:
        unique, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at * len(BANDS) + band, minlength=len(unique) * len(BANDS)).reshape(-1, len(BANDS)).astype(float)
        if below is None:
            history = np.maximum(np.bincount(band, minlength=len(BANDS)), 1)[None, :].repeat(len(unique), axis=0)
        else:  # how often what stands before the word was followed by any word
            history = below[at_first(at, len(unique))]
        tables.append(Table(unique, n / np.maximum(history, 1)))
        below = _followed(ids, counts, band, len(tables))
    prior = np.bincount(y, minlength=len(BANDS)) + 1.0
    vocabulary = max(1, len(tables[0].values))
    return ReadingModel(tuple(tables), config, prior / prior.sum(), 1.0 / vocabulary, (np.array([0.0, 2.0]), np.array([0.0, 2.0])))


def at_first(at: np.ndarray, n: int) -> np.ndarray:
    """The first place of each of n groups."""
    out = np.zeros(n, np.int64)
    out[at[::-1]] = np.arange(len(at))[::-1]
    return out


def _contexts(ids: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """By word, a hash of the ``order`` words before it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    key = np.zeros(len(ids), np.uint64)
    for k in range(1, order + 1):
        part = np.zeros_like(ids)
        part[k:] = np.where(owner[k:] == owner[:-k], ids[:-k], np.uint64(0))
        key = mix(key * _SPAN + part + np.uint64(k))
    return key


def _followed(ids: np.ndarray, counts: np.ndarray, band: np.ndarray, order: int) -> np.ndarray:
    """By word, the number of times by level that the ``order`` words before it occur before any word."""
    _, at = np.unique(_contexts(ids, counts, order), return_inverse=True)
    n = np.bincount(at * len(BANDS) + band, minlength=(at.max(initial=-1) + 1) * len(BANDS)).reshape(-1, len(BANDS))
    return n[at]


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts, levels and folds of pieces of ``text, level, fold``."""
    for batch in batches:
        for part in pieces(batch, 0, 2048):
            yield part.column(0).to_pylist(), part.column(1).to_numpy().astype(np.int64), part.column(2).to_numpy().astype(np.int64)


def _counted(rated: DataFrame, folds: int) -> DataFrame:
    """order, key and the chances of each n-gram by level: of the whole model, then of those without each fold; ``seen``: in which of these models it is."""
    k = len(BANDS)

    def run(batches):
        for texts, y, fold in _texts(batches):
            ids, counts = word_sequence(texts)
            cell = np.repeat(fold * k + y, counts)
            for order, keys in enumerate(_grams(ids, counts)):
                unique, first, at = np.unique(keys, return_index=True, return_inverse=True)
                cells, n = np.unique(at * (folds * k) + cell, return_counts=True)
                at, of = np.divmod(cells, folds * k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), order, np.int8)), pa.array(unique[at].view(np.int64)), pa.array(_contexts(ids, counts, order)[first[at]].view(np.int64)), pa.array(of.astype(np.int32)), pa.array(n.astype(np.int64))],
                    names=["order", "key", "context", "cell", "n"],
                )

    found = rated.select("text", "level", "fold").mapInArrow(run, "order byte, key long, context long, cell int, n long")
    found = materialize(found.groupBy("order", "key", "context").agg(*[F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(folds * k)]))
    before = found.groupBy("order", "context").agg(*[F.sum(f"n{c}").alias(f"h{c}") for c in range(folds * k)])

    def kept(x: str, fold: int, level: int) -> Column:
        return sum((F.col(f"{x}{f * k + level}") for f in range(folds) if f != fold), F.lit(0))

    chances = [(kept("n", f, b) / F.greatest(kept("h", f, b), F.lit(1))).cast("float") for f in range(-1, folds) for b in range(k)]
    seen = [sum((kept("n", f, b) for b in range(k)), F.lit(0)) > 0 for f in range(-1, folds)]
    return found.join(before, ["order", "context"]).select("order", "key", F.array(*chances).alias("values"), F.array(*seen).alias("seen"))


def _written(tables: DataFrame) -> str:
    """A folder with the keys of each order, sorted, and their values, as numbers one after the other; the driver holds a piece at a time."""
    spark = tables.sparkSession
    path = step_path(spark, "reading")
    with scratch():
        at = step_path(spark)
        materialize(tables.select("order", "key", "values").orderBy("order", "key"), at)
        files, top = storage.locate(path)
        files.create_dir(top)
        out = {(o, name): files.open_output_stream(f"{top}/{o}.{name}") for o in range(3) for name in ("keys", "values")}
        for batch in _batches(at, ["order", "key", "values"]):
            order, keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
            for o in np.unique(order):
                out[o, "keys"].write(keys[order == o].tobytes())
                out[o, "values"].write(values[order == o].tobytes())
        for x in out.values():
            x.close()
    return path


def _batches(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """A written step, piece by piece in the order of its files."""
    files, top = storage.locate(path)
    for name in sorted(x.path for x in files.get_file_info(fs.FileSelector(top)) if x.path.endswith(".parquet")):
        with files.open_input_file(name) as f:
            yield from pq.ParquetFile(f).iter_batches(65536, columns=columns)


def fit_reading_model(documents: DataFrame, ratings: DataFrame, config: ReadingConfig = ReadingConfig(), folds: int = 4) -> ReadingModel:
    """Train on all rated documents, like ``train``; folds are told by a hash of the id.

    N-grams are counted and held-out texts scored by tasks. The driver goes through tables and chances of words piece by piece, and has
    the figures of each rated document (fourteen numbers) at once.
    """
    levels = F.create_map(*[x for k, b in enumerate(BANDS) for x in (F.lit(b), F.lit(k))])
    votes = ratings.where("aspect = 'reading_level' AND doc_id IS NOT NULL").select("doc_id", F.try_element_at(levels, F.lower(F.trim("rating"))).alias("level"))
    votes = votes.where("level IS NOT NULL").groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    votes = votes.groupBy("doc_id").agg(F.max(F.struct("n", "level")).alias("best"), F.count_if(F.lit(True)).alias("kinds"), F.max("n").alias("most"), F.min("n").alias("least"))
    votes = votes.where("kinds = 1 OR most > least").select("doc_id", "best.level")
    votes = materialize(votes.withColumn("doc_id", F.col("doc_id").cast("long")))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("length(trim(text)) > 0")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int")
    rated = filtered(rows, votes.select("doc_id")).join(votes, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("level").alias("level"))
    rated = materialize(rated.withColumn("fold", fold))
    docs = np.zeros((folds, len(BANDS)), np.int64)
    for r in rated.groupBy("fold", "level").count().collect():
        docs[r["fold"], r["level"]] = r["count"]
    if docs.sum() < 5 * folds:
        few = sorted(rated.collect(), key=lambda r: r["doc_id"])
        return train([r["text"] for r in few], [r["level"] for r in few], config)
    tables = materialize(_counted(rated, folds))
    path = _written(tables)
    words = tables.where("order = 0").agg(*[F.count_if(F.col("seen")[f]).alias(str(f)) for f in range(folds + 1)]).first()
    line = np.array([0.0, 2.0])
    models = []
    for f in range(-1, folds):
        prior = docs[np.arange(folds) != f].sum(axis=0) + 1.0
        models.append(ReadingModel(tuple(MappedTable(path, o, f) for o in range(3)), config, prior / prior.sum(), 1.0 / (words[f + 1] + 1), (line, line)))

    def parts(batches):
        for texts, y, _ in _texts(batches):
            ids, counts = word_sequence(texts)
            if len(ids):
                p = _own_parts(models[1], ids, counts, y)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in p.T], names=list("abcd"))

    texts = rated.select("text", "level", "fold")
    with scratch():
        at = step_path(documents.sparkSession)
        materialize(texts.where("fold = 0").mapInArrow(parts, "a double, b double, c double, d double"), at)
        config = replace(config, weights=_weights(config, lambda: (np.stack([x.to_numpy() for x in b.columns], axis=1) for b in _batches(at, list("abcd")))))
    models = [replace(m, config=config) for m in models]

    def figures(batches):
        for texts, y, fold in _texts(batches):
            for f in np.unique(fold):
                own = np.flatnonzero(fold == f)
                found = models[f + 1].distributions([texts[i] for i in own])[0]
                yield pa.RecordBatch.from_arrays([pa.array(y[own]), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["level", "figures"])

    held = texts.mapInArrow(figures, "level long, figures array<double>").toArrow()
    x = held.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)
    return _regressed(models[0], x, held.column(0).to_numpy())


def reading_levels(documents: DataFrame, model: ReadingModel, lines: quality.LineModel) -> DataFrame:
    """doc_id, n_words, is_prose, surprisal, difficulty, grade (0 to 2) and band of every document."""
    config = model.config

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1, 2048):
                texts = part.column(1).to_pylist()
                found = quality.line_statistics(texts, lines.vocabulary)
                share = quality.shares(found, lines.label(found), len(texts))
                blank = found.documents["n_words"] == 0
                prose = (1 - share[:, quality.PROSE] <= lines.threshold) & ~blank
                level, surprisal = model.difficulty(texts)
                empty = np.isnan(level)
                grade = model.grade(np.where(empty, 0, level))
                band = np.array(BANDS, dtype=object)[(grade >= 0.5).astype(int) + (grade >= 1.5)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found.documents["n_words"]), pa.array(prose), pa.array(surprisal, mask=empty),
                     pa.array(level, mask=empty), pa.array(grade, mask=empty), pa.array(band, pa.string(), mask=empty)],
                    names=["doc_id", "n_words", "is_prose", "surprisal", "difficulty", "grade", "band"],
                )

    schema = "doc_id bigint, n_words bigint, is_prose boolean, surprisal double, difficulty double, grade double, band string"
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def prose_levels(levels: DataFrame, min_words: int = ReadingConfig.min_words) -> DataFrame:
    """doc_id and band of running prose of at least ``min_words`` words."""
    return levels.where((F.col("n_words") >= min_words) & F.col("is_prose") & F.col("band").isNotNull()).select("doc_id", "band").distinct()
