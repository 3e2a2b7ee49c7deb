"""Held-out evaluation questions inside training texts.

A document leaks a question if one passage of it holds, in order, at least half of the question's words,
where up to one word in eight of the passage may be replaced or missing. Words are compared without regard
to case, punctuation, markup, invisible characters and layout.

Every batch of documents (a shard) gets an FM-index over its words. Any passage that qualifies
contains a run of words of the question whose least length follows from the tolerance (``seed_length``), so all such
runs of all questions are searched in the index at once, located by the sampled suffix positions, and each place is
verified by an alignment of the words. Overlapping places are merged into removal spans.

Questions travel with the code: their size is checked against ``most_question_bytes``, beyond which the operator ends with an error.
Documents are only scanned. Markup is left out whatever its length; a text with what may be a tag of more than 300 characters is also
searched with it left in, since that may be prose between two angle brackets. Null or empty texts and
questions without words match nothing; a question issued under several items counts for each; only items of the given
splits count (split compared trimmed, in any case). Repeated documents repeat nothing: rows are distinct.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.llm.batches import pieces
from loamworks.llm.fm_index import FMIndex

_WORD = re.compile(r"[^\W_]+")
#: A tag ends at the next angle bracket, so searching for all of them takes time in proportion to the text.
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_MARK = re.compile(r"</?[a-zA-Z][^<>]*>")
_LONG_TAG = re.compile(r"</?[a-zA-Z][^<>]{297,}>")
#: Soft hyphen, zero-width characters, direction marks, joiners and the byte order mark.
_INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)])
_WRAPPED = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")


@dataclass(frozen=True)
class LeakConfig:
    """``share``: of the question's words that a passage must hold. ``tolerance``: one word in so many may differ.

    ``shard_bytes``: of text in an index at most, unless one text alone has more; each index is searched for all questions.
    ``most_question_bytes``: of all questions together.
    """

    share: float = 0.5
    tolerance: int = 8
    splits: tuple[str, ...] = ("test", "validation")
    shard_docs: int = 65_536
    shard_bytes: int = 24_000_000
    most_question_bytes: int = 64_000_000


def _tags(text: str, long_tags: bool = True) -> list[tuple[int, int]]:
    """Places of tags and comments, in order. Comments are looked for up to the last end of one only, so none is scanned to the end of the text in vain."""
    if "<" not in text:
        return []
    last = text.rfind("-->") + 3
    found = [m.span() for m in _TAG.finditer(text, 0, last)] if last > 2 else []
    found += [m.span() for m in _MARK.finditer(text, last if last > 2 else 0)]
    return found if long_tags else [x for x in found if x[1] - x[0] <= 300 or text.startswith("<!--", x[0])]


def normalize(text: str, long_tags: bool = True) -> str:
    if cut := _tags(text, long_tags):
        kept = [text[a:b] for a, b in zip([0, *(e for _, e in cut)], [*(b for b, _ in cut), len(text)], strict=True)]
        text = " ".join(kept)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    return text.lower()


def words(text: str | None, long_tags: bool = True) -> list[str]:
    return _WORD.findall(normalize(text, long_tags)) if text else []


def views(texts: list[str | None]) -> list[tuple[int, bool]]:
    """Text and whether long tags are left out: every text once, those with a long tag also with it."""
    return [(t, True) for t in range(len(texts))] + [(t, False) for t, x in enumerate(texts) if x and "<" in x and _LONG_TAG.search(x)]


def seed_length(n_words: int, config: LeakConfig) -> int:
    """The least run of unchanged words in any passage that qualifies, less one for rounding; at least 3."""
    least = max(1, int(np.ceil(n_words * config.share)))
    runs = []
    for p in range(least, max(least, n_words) + 1):
        e = p // config.tolerance
        runs.append(-(-(p - e) // (e + 1)))
    return max(1, min(min(runs), max(3, min(runs) - 1)))


class Questions:
    """The distinct questions as word numbers, and the runs to search for, by length."""

    def __init__(self, rows: list[tuple[int, str]], config: LeakConfig):
        self.config = config
        by_words: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item, text in rows:
            if w := tuple(words(text)):
                by_words[w].append(item)
        self.items = list(by_words.values())
        self.number: dict[str, int] = {}
        self.ids = [np.array([self.number.setdefault(w, len(self.number) + 2) for w in q], np.int64) for q in by_words]
        runs: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for q, ids in enumerate(self.ids):
            k = min(len(ids), seed_length(len(ids), config))
            for at in range(len(ids) - k + 1):
                runs[k][tuple(ids[at : at + k].tolist())].append((q, at))
        #: by length: the runs, and of each the questions and offsets it stands for (from ``first[i]`` to ``first[i + 1]``)
        self.runs = {}
        for k, r in runs.items():
            uses = np.array([x for xs in r.values() for x in xs], np.int64).reshape(-1, 2)
            first = np.concatenate([[0], np.cumsum([len(xs) for xs in r.values()])])
            self.runs[k] = np.array(list(r), np.int64), uses[:, 0], uses[:, 1], first


def common_in_order(masks: dict[int, int], m: int, passage: list[int]) -> int:
    """Length of the longest common subsequence; ``masks`` has a question's places of each word as bits."""
    row = whole = (1 << m) - 1
    for w in passage:
        if x := masks.get(w):
            u = row & x
            row = ((row + u) | (row - u)) & whole
    return m - row.bit_count()


def align(question: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: matched words, differing words, and the passage's bounds.

    A match scores 1, a replaced, missing or added word -1; of equal scores the one with more matches is taken. A cell is one
    number: score, matches and the number of words that lie after the alignment's first, so a row takes a few array operations.
    """
    n = len(passage)
    score, hit = np.int64(1) << np.int64(42), np.int64(1) << np.int64(21)
    # an alignment that begins at a place has the place itself in the lowest part
    fresh = np.arange(n + 1, dtype=np.int64)
    steps = np.arange(n + 1, dtype=np.int64) * score
    row, best, end = fresh, np.int64(0), 0
    for w in question:
        new = fresh.copy()
        np.maximum(new, row - score, out=new)  # missing
        np.maximum(new[1:], row[:-1] + np.where(passage == w, score + hit, -score), out=new[1:])
        new = np.maximum.accumulate(new + steps) - steps  # added
        # an alignment without a score begins anew
        row = np.where(new < score, fresh, new)
        at = int(row.argmax())
        if row[at] >> 21 > best >> 21:
            best, end = row[at], at
    points, hits = int(best >> 42), int(best >> 21) & (2**21 - 1)
    return hits, hits - points, int(best) & (2**21 - 1), end


def best_window(question: np.ndarray, passage: np.ndarray, config: LeakConfig) -> tuple[int, int, int, int] | None:
    """The window with most matches of which at most one word in ``tolerance`` differs: matched words, differing words, and its bounds.

    None if no window holds enough of the question. For each number of differing words the most matches are found, so neither
    ties nor a stretch of poor words inside cut off what lies beyond.
    """
    m, n = len(question), len(passage)
    one, whole = 1 << 32, max(1, config.tolerance - 1)
    faults = m // whole
    # matches in the upper half, the window's first word in the lower; a row for each number of differing words
    fresh = np.tile(np.arange(n + 1, dtype=np.int64), (faults + 1, 1))
    rows, most, end = fresh, np.zeros(faults + 1, np.int64), np.zeros(faults + 1, np.int64)
    for w in question:
        new = fresh.copy()
        np.maximum(new[:, 1:], np.where(passage == w, rows[:, :-1] + one, 0), out=new[:, 1:])
        if faults:
            np.maximum(new[1:], rows[:-1], out=new[1:])  # missing
            np.maximum(new[1:, 1:], rows[:-1, :-1], out=new[1:, 1:])  # replaced
            for e in range(1, faults + 1):
                np.maximum(new[e, 1:], new[e - 1, :-1], out=new[e, 1:])  # added
        at = new.argmax(axis=1)
        top = new[np.arange(faults + 1), at]
        more = top >> 32 > most >> 32
        most[more], end[more] = top[more], at[more]
        rows = new
    matched = most >> 32
    enough = (matched >= np.arange(faults + 1) * whole) & (matched * config.tolerance >= (config.tolerance - 1) * config.share * m - 1e-9) & (matched > 0)
    if not enough.any():
        return None
    e = int(np.argmax(np.where(enough, matched, -1)))
    return int(matched[e]), e, int(most[e] & (one - 1)), int(end[e])


def qualifies(matched: int, faults: int, n_words: int, config: LeakConfig) -> bool:
    """Half of the question's words, of which one in ``tolerance`` may differ, and three matches for each differing word."""
    return matched * config.tolerance >= (config.tolerance - 1) * config.share * n_words - 1e-9 and matched >= 3 * faults


def search_shard(texts: list[str | None], questions: Questions, shown: list[tuple[int, bool]] | None = None) -> list[tuple[int, int, int, int]]:
    """text (or number of the view, if ``shown`` lists views), question, first and last word (exclusive) of each place that qualifies."""
    get = questions.number.get
    shown = [(t, True) for t in range(len(texts))] if shown is None else shown
    ids = []
    for t, long_tags in shown:
        found = words(texts[t], long_tags)
        ids.append(np.fromiter((get(w, 1) for w in found), np.int32, len(found)))
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    # a text ends with an unknown word; of a run of unknown words one is indexed
    spaced = np.insert(flat, starts[1:], 1)
    keep = np.ones(len(spaced), bool)
    keep[1:] = (spaced[1:] != 1) | (spaced[:-1] != 1)
    where = np.flatnonzero(keep)
    if len(where) < 2:
        return []
    index = FMIndex(spaced[where])
    bounds = starts + np.arange(len(starts))
    regions = []
    for patterns, use, offset, first in questions.runs.values():
        low, high = index.search(patterns)
        hit = np.flatnonzero(high > low)
        # located in blocks, so a run that stands everywhere takes bounded memory
        for part in np.split(hit, np.searchsorted(np.cumsum((high - low)[hit]), np.arange(_BLOCK, max(_BLOCK, int((high - low).sum())), _BLOCK))):
            if not len(part):
                continue
            n = (high - low)[part]
            rows = np.repeat(low[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            at = where[index.locate(rows)]
            text = np.searchsorted(bounds, at, side="right") - 1
            pattern = np.repeat(part, n)
            uses = first[pattern + 1] - first[pattern]
            entry = np.repeat(first[pattern] - np.concatenate([[0], np.cumsum(uses)[:-1]]), uses) + np.arange(uses.sum())
            place = np.repeat(np.stack([text, at - bounds[text]]), uses, axis=1)
            regions.append(np.unique(np.stack([place[0], use[entry], place[1] - offset[entry]]), axis=1))
    if not regions:
        return []
    return _verify(np.unique(np.concatenate(regions, axis=1), axis=1), flat, starts, questions)


_BLOCK = 2_000_000


def _verify(places: np.ndarray, flat: np.ndarray, starts: np.ndarray, questions: Questions) -> list[tuple[int, int, int, int]]:
    """Each text and question once per region of near offsets. ``places``: text, question and offset, sorted."""
    out = []
    config = questions.config
    text, asked, shift = places
    margins = np.array([len(q) // config.tolerance + 3 for q in questions.ids], np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (asked[1:] != asked[:-1]) | (shift[1:] - shift[:-1] > margins[asked[1:]])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(text)) - 1
    masks: dict[int, dict[int, int]] = {}
    for t, q, lo, hi in zip(text[begin].tolist(), asked[begin].tolist(), shift[begin].tolist(), shift[last].tolist(), strict=True):
        ids = questions.ids[q]
        m = len(ids)
        reach = max(int(margins[q]), m // max(1, config.tolerance - 1))
        need = (config.tolerance - 1) / config.tolerance * config.share * m
        if q not in masks:
            masks[q] = defaultdict(int)
            for k, w in enumerate(ids.tolist()):
                masks[q][w] |= 1 << k
        low = max(0, lo - reach)
        high = min(int(starts[t + 1] - starts[t]), hi + m + reach)
        part = flat[starts[t] + low : starts[t] + high]
        common = common_in_order(masks[q], m, part.tolist())
        if common < need - 1e-9:
            continue
        best = best_window(ids, part, config)
        # a longer passage with more differing words may hold more of the question
        if best is None or best[0] < common:
            matched, faults, first, end = align(ids, part)
            if qualifies(matched, faults, m, config) and (best is None or matched > best[0]):
                best = matched, faults, first, end
        if best:
            out.append((t, q, low + best[2], low + best[3]))
    return out


def _word_spans(text: str, long_tags: bool = True) -> list[tuple[int, int]] | None:
    """Places of the words of ``words(text, long_tags)`` in the text itself; None if they can't be told."""
    wanted = len(words(text, long_tags))
    units, offsets, i = [], [], 0
    tags = iter(_tags(text, long_tags))
    tag = next(tags, None)
    n = len(text)
    while i < n:
        if tag and i == tag[0]:
            units.append(" ")
            offsets.append(i)
            i, tag = tag[1], next(tags, None)
            continue
        j = i + 1
        if text[i] == "&" and (m := re.compile(r"&#?\w{1,32};?").match(text, i)):
            j = m.end()
        while j < n and unicodedata.combining(text[j]):
            j += 1
        piece = normalize(text[i:j])
        units.append(piece)
        offsets.extend([i] * len(piece))
        i = j
    offsets.append(n)
    spans = [(offsets[m.start()], offsets[m.end() - 1] + 1) for m in _WORD.finditer("".join(units))]
    return spans if len(spans) == wanted else None


def find_leaks(documents: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """doc_id, item_id, start, end: each leaked item with the place of its passage in the text (characters)."""
    chosen = items.where(F.lower(F.trim("split")).isin(*config.splits) & F.col("question").isNotNull() & F.col("item_id").isNotNull())
    chosen = chosen.select("item_id", "question").distinct()
    if (size := chosen.agg(F.sum(F.octet_length("question"))).first()[0] or 0) > config.most_question_bytes:
        raise ValueError(f"the questions have {size} bytes, more than the {config.most_question_bytes} that travel with the code; search them in parts")
    questions = Questions(sorted((r["item_id"], r["question"]) for r in chosen.collect()), config)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1, config.shard_docs, config.shard_bytes):
                texts, ids = part.column(1).to_pylist(), part.column(0).to_pylist()
                shown = views(texts)
                out = []
                spans: dict[int, list | None] = {}
                for v, q, a, b in search_shard(texts, questions, shown):
                    t, long_tags = shown[v]
                    if v not in spans:
                        spans[v] = _word_spans(texts[t], long_tags)
                    where = (spans[v][a][0], spans[v][b - 1][1]) if spans[v] else (0, len(texts[t]))
                    out += [(ids[t], item, *where) for item in questions.items[q]]
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "end"])

    texts = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(run, "doc_id long, item_id long, start long, end long").distinct()


def leaked_items(leaks: DataFrame) -> DataFrame:
    return leaks.select("doc_id", "item_id").distinct()


def removal_spans(leaks: DataFrame) -> DataFrame:
    """doc_id, spans, items, n_chars: the merged places of a document's leaks, in order, and the items leaked."""
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]),
            F.concat(
                F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    out = leaks.groupBy("doc_id").agg(merged.alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    return out.withColumn("n_chars", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"]))
