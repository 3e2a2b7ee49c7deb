"""An exact similarity join of sets, and the classes of equal sets.

Equal sets form a class and take part as one set, so a group of copies costs no more than its number of rows, however large
it is. Classes are joined by signatures of segments of the universe (``setjoin``), candidates are verified on the whole sets.

On disk a signature takes about as many bytes however many buckets there are: its set is named by the size and half of the
fingerprint (``short_names``), and keys are only as long as the number of signatures asks for. Sets of one short name are candidates by themselves.
Sets are only written, and shuffled, if they are in a candidate pair.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.operators import setjoin
from loamworks.operators.setjoin import HASH_BITS, mix
from loamworks.session import materialize, scratch, shuffle_partitions, step_path

_KEY_BITS = 40
_BATCH = 4096
#: The part of a short name that is the size of the set.
_SIZE = np.int64(2**32 - 1)


@dataclass(frozen=True)
class JoinConfig:
    """``threshold``: least Jaccard similarity. The rest changes the cost, never the result.

    ``frequent``: how many of the most frequent elements steer the choice of segments. ``bucket_entries``: signatures in a bucket, on average;
    a task holds one bucket at a time. ``hot_entries``: a segment that more sets have is compared in parts of this size by tasks of their own.
    ``filter_bits``: of the filter for documents in a candidate pair at most.
    """

    threshold: float
    frequent: int = 200_000
    bucket_entries: int = 4_000_000
    hot_entries: int = 20_000
    filter_bits: int = 26


@dataclass(frozen=True)
class SetKind:
    """How documents become sets. ``rows``: what goes to Python of rows with ``doc_id`` (long) first. ``sets``: ids, distinct sorted hashes and
    bounds of pieces of at most so many rows of it."""

    rows: Callable[[DataFrame], DataFrame]
    sets: Callable[[Iterator[pa.RecordBatch], int], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set; zero for empty ones."""
    sizes = np.diff(bounds)
    if not len(sets):
        return np.zeros(len(sizes), np.int64)
    total = np.add.reduceat(np.append(mix(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)), np.uint64(0)), bounds[:-1])
    return np.where(sizes > 0, mix(total + sizes.astype(np.uint64)), np.uint64(0)).view(np.int64)


def short_names(fp: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The upper half of the fingerprint and the size in one number; few different sets share one."""
    return (fp & ~_SIZE) | sizes.astype(np.int64)


def _short_name() -> Column:
    return F.shiftleft(F.shiftright("fp", 32), 32).bitwiseOR(F.col("n"))


def _key_bits(entries: int, buckets: int) -> int:
    """Bits of a key within its bucket, so that about one in 16,000 of all entries meets another by chance."""
    return min(_KEY_BITS, max(16, math.ceil(math.log2(max(2, entries))) + 13 - int(math.log2(buckets))))


def _scan(rows: DataFrame, kind: SetKind) -> DataFrame:
    """One row per document with its fingerprint, and the frequent elements of each batch."""

    def run(batches):
        for ids, sets, bounds in kind.sets(batches, 2 * _BATCH):
            sizes = np.diff(bounds)
            some = sizes > 0
            seen, counts = np.unique(sets, return_counts=True)
            often = counts >= 3
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(some.sum(), np.int8), np.ones(often.sum(), np.int8)])),
                    pa.array(np.concatenate([ids[some], seen[often].view(np.int64)])),
                    pa.array(np.concatenate([fingerprints(sets, bounds)[some], np.zeros(often.sum(), np.int64)])),
                    pa.array(np.concatenate([sizes[some], counts[often]])),
                ],
                names=["kind", "key", "fp", "n"],
            )

    return kind.rows(rows).mapInArrow(run, "kind byte, key long, fp long, n long")


def _pack(sig: np.ndarray, owner: np.ndarray, flags: np.ndarray, short: np.ndarray) -> bytes:
    """A bucket's entries of one batch: sorted keys as differences, byte by byte, so that they compress.

    Sets are numbered as they first occur, and told by how far their number is below the next new one, so that most are zero in small buckets.
    """
    order = np.argsort(sig)
    sig, owner, flags = sig[order], owner[order], flags[order]
    used, first, at = np.unique(owner, return_index=True, return_inverse=True)
    by_first = np.argsort(first)
    number = np.empty(len(used), np.int64)
    number[by_first] = np.arange(len(used))
    new = np.zeros(len(sig), np.int64)
    new[first] = 1
    back = np.cumsum(new) - new - number[at]
    step = np.diff(sig, prepend=np.uint64(0))
    planes = [(step >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(5)]
    packed = back.astype(np.uint16) | (flags.astype(np.uint16) << np.uint16(13))
    names = short[used[by_first]].view(np.uint8).reshape(-1, 8)
    head = struct.pack("<II", len(sig), len(used))
    body = [*planes, (packed & np.uint16(255)).astype(np.uint8).tobytes(), (packed >> np.uint16(8)).astype(np.uint8).tobytes(), names.T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *body]))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, short names and flags."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, used = struct.unpack_from("<II", data)
    planes = np.frombuffer(data, np.uint8, 7 * n, 8).reshape(7, n)
    step = sum(planes[k].astype(np.uint64) << np.uint64(8 * k) for k in range(5))
    packed = planes[5].astype(np.uint16) | (planes[6].astype(np.uint16) << np.uint16(8))
    back = (packed & np.uint16(0x1FFF)).astype(np.int64)
    names = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * used, 8 + 7 * n).reshape(8, used).T).view(np.int64).ravel()
    # a set is new where its number is the next one
    before = np.cumsum(back == 0) - (back == 0)
    return np.cumsum(step, dtype=np.uint64), names[before - back], (packed >> np.uint16(13)).astype(np.uint8)


def _most_frequent(counted: DataFrame, most: int) -> pa.Table:
    """At most ``most`` keys of the highest counts: those above the count at which there would be more.

    The count is read off a histogram, so tasks send only keys that are used.
    """
    least, total = None, 0
    for r in counted.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toLocalIterator():
        total += r["k"]
        if total > most:
            break
        least = r["n"]
    chosen = counted.where(F.col("n") >= least) if least is not None else counted.limit(0)
    return chosen.select("key", "n").toArrow()


def _candidates(rows: DataFrame, kind: SetKind, config: JoinConfig, hot: tuple[np.ndarray, np.ndarray], elements: int) -> DataFrame:
    """Pairs of short names (``a`` of the larger set) that share enough segments, written. ``elements``: of all sets.

    Signatures are dealt into buckets by their upper bits, as many as the number of elements asks for. A task goes through its
    buckets one after the other. Segments that very many sets have leave it unmatched, as soon as a bucket outgrows its
    size or at its end, and are matched in a second step, each in parts that different tasks compare.
    """
    # a set has about as many signatures as elements, small ones up to three times as many
    buckets = min(2**23, max(shuffle_partitions(rows.sparkSession), 2 * elements // config.bucket_entries + 1))
    key_bits = _key_bits(2 * elements, buckets)
    bands = setjoin.Bands(config.threshold)
    most, limit = config.hot_entries, 4 * config.bucket_entries

    def sign(batches):
        for _, sets, bounds in kind.sets(batches, _BATCH):
            fp, sizes = fingerprints(sets, bounds), np.diff(bounds)
            _, first = np.unique(fp, return_index=True)
            once = np.zeros(len(fp), bool)
            once[first] = True
            once &= sizes > 0
            sets = sets[np.repeat(once, sizes)]
            short, sizes = short_names(fp[once], sizes[once]), sizes[once]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            sig, owner, flags = setjoin.signatures(sets, bounds, bands, hot)
            bucket = ((sig >> np.uint64(_KEY_BITS)) % np.uint64(buckets)).astype(np.int64)
            key = sig & np.uint64(2**key_bits - 1)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            filled = np.flatnonzero(np.diff(cut))
            blobs = [_pack(*(x[order[cut[k] : cut[k + 1]]] for x in (key, owner, flags)), short) for k in filled]
            yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def pairs_or_entries(a, b=None, n=None, key=None, flags=None):
        none = np.ones(len(a), bool)
        columns = [pa.array(x if x is not None else a, pa.int64(), mask=none if x is None else None) for x in (a, b, n, key)]
        columns.append(pa.array(np.zeros(len(a), np.int8) if flags is None else flags.astype(np.int8)))
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "key", "flags"])

    def bucket_rows(k, blobs):
        """The candidates of one bucket, and the entries of its hot segments."""
        held: list[tuple[np.ndarray, ...]] = []
        hot_keys = np.empty(0, np.uint64)
        size, allowed = 0, limit

        def part(entries, chosen):
            sig, short, flags = (x[chosen] for x in entries)
            return pairs_or_entries(short, key=(sig | np.uint64(k << _KEY_BITS)).view(np.int64), flags=flags)

        def hottest(sig):
            keys, n = np.unique(sig, return_counts=True)
            return keys[n > most]

        for blob in blobs:
            entries = _unpack(blob)
            sig = entries[0]
            known = np.isin(sig, hot_keys)
            if known.any():
                yield part(entries, known)
                entries = tuple(x[~known] for x in entries)
            held.append(entries)
            size += len(entries[0])
            if size > allowed:
                whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                hot_keys = np.union1d(hot_keys, hottest(whole[0]))
                known = np.isin(whole[0], hot_keys)
                if known.any():
                    yield part(whole, known)
                held = [tuple(x[~known] for x in whole)]
                size = len(held[0][0])
                allowed = max(limit, 2 * size)
        sig, short, flags = (np.concatenate(x) for x in zip(*held, strict=True))
        known = np.isin(sig, hottest(sig))
        if known.any():
            yield part((sig, short, flags), known)
            sig, short, flags = (x[~known] for x in (sig, short, flags))
        yield pairs_or_entries(*_matched(sig, short, flags, bands))

    def match(batches):
        # a task's buckets come in order; keys of different buckets must not meet
        stream = ((k, blob) for batch in batches for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for k, group in groupby(stream, key=itemgetter(0)):
            yield from bucket_rows(k, (blob for _, blob in group))

    path = step_path(rows.sparkSession)
    with scratch():
        signed = kind.rows(rows).mapInArrow(sign, "bucket int, blob binary")
        met = signed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(match, "a long, b long, n long, key long, flags byte")
        met = materialize(met)
        pairs, left = met.where("key IS NULL").select("a", "b", "n"), met.where("key IS NOT NULL").select("key", F.col("a").alias("short"), "flags")
        if not left.isEmpty():
            pairs = pairs.union(_hot_pairs(left.distinct(), bands, most))
        return materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= bands.shared).select("a", "b"), path)


def _matched(sig: np.ndarray, short: np.ndarray, flags: np.ndarray, bands: setjoin.Bands, halves: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """a, b and shared segments of entries; with ``halves`` (a boolean by entry) only pairs across them."""
    names, owner = np.unique(short, return_inverse=True)
    by_owner = names & _SIZE
    # copies from different batches give the same entries
    order = np.lexsort((flags, owner, sig))
    sig, owner, flags = sig[order], owner[order], flags[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1]) | (flags[1:] != flags[:-1])
    a, b, n = setjoin.matches(sig[new], owner[new], flags[new], by_owner, bands)
    if halves is not None:
        side = np.zeros(len(names), bool)
        side[owner] = halves[order]
        across = side[a] != side[b]
        a, b, n = a[across], b[across], n[across]
    return names[a], names[b], n


def _hot_pairs(entries: DataFrame, bands: setjoin.Bands, most: int) -> DataFrame:
    """a, b, n of hot segments: the sets of each are dealt into parts of about ``most``, and every two parts meet in a task of their own."""
    sizes = entries.groupBy("key").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = entries.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("short"), F.col("parts")).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("part", k).alias("x"), F.greatest("part", k).alias("y")))
    dealt = dealt.select("key", "short", "flags", "part", F.explode(mates).alias("p")).select("key", "short", "flags", "part", "p.*")

    def compare(key, table):
        x, y = key[1].as_py(), key[2].as_py()
        short, flags, part = (table.column(c).to_numpy() for c in ("short", "flags", "part"))
        a, b, shared = _matched(np.zeros(len(short), np.uint64), short, flags.astype(np.uint8), bands, None if x == y else part == x)
        return pa.table({"a": a, "b": b, "n": shared})

    return dealt.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long, n long")


def _sets(rows: DataFrame, kind: SetKind) -> DataFrame:
    def run(batches):
        for _, sets, bounds in kind.sets(batches, _BATCH):
            # the upper 48 bits of each hash, still sorted
            raw = (sets >> np.uint64(HASH_BITS - 48)).view(np.uint8).reshape(-1, 8)[:, :6]
            parts = [raw[bounds[k] : bounds[k + 1]].tobytes() for k in range(len(bounds) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(fingerprints(sets, bounds)), pa.array(parts, pa.binary())], names=["fp", "members"])

    return kind.rows(rows).mapInArrow(run, "fp long, members binary")


def filtered(rows: DataFrame, ids: DataFrame, most_bits: int = JoinConfig.filter_bits) -> DataFrame:
    """The rows whose ``doc_id`` is among ``ids``, and a few others: by a filter of bounded size, so that the rows stay where they are."""
    bits = min(most_bits, max(10, math.ceil(math.log2(16 * max(1, ids.count())))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(2**bits)).cast("long")
    marks = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("marks"))
    found = rows.withColumn("p", place).withColumn("word", F.shiftright("p", 6)).join(F.broadcast(marks), "word")
    return found.where("shiftright(marks, CAST(p % 64 AS INT)) & 1 = 1").select(rows.columns)


def _members(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b, left, right = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for k in range(len(a)):
                x, y = _members(left[k]), _members(right[k])
                common = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - common
                if common >= threshold * either - 1e-9:
                    keep.append((a[k], b[k], common, either))
            cols = list(zip(*keep, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "common", "either"])

    return pairs.mapInArrow(run, "a long, b long, common long, either long")


def similar_sets(rows: DataFrame, kind: SetKind, config: JoinConfig) -> tuple[DataFrame, DataFrame]:
    """``classes``: doc_id, fp, n (size of the set), class_id (least id with that set), copies; ``links``: class_a <= class_b, common, either
    (elements in both and in either set) for all pairs of classes at or above the threshold. Documents without elements are in neither."""
    path = step_path(rows.sparkSession)
    scanned = materialize(_scan(rows, kind))
    often = _most_frequent(scanned.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), config.frequent)
    keys, counts = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    order = np.argsort(keys)
    members = scanned.where("kind = 0").select(F.col("key").alias("doc_id"), "fp", "n").distinct()
    first = materialize(members.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.max("n").alias("n")))
    elements = first.agg(F.sum("n")).first()[0] or 0
    with scratch():
        met = _candidates(rows, kind, config, (keys[order], counts[order].astype(np.float32)), elements)
        named = first.select("fp", _short_name().alias("short"))
        of = lambda end: named.select(F.col("fp").alias(f"fp_{end}"), F.col("short").alias(end))
        alike = named.groupBy("short").agg(F.array_sort(F.collect_list("fp")).alias("x")).where(F.size("x") > 1)
        alike = alike.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b")).where("a < b")
        pairs = materialize(met.join(of("a"), "a").join(of("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).union(alike))

        needed = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
        needed = materialize(first.join(needed, "fp", "left_semi").select("fp", F.col("class_id").alias("doc_id")))
        sets = _sets(filtered(rows, needed.select("doc_id"), config.filter_bits), kind)
        sets = materialize(sets.join(needed.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))
        both = pairs.join(sets.select(F.col("fp").alias("b"), F.col("members").alias("right")), "b")
        both = both.join(sets.select(F.col("fp").alias("a"), F.col("members").alias("left")), "a").select("a", "b", "left", "right")
        found = _verified(both, config.threshold)
        found = found.join(first.select(F.col("fp").alias("a"), F.col("class_id").alias("x")), "a").join(
            first.select(F.col("fp").alias("b"), F.col("class_id").alias("y")), "b"
        )
        links = materialize(found.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "common", "either"), path)
    return members.join(first.select("fp", "class_id", "copies"), "fp"), links
