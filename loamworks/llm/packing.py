"""Texts packed into containers of fixed capacity, with little room left over.

A text is split only if it alone exceeds the capacity: into full parts and one rest. Null texts and texts
without tokens take no room and are left out; a null or non-positive capacity is ignored, a repeated pack
counts once. Texts with equally many tokens are told apart by their id, repeated rows by nothing: an id must be unique.

Packing depends only on how many items there are of each size, and sizes are at most the capacity, so the plan is made
on the driver from a histogram of at most ``capacity`` rows, whatever the number of documents. Sets of items
that dominate every other choice for one of their items are fixed first (``reduce_dominated``, after Martello and Toth),
which shrinks the instance; the remainder is packed best-fit, largest first (``best_fit``). Both work on counts of equal
items at once. The plan gives each size ranges of ranks; each document finds its pack from its rank within its size.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.operators.prefix import running_total

Plan = list[tuple[dict[int, int], int]]
_PER_BUCKET = 500_000


class _Sizes:
    """Counts by size that only shrink, with the nearest size that is left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = [0] * (capacity + 2)
        for s, k in counts.items():
            self.n[s] = k
        self.down = [s if self.n[s] else s - 1 for s in range(capacity + 1)]
        self.down[0] = 0
        self.up = [s if s > capacity or (s and self.n[s]) else s + 1 for s in range(capacity + 2)]
        self.capacity = capacity

    def _find(self, link: list[int], s: int, stop: int) -> int:
        path = []
        while s != stop and not (0 < s <= self.capacity and self.n[s]):
            path.append(s)
            s = link[s] if link[s] != s else (s - 1 if link is self.down else s + 1)
        for p in path:
            link[p] = s
        return s

    def at_most(self, s: int) -> int:
        """The largest size left that is at most s, or 0."""
        return self._find(self.down, max(0, min(s, self.capacity)), 0)

    def at_least(self, s: int) -> int:
        """The least size left that is at least s, or capacity + 1."""
        return self._find(self.up, min(s, self.capacity + 1), self.capacity + 1)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Packs that some best packing contains, and the counts that remain.

    For an item s let t be the largest other item that fits beside it. The set {s, t} dominates all sets with s
    if it fills the pack, if no two others fit beside s, or if only two fit and t is no less than the best such
    pair; s alone does if nothing fits.
    """
    left, plan = _Sizes(counts, capacity), []
    changed = True
    while changed:
        changed = False
        s = left.at_most(capacity)
        while s:
            if (done := _dominant(left, s, capacity)) is not None:
                items, k = done
                for size, m in items.items():
                    left.n[size] -= m * k
                plan.append((items, k))
                changed = True
                s = left.at_most(s)
            else:
                s = left.at_most(s - 1)
    return plan, {s: k for s, k in enumerate(left.n) if k}


def _dominant(left: _Sizes, s: int, capacity: int) -> tuple[dict[int, int], int] | None:
    room, n = capacity - s, left.n
    t = left.at_most(room)
    if t == s and n[s] < 2:
        t = left.at_most(s - 1)
    if not t:
        return {s: 1}, n[s]
    pair = ({s: 2}, n[s] // 2) if t == s else ({s: 1, t: 1}, min(n[s], n[t]))
    if t == room:
        return pair
    # the three least items beside one s
    least: list[int] = []
    u = left.at_least(1)
    while len(least) < 3 and u <= capacity:
        least += [u] * min(3, n[u] - (u == s))
        u = left.at_least(u + 1)
    if len(least) < 2 or sum(least[:2]) > room:
        return pair
    if len(least) == 3 and sum(least) <= room:
        return None
    best, a = 0, t
    while a and 2 * a > best:
        b = left.at_most(min(a, room - a))
        if b and n[b] - (b == s) - (b == a) < 1:
            b = left.at_most(b - 1)
        best = max(best, a + b if b else 0)
        a = left.at_most(a - 1)
    return pair if t >= best else None


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit packing of counted sizes, largest first: each item goes where it leaves the least room."""
    rooms: list[int] = []
    open_: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}
    full: Plan = []

    def put(items: tuple[tuple[int, int], ...], room: int, k: int) -> None:
        if not room:
            full.append((dict(items), k))
            return
        if room not in open_:
            insort(rooms, room)
            open_[room] = {}
        open_[room][items] = open_[room].get(items, 0) + k

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                items, room, have = (), capacity, n
            else:
                room = rooms[i]
                items, have = next(iter(open_[room].items()))
            each = min(room // s, n)
            k = min(n // each, have)
            if i < len(rooms):
                if have == k:
                    del open_[room][items]
                    if not open_[room]:
                        del open_[room]
                        rooms.pop(i)
                else:
                    open_[room][items] = have - k
            put((*items, (s, each)), room - s * each, k)
            n -= k * each
    return full + [(dict(items), k) for by in open_.values() for items, k in by.items()]


def plan_packs(counts: dict[int, int], capacity: int) -> Plan:
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _ranges(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size: first rank of each range, its first pack, items per pack."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for items, k in plan:
        for s, m in items.items():
            out.setdefault(s, []).append((used.get(s, 0), first, m))
            used[s] = used.get(s, 0) + m * k
        first += k
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for s, rows in out.items()}


def pieces(counted: DataFrame, packs: DataFrame) -> DataFrame:
    """pack, capacity, doc_id, part, size: the items to be packed. ``counted``: doc_id, token_count."""
    kinds = packs.where("pack IS NOT NULL AND capacity_tokens > 0").groupBy("pack").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    docs = counted.where("token_count > 0 AND doc_id IS NOT NULL").select("doc_id", "token_count")
    # a pack list is a handful of rows given by the user, each of which takes every document: no join key exists
    rows = [(r["pack"], r["capacity"]) for r in kinds.orderBy("pack").collect()]
    if not rows:
        return docs.limit(0).select(F.lit("").alias("pack"), F.lit(0).cast("bigint").alias("capacity"), "doc_id", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("size"))
    listed = F.array(*[F.struct(F.lit(p).alias("pack"), F.lit(c).cast("bigint").alias("capacity")) for p, c in rows])
    each = docs.select("doc_id", "token_count", F.explode(listed).alias("p")).select("p.*", "doc_id", "token_count")
    last = F.floor((F.col("token_count") - 1) / F.col("capacity")).cast("bigint")
    parts = each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return parts.select("pack", "capacity", "doc_id", "part", F.least("capacity", F.col("token_count") - F.col("part") * F.col("capacity")).alias("size"))


def pack(counted: DataFrame, packs: DataFrame) -> DataFrame:
    """pack, pack_id, doc_id, part, n_tokens: one row per text, or per part of a text larger than the pack."""
    items = pieces(counted, packs)
    histogram = items.groupBy("pack", "capacity", "size").agg(F.count("*").alias("n")).toPandas()
    plans = {}
    for (name, capacity), rows in histogram.groupby(["pack", "capacity"]):
        plans[name] = _ranges(plan_packs(dict(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True)), int(capacity)))
    spark = counted.sparkSession
    split = spark.createDataFrame(
        [(r.pack, int(r.size_), max(1, int(r.n) // _PER_BUCKET)) for r in histogram.rename(columns={"size": "size_"}).itertuples()], "pack string, size bigint, _buckets bigint"
    )
    # at most one row per pack and size up to the capacity
    keyed = items.join(F.broadcast(split), ["pack", "size"]).withColumn("_key", F.pmod(F.xxhash64("doc_id", "part"), F.lit(2**31)))
    keyed = keyed.withColumn("_bucket", F.floor(F.col("_key") * F.col("_buckets") / F.lit(2**31)).cast("bigint"))
    ranked = running_total(keyed, ["pack", "size"], "_bucket", ["_key", "doc_id", "part"], F.lit(1), "rank")

    def place(batches):
        for batch in batches:
            names, sizes, ranks = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            out = np.zeros(len(sizes), np.int64)
            order = np.lexsort((sizes, np.array(names, dtype=object).astype(str))) if len(sizes) else np.empty(0, np.int64)
            i = 0
            while i < len(order):
                j = i
                key = (names[order[i]], sizes[order[i]])
                while j < len(order) and (names[order[j]], sizes[order[j]]) == key:
                    j += 1
                at = order[i:j]
                lo, first, each = plans[key[0]][int(key[1])]
                k = np.searchsorted(lo, ranks[at], side="right") - 1
                out[at] = first[k] + (ranks[at] - lo[k]) // each[k]
                i = j
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out), batch.column(3), batch.column(4), batch.column(1)], names=["pack", "pack_id", "doc_id", "part", "n_tokens"]
            )

    return ranked.select("pack", "size", F.col("rank").cast("bigint").alias("rank"), "doc_id", "part").mapInArrow(
        place, "pack string, pack_id bigint, doc_id bigint, part bigint, n_tokens bigint"
    )


def pack_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack, capacity, n_packs, n_items, n_tokens, fill (tokens per room), least_packs (no packing needs fewer)."""
    got = packed.groupBy("pack").agg(F.countDistinct("pack_id").alias("n_packs"), F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    kinds = packs.where("pack IS NOT NULL AND capacity_tokens > 0").groupBy("pack").agg(F.max("capacity_tokens").alias("capacity"))
    out = got.join(kinds, "pack")
    return out.select("pack", "capacity", "n_packs", "n_items", "n_tokens", (F.col("n_tokens") / (F.col("n_packs") * F.col("capacity"))).alias("fill"), F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_packs"))
