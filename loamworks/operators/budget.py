"""Token budgets, caps and samples. All orders are explicit; running totals are distributed (``prefix``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.operators.prefix import running_total_by_order
from loamworks.session import materialize


def _tokens(tokens: str) -> Column:
    return F.coalesce(F.col(tokens), F.lit(0)).cast("bigint")


def _before(df: DataFrame, order: str, end) -> DataFrame:
    return df if end is None else df.where(F.col(order) < F.lit(end))


def budget_end(df: DataFrame, most: int, order: str = "doc_id", tokens: str = "token_count", counted: Column | None = None):
    """The place of the first document that would exceed ``most`` tokens, after all ``counted`` ones before it; None if there is none.

    Only the order and two numbers of each document are moved; the selection is then a comparison with one value.
    """
    slim = df.select(F.col(order).alias("o"), _tokens(tokens).alias("n"), (F.lit(True) if counted is None else counted).alias("c"))
    placed = running_total_by_order(slim, ["o"], F.when(F.col("c"), F.col("n")).otherwise(F.lit(0).cast("bigint")), "_ahead")
    return placed.where(F.col("_ahead") + F.col("n") > most).agg(F.min("o").alias("e")).first()["e"]


def within_budget(df: DataFrame, most: int, order: str = "doc_id", tokens: str = "token_count") -> DataFrame:
    """The documents before the first one that would exceed ``most`` tokens in all."""
    return _before(df, order, budget_end(df, most, order, tokens))


def until_target(df: DataFrame, target: int, order: str = "doc_id", tokens: str = "token_count") -> DataFrame:
    """Documents in order until the total reaches ``target``; the one that reaches it is the last."""
    placed = running_total_by_order(df.select(F.col(order).alias("o"), _tokens(tokens).alias("n")), ["o"], F.col("n"), "_ahead")
    return _before(df, order, placed.where(F.col("_ahead") >= target).agg(F.min("o").alias("e")).first()["e"])


def full_points(df: DataFrame, caps: dict[str, int], order: str = "doc_id", tokens: str = "token_count", tags: str = "slice_tags") -> dict[str, object]:
    """The place of the document that fills each capped tag (None: full from the start); tags that never fill up are left out.

    Equal to going through the documents one by one. Once a tag is full it stays full, so the outcome follows from these places. If
    no document has two capped tags, one running total by tag gives them all. Else they are found one after another: the earliest
    among the tags still open, given the tags already full; there are as many rounds as caps that bind.
    """
    slim = df.select(F.col(order).alias("o"), _tokens(tokens).alias("n"), F.array_distinct(F.filter(tags, lambda t: t.isin(*caps))).alias("t")).where(F.size("t") > 0)
    slim = materialize(slim)
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("tag"))
    full: dict[str, object] = {tag: None for tag, most in caps.items() if most <= 0}

    def reached(rows: DataFrame) -> DataFrame:
        placed = running_total_by_order(rows, ["o"], F.col("n"), "_ahead", group=["tag"])
        return placed.where(F.col("_ahead") + F.col("n") >= cap).groupBy("tag").agg(F.min("o").alias("o"))

    if slim.where(F.size("t") > 1).isEmpty():
        rows = slim.select("o", "n", F.col("t")[0].alias("tag"))
        return full | {r["tag"]: r["o"] for r in reached(rows).collect() if r["tag"] not in full}
    while len(full) < len(caps):
        open_rows = slim.where(_accepted(F.col("t"), F.col("o"), full)).select("o", "n", F.explode("t").alias("tag"))
        first = reached(open_rows.where(~F.col("tag").isin(*full) if full else F.lit(True))).orderBy("o", "tag").first()
        if first is None:
            break
        full[first["tag"]] = first["o"]
    return full


def capped(df: DataFrame, caps: dict[str, int], order: str = "doc_id", tokens: str = "token_count", tags: str = "slice_tags") -> DataFrame:
    """Reject a document if any of its tags has reached its cap; accepted documents count for all their tags."""
    return df.where(_accepted(F.col(tags), F.col(order), full_points(df, caps, order, tokens, tags)))


def _accepted(tags: Column, order: Column, full: dict[str, object]) -> Column:
    """No tag of the document was full before it; a tag filled at None was full from the start."""
    ok = F.lit(True)
    for tag, at in full.items():
        late = F.lit(True) if at is None else order > F.lit(at)
        ok = ok & ~(F.coalesce(F.array_contains(tags, tag), F.lit(False)) & late)
    return ok


def selection(df: DataFrame, most: int, caps: dict[str, int] | None = None, order: str = "doc_id", tokens: str = "token_count", tags: str = "slice_tags") -> tuple[Column, object]:
    """The condition of the documents that budget and caps select, and the place of the document that ends the selection (None: none does).

    A document, accepted or not, that would exceed the budget ends it.
    """
    ok = _accepted(F.col(tags), F.col(order), full_points(df, caps, order, tokens, tags)) if caps else F.lit(True)
    end = budget_end(df, most, order, tokens, ok)
    return (ok if end is None else ok & (F.col(order) < F.lit(end))), end


def capped_within_budget(df: DataFrame, caps: dict[str, int], most: int, order: str = "doc_id", tokens: str = "token_count", tags: str = "slice_tags") -> DataFrame:
    """Caps and a budget together."""
    return df.where(selection(df, most, caps, order, tokens, tags)[0])


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from an md5 of seed and key; the same on every engine that has md5."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 12), 16, 10).cast("double")
    return (digits + 1) / (2.0**48 + 1)


def first_rows(df: DataFrame, keys: dict[str, Column], n: int) -> DataFrame:
    """The ``n`` rows of least keys (unique, not null), as ``orderBy(keys).limit(n)`` but without bringing them to one place.

    Ranks over ranges of the keys find the last key; the rows are those up to it.
    """
    if n <= 0:
        return df.limit(0)
    placed = running_total_by_order(df.select(*[c.alias(k) for k, c in keys.items()]), list(keys), F.lit(1), "_rank")
    last = placed.where(F.col("_rank") == n - 1).first()
    return df if last is None else df.where(_upto(keys, last))


def _upto(keys: dict[str, Column], last) -> Column:
    return F.struct(*[c.alias(k) for k, c in keys.items()]) <= F.struct(*[F.lit(last[k]).alias(k) for k in keys])


def weighted_sample(df: DataFrame, n: int, weights: dict[str, float] | None = None, temperature: float = 1.0, seed: int = 42, id_col: str = "doc_id", tags: str = "slice_tags") -> DataFrame:
    """Draw ``n`` documents without replacement, with chances in proportion to their weight (Efraimidis and Spirakis).

    A document weighs as much as its first tag that ``weights`` names, to the power 1 / temperature, else 1; documents without
    tags are never drawn, those of weight 0 last.
    """
    w = F.lit(1.0)
    for tag, value in reversed(list((weights or {}).items())):
        w = F.when(F.array_contains(tags, tag), F.lit(float(value) ** (1.0 / temperature))).otherwise(w)
    key = F.when(w > 0, -F.ln(uniform(F.col(id_col), seed)) / w).otherwise(F.lit(float("inf")))
    drawn = df.where(F.size(tags) > 0).withColumn("sample_weight", w)
    return first_rows(drawn, {"_key": key, "_id": F.col(id_col)}, n)


def ratio_mix(df: DataFrame, ratios: dict[str, float], target: int, seed: int = 42, id_col: str = "doc_id", domain: str = "domain") -> DataFrame:
    """Per domain the ``int(target * ratio)`` documents of least hash, ``target`` documents at most in all."""
    keys = {"_key": uniform(F.col(id_col), seed), "_id": F.col(id_col)}
    quotas = {k: int(target * r) for k, r in ratios.items() if int(target * r) > 0}
    if not quotas:
        return df.limit(0)
    named = df.where(F.col(domain).isin(*quotas)).select(F.col(domain).alias("_domain"), *[c.alias(k) for k, c in keys.items()])
    quota = F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col("_domain"))
    ranked = running_total_by_order(named, ["_key", "_id"], F.lit(1), "_rank", group=["_domain"])
    # one row per domain that has more than its quota
    last = {r["_domain"]: r for r in ranked.where(F.col("_rank") == quota - 1).collect()}
    ok = F.lit(False)
    for name in quotas:
        ok = ok | ((F.col(domain) == name) & (_upto(keys, last[name]) if name in last else F.lit(True)))
    kept = df.where(ok)
    return first_rows(kept, keys, target) if sum(quotas.values()) > target else kept
