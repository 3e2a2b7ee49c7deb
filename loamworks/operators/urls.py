"""URL filter: blocked domains and their subdomains, and suspicious patterns, with the first reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.functions.text import authority

#: The default patterns, in order. ``$`` stands for the end of the URL.
DEFAULT_PATTERNS = (r"\.xxx$", "porn", "adult", "casino", "gambling", "viagra", "cialis", "pharm", r"\.onion$", "torrent", "warez", "crack", "keygen")


def with_url_reason(df: DataFrame, blocklist: DataFrame | None = None, patterns: tuple[str, ...] = DEFAULT_PATTERNS, url: str = "url") -> DataFrame:
    """Add ``reject_reason``: null passes.

    In order: the network location is in ``blocklist.domain`` (``blocklist_domain``), a parent domain is
    (``blocklist_parent_domain``), or a pattern occurs in the lower-cased URL (``pattern:<p>``). A null or empty URL
    passes. The blocklist is joined by each suffix of the domain, so it may be large.
    """
    low = F.lower(F.col(url))
    by_pattern = F.coalesce(*[F.when(low.rlike(p.replace("$", r"\z")), F.lit(f"pattern:{p}")) for p in patterns]) if patterns else F.lit(None).cast("string")
    if blocklist is None:
        return df.withColumn("reject_reason", F.when(F.coalesce(F.col(url), F.lit("")) != "", by_pattern))
    domains = blocklist.select(F.lower(F.trim("domain")).alias("_suffix")).where("_suffix <> ''").distinct().withColumn("_hit", F.lit(True))
    hosts = df.select(F.lower(authority(F.col(url))).alias("_host")).where("_host IS NOT NULL").distinct()
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("_suffix")))
    found = hosts.select("_host", F.explode(suffixes).alias("s")).select("_host", "s.*").join(domains, "_suffix").groupBy("_host").agg(F.min("depth").alias("_depth"))
    out = df.withColumn("_host", F.lower(authority(F.col(url)))).join(found, "_host", "left")
    reason = F.when(F.col("_depth") == 1, F.lit("blocklist_domain")).when(F.col("_depth") > 1, F.lit("blocklist_parent_domain")).otherwise(by_pattern)
    return out.withColumn("reject_reason", F.when(F.coalesce(F.col(url), F.lit("")) != "", reason)).drop("_host", "_depth")


def url_filter(df: DataFrame, blocklist: DataFrame | None = None, patterns: tuple[str, ...] = DEFAULT_PATTERNS, url: str = "url") -> DataFrame:
    return with_url_reason(df, blocklist, patterns, url).where("reject_reason IS NULL").drop("reject_reason")
