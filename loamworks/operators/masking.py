"""Masks for email addresses and public IPv4 addresses; emails go first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.functions.text import EMAIL, PUBLIC_IPV4


def mask_addresses(
    df: DataFrame, emails: bool = True, ips: bool = True, email_mask: str = "[EMAIL]", ip_mask: str = "[IP_ADDRESS]", text: str = "text"
) -> DataFrame:
    """Replace addresses in ``text`` and add their numbers as ``pii_emails_masked`` and ``pii_ips_masked``."""
    literal = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    out = df.withColumn("pii_emails_masked", F.coalesce(F.regexp_count(text, F.lit(EMAIL)), F.lit(0)).cast("bigint") if emails else F.lit(0).cast("bigint"))
    if emails:
        out = out.withColumn(text, F.regexp_replace(text, EMAIL, literal(email_mask)))
    out = out.withColumn("pii_ips_masked", F.coalesce(F.regexp_count(text, F.lit(PUBLIC_IPV4)), F.lit(0)).cast("bigint") if ips else F.lit(0).cast("bigint"))
    if ips:
        out = out.withColumn(text, F.regexp_replace(text, PUBLIC_IPV4, literal(ip_mask)))
    return out


def mask_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum("pii_emails_masked"), F.lit(0)).alias("emails_masked"), F.coalesce(F.sum("pii_ips_masked"), F.lit(0)).alias("ips_masked"))
