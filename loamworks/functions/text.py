"""Column functions over text; all run in the JVM and return null for null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that separate words: every Unicode white space, as Python's ``str.split`` has it. Those beyond Latin-1 stand behind one range, so that most characters are decided by two tests.
SPACE = r" \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once for each row, whatever reads it.

    Otherwise a filter on it would be pushed below, and the expression be computed again for each mention in the filter.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def words(text: Column) -> Column:
    """The parts between white space."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def lines(text: Column) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), f"[{SPACE}]+", " "))


def content_hash(text: Column, normalize: bool = True) -> Column:
    return F.sha2(normalized(text) if normalize else text, 256)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: inside a lambda a plain expression would be evaluated for every element."""
    return F.transform(F.array(value), f)[0]


def _runs(items: Column, n: int, make: Callable[[Column], Column], kind: str) -> Column:
    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: make(F.slice(w, i, n)))).otherwise(F.array().cast(f"array<{kind}>"))

    return bound(items, runs)


def ngrams(items: Column, n: int) -> Column:
    """Runs of ``n`` items joined by spaces; a shorter list that is not empty is one run; none for an empty one."""
    return _runs(items, n, lambda x: F.array_join(x, " "), "string")


def ngram_hashes(items: Column, n: int) -> Column:
    """64-bit hashes of the same runs, without building their strings."""
    return _runs(items, n, F.xxhash64, "bigint")


def count_chars(text: Column, char_class: str) -> Column:
    """Number of characters of a class given as a regex class body, such as ``\\p{L}``."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]", ""))


def authority(url: Column) -> Column:
    """The network location of a URL with user and port, as written; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


#: The patterns of masked addresses. The class ``[A-Z|a-z]`` admits a bar, as the rule has it.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PUBLIC_IPV4 = r"\b(?!10\.)(?!127\.)(?!172\.(?:1[6-9]|2[0-9]|3[01])\.)(?!192\.168\.)(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
