"""Word splitting and rolling hashes as column expressions, so that they run inside the JVM.

A null text counts as empty everywhere. Positions count from 0. Explode these arrays with posexplode_outer: for
posexplode Spark infers a filter on the array and pushes it below each step that made it, repeating its expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between two words once A-Z are lower case: ASCII but 0-9 and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONG_MIN = -(1 << 63)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; pure ASCII texts take the faster route."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _both(df: DataFrame, name: str, source: str, shift: int, combine) -> DataFrame:
    """name[i] = combine(source[i], source[i + shift]), as long as both exist."""
    n = F.greatest(F.size(source) - shift, F.lit(0))
    return df.withColumn(name, F.zip_with(F.slice(source, 1, n), F.slice(source, F.lit(shift + 1), n), combine))


def _doubled(df: DataFrame, name: str, source: str, width: int, combine) -> DataFrame:
    """combine over every `width` neighbours, by doubling; combine(x, y) may see overlapping ranges."""
    have = 1
    df = df.withColumn(name, F.col(source))
    while have < width:
        shift = min(have, width - have)
        df = _both(df, name, name, shift, combine)
        have += shift
    return df


def with_gram_hashes(df: DataFrame, name: str, hashes: str, k: int) -> DataFrame:
    """Adds the hash of every run of k words; `hashes` holds one hash per word."""
    return _doubled(df, name, hashes, k, lambda x, y: F.xxhash64(x, y))


def with_winnowed(df: DataFrame, name: str, grams: str, width: int) -> DataFrame:
    """Adds grams with all but the minima of each `width` neighbours set to null.

    Every minimum is kept, ties included, so the choice depends only on the words of the window: texts that share
    width + k - 1 words keep the same gram in the shared part.
    """
    df = _doubled(df, name, grams, width, lambda x, y: F.least(x, y))
    edge = F.array_repeat(F.lit(LONG_MIN), width - 1)
    df = df.withColumn(name, F.concat(edge, F.col(name), edge))
    df = _doubled(df, name, name, width, lambda x, y: F.greatest(x, y))
    return df.withColumn(name, F.zip_with(grams, name, lambda x, y: F.when(x == y, x)))


def salted(grams: str, n: int) -> Column:
    """The hashes of `grams` made different from those of grams of another length n."""
    return F.transform(grams, lambda x: F.xxhash64(x, F.lit(n)))
