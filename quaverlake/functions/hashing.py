"""Seeded decisions by hash, so that they don't depend on order, partitions or engine."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def joined(*parts: Column | str | int) -> Column:
    """The parts as text, joined by NUL; strings are literals."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    with_nul = [x for c in columns for x in (F.lit(NUL), c.cast("string"))][1:]
    return F.concat(*with_nul)


def digest(*parts: Column | str | int) -> Column:
    """SHA-256 in hex."""
    return F.sha2(joined(*parts), 256)


def unit_interval(seed: int, namespace: str, value: Column) -> Column:
    """The first 64 bits of the digest as a number in [0, 1)."""
    return F.conv(F.substring(digest(namespace, seed, value), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def split_of(user: Column, seed: int, test_fraction: float) -> Column:
    return F.when(unit_interval(seed, "split", user) < test_fraction, "test").otherwise("train")


def pseudonym(user: Column, seed: int) -> Column:
    return F.substring(digest("pseudonym", seed, user), 1, 16)


def window_priority(user: Column, run: Column, start: Column, seed: int) -> Column:
    """Sixteen hex digits; as text they sort as the number does."""
    return F.substring(digest("window", seed, user, run, start), 1, 16)


def keyed_hash(column: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex; null stays null. Arrow-batched, for there is no built-in."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda v: None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest())

    return run(column)
