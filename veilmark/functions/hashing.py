"""Hashes as Columns. Every random choice in the package is an index drawn from SHA-256, so that any engine can replay it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by |."""
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def short_hash(*parts: Column | str, n: int = 12) -> Column:
    return F.substring(digest(*parts), 1, n)


def stable_seed(*parts: Column | str) -> Column:
    """A positive 63-bit seed from the first 16 hex digits."""
    return (F.conv(F.substring(digest(*parts), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint")


def draw(n: Column, *parts: Column | str) -> Column:
    """An index from 0 to n - 1."""
    return F.pmod(F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint"), n.cast("bigint"))


def content_hash(rows: Column) -> Column:
    """Aggregate: a hash of all rows' texts that does not depend on their order: the sums of their digests' words and the count, hashed.

    Sums are decimals, so they combine on the way and no task holds the rows.
    """
    one = F.sha2(rows, 256)
    words = [F.sum(F.conv(F.substring(one, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")) for k in range(8)]
    return F.sha2(F.concat_ws("|", *(F.coalesce(w, F.lit(0).cast("decimal(38,0)")).cast("string") for w in words), F.count(rows).cast("string")), 256)


def set_hash(ids: Column) -> Column:
    """Aggregate: the same of a set's ids, each of which comes once: nothing is told apart again. Nulls do not count."""
    one = F.sha2(ids.cast("string"), 256)
    words = [F.sum(F.conv(F.substring(one, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return F.sha2(F.concat_ws("|", *(F.coalesce(w, F.lit(0).cast("decimal(38,0)")).cast("string") for w in words), F.count(ids).cast("string")), 256)
