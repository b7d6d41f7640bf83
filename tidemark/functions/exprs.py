"""Column expressions shared by the operators. All stay on the JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a naive timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast(`{ts}` as timestamp_ntz))")


def from_micros(us: str) -> Column:
    """The naive timestamp of microseconds since the epoch."""
    return F.expr(f"timestampadd(MICROSECOND, `{us}`, {EPOCH})")


def elapsed_us(later: Column, earlier: Column) -> Column:
    """Microseconds between two naive timestamps, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", earlier, later)


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed days, floored; not calendar days."""
    return F.floor(elapsed_us(later, earlier) / F.lit(86_400_000_000)).cast("int")


def pct_change(new: Column, old: Column, zero_base: Column | None = None) -> Column:
    """Per cent change. A zero base gives ``zero_base``, or 100 for a positive new value and 0 otherwise."""
    other = F.when(new > 0, F.lit(100.0)).otherwise(F.lit(0.0)) if zero_base is None else zero_base
    return F.when(old != 0, (new - old) / old * 100).otherwise(other)


def md5_mod(text: Column, modulus: int) -> Column:
    """The MD5 of a text as an unsigned 128-bit integer, modulo a number: Horner's rule over four 32-bit words."""
    digest, base = F.md5(text), 2**32 % modulus
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    return reduce(lambda r, w: (r * base + w) % modulus, words[1:], words[0] % modulus)


def quantile_bin(x: Column, edges: Column) -> Column:
    """Index of the right-closed value bin of ``x`` among sorted distinct ``edges``; the lowest edge belongs to bin 0."""
    below = F.size(F.filter(edges, lambda e: e < x)) - 1
    return F.greatest(below, F.lit(0))


#: Names whose values are secrets.
SECRETS = r"(?i)(password|passwd|pwd|secret|token|api_key|apikey|private_key)(\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|[^\s,;&]+)"


def redact(text: Column) -> Column:
    """A text with the values of secrets masked."""
    return F.regexp_replace(text, F.lit(SECRETS), F.lit("$1$2***"))


def sha256_key(sql: Column, params: Column) -> Column:
    """The cache key of an SQL text (lower case, single blanks) and its parameters as JSON."""
    return F.sha2(F.concat(F.lower(F.trim(F.regexp_replace(sql, r"\s+", " "))), F.lit("|"), params), 256)
