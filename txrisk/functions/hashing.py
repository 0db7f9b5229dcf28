"""Deterministic randomness from row keys.

``rand(seed)`` depends on the partition layout, so a re-planned or re-executed
job would draw different values.  These draws depend only on (seed, salt, key...),
so any partitioning, retry or executor loss gives the same rows.

:func:`draw` and :func:`uniform` are a counter-based generator that any SQL engine
can compute: the first 13 hexadecimal digits (52 bits) of the md5 of the seed, the salt
and the keys, written as text and joined by ``|``.  :func:`sql_draw` is the same in DuckDB SQL.
:func:`normal` draws from xxhash64, for noise by the million.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 52
_TWO_POW_53 = float(2**53)


def _cols(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def draw(seed: int, *keys, salt: int = 0) -> Column:
    """A whole number, uniform on [0, 2^52)."""
    text = F.concat_ws("|", F.lit(str(int(seed))), F.lit(str(int(salt))), *[c.cast("string") for c in _cols(keys)])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")


def uniform(seed: int, *keys, salt: int = 0) -> Column:
    """U[0, 1) in steps of 2^-52."""
    return draw(seed, *keys, salt=salt).cast("double") / F.lit(float(2**DRAW_BITS))


def sql_draw(seed: int, *keys: str, salt: int = 0) -> str:
    """:func:`draw` as DuckDB SQL over column names."""
    text = ", ".join([f"'{int(seed)}'", f"'{int(salt)}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST('0x' || substr(md5(concat_ws('|', {text})), 1, {DRAW_BITS // 4}) AS BIGINT)"


def sql_uniform(seed: int, *keys: str, salt: int = 0) -> str:
    return f"({sql_draw(seed, *keys, salt=salt)} / {2**DRAW_BITS}.0::DOUBLE)"


def _fast_uniform(seed: int, *keys, salt: int = 0) -> Column:
    """U[0, 1) from xxhash64(seed, salt, keys...): 53 high-quality bits."""
    h = F.xxhash64(F.lit(int(seed)), F.lit(int(salt)), *_cols(keys))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(_TWO_POW_53)


def normal(seed: int, *keys, salt: int = 0) -> Column:
    """N(0, 1) by Box-Muller on two hashed uniforms."""
    u1 = F.lit(1.0) - _fast_uniform(seed, *keys, salt=2 * salt + 1)  # (0, 1]
    u2 = _fast_uniform(seed, *keys, salt=2 * salt + 2)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
