"""Rows by rank without sorting: radix selection.

Choosing the n rows of a class with the smallest draws needs no global order, only the draw of the n-th row: the
choice is then a filter.  :func:`rank_limits` finds the draws of any ranks of any classes together.  Every round
counts rows by the next ``DIGIT`` bits of the draw, for the prefixes that hold a wanted rank only, so a round sends
(ranks x 2^DIGIT) counts to the driver at most, whatever the table's size.  Once a prefix holds few rows its
(draw, id) pairs are fetched and the rank read off them; draws of 52 bits end after four rounds.

Nothing is shuffled but those counts, and no row is moved, joined or numbered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.hashing import DRAW_BITS

DIGIT = 13  # bits a round
FETCH = 4096  # rows of one prefix that may be fetched


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def rank_limits(df: DataFrame, draw: Column, id_col: str, ranks: Mapping[object, Sequence[int]], label: str | None = None, bits: int = DRAW_BITS) -> dict:
    """{class: [(draw, id) of the rank-th row, ...]} in (draw, id) order; ranks count from 1.

    ``draw`` is a whole number in [0, 2^bits); ids should be unique (rows of one id are one place: all or none of them is
    within a limit).  A rank below 1 gives None, a rank beyond the class its last row.  Without ``label`` the whole
    table is the class ``None``.
    """
    rows = df.select(draw.alias("h"), F.col(id_col).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("c"))
    # wanted: (class, index of the rank) -> (prefix bits, prefix, rank among the rows of the prefix)
    wanted = {(c, j): (0, 0, r) for c, own in ranks.items() for j, r in enumerate(own) if r >= 1}
    ready: dict = {}

    def within(places) -> Column:
        return _any([F.col("c").eqNullSafe(F.lit(c)) & (F.shiftright("h", bits - used) == prefix) for c, used, prefix in places])

    while wanted:
        places = sorted({(c, used, prefix) for (c, _), (used, prefix, _) in wanted.items()}, key=str)
        used = places[0][1]  # every open place is as deep as the others
        step = min(DIGIT, bits - used)
        found = rows.filter(within(places)).groupBy("c", F.shiftright("h", bits - used - step).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts: dict = {}
        for r in sorted(found, key=lambda r: r["p"]):
            counts.setdefault((r["c"], r["p"] >> step), []).append((r["p"], r["n"]))
        still = {}
        for key, (_, prefix, rank) in wanted.items():
            own = counts.get((key[0], prefix), [])
            if not own:
                ready[key] = None  # an empty class
                continue
            before, at = 0, own[-1]
            for p, n in own:
                if before + n >= rank:
                    at = (p, n)
                    break
                before += n
            else:
                before, rank = before - own[-1][1], before  # beyond the class: its last row
            place = (used + step, at[0], rank - before)
            (ready if at[1] <= FETCH or used + step == bits else still)[key] = place
        wanted = still
    open_places = {(key[0], v[0], v[1]) for key, v in ready.items() if v}
    held: dict = {}
    if open_places:
        places = sorted(open_places, key=str)
        for r in rows.filter(within(places)).groupBy("c", "h", "id").agg(F.count(F.lit(1)).alias("n")).collect():
            for c, used, prefix in places:
                if r["c"] == c and r["h"] >> (bits - used) == prefix:
                    held.setdefault((c, used, prefix), []).append((r["h"], r["id"], r["n"]))
    out: dict = {c: [None] * len(own) for c, own in ranks.items()}
    for (c, j), place in ready.items():
        if place:
            left = place[2]
            for h, i, n in sorted(held[(c, place[0], place[1])]):
                out[c][j] = (h, i)
                left -= n
                if left <= 0:
                    break
    return out


def up_to(draw: Column, id_col: str, limits: Mapping[object, tuple | None], label: str | None = None) -> Column:
    """True for the rows of each class up to its limit, the limit's row included; False for classes without one."""
    tests = []
    for c, limit in limits.items():
        if limit is not None:
            own = (draw < F.lit(limit[0])) | ((draw == F.lit(limit[0])) & (F.col(id_col) <= F.lit(limit[1])))
            tests.append(F.col(label).eqNullSafe(F.lit(c)) & own if label else own)
    return F.coalesce(_any(tests), F.lit(False)) if tests else F.lit(False)
