"""DuckDB SQL that states the expected answer of each registered query.

The views ``events``, ``embeddings``, ``lineitem`` ... are the driver's parquet
tables.  ``TX`` is the same events ⋈ embeddings mapping as
``txrisk.sources.tables.transactions``; ``PRED`` the same long predictions table.
"""

from __future__ import annotations

from txrisk.schema import V_COLUMNS


def r6(expr: str, digits: int = 6) -> str:
    """Report rounding, the same IEEE steps as ``catalog.rounded``: floor(x * 10^d + 0.5) / 10^d.

    Both engines then give bit-identical results for identical inputs, including
    exact decimal ties (where decimal half-up and binary rounding disagree).
    """
    scale = f"1e{digits}"
    return f"(CAST(floor(({expr}) * {scale} + 0.5) AS DOUBLE) / {scale})"


_V = ",\n         ".join(f"CAST(v.embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(V_COLUMNS))

TX = f"""
_nv AS (SELECT count(*) AS n FROM embeddings),
_t0 AS (SELECT min(epoch_us(ts)) AS t0 FROM events),
tx AS (
  SELECT e.event_id AS id,
         (epoch_us(e.ts) - (SELECT t0 FROM _t0)) / 1e6 AS Time,
         e.value AS Amount,
         CAST(v.label = 0 AS INTEGER) AS Class,
         {_V}
  FROM events e JOIN embeddings v ON v.vec_id = e.event_id % (SELECT n FROM _nv)
)"""

TX_LI = """
_l0 AS (SELECT min(epoch_us(l_shipdate)) AS t0 FROM lineitem),
tx AS (
  SELECT (epoch_us(l_shipdate) - (SELECT t0 FROM _l0)) / 1e6 AS Time,
         l_extendedprice AS Amount,
         CAST(l_returnflag = 'R' AS INTEGER) AS Class
  FROM lineitem
)"""

PRED = (
    TX
    + """,
_m AS (
  SELECT id, Class AS label,
         least(greatest(CAST(floor((2 * CAST(round(Amount * 100) AS BIGINT) + 5) / 10) AS BIGINT), 0), 1000) AS m
  FROM tx
),
pred AS (
  SELECT 'm1' AS model, id, label, CAST(m AS DOUBLE) / 1000.0 AS p FROM _m
  UNION ALL
  SELECT 'm2' AS model, id, label, CAST(1000 - m AS DOUBLE) / 1000.0 AS p FROM _m
)"""
)


def with_tx(body: str) -> str:
    return f"WITH {TX}\n{body}"


def with_tx_li(body: str) -> str:
    return f"WITH {TX_LI}\n{body}"


def with_pred(body: str) -> str:
    return f"WITH {PRED}\n{body}"
