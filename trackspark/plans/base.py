"""Where query modules register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import VIEWS

MODULES = ["track_queries", "overlap_queries", "evaluate_queries", "image_queries", "source_queries"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers a query; sql: its DuckDB form over the adapter views, which may start with more CTEs."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            views = VIEWS.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else VIEWS
            text = sql.strip()
            ORACLES[name] = views + ("," + text[4:] if text[:5].upper() == "WITH " else text)
        return f

    return register


_LIVE = "CAST(dataset AS VARCHAR) AS dataset, kind, CAST(timeframe AS INTEGER) AS timeframe, sc_id, track_id, n"


def live_sql(max_age: int, kinds: str, where: str = "TRUE", columns: str = _LIVE, silent: bool = False) -> str:
    """What the box tracker shows of boxes that stand still: a track goes on while it lacks max_age frames at most;
    its first cell is hidden but in the movie's first frame; it ends at the frame after those, if the movie has it or (``silent``) is over."""
    ended = "TRUE" if silent else f"max(t) + {max_age + 1} <= max(last)"
    return f"""WITH f AS (SELECT dataset, track_id AS u, timeframe AS t, sc_id, min(timeframe) OVER (PARTITION BY dataset) AS first, max(timeframe) OVER (PARTITION BY dataset) AS last,
      CASE WHEN timeframe - lag(timeframe) OVER (PARTITION BY dataset, track_id ORDER BY timeframe) <= {max_age + 1} THEN 0 ELSE 1 END AS new FROM cells WHERE {where}),
    n AS (SELECT *, new = 0 OR t = first AS shown, CAST(sum(new) OVER (PARTITION BY dataset ORDER BY t, sc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS id FROM f),
    k AS (SELECT *, max(CASE WHEN new = 1 THEN id END) OVER (PARTITION BY dataset, u ORDER BY t) AS track_id FROM n),
    o AS (SELECT dataset, 'cell' AS kind, t AS timeframe, sc_id, track_id, CAST(1 AS BIGINT) AS n FROM k WHERE shown
      UNION ALL SELECT dataset, 'end', max(t) + {max_age + 1}, NULL, track_id, count(*) FILTER (shown) FROM k GROUP BY dataset, track_id HAVING {ended} AND count(*) FILTER (shown) > 0)
    SELECT {columns} FROM o WHERE kind IN ({kinds})"""
