"""Registry of the named queries (operator IDs of SURVEY §2) and their SQL oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables,
turned into ``history`` by the adapters in :mod:`replaylab.sources.plays`.
The oracle is DuckDB SQL over the same tables; ``None`` marks operators that
have no SQL form and are checked against brute force in the tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from replaylab.session import prepare
from replaylab.sources.plays import (
    ANON_PLAYS_SQL, EVENT_PLAYS_SQL, PLAYS_SQL, anon_plays, event_plays, plays,
)

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
# name -> (fn(history) -> DataFrame, source table) for queries over ``history``;
# lets the bench run the same operators over a stored history table.
HISTORY_QUERIES: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {}


# Adapter and its SQL by source name; "anon" is the plays with some listeners unknown.
_SOURCES = {"plays": (plays, PLAYS_SQL), "events": (event_plays, EVENT_PLAYS_SQL), "anon": (anon_plays, ANON_PLAYS_SQL)}


def register(name: str, sql: str | None = None, source: str = "plays"):
    """Register ``fn(history) -> DataFrame`` under ``name``."""

    def deco(fn: Callable[[DataFrame], DataFrame]):
        loader, with_src = _SOURCES[source]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(loader(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if source != "anon":
            HISTORY_QUERIES[name] = (fn, source)
        if sql is not None:
            body = sql.lstrip()
            if body[:4].upper() == "WITH":
                # Merge the query's own CTE list into the history CTE.
                body = "," + body[4:]
            ORACLE[name] = f"WITH history AS ({with_src})\n{body}"
        return fn

    return deco


def register_raw(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` that loads its own input."""

    def deco(fn: QueryFn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# SQL fragments shared by the oracle texts.
MINUTES = "((({ms}) + 300) // 600) / 100"
HOURS = "((({ms}) + 18000) // 36000) / 100"
DAYS = "((({ms}) + 432000) // 864000) / 100"


def minutes_sql(ms: str) -> str:
    return MINUTES.format(ms=ms)


def _load_all() -> None:
    # Importing the query modules fills the registry.
    from replaylab.plans import (  # noqa: F401
        q_activity, q_charts, q_ingest, q_maintained, q_metrics, q_skips, q_streaming, q_unknown_listener,
    )
