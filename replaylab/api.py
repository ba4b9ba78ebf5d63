"""Service-shaped results: the cards and charts as plain dicts.

Each function runs the distributed operators and collects only the final,
bounded result (one card, or featured entities x months) - what a serving
layer returns.  There is no HTTP server here; these are the payloads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from replaylab.operators import activity as A
from replaylab.operators import charts as C
from replaylab.operators import metrics as M
from replaylab.operators import skips as S
from replaylab.sources import history_store as HS


def upload(spark: SparkSession, paths, store: str) -> dict:
    """Validate, ingest and append export files; report files and total rows."""
    r = HS.upload(spark, paths, store).first()
    return {"status": "ok", "files_processed": r["files_processed"], "total_rows": r["total_rows"]}


def total_time(h: DataFrame) -> dict:
    r = M.total_time(h).first()
    return {"status": "ok", "total_minutes": r["total_minutes"], "total_hours": r["total_hours"],
            "total_days": r["total_days"]}


def _top_card(top1: DataFrame, keys: list[str]) -> dict:
    r = M.or_default(top1, keys).first()
    return {"status": "ok", **{k: r[k] for k in keys}, "total_streams": r["total_streams"],
            "total_minutes": r["total_minutes"]}


def top_artist(h: DataFrame) -> dict:
    return _top_card(M.top_artist(h), list(M.ARTIST))


def top_album(h: DataFrame) -> dict:
    return _top_card(M.top_album(h), list(M.ALBUM))


def top_track(h: DataFrame) -> dict:
    return _top_card(M.top_track(h), list(M.TRACK))


def _rank(h: DataFrame, keys, limit: int) -> dict:
    ch = C.Chart(h, keys, limit)
    header = ch.header().first()
    rows = sorted(ch.nested().collect(), key=lambda r: r["rank"])
    data = [{"rank": r["rank"], **{k: r[k] for k in keys}, "total_streams": r["total_streams"],
             "total_minutes": r["total_minutes"], "monthly_ranks": list(r["monthly_ranks"])} for r in rows]
    if header is None:
        return {"status": "ok", "start_month": None, "end_month": None, "total_months": 0,
                "months": [], "data": data}
    return {"status": "ok", "start_month": header["start_month"], "end_month": header["end_month"],
            "total_months": header["total_months"], "months": list(header["months"]), "data": data}


def unique_songs(h: DataFrame) -> dict:
    return {"status": "ok", "unique_songs": M.unique_songs(h).first()["unique_songs"]}


def active_days(h: DataFrame) -> dict:
    return {"status": "ok", "active_days": M.active_days(h).first()["active_days"]}


def heatmap(h: DataFrame, year: int, tz: str | None = None, as_of: str | None = None) -> dict:
    """The calendar grid of one year: at most 378 cells, up to today in the current year."""
    grid = A.calendar_grid(A.daily_counts(h, year, tz=tz), year, as_of)
    cells = sorted(grid.collect(), key=lambda r: r["day"])
    return {"status": "ok", "year": year, "active_days": sum(r["count"] > 0 for r in cells),
            "total_streams": sum(r["count"] for r in cells),
            "cells": [{"day": r["day"].isoformat(), "count": r["count"], "level": r["level"], "in_range": r["in_range"],
                       "week": r["week"], "dow": r["dow"], "month_label": r["month_label"]} for r in cells]}


def most_hated(h: DataFrame, limit: int = 10, min_plays: int = 20) -> dict:
    rows = sorted(S.most_hated(h, S.ARTIST, n=limit, min_plays=min_plays).collect(), key=lambda r: r["rank"])
    return {"status": "ok", "data": [{k: r[k] for k in ("rank", "artist_name", "total_plays", "skips", "skip_rate", "low", "high")}
                                     for r in rows]}


def artist_rank(h: DataFrame, limit: int = 10) -> dict:
    return _rank(h, C.ARTIST, limit)


def track_rank(h: DataFrame, limit: int = 10) -> dict:
    return _rank(h, C.TRACK, limit)
