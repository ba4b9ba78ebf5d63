"""Shared fixtures: one local session for the whole run, history frame builder."""

from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from replaylab.schema import HISTORY, HISTORY_COLUMNS  # noqa: E402
from replaylab.session import checkpoint_dir, local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", shuffle_partitions=8, app="replaylab-tests")
    checkpoint_dir(s)  # the session's shared folder, or a scratch one when unset (local only)
    yield s


def ts(s: str) -> dt.datetime:
    """UTC wall-clock timestamp from text (the session time zone is UTC)."""
    return dt.datetime.fromisoformat(s)


@pytest.fixture(scope="session")
def make_history(spark):
    """Build a ``history`` frame from dicts; missing keys are NULL."""

    def build(rows: list[dict]):
        data = [tuple(r.get(c) for c in HISTORY_COLUMNS) for r in rows]
        return spark.createDataFrame(data, HISTORY)

    return build


def play(when: str | None, artist: str | None = None, track: str | None = None, ms: int = 60_000,
         skipped: bool | None = None, **kw) -> dict:
    row = {"ts": ts(when) if when else None, "artist_name": artist, "track_name": track,
           "ms_played": ms, "skipped": skipped, "username": kw.pop("username", "u1")}
    if track is not None and "track_uri" not in kw:
        row["track_uri"] = f"track:{track}"
    row.update(kw)
    return row
