"""Top-k metrics, breakdowns and skip statistics on micro frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import play
from replaylab.operators import metrics as M
from replaylab.operators import skips as S


def test_total_time_all_rows_and_empty(spark, make_history):
    h = make_history([play("2024-01-01T00:00:00", "A", ms=90_000),
                      play(None, None, ms=30_000, episode_uri="episode:1")])
    r = M.total_time(h).collect()[0]
    assert (r.total_ms, r.total_minutes, r.total_hours) == (120_000, 2.0, 0.03)
    e = M.total_time(make_history([])).collect()[0]
    assert (e.total_ms, e.total_minutes, e.total_days) == (0, 0.0, 0.0)


def test_top_artist_ties_by_name_and_default(spark, make_history):
    h = make_history([play("2024-01-01T00:00:00", "B"), play("2024-01-01T00:00:00", "A"),
                      play("2024-01-01T00:00:00", None)])
    top = M.top_artist(h).collect()
    assert [(r.artist_name, r.total_streams) for r in top] == [("A", 1)]
    empty = M.or_default(M.top_artist(make_history([])), ["artist_name"]).collect()
    assert [(r.artist_name, r.total_streams, r.total_minutes) for r in empty] == [(None, 0, 0.0)]


def test_top_album_and_track_keys(spark, make_history):
    h = make_history([play("2024-01-01T00:00:00", None, "T", album_name="Al"),
                      play("2024-01-01T00:00:00", None, "T", album_name="Al"),
                      play("2024-01-01T00:00:00", "X", "T", album_name="Al")])
    t = M.top_track(h).collect()[0]
    assert (t.track_name, t.artist_name, t.total_streams) == ("T", None, 2)
    a = M.top_album(h).collect()[0]
    assert (a.album_name, a.artist_name, a.total_streams) == ("Al", None, 2)


def test_by_user_top_k_and_default(spark, make_history):
    h = make_history([play("2024-01-01T00:00:00", "A", username="u1"),
                      play("2024-01-01T00:00:00", None, username="u2")])
    groups = h.select("username").distinct()
    got = {r.username: (r.artist_name, r.total_streams)
           for r in M.or_default(M.top_artist(h, by=("username",)), ["artist_name"], ("username",),
                                 groups).collect()}
    assert got == {"u1": ("A", 1), "u2": (None, 0)}


def test_labels_default(spark, make_history):
    h = make_history([play("2024-01-01T00:00:00", "", "T"), play("2024-01-01T00:00:00", None, "")])
    out = M.with_labels(M.top_track(h, n=5)).collect()
    labels = sorted((r.title, r.subtitle, r.streams_label) for r in out)
    assert labels == [("T", "Unknown Artist", "1 streams"), ("Unknown Track", "Unknown Artist", "1 streams")]


def test_breakdown_shares_sum_to_one(spark, make_history):
    h = make_history([play("2024-01-01T00:00:00", "A", platform=p) for p in ["ios", "ios", "web", None]])
    rows = M.breakdown(h, "platform").collect()
    assert sum(r.stream_share for r in rows) == pytest.approx(1.0)
    assert {r.platform: r.streams for r in rows} == {"ios": 2, "web": 1, None: 1}


def test_dedup_and_presets(spark, make_history):
    rows = [play("2024-01-01T00:00:00", "A", "T"), play("2024-01-01T00:00:00", "A", "T"),
            play("2024-03-01T00:00:00", "A", "T")]
    h = make_history(rows)
    assert M.deduplicate(h).count() == 2
    assert M.preset_range(h, "last_4_weeks").count() == 1
    assert M.preset_range(h, "all_time").count() == 3
    assert M.date_range(h, "2024-01-01", "2024-03-01").count() == 2


def test_unique_songs_and_active_days(spark, make_history):
    h = make_history([play("2024-01-01T01:00:00", "A", "T1"), play("2024-01-01T05:00:00", "A", "T2"),
                      play("2024-01-03T00:00:00", "A", "T1")])
    assert M.unique_songs(h).collect()[0][0] == 2
    assert M.unique_songs(h, approx=True).collect()[0][0] == 2
    assert M.active_days(h).collect()[0][0] == 2
    assert M.peak_day(h).collect()[0].streams == 2


def test_skip_stats_semantics(spark, make_history):
    # FIXTURES §5 "null_skips" and "extremes".
    h = make_history([
        play("2024-01-01T00:00:00", "A", skipped=True), play("2024-01-01T00:00:00", "A", skipped=None),
        play("2024-01-01T00:00:00", "A", skipped=False), play(None, "A", skipped=True),
        play("2024-01-01T00:00:00", "N", skipped=None),
        play("2024-01-01T00:00:00", None, skipped=True),
    ])
    st = {r.artist_name: (r.total_plays, r.skips, r.skip_rate) for r in S.skip_stats(h).collect()}
    assert st["A"] == (3, 1, pytest.approx(1 / 3))   # null skipped stays in the denominator
    assert st["N"] == (1, 0, 0.0)
    assert None not in st                           # null keys dropped
    g = S.global_skip_rate(h).collect()[0][0]
    assert g == pytest.approx(3 / 4)                # mean of non-null skipped over all rows


def test_wilson_and_surprise_properties(spark, make_history):
    rows = []
    for i in range(40):
        rows.append(play("2024-01-01T00:00:00", "hated", skipped=i < 36))
        rows.append(play("2024-01-01T00:00:00", "loved", skipped=i < 2))
        rows.append(play("2024-01-01T00:00:00", "mid", skipped=i < 20))
    h = make_history(rows)
    st = S.with_global_rate(S.skip_stats(h), h)
    w = {r.artist_name: r for r in S.wilson(st).collect()}
    for r in w.values():
        assert r.low <= r.skip_rate <= r.high
        assert r.err_low >= 0 and r.err_high >= 0
    assert w["hated"].robust and not w["loved"].robust
    sp = {r.artist_name: r for r in S.skip_surprise(st).collect()}
    assert sp["hated"].p_value < sp["mid"].p_value < sp["loved"].p_value
    assert sp["hated"].significant and not sp["loved"].significant
    top = S.most_hated(h, n=1, min_plays=20).collect()
    assert [r.artist_name for r in top] == ["hated"]
    ext = S.skip_extremes(S.skip_stats(h), S.ARTIST, 1, 1).collect()
    assert {(r.tag, r.artist_name) for r in ext} == {("most_skipped", "hated"), ("most_played", "hated")}


def test_surprise_guards_global_rate_zero_and_one(spark, make_history):
    for flag, want in ((False, 1.0), (True, 1.0)):
        h = make_history([play("2024-01-01T00:00:00", "A", skipped=flag) for _ in range(5)])
        st = S.with_global_rate(S.skip_stats(h), h)
        r = S.skip_surprise(st).collect()[0]
        assert r.p_value == want
