"""Daily counts, calendar grid, histogram, streaks, weekday profile."""

from __future__ import annotations

import datetime as dt

from conftest import SF_SMALL, play
from replaylab.operators import activity as A
from replaylab.sources.plays import event_plays


def test_grid_2024_and_2023(spark, make_history):
    # FIXTURES §5 "grid": 2024 has 371 cells (2023-12-31 .. 2025-01-04); 2023 starts on Sunday Jan 1.
    h = make_history([play("2024-03-05T10:00:00", "A"), play("2024-03-05T11:00:00", "A")])
    g = A.calendar_grid(A.daily_counts(h, year=2024), 2024).collect()
    days = sorted(r.day for r in g)
    assert len(g) == 371 and days[0] == dt.date(2023, 12, 31) and days[-1] == dt.date(2025, 1, 4)
    assert sum(r.in_range for r in g) == 366
    cell = [r for r in g if r.day == dt.date(2024, 3, 5)][0]
    assert (cell["count"], cell.level, cell.dow) == (2, 1, 2)
    assert all(r["count"] == 0 for r in g if not r.in_range)
    labels = [r.month_label for r in sorted(g, key=lambda r: r.day) if r.month_label]
    assert labels == ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    g23 = A.calendar_grid(A.daily_counts(h, year=2023), 2023).collect()
    assert min(r.day for r in g23) == dt.date(2023, 1, 1)
    summ = A.activity_summary(A.calendar_grid(A.daily_counts(h, year=2024), 2024)).collect()[0]
    assert (summ.active_days, summ.total_streams) == (1, 2)


def test_grid_as_of_cuts_current_year(spark, make_history):
    h = make_history([play("2024-03-05T10:00:00", "A"), play("2024-05-01T10:00:00", "A")])
    g = A.calendar_grid(A.daily_counts(h, year=2024), 2024, as_of="2024-03-06").collect()
    assert max(r.day for r in g) == dt.date(2024, 3, 9)   # Saturday after as_of
    assert sum(r["count"] for r in g) == 1                  # May is beyond the end


def test_levels_and_estimate(spark, make_history):
    rows = [play("2024-01-01T00:00:00", "A") for _ in range(9)]
    d = A.daily_counts(make_history(rows)).collect()[0]
    assert (d.streams, d.est_minutes) == (9, 29)   # round(9 * 3.2) = 29


def test_histogram_counts_and_degenerate(spark, make_history):
    h = event_plays(spark, SF_SMALL)
    hist = A.ts_histogram(h, 100).collect()
    assert len(hist) == 100 and sum(r["count"] for r in hist) == h.where("ts IS NOT NULL").count()
    one = A.ts_histogram(make_history([play("2024-01-01T00:00:00", "A")] * 3), 10).collect()
    assert {r.bin: r["count"] for r in one}[0] == 3 and len(one) == 10
    assert A.ts_histogram(make_history([]), 10).count() == 0


def test_streaks_and_weekday(spark, make_history):
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05", "2024-01-06"]
    h = make_history([play(f"{d}T12:00:00", "A", ms=3_600_000) for d in days])
    runs = sorted((r.start_day.isoformat(), r.length) for r in A.streaks(h).collect())
    assert runs == [("2024-01-01", 3), ("2024-01-05", 2)]
    best = A.longest_streak(h).collect()[0]
    assert (best.start_day, best.length) == (dt.date(2024, 1, 1), 3)
    prof = {r.weekday: (r.active_days, r.avg_hours) for r in A.weekday_profile(h).collect()}
    assert prof["Monday"] == (1, 1.0) and prof["Saturday"] == (1, 1.0)
    assert A.top_weekday(h).collect()[0].weekday == "Monday"


def test_sessions_merge_across_day_buckets(spark, make_history):
    # plays every 20 minutes from 22:00 on Jan 1 to 02:00 on Jan 3: ONE session across two midnights,
    # then a play 40 minutes later starts a new one.
    start = dt.datetime(2024, 1, 1, 22, 0)
    times = [start + dt.timedelta(minutes=20 * i) for i in range(0, 85)]
    rows = [play(t.isoformat(), "A", ms=1000) for t in times]
    rows.append(play((times[-1] + dt.timedelta(minutes=40)).isoformat(), "A", ms=1000))
    rows.append(play("2024-01-01T22:10:00", "A", ms=1000, username="u2"))
    s = sorted((r.username, r.session_start, r.plays) for r in A.listening_sessions(make_history(rows)).collect())
    assert s == [("u1", times[0], 85), ("u1", times[-1] + dt.timedelta(minutes=40), 1),
                 ("u2", dt.datetime(2024, 1, 1, 22, 10), 1)]
    first = [r for r in A.listening_sessions(make_history(rows)).collect() if r.plays == 85][0]
    assert first.session_end == times[-1] + dt.timedelta(minutes=30)
