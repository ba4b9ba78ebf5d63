"""Monthly rank charts: micro frames (FIXTURES §5) and a brute-force check."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, play
from replaylab.operators import charts as C
from replaylab.sources.plays import plays


def brute_chart(rows, keys, limit):
    """Independent oracle: {entity: (rank, streams, ms, [ranks])}, months.

    Formulated as lookups: a month index m -> its source month (latest month
    with data at or before m) -> that month's sorted top list.  Featured
    entities are ordered by (-lifetime ms, first month, first rank).
    """
    def ent(r):
        return tuple(r[k] for k in keys)

    def midx(ts):
        return ts.year * 12 + ts.month - 1

    named = [r for r in rows if r[keys[0]] is not None]
    life_n, life_ms = Counter(), Counter()
    for r in named:
        life_n[ent(r)] += 1
        life_ms[ent(r)] += r["ms_played"] or 0
    sums, counts = {}, Counter()
    for r in (r for r in named if r["ts"] is not None):
        cell = (midx(r["ts"]), ent(r))
        counts[cell] += 1
        if r["ms_played"] is not None:
            sums[cell] = sums.get(cell, 0) + r["ms_played"]
    data_months = sorted({m for m, _ in counts})
    if not data_months:
        return None, []

    def order_key(m, e):
        ms = sums.get((m, e))
        return (ms is None, -(ms or 0), -counts[(m, e)], tuple((v is None, v or "") for v in e))

    tops = {m: sorted((e for mm, e in counts if mm == m), key=lambda e: order_key(m, e))[:limit]
            for m in data_months}
    span = range(data_months[0], data_months[-1] + 1)
    listed = {m: tops[max(d for d in data_months if d <= m)] for m in span}

    def rank_at(e, m):
        return listed[m].index(e) + 1 if e in listed[m] else limit + 1

    feat = {e for m in span for e in listed[m]}
    first = {e: min(m for m in span if e in listed[m]) for e in feat}
    ordered = sorted(feat, key=lambda e: (-life_ms[e], first[e], rank_at(e, first[e])))
    months = [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in span]
    out = {e: (i, life_n[e], life_ms[e], [rank_at(e, m) for m in span]) for i, e in enumerate(ordered, 1)}
    return out, months


def spark_chart(ch: C.Chart):
    nested = ch.nested().collect()
    return {tuple(r[k] for k in ch.keys): (r["rank"], r["total_streams"], r["total_minutes"],
                                           list(r["monthly_ranks"])) for r in nested}


def _minutes(ms):
    return ((ms + 300) // 600) / 100


@pytest.mark.parametrize("keys,limit", [(C.ARTIST, 8), (C.TRACK, 5), (C.ARTIST, 1)])
def test_chart_matches_brute_force_on_plays(spark, keys, limit):
    h = plays(spark, SF_SMALL)
    rows = [r.asDict() for r in h.select("ts", "artist_name", "track_name", "ms_played").collect()]
    want, months = brute_chart(rows, list(keys), limit)
    ch = C.Chart(h, keys, limit)
    got = spark_chart(ch)
    assert set(got) == set(want)
    for e, (rank, streams, ms, ranks) in want.items():
        assert got[e] == (rank, streams, _minutes(ms), ranks), e
    hd = ch.header().collect()[0]
    assert hd["total_months"] == len(months) == len(hd["months"])
    assert hd["months"] == months
    # every month's visible ranks are 1..k without gaps
    long = ch.long().where(F.col("month_rank") <= limit).groupBy("month").agg(
        F.sort_array(F.collect_list("month_rank")).alias("r")).collect()
    for r in long:
        assert r["r"] == list(range(1, len(r["r"]) + 1))


def test_year_gap_carry_forward(spark, make_history):
    # FIXTURES §5 "year_gap": data in 2023-11 and 2024-02 only.
    h = make_history([
        play("2023-11-05T10:00:00", "A", ms=100), play("2023-11-06T10:00:00", "B", ms=50),
        play("2024-02-01T10:00:00", "B", ms=500),
    ])
    ch = C.Chart(h, C.ARTIST, 2)
    hd = ch.header().collect()[0]
    assert hd["months"] == ["2023-11", "2023-12", "2024-01", "2024-02"]
    got = {r["artist_name"]: r["monthly_ranks"] for r in ch.nested().collect()}
    # Dec and Jan repeat November's list.
    assert got == {"A": [1, 1, 1, 3], "B": [2, 2, 2, 1]}
    src = {r["month"]: r["carried"] for r in ch.chart.select(
        F.date_format("month_start", "yyyy-MM").alias("month"), "carried").distinct().collect()}
    assert src == {"2023-11": False, "2023-12": True, "2024-01": True, "2024-02": False}


def test_podcast_only_month_is_a_gap(spark, make_history):
    # A middle month with podcasts only has no artist rows: it is carried.
    h = make_history([
        play("2024-01-03T00:00:00", "A"),
        play("2024-02-03T00:00:00", None, episode_name="ep", episode_uri="episode:1"),
        play("2024-03-03T00:00:00", "B"),
    ])
    ch = C.Chart(h, C.ARTIST, 1)
    got = {r["artist_name"]: r["monthly_ranks"] for r in ch.nested().collect()}
    assert got == {"A": [1, 1, 2], "B": [2, 2, 1]}


def test_lifetime_ties_keep_first_appearance(spark, make_history):
    # FIXTURES §5 "ties": equal lifetime ms; order by first month, then first rank.
    h = make_history([
        play("2024-01-01T00:00:00", "Z", ms=100), play("2024-01-02T00:00:00", "Y", ms=90),
        play("2024-02-01T00:00:00", "Y", ms=10), play("2024-02-02T00:00:00", "X", ms=100),
    ])
    got = {r["artist_name"]: r["rank"] for r in C.Chart(h, C.ARTIST, 2).nested().collect()}
    assert got == {"Z": 1, "Y": 2, "X": 3}


def test_monthly_ties_break_by_streams_then_name(spark, make_history):
    h = make_history([
        play("2024-01-01T00:00:00", "B", ms=100), play("2024-01-02T00:00:00", "A", ms=100),
        play("2024-01-03T00:00:00", "C", ms=50), play("2024-01-04T00:00:00", "C", ms=50),
    ])
    top = C.Chart(h, C.ARTIST, 3).top.orderBy("rank").select("artist_name").collect()
    assert [r[0] for r in top] == ["C", "A", "B"]


def test_track_with_null_artist_is_charted(spark, make_history):
    # FIXTURES §5 "null_artist": null-safe lifetime lookup.
    h = make_history([
        play("2024-01-01T00:00:00", None, "T1", ms=500), play("2024-01-02T00:00:00", None, "T1", ms=500),
        play(None, None, "T1", ms=1000),  # undated rows count in lifetime totals
        play("2024-01-03T00:00:00", "A", "T2", ms=100),
    ])
    got = {(r["track_name"], r["artist_name"]): (r["rank"], r["total_streams"], r["total_minutes"])
           for r in C.Chart(h, C.TRACK, 5).nested().collect()}
    assert got[("T1", None)] == (1, 3, _minutes(2000))
    assert got[("T2", "A")] == (2, 1, _minutes(100))


def test_undated_export_falls_back_to_lifetime_top(spark, make_history):
    # FIXTURES §5 "undated": every ts NULL -> lifetime top by ms, then streams; empty ranks.
    h = make_history([play(None, "A", ms=10), play(None, "B", ms=30), play(None, "C", ms=10),
                      play(None, "C", ms=0)])
    got = [(r["rank"], r["artist_name"], list(r["monthly_ranks"]))
           for r in C.Chart(h, C.ARTIST, 2).nested().orderBy("rank").collect()]
    assert got == [(1, "B", []), (2, "C", [])]
    assert C.Chart(h, C.ARTIST, 2).header().count() == 0


def test_empty_history(spark, make_history):
    h = make_history([])
    assert C.Chart(h, C.ARTIST, 3).nested().count() == 0


def test_by_user_partitions_the_chart(spark, make_history):
    h = make_history([
        play("2024-01-01T00:00:00", "A", username="u1"), play("2024-03-01T00:00:00", "B", username="u1"),
        play("2024-02-01T00:00:00", "A", username="u2"),
    ])
    long = C.Chart(h, C.ARTIST, 1, by=("username",)).long()
    months = {u: sorted(r["month"] for r in long.where(F.col("username") == u).collect())
              for u in ("u1", "u2")}
    assert months["u1"] == ["2024-01", "2024-01", "2024-02", "2024-02", "2024-03", "2024-03"]
    assert months["u2"] == ["2024-02"]


def test_limit_must_be_positive(spark, make_history):
    with pytest.raises(ValueError):
        C.Chart(make_history([]), C.ARTIST, 0)


def test_resample_and_on_chart(spark, make_history):
    h = make_history([
        play("2024-01-01T00:00:00", "A", ms=10), play("2024-01-01T00:00:00", "B", ms=5),
        play("2024-02-01T00:00:00", "B", ms=10), play("2024-02-01T00:00:00", "A", ms=5),
    ])
    long = C.Chart(h, C.ARTIST, 2).long()
    res = {(r["artist_name"], r["position"]): r["rank_at"]
           for r in C.resample_ranks(long, C.ARTIST, steps=4).collect()}
    assert res[("A", 0.0)] == 1.0 and res[("A", 1.0)] == 2.0
    assert res[("A", 0.5)] == pytest.approx(1.5)
    assert res[("A", 0.25)] == pytest.approx(1 + (1 - 0.7071067811865476) / 2)
    shown = C.on_chart(C.resample_ranks(long, C.ARTIST, steps=4), slots=1).collect()
    assert all(r["is_leader"] for r in shown)
    vel = {(r["artist_name"], r["month"]): r["rank_change"] for r in C.rank_velocity(long, C.ARTIST).collect()}
    assert vel[("A", "2024-02")] == -1 and vel[("B", "2024-02")] == 1 and vel[("A", "2024-01")] is None


def test_month_labels(spark):
    df = spark.createDataFrame([("2024-01",), ("2023-12",)], "month string")
    got = {r["month"]: (r["label_long"], r["label_short"], r["is_january"]) for r in C.month_labels(df).collect()}
    assert got == {"2024-01": ("January 2024", "JAN '24", True), "2023-12": ("December 2023", "DEC '23", False)}


def test_chart_plan_has_no_nested_loop_join(spark):
    h = plays(spark, SF_SMALL)
    for keys in (C.ARTIST, C.TRACK):
        plan = C.Chart(h, keys, 8).long()._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_by_user_chart_matches_per_user_brute_force(spark):
    h = plays(spark, SF_SMALL)
    rows = [r.asDict() for r in h.select("username", "ts", "artist_name", "ms_played").collect()]
    per_user = {}
    for r in rows:
        per_user.setdefault(r["username"], []).append(r)
    nested = C.Chart(h, C.ARTIST, 2, by=("username",)).nested().collect()
    got = {}
    for r in nested:
        got.setdefault(r["username"], {})[(r["artist_name"],)] = (
            r["rank"], r["total_streams"], r["total_minutes"], list(r["monthly_ranks"]))
    assert set(got) == set(per_user)
    for user, urows in per_user.items():
        want, _ = brute_chart(urows, ["artist_name"], 2)
        assert got[user] == {e: (rk, s, _minutes(ms), rr) for e, (rk, s, ms, rr) in want.items()}, user


def test_by_user_fallback_only_for_undated_listeners(spark, make_history):
    h = make_history([
        play(None, "A", ms=10, username="u1"), play(None, "B", ms=30, username="u1"),
        play("2024-01-01T00:00:00", "C", ms=5, username="u2"), play(None, "D", ms=99, username="u2"),
    ])
    got = sorted((r["username"], r["rank"], r["artist_name"], list(r["monthly_ranks"]))
                 for r in C.Chart(h, C.ARTIST, 2, by=("username",)).nested().collect())
    assert got == [("u1", 1, "B", []), ("u1", 2, "A", []), ("u2", 1, "C", [1])]


def test_rank_at_clamps_eases_and_defaults(spark):
    df = spark.createDataFrame([([1, 3, 9],), ([],), ([2],)], "r array<int>")
    def at(p):
        return [x[0] for x in df.select(C.rank_at("r", p)).collect()]
    assert at(-1.0) == [1.0, 8.0, 2.0]
    assert at(0.5) == [pytest.approx(2.0), 8.0, 2.0]
    assert at(1.25)[0] == pytest.approx(3 + 6 * (1 - 0.7071067811865476) / 2)
    assert at(2.0) == [9.0, 8.0, 2.0] and at(7.0) == [9.0, 8.0, 2.0]
