"""Maintained tables against a rebuild from all plays: any order of uploads, replaced and empty ones, crashes, compaction."""

from __future__ import annotations

import json
import random
import tempfile
from pathlib import Path

import pytest
from conftest import play
from pyspark.sql import functions as F

from replaylab.operators import activity as A
from replaylab.operators import charts as C
from replaylab.operators import metrics as M
from replaylab.sources import chart_store, month_cards, published
from replaylab.sources import history_store as HS
from replaylab.sources import play_keys as K
from replaylab.streaming import daily, runs
from replaylab.streaming import pipelines as P


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()))


def random_plays(rng, n, months):
    out = []
    for _ in range(n):
        month = rng.choice(months)
        when = None if month is None else f"{month}-{rng.randint(1, 28):02d} 10:00:00"
        out.append(play(when, rng.choice(["a", "b", "c", "d", None]), rng.choice(["t", "u", None]), ms=rng.choice([None, 0, 1, 5, 5, 9]) and 60_000,
                        username=rng.choice(["x", "y", None])))
    return out


def same(store, h):
    full = C.Chart(h, store.keys, store.limit, by=store.by)
    got = store.chart()
    assert rows(store.entity_months()) == rows(full.entity_months)
    assert rows(got.long()) == rows(full.long())
    assert rows(got.nested()) == rows(full.nested())


@pytest.mark.parametrize("by", [(), ("username",)])
def test_chart_follows_uploads(spark, make_history, by):
    rng, held = random.Random(5), {}
    store = chart_store.ChartStore(spark, tempfile.mkdtemp() + "/c", C.TRACK if by else C.ARTIST, 2, by)
    assert rows(store.chart().long()) == [] and rows(store.chart().nested()) == []
    steps = [("one", ["2020-03", "2020-06"]), ("two", ["2021-02", None]), ("one", ["2020-06", "2020-05"]), ("three", ["2019-12"]), ("two", [])]
    for n, (upload, months) in enumerate(steps):
        held[upload] = random_plays(rng, 14, months) if months else []
        store.commit(make_history(held[upload]), upload)
        if n == 3:
            same(store, make_history([p for u in held.values() for p in u]))
            assert store.compact() == 3
    same(store, make_history([p for u in held.values() for p in u]))


def test_undated_store_gives_the_fallback(spark, make_history):
    h = make_history([play(None, "a"), play(None, "b", ms=90_000)])
    store = chart_store.ChartStore(spark, tempfile.mkdtemp() + "/c", C.ARTIST, 3)
    store.commit(h, "u")
    same(store, h)


def test_commit_ranks_touched_groups_only_and_a_crash_changes_nothing(spark, make_history, monkeypatch):
    first = make_history([play("2020-01-02 00:00:00", "a"), play("2020-02-02 00:00:00", "b"), play("2021-02-02 00:00:00", "b")])
    store = chart_store.ChartStore(spark, tempfile.mkdtemp() + "/c", C.ARTIST, 3)
    assert store.commit(first, "one") == 3
    before = rows(store.chart().long())
    more = make_history([play("2020-02-03 00:00:00", "c", ms=1_000_000)])
    with monkeypatch.context() as m:
        m.setattr(published, "_mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.commit(more, "two")
    assert rows(store.chart().long()) == before
    assert store.commit(more, "two") == 1
    same(store, first.unionByName(more))
    assert store.commit(more.limit(0), "two") == 1  # the replaced upload's month is ranked anew
    assert rows(store.chart().long()) == before


def test_smaller_limit_and_bad_limits(spark, make_history):
    h = make_history([play("2020-01-02 00:00:00", a, ms=m) for a, m in [("a", 3000), ("b", 2000), ("c", 1000)]])
    store = chart_store.ChartStore(spark, tempfile.mkdtemp() + "/c", C.ARTIST, 3)
    store.commit(h, "u")
    assert rows(store.chart(2).long()) == rows(C.Chart(h, C.ARTIST, 2).long())
    for bad in (0, 4):
        with pytest.raises(ValueError):
            store.chart(bad)


# ------------------------------------------------------------------ keys of a store (S02), daily totals with corrections

def test_key_index_follows_the_store(spark, make_history):
    store = tempfile.mkdtemp() + "/s"
    one = make_history([play("2020-01-02 00:00:00", "a", "t", username=u) for u in ("x", "y", "z", None)])
    assert K.index_uploads(spark, store) == 0
    HS.append_history(one, store, "one")
    HS.append_history(one.limit(0), store, "none")
    assert K.index_uploads(spark, store) == 2 and K.index_uploads(spark, store) == 0
    HS.compact(spark, store)
    assert K.index_uploads(spark, store) == 0                      # the same rows elsewhere
    HS.append_history(one.where("username = 'x'"), store, "one")
    assert K.index_uploads(spark, store) == 1                      # written again: indexed again
    new = one.where("username IS NOT NULL")
    held = K.held_keys(spark, store, new)
    assert [r.username for r in held.collect()] == ["x"]
    assert sorted(r.username for r in K.new_plays(new, held).collect()) == ["y", "z"]
    assert K.held_keys(spark, store, new, without_upload="one").count() == 0


def test_a_listeners_drop_opens_its_bucket_only(spark, make_history):
    store = tempfile.mkdtemp() + "/s"
    HS.append_history(make_history([play("2020-01-02 00:00:00", "a", "t", username=f"u{i}") for i in range(40)]), store, "one")
    K.index_uploads(spark, store)
    held = K.held_keys(spark, store, make_history([play("2020-01-02 00:00:00", "a", "t", username="u7")]))
    all_files = len(spark.read.parquet(K.folder(store)).inputFiles())
    plan = held._jdf.queryExecution().executedPlan()
    assert "u7" in {r.username for r in held.collect()} and held.count() < 5
    assert "bucket" in plan.toString().split("PartitionFilters: ")[1].split("]")[0] and "PushedFilters: [Or(IsNull(ts)" in plan.toString()
    assert all_files > 20


def test_late_plays_correct_their_days(spark):
    base = Path(tempfile.mkdtemp())
    drop, store, ckpt, days = (str(base / n) for n in ("drop", "store", "ckpt", "days"))
    Path(drop).mkdir()

    def rec(when):
        return {"ts": when, "username": "me", "ms_played": 1000, "master_metadata_track_name": "T",
                "master_metadata_album_artist_name": "A", "spotify_track_uri": "spotify:track:T"}

    assert daily.day_totals(spark, days).count() == 0
    for n, times in enumerate([["2024-01-03T10:00:00Z", "2024-01-03T10:00:00Z"], ["2024-01-01T23:00:00Z", "2024-01-03T10:00:00Z", "2024-01-03T11:00:00Z"],
                               ["2024-01-01T23:30:00Z", "2024-01-04T00:00:00Z"]]):
        (Path(drop) / f"{n}.json").write_text(json.dumps([rec(t) for t in times]))
        P.dedup_into_store(spark, drop, store, ckpt, days=days)
    assert rows(daily.day_totals(spark, days).select("day", "streams")) == [("2024-01-01", "2"), ("2024-01-03", "2"), ("2024-01-04", "1")]
    assert rows(daily.corrections(spark, days).select("day", "streams")) == [("2024-01-01", "1")] * 2
    daily.publish_days(spark, store, "drop-1", days)               # a repeated batch replaces its share
    assert {r.streams for r in daily.day_totals(spark, days, ("username",)).collect()} == {1, 2}


# ------------------------------------------------------------------ breakdown cards, counts of plays

def test_cards_equal_the_single_breakdowns(spark, make_history):
    h = make_history([play("2020-01-02 00:00:00", "a", "t", username=u, skipped=s, platform=p, conn_country=c, reason_start=r, reason_end=r, shuffle=s)
                      for u, s, p, c, r in [("x", True, "ios", "DE", "fwd"), ("x", False, "ios", None, None), ("x", None, "web", "DE", "fwd"), (None, True, None, "FR", "end")]])
    cards = M.breakdown_cards(h, by=("username",))
    one = M.breakdown(h, "platform", by=("username",)).drop("total_minutes")
    assert rows(cards.where("card = 'platform'").select("username", cards.value.alias("platform"), "streams", "total_ms", "stream_share", "ms_share")) == rows(one)
    reasons = cards.where("card = 'reasons'").select("username", cards.value.alias("reason_start"), cards.value2.alias("reason_end"), "streams", "skips", "skip_rate")
    assert rows(reasons) == rows(M.reason_breakdown(h, by=("username",)))
    assert M.breakdown_cards(h.limit(0)).count() == 0
    assert cards._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_counts_of_plays_shuffle_keys_only(spark, make_history):
    h = make_history([play("2020-01-02 00:00:00", "a", "t"), play("2020-01-02 00:00:00", "a", "t", ms=5), play(None, "b"), play(None, "c")])
    counts = M.play_counts(h)
    assert [r.rows_after_dedup for r in counts.collect()] == [M.deduplicate(h).count()] == [3]
    assert "SortAggregate" not in counts._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ sessions and streaks (S04, F04), cards of months

@pytest.mark.parametrize("seed", range(3))
def test_runs_follow_uploads_in_any_order(spark, make_history, seed):
    """Plays around midnight, gaps of exactly 30 minutes, equal instants, replaced and empty uploads, before 1970."""
    rng, held, base = random.Random(seed), {}, tempfile.mkdtemp()
    store, folder = base + "/s", base + "/r"
    assert runs.sessions(spark, folder).count() == 0 and runs.streaks(spark, folder).count() == 0

    def some(n):
        return [play(None if rng.random() < 0.05 else f"{rng.choice([1969, 2020])}-{rng.choice(['12-31', '01-01', '01-02'])} "
                     f"{rng.choice(['00', '12', '23'])}:{rng.randint(0, 11) * 5:02d}:00", "a", ms=rng.choice([None, 1, 7]),
                     username=rng.choice(["x", None])) for _ in range(n)]

    for upload, n in [("b", 25), ("a", 25), ("b", 20), ("c", 0), ("d", 15)]:
        held[upload] = make_history(some(n))
        HS.append_history(held[upload], store, upload)
        runs.publish_runs(spark, store, upload, folder)
    h = HS.load_history(spark, store)
    assert runs.compact(spark, folder) == 4
    for by in (("username",), ()):
        assert rows(runs.sessions(spark, folder, by=by)) == rows(A.listening_sessions(h, 30, by))
        assert rows(runs.streaks(spark, folder, by=by)) == rows(A.streaks(h, by))
    ended = runs.sessions(spark, folder, closed_by="2020-01-01 00:00:00")
    assert rows(ended) == rows(A.listening_sessions(h).where("session_end <= timestamp'2020-01-01 00:00:00'"))


def test_one_listeners_runs_are_merged_by_day_first(spark, make_history):
    h = make_history([play(f"2020-01-{d:02d} 10:00:00", "a") for d in range(1, 9)])
    plan = runs.day_runs(h)._jdf.queryExecution().executedPlan().toString()
    spread = [line for line in plan.split("\n") if "hashpartitioning" in line]
    assert len(spread) == 2 and "day" in spread[0]   # equal instants, added up map-side, then (listener, day)
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_cards_of_months_follow_uploads(spark, make_history):
    rng, held, folder = random.Random(3), {}, tempfile.mkdtemp() + "/m"
    assert [tuple(r) for r in month_cards.cards(spark, folder).collect()] == [(0, 0, 0, 0)]
    assert month_cards.cards(spark, folder, ("username",)).count() == 0
    for upload, months in [("one", ["2020-03", "2020-06"]), ("two", ["2020-06", None]), ("one", ["2020-06", "2021-01"]), ("none", [])]:
        held[upload] = make_history(random_plays(rng, 30, months) if months else [])
        month_cards.commit(held[upload], folder, upload)
    h = held["one"].unionByName(held["two"])

    def want(part, by):
        return rows(part.groupBy(*by).agg(
            F.count(F.lit(1)).alias("streams"), F.coalesce(F.sum("ms_played"), F.lit(0)).alias("total_ms"),
            F.countDistinct(F.to_date("ts")).alias("active_days"), F.countDistinct("track_uri").alias("unique_songs")))

    assert month_cards.compact(spark, folder) == 3
    for by in ((), ("username",)):
        assert rows(month_cards.cards(spark, folder, by)) == want(h, by)
        assert rows(month_cards.cards(spark, folder, by, "2020-06", "2020-12")) == want(M.date_range(h, "2020-06-01", "2021-01-01"), by)
    plan = month_cards.cards(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ms_played" not in plan


def test_many_songs_are_estimated_within_three_per_cent(spark):
    n = 200_000
    h = spark.range(n * 2).select(F.lit("x").alias("username"), F.timestamp_seconds(F.lit(1_577_836_800) + F.col("id") * 100).alias("ts"),
                                  F.concat(F.lit("t"), F.col("id") % n).alias("track_uri"), F.lit(1).alias("ms_played"))
    folder = tempfile.mkdtemp() + "/m"
    for i in range(2):
        month_cards.commit(h.where(F.col("id") % 2 == i), folder, str(i))
    r = month_cards.cards(spark, folder).first()
    assert r.streams == 2 * n and abs(r.unique_songs - n) < 0.03 * n
