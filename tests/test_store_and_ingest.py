"""Shared store for batch and stream, tolerant ingest, zones, pruning, whole-row dedup, large binomial tails."""

from __future__ import annotations

import json
import tempfile
from decimal import Decimal, getcontext
from pathlib import Path

import pytest
from conftest import play
from pyspark.sql import functions as F

from replaylab import api, session
from replaylab.functions import expr as X
from replaylab.operators import activity as A
from replaylab.operators import charts as C
from replaylab.operators import metrics as M
from replaylab.operators import skips as S
from replaylab.sources import export_json as E
from replaylab.sources import history_store as HS
from replaylab.streaming import pipelines as P


def rec(ts, track="T", user="me", ms=1000, **kw):
    return {"ts": ts, "username": user, "ms_played": ms, "master_metadata_track_name": track,
            "master_metadata_album_artist_name": "A", "spotify_track_uri": f"spotify:track:{track}", **kw}


@pytest.fixture()
def folder(tmp_path):
    return tmp_path


def write(folder, name, content):
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))
    return str(folder / name)


# ------------------------------------------------------------------ ingest

PLAYS = [rec(f"2024-01-0{i}T10:00:00Z", f"T{i}") for i in range(1, 6)]
NDJSON = "\n".join(json.dumps(p) for p in PLAYS)


def test_newline_delimited_files_keep_all_rows(spark, folder):
    for name, text in (("a.json", NDJSON), ("b.json", NDJSON + "\n\n"), ("c.json", NDJSON.replace("\n", "\r\n")), ("d.json", "﻿" + NDJSON),
                       ("e.json", json.dumps(PLAYS)), ("f.json", "\n " + json.dumps(PLAYS, indent=2))):
        assert E.read_export(spark, [write(folder, name, text)]).count() == 5, name
    for name, text in (("g.json", ""), ("h.json", " \n"), ("i.json", "[]")):
        assert E.read_export(spark, [write(folder, name, text)]).count() == 0


@pytest.mark.parametrize("text, good", [
    ("{not json", 0), (NDJSON[:-5], 4), ('"text"', 0), ("5", 0), (json.dumps([*PLAYS, 7]), 5), (json.dumps([None, *PLAYS]), 5),
    (json.dumps([*PLAYS, [PLAYS[0]]]), 5), (json.dumps(PLAYS)[:-20], 4), (NDJSON + "\nnonsense", 5),
])
def test_bad_parts_are_named_and_cost_no_good_row(spark, folder, text, good):
    path = write(folder, "Bad.json", text)
    with pytest.raises(Exception, match="Bad.json"):
        E.read_export(spark, [path]).collect()
    plays, problems = E.split_problems(E.read_parsed(spark, [path]))
    assert plays.count() == good
    assert {r.file_name for r in problems.collect()} == {"Bad.json"}
    assert E.read_export(spark, [path], strict=False).count() == plays.count()


def test_no_size_changes_a_play(spark, folder):
    names = ["A}B", "{x}", "a {} b", 'say "}" {"k": 1}', "\\}", "a}, {b", "}", "é}{", "[}]", ", {"]
    plays = [rec(f"2024-02-{i + 10}T10:00:00Z", n, extra={"deep": [{"a": "}"}]} if i % 3 == 0 else i) for i, n in enumerate(names)] + PLAYS
    files = {"lines.json": "\n".join(map(json.dumps, plays)) + "\n", "crlf.json": "\r\n".join(map(json.dumps, plays)), "one.json": json.dumps(plays),
             "pretty.json": json.dumps(plays, indent=2), "bom.json": "\ufeff" + json.dumps(plays, indent=1), "tight.json": json.dumps(plays, separators=(",", ":"))}
    files["utf8.json"] = json.dumps(plays, ensure_ascii=False)
    paths = [write(folder, name, text) for name, text in files.items()]
    want = sorted((p["ts"], p["master_metadata_track_name"], str(p["ms_played"])) for p in plays for _ in files)
    for limit in (1 << 20, 10):
        got = E.read_export(spark, paths, max_whole_bytes=limit).select("ts", "master_metadata_track_name", "ms_played").collect()
        assert sorted(map(tuple, got)) == want, limit
    assert E.read_export(spark, [write(folder, n, t) for n, t in (("e1.json", "[ ]"), ("e2.json", " \n"), ("e3.json", "[\n]\n"))], max_whole_bytes=1).count() == 0


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("limit", [10, 1 << 20])
def test_a_cut_array_gives_its_whole_plays_and_all_the_rest(spark, folder, indent, limit):
    text = json.dumps(PLAYS, indent=indent)
    ends = [i + 1 for i, c in enumerate(text) if c == "}"]
    paths, want = [], 0
    for n, cut in enumerate((ends[4], ends[4] - 1, ends[3] + 20, ends[3] + 1, ends[3], ends[0] - 1, 30, 1)):
        paths.append(write(folder, f"cut{n}.json", text[:cut]))
        want += sum(e <= cut for e in ends)
    # The rest is longer than any cap: a play whose name is long and never ends.
    paths.append(write(folder, "long.json", text[:ends[1]] + ', {"ts": "' + "x" * 5000))
    plays, problems = E.split_problems(E.read_parsed(spark, paths, max_whole_bytes=limit))
    assert plays.count() == want + 2
    rows = problems.collect()
    assert {r.file_name for r in rows} == {p.rsplit("/", 1)[1] for p in paths}
    assert any("x" * 5000 in r.problem for r in rows)
    for path in (paths[0], paths[-1]):
        with pytest.raises(Exception, match="Not a JSON array of plays"):
            E.read_export(spark, [path], max_whole_bytes=limit).count()


@pytest.mark.parametrize("limit", [10, 1 << 20])
def test_every_object_of_a_line_is_read(spark, folder, limit):
    texts = [json.dumps(p) for p in PLAYS]
    files = {"one.json": json.dumps(PLAYS), "pairs.json": ",".join(texts[:2]) + "\n" + ",".join(texts[2:]) + "\n",
             "pairs_array.json": "[" + ",".join(texts[:2]) + ",\n" + ",".join(texts[2:]) + "]", "empty.json": "[ ]"}
    paths = [write(folder, name, text) for name, text in files.items()]
    got = E.read_export(spark, paths, max_whole_bytes=limit)
    assert [got.where(F.col("ts") == p["ts"]).count() for p in PLAYS] == [3 * sum(q["ts"] == p["ts"] for q in PLAYS) for p in PLAYS]
    for text in ("".join(texts), " ".join(texts), f"[{texts[0]}][{texts[1]}]", f"[{texts[0]}], [{texts[1]}]", f"[{texts[0]}] tail", texts[0] + "tail"):
        with pytest.raises(Exception, match="roots.json"):
            E.read_export(spark, [write(folder, "roots.json", text)], max_whole_bytes=limit).collect()


def test_count_alone_still_fails_on_a_bad_file(spark, folder):
    with pytest.raises(Exception, match="Bad.json"):
        E.read_export(spark, [write(folder, "Bad.json", "{oops")]).count()


def test_partial_times_are_null(spark, folder):
    times = ["2024-01-01T10:00:00Z", "12:30", "2024", "2024-01-01", "2024-01-01 10:00", "2024-01-01T12:00:00+02:00", "nonsense", None]
    path = write(folder, "t.json", [rec(t) for t in times])
    got = [r.t for r in E.ingest(spark, [path]).select(X.iso_text("ts").alias("t")).collect()]
    ten = "2024-01-01T10:00:00.000000Z"
    assert got == [ten, None, None, None, ten, ten, None, None]


# ------------------------------------------------------------------ store

def test_batch_and_stream_share_one_store(spark, folder):
    store, ckpt = P.scratch(spark, "t")
    drop = Path(tempfile.mkdtemp(prefix="drop-"))
    up = [write(folder, "u1.json", [rec("2024-01-01T00:00:00Z"), rec("2023-01-01T00:00:00Z")])]
    assert api.upload(spark, up, store)["total_rows"] == 2
    write(drop, "d1.json", [rec("2024-02-01T00:00:00Z")])
    write(drop, "bad.json", "{broken")
    for _ in range(2):
        P.ingest_to_store(spark, str(drop), store, ckpt)
    assert HS.load_history(spark, store).count() == 3
    assert {r.file_name for r in spark.read.json(f"{ckpt}-quarantine").collect()} == {"bad.json"}
    assert api.upload(spark, up, store)["total_rows"] == 5
    write(drop, "d2.json", [rec("2024-03-01T00:00:00Z")])
    P.ingest_to_store(spark, str(drop), store, ckpt)
    assert HS.load_history(spark, store).count() == 6
    # The same upload id again replaces that upload.
    h = HS.load_history(spark, store).drop("year").limit(2)
    rows = spark.createDataFrame(h.collect(), h.schema)
    for _ in range(2):
        HS.append_history(rows, store, "again")
    assert HS.load_history(spark, store).count() == 8


def test_sink_log_is_refused(spark, folder):
    sink, ckpt = P.scratch(spark, "t")
    write(folder, "a.json", PLAYS)
    P.run_available_now(P.ingest_stream(spark, str(folder)), sink, ckpt)
    with pytest.raises(HS.NotAHistoryStore):
        HS.load_history(spark, sink)
    with pytest.raises(HS.NotAHistoryStore):
        HS.append_history(E.ingest(spark, [str(folder / "a.json")]), sink)


def test_dedup_into_store_takes_older_files(spark, folder):
    store, ckpt = P.scratch(spark, "t")
    write(folder, "new.json", [rec("2024-05-01T00:00:00Z"), rec("2024-05-01T00:00:00Z"), rec("2024-05-02T00:00:00Z", user=None)])
    P.dedup_into_store(spark, str(folder), store, ckpt)
    write(folder, "old.json", [rec("2020-01-01T00:00:00Z"), rec("2024-05-01T00:00:00Z"), rec("2024-05-02T00:00:00Z", user=None), rec(None), rec(None)])
    P.dedup_into_store(spark, str(folder), store, ckpt)
    assert HS.load_history(spark, store).count() == 4


def test_scratch_folders_are_released(spark):
    path = session.scratch_folder(spark, "t")
    spark.range(3).write.parquet(path)
    assert session.release_scratch(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


# ------------------------------------------------------------------ zones and pruning

def test_results_do_not_depend_on_the_session_zone(spark, folder):
    path = write(folder, "z.json", [rec("2024-01-01T02:00:00Z", "X"), rec("2023-12-31T23:00:00Z", "X"), rec("2024-07-01 03:30:00", "Y"), rec("1969-12-31T23:59:59Z", "Z")])
    seen = []
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            store = session.scratch_folder(spark, "zone")
            HS.append_history(E.ingest(spark, [path]), store)
            h = HS.load_history(spark, store)
            seen.append((
                sorted((r.year, r.n) for r in h.groupBy("year").agg(F.count("*").alias("n")).collect()),
                sorted(map(str, A.daily_counts(h).collect())),
                sorted(map(str, A.daily_counts(h, 2024, tz="America/New_York").collect())),
                sorted(map(str, C.Chart(h, C.TRACK, 3).long().collect())),
                M.date_range(h, "2024-01-01", "2024-07-01T04:00:00").count(),
                M.preset_range(h, "last_6_months").count(),
                sorted(r.t for r in E.to_raw(h).select(F.col("ts").alias("t")).collect()),
            ))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seen[0] == seen[1] == seen[2]
    assert seen[0][0] == [(1969, 1), (2023, 1), (2024, 2)]
    assert len(seen[0][2]) == 1  # 02:00 UTC on Jan 1 is still 2023 in New York


def test_ts_ranges_prune_year_folders(spark, make_history):
    store = session.scratch_folder(spark, "prune")
    HS.append_history(make_history([play(f"{y}-06-01T00:00:00", "A", "T") for y in range(2018, 2026)]), store)
    h = HS.load_history(spark, store)
    for df, n in ((A.year_filter(h, 2022), 1), (M.date_range(h, "2020-01-01", "2022-01-01"), 2), (M.date_range(h, start="2024-01-01"), 2),
                  (A.year_filter(h, 2022, tz="Asia/Tokyo"), 1), (M.date_range(h, end="2019-01-01"), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = plan[plan.index("PartitionFilters: ["):].split("]")[0]
        assert "year" in filters, plan
        assert df.count() == n


def fact_scans(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[:plan.find("Initial Plan")].count("FileScan") if "Initial Plan" in plan else plan.count("FileScan")


def test_one_scan_for_skip_rates_and_grids(spark, make_history):
    store = session.scratch_folder(spark, "scan")
    HS.append_history(make_history([play(f"2024-06-0{i}T00:00:00", "AB"[i % 2], "T", skipped=i % 3 == 0) for i in range(1, 9)]), store)
    h = HS.load_history(spark, store)
    plan = S.most_hated(h, n=3, min_plays=1)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text or fact_scans(plan) == 1
    assert fact_scans(A.calendar_grid(A.daily_counts(h, 2024), 2024)) == 1
    ranges = C.Chart(h, C.ARTIST, 3)
    assert fact_scans(ranges.header()) == 1 and "top" not in ranges.__dict__


# ------------------------------------------------------------------ dedup

def test_dedup_keeps_different_plays_without_uri(make_history):
    rows = [play("2024-01-01T00:00:00", "A", "x", track_uri=None), play("2024-01-01T00:00:00", "A", "y", track_uri=None),
            play("2024-01-01T00:00:00", "A", "y", track_uri=None), play("2024-01-01T00:00:00", "A", "z", ms=5), play("2024-01-01T00:00:00", "A", "z", ms=3),
            play(None, None, None, username=None), play(None, None, None, username=None)]
    out = M.deduplicate(make_history(rows)).collect()
    assert sorted((r.track_name or "", r.ms_played) for r in out) == [("", 60_000), ("x", 60_000), ("y", 60_000), ("z", 3)]


# ------------------------------------------------------------------ binomial tail

def exact_tail(k, n, p):
    """P(X >= k) with 60 digits: log C(n, k) by Stirling's series, then the terms' ratios."""
    getcontext().prec = 60
    pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494459")

    def lg(z):  # log Gamma(z + 1)
        if z < 200:
            f = Decimal(1)
            for i in range(2, int(z) + 1):
                f *= i
            return f.ln()
        z = Decimal(z)
        return (z + Decimal("0.5")) * z.ln() - z + (2 * pi).ln() / 2 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)

    p = Decimal(p)
    term = (lg(n) - lg(k) - lg(n - k) + k * p.ln() + (n - k) * (1 - p).ln()).exp()
    total, i = Decimal(0), k
    while i <= n and (term > total * Decimal("1e-30") or i < n * p):
        total += term
        term = term * (n - i) / (i + 1) * p / (1 - p)
        i += 1
    return float(total)


def test_binomial_tail_stays_precise_for_large_n(spark):
    cases = [(10, 20, 0.3), (300, 1000, 0.28), (3100, 10_000, 0.3), (301_000, 1_000_000, 0.3), (500, 1_000_000, 0.0004), (302_500, 1_000_000, 0.3), (5, 30, 0.01)]
    df = X.with_binom_sf(spark.createDataFrame(cases, "k long, n long, p double"), "k", "n", "p")
    for r in df.collect():
        want = exact_tail(r.k, r.n, r.p)
        assert abs(r.p_value - want) <= 2e-11 * want, (r, want)


# ------------------------------------------------------------------ payloads

def test_cards_of_the_service(make_history):
    rows = [play(f"2023-0{i}-01T00:00:00", "A", f"T{i % 3}", skipped=i % 2 == 0) for i in range(1, 9)]
    h = make_history(rows)
    assert api.unique_songs(h)["unique_songs"] == 3
    assert api.active_days(h)["active_days"] == 8
    grid = api.heatmap(h, 2023)
    assert grid["active_days"] == 8 and grid["total_streams"] == 8 and len(grid["cells"]) % 7 == 0
    hated = api.most_hated(h, min_plays=2)["data"]
    assert hated[0]["artist_name"] == "A" and hated[0]["skips"] == 4
