"""Property tests: random small histories, Spark chart vs the brute-force chart."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import play
from test_charts import _minutes, brute_chart, spark_chart
from replaylab.operators import charts as C
from replaylab.operators import skips as S

MONTHS = ["2023-11", "2023-12", "2024-01", "2024-03", "2024-04"]

plays_st = st.lists(
    st.tuples(
        st.sampled_from(MONTHS + [None]),          # None = undated row
        st.sampled_from(["A", "B", "C", None]),      # artist (None = unknown)
        st.sampled_from(["t1", "t2", "t3"]),
        st.sampled_from([0, 1000, 2000, 60_000]),    # small set -> many ties
        st.sampled_from([True, False, None]),
    ),
    min_size=1, max_size=30,
)


def _rows(sample):
    return [play(f"{m}-15T12:00:00" if m else None, a, t, ms=ms, skipped=sk)
            for m, a, t, ms, sk in sample]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(sample=plays_st, limit=st.integers(1, 3))
def test_chart_equals_brute_force(spark, make_history, sample, limit):
    rows = _rows(sample)
    h = make_history(rows)
    for keys in (C.ARTIST, C.TRACK):
        want, months = brute_chart(rows, list(keys), limit)
        got = spark_chart(C.Chart(h, keys, limit, materialize_top=False))
        if want is None:   # no dated rows: fallback rows carry empty rank lists
            assert all(v[3] == [] for v in got.values())
            continue
        assert set(got) == set(want)
        for e, (rank, streams, ms, ranks) in want.items():
            assert got[e] == (rank, streams, _minutes(ms), ranks)
            assert len(ranks) == len(months)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(sample=plays_st)
def test_skip_stats_invariants(spark, make_history, sample):
    h = make_history(_rows(sample))
    st_ = S.with_global_rate(S.skip_stats(h), h)
    for r in S.skip_surprise(S.wilson(st_)).collect():
        assert 0 <= r.skips <= r.total_plays
        if r.total_plays:
            assert r.low - 1e-12 <= r.skip_rate <= r.high + 1e-12
            assert 0.0 <= r.p_value <= 1.0
