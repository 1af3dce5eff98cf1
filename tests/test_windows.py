import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tributary.operators import windows

T0 = datetime.datetime(2024, 1, 1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 8000)), min_size=1, max_size=30))
def test_sessions_against_model(spark, events):
    df = spark.createDataFrame([(u, T0 + datetime.timedelta(seconds=s), i) for i, (u, s) in enumerate(events)], "u string, ts timestamp, i int")
    got = {(r.u, r.i): r.sess_num for r in windows.with_sessions(df, "u", "ts", 1800, "i").collect()}
    for u in "ab":
        mine = sorted((s, i) for i, (x, s) in enumerate(events) if x == u)
        num, last = 0, None
        for s, i in mine:
            num += last is None or s - last > 1800
            last = s
            assert got[u, i] == num


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 1, "n"), ("b", None, "q")], "k string, t int, v string")
    assert sorted((r.k or "", r.t, r.v) for r in windows.latest_per_key(df, ["k"], ["t"]).collect()) == [("", 1, "n"), ("a", 2, "z"), ("b", None, "q")]
    assert windows.latest_per_key(df.limit(0), ["k"], ["t"]).count() == 0


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 5), ("a", 1), ("b", 9), (None, 5), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), (None, 1, "n")], "k string, t int, v string")
    got = sorted(((r.k or "", r.t or 0, r.asof_v) for r in windows.asof_join(left, right.withColumnRenamed("t", "rt"), "k", "t", "rt", ["v"], "v").collect()), key=str)
    assert got == sorted([("", 5, None), ("a", 0, None), ("a", 1, None), ("a", 5, "z"), ("a", 5, "z"), ("b", 9, None)], key=str)


def test_funnel_without_later_steps(spark):
    df = spark.createDataFrame([("u", "d", "view")], "u string, d string, e string")
    assert [(r.step_users, r.dropoff, r.dropoff_rate) for r in windows.funnel(df, ["u"], "d", "e", ["view", "buy"]).orderBy("step_number").collect()] == [(1, 1, 1.0), (0, 0, 0.0)]
