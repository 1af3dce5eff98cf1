import itertools

import numpy as np
import pytest

from tributary.operators import timestamps as ts

Z = "value string, zone string, ord string, series string, rank bigint, extra int"


def us(spark, rows):
    data = [(v, z, o, s, i, 0) for i, (v, z, o, s) in enumerate(rows)]
    df = spark.createDataFrame(data, Z)
    return {r.rank: r.utc_us for r in ts.normalise(df, "value", "zone", "ord", "series", "rank", "value", ["rank"]).collect()}


CASES = [
    ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
    ("2024-01-02T03:04:05.123456+00:00Z", "2024-01-02 03:04:05.123456"),
    (" 2024-01-02 03:04:05 +0530 ", "2024-01-01 21:34:05"),
    ("2024-07-01T12:00:00", "2024-07-01 16:00:00"),
    ("2024-07-01T12:00:00[Asia/Tokyo]", "2024-07-01 03:00:00"),
    ("20240102T030405Z", "2024-01-02 03:04:05"),
    ("2024/01/02 03:04:05", "2024-01-02 08:04:05"),
    ("2024-01-02", "2024-01-02 05:00:00"),
    ("01/02/2024 11:05 PM", "2024-01-03 04:05:00"),
    ("13/02/2024 10:00", "2024-02-13 15:00:00"),
    ("Tue, 02 Jan 2024 03:04:05 -0500", "2024-01-02 08:04:05"),
    ("Jan 2, 2024 12:05 AM EST", "2024-01-02 05:05:00"),
    ("1704164645", "2024-01-02 03:04:05"),
    ("1704164645123", "2024-01-02 03:04:05.123"),
    ("1704164645123456", "2024-01-02 03:04:05.123456"),
    ("2024-11-03 01:30:00", "2024-11-03 05:30:00"),
    ("2024-03-10 02:30:00", "2024-03-10 07:30:00"),
    ("1970-01-01T00:00:00Z", "1970-01-01 00:00:00"), ("1900-03-04 05:06:07Z", "1900-03-04 05:06:07"), ("2150-01-01", "2150-01-01 05:00:00"), ("99999999", "1973-03-03 09:46:39"), ("20240102", "2024-01-02 05:00:00"),
    ("1704164645123456789", "2024-01-02 03:04:05.123457"), ("17041646451234", "2510-01-11 06:40:51.234"),
    ("2024-02-30T10:00:00Z", None), ("0000-00-00 00:00:00", None), ("never", None), ("", None), ("  ", None), (None, None), ("12", None), ("9" * 100_000, None),
]


def test_spellings(spark):
    got = us(spark, [(v, "America/New_York", "mdy", "s") for v, _ in CASES])
    for i, (v, want) in enumerate(CASES):
        assert got.get(i) == (None if want is None else int(np.datetime64(want, "us").astype("int64"))), v


def test_order_decided_by_neighbours(spark):
    """Without a declared order the records around a number date tell which order it is in."""
    rows = [(f"{d:02d}/03/2024 10:00", None, None, "s") for d in (13, 14)] + [("05/04/2024 10:00", None, None, "s")] + [(f"{d:02d}/04/2024 10:00", None, None, "s") for d in (15, 16)]
    import pandas as pd

    assert us(spark, rows)[2] == pd.Timestamp("2024-04-05 10:00").value // 1000


def test_order_is_kept_over_records_that_do_not_show_it(spark):
    import pandas as pd

    for shown, want in (("25/03/2024 10:00", "2024-04-05"), ("03/25/2024 10:00", "2024-05-04")):
        rows = [(shown, None, None, "s"), *[(f"2024-03-2{i}T10:00:00Z", None, None, "s") for i in range(6, 9)], ("05/04/2024 10:00", None, None, "s"), ("2024-05-30", None, None, "s")]
        assert us(spark, rows)[4] == pd.Timestamp(f"{want} 10:00").value // 1000


def test_zone_names_with_several_meanings(spark):
    """A declared zone tells the meaning; without one it is the usual one, unless that would go back in time."""
    import pandas as pd

    got = us(spark, [("2024-01-02 12:00:00 CST", z, "mdy", z) for z in ("America/Chicago", "Asia/Shanghai", None)])
    assert [got[i] for i in range(3)] == [pd.Timestamp(t).value // 1000 for t in ("2024-01-02 18:00", "2024-01-02 04:00", "2024-01-02 18:00")]
    rows = [("2024-01-02 11:00:00Z", None, None, "s"), ("2024-01-02 12:00:00 IST", None, None, "s"), ("2024-01-02 13:00:00Z", None, None, "s")]
    assert us(spark, rows)[1] == pd.Timestamp("2024-01-02 11:00").value // 1000


def test_span_is_a_choice(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("1970-01-01", None, None), ("2024-01-01", None, None)], "v string, z string, o string")
    sizes = lambda **k: [r[0] for r in ts.candidates(df, "v", "z", "o", **k).select(F.size("candidates")).collect()]
    assert sizes() == [1, 1] and sizes(between=(10**15, 2 * 10**15)) == [0, 1]


def test_empty(spark):
    assert us(spark, []) == {}


@pytest.mark.parametrize("seed", range(6))
def test_blocks_equal_search_over_all(spark, seed):
    """Any block length gives the cost of the best of all combinations."""
    rng = np.random.default_rng(seed)
    n = 7
    cands = [[(int(rng.integers(0, 3)), float(rng.integers(0, 4)), int(rng.integers(1, 9)) * 10**15 // 4 + 10**15) for _ in range(int(rng.integers(1, 5)))] for _ in range(n)]

    def cost(path):
        c = sum(cands[i][k][1] for i, k in enumerate(path))
        for i in range(1, n):
            a, b = cands[i - 1][path[i - 1]], cands[i][path[i]]
            c += ts.SWITCH * (a[0] != b[0]) + ts.BACKWARD * (a[2] > b[2])
        return c

    best = min(cost(p) for p in itertools.product(*[range(len(c)) for c in cands]))
    df = spark.createDataFrame([("s", i, str(i), [{"fmt": f, "cost": c, "us": u} for f, c, u in cs]) for i, cs in enumerate(cands)], f"series string, rank bigint, tie string, candidates array<{ts.CANDIDATE}>")
    for block in (1, 3, 100):
        got = {r.rank: r.utc_us for r in ts.resolve(df, "series", "rank", "tie", ["rank"], block).collect()}
        assert len(got) == n
        options = [[k for k, c in enumerate(cs) if c[2] == got[i]] for i, cs in enumerate(cands)]
        assert min(cost(p) for p in itertools.product(*options)) == best
