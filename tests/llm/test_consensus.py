import random

from pyspark.sql import functions as F

from tributary.llm import consensus as c


def test_progressive_vote():
    w = [1.0, 1.0, 1.0]
    assert c.consensus(["Anna Maria Lee", "Anna Lee", "Anna Maria Lea"], w) == "Anna Maria Lee"
    assert c.consensus(["b x", "a x", "a x"], w) == "a x"
    assert c.consensus([], []) is None
    assert c.consensus(["only"], [1.0]) == "only"
    assert c.consensus(["new one", "old", "old", "old"], [1, 0.5, 0.25, 0.125]) == "new one"


def test_alignment_keeps_columns():
    assert c.align([{"a": 1.0}, {"b": 1.0}], ["a", "x", "b"]) == [(0, "a"), (None, "x"), (1, "b")]


def test_survivors(spark):
    t = "tok_" + "a1" * 16
    u = "tok_" + "b2" * 16
    empty = "tok_" + "0" * 32
    rows = [("k", t, 1, 9), ("k", u, 2, 9), ("k", empty, 3, 9), ("k", " ", 4, 9), ("k", None, 5, 9), ("one", t, 1, 9), ("none", "x", 1, 9), ("none", "x", 1, 9), (None, t, 1, 9), (None, t, 2, 9), ("tie", u, 7, 9), ("tie", t, 7, 9), ("late", t, None, 9), ("late", u, 1, 9)]
    df = spark.createDataFrame(rows, "id string, v string, at int, rank int")
    got = {r.id: r.v for r in c.survivors(df, "id", {"v": c.usable_token(F.col("v"))}, "at").collect()}
    assert got == {"k": u, "none": None, "tie": t, "late": u}
    assert c.survivors(df.limit(0), "id", {"v": F.col("v")}, "at").count() == 0


def test_hot_group(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 500)) as id", "concat('v', id) as v", "id as at")
    got = {r.id: r.v for r in c.survivors(df, "id", {"v": F.col("v")}, "at").collect()}
    assert got["hot"] == "v2997"


def test_survivors_do_nothing_that_cannot_change_the_latest(spark):
    """No older value is ranked, collected or voted on: only the latest of each field goes on, picked without Python."""
    r = random.Random(4)
    rows = [(r.choice([None, *"abcdefgh"]), r.choice([None, "x y", "x z", "x  y", ""]), r.choice([None, "p", "q"]), r.choice([None, 1, 2, 3])) for _ in range(120)]
    df = spark.createDataFrame(rows, "id string, v string, w string, at int")
    found = c.survivors(df, "id", {"v": F.col("v"), "w": F.col("w")}, "at")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Window", "Generate", "collect_list")), plan
    want = {}
    for k in {x[0] for x in rows} - {None}:
        group = [x for x in rows if x[0] == k]
        if len(group) > 1:
            want[k] = tuple(min(((-(x[3] or 0), x[i]) for x in group if x[i] is not None), default=(0, None))[1] for i in (1, 2))
    assert {x.id: (x.v, x.w) for x in found.collect()} == want


def votes_of(rows):
    """(key, field) -> {value: weight} by plain loops; copies of a row vote once."""
    out = {}
    for k, v, w in set(rows):
        if k is not None and v is not None:
            out.setdefault(k, {})
            out[k][v] = out[k].get(v, 0) + w
    return out


def test_consensus_rows_against_a_loop(spark):
    r = random.Random(8)
    names = ["Anna Maria Lee", "Anna Lee", "Anna Maria Lea", "A Maria Lee", "Bob", None]
    rows = [(f"k{r.randrange(40)}", r.choice(names), r.randrange(1, 5) * 10, "x") for _ in range(300)] + [(None, "Bob", 5, "x"), ("lone", "Bob", 5, "x"), ("void", None, 5, "x"), ("void", None, 6, "x")]
    df = spark.createDataFrame(rows, "id string, v string, w int, value string")
    got = {x.id: x.v for x in c.consensus_rows(df, "id", {"v": F.col("v")}, F.col("w").cast("bigint")).collect()}
    sizes = {k: sum(x[0] == k for x in rows) for k in {x[0] for x in rows} - {None}}
    votes = votes_of([x[:3] for x in rows])
    want = {}
    for k in (k for k, n in sizes.items() if n > 1):
        ranked = sorted(((w, v) for v, w in votes.get(k, {}).items()), key=lambda x: (-x[0], x[1]))
        want[k] = c.consensus([v for _, v in ranked], [float(w) for w, _ in ranked])
    assert got == want and got["void"] is None and "lone" not in got
    assert c.consensus_rows(df.limit(0), "id", {"v": F.col("v")}, F.col("w").cast("bigint")).count() == 0


def test_the_vote_decides_and_not_the_latest(spark):
    """Two older trusted rows that agree in most tokens outvote the latest one; their common form comes out."""
    rows = [("k", "Ann Marie Leigh", 0.9, "2024-01-01"), ("k", "Ann Marie Lee", 0.9, "2024-01-02"), ("k", "Ann Mary Lee", 0.9, "2024-02-01"), ("k", "Zoe", 0.8, "2024-06-01")]
    df = spark.createDataFrame(rows, "id string, v string, trust double, at string").withColumn("at", F.to_timestamp("at"))
    weight = c.row_weight(F.col("trust"), [F.col("v")], F.col("at"), F.lit("2024-06-01").cast("timestamp"))
    by_vote = c.consensus_rows(df, "id", {"v": F.col("v")}, weight).first().v
    assert by_vote == "Ann Marie Lee" and c.survivors(df, "id", {"v": F.col("v")}, "at").first().v == "Zoe"


def test_large_group_votes_in_blocks(spark):
    df = spark.range(2000).selectExpr("'hot' as id", "if(id % 4 = 0, 'Ann Lee', concat('Ann L', id)) as v", "id % 7 + 1 as w").unionByName(spark.range(2).selectExpr("'small' as id", "'x' as v", "id + 1 as w"))
    got = {x.id: x.v for x in c.consensus_rows(df, "id", {"v": F.col("v")}, F.col("w"), block=16).collect()}
    assert got == {"hot": "Ann Lee", "small": "x"}


def test_consensus_differs_from_the_latest_on_the_tables(spark):
    import os

    from tributary.llm.queries import p4_consensus, p4_found

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        return
    a, b = ({r.customer_id: r for r in q(spark, sf).collect()} for q in (p4_consensus, p4_found))
    assert set(a) == set(b)
    fields = ("email_token", "first_name_token", "last_name_token")
    assert sum(a[k][f] != b[k][f] for k in a for f in fields) > 0
    assert all((a[k][f] is None) == (b[k][f] is None) for k in a for f in fields)
