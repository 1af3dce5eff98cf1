import random

import pytest

from tributary.llm.components import components, record_groups, smallest_names


def model(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            parent[find(a)] = find(b)
    groups = {}
    for v in parent:
        groups.setdefault(find(v), set()).add(v)
    return {v: min(g) for g in groups.values() for v in g}


def random_pairs(seed):
    r = random.Random(seed)
    n = 60
    return [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(45)]


CASES = {
    "path": [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(70)],
    "star": [("hub", f"leaf{i:03d}") for i in range(200)],
    "random": random_pairs(1),
    "odd": [("a", "a"), ("b", "c"), ("c", "b"), ("b", "c"), (None, "x"), ("y", None), ("", "a")],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_against_union_find(spark, name):
    df = spark.createDataFrame([(a, b, 0) for a, b in CASES[name]], "a string, b string, root int")
    got = {r.v: r.group_id for r in smallest_names(components(df)).collect()}
    assert got == model(CASES[name])


@pytest.mark.parametrize("hot_least", [5, 10**9])
@pytest.mark.parametrize("rounds", [1, 3])
def test_hot_vertices_and_rounds_change_nothing(spark, hot_least, rounds):
    pairs = CASES["star"] + CASES["path"] + CASES["random"] + [("hub", "v000")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r.v: r.group_id for r in smallest_names(components(df, rounds=rounds, hot_least=hot_least)).collect()}
    assert got == model(pairs)


def test_a_round_reads_the_edges_once(spark, monkeypatch):
    """With a hot vertex: what each written frame of a level reads, by the scans of its plan."""
    from tributary.llm import components as module

    reads = {}
    saved = module.saved

    def watched(df, label):
        files = df._jdf.queryExecution().optimizedPlan().toString()
        reads.setdefault(label, []).append(files.count("ldd-edges") or sum("src#" in x and "dst#" in x and "Relation" in x for x in files.splitlines()))
        return saved(df, label)

    monkeypatch.setattr(module, "saved", watched)
    df = spark.createDataFrame(CASES["star"] + CASES["path"], "a string, b string")
    components(df, rounds=4, hot_least=5).count()
    # A hot vertex splits one logical read of the edges in two filtered scans, of its edges and of the others'. The
    # last levels are too small for a hot vertex; there the first two rounds are one plan, whose labels are read twice.
    assert reads["ldd-labels"][:4] == [1, 2, 2, 2] and max(reads["ldd-labels"]) <= 3


def test_records(spark):
    rows = [("r1", "b", None), ("r1", "c", None), ("r2", "c", "d"), ("r3", "z", None), ("r3", "z", None), ("r4", None, "a"), ("r5", "d", "a"), (None, "q", "b"), ("r6", None, None)]
    got = {r.record: r.group_id for r in record_groups(spark.createDataFrame(rows, "record string, id string, linked string")).collect()}
    assert got == {"r1": "a", "r2": "a", "r3": "z", "r4": "a", "r5": "a", "r6": None}
    assert record_groups(spark.createDataFrame([], "record string, id string, linked string")).count() == 0
