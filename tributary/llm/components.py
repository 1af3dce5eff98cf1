"""Groups of records that pairwise matches link directly or indirectly, by low-diameter decomposition.

Every vertex draws an exponential shift and starts growing a cluster that much before the latest possible start;
a vertex joins the cluster that reaches it first. Clusters so grown have a small radius, and only a fraction of the
edges runs between them. They are contracted to super-vertices, the edges between clusters are the next level's
graph, and the assignments of all levels are composed.

A few rounds of growth a level suffice: a vertex always joins a cluster it is connected to, so cutting the growth
short costs at most another level and never a wrong group.

Vertices are numbered once, so that levels move two longs an edge; a label is one long, the time of arrival above the
number of its center, and the earliest is a minimum that hash aggregation finds without sorting. Labels are written
every round, so that no plan reads the edges more than once; only the two rounds of a graph too small to have hot
vertices are one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.skew import HOT_SHARE, lookup_join
from tributary.session import saved, saved_rows

#: Rate of the shifts (larger: smaller clusters) and rounds of growth a level.
BETA, ROUNDS = 0.1, 2
MAX_LEVELS = 60
#: A vertex is hot if it has at least so many edges and at least 1/HOT_SHARE of all.
HOT_LEAST = 20_000
#: Bits of a vertex number, of which the low ones are the task that gave it; bits of a label's time are the rest.
NUMBER_BITS, TASK_BITS = 44, 16
#: A round of growth in units of a label's time, and the latest time (that of a vertex without a head start).
ROUND, LATEST = 1 << 9, (1 << 18) - 1


def _number() -> Column:
    """A number below 2 ** NUMBER_BITS, unique in the DataFrame: place within the task, then the task."""
    raw = F.monotonically_increasing_id()
    row, task = raw.bitwiseAND((1 << 33) - 1), F.shiftright(raw, 33)
    fits = (task < (1 << TASK_BITS)) & (row < (1 << (NUMBER_BITS - TASK_BITS)))
    return F.when(fits, F.shiftleft(row, TASK_BITS).bitwiseOR(task)).otherwise(F.raise_error(F.lit("too many vertices a task")).cast("bigint"))


def _start(v: Column, level: int) -> Column:
    """The label of a vertex's own cluster. The shift depends on vertex and level alone, so a lost task draws it again."""
    u = (F.shiftrightunsigned(F.xxhash64(v, F.lit(level)), 11) + F.lit(1)) / F.lit(float(1 << 53) + 1)
    shift = F.least(F.floor(-F.log(u) / BETA * ROUND), F.lit(LATEST)).cast("bigint")
    return F.shiftleft(F.lit(LATEST) - shift, NUMBER_BITS).bitwiseOR(v)


def _later(label: Column) -> Column:
    return label + F.lit(ROUND << NUMBER_BITS)


def _center(label: Column) -> Column:
    return label.bitwiseAND((1 << NUMBER_BITS) - 1)


def _by_src(edges: DataFrame, labels: DataFrame, hot: list[int]) -> DataFrame:
    """edges joined with labels (one row a vertex) on src; hot sources meet a broadcast of at most len(hot) rows."""
    if not hot:
        return edges.join(labels, "src")
    is_hot = F.col("src").isin(hot)
    cold = edges.where(~is_hot).join(labels.where(~is_hot), "src")
    return cold.unionByName(edges.where(is_hot).join(F.broadcast(labels.where(is_hot)), "src"))


def first_round(edges: DataFrame, level: int) -> DataFrame:
    """(src, label, was, degree) after one round, which needs no join: a neighbour's start follows from its number."""
    own = _start(F.col("src"), level)
    near = edges.groupBy("src").agg(F.min(_later(_start(F.col("dst"), level))).alias("near"), F.count(F.lit(1)).alias("degree"))
    return near.select("src", F.least(own, F.col("near")).alias("label"), own.alias("was"), "degree")


def next_round(edges: DataFrame, labels: DataFrame, hot: list[int]) -> DataFrame:
    """Labels after one more round; only vertices whose label changed in the last one tell their neighbours."""
    told = _by_src(edges, labels.where("label <> was").select("src", "label"), hot)
    reached = told.select(F.col("dst").alias("src"), _later(F.col("label")).alias("label"), F.lit(None).cast("bigint").alias("was"))
    both = reached.unionByName(labels.select("src", "label", F.col("label").alias("was")))
    return both.groupBy("src").agg(F.min("label").alias("label"), F.min("was").alias("was"))


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = ROUNDS, hot_least: int = HOT_LEAST) -> DataFrame:
    """(v, root) for every vertex that occurs in a pair: one root (a number) for all that is connected at any distance.

    Pairs with a null end tie nothing; loops, repeats and reversed pairs do no harm; a vertex that occurs only in a
    loop is its own root. Other columns are not read. No pairs give an empty result. Nothing but counts and at most
    HOT_SHARE hot vertices reaches the driver; every level is written to the shared folder, so a lost executor costs
    one round at most."""
    ends = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    ends, n = saved_rows(ends.distinct(), "ldd-pairs")
    vertices = saved(ends.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", _number().alias("n")), "ldd-vertices")
    numbered = ends.where("a <> b")
    for end, number in (("a", "src"), ("b", "dst")):
        of_end = vertices.select(F.col("v").alias(end), F.col("n").alias(number))
        numbered = lookup_join(numbered, of_end, end, "inner", least=hot_least) if n >= hot_least else numbered.join(of_end, end)
    edges, n = saved_rows(numbered.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct(), "ldd-edges")
    levels: list[DataFrame] = []
    large: list[bool] = []
    while n:
        large.append(n >= hot_least)
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the decomposition does not end")
        labels, hot = first_round(edges, len(levels)), []
        if n >= hot_least:
            labels = saved(labels, "ldd-labels")
            floor = max(hot_least, -(-n // HOT_SHARE))
            hot = [r[0] for r in labels.where(F.col("degree") >= floor).select("src").collect()]
        for _ in range(rounds - 1):
            labels = saved(next_round(edges, labels, hot), "ldd-labels")
        to = labels.select("src", _center(F.col("label")).alias("center"))
        levels.append(to)
        # An edge whose ends met is no edge of the next level; the edges are symmetric, so one side is enough.
        half = _by_src(edges.where("src < dst"), to, hot).select(F.col("dst").alias("src"), F.col("center").alias("other"))
        between = _by_src(half, to, hot).where("center <> other").select(F.least("center", "other").alias("a"), F.greatest("center", "other").alias("b")).distinct()
        both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
        edges, n = saved_rows(between.select(both.alias("e")).select("e.*"), "ldd-edges")
    named = vertices.select("v", F.col("n").alias("at"))
    if not levels:
        return named.select("v", F.col("at").alias("root"))
    composed = levels[-1].select("src", F.col("center").alias("root"))
    for i, lower in enumerate(reversed(levels[:-1]), 1):
        up = composed.select(F.col("src").alias("center"), F.col("root").alias("up"))
        composed = (lookup_join(lower, up, "center", least=hot_least) if large[-1 - i] else lower.join(up, "center", "left")).select("src", F.coalesce("up", "center").alias("root"))
        if i % 4 == 0 or large[-1 - i]:
            composed = saved(composed, "ldd-composed")
    return named.join(composed.select(F.col("src").alias("at"), "root"), "at", "left").select("v", F.coalesce("root", "at").alias("root"))


def smallest_names(members: DataFrame) -> DataFrame:
    """(v, group_id) of (v, root): the group is named by its smallest member."""
    names = members.groupBy("root").agg(F.min("v").alias("group_id"))
    return lookup_join(members, names, "root", least=HOT_LEAST).select("v", "group_id")


def record_groups(rows: DataFrame) -> DataFrame:
    """(record, group_id) of rows (record, id, linked): each distinct non-null record with its group.

    A row ties its record to id and id to linked; null ends tie nothing. group_id is the smallest id, from either
    column, of all that is connected; null for a record that has no id at all."""
    rows = saved(rows.select("record", F.coalesce("id", "linked").alias("id"), "linked").distinct(), "record-rows")
    named = saved(rows.where("record is not null").groupBy("record").agg(F.min("id").alias("first"), F.max("id").alias("last")), "record-names")
    shared = named.where("first <> last").select("record", "first")
    ties = lookup_join(rows.where("record is not null and id is not null"), shared, "record", "inner", least=HOT_LEAST).select(F.col("id").alias("a"), F.col("first").alias("b"))
    links = rows.where("linked is not null").select(F.col("id").alias("a"), F.col("linked").alias("b"))
    groups = saved(smallest_names(components(ties.unionByName(links))), "record-groups")
    out = lookup_join(named.select("record", F.col("first").alias("v")), groups, "v", least=HOT_LEAST)
    return out.select("record", F.coalesce("group_id", "v").alias("group_id"))
