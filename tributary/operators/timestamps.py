"""Normalisation of timestamps written in many ways to one instant in UTC.

Every text gets all its valid interpretations as an array (date orders, both readings of a repeated wall clock, the
meanings of an ambiguous zone name, a number as a date and as an epoch); the interpretation is chosen by Viterbi over
the records of one source in their order. An interpretation costs what it contradicts of the source's declared
convention, or a little where it is the less usual one; a step costs a little for a switch of the source's format (its
date order, which it keeps over records that do not show it) and for a jump back in time. A declared convention
outweighs any step; where nothing is declared, the path decides.

A source may hold any share of all rows, so its sequence is worked in blocks: each block gives a small min-plus
matrix from its first record's interpretations to its last one's, the matrices of a source are chained, and every
block then traces its own path back from the exit it was given.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.session import saved

#: States of one record, at most: two date orders times three readings of a wall clock or zone name.
READINGS = 3
SLOTS = 2 * READINGS
#: Costs of contradicting a declared order or zone, of the later of two equal wall clocks, and of a less usual reading
#: of a zone name or a number.
CONTRADICTS, SECOND_READING, UNUSUAL = 1000.0, 1000.0, 1.5
SWITCH, BACKWARD = 1.0, 2.0
#: Records of one source that are worked in one block.
BLOCK = 200_000

#: Minutes east of UTC of the zone abbreviations in use, the most usual meaning first.
ABBREVIATIONS = {
    "UTC": [0], "GMT": [0], "Z": [0], "WET": [0], "WEST": [60], "BST": [60, 360, 660], "CET": [60], "CEST": [120], "EET": [120], "EEST": [180], "MSK": [180],
    "EST": [-300], "EDT": [-240], "CST": [-360, 480, -300], "CDT": [-300, -240], "MST": [-420, 480], "MDT": [-360], "PST": [-480, 480], "PDT": [-420],
    "AKST": [-540], "AKDT": [-480], "HST": [-600], "AST": [-240, 180], "ADT": [-180], "NST": [-210], "BRT": [-180], "BRST": [-120], "ART": [-180], "IST": [330, 60, 120], "PKT": [300],
    "SGT": [480], "HKT": [480], "JST": [540], "KST": [540], "AWST": [480], "ACST": [570], "ACDT": [630], "AEST": [600], "AEDT": [660], "NZST": [720], "NZDT": [780], "SAST": [120],
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}(?:[.,]\d{1,9})?))?"
ZONE = r"(?:\s*(Z|[A-Za-z]{1,5}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?Z?|\[[A-Za-z0-9_+\-/]+\]))?"
#: Format -> (pattern, replacement giving year|month|day|hour|minute|second|half|zone). @ stands for the month name.
PATTERNS = {
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[T ]\s*{CLOCK}{ZONE}$", "$1|$2|$3|$4|$5|$6||$7"),
    "ymd": (rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})(?:[T ]\s*{CLOCK}{ZONE})?$", "$1|$2|$3|$4|$5|$6||$7"),
    "basic": (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2}(?:[.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5|$6||$7"),
    "date": (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1|$2|$3|0|0|0||"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3|0|0|0||"),
    "mail": (rf"^(?:[A-Za-z]{{3,9}},\s*)?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?[ -](\d{{4}})(?:,?\s+{CLOCK}\s*([AaPp])?(?:[.]?[Mm][.]?)?{ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    "words": (rf"^(?:[A-Za-z]{{3,9}},?\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{CLOCK}\s*([AaPp])?(?:[.]?[Mm][.]?)?{ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    "numbers": (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})(?:,?\s+{CLOCK}\s*([AaPp])?(?:[.]?[Mm][.]?)?{ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8"),
}
#: What an interpretation says of the source's date order: month first, day first, or nothing.
MONTH_FIRST, DAY_FIRST, FREE = 0, 1, -1
#: Bare numbers: digits and how many microseconds they count. Fewer digits name no instant.
EPOCHS = {"8,11": 1_000_000.0, "12,14": 1000.0, "15,17": 1.0, "18,19": 0.001}
CANDIDATE = "struct<fmt:int,cost:double,us:bigint>"


def _instant(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, zone: Column) -> Column:
    """Microseconds since 1970 UTC; null where the parts make no time. A repeated wall clock means the first, a
    skipped one moves on by what was skipped (the JVM's rule for local times)."""
    return F.unix_micros(F.try_make_timestamp(y, mo, d, h, mi, s, zone))


def candidates(df: DataFrame, value: str, zone: str, order: str, between: tuple[int, int] | None = None) -> DataFrame:
    """df with `candidates`: array<CANDIDATE> of all valid interpretations of a text, cheapest first; empty for
    null, blank and senseless texts. zone: the column with the IANA zone of wall clocks without one (null: UTC).
    order: the column with `mdy` or `dmy`, the declared order of all-number dates (null: not known). between: the
    earliest and latest microsecond a timestamp may name, if instants outside are senseless."""
    out = df.withColumn("_v", F.regexp_replace(F.regexp_replace(F.col(value), r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", ""), r"[\s\u00a0\u202f]+", " "))
    fmt = None
    for name, (pattern, _) in PATTERNS.items():
        fmt = F.when(F.col("_v").rlike(pattern), name) if fmt is None else fmt.when(F.col("_v").rlike(pattern), name)
    out = out.withColumn("_f", fmt)
    parts = None
    for name, (pattern, to) in PATTERNS.items():
        made = F.regexp_replace("_v", pattern, to)
        parts = F.when(F.col("_f") == name, made) if parts is None else parts.when(F.col("_f") == name, made)
    out = out.withColumn("_p", F.split(parts, r"\|"))
    part = lambda i: F.get("_p", F.lit(i))
    number = lambda c: F.when(c == "", F.lit("0")).otherwise(c).try_cast("int")
    month = F.coalesce(
        F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(1), 1, 3))), F.lit(0)).cast("int"),
        number(part(1)),
    )
    hour, half = number(part(3)), F.lower(part(6))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    offset = F.regexp_extract(F.upper(part(7)), r"^(?:UTC|GMT)?([+-]\d{2}):?(\d{2})?Z?$", 1)
    minutes = F.regexp_extract(F.upper(part(7)), r"^(?:UTC|GMT)?([+-]\d{2}):?(\d{2})?Z?$", 2)
    named = F.create_map(*[x for k, (m, *_) in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(f"{'-' if m < 0 else '+'}{abs(m) // 60:02d}:{abs(m) % 60:02d}"))])
    others = F.create_map(*[x for k, ms in ABBREVIATIONS.items() if len(ms) > 1 for x in (F.lit(k), F.array(*[F.lit((ms[0] - m) * 60_000_000) for m in ms[1:]]))])
    own = (
        F.when(offset != "", F.concat(offset, F.lit(":"), F.when(minutes == "", "00").otherwise(minutes)))
        .when(part(7).startswith("["), F.regexp_replace(part(7), r"[\[\]]", ""))
        .otherwise(F.try_element_at(named, F.upper(part(7))))
    )
    out = out.select(
        "*",
        number(part(0)).alias("_y"),
        month.alias("_mo"),
        number(part(2)).alias("_d"),
        hour.alias("_h"),
        number(part(4)).alias("_mi"),
        F.when(part(5) == "", F.lit("0")).otherwise(F.regexp_replace(part(5), ",", ".")).try_cast("decimal(16,6)").alias("_s"),
        F.when(part(7) == "", F.coalesce(F.col(zone), F.lit("UTC"))).otherwise(own).alias("_z"),
        (part(7) == "").alias("_wall"),
        F.try_element_at(others, F.upper(part(7))).alias("_moved"),
    )
    clock = ("_h", "_mi", "_s", "_z")
    out = out.select(
        "*",
        _instant(F.col("_y"), F.col("_mo"), F.col("_d"), *map(F.col, clock)).alias("_us1"),
        F.when(F.col("_f") == "numbers", _instant(F.col("_y"), F.col("_d"), F.col("_mo"), *map(F.col, clock))).alias("_us2"),
    )

    local = lambda us, z: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), z))
    declared_zone = F.col(zone)

    def readings(us: str, fmt: int, against: Column) -> Column:
        """The reading itself, the later instant with the same wall clock where the clock is set back, and the other
        meanings of a zone name; where a zone is declared, a meaning that is its offset then outweighs the others."""
        first = F.col(us)
        later = first + F.lit(3_600_000_000)
        again = F.when(F.col("_wall") & (local(first, F.col("_z")) == local(later, F.col("_z"))), later)
        meant = F.when(F.col("_moved").isNotNull() & first.isNotNull(), F.concat(F.array(first), F.transform("_moved", lambda m: first + m)))
        wall = local(first, F.col("_z"))
        fits = F.transform(meant, lambda u: F.coalesce(local(u, declared_zone) == wall, F.lit(False)))
        known = F.coalesce(F.exists(fits, lambda x: x), F.lit(False))
        one = lambda u, cost: F.struct(F.lit(fmt).alias("fmt"), cost.cast("double").alias("cost"), u.cast("bigint").alias("us"))
        named = F.transform(meant, lambda u, i: one(u, against + F.when(known, F.when(F.get(fits, i), 0.0).otherwise(CONTRADICTS)).otherwise(i * UNUSUAL)))
        return F.coalesce(named, F.array(one(first, against), one(again, against + SECOND_READING)))

    declared = F.lower(F.col(order))
    against = lambda o: F.when(declared != o, CONTRADICTS).otherwise(0.0)
    epochs = [F.when(F.col("_v").rlike(rf"^\d{{{n}}}(\.\d+)?$"), F.round(F.col("_v").try_cast("decimal(26,6)") * F.lit(k).cast("decimal(10,3)")).try_cast("bigint")) for n, k in EPOCHS.items()]
    epoch = F.struct(F.lit(FREE).alias("fmt"), F.when(F.col("_us1").isNotNull(), UNUSUAL).otherwise(0.0).alias("cost"), F.coalesce(*epochs).alias("us"))
    found = (
        F.when(F.col("_f") == "numbers", F.concat(readings("_us1", MONTH_FIRST, against("mdy")), readings("_us2", DAY_FIRST, against("dmy"))))
        .when(F.col("_f").isNotNull() & (F.col("_f") != "compact"), readings("_us1", FREE, F.lit(0.0)))
        .otherwise(F.concat(readings("_us1", FREE, F.lit(0.0)), F.array(epoch)))
    )
    # Each step a select of its own, so that no expression is computed once for every use of it.
    out = out.select("*", F.filter(found, lambda x: x["us"].isNotNull() if between is None else x["us"].between(*between)).alias("_kept"))
    kept = F.col("_kept")
    # One instant by both orders says nothing of the order.
    same = (F.size(kept) == 2) & (F.get(kept, F.lit(0))["us"] == F.get(kept, F.lit(1))["us"])
    single = F.array(F.struct(F.lit(FREE).alias("fmt"), F.lit(0.0).alias("cost"), F.get(kept, F.lit(0))["us"].alias("us")))
    cheap = F.array_sort(kept, lambda a, b: F.when(a["cost"] != b["cost"], F.signum(a["cost"] - b["cost"])).when(a["us"] != b["us"], F.signum(a["us"] - b["us"])).otherwise(a["fmt"] - b["fmt"]).cast("int"))
    none = F.array().cast(f"array<{CANDIDATE}>")
    return out.select(*df.columns, F.when(F.col("_v").isNull() | (F.col("_v") == ""), none).when(same, single).otherwise(cheap).alias("candidates"))


# -- Viterbi in blocks ---------------------------------------------------------------------------------------------


def _table(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fmt, cost, us) as arrays of records by slots; cost is infinite where there is no such interpretation. What says
    nothing of the date order is there twice, once in each order, so that the order is kept over it."""
    lengths = pdf["_fmt"].map(len).to_numpy(np.int64)
    n, total = len(lengths), int(lengths.sum())
    rows = np.repeat(np.arange(n), lengths)
    slots = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat = {c: np.concatenate(pdf[c].to_list()) if total else np.zeros(0) for c in ("_fmt", "_cost", "_us")}
    fmt, cost, us = np.zeros((n, SLOTS), np.int64), np.full((n, SLOTS), np.inf), np.zeros((n, SLOTS), np.int64)
    fmt[rows, slots], cost[rows, slots], us[rows, slots] = flat["_fmt"], flat["_cost"], flat["_us"]
    free = fmt[:, 0] == FREE
    fmt[free, :READINGS], fmt[free, READINGS:] = MONTH_FIRST, DAY_FIRST
    cost[free, READINGS:], us[free, READINGS:] = cost[free, :READINGS], us[free, :READINGS]
    return fmt, cost, us


def step(fmt: np.ndarray, us: np.ndarray, fmt2: np.ndarray, us2: np.ndarray) -> np.ndarray:
    """Costs of going from each interpretation of one record to each of the next."""
    return SWITCH * (fmt[:, None] != fmt2[None, :]) + BACKWARD * (us[:, None] > us2[None, :])


def matrix(fmt: np.ndarray, cost: np.ndarray, us: np.ndarray) -> np.ndarray:
    """Least cost from each interpretation of the first record to each of the last (costs of both included)."""
    m = np.where(np.eye(SLOTS, dtype=bool), cost[0][:, None], np.inf)
    for i in range(1, len(cost)):
        m = (m[:, :, None] + step(fmt[i - 1], us[i - 1], fmt[i], us[i])[None]).min(1) + cost[i][None]
    return m


def trace(fmt: np.ndarray, cost: np.ndarray, us: np.ndarray, first: int, last: int) -> np.ndarray:
    """The interpretation of each record on the cheapest path between given ends; the cheaper slot wins ties."""
    n = len(cost)
    best = np.full(SLOTS, np.inf)
    best[first] = cost[0][first]
    back = np.zeros((n, SLOTS), "int64")
    for i in range(1, n):
        through = best[:, None] + step(fmt[i - 1], us[i - 1], fmt[i], us[i])
        back[i] = through.argmin(0)
        best = through.min(0) + cost[i]
    path = np.empty(n, "int64")
    path[-1] = last
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["_rank", "_tie"], kind="stable").reset_index(drop=True)


ENDS = "series string, block bigint, costs array<double>, fmt array<bigint>, us array<bigint>"
PATHS = "series string, block bigint, first int, last int"


def _block_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _ordered(pdf)
    fmt, cost, us = _table(pdf)
    m = matrix(fmt, cost, us)
    return pd.DataFrame({"series": [pdf["_series"][0]], "block": [pdf["_block"][0]], "costs": [m.ravel()], "fmt": [np.concatenate([fmt[0], fmt[-1]])], "us": [np.concatenate([us[0], us[-1]])]})


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ends of every block of one series: forward over blocks (each a single matrix), then back."""
    pdf = pdf.sort_values("block").reset_index(drop=True)
    ms = [np.asarray(c, float).reshape(SLOTS, SLOTS) for c in pdf["costs"]]
    heads = [(np.asarray(f)[:SLOTS], np.asarray(u)[:SLOTS]) for f, u in zip(pdf["fmt"], pdf["us"], strict=True)]
    tails = [(np.asarray(f)[SLOTS:], np.asarray(u)[SLOTS:]) for f, u in zip(pdf["fmt"], pdf["us"], strict=True)]
    enter = np.zeros(SLOTS)
    entries, exits, froms = [], [], []
    for i, m in enumerate(ms):
        if i:
            through = enter[:, None] + step(*tails[i - 1], *heads[i])
            froms.append(through.argmin(0))
            enter = through.min(0)
        total = enter[:, None] + m
        entries.append(total.argmin(0))
        enter = total.min(0)
    last = int(enter.argmin())
    for i in range(len(ms) - 1, -1, -1):
        first = int(entries[i][last])
        exits.append((first, last))
        last = int(froms[i - 1][first]) if i else last
    exits.reverse()
    return pd.DataFrame({"series": pdf["series"], "block": pdf["block"], "first": [e[0] for e in exits], "last": [e[1] for e in exits]})


def resolve(df: DataFrame, series: str, rank: str, tie: str, keep: list[str], block: int = BLOCK) -> DataFrame:
    """The chosen interpretation of each row of a DataFrame with `candidates`: keep and utc_us.

    series: the column naming a source's sequence; rank: its non-negative integer order within (blocks are ranges of
    `block` ranks, so a block is bounded where ranks are unique); tie: a column that orders equal ranks. Rows without
    candidates give no row; an empty table gives an empty one.

    A record with a single interpretation that says nothing of the date order cuts the sequence but for that order: it
    needs no search itself. So only records with several interpretations, each with its two neighbours, and those that
    show an order go through the blocks; all others take their one interpretation at once, in the JVM."""
    rows = df.where(F.size("candidates") > 0).withColumn("_n", F.size("candidates"))
    rows = rows.withColumn("_rank", F.col(rank).cast("bigint")).withColumn("_tie", F.col(tie).cast("string")).withColumn("_series", F.col(series).cast("string"))
    rows = rows.withColumn("_block", F.floor(F.col("_rank") / block).cast("bigint"))
    single = rows.where("_n = 1").select(*keep, F.get("candidates", F.lit(0))["us"].alias("utc_us"))
    keys = ["_series", "_block"]
    arrays = [F.col(f"candidates.{f}").alias(f"_{f}") for f in ("fmt", "cost", "us")]
    slim = rows.select(*keys, "_rank", "_tie", "_n", *arrays, *[F.col(c).alias(f"k_{c}") for c in keep])
    w = Window.partitionBy(*keys).orderBy("_rank", "_tie")
    near = F.greatest("_n", F.coalesce(F.lag("_n").over(w), F.lit(1)), F.coalesce(F.lead("_n").over(w), F.lit(1)))
    # The block's ends stay too, so that blocks can be chained over their true borders.
    edge = F.lag("_n").over(w).isNull() | F.lead("_n").over(w).isNull()
    chained = slim.withColumn("_near", (near > 1) | edge | (F.get("_fmt", F.lit(0)) != FREE)).where("_near").drop("_near")
    ends = chained.select("_series", "_block", "_rank", "_tie", "_fmt", "_cost", "_us").groupBy(*keys).applyInPandas(_block_ends, ENDS)
    paths = ends.groupBy("series").applyInPandas(_chain, PATHS)
    out = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], T.StructField("utc_us", T.LongType())])

    def chosen(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: [] for f in out})
        left = _ordered(left)
        fmt, cost, us = _table(left)
        path = trace(fmt, cost, us, int(right["first"][0]), int(right["last"][0]))
        got = left[[f"k_{c}" for c in keep]].set_axis(keep, axis=1)
        got["utc_us"] = us[np.arange(len(path)), path]
        return got[left["_n"] > 1]

    several = chained.groupBy(*keys).cogroup(paths.groupBy("series", "block")).applyInPandas(chosen, out)
    return single.unionByName(several)


def normalise(df: DataFrame, value: str, zone: str, order: str, series: str, rank: str, tie: str, keep: list[str]) -> DataFrame:
    """keep and utc_us for every text that names an instant; see candidates() and resolve().

    The candidates are written to the shared folder once: three branches read them, and no filter of a branch is
    pushed into the parsing expressions."""
    found = candidates(df.select(*dict.fromkeys([*keep, value, zone, order, series, rank, tie])), value, zone, order)
    return resolve(saved(found.drop(zone, order), "p6-candidates"), series, rank, tie, keep)

