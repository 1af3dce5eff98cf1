import datetime
import os

import pytest

from tests.test_queries import SF
from tributary.operators.messages import COPIES, MessageStore

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "id string, v int, arrived timestamp, _best string"


def store(spark, tmp_path):
    return MessageStore(spark, f"file://{tmp_path}/s", ["id", "v"], ["arrived"], "date_format(arrived, 'yyyy-MM')")


def day(n):
    return T0 + datetime.timedelta(days=n)


def content(s):
    return sorted((r.id or "", r.v, r._best, r[COPIES]) for r in s.read().collect())


def test_one_copy_over_batches(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.read() is None
    assert s.ingest(spark.createDataFrame([], SCHEMA)) == []
    assert s.ingest(spark.createDataFrame([("a", 1, day(0), "x"), ("a", 1, day(1), "y"), ("b", 1, day(40), "x"), (None, 1, day(0), "n")], SCHEMA)) == []
    assert content(s) == [("", 1, "n", 1), ("a", 1, "y", 2), ("b", 1, "x", 1)]
    assert len({p for p in s.data.snapshot().folders}) == len({(r._place) for r in s.read().collect()})
    before = {p: f for p, f in s.data.snapshot().folders.items() if p.startswith("2024-02")}
    place_of_a = s.read().where("id = 'a'").first()._place
    assert place_of_a.startswith("2024-01/")
    # a copy of a January message, a new message of February, one of March: only the partition of the first is rewritten
    assert s.ingest(spark.createDataFrame([("a", 1, day(80), "z"), ("c", 2, day(41), "c"), ("d", 1, day(70), "d")], SCHEMA)) == [place_of_a]
    assert content(s) == [("", 1, "n", 1), ("a", 1, "z", 3), ("b", 1, "x", 1), ("c", 2, "c", 1), ("d", 1, "d", 1)]
    assert all(s.data.snapshot().folders[p][: len(f)] == f for p, f in before.items())
    assert s.data.snapshot().rewritten == 1
    assert {r.id for r in s.read(["2024-01"]).collect()} == {"a", None}


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    from tributary.sources.lake import CommitConflict

    s, other = store(spark, tmp_path), store(spark, tmp_path)
    s.ingest(spark.createDataFrame([("a", 1, day(0), "x")], SCHEMA))
    append = s.index.append

    def late(df):
        other.ingest(spark.createDataFrame([("a", 1, day(2), "y")], SCHEMA))
        return append(df)

    monkeypatch.setattr(s.index, "append", late)
    with pytest.raises(CommitConflict):
        s.ingest(spark.createDataFrame([("a", 1, day(3), "z")], SCHEMA))
    assert content(other) == [("a", 1, "y", 2)]


def test_ties_and_null_times(spark, tmp_path):
    s = store(spark, tmp_path)
    s.ingest(spark.createDataFrame([("a", None, None, "x"), ("a", None, None, "y"), ("a", None, day(0), "w")], SCHEMA))
    assert [(r._best, r[COPIES]) for r in s.read().collect()] == [("w", 3)]
    s.ingest(spark.createDataFrame([("a", None, day(0), "v"), ("a", None, day(0), "w")], SCHEMA))
    assert [(r._best, r[COPIES]) for r in s.read().collect()] == [("w", 5)]


def test_hot_message(spark, tmp_path):
    s = store(spark, tmp_path)
    s.ingest(spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as id", "1 as v", "timestamp '2024-01-01' as arrived", "'x' as _best"))
    assert s.read().count() == 2001
    assert s.read().where("id = 'hot'").first()[COPIES] == 1000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name,key,arrived", [
    ("shopify_customers", lambda r: (r.id, r._webhook_topic, r.updated_at), "_loaded_at"),
    ("mailchimp_subscribers", lambda r: (r.subscriber_id and r.subscriber_id.lower(), r._webhook_event_type, r.last_changed), "_loaded_at"),
    ("incremental_watermarks", lambda r: (r.last_event_id, r.pipeline_name, r.last_sync_timestamp), "updated_at"),
])
def test_messages_come_out_whole(spark, name, key, arrived):
    from tributary.plans.registry import QUERIES

    raw = spark.read.parquet(f"{SF}/{name}.parquet")
    rest = [arrived, *[c for c in raw.columns if c != arrived]]
    copies = {}
    for r in raw.collect():
        if key(r)[0] is not None:
            copies.setdefault(key(r), []).append(r)
    want = sorted(repr([*max(rows, key=lambda r: [(r[c] is not None, r[c]) if r[c] is not None else (False,) for c in rest]), len(rows)]) for rows in copies.values())
    got = QUERIES[f"p7_{name}"](spark, SF)
    assert got.columns == [*raw.columns, "copies"]
    assert sorted(repr(list(r)) for r in got.collect()) == want and any(len(x) > 1 for x in copies.values())
