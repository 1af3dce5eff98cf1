import os
import random

import pytest

from tributary.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="no tokenizers")
TEXTS = ["", " ", "\n\n  \t", "Hello world", "I'll they've <|endoftext|> x", "a" * 20_000, "訂單已發貨 谢谢您 " * 900, "👩‍🍳👨🏽‍🔧 team " * 200, "x y " * 6000, "naïve  résumé\r\n\r\n\tend ", "1234567 890 " * 50, "'s 'll ''", "﻿zero​width", "É" * 9000]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_chunks_are_the_text():
    for t, cut in zip(TEXTS, tokens.chunk_batch(TEXTS), strict=True):
        assert "".join(c for c, _ in cut) == t
        assert max((len(c) for c, _ in cut), default=0) <= tokens.LONGEST
        assert cut == tokens.chunks(t)


def test_equal_passages_give_equal_chunks():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    passage = " ".join(words[:2500])
    a, b = [{c for c, _ in tokens.chunks(f"{head} {passage}")} for head in (" ".join(words[2500:3000]), " ".join(words[3000:]))]
    assert len(a & b) >= 0.7 * min(len(a), len(b))


@pytest.mark.parametrize("longest", [1, 3, 7, 20])
def test_forced_joins_are_repaired(longest):
    enc, want = tokens.encoder(), reference()
    for t in TEXTS:
        t = t[:700]
        parts = [(enc.encode_ordinary(t[i : i + longest]), False) for i in range(0, len(t), longest)]
        assert tokens.joined(parts, enc) == want(t), repr(t[:40])


def test_corpus(spark):
    want = reference()
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, None, "x"), (None, "null id", "x"), (3, TEXTS[3], "x")] + [(200 + i, TEXTS[8], "x") for i in range(30)]
    got = tokens.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), longest=64).collect()
    assert len(got) == len(rows) - 1
    by = {r.doc_id: r.ids for r in got}
    assert by == {i: want(t) if t else [] for i, t, _ in rows}
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_counts_and_hot_chunks(spark, monkeypatch):
    """Counts are the lengths of the ids, also where joins are forced; a chunk of all documents is spread over groups."""
    monkeypatch.setattr(tokens, "HOT_CHUNK", 2)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (3, TEXTS[3])] + [(200 + i, "a text that all of them share " * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    ids = {r.doc_id: r.ids for r in tokens.encode_corpus(df, longest=64).collect()}
    want = reference()
    assert ids == {i: want(t) if t else [] for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in tokens.encode_corpus(df, longest=64, counts=True).collect()} == {i: len(x) for i, x in ids.items()}


def test_hot_chunk_gets_salts():
    import pyarrow as pa

    class Task:
        @staticmethod
        def get():
            return type("T", (), {"partitionId": staticmethod(lambda: 7)})

    original, tokens.TaskContext = tokens.TaskContext, Task
    try:
        b = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(["same"] * 200)], names=["doc", "text"])
        out = next(tokens._pieces(iter([b]), 6, 8192)).to_pylist()
    finally:
        tokens.TaskContext = original
    assert {r["salt"] for r in out} == {0, 8} and sum(r["salt"] == 0 for r in out) == tokens.HOT_CHUNK
    assert [i for i, r in enumerate(out) if r["text"]] == [0, tokens.HOT_CHUNK]


def test_reuse(spark):
    df = spark.createDataFrame([(1, "word " * 500), (2, "word " * 500), (3, None)], "doc_id bigint, text string")
    r = tokens.chunk_reuse(df).first()
    assert r.bytes == 5000 and r.distinct_bytes <= 2500
