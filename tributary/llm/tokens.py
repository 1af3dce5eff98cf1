"""Encoding of a whole corpus with a public tokenizer, by reuse of content-defined chunks.

Texts are cut where a rolling hash over the last characters says so, so that equal passages of different documents
give equal chunks wherever they stand. Every distinct chunk is encoded once; a document's ids are those of its chunks
in order. Cuts fall between a word and the blank before the next, where no token can reach across. A run without such
a place is cut by force, and the join of its pieces is repaired: tokens around it are decoded and encoded again, in a
window that grows until its tokens agree with both sides.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the splitting pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters the rolling hash sees, share of the places at which it cuts (one in 2 ** CUT_BITS words), longest chunk.
WINDOW, CUT_BITS, LONGEST = 8, 6, 8192
#: Times that a task meets a chunk before its places are spread, over how many groups, and chunks a task keeps in mind.
HOT_CHUNK, SALTS, TASK_KEYS = 64, 256, 500_000
PIECES = pa.schema([("tkey", pa.int64()), ("seq", pa.int32()), ("safe", pa.bool_()), ("forced", pa.bool_()), ("key", pa.binary()), ("salt", pa.int32()), ("text", pa.string())])


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY, folder: str = TOKENIZERS):
    """The tokenizer, loaded once a worker from its public vocabulary file."""
    import tiktoken

    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**64, 4096, dtype=np.uint64)


@lru_cache(maxsize=1)
def _white() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(0x3002)), bool, 0x3002)


def chunk_batch(texts: list[str], bits: int = CUT_BITS, longest: int = LONGEST) -> list[list[tuple[str, bool]]]:
    """chunks() of many texts in one pass over their characters."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 2)  # two blanks after each text, so that no place is found across two texts
    points = np.frombuffer("  ".join([*texts, ""]).encode("utf-32-le"), dtype="<u4")
    white = _white()[np.minimum(points, 0x3001)]
    # A single blank between two characters that are no white space: a token begins with it and none crosses it.
    places = np.flatnonzero((points[1:-1] == 32) & ~white[:-2] & ~white[2:]) + 1 if len(points) > 2 else np.zeros(0, np.int64)
    owner = np.searchsorted(ends, places, "right")
    first = (ends - lengths - 2)[owner] if len(places) else places
    h, gear = np.zeros(len(places), np.uint64), _gear()
    for k in range(1, WINDOW + 1):
        at = places - k
        h += np.where(at >= first, gear[points[np.maximum(at, 0)] & 4095] << np.uint64(k), np.uint64(0))
    cut = (h >> np.uint64(64 - bits)) == 0
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        mine = slice(bounds[i], bounds[i + 1])
        out.append(_cut(text, places[mine] - (ends[i] - lengths[i] - 2), cut[mine], longest))
    return out


def _cut(text: str, places: np.ndarray, cut: np.ndarray, longest: int) -> list[tuple[str, bool]]:
    out, start, safe = [], 0, True
    for end in [*places[cut].tolist(), len(text)]:
        while end - start > longest:
            i = int(np.searchsorted(places, start + longest, "right")) - 1
            at, ok = (int(places[i]), True) if i >= 0 and places[i] > start else (start + longest, False)
            out.append((text[start:at], safe))
            start, safe = at, ok
        if end > start:
            out.append((text[start:end], safe))
            start, safe = end, True
    return out


def chunks(text: str, bits: int = CUT_BITS, longest: int = LONGEST) -> list[tuple[str, bool]]:
    """[(chunk, safe)], safe saying that no token reaches across the chunk's start. Joined, they are the text."""
    return chunk_batch([text], bits, longest)[0]


def joined(parts: list[tuple[list[int], bool]], enc) -> list[int]:
    """Ids of a text from those of its chunks: [(ids, safe)] in order. At an unsafe join the last tokens of the left
    side and a growing head of the right side are encoded anew, until the new tokens begin with the left ones before
    the join's word and end on a border of the right side's own words with the same tokens."""
    out: list[int] = []
    for ids, safe in parts:
        if safe or not out or not ids:
            out.extend(ids)
            continue
        back, ahead = 8, 8
        while True:
            left, right = out[max(0, len(out) - back) :], ids[:ahead]
            raw = b"".join(enc.decode_tokens_bytes(left + right))
            window = _encode_bytes(raw, enc)
            lead, tail = _agreement(left, right, window, enc)
            if lead is not None or back >= len(out):
                keep = lead or 0
                if tail is not None or ahead >= len(ids):
                    drop = len(right) - (tail or 0)
                    end = len(window) - (tail or 0)
                    out = out[: len(out) - len(left) + keep] + window[keep:end] + ids[drop:]
                    break
                ahead *= 2
            else:
                back *= 2
    return out


def _encode_bytes(raw: bytes, enc) -> list[int] | None:
    """None where the bytes begin or end inside a character."""
    try:
        return enc.encode_ordinary(raw.decode("utf-8"))
    except UnicodeDecodeError:
        return None


def _agreement(left: list[int], right: list[int], window: list[int] | None, enc) -> tuple[int | None, int | None]:
    """How many leading tokens of the window are the left side's, and how many trailing ones are the right side's,
    such that a letter after a blank follows or precedes (a place no word crosses); None without such a place."""
    if window is None:
        return None, None
    starts = lambda t: (b := enc.decode_single_token_bytes(t))[:1] == b" " and b[1:2].isalnum() and b[1:2].isascii()
    ends_in_ink = lambda t: (b := enc.decode_single_token_bytes(t))[-1:].isalnum() and b[-1:].isascii()
    lead = tail = None
    n = 0
    while n < len(left) and n < len(window) and left[n] == window[n]:
        n += 1
        if n < len(left) and n < len(window) and window[n] == left[n] and starts(window[n]) and ends_in_ink(window[n - 1]):
            lead = n
    n = 0
    while n < len(right) and n < len(window) and right[-1 - n] == window[-1 - n]:
        n += 1
        if n < len(right) and n < len(window) and starts(window[-n]) and ends_in_ink(window[-n - 1]) and window[-n - 1] == right[-n - 1]:
            tail = n
    return lead, tail


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _pieces(batches: Iterator[pa.RecordBatch], bits: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Every chunk of every text in its place, with the chunk's text where this task meets it for the first time.

    A chunk that a task has met HOT_CHUNK times is salted by the task, so that its places are spread over SALTS groups;
    each of them encodes it once more, for HOT_CHUNK places or more."""
    task = TaskContext.get().partitionId()
    met: dict[bytes, int] = {}
    for b in batches:
        rows = ["" if t is None else t for t in b.column("text").to_pylist()]
        at: list[int] = []
        cols: dict[str, list] = {"tkey": [], "seq": [], "safe": [], "forced": [], "key": [], "salt": [], "text": []}
        for i, own in enumerate(chunk_batch(rows, bits, longest)):
            own = own or [("", True)]
            tkey, forced = _text_key(rows[i]), not all(safe for _, safe in own)
            for s, (c, safe) in enumerate(own):
                key = _key(c)
                n = met[key] = met.get(key, 0) + 1
                at.append(i)
                cols["tkey"].append(tkey)
                cols["seq"].append(s)
                cols["safe"].append(safe)
                cols["forced"].append(forced)
                cols["key"].append(key)
                cols["salt"].append(0 if n <= HOT_CHUNK else 1 + task % SALTS)
                cols["text"].append(c if n in (1, HOT_CHUNK + 1) else None)
        if len(met) > TASK_KEYS:
            met = {}
        yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(at, pa.int64())), *[pa.array(v, PIECES.field(c).type) for c, v in cols.items()]], names=["doc", *cols])


def _encoded(batches: Iterator[pa.RecordBatch], enc, counts: bool) -> Iterator[pa.RecordBatch]:
    """Ids of every place, from rows sorted by key and salt with a row that has the text first. With counts, ids come
    only for texts that need a repair."""
    last: tuple[bytes, int] | None = None
    last_ids: list[int] = []
    for b in batches:
        made, which = [last_ids], []
        for key, salt, text in zip(b.column("key").to_pylist(), b.column("salt").to_pylist(), b.column("text").to_pylist(), strict=True):
            if (key, salt) != last:
                last = (key, salt)
                made.append(enc.encode_ordinary(text) if text else [])
            which.append(len(made) - 1)
        last_ids = made[-1]
        lengths = np.fromiter(map(len, made), np.int32, len(made))
        if counts and not pc.any(b.column("forced")).as_py():
            ids = pa.nulls(len(which), pa.list_(pa.int32()))
        else:
            borders = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            ids = pa.ListArray.from_arrays(borders, pa.array(np.fromiter(chain.from_iterable(made), np.int32, int(lengths.sum())), pa.int32())).take(pa.array(which, pa.int64()))
        if counts:
            ids = pc.if_else(b.column("forced"), ids, pa.scalar(None, ids.type))
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc", "tkey", "seq", "safe")], pa.array(lengths[which], pa.int32()), ids], names=["doc", "tkey", "seq", "safe", "n", "ids"])


def _whole(batches: Iterator[pa.RecordBatch], enc, counts: bool) -> Iterator[pa.RecordBatch]:
    """Ids (or their number) of each document from its parts in order; lists are joined by their offsets."""
    for b in batches:
        parts = b.column("parts")
        borders, rows = parts.offsets.to_numpy(), parts.values
        safe = rows.field("safe").to_numpy(zero_copy_only=False)
        forced = np.flatnonzero(np.logical_or.reduceat(~safe, borders[:-1])) if len(safe) else np.zeros(0, np.int64)
        repaired = {int(i): joined([(p["ids"], p["safe"]) for p in parts[int(i)].as_py()], enc) for i in forced}
        if counts:
            total = np.add.reduceat(rows.field("n").to_numpy().astype(np.int64), borders[:-1]) if len(safe) else np.zeros(0, np.int64)
            for i, own in repaired.items():
                total[i] = len(own)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(total, pa.int64())], names=["doc", "n_tokens"])
            continue
        ids = rows.field("ids")
        out = pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[borders], pa.int32()), ids.values)
        if repaired:
            lists = pa.array(list(repaired.values()), out.type)
            at = np.arange(len(out))
            at[forced] = len(out) + np.arange(len(forced))
            out = pa.concat_arrays([out, lists]).take(pa.array(at))
        yield pa.RecordBatch.from_arrays([b.column("doc"), out], names=["doc", "ids"])


def encode_corpus(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    folder: str = TOKENIZERS,
    bits: int = CUT_BITS,
    longest: int = LONGEST,
    counts: bool = False,
) -> DataFrame:
    """(doc, ids): the token ids of every document without special tokens (what looks like one is plain text); with
    counts (doc, n_tokens), for which ids are moved only where a repair needs them.

    An empty and a null text both give an empty list, a blank one its blanks' tokens. A row repeated whole gives one
    row; one id with two texts gives a row each; a null id is an id like others. Other columns are not read; an empty
    table gives an empty one. Texts of any length are encoded whole. The corpus is cut once; places meet their chunk's
    text by one shuffle and their document by another. The places of a chunk that a third of all documents share are
    spread over SALTS groups."""
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    placed = rows.mapInArrow(lambda bs: _pieces(bs, bits, longest), f"doc {kind}, tkey bigint, seq int, safe boolean, forced boolean, key binary, salt int, text string")
    met = placed.repartition("key", "salt").sortWithinPartitions("key", "salt", F.col("text").isNull())
    encoded = met.mapInArrow(lambda bs: _encoded(bs, encoder(vocabulary, folder), counts), f"doc {kind}, tkey bigint, seq int, safe boolean, n int, ids array<int>")
    parts = F.sort_array(F.collect_set(F.struct("seq", "safe", "n", "ids") if counts else F.struct("seq", "safe", "ids"))).alias("parts")
    whole = encoded.groupBy("doc", "tkey").agg(parts).select("doc", "parts")
    out = "n_tokens bigint" if counts else "ids array<int>"
    whole = whole.mapInArrow(lambda bs: _whole(bs, encoder(vocabulary, folder), counts), f"doc {kind}, {out}")
    return whole.withColumnRenamed("doc", doc)


def chunk_reuse(docs: DataFrame, text: str = "text", bits: int = CUT_BITS, longest: int = LONGEST) -> DataFrame:
    """One row: chunks and their bytes in all, and in distinct ones, which are what the tokenizer has to read."""
    placed = docs.select(F.lit(0).alias("doc"), F.col(text).alias("text")).mapInArrow(_sizes(bits, longest), "key binary, size bigint, n bigint")
    distinct = placed.groupBy("key").agg(F.max("size").alias("size"), F.sum("n").alias("n"))
    return distinct.agg(F.sum("n").alias("chunks"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum("size").alias("distinct_bytes"))


def _sizes(bits: int, longest: int):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Counter(c for own in chunk_batch([t or "" for t in b.column("text").to_pylist()], bits, longest) for c, _ in own)
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, n), pa.binary()), pa.array([len(c.encode()) for c in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["key", "size", "n"])

    return sizes
