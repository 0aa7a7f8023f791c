"""Substring deduplication by relative Lempel-Ziv parsing: documents are factored into stretches of earlier documents.

Method: reference blocks are indexes of word windows. A slice of documents (in order of id) is the first block: what it repeats of itself points
there. Windows that are new to their slice go to the block of their anchor (the smallest hash of the five-word runs within the window, so neighbouring windows mostly go to
one block); a block is sorted by window and points every window to its first document and place. A document's factors are greedy: from a pointed window on
as far as the next words go on in the same place of the same document. Where a factor ends, windows that reach across its
boundary are checked by their own pointers. Factors of ``least`` words or more are duplicate spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from kmerloom.llm.common import arrow_map

#: Words of an anchor's run, and bytes of text a block answers for (about a million windows).
ANCHOR, BLOCK_BYTES = 5, 1 << 23
_rng = np.random.default_rng(42)
_times = _rng.integers(0, 2**64, 4096, np.uint64) | np.uint64(1)
#: A document's windows of one block, packed; or factors found within a slice (``known``: six numbers each).
ROWS = "block int, docs binary, keys binary, sizes binary, hashes binary, places binary, known binary"
RUNS = "doc_id long, key long, begin long, windows long, ref_id long, ref_begin long"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _runs_of(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of every run of n words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        out += words[j : j + len(out)] * _times[(j + salt) % 4096]
    return _mixed(out)


def _least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every n neighbours."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out, have = np.minimum(out[: len(out) - step], out[step:]), have + step
    return out


def windows(lists: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, place, hash, anchor) of every window of ``least`` words within one list, in order."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((xxh3_64_intdigest(w) for words in lists for w in words), np.uint64, int(sizes.sum()))
    n = max(0, len(flat) - least + 1)
    own = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = place[:n] + least <= sizes[own[:n]]
    anchor = min(ANCHOR, least)
    if not n:
        return own[:0], place[:0], flat[:0], flat[:0]
    return own[:n][whole], place[:n][whole], _runs_of(flat, least)[whole], _least_of(_runs_of(flat, anchor, 2048), least - anchor + 1)[whole]


def _pack(places: np.ndarray) -> bytes:
    """Places as runs of neighbours, begin (as a step from the one before) and length, in planes of bytes, most of which are zeros."""
    begin = np.flatnonzero(np.diff(places, prepend=-9) != 1)
    numbers = np.concatenate([np.diff(places[begin], prepend=0), np.diff(np.append(begin, len(places)))])
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    steps, sizes = np.ascontiguousarray(planes.T).view("<i4")[:, 0].reshape(2, -1).astype(np.int64)
    return np.repeat(np.cumsum(steps) - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _runs(doc: np.ndarray, key: np.ndarray, place: np.ndarray, ref: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pointers in order of document and place, joined where both sides go on by one: (doc, key, begin, windows, ref, ref_begin) columns."""
    if not len(doc):
        return np.zeros((0, 6), np.int64)
    goes_on = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (place[1:] == place[:-1] + 1) & (ref[1:] == ref[:-1]) & (at[1:] == at[:-1] + 1)
    begin = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return np.stack([doc[begin], key[begin], place[begin], np.diff(np.append(begin, len(doc))), ref[begin], at[begin]], 1)


def _sliced(least: int, blocks: int):
    """Work on a slice of documents in order of id: packed windows that are new to the slice, by block, and runs of the others."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        ids, keys = np.array(batch["doc_id"], np.int64), np.array(batch["key"], np.int64)
        own, place, hashed, anchor = windows([words_of(t) for t in batch["text"]], least)
        out: dict[str, list] = {f.split()[0]: [] for f in ROWS.split(", ")}
        order = np.argsort(hashed, kind="stable")  # within a window: by id, then by place
        ranked = hashed[order]
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1]]))
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
        again = ids[own[first]] < ids[own]
        some = np.flatnonzero(again)
        known = _runs(ids[own[some]], keys[own[some]], place[some], ids[own[first[some]]], place[first[some]])
        new = np.flatnonzero(~again)
        block = (_mixed(anchor[new]) % np.uint64(blocks)).astype(np.int64)
        new = new[by := np.argsort(block, kind="stable")]
        block = block[by]
        ends = np.flatnonzero(np.diff(block, append=-1)) + 1
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
            part = new[a:b]
            docs, sizes = np.unique(own[part], return_counts=True)
            packed = (int(block[a]), ids[docs].tobytes(), keys[docs].tobytes(), sizes.astype("<u4").tobytes(), hashed[part].tobytes(), _pack(place[part]), None)
            for c, value in zip(out, packed):
                out[c].append(value)
        if len(known):  # handed on by a block's task
            for c, value in zip(out, (int(known[0, 0] % blocks), None, None, None, None, None, known.tobytes())):
                out[c].append(value)
        return out

    return rows


def _pointed(rows: list[tuple]) -> np.ndarray:
    """The runs of one block: every window of it that a document of a smaller id holds points to the first such document and place."""
    docs, keys, sizes, hashed = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in ((0, "<i8"), (1, "<i8"), (2, "<u4"), (3, "<u8")))
    place = np.concatenate([_unpack(r[4]) for r in rows])
    doc, key = np.repeat(docs, sizes), np.repeat(keys, sizes)
    order = np.lexsort((place, doc, hashed))
    ranked = hashed[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    first = np.repeat(order[head], np.diff(np.append(head, len(order))))
    held = doc[first] < doc[order]
    at, ref = order[held], first[held]
    by = np.lexsort((place[at], key[at], doc[at]))
    at, ref = at[by], ref[by]
    return _runs(doc[at], key[at], place[at], doc[ref], place[ref])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks a stream sorted by block; one block is held at a time."""
    names = [f.split()[0] for f in RUNS.split(", ")]

    def out(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(found.T)], names=names)

    now, held = None, []
    for batch in batches:
        for block, known, *row in zip(*(batch[c].to_pylist() for c in ("block", "known", "docs", "keys", "sizes", "hashes", "places"))):
            if known is not None:
                yield out(np.frombuffer(known, np.int64).reshape(-1, 6))
                continue
            if block != now and held:
                yield out(_pointed(held))
                held = []
            now = block
            held.append(tuple(row))
    if held:
        yield out(_pointed(held))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))


def pointers(docs: DataFrame, least: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key, begin, windows, ref_id, ref_begin): runs of ``windows`` windows of ``least`` words from word ``begin`` on that stand in the earlier
    document ``ref_id`` from its word ``ref_begin`` on. ``key`` is the text's hash, which tells rows of one id apart.

    Only windows travel, as eight bytes and about one for the place; a window that a third of all documents hold is sent once a slice. Rows are
    sorted by id within their task, so that a task that runs again makes the same slices.
    """
    rows = _keyed(docs).filter(F.col("doc_id").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(64, -(-total // block_bytes))
    packed = arrow_map(rows.sortWithinPartitions("doc_id", "key").select("doc_id", "key", "text"), _sliced(least, blocks), ROWS)
    return packed.repartition("block").sortWithinPartitions("block").mapInArrow(_blocks, RUNS)


def factors_of(runs: list[tuple[int, int, int, int]], least: int) -> np.ndarray:
    """Greedy factors (begin, length, ref_id, ref_begin) of a document's pointer runs (begin, windows, ref_id, ref_begin), which may come cut
    and repeated: each goes on as long as its pointers do; the windows across its end begin factors of their own where they point."""
    if not runs:
        return np.zeros((0, 4), np.int64)
    each = np.unique(np.array(runs, np.int64), axis=0)
    begin, n, ref, at = each.T
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flat = np.stack([np.repeat(begin, n) + place, np.repeat(ref, n), np.repeat(at, n) + place], 1)
    flat = flat[np.unique(flat[:, 0], return_index=True)[1]]  # one pointer a window: rows of one id and text may have met different slices
    zero = np.zeros(len(flat), np.int64)
    joined = _runs(zero, zero, flat[:, 0], flat[:, 1], flat[:, 2])
    return np.stack([joined[:, 2], joined[:, 3] + least - 1, joined[:, 4], joined[:, 5]], 1)


def covered(n: int, factors: np.ndarray) -> np.ndarray:
    """Which of n words lie in a factor."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, factors[:, 0], 1)
    np.add.at(steps, factors[:, 0] + factors[:, 1], -1)
    return np.cumsum(steps[:n]) > 0


DONE = "doc_id long, n_words long, n_removed long, kept string, factors array<struct<begin:bigint,length:bigint,ref_id:bigint,ref_begin:bigint>>"


def dedup_substrings(docs: DataFrame, least: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors) of every row: the words that no factor covers, joined by a space, and the factors
    (begin, length, ref_id, ref_begin, in words).

    A word goes if a window of ``least`` consecutive words around it also stands in a document of a smaller id; windows are judged on the input.
    Null texts have no words; null ids neither remove nor lose anything; rows of one id don't remove from each other; words are
    compared as 64-bit hashes of windows, unchanged; other columns are ignored; an empty table gives an empty one.
    """
    rows = _keyed(docs)
    runs = pointers(docs, least, block_bytes)
    listed = runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("begin", "windows", "ref_id", "ref_begin")).alias("runs"))  # a document's own
    none = F.expr("cast(null as array<struct<begin:bigint,windows:bigint,ref_id:bigint,ref_begin:bigint>>)")
    ready = rows.filter(F.col("doc_id").isNotNull()).join(listed, ["doc_id", "key"], "left").select("doc_id", "text", "runs")
    ready = ready.unionByName(rows.filter(F.col("doc_id").isNull()).select("doc_id", "text", none.alias("runs")))

    def finish(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["doc_id"], "n_words": [], "n_removed": [], "kept": [], "factors": []}
        for text, found in zip(batch["text"], batch["runs"]):
            words = words_of(text)
            factors = factors_of([tuple(r.values()) for r in found or ()], least)
            gone = covered(len(words), factors)
            kept = [words[i] for i in np.flatnonzero(~gone).tolist()] if len(factors) else words
            values = len(words), len(words) - len(kept), b" ".join(kept).decode(), [dict(zip(("begin", "length", "ref_id", "ref_begin"), f)) for f in factors.tolist()]
            for c, value in zip(("n_words", "n_removed", "kept", "factors"), values):
                out[c].append(value)
        return out

    return arrow_map(ready, finish, DONE)
