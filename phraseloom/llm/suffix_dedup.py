"""Exact substring deduplication with suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a document
with a smaller doc_id, or earlier in the same one.

Equal windows of LENGTH bytes have the same smallest hash of their K-byte substrings. Runs of
windows with one smallest hash are the unit of distribution: hashes that occur once in the
corpus cannot belong to a repeated window and are dropped; equal runs are the same text, so only
the earliest stays and the later ones are removed whole; the runs left are dealt to buckets by
their hash, and each bucket's text is sorted by the difference-cover algorithm: triples at
positions 1 and 2 modulo 3 are sorted and named, the names' suffixes sorted by recursion, the
remaining suffixes sorted by their first byte and the sampled rank after it, and both merged.
Adjacent suffixes with LENGTH bytes in common make classes of equal windows; all but the
earliest of a class mark their bytes. Runs whose hash more than HOT places have (a passage that
much of the corpus shares) are not gathered in one bucket: their windows are dealt by the hash
of the whole window, and of equal ones the earliest stays.

Null texts are empty. A row is known by its doc_id and a hash of both columns: rows with a null
doc_id are documents of their own, before all others; different texts of one doc_id are different
documents, in the order of that hash, which also orders those with null. Rows that are equal in
both are one document, and get equal results. Texts shorter than LENGTH lose nothing. An empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_VALUES, U64, forget, materialize, mix, powers, runs, text_bytes

LENGTH = 100
K = 32
POSITION_BITS = 22
RUN = 1024
HOT = 10_000
FLUSH = 400_000
FLUSH_BYTES = 16 << 20
BUCKET_ENTRIES = 1_000_000
BUCKET_BYTES = 2_500_000
SORT_BYTES = 600_000
NULL_ID = -(1 << 63)


def _minima(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of LENGTH bytes: the smallest K-gram hash, and where it stands first."""
    h = BYTE_VALUES[data]
    size, factor = 1, BASE
    while size < K:
        h = h[:-size] + h[size:] * U64(factor)
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        size *= 2
    h = mix(h)
    low = U64((1 << POSITION_BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=U64)
    width, size, n = LENGTH - K + 1, 1, len(h) - (LENGTH - K)
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[:n], least[width - size : width - size + n])
    at = (least[:n] & low).astype(np.int64)
    return h[at], at


def window_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one smallest hash: hash, first window, number of windows, and whether the hash stands at several places."""
    parts = []
    step = (1 << POSITION_BITS) - 2 * LENGTH
    for base in range(0, max(len(data) - LENGTH + 1, 0), step):
        value, at = _minima(data[base : base + step + LENGTH - 1])
        heads = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1])
        moves = np.zeros(len(value), np.int64)
        np.cumsum(at[1:] != at[:-1], out=moves[1:])
        sizes = np.diff(np.concatenate([heads, [len(value)]]))
        several = moves[heads + sizes - 1] > moves[heads]
        if sizes.max() > RUN:
            pieces = -(-sizes // RUN)
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sizes = np.minimum(np.repeat(sizes, pieces) - k * RUN, RUN)
            heads, several = np.repeat(heads, pieces) + k * RUN, np.repeat(several, pieces)
        parts.append((value[heads], heads + base, sizes, several))
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s in order; s holds positive integers. Difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int32)
    assert n < 1 << 31
    padded = np.zeros(n + 3, np.int32)
    padded[:n] = s
    # a sample position n stands for the empty suffix where n is 1 modulo 3
    b1 = np.arange(1, n + (n % 3 == 1), 3, dtype=np.int32)
    b2 = np.arange(2, n, 3, dtype=np.int32)
    sample = np.concatenate([b1, b2])
    top = int(padded.max()) + 1
    if top < 1 << 21:
        key = padded[sample].astype(np.int64)
        for k in (1, 2):
            key *= top
            key += padded[sample + k]
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        new = key[1:] != key[:-1]
        del key
    else:
        order = np.lexsort((padded[sample + 2], padded[sample + 1], padded[sample])).astype(np.int32)
        by = sample[order]
        new = (padded[by[1:]] != padded[by[:-1]]) | (padded[by[1:] + 1] != padded[by[:-1] + 1]) | (padded[by[1:] + 2] != padded[by[:-1] + 2])
        del by
    if not new.all():
        names = np.empty(len(sample), np.int32)
        names[order[:1]] = 1
        names[order[1:]] = 1 + np.cumsum(new, dtype=np.int32)
        del order, new
        order = suffix_array(names)
        del names
    sorted_sample = sample[order]
    del order
    rank = np.zeros(n + 3, np.int32)
    rank[sorted_sample] = np.arange(1, len(sample) + 1, dtype=np.int32)
    b0 = np.arange(0, n, 3, dtype=np.int32)
    wide = len(sample) + 2
    pair = lambda x: padded[x].astype(np.int64) * wide + rank[x + 1]
    sorted0 = b0[np.argsort(pair(b0))]
    sorted_sample = sorted_sample[sorted_sample < n]
    # how many sampled suffixes come before each of the rest
    one, two = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    less = np.searchsorted(pair(one), pair(sorted0))
    if top < 1 << 20 and wide < 1 << 23:
        triple = lambda x: (padded[x].astype(np.int64) * top + padded[x + 1]) * wide + rank[x + 2]
        less += np.searchsorted(triple(two), triple(sorted0))
    else:
        both = np.concatenate([two, sorted0])
        order = np.lexsort((np.concatenate([np.zeros(len(two)), np.ones(len(sorted0))]), rank[both + 2], padded[both + 1], padded[both]))
        is0 = order >= len(two)
        less = less + np.cumsum(~is0)[is0]
    out = np.empty(n, np.int32)
    place = np.arange(len(sorted0)) + less
    rest = np.ones(n, bool)
    rest[place] = False
    out[place] = sorted0
    out[rest] = sorted_sample
    return out


def repeated_windows(texts: list[bytes], order: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Of each text, the starts of windows that equal an earlier one.

    A window's place is order[text] + start, given as a document's key parts and a place in it in
    the rows of `order`; windows at the same place are the same.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 1
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat[begin[1:] - 1] = 0
    flat += 1
    sa = suffix_array(flat)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    start = np.arange(len(flat), dtype=np.int32) - begin[text].astype(np.int32)
    is_window = start + length <= sizes[text]
    sa = sa[is_window[sa]]
    # adjacent windows are equal if their bytes are: all in blocks of eight, by words of the text
    same = np.ones(max(len(sa) - 1, 0), bool)
    raw = np.concatenate([(flat - 2).astype(np.uint8), np.zeros(16, np.uint8)])
    words = sum(raw[k : len(flat) + k].astype(U64) << U64(8 * k) for k in range(8))
    for at in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        live = np.flatnonzero(same)
        same[live] = words[sa[live] + at] == words[sa[live + 1] + at]
    for at in range(length) if length < 8 else []:
        same &= raw[sa[:-1] + at] == raw[sa[1:] + at]
    if not len(sa):
        return [np.zeros(0, np.int64)] * len(texts)
    heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
    # places in one number: the document's rank, then the byte
    document = np.unique(order[:, :-1], axis=0, return_inverse=True)[1].reshape(-1)
    place = (document[text[sa]].astype(np.int64) << 40) + order[text[sa], -1] + start[sa]
    first = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.concatenate([heads, [len(sa)]])))
    hits = sa[place != first]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    hits = np.sort(hits)
    edges = np.searchsorted(hits, begin)
    for t in np.unique(text[hits]).tolist():
        out[t] = start[hits[edges[t] : edges[t + 1]]]
    return out


def may_repeat(text: bytes, length: int = LENGTH) -> bool:
    """Whether a window may stand twice in the text: it would hold a whole block of those that the text is cut into, and this would stand twice."""
    size = length // 3
    return any(text.find(text[k : k + size], k + 1) >= 0 for k in range(0, len(text) - size, size))


def covers(starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of [x, x + length) over ascending starts."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length


PACKED = "bucket int, packed binary"


def _dealt(bucket: np.ndarray, columns: list[np.ndarray], blobs: list[bytes] | None = None) -> Iterator[tuple[int, bytes]]:
    """Entries by bucket, each column's bytes by significance, with the entries' texts behind."""
    order = np.argsort(bucket, kind="stable")
    heads = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        pick = order[a:b]
        parts = [len(pick).to_bytes(4, "little")]
        parts += [np.ascontiguousarray(c[pick].astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
        if blobs is not None:
            parts += [blobs[k] for k in pick.tolist()]
        yield int(bucket[pick[0]]), b"".join(parts)


def _entries(packed, n_columns: int) -> Iterator[tuple[list[np.ndarray], bytes]]:
    for data in packed:
        n = int.from_bytes(data[:4], "little")
        size = 8 * n
        columns = [np.ascontiguousarray(np.frombuffer(data, np.uint8, size, 4 + k * size).reshape(8, n).T).view(np.int64).ravel() for k in range(n_columns)]
        yield columns, data[4 + n_columns * size :]


def _batches(rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes]] = []
    for row in rows:
        held.append(row)
        if len(held) == 2048:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.binary())], names=["bucket", "packed"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.binary())], names=["bucket", "packed"])


FOUND = "key long, hash long, low long, windows int, hot boolean"


def runs_of(docs: DataFrame, n_buckets: int) -> DataFrame:
    """All runs of all texts, dealt by hash. Of runs of a stretch with one hash the first is sent on with their number; all are rows of bucket -1 if they are several."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in runs(batches, "text", 1 << 20):
            data, offsets = text_bytes(batch.column("text"))
            for key, a, b in zip(batch.column("key").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b - a >= LENGTH:
                    value, low, size, several = window_runs(data[a:b])
                    held.append((value, np.full(len(value), key, np.int64), low, size, several))
                    n += len(value)
            if n >= FLUSH:
                yield from _batches(sent(held))
                held, n = [], 0
        if held:
            yield from _batches(sent(held))

    def sent(held: list) -> Iterator[tuple[int, bytes]]:
        value, doc, low, size, several = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(value, kind="stable")
        value, doc, low, size, several = (x[order] for x in (value, doc, low, size, several))
        heads = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1])
        counts = np.diff(np.concatenate([heads, [len(value)]]))
        several = np.logical_or.reduceat(several, heads)
        many = counts > 1
        own = np.repeat(many, counts)
        yield from _dealt(np.full(own.sum(), -1), [value[own].view(np.int64), doc[own], low[own], size[own]])
        bucket = (value[heads] % U64(n_buckets)).astype(np.int64)
        counts = np.where(several & ~many, -1, counts)  # -1: one run that may repeat itself
        yield from _dealt(bucket, [value[heads].view(np.int64), doc[heads], low[heads], size[heads], counts])

    return docs.mapInArrow(find, PACKED)


def repeated_runs(packed: DataFrame) -> DataFrame:
    """The runs whose hash occurs again, and whether more than HOT places have it.

    Runs of a stretch that share their hash are known to repeat; whether their hash is hot is
    looked up afterwards, by the rows of the hot hashes (key is null).
    """

    def bucket(pdf):
        import pandas as pd

        value, doc, low, size, count = (np.concatenate(x) for x in zip(*(c for c, _ in _entries(pdf["packed"], 5)), strict=True))
        order = np.argsort(value, kind="stable")
        value, doc, low, size, count = (x[order] for x in (value, doc, low, size, count))
        heads = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1])
        entries = np.diff(np.concatenate([heads, [len(value)]]))
        total = np.add.reduceat(np.abs(count), heads)
        hot = total > HOT
        again = np.repeat(entries > 1, entries) | (count == -1)
        again &= count <= 1  # the others have rows of their own
        h = np.flatnonzero(hot)
        return pd.DataFrame({"key": pd.Series([*doc[again].tolist(), *[None] * len(h)], dtype="Int64"), "hash": np.concatenate([value[again], value[heads][h]]), "low": np.concatenate([low[again], np.zeros(len(h), np.int64)]), "windows": np.concatenate([size[again], np.zeros(len(h), np.int64)]).astype(np.int32), "hot": np.concatenate([np.repeat(hot, entries)[again], np.ones(len(h), bool)])})

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (value, doc, low, size), _ in _entries(batch.column("packed").to_pylist(), 4):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(value), pa.array(low), pa.array(size.astype(np.int32)), pa.nulls(len(doc), pa.bool_())], names=["key", "hash", "low", "windows", "hot"])

    return packed.where("bucket >= 0").groupBy("bucket").applyInPandas(bucket, FOUND).union(packed.where("bucket < 0").select("packed").mapInArrow(own, FOUND))


MARKS = "doc long, key long, low long, high long"


def _window_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of LENGTH bytes."""
    raw = np.frombuffer(data, np.uint8)
    out = []
    for salt in (1, 2):
        sums = np.zeros(len(raw) + 1, U64)
        np.cumsum(mix(BYTE_VALUES[raw] + U64(salt)) * powers(BASE, len(raw)), out=sums[1:])
        inverse = powers(pow(BASE, -1, 1 << 64), len(raw) + 1)
        out.append(mix((sums[LENGTH:] - sums[:-LENGTH]) * inverse[: len(raw) - LENGTH + 1]))
    return out[0], out[1]


def texts_of(joined: DataFrame, n_buckets: int) -> DataFrame:
    """The runs' texts, dealt by hash (columns hash, doc, key, low, size); windows of hot runs dealt by their own hash, in buckets from n_buckets on.

    Of equal texts of a stretch the earliest is sent on; the later ones' bytes are rows of
    bucket -1, as marks.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earliest: dict = {}
        windows: dict = {}
        marks: set = set()
        size = 0

        def sent() -> Iterator[tuple[int, bytes]]:
            if marks:
                m = np.array(sorted(marks), np.int64)
                yield from _dealt(np.full(len(m), -1), list(m.T))
            if earliest:
                value = np.array([k[0] for k in earliest], np.int64)
                at = np.array(list(earliest.values()), np.int64)
                blobs = [k[1] for k in earliest]
                bucket = (value.view(U64) % U64(n_buckets)).astype(np.int64)
                yield from _dealt(bucket, [value, *at.T, np.array([len(b) for b in blobs])], blobs)
            if windows:
                key = np.array(list(windows), U64)
                at = np.array(list(windows.values()), np.int64)
                bucket = n_buckets + (key[:, 0] % U64(n_buckets)).astype(np.int64)
                yield from _dealt(bucket, [key[:, 0].view(np.int64), key[:, 1].view(np.int64), *at.T])

        def later(table: dict, key, place: tuple[int, int, int], length: int) -> None:
            have = table.get(key)
            if have is None:
                table[key] = place
            elif have != place:
                if place < have:
                    table[key], place = place, have
                marks.add((*place, place[2] + length))

        for batch in runs(batches, "text", 1 << 20):
            for doc, own, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "key", "text", "runs")), strict=True):
                raw = (text or "").encode()
                for r in found:
                    low, n = r["low"], r["windows"]
                    content = raw[low : low + n + LENGTH - 1]
                    if len(content) < LENGTH:
                        continue  # a run of another row, whose key is the same by chance
                    if r["hot"]:
                        for k, key in enumerate(zip(*(x.tolist() for x in _window_hashes(content)), strict=True)):
                            later(windows, key, (doc, own, low + k), LENGTH)
                        size += 200 * n
                    else:
                        later(earliest, (r["hash"], content), (doc, own, low), len(content))
                        size += 200 + len(content)
            if size >= FLUSH_BYTES:
                yield from _batches(sent())
                earliest, windows, marks, size = {}, {}, set(), 0
        yield from _batches(sent())

    return joined.mapInArrow(pack, PACKED)


def marks_of(packed: DataFrame, n_buckets: int) -> DataFrame:
    """doc, key, low, high: bytes that are covered by a window that starts earlier too."""

    def bucket(pdf):
        import pandas as pd

        out: list[tuple[np.ndarray, ...]] = []
        if int(pdf["bucket"].iloc[0]) >= n_buckets:
            k1, k2, doc, own, low = (np.concatenate(x) for x in zip(*(c for c, _ in _entries(pdf["packed"], 5)), strict=True))
            order = np.lexsort((low, own, doc, k2, k1))
            k1, k2, doc, own, low = (x[order] for x in (k1, k2, doc, own, low))
            new = np.ones(len(k1), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc != doc[lead]) | (own != own[lead]) | (low != low[lead])
            out.append((doc[later], own[later], low[later], low[later] + LENGTH))
        else:
            earliest: dict = {}
            marks: list[tuple[int, int, int, int]] = []
            for (value, doc, own, low, size), blob in _entries(pdf["packed"], 5):
                at = 0
                for v, d, k, s, n in zip(value.tolist(), doc.tolist(), own.tolist(), low.tolist(), size.tolist(), strict=True):
                    content, place = blob[at : at + n], (d, k, s)
                    at += n
                    have = earliest.setdefault((v, content), place)
                    if have != place:
                        if place < have:
                            earliest[v, content], place = place, have
                        marks.append((*place, place[2] + n))
            # a hash with a single text can repeat only within it
            counts: dict[int, int] = {}
            for v, _ in earliest:
                counts[v] = counts.get(v, 0) + 1
            kept = [(v, c) for v, c in earliest if counts[v] > 1 or len(c) > LENGTH and may_repeat(c)]
            # by shares of the hashes, so that the arrays of a sort stay small
            n_parts = 1 + sum(len(c) for _, c in kept) // SORT_BYTES
            for share in range(n_parts):
                part = [k for k in kept if k[0] % n_parts == share] if n_parts > 1 else kept
                if not part:
                    continue
                order = np.array([earliest[k] for k in part], np.int64)
                for k, starts in enumerate(repeated_windows([c for _, c in part], order)):
                    if len(starts):
                        a, b = covers(starts)
                        out.append((np.full(len(a), order[k, 0]), np.full(len(a), order[k, 1]), a + order[k, 2], b + order[k, 2]))
            if marks:
                out.append(tuple(np.array(marks, np.int64).T))
        if not out:
            return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("doc", "key", "low", "high")})
        return pd.DataFrame(dict(zip(("doc", "key", "low", "high"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns, _ in _entries(batch.column("packed").to_pylist(), 4):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "key", "low", "high"])

    return packed.where("bucket >= 0").groupBy("bucket").applyInPandas(bucket, MARKS).union(packed.where("bucket < 0").select("packed").mapInArrow(own, MARKS))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and what tells rows apart: doc, the doc_id with null as the smallest number, and key, a hash of both."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return known.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "text")


def removal_spans(docs: DataFrame) -> DataFrame:
    """doc, key (see keyed) and marks, an array of (low, high) in bytes; documents without marks have no row."""
    texts = keyed(docs).drop("doc_id")
    total = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n_buckets = max(8, -(-total // (30 * BUCKET_ENTRIES)))
    # what a stretch sends on and its rows of bucket -1 must be of one evaluation: in another order of rows, stretches end elsewhere
    packed = materialize(runs_of(texts.select("key", "text"), n_buckets), "packed")
    found = materialize(repeated_runs(packed), "runs")
    forget(packed)
    hot = found.where("key is null").select("hash", F.lit(True).alias("is_hot"))
    every = found.where("key is not null").join(hot, "hash", "left").select("key", "hash", "low", "windows", F.coalesce("hot", "is_hot", F.lit(False)).alias("hot"))
    size = int(found.where("key is not null").agg(F.sum(F.col("windows") + LENGTH)).first()[0] or 0)
    n_texts = max(8, -(-size // BUCKET_BYTES))
    by_row = every.groupBy("key").agg(F.collect_list(F.struct("low", "windows", "hash", "hot")).alias("runs"))
    joined = texts.join(by_row.hint("shuffle_hash"), "key")
    packed = materialize(texts_of(joined, n_texts), "texts")
    forget(found)
    marks = materialize(marks_of(packed, n_texts), "marks")
    forget(packed)
    return marks.groupBy("doc", "key").agg(F.collect_list(F.struct("low", "high")).alias("marks"))


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low:long,high:long>>"


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (bytes removed); one row for each row of docs."""
    joined = keyed(docs).join(removal_spans(docs).hint("shuffle_hash"), ["doc", "key"], "left").select("doc_id", "text", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        for batch in runs(batches, "text", 1 << 20):
            rows = []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                raw = text.encode()
                spans: list[list[int]] = []
                for low, high in sorted((m["low"], min(m["high"], len(raw))) for m in marks or () if m["low"] < len(raw)):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                kept, at = hashlib.sha256(), 0
                for low, high in spans:
                    kept.update(raw[at:low])
                    at = high
                kept.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"low": a, "high": b} for a, b in spans]))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return joined.mapInArrow(cut, REMOVED)
