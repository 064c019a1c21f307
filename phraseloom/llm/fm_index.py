"""Benchmark decontamination with an FM-index for each training shard.

Words of a shard's documents become symbols; words that no benchmark item has can be in no
match, so only runs of benchmark words as long as the shortest window are indexed. The index
has the Burrows-Wheeler transform in a wavelet matrix; all windows of the items are searched
backward at once, and occurrences are located by walking to sampled suffix positions. Hit words
merge into removal spans.

Null texts have no words. Items of fewer words than a window are one window; items without
words match nothing. Repeated rows each get a row. Benchmarks over `block_bytes` are searched
in blocks, one pass over the documents each, so that a block's size bounds what is broadcast;
all blocks are searched in the texts as they came, and their hits count or go together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, materialize, passed, runs, spans_of, text_bytes, word_hashes

WINDOW = 10
SAMPLE = 16
SHARD_SYMBOLS = 1 << 20
SHARD_BYTES = 24 << 20
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling. Each 0 is smaller than all others and unlike other zeros."""
    n = len(symbols)
    zeros = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ordered = rank[order]
        new = np.ones(n, np.int64)
        if step > 1:
            after = np.where(order + step // 2 < n, rank[np.minimum(order + step // 2, n - 1)] + 1, 0)
            new[1:] = (ordered[1:] != ordered[:-1]) | (after[1:] != after[:-1])
        else:
            new[1:] = ordered[1:] != ordered[:-1]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(new) - 1
        rank = fresh
        if rank.max(initial=0) == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        order = np.argsort(rank * (n + 1) + second, kind="stable")
        step *= 2


class Wavelet:
    """A wavelet matrix: counts of a symbol before positions, one bit of the symbol a level."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[k] stands before position at[k]."""
        start = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            bit = (symbol >> level & 1).astype(bool)
            ones = self.ones[k]
            a, s = ones[at], ones[start]
            at = np.where(bit, self.zeros[k] + a, at - a)
            start = np.where(bit, self.zeros[k] + s, start - s)
        return at - start


class FMIndex:
    """Over a sequence of symbols in which zeros separate runs; the sequence ends with a zero."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE) -> None:
        self.alphabet, dense = np.unique(symbols, return_inverse=True)
        order = suffix_array(dense)
        self.bwt = dense[order - 1].astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(dense, minlength=len(self.alphabet)))])
        self.wavelet = Wavelet(self.bwt, max(1, (len(self.alphabet) - 1).bit_length()))
        start = np.ones(len(dense), bool)
        start[1:] = dense[:-1] == 0
        kept = (order % sample == 0) | start[order]  # a walk never crosses a separator
        self.kept_before = np.zeros(len(dense) + 1, np.int64)
        np.cumsum(kept, out=self.kept_before[1:])
        self.kept, self.samples = kept, order[kept]

    def step(self, row: np.ndarray) -> np.ndarray:
        symbol = self.bwt[row]
        return self.first[symbol] + self.wavelet.rank(symbol, row)

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern; rows of patterns are padded with -1."""
        low = np.zeros(len(sizes), np.int64)
        high = np.zeros(len(sizes), np.int64)
        dense = np.searchsorted(self.alphabet, patterns)
        dense[dense == len(self.alphabet)] = 0
        known = (self.alphabet[dense] == patterns) & (patterns > 0) | (patterns < 0)
        live = np.flatnonzero(known.all(1) & (sizes > 0))
        high[live] = len(self.bwt)
        for t in range(patterns.shape[1]):
            live = live[(t < sizes[live]) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = dense[live, sizes[live] - 1 - t]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes in these rows."""
        out = np.full(len(rows), -1, np.int64)
        open_, walked, at = np.arange(len(rows)), 0, rows.copy()
        while len(open_):
            done = self.kept[at]
            out[open_[done]] = self.samples[self.kept_before[at[done]]] + walked
            open_, at = open_[~done], self.step(at[~done])
            walked += 1
        return out


@dataclass(frozen=True)
class Queries:
    """The distinct windows of a block of items; owners lists (window, item) pairs by window."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    sizes: np.ndarray
    owner_window: np.ndarray
    owner_item: np.ndarray
    items: tuple[str, ...]


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = lowered(data)
    starts, ends = spans_of(WORD_BYTES[low], offsets)
    return low, starts, ends


def queries_of(items: list[tuple[str, str | None]], window: int) -> Queries:
    column = pa.array([t for _, t in items], pa.string())
    data, offsets = text_bytes(column)
    low, starts, ends = words_in(data, offsets)
    hashes = word_hashes(low, starts, ends)
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    rows = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(rows, minlength=len(items))
    first = np.cumsum(counts) - counts
    sizes = np.minimum(counts, window)
    many = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
    item = np.repeat(np.arange(len(items)), many)
    begin = first[item] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    patterns = np.full((len(item), window), -1, np.int64)
    for k in range(window):
        has = k < sizes[item]
        patterns[has, k] = ids[begin[has] + k] + 1
    if len(item):
        patterns, which = np.unique(patterns, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), item], 1), axis=0)
    else:
        pairs = np.zeros((0, 2), np.int64)
    return Queries(vocabulary, patterns, (patterns > 0).sum(1), pairs[:, 0], pairs[:, 1], tuple(i for i, _ in items))


class _Shard:
    """Documents gathered for one index."""

    def __init__(self, queries: Queries, key: str = "doc_id", kind: pa.DataType = pa.int64()) -> None:
        self.key, self.kind = key, kind
        self.q, self.shortest = queries, int(queries.sizes.min(initial=WINDOW)) if len(queries.sizes) else 1 << 60
        self.clear()

    def clear(self) -> None:
        self.ids, self.texts, self.words, self.bytes, self.size = [], [], [], 0, 0
        self.symbols, self.doc, self.start, self.end, self.word = [], [], [], [], []

    def add(self, batch: pa.RecordBatch) -> None:
        column = batch.column("text")
        data, offsets = text_bytes(column)
        low, starts, ends = words_in(data, offsets)
        rows = np.searchsorted(offsets, starts, "right") - 1
        counts = np.bincount(rows, minlength=batch.num_rows)
        base = len(self.ids)
        self.ids += batch.column(self.key).to_pylist()
        self.words += counts.tolist()
        self.texts.append(column)
        self.bytes += len(data)
        v = self.q.vocabulary
        if not len(v) or not len(starts):
            return
        hashes = word_hashes(low, starts, ends)
        at = np.searchsorted(v, hashes)
        at[at == len(v)] = 0
        known = v[at] == hashes
        s, e = spans_of(known, np.concatenate([[0], np.cumsum(counts)]))
        long = e - s >= self.shortest
        s, e = s[long], e[long]
        if not len(s):
            return
        sizes = e - s + 1  # and a separator
        to = np.cumsum(sizes)
        source = np.arange(to[-1]) - np.repeat(to - sizes, sizes) + np.repeat(s, sizes)
        last = np.zeros(to[-1], bool)
        last[to - 1] = True
        source[last] -= 1
        self.symbols.append(np.where(last, 0, at[source] + 1))
        self.doc.append(base + rows[source])
        self.start.append(starts[source] - offsets[rows[source]])
        self.end.append(ends[source] - offsets[rows[source]])
        self.size += int(to[-1])

    def result(self) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        hit = np.zeros(n, np.int64)
        spans: list[list[dict]] = [[] for _ in range(n)]
        items: list[list[str]] = [[] for _ in range(n)]
        if self.size:
            symbols = np.concatenate(self.symbols)
            doc, start, end = np.concatenate(self.doc), np.concatenate(self.start), np.concatenate(self.end)
            index = FMIndex(symbols)
            low, high = index.search(self.q.patterns, self.q.sizes)
            found = np.flatnonzero(high > low)
            many = (high - low)[found]
            window = np.repeat(found, many)
            rows = np.repeat(low[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = index.locate(rows)
            edge = np.zeros(len(symbols) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + self.q.sizes[window], -1)
            inside = np.cumsum(edge[:-1]) > 0
            hit += np.bincount(doc[inside], minlength=n)
            first = np.searchsorted(self.q.owner_window, window, "left")
            owners = np.searchsorted(self.q.owner_window, window, "right") - first
            pair_item = self.q.owner_item[np.repeat(first, owners) + np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners)]
            pairs = np.unique(np.stack([np.repeat(doc[at], owners), pair_item], 1), axis=0)
            for d, i in pairs.tolist():
                items[d].append(self.q.items[i])
            texts = pa.chunked_array(self.texts)
            s, e = spans_of(inside, np.zeros(0, np.int64))
            text, raw, of = None, b"", -1
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                if doc[a] != of:
                    of = int(doc[a])
                    raw = texts[of].as_py().encode()
                x, y = int(start[a]), int(end[b - 1])
                spans[of].append({"start": len(raw[:x].decode()), "end": len(raw[:y].decode())})
            del text
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(self.ids, self.kind), pa.array(self.words, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(spans, kind)], names=[self.key, "n_words", "n_hit", "items", "spans"])
        self.clear()


SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def blocks_of(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about block_bytes of text each."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    part = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n))
    return [benchmark.where(part == k) if n > 1 else benchmark for k in range(n)]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted) and spans of hit words in code points.

    One row for each row of docs. With several blocks a row's hits are put together, and counted
    on the spans of all.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = blocks_of(benchmark, block_bytes)
    if len(blocks) > 1:
        rows = docs.withColumn("_key", row_key()).join(hits_in_blocks(docs, blocks, window), "_key", "left")
        return rows.select("doc_id", "text", "_items", "_spans").mapInArrow(_counted, SCHEMA)
    rows = blocks[0].select(F.col("item_id").cast("string"), "text").collect()  # a block, of bounded size
    queries = docs.sparkSession.sparkContext.broadcast(queries_of([(r[0], r[1]) for r in rows], window))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(queries.value)
        for batch in runs(batches, "text", 2 << 20):
            shard.add(batch)
            if shard.size >= SHARD_SYMBOLS or shard.bytes >= SHARD_BYTES:
                yield from shard.result()
        if shard.ids:
            yield from shard.result()

    return docs.mapInArrow(searched, SCHEMA)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA from doc_id, text, and the items and spans of all blocks."""
    for batch in runs(batches, "text", 2 << 20):
        data, offsets = text_bytes(batch.column("text"))
        starts = words_in(data, offsets)[1]
        words = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=batch.num_rows)
        texts = batch.column("text").to_pylist()
        spans = [whole_runs(t, s) for t, s in zip(texts, batch.column("_spans").to_pylist(), strict=True)]
        hit = [sum(len(WORD.findall(t, *x)) for x in s) for t, s in zip(texts, spans, strict=True)]
        items = [x or [] for x in batch.column("_items").to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        named = [[{"start": x, "end": y} for x, y in s] for s in spans]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(named, kind)], names=["doc_id", "n_words", "n_hit", "items", "spans"])


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; the spaces around a removed span become one."""
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return " ".join(x.strip(" ") if 0 < k < len(kept) - 1 else x.rstrip(" ") if not k else x.lstrip(" ") for k, x in enumerate(kept))


def row_key() -> Column:
    """Tells rows apart by doc_id and text, nulls too; rows that it does not tell apart are the same."""
    return F.concat_ws("_", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text")))


def hits_in_blocks(docs: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """_key (row_key), items and spans of the rows that any block hits; spans of different blocks may overlap."""
    parts = []
    for block in blocks:
        rows = block.select(F.col("item_id").cast("string"), "text").collect()  # a block, of bounded size
        queries = docs.sparkSession.sparkContext.broadcast(queries_of([(r[0], r[1]) for r in rows], window))

        def searched(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            shard = _Shard(queries.value, "_key", pa.string())
            for batch in runs(batches, "text", 2 << 20):
                shard.add(batch)
                if shard.size >= SHARD_SYMBOLS or shard.bytes >= SHARD_BYTES:
                    yield from shard.result()
            if shard.ids:
                yield from shard.result()

        hits = docs.select(row_key().alias("_key"), "text").mapInArrow(searched, SCHEMA.replace("doc_id long", "_key string"))
        parts.append(hits.where("n_hit > 0").select("_key", "items", "spans").distinct())
    found = materialize(reduce(DataFrame.unionByName, parts), "hits")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    return found.groupBy("_key").agg(items.alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))


def whole_runs(text: str, spans: list[dict] | None) -> list[tuple[int, int]]:
    """The spans as those of runs of hit words: what overlaps or has no other word between becomes one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((x["start"], x["end"]) for x in spans or []):
        if out and (start <= out[-1][1] or not WORD.search(text, out[-1][1], start)):
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def cut(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """The batch without the spans; rows of which no word is left go."""
    if not any(spans):
        return batch
    texts = [without_spans(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
    return passed(batch, keep=[not s or bool(t.strip()) for t, s in zip(texts, spans, strict=True)], texts=texts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """docs, with all their columns, without the hit words; texts of which no word is left go.

    With several blocks the hits of all are found in the texts as they came, and cut at once.
    """
    blocks = blocks_of(benchmark, block_bytes)
    if len(blocks) > 1:
        hits = hits_in_blocks(docs, blocks, window).drop("_items")
        names = docs.columns

        def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in runs(batches, "text", 2 << 20):
                texts, spans = batch.column("text").to_pylist(), batch.column("_spans").to_pylist()
                yield cut(batch.select(names), [whole_runs(t, s) for t, s in zip(texts, spans, strict=True)])

        rows = docs.withColumn("_key", row_key()).join(hits, "_key", "left")
        return rows.select(*names, "_spans").mapInArrow(cut_all, docs.schema)
    rows = blocks[0].select(F.col("item_id").cast("string"), "text").collect()  # a block, of bounded size
    queries = docs.sparkSession.sparkContext.broadcast(queries_of([(r[0], r[1]) for r in rows], window))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = _Shard(queries.value), []

        def out() -> Iterator[pa.RecordBatch]:
            spans = [[(x["start"], x["end"]) for x in s] for part in shard.result() for s in part.column("spans").to_pylist()]
            at = 0
            for batch in held:
                yield cut(batch, spans[at : at + batch.num_rows])
                at += batch.num_rows

        for batch in runs(batches, "text", 2 << 20):
            shard.add(batch)
            held.append(batch)
            if shard.size >= SHARD_SYMBOLS or shard.bytes >= SHARD_BYTES:
                yield from out()
                held = []
        if held:
            yield from out()

    return docs.mapInArrow(cleaned, docs.schema)
