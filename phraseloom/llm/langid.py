"""Language identification of mixed-language text.

Each word's scripts narrow the languages that may own it (by the share of a language's letters
that training texts have in the script). A language's score for a word is the sum of the log
probabilities of the word's letter n-grams, which are hashed into a table. Viterbi over the
words, with a penalty for each switch, labels the spans. A text's language is the one whose
spans hold most letters; the score is the share of letters times the posterior of that language.

Null texts and texts without letters are `und` with score 0. Words whose scripts no learned
language uses take the label of their neighbours. Repeated rows each get a row; texts are read
whole. Rows are decoded together, word by word, so that memory is bounded by the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, runs, spans_of

# First code point of each range and its script, from the Unicode blocks.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({x for _, x in SCRIPTS})
SCRIPT_STARTS = np.array([x for x, _ in SCRIPTS], np.uint32)
SCRIPT_IDS = np.array([NAMES.index(x) for _, x in SCRIPTS], np.int64)
LETTER = re.compile(r"[^\W\d_]")
TABLE_BITS = 17
ORDERS = (3,)
SWITCH = 6.0
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter, by Python's Unicode tables."""
    if not _letters:
        import sys

        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: log probabilities by bucket and language; rows of len(NAMES): which languages use a script
    table: np.ndarray
    uses: np.ndarray


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, starts and ends of the words, and each word's row."""
    parts = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"".join(parts), np.uint32)
    sizes = np.array([len(p) // 4 for p in parts], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    letter = letter_table()[points] if len(points) else np.zeros(0, bool)
    starts, ends = spans_of(letter, at)
    return points, starts, ends, np.searchsorted(at, starts, "right") - 1


def grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table buckets of the n-grams of all words, and the number of them of each word.

    A word's letters stand between two boundary marks; a word of n letters has n + 2 symbols.
    """
    sizes = ends - starts + 2
    begin = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.ones(begin[-1], U64)  # 1 marks a boundary
    inner = np.ones(begin[-1], bool)
    inner[begin[:-1]] = False
    inner[begin[1:] - 1] = False
    take = np.zeros(len(points) + 1, np.int8)
    take[starts] += 1
    take[ends] -= 1
    symbols[inner] = points[np.cumsum(take[:-1]).astype(bool)]
    room = np.repeat(begin[1:], sizes) - np.arange(begin[-1])  # symbols up to the word's end
    buckets = []
    value = symbols.copy()
    for n in range(2, max(ORDERS) + 1):
        value[: -(n - 1)] = value[: -(n - 1)] * U64(0x100000001B3) + symbols[n - 1 :]
        if n in ORDERS:
            fits = room >= n
            buckets.append(np.where(fits, mix(value + U64(n << 56)) >> U64(64 - TABLE_BITS), U64(1 << TABLE_BITS)))
    return np.stack(buckets, 1), begin[:-1]


def word_scores(model: Model, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words x languages: log probabilities, the same for all languages where scripts leave no choice."""
    if not len(starts):
        return np.zeros((0, len(model.languages)), np.float32)
    out = np.empty((len(starts), len(model.languages)), np.float32)
    step = 40_000
    for at in range(0, len(starts), step):
        s, e = starts[at : at + step], ends[at : at + step]
        low, high = int(s[0]), int(e[-1])
        part = points[low:high]
        buckets, begin = grams(part, s - low, e - low)
        values = model.table[buckets[:, 0]]
        for k in range(1, buckets.shape[1]):
            values += model.table[buckets[:, k]]
        out[at : at + step] = np.add.reduceat(values, begin, axis=0)
        if len(part) and (part.max() >= 0x370 or not model.uses[NAMES.index("latin")].all()):
            script = SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, part, "right") - 1]
            allowed = np.minimum.reduceat(model.uses[script].astype(np.int8), s - low, axis=0).astype(bool)
            allowed[~allowed.any(1)] = True
            none = ~model.uses[script[s - low]].any(1)
            block = out[at : at + step]
            block[~allowed] = -1e4
            block[none] = 0
    return out


def viterbi(scores: np.ndarray, rows: np.ndarray, n_rows: int, switch: float) -> np.ndarray:
    """The best language of each word; words of a row are adjacent, rows ascend.

    All rows go through a step together; words are laid out by step, longest rows first. The
    forward pass keeps each state's value, from which the backward pass sees whether a state
    stayed or came from the best one.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    counts = np.bincount(rows, minlength=n_rows)
    rank = np.empty(n_rows, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(n_rows)
    step = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    live = np.bincount(step)  # rows with a word at each step
    begin = np.concatenate([[0], np.cumsum(live)])
    place = begin[step] + rank[rows]
    value = np.empty((k, n), np.float32)
    value[:, place] = scores.T
    edges = begin.tolist()
    for t in range(1, len(live)):
        now = value[:, edges[t - 1] : edges[t - 1] + edges[t + 1] - edges[t]]
        # values count from the best state, so that they stay small in long rows
        gap = now - now.max(0)
        value[:, edges[t] : edges[t + 1]] += np.maximum(gap, -switch, out=gap)
    top = value.argmax(0)
    stays = value >= value.max(0) - np.float32(switch)
    labels = np.empty(n, np.int64)
    state = np.empty(0, np.int64)
    for t in range(len(live) - 1, -1, -1):
        low, high = edges[t], edges[t + 1]
        m = len(state)
        own = top[low:high].copy()
        if m:
            own[:m] = np.where(stays[state, np.arange(low, low + m)], state, own[:m])
        labels[low:high] = own
        state = own
    return labels[place]


def detect(model: Model, texts: list[str | None], switch: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and spans (start, end, language; in code points of the lower-cased text)."""
    if not model.languages:
        return [("und", 0.0, []) for _ in texts]
    points, starts, ends, rows = words_of(texts)
    scores = word_scores(model, points, starts, ends)
    labels = viterbi(scores, rows, len(texts), switch)
    sizes = (ends - starts).astype(np.float64)
    n, k = len(texts), len(model.languages)
    held = np.bincount(rows * k + labels, weights=sizes, minlength=n * k).reshape(n, k) if len(rows) else np.zeros((n, k))
    total = np.stack([np.bincount(rows, weights=np.maximum(scores[:, x], -50), minlength=n) for x in range(k)], 1) if k else np.zeros((n, 0))
    letters = held.sum(1)
    base = np.concatenate([[0], np.cumsum([len((t or "").lower()) for t in texts])])
    new = np.ones(len(starts), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (rows[1:] != rows[:-1])
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(starts)]]) - 1 if len(heads) else heads
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for r, s, e, x in zip(rows[heads].tolist(), starts[heads].tolist(), ends[tails].tolist(), labels[heads].tolist(), strict=True):
        spans[r].append((s - int(base[r]), e - int(base[r]), model.languages[x]))
    out = []
    for i in range(n):
        if not letters[i] or not k:
            out.append(("und", 0.0, spans[i]))
            continue
        x = int(np.lexsort((-total[i], -held[i]))[0])
        odds = np.exp(np.clip((total[i] - total[i].max()) / 4, -50, 0))
        out.append((model.languages[x], float(held[i, x] / letters[i] * max(odds[x] / odds.sum(), 1 / k)), spans[i]))
    return out


def fit(docs: DataFrame, max_rows: int = 1500, min_share: float = 0.002) -> Model:
    """Learns from at most max_rows documents of each lang, the first by a hash of doc_id.

    Rows with a null lang or text do not count. A language uses a script that holds min_share of
    its letters. No rows: a model without languages, for which all texts are `und`.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    ids = None
    for name in names:
        one = known.where(F.col("lang") == name).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        ids = one if ids is None else ids.union(one)
    if ids is None:
        return Model((), np.zeros(((1 << TABLE_BITS) + 1, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(ids.distinct()), "doc_id").select("text", "lang")
    counted = sample.mapInArrow(lambda b: _gram_counts(b, names), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()  # at most languages x (buckets + scripts) rows
    counts = np.zeros((len(names), 1 << TABLE_BITS))
    letters = np.zeros((len(names), len(NAMES)))
    gram = rows["bucket"].to_numpy() >= 0
    counts[rows["lang"][gram], rows["bucket"][gram]] = rows["n"][gram]
    letters[rows["lang"][~gram], -1 - rows["bucket"][~gram]] = rows["n"][~gram]
    smooth = 0.5
    table = np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * counts.shape[1])) if len(names) else counts
    table -= table.mean(0, keepdims=True)
    table = np.vstack([table.T, np.zeros((1, len(names)))]).astype(np.float32) / len(ORDERS)
    uses = letters.T >= min_share * np.maximum(letters.sum(1), 1)
    return Model(tuple(names), table, uses)


def _gram_counts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(names), (1 << TABLE_BITS) + 1), np.int64)
    scripts = np.zeros((len(names), len(NAMES)), np.int64)
    for batch in runs(batches, "text", 1 << 20):
        langs = np.array([names.index(x) for x in batch.column("lang").to_pylist()])
        points, starts, ends, rows = words_of(batch.column("text").to_pylist())
        for x in np.unique(langs):
            own = langs[rows] == x
            if own.any():
                buckets, _ = grams(points, starts[own], ends[own])
                counts[x] += np.bincount(buckets.ravel().astype(np.int64), minlength=counts.shape[1])
                inside = np.zeros(len(points) + 1, np.int8)
                inside[starts[own]] += 1
                inside[ends[own]] -= 1
                used = points[np.cumsum(inside[:-1]).astype(bool)]
                scripts[x] += np.bincount(SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, used, "right") - 1], minlength=len(NAMES))
    l1, b1 = np.nonzero(counts[:, :-1])
    l2, s2 = np.nonzero(scripts)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([l1, l2]), pa.int32()), pa.array(np.concatenate([b1, -1 - s2]), pa.int32()), pa.array(np.concatenate([counts[l1, b1], scripts[l2, s2]]), pa.int64())], names=["lang", "bucket", "n"])


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and spans, an array of (start, end, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in runs(batches, "text", 1 << 20):
            found = detect(shared.value, batch.column("text").to_pylist(), switch)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if spans:
                columns.append(pa.array([[{"start": s, "end": e, "lang": n} for s, e, n in x[2]] for x in found], kind))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(labelled, "doc_id long, lang_pred string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * spans)


def learnable(docs: DataFrame) -> DataFrame:
    """Documents outside the held-out fold."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
