"""Secret scans: base patterns, and a linear-chain conditional random field for what they miss.

A text's tokens are runs of letters, digits and + / _ . - ; the field tags each as begin,
inside or outside of a secret. Its features are the token's shape, what stands before it, the
word before it, and how much of the file's text is digits. Weights are fitted by the exact
gradient of the likelihood on windows of tokens from a bounded sample of documents, where the
base patterns give the tags; Viterbi decodes. Tokens that cannot leave `outside` on any best
path are skipped before decoding, which changes no result.

Null and empty texts have no spans. Repeated rows each get a row. Texts are read whole. A
tagged run that overlaps a base span is dropped; others are spans of kind `crf`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, U64, passed, runs, spans_of, text_bytes, word_hashes

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: bytes that a token's counts are of: digits, a-f, lower, upper
CLASSES = np.zeros((4, 256), bool)
CLASSES[0, 48:58] = CLASSES[1, 97:103] = CLASSES[2, 97:123] = CLASSES[3, 65:91] = True
TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = True
TOKEN[[43, 45, 46, 47, 95]] = True
TOKEN[128:] = True
LENGTHS = np.array([3, 6, 8, 12, 16, 20, 24, 32, 40, 64])
N_LENGTH, N_DIGIT, N_UPPER, N_KIND = len(LENGTHS) + 1, 5, 4, 4
N_BEFORE, N_WORDS, N_FILE = 6, 1024, 5
GROUPS = (N_LENGTH, N_DIGIT, N_UPPER, N_KIND, N_LENGTH * N_KIND, N_BEFORE, N_WORDS, N_FILE, N_BEFORE * N_KIND)
STARTS = np.concatenate([[0], np.cumsum(GROUPS)])
#: Stands for all features of a token that is not there
PADDING = int(STARTS[-1])
#: Of windows without a base span one in so many is kept
OTHERS = 16
OUT, BEGIN, INSIDE = 0, 1, 2
NEVER = -1e4


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three base kinds by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


@dataclass(frozen=True)
class Model:
    #: weights by feature and tag; scores of tag pairs; scores of first tags
    weights: np.ndarray
    pairs: np.ndarray
    first: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = spans_of(TOKEN[data], offsets)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def features(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Tokens x groups: the feature of each group that a token has."""
    sums = np.zeros(len(data) + 1, np.int64)
    counts = []
    for own in CLASSES[::-1]:  # the sums of digits stay for the file
        np.cumsum(own[data], out=sums[1:])
        counts.append(sums[ends] - sums[starts])
    upper, lower, hexa, digits = counts
    size = ends - starts
    length = np.searchsorted(LENGTHS, size, "right")
    share = np.where(digits == 0, 0, np.where(digits * 8 < size, 1, np.where(digits * 2 < size, 2, np.where(digits < size, 3, 4))))
    case = np.where(upper == 0, 0, np.where(upper == size, 3, np.where((upper == 1) & (lower > 0), 1, 2)))
    kind = np.where(digits + hexa == size, np.where(digits == size, 0, 1), np.where(digits + lower + upper == size, 2, 3))
    gap = starts - np.where(np.arange(len(starts)) > 0, np.concatenate([[0], ends[:-1]]), 0)
    head = offsets[rows]
    one, two = np.maximum(starts - 1, 0), np.maximum(starts - 2, 0)
    p1 = np.where(starts > head, data[one] if len(data) else 0, 10)
    p2 = np.where(starts - 1 > head, data[two] if len(data) else 0, 10)
    quoted = (p1 == 34) | (p1 == 39) | (p1 == 96)
    near = np.where(quoted, p2, p1)
    assign = (near == 61) | (near == 58) | ((near == 32) & (gap >= 2) & np.isin(p2 if len(data) else near, [61, 58]))
    # with `= "x`, the sign stands two or three bytes before
    three = np.maximum(starts - 3, 0)
    p3 = np.where(starts - 2 > head, data[three] if len(data) else 0, 10)
    assign |= quoted & (p2 == 32) & np.isin(p3, [61, 58])
    before = np.where(assign, np.where(quoted, 5, 4), np.where(quoted, 3, np.where(p1 == 32, 1, np.where(p1 == 64, 2, 0))))
    hashes = word_hashes(data | np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8), starts, ends) % U64(N_WORDS - 1)
    word = np.full(len(starts), N_WORDS - 1, np.int64)
    same = rows[1:] == rows[:-1]
    word[1:][same] = hashes[:-1][same].astype(np.int64)
    word[size < 6] = N_WORDS - 1  # the word before matters for long tokens only
    per_row = sums[offsets[1:]] - sums[offsets[:-1]]
    file = np.minimum((64 * per_row) // np.maximum(offsets[1:] - offsets[:-1], 1), N_FILE - 1)[rows]
    own = (length, share, case, kind, length * N_KIND + kind, before, word, file, before * N_KIND + kind)
    return np.stack([x + s for x, s in zip(own, STARTS[:-1], strict=True)], 1).astype(np.int32)


def emissions(model: Model, feats: np.ndarray) -> np.ndarray:
    out = model.weights[feats[:, 0]]
    for k in range(1, feats.shape[1]):
        out = out + model.weights[feats[:, k]]
    return out


def decode(model: Model, scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The best tags of all rows' tokens, by Viterbi."""
    n = len(scores)
    tags = np.zeros(n, np.int64)
    finite = model.pairs[model.pairs > NEVER / 2]
    finite = np.concatenate([finite, model.first[model.first > NEVER / 2], [0.0]])
    slack = 3 * (finite.max() - finite.min()) + np.abs(model.weights[:, BEGIN] - model.weights[:, INSIDE]).reshape(-1).max(initial=0) * len(GROUPS)
    may = scores[:, OUT] - scores[:, 1:].max(1) < slack
    edges = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1, [n]]) if n else np.zeros(1, np.int64)
    heads, tails = spans_of(may, edges)
    if not len(heads):
        return tags
    begins_row = np.isin(heads, edges)
    ends_row = np.isin(tails, edges)
    order = np.argsort(-(tails - heads), kind="stable")
    heads, tails, begins_row, ends_row = heads[order], tails[order], begins_row[order], ends_row[order]
    sizes = tails - heads
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    value = np.where(begins_row[:, None], model.first, model.pairs[OUT]) + scores[heads]
    back = []
    for t in range(1, len(live)):
        m = live[t]
        through = value[:m, :, None] + model.pairs
        back.append(through.argmax(1))
        value[:m] = through.max(1) + scores[heads[:m] + t]
    last = value + np.where(ends_row[:, None], 0.0, model.pairs[:, OUT])
    state = last.argmax(1)
    now = state.copy()
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        tags[heads[:m] + t] = now[:m]
        if t:
            now[:m] = back[t - 1][np.arange(m), now[:m]]
    return tags


def scan(model: Model, column: pa.Array) -> list[list[tuple[str, int, int]]]:
    """Spans of each text, in code points, by start, then kind."""
    texts = column.to_pylist()
    found = [base_spans(t or "") for t in texts]
    data, offsets = text_bytes(column)
    starts, ends, rows = tokens(data, offsets)
    if not len(starts):
        return found
    tags = decode(model, emissions(model, features(data, offsets, starts, ends, rows)), rows)
    tagged = np.flatnonzero(tags)
    if len(tagged):
        new = np.ones(len(tagged), bool)
        new[1:] = (tags[tagged[1:]] == BEGIN) | (tagged[1:] != tagged[:-1] + 1) | (rows[tagged[1:]] != rows[tagged[:-1]])
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(tagged)]]) - 1
        for a, b in zip(tagged[heads].tolist(), tagged[tails].tolist(), strict=True):
            row = int(rows[a])
            raw = data[offsets[row] : offsets[row + 1]].tobytes()
            s = len(raw[: int(starts[a] - offsets[row])].decode())
            e = s + len(raw[int(starts[a] - offsets[row]) : int(ends[b] - offsets[row])].decode())
            if not any(x < e and s < y for k, x, y in found[row] if k != "crf"):
                found[row].append(("crf", s, e))
        for row in set(rows[tagged].tolist()):
            found[row].sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Windows of `width` tokens of one text with their features and tags: all that hold a base span, and of the others one in OTHERS by a hash.

    A text's last window is filled up with PADDING. What a text gives does not depend on others.
    """
    for batch in runs(batches, "text", 1 << 20):
        column = batch.column("text")
        data, offsets = text_bytes(column)
        starts, ends, rows = tokens(data, offsets)
        if not len(starts):
            continue
        own = features(data, offsets, starts, ends, rows)
        y = np.zeros(len(starts), np.int64)
        for row, text in enumerate(column.to_pylist()):
            spans = base_spans(text or "")
            if spans:
                lo, hi = np.searchsorted(rows, [row, row + 1])
                for kind, s, e in spans:
                    if kind == "assign":
                        s = e - len(ASSIGN.match(text, s)[1])
                    b = int(offsets[row]) + len(text[:s].encode())
                    z = b + len(text[s:e].encode())
                    inside = np.arange(lo, hi)[(starts[lo:hi] < z) & (ends[lo:hi] > b)]
                    y[inside] = INSIDE
                    y[inside[:1]] = BEGIN
        feats, tags, holds = [], [], []
        edges = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for at in range(lo, hi, width):
                to = min(at + width, hi)
                f = np.full((width, own.shape[1]), PADDING, np.int32)
                f[: to - at] = own[at:to]
                t = np.zeros(width, np.int8)
                t[: to - at] = y[at:to]
                if t.any() or zlib.crc32(f.tobytes()) % OTHERS == 0:
                    feats.append(f.tobytes())
                    tags.append(t.tobytes())
                    holds.append(bool(t.any()))
        yield pa.RecordBatch.from_arrays([pa.array(feats, pa.binary()), pa.array(tags, pa.binary()), pa.array(holds, pa.bool_())], names=["feats", "tags", "holds"])


def fit(docs: DataFrame, max_rows: int = 4000, max_windows: int = 4000, width: int = 24, rounds: int = 80) -> Model:
    """Fits the field to at most max_windows windows of at most max_rows documents, taken by a hash of doc_id.

    Windows with and without a base span are at most half of max_windows each, the first by a
    hash. The fit depends on the rows alone, not on how they are dealt to files and batches.
    """
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")
    found = materialize(sample.mapInArrow(lambda b: _windows(b, width), "feats binary, tags binary, holds boolean"), "windows")
    rows = [r for holds in (True, False) for r in found.where(F.col("holds") == holds).orderBy(F.xxhash64("feats"), "feats", "tags").limit(max_windows // 2).collect()]
    forget(found)
    n = len(rows)
    x = np.frombuffer(b"".join(r["feats"] for r in rows), np.int32).reshape(n, width, len(GROUPS))
    y = np.frombuffer(b"".join(r["tags"] for r in rows), np.int8).reshape(n, width).astype(np.int64)
    return train(x, y, rounds)


def train(x: np.ndarray, y: np.ndarray, rounds: int, rate: float = 0.15, ridge: float = 2e-4) -> Model:
    """Adam on the negative log likelihood of the windows; forward and backward sums in log space."""
    n, width = y.shape
    weights, pairs, first = np.zeros((PADDING + 1, 3)), np.zeros((3, 3)), np.zeros(3)
    bar = np.zeros((3, 3))
    bar[OUT, INSIDE] = NEVER
    bar_first = np.array([0.0, 0.0, NEVER])
    params = [weights, pairs, first]
    if n:
        weights[:, OUT] = 0.05
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    flat, gold = x.reshape(-1, x.shape[2]), np.eye(3)[y]
    lse = lambda a, axis: a.max(axis) + np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis))
    for step in range(1, rounds * bool(n) + 1):
        s = sum(weights[flat[:, k]] for k in range(flat.shape[1])).reshape(n, width, 3)
        t, f = pairs + bar, first + bar_first
        alpha, beta = np.empty((width, n, 3)), np.zeros((width, n, 3))
        alpha[0] = f + s[:, 0]
        for i in range(1, width):
            alpha[i] = lse(alpha[i - 1][:, :, None] + t, 1) + s[:, i]
        for i in range(width - 2, -1, -1):
            beta[i] = lse(t + (s[:, i + 1] + beta[i + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        node = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
        residual = (node - gold).reshape(-1, 3)
        g_w = np.zeros_like(weights)
        for k in range(flat.shape[1]):
            for c in range(3):
                g_w[:, c] += np.bincount(flat[:, k], residual[:, c], len(weights))
        g_p = np.zeros((3, 3))
        for i in range(1, width):
            edge = np.exp(alpha[i - 1][:, :, None] + t + (s[:, i] + beta[i])[:, None, :] - z[:, None, None])
            g_p += edge.sum(0) - np.einsum("na,nb->ab", gold[:, i - 1], gold[:, i])
        grads = [g_w / n + ridge * weights, g_p / n + ridge * pairs, (node[:, 0] - gold[:, 0]).sum(0) / n + ridge * first]
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    if not n:
        weights[:, OUT] = 1.0
    return Model(weights[:PADDING], pairs + bar, first + bar_first)


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start, then kind; one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "text", 1 << 20):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in scan(shared.value, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(spans, SPAN)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scanned, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, mark: str = "[SECRET]") -> DataFrame:
    """docs, with all their columns, with the secrets in text replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            found = scan(shared.value, batch.column("text"))
            yield passed(batch, texts=[redacted(t, s, mark) if s else t for t, s in zip(texts, found, strict=True)]) if any(found) else batch

    return docs.mapInArrow(cleaned, docs.schema)
