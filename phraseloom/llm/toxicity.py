"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding replaces homoglyphs and, inside words, digits and symbols that stand for letters, one
character for one, so that positions stay. Matches must be whole words, or the start of one for entries
that end in *; a match inside an
exception phrase does not count. The sum of weights is normalised by the text's length, and a
logistic function of it gives the score. Lexicon, exceptions and the function are learned from
a bounded sample of labelled rows (`max_rows` of each label, taken by a hash of doc_id).

Null and empty texts match nothing and get the score of a text without matches. Repeated rows
each get a row. Texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, forget, materialize, mix, passed, runs

# Letters of other scripts and forms that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "η": "n", "μ": "u", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
# Digits and symbols written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {ord("A") + i: chr(97 + i) for i in range(26)}
FOLD |= {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1 and not k.upper().isascii()}
#: Lengths of word starts that may be entries
STEMS = (5, 6, 7)
#: 23: one word in a million passes by chance
MIN_ODDS, MIN_SURE = 6, 23
INNER = re.compile(r"[0134578@$!|€9]+(?=[^\W\d_])")
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """The text in one case with look-alikes as Latin letters; as long as the text.

    Digits and symbols count as letters between letters, and a single one before a word.
    """
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    try:
        low.encode("latin-1")  # no look-alike has so low a code point
    except UnicodeEncodeError:
        low = low.translate(FOLD)

    def letters(m: re.Match) -> str:
        before = low[m.start() - 1] if m.start() else " "
        if before.isalpha() or len(m[0]) == 1 and not before.isalnum() and before != "_":
            return "".join(SUBSTITUTES[c] for c in m[0])
        return m[0]

    return INNER.sub(letters, low)


@dataclass(frozen=True)
class Lexicon:
    words: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    #: bias, and weights of the three features
    logistic: tuple[float, float, float, float]

    def automaton(self) -> ahocorasick.Automaton:
        """Each phrase with its length, its weight as a whole word and as the start of one; no weights at an exception."""
        found = ahocorasick.Automaton()
        keys: dict[str, list[float]] = {}
        for word, weight in self.words:
            keys.setdefault(word.rstrip("*"), [0.0, 0.0])[word.endswith("*")] = weight
        for key, (own, stem) in keys.items():
            found.add_word(key, (len(key), own, stem))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None, None))
        if len(found):
            found.make_automaton()
        return found


def matches(automaton: ahocorasick.Automaton, folded: str) -> list[tuple[int, int, float]]:
    """Start, end and weight of the words that count; of a word's matches the heaviest."""
    if not len(automaton):
        return []
    hits: dict[int, tuple[int, int, float]] = {}
    excused = []
    for last, (size, own, stem) in automaton.iter(folded):
        start, end = last + 1 - size, last + 1
        if start and folded[start - 1].isalnum():
            continue
        ends = not (end < len(folded) and folded[end].isalnum())
        if own is None:
            if ends:
                excused.append((start, end))
            continue
        weight = max(own, stem) if ends else stem
        if weight and weight >= hits.get(start, (0, 0, 0.0))[2]:
            hits[start] = (start, end, weight)
    return [h for h in hits.values() if not any(s <= h[0] and h[1] <= e for s, e in excused)] if excused else list(hits.values())


def measures(text: str, hits: list[tuple[int, int, float]]) -> tuple[float, float, float]:
    """What the logistic function sees: weight in all, weight by length, and the strongest word."""
    total = sum(h[2] for h in hits)
    words = text.count(" ") + 1
    return math.log1p(total), math.log1p(100 * total / (20 + words)), max((h[2] for h in hits), default=0.0)


def _word_rows(batches: Iterator[pa.RecordBatch], around: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Each row's distinct words, with three keys that near copies mostly share; with `around`, its pairs of words of which one is in it."""
    for batch in runs(batches, "text", 1 << 18):
        words, toxic, keys = [], [], []
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = WORD.findall(fold(text or ""))
            own = set(found)
            if not own:
                continue
            hashes = np.array([zlib.crc32(w.encode()) for w in found], U64)
            if len(hashes) > 2:
                hashes = mix(mix(mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:])  # of three words in a row
            ends = [int(mix(hashes + U64(k + 1)).min() >> U64(1)) for k in range(3)]
            if around is not None:
                own = {f"{a} {b}" for a, b in zip(found, found[1:], strict=False) if a in around or b in around}
            else:
                own |= {f"{w[:k]}*" for w in own for k in STEMS if len(w) > k}
            words += own
            toxic += [y] * len(own)
            keys += [ends] * len(own)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(toxic, pa.int32()), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(3))], names=["word", "toxic", "k0", "k1", "k2"])


def sample_of(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most max_rows labelled documents of each label, the first by a hash of doc_id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = known.where("1 = 0")
    for y in (0, 1):
        ids = ids.union(known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Lexicon:
    """Learns a lexicon from `labels` (doc_id, toxic), of which at most 2 * max_rows rows count.

    A word's count is the number of distinct texts that hold it, where near copies count once
    or a few times. A word enters with at least four toxic texts and odds above MIN_ODDS for
    toxic texts whose log-likelihood ratio exceeds MIN_SURE; its weight is the log of the odds. A word
    pair around a lexicon word is an exception if clean texts hold it and toxic texts don't
    more often. All words and pairs that pass are kept; the sample bounds their number.
    Without labels of both kinds nothing is learned and all scores are near 0.
    """
    sample = materialize(sample_of(docs, labels, max_rows), "toxic-sample")
    sizes = {int(r["toxic"]): int(r["n"]) for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)

    def scored(around: frozenset[str] | None = None) -> DataFrame:
        words = sample.mapInArrow(lambda b: _word_rows(b, around), "word string, toxic int, k0 long, k1 long, k2 long")
        counts = words.groupBy("word", "toxic").agg(*(F.countDistinct(f"k{k}").alias(f"n{k}") for k in range(3)))
        one = F.least("n0", "n1", "n2")
        counts = counts.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, one).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, one).otherwise(0)).alias("neg"))
        odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
        share = n_pos / (n_pos + n_neg)
        gain = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / ((F.col("pos") + F.col("neg")) * p))).otherwise(0.0)
        return counts.withColumn("odds", odds).withColumn("sure", 2 * (gain("pos", share) + gain("neg", 1 - share)))

    lexicon: dict[str, float] = {}
    exceptions: list[str] = []
    if n_pos and n_neg:
        single = scored().where((F.length("word") >= 3) & (F.col("pos") >= 4) & (F.col("odds") > math.log(MIN_ODDS)) & (F.col("sure") > MIN_SURE))
        lexicon = {r["word"]: float(r["odds"]) for r in single.collect()}
    if lexicon:
        pairs = scored(frozenset(lexicon)).where((F.col("neg") >= 4) & (F.col("odds") < 0))
        exceptions = sorted(r["word"] for r in pairs.collect())
    found = Lexicon(tuple(sorted(lexicon.items())), tuple(exceptions), (0.0, 0.0, 0.0, 0.0))
    rows = np.array(sample.mapInArrow(lambda b: _sample_measures(b, found), "a double, b double, c double, toxic int").toPandas(), float) if n_pos + n_neg else np.zeros((0, 4))
    forget(sample)
    return Lexicon(found.words, found.exceptions, logistic(rows[:, :3], rows[:, 3]))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Newton's method with a small ridge; without rows of both kinds, a function that is near 0 everywhere."""
    if not len(y) or y.min() == y.max():
        return (-30.0, 0.0, 0.0, 0.0)
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(4)
    ridge = np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _sample_measures(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    automaton = lexicon.automaton()
    for batch in runs(batches, "text", 1 << 20):
        rows = [measures(t or "", matches(automaton, fold(t or ""))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows]) for k in range(3)), batch.column("toxic").cast(pa.int32())], names=["a", "b", "c", "toxic"])


def score_of(lexicon: Lexicon, text: str, hits: list[tuple[int, int, float]]) -> float:
    w = lexicon.logistic
    z = w[0] + sum(a * b for a, b in zip(w[1:], measures(text, hits), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1) and matches, an array of (start, end, weight) in code points."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))
        for batch in runs(batches, "text", 1 << 20):
            scores, found = [], []
            for text in batch.column("text").to_pylist():
                hits = matches(automaton, fold(text or ""))
                scores.append(score_of(lexicon, text or "", hits))
                found.append([{"start": s, "end": e, "weight": w} for s, e, w in hits])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "matches"])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double, matches array<struct<start:long,end:long,weight:double>>")


def learnable(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in runs(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield passed(batch, keep=[score_of(lexicon, t, matches(automaton, fold(t))) < threshold for t in texts])

    return docs.mapInArrow(kept, docs.schema)
