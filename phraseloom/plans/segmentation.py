"""Whole plans: tables of texts to clauses, units, cuts and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import numeric as N
from ..functions import text as T
from ..operators import writeback
from ..operators.chunker import Options, segment
from ..sources import dom


def clauses(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """One row for each clause: the kept columns, i and clause. No shuffle."""
    return docs.select(*keep, F.posexplode(T.split_clauses(text)).alias("i", "clause"))


def clause_offsets(rows: DataFrame, key: str) -> DataFrame:
    """start and end of each clause in UTF-16 units, by a running sum in its document."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(T.utf16_length(F.col("clause"))).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - T.utf16_length(F.col("clause")))


def gated(rows: DataFrame, text: str = "clause") -> DataFrame:
    """Clauses long enough to score, before any costly operator sees them. A generator holds the count, which a filter would otherwise compute again."""
    one = F.filter(F.array(T.visual_length(F.col(text))), lambda n: n >= N.MIN_UNITS)
    return rows.select("*", F.explode(one).alias("units"))


def letter_scores(clause: Column) -> Column:
    """A closed-form logit of each gap, from the letters at it: a stand-in for a network in tests."""
    codes = F.transform(F.split(clause, ""), F.ascii)
    return T.let(codes, lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: ((a * 31 + b * 17) % 97 / 4).cast("double")))


GAPS = "gaps long, best double, at long"


def letter_gaps(rows: DataFrame, keep: list[str], clause: str = "clause") -> DataFrame:
    """The kept columns with the number of a clause's gaps, the best gap's probability by softmax, and its index, the first of equal ones.

    As letter_scores, gap_probabilities and best_gap give them, over the code points of a whole
    batch at once; clauses of fewer than two letters have no gap, and null for best and at.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            size = np.array([len(t or "") for t in texts], np.int64)
            points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
            ends = np.cumsum(size)
            gaps = np.maximum(size - 1, 0)
            inside = np.ones(max(len(points) - 1, 0), bool)
            inside[ends[(size > 0) & (ends < len(points))] - 1] = False
            score = ((points[:-1] * 31 + points[1:] * 17) % 97 / 4)[inside]
            some = np.flatnonzero(gaps)
            best, at = np.full(len(texts), np.nan), np.full(len(texts), -1)
            if len(some):
                heads = np.cumsum(gaps[some]) - gaps[some]
                top = np.maximum.reduceat(score, heads)
                own = np.repeat(np.arange(len(some)), gaps[some])
                best[some] = 1 / np.add.reduceat(np.exp(score - top[own]), heads)
                first = np.where(score == top[own], np.arange(len(score)), len(score))
                at[some] = np.minimum.reduceat(first, heads) - heads
            none = gaps == 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(gaps), pa.array(best, mask=none), pa.array(at, mask=none)], names=[*batch.schema.names[:-1], "gaps", "best", "at"])

    source = rows.select(*keep, clause)
    return source.mapInArrow(scored, StructType(source.schema.fields[:-1] + StructType.fromDDL(GAPS).fields))


def uniform_cuts(clause: Column) -> Column:
    """Cuts of a clause of Han letters when all gaps score alike and any gap may be cut: after each letter while enough units stay."""
    n = F.length(clause)
    return F.when(n >= N.MIN_UNITS, F.sequence(F.lit(1), n - N.MIN_UNITS + 1)).otherwise(F.array().cast("array<int>"))


def page_snapshot(pages: DataFrame, processed: DataFrame | None = None, han_only: bool = True) -> DataFrame:
    """The texts to segment of pages that take part: supported address, no opt-out, not yet processed."""
    taking = pages.where(dom.supports_url(F.col("url")) & ~dom.opted_out(F.col("html")))
    texts = dom.page_texts(taking, han_only)
    return writeback.unprocessed(texts, processed) if processed is not None else texts


def page_markers(snapshot: DataFrame, live: DataFrame, scorer: Callable, options: Options = Options()) -> DataFrame:
    """Snapshot rows that are still current, with chunks and offsets."""
    return segment(writeback.current(snapshot, live), scorer, options=options)
