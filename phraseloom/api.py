"""The public surface: phrases of texts and of tables, and SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.chunker import Options, chunk_text, chunks_by_clause, cut_offsets, mark, visual_chunks
from .schema import CHUNK, RESPONSE


def replies(requests: DataFrame, scorer: Callable, segmenter: Callable | None = None, options: Options = Options()) -> DataFrame:
    """(id, offsets, error, received) for requests (id, texts, sent): the offsets of each text, or what went wrong.

    A request fails alone: one with a text that is no string, or that the scorer cannot score,
    has its error, and the others their offsets. Null texts, or none, are no request of texts.
    Batch or streaming; `received` is the time of the query.
    """
    shared = requests.sparkSession.sparkContext.broadcast((scorer, segmenter, options))

    def answer(texts: list[str | None] | None) -> tuple[list[list[int]] | None, str | None]:
        scorer, segmenter, options = shared.value
        try:
            if texts is None or any(t is None for t in texts):
                raise ValueError("texts are needed")
            return [cut_offsets(visual_chunks(t, scorer, segmenter, options)) for t in texts], None
        except Exception as failure:
            return None, str(failure) or type(failure).__name__

    def served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [answer(t) for t in batch.column("texts").to_pylist()]
            columns = [batch.column("id").cast(pa.int64()), pa.array([x[0] for x in found], pa.list_(pa.list_(pa.int32()))), pa.array([x[1] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "offsets", "error"])

    fields = [f.strip() for f in RESPONSE.split(", ") if not f.startswith("received")]
    return requests.select("id", "texts").mapInArrow(served, ", ".join(fields)).withColumn("received", F.current_timestamp())


def request_source(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Requests (id, texts, sent) from a folder of JSON lines, in batch or as a stream; lines of another form are left out."""
    from .schema import REQUEST

    reader = (spark.readStream if stream else spark.read).schema(REQUEST).option("mode", "DROPMALFORMED")
    return reader.json(path).where(F.col("id").isNotNull())


def register(spark: SparkSession, scorer: Callable, segmenter: Callable | None = None, options: Options = Options()) -> None:
    """Registers SQL functions of a text: phrase_chunks, phrase_chunks_by_clause, phrase_parts (with flags), phrase_offsets and phrase_mark."""
    shared = spark.sparkContext.broadcast((scorer, segmenter, options))
    functions = {
        "phrase_chunks": ("array<string>", lambda t, *how: chunk_text(t, *how)),
        "phrase_chunks_by_clause": ("array<array<string>>", lambda t, *how: chunks_by_clause(t, *how)),
        "phrase_parts": (f"array<{CHUNK}>", lambda t, *how: visual_chunks(t, *how)),
        "phrase_offsets": ("array<int>", lambda t, *how: cut_offsets(visual_chunks(t, *how))),
        "phrase_mark": ("string", lambda t, *how: mark(t, *how)),
    }

    def put(name: str, kind: str, f: Callable) -> None:
        @F.pandas_udf(kind)
        def own(texts: pd.Series) -> pd.Series:
            how = shared.value
            return pd.Series([None if t is None else f(t, *how) for t in texts], dtype=object)

        spark.udf.register(name, own)

    for name, (kind, f) in functions.items():
        put(name, kind, f)
