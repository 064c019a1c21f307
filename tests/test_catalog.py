import math
import re

import pytest

from phraseloom import catalog
from phraseloom.functions import text as T
from tests.conftest import DATA, compare

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, name):
    compare(spark, catalog.QUERIES, catalog.ORACLES, name)


def test_chunks_are_lossless(spark):
    from pyspark.sql import functions as F

    from phraseloom.functions.text import han_projection

    whole = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", han_projection(F.col("text")).alias("t"))
    for name in ("chunks_fixed", "chunks_recursive_model", "chunks_network"):
        found = catalog.QUERIES[name](spark, str(DATA)).join(whole, "item_id")
        assert found.where("joined != t or cuts > chunks - 1").count() == 0
        assert found.where("cuts > 0").count() > 0


def projected(text):
    return text.lower().translate(str.maketrans(T.PLAIN, T.PROJECTED))


def test_gaps_of_long_clauses(spark, tmp_path):
    """By hand, on clauses around the gates of 13 and 400 letters and far beyond."""
    made = lambda n, k: "".join(chr(97 + (j * j * k + j) % 26) for j in range(n))
    rows = [(k, "en", ".".join(made(n, k + 1) for n in sizes)) for k, sizes in enumerate([(12, 13), (399, 400, 401), (5000,), (11, 16819, 40), ()])]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, gate = set(), {}
    for key, _, text in rows:
        for i, clause in enumerate(re.findall("[^。]*。+|[^。]+", projected(text))):
            if len(clause) < 13:
                continue
            codes = [ord(c) for c in clause]
            scores = [(a * 31 + b * 17) % 97 / 4 for a, b in zip(codes, codes[1:], strict=False)]
            top = max(scores)
            best = 1 / math.fsum(math.exp(x - top) for x in scores)
            want.add((key, i, len(scores), round(best, 6), scores.index(top)))
            gate.setdefault(key, []).append(best > 0.45)
    got = catalog.QUERIES["gap_softmax_argmax_whole"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and max(r["gaps"] for r in got) > 16_000
    assert {tuple(r) for r in catalog.QUERIES["gap_gate_whole"](spark, str(tmp_path)).collect()} == {(k, len(v), sum(v)) for k, v in gate.items()}


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
