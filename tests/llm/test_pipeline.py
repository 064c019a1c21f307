import re

import pytest

import corpus_pipeline
from phraseloom.llm import ngram_join, secrets_crf, toxicity
from tests.conftest import DATA
from tests.llm.test_operators import components_by_hand, windows_by_hand

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(str(r[0]), r[1]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        path = str(tmp_path / name)
        stage(spark, docs, str(DATA)).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "ngram_jaccard_join":
            groups = components_by_hand([(i, r["text"]) for i, r in before.items()])
            assert set(after) == {c for _, c in groups.values()} and len(after) < len(before)
        if name == "benchmark_decontamination":
            found = windows_by_hand([r["text"] for r in after.values()], bench, 10)
            assert not any(n for _, n, _ in found)
            clean = windows_by_hand([r["text"] for r in before.values()], bench, 10)
            assert any(n for _, n, _ in clean)
            assert all(after[i]["text"] == before[i]["text"] for i, (_, n, _) in zip(before, clean, strict=True) if not n)
        if name == "secret_scans":
            assert not any(secrets_crf.base_spans(r["text"]) for r in after.values())
        if name != "mixture":
            assert docs.columns == columns
    assert set(kept["mixture"]) == set(kept["secret_scans"])
    assert re.match("[a-z_]+", name) and ngram_join and toxicity
