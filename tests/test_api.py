import phraseloom
import pytest
from phraseloom import catalog
from phraseloom.operators import writeback as W
from phraseloom.operators.scorers import Uniform
from phraseloom.plans import segmentation as S
from phraseloom.sources import dom, files
from phraseloom.streaming import refresh as R
from pyspark.sql import functions as F

HOW = phraseloom.Options(min_confidence=0, strategy="fixed")
TEXT = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰"


class Broken:
    def __call__(self, segments):
        raise ValueError("no scores")


def test_replies_fail_alone(spark):
    rows = spark.createDataFrame([(1, [TEXT, ""]), (2, None), (3, [None]), (4, [])], "id long, texts array<string>")
    got = {r["id"]: (r["offsets"], r["error"]) for r in phraseloom.replies(rows, Uniform(), options=HOW).collect()}
    assert got == {1: ([phraseloom.cut_offsets(phraseloom.visual_chunks(TEXT, Uniform(), None, HOW)), []], None), 2: (None, "texts are needed"), 3: (None, "texts are needed"), 4: ([], None)}
    assert [r["error"] for r in phraseloom.replies(rows.where("id = 1"), Broken()).collect()] == ["no scores"]


def test_registered_functions(spark):
    phraseloom.register(spark, Uniform(), None, HOW)
    got = spark.createDataFrame([(TEXT,), (None,)], "t string").selectExpr("phrase_chunks(t) AS c", "phrase_offsets(t) AS o", "phrase_mark(t) AS m", "phrase_parts(t) AS p", "phrase_chunks_by_clause(t) AS k").collect()
    chunks = phraseloom.chunk_text(TEXT, Uniform(), None, HOW)
    assert got[0]["c"] == chunks and got[0]["o"] == [1, 2, 3] and got[0]["m"] == "｜".join(chunks) and [x["text"] for x in got[0]["p"]] == chunks and got[0]["k"] == [chunks]
    assert all(x is None for x in got[1])


def test_requests_from_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id": 1, "texts": ["a"], "sent": "2024-01-01T00:00:00"}\nno json\n')
    assert [r["texts"] for r in phraseloom.request_source(spark, str(tmp_path)).collect()] == [["a"]]


def test_a_rejected_request_fires_no_timeout(spark):
    seconds = lambda x: F.timestamp_millis((F.col(x) * 1000).cast("long"))
    sent = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.5), (4, 4.0), (5, 20.0)], "id long, s double").select("id", seconds("s").alias("sent"))
    back = spark.createDataFrame([(3, 7.0), (4, 6.0)], "id long, s double").select("id", seconds("s").alias("received"), F.array(F.array(F.lit(1))).alias("offsets"), F.lit(None).cast("string").alias("error"))
    got = {r["id"]: r["error"] for r in R.rejected_with(R.answered(sent, back)).collect()}
    assert got == {1: "timeout", 2: "rejected", 3: None, 4: "rejected", 5: "timeout"}


def test_flights_are_switched_off():
    assert R.single_flight([(0, 10), (100, None), (500, 10)]) == [(700, 710)]
    assert R.single_flight([(0, 900), (500, None), (600, 5)]) == [(200, 1100), (1100, 1105)]


def test_settings_and_batches(spark, tmp_path):
    R.write_setting(spark, str(tmp_path / "s"), True)
    assert R.setting(spark.read.parquet(str(tmp_path / "s"))) and not R.setting(None)
    ran = []
    run = R.each_batch(lambda df, k: ran.append(k), lambda: max(ran, default=-1))
    for k in (0, 1, 1, 0, 2):
        run(None, k)
    assert ran == [0, 1, 2]


def test_each_text_needs_its_own_result(spark):
    snap = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "snapshot_id long, idx int, text string")
    for bad in ([(1, 0, [1]), (1, 0, [2])], [(1, 0, [1]), (1, 2, [2])], [(2, 0, [1])]):
        with pytest.raises(Exception, match="as many results"):
            W.with_results(snap, spark.createDataFrame(bad, "snapshot_id long, idx int, offsets array<int>")).collect()


def test_page_texts_in_one_pass(spark):
    html = "<!doctype html><div>a<b style='visibility:hidden'>x<i style='visibility: visible !important'>y</i></b><p>p<li>z<code>no</code><span class='q phrase-divider'>no</span>𠀀中</div><p hidden>no</p>tail"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    for han in (False, True):
        one = dom.page_texts(pages, han)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
        rows = lambda df: sorted((r["page_id"], r["idx"], r["node_id"], r["parent_id"], r["text"], r["start"], r["end"]) for r in df.collect())
        assert rows(one) == rows(dom.readable_texts(dom.dom_nodes(pages), han)) and one.count() == (1 if han else 6)


def test_opt_out_in_any_order(spark):
    pages = {'<meta content="off" name="phraseloom">': True, "<META NAME=phraseloom CONTENT=off>": True, '<meta name="phraseloom" content="offer">': False, '<meta name="phraselooms" content="off">': False, '<meta name="phraseloom"><meta content="off">': False}
    got = spark.createDataFrame([(p,) for p in pages], "html string").select("html", dom.opted_out(F.col("html")).alias("x")).collect()
    assert {r["html"]: r["x"] for r in got} == pages


def test_the_length_gate_counts_once(spark):
    rows = spark.createDataFrame([("甲" * 13,), ("甲" * 12,)], "clause string")
    gated = S.gated(rows)
    assert [r["units"] for r in gated.collect()] == [13]
    assert gated._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2


def test_marked_copy_by_lines():
    source = "+++\r\ntitle = 'x'\r\nlead = [\r\n  'ab',\r\n\r\n\t'cd'\r\n]\r\nother = [\r\n'zz'\r\n]\r\n+++\r\nt\r\n{{< reader-demo id=1 >}}\r\np1\r\n \r\np2\r\n{{< /reader-demo >}}\r\nend"
    want = source.replace("'ab'", "'AB'").replace("'cd'", "'CD'").replace("p1", "P1").replace("p2", "P2")
    assert files.marked_copy(source, str.upper) == want
    for bad in (source.replace("p1\r\n \r\n", "p1\r\n"), source.replace("{{< /reader-demo >}}", ""), source.replace("'cd'", "'c'd'"), source.replace("lead", "led"), source.replace("+++\r\nt", "t")):
        with pytest.raises(ValueError):
            files.marked_copy(bad, str.upper)


def test_whole_tables_are_read(spark):
    assert {"request_rejections", "fragments_beyond_u_ffff", "clauses_with_private_use", "hidden_texts"} <= set(catalog.ORACLES)


def test_letter_gaps_as_columns_give_them(spark):
    from phraseloom.functions import numeric as N

    rows = spark.createDataFrame([(1, "甲乙丙丁戊己庚辛"), (2, "aaaaaaaaaa"), (3, "x"), (4, ""), (5, None), (6, "𠀀b𠀀bc" * 40), (7, "ab")], "id long, clause string")
    got = {r["id"]: (r["gaps"], r["best"] and round(r["best"], 9), r["at"]) for r in S.letter_gaps(rows, ["id"]).collect()}
    own = rows.where("length(clause) > 1").withColumn("s", S.letter_scores(F.col("clause")))
    want = {r["id"]: (r["n"], round(r["p"], 9), r["at"]) for r in own.select("id", F.size("s").alias("n"), F.array_max(N.gap_probabilities(F.col("s"))).alias("p"), N.best_gap(F.col("s")).alias("at")).collect()}
    assert {k: v for k, v in got.items() if k in want} == want and all(got[k] == (0, None, None) for k in (3, 4, 5))


def test_offsets_of_documents(spark):
    rows = spark.createDataFrame([("a，b。\n𠀀！1，000；",), ("",), ("，" * 50,)], "t string")
    from phraseloom.functions import text as T

    got = [r["o"] for r in rows.select(T.boundary_offsets(F.col("t")).alias("o")).collect()]
    assert got == [[1, 3, 4, 7, 13], [], list(range(50))]


def test_offsets_of_long_texts(spark):
    """The work must not grow with the square of a text's length: neither of one without a boundary, nor of one with boundaries only."""
    import time

    from phraseloom.functions import text as T

    long = 300_000
    rows = spark.createDataFrame([(1, "。" + "a" * long), (2, "，" * 100_000), (3, "𠀀1，000\u2028" * 2000), (4, None), (5, "1 " * 1000 + "，2\x85𠀀，\ue000，\x1e")], "id long, t string")
    began = time.monotonic()
    got = {r["id"]: r["o"] for r in rows.select("id", T.boundary_offsets(F.col("t")).alias("o")).collect()}
    assert time.monotonic() - began < 20
    assert got == {1: [0], 2: list(range(100_000)), 3: [8 * k + 7 for k in range(2000)], 4: None, 5: [2002, 2005, 2007, 2008]}
