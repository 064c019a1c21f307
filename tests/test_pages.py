import pytest
from pyspark.sql import functions as F

from phraseloom.operators import writeback as W
from phraseloom.sources import dom, files
from phraseloom.streaming import refresh as R


def test_texts_of_a_page(spark):
    html = "<html><body><p>一<b>二</b><p hidden>三<div aria-hidden='true'>四</div><pre>五</pre><div contenteditable>六</div><div contenteditable='false'>七</div><span style='display: none'>八</span><ul><li>九<li>十</ul><i style='opacity:0.5'>百</i><script>千</script>latin</body></html>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    rows = dom.readable_texts(dom.dom_nodes(pages)).orderBy("idx").collect()
    assert [r["text"] for r in rows] == list("一二七九十百")
    assert [r["idx"] for r in rows] == list(range(6)) and all(r["start"] == 0 and r["end"] == 1 for r in rows)


@pytest.mark.parametrize(
    ("url", "ok"),
    [("https://a.example/", True), ("http://chrome.google.com.evil.example/", True), ("https://Chrome.Google.com./x", False), ("https://sub.webstore.google.com/", False), ("chrome://x", False), ("file:///a", True), (None, False), ("https://notchrome.google.com.example", True)],
)
def test_addresses(spark, url, ok):
    assert spark.createDataFrame([(url,)], "u string").select(dom.supports_url(F.col("u"))).first()[0] is ok


def test_opt_out(spark):
    rows = ['<meta name="reader" content="off">', '<META content="x" name=reader  content=off>', '<meta name="reader" content="on">', None]
    got = spark.createDataFrame([(r,) for r in rows], "h string").select(dom.opted_out(F.col("h"), "reader")).collect()
    assert [r[0] for r in got] == [True, True, False, False]


def test_clipping(spark):
    box = "struct<left:double,top:double,width:double,height:double,client_left:double,client_top:double,client_width:double,client_height:double,offset_width:double,offset_height:double>"
    style = "struct<display:string,overflow_x:string,overflow_y:string>"
    rows = [(1, 1, ("block", "hidden", "scroll"), (10.0, 20.0, 100.0, 80.0, 2.0, 3.0, 40.0, 30.0, 50.0, 40.0)), (1, 1, ("inline", "hidden", "hidden"), (0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)), (1, 2, ("block", "clip", "visible"), (500.0, 0.0, 10.0, 10.0, 0.0, 0.0, 10.0, 10.0, 10.0, 10.0))]
    df = spark.createDataFrame(rows, f"page_id long, node_id long, style {style}, box {box}").select("page_id", "node_id", dom.clip_of(F.col("style"), F.col("box")).alias("clip"))
    area = F.struct(*(F.lit(v).alias(k) for k, v in (("left", 0.0), ("top", 0.0), ("right", 300.0), ("bottom", 300.0))))
    got = {r["node_id"]: r["area"] for r in dom.visible_areas(df, area).collect()}
    assert tuple(got[1]) == (14.0, 26.0, 94.0, 86.0) and got[2] is None


def test_registry_and_validity(spark):
    nodes = spark.createDataFrame([(1, "a", 9), (2, "b", 9), (3, "c", None)], "node_id long, text string, parent_id long")
    held = spark.createDataFrame([(1, "a", 9), (2, "x", 9), (3, "c", None)], "node_id long, text string, parent_id long")
    assert [r[0] for r in W.unprocessed(nodes, held).collect()] == [2]
    assert sorted(r[0] for r in W.current(nodes, held).collect()) == [1, 3]
    after = W.remembered(held, nodes.where("node_id = 2"), nodes.where("node_id = 1").select("node_id"))
    assert sorted((r["node_id"], r["text"]) for r in after.collect()) == [(2, "b"), (3, "c")]


def test_results_must_match(spark):
    snap = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "snapshot_id long, idx int, text string")
    good = spark.createDataFrame([(1, 0, [1]), (1, 1, [])], "snapshot_id long, idx int, offsets array<int>")
    assert W.with_results(snap, good).count() == 2
    with pytest.raises(Exception, match="as many results"):
        W.with_results(snap, good.limit(1)).collect()


def test_reconciliation(spark):
    kind = "array<struct<node_id:long,text:string,dirty:boolean,moved:boolean,reinserted:boolean,value:string,parent:long,connected:boolean>>"
    ok = lambda n, **k: tuple(({"node_id": n, "text": f"t{n}", "dirty": False, "moved": False, "reinserted": False, "value": f"t{n}", "parent": 7, "connected": True} | k).values())
    gone = {"parent": None, "connected": False, "moved": True}
    cases = [
        ([ok(1), ok(2, **gone)], "restore", "t1t2", [1]),
        ([ok(1, dirty=True, value="new"), ok(2)], "discard", "new", []),
        ([ok(1), ok(2)], "unwrite", "t1t2", []),
        ([ok(1, **gone), ok(2)], "discard", None, []),
        ([ok(1), ok(2, dirty=True)], "unmark", None, [1, 2]),
        ([ok(1), ok(2, reinserted=True, moved=True)], "unmark", None, [1, 2]),
        ([ok(1, dirty=True), ok(2, **gone)], "unmark", None, [1]),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], f"k int, s {kind}")
    yes = F.lit(True)
    for r in df.select("k", W.reconciled(F.col("s"), F.lit(7), yes, yes, yes, yes).alias("x")).collect():
        assert (r["x"]["action"], r["x"]["text"], r["x"]["preserved"]) == cases[r["k"]][1:], r["k"]
        assert r["x"]["forgotten"] == [1, 2]


def test_mutations_mark_fragments(spark):
    groups = spark.createDataFrame([(1, 7, None, [(1, "a", False, False, False), (2, "b", False, False, False)])], "group_id long, parent_id long, next_sibling long, sequence array<struct<node_id:long,text:string,dirty:boolean,moved:boolean,reinserted:boolean>>")
    m = spark.createDataFrame([("characterData", 1, None, None), ("childList", 7, [2], [2])], "type string, target long, added array<long>, removed array<long>")
    seq = W.after_mutations(groups, m).first()["sequence"]
    assert [tuple(x) for x in seq] == [(1, "a", True, False, False), (2, "b", False, True, True)]


def test_single_flight():
    assert R.single_flight([(0, 50), (100, 50)]) == [(300, 350)]
    assert R.single_flight([(0, 1000), (300, 10), (400, 10)]) == [(200, 1200), (1200, 1210)]
    assert R.single_flight([(0, 10), (200, 10)]) == [(200, 210), (400, 410)]
    assert R.single_flight([]) == []


def test_reader_steps():
    state = (False, False, None)
    trace = []
    for op in ("on", "on", "off", "fail", "on", "off", "on", "done", "task", "done", "off"):
        state, told = R.step(state, op)
        trace.append((state, told))
    assert trace[1][1] is False and trace[2][1] is False  # busy
    assert trace[3][0] == (False, False, "failed") and trace[4][1] is False
    assert trace[5][0] == (False, False, None) and trace[6][0] == (True, True, None)
    assert trace[-1][0] == (False, False, None)


def test_states_in_a_stream_equal_batch(spark, tmp_path):
    rows = [(p, s, op, None) for p in (1, 2) for s, op in enumerate(["on", "done", "task", "fail", "on", "off", "on"])]
    df = spark.createDataFrame(rows, "page_id long, seq long, op string, value string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = R.reader_states_stream(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert key(spark.table("states")) == key(R.reader_states(df))


def test_requests(spark):
    requests = spark.sql("SELECT id, timestamp_seconds(id) AS sent FROM range(1, 4)")
    responses = spark.sql("SELECT 1L AS id, timestamp_seconds(3) AS received, array(array(1)) AS offsets, CAST(NULL AS string) AS error UNION ALL SELECT 3L, timestamp_seconds(8), array(array(2)), NULL UNION ALL SELECT 9L, timestamp_seconds(3), NULL, NULL")
    got = R.answered(requests, responses)
    assert {r["id"]: r["error"] for r in got.collect()} == {1: None, 2: "timeout", 3: None}
    assert {r["id"]: r["error"] for r in R.rejected_with(got).collect()} == {1: None, 2: "timeout", 3: "rejected"}


def test_run_once(spark):
    df = spark.range(2)
    calls = []
    assert R.run_once(lambda: df, lambda d: d, lambda d: d, calls.append, lambda: calls.append("clear")) is None
    assert R.run_once(lambda: df.limit(0), lambda d: 1 / 0, None, None, None) is None
    assert "zero" in R.run_once(lambda: df, lambda d: 1 / 0, None, None, lambda: calls.append("clear"))
    assert calls[-1] == "clear"


def test_release_files(spark, tmp_path):
    for name, content in (("index.html", b"x"), ("a.0123456789abcdef.js", b"yy"), ("b.css", b"z")):
        (tmp_path / name).write_bytes(content)
    found = files.checked(files.scan(spark, str(tmp_path)))
    plan = files.deploy_plan(found).orderBy("priority", "key").collect()
    assert [r["key"] for r in plan] == ["a.0123456789abcdef.js", "b.css", "index.html"]
    assert plan[0]["cache"].endswith("immutable") and plan[2]["cache"] == "no-cache" and plan[2]["etag"] == "9DD4E461268C8034F5C8564E155C67A6"
    assert tuple(files.totals(files.manifest(found)).first()) == (3, 4)
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path), ["none.js"])
    (tmp_path / "c.exe").write_bytes(b"x")
    with pytest.raises(Exception, match="unexpected file"):
        files.checked(files.scan(spark, str(tmp_path))).collect()


def test_marked_copy():
    source = "+++\nlead = [\n  'ab',\n]\n+++\nx\n{{< reader-demo >}}\np1\n\np2\n{{< /reader-demo >}}\n"
    assert files.marked_copy(source, str.upper) == source.replace("'ab'", "'AB'").replace("p1", "P1").replace("p2", "P2")
    for bad in ("x", source.replace("'ab'", '"ab"'), source.replace("p1", "<b>"), source.replace("reader-demo >}}\np1", "reader-demo }}\np1")):
        with pytest.raises(ValueError):
            files.marked_copy(bad, str.upper)


def test_messages_and_release_checks(spark):
    m = spark.createDataFrame([("me", 0, "ping"), ("me", 1, "ping"), ("x", 0, "ping"), ("me", None, "toggle"), ("me", 0, "other")], "sender_id string, frame_id int, type string")
    assert sorted(r["type"] for r in R.accepted(m, "me").collect()) == ["ping", "toggle"]
    urls = {"https://real.site/": True, "http://real.site/": False, "https://example.com/": False, None: False}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", files.release_url(F.col("u")).alias("ok")).collect()
    assert {r["u"]: r["ok"] for r in got} == urls
    page = '<meta name="phraseloom" content="off">'
    df = spark.createDataFrame([("a", page)], "key string, html string")
    assert files.checked_pages(df, dom.opted_out(F.col("html"))).count() == 1
    with pytest.raises(Exception, match="not fit"):
        files.checked_pages(spark.createDataFrame([("b", "x")], "key string, html string"), dom.opted_out(F.col("html"))).collect()


def test_debounced_stream_and_registry(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_millis(t) AS ts, 1L AS page_id, CAST(t % 3 AS long) AS node_id, 'a' AS text, 9L AS parent_id FROM VALUES (0), (100), (300), (10000), (900000) AS v(t)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert [r["changes"] for r in sorted(drain(R.debounced(stream().withWatermark("ts", "1 second")), "quiet"), key=lambda r: r["first"])] == [2, 1, 1]
    assert sorted(r["changes"] for r in R.debounced(rows).collect()) == [1, 1, 1, 2]
    assert len(drain(R.newly_seen(stream(), "1 day"), "seen")) == 2


SHADOW = """<div id=h><template shadowrootmode="open"><b>甲</b><p aria-hidden=true><slot name=a></slot></p><i style="visibility:hidden"><slot></slot></i><template>乙</template></template>
<u slot=a>丙</u>丁<u>戊</u><u style="visibility:visible">己</u><u slot=none>庚</u></div><template><p>辛</template>壬<br>癸<!-- c -->子<em><template shadowrootmode=closed>丑</template>寅</em>"""


def test_shadow_roots_and_slots(spark):
    pages = spark.createDataFrame([(1, SHADOW), (2, "卯<br>辰"), (3, None)], "page_id long, html string")
    nodes = dom.dom_nodes(pages).cache()
    seen = {r["value"].strip(): r for r in nodes.where("node_type = 3").collect()}
    # inert templates and closed roots are no part of the page
    assert set(seen) - {""} == set("甲丙丁戊己庚壬癸子寅卯辰")
    roots = dom.shadow_roots(nodes).collect()
    assert [(r["page_id"], r["host_id"]) for r in roots] == [(1, 1)]
    # the root hands on to its host; children of the host are drawn in slots, by name or the unnamed one
    slots = {r["attrs"].get("name", ""): r["node_id"] for r in nodes.where("tag = 'slot'").collect()}
    drawn = {r["node_id"]: r["p"] for r in nodes.where("page_id = 1").select("node_id", dom.drawn_parent(nodes).alias("p")).collect()}
    assert drawn[roots[0]["root_id"]] == 1 and drawn[seen["丁"]["node_id"]] == slots[""] and drawn[seen["丙"]["parent_id"]] == slots["a"]
    assert drawn[seen["庚"]["parent_id"]] == 1 and roots[0]["root_id"] in seen["丙"]["path"] and seen["丙"]["path"][0] == 1
    # 丙 lies in a left-out part of the root, 丁 and 戊 in a hidden one; 己 sets its own visibility
    for rows in (dom.readable_texts(nodes), dom.page_texts(pages)):
        assert [r["text"].strip() for r in rows.orderBy("page_id", "idx").collect()] == list("甲己庚壬癸子寅卯辰")
    key = ["page_id", "idx", "node_id", "parent_id", "text"]
    assert sorted(map(tuple, dom.page_texts(pages).select(key).collect())) == sorted(map(tuple, dom.readable_texts(nodes).select(key).collect()))


def test_observed_roots(spark):
    kind = "page_id long, root_id long"
    held, present = spark.createDataFrame([(1, 2), (1, 3), (1, 3)], kind), spark.createDataFrame([(1, 3), (1, 4), (2, 2)], kind)
    assert sorted(map(tuple, R.observed_roots(held, present).collect())) == [(1, 2, "drop"), (1, 3, "keep"), (1, 4, "observe"), (2, 2, "observe")]
    assert R.observed_roots(held.limit(0), present.limit(0)).count() == 0
