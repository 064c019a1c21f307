"""Registered queries and the SQL that gives the same rows.

Texts of the tables hold no Han letters, so queries about Chinese text run over the Han
projection, a letter-for-letter stand-in that both engines compute alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numeric as N
from .functions import text as T
from .operators import writeback
from .operators.chunker import Options, segment
from .operators.scorers import Letters, Network, Periodic, Uniform
from .plans import segmentation as S
from .sources import dom, files
from .sources.model import ModelFile, model_info
from .streaming import refresh

FLAGSHIP = "clause_stats_by_lang"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _projected():
    return T.han_projection(F.col("text"))

_E = "，。！？；…、\\n\\r\\x0B\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}"
_PROJ = f"translate(lower(text), '{T.PLAIN}', '{T.PROJECTED}')"
_CLAUSES = f"(SELECT doc_id, lang, unnest(regexp_extract_all({_PROJ}, '[^{_E}]*[{_E}]+|[^{_E}]+')) AS clause, unnest(range(len(regexp_extract_all({_PROJ}, '[^{_E}]*[{_E}]+|[^{_E}]+')))) AS i FROM documents)"
_NUM = r"\p{N}+(?:[.,]\p{N}+)?(?:[\t \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{feff}\n\x0B\f\r\x{2028}\x{2029}]+\p{N}+[/／]\p{N}+|[/／]\p{N}+)?"


def _units(x: str) -> str:
    return f"(len(regexp_extract_all({x}, '\\p{{Han}}')) + len(regexp_extract_all({x}, '{_NUM}')) + len(regexp_extract_all({x}, '[A-Za-zＡ-Ｚａ-ｚ]+')))"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query(f"SELECT lang, count(*) AS clauses, sum({_units('clause')})::BIGINT AS units, count(*) FILTER (WHERE {_units('clause')} >= 13) AS long_clauses FROM {_CLAUSES} GROUP BY lang")
def clause_stats_by_lang(spark, sf_dir):
    rows = S.clauses(_docs(spark, sf_dir), _projected(), ["lang"]).withColumn("units", T.visual_length(F.col("clause")))
    return rows.groupBy("lang").agg(F.count("*").alias("clauses"), F.sum("units").alias("units"), F.count(F.when(F.col("units") >= N.MIN_UNITS, 1)).alias("long_clauses"))


@query(f"SELECT doc_id, i, md5(clause) AS clause_md5, length(clause)::BIGINT AS n FROM {_CLAUSES}")
def clause_split(spark, sf_dir):
    return S.clauses(_docs(spark, sf_dir), _projected(), ["doc_id"]).select("doc_id", F.col("i").cast("long"), F.md5("clause").alias("clause_md5"), F.length("clause").cast("long").alias("n"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '[^{_E}]*[{_E}]+|[^{_E}]+'))::BIGINT AS clauses, {_units('text')}::BIGINT AS units FROM documents")
def visual_length_plain(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.split_clauses(F.col("text"))).cast("long").alias("clauses"), T.visual_length(F.col("text")).cast("long").alias("units"))


@query(f"SELECT doc_id, i, {_units('clause')}::BIGINT AS units FROM {_CLAUSES} WHERE {_units('clause')} >= 13")
def length_gate(spark, sf_dir):
    return S.gated(S.clauses(_docs(spark, sf_dir), _projected(), ["doc_id"])).select("doc_id", F.col("i").cast("long"), F.col("units").cast("long"))


@query(f"SELECT doc_id, i, (sum(length(clause)) OVER w - length(clause))::BIGINT AS start, (sum(length(clause)) OVER w)::BIGINT AS \"end\" FROM {_CLAUSES} WINDOW w AS (PARTITION BY doc_id ORDER BY i)")
def clause_offsets(spark, sf_dir):
    return S.clause_offsets(S.clauses(_docs(spark, sf_dir), _projected(), ["doc_id"]), "doc_id").select("doc_id", F.col("i").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"))


@query("SELECT doc_id, (length(text || '😀') + 1)::BIGINT AS units, contains(translate(text, 'e', '中'), '中') AS has_han FROM documents")
def utf16_lengths(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.utf16_length(F.concat("text", F.lit("😀"))).cast("long").alias("units"), T.contains_han(F.translate("text", "e", "中")).alias("has_han"))


@query(f"SELECT doc_id, len(list_filter(range(1, length(t) + 1), lambda k: regexp_matches(substring(t, k, 1), '[，。！？；…\\n\\r\\x0B\\f]')))::BIGINT AS n, coalesce(list_sum(list_filter(range(1, length(t) + 1), lambda k: regexp_matches(substring(t, k, 1), '[，。！？；…\\n\\r\\x0B\\f]'))) - len(list_filter(range(1, length(t) + 1), lambda k: regexp_matches(substring(t, k, 1), '[，。！？；…\\n\\r\\x0B\\f]'))), 0)::BIGINT AS total FROM (SELECT item_id AS doc_id, {_PROJ} AS t FROM benchmark)")
def boundary_offsets(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), T.boundary_offsets(_projected()).alias("at"))
    return rows.select("doc_id", F.size("at").cast("long").alias("n"), F.aggregate("at", F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


@query(f"SELECT item_id, len(list_filter(range(1, length(t)), lambda k: regexp_matches(substring(t, k, 1), '\\p{{Han}}') AND regexp_matches(substring(t, k + 1, 1), '\\p{{Han}}')))::BIGINT AS n FROM (SELECT item_id, {_PROJ} AS t FROM benchmark)")
def han_adjacency(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", F.size(T.adjacent_han(_projected())).cast("long").alias("n"))


_HANS = f"(SELECT doc_id, i, clause FROM {_CLAUSES.replace(_PROJ, f'replace({_PROJ}, chr(32), chr(0))'.replace('chr(0)', chr(39) * 2))} WHERE regexp_full_match(clause, '\\p{{Han}}{{13,}}[^\\p{{Han}}]?'))"
_LETTERS = "(SELECT doc_id, i, list_transform(range(1, length(clause)), lambda k: ((unicode(substring(clause, k, 1)) * 31 + unicode(substring(clause, k + 1, 1)) * 17) % 97) / 4.0) AS s FROM (SELECT doc_id, i, clause FROM {c}))"


def _long_clauses(spark, sf_dir, longest):
    rows = S.clauses(_docs(spark, sf_dir), _projected(), ["doc_id"]).where(F.length("clause").between(N.MIN_UNITS, longest))
    return rows.withColumn("scores", S.letter_scores(F.col("clause")))


def _best_gaps(rows):
    rows = rows.withColumn("p", N.gap_probabilities(F.col("scores")))
    return rows.select("doc_id", F.col("i").cast("long"), F.size("scores").cast("long").alias("gaps"), F.round(F.array_max("p"), 6).alias("best"), N.best_gap(F.col("scores")).cast("long").alias("at"))


def _gated_gaps(rows):
    rows = rows.withColumn("p", F.array_max(N.gap_probabilities(F.col("scores"))))
    return rows.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.count(F.when(F.col("p") > N.MIN_CONFIDENCE, 1)).alias("cut"))


_SCORED = _LETTERS.format(c=f"{_CLAUSES} WHERE length(clause) BETWEEN 13 AND 400")


@query(f"SELECT doc_id, i, len(s)::BIGINT AS gaps, round(list_max(list_transform(s, lambda x: exp(x - list_max(s)))) / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))), 6) AS best, (list_position(s, list_max(s)) - 1)::BIGINT AS at FROM {_SCORED}")
def gap_softmax_argmax(spark, sf_dir):
    """The part that its SQL states, clauses of 13 to 400 letters; `gap_softmax_argmax_whole` has all."""
    return _best_gaps(_long_clauses(spark, sf_dir, longest=400))


@query(f"SELECT doc_id, count(*) AS clauses, count(*) FILTER (WHERE p > 0.45) AS cut FROM (SELECT doc_id, 1 / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))) AS p FROM {_SCORED}) GROUP BY doc_id")
def gap_gate(spark, sf_dir):
    """The part that its SQL states, clauses of 13 to 400 letters; `gap_gate_whole` has all."""
    return _gated_gaps(_long_clauses(spark, sf_dir, longest=400))


def _whole_gaps(spark, sf_dir):
    rows = S.clauses(_docs(spark, sf_dir), _projected(), ["doc_id"]).where(F.length("clause") >= N.MIN_UNITS)
    return S.letter_gaps(rows.select("doc_id", F.col("i").cast("long").alias("i"), "clause"), ["doc_id", "i"])


@query()
def gap_softmax_argmax_whole(spark, sf_dir):
    """Clauses of 13 letters and more, of any length."""
    return _whole_gaps(spark, sf_dir).withColumn("best", F.round("best", 6))


@query()
def gap_gate_whole(spark, sf_dir):
    return _whole_gaps(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("clauses"), F.count(F.when(F.col("best") > N.MIN_CONFIDENCE, 1)).alias("cut"))


@query("SELECT doc_id, n, w.cursor::BIGINT AS cursor, least(n - 1, w.cursor + step)::BIGINT AS gap_end, greatest(0, w.cursor - 16)::BIGINT AS start, least(n, least(n - 1, w.cursor + step) + 17)::BIGINT AS \"end\" FROM (SELECT doc_id, n_chars AS n, CASE WHEN n_chars <= 256 THEN n_chars - 1 ELSE 223 END AS step, unnest(range(0, n_chars - 1, greatest(CASE WHEN n_chars <= 256 THEN n_chars - 1 ELSE 223 END, 1))) AS cursor FROM documents WHERE n_chars >= 2) w")
def model_windows(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.col("n_chars").alias("n"), F.explode(N.model_windows(F.col("n_chars").cast("int"), 16)).alias("w"))
    return rows.select("doc_id", "n", *(F.col(f"w.{k}").cast("long").alias(k) for k in ("cursor", "gap_end", "start", "end")))


@query(f"SELECT doc_id, count(*) AS clauses, sum(length(regexp_replace(clause, '[^\\p{{Han}}]', '', 'g')) - 12)::BIGINT AS cuts FROM {_HANS} GROUP BY doc_id")
def uniform_split(spark, sf_dir):
    """All gaps alike and no threshold: a cut after each letter while 13 units stay. By the chunker itself."""
    rows = S.clauses(_docs(spark, sf_dir), F.replace(_projected(), F.lit(" "), F.lit("")), ["doc_id"]).where(F.col("clause").rlike(rf"\A{T.HAN}{{13,}}[^{T.HAN}]?\z"))
    cut = segment(rows, Uniform(), text="clause", keep=["doc_id"], options=Options(min_confidence=0, strategy="fixed"))
    return cut.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.sum(F.size("offsets")).alias("cuts"))


def _segmented(spark, sf_dir, scorer, options, name="benchmark", key="item_id"):
    rows = segment(_table(spark, sf_dir, name).select(key, _projected().alias("text")), scorer, keep=[key], options=options)
    parts = F.transform("chunks", lambda c: c["text"])
    return rows.select(key, F.size("chunks").cast("long").alias("chunks"), F.size("offsets").cast("long").alias("cuts"), F.array_join(parts, "").alias("joined"), F.array_join(parts, T.DIVIDER).alias("marked"))


@query()
def chunks_recursive_softmax(spark, sf_dir):
    return _segmented(spark, sf_dir, Letters(), Options(strategy="recursive-softmax"), "documents", "doc_id")


@query()
def chunks_fixed(spark, sf_dir):
    return _segmented(spark, sf_dir, Letters(), Options(strategy="fixed"))


@query()
def chunks_recursive_model(spark, sf_dir):
    return _segmented(spark, sf_dir, Periodic(11), Options(strategy="recursive-model", min_confidence=0.05))


@query()
def chunks_network(spark, sf_dir):
    """The network's shape with seeded weights: what it cuts means nothing, how it runs does."""
    return _segmented(spark, sf_dir, Network(ModelFile.random(list(T.PROJECTED), 24, 2, seed=7)), Options(strategy="recursive-softmax", min_confidence=0.05))


@query()
def chunks_fixed_whole(spark, sf_dir):
    return _segmented(spark, sf_dir, Letters(), Options(strategy="fixed"), "documents", "doc_id")


@query()
def han_adjacency_whole(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.adjacent_han(_projected())).cast("long").alias("n"))


@query()
def boundary_offsets_whole(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", T.boundary_offsets(_projected()).alias("at"))
    return rows.select("doc_id", F.size("at").cast("long").alias("n"), F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT 'random-f32-v1' AS format, 'unicode-context-v1' AS input_representation, 32::INT AS vocabulary_size, 24::INT AS channels, 2::INT AS residual_blocks, 4::INT AS convolution_layers, (32 * 24 + 2 * (24 + 24 + 1 + 2 * (24 * 24 * 3 + 24)) + 24 * 96 + 24 + 24 + 1)::BIGINT AS parameters")
def network_info(spark, sf_dir):
    return model_info(spark, ModelFile.random(list(T.PROJECTED), 24, 2, seed=7))


@query(f"SELECT doc_id, count(*) AS tokens, sum(coalesce(v.id, 0))::BIGINT AS ids FROM (SELECT doc_id, unnest(string_split({_PROJ}, '')) AS token FROM (SELECT item_id AS doc_id, text FROM benchmark)) t LEFT JOIN (SELECT unnest(string_split('{T.PROJECTED}', '')) AS token, unnest(range(1, {len(T.PROJECTED) + 1})) AS id) v USING (token) GROUP BY doc_id")
def vocabulary_ids(spark, sf_dir):
    tokens = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.explode(F.split(_projected(), "")).alias("token"))
    vocabulary = spark.createDataFrame([(c, k + 1) for k, c in enumerate(T.PROJECTED)], "token string, id int")
    return tokens.join(vocabulary, "token", "left").groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum(F.coalesce("id", F.lit(0))).alias("ids"))


@query("SELECT page_id, regexp_matches(url, '^(https?|file):') AND NOT regexp_matches(lower(url), '^[a-z]+://([^/?#@]*@)?([^/?#:]*\\.)?(chrome|webstore)\\.google\\.com\\.?([/?#:]|$)') AS supported, host, regexp_matches(html, '(?is)<meta\\s[^>]*name\\s*=\\s*[\"'']?phraseloom[\"'']?[^>]*content\\s*=\\s*[\"'']?off[\"''\\s/>]') AS opted_out FROM (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN '<meta name=\"phraseloom\" content=\"off\">' || html ELSE html END AS html, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.$', '') AS host FROM (SELECT page_id, html, CASE WHEN page_id % 7 = 0 THEN 'https://A.Chrome.Google.com./x' ELSE url END AS url FROM pages))")
def page_eligibility(spark, sf_dir):
    """Addresses and opt-outs, with stores and opt-outs put among the pages."""
    pages = _table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 7 == 0, "https://A.Chrome.Google.com./x").otherwise(F.col("url"))
    html = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit('<meta name="phraseloom" content="off">'), "html")).otherwise(F.col("html"))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")
    return pages.select("page_id", dom.supports_url(url).alias("supported"), host.alias("host"), dom.opted_out(html).alias("opted_out"))


@query()
def page_texts(spark, sf_dir):
    """Document trees of the pages, and their readable texts."""
    return S.page_snapshot(_table(spark, sf_dir, "pages"), han_only=False)


@query()
def dom_scan(spark, sf_dir):
    nodes = dom.dom_nodes(_table(spark, sf_dir, "pages"))
    return nodes.groupBy("page_id").agg(F.count("*").alias("nodes"), F.sum((F.col("node_type") == 3).cast("int")).alias("texts"), F.max(F.size("path")).alias("depth"))


_RECT = "(event_id * 37 % 900)::DOUBLE AS l, (event_id * 91 % 700)::DOUBLE AS t, (event_id % 50)::DOUBLE AS w, (event_id % 30)::DOUBLE AS h"


@query(f"SELECT event_id, w > 0 AND h > 0 AND l + w > 100 AND l < 500 AND t + h > 50 AND t < 400 AS visible FROM (SELECT event_id, {_RECT} FROM events)")
def visible_rects(spark, sf_dir):
    """Rectangles from the events' numbers against one viewport."""
    e, d = F.col("event_id"), "double"
    left, top = (e * 37 % 900).cast(d), (e * 91 % 700).cast(d)
    rect = F.struct(left.alias("left"), top.alias("top"), (left + (e % 50)).alias("right"), (top + (e % 30)).alias("bottom"))
    area = F.struct(*(F.lit(x).alias(k) for k, x in (("left", 100.0), ("top", 50.0), ("right", 500.0), ("bottom", 400.0))))
    return _table(spark, sf_dir, "events").select("event_id", dom.visible(F.array(rect), area).alias("visible"))


@query(f"SELECT user_id, CASE WHEN r > l AND b > t THEN l END AS \"left\", CASE WHEN r > l AND b > t THEN t END AS top, CASE WHEN r > l AND b > t THEN r END AS \"right\", CASE WHEN r > l AND b > t THEN b END AS bottom FROM (SELECT user_id, greatest(0, max(l)) AS l, greatest(0, max(t)) AS t, least(1000, min(l + w * 40)) AS r, least(800, min(t + h * 40)) AS b FROM (SELECT user_id, {_RECT} FROM events) GROUP BY user_id)")
def clip_areas(spark, sf_dir):
    """Each user's events as a chain of clipping ancestors."""
    e, d = F.col("event_id"), "double"
    left, top = (e * 37 % 900).cast(d), (e * 91 % 700).cast(d)
    width, height = ((e % 50) * 40).cast(d), ((e % 30) * 40).cast(d)
    zero = F.lit(0.0)
    box = F.struct(left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height"), zero.alias("client_left"), zero.alias("client_top"), width.alias("client_width"), height.alias("client_height"), width.alias("offset_width"), height.alias("offset_height"))
    style = F.struct(F.lit("block").alias("display"), F.lit("hidden").alias("overflow_x"), F.lit("scroll").alias("overflow_y"))
    chains = _table(spark, sf_dir, "events").select(F.lit(0).alias("page_id"), F.col("user_id").alias("node_id"), dom.clip_of(style, box).alias("clip"))
    area = F.struct(*(F.lit(x).alias(k) for k, x in (("left", 0.0), ("top", 0.0), ("right", 1000.0), ("bottom", 800.0))))
    found = dom.visible_areas(chains, area)
    return found.select(F.col("node_id").alias("user_id"), *(F.col(f"area.{k}").alias(k) for k in ("left", "top", "right", "bottom")))


_SNAP = "SELECT conv_id AS snapshot_id, turn AS idx, conv_id * 1000 + turn AS node_id, conv_id AS parent_id, text FROM conversations"


def _snapshot(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("snapshot_id"), F.col("turn").alias("idx"), (F.col("conv_id") * 1000 + F.col("turn")).alias("node_id"), F.col("conv_id").alias("parent_id"), "text")


@query(f"SELECT node_id, parent_id, md5(text) AS text_md5 FROM ({_SNAP}) s WHERE NOT (idx % 3 = 0 AND length(text) % 2 = 0)")
def processed_skip(spark, sf_dir):
    """Texts that a registry does not hold as they are: of every third turn it holds the present or an older text."""
    nodes = _snapshot(spark, sf_dir)
    held = nodes.where(F.col("idx") % 3 == 0).select("node_id", F.when(F.length("text") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x"))).alias("text"), "parent_id")
    return writeback.unprocessed(nodes, held).select("node_id", "parent_id", F.md5("text").alias("text_md5"))


@query(f"SELECT snapshot_id, idx, node_id FROM ({_SNAP}) s WHERE node_id % 4 <> 1 AND node_id % 6 <> 2")
def stale_results_dropped(spark, sf_dir):
    """Snapshot rows whose node kept its text and parent."""
    nodes = _snapshot(spark, sf_dir)
    live = nodes.select("node_id", F.when(F.col("node_id") % 6 == 2, -1).otherwise(F.col("parent_id")).alias("parent_id"), F.when(F.col("node_id") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return writeback.current(nodes, live).select("snapshot_id", "idx", "node_id")


@query(f"SELECT snapshot_id, idx, node_id, (length(text) // 40)::BIGINT AS cuts, md5(text) AS restored_md5, substring(text, 1, CASE WHEN length(text) >= 40 THEN 40 ELSE length(text) END::INT) AS first FROM ({_SNAP}) s")
def markers_written_and_cleared(spark, sf_dir):
    """Results joined by position, texts cut every 40 letters, and the cuts undone."""
    nodes = _snapshot(spark, sf_dir)
    results = nodes.select("snapshot_id", "idx", F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 40).cast("int")), lambda k: k * 40).alias("offsets"))
    results = results.withColumn("offsets", F.slice("offsets", 2, F.greatest(F.size("offsets") - 1, F.lit(0))))
    rows = writeback.with_results(nodes, results).withColumn("parts", writeback.fragments(F.col("text"), F.col("offsets")))
    return rows.select("snapshot_id", "idx", "node_id", F.size("offsets").cast("long").alias("cuts"), F.md5(F.array_join("parts", "")).alias("restored_md5"), F.element_at("parts", 1).alias("first"))


_STATE = "SELECT event_id, event_id % 2 = 1 AS a_dirty, event_id % 3 = 1 AS f_moved, event_id % 5 = 1 AS f_gone, event_id % 7 <> 1 AS together, event_id % 11 <> 1 AS end_ok FROM events"


@query(f"SELECT event_id, CASE WHEN NOT a_dirty AND f_gone AND together AND end_ok THEN 'restore' WHEN NOT f_moved AND NOT f_gone AND together AND a_dirty THEN 'discard' WHEN NOT f_moved AND NOT f_gone AND together THEN 'unwrite' ELSE 'unmark' END AS action FROM ({_STATE}) s")
def reconciliation(spark, sf_dir):
    """A marked group of two texts for each event, changed by what its number says."""
    e = F.col("event_id")
    one = F.lit(1).cast("long")
    part = lambda node, dirty, moved, gone: F.struct(F.lit(node).cast("long").alias("node_id"), F.lit("t").alias("text"), dirty.alias("dirty"), moved.alias("moved"), F.lit(False).alias("reinserted"), F.lit("t").alias("value"), F.when(~gone, one).alias("parent"), (~gone).alias("connected"))
    no = F.lit(False)
    sequence = F.array(part(1, e % 2 == 1, no, no), part(2, no, e % 3 == 1, e % 5 == 1))
    together = e % 7 != 1
    return _table(spark, sf_dir, "events").select("event_id", writeback.reconciled(sequence, one, together, together, together, e % 11 != 1)["action"].alias("action"))


@query("SELECT user_id, min(us)::BIGINT AS first_us, (max(us) + 3600000000)::BIGINT AS due_us, count(*) AS changes FROM (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS run FROM (SELECT user_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 3600000000 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, epoch_us(ts) AS us FROM events))) GROUP BY user_id, run")
def debounce_sessions(spark, sf_dir):
    """Refreshes after an hour without events of a user, by the built-in session window."""
    rows = refresh.debounced(_table(spark, sf_dir, "events"), "user_id", "ts", "1 hour")
    return rows.select("user_id", refresh.micros(F.col("first")).alias("first_us"), refresh.micros(F.col("due")).alias("due_us"), "changes")


@query("SELECT user_id, min(us)::BIGINT AS first_us, (max(us) + 1800000000)::BIGINT AS due_us, count(*) AS changes FROM (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS run FROM (SELECT user_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, epoch_us(ts) AS us FROM events))) GROUP BY user_id, run")
def debounce_islands(spark, sf_dir):
    return refresh.debounced_batch(_table(spark, sf_dir, "events"), 1_800_000_000, "user_id")


_TASK = "greatest(f.due, f.busy)"


@query(f"""
WITH RECURSIVE r AS (SELECT page_id, at_ms, takes, row_number() OVER (PARTITION BY page_id ORDER BY at_ms, takes) AS k
  FROM (SELECT user_id AS page_id, epoch_us(ts) // 1000 AS at_ms, event_id % 5000000 AS takes FROM events)),
f AS (SELECT page_id, k, at_ms + 600000 AS due, 0::BIGINT AS busy, takes, NULL::BIGINT AS start_ms, NULL::BIGINT AS end_ms FROM r WHERE k = 1
  UNION ALL SELECT r.page_id, r.k, r.at_ms + 600000, CASE WHEN {_TASK} <= r.at_ms THEN {_TASK} + f.takes ELSE f.busy END, r.takes,
    CASE WHEN {_TASK} <= r.at_ms THEN {_TASK} END, CASE WHEN {_TASK} <= r.at_ms THEN {_TASK} + f.takes END FROM f JOIN r ON r.page_id = f.page_id AND r.k = f.k + 1)
SELECT page_id, start_ms, end_ms FROM f WHERE start_ms IS NOT NULL
UNION ALL SELECT page_id, {_TASK}, {_TASK} + takes FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k DESC) = 1
""")
def single_flight(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.floor(refresh.micros(F.col("ts")) / 1000).alias("at_ms"), (F.col("event_id") % 5_000_000).alias("takes_ms"))
    return refresh.flights(rows, 600_000)


@query("""
WITH RECURSIVE r AS (SELECT user_id AS page_id, event_id AS seq, event_id % 5 AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT page_id, 0::BIGINT AS k, NULL::BIGINT AS seq, false AS enabled, false AS busy, NULL::VARCHAR AS error, false AS told FROM (SELECT DISTINCT page_id FROM r)
  UNION ALL SELECT page_id, k, seq, CASE WHEN told AND op IN (0, 3, 4) THEN op = 0 ELSE enabled END, CASE WHEN told THEN op IN (0, 2) ELSE busy END,
    CASE WHEN NOT told OR op IN (1, 2) THEN error WHEN op = 3 THEN 'failed' END, told
  FROM (SELECT r.*, f.enabled, f.busy, f.error, CASE r.op WHEN 0 THEN NOT f.busy AND NOT f.enabled AND f.error IS NULL WHEN 2 THEN f.enabled AND NOT f.busy
    WHEN 4 THEN NOT f.busy AND (f.enabled OR f.error IS NOT NULL) ELSE f.busy END AS told FROM f JOIN r ON r.page_id = f.page_id AND r.k = f.k + 1))
SELECT page_id, seq, enabled, busy, error FROM f WHERE told
""")
def reader_states(spark, sf_dir):
    ops = F.array(*(F.lit(x) for x in ("on", "done", "task", "fail", "off")))
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("seq"), F.element_at(ops, (F.col("event_id") % 5 + 1).cast("int")).alias("op"), F.lit(None).cast("string").alias("value"))
    return refresh.reader_states(rows)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_wins(spark, sf_dir):
    return refresh.latest(_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT event_id FROM (SELECT event_id, w, h, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM (SELECT event_id, user_id, ts, event_id % 3 AS w, event_id % 2 AS h FROM events) WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE pw IS NOT NULL AND (pw <> w OR ph <> h)")
def size_changes(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 3).alias("width"), (F.col("event_id") % 2).alias("height"))
    return refresh.size_changes(rows, "user_id").select("event_id")


@query(f"SELECT doc_id, (doc_id % 7 = 0) OR (doc_id % 3 <> 0 AND regexp_matches({_PROJ}, '\\p{{Han}}') AND doc_id % 2 = 0) AS relevant FROM documents")
def mutation_relevance(spark, sf_dir):
    key = F.col("doc_id")
    old = F.when(key % 2 == 0, _projected()).otherwise(F.lit("1, 2"))
    return _docs(spark, sf_dir).select("doc_id", refresh.relevant(old, F.lit("3"), key % 3 == 0, F.lit(False), key % 7 == 0).alias("relevant"))


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'timeout' WHEN event_id % 9 > 5 THEN 'timeout' END AS error, (event_id % 4 <> 0 AND event_id % 9 <= 5) AS answered FROM events")
def request_timeouts(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    requests = e.select(F.col("event_id").alias("id"), F.col("ts").alias("sent"))
    responses = e.where(F.col("event_id") % 4 != 0).select(F.col("event_id").alias("id"), (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 9).cast("decimal(18,6)"))).alias("received"), F.array(F.array(F.lit(1))).alias("offsets"), F.lit(None).cast("string").alias("error"))
    found = refresh.answered(requests, responses)
    return found.select("id", "error", F.col("received").isNotNull().alias("answered"))


_SENT = "SELECT event_id AS id, user_id AS worker, epoch_us(ts) AS s, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) + (event_id % 7) * 1200000000 END AS r FROM events"


@query(f"WITH RECURSIVE a AS (SELECT *, r IS NOT NULL AND r <= s + 3600000000 AS ok FROM ({_SENT})), f AS (SELECT worker, min(s) + 3600000000 AS at FROM a WHERE NOT ok GROUP BY worker UNION ALL SELECT f.worker, min(a.s) + 3600000000 FROM f JOIN a ON a.worker = f.worker AND NOT a.ok AND a.s >= f.at GROUP BY f.worker), dead AS (SELECT DISTINCT a.id FROM a JOIN f ON a.worker = f.worker AND a.s < f.at AND CASE WHEN ok THEN r ELSE s + 3600000000 END > f.at) SELECT id, CASE WHEN id IN (SELECT id FROM dead) THEN 'rejected' WHEN NOT ok THEN 'timeout' END AS error FROM a")
def request_rejections(spark, sf_dir):
    """Each user a worker whose requests wait an hour: a timeout also rejects what is pending, and what is rejected fires no timeout."""
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("worker"), F.col("ts").alias("sent"))
    responses = e.where("id % 3 <> 0").select("id", F.timestamp_add("SECOND", F.col("id") % 7 * 1200, F.col("sent")).alias("received"), F.array(F.array(F.lit(1))).alias("offsets"), F.lit(None).cast("string").alias("error"))
    answers = refresh.answered(e, responses, "1 hour").join(e.select("id", "worker"), "id")
    return refresh.rejected_with(answers, "1 hour", "worker").select("id", "error")


@query("SELECT doc_id, substring(t, 1, 2) AS a, substring(t, 3, 3) AS b, substring(t, 6) AS c FROM (SELECT doc_id, '𠀀' || chr(57344) || text AS t FROM documents WHERE length(text) >= 5)")
def fragments_beyond_u_ffff(spark, sf_dir):
    """Texts cut at UTF-16 offsets behind a letter of two units and a private-use one."""
    rows = _docs(spark, sf_dir).where(F.length("text") >= 5).select("doc_id", F.concat(F.lit("𠀀\ue000"), "text").alias("t"))
    parts = rows.select("doc_id", writeback.fragments(F.col("t"), F.array(F.lit(3), F.lit(6))).alias("p"))
    return parts.select("doc_id", *(F.element_at("p", k + 1).alias(c) for k, c in enumerate("abc")))


@query("SELECT doc_id, ['价格' || chr(57344) || '1，000元，', substring(text, 1, 3)] AS clauses FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS text FROM documents) WHERE length(text) >= 3")
def clauses_with_private_use(spark, sf_dir):
    """A comma inside a number ends no clause, whatever else the text holds."""
    rows = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("t")).where(F.length("t") >= 3)
    return rows.select("doc_id", T.split_clauses(F.concat(F.lit("价格\ue0001，000元，"), F.substring("t", 1, 3))).alias("clauses"))


@query("SELECT page_id, unnest([0, 1, 2, 3])::INT AS idx, unnest(['shown', 'again', 'p' || page_id, 'last']) AS text FROM pages")
def hidden_texts(spark, sf_dir):
    """Pages put together of parts that show and parts that do not: visibility passes on until an element sets it anew."""
    html = F.concat(
        F.lit("<div>shown<p style='visibility: hidden'>no<b>no</b><i style='VISIBILITY:visible'>again</i></p><u style='visibility:collapse'>no</u>"), F.lit("<section hidden>no<em style='visibility:visible'>no</em></section><p>p"),
        F.col("page_id").cast("string"), F.lit("</p><code>no</code><a aria-hidden='true'>no</a><q contenteditable>no</q><s style='opacity: 0'>no</s>last</div>"),
    )
    return dom.page_texts(_table(spark, sf_dir, "pages").select("page_id", html.alias("html")), han_only=False).select("page_id", "idx", "text")


@query("SELECT 'd/' || doc_id AS key, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def release_manifest(spark, sf_dir):
    return files.manifest(_docs(spark, sf_dir).select(F.concat(F.lit("d/"), F.col("doc_id")).alias("key"), F.col("text").alias("content")))


_KEYS = "CASE page_id % 4 WHEN 0 THEN 'p/' || page_id || '.html' WHEN 1 THEN 'a.' || md5(url) || '.js' WHEN 2 THEN 'i' || page_id || '.png' ELSE CASE WHEN page_id = 3 THEN 'index.html' ELSE 't' || page_id || '.txt' END END"


@query(f"SELECT key, strlen(html)::BIGINT AS size, upper(md5(html)) AS etag, CASE WHEN key LIKE '%.html' THEN 'text/html; charset=utf-8' WHEN key LIKE '%.js' THEN 'text/javascript; charset=utf-8' WHEN key LIKE '%.png' THEN 'image/png' ELSE 'text/plain; charset=utf-8' END AS content_type, CASE WHEN key LIKE '%.html' THEN 'no-cache' WHEN regexp_matches(key, '\\.[a-f0-9]{{16,}}\\.(css|js)$') THEN 'public, max-age=31536000, immutable' ELSE 'public, max-age=3600' END AS cache, CASE WHEN key = 'index.html' THEN 2 WHEN key LIKE '%.html' THEN 1 ELSE 0 END::INT AS priority FROM (SELECT html, {_KEYS} AS key FROM pages)")
def deploy_plan(spark, sf_dir):
    k, text = F.col("page_id") % 4, lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    name = F.col("page_id").cast("string")
    key = F.when(k == 0, text("p/", name, ".html")).when(k == 1, text("a.", F.md5("url"), ".js")).when(k == 2, text("i", name, ".png")).when(F.col("page_id") == 3, "index.html").otherwise(text("t", name, ".txt"))
    return files.deploy_plan(_table(spark, sf_dir, "pages").select(key.alias("key"), F.col("html").alias("content")))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def timing_summary(spark, sf_dir):
    e = _table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '!' WHEN event_id % 2 = 0 THEN 'ON' ELSE '' END AS text, event_id % 3 = 0 AS denied, CASE WHEN event_id % 2 = 0 THEN 300.0 ELSE 1280.0 END AS \"right\" FROM events")
def projections(spark, sf_dir):
    """The toolbar's badge, refused pages, and the viewport."""
    e = F.col("event_id")
    message = F.when(e % 3 == 0, F.when(e % 2 == 0, "Blocked").otherwise("Cannot access contents of url")).otherwise("no connection")
    visual = F.when(e % 2 == 0, F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(300.0).alias("width"), F.lit(200.0).alias("height")))
    return _table(spark, sf_dir, "events").select("event_id", refresh.badge(e % 2 == 0, F.when(e % 5 == 0, "x"))["text"].alias("text"), dom.access_denied(message).alias("denied"), dom.viewport(visual, F.lit(1280), F.lit(800))["right"].alias("right"))


@query(f"SELECT item_id, replace(m, '｜', '<span class=\"divider\" aria-hidden=\"true\"></span>') AS html FROM (SELECT item_id, CASE WHEN length(text) > 20 THEN substring(text, 1, 7) || '｜' || substring(text, 8, 13) || '｜' || substring(text, 21) ELSE text END AS m FROM (SELECT item_id, {_PROJ} AS text FROM benchmark))")
def marked_html(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select("item_id", _projected().alias("t"))
    marked = F.when(F.length("t") > 20, T.joined_at(F.col("t"), F.array(F.lit(7), F.lit(20)))).otherwise(F.col("t"))
    return rows.select("item_id", T.divider_spans(marked).alias("html"))


@query("SELECT 'e' || (event_id % 97) AS key FROM events WHERE event_id % 97 >= 90 GROUP BY 1")
def missing_references(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    key = F.concat(F.lit("e"), F.col("event_id") % 97)
    return files.references_missing(e.select(key.alias("key")), e.where(F.col("event_id") % 97 < 90).select(key.alias("key")))
