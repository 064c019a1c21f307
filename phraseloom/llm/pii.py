"""Personal data by bootstrapped contextual extraction, with DataFrame operations only.

Base patterns find seeds: e-mail addresses, IP addresses, payment cards and phone numbers. The
one and two words before a seed are lexical patterns. Patterns and the identifier-like tokens
that follow them make a graph, on which scores go to and fro: a pattern's confidence is the
score of what follows it by the number of times that the corpus has the pattern at all, and a
token's score is that of its best pattern. Patterns need MIN_SEEDS different seeds. Tokens that
reach ACCEPT become spans of the kind that their pattern's seeds have most.

Null and empty texts have no spans. Repeated rows each get a row; rows with the same doc_id and
different texts are told apart by their texts. A found token that overlaps a base span is
dropped. Offsets are code points, ends exclusive. Texts of any length are read whole; the base
patterns are possessive where that changes nothing, so long runs cost no stack or square time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_INSIDE = r"[\p{L}\p{N}_.%+@#/()*-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A run of word characters that holds a digit or @
MENTION = rf"(?<!{_INSIDE})(?={_INSIDE}*?[0-9@]){_INSIDE}++"
#: The last two words of a text, and the space after them, in its reverse
TAIL = r"\A[\x20\n\t\r]*+[^\x20\n\t\r]*+(?:[\x20\n\t\r]++[^\x20\n\t\r]++)?"
ROUNDS = 3
MIN_SEEDS = 3
ACCEPT = 0.6
#: Patterns up to this number are broadcast; more are joined by a shuffle
BROADCAST_ROWS = 100_000


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    number = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(number, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255))
        .when(kind == "card", F.when(n.between(13, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `key`, which tells texts and doc_ids apart."""
    return docs.withColumn("key", F.concat_ws("_", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))))


def _parts(text: Column, pattern: str) -> Column:
    """Of each match: its number, the length of the text before it since the last match, the match, and two words before and after it."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tail = lambda x: F.reverse(F.regexp_extract(F.reverse(x), TAIL, 0))
    words = lambda x: F.split(F.trim(F.translate(F.lower(tail(x)), "\n\t\r", "   ")), " +")
    about = F.transform(pieces, lambda x: F.struct(F.length(x).alias("size"), words(x).alias("words")))
    at = lambda a, k: F.when(F.size(a) >= k, F.element_at(a, -k)).otherwise("")
    return F.transform(found, lambda m, i: F.struct(i.alias("i"), F.get(about, i)["size"].alias("before"), m.alias("value"), at(F.get(about, i)["words"], 1).alias("w1"), at(F.get(about, i)["words"], 2).alias("w2")))


def mentions(docs: DataFrame) -> DataFrame:
    """key, kind (`other` for tokens that no base pattern takes), value, start, end, w1, w2: each match of each pattern."""
    some = docs.where(F.col("text").rlike("[0-9@]")).select("key", "text")
    kinds = {**BASE, "other": MENTION}
    holds = {"email": F.col("text").contains("@"), "ip": F.col("text").contains("."), "phone": F.col("text").contains("+")}
    none = F.array().cast("array<struct<i:int,before:int,value:string,w1:string,w2:string>>")
    each = [F.struct(F.lit(k).alias("kind"), F.when(holds.get(k, F.lit(True)), _parts(F.col("text"), p)).otherwise(none).alias("parts")) for k, p in kinds.items()]
    rows = some.select("key", F.explode(F.array(*each)).alias("x")).select("key", "x.kind", F.explode("x.parts").alias("p")).select("key", "kind", "p.*").distinct()
    line = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.length("value")).over(line)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    # of a token, what lies between its outer letters, digits, plus and at signs
    core = F.regexp_extract("value", r"^([^\p{L}\p{N}+@]*+)(.*?)[^\p{L}\p{N}]*$", 2)
    lead = F.length(F.regexp_extract("value", r"^([^\p{L}\p{N}+@]*+)", 1))
    other = F.col("kind") == "other"
    rows = rows.withColumn("start", F.when(other, F.col("start") + lead).otherwise(F.col("start"))).withColumn("value", F.when(other, core).otherwise(F.col("value")))
    rows = rows.withColumn("end", F.col("start") + F.length("value"))
    return rows.where(F.when(other, F.length("value") >= 4).otherwise(valid(F.col("kind"), F.col("value")))).select("key", "kind", "value", F.col("start").cast("long"), F.col("end").cast("long"), "w1", "w2")


def unclaimed(found: DataFrame) -> DataFrame:
    """Mentions of kind `other` that overlap no base span: by the largest end before and the smallest start after."""
    base = F.col("kind") != "other"
    before = Window.partitionBy("key").orderBy("start", F.when(base, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("key").orderBy("start", F.when(base, 1).otherwise(0)).rowsBetween(0, Window.unboundedFollowing)
    rows = found.withColumn("reach", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(after))
    return rows.where((F.col("kind") == "other") & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))).drop("reach", "next")


def patterns_of(found: DataFrame) -> DataFrame:
    """Each mention with each of its patterns: the word before it, and the two words before it."""
    one = F.when(F.col("w1") != "", F.concat(F.lit("1 "), F.col("w1")))
    two = F.when((F.col("w1") != "") & (F.col("w2") != ""), F.concat(F.lit("2 "), F.col("w2"), F.lit(" "), F.col("w1")))
    return found.withColumn("pattern", F.explode(F.array_compact(F.array(one, two)))).drop("w1", "w2")


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and total: how often the corpus has the words of each pattern."""
    small = patterns.count() <= BROADCAST_ROWS
    side = F.broadcast(patterns) if small else patterns
    words = F.split(F.trim(F.translate(F.lower("text"), "\n\t\r", "   ")), " +")
    pairs = F.transform("words", lambda w, i: F.array(F.concat(F.lit("1 "), w), F.concat(F.lit("2 "), F.coalesce(F.get("words", i - 1), F.lit("")), F.lit(" "), w)))
    rows = docs.where("text is not null").select(words.alias("words")).select(F.explode(F.flatten(pairs)).alias("pattern"))
    return rows.join(side, "pattern").groupBy("pattern").agg(F.count("*").alias("total"))


def bootstrapped(docs: DataFrame, found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, accept: float = ACCEPT) -> DataFrame:
    """key, kind, start, end of the tokens that confident patterns find."""
    seeds = found.where("kind != 'other'").withColumn("seed", F.lit(1.0))
    rest = unclaimed(found).withColumn("seed", F.lit(0.0))
    graph = materialize(patterns_of(seeds.unionByName(rest)), "pii-graph")
    enough = graph.where("seed = 1").groupBy("pattern").agg(F.countDistinct("value").alias("n")).where(F.col("n") >= min_seeds).select("pattern")
    enough = materialize(enough, "pii-patterns")
    totals = materialize(occurrences(docs, enough), "pii-totals")
    edges = graph.join(totals, "pattern")
    # the patterns' meanings come from seeds and stay
    kinds = edges.where("seed = 1").groupBy("pattern", "kind").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.max_by("kind", F.struct("n", "kind")).alias("means"))
    edges = materialize(edges.join(kinds, "pattern").withColumn("score", F.col("seed")), "pii-edges")
    for k in range(rounds):
        confidence = edges.groupBy("pattern").agg((F.sum("score") / (F.max("total") + 1)).alias("confidence"))
        rated = edges.drop("score").join(confidence, "pattern")
        best = rated.where("seed = 0").groupBy("key", "start").agg(F.max(F.struct("confidence", "means")).alias("best"))
        sure = F.when(F.col("best.confidence") >= accept, F.col("best.confidence")).otherwise(0.0)
        score = F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce(sure, F.lit(0.0)))
        edges = materialize(rated.join(best, ["key", "start"], "left").withColumn("score", score).withColumn("finds", F.col("best.means")).drop("confidence", "best"), "pii-edges")
        if k + 1 < rounds:
            edges = edges.drop("finds")
    return edges.where((F.col("seed") == 0) & (F.col("score") > 0)).select("key", F.col("finds").alias("kind"), "start", "end").distinct()


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, base) by kind, then start; one row for each row of docs."""
    docs = keyed(docs.select("doc_id", "text"))
    found = materialize(mentions(docs), "pii-mentions")
    base = found.where("kind != 'other'").select("key", "kind", "start", "end", F.lit(True).alias("base"))
    added = bootstrapped(docs, found).withColumn("base", F.lit(False))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = F.array_sort(F.collect_list(F.struct(order.alias("rank"), "start", "end", "kind", "base")))
    spans = base.unionByName(added).groupBy("key").agg(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))).alias("spans"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    return docs.select("doc_id", "key").join(spans, "key", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
