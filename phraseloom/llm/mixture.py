"""Mixing sources to target weights, with DataFrame operations only.

Each source's words are laid out in one line, documents by a hash of doc_id, and packed into
blocks of a fixed number of words: BLOCK, in sources of fewer than 64 such blocks less, so that
there a block is no large part of the target. The mix is a row of slots in shards of a fixed size. Each
shard draws how many of its slots each source gets (a multinomial: every slot draws a uniform
number); draws beyond a source's quota go to the sources that fall short, in order. A source's
k-th slot reads the block that a pseudorandom permutation of its block numbers gives for k; a
second pass through the blocks uses another permutation. Blocks are joined to documents by
source and block number.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share 1.5 times all
words; none gets more than twice its words, and what is cut off goes to the others by weight.
Null and empty texts have size 0 and take nothing. Null doc_ids sort first. Rows that are the
same take the same share or differ by a block. All choices are hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 64
SHARD = 4096
SHARE, MOST = 1.5, 2.0
WEIGHTS = (3, 1, 2)
ROUNDS = 16
#: Rows of a source that one salt holds, on average
SALT_ROWS = 4096
#: Slots that one task permutes; a number of partitions is stated, as small rows would be put into one
SLOTS = 1 << 16


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target of a table with source and size; a row for each source.

    Sources fill in order of the ratio of their limit to their weight: those before the point
    where the rest's level falls below the ratio stop at their limits.
    """
    every = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    every = every.withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    done, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = every.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * SHARE)
    every = every.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(done), F.lit(0.0))) / F.sum("weight").over(rest))
    every = every.withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    return every.select("source", "source_size", "n_rows", "weight", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("weight") * level)).alias("target"))


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 ... n - 1 for each key: rounds of swap-or-not.

    Each round pairs x with K - x modulo n and swaps the pair if a hash of its larger member
    says so, which permutes any range.
    """

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, other)) < 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swap)


def laid_out(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sizes with `begin`, the number of a source's words before each row.

    Rows are dealt to salts, so that no task holds a whole source: a row's place is the sum of
    the salts before its own and of the rows before it in its salt.
    """
    small = sources.select(F.col("source").alias("_source"), "source_size", "target", "source_no", "n_blocks", "length", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / SALT_ROWS)).alias("n_salts"))
    rows = sizes.join(small, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    order = F.xxhash64(F.lit(7), F.col("doc_id"))
    rows = rows.withColumn("_order", order).withColumn("_salt", F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.col("n_salts")))
    salts = rows.groupBy("source_no", "_salt").agg(F.sum("size").alias("_words"))
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("source_no").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    salts = salts.select(F.col("source_no").alias("_no"), F.col("_salt").alias("_s"), before.alias("_before"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source_no", "_salt").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_inside", inside).join(salts, (F.col("source_no") == F.col("_no")) & (F.col("_salt") == F.col("_s")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "source_no", "n_blocks", "length", (F.col("_before") + F.col("_inside")).alias("begin"))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target and taken, a row for each row of docs."""
    spark = docs.sparkSession
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sources = targets(sizes).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / 64))).cast("long")
    sources = sources.withColumn("length", length)
    n_blocks = F.ceil(F.col("source_size") / F.col("length"))
    quota = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.round(F.col("target") / F.col("source_size") * n_blocks)).cast("long")
    sources = materialize(sources.withColumn("n_blocks", n_blocks.cast("long")).withColumn("quota", quota), "mix-sources")
    slots = int(sources.agg(F.sum("quota")).first()[0] or 0)

    # a slot draws a place on the line of all quotas; its source is the one whose part holds the place.
    # The line is cut into cells, on which slots and parts meet.
    part = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    n_sources = sources.count()
    cell = max(1, slots // max(4096, 4 * n_sources))
    line = sources.where("quota > 0").withColumn("low", F.coalesce(F.sum("quota").over(part), F.lit(0))).withColumn("high", F.col("low") + F.col("quota"))
    line = line.select("source_no", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))).alias("cell"))
    draws = spark.range(slots).select(F.floor(F.col("id") / shard).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(slots, 1))).alias("place"))
    drawn = draws.withColumn("cell", F.floor(F.col("place") / cell)).join(line, "cell").where("place >= low and place < high").select("shard", "source_no")

    # each shard's counts, and the place of its first slot among the source's slots
    counts = drawn.groupBy("shard", "source_no").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("_part", F.floor(F.col("shard") / 1024))
    parts = ahead.groupBy("source_no", "_part").agg(F.sum("n").alias("_sum"))
    parts = parts.select(F.col("source_no").alias("_no"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(Window.partitionBy("source_no").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_far"))
    near = F.coalesce(F.sum("n").over(Window.partitionBy("source_no", "_part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = ahead.withColumn("_near", near).join(parts, (F.col("source_no") == F.col("_no")) & (F.col("_part") == F.col("_p")))
    counts = materialize(ahead.select("shard", "source_no", "n", (F.col("_far") + F.col("_near")).alias("at")), "mix-draws")

    # within quota: slots at ... at + n - 1 of the source; beyond: the same number of slots of sources that fall short
    drawn_all = counts.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    fixed = sources.join(drawn_all, "source_no", "left").select("source_no", "n_blocks", "quota", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    inside = counts.join(fixed, "source_no").select("source_no", "n_blocks", F.col("at").alias("low"), F.least(F.col("at") + F.col("n"), F.col("quota")).alias("high")).where("high > low")
    # as many slots are overdrawn in all as fall short in all, so the short ones take their last places
    short = fixed.where("quota > drawn").select("source_no", "n_blocks", F.explode(F.sequence(F.col("drawn"), F.col("quota") - 1, F.lit(shard))).alias("low"), "quota").select("source_no", "n_blocks", "low", F.least(F.col("low") + shard, F.col("quota")).alias("high"))
    taken = inside.union(short).repartition(max(1, slots // SLOTS), "source_no", "low").select("source_no", "n_blocks", F.explode(F.sequence("low", F.col("high") - 1)).alias("k"))
    chosen = permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), F.xxhash64(F.lit(seed), "source_no", F.floor(F.col("k") / F.col("n_blocks"))))
    uses = taken.select("source_no", chosen.alias("block")).groupBy("source_no", "block").agg(F.count("*").alias("uses"))

    rows = materialize(laid_out(sizes, sources), "mix-rows")
    last = F.floor((F.col("begin") + F.col("size") - 1) / F.col("length"))
    parts = rows.where("size > 0").select("source_no", "begin", "size", "length", F.explode(F.sequence(F.floor(F.col("begin") / F.col("length")), last)).alias("block"))
    overlap = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * F.col("length")) - F.greatest("begin", F.col("block") * F.col("length"))
    parts = parts.select("source_no", "begin", "block", overlap.alias("words"))
    got = parts.join(uses, ["source_no", "block"]).groupBy("source_no", "begin").agg(F.sum(F.col("words") * F.col("uses")).alias("got"))
    got = got.select(F.col("source_no").alias("_no"), F.col("begin").alias("_begin"), "got")
    joined = rows.join(got, (F.col("source_no") == F.col("_no")) & (F.col("begin") == F.col("_begin")) & (F.col("size") > 0), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))
