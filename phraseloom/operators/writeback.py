"""Writing results back: validity of sources, markers, their removal, and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utf16_slices


def unprocessed(nodes: DataFrame, processed: DataFrame) -> DataFrame:
    """Texts that the registry (node_id, text, parent_id) does not hold as they are now."""
    keys = processed.select(F.col("node_id").alias("_n"), F.col("text").alias("_t"), F.col("parent_id").alias("_p")).distinct()
    return nodes.join(keys, (F.col("node_id") == F.col("_n")) & (F.col("text") == F.col("_t")) & F.col("parent_id").eqNullSafe(F.col("_p")), "left_anti")


def remembered(processed: DataFrame, written: DataFrame, forgotten: DataFrame) -> DataFrame:
    """The registry with written nodes as they are and without forgotten ones (node_id)."""
    gone = forgotten.select("node_id").union(written.select("node_id")).distinct()
    return processed.join(gone, "node_id", "left_anti").unionByName(written.select("node_id", "text", "parent_id"))


def with_results(snapshot: DataFrame, results: DataFrame) -> DataFrame:
    """Snapshot rows with the offsets of the same snapshot and idx; an error where a text has no result or several, or a result no text."""
    found = results.groupBy("snapshot_id", "idx").agg(F.count("*").alias("_n"), F.first("offsets").alias("offsets"))
    both = snapshot.withColumn("_text", F.lit(True)).join(found, ["snapshot_id", "idx"], "full")
    bad = F.raise_error(F.concat(F.lit("snapshot "), F.col("snapshot_id").cast("string"), F.lit(": as many results as texts are needed, one at idx "), F.col("idx").cast("string")))
    fits = F.when(F.col("_text").isNotNull() & (F.col("_n") == 1), F.lit(True)).otherwise(bad.cast("boolean"))
    return both.where(fits).select(*snapshot.columns, "offsets")


def current(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """Snapshot rows whose node still has the same parent and text in `live` (node_id, parent_id, text)."""
    now = live.select(F.col("node_id").alias("_n"), F.col("parent_id").alias("_p"), F.col("text").alias("_t"))
    return snapshot.join(now, (F.col("node_id") == F.col("_n")) & F.col("parent_id").eqNullSafe(F.col("_p")) & (F.col("text") == F.col("_t")), "left_semi")


def fragments(text: Column, offsets: Column) -> Column:
    """The parts that markers separate; UTF-16 offsets, as `segment` gives them, ascend within the text."""
    return F.when(F.size(offsets) > 0, utf16_slices(text, offsets)).otherwise(F.array(text))


def restored(sequence: Column) -> Column:
    """The text of a marked group without its markers."""
    return F.array_join(F.transform(sequence, lambda x: x["text"]), "")


def style_roots(marked: DataFrame) -> DataFrame:
    """The roots (root_id) that need the divider's style: those with a marker, once each."""
    return marked.where(F.size("fragments") > 1).select("root_id").distinct()


def touched(sequence: Column) -> Column:
    return F.exists(sequence, lambda x: x["dirty"] | x["moved"] | x["reinserted"])


def after_mutations(groups: DataFrame, mutations: DataFrame) -> DataFrame:
    """Groups with fragments marked dirty by any value change, moved by a removal, reinserted by an addition."""
    m = mutations.select(F.explode(F.flatten(F.array(
        F.when(F.col("type") == "characterData", F.array(F.struct(F.col("target").alias("node_id"), F.lit("dirty").alias("how")))).otherwise(F.array()),
        F.transform(F.coalesce("removed", F.array()), lambda n: F.struct(n.alias("node_id"), F.lit("moved").alias("how"))),
        F.transform(F.coalesce("added", F.array()), lambda n: F.struct(n.alias("node_id"), F.lit("reinserted").alias("how"))),
    ))).alias("x")).select("x.node_id", "x.how").groupBy("node_id").agg(F.collect_set("how").alias("hows"))
    parts = groups.select("group_id", F.posexplode("sequence").alias("pos", "s")).select("group_id", "pos", "s.*").join(m, "node_id", "left")
    has = lambda how: F.coalesce(F.array_contains("hows", how), F.lit(False))
    new = F.struct("pos", F.struct("node_id", "text", (F.col("dirty") | has("dirty")).alias("dirty"), (F.col("moved") | has("moved")).alias("moved"), (F.col("reinserted") | has("reinserted")).alias("reinserted")).alias("s"))
    back = parts.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(new)), lambda x: x["s"]).alias("sequence"))
    return groups.drop("sequence").join(back, "group_id")


def intact(sequence: Column, parent: Column, adjacent: Column) -> Column:
    """Whether a group is as it was written: no fragment touched, all in place with their values, markers between them."""
    return adjacent & F.forall(sequence, lambda x: ~x["dirty"] & ~x["moved"] & x["connected"] & x["parent"].eqNullSafe(parent) & x["value"].eqNullSafe(x["text"]))


def reconciled(sequence: Column, parent: Column, together: Column, rest_together: Column, left_together: Column, end_unchanged: Column) -> Column:
    """What becomes of a marked group that the page changed: (action, text, forgotten, preserved).

    `sequence` holds the anchor and the fragments derived from it: node_id, text as written,
    dirty, moved, reinserted, and value, parent and connected as they are now. The flags say
    whether all texts, those without the anchor, or those still in the parent stand side by
    side. Actions: `restore` puts the whole text on the anchor after fragments were pruned;
    `discard` drops fragments for a page that replaced or removed the anchor; `unwrite` joins
    untouched fragments; `unmark` takes only the markers away, where the page adopted texts.
    """
    anchor, derived = F.element_at(sequence, 1), F.slice(sequence, 2, F.greatest(F.size(sequence), F.lit(1)))
    here = lambda x: x["parent"].eqNullSafe(parent)
    same = lambda x: ~x["dirty"] & x["value"].eqNullSafe(x["text"])
    gone = lambda x: x["parent"].isNull()
    pruned = same(anchor) & ~anchor["moved"] & here(anchor) & F.exists(derived, gone)
    pruned = pruned & F.forall(derived, lambda x: same(x) & ~x["reinserted"] & (gone(x) | (~x["moved"] & here(x)))) & left_together & end_unchanged
    untouched = F.forall(derived, lambda x: same(x) & ~x["moved"] & here(x))
    settled = untouched & ~anchor["moved"] & here(anchor) & together
    ids, none = F.transform(sequence, lambda x: x["node_id"]), F.array().cast("array<bigint>")
    connected = F.transform(F.filter(sequence, lambda x: x["connected"]), lambda x: x["node_id"])
    row = lambda action, text, preserved: F.struct(F.lit(action).alias("action"), text.cast("string").alias("text"), ids.alias("forgotten"), preserved.alias("preserved"))
    return (
        F.when(pruned, row("restore", restored(sequence), F.when(anchor["connected"], F.array(anchor["node_id"])).otherwise(none)))
        .when(settled & ~same(anchor), row("discard", anchor["value"], none))
        .when(settled, row("unwrite", restored(sequence), none))
        .when(untouched & gone(anchor) & rest_together, row("discard", F.lit(None), none))
        .otherwise(row("unmark", F.lit(None), connected))
    )
