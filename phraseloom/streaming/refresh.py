"""Incremental refresh: debouncing, single flight, the reader's states, requests and changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import contains_han

#: 200 ms less a microsecond: a change at the very end of the wait starts another one.
QUIET = "199999 microseconds"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, as its clock shows."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def debounced(changes: DataFrame, key: str = "page_id", ts: str = "ts", gap: str = QUIET) -> DataFrame:
    """One refresh for each quiet end of a run of changes; batch, or streaming with a watermark on ts."""
    return changes.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("changes")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("due"), "changes")


def debounced_batch(changes: DataFrame, gap_us: int, key: str = "page_id", ts: str = "ts") -> DataFrame:
    """The same for whole microseconds, by islands; equal for finite tables."""
    w = Window.partitionBy(key).orderBy("us")
    rows = changes.select(key, micros(F.col(ts)).alias("us"))
    new = F.when(F.col("us") - F.lag("us").over(w) <= gap_us, 0).otherwise(1)
    rows = rows.withColumn("run", F.sum(new).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "run").agg(F.min("us").alias("first_us"), (F.max("us") + gap_us).alias("due_us"), F.count("*").alias("changes")).drop("run")


def size_changes(sizes: DataFrame, key: str = "page_id", ts: str = "ts") -> DataFrame:
    """Size reports that differ from the one before; the first report is none."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    before = F.lag(F.struct("width", "height")).over(w)
    return sizes.withColumn("_before", before).where(F.col("_before").isNotNull() & (F.col("_before") != F.struct("width", "height"))).drop("_before")


def latest(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Of each key's events the last one only."""
    cols = [c for c in events.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(ts, tie))
    return events.groupBy(key).agg(best.alias("x")).select(key, "x.*")


def relevant(old: Column, new: Column, ignored: Column, han_nodes: Column, group_changed: Column) -> Column:
    """Whether a mutation may call for a refresh: outside left-out parts and about Han text, or a marked group changed."""
    text = contains_han(F.coalesce(old, F.lit(""))) | contains_han(F.coalesce(new, F.lit("")))
    return group_changed | (~ignored & (text | han_nodes))


def observed_roots(held: DataFrame, present: DataFrame) -> DataFrame:
    """What to do about shadow roots (page_id, root_id): observe the new ones once, drop those that left their page, keep the rest."""
    key = ["page_id", "root_id"]
    was, now = held.select(key).distinct().withColumn("_was", F.lit(True)), present.select(key).distinct().withColumn("_now", F.lit(True))
    action = F.when(F.col("_was").isNull(), "observe").when(F.col("_now").isNull(), "drop").otherwise("keep")
    return was.join(now, key, "full").select(*key, action.alias("action"))


def foreign(mutations: DataFrame) -> DataFrame:
    """Mutations that the engine's own writes did not make."""
    return mutations.where(F.col("origin").isNull() | (F.col("origin") != "engine"))


def single_flight(requests: list[tuple[int, int | None]], wait: int = 200) -> list[tuple[int, int]]:
    """(start, end) of the tasks that a page runs: requests are (time, duration of the next task), by time.

    A request restarts the wait. A task starts when the wait is over and no task runs; requests
    during a task wait for both. A duration of None switches the page off: what waits is dropped,
    a task that runs goes on. At the end of the requests what waits runs, as at a shutdown that
    flushes.
    """
    tasks: list[tuple[int, int]] = []
    due, busy, duration = None, 0, 0

    def settle(now: float) -> None:
        nonlocal due, busy
        if due is not None and max(due, busy) <= now:
            start = max(due, busy)
            tasks.append((start, start + duration))
            due, busy = None, start + duration

    for at, takes in requests:
        settle(at)
        due, duration = (None, 0) if takes is None else (at + wait, takes)
    settle(float("inf"))
    return tasks


def flights(requests: DataFrame, wait_ms: int = 200) -> DataFrame:
    """Tasks of each page from (page_id, at_ms, takes_ms): start_ms and end_ms; a null takes_ms switches off. A page's requests are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["at_ms", "takes_ms"], na_position="last")
        takes = [None if pd.isna(x) else int(x) for x in rows["takes_ms"].tolist()]
        tasks = single_flight(list(zip(rows["at_ms"].tolist(), takes, strict=True)), wait_ms)
        return pd.DataFrame({"page_id": [pdf["page_id"].iloc[0]] * len(tasks), "start_ms": [t[0] for t in tasks], "end_ms": [t[1] for t in tasks]})

    return requests.select("page_id", "at_ms", "takes_ms").groupBy("page_id").applyInPandas(run, "page_id long, start_ms long, end_ms long")


def step(state: tuple[bool, bool, str | None], op: str, value: str | None = None) -> tuple[tuple[bool, bool, str | None], bool]:
    """The reader's next (enabled, busy, error), and whether it is published.

    `on` and `off` are ignored while busy; `on` also after an error; `done` and `fail` end a task.
    """
    enabled, busy, error = state
    if op in ("on", "off"):
        wanted = op == "on"
        if busy or wanted and error or wanted == enabled and not error:
            return state, False
        return ((True, True, None), True) if wanted else ((False, False, None), True)
    if op == "task":
        return ((enabled, True, error), True) if enabled and not busy else (state, False)
    if op == "done":
        return ((enabled, False, error), True) if busy else (state, False)
    if op == "fail":
        return ((False, False, value or "failed"), True) if busy else (state, False)
    raise ValueError(f"unknown operation {op}")


def reader_states(controls: DataFrame) -> DataFrame:
    """Published states of each page from (page_id, seq, op, value), in batch."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state: tuple = (False, False, None)
        out = []
        for seq, op, value in pdf.sort_values("seq")[["seq", "op", "value"]].itertuples(index=False):
            state, told = step(state, op, value if isinstance(value, str) else None)
            if told:
                out.append((pdf["page_id"].iloc[0], seq, *state))
        return pd.DataFrame(out, columns=["page_id", "seq", "enabled", "busy", "error"])

    return controls.groupBy("page_id").applyInPandas(fold, "page_id long, seq long, enabled boolean, busy boolean, error string")


def reader_states_stream(controls: DataFrame) -> DataFrame:
    """The same of a stream, with each page's state kept between micro-batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        state: tuple = kept.get if kept.exists else (False, False, None)
        for pdf in pdfs:
            out = []
            for seq, op, value in pdf.sort_values("seq")[["seq", "op", "value"]].itertuples(index=False):
                state, told = step(tuple(state), op, value if isinstance(value, str) else None)
                if told:
                    out.append((key[0], seq, *state))
            yield pd.DataFrame(out, columns=["page_id", "seq", "enabled", "busy", "error"])
        kept.update(tuple(state))

    return controls.groupBy("page_id").applyInPandasWithState(fold, "page_id long, seq long, enabled boolean, busy boolean, error string", "enabled boolean, busy boolean, error string", "append", GroupStateTimeout.NoTimeout)


def newly_seen(texts: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Of a stream of (ts, node_id, text, parent_id) the texts that were not processed as they are, by a registry in the stream's state."""
    return texts.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["node_id", "text", "parent_id"])


def answered(requests: DataFrame, responses: DataFrame, timeout: str = "5 seconds") -> DataFrame:
    """Requests with their response within the timeout, or an error; responses to unknown ids are dropped."""
    r = responses.select(F.col("id").alias("_id"), "received", "offsets", "error")
    within = (F.col("id") == F.col("_id")) & (F.col("received") >= F.col("sent")) & (F.col("received") <= F.col("sent") + F.expr(f"INTERVAL {timeout}"))
    return requests.join(r, within, "left").select("id", "sent", "received", "offsets", F.when(F.col("_id").isNull(), "timeout").otherwise(F.col("error")).alias("error"))


def timeouts(answers: DataFrame, timeout: str = "5 seconds", worker: str | None = None) -> DataFrame:
    """(worker, at) of the timeouts that fire: a request that one has rejected fires none of its own.

    Unanswered requests a timeout or more after the one before start an island; in one, in the
    order of sending, a request fires if it was sent at the last timeout or later.
    """
    wait = F.expr(f"INTERVAL {timeout}")
    name = F.col(worker) if worker else F.lit(0)
    open_ = answers.where("error = 'timeout'").select(name.alias("worker"), "sent").distinct()
    order = Window.partitionBy("worker").orderBy("sent")
    fresh = F.when(F.col("sent") >= F.lag("sent").over(order) + wait, 1).otherwise(0)
    islands = open_.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(order)).groupBy("worker", "_island").agg(F.array_sort(F.collect_list("sent")).alias("_sent"))
    none = F.array().cast(f"array<{answers.schema['sent'].dataType.simpleString()}>")
    fired = F.aggregate("_sent", none, lambda fires, s: F.when((F.size(fires) == 0) | (s >= F.element_at(fires, -1)), F.array_append(fires, s + wait)).otherwise(fires))
    return islands.select("worker", F.explode(fired).alias("at"))


def rejected_with(answers: DataFrame, timeout: str = "5 seconds", worker: str | None = None) -> DataFrame:
    """Answers (of one worker, or with a column that names it) in which a timeout also rejects what was pending then: requests sent before it and answered after it."""
    wait = F.expr(f"INTERVAL {timeout}")
    rows = answers.withColumn("_worker", F.col(worker) if worker else F.lit(0)).withColumn("_ends", F.coalesce("received", F.col("sent") + wait))
    # pending over an instant: an interval that holds it; both meet in cells of a timeout's length, of which a request touches two
    length = F.expr(f"timestampdiff(MICROSECOND, timestamp '1970-01-01', timestamp '1970-01-01' + INTERVAL {timeout})")
    cell = lambda t: F.floor(micros(t) / length)
    wide = rows.withColumn("_b", F.explode(F.sequence(cell(F.col("sent")), cell(F.col("_ends")))))
    dead = timeouts(answers, timeout, worker).select(F.col("worker").alias("_w"), "at", cell(F.col("at")).alias("_c"))
    hit = wide.join(dead, (F.col("_worker") == F.col("_w")) & (F.col("_b") == F.col("_c")) & (F.col("sent") < F.col("at")) & (F.col("_ends") > F.col("at"))).select("id").distinct().withColumn("_dead", F.lit(True))
    return answers.join(hit, "id", "left").select("id", "sent", "received", F.when(F.col("_dead"), F.lit(None)).otherwise(F.col("offsets")).alias("offsets"), F.when(F.col("_dead"), "rejected").otherwise(F.col("error")).alias("error"))


def badge(enabled: Column, error: Column) -> Column:
    """What the toolbar shows: text, and title."""
    text = F.when(error.isNotNull(), "!").when(enabled, "ON").otherwise("")
    title = F.when(error.isNotNull(), F.concat(F.lit("Error: "), error)).when(enabled, "Phrases are marked").otherwise("Phrases are not marked")
    return F.struct(text.alias("text"), title.alias("title"))


def setting(table: DataFrame | None) -> bool:
    """The stored switch; off if there is none."""
    row = table.select("enabled").first() if table is not None else None
    return bool(row and row[0])


def write_setting(spark: SparkSession, path: str, enabled: bool) -> None:
    """Stores the switch as a table of one row, which `setting` reads."""
    spark.createDataFrame([(enabled,)], "enabled boolean").coalesce(1).write.mode("overwrite").parquet(path)


def each_batch(task: Callable[[DataFrame, int], None], done: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: runs the task for batches after the last one that is `done`, so that a replayed batch is not written twice."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id > done():
            task(batch, batch_id)

    return run


def run_once(snapshot: Callable[[], DataFrame], process: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], DataFrame], remember: Callable[[DataFrame], None], clear: Callable[[], None]) -> str | None:
    """One task: read, process, write, remember; at any failure clear, and return the error. Nothing to read calls nothing."""
    try:
        source = snapshot()
        if not source.isEmpty():
            remember(write(process(source)))
    except Exception as failure:
        clear()
        return str(failure)
    return None


MESSAGES = ("ping", "toggle", "process", "state")


def accepted(messages: DataFrame, own_id: str, types: tuple[str, ...] = MESSAGES) -> DataFrame:
    """Messages (sender_id, frame_id, type) from the engine itself, of a page's main frame and a known type."""
    return messages.where((F.col("sender_id") == own_id) & (F.coalesce("frame_id", F.lit(0)) == 0) & F.col("type").isin(*types))


def page_status(tabs: DataFrame, states: DataFrame) -> DataFrame:
    """Each tab with its reader's state; null where no reader answers."""
    return tabs.join(states.select("page_id", "enabled", "busy", "error"), "page_id", "left")
