"""Debounce, merge queues and change ingest, for batches and for streams."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Quiet seconds before work starts after an edit, and after a burst of watched-file events (fixed values).
EDIT_QUIET, WATCH_QUIET = 0.3, 0.5
CHANGES = "seq long, ts timestamp, kind string, path string, version int, text string"


def debounced(events: DataFrame, keys: Sequence[str], ts: str, quiet: float, last: Sequence[str]) -> DataFrame:
    """One row for each burst of a key: a burst ends when the key is quiet for ``quiet`` seconds. ``last`` keep their largest value."""
    w = Window.partitionBy(*keys).orderBy(ts, *last)
    apart = F.lag(ts).over(w) + F.expr(f"INTERVAL {quiet} SECOND") > F.col(ts)
    runs = events.withColumn("__fresh", F.when(apart, 0).otherwise(1)).withColumn("__run", F.sum("__fresh").over(w))
    return runs.groupBy(*keys, "__run").agg(*[F.max(c).alias(c) for c in last], F.count(F.lit(1)).alias("n_events")).drop("__run")


def bursts(events: DataFrame, keys: Sequence[str], ts: str, quiet: int, last: Sequence[str], chunk: int = 86_400) -> DataFrame:
    """``debounced`` for keys with any number of events: each ``chunk`` seconds of a key are a task's work, of which its bursts are kept,
    and only these, in order, are joined where the first of a chunk goes on with the last of the one before."""
    wait = F.expr(f"INTERVAL {quiet} SECOND")
    dealt = events.select(*keys, *last, F.col(ts).alias("__t"), F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (chunk * 1_000_000)).alias("__chunk"))
    own = Window.partitionBy(*keys, "__chunk").orderBy("__t", *last)
    apart = F.coalesce(F.lag("__t").over(own) + wait <= F.col("__t"), F.lit(True)).cast("int")
    runs = dealt.withColumn("__new", apart).withColumn("__run", F.sum("__new").over(own))
    some = runs.groupBy(*keys, "__chunk", "__run").agg(F.min("__t").alias("__from"), F.max("__t").alias("__to"), *[F.max(c).alias(c) for c in last], F.count(F.lit(1)).alias("n_events"))
    order = Window.partitionBy(*keys).orderBy("__from", "__to")
    joined = some.withColumn("__new", F.coalesce(F.lag("__to").over(order) + wait <= F.col("__from"), F.lit(True)).cast("int")).withColumn("__burst", F.sum("__new").over(order))
    return joined.groupBy(*keys, "__burst").agg(*[F.max(c).alias(c) for c in last], F.sum("n_events").alias("n_events")).drop("__burst")


def merged(jobs: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Pending jobs of a key as one: the best rank, the first place in line, forced if any is, quiet if all are."""
    return jobs.groupBy(*keys).agg(F.min("rank").alias("rank"), F.max(seq).alias("last"), F.min(seq).alias("seq"), F.bool_or("forced").alias("forced"), F.bool_and("quiet").alias("quiet"))


def queued(events: DataFrame, keys: Sequence[str], quiet: float) -> DataFrame:
    """Jobs that a work queue runs, of events (keys, ts, seq, rank, forced, quiet, cancel): keys, due, rank, seq, last, forced, quiet, n_pushes.

    Pushes of a key merge until it has been quiet for ``quiet`` seconds; then the job is due, with the best rank, the first place
    in line, forced if any was and quiet if all were. A cancel takes back what its key still waits for. Due jobs run by
    rank, then by seq. Equal times go by seq.
    """
    after, wait = Window.partitionBy(*keys).orderBy("ts", "seq"), F.expr(f"INTERVAL {quiet} SECOND")
    fresh = F.col("cancel") | F.coalesce(F.lag("cancel").over(after), F.lit(True)) | (F.lag("ts").over(after) + wait <= F.col("ts"))
    runs = events.withColumns({"__fresh": fresh.cast("int"), "__next": F.lead(F.struct("cancel", "ts")).over(after)}).withColumn("__run", F.sum("__fresh").over(after))
    back = F.coalesce(F.col("__next.cancel") & (F.col("__next.ts") < F.col("ts") + wait), F.lit(False))
    jobs = runs.filter(~F.col("cancel")).groupBy(*keys, "__run").agg(
        (F.max("ts") + wait).alias("due"), F.min("rank").alias("rank"), F.min("seq").alias("seq"), F.max("seq").alias("last"), F.bool_or("forced").alias("forced"), F.bool_and("quiet").alias("quiet"), F.count(F.lit(1)).alias("n_pushes"), F.bool_or(back).alias("__back"),
    )
    return jobs.filter(~F.col("__back")).drop("__run", "__back")


def queue_stream(events: DataFrame, quiet: float, lateness: str) -> DataFrame:
    """The stream form of ``queued`` for events (key, ts, seq, rank, forced, quiet, cancel), which may come out of order by up to ``lateness``.

    A key's state holds its events that aren't decided yet; its timer is the watermark at which the next is. What is decided
    leaves the state, due or taken back, once the watermark says that nothing earlier can come. So a state is as large as
    what its key waits for.
    """
    names = ("ts", "seq", "rank", "forced", "quiet", "cancel")
    wait = int(quiet * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in json.loads(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            for rows in batches:
                held += zip(rows["ts"].astype("datetime64[us]").astype("int64").tolist(), *[rows[c].tolist() for c in names[1:]], strict=True)
        held.sort()
        mark, due, at = state.getCurrentWatermarkMs() * 1000, [], 0
        while at < len(held):  # the next run of pushes, or a cancel: nothing before the watermark can join it any more
            to = at
            while to < len(held) and not held[to][5] and (to == at or held[to][0] < held[to - 1][0] + wait):
                to += 1
            run, end = held[at:to], held[max(at, to - 1)][0] + wait * (to > at)
            back = to < len(held) and held[to][5] and held[to][0] < end
            if (held[to][0] if back else end) > mark:
                break
            if run and not back:
                due.append((key[0], end, min(x[2] for x in run), min(x[1] for x in run), max(x[1] for x in run), any(x[3] for x in run), all(x[4] for x in run), len(run)))
            at = max(to, at + 1)
        held = held[at:]
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(held[0][0] + wait * (not held[0][5]), mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        columns = ("key", "due", "rank", "seq", "last", "forced", "quiet", "n_pushes")
        out = pd.DataFrame(due, columns=columns)
        out["due"] = pd.to_datetime(out["due"], unit="us")
        yield out

    schema = "key string, due timestamp, rank int, seq long, last long, forced boolean, quiet boolean, n_pushes long"
    return events.withWatermark("ts", lateness).groupBy("key").applyInPandasWithState(step, schema, "events string", "append", "EventTimeTimeout")


def debounce_stream(changes: DataFrame, quiet: float = EDIT_QUIET, lateness: str = "10 seconds") -> DataFrame:
    """The stream form: session windows by path with the last version and text of each burst, emitted when the watermark passes."""
    burst = F.session_window("ts", f"{int(quiet * 1000)} milliseconds")
    last = F.max_by(F.struct("kind", "version", "text"), "seq").alias("last")
    return changes.withWatermark("ts", lateness).groupBy("path", burst).agg(last, F.count(F.lit(1)).alias("n_events")).select("path", F.col("session_window.end").alias("at"), "last.*", "n_events")


def open_documents(changes: DataFrame) -> DataFrame:
    """The stream of open-document states: (path, version, text, open), by a state of one row for each path.

    A change to a document that isn't open is ignored, an open replaces what was there, a close drops the text, and of
    changes the largest version counts. Rows of a batch are applied in order of seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        version, text, is_open = state.get if state.exists else (-1, None, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        for kind, v, t in zip(rows["kind"], rows["version"], rows["text"], strict=True):
            if kind == "open":
                version, text, is_open = int(v), t, True
            elif kind == "change" and is_open and v > version:
                version, text = int(v), t
            elif kind == "close":
                version, text, is_open = -1, None, False
        state.update((version, text, is_open))
        yield pd.DataFrame({"path": [key[0]], "version": [version], "text": [text], "open": [is_open]})

    return changes.groupBy("path").applyInPandasWithState(step, "path string, version int, text string, open boolean", "version int, text string, open boolean", "update", "NoTimeout")


def effective_text(disk: DataFrame, open_docs: DataFrame) -> DataFrame:
    """(path, text): the open buffer wins over the file on disk."""
    buffers = open_docs.filter("open").select("path", F.col("text").alias("__text"))
    return disk.select("path", "text").join(buffers, "path", "full").select("path", F.coalesce("__text", "text").alias("text"))


def relevant_watched(changes: DataFrame, open_docs: DataFrame) -> DataFrame:
    """Watched-file events of paths that aren't open."""
    return changes.filter("kind = 'watched'").join(open_docs.filter("open").select("path"), "path", "left_anti")


def load_order(files: DataFrame, open_docs: DataFrame, includes: DataFrame, declares: DataFrame, named: DataFrame) -> DataFrame:
    """(path, rank): files that include an open document at any depth, open documents, files that declare what these name, the rest.

    ``includes``: (includer, included); ``declares`` and ``named``: (path, name), as a scan of words finds them.
    """
    from rtlake.operators import closure

    opened = open_docs.select("path").distinct()
    edges = includes.select(F.col("included").alias("src"), F.col("includer").alias("dst"))
    above = closure.reach(edges, opened.select(F.col("path").alias("root"))).filter("depth > 0").select(F.col("node").alias("path")).distinct()
    wanted = named.join(opened, "path", "left_semi").select("name").distinct()
    gives = declares.join(wanted, "name", "left_semi").select("path").distinct()
    ranked = above.withColumn("rank", F.lit(0)).union(opened.withColumn("rank", F.lit(1))).union(gives.withColumn("rank", F.lit(2)))
    return files.select("path").join(ranked.groupBy("path").agg(F.min("rank").alias("rank")), "path", "left").select("path", F.coalesce("rank", F.lit(3)).alias("rank"))


def ingest(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change events from JSON files that arrive in ``folder``."""
    return spark.readStream.schema(CHANGES).json(folder)


def cancelled(pending: DataFrame, cancels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pending work (keys, at) without what a later cancel of its key (keys, at) took back."""
    last = cancels.groupBy(*keys).agg(F.max("at").alias("__cancelled"))
    return pending.join(last, list(keys), "left").filter(F.col("__cancelled").isNull() | (F.col("__cancelled") < F.col("at"))).drop("__cancelled")


# Sources of problems that lie in other files than the one compiled.
CROSS_FILE = ("reference", "call", "import", "library")


def shown(problems: DataFrame, indexing: bool) -> DataFrame:
    """Problems to show; while a project is indexed, those that depend on other files are held back."""
    return problems.filter(~F.col("source").isin(*CROSS_FILE)) if indexing else problems


def saved(files: DataFrame, includes: DataFrame) -> DataFrame:
    """(path) of units to compile after files (path) were saved: these, and all that include them (includer, included), at any depth."""
    from rtlake.operators import closure

    edges = includes.select(F.col("included").alias("src"), F.col("includer").alias("dst"))
    return closure.reach(edges, files.select(F.col("path").alias("root"))).select(F.col("node").alias("path")).distinct()


class Snapshot:
    """Tables of the last commit: they are read again only when the generation moved. ``generation()`` tells it, ``load(g)`` reads one."""

    def __init__(self, generation, load):
        self._generation, self._load, self._at, self._tables = generation, load, None, None

    def tables(self):
        now = self._generation()
        if now != self._at:
            self._tables, self._at = self._load(now), now
        return self._tables
