"""Conversation structure repair: Dijkstra over the lattice of (turn index, grammar state).

Roles, by their initials, must read ``(s?(ua)+)?``. The edits of a row are to keep it, to give it the role that the
grammar wants next, or to delete it; between rows a turn without text may be put in. Nodes are the rows read and the
grammar's state; the queue's key is the cost, then the audit (the edits' initials, compared as ASCII). At one node equal
costs never have audits of which one begins the other, as letters put in cost something, so the key only grows along an
edge and the first accepting end node popped has the cheapest edits, and of those the ASCII-least.

Spark deals conversations by id, finds repeated rows in a window and sorts rows in order; each task then streams them.
A conversation of up to ``CHUNK`` rows is one search. In a longer one each chunk's search starts from what the one
before it left: at most one audit for each grammar state. States that can't win any more go, the edits on which the
remaining audits agree are given out, and their rows are forgotten. So a task's memory doesn't grow with a conversation;
its time does, as the digest of a whole conversation asks for one pass in order.

Order and equals: rows go by turn, nulls first, then role and text; null roles, texts and ids in keys count as one
space; a null conv_id is one conversation; extra columns are left out; a conversation without rows has no edits.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rtlake.llm.common import WORD, table

#: Rows of one search.
CHUNK = 512
#: Costs of the contract: another role, deletion, insertion; a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar states: nothing yet, after s, after u, after a. Where the role that is wanted next leads, and which it is.
NEXT, WANTED, ENDS = (2, 2, 3, 2), ("user", "user", "assistant", "user"), (0, 3)
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What it costs at most to go on from state q as from state p, for each (p, q): rows deleted or put in before the rest is alike.
SPARE = {
    (0, 1): 2 * INSERT, (0, 2): DELETE + INSERT, (0, 3): DELETE, (1, 0): 0, (1, 2): INSERT, (1, 3): 0,
    (2, 0): INSERT, (2, 1): INSERT, (2, 3): INSERT, (3, 0): 0, (3, 1): 2 * INSERT, (3, 2): INSERT,
}
EDITS = "conv_id long, edit string, turn long, was string, role string, text string, fault string"
BATCH = 2_048


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32 of ``conv_id:turn`` modulo 20; nulls of role and text are one space.

    0 drops a row, 1 empties its text, 2 takes full stops, exclamation and question marks out, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    shaped = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))
    return shaped.select("conv_id", "turn", "role", "text", F.explode("times")).drop("col")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault), dealt by conv_id and in order: blank, duplicate (role and text seen earlier), truncated or null.

    The window's keys begin with conv_id, so it needs no exchange of its own; of rows with one role and text, all but the
    first in order are repeats. Rows without a word are blank whatever came before and are told apart by turn alone.
    """
    blank, last = ~F.col("text").rlike(WORD), F.rlike(F.col("text"), F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    dealt = rows.select("conv_id", "turn", "role", "text", blank.alias("blank")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text", F.when(F.col("blank"), F.col("turn"))).orderBy(F.asc_nulls_first("turn"))
    fault = F.when(F.col("blank"), "blank").when(F.row_number().over(same) > 1, "duplicate").when(~last, "truncated")
    marked = dealt.withColumn("fault", fault).drop("blank")
    return marked.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", F.col("fault").eqNullSafe("duplicate"))


def search(rows: list[tuple[str, str | None]], starts: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) at the end of ``rows`` (role, fault) by grammar state: of the first accepting state alone if they are the ``last``."""
    queue = [(cost, audit, 0, state) for state, (cost, audit) in starts.items()]
    heapq.heapify(queue)
    done: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str]] = {}
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows):
            if last and state in ENDS:
                return {state: (cost, audit)}
            ends[state] = (cost, audit)
        wanted = NEXT[state]
        heapq.heappush(queue, (cost + INSERT, audit + "I", at, wanted))
        if at < len(rows):
            role, fault = rows[at]
            heapq.heappush(queue, (cost + DELETE, audit + "D", at + 1, state))
            if fault in (None, "truncated"):
                more = cost + TRUNCATED * (fault is not None)
                kept = STEPS.get((state, role[:1]))
                if kept is not None:
                    heapq.heappush(queue, (more, audit + "K", at + 1, kept))
                heapq.heappush(queue, (more + REROLE, audit + "R", at + 1, wanted))
    return ends


def alive(ends: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """The states that may still win: not those that another one, going on alike, would surely beat."""
    return {p: x for p, x in ends.items() if not any(q != p and y[0] + SPARE[p, q] < x[0] for q, y in ends.items())}


def edits(rows: Iterable[tuple[int | None, str, str, str | None]], chunk: int = CHUNK) -> Iterator[tuple]:
    """(edit, turn, was, role, text, fault) of one conversation's rows (turn, role, text, fault), in order; put-in turns have no turn, was or fault."""
    held: list[tuple] = []
    states: dict[int, tuple[int, str]] = {0: (0, "")}
    state = read = 0

    def given(audit: str) -> Iterator[tuple]:
        nonlocal state, read
        taken = 0
        for letter in audit:
            turn, was, text, fault = (None, None, "", None) if letter == "I" else held[taken]
            taken += letter != "I"
            if letter == "D":
                yield letter, turn, was, None, text, fault
                continue
            role = was if letter == "K" else WANTED[state]
            state = STEPS[state, role[:1]]
            yield letter, turn, was, role, text, fault
        del held[:taken]
        read -= taken

    def advance(last: bool) -> Iterator[tuple]:
        nonlocal states, read
        states = search([(role, fault) for _, role, _, fault in held[read:]], states, last)
        read = len(held)
        states = states if last else alive(states)
        agreed = os.path.commonprefix([audit for _, audit in states.values()])
        yield from given(agreed)
        states = {s: (cost, audit[len(agreed) :]) for s, (cost, audit) in states.items()}

    for row in rows:
        held.append(row)
        if len(held) - read == chunk:
            yield from advance(False)
    yield from advance(True)


def repaired(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every edit of every conversation, in order within it: conv_id, edit (K, R, D or I), turn, was, role, text, fault.

    Rows of a conversation are in one partition and in order; deleted rows have no role. The repaired conversation is what
    is not deleted.
    """
    arrow = pa.schema([("conv_id", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), *[(c, pa.string()) for c in ("was", "role", "text", "fault")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv_id, rows in by_conversation(batches, ("turn", "role", "text", "fault")):
            for edit in edits(rows, chunk):
                out.append((conv_id, *edit))
                if len(out) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    typed = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    return faults(typed).mapInArrow(run, EDITS)


def by_conversation(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Runs of rows with one conv_id, each as an iterator that must be read before the next."""
    rows = ((c, row) for b in batches for c, row in zip(b.column("conv_id").to_pylist(), zip(*[b.column(x).to_pylist() for x in columns], strict=True), strict=True))
    pending = next(rows, None)
    while pending is not None:
        conv_id = pending[0]

        def run(conv_id=conv_id) -> Iterator[tuple]:
            nonlocal pending
            while pending is not None and pending[0] == conv_id:
                row, pending = pending[1], next(rows, None)
                yield row

        yield conv_id, run()


def summary(found: DataFrame) -> DataFrame:
    """One row for each conversation of ``repaired``'s result, read in its order: faults, cost, audit and digest."""
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, rows in by_conversation(batches, ("edit", "turn", "was", "role", "text", "fault")):
            digest, audit, cost, counts, illegal, n_turns = hashlib.sha256(), [], 0, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0
            before = first = latest = None
            empty = True
            for edit, turn, was, role, text, fault in rows:
                audit.append(edit)
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
                if edit != "I":
                    if fault is not None:
                        counts[fault] += 1
                    illegal += before is not None and before + was[:1] not in ("su", "ua", "au")
                    before = was[:1]
                    if turn is not None and turn != latest:
                        first, latest, n_turns = turn if first is None else first, turn, n_turns + 1
                if edit != "D":
                    digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                    empty = False
            gaps = latest - first + 1 - n_turns if n_turns else 0
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": conv_id, "gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}],
                schema=pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())]),
            )

    return found.mapInArrow(batched(run), schema)


def batched(run):
    """``run`` with its one-row batches put together."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in run(batches):
            held.append(b)
            if len(held) == BATCH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return body


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``conversations`` after damage; those that lost all rows have none."""
    conversations = table(spark, sf_dir, "conversations")
    named = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = summary(repaired(damaged(conversations))).withColumnRenamed("conv_id", "found")
    none = lambda c, value: F.coalesce(F.col(c), F.lit(value)).alias(c)
    counts = [none(c, 0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return named.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").select("conv_id", *counts, none("audit", ""), none("repaired_sha256", hashlib.sha256().hexdigest()))
