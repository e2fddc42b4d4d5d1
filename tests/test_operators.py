"""Operators, scalar functions and streams on small tables."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rtlake.functions import text as T
from rtlake.operators import closure, lookup, sets, spans, subsequences, writes
from rtlake.streaming import schedule


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name, pattern, score", [("anything", "", 0), ("adder", "W", None), ("WIDTH", "W", 25), ("uvm_object", "uvm", 80), ("uvm_object", "uo", 10 + 12 + 3 + 10 + 12 + 3 - 3 - 1), ("uvm_object", "obmvu", None)])
def test_fuzzy(spark, name, pattern, score):
    assert one(spark, T.fuzzy_score(F.lit(name), F.lit(pattern))) == score


def test_subsequences_lose_nothing(spark):
    """Searches by the rarest pair equal scoring all names: in either case, repeated letters, letters of two code points, blanks."""
    rng = random.Random(8)
    letters = "abAB_zé0 İß"
    texts = ["", None, "aa", "a", "İ", "ẞx", "x_y"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    names = spark.createDataFrame([(n,) for n in texts + texts[:9]], "name string")
    posted = subsequences.postings(names).cache()
    held = subsequences.counts(posted).cache()
    patterns = ["a", "aa", "aaa", "ab", "BA", "_0z", "é", "İ", "ß", "q", "a q", "ab_z0"]
    every = names.distinct().crossJoin(spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    every = every.withColumn("score", T.fuzzy_score(F.col("name"), F.col("pattern"))).filter("score IS NOT NULL")
    expected = {(r["pattern"], r["name"], r["score"]) for r in every.collect()}
    asked = spark.createDataFrame([(p,) for p in [*patterns, "ab", "", None]], "pattern string")
    got = [(r["pattern"], r["name"], r["score"]) for r in subsequences.matches(asked, posted, held).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    for p in ("aa", "_0z", "q"):
        found = [(p, r["name"], r["score"]) for r in subsequences.search(names, posted, held, p).collect()]
        assert sorted(found) == sorted(x for x in expected if x[0] == p)
    assert subsequences.search(names, posted, held, "").filter("name IS NOT NULL").count() == len({t for t in texts if t is not None})
    assert subsequences.candidates(posted, held, "_0z").count() < len(set(texts)) / 3
    with pytest.raises(ValueError):
        subsequences.candidates(posted, held, "")
    later = names.filter("name <> 'aa'").union(spark.createDataFrame([("new_name",)], "name string"))
    assert sorted(map(tuple, subsequences.updated(posted, later).collect())) == sorted(map(tuple, subsequences.postings(later).collect()))


def test_grams_once_a_name(spark):
    """Characters are listed once for each distinct name, and by no filter on the rows before."""
    posted = subsequences.postings(spark.createDataFrame([("ab",), ("ab",)], "name string"))
    plan = posted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 1 and not any("sequence(" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")), plan
    assert sorted(map(tuple, posted.collect())) == [("a", "ab"), ("ab", "ab"), ("b", "ab")]


def test_postings_of_patterns(spark):
    """Lists made for some patterns alone are those of the whole index, and find the same."""
    rng = random.Random(9)
    word = lambda most: "".join(rng.choice("abcABC_zé İß") for _ in range(rng.randrange(most)))
    names = spark.createDataFrame([(word(12),) for _ in range(200)] + [(None,), ("zz",), ("zz",)], "name string")
    patterns = spark.createDataFrame([("ab",), ("Ab",), ("_z",), ("ßa",), ("İ",), ("q",), ("",), (None,)], "pattern string")
    every, some = subsequences.postings(names), subsequences.postings(names, patterns=patterns)
    wanted = {r["gram"] for r in subsequences.asked(patterns).collect()}
    assert {"a", "ab", "_z", "ßa", "q"} < wanted and len({r["gram"] for r in every.collect()} - wanted) > 20
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in every.collect() if r["gram"] in wanted)
    found = lambda posted: sorted(map(tuple, subsequences.matches(patterns, posted, subsequences.counts(posted)).collect()))
    assert found(some) == found(every) and len(found(some)) > 20
    assert subsequences.postings(names, patterns=patterns.limit(0)).isEmpty()


def test_fuzzy_against_loop(spark):
    """Scores equal a plain loop over the name's characters."""
    rng = random.Random(10)
    word = lambda least, most: "".join(rng.choice("abcABC_-.:19é") for _ in range(rng.randrange(least, most)))

    def score(name, pattern):
        found = last = total = 0
        for i, c in enumerate(name, 1):
            if found < len(pattern) and c.lower() == pattern[found].lower():
                before = name[i - 2] if i > 1 else ""
                begins = i == 1 or before in "_-.:" or (c in "ABC" and before in "abc19")
                total += 10 - (i - last - 1) + 15 * (found > 0 and i == last + 1) + 12 * begins + 3 * (c == pattern[found])
                found, last = found + 1, i
        return total - len(name.encode()) // 10 if found == len(pattern) else None

    pairs = [(word(0, 25), word(1, 5)) for _ in range(1500)]
    got = spark.createDataFrame(pairs, "name string, pattern string").withColumn("score", T.fuzzy_score(F.col("name"), F.col("pattern"))).collect()
    assert [r["score"] for r in got] == [score(*p) for p in pairs] and sum(r["score"] is not None for r in got) > 100
    none = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "name string, pattern string")
    assert [r[0] for r in none.select(T.fuzzy_score(F.col("name"), F.col("pattern"))).collect()] == [None, None, None]


def test_fuzzy_properties(spark):
    score = lambda n, p: one(spark, T.fuzzy_score(F.lit(n), F.lit(p)))
    assert score("uvm_report_object", "rep") > score("uvm_report_object", "rpo")
    assert score("uvm_object", "uvm") > score("uvm_object", "UVM")
    assert score("uvm_phase", "p") > score("uvm_report", "p")


def test_scalars(spark):
    x = lambda c: one(spark, c)
    assert x(T.scope_tail(F.lit("a::b::c"))) == "c" and x(T.scope_parent(F.lit("a::b::c"))) == "a::b"
    assert x(T.display_scope(F.lit("a::@3.4::b"))) == "a::b"
    assert x(T.type_layers(F.lit("queue:p::t"))) == ["queue", "p::t"] and x(T.peel(F.lit("queue:array:int"), 2)) == "int" and x(T.peel(F.lit("int"), 1)) == ""
    assert x(T.code_part(F.lit('a = "//"; // b'))) == 'a = "//"; '
    assert x(T.word_at(F.lit("int foo_1;"), F.lit(6))) == "foo_1"
    assert x(T.offset_of(F.lit("a\nbc"), F.lit(3), F.lit(0))) is None
    assert x(T.cut_bytes(F.lit("aé漢"), 4)) == "aé..."
    assert x(T.doc_markdown(F.lit("a\nb\n\nc"))) == "a  \nb\n\nc"
    assert x(T.is_separator(F.lit(" -----"))) and not x(T.is_separator(F.lit("--")))
    assert x(spans.chain(F.lit("a::b"))) == ["a::b", "a", ""] and x(spans.chain(F.lit(""))) == [""]


def test_prefix_is_literal(spark):
    rows = spark.createDataFrame([("a_b",), ("axb",), ("A_c",), ("é",)], "n string")
    assert sorted(r["n"] for r in lookup.prefix(rows, "n", "a_").collect()) == ["A_c", "a_b"]


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    found = closure.reach(edges, spark.createDataFrame([(1,)], "root long"))
    assert sorted((r["node"], r["depth"]) for r in found.collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    with pytest.raises(RuntimeError):
        closure.reach(edges, spark.createDataFrame([(1,)], "root long"), limit=2)


def test_closest_before(spark):
    points = spark.createDataFrame([("k", 5, "p"), ("k", 1, "q"), ("none", 1, "r")], "k string, at long, id string")
    rows = spark.createDataFrame([("k", 3, "x"), ("k", 4, "y"), ("k", 9, "z")], "k string, since long, v string")
    got = spans.closest_before(points, rows, ["k"], "at", "since", ["id"], ["v"])
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [("p", "y"), ("q", "x"), ("r", None)]


def test_upsert_keeps_ids(spark):
    old = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id long, path string, hash string")
    new = spark.createDataFrame([(9, "b", "h3"), (10, "c", "h4")], "id long, path string, hash string")
    assert sorted(map(tuple, writes.upsert(old, new, ["path"], ["id"]).collect())) == [(1, "a", "h1"), (2, "b", "h3"), (10, "c", "h4")]


CHANGES = [
    (1, 0.0, "open", "/a", 1, "one"),
    (2, 0.1, "change", "/a", 2, "two"),
    (3, 0.2, "change", "/b", 2, "ignored"),
    (4, 5.0, "change", "/a", 3, "three"),
    (5, 5.1, "open", "/c", 1, "see"),
    (6, 9.0, "close", "/c", 0, None),
    (7, 60.0, "watched", "/d", 0, None),
]


def changes(spark, tmp_path):
    import json

    base = dt.datetime(2024, 1, 1)
    folder = tmp_path / "in"
    folder.mkdir()
    for k, part in enumerate((CHANGES[:5], CHANGES[5:])):
        rows = [dict(zip(("seq", "ts", "kind", "path", "version", "text"), (s, (base + dt.timedelta(seconds=t)).isoformat() + "Z", *rest), strict=True)) for s, t, *rest in part]
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
    return schedule.ingest(spark, str(folder))


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_debounce_stream(spark, tmp_path):
    run(schedule.debounce_stream(changes(spark, tmp_path), 0.3, "1 second"), "bursts", "append")
    got = {(r["path"], r["version"], r["n_events"]) for r in spark.table("bursts").collect()}
    assert {("/a", 2, 2), ("/b", 2, 1), ("/a", 3, 1)} <= got


def test_open_documents(spark, tmp_path):
    run(schedule.open_documents(changes(spark, tmp_path)), "opened", "update")
    states = spark.table("opened").collect()
    assert ("/a", 3, "three", True) in [tuple(r) for r in states]
    assert ("/b", -1, None, False) in [tuple(r) for r in states]
    disk = spark.createDataFrame([("/a", "old"), ("/d", "disk")], "path string, text string")
    opened = spark.createDataFrame([("/a", 3, "three", True)], "path string, version int, text string, open boolean")
    assert sorted(map(tuple, schedule.effective_text(disk, opened).collect())) == [("/a", "three"), ("/d", "disk")]


def test_builtins(spark):
    from rtlake.functions import builtins

    assert ("push_back", "Method") in [tuple(r) for r in builtins.methods(spark, "queue").collect()]
    assert builtins.methods(spark, "none").count() == 0
    names = {r["name"] for r in builtins.keywords(spark, builtins.CLASS).collect()}
    assert "extends" in names and "always_ff" not in names


def test_streamed_digest(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("a", 10, "yy"), (None, 1, ""), ("b", None, "z"), (None, 1, "q")], "k string, n int, t string")
    args = (["k"], [F.col("n"), F.col("t")], ["n"])
    assert sorted(map(str, sets.streamed_digest(rows, *args).collect())) == sorted(map(str, sets.digest(rows, *args).collect()))
    assert sets.streamed_digest(rows.limit(0), *args).count() == 0


def test_latest_holding(spark):
    rows = spark.createDataFrame([(1, 10, 0, 5), (1, 11, 3, 8), (1, 12, 3, 9), (2, 13, 0, 9)], "k int, s int, b int, e int")
    points = spark.createDataFrame([(1, 100, 0), (1, 101, 3), (1, 102, 4), (1, 103, 10), (2, 104, 9), (3, 105, 1)], "k int, p int, at int")
    found = spans.latest_holding(points, rows, ["k"], "at", "b", "e", ["p"], ["s"])
    assert sorted(map(tuple, found.collect())) == [(101, 10), (102, 12), (104, 13)]


def test_innermost_of_any_spans(spark):
    """Nested, touching, crossing, equal and inverted spans, null keys and places, against pairing every point with every span."""
    rng = random.Random(4)
    rows = [(rng.choice((1, 2, None)), s, b, b + rng.choice((-1, 0, 0, 1, 3, 9, 30))) for s in range(120) for b in [rng.randrange(40)]] + [(1, 900, None, 5), (1, 901, 2, None), (4, 902, 0, 9), (4, 903, 2, 5), (4, 904, 9, 12)]
    points = [(rng.choice((1, 2, None, 3)), p, rng.randrange(45)) for p in range(150)] + [(1, 999, None), (4, 1000, 8), (4, 1001, 9), (4, 1002, 5), (4, 1003, 6)]
    want = []
    for k, p, at in points:
        held = [(b, -e, s) for j, s, b, e in rows if j == k and None not in (at, b, e) and b <= at <= e]
        want += [(p, max(held)[2])] if held else []
    place = lambda c: F.array(F.col(c).cast("long"), F.lit(0).cast("long"))
    nulls = lambda c: F.when(F.col(c).isNotNull(), place(c))
    got = spans.innermost(spark.createDataFrame(points, "k int, p int, at int"), spark.createDataFrame(rows, "k int, s int, b int, e int"), ["k"], nulls("at"), nulls("b"), nulls("e"), ["p"], ["s"])
    assert sorted(map(tuple, got.collect())) == sorted(want) and (1000, 902) in want and (1001, 904) in want
    empty = spark.createDataFrame([], "k int, s int, b int, e int")
    assert spans.innermost(spark.createDataFrame(points, "k int, p int, at int"), empty, ["k"], nulls("at"), nulls("b"), nulls("e"), ["p"], ["s"]).collect() == []


@pytest.mark.parametrize("seed", [8, 9])
def test_queue_stream_equals_batch(spark, tmp_path, seed):
    """Merged, cancelled and out-of-order jobs over several micro-batches give what the batch form gives; due ones run by rank and place."""
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = []
    for seq in range(240):
        at = seq + rng.choice((0, 0, 0, -4, 3, 6))  # up to ten seconds out of order
        rows.append({"key": rng.choice("abcdef"), "ts": (start + dt.timedelta(seconds=max(at, 0) + 20)).isoformat(), "seq": seq, "rank": rng.randrange(4), "forced": rng.random() < 0.2, "quiet": rng.random() < 0.6, "cancel": rng.random() < 0.15})
    rows.append({"key": "z", "ts": (start + dt.timedelta(hours=1)).isoformat(), "seq": 999, "rank": 0, "forced": False, "quiet": True, "cancel": True})
    schema = "key string, ts timestamp, seq long, rank int, forced boolean, quiet boolean, cancel boolean"
    (tmp_path / "in").mkdir()
    for k in range(0, len(rows), 30):
        path = tmp_path / "in" / f"{k:04}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows[k : k + 30]))
        os.utime(path, (k + 1, k + 1))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run(schedule.queue_stream(stream, 5, "15 seconds"), f"due_jobs{seed}", "append")
    got = spark.table(f"due_jobs{seed}")
    want = schedule.queued(spark.read.schema(schema).json(str(tmp_path / "in")), ["key"], 5)
    columns = ["key", "due", "rank", "seq", "last", "forced", "quiet", "n_pushes"]
    rows_of = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows_of(got) == rows_of(want) and want.filter("n_pushes > 1").count() > 5


def test_hash_tree_finds_what_differs(spark):
    rows = [("a", i, f"t{i}") for i in range(0, 300, 3)] + [("b", i, "x") for i in range(5)] + [(None, 7, None)]
    changed = [r if r[:2] != ("a", 150) else ("a", 150, "other") for r in rows if r[:2] != ("a", 9)] + [("c", 1, "new")]
    tree = lambda xs: sets.hash_tree(spark.createDataFrame(xs, "k string, id long, t string"), ["k"], [F.col("id"), F.coalesce("t", F.lit(""))], "id", 4, 2)
    one, two, same = tree(rows), tree(changed), tree(rows[::-1])
    assert {(r["k"], r["node"]) for r in sets.unequal_ranges(one, two, ["k"], 4, 2).collect() if r["k"]} == {("a", 2), ("a", 37), ("c", 0)}
    assert [r for r in sets.unequal_ranges(one, same, ["k"], 4, 2).collect() if r["k"]] == []
    assert one.filter("level = 3").count() == 3 and one.filter("level = 1 AND k = 'a'").count() == 75


def test_bursts_across_chunks(spark):
    rng, start = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), start + dt.timedelta(seconds=rng.randrange(4000)), i) for i in range(300)]
    events = spark.createDataFrame(rows, "k string, ts timestamp, id int")
    key = lambda df: sorted(map(tuple, df.select("k", "id", "n_events").collect()))
    assert key(schedule.bursts(events, ["k"], "ts", 20, ["id"], 60)) == key(schedule.debounced(events, ["k"], "ts", 20, ["id"]))
