"""Hard negatives, quality rules and conversation repair: brute force, SQL, nulls, ties, repeated rows, empty tables, clashing columns."""

import glob
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rtlake.llm import negatives, registry, repair, rules

SF = "/root/testdata/sf0.01"
EXTRA = ("kept", "row", "v", "n_words", "words", "lines", "fault", "edit", "kind", "times", "col", "leaf", "block", "score", "query", "found", "audit", "text2")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", ["op11_negatives", "op12_rules"])
def test_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


# Hard negatives


def plain_negatives(rows):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding), by loops."""
    fine = [(i, l, e) for i, l, e in rows if l is not None and e is not None and all(x is not None and abs(x) < float("inf") for x in e)]
    fine = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, [int(256 * x // 1) for x in e]) for i, l, e in fine]
    out, last = [], lambda i: (i is None, i or 0)
    for a, (anchor, label, v) in enumerate(fine):
        if anchor is None or anchor % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), *last(i), l) for b, (i, l, w) in enumerate(fine) if b != a))
        for positive in [s for s in scored if s[3] == label][:5]:
            p = -positive[0]
            inside = [s for s in scored if s[3] != label and 50 * p <= -100 * s[0] <= 95 * p][:3]
            out += [(anchor, None if positive[1] else positive[2], k + 1, None if s[1] else s[2], p, -s[0]) for k, s in enumerate(inside)]
    return sorted(out, key=repr)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit(3) for c in EXTRA})
    vectors = negatives.usable(df)
    found = negatives.mine(vectors, vectors.filter((F.col("vec_id") % 50 == 0) & (F.col("vec_id") != negatives.LAST)), **sizes)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"leaf_rows": 40, "block": 25}])
def test_negatives_equal_brute_force(spark, sizes):
    """Ties, copies, repeated ids, nulls, infinities and vectors of other lengths, in one leaf and in many leaves of several blocks."""
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), [rng.choice((-0.5, 0.0, 0.25, 1.0)) + 0.5 * (k == i % 6) for k in range(6)]) for i in range(400)]
    rows += [(1000 + i, i % 3, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25]) for i in range(120)]  # equal vectors fill more than one block
    rows += [(50, 1, [1.0] * 6), (50, 1, [1.0] * 6), (50, 2, [0.5] * 6), (None, 1, [1.0] * 6), (None, 2, [1.0] * 5 + [0.0])]
    rows += [(100, None, [1.0] * 6), (150, 1, None), (200, 1, [1.0, None]), (250, 1, [float("inf")] * 6), (300, 2, [float("nan")] * 6), (350, 3, [0.0] * 6), (450, 1, []), (500, 2, [2.0, 1.0])]
    assert mined(spark, rows, **sizes) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(50, 1, [1.0, 2.0])]) == []
    assert mined(spark, [(50, 1, None), (None, None, [1.0])]) == []


def test_vantage_tree_holds_every_row_and_bounds_hold():
    import numpy as np

    x = np.random.default_rng(3).normal(size=(700, 5))
    x[100:300] = x[0]
    tree, leaves = negatives.vantage_tree(x, 50)
    assert sorted(np.concatenate(leaves)) == list(range(700))
    assert all((tree.leaf_of(x)[rows] == k).all() for k, rows in enumerate(leaves))
    square = float((x**2).sum(1).max())
    z = negatives.augmented(x, square)
    tree, leaves = negatives.vantage_tree(z, 50)
    low, high = negatives.bounds(negatives.distances(z, tree.points), tree, leaves)
    a = np.random.default_rng(4).normal(size=(20, 5))
    lows, highs = negatives.best_scores((a**2).sum(1) + square, negatives.distances(negatives.of_anchor(a), tree.points), low, high)
    for k, rows in enumerate(leaves):
        s = a @ x[rows].T
        assert (lows[:, k] <= s.min(1)).all() and (s.max(1) <= highs[:, k]).all()


# Quality rules

TEXTS = ["", None, "  \n\t", "a b c a b c", "x " * 300, "same line here\n" * 40, "### | | | " * 60, " ".join(f"word{i}" for i in range(80)), "A" * 5000, "\n".join(f"- item number {i} of many" for i in range(30)),
         " ".join(f"w{i % 7001}" for i in range(60_000)), "é漢😀 ñ " * 30, "SHOUTING " + " ".join(f"LOUD{chr(65 + i % 26)}{i}X" for i in range(60))]


def plain_counts(text):
    words, found = re.findall(r"[^\x20\x09-\x0D]+", text or ""), defaultdict(list)
    for i in range(len(words) - 2):
        found[tuple(words[i : i + 3])].append(i)
    again = {i + k for places in found.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_rules_counts_and_edges(spark):
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in EXTRA})
    got = rules.judged(docs).collect()
    want = sorted((repr(i), *plain_counts(t)) for i, t in rows)
    assert sorted((repr(r["doc_id"]), *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert rules.judged(docs.filter("false")).collect() == []


def test_rules_order_by_rejection_for_cost_and_same_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = rules.counted(docs).filter("not base_failed")
    made = [rules.Rule("none", F.lit(False)), rules.Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")), rules.Rule("same", 5 * F.col("n_symbols") > F.col("n_words")), rules.Rule("long", F.col("n_words") > 1000)]
    order = rules.ordered(rows, made, [1.0, 1.0, 2.0, 1.0])
    assert [m.rejected for m in order] == sorted((m.rejected for m in order), reverse=True)
    assert order[0].rule.name in ("symbols", "long") and next(m.rejected for m in order if m.rule.name == "same") == 0
    cheap = rules.ordered(rows, made, [1.0, 1000.0, 0.001, 1.0])
    assert cheap[0].rule.name == "same"
    verdicts = [sorted((r["doc_id"], r["kept"]) for r in rules.judged(docs, c).collect()) for c in (order, order[::-1])]
    assert verdicts[0] == verdicts[1]


def test_rules_keep_clean_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = rules.judged(spark.read.parquet(f"{SF}/documents.parquet")).join(labels, "doc_id").filter("not base_failed").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(clean) >= 0.99 * len(clean) and not any(r["kept"] for r in rows if r["quality"] == 0)


# Conversation repair

ROLE = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}


def exhaustive(rows, most):
    """Least (cost, audit) of rows (initial, fault) over every audit of cost ``most`` at least tried, by enumeration."""
    best = None

    def go(i, emitted, cost, audit):
        nonlocal best
        if cost > most:
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", emitted) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        go_on = re.fullmatch(r"(s?(ua)*u?)?", emitted)
        if not go_on:
            return
        for r in "ua":
            go(i, emitted + r, cost + 2, audit + "I")
        if i < len(rows):
            role, fault = rows[i]
            go(i + 1, emitted, cost + 3, audit + "D")
            if fault in (None, "truncated"):
                more = cost + (fault == "truncated")
                go(i + 1, emitted + role, more, audit + "K")
                for r in "ua":
                    go(i + 1, emitted + r, more + 2, audit + "R")

    go(0, "", 0, "")
    return best


def test_search_equals_enumeration():
    rng = random.Random(2)
    cases = [list(p) for n in range(4) for p in itertools.product([(r, f) for r in "sua" for f in (None, "blank")], repeat=n)][:160]
    cases += [[(rng.choice("suat"), rng.choice((None, None, None, "blank", "truncated", "duplicate"))) for _ in range(rng.randint(3, 5))] for _ in range(60)]
    for rows in cases:
        found = repair.search([(ROLE[r], f) for r, f in rows], {0: (0, "")}, True)
        ((cost, audit),) = found.values()
        assert (cost, audit) == exhaustive(rows, cost), rows


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_chunks_give_the_audit_of_one_search(chunk):
    rng = random.Random(chunk)
    for n in (0, 1, 2, 5, 30, 130, 400):
        for weights in ((1, 5, 5), (3, 1, 1), (0, 1, 9)):
            rows = [(None if rng.random() < 0.1 else i, ROLE[rng.choices("sua", weights)[0]], f"t{i}", rng.choice((None,) * 6 + ("blank", "duplicate", "truncated"))) for i in range(n)]
            ((_, audit),) = repair.search([(r, f) for _, r, _, f in rows], {0: (0, "")}, True).values()
            got = list(repair.edits(iter(rows), chunk))
            assert "".join(e[0] for e in got) == audit
            assert re.fullmatch(r"(s?(ua)+)?", "".join(e[3][0] for e in got if e[3] is not None))
            assert [e[1:3] + e[4:] for e in got if e[0] != "I"] == [(t, r, x, f) for t, r, x, f in rows]


def test_long_conversation_forgets_rows():
    """What a chunked search holds back stays bounded: it is read row by row and gives edits out as it goes."""
    behind = 0

    def rows():
        for i in range(20_000):
            nonlocal behind
            behind = max(behind, i - seen[0])
            yield i, ROLE["ua"[i % 2]] if i % 97 else "system", f"t{i}", "blank" if i % 31 == 0 else None

    seen = [0]
    for e in repair.edits(rows(), 64):
        seen[0] += e[0] != "I"
    assert seen[0] == 20_000 and behind < 1_000


def plain_repair(rows):
    """What op13 returns for rows (conv_id, turn, role, text), by a forward pass over sorted rows."""
    space, convs = (lambda v: " " if v is None else str(v)), {}
    for c, t, r, x in rows:
        kept, k = convs.setdefault(c, []), zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        r, x = "user" if k == 4 else space(r), "" if k == 1 else re.sub("[.!?]", "", space(x)) if k == 2 else space(x)
        kept += [(t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    out, leads = [], {0: 2, 1: 2, 2: 3, 3: 2}
    for c, kept in convs.items():
        kept.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        seen, found = set(), []
        for _, r, x in kept:
            w = re.sub(r"[\x20\x09-\x0D]+", "", x)
            found.append("blank" if not w else "duplicate" if (r, x) in seen else "truncated" if w[-1] not in ".!?" else None)
            seen.add((r, x))

        def with_insertions(best):
            for _ in range(3):
                for s, (cost, audit) in list(best.items()):
                    best[leads[s]] = min(best.get(leads[s], (10**9, "")), (cost + 2, audit + "I"))
            return best

        best = with_insertions({0: (0, "")})
        for (_, r, _), fault in zip(kept, found, strict=True):
            then = {}
            for s, (cost, audit) in best.items():
                steps = [(s, cost + 3, "D")]
                if fault in (None, "truncated"):
                    more = cost + (fault is not None)
                    steps.append((leads[s], more + 2, "R"))
                    if (s, r[:1]) in ((0, "s"), (0, "u"), (1, "u"), (2, "a"), (3, "u")):
                        steps.append(({"s": 1, "u": 2, "a": 3}[r[:1]], more, "K"))
                for to, paid, letter in steps:
                    then[to] = min(then.get(to, (10**9, "")), (paid, audit + letter))
            best = with_insertions(then)
        cost, audit = min(best[s] for s in (0, 3) if s in best)
        left, texts, state = iter(kept), [], 0
        for letter in audit:
            _, r, x = next(left) if letter != "I" else (None, None, "")
            if letter != "D":
                r = r if letter == "K" else "assistant" if state == 2 else "user"
                state = {"s": 1, "u": 2, "a": 3}[r[0]]
                texts.append(f"{r}:{x}")
        turns = {t for t, _, _ in kept if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repair_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, registry.QUERIES["op13_repair"](spark, SF).collect()), key=repr) == plain_repair(rows)


def test_repair_edges(spark, tmp_path):
    """Nulls anywhere, empty roles, equal turns, repeated rows, a very long text, a long conversation, clashing columns, no rows."""
    rng = random.Random(9)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "Hi."), (1, 0, "", "x."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (2, 5, "assistant", "word " * 60_000), (3, 1, "system", "\t"), (3, 9, "tool", "é漢😀!")]
    rows += [(4, i, rng.choice(("user", "assistant", "system", None)), rng.choice(("Yes.", "No", "", "Go on!", f"line {i}."))) for i in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name, frame in (("some", df.withColumns({c: F.lit(1) for c in EXTRA})), ("none", df.filter("false"))):
        frame.write.parquet(str(tmp_path / name / "conversations.parquet"))
    assert sorted(map(tuple, repair.op13_repair(spark, str(tmp_path / "some")).collect()), key=repr) == plain_repair(rows)
    assert repair.op13_repair(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_neighbours_registered_query_against_brute_force(spark, folder):
    """The registered query goes through learned partitions on small tables too, and finds nine in ten."""
    import numpy as np

    from rtlake.llm import neighbours

    vectors = neighbours.usable(spark.read.parquet(f"{folder}/embeddings.parquet"))
    rows = vectors.select("vec_id", "v").collect()
    parts, network = neighbours.fit(vectors, len(rows))
    assert parts > 1 and network is not None
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    found = defaultdict(dict)
    for r in registry.QUERIES["op4_neighbours"](spark, folder).collect():
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        best = np.lexsort((ids, -scores))[:20]
        got = [found[ids[i]][k] for k in range(1, 21)]
        assert got == sorted(got, key=lambda g: (-g[1], g[0])) and all(abs(s - scores[ids == v][0]) < 1e-12 for v, s in got)
        hits, total = hits + len({v for v, _ in got} & set(ids[best].tolist())), total + 20
    assert hits >= 0.9 * total
