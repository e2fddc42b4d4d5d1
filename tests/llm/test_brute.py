"""Operators against brute force, round trips, the original library or held-out accuracy on sf0.01 or small fixtures."""

import base64
import hashlib
import random
import re
import time
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rtlake.llm import counts, fingerprints, language, lines, near, neighbours, pieces, quality, registry, toxicity

SF = "/root/testdata/sf0.01"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.default_model())


@given(st.lists(st.text(st.sampled_from("ab the▁é漢😀\x00\n\t<s>0x4A "), max_size=60), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_pieces_parity(codec, texts):
    ids = codec.encode(texts)
    assert all(codec.parity(texts, ids))
    assert codec.decode(ids) == codec.original.decode(ids)


def test_unigram_model_is_rebuilt():
    """A hand-made unigram model with byte fallback: same ids as the original library."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    field = lambda k, raw: varint(k << 3 | 2) + varint(len(raw)) + raw
    piece = lambda p, s, kind: field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + varint(3 << 3) + varint(kind))
    vocabulary = [("▁", -3), ("a", -4), ("b", -4.5), ("ab", -5), ("▁ab", -6), ("c", -5), ("bc", -5.5), ("abc", -9.5)]
    raw = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    raw += b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256)) + b"".join(piece(p, s, 1) for p, s in vocabulary)
    raw += field(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)) + field(3, varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1))
    made = pieces.Codec(raw)
    texts = ["abc abcb", "", "a  b é 漢", "<s> abc", "<0x41>b", "cab" * 50]
    ids = made.encode(texts)
    assert all(made.parity(texts, ids))
    assert made.decode(ids) == texts


def test_pieces_blanks_at_the_end(codec):
    """A lone marker is a word, which must not run into the next new one; lines are apart; blanks and markers are one."""
    texts = ["new words here ", " ", "zyx ", " wvu  tsr", "zqx\n ", "  ", "", "\n\nqpo\n", "x▁y \n▁z", "\n"]
    fresh = pieces.Codec(pieces.default_model())
    ids = fresh.encode(texts)
    assert all(codec.parity(texts, ids)) and fresh.encode(texts) == ids and fresh.encode([]) == []


def test_pieces_beyond_the_cache(codec, monkeypatch):
    """Words that are no longer remembered are encoded batch by batch."""
    monkeypatch.setattr(pieces, "CACHE", 4)
    fresh = pieces.Codec(pieces.default_model())
    for texts in (["a bc", "de"], ["fg hi jk a", "bc lm fg"], ["a no", "pq fg"]):
        assert all(codec.parity(texts, fresh.encode(texts)))
    assert len(fresh._rows) <= 4


@given(st.lists(st.text(st.sampled_from("ab the▁é漢😀\x00\n\t<s>0x4A "), max_size=60), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_exact_is_what_decoding_gives(codec, texts):
    """Also of ids that aren't a text's own, cut characters and control pieces among them."""
    import pyarrow as pa

    own = codec.encode(texts)
    for rows in (own, own[1:] + own[:1], [r[:-1] for r in own], [[0, 1, *r] for r in own], [[2] for _ in own]):
        expected = [a == b for a, b in zip(codec.decode(rows), texts, strict=True)]
        assert codec.exact(pa.array(texts, pa.string()), pa.array(rows, pa.list_(pa.int32()))) == expected


def test_pieces_on_documents(spark):
    rows = pieces.encode(read(spark, "documents"))
    assert rows.filter("NOT exact OR NOT parity").count() == 0


@given(st.text(st.sampled_from("ab 're\n 12!é's"), max_size=200), st.lists(st.tuples(st.integers(0, 220), st.integers(0, 40), st.text(st.sampled_from("ab 're\n1!"), max_size=12)), max_size=4))
@settings(max_examples=200, deadline=None)
def test_edited_counts(text, edits):
    counter = test_edited_counts.counter = getattr(test_edited_counts, "counter", None) or counts.Counter(*counts.default_vocabulary())
    tree = counts.Tree.from_row(counts.Tree.of(text, counter).row())
    for at, cut, put in edits:
        text, _ = tree.edit(text, at, cut, put, counter)
        assert tree.tokens == len(counter._bpe.encode_ordinary(text))
        assert tree.chars[1] == len(text)


def test_leaves_stay_short():
    """Edits that all fall in one place, and one long one, leave no leaf that holds most of the text."""
    counter, text = counts.Counter(*counts.default_vocabulary()), "a start and an end"
    tree = counts.Tree.of(text, counter)
    for i in range(700):
        text, _ = tree.edit(text, 7, 0, f" w{i} x", counter)
    text, _ = tree.edit(text, 30, 5, " many words" * 2_000, counter)
    text, _ = tree.edit(text, 40, 12_000, "", counter)
    assert max(len(a) for a, _ in tree.leaves) <= counts.GROWTH * counts.LEAF
    fresh = counts.Tree.of(text, counter)
    assert [x for a, _ in tree.leaves for x in a] == [x for a, _ in fresh.leaves for x in a]
    assert (tree.tokens, tree.chars[1]) == (fresh.tokens, len(text))


def test_trees_travel_cheaply(spark, monkeypatch):
    """An update reads and writes whole trees; without edits it costs far less than splitting and counting the texts anew."""
    docs = read(spark, "documents").select("doc_id", "text")
    monkeypatch.setattr(counts, "map_texts", lambda df, schema, body: body)
    build, update = counts.build(docs), counts.update(docs, F.lit(None))
    kinds = {name: pa.list_(pa.int64() if name in ("chars", "sums") else pa.int32()) for name in ("leaves", "lengths", "tokens", "chars", "sums")}

    def batch(columns):
        columns = {k: c if isinstance(c, pa.Array) else pa.array(c, pa.struct([*kinds.items()]) if k == "tree" else None) for k, c in columns.items()}
        return pa.RecordBatch.from_pydict(columns)

    def timed(body, rows):
        start = time.process_time()
        out = batch(*body([rows]))
        return time.process_time() - start, out

    rows = batch({k: [r[k] for r in docs.collect()] for k in ("doc_id", "text")})
    built = [timed(build, rows) for _ in range(4)]
    trees = built[0][1].append_column("edits", pa.nulls(rows.num_rows, pa.list_(pa.int32())))
    updated = [timed(update, trees) for _ in range(3)]
    assert updated[0][1].column("tree").to_pylist() == trees.column("tree").to_pylist()
    assert min(s for s, _ in updated) < 0.6 * min(s for s, _ in built)
    some = trees.slice(3, 40)  # as pieces of a batch come
    assert batch(*update([some])).column("tree").to_pylist() == some.column("tree").to_pylist()


def test_counts_remembered(monkeypatch):
    """However few pre-tokens are remembered, counts stay right."""
    text = "it's many   different words, and 12 numbers! " * 20
    monkeypatch.setattr(counts, "CACHE", 3)
    counter = counts.Counter(*counts.default_vocabulary())
    assert counts.Tree.of(text, counter).tokens == len(counter._bpe.encode_ordinary(text))


def sets_of(texts, n):
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        yield {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints_estimate_containment(spark):
    docs = read(spark, "documents")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), reverse=True)
    errors = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b = sets_of([text, edited], 5)
        errors.append(abs(got[i]["near_edited"] - len(a & b) / max(1, min(len(a), len(b)))))
    assert np.mean(errors) < 0.03


def test_fingerprints_row_by_row(spark):
    """Every column against a plain loop: hashes, edited texts, likeness."""
    xxhash = pytest.importorskip("xxhash")
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(n)) for _ in range(n))) for i, n in enumerate((1, 3, 40, 200, 700, 4000))] + [(9, ""), (12, "é漢 X")]

    def chained(parts):
        h = 42
        for raw in parts:
            h = xxhash.xxh64_intdigest(raw, seed=h)
        return h

    def sketch(text):
        words = [chained([w.encode()]).to_bytes(8, "little") for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())]
        every = sorted({chained(words[i : i + 5]) >> 32 for i in range(max(1, len(words) - 4))}) if words else []
        for limit in (1 << 32, 1 << 31, 1 << 30, 1 << 29, 1 << 28):
            low = [h for h in every if h < limit]
            if len(low) <= 128:
                break
        return limit, low

    def like(a, b):
        if a[1] == b[1]:
            return 1.0
        x, y = ({h for h in s[1] if h < min(a[0], b[0])} for s in (a, b))
        return len(x & y) / min(len(x), len(y)) if x and y else 0.0

    def shown(s):
        return f"{(1 << 32) // s[0]}:" + base64.b64encode(b"".join(h.to_bytes(4, "big") for h in s[1])).decode()

    order = sorted(docs, reverse=True)
    following = {order[i][0]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    for r in fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        text, after = dict(docs)[r["doc_id"]], following[r["doc_id"]]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(sketch(text)), shown(sketch(edited)))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((like(sketch(text), sketch(edited)), like(sketch(text), sketch(after))))


def test_toxicity_row_by_row():
    """Scores of whole texts in one batch against one text after the other, n-gram by n-gram."""
    rng = np.random.default_rng(5)
    weights = np.where(rng.random(2 << toxicity.BITS) < 0.3, rng.normal(size=2 << toxicity.BITS), 0).astype(np.float32)
    texts = ["", None, "a", "You ARE  a très_bad — дурак дурак дурак", "漢字漢字漢字漢字漢字", "x" * 500, "abc def " * 90]

    def plain(text):
        points, total = [ord(c) + 1 for c in " " + re.sub(r"[\W_]+", " ", (text or "").lower()) + " "], 0.0
        for k, n in enumerate(toxicity.ORDERS):
            grams = {tuple(points[i : i + n]) for i in range(len(points) - n + 1)}
            seen = set()
            for g in grams:
                h = 0
                for p in g:
                    h = (h * 0x100000001B3 + p) % (1 << 64)
                seen.add((h * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - toxicity.BITS)) + (k << toxicity.BITS))
            total += sum(float(weights[c]) for c in seen)
        return total

    assert toxicity.margins(texts, weights).tolist() == pytest.approx([plain(t) for t in texts])
    assert all(sorted(toxicity.codes(t).tolist()) == sorted(set(toxicity.codes(t).tolist())) for t in texts)


def test_sketches_merge(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.random()}" for _ in range(9000))
    half = " ".join(f"v{rng.random()}" for _ in range(9000))
    df = spark.createDataFrame([(long, half, f"{long} {half}")], "a string, b string, c string")
    s = lambda c: fingerprints.sketch(F.col(c))
    row = df.select(fingerprints.likeness(fingerprints.merge(s("a"), s("b")), s("c")).alias("same"), fingerprints.likeness(s("a"), s("c")).alias("within"), fingerprints.likeness(s("a"), s("b")).alias("apart")).first()
    assert row["same"] > 0.98 and row["within"] > 0.98 and row["apart"] < 0.02


@pytest.mark.parametrize("module, label, least", [(toxicity, "toxic", 0.93), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    scored = module.score(docs, module.train(docs, labels, label)).join(labels, "doc_id").filter("held_out")
    assert scored.filter(F.col("predicted") == F.col(label)).count() >= least * scored.count()


def test_language_accuracy(spark):
    docs = read(spark, "documents")
    found = language.identify(language.of_documents(docs), language.train(docs)).join(docs, "doc_id")
    assert found.filter("text_language = lang").count() >= 0.98 * docs.count()


def edits(a, b):
    """Word edit distance, capped at 2."""
    if abs(len(a) - len(b)) > 1:
        return 2
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return 0 if a == b else 1 if a[head + 1 :] == b[head + 1 :] else 2
    a, b = sorted((a, b), key=len)
    return 1 if a[head:] == b[head + 1 :] else 2


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    base = [rng.choices(WORDS, k=rng.randint(1, 9)) for _ in range(12)]

    def line():
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i, kind = rng.randrange(len(words) + 1), rng.randrange(3)
            words[i : i + (kind > 0)] = [] if kind == 1 else [rng.choice(WORDS)]
        return rng.choice([" ", "  "]).join(words)

    docs = [(i, "\n".join(line() for _ in range(rng.randint(0, 12)))) for i in range(80)]
    first, order = {}, []
    for i, text in docs:
        for k, raw in enumerate(text.split("\n")):
            words = tuple(raw.split())
            if words and words not in first:
                first[words] = (i, k)
                order.append(words)
    gone = {b for a, b in combinations(order, 2) if min(len(a), len(b)) >= lines.LEAST and edits(a, b) <= 1}
    expected = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not x.split() or (first[tuple(x.split())] == (i, k) and tuple(x.split()) not in gone)) for i, t in docs}
    assert gone
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == expected


@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
def test_near_against_brute_force(spark, shingle, percent):
    rng = random.Random(9)
    docs = []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([2, 30, 120, 600]))]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 20 + 1)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            docs.append((len(docs), " ".join(words)))
    sets, parent = list(sets_of([t for _, t in docs], shingle)), list(range(len(docs)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in combinations(range(len(docs)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in near.linked(spark.createDataFrame(docs, "doc_id long, text string"), shingle, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i, _ in docs}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}


@pytest.mark.parametrize("shingle, percent, n", [(3, 85, 37), (5, 80, 40)])
def test_near_partner_beyond_its_sketch(spark, shingle, percent, n):
    """A set of 32 within a larger one, whose other values are all in its sketch."""
    for seed in range(1000):
        words = [f"s{seed}w{i}" for i in range(n + shingle - 1)]
        inner, outer = " ".join(words[: 32 + shingle - 1]), " ".join(words)
        a, b = near.shingle_set(inner, shingle), near.shingle_set(outer, shingle)
        if (len(a), len(b), len(np.intersect1d(a, b[:32]))) == (32, n, 64 - n):
            break
    else:
        raise AssertionError("no such sets")
    rows = near.linked(spark.createDataFrame([(1, outer), (2, inner)], "doc_id long, text string"), shingle, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 1}


def test_near_rows_that_repeat_an_id(spark):
    """Rows with one id are one document: each of its texts links, and a text without words goes with the others."""
    x, y, z, v = (" ".join(f"{c}{i}" for i in range(100)) for c in "xyzv")
    rows = [(1, x), (1, y), (2, f"{x} more"), (3, f"{y} more"), (3, ""), (5, z), (6, z), (6, v), (7, f"{v} more"), (8, ""), (8, "")]
    got = near.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (5, 5), (6, 5), (6, 5), (7, 5), (8, 8), (8, 8)]


def test_components(spark):
    rng, edges = random.Random(1), [(i, i + 1) for i in range(100, 160)]
    edges += [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    parent = defaultdict(lambda: None)
    find = lambda x: x if parent[x] is None else find(parent[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        if a != b:
            parent[b] = a
    got = {r["node"]: r["component"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert all(got.get(x, x) == find(x) for x in nodes)


def test_recall(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(12, 16))[rng.integers(12, size=3000)] + rng.normal(size=(3000, 16)) * 0.4).astype(np.float32)
    vectors = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    found = defaultdict(dict)
    for r in neighbours.search(vectors, vectors.filter("vec_id % 20 = 0"), part_rows=300).collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    x, hits = x.astype(float), 0
    for i in range(0, 3000, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(found[i]))
        assert all(abs(s[j] - v) < 1e-9 for j, v in found[i].items())
    assert hits >= 0.9 * 20 * 150


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    import duckdb

    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    plain = lambda row: tuple(f"{v:.9g}" if isinstance(v, float) else v for v in row)
    assert sorted(map(plain, want), key=repr) == sorted((plain(tuple(r)) for r in got.select(*columns).collect()), key=repr)


def test_near_lists_across_components(spark, monkeypatch):
    """Lists that hubs don't settle: families just below the threshold share rare shingles."""
    monkeypatch.setattr(near, "HUB_ROUNDS", 1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for family in range(9):
        words = [*base[: 100 + 2 * family], *[f"f{family}x{i}" for i in range(30 - 2 * family)]]
        rows += [(10 * family + k, " ".join([*words[:-1], f"end{k}"])) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(near.shingle_set(t, 3).tolist()) for i, t in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    assert {r.doc_id: r.component_id for r in near.linked(docs).collect()} == least


def test_components_across_pieces(spark, monkeypatch):
    """Chains whose edges lie in many pieces."""
    monkeypatch.setattr(near, "JOINED", 3)
    edges = [(i + 1, i) for i in range(100)] + [(201 + 2 * i, 200) for i in range(50)]
    got = near.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert {r.node: r.component for r in got} == {a: 0 if a <= 100 else 200 for a, _ in edges}


def test_quality_row_by_row():
    """Scores against a plain loop over features, one look-up table after another; additive tables and pairs both weigh."""
    rng = random.Random(12)
    texts = ["", None, "one", "A b! C? d.\nA b! C? d.\n\nshort\n", "x" * 300] + [" ".join(rng.choice([*WORDS, "LOUD!!", "42", "é漢", "a_b"]) + rng.choice(["", ".", "\n"]) for _ in range(rng.randrange(1, 120))) for _ in range(120)]
    x = np.array([quality.features(t) for t in texts])
    assert x.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(x).all()
    y = np.array([float((t or "").count("!") > 4 and len((t or "").split()) > 30) for t in texts])
    model = quality.fit(x, y)
    assert 0 < y.sum() < len(y) and len(model["pairs"]) == quality.PAIRS and any(t.any() for _, _, t in model["pairs"])

    def place(cuts, value):
        return sum(value >= c for c in cuts)

    def plain(row):
        z = model["bias"]
        for j, table in enumerate(model["tables"]):
            z += table[place(model["cuts"][j], row[j])]
        for i, j, table in model["pairs"]:
            z += table[place(model["coarse"][i], row[i])][place(model["coarse"][j], row[j])]
        return 1 / (1 + np.exp(-z))

    assert quality.predict(model, x).tolist() == pytest.approx([plain(r) for r in x], rel=1e-9)
    value = dict(zip(quality.FEATURES, quality.features("A b! C? d.\nA b! C? d.\n\nshort\n"), strict=True))
    assert value["words"] == pytest.approx(np.log1p(9)) and value["lines"] == pytest.approx(np.log1p(3)) and value["repeated_lines"] == pytest.approx(1 / 3)
    assert value["distinct_words"] == pytest.approx(5 / 9) and value["bangs"] == pytest.approx(4 / 29) and value["mixed_ends"] == pytest.approx(6 / 9)


def test_language_posterior_row_by_row(spark):
    """Every row's posterior against plain loops: text, host in its domain without the row's own share, both channels, nulls."""
    rng = np.random.default_rng(6)
    langs = ["aa", "bb", "cc"]
    logs = np.log(rng.dirichlet(np.ones(1 << language.BITS), 3)).astype(np.float32)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rows = []
    for i in range(60):
        text = pick(["", None, "12 34", "ab", "the cat", "le chat noir", "é漢", "x y z w"])
        domain = pick(["d.aa", "e.bb", None])
        host = None if domain is None else pick(["", "www."]) + domain
        rows.append((i, text, host, domain, pick(["aa", "bb", "zz", None]), pick(["cc", "qq", None])))
    softmax = lambda v: [x / sum(np.exp(v - max(v))) for x in np.exp(v - max(v))]
    evidence, share, letters = [], [], []
    for _, text, *_ in rows:
        codes = language.trigrams(text)
        ll = np.array([sum(float(logs[k][c]) for c in codes) / 3 for k in range(3)])
        e = np.maximum(ll - ll.max(), -language.MOST)
        evidence.append(e)
        letters.append(len(codes))
        share.append(np.array(softmax(e)) if len(codes) else np.zeros(3))
    total = sum(share)
    overall = (total + 1) / (total.sum() + 3)

    def channel(column, row):
        if row[column] is None:
            return np.zeros(3)
        code = lambda r: r[column] if r[column] in langs else "?"
        known = [(code(r), s) for r, s in zip(rows, share, strict=True) if r[column] is not None]
        cell = sum((s for c, s in known if c == code(row)), np.zeros(3)) + language.CHANNEL
        return np.log(cell) - np.log(sum(s for _, s in known) + language.CHANNEL * 4)

    def others(column, row, own):
        return np.maximum(sum((s for r, s in zip(rows, share, strict=True) if row[column] is not None and r[column] == row[column]), np.zeros(3)) - (own if row[column] is not None else 0), 0)

    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, host string, domain string, declared string, address string"), (langs, logs)).collect()}
    assert len(got) == len(rows)
    for row, e, s, n in zip(rows, evidence, share, letters, strict=True):
        d = others(3, row, s)
        prior = (d + language.DOMAIN * overall) / (d.sum() + language.DOMAIN)
        h = others(2, row, s)
        prior = (h + language.HOST * prior) / (h.sum() + language.HOST)
        post = softmax(e + np.log(prior) + channel(4, row) + channel(5, row))
        r = got[row[0]]
        assert r["confidence"] == pytest.approx(max(post), rel=1e-6)
        assert r["language"] == langs[int(np.argmax(post))] and r["letters"] == n
        assert r["accepted"] == (n > 0 and max(post) >= language.SURE)
