"""Pivot search, fingerprints and components, decontamination, near-copy groups: against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeworks.llm import catalog, decontaminate, pivots, simhash
from tests.conftest import SF


def best(rows, k, is_query):
    vec = {i: [int(np.floor(64.0 * x)) for x in v] for i, v in rows}
    out = set()
    for q in filter(is_query, vec):
        s = sorted(((-sum(a * b for a, b in zip(vec[q], vec[o], strict=False)), o) for o in vec if o != q))[:k]
        out |= {(q, r + 1, o, -x) for r, (x, o) in enumerate(s)}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "ROW_BLOCK", 150)
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 8)
    rows = [(r[0], [float(x) for x in r[1]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]  # many equal scores
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pivots.top_k(df, F.col("vec_id") % 20 == 0)
    assert {tuple(r) for r in got.collect()} == best(rows, 20, lambda i: i % 20 == 0)


def test_top_k_stops_early():
    draw = np.random.default_rng(0)
    x = np.floor(draw.normal(size=(4000, 3)) * 50)
    d = pivots.distances(x, pivots.spread_out(x, 24))
    *_, seen = pivots.search_block(5, np.arange(20), x[:20], d[:20], np.arange(4000), x, d)
    assert seen < 0.5 * 20 * 4000


@pytest.mark.parametrize("n", [30, 500])
def test_top_k_block_in_many_dimensions(n):
    """Where pivots eliminate next to nothing: ties, fewer rows than wanted, the query among the rows; products at most twice."""
    draw = np.random.default_rng(1)
    x = np.floor(draw.normal(size=(n, 64)) * 8)
    x[: n // 3] = x[0]
    d = pivots.distances(x, pivots.spread_out(x, 24))
    for k in (20, 40):
        got_q, got_i, got_s, seen = pivots.search_block(k, np.arange(n), x, d, np.arange(n), x, d)
        for q in range(n):
            want = sorted(((-(x[i] @ x[q]), i) for i in range(n) if i != q))[:k]
            assert got_i[q].tolist() == [i for _, i in want] and got_s[q].tolist() == [-s for s, _ in want] and (got_q[q] == q).all()
        assert seen <= 2 * n * n


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf")]), (None, [9.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (6, []), (7, [-1.0, 0.5])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, rank int")
    usable = [(0, [1.0, 2.0]), (20, [1.0, 0.0]), (5, [1.0, 1.0]), (6, [0.0, 0.0]), (7, [-1.0, 0.5])]
    assert {tuple(r) for r in pivots.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect()} == best(usable, 3, lambda i: i % 20 == 0)
    assert pivots.top_k(df.where("false"), F.lit(True)).count() == 0


def fingerprint(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = [x for x in low.translate(bytes(32 if c in b"\t\n\x0b\x0c\r " else c for c in range(256))).split(b" ") if x]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, budget=3):
    """id -> smallest id reachable, by flooding."""
    ids = list(prints)
    left, out = set(range(len(ids))), {}
    while left:
        todo, seen = [left.pop()], []
        while todo:
            i = todo.pop()
            seen.append(i)
            near = {j for j in left if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= budget}
            left -= near
            todo += near
        low = min(ids[i][0] for i in seen)
        out |= {ids[i]: low for i in seen}
    return out


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = {(r["doc_id"], 0): fingerprint(r["text"]) for r in docs}
    low = groups(prints)
    got = catalog.QUERIES["op9_simhash"](spark, SF).collect()
    assert {tuple(r) for r in got} == {(i, f"{prints[i, n]:016x}", low[i, n]) for i, n in prints}


def test_simhash_edge_cases(spark, tricky, nothing):
    got = simhash.near_duplicates(tricky).collect()
    assert len(got) == 11
    of = {(r["doc_id"]): r for r in got}
    assert of[1]["fingerprint"] == of[2]["fingerprint"] == of[3]["fingerprint"] == "0" * 16 and of[3]["component_id"] == 1
    assert of[6]["component_id"] == of[5]["component_id"] == 5
    assert of[4]["fingerprint"] == f"{fingerprint('word word word'):016x}"
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("subtree", [50_000, 20])
def test_trie_links_near_values(spark, subtree):
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, 60, dtype=np.int64)
    rows = set(base.tolist())
    for v in base.tolist():
        for _ in range(6):
            v ^= sum(1 << int(b) for b in draw.choice(63, draw.integers(1, 5), replace=False))
            rows.add(v)
    rows |= {i for i in range(0, 4096, 5)}  # many that share blocks
    rows = sorted(rows)
    df = spark.createDataFrame([(v,) for v in rows], "fingerprint long").select(F.col("fingerprint").alias("node"), F.lit(0).alias("table"), "fingerprint")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, subtree=subtree)).collect()}
    low = groups({(v, 0): v & (1 << 64) - 1 for v in rows})
    assert {v: roots.get(v, v) for v in rows} == {v: low[v, 0] for v in rows}


def test_components_of_a_long_chain(spark):
    df = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(1000, 999), (5, 5)], "a long, b long"))
    got = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert got == {i: 0 for i in range(401)} | {999: 999, 1000: 999}


def test_top_k_keeps_every_vector_of_an_id(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in draw.normal(size=3)]) for i in [*range(200), *range(0, 200, 5), *range(0, 200, 40)]]
    got = pivots.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=7)
    grid = [(i, np.floor(64 * np.array(v))) for i, v in rows]
    want = set()
    for q in range(0, 200, 20):
        all_ = sorted((-int(v @ w), o) for i, v in grid if i == q for o, w in grid if o != q)[:7]
        want |= {(q, r + 1, o, -s) for r, (s, o) in enumerate(all_)}
    assert {tuple(r) for r in got.collect()} == want


def words(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text or "").split()


def overlap(item, text):
    """The rule by brute force: any diagonal, any stretch."""
    a, b = words(item), words(text)
    if len(a) < 5:
        return False
    held, best_ = set(), 0
    for shift in range(-len(a) + 1, len(b)):
        lo, hi = max(0, -shift), min(len(a), len(b) - shift)
        eq = np.array([a[k] == b[k + shift] for k in range(lo, hi)], int)
        if eq.sum() < 5:
            continue
        for x, y in decontaminate._stretches(eq):
            best_ = max(best_, eq[x:y].sum())
            held |= {lo + k for k in range(x, y) if eq[k]}
    return best_ >= 13 or len(held) >= 0.8 * len(a)


def test_decontamination_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs if len(d["text"]) < 6000 for i in items if overlap(i["text"], d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in catalog.QUERIES["op8_decontamination"](spark, SF).collect()}
    small = {d["doc_id"] for d in docs if len(d["text"]) < 6000}
    assert want and {g for g in got if g[0] in small} == want


def test_decontamination_with_substitutions(spark, tricky, nothing):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()
    draw = np.random.default_rng(4)
    docs = []
    for n in range(60):
        w = list(item)
        for k in draw.choice(16, 3, replace=False):
            w[k] = "other"
        docs.append((n, "before it " + " ".join(w).title() + ", after it"))
    docs += [(100, " ".join(item[:9])), (101, "clean text with alpha bravo charlie in it"), (102, " ".join(item[:8] + ["extra"] + item[8:]))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "too short"), (5, "five words are just enough"), (6, " ".join(item))], "item_id long, text string")
    got = decontaminate.find(spark.createDataFrame([*docs, (103, "say FIVE words were just enough")], "doc_id long, text string"), bench, block=10)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(n, i) for n in [*range(60), 102] for i in (1, 6)} | {(103, 5)}
    assert decontaminate.find(tricky, bench).count() == 0 and decontaminate.find(nothing, bench).count() == 0
    assert decontaminate.find(tricky, bench.where("false")).count() == 0
    left = decontaminate.clean(tricky, bench)
    assert left.columns == tricky.columns and left.count() == 11


def test_decontamination_of_items_under_five_words(spark):
    bench = spark.createDataFrame([(1, "Yes."), (2, "in 1789"), (3, "a b c d"), (4, "yes"), (5, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "YES"), (2, "in 1789!"), (3, "yes yes"), (4, "a b c"), (5, "a, b; c d"), (6, "d c b a"), (7, "it was in 1789"), (8, "..."), (9, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["words"], r["item_words"], r["first_word"], r["end_word"]) for r in decontaminate.find(docs, bench, block=4).collect()}
    assert got == {(1, 1, 1, 1, 0, 1), (1, 4, 1, 1, 0, 1), (2, 2, 2, 2, 0, 2), (5, 3, 4, 4, 0, 4)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 6, 7, 8, 9]


def test_longest_stretch():
    draw = np.random.default_rng(5)
    for _ in range(300):
        e = (draw.random(draw.integers(1, 30)) < 0.7).astype(int)
        want = max((j - i for i in range(len(e)) for j in range(i + 1, len(e) + 1) if e[i:j].mean() >= 0.8 - 1e-9), default=0)
        i, j = decontaminate.longest_stretch(e)
        assert j - i == want


def test_deduplicate_keeps_one_of_each_group(spark, tricky, nothing):
    draw = np.random.default_rng(6)
    rows, clean = [], []
    for g in range(30):
        base = [f"w{draw.integers(5000)}" for _ in range(300)]
        for c in range(4):
            w = list(base)
            for k in draw.choice(300, 2 * (c > 1), replace=False):  # 5-word shingles in common: 0.93
                w[k] = "edit"
            rows.append((10 * g + c, " ".join(w)))
        clean.append(10 * g)
    rows += [(1000 + n, f"short text number {n} stands alone") for n in range(20)]
    left = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == clean + [1000 + n for n in range(20)]
    got = simhash.deduplicate(tricky)
    assert got.columns == tricky.columns and sorted(r["doc_id"] or -1 for r in got.collect()) == [-1, 1, 4, 5, 7, 8, 9]
    assert simhash.deduplicate(nothing).count() == 0


def kept(texts, similar=0.8):
    """Ids that stay, by all pairs of sets of five-word shingles."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = root[i], root[j]
            if a != b and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted(set(root))


def drawn(draw, n):
    return [f"w{x}" for x in draw.integers(50_000, size=n)]


def left_ids(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in simhash.deduplicate(rows).collect())


def test_deduplicate_finds_isolated_pairs_with_a_changed_block(spark):
    draw, texts = np.random.default_rng(11), []
    for share in np.linspace(0.78, 0.92, 60):
        n = int(draw.integers(60, 400))
        base = drawn(draw, n)
        longer = round((n - 4) / share) - (n - 4)  # shingles of an appended block
        at = int(draw.integers(n - 20))
        cut = round((n - 4) * (1 - share) / (1 + share) - 2)
        edits = {0: base + drawn(draw, longer), 1: base[longer:], 2: base[:at] + drawn(draw, max(cut, 1)) + base[at + max(cut, 1) :]}
        texts += [" ".join(base), " ".join(edits[int(draw.integers(3))])]
    want = kept(texts)
    assert 70 < len(want) < 110  # both sides of the limit are there
    assert left_ids(spark, texts) == want


def test_deduplicate_finds_copies_of_texts_that_share_a_passage(spark):
    draw = np.random.default_rng(12)
    passage, texts = drawn(draw, 404), []
    for _ in range(150):
        own = drawn(draw, 60)
        texts.append(" ".join(passage + own))
        own[int(draw.integers(5, 55))] = "edit"
        texts.append(" ".join(passage + own))  # 0.98 with its own, 0.75 to 0.78 with the others
    assert left_ids(spark, texts) == kept(texts) == list(range(0, 300, 2))


def test_deduplicate_decides_long_texts_by_all_shingles(spark):
    draw, texts = np.random.default_rng(13), []
    for share in np.linspace(0.70, 0.90, 60):
        base = drawn(draw, int(draw.integers(300, 1500)))
        n = len(base) - 4
        far = round(n * (1 - share) / (1 + share) / 5)  # words edited one by one, each in five shingles
        edit = list(base)
        for k in draw.choice(np.arange(5, len(base) - 5, 5), far, replace=False):
            edit[k] = "edit"
        texts += [" ".join(base), " ".join(edit)]
    want = kept(texts)
    assert 70 < len(want) < 110
    assert left_ids(spark, texts) == want


def test_near_copies_of_the_pipeline_are_those_of_the_fingerprints_too(spark):
    """Texts that operator 9 links are one group, though few of their distinct shingles are the same."""
    import corpus_pipeline

    draw = np.random.default_rng(14)
    texts = ["alpha beta gamma " * 400 + " ".join(drawn(draw, 30)) for _ in range(3)] + [" ".join(drawn(draw, 60))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(rows).collect()} == {0, 3}
    assert kept(texts) == left_ids(spark, texts) == [0, 1, 2, 3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, rows, "").collect()) == [0, 3]


def test_memory_of_a_dense_group_and_of_a_run_of_texts():
    """A task holds little beside its rows: near fingerprints of one group, and the words of one batch of texts."""
    draw = np.random.default_rng(1)
    dense = np.unique((draw.integers(0, 1 << 8, 40_000).astype(np.uint64) << np.uint64(40)) | draw.integers(0, 1 << 8, 40_000).astype(np.uint64))
    group = np.zeros(len(dense), int)
    words = [" ".join(draw.choice(["alpha", "beta", "gamma", "delta"], 1500)) for _ in range(1000)]
    texts = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(words)], names=["_key", "_text"])
    most = []
    for work in (lambda: simhash.trie_links(dense, group, group), lambda: list(simhash._shingles(iter([texts])))):
        tracemalloc.start()
        work()
        most.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert most[0] < 150 and most[1] < 30, most
