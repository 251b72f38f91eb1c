"""Lexical search, vector codes and id files: against brute force and exact round trips."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeworks.llm import codes, idfiles, lexical
from tests.conftest import SF

BPE = public_tokenizers.path("byte_bpe_50k.json")


def ranked(docs, items, k):
    """Scores by the definition, for (id, text) documents and items."""
    low = lambda t: re.findall(lexical.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    terms = [(i, collections.Counter(low(t))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, total, df = len(terms), sum(sum(c.values()) for _, c in terms), collections.Counter(t for _, c in terms for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        asked[i].update(low(t))
    out = set()
    for item, words in asked.items():
        scores = []
        for i, c in terms:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in words.items() if t in c)
            if s > 0:
                scores.append((-s, math.inf if i is None else i, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k])}
    return out


def test_lexical_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 30)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 200)  # several blocks of queries
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = ranked([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], [(r[0], r[1]) for r in items.collect()], 10)
    assert {tuple(r) for r in lexical.rank(docs, items).collect()} == want
    monkeypatch.setattr(lexical, "VOCABULARY", 10)  # the index of all terms
    assert {tuple(r) for r in lexical.rank(docs, items).collect()} == want


def test_lexical_edge_cases(spark, tricky, nothing, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 5)
    items = [(1, "same text, SAME text"), (1, "word"), (2, ""), (3, None), (None, "ünï no"), (4, "zzz"), (5, "one stands twice")]
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    rows = [(r["doc_id"], r["text"]) for r in tricky.collect()]
    for k in (2, 10):
        assert sorted(lexical.rank(tricky, asked, k).collect(), key=str) == sorted(ranked(rows, items, k), key=str)
    assert lexical.rank(nothing, asked).count() == 0
    assert lexical.rank(tricky, asked.where("false")).count() == 0


def test_lexical_stops_early():
    draw = np.random.default_rng(1)
    n_docs, n_strata = 2000, 50
    tf, m = draw.geometric(0.5, n_docs), 25 + 40 * (np.arange(n_docs) % n_strata)
    order = np.lexsort((np.arange(n_docs), -tf, m))
    new = np.append(True, (m[order][1:] != m[order][:-1]) | (tf[order][1:] != tf[order][:-1]))
    g = np.flatnonzero(new)
    row = {"terms": np.array([7]), "term_at": np.array([0, len(g)]), "m": m[order][g], "tf": tf[order][g], "group_at": np.append(g, n_docs), "postings": order}
    block = lexical._Block(row, n_docs)
    best, score, visits = block.search(np.array([5, 7]), np.array([3, 2]), 10, 0, False)
    every = 2 * lexical.impact(tf, m)
    assert score.tolist() == sorted(every, reverse=True)[:10] and best.tolist() == np.lexsort((np.arange(n_docs), -every))[:10].tolist()
    assert visits < n_strata


def lloyd(rows, parts=8, entries=16, rounds=6):
    """(codes, errors, codebooks) of integer vectors in order of their id."""
    x = np.array(rows).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    near = lambda: [[int(((x[i, p] - books[p]) ** 2).sum(1).argmin()) for p in range(parts)] for i in range(len(x))]
    for _ in range(rounds):
        at = np.array(near())
        for p in range(parts):
            for e in range(books.shape[1]):
                if (at[:, p] == e).any():
                    books[p, e] = np.floor_divide(x[at[:, p] == e, p].sum(0), (at[:, p] == e).sum())
    at = np.array(near())
    return ["".join(f"{c:02x}" for c in a) for a in at], [int(sum(((x[i, p] - books[p, a[p]]) ** 2).sum() for p in range(parts))) for i, a in enumerate(at)], books


@pytest.mark.parametrize("owned", [codes.OWNED, 7])
def test_codes_equal_brute_force(spark, monkeypatch, owned):
    monkeypatch.setattr(codes, "OWNED", owned)
    monkeypatch.setattr(codes, "TOGETHER", 50)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = [[math.floor(4096 * float(v)) for v in r["embedding"]] for r in rows]
    code, error, books = lloyd(x)
    got = codes.compress(spark.read.parquet(f"{SF}/embeddings.parquet").repartition(3)).orderBy("vec_id").collect()
    assert [r["code"] for r in got] == code and [r["error"] for r in got] == error
    by = collections.Counter()
    for r, e in zip(rows, error, strict=True):
        by[r["label"]] += e
    assert [r["label_error"] for r in got] == [by[r["label"]] for r in rows]
    assert {r["codebooks_sha256"] for r in got} == {codes.books_hash(books)}


def test_codes_edge_cases(spark):
    rows = [(i % 40, [float((i * j) % 7) / 64 for j in range(10)], None if i % 3 else i % 2) for i in range(60)]  # repeated ids, a length that is no multiple, NULL labels
    odd = [(100, None, 1), (101, [1.0, None], 1), (102, [float("nan")], 1), (103, [float("-inf")] * 10, 1)]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows + odd], "vec_id long, embedding array<double>, label int, code string, v double")
    rows.sort(key=lambda r: (r[0], [math.floor(4096 * x) for x in r[1]]))
    code, error, _ = lloyd([[math.floor(4096 * x) for x in r[1]] + [0] * 6 for r in rows])
    got = codes.compress(df).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted(zip([r[0] for r in rows], code, error, strict=True))
    assert sum(r["label_error"] for r in got if r["vec_id"] == 1) == 2 * sum(e for r, e in zip(rows, error, strict=True) if r[2] is None)
    assert [r["error"] for r in codes.compress(df.where("vec_id in (3, 100)")).collect()] == [0, 0]  # two rows are two entries
    assert codes.compress(df.where("false")).count() == 0 and codes.compress(df.where("vec_id >= 100")).count() == 0


def test_codes_move_only_what_changes(spark, monkeypatch):
    """A generation holds the members that changed their entry; the others stay where they were dealt."""
    held, owners = [], codes._owners
    monkeypatch.setattr(codes, "_owners", lambda rows: held.append(owners(rows)) or held[-1])
    codes.compress(spark.read.parquet(f"{SF}/embeddings.parquet"))
    members = [g.where("n = 0").count() for g in held]
    assert len(members) == 6 and members[0] == 8 * 500 and sum(members[1:]) < members[0]
    assert all(g.where("n > 0").agg(F.sum("n")).first()[0] + m == members[0] for g, m in zip(held[1:], members[1:], strict=True))


@pytest.mark.parametrize("sizes", [[0], [1], [5, 0, 0, 3], list(range(700)), [1 << 20, 1, 1, 0, 1 << 18], [1] * 5000])
def test_boundaries_round_trip(sizes):
    ids = np.arange(sum(sizes)) % 50000
    block = idfiles.Block(idfiles.to_block(np.array(sizes), ids, 2))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    assert (block.starts(np.arange(len(sizes) + 1)) == upto).all() and (block.ids == ids).all()
    i = len(sizes) // 2
    assert (block.document(i) == ids[upto[i] : upto[i + 1]]).all()


def test_boundaries_are_small():
    sizes = np.random.default_rng(0).geometric(1 / 500, 20000)
    low, lows, high, ranks = idfiles.pack(np.concatenate([[0], np.cumsum(sizes)]))
    assert 8 * (len(lows) + len(high) + len(ranks)) / 20001 < 3.2 + math.log2(500)  # bits a document, against 64
    with pytest.raises(ValueError):
        idfiles.Block(b"EFIDxxxx" + bytes(100))


def whole(docs, file=BPE, special=False):
    """(doc_id, start, n_tokens, crc32) by the library over whole texts."""
    t = Tokenizer.from_file(file)
    t.encode_special_tokens = not special
    out, at = [], 0
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_idfiles_equal_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(idfiles, "MEMO", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = idfiles.digest(spark, idfiles.write(docs.repartition(5), BPE, block_ids=9000)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == whole([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])


SPACED = ["a  b  c", "x \n y　 z", "é mot  \té", "l'été   's 've don't\r\n\r\n  end  ", "   w", "日本 語　x", " \n", "a\x1c b\x85 c", "🙂 🙂​ d", "1 2  3", "<|endoftext|> a<|endoftext|>b", "ß́ ؀ q"]


def test_idfiles_spaces_and_special_tokens(spark):
    rows = [(i, t) for i, t in enumerate(SPACED + [t + " and " + u for t in SPACED for u in SPACED])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for special in (False, True):
        got = idfiles.digest(spark, idfiles.write(df, BPE, special=special)).orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == whole(rows, special=special)
    words = public_tokenizers.path("word_bpe_49k.json")  # lower case, white space dropped: whole texts
    assert [tuple(r) for r in idfiles.digest(spark, idfiles.write(df, words)).orderBy("doc_id").collect()] == whole(rows, words)


def test_idfiles_edge_cases(spark, tricky, nothing):
    rows = sorted(((r["doc_id"], r["text"]) for r in tricky.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = idfiles.digest(spark, idfiles.write(tricky.withColumn("_id", F.lit(1)).withColumn("shard", F.lit("x")), BPE)).orderBy("start").collect()
    assert [tuple(r) for r in got] == whole(rows)  # its repeated rows are equal
    assert idfiles.digest(spark, idfiles.write(nothing, BPE)).count() == 0
