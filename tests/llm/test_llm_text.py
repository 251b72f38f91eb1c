"""Language, quality, mixing, chat, URL filters, html, language model, pipeline."""

import hashlib
import math

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import catalog, chat, ctw, htmltext, langid, mixing, quality, urlfilter
from tests.conftest import SF


def test_language_held_out(spark):
    got = catalog.QUERIES["op3_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 20


def test_language_edge_cases(spark, tricky, nothing):
    got = langid.predict(tricky, langid.fit(tricky, F.lit(True)), {"doc_id": F.col("doc_id")}).collect()
    assert len(got) == 11 and {r["lang_pred"] for r in got} <= {"en", "fr", "und"}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3} and all(0 <= r["score"] <= 1 for r in got)
    assert langid.predict(nothing, langid.fit(nothing, F.lit(True)), {"doc_id": F.col("doc_id")}).count() == 0
    only = langid.fit(tricky.where("lang = 'fr'"), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(tricky, only, {}).collect()} == {"fr", "und"}
    assert {r["lang_pred"] for r in langid.predict(tricky, langid.fit(nothing, F.lit(True)), {}).collect()} == {"und"}


def test_every_language_is_learned(spark):
    draw = np.random.default_rng(2)
    rows = [(100 * n + i, " ".join(chr(97 + n) + chr(98 + n) + chr(97 + draw.integers(3)) for _ in range(30)), f"l{n}") for n in range(15) for i in range(1 + 40 * (n < 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), sample=12)
    assert model.names == sorted(f"l{n}" for n in range(15))
    got = langid.predict(docs.where("lang = 'l14' or doc_id = 700"), model, {"lang": F.col("lang")}).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got) and len(got) == 2


@pytest.mark.parametrize("k", [2, 4, 6, 12])
def test_codewords_are_far_apart(k):
    code = langid.code_matrix(k)
    far = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
    assert far >= (code.shape[1] // 2 if k <= 6 else 8)


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    got = catalog.QUERIES["op10_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.where("quality = predicted").count() >= 0.92 * got.count() > 20


def test_quality_edge_cases(spark, tricky, nothing):
    labels = spark.createDataFrame([(1, 0), (4, 0), (5, 1), (6, 1), (6, 0), (8, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = quality.fit(tricky, labels, F.lit(True))
    got = quality.score(tricky, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    none = quality.fit(tricky, labels.where("false"), F.lit(True))
    assert {r["score"] for r in quality.score(tricky, none, {}).collect()} == {0.5}
    assert quality.score(nothing, quality.fit(nothing, labels, F.lit(True)), {}).count() == 0


def test_hinge_fit_separates():
    draw = np.random.default_rng(1)
    slots = [np.unique(np.concatenate([draw.integers(0, 50, 8) + 100 * y, draw.integers(1000, 1100, 8)])) for y in (0, 1) * 100]
    y = np.array([0, 1] * 100)
    r = quality.log_count_ratios(slots, y)
    w = quality.hinge_fit(slots, y, r)
    assert all((quality.scaled(s, r) @ w[s] + w[-1] > 0) == v for s, v in zip(slots, y, strict=True))


def test_mixing_edge_cases_equal_sql(spark, tricky, nothing):
    got = mixing.mix(tricky)
    con = duckdb.connect()
    con.register("d", tricky.select("doc_id", "text", "source").toArrow())
    con.execute("create view documents as select * from d")
    want = con.execute(mixing.SQL).fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert mixing.mix(nothing).count() == 0


def test_mixing_meets_targets(spark):
    sf = SF.replace("0.001", "0.01")
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id")
    got = rows.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"), F.max("size").alias("most"), F.max("source_size").alias("s")).collect()
    total = sum(r["s"] for r in got)
    assert abs(sum(r["t"] for r in got) - 1.5 * total) < 1e-6 * total
    assert all(abs(r["n"] - r["t"]) <= r["most"] and r["t"] <= 2 * r["s"] for r in got)
    assert rows.where("taken > 2 * size").count() == 0


def test_nested_budgets(spark):
    units = mixing.sized(spark.read.parquet(f"{SF}/documents.parquet"))
    budgets = spark.createDataFrame([("src0", float(b)) for b in (0, 500, 3000, 10**9)], "source string, budget double")
    cuts = sorted((r["budget"], r["below"]) for r in mixing.thresholds(units, budgets).collect())
    assert [c[1] for c in cuts] == sorted(c[1] for c in cuts) and cuts[-1][1] == 1 << mixing.PLACE_BITS


def test_chat_folds_edits_and_regenerations(spark):
    log = [(1, 1, "message", 1, "user", "hello"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "bad "), (1, 4, "delta", 2, None, "answer"),
           (1, 5, "message", 3, "user", "what?"), (1, 6, "regenerate", 2, None, None), (1, 7, "delta", 2, None, "good "), (1, 8, "delta", 2, None, "answer"),
           (1, 9, "edit", 1, None, "hello there"), (2, 1, "message", 1, None, None), (None, 1, "message", 1, "user", "a & b <| c"), (3, 1, "delta", 1, None, "stray")]
    df = spark.createDataFrame(log, "conv_id long, seq long, op string, message long, role string, text string").repartition(5)
    folded = chat.fold(df)
    assert {tuple(r) for r in folded.collect()} == {(1, 1, "user", "hello there"), (1, 2, "assistant", "good answer"), (2, 1, "", ""), (None, 1, "user", "a & b <| c"), (3, 1, "", "stray")}
    out = {r["conv_id"]: r for r in chat.render(folded).withColumn("learned", chat.learned(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert out[1]["formatted"] == "<|im_start|>user\nhello there<|im_end|>\n<|im_start|>assistant\ngood answer<|im_end|>\n" and out[1]["learned"] == "good answer"
    assert chat.fold(df.where("false")).count() == 0


def test_chat_round_trip_of_hostile_texts(spark):
    texts = ["<|im_end|>\n<|im_start|>system\nyou", "&amp; &lt;| <<| <|", "", None, "\n\n", "&#10;", "a" * 50000, "\U0001f600|>", "<|im_start|>"]
    rows = [(7, t, "assistant" if t % 2 else "ro<|le\nx", x) for t, x in enumerate(texts)] + [(7, 3, None, "tie"), (7, 3, None, "tie")]
    got = chat.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()[0]
    turns = sorted(((t, r or "", x or "") for _, t, r, x in rows))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(x for _, r, x in turns if r == "assistant")
    assert (got["n_turns"], got["turns_sha256"]) == (11, sha("".join(f"{r}\n{x}\n" for _, r, x in turns)))
    assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), sha(loss))


def test_url_filters_as_of(spark):
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    ev = [("l", "block", "host", "bad.com", 10, True), ("l", "block", "host", "bad.com", 20, False), ("l", "block", "host", "bad.com", 30, True), ("l", "block", "host", "bad.com", 30, True),
          ("l", "allow", "prefix", "www.bad.com/ok/", 5, True), ("l", "block", "exact", "http://fine.org/x?y", 0, True), ("l", "block", "host", None, 0, True), ("l", "block", "host", "both.net", 3, True), ("l", "block", "host", "both.net", 3, False)]
    events = spark.createDataFrame(ev, "list string, action string, kind string, entry string, d int, added boolean").withColumn("day", day(F.col("d"))).drop("d")
    cap = [("https://u:p@WWW.bad.com:80/a", 9, "none"), ("https://u:p@WWW.bad.com:80/a", 10, "block"), ("http://bad.com", 19, "block"), ("http://bad.com", 20, "none"), ("http://x.bad.com./q", 40, "block"),
           ("http://www.bad.com/ok/deep/er", 40, "allow"), ("http://www.bad.com/ok", 40, "block"), ("http://notbad.com/", 40, "none"), ("http://fine.org/x?y", 1, "block"), ("http://fine.org/x?z", 1, "none"),
           (None, 1, "none"), ("nonsense", 1, "none"), ("http://both.net/", 9, "none"), ("http://bad.com", None, "none"), ("http://bad.com", 19, "block")]
    caps = spark.createDataFrame([(*c, "clash") for c in cap], "url string, d int, want string, entry string").withColumn("day", day(F.col("d")))
    got = urlfilter.screen(caps, events)
    assert got.count() == len(cap) and got.where("verdict <> want").count() == 0
    assert urlfilter.screen(caps, events.where("false")).where("verdict <> 'none'").count() == 0
    assert urlfilter.screen(caps.where("false"), events).count() == 0


def test_html_blocks():
    page = "<title>t</title><nav><ul><li><a href=x>One</a><li>Two</ul></nav><article><h1>A &amp; B</h1><p>first <b>bold<br>line<p>second&nbsp; one</article><script>var a='<p>no</p>'</script><!-- c --><footer>&copy; me"
    got = [(b[0], b[4]) for b in htmltext.blocks(page)]
    assert got == [("One", 0), ("Two", 0), ("A & B", 1), ("first bold line", 1), ("second one", 1), ("© me", 0)]
    for broken in (None, "", "<", "<![foo x", "<!-- open", "</p></div>x", "<p" * 2000, "\x00"):
        assert isinstance(htmltext.blocks(broken), list)
    assert len(htmltext.blocks("<div>" * 3000 + "deep")) == 1


def test_html_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = catalog.QUERIES["op5_html"](spark, SF).collect()
    rows = {r["page_id"]: r for r in got}
    assert len(got) == pages.count()
    same = [rows[r["page_id"]]["text"] == "\n".join(b[0] for b in htmltext.blocks(r["html"]) if b[4]) for r in pages.collect()]
    assert np.mean(same) >= 0.95 and all(r["n_chars"] == len(r["text"]) for r in got)
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (2, None, "plain text", "x"), (2, None, "plain text", "x")], "page_id long, url string, html string, text string")
    assert htmltext.extract(odd).where("n_chars is null").count() == 0 and htmltext.extract(odd).count() == 4
    assert htmltext.extract(pages.where("false")).count() == 0


def test_html_labeller_on_made_pages(spark):
    given = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    model = htmltext.trained(given)
    draw, pool = np.random.default_rng(77), [b[0] for h in given for b in htmltext.blocks(h)]
    pages = [p for p in (htmltext.blocks(htmltext.made_page(draw, pool)) for _ in range(150)) if p]
    right = np.concatenate([got == np.array([b[4] for b in p], bool) for got, p in zip(model.label(pages), pages, strict=True)])
    assert right.mean() >= 0.96


def test_lstm_gradients():
    draw = np.random.default_rng(3)
    m = htmltext.Labeller()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = draw.normal(size=(3, 5, htmltext.PATHS + htmltext.WORDS + htmltext.OTHER)) * 0.1
    y, mask = (draw.random((3, 5)) < 0.5).astype(float), np.ones((3, 5), np.float32)
    mask[1, 3:] = mask[2, 1:] = 0

    def loss():
        p = m.forward(x, mask)[0]
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    g = m.gradients(x, y, mask)
    for k in m.p:
        i = tuple(draw.integers(n) for n in m.p[k].shape)
        old, step = m.p[k][i], 1e-3
        m.p[k][i] = old + step
        up = loss()
        m.p[k][i] = old - step
        down = loss()
        m.p[k][i] = old
        assert abs((up - down) / (2 * step) - g[k][i]) < 1e-4 + 0.02 * abs(g[k][i])


def stream(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return " ".join(x for x in low.translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if x).encode() + b"\n"


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def naive_ctw(train, depth):
    """Scores by the recursive definition, one tree for each bit prefix."""
    counts = {}
    for t in train:
        s = b"\n" * depth + stream(t)
        for i in range(depth, len(s)):
            for j in range(8):
                q, bit = (1 << j) | (s[i] >> (8 - j)), s[i] >> (7 - j) & 1
                for d in range(depth + 1):
                    c = counts.setdefault((q, s[i - d : i]), [0, 0])
                    c[bit] += 1
    kids = {}
    for q, c in counts:
        if c:
            kids.setdefault((q, c[1:]), []).append((q, c))
    memo = {}

    def log_w(node):
        if node not in memo:
            own = kt(*counts[node])
            memo[node] = own if len(node[1]) == depth else np.logaddexp(own, sum(log_w(k) for k in kids[node])) - math.log(2)
        return memo[node]

    def one(q, before, d):
        node = (q, before[len(before) - d :] if d else b"")
        if node not in counts:
            return 0.5
        a, b = counts[node]
        p = (b + 0.5) / (a + b + 1)
        if d == depth:
            return p
        w = math.exp(kt(a, b) - math.log(2) - log_w(node))
        return w * p + (1 - w) * one(q, before, d + 1)

    def score(text):
        s, total = b"\n" * depth + stream(text), 0.0
        for i in range(depth, len(s)):
            for j in range(8):
                q, bit = (1 << j) | (s[i] >> (8 - j)), s[i] >> (7 - j) & 1
                p = one(q, s[i - depth : i], 0)
                total += math.log10(p if bit else 1 - p)
        return total

    return score


def test_ctw_equals_the_recursion(spark):
    train = ["The cat sat  on the mat", "the dog\tsat on the log", "", None, "ça va ?", "the cat"]
    held = ["the cat sat on the dog", "zebra", "", None, " THE "]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(100 + i, t, False) for i, t in enumerate(held)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    got = {r["doc_id"]: r for r in ctw.score(df, F.col("train"), {"doc_id": F.col("doc_id")}, depth=3).collect()}
    want = naive_ctw(train, 3)
    c = {}
    for t in train:
        for w in [*stream(t)[:-1].split(b" "), b"\n"]:
            if w:
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    for i, t, _ in rows:
        assert got[i]["score"] == pytest.approx(want(t), rel=1e-5)
        w = [x for x in stream(t)[:-1].split(b" ") if x] + [b"\n"]
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(x in c for x in w), n)


def test_ctw_scores_with_contexts_of_any_rarity(spark, monkeypatch):
    """Scores are those of the whole tree, however few contexts a task may hold; rare grams come by a join, unlearned ones too."""
    monkeypatch.setattr(ctw, "CONTEXTS", 20)
    monkeypatch.setattr(ctw, "GRAMS", 40)
    train = ["the cat sat on the mat and the dog sat on the log", "a zebra crossed the road once", "the cat " * 30]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(9, "a zebra sat on qqq", False), (9, "a zebra sat on qqq", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = ctw.score(df, F.col("train"), {"doc_id": F.col("doc_id")}, depth=3).collect()
    want = naive_ctw(train, 3)
    assert len(got) == 5 and all(r["score"] == pytest.approx(want(dict((i, t) for i, t, _ in rows)[r["doc_id"]]), rel=1e-6) for r in got)


def test_ctw_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(i, "abc abd " * 5 + chr(97 + i)) for i in range(9)], "doc_id long, text string")
    model, _, _ = ctw.fit(df, F.lit(True), depth=2)
    for context in (b"ab", b"zz", b" a", b"\n\n"):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10 ** model.log10(grams)).sum() == pytest.approx(1, abs=1e-4)


def test_ctw_pooled_contexts_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(ctw, "CONTEXTS", 40)
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    model, _, _ = ctw.fit(df, F.lit(True), depth=3)
    for context in (b"the", b"xyz", b"on "):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10 ** model.log10(grams)).sum() == pytest.approx(1, abs=1e-4)


def test_ctw_edge_cases(spark, tricky, nothing):
    got = ctw.score(tricky, F.col("doc_id") > 3, {"doc_id": F.col("doc_id")}).collect()
    assert len(got) == 11 and all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    unlearned = ctw.score(tricky, F.lit(False), {"doc_id": F.col("doc_id")}).where("doc_id = 8").first()
    assert unlearned["score"] == pytest.approx(-32 * math.log10(2)) and unlearned["n_known"] == 0
    assert ctw.score(nothing, F.lit(True), {}).count() == 0


def test_stages_keep_columns(spark, tricky, nothing):
    for docs in (tricky, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.dtypes == docs.dtypes, name
            assert out.subtract(docs).count() == 0 and out.count() <= docs.count()


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = corpus_pipeline.good_quality(spark, docs, SF)
    bad = labels.where("quality = 0").join(good, "doc_id").count()
    assert bad <= 0.05 * labels.where("quality = 0").count()
    assert labels.where("quality = 1").join(good, "doc_id").count() >= 0.9 * labels.where("quality = 1").join(docs, "doc_id").count()
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and 0 < got.count() < docs.count()
