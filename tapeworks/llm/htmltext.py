"""Main text of web pages by a recurrent block labeller (operator 5).

A page is parsed into its leaf blocks in order. Each block is a vector: its tag path (tags, classes and ids of all open
elements, hashed), its words (hashed), length, links and place. A bidirectional LSTM in numpy reads the sequence of a page, so
each block is labelled in the light of the whole page; the blocks labelled as article are joined.

No page carries labels, so the model is trained here on two kinds of pages: at most SAMPLE of the given ones, where a block
inside <article> or <main> counts as article unless a page part such as a menu, form or advert encloses it; and MADE pages
laid out anew from the texts of those, with known labels: menus, headers, footers, sidebars, notices, adverts, forms, reader
comments in many forms around and inside an article with or without an element of that name.

Edge cases: NULL or empty html gives an empty text; text outside any element is a block; scripts, styles, titles and
comments are never blocks; broken markup is read as far as it goes; repeated rows are each returned; NULL ids and urls are
returned as NULL; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import LOWER, word_hashes, word_spans

SAMPLE, LONGEST = 300, 200_000  # pages learned from, and characters of html of one of them
MADE = 500
PATHS, WORDS, OTHER, INNER, HIDDEN = 512, 32, 7, 32, 24

# Element names by their role in HTML.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript title svg iframe object canvas audio video".split())
ALIKE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Words in class names and ids, and elements, of what is no article.
PARTS = frozenset("ad ads advert advertisement adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist cookie consent disclaimer footer form header masthead menu modal nav navbar navigation newsletter notice popup promo promoted related replies reply search share sharing sidebar signup social sponsored subscribe widget".split())
PART_TAGS = frozenset("nav aside footer form button select textarea".split())


@lru_cache(maxsize=1 << 16)
def _slot(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % PATHS


class Blocks(HTMLParser):
    """Collects (text, path counts, innermost element, share of linked characters, label) of the leaf blocks of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, np.ndarray, str, float, int]] = []
        self.stack: list[tuple[str, list[int], int, int]] = []  # tag, slots, is a page part, known label
        self.open: Counter = Counter()
        self.path = np.zeros(PATHS, np.int16)
        self.text: list[str] = []
        self.linked = self.parts = self.unseen = self.label = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                label = self.label or int((self.open["article"] or self.open["main"]) and not self.parts)
                self.found.append((text, self.path.copy(), self.stack[-1][0] if self.stack else "", min(1.0, self.linked / len(text)), label if self.label >= 0 else 0))
            self.text, self.linked = [], 0

    def pop(self) -> None:
        tag, slots, part, label = self.stack.pop()
        self.open[tag] -= 1
        for s in slots:
            self.path[s] -= 1
        self.parts -= part
        self.unseen -= tag in UNSEEN
        self.label -= label

    def pop_to(self, tag: str) -> None:
        while self.stack and self.open[tag]:
            last = self.stack[-1][0]
            self.pop()
            if last == tag:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
            if self.open["p"]:
                self.pop_to("p")
            if tag in ALIKE and self.open[tag]:
                for last, *_ in reversed(self.stack):
                    if last == tag:
                        self.pop_to(tag)
                    if last == tag or last in ALIKE[tag]:
                        break
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        slots, part, label = [_slot(f"<{tag}")], tag in PART_TAGS, 0
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words = re.findall("[a-z]+|[0-9]+", value.lower())[:16]
                slots += [_slot(w) for w in words]
                part |= not PARTS.isdisjoint(words)
            elif name == "data-known":
                label = 1 if value == "1" else -1000
        for s in slots:
            self.path[s] += 1
        self.stack.append((tag, slots, int(part), label))
        self.open[tag] += 1
        self.parts += part
        self.unseen += tag in UNSEEN
        self.label += label

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if tag not in VOID and self.open[tag]:
            self.pop_to(tag)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)
            if self.open["a"]:
                self.linked += len(data)


def blocks(html: str | None) -> list[tuple[str, np.ndarray, str, float, int]]:
    for source in (html or "", (html or "").replace("<!", "&lt;!")):
        parser = Blocks()
        try:
            parser.feed(source)
            parser.close()
        except AssertionError:  # a declaration that the parser doesn't know: read it as text
            continue
        parser.flush()
        return parser.found
    return []


def vectors(pages: list[list[tuple]]) -> np.ndarray:
    """One row for each block of the pages, one page after another."""
    flat = [b for p in pages for b in p]
    texts = [b[0].encode("utf-8", "surrogatepass") for b in flat]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    row, begin, end = word_spans(data, at)
    h = word_hashes(data, begin, end)
    words = np.bincount(row * WORDS + (h >> np.uint64(59)).astype(np.int64), minlength=len(flat) * WORDS).reshape(-1, WORDS).astype(np.float32)
    n = np.maximum(words.sum(1), 1)
    x = np.zeros((len(flat), PATHS + WORDS + OTHER), np.float32)
    if flat:
        x[:, :PATHS] = np.minimum(np.stack([b[1] for b in flat]), 1)
        inner = np.array([_slot(f"last {b[2]}") for b in flat])
        x[np.arange(len(flat)), inner] = 1
    x[:, PATHS : PATHS + WORDS] = words / np.sqrt(n)[:, None] / 4
    place = np.concatenate([np.arange(len(p)) / max(len(p) - 1, 1) for p in pages] or [np.zeros(0)])
    other = [np.log1p(n) / 4, [b[3] for b in flat], place, 1 - place, [b[0][-1] in ".!?:;" for b in flat], [b[0][:1].isupper() for b in flat], n < 4]
    x[:, PATHS + WORDS :] = np.stack([np.asarray(o, np.float32) for o in other], 1) if flat else 0
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Input layer, an LSTM in each direction, and a logistic output; trained by back-propagation through time."""

    def __init__(self, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        new = lambda *s: (draw.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"in": new(PATHS + WORDS + OTHER, INNER) * 4, "in_b": np.zeros(INNER, np.float32), "out": new(2 * HIDDEN + INNER, 1), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": new(INNER, 4 * HIDDEN), f"h{d}": new(HIDDEN, 4 * HIDDEN), f"b{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}

    def _run(self, u: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (pages, blocks, HIDDEN) in one direction; what the way back needs."""
        pages, steps, _ = u.shape
        z_in = u @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, kept = np.zeros((pages, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[:, t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = (f * c + i * g) * m
            tc = np.tanh(c_new)
            h_new = o * tc * m
            kept.append((t, i, f, o, g, c, tc, h, m))
            h, c = h_new, c_new
            out[:, t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        u = np.tanh(x @ self.p["in"] + self.p["in_b"])
        f, kf = self._run(u, mask, "f")
        b, kb = self._run(u, mask, "b")
        s = np.concatenate([f, b, u], 2)
        return _sigmoid(s @ self.p["out"] + self.p["out_b"])[..., 0], (u, s, kf, kb)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        prob, (u, s, kf, kb) = self.forward(x, mask)
        e = ((prob - y) * mask / mask.sum())[..., None].astype(np.float32)
        g = {"out": np.einsum("pti,ptj->ij", s, e), "out_b": e.sum((0, 1))}
        ds = e @ self.p["out"].T
        du = ds[..., 2 * HIDDEN :].copy()
        for d, kept, dh_all in (("f", kf, ds[..., :HIDDEN]), ("b", kb, ds[..., HIDDEN : 2 * HIDDEN])):
            dh, dc = np.zeros_like(dh_all[:, 0]), np.zeros_like(dh_all[:, 0])
            dx, dw, db = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(self.p[f"h{d}"]), np.zeros_like(self.p[f"b{d}"])
            for t, i, f, o, gg, c, tc, h, m in reversed(kept):
                dh = (dh + dh_all[:, t]) * m
                do, dc = dh * tc, (dc + dh * o * (1 - tc * tc)) * m
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), do * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                dx += u[:, t].T @ dz
                dw += h.T @ dz
                db += dz.sum(0)
                du[:, t] += dz @ self.p[f"x{d}"].T
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            g |= {f"x{d}": dx, f"h{d}": dw, f"b{d}": db}
        dz = du * (1 - u * u)
        return g | {"in": np.einsum("pti,ptj->ij", x, dz), "in_b": dz.sum((0, 1))}

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = 350, batch: int = 16, rate: float = 0.01, seed: int = 9) -> None:
        draw = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            some = [pages[i] for i in draw.integers(0, len(pages), batch)]
            x, mask = packed([s[0] for s in some])
            y = np.zeros(mask.shape, np.float32)
            for i, (_, label) in enumerate(some):
                y[i, : len(label)] = label
            g = self.gradients(x, y, mask)
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = v / max(1.0, size)
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.999 * square[k] + 0.001 * v * v
                self.p[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[list[tuple]], together: int = 64) -> list[np.ndarray]:
        """Whether each block of each page belongs to the article; pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        a = 0
        while a < len(order):
            n = max(1, min(together, 20_000 // len(pages[order[min(a + together, len(order)) - 1]])))
            some = order[a : a + n]
            x = vectors([pages[i] for i in some])
            x, mask = packed(np.split(x, np.cumsum([len(pages[i]) for i in some])[:-1]))
            prob = self.forward(x, mask)[0]
            for k, i in enumerate(some):
                out[i] = prob[k, : len(pages[i])] >= 0.5
            a += n
        return out


def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), most, rows[0].shape[1]), np.float32), np.zeros((len(rows), most), np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, 1
    return x, mask


def made_page(draw: np.random.Generator, pool: list[str]) -> str:
    """A page laid out from texts of the pool; data-known says which elements are article."""
    say = lambda most=400: pool[draw.integers(len(pool))][:most].replace("&", "&amp;").replace("<", "&lt;")
    few = lambda most=6: " ".join(say(200).split()[: 1 + draw.integers(most)])
    pick = lambda *options: options[draw.integers(len(options))]
    some = lambda low, high: range(int(draw.integers(low, high + 1)))
    maybe = lambda share, make: make() if draw.random() < share else ""
    text = lambda: say(pick(60, 200, 1200))

    def named(*names: str) -> str:
        name = pick(*names)
        kind = pick("class", "class", "id")
        return f'{kind}="{pick(name, name, f"{name} {pick("box", "wrap", "top", "left", "main-col", "clearfix", "x1")}", f"{pick("site", "page", "js", "col")}-{name}")}"'

    links = lambda: "".join(pick(f'<li><a href="/{k}">{few(3)}</a></li>', f"<a href='#'>{few(2)}</a> ") for k in some(3, 9))
    menu = lambda: pick(f"<nav><ul>{links()}</ul></nav>", f"<nav {named('menu', 'nav')}>{links()}</nav>", f"<div {named('menu', 'nav', 'navbar', 'navigation', 'breadcrumb')}><ul>{links()}</ul></div>", f"<ul {named('menu', 'nav')}>{links()}</ul>")
    header = lambda: pick("<header>{}</header>", f"<header {named('header', 'top')}>{{}}</header>", f"<div {named('header', 'masthead', 'banner')}>{{}}</div>").format(pick(f"<h1>{few()}</h1>", f"<div>{few()}</div>", f"<a href='/'>{few()}</a>", f"<p>{text()}</p>") + maybe(0.4, menu))
    advert = lambda: pick(f"<div {named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{pick(text(), f'<p>{text()}</p>', f'<a href=x>{few(8)}</a>')}</div>", f"<aside {named('ad', 'promo', 'sponsored')}><p>{text()}</p></aside>", f"<ins class='adsbygoogle'>{few(9)}</ins>", f"<p {named('ad', 'advert')}>{text()}</p>")
    notice = lambda: pick(f"<div {named('notice', 'cookie', 'consent', 'alert', 'disclaimer', 'popup', 'modal', 'message')}>{pick(text(), f'<p>{text()}</p>')}{maybe(0.5, lambda: f'<button>{few(2)}</button>')}</div>", f"<p {named('notice', 'cookie', 'alert')}>{text()}</p>", f"<section {named('cookie', 'notice')}><p>{text()}</p></section>", f"<div role='alert'>{text()}</div>", f"<dialog open><p>{text()}</p></dialog>")
    form = lambda: f"<form {pick('', named('search', 'newsletter', 'signup', 'login', 'subscribe', 'form'))}>{pick('', f'<p>{text()}</p>', f'<label>{few()}</label>')}<label>{few(3)}</label><input name=q><select><option>{few(2)}<option>{few(2)}</select><textarea>{few()}</textarea><button>{few(2)}</button></form>"
    related = lambda: pick(f"<div {named('related', 'share', 'social', 'widget', 'tags', 'author', 'promoted')}>{pick('', f'<h3>{few(3)}</h3>')}{pick(f'<ul>{links()}</ul>', links(), f'<p>{text()}</p>')}</div>", f"<section {named('related', 'more')}><h2>{few(3)}</h2>{links()}</section>")
    sidebar = lambda: pick("<aside>{}</aside>", f"<aside {named('sidebar', 'side')}>{{}}</aside>", f"<div {named('sidebar', 'side', 'rail', 'widget')}>{{}}</div>").format("".join(pick(f"<h3>{few(3)}</h3>", f"<p>{text()}</p>", f"<ul>{links()}</ul>", text()) for _ in some(1, 4)))
    comment = lambda: pick(f"<div class='comment'><b>{few(2)}</b><p>{text()}</p></div>", f"<li><p>{text()}</p></li>", f"<article {named('comment', 'reply')}><p>{text()}</p></article>", f"<p>{text()}</p>", f"<div>{text()}</div>")
    comments = lambda: pick("<section {}>{}</section>", "<div {}>{}</div>", "<ol {}>{}</ol>").format(named("comments", "comment", "commentlist", "replies", "discussion", "responses"), pick("", f"<h3>{few(3)}</h3>") + "".join(comment() for _ in some(1, 6)) + maybe(0.3, form))
    footer = lambda: pick("<footer>{}</footer>", f"<footer {named('footer', 'bottom')}>{{}}</footer>", f"<div {named('footer', 'copyright', 'bottom', 'legal')}>{{}}</div>").format(pick(f"&copy; {few(9)}", f"<p>{text()}</p>", f"<ul>{links()}</ul><p>{few()}</p>", f"&copy; {few(2)} &middot; {text()}"))

    def known(tag: str, inner: str) -> str:
        return f'<{tag} data-known="1">{inner}</{tag}>'

    def paragraph() -> str:
        t = text()
        w = t.split()
        if len(w) > 6 and draw.random() < 0.3:
            t = pick(f"<b>{w[0]}</b> " + " ".join(w[1:]), " ".join(w[:3]) + f" <a href='y'>{w[3]} {w[4]}</a> " + " ".join(w[5:]), " ".join(w[:4]) + "<br>" + " ".join(w[4:]), f"<em>{t}</em>")
        return pick(known("p", t), known("p", t), known("p", t), f'<p data-known="1">{t}', known("div", t), known("blockquote", t), known("h2", few(7)), f'<ul data-known="1">{"".join(f"<li>{say(120)}</li>" for _ in some(2, 5))}</ul>', f'<p data-known="1"><b>{few(9)}<br>', known("pre", t), f'<table data-known="1"><tr><td>{few()}<td>{few()}</table>')

    inside = "".join(paragraph() + maybe(0.06, lambda: pick(advert, related, notice, form, sidebar)()) for _ in some(1, 14))
    title = maybe(0.8, lambda: pick(known("h1", few(9)), f'<header>{known("h1", few(9))}</header>', known("h1", say(60)), known("h2", few(9))))
    tail = maybe(0.15, comments) + maybe(0.15, related)
    body = title + inside + tail
    article = pick("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", f"<article {named('post', 'entry', 'story', 'article')}>{{}}</article>", f"<div {named('content', 'post', 'entry', 'article', 'story', 'body', 'text', 'main')}>{{}}</div>", f"<section {named('content', 'article', 'main')}>{{}}</section>", "<div>{}</div>").format(body)
    before = [maybe(0.5, header), maybe(0.8, menu), maybe(0.5, advert), maybe(0.35, notice), maybe(0.15, form), maybe(0.2, sidebar)]
    after = [maybe(0.4, comments), maybe(0.4, sidebar), maybe(0.3, related), maybe(0.3, advert), maybe(0.15, notice), maybe(0.15, form), maybe(0.8, footer)]
    before = [before[i] for i in draw.permutation(len(before))] if draw.random() < 0.3 else before
    if draw.random() < 0.1:
        after.append(maybe(0.5, advert))
    return f"<!DOCTYPE html><html><head><title>{few()}</title><style>p{{}}</style></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"


def trained(given: list[str]) -> Labeller | None:
    """A labeller from given pages and pages made of their texts; None where they hold no text."""
    pages = [p for p in map(blocks, given) if p]
    pool = [b[0] for p in pages for b in p]
    if not pool:
        return None
    known = [p for p in pages if any(b[4] for b in p)]
    draw = np.random.default_rng(13)
    made = [p for p in (blocks(made_page(draw, pool)) for _ in range(MADE)) if p]
    rows = [(vectors([p]), np.array([b[4] for b in p], np.float32)) for p in known + made]
    model = Labeller()
    model.train(rows)
    return model


def _extract(model: Labeller | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = batch.column("_html")
        for a in range(0, batch.num_rows, 256):
            n = min(256, batch.num_rows - a)
            pages = [blocks(html[i].as_py()) for i in range(a, a + n)]
            kept = model.label(pages) if model else [np.zeros(len(p), bool) for p in pages]
            texts = ["\n".join(b[0] for b, k in zip(p, keep, strict=True) if k).encode("utf-8", "replace").decode() for p, keep in zip(pages, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").slice(a, n), batch.column("_url").slice(a, n), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    n = pages.count()
    place = F.pmod(F.xxhash64(page_id, url), F.lit(1 << 30))
    small = pages.where(F.length(html).between(1, LONGEST)).select(F.col(html).alias("_html"), place.alias("_at")).where(F.col("_at") < F.lit(min(1.0, 3 * SAMPLE / max(n, 1)) * (1 << 30)))
    model = trained([r["_html"] for r in small.orderBy("_at", F.xxhash64("_html")).limit(SAMPLE).collect()])
    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    kinds = f"_id {pages.schema[page_id].dataType.simpleString()}, _url {pages.schema[url].dataType.simpleString()}, text string, n_chars long"
    return rows.mapInArrow(partial(_extract, model), kinds).select(F.col("_id").alias("page_id"), F.col("_url").alias("url"), "text", "n_chars")
