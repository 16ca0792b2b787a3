"""HTML main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block-level tags, each with the tags, classes and ids above it.
A bidirectional LSTM in numpy reads the blocks' vectors (hashed tag-path tokens, hashed words, a few counts) and labels each
with the whole page as context. It is trained on generated layouts (seeded, so alike everywhere) when first used; nothing
of the pages' own wording is learnt.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

#: Elements inside one another; as in browsers, a deeper one takes the place of the one beside it.
MAX_DEPTH = 512
PATH_DIMS, WORD_DIMS, COUNTS, HIDDEN = 2048, 64, 6, 24
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr br input math mi mn mo mrow ms mtext mfrac msqrt msub msup msubsup munder mover svg text tspan object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template iframe title select textarea head".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div article section main body aside nav form".split())
_OPENS = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_TO_END = re.compile(r"""(?:[^'">]++|"[^"]*"|'[^']*')*+>""")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z0-9]+")


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _name_tokens(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    for m in _ATTR.finditer(attrs):
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        out += [f".{x}" for x in _NAME.findall(value)]
    return tuple(out)


def markup(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Start, end, tag (None: nothing but markup), whether it closes, and attributes of each piece of markup, in one pass.

    A comment, script or style without an end goes on to the page's end. From the first tag on that quotes keep open to the
    page's end, tags end at the next > whatever the quotes; a < without a > behind it is text.
    """
    at, strict, cdata = 0, True, True
    while m := _OPENS.search(page, at):
        start, tag = m.start(), m[5]
        if m[1]:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        else:
            end = 0
            if m[2] and cdata:
                end = page.find("]]>", m.end()) + 3
                cdata = end > 2
            if not m[2] or not cdata:
                quoted = _TO_END.match(page, m.end()) if tag and strict else None
                strict = strict and (quoted is not None or not tag)
                end = quoted.end() if quoted else page.find(">", m.end()) + 1
                if not end:
                    return
        attrs = page[m.end() : end - 1] if tag else ""
        if tag and not m[4] and tag.lower() in _ENDS:
            closing = _ENDS[tag.lower()].search(page, end)
            end, tag = closing.end() if closing else len(page), None
        yield start, end, tag and tag.lower(), bool(m[4]), attrs
        at = end


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order; white space, br included, becomes one space; character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    state = {"link": 0, "linked": 0, "silent": 0}

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(tuple(t for _, names in stack for t in names), text, state["linked"]))
        parts.clear()
        state["linked"] = 0

    def pop_to(k: int) -> None:
        for tag, _ in stack[k:]:
            state["silent"] -= tag in SILENT
        del stack[k:]

    def text_in(s: str) -> None:
        if s and not state["silent"]:
            parts.append(s)
            if state["link"]:
                state["linked"] += len(s)

    at, page = 0, page or ""
    for start, end, tag, closing, attrs in markup(page):
        text_in(page[at:start])
        at = end
        if tag is None:
            continue
        if tag == "a":
            state["link"] = 0 if closing else 1
            continue
        if tag in INLINE:
            if tag == "br":
                text_in(" ")
            continue
        flush()
        state["link"] = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            continue
        for k in range(len(stack) - 1, -1, -1):  # tags that this one closes
            if stack[k][0] == "p" or stack[k][0] in _CLOSES.get(tag, ()):
                pop_to(k)
            elif stack[k][0] in _SCOPE:
                break
        if tag == "body":
            pop_to(0)
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            if len(stack) >= MAX_DEPTH:
                pop_to(MAX_DEPTH - 1)
            stack.append((tag, _name_tokens(tag, attrs)))
            state["silent"] += tag in SILENT
    text_in(page[at:])
    flush()
    return out


@lru_cache(maxsize=200_000)
def _slot(token: str, dims: int) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(token) % dims


def vectors(blocks: list[Block]) -> tuple[list[list[int]], np.ndarray]:
    """For each block the numbers of its path features, and a dense row of hashed words and counts."""
    path, dense = [], np.zeros((len(blocks), WORD_DIMS + COUNTS))
    cache: dict[tuple[str, ...], list[int]] = {}
    for k, b in enumerate(blocks):
        f = cache.get(b.path)
        if f is None:
            f = cache[b.path] = sorted({_slot(t, PATH_DIMS // 2) for t in b.path} | {PATH_DIMS // 2 + _slot(t, PATH_DIMS // 2) for t in b.path[-4:]})
        path.append(f)
        words = b.text.split()
        dense[k, :WORD_DIMS] = np.bincount([_slot(w, WORD_DIMS) for w in b.text.lower().split()], minlength=WORD_DIMS)[:WORD_DIMS] / len(words) ** 0.5
        n = len(b.text)
        dense[k, WORD_DIMS:] = np.log1p(n) / 8, min(1.0, b.linked / n), sum(map(b.text.count, ".,;!?")) / max(1, len(words)), np.log1p(len(words)) / 6, k / max(1, len(blocks) - 1), 1.0
    return path, dense


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """One bidirectional layer and a logistic output for each step, over padded batches."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        g = 4 * HIDDEN
        self.p = {}
        for d in "fb":
            self.p |= {f"{d}E": rng.normal(0, 0.08, (PATH_DIMS, g)), f"{d}W": rng.normal(0, 0.08, (WORD_DIMS + COUNTS, g)), f"{d}U": rng.normal(0, 0.15, (HIDDEN, g)), f"{d}b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.p |= {"V": rng.normal(0, 0.2, 2 * HIDDEN), "c": np.zeros(1)}

    def inputs(self, d: str, path: list[list[int]], dense: np.ndarray) -> np.ndarray:
        sizes = np.array([len(x) for x in path])
        out = dense @ self.p[f"{d}W"] + self.p[f"{d}b"]
        full = sizes > 0
        if full.any():
            flat = np.fromiter((i for x in path for i in x), np.int64, int(sizes.sum()))
            out[full] += np.add.reduceat(self.p[f"{d}E"][flat], (np.cumsum(sizes) - sizes)[full])
        return out

    def scan(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: steps, pages, gates. Hidden states of each step; padded steps carry the state on."""
        steps, n, _ = x.shape
        h = c = np.zeros((n, HIDDEN))
        out, kept = np.zeros((steps, n, HIDDEN)), []
        u = self.p[f"{d}U"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = x[t] + h @ u
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            a = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = f * c + i * a
            tc = np.tanh(new_c)
            if keep:
                kept.append((t, h, c, i, f, o, a, tc, m))
            c = np.where(m, new_c, c)
            h = np.where(m, o * tc, h)
            out[t] = h
        return out, kept

    def back(self, d: str, kept, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dz_all = np.zeros((*grad.shape[:2], 4 * HIDDEN))
        du = np.zeros_like(self.p[f"{d}U"])
        dh = dc = np.zeros(grad.shape[1:])
        u = self.p[f"{d}U"]
        for t, h, c, i, f, o, a, tc, m in reversed(kept):
            total = dh + grad[t]
            g = np.where(m, total, 0.0)
            do = g * tc
            dcc = np.where(m, dc, 0.0) + g * o * (1 - tc**2)
            dz = np.concatenate((dcc * a * i * (1 - i), dcc * c * f * (1 - f), do * o * (1 - o), dcc * i * (1 - a**2)), axis=1)
            dz_all[t] = dz
            du += h.T @ dz
            dh = dz @ u.T + np.where(m, 0.0, total)
            dc = np.where(m, dcc * f, dc)
        return dz_all, du

    def layout(self, pages: list[tuple[list[list[int]], np.ndarray]]):
        sizes = np.array([len(p) for p, _ in pages])
        mask = np.arange(sizes.max())[:, None] < sizes[None, :]
        path = [x for p, _ in pages for x in p]
        dense = np.concatenate([x for _, x in pages])
        page = np.repeat(np.arange(len(pages)), sizes)
        step = np.arange(len(path)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return mask, path, dense, step, page

    def forward(self, pages, keep: bool = False):
        mask, path, dense, step, page = self.layout(pages)
        hs, kept = [], {}
        for d in "fb":
            x = np.zeros((*mask.shape, 4 * HIDDEN))
            x[step, page] = self.inputs(d, path, dense)
            h, kept[d] = self.scan(d, x, mask, keep)
            hs.append(h[step, page])
        h = np.concatenate(hs, axis=1)
        return h @ self.p["V"] + self.p["c"], h, kept, (mask, path, dense, step, page)

    def train(self, pages, labels: list[np.ndarray], epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        m1, m2, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            order = order[np.argsort([len(pages[k][0]) // 8 for k in order], kind="stable")]  # little padding
            batches = [order[lo : lo + batch] for lo in range(0, len(order), batch)]
            for which in rng.permutation(len(batches)).tolist():
                pick = batches[which]
                z, h, kept, (mask, path, dense, step, page) = self.forward([pages[k] for k in pick], True)
                err = (_sigmoid(z) - np.concatenate([labels[k] for k in pick])) / len(z)
                g = {"V": h.T @ err, "c": np.array([err.sum()])}
                dh = err[:, None] * self.p["V"]
                sizes = np.array([len(x) for x in path])
                flat = np.array([i for x in path for i in x], np.int64)
                of_block, order_at = np.repeat(np.arange(len(path)), sizes), np.argsort(flat, kind="stable")
                cuts = np.nonzero(np.diff(flat[order_at], prepend=-1))[0]
                for n, d in enumerate("fb"):
                    grad = np.zeros((*mask.shape, HIDDEN))
                    grad[step, page] = dh[:, n * HIDDEN : (n + 1) * HIDDEN]
                    dz, g[f"{d}U"] = self.back(d, kept[d], grad)
                    dz = dz[step, page]
                    g[f"{d}W"], g[f"{d}b"] = dense.T @ dz, dz.sum(axis=0)
                    g[f"{d}E"] = np.zeros_like(self.p[f"{d}E"])
                    g[f"{d}E"][flat[order_at[cuts]]] = np.add.reduceat(dz[of_block[order_at]], cuts)
                t += 1
                for k, v in g.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)

    def label(self, pages, batch_steps: int = 20_000) -> list[np.ndarray]:
        """Which blocks are main text; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k][0])), key=lambda k: len(pages[k][0]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * len(pages[order[hi]][0]) <= batch_steps:
                hi += 1
            z, _, _, (_, _, _, _, page) = self.forward([pages[k] for k in order[lo:hi]])
            for n, k in enumerate(order[lo:hi]):
                out[k] = z[page == n] > 0
            lo = hi
        return out


# Generated layouts. Names are common ones of page templates; a wrapper of a kind has one or more of them.
_MAIN = "article main content post entry story body text markdown prose article-body post-content entry-content main-content article__body story-text page-content richtext".split()
_NOISE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar menubar toc pagination pager tabs submenu mainmenu skip links".split(),
    "header": "header masthead site-header top banner logo branding page-header topnav hero".split(),
    "footer": "footer site-footer bottom copyright legal colophon imprint credits page-footer".split(),
    "aside": "aside sidebar side rail widget related recommended popular trending archive tags tagcloud teaser promo more-stories see-also".split(),
    "notice": "cookie cookies consent notice gdpr banner alert notification cookie-banner popup modal overlay paywall disclaimer privacy warning".split(),
    "ad": "ad ads advert advertisement sponsored sponsor adsbygoogle promo adbox ad-slot promotion commercial adunit".split(),
    "form": "form search newsletter subscribe signup login searchbox contact-form register poll survey feedback".split(),
    "comments": "comments comment comment-list replies reply discussion disqus respond thread reader-comments user-comments commentary responses".split(),
    "share": "share social sharing buttons toolbar follow author byline meta postmeta caption-credit timestamp rating".split(),
}


def generated_page(rng: np.random.Generator) -> str:
    """A page; blocks of main text have the attribute data-main, which features never see."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, int(rng.integers(1, 10))))
    words = lambda lo, hi: " ".join(word() for _ in range(int(rng.integers(lo, hi))))
    sentence = lambda: (words(1, 25).capitalize() + pick([".", ".", ".", "!", "?", ""]) if rng.random() < 0.93 else words(1, 3))

    def named(tag: str, names: list[str]) -> str:
        kind = pick(["class", "class", "class", "id"])
        extra = " " + word() if rng.random() < 0.3 else ""
        return f'{tag} {kind}="{pick(names)}{extra}"'

    def noise(kind: str) -> str:
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        names = _NOISE[kind]
        tag = own if own and rng.random() < 0.6 else pick(["div", "div", "section", "ul"] if kind == "nav" else ["div", "div", "section"])
        open_tag = tag if tag == own and rng.random() < 0.5 else named(tag, names)
        rows = []
        for _ in range(int(rng.integers(1, 6))):
            r = rng.random()
            if kind in ("nav", "aside", "footer", "share") and r < 0.55:
                rows.append("<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(int(rng.integers(1, 7)))) + "</ul>")
            elif kind == "form":
                rows.append(f"<label>{words(1, 3)}</label><input><button>{word()}</button><p>{sentence()}</p>")
            elif kind == "comments":
                rows.append(f'<div class="{pick(names)}"><h4>{words(1, 3)}</h4>' + "".join(f"<p>{sentence()} {sentence()}</p>" for _ in range(int(rng.integers(1, 4)))) + "</div>")
            elif r < 0.5:
                rows.append(f"<p>{sentence()}</p>")
            elif r < 0.7:
                rows.append(f"<h3>{words(1, 6)}</h3>")
            else:
                rows.append(sentence())
        if kind == "ad" and rng.random() < 0.6:
            rows = [sentence()]
        if kind == "notice" and rng.random() < 0.2:
            return f"<noscript>{sentence()}</noscript>"
        return f"<{open_tag}>{''.join(rows)}</{tag}>"

    def main() -> str:
        rows = [f"<h1 data-main>{words(1, 9)}</h1>"] if rng.random() < 0.8 else []
        if rng.random() < 0.2:
            rows.append(noise("share"))
        for _ in range(int(rng.integers(1, 14))):
            r = rng.random()
            body = " ".join(sentence() for _ in range(int(rng.integers(1, 5))))
            if rng.random() < 0.1:
                body = f'<b>{body}</b> <a href="/{word()}">{words(1, 3)}</a>'
            if r < 0.72:
                rows.append(f"<p data-main>{body}</p>")
            elif r < 0.8:
                rows.append(f"<h2 data-main>{words(1, 7)}</h2>")
            elif r < 0.85:
                rows.append("<ul>" + "".join(f"<li data-main>{sentence()}</li>" for _ in range(int(rng.integers(1, 6)))) + "</ul>")
            elif r < 0.89:
                rows.append(f"<blockquote><p data-main>{body}</p></blockquote>")
            elif r < 0.92:
                rows.append("<table>" + "".join(f"<tr><td data-main>{words(1, 3)}</td><td data-main>{words(1, 3)}</td></tr>" for _ in range(2)) + "</table>")
            elif r < 0.935:
                rows.append(f"<pre data-main>{body}</pre>")
            elif r < 0.94:
                rows.append(f"<noscript><p data-main>{body}</p></noscript>")
            else:
                rows.append(noise(pick(["ad", "aside", "form", "share", "nav", "notice"])))
        if rng.random() < 0.15:
            rows.append(noise("comments"))
        inner = "".join(rows)
        r = rng.random()
        if r < 0.45:
            return f"<article>{inner}</article>"
        if r < 0.55:
            return f"<main>{inner}</main>"
        if r < 0.7:
            return f"<{named('article', _MAIN)}>{inner}</article>"
        if r < 0.8:
            return f"<main><{named('div', _MAIN)}>{inner}</div></main>"
        return f"<{named('div', _MAIN)}>{inner}</div>"

    before = [noise(k) for k in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.45]
    after = [noise(k) for k in ("aside", "comments", "ad", "share", "form", "notice", "footer") if rng.random() < 0.4]
    if rng.random() < 0.2:
        before.append(noise("aside"))
    middle = main() if rng.random() < 0.96 else ""
    page = "".join((*before, middle, *after))
    if rng.random() < 0.3:
        page = f"<{named('div', ['wrapper', 'container', 'page', 'site', 'layout', 'root', 'app'])}>{page}</div>"
    return f"<html><body>{page}</body></html>"


def _marked(page: str) -> tuple[list[Block], np.ndarray]:
    blocks = blocks_of(page.replace(" data-main", ' role="xmainx"'))
    return [Block(tuple(t for t in b.path if t != ".xmainx"), b.text, b.linked) for b in blocks], np.array([float(".xmainx" in b.path) for b in blocks])


@lru_cache(maxsize=1)
def trained(pages: int = 1200, seed: int = 17) -> BiLSTM:
    """The labeller, trained on generated layouts in a few seconds; the driver does so and sends the weights to tasks."""
    rng = np.random.default_rng(seed)
    made = [m for m in (_marked(generated_page(rng)) for _ in range(pages)) if m[0]]
    net = BiLSTM()
    net.train([vectors(b) for b, _ in made], [y for _, y in made])
    return net


def main_texts(net: BiLSTM, pages: list[str | None]) -> list[str]:
    blocks = [blocks_of(p) for p in pages]
    marks = net.label([vectors(b) for b in blocks])
    return ["\n".join(x.text for x, m in zip(b, y.tolist(), strict=True) if m) for b, y in zip(blocks, marks, strict=True)]


def extract(pages: DataFrame, html_col: str = "html", net: BiLSTM | None = None) -> DataFrame:
    """Adds text (main text, blocks joined by line feeds; empty if there is none) and n_chars to every row but for the HTML,
    in place of columns of these names. Null HTML counts as empty; repeated rows give repeated results; an empty table gives
    an empty one; broken markup is read as far as it goes. No shuffle; memory is one slice of pages."""
    shared = pages.sparkSession.sparkContext.broadcast((net or trained()).p)
    base = pages.drop(*[c for c in pages.columns if c.lower() in ("text", "n_chars") and c != html_col])
    kept = [f for f in base.schema.fields if f.name != html_col]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "text string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        net = BiLSTM.__new__(BiLSTM)
        net.p = shared.value
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(main_texts(net, batch.column(html_col).to_pylist()), pa.string())], names=[*(f.name for f in kept), "text"])

    return base.mapInArrow(map_slices(run, html_col, 8 << 20), schema).withColumn("n_chars", F.length("text").cast("long"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html")))
