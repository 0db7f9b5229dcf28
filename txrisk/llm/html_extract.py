"""Main-text extraction by a recurrent block labeller.

A page is cut into its leaf blocks (runs of text between block-level tags).  Every block becomes a vector: the
mean embedding of its tag path (tags, class and id words of its ancestors), the mean embedding of its hashed
words, and a few shape numbers.  A bidirectional LSTM in numpy reads the blocks of the whole page in order and
labels each as main text or not; the main blocks are joined.

The model is trained here, jointly with the embeddings, on labelled pages that a seeded generator writes from
page skeletons (articles in several kinds of container, with menus, headers, footers, sidebars, notices,
adverts, forms and reader comments around and inside them).  Nothing of the pages table is used for training.

Defined cases: a null or empty html has no blocks and an empty text; unclosed tags, comments and scripts run to
the end of the page; a self-closed svg and a noscript without text are empty, the text of another noscript is
blocks of its own; repeated and null page_ids give one row per input row; an empty table gives no rows; other
columns are ignored.  No block is shortened and no page cut.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 2048, 12, 6, 6, 16
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:svg(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*/>|noscript(?=[\s/>])[^>]*>(?:\s|<(?!/?noscript)[^>]*>)*</noscript\s*>|(script|style|template|svg|iframe|title|select|textarea)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|$))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?|<[!?/][^>]*>?|<|[^<]+", re.S | re.I)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
#: Opening the first closes an open second one.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_WALLS = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "nav", "aside", "form"}


#: Padded (step, page) places of a batch of pages.
CELLS = 1 << 14


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of the leaf blocks in page order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            if whole and not any(t == "head" for t, _ in stack):
                out.append((tuple(x for t, names in stack if t not in INLINE for x in names), whole, linked))
            text.clear()
        linked = 0

    def pop_to(k: int) -> None:
        if any(t not in INLINE for t, _ in stack[k:]):
            flush()
        del stack[k:]

    for m in _TOKEN.finditer(page):
        raw, tag = m.group(0), m.group(3)
        if tag is None:
            if raw[0] != "<" or raw == "<":
                part = html_lib.unescape(raw)
                text.append(part)
                if any(t == "a" for t, _ in stack):
                    linked += len(part.strip())
            elif raw[1].isalpha():  # a skipped element
                text.append(" ")
            continue
        tag = tag.lower()
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if stack[k][0] in _WALLS and tag in INLINE | {"p"}:
                    break
            if tag not in INLINE:
                flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            closes = CLOSES.get(tag, set()) | ({"p"} if tag not in ("td", "th", "tr", "noscript") and "-" not in tag else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    pop_to(k)
                    break
                if stack[k][0] in _WALLS:
                    break
        if tag in VOID:
            continue
        names = [tag]
        if m.group(4):
            for a in _ATTR.findall(m.group(4)):
                names += ["." + w for w in _NAME.findall("".join(a).lower())]
        stack.append((tag, tuple(names)))
    flush()
    return out


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


class _Buckets(dict):
    """Buckets of words met so far; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        k = self[word] = bucket(word.strip(".,;:!?\"'()").lower())
        return k


_BUCKETS = _Buckets()


class Pages:
    """Blocks of several pages as arrays for the network."""

    def __init__(self, pages: list[list[tuple[tuple[str, ...], str, int]]]):
        self.sizes = np.array([len(p) for p in pages], np.int64)
        path, path_n, word, word_n, shape = [], [], [], [], []
        for p in pages:
            for k, (names, text, linked) in enumerate(p):
                own = [bucket("/" + x) for x in names] + [bucket(f"//{names[-1] if names else ''}")]
                words = [_BUCKETS[w] for w in text.split()] or [0]
                path += own
                path_n.append(len(own))
                word += words
                word_n.append(len(words))
                n = len(text)
                shape.append((min(1.0, linked / n), np.log1p(n) / 6, np.log1p(len(words)) / 4, min(1.0, 10 * sum(text.count(c) for c in ".,;:!?") / n), k / len(p), 1.0))
        self.path, self.path_at, self.path_n = np.array(path, np.int64), np.concatenate(([0], np.cumsum(path_n)[:-1])).astype(np.int64), np.array(path_n)
        self.word, self.word_at, self.word_n = np.array(word, np.int64), np.concatenate(([0], np.cumsum(word_n)[:-1])).astype(np.int64), np.array(word_n)
        self.shape = np.array(shape, np.float64).reshape(-1, SHAPE_DIM)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, two LSTMs and a logistic output."""

    def __init__(self, seed: int = 5):
        r, d = np.random.default_rng(seed), PATH_DIM + WORD_DIM + SHAPE_DIM
        self.p = {"path": r.normal(0, 0.3, (BUCKETS, PATH_DIM)), "word": r.normal(0, 0.1, (BUCKETS, WORD_DIM)), "out": r.normal(0, 0.3, 2 * HIDDEN), "off": np.zeros(1)}
        for way in "fb":
            self.p[f"w{way}"] = r.normal(0, 0.25, (d + HIDDEN, 4 * HIDDEN))
            self.p[f"c{way}"] = np.concatenate((np.ones(HIDDEN), np.zeros(3 * HIDDEN)))

    def inputs(self, g: Pages) -> np.ndarray:
        a = np.add.reduceat(self.p["path"][g.path], g.path_at, axis=0) / g.path_n[:, None]
        b = np.add.reduceat(self.p["word"][g.word], g.word_at, axis=0) / g.word_n[:, None]
        return np.concatenate((a, b, g.shape), 1)

    def _lay(self, g: Pages) -> tuple[np.ndarray, np.ndarray]:
        """Place (step, page) of every block."""
        page = np.repeat(np.arange(len(g.sizes)), g.sizes)
        return np.arange(len(page)) - np.repeat(np.cumsum(g.sizes) - g.sizes, g.sizes), page

    def _run(self, x: np.ndarray, live: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """Outputs of one direction; with ``keep`` also what training needs of every step."""
        steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN))
        out, tape = np.zeros((*x.shape[:2], HIDDEN)), []
        w, bias = self.p[f"w{way}"], self.p[f"c{way}"]
        for t in steps:
            z_in = np.concatenate((x[t], h), 1)
            z = z_in @ w + bias
            f, i, o, g = (_sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :]))
            m = live[t][:, None]
            new_c = np.where(m, f * c + i * g, c)
            tanh = np.tanh(new_c)
            new_h = np.where(m, o * tanh, h)
            if keep:
                tape.append((t, z_in, f, i, o, g, c, tanh, m))
            c, h = new_c, new_h
            out[t] = h
        return out, tape

    def logits(self, g: Pages, tape: bool = False):
        t, page = self._lay(g)
        x = np.zeros((int(g.sizes.max()), len(g.sizes), PATH_DIM + WORD_DIM + SHAPE_DIM))
        x[t, page] = self.inputs(g)
        live = np.zeros(x.shape[:2], bool)
        live[t, page] = True
        hf, tf = self._run(x, live, "f", tape)
        hb, tb = self._run(x, live, "b", tape)
        h = np.concatenate((hf, hb), 2)[t, page]
        z = h @ self.p["out"] + self.p["off"]
        return (z, h, x, t, page, tf, tb) if tape else z

    def gradients(self, g: Pages, y: np.ndarray) -> dict[str, np.ndarray]:
        z, h, x, t, page, tf, tb = self.logits(g, True)
        d = (_sigmoid(z) - y) / len(y)
        grad = {"out": h.T @ d, "off": np.array([d.sum()])}
        dh = np.zeros((*x.shape[:2], 2 * HIDDEN))
        dh[t, page] = d[:, None] * self.p["out"]
        dx = np.zeros_like(x)
        for way, tape, part in (("f", tf, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, None))):
            w = self.p[f"w{way}"]
            gw, gc = np.zeros_like(w), np.zeros_like(self.p[f"c{way}"])
            next_h = next_c = np.zeros((x.shape[1], HIDDEN))
            for s, z_in, f, i, o, gg, c, tanh, m in reversed(tape):
                a = next_h + dh[s][:, part]
                dc = next_c + np.where(m, a * o * (1 - tanh * tanh), 0)
                dz = np.concatenate((dc * c * f * (1 - f), dc * gg * i * (1 - i), a * tanh * o * (1 - o), dc * i * (1 - gg * gg)), 1) * m
                gw += z_in.T @ dz
                gc += dz.sum(0)
                back = dz @ w.T
                dx[s] += back[:, : x.shape[2]]
                next_h = np.where(m, back[:, x.shape[2] :], next_h + dh[s][:, part])
                next_c = np.where(m, dc * f, next_c)
            grad[f"w{way}"], grad[f"c{way}"] = gw, gc
        dv = dx[t, page]
        for name, ids, n, cols in (("path", g.path, g.path_n, slice(0, PATH_DIM)), ("word", g.word, g.word_n, slice(PATH_DIM, PATH_DIM + WORD_DIM))):
            owner, per = np.repeat(np.arange(len(n)), n), dv[:, cols] / n[:, None]
            grad[name] = np.stack([np.bincount(ids, per[owner, k], minlength=BUCKETS) for k in range(per.shape[1])], 1)
        return grad

    def fit(self, pages: list[tuple[list, list[int]]], epochs: int = 10, batch: int = 32, rate: float = 0.02, seed: int = 9) -> "Labeller":
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in "mv")
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for s in range(0, len(order), batch):
                rows = [pages[i] for i in order[s : s + batch]]
                grad = self.gradients(Pages([b for b, _ in rows]), np.array([t for _, y in rows for t in y], float))
                norm = np.sqrt(sum(float((q * q).sum()) for q in grad.values()))
                step += 1
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, q in grad.items():
                    q = q * min(1.0, 1 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    self.p[k] -= rate * fix * m[k] / (np.sqrt(v[k]) + 1e-8)
        return self

    def main_text(self, pages: list[list[tuple[tuple[str, ...], str, int]]]) -> list[str]:
        out = [""] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        s = 0
        while s < len(order):  # pages of like length share a batch, of at most 64 pages and CELLS padded places (one page at least)
            e = s + 1
            while e < min(s + 64, len(order)) and (e + 1 - s) * len(pages[order[e]]) <= CELLS:
                e += 1
            own, s = order[s:e], e
            take = self.logits(Pages([pages[i] for i in own])) > 0
            at = 0
            for i in own:
                out[i] = "\n\n".join(t for (_, t, _), k in zip(pages[i], take[at : at + len(pages[i])], strict=True) if k)
                at += len(pages[i])
        return out


#: The parts of the training pages.
CONTAINERS = ["article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="entry"', 'div class="article-text"', 'div role="main"', "article class=\"story\""]
MENUS = ["nav", 'div class="menu"', 'ul class="navigation"', 'div id="navbar"', 'div class="breadcrumb"']
TOPS = ["header", 'div id="header"', 'div class="masthead"', 'div class="banner"']
BOTTOMS = ["footer", 'div id="footer"', 'div class="site-footer"', 'div class="copyright"']
SIDES = ["aside", 'div class="sidebar"', 'div id="related"', 'div class="widget"', 'section class="related-links"']
ADVERTS = ['div class="ad"', 'div class="advert"', 'div id="sponsored"', 'div class="ads banner"', 'div class="promo"']
NOTICES = ['div class="cookie-notice"', 'div id="gdpr"', 'div class="notice"', 'div class="newsletter"', 'div class="popup"']
REMARKS = ['div class="comments"', 'ol class="comment-list"', 'section id="comments"', 'div class="reply"', 'div class="user-comments"']
CUES = {
    "menu": "home news about contact login search archive".split(), "top": "welcome site daily logo".split(), "bottom": "copyright rights reserved terms privacy imprint".split(),
    "side": "related more latest popular tags".split(), "ad": "buy now sponsored offer sale advertisement".split(), "notice": "cookies accept consent subscribe newsletter email".split(),
    "remark": "reply said comment thanks agree posted".split(), "form": "name email send submit password".split(),
}


def training_page(r: np.random.Generator) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks."""
    letters = list("aeioubcdfglmnprstvéäöñ")

    def prose(low: int, high: int) -> str:
        n = int(r.integers(low, high))
        words = ["".join(r.choice(letters, int(r.integers(2, 9)))) for _ in range(n)]
        return " ".join(w.capitalize() if i == 0 else w + ("." if r.random() < 0.1 else "," if r.random() < 0.1 else "") for i, w in enumerate(words)) + "."

    def pick(kinds: list[str]) -> tuple[str, str]:
        k = kinds[int(r.integers(len(kinds)))]
        return f"<{k}>", f"</{k.split()[0]}>"

    def cue(kind: str, long: bool) -> str:
        words = [str(x) for x in r.choice(CUES[kind], int(r.integers(0, 4)))]
        text = " ".join([*words, prose(1, 25 if long else 4)])
        return text.rstrip(".") if r.random() < 0.5 else text

    def aside(kinds: list[str], kind: str, tag: str, links: bool) -> str:
        a, b = pick(kinds)
        if r.random() < 0.3:
            return a + cue(kind, True) + b
        body = "".join(f"<{tag}>" + (f'<a href="/x">{cue(kind, False)}</a>' if links else cue(kind, True)) + f"</{tag}>" for _ in range(int(r.integers(1, 7))))
        return a + (f"<ul>{body}</ul>" if tag == "li" else body) + b

    main: set[str] = set()

    def block() -> str:
        t = prose(1, 90 if r.random() < 0.8 else 4)
        main.add(t)
        k = r.random()
        if k < 0.1:
            return f"<p><b>{t}<br>"
        if k < 0.2:
            return f"<h2>{t}</h2>"
        if k < 0.27:
            return f"<ul><li>{t}</li></ul>"
        if k < 0.34:
            return f"<blockquote>{t}</blockquote>"
        if k < 0.4:
            return f"<div>{t}</div>"
        if k < 0.45:
            return f"<table><tr><td>{t}</td></tr></table>"
        return f"<p>{t}</p>" if r.random() < 0.8 else f'<p><a href="/y">{t}</a></p>'

    noise = {
        "menu": lambda: aside(MENUS, "menu", "li", True), "ad": lambda: aside(ADVERTS, "ad", "p", bool(r.random() < 0.5)), "notice": lambda: aside(NOTICES, "notice", "p", False),
        "side": lambda: aside(SIDES, "side", "li", True), "remark": lambda: aside(REMARKS, "remark", "p" if r.random() < 0.5 else "div", False),
        "form": lambda: f"<form><label>{cue('form', False)}</label><input><button>{cue('form', False)}</button></form>",
        "top": lambda: aside(TOPS, "top", "p", False), "bottom": lambda: aside(BOTTOMS, "bottom", "p", False),
    }
    a, b = pick(CONTAINERS)
    title = prose(2, 12)
    inner = []
    if r.random() < 0.8:
        main.add(title)
        inner.append(f"<h1>{title}</h1>")
    for _ in range(int(r.integers(1, 14))):
        inner.append(block())
        if r.random() < 0.08:
            inner.append(noise[str(r.choice(["ad", "side", "notice", "form"]))]())
    before = [noise[k]() for k in ("top", "menu", "ad", "notice", "side", "form") if r.random() < 0.45]
    after = [noise[k]() for k in ("remark", "side", "ad", "form", "notice", "bottom") if r.random() < 0.45]
    wrap = ('<div class="page">', "</div>") if r.random() < 0.4 else ("", "")
    return f"<html><head><title>{title}</title></head><body>{wrap[0]}{''.join(before)}{a}{''.join(inner)}{b}{''.join(after)}{wrap[1]}</body></html>", main


def train(pages: int = 1000, seed: int = 17) -> Labeller:
    r, data = np.random.default_rng(seed), []
    for _ in range(pages):
        page, main = training_page(r)
        blocks = blocks_of(page)
        data.append((blocks, [int(t in main) for _, t, _ in blocks]))
    return Labeller().fit([d for d in data if d[0]])


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out: list[str] = []
            for s in range(0, b.num_rows, 512):
                out += model.main_text([blocks_of(x or "") for x in b.column("html").slice(s, 512).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row."""
    kinds = dict(pages.select("page_id", "url").dtypes)
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    src = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return src.mapInArrow(_extract(shared), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
