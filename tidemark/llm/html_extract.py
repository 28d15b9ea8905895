"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks.  Each block becomes a vector: hashed steps of its tag path, hashed words, and a few
lengths and rates.  A bidirectional LSTM reads the sequence of a page's blocks and labels each as article or not, with
the whole page as context.

The model is trained here on a bounded sample of pages.  Pages that mark their article (``article`` or ``main``) give
labels by their own markup.  From the same pages' texts, new pages are laid out with the furniture of other sites
(menus, notices, adverts, forms, sidebars, comments, in semantic tags or in named ``div``s), so that the labeller does
not depend on one template.  Labelling is one pass over the pages with no shuffle.
"""

from __future__ import annotations

import html
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, lean
from tidemark.llm.html_blocks import Block, blocks
from tidemark.llm.lstm import Labeller, padded
from tidemark.llm.wordhash import spans, word_hashes
from tidemark.shipping import ship

#: Pages that fit the model, at most: those with the least hash of their id, whole and of any length.
SAMPLE = 250
#: Blocks of a training sequence: a longer page gives several, one after the other.
SEQUENCE = 2_000
LAID_OUT, EPOCHS, HIDDEN, SEED = 1200, 12, 20, 5
PATH_BINS, NEAR_BINS, WORD_BINS, RATES = 128, 32, 24, 8
WIDTH = PATH_BINS + NEAR_BINS + WORD_BINS + RATES
#: Blocks that are labelled together, padding included.
CELLS = 20_000
#: Marks in laid-out texts (private-use characters, taken out of what pages hold themselves).
ARTICLE, OTHER = "\ue000", "\ue001"

_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _paths:
        if len(_paths) > 20_000:
            _paths.clear()
        v = np.zeros(PATH_BINS + NEAR_BINS, np.float32)
        for step in path:
            for word in step.split():
                if word not in ("html", "body"):
                    v[zlib.crc32(word.encode()) % PATH_BINS] = 1
        for word in path[-1].split() if path else ():
            v[PATH_BINS + zlib.crc32(b"near " + word.encode()) % NEAR_BINS] = 1
        _paths[path] = v
    return _paths[path]


def vectors(pages: list[list[Block]], begin: int = 0, total: int = 0) -> np.ndarray:
    """One row per block of all pages, in order; ``begin`` and ``total`` tell where blocks stand that are part of a page."""
    every = [b for p in pages for b in p]
    if not every:
        return np.zeros((0, WIDTH), np.float32)
    out = np.zeros((len(every), WIDTH), np.float32)
    texts = [b.text.encode("utf-8", "surrogatepass") for b in every]
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, stops = spans(data)
    owner = np.searchsorted(ends, starts, "right")
    bins = (word_hashes(data, starts, stops) % np.uint64(WORD_BINS)).astype(np.int64)
    n_words = np.maximum(np.bincount(owner, minlength=len(every)), 1)
    counts = np.bincount(owner * WORD_BINS + bins, minlength=len(every) * WORD_BINS).reshape(-1, WORD_BINS)
    out[:, PATH_BINS + NEAR_BINS : -RATES] = counts / n_words[:, None]
    out[:, : PATH_BINS + NEAR_BINS] = [_path_vector(b.path) for b in every]
    chars = np.array([len(b.text) for b in every], np.float32)
    sizes = np.array([len(t) for t in texts], np.float32)
    place = np.concatenate([(begin + np.arange(len(p), dtype=np.float32)) / (total or len(p)) for p in pages if p])
    out[:, -RATES:] = np.stack(
        [
            np.log1p(chars) / 8, np.log1p(n_words) / 6, np.array([b.link_chars for b in every], np.float32) / np.maximum(chars, 1),
            np.array([t.count(b".") + t.count(b",") for t in texts], np.float32) / n_words, chars > 200, place,
            np.array([len(b.path) for b in every], np.float32) / 8, (sizes - chars) / np.maximum(chars, 1),
        ],
        axis=1,
    )
    return out


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which of its blocks are article."""
    out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
    order, i = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k])), 0
    while order and len(pages[order[-1]]) > CELLS:
        # a page of very many blocks, read in slices
        own = pages[k := order.pop()]
        out[k] = model.margins_in_slices(len(own), CELLS, lambda a, b, own=own: vectors([own[a:b]], a, len(own))) > 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * len(pages[order[j]]) <= CELLS:
            j += 1
        some = order[i:j]
        margins = model.margins(*padded([vectors([pages[k]]) for k in some]))
        for column, k in enumerate(some):
            out[k] = margins[: len(pages[k]), column] > 0
        i = j
    return out


class Layouts:
    """Lays out pages with known labels from the texts of others."""

    NEUTRAL = "wrapper container page site row col layout inner outer grid box root app".split()
    HOLDERS = ['<article class="{}">', '<main id="{}">', '<article>', '<main>', '<div class="{}">', '<section class="{}">', '<div id="{}">', "<div role='main' class='{}'>"]
    HOLDER_NAMES = "content article-body post entry-content story post-content main-content article text body-copy single".split()
    FURNITURE = {
        "menu": ["<nav>", '<div class="menu">', '<ul class="navbar">', '<div id="main-nav">', '<div class="breadcrumb">', '<nav class="toc">', '<div role="navigation">', '<div class="pagination">', '<ul class="tags">'],
        "header": ["<header>", '<div id="header">', '<div class="masthead">', '<header class="site-header">', '<div class="top-bar">', '<div class="banner logo">'],
        "footer": ["<footer>", '<div id="footer">', '<div class="site-footer">', '<footer class="bottom">', '<div class="copyright">', '<div class="legal">'],
        "sidebar": ["<aside>", '<div class="sidebar">', '<aside id="related">', '<div class="widget">', '<div class="related-posts">', '<section class="recommended">', '<div class="share social">', '<div class="trending">', '<div class="author-box">'],
        "notice": ['<div class="notice">', '<div id="cookie-notice">', '<div class="cookie-banner">', '<div class="alert">', '<div class="gdpr consent">', '<section class="announcement">', '<div role="alert">', '<dialog class="popup modal">', '<div class="paywall">', '<div class="disclaimer">'],
        "advert": ['<div class="ad">', '<div class="advert">', '<div id="ads">', '<aside class="sponsored">', '<div class="promo">', '<ins class="adsbygoogle">', '<div class="ad-slot banner">', '<div class="advertisement">', '<section class="sponsor">'],
        "form": ["<form>", '<form class="newsletter">', '<form id="search">', '<div class="subscribe signup">', '<form action="/login">', '<div class="contact-form">'],
        "comments": ['<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<ol class="commentlist">', '<div id="disqus">', '<section id="responses">', '<div class="reader-comments">', '<div class="replies discussion">'],
    }

    def __init__(self, prose: list[str], short: list[str], seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.prose, self.short = prose or ["One line of text, and another."], short or ["Home", "About", "More"]

    def one(self, values: list[str]) -> str:
        return values[int(self.rng.integers(len(values)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, mark: str, long: bool) -> str:
        return mark + html.escape(self.one(self.prose if long else self.short), quote=False)

    def furniture(self, kind: str) -> str:
        opened = self.one(self.FURNITURE[kind])
        if kind in ("menu", "header", "footer") and self.chance(0.15):
            opened = f'<div class="{self.name()}">'
        tag = opened[1:].split(" ")[0].rstrip(">")
        inner = []
        for _ in range(int(self.rng.integers(1, 7 if kind in ("menu", "comments", "sidebar") else 4))):
            long = self.chance({"comments": 0.8, "sidebar": 0.4, "notice": 0.5, "advert": 0.5}.get(kind, 0.15))
            text = self.words(OTHER, long)
            if kind == "comments":
                inner.append(self.one(['<div class="comment"><p>{}</p></div>', "<p>{}</p>", '<li class="comment">{}</li>', '<article class="comment"><p>{}</p></article>', '<div class="reply">{}</div>']).format(text))
            elif kind == "form":
                inner.append(self.one(["<label>{}</label><br>", "<p>{}</p>", "<button>{}</button>", "<div>{}</div>"]).format(text))
            elif kind in ("menu", "footer", "sidebar", "header") and not long:
                inner.append(self.one(['<li><a href="/x">{}</a></li>', '<a href="/x">{}</a> ', "<p>{}</p>", "<span>{}</span> ", '<div><a href="/y">{}</a></div>', "<h3>{}</h3>"]).format(text))
            else:
                inner.append(self.one(["<p>{}</p>", "{}", "<div>{}</div>", "<p><b>{}</b></p>"]).format(text))
        return f"{opened}{''.join(inner)}</{tag}>"

    def name(self) -> str:
        """A name that says nothing."""
        return "".join(self.one(list("bcdfgklmnprstvz")) + self.one(list("aeiou")) for _ in range(int(self.rng.integers(2, 5))))

    def article(self) -> str:
        if self.chance(0.12):
            return self.bare()
        opened = self.one(self.HOLDERS).format(self.one(self.HOLDER_NAMES) if self.chance(0.6) else self.name())
        if self.chance(0.15):
            opened = self.one(["<div>", "<section>", '<section role="main">', "<center>"])
        tag = opened[1:].split(" ")[0].rstrip(">")
        parts = [f"<h1>{self.words(ARTICLE, False)}</h1>"] if self.chance(0.7) else []
        for _ in range(int(self.rng.integers(1, 12))):
            text = self.words(ARTICLE, self.chance(0.8))
            forms = ["<p>{}</p>"] * 8 + ["<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<div><p>{}</p></div>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", '<p>{} <a href="/z">x</a></p>', "<section><p>{}</p></section>", "<figure><figcaption>{}</figcaption></figure>", "<h3>{}</h3>", "<ol><li>{}</ol>"]
            parts.append(self.one(forms).format(text))
            if self.chance(0.12):
                parts.append(self.furniture(self.one(["advert", "sidebar", "form", "notice", "menu"])))
        return f"{opened}{''.join(parts)}</{tag}>"

    def bare(self) -> str:
        """An article without an element of its own."""
        parts = [f"<h1>{self.words(ARTICLE, False)}</h1>"] if self.chance(0.6) else []
        forms = ["<p>{}</p>", "<p>{}", "{}<br><br>", "<div>{}</div>", "<font size=2>{}</font><p>"]
        form = self.one(forms)
        return "".join([*parts, *(form.format(self.words(ARTICLE, True)) for _ in range(int(self.rng.integers(1, 8))))])

    def table(self, before: list[str], article: str, after: list[str]) -> str:
        """A page laid out as a table: menu cells beside or above the article's cell."""
        links = lambda: "".join(self.one(['<a href="/x">{}</a><br>', '<a href="/x">{}</a> | ', "<b>{}</b><br>", '<font size=1><a href="/x">{}</a></font> ', "{} "]).format(self.words(OTHER, False)) for _ in range(int(self.rng.integers(1, 7))))
        menu, body, side = f"<td>{links()}</td>", f"<td>{article}</td>", f"<td>{links()}</td>" if self.chance(0.4) else ""
        top = f"<tr><td>{links()}</td></tr>" if self.chance(0.5) else ""
        bottom = f"<tr><td>{self.one(['<center>{}</center>', '<font size=1>{}</font>', '{}']).format(self.words(OTHER, self.chance(0.3)))}</td></tr>" if self.chance(0.5) else ""
        rows = f"<tr>{menu}{body}{side}</tr>" if self.chance(0.7) else f"<tr>{menu}</tr><tr>{body}</tr>"
        return f"<html><body>{''.join(before)}<table width='100%'>{top}{rows}{bottom}</table>{''.join(after)}</body></html>"

    def page(self) -> str:
        before = [k for k in ("notice", "header", "menu", "advert", "form", "sidebar", "menu") if self.chance(0.4)]
        after = [k for k in ("comments", "sidebar", "advert", "form", "menu", "notice", "footer") if self.chance(0.45)]
        parts = [*map(self.furniture, before), self.article() if self.chance(0.97) else "", *map(self.furniture, after)]
        if self.chance(0.12):
            return self.table([*map(self.furniture, before)], self.article() if self.chance(0.3) else self.bare(), [*map(self.furniture, after)])
        wraps = int(self.rng.integers(0, 3))
        opened = "".join(f'<div class="{self.one(self.NEUTRAL)}">' for _ in range(wraps))
        return f"<html><body>{opened}{''.join(parts)}{'</div>' * wraps if self.chance(0.9) else ''}</body></html>"


def _unmarked(text: str) -> str:
    return text.replace(ARTICLE, "").replace(OTHER, "")


def train(df: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """Fits the labeller to at most ``sample`` pages and to pages laid out from their texts."""
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("pages"))
    known = df.where(F.length(html_col) > 0).select(order.alias("place"), F.col(html_col).alias("html"))
    rows = bounded_sample(known, "place", sample).collect()
    own, marks, prose, short = [], [], [], []
    for r in rows:
        page = blocks(r["html"])
        inside = np.array([any(s.split()[0] in ("article", "main") for s in b.path) and not any(s.split()[0] in ("nav", "aside", "footer", "form") for s in b.path) for b in page], bool)
        if inside.any():
            own.append(page)
            marks.append(inside.astype(np.float32))
        for b in page:
            (prose if len(b.text) > 60 else short).append(_unmarked(b.text))
    layouts = Layouts(prose, short, SEED)
    for _ in range(LAID_OUT):
        page = blocks(layouts.page())
        if page:
            own.append([Block(_unmarked(b.text), b.path, b.link_chars) for b in page])
            marks.append(np.array([ARTICLE in b.text for b in page], np.float32))
    model = Labeller(WIDTH, HIDDEN, SEED)
    cut = [(p, m, a) for p, m in zip(own, marks) for a in range(0, len(p), SEQUENCE)]
    model.fit([vectors([p[a : a + SEQUENCE]], a, len(p)) for p, _, a in cut], [m[a : a + SEQUENCE] for _, m, a in cut], EPOCHS, SEED)
    return model


def extract(df: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (article blocks joined by \\n), n_chars.

    Null, empty and textless pages have an empty text; null ids and urls stay null.  Very long pages are read whole, in
    time linear in their length.  Repeated rows give equal texts; an empty table gives an empty result; other columns are
    not read.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def texts(pages: list[list[Block]]) -> list[str]:
        return ["\n".join(b.text for b, keep in zip(p, kept) if keep) for p, kept in zip(pages, label(shared.value, pages))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, found, held = [], [], 0
            for h in batch.column(2):
                pages.append(blocks(h.as_py()))
                held += sum(len(b.text) for b in pages[-1])
                if held > 4 << 20:
                    found += texts(pages)
                    pages, held = [], 0
            found += texts(pages)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(lean(work), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
