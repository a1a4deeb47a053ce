"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks: text between block-level tags, with the open elements above it.
Each block has features of its ancestors (tags, roles, words of class and id) and of its text (length,
share of linked text, punctuation, cue words, place). The chain's two labels are kept and dropped; weights come
from the log-likelihood of labelled pages, which are generated in many layouts, and Viterbi decoding picks the blocks.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._spark import small_batches

#: Elements whose content is never text of the page, elements that break a block, and elements without content; fixed values.
_SKIP = frozenset(["script", "style", "template", "textarea", "select", "svg", "iframe", "title"])
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul button".split()
)
#: Beyond so many marks above a block, an element adds only marks that no element above it has: a path's length is bounded by distinct marks.
MARKS = 64
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: start tag: open elements that it ends
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"},
}
_FENCE = frozenset("ul ol dl table body html article section div nav aside header footer main form td th blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|select|svg|iframe|title)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-zA-Z]+")


class Block:
    """One leaf block: text, path (a tuple of marks of its ancestors) and characters inside links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def _marks(tag: str, attrs: str) -> tuple[str, ...]:
    out = [f"<{tag}"]
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    out.append("hidden")
            elif name in ("hidden", "aria-hidden"):
                if value.lower() != "false":
                    out.append("hidden")
            else:
                parts = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
                out += [f"{'r' if name == 'role' else 'c'}:{w.lower()}" for w in _WORD.findall(parts)]
    return tuple(out)


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; blocks of white space are left out.

    Missing end tags are supplied, stray ones ignored, a tag cut off at the end dropped. br is white space.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = [("", (), False)]  # tag, marks of the whole path, inside a link
    parts: list[str] = []
    linked = 0
    home: tuple[str, ...] = ()

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, home, min(linked, len(text))))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        tok = m[0]
        if tok[0] != "<" or tok == "<":
            if not parts:
                home = stack[-1][1]
            parts.append(tok)
            if stack[-1][2]:
                linked += len(tok.strip())
            continue
        if tok[1] == "!" or tok[1] == "?" or m[1]:
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attrs = m[2] or m[5], m[4] or m[7] or ""
        block = tag in _BLOCK
        if tag == "br":
            parts.append(" ")
            continue
        if block:
            flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if not block and stack[k][0] in _BLOCK:
                    break
            continue
        if tag in _SKIP or tag in _VOID:
            continue
        if block:
            ends = _ENDS.get(tag)
            for k in range(len(stack) - 1, 0, -1):  # an open p, and inline elements in it, end at a block
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK:
                    break
            if ends:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
                    if stack[k][0] in _FENCE and stack[k][0] not in ends:
                        break
        if attrs.rstrip().endswith("/") and not block:
            continue
        above = stack[-1][1]
        # every element is pushed, so that end tags find their own; beyond MARKS marks, only new ones are added
        marks = _marks(tag, attrs)
        if len(above) >= MARKS:
            marks = tuple(x for x in marks if x not in above)
        stack.append((tag, above + marks if marks else above, stack[-1][2] or tag == "a"))
    flush()
    return out


# ---- features ---------------------------------------------------------------------------------

_CUE = re.compile(r"(?i)\b(cookies?|subscribe|newsletter|sign up|log ?in|advert\w*|sponsored|promo\w*|copyright|all rights reserved|privacy|terms|share|tweet|related|read more|repl(?:y|ies)|comments?|menu|home|search|contact|posted by|says|click here|buy now|offer)\b|©|\xa9")


def _bucket(n: int) -> int:
    return min(8, n.bit_length())


def path_features(path: tuple[str, ...]) -> list[str]:
    """Marks anywhere above the block, and its nearest block element's."""
    out = [f"p{x}" for x in sorted(set(path))]
    tags = [x for x in path if x[0] == "<"]
    blocks = [x for x in tags if x[1:] in _BLOCK]
    if blocks:
        out.append(f"own{blocks[-1]}")
        if len(blocks) > 1:
            out.append(f"up{blocks[-2]}")
    out.append(f"depth{_bucket(len(blocks))}")
    return out


def text_features(b: Block, i: int, n: int) -> list[str]:
    words = b.text.count(" ") + 1
    share = b.linked / len(b.text)
    out = [f"w{_bucket(words)}", f"link{int(share * 4)}", f"at{i * 5 // n}"]
    if b.text[-1] in ".!?\"'”»…":
        out.append("stop")
    if words < 40:
        out += [f"cue:{(x or '©').lower()}" for x in set(_CUE.findall(b.text))]
    if b.text.isupper():
        out.append("upper")
    return out


class ChainCRF:
    """Two labels (0 dropped, 1 kept); weights of features for label 1 and a 2 x 2 transition table."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.edge = np.zeros((2, 2))
        self.begin = np.zeros(2)
        self.cache: dict[tuple, float] = {}

    def emission(self, blocks: list[Block]) -> list[float]:
        """Log-odds that each block is kept, before its neighbours speak."""
        get, n, out = self.w.get, len(blocks), []
        for i, b in enumerate(blocks):
            s = self.cache.get(b.path)
            if s is None:
                if len(self.cache) > 50_000:
                    self.cache.clear()
                s = self.cache[b.path] = sum(get(f, 0.0) for f in path_features(b.path)) + get("bias", 0.0)
            out.append(s + sum(get(f, 0.0) for f in text_features(b, i, n)))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not blocks:
            return []
        e = self.emission(blocks)
        (e00, e01), (e10, e11) = self.edge.tolist()
        s0, s1 = self.begin[0], self.begin[1] + e[0]
        back = []
        for x in e[1:]:
            a, b = s0 + e00, s1 + e10
            c, d = s0 + e01, s1 + e11
            back.append((0 if a >= b else 1, 0 if c >= d else 1))
            s0, s1 = max(a, b), max(c, d) + x
        y = [0 if s0 >= s1 else 1]
        for p in reversed(back):
            y.append(p[y[-1]])
        return y[::-1]

    def gradient(self, feats: list[list[str]], gold: list[int]):
        """Of the log-likelihood, by forward and backward sums: per block the error, and the transition table's."""
        n = len(feats)
        e = np.zeros((n, 2))
        e[:, 1] = [sum(self.w.get(f, 0.0) for f in fs) for fs in feats]
        f = np.zeros((n, 2))
        b = np.zeros((n, 2))
        f[0] = self.begin + e[0]
        for i in range(1, n):
            f[i] = np.logaddexp(f[i - 1, 0] + self.edge[0], f[i - 1, 1] + self.edge[1]) + e[i]
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp(self.edge[:, 0] + e[i + 1, 0] + b[i + 1, 0], self.edge[:, 1] + e[i + 1, 1] + b[i + 1, 1])
        z = np.logaddexp(f[-1, 0], f[-1, 1])
        p = np.exp(f + b - z)
        pair = np.exp(f[:-1, :, None] + self.edge + (e[1:] + b[1:])[:, None, :] - z).sum(0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:-1], gold[1:]), 1)
        first = np.zeros(2)
        first[gold[0]] = 1
        return np.array(gold) - p[:, 1], seen - pair, first - p[0]

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 6, seed: int = 0) -> ChainCRF:
        """Adagrad on the log-likelihood with a small L2 penalty."""
        data = []
        for blocks, gold in pages:
            if blocks:
                data.append(([path_features(b.path) + text_features(b, i, len(blocks)) + ["bias"] for i, b in enumerate(blocks)], gold))
        r = random.Random(seed)
        square: dict[str, float] = {}
        edge2, begin2 = np.ones((2, 2)), np.ones(2)
        for _ in range(epochs):
            r.shuffle(data)
            for feats, gold in data:
                err, ge, gb = self.gradient(feats, gold)
                g: dict[str, float] = {}
                for fs, x in zip(feats, err.tolist()):
                    for f in fs:
                        g[f] = g.get(f, 0.0) + x
                for f, x in g.items():
                    x -= 1e-3 * self.w.get(f, 0.0)
                    square[f] = square.get(f, 0.0) + x * x
                    self.w[f] = self.w.get(f, 0.0) + 0.3 * x / math.sqrt(square[f] + 1e-6)
                edge2 += ge * ge
                self.edge += 0.3 * ge / np.sqrt(edge2)
                begin2 += gb * gb
                self.begin += 0.3 * gb / np.sqrt(begin2)
        self.cache.clear()
        return self


# ---- labelled pages ---------------------------------------------------------------------------

KEEP, DROP = "\ue000", "\ue001"  # mark the label of generated text


def labelled_page(r: random.Random) -> str:
    """A generated page; every piece of text starts with KEEP or DROP."""
    syl = ["an", "er", "tion", "the", "of", "re", "st", "que", "la", "der", "ein", "os", "ment", "ou", "ing", "ble", "é"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice([".", ".", ".", "", "!", "?"])
    k = lambda a, b: KEEP + say(a, b)
    d = lambda a, b: DROP + say(a, b)
    name = lambda *xs: r.choice([f' class="{r.choice(xs)}"', f' id="{r.choice(xs)}"', f' class="{r.choice(xs)} {word()}"', f" class='{word()}-{r.choice(xs)}'"])
    plain = lambda: r.choice(["", f' class="{word()}"'])
    links = lambda n: "".join(f'<li><a href="/{word()}">{d(1, 4)}</a></li>' for _ in range(n))

    def para():
        p = r.random()
        if p < 0.55:
            return f"<p{plain()}>{k(1, 90)}</p>"
        if p < 0.65:
            return f"<p>{k(3, 30)} <a href='/x'>{say(1, 4)}</a> {say(2, 20)}" + r.choice(["</p>", ""])
        if p < 0.72:
            return f"<p><b>{k(5, 60)}<br>"
        if p < 0.79:
            return f"<h{(h := r.randint(2, 4))}>{k(1, 8)}</h{h}>"
        if p < 0.86:
            return "<ul>" + "".join(f"<li>{k(1, 20)}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
        if p < 0.92:
            return f"<blockquote><p>{k(5, 40)}</p></blockquote>"
        if p < 0.96:
            return f"<table><tr><td>{k(1, 3)}</td><td>{k(1, 3)}</td></tr></table>"
        return f"<figure><img src=x><figcaption>{k(2, 12)}</figcaption></figure>"

    def junk(where):
        ad = lambda: f"<div{name('ad', 'ads', 'advert', 'advertisement', 'banner', 'promo', 'sponsored', 'sponsor')}>{r.choice(['', '<p>'])}{d(2, 40)}</div>"
        notice = lambda: f"<div{r.choice([name('notice', 'cookie', 'cookie-banner', 'consent', 'alert', 'gdpr', 'popup', 'modal', 'notification', 'message'), ' role=\"alert\"', ' role=dialog'])}><p>{DROP}{r.choice(['We use cookies. ', 'This site uses cookies ', '', ''])}{say(3, 25)}</p>{r.choice(['', '<button>' + DROP + 'Accept</button>'])}</div>"
        form = lambda: f"<form{r.choice(['', name('search', 'login', 'newsletter', 'subscribe', 'signup')])}><label>{d(1, 4)}</label><input type=text><p>{d(2, 15)}</p><button>{d(1, 2)}</button></form>"
        side = lambda: r.choice([f"<aside{plain()}>", f"<div{name('sidebar', 'side', 'widget', 'related', 'secondary', 'aside')}>"])
        aside = lambda: (t := side()) + f"<h3>{d(1, 4)}</h3>" + r.choice([f"<ul>{links(r.randint(2, 5))}</ul>", f"<p>{d(5, 60)}</p><p>{d(5, 30)}</p>"]) + ("</aside>" if t[1] == "a" else "</div>")
        share = lambda: f"<div{name('share', 'social', 'tags', 'breadcrumb', 'breadcrumbs', 'pagination', 'pager', 'toolbar', 'meta')}>" + " ".join(f"<a href=#>{d(1, 2)}</a>" for _ in range(r.randint(2, 4))) + "</div>"
        return "".join(r.choice([ad, ad, notice, form, aside, share])() for _ in range(r.choice([0, 0, 1] if where == "in" else [0, 1, 1, 2])))

    def comments():
        one = lambda: r.choice([
            f"<li{name('comment', 'reply')}><p>{d(3, 60)}</p></li>", f"<div{name('comment', 'comment-body', 'response', 'reply')}><span{name('author')}>{d(1, 2)}</span><p>{d(3, 60)}</p></div>", f"<article{name('comment')}><p>{d(3, 60)}</p></article>",
        ])
        body = "".join(one() for _ in range(r.randint(1, 5)))
        head = f"<h3>{DROP}{r.choice(['Comments', 'Responses', '3 replies', say(1, 3)])}</h3>"
        return r.choice([f"<section{name('comments', 'responses', 'discussion')}>{head}{body}</section>", f"<div{name('comments', 'comment-list', 'disqus', 'replies')}>{head}{body}</div>", f"<ol{name('comments', 'commentlist')}>{body}</ol>"])

    nav = r.choice([f"<nav{plain()}><ul>{links(r.randint(2, 8))}</ul></nav>", f"<div{name('nav', 'menu', 'navigation', 'navbar', 'topnav')}><ul>{links(r.randint(2, 8))}</ul></div>", f"<ul{name('menu', 'nav')} role=navigation>{links(4)}</ul>", f'<div role="navigation">{links(3)}</div>'])
    head = r.choice(["", f"<header{plain()}>{DROP}{say(1, 6)}{r.choice(['', f'<p>{d(2, 8)}</p>'])}</header>", f"<div{name('header', 'masthead', 'site-header', 'top', 'branding', 'logo')}><h1>{d(1, 6)}</h1></div>", f'<div role="banner">{d(1, 8)}</div>'])
    foot = r.choice([f"<footer{plain()}>{DROP}{r.choice(['&copy; ', '© ', ''])}{say(2, 20)}</footer>", f"<div{name('footer', 'site-footer', 'bottom', 'copyright', 'colophon')}><p>{DROP}&copy; {say(2, 12)}</p><ul>{links(3)}</ul></div>", f'<div role="contentinfo">{d(2, 15)}</div>'])
    title = r.choice([f"<h1>{k(2, 10)}</h1>", f"<h1>{k(2, 10)}</h1>", f"<h2>{k(2, 10)}</h2>", f"<header><h1>{k(2, 8)}</h1></header>", ""])
    body = title
    for _ in range(r.choice([0, 1, 2, 4, 8, 14])):
        body += para() + junk("in")
    kind = r.random()
    if kind < 0.5:
        main = f"<article{plain()}>{body}</article>"
    elif kind < 0.65:
        main = f"<main>{body}</main>"
    elif kind < 0.9:
        main = f"<div{name('content', 'post', 'entry', 'article', 'article-body', 'story', 'main', 'text', 'post-content')}>{body}</div>"
    else:
        main = f"<div{plain()}>{body}</div>"
    if r.random() < 0.25:
        main = r.choice(["<main>{}</main>", "<div class='container'>{}</div>", "<div id=wrapper><section>{}</section></div>"]).format(main)
    tail = comments() if r.random() < 0.45 else ""
    page = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{head}{nav}<!-- c -->{junk('out')}{main}{tail}{junk('out')}{foot}"
    return page + r.choice(["</body></html>", ""])


def labelled_blocks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of a generated page without their marks, and their labels (text without a mark is dropped)."""
    blocks, gold = [], []
    for b in leaf_blocks(page):
        gold.append(int(KEEP in b.text))
        text = b.text.replace(KEEP, "").replace(DROP, "").strip()
        blocks.append(Block(text or "-", b.path, min(b.linked, len(text or "-"))))
    return blocks, gold


@functools.cache
def trained(seed: int = 5, pages: int = 500) -> ChainCRF:
    """The model, fitted on generated pages; the same weights every time."""
    r = random.Random(seed)
    return ChainCRF().fit([labelled_blocks(labelled_page(r)) for _ in range(pages)])


def main_text(crf: ChainCRF, page: str) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, crf.decode(blocks)) if y)


def _extractor(crf: ChainCRF):
    def extract(batches):
        for batch in batches:
            text = [main_text(crf, p) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return extract


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages; text is empty for null or empty html.

    Repeated rows each give a row; null ids and urls pass through. Pages of any length and depth are read whole; equal scores keep
    the block dropped. Other columns are ignored; an empty table gives no rows.
    """
    p = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = p.mapInArrow(_extractor(trained()), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
