"""Main text of pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. Each has features of its ancestors (tags, and the parts of
their class, id and role names) and of its text (length, links, punctuation). A chain CRF with the states content and boilerplate is trained by
maximum likelihood on labelled pages and decoded by Viterbi.

The labelled pages come from `labelled_pages`, a seeded generator of page layouts (semantic and class-based containers, boilerplate around and
within the article, in invented words of several scripts); any list of (html, labels) of one's own can be given
instead. PAGES of them are used: that bounds training, which runs once on the driver.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_texts

PAGES = 800

# Fixed values of HTML: elements that have no content, that form blocks, and whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul xmp".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes template svg".split())
#: Their content is text, not markup.
PLAIN = frozenset(("xmp",))
#: An opening tag ends these, if open.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Implied ends are not looked for beyond these.
SCOPE = frozenset("table ul ol dl article section div body main nav aside form header footer button select".split())
_P_ENDS = BLOCK - frozenset("body head html title noscript option optgroup iframe button td th tr tbody thead tfoot caption legend".split())

_MARKUP = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*|))*+)(?:>|\Z)?)""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_RIGHTS = re.compile(r"©|®|\(c\)|copyright\b", re.I)


class Block:
    __slots__ = ("links", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], links: int) -> None:
        self.text, self.path, self.links = text, path, links


def _marks(tag: str, attributes: str) -> str:
    """The tag and the name parts of its attributes, such as "div|ad|banner"."""
    names = " ".join(a or b or c for _, a, b, c in _NAMES.findall(attributes))
    parts = dict.fromkeys(_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()))
    return "|".join([tag, *parts])


def blocks(page: str | None, memo: dict[tuple[str, str], str] | None = None) -> list[Block]:
    """Leaf blocks in page order, with character references decoded and white space made one space; blank ones are left out. `memo` keeps what tags gave."""
    page, memo = page or "", {} if memo is None or len(memo) > 100_000 else memo
    out: list[Block] = []
    tags: list[str] = []
    path: list[str] = []
    buffer: list[str] = []
    links = depth_a = 0
    held: list[str] | None = None  # the innermost element around all text of the block
    low = None  # the page with A-Z in lower case, made when needed

    def close() -> None:
        nonlocal links, held
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                out.append(Block(text, tuple(path if held is None else held), links))
            buffer.clear()
        links, held = 0, None

    def pop_to(k: int) -> None:
        nonlocal depth_a
        for t in tags[k:]:
            depth_a -= t == "a"
        del tags[k:], path[k:]

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        start = m.start() if m else size
        if start > at:
            piece = page[at:start]
            buffer.append(piece)
            if not piece.isspace() and held != path:
                held = path[:] if held is None else path[: next((k for k, (x, y) in enumerate(zip(held, path, strict=False)) if x != y), min(len(held), len(path)))]
            if depth_a:
                links += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                close()
            elif tag == "br":
                buffer.append(" ")
            for k in range(len(tags) - 1, -1, -1):
                if tags[k] == tag:
                    pop_to(k)
                    break
                if tag not in BLOCK and tags[k] in BLOCK:
                    break
            continue
        if tag in RAW or tag in PLAIN:
            if tag in BLOCK:
                close()
            if m[3].endswith("/") and tag == "svg":
                continue
            if low is None:
                low = page.lower() if page.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            end = low.find(f"</{tag}", at)
            if tag in PLAIN and (text := " ".join(page[at : size if end < 0 else end].split())):
                out.append(Block(text, (*path, tag), 0))
            at = size if end < 0 else (low.find(">", end) + 1 or size)
            continue
        if tag in BLOCK:
            close()
            if tag == "body":
                pop_to(1 if tags[:1] == ["html"] else 0)
            ends = ENDS.get(tag, ()) if tag in ENDS else ()
            if tag in _P_ENDS or ends:
                for k in range(len(tags) - 1, -1, -1):
                    t = tags[k]
                    if t in ends or (t == "p" and tag in _P_ENDS):
                        pop_to(k)
                        if not ends or t in ends:
                            break
                    elif t in SCOPE:
                        break
        elif tag == "br":
            buffer.append(" ")
        if tag in VOID:
            continue
        tags.append(tag)
        mark = memo.get((tag, m[3]))
        if mark is None:
            mark = memo[tag, m[3]] = _marks(tag, m[3])
        path.append(mark)
        depth_a += tag == "a"
    close()
    return out


def path_features(path: tuple[str, ...]) -> list[str]:
    tags = [p.split("|") for p in path]
    own = {f"t:{t[0]}" for t in tags} | {f"c:{c}" for t in tags for c in t[1:]}
    inner = [t for t in tags if t[0] in BLOCK]
    own |= {f"p:{'>'.join(t[0] for t in inner[-2:])}", f"near:{inner[-1][0] if inner else ''}", f"deep:{min(len(inner), 5)}"}
    return sorted(own)


def text_features(b: Block) -> tuple[str, ...]:
    n = len(b.text)
    share = b.links / n
    last = b.text[-1]
    return (
        f"n:{0 if n < 20 else 1 if n < 60 else 2 if n < 200 else 3}",
        f"a:{0 if share < 0.05 else 1 if share < 0.4 else 2 if share < 0.8 else 3}",
        "end:stop" if last in ".!?…。" else "end:no",
        "start:(c)" if _RIGHTS.match(b.text) else "start:other",
    )


class Crf:
    """A chain of two states, boilerplate 0 and content 1. weights: feature to its weight for content; change: 2 x 2; first: 2."""

    def __init__(self, weights: dict[str, float], change: np.ndarray, first: np.ndarray) -> None:
        self.weights, self.change, self.first = weights, change.tolist(), first.tolist()
        self.paths: dict[tuple[str, ...], float] = {}
        self.texts: dict[tuple[str, ...], float] = {}
        self.memo: dict[tuple[str, str], str] = {}

    def score(self, b: Block) -> float:
        s = self.paths.get(b.path)
        if s is None:
            if len(self.paths) > 100_000:
                self.paths.clear()
            s = self.paths[b.path] = sum(self.weights.get(f, 0.0) for f in path_features(b.path))
        t = text_features(b)
        u = self.texts.get(t)
        if u is None:
            u = self.texts[t] = sum(self.weights.get(f, 0.0) for f in t)
        return s + u

    def decode(self, bs: list[Block]) -> list[int]:
        """The most likely states (Viterbi)."""
        if not bs:
            return []
        (c00, c01), (c10, c11) = self.change
        s = self.score(bs[0])
        v0, v1, back = self.first[0], self.first[1] + s, []
        for b in bs[1:]:
            s = self.score(b)
            x0, y0, x1, y1 = v0 + c00, v1 + c10, v0 + c01, v1 + c11
            back.append((x0 < y0, x1 < y1))
            v0, v1 = max(x0, y0), max(x1, y1) + s
        out = [int(v1 > v0)]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = 200, rate: float = 0.1, l2: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam over all pages at once; forward-backward in log space, over pages padded to one length."""
    seen: dict[str, int] = {}
    rows = [[seen.setdefault(f, len(seen)) for f in (*path_features(b.path), *text_features(b))] for bs, _ in pages for b in bs]
    x = np.zeros((len(rows), len(seen)), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    n, long = len(pages), max(len(bs) for bs, _ in pages)
    at = np.full((n, long), -1)
    y = np.zeros((n, long), np.int64)
    k = 0
    for i, (bs, ys) in enumerate(pages):
        at[i, : len(bs)], y[i, : len(bs)] = np.arange(k, k + len(bs)), ys
        k += len(bs)
    real = at >= 0
    gold = np.concatenate([ys for _, ys in pages]).astype(np.float64)
    pairs = np.zeros((2, 2))
    both = real[:, 1:]
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    starts = np.bincount(y[:, 0], minlength=2)
    theta = np.zeros(len(seen) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, change, first = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        e = np.zeros((n, long, 2))
        e[..., 1][real] = (x @ w)[at[real]]
        alpha = np.zeros((n, long, 2))
        alpha[:, 0] = first + e[:, 0]
        for t in range(1, long):
            nxt = np.logaddexp(alpha[:, t - 1, :1] + change[0], alpha[:, t - 1, 1:] + change[1]) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], nxt, alpha[:, t - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        beta = np.zeros((n, long, 2))
        expect = np.zeros((2, 2))
        for t in range(long - 2, -1, -1):
            ahead = (e[:, t + 1] + beta[:, t + 1])[:, None, :] + change
            beta[:, t] = np.where(real[:, t + 1, None], np.logaddexp(ahead[..., 0], ahead[..., 1]), beta[:, t + 1])
            p = np.exp(alpha[:, t, :, None] + ahead - z[:, None, None])
            expect += p[real[:, t + 1]].sum(0)
        post = np.exp(alpha + beta - z[:, None, None])
        g = np.concatenate([x.T @ (post[..., 1][real][np.argsort(at[real])] - gold), (expect - pairs).ravel(), post[:, 0].sum(0) - starts]) / n + l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf({f: float(theta[i]) for f, i in seen.items()}, theta[-6:-2].reshape(2, 2), theta[-2:])


# Names by which pages mark their parts, from common markup practice.
GOOD = ("article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "div.story", "section.post-body", "div#content", "div.page-content", "div.text", "section")
BAD_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog")
BAD_NAMES = tuple(
    "ad ads advert advertisement sponsor sponsored promo banner sidebar widget related recommended menu navbar navigation breadcrumb breadcrumbs toolbar masthead topbar header footer copyright legal cookie cookies consent gdpr notice notification alert popup modal overlay comment comments disqus discussion replies respond reader feedback newsletter subscribe signup login search share social pagination pager tags toc skip".split()
)


def labelled_pages(count: int = PAGES, seed: int = 7, bare: float = 0.15) -> list[tuple[list[Block], list[int]]]:
    """Generated pages as (blocks, labels). Words of the article begin with "q", all others with "z", which is how blocks get their label.

    `bare` is the share of pages whose article has no container of its own.
    """
    r = Random(seed)
    sound = ("an", "or", "eti", "ou", "ß", "éa", "ión", "ты", "か", "um")

    def words(first: str, n: int, end: str) -> str:
        return " ".join(first + "".join(r.choices(sound, k=r.randint(1, 3))) for _ in range(n)) + end

    def tag(name: str, inside: str) -> str:
        t, dot, c = name.partition(".") if "." in name else name.partition("#")
        if dot == "." and r.random() < 0.4:
            c += r.choice((" wide", " box", " row", "-1", " main-col"))
        return f"<{t}{f' {chr(105)}d=' if dot == '#' else ' class=' if dot else ''}{chr(34) + c + chr(34) if dot else ''}>{inside}</{t}>"

    def prose(first: str) -> str:
        n = r.choice((1, 3, 8, 20, 60, 120))
        body = words(first, n, r.choice((".", ".", ".", "", "?", ":")))
        if r.random() < 0.25:
            body = f"<b>{body}</b>"
        if r.random() < 0.2:
            body += f' <a href="/x">{words(first, 2, "")}</a>' + words(first, r.randint(1, 9), ".")
        return body

    def bad(inside_article: bool) -> str:
        kind = r.random()
        if kind < 0.35:
            name = r.choice(BAD_TAGS)
        else:
            name = f"{r.choice(('div', 'div', 'section', 'ul', 'p', 'span'))}{r.choice('..#')}{r.choice(BAD_NAMES)}"
            if r.random() < 0.3:
                name += r.choice(("-box", "-list", "-wrapper", "-area", "-item", "-form", "-section", "-body"))
        if r.random() < 0.07:
            return r.choice(("<p>{}</p>", "<div>{}</div>", "<center>{}</center>", "<p><small>{}</small></p>")).format(r.choice(("&copy; ", "© ", "Copyright ", "(c) ")) + words("z", r.randint(1, 5), r.choice(("", "."))))
        shape = r.random()
        if name.startswith(("p.", "p#", "span")):
            return tag(name, prose("z")) if not name.startswith("span") else f"<p>{tag(name, prose('z'))}</p>"
        if shape < 0.35:
            items = "".join(f'<li><a href="/{k}">{words("z", r.randint(1, 3), "")}</a></li>' for k in range(r.randint(1, 8)))
            return tag(name, items if name.startswith("ul") else f"<ul>{items}</ul>")
        if shape < 0.6:
            return tag(name, prose("z"))
        if shape < 0.85:
            title = f"<h{(k := r.choice((2, 3, 4)))}>{words('z', r.randint(1, 4), '')}</h{k}>" if r.random() < 0.6 else ""
            return tag(name, title + "".join(f"<{(t := r.choice(('p', 'p', 'div', 'h3', 'li')))}>{prose('z')}</{t}>" for _ in range(r.randint(1, 5))))
        return tag(name, f"<label>{words('z', 2, '')}</label><input name=a><button>{words('z', 1, '')}</button>" + (f"&copy; {words('z', 3, '')}" if r.random() < 0.5 else ""))

    def article() -> str:
        out = [f"<h1>{words('q', r.randint(2, 9), r.choice(('', '.')))}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 2, 4, 8, 14))):
            u = r.random()
            if u < 0.7:
                out.append(f"<p>{prose('q')}" + ("</p>" if r.random() < 0.85 else ""))
            elif u < 0.78:
                out.append(f"<h2>{words('q', r.randint(1, 6), '')}</h2>")
            elif u < 0.86:
                out.append("<ul>" + "".join(f"<li>{prose('q')}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif u < 0.92:
                out.append(f"<blockquote>{prose('q')}</blockquote>")
            elif u < 0.935:
                out.append(r.choice(("<figure><img src=x><figcaption>{}</figcaption></figure>", "<pre>{}</pre>", "<noscript>{}</noscript>", "<dl><dt>{}</dt></dl>", "<math><mi>{}</mi></math>", "<object>{}</object>")).format(prose("q")))
            elif u < 0.95:
                out.append(f"<table><tr><td>{prose('q')}</td><td>{prose('q')}</td></tr></table>")
            else:
                out.append(f"<div>{prose('q')}</div>")
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            out.insert(r.choice((r.randint(0, len(out)), len(out))), bad(True))
        form = r.random()
        return "".join(out) if form < bare else tag(r.choice(GOOD) if form < 0.9 else "div", "".join(out))

    pages = []
    while len(pages) < count:
        before, after = (r.randint(0, 4), r.randint(0, 4)) if r.random() < 0.8 else (0, 0)
        body = [bad(False) for _ in range(before)] + [article()] + [bad(False) for _ in range(after)]
        inner = "".join(body)
        if r.random() < 0.3:
            inner = tag(r.choice(("div.wrapper", "div.container", "div#page", "div.layout", "main")), inner)
        bs = blocks(f"<html><head><title>z</title></head><body>{inner}</body></html>")
        if bs:
            pages.append((bs, [int("q" in b.text) for b in bs]))
    return pages


@lru_cache(4)
def default_model(pages: int = PAGES) -> Crf:
    return fit(labelled_pages(pages))


def main_text(page: str | None, model: Crf) -> str:
    bs = blocks(page, model.memo)
    return " ".join(b.text for b, s in zip(bs, model.decode(bs), strict=True) if s)


def extract(pages: DataFrame, html: str = "html", model: Crf | None = None, into: str = "text") -> DataFrame:
    """`pages` with the main text of each (null or empty html, and pages without any: "") and its code points in `n_chars`.

    Columns of those names are replaced; rows that repeat are extracted alike. Pages of any length are parsed whole, in time linear in
    their length.
    """
    whole_texts(pages.sparkSession)
    model = model or default_model()
    parts = model.weights, np.array(model.change), np.array(model.first)

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Crf(*parts)
        for s in series:
            yield pd.Series([main_text(x, own) for x in s], dtype=object)

    text = F.pandas_udf(run, T.StringType())
    return pages.drop("n_chars").withColumn(into, text(F.col(html))).withColumn("n_chars", F.length(into).cast("long"))
