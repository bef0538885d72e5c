"""Main text of web pages: a recurrent labeller decides for every text block of a page.

A page is read into leaf blocks in order, each with the path of elements above it. A bidirectional
LSTM (numpy) reads the blocks' vectors, hashed path names, hashed words and a few measures of the
text, so that each block is judged in the context of the whole page.
"""

from __future__ import annotations

import bisect
import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import SPACES, text_udf

#: Fitted on at most so many pages with explicit parts, chosen by a hash of page_id; each is also rebuilt VARIANTS times.
TRAIN_PAGES, VARIANTS = 240, 3
PATH_SLOTS, WORD_SLOTS, MEASURES, HIDDEN = 96, 24, 8, 16
WIDTH = PATH_SLOTS + WORD_SLOTS + MEASURES

# Element names of HTML.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SAME_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Elements of SVG and MathML: their roots, those that hold HTML, those that aren't shown, and HTML elements that end an unclosed root.
FOREIGN, HOLDS_HTML = {"svg", "math"}, {"foreignobject", "mi", "mo", "mn", "ms", "mtext"}
NOT_SHOWN = {"svg": {"title", "desc", "metadata"}, "math": {"annotation", "annotation-xml"}}
ENDS_FOREIGN = CLOSES_P | {"html", "head", "body", "embed", "meta", "listing", "xmp"}
# Names that pages give to parts, for the rebuilt training pages.
MAIN_PARTS = ["article", "main", "div.content", "div.article", "div.post", "div.entry-content", "section.story", "div.article-body", "div.main", "div.text", "section.page-content", "div.post-body"]
OTHER_PARTS = {
    "menu": ["nav", "div.menu", "ul.navbar", "div.navigation", "div.breadcrumb", "ul.nav-links", "div.topnav", "nav.toc"],
    "header": ["header", "div.header", "div.masthead", "div.site-header", "div.topbar", "div.branding"],
    "footer": ["footer", "div.footer", "div.site-footer", "div.copyright", "div.bottom"],
    "sidebar": ["aside", "div.sidebar", "aside.related", "div.related-posts", "div.widget", "div.popular", "div.recommended", "div.tags"],
    "notice": ["div.cookie-banner", "div.notice", "div.alert", "div.consent", "div.newsletter", "div.popup", "div.gdpr", "div.modal", "div.banner", "div.subscribe"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.promo", "div.sponsored", "aside.advertisement", "div.sponsor"],
    "form": ["form", "form.search", "div.login form", "fieldset", "div.signup form", "select"],
    "comments": ["div.comments", "section.comments", "ol.comment-list", "div.disqus", "div.comment", "ul.responses", "div.replies", "div.discussion"],
    "share": ["div.share", "div.social", "ul.share-buttons", "div.author-bio", "div.meta"],
}
_NOT_MAIN = {"nav", "aside", "footer", "header", "form", "head", "title", "button", "select", "textarea", "noscript"} | {t for names in OTHER_PARTS.values() for n in names for t in re.split(r"[. -]", n)} - {"div", "ul", "ol", "section", "site", "top", "bottom", "body", "page", "list", "post", "posts", "text", "links", "meta", "tags", "toc", "li"}

_RAW = re.compile(r"<(script|style|template|iframe|noembed|noframes|xmp)(?=[\s/>])", re.I)
_RAW_NAMES = {"script", "style", "template", "iframe", "noembed", "noframes", "xmp"}
#: A whole tag without < or > in its quotes: most are, and no attempt reads past the next of these letters.
_PLAIN = re.compile(r"""<(/?)([A-Za-z][^\s/<>"']*)(?=[\s/>])((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_TAG, _NAME_END, _SPECIAL = re.compile(r"<(/?)([A-Za-z])"), re.compile(r"[\s/>]"), re.compile(r"""["'<>]""")


class _Markup:
    """The markup of a page, from its start to its end in one go: where tags end behind whole quotes is worked out
    once for all places, from the page's end back."""

    def __init__(self, page: str):
        self.page, self.places, self.name_end = page, None, 0

    def _look(self) -> None:
        page = self.page
        self.places = places = [m.start() for m in _SPECIAL.finditer(page)]
        n = len(places)
        #: By special letter: the end of a tag that goes on there outside of quotes (None: it has none); the end of what
        #: is left out for a tag that has none (-1: nothing is).
        self.tag_end: list[int | None] = [None] * (n + 1)
        self.rest_end: list[int] = [-1] * n + [len(page)]
        after = {'"': n, "'": n}  # the next quote of a kind
        angle = n  # the next < or >
        self.quote = [n] * (n + 1)  # the next quote of any kind
        for k in range(n - 1, -1, -1):
            c = page[places[k]]
            if c == ">":
                self.tag_end[k] = self.rest_end[k] = places[k] + 1
            elif c == "<":
                self.tag_end[k] = self.tag_end[k + 1]
            elif (other := after[c]) < n:
                self.tag_end[k], self.rest_end[k] = self.tag_end[other + 1], self.rest_end[other + 1]
            else:
                self.rest_end[k] = len(page) if angle == n else places[angle] + 1 if page[places[angle]] == ">" else -1
            if c in after:
                after[c] = k
            else:
                angle = k
            self.quote[k] = min(after.values())

    def _from(self, at: int) -> int:
        return bisect.bisect_left(self.places, at)

    def _name_ends(self, at: int) -> int:
        if self.name_end < at:
            m = _NAME_END.search(self.page, at)
            self.name_end = m.start() if m else len(self.page)
        return self.name_end

    def _raw(self, start: int, name: str, attributes: str, end: int) -> tuple:
        """An element whose content isn't markup, from its tag: start, end, name, attributes, content."""
        close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.page, end)
        stop = self.page.find(">", close.end()) if close else -1
        upto, after = (len(self.page), len(self.page)) if stop < 0 else (close.start(), stop + 1)
        return start, after, name, attributes, self.page[end:upto], "", "", ""

    def _odd_tag(self, start: int, m: re.Match) -> tuple | None:
        """A tag with < or > in its quotes, or without an end."""
        if self.places is None:
            self._look()
        page = self.page
        if (raw := _RAW.match(page, start)) and (end := self.tag_end[self._from(raw.end())]) is not None:
            return self._raw(start, raw[1], page[raw.end() : end - 1], end)
        name = self._name_ends(m.end())
        end = self.tag_end[self._from(name)]
        if end is None and (k := self.quote[self._from(m.end())]) < len(self.places) and self.places[k] < name:
            name, end = self.places[k], self.tag_end[k]  # the name ends before its first quote
        if end is not None:
            return start, end, "", "", "", m[1], page[m.end() - 1 : name], page[name : end - 1]
        end = self.rest_end[self._from(m.end())]
        return (start, end, "", "", "", "", "", "") if end >= 0 else None

    def __iter__(self) -> Iterator[tuple]:
        """(start, end, raw name, its attributes, its content, slash, name, attributes) of each tag; of comments and the
        like, and of tags that are left out, start and end only."""
        page, at = self.page, 0
        last_angle = page.rfind(">")
        while (start := page.find("<", at)) >= 0:
            found = None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                found = (start, len(page) if end < 0 else end + 3, "", "", "", "", "", "")
            elif m := _PLAIN.match(page, start):
                raw = not m[1] and m[2].lower() in _RAW_NAMES
                found = self._raw(start, m[2], m[3], m.end()) if raw else (start, m.end(), "", "", "", *m.groups())
            elif m := _TAG.match(page, start):
                found = self._odd_tag(start, m)
            elif page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start + 2)
                found = (start, len(page) if end < 0 else end + 1, "", "", "", "", "", "")
            elif page[start + 1 : start + 2] == "/" and start + 3 <= last_angle:
                found = (start, page.find(">", start + 3) + 1, "", "", "", "", "", "")
            if found is None:
                at = start + 1
            else:
                yield found
                at = found[1]


_UNQUOTED_END = re.compile(r"""=\s*[^\s"'=]*/\Z""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORDS = re.compile(r"\w+")


@dataclass
class Block:
    path: tuple[str, ...]  # distinct names from the root down: element names and words of their class, id and role
    text: str
    linked: int  # characters inside links
    leaf: str = ""


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    named = [tag]
    for m in _NAMED.finditer(attributes) if "=" in attributes else ():
        for part in _PARTS.findall(m[1] or m[2] or m[3] or ""):
            part = part.lower()
            named.append(part[:-1] if len(part) > 3 and part.endswith("s") else part)
    return tuple(named)


def read_blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in order. Unclosed and stray tags are read as browsers do in common cases;
    a tag with an unclosed quote, or without an end, is left out up to its first > behind whole quotes.

    SVG and MathML are read as inline elements whose texts are words of the block around them; what
    isn't shown of them (titles, descriptions, annotations) is left out. The text of xmp is literal.
    """
    page = page or ""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...] | None]] = []  # names: none of inline elements, None of those that aren't shown
    text: list[str] = []
    links = linked = foreign = hidden = 0
    paths: list[tuple[str, ...]] = [()]  # of the elements on the stack that open blocks
    leaves: list[str] = [""]
    places: dict[str, list[int]] = {}  # of a tag on the stack
    opens: list[int] = []  # places of elements that open blocks
    roots: list[int] = []  # places of elements of SVG and MathML that change how content is read

    def flush() -> None:
        nonlocal linked
        if text:
            joined = SPACES.sub(" ", entities.unescape("".join(text))).strip(" ")
            if joined:
                blocks.append(Block(paths[-1], joined, linked, leaves[-1]))
            text.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links, foreign, hidden
        for tag, names in stack[k:]:
            links -= tag == "a"
            places[tag].pop()
            if names:
                paths.pop()
                leaves.pop()
                opens.pop()
        while roots and roots[-1] >= k:
            roots.pop()
        if foreign:
            foreign -= sum(tag in FOREIGN for tag, _ in stack[k:])
            hidden -= sum(names is None for _, names in stack[k:])
        del stack[k:]

    def push(tag: str, names: tuple[str, ...] | None) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag in FOREIGN or tag in HOLDS_HTML:
            roots.append(len(stack))
        if names:
            opens.append(len(stack))
        stack.append((tag, names))
        if names:
            last = paths[-1]
            more = tuple(dict.fromkeys(n for n in names if n not in last))
            paths.append(last + more if more else last)
            leaves.append(tag)

    def root() -> int | None:
        """Place of the svg or math whose content the innermost element is."""
        return roots[-1] if roots and stack[roots[-1]][0] in FOREIGN else None

    def open_block(tag: str, attributes: str) -> None:
        flush()
        if tag in CLOSES_P and opens and stack[opens[-1]][0] == "p":
            close(opens[-1])
        if tag in SAME_END and any(places.get(t) for t in SAME_END[tag]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SCOPES[tag]:
                    break
                if stack[k][0] in SAME_END[tag]:
                    close(k)
                    break
        if tag not in VOID:
            push(tag, _names(tag, attributes))

    at = 0
    for start, end, raw, raw_attributes, content, slash, name, attributes in _Markup(page):
        if start > at and not hidden:
            text.append(page[at:start])
            if links:
                linked += start - at
        at = end
        if raw.lower() == "xmp":
            if foreign and (k := root()) is not None:
                flush()
                close(k)
            open_block("xmp", raw_attributes)
            text.append(content.replace("&", "&amp;"))
            linked += len(content) if links else 0
            flush()
            close(len(stack) - 1)
            continue
        if not name:
            continue
        tag = name.lower()
        if slash:
            k = places[tag][-1] if places.get(tag) else None
            ends_blocks = k is not None and bool(opens) and opens[-1] >= k
            if tag in INLINE:
                if ends_blocks:
                    continue  # an inline end tag doesn't close blocks
            elif ends_blocks or (k is None and tag not in FOREIGN):
                flush()
            if k is not None:
                close(k)
            continue
        k = root() if foreign else None
        if k is not None and tag in ENDS_FOREIGN:
            flush()
            close(k)
            k = None
        if tag in FOREIGN or k is not None:
            kind = tag if tag in FOREIGN else stack[k][0]
            if tag not in FOREIGN and tag not in INLINE and tag not in ("tspan", "textpath"):
                text.append(" ")  # texts of different elements are different words
            if attributes.endswith("/") and not _UNQUOTED_END.search(attributes):
                continue
            if tag not in INLINE:
                foreign += tag in FOREIGN
                hidden += tag in NOT_SHOWN[kind]
                push(tag, None if tag in NOT_SHOWN[kind] else ())
                continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag not in VOID:
                if tag == "a":
                    links += 1
                push(tag, ())
            continue
        open_block(tag, attributes)
    if at < len(page) and not hidden:
        text.append(page[at:])
    flush()
    return blocks


def silver_label(block: Block) -> int:
    """Whether a block of a page with explicit parts lies in its main part and in no other part."""
    return int(bool({"article", "main"} & set(block.path)) and not _NOT_MAIN & set(block.path))


@lru_cache(1 << 16)
def _word_slot(word: str) -> int:
    """Slot of a word, past WORD_SLOTS if it counts up and not down."""
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h % WORD_SLOTS + (WORD_SLOTS if h & (1 << 20) else 0)


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row for each block; the words of the whole text count, as a vector of length one at most."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    n = len(blocks)
    for k, b in enumerate(blocks):
        for name in b.path:
            out[k, zlib.crc32(name.encode()) % PATH_SLOTS] = 1
        words = _WORDS.findall(b.text.lower())
        if words:
            slots = np.fromiter(map(_word_slot, words), np.int64, len(words))
            counts = np.bincount(slots, minlength=2 * WORD_SLOTS)
            signed = counts[WORD_SLOTS:] - counts[:WORD_SLOTS]
            out[k, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = signed / max(1.0, np.sqrt(signed @ signed))
        size = len(b.text)
        out[k, PATH_SLOTS + WORD_SLOTS :] = (np.log1p(size) / 6, min(1, b.linked / size), b.text.count(",") * 10 / (size + 20), b.text[-1] in ".!?", b.leaf == "p", b.leaf in ("h1", "h2", "h3"), k / n, 1)
    return out


class Labeller:
    """Bidirectional LSTM with one logistic output for each step."""

    def __init__(self, seed: int = 5):
        self.fitted = False
        rng = np.random.default_rng(seed)
        u = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"v": u(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": u(WIDTH, 4 * HIDDEN), f"u{d}": u(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1

    def _direction(self, d: str, x: np.ndarray, live: np.ndarray, keep: bool):
        n, steps, _ = x.shape
        pre = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, tape = np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.p[f"u{d}"]
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * HIDDEN : (k + 1) * HIDDEN], -30, 30))) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = live[:, t : t + 1]
            c2 = (f * c + i * g) * on
            tc = np.tanh(c2)
            h2 = o * tc * on
            if keep:
                tape.append((t, i, f, o, g, c, tc, h, on))
            h, c = h2, c2
            out[:, t] = h
        return out, tape

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        f, b = self._direction("f", x, live, keep), self._direction("b", x, live, keep)
        both = np.concatenate((f[0], b[0]), axis=2)
        return (both @ self.p["v"])[:, :, 0] + self.p["c"], both, f[1], b[1]

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict:
        z, both, *tapes = self.forward(x, live, keep=True)
        off = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * live / live.sum())[:, :, None].astype(np.float32)
        g = {"v": np.einsum("nth,nto->ho", both, off), "c": off.sum((0, 1))}
        back = off @ self.p["v"].T
        for d, tape, part in zip("fb", tapes, (back[:, :, :HIDDEN], back[:, :, HIDDEN:])):
            dh, dc = np.zeros_like(part[:, 0]), np.zeros_like(part[:, 0])
            dw, du, db = (np.zeros_like(self.p[f"{k}{d}"]) for k in "wub")
            for t, i, f, o, gg, c, tc, h, on in reversed(tape):
                dh = (dh + part[:, t]) * on
                dcell = (dc + dh * o * (1 - tc * tc)) * on
                dz = np.concatenate((dcell * gg * i * (1 - i), dcell * c * f * (1 - f), dh * tc * o * (1 - o), dcell * i * (1 - gg * gg)), axis=1)
                dw += x[:, t].T @ dz
                du += h.T @ dz
                db += dz.sum(0)
                dh, dc = dz @ self.p[f"u{d}"].T, dcell * f
            g |= {f"w{d}": dw, f"u{d}": du, f"b{d}": db}
        return g


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, live = np.zeros((len(pages), steps, WIDTH), np.float32), np.zeros((len(pages), steps), np.float32)
    for k, v in enumerate(pages):
        x[k, : len(v)], live[k, : len(v)] = v, 1
    return x, live


def label_pages(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which of its blocks are main text. Pages of like length are labelled together."""
    if not model.fitted:
        return [np.array([not _NOT_MAIN & set(b.path) for b in p], bool) for p in pages]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        most = len(pages[order[min(len(order) - 1, at + 127)]])
        take = order[at : at + max(1, min(128, 20_000 // most))]
        z = model.forward(*_padded([vectors(pages[k]) for k in take]))[0]
        for k, row in zip(take, z):
            out[k] = row[: len(pages[k])] >= 0
        at += len(take)
    return out


def rebuilt(pages: list[list[Block]], rng: np.random.Generator) -> list[tuple[list[Block], list[int]]]:
    """Training pages made of the given pages' texts with other part names and added parts."""
    texts = [b.text for p in pages for b in p]
    some = lambda options: options[int(rng.integers(len(options)))]
    path = lambda name: tuple(t[:-1] if len(t) > 3 and t.endswith("s") and k else t for part in name.split() for k, t in enumerate(re.split(r"[.-]", part)))
    out = []
    for page in pages:
        if not any(map(silver_label, page)):
            continue
        main, outer = path(some(MAIN_PARTS)), ("html", "body") + ((), ("div", "wrapper"), ("div", "container"))[int(rng.integers(3))]
        made: list[tuple[Block, int]] = []

        def part(kind: str, above: tuple[str, ...]) -> None:
            name = path(some(OTHER_PARTS[kind]))
            short = kind in ("menu", "share", "form", "header")
            for _ in range(int(rng.integers(1, 8 if short else 5))):
                t = some(texts)
                t = " ".join(t.split()[: int(rng.integers(1, 4))]) if short else t
                leaf = some(["li", "a", "p", "div"]) if kind != "form" else some(["label", "p", "button", "option"])
                made.append((Block(above + name + ((leaf,) if leaf not in INLINE else ()), t, len(t) if kind in ("menu", "share") or leaf == "a" else 0, leaf), 0))

        for kind in ("header", "menu", "notice", "advert"):
            if rng.random() < 0.5:
                part(kind, outer)
        for b in page:
            if silver_label(b):
                tail = ("h1",) if b.leaf == "h1" else (b.leaf,) if b.leaf in ("p", "h2", "li", "blockquote", "pre", "td") else ()
                made.append((Block(outer + main + tail, b.text, b.linked, b.leaf), 1))
                if rng.random() < 0.06:
                    part(some(["advert", "notice", "form", "share", "sidebar"]), outer + main)
        if rng.random() < 0.4:
            part(some(["comments", "share", "footer"]), outer + main)
        for kind in ("comments", "sidebar", "form", "share", "advert", "footer"):
            if rng.random() < 0.5:
                part(kind, outer)
        out.append(([b for b, _ in made], [y for _, y in made]))
    return out


def train(pages: list[str], seed: int = 5, epochs: int = 10) -> Labeller:
    """Fit the labeller on pages whose parts are explicit, as they are and rebuilt.

    Without such pages nothing can be learnt; the labeller then isn't `fitted`, and label_pages takes
    every block that no part of another kind (navigation, footer, form, ...) holds.
    """
    rng, model = np.random.default_rng(seed), Labeller(seed)
    read = [b for b in map(read_blocks, pages) if any(map(silver_label, b))]
    if not read:
        return model
    model.fitted = True
    sets = [(b, [silver_label(x) for x in b]) for b in read]
    for _ in range(VARIANTS):
        sets += rebuilt(read, rng)
    data = sorted(((vectors(b), np.array(y, np.float32)) for b, y in sets), key=lambda s: len(s[0]))
    batches = [data[k : k + 32] for k in range(0, len(data), 32)]
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            x, live = _padded([v for v, _ in batches[k]])
            y = np.zeros_like(live)
            for j, (_, labels) in enumerate(batches[k]):
                y[j, : len(labels)] = labels
            step += 1
            for name, g in model.gradients(x, live, y).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                s[name] = 0.99 * s[name] + 0.01 * g * g
                model.p[name] -= 0.02 * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-7)
    return model


def fit(pages: DataFrame, rows: int = TRAIN_PAGES) -> Labeller:
    """Train on at most `rows` pages with explicit parts, those of the lowest hash of page_id.

    Pages that may have such parts are read in order of the hash, eight times as many in each round,
    until enough have them or all are read.
    """

    @F.pandas_udf("boolean")
    def explicit(batch: pd.Series) -> pd.Series:
        return pd.Series([any(map(silver_label, read_blocks(h))) for h in batch], dtype=bool)

    may = pages.filter("page_id IS NOT NULL AND html IS NOT NULL").filter(F.col("html").rlike("(?i)article|main")).select("page_id", F.xxhash64("page_id").alias("h"), F.col("html").cast("string").alias("html"))
    share = 2 * rows / max(1, may.count())
    while True:
        within = may if share >= 1 else may.filter(F.col("h") < int(share * 2**64) - 2**63)
        found = within.distinct().filter(explicit("html")).groupBy("h", "page_id").agg(F.max("html").alias("html"))
        sample = found.orderBy("h", "page_id").limit(rows).toPandas()
        if len(sample) >= rows or share >= 1:
            return train(sample.sort_values("page_id")["html"].to_list())
        share *= 8


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """Per row of `pages(page_id, url, html)`: page_id, url, text, n_chars, n_blocks.

    text joins the blocks labelled as main text by line feeds, the empty string if there are none or
    html is null. Repeated and very long pages and null ids pass through; other columns are left
    out. Narrow: one Arrow pass over the whole pages.
    """

    def texts(pages: list[str | None]) -> list[dict]:
        read = [read_blocks(h) for h in pages]
        kept = ["\n".join(b.text for b, y in zip(blocks, main) if y) for blocks, main in zip(read, label_pages(model, read))]
        return [{"text": t, "n_chars": len(t), "n_blocks": len(blocks)} for t, blocks in zip(kept, read)]

    kind = pa.struct([("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64())])
    extracted = text_udf(texts, "text string, n_chars long, n_blocks long", kind, rows=512)
    return pages.select("page_id", "url", extracted(F.col("html").cast("string")).alias("_e")).select("page_id", "url", "_e.*")
