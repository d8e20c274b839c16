"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A block is the text between two edges of block elements. Its features are the tags and the class and id words of its
ancestors, and what its text looks like in any language. The field is trained on labelled pages that training_pages()
writes: layouts with the parts that pages have around an article, under the many names that are given to them.
"""

import functools
import html
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>", re.S)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Elements that start and end blocks, that hold no text of the page, and that have no end.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
#: Elements that hold no text of the page. Those of RAW go on to the page's end if nothing closes them, as browsers have it.
SILENT = frozenset("head iframe script style svg template title".split())
RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element ends those of its group that are open in the same container.
ENDS = {k: (g.split(), h.split()) for k, g, h in (("li", "li", "ul ol menu dir"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("option", "option", "select"))}
SPACE = frozenset("br img input td th".split())


def _names(attributes: str) -> list[str]:
    return [w.lower() for m in ATTRIBUTE.finditer(attributes) for w in WORD.findall(m[2] or m[3] or m[4] or "")]


class Element:
    """An open element, linked to the one that holds it: blocks share their ancestors instead of copying them."""

    __slots__ = ("parent", "tag", "names")

    def __init__(self, parent: "Element | None", tag: str, names: list[str]):
        self.parent, self.tag, self.names = parent, tag, names


class Block:
    """A leaf block: its text, the part of it in links, its innermost element."""

    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: Element | None):
        self.text, self.linked, self.element = text, linked, element


class Open:
    """The open elements; the last one of a tag is found without a walk, so each step's cost does not grow with the nesting."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, names: list[str]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(self.stack[-1] if self.stack else None, tag, names))

    def pop(self, n: int) -> None:
        """The elements from place n on end."""
        while len(self.stack) > n:
            self.places[self.stack.pop().tag].pop()


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in its order. Any text is a page; open elements end with what holds them.

    Time and memory grow with the page's length, however its elements are nested or left open.
    """
    out: list[Block] = []
    open_ = Open()
    text: list[str] = []
    unclosed: set[str] = set()
    linked = at = 0
    last = page.rfind(">") + 1

    def end() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, linked, open_.stack[-1] if open_.stack else None))
            text.clear()
        linked = 0

    # Beyond the last > no element is closed, and only a comment can begin.
    while m := TOKEN.search(page, at, last) if at < last else COMMENT.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if open_.places.get("a"):
                linked += len(piece.strip())
        at = m.end()
        if m.lastindex is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                end()
            if (n := open_.last(tag)) >= 0:
                open_.pop(n)
            continue
        if tag in SPACE:
            text.append(" ")
        if tag in BLOCKS:
            end()
            if tag not in ("button", "option") and (n := open_.last("p")) >= 0:
                open_.pop(n)
            if tag in ENDS:
                group, holders = ENDS[tag]
                if (n := open_.last(*group)) > open_.last(*holders):
                    open_.pop(n)
        if tag in SILENT and not m[3].endswith("/") and tag not in unclosed:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if close:
                at = close.end()
                continue
            if tag in RAW:
                at = len(page)
                continue
            # Nothing further on closes it: it is an element like others, and no further one of its kind is searched for.
            unclosed.add(tag)
        if tag not in VOID and not m[3].endswith("/"):
            open_.push(tag, _names(m[3]))
    if at < len(page):
        text.append(page[at:])
    end()
    return out


def own_features(block: Block) -> list[str]:
    """What a block's text and its innermost block element say."""
    text, words = block.text, block.text.count(" ") + 1
    out = ["bias", f"words{min(6, words.bit_length())}", f"links{round(4 * min(1.0, block.linked / max(1, len(text))))}"]
    out.append("stop" if text[-1] in ".!?…:;\"»”)" else "open")
    if text.count(",") > 1:
        out.append("commas")
    if "©" in text or "copyright" in text.lower()[:200]:
        out.append("rights")
    return out


class Paths:
    """The features that ancestors give, found once for each element and shared with what lies inside it.

    known maps a feature to what stands for it, or to None if the model doesn't have it; so an element's set has at most
    the model's features, and is its parent's own set where it adds none.
    """

    def __init__(self, known: Callable[[str], object]):
        self.known = known
        self.each: dict[Element | None, tuple[object, frozenset, frozenset | None]] = {None: (None, frozenset(), None)}

    def __call__(self, element: Element | None) -> frozenset:
        path = []
        while element not in self.each:
            path.append(element)
            element = element.parent
        tag, inside, within = self.each[element]
        for e in reversed(path):
            new = [f"name:{n}" for n in e.names]
            if e.tag not in ("html", "body", "div"):
                new.append(f"in:{e.tag}")
            inside = self._with(inside, new)
            if e.tag in BLOCKS:
                tag = f"tag:{e.tag}"
                if within is not None:
                    within = self._with(within, [f"within:{e.tag}"])
            if e.tag in ("article", "main"):
                within = frozenset()
            self.each[e] = tag, inside, within
        last = {self.known(tag)} - {None} if tag else set()
        return inside | last | (within or frozenset())

    def _with(self, have: frozenset, new: list[str]) -> frozenset:
        more = {k for f in new if (k := self.known(f)) is not None} - have
        return have | more if more else have


#: Names of the parts of pages, as sites write them.
PARTS = {
    "menu": "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs pagination toc links",
    "header": "header masthead top topbar banner site-header branding logo tagline hero-header",
    "footer": "footer bottom colophon site-footer copyright legal foot imprint",
    "sidebar": "sidebar aside side rail widget widgets related recommended popular trending more secondary column-right",
    "notice": "notice cookie cookies consent gdpr alert message popup modal overlay newsletter subscribe signup paywall toast announcement",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner-ad adsense dfp partner",
    "form": "form search login contact signin searchform register poll",
    "comments": "comment comments commentlist reply replies respond disqus discussion reader-comments responses thread",
    "share": "share social sharing follow tags meta byline author-box date author",
    "main": "content article post entry story main body text page article-body post-content entry-content main-content article-text story-body",
}


def training_pages(n: int = 400, seed: int = 7) -> Iterator[tuple[str, list[str]]]:
    """Pages and the texts of their main blocks."""
    r = random.Random(seed)
    alphabet = "".join(chr(c) for c in range(97, 123)) + "éèüößñ"

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high)))

    def sentence(low: int, high: int) -> str:
        return r.choice(["{}.", "{}.", "{}!", "{}?", "{}, {}."]).format(words(low, high).capitalize(), words(2, 8))

    def called(part: str, often: float = 0.85) -> str:
        name = r.choice(PARTS[part].split())
        return "" if r.random() > often else r.choice([f' class="{name}"', f' id="{name}"', f' class="x {name}"', f" class='{name}-box'", f' class="{name}_wrap"'])

    def link(text: str) -> str:
        return f'<a href="/{r.randint(0, 999)}">{text}</a>'

    def around(part: str, tag: str, inside: str) -> str:
        t = r.choice([tag, tag, "div"])
        return f"<{t}{called(part, 0.4 if t == tag and tag != 'div' else 1.0)}>{inside}</{t}>"

    def menu() -> str:
        items = [link(words(1, 3)) for _ in range(r.randint(2, 8))]
        return around("menu", "nav", r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<span>{x}</span>" for x in items)]))

    def list_() -> str:
        return f"<h3>{words(1, 3)}</h3><ul>" + "".join(f"<li>{link(words(3, 9))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"

    def paragraphs(low: int, high: int) -> str:
        return "".join(f"<p>{' '.join(sentence(3, 14) for _ in range(r.randint(1, 5)))}</p>" for _ in range(r.randint(low, high)))

    def form() -> str:
        return f'<form{called("form", 0.5)}><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button>' + r.choice(["", f"<p>{sentence(3, 9)}</p>", f"<select><option>{words(1, 2)}</option><option>{words(1, 2)}</option></select>"]) + "</form>"

    def comments() -> str:
        one = lambda: r.choice([f"<div{called('comments')}><b>{words(1, 2)}</b><p>{sentence(3, 20)}</p></div>", f"<li><p>{words(1, 2)}</p><p>{sentence(3, 20)} {sentence(3, 20)}</p></li>", f"<article{called('comments', 1)}><header>{words(1, 2)}</header><p>{sentence(4, 25)}</p></article>"])
        return around("comments", "section", f"<h3>{words(1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 5)))) if r.random() < 0.7 else f"<ol{called('comments', 1)}>" + "".join(one() for _ in range(r.randint(1, 5))) + "</ol>"

    def aside() -> str:
        return around("sidebar", "aside", r.choice([list_(), paragraphs(1, 2), list_() + paragraphs(1, 1)]))

    def advert() -> str:
        return f"<div{called('advert', 1)}>{r.choice([sentence(2, 14), link(words(2, 8)), paragraphs(1, 1), sentence(2, 6) + chr(10) + sentence(2, 9)])}</div>"

    def notice() -> str:
        return f"<{(t := r.choice(['div', 'div', 'section', 'dialog']))}{called('notice', 1)}>{r.choice([sentence(4, 16), paragraphs(1, 2), sentence(4, 12) + '<button>' + words(1, 2) + '</button>'])}</{t}>"

    def footer() -> str:
        inside = r.choice([f"&copy; {words(1, 3)} &middot; {sentence(2, 9)}", f"<p>&copy; {words(1, 3)}</p>" + "".join(link(words(1, 2)) for _ in range(4)), paragraphs(1, 2), f"<ul><li>{link(words(1, 2))}</li><li>{link(words(1, 2))}</li></ul><p>{words(1, 4)}</p>"])
        return around("footer", "footer", inside)

    def header() -> str:
        return around("header", "header", r.choice([f"<h1>{words(1, 3)}</h1><p>{words(2, 6)}</p>", f"<div{called('header')}>{link(words(1, 2))}</div>", link(words(1, 3)) + menu(), f"<p>{sentence(2, 6)}</p>"]))

    for _ in range(n):
        kept: list[str] = []

        def main_block(kept: list[str] = kept) -> str:
            kind = r.random()
            text = " ".join(sentence(2, 16) for _ in range(r.randint(1, 6)))
            if r.random() < 0.08:
                text = words(1, 3)
            kept.append(text)
            if kind < 0.62:
                return f"<p>{text}</p>"
            if kind < 0.70:
                first, _, rest = text.partition(" ")
                return f"<p><b>{first}</b> {rest}" + r.choice(["</p>", "", "<br>"])
            if kind < 0.76:
                return f"<blockquote>{text}</blockquote>"
            if kind < 0.82:
                kept[-1] = words(1, 8).capitalize()
                return f"<h{(k := r.randint(2, 4))}>{kept[-1]}</h{k}>"
            if kind < 0.88:
                return f"<div>{text}</div>"
            if kind < 0.93:
                cells = [text, words(1, 12)]
                kept[-1:] = cells
                return "<ul>" + "".join(f"<li>{c}</li>" for c in cells) + "</ul>"
            if kind < 0.96:
                cells = [words(1, 3), words(1, 3)]
                kept[-1:] = cells
                return "<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>"
            first, _, rest = text.partition(" ")
            return f"<p>{link(first)} {rest}</p>"

        kept.append(words(2, 10).capitalize())
        title = f"<h1>{kept[0]}</h1>"
        if r.random() < 0.25:
            title = f"<header>{title}</header>"
        if r.random() < 0.25:
            title += f"<{(t := r.choice(['p', 'div']))}{called('share', 1)}>{words(1, 4)}</{t}>"
        body = [main_block() for _ in range(r.choice([1, 2, 4, 7, 12]))]
        for part, often in ((advert, 0.25), (notice, 0.1), (aside, 0.12), (form, 0.08)):
            if r.random() < often:
                body.insert(r.randint(0, len(body)), part())
        holder = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        inside = title + "".join(body)
        if r.random() < 0.15:
            inside += comments()
        page = f"<{holder}{called('main', 1.0 if holder in ('div', 'section') else 0.4)}>{inside}</{holder}>"
        if r.random() < 0.25:
            page = r.choice(["<main>{}</main>", '<div id="main">{}</div>', '<div class="container">{}</div>']).format(page)
        before = [p() for p, often in ((header, 0.55), (menu, 0.7), (notice, 0.3), (advert, 0.4), (form, 0.2), (aside, 0.15)) if r.random() < often]
        after = [p() for p, often in ((comments, 0.35), (aside, 0.4), (advert, 0.25), (form, 0.2), (notice, 0.15), (menu, 0.2)) if r.random() < often]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.85:
            after.append(footer())
        yield f"<html><head><title>{words(1, 5)}</title></head><body>{''.join(before)}{page}{''.join(after)}</body></html>", kept


def _log_sum(a: np.ndarray) -> np.ndarray:
    """Over the last axis but one, of two."""
    top = a.max(axis=-2, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=-2, keepdims=True)))[..., 0, :]


class Field:
    """A conditional random field with labels 0 (around) and 1 (main): weights of features, and of neighbouring labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.names, self.weights, self.pairs = names, weights, pairs

    def scores(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        paths, above = Paths(self.names.get), {}
        for i, b in enumerate(page):
            if b.element not in above:
                above[b.element] = self.weights[sorted(paths(b.element))].sum(axis=0)
            own = [k for f in own_features(b) if (k := self.names.get(f)) is not None]
            out[i] = above[b.element] + self.weights[own].sum(axis=0)
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The most likely labels, by Viterbi; ties go to 0."""
        if not page:
            return []
        (a, b), pairs, back = (0.0, 0.0), self.pairs.tolist(), []
        for i, (s0, s1) in enumerate(self.scores(page).tolist()):
            if i:
                came = (int(b + pairs[1][0] > a + pairs[0][0]), int(b + pairs[1][1] > a + pairs[0][1]))
                back.append(came)
                a, b = (a, b)[came[0]] + pairs[came[0]][0], (a, b)[came[1]] + pairs[came[1]][1]
            a, b = a + s0, b + s1
        labels = [int(b > a)]
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return labels[::-1]


def labelled(pages: Iterator[tuple[str, list[str]]]) -> list[tuple[list[Block], list[int]]]:
    """Blocks with labels: main blocks are those whose texts come next in the list of a page's main texts."""
    out = []
    for page, kept in pages:
        own, labels, at = blocks(page), [], 0
        for b in own:
            hit = at < len(kept) and b.text == " ".join(kept[at].split())
            labels.append(int(hit))
            at += hit
        out.append((own, labels))
    return out


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 150, ridge: float = 3e-4, least: int = 3) -> Field:
    """Maximum likelihood with a ridge by Adam steps; forward and backward sums run over all pages at once."""
    count: dict[str, int] = {}
    each = []
    for page, _ in pages:
        paths = Paths(lambda f: f)
        each.append([own_features(b) + sorted(paths(b.element)) for b in page])
    for page in each:
        for f in page:
            for x in f:
                count[x] = count.get(x, 0) + 1
    names = {x: i for i, x in enumerate(sorted(x for x, n in count.items() if n >= least))}
    n, longest = len(pages), max(len(p) for p in each)
    flat = np.zeros((n * longest, len(names)))
    mask, gold = np.zeros((n, longest), bool), np.zeros((n, longest), int)
    for i, (page, (_, labels)) in enumerate(zip(each, pages, strict=True)):
        mask[i, : len(page)], gold[i, : len(page)] = True, labels
        for j, f in enumerate(page):
            flat[i * longest + j, [names[x] for x in f if x in names]] = 1
    used = flat[mask.ravel()]
    truth = np.eye(2)[gold] * mask[..., None]
    steps_gold = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    w, pairs = np.zeros((len(names), 2)), np.zeros((2, 2))
    state = [np.zeros_like(x) for x in (w, w, pairs, pairs)]
    blocks_ = int(mask.sum())
    for step in range(1, steps + 1):
        s = np.zeros((n, longest, 2))
        s[mask] = used @ w
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0]
        for t in range(1, longest):
            new = _log_sum(forward[:, t - 1, :, None] + pairs) + s[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _log_sum((backward[:, t + 1] + s[:, t + 1])[:, :, None] + pairs.T)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        z = _log_sum(forward[:, -1][:, :, None])[:, 0]
        marginal = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
        both = forward[:, :-1, :, None] + pairs + (s + backward)[:, 1:, None, :] - z[:, None, None, None]
        both = (np.exp(np.minimum(both, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
        gradients = (used.T @ (marginal - truth)[mask] / blocks_ + ridge * w, (both - steps_gold) / blocks_ + ridge * pairs)
        for k, (x, g) in enumerate(zip((w, pairs), gradients, strict=True)):
            m, v = state[2 * k], state[2 * k + 1]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            x -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(names, w, pairs)


@functools.cache
def default_field() -> Field:
    return train(labelled(training_pages()))


def main_text(page: str | None, field: Field) -> str:
    own = blocks(page or "")
    return "\n".join(b.text for b, main in zip(own, field.decode(own), strict=True) if main)


def extract(spark: SparkSession, pages: DataFrame, field: Field | None = None) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars.

    pages needs page_id, url and html; other columns are not read. text joins the main blocks by line ends;
    character references are decoded, white space within a block is one space. Null and empty html, and pages without a
    main block, give an empty text. Each page is read whole, by itself; repeated rows return as often. The field, some hundred weights, is trained once
    on the driver and goes with the tasks.
    """
    field = field or default_field()
    small_batches(spark)

    @F.pandas_udf("string")
    def text(html_: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, field) for x in html_], dtype=object)

    found = pages.select("page_id", "url", text("html").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
