"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is read tag by tag, in one pass that takes any broken markup, into leaf blocks: stretches of text between block-level
tags, each with its open ancestors. Ancestor tags, words of their class and id names, link density and text features are the
observations; the two labels are main text and other. The field is trained on the driver by maximum likelihood (forward-
backward, Adam, numpy) on labelled pages that training_pages() makes from a list of page layouts, and decoded by Viterbi.

Defined cases: null or empty html gives empty text. Unclosed elements last until an enclosing one closes. A page that ends
inside a tag or comment ends there. An element hides its text by its kind (HIDDEN), the attribute `hidden` or display:none in its
style, and by nothing else; a head ends where the body's first element or text begins. Pages without any block give empty text. Very long pages are read whole. Repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from wordvane.llm.common import in_small_batches

# Fixed values of HTML: elements that flow within a line, void elements, and elements whose content is no page text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label ruby rt rp img math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml maction menclose mfenced".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title template noscript svg iframe object canvas textarea select option datalist audio video".split())
RAW = frozenset("script style textarea title iframe noscript template svg select".split())
#: An opening tag of these closes an open element of the same kind, as in HTML.
SELF_CLOSING = frozenset("p li dt dd option tr td th".split())

#: A quote opens a value only after an equals sign; anywhere else it is a character of the tag.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)?)*+)>")
COMMENT_END = re.compile("--!?>")
UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'>][^\s>]*/\Z")
NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
MAY_HIDE = re.compile("hidden|style", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SPLIT_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Words in class, id and role names, by what they tell.
NAME_GROUPS = {
    "ad": "ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored sponsors outbrain taboola adsense dfp",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip",
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular",
    "foot": "footer foot copyright colophon legal bottom",
    "head": "header masthead topbar top site logo branding toolbar",
    "comment": "comment comments disqus discussion reply replies respond reader reactions review",
    "notice": "cookie cookies consent gdpr notice notices alert banner popup modal overlay warning paywall subscribe newsletter signup",
    "share": "share sharing social tweet facebook follow tags meta byline",
    "form": "form search login register contact input",
    "main": "main content article post entry story body text page maincontent articlebody postbody entrycontent",
}
NAME_OF = {w: g for g, words in NAME_GROUPS.items() for w in words.split()}
TAG_GROUPS = "article main nav header footer aside form section ul ol li table blockquote pre h1 h2 h3 h4 p div figure figcaption dl button address details dialog body".split()
#: What an element's tag and names say counts apart where the element holds most of the page's text: such an element is a wrapper of the page.
MARKS = [f"tag:{t}" for t in TAG_GROUPS] + [f"name:{g}" for g in NAME_GROUPS]
FEATURES = MARKS + [f"wide {m}" for m in MARKS] + ["bare", "parent:p", "parent:heading", "parent:li", "parent:div", "links:all", "links:half", "links:none", "len:1", "len:2", "len:3", "len:4", "stop", "sign", "bar", "first", "bias"]
INDEX = {f: i for i, f in enumerate(FEATURES)}
LABELS = 2  # 0: other, 1: main text
#: Share of the page's characters from which on an element is a wrapper.
WIDE = 0.5


def hides_content(attributes: str) -> bool:
    """Whether an element has the attribute `hidden`, or display:none in its own style. The first attribute of a name counts."""
    if not MAY_HIDE.search(attributes):
        return False
    style = None
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "hidden":
            return True
        if name == "style" and style is None:
            style = entities.unescape(m[2] or m[3] or m[4] or "")
    shown, important = "", False
    for declaration in CSS_COMMENT.sub("", style or "").split(";"):
        key, _, value = declaration.partition(":")
        value, _, mark = value.strip().lower().partition("!")
        # the last one counts, but for one that is marked as important
        if key.strip().lower() == "display" and (mark.strip() == "important" or not important):
            shown, important = value.strip(), mark.strip() == "important"
    return shown == "none"


class Block:
    """text, the features that its open ancestors have, its nearest ancestor that isn't inline, and how many of its characters are in links."""

    __slots__ = ("text", "marks", "parent", "linked")

    def __init__(self, text: str, marks: tuple[int, ...], parent: str, linked: int):
        self.text, self.marks, self.parent, self.linked = text, marks, parent, linked


class OpenElements:
    """The elements that are open at a place of the page. What is asked of them is kept as they come and go, so that a page's time is in proportion to
    its length however deep unclosed elements pile up: where each kind stands, and which aren't inline. What came and went is a list of events:
    the number of an element that opens, its complement where it closes, and blocks. An element's characters are known when it closes."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int, bool]] = []
        self.where: dict[str, list[int]] = {}
        self.outer: list[str] = []
        self.barriers: list[int] = []  # places of elements that neither flow in a line nor are closed by others of their kind
        self.hidden = self.links = self.chars = 0
        self.events: list[int | Block] = []
        self.marks: list[tuple[int, ...]] = []  # of each element, and how many characters it holds
        self.sizes: list[int] = []

    def enter(self, name: str, marks: tuple[int, ...], hides: bool) -> None:
        at = len(self.stack)
        self.stack.append((name, len(self.marks), self.chars, hides))
        self.events.append(len(self.marks))
        self.marks.append(marks)
        self.sizes.append(0)
        self.where.setdefault(name, []).append(at)
        if name not in INLINE:
            self.outer.append(name)
            if name not in SELF_CLOSING:
                self.barriers.append(at)
        self.hidden += hides
        self.links += name == "a"

    def leave(self, at: int) -> None:
        """The element at a place closes, and all within it."""
        while len(self.stack) > at:
            name, number, before, hides = self.stack.pop()
            self.sizes[number] = self.chars - before
            self.events.append(~number)
            self.where[name].pop()
            if name not in INLINE:
                self.outer.pop()
            if self.barriers and self.barriers[-1] == len(self.stack):
                self.barriers.pop()
            self.hidden -= hides
            self.links -= name == "a"

    def add(self, block: Block) -> None:
        self.chars += len(block.text)
        self.events.append(block)

    def last(self, name: str, inside: bool = False) -> int | None:
        """Where the innermost open element of a kind stands; inside: only if no barrier stands between."""
        at = self.where.get(name)
        return at[-1] if at and not (inside and self.barriers and self.barriers[-1] > at[-1]) else None

    def blocks(self) -> list[Block]:
        """All blocks, each with the features of its ancestors, which are now known to be wrappers of the page or not."""
        self.leave(0)
        out: list[Block] = []
        on: dict[int, int] = {}
        for e in self.events:
            if isinstance(e, Block):
                e.marks = tuple(on)
                out.append(e)
                continue
            number = e if e >= 0 else ~e
            shift = len(MARKS) if self.sizes[number] >= WIDE * self.chars else 0
            for m in self.marks[number]:
                on[m + shift] = on.get(m + shift, 0) + (1 if e >= 0 else -1)
                if not on[m + shift]:
                    del on[m + shift]
        return out


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, references decoded, white space as one blank, none empty."""
    held = OpenElements()
    parts: list[str] = []
    linked = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                held.add(Block(text, (), held.outer[-1] if held.outer else "", min(linked, len(text))))
            parts.clear()
        linked = 0

    while at < end:
        lt = page.find("<", at)
        text = page[at:] if lt < 0 else page[at:lt]
        if text and not held.hidden:
            parts.append(text)
            if held.links:
                linked += len(text.strip())
        if lt < 0:
            break
        m = TAG.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                # <!--> and <!---> are comments by themselves; others end at --> or --!>
                whole = next((c for c in ("<!-->", "<!--->") if page.startswith(c, lt)), "")
                stop = None if whole else COMMENT_END.search(page, lt + 4)
                at = lt + len(whole) if whole else end if stop is None else stop.end()
            elif page[lt + 1 : lt + 2] in ("!", "?", "/") and page[lt + 1 : lt + 2]:
                stop = page.find(">", lt)
                at = end if stop < 0 else stop + 1
            elif page[lt + 1 : lt + 2].isalpha():
                stop = page.find(">", lt)  # an odd quote; or the page ends in the tag
                at = end if stop < 0 else stop + 1
            else:
                if not held.hidden:
                    parts.append("<")
                at = lt + 1
            continue
        at = m.end()
        closing, name = m[1], m[2].lower()
        inline = name in INLINE
        if not inline:
            close()
        if name == "head":
            continue  # what hides there hides by itself; anything else stands in the body, whether head is closed or not
        if closing:
            if (place := held.last(name)) is not None:
                held.leave(place)
            continue
        # An open one of the same kind ends here, unless a list, table or other block stands between.
        if name in SELF_CLOSING and (place := held.last(name, inside=True)) is not None:
            held.leave(place)
        closed = m[3].endswith("/") and not UNQUOTED_SLASH.search(m[3])
        if name in VOID or closed and (name == "svg" or name not in RAW):
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end if stop is None else stop.end()
            close()
            continue
        attributes = m[3]
        # what body and html are called is of the page, not of its parts
        marks = {NAME_OF[w] for found in NAMES.findall(attributes) for x in found for w in map(str.lower, SPLIT_NAMES.findall(x)) if w in NAME_OF} if "=" in attributes and name not in ("body", "html") else set()
        on = tuple(sorted(INDEX[f"name:{g}"] for g in marks)) + ((INDEX[f"tag:{name}"],) if f"tag:{name}" in INDEX else ())
        held.enter(name, on, name in HIDDEN or hides_content(attributes))
    close()
    return held.blocks()


def observed(found: list[Block]) -> list[list[int]]:
    """Indices of the features that are on, of each block."""
    out = []
    for i, b in enumerate(found):
        on = {"bias"}
        on.add("parent:heading" if re.fullmatch("h[1-6]", b.parent) else f"parent:{b.parent}")
        share, words = b.linked / len(b.text), b.text.count(" ") + 1
        on.add("links:all" if share > 0.8 else "links:half" if share > 0.3 else "links:none")
        on.add(f"len:{1 if words < 4 else 2 if words < 10 else 3 if words < 40 else 4}")
        if b.text[-1] in ".!?:;\"'”»…":
            on.add("stop")
        if any(c in b.text for c in "©®™"):
            on.add("sign")
        if " | " in b.text or " · " in b.text or " » " in b.text:
            on.add("bar")
        if i == 0:
            on.add("first")
        if not b.parent:
            on.add("bare")
        out.append([*b.marks, *(INDEX[f] for f in on if f in INDEX)])
    return out


class ChainField:
    """weights: feature x label; step: label x label; begin: label."""

    def __init__(self, weights: np.ndarray, step: np.ndarray, begin: np.ndarray):
        self.weights, self.step, self.begin = weights, step, begin

    def decode(self, on: list[list[int]]) -> list[int]:
        """Viterbi; ties go to main text."""
        if not on:
            return []
        w, step = self.weights, self.step.tolist()
        scores = [w[f].sum(axis=0).tolist() for f in on]
        s0, s1 = scores[0][0] + self.begin[0], scores[0][1] + self.begin[1]
        back = []
        for e0, e1 in scores[1:]:
            a, b = s0 + step[0][0], s1 + step[1][0]
            c, d = s0 + step[0][1], s1 + step[1][1]
            back.append((0 if a > b else 1, 0 if c > d else 1))
            s0, s1 = max(a, b) + e0, max(c, d) + e1
        label = 0 if s0 > s1 else 1
        out = [label]
        for pointers in reversed(back):
            label = pointers[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> ChainField:
    """Maximum likelihood by Adam; all pages at once, filled up to the longest."""
    n, longest, k = len(pages), max(len(y) for _, y in pages), len(FEATURES)
    x, y, mask = np.zeros((n, longest, k), np.float32), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (on, labels) in enumerate(pages):
        for j, f in enumerate(on):
            x[i, j, f] = 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    gold = np.eye(LABELS)[y] * mask[..., None]
    pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    params = [np.zeros((k, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    logsum = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    for r in range(1, rounds + 1):
        w, step, begin = params
        e = x @ w
        alpha, beta = np.zeros((n, longest, LABELS)), np.zeros((n, longest, LABELS))
        alpha[:, 0] = e[:, 0] + begin
        for t in range(1, longest):
            moved = logsum(alpha[:, t - 1, :, None] + step, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], moved, alpha[:, t - 1])
        total = logsum(alpha[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            moved = logsum(step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], moved, beta[:, t + 1])
        node = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        grads = [np.einsum("ntk,ntl->kl", x, node - gold) / n + decay * w, (edge.sum(axis=(0, 1)) - pairs) / n + decay * step, (node[:, 0] - gold[:, 0]).sum(axis=0) / n + decay * begin]
        for value, g, m, v in zip(params, grads, first, second, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            value -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return ChainField(*params)


def training_pages(n: int = 400, seed: int = 3) -> list[tuple[str, str]]:
    """(html, main text) of made-up pages: one of several frames around an article, with some of many kinds of other blocks."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[int(rng.integers(len(options)))]
    letters = "etaoinshrdlu"
    word = lambda: "".join(letters[int(i)] for i in rng.integers(0, len(letters), int(rng.integers(2, 9))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    sentence = lambda a=4, b=14: words(a, b).capitalize() + pick(".", ".", ".", "!", "?")
    some = lambda p: rng.random() < p
    out = []
    for _ in range(n):
        main: list[str] = []

        def keep(text: str, main=main) -> str:
            main.append(text)
            return text

        links = lambda a, b: "".join(f'<li><a href="/{w}">{w}</a></li>' for w in (words(1, 3) for _ in range(int(rng.integers(a, b)))))
        menu = pick(lambda: f"<nav><ul>{links(3, 8)}</ul></nav>", lambda: f'<div class="{pick("menu", "navbar", "main-navigation", "breadcrumb")}"><ul>{links(3, 8)}</ul></div>', lambda: f'<ul id="{pick("menu", "nav")}">{links(2, 6)}</ul>', lambda: "")()
        header = pick(lambda: f"<header><a href='/'>{words(1, 3)}</a><p>{sentence()}</p></header>", lambda: f'<div id="{pick("header", "masthead", "site-header")}"><h1>{words(1, 4)}</h1><p>{sentence(3, 8)}</p></div>', lambda: "", lambda: "")()
        advert = lambda: f'<{(t := pick("div", "div", "aside", "section"))} class="{pick("ad", "ads", "advert", "promo", "sponsored", "ad-banner")}">{pick("", "<p>")}{sentence(3, 20)}</{t}>'
        notice = lambda: f'<div class="{pick("cookie-notice", "consent", "alert", "newsletter", "popup", "notice")}">{pick("", "<p>")}{sentence(4, 16)} <a href="#">{word()}</a></div>'
        form = lambda: f'<form {pick("", "class=search", "id=login")}><label>{words(1, 3)}</label><input name="q"><button>{word()}</button>{pick("", f"<p>{sentence()}</p>")}</form>'
        side = lambda: pick(f"<aside><h3>{words(1, 4)}</h3><ul>{links(2, 6)}</ul></aside>", f'<div class="{pick("sidebar", "related", "widget", "rail")}"><h3>{words(1, 3)}</h3><p>{sentence(5, 20)}</p></div>', f"<aside><p>{sentence(6, 24)}</p><p>{sentence()}</p></aside>")
        comments = lambda: f'<{(t := pick("section", "div", "div"))} {pick("id", "class")}="{pick("comments", "comment-list", "discussion", "reader-comments")}"><h2>{words(1, 3)}</h2>' + "".join(pick(f'<div class="comment"><p>{sentence(5, 25)} {sentence()}</p></div>', f"<p>{sentence(4, 22)}</p>", f"<li><b>{word()}</b> {sentence(4, 20)}</li>") for _ in range(int(rng.integers(1, 5)))) + f"</{t}>"
        footer = pick(lambda: f"<footer>&copy; {word()}.example &middot; {sentence()}</footer>", lambda: f'<div class="{pick("footer", "site-footer", "copyright")}"><p>&copy; {words(1, 5)}</p><p>{sentence()}</p></div>', lambda: f"<footer><ul>{links(2, 5)}</ul><p>{sentence()}</p></footer>", lambda: "")()
        body = []
        if some(0.8):
            body.append(f"<h1>{keep(words(2, 10))}</h1>")
        for _ in range(int(rng.integers(1, 12))):
            kind = rng.random()
            if kind < 0.62:
                text = " ".join(sentence(3, 20) for _ in range(int(rng.integers(1, 8))))
                body.append(f"<p>{keep(text)}{pick('</p>', '</p>', '</p>', '')}")
            elif kind < 0.68:
                body.append(f"<p>{keep(words(1, 5) + pick('', '.'))}</p>")
            elif kind < 0.74:
                body.append(f"<p><b>{keep(sentence(1, 12))}<br>")
            elif kind < 0.8:
                body.append(f"<{(h := pick('h2', 'h3', 'h4'))}>{keep(words(1, 7))}</{h}>")
            elif kind < 0.86:
                body.append("<ul>" + "".join(f"<li>{keep(words(1, 12))}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote>{keep(sentence(5, 20))}</blockquote>")
            elif kind < 0.93:
                a, b, c = sentence(2, 6), words(1, 3), sentence(2, 8)
                body.append(f'<p>{a} <a href="/x">{b}</a> {c}</p>')
                keep(f"{a} {b} {c}")
            elif kind < 0.95:
                body.append("<table><tr>" + "".join(f"<td>{keep(words(1, 4))}</td>" for _ in range(3)) + "</tr></table>")
            else:
                body.append(pick(advert, notice, form, side)())
        inner = "".join(body)
        frame = pick("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post"><div class="entry-content">{}</div></div>', '<section class="story">{}</section>', "<div>{}</div>")
        article = frame.format(inner)
        if some(0.3):  # everyday outer elements that carry names of what they hold, or that make a page one form
            wrapper = pick('<div class="{}">{{}}</div>', '<div id="{}">{{}}</div>', '<main class="{}">{{}}</main>', '<section class="{}">{{}}</section>').format(pick("has-sidebar", "with-sidebar", "layout-sidebar", "header-fixed", "has-header", "comments-open", "no-ads", "menu-open", "popup-closed", "with-notice", "article-related", "footer-bottom", "site", "top"))
            article = wrapper.format(article)
        before = "".join(x for x in (header, menu, *(b() for b in (advert, notice, form, side) if some(0.3))))
        after = "".join(b() for b in (comments, advert, side, form, notice) if some(0.3)) + footer
        whole = before + article + after
        if some(0.25):
            whole = pick('<form id="aspnetForm" method="post">{}</form>', "<form>{}</form>", '<div class="page has-sidebar">{}</div>', '<div id="wrapper" class="header-fixed comments-open">{}</div>', '<div class="site with-menu">{}</div>').format(whole)
        body_tag = pick("<body>", "<body>", '<body class="has-sidebar comments-open">', '<body id="top" class="header-fixed">')
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head>{body_tag}{whole}</body></html>"
        if some(0.04):  # a page of text alone
            main = [" ".join(sentence(3, 20) for _ in range(int(rng.integers(1, 8))))]
            page = main[0]
        out.append((page, " ".join(main)))
    return out


def labels_of(found: list[Block], main: str) -> list[int]:
    """1 for the blocks that make up the main text, found in its order; made-up words hardly repeat across blocks."""
    out, at = [], 0
    for b in found:
        here = main.startswith(b.text, at) and main[at + len(b.text) : at + len(b.text) + 1] in ("", " ")
        out.append(int(here))
        at += (len(b.text) + 1) * here
    return out


@lru_cache(maxsize=1)
def trained() -> ChainField:
    pages = [(observed(b), labels_of(b, main)) for page, main in training_pages() if (b := blocks(page))]
    return fit(pages)


def main_text(page: str | None, field: ChainField) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, label in zip(found, field.decode(observed(found)), strict=True) if label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row."""
    field = trained()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h, field) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_small_batches(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
