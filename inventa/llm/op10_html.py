"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text inside one block element, with the tags around them. Each block has
features of its ancestors (tags, words of class, id and role, the innermost container that means something) and of its
text (length, link share, signs). The field has two labels, content and other, is trained by gradient steps on the
exact likelihood (forward-backward) over labelled pages, and decoded by Viterbi. Labelled pages come from `make_page`,
a generator of layouts with many kinds of content and surroundings, since the tables have none; pass pages of your own
to `train` for another model. Training is deterministic and takes a second or two.

Defined results: null or empty html gives an empty text; so does a page on which no block is content. Unfinished tags
at the end are dropped, unfinished character references stay as they are. Scripts, styles, comments of the markup, the
head, and what a browser with scripts never shows (templates, frames, noscript) are no blocks; formulas, drawings and what
stands inside objects are text like any other. A script or style without an end hides the rest of the page, as in a
browser; any other element without an end ends with its parent. All Unicode white space counts as such.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inventa.llm.common import parallel, prepare, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/a-zA-Z!?][^>]*(?:>|\Z)""", re.S)
#: Name and value of each attribute, one after the other, so that nothing inside a value or a longer name is taken for one.
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s"'>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
TELLING = frozenset("class id role aria-label itemprop hidden style".split())
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup; without an end tag the first two hide the rest of the page.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
SILENT = RAW | {"head", "noscript", "template"}
#: What may stand in a head; any other tag, or text, ends it.
IN_HEAD = frozenset("title meta link base script style noscript template".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Start tags that close an open element, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
P_STOPS = frozenset("button td th caption table html body".split())
KINDS = {
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc tabs".split(),
    "footer": "footer foot colophon copyright legal".split(),
    "header": "header masthead topbar site branding logo".split(),
    "side": "sidebar side aside widget widgets related recommended recommendations more popular trending rail teaser teasers".split(),
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner dfp outbrain taboola".split(),
    "comment": "comment comments commentlist disqus reply replies respond discussion reviews feedback".split(),
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall toast disclaimer privacy".split(),
    "share": "share sharing social follow tools tags tagged meta byline".split(),
    "form": "form search login signin signup register contact input".split(),
    "content": "content article post entry story body text main prose page maincontent articlebody".split(),
}
KIND_OF = {w: k for k, ws in KINDS.items() for w in ws}
TAG_KIND = {"nav": "nav", "menu": "nav", "footer": "footer", "header": "header", "aside": "side", "form": "form", "fieldset": "form", "select": "form", "button": "form", "dialog": "notice", "article": "content", "main": "content", "search": "form"}
HINTS = re.compile(r"©|\(c\) ?\d{4}|all rights|copyright|cookie|privacy|terms of|subscribe|newsletter|sign up|log ?in|advert|sponsored|share this|read more|follow us|related|leave a (?:reply|comment)|datenschutz|impressum|politique de|confidentialit|privacidad|derechos", re.I)
#: Each phrase of HINTS has one of these, which are found sooner.
STEMS = "©|(c)|all rights|copyright|cookie|privacy|terms of|subscribe|newsletter|sign up|log|advert|sponsored|share this|read more|follow us|related|leave a|datenschutz|impressum|politique de|confidentialit|privacidad|derechos".split("|")
BASE_KINDS = ("nav", "footer", "header", "side", "ad", "comment", "notice", "share", "form", "content")
TAGS_SEEN = "p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption div span a button label option section body caption".split()


class Frame:
    """An open element and what its ancestors say; features of a block are those of its frame and its text."""

    __slots__ = ("tag", "inner", "kinds", "tags", "features", "children", "silent", "foreign", "owner")

    def __init__(self, tag: str, attributes: str, parent: Frame | None):
        self.tag, self.children = tag, {}
        self.silent = tag in SILENT or bool(parent and parent.silent)
        self.foreign = tag in ("svg", "math") or bool(parent and parent.foreign)
        self.owner = self if parent is None or tag in BLOCK else parent.owner  # the block element that text here belongs to
        inner, kinds = (parent.inner, parent.kinds) if parent else ("none", frozenset())
        found = []
        if tag in TAG_KIND:
            # The header of an article belongs to it.
            found.append("content" if tag == "header" and parent and parent.inner == "content" else TAG_KIND[tag])
        if attributes and tag not in ("html", "body"):
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), next((v for v in values if v), "")
                if name not in TELLING:
                    continue
                if name == "hidden" or name == "style":
                    if name == "hidden" or re.search(r"display\s*:\s*none", value):
                        found.append("notice")
                else:
                    found += [KIND_OF[w.lower()] for w in WORD.findall(value) if w.lower() in KIND_OF]
        strong = [k for k in found if k not in ("content", "header")]
        if found:
            inner = (strong or found)[0]
            kinds = kinds | set(found)
        self.inner, self.kinds = inner, kinds
        self.tags = (parent.tags if parent else frozenset()) | {tag}
        block = tag if tag in TAGS_SEEN else "other"
        holds = [t for t in ("article", "main", "table", "ul", "ol", "blockquote", "figure", "form", "section", "p") if t in self.tags]
        self.features = tuple([f"inner:{inner}", f"block:{block}", f"inner:{inner}+{block}"] + [f"kind:{k}" for k in sorted(kinds)] + [f"in:{t}" for t in holds])

    def child(self, tag: str, attributes: str) -> Frame:
        key = (tag, attributes)
        if (f := self.children.get(key)) is None:
            f = Frame(tag, attributes, self)
            if len(self.children) < 50:
                self.children[key] = f
        return f


class Stack:
    """Open elements, and how many there are of each tag, so that a tag without a partner costs nothing at any depth."""

    def __init__(self):
        self.frames, self.open = [Frame("body", "", None)], defaultdict(int)

    def push(self, tag: str, attributes: str) -> None:
        self.frames.append(self.frames[-1].child(tag, attributes))
        self.open[tag] += 1

    def cut(self, i: int) -> None:
        for f in self.frames[i:]:
            self.open[f.tag] -= 1
        del self.frames[i:]

    def end(self, tag: str) -> None:
        """An end tag: inline elements end inside their block only."""
        if not self.open[tag]:
            return
        for i in range(len(self.frames) - 1, 0, -1):
            f = self.frames[i]
            if f.tag == tag:
                return self.cut(i)
            if tag not in BLOCK and tag not in SILENT and f.tag in BLOCK:
                return

    def end_implied(self, what: set[str] | frozenset[str], until: set[str] | frozenset[str], several: bool = False) -> None:
        """What a start tag ends: the innermost of these elements, or several, up to a container."""
        if not any(self.open[t] for t in what):
            return
        for i in range(len(self.frames) - 1, 0, -1):
            if self.frames[i].tag in until:
                return
            if self.frames[i].tag in what:
                self.cut(i)
                if not several:
                    return


def after_raw(page: str, tag: str, place: int) -> int | None:
    """The place after the end tag of a raw element, None if there is none."""
    m = END_OF[tag].search(page, place)
    if m is None:
        return None
    stop = page.find(">", m.end())
    return len(page) if stop < 0 else stop + 1


END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def leaf_blocks(page: str) -> list[tuple[str, Frame, int]]:
    """(text, frame of its block element, characters inside links) of each leaf block, in page order."""
    stack = Stack()
    frames = stack.frames
    out, text, links, place, owner = [], [], 0, 0, frames[0]
    endless = set()  # raw elements that no end tag follows any more

    def flush() -> None:
        nonlocal text, links
        if text:
            t = " ".join("".join(text).split())
            if t:
                out.append((t, owner, links))
            text, links = [], 0

    def say(raw: str) -> None:
        nonlocal links, owner
        if frames[-1].silent:
            if frames[-1].tag != "head" or raw.isspace():
                return
            stack.end("head")
        t = html_lib.unescape(raw) if "&" in raw else raw
        if not text and not t.isspace():
            owner = frames[-1].owner
        text.append(t)
        if stack.open["a"]:
            links += len(t.strip())

    n = len(page)
    while place < n:
        m = TOKEN.search(page, place)
        if m is None:
            say(page[place:])
            break
        if m.start() > place:
            say(page[place : m.start()])
        place = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag == "br":
            text.append(" ") if text else None
            continue
        if closing:
            if tag in BLOCK:
                flush()
            stack.end(tag)
            continue
        if frames[-1].tag == "head" and tag not in IN_HEAD:
            stack.end("head")
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag in RAW and tag not in endless:
            if frames[-1].foreign and m[3].endswith("/"):
                continue
            stop = after_raw(page, tag, place)
            if stop is None and tag in ("script", "style"):
                break
            if stop is not None:
                place = stop
                continue
            endless.add(tag)
        if tag in BLOCK:
            flush()
            if tag not in ("button", "option", "select"):
                stack.end_implied({"p"}, P_STOPS)
            if tag in CLOSES:
                stack.end_implied(*CLOSES[tag], tag in ("tr", "tbody"))
        if tag in ("html", "body"):
            continue
        if m[3].endswith("/") and (frames[-1].foreign or tag in ("svg", "math")):
            continue
        stack.push(tag, m[3])
    flush()
    return out


LENGTHS = (3, 10, 25, 60, 140, 300)
#: A text hints at what surrounds an article if it has a phrase of HINTS for each so many characters.
HINT_EVERY = 400


def block_features(blocks: list[tuple[str, Frame, int]]) -> list[tuple[str, ...]]:
    out = []
    for i, (t, frame, links) in enumerate(blocks):
        n = len(t)
        size = sum(n >= x for x in LENGTHS)
        share = 3 if links >= 0.9 * n else 2 if links >= 0.4 * n else 1 if links else 0
        end = "stop" if t[-1] in ".!?…:\"”»" else "none"
        f = [f"len:{size}", f"link:{share}", f"end:{end}", f"len+link:{size},{share}", f"inner+len:{frame.inner},{size}"]
        low = t.lower()
        if any(stem in low for stem in STEMS) and HINT_EVERY * sum(1 for _ in HINTS.finditer(t)) > n:
            f.append("hint")
        if i == 0:
            f.append("first")
        if i == len(blocks) - 1:
            f.append("last")
        if frame.tag == "h1":
            f.append("title")
        out.append((*frame.features, *f, "bias"))
    return out


# The field -----------------------------------------------------------------------------------------------------------


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[tuple[str, ...]], list[int]]], steps: int = 120, rate: float = 0.5, l2: float = 1e-3) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Weights of each feature for the two labels, and of the label pairs. pages: (features of the blocks, labels)."""
    pages = [p for p in pages if p[0]]
    names = {f: i for i, f in enumerate(sorted({f for fs, _ in pages for b in fs for f in b}))}
    many, longest = len(pages), max(len(ls) for _, ls in pages)
    x = np.zeros((many, longest, len(names)))
    y, mask = np.zeros((many, longest), int), np.zeros((many, longest), bool)
    for k, (fs, ls) in enumerate(pages):
        mask[k, : len(ls)], y[k, : len(ls)] = True, ls
        for j, b in enumerate(fs):
            x[k, j, [names[f] for f in b]] = 1
    truth = np.eye(2)[y] * mask[..., None]
    pair = mask[:, 1:]
    seen = np.einsum("kti,ktj->ij", truth[:, :-1], truth[:, 1:])
    flat, flat_truth = x.reshape(-1, len(names)), truth.reshape(-1, 2)
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    for _ in range(steps):
        s = (flat @ w).reshape(many, longest, 2)
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[:, 0] = s[:, 0]
        for j in range(1, longest):
            step = log_sum(a[:, j - 1, :, None] + t, 1) + s[:, j]
            a[:, j] = np.where(mask[:, j, None], step, a[:, j - 1])
        for j in range(longest - 2, -1, -1):
            step = log_sum(t + (s[:, j + 1] + b[:, j + 1])[:, None, :], 2)
            b[:, j] = np.where(mask[:, j + 1, None], step, 0)
        z = log_sum(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None]) * mask[..., None]
        both = np.exp(a[:, :-1, :, None] + t + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[..., None, None]
        dw = flat.T @ (flat_truth - p.reshape(-1, 2)) / many - l2 * w
        dt = (seen - both.sum((0, 1))) / many - l2 * t
        gw, gt = gw + dw * dw, gt + dt * dt
        w, t = w + rate * dw / np.sqrt(gw), t + rate * dt / np.sqrt(gt)
    return {f: w[i] for f, i in names.items()}, t


def viterbi(scores: np.ndarray, t: np.ndarray) -> list[int]:
    (a, b), back = scores[0], []
    (t00, t01), (t10, t11) = t.tolist()
    for s0, s1 in scores[1:].tolist():
        x0, x1 = (a + t00, 0) if a + t00 >= b + t10 else (b + t10, 1), (a + t01, 0) if a + t01 >= b + t11 else (b + t11, 1)
        back.append((x0[1], x1[1]))
        a, b = x0[0] + s0, x1[0] + s1
    label = int(b > a)
    out = [label]
    for pointers in reversed(back):
        label = pointers[label]
        out.append(label)
    return out[::-1]


class Field:
    def __init__(self, weights: dict[str, np.ndarray], pairs: np.ndarray):
        self.weights, self.pairs = {f: w.tolist() for f, w in weights.items()}, pairs
        self.known: dict[tuple, tuple] = {}

    def label(self, blocks: list[tuple[str, Frame, int]]) -> list[int]:
        if not blocks:
            return []
        scores = []
        for features in block_features(blocks):
            if (s := self.known.get(features)) is None:
                ws = [self.weights[f] for f in features if f in self.weights]
                s = (sum(w[0] for w in ws), sum(w[1] for w in ws))
                if len(self.known) < 50_000:
                    self.known[features] = s
            scores.append(s)
        return viterbi(np.array(scores), self.pairs)

    def extract(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return "\n\n".join(t for (t, _, _), y in zip(blocks, self.label(blocks)) if y)


# Labelled pages ------------------------------------------------------------------------------------------------------

OPEN, CLOSE = "\x02", "\x03"  # around content in the pages that are made


def make_page(rng: random.Random) -> str:
    """A page whose content is marked with OPEN and CLOSE; layouts, names and texts vary, words mean nothing."""
    syllables = "ka lo mi ter ven sa ri on ta bel gus pra ne chi dor al ум é ña ß sch tion 中 ing".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + rng.choice(".....!?")
    prose = lambda a, b: " ".join(sentence(1, 18) for _ in range(rng.randint(a, b)))
    mark = lambda t: f"{OPEN}{t}{CLOSE}"
    pick = rng.choice

    def link(a: int = 1, b: int = 3) -> str:
        return f'<a href="/{word()}">{words(a, b)}</a>'

    def links(tag: str = "ul") -> str:
        n = rng.randint(2, 9)
        return pick([f"<{tag}>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + f"</{tag}>", " | ".join(link() for _ in range(n)), "".join(f"<div>{link(2, 8)}</div>" for _ in range(n))])

    def paragraph() -> str:
        t = pick([prose(1, 6), prose(1, 2), sentence(1, 4), words(1, 3) + ".", " | ".join(words(1, 1) for _ in range(rng.randint(3, 25))), words(2, 30), " &amp; ".join(words(1, 5) for _ in range(3)), f"{prose(1, 2)} {link()} {prose(1, 2)}", words(1, 1) + "!! " + words(1, 9).upper()])
        return pick([f"<p>{mark(t)}</p>", f"<p>{mark(t)}", f"<p><b>{mark(t)}<br>", f"<p>{mark(f'<em>{words(1, 3)}</em> {t}')}</p>", f"<div>{mark(t)}</div>"])

    def piece() -> str:
        r = rng.random()
        if r < 0.78:
            return paragraph()
        return pick([
            f"<h2>{mark(words(1, 6))}</h2>", f"<h3>{mark(words(1, 6))}</h3>",
            "<ul>" + "".join(f"<li>{mark(pick([sentence(2, 14), words(1, 4)]))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>",
            "<ol>" + "".join(f"<li>{mark(words(1, 9))}" for _ in range(rng.randint(2, 5))) + "</ol>",
            f"<blockquote><p>{mark(prose(1, 2))}</p></blockquote>", f"<pre>{mark(words(3, 20))}</pre>",
            f"<figure><img src=x><figcaption>{mark(sentence(3, 9))}</figcaption></figure>",
            "<table>" + "".join("<tr>" + "".join(f"<td>{mark(words(1, 2))}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 4))) + "</table>",
        ])

    def box(names: list[str], inside: str, tags: tuple[str, ...] = ("div", "section", "aside", "div")) -> str:
        tag, a = pick(tags), pick(["class", "class", "id"])
        return f'<{tag} {a}="{pick(names)}">{inside}</{tag}>'

    noise = lambda: pick([prose(1, 2), sentence(2, 9), words(2, 8), link(2, 6)])
    ad = lambda: box(["ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner", "advertisement"], pick([noise(), f"<p>{noise()}</p>"]))
    notice = lambda: box(["cookie-notice", "cookie-banner", "gdpr", "consent", "newsletter", "subscribe-box", "alert", "modal popup", "notice"], f"<p>{pick(['We use cookies. ', 'Subscribe to our newsletter. ', ''])}{prose(1, 2)}</p>{pick(['', '<button>' + words(1, 2) + '</button>'])}")
    form = lambda: pick([f"<form action=/s><label>{words(1, 3)}</label><input name=q><button>{words(1, 1)}</button></form>", f"<form class=login><p>{sentence(2, 8)}</p><select><option>{words(1, 2)}<option>{words(1, 2)}</select></form>", f"<form><fieldset><legend>{words(1, 2)}</legend><p>{noise()}</p></fieldset></form>"])
    side = lambda: pick([f"<aside><h3>{words(1, 3)}</h3>{links()}</aside>", box(["sidebar", "widget", "related", "related-posts", "rail", "popular"], f"<h3>{words(1, 3)}</h3>{pick([links(), f'<p>{prose(1, 2)}</p>'])}", ("div", "section", "aside")), f"<aside><p>{prose(1, 2)}</p></aside>"])
    comments = lambda: box(["comments", "comment-list", "disqus_thread", "respond", "discussion", "user-comments"], f"<h3>{words(1, 3)}</h3>" + "".join(pick([f"<p>{prose(1, 3)}</p>", f'<div class="comment"><b>{word()}</b><p>{prose(1, 3)}</p></div>', f"<article><p>{prose(1, 3)}</p></article>", f"<li>{prose(1, 2)}</li>"]) for _ in range(rng.randint(1, 5))), ("div", "section", "ol"))
    nav = lambda: pick([f"<nav>{links()}</nav>", box(["menu", "navbar", "nav", "breadcrumb", "main-nav"], links()), f"<nav>{links('ol')}<p>{words(1, 3)}</p></nav>"])
    header = lambda: pick([f"<header><h1>{words(1, 3)}</h1><p>{sentence(2, 6)}</p></header>", f"<header>{nav()}</header>", box(["header", "masthead", "site-header", "topbar"], f"<h1>{words(1, 3)}</h1>{link()}"), ""])
    footer = lambda: pick([f"<footer>&copy; {word()}.example &middot; {prose(1, 2)}</footer>", f"<footer><p>{prose(1, 2)}</p>{links()}</footer>", box(["footer", "site-footer", "copyright"], f"<p>{noise()}</p>"), f"<footer>{words(1, 5)}</footer>", ""])
    share = lambda: box(["share", "social-links", "share-tools", "tags"], links())
    other = lambda: pick([ad, notice, form, side, comments, share])()

    title = pick([f"<h1>{mark(words(2, 9))}</h1>", f"<h1>{mark(sentence(3, 9))}</h1>", f"<header><h1>{mark(words(2, 9))}</h1></header>", f"<h1>{mark(words(2, 9))}</h1>", f'<h1 class="title">{mark(words(2, 9))}</h1>'])
    body = [piece() for _ in range(rng.randint(1, 14))]
    for _ in range(pick([0, 0, 1, 2])):
        body.insert(rng.randint(0, len(body)), other())
    if rng.random() < 0.3:
        body.append(pick([comments, share, form, side])())
    inner = title * (rng.random() < 0.9) + "".join(body)
    kind = rng.random()
    if kind < 0.55:
        inner = f"<article>{inner}</article>"
    elif kind < 0.65:
        inner = f"<main>{inner}</main>"
    elif kind < 0.72:
        inner = f"<main><article>{inner}</article>{side()}</main>"
    else:
        inner = f'<div {pick(["class", "id"])}="{pick(["content", "post", "entry-content", "article-body", "main-content", "story", "page", "wrap", "col-8", "x1"])}">{inner}</div>'
    before = [pick([nav, header])()] + [other() for _ in range(pick([0, 1, 1, 2]))]
    after = [other() for _ in range(pick([0, 0, 1, 2]))] + [footer()]
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{inner}{''.join(after)}" + "</body></html>" * (rng.random() < 0.9)


def labelled(page: str) -> tuple[list[tuple[str, Frame, int]], list[int]]:
    """Blocks of a page of make_page without the marks, and their labels."""
    blocks = leaf_blocks(page)
    return [(t.replace(OPEN, "").replace(CLOSE, ""), f, n) for t, f, n in blocks], [int(OPEN in t or CLOSE in t) for t, _, _ in blocks]


@lru_cache(2)
def model(pages: int = 300, seed: int = 3) -> tuple[dict[str, np.ndarray], np.ndarray]:
    rng = random.Random(seed)
    made = [labelled(make_page(rng)) for _ in range(pages)]
    return train([(block_features(b), y) for b, y in made])


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """All columns of `pages` but the html, then `out_col`."""
    prepare(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(out_col, T.StringType())])
    weights, pairs = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights, pairs)
        for batch in batches:
            at = batch.schema.get_field_index(html_col)
            texts = [field.extract(h) for h in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*kept, html_col).mapInArrow(run, schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = parallel(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html"))
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
