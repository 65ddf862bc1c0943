"""Operator 7: main text of HTML pages.

A page becomes a flat list of text blocks (cut at block-level tags; comments,
scripts, styles, heads and hidden parts left out).  Each block has its word
count and link density, those of the block before and after it, the unlinked words
of its run of paragraphs and headings, whether it is a heading or a paragraph, and
whether it stands inside an article or a boilerplate part.  A decision tree, trained
at call time on the small labelled table below, decides which blocks are main text.

An element is a boilerplate part by its tag or by a class, id or role all of whose words say so
(`related-posts`, not `related-work`; `no-`, `with-`, `has-` and `-free` deny it).  One that
holds most of the page's unlinked words is none, unless an article's text stands beside it.

Character references are decoded, white space inside a block becomes one
space, kept blocks are joined in page order by one space.

Edge cases: null and empty html give an empty text; broken or cut markup is
read as far as it goes (an unclosed tag or comment runs to the end); pages
of any length are used whole; repeated rows give repeated results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import table, text_slices

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "heading", "article", "boilerplate", "paragraph", "run")

#: Small labelled table: one block per row, the first nine features in order, then main text (1) or not (0).  Text stands in
#: paragraphs and in other elements, menus in others only; the run of paragraphs and headings is they and their neighbours.
SINGLE = [
    # paragraphs and headings of an article element
    (48, 0.0, 9, 0.0, 60, 0.0, 0, 1, 0, 1), (9, 0.0, 6, 1.0, 48, 0.0, 1, 1, 0, 1), (3, 0.0, 40, 0.0, 35, 0.0, 0, 1, 0, 1),
    (1, 0.0, 22, 0.0, 30, 0.0, 0, 1, 0, 1), (120, 0.05, 30, 0.0, 2, 0.0, 0, 1, 0, 1), (14, 0.2, 60, 0.0, 80, 0.0, 0, 1, 0, 1),
    (2, 0.0, 8, 0.0, 0, 0.0, 0, 1, 0, 1), (5, 0.0, 0, 0.0, 3, 0.0, 1, 1, 0, 1), (25, 0.4, 25, 0.0, 31, 0.0, 0, 1, 0, 1),
    (1, 0.0, 7, 0.0, 9, 0.0, 0, 1, 0, 1), (8, 0.0, 1, 0.0, 6, 0.0, 0, 1, 0, 1), (17, 0.0, 5, 1.0, 4, 1.0, 0, 1, 0, 1),
    (300, 0.01, 4, 0.0, 0, 0.0, 0, 1, 0, 1), (4, 0.0, 8, 0.0, 12, 1.0, 0, 1, 0, 1), (6, 0.0, 9, 1.0, 2, 0.0, 1, 1, 0, 1),
    (3, 0.0, 3, 0.0, 4, 0.0, 0, 1, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 1), (4, 0.0, 2, 1.0, 3, 0.0, 1, 1, 0, 1),
    (2, 0.0, 5, 0.0, 2, 0.0, 0, 1, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (2, 0.5, 3, 0.0, 2, 0.0, 0, 1, 0, 1),
    (1, 0.0, 2, 1.0, 2, 1.0, 0, 1, 0, 1), (4, 0.25, 4, 0.0, 5, 0.4, 0, 1, 0, 1), (2, 0.0, 1, 1.0, 9, 0.0, 1, 1, 0, 1),
    (3, 0.0, 8, 0.0, 2, 0.0, 1, 1, 0, 1), (5, 0.0, 4, 1.0, 0, 0.0, 0, 1, 0, 1), (2, 0.0, 2, 0.0, 3, 1.0, 0, 1, 0, 1),
    (4, 0.0, 1, 0.0, 2, 0.0, 0, 1, 0, 1), (1, 0.0, 4, 0.0, 0, 0.0, 0, 1, 0, 1), (3, 0.0, 6, 1.0, 1, 0.0, 1, 1, 0, 1),
    # links listed inside an article
    (6, 1.0, 50, 0.0, 7, 1.0, 0, 1, 0, 0), (9, 0.95, 6, 1.0, 5, 1.0, 0, 1, 0, 0), (4, 1.0, 9, 0.95, 0, 0.0, 0, 1, 0, 0),
    (12, 0.9, 30, 0.0, 10, 1.0, 0, 1, 0, 0), (2, 1.0, 70, 0.0, 40, 0.0, 0, 1, 0, 0),
    # boilerplate parts, inside or outside an article, of any length
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 0, 1, 0), (45, 0.0, 7, 0.0, 12, 0.0, 0, 1, 1, 0), (30, 0.0, 20, 0.0, 25, 0.0, 0, 0, 1, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0), (10, 0.1, 35, 0.0, 0, 0.0, 0, 0, 1, 0), (3, 0.0, 60, 0.0, 14, 0.0, 1, 1, 1, 0),
    (70, 0.02, 3, 0.0, 40, 0.0, 0, 0, 1, 0), (16, 0.0, 80, 0.0, 90, 0.0, 0, 1, 1, 0), (5, 0.0, 2, 1.0, 60, 0.0, 1, 0, 1, 0),
    (120, 0.0, 30, 0.0, 20, 0.0, 0, 1, 1, 0), (2, 0.5, 40, 0.0, 3, 1.0, 0, 1, 1, 0), (22, 0.3, 8, 0.0, 9, 0.0, 0, 0, 1, 0),
    # pages without an article element: text by length, density and neighbours
    (60, 0.0, 7, 0.0, 55, 0.0, 0, 0, 0, 1), (35, 0.1, 50, 0.0, 48, 0.0, 0, 0, 0, 1), (90, 0.02, 2, 1.0, 3, 1.0, 0, 0, 0, 1),
    (12, 0.0, 40, 0.0, 33, 0.0, 0, 0, 0, 1), (20, 0.0, 26, 0.0, 1, 1.0, 0, 0, 0, 1), (7, 0.0, 30, 0.0, 44, 0.0, 0, 0, 0, 1),
    (6, 0.0, 2, 1.0, 58, 0.0, 1, 0, 0, 1), (4, 0.0, 38, 0.0, 27, 0.0, 1, 0, 0, 1), (28, 0.2, 8, 0.0, 6, 0.0, 0, 0, 0, 1),
    (3, 0.0, 52, 0.0, 61, 0.0, 0, 0, 0, 1), (18, 0.0, 4, 0.0, 40, 0.0, 0, 0, 0, 1), (24, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (8, 0.0, 12, 0.0, 16, 0.0, 0, 0, 0, 1), (2, 0.0, 14, 0.0, 12, 0.0, 0, 0, 0, 1), (3, 0.0, 20, 0.0, 9, 0.0, 0, 0, 0, 1),
    (4, 0.0, 11, 0.0, 15, 0.0, 0, 0, 0, 1), (16, 0.0, 5, 0.0, 6, 0.0, 0, 0, 0, 1), (5, 0.0, 3, 1.0, 22, 0.0, 1, 0, 0, 1),
    (14, 0.0, 3, 0.0, 16, 0.0, 0, 0, 0, 1), (16, 0.0, 14, 0.0, 2, 0.0, 0, 0, 0, 1), (13, 0.0, 2, 0.0, 14, 0.0, 0, 0, 0, 1),
    (15, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0, 1), (12, 0.0, 2, 0.0, 4, 0.5, 0, 0, 0, 1), (12, 0.1, 13, 0.0, 5, 0.0, 0, 0, 0, 1),
    (11, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0, 1), (13, 0.0, 12, 0.0, 3, 0.7, 0, 0, 0, 1),
    (2, 0.0, 0, 0.0, 15, 0.0, 1, 0, 0, 1), (3, 0.0, 2, 1.0, 18, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 1.0, 30, 0.0, 1, 0, 0, 1),
    (4, 0.0, 2, 1.0, 16, 0.0, 1, 0, 0, 1), (3, 0.0, 1, 1.0, 13, 0.0, 1, 0, 0, 1),
    # menus, buttons, stray labels and link lists outside of any marked part
    (1, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 1.0, 40, 0.0, 2, 1.0, 0, 0, 0, 0), (15, 0.8, 4, 1.0, 9, 0.9, 0, 0, 0, 0),
    (2, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0), (4, 0.0, 2, 1.0, 5, 0.5, 0, 0, 0, 0), (30, 0.6, 4, 0.5, 5, 1.0, 0, 0, 0, 0),
    (3, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0, 0), (5, 0.4, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (2, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0),
    (6, 0.9, 60, 0.0, 50, 0.0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 0.0, 0, 0, 0, 0), (3, 0.0, 4, 1.0, 3, 1.0, 1, 0, 0, 0),
    (2, 1.0, 18, 0.0, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 6, 0.8, 0, 0.0, 0, 0, 0, 0),
]
#: The same with paragraph and run given: runs of short paragraphs, and single ones between links.
RUNS = [
    (5, 0.0, 4, 0.0, 6, 0.0, 0, 0, 0, 1, 20, 1), (4, 0.0, 0, 0.0, 5, 0.0, 0, 0, 0, 1, 18, 1), (6, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 1, 22, 1),
    (3, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 1, 14, 1), (2, 0.0, 1, 1.0, 4, 0.0, 1, 0, 0, 0, 19, 1), (3, 0.0, 5, 0.0, 2, 1.0, 0, 0, 0, 1, 16, 1),
    (1, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 1, 15, 1), (4, 0.0, 1, 1.0, 4, 0.0, 0, 0, 0, 1, 15, 1),
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 1, 2, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 1, 4, 0), (3, 0.0, 6, 0.8, 0, 0.0, 0, 0, 0, 1, 3, 0),
    (6, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 6, 0), (8, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0, 8, 0), (7, 0.0, 4, 1.0, 2, 0.0, 0, 0, 0, 0, 7, 0),
    (3, 0.5, 2, 1.0, 2, 1.0, 0, 0, 0, 1, 1, 0), (4, 1.0, 5, 0.0, 6, 0.0, 0, 0, 0, 1, 11, 0), (6, 0.9, 4, 1.0, 2, 1.0, 0, 0, 0, 1, 0, 0),
]


def _with_runs(row: tuple) -> Iterator[tuple]:
    words, links, before, before_links, after, after_links = row[:6]
    for paragraph in (0, 1) if row[-1] and not row[6] or row[8] else (0,):
        run = words * (1 - links) + ((paragraph or row[6]) and row[-1]) * (before * (1 - before_links) + after * (1 - after_links))
        yield *row[:-1], paragraph, run, row[-1]


LABELLED = [*[r for row in SINGLE for r in _with_runs(row)], *RUNS]


def train_tree(rows: list[tuple], depth: int = 6) -> tuple:
    """CART by Gini impurity: (feature, threshold, left, right) or a leaf (label,)."""
    data = np.array(rows, float)

    def grow(part: np.ndarray, left_depth: int) -> tuple:
        y = part[:, -1]
        if left_depth == 0 or y.min() == y.max():
            return (int(y.mean() >= 0.5),)
        best = None
        for f in range(part.shape[1] - 1):
            values = np.unique(part[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = part[:, f] <= t
                gini = sum(m.sum() * 2 * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, f, t)
        if best is None:
            return (int(y.mean() >= 0.5),)
        _, f, t = best
        low = part[:, f] <= t
        return (f, float(t), grow(part[low], left_depth - 1), grow(part[~low], left_depth - 1))

    return grow(data, depth)


def decide(tree: tuple, block: tuple) -> int:
    while len(tree) > 1:
        tree = tree[2] if block[tree[0]] <= tree[1] else tree[3]
    return tree[0]


BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
section select summary table tbody td tfoot th thead title tr ul""".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p blockquote pre dd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style noscript template textarea svg math head title iframe object canvas audio video datalist select option".split())
RAW = frozenset("script style textarea title iframe noscript".split())  # content without tags
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
SCRIPT = re.compile(r"<!--(?!-?>)|-->|<(/?)script(?=[\s/>]|\Z)", re.I)
HEAD_END = re.compile(r"</head(?=[\s/>])|<body(?=[\s/>])", re.I)
#: Elements that are tracked so that their content knows where it stands.
TRACKED = frozenset("""article main section div nav header footer aside form ul ol table td figure blockquote button menu dialog fieldset
body html details span p li""".split())
BOILERPLATE = frozenset("nav footer aside form button menu dialog fieldset".split())
#: Words of class, id or role that mark a boilerplate part; of these, and of the tags, the plain ones.
PLAIN_MARKS = frozenset("""ad ads advert advertisement advertising adbox adslot adsense banner cookie cookies consent gdpr nav navbar navigation
menu footer contentinfo comment comments commentlist disqus respond reply replies breadcrumb breadcrumbs newsletter subscribe copyright
pagination outbrain taboola""".split())
MARKS = PLAIN_MARKS | frozenset("""sponsor sponsored promo promotion notice notification alert sidebar complementary masthead topbar discussion share
sharing social related recommended recommendations subscription signup login popup modal overlay widget pager toolbar disclaimer skip
search searchbox form paywall teaser""".split())
PLAIN_TAGS = frozenset("nav footer button menu dialog".split())
HEADER_MARKS = frozenset("header head".split())  # boilerplate only outside an article
ARTICLE_MARKS = frozenset("article post entry story main content articlebody".split())
#: Words that may stand beside a mark in one name, and words that deny it.
BESIDE = frozenset("""area box wrapper wrap container inner outer block list lists item items section links link left right top bottom bar posts
articles site page primary secondary group row column module unit slot icons buttons title header footer head body text more""".split()) | ARTICLE_MARKS
DENYING = frozenset("no not non with without has hide free".split())

TOKEN = re.compile(r"""<!--[\s\S]*?(?:-->|\Z)|<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)|[^<]+|<""", re.X)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def marks(attributes: str) -> tuple[set[str], bool]:
    """Words of the names in class, id and role that agree on one thing; whether
    the element is hidden."""
    words: set[str] = set()
    hidden = False
    for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            for one in value.split():
                named = {w.lower() for w in WORD.findall(one)}
                marked = named & (MARKS | HEADER_MARKS)
                if not named & DENYING and (not marked or all(w in BESIDE or len(w) < 3 for w in named - marked)):
                    words |= named - BESIDE if marked & MARKS else named
        elif bare or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    return words, hidden


def raw_end(page: str, tag: str, at: int) -> int:
    """Where the end tag of a RAW element stands whose content starts at `at`; -1 without one."""
    if tag == "script":  # a script tag named inside <!-- --> has an end tag of its own
        escaped = inner = False
        for m in SCRIPT.finditer(page, at):
            if m.group(1):
                if not inner:
                    return m.start()
                inner = False
            elif m.group() == "<!--":
                escaped = True
            elif m.group() == "-->":
                escaped = inner = False
            else:
                inner = escaped
    end = RAW_END[tag].search(page, at)
    return end.start() if end else -1


def tokens(page: str) -> Iterator[re.Match]:
    """The tokens of a page; the content of RAW elements is passed over."""
    at, in_head = 0, False
    while at < len(page):
        for m in TOKEN.finditer(page, at):
            yield m
            tag = m.group(2) and m.group(2).lower()
            if tag in ("head", "body"):
                in_head = tag == "head" and not m.group(1)
            elif tag in RAW and not m.group(1) and not m.group(3).endswith("/"):
                end = raw_end(page, tag, m.end())
                # an unclosed title ends with its head
                if end >= 0 and not (in_head and tag == "title" and HEAD_END.search(page, m.end(), end)):
                    at = end
                    break
        else:
            return


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, bool]]:
    """(text, words, words in links, heading, paragraph, in an article, in a boilerplate part) in page order."""
    out: list = []
    stack: list[tuple[str, bool, tuple[int, ...], bool]] = []  # tag, article, boilerplate parts around, hidden
    plain: list[bool] = []  # of each boilerplate part, whether it is one by a plain mark
    parts: list[str] = []
    linked: list[str] = []
    state = {"a": 0, "h": False, "p": False}
    article = hidden = False
    boiler: tuple[int, ...] = ()
    skip = ""

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = len(text.split(" "))
                out.append((text, n, min(n, len("".join(linked).split())), state["h"], state["p"], article, boiler))
            parts.clear()
            linked.clear()

    def part(is_plain: bool) -> tuple[int, ...]:
        plain.append(is_plain)
        return (*boiler, len(plain) - 1)

    for m in tokens(page):
        tag = m.group(2)
        if tag is None:
            raw = m.group()
            if not skip and not hidden and not (raw[0] == "<" and len(raw) > 1):
                text = html_lib.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if state["a"]:
                    linked.append(text)
            continue
        tag, closing = tag.lower(), bool(m.group(1))
        if skip:
            if closing and tag == skip:
                skip = ""
            elif skip == "head" and tag == "body":  # an unclosed head
                skip = ""
            if skip or closing:
                continue
        if tag in SKIPPED:
            if not closing and not m.group(3).endswith("/"):
                flush()
                skip = tag
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            state["a"] = 0 if closing else 1
            if linked:
                linked.append(" ")
            continue
        if tag in BLOCK:
            flush()
            state["a"] = 0
            state["h"] = tag in HEADING and not closing
            state["p"] = tag in PARAGRAPH and not closing
        if tag not in TRACKED:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCK and stack[i][1:] != (article, boiler, hidden):
                        flush()
                    del stack[i:]
                    break
            _, article, boiler, hidden = stack[-1] if stack else ("", False, (), False)
            continue
        if tag in ("p", "li") and stack and stack[-1][0] == tag:  # left open: the next one closes it
            stack.pop()
            _, article, boiler, hidden = stack[-1] if stack else ("", False, (), False)
        words, gone = marks(m.group(3)) if m.group(3) else (set(), False)
        if gone and not hidden:
            flush()
        if tag not in ("body", "html", "main"):
            if tag in BOILERPLATE or words & MARKS and not (tag == "article" and not article and words & ARTICLE_MARKS):
                if tag not in BLOCK and not boiler:
                    flush()
                boiler = part(tag in PLAIN_TAGS or bool(words & PLAIN_MARKS))
            elif not article and (tag == "header" or words & HEADER_MARKS and not words & ARTICLE_MARKS):
                boiler = part(False)
        if tag in ("article", "main") or words & ARTICLE_MARKS and tag in ("div", "section", "td") and not boiler:
            article = True
        hidden = hidden or gone
        stack.append((tag, article, boiler, hidden))
        if tag in VOID or m.group(3).endswith("/"):
            stack.pop()
            _, article, boiler, hidden = stack[-1] if stack else ("", False, (), False)
    flush()
    body = without_main_parts(out, plain)
    return [(*block[:6], bool(body.intersection(block[6]))) for block in out]


def without_main_parts(found: list, plain: list[bool]) -> set[int]:
    """The boilerplate parts but those that hold most of the page's unlinked
    words (over half, by plain marks over nine tenths) with no text of an
    article beside them."""
    total, held = 0, [0] * len(plain)
    for _, n, linked, *_, around in found:
        total += n - linked
        for i in around:
            held[i] += n - linked
    beside = any(n > linked and not heading and article and not around for _, n, linked, heading, _, article, around in found)
    return {i for i in range(len(plain)) if beside or 10 * held[i] <= (9 if plain[i] else 5) * total}


def runs(found: list) -> list[int]:
    """Unlinked words of each block's run: paragraphs and headings of few links, in or
    out of boilerplate alike, with no other block between."""
    out, at = [0] * len(found), 0
    while at < len(found):
        end, words = at, 0
        while end < len(found) and (found[end][3] or found[end][4]) and 3 * found[end][2] <= found[end][1] and found[end][6] == found[at][6]:
            words += found[end][1] - found[end][2]
            end += 1
        if end == at:
            end, words = at + 1, found[at][1] - found[at][2]
        out[at:end] = [words] * (end - at)
        at = end
    return out


def main_text(page: str | None, tree: tuple) -> str:
    if not page:
        return ""
    found = blocks(page)
    size = [(0, 0.0), *((b[1], b[2] / b[1]) for b in found), (0, 0.0)]
    kept = [b[0] for i, (b, run) in enumerate(zip(found, runs(found), strict=True))
            if decide(tree, (*size[i + 1], *size[i], *size[i + 2], int(b[3]), int(b[5]), int(b[6]), int(b[4]), run))]
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    tree = train_tree(LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in text_slices(batch.column(2)):
                text = [main_text(page, tree) for page in batch.column(2).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(text, pa.string()),
                     pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
