"""Main text of web pages by union-free wrappers of their hosts (operator 2).

A page is read as a balanced token stream, that is, a tree. Equal neighbours are folded into
repeated groups. The streams of pages of one host are aligned, one after another: tags that match
are merged, those without a partner become optional, runs of equal ones repeated groups, and
texts become slots. The result is a wrapper, a regular expression without unions over tags,
groups (+), options (?) and text slots.

Wrappers of some pages are made where the pages lie, one for each host and task, and merge in
two rounds (a host's parts are salted in the first), so that a host with a third of all pages is
spread like any other. They hold no page text, only its length, and meet the pages in
a join on the host that Spark may broadcast only where their written size allows.

A wrapper decides which of its slots are the main text: those of the article (or of the main
element, or of the element with the most text that isn't links), outside menus, headers,
footers, asides, notices, adverts, forms and comments. What many pages share is kept like any
other text; only a label of a share control ("Share this story") that stands alone outside
headings, paragraphs and the like is left out. Each whole page is then read by its host's wrapper.

Names of class and id count in an article as whole tokens or compounds of such words only
(related-posts, not related-work); names made from headings don't count, and ambiguous ones (share,
replies) only on blocks that are mostly links.

Defined results: a null or empty html gives an empty text; a null url is a host of its own
kind; a page without text where its wrapper has the main text (another layout of the host) is
read by a wrapper of its own; an article or main element without any text is none; pages without
tags are one block; repeated rows repeat the result; extra columns of the input are dropped.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.llm.shared import cut

# Names of elements and words of class names by what they mark.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("nav header footer aside form button select option fieldset dialog menu head input frameset".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup signin login paywall nav navbar navigation menu menus breadcrumb breadcrumbs masthead header topbar footer sidebar sidebars aside rail related "
    "recommended recommendations trending share sharing social comment comments commentlist disqus discussion reply replies respond widget widgets toolbar pagination pager search skip copyright legal".split()
)
#: Of these, some may mark parts of an article that belong to it.
WITHIN_ARTICLE = frozenset("header masthead alert overlay legal".split())
#: Words that go with one of LEFT_OUT_WORDS in a compound such as related-posts or share-buttons.
CARRIERS = frozenset(
    "list lists section area box block bar bars container wrapper wrap inner outer button buttons link links icon icons post posts article articles story stories item items form panel slot unit "
    "top bottom left right main site page reader user inline mobile desktop primary secondary thread".split()
)
#: These name what readers say wherever they stand, as an id of a section too.
ALWAYS_APART = frozenset("comments commentlist disqus respond".split())
#: Words that alone also name parts of real texts; a block so named is left out in an article only if most of it is links.
WEAK_WORDS = frozenset("copyright replies reply share skip rail discussion search promotion subscription".split())
#: Of an id, these too, as ids are made from headings.
WEAK_ID_WORDS = WEAK_WORDS | frozenset("related social recommendations navigation advertising consent comment notices notification menu widgets".split())
#: Elements whose ids are made from headings and mark nothing.
NAMED_BY_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p li dl dt dd table caption thead tbody tr td th figure figcaption blockquote pre a span".split())
MAIN_WORDS = frozenset("article content post entry story main body text".split())
CLOSED_BY = {
    "p": frozenset("p".split()),
    "li": frozenset("li p".split()),
    "dt": frozenset("dt dd p".split()),
    "dd": frozenset("dt dd p".split()),
    "tr": frozenset("tr td th p".split()),
    "td": frozenset("td th p".split()),
    "th": frozenset("td th p".split()),
    "option": frozenset("option".split()),
}
BLOCKS_THAT_CLOSE_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("article aside body blockquote div dl fieldset figure footer form header html main nav ol section table td th ul".split())

#: Below this depth a wrapper knows only how long the text is. Pages are read at any depth.
DEEPEST = 120
#: The whole text of an element that labels a share control, and elements whose text is the article's whatever it says.
_LABEL = re.compile(r"(?:share|tweet|print|e-?mail) this (?:story|article|post|page)[.!:]?", re.I)
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th caption figcaption blockquote q pre code em strong b i cite".split())
#: Shapes of a host that a task holds before it aligns them.
MOST_SHAPES = 64
#: Hosts whose wrappers a task holds at a time.
HELD_HOSTS = 2_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# A page's element: [key, children]; a text is a string. A wrapper's element:
# [key, children, optional, repeated, pages, chars]; its texts have the key "#" and in place of
# children None; a group of several elements has the key "()".
Element = list[Any]
TEXT, GROUP = "#", "()"


@lru_cache(1 << 14)
def _mark(token: str, weak: frozenset[str]) -> str:
    """What a token of a class or id marks in an article: apart (left out), linked (left out if
    most of it is links) or nothing. Only whole tokens count, or compounds of nothing else."""
    parts = [w.lower() for w in _WORD.findall(token)]
    found = [w for w in parts if w in LEFT_OUT_WORDS and w not in WITHIN_ARTICLE]
    if not found or any(w not in LEFT_OUT_WORDS and w not in CARRIERS for w in parts):
        return ""
    return "linked" if len(parts) == 1 and parts[0] in weak else "apart"


def _key(tag: str, attributes: str) -> str:
    """Tag and marks of an element: roles and words of class and id, without numbers."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag
    words: list[str] = []
    tokens: dict[str, list[str]] = {"class": [], "id": []}
    for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name in tokens:
            tokens[name] += value.split()
        elif name == "role":
            words.append(f"role={value.strip().lower()}")
        elif hidden or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            words.append("role=hidden")
    classes, ids = tokens["class"], tokens["id"]
    if tag in NAMED_BY_HEADINGS:
        ids = []
    marks = {_mark(t, WEAK_WORDS) for t in classes}
    words += [w.lower() for t in classes for w in _WORD.findall(t)]
    of_ids = [w.lower() for t in ids for w in _WORD.findall(t)]
    if tag == "section" or "section" in classes:
        marks |= {_mark(t, WEAK_ID_WORDS) and ("linked" if ALWAYS_APART.isdisjoint(map(str.lower, _WORD.findall(t))) else "apart") for t in ids}
        of_ids = [w for w in of_ids if w not in LEFT_OUT_WORDS]
    else:
        marks |= {_mark(t, WEAK_ID_WORDS) for t in ids}
    words += of_ids
    words += [f"mark={m}" for m in sorted(marks) if m]
    return " ".join([tag, *dict.fromkeys(words)])


def read_page(text: str) -> Element:
    """The tree of a page, however its tags are closed."""
    root = _parsed(text)
    _open_forms(root)
    return root


def _open_forms(root: Element) -> None:
    """Forms that hold a page's heading or most of its text are containers, as those of some servers are."""
    todo, forms = [root], []
    while todo:
        for c in todo.pop()[1]:
            if isinstance(c, list):
                if _tag(c) == "form":
                    forms.append(c)
                todo.append(c)
    if forms:
        every = _length(root)
        for form in forms:
            if _holds_article(form) or 2 * _length(form) > every:
                form[0] = "div" + form[0][len("form") :]


def _parsed(text: str) -> Element:
    root: Element = ["html", []]
    stack = [root]
    is_open: Counter[str] = Counter()
    at = 0
    while True:
        m = _TOKEN.search(text, at)
        piece = text[at : m.start()] if m else text[at:]
        if piece and not piece.isspace():
            stack[-1][1].append(piece)
        elif piece:
            stack[-1][1].append(" ")
        if not m:
            return root
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if is_open[tag]:
                _close(stack, tag, is_open)
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS_THAT_CLOSE_P:
            _close_open(stack, CLOSED_BY["p"], is_open)
        elif tag in CLOSED_BY:
            _close_open(stack, CLOSED_BY[tag], is_open)
        element: Element = [_key(tag, m[3]), []]
        stack[-1][1].append(element)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(element)
            is_open[tag] += 1


def _tag(element: Element) -> str:
    return element[0].partition(" ")[0]


def _cut(stack: list[Element], i: int, is_open: Counter[str]) -> None:
    for element in stack[i:]:
        is_open[_tag(element)] -= 1
    del stack[i:]


def _close_open(stack: list[Element], tags: frozenset[str], is_open: Counter[str]) -> None:
    """Closes elements of ``tags`` that are open in the innermost scope."""
    if not any(is_open[t] for t in tags):
        return
    last = len(stack)
    for i in range(len(stack) - 1, 0, -1):
        tag = _tag(stack[i])
        if tag in tags:
            last = i
        elif tag in SCOPES:
            break
    _cut(stack, last, is_open)


def _close(stack: list[Element], tag: str, is_open: Counter[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        own = _tag(stack[i])
        if own == tag:
            _cut(stack, i, is_open)
            return
        if tag in INLINE and own not in INLINE:
            return


# Wrappers


def _length(element: Element) -> int:
    """Characters of all texts of a page's element."""
    n, todo = 0, [element]
    while todo:
        for c in todo.pop()[1]:
            if isinstance(c, str):
                n += len(" ".join(html.unescape(c).split()))
            else:
                todo.append(c)
    return n


def _outermost(element: Element) -> list[Element]:
    """The outermost articles and main elements of a page's element."""
    found, todo = [], [element]
    while todo:
        for c in todo.pop()[1]:
            if isinstance(c, list):
                (found if any(want(c) for want in MARKED_MAIN) else todo).append(c)
    return found


def _as_wrapper(element: Element | str, depth: int = 1) -> Element:
    if isinstance(element, str):
        return [TEXT, None, False, False, 1, len(" ".join(html.unescape(element).split()))]
    if depth == DEEPEST:
        # of what lies deeper, only how long it is and whether it is marked as the main text
        marked = [[c[0], [[TEXT, None, False, False, 1, _length(c)]], False, False, 1, 0] for c in _outermost(element)]
        rest = _length(element) - sum(c[1][0][5] for c in marked)
        return [element[0], [[TEXT, None, False, False, 1, rest], *marked], False, False, 1, 0]
    children = [_as_wrapper(c, depth + 1) for c in element[1] if not isinstance(c, str) or not c.isspace()]
    return [element[0], _fold(children), False, False, 1, 0]


def _same(a: Element, b: Element) -> bool:
    return a[0] == b[0] and (a[0] != GROUP or [x[0] for x in a[1]] == [x[0] for x in b[1]])


def _repeat(a: Element, b: Element) -> Element:
    """Two neighbours as one repeated element."""
    out = _merge(a, b)
    out[2], out[3], out[4] = a[2] and b[2], True, max(a[4], b[4])
    return out


def _fold(children: list[Element]) -> list[Element]:
    """Runs of equal neighbours, then of equal pairs and triples, as repeated groups."""
    out: list[Element] = []
    for c in children:
        if out and _same(out[-1], c) and c[0] != TEXT:
            out[-1] = _repeat(out[-1], c)
        else:
            out.append(c)
    for size in (2, 3):
        i = 0
        while i + 2 * size <= len(out):
            keys = [x[0] for x in out[i : i + size]]
            if TEXT not in keys and GROUP not in keys and keys == [x[0] for x in out[i + size : i + 2 * size]]:
                group: Element = [GROUP, out[i : i + size], False, True, max(x[4] for x in out[i : i + size]), 0]
                j = i + size
                while keys == [x[0] for x in out[j : j + size]]:
                    group[1] = [_merge(a, b) for a, b in zip(group[1], out[j : j + size], strict=True)]
                    j += size
                out[i:j] = [group]
            i += 1
    return out


def _merge(a: Element, b: Element) -> Element:
    """The wrapper of what both match; the keys are the same."""
    head = [a[2] or b[2], a[3] or b[3], a[4] + b[4], a[5] + b[5]]
    if a[0] == TEXT:
        return [TEXT, None, *head]
    return [a[0], align(a[1], b[1]), *head]


def align(a: list[Element], b: list[Element]) -> list[Element]:
    """Two streams as one: matching elements merge, the others become optional."""
    if len(a) == len(b) and all(map(_same, a, b)):
        return _fold([_merge(x, y) for x, y in zip(a, b, strict=True)])
    out: list[Element] = []
    i = j = 0
    for x, y in [*_matches(list(map(_sign, a)), list(map(_sign, b))), (len(a), len(b))]:
        out += [[*c[:2], True, *c[3:]] for c in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return _fold(out)


def _sign(w: Element) -> str:
    """Elements match where these are equal."""
    return w[0] if w[0] != GROUP else GROUP + "|".join(x[0] for x in w[1])


#: Cells of a table of common subsequences; larger streams are split at signs that each has once.
TABLE = 1 << 14


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence of two streams, a longest one of short streams."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = _between(a[head : len(a) - tail], b[head : len(b) - tail])
    ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    return [(k, k) for k in range(head)] + [(head + x, head + y) for x, y in inner] + ends


def _between(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) <= TABLE:
        return _longest(a, b)
    in_a, in_b = Counter(a), Counter(b)
    where = {s: j for j, s in enumerate(b) if in_b[s] == 1}
    anchors = _rising([(i, where[s]) for i, s in enumerate(a) if in_a[s] == 1 and s in where])
    if not anchors:
        return _next_found(a, b)
    out, i, j = [], 0, 0
    for x, y in anchors:
        out += [(i + p, j + q) for p, q in _matches(a[i:x], b[j:y])] + [(x, y)]
        i, j = x + 1, y + 1
    return out + [(i + p, j + q) for p, q in _matches(a[i:], b[j:])]


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs whose second numbers rise as the first do."""
    ends: list[int] = []  # for each length the pair that ends it with the least number
    before = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left([pairs[e][1] for e in ends], y) if len(ends) < 32 else bisect_left(ends, y, key=lambda e: pairs[e][1])
        before[k] = ends[at - 1] if at else -1
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _next_found(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Each sign with its next place in the other stream, if that is near."""
    places: dict[str, list[int]] = {}
    for j, s in enumerate(b):
        places.setdefault(s, []).append(j)
    out, j = [], 0
    for i, s in enumerate(a):
        own = places.get(s, [])
        k = bisect_left(own, j)
        if k < len(own) and own[k] - j <= 64:
            out.append((i, own[k]))
            j = own[k] + 1
    return out


def page_wrapper(text: str) -> Element:
    return _as_wrapper(read_page(text))


# What is main text


def _left_out(w: Element, in_article: bool, mild: bool) -> bool:
    """``mild``: by whole names only, as in an article or another element whose class says so."""
    tag, *words = w[0].split(" ")
    if tag in LEFT_OUT and not (in_article and tag == "header"):
        return True
    if not words:
        return False
    if any(x.startswith("role=") and (x[5:] in LEFT_OUT_ROLES or x == "role=hidden") for x in words):
        return True
    if "mark=apart" in words or ("mark=linked" in words and _is_linked(w)):
        return True
    return not mild and not LEFT_OUT_WORDS.isdisjoint(words)


def _is_linked(w: Element) -> bool:
    """Whether most of the text of an element of a page or wrapper is links."""
    every = links = 0
    todo = [(w, _tag(w) == "a")]
    while todo:
        element, link = todo.pop()
        for c in element[1] or ():
            if isinstance(c, str) or c[0] == TEXT:
                n = len("".join(c.split())) if isinstance(c, str) else c[5]
                every, links = every + n, links + n * link
            else:
                todo.append((c, link or _tag(c) in ("a", "button")))
    return 2 * links >= every


def _holds_article(w: Element) -> bool:
    todo = [w]
    while todo:
        for c in todo.pop()[1] or ():
            if isinstance(c, list):
                if _tag(c) in ("article", "main", "h1"):
                    return True
                todo.append(c)
    return False


def _dropped(w: Element, in_article: bool, mild: bool = False, strict: bool = True) -> bool:
    """Whether an element is left out with all it holds. An article goes by its own marks, as a comment or a
    card does, and with what is so marked by a whole name around it; unless ``strict``, for pages whose
    only article lies in such an element, no article goes."""
    tag = _tag(w)
    if tag in ("html", "main", TEXT, GROUP):
        return False
    if tag == "article":
        return strict and "mark=apart" in w[0].split(" ")
    if not _left_out(w, in_article, in_article or mild):
        return False
    return in_article or tag in LEFT_OUT or not _holds_article(w) or (strict and "mark=apart" in w[0].split(" "))


def _roots(w: Element, want: Any, found: list[Element], strict: bool) -> None:
    """Which elements that ``want`` selects stand outermost."""
    for c in w[1]:
        if not isinstance(c, list) or c[0] == TEXT or _dropped(c, False, False, strict):
            continue
        if want(c):
            found.append(c)
        else:
            _roots(c, want, found, strict)


def _mass(w: Element, strict: bool = True) -> int:
    """Characters of text that aren't links, menus and the like."""
    if w[0] == TEXT:
        return w[5]
    if _dropped(w, False, False, strict) or _tag(w) == "a":
        return 0
    return sum(_mass(c, strict) for c in w[1])


def _page_mass(tree: Element) -> int:
    """The same of a page's tree."""
    n, todo = 0, [tree]
    while todo:
        for c in todo.pop()[1]:
            if isinstance(c, str):
                n += len(" ".join(html.unescape(c).split())) if not c.isspace() else 0
            elif _tag(c) != "a" and not _dropped(c, False):
                todo.append(c)
    return n


def _chars(w: Element) -> int:
    return w[5] if w[0] == TEXT else sum(map(_chars, w[1]))


def _says_main(w: Element) -> bool:
    return "role=main" in w[0] or not MAIN_WORDS.isdisjoint(w[0].split(" ")[1:])


#: How pages mark their main text by elements alone, the better way first.
MARKED_MAIN = (lambda c: _tag(c) == "article", lambda c: _tag(c) == "main" or "role=main" in c[0])


def main_elements(w: Element, strict: bool = True) -> tuple[set[int], Any]:
    """The elements of a wrapper that hold the main text, and by which mark of elements, if by one."""
    for want in (*MARKED_MAIN, lambda c: _says_main(c) and 2 * _mass(c, strict) >= _mass(w, strict)):
        found: list[Element] = []
        _roots(w, want, found, strict)
        if any(map(_chars, found)):
            return set(map(id, found)), want if want in MARKED_MAIN else None
    node, total = w, _mass(w, strict)
    while True:  # down to where the text is
        inner = [c for c in node[1] if c[0] not in (TEXT,) and _tag(c) not in INLINE and not _dropped(c, False, False, strict)]
        top = max(inner, key=lambda c: _mass(c, strict), default=None)
        if top is None or top[3] or _tag(top) == "p" or 10 * _mass(top, strict) < 9 * total:
            return {id(node)}, None
        node = top


class Reader:
    """A host's wrapper, ready to read pages."""

    def __init__(self, wrapper: Element, strict: bool = True) -> None:
        self.wrapper, self.strict = wrapper, strict
        self.main, self.mark = main_elements(wrapper, strict)

    def text(self, page: str) -> str:
        """Where the wrapper's main text holds less than half of a page's own (another layout of the same
        host), the page's own wrapper decides, if it finds twice as much."""
        tree = read_page(page)
        found = self._read(tree)
        if found and 2 * len(found) >= _page_mass(tree):
            return found
        own = _as_wrapper(tree)
        other = Reader(own)._read(tree)
        if len(other) > 2 * len(found):
            found = other
        return found or Reader(own, False)._read(tree)

    def _read(self, tree: Element) -> str:
        blocks: list[list[str]] = [[]]
        self._walk(tree, blocks)
        joined = [" ".join(html.unescape("".join(b)).split()) for b in blocks]
        return "\n".join(b for b in joined if b)

    def _walk(self, tree: Element, blocks: list[list[str]]) -> None:
        # open elements: their children still to come, the wrapper's, and where they stand
        todo = [(tree, iter(tree[1]), _Matcher(self.wrapper[1]), id(self.wrapper) in self.main, False, False)]
        while todo:
            element, children, matcher, inside, in_article, mild = todo[-1]
            c = next(children, None)
            if c is None:
                todo.pop()
                if todo and _tag(element) not in INLINE:
                    blocks.append([])
                continue
            if isinstance(c, str):
                if inside:
                    if not c.isspace():
                        matcher.next(TEXT)
                    blocks[-1].append(c)
                continue
            own = matcher.next(c[0])
            tag = _tag(c)
            if _dropped(c, in_article, mild, self.strict) or _is_label(c, element):
                continue
            deep = len(todo) >= DEEPEST and self.mark is not None and self.mark(c)
            is_main = deep or (own is not None and id(own) in self.main)
            if in_article and tag == "header":  # of an article's own header the headings belong to it
                c = [c[0], [x for x in c[1] if isinstance(x, list) and re.match(r"h[1-6]\b", x[0])]]
            if tag not in INLINE:
                blocks.append([])
            elif tag == "br":
                blocks[-1].append(" ")
                continue
            now, within = inside or is_main or tag == "article", in_article or tag in ("article", "main")
            todo.append((c, iter(c[1]), _Matcher(own[1] if own else []), now, within, mild or (is_main and _says_main(c))))


def _is_label(c: Element, parent: Element) -> bool:
    """Whether an element is the label of a share control, and not a word of a heading or paragraph."""
    if len(c[1]) != 1 or not isinstance(c[1][0], str) or _tag(c) in PROSE or _tag(parent) in PROSE:
        return False
    return len(c[1][0]) < 80 and _LABEL.fullmatch(" ".join(html.unescape(c[1][0]).split())) is not None


class _Matcher:
    """Reads a stream of siblings by a wrapper's: each takes the next element with its key."""

    def __init__(self, wrappers: list[Element]) -> None:
        self.flat = [(x, w[3]) for w in wrappers for x in (w[1] if w[0] == GROUP else [w])]
        self.at = 0

    def next(self, key: str) -> Element | None:
        n = len(self.flat)
        for step in range(n):
            i = (self.at + step) % n
            w, grouped = self.flat[i]
            if w[0] == key:
                self.at = i if grouped or w[3] else i + 1
                return w
        return None


# In Spark

PARTS = "host string, wrapper string"
_PARTS = pa.schema([("host", pa.string()), ("wrapper", pa.string())])
SALTS = 32


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return found


def _leaves(w: Element) -> Iterator[Element]:
    yield w
    if w[0] != TEXT:
        for c in w[1]:
            yield from _leaves(c)


def _shape(w: Element) -> str:
    return "#" if w[0] == TEXT else w[0] + "(" + ",".join(map(_shape, w[1])) + ")" + ("+" if w[3] else "")


class HostWrappers:
    """Wrappers of the hosts that a task has seen. Pages of one shape merge leaf by leaf; shapes
    are aligned when the wrappers leave."""

    def __init__(self) -> None:
        self.hosts: dict[str, dict[str, list[Element]]] = {}

    def add(self, host: str, w: Element) -> None:
        shapes = self.hosts.setdefault(host, {})
        shape = _shape(w)
        leaves = list(_leaves(w))
        known = shapes.get(shape)
        if known is None:
            shapes[shape] = leaves
            if len(shapes) > MOST_SHAPES:  # so that a host's share of memory is bounded
                w = merged([x[0] for x in shapes.values()])
                self.hosts[host] = {_shape(w): list(_leaves(w))}
            return
        for a, b in zip(known, leaves, strict=True):
            a[4] += b[4]
            a[5] += b[5]

    def leave(self) -> Iterator[dict[str, str]]:
        for host, shapes in self.hosts.items():
            yield {"host": host, "wrapper": json.dumps(merged([leaves[0] for leaves in shapes.values()]))}
        self.hosts = {}


def merged(wrappers: list[Element]) -> Element:
    """One wrapper of several, larger ones first, so that the order of the parts matters little."""
    order = sorted(wrappers, key=lambda w: (-w[4], _shape(w)))
    out = order[0]
    for w in order[1:]:
        out = _merge(out, w)
    return out


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = HostWrappers()
    for batch in batches:
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if text:
                held.add(host, page_wrapper(text))
        if len(held.hosts) >= HELD_HOSTS:
            yield pa.RecordBatch.from_pylist(list(held.leave()), schema=_PARTS)
    rows = list(held.leave())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_PARTS)


def _merge_parts(table: pa.Table) -> pa.Table:
    parts = [json.loads(x) for x in table.column("wrapper").to_pylist()]
    return pa.Table.from_pylist([{"host": table.column("host")[0].as_py(), "wrapper": json.dumps(merged(parts))}], schema=_PARTS)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): one row for each host of ``pages`` (url, html)."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    parts = rows.mapInArrow(_infer, PARTS).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = parts.groupBy("host", "salt").applyInArrow(_merge_parts, PARTS)
    return some.groupBy("host").applyInArrow(_merge_parts, PARTS)


TEXTS = "page_id long, url string, text string, n_chars long"
_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    readers: dict[str, Reader] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if not page:
                texts.append("")
                continue
            reader = readers.get(wrapper or "")
            if reader is None:
                if len(readers) >= HELD_HOSTS:
                    readers.clear()
                reader = readers[wrapper or ""] = Reader(json.loads(wrapper) if wrapper else page_wrapper(page))
            texts.append(reader.text(page))
        yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_TEXTS)


def extract_main_text(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    held = cut(infer_wrappers(pages)) if wrappers is None else wrappers
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    met = rows.join(held.select("host", "wrapper"), "host", "left")
    return met.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, TEXTS)
