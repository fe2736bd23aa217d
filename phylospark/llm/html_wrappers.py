"""Main-text extraction by union-free regular-expression inference.

The pages of a host are aligned into a wrapper, an expression of tags, text
slots, optional groups ``?`` and repeated groups ``+``, without unions. A page
is a stream of block tags and text runs; adjacent repeats of a stream fold into
``+``. Where wrapper and page differ: two texts become a slot, a group that one
side repeats becomes ``+``, and what only one side has becomes ``?``.

Every slot carries how much text it holds and how much of it in links, and what
the tags around it say. Which texts repeat in it is counted over all pages of the
host: each page is matched by the finished wrapper and gives a digest for every
slot, and Spark counts them (``count_texts``). From these the wrapper decides which
slots are the article (``decide``), and a page is read by its host's wrapper.

Pages of one shape add up place by place in their own task; the shapes of a
host merge in a fixed order, level by level, at most some hundreds in a task.
A shape's rows, one from every task that read a page of it, merge in salted parts
before they meet. So the wrapper depends on neither partitioning nor the order of
rows, and a host with a third of all pages is not one task's.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
from collections import Counter
from itertools import count, groupby, takewhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.shared import cut

#: Elements whose content is no markup, up to their end tag, and other elements that hold no text of the page; fixed by HTML.
RAW, SKIPPED = "script|style|iframe|textarea|title", frozenset("noscript template svg object canvas select button annotation annotation-xml".split())
#: A start tag's end: not that of a longer name, nor of an element closed in the tag itself.
OPENED = r"(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+(?<![\s\"'/]/)>"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?!/>){OPENED}.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|</?[a-z][^<>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
SKIPPED_NAMES = SKIPPED | frozenset(RAW.split("|"))
#: Inline elements are part of a text run, formulas too; fixed by HTML and MathML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meta link nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math semantics mrow mi mo mn ms mtext mspace mfrac msqrt mroot mstyle mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split()
)
#: Elements whose end tag may be left out; fixed by HTML.
OPEN_ENDED = frozenset("p li dt dd tr td th thead tbody tfoot option".split())
#: Elements that label what follows.
LABELS = frozenset("h1 h2 h3 h4 h5 h6 th dt caption figcaption legend summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words in class, id or role that mark what is not the article.
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "header masthead topbar banner footer colophon contentinfo copyright sidebar side aside complementary widget widgets rail related recommended recommendations cookie cookies "
    "consent gdpr notice notices notification notifications alert popup modal overlay dialog comment comments commentlist reply replies respond discussion disqus form newsletter "
    "subscribe subscription signup login search share sharing social toolbar hidden".split()
)
#: Of these words, those that say that an ``article`` element is another thing.
NOT_THE_ARTICLE = frozenset("ad ads advert advertisement sponsored promo promotion comment comments reply replies related recommended".split())
#: Words beside which a word of furniture keeps its meaning inside an article: ``comment-list``, but not ``related-work``.
NEUTRAL = frozenset("site page post entry article blog user reader main primary secondary global top bottom left right inner outer wrap wrapper container box block bar area section list item items group panel region row column".split())
#: The share of a host's pages that agree weighs as it does among so many pages, if the host has more: all are counted, but a label on 10,000 pages is no worse than one on 16.
WEIGHED_PAGES = 16
#: Copies of a page differ in shorter texts only.
LONG_TEXT = 60
#: How far a merge looks for the next place that both sides have, and how long a group may be that a page repeats.
LOOK_AHEAD, LONGEST_BODY = 64, 24
#: A shape that would make its host's wrapper longer than this is left out; its pages are read by their own expression.
MOST_NODES = 4096
#: Shapes or partial wrappers that one task merges for a host, about, and the parts that the pages of one shape merge in first.
MERGED_AT_ONCE, SALTS = 256, 256
#: Rows of shapes that one task merges: they are few bytes but long work, so tasks are not dealt by size.
ROWS_A_TASK = 256

#: What the tags around a text say of it.
FURNITURE, OUTSIDE, OTHER, ARTICLE = range(4)
#: Worth of a slot by what tags say: tags of furniture, outside the page's article, on a page without article, in it.
TAG_WORTH = (-4.0, -3.0, 0.5, 3.0)
#: Pages of the host that must agree before their number counts as evidence, and the share of them that makes a template, outside articles and in one.
AGREEING, TEMPLATE_SHARE, ARTICLE_SHARE = 3, 0.5, 0.8
#: Worth of: each doubling of the pages that have one text in the slot; varied texts; text in links; long texts; a heading in an article; a place outside the region that holds most varied text.
TEMPLATE_WORTH, VARIED_WORTH, LINK_WORTH, LONG_WORTH, HEADING_WORTH, REGION_WORTH = -1.2, 0.5, -1.5, 0.5, 2.0, -1.5
#: Share of text in links, and characters of a text, from which on these count; share of the varied text that the region holds.
LINKED, LONG_ENOUGH, REGION_SHARE = 0.6, 40, 0.6


def tag_name(name: str, attributes: str) -> str:
    """``name`` and the classes, id and role, their words in lower case joined by ``-``, as one string."""
    if not attributes:
        return name
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or m[5] or ""
        value = re.sub(r"\b(?:has|with|no|without)-\S+", " ", value)
        for part in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
            found.add("-".join(re.findall(r"[a-z]+", part)))
    return " ".join([name, *sorted(found - {""})])


def tokens(page: str) -> list[tuple[str, str, float]]:
    """A page as ``("t", tag, 0)`` and ``("s", text, share in links)``; ends of open-ended elements are left out."""
    page = re.sub(r"<head(?=[\s>]).*?</head\s*>", "", page, count=1, flags=re.S | re.I)
    out, run, at, linked, link = [], [], 0, 0, False

    def close():
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(("s", text, min(1.0, linked / len(text))))
        linked = 0

    tags = list(TOKEN.finditer(page))
    # Skipped elements reach to their own end tag; one without an end skips nothing.
    ends, open_ = {}, {}
    for i, m in enumerate(tags):
        name = (m[3] or "").lower()
        if name in SKIPPED:
            if m[2]:
                if open_.get(name):
                    ends[open_[name].pop()] = i
            elif not (m[4].endswith("/") and (len(m[4]) == 1 or m[4][-2] in " \t\r\n\f\"'/")):
                open_.setdefault(name, []).append(i)
    until = -1
    for i, m in enumerate(tags):
        if i <= until:
            at = m.end()
            continue
        part = page[at : m.start()]
        run.append(part)
        linked += len(part.strip()) if link else 0
        at = m.end()
        until = ends.get(i, until)
        name = (m[3] or "").lower()
        if name == "a":
            link = not m[2]
        if not name or name in INLINE or name in SKIPPED_NAMES:
            continue
        if name == "br":
            run.append(" ")
            continue
        close()
        if m[2]:
            link = False
            if name not in OPEN_ENDED and name not in VOID:
                out.append(("t", "/" + name, 0))
            elif name == "p":
                out.append(("t", "p", 0))
        else:
            out.append(("t", tag_name(name, m[4]), 0))
    run.append(page[at:])
    close()
    # An end of paragraph separates blocks; of several separators in a row one is enough.
    return [x for x, y in zip(out, [*out[1:], ("t", "/", 0)]) if x != ("t", "p", 0) or y[0] == "s"] if out else out


# Wrapper nodes: ("t", tag), ("s", seen, texts, characters, characters in links, texts by what tags say), ("?", body), ("+", body), and first of all ("n", seen, pages).
# What a slot has seen lists (page, digest of its text there), all of them; the first node lists pages. Wrappers made by Spark leave both empty, ``count_texts`` counts them there.


#: Digests are less than this, and so are sums of them.
DIGESTS = 2**48


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).digest(), "big")


def page_number(stream: list[tuple]) -> int:
    """A hash that copies of a page share: of its long texts if they are half of it, else of all its texts."""
    texts = [x[1] for x in stream if x[0] == "s"]
    long = [t for t in texts if len(t) >= LONG_TEXT]
    return _digest("\0".join(long if 2 * sum(map(len, long)) >= sum(map(len, texts)) else texts))


def leaves(stream: list[tuple], page: int | None) -> list[tuple]:
    """A page's stream as nodes, with digests of its texts if the page has a number."""
    said = iter(tags_say(stream))
    out = []
    for kind, value, linked in stream:
        if kind == "t":
            out.append(("t", value))
        else:
            counts = [0] * 4
            counts[next(said)] = 1
            out.append(("s", [] if page is None else [(page, _digest(value))], 1, len(value), round(linked * len(value)), counts))
    return out


def seen_by_both(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """The pages of two lists; a page that both have keeps its least digest."""
    if a == b:
        return a
    return sorted(dict(sorted([*a, *b], reverse=True)).items())


def key(node: tuple):
    if node[0] == "t":
        return node[1]
    if node[0] == "n":
        return "n", None
    return "#" if node[0] == "s" else (node[0], key(node[1][0]))


def unify(a: tuple, b: tuple, repeats: bool = False) -> tuple:
    """One node for two of equal key; ``repeats`` of one page add their digests."""
    if a[0] == "t":
        return a
    if a[0] == "n":
        return ("n", seen_by_both(a[1], b[1]), a[2] + b[2])
    if a[0] != "s":
        return (a[0], merge(a[1], b[1]))
    seen = [(a[1][0][0], (a[1][0][1] + b[1][0][1]) % DIGESTS)] if repeats and a[1] else seen_by_both(a[1], b[1])
    return ("s", seen, a[2] + b[2], a[3] + b[3], a[4] + b[4], [x + y for x, y in zip(a[5], b[5])])


def step(node: tuple) -> int:
    """How much deeper in the page the next node is."""
    if node[0] != "t":
        return 0
    name = node[1].split(" ", 1)[0]
    return -1 if name[0] == "/" else 0 if name in OPEN_ENDED or name in VOID else 1


def balanced(nodes: list[tuple]) -> bool:
    """Whether the nodes open what they end and end what they open."""
    depth = 0
    for n in nodes:
        depth += step(n)
        if depth < 0:
            return False
    return depth == 0


def fold(nodes: list[tuple]) -> list[tuple]:
    """Adjacent equal stretches of a page that are whole elements become one repeated group, short ones first."""
    nodes = list(nodes)
    for size in range(1, LONGEST_BODY + 1):
        if 2 * size > len(nodes):
            break
        keys = [key(n) for n in nodes]
        out, at = [], 0
        while at < len(nodes):
            end = at + size
            if end < len(nodes) and nodes[at][0] != "s" and (size > 1 or nodes[at][0] == "t") and keys[at] == keys[end] and keys[at:end] == keys[end : end + size] and balanced(nodes[at:end]):
                body = nodes[at:end]
                while keys[at : at + size] == keys[end : end + size]:
                    body = [unify(a, b, True) for a, b in zip(body, nodes[end : end + size])]
                    end += size
                out.append(("+", body))
                at = end
            else:
                out.append(nodes[at])
                at += 1
        nodes = out
    return nodes


def _optional(nodes: list[tuple]) -> list[tuple]:
    """The nodes as optional groups; those that are optional already stay as they are."""
    out = []
    for already, part in groupby(nodes, lambda n: n[0] == "?"):
        out += list(part) if already else [("?", list(part))]
    return out


def _ahead(nodes: list[tuple], at: int, wanted) -> int | None:
    """The next place of key ``wanted`` that only whole elements stand before."""
    depth = 0
    for k in range(at, min(len(nodes), at + LOOK_AHEAD)):
        if k > at and depth == 0 and key(nodes[k]) == wanted:
            return k
        depth += step(nodes[k])
        if depth < 0:
            return None
    return None


def _unit(nodes: list[tuple], at: int) -> int:
    """The end of the element, text or group that begins at a place."""
    depth, k = step(nodes[at]), at + 1
    while depth > 0 and k < len(nodes):
        depth += step(nodes[k])
        k += 1
    return k


def _absorbed(group: tuple, other: list[tuple], at: int) -> tuple[tuple, int]:
    """A group with the stretches of ``other`` that repeat its body, and where they end."""
    body, end, times = group[1], at, 0
    keys = [key(n) for n in body]
    while [key(n) for n in other[end : end + len(body)]] == keys:
        body = [unify(p, q) for p, q in zip(body, other[end : end + len(body)])]
        end, times = end + len(body), times + 1
    if group[0] == "?" and times > 1 and balanced(body):
        body = [("+", body)]
    return (group[0], body), end


def _loose(x: tuple, y: tuple) -> tuple | None:
    """An optional group of one node and that node, or one that repeats and its body's first."""
    if x[0] == "?" and len(x[1]) == 1 and key(x[1][0]) == key(y):
        return ("?", [unify(x[1][0], y)])
    if x[0] == "?" and y[0] == "+" and [key(n) for n in x[1]] == [key(n) for n in y[1]]:
        return ("?", [("+", [unify(p, q) for p, q in zip(x[1], y[1])])])
    return None


def merge(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """The least general expression found that covers both; only whole elements become optional where pages are well formed."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if key(x) == key(y):
            out.append(unify(x, y))
            i, j = i + 1, j + 1
            continue
        loose = _loose(x, y) or _loose(y, x)
        if loose:
            out.append(loose)
            i, j = i + 1, j + 1
            continue
        if x[0] in "?+":
            made, end = _absorbed(x, b, j)
            if end > j:
                out.append(made)
                i, j = i + 1, end
                continue
        if y[0] in "?+":
            made, end = _absorbed(y, a, i)
            if end > i:
                out.append(made)
                i, j = end, j + 1
                continue
        ahead_a, ahead_b = _ahead(a, i, key(y)), _ahead(b, j, key(x))
        if ahead_a is not None and (ahead_b is None or ahead_a - i <= ahead_b - j):
            out += _optional(a[i:ahead_a])
            i = ahead_a
        elif ahead_b is not None:
            out += _optional(b[j:ahead_b])
            j = ahead_b
        elif step(x) >= 0:
            end = _unit(a, i)
            out += _optional(a[i:end])
            i = end
        elif step(y) >= 0:
            end = _unit(b, j)
            out += _optional(b[j:end])
            j = end
        else:  # ends of different elements
            out += _optional([x]) + _optional([y])
            i, j = i + 1, j + 1
    return out + _optional(a[i:]) + _optional(b[j:])


def page_expression(stream: list[tuple], digests: bool = True) -> list[tuple]:
    page = page_number(stream) if digests else None
    return [("n", [(page, 0)] if stream and digests else [], 1), *fold(leaves(stream, page))]


def shape(nodes: list[tuple]) -> str:
    """What pages of one expression share: their tags and groups."""
    return "\n".join(n[1] if n[0] == "t" else f"{n[0]}({shape(n[1])})" if n[0] in "?+" else n[0] for n in nodes)


def size(nodes: list[tuple]) -> int:
    return sum(1 + size(n[1]) if n[0] in "?+" else 1 for n in nodes)


def merge_shapes(parts: list[list[tuple]]) -> list[tuple]:
    """Expressions of one host in one: first those of most pages; one that would make the wrapper too long is left out."""
    by_shape: dict[str, list] = {}
    for part in parts:
        at = shape(part)
        by_shape[at] = merge(by_shape[at], part) if at in by_shape else part
    whole = None
    for _, part in sorted(by_shape.items(), key=lambda x: (-x[1][0][2], x[0])):
        made = part if whole is None else merge(whole, part)
        whole = made if whole is None or size(made) <= MOST_NODES else [unify(whole[0], part[0]), *whole[1:]]
    return whole


def _tuples(x):
    return [(n[0], _tuples(n[1])) if n[0] in "?+" else (n[0], [tuple(p) for p in n[1]], *n[2:]) if isinstance(n[1], list) else tuple(n) for n in x]


def loads(text: str) -> list[tuple]:
    return _tuples(json.loads(text))


class Element:
    """An open element of a page."""

    def __init__(self, name: str, classes: list[str]):
        words = [c.split("-") for c in classes]
        marks = NOT_THE_ARTICLE if name == "article" else () if name in ("html", "head", "body", "main") else FURNITURE_WORDS
        marked = any(w in marks for c in words for w in c)
        self.name, self.furniture = name, name in FURNITURE_TAGS or marked
        self.article = name == "main" or name == "article" and not marked
        self.ended = name in OPEN_ENDED
        #: A mark that holds inside an article too, where words of the subject can look like furniture.
        self.firm = name in FURNITURE_TAGS or name == "article" and marked or any(any(w in marks for w in c) and all(w in marks or w in NEUTRAL for w in c) for c in words)


class Elements:
    """The open elements at a place of a stream of tags."""

    def __init__(self):
        self.open: list[Element] = []

    def tag(self, value: str) -> None:
        name, *classes = value.split(" ")
        if name.startswith("/"):
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at].name == name[1:]:
                    self.open[at].ended = True
                    del self.open[at:]
                    break
            return
        if name in OPEN_ENDED:
            while self.open and self.open[-1].name in OPEN_ENDED and (self.open[-1].name == name or name == "tr"):
                self.open.pop()
        if name not in VOID:
            self.open.append(Element(name, classes))


def open_elements(stream: list[tuple]) -> list[list[Element]]:
    """The open elements around every text of a stream."""
    at, out = Elements(), []
    for kind, value, *_ in stream:
        if kind == "s":
            out.append(list(at.open))
        else:
            at.tag(value)
    return out


def role(elements: list[Element]) -> int:
    """0 furniture, 1 other text, 2 in main, 3 in an article."""
    inside = False
    for e in elements:
        if e.firm if inside else e.furniture:
            return 0
        inside = inside or e.article
    names = {e.name for e in elements}
    return 3 if "article" in names else 2 if "main" in names else 1


def page_roles(stream: list[tuple[str, str]]) -> list[int]:
    """Role of every text of a page.

    What is furniture by its mark and holds the article is not: an element
    around ``main``, one whose end tag is missing, and, on pages with no other
    article, one around an article that is longer than what is left. If all
    texts are furniture, those in the fewest marked elements are the page's
    text, except in furniture tags that are ended.
    """
    around, lengths = open_elements(stream), [len(x[1]) for x in stream if x[0] == "s"]
    roles, inner = [], []
    for elements in around:
        at = next((i for i, e in enumerate(elements) if e.article), None)
        inside = elements if at is None else elements[at:]
        held = 0 if at is None or any(e.furniture and e.name == "article" for e in elements[:at]) else role([e for e in inside if not e.furniture or e.ended or e.name == "article"])
        inner.append(held)
        sure = at is not None and (elements[at].name == "main" or not any(e.furniture and e.ended for e in elements[:at]))
        roles.append(held if sure and held else role(elements))
    if max(roles, default=0) <= 1:
        if sum(n for n, r in zip(lengths, inner) if r) > sum(n for n, r in zip(lengths, roles) if r):
            return inner
    if roles and not any(roles):
        firm = FURNITURE_TAGS | OPEN_ENDED | {"article"}
        marked = [0 if any(e.furniture and e.ended and e.name in firm for e in elements) else sum(e.furniture for e in elements) for elements in around]
        fewest = min((n for n in marked if n), default=None)
        return [int(n == fewest) for n in marked]
    return roles


def tags_say(stream: list[tuple]) -> list[int]:
    """What the tags of a page say of each of its texts."""
    roles = page_roles(stream)
    best = max(roles, default=0)
    return [FURNITURE if r == 0 else OTHER if best == 1 else ARTICLE if r == best else OUTSIDE for r in roles]


def numbered(wrapper: list[tuple]) -> list[tuple]:
    """The wrapper with ``("s", k)`` for its k-th slot, from 1."""
    at = count(1)

    def number(nodes):
        return [(n[0], number(n[1])) if n[0] in "?+" else ("s", next(at)) if n[0] == "s" else n for n in nodes]

    return number(wrapper[1:])


def texts_by_slot(wrapper: list[tuple], stream: list[tuple]) -> dict[int, int] | None:
    """Slot -> digest of what the page has there, repeats added up, by a ``numbered`` wrapper; slot 0 is the page. None if the page doesn't match."""
    slots = read_by(wrapper, stream) if stream else None
    if slots is None:
        return None
    found = {0: 0}
    for slot, text in zip(slots, (x[1] for x in stream if x[0] == "s")):
        found[slot] = (found.get(slot, 0) + _digest(text)) % DIGESTS
    return found


def _counts(wrapper: list[tuple]) -> dict[int, tuple[int, int]]:
    """What ``count_texts`` counts, from what a wrapper's nodes have seen."""
    out, at = {0: (len(wrapper[0][1]),) * 2}, count(1)

    def walk(nodes):
        for n in nodes:
            if n[0] == "s":
                out[next(at)] = max(Counter(d for _, d in n[1]).values(), default=0), len(n[1])
            elif n[0] != "t":
                walk(n[1])

    walk(wrapper[1:])
    return out


def decide(wrapper: list[tuple], counts: dict[int, tuple[int, int]] | None = None) -> list[tuple]:
    """The wrapper with ``("s", 1)`` for slots of the article and ``("s", 0)`` for others.

    ``counts`` has for the k-th slot, from 1, how many different pages of the
    host have its commonest text and how many have any, and for 0 how many
    pages there are; without it what the nodes have seen is counted.

    A slot is worth what its tags say, less the more pages of the host have
    one text in it, more if texts vary or are long, less if they are links.
    In an article one text on all pages (a label of a table, "Ingredients") is
    evidence only in links or at the article's edge, with nothing but such
    texts before or after it, and there not in a heading or a label.
    The region is the deepest element of several slots that holds most of the
    varied text of the host: on pages without article, slots outside it are worth less, and marks
    on it or around it, which are layout then, don't count.
    """
    counts = _counts(wrapper) if counts is None else counts
    host = counts.get(0, (0, 0))[0]
    known = host >= AGREEING
    slots, at = [], Elements()

    def walk(nodes):
        for n in nodes:
            if n[0] == "t":
                at.tag(n[1])
            elif n[0] == "s":
                slots.append((n, list(at.open), counts.get(len(slots) + 1, (0, 0))[0]))
            else:
                walk(n[1])

    walk(wrapper[1:])

    def template(n, agree, share):
        return known and agree >= AGREEING and agree >= share * host

    mass: dict[int, float] = {}
    holds = Counter(id(e) for _, around, _ in slots for e in around)
    total = 0.0
    for n, around, agree in slots:
        said = n[5].index(max(n[5]))
        own = 0.0 if template(n, agree, TEMPLATE_SHARE) else (n[3] - n[4]) * (0.25, 0.25, 1.0, 4.0)[said]
        total += own
        for e in around:
            mass[id(e)] = mass.get(id(e), 0.0) + own
    region, deep = None, -1
    for _, around, _ in slots if known else ():
        for depth, e in enumerate(around):
            if depth > deep and total and holds[id(e)] > 1 and e.name not in OPEN_ENDED and mass[id(e)] >= REGION_SHARE * total:
                region, deep = e, depth
    own = [k for k, (n, _, _) in enumerate(slots) if n[5].index(max(n[5])) == ARTICLE]
    alike = {k for k in own if template(slots[k][0], slots[k][2], ARTICLE_SHARE) and not (slots[k][1] and slots[k][1][-1].name in LABELS)}
    edge = {k for way in (own, own[::-1]) for k in takewhile(alike.__contains__, way)}
    keep = []
    for k, (n, around, agree) in enumerate(slots):
        said = n[5].index(max(n[5]))
        inside = next((k for k, e in enumerate(around) if e is region), None)
        if said == FURNITURE and inside is not None and not any(e.firm for e in around[inside + 1 :]):
            said = OTHER
        worth = TAG_WORTH[said]
        if template(n, agree, ARTICLE_SHARE if said == ARTICLE else TEMPLATE_SHARE) and (said != ARTICLE or k in edge or n[4] > LINKED * n[3]):
            worth += TEMPLATE_WORTH * math.log2(agree * min(1.0, WEIGHED_PAGES / host))
        elif known and counts.get(k + 1, (0, 0))[1] >= AGREEING:
            worth += VARIED_WORTH
        worth += LINK_WORTH * (n[4] > LINKED * n[3]) + LONG_WORTH * (n[3] >= LONG_ENOUGH * n[2])
        if said == ARTICLE and around and re.fullmatch("h[1-6]", around[-1].name):
            worth += HEADING_WORTH
        if said == OTHER and region is not None and inside is None:
            worth += REGION_WORTH
        keep.append(worth > 0)
    flags = iter(keep)

    def mark(nodes):
        return [(n[0], mark(n[1])) if n[0] in "?+" else ("s", int(next(flags))) if n[0] == "s" else n for n in nodes]

    return mark(wrapper[1:])


def read_by(wrapper: list[tuple], stream: list[tuple]) -> list[int] | None:
    """The mark of its slot for every text of the stream, 1 for the article and 0 for others after ``decide``; None if the page doesn't match."""
    flags: list[int] = []

    def run(nodes: list[tuple], at: int) -> int:
        for node in nodes:
            kind = node[0]
            if kind == "t":
                if at >= len(stream) or stream[at][0] != "t" or stream[at][1] != node[1]:
                    return -1
                at += 1
            elif kind == "s":
                if at >= len(stream) or stream[at][0] != "s":
                    return -1
                flags.append(node[1])
                at += 1
            else:
                times = 0
                while at < len(stream) and (kind == "+" or not times):
                    saved = len(flags)
                    end = run(node[1], at)
                    if end <= at:
                        del flags[saved:]
                        break
                    at, times = end, times + 1
                if kind == "+" and not times:
                    return -1
        return at

    return flags if run(wrapper, 0) == len(stream) else None


def read_alone(stream: list[tuple]) -> list[int]:
    """The same decision from the page's own expression, each text a slot, for a page that its wrapper does not match."""
    page = page_number(stream)
    return [n[1] for n in decide([("n", [(page, 0)], 1), *leaves(stream, page)]) if n[0] == "s"]


def main_text(page: str | None, wrapper: list[tuple] | None) -> str:
    """The page's article by a wrapper that ``decide`` has marked: blocks joined by an empty line.

    If no text is in a slot of the article, the page is read alone, and if that
    leaves nothing, all texts that tags don't call furniture are the article.
    """
    stream = tokens(page or "")
    texts = [x[1] for x in stream if x[0] == "s"]
    flags = read_by(wrapper, stream) if wrapper else None
    if not flags or not any(flags):
        flags = read_alone(stream)
    if not any(flags):
        flags = [said >= OTHER for said in tags_say(stream)]
    return "\n\n".join(t for t, f in zip(texts, flags) if f)


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#]+)", 1)), F.lit(""))


def _joined(rows: DataFrame, wrappers: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Pages with the wrapper of their host, if it has one."""
    if (wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= broadcast_bytes:
        wrappers = F.broadcast(wrappers)
    return rows.join(wrappers, "host", "left")


def count_texts(pages: DataFrame, wrappers: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``host, slot, agree, pages``: how many different pages have a slot's commonest text and how many have the slot.

    Every page (``host, html``) that its host's ``numbered`` wrapper matches is
    counted, once with its copies, of which the one with the least digests
    stands for all. Slot 0 is the page itself.
    """

    def matched(batches):
        known: dict[str, list] = {}
        for b in batches:
            out = []
            for host, page, w in zip(b["host"], b["html"], b["wrapper"]):
                if w not in known:
                    known[w] = loads(w)
                stream = tokens(page)
                found = texts_by_slot(known[w], stream)
                if found:
                    out.append((host, page_number(stream), list(found), list(found.values())))
            yield pd.DataFrame(out, columns=["host", "page", "slots", "digests"])

    rows = _joined(pages, wrappers, broadcast_bytes).where("wrapper is not null").select("host", "html", "wrapper")
    found = rows.mapInPandas(matched, "host string, page long, slots array<int>, digests array<long>")
    one = found.groupBy("host", "page").agg(F.min(F.struct("slots", "digests")).alias("has"))
    texts = one.select("host", F.explode(F.arrays_zip("has.slots", "has.digests")).alias("x")).select("host", "x.slots", "x.digests")
    same = texts.groupBy("host", F.col("slots").alias("slot"), "digests").agg(F.count(F.lit(1)).alias("n"))
    return same.groupBy("host", "slot").agg(F.max("n").alias("agree"), F.sum("n").alias("pages"))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", at_once: int = MERGED_AT_ONCE, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``host, wrapper`` (JSON, marked by ``decide``) of all pages, in two passes: what the pages have in common, then which texts repeat."""

    def shapes(batches):
        found: dict[tuple[str, int], list] = {}
        for b in batches:
            for host, page in zip(b["host"], b["html"]):
                expression = page_expression(tokens(page), digests=False)
                at = host, _digest(shape(expression))
                found[at] = merge(found[at], expression) if at in found else expression
                if len(found) >= 2000:
                    yield _rows(found)
                    found = {}
        yield _rows(found)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["host"].iloc[0], int(pdf["shape"].iloc[0])
        return _rows({at: merge_shapes([loads(p) for p in sorted(pdf["wrapper"])])})

    @F.pandas_udf("string")
    def by_number(wrappers: pd.Series) -> pd.Series:
        return wrappers.map(lambda w: json.dumps(numbered(loads(w))))

    @F.pandas_udf("string")
    def marked(wrappers: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(decide(loads(w), {x["slot"]: (x["agree"], x["pages"]) for x in json.loads(c or "[]")})) for w, c in zip(wrappers, counts)], dtype=object)

    schema = "host string, shape long, wrapper string"
    some = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).where("html is not null")
    made = cut(some.mapInPandas(shapes, schema))
    made = made.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    made = cut(made.repartition(1 + made.count() // ROWS_A_TASK, "host", "shape", "salt").groupBy("host", "shape", "salt").applyInPandas(join, schema))
    most = made.groupBy("host").agg(F.count_distinct("shape").alias("n")).agg(F.max("n")).first()[0] or 0
    # A function of the data alone: as many levels as bring the shapes of the largest host down to one.
    parts = 1
    while most > parts * at_once:
        parts *= at_once
    made = made.groupBy("host", "shape").applyInPandas(join, schema)
    while True:
        made = made.withColumn("shape", F.pmod("shape", F.lit(parts))).groupBy("host", "shape").applyInPandas(join, schema)
        if parts == 1:
            break
        parts //= at_once
    made = cut(made.select("host", "wrapper"))
    counts = count_texts(some, made.select("host", by_number("wrapper").alias("wrapper")), broadcast_bytes)
    counts = counts.groupBy("host").agg(F.to_json(F.collect_list(F.struct("slot", "agree", "pages"))).alias("counts"))
    return made.join(counts, "host", "left").select("host", marked("wrapper", "counts").alias("wrapper"))


def _rows(found: dict[tuple[str, int], list]) -> pd.DataFrame:
    return pd.DataFrame({"host": [h for h, _ in found], "shape": [s for _, s in found], "wrapper": [json.dumps(w) for w in found.values()]}, dtype=object).astype({"shape": "int64"})


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null or empty page has an empty text; pages without a host in their URL
    share a wrapper; repeated rows each get a row, and copies count as one page
    when wrappers are judged; an empty table gives none. Whole pages are read,
    however long. Wrappers don't depend on the order of rows: ties between
    shapes of equally many pages go by the shape's text. Columns of other names
    play no part.
    """
    wrappers = cut(infer_wrappers(pages, url_col, html_col, broadcast_bytes=broadcast_bytes))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"))

    @F.pandas_udf("string")
    def extract(pages: pd.Series, by: pd.Series) -> pd.Series:
        known: dict[str, list] = {}
        out = []
        for page, w in zip(pages, by):
            if w is not None and w not in known:
                known[w] = loads(w)
            out.append(main_text(page, known.get(w)))
        return pd.Series(out, dtype=object)

    made = _joined(rows, wrappers, broadcast_bytes).select("page_id", "url", extract("html", "wrapper").alias("text"))
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
