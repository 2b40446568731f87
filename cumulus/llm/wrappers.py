"""Operator 9: main text of HTML pages by wrappers inferred for each host.

A page becomes a stream of tag and text tokens.  Repeats that follow each other
are folded into groups, which gives the page's own union-free expression.  The
expressions of a host's pages are aligned one after another into one wrapper: what
agrees stays, what only some have becomes optional, what some repeat becomes a
repeated group, and texts become slots (or constants, where all pages agree).  The
wrapper says which elements carry the article and which are menus or other lists
of links, and is then applied to every page of the host.

Tasks infer wrappers of the pages they hold and emit one small row a host; rows of
a host are merged in two steps, so a host with a third of all pages is spread.
"""

from __future__ import annotations

import html
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: element kinds and names of page furniture -----------------------------
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font",
          "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
FURNITURE = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "title", "button",
             "select", "option", "textarea", "input", "svg", "canvas", "iframe", "object", "menu", "dialog", "header",
             "audio", "video", "map"}
FURNITURE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor",
                   "sponsored", "promo", "promotion", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb",
                   "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "notices",
                   "alert", "popup", "modal", "newsletter", "subscribe", "subscription", "comment", "comments",
                   "disqus", "replies", "reply", "respond", "share", "sharing", "social", "related", "recommended",
                   "widget", "toolbar", "pagination", "pager", "copyright", "legal", "login", "signup", "search",
                   "disclaimer", "gdpr", "skip", "contentinfo", "complementary", "hidden"}
ARTICLE_WORDS = {"article", "articlebody", "post", "entry", "story", "content", "main", "maincontent", "body", "text"}
#: Elements that hold the page or its article, so the words of their classes say nothing about them.
WHOLE = {"html", "body", "main"}
#: What the element around a page's article holds, and a list of comments or an advert seldom does.
OF_PAGES = {"article", "main", "h1", "nav", "header", "footer", "aside"}
#: Elements that an opening tag of the left closes when it is still open.
CLOSES = {"p": INLINE | {"p"}, "li": {"li", "p"} | INLINE, "tr": {"tr", "td", "th", "p"} | INLINE,
          "td": {"td", "th", "p"} | INLINE, "th": {"td", "th", "p"} | INLINE, "option": {"option"},
          "dt": {"dt", "dd", "p"} | INLINE, "dd": {"dt", "dd", "p"} | INLINE}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![A-Za-z\[][^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
                   r"|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

GROUP = 12            # tokens of the longest group that is folded at once
CELLS = 1 << 20       # of an alignment's table, held at once
ITEMS = 400           # items of a bounded wrapper (main_text has none); pages that it does not cover use their own
SLOTS = 10 * ITEMS    # slots of a bounded wrapper, and of its templates; all pages of hosts beyond that use their own
KNOWN = 2000          # expressions remembered by a task as aligned already
DIFFERENT = 3         # pages that differ elsewhere and agree in a text, for it to count as constant


def _marker(name: str, attributes: str) -> str:
    """An element's name with its class, id and role; digits do not tell elements apart."""
    if not attributes or "=" not in attributes:
        return name
    words = [next(v for v in m.groups()[1:] if v is not None) for m in ATTRIBUTE.finditer(attributes)]
    words = re.sub(r"\d+", "0", " ".join(words).lower()).split()
    return ".".join([name, *sorted(set(words))]) if words else name


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('open', name, marker), ('close', name, '') and ('text', decoded text, '') of a page.

    Comments, declarations and the contents of scripts, styles and titles are left
    out.  A tag that the page's end cuts off is dropped.
    """
    at, n = 0, len(page)
    held: list[str] = []
    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            held.append(page[at:])
            break
        if found.start() > at:
            held.append(page[at:found.start()])
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        if held:
            yield "text", html.unescape("".join(held)), ""
            held = []
        if not page.endswith(">", found.start(), at):
            return
        name = name.lower()
        if found.group(1):
            yield "close", name, ""
            continue
        yield "open", name, _marker(name, found.group(3))
        if name in RAW and not found.group(3).endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = n if end is None else end.start()
    if held:
        yield "text", html.unescape("".join(held)), ""


def _words_of(marker: str) -> set[str]:
    return set(re.split(r"[^a-z]+", marker.partition(".")[2])) if "." in marker else set()


def is_furniture(marker: str) -> bool:
    """An element of menus, adverts, notices, comments and the like, by its name or its words."""
    name = marker.partition(".")[0]
    return name in FURNITURE or (name not in WHOLE and bool(_words_of(marker) & FURNITURE_WORDS))


Step = tuple[str, str, tuple[str, ...]]


def steps_of(page: str | list[Step]) -> list[Step]:
    """A page's walk as a list, which several readers can share."""
    return list(walk(page)) if isinstance(page, str) else page


def wrapping(page: list[Step]) -> set[str]:
    """Markers that look like furniture by their words only, yet stand around the article.

    Words alone never empty a page: where all unlinked text stands within
    furniture, elements that hold over half of it, and an article, a headline or
    the page's own menus, headers or footers, are not furniture.
    """
    inside: dict[str, int] = {}
    total = 0
    for kind, value, stack in page:
        if kind == "text" and value.strip() and not any(m.partition(".")[0] in FURNITURE | {"a"} for m in stack):
            if not any(map(is_furniture, stack)):
                return set()
            total += len(value)
            for m in set(stack):
                inside[m] = inside.get(m, 0) + len(value)
    held = {m for kind, value, stack in page if kind == "open" and value.partition(".")[0] in OF_PAGES for m in (*stack, value)}
    return {m for m, chars in inside.items() if 2 * chars > total and m in held and is_furniture(m)}


def walk(page: str) -> Iterator[Step]:
    """Tokens with the open elements' markers: ('open' | 'close' | 'text', marker or text, stack)."""
    names: list[str] = []
    stack: list[str] = []
    for kind, value, marker in tokens(page):
        if kind == "text":
            yield "text", value, tuple(stack)
        elif kind == "open":
            closes = CLOSES.get(value)
            if closes is None and value not in INLINE and value not in VOID:
                closes = CLOSES["p"] if "p" in names else None       # a block ends an open paragraph
            if closes:
                cut = len(names)
                while cut and names[cut - 1] in closes:
                    cut -= 1
                if value not in CLOSES or any(x in CLOSES or x == "p" for x in names[cut:]):
                    if "p" in names[cut:] or value in names[cut:] or {"td", "th", "dt", "dd"} & set(names[cut:]):
                        while len(names) > cut:
                            names.pop()
                            yield "close", stack.pop(), tuple(stack)
            yield "open", marker, tuple(stack)
            if value not in VOID:
                names.append(value)
                stack.append(marker)
        elif value in names:
            while True:
                last = names.pop()
                yield "close", stack.pop(), tuple(stack)
                if last == value:
                    break


# ---- union-free expressions ---------------------------------------------------------------
# An item is a token ("p", "/p", "#" for text), ["+", items] (repeated) or ["?", items].

def fold(items: list) -> list:
    """Fold groups that repeat at once into repeated groups, from left to right."""
    out: list = []
    for item in items:
        out.append(item)
        folded = True
        while folded:
            folded = False
            item = out[-1]
            if isinstance(item, list) and len(item[1]) == 1 and isinstance(item[1][0], list) and item[1][0][0] == item[0]:
                item = out[-1] = item[1][0]          # a group that is nothing but a group of its kind
            for k in range(1, min(GROUP, len(out) - 1) + 1):
                before = out[-k - 1]
                if isinstance(before, list):
                    if before[0] == "+" and len(before[1]) == k and before[1] == out[-k:]:
                        del out[-k:]
                        folded = True
                        break
                    if k == 1 and before == item:
                        del out[-1]
                        folded = True
                        break
                # The groups can only be equal if they end alike.
                if before == item and len(out) >= 2 * k and out[-2 * k:-k] == out[-k:]:
                    out[-2 * k:] = [["+", out[-k:]]]
                    folded = True
                    break
    return out


def expression(page: str | list[Step]) -> list:
    """A page's own union-free expression."""
    items = []
    for kind, value, _ in steps_of(page):
        if kind == "text":
            if value.strip() and items[-1:] != ["#"]:
                items.append("#")
        else:
            items.append(value if kind == "open" else "/" + value)
    return fold(items)


def _with_groups(items: list, groups: list[list]) -> list:
    """Single occurrences of the other side's groups, written as these groups."""
    for group in groups:
        inner, k = group[1], len(group[1])
        out, i = [], 0
        while i < len(items):
            if items[i:i + k] == inner:
                out.append(group)
                i += k
            else:
                out.append(items[i])
                i += 1
        items = out
    return fold(items)


def _key(item) -> str:
    """What two items must agree in to be aligned: groups by how they begin."""
    while isinstance(item, list):
        item = item[1][0]
    return item


class _Common:
    """Longest common subsequences of what follows every pair of places, whatever the lengths.

    A row of the table comes from the one below by a running maximum.  Rows that
    open a block are kept and the block in use is filled again from the next one,
    so the memory grows with the lengths and not with their product.
    """

    def __init__(self, a: list, b: list):
        codes: dict = {}
        self.a, self.b = (np.array([codes.setdefault(x, len(codes)) for x in v], dtype=np.int64) for v in (a, b))
        self.height = max(1, CELLS // (len(b) + 1), math.isqrt(len(a)))
        self.kept: dict[int, np.ndarray] = {}
        row = np.zeros(len(b) + 1, dtype=np.int32)
        for i in range(len(a), -1, -1):
            if i < len(a):
                row = self._above(row, i)
            if i % self.height == 0 or i == len(a):
                self.kept[i] = row
        self.begin, self.rows = -1, []

    def _above(self, below: np.ndarray, i: int) -> np.ndarray:
        row = below.copy()
        np.maximum(below[:-1], below[1:] + (self.b == self.a[i]), out=row[:-1])
        return np.maximum.accumulate(row[::-1])[::-1]

    def _row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        begin = i - i % self.height
        if begin != self.begin:
            end = min(begin + self.height, len(self.a))
            rows = [self.kept[end]]
            for k in range(end - 1, begin, -1):
                rows.append(self._above(rows[-1], k))
            self.begin, self.rows = begin, rows[::-1]       # rows begin + 1 to end
        return self.rows[i - begin - 1]

    def without_first(self, i: int, j: int) -> bool:
        """Whether nothing is lost when item i of ``a``, rather than item j of ``b``, is passed over."""
        return bool(self._row(i + 1)[j] >= self._row(i)[j + 1])


def align(wrapper: list, other: list) -> list:
    """The least expression found that covers both: mismatches become optional, groups are merged."""
    if wrapper == other:
        return wrapper
    wrapper = _with_groups(wrapper, [x for x in other if isinstance(x, list)])
    other = _with_groups(other, [x for x in wrapper if isinstance(x, list)])
    if wrapper == other:
        return wrapper
    a, b = [_key(x) for x in wrapper], [_key(x) for x in other]
    best = _Common(a, b)
    out: list = []
    i = j = 0

    def optional(run: list) -> None:
        plain = [x for x in run if not (isinstance(x, list) and x[0] == "?")]
        if plain:
            out.append(["?", run])
        else:
            out.extend(run)

    while i < len(a) or j < len(b):
        run_a, run_b = i, j
        while i < len(a) and j < len(b) and a[i] != b[j]:
            if best.without_first(i, j):
                i += 1
            else:
                j += 1
        if i >= len(a) or j >= len(b):
            i, j = len(a), len(b)
        if run_a < i:
            optional(wrapper[run_a:i])
        if run_b < j:
            optional(other[run_b:j])
        if i < len(a) and j < len(b):
            x, y = wrapper[i], other[j]
            if x == y:
                out.append(x)
            else:
                kinds = [v[0] if isinstance(v, list) else "" for v in (x, y)]
                inner = [v[1] if isinstance(v, list) else [v] for v in (x, y)]
                out.append(["+" if "+" in kinds else "?", align(inner[0], inner[1])])
            i, j = i + 1, j + 1
    return fold(out)


# ---- wrappers of hosts ------------------------------------------------------------------------

class Wrapper:
    """A host's expression, and what its text slots hold: by the elements they stand in,
    the characters, those within links, the text where all pages agree, and the smallest
    ``DIFFERENT`` hashes of whole pages.  Pages without article element are told apart by
    the containers they have (their template), with the characters of each one's slots."""

    def __init__(self, state: dict | None = None, bounded: bool = True):
        state = state or {"items": None, "pages": 0, "own": 0, "lost": False, "slots": {}, "templates": {}}
        self.items, self.pages, self.own, self.lost, self.slots, self.templates = (
            state[k] for k in ("items", "pages", "own", "lost", "slots", "templates"))
        self.most, self.most_slots = (ITEMS, SLOTS) if bounded else (float("inf"), float("inf"))
        self.held = sum(map(len, self.templates.values()))

    def state(self) -> dict:
        return {"items": self.items, "pages": self.pages, "own": self.own, "lost": self.lost, "slots": self.slots,
                "templates": self.templates}

    def add(self, page: str | list[Step], known: set | None = None) -> None:
        page = steps_of(page)
        items = expression(page)
        key = json.dumps(items)
        if known is None or key not in known:
            self._align(items)
            if known is not None and len(known) < KNOWN:
                known.add(key)
        self.pages += 1
        slots = slots_of(page)
        texts = {path: zlib.crc32(text.encode()) for path, (_, _, text) in slots.items()}
        whole = zlib.crc32(json.dumps(sorted(texts.items())).encode())
        for path, (chars, linked, _) in slots.items():
            self._count(path, chars, linked, texts[path], [whole])
        if not _roots({m for path in slots for m in path.split()}):
            self._template(template_of(slots), {path: chars - linked for path, (chars, linked, _) in slots.items()})

    def merge(self, other: Wrapper) -> None:
        if other.items is not None:
            self._align(other.items)
        self.pages += other.pages
        self.own += other.own
        self.lost = self.lost or other.lost
        for path, (chars, linked, text, seen) in other.slots.items():
            self._count(path, chars, linked, text, seen)
        for template, held in other.templates.items():
            self._template(template, held)

    def _align(self, items: list) -> None:
        aligned = None
        if self.items is None:
            aligned = items
        elif len(items) + len(self.items) <= 2 * self.most:
            aligned = align(self.items, items)
        if aligned is not None and len(aligned) <= self.most:
            self.items = aligned
        else:
            self.own += 1

    def _count(self, path: str, chars: int, linked: int, text, seen: list[int]) -> None:
        old = self.slots.get(path)
        if old is None:
            if len(self.slots) < self.most_slots:
                self.slots[path] = [chars, linked, text, seen]
            else:
                self.lost = True
        else:
            seen = old[3] if seen[0] in old[3] and len(seen) == 1 else sorted({*old[3], *seen})[:DIFFERENT]
            self.slots[path] = [old[0] + chars, old[1] + linked, text if text == old[2] else None, seen]

    def _template(self, template: str, held: dict[str, int]) -> None:
        old = self.templates.get(template)
        if old is None and self.held + len(held) > self.most_slots:
            self.lost = True
            return
        old = self.templates.setdefault(template, {})
        self.held -= len(old)
        for path, chars in held.items():
            old[path] = old.get(path, 0) + chars
        self.held += len(old)
        self.lost = self.lost or self.held > self.most_slots


def container_of(chain: str) -> str:
    return chain.rpartition(" ")[0] or chain


def template_of(slots: dict[str, tuple[int, int, str]]) -> str:
    """The containers in which a page has unlinked text (or any, where it has none), as a hash."""
    unlinked = [p for p, (chars, linked, _) in slots.items() if chars > linked]
    return str(zlib.crc32("\n".join(sorted({container_of(p) for p in unlinked or slots})).encode()))


def slots_of(page: str | list[Step]) -> dict[str, tuple[int, int, str]]:
    """Per chain of block elements outside of page furniture: characters, linked characters, text."""
    found: dict[str, list] = {}
    chains: dict[tuple, str | None] = {}
    page = steps_of(page)
    around = wrapping(page)
    for kind, value, stack in page:
        if kind != "text" or not value.strip():
            continue
        if stack not in chains:
            chains[stack] = None if any(is_furniture(m) and m not in around for m in stack) else chain_of(stack)
        chain = chains[stack]
        if chain is not None:
            slot = found.setdefault(chain, [0, 0, []])
            text = " ".join(value.split())
            slot[0] += len(text)
            slot[1] += len(text) * any(m.partition(".")[0] == "a" for m in stack)
            slot[2].append(text)
    return {k: (c, a, " ".join(t)) for k, (c, a, t) in found.items()}


def _link_lists(items: list) -> set[str]:
    """Chains of the elements of repeated groups whose every text stands within a link."""
    out: set[str] = set()
    stack: list[str] = []

    def visit(run: list) -> None:
        for x in run:
            if isinstance(x, list):
                if x[0] == "+":
                    out.update(_linked(_flat(x[1]), stack))
                visit(x[1])
            elif x.startswith("/"):
                if x[1:] in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(x[1:]):]
            elif x != "#" and x.partition(".")[0] not in VOID:
                stack.append(x)

    visit(items)
    return out


def _linked(group: list[str], stack: list[str]) -> set[str]:
    """Chains of a group's outermost elements below ``stack``, or none if it has a text outside of links."""
    out: set[str] = set()
    depth = links = 0
    texts = False
    for x in group:
        name = x.lstrip("/").partition(".")[0]
        if x == "#":
            texts = True
            if links <= 0:
                return set()
        elif x.startswith("/"):
            depth -= 1
            links -= name == "a"
        elif name not in VOID:
            if depth <= 0:
                out.add(chain_of([*stack, x]))
            depth += 1
            links += name == "a"
    return out if texts else set()


def chain_of(stack: list[str] | tuple[str, ...]) -> str:
    """The block elements among the open ones."""
    return " ".join(m for m in stack if m.partition(".")[0] not in INLINE)


def _under(chain: str, top: str) -> bool:
    return chain == top or chain.startswith(top + " ")


def _flat(items: list) -> list[str]:
    return [y for x in items for y in (_flat(x[1]) if isinstance(x, list) else [x])]


def _roots(markers: set[str]) -> list[str]:
    """The article or main elements, or else those that are named like an article."""
    for name in ("article", "main"):
        found = sorted(m for m in markers if m.partition(".")[0] == name)
        if found:
            return found
    return sorted(m for m in markers if "role" not in m and _words_of(m) & ARTICLE_WORDS)


def plan(wrapper: Wrapper) -> dict:
    """What to take from pages of a wrapper: the article's elements, and what to leave out.

    An article or main element comes first, then one that is named like an article,
    then, for every template, the chain of blocks whose unlinked, changing text is longest.  Within all
    of them, chains of repeated groups whose text is all links on every page
    (``skip``, with what they hold) and slots equal on all pages, of which ``DIFFERENT``
    differ elsewhere (``fixed``), are left out; slots of an article element only while
    the rest outweighs them.  Pages that ``covers`` does not cover use their own expression.
    """
    slots = wrapper.slots
    if wrapper.lost:
        return {"covers": []}
    covers = {"covers": (wrapper.items or []) if wrapper.own else None}
    skip = []
    for top in sorted(_link_lists(wrapper.items or [])):
        held = [v for p, v in slots.items() if _under(p, top)]
        if held and all(v[0] == v[1] for v in held):
            skip.append(top)
    fixed = sorted(p for p, (_, _, text, seen) in slots.items() if text is not None and len(seen) >= DIFFERENT)
    markers = {m for path in slots for m in path.split()}
    roots = _roots(markers)
    if roots:
        inner = {p: v[0] for p, v in slots.items() if not set(roots).isdisjoint(p.split())}
        fixed = [p for p in fixed if p in inner]
        if 2 * sum(inner[p] for p in fixed) > sum(inner.values()):
            fixed = []
        return covers | {"roots": roots, "skip": skip, "fixed": fixed, "paths": None}
    # Chains that share the longest chain's container belong to the same article; every template has its own.
    paths: dict[str, str] = {}
    for template, held in wrapper.templates.items():
        container: dict[str, int] = {}
        for p, c in held.items():
            if p not in fixed and not any(_under(p, x) for x in skip):
                container[container_of(p)] = container.get(container_of(p), 0) + c
        if container:
            paths[template] = max(container, key=lambda p: (container[p], p))
    return covers | {"roots": None, "skip": skip, "fixed": fixed, "paths": paths}


def extract(page: str | list[Step], way: dict) -> str:
    """The article's blocks of a page, joined by two line ends."""
    page = steps_of(page)
    roots, skip, fixed, top = way["roots"], way["skip"], set(way["fixed"]), None
    if roots is None:
        top = way["paths"].get(template_of(slots_of(page)))
        if top is None:
            return ""
    around = wrapping(page)
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = " ".join("".join(held).split())
        if text:
            blocks.append(text)
        held.clear()

    def taken(stack: tuple[str, ...]) -> bool:
        inner = 0
        chain = chain_of(stack)
        if roots is not None:
            inner = next((i for i, m in enumerate(stack) if m in roots), None)
            if inner is None:
                return False
        elif not _under(chain, top):
            return False
        if chain in fixed or any(_under(chain, s) for s in skip):
            return False
        # A header within the article is its own; one outside is the page's.
        return not any(is_furniture(m) and m not in around and not (i > inner and roots is not None and m == "header")
                       for i, m in enumerate(stack))

    known: dict[tuple, bool] = {}
    for kind, value, stack in page:
        if kind != "text":
            if value.partition(".")[0] not in INLINE:
                end()
            elif value.partition(".")[0] == "br":
                held.append(" ")
            continue
        if stack not in known:
            known[stack] = taken(stack)
        if known[stack]:
            held.append(value)
    end()
    return "\n\n".join(blocks)


def _covers(page: list[Step], way: dict, known: dict | None) -> bool:
    """Whether aligning the page's expression would leave the wrapper as it is."""
    wrapper = way["covers"]
    if not wrapper:
        return wrapper is None
    items = expression(page)
    key = json.dumps(items)
    found = known.get(key) if known is not None else None
    if found is None:
        found = len(items) + len(wrapper) <= 2 * ITEMS and align(wrapper, items) == wrapper
        if known is not None and len(known) < KNOWN:
            known[key] = found
    return found


def text_of(page: str | list[Step], way: dict, known: dict | None = None) -> str:
    """Main text of a page by its host's plan, or by its own expression where the plan does not know the article
    or a bounded wrapper does not cover the page (``known`` keeps which expressions it does).

    An article element that is all links or all constant on this page keeps them.
    """
    page = steps_of(page)
    if not _covers(page, way, known) or not _applies(page, way):
        way = _own_way(page)
    text = extract(page, way)
    if not text and way["roots"] is not None:
        text = extract(page, way | {"skip": [], "fixed": []})
    return text


def _own_way(page: str | list[Step]) -> dict:
    own = Wrapper(bounded=False)
    own.add(page)
    return plan(own)


def _applies(page: str | list[Step], way: dict) -> bool:
    """Whether the host's wrapper knows this page's article: its element, or unlinked text in its template's container."""
    page = steps_of(page)
    if way["roots"] is not None:
        return any(kind == "open" and value in way["roots"] for kind, value, _ in page)
    slots = slots_of(page)
    top = way["paths"].get(template_of(slots))
    return top is not None and any(
        chars > linked and _under(p, top) and p not in way["fixed"] and not any(_under(p, x) for x in way["skip"])
        for p, (chars, linked, _) in slots.items())


def host_of(url: str):
    """SQL: the host of a URL in lower case ('' where there is none)."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def infer(pages: DataFrame, salts: int = 64) -> DataFrame:
    """One row per host of ``pages(host, html)``: (host, way), the JSON of its wrapper's plan.

    Wrappers are not bounded, so all pages of a host are read by it, however many there are and however they differ.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, tuple[Wrapper, set]] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page:
                    wrapper, known = wrappers.setdefault(host, (Wrapper(bounded=False), set()))
                    wrapper.add(page, known)
            if len(wrappers) > 10_000:
                yield _emit({h: w for h, (w, _) in wrappers.items()})
                wrappers.clear()
        yield _emit({h: w for h, (w, _) in wrappers.items()})

    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        whole = Wrapper(bounded=False)
        for state in sorted(frame["state"]):
            whole.merge(Wrapper(json.loads(state), bounded=False))
        return pd.DataFrame({"host": [key[0]], "state": [json.dumps(whole.state())]})

    def planned(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        state = merged(key, frame)["state"][0]
        return pd.DataFrame({"host": [key[0]], "way": [json.dumps(plan(Wrapper(json.loads(state), bounded=False)))]})

    partial = pages.select("host", "html").mapInArrow(local, "host string, state string")
    some = partial.withColumn("salt", F.pmod(F.xxhash64("state"), F.lit(salts))).groupBy("host", "salt").applyInPandas(
        merged, "host string, state string")
    return some.groupBy("host").applyInPandas(planned, "host string, way string")


def _emit(wrappers: dict[str, Wrapper]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "host": pa.array(list(wrappers), pa.string()),
        "state": pa.array([json.dumps(w.state()) for w in wrappers.values()], pa.string())})


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Main text of every page: (id_col, url, text, n_chars).

    Blocks in page order, white space within a block as single spaces, joined by
    two line ends.  A null or empty page, or one without article, has an empty
    text.  Pages without host share the host ''.  Repeated rows give repeated
    rows; other columns play no part; an empty table gives an empty table.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(page).alias("html"))
    base = base.withColumn("host", host_of("url"))
    rows = base.join(infer(base), "host", "left").select("id", "url", "html", "way")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict[str, tuple[dict, dict]] = {}
        for batch in batches:
            texts = []
            for body, way in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if not body:
                    texts.append("")
                    continue
                if way not in ways:
                    if len(ways) > 10_000:
                        ways.clear()
                    ways[way] = json.loads(way), {}
                texts.append(text_of(body, *ways[way]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    schema = f"id {base.schema['id'].dataType.simpleString()}, url string, text string, n_chars long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
