"""Main-text extraction by equivalence-class template deduction.

Pages are grouped by host; a large host is dealt into groups of bounded bytes
and rows by hash, so that no group grows with the host.  Pages of a group that
are equal count once.  Tokens are tags by their path, and words by the path of
the tag that holds them.

Classes.  Tags with the same occurrence vector over the group's pages form an
equivalence class.  A class is valid if it occurs on two pages or more, its tags
stand in one order on every page (for a vector of k, k times one after another)
and all of it lies in the same slot of the class around it.  A class that fails
is split by its outermost tags, and these into single tags.  Valid classes,
nested by path, are the template: the class of ones is its frame, classes with
zeros are optional parts, larger counts are lists.  A word belongs to the class
of its tag if it has the same vector; such words are the template's own.

Slots.  What a template tag holds besides is a slot.  A slot is chrome if most of
its characters are links (a menu), if its fill is the same on several pages
(adverts and notices from a pool), or if the words are the template's own.  All
other slots are extracted.  Of pages with one `article` (or `main`), only that is
extracted.  An `article` loses what tags, or names made of nothing but such words,
say to be menu, footer, advert, notice, form or comment; what only hints at it (an
`aside`, "related-work") goes if the template finds it to be links or a fill that
repeats, and stays if it varies between pages.  A box in an article that says the
same on nine in ten of three pages or more goes without any name.

Lists of tags and names mark chrome that pages cannot tell apart, and are all
there is for a host with a single page.  They yield to the template: where names
would take out more than two thirds of what varies between pages, names are
ignored.  Where pages of a group hardly differ (near copies), nothing can be
deduced and each page stands alone.

Text is cut into blocks at block-level tags and line breaks; character references
are decoded, white space inside a block becomes one space, blocks are joined by a
line feed.

Cases: null and empty html give an empty text; html without tags is one block;
unclosed or stray tags are closed or ignored as browsers do for the common
cases; a null url, or one without a host, belongs to the host of the empty name;
repeated rows get the same text each; a very long page costs time and memory in
proportion to its length, however deep its tags nest; ties between slots go to
the first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

# Tag sets of the HTML standard and names that mark what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea select title".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
P_SCOPE = ("table", "td", "th", "button", "object", "caption", "article", "div", "section")
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUT_TAGS = frozenset("nav footer aside form button select input dialog menu search fieldset".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adbox adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside rail menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar toolbar footer footers footnav comment comments commentlist reply replies respond disqus discussion feedback share sharing social related recommended recommendations pagination pager paging widget widgets skip copyright disclaimer legal form search".split()
)
#: Names that mark chrome around an article but may well name a part of one.
WEAK_NAMES = frozenset("alert alerts banner banners disclaimer discussion feedback form legal login overlay promotion rail reply replies respond search skip subscription".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
COMMENT_NAMES = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Words that only say where or how a box stands: names of these and of the above hint at nothing else.
PLACE_NAMES = frozenset("area article articles bar block body bottom box btn button buttons card cards col column container content entries entry group header heading holder icon icons inline inner item items left link links list main media module more news outer page pages panel post posts reader readers right row section site slot story stories strip text thread title top unit user users wrap wrapper zone".split())
BOXES = frozenset("aside div section".split())

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOPS = re.compile(r">|=\s*([\"'])")
RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: Names that say what a box goes with, or lacks: "with-sidebar" is no sidebar.
BESIDE = re.compile(r"(?<![A-Za-z])(?:with|has|no|without|show|hide)[-_]?[A-Za-z]+", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Paths:
    """Tag paths of a group of pages as small numbers; a parent's is less than its children's, 0 is the page itself."""

    def __init__(self) -> None:
        self.parent, self.tag, self.name = [0], [""], [""]
        self.known: dict[tuple[int, str], int] = {}

    def child(self, parent: int, name: str, tag: str) -> int:
        path = self.known.setdefault((parent, name), len(self.parent))
        if path == len(self.parent):
            self.parent.append(parent)
            self.tag.append(tag)
            self.name.append(name)
        return path


@dataclass
class Page:
    #: The path of each start tag, in page order.
    order: list[int] = field(default_factory=list)
    #: (path of the enclosing tag, why it is marked or empty, text, characters in links), in page order.
    blocks: list[tuple[int, str, str, int]] = field(default_factory=list)
    #: The paths in articles whose tag or name only hints at chrome ("hint" is then the mark of their blocks).
    hints: set[int] = field(default_factory=set)


def _told(names: str, tag: str, reason: str) -> str:
    """What a tag's names add to the reason for taking it out of an article."""
    for name in BESIDE.sub(" ", names).split():
        parts = {p.lower() for p in NAME_PARTS.findall(name)}
        told = parts - WEAK_NAMES
        if not told & COMMENT_NAMES and (tag == "article" or not told & OUT_NAMES):
            continue
        if not parts <= OUT_NAMES | PLACE_NAMES:
            reason = reason or "hint"
        elif told & COMMENT_NAMES:
            reason = "comment"
        elif reason in ("", "hint"):
            reason = "name"
    return reason


def _marked(tag: str, attributes: str, in_article: bool) -> tuple[str, str, str]:
    """(reason or empty, name for the path, tag by its role) of a start tag."""
    reason, name, role = "", tag, tag
    if tag in OUT_TAGS or tag in ("header", "label") and not in_article:
        reason = "hint" if in_article and tag == "aside" else "tag"
    if not attributes or attributes.isspace():
        return reason, name, role
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind in ("class", "id"):
            if first := value.split()[:1]:
                name += ("." if kind == "class" else "#") + first[0]
            if tag in ("html", "body", "main"):
                continue
            if in_article:
                reason = _told(value, tag, reason)
                continue
            parts = {p.lower() for p in NAME_PARTS.findall(BESIDE.sub(" ", value))}
            if parts & COMMENT_NAMES:
                reason = "comment"
            elif tag != "article" and (parts & OUT_NAMES or "header" in parts and not parts & {"article", "post", "entry", "content"}):
                reason = reason or "name"
        elif kind == "role" and value.lower() == "main":
            role = "main"
        elif kind == "itemprop" and value == "articleBody":
            role = "article"
        elif kind == "role" and value.lower() in OUT_ROLES or kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and HIDDEN.search(value):
            reason = "name" if reason == "hint" else reason or "name"
    return reason, role if role in ("article", "main") else name, role


def _tag_end(html: str, at: int, gone: set[str]) -> int:
    """The place of the > that ends a start tag, past quoted values; -1 if there is none.  gone: quotes that do not come again."""
    while m := STOPS.search(html, at):
        at, quote = m.end(), m[1]
        if quote is None:
            return m.start()
        if quote not in gone:
            to = html.find(quote, at)
            if to < 0:
                gone.add(quote)
            else:
                at = to + 1
    return -1


def parse(html: str, paths: Paths) -> Page:
    """A page's tags and text blocks, in one pass."""
    page = Page()
    stack: list[tuple[str, int, str, bool]] = [("", 0, "", False)]  # tag, path, reason, inside an article
    places: dict[str, list[int]] = defaultdict(list)  # the depths at which a tag is open
    waiting: list[str] = []
    linked, gone, find = 0, set(), html.find

    def flush() -> None:
        nonlocal linked
        if waiting:
            text = " ".join(entities.unescape("".join(waiting)).split())
            waiting.clear()
            if text:
                page.blocks.append((stack[-1][1], stack[-1][2], text, min(linked, len(text))))
            linked = 0

    def close(depth: int) -> None:
        if any(s[0] in BLOCK or s[2] != stack[k - 1][2] for k, s in enumerate(stack[depth:], depth)):
            flush()
        for s in stack[depth:]:
            places[s[0]].pop()
        del stack[depth:]

    def deepest(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    at, n = 0, len(html)
    while at < n:
        to = find("<", at)
        if to < 0:
            to = n
        if to > at:
            waiting.append(html[at:to])
            if places["a"]:
                linked += len(waiting[-1].strip())
        if to == n:
            break
        m = NAME.match(html, to + 1)
        if m is None:
            if html.startswith("<!--", to):
                end = find("-->", to + 4)
                at = n if end < 0 else end + 3
            elif html[to + 1 : to + 2] in ("!", "?", "/"):
                end = find(">", to + 1)
                at = n if end < 0 else end + 1
            else:
                waiting.append("<")
                at = to + 1
            continue
        tag = m[2].lower()
        if m[1]:
            end = find(">", m.end())
            at = n if end < 0 else end + 1
            if places[tag]:
                close(places[tag][-1])
            elif tag in BLOCK:
                flush()
            continue
        end = _tag_end(html, m.end(), gone)
        if end < 0:  # a tag that the page's end cuts off
            break
        at, attributes = end + 1, html[m.end() : end]
        if tag in RAW:
            if not (tag in ("svg", "math") and attributes.endswith("/")):
                over = RAW_ENDS[tag].search(html, at)
                end = find(">", over.end()) if over else -1
                at = n if end < 0 else end + 1
            continue
        if tag in BLOCK:
            flush()
        if tag in CLOSES_P and places["p"] and places["p"][-1] > deepest(P_SCOPE):
            close(places["p"][-1])
        if tag in SIBLINGS and (depth := deepest(SIBLINGS[tag])) > deepest(SCOPE[tag]):
            close(depth)
        if tag in VOID:
            continue
        _, above, why, inside = stack[-1]
        reason, name, role = _marked(tag, attributes, inside)
        holds = role in ("article", "main")
        # an article inside something taken out by its name only (a page-wide wrapper) is none the less an article
        if holds and not reason and why in ("name", "hint"):
            kept = ""
        else:
            kept = reason if reason == "comment" or why == "hint" and reason else why or reason
        if kept != why:
            flush()
        path = paths.child(above, name, role)
        if kept == reason == "hint":
            page.hints.add(path)
        page.order.append(path)
        places[tag].append(len(stack))
        stack.append((tag, path, kept, inside or holds))
        if SELF_CLOSED.search(attributes) and tag not in BLOCK:
            close(len(stack) - 1)
    flush()
    return page


def common_names(pages: list[Page], paths: Paths) -> tuple[list[Page], Paths]:
    """The pages by paths in which names of one page only (numbers, slugs) are left out, so that pages have paths in common."""
    if len(pages) < 2:
        return pages, paths
    on = Counter(name for page in pages for name in {paths.name[p] for p in page.order})
    merged, place = Paths(), [0]
    for p in range(1, len(paths.parent)):
        tag = re.split("[.#]", paths.name[p], maxsplit=1)[0]
        place.append(merged.child(place[paths.parent[p]], paths.name[p] if on[paths.name[p]] > 1 else tag, paths.tag[p]))
    return [Page([place[p] for p in page.order], [(place[b[0]], *b[1:]) for b in page.blocks], {place[p] for p in page.hints}) for page in pages], merged


@dataclass
class Class:
    #: Tag paths in page order, and (page, occurrences) for the pages that have them.
    paths: tuple[int, ...]
    vector: tuple[tuple[int, int], ...]


def classes(orders: list[list[int]], paths: Paths, support: int) -> list[Class]:
    """The valid equivalence classes of tags on `support` pages or more."""
    counts: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, order in enumerate(orders):
        for path, n in Counter(order).items():
            counts[path].append((i, n))
    by_vector: dict[tuple, list[int]] = defaultdict(list)
    for path, vector in counts.items():
        if len(vector) >= support:
            by_vector[tuple(vector)].append(path)
    open_ones = [(vector, frozenset(group)) for vector, group in by_vector.items()]
    found: list[Class] = []
    for whole in (True, False, False):  # whole classes, then parts by outermost tag, then single tags
        valid, failed = _ordered(open_ones, orders, paths)
        found += valid
        open_ones = []
        for vector, group in failed:
            top: dict[int, int] = {}
            for p in sorted(group):  # parents come first
                top[p] = top.get(paths.parent[p], p) if whole else p
            parts = defaultdict(set)
            for p, outermost in top.items():
                parts[outermost].add(p)
            open_ones += [(vector, frozenset(part)) for part in parts.values()]
    return found


def _ordered(groups: list[tuple[tuple, frozenset]], orders: list[list[int]], paths: Paths) -> tuple[list[Class], list]:
    """(valid classes, groups that fail): one order on all pages, and, unless on every page once, one slot around all of it."""
    of = {p: g for g, (_, group) in enumerate(groups) for p in group}
    pattern: dict[int, list[int]] = {}
    bad: set[int] = set()
    for order in orders:
        here: dict[int, list[int]] = defaultdict(list)
        for p in order:
            g = of.get(p)
            if g is not None and g not in bad:
                here[g].append(p)
        for g, seen in here.items():
            size = len(groups[g][1])
            first = pattern.setdefault(g, seen[:size])
            if len(set(first)) != size or seen != first * (len(seen) // size):
                bad.add(g)
    for g, (vector, group) in enumerate(groups):
        if len(vector) < len(orders) or any(n > 1 for _, n in vector):
            if len({paths.parent[p] for p in group if paths.parent[p] not in group}) > 1:
                bad.add(g)
    return [Class(tuple(pattern[g]), groups[g][0]) for g in range(len(groups)) if g not in bad], [groups[g] for g in sorted(bad)]


@dataclass
class Template:
    #: The article or main that is extracted (0: the page), and the article in it whose slots all stay (-1: none).
    root: int
    core: int
    #: Paths of chrome slots and what lies in them.
    chrome: set[int]
    #: Template words by path.
    words: dict[int, set[str]]
    names: bool
    #: Chrome slots of the core and what lies in them; None where one page stands alone and hints are all there is.
    inner: set[int] | None = None


def own_words(pages: list[Page]) -> dict[int, set[str]]:
    """The words at each path that have the path's own occurrence vector."""
    words: dict[int, set[str]] = {}
    for page in pages:
        times, said = Counter(page.order), defaultdict(list)
        times[0] = 1
        for path, _, text, _ in page.blocks:
            said[path].append(text)
        for path, n in times.items():
            if words.get(path) == set():
                continue
            if path not in said:
                words[path] = set()
                continue
            here = {w for w, k in Counter(" ".join(said[path]).split()).items() if k == n}
            words[path] = words[path] & here if path in words else here
    return {path: found for path, found in words.items() if found}


def _fixed(block: tuple, words: dict[int, set[str]], tag: str) -> bool:
    """Whether a block says what the template says; outside headings numbers may vary."""
    if not (own := words.get(block[0])):
        return False
    return all(w in own or tag not in HEADINGS and not any(map(str.isalpha, w)) for w in block[2].split())


def named_root(page: Page, paths: Paths) -> tuple[int, int]:
    """(main or 0, article or 0): the page's only main, and only outermost article, with text that is not marked."""
    held = {path for path, reason, _, _ in page.blocks if reason in ("", "hint")}
    for path in list(held):
        while path and paths.parent[path] not in held:
            path = paths.parent[path]
            held.add(path)
    within: set[int] = set()
    for path in sorted(held):  # parents come first
        if paths.parent[path] in within or paths.tag[paths.parent[path]] == "article":
            within.add(path)
    mains = [p for p in page.order if paths.tag[p] == "main" and p in held]
    articles = [p for p in page.order if paths.tag[p] == "article" and p in held and p not in within]
    return (mains[0] if len(mains) == 1 else 0), (articles[0] if len(articles) == 1 else 0)


def _above(path: int, paths: Paths) -> set[int]:
    out = set()
    while path:
        path = paths.parent[path]
        out.add(path)
    return out


def deduce(pages: list[Page], paths: Paths, root: tuple[int, int] = (0, 0)) -> Template | None:
    """The template of different pages that share a named root; None where several pages hardly differ."""
    n, many = len(pages), len(pages) > 1
    valid = classes([p.order for p in pages], paths, 2 if many else 1)
    template = {p for c in valid for p in c.paths}
    once = {p for c in valid if all(k == 1 for _, k in c.vector) for p in c.paths}
    words = {p: w for p, w in own_words(pages).items() if p in template or not p} if many else {}

    size = len(paths.parent)
    varies, fixed, text, links, named = ([0] * size for _ in range(5))
    fills: dict[int, Counter] = defaultdict(Counter)
    for page in pages:
        own = defaultdict(list)
        for block in page.blocks:
            path, reason, said, linked = block
            here = words.get(path)
            new = sum(len(w) for w in said.split() if w not in here) if here else len(said)
            if reason == "name" and 2 * linked < len(said):
                named[path] += new
            if reason and not (many and reason == "hint"):
                continue
            text[path] += len(said)
            links[path] += linked
            varies[path] += new
            fixed[path] += len(said) - new
            if path in once:
                own[path].append(said)
        for path, said in own.items():
            fills[path]["\n".join(said)] += 1
    for path in range(size - 1, 0, -1):
        for sums in (varies, fixed, text, links, named):
            sums[paths.parent[path]] += sums[path]
    if many and 4 * (varies[0] + named[0]) < fixed[0]:
        return None

    main, article = root
    core = article if article and 10 * text[article] >= 3 * text[0] else -1
    top = main if main and 10 * text[main] >= 3 * text[0] else max(core, 0)
    if core > 0 and top != core and top not in _above(core, paths):
        top = core
    chrome: set[int] = set()
    for path in range(1, size):
        if paths.parent[path] in chrome and paths.parent[path] != core:
            chrome.add(path)
        elif path in template and path != core and text[path]:
            menu = paths.tag[path] not in TEXTUAL and 2 * links[path] >= text[path] and 2 * text[path] < text[0]
            pool = sum(k for k in fills[path].values() if k > 1) if many and path in once else 0
            if menu or 2 * pool > sum(fills[path].values()) and 2 * text[path] < text[0]:
                chrome.add(path)
    inner = inner_chrome(pages, paths, core, template, once, text, links) if many and core > 0 else None
    return Template(top, core, chrome, words, named[0] <= 2 * varies[0], inner)


def inner_chrome(pages: list[Page], paths: Paths, core: int, template: set[int], once: set[int], text: list[int], links: list[int]) -> set[int]:
    """The chrome slots in an article, and all that lies in them."""
    deep = [False] * len(paths.parent)
    for path in range(1, len(deep)):
        deep[path] = path == core or deep[paths.parent[path]]
    fills: dict[int, Counter] = defaultdict(Counter)  # all that a path holds on a page, as a hash made from the leaves up
    for page in pages:
        said: dict[int, list[str]] = defaultdict(list)
        for path, reason, block, _ in page.blocks:
            if deep[path] and reason in ("", "hint"):
                said[path].append(block)
        below: dict[int, int] = defaultdict(int)
        for path in sorted({p for p in page.order if deep[p]}, reverse=True):
            if path in said or path in below:
                fill = hash((path, tuple(said.get(path, ())), below.get(path, 0)))
                fills[path][fill] += 1
                below[paths.parent[path]] += fill
    hints = set().union(*(page.hints for page in pages))
    out: set[int] = set()
    for path in range(core + 1, len(deep)):
        if not deep[path]:
            continue
        on, pool = sum(fills[path].values()), sum(k for k in fills[path].values() if k > 1)
        if paths.parent[path] in out:
            out.add(path)
        elif path in template and path in hints:
            if 2 * links[path] >= text[path] or 2 * pool > on:
                out.add(path)
        elif path in once and paths.tag[path] in BOXES and len(pages) > 2 and len(fills[path]) == 1 and 10 * on >= 9 * len(pages) and 2 * text[path] < text[core]:
            out.add(path)
    return out


def extract(page: Page, t: Template, paths: Paths) -> str:
    """The main text of a page under a template."""
    inside: dict[int, tuple[bool, bool]] = {0: (t.root == 0, False)}

    def where(path: int) -> tuple[bool, bool]:
        """Whether a path lies in the root, and in the core."""
        way = []
        while path not in inside:
            way.append(path)
            path = paths.parent[path]
        for p in reversed(way):
            under, deep = inside[paths.parent[p]]
            inside[p] = (under or p == t.root, deep or p == t.core)
        return inside[way[0] if way else path]

    def kept(names: bool) -> list[str]:
        out, outside, heads = [], [], 0
        for block in page.blocks:
            path, reason, said, _ = block
            under, deep = where(path)
            if reason == "hint":
                reason = "" if deep and t.inner is not None else "name"
            if reason and (names or reason != "name"):
                continue
            if deep and not (names and t.inner and path in t.inner) or not deep and under and path not in t.chrome and not _fixed(block, t.words, paths.tag[path]):
                out.append(said)
                heads += paths.tag[path] == "h1"
            elif not under and paths.tag[path] == "h1" and not out and path not in t.chrome and not _fixed(block, t.words, "h1"):
                outside.append(said)
        return (outside if not heads and out else []) + out  # a title that stands before its article

    return "\n".join(kept(t.names) or kept(False))  # a page cannot be chrome alone: a name misled


def extract_group(pages: list[str]) -> list[str]:
    """The main texts of a group of pages of one host."""
    different, paths = list(dict.fromkeys(pages)), Paths()
    parsed, paths = common_names([parse(h, paths) for h in different], paths)
    kinds: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, page in enumerate(parsed):
        kinds[named_root(page, paths)].append(i)
    texts: dict[str, str] = {}
    for root, group in kinds.items():
        shared = deduce([parsed[i] for i in group], paths, root)
        for i in group:
            texts[different[i]] = extract(parsed[i], shared or _alone(parsed[i], paths, root), paths)
    return [texts[h] for h in pages]


def _alone(page: Page, paths: Paths, root: tuple[int, int]) -> Template:
    """The template of one page, over its own paths only."""
    own = sorted(set(page.order) | {0})
    place = {p: i for i, p in enumerate(own)}
    few = Paths()
    few.parent, few.tag = [place[paths.parent[p]] for p in own], [paths.tag[p] for p in own]
    small = Page([place[p] for p in page.order], [(place[b[0]], *b[1:]) for b in page.blocks], {place[p] for p in page.hints})
    t = deduce([small], few, (place[root[0]], place[root[1]]))
    return Template(own[t.root], own[t.core] if t.core > 0 else -1, {own[p] for p in t.chrome}, {}, t.names)


def html_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", group_pages: int = 200, group_bytes: int = 8 << 20, broadcast_hosts: int = 100_000, task_bytes: int = 16 << 20) -> DataFrame:
    """id_col, url, text and n_chars of every page."""
    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = rows.withColumn("host", host)
    sizes = written(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("bytes")), "hosts")
    parts = F.ceil(F.greatest(F.col("n") / group_pages, F.col("bytes") / group_bytes))
    large = sizes.select("host", parts.alias("parts")).where("parts > 1")
    # a large host has over group_pages pages or group_bytes, so there are few; beyond the bound they are joined by shuffle
    found = sizes.agg(F.count_if(parts > 1), F.sum("bytes")).first()
    few = found[0] <= broadcast_hosts
    dealt = rows.join(F.broadcast(large) if few else large, "host", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", "url"), F.col("parts")), F.lit(0)))
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(found[1] or 0) // task_bytes))

    def run(table: pa.Table) -> pa.Table:
        texts = extract_group(table.column("html").to_pylist())
        return pa.table({id_col: table.column("id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return dealt.select("host", "part", "id", "url", "html").repartition(tasks, "host", "part").groupBy("host", "part").applyInArrow(run, f"`{id_col}` {kinds[id_col]}, url string, text string, n_chars long")
