"""HTML extraction by wrapper induction over the pages of a host."""

from __future__ import annotations

import html as entities_of
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Production parameters of op8: in a slot on at least so many different pages of a host, a text on at least this share of the host's pages
#: is template; within article or main it takes the larger share.
LEAST_PAGES, CONSTANT_SHARE, FIRM_SHARE = 4, 0.5, 0.9
#: Elements nested deeper share the place of what they are in when trees are aligned; their text is read like any other.
_DEEPEST = 48
#: Characters of running text in one element outside any article, from which it can be what the page is about.
_STORY = 200
#: Sums held at once when child lists are aligned; of larger tables some rows are kept and the others computed again, with the same result.
_MOST_CELLS = 200_000

#: Fixed values of HTML: elements without content, with raw text, that end an open paragraph, and that only mark text up.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: A start tag of the left ends an open element of the right, up to the nearest one that holds lists or tables.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "select", "menu"}
#: Elements that are never an article's text.
ASIDE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "canvas", "textarea", "dialog", "xmp", "noembed", "noframes"}
#: Whole names (class or id) and roles by which a slot that varies from page to page is told from content.
ASIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "complementary", "contentinfo",
    "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "paywall", "comments", "disqus", "discussion", "respond", "replies", "related", "recommended", "share", "sharing", "social", "widget", "search", "pagination", "pager",
}
#: Words that say so as the first or last word of a longer name as well, unless a word of the next line is in the name too.
ASIDE_WORDS = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "nav", "navbar", "menu", "breadcrumb", "breadcrumbs", "masthead", "footer", "sidebar", "cookie", "cookies", "gdpr", "popup", "modal", "newsletter", "subscribe", "paywall", "comments", "disqus", "widget", "pagination", "pager"}
OWN_WORDS = {"entry", "post", "article", "content", "story", "body", "text", "main"}
#: Of the names, the ones an article may well use of its own parts; there they count as a role or on a list only.
AMBIGUOUS = {
    "header", "discussion", "related", "search", "share", "sharing", "notice", "alert", "social", "menu", "respond", "replies", "navigation", "consent", "login", "footer", "banner", "recommended",
    "widget", "modal", "popup", "pager", "pagination", "newsletter", "subscribe", "signup", "paywall", "promo",
}
#: Of the ambiguous names, the ones that pages use of their own parts outside an article too.
WEAK = {"discussion", "login", "search"}
#: Words that may stand beside one of ASIDE_WORDS in a longer name; any other word makes it a name of something else (ad-hoc, comments-policy).
STRUCTURE = {"area", "bar", "block", "bottom", "box", "card", "center", "col", "column", "container", "content", "desktop", "fixed", "float", "form", "global", "group", "inner", "item", "items", "label", "left", "link", "links", "list", "mobile", "module", "outer", "page", "panel", "placeholder", "primary", "right", "row", "secondary", "section", "site", "slot", "sticky", "top", "unit", "widget", "wrap", "wrapper", "zone"}
LISTS = {"ul", "ol", "dl"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Elements in which no name says that they are aside: running text.
RUNNING = HEADINGS | {"html", "body", "blockquote", "pre", "figure", "figcaption", "table", "tbody", "tr"}

_QUOTES = re.compile("[>\"']")
_ENDS_NAME = re.compile(r"[\s/>]")
_LETTER = re.compile("[a-zA-Z]")
_NAMES = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_ROLES = re.compile(r"(?i)(?<![\w-])role\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[A-Za-z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_OPEN, _CLOSE = -1, -2


class Page:
    """A tolerant DOM in page order: unclosed and misnested tags, comments, raw text and cut-off pages all give a tree.

    Nodes are numbered by their start tags, 0 is the page; `events` holds (node, text), with _OPEN and _CLOSE for tags.
    Nothing here recurses, and each character is looked at a bounded number of times, whatever the nesting.
    """

    def __init__(self, page: str):
        self.tags, self.parents, self.tokens, self.roles = ["#"], [-1], [()], [()]
        self.events: list[tuple[int, str | int]] = []
        self._read(page)
        self._judge()

    def _read(self, page: str) -> None:
        open_, at, events, tags = [0], 0, self.events, self.tags
        depths: dict[str, list[int]] = {}  # of the open elements of a tag
        blocks = [0]  # the depths of open blocks

        def close(depth: int) -> None:
            for node in reversed(open_[depth:]):
                events.append((node, _CLOSE))
                depths[tags[node]].pop()
                if tags[node] in BLOCKS:
                    blocks.pop()
            del open_[depth:]

        def nearest(names: Iterable[str]) -> int:
            return max((depths[t][-1] for t in names if depths.get(t)), default=0)

        for start, end, tag, closing, attributes in _tags(page):
            if start > at:
                events.append((open_[-1], page[at:start]))
            at = end
            if not tag:
                continue
            if closing:
                depth = nearest((tag,))
                if depth and (tag in BLOCKS or depth > blocks[-1]):
                    close(depth)  # a stray end of an inline element ends no block
                continue
            if tag in BLOCKS and tags[open_[blocks[-1]]] == "p":
                close(blocks[-1])
            if tag in ENDS and (depth := nearest(ENDS[tag])) > nearest(HOLDS):
                close(depth)
            node = len(tags)
            tags.append(tag)
            self.parents.append(open_[-1])
            names = _tokens(_NAMES, attributes)
            self.tokens.append(names)
            self.roles.append(_tokens(_ROLES, attributes) if names else ())
            events.append((node, _OPEN))
            if tag not in VOID and not attributes.endswith("/"):
                depths.setdefault(tag, []).append(len(open_))
                if tag in BLOCKS:
                    blocks.append(len(open_))
                open_.append(node)
        if at < len(page):
            events.append((open_[-1], page[at:]))

    def _judge(self) -> None:
        """By node: whether it is aside by its element or name, whether it is in article or main; only the latter count if there are any."""
        n = len(self.tags)
        self.gone, self.inside, self.only = [False] * n, [False] * n, False
        for i in range(1, n):
            up = self.parents[i]
            inside = self.inside[up]
            self.gone[i] = self.gone[up] or _aside(self.tags[i], self.tokens[i], self.roles[i], inside)
            if not self.gone[i]:
                self.inside[i] = inside or self.tags[i] in ("article", "main") or "main" in self.roles[i]
                self.only = self.only or self.inside[i]
        if self.only:
            self._weigh()

    def _weigh(self) -> None:
        """Articles that are a list of cards beside the page's text, or one small card, don't silence it; repeated cards go themselves."""
        own = [0] * len(self.tags)  # text in each article or main as a whole, at its outermost element
        top = [0] * len(self.tags)
        best: dict[int, int] = {}
        for i in range(1, len(self.tags)):
            top[i] = top[self.parents[i]] or (i if self.inside[i] else 0)
        for node, what in self.events:
            if isinstance(what, int) or self.gone[node] or not (n := len(what.strip())):
                continue
            if top[node]:
                own[top[node]] += n
                continue
            while node > 0 and self.tags[node] not in BLOCKS:
                node = self.parents[node]
            if self.tags[node] not in ("html", "body"):  # running text stands in paragraphs of one element
                node = self.parents[node]
                best[node] = best.get(node, 0) + n
        outside, inside = max(best.values(), default=0), sum(own)
        cards: dict[int, list[int]] = {}
        for i in {t for t in top if t}:
            if self.tags[i] == "article":
                cards.setdefault(self.parents[i], []).append(i)
        listed = {i for same in cards.values() if len(same) > 1 for i in same}
        self.only = outside <= max(_STORY, inside * (1 if listed else 3))
        if not self.only:
            for i in range(1, len(self.tags)):
                self.gone[i] = self.gone[i] or top[i] in listed

    def places(self) -> tuple[str, list[int]]:
        """The tree without its text, inline mark-up left out and runs of like siblings written once; and the place in it of each node."""
        n = len(self.tags)
        own, depth = [0] * n, [0] * n  # the node whose place it shares
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            up = own[self.parents[i]]
            if (self.tags[i] in BLOCKS or self.tags[i] in ASIDE_TAGS) and depth[up] < _DEEPEST:
                own[i], depth[i] = i, depth[up] + 1
                kids[up].append(i)
            else:
                own[i] = up
        known: dict[tuple, int] = {}
        shapes, sizes, like = [], [], [0] * n
        for i in range(n - 1, -1, -1):
            if own[i] == i:
                below = [like[k] for k in kids[i]]
                label = ".".join((self.tags[i], *dict.fromkeys(w for t in self.tokens[i] for w in _WORDS.findall(t))))
                key = (label, tuple(b for b, a in zip(below, [None, *below]) if a != b))
                if key not in known:
                    known[key] = len(shapes)
                    shapes.append(key)
                    sizes.append(1 + sum(sizes[b] for b in key[1]))
                like[i] = known[key]
        place = [0] * n
        for i in range(n):
            if own[i] != i:
                place[i] = place[own[i]]
                continue
            at, last = place[i] + 1, None
            for k in kids[i]:
                if last is not None and like[k] != like[last]:
                    at += sizes[like[last]]
                place[k], last = at, k
        written: list[str] = []
        for name, below in shapes:  # children come first
            written.append(f"{name}({' '.join(written[b] for b in below)})" if below else name)
        return written[like[0]], place

    def counted(self) -> Iterator[tuple[int, str]]:
        """(node, text) of what is left of the page."""
        for node, what in self.events:
            if not isinstance(what, int) and not self.gone[node] and (self.inside[node] or not self.only):
                yield node, what

    def texts(self, place: list[int]) -> dict[int, tuple[int, int, bool, set[int]]]:
        """The texts that count, by place (a run's members together): hash, length, whether in article or main, the nodes that hold them."""
        held: dict[int, tuple[list[str], set[int]]] = {}
        for node, text in self.counted():
            if text := " ".join(text.split()):
                while self.parents[node] > 0 and self.tags[node] not in BLOCKS and place[node] == place[self.parents[node]]:
                    node = self.parents[node]
                parts, nodes = held.setdefault(place[node], ([], set()))
                parts.append(text)
                nodes.add(node)
        return {at: (xxhash.xxh64_intdigest("\n".join(parts)) - (1 << 63), sum(map(len, parts)), self.inside[min(nodes)], nodes) for at, (parts, nodes) in held.items()}

    def text(self, template: Iterable[tuple[int, int, bool]] = ()) -> str:
        """The blocks that count and are not template, in page order."""
        mute: set[int] = set()
        template = {(at, text): firm for at, text, firm in template}
        if template:
            found = self.texts(self.places()[1])
            same = {at for at, (text, _, inside, _) in found.items() if (at, text) in template and (template[at, text] or not inside)}
            # an article of which most is constant is one that the host repeats, not a template around another
            total = sum(n for _, n, inside, _ in found.values() if inside)
            few = 2 * sum(found[at][1] for at in same if found[at][2]) <= total
            mute = {node for at in same for node in found[at][3] if few or not found[at][2]}
        silent = [False] * len(self.tags)
        for i in range(len(self.tags)):
            silent[i] = i in mute or self.tags[i] not in BLOCKS and i > 0 and silent[self.parents[i]]
        blocks: list[list[str]] = [[]]
        for node, what in self.events:
            if what == _OPEN or what == _CLOSE:
                if self.gone[node]:
                    if what == _OPEN and not self.gone[self.parents[node]]:
                        blocks.append([])
                elif self.tags[node] in BLOCKS:
                    blocks.append([])
                elif self.tags[node] in ("br", "img"):
                    blocks[-1].append(" ")
            elif not self.gone[node] and not silent[node] and (self.inside[node] or not self.only):
                blocks[-1].append(what)
        texts = (" ".join(entities_of.unescape("".join(b)).split()) for b in blocks if b)
        return "\n".join(t for t in texts if t)


def _tokens(pattern: re.Pattern, attributes: str) -> tuple[str, ...]:
    return tuple(t for x in pattern.findall(attributes) for t in "".join(x).lower().split()) if "=" in attributes else ()


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name in lower case or "", whether an end tag, attributes) in turn; what lies inside raw text elements is passed over.

    A tag ends at the first > outside quotes. Where quotes never close, it and all further tags end at the first >; a
    tag that has none is cut off and reaches to the end of the page.
    """
    at, n, quoted = 0, len(page), True
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        closing = page.startswith("/", at)
        if not _LETTER.match(page, at + closing):
            if page.startswith("!--", at):
                end = page.find("-->", at + 3)
                at = n if end < 0 else end + 3
                yield start, at, "", False, ""
            elif page[at : at + 1] in ("!", "?", "/"):
                end = page.find(">", at)
                at = n if end < 0 else end + 1
                yield start, at, "", False, ""
            continue
        name = _ENDS_NAME.search(page, at + closing)
        first = name.start() if name else n
        end = first
        while quoted and end < n and (m := _QUOTES.search(page, end)) and m[0] != ">":
            end = page.find(m[0], m.end()) + 1
            if not end:
                quoted = False
        if quoted:
            quoted = end < n and m is not None
            end = m.start() if quoted else -1
        if not quoted:
            end = page.find(">", first)
        tag = page[at + closing : first].lower()
        if end < 0:
            yield start, n, "", False, ""
            return
        yield start, end + 1, tag, closing, page[first:end]
        at = end + 1
        if tag in RAW and not closing:
            m = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            at = m.start() if m else n
            if at > end + 1:
                yield end + 1, at, "", False, ""


def _aside(tag: str, tokens: tuple[str, ...], roles: tuple[str, ...], inside: bool) -> bool:
    if tag in ASIDE_TAGS or tag == "header" and not inside:
        return True
    if not tokens or tag in RUNNING:
        return False
    if tag in ("article", "main"):
        return any(t in ("comment", "comments") for t in tokens)
    if inside:
        return any(t in ASIDE_NAMES and (t not in AMBIGUOUS or t in roles or tag in LISTS) for t in tokens)
    if tag == "p":
        return any(t in ASIDE_NAMES - AMBIGUOUS for t in tokens)
    return any(t in ASIDE_NAMES and (t not in WEAK or t in roles or tag in LISTS) or _says_aside(_WORDS.findall(t)) for t in tokens)


def _says_aside(words: list[str]) -> bool:
    if not words or OWN_WORDS.intersection(words) - {"content"}:
        return False
    if words[-1] == "header" and words[0] in ("site", "page", "top", "global"):
        return True
    return (words[0] in ASIDE_WORDS or words[-1] in ASIDE_WORDS) and all(w in STRUCTURE or w in ASIDE_NAMES for w in words)


def read_shape(text: str) -> tuple:
    stack: list[list] = [[]]
    for token in re.findall(r"[^() ]+|[()]", text):
        if token == "(":
            stack.append([])
        elif token == ")":
            kids = tuple(stack.pop())
            stack[-1][-1] = (stack[-1][-1][0], kids)
        else:
            stack[-1].append((token, ()))
    return stack[0][0]


@lru_cache(20_000)
def _size(s: tuple) -> int:
    return 1 + sum(map(_size, s[1]))


@lru_cache(20_000)
def _matched(a: tuple, b: tuple) -> tuple[int, tuple[tuple[int, int], ...]]:
    """Simple tree matching: most pairs of nodes with like labels that keep order and descent. -> (count, pairs of places).

    Trees are _DEEPEST deep at most. Child lists of any length get the best of all ways.
    """
    if a[0] != b[0]:
        return 0, ()
    if a == b:
        return _size(a), tuple((i, i) for i in range(_size(a)))
    places_a, places_b = [1], [1]
    for kids, places in ((a[1], places_a), (b[1], places_b)):
        for kid in kids:
            places.append(places[-1] + _size(kid))
    pairs, total = [(0, 0)], 1
    for i, j in _best_pairs(a[1], b[1]):
        count, below = _matched(a[1][i], b[1][j])
        total += count
        pairs += [(x + places_a[i], y + places_b[j]) for x, y in below]
    return total, tuple(pairs)


def _best_pairs(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Pairs of children in order with the greatest sum of matches, last first; ties: the last pair is as far in front as can be, and so on."""
    if not a or not b:
        return []
    kinds_a, kinds_b = ({kid: k for k, kid in enumerate(dict.fromkeys(kids))} for kids in (a, b))
    named: dict[str, list[tuple]] = {}
    for y in kinds_b:
        named.setdefault(y[0], []).append(y)
    weights = np.zeros((len(kinds_a), len(kinds_b)), np.int32)
    for x, k in kinds_a.items():
        for y in named.get(x[0], ()):
            weights[k, kinds_b[y]] = _matched(x, y)[0] if x[1] and y[1] else 1
    of_a, of_b = [kinds_a[x] for x in a], np.array([kinds_b[y] for y in b])
    m, n = len(a), len(b)

    def rows(row: np.ndarray, start: int, end: int) -> Iterator[np.ndarray]:
        """The best sums with the first start + 1, ... end children of a, by those of b."""
        for i in range(start, end):
            best = row.copy()
            np.maximum(best[1:], row[:-1] + weights[of_a[i]][of_b], out=best[1:])
            row = np.maximum.accumulate(best)
            yield row

    step = m if m * n <= _MOST_CELLS else math.isqrt(m) + 1
    kept = [np.zeros(n + 1, np.int32)]
    for i, row in enumerate(rows(kept[0], 0, m - 1 - (m - 1) % step), 1):
        if i % step == 0:
            kept.append(row)
    met, j = [], n
    for block in range(len(kept) - 1, -1, -1):
        start = block * step
        best = [kept[block], *rows(kept[block], start, min(start + step, m))]
        i = len(best) - 1
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                met.append((start + i, j))
    return met


def _paths(s: tuple, above: str = "") -> list[str]:
    own = f"{above}/{s[0]}"
    return [own, *(p for kid in s[1] for p in _paths(kid, own))]


def align(page_shape: str, host_shape: str) -> list[str]:
    """The slot of each place of a page's shape: the place of the host's tree it matches, or else its own path."""
    page, host = read_shape(page_shape), read_shape(host_shape)
    partner = dict(_matched(page, host)[1])
    return [str(partner[i]) if i in partner else p for i, p in enumerate(_paths(page))]


def extract(page: str | None, template: Iterable[tuple[int, int, bool]] = ()) -> str:
    """The text of a page: its blocks that are neither template nor aside; within article or main elements, if there are any.

    template: (place, hash of its text, whether it is so on nearly all pages). A place with another text stays. In article
    or main only texts on nearly all pages go, and only where they are the lesser part.
    """
    return Page(page).text(template) if page else ""


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page, url, html, key in zip(*(c.to_pylist() for c in batch.columns)):
            read = Page(html or "")
            shape, place = read.places()
            found = [(at, text, inside) for at, (text, _, inside, _) in read.texts(place).items()]
            rows.append((page, key, host(url), shape, [{"_at": a, "_text": t, "_in": i} for a, t, i in found]))
        pairs = pa.list_(pa.struct([("_at", pa.int32()), ("_text", pa.int64()), ("_in", pa.bool_())]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pairs)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["_page", "_key", "_host", "_shape", "_texts"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = [[xxhash.xxh64_intdigest(f"{h}\n{slot}") - (1 << 63) for slot in align(a, b)] for h, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int64()))], ["_host", "_shape", "_slots"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page, [(d["_at"], d["_text"], d["_firm"]) for d in drop or ()]) for page, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["_id", "_url", "text"])


def induce(described: DataFrame, least_pages: int = LEAST_PAGES, constant_share: float = CONSTANT_SHARE, firm_share: float = FIRM_SHARE) -> DataFrame:
    """Described pages -> (_page, _host, _drop array<struct<_at, _text, _firm>>): the places of a page whose text is the host's template.

    The host's tree is its commonest shape (ties: the greater). Every shape is aligned with it by simple tree matching, so
    that like places share a slot; a text is template in a slot that has text on at least least_pages different pages, if
    it is there on at least constant_share of all the host's pages (firm_share where it stands in article or main); other
    texts of the slot are not. Copies of a page count once. Only shapes, places and text hashes are shuffled, combined by
    (host, shape, place, text) first, so a host with most pages is spread like any other.
    """
    pages = described.dropDuplicates(["_page", "_host"])
    shapes = pages.groupBy("_host", "_shape").agg(F.count(F.lit(1)).alias("_n"))
    trees = shapes.groupBy("_host").agg(F.max(F.struct("_n", "_shape"))["_shape"].alias("_tree"))
    of = shapes.groupBy("_host").agg(F.sum("_n").alias("_of"))
    slots = shapes.join(trees, "_host").select("_host", "_shape", "_tree").mapInArrow(_aligned, "_host string, _shape string, _slots array<bigint>")
    like = F.xxhash64("_host", "_shape").alias("_like")
    slots = checkpointed(slots.join(of, "_host").select(like, "_slots", "_of"))
    texts = pages.select("_page", "_host", like, F.explode("_texts").alias("_t")).select("_page", "_host", "_like", "_t.*")
    held = texts.groupBy("_like", "_at", "_text", "_in").agg(F.count(F.lit(1)).alias("_n"))
    placed = held.join(slots, "_like").select(F.get("_slots", F.col("_at")).alias("_slot"), "_like", "_at", "_text", "_in", "_n", "_of")
    known = placed.groupBy("_slot").agg(F.sum("_n").alias("_pages")).filter(F.col("_pages") >= least_pages).select("_slot")
    shared = placed.groupBy("_slot", "_text", "_in").agg(F.sum("_n").alias("_held"), F.max("_of").alias("_of"))
    shared = shared.filter(F.col("_held") >= F.when(F.col("_in"), firm_share).otherwise(constant_share) * F.col("_of"))
    template = checkpointed(shared.join(known, "_slot").select("_slot", "_text", "_in"))
    drops = placed.join(template, ["_slot", "_text", "_in"]).select("_like", "_at", "_text", F.col("_in").alias("_firm"))
    by_shape = drops.groupBy("_like").agg(F.sort_array(F.collect_set(F.struct("_at", "_text", "_firm"))).alias("_drop"))
    return pages.select("_page", "_host", like).join(by_shape, "_like").select("_page", "_host", "_drop")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, constant_share: float = CONSTANT_SHARE, firm_share: float = FIRM_SHARE) -> DataFrame:
    """-> (id_col, url_col, text), one row per input row.

    Pages of a host are aligned (see induce): constant texts are template and go, all else is content, unless its element
    says that it is a menu, header, footer, form, script and the like, or a name that a varying slot is an advert, notice,
    sidebar, sharing or comments. If a page has article or main elements, only what is in them counts, unless they are cards
    beside a longer text (see Page._weigh); there a constant
    text goes only if it is on nearly all of the host's pages and such texts are the lesser part of the article. Blocks are
    joined by \\n in page order, white space in them is one space, character references are decoded. Null and empty pages
    give an empty text; pages without a host are one host. Cut-off tags and pages and any depth of nesting are read in
    time linear in the page. Repeated rows come out alike. Other columns are ignored; an empty table gives an empty result.
    """
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    keyed = base.withColumn("_key", F.xxhash64("_html", "_url"))
    texts = "array<struct<_at: int, _text: bigint, _in: boolean>>"
    described = checkpointed(keyed.select(F.xxhash64("_html").alias("_page"), "_url", "_html", "_key").mapInArrow(_describe, f"_page long, _key long, _host string, _shape string, _texts {texts}"))
    template = induce(described.drop("_key"), least_pages, constant_share, firm_share)
    drops = described.select("_key", "_page", "_host").join(template, ["_page", "_host"]).select("_key", "_drop").dropDuplicates(["_key"])
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    met = keyed.join(drops, "_key", "left").select("_id", "_url", "_html", "_drop")
    out = met.mapInArrow(_cut, f"_id {kinds['_id']}, _url {kinds['_url']}, text string")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})


def op8_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
