"""Main text of web pages by wrappers: one union-free regular expression over tags for each host.

A page becomes a tree of block elements with text slots. Siblings that follow each other with the same label, or runs of up to
PERIOD labels that repeat, become one repeated group. Two trees of a host are aligned child by child (longest common
subsequence of labels): what both have is aligned further down, what only one has becomes optional, and a text that
differs becomes an open slot, while one that is the same on every page so far stays fixed. Aligning all pages of a host gives its
wrapper: pages are dealt by hash into PARTS parts of a host and aligned in the order of their hashes, then the parts' wrappers in
order, so the result is the same however the table is laid out, and no task holds more than one wrapper and a batch of trees. The wrapper decides which slots are the article: those below its article or
main element, or else those of the element with most open text, never those of menus, headers, footers, sidebars,
notices, adverts, forms or comments. A page's text is what its tokens put into these slots. A page that puts nothing into
them is of another template of its host: its own article, main or marked element is its article, or else the element with
most of its text, without text that the wrapper has on every page.

A null or empty page has no text. A url without host is of the host "". Pages that repeat count once and alike, every
row gives one row; other columns are ignored. Unclosed, stray and truncated tags are repaired as browsers do; elements nested
deeper than DEPTH count as parts of the one at that depth, their text included.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from salesflow.session import materialize

PERIOD = 4
DEPTH = 200  # block elements around a text
PARTS = 64  # of a host
CELLS, BAND = 250_000, 64  # children are aligned in full up to so many pairs, beyond that within a band
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|noscript|svg|iframe|select|button)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                     "menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body table ul ol dl div section article aside nav main form".split())
OUT_TAGS = frozenset("nav footer aside form menu dialog head title".split())
OUT_WORDS = re.compile(r"(?:^|[^a-z])(?:nav\w*|menu\w*|footer|sidebar|side|aside|ads?|adv\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|"
                       r"notification|alert|popup|modal|newsletter|subscri\w*|share|sharing|social|comments?|comment\w*|repl(?:y|ies)|respond|discuss\w*|"
                       r"related|recommend\w*|breadcrumbs?|pagination|pager|login|signup|search|widget|masthead|disclaimer|complementary|contentinfo|navigation)(?:[^a-z]|$)")
STATE = re.compile(r"(?:has|with|without|no|is|show|hide)[-_]", re.I)  # class names that tell of a page, not of an element
MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:article|articlebody|post|entry|story|main|content)(?:[^a-z]|$)")


def parsed(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """Blocks of a page in order: path of labels of the block elements around it, text, and characters inside links."""
    out, stack, labels, buffer, links = [], [], [], [], 0
    in_link = 0

    def flush():
        nonlocal links
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            out.append((tuple(labels[:DEPTH]), text, min(links, len(text))))
        buffer.clear()
        links = 0

    def close(upto: int):
        nonlocal in_link
        blocks = sum(bool(x[1]) for x in stack[upto:])
        if blocks:
            flush()
            del labels[-blocks:]
        in_link -= sum(x[0] == "a" for x in stack[upto:])
        del stack[upto:]

    def find(names, stop) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stop:
                break
        return -1

    page, at = page or "", 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            buffer.append(page[at:token.start()])
            links += (token.start() - at) * bool(in_link)
        at = token.end()
        name = (token[3] or "").lower()
        if not name:
            continue
        if token[2]:
            i = find((name,), () if name in SCOPE else SCOPE) if name != "p" else find((name,), SCOPE)
            if i >= 0:
                close(i)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                buffer.append(" ")
                if name == "hr":
                    flush()
            continue
        if name in CLOSES_P and (i := find(("p",), SCOPE)) >= 0:
            close(i)
        if name in SAME and (i := find(SAME[name], ("ul", "ol", "dl", "table"))) >= 0:
            close(i)
        if name in INLINE:
            in_link += name == "a"
            stack.append((name, ""))
            continue
        flush()
        marks = [re.sub(r"\d+", "", w.lower()) for m in NAMED.finditer(token[4]) for w in (m[2] or m[3] or m[4] or "").split()
                 if not STATE.match(w)] if "=" in token[4] else []
        if not token[4].rstrip().endswith("/"):
            labels.append(".".join([name, *sorted(set(marks))]))
            stack.append((name, labels[-1]))
    buffer.append(page[at:].partition("<")[0] if page[at:].startswith("<") else page[at:])
    flush()
    return out


# A node is [label, quantifier, children]; a text slot is ["#", quantifier, [fixed hash or None, characters, characters in links]].

def optional(node: list) -> list:
    return [node[0], {"1": "?", "+": "*"}.get(node[1], node[1]), node[2]]


def merged(a: list, b: list) -> list:
    """The alignment of two nodes of one label."""
    quantifier = a[1] if a[1] == b[1] else "*" if {a[1], b[1]} & {"*"} or {a[1], b[1]} == {"?", "+"} else "+" if "+" in (a[1], b[1]) else "?"
    if a[0] == "#":
        return ["#", quantifier, [a[2][0] if a[2][0] == b[2][0] else None, a[2][1] + b[2][1], a[2][2] + b[2][2]]]
    return [a[0], quantifier, aligned(a[2], b[2])]


def aligned(a: list, b: list) -> list:
    """Children of two nodes in one list; those that only one node has are optional."""
    first = 0
    while first < min(len(a), len(b)) and a[first][0] == b[first][0]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last][0] == b[-1 - last][0]:
        last += 1
    head = [merged(x, y) for x, y in zip(a[:first], b)]
    tail = [merged(x, y) for x, y in zip(a[len(a) - last:], b[len(b) - last:])]
    if first + last == len(a) == len(b):
        return head + tail
    x, y = a[first:len(a) - last], b[first:len(b) - last]
    return folded(head + (between if len(x) * len(y) <= CELLS else in_band)(x, y) + tail)


def between(a: list, b: list) -> list:
    """Alignment by a longest common subsequence of labels."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return out


def in_band(a: list, b: list) -> list:
    """Alignment of very many children: each with the next one of its label that is at most BAND places ahead."""
    out, j = [], 0
    for node in a:
        at = next((k for k in range(j, min(j + BAND, len(b))) if b[k][0] == node[0]), None)
        if at is None:
            out.append(optional(node))
            continue
        out += [optional(x) for x in b[j:at]] + [merged(node, b[at])]
        j = at + 1
    return out + [optional(x) for x in b[j:]]


def folded(children: list) -> list:
    """Runs of one to PERIOD labels that follow each other twice or more, as one repeated group of aligned nodes."""
    for period in range(1, PERIOD + 1):
        out, i = [], 0
        while i < len(children):
            unit = [x[0] for x in children[i:i + period]]
            group, j = children[i:i + period], i + period
            while len(unit) == period and [x[0] for x in children[j:j + period]] == unit:
                group = [merged(x, y) for x, y in zip(group, children[j:j + period])]
                j += period
            if j > i + period:
                out += [[x[0], "*" if x[1] in "?*" else "+", x[2]] for x in group]
                i = j
            else:
                out.append(children[i])
                i += 1
        children = out
    return children


def tree_of(blocks: list[tuple[tuple[str, ...], str, int]]) -> list:
    """The folded tree of one page."""
    root = ["", "1", []]
    open_nodes = [root]
    for path, text, links in blocks:
        shared = 0
        while shared < len(path) and shared + 1 < len(open_nodes) and open_nodes[shared + 1][0] == path[shared]:
            shared += 1
        if shared == len(path) and path and open_nodes[-1][0] == path[-1] and len(open_nodes) == len(path) + 1 and open_nodes[-1][2] and path[-1].split(".")[0] in ("p", "li", "h1", "h2", "h3", "td"):
            shared -= 1  # a sibling of the same label, not more text of one element
        del open_nodes[shared + 1:]
        for label in path[shared:]:
            node = [label, "1", []]
            open_nodes[-1][2].append(node)
            open_nodes.append(node)
        open_nodes[-1][2].append(["#", "1", [zlib.crc32(text.encode()), len(text), links]])

    def fold(node: list) -> list:
        return node if node[0] == "#" else [node[0], node[1], folded([fold(x) for x in node[2]])]

    return fold(root)


def left_out(label: str, in_main: bool) -> bool:
    tag, _, marks = label.partition(".")
    if tag in ("html", "body", "main", "article"):
        return in_main and tag != "main" and bool(OUT_WORDS.search(marks))  # a reader's comment may be an article inside one
    return tag in OUT_TAGS or (tag == "header" and not in_main) or bool(marks and OUT_WORDS.search(marks))


def volume(node: list, in_main: bool = False) -> tuple[int, int]:
    """Open characters below a node outside of what is left out, and those inside links."""
    if node[0] == "#":
        return (node[2][1], node[2][2]) if node[2][0] is None or in_main else (0, 0)
    if left_out(node[0], in_main):
        return 0, 0
    parts = [volume(x, in_main) for x in node[2]]
    return sum(p[0] for p in parts), sum(p[1] for p in parts)


def article_slots(wrapper: list, least: int = 0) -> list[str]:
    """Paths of the slots that hold the article. An element without marks needs ``least`` open characters at least."""
    roots = {"article": [], "main": [], "marked": [], "open": []}

    def look(node: list, path: tuple[str, ...]):
        if node[0] == "#" or left_out(node[0], False):
            return
        tag, _, marks = node[0].partition(".")
        text, links = volume(node, True)
        if text and tag in ("article", "main"):
            roots[tag].append((text, path, node))
            if tag == "article":
                return
        elif text and marks and MAIN_WORDS.search(marks) and tag != "body":
            roots["marked"].append((text, path, node))
        if node[0] and tag not in ("html",):
            own = sum(max(0, volume(x)[0] - 2 * volume(x)[1]) for x in node[2] if x[0] == "#" or x[0].split(".")[0] in ("p", "h1", "h2", "h3", "ul", "ol", "pre", "blockquote"))
            if own >= least:
                roots["open"].append((own, path, node))
        for x in node[2]:
            look(x, (*path, x[0]))

    look(wrapper, ())
    kind = next((k for k in ("article", "main", "marked", "open") if roots[k]), None)
    if not kind:
        return []
    chosen = roots[kind] if kind == "article" else [max(roots[kind], key=lambda r: r[0])]
    out = set()

    def take(node: list, path: tuple[str, ...]):
        for x in node[2]:
            if x[0] == "#":
                out.add("/".join(path))
            elif not left_out(x[0], True):
                take(x, (*path, x[0]))

    for _, path, node in chosen:
        take(node, path)
    return sorted(out)


def fixed_slots(wrapper: list) -> list[str]:
    """Paths of the slots that every page has with the same text."""
    fixed, other = set(), set()

    def look(node: list, path: tuple[str, ...], always: bool):
        for x in node[2]:
            on_all = always and x[1] in "1+"
            if x[0] == "#":
                (fixed if on_all and x[2][0] is not None else other).add("/".join(path))
            else:
                look(x, (*path, x[0]), on_all)

    look(wrapper, (), True)
    return sorted(fixed - other)


def article_texts(blocks: list[tuple[tuple[str, ...], str, int]], slots: frozenset[str], fixed: frozenset[str]) -> list[str]:
    """Texts of a page in the article's slots of its host, or in those of the page itself if it has none of them."""
    out = [t for path, t, _ in blocks if "/".join(path) in slots]
    if out or all("/".join(path) in fixed for path, _, _ in blocks):
        return out

    def opened(node: list, path: tuple[str, ...] = ()) -> list:
        if node[0] == "#":
            return node if "/".join(path) in fixed else ["#", node[1], [None, *node[2][1:]]]
        return [node[0], node[1], [opened(x, path if x[0] == "#" else (*path, x[0])) for x in node[2]]]

    own = frozenset(article_slots(opened(tree_of(blocks)), 1))
    found = [(path, t) for path, t, _ in blocks if "/".join(path) in own]
    return [t for _, t in found] if any("/".join(path) not in fixed for path, _ in found) else []


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, slots, fixed): the article's slots of each host and those alike on all its pages, from pages (host, html)."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([json.dumps(tree_of(parsed(page.as_py()))) for page in batch.column(1)], pa.string())], ["host", "tree"])

    def aligned_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = whole = None
        for batch in batches:
            for host, part, tree in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (host, part) == key:
                    whole = merged(whole, json.loads(tree))
                    continue
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([json.dumps(whole)])], names)
                key, whole = (host, part), json.loads(tree)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([json.dumps(whole)])], names)

    def across(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for tree in group.sort_values("part")["tree"]:
            whole = json.loads(tree) if whole is None else merged(whole, json.loads(tree))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "slots": [article_slots(whole)], "fixed": [fixed_slots(whole)]})

    names = ["host", "part", "tree"]
    rows = pages.select("host", "html").mapInArrow(trees, "host string, tree string").withColumn("h", F.xxhash64("tree")).distinct()
    dealt = rows.withColumn("part", F.pmod("h", F.lit(PARTS))).repartition("host", "part").sortWithinPartitions("host", "part", "h", "tree")
    parts = dealt.select("host", "part", "tree").mapInArrow(aligned_trees, "host string, part bigint, tree string")
    return parts.groupBy("host").applyInPandas(across, "host string, slots array<string>, fixed array<string>")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """key, url, text and n_chars for each row of pages."""
    kind = pages.schema[key].dataType.simpleString()
    held = pages.select(pages[key].alias("k"), pages[url].cast("string").alias("url"), pages[body].cast("string").alias("html"),
                        F.lower(F.coalesce(F.regexp_extract(pages[url].cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))).alias("host"))
    known = materialize(wrappers(held.select("host", "html")), "wrappers")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, slots, fixed in zip(batch.column(2), batch.column(3), batch.column(4)):
                out.append("\n".join(article_texts(parsed(page.as_py()), frozenset(slots.as_py() or ()), frozenset(fixed.as_py() or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                             ["k", "url", "text", "n_chars"])

    return held.join(known, "host", "left").select("k", "url", "html", "slots", "fixed").mapInArrow(
        texts, f"k {kind}, url string, text string, n_chars bigint").withColumnRenamed("k", key)
