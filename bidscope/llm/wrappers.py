"""Main text of HTML pages by wrappers inferred per host as union-free regular expressions.

A page becomes a nested stream of block tags and text slots. Aligning the streams of a host, mismatches
become optional groups, runs of equal siblings become repeated groups, and differing texts become slots;
nothing ever becomes a choice, so an expression stays as small as the host's structure. The slots of the
finished wrapper are then judged once, and every page is read through its host's wrapper.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from bidscope.session import stage

# HTML's elements by kind, and the words by which pages name what surrounds an article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = set("script style noscript template iframe svg math object canvas audio video textarea title".split())
BLOCK = set(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary header footer nav aside form fieldset menu dialog hr center "
    "select option button".split()
)
CLOSED_BY = {
    "p": BLOCK - {"html", "head", "body"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"},
    "head": {"body"},
}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
AROUND_TAGS = set("nav header footer aside form menu dialog select option button".split())
AROUND_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription paywall comment comments disqus reply replies "
    "discussion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar share sharing social "
    "related recommended recommendations widget login signup toolbar pagination pager search complementary contentinfo dialog".split()
)

MAX_LINK_SHARE = 0.5  # of a slot's characters, where a page names no main region
SAME_PAGES = 3  # pages that differ in the rest and hold the same text in a slot: it is no running text there
MAX_PERIOD = 4  # tags in a repeated group
MAX_DEPTH = 80  # nesting of a page's tree; texts of deeper blocks stand beside each other there
ALIGNED = 400  # siblings that are aligned at a time
MAX_BROADCAST_BYTES = 8 << 20
FLUSH_HOSTS = 2_000  # hosts whose partial wrappers a task holds
SALTS = 32

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.DOTALL
)
_DIGITS = re.compile(r"\d+")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


def _label(tag: str, attributes: str) -> str:
    """Tag with the words of its class, id and role; numbers are left out, so that copies are equal."""
    if not attributes:
        return tag
    values = " ".join(a or b or c for _, a, b, c in _NAMED.findall(attributes)).lower()
    names = sorted(set(re.findall(r"[^\W\d_]+", values)))
    return ".".join([tag, *names])


def parse(html: str | None) -> list:
    """The page as nested ``[label, children]``; a text slot is ``["#", text, characters inside links]``.

    Missing and stray end tags, comments, character references and unfinished pages are taken as
    browsers take them, in one pass with a stack. A text nested deeper than ``MAX_DEPTH`` blocks becomes a
    child of the block at that depth, labelled by the outermost of its deeper blocks that tells a main region
    or what stands around it, else by its own; texts keep their order and none is lost.
    """
    source = html or ""
    root: list = ["", []]
    open_nodes, tags = [root], [""]
    telling = [""]  # of the blocks below MAX_DEPTH
    text: list[str] = []
    in_link, link_chars, at = 0, 0, 0

    def end_slot() -> None:
        nonlocal link_chars
        words = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        slot = ["#", words, link_chars]
        if words and len(open_nodes) > MAX_DEPTH:
            open_nodes[MAX_DEPTH - 1][1].append([telling[-1] or open_nodes[-1][0], [slot]])
        elif words:
            open_nodes[-1][1].append(slot)
        link_chars = 0

    def close(depth: int) -> None:
        end_slot()
        del open_nodes[depth:], tags[depth:], telling[depth:]

    while at < len(source):
        found = _TOKEN.search(source, at)
        stop = found.start() if found else len(source)
        if stop > at:
            text.append(source[at:stop])
            link_chars += (stop - at) if in_link else 0
        if not found:
            break
        at, tag = found.end(), (found.group(2) or "").lower()
        if not tag:
            continue
        if found.group(1):
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag == tags[-1]:
                close(len(tags) - 1)
            elif tag in tags:
                close(next(i for i in range(len(tags) - 1, -1, -1) if tags[i] == tag))
            continue
        if tag in UNREAD:
            if not found.group(3).endswith("/"):
                finish = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                at = finish.end() if finish else len(source)
            continue
        if tag == "a":
            in_link = 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK:
            if tags[-1] in CLOSED_BY and tag in CLOSED_BY[tags[-1]]:
                close(len(tags) - 1)
            end_slot()
            node = [_label(tag, found.group(3)), []]
            deep = len(open_nodes) >= MAX_DEPTH
            if not deep:
                open_nodes[-1][1].append(node)
            if tag not in VOID:
                own = node[0] if deep and (_is_main(node[0]) or _is_around(node[0])) else ""
                open_nodes.append(node)
                tags.append(tag)
                telling.append(telling[-1] or own)
    end_slot()
    return root


# --- wrappers: [label, quantifier, children], or ["#", quantifier, rests, characters, link characters, hash or None]
#
# Rests are the smallest SAME_PAGES digests of what else the pages say: copies of a page count as one.


def _digest(text: str) -> int:
    """Of a text without its numbers, so that counters and dates make no other page."""
    return int.from_bytes(hashlib.blake2b(_DIGITS.sub("", text).encode("utf-8", "replace"), digest_size=8).digest(), "big")


def _running(tree: list) -> int:
    """Sum of the digests of a page's texts, but for those around it and those that are mostly links."""
    if tree[0] == "#":
        return _digest(tree[1]) if tree[2] <= MAX_LINK_SHARE * len(tree[1]) else 0
    return sum(_running(x) for x in tree[1] if x[0] == "#" or not _is_around(x[0]))


def _slot(text: str, link_chars: int, rest: int) -> list:
    return ["#", "", [rest], len(text), min(link_chars, len(text)), zlib.crc32(text.encode("utf-8", "replace"))]


def _widen(a: str, b: str) -> str:
    """Quantifier that allows what either of two allows."""
    optional, many = "?" in a + b or "*" in a + b, "+" in a + b or "*" in a + b
    return "*" if optional and many else "?" if optional else "+" if many else ""


def _merge(a: list, b: list) -> list:
    """One node for two of equal label."""
    if a[0] == "#":
        same = a[5] if a[5] == b[5] else None
        rests = [] if same is None else a[2] if a[2] == b[2] else sorted({*a[2], *b[2]})[:SAME_PAGES]
        return ["#", _widen(a[1], b[1]), rests, a[3] + b[3], a[4] + b[4], same]
    return [a[0], _widen(a[1], b[1]), _align(a[2], b[2])]


def _collapse(nodes: list) -> list:
    """Runs of equal groups of siblings become one repeated group."""
    for period in range(1, MAX_PERIOD + 1):
        out: list = []
        i = 0
        while i < len(nodes):
            group, j = nodes[i : i + period], i + period
            names = [x[0] for x in group]
            while len(group) == period and [x[0] for x in nodes[j : j + period]] == names:
                group = [_merge(x, y) for x, y in zip(group, nodes[j : j + period])]
                j += period
            if j > i + period:
                many = [[x[0], _widen(x[1], "+"), *x[2:]] for x in group]
                out += many if period == 1 else [["()", "+", group]]
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _align(a: list, b: list) -> list:
    """The longest common order of two lists of siblings, so many at a time that it takes bounded memory and time
    in proportion to their number; what only one of them has becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [_merge(x, y) for x, y in zip(a, b)]
    out: list = []
    for at in range(0, max(len(a), len(b)), ALIGNED):
        out += _common_order(a[at : at + ALIGNED], b[at : at + ALIGNED])
    return _collapse(out)


def _common_order(a: list, b: list) -> list:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i][0] == b[j][0] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        if j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            x, i = a[i], i + 1
        else:
            x, j = b[j], j + 1
        out.append([x[0], _widen(x[1], "?"), *x[2:]])
    return out


def wrapper_of(tree: list) -> list:
    """The wrapper of a single page."""
    total = _running(tree)

    def of(node: list, around: bool) -> list:
        if node[0] == "#":
            own = _running(node) if not around else 0
            return _slot(node[1], node[2], (total - own) % 2**64)
        return [node[0], "", _collapse([of(x, around or (x[0] != "#" and _is_around(x[0]))) for x in node[1]])]

    return of(tree, False)


def merge_wrappers(a: list | None, b: list) -> list:
    return b if a is None else _merge(a, b)


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression, for reading."""
    if wrapper[0] == "#":
        return "#" + wrapper[1]
    inner = "".join(map(expression, wrapper[2]))
    return f"({inner}){wrapper[1]}" if wrapper[0] == "()" else f"(<{wrapper[0]}>{inner}</>){wrapper[1]}"


# --- judging slots


def _is_main(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in ("article", "main") or ("main" in names and tag in ("div", "section"))


@lru_cache(maxsize=1 << 16)
def _is_around(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in AROUND_TAGS or (tag not in ("html", "body", "article", "main") and not AROUND_WORDS.isdisjoint(names))


def _holds_main(node: list) -> bool:
    return node[0] != "#" and (_is_main(node[0]) or any(map(_holds_main, node[2])))


def judge(wrapper: list) -> dict[str, int]:
    """Per slot, by the labels above it: 2 in the main region, 1 other running text, 0 what stands around it, and
    -1 what the host repeats, where no page names a main region.

    A container named like a menu or notice is not one if it holds the main region. Slots that are the
    same on three pages or more that differ in the rest, or mostly links, are no running text; inside the main region only the
    containers' names count.
    """
    slots: dict[str, int] = {}
    order = (0, -1, 1, 2).index

    def walk(node: list, path: str, main: bool, around: bool) -> None:
        if node[0] == "#":
            _, _, rests, chars, links, same = node
            plain = 0 if links > MAX_LINK_SHARE * chars else -1 if same is not None and len(rests) >= SAME_PAGES else 1
            slots[path] = max(slots.get(path, 0), 0 if around else 2 if main else plain, key=order)
            return
        label = node[0]
        if label != "()":
            path = f"{path}/{label}"
            if _is_main(label) and not around:
                main = True
            elif _is_around(label) and not _holds_main(node):
                around = True
            elif label.split(".")[0] in HEADINGS and main and around:
                around = not path.split("/")[-2].startswith("header")  # an article's own heading
        for child in node[2]:
            walk(child, path, main, around)

    articles = [x for x in _labels(wrapper) if x.split(".")[0] == "article"]
    walk(wrapper, "", False, False)
    if 2 in slots.values():
        slots = {path: max(kind, 0) for path, kind in slots.items()}
    if articles:  # where a host has articles, what stands beside them in its main element is no article
        for path, kind in slots.items():
            if kind == 2 and not any(x.split(".")[0] == "article" for x in path.split("/")):
                slots[path] = 1
    return slots


def _labels(node: list) -> Iterator[str]:
    if node[0] != "#":
        yield node[0]
        for child in node[2]:
            yield from _labels(child)


def extract(html: str | None, slots: dict[str, int]) -> str:
    """The texts of a page's main slots, or of its running-text slots if it has no main region; what its host
    repeats is left out, unless the page has nothing else."""
    found: list[tuple[int, str]] = []

    def walk(node: list, path: str) -> None:
        for child in node[1]:
            if child[0] == "#":
                found.append((slots.get(path, 1), child[1]))
            else:
                walk(child, f"{path}/{child[0]}")

    tree = parse(html)
    walk(tree, "/" + tree[0])
    kinds = {kind for kind, _ in found}
    wanted = next((kind for kind in (2, 1) if kind in kinds), -1)
    return "\n".join(text for kind, text in found if kind == wanted)


@lru_cache(maxsize=4096)
def _slots(judged: str | None) -> dict[str, int]:
    return json.loads(judged) if judged else {}


# --- jobs


def _host() -> F.Column:
    return F.lower(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` from all pages: partial wrappers per task, merged in two steps.

    However many pages a host has, a task sends one partial wrapper for it, and these meet in groups of
    (host, salt) before they meet by host.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        held: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(host, salt, json.dumps(w)) for host, w in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([salt] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.string())],
                names=["host", "salt", "wrapper"],
            )

        for batch in batches:
            for host, page in zip(batch["host"], batch["html"]):
                key = host.as_py()
                held[key] = merge_wrappers(held.get(key), wrapper_of(parse(page.as_py())))
            if len(held) >= FLUSH_HOSTS:
                yield flush()
        if held:
            yield flush()

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in sorted(rows["wrapper"]):
            whole = merge_wrappers(whole, json.loads(text))
        return rows.head(1).assign(wrapper=json.dumps(whole))

    kind = "host string, salt int, wrapper string"
    parts = pages.select(_host().alias("host"), "html").mapInArrow(partial, kind)
    parts = parts.groupBy("host", "salt").applyInPandas(merged, kind)
    return parts.groupBy("host").applyInPandas(merged, kind).drop("salt")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null or empty html gives an empty text; pages without a url share one wrapper. Repeated rows give
    repeated results, other columns are left out, an empty table an empty result. Wrappers go to the
    pages by broadcast while all of them together are small, else by a join on the host, whose large
    groups the engine splits.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [json.dumps(judge(json.loads(x.as_py()))) for x in batch["wrapper"]]
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(slots, pa.string())], names=["host", "slots"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), _slots(slots.as_py())) for page, slots in zip(batch["html"], batch["slots"])]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    pages = pages.select("page_id", "url", "html")
    slots = stage(infer_wrappers(pages).mapInArrow(judged, "host string, slots string"), "wrappers")
    size = slots.agg(F.sum(F.length("host") + F.length("slots"))).first()[0] or 0
    beside = F.broadcast(slots) if size <= MAX_BROADCAST_BYTES else slots
    joined = pages.withColumn("host", _host()).join(beside, "host", "left").select("page_id", "url", "html", "slots")
    return joined.mapInArrow(read, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
