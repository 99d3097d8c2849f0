"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of tokens: opening and closing tags, named by tag and class, and texts. Tandem
repeats fold into repeated groups. A host's wrapper starts as its first stream; every further stream
is aligned with it, what only one of both has becomes optional, groups that now follow themselves fold
into a repeat, and a text that differs becomes a slot. Streams of the same shape are counted together
first, so a task aligns shapes, not pages, and a host of any size sends one wrapper per task and
portion. Wrappers of a host are aligned with one another in the same way.

From the wrapper follows the host's content element: the article or main element if it has one, else
the innermost element that holds most of the slots' text. Text inside it is a page's main text, but
for menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments, which
their tags, roles or class names tell; a page without that element falls back to its own article, main
or body. A text that is the same on all of a host's pages is not a slot, so it never decides where the
content is; it is not dropped from the content.

Inside a block white space becomes one space, and blocks are joined by one space; character references
are decoded once. Defined cases: null or empty html has empty text; unclosed and stray tags close with
what is around them; a page without tags is its text; pages without a host share a wrapper; repeated
rows are pages each.
"""

from __future__ import annotations

import html as references
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.shared import as_bytes, settled

# Names of elements and words of classes that HTML pages use.
HIDDEN = frozenset("script style noscript template iframe svg head title".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
OUTSIDE = frozenset(
    "nav header footer aside form button select option textarea input menu dialog".split()
)
OUTSIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu".split()
)
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu"
    " breadcrumb breadcrumbs header masthead footer sidebar aside related share sharing social comment"
    " comments disqus reply replies cookie cookies consent notice notices alert newsletter subscribe"
    " signup popup modal login search pagination pager widget toolbar".split()
)
#: Closed by the start of one of the same kind.
SIBLINGS = {"p": "p", "li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td"}

#: Distinct shapes of a host that a task holds before it aligns them.
PORTION = 200
LONGEST_GROUP = 12

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, name or text, outside): kinds are open, close and text; names carry the class."""
    at, stack = 0, []

    def closed(upto: int) -> Iterator[tuple[str, str, bool]]:
        while len(stack) > upto:
            yield "close", stack.pop()[1], False

    while True:
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            yield "text", text, False
        if not found:
            break
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if found["close"]:
            places = [k for k, (tag, _) in enumerate(stack) if tag == name]
            if places:
                yield from closed(places[-1])
            elif name == "p" or name == "br":
                yield "open", "br", False
                yield "close", "br", False
            continue
        own = {key.lower(): a or b or c for key, a, b, c in ATTRIBUTE.findall(found["rest"])}
        kind = own.get("class", "").lower().split()
        label = f"{name}.{kind[0]}" if kind else name
        words = set(WORD.findall(" ".join((own.get("class", ""), own.get("id", ""))).lower()))
        outside = (
            name in OUTSIDE
            or name in HIDDEN
            or own.get("role", "").lower() in OUTSIDE_ROLES
            or (name not in ("html", "body", "article", "main") and bool(words & OUTSIDE_WORDS))
        )
        if name in SIBLINGS:
            for k in range(len(stack) - 1, -1, -1):
                tag = stack[k][0]
                if SIBLINGS.get(tag) == SIBLINGS[name]:
                    yield from closed(k)
                    break
                if tag not in INLINE:
                    break
        elif name not in INLINE and stack and stack[-1][0] == "p":
            yield from closed(len(stack) - 1)
        yield "open", label, outside
        if name in VOID or found["rest"].endswith("/"):
            yield "close", label, False
            continue
        if name in RAW:
            end = re.compile(f"</{name}\\b[^>]*>|\\Z", re.I).search(page, at)
            if end.start() > at:
                yield "text", page[at : end.start()], False
            at = end.end()
            yield "close", label, False
            continue
        stack.append((name, label))
    yield from closed(0)


def main_text(page: str, content: str | None) -> str:
    """Text of the ``content`` elements; without any, of article, main or body."""
    parts: dict[str, list[str]] = {"content": [], "article": [], "main": [], "body": []}
    inside = dict.fromkeys(parts, 0)
    hidden, levels = 0, []
    seen = set()
    for kind, name, outside in tokens(page):
        tag = name.partition(".")[0]
        if kind == "text":
            if not hidden:
                for group, level in inside.items():
                    if level or group == "body":
                        parts[group].append(references.unescape(name))
            continue
        step = 1 if kind == "open" else -1
        if kind == "open":
            levels.append(outside)
            hidden += outside
        elif levels:
            hidden -= levels.pop()
        for group in inside:
            if name == content if group == "content" else tag == group:
                inside[group] += step
                if not hidden or kind == "close":
                    seen.add(group)
        if tag not in INLINE and not hidden:
            for group, level in inside.items():
                if level or group == "body" or kind == "close":
                    parts[group].append(" ")
    chosen = next((parts[g] for g in ("content", "article", "main") if g in seen), parts["body"])
    return " ".join("".join(chosen).split())


# A wrapper is a list of items [token, optional, repeated, checksum of a constant text or None for a
# slot, characters].


def stream(page: str) -> list[list]:
    """A page's tokens as a wrapper of itself, what is outside the content left out."""
    items: list[list] = []
    hidden, levels = 0, []
    for kind, name, outside in tokens(page):
        if kind == "open":
            levels.append(outside)
            hidden += outside
            if not hidden and name.partition(".")[0] not in INLINE:
                items.append(["<" + name, False, False, None, 0])
        elif kind == "close":
            if not hidden and name.partition(".")[0] not in INLINE:
                items.append([">" + name, False, False, None, 0])
            if levels:
                hidden -= levels.pop()
        elif not hidden and name.strip():
            text = " ".join(name.split())
            if not items or items[-1][0] != "#":
                items.append(["#", False, False, 0, 0])
            items[-1][3] = zlib.crc32(text.encode(), items[-1][3])
            items[-1][4] += len(text)
    return folded(items)


def joined(one: list, other: list) -> list:
    """One item for two aligned ones."""
    text = one[3] if one[3] == other[3] else None
    return [one[0], one[1] or other[1], one[2] or other[2], text, one[4] + other[4]]


def folded(items: list[list]) -> list[list]:
    """Groups that directly follow themselves, folded into one repeated group."""
    out: list[list] = []
    for item in items:
        out.append(item)
        for size in range(1, min(LONGEST_GROUP, len(out) // 2) + 1):
            if out[-1][0] != out[-1 - size][0]:
                continue
            left, right = out[-2 * size : -size], out[-size:]
            if all(a[0] == b[0] for a, b in zip(left, right, strict=True)):
                both = [joined(a, b) for a, b in zip(left, right, strict=True)]
                for member in both:
                    member[2] = True
                out[-2 * size :] = both
                break
    return out


def aligned(wrapper: list[list], other: list[list]) -> list[list]:
    """The wrapper that also fits ``other``: what only one has is optional."""
    out: list[list] = []
    names, others = [item[0] for item in wrapper], [item[0] for item in other]
    for kind, a, b, c, d in SequenceMatcher(None, names, others, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [joined(x, y) for x, y in zip(wrapper[a:b], other[c:d], strict=True)]
        else:
            for item in (*wrapper[a:b], *other[c:d]):
                out.append([item[0], True, *item[2:]])
    return folded(out)


def content_of(wrapper: list[list]) -> str | None:
    """The name of the element that holds the content."""
    mass: dict[str, int] = {}
    order: list[str] = []
    open_: list[str] = []
    total = 0
    for token, _, _, text, size in wrapper:
        if token == "#":
            if text is None:
                total += size
                for name in set(open_):
                    mass[name] = mass.get(name, 0) + size
        elif token[0] == "<":
            open_.append(token[1:])
            order.append(token[1:])
        elif token[1:] in open_:
            while open_.pop() != token[1:]:
                pass
    for tag in ("article", "main"):
        held = [name for name in mass if name.partition(".")[0] == tag]
        if held:
            return max(held, key=lambda name: (mass[name], name))
    inner = [name for name in order if 2 * mass.get(name, 0) > total and name not in ("p", "html")]
    return inner[-1] if inner and total else None


HOST = "coalesce(try_parse_url(url, 'HOST'), '')"


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the task's hosts from pages (host, html)."""
    shapes: dict[str, dict[tuple, list]] = {}

    def emptied(host: str) -> tuple[str, str]:
        wrapper: list[list] = []
        for items in shapes.pop(host).values():
            wrapper = aligned(wrapper, items) if wrapper else items
        return host, json.dumps(wrapper)

    def batch_of(rows: list[tuple[str, str]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["host", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            items = stream((page or b"").decode("utf-8", "replace"))
            own = shapes.setdefault(host, {})
            shape = tuple(item[0] for item in items)
            held = own.get(shape)
            own[shape] = [joined(a, b) for a, b in zip(held, items, strict=True)] if held else items
            if len(own) >= PORTION:
                yield batch_of([emptied(host)])
        while len(shapes) > 50 * PORTION:
            yield batch_of([emptied(next(iter(shapes)))])
    if shapes:
        yield batch_of([emptied(host) for host in list(shapes)])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of the task, from wrappers (host, wrapper) sorted by host."""
    host, wrapper = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([host], type=pa.string()),
                pa.array([content_of(wrapper)], type=pa.string()),
                pa.array([json.dumps(wrapper)], type=pa.string()),
            ],
            names=["host", "content", "wrapper"],
        )

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != host:
                if host is not None:
                    yield row()
                host, wrapper = name, []
            wrapper = aligned(wrapper, json.loads(text)) if wrapper else json.loads(text)
    if host is not None:
        yield row()


def wrappers(pages: DataFrame) -> DataFrame:
    """Per host of ``pages`` (url, html): its wrapper as JSON and its content element; settled."""
    parts = pages.selectExpr(f"{HOST} as host", "html").mapInArrow(
        _inferred, "host string, wrapper string"
    )
    merged = (
        parts.repartition("host")
        .sortWithinPartitions("host", "wrapper")
        .mapInArrow(_merged, "host string, content string, wrapper string")
    )
    return settled(merged, "wrappers")


EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = batch.column(3).to_pylist()
        texts = [
            main_text((page or b"").decode("utf-8", "replace"), content)
            for page, content in zip(as_bytes(batch.column(2)), contents, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts), pa.array([len(x) for x in texts])],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    contents = wrappers(pages).select("host", "content")
    # The table of hosts is broadcast by Spark if it is small, and shuffled otherwise.
    rows = pages.selectExpr("page_id", "url", "html", f"{HOST} as of").join(
        contents, F.expr("of = host"), "left"
    )
    return rows.select("page_id", "url", "html", "content").mapInArrow(_extracted, EXTRACTED)
