"""Main text of web pages, by templates deduced from the pages of a host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED = frozenset(
    "head title nav header footer aside form button select option textarea label fieldset iframe noscript object svg "
    "canvas template menu dialog audio video map search".split()
)
#: An element that opens closes these that are still open, up to the nearest of the second set.
CLOSES = {
    "p": (frozenset(["p"]), frozenset("td th li dd div section article blockquote body".split())),
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head", "title"]), frozenset(["html"])),
}
ROOTS = frozenset(["html", "body", "article", "main"])
#: Words in class, id or role of elements beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottombar sidebar aside widget "
    "widgets cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "commentlist respond reply replies disqus pagination pager toolbar search complementary contentinfo hidden".split()
)

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|xmp|noembed|noframes)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^<>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


@dataclass
class Block:
    path: str
    text: str
    beside: bool  # in an element that is not part of an article
    inside: bool  # in an article or main element
    linked: int  # code points in links


class _Element:
    __slots__ = ("name", "path", "beside", "inside", "header")

    def __init__(self, name: str, path: str, beside: bool, inside: bool, header: bool):
        self.name, self.path, self.beside, self.inside, self.header = name, path, beside, inside, header


def _names(attributes: str) -> list[str]:
    found = []
    for m in NAMED.finditer(attributes):
        found += [p.lower() for p in PART.findall(m[1] or m[2] or m[3] or "")]
    return found


def parse(page: str) -> tuple[list[str], list[Block]]:
    """The paths of all elements of a page, and its blocks of text, in page order.

    A path has the names and classes from the root. White space in a block is one space, character
    references are decoded; scripts, styles, comments and markup are gone.
    """
    stack = [_Element("", "", False, False, False)]
    paths: list[str] = []
    blocks: list[Block] = []
    parts: list[str] = []
    linked = 0
    done = 0

    def finish() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                top = next(e for e in reversed(stack) if not e.name or e.name in BLOCK)
                blocks.append(Block(top.path, text, stack[-1].beside, stack[-1].inside, linked))
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        if any(e.name in BLOCK or e.beside != stack[at - 1].beside for e in stack[at:]):
            finish()
        del stack[at:]

    for m in MARKUP.finditer(page):
        if m.start() > done:
            new = page[done : m.start()]
            new = html.unescape(new) if "&" in new else new
            parts.append(new)
            if any(e.name == "a" for e in stack[-3:]):
                linked += len(new.strip())
        done = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if at:
                close(at)
            elif name == "p":
                finish()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in CLOSES:
            ends, stop = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in stop:
                    break
                if stack[k].name in ends:
                    close(k)
                    break
        attributes = m[4]
        above = stack[-1]
        names = _names(attributes) if "=" in attributes else []
        beside = above.beside
        header = above.header or (name == "header" and above.inside)
        if name not in ROOTS or above.inside:
            odd = name in SKIPPED or not BESIDE.isdisjoint(names) or (attributes and HIDDEN.search(attributes) is not None)
            beside = beside or (bool(odd) and not header)
        if header and not beside:
            beside = False
        own = name if not names else f"{name}.{'.'.join(names)}"
        inside = above.inside or name in ("article", "main") or "main" in names and name != "a" or "articlebody" in names
        element = _Element(name, f"{above.path}/{own}", beside, inside, header)
        if name in BLOCK or element.beside != above.beside:
            finish()
        if name not in VOID:
            if name in BLOCK:
                paths.append(element.path)
            if not attributes.endswith("/"):
                stack.append(element)
        elif name == "hr":
            finish()
    if done < len(page):
        parts.append(html.unescape(page[done:]))
    finish()
    return paths, blocks


def main_blocks(blocks: list[Block]) -> list[Block]:
    """Blocks that the structure allows: of the article if a page marks one, else of all, without
    those that are mostly links."""
    inside = [b for b in blocks if b.inside and not b.beside]
    if inside:
        return inside
    return [b for b in blocks if not b.beside and 2 * b.linked <= len(b.text)]


def _token(path: str, text: str | None = None) -> int:
    return xxhash.xxh64_intdigest(path if text is None else f"{path}\0{text}") - 2**63


def host_of(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def templates(pages: DataFrame, least: int = 4, share: float = 0.6, flush: int = 200_000) -> DataFrame:
    """(host, tokens): the text tokens of each host's template.

    Tokens are elements, known by their path, and texts, known by their path and words. Tokens with
    one occurrence vector over the host's pages make an equivalence class; the vector is summed up as
    a hash over (page, count), so tokens are reduced in every task before they are shuffled and a host
    may have any number of pages. A class is large and frequent enough if it is on ``least`` pages and on
    ``share`` of the host's, and valid if it nests: a text belongs to the template if it shares the class
    of the element around it, that is if the element never comes without it or with other text.
    ``pages`` has host, page (a hash of the row) and html.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}

        def rows() -> pa.RecordBatch:
            keys, sums = list(held), list(held.values())
            out = pa.RecordBatch.from_pydict(
                {
                    "host": pa.array([k[0] for k in keys], pa.string()),
                    "around": pa.array([k[1] for k in keys], pa.int64()),
                    "token": pa.array([k[2] for k in keys], pa.int64()),
                    "vector": pa.array([s[0] for s in sums], pa.int64()),
                    "support": pa.array([s[1] for s in sums], pa.int64()),
                }
            )
            held.clear()
            return out

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("host", "page", "html"))
            for host, page, text in zip(*columns, strict=True):
                paths, blocks = parse(text or "")
                counts: dict[tuple, int] = {(host, 0, 0): 1}  # the page itself
                for path in paths:
                    key = (host, 0, _token(path))
                    counts[key] = counts.get(key, 0) + 1
                for b in main_blocks(blocks):
                    key = (host, _token(b.path), _token(b.path, b.text))
                    counts[key] = counts.get(key, 0) + 1
                for key, n in counts.items():
                    one = xxhash.xxh64_intdigest(f"{page}:{n}") - 2**63
                    known = held.setdefault(key, [0, 0])
                    known[0] ^= one
                    known[1] += 1
                if len(held) > flush:
                    yield rows()
        yield rows()

    part = pages.select("host", "page", "html").mapInArrow(
        work, "host string, around bigint, token bigint, vector bigint, support bigint"
    )
    tokens = part.groupBy("host", "around", "token").agg(
        F.bit_xor("vector").alias("vector"), F.sum("support").alias("support")
    )
    tokens = materialise(tokens.filter(F.col("support") >= least))
    elements = tokens.filter("around = 0")
    sizes = elements.filter("token = 0").select("host", F.col("support").alias("n_pages"))
    frames = elements.filter("token <> 0").select("host", F.col("token").alias("around"), F.col("vector").alias("frame"))
    texts = tokens.filter("around <> 0").join(frames, ["host", "around"]).filter("vector = frame")
    frequent = texts.join(sizes, "host").filter(F.col("support") >= share * F.col("n_pages"))
    # every token is on most pages of its host, so a template has no more than a page or two of them
    return frequent.groupBy("host").agg(F.collect_set("token").alias("template"))


def extract_main_text(
    pages: DataFrame, spread: int = 32, page_id: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """Per row: page_id, url, text (empty if none), n_chars (code points).

    Blocks outside the article or in elements beside it go by the structure; texts of the host's
    template go too, unless nothing would be left; what remains in the slots is joined by newlines in
    page order. Null html is empty; pages without a host have no template; equal rows stay.
    Pages meet their template under ``spread`` hashed parts of a host, so that one host may have most pages.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(url).alias("host")
    ).withColumn("page", F.xxhash64("page_id", "url"))
    known = templates(rows.filter("host <> ''")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [main_blocks(parse(t or "")[1]) for t in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "host": batch.column("host"),
                    "page": batch.column("page"),
                    "texts": pa.array([[b.text for b in x] for x in blocks], pa.list_(pa.string())),
                    "tokens": pa.array([[_token(b.path, b.text) for b in x] for x in blocks], pa.list_(pa.int64())),
                }
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    parsed = rows.mapInArrow(
        work,
        f"page_id {kinds[0]}, url {kinds[1]}, host string, page bigint, texts array<string>, tokens array<bigint>",
    ).withColumn("part", F.pmod("page", F.lit(spread)).cast("int"))
    joined = parsed.join(known, ["host", "part"], "left")
    template = F.coalesce("template", F.array().cast("array<bigint>"))
    pairs = F.arrays_zip("texts", "tokens")
    slots = F.transform(F.filter(pairs, lambda x: ~F.array_contains(template, x["tokens"])), lambda x: x["texts"])
    left = F.when(F.size(slots) > 0, slots).otherwise(F.col("texts"))
    return joined.select("page_id", "url", F.array_join(left, "\n").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
