"""Main text of web pages: site templates are found by subtree hashes counted per host, then taken out of each page."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from html import unescape

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches

#: Fixed values of HTML: elements that make blocks, that hold no content, and whose content is never page text: as it holds no tags, or with all elements in it.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())
PRUNED = set("noscript template svg iframe object canvas select button math audio video".split())
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd table thead tbody tr td th figure figcaption ol ul dl".split())

#: Elements that are no main text, and elements that no word marks.
OUTSIDE = set("nav footer aside form menu dialog".split())
CONTENT = set("html body main article".split())
#: Whole words of class, id or role that mark what is no main text by themselves, and those that need a second sign.
STRONG = set("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead comments commentlist disqus cookie cookies consent gdpr notice notices newsletter contentinfo".split())
WEAK = set("banner banners promo promotion comment reply replies respond notification alert subscribe subscription signup share sharing social related popup modal overlay toolbar widget search login form complementary teaser card".split())
#: Strong words that name a part of the page's frame, which an article may stand in, and weak ones of readers' comments.
FRAME = set("sidebar sidebars aside nav navbar navigation menu menus masthead footer".split())
READERS = set("comment reply replies respond".split())
#: Words that say nothing beside a mark in one hyphenated class, as in ad-box.
NEUTRAL = set("area bar block bottom box container content inner left list outer page post posts reader right section site slot top user wrap wrapper".split())

TAG = regex.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", regex.S)
NAMED = regex.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", regex.I)
RAW_END = {tag: regex.compile(rf"</{tag}(?=[\s/>])[^>]*>", regex.I) for tag in RAW}
SIGNED = 1 << 63


class Node:
    __slots__ = ("tag", "names", "level", "children", "closed", "chars", "links", "hash", "slot", "plain", "core")

    def __init__(self, tag: str, names: str = "") -> None:
        self.tag, self.names, self.children, self.closed = tag, names, [], False  # children: nodes, and strings for runs of text
        self.level = level_of(names) if names else 0
        self.chars = self.links = self.hash = self.slot = 0
        self.plain, self.core = 0, False  # see measure()


@lru_cache(4096)
def level_of(names: str) -> int:
    """2 if a word of class, id or role marks an element by itself, 1 if one needs a second sign, else 0.

    A hyphenated word counts as a weak mark if all its parts are marks or neutral, so that no-sidebar or share-price are none.
    """
    level = 0
    for word in names.split():
        if word in STRONG:
            return 2
        parts = regex.split("[-_]+", word)
        if word in WEAK or len(parts) > 1 and all(p in STRONG or p in WEAK or p in NEUTRAL for p in parts) and not NEUTRAL.issuperset(parts):
            level = 1
    return level


def parse(html: str) -> Node:
    """A tree of block elements; a run of inline content is one string with references decoded and white space collapsed.

    A paragraph ends where the next block begins, an end tag closes the nearest open element of its name, and what is
    left open ends with the page. Comments leave nothing, nor do raw elements (script, style and the like), in which only
    their own end tag counts. A head holds no other text, so its tags don't matter. Other elements without page text
    (buttons, frames and the like) are pruned; one that is left open ends at the first block in it or with its parent.
    An inline element with a strong mark is an element of its own, so that it can be taken out of its run.
    """
    root = Node("")
    stack, run, at = [root], [], 0
    outer: list[list[str]] = []  # the run around each open pruned or marked inline element
    link, linked = 0, 0  # how deep the open link stands, and how many characters of the run are in links

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                x = stack[-1]
                x.children.append(text)
                x.chars += len(text)
                x.links += min(linked, len(text))
            run.clear()
        linked = 0

    def close(i: int) -> None:
        """Ends the elements from the i-th of the stack on; a pruned one among them lacks its end tag."""
        nonlocal run, link
        flush()
        while len(stack) > i:
            x = stack.pop()
            if x.tag in PRUNED:
                run = outer.pop()
                flush()
                first = next((j for j, c in enumerate(x.children) if isinstance(c, Node)), len(x.children))
                stack[-1].children += x.children[first:]
            elif x.tag not in BLOCKS:
                run = outer.pop()
        link = 0 if link > len(stack) else link

    while m := TAG.search(html, at):
        if m.start() > at:
            run.append(html[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if tag in BLOCKS:
            flush()
            if m[1]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        stack[i].closed = True
                        close(i)
                        break
            else:
                if stack[-1].tag == "p":
                    stack.pop()
                if tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1].tag == tag:
                    stack.pop()
                if tag == "body" and (i := next((i for i, x in enumerate(stack) if x.tag in PRUNED), 0)):
                    close(i)
                node = Node(tag, names_of(m[3]))
                stack[-1].children.append(node)
                stack.append(node)
        elif tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
        elif tag in PRUNED:
            if not m[1]:
                if not m[3].endswith("/"):
                    outer.append(run)
                    run = []
                    stack.append(Node(tag))
            elif i := next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0):
                close(i + 1)
                stack.pop()
                run = outer.pop()
        elif tag in ("br", "hr"):
            run.append(" ")
        elif tag == "head":
            if i := next((i for i, x in enumerate(stack) if x.tag in PRUNED), 0):
                close(i)
        elif tag and tag not in VOID:
            if tag == "a":
                link = 0 if m[1] else len(stack)
            if not m[1]:
                if m[3] and not m[3].endswith("/") and (names := names_of(m[3])) and level_of(names) == 2:
                    outer.append(run)
                    run = []
                    stack.append(Node(tag, names))
            elif outer:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i + 1)
                        stack.pop()
                        run = outer.pop()
                        break
                    if stack[i].tag in BLOCKS and stack[i].tag not in ("p", "div"):
                        break
    run.append(html[at:])
    close(1)
    return root


def names_of(attributes: str) -> str:
    if not attributes:
        return ""
    return " ".join(sorted({w for n in NAMED.finditer(attributes) for w in (n[2] or n[3] or n[4] or "").lower().split()}))


def measure(root: Node) -> list[Node]:
    """Gives each element the hash of its name and content, the hash of its place (names and marks from the root on, without
    text), and the characters and linked characters in it; lists the elements below the root. Iterative, for deep pages.

    `plain` are its characters outside navigation, footers and asides; `core` tells that an unmarked article (or main) with
    most of the page's plain characters is in it.
    """
    order, todo = [], [root]
    root.slot = 0
    while todo:
        x = todo.pop()
        order.append(x)
        for c in x.children:
            if isinstance(c, Node):
                c.slot = xxhash.xxh3_64_intdigest(f"{x.slot} {c.tag} {c.names}")
                todo.append(c)
    for x in reversed(order):
        h = xxhash.xxh3_64(x.tag.encode())
        x.plain = x.chars
        for c in x.children:
            if isinstance(c, str):
                h.update(c.encode("utf-8", "surrogatepass") + b"\0")
            else:
                h.update(c.hash.to_bytes(8, "little"))
                x.chars += c.chars
                x.links += c.links
                x.plain += c.plain if c.tag == "form" or c.tag not in OUTSIDE else 0
        x.hash = h.intdigest()
    for x in reversed(order):
        x.core = x.tag in ("article", "main") and not x.level and 2 * x.plain > root.plain or any(c.core for c in x.children if isinstance(c, Node))
    return [x for x in order if x.tag not in ("", "html", "body") and x.children]


def places(nodes: list[Node]) -> list[dict]:
    """A row for each place of containers on a page: what all elements there hold together."""
    found: dict[int, list[int]] = {}
    for x in nodes:
        if x.tag not in CONTENT and (x.tag not in TEXT_BLOCKS or x.tag in ("ul", "ol")):
            own = found.setdefault(x.slot, [0, 0, 0, 0])
            own[0] = (own[0] * 31 + x.hash) & (SIGNED - 1)
            own[1] += x.links
            own[2] += x.chars
            own[3] = max(own[3], x.level)
    return [{"slot": slot - SIGNED, "content": c, "links": n, "chars": m, "level": level} for slot, (c, n, m, level) in found.items()]


def main_text(root: Node, template: Iterable[int] = ()) -> str:
    """Blocks of the page without marked and recurring subtrees; only those of the article (or main) elements if these hold most of that text.

    Recurring are subtrees whose content or whose place is in the template. Inside an article, such a subtree goes only if
    it is a container; its paragraphs, headings, lists and tables stay however often other pages repeat them. An article
    that recurs is a syndicated one and no template, nor is an element that holds most of the page's plain text; what is in
    them recurs with them, so there a content that recurs says nothing.

    A weak mark needs a second sign: a place that recurs on the host's pages, links for half of its text, or standing
    outside the article with less than a fifth of the page's text. It never takes what holds most of the page's plain text,
    comments of readers only where there is no other. A word of the page's frame, such as sidebar, on an element around the
    article takes the rest of that element. A form that holds most of the page's text, or that never ends, is only a
    wrapper, and an article stays in whatever element that is left open. An article with a mark goes only beside a longer
    one without.
    """
    nodes = measure(root)
    gone = set(template)
    total = max(1, root.chars)
    longest = max((x.chars for x in nodes if x.tag == "article" and not x.level), default=0)

    def most(x: Node) -> bool:
        return 2 * x.plain > root.plain and (x.plain == root.plain or READERS.isdisjoint(w for name in x.names.split() for w in regex.split("[-_]+", name)))

    def outside(x: Node, inside: bool) -> bool:
        if x.tag in CONTENT:
            return x.tag == "article" and x.level > 0 and x.chars < longest
        if x.tag == "form" and (not x.closed or 2 * x.chars > total):
            return False
        if x.tag in OUTSIDE or x.level == 2 or x.tag == "header" and not inside:
            return True
        return x.level == 1 and not most(x) and (2 * x.links >= x.chars or x.slot - SIGNED in gone or not inside and 5 * x.chars < total)

    blocks: list[tuple[str, bool]] = []
    todo: list[tuple[Node | str, bool, bool, bool]] = [(root, False, True, False)]
    while todo:
        x, inside, shown, explained = todo.pop()
        if isinstance(x, str):
            if shown:
                blocks.append((x, inside))
            continue
        enters = x.tag in ("article", "main") or x.tag in ("div", "section") and "main" in x.names.split()
        if outside(x, inside):
            framed = x.core and x.tag not in OUTSIDE and not STRONG.intersection(x.names.split()) - FRAME
            if (x.closed or x.tag not in BLOCKS) and not framed:
                continue
            shown = False
        elif x.tag in ("article", "main"):
            shown = True
        again = x.hash - SIGNED in gone
        if not enters and (again and not explained or x.slot - SIGNED in gone) and not (inside and x.tag in TEXT_BLOCKS) and not most(x):
            continue
        todo += [(c, inside or enters, shown, explained or again) for c in reversed(x.children)]
    in_article = 2 * sum(len(text) for text, inside in blocks if inside) > sum(len(text) for text, _ in blocks)
    return "\n\n".join(text for text, inside in blocks if inside or not in_article)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


PLACES = "array<struct<slot: bigint, content: bigint, links: bigint, chars: bigint, level: bigint>>"


def site_templates(pages: DataFrame, min_pages: int = 5, min_share: float = 0.3) -> DataFrame:
    """host, template: hashes of what recurs on at least `min_pages` pages and `min_share` of the pages of a host.

    Element subtrees count by their content, and containers also by their place, without their text, as menus and
    adverts differ from page to page. A place that recurs is a template if links hold half of its text, if it has at
    most half as many contents as pages, or if it has a weak mark, which so gets its second sign; places in which each
    page has a text of its own, as that of the article, are none.

    A page counts a subtree once, and equal pages count as one: copies of a page don't make its text a template. A host's
    list can't have more entries than 1 / min_share times its mean elements a page. Hot hosts are added up before the shuffle.
    """
    place = pa.struct([(n, pa.int64()) for n in ("slot", "content", "links", "chars", "level")])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            page, hashes, slots = [], [], []
            for html in batch.column(1).to_pylist():
                root = parse(html)
                nodes = measure(root)
                hashes.append(sorted({x.hash - SIGNED for x in nodes}))
                slots.append(places(nodes))
                page.append(root.hash - SIGNED)
            return pa.RecordBatch.from_pydict({"host": batch.column(0), "page": pa.array(page, pa.int64()), "hashes": pa.array(hashes, pa.list_(pa.int64())), "slots": pa.array(slots, pa.list_(place))})

        return work

    own = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    different = cut(map_batches(own, make, f"host string, page long, hashes array<long>, slots {PLACES}").dropDuplicates(["host", "page"]))
    sizes = different.groupBy("host").agg(F.count("*").alias("pages"))
    often = (F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("pages"))
    subtrees = different.select("host", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    found = subtrees.join(sizes, "host").where(often).select("host", "h")
    slots = different.select("host", F.inline("slots")).groupBy("host", "slot", "content").agg(F.count("*").alias("n"), F.sum("links").alias("links"), F.sum("chars").alias("chars"), F.max("level").alias("level"))
    slots = slots.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.count("*").alias("contents"), F.sum("links").alias("links"), F.sum("chars").alias("chars"), F.max("level").alias("level"))
    signs = (F.col("links") * 2 >= F.col("chars")) | (F.col("contents") * 2 <= F.col("n")) | (F.col("level") > 0)
    found = found.unionByName(slots.join(sizes, "host").where(often & signs).select("host", F.col("slot").alias("h")))
    return found.groupBy("host").agg(F.sort_array(F.collect_set("h")).alias("template"))


def extract_text(pages: DataFrame, templates: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """page_id, url, text, n_chars of every page, given its host's template.

    A null html counts as empty and gives an empty text; a null url has the empty host, a null page_id stays null.
    Repeated rows give repeated rows; an empty table gives none; other columns are passed over, whatever their names. A
    page of any length is read whole. Templates are broadcast while they have few entries in all (8 bytes each) when
    counted, else joined by host, where adaptive execution splits a hot host's pages.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(parse(html), template or ()) for html, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return pa.RecordBatch.from_pydict({"page_id": batch.column(0).cast(pa.int64()), "url": batch.column(1).cast(pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

        return work

    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    entries = templates.agg(F.sum(F.size("template") + 8)).first()[0] or 0
    joined = own.join(F.broadcast(templates) if entries <= max_broadcast else templates, "host", "left")
    return map_batches(joined.select("page_id", "url", "html", "template"), make, "page_id long, url string, text string, n_chars long")


def op9_html_text(pages: DataFrame) -> DataFrame:
    return extract_text(pages, cut(site_templates(pages)))
