"""Main text of web pages by wrapper induction.

The block elements of a page form a tree (leaf siblings of one kind in a row
are one node, a repeated slot). Each host has a reference page, one of its most frequent
structure; every page's tree is aligned with the reference's by simple tree matching,
which names the slot of each element. Two things are induced from all pages of a host:

* a text that fills the same slot on many different pages is template (inside an element that
  declares itself the article or main part, more pages must agree);
* the content region is the deepest element that holds ``REGION_SHARE`` of the host's
  varying text. Blocks outside it go, unless they are a page's title or long and not links.

Names (``nav``, ``class="cookie-notice"``) are a prior: text in named elements
weighs a tenth where the region is sought, and a named element goes unless the region
lies in it (a page inside one form keeps its text). Runs of sibling link
items go outside declared articles. Hosts of one page follow the same rules.
"""

from __future__ import annotations

import collections
import html as entities
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, fresh, slices, staged
from .url_aliases import split_url

#: A text is template if at least so many different pages of the host, and this share of them, have it in one slot.
LEAST_PAGES = 3
LEAST_SHARE = 0.3
#: The share for a text inside a declared article or main part.
DECLARED_SHARE = 0.5
#: The content region holds at least this share of the text's weight, in percent.
REGION_SHARE = 80
#: A block of so many characters, less than half of them links, stays outside the region, too.
LONG = 200
#: Levels of a tree; what lies deeper hangs on the last one.
DEPTH = 100

# Element and attribute names of HTML, and words that name furniture.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
pre section summary table tbody td tfoot th thead tr ul""".split())
RAW = frozenset("script style textarea title".split())
SKIPPED = frozenset("noscript iframe template xmp noembed noframes select button svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav header footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WORDS = frozenset("""ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie
cookies consent notice notices notification alert gdpr popup modal overlay sidebar aside menu nav navbar navigation
breadcrumb breadcrumbs header masthead topbar footer comment comments disqus reply replies respond share sharing social
related recommended newsletter subscribe subscription signup login search pagination pager toolbar copyright""".split())
COMMON = frozenset("""area areas bar block body bottom box button buttons center container content first group holder icon
icons inner item items last law left link links list main outer panel posts primary right row secondary section site
stories tag tags text top unit user widget widgets wrap wrapper""".split())
ABOUT = frozenset("has with without no".split())
TITLES = frozenset("article entry post content story title".split())
CLOSES_P = BLOCKS - frozenset("html head body dd dt li td th tr tbody thead tfoot option optgroup legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SAME = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
ITEMS = frozenset("li dt dd td th option div".split())

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>"""
                  r"""|(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LETTERS = re.compile(r"[A-Za-z]+")


class Tree:
    """Labels, parents and children of the block elements of a page, and its text blocks."""

    def __init__(self):
        self.label, self.parent, self.children, self.tag = ["#"], [-1], [[]], ["#"]
        self.state = [((), False, False, False)]  # (named elements around, in an article, in main, in an article's header)
        self.blocks: list[tuple[int, str, int]] = []  # (node, text, characters of links)

    def add(self, parent: int, tag: str, label: str, state) -> int:
        self.label.append(label)
        self.tag.append(tag)
        self.parent.append(parent)
        self.children.append([])
        self.state.append(state)
        self.children[parent].append(len(self.label) - 1)
        return len(self.label) - 1

    def skeleton(self) -> tuple:
        """Nested (label, children, nodes); a run of leaf siblings of one label is one entry."""
        made = [None] * len(self.label)
        for node in range(len(self.label) - 1, -1, -1):
            out = []
            for c in self.children[node]:
                entry = made[c]
                if out and not entry[1] and not out[-1][1] and out[-1][0] == entry[0]:
                    out[-1] = (entry[0], [], out[-1][2] + entry[2])
                else:
                    out.append(entry)
            made[node] = (self.label[node], out, [node])
        return made[0]


def _furniture(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element says that it is no part of an article."""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in ROLES:
        return True
    if tag in DROPPED and not (tag == "header" and inside):
        return True
    names = _names(attributes)
    if tag in ("html", "body", "main", "article", "h1"):
        return tag == "article" and any(not {"comment", "comments"}.isdisjoint(x) for x in names)
    if any(not ABOUT.isdisjoint(x) for x in names):
        return False  # "has-sidebar" is about the page's layout
    words = WORDS
    if inside or any(not TITLES.isdisjoint(x) for x in names):
        words = WORDS - {"header", "masthead"}
    return any(x[-1] in words or not words.isdisjoint(x) and (words | COMMON).issuperset(x) for x in names)


def _names(attributes: dict[str, str]) -> list[list[str]]:
    """The words of each class and id, cut at letter case and, again, at other characters only."""
    out = []
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        out += [x for x in ([w.lower() for w in cut.findall(name)] for cut in (_WORD, _LETTERS)) if x]
    return out


def _closed(page: str) -> dict[int, int]:
    """Start -> end of the ``SKIPPED`` elements that have an end tag inside the element they are in."""
    out, open_, count, at = {}, [], collections.Counter(), 0
    while (start := page.find("<", at)) >= 0:
        m = _TAG.match(page, start)
        if not m:
            at = start + 1
            continue
        at = m.end()
        tag, closing = (m[2] or m[5] or "").lower(), m[1] or m[4]
        if tag in RAW and not closing:
            at = _end_of(tag, page, at)
        elif tag in SKIPPED or tag in BLOCKS:
            if not closing:
                if not (tag == "svg" and _selfclosed(m)):
                    open_.append((tag, start))
                    count[tag] += 1
            elif count[tag]:
                last = None
                while last != tag:
                    last, begun = open_.pop()
                    count[last] -= 1
                if tag in SKIPPED:
                    out[begun] = at
    return out


def _end_of(tag: str, page: str, at: int) -> int:
    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
    return close.end() if close else len(page)


def _selfclosed(m) -> bool:
    return (m[3] if m[2] else m[6]).rstrip().endswith("/")


def parse(page: str) -> Tree:
    """The tree of a whole page. Tolerates unclosed, misplaced and unknown elements."""
    t = Tree()
    open_, inline, text, links, in_link = [0], [], [], 0, 0  # inline: furniture that is not a block
    closed = None

    def flush():
        nonlocal links
        words = " ".join(entities.unescape("".join(text)).split())
        if words:
            t.blocks.append((open_[-1], words, links))
        text.clear()
        links = 0

    def put(s: str):
        nonlocal links
        if s and not inline:
            text.append(s)
            links += len(s) if in_link else 0

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            put(page[at:])
            break
        put(page[at:start])
        m = _TAG.match(page, start)
        if not m:
            put("<")
            at = start + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, raw = m[1] or m[4], m[3] if m[2] else m[6]
        if tag in RAW and not closing:
            at = _end_of(tag, page, at)
            put(" ")
            continue
        if tag in SKIPPED and not closing:
            if tag == "svg" and _selfclosed(m):
                continue
            closed = _closed(page) if closed is None else closed
            put(" ")
            if start in closed:
                at = closed[start]
            elif not inline:
                inline.append(tag)  # without an end tag: dropped up to the next block
            continue
        if tag in BLOCKS:
            flush()
            in_link = 0
            inline.clear()
            if closing:
                names = [t.tag[n] for n in open_]
                if tag in names[1:]:
                    del open_[len(names) - 1 - names[::-1].index(tag):]
                continue
            names = [t.tag[n] for n in open_]
            if tag in CLOSES_P and "p" in names:
                del open_[len(names) - 1 - names[::-1].index("p"):]
            elif tag in SAME and t.tag[open_[-1]] in SAME[tag].split():
                open_.pop()
            parent = open_[-1]
            attributes = {a[0].lower(): entities.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(raw)} \
                if raw.strip() else {}
            named, article, main, heading = t.state[parent]
            body = "articleBody" in attributes.get("itemprop", "").split()
            if _furniture(tag, attributes, article):
                named = (*named, len(t.label))
            heading = (heading or article and tag == "header") and tag not in HEADINGS
            article = article or tag == "article" or body
            main = main or tag == "main" or attributes.get("role") == "main"
            label = f"{tag}.{attributes['class'].strip()}" if attributes.get("class") else tag
            node = t.add(parent, tag, label, (named, article, main, heading))
            if tag not in VOID and len(open_) < DEPTH:
                open_.append(node)
        elif tag == "br":
            put(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag not in VOID:
            if closing:
                if inline and inline[-1] == tag:
                    inline.pop()
            elif inline:
                if inline[-1] == tag:
                    inline.append(tag)
            elif raw.strip():
                attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(raw)}
                if _furniture(tag, attributes, True):
                    inline.append(tag)
    flush()
    return t


def match(a, b, found: dict[int, int]) -> None:
    """Align two skeletons whose labels are equal: found[node of b] = first node of a. Simple tree matching."""
    sizes: dict[tuple[int, int], int] = {}

    def size(x, y) -> int:
        if x[0] != y[0]:
            return 0
        key = (id(x), id(y))
        if key not in sizes:
            sizes[key] = 1 + (table(x[1], y[1])[-1][-1] if x[1] and y[1] else 0)
        return sizes[key]

    def table(xs, ys):
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            row, above = [0], rows[-1]
            for j, y in enumerate(ys):
                both = size(x, y)
                row.append(max(row[j], above[j + 1], above[j] + both if both else 0))
            rows.append(row)
        return rows

    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        for node in y[2]:
            found[node] = x[2][0]
        if not (x[1] and y[1]):
            continue
        rows = table(x[1], y[1])
        i, j = len(x[1]), len(y[1])
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x[1][i], y[1][j]))


def link_runs(t: Tree) -> set[int]:
    """Nodes whose text is a menu's: at least two sibling items of one element side by side, each mostly links.

    No heading is part of an item, and a paragraph only of an item of a list or table.
    """
    size, links = [0] * len(t.label), [0] * len(t.label)
    for n, s, of_links in t.blocks:
        size[n] += len(s)
        links[n] += of_links
    text = [tag in HEADINGS or tag == "p" for tag in t.tag]
    for n in range(len(t.label) - 1, 0, -1):
        size[t.parent[n]] += size[n]
        links[t.parent[n]] += links[n]
        if text[n] and size[n] and (t.tag[n] != "p" or t.tag[t.parent[n]] not in SAME):
            text[t.parent[n]] = True
    menu = [False] * len(t.label)
    for children in t.children:
        run: list[int] = []
        for c in [*(c for c in children if size[c]), None]:
            item = c is not None and t.tag[c] in ITEMS and not text[c] and links[c] * 5 >= size[c] * 3
            if run and not (item and t.tag[run[0]] == t.tag[c]):
                if len(run) > 1:
                    for x in run:
                        menu[x] = True
                run = []
            if item:
                run.append(c)
    for n in range(1, len(menu)):
        menu[n] = menu[n] or menu[t.parent[n]]
    return {n for n, x in enumerate(menu) if x}


#: What is known of a block before the host's pages are compared.
BLOCK = [
    ("slot", pa.int64()), ("text", pa.string()),
    ("chain", pa.list_(pa.int64())),  # the elements around it that hold blocks, by slot, outermost first
    ("named", pa.list_(pa.int64())),  # those of them, or itself, that are named like furniture; -1: an article's byline
    ("weight", pa.int64()),  # of its text where the region is sought
    ("declared", pa.bool_()), ("menu", pa.bool_()),
    ("body", pa.bool_()),  # in as few named elements as any block of the page, and no menu
    ("strong", pa.bool_()),  # stays outside the region
]
BLOCK_TYPE = ("array<struct<slot:bigint,text:string,chain:array<bigint>,named:array<bigint>,weight:bigint,"
              "declared:boolean,menu:boolean,body:boolean,strong:boolean>>")


def blocks_of(page: str, reference=None) -> list[tuple]:
    """All text blocks of a page in order, as ``BLOCK`` says; slots are those of the reference, or the page's own."""
    t = parse(page)
    found: dict[int, int] = {}
    if reference is not None:
        match(reference, t.skeleton(), found)
    slot: list[int] = []
    for n in range(len(t.label)):  # parents come first
        if reference is None or n in found:
            slot.append(xxhash.xxh64_intdigest(f"r{n if reference is None else found[n]}") >> 1)
        else:
            slot.append(xxhash.xxh64_intdigest(t.label[n], seed=slot[t.parent[n]] if n else 0) >> 1)
    plain = [n for n, _, _ in t.blocks if not (t.state[n][0] or t.state[n][3])]
    declared = next((x for x in ({n for n in plain if t.state[n][place]} for place in (1, 2)) if x), set())
    menus = link_runs(t) - declared
    fewest = min((len(t.state[n][0]) for n, _, _ in t.blocks), default=0)
    out = []
    for n, text, links in t.blocks:
        around, byline = t.state[n][0], t.state[n][3]
        chain, node = [], n if t.children[n] else t.parent[n]
        while node >= 0:
            chain.append(slot[node])
            node = t.parent[node]
        size = len(text)
        out.append((
            slot[n], text, chain[::-1], [slot[x] for x in around] + [-1] * byline,
            max(100 // 10 ** min(len(around), 3), 1) * max(2 * size - links, 1), n in declared, n in menus,
            len(around) == fewest and n not in menus and not byline,
            t.tag[n] == "h1" or size >= LONG and 2 * links < size))
    return out


def _loaded(text: str | None, seen: dict):
    if text is None:
        return None
    if text not in seen:
        seen.clear()  # rows come sorted by host or nearly so
        seen[text] = json.loads(text)
    return seen[text]


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> tuple[DataFrame, list[str]]:
    """``pages`` without the HTML, with the main text, its number of blocks and of those that the host's pages vote out.

    Returns the frame and the three names (fresh ones); runs of link items are in neither
    number. Null HTML is empty. A page without a host is compared with no other.
    The votes of a host are counted over all its different pages, copies of one
    page once; ``LEAST_PAGES`` of them are the least evidence for a template text. A page with no block
    in its host's region loses none for being outside. Repeated rows get equal results;
    an empty table gives an empty result. Slots and texts are compared by 64-bit hashes.
    """
    keep = [c for c in pages.columns if c != page]
    rid, group, ref, blocks, text, n_blocks, n_voted = fresh(
        pages, "_row", "_group", "_reference", "_blocks", "text", "n_blocks", "n_template")
    name, _ = split_url(F.col(url))
    src = pages.withColumn(page, F.coalesce(page, F.lit("")))
    mark = F.xxhash64(page)
    src = src.withColumn(group, F.when(name != "", name).otherwise(F.concat(F.lit("?"), mark.cast("string"))))
    src = src.withColumn(rid, F.monotonically_increasing_id())
    references = _references(src, group, page)
    joined = src.join(references, src[group] == references["h"], "left").select(
        *keep, group, rid, page, F.col("tree").alias(ref))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in [*keep, group, rid]] + [f"`{blocks}` {BLOCK_TYPE}"])
    names, fields = [*keep, group, rid, blocks], [f for f, _ in BLOCK]

    def run(batches):
        seen: dict = {}
        for b in slices(batches):
            n = b.num_columns
            found = [[dict(zip(fields, x, strict=True)) for x in blocks_of(p, _loaded(r, seen))]
                     for p, r in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(found, pa.list_(pa.struct(BLOCK)))], names=names)

    read = staged(joined.mapInArrow(run, schema), "blocks")
    voted = lambda x: F.xxhash64(F.col(group), x["slot"], x["text"])
    hits = _template(read.select(
        F.xxhash64(group).alias("h"), F.col(rid).alias("r"),
        F.xxhash64(F.transform(F.filter(blocks, lambda x: x["body"]), lambda x: x["text"])).alias("whole"),
        F.transform(F.filter(blocks, lambda x: ~x["menu"]), lambda x: F.struct(
            voted(x).alias("cell"), x["declared"].alias("declared"))).alias("cells")).where(F.size("cells") > 0))
    hits = checked_broadcast(hits, F.size("_template") * 8 + 32)
    (template,) = fresh(read, "_template_cells")
    out = read.join(hits, read[rid] == hits["_hit"], "left").withColumn(
        template, F.coalesce("_template", F.array().cast("array<bigint>"))).drop("_hit", "_template")
    constant = lambda x: F.array_contains(template, voted(x))
    regions = _regions(out.select(F.xxhash64(group).alias("h"), F.explode(F.transform(
        F.filter(blocks, lambda x: ~x["menu"] & ~constant(x)),
        lambda x: F.struct(x["chain"].alias("chain"), x["weight"].alias("weight")))).alias("b")))
    regions = checked_broadcast(regions, F.size("_around") * 8 + 32)
    out = out.join(regions, F.xxhash64(out[group]) == regions["_in"], "left")
    (left, beyond) = fresh(out, "_left", "_beyond")
    inside = lambda x: F.array_contains(x["chain"], F.col("_region"))
    out = out.withColumn(beyond, F.coalesce(F.exists(blocks, inside), F.lit(False)))
    away = lambda x: constant(x) | (F.col(beyond) & ~inside(x) & ~x["strong"])
    around = F.coalesce("_around", F.array().cast("array<bigint>"))
    free = lambda x: F.size(F.array_except(x["named"], around)) == 0
    out = out.withColumn(left, F.filter(blocks, lambda x: ~x["menu"] & ~away(x) & free(x)))
    return out.select(
        *keep, F.array_join(F.transform(left, lambda x: x["text"]), "\n\n").alias(text),
        F.size(F.filter(blocks, lambda x: ~x["menu"])).cast("long").alias(n_blocks),
        F.size(F.filter(blocks, lambda x: ~x["menu"] & away(x))).cast("long").alias(n_voted),
    ), [text, n_blocks, n_voted]


def _references(src: DataFrame, group: str, page: str) -> DataFrame:
    """(h, tree) for each group of two or more different pages: the skeleton of a page of the most frequent structure.

    A structure is the order in which the kinds of elements first come; ties go
    to the smaller hash.
    """
    mark = F.xxhash64(page)
    kinds = F.array_distinct(F.regexp_extract_all(F.lower(page), F.lit(
        r"<(main|article|section|nav|aside|header|footer|form|table|ul|ol|div|h1|h2|p)[\s>]"), F.lit(1)))
    ways = (src.select(F.col(group).alias("h"), mark.alias("first"), F.xxhash64(kinds).alias("way")).distinct()
            .groupBy("h", "way").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")))
    best = (ways.groupBy("h").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "way", "first")).alias("best"))
            .where(F.col("pages") > 1).select("h", F.col("best.first").alias("first")))
    best = staged(best, "voters")
    best = checked_broadcast(best, F.length("h") + 64)
    first = src.join(best, (src[group] == best["h"]) & (mark == best["first"])).select("h", page)

    def skeletons(batches):
        for b in batches:
            trees = [json.dumps(parse(x).skeleton()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees, pa.string())], names=["h", "tree"])

    trees = staged(first.mapInArrow(skeletons, "h string, tree string").groupBy("h").agg(F.min("tree").alias("tree")),
                   "references")
    return checked_broadcast(trees, F.length("h") + F.length("tree") + 64)


def _template(votes: DataFrame) -> DataFrame:
    """(_hit, _template): rows with the cells of theirs that are template. ``votes``: h, r, whole, cells (cell, declared)."""
    cells = votes.select("h", "r", "whole", F.explode(F.array_distinct("cells")).alias("c"))
    cells = cells.select("h", "r", "whole", "c.cell", "c.declared")
    different = staged(votes.select("h", "whole").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("pages")),
                       "different-pages")
    different = checked_broadcast(different, 16)
    pages_of = (cells.groupBy("h", "cell", "whole").agg(F.max("declared").alias("declared"))
                .groupBy("h", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("declared").alias("declared")))
    share = F.when(F.col("declared"), DECLARED_SHARE).otherwise(LEAST_SHARE)
    constant = staged(pages_of.where(F.col("n") >= LEAST_PAGES).join(different, "h")
                      .where(F.col("n") >= share * F.col("pages")).select("cell"), "template-cells")
    return staged(cells.select("r", "cell").join(checked_broadcast(constant, 16), "cell").groupBy(F.col("r").alias("_hit"))
                  .agg(F.collect_set("cell").alias("_template")), "template-hits")


def _regions(weights: DataFrame) -> DataFrame:
    """(_in, _region, _around): group, slot of its content region, and of the elements around that, itself included.

    ``weights``: h and b (chain, weight). Chains are summed up first, so a group's hot chain is one row a task.
    """
    chains = weights.groupBy("h", F.col("b.chain").alias("chain")).agg(F.sum("b.weight").alias("weight"))
    chains = staged(chains, "chains")
    totals = chains.groupBy("h").agg(F.sum("weight").alias("total"))
    nodes = (chains.select("h", "weight", "chain", F.posexplode("chain").alias("depth", "node"))
             .groupBy("h", "node", "depth").agg(F.sum("weight").alias("weight"), F.min("chain").alias("chain")))
    return staged(nodes.join(totals, "h").where(F.col("weight") * 100 >= F.col("total") * REGION_SHARE)
                  .groupBy(F.col("h").alias("_in")).agg(F.max(F.struct("depth", "weight", "node", "chain")).alias("b"))
                  .select("_in", F.col("b.node").alias("_region"),
                          F.slice("b.chain", F.lit(1), F.col("b.depth") + 1).alias("_around")), "regions")
