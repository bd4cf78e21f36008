"""Main text of web pages: subtrees that recur on many pages of a host go first, then what names itself page furniture.

On hosts of fewer than LEAST_PAGES pages nothing recurs often enough; there the names of elements decide alone.
"""

from __future__ import annotations

import html
import re
import zlib
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, save, weight
from vitrine.llm.urls import host_of

#: A subtree is the site's own if it is on pages of the host with so many different main texts;
#: a block of plain text within an article if with so many.
LEAST_PAGES, LEAST_BLOCK_PAGES = 5, 20
#: Within an article, near copies must not pass for different texts: one of so many pages at least must differ in the rest.
COPIES_EACH = 3
#: A block of fewer words and characters within an article, with text of the article before and after it, is taken for a heading, which may recur.
LEAST_WORDS, HEADING_CHARS = 5, 200
#: Of several articles those are taken that hold at least one of so many parts of the largest one's text.
TEASER = 4
SHINGLE = 5
#: Shares that a host's pages are dealt to where its templates don't fit a broadcast.
SALTS = 16

# Element names of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr dt dd figcaption caption".split())
CELLS = frozenset("td th tr".split())
FURNITURE = frozenset("nav footer aside form button select dialog menu head object audio video canvas".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body article main section div table ul ol dl blockquote td th nav aside footer header form button".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login menu modal nav navbar navigation newsletter notice overlay pagination popup promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that make a name of furniture with one of NAMES: before it, and after it.
BEFORE = frozenset("site page main top bottom left right global primary secondary side google user reader cookie gdpr privacy social sticky mobile".split())
AFTER = frozenset("bar bars box slot unit area block banner list links link menu section container wrapper wrap form thread panel popup modal notice widget widgets buttons button icons message messages this item items inner outer top bottom left right main primary secondary 1 2 3".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that any of NAMES may mark; others, blocks of text and their parts, only these of them.
CONTAINERS = frozenset("article div section ul ol dl table header figure center".split())
NAMES_OF_TEXT = frozenset("ad ads adv advert adverts advertisement advertising comment comments consent cookie cookies gdpr newsletter promo replies reply share sharing sponsor sponsored subscribe".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|math|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/][^>]*\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[-_]+")


class Node:
    __slots__ = ("tag", "named", "parts", "gone", "mark", "size", "span", "short")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.parts, self.mark, self.size, self.span = tag, [], None, 0, (0, 0)
        self.named = {k.lower(): (a or b or c or "") for k, a, b, c in _NAMED.findall(attributes)} if "=" in attributes or "hidden" in attributes else {}
        self.gone = self.short = False


def parse(page: str) -> Node:
    """Element tree of a page: parts of a node are texts and nodes. Unclosed and misplaced tags end as browsers end them."""
    root = Node("#")
    stack, at = [root], 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m.group(3) or m.group(6)
        if not name:
            continue
        tag = name.lower()
        if m.group(2) or m.group(5):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag in SCOPES:
                    break
            continue
        closes = SAME_ENDS.get(tag, ()) + (("p",) if tag in ENDS_PARAGRAPH else ())
        for k in range(len(stack) - 1, 0, -1) if closes else ():
            if stack[k].tag in closes:
                del stack[k:]
                break
            if stack[k].tag in SCOPES:
                break
        node = Node(tag, m.group(4) or m.group(7) or "")
        stack[-1].parts.append(node)
        if tag not in VOID:
            stack.append(node)
    if at < len(page):
        stack[-1].parts.append(html.unescape(page[at:]))
    return root


def _walk(root: Node):
    """(node, whether inside the article), parents first."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        yield node, inside
        deeper = inside or node.tag in ("article", "main") or node.named.get("role") == "main"
        todo += [(c, deeper) for c in node.parts if isinstance(c, Node)]


def digest_subtrees(root: Node) -> None:
    """Give every element the 64-bit hash of its tag, names, text and children, and whether it holds text (else None)."""
    for node, _ in reversed(list(_walk(root))):
        text = " ".join(" ".join(p for p in node.parts if isinstance(p, str)).split())
        below = [c.mark for c in node.parts if isinstance(c, Node) and c.mark is not None]
        if text or below:
            key = repr((node.tag, node.named.get("class"), node.named.get("id"), text, below)).encode("utf-8", "surrogatepass")
            node.mark = int.from_bytes(blake2b(key, digest_size=8).digest(), "big", signed=True)


def removable(node: Node, inside: bool, page_size: int) -> bool:
    """Whether recurrence may delete the element: not the page itself, the article or, within it, part of a sentence
    or table, a heading, a short block between others or a container of more than half of the page's text."""
    if node.tag in ("#", "html", "body", "article", "main"):
        return False
    if inside and (node.tag in HEADINGS or node.short or (node.tag not in TEXT_BLOCKS and 2 * node.size > page_size)):
        return False
    return not (inside and (node.tag in CELLS or node.tag in INLINE or node.tag in VOID))


def template_key(node: Node, inside: bool) -> int:
    """The mark that the host's templates are asked for; that of a text block within an article is another."""
    return node.mark ^ 1 if inside and node.tag in TEXT_BLOCKS else node.mark


def named_furniture(name: str, names: frozenset = NAMES) -> bool:
    """Whether a class or id, whole, names furniture: sidebar, ad-slot or site_footer, but not post-header."""
    parts = [x for x in _PART.split(name) if x]
    if not parts or len(parts) > 4:
        return False
    for k, part in enumerate(parts):
        if part in names and all(x in BEFORE or x in NAMES for x in parts[:k]) and all(x in AFTER or x in NAMES or x.isdigit() for x in parts[k + 1 :]):
            return True
    return False


def furniture(node: Node, inside: bool, page_size: int) -> str | None:
    """Why the element is page furniture: "element" by its tag, role or state, "name" by class or id; else None.

    A header counts outside the article only. Names count for all elements but headings and table cells, fewer
    of them for blocks of text, and not for one that holds more than half of the page's text.
    """
    if node.tag in FURNITURE or (node.tag == "header" and not inside):
        return "element"
    named = node.named
    if not named or node.tag in ("#", "html", "body", "main"):
        return None
    if named.get("role", "").lower() in ROLES or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "").lower():
        return "element"
    if node.tag in HEADINGS or node.tag in CELLS or 2 * node.size > page_size:
        return None
    names = (named.get("class", "") + " " + named.get("id", "")).lower().split()
    of = NAMES if node.tag in CONTAINERS else NAMES_OF_TEXT
    return "name" if any(named_furniture(n, of) and not (inside and "header" in _PART.split(n)) for n in names) else None


def measure(root: Node) -> None:
    """Give every element the length of its text without what tags alone mark as furniture, and whether it is a short
    block with text of its article before and after it."""
    for node, inside in reversed(list(_walk(root))):
        if node.tag in FURNITURE or (node.tag == "header" and not inside):
            node.size = 0
        else:
            node.size = sum(len(p.strip()) if isinstance(p, str) else p.size for p in node.parts)
    for top in _tops(root):
        pieces, blocks = 0, []  # texts that aren't blank so far; (block, texts before it, texts up to its end)
        todo: list = [top]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                pieces += bool(part) and not part.isspace()
            elif isinstance(part, list):
                part[2] = pieces
            else:
                if part.tag in TEXT_BLOCKS and part.size < HEADING_CHARS:
                    blocks.append([part, pieces, pieces])
                    todo.append(blocks[-1])
                todo += reversed(part.parts)
        for block, before, upto in blocks:
            block.short = 0 < before and upto < pieces and _words(block) < LEAST_WORDS


def _words(node: Node) -> int:
    n, todo = 0, [node]
    while todo:
        for part in todo.pop().parts:
            if isinstance(part, str):
                n += len(part.split())
            else:
                todo.append(part)
    return n


def _tops(root: Node) -> list[Node]:
    """The outermost articles, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main") or node.named.get("role") == "main":
            out.append(node)
        else:
            todo += [c for c in reversed(node.parts) if isinstance(c, Node)]
    return out


def strip(root: Node, templates: frozenset | set = frozenset()) -> dict[str, int]:
    """Mark the elements that go: recurring subtrees first, then furniture. Tells how many went by each rule, outermost ones."""
    measure(root)
    counts = {"template": 0, "element": 0, "name": 0}
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        why = None
        if node.mark is not None and templates and template_key(node, inside) in templates and removable(node, inside, root.size):
            why = "template"
        why = why or furniture(node, inside, root.size)
        node.gone = why is not None
        if why:
            counts[why] += 1
            continue
        deeper = inside or node.tag in ("article", "main") or node.named.get("role") == "main"
        todo += [(c, deeper) for c in node.parts if isinstance(c, Node)]
    return counts


def main_text(root: Node, templates: frozenset | set = frozenset()) -> str:
    """Text of the article (of all that is left, if the page marks none), blocks and words one space apart."""
    strip(root, templates)
    return left_text(root)


def _shown_tops(root: Node) -> list[Node]:
    """The outermost articles that don't lie within what strip() removed."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.gone:
            continue
        if node.tag in ("article", "main") or node.named.get("role") == "main":
            out.append(node)
        else:
            todo += [c for c in reversed(node.parts) if isinstance(c, Node)]
    return out


def left_text(root: Node) -> str:
    """The text of what strip() left: of the articles, without those much smaller than the largest, else of all."""
    out: list[str] = []

    def text_of(top: Node) -> None:
        todo: list = [top]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                out.append(part)
            elif not part.gone:
                edge = [] if part.tag in INLINE else [" "]
                todo += [*edge, *reversed(part.parts), *edge]

    tops = [t for t in _shown_tops(root) if not t.gone]
    largest = max((t.size for t in tops), default=0)
    for top in [t for t in tops if TEASER * t.size >= largest] or [root]:
        text_of(top)
        out.append(" ")
    return " ".join("".join(out).split())


class Surroundings:
    """What an article says outside one of its elements, as the least hash of five words in a row there.

    Near copies have mostly the same least hash, pages of different articles hardly ever.
    """

    def __init__(self, root: Node):
        words: list[str] = []
        todo: list = [(root, False, False)]
        while todo:
            part, inside, end = todo.pop()
            if isinstance(part, str):
                if inside:
                    words += part.split()
            elif end:
                part.span = (part.span[0], len(words))
            else:
                part.span = (len(words), 0)
                deeper = inside or part.tag in ("article", "main") or part.named.get("role") == "main"
                todo.append((part, inside, True))
                todo += [(c, deeper, False) for c in reversed(part.parts)]
        hashes = [zlib.crc32(" ".join(words[i : i + SHINGLE]).encode("utf-8", "surrogatepass")) for i in range(len(words) - SHINGLE + 1)]
        self.words, self.before, self.after = words, [1 << 32], [1 << 32]
        for x in hashes:
            self.before.append(min(self.before[-1], x))
        for x in reversed(hashes):
            self.after.append(min(self.after[-1], x))
        self.after.reverse()

    def of(self, node: Node) -> int:
        a, b = node.span
        found = min(self.before[max(0, a - SHINGLE + 1)], self.after[min(b, len(self.after) - 1)])
        if found == 1 << 32:  # too few words for a run of five
            return zlib.crc32(" ".join([*self.words[:a], *self.words[b:]]).encode("utf-8", "surrogatepass"))
        return found


def _subtrees(batches):
    for batch in batches:
        hosts, keys, blocks, articles, contents = [], [], [], [], []
        for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            root = parse(page or "")
            digest_subtrees(root)
            text = main_text(root).encode("utf-8", "surrogatepass")
            content = int.from_bytes(blake2b(text, digest_size=8).digest(), "big", signed=True)
            around = Surroundings(root)
            own = {}
            for node, inside in _walk(root):
                if node.mark is not None and removable(node, inside, root.size):
                    own[template_key(node, inside)] = (inside and node.tag in TEXT_BLOCKS, inside, around.of(node) if inside else content)
            hosts += [host] * len(own)
            keys += own
            blocks += [b for b, _, _ in own.values()]
            articles += [i for _, i, _ in own.values()]
            contents += [c for _, _, c in own.values()]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(keys, pa.int64()), pa.array(blocks, pa.bool_()), pa.array(articles, pa.bool_()), pa.array(contents, pa.int64())], names=["host", "mark", "block", "inside", "content"])


def _extract(html_at: int, keep: list[int], told=None):
    """Main text and removal counts of each page; the last two columns are its host and, in rows that aren't pages, the templates
    of the host's pages after it. told: a broadcast of all hosts' templates instead."""

    def run(batches):
        last, known = None, frozenset()
        kind = pa.struct([(k, pa.int32()) for k in RULES])
        for batch in batches:
            texts, counts = [], []
            marks = batch.column(batch.num_columns - 1)
            is_page = marks.is_null()
            for k, (page, host) in enumerate(zip(batch.column(html_at).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), strict=True)):
                if told is not None:
                    known = told.value.get(host, frozenset())
                elif not is_page[k].as_py():
                    last, known = host, frozenset(marks[k].as_py())
                    continue
                elif host != last:
                    last, known = host, frozenset()
                root = parse(page or "")
                if known:
                    digest_subtrees(root)
                counts.append(strip(root, known))
                texts.append(left_text(root))
            pages = batch.filter(is_page)
            yield pa.RecordBatch.from_arrays([*[pages.column(i) for i in keep], pa.array(texts, pa.string()), pa.array(counts, kind)], names=[*[batch.schema.names[i] for i in keep], "main_text", "removed"])

    return run


RULES = ("template", "element", "name")


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_block_pages: int = LEAST_BLOCK_PAGES) -> DataFrame:
    """(host hash, marks): the subtrees of each host that recur on its pages.

    Counts are aggregated before they are shuffled, by host, subtree and the page's other text, so a host of
    very many pages is many keys.
    """
    rows = pages.select(F.xxhash64(host_of(F.col(url_col))).alias("host"), F.col(html_col))
    seen = rows.mapInArrow(_subtrees, "host long, mark long, block boolean, inside boolean, content long")
    texts = seen.groupBy("host", "mark", "block", "inside", "content").agg(F.count("*").alias("pages"))
    counts = texts.groupBy("host", "mark", "block", "inside").agg(F.count("*").alias("n"), F.sum("pages").alias("pages"))
    enough = F.col("n") >= F.when(F.col("block"), least_block_pages).otherwise(least_pages)
    often = counts.where(enough & (~F.col("inside") | (COPIES_EACH * F.col("n") > F.col("pages"))))
    return save(often.groupBy("host").agg(F.collect_set("mark").alias("marks")), "templates")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_block_pages: int = LEAST_BLOCK_PAGES) -> DataFrame:
    """All rows and columns but the html, with main_text and removed (elements that went, by rule, outermost ones).

    First go, per host, subtrees that are the same on pages with least_pages different main texts, however
    many pages the host has; within an article a block of text goes from least_block_pages on, and only if
    the rest of those articles differs on one of COPIES_EACH pages, so that near copies don't delete one
    another. Headings, short blocks between others, inline elements and table rows of an article, and its containers of more than half of a page's text,
    stay. Then go elements that are furniture by tag, role or state, and those that name themselves menu,
    footer, advert, comment and the like. Of what is left the article is taken, where a page marks one; of several those
    that aren't much smaller than the largest (TEASER). On hosts of fewer than least_pages pages nothing is found to recur.

    Character references are decoded and white space becomes one space. Null or empty html gives an empty
    text; null urls and urls without a host form one host; an empty table gives no rows; repeated rows stay.
    Input columns named main_text or removed are replaced, others of any name are kept.
    """
    kept = [c for c in pages.columns if c not in (html_col, "main_text", "removed")]
    columns = list(dict.fromkeys([*kept, html_col, url_col]))
    host = F.xxhash64(host_of(F.col(url_col)))
    found = templates(pages, url_col, html_col, least_pages, least_block_pages)
    keyed = pages.select(*[F.col(f"`{c}`") for c in columns], host.alias("__host"))
    rows, size = weight(found)
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:  # counted: small enough for every worker
        shipped = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.marks) for r in found.collect()})
        told = keyed.withColumn("__marks", F.lit(None).cast("array<long>"))
    else:  # each host's pages go to SALTS shares, its templates once before each
        shipped = None
        salted = keyed.withColumns({"__marks": F.lit(None).cast("array<long>"), "__salt": F.pmod(F.xxhash64(F.col(f"`{html_col}`")), F.lit(SALTS)).cast("int")})
        heads = found.select(F.col("host").alias("__host"), F.col("marks").alias("__marks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        both = salted.unionByName(heads, allowMissingColumns=True)
        told = both.repartition("__host", "__salt").sortWithinPartitions("__host", "__salt", F.col("__marks").isNull()).drop("__salt")
    kind = T.StructType([T.StructField(r, T.IntegerType()) for r in RULES])
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField("main_text", T.StringType()), T.StructField("removed", kind)])
    return told.mapInArrow(_extract(columns.index(html_col), [columns.index(c) for c in kept], shipped), schema)
