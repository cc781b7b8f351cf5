"""Main-text extraction by wrapper induction over the pages of a host.

Pages are parsed into DOM trees. Trees of one host are aligned by simple tree matching: children
are matched in order, maximising the number of matched nodes. Aligned blocks of equal text are
constant, those of other text are slots. A constant is template, on every page and inside article
and main elements too, and what varies is content. Element semantics are the prior: outside an
article a fifth of a host's pages (and at least ``LEAST_PAGES``) have to share a constant, inside
one half of them, as a host may serve an article twice; a block beside a page's article is content
only where alignment shows a slot, and all of an article is where nothing was aligned. Only what no
alignment can see, such as adverts that rotate, is settled by kind: navigation, forms, notices,
adverts and comments are never content.

Every page of a host is aligned with the same references, up to three pages of the host picked by
hashes of their html, so a template depends neither on partitioning nor on one odd page. Pages are
dealt once, by host and, for hosts of over a part's size, by hashes of their html into parts of
about that size; references and templates go to each part of their host, so a host with a third of
the pages is no hot group. Counts of what was aligned are summed over the parts.

Edge cases: a null or empty html gives an empty text and 0 characters; broken markup is closed
where HTML would; a null or hostless url has a host of its own; a repeated page counts as one
when constants are counted; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

PART_BYTES = 8 << 20
LEAST_PART_BYTES = 256 << 10
LEAST_PAGES = 3
LEAST_SHARE = 0.2
LEAST_SHARE_INSIDE = 0.5
#: What aligned blocks show: a constant outside an article, one inside, a slot.
OUTSIDE, INSIDE, SLOT = range(3)

#: HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("aside audio button canvas dialog footer form head iframe input menu nav noscript object option script select style svg template textarea title video".split())
BOILERPLATE = frozenset(
    """
    ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies
    copyright disqus footer gdpr legal login menu modal nav navbar navigation newsletter notice notices outbrain pager
    pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup
    skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets
    """.split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z:_-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile("[a-z]+")
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
_ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME_CLOSES = frozenset("li dt dd tr td th option p".split())


class Node:
    """An element with its children in order; text children are strings."""

    __slots__ = ("children", "content", "drop", "label", "tag")

    def __init__(self, tag: str, label: str, drop: bool, content: bool) -> None:
        self.tag, self.label, self.drop, self.content = tag, label, drop, content
        self.children: list = []


def _traits(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The label that trees are matched by, whether the element is boilerplate, and whether it holds the article."""
    if not attributes.strip():
        return tag, tag in DROPPED, tag in ("article", "main")
    values = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
    names = _CAMEL.sub(" ", f"{values.get('class', '')} {values.get('id', '')}").lower()
    role = values.get("role", "").lower()
    content = tag in ("article", "main") or role == "main" or "articlebody" in values.get("itemprop", "").lower()
    words = set(_WORDS.findall(names))
    hidden = "hidden" in values or values.get("aria-hidden", "") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
    drop = tag in DROPPED or hidden or role in ROLES or (bool(words & BOILERPLATE) and tag not in ("html", "body", "main"))
    return f"{tag}.{values.get('class', '')}", drop, content and not drop


def parse(source: str) -> Node:
    """A DOM tree; unclosed and misnested elements are closed as browsers close the common cases."""
    root = Node("#root", "#root", False, False)
    stack, at = [root], 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in _ENDS_PARAGRAPH:  # an open paragraph ends, with the inline elements in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in _SAME_CLOSES and stack[-1].tag == tag:
            stack.pop()
        node = Node(tag, *_traits(tag, m[4]))
        if node.tag == "header":
            node.drop = node.drop or not any(x.content for x in stack)
        stack[-1].children.append(node)
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            stack.append(node)
    if at < len(source):
        stack[-1].children.append(source[at:])
    return root


def runs(root: Node) -> list[tuple[Node, str, str, bool]]:
    """``(element, path, text, in article)`` of each block in page order, boilerplate elements left out."""
    out: list[tuple[Node, str, str, bool]] = []
    held: list[str] = []

    def flush(owner: Node, path: str, inside: bool) -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                out.append((owner, path, text, inside))
            held.clear()

    todo: list = [(root, root, "", False, False)]
    while todo:
        node, owner, path, inside, leaving = todo.pop()
        if isinstance(node, str):
            held.append(node)
            continue
        if leaving:
            flush(owner, path, inside)
            continue
        if node.drop:
            if node.tag not in INLINE:
                flush(owner, path, inside)
            continue
        if node.tag in INLINE:
            todo += [(c, owner, path, inside, False) for c in reversed(node.children)]
            continue
        flush(owner, path, inside)
        path, inside = f"{path}/{node.label}", inside or node.content
        todo.append((node, node, path, inside, True))
        todo += [(c, node, path, inside, False) for c in reversed(node.children)]
    flush(root, "", False)
    return out


def blocks(root: Node) -> list[tuple[str, str, bool]]:
    """``(path, text, in article)`` of each block in page order, boilerplate elements left out."""
    return [x[1:] for x in runs(root)]


def _elements(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str)]


def match_trees(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: pairs of aligned nodes. Children are aligned in order so that the
    matched nodes are most; equal labels at both ends of the lists are matched first."""
    out: list[tuple[Node, Node]] = []
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.label != y.label:
            continue
        out.append((x, y))
        p, q = _elements(x), _elements(y)
        lo = 0
        while lo < min(len(p), len(q)) and p[lo].label == q[lo].label:
            lo += 1
        hi = 0
        while hi < min(len(p), len(q)) - lo and p[-1 - hi].label == q[-1 - hi].label:
            hi += 1
        todo += zip(p[:lo], q[:lo])
        todo += zip(p[len(p) - hi :], q[len(q) - hi :])
        p, q = p[lo : len(p) - hi], q[lo : len(q) - hi]
        if not p or not q:
            continue
        weight = [[_shared(u, v) for v in q] for u in p]
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(len(p) - 1, -1, -1):
            for j in range(len(q) - 1, -1, -1):
                w = weight[i][j]
                best[i][j] = max(best[i + 1][j], best[i][j + 1], w and best[i + 1][j + 1] + w)
        i = j = 0
        while i < len(p) and j < len(q):
            if weight[i][j] and best[i][j] == best[i + 1][j + 1] + weight[i][j]:
                todo.append((p[i], q[j]))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return out


def _shared(u: Node, v: Node) -> int:
    """A bound on matched nodes that ranks alignments: 1 and the labels that their children share."""
    if u.label != v.label:
        return 0
    left = {}
    for c in _elements(u):
        left[c.label] = left.get(c.label, 0) + 1
    n = 1
    for c in _elements(v):
        if left.get(c.label, 0):
            left[c.label] -= 1
            n += 1
    return n


def _key(kind: int, path: str, text: str = "") -> int:
    """Constants are told by the element that they stand in, slots by their whole path."""
    return xxhash.xxh64_intdigest(f"{kind}\x00{path if kind == SLOT else _leaf(path)}\x00{text}") - (1 << 63)


class Page:
    """A page's tree and the blocks of each of its elements."""

    def __init__(self, root: Node) -> None:
        self.root = root
        self.of: dict[int, list[tuple[str, str, bool]]] = {}
        for owner, path, text, inside in runs(root):
            self.of.setdefault(id(owner), []).append((path, text, inside))


def evidence(a: Page, b: Page) -> set[tuple[int, int]]:
    """``(kind, key)`` of what aligning ``a`` with ``b`` shows about the blocks of ``b``."""
    out = set()
    for x, y in match_trees(a.root, b.root):
        mine = b.of.get(id(y))
        if not mine or not (other := a.of.get(id(x))):
            continue
        same = {text for _, text, _ in other}
        for path, text, inside in mine:
            if text in same:
                kind = INSIDE if inside else OUTSIDE
                out.add((kind, _key(kind, path, text)))
            elif not inside:
                out.add((SLOT, _key(SLOT, path)))
    return out


def constants(a: Node, b: Node) -> set[int]:
    """Keys of the aligned blocks of two trees that are equal."""
    return {key for kind, key in evidence(Page(a), Page(b)) if kind != SLOT}


def _leaf(path: str) -> str:
    return path.rpartition("/")[2]


def main_text(source: str, template: set[int] = frozenset()) -> str:
    """The page's main text, given the template of its host: keys of constants and of slots."""
    found = blocks(parse(source))
    article = any(x[2] for x in found)
    kept = []
    for path, text, inside in found:
        if template and _key(INSIDE if inside else OUTSIDE, path, text) in template:
            continue
        if inside or not article or (template and _key(SLOT, path) in template):
            kept.append(text)
    return " ".join(kept)


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host")).withColumn("mark", F.xxhash64("html"))


def _dealt(hosted: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The pages with the deal that they go to; ``host, parts, low, high, other`` of the hosts of
    several parts, with the marks of their references; and the number of deals."""
    deals = shuffle_partitions(hosted.sparkSession)
    mixed = F.xxhash64("mark")
    sizes = hosted.groupBy("host").agg(F.sum(F.length("html").cast("long")).alias("bytes"), F.min("mark").alias("low"), F.max("mark").alias("high"), F.min_by("mark", mixed).alias("other"))
    sizes = staged(sizes, "hosts")
    part = min(PART_BYTES, max(LEAST_PART_BYTES, (sizes.agg(F.sum("bytes")).first()[0] or 0) // (4 * deals)))
    large = sizes.where(F.col("bytes") > part).withColumn("parts", F.ceil(F.col("bytes") / part).cast("int")).drop("bytes")
    parts = F.broadcast(large.select("host", "parts"))
    salt = F.pmod("mark", F.coalesce("parts", F.lit(1))).cast("int")
    return hosted.join(parts, "host", "left").withColumn("deal", _deal(salt, deals)).drop("parts"), large, deals


def _deal(salt: Column, deals: int) -> Column:
    return F.pmod(F.xxhash64("host", salt), F.lit(deals)).cast("int")


def _to_parts(rows: DataFrame, deals: int) -> DataFrame:
    """The rows once for each deal that holds a part of their host."""
    salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return salted.withColumn("deal", _deal(F.col("salt"), deals)).drop("salt", "parts").distinct()


def _references(hosted: DataFrame, large: DataFrame, deals: int) -> DataFrame:
    """``host, mark, html, deal``: the references of the hosts of several parts; the pages of the
    other hosts are together, and find theirs themselves."""
    picked = hosted.join(F.broadcast(large), "host").where(F.col("mark").isin(F.col("low"), F.col("high"), F.col("other")))
    return staged(_to_parts(picked.select("host", "mark", "html", "parts").dropDuplicates(["host", "mark"]), deals), "references")


def _mixed(mark: int) -> int:
    """Spark's ``xxhash64`` of a long, signed."""
    h = xxhash.xxh64_intdigest(mark.to_bytes(8, "little", signed=True), seed=42)
    return h - (1 << 64) if h >> 63 else h


def _align(pages: pa.Table, references: pa.Table) -> pa.Table:
    """``host, kind, key, n``: on how many pages each constant and slot was found, and with a null
    key how many pages were aligned. Equal pages of a host are one."""
    own: dict[str, dict[int, int]] = {}
    for i, (host, mark) in enumerate(zip(pages.column("host").to_pylist(), pages.column("mark").to_pylist())):
        if host:
            own.setdefault(host, {}).setdefault(mark, i)
    given: dict[str, dict[int, str]] = {}
    for host, mark, source in zip(*(references.column(c).to_pylist() for c in ("host", "mark", "html"))):
        given.setdefault(host, {})[mark] = source
    source = pages.column("html")
    rows: list[tuple] = []
    for host, found in own.items():
        picked = given.get(host) or {m: source[found[m]].as_py() for m in (min(found), max(found), min(found, key=_mixed))}
        if len(picked) < 2:
            continue
        trees = {m: Page(parse(x)) for m, x in picked.items()}
        n: dict[tuple[int, int], int] = {}
        for mark, i in found.items():
            page = trees.get(mark) or Page(parse(source[i].as_py()))
            for k in set().union(*(evidence(x, page) for m, x in trees.items() if m != mark)):
                n[k] = n.get(k, 0) + 1
        rows += [(host, kind, key, c) for (kind, key), c in n.items()]
        rows.append((host, None, None, len(found)))
    columns = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["host", "kind", "key", "n"])


def _template(dealt: DataFrame, references: DataFrame) -> DataFrame:
    """``(host, keys array<long>)``: the constants and slots of each host, from all of its pages."""
    counts = dealt.groupBy("deal").cogroup(references.groupBy("deal")).applyInArrow(_align, "host string, kind int, key long, n long").groupBy("host", "kind", "key").agg(F.sum("n").alias("n"))
    counts = staged(counts, "aligned")
    total = counts.where(F.col("key").isNull()).select("host", F.col("n").alias("pages"))
    share = F.when(F.col("kind") == INSIDE, LEAST_SHARE_INSIDE).otherwise(LEAST_SHARE)
    common = counts.where(F.col("key").isNotNull()).join(total, "host").where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= F.col("pages") * share))
    return common.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def induce(pages: DataFrame) -> DataFrame:
    """``(host, keys array<long>)`` of pages with ``page_id, url, html``."""
    hosted = _with_host(pages)
    dealt, large, deals = _dealt(hosted)
    return _template(dealt, _references(hosted, large, deals))


def _apply(pages: pa.Table, templates: pa.Table) -> pa.Table:
    keys = {h: set(k) for h, k in zip(templates.column("host").to_pylist(), templates.column("keys").to_pylist())}
    texts = [main_text(source.as_py(), keys.get(host, frozenset())) for source, host in zip(pages.column("html"), pages.column("host").to_pylist())]
    return pa.table([pages.column("page_id"), pages.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    hosted = _with_host(pages)
    dealt, large, deals = _dealt(hosted)
    template = _template(dealt, _references(hosted, large, deals))
    template = _to_parts(template.join(F.broadcast(large.select("host", "parts")), "host", "left"), deals)
    return dealt.groupBy("deal").cogroup(template.groupBy("deal")).applyInArrow(_apply, "page_id long, url string, text string, n_chars long")


def op5(pages: DataFrame) -> DataFrame:
    return extract(pages)
