"""Main text of web pages by removal of site templates.

Pages are parsed into a light element tree. Every subtree is hashed twice: with its text, and by its shape (place, tags, classes, where
it has text and links, runs of like children as one, so that a menu with other entries is the same menu). Both are counted over the
pages of each host in Spark, and subtrees that recur on many pages of their host are template and go:

* with the same text, on a part of the pages; inside the main element on half of them;
* with the same shape and other text, on half of the pages, if short and outside the main element; where tag, class or links are
  evidence of furniture as well, a few pages do, inside the main element half of them.

The main element is the one that holds most of the page's text. Hosts of few pages are counted together as one site; if even that has
few pages, evidence alone decides. What a tag says outright (menus, forms, asides, footers, hidden elements) needs no count. Counts are
summed per slice before they are shuffled, so a host with a third of all pages is no hot key.
"""

from __future__ import annotations

import functools
import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import cut, shuffle_partitions

MIN_PAGES = 5  # of a site that is counted
SHORT = 400  # characters outside links, beyond which a shape alone is no template
SAME, SAME_INSIDE, SHAPE, TOLD, TOLD_INSIDE = range(1, 6)
#: (pages, share of the site's pages) that make a template of each kind.
LIMITS = {SAME: (5, 0.1), SAME_INSIDE: (10, 0.5), SHAPE: (5, 0.5), TOLD: (3, 0.05), TOLD_INSIDE: (5, 0.5)}
MAX_BROADCAST = 500_000  # template hashes, 8 bytes each; beyond, they reach the pages by a join
HOT = 1000  # hosts with more than this part of all pages are dealt over several tasks

# Names of the HTML standard, and class words usual for page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
HEAD = frozenset("base link meta noscript script style template title".split())
HIDE = frozenset("head noscript template svg canvas select datalist button dialog audio video".split())
FURNITURE_TAGS = frozenset("nav aside footer form menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
CONTAINERS = frozenset("html body div section article main center table tbody tr td form fieldset".split())
_EDGE = r"(?:^|[\s_-])(?:{})(?=$|[\s_-])"
#: Reader comments and adverts, wherever they stand; other furniture outside the main element; words that need a count to be believed.
ALWAYS = re.compile(_EDGE.format(r"comments?|disqus|respond|replies|advert\w*|ads|adsense|sponsor\w*"), re.I)
OUTSIDE = re.compile(_EDGE.format(r"cookies?|consent|gdpr|sidebar|side-bar|navbar|navigation|breadcrumbs?|pagination|popup|modal|overlay|newsletter|masthead"), re.I)
WEAK = re.compile(_EDGE.format(r"ad|adv|promo\w*|banner|notices?|menu|nav|header|footer|social|share|sharing|related|recommended|widget|pager|toolbar|toc|subscribe|subscription|signup|login|skip"), re.I)
#: Words for parts of an article, which are not template by their shape alone.
CONTENT = re.compile(_EDGE.format(r"article|content|post|entry|story|text|body|lead|intro|summary|abstract|title|subtitle|headline|byline|caption"), re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DIGITS = re.compile(r"\d+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_P_SCOPE = ("table", "button", "object")
NONE, WEAKLY, OUT, EVERYWHERE, HIDDEN = range(5)  # evidence of furniture


@functools.lru_cache(1 << 14)
def _attributes(attrs: str) -> tuple[str, int, bool]:
    """(signature, evidence, whether it is from a class) of an element's attributes; the signature has classes, id and role without
    their digits."""
    sign, evidence, by_class = [], NONE, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        found = NONE
        if name in ("class", "id"):
            sign.append(_DIGITS.sub("#", value.lower()))
            found = EVERYWHERE if ALWAYS.search(value) else OUT if OUTSIDE.search(value) else WEAKLY if WEAK.search(value) else NONE
            by_class = by_class or found > evidence
        elif name == "role":
            sign.append(value.lower())
            found = OUT if value.lower() in ROLES else NONE
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
            found = HIDDEN
        if found > evidence:
            evidence, by_class = found, name in ("class", "id")
    return "|".join(sign), evidence, by_class


class Node:
    __slots__ = ("tag", "above", "parts", "sign", "told", "by_class", "article", "chars", "links", "clean", "inside", "holds", "kinds")

    def __init__(self, tag: str, above: Node | None):
        self.tag, self.above, self.parts, self.sign, self.told, self.by_class = tag, above, [], "", NONE, False
        self.article = above is not None and (above.article or above.tag in ("article", "main"))
        self.chars = self.links = self.clean = 0
        self.inside = self.holds = False
        self.kinds: tuple[int, ...] = ()


def parse(page: str, evidence: bool = True) -> list[Node]:
    """The elements of a page in order, the root first; ``parts`` are texts and elements. Raw elements and comments are left out;
    unclosed elements end with their parent, paragraphs, list items and cells also where HTML implies it. Time is linear in the page:
    of each tag the open elements are kept by their place in the stack."""
    root = Node("#root", None)
    nodes, stack, at = [root], [root], 0
    places: dict[str, list[int]] = {}
    blocks: list[int] = []

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(to: int) -> None:
        while len(stack) > to:
            gone = stack.pop()
            places[gone.tag].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        if m.end() == m.start():
            break
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            to = last(tag)
            if to > 0 and (tag in BLOCK or not blocks or blocks[-1] <= to):  # an inline end tag does not close blocks
                close(to)
            continue
        attrs = m[3]
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                end = _raw_end(tag).search(page, at)
                at = end.end() if end else len(page) if tag in ("script", "style", "textarea", "title") else at
            continue
        if places.get("head") and tag not in HEAD:
            close(places["head"][-1])
        if tag in CLOSES_P and places.get("p"):
            to = places["p"][-1]
            if last(*_P_SCOPE) < to:
                close(to)
        if tag in _SPLIT:
            to = last(*_SPLIT[tag])
            if to > last(*_SCOPE.get(tag, ())):
                close(to)
        node = Node(tag, stack[-1])
        stack[-1].parts.append(node)
        if tag not in VOID:
            nodes.append(node)
            if attrs and tag not in ("a", "html", "body"):
                node.sign, node.told, node.by_class = _attributes(attrs)
                if node.told < HIDDEN and (not evidence or (node.by_class and tag not in BLOCK)):
                    node.told = NONE
            if tag in HIDE:
                node.told = HIDDEN
            elif evidence and node.told < EVERYWHERE and (tag in FURNITURE_TAGS and stack[-1].tag != "blockquote" or tag == "header" and not node.article):
                node.told, node.by_class = (EVERYWHERE, tag == "form") if tag != "header" else (OUT, False)
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return nodes


@functools.lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*(?:>|$)", re.I)


def weigh(nodes: list[Node], evidence: bool = True) -> Node:
    """Counts characters of every element, drops evidence from what holds most of the page, and finds the main element: from the root
    down, as long as one element holds half of the text outside links that is left (an article or main element counts threefold)."""
    for x in reversed(nodes):
        if x.told == HIDDEN:
            continue
        own = sum(len(p.strip()) for p in x.parts if isinstance(p, str))
        x.chars += own
        if x.tag == "a":
            x.links = x.chars
        if x.above is not None:
            x.above.chars += x.chars
            x.above.links += x.links
    total = nodes[0].chars
    for x in reversed(nodes):
        if x.told and x.told != HIDDEN and x.by_class and (5 * x.chars >= 4 * total if x.told == EVERYWHERE else 2 * x.chars >= total):
            x.told = NONE
        if evidence and x.told == NONE and x.tag in ("ul", "ol", "div", "p", "section", "table") and x.chars and 10 * x.links >= 7 * x.chars and sum(p.tag != "br" for p in x.parts if isinstance(p, Node)) >= 3:
            x.told = WEAKLY
        if x.told == HIDDEN:
            continue
        x.clean += sum(len(p.strip()) for p in x.parts if isinstance(p, str))
        if x.above is not None and x.told == NONE and x.tag != "a":
            x.above.clean += x.clean
    main = nodes[0]
    while main.tag != "article":
        held = [(p.clean * (3 if p.tag in ("article", "main") else 1), -i, p) for i, p in enumerate(main.parts) if isinstance(p, Node) and p.told == NONE and p.tag in CONTAINERS]
        most = max(held, default=None, key=lambda h: h[:2])
        if most is None or not most[2].clean or 2 * most[0] < main.clean:
            break
        main = most[2]
    x = main
    while x is not None:
        x.holds, x = True, x.above
    for x in nodes[1:]:
        x.inside = x is main or x.above.inside
    if main is nodes[0]:
        for x in nodes:
            x.inside = True
    return main


def hashes(nodes: list[Node]) -> list[tuple[int, int]]:
    """Gives every element that may be template its hashes by kind, and lists them as (hash, kind)."""
    exact: dict[Node, bytes] = {}
    shape: dict[Node, bytes] = {}
    path: dict[Node, bytes] = {}
    told_inside = any(x.inside and x.told for x in nodes)
    for x in nodes:
        if not x.inside or told_inside or x.above is None:
            path[x] = _digest(f"{x.tag} {x.sign}".encode("utf-8", "replace"), path[x.above] if x.above is not None else b"")
    found = []
    for x in reversed(nodes):
        if x.told == HIDDEN or not x.chars or x.holds:
            continue
        same = [x.tag.encode()]
        for p in x.parts:
            if isinstance(p, str):
                if p and not p.isspace():
                    same.append(b"\0" + " ".join(p.split()).encode("utf-8", "replace"))
            elif p in exact:
                same.append(b"\1" + exact[p])
        exact[x] = _digest(b"\2".join(same))
        if x in path:
            form = [f"{x.tag} {x.sign}".encode("utf-8", "replace")]
            for p in x.parts:
                own = (b"" if not p or p.isspace() else b"#") if isinstance(p, str) else shape.get(p, b"")
                if own and own != form[-1]:
                    form.append(own)
            shape[x] = _digest(b"\2".join(form))
        if x.tag not in BLOCK or x.tag in ("html", "body"):
            continue
        kinds = [(SAME_INSIDE if x.inside else SAME, exact[x])]
        if x.told in (WEAKLY, OUT):
            kinds.append((TOLD_INSIDE if x.inside else TOLD, path[x] + shape[x]))
        if not x.inside and x.chars - x.links <= SHORT and x.tag not in ("h1", "h2") and (x.told or not CONTENT.search(x.sign)):
            kinds.append((SHAPE, path[x] + shape[x]))
        x.kinds = tuple(int.from_bytes(_digest(bytes([k]) + d), "little", signed=True) or 1 for k, d in kinds)
        found += zip(x.kinds, (k for k, _ in kinds))
    return found


def _digest(data: bytes, key: bytes = b"") -> bytes:
    return blake2b(data, key=key, digest_size=8).digest()


def _at_host(host: str, keys) -> np.ndarray:
    """Hashes of a site, one number each for host and subtree."""
    own = np.frombuffer(blake2b(host.encode("utf-8", "replace"), digest_size=8).digest(), np.uint64)[0]
    return T.mix(np.asarray(keys, np.int64).view(np.uint64) ^ own).view(np.int64)


def main_text(nodes: list[Node], gone: set[int] = frozenset(), counted: bool = True) -> str:
    """Texts of the kept elements by block, in page order. ``gone``: hashes of templates."""
    blocks: list[str] = []
    line: list[str] = []

    def flush():
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    def dropped(x: Node) -> bool:
        if x.holds and x.told != HIDDEN:
            return False
        if x.told >= EVERYWHERE or (not x.inside and (x.told == OUT or (x.told == WEAKLY and not counted))):
            return True
        return not gone.isdisjoint(x.kinds)

    todo: list = [nodes[0]]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(_html.unescape(x) if "&" in x else x)
        elif not dropped(x):
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.parts))
    flush()
    return "\n".join(blocks)


def _host():
    return F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _counter(evidence: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "html"):
            seen: Counter = Counter()
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                if not page:
                    continue
                nodes = parse(page, evidence)
                weigh(nodes, evidence)
                seen.update({(host, key, kind) for key, kind in hashes(nodes)})
                seen[host, 0, 0] += 1  # pages
            if seen:
                h, k, i = zip(*seen)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(k, pa.int64()), pa.array(i, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["host", "key", "kind", "n"])

    return run


def _spread(df: DataFrame, hot: DataFrame, by) -> DataFrame:
    """``df(host, ...)`` with ``salt``: rows of hot hosts are dealt by ``by`` over their number of salts, those of others have 0."""
    df = df.join(F.broadcast(hot), "host", "left")
    return df.withColumn("salt", F.coalesce(F.pmod(by, F.col("salts")), F.lit(0)).cast("int")).drop("salts")


def _salted(df: DataFrame, hot: DataFrame) -> DataFrame:
    """One row of ``df(host, ...)`` for each salt of its host."""
    df = df.join(F.broadcast(hot), "host", "left")
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)).cast("int") - 1))).drop("salts")


def _hot(total: DataFrame, spark) -> DataFrame:
    """(host, salts) of hosts with more than a ``HOT``-th part of all pages: fewer than ``HOT`` rows, whatever the number of hosts."""
    pages = total.agg(F.sum("pages").alias("p")).first()["p"] or 0
    share = F.col("pages") / F.lit(max(1, pages))
    return total.filter(F.col("pages") * HOT > F.lit(pages)).select("host", F.greatest(F.lit(1), F.ceil(share * 4 * shuffle_partitions(spark))).cast("int").alias("salts"))


def _site_templates(pages: DataFrame, limits: dict, min_pages: int, evidence: bool) -> tuple[DataFrame, DataFrame]:
    """((host, key), (host, pages)): templates by host, key 0 for a site that is counted; the site of hosts with few pages has no host."""
    counts = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_counter(evidence), "host string, key long, kind int, n long")
    counts = cut(counts.groupBy("host", "key", "kind").agg(F.sum("n").alias("n")))
    total = counts.filter("kind = 0").select("host", F.col("n").alias("pages"))
    hot = cut(_hot(total, pages.sparkSession))
    # hosts of few pages are one site, of which shapes alone are counted
    few = total.filter(F.col("pages") < min_pages)
    shapes = counts.filter(F.col("kind").isin(SHAPE, TOLD) & (F.col("n") < min_pages))
    pool = _spread(shapes, hot, F.col("key")).join(_salted(few.drop("pages"), hot), ["host", "salt"], "left_semi")
    pooled = few.agg(F.sum("pages").alias("pages")).first()["pages"] or 0
    shared = pool.groupBy("key", "kind").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("host"), "key", "kind", "n", F.lit(pooled).cast("long").alias("pages"))
    often = counts.filter((F.col("kind") > 0) & (F.col("n") >= min(m for m, _ in limits.values())))
    many = total.filter(F.col("pages") >= min_pages)
    own = _spread(often, hot, F.col("key")).join(_salted(many, hot), ["host", "salt"]).select("host", "key", "kind", "n", "pages")
    least, share = (F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(v[i]))) for k, v in limits.items())) for i in (0, 1))
    every = own.unionByName(shared).filter((F.col("pages") >= min_pages) & (F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))).select("host", "key")
    marks = many.select("host", F.lit(0).cast("long").alias("key"))
    if pooled >= min_pages:
        marks = marks.unionByName(pages.sparkSession.range(1).select(F.lit(None).cast("string").alias("host"), F.lit(0).cast("long").alias("key")))
    return every.distinct().unionByName(marks), hot


def extract_main_text(pages: DataFrame, limits: dict[int, tuple[int, float]] = LIMITS, min_pages: int = MIN_PAGES, evidence: bool = True, templates: bool = True, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``.

    Null or empty html gives an empty text and counts as no page. Pages without a host form one site. Repeated rows are pages of their
    own; an empty table gives an empty result; other columns are ignored. Character references are decoded, white space inside a block
    becomes one space, blocks are joined by a line break; ``br`` ends a block. A page is one row, held and parsed in one piece in time
    linear in its length; nothing is cut off. Without ``evidence`` counts alone decide (and what is hidden or no text goes), without
    ``templates`` only evidence that needs no count. Templates beyond ``max_broadcast`` reach the pages by a join on the host, over
    which pages are then shuffled, those of large hosts dealt over several tasks.
    """
    spark = pages.sparkSession
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host().alias("host"))
    source = source.withColumn("keys", F.lit(None).cast("array<bigint>"))
    small, pool = np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = False
    if templates:
        found, hot = _site_templates(pages, limits, min_pages, evidence)
        found = cut(found)
        pool = np.array(sorted(r["key"] for r in found.filter("host is null").toLocalIterator()), np.int64)  # shapes on half of its pages
        found = found.filter("host is not null")
        joined = found.limit(max_broadcast + 1).count() > max_broadcast
        if joined:
            by_host = found.groupBy("host").agg(F.collect_set("key").alias("keys"))  # at most the elements of a page / their least share
            placed = _spread(source.drop("keys"), hot, F.xxhash64("page_id", "url"))
            source = placed.join(_salted(by_host, hot), ["host", "salt"], "left").select("page_id", "url", "html", "host", "keys")
        else:
            chunks = [np.zeros(0, np.int64)]
            for host, keys in _runs(found.orderBy("host").toLocalIterator()):
                chunks.append(_at_host(host, keys))
            small = np.sort(np.concatenate(chunks))
    shared = spark.sparkContext.broadcast((small.tobytes(), pool.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, common = (np.frombuffer(x, np.int64) for x in shared.value)
        pooled = frozenset(common.tolist())

        def of_host(host: str, keys: list[int] | None, nodes: list[Node]) -> tuple[frozenset | set, bool]:
            if joined:
                if keys:
                    return set(keys), True
            else:
                asked = np.array([0, *(k for x in nodes for k in x.kinds)], np.int64)
                own = _at_host(host, asked)
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                hit = known[at] == own if len(known) else np.zeros(len(own), bool)
                if hit[0]:
                    return set(asked[hit].tolist()), True
            return pooled, 0 in pooled

        for part in T.slices(batches, "html"):
            texts = []
            for host, page, keys in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), part.column("keys").to_pylist()):
                if not page:
                    texts.append("")
                    continue
                nodes = parse(page, evidence)
                weigh(nodes, evidence)
                if templates:
                    hashes(nodes)
                    texts.append(main_text(nodes, *of_host(host, keys, nodes)))
                else:
                    texts.append(main_text(nodes))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _runs(rows) -> Iterator[tuple[str, list[int]]]:
    """Keys of one host after another, out of rows ordered by host."""
    now, keys = None, []
    for r in rows:
        if r["host"] != now and keys:
            yield now, keys
            keys = []
        now = r["host"]
        keys.append(r["key"])
    if keys:
        yield now, keys
