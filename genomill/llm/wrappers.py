"""Main text of web pages by wrapper induction.

Pages of a host come from the same programs. All different pages of a host are aligned by the paths
of their nodes, like siblings being one node, and for each path and text at it the pages that have
it are counted. Text that nearly all pages repeat at their path is template; the rest are slots.
Every page of the host is aligned with that wrapper first, and what is template goes, wherever it
is. Of what varies, the article is the elements that say so, if they hold half of it or more, or
else all of it; menus, notices, adverts, forms and reader comments inside it are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .bytewise import bounded

#: Wrappers up to this many bytes in all are sent to every task; beyond, pages are joined with them by host.
SENT = 16 << 20
#: Text that this share of the pages that have the node repeat is template, if they are LEAST or more.
CONSTANT = 0.9
LEAST = 3
#: Counts that a task holds before it passes them on.
HELD = 200_000

# Fixed values of HTML: elements without content, of raw text, that end a paragraph, that an equal one ends, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BLOCK - frozenset("html head body caption tbody td tfoot th thead tr option legend title".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
# Elements, roles and names of what is no article.
AWAY = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea input dialog menu title xmp noembed noframes map math audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended comments comment disqus respond replies footer masthead pagination pager widget toolbar search copyright skip".split())
HEADS = frozenset("header topbar".split())
NOT_NAMES = frozenset("has with no without".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element: its tag and attributes, and elements and texts in order."""

    __slots__ = ("tag", "attributes", "inside", "up")

    def __init__(self, tag: str, attributes: dict[str, str], up: Node | None):
        self.tag, self.attributes, self.inside, self.up = tag, attributes, [], up

    def key(self) -> str:
        a = self.attributes
        if not a:
            return self.tag
        return re.sub(r"\d+", "0", f"{self.tag}.{' '.join(sorted(a.get('class', '').split()))}#{a.get('id', '')}")

    def names(self) -> set[str]:
        return {n.lower() for n in _NAME.findall(f"{self.attributes.get('class', '')} {self.attributes.get('id', '')}")}


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are taken as browsers take the common cases."""
    root = node = Node("#root", {}, None)
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            node.inside.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            up = node
            while up is not None and up.tag != tag:
                up = up.up
            if up is not None and up.up is not None:
                node = up.up
            continue
        if tag in ENDS_P or tag == "p":
            up = node
            while up is not None and up.tag not in ("p", "button", "td", "th", "table", "#root", "body", "article", "div", "section", "main", "li"):
                up = up.up
            if up is not None and up.tag == "p":
                node = up.up
        if tag in ENDED_BY:
            up, ends, scope = node, ENDED_BY[tag], SCOPE[tag]
            while up is not None and up.tag not in ends and up.tag not in scope:
                up = up.up
            while up is not None and up.tag in ends:
                node = up.up
                up = node if node is not None and node.tag in ends else None
        rest = m.group(3)
        attributes = {}
        if rest and rest != "/":
            for a in _ATTRIBUTE.finditer(rest):
                attributes.setdefault(a.group(1).lower(), html.unescape(a.group(2) or a.group(3) or a.group(4) or ""))
        child = Node(tag, attributes, node)
        node.inside.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            child.inside.append(page[at : end.start()])
            at = end.end()
        elif tag not in VOID:
            node = child
    if at < len(page):
        node.inside.append(page[at:])
    return root


def is_away(node: Node, in_article: bool) -> bool:
    """Whether an element is no part of an article by what it calls itself."""
    if node.tag in AWAY:
        return True
    if node.tag == "header" and not in_article:
        return True
    a = node.attributes
    if not a or node.tag in ("html", "body", "article", "main") and "comment" not in node.names():
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    names = node.names()
    return bool(names & NAMES or (names & HEADS and not in_article)) and not names & NOT_NAMES


def text_of(node: Node, skip=None) -> str:
    """Blocks joined by one space, white space inside them as one space, character references decoded."""
    out: list[str] = []
    open_ = [(iter(node.inside), False)]  # markup may be nested deeper than calls can be
    while open_:
        inside, apart = open_[-1]
        x = next(inside, None)
        if x is None:
            open_.pop()
            if apart:
                out.append(" ")
        elif isinstance(x, str):
            out.append(x)
        elif skip is not None and skip(x):
            out.append(" ")
        else:
            apart = x.tag in BLOCK or x.tag == "br"
            if apart:
                out.append(" ")
            open_.append((iter(x.inside), apart))
    return " ".join(html.unescape("".join(out)).split())


# --- wrappers: [key, pages that have the node, {text digest: pages}, children]


def folded(node: Node) -> list:
    """The tree as a wrapper of one page: like siblings that follow one another are one node."""
    children: list[list] = []
    own: list[str] = []
    for x in node.inside:
        if isinstance(x, str):
            own.append(x)
        elif x.tag not in ("script", "style", "head", "noscript", "template"):
            child = folded(x)
            if children and children[-1][0] == child[0]:
                children[-1] = _joined(children[-1], child)
            else:
                children.append(child)
    text = " ".join("".join(own).split())
    return [node.key(), 1, {crc32(text.encode()): 1} if text else {}, children]


def _joined(a: list, b: list) -> list:
    """Two siblings of a page as one node: it has a text for each."""
    merged = aligned(a, b)
    return [a[0], 1, dict.fromkeys([*a[2], *b[2]], 1), _of_one_page(merged[3])]


def _of_one_page(children: list[list]) -> list[list]:
    return [[k, 1, dict.fromkeys(t, 1), _of_one_page(c)] for k, _, t, c in children]


def matching(a: list, b: list) -> int:
    """Simple tree matching: the most nodes that two trees share in order, roots included; 0 if the roots differ."""
    if a[0] != b[0]:
        return 0
    before = [0] * (len(b[3]) + 1)
    for x in a[3]:
        row = [0]
        for j, y in enumerate(b[3]):
            row.append(max(before[j + 1], row[j], before[j] + matching(x, y)))
        before = row
    return before[-1] + 1


def pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Which children of two nodes the best alignment pairs, in order."""
    n, m = len(a[3]), len(b[3])
    if [x[0] for x in a[3]] == [y[0] for y in b[3]] and len({x[0] for x in a[3]}) == n:
        return [(i, i) for i in range(n)]
    gain = [[matching(x, y) for y in b[3]] for x in a[3]]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain[i][j])
    out, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def aligned(a: list, b: list) -> list:
    """The wrapper of both: paired nodes add their pages and texts, the others stay in order."""
    texts = dict(a[2])
    for t, n in b[2].items():
        texts[t] = texts.get(t, 0) + n
    children, i, j = [], 0, 0
    for x, y in [*pairs(a, b), (len(a[3]), len(b[3]))]:
        children += a[3][i:x] + b[3][j:y]
        if x < len(a[3]):
            children.append(aligned(a[3][x], b[3][y]))
        i, j = x + 1, y + 1
    return [a[0], a[1] + b[1], texts, children]


# --- units: what is counted and, as template, left out


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def units(root: Node) -> list[tuple[str, str, list[tuple[list, int]]]]:
    """(path, text, places) of the texts of a page that may be template.

    A unit is the text between two bounds of blocks, inline elements included, or an inline element
    that has a class or an id. Its places are the lists and positions of its parts in the tree.
    """
    out: list[tuple[str, str, list[tuple[list, int]]]] = []
    run: list[tuple[list, int, str]] = []
    runs = 0

    def ended(path: str, parts: list) -> None:
        text = " ".join(html.unescape("".join(t for _, _, t in parts)).split())
        if text:
            out.append((path, text, [(inside, i) for inside, i, _ in parts]))

    # Frames: node, its children with their places, path of its block, its own path, and where the run stood before it.
    open_: list[tuple] = [(root, iter(enumerate(root.inside)), "", "", 0, 0)]
    while open_:
        n, inside, block, path, at, before = open_[-1]
        i, x = next(inside, (0, None))
        if x is None:
            open_.pop()
            apart = n.tag in BLOCK or n.tag == "br"
            if apart and open_:
                ended(path, run)
                run.clear()
                runs += 1
            elif open_ and runs == before and ("class" in n.attributes or "id" in n.attributes):
                ended(path, run[at:])
        elif isinstance(x, str):
            run.append((n.inside, i, x))
        else:
            apart = x.tag in BLOCK or x.tag == "br"
            inner = f"{_hash(path, x.key()):x}"
            at, before = len(run), runs
            if apart:
                ended(block, run)
                run.clear()
                runs += 1
            below = () if is_away(x, True) else enumerate(x.inside)
            open_.append((x, iter(below), inner if apart else block, inner, at, before))
    ended("", run)
    return out


def counted(pages: Iterator[tuple[str, str, float]]) -> Iterator[Counter]:
    """Pages by (host, path hash, 0) and by (host, path hash, unit hash), from (host, page, weight)."""
    out: Counter = Counter()
    for host, page, weight in pages:
        seen = set()
        for path, text, _ in units(parse(page)):
            seen.add((host, _hash(path), 0))
            seen.add((host, _hash(path), _hash(path, text)))
        for key in seen:
            out[key] += weight
        if len(out) >= HELD:
            yield out
            out = Counter()
    yield out


def without(root: Node, template: frozenset[int]) -> None:
    """Takes the units that are template out of a page; a page that is template as a whole stays as it is."""
    gone = []
    rest = False
    for path, text, places in units(root):
        if _hash(path, text) in template:
            gone += places
        else:
            rest = True
    if rest:
        for inside, i in gone:
            inside[i] = " "


def _find(node: Node, test) -> Iterator[Node]:
    """The outermost elements that pass, none of them below what is no part of an article."""
    waiting = node.inside[::-1]
    while waiting:
        x = waiting.pop()
        if isinstance(x, Node) and not is_away(x, False):
            if test(x):
                yield x
            else:
                waiting += x.inside[::-1]


def extract(page: str, template: frozenset[int] = frozenset()) -> str:
    """The text of a page's article; ``template``: the hashes of units that are template on its host."""
    root = parse(page)
    if template:
        without(root, template)
    away = lambda y: is_away(y, False)
    whole = len(text_of(root, away))
    for test in (lambda x: x.tag == "article", lambda x: x.tag == "main" or x.attributes.get("role") == "main", lambda x: x.attributes.get("itemprop") == "articleBody"):
        found = list(_find(root, test))
        if found:
            found = [x for x in found if not x.names() & NAMES or x.names() & NOT_NAMES] or found
            text = " ".join(t for x in found if (t := text_of(x, lambda y: is_away(y, True))))
            if 2 * len(text) >= whole:
                return text
    return text_of(root, away)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null html is an empty page, whose text is empty; a null url or one without a host belongs to
    the host of no name. Template is counted over all different pages of each host; text on fewer
    than ``LEAST`` of them is none. Repeated rows give repeated rows, an empty table an empty one;
    other columns are ignored.
    """
    spark = pages.sparkSession
    shared.ship(spark)
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    rows = pages.select("page_id", "url", "html").withColumn("host", host)
    # Copies of a page count as one page: each has its share of it.
    marked = rows.where("html is not null").select("host", "html", F.xxhash64("html").alias("mark"))
    copies = shared.keep(marked.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "copies")
    few = copies.count() <= SENT // 64
    marked = marked.join(F.broadcast(copies) if few else copies, ["host", "mark"], "left")

    def count(batches) -> Iterator[pa.RecordBatch]:
        def all_pages():
            for batch in batches:
                for h, page, times in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "times")), strict=True):
                    yield h, page, 1.0 / (times or 1)

        for some in counted(all_pages()):
            hosts, paths, texts = zip(*some, strict=True) if some else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(texts, pa.int64()), pa.array(some.values(), pa.float64())], ["host", "path", "unit", "pages"])

    # Tasks combine their counts first, and keys hold the text: no task sees a host's pages.
    counts = marked.select("host", "html", "times").mapInArrow(bounded(count), "host string, path long, unit long, pages double")
    counts = counts.groupBy("host", "path", "unit").agg(F.round(F.sum("pages"), 3).alias("pages")).where(F.col("pages") >= LEAST)
    counts = shared.keep(counts, "counts")
    of = counts.where("unit = 0").select("host", "path", F.col("pages").alias("all"))
    fixed = counts.where("unit <> 0").join(of, ["host", "path"]).where(F.col("pages") >= CONSTANT * F.col("all"))
    wrappers = shared.keep(fixed.groupBy("host").agg(F.array_sort(F.collect_set("unit")).alias("template")), "wrappers")
    size = wrappers.agg(F.sum(8 * F.size("template"))).first()[0] or 0
    rows = rows.join(F.broadcast(wrappers) if size <= SENT else wrappers, "host", "left")

    def run(batches) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[int]] = {}
        for batch in batches:
            out = []
            for h, page, i in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), range(len(batch)), strict=True):
                if h not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[h] = frozenset(batch.column("template")[i].as_py() or ())
                out.append(extract(page, known[h]) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return rows.select("page_id", "url", "html", "host", "template").mapInArrow(bounded(run), kind)


#: For pages whose article is an ``article`` element without other parts in it.
ORACLE = r"""
with a as (
  select page_id, url, coalesce(regexp_extract(html, '<article[^>]*>(.*?)(</article>|$)', 1, 's'), '') as body from pages),
t as (select page_id, url, regexp_replace(body, '<[^>]*>', ' ', 'g') as body from a),
d as (select page_id, url, replace(replace(replace(replace(replace(replace(body, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as body from t)
select page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) as text, length(trim(regexp_replace(body, '\s+', ' ', 'g'))) as n_chars
from d
"""
