"""Main-text extraction with a site style tree.

Every page is parsed to a tree of structural elements (inline formatting is
transparent).  The trees of one host are merged by element path into its style
tree: for each path, over the host's distinct pages, how often each sequence
of child elements (presentation) and each text below it (content) occurs.
Entropy to the base of the page count turns that into importance between 0
(the same on every page) and 1 (different on each), and content outweighs
presentation.  Branches of low importance are noise and are removed from each
page, if the page's own content there is frequent on the host; what their markup declares to be no article (navigation, forms, adverts,
comments and so on) is of importance zero from the start, which is all there
is to go by on hosts with few pages.  A class or id declares it only for a
branch that holds neither the marked article nor most of the page's text.  Where a page marks its article, the rest
of the page goes too.  A host may publish one article many times: branches
that make up most of an article stay, however often they recur.

The counts are ordinary aggregations keyed by (host, path, value), combined on
the map side; a host with a third of all pages is spread over its values.  Only
a list of noise paths per host meets the pages again, by a join that is a
broadcast only if the written table is small.

Edge cases: null or empty html and pages without text give an empty text and
n_chars 0; a null or odd url shares the host "" with its like; identical pages
count once in the tree; malformed or cut-off markup is closed at the end;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.llm.common import written

#: A path needs this many distinct pages before its entropy says anything.
MIN_PAGES = 4
#: Share of content in a branch's importance, and the importance below which it goes.
CONTENT_SHARE, THRESHOLD = 0.9, 0.3
#: Paths of a page beyond this depth are counted with their ancestor.
MAX_DEPTH = 24
#: A path's content is frequent from this share of the path's pages on (two pages at least).
FREQUENT = 0.01

BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td
tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("""aside audio button canvas datalist dialog embed footer form head iframe input math menu nav
noframes noscript object option script select style svg template textarea title video""".split())
#: Opening one of these closes an open paragraph.
_ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NOISE_WORDS = frozenset("""ad ads advert advertisement advertising adbox adsbygoogle banner breadcrumb breadcrumbs
comment comments commentlist consent cookie cookies disclaimer discussion disqus footer gdpr login masthead menu modal
nav navbar navigation navigator newsletter notice notices overlay pager pagination popup promo promoted promotion
recommended related replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe
subscription tagcloud toolbar topbar widget widgets""".split())
_NOISE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
_MAIN_ROLES = frozenset(("main", "article"))


class Node:
    __slots__ = ("tag", "path", "parts", "noise", "main", "depth", "named")

    def __init__(self, tag: str, path: str, noise: bool, main: bool, depth: int, named: bool = False):
        self.named = named  # its class or id has a word of noise
        self.tag, self.path, self.noise, self.main, self.depth = tag, path, noise, main, depth
        self.parts: list = []  # text pieces and child nodes in page order


#: Before a word they say whether the rest of the page has such a part.
_ABOUT = frozenset("no has have with without".split())


def _noise_name(tag: str, attrs: dict, inside_main: bool) -> bool:
    """Whether a class or the id is a word of noise or ends in one."""
    if tag in ("html", "body", "main", "article"):
        return False
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
        parts = name.replace("_", "-").replace(":", "-").strip("-").split("-")
        if parts[0] not in _ABOUT and (parts[-1] in _NOISE_WORDS or parts[-1] == "header" and not inside_main):
            return True
    return False


def _declared_noise(tag: str, attrs: dict, inside_main: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside_main:
        return True
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    if (attrs.get("role") or "").lower() in _NOISE_ROLES:
        return True
    return "display:none" in (attrs.get("style") or "").replace(" ", "").lower()


class _Builder(HTMLParser):
    """Tree of structural elements; open elements are closed as browsers would."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", "", False, False, 0)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.open[-1].parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self._close_paragraph()
            return
        if tag in _ENDS_P:
            self._close_paragraph()
        if tag in _SIBLINGS:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in _SIBLINGS[tag]:
                    del self.open[i:]
                    break
                if self.open[i].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        named = dict(attrs)
        if tag not in BLOCKS and tag not in DROPPED and not ({"class", "id", "role", "hidden", "aria-hidden", "style"} & named.keys()):
            return
        parent = self.open[-1]
        noise = parent.noise or _declared_noise(tag, named, parent.main)
        by_name = _noise_name(tag, named, parent.main)
        if tag not in BLOCKS and tag not in DROPPED and not noise and not by_name:
            return
        main = parent.main or tag in ("article", "main") or (named.get("role") or "").lower() in _MAIN_ROLES
        step = tag + "".join(f".{w}" for w in sorted(set((named.get("class") or "").split())))
        path = f"{parent.path}/{step}" if parent.depth < MAX_DEPTH else parent.path
        node = Node(tag, path, noise, main, parent.depth + 1, by_name)
        parent.parts.append(node)
        self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("article", "main", "body") and tag not in ("body", "html", "main"):
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            del self.open[-1]

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)

    def _close_paragraph(self) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == "p":
                del self.open[i:]
                return
            if self.open[i].tag in BLOCKS:
                return


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    _settle(builder.root)
    return builder.root


def _nodes(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [p for p in reversed(node.parts) if isinstance(p, Node)]


def _settle(root: Node) -> None:
    """Branches of a noisy name become noise unless they hold the marked article or most of the text."""
    order = list(_nodes(root))
    if not any(n.named and not n.noise for n in order):
        return
    size: dict[int, int] = {}
    main: dict[int, bool] = {}
    for n in reversed(order):
        below = [p for p in n.parts if isinstance(p, Node) and not p.noise]
        size[id(n)] = sum(len("".join(p.split())) for p in n.parts if isinstance(p, str)) + sum(size[id(p)] for p in below)
        main[id(n)] = any(p.main and not n.main or main[id(p)] for p in below)
    for n in order:  # parents come first
        if n.named and not main[id(n)] and 2 * size[id(n)] <= size[id(root)]:
            n.noise = True
        if n.noise:
            for p in n.parts:
                if isinstance(p, Node):
                    p.noise = True


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _texts(order: list[Node]) -> dict[int, str]:
    """Text below each of ``order``, parents before children."""
    text: dict[int, str] = {}
    for n in reversed(order):
        text[id(n)] = " ".join(" ".join(p if isinstance(p, str) else text.get(id(p), "") for p in n.parts).split())
    return text


def tree_rows(html: str) -> list[tuple[str, int, int]]:
    """(path, hash of its child elements, hash of the text below it) once per path of the page."""
    root = parse(html)
    order = [n for n in _nodes(root) if not n.noise and n.path]
    text = _texts(order)
    by_path: dict[str, list[Node]] = {}
    for n in order:
        by_path.setdefault(n.path, []).append(n)
    out = []
    for path, nodes in by_path.items():
        content = "\n".join(text[id(n)] for n in nodes)
        if content.strip():
            shape = "|".join(",".join(p.path for p in n.parts if isinstance(p, Node)) for n in nodes)
            out.append((path, _hash(shape), _hash(content)))
    return out


def _repeated(root: Node, noise: frozenset[tuple[str, int]]) -> frozenset[str]:
    """The paths of ``noise`` whose content on this page is one of theirs in ``noise``."""
    paths = {p for p, _ in noise}
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.path in paths
        if inside and not node.noise:
            order.append(node)
        todo += [(p, inside) for p in reversed(node.parts) if isinstance(p, Node)]
    text = _texts(order)
    by_path: dict[str, list[str]] = {}
    for n in order:
        if n.path in paths:
            by_path.setdefault(n.path, []).append(text[id(n)])
    return frozenset(p for p, parts in by_path.items() if (p, _hash("\n".join(parts))) in noise)


def main_text(html: str, noise: frozenset[tuple[str, int]] = frozenset()) -> str:
    """Blocks of the article joined by line feeds; ``noise`` are (path, hash of its text) to leave out.

    Paths that hold most of a marked article, or all of another page's text,
    are low in entropy because the host repeats the article; they stay.
    """
    root = parse(html)
    in_main = any(n.main and not n.noise for n in _nodes(root))
    whole = _blocks(root, in_main, frozenset())
    if not noise:
        return whole
    rest = _blocks(root, in_main, _repeated(root, noise))
    return whole if not rest or in_main and 2 * len(rest) < len(whole) else rest


def _blocks(root: Node, in_main: bool, noise: frozenset[str]) -> str:
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        line = " ".join("".join(now).split())
        if line:
            blocks.append(line)
        now.clear()

    todo: list = [root]
    while todo:
        part = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            now.append(part)
        elif not part.noise and part.path not in noise:
            if part.tag in BLOCKS:
                close()
                todo.append(None)
            keep = part.main or not in_main
            todo += [p for p in reversed(part.parts) if keep or isinstance(p, Node)]
    close()
    return "\n".join(blocks)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def tree_counts(pages: DataFrame) -> DataFrame:
    """(host, path, kind, value, n) of the merged trees; ``pages`` has host and html."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, _hash(t), *row) for h, t in zip(*(c.to_pylist() for c in batch.columns)) for row in tree_rows(t)]
            columns = list(zip(*found)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=["host", "page", "path", "shape", "content"])

    rows = (pages.where("html is not null").select("host", "html")
            .mapInArrow(run, "host string, page long, path string, shape long, content long").distinct())
    kinds = F.explode(F.array(F.struct(F.lit("shape").alias("kind"), F.col("shape").alias("value")),
                              F.struct(F.lit("content").alias("kind"), F.col("content").alias("value"))))
    return (rows.select("host", "path", kinds.alias("k")).groupBy("host", "path", "k.kind", "k.value")
            .agg(F.count("*").cast("double").alias("n")))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the merged trees; ``pages`` has host and html."""
    return importances(tree_counts(pages))


def importances(counts: DataFrame) -> DataFrame:
    # entropy from two sums: H = log m - sum(n log n) / m, divided by log m
    sums = counts.groupBy("host", "path", "kind").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("w"))
    entropy = F.when(F.col("m") > 1, 1 - F.col("w") / (F.col("m") * F.log("m"))).otherwise(1.0)
    part = F.when(F.col("kind") == "content", CONTENT_SHARE).otherwise(1 - CONTENT_SHARE)
    return sums.groupBy("host", "path").agg(
        F.max("m").cast("long").alias("pages"), F.sum(entropy * part).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"),
                        host(F.col(url).cast("string")).alias("host"))
    counts = written(tree_counts(rows), "style-counts")
    low = importances(counts).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < THRESHOLD)).drop("importance")
    often = counts.where("kind = 'content' and n >= 2").join(low, ["host", "path"]).where(F.col("n") >= FREQUENT * F.col("pages"))
    noise = written(
        often.groupBy("host").agg(F.collect_list(F.struct("path", "value")).alias("noise")), "style-noise")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"page_id {fields['page_id']}, url {fields['url']}, text string, n_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h or "", frozenset((x["path"], x["value"]) for x in n or ()))
                    for h, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(noise, "host", "left").select("page_id", "url", "html", "noise").mapInArrow(run, schema)
