"""HTML extraction: wrappers inferred by aligning the pages of a host.

A page becomes a balanced stream of element and text tokens. Streams of one host
are aligned element by element into a union-free regular expression: equal tokens
stay, a run of equal siblings becomes a repeated group, elements that only some
pages have become optional groups, and texts become slots. What the slots hold
over all pages (how much, how much of it links, whether it ever changes) tells
the article from the template. A page's own blocks are then filtered by the paths
of these slots; it is not matched against the expression.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treatlens.llm.tables import rows_of
from treatlens.llm.url_filter import split_url
from treatlens.session import cut_lineage

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WHITE = re.compile(r"\s+")
_LABELS = re.compile(r"[^a-z0-9]+")

# Element names of HTML by their part in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea template noscript iframe title xmp".split())
NEVER = frozenset(
    "head script style textarea template noscript iframe title nav footer aside form button select option menu dialog "
    "input object embed svg math canvas audio video map".split()
)
#: Words of class, id or role that mark what is no article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar side nav navbar navigation "
    "menu breadcrumb breadcrumbs footer header masthead cookie cookies consent notice popup modal newsletter subscribe "
    "signup login search share social related recommended comment comments respond disqus widget toolbar pagination "
    "complementary contentinfo".split()
)
#: Words of layout: in a compound class of an ancestor they do not exclude an article below.
LAYOUT = frozenset("side sidebar nav navbar menu banner header masthead footer notice widget toolbar".split())
#: Words that turn the next into a property of the layout, as in "has-sidebar".
_ABOUT = frozenset("no not has with without hide show".split())
_CLOSES = {  # an opening element ends these if one is open
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"},
}
REGIONS = frozenset({"article", "main"})
#: Elements that are text themselves: a word of a compound class, as in "comments-open", says nothing about them.
_TEXT = REGIONS | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_SCOPE = frozenset("table ul ol dl article section div main body html".split())

#: A wrapper: [key, optional, repeated, children]; a text slot has the key "#".
Node = list


#: How an element is marked: not, by a layout word of a compound class, or otherwise.
_PLAIN, _WEAK, _STRONG = 0, 1, 2


def _mark(token: str, inside: bool, name: str = "") -> int:
    """How one class, id or role marks its element; ``inside`` an article headers belong to it."""
    words = [x for x in _LABELS.split(token) if x]
    if name in _TEXT and len(words) > 1:
        return _PLAIN
    if not _ABOUT.isdisjoint(words[:-1]):
        return _PLAIN
    marks = MARKED.intersection(words)
    if inside:
        marks -= {"header", "masthead"}
    if not marks:
        return _PLAIN
    return _WEAK if len(words) > 1 and marks <= LAYOUT else _STRONG


def _key(name: str, attributes: str, inside: bool = False) -> tuple[str, int]:
    """Name with class, id and role, and how these mark boilerplate."""
    if not attributes:
        return name, _PLAIN
    found, marked = [], _PLAIN
    for kind, *values in _ATTRIBUTE.findall(attributes):
        tokens = [t for v in values for t in v.lower().split()]
        labels = sorted({x for t in tokens for x in _LABELS.split(t) if x and not x.isdigit()})
        marked = max([marked, *(_mark(t, inside, name) for t in tokens)])
        if labels:
            found.append(f"{kind.lower()}={'.'.join(labels)}")
    return " ".join([name, *sorted(found)]), marked


class Page:
    """Blocks of text in page order with their paths, and the tree of elements."""

    def __init__(self, source: str | None) -> None:
        self.blocks: list[tuple[str, str, int]] = []  # path, text, characters in links
        self.tree: Node = ["", 0, 0, []]
        self._open = [("", self.tree, "", _PLAIN)]  # name, node, path, how it is excluded
        self._text: list[str] = []
        self._links = self._in_link = 0
        self._read(source or "")

    def _flush(self) -> None:
        if not self._text:
            return
        text = _WHITE.sub(" ", html.unescape("".join(self._text))).strip()
        name, node, path, excluded = self._open[-1]
        if text:
            if not node[3] or node[3][-1][0] != "#":
                node[3].append(["#", 0, 0, []])
            if not excluded:
                self.blocks.append((path, text, min(self._links, len(text))))
        self._text, self._links = [], 0

    def _push(self, name: str, attributes: str) -> None:
        _, parent, path, excluded = self._open[-1]
        inside = any(n == "article" for n, *_ in self._open)
        key, marked = _key(name, attributes, inside)
        if name in ("html", "body"):
            marked = _PLAIN
        if name in REGIONS and excluded == _WEAK:
            excluded = _PLAIN
        excluded = max(excluded, marked, _STRONG * (name in NEVER or (name == "header" and not inside)))
        node = [key, 0, 0, []]
        parent[3].append(node)
        if name not in VOID:
            self._open.append((name, node, f"{path}/{key}", excluded))

    def _pop(self, names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] in names:
                del self._open[i:]
                return
            if self._open[i][0] in stop:
                return

    def _read(self, source: str) -> None:
        at = 0
        while True:
            found = _TOKEN.search(source, at)
            if found is None:
                self._say(source[at:])
                break
            self._say(source[at : found.start()])
            at = found.end()
            closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not name:
                continue
            name = name.lower()
            if not closing and name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = end.start() if end else len(source)
                continue
            if name in INLINE:
                if name == "br":
                    self._text.append(" ")
                elif name == "a":
                    self._in_link = 0 if closing else 1
                continue
            self._flush()
            if closing:
                if name not in VOID and name not in RAW:
                    self._pop({name}, frozenset())
                continue
            self._pop({"p"}, _SCOPE)
            if name in _CLOSES:
                for _ in _CLOSES[name]:
                    self._pop(_CLOSES[name], _SCOPE)
            self._push(name, attributes)
        self._flush()

    def _say(self, text: str) -> None:
        if text:
            self._text.append(text)
            self._links += self._in_link * len(text)


def folded(node: Node) -> Node:
    """The same stream with runs of equal siblings as repeated groups."""
    out: list[Node] = []
    for child in map(folded, node[3]):
        if out and out[-1][0] == child[0]:
            merged = align(out[-1], child)
            merged[2] = 1
            out[-1] = merged
        else:
            out.append(child)
    return [node[0], node[1], node[2], out]


def align(a: Node, b: Node) -> Node:
    """The narrowest union-free expression of this form that covers both; equal keys are given.

    The longest common run of child tokens is kept; what only one side has turns
    optional, and equal neighbours that arise are folded into a repeated group.
    """
    left, right = a[3], b[3]
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = (
                best[i + 1][j + 1] + 1 if left[i][0] == right[j][0] else max(best[i + 1][j], best[i][j + 1])
            )
    i = j = 0
    out: list[Node] = []

    def put(node: Node) -> None:
        if out and out[-1][0] == node[0]:
            optional = out[-1][1] & node[1]
            out[-1] = align(out[-1], node)
            out[-1][1], out[-1][2] = optional, 1
        else:
            out.append(node)

    while i < n or j < m:
        if i < n and j < m and left[i][0] == right[j][0]:
            put(align(left[i], right[j]))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            put([left[i][0], 1, *left[i][2:]])
            i += 1
        else:
            put([right[j][0], 1, *right[j][2:]])
            j += 1
    return [a[0], a[1] | b[1], a[2] | b[2], out]


def expression(node: Node) -> str:
    """A wrapper as text, such as ``(html (body (nav)? (p #)+))``."""
    body = node[0] if node[0] == "#" else "(" + " ".join([node[0], *map(expression, node[3])]) + ")"
    return body + ("+" if node[2] else "") + ("?" if node[1] else "")


def slots(node: Node, path: str = "") -> Iterator[str]:
    """Paths of the elements that hold text."""
    for child in node[3]:
        if child[0] == "#":
            yield path
        else:
            yield from slots(child, f"{path}/{child[0]}")


def _names(path: str) -> list[str]:
    return [k.split(" ")[0] for k in path.split("/")]


def content_paths(wrapper: Node, seen: dict[str, dict]) -> list[str]:
    """Slots of a wrapper that may hold the article.

    Inside ``article`` or ``main`` all that is not marked as something else.
    Elsewhere slots of which less than half are links and whose text changes from
    page to page, or which only one page (copies count once) has; and constant
    slots beside such ones in an element, directly in ``body`` only between them.
    """
    order = list(slots(wrapper))
    prose = [p for p in order if p in seen and 2 * seen[p]["links"] < seen[p]["chars"]]
    changing = {p for p in prose if seen[p]["low"] != seen[p]["high"] or seen[p]["first"] == seen[p]["last"]}
    around: dict[str, list[int]] = {}
    for i, p in enumerate(order):
        if p in changing:
            around.setdefault(p.rpartition("/")[0], []).append(i)

    def among(i: int, path: str) -> bool:
        parent = path.rpartition("/")[0]
        at = around.get(parent)
        return bool(at) and (_names(parent)[-1] not in ("", "html", "body") or at[0] < i < at[-1])

    kept = {p for i, p in enumerate(order) if p in seen and not REGIONS.isdisjoint(_names(p))} | changing
    kept |= {p for i, p in enumerate(order) if p in prose and among(i, p)}
    return [p for p in dict.fromkeys(order) if p in kept]


def article(blocks: list[tuple[str, str, int]], content: set[str]) -> list[str]:
    """Texts of a page's blocks in content slots: those in ``article``, else in ``main``, else all.

    The choice is made page by page, as the pages of a host need not share one template.
    """
    held = [(p, t) for p, t, _ in blocks if p in content]
    for region in ("article", "main"):
        inside = [t for p, t in held if region in _names(p)]
        if inside:
            return inside
    return [t for _, t in held]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages -> host, folded stream, and per slot its length, link share and text hash."""
    for batch in batches:
        hosts, streams, stats = [], [], []
        for url, source in zip(rows_of(batch, "url"), rows_of(batch, "html")):
            page = Page(source)
            texts: dict[str, list] = defaultdict(lambda: [0, 0, []])
            for path, text, links in page.blocks:
                held = texts[path]
                held[0] += len(text)
                held[1] += links
                held[2].append(text)
            whole = xxhash.xxh3_64_intdigest(json.dumps(page.blocks)) >> 1
            hosts.append(split_url(url)[0])
            streams.append(json.dumps(folded(page.tree), separators=(",", ":")))
            stats.append([
                {"path": p, "chars": c, "links": k, "hash": xxhash.xxh3_64_intdigest("\n".join(t)) >> 1, "page": whole}
                for p, (c, k, t) in texts.items()
            ])
        kind = pa.list_(pa.struct([("path", pa.string()), ("chars", pa.int64()), ("links", pa.int64()), ("hash", pa.int64()), ("page", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(streams, pa.string()), pa.array(stats, kind)],
            names=["host", "stream", "slots"],
        )


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align all streams of each host in a task, one after the other."""
    wrappers: dict[str, Node] = {}
    for batch in batches:
        for host, stream in zip(rows_of(batch, "host"), rows_of(batch, "stream")):
            node = json.loads(stream)
            wrappers[host] = align(wrappers[host], node) if host in wrappers else node
    names, nodes = list(wrappers), [json.dumps(w, separators=(",", ":")) for w in wrappers.values()]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(nodes, pa.string())], names=["host", "stream"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, streams = rows_of(batch, "host"), [json.loads(s) for s in rows_of(batch, "stream")]
        paths = [content_paths(s, {x["path"]: x for x in seen or []}) for s, seen in zip(streams, rows_of(batch, "seen"))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hosts, pa.string()),
                pa.array(list(map(expression, streams)), pa.string()),
                pa.array(paths, pa.list_(pa.string())),
            ],
            names=["host", "wrapper", "content"],
        )


def infer_wrappers(pages: DataFrame, salts: int = 32) -> DataFrame:
    """``host``, ``wrapper`` (a union-free expression) and ``content`` (paths of its article slots).

    All pages count. A host's distinct streams are first aligned in ``salts``
    parts and the parts with each other, so a host of any size is spread out;
    slot statistics are sums and extremes, combined before the shuffle.
    """
    survey = cut_lineage(
        pages.select("url", "html").mapInArrow(
            _survey, "host string, stream string, slots array<struct<path string, chars long, links long, hash long, page long>>"
        ),
        "survey",
    )
    streams = survey.select("host", "stream").distinct()
    parts = streams.repartition(F.col("host"), F.pmod(F.xxhash64("stream"), F.lit(salts))).mapInArrow(
        _induce, "host string, stream string"
    )
    whole = parts.repartition("host").mapInArrow(_induce, "host string, stream string")
    seen = (
        survey.select("host", F.explode("slots").alias("s"))
        .groupBy("host", "s.path")
        .agg(
            F.min("s.page").alias("first"),
            F.max("s.page").alias("last"),
            F.sum("s.chars").alias("chars"),
            F.sum("s.links").alias("links"),
            F.min("s.hash").alias("low"),
            F.max("s.hash").alias("high"),
        )
        .groupBy("host")  # one entry per slot of the wrapper
        .agg(F.collect_list(F.struct("path", "first", "last", "chars", "links", "low", "high")).alias("seen"))
    )
    return whole.join(seen, "host", "left").mapInArrow(
        _choose, "host string, wrapper string, content array<string>"
    )


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, content in zip(rows_of(batch, "html"), rows_of(batch, "content")):
            texts.append("\n\n".join(article(Page(source).blocks, set(content or []))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text``: the article of every page, blocks joined by two newlines.

    Null HTML is an empty page; pages without a host are aligned with each other.
    Texts are whole. Broken markup is read as far as it goes: open elements end
    with the page. Repeated rows each come back; other columns are not read.
    """
    pages = pages.select("page_id", "url", "html")
    wrappers = cut_lineage(infer_wrappers(pages), "wrappers").select("host", "content")
    rest = F.substring_index(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1), "?", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    placed = pages.withColumn("host", host).join(wrappers, "host", "left").select("page_id", "url", "html", "content")
    kind = pages.schema["page_id"].dataType.simpleString()
    return placed.mapInArrow(_read_pages, f"page_id {kind}, url string, text string")
