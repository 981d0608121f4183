"""Main text of HTML pages by tag-path ratios.

Every block of text has a path: the open elements from the root to it, with classes and ids.  Per path, text length,
punctuation and linked text are summed over its blocks and put in ratio to their number.  A path's length, punctuation
and linked share are fused into one score, which is smoothed over the paths beside it in the page, the more the longer
the way they share below the page's common root.  Paths over a share of the best score are content, and so are the
blocks inside the element that holds most of that content (headings, captions, list items) unless they are mostly links.

Names and labels of elements are a tie-break: paths below elements whose name says that they are no article (menus,
headers, footers, asides, forms), or of which a whole class, id or role says so, have their score times `prior`, so they
win only where nothing else does.  A label that only has such a word as a part ("with-sidebar", "social-science") counts
unless its element holds half of the page's unlinked text.  With prior=1.0 the ratios decide alone.

Pages are independent, so each is handled whole inside a task and nothing is shuffled.  Paths are nodes of a tree and
sums run along it, so time and memory are linear in the page however deep it nests.

Defined results: null, empty or text-free html gives "".  Markup that is cut off or badly nested is read as browsers
do in the main cases: p, li, td and the like end where the next one begins, unknown end tags are passed over, comments
and raw elements that do not end run to the end of the page.  Hidden elements have no text.  Repeated rows are handled
alike.  Further columns pass through, whatever their names, unless named `text` or `n_chars`, which are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stratalog.llm.common import map_batches, others, quoted, sized_chunks, small_batches, spark_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[\"']?[^>]*+)>", re.S)
LABELS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|\baria-hidden\s*=\s*[\"']?true|(?:^|\s)hidden(?:\s|=|/|$)", re.I)

# Element names and label words.
RAW = frozenset("script style textarea title noscript iframe template svg math object noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody", "tfoot"}, "tbody": {"thead", "tbody", "tfoot"}, "tfoot": {"thead", "tbody", "tfoot"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
OUTSIDE = frozenset("head nav header footer aside form button select option dialog menu fieldset".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment comments"
    " consent cookie cookies copyright disqus footer gdpr header masthead menu menubar modal nav navbar navigation"
    " newsletter notice overlay pager pagination popup promo promoted promotion related respond share sharing sidebar"
    " signup social sponsor sponsored sponsors subscribe toolbar widget widgets contentinfo complementary search".split()
)
#: Share of the page's unlinked text from which on an element is a wrapper.
WRAPPER = 0.5
PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？]")


#: What an element's outside name or label leaves of a path's score.
PRIOR = 0.001
#: Share of the best score from which on a path is content.
SHARE = 0.3


class _Tree:
    """Nodes by (parent, label), numbered as they come, so a node's number is above its parent's.  Node 0 is the root."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.parent, self.depth = [0], [0]

    def child(self, parent: int, label: object) -> int:
        node = self.known.setdefault((parent, label), len(self.parent))
        if node == len(self.parent):
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
        return node

    def gathered(self, values: dict[int, float]) -> list[float]:
        """For each node the sum of the values at it and below."""
        out = [0.0] * len(self.parent)
        for node in range(len(out) - 1, -1, -1):
            out[node] += values.get(node, 0.0)
            if node:
                out[self.parent[node]] += out[node]
        return out

    def shared(self, a: int, b: int) -> int:
        """Depth of the last node that the ways to a and b share."""
        while a != b:
            if a > b:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return self.depth[a]

    def under(self, tops: set[int]) -> list[bool]:
        """Which nodes are one of these or below."""
        out = [False] * len(self.parent)
        for node in range(len(out)):
            out[node] = node in tops or node > 0 and out[self.parent[node]]
        return out


class _Block:
    """path: a node; outside: whether an element around it is outside by name; marks: a node of the tree of labelled elements."""

    __slots__ = ("linked", "marks", "outside", "path", "pieces")

    def __init__(self, path: int, outside: bool, marks: int):
        self.path, self.outside, self.marks, self.pieces, self.linked = path, outside, marks, [], 0


def _outside(label: str) -> int:
    """2: all parts of the label are outside words, 1: some, 0: none."""
    words = [b.lower() in OUTSIDE_WORDS for b in re.split(r"[-_\d]+|(?<=[a-z])(?=[A-Z])", label) if b]
    return (2 if all(words) else 1) if any(words) else 0


def blocks(page: str) -> tuple[list[_Block], _Tree, _Tree]:
    """The blocks of text in page order, the tree of their paths and that of labelled elements (number, how the label counts)."""
    found: list[_Block] = []
    paths, marks = _Tree(), _Tree()
    # name, path node, outside by name, node of marks, hidden; of each open element.
    open_: list[tuple[str, int, bool, int, bool]] = []
    counts: Counter[str] = Counter()
    opened = 0
    current: _Block | None = None
    links = 0
    above = ("", 0, False, 0, False)

    def add(piece: str) -> None:
        nonlocal current
        _, path, outside, mark, hidden = open_[-1] if open_ else above
        if hidden:
            return
        if current is None:
            if not piece.strip():
                return
            current = _Block(path, outside, mark)
            found.append(current)
        current.pieces.append(piece)
        if links:
            current.linked += len(piece)

    def close(k: int) -> None:
        """Ends the elements from the k-th on."""
        nonlocal current, links
        for name, *_ in open_[k:]:
            links -= name == "a"
            counts[name] -= 1
            if name not in INLINE:
                current = None
        del open_[k:]

    at, size, last = 0, len(page), page.rfind(">") + 1
    while at < size:
        m = TOKEN.search(page, at, last) if at < last else None
        stop = m.start() if m else size
        if stop > at:
            text = page[at:stop]
            add(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and m[0].endswith("]]>"):
                add(m[0][9:-3])
            elif m[0].startswith(("<!--", "<![CDATA[")) and not m[0].endswith(("-->", "]]>")):
                break
            continue
        name = m[2].lower()
        if m[1]:
            if counts[name] > 0:
                close(next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name))
            elif name not in INLINE:
                current = None
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            if name == "br":
                add(" ")
            elif name == "hr":
                current = None
            continue
        if name not in INLINE:
            current = None
            ends = None
            if counts["p"] > 0 or any(counts[x] > 0 for x in CLOSES.get(name, ())):
                for k in range(len(open_) - 1, -1, -1):
                    over = open_[k][0]
                    if over in CLOSES.get(name, ()):
                        ends = k
                        break
                    if over == "p":
                        ends = k
                    elif over in SCOPES.get(name, ()) or name not in CLOSES and over not in INLINE:
                        break
            if ends is not None:
                close(ends)
        labels = [w for x in LABELS.findall(m[3]) for w in x.strip("\"'").split()] if m[3] else []
        _, path, outside, mark, hidden = open_[-1] if open_ else above
        within = name == "header" and (counts["article"] > 0 or counts["main"] > 0)  # an article's own heading
        opened += 1
        if name not in INLINE:
            path = paths.child(path, ".".join([name, *labels]))
        kind = 0 if name in ("body", "html") else max(map(_outside, labels), default=0)
        if kind:
            mark = marks.child(mark, (opened, kind))
        links += name == "a"
        counts[name] += 1
        open_.append((name, path, outside or name in OUTSIDE and not within, mark, hidden or bool(m[3] and HIDDEN.search(m[3]))))
    return found, paths, marks


def _labelled(parts: list[tuple[_Block, str]], marks: _Tree) -> list[bool]:
    """Whether each block is outside by name or label."""
    kinds = {node: kind for (_, (_, kind)), node in marks.known.items()}
    free: dict[int, float] = {}
    for b, text in parts:
        if not b.outside:
            free[b.marks] = free.get(b.marks, 0) + max(len(text) - b.linked, 0)
    held = marks.gathered(free)
    small = {node for node in kinds if held[node] < WRAPPER * held[0] or not held[node]}
    # Whole labels count on any element, partial ones on elements that hold a small part of the page; if nothing is left, all count so.
    for tops in (small | {node for node, kind in kinds.items() if kind == 2}, small):
        out = marks.under(tops)
        said = [b.outside or out[b.marks] for b, _ in parts]
        if not all(said):
            break
    return said


def main_text(page: str | None, share: float = SHARE, prior: float = PRIOR) -> str:
    """Blocks that path scores and their common container select, each with single spaces, joined by blank lines."""
    found, paths, marks = blocks(page or "")
    parts = [(b, text) for b in found if (text := " ".join("".join(b.pieces).split()))]
    if not parts:
        return ""
    outside = [prior < 1 and x for x in _labelled(parts, marks)]
    # Sums per path, in the order in which paths first appear: blocks, characters, punctuation, linked characters.
    sums: dict[tuple[int, bool], list[float]] = {}
    for (b, text), out in zip(parts, outside, strict=True):
        s = sums.setdefault((b.path, out), [0, 0, 0, 0])
        for k, v in enumerate((1, len(text), len(PUNCTUATION.findall(text)), min(b.linked, len(text)))):
            s[k] += v
    order = list(sums)
    # The page's common root: the last node below which all blocks stand.
    whole = paths.gathered(Counter(b.path for b, _ in parts))
    root = max((node for node, n in enumerate(whole) if n == len(parts)), key=paths.depth.__getitem__)
    base = paths.depth[root]
    raw = [(chars - linked) / n**0.5 * (1 + points / n) * (prior if out else 1.0) for (_, out), (n, chars, points, linked) in sums.items()]
    score = []
    for i, (p, out) in enumerate(order):
        total, weight = raw[i], 1.0
        for j in (i - 2, i - 1, i + 1, i + 2):
            if 0 <= j < len(order) and order[j][1] == out:
                q = order[j][0]
                near = ((paths.shared(p, q) - base) / max(paths.depth[p] - base, paths.depth[q] - base, 1)) ** 2
                total, weight = total + near * raw[j], weight + near
        score.append(total / weight)
    least = share * max(score)
    chosen = {k for k, x in zip(order, score, strict=True) if x >= least}
    # The element around the chosen paths that holds most of their text.
    held = paths.gathered(_summed((paths.parent[p], sums[p, out][1]) for p, out in chosen))
    top = max((node for node, n in enumerate(held) if n >= 0.8 * held[0]), key=paths.depth.__getitem__)
    inside = paths.under({top})
    linky = {k for k, s in sums.items() if s[3] > 0.6 * s[1]}
    return "\n\n".join(text for (b, text), out in zip(parts, outside, strict=True) if (k := (b.path, out)) in chosen and k not in linky or inside[b.path] and top != root and not out and k not in linky)


def _summed(pairs) -> dict[int, float]:
    out: dict[int, float] = {}
    for k, v in pairs:
        out[k] = out.get(k, 0) + v
    return out


def extract(pages: DataFrame, *, html: str = "html", share: float = SHARE, prior: float = PRIOR) -> DataFrame:
    """pages without `html`, with text and n_chars (code points)."""
    small_batches(spark_of(pages))
    columns = others(pages, html, "text", "n_chars")
    source = pages.select(*map(quoted, columns), quoted(html))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_chunks(batches, html, 2 << 20):
            texts = [main_text(x.as_py(), share, prior) for x in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return map_batches(source, each, schema)
