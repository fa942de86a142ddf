"""HTML extraction by composite text density.

For each DOM node, from the characters C, tags T, link characters L and link tags K of its subtree (each at least 1 where it
divides) and the body's share of link characters r:

    density = C / T * log(C * T / (L * K)) / log(log(C * L / (C - L) + r * C + e))

so text with few tags and few links is dense. The density sum of a node is the sum of its children's densities. The node
with the greatest sum is found, and the least density on its path to the body is the threshold. Each child of the body with a density of
at least the threshold gives the greatest-sum node of its subtree, whose text is taken if that sum reaches the threshold too (single
blocks of text beside the main subtree, such as advertisements, have no such sum). Where the body itself has the greatest sum, its
children at or above the threshold are the text. If nothing reaches the threshold the greatest-sum node is taken.

Pages without a body element use the whole document. Null and empty pages, and pages without text, give an empty text. Script, style, head, and
comments have no text. Of equal sums the node that comes first counts. All rows stay, repeated ones with equal results, and an empty table gives an empty one; columns but page_id, url and html
are left out. Each page, however long, is one row of Python work inside Arrow batches, without a shuffle. A slash at the end of a tag closes nothing, as in HTML.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import read, slices

_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""  # up to the first > that is in no quoted value; a quote that is never closed quotes nothing
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head|title|svg)\b" + _REST + r".*?(?:</\1\s*>|\Z)|<!?/?([a-zA-Z][a-zA-Z0-9:-]*)" + _REST + r"|<[!?][^>]*>", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul tr td th dt dd br".split())
_CLOSES = {"p": _BLOCKS - {"br"}, "li": frozenset(["li"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
_INLINE = frozenset("b i em strong a span u s small big sub sup font code tt".split())
_SPACE = re.compile(r"\s+")


class Dom:
    """Nodes in document order: parent, tag, and pieces of (node, text)."""

    def __init__(self, page: str):
        self.tags, self.parents, self.pieces = ["#root"], [-1], []
        stack, at = [0], 0
        tags, parents = self.tags, self.parents
        for m in _TOKEN.finditer(page):
            start = m.start()
            if start > at:
                self._text(stack[-1], page[at:start])
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if page[start + 1] == "/":
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if page[start + 1] == "!":
                continue
            depth = len(stack) - 1  # an open element that this one ends, perhaps below open inline elements
            while depth > 0 and tags[stack[depth]] in _INLINE:
                depth -= 1
            closes = _CLOSES.get(tags[stack[depth]])
            if closes and name in closes:
                del stack[depth:]
            tags.append(name)
            parents.append(stack[-1])
            if name not in _VOID:
                stack.append(len(tags) - 1)
        if at < len(page):
            self._text(stack[-1], page[at:])

    def _text(self, node: int, raw: str) -> None:
        if "&" in raw:
            raw = html_lib.unescape(raw)
        self.pieces.append((node, _SPACE.sub(" ", raw)))


def extract(page: str) -> tuple[str, str, float, float]:
    """Text, tag path of the greatest-sum node, its density sum, and the threshold."""
    dom = Dom(page)
    tags, parents = dom.tags, dom.parents
    n = len(tags)
    body = next((i for i, t in enumerate(tags) if t == "body"), 0)
    chars, count, links, link_tags = [0] * n, [1] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parents[i]] or tags[i] == "a"
        link_tags[i] = int(tags[i] == "a")
    for node, text in dom.pieces:
        size = len(text.strip())
        chars[node] += size
        if in_link[node]:
            links[node] += size
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        count[p] += count[i]
        links[p] += links[i]
        link_tags[p] += link_tags[i]
    if not chars[body]:
        return "", "", 0.0, 0.0
    share, log = links[body] / chars[body], math.log
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        c, t, k = chars[i], count[i], links[i]
        if c:
            inside = c * t / (max(k, 1) * max(link_tags[i], 1))
            base = log(log(c * k / max(c - k, 1) + share * c + math.e) + 1e-9)
            density[i] = c / t * log(inside) / max(base, 1e-3) if inside > 1 else 0.0
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        sums[parents[i]] += density[i]
        children[parents[i]].append(i)
    last = [i for i in range(n)]  # last node of each subtree; a subtree is a range in document order
    for i in range(n - 1, 0, -1):
        last[parents[i]] = max(last[parents[i]], last[i])
    top = max(range(body, last[body] + 1), key=lambda i: (sums[i], -i))
    if sums[top] == 0.0:
        top = body
    threshold, node, path = density[top], top, [tags[top]]
    while node != body:
        node = parents[node]
        path.append(tags[node])
        threshold = min(threshold, density[node])
    chosen: list[int] = []
    for i in children[body]:
        if chars[i] and density[i] >= threshold:
            best = max(range(i, last[i] + 1), key=lambda j: (sums[j], -j)) if children[i] else i
            if top == body or sums[best] >= threshold:
                chosen.append(best if sums[best] > 0 else i)
    if not chosen:
        chosen = [top]
    out: list[str] = []
    spans = [(i, last[i]) for i in chosen]
    s = 0
    before = -1
    for node, text in dom.pieces:
        if s < len(spans):
            while s < len(spans) and node > spans[s][1]:
                s += 1
        if any(a <= node <= b for a, b in spans[max(0, s - 1) : s + 1]):
            if before >= 0 and any(tags[j] in _BLOCKS for j in _between(parents, before, node)):
                out.append("\n")
            out.append(text)
            before = node
    text = "\n".join(x for x in (_SPACE.sub(" ", line).strip() for line in "".join(out).split("\n")) if x)
    return text, "/".join(reversed(path)), sums[top], threshold


def _between(parents: list[int], a: int, b: int) -> Iterator[int]:
    """Nodes that lie on only one of the ways from a and b to the root, or between them in document order."""
    if b > a:
        yield from range(a + 1, b + 1)
    x, y = a, b
    while x != y:
        if x > y:
            yield x
            x = parents[x]
        else:
            yield y
            y = parents[y]


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, node, density_sum, threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = [extract(p) for p in batch.column(2).to_pylist()]
            text, node, sums, threshold = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int32()), pa.array(node, pa.string()), pa.array(sums, pa.float64()), pa.array(threshold, pa.float64())], ["page_id", "url", "text", "n_chars", "node", "density_sum", "threshold"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars int, node string, density_sum double, threshold double")


def op6_html_density(spark, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
