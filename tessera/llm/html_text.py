"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block elements (tag and class) from the root to it. Text
length, punctuation, link text and nodes are summed by path, and fused into one ratio: characters, times
punctuation marks a node, times the share of text outside links (marks count by that share, too). A path's ratio is smoothed over the paths near it in
the tree: those under the same parent, then those under the grandparent. Paths whose smoothed ratio reaches the
threshold, the standard deviation of all paths' ratios, are content, and their blocks are the main text. Nothing else
selects: no element or class name stands for the article.

What HTML itself declares not to be running text never becomes a path: navigation, page headers and footers, asides,
forms and their controls, scripts, styles, raw data, hidden elements, and elements with an ARIA role of that kind.

Paths are numbers with a parent, and open elements are found by tag, so time and memory are linear in the page however
deeply it nests.

Defined cases: null or empty html, or a page without text, gives an empty text; unclosed, unopened or unknown tags,
quotes and comments are read as browsers do in the main; repeated rows are harmless; other columns are ignored."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_rows, table
from tessera.operators.kept import dealt

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
LEFT_OUT = frozenset("head nav footer aside form button select option dialog menu object canvas audio video map fieldset label datalist".split())
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header hgroup address details summary center hr".split()) | LEFT_OUT
#: ARIA roles of parts that are not running text (fixed values of the standard).
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status log".split())
#: What an opening tag closes, and the elements that shelter from it.
P_SHELTER = frozenset("body article section main div td th li blockquote dd figure table".split())
CLOSES = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("thead tbody tr td th", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
SPACES = re.compile(r"\s+")
NAME, STOP = re.compile(r"/?[a-zA-Z][^\s/>]*"), re.compile(r"[>\"']")
END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
SHARE = 1.0  # of the standard deviation
FLOOR = 0.1  # marks a node of a text without any, so that a page without marks is still told by its length
WEIGHTS = (0.1, 0.7, 0.2)  # of a path's own ratio, its siblings' and its parent's siblings'


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text), ('open', tag, attributes) and ('close', tag) in page order, in time linear in the page."""
    at, n, lone, endless = 0, len(page), set(), set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = NAME.match(page, lt + 1)
        if not m:
            yield "text", "<", ""
            at = lt + 1
            continue
        end = m.end()
        while True:
            s = STOP.search(page, end)
            if not s:
                end = -1
                break
            if s[0] == ">":
                end = s.start()
                break
            close = -1 if s[0] in lone else page.find(s[0], s.end())
            if close < 0:
                lone.add(s[0])
                end = page.find(">", s.end())
                break
            end = close + 1
        if end < 0:
            yield "text", page[lt:], ""
            return
        tag = m[0].lower()
        at = end + 1
        if tag[0] == "/":
            yield "close", tag[1:], ""
        elif tag in RAW:
            if page[end - 1] != "/" or tag not in ("svg", "math"):
                close = None if tag in endless else END[tag].search(page, at)
                if close:
                    at = close.end()
                elif tag in ("noscript", "svg", "math", "template"):
                    endless.add(tag)  # nothing further on closes it either
                else:
                    at = n
        else:
            yield "open", tag, page[m.end() : end]


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's name in a path, and whether it is declared not to be running text."""
    if not attributes.strip(" /"):
        return tag, tag in LEFT_OUT
    found = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    name = " ".join(found.get("class", "").lower().split())
    return f"{tag}.{name}" if name else tag, tag in LEFT_OUT or hidden or found.get("role", "").lower() in ROLES


@dataclass
class Paths:
    """The paths of a page as a tree: each has its parent's number (0: the root) and its last label."""

    parent: list[int] = field(default_factory=lambda: [0])
    label: list[str] = field(default_factory=lambda: [""])
    known: dict[tuple[int, str], int] = field(default_factory=dict)

    def child(self, path: int, label: str) -> int:
        found = self.known.get((path, label))
        if found is None:
            found = self.known[path, label] = len(self.parent)
            self.parent.append(path)
            self.label.append(label)
        return found


def blocks(page: str) -> tuple[list[tuple[str, int, int]], Paths]:
    """(text, path, characters within links) of each block that may be running text, and the paths."""
    out: list[tuple[str, int, int]] = []
    paths = Paths()
    stack: list[tuple[str, int, bool]] = []  # tag, path, left out
    places: dict[str, list[int]] = defaultdict(list)  # where each tag is open in the stack
    block_places: list[int] = []
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = SPACES.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, stack[block_places[-1]][1] if block_places else 0, min(linked, len(text))))
        linked = 0

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def pop_to(i: int) -> None:
        if block_places and block_places[-1] >= i:
            flush()
        for t, _, _ in reversed(stack[i:]):
            places[t].pop()
        del stack[i:]
        while block_places and block_places[-1] >= i:
            block_places.pop()

    for kind, value, attributes in tokens(page):
        if kind == "text":
            if not (stack and stack[-1][2]):
                held.append(value)
                if places.get("a"):
                    linked += len(value.strip())
        elif kind == "open":
            if value == "br":
                held.append(" ")
                continue
            block = value in BLOCK
            if block:
                flush()
                closes, shelter = CLOSES.get(value, (("p",), P_SHELTER))
                while (i := last(closes)) > last(shelter):
                    pop_to(i)
            if value in VOID:
                continue
            label, left = _label(value, attributes)
            if value == "header" and not places.get("article") and not places.get("main"):
                left = True  # the page's own header
            path = stack[block_places[-1]][1] if block_places else 0
            if block:
                path = paths.child(path, label)
                block_places.append(len(stack))
            places[value].append(len(stack))
            stack.append((value, path, left or bool(stack and stack[-1][2])))
        else:
            i = places[value][-1] if places.get(value) else -1
            if i >= 0 and (value in BLOCK or not block_places or i > block_places[-1]):
                pop_to(i)
            elif value == "p":
                flush()
    flush()
    return out, paths


def fuse(chars: np.ndarray, marks: np.ndarray, nodes: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The ratio of paths (or groups of them) from their sums."""
    return chars * (FLOOR + marks / np.maximum(nodes, 1)) * (1 - linked / np.maximum(chars, 1))


def path_ratios(found: list[tuple[str, int, int]], paths: Paths) -> dict[int, float]:
    """The smoothed ratio of each path that has text."""
    owners = np.array([p for _, p, _ in found])
    own, at = np.unique(owners, return_inverse=True)
    values = np.array([(len(t), len(PUNCTUATION.findall(t)) * (1 - k / len(t)), 1, k) for t, _, k in found], float)
    sums = np.column_stack([np.bincount(at, values[:, k], len(own)) for k in range(4)])
    parent = np.asarray(paths.parent)
    up = parent[own]
    groups = np.column_stack([np.bincount(up, sums[:, k], len(parent)) for k in range(4)])  # by parent, the paths right under it
    ratio = fuse(*groups.T)
    weight = np.array([WEIGHTS] * len(own))
    weight[:, 2] *= groups[parent[up], 2] > 0
    weight[up == 0, 2] = 0
    levels = np.column_stack([fuse(*sums.T), ratio[up], ratio[parent[up]]])
    return dict(zip(own.tolist(), (levels * weight).sum(1) / weight.sum(1)))


def main_text(page: str | None) -> str:
    found, paths = blocks(page or "")
    if not found:
        return ""
    ratios = path_ratios(found, paths)
    threshold = SHARE * float(np.std(list(ratios.values())))
    return "\n\n".join(text for text, path, _ in found if ratios[path] >= threshold)


@F.arrow_udf(T.StringType())
def main_text_udf(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of ``pages`` (page_id, url, html)."""
    arrow_rows(pages.sparkSession)
    return pages.select("page_id", "url", main_text_udf(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(dealt(table(spark, sf_dir, "pages"))).withColumn("n_chars", F.length("text").cast("long"))
