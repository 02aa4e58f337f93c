"""Main text of web pages by composite text density.

A page is read into its element tree, without what is never text of an article
(scripts, styles, forms, menus, headers, footers, side bars, notices, adverts and
reader comments, told by their tags and by names in class, id and role, which must be such a word
in full; inside an article only elements that hold others are, and words of wider
use count only where half of the text is links). For every node the link-adjusted density is computed from characters, tags,
characters in links and link tags below it. The node whose children's densities
sum to the most is the core; the lowest density on its path to the body is the
threshold, and subtrees beside that path with at least that density belong to
the text as well. A core inside an article or main element stands for all of it.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined in page order by a line end.

Defined cases: null or empty html, or a page without text, gives an empty
string; unclosed and stray tags are closed or ignored as browsers do in the
simple cases; only a script or style without an end takes the rest of the page
with it; a head ends where the first thing stands that it cannot hold; a page
without a body element is read as one; of nodes with equal sums the last is the
core; very long pages are read whole; a column that is called like the one made is
replaced, all others pass unchanged; repeated rows are read alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.llm.common import fresh, kept, table

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
_WORDS = re.compile(r"[a-z]+|[0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noframes svg select".split())
_DROPPED = frozenset("nav footer aside form button dialog menu object video audio canvas head".split())
#: What a head may hold; anything else closes it.
_HEAD = frozenset("base link meta title style script noscript template".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Opening the first closes an open one of the second, up to the third.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Words of class, id or role that mark what does not belong to an article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal overlay nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer comment comments commentlist disqus respond replies social newsletter subscribe signup pagination pager "
    "toolbar".split())
#: The same, but an article may use them of its own text.
_WIDER = frozenset("alert aside banner login menu notice notices promoted promotion recommended related reply search share sharing skip widget".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies reply".split())
_MASTHEAD = frozenset("header masthead topbar banner".split())
#: Words that may stand beside them in a name.
_LAYOUT = frozenset(
    "area bar block body box button buttons col column container content div form group holder inner item items left list main module outer panel "
    "primary right row secondary section site slot top bottom unit wrap wrapper page footer header".split())
#: Elements that may be told by such names inside an article: they hold other blocks, not text itself.
_HOLDERS = frozenset("div section ul ol dl table article main details fieldset span header center figure".split())
_WHOLE = ("article", "main")


def _marks(attributes: str) -> set[str]:
    """The marking words of those names in class, id and role that hold nothing
    else but words of layout: "cookie-notice", but not "notice-of-meeting"."""
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() not in ("class", "id", "role"):
            continue
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(_WORDS.findall(name))
            marks = words & (_MARKS | _WIDER | _MASTHEAD)
            if marks and all(w in marks or w in _LAYOUT or w.isdigit() for w in words):
                found |= marks
    return found


def _hides(attributes: str) -> bool:
    """A hidden attribute of that name, aria-hidden, or display: none in the style."""
    if not _MAY_HIDE.search(attributes):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if (name == "hidden" and value != "false") or (name == "aria-hidden" and value == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
    return False


class _Page:
    """The element tree as parallel lists; a parent stands before its children."""

    def __init__(self, page: str):
        self.tag, self.parent = ["body"], [-1]
        self.doubtful: list[int] = []
        self.blocks: list[list] = []  # [node, pieces, characters, characters in links]
        self._stack: list[tuple[str, int]] = [("body", 0)]  # dropped elements have node -1
        self._open: Counter = Counter()  # how many elements of each name the stack has
        self._block: list | None = None
        self._read(page)

    def _read(self, page: str) -> None:
        at = 0
        while True:
            m = _TAG.search(page, at)
            self._text(page[at : m.start() if m else len(page)])
            if m is None:
                return
            at = m.end()
            name = m["name"] or m["name2"]
            if name is None:
                continue
            name = name.lower()
            if m["end"] or m["end2"]:
                self._end(name)
                continue
            attributes = m["attributes"] if m["name"] else m["attributes2"]
            if name in _RAW and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page) if name in ("script", "style") else at
                continue
            self._start(name, attributes)

    def _start(self, name: str, attributes: str) -> None:
        if self._open["head"] and name not in _HEAD and name != "html":
            self._close({"head"}, frozenset())
        if name in ("html", "body"):
            return
        if name in _BLOCKS:
            self._block = None
            self._close({"math"}, frozenset())
            self._close({"p"}, _BLOCKS - {"p"})
        if name in _CLOSES:
            self._close(*_CLOSES[name])
        above = self._stack[-1][1]
        if name in _VOID:
            if above >= 0:
                self._add(name, above)
                if name == "br":
                    self._text(" ")
            return
        dropped = above < 0 or self._drops(name, attributes)
        # a formula's elements are no tags of the text around it
        formula = name == "math" or self._open["math"]
        doubtful = not dropped and not formula and self._doubtful(name, attributes)
        self._stack.append((name, -1 if dropped else above if formula else self._add(name, above)))
        if doubtful:
            self.doubtful.append(self._stack[-1][1])
        self._open[name] += 1

    def _cut(self, k: int) -> None:
        for name, _ in self._stack[k:]:
            self._open[name] -= 1
        del self._stack[k:]

    def _add(self, name: str, above: int) -> int:
        self.tag.append(name)
        self.parent.append(above)
        return len(self.tag) - 1

    def _drops(self, name: str, attributes: str) -> bool:
        if name in _DROPPED:
            return True
        inside = any(self._open[n] for n in _WHOLE)
        if name == "header" and not inside:
            return True
        if not attributes or attributes.isspace():
            return False
        if _hides(attributes):
            return True
        marks = _marks(attributes)
        if name in _WHOLE and not inside:
            return bool(marks & _COMMENTS)
        if inside and name not in _HOLDERS:
            return False
        return bool(marks & _MARKS) or (not inside and bool(marks))

    def _doubtful(self, name: str, attributes: str) -> bool:
        """Inside an article, is it told by words of wider use only?"""
        return name in _HOLDERS and bool(attributes) and bool(_marks(attributes) & _WIDER) and any(self._open[n] for n in _WHOLE)

    def _close(self, which, upto) -> None:
        if not any(self._open[n] for n in which):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            name = self._stack[k][0]
            if name in which:
                self._cut(k)
                self._block = None
                return
            if name in upto:
                return

    def _end(self, name: str) -> None:
        if name in _BLOCKS:
            self._block = None
        if not self._open[name]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == name:
                self._cut(k)
                return
            # an inline end tag does not close a block around it
            if name not in _BLOCKS and self._stack[k][0] in _BLOCKS:
                return

    def _text(self, raw: str) -> None:
        if self._stack[-1][0] == "head" and not raw.isspace() and raw:
            self._close({"head"}, frozenset())
        if not raw or self._stack[-1][1] < 0:
            return
        text = _html.unescape(raw) if "&" in raw else raw
        n = len("".join(text.split()))
        node = self._stack[-1][1]
        if not n and self._block is None:
            return
        if self._block is None:
            self._block = [[], []]
            self.blocks.append(self._block)
        self._block[0].append(text)
        if n:
            self._block[1].append((node, n, self._open["a"] > 0))

    def _counts(self, gone: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
        """Characters, tags, characters in links and link tags below every node."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for _, pieces in self.blocks:
            for node, k, linked in pieces:
                if not gone[node]:
                    chars[node] += k
                    link_chars[node] += k if linked else 0
        for i in range(n - 1, 0, -1):
            if gone[i]:
                continue
            p = self.parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        return chars, tags, link_chars, link_tags

    def main_text(self) -> str:
        n = len(self.tag)
        gone = [False] * n
        chars, tags, link_chars, link_tags = self._counts(gone)
        if self.doubtful:
            for i in self.doubtful:
                gone[i] = 2 * link_chars[i] >= chars[i]
            for i in range(1, n):
                gone[i] = gone[i] or gone[self.parent[i]]
            chars, tags, link_chars, link_tags = self._counts(gone)
        if not chars[0]:
            return ""
        share = link_chars[0] / chars[0]

        def density(i: int) -> float:
            c, lc = chars[i], link_chars[i]
            if not c:
                return 0.0
            t, lt = max(1, tags[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            return c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + 1e-9) / math.log(max(base, 1 + 1e-9))

        d = [density(i) for i in range(n)]
        sums = [0.0] * n
        for i in range(1, n):
            if not gone[i]:
                sums[self.parent[i]] += d[i]
        core = max(range(n), key=lambda i: (sums[i], i))
        if not sums[core]:
            core = 0
        path = [core]
        while path[-1]:
            path.append(self.parent[path[-1]])
        whole = next((i for i in path if self.tag[i] in _WHOLE), None)
        threshold = min(d[i] for i in path)
        if whole is not None:
            path = path[path.index(whole) :]
        taken = [False] * n
        taken[path[0]] = True
        on_path = set(path)
        for i in range(1, n):
            p = self.parent[i]
            beside = p in on_path and p != path[0] and i not in on_path
            taken[i] = not gone[i] and (taken[i] or taken[p] or (beside and d[i] >= threshold and 2 * link_chars[i] <= chars[i]))
        out = []
        for texts, pieces in self.blocks:
            if any(taken[node] for node, _, _ in pieces):
                line = " ".join("".join(texts).split())
                if line:
                    out.append(line)
        return "\n".join(out)


def main_text(page: str | None) -> str:
    return _Page(page).main_text() if page else ""


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, out: str = "text") -> DataFrame:
    """The columns ``keep`` (all but the html, if None) and the main text."""
    keep = [c for c in kept(pages, keep, out) if keep is not None or c != html_col]
    source = pages.select(*keep, F.col(html_col).cast("string").alias(fresh(keep, "html_")))
    n = len(keep)

    def run(batches):
        for b in batches:
            text = [main_text(x) for x in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(text, pa.string())], names=[*keep, out])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:n], T.StructField(out, T.StringType())]))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract_main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
