"""Main text of web pages by composite text density.

A page is read into a tree that closes what authors leave open. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are told by their tags and by the names in their class, id
and role, and taken out. A name counts where it is a whole token or the first or last word of one; names of
states ("no-sidebar") and words that mean other things in compounds ("market-share") don't. An element that has
such a name, or is a form, but holds most of the page's text with its main heading or nearly all of its
paragraphs is a wrapper, and stays. Which of the rest is the article is decided by density alone, whatever the
elements are called: for every node, the characters for each tag are weighed by how little of them are links, and the
node with the largest sum of its children's densities is the densest part. Elements that only format text
(`INLINE`) and line breaks count as text of the node around them.

The path from the body to the densest part gives the thresholds. The outermost node on it, below the body,
that is no thinner than the body is taken whole, so short headings and last lines stay; in it, and beside it,
the lowest density on the path decides: parts beside it that reach this are taken too, by the densest node in
them, if its sum is a tenth (`BESIDE`) of the largest or more; parts inside that don't and are half links or
more are left out.

Defined cases: null, empty or tag-less html gives its plain text, null and empty the empty string;
a tie in the sums goes to the earlier node; repeated rows are read each on their own; an empty table
gives an empty result; other columns are ignored. After a tag whose quotes never end, quotes in tags mean nothing;
a tag that never ends is text. Text is never capped, and work grows linearly with the page, nested as it may be.
"""

from __future__ import annotations

import bisect
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_slices

# Element names by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CUT_TAGS = frozenset("head nav header footer aside form script style textarea title noscript iframe template svg canvas object select button input dialog menu audio video map noembed noframes search".split())
#: A new element of the key closes open elements of the value, up to the nearest element of SCOPES.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Words of class, id or role that mark what is no article text, and those that mark the article.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer contentinfo sidebar aside complementary widget widgets "
    "cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe signup login "
    "comment comments commentlist respond disqus discussion replies share sharing social related recommended pagination pager toolbar search".split()
)
ARTICLE_WORDS = frozenset("article main content post entry story articlebody".split())
#: Those of CUT_WORDS that count beside words of the article, too ("post-comments").
CUT_ANYWAY = frozenset("comment comments commentlist disqus nav navbar navigation menu breadcrumb breadcrumbs sidebar cookie cookies".split())
#: Those that count as whole tokens only, as compounds have other senses, and first words of names of states.
WHOLE_ONLY = frozenset("share sharing search notice notices social related replies promo respond discussion header login signup".split())
STATES = frozenset("has have no not is with without hide show".split())
COMMENTS = frozenset("comment comments commentlist disqus discussion replies respond".split())
CONTAINERS = frozenset(("article", "main"))
#: Share of the largest sum that a part beside the densest one must have.
BESIDE = 0.1
#: Elements that format text and are no nodes of their own for the densities.
INLINE = frozenset("b i u s em strong small big sub sup span font mark code kbd samp var cite q abbr dfn time br wbr tt ins del bdo bdi".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]*+)))?")
_NAMED = re.compile(r"class|id|role|hidden|style", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[a-z]+")

#: What an element is by its tag and names: article or unknown, no article text, or no article text unless it wraps the article.
OPEN, CLUTTER, NAMED, NAMED_COMMENTS = range(4)


def _cut_words(names: list[str]) -> set[str]:
    """The words by which class, id or role tell what is no article text."""
    tokens = [_WORDS.findall(_CAMEL.sub(" ", token).lower()) for name in names for token in name.split() if ":" not in token]
    article = any(len(words) == 1 and words[0] in ARTICLE_WORDS for words in tokens)
    found = set()
    for words in tokens:
        if not words or words[0] in STATES:
            continue
        if len(words) > 1 and not CUT_WORDS.issuperset(words):
            ends = ({words[0], words[-1]} & CUT_WORDS) - WHOLE_ONLY
            if words[-1] == "header" and words[0] in ("site", "page", "top", "global"):
                ends.add("header")
        else:
            ends = CUT_WORDS.intersection(words)
        found |= ends & CUT_ANYWAY if article or ARTICLE_WORDS.intersection(words) else ends
    return found


def kind_of_element(tag: str, attributes: str) -> int:
    """Whether an element is no article text by its tag, or by the names it has."""
    if tag == "form":
        return NAMED
    if tag in CUT_TAGS:
        return CLUTTER
    if not attributes or tag in ("html", "body") or not _NAMED.search(attributes):
        return OPEN
    values = {}
    for m in _ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    style = "".join(values.get("style", "").lower().split())
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return CLUTTER
    words = _cut_words([values.get(k, "") for k in ("class", "id", "role")])
    if tag in CONTAINERS:
        words &= COMMENTS | {"sidebar", "ad", "ads", "advert", "adverts", "advertisement", "advertising"}
    return NAMED_COMMENTS if words & COMMENTS else NAMED if words else OPEN


class Page:
    """Nodes in page order with their parents; text runs and block borders in page order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.kinds = ["#"], [-1], [OPEN]
        self.runs: list[tuple[int, str | None]] = []  # a None text is the border of a block
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}  # where each tag is open in the stack, outermost first
        self.block_depths: list[int] = []
        at = start = 0  # where to look on, and where the text begins that is not taken yet
        last, pattern = source.rfind(">"), _TAG
        while (at := source.find("<", at)) >= 0:
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                found, end = None, len(source) if end < 0 else end + 3
            elif at > last:
                break
            elif source.startswith(("<!", "<?"), at):
                found, end = None, source.find(">", at + 2) + 1
            else:
                found = pattern.match(source, at)
                if not found:
                    found = _PLAIN_TAG.match(source, at)
                    if not found:
                        at += 1
                        continue
                    pattern = _PLAIN_TAG
                end = found.end()
            if at > start:
                self._text(source[start:at])
            at = start = end
            if not found:
                continue
            name, attributes = found[2].lower(), found[3]
            if found[1]:
                self._close(name)
                continue
            self._open(name, attributes)
            if name in RAW and not attributes.endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = start = close.start() if close else len(source)
        if start < len(source):
            self._text(source[start:])

    def _text(self, text: str) -> None:
        self.runs.append((self.stack[-1], html.unescape(text) if "&" in text else text))

    def _border(self, tag: str) -> None:
        if tag in BLOCKS:
            self.runs.append((self.stack[-1], None))

    def _push(self, node: int) -> None:
        tag = self.tags[node]
        self.depths.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.block_depths.append(len(self.stack))
        self.stack.append(node)

    def _pop_to(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self._border(self.tags[node])
        for node in reversed(self.stack[depth:]):
            tag = self.tags[node]
            self.depths[tag].pop()
            if tag in BLOCKS:
                self.block_depths.pop()
        del self.stack[depth:]

    def _nearest(self, tag: str) -> int:
        """Depth of the innermost open element of a tag, 0 where none is."""
        open_at = self.depths.get(tag)
        return open_at[-1] if open_at else 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:  # a block ends the open paragraph
            self._end_nearest({"p"}, {"table", "td", "th", "button", "object", "caption"})
        if tag in CLOSES:
            self._end_nearest(CLOSES[tag], SCOPES[tag])
        self._border(tag)
        if tag == "br":
            self.runs.append((self.stack[-1], " "))
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.kinds.append(kind_of_element(tag, attributes))
        if tag not in VOID and not attributes.endswith("/"):
            self._push(len(self.tags) - 1)
        elif tag not in VOID:
            self._border(tag)

    def _end_nearest(self, tags: set[str], scope: set[str]) -> None:
        """Close the outermost of `tags` that is open inside the nearest element of `scope`."""
        border = max(map(self._nearest, scope))
        cut = len(self.stack)
        for tag in tags:
            open_at = self.depths.get(tag)
            if open_at and open_at[-1] > border:
                cut = min(cut, open_at[bisect.bisect_right(open_at, border)])
        if cut < len(self.stack):
            self._pop_to(cut)

    def _close(self, tag: str) -> None:
        depth = self._nearest(tag)
        # An inline end does not close blocks.
        if depth and (tag in BLOCKS or not self.block_depths or depth > self.block_depths[-1]):
            self._pop_to(depth)

    def _cut(self) -> list[bool]:
        """Which elements are clutter, or inside it; those that have its names but wrap the article are not."""
        n = len(self.tags)
        cut = [kind == CLUTTER for kind in self.kinds]
        for k in range(1, n):
            cut[k] = cut[k] or cut[self.parents[k]]
        chars, paragraphs, headed = [0] * n, [0] * n, [False] * n
        for k, text in self.runs:
            if text and not cut[k]:
                chars[k] += len("".join(text.split()))
        for k in range(n - 1, 0, -1):
            if not cut[k]:
                up = self.parents[k]
                chars[up] += chars[k]
                paragraphs[up] += paragraphs[k] + (self.tags[k] == "p")
                headed[up] |= headed[k] or self.tags[k] in ("h1", "article", "main")
        for k in range(1, n):
            if self.kinds[k] in (NAMED, NAMED_COMMENTS):
                wraps = headed[k] and 2 * chars[k] > chars[0] or self.kinds[k] == NAMED and paragraphs[k] > 1 and 10 * chars[k] >= 9 * chars[0]
                cut[k] = cut[k] or not wraps
            cut[k] = cut[k] or cut[self.parents[k]]
        return cut

    def main_text(self) -> str:
        n = len(self.tags)
        cut, nodes = self._cut(), [tag not in INLINE for tag in self.tags]
        chars, tags, link_chars, link_tags, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for k in range(1, n):
            in_link[k] = self.tags[k] == "a" or in_link[self.parents[k]]
        for k, text in self.runs:
            if text and not cut[k]:
                size = len("".join(text.split()))
                chars[k] += size
                link_chars[k] += size * in_link[k]
        for k in range(n - 1, 0, -1):
            if not cut[k]:
                up = self.parents[k]
                chars[up] += chars[k]
                link_chars[up] += link_chars[k]
                tags[up] += tags[k] + nodes[k]
                link_tags[up] += link_tags[k] + (self.tags[k] == "a")
        body = next((k for k in range(n) if self.tags[k] == "body"), 0)
        body = body if chars[body] == chars[0] else 0
        share = link_chars[body] / max(1, chars[body])

        def density(k: int) -> float:
            if not chars[k]:
                return 0.0
            c, t, lc, lt = chars[k], max(1, tags[k]), max(1, link_chars[k]), max(1, link_tags[k])
            base = math.log(c / max(1, c - link_chars[k]) * link_chars[k] + share * c + math.e)
            return c / t * math.log(c / lc * t / lt + 1) / max(0.1, math.log(base + 0.1))

        densities = [density(k) if nodes[k] and not cut[k] else 0.0 for k in range(n)]
        sums, owner = [0.0] * n, list(range(n))  # the node that holds each element's text
        for k in range(1, n):
            up = owner[self.parents[k]]
            if nodes[k]:
                sums[up] += densities[k]
            else:
                owner[k] = up
        # The sum of a node that has text but no nodes below is its own density.
        sums = [s or d for s, d in zip(sums, densities, strict=True)]
        best = max((k for k in range(body, n) if nodes[k] and not cut[k]), key=lambda k: (sums[k], -k), default=body)
        path = [best]
        while path[-1] > body:
            path.append(self.parents[path[-1]])
        path = [k for k in path if nodes[k]]
        threshold = min(densities[k] for k in path)
        top = next((k for k in reversed(path[:-1]) if densities[k] >= densities[path[-1]]), best)
        return self._joined(self._kept(top, set(path), body, threshold, densities, sums, [2 * l >= c for l, c in zip(link_chars, chars, strict=True)], nodes, cut))

    def _kept(self, top: int, path: set[int], body: int, threshold: float, densities: list[float], sums: list[float], linked: list[bool], nodes: list[bool], cut: list[bool]) -> list[bool]:
        """Which elements' text stays: `top`, and the densest nodes of dense parts beside the path; without thin parts made of links."""
        n = len(self.tags)
        most = list(sums)  # the largest sum in each subtree
        for k in range(n - 1, 0, -1):
            most[self.parents[k]] = max(most[self.parents[k]], most[k])
        kept, dense = [False] * n, [False] * n
        for k in range(body, n):
            up = self.parents[k]
            if cut[k]:
                continue
            if k == top or k != body and kept[up]:
                thin = nodes[k] and k != top and k not in path and self.tags[k] in BLOCKS and densities[k] < threshold and linked[k]
                kept[k] = not thin
                continue
            dense[k] = k == body or dense[up] and densities[k] >= threshold > 0
            if dense[k] and k not in path and sums[k] >= max(most[k], BESIDE * most[body]):
                kept[k] = True
        return kept

    def _joined(self, keep: list[bool]) -> str:
        blocks, own = [], []
        for node, text in self.runs:
            if text is None:
                blocks.append("".join(own))
                own = []
            elif keep[node]:
                own.append(text)
        blocks.append("".join(own))
        return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract_text(pages: DataFrame, key: str = "page_id", html_column: str = "html") -> DataFrame:
    """key, text and n_chars (code points) of every page."""

    def run(batches):
        for batch in text_slices(batches):
            found = [main_text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != 1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*(c for i, c in enumerate(batch.schema.names) if i != 1), "text", "n_chars"])

    kinds = dict(pages.dtypes)
    others = [c for c in ("url",) if c in kinds]
    return pages.select(key, F.col(html_column).alias("text"), *others).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [key, *others]) + ", text string, n_chars bigint")
