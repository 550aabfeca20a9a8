"""Main text of web pages by tag-path ratios.

The text of a page is cut into blocks, each with its root-to-leaf tag path. For every
path, the length of its text and its punctuation are added up over the page and divided
by the number of its blocks. Both ratios are smoothed along the page, fused by product
and thresholded; the containers of the paths above the threshold that hold a fair share of
their text are the content. The text is their blocks above the threshold, and of the others
those that are not mostly links, and what is above the threshold between such containers.
Elements that are never content (scripts, forms, menus) go before. Classes, ids and roles
only weigh a block's score: words for what surrounds articles nearly always (comments,
notices, adverts) leave a twentieth of it, others that a section of an article may well
have (related, social, search) nine tenths, so prose below them stays above the threshold
and lists of links do not.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
)
_ATTR = re.compile(r"([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))|([^\s=\"'/]++)")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; it ends at their own end tag only.
_RAW = frozenset("script style textarea title xmp noembed iframe noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody"
    " td tfoot th thead title tr ul".split()
)
_NEVER = frozenset(
    "head script style noscript template nav aside footer form button select textarea input label iframe object svg canvas menu"
    " dialog noembed noframes option datalist audio video map title".split()
)
#: Words of class, id and role for parts that surround an article, and for parts that may belong to one.
_AROUND = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notice|alert"
    r"|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side|aside|widget|toolbar|masthead|footer|copyright|complementary"
    r"|contentinfo|comments?|commentlist|disqus|replies|reply|respond|reader-comments|newsletter|subscribe|subscription|signup|login|popup"
    r"|modal|overlay|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
_PERHAPS = re.compile(r"(?:^|[\s_-])(?:foot|share|sharing|social|related|recommend(?:ed|ations)?|skip|hidden|search|tags)(?=$|[\s_-])", re.I)
#: Classes of an article that tell what it has or is about, not what it is.
_ABOUT = re.compile(r"(?:has|with|no|without|category|tag|type|status|format)-", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header|top-?bar)(?=$|[\s_-])", re.I)
#: Which open elements the start of one ends, up to the nearest of the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_SCOPE = frozenset("html body table td th caption button object template".split())
_INLINE_ENDS = frozenset("a b big code em font i s small strike strong tt u span".split())


#: Shares of the score that are left where class, id or role hint at such parts.
AROUND, PERHAPS = 0.05, 0.9
#: The share that is left outside of article and main elements that hold most of the text.
OUTSIDE = 0.05


def _weight(tag: str, attrs: str, inside: bool) -> float:
    """1, or less where the attributes hint at what is not content; 0 if it never is, as nothing that cannot be seen is."""
    if tag in _NEVER or tag == "header" and not inside:
        return 0.0
    weight = 1.0
    if not attrs or tag in ("html", "body"):
        return weight
    for m in _ATTR.finditer(attrs):
        name = (m[1] or m[5] or "").lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "class" and tag in ("article", "main"):
            value = " ".join(x for x in value.split() if not _ABOUT.match(x))
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 0.0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 0.0
        if name not in ("class", "id", "role"):
            continue
        around = _AROUND.search(value) or not inside and _HEADER.search(value)
        if name != "id" and around:
            # A piece inside a block that is no part of its text, as a button is none.
            weight = min(weight, AROUND if tag in _BLOCK else 0.0)
        elif around or _PERHAPS.search(value):
            if name != "id" or tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):  # ids of headings are words of their texts
                # A whole article that is related to something is not the page's own.
                weight = min(weight, AROUND if name != "id" and tag in ("article", "main") else PERHAPS)
    return weight


class Paths:
    """Tag paths as a tree: a path is the number of its last node, 0 the empty one; a child's number is above its parent's."""

    def __init__(self):
        self.parent, self.label, self.depth = [0], [""], [0]
        #: Of each path: the nearest container, the outermost article or main (0 without), and the first two elements.
        self.box, self.first, self.top = [0], [0], [0]
        self._at: dict[tuple[int, str], int] = {}

    def child(self, node: int, tag: str, number: int) -> int:
        """``tag`` below ``node``; containers are told apart by their number, other elements of one tag are one path."""
        holds = tag in ("div", "section", "article", "main")
        label = f"{tag}#{number}" if holds else tag
        found = self._at.get((node, label))
        if found is None:
            found = self._at[node, label] = len(self.parent)
            self.parent.append(node)
            self.label.append(label)
            self.depth.append(self.depth[node] + 1)
            self.box.append(found if holds else self.box[node])
            self.first.append(self.first[node] or (found if tag in ("article", "main") else 0))
            self.top.append(found if self.depth[found] <= 2 else self.top[node])
        return found

    def common(self, nodes: list[int]) -> int:
        """The longest path that all ``nodes`` begin with."""
        n = [0] * len(self.parent)
        for x in nodes:
            n[x] += 1
        for x in range(len(n) - 1, 0, -1):
            n[self.parent[x]] += n[x]
        return max((x for x in range(len(n)) if n[x] == len(nodes)), key=self.depth.__getitem__)

    def along(self, nodes: list[int]) -> list[bool]:
        """Whether each path begins with one of ``nodes`` or is the beginning of one."""
        out = [False] * len(self.parent)
        for x in nodes:
            out[x] = True
        for x in range(len(out) - 1, 0, -1):
            out[self.parent[x]] |= out[x]
        held = set(nodes)
        under = [0 in held] * len(out)
        for x in range(1, len(out)):
            under[x] = x in held or under[self.parent[x]]
        return [a or b for a, b in zip(out, under)]

    def below(self, root: int) -> list[bool]:
        """Whether each path begins with ``root``."""
        out = [root == 0]
        for x in range(1, len(self.parent)):
            out.append(x == root or out[self.parent[x]])
        return out


class _Open:
    """The open elements, with the places of each tag, so that no step looks through all of them."""

    def __init__(self, paths: Paths):
        self.paths, self.all, self.blocks, self.made = paths, [], [], 0
        self.at: dict[str, list[int]] = defaultdict(list)

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def weight(self) -> float:
        return self.all[-1][1] if self.all else 1.0

    def push(self, tag: str, ok: float) -> None:
        self.made += 1
        self.at[tag].append(len(self.all))
        if tag in _BLOCK:
            self.blocks.append(len(self.all))
        self.all.append([tag, ok, self.paths.child(self.all[-1][2] if self.all else 0, tag, self.made), True])

    def cut(self, upto: int) -> None:
        """Close all from place ``upto`` on."""
        while len(self.all) > upto or self.all and not self.all[-1][3]:
            tag, _, _, live = self.all.pop()
            if live:
                self.at[tag].pop()
                if tag in _BLOCK:
                    self.blocks.pop()

    def drop(self, place: int) -> None:
        """Close one formatting element below others."""
        self.all[place][3] = False
        self.at[self.all[place][0]].pop()


def blocks(html: str) -> tuple[list[tuple[int, str, float, int]], Paths]:
    """(path, text, weight or 0 if it cannot be content, characters in links) of each block, in page order, and the paths.

    One pass; time and memory are in proportion to the page, whatever its depth and
    however many tags are left open.
    """
    out: list[tuple[int, str, float, int]] = []
    paths = Paths()
    stack = _Open(paths)
    text: list[str] = []
    said, path, ok, links = False, 0, 1.0, 0

    def flush() -> None:
        nonlocal said, links
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined:
            out.append((path, joined, ok, links))
        text.clear()
        said, links = False, 0

    def say(s: str) -> None:
        nonlocal said, path, ok, links
        if not s:
            return
        if not said:
            path, ok = (stack.all[stack.blocks[-1]][2], stack.all[stack.blocks[-1]][1]) if stack.blocks else (0, 1.0)
        if ok and not stack.weight():
            return  # a button or the like inside a block
        s = unescape(s)
        text.append(s)
        said = said or not s.isspace()
        if stack.at["a"]:
            links += len(s)

    def close(upto: int) -> None:
        if stack.blocks and stack.blocks[-1] >= upto:
            flush()
            # Formatting elements left open go on after the block.
            again = [x[0] for x in stack.all[upto + 1 :] if x[3] and x[0] in _INLINE_ENDS and x[0] != "a"]
            stack.cut(upto)
            for tag in again[:8]:
                stack.push(tag, stack.weight())
        else:
            stack.cut(upto)

    at, last = 0, html.rfind(">")
    while True:
        m = _MARKUP.search(html, at)
        while m and m.start() > last and m[0] not in ("<!--", "<![CDATA[", "<!", "<?"):
            m = _MARKUP.search(html, m.end())  # no tag ends after this place
        t = None
        if m and m[0][-1].isalpha():
            t = _TAG.match(html, m.start())
        say(html[at : m.start()] if m else html[at:])
        if not m:
            break
        if not t:
            end = "-->" if m[0] == "<!--" else "]]>" if m[0] == "<![CDATA[" else ">"
            stop = html.find(end, m.end())
            if m[0] == "<![CDATA[":
                say(html[m.end() : stop if stop >= 0 else len(html)])
            at = stop + len(end) if stop >= 0 else len(html)
            continue
        at = t.end()
        tag, attrs = (t[2] or t[5]).lower(), (t[3] if t[2] else t[6]) or ""
        if t[1] or t[4]:
            if tag == "br":
                text.append(" ")
            place = stack.last((tag,))
            held = tag not in ("table", "tr", "td", "th", "tbody", "body", "html") and stack.last(("td", "th", "table")) > place
            if place >= 0 and not held:
                if tag in _BLOCK or not (stack.blocks and stack.blocks[-1] > place):
                    close(place)
                else:
                    stack.drop(place)  # </b> across blocks ends the formatting alone
            continue
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        inside = stack.last(("article", "main")) >= 0
        if tag in _BLOCK:
            place = stack.last(("p",))
            if place > stack.last(_SCOPE):
                close(place)
            if tag in _ENDS:
                ends, scope = _ENDS[tag]
                place = stack.last(ends)
                if place > stack.last(scope):
                    close(place)
            flush()
        weight = min(stack.weight(), _weight(tag, attrs, inside))
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            stop = html.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else len(html)
            continue
        if attrs.endswith("/") and tag in ("path", "use", "circle", "rect"):
            continue
        stack.push(tag, weight)
    flush()
    return out, paths


def _smooth(x: list[float]) -> list[float]:
    """Gaussian weights over two neighbours on each side."""
    w = (0.06136, 0.24477, 0.38774, 0.24477, 0.06136)
    n = len(x)
    return [sum(w[k + 2] * x[i + k] for k in range(-2, 3) if 0 <= i + k < n) / sum(w[k + 2] for k in range(-2, 3) if 0 <= i + k < n) for i in range(n)]


def main_blocks(found: list[tuple[int, str, float, int]], paths: Paths, threshold: float) -> list[str]:
    """Texts of the content blocks."""
    ok = [b for b in found if b[2]]
    if not ok:
        return []
    chars, marks, count, links = (defaultdict(float) for _ in range(4))
    for path, text, _, link in ok:
        chars[path] += len(text)
        marks[path] += len(_PUNCT.findall(text))
        links[path] += link
        count[path] += 1
    long = _smooth([math.log1p(chars[b[0]] / count[b[0]]) for b in ok])
    marked = _smooth([math.log1p(marks[b[0]] / count[b[0]]) for b in ok])
    ratios = [a * (0.2 + b) * (1 - min(1.0, links[x[0]] / max(1.0, chars[x[0]]))) for a, b, x in zip(long, marked, ok)]
    part = lambda p: paths.box[p] or paths.top[p]

    def scored(weights: list[float]) -> tuple[list[float], float, dict[int, float]]:
        """Scores of blocks, the threshold among them, and the best score of each path."""
        fused = [r * w for r, w in zip(ratios, weights)]
        best: dict[int, float] = defaultdict(float)
        for f, x in zip(fused, ok):
            best[x[0]] = max(best[x[0]], f)
        return fused, threshold * max(fused), best

    weights = [b[2] for b in ok]
    fused, limit, best = scored(weights)
    # Article and main elements that hold most of what is above the threshold, and each a fair
    # share of it, weigh down what is outside of them.
    held: dict[int, float] = defaultdict(float)
    for p in best:
        held[paths.first[p]] += chars[p] if best[p] >= limit else 0.0
    apart = held.pop(0, 0.0)
    if sum(held.values()) > apart:
        most = max(held.values())
        weights = [w if paths.first[b[0]] and held[paths.first[b[0]]] >= 0.1 * most else w * OUTSIDE for w, b in zip(weights, ok)]
        fused, limit, best = scored(weights)
    # The containers: the parts of the paths above the threshold, by the text they hold.
    weight: dict[int, float] = defaultdict(float)
    for path, f in best.items():
        if f >= limit:
            weight[part(path)] += chars[path]
    # Parts with a fair share of the text above the threshold (a tenth of the best one's, or
    # three tenths if it is one block), and what holds them or lies in them, keep all that
    # is not mostly links; other blocks stay between such parts, if above the threshold.
    size = Counter(part(b[0]) for b in ok)
    most = max(weight.values())
    fair = [p for p, w in weight.items() if w >= (0.1 if size[p] > 1 else 0.3) * most]
    along = paths.along(fair)
    company = [along[part(b[0])] for b in ok]
    first, last = company.index(True), len(company) - company[::-1].index(True)
    inside = paths.below(paths.common(fair))
    out = []
    for i, (f, w, c, b) in enumerate(zip(fused, weights, company, ok)):
        # A path may have blocks of several weights; one that is weighed less must be above the threshold itself.
        above = (best[b[0]] if w == 1 else f) >= limit
        if inside[b[0]] and (above and (c or first < i < last) or c and w == 1 and b[3] * 2 < len(b[1])):
            out.append(b[1])
    return out


def main_text(html: str | None, threshold: float = 0.25) -> str:
    """Content blocks joined by two line feeds."""
    return "\n\n".join(main_blocks(*blocks(html), threshold)) if html else ""


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", threshold: float = 0.25) -> DataFrame:
    """``pages`` with the main text of ``html_col`` in ``out_col`` (replaced if it is there).

    A page is worked on by itself in one task, so no row moves. Null and empty pages,
    and pages without content, give the empty text; character references are decoded
    and white space inside a block is one space; pages of any length and depth are taken
    whole, in time and memory in proportion to them;
    repeated rows give equal results; an empty table stays empty.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(h, threshold) for h in b], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pages.withColumn(out_col, F.pandas_udf(run, "string")(F.col(html_col)))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
