"""Main text of HTML pages from flat text blocks.

A page is cut into blocks at block-level tags.  Each block has its number of
words and its link density (share of words inside links), those of the blocks
before and after it, and four marks of where it stands: inside an article or
main element; inside a navigation, header, footer, aside, form or hidden
element; inside an element whose class, id or role names such a part; whether
it is a heading.  A decision tree, grown on the labelled table ``LABELLED``,
says which blocks are main text.  Marks count less in its growth, so that words,
links and neighbours decide wherever they can: long running text is main text
without any article element, a short block is if it stands between long ones, and
a run of links is a menu also inside an article.  The labelled rows hold every unmarked
block under each mark too, so that a mark settles what the figures leave open.

A name is a part's name only as a whole: all of its words name the part or say
where or how large it is (``site-header``, ``comment-list-2``), so ``has-sidebar``,
``sidebar-layout``, ``comments-open``, ``legal-news`` and ``tag-spark`` are none.
Names of an article or main element do not count.  A name outside the outermost
article or main element ends there, unless it is one of parts that hold articles of
their own (comments, related texts, a sidebar).  A form around an article, main,
navigation, header or footer is the page's wrapper and no form.

Comments, scripts, styles and other non-text elements are dropped whole, also
when they are not closed; a self-closed ``svg`` or ``math`` and an ``option``
without its end tag drop no more than themselves.  ``noscript`` is read like a
``div``; bare text in it is a notice.  End tags that HTML lets authors leave out
are added.  Character references are decoded once, after the tags are gone.  White
space in a block (a ``<br>`` counts as such) becomes one space.  Blocks without
text vanish; those kept are joined by a line feed.  Null, empty and textless pages
give an empty string.  Pages are read whole.  Repeated pages are extracted as often
as they come; extra columns are kept.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from surv.llm.rows import add_columns

# --- fixed values: element names of HTML -----------------------------------
DROPPED = "script style template svg math iframe object canvas audio video select textarea button title".split()
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MAIN = {"article", "main"}
SIDE = {"nav", "header", "footer", "aside", "form", "fieldset", "menu", "dialog"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
# words that name a part, and words that may stand beside them in its name
PARTS = set("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion cookie cookies
consent gdpr notice notices alert alerts popup modal overlay sidebar side aside menu menus nav navbar navigation breadcrumb breadcrumbs toolbar footer
header masthead comment comments respond replies reply disqus discussion share sharing social related recommend recommended recommendations newsletter
subscribe subscription signup login search widget widgets pagination pager tag tags copyright legal disclaimer skip complementary
contentinfo""".split())
OF_ARTICLES = set("comment comments respond replies reply disqus discussion related recommend recommended recommendations".split())
BESIDE = set("""site page main global post posts entry user reader article articles story stories top bottom left right primary secondary inner outer wrap
wrapper container content box block area section group list item items bar links link form body text title head row column cloud info button buttons icon
icons inline small large fixed sticky sub js the and of to our by""".split())
# a form around one of these wraps the page
WRAPPED = {"article", "main", "nav", "header", "footer"}
# end tags that may be left out: open elements that a start tag ends
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
ENDED |= {t: {"td", "th", "tr", "thead", "tbody", "tfoot", "caption"} for t in ("thead", "tbody", "tfoot")}

# --- labelled blocks ---------------------------------------------------------
# words, link density | same of the block before | of the block after |
# in article, in side element, part named by class or id, heading | main text?
# The rows from 10 0 1 1 3 0 on are blocks of pages that were read without their marks.
LABELLED = """
9 0 0 0 60 0 1 0 0 1 1
4 0 0 0 45 0 1 0 0 1 1
60 0 9 0 80 0 1 0 0 0 1
80 0 60 0 30 0.1 1 0 0 0 1
30 0.1 80 0 3 0 1 0 0 0 1
3 0 30 0.1 45 0 1 0 0 0 1
1 0 50 0 70 0 1 0 0 0 1
1 0 2 0 1 0 1 0 0 0 1
5 0 0 0 0 0 1 0 0 0 1
2 0 0 0 0 0 1 0 0 1 1
25 0.3 40 0 35 0 1 0 0 0 1
6 1 40 0 55 0 1 0 0 0 1
12 0.5 10 0 14 0 1 0 0 0 1
7 0 70 0 4 0 1 0 0 1 1
150 0 7 0 12 1 1 0 0 0 1
220 0.02 90 0 0 0 1 0 0 0 1
15 0 150 0 9 1 1 0 0 0 1
2 0 1 1 10 0.2 1 0 0 1 1
9 0 3 1 60 0 1 0 0 1 1
3 0 2 1 4 1 1 0 0 0 1
5 0.5 2 1 2 1 1 0 0 0 1
1 1 1 1 1 1 1 0 0 0 0
3 1 4 1 20 0 1 0 0 0 0
3 1 50 0 2 1 1 0 0 0 0
5 1 0 0 4 1 1 0 0 0 0
2 1 2 1 0 0 1 0 0 0 0
8 1 30 0 40 0.1 1 0 0 0 1
3 1 25 0 0 0 1 0 0 0 1
2 1 0 0 60 0 1 0 0 0 1
4 1 3 1 5 1 1 0 0 0 0
2 1 0 0 1 1 1 0 0 0 0
12 0 1 1 1 1 1 0 0 0 1
1 0 1 1 1 1 1 0 0 0 1
35 0 2 1 3 1 1 0 0 0 1
7 0 4 1 5 1 1 0 0 1 1
40 0 6 1 6 1 1 0 0 0 1
10 0 55 0 60 0 1 0 1 0 0
45 0 60 0 70 0 1 0 1 0 0
30 0 12 0 25 0 1 0 1 0 0
3 1 80 0 3 1 1 0 1 0 0
1 1 1 1 1 1 1 0 1 0 0
120 0 30 0 40 0 1 0 1 0 0
6 0 80 0 20 0 1 0 1 1 0
14 0 50 0 60 0 1 1 0 0 0
60 0 70 0 60 0 1 1 0 0 0
2 1 90 0 2 1 1 1 0 0 0
5 0 60 0 12 0 1 1 0 1 0
25 0.1 8 0 3 1 1 1 1 0 0
1 1 1 1 1 1 0 1 0 0 0
2 1 1 1 3 1 0 1 0 0 0
1 1 0 0 1 1 0 1 0 0 0
12 0 3 1 0 0 0 1 0 0 0
9 0.2 80 0 0 0 0 1 0 0 0
45 0 10 0 20 0 0 1 0 0 0
90 0 60 0 70 0 0 1 0 0 0
6 0 0 0 12 0 0 1 0 1 0
30 0 4 0 5 0 0 1 1 0 0
8 0 1 1 10 0 0 0 1 0 0
15 0 1 1 7 0 0 0 1 0 0
60 0 12 0 80 0 0 0 1 0 0
110 0 60 0 90 0 0 0 1 0 0
4 0 30 0 8 0 0 0 1 1 0
2 1 2 1 2 1 0 0 1 0 0
1 1 1 1 1 1 0 0 0 0 0
3 1 2 1 4 1 0 0 0 0 0
5 1 5 1 20 0 0 0 0 0 0
8 0.9 3 1 6 1 0 0 0 0 0
30 0.8 10 1 12 1 0 0 0 0 0
4 0 2 1 3 1 0 0 0 0 0
3 0 1 1 0 0 0 0 0 0 0
6 0 0 0 4 1 0 0 0 0 0
5 0 0 0 0 0 0 0 0 0 0
9 0 4 1 5 1 0 0 0 0 0
60 0 5 0 70 0 0 0 0 0 1
90 0.05 60 0 40 0 0 0 0 0 1
45 0 90 0 8 0 0 0 0 0 1
25 0 3 1 60 0 0 0 0 0 1
22 0.1 70 0 2 1 0 0 0 0 1
12 0 60 0 80 0 0 0 0 0 1
9 0 45 0 50 0 0 0 0 0 1
5 0 50 0 60 0 0 0 0 1 1
7 0 2 1 80 0 0 0 0 1 1
8 0 0 0 60 0 0 0 0 1 1
200 0 0 0 0 0 0 0 0 0 1
40 0.2 30 0 30 0 0 0 0 0 1
10 0 60 0 0 0 1 0 0 0 1
14 0 0 0 0 0 1 0 0 0 1
9 0 8 0 0 0 1 0 0 1 1
12 0 20 0 2 0 1 0 0 0 1
8 0 90 0 0 0 1 0 0 0 1
16 0 12 0 3 0 1 0 0 0 1
60 0 70 0 0 0 0 0 1 0 0
50 0 0 0 0 0 0 0 1 0 0
80 0 3 0 0 0 1 0 1 0 0
25 0 3 1 40 0 1 0 1 0 0
30 0 1 1 0 0 1 1 0 0 0
12 0 2 1 60 0 1 0 1 0 0
10 0 30 0 0 0 1 0 1 0 0
14 0 9 0 2 0 1 1 0 0 0
70 0 40 0 2 1 0 1 0 0 0
90 0 80 0 100 0 0 0 1 0 0
100 0 90 0 60 0 0 1 0 0 0
35 0 60 0 8 0 0 1 0 0 0
4 0 30 0 60 0 0 0 1 0 0
6 0 40 0 70 0 1 0 1 0 0
40 0 60 0 0 0 0 0 0 0 1
25 0 30 0 0 0 0 0 0 0 1
20 0 12 0 0 0 0 0 0 0 1
55 0 0 0 0 0 0 0 0 0 1
35 0.1 90 0 0 0 0 0 0 0 1
9 0 50 0 2 1 1 0 0 0 1
12 0 80 0 1 1 1 0 0 0 1
5 0 30 0 3 1 1 0 0 0 1
15 0 20 0 1 1 1 0 0 0 1
8 0.2 15 0 4 1 1 0 0 0 1
30 0 5 1 0 0 1 0 0 0 1
12 0 3 1 0 0 1 0 0 0 1
6 0.1 8 1 0 0 1 0 0 0 1
100 0 1 1 4 0 0 0 0 0 1
60 0 2 1 10 0 0 0 0 0 1
30 0 1 1 12 0 0 0 0 0 1
80 0 1 1 0 0 0 0 0 0 1
45 0.1 3 1 20 0 0 0 0 0 1
25 0 1 1 6 0 0 0 0 0 1
10 0 1 1 3 0 0 0 0 0 0
6 0 1 1 10 0 0 0 0 0 0
8 0 1 1 10 0 0 0 0 0 0
12 0 1 1 8 0 0 0 0 0 0
6 0 1 1 13 0 0 0 0 0 0
8 0 1 1 11 0 0 0 0 0 0
6 0 1 1 4 0 0 0 0 0 0
10 0 1 1 10 0 0 0 0 0 0
12 0 1 1 9 0 0 0 0 0 0
6 0 1 1 9 0 0 0 0 0 0
14 0 1 0 0 0 0 0 0 0 0
8 0 8 0 0 0 0 0 0 0 0
16 0 16 0 0 0 0 0 0 0 0
9 0 15 0 0 0 0 0 0 0 0
11 0 9 0 0 0 0 0 0 0 0
7 0 1 0 0 0 0 0 0 0 0
7 0 78 0 0 0 0 0 0 0 0
8 0 6 0 0 0 0 0 0 0 0
13 0 9 0 0 0 0 0 0 0 0
8 0 76 0 0 0 0 0 0 0 0
15 0 3 0 0 0 0 0 0 0 0
8 0 96 0 0 0 0 0 0 0 0
12 0 11 0 0 0 0 0 0 0 0
13 0 13 0 0 0 0 0 0 0 0
1 1 1 1 1 1 0 0 0 0 0
1 1 1 1 8 0 0 0 0 0 0
8 0 4 0 8 0 0 0 0 1 1
11 0 9 0 56 0 0 0 0 1 1
11 0 6 0 137 0 0 0 0 1 1
4 0 8 0 4 0 0 0 0 1 1
7 0 6 0 7 0 0 0 0 1 1
10 0 13 0 66 0 0 0 0 1 1
11 0 5 0 55 0 0 0 0 1 1
11 0 9 0 36 0 0 0 0 1 1
8 0 12 0 8 0 0 0 0 1 1
10 0 8 0 10 0 0 0 0 1 1
4 0 37 0 12 0 0 0 0 0 1
17 0 4 0 4 0 0 0 0 0 1
6 0 18 0 2 0 0 0 0 0 1
13 0 24 0 1 0 0 0 0 0 1
14 0 47 0 12 0 0 0 0 0 1
17 0 74 0 5 0 0 0 0 0 1
16 0 3 0 35 0 0 0 0 0 1
11 0 50 0 12 0 0 0 0 0 1
13 0 14 0 19 0 0 0 0 0 1
7 0 31 0 7 0 0 0 0 0 1
11 0 143 0 9 0 0 0 0 0 1
15 0 104 0 5 0 0 0 0 0 1
13 0 35 0 33 0 0 0 0 0 1
11 0 13 0 70 0 0 0 0 0 1
1 0 2 0 15 0 0 0 0 0 1
5 0 19 0 31 0 0 0 0 0 1
5 0 58 0 30 0 0 0 0 0 1
8 0 8 0 48 0 0 0 0 0 1
17 0 92 0 1 0 0 0 0 0 1
8 0 8 0 150 0 0 0 0 0 1
5 0 43 0 11 0 0 0 0 0 1
17 0 90 0 26 0 0 0 0 0 1
56 0 10 0 8 0 0 0 0 0 1
3 0 30 0 16 0 0 0 0 0 1
5 0 150 0 12 0 0 0 0 0 1
15 0 6 0 9 0 0 0 0 0 1
40 0 19 0 11 0 0 0 0 0 1
4 0 52 0 8 0 0 0 0 0 1
30 0 2 0 12 0 0 0 0 0 1
11 0 90 0 7 0 0 0 0 0 1
10 0 11 0 11 0 0 0 0 0 1
8 0 8 0 9 0 0 0 0 0 1
17 0 58 0 8 0 0 0 0 0 1
9 0 184 0 16 0 0 0 0 0 1
12 0 36 0 11 0 0 0 0 0 1
19 0 5 0 66 0 0 0 0 0 1
78 0 44 0 5 0 0 0 0 0 1
49 0 67 0 39 0 0 0 0 0 1
36 0 2 0 11 0 0 0 0 0 1
37 0 4 0 65 0 0 0 0 0 1
71 0 29 0 5 0 0 0 0 0 1
20 0 68 0 30 0 0 0 0 0 1
56 0 28 0 116 0 0 0 0 0 1
150 0 8 0 8 0 0 0 0 0 1
29 0 40 0 6 0 0 0 0 0 1
"""

FIRST_MARK = 6
RUNNING = 0.6          # link density below which text runs
MARK_WEIGHT = 0.8
Tree = tuple  # (feature, bound, low side, high side) or (label,)


def labelled_rows() -> list[list[float]]:
    """The table, and by rule the unmarked rows once more under each mark: in an
    article their running text is main text, in a side element or a named part
    nothing is."""
    rows = [[float(x) for x in line.split()] for line in LABELLED.strip().splitlines()]
    out = list(rows)
    for r in rows:
        if not any(r[FIRST_MARK:FIRST_MARK + 3]):
            out.append([*r[:6], 1.0, 0.0, 0.0, r[9], float(r[1] < RUNNING)])
            out.append([*r[:6], 0.0, 1.0, 0.0, r[9], 0.0])
            out.append([*r[:6], 0.0, 0.0, 1.0, r[9], 0.0])
    return out


def grow(rows: list[list[float]], least: int = 1, depth: int = 12) -> Tree:
    """Decision tree by Gini impurity; what a split by a mark gains counts
    ``MARK_WEIGHT``, and ties go to the first feature and bound."""
    n, ones = len(rows), sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, n) or n < 2 * least:
        return (int(2 * ones >= n),)
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            lo = [r[-1] for r in rows if r[f] <= cut]
            nl, ol = len(lo), sum(lo)
            nh, oh = n - nl, ones - ol
            if min(nl, nh) < least:
                continue
            g = ol * (nl - ol) / nl + oh * (nh - oh) / nh
            if f >= FIRST_MARK:
                g = MARK_WEIGHT * g + (1 - MARK_WEIGHT) * ones * (n - ones) / n
            if best is None or g < best[0] - 1e-12:
                best = (g, f, cut)
    if best is None:
        return (int(2 * ones >= n),)
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[f] <= cut], least, depth - 1), grow([r for r in rows if r[f] > cut], least, depth - 1)


def decide(tree: Tree, x) -> int:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<option\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?=</?(?:option|optgroup|select|datalist|" + "|".join(sorted(BLOCK)) + r")\b|\Z)"
    r"|<(?P<drop>" + "|".join(DROPPED) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=drop)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)|</[^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


PAGE = ("html", "body", "head")


def part(names: str) -> int:
    """1 if one of the names (class, id, role) is a part's, 2 if the part holds
    articles of its own, else 0."""
    found = 0
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit() and w not in BESIDE]
        if words and all(w in PARTS for w in words):
            found = max(found, 2 if OF_ARTICLES.intersection(words) or name in ("sidebar", "widget", "widgets") else 1)
    return found


def blocks(page: str) -> list[tuple[str, int, float, int, int, int, int]]:
    """Text, words, link density, in article, in side element, named part,
    heading; in page order."""
    out, parts, linked = [], [], []
    # open block elements: name, in main, numbers of open side elements, named part (2 if it holds articles of its own)
    stack: list[tuple[str, int, tuple, int]] = []
    sides: list[bool] = []                 # whether a side element is one; a form around the page is not
    link, heading = 0, 0

    def flush():
        nonlocal parts, linked, heading
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                lw = min(len(html.unescape(" ".join(linked)).split()), len(words)) if linked else 0
                tag, main, side, named = stack[-1] if stack else ("", 0, (), 0)
                out.append((" ".join(words), len(words), lw / len(words), main, side, int(named > 0 or tag == "noscript"), heading))
            parts, linked = [], []

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            parts.append(text)
            if link:
                linked.append(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = 0 if m["end"] else 1
        elif tag in BLOCK:
            flush()
            if m["end"]:
                if tag in HEADING:
                    heading = 0
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                link = 0
            elif tag not in VOID:
                heading = int(tag in HEADING)
                while stack and (stack[-1][0] == "p" or stack[-1][0] in ENDED.get(tag, ())):
                    stack.pop()
                attr = m["attr"] or ""
                _, main, side, named = stack[-1] if stack else ("", 0, (), 0)
                if tag in WRAPPED:
                    for open_tag, _, open_sides, _ in stack:
                        if open_tag == "form" and open_sides:
                            sides[open_sides[-1]] = False
                if tag in MAIN:
                    named = named if main or tag == "article" and named == 2 else 0
                elif tag not in PAGE:
                    named = max(named, part(" ".join(a or b or c for _, a, b, c in _NAMES.findall(attr))))
                if tag not in PAGE and (tag in SIDE or _HIDDEN.search(attr)):
                    sides.append(True)
                    side = (*side, len(sides) - 1)
                stack.append((tag, int(main or tag in MAIN), side, named))
    flush()
    return [(t, n, ld, main, int(any(sides[k] for k in side)), named, head) for t, n, ld, main, side, named, head in out]


def features(b: list[tuple], i: int) -> tuple:
    """Words and link density of block ``i``, of the one before and after, and its marks."""
    _, n, ld, *marks = b[i]
    before = b[i - 1][1:3] if i else (0, 0.0)
    after = b[i + 1][1:3] if i + 1 < len(b) else (0, 0.0)
    return (n, ld, *before, *after, *marks)


def main_text(page: str | None, tree: Tree) -> str:
    b = blocks(page or "")
    return "\n".join(x[0] for i, x in enumerate(b) if decide(tree, features(b, i)))


def extract(pages: DataFrame, html_col: str = "html", text_out: str = "text", chars_out: str = "n_chars") -> DataFrame:
    """``pages`` with the main text and its number of code points."""
    tree = grow(labelled_rows())

    def task():
        def run(texts):
            got = [main_text(t, tree) for t in texts]
            return got, [len(t) for t in got]
        return run

    return add_columns(pages, html_col, {text_out: "string", chars_out: "long"}, task)
