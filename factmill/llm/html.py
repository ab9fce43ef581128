"""HTML main text: flat text blocks, each described by its own and its neighbours' word counts and link densities, and judged by a decision tree.

The tree is trained on a small labelled table: the blocks of a few labelled pages, half of them without any mark of an article. Besides the
counts and densities a block has three features of its tags: whether it is a bare run of text, a paragraph or a heading; whether it is
inside an element of a kind that is no part of an article (menus, headers, footers, sidebars, notices, adverts, forms, comments); and whether it
is inside an article element. No feature decides alone. A page is a row and stays one; no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that end a text block, whose raw text runs to their closing tag or the page's end, that hold no page text if they are closed, and that hold no prose of an article.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW = "script style textarea title iframe".split()
SILENT = "template noscript svg math object canvas audio video select button".split()
CHROME = set("nav header footer aside form menu dialog".split())
MAIN = {"article", "main"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = set("p li dd dt blockquote pre td th caption figcaption".split())
#: Whole names of class, id and role for what HTML has no element for: menus, notices, adverts, sidebars and comments.
NAMED = set("ad ads advert adverts advertisement banner promo sponsored cookie cookies cookie-notice cookie-banner consent notice popup modal newsletter navigation navbar nav menu breadcrumb breadcrumbs pagination sidebar widget masthead header footer comment comments comment-list disqus".split())
#: Whole names that mark the article itself.
OWN_ARTICLE = set("articlebody post-content entry-content article-content article-body post-body story-body main-content page-content".split())

_ATTRIBUTES = r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<(?:svg|math)\b" + _ATTRIBUTES + r"(?<=/)>"
    # up to the closing tag, over one level of the same element inside
    r"|<(" + "|".join(SILENT) + r")\b[^>]*>(?:[^<]|<(?!/?\2\b)|<\2\b[^>]*(?<=/)>|<\2\b[^>]*(?<!/)>(?:[^<]|<(?!/?\2\b))*+</\2\s*>)*+</\2\s*>"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)(" + _ATTRIBUTES + r")(?:>|\Z)",
    re.S | re.I,
)
_MARK = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "tag", "excluded", "in_article")

#: Labelled pages: {n} is a run of n words, and + before it marks text of the article.
LABELLED_PAGES = (
    # a marked article
    "<nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav><div class=ad>{8}</div><article><h1>+{9}</h1><p>+{80}<p>+{3}<p>+{120}<p>+{2}</article><footer>{12}</footer>",
    "<header><a>{1}</a><p>{6}</p></header><article><h1>+{4}</h1><p>+{3}</p><p>+{2}</p></article><footer><p>{30}</p><a>{2}</a></footer>",
    "<article><h1>+{5}</h1><p>+{40}</p><ul><li>+<a>{4}</a></li><li>+<a>{2}</a></li><li>+<a>{6}</a></li></ul><p>+{30} <a>{9}</a></p></article><aside><p>{40}</p></aside>",
    "<main><div>+{6}</div><div>+{50}</div><div>+{2}</div><table><tr><td>+{1}<td>+{1}<tr><td>+{3}<td>+<a>{1}</a></table></main><form>{2}</form>",
    "<article>+{25}<aside>{10}</aside>+{18}</article><div id=comments><p>{35}<p>{60}<article class=comment><p>{20}</article></div>",
    # articles as teasers: cards of linked lines
    "<article><h3><a>{7}</a></h3></article><article><h3><a>{5}</a></h3></article><article><h3><a>{8}</a></h3></article>",
    "<div><p>+{70}</p><p>+{45}</p></div><article><a>{6}</a></article><article><a>{4}</a></article><article><a>{9}</a></article>",
    # no mark of an article
    "<div><a>{1}</a> <a>{2}</a></div><div>{2}</div><div><h1>+{7}</h1><p>+{60}</p><p>+{4}</p><p>+{30} <a>{3}</a></p></div><div><a>{2}</a> <a>{1}</a></div>",
    "<ul><li><a>{1}</a><li><a>{1}</a><li>{1}<li><a>{2}</a></ul><h1>+{6}</h1><p>+{9}<p>+{5}<ul><li>+{3}<li>+{4}<li>+{2}</ul><p>+{7}<ul><li><a>{3}</a><li><a>{2}</a></ul>",
    "<div><a>{1}</a></div><div>+{48}</div><p>+{52}",
    "<div><a>{2}</a></div><div>{3}</div><div><a>{1}</a></div><div>+{90}</div><div>+{25}</div><div>+{60}</div><div>{3}</div><div><a>{2}</a></div>",
    "<p>+{12}<p>+{20}<p>+{6}<div class=newsletter><p>{15}</div><p>+{16}",
    "<h2>+{4}</h2><p>+{35}<blockquote>+{12}</blockquote><h2>+{3}</h2><p>+{25}<h3>{2}</h3><ul><li><a>{5}</a><li><a>{6}</a><li><a>{4}</a></ul>",
    "<div class=cookie-banner><p>{25}</p></div><div class=menu><p>{2}</p></div><p>+{5}<p>+{3}<div class=sidebar><h3>{2}</h3><p>{40}</div>",
    "<form><p>{5}<p>{20}</form><h1>+{8}</h1><pre>+{30}</pre><dl><dt>+{1}<dd>+{9}<dt>+{2}<dd>+{14}</dl><footer><p>{60}</footer>",
    "<div>{2} <a>{3}</a></div><p>+{1}<p>+{2}<div><a>{2}</a></div>",
    "<div>+{15} <a>{2}</a></div><div>+{22}</div><div>+{4} <a>{1}</a> +{40}</div>",
    # headings after menus of longer links, and short last lines before links
    "<nav><ul><li><a>{3}</a><li><a>{4}</a></ul></nav><article><h1>+{3}</h1><p>+{50}<p>+{3}</article><div><a>{2}</a> <a>{3}</a></div>",
    "<ul><li><a>{3}</a><li><a>{4}</a></ul><h1>+{2}</h1><p>+{6}<p>+{50}<p>+{2}</p><div><a>{2}</a> <a>{3}</a></div>",
    "<div><a>{4}</a></div><div>{5}</div><div><a>{3}</a></div><h2>+{5}</h2><p>+{30}<p>+{4}<ul><li><a>{3}</a><li><a>{2}</a></ul>",
    "<nav><a>{5}</a></nav><main><h1>+{5}</h1><p>+{3}</p></main><nav><a>{4}</a></nav>",
    "<article><p>+{40}<h2>+{2}</h2><ol><li>+<a>{8}</a><li>+<a>{12}</a><li>+<a>{3}</a></ol></article><ul><li><a>{3}</a></ul>",
    "<article><p>+<a>{3}</a></p><p>+{6}</p></article>", "<article><h2>+{3}</h2><p>+<a>{2}</a> {2}</p><p>+{5}</p></article>",
    "<article><p>+{20}<p>+{1}</article><section><h3>{2}</h3><ul><li><a>{4}</a><li><a>{6}</a></ul></section>",
    "<p>+{9}", "<h1>+{6}</h1>", "<div>+{30}</div>", "<div><a>{3}</a></div>", "<header><h1>{5}</h1></header><p>+{4}",
)


def labelled_blocks(pages: tuple[str, ...] = LABELLED_PAGES, scales: tuple[float, ...] = (1, 1.6, 3)) -> np.ndarray:
    """Rows of features, then 1 for text of the article, of the labelled pages; each page also with longer runs of words."""
    rows = []
    for page in pages:
        for scale in scales:
            html = re.sub(r"\{(\d+)\}", lambda m: " ".join(["w"] * max(1, int(int(m[1]) * scale))), page)
            found = blocks(html)
            plain = [(text.replace("+", " ").strip(), len(text.replace("+", " ").split()), linked, *rest) for text, _, linked, *rest in found]
            rows += [(*row, float("+" in block[0])) for row, block in zip(described(plain), found, strict=True)]
    return np.array(rows, float)


def grow(rows: np.ndarray, depth: int = 10) -> tuple | float:
    """CART by Gini impurity: (feature, threshold, at most, above) or the share of label 1 of a leaf."""
    labels = rows[:, -1]
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = rows[:, f] <= t
            a, b = labels[left], labels[~left]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), left)
    if best is None:
        return share
    return best[1], best[2], grow(rows[best[3]], depth - 1), grow(rows[~best[3]], depth - 1)


def judge(tree: tuple | float, row: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def blocks(html: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, linked words, tag, excluded, in_article) of every flat text block, in page order. Unclosed tags and cut pages are fine."""
    out: list = []
    open_tags: list[tuple[str, int]] = []  # container and what it says of its place
    text: list[str] = []
    linked, in_link, tag_kind = 0, False, 0

    def place() -> tuple[int, int]:
        """(excluded, in_article): the innermost mark decides, and what is hidden stays so."""
        excluded = inside = 0
        for _, kind in open_tags:
            if kind == HIDDEN:
                return 1, 0
            if kind:
                excluded, inside = int(kind == EXCLUDED), int(kind == ARTICLE or (inside and kind != EXCLUDED))
        return excluded, inside

    def end() -> None:
        nonlocal linked, tag_kind
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, len(joined.split(" ")), linked, tag_kind, *place()))
        text.clear()
        linked = 0
        tag_kind = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = unescape(raw)
            text.append(plain)
            if in_link:
                linked += len(plain.split())

    at = 0
    for m in _TAG.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        if m[4] is None:
            continue
        tag = m[4].lower()
        if tag == "a":
            in_link = not m[3]
        elif tag in ("br", "img", "wbr"):
            text.append(" ")
        if tag in BLOCK:
            end()
            if not m[3]:
                tag_kind = 2 if tag in HEADINGS else 1 if tag in PARAGRAPHS else 0
                in_link = False
        if m[3]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    del open_tags[i:]
                    break
        elif tag in VOID or tag == "head" or m[5].endswith("/"):
            continue
        elif tag in BLOCK - {"p", "li", "td", "th", "tr", "dd", "dt", "option"} or (m[5] and tag in ("span", "p", "li", "td")):
            kind = _kind(tag, m[5])
            if kind or tag in BLOCK:
                open_tags.append((tag, kind))
    add(html[at:])
    end()
    return out


#: What a container says of its place.
ARTICLE, EXCLUDED, HIDDEN = 1, 2, 3


def _kind(tag: str, attributes: str) -> int:
    """What an element says of its place by its own kind and whole names: ARTICLE, EXCLUDED, HIDDEN or 0."""
    kind = EXCLUDED if tag in CHROME else ARTICLE if tag in MAIN else 0
    for name, a, b, c in _MARK.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return HIDDEN
        names = set(value.split())
        if name == "class" and "hidden" in names:
            return HIDDEN
        if name in ("class", "id", "role", "itemprop") and tag not in ("body", "html"):
            if names & OWN_ARTICLE or (name == "role" and names & MAIN):
                kind = ARTICLE
            elif names & NAMED and not (tag in MAIN and name == "id"):
                kind = EXCLUDED
    return kind


def described(found: list[tuple]) -> list[tuple]:
    """The features of each block of a page, in the order of FEATURES."""
    none = (0, 0.0)
    own = [(n, linked / max(1, n)) for _, n, linked, *_ in found]
    return [(*own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none), *found[i][3:]) for i in range(len(found))]


#: The labelled table: features in order, then 1 for text of the article.
LABELLED = labelled_blocks()


def main_text(html: str | None, tree: tuple | float) -> str:
    found = blocks(html or "")
    return "\n".join(block[0] for block, row in zip(found, described(found), strict=True) if judge(tree, row))


def extract_text(pages: DataFrame, labelled: np.ndarray = LABELLED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text (blocks of the article joined by a line break; empty if none), n_chars (code points).

    Character references are decoded, white space inside a block is one space. Null and empty html give an empty text. Repeated rows give repeated results.
    """
    tree = grow(labelled)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(extract, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
