"""HTML extraction by tag-path ratios.

A page is read into blocks of text. Each belongs to a root-to-leaf path of block tags; tags that hold parts of a page carry
their classes too, so that parts of different make have different paths. Per path, text length outside links and
punctuation are summed and divided by its blocks (the ratios), fused by their geometric mean and smoothed along the page.
A path then takes the greater of its own score and that of the part that it lies in, so that headings and short paragraphs
follow the text around them. Paths whose score reaches a share of the page's spread are content, and their blocks the result.

Names of classes, ids, roles and tags are a prior: they multiply a path's score. A part that holds most of the page's text is
not marked down by its name. Only what no reader sees as text (scripts, styles, hidden elements) and page furniture by its
own tag (menus, asides, footers, controls) is left out beforehand. Time and memory are linear in the page.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+|[^>]*)>", re.S
)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，]")
_WORDS = re.compile(r"[a-z]+")

RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that neither begin a block nor count in a path.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split()
)
#: Tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: A start tag of the first kind ends an open one of the second, up to the named boundary.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_IN_P = ("article", "body", "table", "td", "button")
_IN_LINE = ("article", "body", "table", "td")
#: Tags whose text is never the article's.
OUTSIDE = frozenset("head nav footer aside button select dialog menu svg math canvas object audio video applet".split())
#: Tags that hold parts of a page; a path carries their classes.
PARTS = frozenset("body div section article main header form fieldset td center".split())
#: Tags whose part is an article by its own word.
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Whole classes or ids, and roles, that speak against a part.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs cookie-banner cookie-consent cookie-notice footer login masthead menu modal nav navbar "
    "navigation newsletter overlay pager pagination popup promo promoted recommended related-articles related-posts search-form share share-buttons sharing sidebar side-bar signup site-footer "
    "site-header skip-link social-links social-share sponsor sponsored subscribe subscription teaser toolbar tracking widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Only outside an article: within one they hold its headline.
HEADER = frozenset(("header", "page-header", "topbar", "top-bar"))
#: Words of a class or id that speak of readers' comments, unless with one that tells a state ("comments-open").
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond responses thread threads disqus guestbook".split())
STATE_WORDS = frozenset("no has open closed off with without enabled disabled count link status".split())

#: What a name multiplies a score by.
PRIOR = 0.1
#: Marks are lifted from a part that holds this share of the text outside links, by a class or id only where no article stands
#: free of marks; from comments if this share or less lies elsewhere.
MOST, LITTLE = 0.5, 0.1
#: What is left of a part's score for a part within it, and for a heading of its own.
DECAY, HEADING = 0.5, 2.0
#: A part with more of the page's text than this is the page itself and lends its score to no part within it.
WHOLE = 0.95
#: Paths whose score reaches this share of the page's spread (root mean square over its blocks) are content.
SPREAD = 0.3


class Paths:
    """The paths of a page, each by its parent's number and its own key: tag, classes if it holds a part, and mark."""

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}
        self.parent, self.name, self.mark = [-1], [""], [""]

    def of(self, parent: int, name: str, classes: str, mark: str) -> int:
        key = (parent, f"{name} {classes} {mark}")
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.parent)
            self.parent.append(parent)
            self.name.append(name)
            self.mark.append(mark)
        return at


def _read_attributes(name: str, attrs: str, in_article: bool) -> tuple[str, str, bool]:
    """(classes without digits, mark: '', 'wrapper', 'furniture' or 'comments', whether unseen) of a start tag."""
    classes, mark, unseen = "", "wrapper" if name in ("form", "fieldset") or (name == "header" and not in_article) else "", False
    for key, *values in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            tokens = value.lower().split()
            if key == "class":
                classes = " ".join(sorted({re.sub(r"\d+", "", t) for t in tokens}))
            if name not in ("html", "body", *ARTICLES):
                if FURNITURE.intersection(tokens) or (not in_article and HEADER.intersection(tokens)):
                    mark = "furniture"
                for t in tokens:
                    found = set(_WORDS.findall(t))
                    if found & COMMENT_WORDS and not found & STATE_WORDS:
                        mark = "comments"
        elif key == "role":
            if name not in ("html", "body", *ARTICLES) and value.lower() in ROLES:
                mark = mark or "wrapper"
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            unseen = True
        elif key == "style" and _UNSEEN.search(value):
            unseen = True
    return classes, mark, unseen


def blocks(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The page's paths, and its blocks of text in order: (path, text, characters outside links)."""
    paths = Paths()
    # open elements: tag, path, whether unseen, in a link, in an article; and for each tag where it is open
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    opened: dict[str, list[int]] = {}
    found: list[tuple[int, str, int]] = []
    text: list[tuple[str, bool]] = []
    at, end, lower = 0, len(page), None

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(t for t, _ in text)).split())
            if whole:
                linked = sum(len(" ".join(html.unescape(t).split())) for t, link in text if link)
                found.append((stack[-1][1], whole, max(0, len(whole) - linked)))
            text.clear()

    def close(names: tuple[str, ...], boundary: tuple[str, ...] = ()) -> None:
        deepest = max((opened[n][-1] for n in names if opened.get(n)), default=0)
        if deepest > max((opened[b][-1] for b in boundary if opened.get(b)), default=0):
            while len(stack) > deepest:
                opened[stack.pop()[0]].pop()

    while at < end:
        token = _TOKEN.search(page, at)
        stop = end if token is None else token.start()
        if stop > at and not stack[-1][2]:
            text.append((page[at:stop], stack[-1][3]))
        if token is None:
            break
        at, name = token.end(), token["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            text.append((" ", False))
            continue
        if name not in INLINE:
            flush()
        if token["close"]:
            close((name,), tuple(b for b in _IN_LINE if b != name) if name in INLINE or name == "p" else ())
            continue
        if name in RAW:
            if lower is None:
                lower = page.lower()
                if len(lower) != end:  # a letter whose lower case is longer
                    lower = "".join(c.lower() if c < "\x80" else c for c in page)
            stop = lower.find(f"</{name}", at)
            at = end if stop < 0 else stop
            continue
        if name in ENDS_P:
            close(("p",), _IN_P)
        if name in ENDS:
            close(tuple(ENDS[name][0].split()), ENDS[name][1])
        if name in VOID:
            continue
        _, path, unseen, link, in_article = stack[-1]
        classes, mark, hidden = _read_attributes(name, token["attrs"], in_article)
        if name not in INLINE:
            path = paths.of(path, name, classes if name in PARTS else "", mark)
        stack.append((name, path, unseen or hidden or name in OUTSIDE, link or name == "a", in_article or name in ARTICLES))
        opened.setdefault(name, []).append(len(stack) - 1)
    flush()
    return paths, found


def path_scores(paths: Paths, found: list[tuple[int, str, int]]) -> np.ndarray:
    """The score of every path."""
    n = len(paths.parent)
    path = np.array([p for p, _, _ in found])
    size = np.array([len(t) for _, t, _ in found], float)
    free = np.array([f for _, _, f in found], float)
    points = np.array([len(_PUNCTUATION.findall(t)) for _, t, _ in found], float)
    many, plain, chars = (np.bincount(path, w, n) for w in (None, free, size))
    per = np.maximum(many, 1)
    ratio = np.sqrt(plain / per * (1 + np.bincount(path, points, n) / per))
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    smooth = np.convolve(np.pad(ratio[path], 2, mode="edge"), kernel / kernel.sum(), "valid")
    own = (ratio + np.bincount(path, smooth, n) / per) / 2

    # sums over all that lies below a path
    below, text = plain.copy(), chars.copy()
    strength, weight = own * plain, plain.copy()
    for p in range(n - 1, 0, -1):
        for sums in (below, text):
            sums[paths.parent[p]] += sums[p]
    marked, free_article = [False] * n, False
    for p in range(1, n):
        marked[p] = marked[paths.parent[p]] or paths.mark[p] != ""
        free_article |= paths.name[p] in ARTICLES and not marked[p] and below[p] > 0
    prior = np.ones(n)
    for p in range(1, n):
        share = below[p] / below[0] if below[0] else 1.0
        lifted = {"wrapper": share >= MOST, "furniture": share >= MOST and not free_article, "comments": share >= 1 - LITTLE}
        prior[p] = prior[paths.parent[p]] * (1.0 if lifted.get(paths.mark[p], True) else PRIOR)
    strength, weight = strength * (prior == 1), weight * (prior == 1)  # what is marked lends nothing
    for p in range(n - 1, 0, -1):
        for sums in (strength, weight):
            sums[paths.parent[p]] += sums[p]
    mean = strength / np.maximum(weight, 1)

    lent, article, score = np.zeros(n), np.zeros(n), np.zeros(n)
    for p in range(1, n):
        up, name = paths.parent[p], paths.name[p]
        lent[p], article[p] = lent[up], article[up]
        if name in PARTS:
            lent[p] = max(mean[p], DECAY * lent[up] if up and text[up] <= WHOLE * text[0] else 0.0)
        if name in ARTICLES:
            article[p] = mean[p]
        outside_links = plain[p] / max(1.0, chars[p])
        mine = own[p] * (HEADING if name in HEADINGS else 1.0)
        score[p] = prior[p] * max(mine, lent[p] * outside_links, article[p] * max(DECAY, outside_links))
    score[0] = own[0]
    return score


def extract(page: str | None) -> str:
    """The article's text: its blocks in page order, white space inside one turned into one space, joined by line feeds."""
    paths, found = blocks(page or "")
    if not found:
        return ""
    score = path_scores(paths, found)
    least = SPREAD * float(np.sqrt(np.mean(score[[p for p, _, _ in found]] ** 2)))
    return "\n".join(t for p, t, _ in found if score[p] > 0 and score[p] >= least)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Return page_id, url, text, n_chars for every row. A null or empty page, or one without article text, has text ''.

    Repeated rows are extracted each for itself; other columns are ignored; an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
