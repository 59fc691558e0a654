"""Operator 9, HTML extraction by the distribution of text over line blocks.

Markup is stripped into lines, one for each block element. What is never text is left out at once: scripts, styles, menus,
footers, asides, controls, hidden parts. Elements that only their name, or being a form or header, makes furniture
(adverts, cookies, sidebars, reader comments) lower their lines' mass to nothing, unless they hold the page: if no
text would surge outside and it has half of the text, or it has HOLDS of it (reader comments: only the former), it is no furniture.

A line's mass is its text outside of links, none if that is less than half of it. Masses are summed over sliding windows of
WINDOW lines. The text surges where a window reaches SURGE (or LIGHT of the page's fullest window, if that is less), and
dives where a whole window is empty. Kept are all lines from the dive before the first surge to the dive after the last
one. Marks of an article (its tag or role, or a name that holds half of the mass) weigh: the lines inside weigh SURGE more
and those outside nothing, so there furniture is what is furniture within the article.

Character references are decoded, white space within a block becomes one space, blocks are joined by an empty
line. Results for odd input: null or empty html gives an empty text, as do pages without any article; broken markup
is read as browsers do (open blocks end at the next) in linear time; pages of any length are read whole; repeated rows and null
ids each give their row; an empty table gives an empty result. Columns beyond id, url and html are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import table

WINDOW = 3
SURGE = 80
#: A page whose fullest window is small has its surges at this share of it.
LIGHT = 0.25
#: The share of the page's text from which a named element is no furniture.
HOLDS = 0.75

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
FURNITURE = frozenset("nav footer aside head script style noscript template svg math button select textarea title iframe object canvas dialog menu noembed noframes xmp".split())
#: Names of furniture in class and id, of reader comments, what else may stand beside them in a token, and what turns them round.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner banners cookie cookies consent gdpr popup modal newsletter subscribe subscription signup "
    "nav navbar navigation menu menus breadcrumb breadcrumbs toolbar pagination pager sidebar sidebars widget widgets footer footers masthead notice notices alert alerts overlay login search "
    "related recommended share sharing social header copyright legal disclaimer pageheader siteheader".split()
)
TALK = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
ALONE = frozenset("side rail foot".split())
BESIDE = frozenset(
    "area bar block box button buttons container form icons inner item items link links list panel posts articles stories top bottom left right wrap wrapper site page main global primary secondary "
    "section user reader post media slot unit sticky fixed".split()
)
TURNED = frozenset("has have no not with without hide show js is".split())
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
HIDDEN = re.compile(r"(?:^|[\s\"'])hidden(?=[\s=/]|$)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
MAIN_NAMES = re.compile(r"(?:^|\s)(?:article|post|entry|story)(?:[-_]?(?:body|content|text))?(?=$|\s)", re.I)
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _named(names: str) -> str:
    """What a list of names makes of an element: 'talk', 'soft' (other furniture) or ''. Each part of a token must be known: a token says nothing if any part is another word."""
    kind = ""
    for token in names.lower().split():
        parts = set(re.split("[-_]+", token.strip("0123456789-_")))
        if parts & TURNED or not (parts <= NAMES | TALK | BESIDE or parts <= ALONE):
            continue
        if parts & TALK:
            return "talk"
        if parts & NAMES or parts <= ALONE:
            kind = "soft"
    return kind


def _kind(tag: str, attributes: str, in_article: bool) -> str:
    """What an element is: 'hard' furniture, which is never text; 'soft' or 'talk', which is none unless it holds the page; 'main', 'named' (an article by its name) or ''."""
    if tag in FURNITURE:
        return "hard"
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    role = found.get("role", "").lower()
    if role in ROLES or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) or found.get("aria-hidden") == "true":
        return "hard"
    if attributes and HIDDEN.search(QUOTED.sub('""', attributes)):
        return "hard"
    if tag == "article" or tag == "main" or role in ("main", "article"):
        return "main"
    if tag == "form" or role == "form" or tag == "header" and not in_article:
        return "soft"
    if tag not in ("html", "body"):
        names = f"{found.get('class', '')} {found.get('id', '')}"
        return _named(names) or ("named" if MAIN_NAMES.search(names) else "")
    return ""


def strip(html: str) -> tuple[list[str], np.ndarray, np.ndarray, list[list]]:
    """The lines of a page outside of hard furniture, for each how deep it is in an article by tag and by name and its
    characters in links, and the soft furniture as [first line, line after, kind]."""
    lines: list[str] = []
    marked: list[tuple[int, int]] = []
    linked: list[int] = []
    soft: list[list] = []
    opened: list[list] = []  # those that are open
    stack: list[tuple[str, str]] = []
    is_open: Counter[str] = Counter()  # how often each tag is on the stack
    furniture = main = named = article = links = 0
    now: list[str] = []
    now_links = 0

    def end_line() -> None:
        nonlocal now, now_links
        text = " ".join(unescape("".join(now)).split())
        if text and not furniture:
            lines.append(text)
            marked.append((main, named))
            linked.append(now_links)
        now, now_links = [], 0

    def close(k: int) -> None:
        """Close the open elements from the k-th on."""
        nonlocal furniture, main, named, article, links
        for tag, kind in reversed(stack[k:]):
            is_open[tag] -= 1
            furniture -= kind == "hard"
            main -= kind == "main"
            named -= kind == "named"
            if kind in ("soft", "talk"):
                opened.pop()[1] = len(lines)
            article -= tag == "article"
            links -= tag == "a"
        del stack[k:]

    def text(s: str) -> None:
        nonlocal now_links
        now.append(s)
        if links:
            now_links += len(s)

    at, n = 0, len(html)
    last = html.rfind(">")
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt > last:
            text(html[at:])
            break
        if lt > at:
            text(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag == "br" or tag in ("td", "th"):
            now.append(" ")
        if tag in BLOCKS:
            end_line()
        if closing:
            if is_open[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in BLOCKS and is_open["p"]:  # an open paragraph ends at the next block
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in BLOCKS), -1)
            if k >= 0 and stack[k][0] == "p":
                close(k)
        if tag in SELF_CLOSING and any(is_open[t] for t in SELF_CLOSING[tag]):
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in SELF_CLOSING[tag] or stack[k][0] in ("ul", "ol", "dl", "table", "select")), -1)
            if k >= 0 and stack[k][0] in SELF_CLOSING[tag]:
                close(k)
        if tag in VOID or tag not in BLOCKS and SELF_CLOSED.search(attributes):
            continue
        kind = _kind(tag, attributes, article > 0)
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = n if end is None else end.start()
        stack.append((tag, kind))
        is_open[tag] += 1
        furniture += kind == "hard"
        main += kind == "main"
        named += kind == "named"
        if kind in ("soft", "talk"):
            opened.append([len(lines), -1, kind])
            soft.append(opened[-1])
        article += tag == "article"
        links += tag == "a"
    end_line()
    close(0)
    return lines, np.array(marked, np.int64).reshape(-1, 2), np.array(linked, np.int64), soft


def window_sums(mass: np.ndarray) -> np.ndarray:
    """The sum of the window that begins at each line."""
    total = np.concatenate([[0], np.cumsum(mass), np.full(WINDOW - 1, mass.sum())])
    return total[WINDOW:] - total[: len(mass)]


def furniture_lines(mass: np.ndarray, soft: list[list]) -> np.ndarray:
    """Which lines soft furniture takes. An element that holds the page is released, the outermost first; those within it stay."""
    sums = np.concatenate([[0], np.cumsum(mass)])
    held = [(a, b, kind) for a, b, kind in soft if b > a]
    lines = lambda: np.cumsum(np.bincount([a for a, _, _ in held], minlength=len(mass) + 1) - np.bincount([b for _, b, _ in held], minlength=len(mass) + 1))[:-1] > 0
    held = [(a, b, kind) for a, b, kind in held if kind == "talk" or sums[b] - sums[a] < HOLDS * sums[-1]]
    while held:
        taken = lines()
        outside = window_sums(np.where(taken, 0, mass))
        most = max(sums[b] - sums[a] for a, b, _ in held)
        if outside.max() >= SURGE or 2 * most < sums[-1] or not most:
            return taken
        held = [(a, b, kind) for a, b, kind in held if sums[b] - sums[a] < most]
    return np.zeros(len(mass), bool)


def main_text(html: str | None) -> str:
    lines, marked, linked, soft = strip(html or "")
    if not lines:
        return ""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    mass = np.where(2 * linked <= length, length - linked, 0)
    inside = np.ones(len(lines), bool)
    for by, least in ((marked[:, 0] > 0, 1), (marked[:, 1] > 0, max(1, mass.sum() / 2))):
        if mass[by].sum() >= least:
            inside, mass = by, np.where(by, length + SURGE, 0)
            break
    kept = inside & ~furniture_lines(mass, soft)
    mass = np.where(kept, mass, 0)
    reach = window_sums(mass)
    surges = np.flatnonzero((mass > 0) & (reach >= max(1, min(SURGE, LIGHT * reach.max()))))
    if not len(surges):
        return ""
    dives = np.flatnonzero(reach == 0)  # the first line of an empty window
    before, after = dives[dives < surges[0]], dives[dives > surges[-1]]
    first = before[-1] + 1 if len(before) else 0
    end = after[0] if len(after) else len(lines)
    while mass[first] == 0:  # not the links at the edges
        first += 1
    while mass[end - 1] == 0:
        end -= 1
    return "\n\n".join(line for line, k in zip(lines[first:end], kept[first:end].tolist()) if k)


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    out = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
