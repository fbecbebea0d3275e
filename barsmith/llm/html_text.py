"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Lines of a window, characters outside links of a window at which text surges, and the part (in percent) of its characters
#: outside links under which it dives.
WINDOW, SURGE, DIVE = 3, 60, 50

# Element names of HTML by what they do to the text, and the words by which pages name their boilerplate.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SPACE = {"br", "td", "th", "wbr", "img", "option", "hr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr", "picture",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
DROPPED = {
    "nav", "footer", "aside", "form", "menu", "dialog", "template", "svg", "math", "canvas", "object", "audio", "video", "select", "button", "head", "map",
    "fieldset", "datalist", "applet", "frameset",
}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
DROPPED_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promotion", "cookie",
    "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "comment", "comments",
    "commentlist", "disqus", "respond", "replies", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "notice", "notices", "disclaimer",
    "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "skip", "pagination", "pager", "toolbar", "topbar", "masthead",
}
#: These name boilerplate unless the name also says that they belong to the article.
OUTER_WORDS, OWN_WORDS = {"header", "footer", "banner"}, {"article", "post", "entry", "story", "content"}
KEPT = {"html", "body", "main", "article"}
#: After these a word tells how the page is laid out ("no-sidebar", "with-comments").
LAYOUT_WORDS = {"no", "non", "not", "without", "with", "has", "have"}
#: What these name may be longer than the article.
REPLY_WORDS = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}
#: Elements of which a text has many, side by side.
ITEMS = {"li", "td", "th", "tr", "tbody", "thead", "dt", "dd", "blockquote", "section", "figure", "figcaption", "pre"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _dropped(name: str, attrs: str) -> str:
    """How the markup tells that the element is boilerplate: "" if it does not, "surely", or by one word of a
    compound name, "replies" or "maybe"."""
    if name in DROPPED:
        return "surely"
    if not attrs or name in KEPT and name != "article":
        return ""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
        return "surely"
    if found.get("role", "").lower() in DROPPED_ROLES:
        return "surely"
    how = ""
    for title in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        words = [w for w in re.split(r"[-_:.]+", title) if w]
        told = {w for before, w in zip(["", *words], words, strict=False) if before not in LAYOUT_WORDS}
        named = told & DROPPED_WORDS or told & OUTER_WORDS if not told & OWN_WORDS else told & DROPPED_WORDS
        if named and named == set(words):
            return "surely"
        if named:
            how = "replies" if how == "replies" or named & REPLY_WORDS else "maybe"
    return how


class Page:
    """The blocks of a page in order; what is dropped leaves WINDOW empty lines.

    lines: (text, plain, article, parent) of each block. plain: characters of the text outside links; links
    of headings count as text. article: number of the outermost article or main element that holds the
    block, 0 for none. parent: number of the element that holds it. tree: (name, parent) of each element.
    """

    def __init__(self, page: str) -> None:
        self.tree: list[tuple[str, int]] = [("", 0)]
        self.doubts: dict[int, str] = {}  # elements that one word of a compound name calls boilerplate
        found = self._read(page)
        gone = self._gone(found)
        self.lines = [x[:4] for x in found if not (gone.intersection(x[4]) or x[5] and x[5] not in gone)]

    def _gone(self, found: list[tuple]) -> set[int]:
        """The doubts that are dropped: all but those that hold the article or most of the page's text."""
        own, plain, articles = ({one: kind() for one in self.doubts} for kind in (int, int, set))
        total, sure = 0, {}
        for text, _, article, _, doubts, _ in found:
            counts = not any(self.doubts[k] == "replies" for k in doubts)
            total += len(text) * counts
            if article and not doubts:
                sure[article] = sure.get(article, 0) + len(text)
            for k in doubts:
                own[k] += len(text)
                plain[k] += len(text) * counts
                if article:
                    articles[k].add(article)
        gone = set()
        for one, how in self.doubts.items():
            other = total - plain[one]
            most = own[one] > other if how == "maybe" else other < SURGE
            if max(sure.values(), default=0) >= SURGE and not articles[one] & sure.keys():
                most = False  # the article is elsewhere
            if not most and (sure or len(articles[one]) != 1):
                gone.add(one)
        return gone

    def _read(self, page: str) -> list[tuple]:
        """Lines with the doubts that hold them, and for empty lines the doubt that they stand for."""
        lines: list[tuple] = []
        parts: list[str] = []
        linked: list[str] = []  # those parts that are inside links
        # name, dropped, article, own number, doubts, and whether text is a link's (1) or a heading's (2)
        stack: list[tuple[str, bool, int, int, tuple[int, ...], int]] = [("", False, 0, 0, (), 0)]
        header = 0  # open header elements inside an article: only their headings count

        def flush() -> None:
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                plain = max(0, len(text) - len(" ".join(html.unescape(" ".join(linked)).split())))
                parts.clear()
                linked.clear()
                if text:
                    block = next((e for e in reversed(stack) if e[0] not in INLINE and e[0] != "p" and e[0] not in HEADINGS), stack[0])
                    lines.append((text, plain, stack[-1][2], block[3], stack[-1][4], 0))

        def gap(doubt: int = 0) -> None:
            lines.extend([("", 0, 0, 0, (), doubt)] * WINDOW)

        def close(depth: int) -> None:
            if any(e[1] for e in stack[depth:]) and not stack[depth - 1][1]:
                gap()
            for e in stack[depth:]:
                if e[3] in self.doubts:
                    gap(e[3])
            del stack[depth:]

        at, size = 0, len(page)
        while at < size:
            found = _TOKEN.search(page, at)
            start = found.start() if found else size
            if start > at and not stack[-1][1] and (not header or any(e[0] in HEADINGS for e in stack)):
                parts.append(page[at:start])
                if stack[-1][5] == 1:
                    linked.append(page[at:start])
            if not found:
                break
            at = found.end()
            if not found["name"]:
                continue
            name = found["name"].lower()
            if found["end"]:
                if name not in INLINE:
                    flush()
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if depth and name in INLINE and any(e[0] not in INLINE for e in stack[depth:]):
                    depth = 0  # an inline end tag does not close blocks
                if depth:
                    if any(e[3] in self.doubts for e in stack[depth:]):
                        flush()
                    header -= sum(e[0] == "header" and not e[1] for e in stack[depth:])
                    close(depth)
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else size
                continue
            if name in SPACE and not stack[-1][1]:
                parts.append(" ")
            if name in VOID:
                continue
            if name not in INLINE and name not in SPACE:
                flush()
                for i in range(len(stack) - 1, 0, -1):  # a block closes an open paragraph, a list item its elder
                    if stack[i][0] == "p" or stack[i][0] == name == "li":
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            _, inside, article, parent, doubts, kind = stack[-1]
            how = "" if inside else _dropped(name, found["attrs"])
            drop = inside or how == "surely"
            if name == "header" and not drop:
                drop, header = not article, header + bool(article)
            number = len(self.tree)
            self.tree.append((name, parent))
            if not inside and (drop or how):
                flush()
                gap(0 if drop else number)
            if name in ("article", "main") and not article and not drop:
                article = number
            if not found["attrs"].rstrip().endswith("/") or name not in INLINE | DROPPED:
                if how and not drop:
                    self.doubts[number] = how
                    doubts = (*doubts, number)
                kind = 2 if kind == 2 or name in HEADINGS else int(kind == 1 or name == "a")
                stack.append((name, drop, article, number, doubts, kind))
            elif drop and not inside:
                gap()
        flush()
        return lines

    def common(self, numbers: set[int]) -> int:
        """The innermost element that holds all these and is no item of a row of such, 0 if that is the whole page."""
        one, last = min(numbers), max(numbers)  # numbers go by start tags: what holds these two holds all
        while one != last:
            one, last = min(one, self.tree[last][1]), max(one, self.tree[last][1])
        while self.tree[one][0] in ITEMS:
            one = self.tree[one][1]
        return 0 if self.tree[one][0] in ("", "html", "body") else one

    def within(self, some: set[int]) -> set[int]:
        """These elements and all inside them."""
        out = set(some)
        for number, (_, parent) in enumerate(self.tree):
            if parent in out:
                out.add(number)
        return out


def _regions(size: list[int], weight: list[int]) -> list[tuple[int, int]]:
    """(first line, line behind the last) of what lies between the surge and dive points of weight's window sums.

    The sum dives under DIVE percent of the window's size, or to nothing. Lines of links at the ends of a
    region only share a window with its text, so it begins and ends at lines which are text by themselves.
    """
    above = lambda w, n: 0 < w and 100 * w >= DIVE * n
    out: list[tuple[int, int]] = []
    start = None
    for i in range(len(size) + 1):
        low = max(0, i - WINDOW + 1)
        on = i < len(size) and above(sum(weight[low:i + 1]), sum(size[low:i + 1]))
        # A long run of links can pull the window down before a line that is text has left it.
        on = on or i < len(size) and above(weight[i], size[i])
        if on and start is None:
            start = i
        elif not on and start is not None:
            text = [k for k in range(start, i) if above(weight[k], size[k])]
            if text:
                out.append((text[0], text[-1] + 1))
            start = None
    return out


def main_text(page: str | None) -> str:
    """The blocks between surge and dive points of the line-block distribution, one a line.

    The weight of a line is that of its text outside links; the distribution is the sum over WINDOW lines.
    A region begins where the sum rises and ends where it dives under DIVE percent of all text there
    (lines of links) or to nothing (dropped boilerplate makes WINDOW empty lines); it is text if the sum
    surges to SURGE somewhere. All these regions are kept, with short ones inside the same element. Of pages
    with article or main elements only the lines of the longest one count; there other short regions stay
    too, but for those between lines of links. Where nothing surges, the text of links counts in full and the
    longest region alone decides.
    """
    tree = Page(page or "")
    lines = tree.lines
    by_article: dict[int, int] = {}
    for text, _, article, _ in lines:
        by_article[article] = by_article.get(article, 0) + len(text)
    own = max((a for a in by_article if a and by_article[a]), key=lambda a: (by_article[a], -a), default=0)
    inside = [article == own or not own for _, _, article, _ in lines]
    size = [len(x[0]) if there else 0 for x, there in zip(lines, inside, strict=True)]
    weight = [x[1] if there else 0 for x, there in zip(lines, inside, strict=True)]
    surges = lambda r: any(sum(weight[max(r[0], i - WINDOW + 1):i + 1]) >= SURGE for i in range(*r))
    regions = _regions(size, weight)
    surging = [r for r in regions if surges(r)]
    if not surging:
        weight = size
        regions = _regions(size, weight)
        surging = [max(regions, key=lambda r: (surges(r), sum(size[r[0]:r[1]]), -r[0]))] if regions else []
    if not regions:
        return ""
    parents = lambda r: {lines[i][3] for i in range(*r) if size[i]}
    strong, homes = set(surging), set.union(*map(parents, surging))
    around = {tree.common(homes)} - {0} or {tree.common(parents(r)) for r in surging} - {0}
    near = homes | tree.within(around)
    if own:
        links = lambda i: 0 <= i < len(size) and size[i] > 0  # noqa: E731  (text beside a region is one of links)
        between = lambda r: links(r[0] - 1) and links(r[1]) and not parents(r) & homes
        kept = [r for r in regions if r in strong or not between(r)]
    else:
        kept = [r for r in regions if r in strong or parents(r) & near]
    return "\n".join(lines[i][0] for r in kept for i in range(*r) if size[i])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text (main text, empty if there is none) and n_chars (its code points) added.

    Null html is an empty page. Rows keep their other columns; columns text and n_chars of the input
    are replaced. An empty table gives no rows.
    """
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(*names)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x) for x in batch.pop("__html")]
            yield batch.assign(text=texts, n_chars=[len(t) for t in texts])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("__html", pages[html_col]).mapInPandas(run, f"{schema}, text string, n_chars long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: edge cases as for extract()."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
