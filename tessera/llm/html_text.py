"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines: each block element begins one, and what has no text makes none, however deep its tags. Tags
shape the lines and nothing else. Elements that are never main text (menus, headers and footers, sidebars, forms, adverts,
notices, reader comments) leave GAP empty lines, or one inside an article. Where a page marks an article, GAP empty lines
part it from the rest, and lines outside have no length; elsewhere the length of a line is that of its text outside links.

Then the sums of lengths over windows of WINDOW lines decide. Where a sum surges past the threshold text begins, which
reaches back to the last dive; where the sums dive to nothing it ends. The lines between are kept; where no article is marked,
so are lines with text outside links between two kept ones. Of several stretches only those stay in which some sum passes the
threshold: a short text in a block of its own goes, and so does a teaser that is marked as an article of its own. On pages of
short lines, where no sum passes it, the threshold is nothing.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_batches

WINDOW, THRESHOLD, GAP = 3, 86, 3

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^'">]|"[^"]*"|'[^']*')*)>|<[!?/](?:[^>]*)>""", re.S)
_LOOSE = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s"'>][^\s>]*+))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_NEVER = {"nav", "footer", "aside", "form", "button", "select", "option", "datalist", "svg", "canvas", "object", "audio", "video", "map", "menu", "dialog", "fieldset", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "body", "html", "head", "summary", "figcaption"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = {"ul", "ol", "table", "div", "article", "section", "main", "body", "dl", "blockquote", "td", "th", "aside", "nav", "footer", "header", "form"}
_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "banner", "banners", "sponsor", "sponsored", "promo", "promotion", "sidebar", "comment", "comments", "commentlist", "disqus", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "share", "sharing", "social", "related", "recommended", "recommendations", "newsletter", "subscribe", "signup", "login", "popup", "modal", "overlay", "widget", "widgets", "pagination", "pager", "toolbar", "masthead", "footer", "toc"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog"}
_SPLIT = re.compile(r"[\s_-]+")


def _judge(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is never main text; whether it is the page's article."""
    main = name in ("article", "main")
    if name in _NEVER or (name == "header" and not in_article):
        return True, False
    if "=" in attributes or "hidden" in attributes.lower():
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                words = set(_SPLIT.split(value))
                if name not in ("body", "html", "article", "main") and (words & _WORDS or ("header" in words and not in_article and name in ("div", "section"))):
                    return True, False
            elif key == "role":
                if value in _ROLES:
                    return True, False
                main |= value in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                return True, False
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, False
            elif key == "itemprop" and value == "articlebody":
                main = True
    return False, main


Line = tuple[str, int, bool]


def lines_of(html: str) -> list[Line]:
    """(text, characters outside links, inside an article) of every line; what parts stretches is lines without text."""
    lines: list[Line] = []
    parts: list[str] = []
    plain = links = skipped = article = 0
    stack: list[tuple[str, bool, bool]] = []  # name, begins what is never main text, begins an article
    places: dict[str, list[int]] = {}  # where in the stack the elements of a name are, and those that end a scope
    scopes: list[int] = []

    def end_line() -> None:
        nonlocal plain
        text = " ".join("".join(parts).split()) if parts else ""
        if text:  # tags alone make no line
            lines.append((text, plain, article > 0))
        parts.clear()
        plain = 0

    def part(n: int) -> None:
        """At least n lines without text."""
        end_line()
        have = 0
        while have < min(n, len(lines)) and not lines[-1 - have][0]:
            have += 1
        lines.extend([("", 0, article > 0)] * (n - have))

    def add(text: str) -> None:
        nonlocal plain
        if not skipped and text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if not links:
                plain += len("".join(text.split()))

    def push(name: str, never: bool, main: bool) -> None:
        nonlocal links, skipped, article
        if not skipped and (never or main):
            part(1 if never and article else GAP)
        places.setdefault(name, []).append(len(stack))
        if name in _SCOPE:
            scopes.append(len(stack))
        stack.append((name, never, main))
        skipped += never
        article += main
        links += name == "a"

    def pop() -> None:
        nonlocal links, skipped, article
        name, never, main = stack.pop()
        places[name].pop()
        if name in _SCOPE:
            scopes.pop()
        if name in _BLOCK and not skipped:
            end_line()
        skipped -= never
        article -= main
        if main and not skipped:
            part(GAP)
        links -= name == "a"

    def open_at(names: set[str]) -> int:
        """Where the innermost open element of some names is, if no scope ends between; or -1."""
        at = max((places[x][-1] for x in names if places.get(x)), default=-1)
        return at if not scopes or at >= scopes[-1] else -1

    def close(at: int) -> None:
        while len(stack) > at >= 0:
            pop()

    at, n = 0, len(html)
    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            add(html[at:])
            break
        if begin > at:
            add(html[at:begin])
        found = _TOKEN.match(html, begin) or _LOOSE.match(html, begin)
        if not found:
            if re.match(r"[a-zA-Z/!?]", html[begin + 1 : begin + 2] or "/"):
                break  # a tag that the page's end cuts off
            add("<")
            at = begin + 1
            continue
        at = found.end()
        groups = found.groupdict()
        name = (groups.get("name") or "").lower()
        if not name:
            continue
        if groups["close"]:
            if places.get(name):
                close(places[name][-1])
            elif name in _BLOCK and not skipped:
                end_line()
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name == "br" or name == "hr":
            add("\n")
        if name in _ENDS_P:
            close(open_at({"p"}))
        if siblings := _SIBLINGS.get(name):
            close(open_at(siblings))
        if name in _BLOCK and not skipped:
            end_line()
        if name not in _VOID:
            push(name, *_judge(name, groups["attributes"] or "", article > 0))
    close(0)
    end_line()
    return lines


def kept_lines(lines: list[Line]) -> list[int]:
    """The lines between surge and dive."""
    marked = any(text and own for text, _, own in lines)
    sizes = [(len(text) if own else 0) if marked else plain for text, plain, own in lines]
    sums, window = [], sum(sizes[:WINDOW])
    for k in range(len(sizes)):
        sums.append(window)
        window += (sizes[k + WINDOW] if k + WINDOW < len(sizes) else 0) - sizes[k]
    threshold = THRESHOLD if max(sums, default=0) > THRESHOLD else 0
    kept, inside, dived = [], False, 0
    for k, total in enumerate(sums):
        if total == 0:
            inside, dived = False, k + 1
        elif not inside and total > threshold and sizes[k]:
            inside = True
            kept += [j for j in range(dived, k) if sizes[j]]
        if inside and lines[k][0] and (sizes[k] or not marked):
            kept.append(k)
    if kept and not marked:
        own = set(kept)
        kept = [k for k in range(kept[0], kept[-1] + 1) if k in own or sizes[k]]
    return kept


def main_text(html: str | None) -> str:
    """Blocks of the main text in page order, joined by an empty line; empty if there is none."""
    if not html:
        return ""
    lines = lines_of(html)
    return "\n\n".join(lines[k][0] for k in kept_lines(lines))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key long, url string, text string, n_chars long) of every row. Null html is empty and gives an empty text; repeated
    rows stay; other columns are not looked at; an empty table gives an empty result."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [main_text(x) for x in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["id", "url", "text", "n_chars"])

        return apply

    own = pages.selectExpr(f"cast(`{key}` as long) id", f"cast(`{url}` as string) url", f"`{html}` h")
    return map_batches(own, "id long, url string, text string, n_chars long", make).withColumnRenamed("id", key)
