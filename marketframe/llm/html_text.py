"""HTML extraction by layout-aware rendering.

A page becomes a tree (implied end tags, void and raw-text elements, entities), the tree is rendered to text: hidden
parts are left out, blocks stand on lines of their own, paragraphs and headings are set apart by an empty line, list
items carry bullets or numbers and nested lists are indented, table cells are padded to the width of their column, also
where cells span rows or columns. Hidden is what the element itself, its style attribute or a rule of the page's style
sheets takes out by display or visibility (rules for tags, classes, ids and combinations of these; other selectors and
rules inside @ blocks are not applied). Of controls their text shows: the chosen option, values and labels of buttons.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import read

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe embed canvas audio video datalist progress meter noembed noframes title annotation annotation-xml".split())
#: Parts of drawings that are defined, not drawn.
UNDRAWN = frozenset("desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
#: Blocks set apart by an empty line, and other blocks.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address fieldset form legend details summary dt dd li tr caption figcaption center dir menu search hgroup option optgroup".split()
)
#: Elements whose end is implied by the start of another: opening one of the values closes an open key.
_P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul center dir li dt dd".split())
CLOSED_BY = {
    "p": _P_ENDERS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "optgroup": frozenset(["optgroup"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "tbody": frozenset(["tbody", "thead", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]),
    "tfoot": frozenset(["tbody"]),
    "caption": frozenset(["tr", "tbody", "thead", "tfoot", "colgroup", "td", "th"]),
    "colgroup": frozenset(["tr", "tbody", "thead", "tfoot", "td", "th", "caption"]),
    "head": frozenset(["body"]) | _P_ENDERS,
    "rt": frozenset(["rt", "rp"]),
    "rp": frozenset(["rt", "rp"]),
}
#: An implied end does not reach beyond these.
SCOPE = {"li": frozenset(["ul", "ol", "menu", "dir"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
_WALL = frozenset(["table", "td", "th", "caption", "html", "body", "button", "object", "template"])
_TABLE_WALL = frozenset(["table", "html", "template"])
_TABLE_PARTS = frozenset("tr td th tbody thead tfoot caption colgroup".split())
_GROUPS = frozenset(["tbody", "thead", "tfoot"])
_CLOSES = {tag: [there for there, closers in CLOSED_BY.items() if tag in closers] for tag in frozenset().union(*CLOSED_BY.values())}

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:\s+|/|[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?|[\"'=])*)>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
STYLE = re.compile(r"<style[^>]*>(.*?)(?:</style|\Z)", re.S | re.I)
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)", re.I)
SHOWN_VALUES = frozenset(["submit", "reset", "button", "text", "search", "email", "url", "tel", "number", "date", "time", ""])
SPACES = re.compile("[ \t\n\r\f]+")


class Node:
    """An element: ``hidden`` ones take no place, ``seen`` is False or True where visibility changes, None to inherit."""

    __slots__ = ("tag", "hidden", "seen", "given", "children")

    def __init__(self, tag: str, hidden: bool = False, seen: bool | None = None, given: dict[str, str] | None = None):
        self.tag, self.hidden, self.seen, self.given, self.children = tag, hidden, seen, given or {}, []

    def number(self, name: str, otherwise: int) -> int:
        value = self.given.get(name, "").strip()
        return int(value[:9]) if value.lstrip("+-").isdecimal() and value.isascii() else otherwise


def declared(style: str) -> dict[str, str]:
    """Value of display, visibility and content-visibility; of several declarations the last one counts."""
    out = {}
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        if name.strip() in ("display", "visibility", "content-visibility") and value.strip():
            out[name.strip()] = value.replace("!important", "").strip()
    return out


def rules(html: str) -> list[tuple]:
    """(weight, tag, ids, classes, declarations) of the page's style rules that hide or show, weak ones first."""
    out = []
    for sheet in STYLE.findall(html) if "<style" in html.lower() else ():
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)
        # blocks like @media and all in them
        plain, depth, at = [], 0, 0
        for mark in re.finditer(r"@[^{};]*[{;]|[{}]", sheet):
            if depth == 0 and mark.group()[0] == "@":
                plain.append(sheet[at : mark.start()])
                depth, at = int(mark.group()[-1] == "{"), mark.end()
            elif depth:
                depth += 1 if mark.group()[-1] == "{" else -1 if mark.group() == "}" else 0
                at = mark.end()
        for selectors, style in RULE.findall("".join([*plain, "" if depth else sheet[at:]])):
            if not (effect := declared(style)):
                continue
            for selector in selectors.split(","):
                found = SELECTOR.fullmatch(selector.strip())
                if found and found.group():
                    names = re.findall(r"[.#][\w-]+", found.group(2))
                    ids, classes = ({n[1:] for n in names if n[0] == sign} for sign in "#.")
                    tag = (found.group(1) or "*").lower()
                    out.append(((len(ids), len(classes), tag != "*"), tag, ids, classes, effect))
    return sorted(out, key=lambda r: r[0])


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


def parse(html: str) -> Node:
    """The tree of a page; text is kept as strings between nodes."""
    root = Node("html")
    stack = [root]
    open_tags = {"html": 1}
    sheet = rules(html)

    def styled(tag: str, given: dict[str, str]) -> tuple[bool, bool | None]:
        effect = {"display": "none"} if tag in HIDDEN or "hidden" in given else {}
        if sheet:
            own, names = given.get("id"), given.get("class", "").split()
            for _, wanted, ids, classes, style in sheet:
                if wanted in ("*", tag) and ids <= {own} and classes.issubset(names):
                    effect |= style
        if "style" in given:
            effect |= declared(given["style"])
        if tag in HIDDEN:  # nothing of these is text, whatever a style says
            effect["display"] = "none"
        seen = {"hidden": False, "collapse": False, "visible": True}.get(effect.get("visibility", ""))
        return effect.get("display") == "none" or effect.get("content-visibility") == "hidden", seen

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    at, size = 0, len(html)
    while at < size:
        token = TOKEN.match(html, at)
        at = token.end()
        end, start = token.group(1), token.group(2)
        if start is None and end is None:
            text = token.group()
            drawn = not open_tags.get("svg") or open_tags.get("text") or open_tags.get("foreignobject")
            if drawn and (text[0] != "<" or len(text) == 1):
                stack[-1].children.append(unescape(text))
            continue
        if end is not None:
            tag = end.lower()
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not open_tags.get("p"):
                stack[-1].children.append(Node("p"))
            elif open_tags.get(tag) and tag != "html":
                wall = _TABLE_WALL if tag in _TABLE_PARTS else _WALL
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close_to(depth)
                        break
                    if stack[depth].tag in wall and tag not in ("table", "body", "html"):
                        break
            continue
        tag = start.lower()
        if tag in ("html", "body") and open_tags.get(tag):
            continue
        wall = _TABLE_WALL if tag in _TABLE_PARTS else _WALL
        closes = any(open_tags.get(there) for there in _CLOSES.get(tag, ()))
        for depth in range(len(stack) - 1, 0, -1) if closes else ():
            there = stack[depth].tag
            if tag in CLOSED_BY.get(there, ()):
                close_to(depth)
                if tag not in _TABLE_PARTS:
                    break
            elif there in wall or tag in SCOPE and there in SCOPE[tag]:
                break
        if tag in ("td", "th") and (stack[-1].tag == "table" or stack[-1].tag in _GROUPS):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
            open_tags["tr"] = open_tags.get("tr", 0) + 1
        source = token.group(3)
        foreign = tag in ("svg", "math") or open_tags.get("svg") or open_tags.get("math")
        given = attributes(source) if source and not source.isspace() else {}
        hidden, seen = styled(tag, given) if given or sheet else (tag in HIDDEN, None)
        hidden = hidden or bool(tag in UNDRAWN and open_tags.get("svg"))
        node = Node(tag, hidden, seen, given)
        if tag == "img" and given.get("alt"):
            node.children.append(given["alt"])
        elif tag == "input" and given.get("type", "").lower() in SHOWN_VALUES:
            node.children.append(given.get("value") or given.get("placeholder", ""))
        if tag in RAW:
            closing = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)[^>]*>?", re.I).search(html, at)
            body = html[at : closing.start()] if closing else html[at:]
            at = closing.end() if closing else size
            if tag in ("textarea", "title", "xmp", "plaintext"):
                node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            stack[-1].children.append(node)
            continue
        stack[-1].children.append(node)
        if tag not in VOID and not (foreign and source and source.rstrip().endswith("/")):
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def width(text: str) -> int:
    """Columns a text takes: wide characters count twice, combining ones not at all."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines under construction: pending empty lines, the current line, the indent of open lists."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.indents: list[str] = []
        self.lead: str | None = None
        self.space = False

    def text(self, value: str, pre: bool) -> None:
        if pre:
            if self.space and self.line:
                self.line.append(" ")
            self.space = False
            parts = value.replace("\r\n", "\n").split("\n")
            for n, part in enumerate(parts):
                if n:
                    self.end(keep=True)
                if part:
                    self.line.append(part)
            return
        if not value:
            return
        words = SPACES.sub(" ", value)
        if words[0] == " " and self.line:
            self.space = True
        words_in = words.strip(" ")
        if words_in:
            if self.space:
                self.line.append(" ")
            self.line.append(words_in)
            self.space = words[-1] == " "

    def end(self, keep: bool = False) -> None:
        """Finish the current line."""
        self.space = False
        if not self.line and not keep:
            return
        text = "".join(self.line).rstrip(" ")
        self.line = []
        if not text.strip() and not keep:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = self.lead if self.lead is not None else "".join(self.indents)
        self.lead = None
        self.lines.append((lead + text).rstrip(" ") if text else "")

    def gap(self) -> None:
        self.end()
        self.blank = True


def parts_of(table: Node) -> Iterator[tuple[Node | str, str]]:
    """Children of a table and of its row groups that take place, with the tag of their group."""
    work = [(iter(table.children), "tbody")]
    while work:
        child = next(work[-1][0], None)
        if child is None:
            work.pop()
        elif isinstance(child, str) or not child.hidden:
            if isinstance(child, Node) and child.tag in _GROUPS:
                work.append((iter(child.children), child.tag))
            else:
                yield child, work[-1][1]


def _table(table: Node, page: Page, seen: bool) -> Iterator[tuple[Node, Page, bool, bool]]:
    """A data table: one line a row (cells of several lines take as many), cells padded to their column's width. Heads
    come first and feet last; what stands outside of rows comes before them."""
    page.gap()
    rows = []
    for child, group in parts_of(table):
        if isinstance(child, str):
            if child.strip() and seen:
                page.text(child, False)
                page.end()
        elif child.tag == "tr":
            rows.append((("thead", "tbody", "tfoot").index(group), child))
        else:
            yield child, page, False, seen
            page.end()
    rows = [row for _, row in sorted(rows, key=lambda r: r[0])]
    taken: list[int] = []  # rows for which each column still belongs to a cell from above
    grid = []
    for row in rows:
        cells, column = [], 0
        row_seen = seen if row.seen is None else row.seen
        taken = [max(n - 1, 0) for n in taken]
        for child in row.children:
            if isinstance(child, str) and not child.strip() or isinstance(child, Node) and child.hidden:
                continue
            cell = child if isinstance(child, Node) else _text_node(child)
            inner = Page()
            yield cell, inner, False, row_seen
            inner.end()
            while column < len(taken) and taken[column]:
                column += 1
            across = min(max(cell.number("colspan", 1), 1), 1000)
            taken += [0] * (column + across - len(taken))
            taken[column : column + across] = [max(cell.number("rowspan", 1), 1)] * across
            cells.append((column, across, inner.lines or [""]))
            column += across
        grid.append(cells)
    widths = [0] * len(taken)
    for single in (True, False):
        for cells in grid:
            for column, across, lines in cells:
                if (across == 1) == single:
                    there = sum(widths[column : column + across]) + 2 * (across - 1)
                    widths[column + across - 1] += max(max(map(width, lines)) - there, 0)
    begins = [sum(widths[:n]) + 2 * sum(w > 0 for w in widths[:n]) for n in range(len(widths))]
    for cells in grid:
        for n in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, at = [], 0
            for column, _, lines in cells:
                part = lines[n] if n < len(lines) else ""
                if part:
                    line.append(" " * (begins[column] - at) + part)
                    at = begins[column] + width(part)
            page.line.append("".join(line))
            page.end()
    page.gap()


def chosen(select: Node) -> list[Node]:
    """The options that a list box shows: all, or of a drop-down list the last selected one, else the first."""
    options, work = [], [select]
    while work:
        node = work.pop()
        for child in reversed(node.children):
            if isinstance(child, Node) and not child.hidden:
                work.append(child)
        if node.tag == "option":
            options.append(node)
    if "multiple" in select.given or select.number("size", 1) > 1:
        return options
    picked = [o for o in options if "selected" in o.given] or [o for o in options if "disabled" not in o.given][:1] or options[:1]
    return picked[-1:]


def _text_node(text: str) -> Node:
    node = Node("span")
    node.children.append(text)
    return node


def render(node: Node, page: Page, pre: bool) -> None:
    """Append the visible text below ``node``; open elements wait on a list, so their depth has no limit."""
    work = [_element(node, page, pre, True)]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
        else:
            work.append(_element(*inner))


def _element(node: Node, page: Page, pre: bool, seen: bool) -> Iterator[tuple[Node, Page, bool, bool]]:
    """Append an element; the elements in it are handed out and appended before the next step."""
    tag = node.tag
    if node.hidden:
        return
    seen = seen if node.seen is None else node.seen
    if tag == "br":
        page.end(keep=True)
        return
    if tag == "table":
        yield from _table(node, page, seen)
        return
    listed = tag in ("ul", "ol", "menu", "dir")
    if listed and page.indents:
        page.end()
    elif tag in SPACED and not (page.lead is not None and not page.line):
        page.gap()
    elif tag in BLOCK and tag != "option" and not (page.lead is not None and not page.line):
        page.end()
    if tag == "hr":
        if seen:
            page.line.append("---")
        page.gap()
        return
    pre = pre or tag in ("pre", "xmp", "plaintext", "textarea")
    children = node.children
    if tag == "select":
        children = chosen(node)
    elif tag == "details" and "open" not in node.given:
        children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
    step = -1 if "reversed" in node.given else 1
    number = node.number("start", 1 if step > 0 else sum(isinstance(c, Node) and c.tag == "li" and not c.hidden for c in children)) if tag == "ol" else 1
    if tag in ("td", "th", "text", "select", "textarea", "input", "button", "option") and page.line:
        page.space = True
    for child in children:
        if isinstance(child, str):
            if seen:
                page.text(child, pre)
        elif child.tag == "li" and not child.hidden and listed:
            page.end()
            number = child.number("value", number) if tag == "ol" else number
            mark = f"{number}. " if tag == "ol" else "- "
            number += step
            outer = page.lead if page.lead is not None else "".join(page.indents)
            page.lead = outer + (mark if (seen if child.seen is None else child.seen) else " " * len(mark))
            page.indents.append(" " * len(mark))
            yield child, page, pre, seen
            page.end()
            page.indents.pop()
            page.lead = None
        elif child.tag in ("dd", "blockquote") and not child.hidden:
            page.end()
            if child.tag == "blockquote":
                page.gap()
            page.indents.append("    " if child.tag == "dd" else "> ")
            yield child, page, pre, seen
            page.end()
            page.indents.pop()
        else:
            yield child, page, pre, seen
    if listed and page.indents:
        page.end()
    elif tag in SPACED:
        page.gap()
    elif tag in BLOCK and tag != "option":
        page.end()
    elif tag in ("select", "textarea", "input", "button") and page.line:
        page.space = True


def extract(html: str) -> str:
    """Visible text of a page, lines joined by newlines."""
    page = Page()
    render(parse(html), page, False)
    page.end()
    return "\n".join(page.lines).strip("\n")


def rendered(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_lines.

    A missing or empty html gives an empty text with no lines; a missing page_id or url stays missing; repeated rows
    are rendered each; other columns are not read. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(2)
            for at in range(0, batch.num_rows, 500):
                texts = [extract(h.as_py() or "") for h in html.slice(at, 500)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), batch.column(1).slice(at, 500), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    text = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return text.withColumns({"n_chars": F.length("text").cast("long"), "n_lines": lines.cast("long")})


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(read(spark, sf_dir, "pages"))


QUERIES = {"op10_html_text": op10_html_text}
SQL: dict[str, str] = {}
