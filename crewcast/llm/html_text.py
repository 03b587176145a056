"""Layout-aware text of HTML pages.

A page's tags are read once into a tree of open elements with implied ends (a new paragraph ends
an open one, a list item the one before it, a cell, row or table section likewise), and visible
text is written out as it passes: blocks stand on lines of their own, headings, paragraphs, lists
and tables apart by a blank line, items carry their bullet or number with indentation by depth,
and the cells of a table are padded to common columns, past the columns and rows that other cells
span. Formulas, labels of drawings, text areas
and the options a selection shows count as text. Scripts, styles, templates, comments, hidden
elements, data lists, descriptions and definitions of drawings, annotations of formulas and what
stands in for missing media, objects or frames show nothing; all other text between tags does.
Attributes (values of inputs, alternative texts, labels of options) are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.llm.words import slices

# Every form consumes at least what it read, an unfinished one up to the end: one pass in linear time.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[=\"'])*+)(?:>|\Z)"
    r"|<[!?][^>]*>?|[^<]+|<",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_UNSEEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.IGNORECASE)

# Element names of the HTML standard by their part in layout.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes".split())
_UNSEEN = frozenset("head script style template noscript iframe object noembed noframes datalist audio video canvas title".split())
#: Not drawn inside a drawing or formula; elsewhere these are unknown elements.
_UNSEEN_IN = {"svg": frozenset("desc metadata defs symbol clippath mask marker pattern".split()), "math": frozenset("annotation annotation-xml".split())}
_APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
_BLOCK = _APART | frozenset(
    "html body address article aside details dialog dd div dt fieldset figcaption footer form header hgroup legend li"
    " main menu nav search section summary tbody thead tfoot tr td th caption center dir optgroup".split()
)
_ENDS_PARAGRAPH = _BLOCK - frozenset("html body td th tr tbody thead tfoot caption optgroup legend summary".split())
# An element is ended by the start of one of these, unless one of the last is open in between.
_IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th".split()), frozenset("table tr".split())),
    "th": (frozenset("td th".split()), frozenset("table tr".split())),
    "tr": (frozenset("tr td th caption".split()), frozenset(["table"])),
    "tbody": (frozenset("tbody thead tfoot tr caption".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr caption".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
_BOUNDARY = frozenset("table td th caption template object".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in _RAW}
_SELECT_END = re.compile(r"</?select(?=[\s/>]|\Z)", re.IGNORECASE)
#: Levels of lists and quotes that still indent.
DEEPEST = 16
#: Cells up to this width are padded to common columns; wider ones stand as they are.
WIDEST_PAD = 120
#: Columns and rows a cell spans at most.
MOST_COLUMNS, MOST_ROWS = 100, 65_534


def _width(text: str) -> int:
    """Columns of a text: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Flow:
    """Lines of one flow: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False  # a blank stands between the last text and the next
        self.gap = 0  # blank lines owed before the next line
        self.prefix: list[str] = []  # indentation by open lists and quotes
        self.marker = ""  # bullet or number of the item that begins

    def text(self, value: str, keep: bool) -> None:
        if keep:
            pieces = value.replace("\r\n", "\n").split("\n")
            for n, piece in enumerate(pieces):
                if n:
                    self.end_line(forced=True)
                if piece:
                    self.parts.append(piece)
            return
        words = _BLANK.sub(" ", value)
        if words[0] == " ":
            self.space = True
        core = words.strip(" ")
        if core:
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(core)
            self.space = words[-1] == " "

    def end_line(self, forced: bool = False) -> None:
        line = "".join(self.parts).rstrip()
        self.parts, self.space = [], False
        if line or self.marker and not forced:
            if not line:
                return
            if self.lines and self.gap:
                self.lines.append("")
            self.gap = 0
            indent = "".join(self.prefix[:DEEPEST])
            if self.marker:
                indent = indent[: max(len(indent) - len(self.marker), 0)] + self.marker
                self.marker = ""
            self.lines.append(indent + line)
        elif forced and self.lines and self.lines[-1]:
            self.gap = max(self.gap, 1) if self.gap else 0

    def apart(self) -> None:
        self.end_line()
        if self.lines:
            self.gap = 1

    def add_lines(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            self.parts = [line]
            self.end_line()

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[list[str]]] = []
        self.covered: dict[int, int] = {}  # columns of this row that a cell above covers, and rows left
        self.below: dict[int, int] = {}

    def row(self) -> None:
        self.rows.append([])
        self.covered = self.below
        self.below = {column: left - 1 for column, left in self.covered.items() if left > 1}

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        while len(row) in self.covered:
            row.append([])
        if rows > 1:
            self.below.update(dict.fromkeys(range(len(row), len(row) + columns), rows - 1))
        row += [lines, *([[]] * (columns - 1))]

    def layout(self) -> list[str]:
        rows = [row for row in self.rows if any(any(cell) for cell in row)]
        widths = [0] * max((len(r) for r in rows), default=0)
        for row in rows:
            for n, cell in enumerate(row):
                widths[n] = max(widths[n], max((w for line in cell if (w := _width(line)) <= WIDEST_PAD), default=0))
        found = []
        for row in rows:
            for n in range(max(len(cell) for cell in row)):
                columns = [cell[n] if n < len(cell) else "" for cell in row]
                padded = [c + " " * (widths[k] - _width(c)) for k, c in enumerate(columns)]
                found.append(" | ".join(padded).rstrip())
        return found


def page_text(page: str) -> str:
    """All visible text of a page, laid out."""
    root = _Flow()
    flows, tables = [root], []
    stack: list[tuple[str, bool]] = []  # element, whether it shows its text
    places: dict[str, list[int]] = {}  # where elements of a name stand open on the stack
    spans: list[tuple[int, int]] = []  # columns and rows of the open cells
    lists: list[list] = []  # kind and next number
    keep = 0  # open <pre>
    chosen: set[int] = set()  # where the options begin that the open selection shows

    def shows() -> bool:
        return not stack or stack[-1][1]

    def close() -> None:
        nonlocal keep
        name, shown = stack.pop()
        places[name].pop()
        if not shown:
            return
        flow = flows[-1]
        if name == "pre":
            keep -= 1
        if name in ("select", "option", "mtd", "mtr"):
            flow.space = True
        if name == "textarea" or name == "text" and places.get("svg"):
            flow.end_line()
        if name in ("td", "th", "caption") and tables and len(flows) > 1:
            lines = flows.pop().done()
            if name == "caption":
                spans.pop()
                flows[-1].add_lines(lines)
            else:
                tables[-1].cell(lines, *spans.pop())
            return
        if name == "table" and tables:
            flow.end_line()
            flow.add_lines(tables.pop().layout())
            flow.apart()
            return
        if name in ("ul", "ol", "menu", "dir") and lists:
            flow.end_line()
            lists.pop()
            if lists:
                flow.gap = 0
            else:
                flow.apart()
            return
        if name in ("li", "dd", "blockquote") and flow.prefix:
            flow.end_line()
            flow.prefix.pop()
            flow.marker = ""
        if name in _APART:
            flow.apart()
        elif name in _BLOCK:
            flow.end_line()

    def close_to(names: frozenset[str], stop: frozenset[str]) -> None:
        """Ends the outermost open element of `names` above the nearest of `stop`."""
        below = last(stop)
        cuts = [open_[at] for name in names if (open_ := places.get(name)) and (at := bisect_right(open_, below)) < len(open_)]
        while cuts and len(stack) > min(cuts):
            close()

    def last(names: frozenset[str]) -> int:
        """Where the innermost open element of `names` stands; -1 without any."""
        return max((open_[-1] for name in names if (open_ := places.get(name))), default=-1)

    at = 0
    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        name = token.group(2)
        if name is None:
            value = token.group(0)
            if (value[0] != "<" or len(value) == 1) and shows():
                flows[-1].text(html.unescape(value) if "&" in value else value, keep > 0)
            continue
        name = name.lower()
        if token.group(1):
            if places.get(name):
                if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "li", "ul", "ol") or last(_BOUNDARY) <= last(frozenset([name])):
                    while stack[-1][0] != name:
                        close()
                    close()
            elif name == "p" and shows():
                flows[-1].apart()
            elif name == "br" and shows():
                flows[-1].end_line(forced=True)
            continue
        if name in _ENDS_PARAGRAPH:
            close_to(frozenset(["p"]), _BOUNDARY | frozenset(["button"]))
        if name in _IMPLIED_END:
            close_to(*_IMPLIED_END[name])
        shown = shows() and name not in _UNSEEN and not _is_hidden(token.group(3))
        foreign = places.get("svg") or places.get("math")
        if foreign and any(places.get(outer) and name in names for outer, names in _UNSEEN_IN.items()):
            shown = False
        if name == "option" and places.get("select") and token.start() not in chosen:
            shown = False
        if name in _VOID:
            if shown and name == "br":
                flows[-1].end_line(forced=True)
            elif shown and name == "hr":
                flows[-1].apart()
            continue
        if token.group(3).endswith("/") and name not in _BLOCK and (foreign or name not in _RAW):
            continue
        flow = flows[-1]
        if shown:
            if name in ("td", "th", "caption"):
                if tables:
                    flows.append(_Flow())
                    spans.append(_spans(token.group(3)))
                else:
                    flow.end_line()
            elif name == "table":
                flow.apart()
                tables.append(_Table())
            elif name == "tr" and tables:
                tables[-1].row()
            elif name in ("ul", "ol", "menu", "dir"):
                if lists:
                    flow.end_line()
                else:
                    flow.apart()
                lists.append([name, _number(token.group(3), "start", 1)])
            elif name in ("li", "dd", "blockquote"):
                if name == "blockquote":
                    flow.apart()
                else:
                    flow.end_line()
                marker = ""
                if name == "li":
                    marker = "- "
                    if lists and lists[-1][0] == "ol":
                        lists[-1][1] = _number(token.group(3), "value", lists[-1][1])
                        marker = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                flow.prefix.append(" " * (len(marker) or 2))
                flow.marker = marker
            elif name == "pre":
                flow.apart()
                keep += 1
            elif name in ("select", "option", "mtd", "mtr"):
                flow.space = True
                if name == "select":
                    chosen = _shown_options(page, at, token.group(3))
            elif name == "textarea" or name == "text" and places.get("svg"):
                flow.end_line()
            elif name in _APART:
                flow.apart()
            elif name in _BLOCK:
                flow.end_line()
        # Prefixes are taken off only where they were put on: an unseen element changes no layout.
        stack.append((name, shown))
        places.setdefault(name, []).append(len(stack) - 1)
        if name in _RAW:  # only its own end tag ends the text of such an element
            end = _RAW_END[name].search(page, at)
            begin, at = at, end.start() if end else len(page)
            if name == "textarea" and shown and begin < at:
                flow.text(html.unescape(page[begin:at]), True)
    while stack:
        close()
    return "\n".join(root.done())


def _number(attributes: str, name: str, default: int) -> int:
    """The whole number of an attribute."""
    if name in attributes.lower():
        for found, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).strip()
            if found.lower() == name and len(value) < 10 and value.removeprefix("-").isdecimal():
                return int(value)
    return default


def _spans(attributes: str) -> tuple[int, int]:
    """Columns and rows of a cell; no rows means all that follow."""
    columns, rows = _number(attributes, "colspan", 1), _number(attributes, "rowspan", 1)
    return min(max(columns, 1), MOST_COLUMNS), MOST_ROWS if rows == 0 else min(max(rows, 1), MOST_ROWS)


def _shown_options(page: str, at: int, attributes: str) -> set[int]:
    """Where the options begin that a selection shows: all of a list, else the one selected or first."""
    of = {name.lower(): "".join(values) for name, *values in _ATTRIBUTE.findall(attributes)}
    size = of.get("size", "")
    end = _SELECT_END.search(page, at)
    until = end.start() if end else len(page)
    options = []
    while at < until:
        token = _TOKEN.match(page, at, until)
        at = token.end()
        if token.group(2) and not token.group(1) and token.group(2).lower() == "option":
            names = {name.lower() for name, *_ in _ATTRIBUTE.findall(token.group(3))}
            options.append((token.start(), "selected" in names, "disabled" in names))
    if "multiple" in of or size.isdecimal() and int(size[:6]) > 1:
        return {start for start, _, _ in options}
    picked = [start for start, selected, _ in options if selected][-1:]
    return set(picked or [start for start, _, disabled in options if not disabled][:1])


def _is_hidden(attributes: str) -> bool:
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden":
            return True
        if name == "style" and _UNSEEN_STYLE.search("".join(values)):
            return True
    return False


def _text_rows(batches):
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = [None if page is None else page_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def html_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of pages (page_id, url, html).

    A null page has a null text; an empty page, or one with nothing visible, an empty text. Rows
    without an id or url and repeated rows are rendered like any other. Other columns are ignored.
    One pass over the rows, without a shuffle.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_text_rows, "page_id bigint, url string, text string")
