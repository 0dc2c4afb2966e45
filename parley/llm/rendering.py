"""HTML extraction by layout: all visible text of a page, as a reader would see it.

A tree is built with the tags that HTML leaves out: paragraphs, list items, table parts and options close each other,
rows and sections of tables open where cells need them, and end tags close what is open inside their scope. Hidden
subtrees are dropped (by element, ``hidden``, ``display: none``, ``visibility: hidden``, closed ``details``). Text is
laid out in blocks: white space collapses outside ``pre``, blocks begin lines, paragraphs are parted by one blank line,
list items have bullets or numbers and are indented, and the cells of a table are aligned in columns. What stands in a
table beside its rows comes before them; rows inside another element are rows of the table.

Blanks have a bound, so that a text is never much longer than its page: lines of a cell longer than ``WIDEST`` do not
widen their column, what would begin beyond ``ALIGNED`` follows two blanks after the cell before, and blocks are not
indented beyond ``INDENT``. Text itself is never cut or wrapped.

A null or empty page has an empty text, an empty table of pages an empty result. Broken markup never fails: what cannot
be a tag is text, what is not closed ends with the page. A page is read once, whatever it holds: where a tag has no end
because of its quotes, it and all later tags end at their first ``>``, and without any ``>`` they are text. Elements
nested deeper than ``DEPTH`` are taken as neighbours of their parents, with all their text. Rows are rendered each,
repeated ones too; equal pages have equal texts. Columns other than id and page are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import typed

DEPTH = 200
#: Columns and rows that one cell may span at most, as browsers have it.
SPAN = 1000
#: Longest line of a cell that widens its column, last place of a line where a cell is put by blanks, deepest indentation.
WIDEST = 80
ALIGNED = 160
INDENT = 60

# Fixed values of HTML: names of elements by how they are parsed and shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = set(
    "script style template head title iframe noembed noframes object embed audio video canvas datalist map param "
    "source track meta link base area col colgroup noscript".split()
)
PARTED = set(
    "p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr fieldset listing xmp".split()
)
BLOCK = PARTED | set(
    "html body div section article aside header footer nav main address li dt dd form details summary figcaption "
    "legend center dialog hgroup search optgroup option caption tr td th thead tbody tfoot".split()
)
CLOSES_P = PARTED | set(
    "div section article aside header footer nav main address li dt dd form details summary figcaption center dialog "
    "hgroup search".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "menu", "dir"}
SECTIONS = {"thead", "tbody", "tfoot"}
CELLS = {"td", "th"}
IN_HEAD = set("title style script meta link base template noscript".split())
#: What an element closes if it is open, and the elements behind which it is not looked for.
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = {"table", "td", "th", "caption", "html", "template", "object", "button"}

_MARKUP = re.compile(
    r"""<(?:
        !--(?P<comment>.*?)(?:--!?>|\Z)
      | (?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)>
      | [!?/][^>]*+(?:>|\Z)
    )""",
    re.S | re.X,
)
#: The same where quotes hide no end of a tag.
_PLAIN_MARKUP = re.compile(
    r"""<(?:
        !--(?P<comment>.*?)(?:--!?>|\Z)
      | (?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>
      | [!?/][^>]*+(?:>|\Z)
    )""",
    re.S | re.X,
)
_TAG_LIKE = re.compile(r"<[a-zA-Z]")
_NO_TAG = re.compile(r"<[!?/]")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_NO_SIGHT = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse)\b", re.I)
_SIGHT = re.compile(r"(?:^|;)\s*visibility\s*:\s*visible\b", re.I)
_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"),
          (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


class Node:
    __slots__ = ("name", "attrs", "children", "rows")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs = name, attrs
        self.rows = False  # whether it holds rows of the table around it
        self.children: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if text:
        for name, double, single, bare in _ATTR.findall(text):
            value = double or single or bare
            found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found


class TreeBuilder:
    """The tree of a page, with implied tags."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]

    def text(self, text: str) -> None:
        if text:
            top = self.open[-1]
            if top.name == "head" and text.strip():
                self.open.pop()
                top = self.open[-1]
            top.children.append(text)

    def _find(self, names: set[str], behind: set[str]) -> int:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                return i
            if self.open[i].name in behind:
                return 0
        return 0

    def _close(self, names: set[str], behind: set[str]) -> None:
        while at := self._find(names, behind):
            del self.open[at:]

    def _push(self, name: str, attrs: dict[str, str]) -> None:
        node = Node(name, attrs)
        if len(self.open) < DEPTH:
            self.open[-1].children.append(node)
            self.open.append(node)
        else:  # a neighbour of the deepest open element
            self.open[-2].children.append(node)
            self.open[-1] = node
        if name == "tr":
            for around in reversed(self.open[:-1]):
                if around.name == "table" or around.rows:
                    break
                around.rows = True

    def start(self, name: str, attrs: dict[str, str]) -> None:
        top = self.open[-1].name
        if name == "html" or name == "body":
            self._close({"head"}, set())
            if name == "body" and not any(n.name == "body" for n in self.open):
                self._push(name, attrs)
            return
        if top == "head" and name not in IN_HEAD:
            self.open.pop()
        if name in CLOSES_P:
            self._close({"p"}, SCOPE)
        if name in HEADINGS and self.open[-1].name in HEADINGS:
            self.open.pop()
        if name in IMPLIED:
            self._close(*IMPLIED[name])
        inside = self._find({"table"}, set()) if name in CELLS or name == "tr" or name in SECTIONS else 0
        if inside:
            if name in CELLS and not self._find({"tr"}, {"table"}):
                self.start("tr", {})
            elif name == "tr" and not self._find(SECTIONS, {"table"}):
                del self.open[inside + 1 :]
                self._push("tbody", {})
        if name in VOID:
            self.open[-1].children.append(Node(name, attrs))
        else:
            self._push(name, attrs)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
        elif name in ("html", "body"):
            return
        elif name in HEADINGS:
            if at := self._find(HEADINGS, SCOPE):
                del self.open[at:]
        else:
            behind = SCOPE - {name} if name not in ("table", "tr") and name not in SECTIONS else {"html"}
            if name in ("tr",) or name in SECTIONS or name in CELLS:
                behind = {"table"}
            elif name == "li":
                behind = SCOPE | LISTS
            if at := self._find({name}, behind):
                del self.open[at:]
            elif name == "p":
                self.start("p", {})
                self.open.pop()


def parsed(page: str) -> Node:
    builder, at, markup = TreeBuilder(), 0, _MARKUP
    size, found = len(page), 0  # at: where text begins; found: where the next tag is looked for
    while at < size:
        found = page.find("<", found)
        tag = markup.match(page, found) if found >= 0 else None
        if tag is None and found >= 0:
            if _TAG_LIKE.match(page, found):
                if markup is _MARKUP:
                    markup = _PLAIN_MARKUP
                    continue
                hidden = _NO_TAG.search(page, found)  # there is no > ahead, so this one runs to the end
                size = hidden.start() if hidden else size
                found = -1
            else:
                found += 1
                continue
        if tag is None:
            builder.text(_unescaped(page[at:size]))
            break
        if found > at:
            builder.text(_unescaped(page[at:found]))
        at = found = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name = name.lower()
        if tag["close"]:
            builder.end(name)
            continue
        builder.start(name, _attributes(tag["attrs"]))
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            raw = page[at : end.start() if end else size]
            if name not in HIDDEN:
                builder.text(_unescaped(raw) if name == "textarea" else raw)
            at = found = end.start() if end else size
            if not end:
                break
        elif name == "plaintext":
            builder.text(page[at:])
            break
    return builder.root


def _unescaped(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def _shown(node: Node) -> bool:
    if node.name in HIDDEN or "hidden" in node.attrs:
        return False
    if node.name == "dialog" and "open" not in node.attrs:
        return False
    style = node.attrs.get("style")
    return not (style and _NO_DISPLAY.search(style))


_DEEPEST = " " * INDENT


class Canvas:
    """Lines of a block under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []  # pieces of the current line
        self.gap = False  # a space is due before the next word
        self.parted = False  # a blank line is due before the next line
        self.bullet = ""

    def words(self, text: str) -> None:
        if not text:
            return
        if _SPACES.match(text) and self.now:
            self.gap = True
        body = _SPACES.sub(" ", text).strip(" ")
        if body:
            if self.gap and self.now:
                self.now.append(" ")
            self.now.append(body)
            self.gap = text[-1] in " \t\n\r\f"

    def flush(self) -> None:
        """Ends the current line if it has anything."""
        if self.now:
            self._line("".join(self.now))
            self.now = []
        self.gap = False

    def _line(self, line: str) -> None:
        if self.parted and self.lines:
            self.lines.append("")
        self.parted = False
        self.lines.append(self.bullet + line)
        self.bullet = " " * len(self.bullet) if self.bullet else ""

    def break_line(self) -> None:
        if self.now:
            self.flush()
        else:
            self._line("")

    def part(self) -> None:
        self.flush()
        self.parted = True

    def block(self, lines: list[str], indent: str = "", first: str | None = None) -> None:
        self.flush()
        for i, line in enumerate(lines):
            deep = line.startswith(_DEEPEST)
            lead = first if first is not None and i == 0 else "" if deep else indent
            self._line((lead + line).rstrip() if line else "")


def _number(kind: str, n: int) -> str:
    if kind in ("a", "A") and n > 0:
        letters = ""
        while n:
            n, rest = divmod(n - 1, 26)
            letters = chr(97 + rest) + letters
        return letters.upper() if kind == "A" else letters
    if kind in ("i", "I") and 0 < n < 4000:
        roman = ""
        for value, sign in _ROMAN:
            roman += sign * (n // value)
            n %= value
        return roman.upper() if kind == "I" else roman
    return str(n)


def _int(text: str | None, default: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(found[1]) if found else default


class Renderer:
    def __init__(self, root: Node) -> None:
        self.root = root

    def lines(self) -> list[str]:
        canvas = Canvas()
        self._children(self.root, canvas, False, True, 0)
        canvas.flush()
        return _trimmed(canvas.lines)

    def _children(self, node: Node, canvas: Canvas, pre: bool, sight: bool, depth: int) -> None:
        for child in node.children:
            if isinstance(child, str):
                if not sight:
                    continue
                if pre:
                    first, *rest = child.replace("\r\n", "\n").split("\n")
                    if first:
                        canvas.now.append(first)
                    for line in rest:
                        canvas.break_line()
                        if line:
                            canvas.now.append(line)
                else:
                    canvas.words(child)
            elif _shown(child):
                self._element(child, canvas, pre, sight, depth)

    def _element(self, node: Node, canvas: Canvas, pre: bool, sight: bool, depth: int) -> None:
        name, style = node.name, node.attrs.get("style")
        if style:
            sight = (sight and not _NO_SIGHT.search(style)) or bool(_SIGHT.search(style))
        if name == "br":
            canvas.break_line()
        elif name == "hr":
            canvas.part()
        elif name == "wbr":
            pass
        elif name == "table":
            canvas.part()
            for line in self._table(node, sight, depth):
                canvas.block([line])
            canvas.part()
        elif name in LISTS:
            canvas.part() if depth == 0 else canvas.flush()
            self._list(node, canvas, pre, sight, depth)
            canvas.part() if depth == 0 else canvas.flush()
        elif name == "details" and "open" not in node.attrs:
            canvas.flush()
            summaries = [c for c in node.children if isinstance(c, Node) and c.name == "summary" and _shown(c)]
            for summary in summaries[:1]:
                self._children(summary, canvas, pre, sight, depth)
            canvas.flush()
        elif name in ("pre", "listing", "xmp"):
            inner = Canvas()
            self._children(node, inner, True, sight, depth)
            inner.flush()
            lines = inner.lines
            canvas.part()
            canvas.block(lines[1:] if lines and not lines[0] else lines)
            canvas.part()
        elif name in ("blockquote", "dd", "figure"):
            inner = Canvas()
            self._children(node, inner, pre, sight, depth)
            inner.flush()
            canvas.flush() if name == "dd" else canvas.part()
            canvas.block(_trimmed(inner.lines), "    " if name != "figure" else "")
            canvas.flush() if name == "dd" else canvas.part()
        elif name in PARTED:
            canvas.part()
            self._children(node, canvas, pre, sight, depth)
            canvas.part()
        elif name in BLOCK:
            canvas.flush()
            self._children(node, canvas, pre, sight, depth)
            canvas.flush()
        elif name == "q":
            canvas.words('"') if sight else None
            self._children(node, canvas, pre, sight, depth)
            canvas.now.append('"') if sight else None
        else:
            self._children(node, canvas, pre, sight, depth)

    def _list(self, node: Node, canvas: Canvas, pre: bool, sight: bool, depth: int) -> None:
        ordered = node.name == "ol"
        number = _int(node.attrs.get("start"), 1)
        step = -1 if "reversed" in node.attrs else 1
        if step < 0 and "start" not in node.attrs:
            number = sum(isinstance(c, Node) and c.name == "li" for c in node.children)
        for child in node.children:
            if isinstance(child, str):
                if sight:
                    canvas.words(child)
                continue
            if not _shown(child):
                continue
            if child.name != "li":
                self._element(child, canvas, pre, sight, depth + 1)
                continue
            number = _int(child.attrs.get("value"), number) if ordered else number
            mark = f"{_number(node.attrs.get('type', '1'), number)}. " if ordered else "* "
            number += step
            inner = Canvas()
            style_sight = sight
            if child.attrs.get("style"):
                style = child.attrs["style"]
                style_sight = (sight and not _NO_SIGHT.search(style)) or bool(_SIGHT.search(style))
            self._children(child, inner, pre, style_sight, depth + 1)
            inner.flush()
            lines = _trimmed(inner.lines)
            if lines:
                canvas.block(lines, " " * len(mark), mark)

    def _rows(self, node: Node, before: Canvas, sight: bool, depth: int) -> list[tuple[Node, bool]]:
        """The rows in a table or a part of one; captions, and what stands beside rows by mistake, go to ``before``."""
        rows: list[tuple[Node, bool]] = []
        for child in node.children:
            if isinstance(child, str):
                before.words(child) if sight else None
            elif not _shown(child):
                continue
            elif child.name == "tr":
                rows.append((child, sight))
            elif child.name in SECTIONS:
                rows += self._rows(child, before, sight, depth)
            elif child.rows and (child.name != "details" or "open" in child.attrs):
                style = child.attrs.get("style")
                seen = (sight and not _NO_SIGHT.search(style)) or bool(_SIGHT.search(style)) if style else sight
                before.flush()
                rows += self._rows(child, before, seen, depth)
                before.flush()
            else:
                before.flush()
                self._element(child, before, False, sight, depth)
                before.flush()
        return rows

    def _table(self, table: Node, sight: bool, depth: int) -> list[str]:
        before, cells, busy, row = Canvas(), [], [], 0  # busy: (row behind it, columns) of cells that span rows
        rows = self._rows(table, before, sight, depth)
        before.flush()
        for tr, seen in rows:
            column = 0
            busy = [b for b in busy if b[0] > row] if tr.children else busy
            taken, passed = sorted((b[1], b[2]) for b in busy) if tr.children else [], 0
            for cell in tr.children:
                if isinstance(cell, str):
                    if cell.strip() and seen:
                        cells.append((row, column, 1, [" ".join(cell.split())], "left"))
                        column += 1
                    continue
                if not _shown(cell):
                    continue
                while passed < len(taken) and taken[passed][0] <= column:
                    column = max(column, taken[passed][1])
                    passed += 1
                inner = Canvas()
                holder = Node("div", cell.attrs)
                holder.children = cell.children if cell.name in CELLS else [cell]
                self._element(holder, inner, False, seen, depth)
                inner.flush()
                wide = min(max(1, _int(cell.attrs.get("colspan"), 1)), SPAN)
                high = min(max(1, _int(cell.attrs.get("rowspan"), 1)), SPAN)
                align = cell.attrs.get("align", "left").lower()
                cells.append((row, column, wide, _trimmed(inner.lines), align))
                if high > 1:
                    busy.append((row + high, column, column + wide))
                column += wide
            row += 1
        widths: dict[int, int] = {}
        needs = [max((n for n in map(len, c[3]) if n <= WIDEST), default=0) for c in cells]
        for (_, column, wide, _, _), need in zip(cells, needs):
            if wide == 1:
                widths[column] = max(widths.get(column, 0), need)
        for (_, column, wide, _, _), need in zip(cells, needs):
            if wide > 1:  # the last column of a span takes what is missing; a very wide span has enough
                last = column + wide - 1
                widths.setdefault(last, 0)
                if 2 * (wide - 1) < need:
                    has = sum(widths.get(c, 0) for c in range(column, column + wide)) + 2 * (wide - 1)
                    widths[last] += max(0, need - has)
        used = sorted(widths)
        ends = [0, *accumulate(widths[c] + (2 if widths[c] else 0) for c in used)]
        out = _trimmed(before.lines)
        by_row: dict[int, list] = {}
        for r, column, wide, lines, align in cells:
            room = 0
            if align in ("right", "center"):
                first, behind = bisect_left(used, column), bisect_left(used, column + wide)
                room = min(ends[behind] - ends[first] - 2, ALIGNED)
            by_row.setdefault(r, []).append((ends[bisect_left(used, column)], lines, align, room))
        for r in range(row):
            own, k = by_row.get(r, []), 0
            while own := [c for c in own if len(c[1]) > k]:
                parts, length = [], 0
                for begin, lines, align, room in own:
                    if lines[k]:
                        text = lines[k].rjust(room) if align == "right" else lines[k]
                        text = lines[k].center(room) if align == "center" else text
                        gap = 2 if length else 0
                        if length + gap <= begin <= ALIGNED:
                            gap = begin - length
                        parts += (" " * gap, text)
                        length += gap + len(text)
                out.append("".join(parts).rstrip())
                k += 1
        return _trimmed(out)


def _trimmed(lines: list[str]) -> list[str]:
    """Without blank lines at both ends and blanks at the ends of lines."""
    lines = [line.rstrip() for line in lines]
    first = next((i for i, line in enumerate(lines) if line), len(lines))
    last = next((i for i in range(len(lines), 0, -1) if lines[i - 1]), 0)
    return lines[first:last]


def rendered(page: str | None) -> str:
    """The visible text of a page."""
    return "\n".join(Renderer(parsed(page)).lines()) if page else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text: one row per page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [rendered(page) for page in batch.column("html").to_pylist()]
            yield pa.record_batch({"page_id": batch.column("page_id"), "text": pa.array(texts, pa.string())})

    return rows.mapInArrow(run, typed("", page_id=rows.schema["page_id"].dataType).add("text", "string"))
