"""Visible text of web pages, laid out as a reader sees it.

A tree builder reads tags in any state of repair: it closes what HTML closes by itself (p before blocks; li, dt, dd,
option, tr, td, th before their like; head before what cannot be in it), opens tr around loose cells, ignores end tags
that match nothing and closes what is still open. In svg and math it follows
the rules for foreign content: tags may close themselves, and HTML tags that cannot be there end it.

Rendering separates blocks by line breaks and paragraphs, headings, lists and tables by an empty line, marks list items
with '- ' or their number, indents nested lists and quotes, keeps pre as it is, and pads table cells to aligned
columns, also below cells that span rows.
Labels of svg (text, foreignObject) are set apart by spaces, as are cells of formulas; a fraction is written with '/'.
A select shows its option marked as selected, or all of a list box (multiple, or of a size above 1).

What is not shown is dropped: head, title, script, style, template, noscript, datalist; what stands in for the content
of iframe, object, audio, video, canvas, noembed and noframes; hidden inputs, elements with the hidden attribute or with
display:none or visibility:hidden in their style (of svg, in their attributes too); of svg title, desc, metadata, defs
and what else is drawn only by reference, and text outside of labels; of math annotations and phantoms; all but the
first branch of switch, semantics and maction. Also dropped, though browsers show it: the first option of a drop-down
of which none is marked as selected, labels in svg defs or symbol that use draws, texts in attributes (alt, value,
placeholder) and signs that formulas draw (radicals). Style sheets are not read.

A null page has a null text, an empty one an empty text. Rows are rendered one by one: a null page_id or a repeated
page gives its own row. Any length and depth is rendered whole, in time that grows with the page: a tag that never ends
is text, and indentation stops at INDENT columns. An empty table gives none. Extra columns, whatever their names, are not
read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
OPENS = re.compile(r"</?[A-Za-z]")
SPECIAL = re.compile(r"[>\"']")
#: Character references that no character has, with more digits than Python reads at once.
LONG = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
#: Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
#: What stays in an open head; any other start tag, and text that is not white space, closes it.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
SPACE = " \t\n\f\r"
CLOSES_P = BLOCK - frozenset("li dd dt option optgroup legend summary body html".split())
#: HTML start tags that end svg or math, and what these hold without showing it.
LEAVES = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
FONT = re.compile(r"(?:^|\s)(?:color|face|size)\s*(?:=|\s|/|$)", re.I)
UNQUOTED = re.compile(r"=\s*[^\s\"'>]*/$")
FOREIGN_UNSEEN = {
    "svg": frozenset("title desc metadata defs symbol clippath mask marker pattern filter lineargradient radialgradient".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
FIRST_ONLY = frozenset("switch semantics maction".split())
#: Elements of svg and math whose content is HTML.
HOLDS_HTML = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext".split())}
BETWEEN = {"mfrac": "/", "mtr": " ", "mlabeledtr": " ", "mtable": " "}
#: What an opening tag closes by itself, and the elements beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
#: Columns of indentation at most; deeper levels share them.
INDENT = 80
#: Ranges of columns that cells of earlier rows hold of a row at most, and characters of padding of a row for them and
#: within cells that span columns.
HELD, SPANNED = 8, 80


class Node:
    """span and down are the columns and rows of a cell, a down of 0 being all that its row group still has. space is the kind of element: '' (HTML), svg or math; inner is that of its children, svg-text within labels."""

    __slots__ = ("attributes", "branched", "children", "down", "hidden", "inner", "space", "span", "start", "tag")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1, span: int = 1, down: int = 1, attributes: dict[str, str] | None = None):
        self.tag, self.hidden, self.start, self.span, self.down = tag, hidden, start, span, down
        self.attributes, self.space, self.inner = attributes or {}, "", ""
        self.branched = False  # has an element of svg or math
        self.children: list[Node | str] = []


def _number(text: str | None, least: int, most: int, default: int) -> int:
    """An integer within bounds, whatever its digits."""
    m = re.match(r"\s*(-?)0*(\d+)", text or "", re.A)
    if not m:
        return default
    n = int(m[2]) if len(m[2]) < 12 else 10**12
    return min(most, max(least, -n if m[1] else n))


def _reference(m: re.Match) -> str:
    digits = m[0].rstrip(";")[2:].lstrip("xX").lstrip("0")
    return f"&#{m[0][2] if m[0][2] in 'xX' else ''}{digits or 0};" if len(digits) < 8 else "\ufffd"


def unescape(text: str) -> str:
    return entities.unescape(LONG.sub(_reference, text) if "&#" in text else text)


def _rows(text: str | None) -> int:
    n = _number(text, -1, 65_534, 1)
    return n if n >= 0 else 1


def _node(tag: str, attributes: str) -> Node:
    if not attributes.strip(" /"):
        return Node(tag)
    a = {}
    for m in ATTRIBUTE.finditer(attributes):
        a.setdefault(m[1].lower(), unescape(next((v for v in m.groups()[1:] if v is not None), "")))
    hidden = "hidden" in a or bool(HIDING.search(a.get("style", ""))) or tag == "input" and a.get("type", "").lower() == "hidden"
    return Node(tag, hidden, _number(a.get("start"), -(2**31), 2**31 - 1, 1), _number(a.get("colspan"), 1, 1000, 1), _rows(a.get("rowspan")), a)


def _foreign(tag: str, attributes: str, parent: Node) -> Node:
    """An element of svg or math."""
    node = _node(tag, attributes)
    a = node.attributes
    node.space = tag if tag in FOREIGN_UNSEEN else parent.inner.removesuffix("-text")
    is_html = tag in HOLDS_HTML[node.space] or tag == "annotation-xml" and a.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")
    text = node.space == "svg" and tag != "svg" and (tag == "text" or parent.inner == "svg-text")
    node.inner = "" if is_html else "svg-text" if text else node.space
    unseen = tag in FOREIGN_UNSEEN[node.space] or parent.space and parent.tag in FIRST_ONLY and parent.branched
    if node.space == "svg":
        unseen = unseen or a.get("display") == "none" or a.get("visibility") in ("hidden", "collapse")
    node.hidden = node.hidden or bool(unseen)
    return node


class Scanner:
    """Finds the tag at a place of the page. Tags that never end are found out in time that grows with the page."""

    def __init__(self, page: str):
        self.page = page
        self.special: list[int] | None = None
        self.dead: set[int] = set()

    def tag(self, at: int) -> re.Match | None:
        if self.special is not None and not self._ends(at):
            return None
        m = TAG.match(self.page, at)
        if m is None and self.special is None and OPENS.match(self.page, at):
            self.special = [s.start() for s in SPECIAL.finditer(self.page)]
            self._ends(at)
        return m

    def _ends(self, at: int) -> bool:
        """Whether a > outside quotes follows. From the same quote on, every search goes the same way, so the quotes of
        those that came to nothing are remembered."""
        seen = []
        while (i := bisect_left(self.special, at)) < len(self.special):
            s = self.special[i]
            if self.page[s] == ">":
                return True
            if s in self.dead:
                break
            seen.append(s)
            end = self.page.find(self.page[s], s + 1)
            if end < 0:
                break
            at = end + 1
        self.dead.update(seen)
        return False


class Stack:
    """The open elements, with the places of each kind, so that the nearest of some is found without a walk."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}
        self.holds: list[int] = []  # elements of svg and math whose content is HTML

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.space and not node.inner:
            self.holds.append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        node = self.nodes.pop()
        self.at[node.tag].pop()
        if self.holds and self.holds[-1] == len(self.nodes):
            self.holds.pop()

    def last(self, tags: set[str]) -> int:
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=0)

    def close(self, until: set[str], fence: set[str], below: int | None = None) -> None:
        """Closes the nearest of until unless one of fence is nearer or the same. HTML in svg or math closes nothing
        outside; an end tag at that point, in place below, does."""
        i = self.last(until)
        holds = [p for p in self.holds[-2:] if below is None or p < below]
        if i > max(self.last(fence), holds[-1] if holds else 0):
            while len(self.nodes) > i:
                self.pop()


def parse(page: str) -> Node:
    """The element tree; text nodes have their entities resolved."""
    root = Node("html")
    stack, scanner = Stack(root), Scanner(page)
    at, n = 0, len(page)
    no_end = False  # no > follows

    def put(text: str) -> None:
        if not text:
            return
        text = unescape(text)
        if stack.top.tag == "head" and text.strip(SPACE):
            stack.pop()
        if stack.top.inner != "svg":
            stack.top.children.append(text)

    look = 0
    while True:
        lt = page.find("<", look)
        if lt < 0:
            put(page[at:])
            return root
        mark = page[lt + 1 : lt + 2]
        if mark in ("!", "?") and mark:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end = end + 3 if end >= 0 else n
            else:
                end = -1 if no_end else page.find(">", lt + 2)
                no_end = end < 0
                if no_end:
                    look = lt + 2
                    continue
                end += 1
            put(page[at:lt])
            if stack.top.space and page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                end = end if end >= 0 else n
                if stack.top.inner != "svg":
                    stack.top.children.append(page[lt + 9 : end])
                end = min(n, end + 3)
            at = look = end
            continue
        m = scanner.tag(lt)
        if m is None:
            look = lt + 1
            continue
        put(page[at:lt])
        at = look = m.end()
        tag = m[2].lower()
        if stack.top.inner and (tag in ("p", "br") if m[1] else tag in LEAVES or tag == "font" and FONT.search(m[3])):
            while stack.top.inner:
                stack.pop()
        if m[1]:
            if tag == "br":
                stack.top.children.append(Node("br"))
            elif tag == "p" and not stack.at.get("p"):
                stack.top.children.append(Node("p"))
            else:
                fence = {"td", "th"} if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html") else {"table"} - {tag}
                stack.close({tag}, fence, len(stack.nodes) - 1)
            continue
        if tag in ("html", "body") and len(stack.nodes) == 1:
            continue
        if stack.top.tag == "head" and tag not in IN_HEAD:
            stack.pop()
        if stack.top.inner or tag in FOREIGN_UNSEEN:
            node = _foreign(tag, m[3], stack.top)
            own_line = tag == "math" and not stack.top.inner and node.attributes.get("display", "").lower() == "block"
            stack.top.children.append(_line(node) if own_line else node)
            stack.top.branched = True
            if not m[3].endswith("/") or UNQUOTED.search(m[3]):
                stack.push(node)
            continue
        if tag in CLOSES_P:
            stack.close({"p"}, {"td", "th", "table", "button", "object", "caption"})
        if tag in CLOSES:
            until, fence = CLOSES[tag]
            for _ in until:
                stack.close(until, fence)
        if tag in ("td", "th") and stack.top.tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            stack.top.children.append(row)
            stack.push(row)
        if tag == "body":
            stack.close({"head"}, set())
        node = _node(tag, m[3])
        stack.top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            raw = page[at : end.start() if end else n]
            node.children.append(unescape(raw) if tag in ("textarea", "title") else raw)
            at = look = end.end() if end else n
        elif tag not in VOID:
            stack.push(node)


def _line(node: Node) -> Node:
    out = Node("div")
    out.children.append(node)
    return out


def _inside(node: Node) -> list[Node | str]:
    """The children that an element shows, with what sets them apart."""
    if node.tag == "select":
        return _options(node)
    if not node.space:
        return node.children
    if node.tag in ("text", "foreignobject") or node.tag == "tspan" and node.attributes.keys() & {"x", "y"}:
        return [" ", *node.children, " "]
    if node.tag not in BETWEEN:
        return node.children
    between = " " if re.match(r"\s*0", node.attributes.get("linethickness", "")) else BETWEEN[node.tag]
    out: list[Node | str] = []
    for child in node.children:
        if isinstance(child, Node) or child.strip():
            out += [between, child] if out else [child]
    return out


def _options(select: Node) -> list[Node | str]:
    a = select.attributes
    box = "multiple" in a or _number(a.get("size"), 0, 999_999, 0) > 1
    out: list[Node | str] = []
    todo = list(reversed(select.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str) or box and node.hidden or node.tag in UNSEEN:
            continue
        label = node.attributes.get("label")
        if node.tag == "option":
            shown = [label] if label else node.children
            if box:
                option = Node("option")
                option.children = shown
                out.append(option)
            elif "selected" in node.attributes:
                out = [" ", *shown, " "]
            continue
        if node.tag == "optgroup" and label and box:
            group = Node("optgroup")
            group.children = [label]
            out.append(group)
        todo += reversed(node.children)
    return out


class Layout:
    """Lines of text with the spacing of blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.indent = 0
        self.marker: str | None = None
        self.wants_gap = False

    def text(self, s: str) -> None:
        self.inline.append(s)

    def raw(self, lines: list[str]) -> None:
        self.flush()
        for line in lines:
            self._put(line)

    def _put(self, line: str) -> None:
        if self.wants_gap and self.lines:
            self.lines.append("")
        self.wants_gap = False
        if self.marker is not None:
            head, self.marker = self.marker, None
            line = " " * min(INDENT, self.indent - len(head)) + head + line
        else:
            line = " " * min(INDENT, self.indent) + line
        self.lines.append(line.rstrip())

    def flush(self) -> None:
        line = " ".join("".join(self.inline).split())
        self.inline.clear()
        if line:
            self._put(line)

    def gap(self) -> None:
        self.flush()
        if self.marker is None:
            self.wants_gap = True


def render(root: Node, tables: dict[int, list[str]]) -> list[str]:
    """The lines that an element shows, given those of the tables in it. The walk keeps its own stack, so that depth
    costs no recursion."""
    out = Layout()
    lists: list[list] = []  # kind and next number
    todo: list[tuple[str, object]] = [("open", c) for c in reversed(root.children)]
    while todo:
        what, node = todo.pop()
        if what == "close":
            tag, indent, was_list = node
            out.flush()
            if was_list:
                lists.pop()
            if tag in SPACED and not (was_list and lists):
                out.gap()
            if out.marker is not None and tag == "li":
                out.marker = None
            out.indent = indent
            continue
        if isinstance(node, str):
            out.text(node)
            continue
        tag = node.tag
        if node.hidden or tag in UNSEEN:
            continue
        if tag == "br":
            out.flush() if "".join(out.inline).strip() else out.gap()
            continue
        if tag == "table":
            out.gap()
            out.raw(tables.pop(id(node), []))
            out.gap()
            continue
        if tag in ("td", "th", "tr", "caption"):  # outside a table that is laid out
            out.flush() if tag in ("tr", "caption") else out.text(" ")
        if tag == "pre":
            out.gap()
            out.raw(_plain(node).expandtabs(8).strip("\n").split("\n"))
            out.gap()
            continue
        if tag not in BLOCK:
            todo += [("open", c) for c in reversed(_inside(node))]
            continue
        nested = tag in ("ul", "ol", "menu", "dir") and bool(lists)
        out.flush() if tag not in SPACED or nested else out.gap()
        indent = out.indent
        is_list = tag in ("ul", "ol", "menu", "dir")
        if is_list:
            lists.append([tag, node.start])
        elif tag == "li":
            head = "- "
            if lists and lists[-1][0] == "ol":
                head, lists[-1][1] = f"{lists[-1][1]}. ", lists[-1][1] + 1
            out.marker = head
            out.indent = indent + len(head)
        elif tag in ("blockquote", "dd"):
            out.indent = indent + 2
        todo.append(("close", (tag, indent, is_list)))
        todo += [("open", c) for c in reversed(node.children)]
    out.flush()
    return out.lines


def _plain(root: Node) -> str:
    parts, todo = [], list(reversed(root.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            parts.append(node)
        elif not node.hidden and node.tag not in UNSEEN:
            parts.append("\n" * (node.tag == "br"))
            todo += reversed(_inside(node))
    return "".join(parts)


Held = tuple[int, int, int, bool]  # column, columns, rows left (0 without end), whether each of the columns is a cell's own


def _placed(cells: list[tuple[str, int, int]], held: list[Held]) -> tuple[list, list[Held]]:
    """The cells (text, span, down) of a row as (column, text, span), with empty ones where cells from above hold columns, up
    to the last cell; and what is held of the next row. Neighbours that are held alike are one range, of text None."""
    row, at, last = [], 0, 0
    ahead = deque(held)
    below = [(lo, span, left and left - 1, ones) for lo, span, left, ones in held if left != 1]
    for text, span, down in cells:
        while ahead and ahead[0][0] <= at:
            lo, wide, _, ones = ahead.popleft()
            if lo + wide > at:
                row.append((at, None if ones else "", lo + wide - at))
                at = lo + wide
        row.append((at, text, span))
        last = len(row)
        if down != 1:
            below.append((at, span, down and down - 1, span == 1))
        at += span
    joined: list[Held] = []
    below.sort()
    for lo, span, left, ones in below:
        if ones and joined and joined[-1][3] and joined[-1][2] == left and joined[-1][0] + joined[-1][1] == lo:
            joined[-1] = (joined[-1][0], joined[-1][1] + span, left, True)
        else:
            joined.append((lo, span, left, ones))
    return row[:last], joined[:HELD]


def _padded(row: list[tuple[int, str | None, int]], used: list[int], before: list[int]) -> str:
    """A row's cells, padded to their columns; before has the width of all used columns before each."""
    parts, left = [], SPANNED
    for at, text, span in row:
        lo, hi = bisect_left(used, at), bisect_left(used, at + span)
        room = before[hi] - before[lo] - 3
        if text is None:
            parts.append("")
            for i in range(lo, hi):
                wide = before[i + 1] - before[i] - 3
                if wide > left:
                    break
                left -= wide + 3
                if i > lo:
                    parts.append("")
                parts[-1] = " " * wide
        elif span > 1:
            pad = min(max(0, room - len(text)), left)
            left -= pad
            parts.append(text + " " * pad)
        else:
            parts.append(text.ljust(room))
    return " | ".join(parts)


def table(root: Node, tables: dict[int, list[str]]) -> list[str]:
    """Rows with cells padded to the width of their column; a cell's lines are joined by a space. Cells that span
    columns, and captions, do not widen a column. Below a cell that spans rows its columns stay empty: up to HELD ranges of
    them, from the left. Padding within spans, and below such cells, ends at SPANNED characters a row, so that a page's text
    grows with the page."""
    captions, rows = [], []
    group, held = root, []  # the row group, and what its cells hold of the next row
    todo = [(c, root) for c in reversed(root.children)]
    while todo:
        node, parent = todo.pop()
        if isinstance(node, str):
            if node.strip():
                captions.append(" ".join(node.split()))
        elif node.hidden or node.tag in UNSEEN:
            continue
        elif node.tag == "tr":
            cells = [c for c in node.children if not isinstance(c, str) and c.tag in ("td", "th") and not c.hidden]
            loose = Node("td")
            loose.children = [c for c in node.children if isinstance(c, str) or c.tag not in ("td", "th")]
            extra = " ".join(" ".join(render(loose, tables)).split()) if loose.children else ""
            captions += [extra] * bool(extra)
            held = held if parent is group else []
            group = parent
            row, held = _placed([(" ".join(x for x in render(c, tables) if x), c.span, c.down) for c in cells], held)
            rows.append(row)
        elif node.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo += [(c, node) for c in reversed(node.children)]
        else:
            wrap = Node("div")
            wrap.children = [node]
            captions += [x for x in render(wrap, tables) if x]
    widths: dict[int, int] = {}
    for row in rows:
        for at, text, span in row:
            if text is not None:
                widths[at] = max(widths.get(at, 0), len(text) if span == 1 else 0)
    used = sorted(widths)  # columns in which a cell begins
    before = [0, *accumulate(widths[i] + 3 for i in used)]
    lines = list(captions)
    for row in rows:
        line = _padded(row, used, before)
        if any(text for _, text, _ in row):
            lines.append(line.rstrip())
    return lines


def layout(root: Node) -> list[str]:
    """The lines of a page; its tables are laid out from the innermost on."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node.hidden or node.tag in UNSEEN:
            continue
        if node.tag == "table":
            found.append(node)
        todo += reversed(_inside(node))
    tables: dict[int, list[str]] = {}
    for node in reversed(found):
        tables[id(node)] = table(node, tables)
    return render(root, tables)


def visible_text(page: str | None) -> str | None:
    if page is None:
        return None
    lines = layout(parse(page.replace("\r\n", "\n").replace("\0", "�")))
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([visible_text(p) for p in batch], dtype=object)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), run(F.col("html").cast("string")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
