"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied tags (a ``p`` ends where a block begins, list items, table rows and cells and options end one
another, head content moves the builder into the head) give a tree; unclosed inline formatting elements are reopened
in the next block, as browsers do. The renderer walks it with visibility rules (no head matter, scripts, styles, templates, comments, hidden
or ``display: none`` elements, what stands in for objects, media and frames; closed details show their summary, closed lists the chosen option or the first)
and emits all visible text, that of form fields, formulas and drawings too: blocks on lines of their own,
paragraphs, headings, lists and tables set off by a blank line, list items with bullets or numbers and indented by depth, table cells aligned in
columns, ``pre`` unchanged, runs of white space elsewhere as one blank.

Defined results: a null or empty page has an empty text; a page cut anywhere, also within a tag or an entity, renders what is complete
(an incomplete tag at the end is dropped, also one cut within a quoted value, an incomplete entity is text); of equal formatting elements three are
reopened at most, as in browsers; a column of a table is padded up to ``WIDEST`` characters;
repeated pages and null ids have rows like others; an empty table gives an empty one. Nothing is recursive, so depth is unbounded. Ids are numbers or
text that reads as such; another id is an error (ANSI cast).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import map_text, row_key

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title template".split())
UNSEEN = frozenset("head script style template noembed noframes noscript iframe title datalist object audio video canvas map meter progress desc metadata defs annotation annotation-xml".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p plaintext pre section summary table ul tr caption thead tbody tfoot td th".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
ENDS_P = BLOCK - frozenset("body html tr td th thead tbody tfoot caption".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: A start tag of the key ends open elements of the values, up to the nearest of its scope.
IMPLIED_ENDS = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "option": ("option", ("select", "datalist")),
    "optgroup": ("option optgroup", ("select",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "thead": ("tr td th thead tbody tfoot caption colgroup", ("table",)),
    "tbody": ("tr td th thead tbody tfoot caption colgroup", ("table",)),
    "tfoot": ("tr td th thead tbody tfoot caption colgroup", ("table",)),
}
IMPLIED_ENDS = {k: (tuple(ended.split()), scope) for k, (ended, scope) in IMPLIED_ENDS.items()}
SCOPE = frozenset("table td th caption html button object".split())
WIDEST = 60
#: Fixed value of HTML: so many equal formatting elements are reopened at most.
EQUAL = 3

_TOKEN = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<odd>[!?][^>]*)(?:>|\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?P<end>>|\Z))", re.S)
_CUT = re.compile(r"</?[a-zA-Z][^>]*\Z")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("open", name, attributes) and ("close", name, {}) in order."""
    at, n = 0, len(page)
    while at < n:
        less = page.find("<", at)
        if less < 0:
            yield "text", page[at:], {}
            return
        m = _TOKEN.match(page, less)
        if m is None and _CUT.match(page, less):  # a tag that the page's end cuts within a quoted value
            if less > at:
                yield "text", page[at:less], {}
            return
        if m is None:  # a lone "<" is text
            stop = page.find("<", less + 1)
            stop = n if stop < 0 else stop
            yield "text", page[at:stop], {}
            at = stop
            continue
        if less > at:
            yield "text", page[at:less], {}
        at = m.end()
        name = m["name"]
        if name is None or not m["end"]:
            continue
        name = name.lower()
        if m["close"]:
            yield "close", name, {}
            continue
        yield "open", name, attributes(m["attrs"]) if m["attrs"] else {}
        if name in RAW and name != "template":
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                yield "raw", page[at:stop], {}
            at = stop


class Builder:
    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # of the open elements' names, so that what isn't open isn't searched for
        self.body: Node | None = None
        self.selects: list[Node] = []
        self.lost: list[Node] = []  # formatting elements cut short by a block's end, reopened before the next text

    def _in_body(self) -> None:
        if self.body is None:
            self.body = Node("body")
            self.root.children.append(self.body)
            self.open = [self.root, self.body]

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        if node.name == "select":
            self.selects.append(node)
        if node.name not in VOID:
            self.open.append(node)
            self.count[node.name] += 1

    def _end(self, at: int) -> None:
        """Ends the open elements from position ``at``; formatting among them (not the first itself) is reopened later."""
        self.lost += [x for x in self.open[at + 1 :] if x.name in FORMATTING]
        for x in self.open[at:]:
            self.count[x.name] -= 1
        del self.open[at:]

    def _within(self, names, scope) -> int | None:
        if not any(self.count[x] for x in names):
            return None
        for k in range(len(self.open) - 1, 1, -1):
            if self.open[k].name in names:
                return k
            if self.open[k].name in scope:
                return None
        return None

    def _reopen(self) -> None:
        lost, self.lost = self.lost, []
        seen: Counter = Counter()
        again = []
        for node in reversed(lost):
            kind = (node.name, frozenset(node.attrs.items()))
            seen[kind] += 1
            if seen[kind] <= EQUAL:
                again.append(node)
        for node in reversed(again):
            self._push(Node(node.name, node.attrs))

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name == "html":
            self.root.attrs |= {k: v for k, v in attrs.items() if k not in self.root.attrs}
            return
        if name == "head":
            return
        if name == "body":
            self._in_body()
            self.body.attrs |= {k: v for k, v in attrs.items() if k not in self.body.attrs}
            return
        if self.body is None:
            if name in HEAD_ONLY:
                node = Node(name, attrs)
                self.root.children.append(node)
                if name not in VOID:
                    self.open.append(node)
                    self.count[name] += 1
                return
            self._in_body()
        if name in ENDS_P:
            k = self._within(("p",), SCOPE)
            if k is not None:
                self._end(k)
        if name in IMPLIED_ENDS:
            ended, scope = IMPLIED_ENDS[name]
            outermost = None
            for k in range(len(self.open) - 1, 1, -1) if any(self.count[x] for x in ended) else ():
                if self.open[k].name in scope:
                    break
                if self.open[k].name in ended:
                    outermost = k
            if outermost is not None:
                self._end(outermost)
                if name in ("tr", "td", "th", "thead", "tbody", "tfoot"):
                    self.lost = []
        if name == "a":
            k = self._within(("a",), SCOPE)
            if k is not None:
                self._close_formatting(k)
            self.lost = [x for x in self.lost if x.name != "a"]
        if name in ("td", "th") and self.count["table"] and not any(x.name == "tr" for x in self.open[self._table() :]):
            self._push(Node("tr"))
        if name not in BLOCK and name not in VOID:
            self._reopen()
        self._push(Node(name, attrs))

    def _table(self) -> int:
        return next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].name == "table"), 0)

    def _close_formatting(self, k: int) -> None:
        inner = self.open[k + 1 :]
        if any(x.name in BLOCK for x in inner):  # stays open around the block; what follows the block is outside
            self.count[self.open[k].name] -= 1
            del self.open[k]
            return
        for x in self.open[k:]:
            self.count[x.name] -= 1
        del self.open[k:]
        for x in inner:
            if x.name in FORMATTING:
                self._push(Node(x.name, x.attrs))

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name == "head":
            if self.body is None:
                self._end(1)
            return
        if name == "br":
            self.start("br", {})
            return
        if name in FORMATTING:
            k = self._within((name,), SCOPE)
            if k is None:
                for i in range(len(self.lost) - 1, -1, -1):
                    if self.lost[i].name == name:
                        del self.lost[i]
                        break
            else:
                self._close_formatting(k)
            return
        headings = ("h1", "h2", "h3", "h4", "h5", "h6")
        names = headings if name in headings else (name,)
        scope = () if name in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption") else SCOPE
        least = 0 if self.body is None else 1
        for k in range(len(self.open) - 1, least, -1) if any(self.count[x] for x in names) else ():
            if self.open[k].name in names:
                self._end(k)
                if name in SCOPE:
                    self.lost = []
                return
            if self.open[k].name in scope:
                break
        if name == "p":
            self._in_body()
            self.open[-1].children.append(Node("p"))

    def text(self, data: str, raw: bool) -> None:
        if not raw and self.body is None and self.open[-1].name not in HEAD_ONLY:
            if not data.strip(" \t\n\r\f"):
                return
            self._in_body()
        if not raw and self.lost and data.strip(" \t\n\r\f"):
            self._reopen()
        self.open[-1].children.append(html.unescape(data) if "&" in data and (not raw or self.open[-1].name in ("title", "textarea")) else data)


def tree(page: str) -> Node:
    builder = Builder()
    for kind, value, attrs in tokens(page):
        if kind == "open":
            builder.start(value, attrs)
        elif kind == "close":
            builder.end(value)
        else:
            builder.text(value, kind == "raw")
    for select in builder.selects:
        _choose(select)
    return builder.root


def _choose(select: Node) -> None:
    """Hides the options that a browser doesn't show: of a closed list all but the chosen or the first."""
    options, stack = [], list(reversed(select.children))
    while stack:
        node = stack.pop()
        if isinstance(node, Node):
            if node.name == "option":
                node.children.append(" ")
                options.append(node)
            else:
                stack.extend(reversed(node.children))
    if "multiple" in select.attrs or select.attrs.get("size", "1") not in ("", "0", "1"):
        return
    chosen = [x for x in options if "selected" in x.attrs][-1:] or options[:1]
    for x in options:
        if x not in chosen:
            x.attrs["hidden"] = ""


def visible(node: Node) -> bool:
    if node.name in UNSEEN or "hidden" in node.attrs or node.name == "dialog" and "open" not in node.attrs:
        return False
    if node.name == "input":
        return False
    style = node.attrs.get("style")
    return not (style and _HIDDEN_STYLE.search(style))


class Lines:
    """Collects inline text into lines; breaks and blank lines are owed until text follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = self.space = False
        #: (what the next line starts with, what later ones do), from the outside in
        self.indent: list[tuple[str, str]] = []

    def write(self, text: str, kept: bool) -> None:
        if kept:
            first, *rest = text.split("\n")
            self._add(first)
            for line in rest:
                self.feed(True)
                self._add(line)
            return
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            self.space, words = True, words[1:]
        trailing = words.endswith(" ")
        words = words[:-1] if trailing else words
        if words:
            self._add((" " if self.space and self.now else "") + words)
            self.space = False
        self.space = self.space or trailing

    def _add(self, text: str) -> None:
        if not text:
            return
        if not self.now:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.now.append("".join(first for first, _ in self.indent))
            self.indent[:] = [(later, later) for _, later in self.indent]
        self.now.append(text)

    def feed(self, always: bool = False) -> None:
        """Ends the line; ``always``: also an empty one, which is one blank line."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        elif always and self.lines and self.lines[-1]:
            self.lines.append("")
        self.space = False

    def gap(self) -> None:
        self.feed()
        self.blank = not self.lines or self.lines[-1] != ""

    def done(self) -> str:
        self.feed()
        return "\n".join(self.lines).strip("\n")


def _cell_rows(table: Node) -> list[list[Node]]:
    rows: list[list[Node]] = []
    stack = [c for c in reversed(table.children) if isinstance(c, Node)]
    while stack:
        node = stack.pop()
        if not visible(node):
            continue
        if node.name == "tr":
            rows.append([c for c in node.children if isinstance(c, Node) and c.name in ("td", "th") and visible(c)])
        elif node.name in ("thead", "tbody", "tfoot"):
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return rows


def _strays(table: Node) -> list:
    """What stands in a table outside its cells: browsers show it before the table, as they do captions."""
    out: list = []
    stack = list(reversed(table.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x.strip(" \t\n\r\f"):
                out.append(x)
        elif x.name in ("thead", "tbody", "tfoot", "tr"):
            if visible(x):
                stack.extend(reversed(x.children))
        elif x.name not in ("td", "th", "colgroup", "col"):
            out.append(x)
    return out


def _laid_out(rows: list[list[str]]) -> list[str]:
    widths: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            if k == len(widths):
                widths.append(0)
            if k < len(row) - 1:
                widths[k] = max(widths[k], min(len(cell), WIDEST))
    return ["  ".join(cell.ljust(widths[k]) if k < len(row) - 1 else cell for k, cell in enumerate(row)).rstrip(" ") for row in rows]


def render(root: Node) -> str:
    """All visible text of a tree, by a stack of what is still to be done: walks, texts, calls at ends, cells and tables to lay out."""
    top = Lines()
    stack: list[tuple] = [("walk", top, root, False)]
    counters: list[list] = []
    while stack:
        frame = stack.pop()
        kind = frame[0]
        if kind == "text":
            frame[1].write(frame[2], frame[3])
        elif kind == "call":
            frame[1]()
        elif kind == "cell":  # the cell's lines are complete
            frame[2].append(" ".join(frame[1].done().split("\n")).strip())
        elif kind == "table":
            out, rows = frame[1], frame[2]
            out.gap()
            for line in _laid_out([r for r in rows if any(r)]):
                out._add(line)
                out.feed()
            out.gap()
        else:
            _, out, node, kept = frame
            if not visible(node):
                continue
            name = node.name
            if name == "br":
                out.feed(True)
                continue
            if name == "hr":
                out.gap()
                continue
            if name == "img":
                if node.attrs.get("alt"):
                    out.write(node.attrs["alt"], False)
                continue
            if name == "table":
                rows: list[list[str]] = []
                after: list[tuple] = [("table", out, rows)]
                for cells in _cell_rows(node):
                    row: list[str] = []
                    rows.append(row)
                    for cell in cells:
                        inside = Lines()
                        after += [("cell", inside, row), ("children", inside, cell, kept)]
                stack.append(after[0])
                pairs = [after[i : i + 2] for i in range(1, len(after), 2)]
                for done, inner in reversed(pairs):
                    stack += [done, inner]
                stack.append(("call", out.gap))
                for x in reversed(_strays(node)):
                    stack.append(("text", out, x, kept) if isinstance(x, str) else ("walk", out, x, kept))
                stack.append(("call", out.gap))
                continue
            if kind == "walk" and name in BLOCK:
                spaced = name in SPACED and not (name in ("ul", "ol") and counters)
                edge = out.gap if spaced else out.feed
                stack.append(("call", edge))
                edge()
                if name in ("ul", "ol", "menu", "dir"):
                    start = node.attrs.get("start", "1")
                    counters.append([name, int(start) if start.lstrip("-").isdigit() and len(start) < 9 else 1])
                    stack.append(("call", counters.pop))
                elif name == "li":
                    mark = "- "
                    if counters and counters[-1][0] == "ol":
                        mark = f"{counters[-1][1]}. "
                        counters[-1][1] += 1
                    stack += [("call", out.indent.pop), ("call", out.feed)]
                    out.indent.append((mark, " " * len(mark)))
                elif name in ("dd", "blockquote"):
                    stack += [("call", out.indent.pop), ("call", out.feed)]
                    out.indent.append(("  ", "  "))
                if name == "details" and "open" not in node.attrs:
                    shown = [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]
                    stack.extend(("walk", out, c, kept) for c in shown)
                    continue
            kept = kept or name in ("pre", "listing", "xmp", "plaintext")
            for child in reversed(node.children):
                stack.append(("text", out, child, kept) if isinstance(child, str) else ("walk", out, child, kept))
    return top.done()


def text_of(page: str | None) -> str:
    return render(tree(page)) if page else ""


def title_of(root: Node) -> str:
    for child in root.children:
        if isinstance(child, Node) and child.name == "title":
            return _SPACE.sub(" ", "".join(c for c in child.children if isinstance(c, str))).strip()
    return ""


def extract(pages: DataFrame, page_id: str = "page_id", markup: str = "html") -> DataFrame:
    """One row for each row of ``pages``: id, row_key, title, text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        titles, texts = [], []
        for page in batch.column(2).to_pylist():
            root = tree(page) if page else Node("html")
            titles.append(title_of(root))
            texts.append(render(root))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(titles, pa.string()), pa.array(texts, pa.string())], ["id", "row_key", "title", "text"])

    rows = pages.select(F.col(page_id).cast("long").alias("id"), row_key(page_id, markup).alias("row_key"), F.col(markup).cast("string").alias("html"))
    return map_text(rows, "html", run, "id long, row_key long, title string, text string")
