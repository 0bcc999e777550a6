"""Layout-aware HTML rendering.

A tree builder with implied tags gives balanced open and close events; a renderer walks them with a stack of its own, so nesting
has no depth limit. It writes all visible text: blocks on lines of their own with the space their margins have, list markers and
indents, preformatted text as it stands, and table cells aligned in columns.

Time and memory are in proportion to the page: open tags are found by their last places, not by walking the stack, and layout that
could outgrow the text is bounded, never the text itself. Columns are aligned up to ALIGN characters (a longer cell pushes on what
follows it), the first COLUMNS of a row and TABLES tables within each other; a table that would be mostly padding is not aligned;
indents stop at INDENTS levels.

Visible is what a browser without scripts shows: `display: none`, `hidden`, closed dialogs and elements without text of their own
are left out with all below them; `visibility: hidden` is inherited, and a child can be visible again. Both come out of the cascade
over style attributes and all of a page's own style sheets, those that stand after an element too (see Styles).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quote opens a value only after `=`; a tag that never ends takes the rest of the page.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_DECLARED = re.compile(r"(?<![^;])\s*(display|visibility)\s*:([^;!]*)(!\s*important\s*)?(?=;|\Z)", re.IGNORECASE)
_CSS = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|[{};]", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
#: A tag, a class or id, an attribute's condition, or a pseudo-class of a selector.
_SIMPLE = re.compile(r"([a-z][\w-]*|\*)|([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*(?:[is]\s*)?)?\]|(::?[\w-]+)(?:\([^()]*\))?", re.IGNORECASE)
_COMBINES = re.compile(r"\s*[>+~]\s*|\s+")
_STYLE, _STYLE_END = re.compile(r"<style", re.IGNORECASE), re.compile(r"</style[^>]*>?", re.IGNORECASE)

ALIGN, COLUMNS, TABLES, INDENTS = 60, 256, 32, 32
#: Selectors that an element is held against by one of its keys, besides the bare key; pixels of the screen's width.
NODES, VIEWPORT = 128, 1280

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NO_TEXT = frozenset("script style head title template iframe noembed noframes audio video canvas datalist desc metadata defs annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table textarea ul xmp".split())
MARGINS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An opening tag closes these, if open within the nearest of the bounds.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ("html",)),
}
SCOPE = ("table", "td", "th", "caption", "button", "object", "html")
TABLE_PARTS = frozenset("table tr td th thead tbody tfoot".split())
#: Inputs whose value is shown.
SHOWN_INPUTS = frozenset("text search email url tel number submit button reset".split())
#: Keywords of the CSS standards.
DISPLAYS = frozenset("none contents block inline inline-block flow flow-root run-in list-item flex inline-flex grid inline-grid table inline-table table-row-group table-header-group table-footer-group table-row table-cell table-column-group table-column table-caption ruby ruby-base ruby-text ruby-base-container ruby-text-container math".split())
VISIBILITIES = frozenset("visible hidden collapse".split())
GLOBAL_VALUES = frozenset("initial inherit unset revert revert-layer".split())
HIDING = frozenset("none hidden collapse".split())
#: Pseudo-classes of a state that a page isn't in when it is read.
NEVER = frozenset(":hover :focus :focus-visible :focus-within :active :target :visited :before :after :first-line :first-letter".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in _ATTRIBUTE.finditer(text)} if text.strip("/ \n\t") else {}


class Open:
    """The stack of open tags; the places of each tag are kept, so that a look for one doesn't walk the stack."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)

    def pop(self) -> str:
        tag = self.tags.pop()
        self.places[tag].pop()
        return tag

    def last(self, tags: tuple[str, ...] | frozenset[str]) -> int:
        """The place of the innermost open one of the tags, or -1."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def outermost(self, tags: tuple[str, ...], bounds: tuple[str, ...]) -> int | None:
        """The outermost open one of the tags within the nearest bound."""
        bound, found = self.last(bounds), None
        for t in tags:
            at = self.places.get(t, ())
            i = bisect_right(at, bound)
            if i < len(at) and (found is None or at[i] < found):
                found = at[i]
        return found


def events(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("open" | "close" | "text", tag or text, attributes), balanced, with the tags that the source leaves out."""
    open_ = Open()
    at = 0

    def close_to(depth: int) -> Iterator[tuple[str, str, dict[str, str]]]:
        while len(open_.tags) > depth:
            yield "close", open_.pop(), {}

    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            yield "text", unescape(html[at:]), {}
            break
        if m.start() > at:
            text = html[at : m.start()]
            yield "text", unescape(text) if "&" in text else text, {}
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>"), {}
            continue
        if m[1]:
            if tag in VOID:
                if tag == "br":
                    yield "open", "br", {}
                    yield "close", "br", {}
                continue
            depth = open_.last((tag,))
            if depth >= 0 and (tag in TABLE_PARTS or depth > open_.last(("td", "th", "table"))):
                yield from close_to(depth)
            elif tag == "p":
                yield "open", "p", {}
                yield "close", "p", {}
            continue
        if tag in CLOSES_P and (depth := open_.outermost(("p",), SCOPE)) is not None:
            yield from close_to(depth)
        if tag in IMPLIED and (depth := open_.outermost(*IMPLIED[tag])) is not None:
            yield from close_to(depth)
        if tag in ("td", "th") and (table := open_.last(("table",))) >= 0 and open_.last(("tr",)) < table:
            open_.push("tr")
            yield "open", "tr", {}
        attributes = _attributes(m[3] or "")
        yield "open", tag, attributes
        if tag in VOID:
            yield "close", tag, {}
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
            stop = end.start() if end else len(html)
            if stop > at:
                yield "text", unescape(html[at:stop]) if tag in ("textarea", "title") else html[at:stop], {}
            yield "close", tag, {}
            at = len(html) if end is None else (html.find(">", stop) + 1 or len(html))
        else:
            open_.push(tag)
    yield from close_to(0)


_NONE: set[str] = set()


class Node:
    """A compound selector with what stands left of it in its selectors; `open` counts the open elements that match it."""

    __slots__ = ("classes", "others", "id", "tag", "attributes", "child", "up", "weight", "values", "open", "leads")

    def __init__(self, parts: tuple, child: bool, up: Node | None, weight: tuple[int, int, int]) -> None:
        self.tag, self.id, self.classes, self.attributes = parts
        self.child, self.up, self.weight = child, up, weight
        self.values: dict[tuple[str, bool], tuple[bool, int, str]] = {}  # (property, sure) -> (important, order, value)
        self.open = 0
        self.leads = False  # another compound follows it in some selector

    def matches(self, tag: str, attributes: dict[str, str], names: set[str], parent: list[Node]) -> bool:
        if self.up is not None and not (self.up in parent if self.child else self.up.open):
            return False
        if (self.tag and self.tag != tag) or (self.id and self.id != attributes.get("id")) or not all(c in names for c in self.classes):
            return False
        return all(_attribute_fits(attributes.get(n), how, v) for n, how, v in self.attributes)


def _attribute_fits(value: str | None, how: str, wanted: str) -> bool:
    if value is None:
        return False
    if how == "~=":
        return wanted in value.split()
    if how == "|=":
        return value == wanted or value.startswith(wanted + "-")
    if how in ("^=", "$=", "*="):
        return bool(wanted) and (value.startswith(wanted) if how[0] == "^" else value.endswith(wanted) if how[0] == "$" else wanted in value)
    return how == "" or value == wanted


def _declared(body: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of display and visibility; invalid values are no declarations."""
    out = []
    for m in _DECLARED.finditer(body):
        name, value, important = m[1].lower(), " ".join(m[2].lower().split()), bool(m[3])
        if "(" in value or value.startswith("-"):
            value = "?"  # it can't be worked out, so the text is shown
        elif value not in GLOBAL_VALUES and not set(value.split()) <= (DISPLAYS if name == "display" else VISIBILITIES):
            continue
        out.append((name, value, important))
    return out


def _media(query: str) -> bool | None:
    """Whether a list of media queries is true of a screen of VIEWPORT pixels; None if it can't be told."""
    found = []
    for one in query.lower().split(","):
        now: bool | None = True
        for part in re.split(r"\sand\s", f" {one.strip()} "):
            part = part.strip()
            width = re.fullmatch(r"\(\s*(min|max)-width\s*:\s*(\d{1,9}(?:\.\d{1,9})?)px\s*\)", part)
            if width:
                fits = VIEWPORT >= float(width[2]) if width[1] == "min" else VIEWPORT <= float(width[2])
                now = now if fits else False
            elif re.fullmatch(r"(?:only\s+)?[a-z]+", part):
                now = now if part.split()[-1] in ("all", "screen") else False
            elif part and now:
                now = None
        found.append(now)
    return True if True in found else None if None in found else False


class Styles:
    """What a page's style sheets say of display and visibility, by the cascade: importance, style attribute, specificity, order.

    Selectors of tags, classes, ids and attributes, within each other by descent or as children, and widths and kinds of media are
    worked out. Where a rule's match can't be told (other pseudo-classes, siblings, other conditions), it may show but not hide.
    The compounds of all selectors are one tree, and open elements are counted at its nodes, so an element costs the nodes of its
    keys (tag, classes, id, attributes), not its depth. Of a key's selectors with more than the key, those beyond NODES only show.
    """

    def __init__(self) -> None:
        self.by_key: dict[str, list[Node]] = {}
        self.known: dict[tuple, Node] = {}
        self.within: dict[str, int] = {}  # nodes that ask for more than their key
        self.order = 0

    def read(self, sheet: str, sure: bool | None = True) -> None:
        """sure: whether the sheet applies; None if that can't be told."""
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.DOTALL)
        stack: list[list] = []  # [kind, applies, selectors, declarations so far, where what follows begins]
        begin = 0
        for m in _CSS.finditer(sheet + "}" * sheet.count("{")):
            if m[0] == "{":
                prelude = sheet[begin : m.start()].strip()
                applies = stack[-1][1] if stack else sure
                if stack and stack[-1][0] != "group":
                    kind = "skip"  # nested in a rule, or in what is no rule
                    stack[-1][3].append(sheet[stack[-1][4] : m.start()].rpartition(";")[0])
                elif prelude.startswith("@"):
                    name = prelude[1:].split("(")[0].lower().split()[:1]
                    kind = "group" if name and name[0] in ("media", "supports", "layer", "container", "scope", "starting-style") else "skip"
                    now = _media(prelude[6:]) if name == ["media"] else None
                    applies = False if False in (applies, now) else None if None in (applies, now) else True
                else:
                    kind = "rule"
                stack.append([kind, applies, prelude, [], m.end()])
                begin = m.end()
            elif m[0] == "}" and stack:
                kind, applies, prelude, parts, first = stack.pop()
                if kind == "rule" and applies is not False:
                    self._add(prelude, ";".join([*parts, sheet[first : m.start()]]), applies is None)
                if stack:
                    stack[-1][4] = m.end()
                begin = m.end()
            elif m[0] == ";" and (not stack or stack[-1][0] == "group"):
                begin = m.end()

    def _add(self, selectors: str, body: str, doubt: bool) -> None:
        found = _declared(body)
        for one in selectors.split(",") if found else ():
            node, unsure = self._node(one.strip())
            if node is None:
                continue
            for i, (name, value, important) in enumerate(found, self.order):
                key, new = (name, not (doubt or unsure)), (important, i, value)
                node.values[key] = max(node.values.get(key, new), new)
        self.order += len(found)

    def _node(self, selector: str) -> tuple[Node | None, bool]:
        """The tree's node of a selector, and whether its match can't be told; no node if it never matches or isn't understood."""
        node: Node | None = None
        unsure, child, at = False, False, 0
        while at < len(selector):
            tag = mark = ""
            classes: list[str] = []
            conditions: list[tuple[str, str, str]] = []
            ids, kinds, start = 0, 0, at
            while m := _SIMPLE.match(selector, at):
                at = m.end()
                if m[1]:
                    tag = "" if m[1] == "*" else m[1].lower()
                elif m[2] == ".":
                    classes.append(m[3])
                elif m[2] == "#":
                    mark, ids = m[3], ids + 1
                elif m[4]:
                    conditions.append((m[4].lower(), m[5] or "", (m[6] or "").strip("\"'")))
                elif m[7]:
                    if m[7].startswith("::") or m[7].lower() in NEVER:
                        return None, False
                    unsure, kinds = True, kinds + 1
            if at == start:
                return None, False
            up = node.weight if node else (0, 0, 0)
            weight = (up[0] + ids, up[1] + len(classes) + len(conditions) + kinds, up[2] + bool(tag))
            parts = (tag, mark, tuple(classes), tuple(conditions))
            key = f"#{mark}" if mark else f".{classes[0]}" if classes else f"[{conditions[0][0]}" if conditions else tag or "*"
            bare = ("" if key != tag else tag, mark, () if mark else tuple(classes[:1]), ())
            if (node is not None or parts != bare) and (key, parts, child, node) not in self.known:
                self.within[key] = self.within.get(key, 0) + 1
                if self.within[key] > NODES:
                    node, child, unsure, parts = None, False, True, bare
            if (own := self.known.get((key, parts, child, node))) is None:
                own = self.known[key, parts, child, node] = Node(parts, child, node, weight)
                self.by_key.setdefault(key, []).append(own)
            m = _COMBINES.match(selector, at)
            if m is None:
                return (own, unsure) if at == len(selector) else (None, False)
            at = m.end()
            child = m[0].strip() == ">"
            if m[0].strip() in ("+", "~"):
                node, unsure = None, True
            else:
                own.leads = True
                node = own
        return None, False

    def of(self, tag: str, attributes: dict[str, str], parent: list[Node]) -> tuple[dict[str, str], list[Node]]:
        """(the values that win, the nodes that the element matches); the caller counts it at them while it is open."""
        if not self.by_key and "style" not in attributes:
            return {}, []
        best: dict[str, tuple] = {}
        hits: list[Node] = []
        if not attributes:
            keys, names = ("*", tag), _NONE
        else:
            names = set(attributes["class"].split()) if "class" in attributes else _NONE
            keys = ("*", tag, *[f".{c}" for c in names], *[f"[{a}" for a in attributes], f"#{attributes.get('id', '')}")
        for key in keys if self.by_key else ():
            for node in self.by_key.get(key, ()):
                if node.matches(tag, attributes, names, parent):
                    if node.leads:
                        hits.append(node)
                    for (name, sure), (important, order, value) in node.values.items():
                        if sure or value not in HIDING:
                            best[name] = max(best.get(name, ()), (important, 0, node.weight, order, value))
        if style := attributes.get("style"):
            for i, (name, value, important) in enumerate(_declared(re.sub(r"/\*.*?(?:\*/|\Z)", " ", style, flags=re.DOTALL))):
                best[name] = max(best.get(name, ()), (important, 1, (0, 0, 0), i, value))
        return {name: x[4] for name, x in best.items()}, hits


class Flow:
    """Lines under way, with pending space between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a space is due before the next text
        self.gap = 0  # blank lines due before the next line
        self.marker = ""

    def break_line(self, gap: int = 0) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
            self.gap = gap
        else:
            self.gap = max(self.gap, gap)
        self.space = False

    def start(self, indent: str) -> None:
        if not self.line:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.line.append(indent + self.marker)
            self.marker = ""
            self.space = False

    def write(self, text: str, indent: str) -> None:
        """Text with its white space collapsed."""
        flat = _SPACES.sub(" ", text)
        body = flat.strip(" ")
        if not body:
            self.space |= bool(flat) and bool(self.line)
            return
        fresh = not self.line
        self.start(indent)
        if (self.space or flat[0] == " ") and not fresh:
            self.line.append(" ")
        self.line.append(body.replace("\xa0", " "))
        self.space = flat[-1] == " "

    def done(self) -> list[str]:
        self.break_line()
        return self.lines


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines) of each cell
        self.caption: list[str] = []
        self.busy: dict[int, int] = {}  # the last row that a cell from above takes of a column

    def place(self, lines: list[str], columns: int, rows: int) -> None:
        """The next cell of the row, in its first column that no cell from above takes."""
        if not self.rows:
            self.rows.append([])
        r = len(self.rows) - 1
        row = self.rows[r]
        at = min(COLUMNS, row[-1][0] + row[-1][1]) if row else 0
        while at < COLUMNS and self.busy.get(at, -1) >= r:
            at += 1
        columns = max(1, min(columns, COLUMNS - at))
        if rows != 1:
            for c in range(at, at + columns):
                self.busy[c] = r + (rows or 1 << 16) - 1
        row.append((at, columns, lines))

    def render(self) -> list[str]:
        """Cells aligned: a column is as wide as its widest cell of up to ALIGN characters that spans no other."""
        rows = [r for r in self.rows if any(line.strip() for c in r for line in c[2])]
        widths = [0] * (COLUMNS + 1)
        for row in rows:
            for at, columns, lines in row:
                if columns == 1:
                    widths[at] = max([widths[at], *(n for line in lines if (n := len(line)) <= ALIGN)])
        starts = [0]
        for w in widths:
            starts.append(starts[-1] + (w + 2 if w else 0))
        text = sum(len(line) for row in rows for c in row for line in c[2])
        padded = sum(starts[c[0]] for row in rows for c in row[-1:] for _ in c[2])
        if padded > 8 * text + 4096:
            starts = [0] * len(starts)
        out = list(self.caption)
        for row in rows:
            parts: list[list[str]] = [[] for _ in range(max(len(c[2]) for c in row))]
            ends = [0] * len(parts)
            for at, _, lines in row:
                for k, line in enumerate(lines):
                    if line:
                        space = max(starts[at] - ends[k], 2 if ends[k] else 0)
                        parts[k] += [" " * space, line]
                        ends[k] += space + len(line)
            out += ["".join(p).rstrip() for p in parts]
        return out


def _span(attributes: dict[str, str], name: str, most: int, least: int) -> int:
    value = attributes.get(name, "1")
    return min(most, max(least, int(value))) if value.isascii() and value.isdigit() and len(value) < 6 else 1


class Page:
    """The renderer's state; what an element did when it opened is undone when it closes."""

    def __init__(self, styles: Styles) -> None:
        self.flows: list[Flow] = [Flow()]
        self.tables: list[Table] = []
        self.lists: list[list] = []  # [kind, next number]
        self.quotes = self.pre = self.deep = 0
        self.elements: list[tuple[bool, bool, str, tuple, list[Node]]] = []  # (gone, invisible, what it did, how, selectors it matches)
        self.cells: list[tuple[int, int]] = []  # lists and quotes outside each open cell
        self.styles = styles

    def indent(self) -> str:
        lists, quotes = self.cells[-1] if self.cells else (0, 0)
        return "  " * min(INDENTS, max(0, len(self.lists) - lists - 1) + max(0, self.quotes - quotes))

    def text(self, text: str) -> None:
        if self.elements and (self.elements[-1][0] or self.elements[-1][1]):
            return
        flow = self.flows[-1]
        if self.pre:
            for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
                if i:
                    flow.start(self.indent())
                    flow.break_line()
                if part:
                    flow.start(self.indent())
                    flow.line.append(part)
        elif len(self.cells) >= len(self.tables):
            flow.write(text, self.indent())
        elif text.strip():
            self.tables[-1].caption.append(_SPACES.sub(" ", text).strip())

    def open(self, tag: str, attributes: dict[str, str]) -> None:
        gone, invisible, _, _, parent = self.elements[-1] if self.elements else (False, False, "", (), [])
        found, hits = self.styles.of(tag, attributes, parent)
        for node in hits:
            node.open += 1
        display = found.get("display", "revert")
        if display.startswith("revert"):  # what the browser's own sheet says
            display = "none" if "hidden" in attributes or (tag == "dialog" and "open" not in attributes) else ""
        gone = gone or tag in NO_TEXT or display == "none"
        visibility = found.get("visibility", "inherit")
        if visibility in ("visible", "initial", "?"):
            invisible = False
        elif visibility in HIDING:
            invisible = True
        did, how = ("", ()) if gone else self._open(tag, attributes, invisible)
        self.elements.append((gone, invisible, did, how, hits))

    def _open(self, tag: str, attributes: dict[str, str], invisible: bool) -> tuple[str, tuple]:
        flow = self.flows[-1]
        if tag == "br":
            flow.start(self.indent())
            flow.break_line()
        elif tag == "input":
            if not invisible and attributes.get("type", "text").lower() in SHOWN_INPUTS and attributes.get("value", "").strip():
                self.text(" " + attributes["value"] + " ")
        elif tag == "table":
            flow.break_line(1)
            if len(self.tables) < TABLES:
                self.tables.append(Table())
                return "table", ()
            self.deep += 1  # its rows and cells are blocks
            return "deep", ()
        elif tag in TABLE_PARTS or tag == "caption":
            if self.deep or not self.tables or len(self.cells) >= len(self.tables):
                flow.break_line()
                return "block", (0,)
            if tag == "tr":
                self.tables[-1].rows.append([])
            elif tag in ("td", "th", "caption"):
                self.cells.append((len(self.lists), self.quotes))
                self.flows.append(Flow())
                return "caption" if tag == "caption" else "cell", (_span(attributes, "colspan", COLUMNS, 1), _span(attributes, "rowspan", 1 << 16, 0))
            else:
                self.tables[-1].busy.clear()  # no cell reaches out of its section
        elif tag in BLOCKS:
            gap = int(tag in MARGINS and not (tag in ("ul", "ol") and self.lists))
            flow.break_line(gap)
            if tag in ("ul", "ol", "menu", "dir"):
                start = attributes.get("start", "1")
                self.lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                return "list", (gap,)
            if tag == "li":
                if self.lists and self.lists[-1][0] == "ol":
                    flow.marker = f"{self.lists[-1][1]}. "
                    self.lists[-1][1] += 1
                else:
                    flow.marker = "* "
                return "item", (gap,)
            if tag in ("blockquote", "dd"):
                self.quotes += 1
                return "quote", (gap,)
            if tag in ("pre", "textarea", "xmp"):
                self.pre += 1
                return "pre", (gap,)
            return "block", (gap,)
        return "", ()

    def close(self) -> None:
        did, how, hits = self.elements.pop()[2:]
        for node in hits:
            node.open -= 1
        flow = self.flows[-1]
        if did == "table":
            for line in self.tables.pop().render():
                flow.start(self.indent())
                flow.line.append(line)
                flow.break_line()
            flow.break_line(1)
        elif did in ("cell", "caption"):
            own = self.flows.pop().done() or [""]
            self.cells.pop()
            if did == "caption":
                self.tables[-1].caption += own
            else:
                self.tables[-1].place(own, *how)
        elif did == "deep":
            self.deep -= 1
            flow.break_line(1)
        elif did in ("block", "list", "item", "quote", "pre"):
            if did == "item":
                flow.marker = ""
            flow.break_line(*how)
            if did == "list":
                self.lists.pop()
            elif did == "quote":
                self.quotes -= 1
            elif did == "pre":
                self.pre -= 1


def _sheets(html: str) -> Styles:
    """The page's style sheets, read before its text is."""
    styles = Styles()
    last = next(reversed([m.end() for m in _STYLE.finditer(html)]), None)
    if last is None:
        return styles
    end = _STYLE_END.search(html, last)
    html = html[: end.end()] if end else html  # there are none beyond
    open_: list[tuple[str, dict[str, str]]] = []
    templates = 0
    for what, tag, attributes in events(html):
        if what == "open":
            open_.append((tag, attributes))
            templates += tag == "template"
        elif what == "close":
            templates -= open_.pop()[0] == "template"
        elif open_ and open_[-1][0] == "style" and not templates and open_[-1][1].get("type", "").strip().lower() in ("", "text/css"):
            media = open_[-1][1].get("media", "").strip()
            applies = _media(media) if media else True
            if applies is not False:
                styles.read(tag, applies)
    return styles


def render(html: str | None) -> str:
    """The visible text of a page; of null or empty, the empty text."""
    page = Page(_sheets(html or ""))
    for what, tag, attributes in events(html or ""):
        if what == "text":
            page.text(tag)
        elif what == "open":
            page.open(tag, attributes)
        else:
            page.close()
    return "\n".join(page.flows[0].done()).strip("\n")


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text) of each row: the visible text of the whole page.

    A null or empty page has an empty text. Repeated rows each give a row, a null key stays, an empty table gives no rows; other
    columns, whatever their names, don't matter.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(x.as_py()) for x in part.column(1)], pa.string())], [key, "text"])

    return pages.select(F.col(key).cast("long").alias(key), F.col(html).cast("string").alias("html")).mapInArrow(rows, f"`{key}` long, text string")
