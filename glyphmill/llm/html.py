"""HTML extraction as a browser lays it out, in plain text.

A tokenizer and a tree builder (a stack of open elements, with the tags HTML lets
authors leave out) turn a page into properly nested events. A renderer follows
them: hidden elements are skipped, blocks stand on lines of their own, paragraphs
and headings apart from the rest, lists have bullets or numbers, cells of a table
are aligned in columns. All visible text comes out, in order. Nothing recurses, so
deeply nested pages are safe.

What hides: the ``hidden`` attribute, a closed dialog, the body of closed details, the
options of a drop-down that are not chosen, ``display`` and ``visibility`` of an
element's own style or of the page's style sheets. Of these, selectors of one element
(tag, classes, id) count, from where the sheet stands on; at-rules are passed over.
"""

from __future__ import annotations

import re
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import arrays as A

TEXT = "page_id long, text string, n_blocks long, n_list_items long, n_table_rows long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas datalist noembed noframes".split())
#: Within SVG or MathML, what is not shown.
HIDDEN_WITHIN = {"svg": frozenset("title desc defs metadata".split()), "math": frozenset(["annotation", "annotation-xml"])}
FOREIGN = frozenset([*HIDDEN_WITHIN, "foreignobject"])
#: Parts of charts and formulas that stand apart.
APART = frozenset("text mtd".split())
#: Lines of their own; those in SPACED also keep a blank line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp table ul ol dl figure".split())
BLOCK = SPACED | frozenset(
    "html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup "
    "hr legend li main menu nav optgroup option search section summary caption tr thead tbody tfoot".split()
)
#: A start tag ends an open element of these, up to the given borders.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "select": (("select",), ("table", "td", "th", "body")),
    "tr": (("tr", "caption"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "body": (("head",), ()),
}
HEAD_ONLY = frozenset("base link meta title style script noscript template html head".split())
P_ENDS = BLOCK - frozenset("tr thead tbody tfoot caption option optgroup html body legend summary".split())
SCOPE = frozenset("table td th caption button object".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SHEET = re.compile(r"\s*(@?)([^{};]*)(?:;|\{([^{}]*)\}?|\Z)")
BRACE = re.compile(r"[{}]")
SIMPLE = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)\Z", re.I)
#: Inputs whose value is not text on the page.
SILENT = frozenset("hidden password checkbox radio file range color image".split())
GAP = re.compile(r"[ \t\n\r\f]+")


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _count(value: str | None) -> int:
    return min(max(int(value), 1), 1000) if value and value.strip().isdigit() else 1


def _room(text: str) -> int:
    """Columns that a text takes: two for a wide character, none for a mark."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


class _Sheet:
    """The display and visibility that the page's style sheets give to elements."""

    def __init__(self):
        self.rules: dict[str, list] = {}  # by the last class, id or tag of the selector
        self.order = 0

    def read(self, css: str) -> None:
        css = COMMENT.sub(" ", css)
        at = 0
        while at < len(css):
            m = SHEET.match(css, at)
            if m is None:  # an end of a block that never began
                at += 1
                continue
            at = m.end() if m.end() > at else at + 1
            if m[1] and m[3] is not None:
                at = self._past_block(css, css.index("{", m.start()))
            elif m[3] is not None:
                found = DECLARED.findall(m[3])
                for selector in m[2].split(",") if found else ():
                    self._add(selector.strip(), found)

    @staticmethod
    def _past_block(css: str, at: int) -> int:
        depth = 0
        for m in BRACE.finditer(css, at):
            depth += 1 if m[0] == "{" else -1
            if depth <= 0:
                return m.end()
        return len(css)

    def _add(self, selector: str, found) -> None:
        m = SIMPLE.match(selector) if selector else None
        if m is None:
            return
        tag = (m[1] or "*").lower()
        names = re.findall(r"[.#][\w-]+", m[2])
        weight = (sum(n[0] == "#" for n in names), sum(n[0] == "." for n in names), tag != "*")
        self.order += 1
        for name, value, important in found:
            rule = (tag, frozenset(names), (bool(important), *weight, self.order), name.lower(), value.lower())
            self.rules.setdefault(names[-1] if names else tag, []).append(rule)

    def of(self, tag: str, marks: dict[str, str]) -> dict[str, str]:
        best: dict[str, tuple] = {}
        if self.rules:
            own = {"." + c for c in marks.get("class", "").split()}
            if marks.get("id"):
                own.add("#" + marks["id"])
            for key in (*own, tag, "*"):
                for wanted, names, weight, name, value in self.rules.get(key, ()):
                    if wanted in ("*", tag) and names <= own:
                        best[name] = max(best.get(name, ((False,), "")), (weight, value))
        for name, value, important in DECLARED.findall(marks.get("style", "")):
            weight = (bool(important), 1 << 30)
            if weight >= best.get(name.lower(), ((False,), ""))[0]:
                best[name.lower()] = (weight, value.lower())
        return {name: value for name, (_, value) in best.items()}


class _Flow:
    """Lines under way: of the page, or of one table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a collapsed space is due
        self.blank = False  # a blank line is due
        self.prefix: list[str] = []
        self.bullet = ""

    def text(self, words: str) -> None:
        body = GAP.sub(" ", words)
        if body == " " or not body:
            self.space |= bool(self.line) and body == " "
            return
        if (self.space or body[0] == " ") and self.line:
            self.line.append(" ")
        self.line.append(body.strip(" "))
        self.space = body[-1] == " "

    def raw(self, words: str) -> None:
        first, *rest = words.split("\n")
        self.line.append(first)
        for more in rest:
            self.end_line(keep=True)
            self.line.append(more)
        self.space = False

    def end_line(self, keep: bool = False) -> None:
        body = "".join(self.line)
        self.line, self.space = [], False
        if not body and not keep:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = "".join(self.prefix)
        if self.bullet:
            lead = lead[: len(lead) - len(self.bullet)] + self.bullet
            self.bullet = ""
        self.lines.append((lead + body).rstrip(" "))

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


class _Page:
    def __init__(self):
        self.open: list[tuple[str, bool, int]] = []  # tag, hidden, length of prefix
        self.veils: list[bool] = []  # for each open element: laid out, but invisible
        self.shut: dict[int, bool] = {}  # closed details by depth: has the summary come?
        self.sheet = _Sheet()
        self.selects: list[list | None] = []  # drop-downs: first option, chosen one
        self.flows = [_Flow()]
        self.tables: list[list[list[tuple[list[str], int, int]]]] = []
        self.lists: list[list] = []  # [ordered, next number]
        self.pre = 0
        self.foreign: list[str] = []  # svg and math that are open, and HTML inside them
        self.blocks = self.items = self.rows = 0

    # The tree: which elements are open.

    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def within(self) -> str:
        """svg or math, if one is open and no HTML inside it."""
        return self.foreign[-1] if self.foreign and self.foreign[-1] in HIDDEN_WITHIN else ""

    def start(self, tag: str, raw: str) -> None:
        around = tag if tag in HIDDEN_WITHIN else self.within()
        if around and raw.endswith("/") and not re.search(r"=[^\s\"'=]*/$", raw):
            return  # ends itself; in HTML the slash means nothing
        if tag in ENDS:
            self._close_up_to(*ENDS[tag])
        elif tag not in HEAD_ONLY and self.open and self.open[-1][0] == "head":
            self.end("head")
        if tag in P_ENDS:
            self._close_up_to(("p",), SCOPE)
        if tag in ("td", "th") and (not self.open or self.open[-1][0] != "tr") and self.tables:
            self.start("tr", "")
        hide = self.hidden() or tag in HIDDEN or tag in HIDDEN_WITHIN.get(around, ())
        depth = len(self.open)
        if depth in self.shut:
            hide |= tag != "summary" or self.shut[depth]
            self.shut[depth] |= tag == "summary"
        marks: dict[str, str] = {}
        veil = bool(self.veils) and self.veils[-1]
        if not hide:
            marks = _attributes(raw) if raw else {}
            style = self.sheet.of(tag, marks)
            closed = "hidden" in marks or (tag == "dialog" and "open" not in marks)
            hide = style.get("display") == "none" or (closed and style.get("display") is None)
            seen = style.get("visibility")
            veil = seen in ("hidden", "collapse") if seen in ("hidden", "collapse", "visible", "initial") else veil
        if tag in VOID:
            if not hide and (tag == "br" or not veil):
                self._void(tag, marks)
            return
        self.open.append((tag, hide, len(self.flows[-1].prefix)))
        self.veils.append(veil)
        if tag == "details" and not hide and "open" not in marks:
            self.shut[len(self.open)] = False
        if tag in FOREIGN:
            self.foreign.append(tag)
        if around and tag in APART and not hide:
            self.flows[-1].text(" ")
        if not hide:
            self._enter(tag, marks)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if depth is None or (tag not in SCOPE and tag not in ("html", "body") and any(
            t in ("table", "td", "th") for t, _, _ in self.open[depth + 1 :]
        ) and tag not in ("tr", "thead", "tbody", "tfoot")):
            return
        while len(self.open) > depth:
            self._pop()

    def _close_up_to(self, tags, borders) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i][0]
            if tag in tags:
                while len(self.open) > i:
                    self._pop()
                return
            if tag in borders:
                return

    def _pop(self) -> None:
        self.shut.pop(len(self.open), None)
        tag, hide, prefix = self.open.pop()
        self.veils.pop()
        if tag in FOREIGN:
            self.foreign.pop()
        if tag in APART and not hide and self.within():
            self.flows[-1].text(" ")
        if not hide:
            self._leave(tag, prefix)

    # The layout of visible elements.

    def _void(self, tag: str, marks: dict[str, str]) -> None:
        flow = self.flows[-1]
        if tag == "br":
            flow.end_line(keep=True)
        elif tag == "hr":
            flow.end_line()
            flow.blank = True
        elif tag == "input" and marks.get("type", "").strip().lower() not in SILENT and marks.get("value"):
            flow.text(" " + marks["value"] + " ")

    def _enter(self, tag: str, marks: dict[str, str]) -> None:
        flow = self.flows[-1]
        if tag in ("td", "th") and self.tables:
            down = marks.get("rowspan", "").strip()
            rows = min(int(down), 65534) or 65534 if re.fullmatch(r"[0-9]{1,9}", down) else 1
            self.tables[-1][-1].append(([], _count(marks.get("colspan")), rows))
            self.flows.append(_Flow())
            return
        if tag == "select":
            size = marks.get("size", "").strip()
            drop = "multiple" not in marks and not (size.isdigit() and int(size) > 1)
            self.selects.append([None, None] if drop else None)
            if drop:
                self.flows.append(_Flow())
            return
        if self.selects and self.selects[-1] is not None:
            if tag == "option":
                self.flows.append(_Flow())
                self.selects[-1].append("selected" in marks)
                self.selects[-1].append("disabled" in marks)
            return
        if tag not in BLOCK:
            return
        flow.end_line()
        veil = self.veils[-1]
        self.blocks += not veil
        if tag in SPACED and not (tag in ("ul", "ol") and self.lists):
            flow.blank = True
        if tag in ("ul", "ol", "menu", "dir"):
            first = marks.get("start", "")
            self.lists.append([tag == "ol", int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1])
        elif tag == "li":
            self.items += not veil
            bullet = "- "
            if self.lists and self.lists[-1][0]:
                bullet = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            flow.prefix.append(" " * len(bullet))
            flow.bullet = "" if veil else bullet
        elif tag == "dd":
            flow.prefix.append("    ")
        elif tag == "blockquote":
            flow.prefix.append("> ")
        elif tag in ("pre", "xmp"):
            self.pre += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.rows += not veil
            self.tables[-1].append([])

    def _leave(self, tag: str, prefix: int) -> None:
        if tag in ("td", "th") and len(self.flows) > 1:
            lines = self.flows.pop().done()
            if self.tables and self.tables[-1] and self.tables[-1][-1]:
                self.tables[-1][-1][-1][0].extend(lines)
            return
        if tag == "select" and self.selects:
            options = self.selects.pop()
            if options is not None:
                self.flows.pop()
                shown = options[0] if options[1] is None else options[1]
                if shown:
                    self.flows[-1].text(" " + shown + " ")
            return
        if self.selects and self.selects[-1] is not None:
            if tag == "option":
                disabled, selected = self.selects[-1].pop(), self.selects[-1].pop()
                words = " ".join(self.flows.pop().done())
                if selected:
                    self.selects[-1][1] = words
                elif self.selects[-1][0] is None and not disabled:
                    self.selects[-1][0] = words
            return
        if tag not in BLOCK:
            return
        flow = self.flows[-1]
        flow.end_line()
        if tag == "li" and flow.bullet:
            flow.line.append("")
            flow.bullet = ""
        if tag in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
        elif tag in ("pre", "xmp"):
            self.pre -= 1
        elif tag == "table" and self.tables:
            for line in _aligned(self.tables.pop()):
                flow.line.append(line)
                flow.end_line()
        if tag in SPACED and not (tag in ("ul", "ol") and self.lists):
            flow.blank = True
        del flow.prefix[prefix:]

    def words(self, text: str) -> None:
        if self.open and self.open[-1][0] == "head" and not text.isspace():
            self.end("head")
        if self.hidden() or (self.veils and self.veils[-1]) or len(self.open) in self.shut:
            return
        if self.pre:
            self.flows[-1].raw(text)
        else:
            self.flows[-1].text(text)

    def finish(self) -> str:
        while self.open:
            self._pop()
        return "\n".join(self.flows[0].done()).strip("\n")


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows as lines, each cell padded to its column; a cell over several columns
    takes the room of all. A cell over several rows stands in the first of them and
    keeps its columns free in the others. The last cell of a row is not padded."""
    width: dict[int, int] = {}
    taken: dict[int, int] = {}  # rows that a column is still taken for from above
    grid = []
    for row in rows:
        placed, at, below = [], 0, {}
        for lines, span, down in row:
            while taken.get(at, 0):
                placed.append(([], at, 1))
                at += 1
            placed.append((lines, at, span))
            if down > 1:
                below.update(dict.fromkeys(range(at, at + span), down))
            if span == 1:
                width[at] = max(width.get(at, 0), max(map(_room, lines), default=0))
            at += span
        taken = {c: n - 1 for c, n in (taken | below).items() if n > 1}
        grid.append(placed)
    out = []
    for row in grid:
        for k in range(max((len(lines) for lines, _, _ in row), default=0)):
            parts = []
            for lines, at, span in row:
                room = sum(width.get(c, 0) for c in range(at, at + span)) + 3 * (span - 1)
                text = lines[k] if k < len(lines) else ""
                parts.append(text + " " * (room - _room(text)))
            out.append(" | ".join(parts).rstrip(" "))
    return out


def render(html: str | None) -> tuple[str, int, int, int]:
    """Visible text, and how many blocks, list items and table rows it has."""
    page = _Page()
    html = html or ""
    low = None
    at, end = 0, len(html)
    while at < end:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            first = m[0]
            if first[0] != "<" or first == "<":
                page.words(unescape(first))
            elif first.startswith("<![CDATA[") and page.within():
                stop = html.find("]]>", m.start())
                stop = end if stop < 0 else stop
                page.words(html[m.start() + 9 : stop])
                at = min(end, stop + 3)
            continue
        tag = tag.lower()
        if m[1]:
            page.end(tag)
            continue
        depth = len(page.open)
        page.start(tag, m[3])
        if tag in RAW and not (page.within() and len(page.open) <= depth and m[3].endswith("/")):
            low = html.lower() if low is None else low
            stop = low.find("</" + tag, at) if len(low) == end else html.find("</" + tag, at)
            stop = end if stop < 0 else stop
            if tag == "style":
                page.sheet.read(html[at:stop])
            elif tag == "textarea":
                page.words(unescape(html[at:stop]))
            elif tag == "xmp":
                page.words(html[at:stop])
            close = html.find(">", stop)
            at = end if close < 0 else close + 1
            page.end(tag)
    return page.finish(), page.blocks, page.items, page.rows


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, text, n_blocks, n_list_items, n_table_rows`` of every page.

    Defined cases: a null or empty page gives an empty text; unclosed and misplaced
    tags are mended as far as the implied-tag rules go, and what is left of a
    broken tag counts as text; repeated rows are each rendered; an empty table
    gives an empty result. Other columns are not read.
    """

    def rendered(batches):
        for whole in batches:
            for batch in A.slices([whole], "html"):
                done = [render(h) for h in batch.column("html").to_pylist()]
                text, blocks, items, rows = zip(*done, strict=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": batch.column("page_id"),
                        "text": pa.array(text, pa.string()),
                        "n_blocks": pa.array(blocks, pa.int64()),
                        "n_list_items": pa.array(items, pa.int64()),
                        "n_table_rows": pa.array(rows, pa.int64()),
                    }
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(rendered, TEXT)
