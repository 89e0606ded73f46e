"""Visible text of web pages, laid out as a browser would: blocks, lists and tables keep their shape.

A page is cut into tags and text by one regular expression. A builder keeps the stack of open elements, closes what a
tag closes by implication (a list item ends the one before, a block ends a paragraph, a cell stands in a row) and
ignores end tags that match nothing in reach. Elements that show nothing are skipped with all they hold: scripts and
the like, ``hidden`` ones, those with ``display: none`` or ``visibility: hidden`` in their style or by a simple rule
(one tag, class or id) of the page's style sheets, closed dialogs, and what a closed ``details`` hides. Rules count as
the cascade has them (importance, inline, id, class, tag, order) and only where their at-rules hold on a screen of
1280 x 800; what is made visible within an invisible element is shown. Formulas, the text elements of SVG, text areas and
the options that a closed or an open list shows are text.

The renderer collapses white space except in ``pre``, starts blocks on lines of their own, puts a blank line around
paragraphs, headings, lists, quotes and tables, marks and indents list items, and aligns the cells of a table in columns.
No step is recursive, so depth costs memory only in proportion to the page.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

from pyspark.sql import DataFrame

from .per_text import per_text

# Fixed by the HTML standard: element classes and what an opening tag closes by implication.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style template noscript iframe object canvas audio video datalist title".split())
IN_FOREIGN = frozenset("annotation annotation-xml desc metadata defs symbol clippath mask marker pattern".split())  # shown nowhere in SVG and formulas
FOREIGN = frozenset({"svg", "math"})
POINTS = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())  # within these HTML goes on
BREAKS_OUT = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p
    pre ruby s small span strong strike sub sup table tt u ul var""".split())  # these end SVG and formulas
RAW = frozenset("script style textarea title iframe noscript template xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu xmp".split())
BLOCK = SPACED | frozenset("""html body div section article header footer nav aside main address form li dt dd
    figcaption details summary caption legend center dir tr dialog search hgroup""".split())
ENDS = {  # opening tag -> (elements it ends, elements beyond which it doesn't look)
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "td", "th"}), "dt": ({"dt", "dd"}, {"dl", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "td", "th"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"table"}), "th": ({"td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
PARTS = frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"})
SCOPE = frozenset({"table", "td", "th", "caption", "html"})  # an end tag doesn't reach out of these, unless it is theirs
IN_BUTTON = SCOPE | {"button"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]+|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SHEET = re.compile(r"<!--.*?(?:-->|\Z)|<(script|noscript|template|textarea|title|xmp|iframe)\b.*?(?:</\1\s*>|\Z)|"
                    r"<style\b([^>]*)>(.*?)(?:</style|\Z)", re.S | re.I)
_CSS = re.compile(r"""((?:"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[^{};])*+)([{};]|\Z)""", re.S)
_FEATURE = re.compile(r"(min-|max-)?([a-z-]+)(?:\s*(:|<=|>=|<|>|=)\s*([\w./-]+))?\Z")
_LENGTH = re.compile(r"(\d*\.?\d+)(px|em|rem)?\Z")
SCREEN = {"width": 1280.0, "height": 800.0}
FEATURES = {"orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "enabled",
            "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference", "grid": "0", "update": "fast"}
PROPERTIES = frozenset({"display", "visibility", "content-visibility"})
_SIMPLE = re.compile(r"[.#]?[\w-]+\Z")
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'>]+\Z")  # here a slash belongs to the value
_SPACE = re.compile(r"[ \t\n\r\f]+")
WIDEST = 60  # columns wider than this aren't padded; their text stays whole
DEEPEST = 20  # lists nested deeper are indented like this


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in reversed(_ATTRIBUTE.findall(text))} if text and not text.isspace() else {}


def declarations(body: str) -> dict[str, tuple[bool, str]]:
    """(important, value) of the properties that decide about showing, the last ones of a list of declarations."""
    found: dict[str, tuple[bool, str]] = {}
    for part in re.sub(r"/\*.*?(?:\*/|\Z)", " ", body, flags=re.S).split(";"):
        name, _, value = part.partition(":")
        name, (value, _, mark) = name.strip().lower(), value.lower().partition("!")
        if name in PROPERTIES and value.strip():
            important = mark.strip() == "important"
            if important or not found.get(name, (False,))[0]:
                found[name] = (important, value.strip())
    return found


def _feature(text: str) -> bool | None:
    """Whether one media feature holds on the screen; None if it isn't known."""
    found = _FEATURE.match(text.strip())
    if not found:
        return None
    bound, name, sign, value = found.groups()
    if name in SCREEN:
        length = _LENGTH.match(value or "")
        if not length:
            return True if value is None else None
        limit = float(length[1]) * (16 if length[2] in ("em", "rem") else 1)
        have = SCREEN[name]
        sign = {"min-": ">=", "max-": "<="}.get(bound, sign)
        return {">=": have >= limit, "<=": have <= limit, "<": have < limit, ">": have > limit}.get(sign, have == limit)
    if bound or name not in FEATURES:
        return None
    return FEATURES[name] == value if value else FEATURES[name] not in ("0", "no-preference")


def _condition(text: str) -> bool | None:
    for word, some in ((" or ", True), (" and ", False)):
        if word in text:
            parts = [_condition(t) for t in text.split(word)]
            return some if some in parts else None if None in parts else not some
    text = text.strip()
    if text.startswith("not ") or text.startswith("not("):
        inner = _condition(text[3:])
        return None if inner is None else not inner
    if text.startswith("(") and text.endswith(")"):
        return _feature(text[1:-1])
    return text in ("all", "screen") if re.fullmatch(r"[a-z-]+", text) else None


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds on a screen; one with parts that aren't known doesn't."""
    queries = [re.sub(r"\s+", " ", q).strip().lower() for q in media.split(",")]
    def holds(q: str) -> bool | None:
        negated = q.startswith("not ") and not q.startswith("not (")
        found = _condition(q[4:] if negated else q.removeprefix("only "))
        return not found if negated and found is not None else found
    return not media.strip() or any(holds(q) for q in queries)


def _at_rule(prelude: str) -> bool:
    """Whether the rules in a block of this at-rule hold."""
    name, rest = re.match(r"@([\w-]*)(.*)", prelude, re.S).groups()
    return name.lower() == "layer" or name.lower() == "media" and on_screen(rest) or (
        name.lower() == "supports" and not rest.strip().lower().startswith("not"))


def sheet_rules(page: str) -> dict[str, dict[str, tuple[bool, int, str]]]:
    """{selector of one tag, class or id: {property: (important, order, value)}} of the page's style elements."""
    found: dict[str, dict[str, tuple[bool, int, str]]] = {}
    if "<style" not in page.lower():
        return found
    order = 0
    for sheet in _SHEET.finditer(page):
        if sheet[3] is None or not on_screen(attributes(sheet[2]).get("media", "")):
            continue
        text = re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", sheet[3], flags=re.S)
        blocks: list[tuple[bool, list[str] | None, list[str]]] = []  # whether it holds, its selectors, its declarations
        for part, end in _CSS.findall(text):
            holds, selectors, body = blocks[-1] if blocks else (True, None, [])
            if end == "{":
                if part.strip().startswith("@"):
                    blocks.append((holds and _at_rule(part.strip()), selectors, []))
                else:  # a rule within a rule selects by both
                    blocks.append((holds, [] if selectors is not None else [s.strip() for s in part.split(",")], []))
                continue
            body.append(part)
            if end != ";":
                for holds, selectors, body in [blocks.pop()] if end and blocks else blocks[::-1] if not end else []:
                    declared = declarations(";".join(body)) if holds and selectors else {}
                    order += 1
                    for selector in selectors if declared else []:
                        if _SIMPLE.match(selector):
                            known = found.setdefault(selector if selector[0] in ".#" else selector.lower(), {})
                            for name, (important, value) in declared.items():
                                if important or not known.get(name, (False,))[0]:
                                    known[name] = (important, order, value)
                if not end:
                    break
    return found


def shown_as(tag: str, attrs: dict[str, str], rules: dict[str, dict[str, tuple[bool, int, str]]]) -> dict[str, str]:
    """The values of ``PROPERTIES`` that an element has by its style and by rules, as far as they are declared."""
    best: dict[str, tuple[bool, int, int, str]] = {}
    selectors = [(0, tag), *((1, "." + c) for c in attrs.get("class", "").split()), (2, "#" + attrs.get("id", ""))] if rules else []
    for level, selector in selectors:
        for name, (important, order, value) in rules.get(selector, {}).items():
            best[name] = max(best.get(name, (False, -1, 0, "")), (important, level, order, value))
    for name, (important, value) in declarations(attrs["style"]).items() if "style" in attrs else ():
        best[name] = max(best.get(name, (False, -1, 0, "")), (important, 3, 0, value))
    return {name: found[-1] for name, found in best.items()}


def hidden(tag: str, attrs: dict[str, str], style: dict[str, str]) -> bool:
    """Whether an element is left out with all it holds."""
    closed = "hidden" in attrs or tag == "dialog" and "open" not in attrs
    display = style.get("display", "none" if closed else "")
    return tag in SKIPPED or display == "none" or style.get("content-visibility") == "hidden"


class Flow:
    """Text of one flow: the page, or a cell."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks, self.space, self.started, self.prefix = 0, False, False, ""

    def line(self, breaks: int) -> None:
        """The next text begins after at least this many line ends."""
        self.breaks = max(self.breaks, breaks)
        self.space = False

    def lead(self, prefix: str) -> None:
        """The next text begins with a mark or an indentation."""
        self.prefix = prefix

    def text(self, text: str) -> None:
        if self.breaks or not self.started:
            self.parts.append("\n" * self.breaks if self.started else "")
            self.parts.append(self.prefix)
            self.breaks, self.prefix, self.space = 0, "", False
        if self.space:
            self.parts.append(" ")
        self.parts.append(text)
        self.started, self.space = True, False

    def inline(self, raw: str) -> None:
        words = _SPACE.sub(" ", raw)
        bare = words.strip(" ")
        if not bare:
            self.space = self.space or bool(words) and self.started and not self.breaks
            return
        if words[0] == " ":
            self.space = self.started and not self.breaks
        self.text(bare)
        self.space = words[-1] == " "

    def whole(self) -> str:
        return "".join(self.parts)


class Table:
    def __init__(self):
        self.rows: list[list[str]] = []

    def lines(self) -> list[str]:
        """Rows with their cells in columns; a cell of several lines makes its row as high."""
        split = [[cell.split("\n") for cell in row] for row in self.rows]
        widths = [0] * max((len(r) for r in split), default=0)
        for row in split:
            for i, cell in enumerate(row):
                widths[i] = max(widths[i], min(WIDEST, max(map(len, cell))))
        out = []
        for row in split:
            for k in range(max(map(len, row), default=0)):
                line = "  ".join((cell[k] if k < len(cell) else "").ljust(widths[i]) for i, cell in enumerate(row)).rstrip()
                if line:
                    out.append(line)
        return out


class Page:
    """Builder and renderer of one page."""

    def __init__(self, html: str):
        self.open: list[str] = []  # open elements
        self.at: dict[str, list[int]] = {}  # where in ``open`` each tag stands
        self.flows, self.tables, self.lists = [Flow()], [], []
        self.cells: list[int] = []  # columns each open cell takes
        self.skip_at = 0  # depth of the outermost hidden element, 0 if none
        self.pre, self.items, self.n_tables = 0, 0, 0
        self.closed_details: list[int] = []  # depths of details elements that aren't open
        self.veils: list[tuple[int, bool]] = []  # depths of elements with a visibility of their own, and whether they're invisible
        self.selects: list[tuple[bool, list[tuple[bool, bool, str]]]] = []  # shows all options; (selected, disabled, text) of each
        self.options: list[tuple[bool, bool, str]] = []  # open ones: selected, disabled, label
        self.rules = sheet_rules(html)
        self.title = ""
        self.read(html)

    # ---- builder -------------------------------------------------------------------------------------------

    def read(self, html: str) -> None:
        at, find = 0, _TOKEN.search
        while True:
            token = find(html, at)
            if token is None:
                break
            if token.start() > at:
                self.data(html[at:token.start()])
            at = token.end()
            if not token[2]:
                continue
            tag = token[2].lower()
            if token[1]:
                self.end_tag(tag)
                continue
            foreign = self.foreign(tag)
            self.start_tag(tag, attributes(token[3]))
            if foreign and token[3].endswith("/") and not _UNQUOTED_END.search(token[3]):
                if self.open and self.open[-1] == tag:
                    self.pop()
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(html, at)
                stop = end.start() if end else len(html)
                if tag == "title" and not self.title and not self.at.get("body"):
                    self.title = _SPACE.sub(" ", unescape(html[at:stop])).strip()
                if tag == "textarea" or tag == "xmp":
                    raw = re.sub(r"\A\r?\n", "", html[at:stop])
                    self.data(raw, tag == "textarea", True)
                at = stop
        if at < len(html):
            self.data(html[at:])
        while self.open:
            self.pop()

    def foreign(self, tag: str) -> bool:
        """Whether an element is one of SVG or of a formula."""
        if tag in FOREIGN:
            return True
        return tag not in BREAKS_OUT and self.in_foreign()

    def in_foreign(self) -> bool:
        return bool(self.at.get("svg") or self.at.get("math")) and self.last(FOREIGN) > self.last(POINTS)

    def start_tag(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in BREAKS_OUT and self.in_foreign():
            self.pop_to(FOREIGN, POINTS, every=True)
        if tag in ("select", "input", "textarea") and self.at.get("select"):
            self.pop_to({"select"}, SCOPE)
            if tag == "select":
                return
        if tag in ENDS:
            ended, limit = ENDS[tag]
            self.pop_to(ended, limit, every=True)
        if tag in BLOCK and self.at.get("p"):
            self.pop_to({"p"}, IN_BUTTON)
        if tag in ("td", "th") and self.at.get("table") and self.last({"tr"}) < self.last({"table"}):
            self.push("tr", {})
        if tag not in VOID:
            self.push(tag, attrs)
        elif not self.skip_at:
            self.void(tag)

    def last(self, tags: set[str] | frozenset) -> int:
        """The place of the innermost open element of these, -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def pop_to(self, tags: set[str], limit: frozenset | set, every: bool = False) -> None:
        """Closes the innermost open element of ``tags`` (or the outermost one) within ``limit``, with all in it."""
        beyond = self.last(limit)
        places = [self.at[t][bisect_right(self.at[t], beyond) if every else -1]
                  for t in tags if self.at.get(t) and self.at[t][-1] > beyond]
        if places:
            stop = min(places) if every else max(places)
            while len(self.open) > stop:
                self.pop()

    def end_tag(self, tag: str) -> None:
        if tag == "br":
            self.start_tag("br", {})
            return
        self.pop_to({tag}, {"html"} - {tag} if tag in ("table", "html", "body") else {"table"} if tag in PARTS else SCOPE)

    # ---- renderer ------------------------------------------------------------------------------------------

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(tag)
        if self.skip_at:
            return
        depth = len(self.open)
        style = shown_as(tag, attrs, self.rules)
        shapes = tag in IN_FOREIGN and self.last(FOREIGN) >= 0
        if shapes or hidden(tag, attrs, style) or self.closed_details and self.closed_details[-1] == depth - 1 and tag != "summary":
            self.skip_at = depth
            return
        visibility = style.get("visibility")
        if visibility in ("hidden", "collapse", "visible", "initial"):
            self.veils.append((depth, visibility in ("hidden", "collapse")))
        veiled = self.veiled()
        flow = self.flows[-1]
        if tag == "details" and "open" not in attrs:
            self.closed_details.append(depth)
        if tag == "select":
            size = attrs.get("size", "1")
            self.selects.append(("multiple" in attrs or size.isdecimal() and int(size) > 1, []))
        elif tag == "option" and self.selects:
            self.flows.append(Flow())
            self.options.append(("selected" in attrs, "disabled" in attrs, attrs.get("label", "")))
            return
        elif tag == "optgroup" and self.selects and self.selects[-1][0] and attrs.get("label") and not veiled:
            self.selects[-1][1].append((False, False, attrs["label"]))
        elif tag == "text" and self.at.get("svg"):
            flow.line(1)
        if tag in ("td", "th"):
            self.flows.append(Flow())
            span = attrs.get("colspan", "1")
            self.cells.append(min(int(span), 1000) if span.isdecimal() and int(span) else 1)
            return
        if tag in BLOCK:
            flow.line(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and self.lists) else 1)
        if tag == "table":
            self.tables.append(Table())
            self.n_tables += not veiled
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("ul", "ol", "menu"):
            start = attrs.get("start", "1")
            self.lists.append(int(start) if tag == "ol" and start.lstrip("-").isdecimal() else 1 if tag == "ol" else None)
        elif tag == "li":
            self.items += not veiled
            mark = "- "
            if self.lists and self.lists[-1] is not None:
                mark = f"{self.lists[-1]}. "
                self.lists[-1] += 1
            flow.lead("" if veiled else "  " * min(DEEPEST, max(0, len(self.lists) - 1)) + mark)
        elif tag == "dd":
            flow.lead("  ")
        elif tag in ("pre", "xmp"):
            self.pre += 1

    def pop(self) -> None:
        depth, tag = len(self.open), self.open.pop()
        self.at[tag].pop()
        if self.skip_at:
            if self.skip_at == depth:
                self.skip_at = 0
            return
        if self.veils and self.veils[-1][0] == depth:
            self.veils.pop()
        if self.closed_details and self.closed_details[-1] == depth:
            self.closed_details.pop()
        if tag in ("td", "th"):
            cell, span = self.flows.pop().whole(), self.cells.pop()
            if self.tables and self.tables[-1].rows:
                self.tables[-1].rows[-1] += [cell] + [""] * (span - 1)
            elif cell:
                self.flows[-1].inline(cell + " ")
            return
        if tag == "option" and self.selects:
            text, (chosen, disabled, label) = self.flows.pop().whole(), self.options.pop()
            self.selects[-1][1].append((chosen, disabled, label if label and not self.veiled() else text))
            return
        flow = self.flows[-1]
        if tag == "select":
            self.choice(*self.selects.pop())
        elif tag == "text" and self.at.get("svg"):
            flow.line(1)
        if tag == "table":
            lines = self.tables.pop().lines()
            for line in lines:
                flow.text(line)
                flow.line(1)
        elif tag in ("ul", "ol", "menu"):
            self.lists.pop()
        elif tag in ("pre", "xmp"):
            self.pre -= 1
        if tag in BLOCK:
            flow.line(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and self.lists) else 1)
            flow.lead("")

    def choice(self, every: bool, options: list[tuple[bool, bool, str]]) -> None:
        """What a select element shows: all its options, or the last selected one, or else the first that isn't disabled."""
        flow = self.flows[-1]
        if every:
            for _, _, text in options:
                flow.line(1)
                if text:
                    flow.inline(text)
            flow.line(1)
            return
        shown = [o[2] for o in options if o[0]][-1:] or [o[2] for o in options if not o[1]][:1]
        if shown and shown[0]:
            flow.inline(f" {shown[0]} ")

    def veiled(self) -> bool:
        return bool(self.veils) and self.veils[-1][1]

    def void(self, tag: str) -> None:
        flow = self.flows[-1]
        if tag == "br":
            if flow.started:
                flow.breaks += 1
            flow.space = False
        elif tag == "hr":
            flow.line(2)

    def data(self, raw: str, coded: bool = True, as_is: bool = False) -> None:
        if self.skip_at or self.veiled() or self.closed_details and self.closed_details[-1] == len(self.open):
            return
        if self.selects and self.last({"option"}) < self.last({"select"}):
            return
        if self.at.get("svg") and self.last({"svg"}) > self.last({"text", "foreignobject"}):
            return
        text = unescape(raw) if coded and "&" in raw else raw
        if self.tables and self.open and self.open[-1] in ("table", "tr", "thead", "tbody", "tfoot"):
            if text.isspace():  # between the parts of a table
                return
        if not self.pre and not as_is:
            self.flows[-1].inline(text)
            return
        flow = self.flows[-1]
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i and flow.started:
                flow.breaks += 1
            if line:
                flow.text(line)


def render(html: str | None) -> tuple[str, str, int, int]:
    """Title, visible text, and the numbers of list items and tables shown."""
    page = Page(html or "")
    text = "\n".join(line.rstrip() for line in page.flows[0].whole().split("\n"))
    return page.title, text.strip("\n"), page.items, page.n_tables


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, text, n_lines, n_items, n_tables), one row per row of ``pages``.

    Null and empty pages have empty text. Null ids and repeated rows are kept. Broken markup is read as far as it goes; what looks
    like a tag that never ends is text. Other columns aren't looked at; an empty table gives an empty table.
    """
    def start():
        def compute(texts: list) -> tuple:
            made = [render(t) for t in texts]
            return ([m[0] for m in made], [m[1] for m in made], [m[1].count("\n") + 1 if m[1] else 0 for m in made],
                    [m[2] for m in made], [m[3] for m in made])
        return compute

    return per_text(pages, html_col, [id_col], {
        "title": "string", "text": "string", "n_lines": "long", "n_items": "long", "n_tables": "long"}, start)
