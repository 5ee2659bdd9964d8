"""HTML to text by layout: all visible text of a page, with the spacing of blocks, lists and aligned table cells.

A tree builder turns markup into properly nested events: end tags that authors leave out are implied, void elements close at
once, raw text stays raw. The renderer walks the events with a stack of open boxes: invisible subtrees are skipped,
white space collapses outside preformatted text, and table cells are laid out in columns. Both are loops, so deep nesting
needs no recursion.
"""

from __future__ import annotations

import re
import unicodedata
from html import unescape

from pyspark.sql import DataFrame

from cohort.llm.common import map_texts

# Fixed values of the HTML standard: element groups and the tags that an opening tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes plaintext".split())
RAW_TEXT = {"textarea", "title"}          # raw, but with character references
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section
    summary table ul""".split())
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 menu ol p pre listing table ul".split())   # an empty line around them
CLOSES_P = BLOCK - {"html", "body", "dd", "dt", "li", "legend", "option", "optgroup"}
HIDDEN = set("""area base datalist head link meta noembed noframes noscript param rp script style template title iframe audio
    video canvas source track annotation annotation-xml""".split())
DRAWN = {"text"}                                            # of a drawing, only the text of these elements shows
UNDRAWN = set("title desc metadata defs symbol".split())
IMPLIED = {   # opening tag: (tags it closes, tags beyond which it does not look)
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "body": ({"head"}, {"html"}),
    "a": ({"a"}, {"table", "td", "th"}), "button": ({"button"}, {"table", "td", "th"}),
}
SCOPE = {"table", "td", "th", "html", "button", "object"}   # an implied </p> does not reach beyond these
MAX_SPAN, MAX_ROWS = 1000, 65534                            # of columns and rows, as in the standard

TAG = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"[ \t\n\f\r]+")
STYLE = re.compile(r"<style\b[^>]*>(.*?)(?:</style\b|\Z)", re.S | re.I)
STYLE_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
STYLE_BLOCK = re.compile(r"@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}|@[^{};]*;")   # what holds for some devices only
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?")
SHOWS = re.compile(r"(?:^|;)\s*(?:display|visibility)\s*:", re.I)
NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)\b", re.I)


def attributes(text: str) -> dict[str, str]:
    """The first value of each attribute, by lower-case name."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text) if text and not text.isspace() else ():
        out.setdefault(name.lower(), unescape(values[0] or values[1] or values[2]))
    return out


def events(html: str):
    """("open", tag, attributes), ("close", tag, None) and ("text", text, None), properly nested."""
    opened: list[str] = []
    held: dict[str, list[int]] = {}     # where each tag stands among the open ones

    def push(tag: str) -> None:
        held.setdefault(tag, []).append(len(opened))
        opened.append(tag)

    def close_to(depth: int):
        while len(opened) > depth:
            tag = opened.pop()
            held[tag].pop()
            yield "close", tag, None

    def innermost(tags, stop) -> int | None:
        place = max((held[t][-1] for t in tags if held.get(t)), default=-1)
        barrier = max((held[t][-1] for t in stop if held.get(t)), default=-1)
        return place if place >= max(barrier, 0) else None

    at = 0
    while at < len(html):
        mark = html.find("<", at)
        if mark < 0:
            mark = len(html)
        if mark > at:
            yield "text", unescape(html[at:mark]), None
        m = TAG.match(html, mark) if mark < len(html) else None
        if m is None:
            if mark < len(html):
                yield "text", "<", None
            at = mark + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:                                       # an end tag
            if tag == "br":
                yield "open", "br", {}
                yield "close", "br", None
                continue
            stop = {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else () if tag in ("table", "html", "body") else {"td", "th"}
            depth = innermost({tag}, stop)
            if depth is not None:
                yield from close_to(depth)
            continue
        if tag in CLOSES_P and (depth := innermost({"p"}, SCOPE)) is not None:
            yield from close_to(depth)
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            while (depth := innermost(ends, stop)) is not None:
                yield from close_to(depth)
        if tag in BLOCK and held.get("head") and tag not in ("html", "head"):
            yield from close_to(opened.index("head"))
        if tag in ("html", "head", "body") and held.get(tag):
            continue
        if tag in ("td", "th") and innermost({"tr"}, {"table"}) is None and held.get("table"):
            push("tr")
            yield "open", "tr", {}
        found = attributes(m[3] if m[2] else m[6])
        yield "open", tag, found
        if tag in VOID:
            yield "close", tag, None
        elif tag in RAW or tag in RAW_TEXT:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at) if tag != "plaintext" else None
            stop = end.start() if end else len(html)
            body = html[at:stop]
            yield "text", unescape(body) if tag in RAW_TEXT else body, None
            yield "close", tag, None
            closing = html.find(">", stop) if end else -1
            at = closing + 1 if closing >= 0 else len(html)
        else:
            push(tag)
            if tag in ("pre", "listing") and html.startswith("\n", at):
                at += 1                                        # the first line end does not count
    yield from close_to(0)


def unseen(html: str) -> dict[tuple[str, str, str], bool]:
    """(tag, "." or "#" or nothing, name) of the simple selectors in a page's styles: whether their last rule hides.

    Rules for some devices only, and selectors that look at more than one element, are not read.
    """
    out: dict[tuple[str, str, str], bool] = {}
    for sheet in STYLE.findall(html) if "<style" in html.lower() else ():
        for selectors, rule in RULE.findall(STYLE_BLOCK.sub("", STYLE_COMMENT.sub("", sheet))):
            if SHOWS.search(rule):
                for selector in selectors.split(","):
                    m = SIMPLE.fullmatch(selector.strip())
                    if m and (m[1] or m[2]):
                        out[(m[1] or "").lower(), m[2] or "", m[3] or ""] = bool(NO_DISPLAY.search(rule))
    return out


def hidden(tag: str, found: dict[str, str], parents: list, styles: dict | None = None) -> bool:
    """Whether an element and all that is in it does not show. An id's rule goes before a class's, that before a tag's."""
    if tag in HIDDEN or "hidden" in found or NO_DISPLAY.search(found.get("style", "")):
        return True
    if styles and not SHOWS.search(found.get("style", "")):
        names = [("#", n) for n in found.get("id", "").split()] + [(".", n) for n in found.get("class", "").split()]
        told = [styles[own, kind, n] for kind, n in names for own in (tag, "") if (own, kind, n) in styles]
        told += [styles[tag, "", ""]] if (tag, "", "") in styles else []
        if told and told[0]:
            return True
    if tag == "dialog" and "open" not in found:
        return True
    inside = parents[-1] if parents else None
    return bool(inside and inside[0] == "details" and "open" not in inside[1] and tag != "summary")


def width(text: str) -> int:
    """Columns of a text in a fixed-width font."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of one box. Inline text collapses; blocks break lines; an empty line is owed between spaced blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = False
        self.prefix: list[tuple[str, str]] = []   # for the next line and for later ones, by open list item or quote

    def add(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            self._word(first)
            for line in rest:
                self.end(force=True)
                self._word(line)
            return
        if not text:
            return
        words = SPACE.sub(" ", text)
        if words[0] == " ":
            self.space = True
        body = words.strip(" ")
        if body:
            self._word((" " if self.space and self.parts else "") + body)
            self.space = words[-1] == " "

    def _word(self, text: str) -> None:
        if text:
            self.parts.append(text)

    def end(self, force: bool = False) -> None:
        """End the line; an empty one only counts when forced."""
        if self.parts or force:
            self.line("".join(self.parts).rstrip(" "))
        self.parts, self.space = [], False

    def line(self, text: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        start = "".join(a for a, _ in self.prefix)
        self.prefix = [(b, b) for _, b in self.prefix]
        self.lines.append((start + text).rstrip(" "))

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap |= spaced

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """(first column, columns, text) of the cells of each row; a cell that spans rows keeps its columns from those below."""
    taken: dict[int, int] = {}     # column -> rows below for which it is taken
    out = []
    for row in rows:
        at, cells, fresh = 0, [], {}
        for text, columns, spanned in row:
            while taken.get(at, 0) > 0:
                at += 1
            cells.append((at, columns, text))
            if spanned > 1:
                fresh |= dict.fromkeys(range(at, at + columns), spanned)
            at += columns
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | {c: n - 1 for c, n in fresh.items()}
        out.append(cells)
    return out


def table_lines(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (cell text, columns, rows that it spans) as lines with aligned cells, two blanks apart."""
    grid = placed(rows)
    widths: dict[int, int] = {}
    for cells in grid:
        for at, span, text in cells:
            widths.setdefault(at, 0)
            if span == 1:
                widths[at] = max(widths[at], max(map(width, text.split("\n"))))
    order = sorted({c for cells in grid for at, span, _ in cells for c in range(at, at + span)})
    starts, total = {}, 0
    for c in order:
        starts[c] = total
        total += widths.get(c, 0) + 2
    out = []
    for cells in grid:
        if not any(t for *_, t in cells):
            continue
        split = [t.split("\n") for *_, t in cells]
        for k in range(max(map(len, split))):
            line, wide = "", 0
            for (at, _, _), lines in zip(cells, split):
                text = lines[k] if k < len(lines) else ""
                if text:
                    # a text that is wider than its columns moves what follows
                    gap = max(starts[at] - wide, 2 if wide else 0)
                    line, wide = line + " " * gap + text, wide + gap + width(text)
            out.append(line.rstrip(" "))
    return out


def whole_number(text: str, least: int, most: int) -> int:
    return min(most, max(least, int(text))) if re.fullmatch(r"\d{1,9}", text) else 1


def render(html: str) -> tuple[str, str]:
    """(title, visible text) of a page."""
    flows, parents = [Flow()], []          # parents: [tag, attributes, state]
    styles = unseen(html)
    tables, lists, items = [], [], 0       # open tables and lists, and how many list items are open
    skipped = pre = drawing = drawn = 0
    title: list[str] = []
    in_title = False
    for kind, tag, found in events(html):
        flow = flows[-1]
        if kind == "text":
            if in_title:
                title.append(tag)
            if not skipped:
                inside = parents[-1] if parents else None
                if inside and inside[0] in ("table", "tr", "tbody", "thead", "tfoot", "colgroup", "ul", "ol", "dl") and not tag.strip():
                    continue
                if inside and inside[0] == "details" and "open" not in inside[1] or drawing and not drawn or inside and inside[0] == "select":
                    continue
                if inside and inside[0] == "optgroup":
                    continue
                flow.add(tag, pre > 0)
            continue
        if kind == "open":
            if tag == "title" and not title and not drawing:
                in_title = True
            state: object = None
            if skipped or hidden(tag, found, parents, styles) or drawing and tag in UNDRAWN:
                skipped += 1
                parents.append([tag, found, "skipped"])
                continue
            if tag == "br":
                flow.end(force=True)
            elif tag == "hr":
                flow.block(True)
            elif tag == "input" and found.get("type", "text").lower() in ("submit", "button", "reset") and found.get("value"):
                flow.add(found["value"], False)
            elif tag == "table":
                flow.block(True)
                state = []
                tables.append(state)
            elif tag == "select":
                state = []
            elif tag == "option" and any(p[0] == "select" for p in parents[-2:]):
                flows.append(Flow())
                state = "option"
            elif tag == "svg":
                drawing += 1
            elif drawing and tag in DRAWN:
                flow.block(False)
                drawn += 1
                state = "drawn"
            elif tag == "tr":
                if tables:
                    tables[-1].append([])
            elif tag in ("td", "th", "caption"):
                if tables:
                    flows.append(Flow())
                    state = "cell"
            elif tag in BLOCK:
                nested = tag in ("ul", "ol", "dl", "menu", "dir") and items > 0
                flow.block(tag in SPACED and not nested)
                if tag == "li":
                    items += 1
                    owner = lists[-1] if lists else None
                    mark = "- "
                    if owner and owner[0] == "ol":
                        given = found.get("value") if re.fullmatch(r"-?\d{1,9}", found.get("value", "")) else None
                        start = owner[1].get("start", "1")
                        owner[2] = int(given) if given else (owner[2] + 1 if owner[2] is not None else
                                                             int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)
                        mark = f"{owner[2]}. "
                    flow.prefix.append((mark, " " * len(mark)))
                    state = "prefix"
                elif tag == "blockquote":
                    flow.prefix.append(("> ", "> "))
                    state = "prefix"
                elif tag == "dd":
                    flow.prefix.append(("  ", "  "))
                    state = "prefix"
            elif tag == "q":
                flow.add("“", False)
            if tag in ("pre", "listing", "textarea"):
                pre += 1
            parents.append([tag, found, state])
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append(parents[-1])
            continue
        in_title = in_title and tag != "title"
        _, found, state = parents.pop()
        if state == "skipped":
            skipped -= 1
            continue
        if state == "cell":
            text = flows.pop().text()
            if tag == "caption":
                for line in text.split("\n") if text else ():
                    flows[-1].line(line)
            else:
                if not tables[-1]:
                    tables[-1].append([])
                rows = found.get("rowspan", "1")
                tables[-1][-1].append((text, whole_number(found.get("colspan", "1"), 1, MAX_SPAN), MAX_ROWS if rows == "0" else whole_number(rows, 1, MAX_ROWS)))
        elif state == "option":
            text, (_, _, options) = SPACE.sub(" ", flows.pop().text()), next(p for p in reversed(parents) if p[0] == "select")
            options.append((text or found.get("label", ""), "selected" in found))
        elif tag == "select":
            if "multiple" in found or whole_number(found.get("size", "1"), 1, 9) > 1:
                for text, _ in state:
                    flow.block(False)
                    flow.add(text, False)
                flow.block(False)
            elif state:
                flow.add(next((t for t, chosen in reversed(state) if chosen), state[0][0]), False)
        elif tag == "svg":
            drawing -= 1
        elif state == "drawn":
            drawn -= 1
            flow.block(False)
        elif tag == "table":
            tables.pop()
            flow.block(False)
            for line in table_lines(state):
                flow.line(line)
            flow.block(True)
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "dl", "menu", "dir") and items > (tag == "li")
            flow.block(tag in SPACED and not nested)
            items -= tag == "li"
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if state == "prefix":
                flow.prefix.pop()
        elif tag == "q":
            flow.add("”", False)
        if tag in ("pre", "listing", "textarea"):
            pre -= 1
    return SPACE.sub(" ", "".join(title)).strip(" "), flows[0].text()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, text, n_chars) of every page: its title and all text that shows.

    Null or empty pages have an empty title and text. Broken markup never fails: unclosed elements end with the
    page, stray end tags and `<` are ignored and kept as text. Repeated rows stay repeated, null ids have rows too, an
    empty table gives an empty table, further columns are not read.
    """
    def measure(texts):
        found = [render(t.decode()) for t in texts]
        return [[t for t, _ in found], [x for _, x in found], [len(x) for _, x in found]]

    return map_texts(pages, id_col, html_col, measure, "title string, text string, n_chars long")
