"""Markdown to HTML by the public CommonMark rules, with tables and footnotes: a helper for tasks, one text at a time.

Blocks: each line first continues the open containers, a stack; what is left of it may open others, or goes to
the innermost leaf. Inlines: brackets and runs of marks are kept on a stack until their partners come.
Nothing recurses on the depth of a text.
"""

from __future__ import annotations

import html
import re
import sys
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark import cloudpickle

_ATX = re.compile(r"(#{1,6})(?=[ \t]|$)")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_MARKER = re.compile(r"([-+*]|(\d{1,9})([.)]))(?=[ \t]|$)")
_NOTE = re.compile(r"\[\^([^\]\s]+)\]:[ \t]*")
_DELIMITER = re.compile(r":?-+:?$")
_TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
_RAW = re.compile(rf"{_TAG}|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z].*?>|<!\[CDATA\[.*?\]\]>", re.S)
# Elements that begin a block of raw HTML, by the public CommonMark specification.
_ELEMENTS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
#: (begin, end, may interrupt a paragraph): an end of None is a blank line.
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True), (re.compile("<!--"), re.compile("-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True), (re.compile("<![A-Za-z]"), re.compile(">"), True),
    (re.compile(rf"</?(?:{'|'.join(_ELEMENTS.split())})(?:\s|/?>|$)", re.I), None, True), (re.compile(rf"(?:{_TAG})\s*$"), None, False),
]
_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|<([\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)>")
_PLAIN = re.compile(r"[^\n`*_\[\]!<&\\]+")
_TARGET = re.compile(r"[ \t\n]*(?:<((?:[^<>\n\\]|\\.)*)>|((?!<)(?:[^\s()\\\x00-\x1f]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))+))?", re.S)
_TITLE = re.compile(r"(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\))", re.S)
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){1,999})\]", re.S)


def _text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _attribute(s: str) -> str:
    return _text(s).replace('"', "&quot;")


def _unescape(s: str) -> str:
    """Backslashes before punctuation and entities, resolved."""
    return re.sub(rf"\\([!-/:-@\[-`{{-~])|({_ENTITY.pattern})", lambda m: m[1] or html.unescape(m[2]), s)


def _href(s: str) -> str:
    return _attribute(quote(s, safe="/:?#@!$&'()*+,;=-._~%[]"))


def _name(label: str) -> str:
    return " ".join(label.split()).casefold()


_LEAVES = ("paragraph", "table", "heading", "rule", "code", "fence", "html")


@dataclass
class _Block:
    kind: str
    lines: list[str] = field(default_factory=list)
    children: list[_Block] = field(default_factory=list)
    open: bool = True
    #: Of an item: columns of its content; of a list: its mark; of a heading: its level; and so on.
    info: dict = field(default_factory=dict)
    blank: bool = False


class _Line:
    """The rest of a line and its column; tabs at its front count to the next multiple of four."""

    def __init__(self, text: str) -> None:
        self.text, self.column, self.raw = text, 0, text
        self._expand()

    @property
    def code(self) -> str:
        """The line as code: its own tabs stay where nothing was taken off its front."""
        return self.text if self.column else self.raw

    def _expand(self) -> None:
        body = self.text.lstrip(" \t")
        front = self.text[: len(self.text) - len(body)]
        if "\t" in front:
            front = (" " * (self.column % 4) + front).expandtabs(4)[self.column % 4 :]
        self.text, self.indent, self.blank = front + body, len(front), not body

    def skip(self, n: int) -> None:
        self.text, self.column = self.text[n:], self.column + n
        self._expand()


def _last(block: _Block) -> _Block | None:
    return block.children[-1] if block.children and block.children[-1].open else None


class _Document:
    def __init__(self, source: str) -> None:
        self.root, self.refs, self.notes = _Block("document"), {}, set()
        for raw in re.split(r"\r\n|\n|\r", source[:-1] if source.endswith("\n") else source):
            self._line(_Line(raw.replace("\0", "\ufffd")))
        self._close(self.root)

    def _close(self, block: _Block) -> None:
        """Close a block with all that is open in it; a paragraph gives up its link definitions."""
        while block is not None:
            block.open = False
            if block.kind == "paragraph":
                self._definitions(block)
            block = block.children[-1] if block.children and block.children[-1].open else None

    def _definitions(self, block: _Block) -> None:
        text = "\n".join(block.lines)
        while text.startswith("[") and (m := _LABEL.match(text)) and text[m.end() : m.end() + 1] == ":" and m[1].strip():
            target = _TARGET.match(text, m.end() + 1)
            if target[1] is None and target[2] is None:
                break
            end, title = target.end(), None
            space = re.compile(r"[ \t]*\n?[ \t]*").match(text, end)
            found = _TITLE.match(text, space.end()) if space.end() > end else None
            rest = re.compile(r"[ \t]*(?:\n|$)")
            if found and rest.match(text, found.end()):
                title, end = next(x for x in found.groups() if x is not None), rest.match(text, found.end()).end()
            elif after := rest.match(text, end):
                end = after.end()
            else:
                break
            self.refs.setdefault(_name(m[1]), (_unescape(target[1] if target[1] is not None else target[2]), _unescape(title) if title is not None else None))
            text = text[end:]
        block.lines = text.split("\n") if text.strip() else []

    def _continues(self, block: _Block, line: _Line) -> bool:
        kind = block.kind
        if kind == "quote":
            if line.indent > 3 or line.text[line.indent : line.indent + 1] != ">":
                return False
            line.skip(line.indent + 1)
            if line.indent:
                line.skip(1)
        elif kind == "item":
            if line.blank:
                return bool(block.children)
            if line.indent < block.info["columns"]:
                return False
            line.skip(block.info["columns"])
        elif kind == "note":
            if not line.blank and line.indent < 4:
                return False
            line.skip(min(line.indent, 4))
        elif kind == "code":
            if line.blank:
                line.skip(min(line.indent, 4))
            elif line.indent < 4:
                return False
            else:
                line.skip(4)
        elif kind == "fence":
            line.skip(min(line.indent, block.info["indent"]))
        elif kind == "html":
            return not (line.blank and block.info["end"] is None)
        elif kind in ("paragraph", "table"):
            return not line.blank
        return kind != "heading" and kind != "rule"

    def _place(self, path: list[_Block], block: _Block) -> _Block:
        """Put a block into the innermost open container that can hold it, which closes what is open inside."""
        while path[-1].kind in _LEAVES or (path[-1].kind == "list") != (block.kind == "item"):
            self._close(path.pop())
        if (before := _last(path[-1])) is not None:
            self._close(before)
        path[-1].children.append(block)
        path.append(block)
        return block

    def _line(self, line: _Line) -> None:
        path = [self.root]
        while (child := _last(path[-1])) is not None and self._continues(child, line):
            path.append(child)
        unmatched, new = child, None
        if path[-1].kind in ("fence", "code", "html"):
            self._code(path[-1], line)
        elif line.blank:
            if unmatched is not None:
                self._close(unmatched)
        elif path[-1].kind != "paragraph" or not self._table(path, line):
            while (opened := self._open(path, line, unmatched)) is not None:
                unmatched = None
                if opened.kind == "item":
                    new = opened
                if opened.kind not in ("quote", "item", "note") or line.blank:
                    break
            if opened is None:
                self._words(path, line, unmatched)
        at = path[-1]
        if line.blank and at.children:
            at.children[-1].blank = True
        blank = line.blank and at.kind not in ("quote", "fence") and not (at is new and not at.children)
        for block in path:
            block.blank = blank

    def _code(self, at: _Block, line: _Line) -> None:
        if at.kind == "fence" and line.indent < 4 and (m := _FENCE.match(line.text.strip())):
            mark, said = (m[1], m[2]) if m[1] else (m[3], m[4])
            if mark[0] == at.info["mark"][0] and len(mark) >= len(at.info["mark"]) and not said.strip():
                at.open = False
                return
        at.lines.append(line.code)
        if at.kind == "html" and at.info["end"] is not None and at.info["end"].search(line.text):
            at.open = False

    def _words(self, path: list[_Block], line: _Line, unmatched: _Block | None) -> None:
        """A line of text: it goes on with a paragraph or table, also one whose containers it doesn't continue, or begins a paragraph."""
        at, body = path[-1], line.text.lstrip(" ")
        if at.kind == "table":
            at.lines.append(body)
        elif at.kind == "paragraph":
            at.lines.append(body)
        elif unmatched is not None and self._tip(unmatched).kind == "paragraph":
            self._tip(unmatched).lines.append(body)
        else:
            self._place(path, _Block("paragraph", [body]))

    def _tip(self, block: _Block) -> _Block:
        while (child := _last(block)) is not None:
            block = child
        return block

    def _open(self, path: list[_Block], line: _Line, unmatched: _Block | None) -> _Block | None:
        """The block that begins here, put in its place; None if the line is text."""
        leaf = path[-1] if path[-1].kind in _LEAVES else None
        text, inside = line.text[line.indent :], leaf is not None and leaf.kind == "paragraph"
        lazy = unmatched is not None and self._tip(unmatched).kind == "paragraph"
        if line.indent > 3:
            if lazy or leaf:
                return None
            line.skip(4)
            return self._place(path, _Block("code", [line.text]))
        if text[0] == ">":
            line.skip(line.indent + 1)
            if line.indent:
                line.skip(1)
            return self._place(path, _Block("quote"))
        if m := _ATX.match(text):
            return self._place(path, _Block("heading", [_unmarked(text[m.end() :])], info={"level": len(m[1])}))
        if m := _FENCE.match(text):
            return self._place(path, _Block("fence", info={"mark": m[1] or m[3], "indent": line.indent, "said": (m[2] or m[4] or "").strip()}))
        if text[0] == "<":
            for begin, end, interrupts in _HTML:
                if begin.match(text) and (interrupts or not (inside or lazy)):
                    block = self._place(path, _Block("html", [line.code], info={"end": end}))
                    block.open = not (end is not None and end.search(text))
                    return block
        if inside and (m := _SETEXT.match(text)):
            self._definitions(leaf)
            if leaf.lines:
                leaf.kind, leaf.open, leaf.info = "heading", False, {"level": 1 if m[1][0] == "=" else 2}
                return leaf
        if _RULE.match(text):
            return self._place(path, _Block("rule"))
        if (m := _NOTE.match(text)) and not inside:
            line.skip(line.indent + m.end())
            self.notes.add(m[1].casefold())
            return self._place(path, _Block("note", info={"label": m[1]}))
        if m := _MARKER.match(text):
            rest = text[m.end() :]
            if inside and (not rest.strip() or (m[2] and m[2] != "1")):
                return None
            start = line.indent
            line.skip(line.indent + m.end())
            pad = line.indent if not line.blank and line.indent <= 4 else 1
            if not line.blank:
                line.skip(pad)
            mark = m[3] or m[1]
            if path[-1].kind != "list" or path[-1].info["mark"] != mark:
                self._place(path, _Block("list", info={"mark": mark, "start": int(m[2]) if m[2] else None}))
            return self._place(path, _Block("item", info={"columns": start + m.end() + pad}))
        return None

    def _table(self, path: list[_Block], line: _Line) -> bool:
        """Whether this line makes a table of the paragraph's last line."""
        leaf = path[-1]
        if not leaf.lines or line.text.strip(" \t|:-") or "|" not in leaf.lines[-1] + line.text:
            return False
        head, marks = _cells(leaf.lines[-1]), _cells(line.text)
        if len(head) != len(marks) or not all(map(_DELIMITER.match, marks)):
            return False
        leaf.lines.pop()
        table = _Block("table", [], info={"head": head, "align": [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((x[0] == ":", x[-1] == ":")) for x in marks]})
        if not leaf.lines:
            path.pop()
            path[-1].children.remove(leaf)
        self._place(path, table)
        return True


def _unmarked(heading: str) -> str:
    """A heading without the marks that may close it."""
    heading = heading.strip(" \t")
    bare = heading.rstrip("#")
    return bare.rstrip(" \t") if not bare or bare[-1] in " \t" else heading


def _cells(row: str) -> list[str]:
    row = row.strip()
    row = row[1:] if row.startswith("|") else row
    row = row[:-1] if row.endswith("|") and not row.endswith("\\|") else row
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", row)]


class _Inline:
    """One paragraph's inlines: pieces of HTML, of which runs of marks and brackets may still change."""

    def __init__(self, source: str, document: _Document, numbers: dict[str, int]) -> None:
        self.s, self.doc, self.numbers = source, document, numbers
        self.out: list[str] = []
        self.plain: list[str] = []  # what each piece gives to the text of an image
        self.marks: list[dict] = []
        self.brackets: list[dict] = []
        self.closed_ticks: dict[int, int] = {}

    def _put(self, code: str, plain: str | None = None) -> None:
        self.out.append(code)
        self.plain.append(code if plain is None else plain)

    def html(self) -> str:
        s, i = self.s, 0
        ticks = {}
        for m in re.finditer("`+", s):
            ticks.setdefault(len(m[0]), []).append(m.start())
        while i < len(s):
            c = s[i]
            if m := _PLAIN.match(s, i):
                self._put(_text(m[0]), m[0])
                i = m.end()
            elif c == "\n":
                last = self.out[-1] if self.out else ""
                if last.endswith("\\") and self.plain[-1] == "\\":
                    self.out[-1] = ""
                    self._put("<br />\n", "\n")
                else:
                    hard = last.endswith("  ")
                    if self.out:
                        self.out[-1] = last.rstrip(" ")
                    self._put("<br />\n" if hard else "\n", "\n")
                i += 1
                while i < len(s) and s[i] in " \t":
                    i += 1
            elif c == "\\":
                if i + 1 < len(s) and s[i + 1] in _PUNCTUATION:
                    self._put(_text(s[i + 1]), s[i + 1])
                    i += 2
                else:
                    self._put("\\")
                    i += 1
            elif c == "`":
                n = len(re.compile("`+").match(s, i)[0])
                later = ticks[n]
                k = self.closed_ticks.get(n, 0)
                while k < len(later) and later[k] < i + n:
                    k += 1
                self.closed_ticks[n] = k
                if k < len(later):
                    body = s[i + n : later[k]].replace("\n", " ")
                    if len(body) > 1 and body[0] == body[-1] == " " and body.strip(" "):
                        body = body[1:-1]
                    self._put(f"<code>{_text(body)}</code>", body)
                    i = later[k] + n
                else:
                    self._put("`" * n)
                    i += n
            elif c == "<":
                if m := _AUTOLINK.match(s, i):
                    url = m[1] or m[2]
                    self._put(f'<a href="{"mailto:" if m[2] else ""}{_href(url)}">{_text(url)}</a>', url)
                    i = m.end()
                elif m := _RAW.match(s, i):
                    self._put(m[0], "")
                    i = m.end()
                else:
                    self._put("&lt;", "<")
                    i += 1
            elif c == "&":
                m = _ENTITY.match(s, i)
                plain = html.unescape(m[0]) if m else "&"
                plain = "\ufffd" if plain == "\0" else plain
                known = bool(m) and plain != m[0]
                self._put(_text(plain if known else "&"), plain if known else "&")
                i = m.end() if known else i + 1
            elif c in "*_":
                i = self._run(i)
            elif c == "!" and s[i + 1 : i + 2] == "[":
                self._put("![")
                self.brackets.append({"at": len(self.out) - 1, "image": True, "active": True, "marks": len(self.marks), "end": i + 2})
                i += 2
            elif c == "[":
                m = re.compile(r"\[\^([^\]\s]+)\]").match(s, i)
                if m and m[1].casefold() in self.doc.notes:
                    n = self.numbers.setdefault(m[1].casefold(), len(self.numbers) + 1)
                    self._put(f'<sup class="footnote-reference"><a href="#{_attribute(m[1])}">{n}</a></sup>', "")
                    i = m.end()
                else:
                    self._put("[")
                    self.brackets.append({"at": len(self.out) - 1, "image": False, "active": True, "marks": len(self.marks), "end": i + 1})
                    i += 1
            elif c == "]":
                i = self._close_bracket(i)
            else:
                self._put(c)
                i += 1
        self._emphasis(0)
        return "".join(self.out)

    def _run(self, i: int) -> int:
        s, c = self.s, self.s[i]
        j = i
        while j < len(s) and s[j] == c:
            j += 1
        before, after = s[i - 1] if i else " ", s[j] if j < len(s) else " "
        space = lambda x: x.isspace()
        mark = lambda x: x in _PUNCTUATION or (not x.isalnum() and not x.isspace() and not x.isascii())
        left = not space(after) and (not mark(after) or space(before) or mark(before))
        right = not space(before) and (not mark(before) or space(after) or mark(after))
        opens, closes = (left, right) if c == "*" else (left and (not right or mark(before)), right and (not left or mark(after)))
        self._put(c * (j - i))
        if opens or closes:
            self.marks.append({"at": len(self.out) - 1, "c": c, "n": j - i, "size": j - i, "opens": opens, "closes": closes, "front": "", "back": ""})
        return j

    def _emphasis(self, bottom: int) -> None:
        """Pair the marks above ``bottom``: each closer with the nearest opener that fits; what is left is text."""
        marks, floor = self.marks, {}
        k = bottom
        while k < len(marks):
            closer = marks[k]
            if not closer["closes"] or not closer["n"]:
                k += 1
                continue
            key = (closer["c"], closer["opens"], closer["size"] % 3)
            j, found = k - 1, None
            least = floor.get(key, bottom)
            while j >= least:
                opener = marks[j]
                odd = (closer["opens"] or opener["closes"]) and (opener["size"] + closer["size"]) % 3 == 0 and (opener["size"] % 3 or closer["size"] % 3)
                if opener["opens"] and opener["n"] and opener["c"] == closer["c"] and not odd:
                    found = opener
                    break
                j -= 1
            if found is None:
                floor[key] = k
                k += 1
                continue
            use = 2 if found["n"] >= 2 and closer["n"] >= 2 else 1
            tag = "strong" if use == 2 else "em"
            found["n"] -= use
            closer["n"] -= use
            found["back"] = f"<{tag}>" + found["back"]
            closer["front"] += f"</{tag}>"
            del marks[j + 1 : k]
            k = j + 1
            floor = {x: min(y, k) for x, y in floor.items()}
            if not found["n"]:
                self._settle(marks.pop(j))
                k -= 1
            if not closer["n"]:
                self._settle(marks.pop(k))
        for mark in marks[bottom:]:
            self._settle(mark)
        del marks[bottom:]

    def _settle(self, mark: dict) -> None:
        self.out[mark["at"]] = mark["front"] + mark["c"] * mark["n"] + mark["back"]
        self.plain[mark["at"]] = mark["c"] * mark["n"]

    def _close_bracket(self, i: int) -> int:
        s = self.s
        while self.brackets and self.brackets[-1].get("gone"):
            self.brackets.pop()
        if not self.brackets:
            self._put("]")
            return i + 1
        opener = self.brackets.pop()
        target = self._target(s, i + 1, s[opener["end"] : i]) if opener["active"] else None
        if target is None:
            self._put("]")
            return i + 1
        url, title, end = target
        self._emphasis(opener["marks"])
        a = opener["at"]
        said = f' title="{_attribute(title)}"' if title is not None else ""
        if opener["image"]:
            words = "".join(self.plain[a + 1 :])
            code = f'<img src="{_href(url)}" alt="{_attribute(words)}"{said} />'
            del self.out[a:], self.plain[a:]
            self._put(code, words)
        else:
            self.out[a], self.plain[a] = f'<a href="{_href(url)}"{said}>', ""
            self._put("</a>", "")
            for other in self.brackets:
                if not other["image"]:
                    other["active"] = False
        return end

    def _target(self, s: str, i: int, inner: str) -> tuple[str, str | None, int] | None:
        """(address, title, end) of what follows a closing bracket, or of its text as a reference."""
        if s[i : i + 1] == "(":
            m = _TARGET.match(s, i + 1)
            url, end = m[1] if m[1] is not None else (m[2] or ""), m.end()
            space = re.compile(r"[ \t\n]*").match(s, end)
            title = _TITLE.match(s, space.end()) if space.end() > end else None
            close = re.compile(r"[ \t\n]*\)").match(s, title.end() if title else end)
            if close:
                return _unescape(url), _unescape(next(x for x in title.groups() if x is not None)) if title else None, close.end()
        label = _LABEL.match(s, i)
        end = i
        if label:
            inner, end = label[1], label.end()
        elif s[i : i + 2] == "[]":
            end = i + 2
        found = self.doc.refs.get(_name(inner)) if len(inner) < 1000 and not (not label and re.search(r"(?<!\\)[\[\]]", inner)) else None
        return (*found, end) if found else None


def to_html(source: str | None) -> str | None:
    """The HTML of a Markdown text; null for null."""
    if source is None:
        return None
    doc, out, numbers = _Document(source), [], {}

    def fresh() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    inline = lambda text: _Inline(text, doc, numbers).html()
    work: list = [(doc.root, False)]
    while work:
        step = work.pop()
        if isinstance(step, str):
            out.append(step)
            continue
        block, tight = step
        kind = block.kind
        if kind in ("document", "quote", "list", "item", "note"):
            end = ""
            if kind == "quote":
                fresh()
                out.append("<blockquote>\n")
                end = "</blockquote>\n"
            elif kind == "list":
                fresh()
                start = block.info["start"]
                out.append("<ul>\n" if start is None else "<ol>\n" if start == 1 else f'<ol start="{start}">\n')
                end = "</ul>\n" if start is None else "</ol>\n"
                tight = not _loose(block)
            elif kind == "item":
                out.append("<li>")
                end = "</li>\n"
            elif kind == "note":
                fresh()
                n = numbers.setdefault(block.info["label"].casefold(), len(numbers) + 1)
                out.append(f'<div class="footnote-definition" id="{_attribute(block.info["label"])}"><sup class="footnote-definition-label">{n}</sup>')
                end = "</div>\n"
            inner = tight if kind in ("list", "item") else False
            work.append(end)
            work.extend((x, inner) for x in reversed(block.children))
        elif kind == "paragraph":
            text = "\n".join(block.lines).rstrip()
            if text and tight:
                out.append(inline(text))
            elif text:
                fresh()
                out.append(f"<p>{inline(text)}</p>\n")
        elif kind == "heading":
            fresh()
            level = block.info["level"]
            text = "\n".join(block.lines).strip()
            out.append(f"<h{level}>{inline(text)}</h{level}>\n")
        elif kind == "rule":
            fresh()
            out.append("<hr />\n")
        elif kind in ("code", "fence"):
            fresh()
            lines = block.lines
            if kind == "code":
                while lines and not lines[-1].strip():
                    lines.pop()
            said = _unescape(block.info.get("said", "")).split()
            lang = f' class="language-{_attribute(said[0])}"' if said else ""
            out.append(f"<pre><code{lang}>{_text(''.join(x + chr(10) for x in lines))}</code></pre>\n")
        elif kind == "html":
            fresh()
            out.append("\n".join(block.lines).rstrip("\n") + "\n")
        elif kind == "table":
            fresh()
            align = [f' style="text-align: {x}"' if x else "" for x in block.info["align"]]
            row = lambda cells, tag: "".join(f"<{tag}{a}>{inline(c)}</{tag}>" for c, a in zip([*cells, *[""] * len(align)], align, strict=False))
            out.append(f"<table><thead><tr>{row(block.info['head'], 'th')}</tr></thead><tbody>\n")
            out.extend(f"<tr>{row(_cells(line), 'td')}</tr>\n" for line in block.lines)
            out.append("</tbody></table>\n")
    return "".join(out)


def _loose(block: _Block) -> bool:
    """Whether blank lines stand between a list's items or between the children of one."""
    items = block.children
    for i, item in enumerate(items):
        more = i + 1 < len(items)
        if more and _ends_blank(item):
            return True
        if any(_ends_blank(child) for child in (item.children if more else item.children[:-1])):
            return True
    return False


def _ends_blank(block: _Block) -> bool:
    """Whether a blank line follows the block, or the last one in it."""
    while not block.blank:
        if block.kind not in ("list", "item") or not block.children:
            return False
        block = block.children[-1]
    return True


# Tasks get these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
