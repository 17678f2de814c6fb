"""YAML as rule files use it: blocks, flow collections, quoted and block scalars, anchors, merges, several documents."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any


class NotYaml(ValueError):
    """A text that this reader cannot read."""


#: Fixed values of YAML 1.1: words for nothing and for truth, and escapes in double quotes.
NULLS = {"", "~", "null", "Null", "NULL"}
TRUTH = {w: t for t, words in ((True, "yes true on"), (False, "no false off")) for v in words.split() for w in (v, v.capitalize(), v.upper())}
ESCAPES = {
    "0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"',
    "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029",
}

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?:[^\s,\[\]{}#&*!|>'"%@`?:-]|[?:-](?=\S))(?:(?!:(?:\s|$)|\s\#).)*?)\s*:(?=\s|$)""")
_PROPERTY = re.compile(r"([&!])(\S*)(?:\s+|$)")
_ALIAS = re.compile(r"\*([^\s,\[\]{}]+)")
_COMMENT = re.compile(r"(?:^|\s)#.*$")
_ESCAPE = re.compile(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|\n[ \t]*|.)", re.S)
_FOLD = re.compile(r"[ \t]*\n[ \t]*((?:\n[ \t]*)*)")
_FLOW_PLAIN = re.compile(r"(?:(?!:(?:[\s,\[\]{}]|$)|\s\#)[^,\[\]{}\n])+")


def plain(text: str) -> Any:
    """The value of a scalar without quotes."""
    if text in NULLS:
        return None
    if text in TRUTH:
        return TRUTH[text]
    if re.fullmatch(r"[-+]?(?:0|[1-9][0-9]*)", text):
        return int(text)
    return float(text) if re.fullmatch(r"[-+]?[0-9]+\.[0-9]*", text) else text


def _folded(text: str) -> str:
    return _FOLD.sub(lambda m: "\n" * m[1].count("\n") or " ", text)


def _unescaped(m: re.Match) -> str:
    code = m[1]
    if code[0] == "\n":
        return ""
    if len(code) > 1:
        return chr(int(code[1:], 16))
    if code not in ESCAPES:
        raise NotYaml(f"unknown escape {code!r}")
    return ESCAPES[code]


def _unquoted(text: str) -> str:
    body = text[1:-1]
    if text[0] == "'":
        return _folded(body).replace("''", "'")
    pieces = re.split(r"(\\(?:\n[ \t]*|.))", body, flags=re.S)  # folding leaves escapes alone
    whole = "".join(p if k % 2 else _folded(p) for k, p in enumerate(pieces))
    return _ESCAPE.sub(_unescaped, whole)


class _Flow:
    """Reads one quoted scalar or flow collection; ``more`` gives the next line, or None."""

    def __init__(self, text: str, more: Callable[[], str | None], anchors: dict[str, Any]):
        self.text, self.at, self.more, self.anchors = text, 0, more, anchors

    def grow(self) -> None:
        line = self.more()
        if line is None:
            raise NotYaml("the text ends within quotes or brackets")
        self.text += "\n" + line

    def next(self) -> str:
        """The next character that is no blank and no comment."""
        while True:
            m = re.compile(r"(?:\s|(?:(?<=\s)|^)#[^\n]*)*").match(self.text, self.at)
            self.at = m.end()
            if self.at < len(self.text):
                return self.text[self.at]
            self.grow()

    def quoted(self) -> str:
        quote, k = self.text[self.at], self.at + 1
        while True:
            if k >= len(self.text):
                self.grow()
            elif self.text[k] == "\\" and quote == '"':
                k += 2
            elif self.text[k] != quote:
                k += 1
            elif quote == "'" and self.text[k + 1 : k + 2] == "'":
                k += 2
            else:
                out, self.at = _unquoted(self.text[self.at : k + 1]), k + 1
                return out

    def node(self) -> Any:
        c, name = self.next(), None
        while c in "&!" and (m := re.compile(r"([&!])([^\s,\[\]{}]*)").match(self.text, self.at)):
            name, self.at = m[2] if m[1] == "&" else name, m.end()
            c = self.next()
        if c in "[{":
            out = self.collection(c)
        elif c in "\"'":
            out = self.quoted()
        elif m := _ALIAS.match(self.text, self.at):
            out, self.at = _of(self.anchors, m[1]), m.end()
        elif m := _FLOW_PLAIN.match(self.text, self.at):
            parts = []
            while m:  # plain text goes on over lines
                parts.append(m[0].strip())
                self.at = m.end()
                m = self.at == len(self.text) and self.next() not in ",:[]{}" and _FLOW_PLAIN.match(self.text, self.at)
            out = plain(" ".join(parts))
        else:
            out = None
        if name:
            self.anchors[name] = out
        return out

    def collection(self, opening: str) -> Any:
        self.at += 1
        pairs, items = {}, []
        closing = "]" if opening == "[" else "}"
        while self.next() != closing:
            if self.text[self.at] in ",]}":
                raise NotYaml("an entry is missing")
            item = self.node()
            told = self.next() == ":"
            if told:
                self.at += 1
                value = None if self.next() in ",]}" else self.node()
                _put({} if opening == "[" else pairs, item, value)
            elif opening == "{":
                _put(pairs, item, None)
            items.append({item: value} if told and opening == "[" else item)
            if self.next() == ",":
                self.at += 1
            elif self.text[self.at] != closing:
                raise NotYaml("brackets do not fit")
        self.at += 1
        return items if opening == "[" else pairs


def _of(anchors: dict[str, Any], name: str) -> Any:
    if name not in anchors:
        raise NotYaml(f"no anchor {name!r}")
    return anchors[name]


def _put(pairs: dict, key: Any, value: Any) -> None:
    """Adds a pair; what ``<<`` brings stands behind the mapping's own keys."""
    if isinstance(key, (dict, list)):
        raise NotYaml("a key is a collection")
    if key != "<<":
        pairs[key] = value
        return
    for source in value if isinstance(value, list) else [value]:
        if not isinstance(source, dict):
            raise NotYaml("only mappings can be merged")
        for k, v in source.items():
            pairs.setdefault(k, v)


class _Document:
    def __init__(self, lines: list[str], ended_line: bool):
        """``ended_line`` tells whether a line break ends the last line."""
        self.lines, self.ended_line, self.i, self.anchors = lines, ended_line, 0, {}

    def peek(self) -> tuple[int, str] | None:
        """Indent and text of the next line that says something."""
        while self.i < len(self.lines):
            line = self.lines[self.i]
            text = line.lstrip(" ")
            if text.strip() and not text.lstrip().startswith("#"):
                if text[0] == "\t":
                    raise NotYaml("a tab indents")
                return len(line) - len(text), text.rstrip()
            self.i += 1
        return None

    def read(self) -> Any:
        out = self.block() if self.peek() else None
        if self.peek():
            raise NotYaml("text after the document's value")
        return out

    def block(self) -> Any:
        indent, text = self.peek()
        if text == "-" or text.startswith("- "):
            return self.sequence(indent)
        return self.mapping(indent) if _KEY.match(text) else self.value(text, indent - 1, False)

    def sequence(self, indent: int) -> list:
        out = []
        while (p := self.peek()) and p[0] == indent and (p[1] == "-" or p[1].startswith("- ")):
            rest = p[1][1:].lstrip()
            if rest.startswith("- ") or rest == "-" or _KEY.match(rest):
                self.lines[self.i] = " " * (indent + len(p[1]) - len(rest)) + rest
                out.append(self.block())
            else:
                out.append(self.value(rest, indent, False))
        if p and p[0] > indent:
            raise NotYaml("a line is indented too far")
        return out

    def mapping(self, indent: int) -> dict:
        out, merged = {}, []
        while (p := self.peek()) and p[0] == indent and (m := _KEY.match(p[1])):
            key = _unquoted(m[1]) if m[1][0] in "\"'" else plain(m[1])
            value = self.value(p[1][m.end() :].strip(), indent, True)
            if key == "<<":
                merged.append(value)
            else:
                out[key] = value
        if p and p[0] >= indent and not (p[0] == indent and p[1][0] == "-"):
            raise NotYaml("a line fits no mapping")
        for value in merged:
            _put(out, "<<", value)
        return out

    def value(self, rest: str, indent: int, in_mapping: bool) -> Any:
        """What follows a key or a dash: ``rest`` of the line, and the deeper lines below."""
        name = None
        while m := _PROPERTY.match(rest):
            name, rest = m[2] if m[1] == "&" else name, rest[m.end() :]
        if not rest or rest[0] == "#":
            self.i += 1
            p = self.peek()
            inside = p and (p[0] > indent or in_mapping and p[0] == indent and (p[1] == "-" or p[1].startswith("- ")))
            out = self.block() if inside else None
        elif rest[0] in "|>":
            out = self.scalar_block(rest, indent)
        elif m := _ALIAS.match(rest):
            out = _of(self.anchors, m[1])
            self.ended(rest[m.end() :])
        elif rest[0] in "\"'[{":
            flow = _Flow(rest, self.line_below, self.anchors)
            out = flow.node()
            self.ended(flow.text[flow.at :])
        else:
            out = self.plain_lines(rest, indent)
        if name:
            self.anchors[name] = out
        return out

    def line_below(self) -> str | None:
        self.i += 1
        return self.lines[self.i].strip() if self.i < len(self.lines) else None

    def ended(self, rest: str) -> None:
        if rest.strip() and not re.match(r"\s+#", rest):
            raise NotYaml("text after a value")
        self.i += 1

    def plain_lines(self, rest: str, indent: int) -> Any:
        if rest[0] in ",]}%@`" or rest in ("-", "?") or rest.startswith(("? ", "- ")):
            raise NotYaml("a sign that starts no plain text")
        text = part = _COMMENT.sub("", rest).strip()
        self.i += 1
        while part == rest:  # no comment ended it
            below = self.i
            while below < len(self.lines) and not self.lines[below].strip():
                below += 1
            if below == len(self.lines) or self.lines[below].lstrip().startswith("#"):
                break
            blank, self.i = below - self.i, below
            deep, rest = self.peek()
            if deep <= indent:
                break
            part = _COMMENT.sub("", rest).strip()
            text += ("\n" * blank or " ") + part
            self.i += 1
        if re.search(r":(?:\s|$)", text):
            raise NotYaml("a colon within plain text")
        return plain(text)

    def scalar_block(self, header: str, indent: int) -> str:
        m = re.fullmatch(r"([|>])([-+]?)([1-9]?)([-+]?)(?:\s+#.*)?", header)
        if not m:
            raise NotYaml("a block scalar's first line")
        self.i += 1
        body, width = [], indent + int(m[3]) if m[3] else None
        if width is not None and indent < 0:
            width += 1
        while self.i < len(self.lines):
            line = self.lines[self.i]
            deep = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                width = max(deep, indent + 1) if width is None else width
                if deep < width:
                    break
            body.append(line[width or len(line) :])
            self.i += 1
        kept = "\n".join(body)
        text = kept.rstrip("\n")
        if m[1] == ">":
            text = re.sub(r"(?<=[^\n])\n(\n*)(?=[^\n])", lambda x: x[1] or " ", text)
        chomp = m[2] or m[4]
        last = "\n" if self.ended_line or self.i < len(self.lines) or not (body and body[-1]) else ""
        if chomp == "+":
            return text + kept[len(kept.rstrip("\n")) :] + (last if body else "")
        return text if chomp == "-" or not text else text + ("\n" if "\n" in kept[len(kept.rstrip("\n")) :] else last)


def documents(text: str) -> list[Any]:
    """The values of a text's documents: dicts, lists, strings, numbers, booleans and None.

    Mappings with keys that are collections, and tags' meanings, are not read;
    numbers are those with decimal digits. Raises ``NotYaml``.
    """
    parts: list[list[str]] = [[]]
    marked = False
    for line in re.split(r"\r\n|\r|\n", text.removeprefix("\ufeff")):
        if line.startswith("%") and not any(x.strip() for x in parts[-1]):
            continue
        if re.match(r"---(?:\s|$)", line):
            if marked or any(x.strip() and not x.lstrip().startswith("#") for x in parts[-1]):
                parts.append([])
            marked = True
            parts[-1] = [line[3:].lstrip()] if line[3:].strip() else []
        elif re.match(r"\.\.\.(?:\s|$)", line):
            parts.append([])
            marked = False
        else:
            parts[-1].append(line)
    ended = len(parts[-1]) > 1 and not parts[-1][-1]
    if ended:
        parts[-1].pop()
    said = [p for k, p in enumerate(parts) if marked and k == len(parts) - 1 or k < len(parts) - 1 or any(x.strip() and not x.lstrip().startswith("#") for x in p)]
    try:
        return [_Document(p, ended or p is not parts[-1]).read() for p in said]
    except RecursionError:
        raise NotYaml("nested too deeply") from None
