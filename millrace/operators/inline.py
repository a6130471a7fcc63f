"""Inline marks of Markdown: code spans, tags, addresses, links and images with their references, stress by runs of delimiters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

# Fixed values of the format: longest label of a reference, parentheses within a bare target, characters that a backslash makes plain.
LABEL, NESTED, PLAIN = 999, 32, set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

_SPECIAL = re.compile(r"[\\`<\[\]*_~\n]|!\[")
_ADDRESS = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_TAG = re.compile(r"<(?:[A-Za-z][A-Za-z0-9-]*+(?:\s++[A-Za-z_:][\w.:-]*+(?:\s*+=\s*+(?:[^\s\"'=<>`]++|'[^']*+'|\"[^\"]*+\"))?+)*+\s*+/?>|/[A-Za-z][A-Za-z0-9-]*+\s*+>)")
_LONG_TAGS = (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>"), ("<!", ">"))
_TITLE = r"(?:\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|\((?:[^()\\]|\\.)*+\))"
_POINTED = re.compile(r"<(?:[^<>\n\\]|\\.)*+>")
_SPACE, _END = re.compile(r"\s*+"), re.compile(rf"(?:\s++{_TITLE})?\s*+\)", re.S)
_REFERRED = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999}+)\]", re.S)
_DEFINED = re.compile(rf" {{0,3}}\[((?:[^\[\]\\]|\\.){{1,999}}+)\]:[ \t]*+\n?+[ \t]*+(<(?:[^<>\n\\]|\\.)*+>|[^\s<]\S*+)(?:(?:[ \t]++\n?+|\n)[ \t]*+{_TITLE}(?=[ \t]*+(?:\n|\Z)))?[ \t]*+(?:\n|\Z)", re.S)


@dataclass
class Inline:
    """A line of text read for its marks: its words, and (target, words, place) of images, targets as written, and (tag, place) of raw tags."""

    words: str
    images: list[tuple[str, str, int]] = field(default_factory=list)
    tags: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class _Run:
    """A run of one delimiter: its place among the parts, what is left of it, its first length, whether it may open and close."""

    part: int
    mark: str
    left: int
    length: int
    opens: bool
    closes: bool


def reference(label: str) -> str:
    """A label as references are compared: case folded, white space as one blank."""
    return " ".join(label.casefold().split())


def definitions(paragraph: str) -> Iterator[tuple[str, str]]:
    """(label, target) of the definitions that a paragraph begins with."""
    at = 0
    while (found := _DEFINED.match(paragraph, at)) and found[1].strip():
        yield reference(found[1]), found[2]
        at = found.end()


def _is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


def _run(text: str, at: int, end: int, part: int) -> _Run:
    """The run text[at:end] by what stands on its two sides."""
    mark, before, after = text[at], text[at - 1] if at else " ", text[end] if end < len(text) else " "
    left = not after.isspace() and (not _is_mark(after) or before.isspace() or _is_mark(before))
    right = not before.isspace() and (not _is_mark(before) or after.isspace() or _is_mark(after))
    if mark == "_":
        return _Run(part, mark, end - at, end - at, left and (not right or _is_mark(before)), right and (not left or _is_mark(after)))
    fits = mark == "*" or end - at <= 2
    return _Run(part, mark, end - at, end - at, left and fits, right and fits)


def _paired(opener: _Run, closer: _Run) -> bool:
    if opener.mark != closer.mark:
        return False
    if opener.mark == "~":
        return opener.left == closer.left
    odd = (opener.closes or closer.opens) and (opener.length + closer.length) % 3 == 0
    return not odd or (opener.length % 3 == 0 and closer.length % 3 == 0)


def _stress(runs: list[_Run]) -> None:
    """Takes the delimiters that pair out of the runs; a search that found no opener isn't made again below its place."""
    held: list[_Run] = []
    floors: dict[tuple, int] = {}
    for closer in runs:
        while closer.closes and closer.left:
            sort = (closer.mark, closer.opens, closer.left if closer.mark == "~" else closer.length % 3)
            floor, j = floors.get(sort, -1), len(held) - 1
            while j >= 0 and held[j].part > floor and not _paired(held[j], closer):
                j -= 1
            if j < 0 or held[j].part <= floor:
                floors[sort] = held[-1].part if held else floor
                break
            used = closer.left if closer.mark == "~" else 2 if min(held[j].left, closer.left) >= 2 else 1
            held[j].left -= used
            closer.left -= used
            del held[j + (held[j].left > 0) :]
        if closer.opens and closer.left:
            held.append(closer)


def _target(text: str, at: int) -> tuple[str, int] | None:
    """(target, end) of what stands in parentheses from `at` on, if it is a link's."""
    at = _SPACE.match(text, at + 1).end()
    if found := _POINTED.match(text, at):
        end = found.end()
    elif text.startswith("<", at):
        return None
    else:
        end, deep = at, 0
        while end < len(text) and not text[end].isspace():
            c = text[end]
            if c == "\\" and text[end + 1 : end + 2] in PLAIN:
                end += 1
            deep += (c == "(") - (c == ")")
            if deep < 0 or deep > NESTED:
                break
            end += 1
        if deep > 0:
            return None
    close = _END.match(text, end)
    return (text[at:end], close.end()) if close else None


def inline(text: str, defined: Mapping[str, str] | None = None) -> Inline:
    """The words and images of an inline text. `defined` has the targets of references.

    Code stands as it is, but for one blank on both sides; tags and delimiters that pair go, links and images leave their words, addresses in angle
    brackets themselves; escaped marks are plain and ends of lines blanks. The time is in proportion to the text.
    """
    defined = defined or {}
    parts: list[str | _Run] = []
    runs: list[_Run] = []
    brackets: list[tuple[int, int, int, bool]] = []  # part, place after the bracket, runs before it, whether an image's
    images: list[tuple[str, int, int, int]] = []
    tags: list[tuple[str, int]] = []
    never: set[str] = set()
    ticks: dict[int, list[int]] = {}
    for found in reversed(list(re.finditer(r"`+", text))):
        ticks.setdefault(len(found[0]), []).append(found.start())
    dead = at = 0  # brackets below `dead` open no link any more, since links hold none
    while at < len(text):
        found = _SPECIAL.search(text, at)
        if not found:
            parts.append(text[at:])
            break
        if found.start() > at:
            parts.append(text[at : found.start()])
        at, c = found.start(), found[0]
        if c == "\\":
            after = text[at + 1 : at + 2]
            parts.append(after if after in PLAIN else " " if after == "\n" else c + after)
            at += 2
        elif c == "\n":
            parts.append(" ")
            at += 1
        elif c == "`":
            end = at
            while text.startswith("`", end):
                end += 1
            same = ticks.get(end - at, [])
            while same and same[-1] < end:
                same.pop()
            code = text[end : same[-1]].replace("\n", " ") if same else text[at:end]
            if same and code.strip(" ") and code[0] == code[-1] == " ":
                code = code[1:-1]
            parts.append(code)
            at = same[-1] + end - at if same else end
        elif c == "<":
            if address := _ADDRESS.match(text, at):
                parts.append(address[1])
                at = address.end()
                continue
            tag = _TAG.match(text, at)
            end = tag.end() if tag else -1
            for begin, close in _LONG_TAGS:
                if end < 0 and close not in never and text.startswith(begin, at) and (begin != "<!" or text[at + 2 : at + 3].isalpha()):
                    stop = text.find(close, at + len(begin))
                    end = stop + len(close) if stop >= 0 else -1
                    if stop < 0:
                        never.add(close)
            if end < 0:
                parts.append(c)
                end = at + 1
            else:
                tags.append((text[at:end], at))
            at = end
        elif c in ("[", "!["):
            brackets.append((len(parts), at + len(c), len(runs), c == "!["))
            parts.append(c)
            at += len(c)
        elif c == "]":
            part, inside, below, image = brackets.pop() if brackets else (-1, 0, 0, False)
            to = None
            if part >= 0 and (image or len(brackets) >= dead):
                if text.startswith("(", at + 1):
                    to = _target(text, at + 1)
                if to is None and defined:
                    referred = _REFERRED.match(text, at + 1)
                    own = referred[1] if referred and referred[1].strip() else text[inside:at] if at - inside <= LABEL and not (referred and referred[1]) else ""
                    if (known := defined.get(reference(own))) is not None:
                        to = known, referred.end() if referred else at + 1
            dead = min(dead, len(brackets))
            if to is None:
                parts.append("]")
                at += 1
                continue
            _stress(runs[below:])
            del runs[below:]
            parts[part] = ""
            if image:
                images.append((to[0], part, len(parts), inside))
            else:
                dead = len(brackets)
            at = to[1]
        else:
            end = at
            while text.startswith(c, end):
                end += 1
            runs.append(_run(text, at, end, len(parts)))
            parts.append(runs[-1])
            at = end
    _stress(runs)
    shown = [p.mark * p.left if isinstance(p, _Run) else p for p in parts]
    return Inline("".join(shown), [(to, "".join(shown[a:b]), place) for to, a, b, place in sorted(images, key=lambda x: x[3])], tags)
