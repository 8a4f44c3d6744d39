"""What the author of a notebook wrote for its reader: the prose of its text cells, whatever form the notebook has."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_CELLS = re.compile(r'"cells"\s*:\s*\[')
_NEXT = re.compile(r"[\s,]*")
_TYPE = re.compile(r'"cell_type"\s*:\s*"(\w+)"')
_SOURCE = re.compile(r'"source"\s*:\s*')
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)("?)', re.S)
#: Cells that speak to the reader; raw cells hold settings.
TEXT_CELLS = frozenset({"markdown", "heading"})

_decoder = json.JSONDecoder(strict=False)


def _joined(source: object) -> str:
    if isinstance(source, str):
        return source
    if isinstance(source, list):
        return "".join(x for x in source if isinstance(x, str))
    return ""


def _whole_cells(book: object) -> Iterator[str]:
    if not isinstance(book, dict):
        return
    sheets = book.get("worksheets")
    for sheet in [book, *(sheets if isinstance(sheets, list) else [])]:
        cells = sheet.get("cells") if isinstance(sheet, dict) else None
        for c in cells if isinstance(cells, list) else []:
            if isinstance(c, dict) and c.get("cell_type") in TEXT_CELLS:
                yield _joined(c.get("source"))


def _cut_cells(text: str) -> Iterator[str]:
    """Text cells of JSON that ends too early or is damaged: whole cells one by one, of the last one what is there."""
    for start in _CELLS.finditer(text):
        at = start.end()
        while True:
            at = _NEXT.match(text, at).end()
            if at >= len(text) or text[at] != "{":
                break
            try:
                cell, at = _decoder.raw_decode(text, at)
            except ValueError:
                rest = text[at:]
                kind, source = _TYPE.search(rest), _SOURCE.search(rest)
                if kind and source and kind[1] in TEXT_CELLS:
                    yield "".join(_unescaped(m[1]) for m in _STRING.finditer(rest, source.end()))
                break
            if isinstance(cell, dict) and cell.get("cell_type") in TEXT_CELLS:
                yield _joined(cell.get("source"))


def _unescaped(s: str) -> str:
    try:
        return json.loads(f'"{s}"', strict=False)
    except ValueError:
        return s.replace("\\n", "\n").replace('\\"', '"')


_MARK = re.compile(r"^#\s?%%(.*)$", re.M)


def _percent_cells(text: str) -> Iterator[str]:
    marks = list(_MARK.finditer(text))
    for m, after in zip(marks, [*marks[1:], None]):
        if "[markdown]" in m[1] or "[md]" in m[1]:
            body = text[m.end() : after.start() if after else len(text)]
            yield "\n".join(line.lstrip()[1:].removeprefix(" ") for line in body.split("\n") if line.lstrip().startswith("#"))


def text_cells(text: str) -> list[str]:
    """The text cells of a notebook; its form is told from the text, as the label may be wrong."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff")
    if text.lstrip().startswith("{"):
        try:
            return list(_whole_cells(json.loads(text, strict=False)))
        except (ValueError, RecursionError):
            return list(_cut_cells(text))
    if _MARK.search(text):
        return list(_percent_cells(text))
    return [text]


_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_DROP = [
    (re.compile(r"^---[ \t]*\n(?:[\w-]+:.*\n)+---[ \t]*$", re.M), ""),
    (re.compile(r"<!--.*?(?:-->|\Z)", re.S), " "),
    (re.compile(r"<(style|script|table|pre|svg)\b.*?(?:</\1\s*>|\Z)", re.S | re.I), " "),
    (re.compile(r"\$\$.*?(?:\$\$|\Z)", re.S), " "),
    (re.compile(r"\\begin\{(\w+\*?)\}.*?(?:\\end\{\1\}|\Z)", re.S), " "),
    (re.compile(r"\$(?=[^\s$])[^$\n]*(?<=[^\s$])\$(?!\d)"), " "),
    (re.compile(r"!\[[^\]\n]*\]\([^)\n]*\)?"), " "),
    (re.compile(r"^[ \t]*\[[^\]\n]*\]\([^)\n]*\)?[ \t]*$", re.M), ""),
    (re.compile(r"\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    (re.compile(r"</?[a-zA-Z][^>\n]*>"), " "),
    (re.compile(r"`[^`\n]*`"), " "),
    (re.compile(r"https?://\S+"), " "),
    (re.compile(r"^[ \t]*(?:#{1,6}[ \t].*|\|.*|>[ \t]*$|[-*_=]{3,}[ \t]*|(?:[-*+]|\d+[.)])[ \t]+.*)$", re.M), ""),
    (re.compile(r"&[a-z]+;|\*\*|__|[*_~]"), ""),
]


def prose_paragraphs(text: str | None) -> list[str]:
    """Paragraphs of prose in the text cells, without headings, lists, tables, formulas, links and code."""
    out: list[str] = []
    for cell in text_cells(text) if text else []:
        cell = _FENCE.sub("\n", cell)
        for pattern, by in _DROP:
            cell = pattern.sub(by, cell)
        out += [p for p in (" ".join(x.split()) for x in re.split(r"\n\s*\n", cell)) if p]
    return out
