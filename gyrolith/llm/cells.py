"""Text and output units of flattened notebooks.

A unit is what may be residue on its own: the whole text, and each paragraph or cell of text or
output in it.  Code is no unit.  The flattening is told from the text itself, since the column that
names it may be null or the text cut off:

* JSON notebooks: each markdown or raw cell and each output; what no longer parses is read by scanning;
* ``# %%`` scripts: markdown and output cells, without their comment signs;
* fenced: paragraphs outside fences, and fences of text;
* console: paragraphs other than those of ``In [n]:``.
"""

from __future__ import annotations

import json
import re

_SCAN = re.compile(r'"cell_type"\s*:\s*"(\w+)"|"(source|text|text/plain|text/html|traceback)"\s*:\s*(\[(?:\s*"(?:[^"\\]|\\.)*"\s*,?)*\s*\]?|"(?:[^"\\]|\\.)*"?)', re.S)
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"?', re.S)
_BLANK = re.compile(r"\n[ \t]*\n")
_MARK = re.compile(r"(?m)^# (?:%%|\+ ).*$")
_FENCE = re.compile(r"(?ms)^[ \t]*(```+|~~~+)([^\n`]*)\n(.*?)(?:^[ \t]*\1[ \t]*$|\Z)")
_SIGN = re.compile(r"(?m)^#(?:   | |$)")
_OUT = re.compile(r"\AOut ?\[[ \d*]*\]:[ \t]*\n?")
#: Fences without a language or named one of these hold output, not code.
PLAIN_FENCES = {"", "text", "txt", "output", "html", "json", "console", "none", "plain"}


def _joined(x: object) -> str:
    return "".join(map(str, x)) if isinstance(x, list) else x if isinstance(x, str) else ""


def _json_units(text: str) -> list[str] | None:
    try:
        book = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(book, dict) or not isinstance(book.get("cells"), list):
        return []
    out = []
    for cell in book["cells"]:
        if not isinstance(cell, dict):
            continue
        if cell.get("cell_type") != "code":
            out.append(_joined(cell.get("source")))
        for o in cell.get("outputs") or []:
            if isinstance(o, dict):
                data = o.get("data") if isinstance(o.get("data"), dict) else {}
                out += [_joined(o.get("text")), *[_joined(v) for k, v in data.items() if k.startswith("text/")]]
    return out


def _scanned_units(text: str) -> list[str]:
    """Of a JSON notebook that is cut off or broken."""
    out, found = [], list(_SCAN.finditer(text))
    kind = ""
    for m in found:
        if m[1]:
            kind = m[1]
        elif m[2] != "source" or kind != "code":
            parts = _STRING.findall(m[3])
            out.append("".join(parts).replace("\\n", "\n").replace('\\"', '"').replace("\\\\", "\\"))
    return out


def _paragraphs(text: str) -> list[str]:
    return _BLANK.split(text)


def units(text: str, with_code: bool = True) -> list[str]:
    """The whole text first, then its text and output units; blank ones are left out.

    ``with_code=False`` leaves out the whole of a text that has code.
    """
    text = text.lstrip("﻿").replace("\r\n", "\n")
    if not text.strip():
        return []
    if text.lstrip().startswith("{") and ('"cells"' in text or '"cell_type"' in text):
        parts = _json_units(text)
        if parts is None:
            parts = _scanned_units(text)
        whole: list[str] = []
    elif _MARK.search(text):
        whole, parts, at, mark, code = [_SIGN.sub("", _MARK.sub("", text))], [], 0, "", False
        for m in [*_MARK.finditer(text), None]:
            body = text[at : m.start() if m else len(text)]
            if mark == "" or "markdown" in mark or mark.startswith("# +") or "raw" in mark:
                parts += [_SIGN.sub("", body)]
            elif body.strip():
                code = True
            if m:
                mark, at = m[0], m.end()
        whole = [] if code and not with_code else whole
    elif "```" in text or "~~~" in text:
        whole, parts, at = [text], [], 0
        for m in _FENCE.finditer(text):
            parts += _paragraphs(text[at : m.start()])
            if m[2].strip().lower() in PLAIN_FENCES:
                parts.append(m[3])
            elif not with_code:
                whole = []
            at = m.end()
        parts += _paragraphs(text[at:])
    else:
        whole, parts = [text], []
        for p in _paragraphs(text):
            s = p.lstrip("\n")
            if s.startswith("Out"):
                parts.append(_OUT.sub("", s))
            elif not s.startswith(("In [", "In[")):
                parts.append(p)
            elif not with_code:
                whole = []
    return [u for u in [*whole, *parts] if u and not u.isspace()]
