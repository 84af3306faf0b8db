"""Selections typed by a user: plain functions for the driver."""

from __future__ import annotations

import re

from skeinwork.schemas import GraphError

_TOKEN = re.compile(r'((?:"[^"]*"|`[^`]*`|\[[^\]]*\]|[^."`\[\]])+)(\.|$)')


def split(name: str) -> list[str]:
    parts, at = [], 0
    while True:
        m = _TOKEN.match(name, at)
        if not m or not m[1].strip():
            raise GraphError(f"invalid identifier: {name!r}")
        parts.append(m[1].strip())
        at = m.end()
        if not m[2]:
            return parts


def part(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and (text[0], text[-1]) in {('"', '"'), ("`", "`"), ("[", "]")}:
        text = text[1:-1].strip()
    if not text or text == "*":
        raise GraphError("an identifier part is empty or a star")
    return text.lower()


def normal(name: str) -> str:
    return ".".join(map(part, split(name)))


def column_selection(text: str) -> str:
    """``column:a.b``, ``column.a.b`` or ``a.b`` -> id."""
    rest = re.sub(r"^column[:.]", "", text.strip())
    if len(split(rest)) < 2:
        raise GraphError(f"not a column: {text!r}")
    return "column:" + normal(rest)


def query_selection(text: str) -> str:
    return "query:" + normal(re.sub(r"^query[:.]", "", text.strip()))


def impact_selection(text: str) -> str:
    """``metric:x`` and ``query:x`` by prefix; anything else with a dot is a column."""
    text = text.strip()
    for kind in ("metric", "query"):
        if text.startswith(kind + ":"):
            return f"{kind}:{normal(text[len(kind) + 1 :])}"
    return column_selection(text)
