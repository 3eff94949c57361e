"""The first JSON object in a text, by one pass over it."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r'[ \t\n\r]*(?:(?P<text>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+")'
    r"|(?P<plain>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)"
    r"|(?P<mark>[{}\[\],:]))")


def _objects(text: str, start: int) -> dict[int, int | None]:
    """Objects met while reading the one at ``start``, up to its end or the first error: start to end, None if it has none."""
    met: dict[int, int | None] = {}
    open_at: list[int] = []  # starts of open objects, -1 for arrays
    need, at = "value", start
    while token := _TOKEN.match(text, at):
        at, kind = token.end(), token.lastgroup
        mark = token["mark"] if kind == "mark" else kind
        if mark in ("}", "]"):
            first, closes = ("key or end", open_at[-1] >= 0) if mark == "}" else ("value or end", open_at[-1] < 0)
            if not closes or need not in (first, "comma or end"):
                break
            begun = open_at.pop()
            if begun >= 0:
                met[begun] = at
            if not open_at:
                break
            need = "comma or end"
        elif need in ("value", "value or end") and mark in ("{", "[", "text", "plain"):
            if mark == "{":
                met[at - 1] = None
                open_at.append(at - 1)
                need = "key or end"
            elif mark == "[":
                open_at.append(-1)
                need = "value or end"
            else:
                need = "comma or end"
        elif need in ("key", "key or end") and mark == "text":
            need = "colon"
        elif need == "colon" and mark == ":":
            need = "value"
        elif need == "comma or end" and mark == ",":
            need = "key" if open_at[-1] >= 0 else "value"
        else:
            break
    return met


def first_object(text: str | None) -> str | None:
    """The object that begins at the earliest possible brace of ``text``; NULL when there is none.

    Reading on from a brace inside a value gives what the outer reading found,
    so no stretch is read again for it: braces without end take linear time,
    however deep. Only a brace inside a string starts a reading of its own.
    """
    met: dict[int, int | None] = {}
    at = (text or "").find("{")
    while at >= 0:
        if at not in met:
            met |= _objects(text, at)
        if (end := met.pop(at)) is not None:
            return text[at:end]
        at = text.find("{", at + 1)
    return None
