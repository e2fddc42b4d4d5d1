"""Functions of source text: comments and strings, occurrences, call context, documentation comments.

Plain Python over one text; jobs apply them to whole files in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_right

#: Comments and strings of a source text.
QUIET = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*(?:"|$)', re.S | re.M)
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")


def blanked(text: str) -> str:
    """The text with comments and strings blanked, offsets and line ends kept."""
    return QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def is_quiet(text: str, at: int) -> bool:
    """Whether an offset lies inside a comment or string."""
    return any(m.start() < at < m.end() or (at == m.end() and m[0].startswith("//")) for m in QUIET.finditer(text))


def occurrences(text: str, name: str | None = None) -> list[tuple[str, int, int]]:
    """(name, line from 1, column from 0) of identifiers outside comments and strings; macro uses and system tasks are none."""
    plain = blanked(text)
    starts = [0, *(m.end() for m in re.finditer("\n", plain))]
    out = []
    for m in NAME.finditer(plain):
        if (name is None or m[0] == name) and (m.start() == 0 or plain[m.start() - 1] not in "`$0123456789"):
            line = bisect_right(starts, m.start())
            out.append((m[0], line, m.start() - starts[line - 1]))
    return out


def receiver(text: str, at: int) -> list[str]:
    """Names of the chain ``a.b.c`` before the dot at which completion is asked, calls and indexes dropped; empty if there is none."""
    plain, i, names = blanked(text), at, []
    while True:
        i = len(plain[:i].rstrip())
        if not i or plain[i - 1] != ".":
            return names[::-1]
        i = len(plain[: i - 1].rstrip())
        while i and plain[i - 1] in ")]":
            depth, close = 0, plain[i - 1]
            opened = {")": "(", "]": "["}[close]
            while i:
                depth += (plain[i - 1] == close) - (plain[i - 1] == opened)
                i -= 1
                if not depth:
                    break
            i = len(plain[:i].rstrip())
        m = re.search(r"[A-Za-z_$][A-Za-z0-9_$]*\Z", plain[:i])
        if not m:
            return []
        names.append(m[0])
        i = m.start()


def call_at(text: str, at: int) -> tuple[str, int, str | None] | None:
    """(callee, argument number, name of the connection) of the innermost open parenthesis before an offset."""
    plain, depth, commas = blanked(text)[:at], 0, 0
    connection = None
    for i in range(len(plain) - 1, -1, -1):
        c = plain[i]
        if c in ")]}":
            depth += 1
        elif c in "[{" or (c == "(" and depth):
            depth -= 1
            if depth < 0:
                depth = 0
        elif c == "(":
            m = re.search(r"\.\s*([A-Za-z_][A-Za-z0-9_$]*)\s*\Z", plain[:i])
            if m and not re.search(r"[A-Za-z0-9_$)\]]\s*\Z", plain[: m.start()]):
                connection, commas = connection or m[1], 0  # a named connection: the call is further out
                continue
            m = re.search(r"([`$]?[A-Za-z_$][A-Za-z0-9_$]*(?:(?:\.|::)[A-Za-z_$][A-Za-z0-9_$]*)*)\s*\Z", plain[:i])
            return (m[1], commas, connection) if m else None
        elif c == "," and not depth:
            commas += 1
        elif c == ";" and not depth:
            return None
    return None


def clean_doc(comment: str) -> str:
    """A documentation comment's text: markers, gutters, rules and tag lines dropped, common indent and blank ends taken off."""
    lines = []
    for raw in comment.split("\n"):
        line = re.sub(r"^\s*(?://+!?|/\*+!?|\*+(?!/))?", "", re.sub(r"\*+/\s*$", "", raw)).rstrip()
        if re.fullmatch(r"\s*([-=*/#~+_])\1{2,}\s*", line) or re.match(r"\s*[@\\][A-Za-z]", line):
            continue
        lines.append(line)
    indent = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return re.sub(r"\A\n+|\n+\Z", "", "\n".join(x[indent:] for x in lines)).rstrip()


def mapped_column(shifts: list[tuple[int, int]], col: int) -> int:
    """The original column of an output column: the last shift at or before it counts."""
    i = bisect_right(shifts, (col, 1 << 60))
    return col + (shifts[i - 1][1] if i else 0)
