"""Help inside the parentheses of a call: of macros, headers of constructs, routines and units, and system tasks, in this order."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import functions as F

from rtlake.functions.builtins import KEYWORD_HEADERS, system_tasks
from rtlake.functions.code import blanked, call_at
from rtlake.operators import lookup
from rtlake.plans import requests
from rtlake.plans.requests import Index


@dataclass(frozen=True)
class Help:
    """A label, its parameters and the number of the one the cursor is in (none beyond the last)."""

    label: str
    parameters: tuple[str, ...]
    active: int | None

    @classmethod
    def of(cls, label: str, parameters: Sequence[str], slot: int) -> Help:
        return cls(label, tuple(parameters), slot if 0 <= slot < len(parameters) else None)


def open_parenthesis(plain: str, at: int) -> int | None:
    """The innermost parenthesis that is open at an offset of a blanked text."""
    depth = 0
    for i in range(min(at, len(plain)) - 1, -1, -1):
        if plain[i] in ")]}":
            depth += 1
        elif plain[i] in "([{":
            if not depth and plain[i] == "(":
                return i
            depth = max(0, depth - 1)
    return None


def top_level(plain: str, start: int, at: int, marks: str) -> int:
    """How many of ``marks`` stand between two offsets outside inner brackets."""
    depth = found = 0
    for c in plain[start:at]:
        found += c in marks and not depth
        depth += (c in "([{") - (c in ")]}")
    return found


def keyword_header(plain: str, parenthesis: int, at: int) -> Help | None:
    """Help in the header of a construct; one that names the word before it goes first (``assert property``)."""
    m = re.search(r"(?:([A-Za-z_$][\w$]*)\s+)?(?<![\w$])([A-Za-z_$][\w$]*)\s*\Z", plain[:parenthesis])
    if not m:
        return None
    name = next((n for n in (f"{m[1]} {m[2]}", m[2]) if n in KEYWORD_HEADERS), None)
    if name is None:
        return None
    inside = KEYWORD_HEADERS[name]
    if m := re.fullmatch(r"(\w+)\[(.*)\]", inside):
        return Help.of(f"{name} ({inside})", m.groups(), min(1, top_level(plain, parenthesis + 1, at, "[")))
    parts = inside.split("; ")
    return Help.of(f"{name}({inside})" if name == "randomize" else f"{name} ({inside})", parts, top_level(plain, parenthesis + 1, at, ";"))


def system_task(name: str, text: str, parenthesis: int, slot: int) -> Help | None:
    """Help for a system task: the last parameter takes all further ones if it is repeated, and an optional first one is left out before a format."""
    parameters = system_tasks().get(name)
    if parameters is None:
        return None
    if len(parameters) > 1 and parameters[0].startswith("[") and parameters[1] == "format" and text[parenthesis + 1 :].lstrip().startswith('"'):
        slot += 1
    if parameters and parameters[-1].rstrip("]").endswith("..."):
        slot = min(slot, len(parameters) - 1)
    return Help.of(f"{name}({', '.join(parameters)})", parameters, slot)


def macro(index: Index, name: str, file: str, line: int, slot: int) -> Help | None:
    """Help for a macro's call, of the definition that counts at the line; none unless it takes arguments."""
    row = requests.macro(index, name, file, line).select("is_function_like", "params").first()
    if row is None or not row["is_function_like"]:
        return None
    parameters = [p["name"] if p["default"] is None else f"{p['name']} = {p['default']}" for p in row["params"]]
    return Help.of(f"`{name}({', '.join(parameters)})", parameters, slot)


def help_at(index: Index, file: str, text: str, at: int) -> Help | None:
    """Help at an offset of a file's text, if it lies in parentheses that something known opens. A macro's call is never anything else."""
    plain = blanked(text)
    parenthesis = open_parenthesis(plain, at)
    if parenthesis is None:
        return None
    slot = top_level(plain, parenthesis + 1, at, ",")
    if m := re.search(r"`([A-Za-z_][\w$]*)\s*\Z", plain[:parenthesis]):
        return macro(index, m[1], file, text.count("\n", 0, at) + 1, slot)
    if found := keyword_header(plain, parenthesis, at):
        return found
    call = call_at(text, at)
    if call is None:
        return None
    callee, slot, connection = call
    *qualifier, name = re.split(r"::|\.", callee)
    begins = [m.start() for m in re.finditer(rf"(?<![\w$]){re.escape(name)}\s*\(", plain[:at])]
    unit = re.search(r"([A-Za-z_][\w$]*)\s*(?:#\s*\([^;]*\)\s*)?\Z", plain[: begins[-1]]) if begins and not qualifier else None
    asked = [(unit[1], requests.UNITS)] if unit else []
    for callee, kinds in (*asked, (name, requests.ROUTINES)):
        owners = lookup.exact(index["symbols"], "name", callee).filter(F.col("kind").isin(*kinds)).select("name", "scope", "file").distinct()
        rows = requests.signature(index, callee, qualifier[-1] if qualifier else "").join(F.broadcast(owners), ["name", "scope", "file"], "left_semi")
        row = rows.orderBy(F.desc(F.col("file") == file), "file", "scope").select("label", "parameters").first()
        if row is not None:
            names = [p.split(" ")[-1] for p in row["parameters"]]
            return Help.of(row["label"], row["parameters"], names.index(connection) if connection in names else slot)
    return system_task(name, text, parenthesis, slot) if not qualifier else None
