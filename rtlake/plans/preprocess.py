"""Preprocessing of one compilation unit: directives, conditionals, includes, macros, source map.

Order within a unit is state, so a unit is the grain of parallel work: ``preprocessed`` runs units side by side.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from rtlake.functions.code import clean_doc

#: Directives that only set metadata (fixed names of the language).
METADATA = {"timescale", "default_nettype", "celldefine", "endcelldefine", "resetall", "unconnected_drive", "nounconnected_drive", "pragma", "line", "begin_keywords", "end_keywords"}
#: Bounds of nesting: includes, times that a file may be open at once, expansions.
INCLUDE_DEPTH, FILE_TWICE, EXPANSION_DEPTH = 16, 2, 32
_DIRECTIVE = re.compile(r"[ \t]*`(\w+)(.*)", re.S)
_NAME = re.compile(r"[A-Za-z_][\w$]*")
_LEAF = re.compile(r'"(?:\\.|[^"\\])*"?|//.*|/\*.*?(?:\*/|\Z)|`(?:[A-Za-z_][\w$]*)|.', re.S)
UNIT = (
    "unit string, lines array<struct<text: string, file: string, line: int, shifts: array<struct<output_col: int, delta: int>>>>,"
    "macros array<struct<name: string, body: string, line: int, col: int, file: string, is_function_like: boolean, params: array<struct<name: string, `default`: string>>, doc: string>>,"
    "sites array<struct<file: string, includer: string, line: int, col: int, end_col: int>>,"
    "directives array<struct<name: string, from_file: string, resolved: string>>,"
    "metadata array<struct<kind: string, value: string, file: string, line: int>>,"
    "errors array<struct<file: string, line: int, col: int, message: string>>"
)


@dataclass
class Macro:
    body: str
    params: list[tuple[str, str | None]] | None = None


def arguments(text: str, at: int) -> tuple[list[str], int] | None:
    """Arguments of the call whose ``(`` is at ``at`` and the offset behind its ``)``; None while it is open. ``()`` has none."""
    depth, parts, begin, i = 0, [], at + 1, at
    while i < len(text):
        m = re.compile(r'"(?:\\.|[^"\\])*"').match(text, i)
        if m:
            i = m.end()
            continue
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                parts.append(text[begin:i].strip())
                return ([] if parts == [""] else parts), i + 1
        elif c == "," and depth == 1:
            parts.append(text[begin:i].strip())
            begin = i + 1
        i += 1
    return None


def substituted(body: str, values: dict[str, str]) -> str:
    """A macro body with parameters put in, quotes made and tokens pasted."""
    out = []
    for m in re.finditer(r'`\\`"|`"|\s*``\s*|"(?:\\.|[^"\\])*"|[A-Za-z_][\w$]*|.', body, re.S):
        t = m[0]
        out.append('\\"' if t == '`\\`"' else '"' if t == '`"' else "" if t.strip() == "``" else values.get(t, t))
    return "".join(out)


def _without_comments(text: str) -> str:
    """Without line comments; what looks like one within a string is text."""
    return re.sub(r'("(?:[^"\\\n]|\\.)*")|//[^\n]*', lambda m: m[1] or "", text)


@dataclass
class Preprocessor:
    """Runs over one unit. ``files``: texts by path; nothing is read from disk."""

    files: dict[str, str]
    include_dirs: Sequence[str] = ()
    defines: dict[str, str] = field(default_factory=dict)
    preincludes: Sequence[str] = ()

    def run(self, unit: str) -> dict:
        self.macros = {k: Macro(v) for k, v in self.defines.items()}
        self.out: dict[str, list] = {k: [] for k in ("lines", "macros", "sites", "directives", "metadata", "errors")}
        self.stack: list[list] = []  # [taken before, active, file, line] of open conditionals
        self.open_files: list[str] = []
        for path in self.preincludes:
            self._file(path)
        self._file(unit)
        if self.stack:
            *_, file, line = self.stack[0]
            self._error(file, line, 0, "unterminated conditional")
        return {"unit": unit, **self.out}

    def _error(self, file: str, line: int, col: int, message: str) -> None:
        self.out["errors"].append({"file": file, "line": line, "col": col, "message": message})

    @property
    def active(self) -> bool:
        return all(level[1] for level in self.stack)

    def resolve(self, name: str, includer: str) -> str:
        """Absolute as it is; else beside the includer, then the include directories in order; empty when nowhere."""
        places = [name] if name.startswith("/") else [posixpath.normpath(posixpath.join(d, name)) for d in (posixpath.dirname(includer), *self.include_dirs)]
        return next((p for p in places if p in self.files), "")

    def _emit(self, text: str, file: str, line: int, shifts: list[tuple[int, int]] = ()) -> None:
        self.out["lines"].append({"text": text, "file": file, "line": line, "shifts": [{"output_col": a, "delta": b} for a, b in shifts]})

    def _file(self, path: str) -> None:
        self.open_files.append(path)
        lines, i, comment = self.files[path].split("\n"), 0, False
        while i < len(lines):
            raw, first = lines[i].rstrip("\r"), i
            m = None if comment else _DIRECTIVE.match(raw)
            word = m[1] if m else ""
            if word == "define":
                while raw.endswith("\\") and i + 1 < len(lines):
                    i += 1
                    raw = raw[:-1] + "\n" + lines[i].rstrip("\r")
                if self.active:
                    self._define(raw, path, first, lines)
                text, shifts = "", []
            elif word in ("ifdef", "ifndef", "elsif", "else", "endif"):
                self._conditional(word, m[2].split("//")[0].split(), path, first + 1)
                text, shifts = "", []
            elif not self.active:
                text, shifts = "", []
            elif word == "include":
                self._include(m[2], raw, path, first + 1)
                text, shifts = "", []
            elif word in METADATA:
                self.out["metadata"].append({"kind": word, "value": m[2].split("//")[0].strip(), "file": path, "line": first + 1})
                text, shifts = "", []
            elif word in ("undef", "undefineall"):
                names = m[2].split()[:1] if word == "undef" else list(self.macros)
                for n in names:
                    self.macros.pop(n, None)
                text, shifts = "", []
            else:
                while not comment and i + 1 < len(lines) and self._is_open(raw):
                    i += 1
                    raw += " " + lines[i].rstrip("\r").lstrip()
                begin = "/*" if comment else ""
                text, shifts = self.expanded(begin + raw, path, first + 1)
                text = text[len(begin) :]
                plain = re.sub(r'"(?:\\.|[^"\\])*"|//.*|/\*.*?\*/', "", begin + raw)
                comment = "/*" in plain
            self._emit(text, path, first + 1, shifts)
            for k in range(first + 1, i + 1):
                self._emit("", path, k + 1)
            i += 1
        self.open_files.pop()

    def _conditional(self, word: str, args: list[str], path: str, line: int) -> None:
        if word in ("ifdef", "ifndef"):
            holds = bool(args) and (args[0] in self.macros) == (word == "ifdef")
            self.stack.append([holds, holds, path, line])
        elif not self.stack:
            self._error(path, line, 0, f"`{word} without `ifdef")
        elif word == "endif":
            self.stack.pop()
        else:
            level = self.stack[-1]
            level[1] = not level[0] and (word == "else" or (bool(args) and args[0] in self.macros))
            level[0] = level[0] or level[1]

    def _define(self, raw: str, path: str, at: int, lines: list[str]) -> None:
        m = re.match(r"[ \t]*`define[ \t]+([A-Za-z_][\w$]*)", raw)
        if not m:
            return self._error(path, at + 1, 0, "`define without a name")
        rest, params = raw[m.end() :], None
        if rest.startswith("("):
            found = arguments(rest, 0)
            if found is None:
                return self._error(path, at + 1, m.end(), "`define with an open parameter list")
            params = [(n.strip(), d.strip() if eq else None) for n, eq, d in (p.partition("=") for p in found[0])]
            rest = rest[found[1] :]
        body = _without_comments(rest).strip()
        self.macros[m[1]] = Macro(body, params)
        above, k = [], at - 1
        while k >= 0 and lines[k].lstrip().startswith(("//", "*", "/*")):
            above.insert(0, lines[k])
            k -= 1
        self.out["macros"].append(
            {"name": m[1], "body": body, "line": at + 1, "col": m.start(1), "file": path, "is_function_like": params is not None, "params": [{"name": n, "default": d} for n, d in params or []], "doc": clean_doc("\n".join(above))}
        )

    def _include(self, rest: str, raw: str, path: str, line: int) -> None:
        name, _ = self.expanded(_without_comments(rest).strip(), path, line)
        m = re.match(r'"([^"]+)"|<([^>]+)>', name.strip())
        target = self.resolve(m[1] or m[2], path) if m else ""
        if m and not any(d["name"] == (m[1] or m[2]) and d["from_file"] == path for d in self.out["directives"]):
            self.out["directives"].append({"name": m[1] or m[2], "from_file": path, "resolved": target})
        col = len(raw) - len(raw.lstrip())
        if not target:
            self._error(path, line, col, f"include file not found: {(m[1] or m[2]) if m else rest.strip()}")
        elif len(self.open_files) >= INCLUDE_DEPTH or self.open_files.count(target) >= FILE_TWICE:
            self._error(path, line, col, f"include too deep: {target}")
        else:
            if not any(s["file"] == target and s["includer"] == path for s in self.out["sites"]):
                self.out["sites"].append({"file": target, "includer": path, "line": line, "col": col, "end_col": len(raw.rstrip())})
            self._file(target)

    def _is_open(self, text: str) -> bool:
        for m in _LEAF.finditer(text):
            macro = self.macros.get(m[0][1:]) if m[0].startswith("`") else None
            if macro and macro.params is not None:
                rest = text[m.end() :]
                if rest.lstrip(" \t").startswith("(") and arguments(rest, rest.index("(")) is None:
                    return True
        return False

    def expanded(self, text: str, path: str, line: int, depth: int = 0) -> tuple[str, list[tuple[int, int]]]:
        """The text with macros expanded, and (output column, distance to the original column) after each expansion."""
        out, shifts, at, size = [], [], 0, 0

        def put(t: str) -> None:
            nonlocal size
            out.append(t)
            size += len(t)

        while at < len(text):
            m = _LEAF.match(text, at)
            t, at = m[0], m.end()
            name = t[1:] if t.startswith("`") and len(t) > 1 else ""
            if not name:
                put(t)
                continue
            if name in ("__FILE__", "__LINE__"):
                put(f'"{path}"' if name == "__FILE__" else str(line))
            elif name not in self.macros:
                put(t)
                if name not in METADATA:
                    self._error(path, line, m.start(), f"undefined macro `{name}")
                continue
            elif depth >= EXPANSION_DEPTH:
                self._error(path, line, m.start(), f"macro `{name} nests too deep")
            else:
                put(self._call(name, text, at, path, line, depth, found := []))
                at = found[0]
            shifts.append((size, at - size))
        return "".join(out), shifts

    def _call(self, name: str, text: str, at: int, path: str, line: int, depth: int, end: list[int]) -> str:
        macro, values = self.macros[name], {}
        end.append(at)
        if macro.params is not None:
            m = re.compile(r"[ \t]*\(").match(text, at)
            found = arguments(text, m.end() - 1) if m else None
            if found is None:
                self._error(path, line, at, f"macro `{name} needs arguments")
                return ""
            given, end[0] = found
            if len(given) > len(macro.params):
                self._error(path, line, at, f"macro `{name} takes {len(macro.params)} arguments, not {len(given)}")
            for k, (param, default) in enumerate(macro.params):
                value = given[k] if k < len(given) else None
                if value is None and default is None and not (len(macro.params) == 1 and not given):
                    self._error(path, line, at, f"macro `{name} lacks an argument for {param}")
                values[param] = self.expanded(value or default or "", path, line, depth + 1)[0]
        return self.expanded(self._inside(substituted(macro.body, values)), path, line, depth + 1)[0]

    def _inside(self, body: str) -> str:
        """Conditionals inside a macro body, decided at each use; each directive becomes a blank."""
        if "`if" not in body:
            return body
        out, stack = [], []
        for m in re.finditer(r"`(ifdef|ifndef|elsif)\s+(\w+)|`(else|endif)\b|.", body, re.S):
            word, known = m[1] or m[3], m[2] in self.macros if m[2] else True
            if word in ("ifdef", "ifndef"):
                stack.append([known == (word == "ifdef")] * 2)
            elif word == "endif" and stack:
                stack.pop()
            elif word and stack:
                now = not stack[-1][0] and known
                stack[-1] = [stack[-1][0] or now, now]
            if word:
                out.append(" ")
            elif all(s[1] for s in stack):
                out.append(m[0])
        return "".join(out)


def preprocessed(sent: DataFrame, include_dirs: Sequence[str] = (), defines: dict[str, str] | None = None, preincludes: Sequence[str] = ()) -> DataFrame:
    """One row for each unit with its output lines, macros, include sites, directives, metadata and errors.

    ``sent``: (unit, path, text) of the files that each unit may read; a unit's texts meet in one task, and no others.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(UNIT))

    def run(group: pa.Table) -> pa.Table:
        texts = {p: t for p, t in zip(group["path"].to_pylist(), group["text"].to_pylist(), strict=True) if t is not None}
        return pa.Table.from_pylist([Preprocessor(texts, tuple(include_dirs), dict(defines or {}), tuple(preincludes)).run(group["unit"][0].as_py())], schema=schema)

    return sent.select("unit", "path", "text").groupBy("unit").applyInArrow(run, UNIT)
