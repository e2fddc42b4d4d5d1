"""Declarations of preprocessed text: a recursive descent over tokens that knows declarations and skips expressions.

Records have the columns of ``ROW``; scopes are texts joined by ``::``, unnamed blocks are ``@line.col``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from rtlake.functions.code import clean_doc
from rtlake.functions.names import FORWARD

ROW = "kind string, name string, line int, col int, parent string, detail string, end_line int, end_col int, scope string, file string, doc string, access string"
IMPORT = "pkg_name string, item string, line int, file string, is_export boolean, scope string, col int, pkg_col int"
INSTANCE = "type_name string, inst_name string, line int, file string, conditional boolean"
CALL = "callee string, qualifier string, args array<struct<kind: string, name: string>>, line int, col int, file string"
TYPE_REF = "name string, qualifier string, line int, col int, file string"
ERROR = "line int, col int, message string, file string"
_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"|`?[A-Za-z_][\w$]*|\$[A-Za-z_][\w$]*|\\\S+|[0-9][\w.\']*|\'[bodhBODH][\w]*|::|\(\*|\*\)|[^\w\s]', re.S)
UNITS = {"module": ("Module", "endmodule"), "macromodule": ("Module", "endmodule"), "interface": ("Interface", "endinterface"), "program": ("Program", "endprogram"), "package": ("Package", "endpackage"), "checker": ("Checker", "endchecker")}
BLOCKS = {"covergroup": ("Covergroup", "endgroup"), "property": ("Property", "endproperty"), "sequence": ("Sequence", "endsequence"), "clocking": ("Clocking", "endclocking")}
DIRECTIONS = ("input", "output", "inout", "ref")
QUALIFIERS = {"static", "automatic", "virtual", "local", "protected", "pure", "extern", "const", "rand", "randc", "var", "default", "global", "ref", "input", "output", "inout", "forkjoin", "context"}
NETS = {"wire", "tri", "tri0", "tri1", "wand", "wor", "triand", "trior", "trireg", "supply0", "supply1", "uwire"}
BASIC = {"logic", "bit", "reg", "byte", "shortint", "int", "longint", "integer", "time", "real", "realtime", "shortreal", "string", "event", "chandle", "void", "genvar", "signed", "unsigned"}
STATEMENTS = {"if", "else", "case", "casex", "casez", "for", "foreach", "while", "repeat", "forever", "do", "always", "always_comb", "always_ff", "always_latch", "initial", "final", "return", "break", "continue", "assign", "deassign", "force", "release", "wait", "disable", "assert", "assume", "cover", "fork", "begin", "end", "join", "join_any", "join_none", "endcase", "generate", "endgenerate", "unique", "unique0", "priority", "randcase", "expect", "bind", "defparam", "timeunit", "timeprecision", "constraint", "specify", "default"}


class Token(NamedTuple):
    text: str
    line: int
    col: int


@dataclass
class Declared:
    rows: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    instances: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    type_refs: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)


class Parser:
    """Reads one text; ``declared`` is what it found."""

    def __init__(self, text: str, file: str):
        self.file, self.out, self.tokens, self.comments = file, Declared(), [], {}
        line, begin, last = 1, 0, 0
        for m in _TOKEN.finditer(text):
            newlines = text.count("\n", last, m.start())
            if newlines:
                line, begin = line + newlines, text.rindex("\n", 0, m.start()) + 1
            last = m.start()
            t = Token(m[0], line, m.start() - begin)
            if m[0].startswith(("//", "/*")):
                for k in range(m[0].count("\n") + 1):
                    self.comments[line + k] = (line, m[0])
            elif m[0] not in ("(*", "*)"):
                self.tokens.append(t)
        self.at, self.conditional, self.direction, self.directions = 0, 0, "", {}

    @property
    def here(self) -> Token:
        return self.tokens[self.at] if self.at < len(self.tokens) else Token("", self.tokens[-1].line if self.tokens else 1, 0)

    def peek(self, n: int = 1) -> str:
        return self.tokens[self.at + n].text if self.at + n < len(self.tokens) else ""

    def next(self) -> Token:
        t = self.here
        self.at += 1
        return t

    def name_here(self) -> bool:
        return bool(re.fullmatch(r"[A-Za-z_][\w$]*|\\\S+", self.here.text)) and self.here.text not in STATEMENTS

    def skip(self, opened: str) -> list[Token]:
        """What a bracket at the current token holds, both brackets left out."""
        close, depth, begin = {"(": ")", "[": "]", "{": "}"}[opened], 0, self.at + 1
        while self.at < len(self.tokens):
            t = self.next().text
            depth += (t == opened) - (t == close)
            if not depth:
                break
        return self.tokens[begin : self.at - 1]

    def until(self, *ends: str) -> list[Token]:
        """Tokens up to one of ``ends`` outside brackets, which stays."""
        begin, depth = self.at, 0
        while self.at < len(self.tokens):
            t = self.here.text
            if not depth and t in ends:
                break
            depth += (t in "([{") - (t in ")]}")
            if depth < 0:
                break
            self.at += 1
        return self.tokens[begin : self.at]

    def doc(self, line: int) -> str:
        """The comment block that ends on the line above a declaration, else the comment behind it."""
        parts, k = [], line - 1
        while k in self.comments:
            begin, text = self.comments[k]
            parts.insert(0, text)
            k = begin - 1
        if not parts and line in self.comments and self.comments[line][0] == line:
            parts = [self.comments[line][1]]
        return clean_doc("\n".join(parts)) if parts else ""

    def row(self, kind: str, t: Token, scope: str, detail: str = "", access: str = "", name: str | None = None) -> dict:
        name = name or t.text
        found = {"kind": kind, "name": name, "line": t.line, "col": t.col, "parent": scope.rpartition("::")[2], "detail": detail, "end_line": 0, "end_col": 0, "scope": scope, "file": self.file, "doc": self.doc(t.line), "access": access}
        self.out.rows.append(found)
        return found

    def parse(self) -> Declared:
        while self.at < len(self.tokens):
            before = self.at
            self.items("", ())
            if self.at == before or self.at < len(self.tokens):
                t = self.next()
                if t.text.startswith("end") or t.text.startswith("join"):
                    self.out.errors.append({"line": t.line, "col": t.col, "message": f"unexpected '{t.text}'", "file": self.file})
        return self.out

    def close(self, row: dict | None, end: str) -> None:
        """Consumes the end keyword, with its label."""
        t = self.here
        if t.text != end:
            self.out.errors.append({"line": t.line, "col": t.col, "message": f"missing '{end}'", "file": self.file})
            return
        self.next()
        if row is not None:
            row["end_line"], row["end_col"] = t.line, t.col + len(end)
        if self.here.text == ":" and re.match(r"[A-Za-z_\\]", self.peek()):
            self.at += 2

    def items(self, scope: str, ends: tuple[str, ...], kind: str = "") -> None:
        """Declarations up to one of ``ends``, which stays; an end keyword of something else stops too."""
        while self.at < len(self.tokens) and self.here.text not in ends:
            t = self.here.text
            if re.fullmatch(r"end\w*|join\w*", t) and t not in ("endgenerate",):
                return
            begin = self.at
            self.item(scope, kind)
            if self.at == begin:
                self.next()

    def item(self, scope: str, kind: str) -> None:
        t = self.here
        if t.text == "(" or t.text == "[" or t.text == "{":
            self.skip(t.text)
        elif t.text in ("virtual", "extern") or t.text in QUALIFIERS or t.text in UNITS or t.text in BLOCKS or t.text in ("class", "function", "task", "import", "export"):
            self.declaration(scope, kind)
        elif t.text in ("typedef", "nettype", "enum", "struct", "union", "parameter", "localparam", "let", "modport", "genvar") or t.text in NETS or t.text in BASIC:
            self.declaration(scope, kind)
        elif t.text in STATEMENTS:
            self.statement(scope)
        elif self.name_here():
            self.named(scope, kind)
        elif t.text.startswith("$") and self.peek() == "(":
            self.next()
            self.skip("(")
        else:
            self.next()

    def declaration(self, scope: str, kind: str) -> None:
        words = []
        while self.here.text in QUALIFIERS and not (self.here.text == "default" and self.peek() in (":", "disable")):
            words.append(self.next().text)
            if words[-1] in ("import", "export"):
                break
        t, access = self.here.text, next((w for w in words if w in ("local", "protected")), "")
        self.direction = next((w for w in words if w in DIRECTIONS), "")
        if t == "interface" and self.peek() == "class":
            self.next()
            t = "class"
        if t in UNITS:
            self.unit(scope, *UNITS[t], prototype="extern" in words) if not ("virtual" in words) else self.variables(scope, access)
        elif t == "class":
            self.klass(scope)
        elif t in BLOCKS:
            self.block_of(scope, *BLOCKS[t])
        elif t in ("function", "task"):
            self.routine(scope, t, words, access)
        elif t in ("import", "export"):
            self.imports(scope, t)
        elif t in ("typedef", "nettype"):
            self.typedef(scope)
        elif t in ("parameter", "localparam"):
            self.next()
            self.parameters(scope, self.until(";"))
        elif t == "let":
            self.next()
            self.row("Let", self.here, scope)
            self.until(";")
        elif t == "modport":
            self.modport(scope)
        elif t == "genvar":
            self.next()
            for name in self.until(";"):
                if re.match(r"[A-Za-z_]", name.text):
                    self.row("Genvar", name, scope)
        elif t in NETS:
            self.variables(scope, access, "Net")
        elif t in STATEMENTS:
            self.statement(scope)
        elif words or t in BASIC or t in ("enum", "struct", "union"):
            self.variables(scope, access)

    def unit(self, scope: str, kind: str, end: str, prototype: bool = False) -> None:
        self.next()
        while self.here.text in ("static", "automatic"):
            self.next()
        name = self.next()
        row, inner = self.row(kind, name, scope), f"{scope}::{name.text}" if scope else name.text
        while self.here.text == "import":
            self.imports(inner, "import")
        if self.here.text == "#" and self.peek() == "(":
            self.next()
            self.parameters(inner, self.skip("("))
        if self.here.text == "(":
            self.ports(inner, self.skip("("), "Port")
        self.until(";")
        self.next()
        if not prototype:
            self.items(inner, (end,), kind)
            self._join_ports(inner)
            self.close(row, end)

    def _join_ports(self, scope: str) -> None:
        """Ports that a header only names are declared in the body: one row a port, at the header's place, with what the body says."""
        bare = {r["name"]: r for r in self.out.rows if r["scope"] == scope and r["kind"] == "Port" and not r["detail"]}
        for r in [r for r in self.out.rows if r["scope"] == scope and r["kind"] in ("Variable", "Net") and r["name"] in bare]:
            port = bare[r["name"]]
            said = self.directions.get((r["line"], r["col"]), "")
            port["detail"] = " ".join(x for x in (port["detail"] or said, r["detail"]) if x)
            port["doc"] = port["doc"] or r["doc"]
            self.out.rows.remove(r)

    def klass(self, scope: str) -> None:
        self.next()
        while self.here.text in ("static", "automatic"):
            self.next()
        name = self.next()
        row, inner = self.row("Class", name, scope), f"{scope}::{name.text}" if scope else name.text
        if self.here.text == "#" and self.peek() == "(":
            self.next()
            self.parameters(inner, self.skip("("))
        if self.here.text == "extends":
            self.next()
            parents = _split(self.until(";", "implements"))  # an interface class may have several; the first is kept
            row["detail"] = self.type_text(parents[0], scope) if parents else ""
        self.until(";")
        self.next()
        self.items(inner, ("endclass",), "Class")
        self.close(row, "endclass")

    def block_of(self, scope: str, kind: str, end: str) -> None:
        self.next()
        if not self.name_here():  # unnamed clocking and the like
            self.until(";", end)
            return
        name = self.next()
        row, inner = self.row(kind, name, scope), f"{scope}::{name.text}" if scope else name.text
        held = []
        while self.at < len(self.tokens) and self.here.text != end:
            t = self.next()
            if kind == "Clocking" and t.text in ("input", "output", "inout"):
                held += [x for x in self.until(";") if re.match(r"[A-Za-z_]", x.text)]
        if kind == "Clocking":
            row["detail"] = ", ".join(x.text for x in held)
            for x in held:
                self.row("Clockvar", x, inner)
        self.close(row, end)

    def routine(self, scope: str, word: str, words: list[str], access: str) -> None:
        self.next()
        while self.here.text in ("static", "automatic", "virtual"):
            self.next()
        head = self.until("(", ";")
        path = [head[-1]] if head else [self.here]
        k = len(head) - 1
        while k >= 2 and head[k - 1].text == "::":
            path.insert(0, head[k - 2])
            k -= 2
        outer = "::".join(p.text for p in path[:-1])
        name, inner = path[-1], "::".join(x for x in (scope, outer) if x)
        prototype = "extern" in words or "pure" in words
        kind = "Constructor" if name.text == "new" else "Function" if word == "function" else "Task"
        row = self.row(kind, name, inner, self.type_text(head[: max(k, 0)], scope) if word == "function" else "", access)
        row["prototype"] = prototype
        body = f"{inner}::{name.text}" if inner else name.text
        if self.here.text == "(":
            self.ports(body, self.skip("("), "Parameter")
        self.until(";")
        self.next()
        if not prototype and words[:1] != ["import"]:
            self.items(body, ("endfunction" if word == "function" else "endtask",), kind)
            self.close(row, "endfunction" if word == "function" else "endtask")

    def imports(self, scope: str, word: str) -> None:
        self.next()
        if self.here.text.startswith('"'):  # a foreign function
            self.until("function", "task", ";")
            if self.here.text in ("function", "task"):
                self.routine(scope, self.here.text, ["import", "extern"], "")
            return
        for part in _split(self.until(";")):
            if len(part) == 3 and part[1].text == "::":
                p, _, item = part
                self.out.imports.append({"pkg_name": p.text, "item": item.text, "line": item.line, "file": self.file, "is_export": word == "export", "scope": scope, "col": item.col, "pkg_col": p.col})
        self.next()

    def typedef(self, scope: str) -> None:
        self.next()
        body = self.until(";")
        self.next()
        if not body:
            return
        while body and body[-1].text == "]":  # dimensions behind the name
            depth = 0
            while body:
                t = body.pop().text
                depth += (t == "]") - (t == "[")
                if not depth:
                    break
        name, rest = body[-1], body[:-1]
        before = " ".join(t.text for t in rest) or "type"
        detail = before if before in FORWARD else "" if rest[0].text in ("enum", "struct", "union") else self.type_text(rest, scope)
        row = self.row("Typedef", name, scope, detail)
        row["end_line"] = self.tokens[self.at - 1].line
        self.members(scope, rest, name.text)

    def members(self, scope: str, body: list[Token], owner: str) -> None:
        """Literals of an enum and members of a struct or union in ``body``."""
        brace = next((i for i, t in enumerate(body) if t.text == "{"), None)
        if brace is None:
            return
        depth, end = 0, len(body)
        for i in range(brace, len(body)):
            depth += (body[i].text == "{") - (body[i].text == "}")
            if not depth:
                end = i
                break
        inside, word = body[brace + 1 : end], body[0].text
        if word == "enum":
            for part in _split(inside):
                self.row("EnumLiteral", part[0], scope, owner)
        elif word in ("struct", "union"):
            inner = f"{scope}::{owner}" if scope else owner
            for part in _split(inside, ";"):
                names = _split(part)
                nested = next((i for i, t in enumerate(names[0]) if t.text == "}"), None)
                name = _declarator(names[0])
                if name is None:
                    continue
                kind = names[0][: names[0].index(name)]
                for n in [name, *[x[0] for x in names[1:]]]:
                    self.row("Member", n, inner, self.type_text(kind, scope))
                    if nested is not None:
                        self.members(inner, kind, n.text)

    def parameters(self, scope: str, tokens: list[Token]) -> None:
        is_type = False
        for part in _split(tokens):
            while part and part[0].text in ("parameter", "localparam", "type"):
                is_type = part[0].text == "type"
                part = part[1:]
            left, default = _halves(part, "=")
            name = _declarator(left)
            if name is not None:
                kind = left[: left.index(name)]
                is_type = is_type and not kind
                value = _joined(default)
                self.row("TypeParameter" if is_type else "Parameter", name, scope, value if is_type else " ".join(x for x in (self.type_text(kind, scope), f"= {value}" if value else "") if x))

    def ports(self, scope: str, tokens: list[Token], kind: str) -> None:
        """Ports or parameters; direction and type carry over to those that name none."""
        direction = type_text = ""
        for part in _split(tokens):
            left, default = _halves(part, "=")
            name = _declarator(left)
            if name is None:
                continue
            before = left[: left.index(name)]
            way = next((t.text for t in before if t.text in ("input", "output", "inout", "ref")), "")
            kind_text = self.type_text([t for t in before if t.text not in ("input", "output", "inout", "ref", "const", "var")], scope)
            if way:
                direction, type_text = way, kind_text
            elif kind_text:
                type_text = kind_text
            shown = " ".join(x for x in (direction, type_text) if x)
            self.row(kind, name, scope, shown + (f"\x1f{_joined(default)}" if default else ""))

    def modport(self, scope: str) -> None:
        self.next()
        while self.name_here():
            name = self.next()
            held = [t for t in self.skip("(") if t.text not in QUALIFIERS and re.match(r"[A-Za-z_]", t.text) and t.text not in ("import", "export", "clocking", "task", "function")] if self.here.text == "(" else []
            self.row("Modport", name, scope, ", ".join(t.text for t in held))
            if self.here.text == ",":
                self.next()
        self.until(";")

    def variables(self, scope: str, access: str, kind: str = "Variable") -> None:
        tokens = self.until(";")
        parts = _split(tokens)
        self.scan(_halves(tokens, "=")[1])
        if self.here.text == ";":
            self.next()
        left, _ = _halves(parts[0], "=") if parts else ([], [])
        name = _declarator(left)
        if name is None:
            return
        direction, self.direction = self.direction, ""
        before = left[: left.index(name)]
        shown = self.type_text(before, scope)
        for part in [left[left.index(name) :], *parts[1:]]:
            if part and re.match(r"[A-Za-z_\\]", part[0].text):
                if direction:
                    self.directions[part[0].line, part[0].col] = direction
                self.row(kind, part[0], scope, _containers(_halves(part, "=")[0][1:]) + shown, access)
        self.members(scope, [t for t in before if t.text not in QUALIFIERS], name.text)

    def named(self, scope: str, kind: str) -> None:
        """Starts with a name: an instance, a variable of a named type, a call, an assignment or a labelled block."""
        begin, t = self.at, self.here
        if self.peek() == ":" and self.peek(2) in ("begin", "fork", "assert", "assume", "cover"):
            self.at += 2
            return self.statement(scope, label=t)
        self.next()
        path = [t]
        while self.here.text in ("::", ".") and re.match(r"[A-Za-z_]", self.peek()):
            self.at += 1
            path.append(self.next())
            if self.here.text == "#" and self.peek() == "(":
                self.next()
                self.skip("(")
        if self.here.text == "(":
            self.call(path, self.skip("("))
            return
        if self.here.text == "#":
            self.next()
            self.skip("(") if self.here.text == "(" else self.next()
            while self.here.text == "::" and re.match(r"[A-Za-z_]", self.peek()):
                self.at += 1
                path.append(self.next())
        while self.here.text == "[":
            self.skip("[")
        if not self.name_here():
            if self.here.text == ";":  # a statement that calls without parentheses
                self.call(path, [])
            if self.here.text in ("=", "<", "+", "-", "*", "/", "|", "&", "^"):
                self.scan(self.until(";", "end"))
            return
        after = self.at + 1
        while after < len(self.tokens) and self.tokens[after].text == "[":
            depth = 0
            while after < len(self.tokens):
                depth += (self.tokens[after].text == "[") - (self.tokens[after].text == "]")
                after += 1
                if not depth:
                    break
        if after < len(self.tokens) and self.tokens[after].text == "(" and kind in ("Module", "Interface", "Program", "Checker", "Generate"):
            while self.name_here():
                name = self.next()
                while self.here.text == "[":
                    self.skip("[")
                self.skip("(") if self.here.text == "(" else None
                self.row("Instance", name, scope, path[-1].text)
                self.out.instances.append({"type_name": path[-1].text, "inst_name": name.text, "line": name.line, "file": self.file, "conditional": self.conditional > 0})
                if self.here.text != ",":
                    break
                self.next()
            return
        self.out.type_refs.append({"name": path[-1].text, "qualifier": "::".join(p.text for p in path[:-1]), "line": path[-1].line, "col": path[-1].col, "file": self.file})
        self.at = begin
        self.variables(scope, "")

    def call(self, path: list[Token], inside: list[Token]) -> None:
        args = []
        for part in _split(inside) if inside else []:
            named = len(part) > 1 and part[0].text == "." and re.match(r"[A-Za-z_]", part[1].text)
            args.append({"kind": "named" if named else "positional" if part else "elided", "name": part[1].text if named else ""})
        self.out.calls.append({"callee": path[-1].text, "qualifier": "::".join(p.text for p in path[:-1]), "args": args, "line": path[0].line, "col": path[0].col, "file": self.file})
        self.scan(inside)

    def scan(self, tokens: list[Token]) -> None:
        """Records the calls in an expression; inner ones by way of their call's arguments."""
        i = 0
        while i < len(tokens):
            t = tokens[i]
            named = re.fullmatch(r"[A-Za-z_][\w$]*", t.text) and t.text not in STATEMENTS and i + 1 < len(tokens) and tokens[i + 1].text == "("
            if not named or (i and tokens[i - 1].text == "." and (i < 2 or tokens[i - 2].text in ",(")):
                i += 1
                continue
            begin = i
            while begin >= 2 and tokens[begin - 1].text in ("::", ".") and re.match(r"[A-Za-z_]", tokens[begin - 2].text):
                begin -= 2
            depth, end = 0, i + 1
            while end < len(tokens):
                depth += (tokens[end].text in "([{") - (tokens[end].text in ")]}")
                end += 1
                if not depth:
                    break
            self.call([x for x in tokens[begin : i + 1] if x.text not in ("::", ".")], tokens[i + 2 : end - 1])
            i = end

    def statement(self, scope: str, label: Token | None = None) -> None:
        t = self.next()
        if t.text in ("begin", "fork"):
            if self.here.text == ":":
                self.next()
                label = self.next()
            name = label.text if label else f"@{t.line}.{t.col}"
            inner, place = f"{scope}::{name}" if scope else name, len(self.out.rows)
            self.items(inner, ("end",) if t.text == "begin" else ("join", "join_any", "join_none"), "Generate" if self.conditional else "Block")
            row = None
            if label is not None or any(r["scope"] == inner for r in self.out.rows[place:]):
                row = self.row("Block", label or t, scope, name=name)
                self.out.rows.insert(place, self.out.rows.pop())
            self.close(row, "end" if t.text == "begin" else self.here.text if self.here.text.startswith("join") else "join")
        elif t.text in ("for", "foreach") and self.here.text == "(":
            head = self.skip("(")
            inner = f"{scope}::@{t.line}.{t.col}" if scope else f"@{t.line}.{t.col}"
            if t.text == "for":
                first = _split(head, ";")[0] if head else []
                left, _ = _halves(first, "=")
                name = _declarator(left)
                if name is not None and len(left) > 1:
                    self.row("Genvar" if left[0].text == "genvar" else "Variable", name, inner, self.type_text([x for x in left[:-1] if x.text != "genvar"], scope))
            else:
                at = next((i for i, x in enumerate(head) if x.text == "["), len(head))
                for x in head[at:]:
                    if re.match(r"[A-Za-z_]", x.text):
                        self.row("Variable", x, inner, "int")
            if self.here.text == "begin":
                self.statement(inner)
        elif t.text in ("if", "case", "casex", "casez"):
            if self.here.text == "(":
                self.scan(self.skip("("))
            self.conditional += 1
            if self.here.text == "begin":
                self.statement(scope)
            elif t.text != "if":
                self.items(scope, ("endcase",), "Generate")
                self.close(None, "endcase")
            elif self.here.text != ";":
                self.item(scope, "Generate")
            self.conditional -= 1
        elif t.text in ("assign", "defparam", "constraint", "timeunit", "timeprecision", "force", "release", "return", "bind", "disable"):
            if t.text == "constraint":
                self.until("{", ";")
                self.skip("{") if self.here.text == "{" else None
            else:
                self.scan(self.until(";"))
        elif self.here.text in ("(", "@", "#"):
            while self.here.text in ("@", "#", "*"):
                self.next()
            if self.here.text == "(":
                self.scan(self.skip("("))

    def type_text(self, tokens: list[Token], scope: str) -> str:
        """A type's text: qualifiers and parameter lists dropped, containers in front."""
        out, i, depth = [], 0, 0
        while i < len(tokens):
            t = tokens[i].text
            if t == "#" and i + 1 < len(tokens) and tokens[i + 1].text == "(":
                i += 1
                while i < len(tokens):
                    depth += (tokens[i].text == "(") - (tokens[i].text == ")")
                    i += 1
                    if not depth:
                        break
                continue
            if t in ("{",):
                break
            if t not in QUALIFIERS or t == "virtual":
                out.append(t)
            i += 1
        text = "".join(f" {x}" if k and re.match(r"[\w\[]", x) and re.match(r"[\w\]]", out[k - 1][-1]) else x for k, x in enumerate(out))
        return text.strip()


def _split(tokens: list[Token], separator: str = ",") -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        depth += (t.text in "([{") - (t.text in ")]}")
        if t.text == separator and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out if separator == "," else [x for x in out if x]


def _halves(tokens: list[Token], mark: str) -> tuple[list[Token], list[Token]]:
    depth = 0
    for i, t in enumerate(tokens):
        depth += (t.text in "([{") - (t.text in ")]}")
        if t.text == mark and not depth:
            return tokens[:i], tokens[i + 1 :]
    return tokens, []


def _declarator(tokens: list[Token]) -> Token | None:
    """The declared name: the last name outside brackets."""
    depth, found = 0, None
    for t in tokens:
        depth += (t.text in "([{") - (t.text in ")]}")
        if not depth and re.match(r"[A-Za-z_\\]", t.text) and t.text not in QUALIFIERS:
            found = t
    return found if found is None or found.text not in BASIC else None


def _joined(tokens: list[Token]) -> str:
    return "".join(f" {t.text}" if k and tokens[k - 1].line == t.line and tokens[k - 1].col + len(tokens[k - 1].text) < t.col else t.text for k, t in enumerate(tokens))


def _containers(tokens: list[Token]) -> str:
    """Tags of the dimensions behind a name, outermost first, each followed by a colon."""
    out, i = "", 0
    while i < len(tokens) and tokens[i].text == "[":
        depth, inside = 0, []
        while i < len(tokens):
            depth += (tokens[i].text == "[") - (tokens[i].text == "]")
            i += 1
            if not depth:
                break
            inside.append(tokens[i].text)
        inside = [x for x in inside if x != "]"]
        out += "queue:" if inside[:1] == ["$"] else "dynamic:" if not inside else "assoc:" if inside == ["*"] or (len(inside) == 1 and not inside[0][0].isdigit() and inside[0] in BASIC) else "array:"
    return out


def declared(text: str, file: str) -> Declared:
    return Parser(text, file).parse()
