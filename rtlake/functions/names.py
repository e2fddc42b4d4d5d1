"""Names and places as a client shows them: kinds, ranges, details, macro names and signatures."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rtlake.functions.code import blanked

# The client's kind of a declaration of each kind; all others are a Variable.
SYMBOL_KINDS = {
    "Module": "Module", "Interface": "Interface", "Package": "Package", "Class": "Class", "Function": "Function", "Task": "Method",
    "Port": "Field", "Parameter": "Constant", "Macro": "Constant", "Typedef": "TypeParameter", "EnumLiteral": "EnumMember", "Member": "Field",
    "Block": "Namespace", "Instance": "Object", "Modport": "Interface", "Clocking": "Event", "TypeParameter": "TypeParameter",
    "Covergroup": "Class", "Sequence": "Function", "Property": "Function", "Let": "Function", "Checker": "Module",
}
# Those of completion that differ.
COMPLETION_KINDS = SYMBOL_KINDS | {"Package": "Module", "Task": "Function", "Macro": "Keyword", "Block": "Module", "Instance": "Module"}
# Directives of the language, and those whose first operand is a macro's name.
DIRECTIVES = (
    "begin_keywords", "celldefine", "default_nettype", "define", "else", "elsif", "end_keywords", "endcelldefine", "endif", "ifdef", "ifndef",
    "include", "line", "nounconnected_drive", "pragma", "resetall", "timescale", "unconnected_drive", "undef", "undefineall", "__FILE__", "__LINE__",
)
NAME_TAKING = ("define", "undef", "ifdef", "ifndef", "elsif")
#: Parts a parameter's direction and type from its default.
DEFAULT_SEPARATOR = "\x1f"
_MACRO_NAME = re.compile(r"^[ \t]*`(?:" + "|".join(NAME_TAKING) + r")[ \t]+([A-Za-z_][\w$]*)|`([A-Za-z_][\w$]*)", re.M)


def _mapped(kind: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("Variable"))


def symbol_kind(kind: Column) -> Column:
    return _mapped(kind, SYMBOL_KINDS)


def completion_kind(kind: Column) -> Column:
    return _mapped(kind, COMPLETION_KINDS)


def name_range(line: Column, col: Column, length: Column) -> Column:
    """The range of a name from a line counted from 1 and a column counted from 0."""
    place = lambda c: F.struct((line - 1).alias("line"), c.alias("character"))
    return F.struct(place(col).alias("start"), place(col + length).alias("end"))


def problem_range(line: Column, col: Column, end_col: Column) -> Column:
    """The range of a diagnostic: up to its end column, or one character where it has none."""
    return name_range(line, col, F.when(end_col > col, end_col - col).otherwise(1))


def severity(level: Column) -> Column:
    return F.when(level == 3, "Information").when(level == 2, "Warning").otherwise("Error")


def display_detail(kind: Column, detail: Column) -> Column:
    """A detail as shown: of a port without the sign that parts its default."""
    return F.when(kind == "Port", F.replace(detail, F.lit(DEFAULT_SEPARATOR), F.lit(""))).otherwise(detail)


def value_type(detail: Column) -> Column:
    """The type of a port's value: its detail without direction, net kind and default."""
    own = F.substring_index(detail, DEFAULT_SEPARATOR, 1)
    return F.trim(F.regexp_replace(own, r"\b(const|input|output|inout|ref|var|static|wire|tri|tri0|tri1|wand|wor|uwire|supply0|supply1)\b *", ""))


def block_comment_end(text: Column) -> Column:
    """Offset behind the first end of a block comment; null where there is none."""
    at = F.locate("*/", text)
    return F.when(at > 0, at + 1)


def is_directive(word: Column) -> Column:
    return word.isin(*DIRECTIVES)


def takes_macro_name(word: Column) -> Column:
    return word.isin(*NAME_TAKING)


def macro_signature(name: Column, is_function_like: Column, params: Column) -> Column:
    """A macro as shown: its name behind a backtick, and the parameters with their defaults."""
    shown = F.transform(params, lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(" = "), p["default"]), F.lit(""))))
    return F.concat(F.lit("`"), name, F.when(is_function_like, F.concat(F.lit("("), F.array_join(shown, ", "), F.lit(")"))).otherwise(""))


def macro_names(text: str) -> list[tuple[str, int]]:
    """(name, offset) of macro names outside comments and strings: uses, and the operands of directives that take one."""
    found = []
    for m in _MACRO_NAME.finditer(blanked(text)):
        k = 1 if m[1] else 2
        if k == 1 or m[2] not in DIRECTIVES:
            found.append((m[k], m.start(k)))
    return found


def macro_name_at(text: str, at: int) -> str | None:
    """The macro name that holds offset ``at``, or whose backtick is there."""
    return next((n for n, i in macro_names(text) if i <= at < i + len(n) or (at == i - 1 and text[at] == "`")), None)


# Details of forward typedefs, the words that stand before the name; "type" where there are none.
FORWARD = ("class", "interface class", "enum", "struct", "union", "type")


def is_forward(kind: Column, detail: Column) -> Column:
    """Whether a row is a forward typedef, whose detail is only a keyword. A type with a body has none, or its type's name."""
    return (kind == "Typedef") & detail.isin(*FORWARD)
