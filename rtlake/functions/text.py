"""Scalar functions as column expressions: they stay in the JVM and in generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "::"


def escape_like(text: Column, escape: str = "\\") -> Column:
    """A LIKE pattern that matches ``text`` literally."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(escape + c)), (escape, "%", "_"), text)


def scope_tail(scope: Column) -> Column:
    """What follows the last ``::``; all of it where there is none."""
    return F.substring_index(scope, SEPARATOR, -1)


def scope_parent(scope: Column) -> Column:
    """What precedes the last ``::``; empty where there is none."""
    return F.when(F.locate(SEPARATOR, scope) > 0, F.regexp_extract(scope, r"(?s)^(.*)::", 1)).otherwise("")


def display_scope(scope: Column) -> Column:
    """A scope without its unnamed segments, which begin with ``@``."""
    return F.array_join(F.filter(F.split(scope, SEPARATOR), lambda p: ~p.startswith("@")), SEPARATOR)


def type_layers(detail: Column) -> Column:
    """Layers of a type text, split at single colons only."""
    return F.split(detail, r"(?<!:):(?!:)")


def peel(detail: Column, n: Column | int) -> Column:
    """A type without its first ``n`` layers; empty where it has no more than that."""
    layers = type_layers(detail)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(F.size(layers) > n, F.array_join(F.slice(layers, n + 1, F.greatest(F.size(layers), F.lit(1))), ":")).otherwise("")


def split_keep(text: Column, separator: str) -> Column:
    """Parts between separators, empty ones kept."""
    return F.split(text, "\\Q" + separator + "\\E", -1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def trim_blank(text: Column) -> Column:
    """Without blanks and tabs at both ends."""
    return F.regexp_replace(text, r"^[ \t]+|[ \t]+$", "")


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Za-z_][A-Za-z0-9_$]*\z"), F.lit(False))


def is_separator(line: Column) -> Column:
    """Whether a comment line only draws a rule: three or more of one kind of mark."""
    return line.rlike(r"^\s*([-=*/#_~+])\1{2,}\s*$")


def is_tag(line: Column) -> Column:
    """Whether a comment line is an annotation: ``@word`` or ``\\word`` at its start."""
    return line.rlike(r"^\s*[@\\][A-Za-z]+")


def code_part(line: Column) -> Column:
    """A line up to its ``//``, where no string holds it."""
    return F.regexp_extract(line, r'^((?:[^"/]|/(?!/)|"(?:[^"\\]|\\.)*"?)*)', 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_$]*"), F.lit(0))


def word_at(text: Column, at: Column) -> Column:
    """The identifier that holds or touches code point ``at`` (from 0); empty if none."""
    left = F.regexp_extract(F.substring(text, F.lit(1), at), r"([A-Za-z0-9_$]*)\z", 1)
    right = F.regexp_extract(F.substring(text, at + 1, F.length(text)), r"\A([A-Za-z0-9_$]*)", 1)
    word = F.concat(left, right)
    return F.when(word.rlike(r"\A[0-9]"), "").otherwise(word)


def word_before(text: Column, at: Column) -> Column:
    """The identifier that ends at code point ``at``."""
    return F.regexp_extract(F.substring(text, F.lit(1), at), r"([A-Za-z_$][A-Za-z0-9_$]*)\z", 1)


def line_of(text: Column, at: Column) -> Column:
    """Line (from 0) and character of a code point offset, which is clipped to the text."""
    before = F.substring(text, F.lit(1), F.least(F.greatest(at, F.lit(0)), F.length(text)))
    return F.struct(F.regexp_count(before, F.lit("\n")).alias("line"), F.length(F.substring_index(before, "\n", -1)).alias("char"))


def offset_of(text: Column, line: Column, char: Column) -> Column:
    """Code point offset of a line (from 0) and character; null past the last line. A character past the line's end is its end."""
    lines = F.split(text, "\n")
    before = F.slice(lines, F.lit(1), line)
    start = F.aggregate(before, F.lit(0), lambda n, x: n + F.length(x) + 1)
    return F.when(line < F.size(lines), start + F.least(char, F.length(F.get(lines, line))))


def cut_bytes(text: Column, most: int) -> Column:
    """At most ``most`` UTF-8 bytes, never half a character; marked where something was cut."""
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(text), F.lit(most))), lambda k: F.octet_length(F.substring(text, F.lit(1), k)) <= most)
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, F.lit(1), F.array_max(fits)), F.lit("..."))).otherwise(text)


def rank_text(place: Column, width: int = 5) -> Column:
    return F.lpad(place.cast("string"), width, "0")


def doc_markdown(doc: Column) -> Column:
    """A comment as markdown: line breaks within a paragraph become hard breaks."""
    return F.regexp_replace(doc, r"(?<!\n)\n(?!\n)", "  \n")


def field(text: Column) -> Column:
    """A field with its length in front: concatenations of such fields are injective."""
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def boundary(text: Column, at: Column) -> Column:
    """Whether a word begins at character ``at`` (from 1): at the start, after a mark of ``_-.:``, or at a capital after a small letter or digit."""
    here, before = F.substring(text, at, F.lit(1)), F.substring(text, at - 1, F.lit(1))
    return (at == 1) | before.isin("_", "-", ".", ":") | (here.rlike("[A-Z]") & before.rlike("[a-z0-9]"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fuzzy_score(name: Column, pattern: Column) -> Column:
    """Greedy subsequence match, ASCII letters in either case; null without one, 0 for an empty pattern.

    Each character scores 10; 15 more right after the last one, 12 more at a word's start, 3 more in the same case; the
    characters skipped to reach it and, at the end, a tenth of the name's bytes are taken off (fixed values).
    """
    count = lambda x: F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)))
    chars = F.transform(count(name), lambda i: F.lower(F.substring(name, i, F.lit(1))))

    def places(cs: Column) -> Column:
        """0 and each pattern character's place: past the name's end from the first that is not found."""
        after = lambda last, p: last + F.array_position(F.concat(F.slice(cs, last + 1, F.size(cs)), F.array(p)), p).cast("int")
        return F.aggregate(count(pattern), F.array(F.lit(0)), lambda s, j: F.concat(s, F.array(after(F.element_at(s, -1), F.lower(F.substring(pattern, j, F.lit(1)))))))

    def gain(at: Column, last: Column, j: Column) -> Column:
        run = F.when((j > 1) & (at == last + 1), 15).otherwise(0)
        same = F.when(F.substring(name, at, F.lit(1)) == F.substring(pattern, j, F.lit(1)), 3).otherwise(0)
        return run + F.when(boundary(name, at), 12).otherwise(0) + same + 10 - (at - last - 1)

    def total(s: Column) -> Column:
        gained = F.aggregate(count(pattern), F.lit(0), lambda n, j: n + gain(F.element_at(s, j + 1), F.element_at(s, j), j))
        return F.when(F.element_at(s, -1) <= F.length(name), gained - (F.octet_length(name) / 10).cast("int"))

    return F.when(F.length(pattern) == 0, 0).when(F.length(pattern) > 0, _let(_let(chars, places), total))
