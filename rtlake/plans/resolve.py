"""What names mean where they stand, for any number of places at once, as joins over the tables of an index.

A place asks for a name from its innermost scope. What it may see are arms of a union: its own scopes, what classes around
it inherit, what is imported there, and other files' top level. Each arm is an equi-join on scope and name that says how near a
row is; one aggregate keeps the nearest. Chains such as ``a.b[0].c`` go on segment by segment, for all places in one join a
round: the type of what was found is an owner, whose members are the rows of its scopes.

Nothing is resolved row by row or on the driver: there are as many rounds as the longest chain has segments.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rtlake.functions import names
from rtlake.functions import text as T
from rtlake.functions.code import NAME, blanked
from rtlake.operators import closure, spans
from rtlake.plans.checks import UNITS, path
from rtlake.plans.requests import ROUTINES, Index, is_forward

VIEWS = ("Modport", "Clocking")
VALUES = ("Variable", "Net", "Port", "Parameter", "Member", "Instance", "EnumLiteral", "Genvar")
TYPES = ("Class", "Interface", "Typedef", "TypeParameter", *VIEWS)
#: Kinds that have members of their own, and kinds that count only from where they are declared on.
OWNERS, ORDERED = ("Class", "Interface", *VIEWS), ("Variable", "Net", "Parameter", "Genvar", "Typedef")
#: Doublings by which aliases of types are followed: 32 one after the other.
ALIAS_ROUNDS = 5
#: A declaration by its place and name, as columns of whatever refers to it.
KEY, DECLARED = ("file", "line", "col", "name"), ("d_file", "d_line", "d_col", "d_name")
#: A place that asks: its number, where it is, the name, what precedes it, and whether it is called.
OCCURRENCE = "file string, line int, col int, name string, chain array<struct<name: string, call: boolean, depth: int>>, qualifier string, call boolean"


def declared() -> list[Column]:
    """A row's key under the names of ``DECLARED``."""
    return [F.col(c).alias(d) for c, d in zip(KEY, DECLARED, strict=True)]


# Places


def segments_before(plain: str, at: int) -> list[tuple[str, bool, int]]:
    """The chain that ends before the dot at ``at``: of each part its name, whether it is called, and how many index groups follow it."""
    out, i = [], at
    while True:
        i = len(plain[:i].rstrip())
        if not i or plain[i - 1] != ".":
            return out[::-1]
        found = segment_at(plain, len(plain[: i - 1].rstrip()))
        if found is None:
            return []
        out.append(found[:3])
        i = found[3]


def segment_at(plain: str, end: int) -> tuple[str, bool, int, int] | None:
    """The part of a chain that ends at an offset, and where it begins."""
    depth, call, i = 0, False, end
    while i and plain[i - 1] in ")]":
        close, level = plain[i - 1], 0
        while i:
            level += (plain[i - 1] == close) - (plain[i - 1] == {")": "(", "]": "["}[close])
            i -= 1
            if not level:
                break
        call, depth = call or close == ")", depth + (close == "]")
        i = len(plain[:i].rstrip())
    begin = i
    while begin and (plain[begin - 1].isalnum() or plain[begin - 1] in "_$"):
        begin -= 1
    return (plain[begin:i], call, depth, begin) if begin < i and not plain[begin].isdigit() else None


def asked_in(text: str, wanted: set[str] | None = None) -> Iterator[tuple]:
    """(line, col, name, chain, qualifier, call) of the identifiers of a text, those ``wanted`` or all.

    ``new`` without a receiver has as its chain what it is assigned to.
    """
    plain = blanked(text)
    starts = [0, *(m.end() for m in re.finditer("\n", plain))]
    for m in NAME.finditer(plain):
        if (wanted is not None and m[0] not in wanted) or (m.start() and plain[m.start() - 1] in "`$0123456789"):
            continue
        line = bisect_right(starts, m.start())
        window = max(0, m.start() - 4_000)  # a receiver is shorter than that
        before = plain[window : m.start()].rstrip()
        chain, qualifier = [], ""
        if before.endswith("."):
            chain = segments_before(before, len(before)) or [("", False, 0)]
        elif before.endswith("::"):
            found = re.search(r"[A-Za-z_][\w$]*(?:\s*::\s*[A-Za-z_][\w$]*)*(?=\s*::\Z)", before)
            qualifier = re.sub(r"\s", "", found[0]) if found else ""
        elif m[0] == "new" and before.endswith("=") and not before.endswith("=="):
            end = len(before.rstrip("<=").rstrip())
            last = segment_at(before, end)
            chain = [*segments_before(before, last[3]), last[:3]] if last else []
        yield line, m.start() - starts[line - 1], m[0], chain, qualifier, plain[m.end() : m.end() + 80].lstrip().startswith("(")


def occurrences(files: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Identifiers of ``files`` (path, text) outside comments and strings, as ``OCCURRENCE``; those ``wanted`` or all."""
    few = set(wanted) if wanted is not None else None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = pa.list_(pa.struct([("name", pa.string()), ("call", pa.bool_()), ("depth", pa.int32())]))
        types = (pa.string(), pa.int32(), pa.int32(), pa.string(), chain, pa.string(), pa.bool_())
        for b in batches:
            for file, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows = [(file, line, col, name, [dict(zip(("name", "call", "depth"), s, strict=True)) for s in segs], q, call) for line, col, name, segs, q, call in asked_in(text or "", few)]
                columns = list(zip(*rows, strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["file", "line", "col", "name", "chain", "qualifier", "call"])

    held = files.filter(F.arrays_overlap(F.lit(wanted), T.words(F.col("text")))) if wanted else files
    return held.select("path", "text").mapInArrow(find, OCCURRENCE)


def include_context(index: Index) -> DataFrame:
    """(file, scope): the scope in which a file is read, where its first include site stands; empty at the top.

    Sites that stand in no scope of their own file are read in that of the file's own site: chains of includes are
    followed by doubling.
    """
    first = Window.partitionBy("file").orderBy("includer", "line", "col")
    sites = index["include_sites"].filter("includer <> ''").withColumn("n", F.row_number().over(first)).filter("n = 1").select("file", F.col("includer").alias("up"), "line", "col")
    inside = innermost(index, sites.select(F.col("file").alias("q"), F.col("up").alias("file"), "line", "col"))
    out = closure.cut(sites.select("file", "up").join(inside.select(F.col("q").alias("file"), "scope"), "file", "left"))
    for _ in range(6):
        if out.filter("scope IS NULL AND up IS NOT NULL").isEmpty():
            break
        above = out.select(F.col("file").alias("up"), F.col("scope").alias("s"), F.col("up").alias("upper"))
        out = closure.cut(out.join(above, "up", "left").select("file", F.coalesce("scope", "s").alias("scope"), F.when(F.coalesce("scope", "s").isNull(), F.col("upper")).alias("up")))
    return out.select("file", F.coalesce("scope", F.lit("")).alias("scope"))


def innermost(index: Index, places: DataFrame) -> DataFrame:
    """(q, scope, kind) of places (q, file, line, col) that lie in a scope of their file."""
    held = index["symbols"].filter("end_line > 0").select("file", "line", "col", "end_line", "end_col", "kind", path().alias("scope")).distinct()
    at = lambda line, col: F.array(F.col(line).cast("long"), col.cast("long"))
    end = F.when(F.col("end_col") == 0, 1 << 40).otherwise(F.col("end_col"))
    return spans.innermost(places, held, ["file"], at("line", F.col("col")), at("line", F.col("col")), at("end_line", end), ["q"], ["scope", "kind"])


def placed(index: Index, places: DataFrame) -> DataFrame:
    """``places`` (q, file, line, col, ...) with ``scope``, the innermost around each: of its own file, else that in which the file is read."""
    own = innermost(index, places.select("q", "file", "line", "col")).select("q", F.col("scope").alias("own"))
    context = include_context(index).select("file", F.col("scope").alias("outer"))
    return places.join(own, "q", "left").join(context, "file", "left").withColumn("scope", F.coalesce("own", "outer", F.lit(""))).drop("own", "outer")


# Units


def unit_primary(sites: DataFrame, files: DataFrame) -> DataFrame:
    """(file, primary): up the first includer of each file to one that nothing includes; a cycle ends where it closes.

    All files go up at once, a step a round; there are as many rounds as includes are deep.
    """
    first = sites.filter("includer <> ''").groupBy("file").agg(F.min("includer").alias("up"))
    # ``seen`` holds the files on the way, so that a cycle is told; its length is the depth of includes.
    at = files.select("file", F.col("file").alias("primary"), F.array("file").alias("seen"), F.lit(False).alias("done"))
    for _ in range(64):
        step = at.join(first.select(F.col("file").alias("primary"), "up"), "primary", "left")
        done = F.col("done") | F.col("up").isNull() | F.array_contains("seen", F.col("up"))
        at = step.select("file", F.when(done, F.col("primary")).otherwise(F.col("up")).alias("primary"), F.when(done, F.col("seen")).otherwise(F.array_append("seen", F.col("up"))).alias("seen"), done.alias("done"))
        at = closure.cut(at)
        if at.filter("NOT done").isEmpty():
            return at.select("file", "primary")
    raise RuntimeError("includes are more than 64 deep")


# Meanings


class Model:
    """What questions about one index share, stored: rows by scope and name, packages' providers, types of values, lineage, owners' scopes."""

    def __init__(self, index: Index):
        self.index = index
        columns = ("file", "line", "col", "name", "kind", "scope", "detail", "access")
        self.rows = closure.cut(index["symbols"].select(*columns, path().alias("path"), is_forward(F.col("kind"), F.col("detail")).cast("int").alias("forward")))
        exports = index["imports"].filter("is_export AND item = '*'").select(F.col("scope").alias("src"), F.col("pkg_name").alias("dst"))
        imported = index["imports"].filter("pkg_name <> '*'").select(F.col("pkg_name").alias("root")).distinct()
        self.providers = closure.cut(closure.reach(exports, imported).select(F.col("root").alias("pkg_name"), F.col("node").alias("provider")))
        self.sees = closure.cut(self._sees())
        imports = index["imports"].filter("NOT is_export").select("file", "scope", "pkg_name", "item").distinct()
        self.given = closure.cut(imports.join(self.sees, "file").select("a_file", "scope", "pkg_name", "item").distinct())
        self.lineage = self.owners = None
        self.types = closure.cut(self._types())
        parents = self.rows.filter("kind = 'Class'").join(self.types.filter("t_kind = 'Class'"), [F.col(a) == F.col(b) for a, b in zip(KEY, DECLARED, strict=True)])
        self.lineage = closure.lineage(parents.select(F.col("path").alias("node"), F.col("t_path").alias("parent")))
        self.owners = closure.cut(self._owners())

    def _sees(self) -> DataFrame:
        """(a_file, file): a file and those compiled with it, in its own unit or in that by which it is read first."""
        files = self.index["contents"].select("file").distinct()
        units = unit_primary(self.index["include_sites"], files).select(F.col("file").alias("a_file"), F.col("primary").alias("unit"))
        return units.join(self.index["contents"].select("unit", "file"), "unit").select("a_file", "file").union(files.select("file", "file")).distinct()

    def _owners(self) -> DataFrame:
        """(owner, within, away, only): the scopes that an owner has members of, nearest first, and the names that alone it shows of them."""
        every, none = self.rows.select(F.col("path").alias("owner")).distinct(), F.lit(None).cast("array<string>")
        views = self.rows.filter(F.col("kind").isin(*VIEWS)).select(F.col("path").alias("owner"), F.col("scope").alias("within"), F.lit(0).alias("away"), F.transform(F.split("detail", ","), lambda x: F.trim(x)).alias("only"))
        classes = self.lineage.select(F.col("node").alias("owner"), F.col("ancestor").alias("within"), F.col("depth").alias("away"), none.alias("only"))
        known = views.select("owner").union(classes.select("owner")).distinct()
        rest = every.join(known, "owner", "left_anti").select("owner", F.col("owner").alias("within"), F.lit(0).alias("away"), none.alias("only"))
        root = self.rows.sparkSession.range(1).select(F.lit("$root").alias("owner"), F.lit("").alias("within"), F.lit(0).alias("away"), none.alias("only"))
        return views.union(classes).union(rest).union(root)

    def _types(self) -> DataFrame:
        """Of each declaration that has a type: ``DECLARED``, ``layers`` of containers around it, and the type's row by t_kind and t_path.

        Types are looked up where they are written. Aliases are followed by doubling; a struct is its own type.
        """
        detail = F.when(F.col("kind") == "Port", names.value_type(F.col("detail"))).otherwise(F.col("detail"))
        layers = T.type_layers(F.coalesce(detail, F.lit("")))
        typed = self.rows.filter(F.col("kind").isin(*VALUES, *ROUTINES, "Typedef", "TypeParameter", "Class") & (F.col("forward") == 0))
        parts = typed.withColumns({"layers": F.size(layers) - 1, "written": F.trim(F.split_part(F.element_at(layers, -1), F.lit("#"), F.lit(1)))})
        unit, view = F.split_part("written", F.lit("."), F.lit(1)), F.split_part("written", F.lit("."), F.lit(2))
        asks = parts.filter("written <> ''").select(
            F.struct(*declared()).alias("q"), "file", "line", "scope", "kind", "path", "layers",
            F.when(view != "", view).otherwise(T.scope_tail(unit)).alias("name"), F.when(view != "", unit).otherwise(T.scope_parent(unit)).alias("qualifier"),
        )
        asks = closure.cut(asks)
        kinds = F.col("kind").isin(*TYPES, *UNITS)
        bare = self.bare(asks.filter("qualifier = ''").select("q", "file", "line", "scope", "name", F.lit("type").alias("want")), self.rows.filter(kinds), inherited=False)
        named = self.qualified(asks.filter("qualifier <> ''").select("q", "qualifier", "name"), self.rows.filter(kinds))
        found = closure.cut(bare.union(named))
        alone = self.rows.filter(F.col("kind").isin("Class", "Interface")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("file", "line", "col", "name", "kind", "path")).alias("r")).filter("n = 1").select("name", "r")
        rest = asks.join(found.select("q"), "q", "left_anti").join(alone, "name").select("q", "r.*")
        first = found.union(rest.select(*found.columns)).select("q", F.struct(*declared()).alias("to"), F.col("kind").alias("t_kind"), F.col("path").alias("t_path"))
        structs = self.rows.filter("kind = 'Member'").select(F.col("scope").alias("t_path")).distinct().withColumn("struct", F.lit(True))
        at = closure.cut(first.join(structs, "t_path", "left").withColumn("ends", F.coalesce("struct", F.lit(False)) | F.col("t_kind").isin(*OWNERS, *UNITS)).drop("struct"))
        alias = closure.cut(at.join(self.rows.filter("kind IN ('Typedef', 'TypeParameter')").select(F.struct(*declared()).alias("q")), "q", "left_semi"))
        for _ in range(ALIAS_ROUNDS):
            if at.filter("NOT ends").isEmpty():
                break
            step = alias.select(F.col("q").alias("to"), F.col("to").alias("to2"), F.col("t_kind").alias("k2"), F.col("t_path").alias("p2"), F.col("ends").alias("e2"))
            go = lambda df: closure.cut(df.join(step, "to", "left").select("q", F.when(F.col("ends"), F.col("to")).otherwise(F.col("to2")).alias("to"), *[F.when(F.col("ends"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("t_kind", "k2"), ("t_path", "p2"))], (F.col("ends") | F.coalesce("e2", F.lit(False))).alias("ends")))
            at, alias = go(at), go(alias)
        known = at.filter("ends").select("q", "t_kind", "t_path")
        own = parts.join(structs.select(F.col("t_path").alias("path")), "path", "left_semi").select(F.struct(*declared()).alias("q"), F.col("kind").alias("t_kind"), F.col("path").alias("t_path"), "layers")
        typed_rows = known.join(asks.select("q", "layers"), "q")
        return typed_rows.select("q.*", "layers", "t_kind", "t_path").union(own.join(known.select("q"), "q", "left_anti").select("q.*", "layers", "t_kind", "t_path"))

    def bare(self, asks: DataFrame, rows: DataFrame | None = None, inherited: bool = True) -> DataFrame:
        """(q, file, line, col, name, kind, path) of what a name alone means to ``asks`` (q, file, line, scope, name, want).

        ``want`` (value, call, type or any) says which kinds go first; then the nearest: own scopes from the inside out, at
        each what a class there inherits; imports; other files' top level. Forward declarations go last in their turn.
        """
        rows = (self.rows if rows is None else rows).select("file", "line", "col", "name", "kind", "path", "scope", "access", "forward")
        at = asks.select("q", F.col("file").alias("a_file"), F.col("line").alias("a_line"), "want", F.col("name"), F.posexplode(spans.chain(F.col("scope"))).alias("level", "scope"))
        later = F.col("kind").isin(*ORDERED) & (F.col("line") > F.col("a_line")) & (F.col("scope") != "") & (F.col("file") == F.col("a_file"))
        shape = lambda df, arm, away: df.select("q", "want", F.lit(arm).alias("arm"), "level", away.alias("away"), "file", "line", "col", "name", "kind", "path", "forward")
        found = shape(at.join(rows, ["scope", "name"]).filter(~later).join(self.sees, ["a_file", "file"], "left_semi"), 0, F.lit(0))
        if inherited and self.lineage is not None:
            up = at.join(self.lineage.select(F.col("node").alias("scope"), "ancestor", "depth"), "scope").drop("scope").withColumnRenamed("ancestor", "scope")
            seen = up.join(rows, ["scope", "name"]).filter((F.col("depth") > 0) & (F.coalesce("access", F.lit("")) != "local"))
            found = found.union(shape(seen, 0, F.col("depth")))
        offered = at.join(self.given, ["a_file", "scope"]).filter("item = '*' OR item = name").join(self.providers, "pkg_name").drop("scope").withColumnRenamed("provider", "scope")
        found = found.union(shape(offered.join(rows, ["scope", "name"]), 1, F.lit(0)))
        top = asks.select("q", F.col("file").alias("a_file"), "want", "name", F.lit(0).alias("level")).join(rows.filter("scope = ''"), "name").filter(F.col("file") != F.col("a_file"))
        found = found.union(shape(top, 2, F.lit(0)))
        kinds = {"value": (*VALUES, "Block", *VIEWS), "call": ROUTINES, "type": TYPES}
        fits = F.lit(0)
        for want, ks in kinds.items():
            fits = F.when((F.col("want") == want) & ~F.col("kind").isin(*ks), 1).otherwise(fits)
        order = F.struct(fits.alias("fits"), "forward", "arm", "level", "away", "file", "line", "col")
        return found.groupBy("q").agg(F.min_by(F.struct("file", "line", "col", "name", "kind", "path"), order).alias("r")).select("q", "r.*")

    def qualified(self, asks: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """(q, ...) of what ``qualifier::name`` means: a row in that scope, or in one that ends so; the first by place."""
        rows = (self.rows if rows is None else rows).select("file", "line", "col", "name", "kind", "path", "scope")
        whole = F.col("scope") == F.col("qualifier")
        both = asks.join(rows, "name").filter(whole | F.col("scope").endswith(F.concat(F.lit("::"), F.col("qualifier"))))
        order = F.struct((~whole).alias("part"), "line", "col", "file")
        return both.groupBy("q").agg(F.min_by(F.struct("file", "line", "col", "name", "kind", "path"), order).alias("r")).select("q", "r.*")

    def members(self, asks: DataFrame) -> DataFrame:
        """(q, ...) of the members that ``asks`` (q, owner, name, call) mean: the nearest of the owner's scopes, of one scope the kind that fits a call or a value.

        Local ones are the owner's own; so is a constructor; of ``$root`` only design units are members.
        """
        both = asks.join(self.owners, "owner").join(self.rows.withColumnRenamed("scope", "within"), ["within", "name"])
        both = both.filter((F.col("only").isNull() | F.array_contains("only", F.col("name"))) & ((F.col("away") == 0) | ((F.coalesce("access", F.lit("")) != "local") & (F.col("name") != "new"))) & ((F.col("owner") != "$root") | F.col("kind").isin(*UNITS)))
        fits = F.when(F.col("call"), F.col("kind").isin(*ROUTINES)).otherwise(F.col("kind").isin(*VALUES, "Block", *VIEWS))
        order = F.struct("away", (~fits).alias("other"), "line", "col", "file")
        return both.groupBy("q").agg(F.min_by(F.struct("file", "line", "col", "name", "kind", "path"), order).alias("r")).select("q", "r.*")

    def owner_of(self, found: DataFrame) -> DataFrame:
        """(q, owner) of rows (q, file, line, col, name, kind, path, depth): the path whose members a value has after ``depth`` index groups."""
        itself = F.col("kind").isin("Block", *VIEWS, *UNITS) & (F.col("depth") == 0)
        keyed = found.select("q", "kind", "path", "depth", *declared())
        typed = keyed.join(self.types.select(*DECLARED, "layers", "t_path"), list(DECLARED), "left")
        routine = F.col("kind").isin(*ROUTINES)
        fits = (F.col("layers") == F.col("depth")) | (routine & (F.col("depth") == 0) & (F.col("layers") == 0))
        return typed.select("q", F.when(itself, F.col("path")).when(fits & F.col("kind").isin(*VALUES, *ROUTINES), F.col("t_path")).alias("owner")).filter("owner IS NOT NULL")

    def around(self, places: DataFrame) -> DataFrame:
        """(q, class, parent) of the innermost class around places (q, scope), and the class that it extends."""
        at = places.select("q", F.posexplode(spans.chain(F.col("scope"))).alias("level", "class"))
        own = at.join(self.lineage.filter("depth = 0").select(F.col("node").alias("class")), "class").groupBy("q").agg(F.min_by("class", "level").alias("class"))
        return own.join(self.lineage.filter("depth = 1").select(F.col("node").alias("class"), F.col("ancestor").alias("parent")), "class", "left").select("q", "class", "parent")

    def receivers(self, asks: DataFrame) -> DataFrame:
        """(q, owner) of what the chains of ``asks`` (q, file, line, scope, chain) stand for, one segment of all of them a round."""
        asks = closure.cut(asks.select("q", "file", "line", "scope", "chain"))
        first = F.col("chain")[0]
        plain = ~first["call"] & (first["depth"] == 0)
        around = self.around(asks.filter(plain & first["name"].isin("this", "super")))
        named = asks.filter(plain & first["name"].isin("this", "super")).join(around, "q").select("q", F.when(first["name"] == "this", F.col("class")).otherwise(F.col("parent")).alias("owner"))
        root = asks.filter(plain & (first["name"] == "$root")).select("q", F.lit("$root").alias("owner"))
        rest = asks.filter(~(plain & first["name"].isin("this", "super", "$root")))
        bare = self.bare(rest.select("q", "file", "line", "scope", first["name"].alias("name"), F.when(first["call"], "call").otherwise("value").alias("want")))
        found = self.owner_of(bare.join(rest.select("q", first["depth"].alias("depth")), "q"))
        at = closure.cut(found.union(named.filter("owner IS NOT NULL")).union(root))
        longest = asks.agg(F.max(F.size("chain")).alias("n")).first()["n"] or 0
        done = at.join(asks.filter(F.size("chain") == 1).select("q"), "q", "left_semi")
        for k in range(1, longest):
            part = F.get("chain", F.lit(k))
            going = at.join(asks.filter(F.size("chain") > k).select("q", "chain"), "q")
            met = self.members(going.select("q", "owner", part["name"].alias("name"), part["call"].alias("call")))
            at = closure.cut(self.owner_of(met.join(going.select("q", part["depth"].alias("depth")), "q")))
            done = done.union(at.join(asks.filter(F.size("chain") == k + 1).select("q"), "q", "left_semi"))
        return done

    def meanings(self, found: DataFrame) -> DataFrame:
        """``found`` (as ``OCCURRENCE``) with ``DECLARED``, the declaration that each means, and its kind; those without any drop out.

        An identifier that stands at a declaration of its name means that one.
        """
        asks = closure.cut(placed(self.index, found.withColumn("q", F.struct(*KEY))))
        here = self.rows.select(F.struct(*KEY).alias("q"), "kind", "path").groupBy("q").agg(F.min(F.struct("kind", "path")).alias("r")).select("q", "q.*", "r.*")
        own = here.join(asks.select("q"), "q", "left_semi")
        rest = closure.cut(asks.join(own.select("q"), "q", "left_anti"))
        dotted = rest.filter(F.size("chain") > 0)
        through = self.members(self.receivers(dotted).join(dotted.select("q", "name", "call"), "q"))
        named = self.qualified(rest.filter("qualifier <> ''").select("q", "qualifier", "name"))
        alone = self.bare(rest.filter((F.size("chain") == 0) & (F.col("qualifier") == "")).select("q", "file", "line", "scope", "name", F.lit("any").alias("want")))
        every = own.union(through).union(named).union(alone)
        return asks.drop("scope").join(every.select("q", "kind", *declared()), "q").drop("q")

    def families(self) -> DataFrame:
        """(``DECLARED``, root): of each routine of a class, the topmost that it overrides; constructors override nothing."""
        routines = self.rows.filter(F.col("kind").isin(*ROUTINES) & (F.col("name") != "new"))
        own = routines.select(F.col("scope").alias("node"), *declared())
        tops = routines.select(F.col("scope").alias("ancestor"), F.col("name").alias("d_name"), F.struct(*KEY).alias("top"))
        both = own.join(self.lineage, "node").join(tops, ["ancestor", "d_name"])
        return both.groupBy(*DECLARED).agg(F.min_by("top", F.struct(-F.col("depth"), F.col("top.line"), F.col("top.col"), F.col("top.file"))).alias("root"))

    def meant_occurrences(self, files: DataFrame, targets: DataFrame) -> DataFrame:
        """Occurrences, by file, line, col and name, that mean one of ``targets`` (file, line, col, name) or, for a method, one of its override family."""
        few = [r["name"] for r in targets.select("name").distinct().limit(1_001).collect()]
        found = self.meanings(occurrences(files, few if len(few) <= 1_000 else None))
        root = lambda df: df.join(self.families(), list(DECLARED), "left").withColumn("root", F.coalesce("root", F.struct(*[F.col(d).alias(c) for c, d in zip(KEY, DECLARED, strict=True)])))
        wanted = root(targets.select(*declared())).select("root").distinct()
        return root(found).join(wanted, "root", "left_semi").select("file", "line", "col", "name")


# Macros


def macro_occurrences(files: DataFrame, name: str) -> DataFrame:
    """(file, line, col) of a macro's uses and of the directives that name it, outside comments and strings."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                for found, at in names.macro_names(text):
                    if found == name:
                        rows.append((path, text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at) - 1))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True)], names=["file", "line", "col"])

    return files.filter(F.contains("text", F.lit(name))).select("path", "text").mapInArrow(find, "file string, line int, col int")
