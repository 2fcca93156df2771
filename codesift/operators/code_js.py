"""Script files as tables: calls, imports, bindings, blocks and HTML parts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.functions import names
from codesift.operators import flow
from codesift.operators import structure as st
from codesift.operators import sweeps
from codesift.operators import tokens as tk
from codesift.operators.inventory import SCRIPT_EXTENSIONS
from codesift.operators.tables import TableSet
from codesift.schema import local_table
from codesift.session import keep

# Modules and the exports whose calls are looked at.
API_EXPORTS = {
    "shell": (["child_process", "node:child_process"], ["exec", "execSync"]),
    "fs": (
        ["fs", "node:fs", "fs/promises", "node:fs/promises"],
        ["readFile", "readFileSync", "writeFile", "writeFileSync", "open", "openSync", "rm", "rmSync",
         "unlink", "unlinkSync", "mkdir", "mkdirSync", "rmdir", "rmdirSync", "rename", "renameSync",
         "createReadStream", "createWriteStream", "readdirSync"],
    ),
    "path": (["path", "node:path"], ["join", "resolve"]),
    "http": (["http", "node:http", "https", "node:https"], ["get", "request"]),
    "vm": (["vm", "node:vm"], ["runInContext", "runInNewContext", "runInThisContext", "compileFunction", "Script"]),
    "program": (["child_process", "node:child_process"], ["execFile", "execFileSync", "spawn", "spawnSync"]),
}
# How far an import statement is followed.
IMPORT_REACH = {"shell": 40}
IMPORT_REACH_DEFAULT = 48
ASSIGN_REACH = 12
TYPE_REACH = 32

# Query words that mark text as SQL.
SQL_WORDS = ["select ", "insert ", "update ", "delete ", " from ", " where ", " order by ", " group by ", " union "]

COUNTERS = ["str", "non", "tpl", "tstart", "plus", "src", "sens", "log", "san", "pid", "solid"]


def unquote(text: Column) -> Column:
    """Drop one pair of equal quotes (templates keep their marks)."""
    return F.when(F.rlike(text, F.lit(r"\A(?:'[\s\S]*'|\"[\s\S]*\")\z")), F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def _flags() -> dict[str, Column]:
    text, kind, p1, p2 = F.col("text"), F.col("kind"), F.col("p1"), F.col("p2")
    string = kind.isin("string", "template")
    template = kind.isin("tstart", "tmid", "tend")
    source = (p1 == ".") & (
        ((text == "argv") & (p2 == "process"))
        | (text.isin("query", "params", "body", "headers", "header") & p2.isin("req", "request", "ctx"))
        | ((text == "data") & p2.isin("event", "messageEvent"))
        | (text.isin("search", "hash", "href") & (p2 == "location"))
    )
    ident = kind == "ident"
    return {
        "str": string,
        "non": ~string & ~text.isin("+", "(", ")"),
        "tpl": template,
        "tstart": kind == "tstart",
        "plus": text == "+",
        "src": source,
        "sens": ident & names.js_value_name(text),
        "log": ident & names.js_log_name(text),
        "san": (text == "(") & F.lower(p1).isin(names.LOG_SANITIZERS),
        "pid": text.isin("pid", "ppid") & (p1 == ".") & (p2 == "process"),
        "solid": ~text.isin("(", ")"),
    }


def script_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isin(SCRIPT_EXTENSIONS))


class ScriptTables(TableSet):
    """Tables derived from script files; built on demand, shared by all rules."""

    label = "js"

    def __init__(self, files: DataFrame):
        super().__init__()
        self.files = script_files(files)

    def holding(self, name: str, words: Column) -> ScriptTables:
        """Tables of the scripts whose whole text passes the test ``words``, under ``name``; of
        all scripts if their tokens lie there already."""
        if "rows" in self._made:
            return self
        return self._once(f"holding {name}", lambda: ScriptTables(self.files.where(words)))

    @property
    def cuts(self) -> DataFrame:
        """Every script, tests too, cut once: (file_id, repo, path, ext, is_test, pieces, errors)."""
        return self._once("cuts", lambda: tk.js_pieces(tk.placed(
            self.files.select("file_id", "repo", "path", "ext", "is_test", "content")
        )).drop("content"), kept=True)

    @property
    def rows(self) -> DataFrame:
        """Tokens by level and role (see ``structure.keyed``); read many times, so kept."""

        def make() -> DataFrame:
            base = st.neighbours(tk.js_tokens_of(self.cuts.where(~F.col("is_test"))), back=5, ahead=6, kinds_ahead=3)
            w = tk.by_file()
            base = base.withColumn("pk2", F.coalesce(F.lag("kind", 2).over(w), F.lit("")))
            flags = _flags()
            base = base.withColumns({f"f_{k}": v for k, v in flags.items()})
            out = st.nested(base, {k: F.col(f"f_{k}") for k in flags})
            return st.keyed(out.drop("off", "size", "pos"))

        return self._once("rows", make, kept=True)

    @property
    def tokens(self) -> DataFrame:
        return self._once("tokens", lambda: st.selves(self.rows))

    @property
    def seps(self) -> DataFrame:
        def make() -> DataFrame:
            w = Window.partitionBy("file_id", "grp").orderBy("idx")
            rows = self.rows.where(
                (F.col("role").isin("open", "close") | (F.col("text") == ",")) & (F.col("grp_text") == "(")
            )
            # A comma is itself code; the counts at the end of an argument leave it out.
            ends = [(F.col(f"c_{c}") - F.col(f"f_{c}").cast("int")).alias(f"c_{c}") for c in COUNTERS]
            after = F.struct("idx", "role", "n1", "nk1", "pk1", *ends)
            names_kept = ["file_id", "idx", "role", "grp", "bl", "p1", "p2", "p3", "p4", "p5", "pk1", "n1", "nk1", *[f"c_{c}" for c in COUNTERS]]
            return rows.withColumns({
                "nx": F.lead(after, 1).over(w), "nx2": F.lead(after, 2).over(w),
                "arg_no": (F.row_number().over(w) - 1).cast("int"),
            }).select(*names_kept, "nx", "nx2", "arg_no")

        return self._once("seps", make, kept=True)

    @property
    def args(self) -> DataFrame:
        """Non-empty arguments with their flag counts; text and kind of the first token."""
        return self._once("args", lambda: st.args(
            self.seps, COUNTERS, [F.col("n1").alias("first"), F.col("nk1").alias("first_kind"), F.col("nx.pk1").alias("last_kind")]
        ))

    @property
    def calls(self) -> DataFrame:
        """Round groups with the texts before them and their first two arguments."""

        def make() -> DataFrame:
            rows = self.seps.where((F.col("role") == "open") & F.col("nx.idx").isNotNull())
            out = rows.select(
                "file_id", F.col("idx").alias("open_idx"), "bl", "p1", "p2", "p3", "p4", "p5", "pk1",
                (F.col("idx") + 1).alias("s0"), (F.col("nx.idx") - 1).alias("e0"),
                F.col("n1").alias("first0"), F.col("nk1").alias("kind0"), F.col("nx.pk1").alias("last0"),
                *[(F.col(f"nx.c_{c}") - F.col(f"c_{c}")).alias(f"x_{c}") for c in COUNTERS],
                F.when(F.col("nx.role") == "self", F.col("nx.idx") + 1).alias("s1"),
                F.when(F.col("nx.role") == "self", F.col("nx2.idx") - 1).alias("e1"),
                F.col("nx.n1").alias("first1"), F.col("nx.nk1").alias("kind1"),
                *[(F.col(f"nx2.c_{c}") - F.col(f"nx.c_{c}") - (1 if c in ("non", "solid") else 0)).alias(f"y_{c}") for c in COUNTERS],
            )
            return out.withColumns({"has0": F.col("s0") <= F.col("e0"), "has1": F.coalesce(F.col("s1") <= F.col("e1"), F.lit(False))})

        return self._once("calls", make)

    @property
    def brackets(self) -> DataFrame:
        """Round groups: open, close, the texts before the opener and after the closer."""

        def make() -> DataFrame:
            rows = self.rows.where(F.col("role").isin("open", "close") & (F.col("grp_text") == "("))
            w = Window.partitionBy("file_id", "grp").orderBy("idx")
            return rows.withColumn("end", F.lead(F.struct("idx", "n1")).over(w)).where(F.col("role") == "open").select(
                "file_id", F.col("grp"), F.col("p1").alias("b1"), F.col("p2").alias("b2"), F.col("pk1").alias("bk1"),
                F.col("end.idx").alias("close_idx"), F.col("end.n1").alias("after"),
            )

        return self._once("brackets", make)

    @property
    def braces(self) -> DataFrame:
        return self._once("braces", lambda: self.tokens.where(F.col("text") == "{").select("file_id", "idx", "bl"))

    @property
    def brace_pairs(self) -> DataFrame:
        return self._once("brace_pairs", lambda: st.pairs(self.rows).where(F.col("kind") == "{"))

    # ---- imports and API calls -------------------------------------------------

    @property
    def imports(self) -> DataFrame:
        """imports(file_id, local, family, member): member NULL = whole namespace."""
        return self._once("imports", lambda: keep(self._imports()))

    def _imports(self) -> DataFrame:
        t = self.tokens
        spark = t.sparkSession
        modules = [(f, m, IMPORT_REACH.get(f, IMPORT_REACH_DEFAULT)) for f, (ms, _) in API_EXPORTS.items() for m in ms]
        module_table = F.broadcast(local_table(spark, modules, ["family", "module", "reach"], [pa.string(), pa.string(), pa.int32()]))
        # ES form: the next of (; export import from) after `import` must be `from`.
        marks = t.where(F.col("text").isin("import", "from", "export", ";"))
        ahead = F.lead(F.struct("idx", "text", "n1")).over(Window.partitionBy("file_id").orderBy("idx"))
        stmts = marks.withColumn("nx", ahead).where((F.col("text") == "import") & (F.col("nx.text") == "from")).select(
            "file_id", F.col("idx").alias("at"), F.col("nx.idx").alias("from_idx"), unquote(F.col("nx.n1")).alias("module"), "n1", "n2", "n3"
        ).join(module_table, "module").where(F.col("from_idx") < F.col("at") + F.col("reach"))
        star = (F.col("n1") == "*") & (F.col("n2") == "as")
        star_ok = star & ((F.col("family") != "shell") | (F.col("at") + 3 < F.col("from_idx")))
        spaces = stmts.where((F.col("n1") != "{") & (F.col("at") + 1 < F.col("from_idx"))).select(
            "file_id", F.when(star_ok, F.col("n3")).otherwise(F.col("n1")).alias("local"), "family", F.lit(None).cast("string").alias("member")
        )
        inside = t.select("file_id", F.col("grp").alias("open_idx"), "idx", "text", "p1", "n1", "n2")
        groups = stmts.where(F.col("n1") == "{").select("file_id", (F.col("at") + 1).alias("open_idx"), "family", F.lit("as").alias("rename"))
        # CommonJS form: name = require("m") or { a, b: c } = require("m").
        reqs = t.where((F.col("text") == "require") & (F.col("n1") == "(") & (F.col("p1") == "=")).select(
            "file_id", "idx", "p2", "p3", unquote(F.col("n2")).alias("module")
        ).join(module_table.drop("reach"), "module")
        variable = ["const", "let", "var"]
        plain = reqs.where(F.col("p3").isin(variable)).select(
            "file_id", F.col("p2").alias("local"), "family", F.lit(None).cast("string").alias("member")
        )
        opened = t.where((F.col("text") == "{") & F.col("p1").isin(variable)).select("file_id", F.col("idx").alias("open_idx"))
        taken = reqs.where((F.col("p2") == "}") & ~F.col("p3").isin(variable)).select("file_id", (F.col("idx") - 2).alias("close_idx"), "family")
        groups2 = taken.join(self.brace_pairs.select("file_id", "open_idx", "close_idx"), ["file_id", "close_idx"]).join(
            opened, ["file_id", "open_idx"], "left_semi"
        ).select("file_id", "open_idx", "family", F.lit(":").alias("rename"))
        items = groups.unionByName(groups2).join(inside, ["file_id", "open_idx"]).where(
            F.col("p1").isin("{", ",", "type") & ~F.col("text").isin(",", "}", "type")
        )
        named = items.select(
            "file_id", F.when(F.col("n1") == F.col("rename"), F.col("n2")).otherwise(F.col("text")).alias("local"), "family", F.col("text").alias("member")
        )
        exports = [(f, x) for f, (_, xs) in API_EXPORTS.items() for x in xs]
        known = named.join(F.broadcast(local_table(spark, exports, ["family", "member"])), ["family", "member"], "left_semi")
        return spaces.unionByName(plain).unionByName(known.select("file_id", "local", "family", "member")).distinct()

    @property
    def api_calls(self) -> DataFrame:
        """Calls resolved to a module export: adds family, method, anchor."""
        return self._once("api_calls", lambda: keep(self._api_calls()))

    def _api_calls(self) -> DataFrame:
        exports = [(f, x) for f, (_, xs) in API_EXPORTS.items() for x in xs]
        table = F.broadcast(local_table(self.tokens.sparkSession, exports, ["family", "method"]))
        forms = F.array_compact(F.array(
            F.struct(F.col("p1").alias("local"), F.lit("direct").alias("form"), F.lit("").alias("said"), (F.col("open_idx") - 1).alias("anchor")),
            F.when(F.col("p2") == ".", F.struct(F.col("p3").alias("local"), F.lit("space").alias("form"), F.col("p1").alias("said"), (F.col("open_idx") - 3).alias("anchor"))),
            F.when((F.col("p2") == ".") & (F.col("p3") == "promises") & (F.col("p4") == "."),
                   F.struct(F.col("p5").alias("local"), F.lit("promises").alias("form"), F.col("p1").alias("said"), (F.col("open_idx") - 5).alias("anchor"))),
        ))
        asked = self.calls.select("*", F.inline(forms))
        joined = asked.join(self.imports, ["file_id", "local"])
        direct = (F.col("form") == "direct") & F.col("member").isNotNull()
        spaced = (F.col("form") != "direct") & F.col("member").isNull() & ((F.col("form") == "space") | (F.col("family") != "shell"))
        found = joined.where(direct | spaced).withColumn("method", F.coalesce("member", "said"))
        return found.join(table, ["family", "method"], "left_semi").dropDuplicates(["file_id", "open_idx", "anchor", "family", "method"])

    # ---- expressions and bindings ----------------------------------------------

    def ends(self, starts: DataFrame, hard: Column, brk: Column) -> DataFrame:
        """End of an expression that follows each start token.

        starts(file_id, idx, lv, c_*): the token before the expression.  The first
        marked token at the expression's own depth ends it; a round or square
        group that closes first is left behind, a brace is handled by ``hard``.
        """
        own = self.rows.where(F.col("role") == "self")
        # A closer has a row of its own in the level that it ends.
        closers = self.rows.where(F.col("role") == "close").select("file_id", "idx", "lv", F.coalesce(hard | brk, F.lit(False)).alias("inner"))
        found = sweeps.next_marks(starts.select("file_id", "idx", "lv"), own.where(hard | brk).select("file_id", "idx", "lv"), closers)
        # Only marks and closers end an expression.
        at = own.where(hard | brk | st.is_closer()).select(
            "file_id", F.col("idx").alias("next_idx"), F.col("pk1").alias("z_last"),
            *[(F.col(f"c_{c}") - F.col(f"f_{c}").cast("int")).alias(f"z_{c}") for c in COUNTERS],
        )
        return found.join(at, ["file_id", "next_idx"]).select(
            "file_id", "idx", F.struct(F.col("next_idx").alias("idx"), "z_last", *[f"z_{c}" for c in COUNTERS]).alias("nx")
        )

    @property
    def file_ends(self) -> DataFrame:
        """Last token of each file, for expressions that run to the end."""
        # Texts are never empty, so an empty one stands for no token.
        return self._once("file_ends", lambda: self.tokens.where(F.col("n1") == "").select(
            "file_id", F.struct("idx", F.col("kind").alias("z_last"), *[F.col(f"c_{c}").alias(f"z_{c}") for c in COUNTERS]).alias("eof")
        ))

    def _spans(self, starts: DataFrame, ends: DataFrame) -> DataFrame:
        """Adds s, e and the flag counts x_* to the start tokens."""
        joined = starts.join(ends, ["file_id", "idx"], "left").join(self.file_ends, "file_id")
        return joined.withColumns({
            "s": F.col("idx") + 1,
            "e": F.coalesce(F.col("nx.idx") - 1, F.col("eof.idx")),
            "last_kind": F.coalesce("nx.z_last", "eof.z_last"),
            **{f"x_{c}": F.coalesce(f"nx.z_{c}", f"eof.z_{c}") - F.col(f"c_{c}") for c in COUNTERS},
        }).drop("nx", "eof", *[f"c_{c}" for c in COUNTERS])

    @staticmethod
    def line_break_ends() -> Column:
        """A line break before this token ends an expression."""
        return (
            (F.col("line") > F.col("pline"))
            & (F.col("pk1") != "op") & (F.col("kind") != "op")
            & ~F.col("p1").isin(".", "?.", ",", "?", ":", "(", "[", "{", "=>", "as", "satisfies", "return", "throw", "await", "yield")
            & ~F.col("text").isin(".", "?.", "(", "[", "?", ":", ",", "as", "satisfies")
            & ~F.col("kind").isin("template", "tstart")
        )

    def flow_spans(self, starts: DataFrame) -> DataFrame:
        closer = st.is_closer()
        own = F.col("role") == "self"
        hard = (own & F.col("text").isin(";", ",")) | ((F.col("role") == "close") & (F.col("text") == "}"))
        brk = self.line_break_ends() & (~own | ~closer)
        return self._spans(starts, self.ends(starts, hard, brk))

    def statement_spans(self, starts: DataFrame) -> DataFrame:
        hard = (F.col("role") == "self") & (F.col("text") == ";")
        return self._spans(starts, self.ends(starts, hard, F.lit(False)))

    def property_spans(self, starts: DataFrame) -> DataFrame:
        hard = ((F.col("role") == "self") & (F.col("text") == ",")) | ((F.col("role") == "close") & (F.col("text") == "}"))
        return self._spans(starts, self.ends(starts, hard, F.lit(False)))

    @property
    def assigned(self) -> DataFrame:
        """Right-hand sides, one per ``=``: (file_id, eq, s, e, x_*, first, first_kind)."""

        def make() -> DataFrame:
            eqs = self.tokens.where(F.col("text") == "=").select(
                "file_id", "idx", "lv", *[f"c_{c}" for c in COUNTERS], F.col("n1").alias("first"), F.col("nk1").alias("first_kind")
            )
            return keep(self.flow_spans(eqs).withColumnRenamed("idx", "eq").where(F.col("s") <= F.col("e")))

        return self._once("assigned", make)

    @property
    def bindings(self) -> DataFrame:
        """bindings(file_id, pos, name, bl, eq, is_barrier); each lives in the block around it."""

        def make() -> DataFrame:
            stops = ["=", ";", ",", "{", "}", "=>"]
            subset = self.tokens.where((F.col("kind") == "ident") | F.col("text").isin(stops))
            w = Window.partitionBy("file_id").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
            nx = F.last(F.when(F.col("text").isin(stops), F.struct("idx", "text")), ignorenulls=True).over(w)
            ids = subset.withColumn("nx", nx).where((F.col("kind") == "ident") & (F.col("p1") != "."))
            eq = F.when((F.col("nx.text") == "=") & (F.col("nx.idx") <= F.col("idx") + ASSIGN_REACH), F.col("nx.idx"))
            ids = ids.withColumn("eq", eq)
            named = ids.where(F.col("eq").isNotNull()).join(
                self.assigned.select("file_id", "eq"), ["file_id", "eq"], "left_semi"
            ).withColumn("is_barrier", F.lit(False))
            bare = ids.where(F.col("eq").isNull())
            told = F.col("p1").isin("const", "let", "var") | (F.col("n1") == "=>")
            params = bare.where(~told & F.col("p1").isin("(", ",", "...")).drop("grp")
            limits = self.tokens.where(F.col("text").isin("(", ")", "{", "}", ";")).select("file_id", "idx", "text")
            lists = sweeps.param_lists(limits, params.select("file_id", "idx"))
            as_param = params.join(lists, ["file_id", "idx"]).join(self.brackets, ["file_id", "grp"]).where(
                (F.col("after") == "=>")
                | ((F.col("after") == "{") & ~F.col("b1").isin("if", "for", "while", "switch", "with") & (
                    F.col("b1").isin("function", "catch")
                    | ((F.col("bk1") == "ident") & F.col("b2").isin("function", "async", "static", "get", "set", "{", ";"))
                ))
            )
            cols = ["file_id", F.col("idx").alias("pos"), F.col("text").alias("name"), "bl", "eq", "is_barrier"]
            out = named.select(*cols)
            for part in (bare.where(told), as_param):
                out = out.unionByName(part.withColumn("is_barrier", F.lit(True)).select(*cols))
            return keep(out)

        return self._once("bindings", make)

    def see(self, points: DataFrame) -> DataFrame:
        """points(file_id, idx, bl, point_id, name) → visible bindings."""
        bound = self.bindings.withColumns({"at": F.col("pos"), "scope_level": F.col("bl")})
        return sweeps.visible(points, bound, self.braces, "bl")

    @property
    def mentions(self) -> DataFrame:
        """Identifiers that read a variable, at the start of an expression or behind it."""

        def make() -> DataFrame:
            key = (F.col("n1") == ":") & F.col("p1").isin("{", ",")
            named = self.tokens.where(F.col("kind") == "ident").join(self.source_files, "file_id", "left_semi")
            return named.select("file_id", "idx", "text", (F.col("n1") != ":").alias("as_first"), ((F.col("p1") != ".") & ~key).alias("as_inner"))

        return self._once("mentions", make)

    @property
    def source_files(self) -> DataFrame:
        return self._once("source_files", lambda: self.tokens.where(F.col("f_src")).select("file_id").distinct())

    @property
    def edges(self) -> DataFrame:
        """Binding → binding references, only in files that mention a source."""

        def make() -> DataFrame:
            spans = self.assigned.select("file_id", "eq", F.col("s").alias("start_idx"), F.col("e").alias("end_idx")).join(
                self.source_files, "file_id", "left_semi"
            )
            used = sweeps.marks_in_spans(spans, self.mentions, "text", ["eq"], ["text"]).withColumnRenamed("text", "used").distinct()
            values = self.bindings.where(~F.col("is_barrier"))
            points = values.select("file_id", "eq", "pos", "bl").join(used, ["file_id", "eq"]).select(
                "file_id", F.col("pos").alias("idx"), "bl", F.col("pos").alias("point_id"), F.col("used").alias("name")
            )
            seen = self.see(points).where(~F.col("is_barrier"))
            seen = seen.select("file_id", F.col("point_id").alias("pos"), F.col("pos").alias("to_pos"), F.col("name").alias("to_name"))
            return keep(values.select("file_id", "pos", "name").join(seen, ["file_id", "pos"]))

        return self._once("edges", make)

    @property
    def tainted(self) -> DataFrame:
        """tainted(file_id, pos): bindings a lower-trust source can reach."""

        def make() -> DataFrame:
            values = self.bindings.where(~F.col("is_barrier")).join(self.source_files, "file_id", "left_semi").join(
                self.assigned.select("file_id", "eq", (F.col("x_src") > 0).alias("has_source")), ["file_id", "eq"]
            )
            return keep(flow.tainted_bindings(values.select("file_id", "pos", "name", "has_source"), self.edges).select("file_id", "pos"))

        return self._once("tainted", make)

    def tainted_sinks(self, sinks: DataFrame) -> DataFrame:
        """Ids of sinks(file_id, sink_id, idx, bl, s, e, x_src) a source reaches."""
        direct = sinks.where(F.col("x_src") > 0).select("file_id", "sink_id")
        spans = sinks.where(F.col("x_src") == 0).join(self.source_files, "file_id", "left_semi").select(
            "file_id", "sink_id", F.col("idx").alias("at"), "bl", F.col("s").alias("start_idx"), F.col("e").alias("end_idx")
        )
        used = sweeps.marks_in_spans(spans, self.mentions, "text", ["sink_id", "at", "bl"], ["text"])
        points = used.select(
            "file_id", F.col("at").alias("idx"), "bl", F.col("sink_id").alias("point_id"), F.col("text").alias("name")
        ).distinct()
        seen = self.see(points).where(~F.col("is_barrier")).select("file_id", "point_id", "pos")
        via = seen.join(self.tainted, ["file_id", "pos"], "left_semi").select("file_id", F.col("point_id").alias("sink_id"))
        return direct.unionByName(via).distinct()

    @property
    def alias_values(self) -> DataFrame:
        """Alias chains followed: (file_id, pos, s, e and x_* of the value at the end)."""

        def make() -> DataFrame:
            held = self.bindings.where(~F.col("is_barrier")).join(self.assigned, ["file_id", "eq"])
            single = held.where((F.col("x_solid") == 1) & ((F.col("s") + F.col("e")) % 2 == 0)).select(
                "file_id", "pos", F.col("name").alias("own"), "bl", ((F.col("s") + F.col("e")) / 2).cast("int").alias("mid")
            )
            mids = self.tokens.where(F.col("kind") == "ident").select("file_id", F.col("idx").alias("mid"), F.col("text").alias("used"))
            plain = single.join(mids, ["file_id", "mid"])
            points = plain.select("file_id", F.col("pos").alias("idx"), "bl", F.col("pos").alias("point_id"), F.col("used").alias("name"))
            seen = self.see(points).where(~F.col("is_barrier")).select(
                "file_id", F.col("point_id").alias("pos"), F.col("pos").alias("to_pos"), F.col("name").alias("to_name")
            )
            links = plain.select("file_id", "pos", F.col("own").alias("name")).join(seen, ["file_id", "pos"])
            links = links.where(F.col("name") != F.col("to_name"))
            ends = flow.alias_ends(links).select("file_id", "pos", "end_pos")
            values = held.select("file_id", F.col("pos").alias("end_pos"), "s", "e", *[f"x_{c}" for c in COUNTERS])
            first = held.select("file_id", "pos").join(ends, ["file_id", "pos"], "left").withColumn("end_pos", F.coalesce("end_pos", "pos"))
            return keep(first.join(values, ["file_id", "end_pos"]))

        return self._once("alias_values", make)
