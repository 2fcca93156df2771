"""Go files as tables: statements, scopes, calls, literals and bindings.

There is no syntax tree.  Tokens carry the statement ends that line breaks
imply, and inside one group (the tokens directly between a pair of delimiters)
windows cut statements into elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.functions import names
from codesift.operators import flow
from codesift.operators import structure as st
from codesift.operators import sweeps
from codesift.operators import tokens as tk
from codesift.operators.tables import TableSet
from codesift.schema import local_table

ASSIGN_OPS = ["=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="]
CONTROL = ["if", "for", "switch"]
BODY_WORDS = ["if", "for", "switch", "select", "else"]
# Words that begin a statement, so that an assignment after them starts afresh.
STATEMENT_WORDS = [
    "if", "for", "switch", "select", "case", "default", "else", "var", "const", "type", "return", "go", "defer",
]

# Packages and the calls that the rules look at.
API_CALLS = {
    "os/exec": ["Command", "CommandContext"],
    "os": ["Open", "OpenFile", "ReadFile", "WriteFile", "Create", "Remove", "RemoveAll", "Mkdir", "MkdirAll",
           "Rename", "ReadDir", "Exit"],
    "path/filepath": ["Join"],
    "io": ["ReadAll"],
    "net/http": ["Get", "Head", "Post", "PostForm", "Redirect"],
    "html/template": ["HTML"],
    "log": ["Print", "Printf", "Println", "Fatal", "Fatalf", "Fatalln"],
    "log/slog": ["Debug", "Info", "Warn", "Error", "Log"],
    "fmt": ["Print", "Printf", "Println", "Fprint", "Fprintf", "Fprintln", "Sprintf", "Sprint", "Sprintln"],
    "crypto/md5": ["Sum"],
    "crypto/sha1": ["Sum"],
    "regexp": ["MustCompile"],
    "math/rand": ["Int", "Int31", "Int31n", "Int63", "Int63n", "Intn", "Uint32", "Uint64", "Float32", "Float64", "Read"],
}
REQUESTS = ["r", "req", "request"]
COUNTERS = ["src", "log"]

# Literals of more bytes are not copied to the tokens around them.
LONG_LITERAL = 256


# What the one-letter escapes of a quoted literal stand for.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def _unescaped(piece: Column) -> Column:
    """One piece of a quoted literal: an escape, or a run of plain characters."""
    letter, digits = F.substring(piece, 2, 1), F.substr(piece, F.lit(3))
    code = F.when(letter.isin("x", "u", "U"), F.conv(digits, 16, 10)).when(F.rlike(piece, F.lit(r"\A\\[0-7]{3}\z")), F.conv(F.substr(piece, F.lit(2)), 8, 10)).cast("long")
    valid = (code < 0xD800) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    out = F.when(code.isNotNull(), char)
    for name, value in ESCAPES.items():
        out = out.when(letter == name, F.lit(value))
    return F.when(F.startswith(piece, F.lit("\\")), out.otherwise(letter)).otherwise(piece)


def literal(text: Column) -> Column:
    """Value of a string token; escapes of the quoted form are undone from left to right."""
    inner = F.substr(text, F.lit(2), F.length(text) - 2)
    pieces = F.regexp_extract_all(inner, F.lit(r"(?s)\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[0-7]{3}|.)|[^\\]+"), F.lit(0))
    plain = F.when(F.contains(inner, F.lit("\\")), F.array_join(F.transform(pieces, _unescaped), "")).otherwise(inner)
    return F.when(F.startswith(text, F.lit("`")), inner).otherwise(plain)


def _stand_in() -> Column:
    """What other tokens hold of a token.  For a long literal its first mark and a digest, which
    is no token itself: unlike all words and marks, and alike for equal literals only."""
    text = F.col("text")
    long = (F.col("kind") == "string") & (F.octet_length(text) > LONG_LITERAL)
    return F.when(long, F.concat(F.substring(text, 1, 1), F.sha2(text, 256))).otherwise(text)


def _with_neighbours(tokens: DataFrame) -> DataFrame:
    """Texts around each token, long literals by their stand-in but where their value is read:
    arguments and import paths (n1, n2), and fields of composite literals (n2)."""
    out = st.neighbours(tokens.withColumn("shown", _stand_in()), back=6, ahead=5, kinds_ahead=2, text="shown").drop("shown")
    whole = [F.lead("text", i).over(tk.by_file()) for i in (1, 2)]
    imported = F.col("text") == "import"
    return out.withColumns({
        "n1": F.when((F.col("nk1") == "string") & (imported | F.col("text").isin("(", ",")), whole[0]).otherwise(F.col("n1")),
        "n2": F.when((F.col("nk2") == "string") & (imported | (F.col("n1") == ":")), whole[1]).otherwise(F.col("n2")),
    })


def _flags() -> dict[str, Column]:
    text, kind = F.col("text"), F.col("kind")
    p1, p2, p3, p4, p5 = (F.col(f"p{i}") for i in range(1, 6))
    n1 = F.col("n1")
    direct = (p1 == ".") & F.lower(p2).isin(REQUESTS) & (p3 != ".")
    behind = (p1 == ".") & (p3 == ".") & F.lower(p4).isin(REQUESTS) & (p5 != ".")
    source = (kind == "ident") & (
        (text.isin("Host", "RequestURI") & direct)
        | (text.isin("FormValue", "PostFormValue", "PathValue") & direct & (n1 == "("))
        | ((text == "Get") & (n1 == "(") & behind & (p2 == "Header"))
        | ((text == "String") & (n1 == "(") & behind & (p2 == "URL"))
        | ((text == "Query") & behind & (p2 == "URL") & (n1 == "(") & (F.col("n2") == ")") & (F.col("n3") == ".")
           & (F.col("n4") == "Get") & (F.col("n5") == "("))
        | ((text == "Args") & (p1 == ".") & (p3 != ".") & (p2 == F.col("os_name")))
    )
    return {"src": source, "log": (kind == "ident") & names.go_log_name(text)}


def _os_name() -> Column:
    """On the path of an import of package os, its local name.  A string that begins a
    statement, or follows a name that does, can only stand in an import."""
    p1, p2, p3 = F.col("p1"), F.col("p2"), F.col("p3")
    path = (F.col("kind") == "string") & F.col("text").isin('"os"', "`os`")
    plain = p1.isin("import", ";") | ((p1 == "(") & (p2 == "import"))
    named = (F.col("pk1") == "ident") & (p2.isin("import", ";") | ((p2 == "(") & (p3 == "import")))
    return F.when(path & plain, F.lit("os")).when(path & named, p1)


class GoTables(TableSet):
    """Tables derived from Go files; built on demand, shared by all rules."""

    label = "go"

    def __init__(self, files: DataFrame):
        super().__init__()
        self.files = files.where(F.col("ext") == ".go")

    @property
    def cuts(self) -> DataFrame:
        """Every Go file, tests too, cut once: (file_id, repo, path, ext, is_test, pieces, errors)."""
        return self._once("cuts", lambda: tk.go_pieces(tk.placed(
            self.files.select("file_id", "repo", "path", "ext", "is_test", "content")
        )).drop("content"), kept=True)

    @property
    def pieces(self) -> DataFrame:
        """Readable pieces including comments, with positions."""

        def make() -> DataFrame:
            # A file with unreadable characters counts as a parse failure.
            rows = tk.go_pieces_with_ends(self.cuts.where(~F.col("is_test") & (F.col("errors") == 0)))
            return rows.where(F.col("kind") != "trivia").select(
                "file_id", "repo", "path", "pos", "kind", "text", "line", "col", "off", "size", "breaks"
            )

        return self._once("pieces", make, kept=True)

    @property
    def rows(self) -> DataFrame:
        def make() -> DataFrame:
            solid = self.pieces.where(F.col("kind") != "comment").drop("breaks")
            solid = solid.withColumn("idx", (F.row_number().over(tk.by_file()) - 1).cast("int"))
            base = _with_neighbours(solid)
            base = base.withColumn("os_name", F.coalesce(F.max(_os_name()).over(Window.partitionBy("file_id")), F.lit("")))
            flags = _flags()
            base = base.withColumns({f"f_{k}": v for k, v in flags.items()}).drop("os_name")
            return st.keyed(st.nested(base, {k: F.col(f"f_{k}") for k in flags}))

        return self._once("rows", make, kept=True)

    @property
    def tokens(self) -> DataFrame:
        return self._once("tokens", lambda: st.selves(self.rows))

    # ---- calls ------------------------------------------------------------------

    @property
    def seps(self) -> DataFrame:
        def make() -> DataFrame:
            w = Window.partitionBy("file_id", "grp").orderBy("idx")
            rows = self.rows.where((F.col("role").isin("open", "close") | (F.col("text") == ",")) & (F.col("grp_text") == "("))
            ends = [(F.col(f"c_{c}") - F.col(f"f_{c}").cast("int")).alias(f"c_{c}") for c in COUNTERS]
            after = F.struct("idx", "role", "p1", "p2", *ends)
            close = F.max(F.when(F.col("role") == "close", F.col("idx"))).over(Window.partitionBy("file_id", "grp"))
            return rows.withColumns({
                "nx": F.lead(after).over(w), "arg_no": (F.row_number().over(w) - 1).cast("int"), "close_idx": close,
            }).select("file_id", "idx", "role", "grp", *[f"p{i}" for i in range(1, 7)], "pk1", "n1", "nk1", "nx", "arg_no", "close_idx",
                      *[f"c_{c}" for c in COUNTERS])

        return self._once("seps", make, kept=True)

    @property
    def args(self) -> DataFrame:
        """Arguments by call; ``last``/``before_last`` are the final texts."""
        return self._once("args", lambda: st.args(self.seps, COUNTERS, [
            F.col("n1").alias("first"), F.col("nk1").alias("first_kind"), F.col("nx.p1").alias("last"), F.col("nx.p2").alias("before_last"),
        ]))

    @property
    def arg_counts(self) -> DataFrame:
        return self._once("arg_counts", lambda: self.args.groupBy("file_id", "open_idx").agg(F.count(F.lit(1)).cast("int").alias("n_args")))

    @property
    def imports(self) -> DataFrame:
        """imports(file_id, local, module)."""

        def make() -> DataFrame:
            t = self.tokens
            heads = t.where((F.col("text") == "import") & (F.col("bl") == 0) & (F.col("grp") == -1))
            single = heads.where(F.col("n1") != "(").select(
                "file_id",
                F.when(F.col("nk1") == "string", F.lit("")).otherwise(F.col("n1")).alias("name"),
                literal(F.when(F.col("nk1") == "string", F.col("n1")).otherwise(F.col("n2"))).alias("module"),
            )
            groups = heads.where(F.col("n1") == "(").select("file_id", (F.col("idx") + 1).alias("grp"))
            inside = t.where(F.col("kind") == "string").join(groups, ["file_id", "grp"], "left_semi").select(
                "file_id", F.when(F.col("p1").isin("(", ";"), F.lit("")).otherwise(F.col("p1")).alias("name"), literal(F.col("text")).alias("module")
            )
            both = single.unionByName(inside)
            base = F.regexp_extract("module", r"([^/]*)/*\z", 1)
            return both.select("file_id", F.when(F.col("name") == "", base).otherwise(F.col("name")).alias("local"), "module").distinct()

        return self._once("imports", make, kept=True)

    @property
    def api_calls(self) -> DataFrame:
        """Package calls: (file_id, module, method, anchor, open_idx, close_idx, n_args)."""

        def make() -> DataFrame:
            table = [(m, x) for m, xs in API_CALLS.items() for x in xs]
            known = F.broadcast(local_table(self.tokens.sparkSession, table, ["module", "method"]))
            opened = self.seps.where((F.col("role") == "open") & (F.col("p2") == ".") & (F.col("p4") != ".") & F.col("close_idx").isNotNull())
            calls = opened.select(
                "file_id", F.col("p3").alias("local"), F.col("p1").alias("method"), (F.col("idx") - 3).alias("anchor"),
                F.col("idx").alias("open_idx"), "close_idx",
            )
            out = calls.join(self.imports, ["file_id", "local"]).join(known, ["module", "method"], "left_semi")
            return out.join(self.arg_counts, ["file_id", "open_idx"], "left").withColumn("n_args", F.coalesce("n_args", F.lit(0)))

        return self._once("api_calls", make, kept=True)

    def calls_of(self, module: str, *methods: str) -> DataFrame:
        out = self.api_calls.where(F.col("module") == module)
        return out.where(F.col("method").isin(list(methods))) if methods else out

    def with_arg(self, calls: DataFrame, number) -> DataFrame:
        """Adds one argument: number is an int or a column of the calls."""
        want = calls.withColumn("arg_no", F.lit(number) if isinstance(number, int) else number)
        return want.join(self.args, ["file_id", "open_idx", "arg_no"])

    # ---- bodies, functions and scopes ---------------------------------------------

    @property
    def grouped(self) -> DataFrame:
        """Tokens in group order with the body each brace opens.

        ``head`` names the word whose body a brace is (func, if, for, ...), or is
        NULL for literals, types and plain blocks.
        """

        def make() -> DataFrame:
            t = self.tokens
            w = Window.partitionBy("file_id", "grp").orderBy("idx")
            past = w.rowsBetween(Window.unboundedPreceding, -1)
            control = F.col("text").isin(BODY_WORDS) & (F.col("kind") == "keyword")
            func = (F.col("text") == "func") & (F.col("kind") == "keyword")
            brace = (F.col("text") == "{") & ~F.col("p1").isin("struct", "interface")
            sized = (F.col("pk1") == "ident") & ((F.col("p2") == "]") | ((F.col("p2") == ".") & (F.col("p4") == "]")))
            breaks_func = F.col("text").isin(";", ",", "=", ":=", ":")
            t = t.withColumns({
                "last_head": F.last(F.when(control | func, F.struct("idx", "text")), ignorenulls=True).over(past),
                "last_break": F.max(F.when(breaks_func, F.col("idx"))).over(past),
            })
            head = F.col("last_head.text")
            open_func = brace & (head == "func") & ~F.coalesce(F.col("last_break") > F.col("last_head.idx"), F.lit(False))
            open_ctl = brace & head.isin(BODY_WORDS) & ~sized
            t = t.withColumn("may_open", open_func | open_ctl)
            t = t.withColumn("last_open", F.max(F.when(F.col("may_open"), F.col("idx"))).over(past))
            is_body = F.col("may_open") & ~F.coalesce(F.col("last_open") > F.col("last_head.idx"), F.lit(False))
            t = t.withColumn("head", F.when(is_body, head)).withColumn("head_idx", F.when(is_body, F.col("last_head.idx")))
            # A closer follows its opener directly in group order.
            t = t.withColumn("closes", F.when(F.col("text") == "}", F.lag("head").over(w)))
            t = t.withColumn("closes_open", F.when(F.col("text").isin("}", ")", "]"), F.lag("idx").over(w)))
            ifs = F.sum(F.when((F.col("text") == "if") & (F.col("kind") == "keyword"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
            t = t.withColumn("ifs", ifs)
            chain = F.last(F.when((F.col("text") == "if") & (F.col("p1") != "else"), F.col("ifs") - 1), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
            t = t.withColumn("chain", F.coalesce(chain, F.lit(0)))
            ended = (
                F.when(F.col("closes").isin("for", "switch"), 1)
                .when(F.col("closes").isin("if", "else") & (F.col("n1") != "else"), F.col("ifs") - F.col("chain")).otherwise(0)
            )
            word = F.col("text").isin(CONTROL) & (F.col("kind") == "keyword")
            opens = F.col("text") == "{"
            step = F.when(opens | word, 1).when(F.col("text") == "}", -1 - ended).otherwise(0)
            t = t.withColumn("scope_opens", opens | word).withColumn("after", F.sum(step).over(
                Window.partitionBy("file_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ))
            t = t.withColumn("sl", (F.col("after") - F.when(F.col("scope_opens"), 1).otherwise(0)).cast("int"))
            # Statements: separated by ;, statement words, case colons and control bodies.
            # A colon after case, default or a label; in literals no assignment follows it.
            case_colon = (F.col("text") == ":") & F.coalesce(F.col("grp_text") == "{", F.lit(False))
            bound = (
                (F.col("text") == ";") | (F.col("text").isin(STATEMENT_WORDS) & (F.col("kind") == "keyword"))
                | F.col("head").isin(BODY_WORDS) | F.col("closes").isin(BODY_WORDS) | case_colon
            )
            t = t.withColumn("bound", F.coalesce(bound, F.lit(False))).withColumn("stmt", F.sum(F.when(bound, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            return t.select(
                "file_id", "idx", "text", "kind", "grp", "grp_text", "bl", "sl", "scope_opens", "bound", "stmt", "head", "head_idx",
                "closes", "closes_open", *[f"p{i}" for i in range(1, 5)], "pk1", "n1", "n2", "nk1", "line", "f_src", "c_src",
            )

        return self._once("grouped", make, kept=True)

    @property
    def scope_openers(self) -> DataFrame:
        is_fn = F.coalesce(F.col("head") == "func", F.lit(False)).alias("is_fn")
        return self.grouped.where("scope_opens").select("file_id", "idx", "sl", is_fn)

    @property
    def declared(self) -> DataFrame:
        """Top-level functions: (file_id, scope, close_idx, name)."""

        def make() -> DataFrame:
            top = self.grouped.where(F.col("grp") == -1)
            w = Window.partitionBy("file_id", "grp").orderBy("idx")
            named = top.withColumn("name", F.when(F.col("n1") == "(", F.lead("text", 3).over(w)).otherwise(F.col("n1"))).where(F.col("text") == "func")
            bodies = top.where(F.col("head") == "func").select("file_id", F.col("idx").alias("scope"), "head_idx")
            closes = top.where(F.col("closes") == "func").select("file_id", F.col("closes_open").alias("scope"), F.col("idx").alias("close_idx"))
            return bodies.join(named.select("file_id", F.col("idx").alias("head_idx"), "name"), ["file_id", "head_idx"]).join(
                closes, ["file_id", "scope"]
            ).select("file_id", "scope", "close_idx", "name")

        return self._once("declared", make, kept=True)

    @property
    def levels(self) -> DataFrame:
        return self._once("levels", lambda: self.grouped.select("file_id", "idx", "sl"))

    # ---- statements and bindings ----------------------------------------------------

    @property
    def elements(self) -> DataFrame:
        """Comma-separated sides of assignments and var declarations.

        (file_id, grp, stmt, op_idx, side, no, s, e, n, text, kind, plus, x_src):
        side 0 = targets, 1 = values; s..e are token indices.
        """

        def make() -> DataFrame:
            g = self.grouped.where(~F.col("bound"))
            w = Window.partitionBy("file_id", "grp", "stmt")
            op = F.col("text").isin(ASSIGN_OPS) & (F.col("kind") == "op")
            run = w.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            g = g.withColumn("op_idx", F.min(F.when(op, F.col("idx"))).over(w)).withColumns({
                "side": F.max(F.when(op, 1).otherwise(0)).over(run),
                "commas": F.sum(F.when(F.col("text") == ",", 1).otherwise(0)).over(run),
                "ranged": F.max(F.when(F.col("text") == "range", 1).otherwise(0)).over(w),
            })
            is_var = self.grouped.where((F.col("text") == "var") & (F.col("kind") == "keyword")).select("file_id", "grp", "stmt").distinct()
            in_var_group = self.grouped.where((F.col("text") == "(") & (F.col("p1") == "var")).select("file_id", F.col("idx").alias("grp"))
            g = g.join(is_var.withColumn("is_var", F.lit(True)), ["file_id", "grp", "stmt"], "left").join(
                in_var_group.withColumn("var_group", F.lit(True)), ["file_id", "grp"], "left"
            )
            g = g.withColumn("is_var", F.coalesce("is_var", "var_group", F.lit(False))).where(F.col("op_idx").isNotNull() | F.col("is_var"))
            first_comma = F.min(F.when(F.col("side") == 1, F.col("commas"))).over(w)
            g = g.withColumn("no", F.when(F.col("side") == 1, F.col("commas") - first_comma).otherwise(F.col("commas")).cast("int"))
            body = g.where(~(op & (F.col("idx") == F.col("op_idx"))) & (F.col("text") != ","))
            # Binary plus directly in the element; the token before it ends an operand.
            plus = (F.col("text") == "+") & (F.col("pk1").isin("ident", "string", "number", "rune") | F.col("p1").isin(")", "]", "}"))
            weaker = F.col("text").isin("==", "!=", "<", "<=", ">", ">=", "&&", "||")
            return body.groupBy("file_id", "grp", "stmt", "op_idx", "side", "no", "is_var", "ranged").agg(
                F.min("idx").alias("s"), F.max("idx").alias("e"), F.count(F.lit(1)).cast("int").alias("n"),
                F.min_by(F.struct("text", "kind", "sl"), "idx").alias("f"),
                (F.bool_or(plus) & ~F.bool_or(weaker)).alias("plus"),
                F.max_by(F.struct("text", "kind", "p1"), "idx").alias("l"),
                (F.max("c_src") - F.min(F.col("c_src") - F.col("f_src").cast("int"))).alias("x_src"),
            ).select("file_id", "grp", "stmt", "op_idx", "side", "no", "is_var", "ranged", "s", "e", "n", "plus", "x_src",
                     F.col("f.text").alias("text"), F.col("f.kind").alias("kind"), F.col("f.sl").alias("sl"),
                     F.col("l.text").alias("last"), F.col("l.kind").alias("last_kind"), F.col("l.p1").alias("before_last"))

        return self._once("elements", make, kept=True)

    @property
    def sides(self) -> DataFrame:
        """Element counts of a statement: (file_id, grp, stmt, targets, given)."""
        return self._once("sides", lambda: self.elements.groupBy("file_id", "grp", "stmt").agg(
            F.count_if(F.col("side") == 0).alias("targets"), F.count_if(F.col("side") == 1).alias("given"),
            F.min("s").alias("from_idx"), F.max("e").alias("to_idx"),
        ))

    @property
    def assigned(self) -> DataFrame:
        """Targets with their values: (file_id, name, pos, sl, s, e, ...); a NULL ``s``
        is a target whose value is unknown."""

        def make() -> DataFrame:
            keys = ["file_id", "grp", "stmt"]
            base = self.elements.where(F.col("ranged") == 0).join(self.sides, keys)
            typed = F.col("is_var") & (F.col("side") == 0)
            name_ok = (F.col("kind") == "ident") & ((F.col("n") == 1) | typed) & (F.col("text") != "_")
            targets = base.where((F.col("side") == 0) & name_ok).select(
                *keys, "no", "is_var", "op_idx", F.col("text").alias("name"), F.col("s").alias("pos"), "sl", "targets", "given"
            )
            values = self.elements.where((F.col("side") == 1) & (F.col("ranged") == 0)).select(
                *keys, "no", "s", "e", "n", "plus", "x_src", F.col("text").alias("first"), F.col("kind").alias("first_kind"), "last", "last_kind", "before_last"
            )
            paired = F.col("targets") == F.col("given")
            return targets.join(values, [*keys, "no"], "left").withColumns({
                c: F.when(paired, F.col(c)) for c in ("s", "e", "n", "plus", "x_src", "first", "first_kind", "last", "last_kind", "before_last")
            })

        return self._once("assigned", make, kept=True)

    @property
    def bindings(self) -> DataFrame:
        """bindings(file_id, pos, name, at, scope_level, is_barrier, s, e, ...) inside functions.

        ``decl`` is where the binding is written and ``pos`` where it takes effect; from
        ``at`` on it is seen, in the scope then open at ``scope_level``.
        """

        def make() -> DataFrame:
            inner = self.assigned.withColumn("decl", F.col("pos"))
            placed = st.enclosing_at(
                inner.select("file_id", F.col("pos").alias("idx"), "sl", "name"), self.scope_openers, "sl"
            ).select("file_id", F.col("idx").alias("decl"), "name", "scope")
            out = inner.join(placed, ["file_id", "decl", "name"])
            # The post statement of a for: it follows the second ; of the header.
            heads = self.grouped.where(F.col("head") == "for").select("file_id", F.col("grp"), F.col("head_idx").alias("scope"), F.col("idx").alias("body"))
            semis = self.grouped.where((F.col("text") == ";") & (F.col("kind") == "op")).select("file_id", "grp", F.col("idx").alias("semi"))
            # Header semicolons of a loop are the two written ones between word and body.
            loops = heads.join(semis, ["file_id", "grp"]).where(F.col("semi").between(F.col("scope"), F.col("body"))).groupBy("file_id", "scope", "body").agg(
                F.max("semi").alias("second"), F.min("semi").alias("first_semi")
            )
            ends = self.grouped.where(F.col("closes") == "for").select("file_id", F.col("closes_open").alias("body"), F.col("idx").alias("end"))
            loops = loops.join(ends, ["file_id", "body"])
            out = out.join(loops, ["file_id", "scope"], "left").withColumn(
                "post", F.coalesce((F.col("decl") > F.col("second")) & (F.col("decl") < F.col("body")) & (F.col("first_semi") < F.col("second")), F.lit(False))
            )
            defined = out.where(F.col("first_semi").isNotNull() & (F.col("decl") < F.col("first_semi"))).select("file_id", "scope", "name").distinct()
            own = out.where(~F.col("post")).withColumn("scope_level", F.col("sl"))
            # It runs behind the body, and what it sets is seen behind the loop.
            post = out.where("post").join(defined, ["file_id", "scope", "name"], "left_anti").withColumns({"pos": F.col("end"), "scope_level": F.col("sl") - 1})
            cols = ["file_id", "pos", "decl", "name", "sl", F.col("pos").alias("at"), "scope_level", F.col("s").isNull().alias("is_barrier"), "s", "e", "n", "plus", "x_src", "first", "first_kind"]
            return own.select(*cols).unionByName(post.select(*cols)).unionByName(self._range_barriers(), allowMissingColumns=True)

        return self._once("bindings", make, kept=True)

    @property
    def ranges(self) -> DataFrame:
        """Loop variables of range statements: (file_id, name, no, pos, body, s, e, ...)."""

        def make() -> DataFrame:
            e = self.elements.where((F.col("ranged") == 1) & F.col("op_idx").isNotNull())
            bodies = self.grouped.where(F.col("head") == "for").select("file_id", "grp", F.col("idx").alias("body"), F.col("head_idx").alias("word"), F.col("sl").alias("body_sl"))
            starts = self.grouped.where((F.col("text") == "for") & (F.col("kind") == "keyword")).select("file_id", "grp", "stmt", F.col("idx").alias("word"))
            closes = self.grouped.where(F.col("closes") == "for").select("file_id", F.col("closes_open").alias("body"), F.col("idx").alias("close_idx"))
            where = starts.join(bodies, ["file_id", "grp", "word"]).join(closes, ["file_id", "body"])
            vars_ = e.where((F.col("side") == 0) & (F.col("n") == 1) & (F.col("kind") == "ident") & (F.col("text") != "_")).select(
                "file_id", "grp", "stmt", F.col("text").alias("name"), "no", F.col("s").alias("pos"), "sl"
            )
            over = e.where(F.col("side") == 1).select("file_id", "grp", "stmt", (F.col("s") + 1).alias("s"), "e")
            return vars_.join(where, ["file_id", "grp", "stmt"]).join(over, ["file_id", "grp", "stmt"], "left")

        return self._once("ranges", make, kept=True)

    def _range_barriers(self) -> DataFrame:
        return self.ranges.select(
            "file_id", "pos", F.col("pos").alias("decl"), "name", "sl", F.col("body").alias("at"), (F.col("body_sl") + 1).alias("scope_level"),
            F.lit(True).alias("is_barrier"),
        )

    def see(self, points: DataFrame) -> DataFrame:
        """points(file_id, idx, sl, point_id, name) → visible bindings of the function."""
        return sweeps.visible(points, self.bindings, self.scope_openers, "sl", in_function=True)

    def at(self, points: DataFrame) -> DataFrame:
        """Adds the scope level at ``idx``."""
        return points.join(self.levels, ["file_id", "idx"])

    @staticmethod
    def is_reference() -> Column:
        key = (F.col("n1") == ":") & (F.col("grp_text") == "{")
        return (F.col("kind") == "ident") & (F.col("p1") != ".") & (F.col("n1") != "(") & (F.col("text") != "_") & ~key

    @property
    def source_files(self) -> DataFrame:
        return self._once("source_files", lambda: self.tokens.where(F.col("f_src")).select("file_id").distinct())

    def used_names(self, spans: DataFrame) -> DataFrame:
        """Variables read in spans(file_id, start_idx, end_idx, ...)."""
        kept = [c for c in spans.columns if c not in ("file_id", "start_idx", "end_idx")]
        used = sweeps.marks_in_spans(spans, self.mentions, "text", kept, ["text"])
        return used.withColumnRenamed("text", "used").distinct()

    @property
    def mentions(self) -> DataFrame:
        """Identifiers that read a variable, in files with a source."""
        return self._once("mentions", lambda: self.tokens.where(self.is_reference()).join(self.source_files, "file_id", "left_semi").select("file_id", "idx", "text"))

    @property
    def tainted(self) -> DataFrame:
        """(file_id, pos, name) of bindings a lower-trust source can reach."""

        def make() -> DataFrame:
            values = self.bindings.where(~F.col("is_barrier")).join(self.source_files, "file_id", "left_semi")
            used = self.used_names(values.select("file_id", "pos", "name", F.col("s").alias("start_idx"), F.col("e").alias("end_idx")))
            points = self.at(used.select("file_id", F.col("pos").alias("idx"), F.col("pos").alias("point_id"), F.col("used").alias("name")).distinct())
            seen = self.see(points).where(~F.col("is_barrier")).select(
                "file_id", F.col("point_id").alias("pos"), F.col("name").alias("used"), F.col("pos").alias("to_pos"), F.col("name").alias("to_name")
            )
            edges = used.join(seen, ["file_id", "pos", "used"]).drop("used")
            return flow.tainted_bindings(
                values.select("file_id", "pos", "name", (F.col("x_src") > 0).alias("has_source")), edges
            ).distinct()

        return self._once("tainted", make, kept=True)

    def tainted_sinks(self, sinks: DataFrame) -> DataFrame:
        """Ids of sinks(file_id, sink_id, idx, s, e, x_src) a source reaches, seen from idx."""
        direct = sinks.where(F.col("x_src") > 0).select("file_id", "sink_id")
        spans = sinks.where(F.col("x_src") == 0).join(self.source_files, "file_id", "left_semi").select(
            "file_id", "sink_id", F.col("idx").alias("at"), F.col("s").alias("start_idx"), F.col("e").alias("end_idx")
        )
        used = self.used_names(spans)
        points = self.at(used.select("file_id", F.col("at").alias("idx"), F.col("sink_id").alias("point_id"), F.col("used").alias("name")).distinct())
        seen = self.see(points).where(~F.col("is_barrier")).select("file_id", "point_id", "pos", "name")
        via = seen.join(self.tainted, ["file_id", "pos", "name"], "left_semi").select("file_id", F.col("point_id").alias("sink_id"))
        return direct.unionByName(via).distinct()

    @property
    def alias_values(self) -> DataFrame:
        """Alias chains followed: (file_id, pos, name, s, e, plus, first, first_kind, x_src)."""

        def make() -> DataFrame:
            held = self.bindings.where(~F.col("is_barrier"))
            plain = held.where((F.col("s") == F.col("e")) & (F.col("first_kind") == "ident"))
            points = self.at(plain.select("file_id", F.col("pos").alias("idx"), F.col("pos").alias("point_id"), F.col("first").alias("name")).distinct())
            seen = self.see(points).where(~F.col("is_barrier")).select(
                "file_id", F.col("point_id").alias("pos"), F.col("name").alias("first"), F.col("pos").alias("to_pos"), F.col("name").alias("to_name")
            )
            links = plain.select("file_id", "pos", "name", "first").join(seen, ["file_id", "pos", "first"]).where(F.col("name") != F.col("to_name"))
            ends = flow.alias_ends(links)
            first = held.select("file_id", "pos", "name").distinct().join(ends, ["file_id", "pos", "name"], "left")
            first = first.withColumns({"end_pos": F.coalesce("end_pos", "pos"), "end_name": F.coalesce("end_name", "name")})
            values = held.select("file_id", F.col("pos").alias("end_pos"), F.col("name").alias("end_name"), "s", "e", "plus", "first", "first_kind", "x_src")
            return first.join(values, ["file_id", "end_pos", "end_name"]).drop("end_pos", "end_name")

        return self._once("alias_values", make, kept=True)

    def resolve(self, spans: DataFrame) -> DataFrame:
        """Follows a span that is one name to its visible value.

        spans(file_id, ref_id, idx, s, e, first, first_kind, plus, x_src), seen from
        ``idx`` → the same columns with the value's span, and ``aliased``.
        """
        single = spans.where((F.col("s") == F.col("e")) & (F.col("first_kind") == "ident"))
        points = self.at(single.select("file_id", "idx", F.col("ref_id").alias("point_id"), F.col("first").alias("name")).distinct())
        seen = self.see(points).where(~F.col("is_barrier")).select("file_id", F.col("point_id").alias("ref_id"), "pos", "name")
        fields = ["s", "e", "plus", "first", "first_kind", "x_src"]
        found = seen.join(self.alias_values, ["file_id", "pos", "name"]).select(
            "file_id", "ref_id", *[F.col(c).alias(f"to_{c}") for c in fields], F.lit(True).alias("aliased")
        )
        out = spans.join(found, ["file_id", "ref_id"], "left")
        return out.withColumns({c: F.when(F.col("aliased"), F.col(f"to_{c}")).otherwise(F.col(c)) for c in fields}).withColumn(
            "aliased", F.coalesce("aliased", F.lit(False))
        ).drop(*[f"to_{c}" for c in fields])

    # ---- composite literals ----------------------------------------------------------

    @property
    def literals(self) -> DataFrame:
        """Package-typed literals: (file_id, module, type_name, anchor, open_idx, close_idx)."""

        def make() -> DataFrame:
            opened = self.grouped.where(
                (F.col("text") == "{") & F.col("head").isNull() & (F.col("p2") == ".") & (F.col("p4") != ".") & (F.col("pk1") == "ident")
            ).select("file_id", F.col("idx").alias("open_idx"), (F.col("idx") - 3).alias("anchor"), F.col("p1").alias("type_name"), F.col("p3").alias("local"))
            pairs = st.pairs(self.rows).where(F.col("kind") == "{").select("file_id", "open_idx", "close_idx")
            return opened.join(self.imports, ["file_id", "local"]).join(pairs, ["file_id", "open_idx"])

        return self._once("literals", make, kept=True)

    @property
    def fields(self) -> DataFrame:
        """Keyed fields of literals: (file_id, open_idx, field, value, value_kind);
        the value is given only when it is one token."""
        keyed = self.tokens.where((F.col("kind") == "ident") & (F.col("n1") == ":") & (F.col("grp_text") == "{") & F.col("p1").isin("{", ",", ";"))
        lone = F.col("n3").isin(",", "}", ";")
        return keyed.join(self.literals.select("file_id", F.col("open_idx").alias("grp")).distinct(), ["file_id", "grp"], "left_semi").select(
            "file_id", F.col("grp").alias("open_idx"), F.col("text").alias("field"), F.when(lone, F.col("n2")).alias("value"),
            F.when(lone, F.col("nk2")).alias("value_kind"),
        )

    def static_lists(self, spans: DataFrame) -> DataFrame:
        """Spans(file_id, ref_id, s, e) that are []string literals of plain strings."""
        starts = spans.join(self.grouped.select("file_id", F.col("idx").alias("s"), F.col("text").alias("t0"), F.col("n1").alias("t1"), F.col("n2").alias("t2")), ["file_id", "s"])
        shaped = starts.where((F.col("t0") == "[") & (F.col("t1").isin("]")) & (F.col("t2") == "string")).withColumn("grp", F.col("s") + 3)
        sized = starts.where((F.col("t0") == "[") & (F.col("t1") != "]")).withColumn("grp", F.col("s") + 4)
        both = shaped.unionByName(sized.join(
            self.grouped.where((F.col("text") == "{") & (F.col("p1") == "string") & (F.col("p2") == "]")).select("file_id", F.col("idx").alias("grp")), ["file_id", "grp"], "left_semi"
        ))
        whole = both.join(self.grouped.where(F.col("text") == "}").select("file_id", F.col("closes_open").alias("grp"), F.col("idx").alias("e2")), ["file_id", "grp"]).where(F.col("e2") == F.col("e"))
        parts = self.tokens.where(F.col("grp_text") == "{").groupBy("file_id", "grp").agg(
            F.bool_and((F.col("kind") == "string") | F.col("text").isin(",", ";")).alias("plain"),
            F.bool_or(F.col("kind") == "string").alias("some"),
        ).where("plain and some")
        return whole.join(parts, ["file_id", "grp"], "left_semi").select("file_id", "ref_id")
