"""Go rule pack: twenty-one rules over the tables of ``code_go``."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.functions import names
from codesift.functions.text import any_of_folded, clipped, is_shell_mode, safe_segment_pattern, world_writable
from codesift.operators import flow
from codesift.operators import structure as st
from codesift.operators import sweeps
from codesift.operators.code_go import GoTables, literal
from codesift.schema import RAW_COLUMNS
from codesift.session import keep

TODO_WORDS = ["todo", "fixme", "hack", "xxx"]
CONTROL_WORDS = ["auth", "permission", "authoriz", "saniti", "secur", "secret", "token", "credential"]
FILE_SINKS = ["Open", "OpenFile", "ReadFile", "WriteFile", "Create", "Remove", "RemoveAll", "Mkdir", "MkdirAll", "Rename"]
DB_DIRECT = ["Exec", "Query", "QueryRow", "Raw", "Where", "Order", "Select"]
DB_CONTEXT = ["ExecContext", "QueryContext", "QueryRowContext"]
EVIDENCE_TOKENS = 281

# Order in which the rules look at one node.
RULE_ORDER = [
    "GO001", "GO008", "GO014", "GO018", "GO002", "GO019", "GO021", "GO003", "GO004", "GO006", "GO007", "GO016",
    "GO017", "GO009", "GO010", "GO011", "GO005",
]
# Rules reported after the walk over the nodes.
LATE = {"GO022": 1, "GO015": 2, "GO013": 3, "GO012": 4}


def _hits(df: DataFrame, rule: str, from_col: Column, to_col: Column) -> DataFrame:
    return df.select("file_id", F.lit(rule).alias("rule_id"), from_col.cast("int").alias("from_idx"), to_col.cast("int").alias("to_idx"))


def _calls(df: DataFrame, rule: str) -> DataFrame:
    return _hits(df, rule, F.col("anchor"), F.col("close_idx"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _one_token(kind: str) -> Column:
    return (F.col("start_idx") == F.col("end_idx")) & (F.col("first_kind") == kind)


# ---- literals ---------------------------------------------------------------------


def literal_rules(t: GoTables) -> DataFrame:
    """GO001, GO008, GO014, GO018: fields of package-typed literals."""
    field, value = F.col("field"), F.col("value")
    facts = t.fields.groupBy("file_id", "open_idx").agg(
        F.bool_or((field == "InsecureSkipVerify") & (value == "true")).alias("skip"),
        F.bool_or(field == "Timeout").alias("timeout"),
        F.bool_or(field.isin("ReadHeaderTimeout", "ReadTimeout", "WriteTimeout", "IdleTimeout")).alias("server_timeout"),
        F.bool_or((field == "Secure") & (value == "true")).alias("secure"),
        F.bool_or((field == "HttpOnly") & (value == "true")).alias("http_only"),
        F.max(F.when((field == "Name") & (F.col("value_kind") == "string"), literal(value))).alias("name"),
    )
    flags = ["skip", "timeout", "server_timeout", "secure", "http_only"]
    lits = t.literals.join(facts, ["file_id", "open_idx"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})
    kind = F.concat_ws(".", "module", "type_name")
    cookie = (kind == "net/http.Cookie") & names.go_value_name(F.col("name")) & ~(F.col("secure") & F.col("http_only"))
    tests = {
        "GO001": (kind == "crypto/tls.Config") & F.col("skip"),
        "GO008": (kind == "net/http.Client") & ~F.col("timeout"),
        "GO014": (kind == "net/http.Server") & ~F.col("server_timeout"),
        "GO018": F.coalesce(cookie, F.lit(False)),
    }
    hit = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in tests.items()]))
    return lits.select("file_id", F.explode(hit).alias("rule_id"), F.col("anchor").cast("int").alias("from_idx"), F.col("close_idx").cast("int").alias("to_idx"))


# ---- calls without data flow --------------------------------------------------------


def plain_calls(t: GoTables) -> DataFrame:
    """GO006, GO007, GO009, GO011."""
    body = t.with_arg(t.calls_of("io", "ReadAll").where(F.col("n_args") == 1), 0).where(
        (F.col("last") == "Body") & (F.col("before_last") == ".")
    )
    defaults = t.calls_of("net/http", "Get", "Post", "PostForm")
    marked = t.with_arg(t.calls_of("html/template", "HTML").where(F.col("n_args") == 1), 0).where(~_one_token("string"))
    modes = t.calls_of("os", "WriteFile", "OpenFile", "Mkdir", "MkdirAll")
    number = F.when(F.col("method").isin("WriteFile", "OpenFile"), F.lit(2)).otherwise(F.lit(1))
    open_modes = t.with_arg(modes, number).where(_one_token("number") & world_writable(F.col("first")))
    return _union([_calls(body, "GO006"), _calls(defaults, "GO007"), _calls(marked, "GO009"), _calls(open_modes, "GO011")])


def sensitive_args(t: GoTables) -> DataFrame:
    """GO010 and GO021: sensitive names in arguments, outside sanitizer calls."""
    logs = _union([
        t.calls_of("log", "Print", "Printf", "Println"), t.calls_of("log/slog", "Debug", "Info", "Warn", "Error", "Log"),
        t.calls_of("fmt", "Print", "Printf", "Println", "Fprint", "Fprintf", "Fprintln"),
    ]).withColumn("rule_id", F.lit("GO010"))
    sums = _union([t.calls_of("crypto/md5", "Sum"), t.calls_of("crypto/sha1", "Sum")]).where(F.col("n_args") == 1).withColumn("rule_id", F.lit("GO021"))
    calls = logs.unionByName(sums)
    spans = calls.join(t.args.where(F.col("x_log") > 0), ["file_id", "open_idx"]).select(
        "file_id", "rule_id", "anchor", "close_idx", "start_idx", "end_idx"
    )
    files = spans.select("file_id").distinct()
    shields = t.seps.where((F.col("role") == "open") & F.lower("p1").isin(names.LOG_SANITIZERS) & F.col("close_idx").isNotNull()).select(
        "file_id", (F.col("idx") - 1).alias("start_idx"), F.col("close_idx").alias("end_idx")
    ).join(files, "file_id", "left_semi")
    named = t.tokens.where(F.col("f_log")).join(files, "file_id", "left_semi").select("file_id", "idx", "text")
    raw = flow.first_in_span(spans, flow.not_covered(named, shields), "text")
    return raw.select("file_id", "rule_id", F.col("anchor").cast("int").alias("from_idx"), F.col("close_idx").cast("int").alias("to_idx")).distinct()


def fatal_calls(t: GoTables) -> DataFrame:
    """GO012: the process ends inside a function of a package other than main."""
    calls = _union([t.calls_of("log", "Fatal", "Fatalf", "Fatalln"), t.calls_of("os", "Exit")]).withColumn("idx", F.col("anchor").cast("int"))
    package = t.tokens.where((F.col("idx") == 0) & (F.col("text") == "package") & (F.col("n1") != "main")).select("file_id")
    placed = st.enclosing_at(t.at(calls.join(package, "file_id", "left_semi")), t.scope_openers, "sl", F.lit(1))
    inside = placed.join(t.declared.where(F.col("name") != "init").select("file_id", "scope"), ["file_id", "scope"], "left_semi")
    return _calls(inside, "GO012")


def random_values(t: GoTables) -> DataFrame:
    """GO005: sensitive names set from the predictable generator."""
    keys = ["file_id", "grp", "stmt"]
    generators = t.calls_of("math/rand").select("file_id", F.col("anchor").alias("s"), F.col("close_idx").alias("e"), "method", "open_idx", "n_args")
    values = t.elements.where(F.col("side") == 1).join(generators, ["file_id", "s", "e"]).select(*keys, "no", "method", "open_idx", "n_args", F.col("is_var").alias("var_value"))
    # Target name: a plain name, or the last part of a selector.
    named = t.elements.where(F.col("side") == 0)
    name = F.when(F.col("is_var"), F.col("text")).when(F.col("n") == 1, F.when(F.col("kind") == "ident", F.col("text"))).when(
        (F.col("last_kind") == "ident") & (F.col("before_last") == "."), F.col("last")
    )
    targets = named.select(*keys, "no", name.alias("name"))
    pairs = values.join(t.sides.where(F.col("targets") == F.col("given")), keys).join(targets, [*keys, "no"]).where(names.go_value_name(F.col("name")))
    buffers = values.where((F.col("method") == "Read") & (F.col("n_args") == 1) & ~F.col("var_value")).withColumn("arg_no", F.lit(0)).join(
        t.args.select("file_id", "open_idx", "arg_no", "start_idx", "end_idx", "first", "first_kind", "last", "before_last"), ["file_id", "open_idx", "arg_no"]
    )
    filled = buffers.where(names.go_value_name(F.when(_one_token("ident"), F.col("first")).when(F.col("before_last") == ".", F.col("last")))).join(t.sides, keys)
    return _hits(pairs, "GO005", F.col("from_idx"), F.col("to_idx")).unionByName(_hits(filled, "GO005", F.col("from_idx"), F.col("to_idx"))).distinct()


# ---- calls with aliases and taint ---------------------------------------------------


def _spans(df: DataFrame, ref: Column) -> DataFrame:
    """Argument rows as input of ``resolve``: seen from the start of the call."""
    return df.withColumns({
        "ref_id": ref, "idx": F.col("anchor").cast("int"), "s": F.col("start_idx"), "e": F.col("end_idx"),
    })


def shell_commands(t: GoTables) -> DataFrame:
    """GO002: a shell reads a command that is not one literal."""
    calls = t.calls_of("os/exec", "Command", "CommandContext").withColumn("at", F.when(F.col("method") == "Command", F.lit(0)).otherwise(F.lit(1)))
    lit = t.args.where(_one_token("string")).select("file_id", "open_idx", "arg_no", literal(F.col("first")).alias("value"))
    shells = calls.join(lit.select("file_id", "open_idx", F.col("arg_no").alias("at"), F.col("value").alias("shell")), ["file_id", "open_idx", "at"])
    flags = shells.withColumn("arg_no", F.col("at") + 1).join(lit, ["file_id", "open_idx", "arg_no"]).where(is_shell_mode(F.col("shell"), F.col("value")))
    commands = t.with_arg(flags.drop("arg_no", "value"), F.col("at") + 2).withColumn("plus", F.lit(False))
    found = t.resolve(_spans(commands, F.col("open_idx").cast("string")))
    return _calls(found.where(~((F.col("s") == F.col("e")) & (F.col("first_kind") == "string"))), "GO002")


def dynamic_sql(t: GoTables) -> DataFrame:
    """GO003: query text built by + or a format call, in files that import a database."""
    module = F.col("module")
    db = t.imports.where(
        (module == "database/sql") | F.contains(module, F.lit("gorm.io/")) | F.endswith(module, F.lit("/gorm")) | F.contains(module, F.lit("sqlx"))
    ).select("file_id").distinct()
    calls = t.seps.where(
        (F.col("role") == "open") & (F.col("p2") == ".") & F.col("p1").isin(DB_DIRECT + DB_CONTEXT) & F.col("close_idx").isNotNull()
    ).join(db, "file_id", "left_semi").select("file_id", F.col("idx").alias("open_idx"), "close_idx", F.col("p1").alias("method"))
    # Where the receiver begins: the last token that does not continue a chain.
    w = Window.partitionBy("file_id", "grp").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    hangs = (F.col("p1") == ".") | (F.col("text") == ".") | (
        F.col("text").isin("(", "[") & (F.col("pk1").isin("ident") | F.col("p1").isin(")", "]", "}"))
    ) | F.col("text").isin(")", "]")
    chains = t.grouped.withColumn("begin", F.max(F.when(~hangs, F.col("idx"))).over(w)).where(F.col("text") == "(").select(
        "file_id", F.col("idx").alias("open_idx"), F.col("begin").alias("anchor")
    )
    calls = calls.join(chains, ["file_id", "open_idx"])
    texts = t.with_arg(calls, F.when(F.col("method").isin(DB_CONTEXT), F.lit(1)).otherwise(F.lit(0)))
    plus = t.tokens.where((F.col("text") == "+") & (F.col("pk1").isin("ident", "string", "number", "rune") | F.col("p1").isin(")", "]", "}"))).select(
        "file_id", F.col("grp").alias("open_idx"), F.col("idx").alias("plus_idx")
    )
    weak = t.tokens.where(F.col("text").isin("==", "!=", "<", "<=", ">", ">=", "&&", "||")).select("file_id", F.col("grp").alias("open_idx"), F.col("idx").alias("weak_idx"))

    def inside(marks: DataFrame, col: str) -> DataFrame:
        # Operators directly in this call's brackets, attributed to the argument they lie in.
        joined = texts.select("file_id", "open_idx", "start_idx", "end_idx").join(marks, ["file_id", "open_idx"])
        return joined.where(F.col(col).between(F.col("start_idx"), F.col("end_idx"))).select("file_id", "open_idx").distinct()

    added = inside(plus, "plus_idx").join(inside(weak, "weak_idx"), ["file_id", "open_idx"], "left_anti").withColumn("plus", F.lit(True))
    texts = texts.join(added, ["file_id", "open_idx"], "left").withColumn("plus", F.coalesce("plus", F.lit(False)))
    found = t.resolve(_spans(texts, F.col("open_idx").cast("string")))
    formats = t.calls_of("fmt", "Sprintf", "Sprint", "Sprintln").select("file_id", F.col("anchor").alias("s"), F.col("close_idx").alias("e"), F.lit(True).alias("formatted"))
    out = found.join(formats, ["file_id", "s", "e"], "left").where(F.col("plus") | F.coalesce("formatted", F.lit(False)))
    return _calls(out, "GO003")


def tainted_args(t: GoTables) -> DataFrame:
    """GO016, GO017, GO019 and GO022: a source reaches an argument."""
    t.beside(lambda: t.tainted, lambda: t.api_calls, lambda: t.declared)
    get = t.with_arg(t.calls_of("net/http", "Get", "Head", "Post", "PostForm"), 0).withColumn("rule_id", F.lit("GO016"))
    redirect = t.with_arg(t.calls_of("net/http", "Redirect").where(F.col("n_args") >= 4), 2).withColumn("rule_id", F.lit("GO017"))
    run = t.calls_of("os/exec", "Command", "CommandContext")
    program = t.with_arg(run, F.when(F.col("method") == "Command", F.lit(0)).otherwise(F.lit(1))).withColumn("rule_id", F.lit("GO019"))
    headers = header_sets(t)
    origin = headers.where(F.col("header") == "access-control-allow-origin").withColumn("rule_id", F.lit("GO022"))
    cols = ["file_id", "rule_id", "anchor", "close_idx", "open_idx", "start_idx", "end_idx", "x_src"]
    sinks = _union([df.select(*cols) for df in (get, redirect, program, origin)]).withColumns({
        "sink_id": F.concat_ws(":", "rule_id", "open_idx"), "idx": F.col("anchor").cast("int"), "s": F.col("start_idx"), "e": F.col("end_idx"),
    })
    sinks = keep(sinks)
    reached = sinks.join(t.tainted_sinks(sinks), ["file_id", "sink_id"], "left_semi")
    plain = reached.where(F.col("rule_id") != "GO022").select(
        "file_id", "rule_id", F.col("anchor").cast("int").alias("from_idx"), F.col("close_idx").cast("int").alias("to_idx")
    )
    # Both headers inside one declared function; the last origin is reported.
    true_text = F.lower(F.trim(literal(F.col("first")))) == "true"
    allowed = headers.where((F.col("header") == "access-control-allow-credentials") & _one_token("string") & true_text)
    both = reached.where(F.col("rule_id") == "GO022").select("file_id", "idx", "close_idx", F.lit(False).alias("cred")).unionByName(
        allowed.select("file_id", F.col("anchor").cast("int").alias("idx"), "close_idx", F.lit(True).alias("cred"))
    )
    placed = st.enclosing_at(t.at(both), t.scope_openers, "sl", F.lit(1)).join(t.declared.select("file_id", "scope"), ["file_id", "scope"], "left_semi")
    cors = placed.groupBy("file_id", "scope").agg(
        F.max(F.when(~F.col("cred"), F.struct("idx", "close_idx"))).alias("at"), F.bool_or("cred").alias("cred")
    ).where(F.col("cred") & F.col("at").isNotNull())
    return plain.unionByName(_hits(cors, "GO022", F.col("at.idx"), F.col("at.close_idx")))


def header_sets(t: GoTables) -> DataFrame:
    """Calls w.Header().Set("name", value): the value argument and the lower-cased name."""
    opened = t.seps.where(
        (F.col("role") == "open") & (F.col("p1") == "Set") & (F.col("p2") == ".") & (F.col("p3") == ")") & (F.col("p4") == "(")
        & (F.col("p5") == "Header") & (F.col("p6") == ".") & F.col("close_idx").isNotNull()
    ).select("file_id", F.col("idx").alias("open_idx"), "close_idx")
    named = t.args.where((F.col("arg_no") == 0) & _one_token("string")).select("file_id", "open_idx", F.lower(literal(F.col("first"))).alias("header"))
    w = Window.partitionBy("file_id", "grp").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    hangs = (F.col("p1") == ".") | F.col("text").isin(".", "(", "[", ")", "]")
    chains = t.grouped.withColumn("begin", F.max(F.when(~hangs, F.col("idx"))).over(w)).where(F.col("text") == "(").select(
        "file_id", F.col("idx").alias("open_idx"), F.col("begin").alias("anchor")
    )
    return t.with_arg(opened.join(named, ["file_id", "open_idx"]).join(chains, ["file_id", "open_idx"]), 1)


def trusted_names(t: GoTables) -> DataFrame:
    """trusted(file_id, name, scope, from_idx, form): loop variables over constant
    lists, directory entries, and names behind a strict pattern guard."""
    ranges = t.ranges.where((F.col("no") == 1) & F.col("s").isNotNull()).select("file_id", "name", "pos", "body", "s", "e", "word", "close_idx")
    firsts_of = ranges.join(t.grouped.select("file_id", F.col("idx").alias("s"), F.col("text").alias("first"), F.col("kind").alias("first_kind")), ["file_id", "s"])

    def spans_of(heads: DataFrame) -> DataFrame:
        return heads.withColumns({
            "ref_id": F.col("body").cast("string"), "idx": F.col("word"), "plus": F.lit(False), "x_src": F.lit(0),
        })

    firsts = t._once("range_heads", lambda: firsts_of, kept=True)
    spans = t._once("range_spans", lambda: t.resolve(spans_of(firsts)).select(
        "file_id", "ref_id", "s", "e", "aliased", "name", "body"
    ), kept=True)
    direct = t.static_lists(spans_of(firsts).select("file_id", "ref_id", "s", "e"))
    followed = t.static_lists(spans.where("aliased").select("file_id", "ref_id", "s", "e"))
    lists = spans.join(direct.unionByName(followed).distinct(), ["file_id", "ref_id"], "left_semi").select(
        "file_id", "name", F.col("body").alias("scope"), F.lit(-1).alias("from_idx"), F.lit("name").alias("form")
    )
    # Variables assigned exactly once in the declared function, by a directory listing.
    reads = t.calls_of("os", "ReadDir").select("file_id", F.col("anchor").alias("s"), F.col("close_idx").alias("e"))
    lone = t.elements.where((F.col("side") == 1) & ~F.col("is_var")).join(reads, ["file_id", "s", "e"]).join(
        t.sides.where(F.col("given") == 1), ["file_id", "grp", "stmt"]
    ).select("file_id", "grp", "stmt")
    targets = t.elements.where((F.col("side") == 0) & (F.col("n") == 1) & (F.col("kind") == "ident") & (F.col("text") != "_") & ~F.col("is_var") & (F.col("ranged") == 0))
    targets = targets.join(lone.withColumn("listing", F.lit(True)), ["file_id", "grp", "stmt"], "left").select(
        "file_id", F.col("s").alias("idx"), "sl", F.col("text").alias("name"), (F.col("listing").isNotNull() & (F.col("no") == 0)).alias("listing")
    )
    counted = st.enclosing_at(targets, t.scope_openers, "sl", F.lit(1)).groupBy("file_id", "scope", "name").agg(
        F.count(F.lit(1)).alias("times"), F.bool_or("listing").alias("listing")
    ).where((F.col("times") == 1) & F.col("listing"))
    over = firsts.where((F.col("s") == F.col("e")) & (F.col("first_kind") == "ident"))
    over = st.enclosing_at(t.at(over.withColumn("idx", F.col("pos"))), t.scope_openers, "sl", F.lit(1))
    entries = over.join(counted.select("file_id", "scope", F.col("name").alias("first")), ["file_id", "scope", "first"], "left_semi").select(
        "file_id", "name", F.col("body").alias("scope"), F.lit(-1).alias("from_idx"), F.lit("entry").alias("form")
    )
    guarded = t._once("guarded", lambda: _guarded(t), kept=True)
    return lists.unionByName(entries).unionByName(guarded).distinct()


def _guarded(t: GoTables) -> DataFrame:
    """Names checked by ``if !strict.MatchString(name) { ... return }`` in a body's own statements."""
    vars_ = t.elements.where((F.col("grp") == -1) & F.col("is_var") & (F.col("side") == 0)).select("file_id", "grp", "stmt", "no", F.col("text").alias("var"))
    grouped_vars = t.elements.where((F.col("grp") != -1) & F.col("is_var") & (F.col("side") == 0) & (F.col("sl") == 0)).select("file_id", "grp", "stmt", "no", F.col("text").alias("var"))
    made = t.with_arg(t.calls_of("regexp", "MustCompile").where(F.col("n_args") == 1), 0).where(_one_token("string") & safe_segment_pattern(literal(F.col("first"))))
    values = t.elements.where(F.col("side") == 1).join(made.select("file_id", F.col("anchor").alias("s"), F.col("close_idx").alias("e")), ["file_id", "s", "e"])
    strict = vars_.unionByName(grouped_vars).join(values.select("file_id", "grp", "stmt", "no"), ["file_id", "grp", "stmt", "no"]).select("file_id", "var")
    changed = t.elements.where((F.col("side") == 0) & ~F.col("is_var") & (F.col("n") == 1)).select("file_id", F.col("text").alias("var"))
    stepped = t.tokens.where(F.col("text").isin("++", "--")).select("file_id", F.col("p1").alias("var"))
    strict = strict.join(changed.unionByName(stepped).distinct(), ["file_id", "var"], "left_anti").distinct()
    g = t.grouped
    w = Window.partitionBy("file_id", "grp").orderBy("idx")
    ahead = {f"g{i}": F.lead("text", i).over(w) for i in range(1, 8)} | {"i7": F.lead("idx", 7).over(w), "i8": F.lead("idx", 8).over(w), "g9": F.lead("text", 9).over(w)}
    # if ! strict . MatchString ( ) { }  — brackets hold one name.
    conds = g.withColumns(ahead).where(
        (F.col("text") == "if") & (F.col("p1") != "else") & (F.col("g1") == "!") & (F.col("g3") == ".") & (F.col("g4") == "MatchString") & (F.col("g5") == "(")
        & (F.col("g6") == ")") & (F.col("g7") == "{") & (F.coalesce("g9", F.lit("")) != "else")
    ).select("file_id", "idx", F.col("grp").alias("scope"), F.col("g2").alias("var"), F.col("i7").alias("body"), F.col("i8").alias("end"))
    asked = t.tokens.where((F.col("p2") == "MatchString") & (F.col("p1") == "(") & (F.col("n1") == ")") & (F.col("kind") == "ident")).select(
        "file_id", (F.col("idx") - 6).alias("idx"), F.col("text").alias("name")
    )
    guards = conds.join(asked, ["file_id", "idx"]).join(strict, ["file_id", "var"], "left_semi").join(
        t.declared.select("file_id", "scope", F.col("close_idx").alias("fn_end")), ["file_id", "scope"]
    )
    guards = keep(guards)
    # The guard's body must end with a return statement.
    inner = g.where(F.col("grp_text") == "{").join(guards.select("file_id", F.col("body").alias("grp")).distinct(), ["file_id", "grp"], "left_semi")
    solid = inner.where(F.col("text") != ";").groupBy("file_id", "grp").agg(F.max(F.when(F.col("text") == "return", F.col("idx"))).alias("ret"), F.max("idx").alias("last"))
    semis = inner.where(F.col("text") == ";").select("file_id", "grp", F.col("idx").alias("semi"))
    broken = solid.join(semis, ["file_id", "grp"]).where((F.col("semi") > F.col("ret")) & (F.col("semi") < F.col("last"))).select("file_id", "grp")
    ends = solid.where(F.col("ret").isNotNull()).join(broken, ["file_id", "grp"], "left_anti").select("file_id", F.col("grp").alias("body"))
    guards = guards.join(ends, ["file_id", "body"], "left_semi")
    # Later writes to the name inside the function cancel the guard.
    writes = _union([
        t.elements.where((F.col("side") == 0) & (F.col("kind") == "ident") & ((F.col("n") == 1) | F.col("is_var"))).select("file_id", F.col("s").alias("idx"), F.col("text").alias("name")),
    ])
    last_write = writes.groupBy("file_id", "name", "idx").agg(F.count(F.lit(1)).alias("k"))
    after = guards.select("file_id", "name", "end", "fn_end").unionByName(
        last_write.select("file_id", "name", F.col("idx").alias("end"), F.lit(None).cast("int").alias("fn_end"))
    )
    back = Window.partitionBy("file_id", "name").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    next_write = F.min(F.when(F.col("fn_end").isNull(), F.col("end"))).over(back)
    kept = after.withColumn("next_write", next_write).where(
        F.col("fn_end").isNotNull() & (F.col("next_write").isNull() | (F.col("next_write") > F.col("fn_end")))
    ).select("file_id", "name", "end", "fn_end")
    stable = guards.join(kept, ["file_id", "name", "end", "fn_end"], "left_semi")
    return stable.select("file_id", "name", "scope", F.col("end").alias("from_idx"), F.lit("name").alias("form"))


def joined_paths(t: GoTables) -> DataFrame:
    """GO004: a file call over a joined path with an unproven component."""
    sinks = t.with_arg(t.calls_of("os", *FILE_SINKS), 0).withColumn("plus", F.lit(False))
    found = t.resolve(_spans(sinks, F.col("open_idx").cast("string")))
    joins = t.calls_of("path/filepath", "Join").where(F.col("n_args") >= 2).select(
        "file_id", F.col("anchor").alias("s"), F.col("close_idx").alias("e"), F.col("open_idx").alias("join_open")
    )
    paths = keep(found.join(joins, ["file_id", "s", "e"]).select(
        "file_id", "open_idx", "anchor", "idx", "close_idx", "s", "e", "x_src", "aliased", "join_open", F.col("open_idx").cast("string").alias("sink_id")
    ))
    far = paths.where("aliased")
    reached = t.tainted_sinks(far.select("file_id", "sink_id", "idx", "s", "e", "x_src"))
    live = paths.where(~F.col("aliased")).unionByName(far.join(reached, ["file_id", "sink_id"], "left_semi"))
    parts = live.select("file_id", "anchor", "idx", "close_idx", F.col("open_idx").alias("sink_open"), F.col("join_open").alias("open_idx")).join(
        t.args.where(F.col("arg_no") >= 1), ["file_id", "open_idx"]
    ).withColumns({
        "ref_id": F.concat_ws(":", "sink_open", "arg_no"), "s": F.col("start_idx"), "e": F.col("end_idx"), "plus": F.lit(False),
        "own_first": F.col("first"), "own_kind": F.col("first_kind"),
    }).where(~_one_token("string"))
    parts = keep(t.resolve(keep(parts)))
    one = F.col("s") == F.col("e")
    calm = one & (F.col("first_kind") == "string") & ~F.array_contains(F.split(F.regexp_replace(literal(F.col("first")), r"\\\\", "/"), "/"), "..")
    open_parts = parts.where(~calm)
    # Names whose trust matters: the argument itself and what it stands for; x.Name() of an entry.
    entry = F.col("e") == F.col("s") + 4
    marks = t.tokens.select("file_id", F.col("idx").alias("s"), "n1", "n2", "n3", "n4")
    shaped = open_parts.join(marks, ["file_id", "s"]).withColumn(
        "entry", entry & (F.col("n1") == ".") & (F.col("n2") == "Name") & (F.col("n3") == "(") & (F.col("n4") == ")")
    )
    own = (F.col("start_idx") == F.col("end_idx")) & (F.col("own_kind") == "ident")
    now = one & (F.col("first_kind") == "ident")
    asked = shaped.withColumn("names", F.array_compact(F.array(
        F.when(own, F.struct(F.col("own_first").alias("name"), F.lit("name").alias("form"))),
        F.when(now, F.struct(F.col("first").alias("name"), F.lit("name").alias("form"))),
        F.when(F.col("entry"), F.struct(F.col("first").alias("name"), F.lit("entry").alias("form"))),
    )))
    points = t.at(asked.select("file_id", "idx", "ref_id", F.inline("names"))).distinct()
    trusted = t._once("trusted", lambda: trusted_names(t), kept=True)
    # Trust is a binding of the scope it holds in, from the place on that earned it.
    said = F.concat_ws(":", "form", "name").alias("name")
    held = trusted.join(t.scope_openers.select("file_id", F.col("idx").alias("scope"), F.col("sl").alias("outer")), ["file_id", "scope"]).select(
        "file_id", said, F.greatest("scope", "from_idx").alias("at"), (F.col("outer") + 1).alias("scope_level"), F.col("scope").alias("pos"), F.lit(False).alias("is_barrier")
    )
    asks = points.select("file_id", "idx", "sl", F.col("ref_id").alias("point_id"), said)
    proven = sweeps.visible(asks, held, t.scope_openers, "sl").select("file_id", F.col("point_id").alias("ref_id")).distinct()
    risky = shaped.join(proven, ["file_id", "ref_id"], "left_anti")
    return _calls(risky, "GO004").distinct()


# ---- comments and imports ---------------------------------------------------------------


def comment_rule(t: GoTables) -> DataFrame:
    """GO015: a comment group with an open marker and a security term.

    Groups are islands of comments on neighbouring lines without code between.
    """
    w = Window.partitionBy("file_id").orderBy("pos")
    p = t.pieces
    # A comment that trails code is a group of its own.
    solid_line = F.last(F.when(F.col("kind") != "comment", F.when(F.col("kind") != "end", F.col("line") + F.col("breaks"))), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1)
    )
    solid_pos = F.last(F.when(~F.col("kind").isin("comment", "end"), F.col("pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    c = p.withColumns({"code_line": solid_line, "code_pos": F.coalesce(solid_pos, F.lit(-1))}).where(F.col("kind") == "comment")
    wc = Window.partitionBy("file_id").orderBy("pos")
    c = c.withColumn("last", F.lag(F.struct((F.col("line") + F.col("breaks")).alias("end"), "code_pos", (F.col("line") == F.col("code_line")).alias("trails"))).over(wc))
    same = (
        (F.col("last.code_pos") == F.col("code_pos")) & (F.col("line") <= F.col("last.end") + 1)
        & (~F.coalesce(F.col("last.trails"), F.lit(False)) | (F.col("line") <= F.col("last.end")))
    )
    c = c.withColumn("island", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(wc))
    # Directives and markers are not part of a comment's text.
    told = ~F.rlike("text", F.lit(r"\A//(?:[a-z0-9]+:[a-z0-9]|line |extern |export )"))
    groups = c.groupBy("file_id", "island").agg(
        F.bool_or(told & any_of_folded(F.col("text"), TODO_WORDS)).alias("marker"), F.bool_or(told & any_of_folded(F.col("text"), CONTROL_WORDS)).alias("term"),
        F.min(F.struct("pos", "line", "col")).alias("at"),
    ).where("marker and term")
    return groups.select("file_id", F.lit("GO015").alias("rule_id"), F.col("at.pos").alias("order_pos"), F.col("at.line").alias("line"), F.col("at.col").alias("column"), F.lit("*ast.CommentGroup").alias("evidence"))


def import_rule(t: GoTables) -> DataFrame:
    """GO013: the profiling package is imported; placed at the package clause."""
    files = t.imports.where(F.col("module") == "net/http/pprof").select("file_id").distinct()
    return t.tokens.where((F.col("idx") == 0) & (F.col("text") == "package")).join(files, "file_id", "left_semi").select(
        "file_id", F.lit("GO013").alias("rule_id"), F.lit(0).alias("order_pos"), "line", F.col("col").alias("column"), F.lit("import net/http/pprof").alias("evidence")
    )


def with_text(t: GoTables, hits: DataFrame) -> DataFrame:
    """Adds position and evidence: the source of the node with white space collapsed."""
    spans = hits.distinct().select(
        "file_id", "rule_id", "from_idx", "to_idx", F.col("from_idx").alias("start_idx"),
        F.least(F.col("to_idx"), F.col("from_idx") + EVIDENCE_TOKENS).alias("end_idx"),
    )
    toks = t.tokens.select("file_id", "idx", "text", "kind", "off", "size", "line", "col")
    inside = flow.span_tokens(spans, toks)
    rows = inside.groupBy("file_id", "rule_id", "from_idx", "to_idx").agg(
        F.min(F.struct("idx", "line", "col")).alias("at"),
        F.array_sort(F.collect_list(F.when(F.col("kind") != "end", F.struct("off", "size", "text")))).alias("ts"),
    )
    gaps = F.transform("ts", lambda x, i: F.concat(
        F.when((i > 0) & (F.get("ts", i - 1)["off"] + F.get("ts", i - 1)["size"] < x["off"]), F.lit(" ")).otherwise(F.lit("")), x["text"]
    ))
    return rows.select(
        "file_id", "rule_id", F.col("from_idx").alias("order_pos"), F.col("at.line").alias("line"), F.col("at.col").alias("column"),
        clipped(F.array_join(gaps, "")).alias("evidence"),
    )


RULES = {
    ("GO001", "GO008", "GO014", "GO018"): literal_rules,
    ("GO002",): shell_commands,
    ("GO003",): dynamic_sql,
    ("GO004",): joined_paths,
    ("GO005",): random_values,
    ("GO006", "GO007", "GO009", "GO011"): plain_calls,
    ("GO010", "GO021"): sensitive_args,
    ("GO012",): fatal_calls,
    ("GO016", "GO017", "GO019", "GO022"): tainted_args,
}
OTHER = {"GO015": comment_rule, "GO013": import_rule}


def go_pack(files: DataFrame, only: list[str] | None = None, tables: GoTables | None = None) -> DataFrame:
    """Raw findings of the pack; test files are read but never reported."""
    t = tables or GoTables(files.where(~F.col("is_test")))

    def wanted(rules) -> bool:
        return only is None or bool(set(rules) & set(only))

    found = {"hits_" + rules[0]: partial(make, t) for rules, make in RULES.items() if wanted(rules)}
    other = {"hits_" + rule: partial(make, t) for rule, make in OTHER.items() if wanted([rule])}
    tables = t.all_of({**found, **other})
    nodes, rest = tables[: len(found)], tables[len(found):]
    hits = _union(([with_text(t, _union(nodes))] if nodes else []) + rest)
    if only is not None:
        hits = hits.where(F.col("rule_id").isin(only))
    where = t.tokens.where(F.col("idx") == 0).select("file_id", "repo", "path")
    order = F.array_position(F.array(*[F.lit(r) for r in RULE_ORDER]), F.col("rule_id")).cast("int")
    late = F.create_map(*[F.lit(x) for pair in LATE.items() for x in pair])
    return hits.join(where, "file_id").withColumns({
        "variant": F.lit(""), "verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("string"),
        "phase": F.coalesce(F.try_element_at(late, F.col("rule_id")), F.lit(0)), "pos": F.col("order_pos").cast("int"), "rule_no": order,
    }).select(*RAW_COLUMNS)
