"""Script rule pack: seventeen rules over the tables of ``code_js``.

Sinks of all rules are collected into one table, so taint, aliases and scopes are
resolved once for all of them.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.functions import names
from codesift.operators import flow
from codesift.operators import structure as st
from codesift.operators import sweeps
from codesift.operators.code_js import COUNTERS, SQL_WORDS, ScriptTables, TYPE_REACH, unquote
from codesift.schema import RAW_COLUMNS
from codesift.session import keep

# Method names and reaches of the rules.
SQL_METHODS = ["query", "execute", "raw", "whereRaw", "orderByRaw"]
RAW_SQL_METHODS = ["$queryRawUnsafe", "$executeRawUnsafe"]
LOG_METHODS = ["log", "debug", "info", "warn", "error", "fatal", "trace"]
RESPONSE_NAMES = ["res", "response", "reply"]
HTML_PROPERTY_REACH = 16
RANDOM_NAME_REACH = 10
RANDOM_VALUE_REACH = 18
SANITIZER_REACH = 32

# Order in which the rules look at one token.
RULE_ORDER = [
    "JS001", "JS002", "JS003", "JS004", "JS005", "JS006", "JS007", "JS008", "JS009", "JS010", "JS011",
    "JS012", "JS013", "JS014", "JS015", "JS016", "JS017",
]


def _hits(df: DataFrame, rule: str, at: Column, evidence: Column, variant: Column | str = "") -> DataFrame:
    kind = F.lit(variant) if isinstance(variant, str) else variant
    return df.select("file_id", at.cast("int").alias("idx"), F.lit(rule).alias("rule_id"), kind.alias("variant"), evidence.alias("evidence"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def is_static() -> Column:
    """The first argument is string literals only."""
    return (F.col("x_non") == 0) & (F.col("x_str") > 0) & (F.col("x_tpl") == 0)


# ---- rules without data flow ----------------------------------------------------


def tls(t: ScriptTables) -> DataFrame:
    """JS001: verification switched off, outside type bodies."""
    toks = t.tokens
    off = F.when(F.col("n1") == "?", F.col("n2").isin(":", "=") & (F.col("n3") == "false")).otherwise(
        F.col("n1").isin(":", "=") & (F.col("n2") == "false")
    )
    option = toks.where((F.col("text") == "rejectUnauthorized") & off).select("file_id", "idx", "bl")
    marks = toks.where(F.col("text").isin("interface", "type", ";", "}", "{", "="))
    w = Window.partitionBy("file_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.last(F.when(F.col("text") != "=", F.struct("idx", "text")), ignorenulls=True).over(w)
    eq = F.max(F.when(F.col("text") == "=", F.col("idx"))).over(w)
    bodies = marks.withColumns({"stop": stop, "eq": eq}).where(
        (F.col("text") == "{") & (F.col("stop.idx") >= F.col("idx") - TYPE_REACH)
        & ((F.col("stop.text") == "interface") | ((F.col("stop.text") == "type") & (F.col("eq") > F.col("stop.idx"))))
    ).select("file_id", F.col("idx").alias("scope"))
    inside = st.enclosing_at(option, t.braces, "bl")
    kept = inside.join(bodies, ["file_id", "scope"], "left_anti")
    zero = (F.col("n2") == "0") | (F.col("nk2").isin("string", "template") & (unquote(F.col("n2")) == "0"))
    globally = toks.where((F.col("text") == "NODE_TLS_REJECT_UNAUTHORIZED") & (F.col("n1") == "=") & zero)
    return _union([
        _hits(kept, "JS001", F.col("idx"), F.lit("rejectUnauthorized: false"), "option"),
        _hits(globally, "JS001", F.col("idx"), F.lit("NODE_TLS_REJECT_UNAUTHORIZED = 0"), "global"),
    ])


def shell(t: ScriptTables) -> DataFrame:
    """JS002: a shell command that is neither constant nor built from process ids."""
    parts = F.col("x_pid")
    ids_only = (
        (F.col("kind0") == "tstart") & (F.col("last0") == "tend") & (F.col("x_tstart") == 1)
        & (F.col("x_tpl") == parts + 1) & (F.col("e0") - F.col("s0") + 1 == 4 * parts + 1)
    )
    before = F.when(F.col("anchor") == F.col("open_idx") - 1, F.col("p2")).otherwise(F.col("p4"))
    calls = t.api_calls.where((F.col("family") == "shell") & F.col("has0") & (before != "/"))
    return _hits(calls.where(~is_static() & ~ids_only), "JS002", F.col("anchor"), F.concat("method", F.lit("(dynamic command)")))


def dynamic_code(t: ScriptTables) -> DataFrame:
    """JS003: evaluation of text."""
    evals = t.calls.where((F.col("p1") == "eval") & (F.col("p2") != "/") & F.col("has0"))
    built = t.calls.where((F.col("p1") == "Function") & (F.col("p2") == "new") & (F.col("p3") != "/") & F.col("has0"))
    variant = F.when(is_static(), F.lit("static")).otherwise(F.lit("dynamic"))
    what = F.when(is_static(), F.lit("(static code)")).otherwise(F.lit("(dynamic code)"))
    return _union([
        _hits(evals, "JS003", F.col("open_idx") - 1, F.concat(F.lit("eval"), what), variant),
        _hits(built, "JS003", F.col("open_idx") - 2, F.concat(F.lit("new Function"), what), variant),
    ])


def weak_random(t: ScriptTables) -> DataFrame:
    """JS005: a sensitive name set from the predictable generator nearby."""
    random = (F.col("text") == "Math") & (F.col("n1") == ".") & (F.col("n2") == "random") & (F.col("n3") == "(")
    any_random = t.tokens.where(random).select("file_id").distinct()
    named = names.js_value_name(F.col("text"))
    subset = t.tokens.join(any_random, "file_id", "left_semi").where(F.col("text").isin("=", ";", ",") | random | named)
    back = Window.partitionBy("file_id").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = subset.withColumns({
        "next_random": F.min(F.when(random, F.col("idx"))).over(back),
        "next_semi": F.min(F.when(F.col("text") == ";", F.col("idx"))).over(back),
        "next_comma": F.last(F.when(F.col("text") == ",", F.struct("idx", "line")), ignorenulls=True).over(back),
    })
    eq = F.last(F.when(F.col("text") == "=", F.struct("idx", "line", "next_random", "next_semi", "next_comma")), ignorenulls=True).over(back)
    rows = ahead.withColumn("eq", eq).where(named & F.col("eq").isNotNull())

    def after(limit: Column, at: Column) -> Column:
        return F.coalesce(limit, F.lit(flow.NO_END)) > at

    m = F.col("eq.next_random")
    comma = F.col("eq.next_comma")
    found = rows.where(
        (F.col("eq.idx") <= F.col("idx") + RANDOM_NAME_REACH)
        & after(F.col("next_semi"), F.col("eq.idx")) & after(F.col("next_comma.idx"), F.col("eq.idx"))
        & (F.col("eq.line") <= F.col("line") + 1)
        & (m <= F.col("eq.idx") + RANDOM_VALUE_REACH)
        & after(F.col("eq.next_semi"), m)
        & (after(comma["idx"], m) | (comma["line"] != F.col("line")))
    )
    return _hits(found, "JS005", F.col("idx"), F.concat("text", F.lit(" = Math.random(...)")))


def post_message(t: ScriptTables) -> DataFrame:
    """JS010: a sensitive name posted to every origin."""
    anywhere = F.col("has1") & (F.col("s1") == F.col("e1")) & (unquote(F.col("first1")) == "*")
    calls = t.calls.where((F.col("p1") == "postMessage") & (F.col("p2") == ".") & F.col("has0") & (F.col("x_sens") > 0) & anywhere)
    return _hits(calls, "JS010", F.col("open_idx") - 1, F.lit('postMessage(sensitive value, "*")'))


def web_storage(t: ScriptTables) -> DataFrame:
    """JS011: a sensitive literal key in web storage."""
    key = unquote(F.col("first0"))
    calls = t.calls.where(
        (F.col("p1") == "setItem") & (F.col("p2") == ".") & F.col("p3").isin("localStorage", "sessionStorage")
        & F.col("has0") & (F.col("s0") == F.col("e0")) & (F.col("kind0") == "string") & names.js_value_name(key)
    )
    return _hits(calls, "JS011", F.col("open_idx") - 3, F.concat("p3", F.lit(".setItem("), key, F.lit(", ...)")))


def logging(t: ScriptTables) -> DataFrame:
    """JS013: the first argument with a sensitive name and no sanitizer."""
    receiver = F.lower(F.col("p3"))
    calls = t.calls.where(
        (F.col("p2") == ".") & F.lower(F.col("p1")).isin(LOG_METHODS)
        & (receiver.isin("console", "log") | F.endswith(receiver, F.lit("logger")))
    ).select("file_id", "open_idx", "p1", "p3")
    raw = t.args.where((F.col("x_log") > 0) & (F.col("x_san") == 0))
    first = calls.join(raw, ["file_id", "open_idx"]).groupBy("file_id", "open_idx", "p1", "p3").agg(
        F.min(F.struct("arg_no", "start_idx", "end_idx")).alias("arg")
    ).select("file_id", "open_idx", "p1", "p3", "arg.start_idx", "arg.end_idx")
    one = flow.first_in_span(first, t.tokens.where(F.col("f_log")), "text")
    return _hits(one, "JS013", F.col("open_idx") - 3, F.concat("p3", F.lit("."), "p1", F.lit("("), F.col("mark.text"), F.lit(")")))


def vm_code(t: ScriptTables) -> DataFrame:
    """JS015: text compiled by a VM call."""
    calls = t.api_calls.where((F.col("family") == "vm") & F.col("has0") & ~is_static())
    return _hits(calls, "JS015", F.col("anchor"), F.concat("method", F.lit("(dynamic code)")))


# ---- rules with aliases ----------------------------------------------------------


def dynamic_sql(t: ScriptTables) -> DataFrame:
    """JS006: dynamic query text, after following plain aliases."""
    calls = t.calls.where(
        (F.col("p2") == ".") & F.col("p1").isin(SQL_METHODS + RAW_SQL_METHODS) & F.col("has0")
    ).withColumn("mid", ((F.col("s0") + F.col("e0")) / 2).cast("int"))
    single = (F.col("x_solid") == 1) & ((F.col("s0") + F.col("e0")) % 2 == 0)
    ids = t.tokens.where(F.col("kind") == "ident").select("file_id", F.col("idx").alias("mid"), F.col("text").alias("name"))
    plain = calls.where(single).join(ids, ["file_id", "mid"])
    points = plain.select("file_id", (F.col("open_idx") - 1).alias("idx"), "bl", F.col("open_idx").alias("point_id"), "name")
    seen = t.see(points).where(~F.col("is_barrier")).select("file_id", F.col("point_id").alias("open_idx"), "pos")
    kinds = ["x_non", "x_str", "x_tpl", "x_plus", "x_src"]
    held = [*((c, c) for c in kinds), ("s0", "s"), ("e0", "e")]
    values = seen.join(t.alias_values, ["file_id", "pos"]).select("file_id", "open_idx", *[F.col(c).alias(f"v_{c}") for _, c in held])
    out = calls.join(values, ["file_id", "open_idx"], "left").withColumns({own: F.coalesce(f"v_{c}", own) for own, c in held})
    raw = F.col("p1").isin(RAW_SQL_METHODS)
    dynamic = (F.col("x_tpl") > 0) | (F.col("x_plus") > 0) | (F.col("x_src") > 0)
    risky = out.where(~is_static() & (raw | dynamic)).withColumn("raw", raw)
    told = says_sql(t, risky.where(~F.col("raw")).select("file_id", "open_idx", F.col("s0").alias("start_idx"), F.col("e0").alias("end_idx")))
    found = risky.where("raw").unionByName(risky.where(~F.col("raw")).join(told, ["file_id", "open_idx"], "left_semi"))
    return _hits(found, "JS006", F.col("open_idx") - 1, F.concat("p1", F.lit("(dynamic SQL)")))


def says_sql(t: ScriptTables, spans: DataFrame) -> DataFrame:
    """Calls (file_id, open_idx) in whose spans(file_id, open_idx, start_idx, end_idx) the
    texts of all literals, joined by blanks, hold query words."""
    texts = t.tokens.where(F.col("kind").isin("string", "template", "tstart", "tmid", "tend")).join(spans.select("file_id").distinct(), "file_id", "left_semi")
    inside = sweeps.marks_in_spans(spans, texts.select("file_id", "idx", "text"), "idx", ["open_idx"], ["idx", "text"])
    said = inside.groupBy("file_id", "open_idx").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("texts"))
    whole = F.array_join(F.transform("texts", lambda x: F.concat(F.lit(" "), F.lower(unquote(x["text"])))), "")
    return said.where(F.rlike(whole, F.lit("(?:" + "|".join(SQL_WORDS) + ")"))).select("file_id", "open_idx")


# ---- rules with taint ------------------------------------------------------------


def _sink(df: DataFrame, rule: str, at: Column, label: Column, s: str = "s0", e: str = "e0", counts: str = "x_") -> DataFrame:
    return df.select(
        "file_id", F.lit(rule).alias("rule_id"), at.cast("int").alias("idx"), "bl", F.col(s).alias("s"), F.col(e).alias("e"),
        F.col(f"{counts}src").alias("x_src"), label.alias("evidence"),
        (F.col(f"{counts}non") == 0).alias("no_code"), ((F.col(f"{counts}str") > 0) & (F.col(f"{counts}tpl") == 0)).alias("has_text"),
    )


def flow_sinks(t: ScriptTables) -> DataFrame:
    """Sinks whose finding depends on a lower-trust value: rules 7–9, 12, 14, 16 and 17."""
    c = t.calls.where(F.col("has0"))
    api = t.api_calls.where(F.col("has0"))
    p1, p2, p3, p4, p5 = (F.col(f"p{i}") for i in range(1, 6))
    o = F.col("open_idx")
    target = F.lit("(lower-trust target)")
    nav = (p2 == ".") & p1.isin("assign", "replace") & (p3 == "location")
    href = t.tokens.where((F.col("text") == "href") & (F.col("n1") == "=") & (F.col("p1") == ".") & (F.col("p2") == "location"))
    eqs = t.tokens.where(F.col("text") == "=").join(
        href.select("file_id", (F.col("idx") + 1).alias("idx")), ["file_id", "idx"], "left_semi"
    ).select("file_id", "idx", "lv", "bl", *[f"c_{k}" for k in COUNTERS])
    hrefs = t.statement_spans(eqs).where(F.col("s") <= F.col("e"))
    header = (p2 == ".") & p1.isin("setHeader", "header", "set") & F.lower(p3).isin(RESPONSE_NAMES)
    name = F.lower(unquote(F.col("first0")))
    origin = header & (F.col("s0") == F.col("e0")) & (F.col("kind0") == "string") & F.col("has1") & (name == "access-control-allow-origin")
    return _union([
        _sink(api.where((F.col("family") == "fs") & (F.col("method") != "readdirSync") & ~is_static()), "JS007", F.col("anchor"), F.concat("method", F.lit("(dynamic path)"))),
        _sink(c.where((p1 == "fetch") & (p2 != ".")), "JS008", o - 1, F.lit("fetch(lower-trust URL)")),
        _sink(api.where((F.col("family") == "http") & ((F.col("anchor") != o - 1) | (p1 != "fetch") | (p2 == "."))), "JS008", F.col("anchor"), F.concat("method", F.lit("(lower-trust URL)"))),
        _sink(c.where(nav), "JS009", o - 3, F.concat(F.lit("location."), p1, target)),
        _sink(c.where(nav & (p4 == ".") & (p5 == "window")), "JS009", o - 5, F.concat(F.lit("window.location."), p1, target)),
        _sink(c.where((p1 == "open") & (p2 == ".") & (p3 == "window")), "JS009", o - 3, F.concat(F.lit("window.open"), target)),
        _sink(hrefs, "JS009", F.col("idx") - 1, F.concat(F.lit("location.href"), target), "s", "e"),
        _sink(c.where((p1 == "redirect") & (p2 == ".") & F.lower(p3).isin(RESPONSE_NAMES)), "JS012", o - 3, F.lit("response.redirect(lower-trust target)")),
        _sink(c.where(p1.isin("import", "require") & (p2 != ".")), "JS014", o - 1, F.concat(p1, F.lit("(lower-trust module)"))),
        _sink(api.where(F.col("family") == "program"), "JS016", F.col("anchor"), F.concat("method", F.lit("(lower-trust executable)"))),
        _sink(c.where(origin), "JS017", o - 3, F.lit("credentialed reflected CORS"), "s1", "e1", "y_"),
    ])


def trusted_names(t: ScriptTables) -> DataFrame:
    """trusted(file_id, name, scope): constants (scope NULL = whole file) and names
    that range over constant lists or directory listings (scope = loop body)."""
    toks = t.tokens
    const = toks.where((F.col("text") == "const") & (F.col("n2") == "=") & (F.col("n1") != ""))
    static = const.where(F.col("nk3").isin("string", "template")).select("file_id", F.col("n1").alias("name"))
    opened = const.where(F.col("n3") == "[").select("file_id", F.col("n1").alias("name"), (F.col("idx") + 3).alias("grp"))
    items = toks.where(F.col("grp_text") == "[").groupBy("file_id", "grp").agg(
        F.bool_and(F.col("kind").isin("string", "template") | (F.col("text") == ",")).alias("plain"),
        F.bool_or(F.col("kind").isin("string", "template")).alias("some"),
    ).where("plain and some")
    lists = opened.join(items, ["file_id", "grp"], "left_semi").select("file_id", F.col("name").alias("n5")).distinct()
    heads = toks.where((F.col("text") == "for") & (F.col("n1") == "(") & F.col("n2").isin("const", "let") & (F.col("n4") == "of")).select(
        "file_id", "idx", F.col("n3").alias("name"), "n5", (F.col("idx") + 1).alias("grp"), (F.col("idx") + 5).alias("anchor")
    )
    reads = t.api_calls.where((F.col("family") == "fs") & (F.col("method") == "readdirSync")).select("file_id", "anchor").distinct()
    loops = heads.join(lists, ["file_id", "n5"], "left_semi").unionByName(heads.join(reads, ["file_id", "anchor"], "left_semi")).distinct()
    bodies = loops.join(t.brackets.where(F.col("after") == "{"), ["file_id", "grp"]).select(
        "file_id", "name", (F.col("close_idx") + 1).alias("scope")
    )
    return static.withColumn("scope", F.lit(None).cast("int")).unionByName(bodies).distinct()


def risky_paths(t: ScriptTables, sinks: DataFrame) -> DataFrame:
    """Sink ids of file calls whose first argument joins an unproven component."""
    joins = t.api_calls.where(F.col("family") == "path").select("file_id", "open_idx", "anchor")
    parts = joins.join(t.args.where(F.col("arg_no") >= 1), ["file_id", "open_idx"])
    loose = parts.where(~((F.col("x_non") == 0) & (F.col("x_str") > 0) & (F.col("x_tpl") == 0))).select(
        "file_id", F.col("anchor").alias("idx"), F.col("start_idx").alias("part"),
        F.when((F.col("start_idx") == F.col("end_idx")) & (F.col("first_kind") == "ident"), F.col("first")).alias("name"),
    )
    spans = sinks.select("file_id", "sink_id", F.col("idx").alias("at"), "bl", F.col("s").alias("start_idx"), F.col("e").alias("end_idx"))
    held = sweeps.marks_in_spans(spans, loose, "part", ["sink_id", "at", "bl"], ["name"])
    trusted = t._once("trusted", lambda: trusted_names(t), kept=True)
    unnamed = held.where(F.col("name").isNull()).select("file_id", "sink_id")
    points = held.where(F.col("name").isNotNull()).select("file_id", F.col("at").alias("idx"), "bl", F.col("sink_id").alias("point_id"), "name").distinct()
    points = points.join(trusted.where(F.col("scope").isNull()), ["file_id", "name"], "left_anti")
    # A trusted loop variable is a binding of its loop's body.
    bodies = trusted.join(t.braces.withColumnRenamed("idx", "scope"), ["file_id", "scope"]).select(
        "file_id", "name", F.col("scope").alias("at"), (F.col("bl") + 1).alias("scope_level"), F.col("scope").alias("pos"), F.lit(False).alias("is_barrier")
    )
    proven = sweeps.visible(points, bodies, t.braces, "bl").select("file_id", "point_id", "name")
    open_names = points.join(proven, ["file_id", "point_id", "name"], "left_anti").select("file_id", F.col("point_id").alias("sink_id"))
    return unnamed.unionByName(open_names.select("file_id", "sink_id")).distinct()


def tainted_rules(t: ScriptTables) -> DataFrame:
    sinks, *_ = t.beside(
        lambda: keep(flow_sinks(t).withColumn("sink_id", F.concat_ws(":", "rule_id", "idx", "s"))),
        lambda: t.tainted, lambda: t._once("trusted", lambda: trusted_names(t), kept=True),
    )
    hit = keep(t.tainted_sinks(sinks))
    paths = risky_paths(t, sinks.where(F.col("rule_id") == "JS007"))
    reached = sinks.join(hit.unionByName(paths).distinct(), ["file_id", "sink_id"], "left_semi")
    plain = reached.where(F.col("rule_id") != "JS017")
    return plain.select("file_id", "idx", "rule_id", F.lit("").alias("variant"), "evidence").unionByName(
        cors(t, reached.where(F.col("rule_id") == "JS017"))
    )


def cors(t: ScriptTables, origins: DataFrame) -> DataFrame:
    """JS017: both headers in one innermost block, placed at the last origin."""
    p1, p2, p3 = F.col("p1"), F.col("p2"), F.col("p3")
    yes = (F.col("s1") == F.col("e1")) & ((F.col("first1") == "true") | (F.lower(unquote(F.col("first1"))) == "true"))
    allowed = t.calls.where(
        (p2 == ".") & p1.isin("setHeader", "header", "set") & F.lower(p3).isin(RESPONSE_NAMES) & F.col("has0") & F.col("has1")
        & (F.col("s0") == F.col("e0")) & (F.col("kind0") == "string")
        & (F.lower(unquote(F.col("first0"))) == "access-control-allow-credentials") & yes
    ).select("file_id", (F.col("open_idx") - 3).alias("idx"), "bl", F.lit(True).alias("cred"))
    rows = origins.select("file_id", "idx", "bl", F.lit(False).alias("cred")).unionByName(allowed)
    blocks = st.enclosing_at(rows, t.braces, "bl").where(F.col("scope") >= 0)
    both = blocks.groupBy("file_id", "scope").agg(
        F.max(F.when(~F.col("cred"), F.col("idx"))).alias("idx"), F.bool_or("cred").alias("cred")
    ).where(F.col("cred") & F.col("idx").isNotNull())
    return _hits(both, "JS017", F.col("idx"), F.lit("credentialed reflected CORS"))


# ---- HTML sinks ------------------------------------------------------------------


def sanitizers(t: ScriptTables) -> DataFrame:
    """Functions whose body visibly escapes markup: (file_id, name)."""
    toks = t.tokens
    w = Window.partitionBy("file_id").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    marks = toks.where(F.col("text").isin("function", "const", "{", ";", "=>"))
    ahead = marks.withColumns({
        "brace": F.last(F.when(F.col("text").isin("{", ";"), F.struct("idx", "text")), ignorenulls=True).over(w),
        "arrow": F.last(F.when(F.col("text").isin("=>", ";"), F.struct("idx", "text", "n1")), ignorenulls=True).over(w),
        "semi": F.min(F.when(F.col("text") == ";", F.col("idx"))).over(w),
    })
    near = F.col("idx") + SANITIZER_REACH
    functions = ahead.where((F.col("text") == "function") & (F.col("brace.text") == "{") & (F.col("brace.idx") <= near)).select(
        "file_id", F.col("n1").alias("name"), F.col("brace.idx").alias("open_idx")
    )
    arrows = ahead.where((F.col("text") == "const") & (F.col("n2") == "=") & (F.col("arrow.text") == "=>") & (F.col("arrow.idx") <= near))
    blocks = arrows.where(F.col("arrow.n1") == "{").select("file_id", F.col("n1").alias("name"), (F.col("arrow.idx") + 1).alias("open_idx"))
    closed = functions.unionByName(blocks).join(t.brace_pairs, ["file_id", "open_idx"]).select(
        "file_id", "name", F.col("open_idx").alias("from_idx"), F.col("close_idx").alias("to_idx")
    )
    ends = ahead.where(F.col("text") == "=>").select("file_id", F.col("idx").alias("from_idx"), "semi")
    bare = arrows.where(F.col("arrow.n1") != "{").select("file_id", F.col("n1").alias("name"), F.col("arrow.idx").alias("from_idx")).join(
        ends, ["file_id", "from_idx"]
    ).select("file_id", "name", "from_idx", F.coalesce("semi", F.lit(flow.NO_END)).alias("to_idx"))
    value = unquote(F.col("text"))
    signs = toks.where(
        (F.col("text") == "replace") | value.isin("&amp;", "&lt;", "&gt;")
        | ((F.col("kind") == "regex") & F.contains(F.col("text"), F.lit("&")) & F.contains(F.col("text"), F.lit("<")) & F.contains(F.col("text"), F.lit(">")))
    ).select("file_id", "idx", F.when(F.col("kind") == "regex", F.lit("regex")).otherwise(value).alias("sign"))
    # Running positions of the latest sign of each kind: a body holds a sign if
    # the latest one before its end lies after its start.
    edges = closed.unionByName(bare).withColumn("idx", F.col("to_idx"))
    rows = edges.unionByName(signs, allowMissingColumns=True)
    f = Window.partitionBy("file_id").orderBy("idx", F.col("sign").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    needed = ["replace", "regex", "&amp;", "&lt;", "&gt;"]
    latest = {f"s{i}": F.max(F.when(F.col("sign") == s, F.col("idx"))).over(f) for i, s in enumerate(needed)}
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"s{i}") > F.col("from_idx"), F.lit(False)) for i in range(len(needed))])
    return rows.withColumns(latest).where(F.col("name").isNotNull() & ok).select("file_id", "name").distinct()


def html_sinks(t: ScriptTables) -> DataFrame:
    """Expressions that become markup: (file_id, sink_id, idx, bl, lv, s, e, x_*, label)."""
    toks = t.tokens
    counts = [f"c_{k}" for k in COUNTERS]
    assigns = toks.where((F.col("text") == "=") & F.col("p1").isin("innerHTML", "outerHTML")).select(
        "file_id", "idx", "lv", "bl", F.col("p1").alias("what"), *counts
    )
    assigned = t.statement_spans(assigns).select("file_id", (F.col("idx") - 1).alias("at"), "bl", "s", "e", "x_src", F.concat("what", F.lit(" = dynamic HTML")).alias("label"))
    inserted = t.calls.where((F.col("p1") == "insertAdjacentHTML") & F.col("has1")).select(
        "file_id", (F.col("open_idx") - 1).alias("at"), "bl", F.col("s1").alias("s"), F.col("e1").alias("e"), F.col("y_src").alias("x_src"),
        F.lit("insertAdjacentHTML(..., dynamic HTML)").alias("label"),
    )
    written = t.calls.where((F.col("p1") == "write") & (F.col("p2") == ".") & (F.col("p3") == "document") & F.col("has0")).select(
        "file_id", (F.col("open_idx") - 3).alias("at"), "bl", F.col("s0").alias("s"), F.col("e0").alias("e"), "x_src",
        F.lit("document.write(dynamic HTML)").alias("label"),
    )
    key = (F.col("text") == "__html") & (F.col("n1") == ":")
    subset = toks.where(key | (F.col("text") == "dangerouslySetInnerHTML"))
    w = Window.partitionBy("file_id").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    props = subset.withColumn("key", F.min(F.when(key, F.col("idx"))).over(w)).where(
        (F.col("text") == "dangerouslySetInnerHTML") & (F.col("key") <= F.col("idx") + HTML_PROPERTY_REACH)
    ).select("file_id", F.col("idx").alias("at"), "bl", (F.col("key") + 1).alias("idx"))
    colons = toks.where(F.col("text") == ":").select("file_id", "idx", "lv", *counts).join(props, ["file_id", "idx"])
    shown = t.property_spans(colons).where(F.col("s") <= F.col("e")).select(
        "file_id", "at", "bl", "s", "e", "x_src", F.lit("dangerouslySetInnerHTML={{__html: dynamic HTML}}").alias("label")
    )
    return _union([assigned, inserted, written, shown]).withColumnRenamed("at", "idx").withColumn(
        "sink_id", F.concat_ws(":", F.lit("JS004"), "idx", "s")
    )


def html_parts(t: ScriptTables, spans: DataFrame) -> DataFrame:
    """Decides markup spans by their parts.

    spans(file_id, span_id, s, e) → (file_id, span_id, bad, alias): ``bad`` means
    that a part is neither literal, nor a sanitizer call, nor a plain name;
    ``alias`` lists the plain names.

    Inside a span a group is transparent if it only wraps a part: round brackets
    or a template bounded by +, ?, :, the span or another transparent group.  At
    one level the text before ``?`` is a condition and does not count.
    """
    cols = ["file_id", "idx", "text", "kind", "grp", "lv", "p1", "n1", "pk1", "nk1"]
    closing = t.rows.where(F.col("role") == "close").select(
        "file_id", F.col("idx").alias("c_idx"), F.col("grp").alias("idx"), F.col("n1").alias("after"), F.col("nk1").alias("after_kind")
    )
    inside = flow.span_tokens(spans.select("file_id", "span_id", F.col("s").alias("start_idx"), F.col("e").alias("end_idx")), t.tokens.select(*cols))
    toks = inside.join(closing, ["file_id", "idx"], "left")
    first, last = F.col("idx") == F.col("start_idx"), F.col("c_idx") == F.col("end_idx")
    edge_before = first | F.col("p1").isin("+", "?", ":", "(") | F.col("pk1").isin("tstart", "tmid")
    edge_after = last | F.col("after").isin("+", "?", ":", ")") | F.col("after_kind").isin("tmid", "tend")
    wraps = ((F.col("text") == "(") | (F.col("kind") == "tstart")) & F.col("c_idx").isNotNull() & edge_before & edge_after
    # A template that opens an expression must be all of it, and may not hold another one.
    opens = first | F.col("p1").isin("?", ":", "(") | F.col("pk1").isin("tstart", "tmid")
    partial = (F.col("kind") == "tstart") & opens & ~last & F.col("after").isin("+", "?")
    toks = toks.withColumns({"wraps": wraps, "partial": partial})
    # Depth of the opaque groups around each token, by a running sum in the span.
    w = Window.partitionBy("file_id", "span_id").orderBy("idx")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opener, closer = st.is_opener(), st.is_closer()
    own_open = toks.where(opener).select("file_id", "span_id", F.col("c_idx").alias("idx"), F.col("wraps").alias("closes_wrap"))
    toks = toks.join(own_open.where(F.col("idx").isNotNull()), ["file_id", "span_id", "idx"], "left")
    step = F.when(opener & ~F.col("wraps"), 1).when(closer & ~F.coalesce("closes_wrap", F.lit(False)), -1).otherwise(0)
    toks = toks.withColumn("opaque", F.sum(step).over(run) - F.when(opener & ~F.col("wraps"), 1).otherwise(0))
    visible_ = F.col("opaque") <= 0
    bound = visible_ & (
        F.col("text").isin("+", "?", ":") & (F.col("kind") != "string")
        | F.col("kind").isin("tmid", "tend") | (opener & F.col("wraps")) | (closer & F.coalesce("closes_wrap", F.lit(False)))
    )
    toks = toks.withColumns({"bound": bound, "piece": F.sum(F.when(bound, 1).otherwise(0)).over(run)})
    # A condition: the next bound at the same level, skipping +, is a question mark.
    lvw = Window.partitionBy("file_id", "span_id", "grp").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(F.col("bound") & ~opener & (F.col("text") != "+"), F.col("text")), ignorenulls=True).over(lvw)
    toks = toks.withColumn("cond", F.coalesce((nxt == "?") & ~(F.col("bound") & (F.col("text") == "?")), F.lit(False)))
    # Everything inside a transparent group that stands in a condition is ignored too.
    hide = F.when(opener & F.col("wraps") & F.col("cond"), 1).otherwise(0)
    unhide_rows = toks.where(opener & F.col("wraps") & F.col("cond")).select(
        "file_id", "span_id", F.col("c_idx").alias("idx"), F.lit(1).alias("unhide")
    )
    toks = toks.join(unhide_rows, ["file_id", "span_id", "idx"], "left").withColumn(
        "hidden", F.sum(hide - F.coalesce("unhide", F.lit(0))).over(run)
    )
    toks = keep(toks)
    body = toks.where(~F.col("bound") & (F.col("hidden") <= 0) & ~F.col("cond"))
    known = t._once("sanitizers", lambda: sanitizers(t), kept=True).withColumn("sane", F.lit(True))
    parts = body.groupBy("file_id", "span_id", "piece").agg(
        F.min(F.struct("idx", "text", "kind", "n1")).alias("f"), F.max("idx").alias("to_idx"), F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("kind").isin("string", "template")).alias("literal"), F.bool_or("partial").alias("partial"),
        F.max(F.when(F.col("kind") == "tstart", 1).otherwise(0)).alias("holds_template"),
    )
    firsts = t.rows.where((F.col("role") == "close") & (F.col("grp_text") == "(")).select(
        "file_id", (F.col("grp") - 1).alias("name_idx"), F.col("idx").alias("call_end")
    )
    parts = parts.withColumns({"name_idx": F.col("f.idx"), "name": F.col("f.text")}).join(firsts, ["file_id", "name_idx"], "left").join(
        known, ["file_id", "name"], "left"
    )
    alias = (F.col("n") == 1) & (F.col("f.kind") == "ident")
    sane = F.coalesce("sane", F.lit(False)) & (F.col("f.n1") == "(") & F.coalesce(F.col("call_end") == F.col("to_idx"), F.lit(False))
    good = F.col("literal") | sane | alias
    # Spans without a visible part (nothing but bounds) are not safe.
    flags = toks.groupBy("file_id", "span_id").agg(
        F.bool_or(F.col("partial") & (F.col("hidden") <= 0)).alias("cut"),
        F.bool_or((F.col("kind") == "tstart") & (F.col("hidden") <= 0) & (F.col("opaque") > 0)).alias("inner_template"),
    )
    nests = _nested_templates(toks)
    judged = parts.groupBy("file_id", "span_id").agg(
        F.bool_or(~good).alias("bad_part"), F.collect_set(F.when(alias, F.col("name"))).alias("alias")
    )
    return spans.select("file_id", "span_id").join(judged, ["file_id", "span_id"], "left").join(flags, ["file_id", "span_id"], "left").join(
        nests, ["file_id", "span_id"], "left"
    ).select(
        "file_id", "span_id",
        (F.coalesce("bad_part", F.lit(True)) | F.coalesce("cut", F.lit(False)) | F.coalesce("nests", F.lit(False))).alias("bad"),
        F.coalesce("alias", F.array().cast("array<string>")).alias("alias"),
    )


def _nested_templates(toks: DataFrame) -> DataFrame:
    """Spans in which a transparent, visible template holds another template."""
    w = Window.partitionBy("file_id", "span_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when((F.col("kind") == "tstart") & F.col("wraps") & (F.col("hidden") <= 0) & ~F.col("cond"), F.col("c_idx"))).over(w)
    rows = toks.withColumn("reach", reach).where((F.col("kind") == "tstart") & (F.col("reach") > F.col("idx")))
    return rows.select("file_id", "span_id").distinct().withColumn("nests", F.lit(True))


def html(t: ScriptTables) -> DataFrame:
    """JS004: markup sinks that are not provably safe."""
    sinks = t._once("html_sinks", lambda: html_sinks(t), kept=True)
    # Right-hand sides matter only in files that have a markup sink at all.
    held = t.bindings.where(~F.col("is_barrier")).join(sinks.select("file_id").distinct(), "file_id", "left_semi")
    values = t.assigned.join(held.select("file_id", "eq").distinct(), ["file_id", "eq"], "left_semi")
    spans = sinks.where(F.col("s") <= F.col("e")).select("file_id", F.col("sink_id").alias("span_id"), "s", "e").unionByName(
        values.select("file_id", F.concat(F.lit("eq:"), F.col("eq").cast("string")).alias("span_id"), "s", "e")
    )
    judged = keep(html_parts(t, keep(spans)))
    bound = held.withColumn("span_id", F.concat(F.lit("eq:"), F.col("eq").cast("string"))).join(judged, ["file_id", "span_id"])
    points = bound.where(~F.col("bad")).select(
        "file_id", F.col("pos").alias("idx"), "bl", F.col("pos").cast("string").alias("point_id"), F.explode("alias").alias("name")
    )
    named = judged.where(~F.col("bad")).withColumnRenamed("span_id", "sink_id")
    sink_points = sinks.join(named, ["file_id", "sink_id"]).select(
        "file_id", "idx", "bl", F.col("sink_id").alias("point_id"), F.explode("alias").alias("name")
    )
    every = points.unionByName(sink_points)
    seen = t.see(every).where(~F.col("is_barrier")).select("file_id", "point_id", "name", F.col("pos").alias("to_pos"))
    links = every.select("file_id", "point_id", "name").join(seen, ["file_id", "point_id", "name"], "left")
    numeric = F.col("point_id").try_cast("int")
    safe = flow.safe_bindings(
        bound.select("file_id", "pos", "name", "bad"),
        links.where(numeric.isNotNull()).select("file_id", numeric.alias("pos"), "to_pos"),
    )
    sink_links = links.where(numeric.isNull()).join(
        safe.select("file_id", F.col("pos").alias("to_pos"), F.lit(True).alias("ok")), ["file_id", "to_pos"], "left"
    )
    loose = sink_links.where(F.col("ok").isNull()).select("file_id", F.col("point_id").alias("sink_id"))
    bad = judged.where(F.col("bad")).select("file_id", F.col("span_id").alias("sink_id"))
    empty = sinks.where(F.col("s") > F.col("e")).select("file_id", "sink_id")
    risky = keep(sinks.join(loose.unionByName(bad).unionByName(empty).distinct(), ["file_id", "sink_id"], "left_semi"))
    hit = t.tainted_sinks(risky).withColumn("hit", F.lit(True))
    out = risky.join(hit, ["file_id", "sink_id"], "left")
    return _hits(out, "JS004", F.col("idx"), F.col("label"), F.when(F.col("hit"), F.lit("source")).otherwise(F.lit("dynamic")))


RULES = {
    "JS001": tls, "JS002": shell, "JS003": dynamic_code, "JS004": html, "JS005": weak_random, "JS006": dynamic_sql,
    "JS010": post_message, "JS011": web_storage, "JS013": logging, "JS015": vm_code, "FLOW": tainted_rules,
}


# What the text of a script must hold, of each list one word, for a rule to find
# anything in it.  A token is a piece of the text as it stands, and no rule looks beyond a file,
# so scripts without them are not cut when the rule is asked for alone.
GATES = {
    "JS001": [["rejectUnauthorized", "NODE_TLS_REJECT_UNAUTHORIZED"]],
    "JS003": [["eval", "Function"]],
    "JS005": [["Math"], ["random"]],
    "JS010": [["postMessage"]],
    "JS011": [["setItem"], ["localStorage", "sessionStorage"]],
}


def may_hold(rules: list[str]) -> Column:
    """Scripts that one of the rules may find something in."""
    def says(lists: list[list[str]]) -> Column:
        return reduce(lambda a, b: a & b, [F.rlike("content", F.lit("|".join(words))) for words in lists])

    return reduce(lambda a, b: a | b, [says(GATES[rule]) for rule in rules])


def js_pack(files: DataFrame, only: list[str] | None = None, tables: ScriptTables | None = None) -> DataFrame:
    """Raw findings of the pack; test files are read but never reported."""
    t = tables or ScriptTables(files.where(~F.col("is_test")))
    if only and set(only) <= set(GATES):
        t = t.holding(" ".join(sorted(only)), may_hold(only))
    flow_rules = {"JS007", "JS008", "JS009", "JS012", "JS014", "JS016", "JS017"}
    wanted = [r for r in RULES if only is None or r in only or (r == "FLOW" and flow_rules & set(only))]
    hits = _union(t.all_of({"hits_" + r: partial(RULES[r], t) for r in wanted}))
    if only is not None:
        hits = hits.where(F.col("rule_id").isin(only))
    where = t.tokens.select("file_id", "idx", "repo", "path", "line", F.col("col").alias("column"))
    order = F.array_position(F.array(*[F.lit(r) for r in RULE_ORDER]), F.col("rule_id")).cast("int")
    out = hits.join(where, ["file_id", "idx"])
    return out.withColumns({
        "verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("string"),
        "phase": F.when(F.col("rule_id") == "JS017", 1).otherwise(0), "pos": F.col("idx"), "rule_no": order,
    }).select(*RAW_COLUMNS)
