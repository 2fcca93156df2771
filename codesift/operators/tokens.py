"""Tokens: source text as rows.

A text is cut into pieces that join back to the text exactly: Go by one regular
expression; scripts by one pass in Python, because what a slash or a brace means
depends on the token before it and on the templates that are open.  The pass counts
unreadable characters as it goes, so coverage reads its counts and cuts nothing again.  Positions
come from running sums over the pieces, and a file never leaves its task: files
are hash-partitioned by ``file_id`` before they are exploded, and every later
window and join uses that partitioning.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from codesift.session import buckets

# Words that cannot be variable names.
JS_RESERVED = [
    "await", "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete",
    "do", "else", "enum", "export", "extends", "false", "finally", "for", "function", "if", "import",
    "in", "instanceof", "new", "null", "return", "super", "switch", "this", "throw", "true", "try",
    "typeof", "var", "void", "while", "with", "yield",
]
# Words after which a slash starts a regular expression.
JS_BEFORE_REGEX = [
    "return", "throw", "case", "delete", "void", "typeof", "instanceof", "in", "of", "yield", "await",
]
JS_PUNCTUATION = ["{", "}", "(", ")", "[", "]", ".", ";", ",", "?", ":", "=>", "..."]
JS_OPERATORS = (
    ">>>= === !== **= <<= >>= >>> &&= ||= ??= == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= "
    "<< >> ** < > + - * / % & | ^ ! ~ ="
).split()
GO_KEYWORDS = [
    "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for",
    "func", "go", "goto", "if", "import", "interface", "map", "package", "range", "return", "select",
    "struct", "switch", "type", "var",
]
GO_OPERATORS = (
    "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ "
    "+ - * / % & | ^ < > = ! ~ ( ) [ ] { } , ; . :"
).split()


def _op(words: list[str]) -> str:
    return "|".join("".join("\\" + c for c in w) for w in words)


_SPACE = r"[ \t\n\x0b\f\r\u00a0\ufeff\u2028\u2029]++"
_BLOCK = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
# The inside of quotes and of a regular expression, up to what may end it.
_QUOTED = {q: rf"(?:[^{q}\\\r\n]|\\(?:\r\n|[\s\S]))*+" for q in "\"'"}
_REGEX = {"plain": r"(?:[^\\/\[\r\n]|\\[^\r\n])*+", "class": r"\[(?:[^\]\\\r\n]|\\[^\r\n])*+", "flags": r"[\w$]*+"}
# Tokens after which a slash starts a regular expression; so it does at the start and after ``${``.
_REGEX_AFTER = frozenset(
    ["(", "[", "{", ",", ":", ";", "?", "=>", *JS_BEFORE_REGEX, *(o for o in JS_OPERATORS if o not in ("?.", "++", "--", "<", ">", "/"))]
)
_TEXT = r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+"
_NUMBER = (
    r"0[xX][0-9a-fA-F_]++n?|0[bB][01_]++n?|0[oO][0-7_]++n?|"
    r"(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9_]++)?n?"
)


def _of_categories(*wanted: str) -> str:
    """The inside of a character class: all characters of these Unicode categories."""
    runs = groupby(range(sys.maxunicode + 1), lambda c: unicodedata.category(chr(c)) in wanted)
    ends = ((run[0], run[-1]) for run in (list(of) for held, of in runs if held))
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in ends)


@cache
def _js_patterns() -> dict[str, re.Pattern]:
    letters = ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl")
    name = rf"#?[{_of_categories(*letters)}$_][{_of_categories(*letters, 'Mn', 'Mc', 'Nd', 'Pc')}$]*+"
    skip = "|".join([_SPACE, r"//[^\r\n]*+", r"<!--[^\r\n]*+"])
    token = "|".join([_NUMBER, name, r"\?\.(?![0-9])", r"=>|\.\.\.", _op([o for o in JS_OPERATORS if o != "?."]), r"[{}()\[\].;,?:]"])
    parts = {**_QUOTED, **_REGEX, "text": _TEXT, "other": f"(?P<skip>{skip})|(?P<token>{token})|[\\s\\S]"}
    return {key: re.compile(x) for key, x in parts.items()}


class ScriptCut:
    """Cuts one script into pieces, in one pass.

    What has no end is looked for once: a search that fails says that nothing up to where
    it stopped can succeed, since escapes are read alike from any later start.  So work is
    linear in the text, whatever it holds.
    """

    def __init__(self, text: str):
        self.text = text
        self.errors = 0
        self.find = {k: p.match for k, p in _js_patterns().items()}
        self.comments_end = self.templates_end = True
        self.no_end: dict[str, int] = {}  # quote or class: none closes before here

    def quoted(self, at: int) -> int | None:
        quote = self.text[at]
        if at < self.no_end.get(quote, 0):
            return None
        stop = self.find[quote](self.text, at + 1).end()
        if self.text.startswith(quote, stop):
            return stop + 1
        self.no_end[quote] = stop
        return None

    def comment(self, at: int) -> int | None:
        stop = self.text.find("*/", at + 2) if self.comments_end else -1
        self.comments_end = stop >= 0
        return stop + 2 if stop >= 0 else None

    def template(self, at: int) -> tuple[int | None, bool]:
        """End of the chunk that starts at a back quote or brace, and whether a substitution follows."""
        if self.templates_end:
            stop = self.find["text"](self.text, at + 1).end()
            if self.text.startswith("${", stop):
                return stop + 2, True
            if self.text.startswith("`", stop):
                return stop + 1, False
            self.templates_end = False
        return None, False

    def regex(self, at: int) -> int | None:
        stop = at + 1
        if self.text.startswith(("*", "/"), stop):
            return None
        while True:
            stop = self.find["plain"](self.text, stop).end()
            if not self.text.startswith("[", stop):
                break
            if stop < self.no_end.get("[", 0):
                return None
            inside = self.find["class"](self.text, stop).end()
            if not self.text.startswith("]", inside):
                self.no_end["["] = inside
                return None
            stop = inside + 1
        return self.find["flags"](self.text, stop + 1).end() if stop > at + 1 and self.text.startswith("/", stop) else None

    def pieces(self) -> Iterator[str]:
        text, other = self.text, self.find["other"]
        braces: list[bool] = []  # for each open brace whether it opened a substitution
        at, regex_may_start = 0, True
        while at < len(text):
            first, end, opens = text[at], None, False
            if first == "`" or (first == "}" and braces and braces.pop()):
                end, opens = self.template(at)
                if end is not None:
                    regex_may_start = opens
                    if opens:
                        braces.append(True)
            elif first in "\"'":
                end = self.quoted(at)
                if end is not None:
                    regex_may_start = False
            elif first == "/" and text.startswith("/*", at):
                end = self.comment(at)
            elif first == "/" and regex_may_start:
                end = self.regex(at)
                if end is not None:
                    regex_may_start = False
            if end is None:
                found = other(text, at)
                end = found.end()
                if found.lastgroup == "token":
                    piece = found.group()
                    regex_may_start = piece in _REGEX_AFTER
                    if piece == "{":
                        braces.append(False)
                elif found.lastgroup is None:
                    self.errors += 1
            yield text[at:end]
            at = end


def js_cut(text: str) -> list[str]:
    return list(ScriptCut(text).pieces())


@F.arrow_udf(StructType([StructField("pieces", ArrayType(StringType())), StructField("errors", IntegerType())]))
def _js_cuts(texts: pa.Array) -> pa.Array:
    flat, ends, errors = [], [0], []
    for text in texts:  # one text at a time in Python
        cut = ScriptCut(text.as_py() or "")
        flat.append(pa.array(list(cut.pieces()), pa.string()))
        ends.append(ends[-1] + len(flat[-1]))
        errors.append(cut.errors)
    pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(flat) if flat else pa.array([], pa.string()))
    return pa.StructArray.from_arrays([pieces, pa.array(errors, pa.int32())], names=["pieces", "errors"])


GO_PATTERN = "|".join(
    [r"\s++", r"//[^\n]*+", _BLOCK, r"`[^`]*+`", r"\"(?:[^\"\\\n]|\\.)*+\"", r"'(?:[^'\\\n]|\\.)++'",
     r"0[xX][0-9a-fA-F_]++|0[bB][01_]++|0[oO][0-7_]++|(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9_]++)?i?",
     r"[\p{L}_][\p{L}\p{Nd}_]*+", _op(GO_OPERATORS), r"[\s\S]"]
)


def js_pieces(files: DataFrame) -> DataFrame:
    """Adds ``pieces`` and ``errors``, the number of characters that are no token; templates
    with substitutions are split, however deep they nest."""
    content = F.col("content")
    blanked = F.when(
        F.startswith(content, F.lit("#!")),
        F.concat(F.regexp_replace(F.regexp_extract(content, r"^[^\r\n]*", 0), r"[\s\S]", " "),
                 F.regexp_replace(content, r"^[^\r\n]*", "")),
    ).otherwise(content)
    return files.withColumn("cut", _js_cuts(blanked)).withColumns({"pieces": F.col("cut.pieces"), "errors": F.col("cut.errors")}).drop("cut")


def go_pieces(files: DataFrame) -> DataFrame:
    """Adds ``pieces`` and ``errors``."""
    cut = files.withColumn("pieces", F.regexp_extract_all(F.col("content"), F.lit(GO_PATTERN), F.lit(0)))
    return cut.withColumn("errors", F.size(F.filter("pieces", lambda p: go_kind(p) == "error")))


def js_kind(text: Column) -> Column:
    first = F.substring(text, 1, 1)
    many = F.length(text) > 1
    return (
        F.when(F.rlike(text, F.lit(r"\A(?:[\s\u00a0\ufeff\u2028\u2029]|//|/\*|<!--)")), F.lit("trivia"))
        .when((first == "`") & many, F.when(F.endswith(text, F.lit("`")), F.lit("template")).otherwise(F.lit("tstart")))
        .when((first == "}") & many, F.when(F.endswith(text, F.lit("`")), F.lit("tend")).otherwise(F.lit("tmid")))
        .when(first.isin("\"", "'") & many, F.lit("string"))
        .when((first == "/") & many & (text != "/="), F.lit("regex"))
        .when(F.rlike(text, F.lit(r"\A\.?[0-9]")), F.lit("number"))
        .when(F.rlike(text, F.lit(r"\A[\p{L}\p{Nl}$_]")), F.when(text.isin(JS_RESERVED), F.lit("keyword")).otherwise(F.lit("ident")))
        .when((first == "#") & many, F.lit("private"))
        .when(text.isin(JS_PUNCTUATION), F.lit("punct"))
        .when(text.isin(JS_OPERATORS), F.lit("op"))
        .otherwise(F.lit("error"))
    )


def go_kind(text: Column) -> Column:
    first = F.substring(text, 1, 1)
    many = F.length(text) > 1
    return (
        F.when(F.rlike(text, F.lit(r"\A\s")), F.lit("trivia"))
        .when(F.rlike(text, F.lit(r"\A/[/*]")), F.lit("comment"))
        .when(first.isin("\"", "`") & many, F.lit("string"))
        .when((first == "'") & many, F.lit("rune"))
        .when(F.rlike(text, F.lit(r"\A\.?[0-9]")), F.lit("number"))
        .when(F.rlike(text, F.lit(r"\A[\p{L}_]")), F.when(text.isin(GO_KEYWORDS), F.lit("keyword")).otherwise(F.lit("ident")))
        .when(text.isin(GO_OPERATORS), F.lit("op"))
        .otherwise(F.lit("error"))
    )


def by_file():
    return Window.partitionBy("file_id").orderBy("pos")


def before():
    return by_file().rowsBetween(Window.unboundedPreceding, -1)


def up_to():
    return by_file().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def placed(files: DataFrame) -> DataFrame:
    """Moves each text once, hash-partitioned by file: the only exchange of texts."""
    return files.repartition(buckets(files.sparkSession), "file_id")


def _explode(cut: DataFrame, kind: Column, breaks: str) -> DataFrame:
    """Files with their pieces, already placed → pieces with byte offset, line and column."""
    rows = cut.select("file_id", "repo", "path", F.posexplode("pieces").alias("pos", "text"))
    rows = rows.withColumn("kind", kind).withColumn("size", F.octet_length("text"))
    wrapped = F.rlike(F.col("text"), F.lit(breaks))
    # From the right: a pattern that looks for its end would look again from every place of a long line.
    tail = F.octet_length(F.substring_index(F.substring_index(F.col("text"), "\n", -1), "\r", -1))
    rows = rows.withColumns({
        "breaks": F.when(wrapped, F.regexp_count(F.col("text"), F.lit(breaks))).otherwise(F.lit(0)),
        "tail": F.when(wrapped, tail),
    })
    rows = rows.withColumns({
        "off": F.coalesce(F.sum("size").over(before()), F.lit(0)),
        "line": (F.coalesce(F.sum("breaks").over(before()), F.lit(0)) + 1).cast("int"),
    })
    start = F.last(F.col("off") + F.col("size") - F.col("tail"), ignorenulls=True).over(before())
    return rows.withColumn("col", (F.col("off") - F.coalesce(start, F.lit(0)) + 1).cast("int"))


def js_tokens(files: DataFrame) -> DataFrame:
    """tokens(file_id, repo, path, pos, idx, kind, text, line, col, off, size) of script files."""
    return js_tokens_of(js_pieces(placed(files.select("file_id", "repo", "path", "content"))))


def js_tokens_of(cut: DataFrame) -> DataFrame:
    """The same of files that are cut and placed already."""
    rows = _explode(cut, js_kind(F.col("text")), r"\r\n|\r|\n")
    kept = rows.where(~F.col("kind").isin("trivia", "error"))
    return kept.select(
        "file_id", "repo", "path", "pos", (F.row_number().over(by_file()) - 1).alias("idx"), "kind", "text", "line", "col", "off", "size"
    )


def go_pieces_with_ends(cut: DataFrame) -> DataFrame:
    """Go pieces; white space that ends a statement becomes a ``;`` of kind ``end``."""
    rows = _explode(cut, go_kind(F.col("text")), r"\n")
    solid = ~F.col("kind").isin("trivia", "comment")
    closing = F.col("kind").isin("ident", "number", "rune", "string") | F.col("text").isin(
        "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"
    )
    ended = F.last(F.when(solid, closing), ignorenulls=True).over(before())
    gap = (F.col("kind") == "trivia") & (F.col("breaks") > 0) & ended
    return rows.withColumn("gap", gap).withColumns({
        "kind": F.when(F.col("gap"), F.lit("end")).otherwise(F.col("kind")),
        "text": F.when(F.col("gap"), F.lit(";")).otherwise(F.col("text")),
    })


def go_tokens(files: DataFrame) -> DataFrame:
    rows = go_pieces_with_ends(go_pieces(placed(files.select("file_id", "repo", "path", "content"))))
    kept = rows.where(~F.col("kind").isin("trivia", "comment", "error"))
    return kept.select(
        "file_id", "repo", "path", "pos", (F.row_number().over(by_file()) - 1).alias("idx"), "kind", "text", "line", "col", "off", "size"
    )
