"""Inventory: one row per file with its language, kind and reason to be skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions.text import ends_with_any, starts_with_any

DEFAULT_MAX_BYTES = 4 << 20

# Directories that hold dependencies, builds or tool state.
DEPENDENCY_DIRS = [
    ".git", ".hg", ".svn", ".idea", ".vscode", ".cache", "node_modules", "vendor", "dist", "build",
    "coverage", "target", "bin", "obj", ".next", ".nuxt", ".terraform",
]
# Test markers.
TEST_SUFFIXES = [
    "_test.go", ".test.js", ".test.jsx", ".test.ts", ".test.tsx", ".spec.js", ".spec.jsx", ".spec.ts", ".spec.tsx",
]
TEST_DIRS = ["test", "tests", "testdata", "fixtures", "__tests__", "e2e", "evals", "benchmarks"]
# Extensions by language.
LANGUAGE_EXTENSIONS = {
    "go": [".go"],
    "javascript": [".js", ".mjs", ".cjs", ".jsx"],
    "typescript": [".ts", ".tsx"],
    "python": [".py"],
    "rust": [".rs"],
    "java": [".java"],
    "kotlin": [".kt", ".kts"],
    "php": [".php"],
    "ruby": [".rb"],
    "csharp": [".cs"],
    "cpp": [".c", ".h", ".cc", ".cpp", ".cxx", ".hpp"],
    "shell": [".sh", ".bash", ".zsh", ".ps1"],
    "yaml": [".yaml", ".yml"],
    "json": [".json"],
    "toml": [".toml"],
    "xml": [".xml"],
    "markdown": [".md", ".mdx"],
    "text": [".txt"],
    "html": [".html", ".htm"],
    "css": [".css", ".scss", ".sass", ".less"],
    "sql": [".sql"],
}
# Extensions scanned as text.
TEXT_EXTENSIONS = [
    ".go", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".py", ".rs", ".java", ".kt", ".kts", ".php", ".rb",
    ".cs", ".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".sh", ".bash", ".zsh", ".ps1", ".yaml", ".yml",
    ".json", ".toml", ".xml", ".ini", ".conf", ".cfg", ".properties", ".md", ".txt",
]
SHELL_EXTENSIONS = LANGUAGE_EXTENSIONS["shell"]
CONFIG_EXTENSIONS = [".ini", ".conf", ".cfg", ".properties", ".yaml", ".yml", ".toml", ".json"]
SCRIPT_EXTENSIONS = [".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"]

BINARY_SNIFF_BYTES = 8192


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased text from the last dot of the file name, or empty."""
    return F.lower(F.regexp_extract(base_name(path), r"\.[^.]*\z", 0))


def normal_path(path: Column) -> Column:
    """Path without empty, ``.`` and resolvable ``..`` parts; NULL if it leaves the root."""
    text = F.trim(path)
    kept = F.filter(F.split(text, "/"), lambda part: ~part.isin("", "."))

    def step(stack: Column, part: Column) -> Column:
        can_pop = (F.size(stack) > 0) & (F.try_element_at(stack, F.lit(-1)) != "..")
        return F.when((part == "..") & can_pop, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(
            F.concat(stack, F.array(part))
        )

    clean = F.array_join(F.aggregate(kept, F.array().cast("array<string>"), step), "/")
    odd = F.rlike(text, F.lit(r"(?:^|/)\.{0,2}(?:/|\z)"))
    out = F.when(odd, clean).otherwise(text)
    return F.when((out != "") & (out != "..") & ~F.startswith(out, F.lit("../")), out)


def in_dependency_dir(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in DEPENDENCY_DIRS]))


def is_test(path: Column) -> Column:
    low = F.lower(path)
    parts = F.split(low, "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    in_dir = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in TEST_DIRS]))
    return ends_with_any(low, TEST_SUFFIXES) | in_dir


def is_dockerfile(path: Column) -> Column:
    base = F.lower(base_name(path))
    return (base == "dockerfile") | F.startswith(base, F.lit("dockerfile."))


def language(path: Column) -> Column:
    """Language family; a constant map lookup, so no join is needed."""
    pairs = [F.lit(x) for lang, exts in LANGUAGE_EXTENSIONS.items() for ext in exts for x in (ext, lang)]
    known = F.try_element_at(F.create_map(*pairs), extension(path))
    return F.coalesce(known, F.when(is_dockerfile(path), F.lit("dockerfile")), F.lit("other"))


def is_workflow(path: Column) -> Column:
    low = F.lower(path)
    return F.startswith(low, F.lit(".github/workflows/")) & ends_with_any(low, [".yml", ".yaml"])


def is_shell_like(path: Column) -> Column:
    return extension(path).isin(SHELL_EXTENSIONS)


def is_env_file(path: Column) -> Column:
    return F.startswith(F.lower(base_name(path)), F.lit(".env"))


def is_text_candidate(path: Column) -> Column:
    base = F.lower(base_name(path))
    return (
        is_dockerfile(path)
        | base.isin("go.mod", "go.sum", ".gitignore")
        | starts_with_any(base, [".env"])
        | extension(path).isin(TEXT_EXTENSIONS)
    )


def looks_binary(content: Column) -> Column:
    """A NUL byte in the first 8,192 bytes (not characters)."""
    head = F.decode(F.substring(content.cast("binary"), 1, BINARY_SNIFF_BYTES), "ISO-8859-1")
    return F.contains(content, F.lit("\0")) & F.contains(head, F.lit("\0"))


def file_key(repo: Column, path: Column) -> Column:
    """128-bit key: at billions of files a 64-bit hash would collide."""
    return F.unhex(F.md5(F.concat_ws("\0", repo, path)))


def inventory(
    files: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES, include_tests: bool = True, include_ignored: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Adds language, test flag and ``skip_reason`` (NULL = analysed).

    ``files`` needs repo, path, content; optional columns: size, inaccessible, walk_error,
    symlink, non_regular, git_ignored, read_error; ``carry`` names others to keep.  Purely row-wise: no shuffle, and every
    predicate that does not need the content is evaluated before it.
    """
    have = set(files.columns)

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in have else F.lit(False)

    size = F.col("size") if "size" in have else F.octet_length("content").cast("bigint")
    path = F.col("path")
    out = files.withColumn("path", normal_path(path)).where(path.isNotNull())
    out = out.withColumns({"size": size, "is_test": is_test(path), "ext": extension(path), "lang": language(path)})
    ignored = F.lit(False) if include_ignored else flag("git_ignored")
    reason = (
        F.when(ignored, F.lit("git_ignored"))
        .when(in_dependency_dir(path), F.lit("dependency_or_build_dir"))
        .when(flag("walk_error"), F.lit("walk_error"))
        .when(flag("inaccessible"), F.lit("inaccessible"))
        .when(flag("symlink"), F.lit("symlink"))
        .when(flag("non_regular"), F.lit("non_regular"))
        .when(F.col("size") > max_bytes, F.lit("too_large"))
        .when(F.col("is_test") & F.lit(not include_tests), F.lit("tests_excluded"))
    )
    return out.select(
        "repo", "path", "ext", "size", "is_test", "lang", reason.alias("skip_reason"), "content", flag("read_error").alias("read_error"),
        file_key(F.col("repo"), path).alias("file_id"), *carry,
    )


def analysed(inv: DataFrame) -> DataFrame:
    return inv.where(F.col("skip_reason").isNull())


def inventory_counts(inv: DataFrame) -> DataFrame:
    """One row per repo: files, bytes, skipped files, and the two count maps.

    Counted first per (repo, language, reason), which combines map-side and
    leaves a few dozen rows per repo for the second step.
    """
    fine = inv.groupBy("repo", "lang", "skip_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    )
    kept = F.col("skip_reason").isNull()
    by_lang = (
        fine.groupBy("repo", F.when(kept, F.col("lang")).alias("lang"), "skip_reason")
        .agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    )
    return by_lang.groupBy("repo").agg(
        F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("files"),
        F.coalesce(F.sum(F.when(kept, F.col("bytes"))), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("skipped_files"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(kept, F.struct("lang", "n"))))).alias("languages"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(~kept, F.struct("skip_reason", "n"))))
        ).alias("skipped_by_reason"),
    )
