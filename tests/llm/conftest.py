import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; an input may have them too.
CLASHES = ("doc", "h", "ctx", "n", "maybe", "part", "id", "cell", "size", "score", "kept", "in_0", "mix_size", "digest", "page", "copy", "rep", "cid", "class_id")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text[, source]) as a documents table."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, NAMES)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 7000}" for i in range(40_000))
    base = " ".join(f"a{i}" for i in range(120))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, base), (7, base), (7, base), (8, base.upper()),
        (9, base + " tail"), (10, "x " * 3000), (11, long), (None, base), (None, None), (12, "é Ä İ ς Σ \u00a0 \u0085 y"), (13, "a" * 50_000),
    ]


@pytest.fixture(scope="session")
def with_clashes():
    def add(df):
        from pyspark.sql import functions as F

        return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))

    return add
