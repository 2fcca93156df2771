"""Named queries over whole tables, and the SQL that computes the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.llm import ann, blob_ledger, exact_dedup, filter_audit, hilbert_shards, mixing, quality, spelling
from codesift.llm.bpe import encode_decode
from codesift.llm.jaccard_join import jaccard_join
from codesift.llm.quotes import format_chats
from codesift.llm.store import shared_folder
from codesift.llm.substring_dedup import substring_dedup
from codesift.llm.token_counts import token_counts

TOKEN_LIMIT = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP1_SQL = f"""
WITH texts AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts)),
earliest AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN earliest USING (h) WHERE d < doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM texts) ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def tokenizer_file(name: str) -> str:
    """Where the installed package of public vocabularies has a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return out.select(
        F.col("doc").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source")
    return plan.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


OP4_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS drawn_by
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap
  FROM sources),
summed AS (
  SELECT *, row_number() OVER w AS room, (sum(cap) OVER w - cap)::BIGINT AS capped, (sum(weight) OVER w - weight)::BIGINT AS gone,
         (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights
  FROM ranked WINDOW w AS (ORDER BY cap::DOUBLE / weight::DOUBLE, place ROWS UNBOUNDED PRECEDING)),
shared AS (SELECT *, (total - capped)::DOUBLE / (weights - gone)::DOUBLE AS share FROM summed),
level AS (SELECT arg_min(share, room) AS share FROM shared WHERE cap::DOUBLE > share * weight::DOUBLE),
plan AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT share FROM level) * weight::DOUBLE), cap::DOUBLE) AS target
  FROM shared),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate FROM plan)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN
         ('0x' || substr(md5('{mixing.SEED}:' || drawn_by), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate)
         THEN 1 ELSE 0 END) AS taken
FROM docs JOIN rated ON docs.source IS NOT DISTINCT FROM rated.source
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards.shards(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("doc").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell",
    )


def crc32_table() -> list[int]:
    """Remainders of all bytes for the reflected polynomial of CRC-32."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def op6_sql() -> str:
    """The order is cell, CRC, id, size at any size."""
    steps = hilbert_shards.curve_steps()
    to, digit = [s for s, _ in steps], [d for _, d in steps]
    chain = "placed AS (SELECT *, 0 AS state, 0 AS cell FROM levelled)"
    last = "placed"
    for bit in range(hilbert_shards.BITS - 1, -1, -1):
        octant = f"((level_size >> {bit}) & 1) + 2 * ((level_lang >> {bit}) & 1) + 4 * ((level_source >> {bit}) & 1)"
        chain += f""",
at{bit} AS (SELECT * REPLACE ({to}[state * 8 + {octant} + 1] AS state, cell * 8 + {digit}[state * 8 + {octant} + 1] AS cell) FROM {last})"""
        last = f"at{bit}"

    def levels(name: str) -> str:
        return f"""{name}s AS (SELECT {name}, floor((sum(n) OVER w - n) * 32 / sum(n) OVER ())::INT AS level_{name}
  FROM (SELECT {name}, count(*) AS n FROM documents GROUP BY {name}) WINDOW w AS (ORDER BY {name} NULLS FIRST ROWS UNBOUNDED PRECEDING))"""

    return f"""
WITH {levels("lang")},
{levels("source")},
texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {crc32_table()}::UBIGINT[] AS remainder FROM documents),
meta AS (
  SELECT doc_id, lang, source, strlen(text) + 1 AS size,
         xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
           list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::UBIGINT)),
           lambda a, b: xor(a >> 8, remainder[((xor(a, b) & 255) + 1)::BIGINT])))::BIGINT AS text_crc32
  FROM texts),
levelled AS (
  SELECT meta.*, level_lang, level_source, least(length(bin(size)) - 1, 31)::INT AS level_size
  FROM meta JOIN langs ON meta.lang IS NOT DISTINCT FROM langs.lang JOIN sources ON meta.source IS NOT DISTINCT FROM sources.source),
{chain},
ordered AS (SELECT *, row_number() OVER (ORDER BY cell, text_crc32, doc_id NULLS FIRST, size) - 1 AS p, count(*) OVER () AS n FROM {last}),
cut AS (SELECT *, (p * 8) // n AS shard FROM ordered)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (p - (shard * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard, cell::INT AS cell
FROM cut
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.decisions(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


OP8_SQL = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0)),
sets AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS k, count(*) AS n FROM shingles GROUP BY doc_id),
classes AS (SELECT k, min(doc_id) AS rep, count(*) AS n_copies, any_value(n) AS n FROM sets GROUP BY k),
held AS (SELECT rep, s FROM classes JOIN shingles ON rep = doc_id),
met AS (SELECT x.rep AS a, y.rep AS b, count(*) AS c FROM held x JOIN held y ON x.s = y.s AND x.rep < y.rep GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS label FROM classes UNION SELECT b, label FROM reach JOIN ways ON a = node),
labels AS (SELECT node, min(label) AS class_id FROM reach GROUP BY node),
degree AS (SELECT a AS node, count(*) AS n FROM ways GROUP BY a)
SELECT t.doc_id, coalesce(class_id, t.doc_id) AS class_id, coalesce(rep, t.doc_id) AS copy_id,
       coalesce(n_copies, 1)::BIGINT AS n_copies, coalesce(degree.n, 0)::BIGINT AS n_links
FROM texts t LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (k) LEFT JOIN labels ON labels.node = rep LEFT JOIN degree ON degree.node = rep
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_sql() -> str:
    """Step by step over all orders: the Shapley sum is counted here, not solved for."""
    steps = ", ".join(f"('{order}', {step}, {before}, {after}, {after - before})" for order, step, _, before, after in filter_audit.steps("ABCDE"))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {SQL_WORDS} AS w FROM documents),
told AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS t FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(q, 0) AS q, coalesce(t, 0) AS t,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM texts LEFT JOIN told USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(q) AS q, sum(t) AS t FROM masks GROUP BY ALL),
steps(filter_order, step, b, a, f) AS (VALUES {steps}),
counted AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (mask & a = 0) AS kept, sum(n) FILTER (mask & b = 0 AND mask & f <> 0) AS removed,
    sum(n) FILTER (mask & b <> 0 AND mask & f <> 0) AS redundant, sum(n) FILTER (mask = f) AS unique_fails,
    sum(q) FILTER (mask & b = 0 AND mask & f <> 0) AS good_lost, sum(t) FILTER (mask & b = 0 AND mask & f <> 0) AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM counted
"""


def op12_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a ledger of its own, as in the first run over a corpus."""
    out = blob_ledger.scan(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/ledger_{uuid.uuid4().hex}")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = (count(r.name) for r in blob_ledger.RULES)
    spans = blob_ledger.joined(F.col("spans"))
    return out.select(F.col("doc").alias("doc_id"), *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op12_sql() -> str:
    """Where matches lie follows from the texts between them."""

    def matches(no: int, kind: str, pattern: str, least: str) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        return f"""
  SELECT doc_id, key, {no} AS no, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
    'a': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'v': {least}}})) AS s
  FROM (SELECT doc_id, key, string_split_regex(text, {p}) AS g, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, 2) AS v FROM texts)""" if kind == "assign" else f"""
  SELECT doc_id, key, {no}, '{kind}', unnest(list_transform(range(1, len(m) + 1), lambda i: {{
    'a': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'v': {least}}}))
  FROM (SELECT doc_id, key, string_split_regex(text, {p}) AS g, regexp_extract_all(text, {p}) AS m FROM texts)"""

    assign, access, hexes = blob_ledger.RULES
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS key, coalesce(text, '') AS text FROM documents),
found AS ({matches(0, "assign", assign.pattern, "length(v[i]) >= 8")}
  UNION ALL {matches(1, "access", access.pattern, "length(m[i]) >= 16")}
  UNION ALL {matches(2, "hex", f"[0-9a-f]{{{hexes.least},}}", "true")}),
kept AS (SELECT key, no, kind, s.a::BIGINT AS a, (s.a + s.n)::BIGINT AS b FROM found WHERE s.v),
lists AS (SELECT key, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) AS spans, count(*) FILTER (no = 0) AS n0, count(*) FILTER (no = 1) AS n1, count(*) FILTER (no = 2) AS n2 FROM kept GROUP BY key)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN lists USING (key)
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def sql_crc32(text: str) -> str:
    """CRC-32 of a text in SQL; ``remainder`` must hold ``crc32_table``."""
    return f"""xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
      list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UBIGINT)),
      lambda a, b: xor(a >> 8, remainder[((xor(a, b) & 255) + 1)::BIGINT])))"""


def op13_sql() -> str:
    """Near words meet where one letter of either is left out, at equal places for a
    replaced one; every deletion is made."""
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS said, count(*) AS n, {crc32_table()}::UBIGINT[] AS remainder FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {sql_crc32("said")} AS h FROM counted),
cut AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT x.word AS a, y.word AS b FROM gaps x JOIN gaps y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT DISTINCT words.word, gaps.word FROM gaps JOIN words ON rest = words.word
  UNION SELECT DISTINCT gaps.word, words.word FROM gaps JOIN words ON rest = words.word),
ranked AS (SELECT a, b, words.n, row_number() OVER (PARTITION BY a ORDER BY words.n DESC, encode(b)) AS r, count(*) OVER (PARTITION BY a) AS n_near FROM near JOIN words ON b = word),
best AS (SELECT * FROM ranked WHERE r = 1),
held AS (
  SELECT word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= 2 * words.n THEN b END AS form, CASE WHEN best.n >= 2 * words.n THEN best.n END AS form_n
  FROM words LEFT JOIN best ON a = word),
ways AS (SELECT word, word AS at FROM held UNION ALL SELECT ways.word, held.form FROM ways JOIN held ON ways.at = held.word WHERE held.form IS NOT NULL),
ends AS (SELECT ways.word, ways.at AS root FROM ways JOIN held ON ways.at = held.word WHERE held.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM held JOIN ends USING (word)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ann": op2_ann,
    "op3_bpe": op3_bpe,
    "op4_mix": op4_mix,
    "op5_token_counts": op5_token_counts,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality": op9_quality,
    "op10_chat_format": op10_chat_format,
    "op11_filter_audit": op11_filter_audit,
    "op12_blob_ledger": op12_blob_ledger,
    "op13_spelling": op13_spelling,
}


def oracles() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL, "op4_mix": OP4_SQL, "op6_hilbert_shards": op6_sql(), "op7_exact_dedup": OP7_SQL, "op8_jaccard_join": OP8_SQL,
        "op11_filter_audit": op11_sql(), "op12_blob_ledger": op12_sql(), "op13_spelling": op13_sql(),
    }
