"""Substring dedup, exact dedup, Jaccard join and the two tokenizers against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from codesift.llm import exact_dedup, jaccard_join
from codesift.llm.bpe import OffsetDecoder, coder, encode_decode
from codesift.llm.components import roots
from codesift.llm.queries import QUERIES, oracles, tokenizer_file
from codesift.llm.substring_dedup import COVER, PERIOD, substring_dedup
from codesift.llm.token_counts import token_counts

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall((text or "").encode())


def test_every_residue_is_a_difference_of_the_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def brute_substrings(rows):
    """Window by window, in the order of ids; a missing id is later than all others."""
    big = float("inf")
    first = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - 49):
            key = b" ".join(w[p : p + 50])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = collections.Counter()
    for i, text in rows:
        w = words(text)
        stay = [True] * len(w)
        for p in range(len(w) - 49):
            if first[b" ".join(w[p : p + 50])] < (big if i is None else i):
                stay[p : p + 50] = [False] * 50
        out[i, len(w), stay.count(False), b" ".join(x for x, s in zip(w, stay, strict=True) if s).decode()] += 1
    return out


def planted_rows(seed=5, n=150):
    """Random texts over few words, with shared, shifted and edited passages."""
    rnd = random.Random(seed)
    passages = [[f"p{k}_{rnd.randint(0, 9)}" for _ in range(rnd.choice([49, 50, 51, 80, 130]))] for k in range(6)]
    rows = []
    for i in range(n):
        w = [f"r{rnd.randint(0, 999)}" for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            part = list(rnd.choice(passages))
            if rnd.random() < 0.5:
                part[rnd.randrange(len(part))] = "edit"
            w += part[rnd.randint(0, 5) :] + [f"r{rnd.randint(0, 999)}" for _ in range(rnd.randint(0, 3))]
        rows.append((i, " ".join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["planted", "odd"])
def test_substring_dedup_equals_brute_force(docs_of, odd_rows, with_clashes, kind):
    rows = planted_rows() if kind == "planted" else odd_rows
    got = substring_dedup(with_clashes(docs_of(rows)).repartition(5)).collect()
    assert collections.Counter((r["doc"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_substrings(rows)


def thue_morse(n):
    """Two strings that every polynomial modulo a power of two takes for equal, if long enough."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomials_confuse_are_told_apart(docs_of):
    for n in (32, 64, 1024, 4096):
        one, two = thue_morse(n)
        rest = " ".join(f"w{i}" for i in range(60))
        rows = [(1, f"{one} {rest}"), (2, f"{two} " + " ".join(f"w{i} {two}" for i in range(60))), (3, f"{rest[:90]} {one} {rest[90:]}"), (4, f"{rest[:90]} {two} {rest[90:]}")]
        got = substring_dedup(docs_of(rows)).collect()
        assert collections.Counter((r["doc"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_substrings(rows)
        pair = [(1, f"{one} " + " ".join(f"w{i}" for i in range(60))), (2, f"{two} " + " ".join(f"w{i}" for i in range(60)))]
        linked = {r["doc"]: (r["n_copies"], r["n_links"]) for r in jaccard_join.jaccard_join(docs_of(pair)).collect()}
        assert linked == {1: (1, 1), 2: (1, 1)}


def test_hashes_follow_the_word_alone():
    import numpy as np

    from codesift.llm.words import split_words

    said = [b"a", b"ab", b"a\0", b"\0", b"\0\0", b"x" * 8, b"x" * 9, b"x" * 64, b"x" * 65, "é".encode(), b"abcdefgh", b"abcdefghabcdefgh"]
    text = b" ".join(said) + b"  " + b"\n".join(reversed(said))
    words = split_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    for seed in (0, 1):
        h = words.hashes(seed).tolist()
        assert h[: len(said)] == h[len(said) :][::-1] and len(set(h)) == len(said)
    assert set(words.hashes(0).tolist()).isdisjoint(words.hashes(1).tolist())


def test_substring_dedup_of_many_texts_under_one_id(docs_of):
    # 3,000 texts are enough for some of them to share 16 bits of any hash; lengths differ.
    rnd = random.Random(6)
    passages = [[f"p{k}_{i}" for i in range(60)] for k in range(3)]
    rows = [(k, " ".join(p)) for k, p in enumerate(passages)]
    for i in range(3000):
        w = [f"r{rnd.randint(0, 999)}" for _ in range(rnd.randint(0, 40))]
        rows.append((None if i % 3 else 7, " ".join([f"n{i}", *w, *rnd.choice(passages)[rnd.randint(0, 10) :], *w[:5]])))
    got = substring_dedup(docs_of(rows).repartition(3)).collect()
    assert collections.Counter((r["doc"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_substrings(rows)


def test_substring_dedup_with_a_narrow_hash(docs_of, monkeypatch):
    # Even if all hashes were equal, texts of different length are told apart.
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    shared = [f"s{i}" for i in range(60)]
    rows = [(1, " ".join(shared)), *((None, " ".join([f"n{'x' * k}"] * k + shared + ["end"] * (k % 4))) for k in range(40))]
    got = substring_dedup(docs_of(rows).repartition(3)).collect()
    assert collections.Counter((r["doc"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_substrings(rows)


def test_exact_dedup_decisions(docs_of, odd_rows):
    # Two slots only: every row passes the filter, and the result is the same.
    for slots in (exact_dedup.FILTER_SLOTS, 2):
        got = exact_dedup.decisions(docs_of(odd_rows).repartition(4), slots=slots).collect()
        low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        groups = collections.defaultdict(list)
        for i, t in odd_rows:
            groups[low(t)].append(i)
        want = collections.Counter()
        for text, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            for place, i in enumerate(sorted(ids, key=lambda x: (x != keep, x is None, x or 0))):
                want[i, keep, len(ids), place == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
        assert collections.Counter((r["doc"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in got) == want


def test_dropping_exact_copies_keeps_columns(docs_of, odd_rows, with_clashes):
    docs = with_clashes(docs_of(odd_rows))
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for _, t in odd_rows})


@pytest.fixture
def split_early(spark):
    """Adaptive execution takes a few kilobytes for a hot piece."""
    settings = {"skewJoin.skewedPartitionThresholdInBytes": "2k", "skewJoin.skewedPartitionFactor": "2", "advisoryPartitionSizeInBytes": "1k", "coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(f"spark.sql.adaptive.{k}", None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    yield
    for k, v in before.items():
        spark.conf.unset(f"spark.sql.adaptive.{k}") if v is None else spark.conf.set(f"spark.sql.adaptive.{k}", v)


HOT_ROWS = [(i, " ".join(f"h{k}" for k in range(60)) if i % 2 else f"own text of {i} and nobody else " * (1 + i % 4 // 2)) for i in range(6000)]


@pytest.mark.parametrize("operator", [exact_dedup.decisions, jaccard_join.jaccard_join])
def test_a_text_of_half_of_all_rows_is_split(docs_of, split_early, operator):
    out = operator(docs_of(HOT_ROWS).repartition(16))
    got = out.collect()
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc"] for r in got) == list(range(6000))
    size = "group_size" if operator is exact_dedup.decisions else "n_copies"
    assert all(r[size] == (3000 if r["doc"] % 2 else 1) for r in got)


def brute_links(rows):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets.setdefault(frozenset(b" ".join(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if w else (i,), []).append(i)
    keys = [k for k in sets if isinstance(k, frozenset)]
    links = [(x, y) for n, x in enumerate(keys) for y in keys[:n] if len(x & y) >= 0.8 * len(x | y)]
    group = {k: k for k in sets}
    for x, y in links:
        a, b = group[x], group[y]
        group = {k: a if g == b else g for k, g in group.items()}
    label = {}
    for k, g in group.items():
        label[g] = min(label.get(g, 1 << 63), *((1 << 63) - 1 if i is None else i for i in sets[k]))
    degree = collections.Counter(k for pair in links for k in pair)
    return collections.Counter((i, label[group[k]], len(ids), degree[k]) for k, ids in sets.items() for i in ids)


def near_rows(seed=3, families=12, copies=12):
    rnd = random.Random(seed)
    rows, i = [], 0
    for f in range(families):
        base = [f"v{rnd.randint(0, 5000)}" for _ in range(rnd.choice([6, 60, 200]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, len(w) // 30 + 1)):
                w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 99)}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("limit", [512, 3])
def test_jaccard_join_equals_brute_force(docs_of, monkeypatch, limit):
    # With small buckets every level of the paths, and blocks against blocks, are used.
    monkeypatch.setattr(jaccard_join, "LIMIT", limit)
    monkeypatch.setattr(jaccard_join, "SET_BLOCK", limit)
    monkeypatch.setattr(jaccard_join, "MAX_DEPTH", 4)
    rows = near_rows()
    got = jaccard_join.jaccard_join(docs_of(rows).repartition(3)).collect()
    assert collections.Counter((r["doc"], r["class_id"], r["n_copies"], r["n_links"]) for r in got) == brute_links(rows)


def test_jaccard_join_of_odd_rows(docs_of, odd_rows, with_clashes):
    rows = [r for r in odd_rows if words(r[1])]
    got = jaccard_join.jaccard_join(with_clashes(docs_of(odd_rows))).collect()
    full = [r for r in got if r["n_copies"] > 1 or r["doc"] not in (1, 2, 3)]
    assert collections.Counter((r["doc"], r["class_id"], r["n_copies"], r["n_links"]) for r in full if (r["doc"], r["class_id"]) != (None, (1 << 63) - 1)) == collections.Counter(
        {k: n for k, n in brute_links(rows).items()}
    )
    assert {(r["doc"], r["class_id"], r["n_links"]) for r in got if r["doc"] in (1, 2, 3)} == {(1, 1, 0), (2, 2, 0), (3, 3, 0)}


def test_jaccard_join_of_many_texts_under_one_id(docs_of):
    # Families of three near copies: three without id, and two that share their ids.
    near = [[" ".join([*(f"{f}{i}" for i in range(60)), f"tail{k}"]) for k in range(3)] for f in "uvwxy"]
    rows = [(None, text) for family in near[:3] for text in family]
    rows += [(100 + k, text) for family in near[3:] for k, text in enumerate(family)]
    rows += [rows[0], rows[-1]]
    got = jaccard_join.jaccard_join(docs_of(rows).repartition(3)).collect()
    assert collections.Counter((r["doc"], r["class_id"], r["n_copies"], r["n_links"]) for r in got) == brute_links(rows)
    assert {r["n_links"] for r in got} == {2}


def test_one_of_each_near_group_stays(docs_of):
    rows = near_rows(families=4)
    kept = jaccard_join.keep_one_of_each_group(docs_of(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({k[1] for k in brute_links(rows)})
    assert kept.columns == docs_of(rows).columns


def test_one_row_of_each_near_group_stays_without_unique_ids(docs_of):
    near = [[" ".join([*(f"{f}{i}" for i in range(60)), f"tail{k}"]) for k in range(3)] for f in "uvwxyz"]
    rows = [(None, t) for t in near[0]]  # no ids
    rows += [(1, near[1][0]), (None, near[1][1]), (None, near[1][2])]  # beside a row with id
    rows += [(2, t) for t in near[2]]  # one id for all
    rows += [(3, near[3][0]), (4, near[3][1]), (4, near[4][0])]  # one of two texts of an id is a copy
    rows += [(5, near[5][0]), (5, near[5][0]), (6, near[5][1]), (5, None), (None, ""), (None, None)]  # repeated rows; no words
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one_of_each_group(docs_of(rows).repartition(3)).collect()]
    full = [(i, t) for i, t in kept if t]
    assert sorted((i is None, i or 0, t[0]) for i, t in full) == [(False, 1, "v"), (False, 2, "w"), (False, 3, "x"), (False, 4, "y"), (False, 5, "z"), (True, 0, "u")]
    assert collections.Counter(r for r in kept if not r[1]) == collections.Counter([(5, None), (None, ""), (None, None)])


def test_components(spark):
    rnd = random.Random(1)
    edges = {(min(e), max(e)) for e in ((rnd.randint(-40, 400), rnd.randint(-40, 400)) for _ in range(220)) if e[0] != e[1]}
    edges |= {(k, k + 1) for k in range(1000, 1100)}
    got = {r["node"]: r["root"] for r in roots(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == root


HARD = ["", " ", "\n\n ", "It's THE end", "aaaaaaaaa", "ab" * 3000, "!" * 500, "a<|endoftext|>b", "<|startoftext|>", "</w>", "½ Ⅷ 9 99", "中文 語", "🙂👨‍👩‍👧", "ΑΣ Σ", "İ", "e\u0301", "a\x1cb\x85c\u00a0d", "\x00", "\u208f\U0001e9e1"]


@pytest.fixture(scope="session")
def texts():
    import pyarrow.parquet as pq

    rnd = random.Random(2)
    made = ["".join(rnd.choice("abcdeinorst 'é\n") for _ in range(rnd.choice([3, 30, 300]))) for _ in range(400)]
    return HARD + made + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()


def test_backtracking_gives_the_librarys_ids_and_text(docs_of, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = [*enumerate(texts), (None, None)]
    got = encode_decode(docs_of(rows).repartition(4), tokenizer_file("word_bpe_49k.json")).collect()
    by = {r["doc"]: r for r in got}
    assert by[None]["ids"] == [] and by[None]["decoded"] == ""
    for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert by[i]["ids"] == want.ids, repr(texts[i][:80])
        assert by[i]["decoded"] == library.decode(want.ids, skip_special_tokens=False)


def test_pairs_table_agrees_with_merging():
    """Encoding the letters of two tokens gives them back exactly if they are compatible."""
    from codesift.llm.vocabulary import merged

    encoder, decoder = coder(tokenizer_file("word_bpe_49k.json"))
    assert isinstance(decoder, OffsetDecoder)
    spelled = {i: s for s, i in encoder.vocab.ids.items()}
    rnd = random.Random(4)
    inner = [i for i in encoder.shorter if ord(spelled[i][-1]) < 0xE000]
    for _ in range(3000):
        a, b = rnd.choice(inner), rnd.choice(list(encoder.shorter))
        assert encoder.fits(a, b) == (merged(encoder.vocab, spelled[a] + spelled[b]) == [a, b])


def test_token_counts_are_the_librarys(docs_of, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    got = {r["doc"]: r for r in token_counts(docs_of([*enumerate(texts), (None, None)]), tokenizer_file("byte_bpe_50k.json")).collect()}
    assert (got[None]["n_bytes"], got[None]["n_tokens"]) == (0, 0)
    for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len(texts[i].encode()), len(want.ids)), repr(texts[i][:80])


def test_empty_tables(docs_of):
    none = docs_of([])
    assert substring_dedup(none).count() == 0
    assert exact_dedup.decisions(none).count() == 0
    assert exact_dedup.drop_exact_copies(none).count() == 0
    assert jaccard_join.jaccard_join(none).count() == 0
    assert encode_decode(none, tokenizer_file("word_bpe_49k.json")).count() == 0
    assert token_counts(none, tokenizer_file("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op4_mix", "op6_hilbert_shards", "op7_exact_dedup", "op8_jaccard_join"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = con.sql(oracles()[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    rows = collections.Counter(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows == collections.Counter(want.fetchall())


def test_crc_column(spark, docs_of):
    from codesift.llm.hilbert_shards import shards

    got = shards(docs_of([(1, "abc"), (2, None), (3, "é")])).collect()
    assert {r["doc"]: (r["size"], r["crc"]) for r in got} == {i: (len(b) + 1, zlib.crc32(b)) for i, b in ((1, b"abc"), (2, b""), (3, "é".encode()))}
    assert spark.range(0).where(F.col("id") > 0).count() == 0
