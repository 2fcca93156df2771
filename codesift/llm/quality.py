"""Quality classifier from weak labels.

1. LABELLERS, overlapping heuristics over signals of the whole text, vote good, bad or
   abstain for every document.  Only the counts of their joint votes leave the executors,
   3 ** len(LABELLERS) rows at most, whatever the corpus.
2. Expectation-maximisation over these counts estimates how often each labeller gives
   each vote on good and on bad documents, and from that the posterior of every joint vote.
3. The posteriors of a bounded sample (SAMPLE documents of smallest hash) are the labels
   on which a linear scorer over hashed word shapes is trained; it scores every document.

The labellers see ratios against fixed bounds; the scorer sees how words look (case,
length, edges, symbols, whether they repeat the one before) and pairs of such shapes, so
it also ranks documents between the bounds.

Defined cases: a document without words, or a null text, gets score 0 and is rejected;
repeated rows get equal scores; rows without id are drawn by their texts; an empty table,
or one without any words, gives rows of score 0.  Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.words import BASES, Words, mix, prefix_sums, run_hash, word_slices

FEATURES = 1 << 12
SAMPLE = 8192
KEEP_AT = 0.5
EM_ROUNDS = 60
EPOCHS = 30
RUN = 5  # words of a repeated run

#: name: (good if below, bad if above) for a ratio that grows with bad quality.
LABELLERS = {
    "symbols": (0.03, 0.10),  # unusual punctuation among all bytes of words
    "capitals": (0.12, 0.40),  # A-Z among letters
    "repeated_words": (0.55, 0.80),  # words that occurred before in the text
    "stutter": (0.02, 0.15),  # words equal to the one before
    "bars": (0.01, 0.10),  # words that are one symbol only
    "shouts": (0.05, 0.25),  # words that end in "!"
    "endless": (0.985, 0.997),  # words that don't end a sentence
    "repeated_runs": (0.10, 0.40),  # runs of RUN words that occurred before
}
#: Labellers that look at one way to be bad.
KINDS = (("symbols", "bars"), ("capitals", "shouts"), ("repeated_words", "stutter", "repeated_runs"), ("endless",))
SHORT = 20  # ratios of texts with fewer words say little: the last labellers abstain there
_ON_LONG = {"repeated_words", "endless", "repeated_runs"}

_U64 = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_USUAL = np.zeros(256, bool)
_USUAL[[ord(c) for c in ".,;:'\"-?!()"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ODD = ~(_LETTER | _USUAL | _DIGIT)


def _repeats(doc: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """How many values of each text occurred before in it."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    again = np.zeros(len(d), bool)
    again[1:] = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    return np.bincount(d[again], minlength=texts)


def _in_words(flags: np.ndarray, words: Words) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[words.end] - sums[words.start]


def votes(words: Words) -> np.ndarray:
    """For each text the joint vote: base-3 digits in the order of LABELLERS, 0 abstain, 1 good, 2 bad; -1 without words."""
    n = words.counts
    texts, doc = len(n), words.doc
    out = np.full(texts, -1, np.int64)
    if not len(doc):
        return out
    data, hashes = words.data, words.hashes()
    size = words.end - words.start
    per_text = lambda x: np.bincount(doc, x, minlength=texts)
    odd, upper, letters = (_in_words(table[data], words) for table in (_ODD, _UPPER, _LETTER))
    last = data[words.end - 1]
    same = np.zeros(len(doc), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    runs = np.flatnonzero(np.arange(len(doc)) + RUN <= words.first[doc + 1])
    sums = prefix_sums(hashes, BASES[0])
    run_value = run_hash(sums, BASES[0], runs, runs + RUN)
    some = np.maximum(n, 1)
    ratio = {
        "symbols": per_text(odd) / np.maximum(per_text(size), 1),
        "capitals": per_text(upper) / np.maximum(per_text(letters), 1),
        "repeated_words": _repeats(doc, hashes, texts) / some,
        "stutter": per_text(same) / some,
        "bars": per_text((size == 1) & _ODD[data[words.start]]) / some,
        "shouts": per_text(last == 33) / some,
        "endless": 1 - per_text((last == 46) | (last == 63) | (last == 33)) / some,
        "repeated_runs": _repeats(doc[runs], run_value, texts) / np.maximum(np.bincount(doc[runs], minlength=texts), 1),
    }
    total = np.zeros(texts, np.int64)
    for name, (good, bad) in LABELLERS.items():
        vote = np.where(ratio[name] > bad, 2, np.where(ratio[name] < good, 1, 0))
        if name in _ON_LONG:
            vote[n < SHORT] = 0
        total = total * 3 + vote
    out[n > 0] = total[n > 0]
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Posterior of ``good`` for each joint vote, by expectation-maximisation.

    Bad documents are of several kinds that few labellers see at once, so the latent class
    is good or one of KINDS.  Every labeller has a rate of bad votes for each class; an
    abstention says nothing.  Starts from: a document is of the kinds whose labellers call
    it bad, else good.  Rates are smoothed by one pseudo-vote each."""
    m, names = len(LABELLERS), list(LABELLERS)
    digits = np.stack([patterns // 3**i % 3 for i in range(m - 1, -1, -1)], 1)
    says_bad, says_good = digits == 2, digits == 1
    likely = np.full((len(patterns), 1 + len(KINDS)), 0.02)
    for k, kind in enumerate(KINDS):
        likely[:, k + 1] += says_bad[:, [names.index(n) for n in kind]].any(1)
    likely[:, 0] += ~says_bad.any(1)
    for _ in range(EM_ROUNDS):
        likely /= likely.sum(1, keepdims=True)
        mass = likely * counts[:, None]
        bad, voted = mass.T @ says_bad + 1, mass.T @ (says_bad | says_good) + 2
        rate = bad / voted
        log_odds = np.log(mass.sum(0) + 1) + says_bad @ np.log(rate.T) + says_good @ np.log(1 - rate.T)
        likely = np.exp(log_odds - log_odds.max(1, keepdims=True))
    return likely[:, 0] / likely.sum(1)


def shapes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, share) of hashed word shapes and of pairs of them; shares of a text add up to 1."""
    texts, doc, n = len(words.counts), words.doc, words.counts
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    data, hashes = words.data, words.hashes()
    size = words.end - words.start

    def kind(at: np.ndarray) -> np.ndarray:
        byte = data[at]
        return np.select([_UPPER[byte], _LETTER[byte], _DIGIT[byte], byte == 33, _USUAL[byte]], [1, 2, 3, 4, 5], 6)

    upper, odd = _in_words(_UPPER[data], words), _in_words(_ODD[data], words)
    same = np.zeros(len(doc), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    shape = kind(words.start)
    for part, base in ((kind(words.end - 1), 7), (np.minimum(size // 3, 5), 6), (np.where(upper == 0, 0, np.where(upper == size, 2, 1)), 3), (np.minimum(odd, 3), 4), (same, 2)):
        shape = shape * base + part
    pair = np.flatnonzero(np.concatenate([[False], doc[1:] == doc[:-1]]))
    one = mix(shape.astype(_U64))
    two = mix(one[pair] ^ mix(one[pair - 1] + _U64(1)))
    feature = np.concatenate([one, two]) % _U64(FEATURES)
    key, count = np.unique(np.concatenate([doc, doc[pair]]) * FEATURES + feature.astype(np.int64), return_counts=True)
    text = key // FEATURES
    return text, key % FEATURES, count / np.maximum(2 * n - 1, 1)[text]


def train(docs: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on soft labels, by Adam over mini-batches."""
    rng = np.random.default_rng(11)
    weights, bias = np.zeros(FEATURES), 0.0
    first, second, step = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), 0
    # Both classes weigh the same, however rare one is.
    weigh = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    weigh *= len(target) / weigh.sum()
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            which = np.concatenate([docs[r][0] for r in rows])
            value = np.concatenate([docs[r][1] for r in rows])
            of = np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows])
            logit = np.bincount(of, value * weights[which], minlength=len(rows)) + bias
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target[rows]) * weigh[rows] / len(rows)
            slope = np.append(np.bincount(which, value * error[of], minlength=FEATURES) + 1e-6 * weights, error.sum())
            step += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope * slope
            move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, words in word_slices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(votes(words))], names=["vote"])


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in word_slices(batch.column(1)):
            text, feature, share = shapes(words)
            edge = np.searchsorted(text, np.arange(b - a + 1))
            pieces = zip(edge[:-1], edge[1:], strict=True)
            held = [(feature[i:j].astype("<u2").tobytes(), share[i:j].astype("<f4").tobytes()) for i, j in pieces]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(votes(words)), pa.array([x for x, _ in held], pa.binary()), pa.array([y for _, y in held], pa.binary())],
                names=["h", "vote", "features", "shares"],
            )


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The scorer's weights and bias."""
    # A row without id is drawn by its text.
    h = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    texts = docs.select(h.alias("h"), F.col(text_col).alias("text"))
    told = texts.select("text").mapInArrow(_vote_rows, "vote long").groupBy("vote").agg(F.count("*").alias("n")).collect()
    told = [(r["vote"], r["n"]) for r in told if r["vote"] >= 0]
    if not told:
        return np.zeros(FEATURES), 0.0
    patterns, counts = np.array([v for v, _ in told]), np.array([n for _, n in told], float)
    posterior = dict(zip(patterns.tolist(), estimate(patterns, counts), strict=True))
    # Ids hash evenly, so this many of the smallest hashes are expected; at most ``sample`` are used.
    bound = min((1 << 63) - 1, int(min(1.0, 0.95 * sample / counts.sum()) * (1 << 64)) - (1 << 63))

    def smallest(some: DataFrame) -> list:
        drawn = some.mapInArrow(_sample_rows, "h long, vote long, features binary, shares binary").where("vote >= 0")
        return drawn.orderBy("h", "features", "shares").limit(sample).collect()

    # Of few ids or texts, repeated often, none may lie below the bound; then all are looked at.
    rows = smallest(texts.where(F.col("h") <= F.lit(bound).cast("long"))) or smallest(texts)
    held = [(np.frombuffer(r["features"], "<u2").astype(np.int64), np.frombuffer(r["shares"], "<f4").astype(float)) for r in rows]
    return train(held, np.array([posterior[r["vote"]] for r in rows]))


def scores(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    """``extra`` columns of ``docs``, score (probability of good) and kept."""
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_slices(batch.column(batch.num_columns - 1)):
                text, feature, share = shapes(words)
                logit = np.bincount(text, share * weights[feature], minlength=b - a) + bias
                score = np.where(words.counts > 0, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    own = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(extra)), F.col(text_col).alias("text"))
    schema = "".join(f"in_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(extra)) + "score double"
    return own.mapInArrow(run, schema)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc (its id), score, kept."""
    out = scores(docs, fit(docs, text_col, id_col), id_col, text_col, [id_col])
    return out.select(F.col("in_0").alias("doc"), "score", (F.col("score") >= KEEP_AT).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows, columns unchanged."""
    names = docs.columns
    out = scores(docs, fit(docs, text_col, id_col), id_col, text_col, names).where(F.col("score") >= KEEP_AT)
    return out.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(names)))
