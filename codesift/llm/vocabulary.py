"""A byte-pair vocabulary read from a tokenizer file: tokens, merges, special strings.

Symbols are single characters: a byte of a pre-token is the character its vocabulary
writes for it, and a last byte that carries the end-of-word mark is a character of its
own (END above the plain one), so every token is a plain string of symbols.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import regex

END = 0xE000
LIMIT = 1 << 30  # above every rank
#: The patterns that the two kinds of file split texts with.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the tokenizer files understand it (regex counts U+001C to U+001F as well).
SPACE = r"[\t-\r \x85\xa0  -     　]"


def _pattern(source: str) -> regex.Pattern:
    inner = SPACE[1:-1]
    source = source.replace(r"[^\s", f"[^{inner}").replace(r"\S", f"[^{inner}]").replace(r"\s", SPACE)
    return regex.compile(source)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it,
    else the next free one from U+0100."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in printed else chr(next(free)) for b in range(256)]


class Vocabulary:
    """What encoders need: ``ids`` by symbol string, ``rank`` by pair of ids, ``made``
    (left, right, rank) of each token that merging can reach."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        symbols = byte_symbols()
        self.plain = dict(enumerate(symbols))
        self.ids = {self._symbols(s): i for s, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.result: dict[tuple[int, int], int] = {}
        vocab = model["vocab"]
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = (vocab[left], vocab[right])
            if key not in self.rank:
                self.rank[key], self.result[key] = r, vocab[left + right]
        self.path = path
        self.split, spaces_matter = self._splitter(told["pre_tokenizer"])
        self.steps = self._normal_steps(told["normalizer"], spaces_matter)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = str.maketrans({b: symbols[b] for b in range(256)})

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(END + ord(token[-1]))
        return token

    def _normal_steps(self, told: dict | None, spaces_matter: bool) -> list[str]:
        steps = told["normalizers"] if told and told["type"] == "Sequence" else [told] if told else []
        known = [s["type"] for s in steps]
        if not set(known) <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"unknown normalizer in {known}")
        # Which white space separates two words is lost anyway where the splitter drops it.
        return [k for k in known if spaces_matter or k != "Replace"]

    def _splitter(self, told: dict) -> tuple[regex.Pattern, bool]:
        parts = told["pretokenizers"] if told["type"] == "Sequence" else [told]
        first = parts[0]
        own = first["type"] == "Split"
        return _pattern(first["pattern"]["Regex"] if own else BYTE_LEVEL_PATTERN), not own or first["behavior"] != "Removed"

    def normal(self, text: str) -> str:
        for step in self.steps:
            if step == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif step == "Replace":
                text = _spaces().sub(" ", text)
            else:
                # Character by character: a final sigma is no special case.
                text = text.replace("Σ", "σ").lower()
        return text

    def pieces(self, text: str) -> list[tuple[bool, str]]:
        """(is a special string, text) in order; special strings are found in the raw text."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(False, text)]
        return [(i % 2 == 1, part) for i, part in enumerate(self.cut.split(text)) if part]

    def word(self, pre_token: str) -> str:
        """Symbols of a pre-token."""
        return self._ended(pre_token.encode("utf-8").decode("latin-1").translate(self.table))

    def _ended(self, text: str) -> str:
        return text[:-1] + chr(END + ord(text[-1])) if self.suffix else text

    def newer_words(self, text: str) -> list[str] | None:
        """Symbols of all pre-tokens of a text with characters that Python's Unicode tables
        don't know.  Versions of the tables differ there, so the tokenizer library splits it."""
        if text.isascii() or all(unicodedata.category(c) != "Cn" for c in set(text)):
            return None
        from tokenizers import Tokenizer

        if not hasattr(self, "library"):
            self.library = Tokenizer.from_file(self.path)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [self._ended(s) for s, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]


@lru_cache(maxsize=1)
def _spaces() -> regex.Pattern:
    return regex.compile(SPACE + "+")


def merged(vocab: Vocabulary, word: str) -> list[int]:
    """Plain merging: the pair of lowest rank first, the leftmost of equal ones."""
    ids = [vocab.ids[c] for c in word]
    if len(ids) > 48:
        return _merged_long(vocab, ids)
    rank = vocab.rank
    ranks = [rank.get(p, LIMIT) for p in zip(ids, ids[1:])]
    while ranks and (best := min(ranks)) < LIMIT:
        i = ranks.index(best)
        ids[i : i + 2] = [vocab.result[ids[i], ids[i + 1]]]
        del ranks[i]
        if i:
            ranks[i - 1] = rank.get((ids[i - 1], ids[i]), LIMIT)
        if i < len(ranks):
            ranks[i] = rank.get((ids[i], ids[i + 1]), LIMIT)
    return ids


def _merged_long(vocab: Vocabulary, ids: list[int]) -> list[int]:
    """The same with a heap over a linked list: n log n for very long pre-tokens."""
    from heapq import heapify, heappop, heappush

    n = len(ids)
    after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
    rank = vocab.rank
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
    heapify(heap)
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = vocab.result[a, b], False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (r := rank.get((ids[x], ids[y]))) is not None:
                heappush(heap, (r, x, ids[x], ids[y]))
    return [x for x, live in zip(ids, alive, strict=True) if live]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker, whose file must be readable on every machine."""
    return Vocabulary(path)
