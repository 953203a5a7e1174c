"""Pre-tokens of a byte-level BPE as numpy offsets, and ids of distinct pre-tokens through a worker's cache."""

from __future__ import annotations

import base64
import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa

from . import common as C

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: What the pre-tokeniser's pattern has as contractions after an apostrophe.
SHORT = "stmd"
LONG = ("re", "ve", "ll")
CACHE_WORDS = 250_000
#: Longer pre-tokens are left to the tokenizers library itself.
LONG_PIECE = 256


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point in the pre-tokeniser's pattern."""
    import regex
    from tokenizers import pre_tokenizers

    out, own = np.full(0x110000, OTHER, np.uint8), np.full(0x110000, OTHER, np.uint8)
    places = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, places))
    kinds = {"L": LETTER, "N": NUMBER}
    own[places] = [kinds.get(unicodedata.category(c)[0], OTHER) for c in every]
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = (x if x <= 0xD800 else x + 0x800 for x in m.span())
            out[a:b] = kind
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    # code points that are not in each Unicode version: as the library has them
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for i in np.flatnonzero((out != own) & (out != SPACE)).tolist():
        one = {k: len(library.pre_tokenize_str(c + chr(i) + c)) == 1 for k, c in ((LETTER, "a"), (NUMBER, "1"))}
        out[i] = next((k for k, yes in one.items() if yes), OTHER)
    return out


def cut(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all pre-tokens of texts that lie one after another in data, with the end; and the first pre-token of each text."""
    heads = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    ch = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    n = len(ch)
    kind = classes()[ch]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(heads, bounds[:-1][np.diff(bounds) > 0])] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    follow = ~first[1:n]  # i and i+1 are of one text
    space = kind[:-1] == SPACE
    turn = np.flatnonzero(space & (kind[1:] != SPACE) & follow)
    start[turn] = True
    start[turn[ch[turn] == 32] + 1] = False
    # contractions: an apostrophe that begins a pre-token, alone between other classes, before s, t, m, d, re, ve, ll
    at = np.flatnonzero((ch[:-1] == 39) & start[:-1] & follow & (kind[1:] == LETTER))
    if len(at):
        one = at[np.isin(ch[at + 1], [ord(c) for c in SHORT])]
        rest = at[(at + 2 < n)]
        rest = rest[~first[rest + 2]]
        two = rest[np.any([(ch[rest + 1] == ord(a)) & (ch[rest + 2] == ord(b)) for a, b in LONG], axis=0)]
        for found, size in ((one, 2), (two, 3)):
            start[found + 1] = False
            after = found + size
            after = after[after < n]
            start[after[(kind[after] == LETTER)]] = True
    at = np.flatnonzero(start)
    offsets = np.r_[heads[at], len(data)]
    return offsets, np.searchsorted(offsets, bounds)


class Tokens:
    """Ids of single pre-tokens of a tokenizers file with GPT-2's byte-level pre-tokeniser."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or spec["truncation"] or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("a byte-level BPE without normaliser is needed")
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("plain added tokens are needed")
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
        ranks = {bytes(back[c] for c in p): i for p, i in model["vocab"].items() if p.encode() not in self.special}
        self.core = tiktoken.Encoding("own", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.cache: dict[bytes, bytes] = {}

    def ids(self, piece: bytes) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        if len(piece) > LONG_PIECE:
            return self.library.encode(piece.decode(), add_special_tokens=False).ids
        return self.core.encode_single_piece(piece)

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each as little-endian unsigned 32-bit integers."""
        cache = self.cache
        missing = [w for w in words if w not in cache]
        fresh = {w: np.array(self.ids(w), "<u4").tobytes() for w in missing}
        out = [cache[w] if w in cache else fresh[w] for w in words]
        if len(cache) + len(fresh) > CACHE_WORDS:
            cache.clear()
        if len(fresh) <= CACHE_WORDS:
            cache.update(fresh)
        return out


@functools.cache
def worker(path: str) -> Tokens:
    return Tokens(path)


def words_of(t: Tokens, column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, bytes, np.ndarray]:
    """Pre-tokens of a column (special strings are pre-tokens of their own), the first of each text, the bytes and their bounds."""
    data, bounds = C.utf8(column)
    edges, marks = bounds, {}
    for special in t.special:
        if special in data:
            at = data.find(special)
            while at >= 0:
                row = int(np.searchsorted(bounds, at, "right")) - 1
                if at + len(special) <= bounds[row + 1]:
                    marks[at] = at + len(special)
                    at = data.find(special, at + len(special))
                else:
                    at = data.find(special, at + 1)
    if marks:
        edges = np.union1d(edges, np.array([*marks, *marks.values()], np.int64))
    if not len(data):
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(bounds), np.int64), data, bounds
    offsets, _ = cut(data, edges)
    if marks:  # a special string is one pre-token
        inside = np.zeros(len(offsets), bool)
        for a, b in marks.items():
            lo, hi = np.searchsorted(offsets, [a, b])
            inside[lo + 1 : hi] = True
        offsets = offsets[~inside]
    return C.binaries(data, offsets).dictionary_encode(), np.searchsorted(offsets, bounds), data, bounds


def encode_batch(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column, and where each text's ids start (with the end)."""
    t = worker(path)
    words, first, _, _ = words_of(t, column)
    values = t.of_words(words.dictionary.to_pylist())
    flat, cuts = C.concatenated(C.binary_array(values).take(words.indices))
    return flat.view("<u4"), cuts[first] // 4
