"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts is cut into words at each space mark after another symbol (no piece of the model
spans such a place; the table checks it). Distinct words that the worker's cache lacks are encoded
together: flat numpy arrays hold their symbols, each round finds each word's smallest pair rank by a
segmented minimum, merges the leftmost pairs of that rank in all words at once, and compacts the
arrays; a word without a mergeable pair leaves.

Defined results: a null or empty text has no pieces (begin and end ids only); a literal mark U+2581
in a text is a space, as in the library; repeated rows give repeated rows; columns besides the id
and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

MARK = "▁"
NONE = np.iinfo(np.int32).max
CACHE_WORDS = 250_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceTable:
    """Symbols, pair ranks and piece bytes of a model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("a BPE model with byte fallback, dummy prefix and identity normalisation is needed")
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece spans two words")
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bos = next(i for i, p in enumerate(model.pieces) if p.piece == "<s>")
        self.eos = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        # symbols: pieces keep their ids; characters that only occur inside pieces get ids after them
        n = len(model.pieces)
        ids = dict(normal)
        for ch in sorted({c for p in normal for c in p} - set(ids)):
            ids[ch] = n
            n += 1
        self.outside = n  # any other character
        self.of_char = np.full(0x110000, self.outside, np.int32)
        for s, i in ids.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.n_pieces, self.width = len(model.pieces), n + 1
        self.known = np.zeros(n + 1, bool)
        self.known[list(normal.values())] = True
        # the lowest rank is kept for runs of marks, which share one score in such models
        runs = {len(p): i for p, i in normal.items() if len(p) > 1 and not p.strip(MARK)}
        self.run_ids = {1: normal[MARK], **runs}
        if len({model.pieces[i].score for i in runs.values()}) > 1:
            raise ValueError("pieces of marks differ in score")
        others = sorted((p for p in normal if len(p) > 1 and p.strip(MARK)), key=lambda p: -model.pieces[normal[p]].score)
        if len({model.pieces[normal[p]].score for p in others}) != len(others) or runs and others and max(model.pieces[i].score for i in runs.values()) >= model.pieces[normal[others[-1]]].score:
            raise ValueError("pieces of equal score")
        keys, values, ranks = [], [], []
        for rank, p in enumerate(others):
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    keys.append(ids[p[:k]] * self.width + ids[p[k:]])
                    values.append(normal[p])
                    ranks.append(rank)
        self._index(np.array(keys, np.int64), np.array(values, np.int32), np.array(ranks, np.int32))
        self.raw = C.binary_array([bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(MARK, " ").encode() if p.type == kinds.NORMAL else b"" for p in model.pieces])
        self.mark = ids[MARK]

    def _index(self, keys: np.ndarray, values: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing: a pair is within self.probes slots of its hash."""
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32), np.full(1 << bits, NONE, np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] < 0]
            slot, who = np.unique(at[free], return_index=True)
            own = free[who]
            self.keys[slot], self.values[slot], self.ranks[slot] = keys[own], values[own], ranks[own]
            left = np.setdiff1d(left, own)
            at[left] = (at[left] + 1) & ((1 << bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE where there is none."""
        key = left.astype(np.int64) * self.width + right
        at = self._slot(key)
        found = self.keys[at]
        rank, value = np.where(found == key, self.ranks[at], NONE), np.where(found == key, self.values[at], -1)
        todo = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            hit = todo[found == key[todo]]
            rank[hit], value[hit] = self.ranks[at[hit]], self.values[at[hit]]
            todo = todo[(found != key[todo]) & (found >= 0)]
        return rank, value

    def run(self, n: int) -> list[int]:
        """Pieces of n marks that nothing else has taken: their pairs share one score, so the leftmost merges first."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-1] + stack[-2] in self.run_ids:
                stack[-2:] = [stack[-1] + stack[-2]]
        return [self.run_ids[s] for s in stack]


def merge_rounds(t: PieceTable, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges the symbols of all words (lengths > 0); gives the symbols left and the words' new lengths."""
    n_words = len(lengths)
    word = np.repeat(np.arange(n_words, dtype=np.int32), lengths)
    done_sym: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    rank, into = np.full(len(sym), NONE, np.int32), np.full(len(sym), -1, np.int32)

    def refresh(at: np.ndarray) -> None:
        at = at[(at >= 0) & (at < len(sym))]
        last = at == len(sym) - 1
        inside = at[~last]
        same = word[inside] == word[inside + 1]
        rank[at], into[at] = NONE, -1
        pairs = inside[same]
        rank[pairs], into[pairs] = t.look(sym[pairs], sym[pairs + 1])

    refresh(np.arange(len(sym)))
    while len(sym):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        counts = np.diff(np.r_[starts, len(sym)])
        least = np.minimum.reduceat(rank, starts)
        still = np.repeat(least < NONE, counts)
        if not still.all():
            done_sym.append(sym[~still])
            done_word.append(word[~still])
            sym, word, rank, into = sym[still], word[still], rank[still], into[still]
            if not len(sym):
                break
            keep = least < NONE
            counts, least = counts[keep], least[keep]
            starts = np.cumsum(counts) - counts
        here = np.flatnonzero(rank == np.repeat(least, counts))
        # of pairs that overlap, every second one from the left
        fresh = np.r_[True, here[1:] != here[:-1] + 1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(here)), 0))
        here = here[(np.arange(len(here)) - first) % 2 == 0]
        # a merge that makes a pair of smaller rank goes before the later ones of its word
        new = into[here]
        follows = np.r_[False, here[1:] == here[:-1] + 2]
        before = np.where(follows, np.r_[-1, new[:-1]], sym[np.maximum(here - 1, 0)])
        ok = (here > 0) & (word[np.maximum(here - 1, 0)] == word[here])
        low = np.full(len(here), NONE, np.int32)
        if ok.any():
            low[ok] = t.look(before[ok], new[ok])[0]
        after = np.minimum(here + 2, len(sym) - 1)
        ok = (here + 2 < len(sym)) & (word[after] == word[here])
        if ok.any():
            low[ok] = np.minimum(low[ok], t.look(new[ok], sym[after[ok]])[0])
        trigger = low < rank[here]
        if trigger.any():
            w = word[here]
            heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            limit = np.minimum.reduceat(np.where(trigger, here, NONE), heads)
            here = here[here <= np.repeat(limit, np.diff(np.r_[heads, len(here)]))]
            new = into[here]
        sym = sym.copy()
        sym[here] = new
        keep = np.ones(len(sym), bool)
        keep[here + 1] = False
        place = np.cumsum(keep) - 1
        sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
        touched = np.zeros(len(sym) + 1, bool)
        touched[place[here]] = touched[place[here] - 1] = True  # -1 is the spare last entry
        refresh(np.flatnonzero(touched[:-1]))
    out_sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
    out_word = np.concatenate(done_word) if done_word else np.zeros(0, np.int32)
    order = np.argsort(out_word, kind="stable")
    return out_sym[order], np.bincount(out_word, minlength=n_words)


def encode_words(t: PieceTable, words: list[bytes]) -> list[bytes]:
    """Ids of each word (its mark first) as little-endian 32-bit integers."""
    joined = b"".join(words).decode()
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words])
    heads = (np.frombuffer(b"".join(words), np.uint8) & 0xC0) != 0x80
    lengths = np.add.reduceat(heads, np.cumsum(size) - size).astype(np.int64)
    sym, lengths = merge_rounds(t, t.of_char[chars], lengths)
    # characters outside the vocabulary become byte pieces: their characters are found by order
    if (~t.known[sym]).any():
        return _with_bytes(t, words, sym, lengths)
    return _with_runs(t, sym, lengths)


def _with_runs(t: PieceTable, sym: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths)
    starts = ends - lengths
    second = np.minimum(starts + 1, max(len(sym) - 1, 0))
    runs = (lengths > 1) & (sym[starts] == t.mark) & (sym[second] == t.mark)
    raw = sym.astype("<u4").tobytes()
    out = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    for i in np.flatnonzero(runs):
        own = sym[starts[i] : ends[i]]
        other = np.flatnonzero(own != t.mark)
        n = int(other[0]) if len(other) else len(own)
        out[i] = np.array([*t.run(n), *own[n:]], "<u4").tobytes()
    return out


def _with_bytes(t: PieceTable, words: list[bytes], sym: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    out = _with_runs(t, sym, lengths)
    bad = np.unique(np.repeat(np.arange(len(words)), lengths)[~t.known[sym]])
    for i in bad.tolist():
        lost = iter([c for c in words[i].decode() if not t.known[t.of_char[ord(c)]]])
        ids: list[int] = []
        own = np.frombuffer(out[i], "<u4")
        for s in own.tolist():
            ids.extend([s] if t.known[s] else [t.bytes[b] for b in next(lost).encode()])
        out[i] = np.array(ids, "<u4").tobytes()
    return out


@functools.cache
def _worker(path: str) -> tuple[PieceTable, dict[bytes, bytes]]:
    return PieceTable(path), {}


def encode_batch(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column without begin and end, and where each text's ids start (with the end)."""
    t, cache = _worker(path)
    data, offsets = C.utf8(column)
    mark = MARK.encode()
    full = np.diff(offsets) > 0
    if not len(data):
        return np.zeros(0, "<u4"), np.zeros(len(column) + 1, np.int64)
    if mark in data:  # the library sees a literal mark as a space
        parts = [data[a:b].replace(mark, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        data, offsets = b"".join(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
    # the dummy prefix: one space before each text that is not empty
    raw = np.frombuffer(data, np.uint8)
    starts = offsets[:-1][full]
    raw = np.insert(raw, starts, 32)
    bounds = np.r_[0, np.cumsum(np.diff(offsets) + full)]
    space = raw == 32
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[bounds[:-1][full]] = True
    if t.of_char[10] == t.outside:  # nothing merges with a line feed
        head |= raw == 10
        head[1:] |= raw[:-1] == 10
    at = np.flatnonzero(head)
    found = C.binaries(raw.tobytes(), np.r_[at, len(raw)]).dictionary_encode()
    unique, index = found.dictionary.to_pylist(), found.indices.to_numpy()
    missing = [w for w in unique if w not in cache]
    if missing:
        fresh = dict(zip(missing, encode_words(t, [w.replace(b" ", mark) for w in missing]), strict=True))
        values = [cache[w] if w in cache else fresh[w] for w in unique]
        if len(cache) + len(fresh) > CACHE_WORDS:
            cache.clear()
        if len(fresh) <= CACHE_WORDS:
            cache.update(fresh)
    else:
        values = [cache[w] for w in unique]
    taken = C.binary_array(values).take(pa.array(index))
    flat, cuts = C.concatenated(taken)
    word_of = np.searchsorted(at, bounds)
    return flat.view("<u4"), cuts[word_of] // 4


def decode_batch(path: str, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Decoded texts in UTF-8; the dummy prefix goes."""
    t, _ = _worker(path)
    data, cuts = C.concatenated(t.raw.take(pa.array(ids.astype(np.int64))))
    whole = data.tobytes()
    out = []
    for a, b in zip(cuts[starts[:-1]].tolist(), cuts[starts[1:]].tolist(), strict=True):
        own = whole[a + (a < b and whole[a] == 32) : b]
        out.append(own)
    return out


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text with begin and end ids and decodes the ids again; digests of both."""

    def one():
        t, _ = _worker(model_path)
        bos, eos = np.array([t.bos], "<u4").tobytes(), np.array([t.eos], "<u4").tobytes()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, starts = encode_batch(model_path, batch.column("text"))
            raw = ids.tobytes()
            sha = [hashlib.sha256(bos + raw[4 * a : 4 * b] + eos).hexdigest() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            text = [hashlib.sha256(x).hexdigest() for x in decode_batch(model_path, ids, starts)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(starts) + 2, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return C.map_texts(C.texts(docs, id_col, text_col), one, SCHEMA)
