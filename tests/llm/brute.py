"""Plain definitions that the operators' results are held against."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np

BLANK = re.compile(r"[\x20\x09-\x0D]")


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def pieces(docs, path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i, t in docs:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        out.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids))))
    return out


def counts(docs, path, limit=512):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    n = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in docs]
    return [(i, len((t or "").encode()), k, k > limit) for (i, t), k in zip(docs, n, strict=True)]


def check_packing(docs, rows, path, window=2048, end=1):
    """rows: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); doc_ids are unique."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r[0]].append(r)
        sequences[r[5]].append((r[6], r[2]))
    assert set(own) == {i for i, _ in docs}
    for i, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        at = 0
        for _, start, length, crc, total, _, _ in sorted(own[i], key=lambda r: r[1]):
            assert start == at and length > 0 and total == len(ids)
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)
    for k, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or k == max(sequences)
    assert set(sequences) == set(range(len(sequences)))


def luhn(d: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
}


def base_spans(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PII.items() for m in re.finditer(p, text or "", re.ASCII) if ok(m.group())]


def pii(docs):
    out = []
    for i, t in docs:
        spans = base_spans(t)
        n = [sum(s[0] == k for s in spans) for k in PII]
        out.append((i, *n, sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    return out


def exact(docs):
    """One row of each group stays; docs may repeat ids."""
    groups = defaultdict(list)
    for n, (i, t) in enumerate(docs):
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i is None, i or 0, n))
    out = []
    for plain, rows in groups.items():
        best = min(rows)
        out += [(docs[r[3]][0], docs[best[3]][0], len(rows), r is best, sha(plain)) for r in rows]
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _covered(units, docs, k):
    """units: {doc_id: sequence}; positions covered by a k-window that also starts in a smaller doc."""
    first = {}
    for i in sorted(units):
        s = units[i]
        for a in range(len(s) - k + 1):
            first.setdefault(s[a : a + k] if isinstance(s, bytes) else tuple(s[a : a + k]), i)
    out = {}
    for i, s in units.items():
        hit = np.zeros(len(s) + 1, int)
        for a in range(len(s) - k + 1):
            if first[s[a : a + k] if isinstance(s, bytes) else tuple(s[a : a + k])] < i:
                hit[a] += 1
                hit[a + k] -= 1 if a + k <= len(s) else 0
        out[i] = np.cumsum(hit)[: len(s)] > 0
    return out


def word_repeats(docs, k=50):
    units = {i: words(t) for i, t in docs}
    gone = _covered(units, docs, k)
    return [(i, len(units[i]), int(gone[i].sum()), sha(" ".join(w for w, g in zip(units[i], gone[i], strict=True) if not g))) for i, _ in docs]


def byte_repeats(docs, k=50):
    units = {i: (t or "").encode() for i, t in docs}
    gone = _covered(units, docs, k)
    out = []
    for i, _ in docs:
        g = gone[i]
        runs = int((np.diff(np.r_[0, g.astype(int)]) == 1).sum())
        out.append((i, len(units[i]), int(g.sum()), runs, sha(bytes(b for b, x in zip(units[i], g, strict=True) if not x))))
    return out


def shingles(text, k=5):
    w = words(re.sub(r"[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()


def components(docs, k=5):
    sets = [(i, shingles(t, k)) for i, t in docs]
    by, up = defaultdict(list), list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(n)
    for n, (_, s) in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for m in by[g]:
                if m < n:
                    both[m] += 1
        for m, c in both.items():
            if 100 * c >= 75 * (len(s) + len(sets[m][1]) - c):
                up[root(n)] = root(m)
    low = {}
    for n, (i, _) in enumerate(sets):
        low[root(n)] = min((x for x in (low.get(root(n)), i) if x is not None), default=None)
    return [(i, len(s), low[root(n)] if s else i) for n, (i, s) in enumerate(sets)]


def top_products(vectors, k=20, every=20):
    """vectors: (vec_id, list); each row is a vector of its own."""
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, x) in enumerate(ok):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for m, (i, y) in enumerate(ok) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


# -- quality: features and training, one number at a time ------------------------------------------------

M64 = (1 << 64) - 1


def mix64(x):
    x ^= x >> 31
    x = x * 0xD6E8FEB86659FD93 & M64
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & M64
    return x ^ x >> 29


def word_code(w):
    factor = 0x9E3779B97F4A7C15 | 1
    return mix64((sum(mix64(b + 1) * pow(factor, i, 1 << 64) for i, b in enumerate(w)) + len(w)) & M64)


def word_shape(w, same):
    kind = [1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b > 127 else 0 for b in w]
    upper, lower, digit, marks = kind.count(2), kind.count(1), kind.count(3), kind.count(0)
    return min(len(w), 15) | min(upper, 3) << 4 | min(lower, 1) << 8 | min(digit, 2) << 9 | min(marks, 3) << 12 | same << 16 | (w[-1] if kind[-1] == 0 else 0) << 20 | (kind[0] == 2) << 30


def quality_features(text, places=1 << 18):
    """{place: share} of a text."""
    own = [w.encode() for w in words(text)]
    codes = [word_code(w) for w in own]
    shapes = [word_shape(w, int(k > 0 and codes[k] == codes[k - 1])) for k, w in enumerate(own)]
    seeds, out = (0x51ED270B, 0x2545F491, 0x9E3779B9, 0x85EBCA6B), defaultdict(float)
    rows = ([c ^ seeds[0] for c in codes], [s ^ (seeds[1] << 33 & M64) for s in shapes])
    for k in range(len(own)):
        for r in (0, 1):
            pair = (rows[r][k] + rows[r][k - 1] * 0xC2B2AE3D27D4EB4F) & M64 if k else 1
            for h in (rows[r][k], pair ^ (seeds[2 + r] << 31 & M64)):
                out[mix64(h) & places - 1] += 8 / len(own)
    return out


def quality_scores(train, texts, epochs=4, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-3):
    """train: (features, label) in the order of training; the score of each text."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(j):
        return 0.0 if abs(z[j]) <= l1 else -(z[j] - math.copysign(l1, z[j])) / ((beta + math.sqrt(n[j])) / alpha + l2)

    def chance(x):
        return 1 / (1 + math.exp(-max(-30, min(30, sum(weight(j) * v for j, v in x.items())))))

    for k in range(epochs):
        for i in np.random.default_rng(k).permutation(len(train)):
            x, label = {**train[i][0], -1: 1.0}, train[i][1]
            miss, before = chance(x) - label, {j: weight(j) for j in x}
            for j, v in x.items():
                g = miss * v
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / alpha * before[j]
                n[j] += g * g
    return [chance({**quality_features(t), -1: 1.0}) for t in texts]


# -- weak supervision: all patterns at once ---------------------------------------------------------------


def span_model(counts, kinds=5, labelers=4, rounds=50, epochs=300):
    """Posterior and classifier score of each pattern (kind, votes, size, n)."""
    kind = np.eye(kinds)[[c[0] for c in counts]]
    votes, size, n = np.array([c[1] for c in counts], float), np.array([c[2] for c in counts]) / 20, np.array([c[3] for c in counts], float)
    start = np.array([[0.05] + [0.35] * (labelers - 1), [0.95] + [0.85] * (labelers - 1)])  # class, labeler
    rate = start.copy()
    prior = np.full(kinds, 0.5)
    for _ in range(rounds):
        like = [np.prod(np.where(votes > 0, rate[y], np.where(votes < 0, 1 - rate[y], 1)), axis=1) for y in (0, 1)]
        p = kind @ prior
        post = np.where(votes[:, 0] == 1, 1.0, p * like[1] / (p * like[1] + (1 - p) * like[0]))
        prior = (kind.T @ (post * n) + 5) / (kind.T @ n + 10)
        for y, share in ((0, n * (1 - post)), (1, n * post)):
            rate[y] = (share @ (votes > 0) + 20 * start[y]) / (share @ (votes != 0) + 20)
    x = np.c_[votes, kind, size]
    w = np.r_[np.log(rate[1] * (1 - rate[0]) / (rate[0] * (1 - rate[1]))) / 2, np.log(prior / (1 - prior)), 0]
    alike = n / (kind @ (kind.T @ n)) / (kind.sum(0) > 0).sum()
    for _ in range(epochs):
        w = w + x.T @ (alike * (post - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))) - 1e-4 * w
    return post, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
