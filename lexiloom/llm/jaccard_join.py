"""N-gram Jaccard join by vertical partitioning.

1. Rows of equal text are one node: only ids and hashes travel for that.
2. Chunks of documents send the distinct n-gram hashes of their nodes to buckets and learn how many nodes hold
   each. This count (exact up to 127, then within a tenth, without a cap), then the hash, is the global n-gram
   order, rare first. A node of which less than the threshold's share of n-grams occurs elsewhere can link to
   nothing; the others' sets are written.
3. Linking sets share an n-gram within their prefixes in the global order. Nodes of a prefix group are
   paired with the group's most shared member first; groups of a few nodes give all their pairs.
4. The hash space of the n-grams is cut into fragments, by the bytes of the sets that are written and not by those of
   the input. Each fragment counts the overlap of each candidate pair in its part only; partial counts are summed
   per pair, and the sum decides the link exactly.
5. Components follow by spreading the smallest node. Then members of a prefix group that are still in different
   components meet: as long as that is much work, each meets a further member of the first component; then
   whatever is left is paired in blocks of a bounded size by n-gram and size of the set (sizes of linking sets
   differ by the threshold at most), where only pairs come out that what follows the shared n-gram allows.
   So every pair of a group is counted, connected or impossible, and components are those of all links.

A group of near copies, whatever its size, thus costs one pair for each node and not all its pairs.
Sets are sets of 64-bit hashes of the n-grams. Messages between chunks, buckets and fragments are at most as
many as the n-grams (or pairs) in them, however fine the grid; below that they are chunks times buckets.

Defined results: A-Z are lower-cased; fewer words than n are one n-gram; a null, empty or blank text has no
n-grams and links to nothing; each row is a document of its own, also if its id is repeated or null; a component is
named by its smallest id that is not null (null if there is none); an empty table gives no rows; other columns of the input are
ignored, whatever their names (one_each() breaks ties between rows of one id by a hash of them).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .repeats import Units, cut_units, grams_of, grid, mix

FEW = 8  # groups of so many nodes give all their pairs at once
PIVOTS, EASY = 4, 1 << 28  # further members that a large group meets at most, while more comparisons than this are left
MEETING = 4096  # rows of a block of the last meetings
FRAGMENTS, FRAGMENT_BYTES = 32, 8 << 20  # fragments at least, and bytes of sets in one: a pair is counted in each that holds a part of it
LOW32 = np.uint64(0xFFFFFFFF)
UNITS = Units(words=True, k=1, m=1)
SETS = "chunk int, node long, n_shingles long, grams binary"


def coded(count: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact up to 127, then by their logarithm."""
    return np.where(count < 128, count, np.minimum(255, 128 + np.rint(6 * np.log2(np.maximum(count, 128) / 128)))).astype(np.uint8)


def decoded(code: np.ndarray) -> np.ndarray:
    return np.where(code < 128, code, np.rint(128 * 2.0 ** ((code.astype(np.int64) - 128) / 6))).astype(np.int64)


def lower_ascii(data: bytes) -> bytes:
    raw = np.frombuffer(data, np.uint8)
    return (raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))).tobytes()


def document_sets(data: bytes, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct n-gram, by document, then hash."""
    cut = cut_units(UNITS, lower_ascii(data), bounds)
    sizes = np.diff(cut.bounds)
    if not len(cut.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = np.maximum(sizes - n + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), full)
    gram = grams_of(cut.codes, n)[C.ragged(cut.bounds[:-1], full)] if len(cut.codes) >= n else np.zeros(0, np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):  # the whole sequence, told from others by its number of words
        at = C.ragged(cut.bounds[:-1][short], sizes[short])
        place = C.ragged(np.zeros(len(short), np.int64), sizes[short]).astype(np.uint64)
        begins = np.cumsum(sizes[short]) - sizes[short]
        own = mix(np.add.reduceat(mix(cut.codes[at] + place), begins) + sizes[short].astype(np.uint64))
        doc, gram = np.r_[doc, short], np.r_[gram, own]
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[new], gram[new]


def spot(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket, then 32 bits within it: enough to tell n-grams of one bucket apart nearly always, for a filter."""
    return ((((gram >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32)) | (gram & LOW32)


class Chunk(C.Chunk):
    """The nodes of a chunk: of its documents those that stand for their text."""

    def __init__(self, packed: pa.Table, side: pa.Table) -> None:
        super().__init__(packed)
        stands = side.filter(pc.equal(side.column("kind"), 0)).column("data").to_pylist()
        ids, hashes, nodes = np.concatenate([np.zeros((3, 0), np.int64), *(np.frombuffer(x, np.int64).reshape(3, -1) for x in stands)], axis=1)
        of = dict(zip(zip(ids.tolist(), hashes.tolist(), strict=True), nodes.tolist(), strict=True))
        own = np.array([of.pop(k, -1) for k in zip(self.ids.tolist(), self.hashes.tolist(), strict=True)], np.int64)
        rows = np.flatnonzero(own >= 0)
        size = np.diff(self.bounds)[rows]
        self.data = np.frombuffer(self.data, np.uint8)[C.ragged(self.bounds[:-1][rows], size)].tobytes()
        self.ids, self.hashes, self.nodes, self.bounds = self.ids[rows], self.hashes[rows], own[rows], np.r_[0, np.cumsum(size)]

    def sets(self, n: int):
        for at, data, bounds in self.slices(1 << 20):
            doc, gram = document_sets(data, bounds, n)
            yield doc + at, gram


SIDE = "chunk int, kind int, bucket int, data binary, counts binary"


def _ask(n: int, buckets: int):
    def run(key: tuple, docs: pa.Table, side: pa.Table) -> pa.Table:
        out = {"chunk": [], "kind": [], "bucket": [], "data": [], "counts": []}
        if docs.num_rows:
            C.release()
            spots = np.concatenate([np.zeros(0, np.uint64), *(spot(g, buckets) for _, g in Chunk(docs, side).sets(n))])
            spots, count = np.unique(spots, return_counts=True)
            b = (spots >> np.uint64(32)).astype(np.int64)
            head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
            for x, y in zip(head, np.r_[head[1:], len(b)] if len(b) else [], strict=True):
                x, y = int(x), int(y)
                out["bucket"].append(int(b[x]))
                out["data"].append((spots[x:y] & LOW32).astype(np.uint32).tobytes())
                out["counts"].append(coded(count[x:y]).tobytes())
        m = len(out["bucket"])
        return pa.table({"chunk": pa.array([key[0].as_py()] * m, pa.int32()), "kind": pa.array([1] * m, pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()), "data": pa.array(out["data"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    return run


def _count(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint32) for x in table.column("data").to_pylist()]
    own = decoded(np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()]))
    gram = np.concatenate(parts)
    order = np.argsort(gram, kind="stable")
    ordered = gram[order]
    head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    total = np.add.reduceat(own[order], head)
    back = np.empty(len(gram), np.uint8)
    back[order] = np.repeat(coded(total), np.diff(np.r_[head, len(gram)]))
    cuts = np.cumsum([0, *map(len, parts)])
    return pa.table({"chunk": table.column("chunk"), "kind": table.column("kind"), "bucket": table.column("bucket"), "data": pa.array([b""] * table.num_rows, pa.binary()), "counts": pa.array([back[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _keep(n: int, buckets: int, percent: int):
    """n_shingles of every node; the set of each of which enough n-grams occur elsewhere, in the global order."""

    def run(key: tuple, docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"chunk": pa.array([], pa.int32()), "node": pa.array([], pa.int64()), "n_shingles": pa.array([], pa.int64()), "grams": pa.array([], pa.binary())})
        C.release()
        chunk = Chunk(docs, side)
        rows = len(chunk.ids)
        sizes, sets = np.zeros(rows, np.int64), [None] * rows
        found = list(chunk.sets(n))
        spots = np.unique(np.concatenate([np.zeros(0, np.uint64), *(spot(g, buckets) for _, g in found)]))
        side = side.filter(pc.equal(side.column("kind"), 1))
        order = np.argsort(side.column("bucket").to_numpy())
        replies = side.column("counts").to_pylist()
        total = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(replies[i], np.uint8) for i in order.tolist())])
        for doc, gram in found:
            if not len(doc):
                continue
            of = total[np.searchsorted(spots, spot(gram, buckets))]
            head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            size = np.diff(np.r_[head, len(doc)])
            sizes[doc[head]] = size
            shared = np.add.reduceat((of > 1).astype(np.int64), head)
            for i in np.flatnonzero(100 * shared >= percent * size).tolist():
                at = slice(int(head[i]), int(head[i] + size[i]))
                g, c = gram[at][of[at] > 1], of[at][of[at] > 1]
                sets[doc[head[i]]] = g[np.lexsort((g, c))].tobytes()
        return pa.table({"chunk": pa.array([key[0].as_py()] * rows, pa.int32()), "node": pa.array(chunk.nodes), "n_shingles": pa.array(sizes, pa.int64()), "grams": pa.array(sets, pa.binary())})

    return run


def _prefixes(percent: int):
    """gram, node, n (size of its set) and rest: how many of its shared n-grams are not before this one."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, n, g in zip(batch.column("node").to_pylist(), batch.column("n_shingles").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                g = np.frombuffer(g, np.int64)
                own = g[: len(g) - -(-percent * n // 100) + 1]
                rows.append((own, np.full(len(own), i), np.full(len(own), n), len(g) - np.arange(len(own))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*rows, strict=True)], ["gram", "node", "n", "rest"])

    return run


def _segments(fragments: int):
    """The sets of a chunk, cut by fragment."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        parts = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        gram = np.concatenate(parts)
        node = np.repeat(ids, [len(p) for p in parts])
        f = (((gram >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((gram, node, f))
        f, node, gram = f[order], node[order], gram[order]
        head = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        ends = np.r_[head[1:], len(f)]
        return pa.table({"fragment": pa.array(f[head], pa.int32()), "nodes": pa.array([node[a:b].tobytes() for a, b in zip(head, ends, strict=True)], pa.binary()), "grams": pa.array([gram[a:b].tobytes() for a, b in zip(head, ends, strict=True)], pa.binary())})

    return run


def _ask_fragments(fragments: int):
    """Pairs of a chunk's documents go to each fragment that holds a part of the first one's set."""

    def run(key: tuple, sets: pa.Table, pairs: pa.Table) -> pa.Table:
        out = {"fragment": [], "x": [], "y": []}
        if sets.num_rows and pairs.num_rows:
            ids = sets.column("node").to_numpy()
            order = np.argsort(ids)
            parts = [np.frombuffer(x, np.uint64) for x in sets.column("grams").to_pylist()]
            parts = [np.unique((((parts[i] >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)) for i in order.tolist()]
            sizes = np.array([len(p) for p in parts])
            flat, begins = np.concatenate(parts), np.cumsum(sizes) - sizes
            x, y = pairs.column("x").to_numpy(), pairs.column("y").to_numpy()
            at = np.searchsorted(ids[order], x)
            f = flat[C.ragged(begins[at], sizes[at])]
            row = np.repeat(np.arange(len(x)), sizes[at])
            rank = np.argsort(f, kind="stable")
            f, row = f[rank], row[rank]
            head = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            for a, b in zip(head.tolist(), np.r_[head[1:], len(f)].tolist(), strict=True):
                out["fragment"].append(int(f[a]))
                out["x"].append(x[row[a:b]].tobytes())
                out["y"].append(y[row[a:b]].tobytes())
        return pa.table({"fragment": pa.array(out["fragment"], pa.int32()), "x": pa.array(out["x"], pa.binary()), "y": pa.array(out["y"], pa.binary())})

    return run


def _overlaps(key: tuple, segments: pa.Table, asked: pa.Table) -> pa.Table:
    """Partial overlap of each pair within a fragment; only those above 0."""
    cat = lambda t, c, k: np.concatenate([np.zeros(0, k), *(np.frombuffer(v, k) for v in t.column(c).to_pylist())])
    x, y = cat(asked, "x", np.int64), cat(asked, "y", np.int64)
    node, gram = cat(segments, "nodes", np.int64), cat(segments, "grams", np.uint64)
    if not len(x) or not len(node):
        return pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "both": pa.array([], pa.int64())})
    nodes, node = np.unique(node, return_inverse=True)
    _, code = np.unique(gram, return_inverse=True)
    key_ = np.sort(node.astype(np.int64) * (int(code.max()) + 1) + code)
    order = np.argsort(node, kind="stable")
    code = code[order]
    begins = np.searchsorted(node[order], np.arange(len(nodes) + 1))
    xi = np.searchsorted(nodes, x)
    yi = np.minimum(np.searchsorted(nodes, y), len(nodes) - 1)
    held = nodes[yi] == y
    x, y, xi, yi = x[held], y[held], xi[held], yi[held]
    both = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 50_000):
        i, j = xi[a : a + 50_000], yi[a : a + 50_000]
        sizes = begins[i + 1] - begins[i]
        want = np.repeat(j, sizes).astype(np.int64) * (int(code.max()) + 1) + code[C.ragged(begins[i], sizes)]
        at = np.minimum(np.searchsorted(key_, want), len(key_) - 1)
        both[a : a + 50_000] = np.bincount(np.repeat(np.arange(len(i)), sizes), key_[at] == want, len(i)).astype(np.int64)
    some = both > 0
    return pa.table({"x": pa.array(x[some]), "y": pa.array(y[some]), "both": pa.array(both[some])})


def _meetings(percent: int):
    """x, y, nx, ny of the pairs of each run (rows of one n-gram, band and pair of blocks) that are apart and can link.

    Rows come sorted by run; a run has two blocks of about MEETING rows at most.
    """
    keys = ("gram", "band", "i", "j")

    def pairs(t: dict[str, np.ndarray]):
        change = np.zeros(len(t["gram"]), bool)
        change[0] = True
        for k in keys:
            change[1:] |= t[k][1:] != t[k][:-1]
        head = np.flatnonzero(change)
        size = np.diff(np.r_[head, len(change)])
        after = np.repeat(head + size, size) - 1 - np.arange(len(change))  # partners that come later in the run
        done = np.r_[0, np.cumsum(after)]
        at = 0
        while at < len(after):
            stop = max(at + 1, int(np.searchsorted(done, done[at] + (1 << 21), "right")) - 1)
            p = np.repeat(np.arange(at, stop), after[at:stop])
            q = C.ragged(np.arange(at, stop) + 1, after[at:stop])
            ok = (t["label"][p] != t["label"][q]) & ~(t["guest"][p] & t["guest"][q]) & ((t["i"][p] == t["j"][p]) | (t["block"][p] != t["block"][q]))
            p, q = p[ok], q[ok]
            ok = (100 + percent) * np.minimum(t["rest"][p], t["rest"][q]) >= percent * (t["n"][p] + t["n"][q])
            p, q = p[ok], q[ok]
            up = t["node"][p] > t["node"][q]
            x, y = np.where(up, p, q), np.where(up, q, p)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (t["node"][x], t["node"][y], t["n"][x], t["n"][y])], ["x", "y", "nx", "ny"])
            at = stop

    def run(batches):
        held, rows = [], 0
        columns = (*keys, "node", "n", "rest", "label", "block", "guest")

        def whole(last: bool):
            table = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in columns}
            end = len(table["gram"])
            if not last:  # the last run may go on in the next batch
                same = np.ones(end, bool)
                for k in keys:
                    same &= table[k] == table[k][-1]
                end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            return {c: v[:end] for c, v in table.items()}, pa.RecordBatch.from_arrays([pa.array(v[end:]) for v in table.values()], list(columns))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows > 100_000:
                ready, left = whole(False)
                held, rows = [left], left.num_rows if len(ready["gram"]) else 0
                if len(ready["gram"]):
                    yield from pairs(ready)
        if held:
            ready, _ = whole(True)
            if len(ready["gram"]):
                yield from pairs(ready)

    return run


def met(split: DataFrame, percent: int) -> DataFrame:
    """x, y, nx, ny of all pairs of split (gram, node, n, rest, label) that share an n-gram, are apart and can link."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    # sets that link differ in size by the threshold at most: of a pair the smaller one is in the band of the larger or the next lower
    own = split.select("gram", "node", "n", "rest", "label", F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest")))).alias("b")).select("*", "b.*").drop("b")
    sizes = own.groupBy("gram", "band").agg(F.ceil(F.count("*") / MEETING).cast("int").alias("blocks"), F.count(F.when(~F.col("guest"), 1)).alias("hosts"), F.count("*").alias("all")).where("hosts > 0 and all > 1").select(F.col("gram").alias("g"), F.col("band").alias("at"), "blocks")
    own = own.join(sizes, (F.col("gram") == F.col("g")) & (F.col("band") == F.col("at"))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("gram", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "n", "rest", "label", "block", "guest")
    return own.repartition("gram", "band", "i", "j").sortWithinPartitions("gram", "band", "i", "j").mapInArrow(_meetings(percent), "x long, y long, nx long, ny long")


def components(tables: C.Tables, edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """node, label: the smallest node that links reach. edges: x, y; nodes: node, label so far (a node of its component)."""
    both = tables.written(edges.select("x", "y").union(edges.select(F.col("y"), F.col("x"))), f"{name}-edges")
    labels, turn = nodes, 0
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("label").alias("near")), "y").groupBy(F.col("x").alias("node")).agg(F.min("near").alias("near"))
        moved = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        # a component's label moves as a whole: the smallest that any of its nodes has found
        root = moved.groupBy("label").agg(F.min("low").alias("low"))
        jump = root.join(root.select(F.col("label").alias("low"), F.col("low").alias("lower")), "low", "left").select("label", F.least("low", F.coalesce("lower", "low")).alias("to"))
        step = tables.written(labels.join(jump, "label").select("node", F.col("to").alias("label"), (F.col("to") < F.col("label")).alias("moved")), f"{name}-{turn}")
        labels = step.select("node", "label")
        if turn:
            tables.drop(f"{name}-{turn - 1}")
        turn += 1
        if step.where("moved").limit(1).count() == 0:
            tables.drop(f"{name}-edges")
            return labels


def linked(docs: DataFrame, percent: int = 75, n: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), tables: C.Tables | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; with carry, those columns of docs and `label`, the component's number."""
    tables = tables or C.Tables(docs.sparkSession, "jaccard")
    docs = C.texts(docs, id_col, text_col, *(F.col(c).alias(f"c_{c}") for c in carry)).withColumn("text_hash", F.xxhash64("text"))
    chunks, buckets = grid(docs)
    chunk_of = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).cast("int")
    # equal texts: by two hashes and the length
    keys = ("text_sha", "text_hash", "chars")
    rows = tables.written(docs.select("doc_id", *(f"c_{c}" for c in carry), F.unhex(F.sha2("text", 256)).alias("text_sha"), "text_hash", F.length("text").alias("chars")), "rows")
    groups = rows.groupBy(*keys).agg(F.min("doc_id").alias("stands"))
    groups = tables.written(groups.withColumn("node", F.monotonically_increasing_id()), "groups")

    def packed(t: pa.Table) -> pa.Table:
        data = np.stack([t.column("stands").to_numpy(), t.column("text_hash").to_numpy(), t.column("node").to_numpy()])
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "kind": pa.array([0], pa.int32()), "bucket": pa.array([-1], pa.int32()), "data": pa.array([data.tobytes()], pa.binary()), "counts": pa.array([b""], pa.binary())})

    stands = groups.select(chunk_of("stands").alias("chunk"), F.coalesce("stands", F.lit(int(C.NO_ID))).alias("stands"), "text_hash", "node").groupBy("chunk").applyInArrow(packed, SIDE)
    stands = tables.written(stands, "stands")
    dealt = C.dealt(docs.select("doc_id", "text"), chunks)
    asked = dealt.groupBy("chunk").cogroup(stands.groupBy("chunk")).applyInArrow(_ask(n, buckets), SIDE)
    counted = asked.groupBy("bucket").applyInArrow(_count, SIDE)
    sets = dealt.groupBy("chunk").cogroup(stands.unionByName(counted).groupBy("chunk")).applyInArrow(_keep(n, buckets, percent), SETS)
    sets = tables.written(sets, "sets")
    tables.drop("stands")
    held = sets.where("grams is not null").select("chunk", "node", "n_shingles", "grams")
    prefix = tables.written(held.mapInArrow(_prefixes(percent), "gram long, node long, n long, rest long"), "prefixes")
    # only groups of two or more
    many = prefix.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1")
    prefix = tables.written(prefix.join(many, "gram"), "shared")
    tables.drop("prefixes")
    fragments = max(FRAGMENTS, (held.agg(F.sum(F.octet_length("grams"))).first()[0] or 0) // FRAGMENT_BYTES)
    segments = tables.written(held.groupBy("chunk").applyInArrow(_segments(fragments), "fragment int, nodes binary, grams binary"), "segments")
    labels = tables.written(held.select("node", F.col("node").alias("label")), "nodes")
    # at the first n-gram that two sets share, what follows bounds their overlap; elsewhere the pair is met already
    fits = (100 + percent) * F.least("rx", "ry") >= percent * (F.col("nx") + F.col("ny"))
    cols = ("x", "y", "nx", "ny")

    def join(pairs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        """The labels with the links of these pairs."""
        pairs = tables.written(pairs.select(*cols).distinct(), f"{name}-pairs")
        by_chunk = pairs.join(held.select(F.col("node").alias("x"), F.col("chunk").alias("of_x")), "x").select(F.col("of_x").alias("chunk"), "x", "y")
        asked = held.groupBy("chunk").cogroup(by_chunk.groupBy("chunk")).applyInArrow(_ask_fragments(fragments), "fragment int, x binary, y binary")
        parts = segments.groupBy("fragment").cogroup(asked.groupBy("fragment")).applyInArrow(_overlaps, "x long, y long, both long")
        total = parts.groupBy("x", "y").agg(F.sum("both").alias("both"))
        links = total.join(pairs, ["x", "y"]).where(100 * F.col("both") >= percent * (F.col("nx") + F.col("ny") - F.col("both"))).select("x", "y")
        labels = components(tables, links, labels, name)
        tables.drop(f"{name}-pairs")
        return labels

    # a large group's members meet the one of which the largest share occurs elsewhere
    large = prefix.where(F.col("members") > FEW)
    member = large.select("gram", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("rest").alias("rx"))
    central = F.struct(F.col("rest") / F.col("n"), -F.col("node"))
    pivots = large.groupBy("gram").agg(F.max_by(F.struct("node", "n", "rest"), central).alias("p")).select("gram", F.col("p.node").alias("y"), F.col("p.n").alias("ny"), F.col("p.rest").alias("ry"))
    first = member.join(pivots, "gram").where((F.col("x") != F.col("y")) & fits)
    few = prefix.where(F.col("members") <= FEW).groupBy("gram").agg(F.collect_list(F.struct("node", "n", "rest")).alias("g"))
    few = few.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where("a.node > b.node")
    few = few.select(F.col("a.node").alias("x"), F.col("a.n").alias("nx"), F.col("a.rest").alias("rx"), F.col("b.node").alias("y"), F.col("b.n").alias("ny"), F.col("b.rest").alias("ry")).where(fits)
    labels = join(first.select(*cols).union(few.select(*cols)), labels, "first")

    # what is left: pairs of a large group whose nodes are still apart
    for turn in range(PIVOTS + 1):
        now = large.join(labels, "node")
        apart = now.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("left")).where("lo < hi").select("gram", "lo", "left")
        apart = tables.written(apart, f"apart{turn}")
        work = apart.agg(F.sum(F.col("left").cast("double") * F.col("left"))).first()[0]
        if not work:
            break
        now = now.join(apart, "gram")
        if turn < PIVOTS and work > EASY:  # all other components' members meet one of the first component, chosen anew each time
            one = now.where("label = lo").groupBy("gram").agg(F.min_by(F.struct("node", "n", "rest"), F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("p"))
            one = one.select("gram", F.col("p.node").alias("y"), F.col("p.n").alias("ny"), F.col("p.rest").alias("ry"))
            pairs = now.where("label > lo").select("gram", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("rest").alias("rx")).join(one, "gram").where(fits)
            labels = join(pairs, labels, f"turn{turn}")
        else:
            labels = join(met(now, percent), labels, f"turn{turn}")
            break

    tables.drop("segments", "shared")
    named = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(sets.select("node", "n_shingles"), "node")
    named = tables.written(named, "named")
    lowest = named.groupBy("label").agg(F.min("stands").alias("component_id"))
    named = named.join(lowest, "label").select(*keys, "label", "n_shingles", "component_id")
    out = rows.join(named, list(keys))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), *(["label", *(F.col(f"c_{c}").alias(c) for c in carry)] if carry else []))


def one_each(docs: DataFrame, percent: int = 75, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, of each component: that of smallest id (null last), then of smallest hash of all columns.

    Rows without n-grams all stay.
    """
    tables = C.Tables(docs.sparkSession, "jaccard-rows")
    docs = C.steady(docs, tables)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), C.mark(docs).alias("tie"))
    inner = C.Tables(docs.sparkSession, "jaccard")
    found = inner.only(linked(own, percent, n, carry=("tie",), tables=inner)).where("n_shingles > 0")
    rows = found.groupBy("label", "doc_id", "tie").agg(F.count("*").alias("copies"))
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("best"), F.sum("copies").alias("all")).where("all > 1")
    gone = rows.join(best, "label").select(F.col("tie").alias("mark"), (F.col("tie") == F.col("best.tie")).alias("one"), "copies").where("not one or copies > 1")
    gone = tables.written(gone.select("mark", "one"), "gone")
    inner.drop("result")
    return C.rest(docs, gone)
