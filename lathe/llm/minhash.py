"""Near-duplicate documents by HyperMinHash.

One hash per shingle feeds a sketch of 256 registers: the top 8 bits choose the register, which
keeps the least remaining value as a leading-zero count and ten mantissa bits (16 bits in all).
Bands of eight registers propose candidates; a collision-corrected Jaccard estimate drops most of
the wrong ones; the rest are verified on full shingle sets.

Documents with equal sets are one class, represented by its least doc_id, so groups of copies cost
one node however large they are. Within a bucket of candidates nodes are first compared with the
bucket's least node (linear in the bucket) and components are formed. Buckets that then still hold
several components are compared block against block inside tasks: pairs are looked at in place and only
links leave a task, so a large bucket whose members are not linked never becomes rows of pairs.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import WordHashes, cut, mix64, shingle_hashes
from lathe.llm.components import components

REGISTERS = 256
MANTISSA = 10
ROWS_PER_BAND = 8
BANDS = 64
#: Below the threshold by over five standard errors of an estimate from 256 registers.
MARGIN = 0.15
#: Nodes of a bucket that one task holds against as many others.
BLOCK_NODES = 3072
#: At most so many ids are broadcast (8 bytes each); beyond, the join is shuffled.
BROADCAST_IDS = 100_000

_rng = np.random.default_rng(20_240)
#: For each empty register an order of the others in which it looks for one to borrow from.
_LOOK = np.argsort(_rng.random((REGISTERS, REGISTERS)), axis=1).astype(np.uint8)
_BAND_OF = np.concatenate([_rng.permutation(REGISTERS).reshape(-1, ROWS_PER_BAND) for _ in range(BANDS * ROWS_PER_BAND // REGISTERS)])
_ODD = _rng.integers(1, 2**63, ROWS_PER_BAND, dtype=np.uint64) | np.uint64(1)
_SALT = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)


def shingle_set(data: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; bytes.lower() changes A-Z only, split() cuts at ASCII white space."""
    return np.unique(shingle_hashes((data or b"").lower().split(), k, hashes))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of sorted distinct hashes: (leading zeros + 1) << 10 | mantissa, 0 where no shingle fell."""
    regs = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        bucket = shingles >> np.uint64(56)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        value = ((shingles[first] & np.uint64((1 << 56) - 1)) >> np.uint64(4)).astype(np.float64)  # 52 bits: exact
        part, power = np.frexp(value)
        zeros = np.where(value > 0, 52 - power, 52)
        mantissa = np.where(value > 0, (part * 2 - 1) * (1 << MANTISSA), 0)
        regs[bucket[first].astype(np.intp)] = ((zeros.astype(np.uint32) + 1) << MANTISSA | mantissa.astype(np.uint32)).astype(np.uint16)
    return regs


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A key per band. Empty registers borrow from the first full one in their own fixed order, so sparse sketches agree as often as their sets do."""
    full = np.flatnonzero(regs)
    source = np.arange(REGISTERS)
    empty = np.flatnonzero(regs == 0)
    if len(empty) and len(full):
        source[empty] = full[np.argmin(_LOOK[np.ix_(empty, full)], axis=1)]
    codes = regs[source].astype(np.uint64) | (source.astype(np.uint64) << np.uint64(16))
    return mix64((codes[_BAND_OF] * _ODD).sum(axis=1, dtype=np.uint64) ^ _SALT).view(np.int64)


@functools.lru_cache(4096)
def chance_matches(n: int, m: int) -> float:
    """Expected registers that agree by chance between disjoint sets of n and m shingles."""
    zeros = np.arange(1, 41)[:, None]
    step = np.arange(1 << MANTISSA)[None, :]
    low = 2.0**-zeros * (1 + step / (1 << MANTISSA))
    high = 2.0**-zeros * (1 + (step + 1) / (1 << MANTISSA))
    cell = lambda k: np.exp(-k * low) - np.exp(-k * high)  # noqa: E731  a register gets a Poisson number of shingles
    return float(REGISTERS * (cell(n / REGISTERS) * cell(m / REGISTERS)).sum())


def _coarse(n: int) -> int:
    """n to two leading bits more than its size: few distinct arguments for the cache."""
    shift = max(0, int(n).bit_length() - 4)
    return (int(n) >> shift) << shift


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity from registers, with chance agreements taken off."""
    either = np.count_nonzero(a | b)
    same = np.count_nonzero((a == b) & (a != 0))
    return max(0.0, same - min(same, chance_matches(_coarse(n), _coarse(m)))) / either if either else 0.0


def _sketches(batches, k: int):
    hashes = WordHashes()
    for batch in batches:
        ids, ns, keys, regs = batch.column(0), [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, k, hashes)
            ns.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            regs.append(sketch(s).tobytes())
        yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n", "set_key", "regs"])


def _bands(batches):
    for batch in batches:
        if batch.num_rows:
            keys = np.concatenate([band_keys(np.frombuffer(r, np.uint16)) for r in batch.column(2).to_pylist()])
            ids, ns = (np.repeat(batch.column(i).to_numpy(), BANDS) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(ns)], ["band", "node", "n"])


def _sets(batches, k: int):
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t, k, hashes).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])


def _likely(batches, least: float):
    for batch in batches:
        a, b, ra, rb, n, m = (batch.column(i).to_pylist() for i in range(6))
        keep = [estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), i, j) >= least for x, y, i, j in zip(ra, rb, n, m, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(batches, percent: int):
    for batch in batches:
        sets = [[np.frombuffer(s, np.uint64) for s in batch.column(i).to_pylist()] for i in (2, 3)]
        keep = [_similar(x, y, percent) for x, y in zip(*sets, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _in_blocks(batches, width: int):
    """Rows of one block at a time, as lists of columns; rows come sorted by the first three (band, p, q)."""
    held: list[list] = [[] for _ in range(width)]
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(width)]
        for i in range(batch.num_rows):
            if held[0] and (held[0][-1], held[1][-1], held[2][-1]) != (cols[0][i], cols[1][i], cols[2][i]):
                yield held
                held = [[] for _ in range(width)]
            for h, c in zip(held, cols, strict=True):
                h.append(c[i])
    if held[0]:
        yield held


def _candidates(block, percent: int, least: float):
    """Pairs (i, j) of positions in a block of an open bucket that have to be verified, one after another.

    A pair is looked at in the first band that it shares and there in one block, so nothing is done twice.
    """
    band, p, q, chunk, _, labels, sizes, regs = block
    r = np.frombuffer(b"".join(regs), np.uint16).reshape(len(chunk), REGISTERS)
    label, n = np.array(labels), np.array(sizes)
    keys: dict[int, np.ndarray] = {}
    own_side = np.array(chunk) == p[0]
    order = np.flatnonzero(own_side)
    for k, i in enumerate(order.tolist()):
        others = order[k + 1 :] if p[0] == q[0] else np.flatnonzero(~own_side)
        others = others[(label[others] != label[i]) & (np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * percent)]
        if not len(others):
            continue
        x = r[others]
        same = ((x == r[i]) & (r[i] != 0)).sum(axis=1)
        either = ((x | r[i]) != 0).sum(axis=1)
        chance = {m: chance_matches(_coarse(n[i]), _coarse(m)) for m in set(n[others].tolist())}
        sure = (same - np.array([chance[m] for m in n[others].tolist()])) >= least * either
        for j in others[sure].tolist():
            for x_ in (i, j):
                if x_ not in keys:
                    keys[x_] = band_keys(r[x_])
            if keys[i][np.flatnonzero(keys[i] == keys[j])[0]] == band[0]:
                yield i, j


_BLOCK = "band long, p int, q int, chunk int, node long, label long, n long, regs binary"
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _involved(batches, percent: int, least: float):
    """The rows of blocks that have something to verify; the pairs themselves never leave the task."""
    for block in _in_blocks(batches, 8):
        at = set()
        for pair in _candidates(block, percent, least):
            at.update(pair)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in sorted(at)], t) for c, t in zip(block, _KINDS, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])


def _linked_in_blocks(batches, percent: int, pairs):
    """Candidates within a block, verified on full sets; once two components are linked their other pairs are let be."""
    for block in _in_blocks(batches, 9):
        nodes, labels, sets = block[4], block[5], [np.frombuffer(x, np.uint64) for x in block[8]]
        root: dict[int, int] = {}

        def find(x: int, root=root) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        links = []
        for i, j in pairs(block[:8]):
            a, b = find(labels[i]), find(labels[j])
            if a != b and _similar(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
                links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])


def _every_pair(block, percent: int):
    """All pairs of a block whose sizes allow a link, each in one block."""
    _, p, q, chunk, nodes, _, sizes, _ = block
    left = [i for i, c in enumerate(chunk) if c == p[0]]
    right = left if p[0] == q[0] else [i for i, c in enumerate(chunk) if c != p[0]]
    for i in left:
        for j in right:
            if nodes[i] < nodes[j] if left is right else True:
                if min(sizes[i], sizes[j]) * 100 >= max(sizes[i], sizes[j]) * percent:
                    yield i, j


def _prefixes(batches, percent: int):
    """A key for each of the least hashes of a set: two sets at the threshold share one of them."""
    for batch in batches:
        keys, ids, ns = [], [], []
        for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(raw, np.uint64)
            own = own[: len(own) - (percent * len(own) + 99) // 100 + 1].view(np.int64)
            keys.append(own), ids.append(np.full(len(own), node)), ns.append(np.full(len(own), len(raw) // 8))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (keys, ids, ns)], ["band", "node", "n"])


def _texts(docs: DataFrame, ids: DataFrame, few: bool, k: int) -> DataFrame:
    """(node, set) of the documents whose id is in ids (doc_id, distinct)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return cut(texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(lambda x: _sets(x, k), "node long, set binary"))


def _verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, least: float) -> DataFrame:
    """The candidate pairs (a, b) that pass the estimate and then the test on full sets."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n").alias(f"n_{x}"))
    likely = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "regs_a", "regs_b", "n_a", "n_b")
    likely = cut(likely.mapInArrow(lambda x: _likely(x, least), "a long, b long"))
    sets = _texts(docs, likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), 2 * likely.count() <= BROADCAST_IDS, k)
    held = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}"))
    full = likely.join(held("b"), "b").join(held("a"), "a").select("a", "b", "set_a", "set_b")
    return full.mapInArrow(lambda x: _linked(x, percent), "a long, b long")


def _shared(keys: DataFrame) -> DataFrame:
    """Rows (band, node, n) of buckets with more than one node, with the bucket's size and least node.

    Sizes are counted with map-side aggregation and joined, so that a hot bucket is split by the skew join.
    """
    sizes = keys.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("centre")).filter("size > 1")
    return keys.join(sizes, "band")


def _dealt(open_: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of open buckets (band, node, n, label, size) dealt out as pairs of blocks (p, q)."""
    blocks = F.ceil(F.col("size") / BLOCK_NODES).cast("int")
    rows = open_.withColumn("chunk", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.join(reps.select("node", "regs"), "node")
    return rows.select("band", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"), "chunk", "node", "label", "n", "regs")


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")


def _verify_open(open_: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, exact: bool) -> DataFrame:
    """Links between the components of open buckets (band, node, n, label, size)."""
    least = percent / 100 - MARGIN
    rows = _dealt(open_, reps)
    if not exact:
        rows = _by_block(rows).mapInArrow(lambda x: _involved(x, percent, least), _BLOCK)
    some = cut(rows)
    sets = _texts(docs, some.select(F.col("node").alias("doc_id")).distinct(), some.count() <= BROADCAST_IDS, k).dropDuplicates(["node"])
    full = _by_block(some.join(sets, "node").select("band", "p", "q", "chunk", "node", "label", "n", "regs", "set"))
    pairs = (lambda block: _every_pair(block, percent)) if exact else (lambda block: _candidates(block, percent, least))
    return full.mapInArrow(lambda x: _linked_in_blocks(x, percent, pairs), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are not read).

    Two documents are linked if 100 * intersection >= percent * union of their sets of word shingles;
    component_id is the least doc_id reachable and kept says that it is the row's own. Texts that are
    null or without words have no shingles, are linked with nothing and kept. Rows with a null
    doc_id take no part: component_id null, kept true. Repeated rows of a doc_id share a component.
    An empty table gives an empty result. Whole texts of any length are read.

    exact: buckets are the least hashes of each set (any two linked sets share one) in place of bands,
    and nothing is left to the estimate, so that no link is missed; common shingles make it slower.
    """
    k = shingle_words
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    every = cut(ids.mapInArrow(lambda x: _sketches(x, k), "doc_id long, n long, set_key binary, regs binary"))
    least = every.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "regs")).alias("r"))
    reps = cut(least.select("set_key", F.col("r.doc_id").alias("node"), F.col("r.n").alias("n"), F.col("r.regs").alias("regs")))
    if exact:
        keys = _texts(docs, reps.select(F.col("node").alias("doc_id")), False, k).dropDuplicates(["node"]).mapInArrow(lambda x: _prefixes(x, percent), "band long, node long, n long")
    else:
        keys = reps.select("node", "n", "regs").mapInArrow(_bands, "band long, node long, n long")
    bands = cut(_shared(keys))
    first = bands.filter(F.col("node") != F.col("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    edges = cut(_verify(first, reps, docs, k, percent, -1.0 if exact else percent / 100 - MARGIN))
    labels = components(edges)
    named = bands.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # A bucket's centre has been verified with all its members, so it is left out of what follows.
    rest = named.filter(F.col("node") != F.col("centre"))
    wide = rest.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
    open_ = cut(rest.join(wide, "band").select("band", "node", "n", "label", "size"))
    if not open_.isEmpty():
        found = cut(_verify_open(open_, reps, docs, k, percent, exact))
        if not found.isEmpty():
            labels = components(edges.union(found))

    rows = every.select("doc_id", "n", "set_key").join(reps.select("set_key", "node"), "set_key", "left").join(labels, "node", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("label", "node"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, that stay if of each group of linked documents the one of least doc_id does.

    Rows without words or without doc_id stay. Of rows that repeat a doc_id one stays: the first in
    order of text. Null, empty and long texts and empty tables are as in near_duplicates; columns may have any name.
    """
    verdicts = cut(near_duplicates(docs, shingle_words, percent))
    gone = verdicts.filter("NOT kept").select("doc_id").distinct()
    again = verdicts.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    gone, again = cut(gone), cut(again)
    chosen = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    rest = docs.join(chosen, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return rest
    few = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    # The least row by text: pre-aggregated, so that a doc_id with a third of all rows is no single task.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = rest.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("text", *others), F.struct("text", F.to_json(F.struct("text", *others)))).alias("r"))
    one = least.select(*(F.col("doc_id") if c == "doc_id" else F.col("r")[c].alias(c) for c in docs.columns))
    return rest.join(few, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
