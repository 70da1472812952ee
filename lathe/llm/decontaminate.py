"""Benchmark decontamination: SimHash over windows of an item's size.

Texts are words (letters and digits, lower-cased) and their runs of five words. Every item has a 128-bit
SimHash of its shingles. Windows of a document that could reach the similarity have one too;
a multi-index over eight 16-bit blocks finds every item within the radius: two fingerprints that
differ in at most 31 bits differ in at most 3 bits of some block, and all such values of each
block are looked up. A similar window can be farther off than the radius (its foreign shingles may
be heavy or repeated), so items are also looked up by their rarest shingles: a window without any of
them misses more weight than the threshold allows. No item at the threshold is missed, whatever its
distance. Candidates are confirmed by the exact weighted similarity of shingles, whose weights are
counted over the whole benchmark: the result does not depend on how items are dealt out to passes.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import WordHashes, cut, mix64, shingle_hashes

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RADIUS = 31
BLOCKS = 8
#: Items are held against documents in blocks of so many, so what is sent is bounded. With more than one
#: block a first pass over all documents keeps those that hold a rare shingle of any item, by a bitmap.
ITEMS_PER_PASS = 20_000
BITMAP_BITS = 27
#: What rounding may take from a similarity that is exactly the threshold.
ROUNDING = 1e-9
_WORDS = re.compile(r"[^\W_]+")
#: All 16-bit values within Hamming distance 3 of 0: what a block may differ by.
_FLIPS = np.array([sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in itertools.combinations(range(16), k)], np.uint16)


def words_of(text: str | None) -> list[bytes]:
    return " ".join(_WORDS.findall((text or "").lower())).encode().split()


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 in each of 128 dimensions for every shingle."""
    two = np.stack((mix64(hashes ^ np.uint64(0xA5A5A5A5)), mix64(hashes ^ np.uint64(0x5C5C5C5C5C5C))), axis=1)
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """(n, 128) sums -> (n, 8) blocks of 16 bits."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def rarest(bag: Counter, df: dict[int, int], weight: dict[int, float], threshold: float) -> list[int]:
    """An item's rarest shingles, heavier together than what may be missing of it: a window at the threshold holds one."""
    out, held, total = [], 0.0, sum(c * weight[h] for h, c in bag.items())
    for h, c in sorted(bag.items(), key=lambda x: (df[x[0]], x[0])):
        out.append(h)
        held += c * weight[h]
        if held > (1 - threshold + 1e-6) * total:
            break
    return out


class BenchmarkIndex:
    """Items' shingle weights, fingerprints, and the multi-index over their blocks.

    counts: of the whole benchmark, how many items hold each shingle of these items; n_items: how many
    items with words it has. Without them the items given are the whole benchmark.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, k: int = SHINGLE_WORDS, counts: dict[int, int] | None = None, n_items: int | None = None):
        hashes = WordHashes()
        self.k, self.threshold = k, threshold
        own = [(i, w, shingle_hashes(w, k, hashes)) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _, _ in own]
        self.lengths = [len(s) for _, _, s in own]
        self.bags = [Counter(s.tolist()) for _, _, s in own]
        df = Counter(h for bag in self.bags for h in bag) if counts is None else {h: counts[h] for bag in self.bags for h in bag}
        n_items = len(own) if n_items is None else n_items
        # A shingle of many items says little.
        self.weight = {h: float(np.log(1 + n_items / c)) for h, c in df.items()}
        self.totals = [sum(c * self.weight[h] for h, c in bag.items()) for bag in self.bags]
        #: sorted shingles, and for each the window sizes of items that hold it
        self.known = np.array(sorted(df), np.uint64)
        sizes: defaultdict[int, set[int]] = defaultdict(set)
        for bag, n in zip(self.bags, self.lengths, strict=True):
            for h in bag:
                sizes[h].add(n)
        self.sizes = {h: sorted(s) for h, s in sizes.items()}
        self.least: dict[int, float] = {}
        for n, total in zip(self.lengths, self.totals, strict=True):
            self.least[n] = min(self.least.get(n, total), total)
        #: for each window size the rarest shingles of its items, heavier together than what may be missing
        self.rare: defaultdict[int, defaultdict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, (bag, n) in enumerate(zip(self.bags, self.lengths, strict=True)):
            for h in rarest(bag, df, self.weight, threshold):
                self.rare[n][h].append(i)
        self.rare = {n: dict(own) for n, own in self.rare.items()}
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.intp)] = True
        marks = np.concatenate([pack(signs(s).sum(axis=0, keepdims=True)) for _, _, s in own]) if own else np.zeros((0, BLOCKS), np.uint16)
        self.marks = marks
        self.order = [np.argsort(marks[:, b], kind="stable") for b in range(BLOCKS)]
        self.starts = [np.searchsorted(marks[self.order[b], b], np.arange(65537)) for b in range(BLOCKS)]

    def _weights(self, shingles: np.ndarray) -> np.ndarray:
        return np.array([self.weight[h] for h in shingles.tolist()], np.float32)

    def within(self, mark: np.ndarray) -> list[tuple[int, int]]:
        """(item, distance) of every item whose fingerprint is within the radius."""
        found = set()
        for b in range(BLOCKS):
            values = (mark[b] ^ _FLIPS).astype(np.intp)
            low, high = self.starts[b][values], self.starts[b][values + 1]
            for i in np.flatnonzero(high > low):
                found.update(self.order[b][low[i] : high[i]].tolist())
        if not found:
            return []
        at = np.fromiter(found, np.intp)
        distance = np.bitwise_count(self.marks[at] ^ mark).sum(axis=1)
        return [(int(i), int(d)) for i, d in zip(at, distance, strict=True) if d <= RADIUS]

    def similarity(self, item: int, window: Counter) -> float:
        """Weight of the item's shingles that the window has, repeats counted, by the item's weight."""
        common = sum(min(c, window[h]) * self.weight[h] for h, c in self.bags[item].items() if h in window)
        return common / self.totals[item] if self.totals[item] else 0.0

    def search(self, shingles: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
        """item -> (similarity, distance, first word, words) of its best window in a document.

        Only windows whose known shingles weigh enough for the lightest item of that size are fingerprinted:
        the others cannot reach the threshold.
        """
        best: dict[int, tuple[float, int, int, int]] = {}
        if not len(shingles) or not len(self.known):
            return best
        near = np.flatnonzero(self.filter[(shingles >> np.uint64(44)).astype(np.intp)])
        if not len(near):
            return best
        slot = np.minimum(np.searchsorted(self.known, shingles[near]), len(self.known) - 1)
        near = near[self.known[slot] == shingles[near]]
        by_size: defaultdict[int, list[int]] = defaultdict(list)
        for p in near.tolist():
            for n in self.sizes[int(shingles[p])]:
                by_size[n].append(p)
        for n, at in by_size.items():
            at = np.array(at)
            weight = np.concatenate(([0.0], np.cumsum(self._weights(shingles[at]), dtype=np.float64)))
            # All windows of n shingles that hold a known one; those at the text's ends are as long as the text allows.
            starts = np.unique(np.clip((at[:, None] - np.arange(n)[None, :]).ravel(), 0, max(0, len(shingles) - n)))
            inside = weight[np.searchsorted(at, starts + n)] - weight[np.searchsorted(at, starts)]
            starts = starts[inside >= self.threshold * self.least[n] * 0.9999]
            while len(starts):
                # Windows that overlap share a prefix sum; runs are cut so that it stays small.
                stop = int(np.searchsorted(starts, starts[0] + 4 * n + 256))
                self._windows(shingles, starts[:stop], n, best)
                starts = starts[stop:]
        return best

    def _windows(self, shingles: np.ndarray, starts: np.ndarray, n: int, best: dict) -> None:
        low, high = int(starts[0]), min(len(shingles), int(starts[-1]) + n)
        part = shingles[low:high]
        sums = np.zeros((len(part) + 1, 128), np.float32)  # whole numbers far below 2^24: exact
        np.cumsum(signs(part), axis=0, out=sums[1:])
        ends = np.minimum(starts - low + n, len(part))
        marks = pack(sums[ends] - sums[starts - low])
        seen: dict[bytes, list] = {}
        rare = self.rare[n]
        hits = [(low + p, rare[h]) for p, h in enumerate(part.tolist()) if h in rare]
        places = [p for p, _ in hits]
        for start, mark in zip(starts.tolist(), marks, strict=True):
            items = seen.get(key := mark.tobytes())
            if items is None:
                items = seen[key] = self.within(mark)
            shared = {i for _, own in hits[bisect_left(places, start) : bisect_left(places, start + n)] for i in own}.difference(i for i, _ in items)
            items = items + [(i, int(np.bitwise_count(self.marks[i] ^ mark).sum())) for i in sorted(shared)]
            bag = Counter(shingles[start : start + n].tolist()) if items else None
            for item, distance in items:
                s = self.similarity(item, bag)
                if s >= self.threshold - ROUNDING and (item not in best or (s, -distance, -start) > (best[item][0], -best[item][1], -best[item][2])):
                    best[item] = (s, distance, start, n + self.k - 1)


def _counted(benchmark: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Items with an id and words: item_id, text, and of their shingles how many items hold each; and the number of items."""

    def shingles(batches: Iterable[pa.RecordBatch]):
        hashes = WordHashes()
        for batch in batches:
            found = [np.unique(shingle_hashes(words_of(t), k, hashes)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["item_id", "text", "shingles"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    items = cut(items.mapInArrow(shingles, "item_id long, text string, shingles array<long>").filter("size(shingles) > 0").withColumn("row", F.monotonically_increasing_id()))
    each = items.select("row", F.explode("shingles").alias("shingle"))
    held = each.join(each.groupBy("shingle").agg(F.count("*").alias("n")), "shingle").groupBy("row").agg(F.collect_list(F.struct("shingle", "n")).alias("counts"))
    return cut(items.select("row", "item_id", "text").join(held, "row")), items.count()


def _indexes(benchmark: DataFrame, threshold: float, items_per_pass: int):
    """BenchmarkIndex of items_per_pass items at a time; rows come to the driver a partition at a time."""
    counted, n = _counted(benchmark, SHINGLE_WORDS)
    block: list[tuple[int, str]] = []
    counts: dict[int, int] = {}
    for r in counted.orderBy("item_id", "row").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        counts.update((h % 2**64, c) for h, c in r["counts"])
        if len(block) == items_per_pass:
            yield BenchmarkIndex(block, threshold, SHINGLE_WORDS, counts, n), n
            block, counts = [], {}
    if block:
        yield BenchmarkIndex(block, threshold, SHINGLE_WORDS, counts, n), n


def _bitmap(benchmark: DataFrame, threshold: float, items_per_pass: int) -> np.ndarray:
    """Bits of the rare shingles of all items: 16 MB however many there are; more items only mean more texts that pass."""
    bits = np.zeros(1 << BITMAP_BITS, bool)
    for index, _ in _indexes(benchmark, threshold, items_per_pass):
        for own in index.rare.values():
            bits[[h >> (64 - BITMAP_BITS) for h in own]] = True
    return np.packbits(bits)


def _suspects(docs: DataFrame, bitmap, suspect: bool) -> DataFrame:
    """The rows of docs that hold a shingle of the bitmap, or those that hold none."""

    def run(batches: Iterable[pa.RecordBatch]):
        hashes, bits = WordHashes(), bitmap.value
        for batch in batches:
            keep = []
            for t in batch.column("text").to_pylist():
                at = shingle_hashes(words_of(t), SHINGLE_WORDS, hashes) >> np.uint64(64 - BITMAP_BITS)
                keep.append(bool((bits[(at >> np.uint64(3)).astype(np.intp)] & (np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))).any()) == suspect)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """doc_id, item_id, similarity, distance, first_word, n_words for every item found in a row of docs.

    The best window of each (document, item) is returned: highest similarity, then least distance, then
    first. Null and empty texts hold nothing; an item shorter than a shingle is one shingle and is found
    only in texts that are just as short. Whole texts are read, however long. Repeated items and rows
    give repeated results, an empty table none. Only doc_id, item_id and text are read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, distance int, first_word int, n_words int"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for index, n in _indexes(benchmark, threshold, items_per_pass):
        if found is None and n > items_per_pass:
            own = cut(_suspects(own, spark.sparkContext.broadcast(_bitmap(benchmark, threshold, items_per_pass)), True))
        index = spark.sparkContext.broadcast(index)  # at most items_per_pass items
        one = own.mapInArrow(lambda batches, index=index: _scan(batches, index.value), schema)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], schema) if found is None else found


def _scan(batches: Iterable[pa.RecordBatch], index: BenchmarkIndex):
    hashes = WordHashes()
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for item, (s, distance, start, n) in sorted(index.search(shingle_hashes(words_of(text), index.k, hashes)).items()):
                rows.append((doc, index.ids[item], s, distance, start, n))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "similarity", "distance", "first_word", "n_words"])


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows of docs, with all columns, in which find_leaks finds no item; judged in place.

    Rows with null or empty texts stay, repeated rows are judged alike, an empty table of either kind
    is no error, columns may have any name. With more than one block of items only the rows that hold
    a rare shingle of some item go through the passes, each written before the next.
    """
    clean = None
    for index, n in _indexes(benchmark, threshold, items_per_pass):
        if clean is None and n > items_per_pass:
            bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(benchmark, threshold, items_per_pass))
            clean, docs = _suspects(docs, bitmap, False), cut(_suspects(docs, bitmap, True))
        index = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterable[pa.RecordBatch], index=index):
            hashes = WordHashes()
            for batch in batches:
                free = [not index.value.search(shingle_hashes(words_of(t), index.value.k, hashes)) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(free, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
        if clean is not None:
            docs = cut(docs)
    return docs if clean is None else clean.unionByName(docs)
