"""Document fingerprints from prefix polynomial hashes.

A modular prefix array over a text's code points answers whether any two spans are equal in constant
time, and the longest common extension of two positions by binary search. The likeness of two texts is
the share of the longer one that such extensions cover: from the beginning, back from the end, across
small edits, and from blocks of one that occur anywhere in the other.

A stored fingerprint keeps the prefix array at every s-th position (s a power of two, at most 128
positions). Without the texts it still answers which blocks are equal at equal places (`stored_likeness`)
and about how long the common beginning is (`common_beginning`), not what has moved.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import cut

#: Two primes below 2^31, and a base for each.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
BLOCKS = 128
#: Where two texts part, extensions go on after at most so many code points of each, if so many agree there.
MOST_SKIPPED = 4
RESUME = 16
#: Blocks that are looked for anywhere are at least so long.
LEAST_BLOCK = 32
#: Rows of a stretch of the doc_id order that one task edits.
STRETCH_ROWS = 2_000
#: At most so many stretches; so many sampled doc_ids for each reach the driver.
MOST_STRETCHES = 100_000
SAMPLED_IDS = 40
_powers = [np.ones(1, np.uint64) for _ in PRIMES]


def powers(k: int, n: int) -> np.ndarray:
    """BASES[k] ** i for i < n, extended by doubling."""
    while len(_powers[k]) < n:
        have = _powers[k]
        step = np.uint64(int(have[-1]) * BASES[k] % PRIMES[k])
        _powers[k] = np.concatenate((have, have * step % np.uint64(PRIMES[k])))
    return _powers[k][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Modular prefix arrays of a text: sums of (code point + 1) * base ** position."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        c = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for k, prime in enumerate(PRIMES):  # a term is below 2^31, so 2^33 terms fit
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * powers(k, self.n) % np.uint64(prime), out=s[1:])
            self.sums.append(s)

    def _raw(self, k: int, i: int, j: int) -> int:
        return (int(self.sums[k][j]) - int(self.sums[k][i])) % PRIMES[k]

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether self[i:i+length] and other[j:j+length] are equal: both are shifted to one power of the base."""
        for k, prime in enumerate(PRIMES):
            a, b = self._raw(k, i, i + length), other._raw(k, j, j + length)
            if a * pow(BASES[k], max(0, j - i), prime) % prime != b * pow(BASES[k], max(0, i - j), prime) % prime:
                return False
        return True

    def common(self, i: int, other: PrefixHash, j: int) -> int:
        """Longest common extension of self[i:] and other[j:]."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low

    def fingerprint(self) -> str:
        """Hex of length, block size, and the prefix array mod each prime at every block's end and at the text's end."""
        size = 1
        while size * BLOCKS < self.n:
            size *= 2
        ends = np.append(np.arange(size, self.n, size), self.n) if self.n else np.empty(0, np.int64)
        marks = np.stack([s[ends] % np.uint64(p) for s, p in zip(self.sums, PRIMES, strict=True)], axis=1).astype("<u4")
        return (struct.pack("<QI", self.n, size) + marks.tobytes()).hex()


def unpack(fingerprint: str) -> tuple[int, int, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    n, size = struct.unpack_from("<QI", raw)
    return n, size, np.frombuffer(raw, "<u4", offset=12).reshape(-1, 2).astype(np.int64)


def stored_likeness(a: str, b: str) -> float:
    """Of two stored fingerprints: share of the longer text in blocks that are equal at the same place; 1 for equal texts, both empty included."""
    if a == b:
        return 1.0
    (n, s, x), (m, t, y) = unpack(a), unpack(b)
    if not n or not m:
        return 0.0
    size = max(s, t)
    whole = min(n, m) // size
    pick = lambda marks, own: np.concatenate((np.zeros((1, 2), np.int64), marks[(np.arange(1, whole + 1) * size - 1) // own]))
    same = (np.diff(pick(x, s), axis=0) - np.diff(pick(y, t), axis=0)) % np.array(PRIMES) == 0
    return min(1.0, int(same.all(axis=1).sum()) * size / max(n, m))


def common_beginning(a: str, b: str) -> int:
    """Of two stored fingerprints: how many code points the texts begin with in common, rounded down to a kept place; by binary search."""
    if a == b:
        return unpack(a)[0]
    (n, s, x), (m, t, y) = unpack(a), unpack(b)
    size = max(s, t)
    low, high = 0, min(n, m) // size
    while low < high:
        mid = (low + high + 1) // 2
        at = mid * size - 1
        low, high = (mid, high) if (x[at // s] == y[at // t]).all() else (low, mid - 1)
    return low * size


def _extend(x: PrefixHash, i: int, y: PrefixHash, j: int) -> tuple[int, int, int]:
    """(code points covered, where it ends in x, in y) of an extension from i and j that goes on across small edits."""
    covered = 0
    while True:
        n = x.common(i, y, j)
        covered, i, j = covered + n, i + n, j + n
        if i >= x.n or j >= y.n:
            return covered, i, j
        for skip in range(1, 2 * MOST_SKIPPED + 1):
            hops = [(k, skip - k) for k in range(skip + 1) if k <= MOST_SKIPPED and skip - k <= MOST_SKIPPED]
            hop = next((h for h in hops if min(x.n - i - h[0], y.n - j - h[1]) >= RESUME and x.equal(i + h[0], y, j + h[1], RESUME)), None)
            if hop:
                break
        else:
            return covered, i, j
        i, j = i + hop[0], j + hop[1]


def _back(x: PrefixHash, i: int, y: PrefixHash, j: int, most: int) -> int:
    """Longest common extension back from the ends i and j, at most `most`."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x.equal(i - mid, y, j - mid, mid) else (low, mid - 1)
    return low


def likeness(x: PrefixHash, y: PrefixHash) -> float:
    """Share of the longer text that longest common extensions with the other cover; 1 for equal texts only, both empty included.

    One walk from the beginning, one extension back from the end of what it leaves, then blocks of what is
    left of the shorter text, wherever they occur in what is left of the other: each is extended both ways
    and the walk goes on behind it. An insertion or a small edit costs its own length, a passage that moved
    counts unless it is shorter than two blocks (of LEAST_BLOCK, or a 128th of the rest).
    """
    if x.n > y.n:
        x, y = y, x
    if not x.n:
        return float(not y.n)
    covered, i, j = _extend(x, 0, y, 0)
    tail = _back(x, x.n, y, y.n, min(x.n - i, y.n - j))
    covered, end, stop = covered + tail, x.n - tail, y.n - tail
    size = max(LEAST_BLOCK, -(-(end - i) // BLOCKS))
    if end - i >= size and stop - j >= size:
        # Hashes of all windows of that size, each times the power that the windows before it lack.
        p = np.uint64(PRIMES[0])
        here = lambda own, at: ((own.sums[0][at + size] - own.sums[0][at]) % p) * powers(0, y.n + 1)[y.n - at] % p
        blocks = np.arange(i, end - size + 1, size)
        wanted = here(x, blocks)
        keys = np.unique(wanted)
        windows = np.arange(j, stop - size + 1)
        marks = here(y, windows)
        slot = np.minimum(np.searchsorted(keys, marks), len(keys) - 1)
        hits = np.flatnonzero(keys[slot] == marks)
        order = hits[np.argsort(slot[hits], kind="stable")]
        starts = np.searchsorted(slot[order], np.arange(len(keys) + 1))
        at = i
        for block, key in zip(blocks.tolist(), np.searchsorted(keys, wanted).tolist(), strict=True):
            if block < at or starts[key] == starts[key + 1]:
                continue
            place = int(windows[order[starts[key]]])
            if x.equal(block, y, place, size):
                back = _back(x, block, y, place, min(block - at, place))
                n, at, _ = _extend(x, block, y, place)
                covered += back + n
    whole = x.n == y.n and x.equal(0, y, 0, x.n)
    return 1.0 if whole else min(covered / y.n, 1 - 1 / (y.n + 1))


def fingerprint(text: str) -> str:
    return PrefixHash(code_points(text)).fingerprint()


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many code points of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _edit(batches: Iterable[pa.RecordBatch]):
    """Rows in order of stretch and place; the last of each stretch only serves as the next of the one before."""
    held = None
    for batch in batches:
        out = []
        for stretch, doc, text, guest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = (stretch, doc, text, PrefixHash(code_points(text)))
            if held is not None and held[0] == stretch:
                new = edited(held[2], text)
                prefix = PrefixHash(code_points(new))
                row = (held[1], held[3].n, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), held[3].fingerprint(), prefix.fingerprint(), likeness(held[3], prefix), likeness(held[3], own[3]))
                out.append(row)
            held = None if guest else own
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def _stretches(own: DataFrame) -> tuple[list[tuple[int, int]], int, int]:
    """((least doc_id, pieces) of each stretch in ascending order; pieces of the rows without doc_id; all stretches).

    Bounds are quantiles of a sample of doc_ids; they decide which task edits a row, not what comes out.
    An id that fills several stretches by itself, as a missing one may, is cut by a hash of its texts.
    """
    n, known = own.agg(F.count("*"), F.count("doc_id")).first()
    pieces = min(MOST_STRETCHES, max(1, n // STRETCH_ROWS))
    share = min(1.0, SAMPLED_IDS * pieces / max(1, known))
    ids = own.select("doc_id").filter("doc_id IS NOT NULL")
    ids = np.sort((ids if share == 1 else ids.sample(False, share, 1)).toPandas()["doc_id"].to_numpy(np.int64))
    marks = ids[np.arange(1, pieces) * len(ids) // pieces] if len(ids) else ids
    values, times = np.unique(marks, return_counts=True)
    cuts = {-(2**63): 1}
    for v, t in zip(values.tolist(), times.tolist(), strict=True):
        cuts[v] = t + 1 if t > 1 else cuts.get(v, 1)
        if t > 1 and v < 2**63 - 1:
            cuts.setdefault(v + 1, 1)
    lost = max(1, (n - known) // STRETCH_ROWS)
    return sorted(cuts.items()), min(lost, MOST_STRETCHES), sum(cuts.values()) + lost


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness; see `edited` and `likeness`.

    The next document is the one with the next smaller doc_id (the last one's is the first); equal
    doc_ids are ordered by a hash of the text and the text, null doc_ids come last. A null text is empty.
    The only document of a table is its own next. Whole texts are read, however long. Other columns are
    not read; an empty table gives an empty result.

    The order is cut into stretches of about STRETCH_ROWS rows. A stretch gets a copy of the first row
    of the next one, so no window over all rows is needed and texts move once.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts, lost, total = _stretches(own)
    lows = np.array([v for v, _ in cuts], np.int64)
    parts = np.array([p for _, p in cuts], np.int64)
    after = parts[::-1].cumsum()[::-1] - parts  # stretches of greater doc_ids come before

    @F.pandas_udf("long")
    def stretch(ids: pd.Series, known: pd.Series, tie: pd.Series) -> pd.Series:
        """Stretches in descending order of doc_id, then ascending hash; those without doc_id come after all."""
        at = np.searchsorted(lows, ids.to_numpy(np.int64), "right") - 1
        first, of = np.where(known, after[at], parts.sum()), np.where(known, parts[at], lost)
        # The hash's place among `of` equal ranges; 32 bits of it, so that the product stays in range.
        return pd.Series(first + (((tie.to_numpy(np.int64) >> 32) + 2**31) * of >> 32))

    placed = own.withColumn("tie", F.xxhash64("text")).withColumn("stretch", stretch(F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNotNull(), "tie"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not("doc_id").alias("down"), "tie")
    heads = placed.groupBy("stretch").agg(F.min(place).alias("h")).orderBy("stretch").collect()  # a row per stretch
    if not heads:
        return spark.createDataFrame([], _SCHEMA)
    rows = [(h["stretch"], h["h"]["down"], h["h"]["tie"], heads[i - 1]["stretch"]) for i, h in enumerate(heads)]  # the first one's guest goes to the last: a ring
    lead = spark.createDataFrame(rows, "stretch long, down long, head long, guest_of long")
    first = placed.join(F.broadcast(lead), "stretch").filter(F.bitwise_not("doc_id").eqNullSafe(F.col("down")) & (F.col("tie") == F.col("head"))).groupBy("guest_of").agg(F.min("text").alias("text"))
    guests = cut(first.select(F.col("guest_of").alias("stretch"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("guest"), F.lit(0).cast("long").alias("tie")))
    rows = placed.select("stretch", "doc_id", "text", F.lit(False).alias("guest"), "tie").unionByName(guests)
    dealt = rows.repartition(max(8, 2 * len(heads)), "stretch").sortWithinPartitions("stretch", "guest", F.col("doc_id").desc_nulls_last(), "tie", "text")
    return dealt.select("stretch", "doc_id", "text", "guest").mapInArrow(_edit, _SCHEMA)
