"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents are shuffled and given virtual finish times: cumulative words of the source,
divided by its target. The sources' queues are merged by finish time and cut off at the budget. A
source whose target exceeds its size goes round again, up to the number of repeats.

Cumulative sums use slices of the shuffle order (source, slice): totals per slice are summed first and
a window inside a slice does the rest, so a source with a third of all rows is spread over many tasks.
The cut is found the same way: words per range of finish times, ranges within the range at the cut, and
an exact order once few turns are left. Only the sources themselves are ranked in one task (a row each).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lathe.llm.common import WORD, cut, fresh

#: Slices of the shuffle order hold about so many documents; there are at most so many slices a source.
SLICE_ROWS, MOST_SLICES = 250, 65_536
#: Finish times are counted in so many ranges, and the range at the cut again, until it holds at most so many turns.
RANGES, EXACT_ROWS = 4_096, 100_000


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix") -> DataFrame:
    """All columns of docs (doc_id, source, text) with size, source_size, target and taken.

    size: words of the text (null or empty: 0). Sources in code point order, null last, have the
    weights, repeating, and share `share` times all words; a target stops at `repeats` times its
    source's size and the excess goes to the others by weight. taken: words of the document in
    the mix, repeats counted; the document at the cut is taken in part, so the total is the budget.
    The order depends on seed, doc_id, size and a hash of the text, so reruns agree; rows equal in
    these are interchangeable. Columns of docs with the result's names are replaced, others may have
    any name. Empty in, empty out.
    """
    own = fresh("_mix", docs.columns)
    SIZE, SOURCE, KEY, TIE, SLICE, BEFORE, END = (f"{own}_{x}" for x in ("size", "source", "key", "tie", "slice", "before", "end"))
    slices = min(MOST_SLICES, max(1, math.ceil(docs.count() / SLICE_ROWS)))
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    base = docs.drop("size", "source_size", "target", "taken").withColumns({
        SIZE: F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")),
        SOURCE: F.when(F.col("source").isNull(), "b").otherwise(F.concat(F.lit("a"), F.col("source").cast("string"))),
        KEY: key,
        TIE: F.xxhash64("text"),
    })
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    base = base.withColumn(SLICE, F.floor(F.conv(F.substring(KEY, 1, 8), 16, 10).cast("long") * slices / 2**32))

    # Words are counted once for the search of the cut (small rows, written) and once for the result.
    sizes = cut(base.select(SOURCE, SLICE, KEY, TIE, SIZE))
    totals = cut(sizes.groupBy(SOURCE, SLICE).agg(F.sum(SIZE).alias("words")))
    sources = _targets(totals.groupBy(SOURCE).agg(F.sum("words").alias("source_size")), SOURCE, weights, share, repeats)
    before = F.coalesce(F.sum("words").over(W.partitionBy(SOURCE).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cut(totals.join(sources, SOURCE).select(SOURCE, SLICE, "source_size", "target", before.alias(BEFORE)))
    budget = starts.select(SOURCE, "target").distinct().agg(F.floor(F.coalesce(F.sum("target"), F.lit(0.0)) + 1e-6)).first()[0]

    within = F.sum(SIZE).over(W.partitionBy(SOURCE, SLICE).orderBy(KEY, SIZE, TIE).rowsBetween(W.unboundedPreceding, 0))
    queued = lambda rows: rows.join(starts.withColumnsRenamed({"source_size": f"{own}_of", "target": f"{own}_to"}), [SOURCE, SLICE]).withColumn(END, F.col(BEFORE) + within)
    finish = lambda turn: (F.col(END) + F.lit(turn) * F.col(f"{own}_of")) / F.col(f"{own}_to")
    order = ["finish", "source", "key", "size", "tie", "turn"]
    turns = queued(sizes).filter(F.col(SIZE) > 0).select(F.explode(F.array(*[F.struct(finish(i).alias("finish"), F.col(SOURCE).alias("source"), F.col(KEY).alias("key"), F.col(SIZE).alias("size"), F.col(TIE).alias("tie"), F.lit(i).alias("turn")) for i in range(repeats)])).alias("t")).select("t.*")
    last, left = _at_cut(cut(turns), order, budget)
    total = F.lit(0).cast("long")
    for i in range(repeats):
        here = F.struct(finish(i), F.col(SOURCE), F.col(KEY), F.col(SIZE), F.col(TIE), F.lit(i))
        total = total + (F.col(SIZE) if last is None else _taken(here, F.col(SIZE), last, left))
    taken = F.when(F.col(SIZE) > 0, total).otherwise(F.lit(0)).cast("long")
    return queued(base).select(*kept, F.col(SIZE).alias("size"), F.col(f"{own}_of").alias("source_size"), F.col(f"{own}_to").alias("target"), taken.alias("taken"))


def _at_cut(turns: DataFrame, order: list[str], budget: int):
    """The turn in which the budget is reached, and how many of its words are left: (None, 0) if it is never reached.

    Words are summed per range of finish times; the range that holds the cut is divided in ranges again
    until few turns are left, and only those are put in exact order.
    """
    low, width, passed = 0.0, 1.0 / RANGES, 0
    part = turns
    while True:
        place = F.least(F.greatest(F.floor((F.col("finish") - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(8 * RANGES)).cast("long")
        sums = part.withColumn("range", place).groupBy("range").agg(F.sum("size").alias("words"), F.count("*").alias("n")).orderBy("range").collect()  # at most 8 * RANGES + 1 rows
        at = None
        for r in sums:
            if passed + r["words"] >= budget:
                at = r
                break
            passed += r["words"]
        if at is None:
            return None, 0
        part = part.filter(place == at["range"])
        if at["n"] <= EXACT_ROWS or width < 1e-13:
            break
        low, width = low + at["range"] * width, width / RANGES
    through = F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) + F.lit(passed)
    last = part.select(*order, through.alias("through")).filter(F.col("through") >= budget).orderBy("through", *order).first()
    return last, int(budget - (last["through"] - last["size"]))


def _taken(own: Column, size: Column, last, left: int) -> Column:
    """Words taken of one turn: all before the cut, `left` of the turn at the cut, none beyond."""
    end = F.struct(F.lit(last["finish"]), F.lit(last["source"]), F.lit(last["key"]), F.lit(last["size"]).cast("long"), F.lit(last["tie"]).cast("long"), F.lit(last["turn"]))
    return F.when(own < end, size).when(own == end, F.lit(left).cast("long")).otherwise(F.lit(0).cast("long"))


def _targets(sources: DataFrame, source: str, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """Water filling: target = least(cap, level * weight). Ordered by cap / weight, the level that spends what
    the sources before leave is largest exactly where the first uncapped source begins. One row per source."""
    turn = (F.row_number().over(W.orderBy(source)) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sources.withColumns({"weight": weight, "cap": (F.col("source_size") * repeats).cast("double")})
    order = W.orderBy(F.col("cap") / F.col("weight"), source)
    spent = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy()
    levels = ranked.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - spent) / rest)
    return levels.select(source, "source_size", F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight")).alias("target"))
