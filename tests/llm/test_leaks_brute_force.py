"""Decontamination against all windows of every document."""

import random
from collections import Counter

from lathe.llm import decontaminate
from lathe.llm.common import WordHashes, shingle_hashes

NAMES = [f"w{i}" for i in range(4000)]


def brute(index, text):
    """item -> similarity of its best window, of those at the threshold."""
    s = shingle_hashes(decontaminate.words_of(text), index.k, WordHashes()).tolist()
    best = {}
    for item, n in enumerate(index.lengths):
        top = max(index.similarity(item, Counter(s[i : i + n])) for i in range(max(1, len(s) - n + 1)))
        if top >= index.threshold - 1e-9:
            best[index.ids[item]] = round(top, 9)
    return best


def compare(spark, items, texts):
    index = decontaminate.BenchmarkIndex(items)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in rows}
    assert got == {(d, i): s for d, t in enumerate(texts) for i, s in brute(index, t).items()}
    clean = {r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in got}
    return rows


def test_edited_items(spark):
    """One inner word of 29 to 31 replaced, two of 54 to 59: similarities just above the threshold."""
    d = random.Random(5)
    items, texts = [], []
    for i in range(60):
        n = d.choice((29, 30, 31) if i % 2 else tuple(range(54, 60)))
        words = d.sample(NAMES, n)
        items.append((i, " ".join(words)))
        for _ in range(3):
            new = list(words)
            for at in (n // 2,) if i % 2 else (n // 3, 2 * n // 3):
                new[at] = d.choice(NAMES) + "x"
            texts.append(" ".join(d.sample(NAMES, 15) + new + d.sample(NAMES, 15)))
    rows = compare(spark, items, texts)
    assert len({r["doc_id"] for r in rows}) == len(texts)
    assert max(r["distance"] for r in rows) > decontaminate.RADIUS  # the radius alone misses some


def test_items_of_a_common_form(spark):
    """Most shingles are shared by all items, so few heavy ones decide; the foreign words are one word repeated."""
    d = random.Random(6)
    form = d.sample(NAMES, 60)
    items = [(i, " ".join(form + d.sample(NAMES, 7))) for i in range(30)]
    texts = []
    for _, t in items:
        words = t.split()
        texts += [" ".join([*words[:-k], *["echo"] * k]) for k in (1, 2, 3, 5)]
        texts += [" ".join(["echo"] * k + words[k:]) for k in (5, 10, 20)]
    rows = compare(spark, items, texts)
    assert max(r["distance"] for r in rows) > decontaminate.RADIUS
