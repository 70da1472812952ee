"""Toxicity by a classifier chain over the label columns.

The chain predicts its categories one after another. Each link is a sparse linear model over features
of a document's words and the probabilities of the categories before it. Those are out-of-fold
predictions while a link is fitted, so a later model sees earlier ones as they err on unseen texts.
A document's features are its distinct words, their prefixes of three to eight letters (an inflected
form that no labelled text holds still shows its stem) and its distinct runs of punctuation. A link's
penalty and the cut between its two answers are chosen by its out-of-fold predictions; its bias is
moved so that the cut lies at one half.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain as flatten

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import cut
from lathe.llm.linear import Rows, fit_binary, sigmoid

#: The classifier is fitted on at most so many labelled rows, those of least hash of doc_id.
SAMPLE_ROWS = 6_000
FOLDS = 3
#: A link sees features of at least so many labelled texts whose count deviates by so many standard
#: deviations, the most deviating ones up to LINK_FEATURES; MOST_FEATURES of all links reach the driver.
LEAST_DOCS = 4
DEVIATION = 4.0
LINK_FEATURES = 1_024
MOST_FEATURES = 8_192
PENALTIES = (1e-3, 3e-4, 1e-4)
ROUNDS = 100
THRESHOLD = 0.5
_PREFIXES = range(3, 9)
_TOKENS = re.compile(r"[^\W\d_]+|[^\w\s]+")


def tokens_of(text: str | None) -> set[str]:
    """Distinct words (runs of letters, lower-cased) and distinct runs of punctuation."""
    return set(_TOKENS.findall((text or "").lower()))


def features_of(token: str) -> list[str]:
    """The token and its proper prefixes, which end in a hyphen: no word or punctuation run does after a letter."""
    return [token, *(f"{token[:n]}-" for n in _PREFIXES if n < len(token) and token[0].isalpha())]


class Lookup(dict):
    """token -> numbers of its features, remembered; emptied when full so that memory stays bounded.

    Features are kept by their first three letters and their length: most tokens share no beginning with any.
    """

    LIMIT = 200_000

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.whole: dict[str, int] = {}
        self.stems: dict[str, dict[int, dict[str, int]]] = {}
        for feature, i in vocabulary.items():
            if feature[-1] == "-" and feature[0].isalpha():
                self.stems.setdefault(feature[:3], {}).setdefault(len(feature) - 1, {})[feature[:-1]] = i
            else:
                self.whole[feature] = i

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        found = [self.whole[token]] if token in self.whole else []
        for n, stems in self.stems.get(token[:3], {}).items():
            if n < len(token) and token[:n] in stems:
                found.append(stems[token[:n]])
        out = self[token] = tuple(found)
        return out

    def row(self, text: str | None) -> np.ndarray:
        return np.array(sorted(set(flatten.from_iterable(map(self.__getitem__, tokens_of(text))))), np.int64)


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]  # one per category
    links: list[np.ndarray]  # weights of earlier categories' probabilities
    biases: list[float]

    def predict(self, texts: list[str | None], lookup: Lookup | None = None) -> np.ndarray:
        """(documents, categories): every probability feeds the categories after it."""
        lookup = Lookup(self.vocabulary) if lookup is None else lookup
        x = _rows([lookup.row(t) for t in texts], len(self.vocabulary))
        out = np.zeros((len(texts), len(self.categories)))
        for k in range(len(self.categories)):
            out[:, k] = sigmoid(x.dot(self.weights[k]) + out[:, :k] @ self.links[k] + self.biases[k])
        return out

    def pruned(self) -> Chain:
        """Without features that no link weighs: less to send."""
        used = np.flatnonzero(np.any([w != 0 for w in self.weights], axis=0))
        names = list(self.vocabulary)
        return Chain(self.categories, {names[i]: k for k, i in enumerate(used)}, [w[used] for w in self.weights], self.links, self.biases)


def _rows(at: list[np.ndarray], width: int) -> Rows:
    return Rows([(a, np.ones(len(a))) for a in at], width)


def _telling(x: Rows, y: np.ndarray) -> np.ndarray:
    """Which columns' counts among rows of y = 1 deviate most, and enough, from chance."""
    n, q = x.n, y.mean() if x.n else 0.0
    seen, hits = x.back(np.ones(n)), x.back(y)
    spread = np.sqrt(np.maximum(seen * q * (1 - q) * (n - seen) / max(1, n - 1), 1e-9))
    score = np.where(seen >= LEAST_DOCS, np.abs(hits - seen * q) / spread, 0.0)
    keep = np.zeros(x.width, bool)
    keep[np.argsort(-score, kind="stable")[:LINK_FEATURES]] = True
    return keep & (score >= DEVIATION)


def _fit(x: Rows, earlier: np.ndarray, y: np.ndarray, l1: float) -> tuple[np.ndarray, np.ndarray, float]:
    keep = _telling(x, y)
    own, e, b = fit_binary(x.among(keep), earlier, y, l1, 1e-5, ROUNDS)
    w = np.zeros(x.width)
    w[keep] = own
    return w, e, b


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of greatest F1, the middle one of equals; one half where nothing is to be found."""
    if not y.any():
        return 0.5
    cuts = np.linspace(0.05, 0.95, 19)
    f1 = [2 * ((p >= c) & (y == 1)).sum() / ((p >= c).sum() + y.sum()) for c in cuts]
    best = cuts[np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)]
    return float(best[len(best) // 2])


def _out_of_fold(x: Rows, earlier: np.ndarray, y: np.ndarray, fold: np.ndarray, l1: float) -> np.ndarray:
    """What a row's label looks like to a model fitted without the row's fold."""
    p = np.full(x.n, y.mean() if x.n else 0.0)
    for f in np.unique(fold):
        rest = fold != f
        if rest.any():
            w, e, b = _fit(x.pick(rest), earlier[rest], y[rest], l1)
            p[~rest] = sigmoid(x.pick(~rest).dot(w) + earlier[~rest] @ e + b)
    return p


def fit_chain(x: Rows, vocabulary: dict[str, int], labels: dict[str, np.ndarray], fold: np.ndarray) -> Chain:
    """Fit the links in the order of labels; features are chosen anew without each fold."""
    earlier = np.zeros((x.n, 0))
    chain = Chain(list(labels), vocabulary, [], [], [])
    for y in labels.values():
        tried = []
        for l1 in PENALTIES:
            p = np.clip(_out_of_fold(x, earlier, y, fold, l1), 1e-6, 1 - 1e-6)
            tried.append((-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() if x.n else 0.0, l1, p))
        _, l1, p = min(tried, key=lambda t: t[:2])
        at = _cut(p, y)
        move = np.log(at / (1 - at))
        w, e, b = _fit(x, earlier, y, l1)
        chain.weights.append(w), chain.links.append(e), chain.biases.append(float(b - move))
        earlier = np.column_stack((earlier, sigmoid(np.log(p / (1 - p)) - move)))
    return chain


def _all_features(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        found = [sorted({f for token in tokens_of(t) for f in features_of(token)}) for t in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.list_(pa.string()))], [*names, "features"])


def _deviation(seen: Column, hits: Column, n: int, positive: int) -> Column:
    """Squared deviations of a count from chance, as in _telling."""
    q = positive / n
    spread = F.greatest(seen * F.lit(q * (1 - q) / max(1, n - 1)) * (F.lit(n) - seen), F.lit(1e-9))
    return F.when(seen >= LEAST_DOCS, (hits - seen * F.lit(q)) ** 2 / spread).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> Chain | None:
    """Fit on at most sample_rows labelled documents. categories: name -> SQL condition over labels, in chain order.

    Labels without doc_id and conditions that are null count as no label; of repeated labels the
    greatest holds, of repeated doc_ids the least text. Equal texts are in the same fold. The driver
    gets the sample's numbers of at most MOST_FEATURES features. None without labelled texts.
    """
    names = [f"c{i}" for i in range(len(categories))]
    conditions = [F.max(F.expr(f"CAST({c} AS INT)")).alias(n) for n, c in zip(names, categories.values(), strict=True)]
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*conditions).na.drop()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text"))
    rows = cut(texts.withColumn("fold", F.expr(f"CAST(pmod(xxhash64(text), {folds}) AS INT)")))

    totals = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(n).alias(n) for n in names)).collect()}
    if not totals:
        return None
    count = lambda f, what: F.sum(F.when(F.col("fold") == f, what).otherwise(0))
    seen = rows.select("fold", *names, "text").mapInArrow(_all_features, "fold int, " + ", ".join(f"{n} int" for n in names) + ", features array<string>")
    seen = seen.select("fold", *names, F.explode("features").alias("feature")).groupBy("feature").agg(*(count(f, F.lit(1)).alias(f"n_{f}") for f in totals), *(count(f, F.col(n)).alias(f"{n}_{f}") for f in totals for n in names))
    scores = [F.lit(0.0)]
    for held in (None, *totals):
        rest = [f for f in totals if f != held]
        n = sum(totals[f]["n"] for f in rest)
        for c in names if n else []:
            scores.append(_deviation(sum(F.col(f"n_{f}") for f in rest), sum(F.col(f"{c}_{f}") for f in rest), n, sum(totals[f][c] for f in rest)))
    telling = seen.select("feature", F.greatest(F.lit(0.0), *scores).alias("score")).filter(F.col("score") >= DEVIATION**2 - 1e-9)
    vocabulary = {r["feature"]: i for i, r in enumerate(telling.orderBy(F.desc("score"), "feature").limit(MOST_FEATURES).collect())}

    def numbers(batches: Iterable[pa.RecordBatch]):
        lookup = Lookup(vocabulary)
        for batch in batches:
            found = [lookup.row(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "fold", *names)), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "fold", *names, "at"])

    got = rows.select("doc_id", "fold", *names, "text").mapInArrow(numbers, "doc_id long, fold int, " + ", ".join(f"{n} int" for n in names) + ", at array<long>").toPandas().sort_values("doc_id")
    y = {c: got[n].to_numpy(float) for c, n in zip(categories, names, strict=True)}
    return fit_chain(_rows([np.asarray(a, np.int64) for a in got["at"]], len(vocabulary)), vocabulary, y, got["fold"].to_numpy()).pruned()


#: The label table has two judgements; their combination is the third category.
CATEGORIES = {"junk": "quality = 0", "toxic": "toxic = 1", "toxic_junk": "toxic = 1 AND quality = 0"}


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, verdict: str = "toxic", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, a probability p_<category> each, and toxic (that of verdict is at least threshold), per row of docs.

    Whole texts are judged, however long; a null or empty text has no features and gets the
    probabilities that stand for none. Without any labelled text all probabilities are 0. Repeated
    rows give repeated results, an empty table none; columns other than doc_id and text are not read.
    """
    chain = train(docs, labels, categories, sample_rows)
    names = list(categories)

    def judge(batches: Iterable[pa.RecordBatch]):
        lookup = Lookup(chain.vocabulary) if chain else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            p = chain.predict(texts, lookup) if chain else np.zeros((len(texts), len(names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(names)))], ["doc_id", *(f"p_{c}" for c in names)])

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in names)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, schema)
    return scored.withColumn("toxic", F.col(f"p_{verdict}") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, texts: DataFrame | None = None, categories: dict[str, str] = CATEGORIES, verdict: str = "toxic", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that are not judged toxic, with all columns; judged in place, so nothing is joined.

    texts: documents that the labels are about, docs itself if None. Nulls, empty and long texts,
    repeated rows and empty tables as in score_toxicity; all rows stay where nothing is labelled.
    """
    chain = train(docs if texts is None else texts, labels, categories, sample_rows)
    at = list(categories).index(verdict)

    def keep(batches: Iterable[pa.RecordBatch]):
        lookup = Lookup(chain.vocabulary) if chain else None
        for batch in batches:
            if batch.num_rows and chain:
                p = chain.predict(batch.column("text").to_pylist(), lookup)[:, at]
                batch = batch.filter(pa.array(p < threshold))
            yield batch

    return docs.mapInArrow(keep, docs.schema)
