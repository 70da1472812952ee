"""URL filters: longest matching rule first, else naive Bayes over segmented host and path words.

Names are split by a unigram model: the words of all pages, counted over the whole table, mixed with the
word lists below. The words stay a table of any size: each name is given those that it holds (`PageWords`),
which are all that its split depends on. The naive Bayes model is multinomial over the split names of
labelled URLs; as no table labels URLs, they are made by a rule from the lists (`labelled_urls`), with names
run together as they are on the web, so that the counts include what segmentation gets wrong.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lathe.llm.common import cut

#: Words that mark unwanted and wanted pages.
BLOCK_WORDS = "casino poker porn sex xxx adult bet bets betting viagra cialis pill pills loan loans payday jackpot slots gamble gambling escort cams nude webcam torrent warez crack keygen replica cheap bonus roulette lottery dating hookup pharmacy malware phishing spam ads adserver banner track tracker tracking popup affiliate win free".split()
ALLOW_WORDS = "news blog wiki docs school university library science research history health education museum travel food sport music art book books code open data weather garden recipes forum support help about article story world local daily times journal review guide learn shop mail page post".split()
#: Words that either kind of page has.
COMMON_WORDS = "the and of to in for a on my your our with best new online home web site net top big good great now go get all one live real super mega hot red blue green house car city park work life time day night game games play player club land zone hub lab box base star king queen man men girl boys kids family love money bank card cash credit fast easy smart safe secure farm".split()
#: Parts of names that say nothing.
PARTS = "www m mobile blog en de fr es it index html page example".split()

#: So many URLs are made to fit the naive Bayes model.
LABELLED_URLS = 4_000
#: The unigram model knows all words of pages that occur so often; fewer count as unknown.
LEAST_COUNT = 5
#: All of them, unless a smaller model is asked for: then at most so many, the most frequent ones (none or all of
#: those that are equally frequent).
MOST_WORDS = math.inf
#: Names are looked up so many to a task; their parts are passed on so many at a time.
TASK_NAMES, BATCH_PARTS = 20_000, 20_000
#: Probability of all listed words together, and of an unknown stretch before its letters.
LISTED, UNKNOWN = 0.2, 1e-6

#: host, path prefix, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def labelled_urls(n: int = LABELLED_URLS, seed: int = 3) -> list[tuple[str, str, bool]]:
    """(host, path, whether it is to be blocked): two or three words run together or set apart, one of them telling in most."""
    d = random.Random(seed)
    syllable = lambda: "".join(d.choice("bcdfghklmnprstvw") + d.choice("aeiou") for _ in range(d.randint(2, 4)))
    out = []
    for _ in range(n):
        block = d.random() < 0.4
        plain = lambda: d.choice(COMMON_WORDS) if d.random() < 0.7 else syllable()
        telling = lambda own: d.choice(own)
        names = [plain() for _ in range(d.randint(0, 2))]
        if block:
            names.append(telling(BLOCK_WORDS))
        elif d.random() < 0.7 or not names:
            names.append(telling(ALLOW_WORDS))
        d.shuffle(names)
        sub = d.choice(["", "", "www.", "m.", "blog."])
        path = [d.choice(PARTS)] + [telling(BLOCK_WORDS if block else ALLOW_WORDS) if d.random() < 0.3 else plain() for _ in range(d.randint(0, 2))]
        out.append((f"{sub}{d.choice(['', '-']).join(names)}{d.choice(['', '.example'])}.com", f"/{'/'.join(path)}/{d.randint(1, 9999)}", block))
    return out


def url_names(host: str, path: str) -> list[str]:
    """The runs of letters that are split into words, in order."""
    # Public suffixes and digits say nothing; names are split at all else that is no letter.
    return re.findall(r"[^\W\d_]+", host.rpartition(".")[0] or host) + re.findall(r"[^\W\d_]+", path.lower())


class UrlModel:
    """A unigram model for splitting names and a multinomial naive Bayes model of two classes.

    counts: how often words occur in pages; the listed words are known without. total: occurrences of all words,
    where counts has only those that the labelled URLs hold, and the listed ones.
    """

    def __init__(self, counts: dict[str, int] | None = None, labelled: Iterable[tuple[str, str, bool]] | None = None, smoothing: float = 1.0, total: int | None = None):
        listed = {*BLOCK_WORDS, *ALLOW_WORDS, *COMMON_WORDS, *PARTS}
        counts = {w: c for w, c in (counts or {}).items() if len(w) > 1}
        self.total = sum(counts.values()) if total is None else total
        self.base = LISTED / len(listed)
        self.logp = {w: self.log_probability(w in listed, counts.get(w, 0)) for w in {*listed, *counts}}
        self.listed = {w: self.logp[w] for w in listed}
        self.longest = max(map(len, self.logp))
        self.unknown = math.log(UNKNOWN)
        seen = {True: Counter(), False: Counter()}
        urls: Counter[bool] = Counter()
        for host, path, block in labelled_urls() if labelled is None else labelled:
            seen[block].update(self.tokens(host, path))
            urls[block] += 1
        words = {*seen[True], *seen[False]}
        size = {c: sum(n.values()) + smoothing * len(words) for c, n in seen.items()}
        self.prior = math.log((urls[True] + smoothing) / (urls[False] + smoothing))
        self.weight = {w: math.log((seen[True][w] + smoothing) / size[True]) - math.log((seen[False][w] + smoothing) / size[False]) for w in words}

    def log_probability(self, listed: bool, count: int) -> float:
        return math.log(self.base * listed + ((1 - LISTED) * count / self.total if self.total else 0))

    def segment(self, name: str, counts: dict[str, int] | None = None) -> list[str]:
        """Most probable split of a name into words (Viterbi); a stretch without known words stays whole.

        counts: those of all words of pages that the name holds, where the model was made with `total`.
        An unknown stretch of n letters costs log(UNKNOWN) and 2.3 a letter, so it is only cut where
        known words gain by it. Work is the length times the longest word: unknown stretches extend by a letter.
        """
        n, logp, longest = len(name), self.logp, self.longest
        if counts is not None:
            logp = self.listed | {w: self.log_probability(w in self.listed, c) for w, c in counts.items()}
            longest = max(map(len, logp))
        best = [0.0] + [-math.inf] * n  # ends here with a whole word
        open_ = [-math.inf] * (n + 1)  # ends here inside an unknown stretch
        back: list[int] = [0] * (n + 1)
        began: list[int] = [0] * (n + 1)
        for i in range(1, n + 1):
            start, longer = best[i - 1] + self.unknown - 2.3, open_[i - 1] - 2.3
            open_[i], began[i] = (start, i - 1) if start >= longer else (longer, began[i - 1])
            best[i], back[i] = open_[i], began[i]
            for j in range(max(0, i - longest), i):
                p = logp.get(name[j:i])
                if p is not None and best[j] + p > best[i]:
                    best[i], back[i] = best[j] + p, j
        words, i = [], n
        while i:
            words.append(name[back[i] : i])
            i = back[i]
        return words[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        return [w for x in url_names(host, path) for w in self.segment(x)]

    def score(self, tokens: list[str]) -> float:
        """Log odds of block against allow; words that neither class has are left out."""
        return self.prior + sum(self.weight.get(t, 0.0) for t in tokens)


@lru_cache(1)
def default_model() -> UrlModel:
    """The model that knows the listed words only."""
    return UrlModel()


class PageWords:
    """The words of all pages (html, markup taken out) with their counts, as a table; `total` is the sum of the counts."""

    def __init__(self, pages: DataFrame):
        text = F.lower(F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?s)<[^>]*>", " "))
        words = cut(pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("word").count().filter(F.col("count") >= LEAST_COUNT))
        if MOST_WORDS < math.inf:
            # How many words have each frequency says where the most frequent ones end.
            times = words.groupBy("count").agg(F.count("*").alias("words"))
            up = W.orderBy(F.desc("count")).rowsBetween(W.unboundedPreceding, 0)
            least = times.select("count", F.sum("words").over(up).alias("kept")).filter(F.col("kept") <= MOST_WORDS).agg(F.min("count")).first()[0]
            words = words.filter(F.col("count") >= F.lit(least))
        self.words = words.filter(F.length("word") > 1)
        sizes = self.words.groupBy(F.length("word").alias("size")).agg(F.sum("count").alias("n")).collect()
        self.sizes, self.total = sorted(r["size"] for r in sizes), sum(r["n"] for r in sizes)

    def inside(self, names: DataFrame) -> DataFrame:
        """name, words, counts for each row of names (name): all words of pages that the name holds.

        Names are known by a hash: of two with the same one, each is given the words of both, which changes no split.
        """
        sizes = self.sizes

        def parts(frames):
            every = ((key, part) for f in frames for key, x in zip(f["key"], f["name"], strict=True) for n in sizes for part in {x[i : i + n] for i in range(len(x) - n + 1)})
            for some in batched(every, BATCH_PARTS):
                yield pd.DataFrame(some, columns=["key", "word"])

        keyed = names.select("name", F.xxhash64("name").alias("key"))
        held = keyed.repartition(1 + names.count() // TASK_NAMES).mapInPandas(parts, "key long, word string")
        # Neither side has a known bound: the hints keep Spark from broadcasting one.
        held = held.join(self.words.hint("merge"), "word").groupBy("key").agg(F.collect_list("word").alias("words"), F.collect_list("count").alias("counts"))
        every = keyed.join(held.hint("merge"), "key", "left")
        return every.select("name", F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.coalesce("counts", F.array().cast("array<long>")).alias("counts"))


def train(words: PageWords) -> UrlModel:
    """The model of the labelled URLs, split by the words of all pages; only those that their names hold reach the driver."""
    names = {x for host, path, _ in labelled_urls() for x in url_names(host, path)} | {*BLOCK_WORDS, *ALLOW_WORDS, *COMMON_WORDS, *PARTS}
    own = cut(words.words.sparkSession.createDataFrame([(x,) for x in sorted(names)], "name string"))
    known = words.inside(own).select(F.explode(F.arrays_zip("words", "counts")).alias("k")).select("k.*").distinct().collect()
    return UrlModel({r["words"]: r["counts"] for r in known}, total=words.total)


def split_names(urls: DataFrame, words: PageWords, model: UrlModel) -> DataFrame:
    """key, names, splits (words with spaces between) for each key of urls (key, host, path) whose URLs have names."""

    @F.pandas_udf("array<string>")
    def names(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([url_names(h, p) for h, p in zip(host, path, strict=True)])

    @F.pandas_udf("string")
    def split(name: pd.Series, known: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([" ".join(model.segment(x, dict(zip(w, c, strict=True)))) for x, w, c in zip(name, known, counts, strict=True)])

    pairs = cut(urls.select("key", F.explode(names("host", "path")).alias("name")).distinct())
    splits = words.inside(cut(pairs.select("name").distinct())).select("name", split("name", "words", "counts").alias("split"))
    return pairs.join(splits.hint("merge"), "name").groupBy("key").agg(F.collect_list("name").alias("names"), F.collect_list("split").alias("splits"))


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if null or without ://."""
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules=RULES, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score for each row of pages (page_id, url).

    A rule (host, path, verdict) fits its host and all below it if the path begins with the rule's;
    the longest rule (host and path together, then the greater text) decides. Without a rule the
    verdict is block if the naive Bayes log odds of the segmented host and path words exceed 0.
    A null url or one without :// has an empty host and path and the verdict of no words. Urls of any
    length are judged whole. Repeated rows give repeated results; an empty table gives none. Other
    columns are not read but html, if there is one and no model is given, for the words that names are split by.
    """
    known = PageWords(pages) if model is None and "html" in pages.columns else None
    model = model or (train(known) if known else default_model())
    own = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, v).otherwise(verdict)

    def judged(words: list[list[str]]) -> pd.DataFrame:
        return pd.DataFrame({"words": words, "score": [model.score(w) for w in words]})

    @F.pandas_udf("words array<string>, score double")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        return judged([model.tokens(h, p) for h, p in zip(host, path, strict=True)])

    @F.pandas_udf("words array<string>, score double")
    def judge_split(host: pd.Series, path: pd.Series, names: pd.Series, splits: pd.Series) -> pd.DataFrame:
        words = []
        for h, p, n, s in zip(host, path, names, splits, strict=True):
            split = {} if n is None else dict(zip(n, s, strict=True))
            words.append([w for x in url_names(h, p) for w in split[x].split(" ")])
        return judged(words)

    rows = own.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    if known:
        # URLs with the same key share their names' splits, which are the same for all URLs.
        key = F.xxhash64("host", "path").alias("key")
        splits = split_names(own.select("host", "path", key), known, model)
        rows = rows.select("*", key).join(splits.hint("merge"), "key", "left").withColumn("j", judge_split("host", "path", "names", "splits"))
    else:
        rows = rows.withColumn("j", judge("host", "path"))
    method = F.when(F.col("j.score") > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "j.words", "j.score")
