"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch: texts of a batch are in memory several times, in the JVM and in Python.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input. The session's Arrow batches are made no larger than BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset in local mode (tests).

    Elsewhere an unset folder is an error: other hosts would not see a folder of this machine.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lathe-shared-")
        sc.setCheckpointDir(base)
    return base


def drop_cuts(spark: SparkSession) -> None:
    """Remove all tables that `cut` has written: for the end of a job, once its results are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lathe")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/lathe/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores put in front until it begins no column's name."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = "_" + name
    return name


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when full so that memory stays bounded."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """One hash for each run of k words, in order; with fewer words one for the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b"\x20".join(words), seed=k)], np.uint64)
    h = hashes.of(words)
    n = len(words) - k + 1
    acc = h[:n].copy()
    for j in range(1, k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix64(acc)
