"""What the corpus operators share: the shared folder, word boundaries and word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of anything but space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new temporary
    folder is put into the session, but only in local mode (tests): executors elsewhere would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="barsmith-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back with its own schema: cuts the lineage at data
    that outlive any executor, and fixes values that a second run of the plan could change."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(batches: Iterable[pd.DataFrame], rows: int = 256, col: str | None = None, size: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """The batches in parts of so many rows, and of about so many letters in column col (a longer text is a part by
    itself), so that what Python makes of whole texts stays small."""
    for batch in batches:
        if col is None:
            cuts = [*range(0, len(batch), rows), len(batch)]
        else:
            cuts, letters = [0], 0
            for i, text in enumerate(batch[col]):
                here = len(text) if text else 0
                if i > cuts[-1] and (i - cuts[-1] >= rows or letters + here > size):
                    cuts.append(i)
                    letters = 0
                letters += here
            cuts.append(len(batch))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.iloc[a:b]


def batches_of(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that one batch takes to Python at most: whole texts of 10,000 rows, the default, fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) <= 0 or int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def mix(x: np.ndarray) -> np.ndarray:
    """The murmur3 finaliser, element by element."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


#: Odd bases of the two polynomial word hashes, and one random odd 64-bit value for each byte and hash.
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_BYTES = mix(np.arange(512, dtype=np.uint64) * _STEP + np.uint64(12345)).reshape(2, 256) | np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in UTF-8 bytes (all blanks are ASCII, so bytes suffice)."""
    word = np.empty(len(data) + 2, dtype=bool)
    word[0] = word[-1] = False
    np.logical_not(_BLANK[data], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[0::2], edges[1::2]


#: Words that are hashed in one step.
_STRIDE = 1 << 16


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; two independent ones are to be had by which = 0 and 1."""
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    size = ends - starts
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max()) - 1, _BASES[which])]))
    table = _BYTES[which]
    for at in range(0, len(starts), _STRIDE):  # over all letters of so many words at once
        n = size[at:at + _STRIDE]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        letters = data[np.repeat(starts[at:at + _STRIDE], n) + place]
        out[at:at + _STRIDE] = np.add.reduceat(table[letters] * powers[place], first)
    return mix(out ^ (size.astype(np.uint64) * _STEP))


def runs(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """The hash of every n consecutive words."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(hashes) - n + 1
    out = np.full(m, np.uint64(salt), dtype=np.uint64)
    for k in range(n):
        out = (out + hashes[k:k + m]) * _STEP
        out ^= out >> np.uint64(29)
    return mix(out)
