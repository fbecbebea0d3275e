"""Substring deduplication: windows of words that start in an earlier document, with a count-min prefilter.

The sketch has one row of cells, 16 for each window of the corpus, and is cut into blocks of 2**24 cells.
Rows of a table travel in chunks of about CHUNK documents:

1. each chunk sketches its windows: to every block go the cells that it has hit;
2. a block merges the partition sketches of all chunks and answers each chunk with those of its cells whose
   merged count is at least 2. Counts are never too low, so no repeated window is lost; a window that shares
   a cell by chance comes along and is sorted out by the next step;
3. each chunk sends its windows in such cells (128-bit hashes of the word sequence, once per chunk with the
   chunk's smallest document) to their block, which groups them exactly and answers with one bit: does the
   window start in a smaller document elsewhere?
4. each chunk marks its covered words.

What is held in one task is a chunk, or a block's share of all chunks; a window that stands in very many
documents is pre-aggregated to one entry for each chunk. The sketch grows with the corpus but is never
broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.common import batches_of, runs, small, word_hashes, word_spans, written

WINDOW = 13
#: Documents of a chunk; cells of the sketch for each window; bits of a cell's number inside its block.
CHUNK, CELLS, BLOCK_BITS = 2000, 16, 24
#: Bytes of text that one word takes at least, on average, for the size of the sketch.
WORD_BYTES = 6

PACKED = "chunk long, ids binary, known binary, sizes binary, blob binary"


def pack(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, chunk) as compressed parts of chunks."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in small(batches, CHUNK, "text"):
            for chunk, part in batch.groupby("chunk", sort=False):
                texts = [(t or "").encode() for t in part["text"]]
                known = part["doc_id"].notna().to_numpy()
                yield pd.DataFrame({
                    "chunk": [chunk], "ids": [part["doc_id"].fillna(0).to_numpy(dtype=np.int64).tobytes()], "known": [known.tobytes()],
                    "sizes": [np.array([len(t) for t in texts], dtype=np.int64).tobytes()], "blob": [press.compress(b"".join(texts))],
                })

    return docs.select("doc_id", "text", "chunk").mapInPandas(run, PACKED)


def unpack(parts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in parts["ids"]])
    known = np.concatenate([np.frombuffer(x, dtype=bool) for x in parts["known"]])
    texts: list[bytes] = []
    for sizes, blob in zip(parts["sizes"], parts["blob"], strict=True):
        data, at = zstandard.ZstdDecompressor().decompress(blob), 0
        for n in np.frombuffer(sizes, dtype=np.int64).tolist():
            texts.append(data[at:at + n])
            at += n
    return ids, known, texts


@dataclass
class Windows:
    """Windows of a chunk: document place, first word, two hashes; and the words."""

    doc: np.ndarray
    word: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    word_doc: np.ndarray


def windows_of(texts: list[bytes], known: np.ndarray, n: int) -> Windows:
    data = b"\n".join(texts)
    buffer = np.frombuffer(data, dtype=np.uint8)
    starts, ends = word_spans(buffer)
    firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    word_doc = np.searchsorted(firsts, starts, side="right") - 1
    h1, h2 = (runs(word_hashes(buffer, starts, ends, i), n, i) for i in (0, 1))
    whole = np.flatnonzero((word_doc[n - 1:] == word_doc[:len(h1)]) & known[word_doc[:len(h1)]]) if len(h1) else np.empty(0, dtype=np.int64)
    return Windows(word_doc[whole], whole, h1[whole], h2[whole], data, starts, ends, word_doc)


def cells_of(h1: np.ndarray, bits: int) -> np.ndarray:
    """Cell of the whole sketch, which has 2**bits blocks."""
    return (h1 >> np.uint64(64 - BLOCK_BITS - bits)).astype(np.int64)


def put(cells: np.ndarray) -> bytes:
    """Sorted distinct cells of a block: how many have each upper byte, then the two lower ones."""
    low = (cells & 0xFFFF).astype(np.uint16).tobytes()
    if len(cells) < 512:
        return b"\x00" + (cells & 0xFFFFFF).astype(np.uint32).tobytes()
    return b"\x01" + np.bincount((cells >> 16) & 0xFF, minlength=256).astype(np.uint32).tobytes() + low


def get(packed: bytes) -> np.ndarray:
    if packed[:1] == b"\x00":
        return np.frombuffer(packed, dtype=np.uint32, offset=1).astype(np.int64)
    high = np.repeat(np.arange(256, dtype=np.int64), np.frombuffer(packed, dtype=np.uint32, count=256, offset=1))
    return (high << 16) | np.frombuffer(packed, dtype=np.uint16, offset=1025).astype(np.int64)


def by_block(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks that sorted cells fall into, and where each begins (with the end)."""
    block = cells >> BLOCK_BITS
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.empty(0, dtype=np.int64)
    return block[first], np.append(first, len(block))


def sketches(docs: DataFrame, bits: int, n: int) -> DataFrame:
    """block, chunk, cells, twice: each chunk part's sketch by blocks; twice marks cells that two of its documents hit."""

    def run(batches):
        for batch in small(batches, CHUNK):
            for chunk, part in batch.groupby("chunk", sort=False):
                w = windows_of([(t or "").encode() for t in part["text"]], part["doc_id"].notna().to_numpy(), n)
                # one hit for each document with the id, so that only other documents make a window repeated
                _, doc = np.unique(part["doc_id"].fillna(0).to_numpy(dtype=np.int64), return_inverse=True)
                cells, doc = cells_of(w.h1, bits), doc[w.doc]
                order = np.lexsort((doc, cells))
                cells, doc = cells[order], doc[order]
                new = np.concatenate([[True], cells[1:] != cells[:-1]]) if len(cells) else np.empty(0, dtype=bool)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(cells)) - 1
                twice = doc[first] != doc[last] if len(first) else np.empty(0, dtype=bool)
                cells = cells[first]
                blocks, at = by_block(cells)
                yield pd.DataFrame({
                    "block": blocks, "chunk": chunk,
                    "cells": [put(cells[a:b]) for a, b in zip(at, at[1:], strict=False)],
                    "twice": [np.packbits(twice[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)],
                })

    return docs.select("doc_id", "text", "chunk").mapInPandas(run, "block long, chunk long, cells binary, twice binary")


def merge_sketches(group: pd.DataFrame) -> pd.DataFrame:
    """The block's merged counts (up to 2), and for each chunk those of its cells that reach 2."""
    count = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
    for cells, twice in zip(group["cells"], group["twice"], strict=True):
        at = get(cells)
        more = np.unpackbits(np.frombuffer(twice, dtype=np.uint8), count=len(at))
        count[at] = np.minimum(2, count[at] + 1 + more)
    found = [(c, at[count[at] >= 2]) for c, at in ((c, get(x)) for c, x in zip(group["chunk"], group["cells"], strict=True))]
    found = [(c, put(at)) for c, at in found if len(at)]
    return pd.DataFrame({"chunk": [c for c, _ in found], "block": int(group["block"].iloc[0]), "answer": [x for _, x in found]}).astype({"chunk": "int64"})


@dataclass
class Suspects:
    """Distinct windows of a chunk in repeated cells, in the order of their hashes: for each window
    occurrence its number among them, and for each of them its cell, second hash and smallest document."""

    occurrence: np.ndarray
    number: np.ndarray
    cell: np.ndarray
    h2: np.ndarray
    least: np.ndarray


def suspects_of(w: Windows, ids: np.ndarray, answers: pd.DataFrame, bits: int) -> Suspects:
    repeated = [int(b) << BLOCK_BITS | get(x) for b, x in zip(answers["block"], answers["answer"], strict=True)]
    repeated = np.unique(np.concatenate(repeated)) if repeated else np.empty(0, dtype=np.int64)
    cells = cells_of(w.h1, bits)
    at = np.searchsorted(repeated, cells)
    occurrence = np.flatnonzero(repeated[np.minimum(at, len(repeated) - 1)] == cells) if len(repeated) else np.empty(0, dtype=np.int64)
    h1, h2, doc = w.h1[occurrence], w.h2[occurrence], ids[w.doc[occurrence]]
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc = h1[order], h2[order], doc[order]
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(order) else np.empty(0, dtype=bool)
    first = np.flatnonzero(new)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return Suspects(occurrence, number, cells[occurrence][order][first], h2[first], doc[first])


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers as a base and offsets of 2, 4 or 8 bytes."""
    base = int(values.min())
    span = int(values.max()) - base
    kind = np.uint16 if span < 1 << 16 else np.uint32 if span < 1 << 32 else np.uint64
    return base, (values - base).astype(kind).tobytes()


def _send(bits: int, n: int):
    def send(parts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = {"block": [], "chunk": [], "low": [], "h2": [], "base": [], "least": []}
        if len(parts) and len(answers):
            ids, known, texts = unpack(parts)
            s = suspects_of(windows_of(texts, known, n), ids, answers, bits)
            blocks, at = by_block(s.cell)
            for block, a, b in zip(blocks, at, at[1:], strict=False):
                base, least = _narrow(s.least[a:b])
                row = int(block), int(parts["chunk"].iloc[0]), (s.cell[a:b] & 0xFFFF).astype(np.uint16).tobytes(), s.h2[a:b].tobytes(), base, least
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        return pd.DataFrame(out).astype({"block": "int64", "chunk": "int64", "base": "int64"})

    return send


def group_windows(group: pd.DataFrame) -> pd.DataFrame:
    """Exact groups of a block's windows; one bit for each that a chunk has sent: a smaller document has it too."""
    low = [np.frombuffer(x, dtype=np.uint16) for x in group["low"]]
    sizes = [len(x) for x in low]
    low, h2 = np.concatenate(low), np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in group["h2"]])
    kinds = {2: np.uint16, 4: np.uint32, 8: np.uint64}
    least = np.concatenate([np.frombuffer(x, dtype=kinds[len(x) // n]).astype(np.int64) + b for x, b, n in zip(group["least"], group["base"], sizes, strict=True)])
    order = np.lexsort((low, h2))
    new = np.concatenate([[True], (h2[order][1:] != h2[order][:-1]) | (low[order][1:] != low[order][:-1])])
    smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))
    bit = np.empty(len(order), dtype=bool)
    bit[order] = least[order] > smallest[np.cumsum(new) - 1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    answers = [np.packbits(bit[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)]
    return pd.DataFrame({"chunk": group["chunk"], "block": group["block"], "answer": answers})


def _cut(bits: int, n: int):
    def cut(parts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(parts):
            return pd.DataFrame({"doc_id": [], "n_words": [], "n_removed": [], "text": []})
        ids, known, texts = unpack(parts)
        w = windows_of(texts, known, n)
        removed = np.zeros(len(w.starts) + 1, dtype=np.int64)
        cells, bitmaps = answers[answers["kind"] == 0], answers[answers["kind"] == 1]
        if len(cells):
            s = suspects_of(w, ids, cells, bits)
            elsewhere = np.zeros(len(s.cell), dtype=bool)
            sent = dict(zip(bitmaps["block"], bitmaps["answer"], strict=True))
            blocks, at = by_block(s.cell)
            for block, a, b in zip(blocks, at, at[1:], strict=False):
                elsewhere[a:b] = np.unpackbits(np.frombuffer(sent[int(block)], dtype=np.uint8), count=b - a)
            again = elsewhere[s.number] | (ids[w.doc[s.occurrence]] > s.least[s.number])
            first = w.word[s.occurrence[again]]
            np.add.at(removed, first, 1)
            np.add.at(removed, first + n, -1)
        gone = np.cumsum(removed[:-1]) > 0
        n_words = np.bincount(w.word_doc, minlength=len(texts))
        n_gone = np.bincount(w.word_doc, weights=gone, minlength=len(texts)).astype(np.int64)
        ends = np.cumsum(n_words)
        kept = []
        for k, text in enumerate(texts):
            if n_gone[k]:
                at = np.arange(ends[k] - n_words[k], ends[k])[~gone[ends[k] - n_words[k]:ends[k]]]
                kept.append(b" ".join([w.data[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]).decode())
            else:
                kept.append(b" ".join(text.split()).decode())
        doc_id = pd.Series(ids, dtype="Int64").where(known)
        return pd.DataFrame({"doc_id": doc_id, "n_words": n_words.astype(np.int64), "n_removed": n_gone, "text": kept})

    return cut


def remove_repeated(docs: DataFrame, window: int = WINDOW, chunk=None) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words, joined by one space) of docs (doc_id, text).

    A word goes if a window of `window` consecutive words that covers it also starts, with the same words,
    in a document with a smaller doc_id; windows are judged on the input. chunk: a column that deals rows
    to chunks of about CHUNK documents and is the same whenever the plan runs; by default a hash of doc_id
    (a place in a file keeps neighbours together and travels better).

    Null text has no words. A document without an id neither loses words nor makes others lose them.
    Documents with the same id do not make each other lose words. Repeated rows come as often as they
    came. Other columns are not read; an empty table gives no rows.
    """
    batches_of(docs.sparkSession)
    n_docs, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = max(0, int(total // WORD_BYTES * CELLS - 1).bit_length() - BLOCK_BITS) if total else 0
    if chunk is None:
        chunk = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs // CHUNK)))
    rows = docs.select("doc_id", "text", chunk.cast("long").alias("chunk"))
    cells = written(sketches(rows, bits, window).groupBy("block").applyInPandas(merge_sketches, "chunk long, block long, answer binary"), "repeated-cells")
    packed = pack(rows)
    sent = packed.groupBy("chunk").cogroup(cells.groupBy("chunk")).applyInPandas(_send(bits, window), "block long, chunk long, low binary, h2 binary, base long, least binary")
    bitmaps = written(sent.groupBy("block").applyInPandas(group_windows, "chunk long, block long, answer binary"), "repeated-windows")
    answers = cells.withColumn("kind", F.lit(0)).unionByName(bitmaps.withColumn("kind", F.lit(1)))
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_cut(bits, window), "doc_id long, n_words long, n_removed long, text string")


def file_chunk(rows: int = CHUNK):
    """Chunks of so many neighbouring rows by place in the file, for tables read from files."""
    return F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document: edge cases as for remove_repeated()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", file_chunk().alias("place"))
    found = remove_repeated(docs, WINDOW, F.col("place"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = rf"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
numbered as (select row_number() over () as r, * from words),
windows as (
  select r, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as seq from numbered, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) as u(i)
  where doc_id is not null),
firsts as (select seq, min(doc_id) as least from windows group by seq having min(doc_id) < max(doc_id)),
again as (select r, i from windows join firsts using (seq) where doc_id > least),
gone as (select distinct r, i + k as j from again, unnest(range({WINDOW})) as t(k)),
gone_lists as (select r, list(j) as js, count(*) as n from gone group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, k: not list_contains(coalesce(js, []), k)), ' '), '')) as kept_sha256
from numbered left join gone_lists using (r)
"""
