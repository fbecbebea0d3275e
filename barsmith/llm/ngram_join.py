"""Jaccard self-join on word n-grams by multiple-global-order filtering, and the components of its links.

Texts with the same set are one node. A node's prefix under a global order of the n-grams is so long that
two nodes that link share a prefix n-gram, whatever the order; so candidates must share one under each of
ORDERS orders. All orders put n-grams that no other document has first (as a sketch that grows with the corpus
tells, which never takes a shared one for such) and those that a fixed-size sketch finds frequent last, and
differ in how they arrange n-grams of one frequency class. An n-gram of one document makes no candidates, so
such entries of a prefix are not even sent: most documents without near copies send nothing, at any size.

Only the components are asked for, so a group of near copies need not be spelt out into all its pairs:

1. every list of nodes with a prefix n-gram has leaders, that other nodes of the list are like as far as the
   parity bitmaps of the two sets tell. A node's best two leaders are verified and joined into components;
2. in lists that still hold several components, a node's most like one of another component is verified, a pair a
   node; again for up to ROUNDS rounds: nodes that link with many of a group, but with none of the leaders, join it;
3. in lists that even then hold several components, nodes of different components (and of compatible size) are
   held against each other inside the task: a pair leaves it only if the bitmaps leave a link possible. Pairs that share enough prefix n-grams for a link under every order are verified. A link
   between two nodes of one component changes nothing, every other link is among those pairs, so none is lost.

A long list is cut into parts of about PART nodes, and every two parts meet in a task of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.common import batches_of, mix, runs, small, word_hashes, word_spans, written
from barsmith.llm.substrings import BLOCK_BITS, by_block, file_chunk, get, merge_sketches, pack, put, unpack

N, PERCENT, ORDERS = 4, 85, 2
#: Documents of a chunk.
CHUNK = 1000
#: Cells of the frequency sketch: only the arrangement of n-grams depends on it, never a result.
SKETCH, SLICES = 1 << 22, 64
#: Prefix entries of a block of n-grams, about; hits of a sketch cell from which its n-grams' lists are dealt to
#: several blocks, each of about so many entries.
ENTRIES, HOT = 1 << 20, 1 << 18
#: Rows of lists that one task holds against each other, about; nodes of a part of a long list.
ROWS, PART = 1 << 16, 1 << 12
#: Leaders of a list at most; nodes without one are left to step 2.
LEADERS = 8
#: Rounds of step 2 at most; what they leave is left to step 3.
ROUNDS = 3
#: Cells of the growing sketch for each n-gram; bytes of text that one takes at least, on average.
CELLS, GRAM_BYTES = 8, 6
#: Documents that are asked for their sets by a broadcast list at most (16 bytes each); more go by a join.
FEW = 1 << 21
#: Bits of an n-gram's hash; bits of a set's parity bitmap.
GRAM_BITS, BITMAP = 64, 512
#: What a chunk gets: the set of a node, a pair whose other set is sent, a pair of its own.
SET, FAR, LOCAL = 0, 1, 2

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(document place, hash of GRAM_BITS bits) of all distinct n-grams, by document and hash; texts with fewer
    than n words have their whole sequence as the only one."""
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER), dtype=np.uint8)
    starts, ends = word_spans(data)
    firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    count = np.diff(np.searchsorted(starts, firsts))
    words = word_hashes(data, starts, ends)
    grams = runs(words, n)
    first = np.cumsum(count) - count
    value = np.empty(int(np.where(count >= n, count - n + 1, np.minimum(count, 1)).sum()), dtype=np.uint64)
    doc = np.empty(len(value), dtype=np.int64)
    at = 0
    for i in np.flatnonzero(count):  # sorted one by one: short arrays, and no bits of the hash given up for the place
        a, k = int(first[i]), int(count[i])
        own = np.sort(grams[a:a + k - n + 1]) if k >= n else runs(words[a:a + k], k, k)
        value[at:at + len(own)], doc[at:at + len(own)] = own, i
        at += len(own)
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
        doc, value = doc[new], value[new]
    return doc, value


def nodes_of(docs: np.ndarray, values: np.ndarray, n_docs: int, clashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit id of each document's set, 64 bits more (from two sums over its members), and its size.

    clashes: ids that sets of different second halves share; such sets take an id made of both halves, as
    renamed() gives it.
    """
    size = np.bincount(docs, minlength=n_docs)
    at = np.concatenate([[0], np.cumsum(size)])
    sums = []
    for salt in (0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(salt)))])
        sums.append(mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)))
    node, half = sums[0].astype(np.int64), sums[1].astype(np.int64)
    return node if clashes is None else told_apart(node, half, clashes), half, size


def told_apart(node: np.ndarray, half: np.ndarray, clashes: np.ndarray) -> np.ndarray:
    """The ids of sets, those among clashes replaced."""
    node = node.copy()
    for i in np.flatnonzero(np.isin(node, clashes)):
        seed = xxhash.xxh64_intdigest(node[i].tobytes(), seed=42)
        node[i] = np.uint64(xxhash.xxh64_intdigest(half[i].tobytes(), seed=seed)).astype(np.int64)
    return node


def renamed():
    """The id that told_apart() gives a set whose first 64 bits another set has too."""
    return F.xxhash64("node", "half")


def bitmaps_of(docs: np.ndarray, values: np.ndarray, n_docs: int) -> list[bytes]:
    """For every document which of BITMAP cells an odd number of its n-grams hit. Two bitmaps differ in no
    more bits than the two sets in members."""
    cell = docs * BITMAP + (mix(values) & np.uint64(BITMAP - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n_docs * BITMAP) & 1).astype(bool).reshape(n_docs, BITMAP)
    return [x.tobytes() for x in np.packbits(odd, axis=1)]


def most_different(size_a, size_b, percent: int):
    """In how many members two sets differ at most if they link."""
    return (100 - percent) * (size_a + size_b) // (100 + percent)


def _chunks(batches):
    """(chunk, ids, texts) of each part of a chunk."""
    for batch in small(batches, CHUNK, "text"):
        for chunk, part in batch.groupby("chunk", sort=False):
            yield chunk, part["doc_id"], [(t or "").encode() for t in part["text"]]


SIGNED = "doc_id long, chunk long, key long, node long, half long, size long, bitmap binary, slice int, counts binary"


def signed(rows: DataFrame, n: int) -> DataFrame:
    """For every row doc_id, chunk, key (a hash of the text), node, half, size, bitmap; and for every task, in
    rows of their own, the slices of its frequency sketch: hits of the cells, compressed."""

    def run(batches):
        count = np.zeros(SKETCH, dtype=np.uint32)
        for chunk, ids, texts in _chunks(batches):
            docs, values = shingle_sets(texts, n)
            node, half, size = nodes_of(docs, values, len(texts))
            cells, hits = np.unique(cells_of(values), return_counts=True)
            count[cells] += hits.astype(np.uint32)
            yield pd.DataFrame({
                "doc_id": ids.astype("Int64").to_numpy(dtype=object, na_value=None), "chunk": chunk, "key": keys_of(texts), "node": node, "half": half,
                "size": size.astype(np.int64), "bitmap": bitmaps_of(docs, values, len(texts)), "slice": None, "counts": None,
            })
        press = zstandard.ZstdCompressor(level=1)
        kind = np.uint8 if count.max() < 256 else np.uint32
        parts = [press.compress(part.astype(kind).tobytes()) for part in count.reshape(SLICES, -1)] if count.any() else []
        yield pd.DataFrame({"slice": range(len(parts)), "counts": parts}).reindex(columns=[c.split()[0] for c in SIGNED.split(", ")]).astype(object).where(lambda x: x.notna(), None)

    return rows.mapInPandas(run, SIGNED)


def keys_of(texts: list[bytes]) -> np.ndarray:
    """text_key() of these texts."""
    return np.array([xxhash.xxh64_intdigest(t, seed=42) for t in texts], dtype=np.uint64).astype(np.int64)


def text_key():
    """A 64-bit hash of the text, null as the empty one."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def cells_of(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(SKETCH - 1)).astype(np.int64)


def frequency_classes(slices: DataFrame) -> tuple[np.ndarray, float]:
    """For each cell of the sketch how many times, as a power of 2, it is hit more often than the mean cell,
    and what counts as that. The hits stay with the tasks: only their median and the classes, packed, reach the driver."""
    width = SKETCH // SLICES

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, dtype=np.int64)
        for x in group["counts"]:
            data = zstandard.ZstdDecompressor().decompress(x)
            total += np.frombuffer(data, dtype=np.uint8 if len(data) == width else np.uint32)
        return pd.DataFrame({"slice": [int(group["slice"].iloc[0])], "counts": [zstandard.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})

    def hits(batch: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(zstandard.decompress(x), dtype=np.uint32) for x in batch["counts"]]

    def spread(batches):
        for batch in small(batches, 1):
            hit, cells = np.unique(hits(batch)[0], return_counts=True)
            yield pd.DataFrame({"hit": hit.astype(np.int64), "cells": cells})

    sums = written(slices.groupBy("slice").applyInPandas(add, "slice int, counts binary"), "sketch")
    met = sums.mapInPandas(spread, "hit long, cells long").groupBy("hit").agg(F.sum("cells").alias("cells"))
    middle = met.agg(F.percentile("hit", 0.5, F.col("cells"))).first()[0]
    if middle is None:  # no n-grams at all
        return np.zeros(SKETCH, dtype=np.uint8), 1.0
    middle = np.float32(middle)
    floor = max(1.0, float(middle) + 3 * float(np.sqrt(middle)))

    def classes(batches):
        for batch in small(batches, 1):
            above = np.ceil(np.log2(np.maximum(hits(batch)[0].astype(np.float32) / floor, 1)))
            yield pd.DataFrame({"slice": batch["slice"], "classes": [zstandard.compress(above.astype(np.uint8).tobytes(), 1)]})

    out = np.zeros(SKETCH, dtype=np.uint8)
    for p in sums.mapInPandas(classes, "slice int, classes binary").collect():  # a byte for each of SKETCH cells, packed
        out[p["slice"] * width:(p["slice"] + 1) * width] = np.frombuffer(zstandard.decompress(p["classes"]), dtype=np.uint8)
    return out, floor


def least_overlap(size: np.ndarray, percent: int) -> np.ndarray:
    return (percent * size + 99) // 100


def least_shared(size_a, size_b, percent: int):
    """How many prefix n-grams two linked nodes share at least under any one order.

    Say a's prefix ends first in that order. What the two have in common lies in both prefixes or in a behind its
    prefix, where it has least_overlap(size) - 1 n-grams; if b's ends first, likewise. A link needs
    percent / (100 + percent) of both sizes in common.
    """
    common = F.floor((percent * (size_a + size_b) + 99 + percent) / (100 + percent))
    behind = F.floor((percent * F.greatest(size_a, size_b) + 99) / 100) - 1
    return F.greatest(common - behind, F.lit(1))


def shared_cells(rows: DataFrame, bits: int, n: int) -> DataFrame:
    """chunk, block, answer: for every chunk those cells of the growing sketch (of 2**bits blocks) that documents of
    other chunks, or two of its own, hit too."""

    def run(batches):
        for chunk, _, texts in _chunks(batches):
            _, values = shingle_sets(texts, n)
            cells = np.sort((values >> np.uint64(GRAM_BITS - BLOCK_BITS - bits)).astype(np.int64))
            new = np.concatenate([[True], cells[1:] != cells[:-1]]) if len(cells) else np.empty(0, dtype=bool)
            first = np.flatnonzero(new)
            twice = np.diff(np.append(first, len(cells))) > 1
            cells = cells[first]
            blocks, at = by_block(cells)
            yield pd.DataFrame({
                "block": blocks, "chunk": chunk,
                "cells": [put(cells[a:b]) for a, b in zip(at, at[1:], strict=False)], "twice": [np.packbits(twice[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)],
            })

    found = rows.mapInPandas(run, "block long, chunk long, cells binary, twice binary")
    return found.groupBy("block").applyInPandas(merge_sketches, "chunk long, block long, answer binary")


def prefixes(packed: DataFrame, answers: DataFrame, cell_bits: int, classes: np.ndarray, floor: float, bits: int, percent: int, n: int) -> DataFrame:
    """Prefix entries of each chunk's nodes under each order that other documents may share, by blocks of n-grams.
    answers: what shared_cells() gives, and the chunk's clashing ids of sets as rows of their own (clash).
    Entries of n-grams in cells with more than HOT hits go, by node, to one of as many blocks more as keep a
    block's share at HOT."""
    known = packed.sparkSession.sparkContext.broadcast(classes)  # one byte for each of SKETCH cells
    hot_from = max(1, int(np.ceil(np.log2(max(HOT / floor, 1)))))
    names = ["ord", "block", "grams", "places", "nodes", "sizes"]

    def entries(texts: list[bytes], shared: np.ndarray, clashes: np.ndarray, out: list) -> None:
        doc, value = shingle_sets(texts, n)
        node, _, size = nodes_of(doc, value, len(texts), clashes)
        once = np.zeros(len(texts), dtype=bool)
        once[np.unique(node, return_index=True)[1]] = True
        keep = once[doc]
        doc, value = doc[keep], value[keep]
        cell = (value >> np.uint64(GRAM_BITS - BLOCK_BITS - cell_bits)).astype(np.int64)
        met = shared[np.minimum(np.searchsorted(shared, cell), len(shared) - 1)] == cell if len(shared) else np.zeros(len(cell), dtype=bool)
        rank = known.value[cells_of(value)]
        block = (mix(value) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(value), dtype=np.int64)
        hot = np.flatnonzero(rank >= hot_from)
        if len(hot):
            share = np.left_shift(np.int64(1), np.minimum(rank[hot].astype(np.int64) - hot_from + 1, 30))
            block[hot] = -1 - (block[hot] << 30 | (mix(node[doc[hot]].astype(np.uint64)).astype(np.int64) & (share - 1)))
        first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
        longest = size - least_overlap(size, percent) + 1
        rank = np.where(met, np.minimum(rank, 254) + 1, 0)
        for order in range(ORDERS):
            # document, class and a random number under that order, in one number each
            by = np.argsort(doc.astype(np.uint64) << np.uint64(48) | rank.astype(np.uint64) << np.uint64(40) | mix(value ^ np.uint64(0x51ED270B * (order + 1))) >> np.uint64(24))
            inside = np.arange(len(by)) - first[doc[by]] < longest[doc[by]]
            at = by[inside]
            at = at[met[at]]
            if not len(at):
                continue
            at = at[np.argsort(block[at], kind="stable")]
            cuts = np.flatnonzero(np.concatenate([[True], block[at][1:] != block[at][:-1]]))
            for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
                used, place = np.unique(doc[at[a:b]], return_inverse=True)
                out.append((order, int(block[at[a]]), value[at[a:b]].tobytes(), place.astype(np.uint16).tobytes(), node[used].tobytes(), size[used].astype(np.uint32).tobytes()))

    def run(parts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        clashes = answers["clash"].dropna().to_numpy(dtype=np.int64) if len(answers) else np.empty(0, dtype=np.int64)
        answers = answers[answers["answer"].notna()]
        shared = [int(b) << BLOCK_BITS | get(x) for b, x in zip(answers["block"], answers["answer"], strict=True)]
        shared = np.unique(np.concatenate(shared)) if shared else np.empty(0, dtype=np.int64)
        for i in range(len(parts) if len(shared) else 0):
            entries(unpack(parts.iloc[i:i + 1])[2], shared, clashes, out)
        return pd.DataFrame(out, columns=names)

    met = packed.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return met.applyInPandas(run, "ord int, block long, grams binary, places binary, nodes binary, sizes binary")


def prefix_lists(group: pd.DataFrame) -> pd.DataFrame:
    """Lists of the block with at least two nodes, by size: equal lists once, with how many there are. Of a hot
    n-gram, whose list lies in several blocks, all is sent, lists of one node too."""
    hot = int(group["block"].iloc[0]) < 0
    gram, node, size = [], [], []
    for g, p, n, s in zip(group["grams"], group["places"], group["nodes"], group["sizes"], strict=True):
        place = np.frombuffer(p, dtype=np.uint16)
        gram.append(np.frombuffer(g, dtype=np.uint64))
        node.append(np.frombuffer(n, dtype=np.int64)[place])
        size.append(np.frombuffer(s, dtype=np.uint32)[place].astype(np.int64))
    gram, node, size = np.concatenate(gram), np.concatenate(node), np.concatenate(size)
    order = np.lexsort((node, gram))
    gram, node, size = gram[order], node[order], size[order]
    fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])])
    gram, node, size = gram[fresh], node[fresh], size[fresh]
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    length = np.diff(np.append(start, len(gram)))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(node.astype(np.uint64)))])
    content = total[start + length] - total[start]
    content = np.where(length > 1, content ^ length.astype(np.uint64), np.uint64(0))
    weight = np.ones(len(start), dtype=np.int64)
    chosen = np.ones(len(start), dtype=bool)
    if not hot:
        _, one, which, weight = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
        weight = weight[which]
        chosen[:] = False
        chosen[one] = True
        chosen &= length > 1
    keep = np.repeat(chosen, length)
    gram, node, size, weight = gram[keep], node[keep], size[keep], np.repeat(weight, length)[keep]
    return pd.DataFrame({"ord": int(group["ord"].iloc[0]), "list": gram.astype(np.int64), "weight": weight.astype(np.int64), "node": node, "size": size})


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that the edges (a, b) reach, for every node on an edge.

    Every node hooks itself to its smallest smaller neighbour, pointers are doubled until they end at
    roots, edges move up to the roots, and so on until no edge is left. Each step is a table in the
    shared folder; nothing is gathered on the driver but counts.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = written(both(edges.where("a <> b")).distinct(), "edges")
    labels = None
    while True:
        hooks = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
        hooks = written(hooks, "hooks")
        while True:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("root"))
            hooks = written(hooks.join(up, "label").select("node", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("moved")), "hooks")
            moved = hooks.where("moved").limit(1).count()
            hooks = hooks.drop("moved")
            if not moved:
                break
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("root"))
            labels = written(labels.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("label").alias(f"root_{c}"))
        left = left.join(to("a"), "a").join(to("b"), "b").where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
        left = written(left, "edges")
        if not left.limit(1).count():
            return labels


def _fetch(n: int):
    """The sets of the nodes that a chunk is asked for."""

    def fetch(parts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        texts = _texts(parts, asked["key"])
        place = {k: i for i, k in enumerate(texts)}
        doc, value = shingle_sets(list(texts.values()), n)
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        sets = [value[at[place[k]]:at[place[k] + 1]].tobytes() for k in asked["key"]]
        return pd.DataFrame({"node": asked["node"].to_numpy(dtype=np.int64), "shingles": sets})

    return fetch


def _texts(parts: pd.DataFrame, keys) -> dict[int, bytes]:
    """The texts of a chunk with these keys."""
    wanted, out = set(map(int, keys)), {}
    for i in range(len(parts) if wanted else 0):
        _, _, texts = unpack(parts.iloc[i:i + 1])
        out |= {k: t for k, t in zip(keys_of(texts).tolist(), texts, strict=True) if k in wanted}
    return out


def _compare(percent: int, n: int):
    """Of the pairs (a, b) whose b lives in the chunk those that link; a's set has come by mail or lives there too."""

    def compare(parts: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
        pairs, sent = mail[mail["kind"] != SET], mail[mail["kind"] == SET]
        texts = _texts(parts, [*pairs["key_b"], *pairs["key_a"][pairs["kind"] == LOCAL]])
        place = {k: i for i, k in enumerate(texts)}
        doc, value = shingle_sets(list(texts.values()), n)
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        own = lambda k: value[at[place[k]]:at[place[k] + 1]]
        far = dict(zip(sent["a"], sent["shingles"], strict=True))
        linked = []
        for kind, a, b, key_a, key_b in zip(pairs["kind"], pairs["a"], pairs["b"], pairs["key_a"], pairs["key_b"], strict=True):
            x, y = own(key_a) if kind == LOCAL else np.frombuffer(far[a], dtype=np.uint64), own(key_b)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                linked.append((a, b))
        return pd.DataFrame(linked, columns=["a", "b"]).astype("int64")

    return compare


def verified(pairs: DataFrame, rows: DataFrame, homes: DataFrame, percent: int, n: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes that link: percent * union <= 100 * intersection.

    Of every pair the node with more pairs travels to the chunk of the other one. A node's set leaves its chunk
    once, and goes on once to each chunk that needs it. Only texts that pairs need are packed.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ends = degree.join(homes.select("node", "chunk", "key"), "node")
    end = lambda c: ends.select(F.col("node").alias(c), F.struct(F.col("degree").alias("degree"), F.col("node").alias("node"), F.col("chunk").alias("chunk"), F.col("key").alias("key")).alias(f"end_{c}"))
    met = pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b").select(F.greatest("end_a", "end_b").alias("far"), F.least("end_a", "end_b").alias("near"))
    met = written(met.select(
        F.col("far.node").alias("a"), F.col("near.node").alias("b"), F.col("near.chunk").alias("chunk"), F.col("far.chunk").alias("home"), F.col("far.key").alias("key_a"), F.col("near.key").alias("key_b")), "pairs")
    wanted = written(met.select("chunk", F.col("key_b").alias("key")).union(met.select("home", "key_a")).distinct(), "wanted")
    few = wanted.count() <= FEW
    packed = pack(rows.withColumn("key", text_key()).join(F.broadcast(wanted) if few else wanted, ["chunk", "key"], "left_semi"))
    needs = met.where("home <> chunk").select(F.col("home"), F.col("a").alias("node"), F.col("key_a").alias("key"), "chunk").distinct()
    asked = needs.select(F.col("home").alias("chunk"), "node", "key").distinct()
    sets = packed.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInPandas(_fetch(n), "node long, shingles binary")
    none = F.lit(0).cast("long")  # no nulls: pandas would make doubles of the column
    sent = needs.select("node", "chunk").join(sets, "node").select("chunk", F.lit(SET).alias("kind"), F.col("node").alias("a"), none.alias("b"), none.alias("key_a"), none.alias("key_b"), "shingles")
    kind = F.when(F.col("home") == F.col("chunk"), F.lit(LOCAL)).otherwise(F.lit(FAR))
    mail = met.select("chunk", kind.alias("kind"), "a", "b", "key_a", "key_b", F.lit(b"").alias("shingles")).unionByName(sent)
    return packed.groupBy("chunk").cogroup(mail.groupBy("chunk")).applyInPandas(_compare(percent, n), "a long, b long")


class Lists:
    """The lists of a task: rows by list and size; of a long list two parts (x, y) meet, pairs inside them not counted."""

    def __init__(self, group: pd.DataFrame) -> None:
        group = group.sort_values(["list", "x", "y", "size", "node"], kind="stable", ignore_index=True)
        self.part, self.node, self.size, self.weight, self.x, self.y = (group[c].to_numpy(dtype=np.int64) for c in ("part", "node", "size", "weight", "x", "y"))
        self.label = group["label"].to_numpy(dtype=np.int64) if "label" in group else self.node
        self.bits = np.frombuffer(b"".join(group["bitmap"]), dtype=np.uint64).reshape(len(group), -1)
        new = np.zeros(len(group), dtype=bool)
        for c in ("list", "x", "y"):
            new[1:] |= group[c].to_numpy()[1:] != group[c].to_numpy()[:-1]
        self.list = np.cumsum(new)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Rows of different components that meet here."""
        return (self.label[i] != self.label[j]) & ((self.x[i] == self.y[i]) | (self.part[i] != self.part[j]))

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The fewest members in which the two sets differ."""
        return np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1, dtype=np.int64)

    def meeting(self, percent: int):
        """Rows (i, j) of a list that are apart and may link by size and bitmap, with how they differ, a few at a time."""
        size, rows = self.size, np.arange(len(self.size))
        place = self.list << 32
        last = np.searchsorted(place | size, place | np.minimum(100 * size // percent, (1 << 32) - 1), side="right")
        reach = last - rows - 1
        for first, end in _spans(reach):
            i = np.repeat(rows[first:end], reach[first:end])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(reach[first:end]) - reach[first:end], reach[first:end])
            ok = self.apart(i, j)
            i, j = i[ok], j[ok]
            differ = self.differ(i, j)
            ok = differ <= most_different(size[i], size[j], percent)
            yield i[ok], j[ok], differ[ok]


def _leaders(percent: int):
    """Likely links (node, leader, differ): in every list the first node that no leader may link with becomes a
    leader, whom all nodes of the list that may link with it follow; so again for a few rounds."""

    def leaders(group: pd.DataFrame) -> pd.DataFrame:
        t = Lists(group)
        by = np.lexsort((mix(t.node.astype(np.uint64)), t.list))  # the order is the same in all lists
        free = np.ones(len(by), dtype=bool)
        out = []
        for _ in range(LEADERS):
            at = by[free[by]]
            if not len(at):
                break
            lists, first = np.unique(t.list[at], return_index=True)
            leader = np.full(int(t.list[-1]) + 1, -1)
            leader[lists] = at[first]
            free[at[first]] = False
            row = np.flatnonzero(leader[t.list] >= 0)
            to = leader[t.list[row]]
            ok = t.apart(row, to) & (100 * np.minimum(t.size[row], t.size[to]) >= percent * np.maximum(t.size[row], t.size[to]))
            row, to = row[ok], to[ok]
            differ = t.differ(row, to)
            ok = differ <= most_different(t.size[row], t.size[to], percent)
            row, to, differ = row[ok], to[ok], differ[ok]
            free[row] = False
            out.append(pd.DataFrame({"node": t.node[row], "leader": t.node[to], "differ": differ}))
        return pd.concat(out).drop_duplicates(["node", "leader"]).astype("int64")

    return leaders


def _across(percent: int):
    """Pairs of a task's lists whose nodes are of different components and may link by size and bitmap, and how
    many prefix n-grams they share there."""

    def across(group: pd.DataFrame) -> pd.DataFrame:
        t = Lists(group)
        size = t.size
        i, j = np.concatenate([np.empty((2, 0), dtype=np.int64), *(np.stack(x[:2]) for x in t.meeting(percent))], axis=1)
        a, b = np.minimum(t.node[i], t.node[j]), np.maximum(t.node[i], t.node[j])
        by = np.lexsort((b, a))
        a, b, i, j = a[by], b[by], i[by], j[by]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, dtype=np.int64)
        shared = np.add.reduceat(t.weight[i], start) if len(a) else np.empty(0, dtype=np.int64)
        i, j = i[start], j[start]
        return pd.DataFrame({"ord": int(group["ord"].iloc[0]), "a": a[start], "b": b[start], "sizes": size[i] + size[j], "larger": np.maximum(size[i], size[j]), "shared": shared}).astype({"ord": "int32"})

    return across


def _nearest(percent: int):
    """For each node of a task's lists the one of another component that is most like it by the bitmaps (node, other, differ)."""

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        t = Lists(group)
        best, to = np.full(len(t.node), np.iinfo(np.int64).max), np.full(len(t.node), -1)
        for i, j, differ in t.meeting(percent):
            for x, y in ((i, j), (j, i)):
                by = np.lexsort((differ, x))
                row, first = np.unique(x[by], return_index=True)
                at = by[first]
                ok = differ[at] < best[row]
                best[row[ok]], to[row[ok]] = differ[at[ok]], y[at[ok]]
        row = np.flatnonzero(to >= 0)
        found = pd.DataFrame({"node": t.node[row], "other": t.node[to[row]], "differ": best[row]})
        return found.sort_values(["node", "differ", "other"]).drop_duplicates("node").astype("int64")

    return nearest


def _spans(reach: np.ndarray, most: int = 1 << 20):
    """Runs of rows which have about so many pairs in all."""
    first, total = 0, np.cumsum(reach)
    while first < len(reach):
        before = total[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(total, before + most, side="right")))
        yield first, end
        first = end


def dealt(lists: DataFrame) -> DataFrame:
    """Lists with their number n of nodes as rows of tasks: a long list in parts, of which every two meet in a task."""
    lists = written(lists, "dealt-lists")
    parts = F.floor((F.col("n") - 1) / PART) + 1
    rows = lists.withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other")).drop("other", "n")
    return rows.withColumn("task", F.pmod(F.xxhash64("list", "x", "y"), F.lit(max(1, lists.count() // ROWS))))


def likely(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that tie nodes to leaders: for each node the leader whom most follow and the one most like it."""
    lists = lists.where("ord = 0")
    sizes = lists.groupBy("ord", "list").agg(F.count(F.lit(1)).alias("n"))
    found = dealt(lists.join(sizes, ["ord", "list"])).groupBy("ord", "task").applyInPandas(_leaders(percent), "node long, leader long, differ long").distinct()
    found = written(found, "leaders")
    led = found.groupBy("leader").agg(F.count(F.lit(1)).alias("led"))
    best = found.join(led, "leader").groupBy("node").agg(F.max(F.struct("led", "leader"))["leader"].alias("most"), F.min(F.struct("differ", "leader"))["leader"].alias("like"))
    pairs = best.select("node", F.explode(F.array_distinct(F.array("most", "like"))).alias("leader"))
    return written(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "likely")


def unsettled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of tasks of those lists that hold several components."""
    known = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("ord", "list").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("ord", "list", "n")
    return dealt(known.join(mixed, ["ord", "list"]))


def closest(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components: for each node the one that is most like it, at most one pair a node."""
    some = unsettled(lists.where("ord = 0"), labels)
    met = some.groupBy("ord", "task").applyInPandas(_nearest(percent), "node long, other long, differ long")
    best = met.groupBy("node").agg(F.min(F.struct("differ", "other"))["other"].alias("other"))
    return written(best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "closest")


def candidates(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share enough prefix n-grams under every order and may link by
    size and bitmap."""
    met = unsettled(lists, labels).groupBy("ord", "task").applyInPandas(_across(percent), "ord int, a long, b long, sizes long, larger long, shared long")
    enough = least_shared(F.col("larger"), F.col("sizes") - F.col("larger"), percent)
    under = [F.sum(F.when(F.col("ord") == k, F.col("shared"))).alias(f"shared_{k}") for k in range(ORDERS)]
    pairs = met.groupBy("a", "b", "sizes", "larger").agg(*under)
    for k in range(ORDERS):
        pairs = pairs.where(F.col(f"shared_{k}") >= enough)
    return written(pairs.select("a", "b"), "candidates")


def linked(docs: DataFrame, percent: int = PERCENT, n: int = N, chunk=None) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text): the smallest doc_id that links reach.

    Rows link when percent * union <= 100 * intersection of their sets of word n-grams.

    chunk: as for remove_repeated() of substrings. A document without words or text has an empty set and
    is linked with nothing: its component is itself. Null ids: such rows link like others, but never name
    a component (null if a component has no id at all). Rows with the same id stay rows of their own.
    Other columns are not read; an empty table gives no rows.
    """
    batches_of(docs.sparkSession)
    n_docs, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if chunk is None:
        chunk = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs // CHUNK)))
    rows = docs.select("doc_id", "text", chunk.cast("long").alias("chunk"))
    first = written(signed(rows, n), "shingle-sets")
    sigs = first.where("node is not null").drop("slice", "counts")
    # Sets of one id but another second half: at 10**10 sets a few are to be expected.
    twice = sigs.where("size > 0").groupBy("node").agg((F.min("half") != F.max("half")).alias("twice")).where("twice")
    sigs = sigs.join(written(twice, "clashes"), "node", "left").withColumn("clash", F.when(F.col("twice"), F.col("node")))
    sigs = sigs.withColumn("node", F.when(F.col("twice"), renamed()).otherwise(F.col("node"))).drop("twice")
    home = F.min(F.struct("chunk", "key", "size", "bitmap")).alias("home")
    homes = written(sigs.where("size > 0").groupBy("node").agg(home, F.min("doc_id").alias("least")).select("node", "home.*", "least"), "nodes")
    bits = max(0, int(total // GRAM_BYTES * (100 - percent) // 100 // ENTRIES).bit_length())
    classes, floor = frequency_classes(first.where("slice is not null").select("slice", "counts"))
    cell_bits = min(GRAM_BITS - BLOCK_BITS, max(0, int(total // GRAM_BYTES * CELLS - 1).bit_length() - BLOCK_BITS)) if total else 0
    answers = written(shared_cells(rows, cell_bits, n).withColumn("clash", F.lit(None).cast("string")), "shared-cells")
    # as text, since pandas would make doubles of a column of numbers with nulls
    answers = answers.unionByName(sigs.where("clash is not null").select("chunk", F.col("clash").cast("string").alias("clash")).distinct(), allowMissingColumns=True)
    packed = pack(rows)
    lists = prefixes(packed, answers, cell_bits, classes, floor, bits, percent, n).groupBy("ord", "block").applyInPandas(prefix_lists, "ord int, list long, weight long, node long, size long")
    lists = written(lists.join(homes.select("node", "bitmap"), "node"), "prefix-lists")

    # Any choice here is right; likely links are chosen, as sets travel for each. Step 3 finds what this misses.
    links = written(verified(likely(lists, percent), rows, homes, percent, n), "links")
    labels = components(links)
    some = lambda df: df.limit(1).count() > 0
    for _ in range(ROUNDS):
        pairs = closest(lists, labels, percent)
        if not some(pairs):
            break
        more = written(verified(pairs, rows, homes, percent, n), "links")
        if not some(more):
            break
        links = links.unionByName(more)
        labels = components(links)
    pairs = candidates(lists, labels, percent)
    if some(pairs):
        more = written(verified(pairs, rows, homes, percent, n), "links")
        if some(more):
            labels = components(links.unionByName(more))

    named = homes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(names, "label").select("node", "component_id")
    full = sigs.where("size > 0").join(named, "node").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return full.unionByName(sigs.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document: edge cases as for linked()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", file_chunk(CHUNK).alias("place"))
    return linked(docs, PERCENT, N, F.col("place"))


OP4_SQL = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < {N} then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + {N - 1}], ' ') for i in range(1, len(w) - {N - 2})]) end as s from words),
keyed as (select doc_id, len(s) as n, list_sort(s) as s from sets),
contents as (select min(doc_id) as node, any_value(n) as n, s from keyed where n > 0 group by s),
grams as (select node, n, unnest(s) as g from contents),
common as (
  select x.node as a, y.node as b, count(*) as c, any_value(x.n) as na, any_value(y.n) as nb
  from grams x join grams y on x.g = y.g and x.node < y.node and 100 * x.n >= {PERCENT} * y.n and 100 * y.n >= {PERCENT} * x.n group by 1, 2),
links as (select a, b from common where 100 * c >= {PERCENT} * (na + nb - c)),
ends as (select a, b from links union all select b, a from links),
reach as (select node as a, node as b from contents union select r.a, e.b from reach r join ends e on r.b = e.a),
labels as (select a as node, min(b) as component_id from reach group by a)
select doc_id, cast(k.n as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id
from keyed k left join contents c on k.n > 0 and k.s = c.s left join labels using (node)
"""
