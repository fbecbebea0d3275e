"""BPE encoding and decoding of whole texts; long texts by tree concatenation."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.common import batches_of, small

#: Longest text, in characters, that is encoded in one go; longer ones are halved until they fit.
LEAF = 32768
#: Characters of the first window on either side of a join; it doubles until the sides agree.
WINDOW = 64
#: Pre-tokens before the end of a text that what follows can still change (a contraction and a blank).
UNSURE = 3


@functools.cache
def tokenizer(path: str):
    """The tokenizers library's reading of the file, without truncation and padding, one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id. In a byte-level vocabulary each byte has a letter: the printable ones of
    Latin-1 stand for themselves, the others, in order, for the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = b"".join(bytes([letters[c]]) if c in letters else c.encode() for c in token)
    return out


@functools.cache
def _tables(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens on end and where each begins; decimal numbers of all ids, padded, and which bytes count."""
    table = token_bytes(path)
    at = np.concatenate([[0], np.cumsum([len(x) for x in table])])
    numbers = np.array([f"{i}," for i in range(len(table))], dtype=f"S{len(str(len(table))) + 1}")
    digits = numbers.view(np.uint8).reshape(len(table), -1)
    return np.frombuffer(b"".join(table), dtype=np.uint8), at, digits, digits != 0


def decimals(path: str, ids: np.ndarray) -> bytes:
    """The ids, all of the vocabulary, in decimal, joined by commas."""
    _, _, digits, there = _tables(path)
    return digits[ids][there[ids]].tobytes()[:-1]


def decoded(path: str, ids: np.ndarray) -> bytes:
    """What decode_ids() gives, in UTF-8."""
    data, at, _, _ = _tables(path)
    ids = ids[ids < len(at) - 1]
    n = at[ids + 1] - at[ids]
    whole = data[np.repeat(at[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].tobytes()
    return whole.decode("utf-8", "replace").encode()


def decode_ids(path: str, ids: list[int]) -> str:
    """What the library's decode(ids, skip_special_tokens=False) gives; ids beyond the vocabulary give nothing."""
    table = token_bytes(path)
    return b"".join([table[i] for i in ids if i < len(table)]).decode("utf-8", "replace")


@functools.cache
def _specials(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in tokenizer(path).get_added_tokens_decoder().values())


#: Plain texts: each blank is a space or a line feed between characters that are none, all of them of classes that
#: no Unicode version has changed. Others go to the library whole.
_PLAIN = re.compile(r"(?:[ \n]?[\x21-\x7e\u00a1-\u024f\u2010-\u2027]+)*+")
#: Letters of words whose ids a worker remembers at most, about.
REMEMBERED = 1 << 22


class Words(dict):
    """Numbers of words; a new word gets the next one. Ids of word k: ids[at[k]:at[k + 1]]."""

    def __init__(self, before: str) -> None:
        self.before, self.new, self.letters = before, [], 0
        self.ids, self.at = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        self.letters += len(word)
        return number

    def learn(self, t) -> None:
        """The library encodes the words that came up since."""
        if self.new:
            found = [e.ids for e in t.encode_batch_fast([self.before + w for w in self.new], add_special_tokens=False)]
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), dtype=np.int32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in found])])
            self.new = []


_memory: dict[str, tuple[Words, Words]] = {}


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of whole texts, as the library gives them.

    The pre-tokeniser of a byte-level vocabulary always cuts before a space that no blank follows, and before and
    after a line feed that stands alone, and BPE encodes what it cuts one by one. So the ids of a plain text are
    those of its lines and words in turn, and the worker remembers them. Texts with special tokens, with runs of
    blanks or with characters that are not settled go to the library as they are.
    """
    t = tokenizer(path)
    first, later = _memory.setdefault(path, (Words(""), Words(" ")))
    if first.letters + later.letters > REMEMBERED:
        first, later = _memory[path] = (Words(""), Words(" "))
    specials = _specials(path)
    plain = [bool(x) and _PLAIN.fullmatch(x) is not None and x[0] != " " and x[0] != "\n" and not any(s in x for s in specials) for x in texts]
    feed = first["\n"]
    numbers: list[np.ndarray] = []  # of words, those at the start of a line as -1 - number
    for x, p in zip(texts, plain, strict=True):
        if p:
            row: list[int] = []
            for line in x.split("\n"):
                head, *rest = line.split(" ")
                row += (-1 - first[head], *map(later.__getitem__, rest), -1 - feed)
            numbers.append(np.array(row[:-1], dtype=np.int64))
    first.learn(t)
    later.learn(t)
    odd = iter(t.encode_batch_fast([x for x, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
    ids = np.concatenate([first.ids, later.ids])
    starts = np.concatenate([first.at[:-1][::-1], len(first.ids) + later.at[:-1]])
    sizes = np.concatenate([np.diff(first.at)[::-1], np.diff(later.at)])
    known = iter(numbers)
    out = []
    for p in plain:
        if p:
            word = next(known) + len(first)
            n = sizes[word]
            out.append(ids[np.repeat(starts[word] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
        else:
            out.append(np.array(next(odd).ids, dtype=np.int32))
    return out


@dataclass
class Piece:
    """Text with its ids; per token its first character and whether it begins a pre-token."""

    text: str
    ids: list[int]
    starts: list[int]
    heads: list[bool]

    def head_places(self) -> list[int]:
        return [i for i, h in enumerate(self.heads) if h]


def encode_piece(path: str, text: str) -> Piece:
    e = tokenizer(path).encode(text, add_special_tokens=False)
    words = e.word_ids
    heads = [i == 0 or words[i] is None or words[i - 1] is None or words[i] != words[i - 1] for i in range(len(words))]
    return Piece(text, e.ids, [a for a, _ in e.offsets], heads)


def _one_kind(text: str) -> bool:
    """Is it inside one run of a class (no boundary of pre-tokens can fall into it)?"""
    import regex

    return bool(regex.fullmatch(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+", text))


def join(path: str, left: Piece, right: Piece) -> Piece:
    """The encoding of left.text + right.text from those of the two, exactly.

    A window around the join is encoded afresh and grows until both sides agree with it. On the left
    it begins where a pre-token of the left text begins that nothing behind the join can change (not
    one of its last UNSURE). On the right the sides agree at the first place where both the window
    (again but for its last pre-tokens) and the right text begin a pre-token: from there on the
    pre-tokeniser, which only looks ahead, goes on alike. Inside a long run without any boundary
    the window lies in that run, and agreement is of its outermost tokens with both
    sides' tokens: BPE output is right if every two neighbours are, and each pair lies in one of the
    three encodings. If nothing agrees the window ends up as the whole text.
    """
    if not left.text or not right.text:
        return left if not right.text else right
    cut = len(left.text)
    text = left.text + right.text
    specials = _specials(path)
    margin = max((len(s) for s in specials), default=0)
    size = WINDOW
    while True:
        lo, hi = max(0, cut - size), min(len(text), cut + size)
        got = _by_heads(path, left, right, text, lo, hi, margin) or _by_tokens(path, left, right, lo, hi)
        if got is not None:
            return got
        if lo == 0 and hi == len(text):
            return encode_piece(path, text)
        size *= 2


def _by_heads(path: str, left: Piece, right: Piece, text: str, lo: int, hi: int, margin: int) -> Piece | None:
    cut = len(left.text)
    heads = left.head_places()
    sure = [i for i in heads[: -UNSURE or None] if left.starts[i] <= min(cut - margin, lo)] if len(heads) > UNSURE else []
    begin = sure[-1] if sure else 0
    at = left.starts[begin] if sure else 0
    if at < lo - 4 * WINDOW and lo > 0 and cut - at > 4 * (cut - lo):
        return None  # the pre-token is far longer than the window: try inside it, or grow
    window = encode_piece(path, text[at:hi])
    whole = hi == len(text)
    places = window.head_places()
    if not whole:
        places = places[:-UNSURE] if len(places) > UNSURE else []
    ours = {at + window.starts[i]: i for i in places if at + window.starts[i] > cut and (whole or at + window.starts[i] <= hi - margin)}
    for i in right.head_places():
        place = cut + right.starts[i]
        if place in ours and right.starts[i] >= margin:
            k = ours[place]
            return Piece(
                text, left.ids[:begin] + window.ids[:k] + right.ids[i:],
                left.starts[:begin] + [at + s for s in window.starts[:k]] + [cut + s for s in right.starts[i:]],
                left.heads[:begin] + window.heads[:k] + right.heads[i:],
            )
    if whole:
        return Piece(text, left.ids[:begin] + window.ids, left.starts[:begin] + [at + s for s in window.starts], left.heads[:begin] + window.heads)
    return None


def _by_tokens(path: str, left: Piece, right: Piece, lo: int, hi: int) -> Piece | None:
    cut = len(left.text)
    i = next((i for i in range(len(left.ids) - 1, -1, -1) if left.starts[i] <= lo), None)
    j = next((j for j in range(len(right.ids)) if cut + right.starts[j] >= hi), None)
    if i is None or j is None or i == 0 or j == 0 or left.starts[i] < 4:
        return None
    text = left.text + right.text
    at, end = left.starts[i], cut + right.starts[j]
    # characters of several tokens begin more than one at the same place: only clean borders will do
    if left.starts[i - 1] == at or right.starts[j - 1] == right.starts[j] or not _one_kind(text[at - 4:end + 4]):
        return None
    window = encode_piece(path, text[at:end])
    if window.ids[0] != left.ids[i] or window.ids[-1] != right.ids[j - 1]:
        return None
    return Piece(
        text, left.ids[:i] + window.ids + right.ids[j:],
        left.starts[:i] + [at + s for s in window.starts] + [cut + s for s in right.starts[j:]],
        left.heads[:i] + [left.heads[i]] + [False] * (len(window.ids) - 1) + right.heads[j:],
    )


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    """The text halved until every part has at most leaf characters, in order."""
    if len(text) <= leaf:
        return [text]
    half = len(text) // 2
    return leaves(text[:half], leaf) + leaves(text[half:], leaf)


def join_tree(path: str, pieces: list[Piece]) -> Piece:
    """Neighbours joined pairwise, level by level."""
    while len(pieces) > 1:
        pieces = [join(path, *pieces[i:i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


IDS = ("token_ids array<int>", lambda path, ids: {"token_ids": ids})


def encode(docs: DataFrame, path: str, text_col: str = "text", leaf: int = LEAF, then=IDS) -> DataFrame:
    """docs without the text but with token_ids (array of int) added: what the library gives for the whole text.
    Or, with then = (schema, columns), with what columns(path, ids of some texts) makes of them.

    Texts of at most leaf characters are encoded where they are. Longer ones are halved into leaves, which
    are dealt out over the cluster, encoded in parallel and then joined, tree-wise, per document.
    Null text: as the empty one, no ids. Rows keep their other columns; a column token_ids of the input
    is replaced. Repeated rows come as often as they came. An empty table gives no rows.
    """
    batches_of(docs.sparkSession)
    added, columns = then
    names = [c for c in docs.columns if c not in (text_col, *(x.split()[0] for x in added.split(", ")))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    rows = docs.select(*names, F.coalesce(text_col, F.lit("")).alias("__text"))

    def whole(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small(batches, 256, "__text"):
            yield batch[names].assign(**columns(path, encode_texts(path, list(batch["__text"]))))

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in small(batches, 1):
            parts = leaves(row["__text"].iloc[0], leaf)
            yield row.iloc[[0] * len(parts)].assign(__text=parts, __leaf=range(len(parts)))

    def encoded(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small(batches, 16):
            pieces = [encode_piece(path, x) for x in batch["__text"]]
            arrays = [(np.array(p.ids, dtype=np.int32), np.array(p.starts, dtype=np.int32), np.array(p.heads, dtype=bool)) for p in pieces]
            yield batch.assign(__ids=[a for a, _, _ in arrays], __starts=[a for _, a, _ in arrays], __heads=[a for _, _, a in arrays])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__leaf", kind="stable")
        copies = int((group["__leaf"] == 0).sum())
        one = group.drop_duplicates("__leaf")
        pieces = [Piece(t, list(map(int, i)), list(map(int, s)), list(map(bool, h))) for t, i, s, h in zip(one["__text"], one["__ids"], one["__starts"], one["__heads"], strict=True)]
        made = columns(path, [np.array(join_tree(path, pieces).ids, dtype=np.int32)])
        return group[group["__leaf"] == 0][names].assign(**{k: list(v) * copies for k, v in made.items()})

    long = F.length("__text") > leaf
    short = rows.where(~long).mapInPandas(whole, f"{schema}, {added}")
    # Of equal texts in equal rows the leaves are the same: they meet in one group and are joined once.
    key = F.sha2(F.concat_ws("\x01", "__text", F.to_json(F.struct(*names)) if names else F.lit("")), 256)
    parts = rows.where(long).withColumn("__key", key).mapInPandas(cut, f"{schema}, __text string, __key string, __leaf int")
    tokens = parts.repartition(F.col("__key"), F.col("__leaf")).mapInPandas(encoded, f"{schema}, __text string, __key string, __leaf int, __ids array<int>, __starts array<int>, __heads array<boolean>")
    trees = tokens.groupBy("__key").applyInPandas(joined, f"{schema}, {added}")
    return short.unionByName(trees)


def decode(df: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """df with text added: the library's decode(ids, skip_special_tokens=False). Null ids give null."""
    names = [c for c in df.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small(batches):
            texts = [None if ids is None else decode_ids(path, ids.tolist()) for ids in batch[ids_col]]
            yield batch.assign(text=texts)

    return df.select(*names).mapInPandas(run, f"{schema}, text string")


def digest_columns(path: str, ids: list[np.ndarray]) -> dict[str, list]:
    return {
        "n_tokens": [len(x) for x in ids],
        "ids_sha256": [hashlib.sha256(decimals(path, x)).hexdigest() for x in ids],
        "decoded_sha256": [hashlib.sha256(decoded(path, x)).hexdigest() for x in ids],
    }


#: For then of encode(): digests of the ids and of the decoded text, without or with the ids.
DIGESTS = ("n_tokens long, ids_sha256 string, decoded_sha256 string", digest_columns)
IDS_AND_DIGESTS = ("token_ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda path, ids: {"token_ids": ids} | digest_columns(path, ids))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every whole text. Null: the empty text, no tokens; null and
    repeated ids, rows and extra columns: a row each, no matter; an empty table: no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, vocabulary(), then=DIGESTS)
