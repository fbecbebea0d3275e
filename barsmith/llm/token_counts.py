"""Token counts of every prefix of a text, by dynamic programming over its pieces."""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.bpe import _PLAIN, token_bytes, tokenizer, vocabulary
from barsmith.llm.common import batches_of, small

#: Tokens of the budget that op12 asks about.
LIMIT = 1024
#: Letters of pieces whose counts a worker remembers at most, about, of the longest one that it remembers, and of the
#: longest start of a word whose place in the table it remembers.
REMEMBERED, LONGEST, START = 5 << 20, 1 << 12, 48
#: The characters with Unicode's property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Places where the pre-tokeniser cuts whatever stands around: before a space, and on both sides of a line feed, that
#: stand alone between characters that are not white.
_CUT = re.compile(rf"(?<=[^{WHITE}])(?= [^{WHITE}])|(?<=[^{WHITE}])(?=\n[^{WHITE}])|(?<=[^{WHITE}]\n)(?=[^{WHITE}])")
#: The same places in a plain text.
_WORDS = re.compile(r" ?[^ \n]+|\n")
#: Letters and then other signs (no apostrophe): two pre-tokens, of classes that no Unicode version has changed.
_SIMPLE = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
_NEVER = 1 << 30
#: Bits of a token's number.
TOKEN_BITS = 24
TOKEN = (1 << TOKEN_BITS) - 1


class Merges:
    """The merge list of a byte-level vocabulary, as far as counting needs it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, table = model["vocab"], token_bytes(path)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}  # token: its parts and the rank of the merge that makes it
        for r, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = r
            parts.setdefault(z, (x, y, r))
        single = {i for i in vocab.values() if len(table[i]) == 1}
        #: Bytes: the token, or -1 if longer tokens end so.
        self.known: dict[bytes, int] = {}
        for i in single | parts.keys():
            for k in range(1, len(table[i])):
                self.known.setdefault(table[i][k:], -1)
        for i in single | parts.keys():
            self.known[table[i]] = i
        self.longest = max(map(len, self.known))
        #: Bytes of the tokens; the number behind the last stands for no token.
        self.size = [*map(len, table), 0]
        #: Starts of words, of START bytes at most: their last token, and above it the number of their shape, the counts of
        #: their own starts. Plain numbers, which Python's garbage collector has no need to look at.
        self.starts: dict[bytes, int] = {}
        self.shapes: list[bytes] = []
        self.shape_of: dict[bytes, int] = {}
        self.forget()
        self._parts = parts
        self._ok: dict[int, bool] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge (0 left, 1 right) while token grows from bytes, each with the rank at
        which it is merged into the next; the token itself comes last and stays."""
        memo = (self._left, self._right)[side]
        if token not in memo:
            out, end = [], _NEVER
            while True:
                out.append((token, end))
                if token not in self._parts:
                    break
                end = self._parts[token][2]
                token = self._parts[token][side]
            memo[out[0][0]] = out[::-1]
            return out[::-1]
        return memo[token]

    def neighbours(self, a: int, b: int) -> bool:
        """Do the bytes of a and b encode as a, b? They do unless two tokens that face each other at the border while a
        and b grow are merged first: merges come by rank, equal ranks from the left."""
        key = a << TOKEN_BITS | b
        found = self._ok.get(key)
        if found is None:
            left, right = self.spine(a, 1), self.spine(b, 0)
            i = j = 0
            found = True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                r = self.rank.get((x, y), _NEVER)
                if r < _NEVER and r < x_ends and r <= y_ends:
                    found = False
                    break
                if x_ends == y_ends == _NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self._ok[key] = found
        return found

    def counts(self, word: bytes) -> Sequence[int]:
        """Tokens of word[:i] for every i from 0 on.

        The encoding of a prefix is that of a shorter one and one more token, and whether that token may follow depends
        only on the last one before it. So each place needs its last token and its count alone, of the one token that
        ends there and may follow what its own start has. Words share the starts that they have in common: the longest
        one that is known has the counts of all shorter ones, and only the places behind it are worked out.
        """
        starts, start = self.starts, word[:START]
        e = len(start)
        while (place := starts.get(start[:e])) is None:  # starts of a known start are known; most often few letters are new
            e -= 1
        token, count = place & TOKEN, self.shapes[place >> TOKEN_BITS]
        if e < len(start):
            last = lambda s: starts[start[:s]] & TOKEN
            for e in range(e + 1, len(start) + 1):
                s, token = self._end(word, e, token, last)
                count += bytes((count[s] + 1,))
                shape = self.shape_of.setdefault(count, len(self.shapes))
                if shape == len(self.shapes):
                    self.shapes.append(count)
                starts[start[:e]] = shape << TOKEN_BITS | token
        if len(word) == len(start):
            return count
        tokens, count = [starts[start[:i]] & TOKEN for i in range(START + 1)], list(count)
        for e in range(START + 1, len(word) + 1):
            s, token = self._end(word, e, token, tokens.__getitem__)
            tokens.append(token)
            count.append(count[s] + 1)
        return count

    def _end(self, word: bytes, e: int, token: int, last: Callable[[int], int]) -> tuple[int, int]:
        """Where the last token of word[:e] begins, and the token; token is that of word[:e - 1], last(s) that of word[:s].

        Only one fits, so the order of trials is a matter of time: first that which continues token, then long ones.
        """
        known = self.known
        s = e - 1 - self.size[token]
        found = known.get(word[s:e], -1)
        if found >= 0 and (s == 0 or self.neighbours(last(s), found)):
            return s, found
        ends = []
        for s in range(e - 1, max(0, e - self.longest) - 1, -1):
            found = known.get(word[s:e])
            if found is None:
                break
            if found >= 0:
                ends.append((s, found))
        for s, found in reversed(ends):
            if s == 0 or self.neighbours(last(s), found):
                return s, found
        raise AssertionError("a byte without a token")

    def forget(self) -> None:
        """Only the empty start stays."""
        self.starts.clear()
        self.starts[b""] = len(self.size) - 1
        self.shapes[:] = [b"\0"]
        self.shape_of.clear()
        self.shape_of[b"\0"] = 0


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


def _by_letter(m: Merges, word: str) -> Sequence[int]:
    """Tokens of word[:i] for every number of characters i from 1 on, word being one pre-token or the start of one."""
    data = word.encode()
    count = m.counts(data)
    if len(data) == len(word):
        return count[1:]
    return [c for c, after in zip(count[1:], data[1:] + b" ", strict=True) if after & 0xC0 != 0x80]  # where a character ends


def piece_counts(path: str, text: str) -> tuple[Sequence[int], int]:
    """Tokens of text[:i], as a text by itself, for i from 1 on; and of the whole, if something that is not white follows.

    The pre-tokens are the library's. A prefix that ends inside one has the same pre-tokens before it, with two
    exceptions: white space at the end of a prefix is one pre-token, though all but its last character is one and the
    last joins what follows when something does; and a contraction of three letters is an apostrophe and a letter until
    it is complete.
    """
    m = merges(path)
    simple = _SIMPLE.fullmatch(text)
    if simple:
        out = _by_letter(m, simple[1])
        if simple[2]:
            out = [*out, *(out[-1] + c for c in m.counts(simple[2].encode())[1:])]
        return out, out[-1]
    out = []
    done = run_at = run_done = 0  # tokens so far; where the last white run begins, and tokens before it
    for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text):
        word = text[a:b]
        count = _by_letter(m, word)
        white_before = a > 0 and text[a - 1] in WHITE
        if word[0] in WHITE and not white_before:
            run_at, run_done = a, done
        if word[-1] in WHITE and not white_before:
            out += [done + c for c in count]
        elif word[-1] in WHITE or (word[0] in WHITE and white_before):
            k = next((i for i, c in enumerate(word) if c not in WHITE), len(word))
            whole = _by_letter(m, text[run_at:a + k])
            out += [run_done + c for c in whole[a - run_at:]] + [done + c for c in count[k:]]
        elif len(word) == 3 and word[0] == "'" and word[1].isalpha():
            out += [done + count[0], done + count[0] + _by_letter(m, word[1])[0], done + count[2]]
        else:
            out += [done + c for c in count]
        done += count[-1]
    return out, done


class Pieces(dict):
    """Numbers of pieces; a new piece gets the next one and its counts."""

    def __init__(self, path: str) -> None:
        self.path, self.letters = path, 0
        self.flat, self.at, self.total = array("i"), array("q", [0]), array("q")
        self._arrays: tuple[np.ndarray, ...] | None = None

    def __missing__(self, piece: str) -> int:
        counts, total = piece_counts(self.path, piece)
        number = len(self.total)
        if len(piece) <= LONGEST:
            self[piece] = number
        self.flat.extend(counts)
        self.at.append(len(self.flat))
        self.total.append(total)
        self.letters += len(piece)
        self._arrays = None
        return number

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._arrays is None:
            self._arrays = np.array(self.flat), np.array(self.at), np.array(self.total)
        return self._arrays


_memory: dict[str, Pieces] = {}


def _segment(known: Pieces, text: str) -> list[int]:
    """Numbers of the pieces of a text without special tokens."""
    if _PLAIN.fullmatch(text) and text and text[0] not in " \n":
        return [*map(known.__getitem__, _WORDS.findall(text))]
    return [known[x] for x in _CUT.split(text) if x]


@functools.cache
def _specials(path: str) -> tuple[tuple[str, ...], re.Pattern | None]:
    names = tuple(sorted((x.content for x in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True))
    return names, re.compile("|".join(map(re.escape, names))) if names else None


def text_counts(path: str, texts: list[str]) -> list[np.ndarray]:
    """For each text the tokens of its first i characters, for every i from 1 on, as the library counts that prefix.

    A text is cut where the pre-tokeniser always cuts; the worker remembers the counts of the pieces between, so a text
    costs look-ups and one running sum. A special token in the text counts one when it is complete; until then
    its letters are ordinary ones that end the stretch before it.
    """
    known = _memory.setdefault(path, Pieces(path))
    if known.letters > REMEMBERED:
        known = _memory[path] = Pieces(path)
        merges(path).forget()
    _, special = _specials(path)
    plans: list[list[tuple[list[int], int]]] = []  # per text: pieces of a stretch, letters of the special token behind it
    for text in texts:
        plan, at = [], 0
        for hit in special.finditer(text) if special else ():
            plan.append((_segment(known, text[at:hit.end() - 1]), hit.end() - hit.start()))
            at = hit.end()
        plan.append((_segment(known, text[at:]), 0))
        plans.append(plan)
    flat, starts, totals = known.arrays()
    sizes = np.diff(starts)

    def stretch(numbers: list[int]) -> np.ndarray:
        k = np.array(numbers, dtype=np.int64)
        n, total = sizes[k], totals[k]
        before = np.cumsum(total) - total
        place = np.arange(int(n.sum())) + np.repeat(starts[k] - (np.cumsum(n) - n), n)
        return flat[place] + np.repeat(before, n)

    out = []
    for plan in plans:
        parts, done = [], 0
        for numbers, extra in plan:
            part = stretch(numbers) + done if numbers else np.empty(0, dtype=np.int64)
            parts.append(part)
            if extra:
                stop = len(part) - (extra - 1)  # where the special token begins
                done = (int(part[stop - 1]) if stop else done) + 1
                parts.append(np.array([done]))
        out.append(np.concatenate(parts).astype(np.int32))
    return out


# Columns


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most so many tokens (a longer prefix can have fewer)."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


COUNTS = ("prefix_tokens array<int>", lambda counts: {"prefix_tokens": counts})


def budget_columns(limit: int):
    """n_tokens, over_limit, and kept_chars: the characters that a truncation to the limit keeps."""

    def columns(counts: list[np.ndarray]) -> dict[str, list]:
        n = [int(c[-1]) if len(c) else 0 for c in counts]
        return {"n_tokens": n, "over_limit": [x > limit for x in n], "kept_chars": [longest_within(c, limit) for c in counts]}

    return "n_tokens long, over_limit boolean, kept_chars long", columns


def count_prefixes(docs: DataFrame, path: str, text_col: str = "text", then=COUNTS) -> DataFrame:
    """docs with prefix_tokens added: element i (from 0) has the tokens of the first i + 1 characters, which is what the
    library gives for that prefix without special tokens around it. Or, with then = (schema, columns), with what
    columns(counts of some texts) makes of them; the counts themselves are then not sent.

    Null text: as the empty one, no elements. Any length; one task holds one text and four bytes a character. Rows keep
    their other columns, whatever their names, but for those that are added; repeated rows come as often as they came.
    An empty table gives no rows.
    """
    batches_of(docs.sparkSession)
    added, columns = then
    new = [x.split()[0] for x in added.split(", ")]
    names = [c for c in docs.columns if c not in new]
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    kept = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)))  # Spark resolves no dots here
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    text = f"c{names.index(text_col)}"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in small(batches, 256, text):
            yield part.assign(**columns(text_counts(path, [x or "" for x in part[text]])))

    return kept.mapInPandas(run, f"{schema}, {added}").toDF(*names, *new)


def truncate(docs: DataFrame, path: str, budget: int, text_col: str = "text") -> DataFrame:
    """docs with the text cut to its longest prefix of at most so many tokens. Null text: the empty one. Else as for
    count_prefixes()."""
    cut = count_prefixes(docs, path, text_col, (f"kept_chars_{budget} long", lambda counts: {f"kept_chars_{budget}": [longest_within(c, budget) for c in counts]}))
    return cut.withColumn(text_col, F.substring(F.coalesce(text_col, F.lit("")), F.lit(1), F.col(f"kept_chars_{budget}").cast("int"))).drop(f"kept_chars_{budget}")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it is over LIMIT tokens. Null: the empty text; null and
    repeated ids, rows and extra columns: a row each, no matter; an empty table: no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_prefixes(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), vocabulary(), then=budget_columns(LIMIT))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars")
