"""Repair of the structure of conversations: cheapest edits by dynamic programming over a grammar of their symbols."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.common import batches_of, written

#: Costs of the edits of a row, and of a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rounds of pair replacement, pairs that one round replaces at most, and occurrences that make a pair worth a rule.
ROUNDS, PAIRS, LEAST = 10, 48, 2
#: Rows of a conversation in one segment at most.
SEGMENT = 1 << 16
#: The first symbol that is a rule; terminals are the letters of TERMINALS.
FIRST_RULE = 0xE000
#: Terminals: role initial s, u, a or other (o), in upper case if the row is truncated; X is a row that has to go.
TERMINALS = "suaoSUAOX"

# States of the roles kept so far: none, the system row, ... user, ... assistant. A conversation may end in NONE or ASSISTANT.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
_NEXT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
#: What a new or renamed row has to be, by state, and the state after it.
_FORCED = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 60


# Transfer matrices


@dataclass
class Matrix:
    """From state i to state j over some rows: the least cost, the place of its audit among the audits from i (in ASCII
    order, by end state), and the rope of that audit: letters, or the state in which the left part of a pair ends."""

    cost: list[list[int]]
    order: list[list[int]]
    rope: list[list[str | int | None]]
    parts: tuple[Matrix, Matrix] | None = None

    def audit(self, i: int, j: int) -> str:
        """The letters of the rope, read off without recursion."""
        out, stack = [], [(self, i, j)]
        while stack:
            m, a, b = stack.pop()
            if m.parts is None:
                out.append(m.rope[a][b])
            else:
                k = m.rope[a][b]
                stack += [(m.parts[1], k, b), (m.parts[0], a, k)]
        return "".join(out)


def terminal(symbol: str) -> Matrix:
    """One row: rows inserted before it, then what becomes of it."""
    cost = [[_FAR] * 4 for _ in range(4)]
    rope: list[list[str | int | None]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        k = i
        for inserted in range(3):  # three would come back to a state that one has reached
            ways = [("D", k, DELETE)]
            if symbol != "X":
                late = TRUNCATED if symbol.isupper() else 0
                ways.append(("R", _FORCED[k], RENAME + late))
                if k in _NEXT[symbol.lower()]:
                    ways.append(("K", _NEXT[symbol.lower()][k], late))
            for letter, j, price in ways:
                new = (inserted * INSERT + price, "I" * inserted + letter)
                if new < (cost[i][j], rope[i][j] or ""):
                    cost[i][j], rope[i][j] = new
            k = _FORCED[k]
    order = [[0] * 4 for _ in range(4)]
    for i in range(4):
        for place, j in enumerate(sorted(range(4), key=lambda j: rope[i][j] or "~")):
            order[i][j] = place
    return Matrix(cost, order, rope)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The rows of a, then those of b, by least cost, ties by audit.

    Audits from one state over the same rows that end in different states differ at some letter and none begins another
    (each ends with the edit of the last row, and a state and an audit give the next state). So two ways from i that
    part ways in a are told by a's order, and else by b's: ranks suffice, no letters are compared.
    """
    cost = [[_FAR] * 4 for _ in range(4)]
    order = [[0] * 4 for _ in range(4)]
    rope: list[list[str | int | None]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            best, _, k = min((a.cost[i][k] + b.cost[k][j], a.order[i][k], k) for k in range(4))
            cost[i][j], rope[i][j] = min(best, _FAR), k
        for place, j in enumerate(sorted(range(4), key=lambda j: (a.order[i][rope[i][j]], b.order[rope[i][j]][j]) if cost[i][j] < _FAR else (4, j))):
            order[i][j] = place
    return Matrix(cost, order, rope, (a, b))


def closing(i: int) -> dict[int, tuple[int, str]]:
    """From state i to each end by insertions alone: cost and audit."""
    out: dict[int, tuple[int, str]] = {}
    k = i
    for inserted in range(3):
        if k in ENDS:
            out.setdefault(k, (inserted * INSERT, "I" * inserted))
        k = _FORCED[k]
    return out


@dataclass
class Grammar:
    """Rules in the order of their making: two symbols (letters) each, of terminals and earlier rules."""

    rules: list[str] = field(default_factory=list)
    _known: dict[str, Matrix] = field(default_factory=dict, repr=False)
    _memory: dict[str, Matrix] = field(default_factory=dict, repr=False)

    def compress(self, symbols: str) -> str:
        for k, pair in enumerate(self.rules):
            if pair[0] in symbols:
                symbols = symbols.replace(pair, chr(FIRST_RULE + k))
        return symbols

    def matrices(self) -> dict[str, Matrix]:
        """The matrix of every symbol, bottom-up: a rule's parts come before it."""
        if not self._known:
            self._known = {x: terminal(x) for x in TERMINALS}
            for k, (a, b) in enumerate(self.rules):
                self._known[chr(FIRST_RULE + k)] = product(self._known[a], self._known[b])
        return self._known

    def evaluate(self, symbols: str) -> Matrix:
        """The matrix of a sequence of terminals, one at least; sequences that come again are remembered."""
        found = self._memory.get(symbols)
        if found is None:
            level = [self.matrices()[x] for x in self.compress(symbols)]
            while len(level) > 1:
                level = [product(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            found = level[0]
            if len(symbols) <= 256:
                if len(self._memory) >= 50_000:
                    self._memory.clear()
                self._memory[symbols] = found
        return found


def pair_counts(sequence: str) -> Counter:
    """Occurrences of neighbours, those of two equal symbols without overlaps."""
    out: Counter = Counter()
    last, run = "", 0
    for a, b in zip(sequence, sequence[1:], strict=False):
        run = run + 1 if a == b == last else 0
        if run % 2 == 0:
            out[a + b] += 1
        last = a
    return out


def disjoint(counts: list[tuple[str, int]], most: int) -> list[str]:
    """Of pairs by falling count those that cannot overlap one another: no symbol is the left one of a pair and the
    right one of another."""
    lefts: set[str] = set()
    rights: set[str] = set()
    out: list[str] = []
    for pair, _ in counts:
        a, b = pair
        free = a not in rights and b not in lefts and (a != b or (a not in lefts and b not in rights))
        if free and len(out) < most:
            out.append(pair)
            lefts.add(a)
            rights.add(b)
    return out


def re_pair(sequences: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> Grammar:
    """The grammar of all sequences (symbols, copies): in each round the most frequent pairs that cannot overlap become
    rules. Counts are over all of them, summed up in the tasks first; the driver sees one row a pair of symbols, of which
    there are at most the square of (terminals + rules). What the rules leave uncompressed is evaluated symbol by symbol."""
    grammar = Grammar()
    for _ in range(rounds):
        rules = list(grammar.rules)

        def count(batches: Iterable[pd.DataFrame], rules: list[str] = rules) -> Iterator[pd.DataFrame]:
            now, found = Grammar(rules), Counter()
            for batch in batches:
                for symbols, copies in zip(batch["symbols"], batch["copies"], strict=True):
                    for pair, n in pair_counts(now.compress(symbols)).items():
                        found[pair] += n * copies
            if found:
                yield pd.DataFrame({"pair": list(found), "n": list(found.values())})

        totals = sequences.mapInPandas(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
        best = [(r.pair, r.n) for r in totals.orderBy(F.desc("n"), "pair").limit(4 * pairs).collect()]
        chosen = disjoint(best, pairs)
        if not chosen:
            break
        grammar.rules += chosen
    return grammar


# Rows


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of conv_id:turn deals to each row (nulls as one space)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """rows with digest (SHA-256 of the text), initial (first letter of the role), blank and truncated."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.substring("role", 1, 1).alias("initial"),
        (last == "").alias("blank"), ((last != "") & ~last.isin(".", "!", "?")).alias("truncated"),
    )


def cells(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: n of them, and first: no earlier turn of the conversation has that role and
    text. Both groupings sum up in the tasks first, and the second has the turn in its key, so neither a
    conversation nor a text that fills one meets in one task."""
    key = ["conv_id", "role", "digest"]
    at = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    firsts = rows.groupBy(*key).agg(F.min(at).alias("at")).select("conv_id", F.col("at.turn").alias("turn"), "role", "digest")
    both = rows.withColumn("first", F.lit(0)).withColumn("one", F.lit(1)).unionByName(firsts.withColumn("first", F.lit(1)).withColumn("one", F.lit(0)), allowMissingColumns=True)
    return both.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("one").alias("n"), (F.max("first") == 1).alias("first"), F.max("initial").alias("initial"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")
    )


ORDER = [F.asc_nulls_first, ["conv_id", "turn", "role", "digest"]]
SEGMENTS = "conv_id string, part int, nth int, turn long, role string, digest binary, symbols string, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long"
_LEGAL = {"su", "ua", "au"}


def segments(found: DataFrame) -> DataFrame:
    """Stretches of conversations in order, with their symbols, counts of faults, and what neighbours need: first and
    last initial, lowest, highest and distinct turns, and turn, role and digest of the first row. A sort by ranges deals
    a long conversation out over many tasks; no stretch has more than SEGMENT rows but where equal rows of a turn do."""
    by, names = ORDER
    keys = [by(c) for c in names]
    tasks = max(found.sparkSession.sparkContext.defaultParallelism, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = found.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    ordered = ordered.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})  # whole numbers with nulls are not for pandas

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        missing = object()
        conv, row, symbols, nth = missing, None, [], 0
        done: list[list] = []
        for batch in batches:
            columns = [batch[c] for c in ("conv_id", "turn", "role", "digest", "n", "first", "initial", "blank", "truncated", "part")]
            for conv_id, turn, role, digest, n, first, initial, blank, truncated, part in zip(*columns, strict=True):
                turn = None if turn is None else int(turn)
                new = conv is missing or conv_id != conv
                if new or row["size"] + n > SEGMENT:
                    if row is not None:
                        done.append([*_row(row, symbols)])
                    nth = 0 if new else nth + 1
                    conv, symbols = conv_id, []
                    row = {"conv_id": conv_id, "part": part, "nth": nth, "turn": turn, "role": role, "digest": digest, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                           "head": initial, "tail": None, "low": None, "high": None, "turns": 0, "size": 0, "last": None}
                row["size"] += n
                own = "X"
                if blank:
                    row["blank"] += n
                else:
                    row["duplicate"] += n - 1 if first else n
                    if first:
                        own = initial if initial in ("s", "u", "a") else "o"
                        own = own.upper() if truncated else own
                        row["truncated"] += bool(truncated)
                symbols.append(own + "X" * (n - 1))
                row["illegal"] += (row["tail"] is not None and row["tail"] + initial not in _LEGAL) + (n - 1 if initial + initial not in _LEGAL else 0)
                row["tail"] = initial
                if turn is not None:
                    if turn != row["last"]:
                        row["turns"] += 1
                        row["last"] = turn
                    row["low"] = turn if row["low"] is None else row["low"]
                    row["high"] = turn
            if len(done) >= 1000:
                yield pd.DataFrame(done, columns=_SEGMENT_NAMES, dtype=object)
                done = []
        if row is not None:
            done.append([*_row(row, symbols)])
        if done:
            yield pd.DataFrame(done, columns=_SEGMENT_NAMES, dtype=object)

    return ordered.mapInPandas(run, SEGMENTS)


_SEGMENT_NAMES = [x.split()[0] for x in SEGMENTS.split(", ")]


def _row(row: dict, symbols: list[str]) -> Iterator:
    return (("".join(symbols) if name == "symbols" else row[name]) for name in _SEGMENT_NAMES)


PLANS = "conv_id string, turn long, role string, digest binary, plan string, state int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, last boolean"


def plans(parts: DataFrame, grammar: Grammar) -> DataFrame:
    """For every segment the audit of its rows and the state in which it begins; the last one of a conversation has the
    insertions behind it, the whole cost and counts as well.

    A conversation of several segments: from its end backwards each state's best way on, by the segments' least costs
    and, for ties, by the order of their audits; then forwards the states in which segments begin.
    """
    batches_of(parts.sparkSession, 4096)
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth").withColumns({c: F.col(c).cast("string") for c in ("turn", "low", "high")})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        missing = object()
        conv, group = missing, []
        for batch in batches:
            out: list[tuple] = []
            for r in batch.itertuples(index=False):
                if conv is missing or r.conv_id != conv:
                    out += _planned(group, grammar)
                    conv, group = r.conv_id, []
                group.append(r)
            if out:
                yield pd.DataFrame(out, columns=_PLAN_NAMES, dtype=object)
        if group:
            yield pd.DataFrame(_planned(group, grammar), columns=_PLAN_NAMES, dtype=object)

    return rows.mapInPandas(run, PLANS)


_PLAN_NAMES = [x.split()[0] for x in PLANS.split(", ")]


def _planned(group: list, grammar: Grammar) -> Iterator[tuple]:
    if not group:
        return
    whole = lambda x: None if x is None else int(x)
    found = [grammar.evaluate(r.symbols) for r in group]
    # ways[t][i]: least cost from state i before segment t to the end, and the state after that segment.
    ends = [min(((cost, audit) for cost, audit in closing(i).values()), default=(_FAR, "")) for i in range(4)]
    ways: list[list[tuple[int, int]]] = []
    after = [cost for cost, _ in ends]
    for m in reversed(found):
        step = [min((m.cost[i][k] + after[k], m.order[i][k], k) for k in range(4)) for i in range(4)]
        ways.append([(cost, k) for cost, _, k in step])
        after = [cost for cost, _, _ in step]
    ways.reverse()
    state, states = NONE, []
    for way in ways:
        states.append(state)
        state = way[state][1]
    illegal = sum(r.illegal for r in group)
    turns, low, high, tail = 0, None, None, None
    for r in group:
        if tail is not None and tail + r.head not in _LEGAL:
            illegal += 1
        tail = r.tail
        if whole(r.turns):
            turns += whole(r.turns) - (high is not None and high == whole(r.low))
            low, high = (whole(r.low) if low is None else low), whole(r.high)
    totals = (0 if low is None else high - low + 1 - turns, *(sum(getattr(r, c) for r in group) for c in ("blank", "duplicate", "truncated")), illegal, ways[0][NONE][0])
    for t, (r, m) in enumerate(zip(group, found, strict=True)):
        end = t + 1 == len(group)
        audit = m.audit(states[t], ways[t][states[t]][1])
        yield (r.conv_id, whole(r.turn), r.role, r.digest, audit + (ends[state][1] if end else ""), states[t], *(totals if end else (0,) * 6), end)


REPAIRED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _apply(plan: Iterator[str], state: int, role: str, text: str) -> tuple[list[tuple[str, str]], int]:
    """What the plan's next letters, to the one of this row, make of it: rows, and the state after them."""
    out: list[tuple[str, str]] = []
    for letter in plan:
        if letter in "IR":
            state = _FORCED[state]
            out.append((_ROLE[state], text if letter == "R" else ""))
        elif letter == "K":
            state = _NEXT[role[0]][state]
            out.append((role, text))
        if letter != "I":
            break
    return out, state


def _merged(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows and plans of each conversation in one stream: every plan before the first of its rows."""
    one = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.lit(1).alias("kind"), "text")
    other = parts.withColumn("kind", F.lit(0))
    stream = one.unionByName(other, allowMissingColumns=True)
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "kind").drop("digest")


def _walk(batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """(conv_id, edited rows, plan row or None, is the conversation new) of the stream, row by row."""
    missing = object()
    conv, state, plan, letters = missing, NONE, None, iter("")
    for batch in batches:
        for r in batch.itertuples(index=False):
            new = conv is missing or r.conv_id != conv
            if new:
                conv = r.conv_id
            if r.kind == 0:
                plan, state, letters = r, int(r.state), iter(r.plan)
                yield conv, [], r, new
                continue
            made, state = _apply(letters, state, r.role, r.text)
            yield conv, made, None, new


class _Digest:
    """The running hash of a conversation's repaired rows, with its audit and counts so far."""

    def __init__(self, conv_id: str | None) -> None:
        self.conv_id, self.hash, self.some = conv_id, hashlib.sha256(), False
        self.audit: list[str] = []
        self.state, self.totals = NONE, (0,) * 6

    def add(self, rows: list[tuple[str, str]]) -> None:
        for role, text in rows:
            self.hash.update((("\n" if self.some else "") + f"{role}:{text}").encode())
            self.some = True

    def row(self) -> tuple:
        return (self.conv_id, *self.totals, "".join(self.audit), self.hash.hexdigest())


def summaries(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each conversation with rows. The hash of a conversation runs through its rows in order, so a task
    reads all of one; it holds one batch of them and the audit at a time."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        now: _Digest | None = None
        for conv, made, plan, new in _walk(batches):
            if new:
                if now is not None:
                    done.append(_closed(now))
                now = _Digest(conv)
                if len(done) >= 1000:
                    yield pd.DataFrame(done, columns=["conv_id", *_REPAIRED_NAMES])
                    done = []
            if plan is not None:
                now.audit.append(plan.plan)
                if plan.last:
                    now.totals = tuple(int(getattr(plan, c)) for c in _REPAIRED_NAMES[:6])
            now.add(made)
        if now is not None:
            done.append(_closed(now))
        if done:
            yield pd.DataFrame(done, columns=["conv_id", *_REPAIRED_NAMES])

    return _merged(rows, parts).mapInPandas(run, f"conv_id string, {REPAIRED}")


_REPAIRED_NAMES = [x.split()[0] for x in REPAIRED.split(", ")]


def _trailing(audit: str) -> int:
    return len(audit) - len(audit.rstrip("I"))


def _closed(now: _Digest) -> tuple:
    """The row of a conversation, after the insertions behind its last row (the last of them is an assistant's)."""
    n = _trailing(now.audit[-1]) if now.audit else 0
    now.add([(_ROLE[USER if (n - k) % 2 == 0 else ASSISTANT], "") for k in range(n)])
    return now.row()


def edited(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        conv, place, behind, size = None, 0, [], 0

        def put(made: list[tuple[str, str]]) -> None:
            nonlocal place, size
            for role, text in made:
                done.append((conv, place, role, text))
                place += 1
                size += len(text)

        for key, made, plan, new in _walk(batches):
            if new:
                put(behind)
                conv, place, behind = key, 0, []
            if plan is not None and plan.last:
                n = _trailing(plan.plan)
                behind = [(_ROLE[USER if (n - k) % 2 == 0 else ASSISTANT], "") for k in range(n)]
            put(made)
            if len(done) >= 1000 or size > 1 << 22:
                yield pd.DataFrame(done, columns=["conv_id", "place", "role", "text"])
                done, size = [], 0
        put(behind)
        if done:
            yield pd.DataFrame(done, columns=["conv_id", "place", "role", "text"])

    return _merged(rows, parts).mapInPandas(run, "conv_id string, place long, role string, text string")


def planned(rows: DataFrame) -> DataFrame:
    """The plans of all conversations of rows (conv_id, turn, role, text, no nulls but of ids and turns), written."""
    parts = written(segments(cells(marked(rows))), "conversation-segments")
    grammar = re_pair(parts.groupBy("symbols").agg(F.count(F.lit(1)).alias("copies")))
    return written(plans(parts, grammar), "conversation-plans")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id (as text), place, role, text. Rows stand in the order of their turn (null
    first), those of one turn by role and digest of the text. Null roles and texts count as one space; a null id is a
    conversation of its own; repeated rows are duplicates. Rows whose text is blank or was seen before in the
    conversation are deleted, others kept, renamed or deleted, and empty ones put in, at the least cost, so that roles
    read system?, then user and assistant in turn. An empty table gives no rows. Other columns are not read."""
    spaced = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    return edited(spaced, planned(spaced))


def repair_report(rows: DataFrame, damage: Column | None = None) -> DataFrame:
    """Per conversation of rows: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, of the rows
    after the damage that the contract of op11 deals out. Conversations without rows after it have zeros, an empty audit
    and the hash of the empty string. Rows and nulls as for repair(); conv_id keeps its type."""
    spark = rows.sparkSession
    batches_of(spark, 2048)
    hurt = damaged(rows)
    known = summaries(hurt, planned(hurt))
    kind = dict(rows.dtypes)["conv_id"]
    ids = rows.select("conv_id").distinct()
    joined = ids.join(known.withColumnRenamed("conv_id", "key"), F.col("conv_id").cast("string").eqNullSafe(F.col("key")), "left")
    none = {**dict.fromkeys(_REPAIRED_NAMES[:6], F.lit(0).cast("long")), "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return joined.select(F.col("conv_id").cast(kind).alias("conv_id"), *(F.coalesce(F.col(c), none[c]).alias(c) for c in _REPAIRED_NAMES))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation: edge cases as for repair_report()."""
    return repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP11_SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint)) as bytes
  from conversations),
dealt as (
  select conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 as kind from named, crc),
hurt as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from dealt, unnest(case kind when 0 then [] when 3 then [0, 1] else [0] end) as c(copy)),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as p from hurt),
seen as (
  select *, left(role, 1) as initial, left(lag(role) over w, 1) || left(role, 1) as pair,
         not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by p) > 1 as again,
         right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) not in ('.', '!', '?') as open
  from placed window w as (partition by conv_id order by p)),
faults as (
  select *, again and not blank as duplicate, open and not blank and not again as truncated from seen),
counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
         count(*) filter (truncated) as truncated, count(*) filter (p > 1 and pair not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id),
moves(state, ins, k, added) as (values
  (0, 0, 0, ''), (0, 1, 2, 'user:' || chr(10)), (0, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 0, 1, ''), (1, 1, 2, 'user:' || chr(10)), (1, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
  (2, 0, 2, ''), (2, 1, 3, 'assistant:' || chr(10)), (2, 2, 2, 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 0, 3, ''), (3, 1, 2, 'user:' || chr(10)), (3, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10))),
steps as (
  select f.conv_id, f.p, m.state, m.ins, letter, added,
         case letter when 'D' then k when 'R' then case k when 2 then 3 else 2 end else case when initial = 's' and k = 0 then 1 when initial = 'u' and k <> 2 then 2 when initial = 'a' and k = 2 then 3 end end as next,
         2 * ins + case letter when 'D' then 3 when 'R' then 2 else 0 end + case when letter <> 'D' and truncated then 1 else 0 end as price,
         case letter when 'D' then '' when 'R' then case k when 2 then 'assistant:' else 'user:' end || text || chr(10) else role || ':' || text || chr(10) end as made
  from faults f, moves m, (values ('D'), ('K'), ('R')) as l(letter) where letter = 'D' or not (blank or duplicate)),
walk as (
  select conv_id, cast(0 as bigint) as p, 0 as state, {'c': cast(0 as bigint), 'a': '', 't': ''} as best from counts
  union all
  select w.conv_id, w.p + 1, s.next, min({'c': cast(best.c + price as bigint), 'a': best.a || repeat('I', ins) || letter, 't': best.t || added || made})
  from walk w join steps s on w.conv_id is not distinct from s.conv_id and s.p = w.p + 1 and s.state = w.state where s.next is not null
  group by w.conv_id, w.p + 1, s.next),
ended as (
  select w.conv_id, min({'c': best.c + 2 * ins, 'a': best.a || repeat('I', ins), 't': best.t || added}) as best
  from walk w join counts c on w.conv_id is not distinct from c.conv_id and w.p = c.n
  join moves m on m.state = w.state and ((m.state in (0, 3) and ins = 0) or (m.state = 1 and ins = 2) or (m.state = 2 and ins = 1)) group by w.conv_id)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       cast(coalesce(best.c, 0) as bigint) as cost, coalesce(best.a, '') as audit, sha256(coalesce(left(best.t, length(best.t) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join counts c on i.conv_id is not distinct from c.conv_id left join ended e on i.conv_id is not distinct from e.conv_id
"""
