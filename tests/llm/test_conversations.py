"""Conversation repair against a plain search over all edits, and its grammar against plain products."""

import hashlib
import heapq
import random
import zlib

import duckdb
import pytest

from barsmith.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, extra string"
BLANKS = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of one conversation's rows: the cheapest edits by a
    search that always widens the least (cost, audit) first."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        last = text.rstrip(BLANKS)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    heap, done = [(0, "", 0, "", [])], set()
    while True:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            break
        if (at, state) in done:
            continue
        done.add((at, state))
        forced = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", at, forced[0], [*kept, f"{forced}:"]))
        if at < len(rows):
            role, text = rows[at][2:4]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, kept))
            if faults[at] not in ("blank", "duplicate"):
                late = faults[at] == "truncated"
                heapq.heappush(heap, (cost + 2 + late, audit + "R", at + 1, forced[0], [*kept, f"{forced}:{text}"]))
                if role[:1] and role[:1] in NEXT[state]:
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, role[0], [*kept, f"{role}:{text}"]))
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in damage([r[:4] for r in rows]):
        by[r[0]].append(r)
    none = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    return {k: brute(v) if v else none for k, v in by.items()}


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", " ", "", "Well then!", "a ", "Why?\n\n", "x.y", "fin.", None]
    return [
        (k, rng.choice([t, t, t, t + rng.randint(0, 2), None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"line {t}.", "x")
        for k in range(conversations) for t in range(rng.randint(1, longest))
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = random_rows(seed, 150, 9) + [(None, 0, "user", "a.", "x"), (None, None, "assistant", "b.", "x"), (10**15, 2**60, "user", "a.", "x"), (10**15, 2**60 + 3, "assistant", "b.", "x"), (10**15, None, None, None, "x")]
    got = c.repair_report(spark.createDataFrame(rows, SCHEMA))
    assert got.columns[0] == "conv_id"
    assert found(got) == expected(rows)


def test_query_and_sql_against_brute_force(spark, duck):
    rows = duck.sql("select conv_id, turn, role, text from conversations").fetchall()
    want = expected(rows)
    assert found(c.op11(spark, "/root/testdata/sf0.001")) == want
    assert {r[0]: r[1:] for r in duck.sql(c.OP11_SQL).fetchall()} == want


def test_sql_on_odd_rows():
    rows = [r[:4] for r in random_rows(3, 80, 7)]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.sql(c.OP11_SQL).fetchall()} == expected(rows)


def test_a_long_conversation_in_many_segments(spark, monkeypatch):
    monkeypatch.setattr(c, "SEGMENT", 7)
    rows = [(1, t, r, x, e) for _, t, r, x, e in random_rows(5, 1, 2) + [(0, 5 + k, random.Random(k).choice(["user", "assistant", "system"]), f"t {k % 90}" + "." * (k % 3), "x") for k in range(700)]]
    rows += random_rows(6, 5, 40)
    assert found(c.repair_report(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_repaired_rows(spark):
    rows = random_rows(9, 60, 8)
    plain = [(r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows]
    by = {}
    for r in c.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect():
        by.setdefault(int(r.conv_id), []).append(f"{r.role}:{r.text}")
    for k in {r[0] for r in rows}:
        want = brute([r for r in plain if r[0] == k])
        assert hashlib.sha256("\n".join(by.get(k, [])).encode()).hexdigest() == want[-1]


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.repair_report(empty).count() == 0 and c.repair(empty).count() == 0


def test_grammar_changes_no_result(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("suaoUAX") for _ in range(rng.randint(1, 60))) for _ in range(200)] + ["ua" * 3000]
    grammar = c.re_pair(spark.createDataFrame([(w, 1) for w in words], "symbols string, copies long"))
    assert len(grammar.rules) > 50 and len(grammar.compress("ua" * 3000)) < 60
    plain = c.Grammar()
    for w in words:
        a, b = grammar.evaluate(w), plain.evaluate(w)
        assert (a.cost, a.order) == (b.cost, b.order)
        assert all(a.audit(i, j) == b.audit(i, j) for i in range(4) for j in range(4) if a.cost[i][j] < c._FAR)


def test_pairs():
    assert c.pair_counts("aaaabab") == {"aa": 2, "ab": 2, "ba": 1}
    assert c.disjoint([("ua", 9), ("au", 8), ("aa", 7), ("su", 5), ("xa", 4), ("zz", 1)], 9) == ["ua", "xa", "zz"]
