"""Counts of all prefixes against the library, prefix by prefix."""

import random

import pytest

from barsmith.llm import token_counts as tc
from barsmith.llm.bpe import tokenizer, vocabulary

PATH = vocabulary()
PARTS = [*" \n\taabcde'lrvsT19!?.,-é", "\xa0", "　", "​", "ß", "中", "\U0001f389", "<|endoftext|>", "<|end", "'ll", "'re", "'t", "'d", " the", "ing", "  ", "\n\n", "\r\n"]


def brute(text):
    return [len(e.ids) for e in tokenizer(PATH).encode_batch_fast([text[:i] for i in range(1, len(text) + 1)], add_special_tokens=False)]


def whole(text):
    return len(tokenizer(PATH).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(4))
def test_every_prefix(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for text, got in zip(texts, tc.text_counts(PATH, texts), strict=True):
        assert got.tolist() == brute(text), repr(text)


def test_prose_and_plain_texts(duck):
    texts = [t or "" for (t,) in duck.sql("select text from documents order by doc_id limit 40").fetchall()]
    for text, got in zip(texts, tc.text_counts(PATH, texts), strict=True):
        assert (got[-1] if len(got) else 0) == whole(text)
        assert got[:600].tolist() == brute(text[:600])


@pytest.mark.parametrize("text", ["a" * 60000, "ab" * 30000, " " * 50000, "\n" * 30000, "é" * 30000, "-" * 30000, "ACGT" * 15000, "x <|endoftext|>" * 3000])
def test_long_runs(text):
    got = tc.text_counts(PATH, [text])[0]
    assert len(got) == len(text) and got[-1] == whole(text) and got[len(text) // 2 - 1] == whole(text[: len(text) // 2])


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 500)
    for k in range(30):
        text = " ".join(f"word{k}x{i}" for i in range(40))
        assert tc.text_counts(PATH, [text])[0][-1] == whole(text)
        assert tc._memory[PATH].letters < 2000
    monkeypatch.undo()


def test_known_starts_are_not_walked_again():
    class Asked(dict):
        times = 0

        def get(self, *a):
            self.times += 1
            return super().get(*a)

    m = tc.Merges(PATH)
    word = b" counterrevolutionariesandothers"
    want = m.counts(word)
    m.starts = Asked(m.starts)
    assert list(m.counts(word)) == list(want) and m.starts.times == 1  # one look-up a letter before
    assert list(m.counts(word + b"x"))[:-1] == list(want) and m.starts.times == 3
    assert len(want) == len(word) + 1 and want[-1] == whole(word.decode())


def test_borders_agree_with_the_library():
    m = tc.merges(PATH)
    table, rng = tc.token_bytes(PATH), random.Random(7)
    ids = [i for i in range(50256) if table[i].isascii() and table[i].isalpha()]
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids[:4000])
        want = tokenizer(PATH).encode((table[a] + table[b]).decode(), add_special_tokens=False).ids == [a, b]
        assert m.neighbours(a, b) == want


def test_columns_and_odd_rows(spark):
    rows = [(1, "the cat's\n\n here", "x"), (1, "the cat's\n\n here", "x"), (None, None, "y"), (3, "", None), (4, "é" * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n.tokens` string")
    got = tc.count_prefixes(df, PATH).collect()
    assert sorted(len(r.prefix_tokens) for r in got) == [0, 0, 16, 16, 3000]
    assert all(r.prefix_tokens == brute(r.text or "") for r in got if len(r.text or "") < 100)
    counted = tc.count_prefixes(df, PATH, then=tc.budget_columns(4)).where("doc_id = 1").first()
    text = rows[0][1]
    keep = max(i for i in range(1, len(text) + 1) if whole(text[:i]) <= 4)
    assert (counted.n_tokens, counted.over_limit, counted.kept_chars) == (whole(text), True, keep)
    cut = tc.truncate(df, PATH, 4).where("doc_id = 1").first()
    assert cut.text == text[:keep] and set(cut.asDict()) == {"doc_id", "text", "n.tokens"}
    assert tc.count_prefixes(df.limit(0), PATH).count() == 0


def test_query_against_the_library(spark, duck):
    got = {r.doc_id: r for r in tc.op12(spark, "/root/testdata/sf0.001").collect()}
    rows = duck.sql("select doc_id, text from documents").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r.n_bytes, r.n_tokens) == (len((text or "").encode()), whole(text or "")) and r.over_limit == (r.n_tokens > 1024)
        assert r.over_limit == (r.kept_chars < len(text or ""))
