"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import bisect
import functools
import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.bpe import vocabulary
from barsmith.llm.common import batches_of, small

# Words next to credentials, words next to harmless digests, and the formats of issued keys.
SECRET_WORDS = {
    "password", "passwd", "passphrase", "pwd", "pass", "secret", "token", "key", "apikey", "auth", "authorization", "bearer", "credential", "credentials",
    "access", "private", "client", "login", "signing",
}
HARMLESS_WORDS = {
    "commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "guid", "revision", "build", "version", "etag", "id", "see", "file", "path",
    "image", "url", "example", "isbn", "phone", "card",
}
PLACEHOLDERS = {"changeme", "example", "your", "placeholder", "xxxx", "dummy", "sample", "redacted", "none", "null", "true", "false", "here", "todo", "insert"}
#: A private key's block: header lines, line ends as such or escaped, and an end line, or else all that is base64 in long lines.
_LINE_END = r"(?:\s|\\+[nrt])"
_PEM_HEADERS = rf"(?:(?:Proc-Type:[ ]*4,[ ]*[A-Z-]+|DEK-Info:[ ]*[A-Za-z0-9-]+,[ ]*[0-9A-Fa-f]+|[A-Z][A-Za-z-]+:[^\r\n\\]*){_LINE_END}+)*"
_PEM = (
    rf"-----BEGIN [A-Z ]*PRIVATE KEY-----{_LINE_END}*+{_PEM_HEADERS}(?:(?:[A-Za-z0-9+/=\s]|\\+[nrt/])*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|[A-Za-z0-9+/]{{16,}}+={{0,2}}(?:{_LINE_END}+(?:[A-Za-z0-9+/]{{16,}}+={{0,2}}|[A-Za-z0-9+/]+(?:={{1,2}}|\Z)))*)"
)
ISSUED = {
    "aws": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "slack": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "stripe": r"\b[sr]k_live_[0-9A-Za-z]{16,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": _PEM,
}
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_ISSUED = re.compile("|".join(f"(?P<{k}>{v})" for k, v in ISSUED.items() if k != "private_key"))
_PRIVATE_KEY = re.compile(ISSUED["private_key"])
_RANDOM = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_IN_URL = re.compile(r"://[^\s/:@\"'<>]{0,128}:([^\s/\"'<>]{3,256})@(?=[\w\[])")
_OPERATOR = re.compile(r"[:=]")
_NAME = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?)[\"']?[ \t]*:?$", re.IGNORECASE)
_VALUE = re.compile(r"[ \t]*[\"']?([^\s\"'<>,;=]{6,})")
#: Characters around a candidate in which neighbouring words are looked for.
NEAR = 48
#: Characters from which on an assigned value is one value, whatever is assigned inside it.
LONG_VALUE = 4096
#: The forest: trees, depth, fewest findings in a leaf; labelled findings it is fitted on at most.
TREES, DEPTH, LEAST, LABELLED = 30, 8, 3, 6000

FINDING = "start int, end int, rule string, score double"


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, rule) of everything that could be a secret, in code points, without overlaps.

    Issued keys and private key blocks come first, then passwords of URLs (user:password@host) and values
    assigned to a telling name, then long runs that mix letters and digits.
    """
    spans: list[tuple[int, int, int, str]] = []
    if "-----BEGIN" in text:
        spans += [(0, m.start(), m.end(), "private_key") for m in _PRIVATE_KEY.finditer(text)]
    if "://" in text:
        spans += [(1, m.start(1), m.end(1), "url") for m in _IN_URL.finditer(text)]
    for run in _RUN.finditer(text):
        spans += [(0, m.start(), m.end(), m.lastgroup) for m in _ISSUED.finditer(text, run.start(), run.end())]
        for m in _RANDOM.finditer(text, run.start(), run.end()):
            if _DIGIT.search(text, *m.span()) and _LETTER.search(text, *m.span()):
                spans.append((2, m.start(), m.end(), "random"))
    covered = 0  # end of the last very long value: what is assigned inside it is part of it
    for m in _OPERATOR.finditer(text):
        if m.end() >= covered and _NAME.search(text, max(0, m.start() - 24), m.start()) and (v := _VALUE.match(text, m.end())):
            spans.append((1, v.start(1), v.end(1), "assigned"))
            covered = v.end(1) if v.end(1) - v.start(1) > LONG_VALUE else covered
    taken: list[tuple[int, int, str]] = []  # sorted, without overlaps
    for _, a, b, rule in sorted(spans):
        k = bisect.bisect_left(taken, (a,))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
            taken.insert(k, (a, b, rule))
    return iter(taken)


@functools.cache
def dictionary() -> tuple[frozenset[str], np.ndarray]:
    """Words of at least 3 letters from a public tokenizer's vocabulary, and log shares of their letter pairs."""
    with open(vocabulary(), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = frozenset(w.lower() for w in (t.removeprefix("Ġ") for t in vocab) if len(w) >= 3 and w.isascii() and w.isalpha())
    pairs = np.ones((26, 26))
    for w in words:
        for a, b in zip(w, w[1:], strict=False):
            pairs[ord(a) - 97, ord(b) - 97] += 1
    return words, np.log(pairs / pairs.sum(1, keepdims=True))


def _covered(value: str) -> float:
    """Share of the characters that lie in dictionary words of 4 letters and more, longest first."""
    words, _ = dictionary()
    covered = 0
    for run in re.findall(r"[a-z]+", value.lower()):
        at = 0
        while at < len(run):
            size = next((n for n in range(min(14, len(run) - at), 3, -1) if run[at:at + n] in words), 0)
            covered += size
            at += size or 1
    return covered / len(value)


def _kind(ch: str) -> int:
    return 0 if ch.isdigit() else 1 if ch.islower() else 2 if ch.isupper() else 3


def features(text: str, start: int, end: int) -> list[float]:
    """Length, character transitions, dictionary coverage, path, and neighbouring words of a candidate."""
    value = text[start:end]
    before, after = text[max(0, start - NEAR):start], text[end:end + NEAR]
    n = len(value)
    _, pairs = dictionary()
    letters = [(ord(a) - 97, ord(b) - 97) for a, b in zip(value.lower(), value[1:].lower(), strict=False) if "a" <= a <= "z" and "a" <= b <= "z"]
    kinds = [_kind(c) for c in value]
    counts = Counter(value)
    words = re.findall(r"[a-z0-9]+", before.lower().replace("_", " "))[-3:]
    next_words = re.findall(r"[a-z0-9]+", after.lower())[:2]
    lower = value.lower()
    return [
        float(n),
        sum(pairs[a, b] for a, b in letters) / len(letters) if letters else -6.0,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        _covered(value),
        kinds.count(0) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))),
        float(any(re.fullmatch(p, value) for p in ISSUED.values())),
        float(value.count("/") + value.count("\\") + ("://" in before[-12:])),
        float(bool(re.search(r"\.[a-z]{2,4}$", lower) or before[-1:] in "/\\." and before)),
        float(any(w in SECRET_WORDS for w in words)),
        float(any(w in HARMLESS_WORDS for w in words)),
        float(bool(re.search(r"[:=][ \t]*[\"']?$", before))),
        float(before[-1:] in "\"'`" and bool(before)),
        float(any(p in lower for p in PLACEHOLDERS) or value[:1] in "$<{%"),
        float(any(w in HARMLESS_WORDS for w in next_words)),
        float(len(re.findall(r"-", value)) == 4 and n == 36),
    ]


@dataclass
class Forest:
    """Trees as arrays of nodes: feature (-1 at leaves), threshold, left, right, share of secrets.

    in_urls: the forest that judges passwords of URLs, if that is another one.
    """

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    in_urls: Forest | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH + 1):
                f = feature[node]
                down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[node], left[node], right[node])
                node = np.where(f < 0, node, down)
            total += share[node]
        return total / len(self.trees)


def _split(x: np.ndarray, y: np.ndarray, tried: np.ndarray) -> tuple[float, int, float] | None:
    """The split with the least Gini impurity among the tried features: (impurity, feature, threshold)."""
    best = None
    n = len(y)
    for f in tried:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        size = np.arange(1, n + 1)
        ok = np.flatnonzero((v[1:] > v[:-1]) & (size[:-1] >= LEAST) & (n - size[:-1] >= LEAST))
        if len(ok):
            a, b = ones[ok] / size[ok], (ones[-1] - ones[ok]) / (n - size[ok])
            impurity = size[ok] * a * (1 - a) + (n - size[ok]) * b * (1 - b)
            i = int(impurity.argmin())
            if best is None or impurity[i] < best[0]:
                best = float(impurity[i]), int(f), float((v[ok[i]] + v[ok[i] + 1]) / 2)
    return best


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 5) -> Forest:
    """A random forest: each tree on a bootstrap sample, each split among a random root of the features."""
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, depth: int, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
            if depth < DEPTH and 0 < nodes[at][4] < 1:
                tried = rng.permutation(x.shape[1])[: max(2, round(x.shape[1] ** 0.5) + 1)]
                if (s := _split(x[rows], y[rows], tried)) is not None:
                    low = x[rows, s[1]] <= s[2]
                    left, right = grow(rows[low], depth + 1), grow(rows[~low], depth + 1)
                    nodes[at][:4] = [s[1], s[2], left, right]
            return at

        grow(pick, 0)
        a = np.array(nodes)
        grown.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return Forest(grown)


def labelled_findings(n: int = LABELLED, seed: int = 3) -> Iterator[tuple[str, int, int, int]]:
    """(text, start, end, is_secret): n labelled findings, half of them planted secrets of the known kinds,
    half what scans mistake for them (digests, ids, paths, placeholders, code names, long words)."""
    r = random.Random(seed)
    words = sorted(dictionary()[0])
    hexes, upper, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    run = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    name = lambda: r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "pwd", "credential"])
    assign = lambda: r.choice(["=", " = ", ": ", ":", ' = "', '="', ": '"])
    secret = [
        lambda: ("", "AKIA" + run(upper, 16)),
        lambda: ("", r.choice(["ghp_", "gho_", "ghs_"]) + run(alnum, 36)),
        lambda: ("", "xoxb-" + run("0123456789", 11) + "-" + run(alnum, 24)),
        lambda: ("", "AIza" + run(alnum, 35)),
        lambda: ("", "sk_live_" + run(alnum, 24)),
        lambda: ("", ".".join(["eyJ" + run(alnum, 20), "eyJ" + run(alnum, 40), run(alnum, 43)])),
        lambda: (name() + assign(), run(hexes, r.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: (name() + assign(), run(alnum + "+/", r.choice([20, 24, 32, 40, 44]))),
        lambda: (name() + assign(), run(alnum, r.randint(8, 14)) + r.choice(["!", "#", "9$", "1"])),
        lambda: (name() + assign(), r.choice(words).title() + run("0123456789", r.randint(2, 5)) + r.choice(["!", "$", "#", "?"])),
        lambda: ("Authorization: Bearer ", run(alnum, r.choice([32, 40, 48]))),
    ]
    other = [
        lambda: (r.choice(["commit ", "sha1 ", "revision ", "see commit "]), run(hexes, 40)),
        lambda: (r.choice(["md5: ", "checksum = ", "etag: ", "hash "]), run(hexes, 32)),
        lambda: (r.choice(["sha256:", "digest: sha256:", "image "]), run(hexes, 64)),
        lambda: (r.choice(["id: ", "uuid ", "guid=", ""]), "-".join(run(hexes, k) for k in (8, 4, 4, 4, 12))),
        lambda: (r.choice(["/usr/lib/", "https://example.com/", "path ", "file "]), "/".join(r.choice(words) + r.choice(["", run("0123456789", 1)]) for _ in range(4)) + r.choice(["/v2", ".so.1", "2"])),
        lambda: (name() + assign(), r.choice(["changeme", "your_" + name() + "_here", "xxxxxxxxxxxx", "example123", "<password>", "${SECRET_TOKEN}", "placeholder", "dummy-value", "None,", "os.environ"])),
        lambda: (name() + assign(), r.choice(words) + "_" + r.choice(words) + r.choice(["()", ".get", "", "_" + r.choice(words)])),
        lambda: (name() + ": ", r.choice(words) + r.choice(words)),
        lambda: ("", r.choice(words) + "-" + r.choice(words) + "-" + r.choice(words) + "-" + run("0123456789", 2)),
        lambda: ("", "_".join(r.choice(words) for _ in range(3)) + run("0123456789", r.randint(1, 3))),
        lambda: ("", r.choice(words) + r.choice(words) + r.choice(words) + run("0123456789", r.randint(1, 2))),
        lambda: ("", "".join(r.choice(words).title() for _ in range(3)) + run("0123456789", 1)),
        lambda: (r.choice(["version ", "build ", ""]), run("0123456789", 8) + "T" + run("0123456789", 6) + "Z-" + run(hexes, 7)),
        lambda: ("", "0" * r.randint(10, 20) + "x" + "0" * 8),
    ]
    for i in range(n):
        label = i % 2
        lead, value = r.choice(secret if label else other)()
        close = lead[-1:] if lead[-1:] in "\"'" else ""
        text = some(r.randint(0, 6)) + r.choice([" ", " ", "\n"])
        start = len(text) + len(lead)
        yield text + lead + value + close + r.choice([" ", "\n", ". "]) + some(r.randint(0, 5)), start, start + len(value), label


def labelled_urls(n: int = LABELLED // 2, seed: int = 8) -> Iterator[tuple[str, int, int, int]]:
    """(text, start, end, is_secret): passwords of URLs, half of them secrets, half what stands for one."""
    r = random.Random(seed)
    words = sorted(dictionary()[0])
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    run = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    secret = [
        lambda: run(alnum, r.randint(6, 32)),
        lambda: run("0123456789abcdef", r.randint(8, 40)),
        lambda: r.choice(words) + run("0123456789", r.randint(2, 5)) + r.choice(["", "!", "$", "Pa55", "_x"]),
        lambda: run(alnum, r.randint(4, 10)) + r.choice("!#$%-_@") + run(alnum, r.randint(2, 6)),
    ]
    other = ["password", "passwd", "pass", "changeme", "${DB_PASSWORD}", "$PASSWORD", "{password}", "%(password)s", "your_password", "YOUR_PASSWORD", "xxxxxxxx", "placeholder", "dummy", "example", "redacted", "****"]
    for i in range(n):
        label = i % 2
        value = r.choice(secret)() if label else r.choice(other)
        lead = r.choice(["postgres", "postgresql", "mysql", "mongodb+srv", "redis", "amqp", "https", "ftp"]) + "://" + r.choice(["", "admin", "root", "app", "user", r.choice(words)]) + ":"
        host = "@" + r.choice(["localhost", "db", "host", "10.0.0.1", r.choice(words) + ".example.com"]) + r.choice(["", ":5432"]) + "/" + r.choice(words)
        text = some(r.randint(0, 6)) + r.choice([" ", "\n", " = ", ': "'])
        start = len(text) + len(lead)
        yield text + lead + value + host + r.choice([" ", "\n", '" ']) + some(r.randint(0, 5)), start, start + len(value), label


@functools.cache
def default_forest() -> Forest:
    forest = fit_findings(labelled_findings())
    forest.in_urls = fit_findings(labelled_urls())
    return forest


def fit_findings(findings: Iterable[tuple[str, int, int, int]]) -> Forest:
    """A forest from labelled findings (text, start, end, is_secret); their number is the caller's bound."""
    rows = list(findings)
    x = np.array([features(t, a, b) for t, a, b, _ in rows])
    return fit(x, np.array([label for *_, label in rows], dtype=float))


def scan_texts(texts: Iterable[str | None], forest: Forest, least: float) -> list[list[tuple[int, int, str, float]]]:
    """The findings of each text that the forest lets pass, in order."""
    found = [[(a, b, rule, text) for a, b, rule in candidates(text)] if text else [] for text in texts]
    flat = [f for fs in found for f in fs]
    x = np.array([features(t, a, b) for a, b, _, t in flat])
    score = forest.score(x) if flat else np.empty(0)
    urls = np.flatnonzero([rule == "url" for _, _, rule, _ in flat])
    if len(urls) and forest.in_urls is not None:
        score[urls] = forest.in_urls.score(x[urls])
    scores = iter(score.tolist())
    out = [[(a, b, rule, next(scores)) for a, b, rule, _ in fs] for fs in found]
    return [[f for f in fs if f[3] >= least] for fs in out]


def scan(docs: DataFrame, forest: Forest | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per finding: doc_id, start, end (code points of the text), rule, score.

    Whole texts are scanned. Null and empty texts have no findings; null ids keep theirs; repeated rows
    report theirs each. Other columns are not read; an empty table gives no rows.
    """
    batches_of(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())  # TREES trees of at most 2**DEPTH leaves

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small(batches, 1024, "text"):
            found = scan_texts(batch["text"], shared.value, least)
            rows = [(i, *f) for i, fs in zip(batch["doc_id"], found, strict=True) for f in fs]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "end", "rule", "score"])
            yield out.astype({"doc_id": "Int64" if len(rows) else "object"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id long, {FINDING}")


def redact(docs: DataFrame, forest: Forest | None = None, least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with every finding in text replaced by mark, and n_chars, if there, counted anew.

    Null and empty texts, and rows without findings, stay as they are; other columns too; repeated rows come as
    often as they came; an empty table gives no rows.
    """
    batches_of(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small(batches, 1024, "text"):
            texts = list(batch["text"])
            for k, found in enumerate(scan_texts(texts, shared.value, least)):
                for a, b, *_ in reversed(found):
                    texts[k] = texts[k][:a] + mark + texts[k][b:]
            yield batch.assign(text=texts)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInPandas(run, schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in all documents: edge cases as for scan()."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
