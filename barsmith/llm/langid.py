"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barsmith.llm.common import batches_of, mix, small, written

#: N-grams of these lengths are hashed into so many features.
LENGTHS, FEATURES = (1, 2, 3), 1 << 16
#: Labelled documents that the classifier is fitted on at most: of each language (those with the smallest hash),
#: and in all; languages that it learns at most (the model has FEATURES weights for each): the most frequent ones.
SAMPLE, SAMPLED, LANGUAGES = 1500, 60_000, 500
#: Parts of a language that are ranked by themselves first.
PARTS = 64
#: Share of the sample that is left out of training and fits the temperature.
CALIBRATE = 0.2
#: FTRL-proximal: learning rate, smoothing, and the two penalties of the elastic net.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-3, 1e-4, 4
UNKNOWN = "und"


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the whole text in lower case and their counts."""
    code = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    hashes = [np.zeros(0, dtype=np.uint64)]
    for n in LENGTHS:
        if len(code) >= n:
            h = np.full(len(code) - n + 1, np.uint64(n))
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + code[k:len(code) - n + 1 + k]
            hashes.append(h)
    places = (mix(np.concatenate(hashes)) & np.uint64(FEATURES - 1)).astype(np.int64)
    total = np.bincount(places, minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (FEATURES + 1, languages), the last row is the bias; mostly zeros
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = text_features(text)
        x = (1 + np.log(n)) * self.idf[at]
        norm = np.sqrt(x @ x)
        return np.append(at, FEATURES), np.append(x / norm if norm else x, 1.0)

    def scores(self, text: str) -> np.ndarray:
        at, x = self.vector(text)
        return softmax(x @ self.weights[at] / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the documents each feature occurs, and their number: over all of them. Every task
    sends one count for each feature it has met; FEATURES counts reach the driver."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(FEATURES + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                df[text_features(text)[0]] += 1
                n += 1
        df[FEATURES] = n
        at = np.flatnonzero(df)
        yield pd.DataFrame({"feature": at, "n": df[at]})

    found = docs.select("text").mapInPandas(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1, dtype=np.int64)
    df[found["feature"]] = found["n"]
    return df[:FEATURES], int(df[FEATURES])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS, seed: int = 11) -> np.ndarray:
    """Weights by follow-the-regularised-leader (proximal, per coordinate) under L1 and L2 penalties.

    The leader's weight is nought where |z| stays within L1, so most stay exactly nought.
    """
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def leader(at):
        zs = z[at]
        return -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2) * (np.abs(zs) > L1)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            w = leader(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return leader(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    lo, hi, r = -1.5, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(train: DataFrame, sample: int = SAMPLE, most: int = LANGUAGES) -> Model | None:
    """A model from rows text, lang (neither null) and key (any column that tells rows apart).

    Document counts for IDF are over all rows. The regression sees at most sample keys of each language and
    SAMPLED in all, those with the smallest hashes, and is fitted on the driver. They are ranked in PARTS parts
    of each language first, so that no task ranks a whole language. Of rows of one key and language the
    smallest text counts. None if there are no rows. Of more than LANGUAGES values of lang the most frequent are
    learnt (ties: the first by code point): a label column of noise costs nothing but its noise.
    """
    df, n = document_counts(train)
    if not n:
        return None
    learnt = written(train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most).select("lang"), "languages")
    sample = min(sample, max(1, SAMPLED // learnt.count()))
    train = train.join(F.broadcast(learnt), "lang", "left_semi")  # at most LANGUAGES rows
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(PARTS))
    first = lambda rows, by: rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("key"), "key"))).where(F.col("__rank") <= sample)
    keys = first(train.select("key", "lang", part.alias("__part")).distinct(), ["lang", "__part"])
    chosen = written(first(keys, ["lang"]).select("key", "lang"), "language-sample")  # at most SAMPLED rows
    idf = np.log((1 + n) / (1 + df)) + 1
    model = Model([], idf, np.zeros((FEATURES + 1, 0)))

    def vectors(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small(batches):
            v = [model.vector(t) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "lang": batch["lang"], "at": [a.astype(np.int32).tobytes() for a, _ in v], "x": [x.astype(np.float32).tobytes() for _, x in v]})

    sampled = train.select("key", "lang", "text").join(F.broadcast(chosen), ["key", "lang"], "left_semi").groupBy("key", "lang").agg(F.min("text").alias("text"))
    got = sampled.mapInPandas(vectors, "key string, lang string, at binary, x binary").orderBy("lang", F.xxhash64("key"), "key").toPandas()
    languages = sorted(got["lang"].unique())
    y = got["lang"].map({c: i for i, c in enumerate(languages)}).to_numpy()
    rows = [(np.frombuffer(a, dtype=np.int32), np.frombuffer(x, dtype=np.float32), int(c)) for a, x, c in zip(got["at"], got["x"], y, strict=True)]
    every = round(1 / CALIBRATE)
    held = [r for i, r in enumerate(rows) if i % every == every - 1]
    weights = ftrl([r for i, r in enumerate(rows) if i % every != every - 1], len(languages))
    logits = np.stack([x @ weights[a] for a, x, _ in held]) if held else np.zeros((0, len(languages)))
    return Model(languages, idf, weights, temperature(logits, np.array([c for *_, c in held], dtype=int)))


def training_rows(docs: DataFrame) -> DataFrame:
    """text, lang, key of the documents to learn from: those not held out, with both text and lang."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", F.col("doc_id").cast("string").alias("key"))


def held_out():
    """crc32 of the id as text leaves 2 mod 4; null ids are not held out, but not learnt from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced).

    lang_pred: the learnt language with the highest calibrated probability, which is score; `und` with
    score 0 if the text is null or has no letter, or nothing was learnt. Repeated rows each get the same answer;
    no other column is looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    batches_of(spark)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    if model is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # FEATURES weights for each language

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in small(batches, 1024, "text"):
            best, score = [], []
            for text in batch["text"]:
                p = m.scores(text) if has_letter(text) else None
                best.append(UNKNOWN if p is None else m.languages[int(p.argmax())])
                score.append(0.0 if p is None else float(p.max()))
            yield batch.assign(lang_pred=best, score=score)

    return docs.select(*names).mapInPandas(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out, predict all: doc_id, held_out, lang_pred, score.

    Only whole texts enter a prediction. Null or empty texts and texts without a letter are `und`.
    Repeated rows each get the same answer. Without any labelled row everything is `und`. An empty
    table gives no rows; other columns are not read.
    """
    model = fit(training_rows(docs))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that language identification does not reject: with a letter, and a best language
    whose calibrated probability is at least `least`."""
    model = fit(training_rows(docs))
    return predict(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: edge cases as for identify()."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
