"""Language identification: sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams with TF-IDF weights; document
frequencies come from every training document. The weights are fitted with
follow-the-regularised-leader (proximal, per-coordinate rates, L1 and L2
penalties) on a bounded sample, and the scores are calibrated with one
temperature fitted on a part of the sample that the weights have not seen.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
N_FEATURES = 1 << BITS
UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    """``max_train_docs`` bounds the rows that the weights are fitted on (the
    same number for each label, by a hash); ``max_labels`` bounds the model."""
    max_train_docs: int = 4000
    max_labels: int = 256
    passes: int = 3
    alpha: float = 2.0
    beta: float = 0.1
    l1: float = 0.02
    l2: float = 0.001
    calibration_part: int = 5  # every n-th row of the sample


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x labels
    bias: np.ndarray
    temperature: float


def gram_counts(text: str, chunk: int = 1 << 20) -> np.ndarray:
    """How often each hashed 1-, 2- and 3-gram of the lower-cased text occurs."""
    total = np.zeros(N_FEATURES, np.int64)
    text = text.lower()
    for at in range(0, len(text), chunk):
        before = min(at, 2)  # grams that begin in the chunk before
        x = np.frombuffer(text[at - before:at + chunk].encode("utf-32-le", "surrogatepass"), np.uint32)
        one = x * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ x[1:]) * np.uint32(0x85EBCA6B)
        three = (two[:-1] ^ x[2:]) * np.uint32(0xC2B2AE35)
        for grams, own in ((one, before), (two, max(before - 1, 0)), (three, 0)):
            total += np.bincount(grams[own:] >> np.uint32(32 - BITS), minlength=N_FEATURES)
    return total


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, values): damped term frequency times idf, of length one."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return at, x / norm if norm else x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(docs: list[tuple[str, str]], labels: list[str], idf: np.ndarray, p: Params) -> Model:
    """Fits weights and temperature on (text, label) rows in their order."""
    rows = [(*vector(text, idf), labels.index(label)) for text, label in docs]
    held = rows[::p.calibration_part] if len(rows) >= 2 * p.calibration_part else []
    train = [r for i, r in enumerate(rows) if i % p.calibration_part or not held]
    k = len(labels)
    z, n = np.zeros((N_FEATURES + 1, k)), np.zeros((N_FEATURES + 1, k))  # the last row is the bias

    def leader(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)
        return np.where(np.abs(zs) <= p.l1, 0.0, w)

    for _ in range(p.passes):
        for at, x, y in train:
            at, x = np.append(at, N_FEATURES), np.append(x, 1.0)
            w = leader(at)
            wrong = _softmax(x @ w)
            wrong[y] -= 1
            g = x[:, None] * wrong[None, :]
            n_at = n[at]
            z[at] += g - (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / p.alpha * w
            n[at] += g * g
    w = leader(np.arange(N_FEATURES + 1))
    logits = np.array([x @ w[at] + w[-1] for at, x, _ in held]).reshape(len(held), k)
    return Model(labels, idf.astype(np.float32), w[:-1].astype(np.float32), w[-1],
                 temperature(logits, np.array([y for _, _, y in held], int)))


def temperature(logits: np.ndarray, y: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """The temperature of least log loss, by golden section; 1 without rows."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    a, b, g = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def predict(model: Model, text: str) -> tuple[str, float]:
    at, x = vector(text, model.idf)
    p = _softmax((x @ model.weights[at] + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.labels[best], float(p[best])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(in how many of ``texts`` (one column) each feature occurs, their number);
    a task sends one row per feature, the driver gets one number per feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(N_FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df += gram_counts(text.as_py()) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))],
                                         names=["feature", "n"])
    sums = texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(N_FEATURES), 0
    for r in sums:
        if r["feature"] < 0:
            n = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return df, n


def _sample(train: DataFrame, labels: dict[str, int], per_label: int) -> DataFrame:
    """At most ``per_label`` rows of each label, those with the smallest hash."""
    rate = F.lit(1.0)
    for label, n in labels.items():
        rate = F.when(F.col("_lang") == label, F.lit(min(1.0, 1.3 * per_label / n + 20 / n))).otherwise(rate)
    u = (F.xxhash64("_id", "_text") / F.lit(2.0 ** 64)) + 0.5
    some = train.withColumn("_u", u).where(F.col("_u") <= rate)
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_u", "_text"))
    return some.withColumn("_rank", rank).where(F.col("_rank") <= per_label).select("_text", "_lang", "_u")


def train_model(rows: DataFrame, p: Params = Params()) -> Model | None:
    """Model from rows (_id, _text, _lang), none of them null but ids; None
    without rows. Statistics cover all rows, the weights a bounded sample."""
    counts = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).limit(p.max_labels + 1).collect()
    if len(counts) > p.max_labels:
        raise ValueError(f"more than {p.max_labels} labels")
    if not counts:
        return None
    labels = sorted(r["_lang"] for r in counts)
    df, n = document_frequencies(rows.select("_text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = _sample(rows, {r["_lang"]: r["n"] for r in counts}, max(1, p.max_train_docs // len(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = [(t.as_py(), y.as_py()) for b in batches for t, y in zip(b.column(0), b.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(docs, labels, idf, p))])], names=["model"])
    # one task sees the bounded sample, in the order of its hash
    fitted = (sample.repartition(1).sortWithinPartitions("_u", "_text", "_lang").select("_text", "_lang")
              .mapInArrow(run, "model binary").first())
    return pickle.loads(fitted["model"])


def is_held_out(id_: Column, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % parts == part


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def predicted(docs: DataFrame, text: str, model: Model | None) -> Column:
    """struct(lang, score): ``und`` and 0 where the text has no letter."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return unknown
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pickle.loads(held.value)
        for texts in batches:
            found = [(UNKNOWN, 0.0) if t is None else predict(known, t) for t in (x.as_py() for x in texts)]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()),
                                              pa.array([s for _, s in found], pa.float64())], names=["lang", "score"])
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, "struct<lang: string, score: double>")
    return udf(F.when(has_letter(F.col(text)), F.col(text)))


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
          p: Params = Params()) -> Model | None:
    """Model from the documents that are not held out and have text and label."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    return train_model(rows.where(~is_held_out(F.col("_id")) & F.col("_lang").isNotNull() & has_letter(F.col("_text"))), p)


def language_id(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
                p: Params = Params()) -> DataFrame:
    """Per row: id, held_out, lang_pred, score.

    Held out are the documents with crc32(id as text) mod 4 = 2 (a null id is
    the empty text); the others with a label and a letter are learned from.
    Whole texts are used. A text that is null or has no letter, and every text
    where nothing can be learned, is ``und`` with score 0; ties go to the first
    label by name. Repeated rows each get the same result; an empty table gives
    an empty result; other columns are not read.
    """
    model = learn(docs, id_col, text, lang, p)
    d = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    d = d.withColumn("_p", predicted(d, "_text", model))
    return d.select(F.col("_id").alias(id_col), is_held_out(F.col("_id")).alias("held_out"),
                    F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
