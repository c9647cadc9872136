"""Language ID: sparse multinomial regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh
from tidemark.sources.shared import settle

#: Character n-grams of these lengths are hashed into so many features; one more is the constant.
LENGTHS = (1, 2, 3)
FEATURES = 1 << 15
#: The bound on the rows that the weights are fitted on, dealt evenly over the languages. Document
#: frequencies are counted on all rows that may be learned from.
SAMPLE = 4000
EPOCHS = 3
#: The learner's rate and smoothing, and the elastic net's two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: Of five parts of the rows by doc_id, the first is held out and the second sets the temperature.
PARTS = 5
UNKNOWN = "und"
#: A document is rejected below this score.
LEAST_SCORE = 0.5


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    temperature: float = 1.0


def part(doc_id: Column | str = "doc_id") -> Column:
    """The part of a row: crc32 of its doc_id as text, modulo five; a null doc_id is never held out."""
    number = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(number.cast("string").cast("binary")) % PARTS, F.lit(2))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a whole text and how often each occurs."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    hashed, run = [], None
    for length in LENGTHS:
        if len(codes) < length:
            break
        last = codes[length - 1 :]
        run = last * np.uint32(0x9E3779B1) if run is None else (run[: len(last)] ^ last) * np.uint32(0x85EBCA77)
        mixed = (run ^ (run >> np.uint32(15))) * np.uint32(0xC2B2AE3D + 2 * length)
        hashed.append(mixed >> np.uint32(33 - FEATURES.bit_length()))
    total = np.bincount(np.concatenate(hashed), minlength=FEATURES)
    found = np.flatnonzero(total)
    return found, total[found]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TF-IDF values of unit length and, last, the constant feature."""
    at, n = counts(text)
    values = (1 + np.log(n)) * idf[at]
    length = np.sqrt((values * values).sum())
    values = values / length if length else values
    return np.append(at, FEATURES).astype(np.int32), np.append(values, 1.0).astype(np.float32)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, rows = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            found[counts(text.as_py())[0]] += 1
            rows += 1
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_pydict(
        {"feature": np.append(at, FEATURES).astype(np.int64), "n": np.append(found[at], rows).astype(np.int64)}
    )


def _softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int) -> np.ndarray:
    """Weights by follow-the-regularised-leader; those that stay within the first penalty are zero."""
    z = np.zeros((FEATURES + 1, n_languages))
    n = np.zeros_like(z)

    def weights(at) -> np.ndarray:
        held = np.sign(z[at]) * L1 - z[at]
        return np.where(np.abs(z[at]) <= L1, 0.0, held / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, values, label in examples:
            now = weights(at)
            wrong = _softmax(values @ now)
            wrong[label] -= 1
            gradient = values[:, None] * wrong
            grown = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * now
            n[at] = grown
    return weights(slice(None)).astype(np.float32)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which the labels are likeliest, by golden section."""
    if not len(labels):
        return 1.0

    # The labels are softened by one row more and one less, or no errors would mean no doubt.
    doubt = 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        logs = np.log(np.maximum(_softmax(scores / np.exp(t)), 1e-300))
        return -((1 - doubt) * logs[np.arange(len(labels)), labels].mean() + doubt * logs.mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, right) if loss(left) <= loss(right) else (left, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model learned from ``text`` and ``lang`` of the rows that aren't held out.

    Languages are those found there; none gives a model that knows nothing. The rows to fit on are
    chosen by a hash of doc_id under a share for each language that keeps them near ``sample``
    in all; their features, and the document frequencies, are what comes to the driver.
    """
    open_rows = docs.select("doc_id", "text", "lang", part().alias("part")).filter(
        "part <> 0 and lang is not null and text is not null"
    )
    totals = {row["lang"]: row["n"] for row in open_rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model()
    found = (
        open_rows.select("text")
        .mapInArrow(_document_frequencies, "feature long, n long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    frequency = np.zeros(FEATURES + 1)
    frequency[found["feature"]] = found["n"]
    idf = (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1).astype(np.float32)
    each = sample / len(languages)
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, each / totals[lang]))])
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11).cast("double") / float(1 << 53)

    @F.pandas_udf("struct<at array<int>, value array<float>>")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            both = [vector(text, idf) for text in batch]
            yield pd.DataFrame({"at": [x[0] for x in both], "value": [x[1] for x in both]})

    chosen = settle(open_rows.filter(drawn < F.element_at(shares, F.col("lang"))), "sample")
    rows = chosen.select("doc_id", "part", "lang", vectors("text").alias("x")).select("doc_id", "part", "lang", "x.*").toArrow()
    order = np.random.default_rng(0).permutation(np.argsort(rows["doc_id"].to_numpy(zero_copy_only=False), kind="stable"))
    at, values = rows["at"].combine_chunks(), rows["value"].combine_chunks()
    parts, names = rows["part"].to_pylist(), rows["lang"].to_pylist()
    label = {lang: i for i, lang in enumerate(languages)}
    examples = [(at[i].values.to_numpy(), values[i].values.to_numpy(), label[names[i]], parts[i]) for i in map(int, order)]
    weights = ftrl([x[:3] for x in examples if x[3] != 1], len(languages))
    held = [x for x in examples if x[3] == 1]
    scores = np.array([x[1] @ weights[x[0]] for x in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights, temperature(scores, np.array([x[2] for x in held], int)))


def predictions(docs: DataFrame, text: str, model: Model) -> Column:
    """A struct of ``lang`` and ``score`` for every text; ``und`` and 0 where there is no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang string, score double>")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in texts:
            langs, scores = [], []
            for whole in batch:
                lang, score = UNKNOWN, 0.0
                if known.languages and whole is not None and any(map(str.isalpha, whole)):
                    at, values = vector(whole, known.idf)
                    chances = _softmax(values @ known.weights[at] / known.temperature)
                    best = int(chances.argmax())
                    lang, score = known.languages[best], float(chances[best])
                langs.append(lang)
                scores.append(score)
            yield pd.DataFrame({"lang": langs, "score": scores})

    return predict(F.col(f"`{text}`"))


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    A null text and one without letters have ``und`` and score 0, and so has every text if there
    was nothing to learn from. Repeated rows are rows of their own; an empty table gives no rows.
    """
    model = fit(docs) if model is None else model
    said = predictions(docs, "text", model).alias("said")
    return docs.select("doc_id", (part() == 0).alias("held_out"), said).select(
        "doc_id", "held_out", F.col("said.lang").alias("lang_pred"), "said.score"
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a known language of a score of at least ``LEAST_SCORE``."""
    said = fresh(docs, "said")
    judged = docs.withColumn(said, predictions(docs, "text", fit(docs)))
    sure = (F.col(f"{said}.lang") != UNKNOWN) & (F.col(f"{said}.score") >= LEAST_SCORE)
    return judged.filter(sure).select(*[F.col(f"`{c}`") for c in docs.columns])
