"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.sample import bounded_sample
from brindle.llm.text import mix

ORDERS = (1, 2, 3, 4)
#: Small samples are gone over until so many mini-batches have been seen.
MIN_STEPS = 1000
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


@dataclass(frozen=True)
class Model:
    """table[bucket] holds each language's score of a subword: its embedding through the linear layer."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(text: str, n_buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to 4 letters within words; letters in lower case, anything else is a border."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.where((codes < 65) | ((codes > 90) & (codes < 97)) | ((codes > 122) & (codes < 170)), 0, codes).astype(np.uint64)
    border = np.zeros(len(letters) + 2, np.uint64)
    border[1:-1] = letters
    out = []
    acc = np.zeros(len(border), np.uint64)
    whole = np.ones(len(border), bool)
    for j in range(max(ORDERS)):
        n = len(border) - j
        acc = acc[:n] * np.uint64(0x100000001B3) + border[j:] + np.uint64(j + 1)
        # a border may begin or end a subword but not lie inside it
        whole = whole[:n] & (True if j < 2 else border[j - 1 : j - 1 + n] != 0)
        keep = whole & ((border[:n] != 0) | (border[j:] != 0)) if j else border != 0
        if j + 1 in ORDERS:
            out.append((mix(acc[keep]) >> np.uint64(20)) % np.uint64(n_buckets))
    return np.concatenate(out).astype(np.int64)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _train(rows, n_buckets: int, dim: int, epochs: int, rate: float, seed: int, keep: float) -> Model:
    """SGD on mini-batches of documents; a fifth of them calibrates temperature and the rejection bound."""
    rng = np.random.default_rng(seed)
    langs = sorted({r.lang for r in rows})
    data = []
    for r in rows:
        b, c = np.unique(subwords(r.text, n_buckets), return_counts=True)
        if len(b):
            data.append((b, (c / c.sum()).astype(np.float32), langs.index(r.lang)))
    if not data:
        return Model(langs or ["und"], np.zeros((n_buckets, max(1, len(langs))), np.float32), np.zeros(max(1, len(langs)), np.float32), 1.0, 0.0)
    order = rng.permutation(len(data))
    hold, fit = order[: len(data) // 5], order[len(data) // 5 :]
    emb = rng.normal(0, 0.1, (n_buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    epochs = max(epochs, -(-MIN_STEPS * 16 // max(1, len(fit))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 16)):
            x = np.stack([data[i][1] @ emb[data[i][0]] for i in part])
            z = x @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), [data[i][2] for i in part]] -= 1
            back = p @ out.T
            out -= step / len(part) * (x.T @ p)
            bias -= step / len(part) * p.sum(0)
            for row, i in enumerate(part):
                emb[data[i][0]] -= step / len(part) * np.outer(data[i][1], back[row]) * 10
    table = emb @ out
    cal = hold if len(hold) else fit
    z = np.stack([data[i][1] @ table[data[i][0]] + bias for i in cal])
    y = np.asarray([data[i][2] for i in cal])

    def loss(t: float) -> float:
        q = z / t - (z / t).max(1, keepdims=True)
        return float(-(q[np.arange(len(y)), y] - np.log(np.exp(q).sum(1))).mean())

    t = min(np.geomspace(0.5, 10, 40), key=loss)
    q = np.exp(z / t - (z / t).max(1, keepdims=True))
    sure = np.sort((q / q.sum(1, keepdims=True)).max(1))
    return Model(langs, table, bias, float(t), float(min(sure[int((1 - keep) * len(sure))], 0.5)))


def train_language_model(docs: DataFrame, *, max_rows_per_lang: int = 600, n_buckets: int = 1 << 15, dim: int = 16, epochs: int = 12, rate: float = 3.0, keep: float = 0.999, seed: int = 11) -> Model:
    """Fit on a bounded sample: at most ``max_rows_per_lang`` labelled documents of each language (the documented bound),
    chosen by a hash of the row, whole texts. docs: doc_id, text, lang; null langs and texts are left out.

    ``keep`` is the share of calibration documents that must not be rejected; the bound is at most 0.5.
    """
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    rows = sorted(bounded_sample(labelled, max_rows_per_lang, seed, "lang"), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text, r.lang))
    return _train(rows, n_buckets, dim, epochs, rate, seed, keep)


def _predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    langs, scores, rejected = [], [], []
    for text in texts:
        if not text or not _has_letter(text):
            langs.append("und")
            scores.append(0.0)
            rejected.append(True)
            continue
        b = subwords(text, len(model.table))
        z = (model.table[b].sum(0, dtype=np.float64) / max(1, len(b)) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        langs.append(model.langs[k])
        scores.append(float(p[k]))
        rejected.append(bool(p[k] < model.reject_below))
    return langs, scores, rejected


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """Language of every whole text: (doc_id, lang_pred, score, rejected), a map without a shuffle.

    ``score`` is the calibrated probability. A null text or one without letters is ``und`` with score 0 and is
    rejected; so is a text whose score is below the model's bound (it keeps its best language). Repeated rows each get
    a row. The model (buckets x languages floats) is of a size fixed by parameters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = _predict(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all their columns, that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = _predict(shared.value, batch.column(at).to_pylist())[2]
            yield batch.filter(pa.array([not x for x in rejected]))

    return docs.mapInArrow(run, docs.schema)
