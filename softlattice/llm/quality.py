"""Quality classifier by co-training (Blum and Mitchell, COLT 1998).

Two views of a document.  Its text: hashed words (how often each comes, by its
logarithm, scaled to length one), and shares of its bytes, words and lines that
are digits, capitals, marks, repeats.  Its page metadata: lang and source, and
nothing that the text tells.  Each view has a softmax classifier of two classes,
fitted by Newton's method.  In every round each classifier labels the unlabelled
documents it is surest of, in the proportions of the labels, for the other one to
learn from.  Both are calibrated (Platt) on labelled rows kept out of the rounds,
and the score adds their log-odds less the prior's.

Labels are read only from rows with crc32(doc_id as text) mod 5 <> 0, at most
`max_labelled` of them; the pool of unlabelled documents has `max_unlabelled`;
all documents are scored, on their whole texts of any length.  Null or empty
texts, langs and sources are values of their own; of labels of one doc_id that
disagree the larger counts; with no labels, or labels of one class, every score
is that share (0.5 without any).  Repeated rows score alike; an empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import span_hash, utf8, words
from .toxicity import held_out
from .workspace import least, small_batches

#: Hashed words of the text view, hashed values of each column of the metadata view.
_WORDS, _HASHED = 192, 48
_KINDS = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*|<>{}[]@^~=+\\", ".!?", ",;:", "\"'()-")
_KIND = np.full(256, len(_KINDS), np.int64)
for _i, _chars in enumerate(_KINDS):
    _KIND[np.frombuffer(_chars.encode(), np.uint8)] = _i


def text_views(column: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    w = words(column)
    raw, offs = utf8(column)
    kind = _KIND[raw]
    again = np.zeros(len(raw), bool)
    again[1:] = (raw[1:] == raw[:-1]) & (kind[1:] < len(_KINDS))
    breaks = np.flatnonzero(raw == 10)
    starts = np.union1d(offs[:-1], breaks + 1)
    starts = starts[starts < len(raw)]
    line = span_hash(raw, starts, np.append(starts[1:], len(raw))) if len(starts) else np.zeros(0, np.uint64)
    out = np.zeros((len(offs) - 1, _WORDS + len(_KINDS) + 6))
    for i in range(len(out)):
        a, b, c, d = offs[i], offs[i + 1], w.doc[i], w.doc[i + 1]
        n, k = max(b - a, 1), max(d - c, 1)
        tf = np.log1p(np.bincount((w.hash[c:d] % np.uint64(_WORDS)).astype(np.int64), minlength=_WORDS))
        out[i, :_WORDS] = tf / max(np.sqrt((tf * tf).sum()), 1.0)
        lines = line[np.searchsorted(starts, a) : np.searchsorted(starts, b)]
        form = [math.log1p(n), math.log1p(k), (w.end[c:d] - w.start[c:d]).sum() / k, len(np.unique(w.hash[c:d])) / k, len(np.unique(lines)) / max(len(lines), 1), math.sqrt(again[a:b].sum() / n)]
        out[i, _WORDS:] = [*np.sqrt(np.bincount(kind[a:b], minlength=len(_KINDS) + 1)[:-1] / n), *form]
    return out


def meta_view(lang: str | None, source: str | None) -> list[float]:
    out = [0.0] * (2 * _HASHED)
    out[zlib.crc32(f"l|{lang}".encode()) % _HASHED] = 1.0
    out[_HASHED + zlib.crc32(f"s|{source}".encode()) % _HASHED] = 1.0
    return out


@dataclass
class View:
    """Standardised linear model of the log-odds and its Platt calibration."""

    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.coef[1:] + self.coef[0], -30, 30)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.margin(x) + self.b, -12, 12)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 15) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pen * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray, ridge: float = 5.0) -> View:
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    return View(mean, scale, _newton((x - mean) / scale, y, ridge))


@dataclass
class QualityModel:
    prior: float
    text: View | None = None
    meta: View | None = None

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of label 1: of the text view, of the metadata view, of both."""
        sig = lambda z: 1 / (1 + np.exp(-z))
        if self.text is None:
            same = np.full(len(text), self.prior)
            return same, same, same
        t, m = self.text.calibrated(text), self.meta.calibrated(meta)
        return sig(t), sig(m), sig(t + m - math.log(self.prior / (1 - self.prior)))


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, u_text: np.ndarray, u_meta: np.ndarray, rounds: int = 5, share: float = 0.05) -> QualityModel:
    """y: 0/1 labels of the labelled rows; u_: the views of unlabelled rows."""
    if not len(y):
        return QualityModel(0.5)
    prior = float(y.mean())
    if prior in (0.0, 1.0) or len(y) < 10:
        return QualityModel(prior)
    apart = np.arange(len(y)) % 4 == 3  # for calibration
    if y[apart].min() == y[apart].max() or y[~apart].min() == y[~apart].max():
        apart[:] = False
    views, labelled = {"text": (text, u_text), "meta": (meta, u_meta)}, ~apart
    extra = {"text": {}, "meta": {}}  # row of u -> pseudo-label
    fitted: dict[str, View] = {}

    def refit(name: str) -> None:
        x, u = views[name]
        rows = np.array(sorted(extra[name]), int)
        xs, ys = np.concatenate([x[labelled], u[rows]]), np.concatenate([y[labelled], [extra[name][r] for r in rows]])
        fitted[name] = fit_view(xs, ys.astype(float))

    for name in views:
        refit(name)
    for _ in range(rounds):
        for name, other in (("text", "meta"), ("meta", "text")):
            u = views[name][1]
            if not len(u):
                continue
            m = fitted[name].margin(u)
            order, n = np.argsort(m, kind="stable"), int(len(u) * share)
            low, high = order[: round(n * (1 - prior))], order[len(u) - round(n * prior) :]
            sure = np.abs(m) > 1.5  # only what it is confident of
            extra[other].update({int(r): 0 for r in low if sure[r] and m[r] < 0} | {int(r): 1 for r in high if sure[r] and m[r] > 0})
        for name in views:
            refit(name)
    check = apart if apart.any() else labelled
    for name in views:
        v = fitted[name]
        w = _newton(v.margin(views[name][0][check])[:, None], y[check].astype(float), 1e-2)
        v.b, v.a = float(w[0]), float(max(w[1], 0.0))
    return QualityModel(prior, fitted["text"], fitted["meta"])


_META = ("lang", "source")


def _views(batch) -> tuple[np.ndarray, np.ndarray]:
    col = lambda c: batch.column(batch.schema.get_field_index(c))
    return text_views(col("text")), np.array([meta_view(*m) for m in zip(*(col(c).to_pylist() for c in _META), strict=True)], float).reshape(batch.num_rows, -1)


def _featurise(batches):
    for batch in batches:
        if batch.num_rows:
            t, m = _views(batch)
            both = lambda x: pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), both(t), both(m)], names=["doc_id", "t", "m"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, max_unlabelled: int = 8000) -> QualityModel:
    spark = docs.sparkSession
    small_batches(spark)
    known = least(labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id")).select("doc_id", "quality"), "doc_id", max_labelled, "quality")
    known = {r[0]: r[1] for r in known.orderBy("quality").collect()}
    more = [r[0] for r in least(docs.where("doc_id is not null").select("doc_id"), "doc_id", max_unlabelled).collect()]
    ids = spark.createDataFrame([(i,) for i in {*known, *more}], "doc_id long")  # bounded by both parameters
    some = docs.select("doc_id", "text", *_META).join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_featurise, "doc_id long, t array<double>, m array<double>")
    table = some.groupBy("doc_id").agg(F.min(F.struct("t", "m")).alias("x")).select("doc_id", "x.t", "x.m").orderBy("doc_id").toArrow()
    ids = table.column("doc_id").to_pylist()
    dense = lambda c: np.array(table.column(c).combine_chunks().flatten()).reshape(len(ids), -1) if ids else np.zeros((0, 1))
    t, m = dense("t"), dense("m")
    has = np.array([i in known for i in ids], bool)
    y = np.array([known[i] for i in ids if i in known], float)
    return cotrain(t[has], m[has], y, t[~has], m[~has])


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score and keep (score >= 0.5) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, shared.value.score(*_views(batch)))], names=["doc_id", "text_score", "meta_score", "score"])

    out = docs.select("doc_id", "text", *_META).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("keep"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
