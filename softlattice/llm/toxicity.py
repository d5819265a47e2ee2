"""Toxicity: non-negative positive-unlabelled learning (Kiryo et al., NIPS 2017).

Confirmed toxic documents are the positives, a hash sample of all texts the
unlabelled set.  A linear model counts, over a text's distinct words, the words
themselves and their prefixes; it is fitted by the class-prior-corrected risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the log-loss; where the bracket turns negative the step goes the other
way, as the paper has it.  Scoring is one map over whole texts.

Nulls and empty texts have no features and score by the intercept; texts of any
length are read whole.  Without one confirmed toxic example every score is 0; a
doc_id that one label row calls toxic is a positive, whatever another says.  A
score of exactly 0.5 counts as toxic.  Repeated rows score alike; an empty table
gives no rows; extra columns are passed on by `toxicity_filter` and never read.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import least, release, small_batches

DIMS = 1 << 18
_WORD = re.compile(r"\w+")
_PREFIXES = (3, 4, 5, 6)


@dataclass
class ToxicityModel:
    """Weights by hashed feature, and the intercept; None where there was nothing to learn."""

    weights: dict[int, float] | None
    intercept: float = 0.0


def word_features(word: str) -> tuple[int, ...]:
    """Hashed ids of a lower-cased word: itself, and its prefixes, which mark word families."""
    keys = ["w|" + word] + [f"p|{word[:n]}" for n in _PREFIXES if len(word) > n]
    return tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) & (DIMS - 1) for k in keys)


def _distinct(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _featurise(batches):
    for batch in batches:
        ids = []
        for text in batch.column("text").to_pylist():
            ids.append(sorted(i for word in _distinct(text) for i in word_features(word)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _sample(docs: DataFrame, ids: DataFrame) -> list[np.ndarray]:
    """Features of the documents in ids, of which there are n at most; the same rows every time."""
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_featurise, "doc_id long, ids array<int>")
    table = rows.groupBy("doc_id").agg(F.min("ids").alias("ids")).orderBy("doc_id").toArrow()
    return [np.asarray(x.values, np.int32) for x in table.column("ids")] if table.num_rows else []


def _counts(rows: list[np.ndarray]) -> np.ndarray:
    """How many rows hold each id; one row at a time, so that no copy of them all is made."""
    out = np.zeros(DIMS)
    for row in rows:
        out[np.unique(row)] += 1
    return out


def _csr(rows: list[np.ndarray], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and selected column of each set feature; index maps a hashed id to its column or -1."""
    columns = [c[c >= 0] for c in (index[row] for row in rows)]
    if not columns:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.repeat(np.arange(len(rows)), [len(c) for c in columns]), np.concatenate(columns)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, features: int = 4096, least: int = 3, rounds: int = 400, rate: float = 0.05, decay: float = 1e-3) -> ToxicityModel:
    """Fit on feature-id arrays; `features` ids are chosen by how far their share among positives lies from that among unlabelled, of those in `least` positives (or texts, where rarer among positives)."""
    if not positive:
        return ToxicityModel(None)
    np_, nu = len(positive), max(len(unlabelled), 1)
    p, u = _counts(positive) / np_, _counts(unlabelled) / nu
    both = (p * np_ + u * nu) / (np_ + nu)
    z = (p - u) / np.sqrt(both * (1 - both) * (1 / np_ + 1 / nu) + 1e-6)
    z = np.where(np.where(z > 0, p * np_, p * np_ + u * nu) > least - 0.5, z, 0.0)
    chosen = np.argsort(-np.abs(z), kind="stable")[:features]
    chosen = np.sort(chosen[np.abs(z[chosen]) > 2.0])
    index = np.full(DIMS, -1, np.int64)
    index[chosen] = np.arange(len(chosen))
    (pr, pcol), (ur, ucol) = _csr(positive, index), _csr(unlabelled, index)
    d = len(chosen)
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = np.log(prior / (1 - prior))
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    soft = lambda x: np.logaddexp(0, x)
    for t in range(1, rounds + 1):
        fp = np.bincount(pr, w[pcol], minlength=np_)[:np_] + w[d]
        fu = np.bincount(ur, w[ucol], minlength=nu)[:nu] + w[d]
        bracket = soft(fu).mean() - prior * soft(fp).mean()
        if bracket >= 0:  # d softplus(f) = sig(f), d softplus(-f) = -sig(-f)
            gp, gu = -prior * sig(-fp) / np_ - prior * sig(fp) / np_, sig(fu) / nu
        else:
            gp, gu = prior * sig(fp) / np_, -sig(fu) / nu
        g = np.append(np.bincount(pcol, gp[pr], minlength=d)[:d] + np.bincount(ucol, gu[ur], minlength=d)[:d], gp.sum() + gu.sum())
        g[:d] += decay * w[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return ToxicityModel({int(k): float(x) for k, x in zip(chosen, w[:d], strict=True) if abs(x) > 1e-4}, float(w[d]))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 8000) -> ToxicityModel:
    """Fit on at most `max_positive` confirmed toxic documents and `max_unlabelled` unlabelled ones.

    Only label rows with crc32(doc_id as text) mod 5 <> 0 are read.  The samples
    are the rows of least hash, so they do not depend on the partitioning; their
    ids, bounded by the two parameters, are broadcast to the one scan of texts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).select("doc_id", "toxic")
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not toxic:
        return ToxicityModel(None)
    small_batches(docs.sparkSession)
    positive = _sample(docs, least(known.where("toxic = 1").select("doc_id"), "doc_id", max_positive))
    unlabelled = _sample(docs, least(docs.where("doc_id is not null").select("doc_id"), "doc_id", max_unlabelled))
    prior = min(max(toxic / n, 1 / n), 0.9)
    model = fit_nnpu(positive, unlabelled, min(prior, 1 - 1e-3))
    del positive, unlabelled
    release(docs.sparkSession)
    return model


class Scorer:
    """Scores texts; keeps what a word weighs, since words come again."""

    def __init__(self, model: ToxicityModel):
        self.model, self.seen = model, {}

    def __call__(self, text: str | None) -> float:
        if self.model.weights is None:
            return 0.0
        seen, weights, parts = self.seen, self.model.weights, []
        for word in _distinct(text):
            part = seen.get(word)
            if part is None:
                if len(seen) > 300_000:
                    seen.clear()
                part = seen[word] = sum(weights.get(i, 0.0) for i in word_features(word))
            if part:
                parts.append(part)
        x = math.fsum([self.model.intercept, *parts])  # exact, so the order of a set doesn't matter
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _shared(spark: SparkSession, model: ToxicityModel):
    return spark.sparkContext.broadcast(model)  # at most `features` weights


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = _shared(spark, model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = pa.array([scorer(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_filter(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows, with all their columns, that score below 0.5."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = _shared(spark, model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            keep = pa.array([scorer(t) < 0.5 for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], pa.bool_())
            yield batch.filter(pc.fill_null(keep, True))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity_scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
