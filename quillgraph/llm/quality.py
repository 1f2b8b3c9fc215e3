"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (logs of lengths, square
roots of shares). Per class, counts, sums and products are added up over all
labelled training rows; nothing else reaches the driver. A class covariance is
shrunk towards the pooled one by ``ALPHA`` and towards its mean variance (of
standardised statistics) by ``GAMMA``; its Cholesky factor is computed once and
kept with the model. A score is the logistic function of the difference of the
log densities, each a Mahalanobis term and a log determinant, and of the log
priors.

Defined cases: a null text is empty; a row without a label is scored only;
labels with a null quality or doc_id, or without a document, teach nothing;
repeated rows and labels count as often as they occur; without two classes
every score is 0.5; an empty table gives no rows; more columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.storage import materialize

THRESHOLD = 0.3
ALPHA = 0.1
GAMMA = 0.02
CLASSES = (0, 1)
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "stop", "comma", "exclaim", "bar", "symbol",
    "other_punctuation", "distinct_words", "distinct_lines", "line_words", "wide_bytes", "repeat_run", "entropy",
)
_SYMBOLS = np.frombuffer(b"#$%&*@^~=+<>\\", np.uint8)
_OTHER = np.frombuffer(b"\"'()-/:;?[]_`{}", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of STATISTICS."""
    data = (text or "").encode()
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    w = len(words)
    share = lambda k: float(np.sqrt(k / max(n, 1)))
    p = counts[counts > 0] / max(n, 1)
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(n), np.log1p(w), np.log1p(n / max(w, 1)), share(counts[65:91].sum()), share(counts[48:58].sum()),
        share(counts[32] + counts[9:14].sum()), share(counts[46]), share(counts[44]), share(counts[33]), share(counts[124]),
        share(counts[_SYMBOLS].sum()), share(counts[_OTHER].sum()), len(set(words)) / max(w, 1) * (1 + np.log1p(w) / 10),
        len(set(lines)) / len(lines), np.log1p(w / len(lines)), share(counts[128:].sum()), float(np.sqrt(same / max(w, 1))),
        float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Model:
    """Per class: prior, mean, Cholesky factor of the shrunk covariance and its log determinant; and the scaling."""

    center: np.ndarray
    scale: np.ndarray
    log_prior: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        z = (x - self.center) / self.scale
        logs = []
        for c in range(2):
            whitened = np.linalg.solve(self.factors[c], (z - self.means[c]).T)
            logs.append(self.log_prior[c] - 0.5 * (self.log_dets[c] + (whitened**2).sum(axis=0)))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit_sums(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], alpha: float = ALPHA, gamma: float = GAMMA) -> Model | None:
    """A model from each class's count, sum and sum of outer products; None without two classes."""
    if any(c not in sums or sums[c][0] < 1 for c in CLASSES):
        return None
    n = sum(s[0] for s in sums.values())
    center = sum(s[1] for s in sums.values()) / n
    spread = np.diag(sum(s[2] for s in sums.values())) / n - center**2
    scale = np.sqrt(np.where(spread > 1e-12, spread, 1.0))
    means, covariances = [], []
    for c in CLASSES:
        k, s, ss = sums[c]
        mean = s / k
        means.append((mean - center) / scale)
        covariances.append((ss / k - np.outer(mean, mean)) / np.outer(scale, scale))
    counts = np.array([sums[c][0] for c in CLASSES], float)
    pooled = (counts[0] * covariances[0] + counts[1] * covariances[1]) / n
    factors, dets = [], []
    for cov in covariances:
        cov = (1 - alpha) * cov + alpha * pooled
        cov = (1 - gamma) * cov + gamma * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        factors.append(factor)
        dets.append(2 * np.log(np.diag(factor)).sum())
    return Model(center, scale, np.log(counts / n), np.array(means), np.array(factors), np.array(dets))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def featurize(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the whole text."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.select("doc_id", stats("text").alias("x"))


def fit(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, gamma: float = GAMMA) -> Model | None:
    """Learn from all labelled rows of ``features`` that are not held out."""
    taught = labels.filter(F.col("quality").isin(*CLASSES) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    rows = features.join(taught, "doc_id").select("label", "x")

    def add_up(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            label = batch.column("label").to_numpy()
            x = np.asarray(batch.column("x").flatten()).reshape(len(label), -1)
            for c in CLASSES:
                own = x[label == c]
                if len(own):
                    old = sums.get(c, [0, 0.0, 0.0])
                    sums[c] = [old[0] + len(own), old[1] + own.sum(axis=0), old[2] + own.T @ own]
        for c, (n, s, ss) in sums.items():
            yield pa.RecordBatch.from_pydict({"label": pa.array([c], pa.int32()), "v": [[float(n), *s, *ss.ravel()]]})

    parts = rows.mapInArrow(add_up, "label int, v array<double>").select("label", F.posexplode("v").alias("i", "v"))
    total: dict[int, dict[int, float]] = {}
    for label, i, v in parts.groupBy("label", "i").agg(F.sum("v")).collect():  # 1 + p + p * p numbers per class
        total.setdefault(label, {})[i] = v
    p = len(STATISTICS)
    sums = {}
    for c, cells in total.items():
        v = np.array([cells[i] for i in range(len(cells))])
        sums[c] = (int(v[0]), v[1 : 1 + p], v[1 + p :].reshape(p, p))
    return fit_sums(sums, alpha, gamma)


def score_column(model: Model | None, x: Column) -> Column:
    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        if model is None or not len(rows):
            return pd.Series(np.full(len(rows), 0.5))
        return pd.Series(model.score(np.vstack(rows.to_numpy())))

    return score(x)


def text_score_column(model: Model | None, text: Column) -> Column:
    """The score straight from a text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(np.array([statistics(t) for t in texts])))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    features = materialize(featurize(docs), "quality-features")
    model = fit(features, labels)
    score = features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("x")).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    model = fit(materialize(featurize(docs), "quality-features"), labels)
    return docs.filter(text_score_column(model, F.col("text")) >= THRESHOLD)
