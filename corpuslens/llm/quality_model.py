"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, scan, stored

#: Share of the pooled covariance in each class covariance, and the ridge relative to the mean pooled variance.
POOLED_SHARE, RIDGE = 0.2, 1e-3
STATISTICS = [
    "words", "word_length", "distinct_words", "repeated_triples", "same_as_previous", "upper_case", "symbols", "exclamations", "punctuation",
    "digits", "distinct_lines",
]
_SYMBOLS, _PUNCTUATION = np.frombuffer(b"#*$%&|<>{}\\^~=_", np.uint8), np.frombuffer(b".,;:?", np.uint8)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; all shares of a text without words are zero."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0, *[float(np.log(0.02))] * (len(STATISTICS) - 1)]
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    triples = set(zip(words, words[1:], words[2:], strict=False))
    lines = data.split(b"\n")
    shares = [
        len(set(words)) / n,
        1 - len(triples) / max(1, n - 2) if n > 2 else 0.0,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        upper / max(1, upper + lower),
        int(seen[_SYMBOLS].sum()) / n,
        int(seen[33]) / n,
        int(seen[_PUNCTUATION].sum()) / n,
        int(seen[48:58].sum()) / n,
        len(set(lines)) / len(lines),
    ]
    letters = sum(map(len, words)) / n
    return [float(np.log1p(n)), float(np.log(letters)), *np.log(0.02 + np.array(shares)).tolist()]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [statistics(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its whole text."""
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _measured, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class means, and of each covariance the inverse Cholesky factor and the log-determinant, computed once."""

    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 from the difference of the two log densities."""
        logs = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(examples: DataFrame) -> Discriminant | None:
    """The discriminant of rows (x, label 0 or 1), from sums that Spark adds up; None if a class has no row.

    A class covariance is drawn to the pooled one, the more so the fewer rows the class has, and a ridge keeps it
    regular where a statistic never varies.
    """
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    columns = [F.col("x")[i].alias(f"x{i}") for i in range(d)]
    sums = [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(d)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]]
    rows = {r["label"]: r for r in examples.select("label", *columns).groupBy("label").agg(*sums).collect()}  # two rows at most
    if set(rows) != {0, 1}:
        return None
    n = np.array([rows[k]["n"] for k in (0, 1)], float)
    means = np.array([[rows[k][f"s{i}"] for i in range(d)] for k in (0, 1)]) / n[:, None]
    scatter = np.zeros((2, d, d))
    for k in (0, 1):
        for i, j in pairs:
            scatter[k, i, j] = scatter[k, j, i] = rows[k][f"p{i}_{j}"] - n[k] * means[k, i] * means[k, j]
    pooled = scatter.sum(axis=0) / n.sum()
    ridge = RIDGE * max(np.trace(pooled) / d, 1e-6) * np.eye(d)
    whiten, offsets = [], []
    for k in (0, 1):
        share = max(POOLED_SHARE, d / (d + n[k]))
        factor = np.linalg.cholesky((1 - share) * scatter[k] / n[k] + share * pooled + ridge)
        whiten.append(np.linalg.inv(factor))
        offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(offsets))


def _scored(batches: Iterator[pa.RecordBatch], model: Discriminant | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(STATISTICS))
        scores = model.scores(x) if model and len(x) else np.ones(len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])


def in_held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(statistics_: DataFrame, labels: DataFrame) -> DataFrame:
    """x and label of the labelled rows that are not held out; of contradicting labels the lower counts."""
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    return statistics_.where(~in_held_out("doc_id")).join(known, "doc_id").select("x", "label")


def score_documents(docs: DataFrame, examples: DataFrame) -> DataFrame:
    """doc_id and score, the probability of good quality, of each whole text by the discriminant of the examples.

    Null and empty texts are scored like texts without words; null doc_ids and repeated rows stay; with no example of
    a class nothing is rejected (score 1); an empty table gives no rows. Only doc_id and text are read.
    """
    return arrow_map(measured(docs), partial(_scored, model=fit(examples)), "doc_id long, score double")


def _good(batches: Iterator[pa.RecordBatch], model: Discriminant, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([statistics(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], float).reshape(-1, len(STATISTICS))
        yield batch.filter(pa.array(model.scores(x) >= least))


def good_documents(docs: DataFrame, examples: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose whole text scores at least `least` by the discriminant of the examples."""
    model = fit(examples)
    return docs if model is None else arrow_map(docs, partial(_good, model=model, least=least), docs.schema)


def op1_quality(spark, sf_dir):
    rows = stored(measured(scan(spark, sf_dir, "documents", "doc_id", "text")), "statistics")
    model = fit(training_rows(rows, scan(spark, sf_dir, "labels", "doc_id", "quality")))
    scored = arrow_map(rows, partial(_scored, model=model), "doc_id long, score double")
    return scored.select("doc_id", in_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
