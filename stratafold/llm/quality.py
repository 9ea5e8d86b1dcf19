"""Document quality: regularised quadratic discriminant analysis over document statistics.

Each whole text gives ``len(NAMES)`` transformed statistics.  Class means and
covariances come from all usable labelled rows: the sums of the statistics and of
their products are one distributed aggregate, two rows reach the driver.  Covariances
are shrunk towards the pooled covariance and its diagonal; scores are differences of
Gaussian log-densities from Mahalanobis distances by Cholesky factors that are computed
once and broadcast.

Defined results: null and empty texts have the statistics of an empty text and are
scored; null ids are scored and never trained on; null labels are not used; repeated
label rows count as often as they appear; unless both classes have two rows or more
every score is 0.5; other columns are ignored or, in ``drop_rejected``, carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stratafold.llm.arrow import map_texts, slices
from stratafold.scratch import materialize

NAMES = ("length", "word_length", "symbols", "capitals", "digits", "stops", "lines", "distinct", "stutter", "commonest", "line_repeats")
#: Weight of the pooled covariance in a class's own, and of the diagonal in either.
POOLED = 0.2
DIAGONAL = 0.1
#: Least variance of a standardised statistic.
FLOOR = 0.05

_KIND = np.zeros(256, np.uint8)
_KIND[np.frombuffer(b"#$%&*+/<=>@\\^_`|~!{}[]", np.uint8)] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[128:] = 3
_KIND[48:58] = 4
_KIND[np.frombuffer(b".,;:?", np.uint8)] = 5


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of one text, in the order of ``NAMES``."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(NAMES)
    kinds = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=6)
    letters = kinds[2] + kinds[3]
    lines = [x for x in text.split("\n") if x]
    counted = Counter(words)
    return (
        np.log1p(n),
        np.log(len(text) / n),
        np.sqrt(kinds[1] / n),
        np.sqrt(kinds[2] / (letters + 1)),
        np.sqrt(kinds[4] / n),
        np.sqrt(kinds[5] / n),
        np.sqrt(len(lines) / n),
        np.log1p(n / len(counted)) / np.log1p(np.log1p(n)),
        np.sqrt(sum(map(eq, words, words[1:])) / n),
        np.sqrt(max(counted.values()) / n),
        np.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
    )


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rid: str | None = None) -> DataFrame:
    """doc_id (and rid) with one double column per statistic, for every row."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), *([F.col(rid).alias("rid")] if rid else []), F.col(text).alias("text"))
    def computed(texts: list) -> tuple[None, list[pa.Array]]:
        table = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(NAMES))
        return None, [pa.array(column) for column in table.T]

    return map_texts(chosen, computed, ", ".join(f"{n} double" for n in NAMES))


class Discriminant:
    """Fitted classes: standardisation, means, inverse Cholesky factors, log terms."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> None:
        """moments: by class the row count, the sums and the sums of products."""
        self.ready = all(moments.get(y, (0,))[0] >= 2 for y in (0, 1))
        if not self.ready:
            return
        total = sum(m[0] for m in moments.values())
        self.centre = sum(m[1] for m in moments.values()) / total
        spread = sum(m[2] for m in moments.values()) / total - np.outer(self.centre, self.centre)
        self.scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
        means, covs = {}, {}
        for y, (n, sums, products) in moments.items():
            mean = sums / n
            means[y] = (mean - self.centre) / self.scale
            covs[y] = (products / n - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
        pooled = sum(moments[y][0] * covs[y] for y in covs) / total
        self.classes = {}
        for y, cov in covs.items():
            mixed = (1 - POOLED) * cov + POOLED * pooled
            mixed = (1 - DIAGONAL) * mixed + DIAGONAL * np.diag(np.diag(mixed)) + FLOOR * np.eye(len(mixed))
            root = np.linalg.cholesky(mixed)
            self.classes[y] = (means[y], np.linalg.inv(root), np.log(moments[y][0] / total) - np.log(np.diag(root)).sum())

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """In [0, 1], one half where both classes are equally likely; log-scaled so far rows keep their order."""
        if not self.ready:
            return np.full(len(rows), 0.5)
        x = (rows - self.centre) / self.scale
        density = {y: log - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for y, (mean, inverse, log) in self.classes.items()}
        margin = density[1] - density[0]
        return 1 / (1 + np.exp(-np.sign(margin) * np.log1p(np.abs(margin))))


def fit(table: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Discriminant:
    """table: ``document_statistics``; all labelled rows that are not held out count."""
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    pairs = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)]
    products = [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    moments = {}
    for r in table.join(usable, "doc_id").groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect():
        square = np.zeros((len(NAMES), len(NAMES)))
        for i, j in pairs:
            square[i, j] = square[j, i] = r[f"p{i}_{j}"]
        moments[r["label"]] = (r["n"], np.array([r[f"s{i}"] for i in range(len(NAMES))]), square)
    return Discriminant(moments)


def score(table: DataFrame, model: Discriminant) -> DataFrame:
    """The id columns of ``document_statistics`` and a score for every row."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    ids = [c for c in table.columns if c not in NAMES]
    schema = StructType([*(table.schema[c] for c in ids), StructField("score", DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(n).to_numpy() for n in NAMES])
            made = pa.array(shared.value.scores(rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), made], names=schema.fieldNames())

    return table.mapInArrow(scored, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    table = materialize(document_statistics(docs), "quality-statistics")
    done = score(table, fit(table, labels))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the documents scored below ``threshold``, all columns kept.

    Once the classifier is fitted, texts are scored in the map that passes them on: nothing is joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(materialize(document_statistics(docs), "quality-statistics"), labels))
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(at)):
                part = batch.slice(start, end - start)
                rows = np.array([statistics(t) for t in part.column(at).to_pylist()], float).reshape(len(part), len(NAMES))
                yield part.filter(pa.array(shared.value.scores(rows) >= threshold))

    return docs.mapInArrow(kept, docs.schema)
