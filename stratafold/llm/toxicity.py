"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document is the set of hashed character n-grams (of its UTF-8 bytes, A-Z in lower
case) of its whole text.  Each n-gram's presence is scaled by the log ratio of its
smoothed frequencies among toxic and other documents, and logistic regression with
an L2 penalty is trained on the scaled features.

The classifier is fitted on at most ``FIT_ROWS`` labelled rows of each class, chosen
by a hash of the id (the rows are found by a top-k over the labels and joined by
broadcasting those few ids, and each sends at most 32 KiB to the driver); scoring covers every row and whole texts, one document at
a time in fixed memory, without a shuffle.

Defined results: null and empty texts have no n-grams and get the score of the
intercept; rows with a null id are scored and never trained on; null labels are not
used; repeated rows count as often as they appear (four times ``FIT_ROWS`` rows in all at most); without rows of both classes
the score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.arrow import map_texts

#: Labelled rows of each class used at most for fitting.
FIT_ROWS = 1500
#: Length of the n-grams in bytes, bits of the feature hash.
SIZES = (3, 4, 5, 6)
BITS = 18
#: Bytes of a text handled at once.
CHUNK = 1 << 20
#: Smoothing of the counts, standard errors of a used feature, L2 penalty, gradient steps and their rate.
SMOOTHING = 1.0
SIGNIFICANT = 3.0
PENALTY = 1e-2
STEPS = 120
RATE = 0.02
#: How far the intercept goes from equal classes to the labels' own shares (1: all the way).
PRIOR = 0.5

_ODD = 0x9E3779B1
_MIX = 0x85EBCA6B


def features(text: str | None, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text, unsorted and with repeats (uint32), for ``CHUNK`` of its bytes at a time.

    Chunks overlap by one byte less than the longest n-gram, so none is lost; those in the overlap come twice.
    """
    whole = (text or "").encode("utf-8", "surrogatepass")
    for at in range(0, max(1, len(whole) - max(SIZES) + 1), CHUNK):
        data = np.frombuffer(whole[at : at + CHUNK + max(SIZES) - 1].lower(), np.uint8).astype(np.uint32)
        rolled, power = np.zeros(len(data), np.uint32), 1
        for n in range(1, max(SIZES) + 1):
            if len(data) < n:
                break
            rolled = rolled[: len(data) - n + 1] + data[n - 1 :] * np.uint32(power)
            power = power * _ODD & 0xFFFFFFFF
            if n in SIZES:
                mixed = (rolled ^ np.uint32(n)) * np.uint32(_MIX)
                mixed ^= mixed >> np.uint32(15)
                yield mixed * np.uint32(_ODD) >> np.uint32(32 - bits)


def presence(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct hashes of a text in ascending order (uint32)."""
    seen = np.zeros(1 << bits, bool)
    for found in features(text, bits):
        seen[found] = True
    return np.flatnonzero(seen).astype(np.uint32)


def packed(text: str | None, bits: int = BITS) -> bytes:
    """``presence`` as its numbers or, if that is shorter, as a bitmap: never over 2 ** bits / 8 bytes."""
    found = presence(text, bits)
    if 4 * len(found) < (1 << bits) // 8:
        return found.tobytes()
    seen = np.zeros(1 << bits, bool)
    seen[found] = True
    return np.packbits(seen).tobytes()


def unpacked(data: bytes, bits: int = BITS) -> np.ndarray:
    if len(data) == (1 << bits) // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).astype(np.uint32)
    return np.frombuffer(data, np.uint32)


def fit(rows: list[bytes], labels: np.ndarray, bits: int = BITS, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights by feature (ratio times coefficient) and the intercept; zeros unless both classes are there.

    rows: the ``packed`` features of each text.  Features whose presence differs between the
    classes by less than ``SIGNIFICANT`` standard errors keep the weight 0.
    """
    total = 1 << bits
    if len(set(labels.tolist())) < 2:
        return np.zeros(total, np.float32), 0.0
    toxic = labels.astype(bool)
    counts = np.zeros((2, total))
    for row, y in zip(rows, toxic, strict=True):
        counts[int(y), unpacked(row, bits)] += 1
    n_other, n_toxic = (~toxic).sum(), toxic.sum()
    p_other, p_toxic = (counts[0] + SMOOTHING) / (n_other + 2 * SMOOTHING), (counts[1] + SMOOTHING) / (n_toxic + 2 * SMOOTHING)
    ratio = np.log(p_toxic) - np.log(p_other)
    error = np.sqrt(p_toxic * (1 - p_toxic) / n_toxic + p_other * (1 - p_other) / n_other)
    used = np.abs(p_toxic - p_other) >= SIGNIFICANT * error
    kept = [found[used[found]].astype(np.int32) for found in (unpacked(row, bits) for row in rows)]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in kept])
    flat = np.concatenate(kept)
    value = ratio[flat]
    share = np.where(toxic, 0.5 / n_toxic, 0.5 / n_other)  # both classes weigh the same
    coef, bias = np.zeros(total), 0.0
    first, second, bias_first, bias_second = np.zeros(total), np.zeros(total), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(owner, value * coef[flat], len(rows)) + bias
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic) * share
        slope, slope_bias = np.bincount(flat, miss[owner] * value, total) + PENALTY * coef, miss.sum()
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        bias_first, bias_second = 0.9 * bias_first + 0.1 * slope_bias, 0.99 * bias_second + 0.01 * slope_bias**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        coef -= RATE * (first / fix1) / (np.sqrt(second / fix2) + 1e-6)
        bias -= RATE * (bias_first / fix1) / (np.sqrt(bias_second / fix2) + 1e-8)
    return (ratio * coef).astype(np.float32), float(bias)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features_of(texts: list) -> tuple[None, list[pa.Array]]:
    return None, [pa.array([packed(t) for t in texts], pa.binary())]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Weights and intercept from at most ``fit_rows`` labelled rows of each class."""
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id", F.lit(29)), "doc_id"]
    picked = [usable.where(F.col("toxic") == y).orderBy(*order).limit(fit_rows) for y in (0, 1)]
    # At most twice fit_rows ids: a size bound by parameter.
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id")
    found = map_texts(rows.select("toxic", "text"), _features_of, "features binary")
    got = found.orderBy(F.xxhash64("features", "toxic")).limit(4 * fit_rows).collect()  # so many at most, also where ids repeat
    got.sort(key=lambda r: (r["toxic"], r["features"]))
    weights, bias = fit([r["features"] for r in got], np.array([r["toxic"] for r in got]))
    seen = {r["toxic"]: r["count"] for r in usable.where(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    if weights.any():  # fitted as if both classes were equally common
        bias += PRIOR * float(np.log(seen[1] / seen[0]))
    return weights, bias


def score_texts(texts: list, weights: np.ndarray, bias: float) -> np.ndarray:
    seen, out = np.zeros(len(weights), bool), np.empty(len(texts))
    for i, t in enumerate(texts):
        marked = []
        for found in features(t):
            seen[found] = True
            if marked is not None:
                marked = [*marked, found] if len(marked) < len(SIZES) else None
        out[i] = weights[seen].sum(dtype=np.float64) + bias
        for found in marked or [slice(None)]:  # of a text of several chunks all marks go
            seen[found] = False
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and score in [0, 1]."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: list) -> tuple[None, list[pa.Array]]:
        return None, [pa.array(score_texts(texts, *shared.value))]

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), scored, "score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    done = score(docs, train(docs, labels))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
