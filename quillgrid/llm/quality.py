"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

A document's features are 32-bit hashes of its distinct words and their beginnings, of the shapes of its tokens (what is left
without lower-case letters) and of a few bucketed ratios. One weight per hash is shared by all grades;
ordered thresholds cut the score into grades: P(grade > k) = sigmoid(score - threshold_k). The expected
grade ranks documents and a tail probability selects them.

The model is fitted on at most `SAMPLE` labelled documents, those with the least hashes, whatever the
size of the tables; scoring reads every whole text. Only weights of features that occur in at least
`MIN_DOCS` sampled documents are kept, so what is broadcast is bounded by the sample.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import from_text, packed, table
from .decontamination import FOLD

SAMPLE = 8_000
MIN_DOCS = 5
ROUNDS = 200
PENALTY = 2e-4
GRADES = 3
BLOCK = 1 << 19
ACCEPT = 0.5
#: Lengths in bytes of the word beginnings that are features too: inflected and compound forms share them.
STEMS = (5, 6, 7, 8)

SHAPE = bytes(ord("X") if 65 <= c <= 90 else ord("9") if 48 <= c <= 57 else c for c in range(256))
LETTERS = bytes(c for c in range(256) if 97 <= c <= 122 or c >= 128)
RUN = re.compile(rb"(.)\1+", re.S)


def features(text: bytes | None) -> set[int]:
    """Hashes of the features of a text; null is empty."""
    text = text or b""
    words = text.translate(FOLD).split()
    distinct = set(words)
    digest = xxhash.xxh32_intdigest
    found = {digest(w, 1) for w in distinct}
    for k in STEMS:
        found.update(digest(w, 5) for w in {w[:k] for w in distinct if len(w) > k})
    found.update(digest(RUN.sub(rb"\1\1", s), 2) for s in set(text.translate(SHAPE, LETTERS).split()))
    lines = text.split(b"\n")
    ratios = (len(distinct) / max(1, len(words)), len(set(lines)) / len(lines), len(words) / max(1, len(text)))
    found.update(digest(b"%d=%d" % (k, int(10 * r)), 3) for k, r in enumerate(ratios))
    found.add(digest(b"%d" % len(words).bit_length(), 4))
    return found


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature hash, and the thresholds between grades, ascending."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def lookup(self) -> dict[int, float]:
        return dict(zip(self.hashes.tolist(), self.weights.tolist(), strict=True))

    def tails(self, score: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), .."""
        return [1.0 / (1.0 + math.exp(min(700.0, max(-700.0, t - score)))) for t in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def _frequent(hashes: np.ndarray, least: int) -> np.ndarray:
    """Hashes that occur at least `least` times, ascending; `hashes` is sorted in place."""
    hashes.sort()
    if least > 1:
        hashes = hashes[: len(hashes) - least + 1][hashes[: len(hashes) - least + 1] == hashes[least - 1 :]]
    return np.unique(hashes)


def _columns(hashes: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Places in `hashes` of those of `given` that are among them."""
    at = np.searchsorted(hashes, given)
    inside = at < len(hashes)
    at, given = at[inside], given[inside]
    return at[hashes[at] == given].astype(np.int32)


def _sums(into: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of values[of] by `into`, some at a time, so that no temporary is as long as the sample."""
    total = np.zeros(n)
    for k in range(0, len(into), BLOCK):
        total += np.bincount(into[k : k + BLOCK], values[of[k : k + BLOCK]], n)
    return total


def fit(rows: list[tuple[np.ndarray, int]], grades: int = GRADES, min_docs: int = MIN_DOCS, rounds: int = ROUNDS, penalty: float = PENALTY) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty on the weights, by accelerated proximal steps.

    Thresholds stay ordered because they are a first one plus positive gaps. Without rows every document
    has tail probabilities of almost 1.
    """
    if not rows:
        return OrdinalModel(np.zeros(0, np.uint32), np.zeros(0), np.full(grades - 1, -20.0) + np.arange(grades - 1) * 1e-3)
    y = np.array([g for _, g in rows])
    hashes = _frequent(np.concatenate([f for f, _ in rows]), min(min_docs, len(rows)))
    columns = [_columns(hashes, f) for f, _ in rows]
    row, column = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in columns]), np.concatenate(columns)
    del columns
    shares = np.array([(np.sum(y > k) + 0.5) / (len(y) + 1) for k in range(grades - 1)])
    start = -np.log(shares / (1 - shares))
    raw = np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    w = np.zeros(len(hashes))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(raw), np.zeros_like(raw)]
    for step in range(1, rounds + 1):
        theta = np.cumsum(np.r_[raw[0], np.exp(raw[1:])])
        score = _sums(row, w, column, len(rows))
        upper = np.r_[theta, np.inf][y] - score
        lower = np.r_[-np.inf, theta][y] - score
        cu, cl = _sigmoid(upper), _sigmoid(lower)
        cu[np.isinf(upper)], cl[np.isinf(lower)] = 1.0, 0.0
        p = np.maximum(cu - cl, 1e-9)
        du, dl = cu * (1 - cu), cl * (1 - cl)
        by_score = (du - dl) / p / len(y)
        by_theta = np.array([(-(du / p)[y == k].sum() + (dl / p)[y == k + 1].sum()) / len(y) for k in range(grades - 1)])
        by_raw = np.r_[by_theta.sum(), [by_theta[j:].sum() * np.exp(raw[j]) for j in range(1, grades - 1)]]
        by_w = _sums(column, by_score, row, len(w))
        if step in (30, 80):  # features that are at zero and pull too weakly to leave it
            live = (w != 0) | (np.abs(by_w) > penalty / 2)
            stays = live[column]
            row, column = row[stays], (np.cumsum(live) - 1).astype(np.int32)[column[stays]]
            w, by_w, hashes = w[live], by_w[live], hashes[live]
            moments[0], moments[1] = moments[0][live], moments[1][live]
        rate = 0.15 / math.sqrt(1 + step / 50)
        for k, (value, gradient) in enumerate(((w, by_w), (raw, by_raw))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * gradient
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * gradient**2
            scale = rate / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-4)
            value -= scale * moments[2 * k] / (1 - 0.9**step)
            if k == 0:
                value[:] = np.sign(value) * np.maximum(np.abs(value) - scale * penalty, 0)
    theta = np.cumsum(np.r_[raw[0], np.exp(raw[1:])])
    used = w != 0
    return OrdinalModel(hashes[used], w[used], theta)


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0: toxic, 1: poor, 2: good; null where a rating is missing."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)


def fit_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """The model of the sampled labelled rows of `docs`; labels has key, quality and toxic. Of several ratings the worst counts.

    Only keys with hashes below a bound, of which there are about a quarter more than wanted, are brought
    together, and texts become features where they are read; equal keys have several rows, of which those
    with the least hashes are taken. One task fits the model to them, so only its weights come to the driver.
    """
    graded = labels.select(F.col(f"`{key}`").alias("_key"), grade().alias("_grade")).where("_grade is not null and _key is not null")
    n = graded.agg(F.approx_count_distinct("_key", 0.02)).head()[0]
    bound = min(1.0, (1.25 * sample + 100) / max(1, n))
    near = graded.where(F.xxhash64("_key").cast("double") / 2.0**64 + 0.5 <= bound)
    chosen = near.groupBy("_key").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_key"), "_key").limit(sample)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("binary").alias("_t"))
    found = rows.join(F.broadcast(chosen), "_key").select(F.xxhash64("_key", "_t").alias("h"), "_t", F.col("_grade").alias("g"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = [np.sort(np.fromiter(features(x), np.uint32)).tobytes() for x in b["_t"]]
            yield pd.DataFrame({"h": b["h"], "f": packed, "g": b["g"]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = [(np.frombuffer(f, np.uint32), g) for b in batches for f, g in zip(b["f"], b["g"], strict=True)]
        model = fit(taken)
        yield pd.DataFrame({"hashes": [model.hashes.tobytes()], "weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tobytes()]})

    taken = found.mapInPandas(run, "h long, f binary, g int").orderBy("h", "g").limit(sample)  # one partition, in order
    model = taken.mapInPandas(fitted, "hashes binary, weights binary, thresholds binary").head()
    return OrdinalModel(*map(np.frombuffer, model, (np.uint32, float, float))) if model else fit([])


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", accept: float = ACCEPT, keep_text: bool = True) -> DataFrame:
    """`docs` with _score, _tails (P(grade >= k) for each k >= 1), _expected (grade) and _accepted.

    A document is accepted if the best grade's tail probability is at least `accept`. Null texts are scored
    as empty ones. Repeated rows get equal scores. Columns with the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(texts: list[bytes | None]) -> Iterator[tuple[float, list[float], float, bool]]:
        weight = shared.value.lookup()
        for t in texts:
            total = math.fsum(weight[h] for h in features(t) if h in weight)
            tails = shared.value.tails(total)
            yield total, tails, sum(tails), tails[-1] >= accept

    return from_text(docs, text, "_score double, _tails array<double>, _expected double, _accepted boolean", rate, keep_text=keep_text)


def accepted_documents(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that the model fitted on them accepts; the columns of `docs`."""
    model = fit_on(docs, labels, text=text)
    return score(packed(docs, F.col(f"`{text}`").alias("_text")), model, "_text", keep_text=False).where("_accepted").select("_all.*")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: doc_id, score, p_poor_or_better, p_good, expected_grade and accepted of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_on(docs, labels)
    rated = score(docs.select("doc_id", "text"), model, keep_text=False)
    return rated.select("doc_id", F.col("_score").alias("score"), F.col("_tails")[0].alias("p_poor_or_better"), F.col("_tails")[1].alias("p_good"), F.col("_expected").alias("expected_grade"), F.col("_accepted").alias("accepted"))
