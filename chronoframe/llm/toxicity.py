"""Toxic passages as maximum-scoring segments of token log-odds.

Fitting. Words of labelled documents, and the first 4, 5 and 6 bytes of longer words, are
counted by toxic and clean documents that have them. Their log-odds under an informative Dirichlet
prior (the overall rates, worth ``PRIOR_SHARE`` of all counts) are kept where they are
significantly positive. A word scores by itself if it is kept, else by its longest kept
beginning, else it costs ``GAP``.

Scoring. One linear scan finds all maximal segments of positive total score. Under clean
text the best score among n words follows an extreme-value law with parameters lambda
(from the scores' distribution in clean text) and K (by maximum likelihood), which turns
each segment into the number of such segments that n clean words would give by chance. The
best segment's evidence, all segments' evidence together and the number of significant
ones make the document's score by a logistic fit.

Scale: documents are scored where they are read, without a shuffle. The classifier is
fitted on at most ``FIT_ROWS`` labelled documents, picked by a hash of the id, which bounds
what reaches the driver and the workers: the significant features, the numbers of tokens of each weight, and a few numbers
for each of these documents. Every document is scored whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small, spread, table
from .decontaminate import words_of
from .token_files import Generations

FIT_ROWS = 20_000
PRIOR_SHARE = 0.02
MIN_Z, MIN_COUNT = 3.0, 5
GAP = 0.5
SIGNIFICANT = 0.05
THRESHOLD = 0.3
CACHE_ENTRIES = 200_000
PREFIXES = (6, 5, 4)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def features_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings, longest first; a beginning ends in * and so is no word."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) >= n)]


@dataclass
class ToxicityModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    coefficients: tuple[float, ...] = (-2.0, 0.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self.cache: Generations = Generations(self._weight, CACHE_ENTRIES)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.cache = Generations(self._weight, CACHE_ENTRIES)

    def _weight(self, word: bytes) -> float:
        for f in features_of(word):
            if (w := self.weights.get(f)) is not None:
                return w
        return -GAP

    def token_scores(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        out = np.fromiter(map(self.cache.__getitem__, words), np.float64, len(words))
        self.cache.trim()
        return out

    def log_e(self, score: float, n: int) -> float:
        return math.log(self.k) + math.log(max(n, 1)) - self.lam * score

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(first word, end, score, log of the expected number by chance) of the significant segments."""
        found = [(a, b, s, self.log_e(s, len(scores))) for a, b, s in maximal_segments(scores)]
        return [p for p in found if p[3] <= math.log(SIGNIFICANT)]

    def probability(self, passages: list[tuple[int, int, float, float]]) -> float:
        z = sum(c * x for c, x in zip(self.coefficients, evidence(passages), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def evidence(passages: list[tuple[int, int, float, float]]) -> tuple[float, float, float, float]:
    """What the logistic fit sees: 1, and logarithms of the best and of all evidence, and of the passages."""
    e = [-p[3] for p in passages]
    return 1.0, math.log1p(max(e, default=0.0)), math.log1p(sum(e)), math.log1p(len(e))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) in linear time, in order of place.

    Runs of tokens that score zero or less only separate, so the scan visits the positive
    tokens and the cumulated score before and after each.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    open_: list[tuple[int, int, float, float]] = []  # first, end, cumulated score before and after
    for i, before, after in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        segment = (i, i + 1, before, after)
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= segment[2]:
                j -= 1
            if j < 0 or open_[j][3] >= segment[3]:
                open_.append(segment)
                break
            segment = (open_[j][0], segment[1], open_[j][2], segment[3])
            del open_[j:]
    return [(a, b, y - x) for a, b, x, y in open_]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least of three hashes over a text's shingles of five words: near copies share most of these."""
    for batch in small(batches):
        marks = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = words_of(text)
            h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], np.uint64)
            marks.append([(h * np.uint64(m)).min().astype(np.int64) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)])
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[k] for m in marks], pa.int64()) for k in range(3))], ["row", "text", "toxic", "m0", "m1", "m2"])


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): how many documents of each class have it, so that a word that
    one document repeats counts once; the empty feature has the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            counts: dict[bytes, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {f for w in set(words_of(text)) for f in features_of(w)}
                counts[b""][1 - toxic] += len(found)
                for f in found:
                    counts[f][1 - toxic] += 1
            columns = [pa.array(list(counts), pa.binary()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "clean"])

    out = sample.select("text", "toxic").mapInArrow(run, "feature binary, toxic long, clean long")
    return out.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _log_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    n = n_toxic + n_clean
    prior = F.lit(PRIOR_SHARE) * (F.col("toxic") + F.col("clean"))
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    delta = F.log(t / (F.lit(n_toxic + PRIOR_SHARE * n) - t)) - F.log(c / (F.lit(n_clean + PRIOR_SHARE * n) - c))
    kept = counts.where((F.length("feature") > 0) & (F.col("toxic") + F.col("clean") >= MIN_COUNT) & (F.col("toxic") > 0))
    return kept.select("feature", delta.alias("delta"), (delta / F.sqrt(1 / t + 1 / c)).alias("z")).where(f"z >= {MIN_Z}")


def _solve_lambda(positive: np.ndarray, times: np.ndarray, n: int) -> float:
    """The positive root of the mean of exp(lambda * score) = 1 over n tokens, of which ``times`` have the positive scores;
    half a mean positive token is added for smoothing."""
    typical = float((positive * times).sum() / times.sum()) if len(positive) else 5.0
    s, p = np.append(positive, typical), np.append(times, 0.5) / (n + 1)
    rest = 1 - p.sum()
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 600))).sum() + rest * math.exp(-mid * GAP) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fits on labelled documents that are not held out, at most ``fit_rows`` of them.

    An id that is labelled toxic once counts as toxic; null labels and ids count as none;
    of texts under one id one counts; copies and most near copies of a text count once. Null and empty texts count as texts
    without a word. Without documents of both kinds, as in an empty table, the score is the rate.
    """
    ids = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    picked = materialize(picked.withColumn("row", F.monotonically_increasing_id()).select("row", "text", "toxic", F.col("doc_id").alias("id")), "toxicity-picked")
    hashed = F.xxhash64("text").alias("h")
    # texts stay where they are; of rows with one id, then with one mark, the one with the least hash stays, however they are partitioned
    first = F.min_by("row", F.struct("h", "row")).alias("row")
    ids = picked.select("row", "id", hashed).groupBy("id").agg(first).select("row")
    marked = picked.select("row", "text", "toxic").mapInArrow(_mark, "row long, text string, toxic int, m0 long, m1 long, m2 long").select("row", "toxic", "m0", "m1", "m2", hashed)
    marked = materialize(marked.join(ids, "row", "left_semi"), "toxicity-marks")  # at most fit_rows rows
    for m in ("m0", "m1", "m2"):
        marked = marked.join(marked.groupBy(F.col(m), "toxic").agg(first).select("row"), "row", "left_semi")
    kept = materialize(marked.select("row"), "toxicity-rows")
    sample = materialize(picked.join(F.broadcast(kept), "row", "left_semi").select("text", "toxic"), "toxicity-fit")
    counts = materialize(_counts(sample), "toxicity-counts")
    totals = counts.where("length(feature) = 0").first()
    classes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    rate = (classes.get(1, 0) + 0.5) / (sum(classes.values()) + 1)
    if not totals or not totals.toxic or not totals.clean:
        return ToxicityModel(coefficients=(math.log(rate / (1 - rate)), 0.0, 0.0, 0.0))
    kept = _log_odds(counts, totals.toxic, totals.clean).orderBy(F.desc("z"), "feature").collect()
    model = ToxicityModel({bytes(r.feature): r.delta for r in kept})

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = np.concatenate([np.zeros(0), *(s[s > 0] for s in map(model.token_scores, batch.column(0).cast(pa.binary()).to_pylist()))])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(found, return_counts=True)], ["weight", "times"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            scores = [model.token_scores(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            most = [max((x for _, _, x in maximal_segments(s)), default=0.0) for s in scores]
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in scores], pa.int64()), pa.array(most, pa.float64())], ["n", "best"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = [evidence(model.passages(model.token_scores(t))) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([r[k] for r in x], pa.float64()) for k in range(4))], ["toxic", "x0", "x1", "x2", "x3"])

    clean = sample.where("toxic = 0").select("text")
    kinds = clean.mapInArrow(weights, "weight double, times long").groupBy("weight").agg(F.sum("times").alias("times")).orderBy("weight").collect()
    rows = clean.mapInArrow(best, "n long, best double").orderBy("n", "best").collect()
    model.lam = _solve_lambda(np.array([r.weight for r in kinds]), np.array([float(r.times) for r in kinds]), sum(r.n for r in rows))
    model.k = len(rows) / max(1e-300, sum(max(r.n, 1) * math.exp(-model.lam * r.best) for r in rows))
    rows = sample.select("text", "toxic").mapInArrow(seen, "toxic int, x0 double, x1 double, x2 double, x3 double").orderBy("toxic", "x1", "x2", "x3").collect()
    x = np.array([tuple(r)[1:] for r in rows])
    model.coefficients = _logistic(x, np.array([float(r.toxic) for r in rows]))
    return model


def _score_texts(model: ToxicityModel, texts: list[bytes | None]) -> tuple[list[float], list[int]]:
    found = [model.passages(model.token_scores(t)) for t in texts]
    return [model.probability(p) for p in found], [len(p) for p in found]


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Returns doc_id, held_out, score, predicted, n_passages for every row; null and empty texts have no passage.

    Repeated rows are scored each, equal texts alike; an empty table gives none; further columns are left aside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            p, n = _score_texts(model, batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= THRESHOLD) for x in p], pa.int32()), pa.array(n, pa.int64())], ["doc_id", "score", "predicted", "n_passages"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, n_passages long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")


def toxic_passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every significant passage: doc_id, first_word, end_word, score, log_e."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [(i, *p) for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()) for p in model.passages(model.token_scores(t))]
            columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.float64()) for k in range(1, 5))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "first_word", "end_word", "score", "log_e"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, first_word long, end_word long, score double, log_e double")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted to be toxic."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            p, _ = _score_texts(model, batch.column(at).cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array([x < THRESHOLD for x in p], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
