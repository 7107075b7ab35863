"""Linear text classifiers on hashed n-gram indicators that are scaled by naive Bayes log-count ratios.

Two of them: on word and word-shape n-grams (quality) and on character n-grams (toxicity). Both minimise the
hinge loss by dual coordinate descent. A model is fitted on a bounded sample of labelled rows (`per_class` rows
of each class and FEATURES features in all, by the order of a hash of doc_id); features of the sample are made
in Spark tasks, the fit runs on the driver, and the weights, 2**BITS floats whatever the corpus, are broadcast.
Scoring reads whole texts.

Settings are chosen on the training fold alone: a fitted model tells the accuracy and the area under the curve
of its sample's rows, each scored by a model of the other parts (`cross_validated`).

Wherever texts are scored: null and empty texts have no features and score by the intercept; very long texts are
read whole; equal texts have equal scores; repeated rows and rows without doc_id are rows like others; an empty
table gives no rows; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import _TABLE, ascii_lower, byte_view, chunks, cut, mixed, short_batches, span_hashes, spans

BITS = 18
#: Rows of each class that a fit takes at most; character n-grams of a text are many more than its words'.
PER_CLASS, PER_CLASS_CHARS = 2500, 2000
#: Features of the sample's rows that go to the driver at most.
FEATURES = 1 << 25
#: Lengths of character n-grams in bytes; the long ones hold beginnings of words with letters of two bytes.
GRAMS = (4, 6)
#: Parts of the sample that are scored by a model of the other parts, to calibrate probabilities.
FOLDS = 2

#: Features of one kind: values that stand in row order, and where each row's begin and end.
Part = tuple[np.ndarray, np.ndarray, np.ndarray]
#: (bytes, row offsets) -> parts; a row may repeat a feature
Features = Callable[[np.ndarray, np.ndarray], list[Part]]


def _index(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def char_ngrams(data: np.ndarray, offs: np.ndarray) -> list[Part]:
    """n-grams of lower-cased bytes within a row, of each length in GRAMS (in rising order), with a blank before and after it.

    Bytes below 0x30 count as blank, so punctuation doesn't part equal words.
    """
    n_rows = len(offs) - 1
    edges = offs + 2 * np.arange(n_rows + 1)
    padded = np.full(edges[-1], 32, np.uint8)
    folded = ascii_lower(data)
    folded[folded < 48] = 32
    inner = np.ones(edges[-1], bool)
    inner[edges[:-1]] = inner[edges[1:] - 1] = False
    padded[inner] = folded
    codes = (_TABLE >> np.uint64(32)).astype(np.uint32)[padded]
    parts, h = [], codes
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
        if n in GRAMS:
            g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            parts.append(((g >> np.uint32(32 - BITS)).astype(np.int32), edges[:-1], np.maximum(edges[1:] - n + 1, edges[:-1])))
    return parts


#: Shape of a token: its first byte's class, an all-capitals mark, a repeat mark and its length class.
_KIND = np.zeros(256, np.uint64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 1


def word_ngrams(data: np.ndarray, offs: np.ndarray) -> list[Part]:
    """Words, word pairs, and shape n-grams (one to three tokens) of each row.

    A token is a run of letters and digits or a run of other visible bytes. A token's shape tells letters
    from capitals, digits and marks (marks by their own bytes), all-capital words, words equal to the one
    before the last token, and a coarse length.
    """
    kind = _KIND[data]
    visible = data > 32
    ws, we = spans((kind > 0) & visible, offs)
    ms, me = spans((kind == 0) & visible, offs)
    s, e = np.concatenate([ws, ms]), np.concatenate([we, me])
    order = np.argsort(s, kind="stable")
    s, e, is_mark = s[order], e[order], (np.arange(len(s)) >= len(ws))[order]
    if not len(s):
        return []
    first = np.searchsorted(s, offs)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    lower = span_hashes(ascii_lower(data), s, e)
    capitals = np.concatenate([[0], np.cumsum(kind == 2)])
    size = e - s
    caps = (capitals[e] - capitals[s] == size) & (size > 1)
    repeat = np.zeros(len(s), bool)
    for back in (1, 2):
        repeat[back:] |= (lower[back:] == lower[:-back]) & (rows[back:] == rows[:-back]) & ~is_mark[back:]
    shape = kind[s] + np.uint64(8) * caps.astype(np.uint64) + np.uint64(16) * repeat.astype(np.uint64)
    shape += np.uint64(32) * np.minimum(np.log2(size).astype(np.uint64), np.uint64(5))
    shape = mixed(np.where(is_mark, lower, shape + np.uint64(1)))
    at, to = first[:-1], first[1:]
    pair, three = np.maximum(to - 1, at), np.maximum(to - 2, at)
    return [
        (_index(mixed(lower)), at, to),
        (_index(mixed(shape + np.uint64(7))), at, to),
        (_index(mixed(lower[:-1] * np.uint64(3) + lower[1:])), at, pair),
        (_index(mixed(shape[:-1] * np.uint64(5) + shape[1:])), at, pair),
        (_index(mixed(shape[:-2] * np.uint64(25) + shape[1:-1] * np.uint64(5) + shape[2:])), at, three),
    ]


class Distinct:
    """Finds the distinct features of a row without sorting: the last of equal features is kept."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, np.int32)
        self.count = np.arange(1 << 16, dtype=np.int32)

    def __call__(self, f: np.ndarray) -> np.ndarray:
        if len(f) > len(self.count):
            self.count = np.arange(2 * len(f), dtype=np.int32)
        n = self.count[: len(f)]
        self.last[f] = n
        return f[self.last[f] == n]


def by_row(parts: list[Part], n_rows: int) -> Iterator[np.ndarray]:
    for i in range(n_rows):
        yield np.concatenate([f[lo[i] : hi[i]] for f, lo, hi in parts]) if parts else np.zeros(0, np.int32)


def usable(labels: DataFrame, label: str, held: int, folds: int) -> DataFrame:
    """(doc_id, y): labels outside the held-out fold, which is crc32 of doc_id as text modulo folds.

    Null labels, labels but 0 and 1, and labels of one id that contradict each other are left out.
    """
    return (
        labels.select(F.col("doc_id").cast("bigint"), F.col(label).cast("int").alias("y"))
        .where("y in (0, 1) and doc_id is not null")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held)
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    )


def sample(docs: DataFrame, ids: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, text, y): at most per_class rows of each class among ids(doc_id, y).

    Rows are taken in the order of a hash of doc_id, so the sample is the same on every run.
    """
    # only labelled ids are dealt out; texts are joined to the few that the sample keeps
    order = F.xxhash64("doc_id"), F.col("doc_id")
    taken = ids.where("y = 0").orderBy(*order).limit(per_class).union(ids.where("y = 1").orderBy(*order).limit(per_class))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    # at most 2 x per_class ids of 12 bytes; of rows that share an id, one by a hash of the text
    joined = rows.join(F.broadcast(taken), "doc_id")
    return joined.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")


def _features_of(rows: DataFrame, features: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct()
        for b in batches:
            data, offs = byte_view(b.column(1))
            lists = []
            for lo, hi in chunks(offs):
                parts = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                lists += [distinct(f) for f in by_row(parts, hi - lo)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "y", "feats"])

    return rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id bigint, y int, feats array<int>")


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """The first rows(doc_id, y, feats) of each class, by the hash of doc_id, that have half of `most` features together."""
    sized = cut(rows).withColumn("size", F.size("feats"))
    # a narrow window over at most per_class rows of a class
    upto = sized.select("doc_id", "y", F.sum("size").over(W.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")).alias("upto"))
    return sized.join(upto.where(F.col("upto") <= most // 2).select("doc_id"), "doc_id").select("doc_id", "y", "feats")


def log_count_ratio(feats: list[np.ndarray], y: np.ndarray, smooth: float = 1.0, least: int = 3) -> np.ndarray:
    """Log of the ratio of smoothed, normalised indicator counts in class 1 and class 0.

    Features that occur in fewer than `least` sampled rows get zero, so they carry no weight.
    """
    counts = np.zeros((2, 1 << BITS))
    for f, label in zip(feats, y, strict=True):
        counts[label, f] += 1
    p, q = counts[1] + smooth, counts[0] + smooth
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[counts.sum(0) < least] = 0
    return r


def _scaled(feats: list[np.ndarray], r: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for f in feats:
        f = f[r[f] != 0]
        x = r[f].astype(np.float32)
        norm = np.sqrt((x * x).sum())
        out.append((f, x / norm if norm else x))
    return out


def fit_hinge(feats: list[np.ndarray], y: np.ndarray, cost: float = 1.0, sweeps: int = 15, seed: int = 7) -> dict:
    """Naive Bayes support vectors: dual coordinate descent on the L2-regularised hinge loss."""
    r = log_count_ratio(feats, y)
    rows, sign = _scaled(feats, r), np.where(y == 1, 1.0, -1.0)
    n = len(rows)
    caps = np.where(y == 1, cost * n / (2 * max((y == 1).sum(), 1)), cost * n / (2 * max((y == 0).sum(), 1)))
    w, b, alpha, rng = np.zeros(1 << BITS), 0.0, np.zeros(n), np.random.default_rng(seed)
    for _ in range(sweeps):
        moved = 0.0
        for i in rng.permutation(n):
            f, x = rows[i]
            grad = sign[i] * (w[f] @ x + b) - 1
            new = min(max(alpha[i] - grad / (x @ x + 1), 0.0), caps[i])
            if step := (new - alpha[i]) * sign[i]:
                w[f] += step * x
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return {"r": r, "w": w, "b": b}


def _margins(model: dict, feats: list[np.ndarray]) -> np.ndarray:
    return np.array([x @ model["w"][f] + model["b"] for f, x in _scaled(feats, model["r"])])


def _calibrated(model: dict, z: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict:
    """Platt's slope and shift for margins z of rows that their model wasn't fitted on; share: weights by class."""
    weight, a, b = share[y] / share[y].mean(), 1.0, 0.0
    x = np.stack([z, np.ones(len(z))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = x @ (weight * (p - y)) + 0.01 * np.array([a - 1, b])
        h = (x * (weight * p * (1 - p))) @ x.T + 0.01 * np.eye(2)
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
        a = float(np.clip(a, 0.05, 20))
    return model | {"slope": a, "shift": float(b)}


def fit(docs: DataFrame, labels: DataFrame, label: str, features: Features, held: int, folds: int, per_class: int = PER_CLASS) -> dict:
    """Fits on the bounded sample; probabilities are calibrated on halves of it that the other half's model scores.

    The calibration weighs the classes as all usable labels do, since the sample may hold other shares. With
    one class or no rows, the model gives that class's prior (0.5 if none). Of documents that share a doc_id, one
    by a hash of the text is taken, null texts last; labelled ids without a document count for nothing.
    """
    short_batches(docs.sparkSession)
    ids = usable(labels, label, held, folds)
    rows = _bounded(_features_of(sample(docs, ids, per_class), features), FEATURES).toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    y = rows["y"].to_numpy()[order].astype(int)
    lists = rows["feats"].combine_chunks()
    values, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
    feats = [values[offs[i] : offs[i + 1]] for i in order]
    if len(set(y.tolist())) < 2:
        zero = np.zeros(1 << BITS)
        return {"r": zero, "w": zero, "b": (-1.0 if not y[0] else 1.0) if len(y) else 0.0, "slope": 1.0, "shift": 0.0}
    model, (no, yes) = fit_hinge(feats, y), np.bincount(y, minlength=2)
    if min(no, yes) < 2 * FOLDS:
        return model | {"slope": 1.0, "shift": 0.0}
    part = np.empty(len(y), int)
    for c in (0, 1):
        part[y == c] = np.arange((y == c).sum()) % FOLDS
    z = np.empty(len(y))
    for k in range(FOLDS):
        own, rest = np.flatnonzero(part == k), np.flatnonzero(part != k)
        z[own] = _margins(fit_hinge([feats[i] for i in rest], y[rest]), [feats[i] for i in own])
    counted = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}  # two rows
    place = np.argsort(np.argsort(z))
    told = {"accuracy": float(((z >= 0) == y).mean()), "area": float((place[y == 1].sum() - yes * (yes - 1) / 2) / (yes * no))}
    return _calibrated(model, z, y, np.array([counted[0] / no, counted[1] / yes])) | {"cross_validated": told}


def margin_function(spark: SparkSession, model: dict, features: Features) -> Callable[[], Callable[[pa.Array], np.ndarray]]:
    """What makes, in a task, a function from a text column to the probabilities of class 1."""
    r, w = model["r"].astype(np.float32), model["w"].astype(np.float32)
    held = spark.sparkContext.broadcast((r * r, r * w, float(model["b"]), float(model["slope"]), float(model["shift"])))

    def make() -> Callable[[pa.Array], np.ndarray]:
        rr, rw, b0, slope, shift = held.value
        used, distinct = rr != 0, Distinct()

        def probabilities(texts: pa.Array) -> np.ndarray:
            data, offs = byte_view(texts)
            margins = np.zeros(len(texts))
            for lo, hi in chunks(offs):
                parts = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                for i, f in enumerate(by_row(parts, hi - lo), lo):
                    f = distinct(f[used[f]])
                    norm = np.sqrt(rr[f].sum())
                    margins[i] = rw[f].sum() / (norm or 1) + b0
            return 1 / (1 + np.exp(-np.clip(margins * slope + shift, -30, 30)))

        return probabilities

    return make


def score(docs: DataFrame, model: dict, features: Features) -> DataFrame:
    """(doc_id, score) of every row: the probability of class 1. Null and empty texts score by the intercept."""
    short_batches(docs.sparkSession)
    margins = margin_function(docs.sparkSession, model, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = margins()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_of(b.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")


def scored(docs: DataFrame, model: dict, features: Features, held: int, folds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; repeated rows stay; a null doc_id isn't held out."""
    out = score(docs, model, features)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held
    return out.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_model(docs: DataFrame, labels: DataFrame, held: int = 1, folds: int = 3, per_class: int = PER_CLASS) -> dict:
    """Naive Bayes support vectors on word and shape n-grams, fitted to labels.quality outside the held-out fold (see fit)."""
    return fit(docs, labels, "quality", word_ngrams, held, folds, per_class)


def toxicity_model(docs: DataFrame, labels: DataFrame, held: int = 0, folds: int = 5, per_class: int = PER_CLASS_CHARS) -> dict:
    """Linear model on scaled character n-grams, fitted to labels.toxic outside the held-out fold (see fit)."""
    return fit(docs, labels, "toxic", char_ngrams, held, folds, per_class)


def accepted(docs: DataFrame, model: dict, features: Features) -> DataFrame:
    """The rows of docs, with all their columns, that a model scores at 0.5 or more.

    Rows are scored beside their columns, whatever these are called, so nothing is joined or shuffled, and repeated
    rows share a fate. Null and empty texts stay if the intercept alone is accepted.
    """
    spark = docs.sparkSession
    short_batches(spark)
    cols = docs.columns
    at = cols.index("text")
    margins = margin_function(spark, model, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = margins()
        for b in batches:
            yield b.filter(pa.array(score_of(b.column(at)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
