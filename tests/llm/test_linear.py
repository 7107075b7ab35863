import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import linear
from gleaner.llm.common import _TABLE, ascii_lower, mixed, span_hashes
from gleaner.llm.queries import table
from tests.llm.cases import documents, edge_rows

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize("label,held,folds,fit,features", [
    ("quality", 1, 3, linear.quality_model, linear.word_ngrams), ("toxic", 0, 5, linear.toxicity_model, linear.char_ngrams)])
def test_held_out_accuracy(spark, label, held, folds, fit, features):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = {r.doc_id: r for r in linear.scored(docs, fit(docs, labels), features, held, folds).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.where(f"{label} is not null").collect() if r.doc_id in got}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [(got[i].score, y) for i, y in truth.items() if got[i].held_out]
    pos, neg = [s for s, y in out if y], [s for s, y in out if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    accuracy = np.mean([(s >= 0.5) == y for s, y in out])
    print(label, auc, accuracy, np.mean([s >= 0.5 for s in pos]), np.mean([s >= 0.5 for s in neg]))
    assert auc > 0.95 and accuracy > 0.93, (auc, accuracy)


def test_held_out_labels_are_not_read(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    from pyspark.sql import functions as F

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = linear.quality_model(docs, labels), linear.quality_model(docs, turned)
    assert (a["w"] == b["w"]).all() and a["b"] == b["b"]


@pytest.mark.parametrize("labelled", [[], [(5, 1)], [(5, 1), (8, 0), (9, None), (10, 7), (1, 0), (1, 1)]])
def test_edge_cases(spark, labelled):
    labels = spark.createDataFrame([(i, y, y) for i, y in labelled], "doc_id bigint, quality int, toxic int")
    rows = edge_rows()
    docs = documents(spark, rows)
    for fit, features in ((linear.quality_model, linear.word_ngrams), (linear.toxicity_model, linear.char_ngrams)):
        model = fit(docs, labels)
        got = linear.scored(docs, model, features, 0, 5).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
        assert all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (5, 6)}) == 1
        kept = linear.accepted(docs, model, features)
        assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
        assert linear.scored(documents(spark, []), model, features, 0, 5).count() == 0


def test_dual_coordinate_descent_meets_the_primal(spark):
    """On a small problem the hinge model's duality gap closes."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    feats = [np.unique(rng.integers(0, 60, 12) + 25 * (label if rng.random() < 0.8 else 1 - label)).astype(np.int32) for label in y]
    model = linear.fit_hinge(feats, y, sweeps=400)
    rows, sign = linear._scaled(feats, model["r"]), np.where(y == 1, 1, -1)
    n = len(y)
    caps = np.where(y == 1, n / (2 * (y == 1).sum()), n / (2 * (y == 0).sum()))
    margin = sign * np.array([model["w"][f] @ x + model["b"] for f, x in rows])
    primal = 0.5 * ((model["w"] ** 2).sum() + model["b"] ** 2) + (caps * np.maximum(0, 1 - margin)).sum()
    for direction in range(20):
        step = np.random.default_rng(direction).normal(size=model["w"].shape) * 1e-3 * (model["r"] != 0)
        moved = sign * np.array([(model["w"] + step)[f] @ x + model["b"] for f, x in rows])
        assert 0.5 * (((model["w"] + step) ** 2).sum() + model["b"] ** 2) + (caps * np.maximum(0, 1 - moved)).sum() >= primal - 1e-2


def _chars(text):
    """Features of character n-grams, one gram at a time."""
    codes = [int(x) >> 32 for x in _TABLE]
    folded = bytes(b | 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    padded, found = b" " + bytes(32 if b < 48 else b for b in folded) + b" ", set()
    for n in linear.GRAMS:
        for i in range(len(padded) - n + 1):
            h = codes[padded[i]]
            for b in padded[i + 1 : i + n]:
                h = (h * 0x9E3779B1 + codes[b]) & 0xFFFFFFFF
            found.add((((h ^ h >> 15) * (0x85EBCA6B + 2 * n)) & 0xFFFFFFFF) >> (32 - linear.BITS))
    return found


def _mixed(*terms):
    """The finished hash of a sum of products modulo 2**64."""
    return int(mixed(np.array([sum(terms) & (2**64 - 1)], np.uint64))[0])


def _words(text):
    """Features of words and shapes, one token at a time."""
    tokens = re.findall(rb"(?:[A-Za-z0-9\x80-\xff])+|[^A-Za-z0-9\x80-\xff\x00-\x20]+", (text or "").encode())
    lower, shape, is_mark = [], [], []
    for n, t in enumerate(tokens):
        data = np.frombuffer(t, np.uint8)
        lower.append(int(span_hashes(ascii_lower(data), np.array([0]), np.array([len(t)]))[0]))
        is_mark.append(not (t[:1].isalnum() or t[0] >= 128))
        again = not is_mark[n] and any(n >= k and lower[n] == lower[n - k] for k in (1, 2))
        kind = 2 if t[:1].isupper() else 3 if t[:1].isdigit() else 1
        value = kind + 8 * (len(t) > 1 and t.isalpha() and t.isupper()) + 16 * again + 32 * min(int(math.log2(len(t))), 5) + 1
        shape.append(_mixed(lower[n] if is_mark[n] else value))
    found = [_mixed(x) for x in lower] + [_mixed(x, 7) for x in shape]
    found += [_mixed(a * 3, b) for a, b in zip(lower, lower[1:], strict=False)] + [_mixed(a * 5, b) for a, b in zip(shape, shape[1:], strict=False)]
    found += [_mixed(a * 25, b * 5, c) for a, b, c in zip(shape, shape[1:], shape[2:], strict=False)]
    return {x >> (64 - linear.BITS) for x in found}


@pytest.mark.parametrize("label,fit,features,plain", [("toxic", linear.toxicity_model, linear.char_ngrams, _chars), ("quality", linear.quality_model, linear.word_ngrams, _words)])
def test_model_and_scores_one_by_one(spark, label, fit, features, plain):
    """Every feature, ratio, margin and probability again, for every row, from the bytes of its text."""
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    held, folds = (0, 5) if label == "toxic" else (1, 3)
    model, texts = fit(docs, labels), {r.doc_id: r.text for r in docs.collect()}
    trained = {r.doc_id: r[label] for r in labels.collect() if r[label] in (0, 1) and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % folds != held}
    counts = [Counter(f for i, y in trained.items() if y == c for f in plain(texts[i])) for c in (0, 1)]
    totals = [sum(c.values()) + (1 << linear.BITS) for c in counts]
    ratio = {f: math.log((counts[1][f] + 1) / totals[1]) - math.log((counts[0][f] + 1) / totals[0]) for f in set(counts[0]) | set(counts[1]) if counts[0][f] + counts[1][f] >= 3}
    assert {int(f) for f in np.flatnonzero(model["r"])} == {f for f, r in ratio.items() if r}
    assert all(abs(model["r"][f] - r) < 1e-9 for f, r in ratio.items())
    got = {r.doc_id: r.score for r in linear.scored(docs, model, features, held, folds).collect()}
    for i, text in texts.items():
        own = [f for f in plain(text) if ratio.get(f)]
        norm = math.sqrt(sum(ratio[f] ** 2 for f in own)) or 1.0
        margin = sum(ratio[f] * model["w"][f] for f in own) / norm + model["b"]
        assert abs(got[i] - 1 / (1 + math.exp(-min(max(margin * model["slope"] + model["shift"], -30), 30)))) < 1e-4


def test_the_sample_is_bounded_in_features(spark, monkeypatch):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    rows = linear._features_of(linear.sample(docs, linear.usable(labels, "quality", 1, 3), 50), linear.word_ngrams)
    whole, few = rows.collect(), linear._bounded(rows, 60_000).collect()
    assert 0 < len(few) < len(whole) and sum(len(r.feats) for r in few) <= 60_000
    assert len(linear._bounded(rows, 1 << 40).collect()) == len(whole)


def test_short_tables_and_neighbours_change_no_score(spark):
    """A text's score doesn't depend on the rows that a task reads beside it."""
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = linear.quality_model(docs, labels)
    alone = linear.scored(spark.createDataFrame([(1, "Zz")], "doc_id bigint, text string"), model, linear.word_ngrams, 1, 3).first().score
    beside = linear.scored(spark.createDataFrame([(2, "x" * 500), (1, "Zz"), (3, "A B c")], "doc_id bigint, text string").coalesce(1), model, linear.word_ngrams, 1, 3)
    assert {r.doc_id: r.score for r in beside.collect()}[1] == alone
