import hashlib
import math
import random
import re
import zlib
from string import ascii_lowercase, ascii_uppercase

import pytest

from gleaner.llm import resampling
from tests.llm.cases import documents, edge_rows, sentence

_TABLE = str.maketrans(ascii_uppercase, ascii_lowercase)


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_TABLE))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    of = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for f in features(x, longest)[1]:
                counts[of(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in rows:
        n, fs = features(x, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[of(f)] for f in fs)
        out.append([n, i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    for k, r in enumerate(fit):
        r.append(k + 1 if k < len(fit) * percent // 100 else None)
    return sorted((tuple((*r, None)[1:6]) for r in out), key=repr)


def found(spark, rows, target, **kw):
    texts = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resampled(documents(spark, rows), texts, **kw).select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_drawn_as_by_brute_force(spark, longest):
    rng = random.Random(longest)
    rows = [(i, sentence(rng, rng.choice([0, 1, 2, 19, 20, 21, 60, 200])).title()) for i in range(200)]
    target = [sentence(rng, 30) for _ in range(10)]
    assert found(spark, rows, target, longest=longest, percent=30) == brute(rows, target, longest, percent=30)


def test_odd_rows_ties_and_repeats(spark):
    rng = random.Random(4)
    rows = edge_rows() + [(50, "A-B c_d 3rd É" * 9)] * 40 + [(None, sentence(rng, 25))] * 30
    target = [None, "", "Aa bb " * 20, sentence(rng, 40)]
    assert found(spark, rows, target, percent=60) == brute(rows, target, percent=60)
    assert found(spark, rows, [], percent=100) == brute(rows, [], percent=100)
    assert found(spark, [], target) == []
