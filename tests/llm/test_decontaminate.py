import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import decontaminate as d
from tests.llm.cases import documents, edge_rows, sentence

ITEMS = "item_id bigint, text string"


def words(text):
    return [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", text or "")]


def covered(part, shared):
    n = min(3, len(part))
    if not n:
        return 1.0
    hit = [False] * len(part)
    for i in range(len(part) - n + 1):
        if tuple(part[i : i + n]) in shared:
            hit[i : i + n] = [True] * n
    return sum(hit) / len(part)


def brute(rows, items, threshold=d.THRESHOLD, overlap=d.OVERLAP):
    """Every passage of every row against every item, without an index."""
    split = []
    for i, text in items:
        w = [x for x in re.split(r"\s+", text or "") if x]
        k = len(w) - len(w) // 3
        q, a = words(" ".join(w[:k])), words(" ".join(w[k:]))
        if q or a:
            split.append((i, q, a))
    df = Counter(t for _, q, a in split for t in set(q + a))
    mean = sum(len(q) + len(a) for _, q, a in split) / max(len(split), 1)
    weights = []
    for _, q, a in split:
        tf = Counter(q + a)
        w = {t: math.log(1 + (len(split) - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(q + a) / mean)) for t, c in tf.items()}
        total = sum(w.values())
        weights.append({t: x / total for t, x in w.items()})
    size = max([64, *(2 * len(q + a) for _, q, a in split)])
    out = {}
    for n, (doc, text) in enumerate(rows):
        all_words = words(text)
        for s in range(0, len(all_words), size // 2):
            part = all_words[s : s + size]
            terms, shared = set(part), {tuple(part[i : i + k]) for k in (1, 2, 3) for i in range(len(part) - k + 1)}
            for k, ((i, q, a), w) in enumerate(zip(split, weights, strict=True)):
                score = sum(x for t, x in w.items() if t in terms)
                if score >= threshold and min(covered(q, shared), covered(a, shared)) >= overlap:
                    out[n, doc, k] = max(out.get((n, doc, k), (0,)), (score, i))
    return sorted((-1 if doc is None else doc, i, round(x, 9)) for (_, doc, _), (x, i) in out.items())


def found(spark, rows, items, **kw):
    table = spark.createDataFrame(items, ITEMS)
    got = d.contaminated(documents(spark, rows), d.split_items(table), **kw).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.item_id is None else r.item_id, round(r.score, 9)) for r in got)


def _corpus(seed):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.randint(3, 60)) + ". " + sentence(rng, rng.randint(1, 20))) for i in range(80)]
    rows = []
    for i in range(120):
        parts = [sentence(rng, rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            w = items[rng.randrange(80)][1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 4, 12])):
                w[rng.randrange(len(w))] = rng.choice(["Other", "", "new!"])
            parts.append(rng.choice([str.upper, str.lower, str])(" ".join(w)) + rng.choice([".", "\n", " "]))
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    return rows, items


@pytest.mark.parametrize("seed", range(2))
def test_as_without_an_index(spark, seed):
    rows, items = _corpus(seed)
    wanted = brute(rows, items)
    assert len(wanted) > 60
    assert found(spark, rows, items) == wanted
    assert found(spark, rows, items, threshold=0.3, overlap=0.5) == brute(rows, items, 0.3, 0.5)


@pytest.mark.parametrize("indexes", [8, 2])
def test_several_indexes_change_no_score(spark, monkeypatch, indexes):
    rows, items = _corpus(3)
    items += [(200 + i, x[1]) for i, x in enumerate(items[:3] * 20)]
    whole = brute(rows, items)
    assert found(spark, rows, items) == whole
    monkeypatch.setattr(d, "INDEX_BYTES", 3000)
    monkeypatch.setattr(d, "INDEXES", indexes)
    assert found(spark, rows, items) == whole


@pytest.mark.parametrize("block,slack", [(1, 0.25), (4, 0.0), (16, 0.54)])
def test_search_is_exhaustive_search(monkeypatch, block, slack):
    rows, items = _corpus(5)
    monkeypatch.setattr(d, "BLOCK", block)
    monkeypatch.setattr(d, "SLACK", slack)
    index = d.build([(i, t, "") for i, t in items])
    lookup = d.Lookup(index.vocab)
    weights = np.zeros((len(index.ids), len(index.vocab)))
    for t in range(len(index.vocab)):
        at = slice(index.start[t], index.start[t + 1])
        weights[index.item[at], t] = index.weight[at]
    for _, text in rows:
        terms = np.unique(lookup(d.words_in(text))[1])
        for threshold in (0.1, 0.3, 0.55):
            got, scores = index.search(terms, threshold)
            full = weights[:, terms].sum(1)
            assert got.tolist() == np.flatnonzero(full >= threshold).tolist() and np.allclose(scores, full[got])
        w = d.words_in(text)
        opened = set()
        for _, s, e, found_terms in d.passages_above(w, np.array([0, len(w)]), index, lookup, 0.55):
            opened.add(s)
            assert set(found_terms.tolist()) == set(lookup(w[s:e])[1].tolist())
        for s in range(0, len(w), index.passage // 2):
            terms = np.unique(lookup(w[s : s + index.passage])[1])
            if (weights[:, terms].sum(1) >= 0.55).any():
                assert s in opened or s - index.passage // 2 in opened and s + index.passage // 2 >= len(w)


def test_edge_cases(spark):
    rows = edge_rows()
    text = rows[4][1]
    items = [(1, None), (2, ""), (3, "..."), (4, text), (4, text), (5, "one"), (None, text), (6, sentence(random.Random(8), 2000))]
    assert found(spark, rows, items) == brute(rows, [(-1 if i is None else i, t) for i, t in items])
    assert {x[0] for x in found(spark, rows, items)} >= {5, 6, 10}
    assert found(spark, rows, []) == [] and found(spark, [], items) == []


def test_clean_texts_stay(spark):
    rng = random.Random(77)
    _, items = _corpus(0)
    assert found(spark, [(i, sentence(rng, 400)) for i in range(100)], items) == []
