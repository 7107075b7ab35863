"""Benchmark items without an answer of their own, copied with one changed word or in part."""

import random

import numpy as np
import pytest

from gleaner.llm import decontaminate as d
from tests.llm.cases import documents, sentence

ITEMS = "item_id bigint, text string"


def _items(seed):
    rng = random.Random(seed)
    return [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in (4, 5, 7, 9, 14, 15, 18, 40)], sentence(rng, 90)


def _found(spark, rows, items):
    got = d.contaminated(documents(spark, rows), d.split_items(spark.createDataFrame(items, ITEMS)), whole=d.WHOLE)
    return {(r.doc_id, r.item_id) for r in got.collect()}


def test_one_changed_word_anywhere(spark):
    items, around = _items(1)
    rows, wanted = [], set()
    for n, text in items:
        words = text.split(" ")
        for k in range(n):
            wanted.add((len(rows), n))
            rows.append((len(rows), f"{around} {' '.join([*words[:k], 'other', *words[k + 1 :]])} {around}"))
    assert _found(spark, rows, items) == wanted


def test_first_two_thirds_word_for_word(spark):
    items, around = _items(2)
    long = [(n, t) for n, t in items if n >= 14]
    rows = [(n, f"{around} {' '.join(t.split(' ')[: n - n // 3])} {around}") for n, t in long]
    assert _found(spark, rows, items) == {(n, n) for n, _ in long}


def test_scattered_words_stay(spark):
    items, around = _items(3)
    far = around.split(" ")
    rows = [(n, " ".join(w for i, x in enumerate(t.split(" ")) for w in (x, far[2 * i], far[2 * i + 1]))) for n, t in items]
    assert _found(spark, rows, items) == set()


def _aligned_slowly(part, passage, least):
    best = 0
    for s in range(max(1, len(passage) - len(part))):
        row = [0] * (len(part) + 1)
        for t in passage[s : s + len(part) + 1]:
            row, before = [0], row
            for i, w in enumerate(part):
                row.append(before[i] + 1 if w == t else max(before[i + 1], row[i]))
        best = max(best, row[-1])
    return best >= least * len(part) - 1e-9


def test_alignment_is_the_longest_common_sequence():
    rng = random.Random(4)
    seen = set()
    for _ in range(400):
        part = [rng.randrange(9) for _ in range(rng.randint(4, 90))]
        passage = [rng.choice([w, w, w, rng.randrange(9)]) for w in part] + [rng.randrange(9) for _ in range(rng.randint(0, 30))]
        least = rng.choice([0.5, 0.7, 0.8])
        got = d.aligned(np.array(part, np.uint64), np.array(passage, np.uint64), least)
        assert got == _aligned_slowly(part, passage, least)
        seen.add(got)
    assert seen == {True, False}


@pytest.mark.parametrize("changed,least", [(0.05, 1.0), (0.1, 0.99), (0.2, 0.95)])
def test_recall_with_changed_words(spark, changed, least):
    rng = random.Random(int(100 * changed))
    items = [(k, sentence(rng, rng.randint(10, 60))) for k in range(150)]
    rows = []
    for k, text in items:
        words = text.split(" ")
        for at in rng.sample(range(len(words)), round(changed * len(words))):
            words[at] = f"changed{at}"
        rows.append((k, f"{sentence(rng, 90)} {' '.join(words)} {sentence(rng, 90)}"))
    found = {x for x in _found(spark, rows, items) if x[0] == x[1]}
    print(changed, len(found) / len(items))
    assert len(found) >= least * len(items)
    assert not _found(spark, [(k, sentence(rng, 400)) for k in range(60)], items)
