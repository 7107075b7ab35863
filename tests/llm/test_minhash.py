import random
import re
from string import ascii_lowercase, ascii_uppercase

import pytest

from gleaner.llm import minhash
from tests.llm.cases import documents, edge_rows, sentence, union_find

_TABLE = str.maketrans(ascii_uppercase, ascii_lowercase)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_TABLE))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    named = list(range(len(rows)))
    pairs = [(a, b) for a in named for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    of = union_find(pairs, named)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[of[k]] = min(i, least.get(of[k], i))
    component = [least.get(of[k]) for k in named]
    return sorted(((i, len(sets[k]), component[k], i is not None and i == component[k]) for k, (i, _) in enumerate(rows)), key=repr)


def found(spark, rows, **kw):
    got = minhash.near_duplicate_classes(documents(spark, rows), **kw).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted(map(tuple, got), key=repr)


def changed(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "Changed"
    return " ".join(words)


@pytest.mark.parametrize("sizes", [{}, {"tile": 4, "tile_shingles": 300}])
def test_classes_as_by_brute_force(spark, sizes):
    """Copies, and texts with so many changed words that some link and some don't, in groups and in chains."""
    rng = random.Random(7)
    rows = [(i, sentence(rng, rng.randint(1, 150))) for i in range(40)]
    rows += [(100 + i, changed(rng, rows[rng.randrange(12)][1], rng.randint(0, 3)).replace(" ", rng.choice([" ", "\n", "\t "]))) for i in range(110)]
    text = sentence(rng, 120)
    for i in range(30):  # each is near the one before it only
        text = changed(rng, text, 1)
        rows.append((300 + i, text))
    rng.shuffle(rows)
    assert found(spark, rows, **sizes) == brute(rows)


def test_one_group_of_a_third_with_a_common_passage(spark):
    """Many texts share half of their shingles and aren't near; a large group is, all with one another."""
    rng = random.Random(8)
    passage, base = sentence(rng, 40), sentence(rng, 100)
    rows = [(i, passage + " " + sentence(rng, rng.randint(3, 40))) for i in range(120)] + [(200 + i, changed(rng, base, 1)) for i in range(60)] + [(400 + i, base) for i in range(40)]
    assert found(spark, rows, tile=16, tile_shingles=800) == brute(rows)


def test_edge_cases(spark):
    assert found(spark, edge_rows()) == brute(edge_rows())
    assert found(spark, []) == []
    assert found(spark, [(3, None), (3, ""), (None, " ")]) == [(3, 0, 3, True), (3, 0, 3, True), (None, 0, None, False)]


def test_recall_at_the_threshold():
    """A pair at 0.85 shares the prefix of a region in some tree but for one in four million."""
    assert (1 - 0.85**minhash.LEAST) ** minhash.TREES < 2.5e-7
