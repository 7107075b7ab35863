import hashlib
import random

import numpy as np

import pytest

from gleaner.llm import repeats
from tests.llm.cases import documents, edge_rows, sentence


def brute(rows, length=100):
    """The definition itself: every string of `length` bytes and where it first starts."""
    order = sorted({(i is not None, i or 0, hashlib.sha256((t or "").encode()).hexdigest()): (i, (t or "").encode()) for i, t in rows}.items())
    seen, out = set(), {}
    for _, (i, b) in order:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if x in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(x)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out[i, b] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((i if i is not None else -1, *out[i, (t or "").encode()]) for i, t in rows)


def found(spark, rows):
    got = repeats.digests(repeats.without_repeats(documents(spark, rows))).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def test_edge_cases(spark):
    rows = edge_rows()
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_repetitive_texts(spark, seed):
    rng = random.Random(seed)
    passages = [sentence(rng, rng.randint(5, 60)) for _ in range(12)] + ["ab" * 150, "z" * 260, "0123456789" * 30]
    rows = []
    for i in range(60):
        parts = rng.choices(passages, k=rng.randint(0, 6)) + [sentence(rng, rng.randint(0, 20))]
        rng.shuffle(parts)
        text = rng.choice([" ", "", "\n"]).join(parts)
        if text and rng.random() < 0.4:
            k = rng.randrange(len(text))
            text = text[:k] + "Q" + text[k + 1 :]
        rows.append((rng.randrange(40) if seed == 2 else i * 3, text))
    assert found(spark, rows) == brute(rows)


def test_long_text_in_pieces(spark):
    rng = random.Random(9)
    block = sentence(rng, 400)
    rows = [(1, "".join(rng.choice([block, sentence(rng, 100)]) + " " for _ in range(800))), (2, block[50:900])]
    assert len(rows[0][1]) > 1 << 20
    assert found(spark, rows) == brute(rows)


def test_hot_trigger(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HELD", 50)
    rng = random.Random(4)
    core = sentence(rng, 12)
    rows = [(i, sentence(rng, 6) + core + sentence(rng, 6) + core) for i in range(80)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("length", [8, 9, 24, 100])
def test_suffix_ranks_are_the_order_of_bytes(length):
    rng = random.Random(length)
    data = bytes(rng.choice(b"\x00ab\xff") for _ in range(3)) * 200 + bytes(rng.choice(b"ab") for _ in range(500)) + bytes(300)
    rank = repeats.suffix_ranks(np.frombuffer(data, np.uint8), length).tolist()
    whole = [data[i : i + length] for i in range(len(data) - length + 1)]
    order = {x: i for i, x in enumerate(sorted(set(whole)))}
    pairs = sorted(zip(whole, rank, strict=False))
    assert all((a[0] == b[0]) == (a[1] == b[1]) and a[1] <= b[1] for a, b in zip(pairs, pairs[1:], strict=False)) and len(order) > 10


def test_many_texts_of_one_id(spark):
    rng = random.Random(6)
    core = sentence(rng, 30)
    rows = [(rng.choice([None, 7]), sentence(rng, 3) + core + str(i)) for i in range(60)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("copies", [1, 50, 200])
def test_repeated_rows_are_parsed_once(spark, copies):
    """However often a row stands in the table, its removed places are listed once."""
    rng = random.Random(8)
    core = sentence(rng, 40)
    rows = [(1, core)] + [(2, " ".join([sentence(rng, 30), core] * 3))] * copies + [(None, "x " + core)] * copies
    _, distinct = repeats._numbered(documents(spark, rows))
    assert distinct.count() == 3
    places = repeats.removed_places(distinct).groupBy("doc").count().collect()
    assert sum(r["count"] for r in places) < 40
    assert found(spark, rows) == brute(rows)


def test_few_spelt_strings_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HELD", 50)
    monkeypatch.setattr(repeats, "SPELT", 40)
    rng = random.Random(4)
    core = sentence(rng, 12)
    rows = [(i, sentence(rng, 6) + core + sentence(rng, 6) + core) for i in range(60)]
    assert found(spark, rows) == brute(rows)
