import hashlib
import math
import zlib
from collections import Counter

import pytest

from gleaner.llm import sharding
from tests.llm.cases import documents, edge_rows, sentence


def brute_place(key: str, shards: int) -> int:
    """Down from the root by the least -ln(u) / weight."""
    top = sharding.tree(shards)

    def pick(level, weights):
        def draw(i):
            bits = int(hashlib.md5(f"{key}/{level}{i}".encode()).hexdigest()[:13], 16)
            return -math.log((bits + 0.5) / 2**52) / weights[i]

        return min(weights, key=lambda i: (draw(i), i))

    region = pick("region", {r: sum(map(len, x.values())) for r, x in top.items()})
    rack = pick("rack", {k: len(v) for k, v in top[region].items()})
    return pick("shard", dict.fromkeys(top[region][rack], 1))


def test_contract(spark):
    rows = edge_rows() + [(i, "text " * (i % 7)) for i in range(100, 2000)]
    got = sharding.shard_documents(documents(spark, rows)).collect()
    raw = lambda t: (t or "").encode()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == sorted((-1 if i is None else i, len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t in rows)
    slots = {}
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.law == "key" and r.shard == brute_place(key, 24) and r.grown_shard == brute_place(key, 25)
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(24))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_even_shares():
    n = Counter(brute_place(str(i), 24) for i in range(24_000))
    assert len(n) == 24 and max(n.values()) < 1150 and min(n.values()) > 850


@pytest.mark.parametrize("shards", [1, 4, 8, 23])
def test_a_new_shard_takes_rows_only_into_itself_or_its_subtree(shards):
    for i in range(3000):
        old, new = brute_place(str(i), shards), brute_place(str(i), shards + 1)
        if old != new:
            region = lambda s: s // sharding.RACK // sharding.REGION
            assert region(new) == region(shards) or region(old) == region(new)


def test_empty_table(spark):
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def test_one_id_in_very_many_rows(spark):
    text = sentence(__import__("random").Random(1), 5)
    got = sharding.shard_documents(documents(spark, [(7, text)] * 500)).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(500))


@pytest.mark.parametrize("shards", [0, -8, 1, 25])
def test_counts_for_which_the_law_would_not_hold_are_refused(spark, shards):
    with pytest.raises(ValueError, match="multiple"):
        sharding.shard_documents(documents(spark, []), shards)


@pytest.mark.parametrize("shards", [8, 16, 32])
def test_a_new_region_takes_rows_only_into_itself(shards):
    assert all(brute_place(str(i), shards + 1) in (brute_place(str(i), shards), shards) for i in range(3000))
