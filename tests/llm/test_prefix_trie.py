import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from gleaner.llm import prefix_trie
from tests.llm.cases import sentence

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute(rows, family=20, longest=4):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [x[1] for x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % longest
        whole = tuple(own.get(c - int(math.fmod(c, family)), [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), children[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in members)


def found(spark, rows, clash=False, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if clash:
        df = df.withColumns({c: F.lit("own") for c in ("key", "a", "n", "first", "turns", "code", "depth", "leaf_upto")})
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.conversation_trie(df).select(*cols).collect())


def test_trie_as_by_brute_force(spark):
    rng = random.Random(3)
    said = [sentence(rng, rng.randint(0, 4)) for _ in range(5)]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(said)) for c in rng.sample(range(200), 90) for t in range(rng.randint(1, 7))]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", "x y"), (0, 1, "user", "x y"), (7, 2, None, "z"), (7, None, "user", ""), (9, 1, "a", "late"), (9, 1, "a", "early"), (-3, 1, "u", "below"),
            (None, 1, "user", "nobody's"), (41, 5, "u", " a\tb "), (60, 1, "ü", "漢字 ñ"), (61, 1, "ü", "漢字 ñ"), (63, 2, "ü", "long " * 20_000)]
    assert found(spark, rows, clash=True) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_a_third_of_all_conversations_is_one(spark):
    """Equal conversations are one row from the first aggregate on, and their ids are printed in pieces."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 2000, 20) for t in range(3)] + [(c, 0, "user", f"own {c}") for c in range(1, 150)]
    size, prefix_trie.CHUNK = prefix_trie.CHUNK, 50
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        prefix_trie.CHUNK = size


def test_turnless_and_very_long(spark):
    """A conversation whose few turns are those of an absent first one has none; one of many turns is a path."""
    absent = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][:2]
    rows = [(c, t, "user", "gone") for c in absent for t in range(2)] + [(40, t, "user", f"t {t % 7}") for t in range(200)]
    got = found(spark, rows)
    assert got == brute(rows) and (min(absent), 0, -1, 3, 1, 1, 0) == got[[r[1] for r in got].index(0)][:7]
    assert max(r[1] for r in got) == 200
