"""Rows that every operator on documents has to bear."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators might use names of for their own.
CLASHING = ["fp", "key", "node", "shard", "rate", "slot", "score", "found", "kept", "n", "sub", "doc"]


def sentence(rng: random.Random, n: int) -> str:
    syllables = ["ba", "ke", "li", "mo", "nu", "pra", "sti", "tor", "ven", "zul"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def documents(spark, rows, clash: bool = True):
    """documents of (doc_id, text) with all columns of the table, and others that clash."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("own") for c in CLASHING})
    return df


def edge_rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    text = sentence(rng, 60)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, text), (6, text), (6, text), (None, text), (None, None),
            (7, "Ünïcödé ñ 漢字 " * 8), (8, sentence(rng, 30_000)), (9, "a" * 50_000), (10, text + " and more"), (11, "x")]


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
