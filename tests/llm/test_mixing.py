import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing
from tests.llm.cases import documents, edge_rows

WORDS = {"a": ["red", "green", "blue", "shared"], "b": ["dog", "cat", "cow", "shared"], "c": ["one", "two", "ten", "shared"]}
WEIGHTS = {"a": 0.5, "b": 0.3, "c": 0.2}


def _text(rng, domain, n):
    return " ".join(rng.choices(WORDS[domain], k=n))


def _labelled(spark):
    rng = random.Random(0)
    return spark.createDataFrame([(_text(rng, d, 20), d) for d in "abc" for _ in range(30)], "text string, domain string")


def _rows():
    rng = random.Random(1)
    return edge_rows() + [(i, " ".join([_text(rng, rng.choice("abbcccc"), rng.randint(1, 60)), _text(rng, rng.choice("abc"), rng.randint(0, 20))])) for i in range(100, 400)]


@pytest.mark.parametrize("budget,keep_all", [(None, False), (3000.0, False), (None, True)])
def test_expected_tokens_meet_targets(spark, budget, keep_all):
    rows = _rows()
    rates, have = mixing.mix(documents(spark, rows), _labelled(spark), WEIGHTS, budget, keep_all)
    got = rates.collect()
    assert sum(r.copies for r in got) == len(rows) and len(got) == len(set(rows))
    assert all(r.rate >= keep_all and abs(r.q_0 + r.q_1 + r.q_2 - 1) < 1e-9 for r in got)
    reached = [sum(r.rate * r.n_tokens * r.copies * r[f"q_{k}"] for r in got) for k in range(3)]
    total = sum(reached)
    assert all(abs(x / total - w) < 1e-3 for x, w in zip(reached, WEIGHTS.values(), strict=True))
    assert all(abs(have[d] - x) <= 1e-3 * total for d, x in zip("abc", reached, strict=True))
    if budget:
        assert abs(total - budget) < 1e-2 * budget


def test_rates_are_least_squares_steps_from_one(spark):
    """Among all rates that meet the targets those nearest to one, in the metric of tokens."""
    rates, _ = mixing.mix(documents(spark, _rows()), _labelled(spark), WEIGHTS)
    got = [r for r in rates.collect() if r.n_tokens and r.rate > 0]
    import numpy as np

    q = np.array([[r.q_0, r.q_1, r.q_2] for r in got])
    move = np.array([r.rate - 1 for r in got])
    left = move - q @ np.linalg.lstsq(q, move, rcond=None)[0]
    assert np.abs(left).max() < 1e-4


def test_realised_rows(spark):
    rows = _rows()
    docs = documents(spark, rows)
    rates, _ = mixing.mix(docs, _labelled(spark), WEIGHTS, keep_all=True)
    out = mixing.realise(docs, rates)
    assert out.columns == docs.columns
    times = Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect())
    given = Counter(rows)
    rate = {r.key: r.rate for r in rates.collect()}
    for r in docs.select("doc_id", "text", mixing.row_key().alias("key")).distinct().collect():
        each, rest = divmod(times[r.doc_id, r.text], given[r.doc_id, r.text])
        assert rest == 0 and 0 <= each - int(rate[r.key]) <= 1
        assert each >= 1 or rate[r.key] < 1


def test_classifier_against_counts(spark):
    prior, logs = mixing.domain_model(_labelled(spark), ["a", "b", "c"])
    assert len({round(p, 9) for p in prior}) == 1
    rates, _ = mixing.mix(documents(spark, [(1, "red green"), (2, "cat"), (3, "ten two"), (4, ""), (5, None)]), _labelled(spark), WEIGHTS)
    best = {r.doc_id: max(range(3), key=lambda k: r[f"q_{k}"]) for r in rates.collect()}
    assert (best[1], best[2], best[3]) == (0, 1, 2)
    empty = {r.doc_id: r for r in rates.collect()}
    assert empty[4].n_tokens == empty[5].n_tokens == 0 and abs(empty[5].q_0 - 1 / 3) < 1e-9


def test_empty_tables(spark):
    none = _labelled(spark).limit(0)
    rates, have = mixing.mix(documents(spark, []), none, WEIGHTS)
    assert rates.count() == 0 and all(x == 0 for x in have.values())
    rates, _ = mixing.mix(documents(spark, _rows()[:3]), none, WEIGHTS)
    assert rates.count() == 3


def test_native(spark):
    rates, _ = mixing.mix(documents(spark, _rows()), _labelled(spark), WEIGHTS)
    plan = rates.withColumn("x", F.lit(1))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _plain_rates(q, mass, goal, least):
    """Projected gradient with steps of one, in plain loops until nothing moves."""
    import numpy as np

    rate, weight = np.ones(len(q)), (q * mass[:, None]).sum(0)
    for _ in range(20000):
        have = (q * (rate * mass)[:, None]).sum(0)
        new = np.maximum(least, rate - q @ ((have - goal) / weight))
        if np.abs(new - rate).max() < 1e-13:
            break
        rate = new
    return rate


@pytest.mark.parametrize("least,shares", [(0.0, (0.5, 0.3, 0.2)), (0.0, (0.05, 0.15, 0.8)), (1.0, (0.5, 0.3, 0.2))])
def test_rates_against_plain_loops(spark, least, shares):
    import numpy as np

    rng = np.random.default_rng(4)
    q = rng.dirichlet([0.3, 0.3, 0.3], 200)
    tokens, copies = rng.integers(0, 300, 200), rng.integers(1, 4, 200)
    members = spark.createDataFrame([(i, int(n), int(c), *map(float, x)) for i, (n, c, x) in enumerate(zip(tokens, copies, q, strict=True))], "doc_id int, n_tokens int, copies int, q_0 double, q_1 double, q_2 double")
    mass = (tokens * copies).astype(float)
    goal = np.array(shares) * mass.sum() * (4 if least else 1)
    rated, have, missed = mixing.fit_rates(members, goal.tolist(), least)
    got = np.array([r.rate for r in rated.orderBy("doc_id").collect()])
    assert missed <= mixing.TOLERANCE and np.allclose(have, goal, rtol=1e-5) and (got >= least).all()
    wanted = _plain_rates(q, mass, goal, least)
    assert np.allclose((q * (wanted * mass)[:, None]).sum(0), goal, rtol=1e-5)
    if not least and (wanted > 0).all():
        assert np.abs(got - wanted).max() < 1e-3


def test_targets_that_cannot_be_met_are_marked(spark):
    members = spark.createDataFrame([(1, 10, 1, 0.5, 0.5), (2, 30, 1, 0.5, 0.5)], "doc_id int, n_tokens int, copies int, q_0 double, q_1 double")
    rated, have, missed = mixing.fit_rates(members, [30.0, 10.0])
    assert abs(missed - 1.0) < 1e-3 and [round(x) for x in have] == [20, 20]
    none = spark.createDataFrame([(1, 0, 1, 0.5, 0.5)], "doc_id int, n_tokens int, copies int, q_0 double, q_1 double")
    rated, have, missed = mixing.fit_rates(none, [30.0, 10.0])
    assert [r.rate for r in rated.collect()] == [1.0] and missed == 1.0


def test_posteriors_by_hand(spark):
    """Words counted and multiplied by hand, with buckets from Spark's own hash."""
    import math

    labelled = [("red red blue", "a"), ("dog, Dog!", "b"), ("blue", "a"), ("other", "z")]
    texts = {1: "Red  dog", 2: "blue\nred green " * 200, 3: None}
    words = sorted({w for t in [x for x, _ in labelled] + [texts[1], texts[2]] for w in t.lower().translate(str.maketrans(",!\n", "   ")).split()})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    split = lambda t: [bucket[w] for w in (t or "").lower().translate(str.maketrans(",!\n", "   ")).split()]
    logs, prior = {}, {}
    for d in "ab":
        own = [b for t, x in labelled if x == d for b in split(t)]
        logs[d] = lambda b, own=own: math.log((own.count(b) + 0.5) / (len(own) + 0.5 * mixing.BUCKETS))
        prior[d] = math.log((sum(x == d for _, x in labelled) + 1) / 5)
    table = spark.createDataFrame(labelled, "text string, domain string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in mixing.memberships(docs, mixing.domain_model(table, ["a", "b"]), ["a", "b"], 0.2).collect()}
    for i, t in texts.items():
        z = {d: prior[d] + 0.2 * sum(map(logs[d], split(t))) for d in "ab"}
        assert abs(got[i].q_0 - 1 / (1 + math.exp(z["b"] - z["a"]))) < 1e-9 and got[i].n_tokens == len(split(t))


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "red", "x", 7, 8), (None, "dog", "y", 9, 10)], "doc_id bigint, text string, key string, times int, __key int")
    rates, _ = mixing.mix(docs, _labelled(spark), WEIGHTS, keep_all=True)
    out = mixing.realise(docs, rates)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.collect()}
