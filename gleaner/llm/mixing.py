"""Mixing sources to target weights by soft membership, in DataFrame operations only.

1. A hashed naive Bayes classifier learns domains from a bounded sample of a labelled table. One temperature,
   fitted on labelled rows that their model hasn't seen, scales the evidence of every text.
2. Every document gets domain posteriors and its token count.
3. Nonnegative document rates are fitted by projected gradient so that the expected token total of each domain,
   the sum of rate x tokens x posterior, meets its target: least squares on the totals, each weighed by the
   domain's tokens, from rates of one and in the metric of tokens. A step moves every document's rate against
   its own gradient, the mean miss of its domains, and projects it onto the least rate allowed. The rates stand
   beside the documents; what passes the driver in a step is one number a domain.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

#: Hash buckets of the classifier's tokens.
BUCKETS = 4096
#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 4000
#: Temperatures that are tried.
TEMPERATURES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)
#: Gradient steps at most, steps between two cuts of the lineage, and share of a target that may stay open.
STEPS, SPAN, TOLERANCE = 60, 8, 1e-6
#: A step's length: one never overshoots, since the weighed Gram matrix has no eigenvalue above one.
LONGEST = 64.0
#: What keep_all takes more than the least total, for documents that belong to several domains.
ROOM = 1.05

_MARKS = "\n\r\t.,;:!?|*&%$#\"()[]"


def tokens(text: Column) -> Column:
    """Array of lower-cased words and, at its end, one null that stands for the row itself."""
    flat = F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKS, " " * len(_MARKS))
    return F.concat(F.split(flat, " "), F.array(F.lit(None).cast("string")))


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def domain_model(labelled: DataFrame, domains: list[str]) -> tuple[list[float], DataFrame]:
    """Log priors, and a table (b, l_0 ... l_k) of log token probabilities by bucket, from labelled(text, domain).

    Other domains are left out. Counts are smoothed, so a domain without rows, or an empty table, gives an even
    spread. The table has BUCKETS rows.
    """
    words = labelled.where(F.col("domain").isin(domains)).select("domain", F.explode(tokens(F.col("text"))).alias("t")).where("t is null or t <> ''")
    counts = cut(words.groupBy("domain", F.when(F.col("t").isNull(), -1).otherwise(_bucket(F.col("t"))).alias("b")).count())
    own, all_words = F.sum(F.when(F.col("b") < 0, F.col("count"))), F.sum(F.when(F.col("b") >= 0, F.col("count")))
    seen = {r["domain"]: (r["own"] or 0, r["all"] or 0) for r in counts.groupBy("domain").agg(own.alias("own"), all_words.alias("all")).collect()}  # a row a domain
    rows = [seen.get(d, (0, 0))[0] + 1 for d in domains]
    by_bucket = counts.groupBy("b").agg(*[F.sum(F.when(F.col("domain") == d, F.col("count"))).alias(f"n_{k}") for k, d in enumerate(domains)])
    share = lambda k, d: F.log((F.coalesce(F.col(f"n_{k}"), F.lit(0)) + 0.5) / F.lit(seen.get(d, (0, 0))[1] + 0.5 * BUCKETS)).alias(f"l_{k}")
    every = labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    table = cut(every.join(by_bucket, "b", "left").select("b", *[share(k, d) for k, d in enumerate(domains)]))
    return [math.log(n / sum(rows)) for n in rows], table


def temperature(labelled: DataFrame, domains: list[str]) -> float:
    """What the evidence of labelled(text, domain) is best scaled by, of TEMPERATURES: each half is judged by the other half's model."""
    rows = labelled.where(F.col("domain").isin(domains)).withColumn("half", F.pmod(F.xxhash64("text", "domain"), F.lit(2)))
    lost = None
    for half in (0, 1):
        prior, table = domain_model(rows.where(F.col("half") != half), domains)
        judged = _evidence(rows.where(F.col("half") == half).select(F.struct("domain", "text").alias("row"), "text"), table, len(domains), "row")
        right = F.element_at(F.array(*[F.col(f"l_{k}") for k in range(len(domains))]), F.array_position(F.array(*map(F.lit, domains)), F.col("row.domain")).cast("int"))
        chance = F.element_at(F.array(*map(F.lit, prior)), F.array_position(F.array(*map(F.lit, domains)), F.col("row.domain")).cast("int"))
        loss = [F.sum(_log_total([F.lit(p) + F.col(f"l_{k}") * t for k, p in enumerate(prior)]) - chance - right * t).alias(f"t_{i}") for i, t in enumerate(TEMPERATURES)]
        got = [x or 0.0 for x in judged.agg(*loss).first()]
        lost = got if lost is None else [x + y for x, y in zip(lost, got, strict=True)]
    return min(zip(lost, TEMPERATURES, strict=True))[1] if any(lost) else 1.0


def _log_total(logits: list[Column]) -> Column:
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    return top + F.log(sum((F.exp(z - top) for z in logits[1:]), F.exp(logits[0] - top)))


def _evidence(rows: DataFrame, table: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, copies, all, l_0 ... l_k): log probabilities of the words of rows(keys, text), summed, and their number."""
    words = rows.select(*keys, F.explode(tokens(F.col("text"))).alias("t")).where("t is null or t <> ''")
    words = words.select(*keys, F.col("t").isNull().cast("int").alias("own"), F.when(F.col("t").isNotNull(), _bucket(F.col("t"))).alias("b"))
    told = words.join(F.broadcast(table), "b", "left")  # BUCKETS rows
    sums = [F.coalesce(F.sum(f"l_{i}") / F.sum("own"), F.lit(0.0)).alias(f"l_{i}") for i in range(k)]
    return told.groupBy(*keys).agg(F.sum("own").alias("copies"), F.count("b").alias("all"), *sums)


def sample_labelled(docs: DataFrame, ids: DataFrame, domain: str, limit: int = SAMPLE) -> DataFrame:
    """(text, domain) of at most `limit` documents among ids(doc_id), by the order of a hash of the id."""
    taken = ids.select(F.col("doc_id").cast("bigint")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col(domain).cast("string").alias("domain"))
    joined = rows.join(F.broadcast(taken), "doc_id")  # ids of at most `limit` rows; of rows that share an id, one by a hash
    one = F.min_by(F.struct("text", "domain"), F.xxhash64("text", "domain")).alias("one")
    return joined.groupBy("doc_id").agg(one).select("one.text", "one.domain")


def row_key() -> Column:
    """What parts rows: the id with a hash of the text. Equal rows share it, and are counted."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def memberships(docs: DataFrame, model: tuple[list[float], DataFrame], domains: list[str], scale: float = 1.0) -> DataFrame:
    """(doc_id, key, copies, n_tokens, q_0 ... q_k): posteriors of each distinct row and how often it stands there."""
    prior, table = model
    # the key is made before the words are laid out, else it is made again for each of them
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("key"), "text")
    found = _evidence(keyed, table, len(domains), "doc_id", "key").withColumn("n_tokens", (F.col("all") / F.col("copies")).cast("bigint"))
    logits = [F.lit(p) + F.col(f"l_{k}") * scale for k, p in enumerate(prior)]
    found = found.select("doc_id", "key", "copies", "n_tokens", *[z.alias(f"z_{k}") for k, z in enumerate(logits)])
    total = _log_total([F.col(f"z_{k}") for k in range(len(domains))])
    return found.select("doc_id", "key", "copies", "n_tokens", *[F.exp(F.col(f"z_{k}") - total).alias(f"q_{k}") for k in range(len(domains))])


def fit_rates(members: DataFrame, targets: list[float], least: float = 0.0) -> tuple[DataFrame, list[float], float]:
    """Adds `rate`, at least `least`, to members; also returns the domains' expected totals and their largest miss.

    targets are expected token totals, one a domain; the miss is the largest share of a target that stays open.
    Without tokens every rate is one. A domain that no posterior reaches can't meet its target and counts as
    missed. Step lengths follow from the last two gradients (Barzilai and Borwein), and are one again after a
    step that brings no gain.
    """
    k, mass, goal = len(targets), F.col("n_tokens") * F.col("copies"), np.array(targets)
    totals = lambda rows, rate: np.array([x or 0.0 for x in rows.agg(*[F.sum(rate * mass * F.col(f"q_{d}")).alias(f"s_{d}") for d in range(k)]).first()])
    rows, rate = members.withColumn("rate", F.lit(1.0)), F.col("rate")
    weight = totals(rows, rate)
    reached = weight > 0
    miss = lambda x: float((np.abs(goal - x) / np.maximum(goal, 1.0)).max(initial=0.0))
    have, length, last, best = weight, 1.0, None, None
    for step in range(1, STEPS + 1):
        gradient = np.where(reached, (have - goal) / np.where(reached, weight, 1.0), 0.0)
        if best is None or miss(have) < best[0]:
            best = (miss(have), rows, rate, have)
        if best[0] <= TOLERANCE or not np.abs(gradient).max(initial=0.0) > TOLERANCE / 10:
            break
        if last is not None:
            moved, change = -last[1] * last[0], gradient - last[0]
            # the weighed inner product, in which the Gram matrix is symmetric
            curved = float((weight * moved * change).sum())
            gained = miss(have) <= 2 * best[0]
            length = float(np.clip((weight * moved * moved).sum() / curved, 1.0, LONGEST)) if gained and curved > 0 else 1.0
        pull = length * gradient
        rate = F.greatest(F.lit(least), rate - sum((F.lit(float(x)) * F.col(f"q_{d}") for d, x in enumerate(pull)), F.lit(0.0)))
        if step % SPAN == 0:
            rows, rate = cut(rows.withColumn("rate", rate)), F.col("rate")
        have, last = totals(rows, rate), (gradient, length)
    left, rows, rate, have = best
    return rows.withColumn("rate", F.round(rate, 9)), have.tolist(), left


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None, keep_all: bool = False) -> tuple[DataFrame, dict[str, float]]:
    """Rates for every row of docs(doc_id, text), so that expected tokens by domain stand as the weights.

    labelled(text, domain) trains the classifier. budget is the expected token total (that of docs, if not
    given); keep_all sets it instead to ROOM times the least at which no domain needs a rate under one, and
    takes rates of one or more only, so no document is lost. Returns
    (doc_id, key, copies, n_tokens, q_*, rate, missed), a row for each distinct (doc_id, text) with the number of
    its copies, and the expected totals. missed is the largest share of a target that the rates leave open. Null and empty texts have no tokens, the prior as posterior, and a rate
    like any other; an empty table gives no rows; other columns aren't read.
    """
    domains = sorted(weights)
    members = cut(memberships(docs, domain_model(labelled, domains), domains, temperature(labelled, domains)))
    base = members.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("copies") * F.col(f"q_{d}")), F.lit(0.0)) for d in range(len(domains))]).first()
    share = [weights[d] / sum(weights.values()) for d in domains]
    total = budget if budget is not None else float(sum(base))
    if keep_all:
        total = ROOM * max(b / s for b, s in zip(base, share, strict=True) if s > 0)
    rated, have, missed = fit_rates(members, [total * s for s in share], 1.0 if keep_all else 0.0)
    return rated.withColumn("missed", F.lit(missed)), dict(zip(domains, have, strict=True))


def realise(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """docs with each row as often as its rate says: the whole part always, the rest by a hash of its key.

    All columns of docs stay, whatever their names; rows of null ids count by their texts like others.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("key"))
    fate = F.pmod(F.xxhash64("key", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("rate")
    times = rates.select(F.col("doc_id").alias("rated_id"), F.col("key").alias("rated_key"), (whole + (fate < F.col("rate") - whole).cast("int")).cast("int").alias("times")).where("times > 0")
    both = rows.join(times, (F.col("key") == F.col("rated_key")) & F.col("doc_id").eqNullSafe(F.col("rated_id")))
    return both.select("row", F.explode(F.expr("sequence(1, times)"))).select("row.*")
