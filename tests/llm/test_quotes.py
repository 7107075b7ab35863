import random
import re

import pytest

from gleaner.llm import quotes
from tests.llm.cases import sentence

SCHEMA = "thread bigint, seq bigint, role string, text string"


def _norm(s):
    return re.sub(r"[\W_]+", " ", s.lower()).strip()


def brute(rows):
    """Message by message: holders of each quoted line, votes, and the chain to the root."""
    first = {}
    for t, s, role, text in rows:
        if t is not None and s is not None:
            key = (text is not None, text or "", role is not None, role or "")
            if (t, s) not in first or key < first[t, s][0]:
                first[t, s] = (key, role, text)
    out = {}
    for t, s in sorted(first):
        text = first[t, s][2] or ""
        own, quoted = [], {}
        for line in re.split("\r?\n|\r", text):
            mark = re.match(r"^(\s*>[\s>]*)?", line)[0]
            level, plain = mark.count(">"), _norm(line[len(mark) :])
            if level and plain:
                quoted[level, plain] = len(plain)
            if not re.match(r"^\s*>", line):
                own.append(line)
        out[t, s] = {"own": {_norm(x) for x in own if _norm(x)}, "quoted": quoted, "text": "\n".join(own).strip()}
    got = []
    for (t, s), m in out.items():
        votes, linked = {}, 0
        for (level, plain), size in m["quoted"].items():
            said = [k[1] for k in out if k[0] == t and plain in out[k]["own"]]
            holders = [x for x in said if x < s]
            linked += bool(holders)
            for h in holders:
                votes.setdefault(level, {}).setdefault(h, 0)
                votes[level][h] += size
        best = {level: max(v, key=lambda h: (v[h], h)) for level, v in sorted(votes.items())}
        m["parent"] = best.get(1)
        m["depth"], m["root"] = (0, s) if m["parent"] is None else (out[t, m["parent"]]["depth"] + 1, out[t, m["parent"]]["root"])
        place = sum(k[0] == t and k[1] < s for k in out)
        got.append((t, s, place, m["parent"], m["root"], m["depth"], " ".join(f"{k}:{v}" for k, v in best.items()), len(m["quoted"]), linked, m["text"]))
    return sorted(got, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", hash string")
    got = quotes.conversations(df, every=False).collect()
    return sorted(((r.thread, r.seq, r.position, r.parent, r.root, r.depth, r.links, r.n_quoted, r.n_linked, r.text) for r in got), key=str)


def test_random_threads(spark):
    rng = random.Random(3)
    rows = []
    for t in range(25):
        said = []
        for s in range(rng.randint(1, 14)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                if said:
                    old = rng.choice(said)
                    lines += [">" * rng.randint(1, 2) + rng.choice([" ", "", "> "]) + rng.choice([str.upper, str])(x) + rng.choice(["", "!!"]) for x in old.split("\n") if not x.startswith(">")]
            lines += [sentence(rng, rng.randint(0, 6)) for _ in range(rng.randint(0, 3))] + rng.choice([[], ["Thanks"], ["..."]])
            said.append("\n".join(lines))
            rows.append((t, s * 3000, rng.choice(["a", "b"]), said[-1]))
    assert found(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, 0, "a", None), (1, 1, None, ""), (1, 2, "b", "> nothing known\nyes"), (1, 3, "a", ">yes\r\n>> >\n>>> deep"), (1, 3, "a", "twice"), (1, 3, "a", "twice"),
            (None, 1, "a", "x"), (2, None, "a", "x"), (2, 5, "a", "yes"), (2, 6, "b", "> YES!\n" + "word " * 20_000), (2, 7, "b", "> yes\n> " + "word " * 20_000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_long_chain(spark):
    rows = [(1, i, "a", f"> line {i - 1} here\nline {i} here") for i in range(70)]
    got = found(spark, rows)
    assert got == brute(rows) and max(r[5] for r in got) == 69


def test_mail_form_gives_back_the_turns(spark):
    turns = spark.createDataFrame([(1, i, "u", f"turn number {i}\n\nof this talk {i}") for i in range(6)], "conv_id bigint, turn bigint, role string, text string")
    got = {r.seq: r for r in quotes.conversations(quotes.as_mail(turns), every=False).collect()}
    assert [got[i].parent for i in range(6)] == [None, 0, 1, 2, 3, 4]
    assert all(got[i].text == f"turn number {i}\n\nof this talk {i}" for i in range(6))


def test_the_parent_holds_most_of_the_quotation(spark):
    rows = [(1, 0, "a", "line A\nline B\nline C\nand more"), (1, 1, "b", "line A\nline B\nline D"), (1, 2, "a", "> line A\n> line B\n> line C\n>> line D\nyes")]
    got = {r[1]: (r[3], r[6]) for r in found(spark, rows)}
    assert got[2] == (0, "1:0 2:1") and found(spark, rows) == brute(rows)


def test_common_lines_and_long_threads(spark):
    rows = [(1, i * 700, "a", f"Thanks\nnumber {i}") for i in range(30)] + [(1, i * 700 + 1, "b", f"> thanks\n> number {i - 3}\nyes {i}") for i in range(30)] + [(1, 50000, "c", "> Thanks\nbye"), (1, 50001, "c", ">> Thanks")]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("k", [16, 17, 400])
def test_a_line_that_all_say_doesnt_hide_the_parent(spark, k):
    """Every message says one line; the last quotes it with a line that only message 3 says."""
    rows = [(1, i, "a", f"the same line here\nown text number {i}") for i in range(k)] + [(1, k, "b", "> the same line here\n> own text number 3\nyes")]
    got = {r[1]: r[3] for r in found(spark, rows)}
    assert got[k] == 3 and all(got[i] is None for i in range(k))


def test_combinations_of_common_lines(spark, monkeypatch):
    """Lines that many say, in all combinations, quoted in all combinations, with rare ones among them and not."""
    monkeypatch.setattr(quotes, "MANY", 3)
    rng = random.Random(11)
    common = [sentence(rng, n) for n in (2, 3, 3, 5)]
    rows = []
    for i in range(120):
        lines = ["> " + x for x in common if rng.random() < 0.4] + [">> " + x for x in common if rng.random() < 0.2]
        lines += [f"> only {rng.randrange(max(i, 1))}"] * (rng.random() < 0.3) + [x for x in common if rng.random() < 0.4] + [f"only {i}"] * (rng.random() < 0.5)
        rng.shuffle(lines)
        rows.append((1, i, "a", "\n".join(lines)))
    assert found(spark, rows) == brute(rows)


def test_ten_thousand_holders(spark):
    rows = [(1, i, "a", f"thanks\nown {i}") for i in range(10_000)] + [(1, 10_000 + i, "b", f"> thanks\n> own {3 * i}\nno {i}") for i in range(1000)] + [(1, 11_000, "c", "> thanks")]
    got = {r[1]: r[3] for r in found(spark, rows)}
    assert all(got[10_000 + i] == 3 * i for i in range(1000)) and got[11_000] == 9999
