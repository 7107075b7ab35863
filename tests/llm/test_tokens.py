import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import tokens
from tests.llm.cases import documents, edge_rows, sentence


@pytest.fixture(scope="module")
def counter(spark):
    return tokens.Counter(tokens.read_ranks(spark, tokens.VOCABULARY))


texts = st.text(alphabet="ab'sl l  \n\t1,.é漢", max_size=300)


@settings(max_examples=200, deadline=None)
@given(data=st.data())
def test_any_edit_counts_as_a_whole_recount(counter, data):
    tree = tokens.Tree(data.draw(texts), counter)
    for _ in range(data.draw(st.integers(1, 5))):
        tree.edit(data.draw(st.integers(-3, 320)), data.draw(st.integers(-2, 60)), data.draw(texts))
        assert tree.tokens == len(counter.encoding.encode_ordinary(tree.text))
        assert sum(sum(s) for s, _ in tree.leaves) == len(tree.text) == tree.levels[-1][0][0]


def test_long_text_is_encoded_only_near_its_edits(counter):
    rng = random.Random(2)
    tree = tokens.Tree(sentence(rng, 40_000), counter)
    for _ in range(50):
        tree.edit(rng.randrange(len(tree.text)), rng.randrange(20), rng.choice(["", "word", " two words ", "\n\n"]))
    assert tree.tokens == len(counter.encoding.encode_ordinary(tree.text))
    assert tree.encoded < 50 * 40


class Unparsing:
    """A counter that refuses to cut a whole text."""

    def __init__(self, counter):
        self.counts, self.parts = counter.counts, self
        self.match = counter.parts.match

    def findall(self, text):
        raise AssertionError("a whole text was parsed")


@settings(max_examples=100, deadline=None)
@given(data=st.data())
def test_stored_trees_take_edits_unparsed(counter, data):
    tree = tokens.Tree(data.draw(texts), counter)
    for _ in range(data.draw(st.integers(1, 4))):
        tree = tokens.Tree.stored(tree.text, *tree.columns(), Unparsing(counter))
        tree.edit(data.draw(st.integers(-3, 320)), data.draw(st.integers(-2, 60)), data.draw(texts))
        assert tree.tokens == len(counter.encoding.encode_ordinary(tree.text))


def test_leaves_grow_and_shrink(counter):
    rng = random.Random(5)
    tree = tokens.Tree(sentence(rng, 5_000), counter)
    for i in range(120):
        at = rng.randrange(len(tree.text) + 1)
        tree.edit(at, *((0, sentence(rng, 300)) if i % 3 == 0 else (rng.randrange(4_000), "")))
        assert max(len(s) for s, _ in tree.leaves) <= 2 * tokens.LEAF
        again = tokens.Tree.stored(tree.text, *tree.columns(), counter)
        assert again.levels == tree.levels and tree.levels[0] == [(sum(s), sum(n)) for s, n in tree.leaves]
        for below, above in zip(tree.levels, tree.levels[1:], strict=False):
            assert above == [tree._sum(below, k) for k in range(-(-len(below) // tokens.FANOUT))]
    assert tree.tokens == len(counter.encoding.encode_ordinary(tree.text))


def test_long_pretokens_are_stored(counter):
    tree = tokens.Tree("a " + "x" * 70_000 + " b", counter)
    again = tokens.Tree.stored(tree.text, *tree.columns(), counter)
    assert [tuple(map(list, x)) for x in again.leaves] == [tuple(x) for x in tree.leaves]


def test_batches_of_edits_follow_one_another(spark, counter):
    rng = random.Random(9)
    rows = [(i, sentence(rng, 20 * i)) for i in range(30)] + [(3, None), (None, "no id"), (4, "own text")]
    edit = lambda seq, at: "array(named_struct('seq', %d, 'at', cast(%s as bigint), 'removed', 4L, 'added', ' once more '))" % (seq, at)
    trees = tokens.stored(tokens.planted(documents(spark, rows)))
    whole = {r.doc_id: r.n_tokens for r in trees.collect() if r.doc_id}
    for at in ("length(text) / 2", "length(text) / 3", "0"):
        trees = tokens.stored(tokens.regrown(trees.withColumn("edits", F.expr(edit(0, at)))))
    got = trees.collect()
    assert len(got) == len(rows) and all(r.n_tokens_after == len(counter.encoding.encode_ordinary(r.text)) for r in got)
    assert all("once more" in r.text and r.n_pretokens_encoded < 40 for r in got) and max(whole.values()) > 500


def test_edits_by_document(spark, counter):
    rows = edge_rows()
    edits = [(5, 1, 3, 4, "x"), (5, 0, 0, 2, "Start "), (6, 0, 10**9, 5, " end"), (2, 0, 0, 0, "new"), (1, None, None, None, None), (None, 0, 0, 1, "z"), (99, 0, 0, 1, "z")]
    table = spark.createDataFrame(edits, "doc_id bigint, seq bigint, at bigint, removed bigint, added string")
    got = tokens.edited_counts(documents(spark, rows), table).collect()

    def after(i, text):
        for _, at, n, new in sorted((e[1:] for e in edits if i is not None and e[0] == i), key=lambda e: (e[0] is not None, e[0] or 0)):
            at = min(max(at or 0, 0), len(text))
            text = text[:at] + (new or "") + text[at + (n or 0) :]
        return text

    count = lambda t: len(counter.encoding.encode_ordinary(t))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.n_tokens, r.n_tokens_after) for r in got), key=key) == sorted(((i, count(t or ""), count(after(i, t or ""))) for i, t in rows), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, seq bigint, at bigint, removed bigint, added string")
    assert tokens.edited_counts(documents(spark, []), none).count() == 0
    assert tokens.edited_counts(documents(spark, [(1, "a b")]), none).first()["n_edits"] == 0
