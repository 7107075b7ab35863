"""Tied turns, messages without a key, and quotations that were wrapped anew."""

from gleaner.llm import quotes
from tests.llm.test_quotes import SCHEMA


def _found(spark, rows):
    got = quotes.conversations(spark.createDataFrame(rows, SCHEMA), every=True).collect()
    return sorted(((r.thread, r.seq, r.tie, r.position, r.parent, r.parent_tie, r.root, r.root_tie, r.depth, r.n_linked, r.text) for r in got), key=str)


def test_all_messages_of_a_tied_turn_stay(spark):
    rows = [(1, 0, "a", "alpha"), (1, 1, "a", "beta"), (1, 1, "b", "gamma"), (1, 1, "b", "gamma"), (1, 1, "b", None), (1, 2, "a", "> gamma\nyes"), (1, 1, "c", "> beta\nno")]
    assert _found(spark, rows) == sorted([
        (1, 0, 0, 0, None, None, 0, 0, 0, 0, "alpha"), (1, 1, 0, 1, None, None, 1, 0, 0, 0, ""), (1, 1, 1, 2, None, None, 1, 1, 0, 0, "no"),
        (1, 1, 2, 3, None, None, 1, 2, 0, 0, "beta"), (1, 1, 3, 4, None, None, 1, 3, 0, 0, "gamma"), (1, 2, 0, 5, 1, 3, 1, 3, 1, 1, "yes")], key=str)


def test_messages_without_thread_or_seq_stay(spark):
    rows = [(None, 1, "a", "x"), (None, 1, "a", "x"), (2, None, "a", "> x\ny"), (2, 5, "a", "z")]
    assert _found(spark, rows) == sorted([(None, 1, 0, None, None, None, 1, 0, 0, 0, "x")] * 2 + [
        (2, None, 0, None, None, None, None, 0, 0, 0, "y"), (2, 5, 0, 0, None, None, 5, 0, 0, 0, "z")], key=str)


def test_a_quotation_wrapped_anew_is_linked(spark):
    rows = [(1, 0, "a", "one two three four\nfive six\n\nother"), (1, 1, "b", "> one two\n> three four five\n> six\nyes"), (1, 2, "b", "> three four five\nno")]
    got = {r[1]: (r[4], r[9]) for r in _found(spark, rows)}
    assert got == {0: (None, 0), 1: (0, 3), 2: (None, 0)}
