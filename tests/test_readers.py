"""Every query over pages and payloads against the postings that its cases hold, and what the readers are made of."""

from pathlib import Path

import duckdb
import pytest

from gleaner.functions.lineage import use_shared_checkpoints
from gleaner.operators import dom, paging
from gleaner.plans import readers, runs, value_cases

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


_QUERIES = readers.queries() | runs.queries() | value_cases.queries()
_SQL = readers.oracle_sql() | runs.oracle_sql() | value_cases.oracle_sql()


@pytest.mark.parametrize("name", _SQL)
def test_as_in_sql(spark, duck, name):
    df = _QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    there = duck.execute(_SQL[name])
    names = [c[0] for c in there.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in there.fetchall()), key=repr)
    assert want and sorted(map(tuple, df.select(*columns).collect()), key=repr) == want


@pytest.mark.parametrize("value,text", [
    (None, ""), (True, ""), ("  a\xa0 b ", "a b"), (7, "7"), ([1, "x", 1, None, {"name": "y"}], "1, x, y"), (list("abcdefgh"), "a, b, c, d, e, f"), ({}, ""), ({"other": "x"}, ""),
    ({"city": "Oslo", "region": "", "country": {"name": "Norway"}}, "Oslo, Norway"), ({"label": {"text": "deep"}}, "deep"), ({"name": "n", "town": "t"}, "t"),
])
def test_text_of_values(value, text):
    assert dom.text_of(value) == text


def test_nesting_beyond_bounds_is_no_text():
    value = "x"
    for _ in range(2000):
        value = [value]
    assert dom.text_of(value) == ""


@pytest.mark.parametrize("raw,value", [
    ('{"a": 1};', {"a": 1}), (" [1] ; ", [1]), ("{&quot;a&quot;: 2}", {"a": 2}), ('"a" b', None), ("", None), ("nothing", None), ("[" * 100000, None), (r'{"u": "a\/b"}', {"u": "a/b"}),
])
def test_literals(raw, value):
    assert dom.decoded(raw) == value


def _card(markup):
    tree = dom.Tree(markup)
    anchors = [n for n in tree.nodes if n.tag == "a"]
    return [n.attrs.get("id") for n in dom.cards(tree, anchors)]


def test_cards():
    link = '<a href="/jobs/1">x</a>'
    assert _card(f'<div id="far"><li id="near"><p id="own">{link}</p></li></div>') == ["near"]
    assert _card(f'<div id="all"><div id="a">{link}</div><div id="b">{link}</div></div>') == ["all", "all"]
    assert _card(f'<div id="all"><div id="a">{link}</div><div id="b">{link}{link}</div></div>') == ["a", "b", "b"]
    assert _card(f'<div id="own">{link * 4}</div>') == ["own"] * 4
    assert _card('<div id="9">' + "".join(f'<div id="{8 - i}">' for i in range(9)) + link) == ["7"]


def test_walks_end_at_pages_seen(spark):
    edges = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "a", 1), (1, "b", "c", 2), (2, "a", "a", 1)], "board int, url string, next_url string, place int")
    starts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "z"), (1, "a")], "board int, url string")
    assert sorted(map(tuple, paging.next_chain(edges, starts).collect())) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a"), (3, 1, "z")]
    assert sorted(map(tuple, paging.next_chain(edges, starts, 2).collect())) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (3, 1, "z")]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class Absent:
                            @staticmethod
                            def isDefined():
                                return False
                        return Absent
                return Inner

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, other):
                return other

    with pytest.raises(ValueError, match="shar"):
        use_shared_checkpoints(Session)
