"""The registered queries over whole tables, against SQL or plain loops."""

import hashlib
import math
import zlib
from pathlib import Path

import duckdb
import pytest

from gleaner.llm import queries, tokens
from tests.llm import test_sharding, test_simhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in queries.table(spark, DATA, "documents").collect()}


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_as_in_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, DATA)
    there = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in there.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(there.fetchall(), key=repr)


def test_op1_counts_edited_texts_anew(spark, texts):
    counter = tokens.Counter(tokens.read_ranks(spark, tokens.VOCABULARY))
    got = {r.doc_id: (r.n_tokens, r.n_tokens_after) for r in queries.op1_token_counts(spark, DATA).collect()}
    for i, text in texts.items():
        now, n = text or "", len(text or "")
        for share, removed, added in ((0.25, 5, ""), (0.5, 0, " newly written "), (0.75, 7, "\n\n  It's 42! ")):
            at = min(math.floor(n * share), len(now))
            now = now[:at] + added + now[at + removed :]
        assert got.pop(i) == (counter.whole(text or ""), counter.whole(now))
    assert not got


def test_op3_classes(spark, texts):
    rows = list(texts.items())
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, DATA).collect())
    assert got == test_simhash.brute(rows)


def test_op7_places(spark, texts):
    for r in queries.op7_sharding(spark, DATA).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert (r.shard, r.grown_shard) == (test_sharding.brute_place(str(r.doc_id), 24), test_sharding.brute_place(str(r.doc_id), 25))


def test_op10_bytes(spark, texts):
    for r in queries.op10_media(spark, DATA).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
