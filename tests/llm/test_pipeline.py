import __spark_entry__
import corpus_pipeline
import pytest
from gleaner.llm import linear, simhash
from gleaner.llm.common import use_shared_checkpoints
from gleaner.llm.queries import table
from tests.llm import test_decontaminate, test_simhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage kept, in order, with the documents first."""
    use_shared_checkpoints(spark)
    docs, out = table(spark, DATA, "documents"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[:-1])


def test_quality(spark, kept):
    model = linear.quality_model(kept[0], table(spark, DATA, "labels"))
    scores = linear.scored(kept[0], model, linear.word_ngrams, 1, 3).collect()
    assert ids(kept[1]) == sorted(r.doc_id for r in scores if r.predicted)
    assert 0 < len(ids(kept[1])) < len(ids(kept[0]))


def test_near_duplicates(kept):
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    assert ids(kept[2]) == sorted({c for _, _, c in test_simhash.brute(rows)})


def test_decontaminated(spark, kept):
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    rows = [(r.doc_id, r.text) for r in kept[2].collect()]
    leaks = {x[0] for x in test_decontaminate.brute(rows, items)}
    assert ids(kept[3]) == sorted(set(ids(kept[2])) - leaks)


def test_mixed_loses_no_document(kept):
    assert set(ids(kept[4])) == set(ids(kept[3]))
    assert kept[4].join(kept[3], kept[3].columns, "left_anti").count() == 0


def test_sharded(kept):
    assert ids(kept[5]) == ids(kept[4])


def test_run_and_registration(spark, kept):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, kept[5].collect()))


def test_whole_pipeline_on_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, DATA, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert simhash.RADIUS == 3
