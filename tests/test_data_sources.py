import csv
import io
import json
import os
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from gleaner.functions.fixed import EXPORT_COLUMNS
from gleaner.sources import datasources, sheet

HEADERS = list(EXPORT_COLUMNS.values())


@pytest.fixture(autouse=True)
def _registered(spark):
    datasources.register(spark)


def _write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode("utf-8-sig"))
    return str(folder)


def test_headers_in_any_order_and_spelling(spark, tmp_path):
    at = _write(tmp_path / "s", "a.csv", 'Website,ignored,COMPANY name,Careers URL\r\n https://a.example ,x,"Acme, ""A""",\r\n,,  ,https://b.example\r\n\r\nN/A,y,"Two\nlines"\r\n')
    _write(tmp_path / "s", "b.csv", "company,career_url,website,it_link\nBeta,https://c,https://d,https://e\n")
    df = spark.read.format("company_sheet").load(at)
    got = df.orderBy("row_id").collect()
    assert [tuple(r)[1:] for r in got] == [('Acme, "A"', "https://a.example", "", ""), ("Two\nlines", "N/A", "", ""), ("Beta", "https://d", "https://c", "https://e")]
    assert df.rdd.getNumPartitions() == 2
    some = spark.read.format("company_sheet").schema("company string").load(at)
    assert some.columns == ["company"] and some.count() == 3


def test_sheets_that_are_none(spark, tmp_path):
    at = _write(tmp_path / "s", "a.csv", "name,site\nx,y\n")
    with pytest.raises(Exception, match="columns not found"):
        spark.read.format("company_sheet").load(at).collect()
    with pytest.raises(Exception, match="isn't there"):
        spark.read.format("company_sheet").load(str(tmp_path / "none")).collect()
    with pytest.raises(Exception, match="has no other"):
        spark.read.format("company_sheet").schema("other string").load(_write(tmp_path / "t", "a.csv", "company,career_url,website\nx,,\n")).collect()


def test_as_the_other_reader(spark, tmp_path):
    at = _write(tmp_path / "s", "a.csv", "company,career_url,website\n" + "".join(f"C{i},https://{i}.example, w{i} \n" for i in range(10_000)))
    one = spark.read.format("company_sheet").load(at).drop("row_id")
    two = sheet.read_companies(spark, at).select(*one.columns)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty() and one.count() == 10_000


def _jobs(spark, n, parts=3):
    long = "t" * 100
    return spark.range(n).repartition(parts).select(*[F.concat(F.lit(f'{c}, "q" é '), F.col("id").cast("string"), F.lit(long if c == "job_title" else "")).alias(c) for c in EXPORT_COLUMNS], F.lit(1).alias("extra"))


def _read(folder):
    rows = []
    for name in sorted(os.listdir(folder)):
        raw = open(f"{folder}/{name}", "rb").read()
        if name.endswith(".csv"):
            assert raw.startswith(datasources.MARK)
            lines = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
        elif name.endswith(".xlsx"):
            ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
            page = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("xl/worksheets/sheet1.xml"))
            lines = [["".join(t.text or "" for t in c.iter(f"{ns}t")) for c in row] for row in page.iter(f"{ns}row")]
            assert [float(c.get("width")) for c in page.iter(f"{ns}col")][0] >= datasources.NARROW
        else:
            continue
        assert lines[0] == HEADERS
        rows += lines[1:]
    return sorted(rows), json.load(open(f"{folder}/_columns.json"))


@pytest.mark.parametrize("kind", ["csv", "xlsx"])
def test_published_once_and_read_back(spark, tmp_path, kind):
    at = str(tmp_path / "jobs")
    for n in (50, 20):  # the second takes the place of the first
        _jobs(spark, n).write.format("posting_sheet").option("kind", kind).mode("overwrite").save(at)
    rows, told = _read(at)
    assert rows == sorted(list(r)[:-1] for r in _jobs(spark, 20).collect())
    assert told["rows"] == 20 and {c["header"]: c["width"] for c in told["columns"]}[EXPORT_COLUMNS["job_title"]] == 70
    assert os.listdir(tmp_path) == ["jobs"]


def test_no_postings_have_a_header(spark, tmp_path):
    _jobs(spark, 0).write.format("posting_sheet").mode("overwrite").save(str(tmp_path / "jobs"))
    assert _read(tmp_path / "jobs")[0] == []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "jobs")
    _jobs(spark, 5).write.format("posting_sheet").mode("overwrite").save(at)
    bad = _jobs(spark, 50).withColumn("location", F.when(F.col("job_title").contains(" 33t"), F.raise_error(F.lit("broken"))).otherwise(F.col("location")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("posting_sheet").mode("overwrite").save(at)
    assert os.listdir(tmp_path) == ["jobs"] and _read(at)[1]["rows"] == 5


def test_a_held_target_gets_a_stamped_neighbour(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "jobs")
    _jobs(spark, 5).write.format("posting_sheet").mode("overwrite").save(at)
    _jobs(spark, 7).write.format("posting_sheet").mode("append").save(at)  # not to be replaced
    other = next(f for f in os.listdir(tmp_path) if f.startswith("jobs-"))
    assert _read(at)[1]["rows"] == 5 and _read(tmp_path / other)[1]["rows"] == 7
    writer = datasources._SheetWriter(at, "csv", True)
    store = datasources.fs.LocalFileSystem()

    class Held:
        def __getattr__(self, name):
            return getattr(store, name)

        def move(self, a, b):
            if a == at:
                raise PermissionError("held open")
            store.move(a, b)

    store.create_dir(writer.staged)
    (tmp_path / os.path.basename(writer.staged) / "x").write_text("")
    writer._publish(Held(), at)
    assert _read(at)[1]["rows"] == 5 and len([f for f in os.listdir(tmp_path) if f.startswith("jobs-")]) >= 1 and not os.path.exists(writer.staged)
