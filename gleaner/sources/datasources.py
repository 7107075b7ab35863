"""Spark data sources in Python: the sheet of companies to read, and a sheet of postings to write.

    register(spark)
    spark.read.format("company_sheet").load("file:///data/companies")
    jobs.write.format("posting_sheet").option("kind", "xlsx").mode("overwrite").save("file:///out/jobs")

Paths are local ones or URIs that pyarrow's file systems know; on a cluster all executors have to see them. Where only
Spark's readers know a store, sheet.read_companies reads it.
"""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import unquote
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gleaner.functions.fixed import EXPORT_COLUMNS, HEADER_ALIASES
from gleaner.sources.sheet import SheetError, resolve

_BLANKS = " \t\n\x0b\f\r\xa0"
#: Rows of a sheet that are handed over together, and rows that a page of a workbook may have.
BATCH, LONGEST = 4096, 1_048_576
#: Least and greatest width of a column, and what it has more than its longest text.
NARROW, WIDE, MARGIN = 12, 70, 2
MARK = b"\xef\xbb\xbf"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; Spark and Hadoop write local URIs with one slash or three."""
    if re.match("file:/", path):
        return fs.LocalFileSystem(), unquote(re.sub("^file:/+", "/", path))
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The sheets at a path: itself, or the CSV files of a folder by name."""
    store, at = _at(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise SheetError(f"{path} isn't there")
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.path.lower().endswith(".csv"))


def _cells(path: str, file: str) -> Iterator[list[str]]:
    store, _ = _at(path)
    with store.open_input_stream(file) as raw:
        yield from csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""))


@dataclass
class _Sheet(InputPartition):
    number: int
    file: str


class CompanySheet(DataSource):
    """(row_id, company, website, career_url, it_link), or those of a given schema, of CSV files whose columns go by several names.

    Each file is a partition, read as a stream by its own header; row_id grows with the place. Cells are text without outer
    blanks, a missing column is empty; rows that name no company go. A sheet without its required columns is an error that
    says what it has, for the first file when the query is planned.
    """

    @classmethod
    def name(cls) -> str:
        return "company_sheet"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise SheetError(f"{self.options['path']} holds no sheet")
        resolve(next(_cells(self.options["path"], files[0]), []))
        return StructType([StructField("row_id", LongType()), *[StructField(c, StringType()) for c in HEADER_ALIASES]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SheetReader(self.options["path"], schema)


class _SheetReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, [f.name for f in schema.fields]
        unknown = [c for c in self.columns if c != "row_id" and c not in HEADER_ALIASES]
        if unknown:
            raise SheetError(f"a sheet of companies has no {', '.join(unknown)}")

    def partitions(self) -> list[InputPartition]:
        return [_Sheet(i, f) for i, f in enumerate(_files(self.path))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without sheets
            return
        rows = _cells(self.path, partition.file)
        try:
            at = resolve(next(rows, []))
        except SheetError as e:
            raise SheetError(f"{partition.file}: {e}") from None
        held: list[list] = []

        def batch():
            arrays = [pa.array([r[i] for r in held], pa.int64() if c == "row_id" else pa.string()) for i, c in enumerate(self.columns)]
            return pa.RecordBatch.from_arrays(arrays, self.columns)

        cell = lambda row, c: row[at[c]].strip(_BLANKS) if c in at and at[c] < len(row) else ""
        for n, row in enumerate(rows):
            if cell(row, "company"):
                held.append([(partition.number << 33) + n if c == "row_id" else cell(row, c) for c in self.columns])
                if len(held) == BATCH:
                    yield batch()
                    held.clear()
        if held:
            yield batch()


@dataclass
class _Part(WriterCommitMessage):
    file: str
    rows: int
    longest: list[int]


def _width(longest: int) -> int:
    return min(max(longest + MARGIN, NARROW), WIDE)


def _workbook(out, headers: list[str], rows: list[list[str]], widths: list[int]) -> None:
    """One page of texts: the header in bold and held in view, columns as wide as their texts."""
    def cells(values: list[str], style: str = "") -> str:
        return "<row>" + "".join(f'<c t="inlineStr"{style}><is><t xml:space="preserve">{escape(_plain(v))}</t></is></c>' for v in values) + "</row>"

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    top = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'{top}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
                      f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>')
        book.writestr("_rels/.rels", f'{top}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{top}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Jobs" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{top}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'{top}<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        with book.open("xl/worksheets/sheet1.xml", "w") as page:
            columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
            page.write(f'{top}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>{columns}</cols><sheetData>{cells(headers, ' s="1"')}'.encode())
            for r in rows:
                page.write(cells(r).encode())
            page.write(b"</sheetData></worksheet>")


def _plain(text: str) -> str:
    """Without the characters that XML can't hold."""
    return "".join(c for c in text if c in "\t\n\r" or ord(c) >= 32 and c not in "￾￿")


class PostingSheet(DataSource):
    """Writes postings under the headers of the exported sheet: a folder of CSV files (with a byte order mark) or workbooks.

    Tasks write their parts into a folder of their own beside the target. commit gives that folder the target's name, once,
    with _columns.json (rows, headers, widths) in it; where the target can't be replaced, since someone holds it open, it
    gets a name with the time instead. Where a task fails, abort takes the folder away and the target stays as it was.
    Options: kind (csv or xlsx).
    """

    @classmethod
    def name(cls) -> str:
        return "posting_sheet"

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in EXPORT_COLUMNS])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        missing = [c for c in EXPORT_COLUMNS if c not in schema.names]
        if missing:
            raise SheetError(f"postings without {', '.join(missing)}")
        kind = self.options.get("kind", "csv")
        if kind not in ("csv", "xlsx"):
            raise SheetError(f"a sheet is csv or xlsx, not {kind}")
        return _SheetWriter(self.options["path"].rstrip("/"), kind, overwrite)


class _SheetWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.staged = f"{_at(path)[1]}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, _ = _at(self.path)
        store.create_dir(self.staged, recursive=True)
        name, headers = f"part-{uuid.uuid4().hex}", list(EXPORT_COLUMNS.values())
        longest, n, files, rows = [len(h) for h in headers], 0, [], []
        text = None

        def finish() -> None:
            nonlocal text, rows
            if self.kind == "csv" and text:
                text.close()
            elif self.kind == "xlsx" and rows:
                files.append(f"{name}-{len(files)}.xlsx")
                with store.open_output_stream(f"{self.staged}/{files[-1]}") as out:
                    buffer = io.BytesIO()
                    _workbook(buffer, headers, rows, [_width(x) for x in longest])
                    out.write(buffer.getvalue())
            text, rows = None, []

        for batch in iterator:
            columns = [[v or "" for v in batch.column(batch.schema.get_field_index(c)).cast(pa.string()).to_pylist()] for c in EXPORT_COLUMNS]
            longest = [max([w, *map(len, c)]) for w, c in zip(longest, columns, strict=True)]
            for row in zip(*columns, strict=True):
                n += 1
                if self.kind == "xlsx":
                    rows.append(list(row))
                    if len(rows) == LONGEST - 1:
                        finish()
                    continue
                if text is None:
                    files.append(f"{name}.csv")
                    out = store.open_output_stream(f"{self.staged}/{files[-1]}")
                    out.write(MARK)
                    text = io.TextIOWrapper(out, encoding="utf-8", newline="")
                    lines = csv.writer(text)
                    lines.writerow(headers)
                lines.writerow(row)
        finish()
        return _Part(",".join(files), n, longest)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, target = _at(self.path)
        parts = [m for m in messages if m is not None]
        headers = list(EXPORT_COLUMNS.values())
        store.create_dir(self.staged, recursive=True)
        widths = [_width(max([len(h), *[p.longest[i] for p in parts]])) for i, h in enumerate(headers)]
        files = [f for p in parts for f in p.file.split(",") if f]
        if not files:  # no postings: a sheet with its header alone
            files = [f"part-none.{self.kind}"]
            with store.open_output_stream(f"{self.staged}/{files[0]}") as out:
                buffer = io.BytesIO()
                if self.kind == "xlsx":
                    _workbook(buffer, headers, [], widths)
                else:
                    buffer.write(MARK + (",".join(headers) + "\r\n").encode())
                out.write(buffer.getvalue())
        # what a task that ran twice has left isn't part of the result
        for info in store.get_file_info(fs.FileSelector(self.staged)):
            if info.base_name not in files:
                store.delete_file(info.path)
        told = {"rows": sum(p.rows for p in parts), "columns": [{"header": h, "width": w} for h, w in zip(headers, widths, strict=True)], "files": sorted(files)}
        with store.open_output_stream(f"{self.staged}/_columns.json") as out:
            out.write(json.dumps(told).encode())
        self._publish(store, target)

    def _publish(self, store: fs.FileSystem, target: str) -> None:
        stamped, again = f"{target}-{datetime.now(UTC):%Y%m%d-%H%M%S}", 1
        while store.get_file_info(stamped if again == 1 else f"{stamped}-{again}").type != fs.FileType.NotFound:
            again += 1
        stamped = stamped if again == 1 else f"{stamped}-{again}"
        there = store.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            store.move(self.staged, stamped)
            return
        old = f"{self.staged}.old"
        try:
            if there:
                store.move(target, old)
            store.move(self.staged, target)
        except OSError:
            if there and store.get_file_info(target).type == fs.FileType.NotFound and store.get_file_info(old).type != fs.FileType.NotFound:
                store.move(old, target)
            store.move(self.staged, stamped)
            return
        if there:
            (store.delete_dir if store.get_file_info(old).type == fs.FileType.Directory else store.delete_file)(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _at(self.path)
        if store.get_file_info(self.staged).type == fs.FileType.Directory:
            store.delete_dir(self.staged)


def register(spark: SparkSession) -> None:
    for source in (CompanySheet, PostingSheet):
        spark.dataSource.register(source)
