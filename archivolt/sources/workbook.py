"""XLSX workbooks as a data source: a partition per sheet, rows read and written as they stream by."""

from __future__ import annotations

import glob
import itertools
import os
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SHEET_NS, REL_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MAIN, LINK = f"{{{SHEET_NS}}}", f"{{{REL_NS}}}id"
SHEET_ROWS = 1_048_576  # fixed value: rows of a sheet in this format
ODD = re.compile(r"_(?=x[0-9A-Fa-f]{4}_)|[\x00-\x08\x0b-\x1f\ufffe\uffff]")
CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")
ROWS = 1000
SCHEMA = "file string, sheet string, place int, row int, cells array<string>"
ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("place", pa.int32()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])


class Sheet(InputPartition):
    def __init__(self, path: str, name: str, place: int, part: str):
        self.path, self.name, self.place, self.part = path, name, place, part


def sheets_of(path: str) -> list[Sheet]:
    """The sheets of a workbook in their order; only its list of sheets is read."""
    with zipfile.ZipFile(path) as z:
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
        target = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        return [Sheet(path, s.get("name"), n, target(links[s.get(LINK)])) for n, s in enumerate(found)]


def plain(text: str) -> str:
    return CODED.sub(lambda m: chr(int(m[1], 16)), text)


def _text(node) -> str:
    """Text of a string item: its runs, without the marks of pronunciation."""
    runs = [t for t in node.findall(f"{MAIN}t")] + [t for r in node.findall(f"{MAIN}r") for t in r.findall(f"{MAIN}t")]
    return plain("".join(t.text or "" for t in runs))


def column_of(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{MAIN}si":
                out.append(_text(node))
                node.clear()
    return out


def rows_of(path: str, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """(number, cells) of the rows of a sheet; a cell that is not there is null, numbers and dates come as they are stored."""
    with zipfile.ZipFile(path) as z:
        strings, number, root = shared_strings(z), 0, None
        with z.open(part) as f:
            for event, node in ElementTree.iterparse(f, events=("start", "end")):
                if event == "start":
                    root = node if node.tag == f"{MAIN}sheetData" else root
                    continue
                if node.tag != f"{MAIN}row":
                    continue
                number = int(node.get("r") or number + 1)
                cells: list[str | None] = []
                for c in node.findall(f"{MAIN}c"):
                    at = column_of(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = c.get("t", "n"), c.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        inline = c.find(f"{MAIN}is")
                        cells[at] = _text(inline) if inline is not None else None
                    elif value is not None and value.text is not None:
                        cells[at] = strings[int(value.text)] if kind == "s" else plain(value.text) if kind == "str" else {"0": "FALSE", "1": "TRUE"}.get(value.text) if kind == "b" else value.text
                yield number, cells
                if root is not None:
                    root.clear()


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Sheet]:
        path = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "**", "*.xlsx"), recursive=True)) if os.path.isdir(path) else [path]
        return [s for f in files for s in sheets_of(f)]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[str | None]]] = []

        def batch() -> pa.RecordBatch:
            n = len(held)
            columns = [[partition.path] * n, [partition.name] * n, [partition.place] * n, [r for r, _ in held], [c for _, c in held]]
            held.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

        for row in rows_of(partition.path, partition.part):
            held.append(row)
            if len(held) == ROWS:
                yield batch()
        if held:
            yield batch()


def _row(values: Iterable) -> str:
    """A row of text cells; characters that XML has not are written by their numbers, null as no value."""
    cells = ("" if v is None else escape(ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", str(v))) for v in values)
    return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{c}</t></is></c>' for c in cells) + "</row>"


def write(file: BinaryIO, sheets: Iterable[tuple[str, list[str], Iterator[Iterable]]], most: int = SHEET_ROWS) -> None:
    """Write sheets (name, header, rows) as rows come; a sheet of `most` rows goes on in another."""
    names: list[str] = []
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for name, header, rows in sheets:
            first, part = next(rows, None), 1
            while part == 1 or first is not None:
                names.append(name[:31] if part == 1 else f"{name[:22]} ({part})")
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<?xml version="1.0"?><worksheet xmlns="{SHEET_NS}"><sheetData>{_row(header)}'.encode())
                    for row in itertools.islice(itertools.chain([] if first is None else [first], rows), most - 1):
                        sheet.write(_row(row).encode())
                    sheet.write(b"</sheetData></worksheet>")
                first, part = next(rows, None), part + 1
        kind, n = "application/vnd.openxmlformats-officedocument.spreadsheetml", range(1, len(names) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in n)
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL_NS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(x, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, x in zip(n, names, strict=True))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{SHEET_NS}" xmlns:r="{REL_NS}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{REL_NS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>")


@dataclass
class Written(WriterCommitMessage):
    part: str


class WorkbookWriter(DataSourceArrowWriter):
    """A file per task, under another name until all tasks are done."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.sheet, self.columns = options["path"].removeprefix("file://"), options.get("sheet", "rows"), columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        part = os.path.join(self.path, f".{uuid.uuid4().hex}.part")
        rows = (row for batch in iterator for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        with open(part, "wb") as file:
            write(file, [(self.sheet, self.columns, rows)])
        return Written(part)

    def commit(self, messages: list[Written | None]) -> None:
        for n, m in enumerate(messages):
            if m is not None:
                os.rename(m.part, os.path.join(self.path, f"part-{n:05d}-{uuid.uuid4().hex}.xlsx"))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                os.remove(m.part)


class WorkbookSource(DataSource):
    """spark.read.format("workbook").load(path) and df.write.format("workbook").save(path): on storage that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        if overwrite:
            raise ValueError("workbooks are only added to a folder")
        return WorkbookWriter(self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, place, row, cells) of all sheets of the workbooks at a path; rows count from 1."""
    register(spark)
    return spark.read.format("workbook").load(path)
