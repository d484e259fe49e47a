"""Sinks: exports, reports, and writers that can run twice."""

from __future__ import annotations

import re
import struct
import tempfile
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from archivolt.operators.lifecycle import append_audit
from archivolt.sources import workbook as books


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, ArrayType | MapType | StructType) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    out = flat(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, template: str, *columns: str) -> None:
    """One line per row by a printf template."""
    df.select(F.format_string(template, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value")).write.mode("overwrite").text(path)


def newest(df: DataFrame, n: int, time: str, key: str) -> DataFrame:
    """The rows an export holds: the newest n."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_audit(df: DataFrame, path: str) -> None:
    """Append audit rows of known actions, by day."""
    append_audit(df).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def write_by_document(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace the buckets that df's documents are in; df holds whole buckets.

    Only those partitions are written anew, so a run that is repeated leaves
    the same table.
    """
    parted = df.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))
    parted.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def workbook(sheets: dict[str, DataFrame], most: int = books.SHEET_ROWS) -> bytes:
    """An XLSX file of all rows as text cells: a sheet per frame, and another where one is full.

    Rows come to the driver a partition at a time and are written as they
    come; the file itself is the caller's. For tables too large for one file
    there is `write_workbooks`.
    """
    with tempfile.SpooledTemporaryFile(1 << 24) as file:
        frames = {name: flat(df) for name, df in sheets.items()}
        books.write(file, ((name, df.columns, df.toLocalIterator()) for name, df in frames.items()), most)
        file.seek(0)
        return file.read()


def write_workbooks(df: DataFrame, path: str, sheet: str = "rows") -> None:
    """All rows as XLSX files in a folder that all executors mount, a file per task."""
    books.register(df.sparkSession)
    flat(df).write.format("workbook").option("sheet", sheet).mode("append").save(path)


def report_rows(states: DataFrame, gaps: DataFrame, plans: DataFrame) -> DataFrame:
    """Lines of the report: indicators, the first 15 gaps and 10 of the newest 20 plans."""
    a = states.select(F.lit(1).alias("part"), F.col("code").alias("key"), F.concat_ws(" ", "code", F.coalesce(F.col("value").cast("string"), F.lit("-")), "state").alias("line"))
    b = gaps.orderBy("term").limit(15).select(F.lit(2).alias("part"), F.col("term").alias("key"), F.col("term").alias("line"))
    c = plans.orderBy(F.desc("plan_id")).limit(20).limit(10).select(F.lit(3).alias("part"), F.col("plan_id").cast("string").alias("key"), F.concat_ws(" ", "title", "status").alias("line"))
    return a.unionByName(b).unionByName(c)


def _shown(line: str, font: str) -> tuple[bytes, str]:
    """Operators that show a line, and the font they leave: its letters' own codes, or UTF-16 where these have none."""
    try:
        raw = line.encode("cp1252")
        text, wanted = b"(" + re.sub(rb"[\\()]", rb"\\\g<0>", raw).replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")", "F1"
    except UnicodeEncodeError:
        text, wanted = b"<" + line.encode("utf-16-be", "replace").hex().encode() + b">", "F2"
    return (b"" if wanted == font else f"/{wanted} 11 Tf ".encode()) + text + b" Tj T*", wanted


@cache
def _to_unicode(packed: bool) -> bytes:
    """The map of a font whose codes are UTF-16."""
    ranges = [f"<{n:02x}00> <{n:02x}ff> <{n:02x}00>" for n in range(256)]
    parts = "\n".join(f"{len(r)} beginbfrange\n" + "\n".join(r) + "\nendbfrange" for r in (ranges[i : i + 100] for i in range(0, 256, 100)))
    program = f"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /U def /CMapType 2 def\n1 begincodespacerange <0000> <ffff> endcodespacerange\n{parts}\nendcmap end end".encode()
    return zlib.compress(program) if packed else program


def pdf(title: str, lines: list[str], per_page: int = 45, compact: bool = False) -> bytes:
    """A plain PDF document of text lines, in any script.

    compact packs its objects into streams, with a stream of cross references.
    """
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    bodies: list[tuple[str, bytes | None]] = [
        ("/Type /Catalog /Pages 2 0 R", None),
        ("/Type /Pages /Kids [" + " ".join(f"{7 + 2 * n} 0 R" for n in range(len(pages))) + f"] /Count {len(pages)}", None),
        ("/Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding", None),
        ("/Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 6 0 R", None),
        ("/Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >>", None),
        ("", _to_unicode(compact)),
    ]
    for n, page in enumerate(pages):
        parts, font = [b"BT /F1 11 Tf 50 790 Td 14 TL"], "F1"
        for line in [title, "", *page] if n == 0 and title else page:
            shown, font = _shown(line, font)
            parts.append(shown)
        bodies.append((f"/Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {8 + 2 * n} 0 R", None))
        bodies.append(("", b" ".join([*parts, b"ET"])))
    out, places = bytearray(b"%PDF-1.5\n"), {}

    def put(number: int, info: str, stream: bytes | None, packed: bool) -> None:
        places[number] = (1, len(out), 0)
        out.extend(f"{number} 0 obj\n".encode())
        if stream is None:
            out.extend(f"<< {info} >>".encode())
        else:
            how = " /Filter /FlateDecode" if packed else ""
            stream = zlib.compress(stream) if packed and number != 6 else stream
            out.extend(f"<< {info} /Length {len(stream)}{how} >>\nstream\n".encode() + stream + b"\nendstream")
        out.extend(b"\nendobj\n")

    plain = []
    for number, (info, stream) in enumerate(bodies, 1):
        if compact and stream is None:
            plain.append((number, f"<< {info} >>"))
        else:
            put(number, info, stream, compact)
    total = len(bodies) + 1
    if not compact:
        start = len(out)
        out += f"xref\n0 {total}\n0000000000 65535 f \n".encode() + b"".join(f"{places[n][1]:010d} 00000 n \n".encode() for n in range(1, total))
        return bytes(out) + f"trailer << /Size {total} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
    heads, at = [], 0
    for index, (number, text) in enumerate(plain):
        heads.append(f"{number} {at}")
        at += len(text) + 1
        places[number] = (2, total, index)
    head = " ".join(heads) + " "
    put(total, f"/Type /ObjStm /N {len(plain)} /First {len(head)}", (head + " ".join(t for _, t in plain)).encode(), True)
    places |= {0: (0, 0, 0xFFFF), total + 1: (1, len(out), 0)}
    rows = [struct.pack(">BIH", *places[n]) for n in range(total + 2)]
    above = [bytes(7), *rows[:-1]]
    predicted = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(row, up, strict=True)) for row, up in zip(rows, above, strict=True))
    start = len(out)
    put(total + 1, f"/Type /XRef /Size {total + 2} /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >>", predicted, True)
    return bytes(out) + f"startxref\n{start}\n%%EOF\n".encode()


def pdf_files(docs: DataFrame, per_page: int = 45) -> DataFrame:
    """(file_id, content): the text of each document as a PDF file, a line of text a line; odd ids in compact form.

    docs: document_id, text. A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # files are larger than texts
                ids, texts = (batch.column(c)[at : at + 64].to_pylist() for c in ("document_id", "text"))
                made = [pdf("", (t or "").split("\n"), per_page, bool(i and i % 2)) for i, t in zip(ids, texts, strict=True)]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], names=["file_id", "content"])

    return docs.select("document_id", "text").mapInArrow(run, "file_id long, content binary")
