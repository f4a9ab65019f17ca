"""Spreadsheets: a data source that reads .xlsx sheets, and a writer of small reports. Only the standard library is needed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(data: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """The cells of a sheet as text, row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot()]
        for _, row in ElementTree.iterparse(z.open(f"xl/worksheets/sheet{sheet}.xml")):
            if row.tag != f"{NS}row":
                continue
            out: list[str | None] = []
            for n, cell in enumerate(row.iter(f"{NS}c")):
                at = column_number(cell.get("r")) if cell.get("r") else n
                value, inline = cell.find(f"{NS}v"), cell.find(f"{NS}is")
                text = "".join(t.text or "" for t in inline.iter(f"{NS}t")) if inline is not None else value.text if value is not None else None
                out += [None] * (at + 1 - len(out))
                out[at] = shared[int(text)] if cell.get("t") == "s" and text is not None else text
            row.clear()
            yield out


class Sheet(DataSourceReader):
    def __init__(self, schema: StructType, data: bytes, sheet: int):
        self.schema, self.data, self.sheet = schema, data, sheet

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        width = len(self.schema)
        for n, row in enumerate(rows(self.data, self.sheet)):
            if n:
                yield tuple((row + [None] * width)[: width - 1]) + (n - 1,) if self.schema[-1].name == "source_row" else tuple((row + [None] * width)[:width])


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").load(path)``: text columns named by the first row, and ``source_row``."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _data(self) -> bytes:
        with open(self.options["path"].removeprefix("file://"), "rb") as f:
            return f.read()

    def schema(self) -> StructType:
        from pyspark.sql.types import LongType

        head = next(rows(self._data(), int(self.options.get("sheet", 1))), [])
        return StructType([*(StructField(h or f"column_{i}", StringType()) for i, h in enumerate(head)), StructField("source_row", LongType())])

    def reader(self, schema: StructType) -> Sheet:
        return Sheet(schema, self._data(), int(self.options.get("sheet", 1)))


def read(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    return spark.read.format("xlsx").option("path", path).option("sheet", sheet).load()


def write(path: str, sheets: dict[str, DataFrame], most_rows: int = 100_000) -> None:
    """A report of several sheets for people to open. A sheet that has more than ``most_rows`` is refused: write a table instead."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        book = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{book}</sheets></workbook>')
        rel = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel}</Relationships>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        for i, df in enumerate(sheets.values(), 1):
            found = df.limit(most_rows + 1).collect()
            if len(found) > most_rows:
                raise ValueError(f"sheet {names[i - 1]} has more than {most_rows} rows")
            cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
            lines = [df.columns, *found]
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{NS[1:-1]}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in lines) + "</sheetData></worksheet>")
