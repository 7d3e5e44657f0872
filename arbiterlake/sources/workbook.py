"""Workbooks (.xlsx): sheets out of tables and tables out of sheets, with the standard library's zip and XML.

Writing is a data source: every task writes its rows as fragments of their sheets, and the commit joins the
fragments into the one file that a workbook is, so nothing is left of a task or job that fails. Reading takes
workbooks as binary files, from any store that Spark reads, one task a workbook, and streams its sheets.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
import zlib
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Decimal
from io import BytesIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BooleanType, DateType, DecimalType, NumericType, TimestampNTZType, TimestampType

FORMAT = "arbiterlake_workbook"
#: Fixed limits and looks: rows that a sheet can have, rows that set the width of columns, their least and largest width.
MOST_ROWS, WIDTH_ROWS, WIDTHS = 1_048_576, 80, (12, 42)
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Cell styles: 0 plain, 1 header, 2 date, 3 time.
_STYLES = f"""{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm:ss"/></numFmts>
<fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts>
<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF1F4E79"/></patternFill></fill></fills>
<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>
<cellXfs count="4"><xf applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf><xf fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf>
<xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>"""
_EPOCH = datetime(1899, 12, 30)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _text(value: str, style: int = 0) -> str:
    """An inline text cell; characters that XML cannot hold are written as ``_xHHHH_``."""
    safe = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", value)
    safe = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\r￾￿\ud800-\udfff]", lambda c: f"_x{ord(c[0]):04X}_", safe)
    return f'<c t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(safe)}</t></is></c>'


def _cell(kind: str | None, value: str | None) -> str:
    if value is None:
        return "<c/>"
    if kind == "n":
        return f"<c><v>{value}</v></c>"
    if kind == "b":
        return f'<c t="b"><v>{int(value == "true")}</v></c>'
    if kind in ("d", "t"):
        at = datetime.fromisoformat(value)
        serial = Decimal((at - _EPOCH) // timedelta(microseconds=1)) / Decimal(86_400_000_000)
        return f'<c s="{2 if kind == "d" else 3}"><v>{serial}</v></c>' if at >= _EPOCH else _text(value)
    return _text(value)


@dataclass
class Fragments(WriterCommitMessage):
    """What one task wrote: (task, sheet, file, rows, lengths of the first rows' cells)."""

    parts: list


class WorkbookWriter(DataSourceWriter):
    """Rows (``sheet``, ``cells`` of kind and text) as sheets of one workbook, in the order of tasks and rows."""

    def __init__(self, options: dict):
        self.path, self.sheets = options["path"], json.loads(options["sheets"])
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator) -> Fragments:
        store, inside = _filesystem(self.parts)
        store.create_dir(inside, recursive=True)
        task, made, now, packer, out = TaskContext.get().partitionId(), [], None, None, None
        for row in iterator:
            if row["sheet"] != now:
                if out:
                    out.write(packer.flush())
                    out.close()
                now, packer = row["sheet"], zlib.compressobj(1)
                name = f"{inside}/{uuid.uuid4().hex}"
                out = store.open_output_stream(name, compression=None)
                made.append([task, now, name, 0, []])
            made[-1][3] += 1
            if made[-1][3] <= WIDTH_ROWS:
                made[-1][4].append([len(c["text"] or "") for c in row["cells"]])
            out.write(packer.compress(f"<row>{''.join(_cell(c['kind'], c['text']) for c in row['cells'])}</row>".encode()))
        if out:
            out.write(packer.flush())
            out.close()
        return Fragments(made)

    def commit(self, messages: list) -> None:
        store, inside = _filesystem(self.path)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p[0])
        try:
            with store.open_output_stream(f"{inside}.writing", compression=None) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
                self._frame(book)
                for i, (name, columns) in enumerate(self.sheets):
                    own = [p for p in parts if p[1] == i]
                    if sum(p[3] for p in own) >= MOST_ROWS:
                        raise ValueError(f"sheet {name} has more rows than a workbook can hold")
                    self._sheet(book, i, columns, own, store)
            store.move(f"{inside}.writing", inside)
        finally:
            self.clear()

    def _frame(self, book: zipfile.ZipFile) -> None:
        sheet = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        numbers = range(1, len(self.sheets) + 1)
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{sheet}.worksheet+xml"/>' for i in numbers)
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{sheet}.styles+xml"/>{overrides}</Types>')
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in zip(numbers, self.sheets))
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="rId0" Type="{_RELS}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", _STYLES)

    def _sheet(self, book: zipfile.ZipFile, i: int, columns: list[str], own: list, store) -> None:
        lengths = [[len(c) for c in columns], *(x for p in own for x in p[4])][: WIDTH_ROWS + 1]
        widths = [min(max(max(x[c] for x in lengths) + 2, WIDTHS[0]), WIDTHS[1]) for c in range(len(columns))]
        cols = "".join(f'<col min="{c}" max="{c}" width="{w}" customWidth="1"/>' for c, w in enumerate(widths, 1))
        with book.open(f"xl/worksheets/sheet{i + 1}.xml", "w", force_zip64=True) as out:
            pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
            out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}">{pane}{f"<cols>{cols}</cols>" if cols else ""}<sheetData><row>{"".join(_text(c, 1) for c in columns)}</row>'.encode())
            for _, _, name, _, _ in own:
                unpack = zlib.decompressobj()
                with store.open_input_stream(name, compression=None) as file:
                    while chunk := file.read(1 << 20):
                        out.write(unpack.decompress(chunk))
            out.write(b"</sheetData></worksheet>")

    def abort(self, messages: list) -> None:
        self.clear()

    def clear(self) -> None:
        store, inside = _filesystem(self.parts)
        from pyarrow import fs

        if store.get_file_info(inside).type == fs.FileType.Directory:
            store.delete_dir(inside)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options))


def _kind(t) -> str:
    kinds = ((BooleanType, "b"), (NumericType, "n"), (DateType, "d"), ((TimestampType, TimestampNTZType), "t"))
    return next((k for c, k in kinds if isinstance(t, c)), "s")


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """The tables as sheets of one workbook at ``path`` (which Arrow reaches on driver and executors), in their order.

    Header rows are frozen and marked, columns as wide as their first rows ask for. Numbers, booleans, dates and
    times keep their kind, nested columns become JSON; a number that is not finite is text, a null an empty cell. The
    rows go out as each table's tasks have them, without a shuffle; a sheet of more rows than the format has raises.
    """
    from .sinks import flat

    if not sheets:
        raise ValueError("a workbook has a sheet at least")
    spark, every = next(iter(sheets.values())).sparkSession, None
    spark.dataSource.register(WorkbookSource)
    named = []
    for i, (name, df) in enumerate(sheets.items()):
        df = flat(df)
        named.append((name[:31], df.columns))

        def cell(f):
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, DecimalType):
                c = F.format_string("%s", c)
            shown = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if _kind(f.dataType) == "t" else c.cast("string")
            kind = F.when(shown.isin("NaN", "Infinity", "-Infinity"), "s").otherwise("n") if _kind(f.dataType) == "n" else F.lit(_kind(f.dataType))
            return F.struct(kind.alias("kind"), shown.alias("text"))

        cells = F.array(*map(cell, df.schema.fields)) if df.columns else F.array().cast("array<struct<kind:string,text:string>>")
        part = df.select(F.lit(i).alias("sheet"), cells.alias("cells"))
        every = part if every is None else every.unionByName(part)
    every.write.format(FORMAT).option("sheets", json.dumps(named)).mode("append").save(path)


def _column_of(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _dates(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root, tag = ElementTree.fromstring(book.read("xl/styles.xml")), f"{{{_MAIN}}}"
    shown = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", x.get("formatCode", "")) for x in root.iter(f"{tag}numFmt")}
    is_date = lambda n: 14 <= n <= 22 or 45 <= n <= 47 or bool(re.search("[ymdhs]", shown.get(n, "").lower()))
    styles = root.find(f"{tag}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else ()) if is_date(int(x.get("numFmtId", 0)))}


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and members of the sheets, in order."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    targets = [(x.get("name"), links[x.get(f"{{{_RELS}}}id")]) for x in root.iter(f"{{{_MAIN}}}sheet")]
    return [(n, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for n, t in targets]


def _shown(text: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _rows(book: zipfile.ZipFile, member: str, shared: list[str], dates: set[int]):
    tag = f"{{{_MAIN}}}"
    with book.open(member) as file:
        number = 0
        for _, row in ElementTree.iterparse(file):
            if row.tag != f"{tag}row":
                continue
            number = int(row.get("r", number + 1))
            cells: list[str | None] = []
            for c in row.iter(f"{tag}c"):
                at = _column_of(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, value = c.get("t", "n"), c.find(f"{tag}v")
                text = value.text if value is not None else None
                if kind == "inlineStr":
                    cells[at] = _shown("".join(t.text or "" for t in c.iter(f"{tag}t")))
                elif text is None:
                    continue
                elif kind == "s":
                    cells[at] = shared[int(text)]
                elif kind == "b":
                    cells[at] = "true" if text == "1" else "false"
                elif kind == "n" and int(c.get("s", 0)) in dates:
                    moment = _EPOCH + timedelta(microseconds=round(Decimal(text) * 86_400_000_000))
                    cells[at] = moment.date().isoformat() if moment.time() == datetime.min.time() else moment.isoformat(sep=" ")
                else:
                    cells[at] = _shown(text) if kind == "str" else text
            yield number, cells
            row.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``sheet``, ``sheet_no``, ``row`` (from 1) and ``cells`` of all rows of the workbooks at ``path``.

    Cells are texts: numbers as they are written, booleans as true and false, dates and times in ISO form;
    empty cells are null, cells after a row's last one are absent.
    """
    schema = "path string, sheet string, sheet_no int, row int, cells array<string>"

    def run(batches):
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "sheet", "sheet_no", "row", "cells"])

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(BytesIO(content.as_buffer())) as book:
                    shared, tag = [], f"{{{_MAIN}}}"
                    if "xl/sharedStrings.xml" in book.namelist():
                        with book.open("xl/sharedStrings.xml") as file:
                            for _, x in ElementTree.iterparse(file):
                                if x.tag == f"{tag}si":
                                    shared.append(_shown("".join(t.text or "" for p in x for t in ([p] if p.tag == f"{tag}t" else p.iter(f"{tag}t") if p.tag == f"{tag}r" else ()))))
                                    x.clear()
                    dates, rows = _dates(book), []
                    for no, (sheet, member) in enumerate(_sheets(book)):
                        for number, cells in _rows(book, member, shared, dates):
                            rows.append((name, sheet, no, number, cells))
                            if len(rows) >= 1000:
                                yield out(rows)
                                rows = []
                    if rows:
                        yield out(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the sheets that have a row, in order."""
    rows = read_workbooks(spark, path).select("sheet_no", "sheet").distinct().orderBy("sheet_no").collect()
    return [r["sheet"] for r in rows]


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet as a table: names from its first row, whole and decimal numbers where all values are such, all else text.

    Columns without a name or a value and rows without a value are left out; a missing sheet raises.
    """
    rows = read_workbooks(spark, path).filter(F.col("sheet") == sheet)
    header = rows.orderBy("row").limit(1).collect()
    if not header:
        raise ValueError(f"no sheet {sheet} in {path}")
    names = {i: n for i, n in enumerate(header[0]["cells"]) if n}
    body = rows.filter(F.col("row") > header[0]["row"]).select("row", *(F.get("cells", F.lit(i)).alias(n) for i, n in names.items()))
    if not names:
        return body.drop("row")
    of = lambda n: F.col(f"`{n}`")
    plain = lambda n: of(n).rlike(r"^-?(?:0|[1-9]\d{0,17})$")  # noqa: E731  codes such as 007 stay text
    figures = lambda n: of(n).rlike(r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?$")
    known = body.agg(*(F.struct(F.count(of(n)).alias("n"), F.count_if(plain(n)).alias("whole"), F.count_if(figures(n)).alias("figures")).alias(f"c{i}") for i, n in names.items())).first()
    kept = {i: n for i, n in names.items() if known[f"c{i}"]["n"]}
    kind = lambda c: "bigint" if c["whole"] == c["n"] else "double" if c["figures"] == c["n"] else "string"
    full = body.filter(F.coalesce(*(of(n) for n in kept.values())).isNotNull()) if kept else body.limit(0)
    return full.select(*(of(n).cast(kind(known[f"c{i}"])).alias(n) for i, n in kept.items()))
