"""Raw bank statements as grids of text cells: a Python data source and sink for CSV and XLSX files.

    spark.dataSource.register(Grids)
    spark.read.format("statement_grids").load(folder)                   # (file, row_no, cells)
    rows.write.format("statement_grids").mode("append").save(folder)    # (file, row_no, cells), a file's rows in one task

A partition is a few files, each read as a stream; a file of more than HELD rows is read twice, once for its width, once for its rows, which are
padded to it. Of a workbook the first
sheet is read, from the zipped XML, row by row; only its table of shared texts is held. CSV records are split by a reader that knows
quotes, so a quoted cell may hold line breaks. What a cell is becomes text by fixed rules, the same for both kinds of files:

* nothing is an empty text; a whole number has no decimals (10.0 is ``10``); another number has two (``7881.25``);
* a day, or a moment, is ``dd-mm-yyyy``; a time of day, a span or a truth value is as Python writes it;
* a text loses white space at its ends.
"""

from __future__ import annotations

import csv
import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from itertools import chain, groupby, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Endings of statements, and folders under a statement folder that hold other things.
ENDINGS, OTHER_FOLDERS = ("csv", "xlsx"), ("world", "golden")
#: Files and bytes of a partition, partitions that a folder of few files is dealt to, and rows of a file that are held for its width.
FILES, BYTES, SPREAD, HELD = 32, 8 << 20, 64, 5_000
#: A workbook's own numbers of formats that show a day or a time.
DAY_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def store_of(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{posixpath.abspath(path)}")


def listed(path: str) -> list[str]:
    """The statements under a folder, however deep, or the file that ``path`` is; in order."""
    return [path for path, _ in sized(path)]


def sized(path: str) -> list[tuple[str, int]]:
    """The same with the files' bytes."""
    from pyarrow import fs

    store, root = store_of(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    inner = lambda p: p[len(root) :].strip("/").split("/")
    ours = lambda p: p.rsplit(".", 1)[-1].lower() in ENDINGS and not set(inner(p)[:-1]) & set(OTHER_FOLDERS)
    return sorted((info.path, info.size) for info in found if info.type == fs.FileType.File and ours(info.path))


def text_of(cell) -> str:
    """A cell's text by the rules above."""
    if cell is None:
        return ""
    if isinstance(cell, float):
        return str(int(cell)) if cell == int(cell) else f"{cell:.2f}"
    if isinstance(cell, datetime.date):
        return cell.strftime("%d-%m-%Y")
    return str(cell).strip()


def csv_rows(stream) -> Iterator[list[str]]:
    for row in csv.reader(io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")):
        yield [text_of(cell) for cell in row]


def shows_time(code: str) -> bool:
    """Whether a number format shows a day or a time: it has one of their letters outside quotes, brackets and escapes."""
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[(?!h+\]|m+\]|s+\])[^\]]*\]|\\.|_.', "", code.lower())))


class Workbook:
    """The first sheet of a workbook."""

    def __init__(self, stream):
        self.zipped = zipfile.ZipFile(stream)
        book = ElementTree.fromstring(self.zipped.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zipped.read("xl/_rels/workbook.xml.rels"))}
        target = links[book.find(f"{MAIN}sheets/{MAIN}sheet").get(LINK)]
        self.sheet = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        setup = book.find(f"{MAIN}workbookPr")
        self.first_day = datetime.datetime(1904, 1, 1) if setup is not None and setup.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)
        self.texts = [self.written(item) for item in self.items("xl/sharedStrings.xml", f"{MAIN}si")]
        self.formats = self.styled()

    def items(self, part: str, tag: str) -> Iterator[ElementTree.Element]:
        """The elements of a part, one at a time; none where the part is missing."""
        if part in self.zipped.namelist():
            with self.zipped.open(part) as stream:
                for _, element in ElementTree.iterparse(stream):
                    if element.tag == tag:
                        yield element
                        element.clear()

    @staticmethod
    def written(item: ElementTree.Element) -> str:
        """The text of a string item: its own or that of its runs, without phonetic hints."""
        return "".join(t.text or "" for part in item if part.tag in (f"{MAIN}t", f"{MAIN}r") for t in part.iter(f"{MAIN}t"))

    def styled(self) -> list[str]:
        """Of each cell style what its numbers are: a number, a moment or a span."""
        if "xl/styles.xml" not in self.zipped.namelist():
            return []
        styles = ElementTree.fromstring(self.zipped.read("xl/styles.xml"))
        codes = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
        kinds = []
        for style in styles.findall(f"{MAIN}cellXfs/{MAIN}xf"):
            number = style.get("numFmtId", "0")
            code = codes.get(number, "")
            span = number == "46" or bool(re.search(r"\[(h+|m+|s+)\]", code.lower()))
            kinds.append("span" if span else "moment" if (shows_time(code) if number in codes else int(number) in DAY_FORMATS) else "number")
        return kinds

    def value(self, cell: ElementTree.Element):
        kind, held = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            inner = cell.find(f"{MAIN}is")
            return None if inner is None else self.written(inner)
        if held is None or held.text is None:
            return None
        if kind == "s":
            return self.texts[int(held.text)]
        if kind == "b":
            return bool(int(held.text))
        if kind == "d":
            return datetime.datetime.fromisoformat(held.text.rstrip("Z"))
        if kind != "n":
            return held.text
        number = float(held.text) if re.search("[.eE]", held.text) else int(held.text)
        style = int(cell.get("s", "0"))
        shown = self.formats[style] if style < len(self.formats) else "number"
        if shown == "number":
            return number
        span = datetime.timedelta(milliseconds=round(number * 86_400_000))
        if shown == "span":
            return span
        if 0 <= number < 1:
            return (datetime.datetime(1900, 1, 1) + span).time()
        return self.first_day + span + datetime.timedelta(days=self.first_day.year == 1899 and number < 60)

    def rows(self) -> Iterator[list[str]]:
        """All rows, those that the sheet leaves out included."""
        at = 0
        for row in self.items(self.sheet, f"{MAIN}row"):
            number = int(row.get("r", at + 1))
            yield from ([] for _ in range(at + 1, number))
            at, cells = number, []
            for cell in row.findall(f"{MAIN}c"):
                column = column_number(cell.get("r")) if cell.get("r") else len(cells)
                cells += [""] * (column - len(cells))
                cells.append(text_of(self.value(cell)))
            yield cells


def column_number(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        number = 26 * number + ord(letter) - 64
    return number - 1


def column_letters(number: int) -> str:
    letters = ""
    number += 1
    while number:
        number, last = divmod(number - 1, 26)
        letters = chr(65 + last) + letters
    return letters


def rows_of(path: str) -> Iterator[list[str]]:
    """A file's rows of text cells, as wide as each is."""
    store, inner = store_of(path)
    with store.open_input_file(inner) as stream:
        yield from Workbook(stream).rows() if inner.lower().endswith(".xlsx") else csv_rows(stream)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def dealt(files: list[tuple[str, int]]) -> list[list[str]]:
    """Files (path, bytes) in groups of a few, in their order; a large file is a group of its own."""
    most = min(FILES, -(-len(files) // SPREAD))
    groups, held = [], 0
    for path, size in files:
        if not groups or len(groups[-1]) >= most or held + size > BYTES:
            groups.append([])
            held = 0
        groups[-1].append(path)
        held += size
    return groups


class GridReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        """A partition a few files; without files one that has none."""
        scheme = re.match(r"([a-z0-9]+://[^/]*)", self.path)
        local = not scheme or scheme[1] == "file://"
        return [Files([path if local else f"{scheme[1]}{path}" for path in paths]) for paths in dealt(sized(self.path))] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            rows = rows_of(path)
            first = list(islice(rows, HELD))
            width = max(map(len, chain(first, rows)), default=0)
            for number, row in enumerate(first if len(first) < HELD else rows_of(path)):
                yield path, number, row + [""] * (width - len(row))


class Done(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class GridWriter(DataSourceWriter):
    """Each task writes its files under names of its own; they get their real names when all tasks are done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Done:
        import uuid

        store, root = store_of(self.path)
        files, mark = [], f".part-{uuid.uuid4().hex}"
        for name, own in groupby(rows, key=lambda row: row["file"]):
            if any(file == name for file, _ in files):
                raise ValueError(f"the rows of {name} are not together")
            target = f"{root}/{name}"
            store.create_dir(posixpath.dirname(target), recursive=True)
            with store.open_output_stream(target + mark) as stream:
                (write_workbook if name.lower().endswith(".xlsx") else write_csv)(stream, (row["cells"] for row in own))
            files.append((name, mark))
        return Done(files)

    def commit(self, messages: list) -> None:
        store, root = store_of(self.path)
        names = [name for message in messages if message for name, _ in message.files]
        if len(names) != len(set(names)):
            raise ValueError("a statement's rows are in several partitions")
        for message in messages:
            for name, mark in message.files if message else []:
                store.move(f"{root}/{name}{mark}", f"{root}/{name}")

    def abort(self, messages: list) -> None:
        store, root = store_of(self.path)
        for message in messages:
            for name, mark in message.files if message else []:
                store.delete_file(f"{root}/{name}{mark}")


def write_csv(stream, rows: Iterator) -> None:
    text = io.TextIOWrapper(stream, encoding="utf-8", newline="")
    writer = csv.writer(text, lineterminator="\n")
    for cells in rows:
        writer.writerow([cell["text"] if cell["text"] is not None else text_of(cell["number"] if cell["day"] is None else cell["day"]) for cell in cells])
    text.flush()
    text.detach()


#: The least parts of a workbook of one sheet. Style 1 shows days.
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Statement" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def write_workbook(stream, rows: Iterator) -> None:
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as zipped:
        for name, text in PARTS.items():
            zipped.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
        with zipped.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for number, cells in enumerate(rows, 1):
                held = "".join(cell_xml(f"{column_letters(k)}{number}", cell) for k, cell in enumerate(cells))
                sheet.write(f'<row r="{number}">{held}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")


def cell_xml(reference: str, cell) -> str:
    if cell["day"] is not None:
        return f'<c r="{reference}" s="1"><v>{(cell["day"] - datetime.date(1899, 12, 30)).days}</v></c>'
    if cell["number"] is not None:
        return f'<c r="{reference}"><v>{cell["number"]!r}</v></c>'
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(cell["text"])}</t></is></c>' if cell["text"] else ""


class Grids(DataSource):
    """Statements under a folder; reads (file, row_no, cells), writes rows of that kind with cells of struct<text, number, day>."""

    @classmethod
    def name(cls) -> str:
        return "statement_grids"

    def schema(self) -> str:
        return "file string, row_no long, cells array<string>"

    def reader(self, schema) -> GridReader:
        return GridReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> GridWriter:
        return GridWriter(self.options["path"])


def read(spark, path: str):
    """(file, row_no, cells) of the statements under a folder, or of one file."""
    spark.dataSource.register(Grids)
    return spark.read.format("statement_grids").load(path)


def write(rows, path: str) -> None:
    """Write rows (file, row_no, cells of struct<text string, number double, day date>) as files under a folder; a name's ending says which
    kind. A file's rows go through one task, in order."""
    rows.sparkSession.dataSource.register(Grids)
    rows.select("file", "row_no", "cells").repartition("file").sortWithinPartitions("file", "row_no").write.format("statement_grids").mode("append").save(path)
