"""Spreadsheets, documents and drawings as tables of text segments.

Files are read whole by Spark's binaryFile source, one row per file, and parsed per row in an Arrow batch; only
the standard library is needed. A file that can't be parsed yields one row with its error and no text, so one bad
file never stops a run. Rows carry seq, because a table has no order of its own.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = "path string, seq bigint, sheet string, row int, col int, handle string, entity_type string, layer string, block_name string, layout_name string, raw_text string, text string, error string"
#: Inline format groups and codes of drawing texts.
MTEXT = re.compile(r"\{\\.*?;|\}|\\P|\\~|\\[A-Za-z0-9]+;?")


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, length and content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "length", "content")


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def parse_xlsx(data: bytes) -> Iterator[dict]:
    """Every cell with text: sheet, row and col from 0. Empty cells and "nan" are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{S}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
            target = targets[sheet.get(f"{R}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for c in root.iter(f"{S}c"):
                ref, kind = c.get("r", ""), c.get("t", "n")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{S}t"))
                else:
                    v = c.find(f"{S}v")
                    value = "" if v is None else v.text or ""
                    if kind == "s" and value:
                        value = shared[int(value)]
                value = value.strip()
                if value and value != "nan":
                    yield {"sheet": sheet.get("name"), "row": int(re.sub(r"\D", "", ref)) - 1, "col": _column(ref), "text": value}


def _paragraphs(root: ElementTree.Element) -> Iterator[str]:
    for p in root.iter(f"{W}p"):
        yield "".join(t.text or "" if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" for t in p.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))


def parse_docx(data: bytes) -> Iterator[dict]:
    """Paragraphs of the body, then of its tables row by row, then of headers and footers; empty ones are kept."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        for child in body:
            if child.tag == f"{W}p":
                yield from ({"text": t} for t in _paragraphs(_wrap(child)))
        for child in body:
            if child.tag == f"{W}tbl":
                yield from ({"text": t} for t in _paragraphs(child))
        for kind in ("header", "footer"):
            for name in sorted(n for n in z.namelist() if re.fullmatch(rf"word/{kind}\d*\.xml", n)):
                yield from ({"text": t} for t in _paragraphs(ElementTree.fromstring(z.read(name))))


def _wrap(e: ElementTree.Element) -> ElementTree.Element:
    out = ElementTree.Element("x")
    out.append(e)
    return out


def dxf_pairs(data: bytes) -> Iterator[tuple[int, str]]:
    lines = data.decode("utf-8", "replace").splitlines()
    for i in range(0, len(lines) - 1, 2):
        code = lines[i].strip()
        if code.lstrip("-").isdigit():
            yield int(code), lines[i + 1]


TEXT_ENTITIES = {"TEXT", "MTEXT", "ATTRIB", "ATTDEF", "DIMENSION", "MULTILEADER", "MLEADER"}


def parse_dxf(data: bytes) -> Iterator[dict]:
    """Text entities of a drawing: those of its layouts in order, then those of its blocks; a dimension only with an override.

    Blocks whose name begins with * are the drawing program's own (layout spaces, dimension pictures) and left out.
    """
    rows = list(_dxf_texts(data))
    yield from (r for r in rows if not r["block_name"])
    yield from (r for r in rows if r["block_name"] and not r["block_name"].startswith("*"))


def _dxf_texts(data: bytes) -> Iterator[dict]:
    """Text entities of a drawing in the order of the file."""
    section = block = ""
    entity: dict | None = None

    def done(e: dict | None) -> Iterator[dict]:
        if e and e["entity_type"] in TEXT_ENTITIES:
            raw = "".join(e.pop("parts")) + e.pop("last")
            if e["entity_type"] == "DIMENSION" and raw.strip() in ("", "<>"):
                return
            text = re.sub(r"\s+", " ", MTEXT.sub(lambda m: " " if m[0][0] == "\\" else "", raw)).strip()
            if text:
                yield e | {"raw_text": raw, "text": text}

    for code, value in dxf_pairs(data):
        if code == 0:
            yield from done(entity)
            kind = value.strip()
            entity = {"entity_type": kind, "handle": "", "layer": "", "block_name": block, "layout_name": "" if block else "Model", "parts": [], "last": ""}
            if kind in ("ENDBLK", "ENDSEC"):
                block = "" if kind == "ENDBLK" else block
        elif entity is not None:
            if code == 5:
                entity["handle"] = value.strip()
            elif code == 8:
                entity["layer"] = value.strip()
            elif code == 3 and entity["entity_type"] == "MTEXT":
                entity["parts"].append(value)
            elif code in (1, 304) and not entity["last"]:
                entity["last"] = value
            elif code == 2 and entity["entity_type"] == "SECTION":
                section = value.strip()
            elif code == 2 and entity["entity_type"] == "BLOCK" and section == "BLOCKS":
                block = value.strip()
    yield from done(entity)


PARSERS: dict[str, Callable[[bytes], Iterator[dict]]] = {".xlsx": parse_xlsx, ".docx": parse_docx, ".dxf": parse_dxf}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            parser = PARSERS[path[path.rfind(".") :].lower()]
            try:
                rows = [{"path": path, "seq": i} | r for i, r in enumerate(parser(content))]
            except Exception as e:  # noqa: BLE001 - the error becomes a column of this file's row
                rows = [{"path": path, "seq": 0, "error": f"{type(e).__name__}: {e}"[:500]}]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of all spreadsheets, documents and drawings below a folder; other files are left out."""
    f = files(spark, folder)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return f.where(ext.isin(*PARSERS)).select("path", "content").mapInArrow(_parse, SCHEMA)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export: header, quoted fields over several lines, everything text, null as an empty text."""
    return _csv(spark, path).na.fill("")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary files in either letter case, missing columns as empty text; ord is the order of the files' names, then of their rows."""
    want = ["section", "cn", "ru", "standard_ref", "status", "note"]
    d = _csv(spark, path)
    have = {c.lower().lstrip("﻿"): c for c in d.columns}
    cols = [F.coalesce(F.col(f"`{have[c]}`") if c in have else F.lit(""), F.lit("")).alias(c) for c in want]
    d = d.select(*cols, F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_path").alias("_file"))
    ranks = d.select("_file").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_file")))  # one row for each file
    # a file is read by one task, in order; the low bits of _at count the rows of the task
    place = F.col("_rank").cast("bigint") * F.lit(1 << 33) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return d.join(F.broadcast(ranks), "_file").select(*want, place.alias("ord"))


def read_term_store(spark: SparkSession, path: str) -> DataFrame:
    """(section, cn, ru, ord) of a JSON file of sections with their terms in order; a missing or broken file is empty.

    Such a file is a hand-kept dictionary; it is parsed as a whole where the order of its keys is kept.
    """
    import json

    rows = []
    for r in spark.read.format("binaryFile").load(path).select("content").collect() if _exists(spark, path) else []:
        try:
            data = json.loads(bytes(r["content"]).decode("utf-8-sig"))
        except ValueError:
            data = {}
        if isinstance(data, dict):
            rows += [(s, k, v, i) for s, m in data.items() if isinstance(m, dict) for i, (k, v) in enumerate(m.items())]
    return spark.createDataFrame(rows, "section string, cn string, ru string, ord int")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))
