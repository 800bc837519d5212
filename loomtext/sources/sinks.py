"""Writing back: files with their texts replaced, versioned stores, and the archive of a batch.

Each file is rewritten in one Arrow call from its own bytes and its own replacements, so the work spreads over
files; a failing file keeps its bytes and reports its error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.writeback import run_texts
from loomtext.sources.office import S, W, R, _column, dxf_pairs

SCHEMA = "path string, bytes binary, n_replaced int, error string"


def _rezip(data: bytes, change: Callable[[str, bytes], bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for item in z.infolist():
            w.writestr(item.filename, change(item.filename, z.read(item.filename)))
    return out.getvalue()


def write_xlsx(data: bytes, texts: dict[tuple[str, int, int], str]) -> tuple[bytes, int]:
    """Cells (sheet, row, col) replaced by inline texts; sheet names are compared at 31 characters."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
            t = targets[s.get(f"{R}id")].lstrip("/")
            sheets[t if t.startswith("xl/") else f"xl/{t}"] = s.get("name")[:31]
    wanted = {(s[:31], r, c): v for (s, r, c), v in texts.items()}
    n = 0

    def change(name: str, raw: bytes) -> bytes:
        nonlocal n
        if name not in sheets:
            return raw
        root = ElementTree.fromstring(raw)
        for c in root.iter(f"{S}c"):
            ref = c.get("r", "")
            value = wanted.get((sheets[name], int(re.sub(r"\D", "", ref)) - 1, _column(ref)))
            if value is not None:
                for child in list(c):
                    c.remove(child)
                c.set("t", "inlineStr")
                ElementTree.SubElement(ElementTree.SubElement(c, f"{S}is"), f"{S}t").text = value
                n += 1
        return ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")

    return _rezip(data, change), n


def write_docx(data: bytes, texts: dict[int, str]) -> tuple[bytes, int]:
    """Paragraphs replaced by position, each new text spread over the runs of the old one."""
    n = at = 0

    def paragraphs(name: str, root: ElementTree.Element) -> list[ElementTree.Element]:
        if name != "word/document.xml":
            return list(root.iter(f"{W}p"))
        body = root.find(f"{W}body")
        return [c for c in body if c.tag == f"{W}p"] + [p for c in body if c.tag == f"{W}tbl" for p in c.iter(f"{W}p")]

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = ["word/document.xml"] + [x for kind in ("header", "footer") for x in sorted(m for m in z.namelist() if re.fullmatch(rf"word/{kind}\d*\.xml", m))]
        done = {}
        for name in parts:
            root = ElementTree.fromstring(z.read(name))
            for p in paragraphs(name, root):
                new = texts.get(at)
                at += 1
                spans = [t for t in p.iter(f"{W}t")]
                if new is None or not spans:
                    continue
                for t, v in zip(spans, run_texts(new, [t.text or "" for t in spans])):
                    t.text = v
                    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                n += 1
            done[name] = ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")
    return _rezip(data, lambda name, raw: done.get(name, raw)), n


def write_dxf(data: bytes, texts: dict[str, str]) -> tuple[bytes, int]:
    """Texts replaced by handle; the continuation lines of a long text go."""
    groups: list[list[tuple[int, str]]] = []
    for code, value in dxf_pairs(data):
        if code == 0 or not groups:
            groups.append([])
        groups[-1].append((code, value))
    n, out = 0, []
    for g in groups:
        new = texts.get(next((v.strip() for c, v in g if c == 5), ""))
        if new is not None:
            code = 304 if g[0][1].strip() in ("MULTILEADER", "MLEADER") else 1
            n += 1
            done, kept = False, []
            for c, v in g:
                if c == code:
                    if not done:
                        kept.append((c, new.replace("\n", "\\P")))
                    done = True
                elif not (c == 3 and g[0][1].strip() == "MTEXT"):
                    kept.append((c, v))
            g = kept
        out += [f"{c}\n{v}" for c, v in g]
    return ("\n".join(out) + "\n").encode("utf-8"), n


def rewrite_files(files: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, bytes, n_replaced, error) for files(path, content) and segments(path, seq, sheet, row, col, handle, output).

    The last segment of a cell, paragraph or handle wins. A file without segments keeps its bytes.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["path", "bytes", "n_replaced", "error"])
        path, data = left["path"].iloc[0], bytes(left["content"].iloc[0])
        right = right[right["output"].notna()].sort_values("seq", kind="stable")
        ext, n, error = path[path.rfind(".") :].lower(), 0, None
        try:
            if ext == ".xlsx":
                data, n = write_xlsx(data, {(r.sheet, int(r.row), int(r.col)): r.output for r in right.itertuples()})
            elif ext == ".docx":
                data, n = write_docx(data, {int(r.seq): r.output for r in right.itertuples()})
            elif ext == ".dxf":
                data, n = write_dxf(data, {r.handle: r.output for r in right.itertuples() if r.handle})
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"[:500]
        return pd.DataFrame({"path": [path], "bytes": [data], "n_replaced": [n], "error": [error]})

    seg = segments.select("path", "seq", "sheet", "row", "col", "handle", "output")
    return files.select("path", "content").groupBy("path").cogroup(seg.groupBy("path")).applyInPandas(run, SCHEMA)


def save_version(df: DataFrame, folder: str) -> str:
    """df as the next version of a store: a new folder, then the pointer; a version being read is never overwritten."""
    spark = df.sparkSession
    last = current_version(spark, folder)
    n = 0 if last is None else int(last.rsplit("v", 1)[1]) + 1
    path = f"{folder}/v{n}"
    df.write.mode("errorifexists").parquet(path)
    spark.createDataFrame([(n,)], "v int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/current")
    return path


def current_version(spark: SparkSession, folder: str) -> str | None:
    from loomtext.sources.office import _exists

    if not _exists(spark, f"{folder}/current"):
        return None
    return f"{folder}/v{spark.read.parquet(f'{folder}/current').first()['v']}"


def batch_archive(outputs: list[tuple[str, bytes]], summary: pd.DataFrame) -> bytes:
    """One archive of a batch's files and its summary, for a batch small enough to be downloaded."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in outputs:
            z.writestr(name, data)
        z.writestr("summary.csv", summary.to_csv(index=False).encode("utf-8-sig"))
    return out.getvalue()


def store_files(rewritten: DataFrame, folder: str) -> None:
    """The rewritten bytes as a table partitioned by nothing: one row per file, ready for an export job."""
    rewritten.select("path", "bytes", F.coalesce("error", F.lit("")).alias("error")).write.mode("overwrite").parquet(folder)
