"""Round trips through spreadsheets, documents and drawings made here, stores and the drop folder."""

import io
import zipfile

from pyspark.sql import functions as F

from loomtext.functions import glossary as G
from loomtext.sources import office, sinks
from loomtext.streaming.dropfolder import watch

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
WNS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def xlsx():
    return zipped({
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="Лист" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {NS}><si><t>水泵</t></si><si><r><t>通</t></r><r><t>风</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>12.5</v></c><c r="C3" t="inlineStr"><is><t> nan </t></is></c></row></sheetData></worksheet>',
    })


def docx():
    p = lambda *t: "<w:p>" + "".join(f"<w:r><w:t>{x}</w:t></w:r>" for x in t) + "</w:p>"
    return zipped({
        "word/document.xml": f"<w:document {WNS}><w:body>{p('设备', '布置')}<w:tbl><w:tr><w:tc>{p('阀')}</w:tc></w:tr></w:tbl>{p()}{p('конец')}</w:body></w:document>",
        "word/header1.xml": f"<w:hdr {WNS}>{p('верх')}</w:hdr>",
    })


DXF = "\n".join(["0", "SECTION", "2", "ENTITIES", "0", "MTEXT", "5", "A1", "8", "L", "3", "{\\H2;水", "1", "泵}\\Px", "0", "DIMENSION", "5", "A2", "1", "<>", "0", "TEXT", "5", "A3", "8", "0", "1", "阀", "0", "ENDSEC", "0", "EOF", ""])


def test_parse_rewrite_and_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xlsx").write_bytes(xlsx())
    (tmp_path / "in/b.docx").write_bytes(docx())
    (tmp_path / "in/c.dxf").write_text(DXF)
    (tmp_path / "in/bad.docx").write_bytes(b"no zip")
    (tmp_path / "in/d.txt").write_text("x")
    seg = office.read_segments(spark, str(tmp_path / "in")).cache()
    rows = seg.collect()
    by = lambda n: [r for r in sorted(rows, key=lambda r: r["seq"]) if r["path"].endswith(n)]
    assert [(r["row"], r["col"], r["text"]) for r in by("a.xlsx")] == [(0, 0, "水泵"), (0, 27, "通风"), (2, 1, "12.5")]
    assert [r["text"] for r in by("b.docx")] == ["设备布置", "", "конец", "阀", "верх"]
    assert [(r["handle"], r["text"]) for r in by("c.dxf")] == [("A1", "水泵 x"), ("A3", "阀")]
    assert len(by("bad.docx")) == 1 and "BadZipFile" in by("bad.docx")[0]["error"] and not by("d.txt")
    out = seg.withColumn("output", F.when(F.col("text") != "", F.concat(F.lit("Я "), "text")))
    done = {r["path"].rsplit("/", 1)[1]: r for r in sinks.rewrite_files(office.files(spark, str(tmp_path / "in")), out).collect()}
    assert [c["text"] for c in office.parse_xlsx(bytes(done["a.xlsx"]["bytes"]))] == ["Я 水泵", "Я 通风", "Я 12.5"]
    assert [c["text"] for c in office.parse_docx(bytes(done["b.docx"]["bytes"]))] == ["Я 设备布置", "", "Я конец", "Я 阀", "Я верх"]
    assert [c["text"] for c in office.parse_dxf(bytes(done["c.dxf"]["bytes"]))] == ["Я 水泵 x", "Я 阀"]
    assert bytes(done["d.txt"]["bytes"]) == b"x" and done["bad.docx"]["error"]


def test_layouts_come_before_blocks():
    def text(handle, value):
        return f"0\nTEXT\n5\n{handle}\n1\n{value}\n"

    blocks = "".join(f"0\nBLOCK\n2\n{name}\n{text(h, v)}0\nENDBLK\n" for name, h, v in (("*D1", "1", "12.5 м"), ("ШТАМП", "2", "план"), ("*Model_Space", "3", "внутри")))
    data = f"0\nSECTION\n2\nBLOCKS\n{blocks}0\nENDSEC\n0\nSECTION\n2\nENTITIES\n{text('4', 'модель')}0\nENDSEC\n0\nEOF\n".encode()
    assert [(r["handle"], r["text"], r["block_name"]) for r in office.parse_dxf(data)] == [("4", "модель", ""), ("2", "план", "ШТАМП")]
    assert list(office.parse_dxf(b"")) == []


def test_tables_and_stores(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿SECTION,CN,RU,STATUS\nОВ,"通\n风","a ""b""",OK\n,风管,,\n', encoding="utf-8")
    g = office.read_glossary(spark, str(tmp_path / "t.csv")).orderBy("ord").collect()
    assert [(r["section"], r["cn"], r["ru"], r["note"]) for r in g] == [("ОВ", "通\n风", 'a "b"', ""), ("", "风管", "", "")]
    many = tmp_path / "many"
    many.mkdir()
    for name in ("b", "a", "c"):
        (many / f"{name}.csv").write_text("section,cn,ru\n" + "".join(f"ОВ,{name}{i},x\n" for i in range(3)), encoding="utf-8")
    got = office.read_glossary(spark, str(many))
    assert [r["cn"] for r in got.orderBy("ord").collect()] == [f"{n}{i}" for n in "abc" for i in range(3)]
    assert G.approved_terms(got.withColumn("status", F.lit("OK"))).count() == 9
    (tmp_path / "s.json").write_text('{"ОВ": {"b": "1", "a": "2"}, "x": 3}', encoding="utf-8")
    assert [(r["cn"], r["ord"]) for r in office.read_term_store(spark, str(tmp_path / "s.json")).orderBy("ord").collect()] == [("b", 0), ("a", 1)]
    (tmp_path / "bad.json").write_text("{")
    assert office.read_term_store(spark, str(tmp_path / "bad.json")).count() == 0 == office.read_term_store(spark, str(tmp_path / "none.json")).count()
    store = str(tmp_path / "store")
    assert sinks.current_version(spark, store) is None
    sinks.save_version(spark.range(3), store)
    sinks.save_version(spark.read.parquet(sinks.current_version(spark, store)).union(spark.range(2)), store)
    assert spark.read.parquet(sinks.current_version(spark, store)).count() == 5


def test_drop_folder(spark, tmp_path):
    g = spark.createDataFrame([("ALL", "通风", "вентиляция", "OK", 0)], "section string, cn string, ru string, status string, ord int")
    book = G.term_book(spark, g)
    memory = spark.createDataFrame([], "section string, source_text string, translated string")
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, "通风"), (1, 1, "DN5")], "doc_id bigint, seq bigint, text string").write.parquet(src)
    watch(spark, src, str(tmp_path / "out"), str(tmp_path / "cp"), book, memory).awaitTermination()
    spark.createDataFrame([(2, 0, "通风")], "doc_id bigint, seq bigint, text string").write.mode("append").parquet(src)
    watch(spark, src, str(tmp_path / "out"), str(tmp_path / "cp"), book, memory).awaitTermination()
    assert {(r["doc_id"], r["seq"]): r["translated"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 0): "вентиляция", (1, 1): "DN5", (2, 0): "вентиляция"}
