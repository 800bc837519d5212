"""Routing, finalising, memory, learning and reports on small inputs."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.functions import glossary as G
from loomtext.plans import learning as L
from loomtext.plans import quality as Q
from loomtext.plans import translate as R

GLOSSARY_ROWS = [
    ("ALL", "通风", "вентиляция", "OK", 0), ("ОВ", "通风", "вентиляция ОВ", "approved", 1), ("", "风管", "воздуховод", "ДА", 2), ("ALL", "阀", "клапан", "DRAFT", 3), ("ALL", None, "x", "OK", 4),
]
GLOSSARY = "section string, cn string, ru string, status string, ord int"


@pytest.fixture(scope="module")
def book(spark):
    return G.term_book(spark, spark.createDataFrame(GLOSSARY_ROWS, GLOSSARY))


def winners(spark, section, kind="terms", booster=None):
    """The terms of a section in the order in which they replace, from the plain layers."""
    t = G.term_table(spark, spark.createDataFrame(GLOSSARY_ROWS, GLOSSARY), booster).where((F.col("section") == section) & (F.col("kind") == kind)).collect()
    return {r["cn"]: r["ru"] for r in sorted(t, key=lambda r: (-len(r["cn"]), r["place"]))}


def test_precedence(spark):
    assert winners(spark, "ОВ")["通风"] == "вентиляция ОВ" and winners(spark, "ВК")["通风"] == "вентиляция"
    assert winners(spark, "ВК")["风管"] == "воздуховод" and "阀" not in winners(spark, "ВК")
    assert winners(spark, "ОВ", "residual_terms")["квадратная яма"] == "квадратный смотровой колодец"
    assert list(winners(spark, "ОВ", "norm_terms")) == ["通风", "风管"] and "ПБ" not in winners(spark, "ПБ")
    b = spark.createDataFrame([("UNKNOWN", "通风", "x", 0), ("ОВ", "新词", "y", 0), ("ALL", "风管", "z", 1), ("ЧУЖОЙ", "a", "b", 0)], "section string, cn string, ru string, ord int")
    more = winners(spark, "ОВ", booster=b)
    assert more["通风"] == "x" and more["新词"] == "y" and more["风管"] == "z" and "a" not in more
    assert "新词" not in winners(spark, "ВК", booster=b)


def test_attached_terms_are_those_that_can_come_up(spark):
    """Folding the attached terms equals folding all terms, also where translations hold ideographs."""
    rows = [("ALL", "循环水泵", "насос", "OK", 0), ("ALL", "水泵", "泵 насос", "OK", 1), ("ALL", "泵", "помпа", "OK", 2), ("ОВ", "A区", "зона", "OK", 3), ("ОВ", "风阀门", "клапан", "OK", 4), ("ALL", "xy", "水", "OK", 5)]
    for glossary in (rows, rows[:1] + rows[2:5]):
        g = spark.createDataFrame(glossary, GLOSSARY)
        book = G.term_book(spark, g)
        every = {}
        for r in G.term_table(spark, g).collect():
            every.setdefault((r["section"], r["kind"]), []).append((-len(r["cn"]), r["place"], r["cn"], r["ru"]))
        texts = ["循环水泵 5台", "水泵xy", "A区风阀门", "", "水", "xy泵", "насос", "квадратная яма 个", "循环水 泵", None, "水泵xy"]
        d = spark.createDataFrame([(i, s, t) for i, t in enumerate(texts) for s in ("ОВ", "UNKNOWN", "ЧУЖОЙ")], "i int, section string, source string")
        for kind in G.KINDS:
            for r in book.attach(d, "source").select("section", "source", book.fold(F.col("source"), kind).alias("out")).collect():
                want = r["source"]
                for _, _, k, v in sorted(every.get((r["section"] if r["section"] != "ЧУЖОЙ" else "UNKNOWN", kind), [])):
                    want = None if want is None else want.replace(k, v)
                assert r["out"] == want, (kind, r)


def test_a_large_glossary_keeps_rows_small(spark):
    """A hundred thousand terms: no row carries more than it holds, and no plan pairs all with all."""
    rnd = random.Random(1)
    words = ["".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(4)) for _ in range(100_000)]
    g = spark.createDataFrame(pd.DataFrame({"section": "ALL", "cn": words, "ru": [f"термин {i}" for i in range(len(words))], "status": "OK", "ord": range(len(words))}), GLOSSARY)
    some = g.orderBy("ord").limit(40).collect()
    d = spark.createDataFrame([(i, "ОВ", f"план {r['cn']} узел") for i, r in enumerate(some)], "row_id int, section string, text string")
    book = G.term_book(spark, g)
    out = book.attach(d, "text").select("row_id", F.size("terms").alias("n"), book.fold(F.col("text"), "terms").alias("t"))
    assert [(r["t"], r["n"] < 60) for r in out.orderBy("row_id").collect()] == [(f"план {r['ru']} узел", True) for r in some]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    terms = G.section_terms(G.layered_terms(spark, g).where("layer in (2, 3)"))
    rep = Q.validation_report(d.select("row_id", F.col("text"), F.lit("перевод").alias("translated")), terms)
    assert rep.where("issues like '%термин%'").count() == 40
    assert "CartesianProduct" not in rep._jdf.queryExecution().executedPlan().toString()


#: Source, candidate and the finalised text; each was read against the rules.
FINAL = [
    ("通风系统，风管：10个", "вентиляция", "вентиляция ОВ系统, воздуховод: 10 шт."),
    ("能源：电，天然气，水，压缩空气。", "", "Энергоносители: электроэнергия, природный газ, вода, сжатый воздух."),
    ("600x400方井", "600x400方井", "600 x400 квадратный смотровой колодец"),
    ("水泵", "насос", "насос"),
    ("3套（备用）", "3套", "3 комплект"),
    ("中国标准", "中国标准水", "китайский стандартвода"),
    ("a", None, "a"),
    ("", "text: 5件", "5 шт."),
    ("铝锭+废料投入熔铸炉", "铝锭+废料投入熔铸炉", "алюминиевый слиток + отходызагружаютсяплавильно-литейная печь"),
    ("квадратная яма", "квадратная яма", "квадратный смотровой колодец"),
]


def test_finalise(spark, book):
    rows = spark.createDataFrame([(i, "ОВ", a, b) for i, (a, b, _) in enumerate(FINAL)], "i int, section string, s string, c string")
    for r, (a, b, want) in zip(R.finalise(rows, "s", "c", "out", book).orderBy("i").collect(), FINAL):
        assert r["out"] == want, (a, b)
        assert r["out_untranslated"] == bool(re.search("[一-鿿]", r["out"]))
        assert ("needs_manual_review" in r["out_flags"]) == r["out_untranslated"]


def test_translate_invariants(spark, book):
    texts = ["DN300", "通风", "水泵 A", "水泵 A", "未知设备名称", "未知设备名称", "", None, "насос", "水泵 A"]
    seg = spark.createDataFrame([(1 + i % 2, i, t) for i, t in enumerate(texts)], "doc_id bigint, seq bigint, text string")
    memory = spark.createDataFrame([("UNKNOWN", "水泵 A", "Насос А")], "section string, source_text string, translated string")
    out = {r["seq"]: r for r in R.translate(seg, book, memory).collect()}
    assert len(out) == len(texts)
    assert out[0]["translation_source"] == "passthrough" and out[0]["translated"] == "DN300"
    assert out[2]["translation_source"] == "memory" == out[9]["translation_source"]
    assert {out[4]["translation_source"], out[5]["translation_source"]} == {"fallback", "fallback_duplicate"}
    assert out[4]["translated"] == out[5]["translated"]
    assert all(r["untranslated_chinese"] == bool(re.search("[一-鿿]", r["translated"])) for r in out.values())


def test_model_failures_mean_identity(spark, book):
    p = spark.createDataFrame([("UNKNOWN", "未知"), ("UNKNOWN", "某物")], "section string, source string")

    def broken(texts):
        raise RuntimeError("no service")

    assert {r["model_text"] for r in R.call_model(p, broken).collect()} == {"未知", "某物"}
    assert {r["model_text"] for r in R.call_model(p, lambda t: ["x"] * (len(t) + 1)).collect()} == {"未知", "某物"}
    assert {r["route"] for r in R.resolve_pending(p, book, lambda t: ["Неизвестное изделие"] * len(t)).collect()} == {"ollama"}


def test_memory(spark):
    schema = "section string, source_text string, translated string"
    m = spark.createDataFrame([("A", "水泵", "насос"), ("A", "阀", "кл"), ("A", "x", "水"), ("A", "甲，乙，丙", "один"), ("A", "y", None)], schema)
    assert [r["source_text"] for r in R.clean_memory(m).collect()] == ["水泵"]
    new = spark.createDataFrame([("A", "水泵", "помпа"), ("B", "阀门", " задвижка "), ("B", " ", "x")], schema)
    up = {(r["section"], r["source_text"]): r["translated"] for r in R.upsert_memory(m, new).collect()}
    assert up["A", "水泵"] == "помпа" and up["B", "阀门"] == "задвижка" and len(up) == 6


def test_empty_metrics(spark):
    df = spark.createDataFrame([], "translation_source string, untranslated_chinese boolean, qc_flags string")
    r = Q.translation_metrics(df).collect()
    assert len(r) == 1 and r[0]["rows"] == 0 and r[0]["qc_flags"] == ""


def test_norm(spark, book):
    rows = spark.createDataFrame([("UNKNOWN", "входные двери цеха"), ("UNKNOWN", "диаметр ф 20, 300x200, h 5 mm"), ("UNKNOWN", None)], "section string, t string")
    got = [r["n"] for r in R.domain_norm(rows, "t", "n", book).collect()]
    assert "Вход в цех" in got and "Диаметр Ø20, 300×200, h 5 мм" in got and "" in got


def test_learning_is_idempotent(spark):
    seg = spark.createDataFrame([(d, i, "ОВ", t, r, "memory") for d in (1, 2) for i, (t, r) in enumerate([("通风系统", "вентиляция"), ("通风系统", "вентиляция"), ("风", "воздух"), (None, None)])] + [(2, 9, "ОВ", "阀门组", "задвижка чугунная", "ollama")],
                                "doc_id bigint, seq bigint, section string, text string, translated string, translation_source string")
    approved = spark.createDataFrame([("ОВ", "风管", "воздуховод", "", "APPROVED", "", 0)], "section string, cn string, ru string, standard_ref string, status string, note string, ord int")
    keys = L.document_keys(seg)
    triples = L.document_triples(seg, keys, approved)
    from loomtext.plans.queries_flow import NO_CANDIDATES

    one = L.upsert_candidates(spark.createDataFrame([], NO_CANDIDATES), triples).cache()
    rows = {r["cn"]: r for r in one.collect()}
    assert rows["通风系统"]["n_docs"] == 2 and rows["通风系统"]["status"] == "RECOMMENDED" and rows["阀门组"]["status"] == "NEW" and "风" not in rows
    two = L.upsert_candidates(one, triples)
    assert sorted(map(str, two.collect())) == sorted(map(str, one.collect()))
    grown, marked = L.promote(approved, one)
    assert grown.count() == 2 and L.promote(grown, marked)[0].count() == 2
    assert {r["cn"]: r["status"] for r in marked.collect()}["通风系统"] == "APPROVED"


def test_review_without_model(spark, book):
    rows = spark.createDataFrame([(1, "ОВ", "通风 5", "вентиляция 5", False, ""), (2, "ОВ", "通风 5", "вентиляция", False, ""), (3, "ОВ", None, None, None, None)],
                                              "row_id bigint, section string, text string, translated string, untranslated_chinese boolean, qc_flags string")
    got = {r["row_id"]: (r["llm_validation_status"], r["llm_validation_notes"]) for r in Q.review(rows, book).collect()}
    assert got == {1: ("SKIP", ""), 2: ("CHECKED", "request_failed"), 3: ("CHECKED", "request_failed")}
    fixed = {r["row_id"]: r["llm_validation_status"] for r in Q.review(rows, book, lambda t: ["вентиляция 5 шт"] * len(t)).collect()}
    assert fixed[2] == "EDITED"


def test_batch_report_isolates_errors(spark):
    files = spark.createDataFrame([(1, "a.xlsx", None), (2, "b.docx", "bad zip"), (3, "c.pdf", None)], "doc_id bigint, file_name string, error string")
    tr = spark.createDataFrame([(1, "memory", False, ""), (1, "fallback", True, "x")], "doc_id bigint, translation_source string, untranslated_chinese boolean, qc_flags string")
    rep = spark.createDataFrame([(1, i, "WARN", f"i{i}") for i in range(7)], "doc_id bigint, seq bigint, status string, issues string")
    got = {r["doc_id"]: r for r in Q.batch_report(files, tr, rep).collect()}
    assert got[1]["status"] == "WARN" and got[1]["issues"] == "i0; i1; i2; i3; i4" and got[1]["rows"] == 2
    assert got[2]["status"] == "ERROR" and got[2]["issues"] == "bad zip" and got[3]["status"] == "OK"


def test_routing_uses_the_whole_memory(spark, tmp_path):
    """Entries of the memory hit whatever the length of their text, and the other routes occur beside them."""
    from loomtext.plans import queries_flow as flow

    known = [("水泵", "насос водяной"), ("循环泵", "насос циркуляционный"), ("循环水泵", "насос циркуляционной воды"), ("离心循环泵", "насос центробежный"), ("暖通风管设计说明", "пояснения к воздуховодам")]
    other = [("DN300", None), ("通风", None), ("阀门5号井", None), ("未知设备名称", None), ("未知设备名称", None)]
    rows = [(i, "ОВ", a, b) for i, (a, b) in enumerate(known + other)]
    spark.createDataFrame(rows, "row_id bigint, section string, text string, translated string").write.parquet(f"{tmp_path}/translated_sample.parquet")
    terms = [("ALL", "通风", "вентиляция", "OK", 0, "", ""), ("ALL", "阀门5号井", "колодец задвижки", "OK", 1, "", "")]
    spark.createDataFrame(terms, GLOSSARY + ", standard_ref string, note string").write.parquet(f"{tmp_path}/approved_terms.parquet")
    got = {r["source"]: r["route"] for r in flow.fast_route(spark, str(tmp_path)).collect()}
    assert got == {a: "memory" for a, _ in known} | {"DN300": "passthrough", "通风": "structured_dict", "阀门5号井": "structured_dict", "未知设备名称": None}
    n = {}
    for r in flow.routing_summary(spark, str(tmp_path)).collect():
        n[r["route"]] = n.get(r["route"], 0) + r["n_rows"]
    assert n == {"memory": 5, "passthrough": 1, "structured_dict": 2, "pending": 2}
