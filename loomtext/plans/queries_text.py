"""Queries on single texts, boxes and files, with SQL written for another engine and its regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.glossary import FILE_NAME_TERMS
from loomtext.operators import geometry as G
from loomtext.operators import writeback as W
from loomtext.plans.runtime import table

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def squash(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'), ' ')"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def clean(x: str) -> str:
    return f"substr({squash(x)}, 1, 1400)"


def tally(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def marks(x: str, signs: str) -> str:
    return f"(length({x}) - length(translate({x}, '{signs}', '')))"


def clean_source_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_source(F.col("text")).alias("clean_text"))


def text_fingerprint_dups(spark: SparkSession, d: str) -> DataFrame:
    rec = table(spark, d, "dxf_records").select(T.text_hash(F.col("text")).alias("text_hash"), "rec_id")
    return rec.groupBy("text_hash").agg(F.min("rec_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def section_detect(spark: SparkSession, d: str) -> DataFrame:
    s = T.detect_section(F.col("text"))
    return table(spark, d, "dxf_records").select("rec_id", s.alias("section"), F.when(s == "ПБ", "UNKNOWN").otherwise(s).alias("term_section"))


SECTION_SQL = """CASE WHEN regexp_matches({x}, '工艺|流程|原料|熔铸|挤压|时效|表面处理|包装|能耗|能源') THEN 'ТХ' WHEN contains({x}, '电气') THEN 'ЭОМ'
 WHEN contains({x}, '消防') THEN 'ПБ' WHEN contains({x}, '给排水') THEN 'ВК' WHEN contains({x}, '暖通') OR contains({x}, '通风') THEN 'ОВ'
 WHEN contains({x}, '结构') THEN 'КЖ' WHEN contains({x}, '建筑') THEN 'АР' ELSE 'UNKNOWN' END"""


def passthrough_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dxf_records").select("rec_id", T.is_passthrough(F.col("text")).alias("passthrough"))


PASS_SQL = r"""CASE WHEN v = '' THEN true WHEN regexp_matches(v, '[一-鿿]') THEN false WHEN NOT regexp_matches(v, '[一-鿿A-Za-zА-Яа-яЁё]') THEN true
 WHEN regexp_full_match(c, '[\p{Nd}.,\-+−–—_=:/\\|#№()\[\]{}<>*xX×Øø°''"′″%‰mMмМcCсСkKкКgGгГtTтТnNнНpPпПaAаАvVвВwWвВhHчЧ]+') THEN true
 WHEN regexp_full_match(c, '[A-Za-zА-Яа-я]{0,4}[-_/]?\p{Nd}+[A-Za-zА-Яа-я\p{Nd}\-_/]*') THEN true WHEN regexp_matches(v, '[А-Яа-яЁё]') THEN true
 ELSE length(v) <= 12 AND len(regexp_extract_all(v, '[А-Яа-яЁёA-Za-z]{2,}')) <= 1 END"""


def punctuation_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translated_sample").select("row_id", T.normalise_punctuation(F.col("text")).alias("normal_text"))


def _punctuation_sql(x: str) -> str:
    v = f"translate(coalesce({x}, ''), '（）：，；。＋、_', '():,;.+, ')"
    for find, to in [
        (f"{WS}+", " "), (r"\( +", "("), (r" +\)", ")"), (" *([:;,]) *", r"\1 "), (r" *\. *", ". "), (r" *\+ *", " + "),
        (r"(\p{Nd})([А-Яа-яЁёA-Za-z])", r"\1 \2"), (r"(\p{Nd})(\()", r"\1 \2"), (r"([А-Яа-яЁё])(\p{Nd})", r"\1 \2"), (" +", " "), (r" +([,.;:)])", r"\1"), ("^[ _-]+|[ _-]+$", ""),
    ]:
        v = f"regexp_replace({v}, '{find}', '{to}', 'g')"
    return strip(v)


def drawing_text_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dxf_records").select("rec_id", T.clean_mtext(F.col("raw_text")).alias("clean_text"))


def drawing_records(spark: SparkSession, d: str) -> DataFrame:
    return W.drawing_records(table(spark, d, "dxf_records").select("file_id", "handle", "entity_type", "text", "seq", "rec_id")).select("file_id", "handle", "entity_type", "text", "rec_id")


def _mtext_sql(x: str) -> str:
    v = f"replace(regexp_replace(coalesce({x}, ''), '\\{{\\\\.*?;', '', 'g'), '}}', '')"
    for find in (r"\\P", r"\\~", r"\\[A-Za-z0-9]+;?"):
        v = f"regexp_replace({v}, '{find}', ' ', 'g')"
    return squash(v)


def untranslated_drawing_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dxf_records").groupBy("file_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(T.has_cn(F.col("text"))).alias("n_chinese"))


def missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    lacking = T.missing_numbers(F.col("text"), F.col("translated"))
    return table(spark, d, "translated_sample").select("row_id", F.array_join(lacking, ",").alias("missing")).where("missing <> ''")


def text_measures(spark: SparkSession, d: str) -> DataFrame:
    v = F.coalesce("translated", F.lit(""))
    return table(spark, d, "translated_sample").select(
        "row_id", T.tokens(v).alias("n_words"), T.cn_runs(F.coalesce("text", F.lit(""))).alias("n_runs"),
        F.round(T.word_share(v), 6).alias("word_share"), T.complexity(T.clean_source(F.col("text"))).alias("complexity"))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translated_sample").withColumn("origin", F.coalesce("translation_source", F.lit("")))
    return W.top_counts(t, "origin")


def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return W.top_counts(table(spark, d, "dxf_records"), "entity_type")


def two_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "approved_terms").select("term_id", T.split_two_lines(F.concat_ws(", ", "ru", "note")).alias("two_lines"))


def despaced_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translated_sample").select("row_id", T.fix_spaced(F.col("text")).alias("text"))


def clipped_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_blocks").select("block_id", T.clip(F.col("text")).alias("clipped"))


def output_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", T.ru_name(F.col("file_name")).alias("output_name"))


def project_plan(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select(F.concat(F.lit("in/"), "project_code", F.lit("/"), "file_name").alias("path"))
    return W.project_plan(f)


def rename_plan(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translated_sample").select(F.concat(F.lit("p/"), "section", F.lit("/"), F.translate("text", "/", " "), F.lit(".dwg")).alias("path"))
    return W.rename_plan(t.distinct())


def pdf_page_modes(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "pdf_blocks").select(F.col("file_id").alias("doc_id"), "page", "text")
    return G.page_modes(b)


def pdf_document_modes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "source_files").where("ext = 'pdf'").select(F.col("file_id").alias("doc_id"))
    b = table(spark, d, "pdf_blocks").select(F.col("file_id").alias("doc_id"), "page", "text")
    return G.document_modes(docs, G.page_modes(b))


def pdf_block_report(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_blocks").select("block_id", T.has_cn(F.col("text")).alias("has_chinese"), T.ocr_noise(F.col("text")).alias("ocr_noise"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_blocks").select(F.col("file_id").alias("doc_id"), "page", F.col("block_id").alias("id"), *[F.col(f"bbox.{c}").alias(c) for c in G.BOX], "text", "pdf_source", "font_size")


def box_projection(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumns({"x_min": F.lit(-100.0), "x_max": F.lit(1090.0), "y_a": F.lit(1700.0), "y_b": F.lit(16.0), "image_w": F.lit(595.0), "image_h": F.lit(842.0)})
    return G.project_boxes(b).select("id", *[F.round(c, 4).alias(c) for c in ("insert_x", "insert_y", "width", "height", "char_height")])


def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of every block with the one before it on its page."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "id")
    b = _boxes(spark, d).where("x0 is not null").withColumns({f"p_{c}": F.lag(c).over(w) for c in G.BOX})
    iou = G.box_iou([F.col(c) for c in G.BOX], [F.col(f"p_{c}") for c in G.BOX])
    return b.where("p_x0 is not null").select("id", F.round(iou, 6).alias("iou"), F.round(G.box_distance([F.col(c) for c in G.BOX], [F.col(f"p_{c}") for c in G.BOX]), 4).alias("distance"))


def image_zones(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").where("ext = 'pdf'").select(F.col("file_id").alias("image_id"), (F.lit(1785) + F.col("file_id") % 7).cast("int").alias("w"), F.lit(2526).alias("h"))
    return G.zone_plan(f)


def near_duplicate_blocks(spark: SparkSession, d: str) -> DataFrame:
    return G.drop_near_duplicates(_boxes(spark, d))


def merged_block_sets(spark: SparkSession, d: str) -> DataFrame:
    extra = F.coalesce(F.col("pdf_source").startswith("ocr_raster"), F.lit(False))
    return G.merge_block_sets(_boxes(spark, d).withColumn("extra", extra))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return G.lines_from_words(_boxes(spark, d))


def merged_lines(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_lines(_boxes(spark, d).withColumn("score", F.col("font_size") / 20))


def deduped_lines(spark: SparkSession, d: str) -> DataFrame:
    return G.dedupe_lines(_boxes(spark, d).withColumn("score", F.col("font_size") / 20))


def recognised_lines(spark: SparkSession, d: str) -> DataFrame:
    """Words grouped to lines; every block of a page stands for a word of one of two attempts."""
    b = _boxes(spark, d).where("x0 is not null")
    w = b.select(
        F.col("doc_id").alias("image_id"), (F.col("id") % 2).cast("int").alias("attempt"), F.col("page").alias("block_num"), F.lit(1).alias("par_num"),
        F.floor(F.col("y0") / 20).cast("int").alias("line_num"), F.col("id").alias("word_num"), F.col("x0").alias("left"), F.col("y0").alias("top"),
        (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), (F.col("font_size") * 6).alias("conf"), "text")
    return G.tsv_lines(w).select("image_id", "block_num", "line_num", "text", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"), F.round("score", 6).alias("score"))


def text_fit(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).where("x0 is not null and text is not null")
    return b.select("id", G.fit_size(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("text"), 0.5, F.col("font_size")).alias("font_size"))


QUERIES = {f.__name__: f for f in (
    clean_source_text, text_fingerprint_dups, section_detect, passthrough_route, punctuation_normalise, drawing_text_clean, drawing_records,
    untranslated_drawing_texts, missing_numbers, text_measures, value_counts, entity_counts, two_lines, despaced_text, clipped_text, output_names,
    project_plan, rename_plan, pdf_page_modes, pdf_document_modes, pdf_block_report, box_projection, box_overlaps, image_zones,
    near_duplicate_blocks, merged_block_sets, page_lines, merged_lines, deduped_lines, recognised_lines, text_fit,
)}

_MODES = """SELECT file_id AS doc_id, page, count(*) AS text_blocks, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM pdf_blocks GROUP BY 1, 2"""
_MODE = "CASE WHEN chars >= 200 THEN 'text' WHEN chars >= 30 THEN 'hybrid' ELSE 'scanned' END"

_NOISE = r"(CASE WHEN v = '' THEN true WHEN regexp_matches(v, '[一-鿿]') THEN false ELSE length(v) <= 1 OR " + marks("v", "?") + r" >= 3 OR regexp_full_match(v, '[A-Za-z0-9\s,.;:()/%×\-–—_?]{1,18}') END)"
_PLACED = f"""SELECT file_id AS doc_id, page, block_id AS id, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1, text, font_size / 20 AS score,
    coalesce(starts_with(pdf_source, 'ocr_raster'), false) AS extra, v, lower(v) AS t, {strip("coalesce(text, '')")} AS s, {_NOISE} AS noise
    FROM (SELECT *, {squash('text')} AS v FROM pdf_blocks)"""
_BOXED = "x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL"
_NEAR = "greatest(abs(k.x0 - o.x0), abs(k.y0 - o.y0), abs(k.x1 - o.x1), abs(k.y1 - o.y1)) <= "


def _page_walk(keep: str, order: str, first: str, step: str) -> str:
    """SQL that walks over the rows of each page in order with a list; f is the list at the end of each page."""
    return f"""WITH RECURSIVE b AS ({_PLACED}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY {order}) AS n FROM b WHERE {_BOXED} AND {keep}),
        r AS (SELECT doc_id, page, n, [{first}] AS acc FROM o WHERE n = 1 UNION ALL SELECT o.doc_id, o.page, o.n, {step} FROM r JOIN o ON o.doc_id = r.doc_id AND o.page = r.page AND o.n = r.n + 1),
        f AS (SELECT doc_id, page, arg_max(acc, n) AS acc FROM r GROUP BY ALL)"""


_P = "{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 't': t, 'id': id}"
_PO = "{'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 't': o.t, 'id': o.id}"
_INSIDE = "(k.t <> '' AND o.t <> '' AND (contains(k.t, o.t) OR contains(o.t, k.t)))"
_IOU = """(list_transform([greatest(least(k.x1, o.x1) - greatest(k.x0, o.x0), 0) * greatest(least(k.y1, o.y1) - greatest(k.y0, o.y0), 0)], lambda i:
    CASE WHEN i > 0 THEN i / greatest(greatest((k.x1 - k.x0) * (k.y1 - k.y0), 1) + greatest((o.x1 - o.x0) * (o.y1 - o.y0), 1) - i, 1) ELSE 0 END))[1]"""
_SPOT = f"list_position(list_transform(r.acc, lambda k: {_NEAR}8 AND (k.t = o.t OR {_INSIDE})), true)"
_ROW = "list_position(list_transform(r.acc, lambda k: abs(o.y0 - k.y0) <= greatest(k.y1 - k.y0, 1) * 0.65), true)"
_W = "{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'w': [{'x': x0, 'n': 0, 's': s}]}"
_WO = "{'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'w': [{'x': o.x0, 'n': 0, 's': o.s}]}"
_L = "{'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'text': coalesce(text, ''), 'score': score}"
_LO = "{'id': o.id, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'text': coalesce(o.text, ''), 'score': o.score}"
_SAME_ROW = "(abs(o.y0 - r.acc[-1].y0) <= greatest(r.acc[-1].y1 - r.acc[-1].y0, 1) * 0.55 AND o.x0 - r.acc[-1].x1 <= greatest(r.acc[-1].y1 - r.acc[-1].y0, 1) * 2.5)"

PAGE_ORACLE = {
    "near_duplicate_blocks": _page_walk("t <> ''", "y0, x0, -length(text), id", _P, f"CASE WHEN len(list_filter(r.acc, lambda k: {_NEAR}5 AND {_INSIDE})) > 0 THEN r.acc ELSE list_append(r.acc, {_PO}) END")
        + f" SELECT doc_id, page, unnest(acc).id AS id FROM f UNION ALL SELECT doc_id, page, id FROM b WHERE NOT ({_BOXED}) AND t <> ''",
    "deduped_lines": _page_walk("s <> ''", "-score, length(text), id", _P.replace("'t': t", "'t': s"),
        f"CASE WHEN len(list_filter(r.acc, lambda k: {_INSIDE.replace('o.t', 'o.s')} AND {_IOU} >= 0.35)) > 0 THEN r.acc ELSE list_append(r.acc, {_PO.replace('o.t', 'o.s')}) END")
        + f" SELECT doc_id, page, unnest(acc).id AS id FROM f UNION ALL SELECT doc_id, page, id FROM b WHERE NOT ({_BOXED}) AND s <> ''",
    "merged_block_sets": _page_walk("(NOT extra OR NOT noise AND t <> '')", "extra, id", _P,
        f"CASE WHEN o.extra AND {_SPOT} > 0 THEN list_transform(r.acc, lambda k, i: CASE WHEN i = {_SPOT} AND length(k.t) < length(o.t) THEN {_PO} ELSE k END) ELSE list_append(r.acc, {_PO}) END")
        + f" SELECT doc_id, page, unnest(acc).id AS id FROM f UNION ALL SELECT doc_id, page, id FROM b WHERE NOT ({_BOXED}) AND (NOT extra OR NOT noise AND t <> '')",
    "page_lines": _page_walk("NOT noise", "y0, x0, s", _W, f"""CASE WHEN {_ROW} > 0 THEN list_transform(r.acc, lambda k, i: CASE WHEN i = {_ROW} THEN
        {{'x0': least(k.x0, o.x0), 'y0': least(k.y0, o.y0), 'x1': greatest(k.x1, o.x1), 'y1': greatest(k.y1, o.y1), 'w': list_append(k.w, {{'x': o.x0, 'n': len(k.w)::INT, 's': o.s}})}} ELSE k END) ELSE list_append(r.acc, {_WO}) END""")
        + f""", g AS (SELECT doc_id, page, unnest(acc) AS l FROM f), h AS (SELECT doc_id, page, l.x0 AS x0, l.y0 AS y0, l.x1 AS x1, l.y1 AS y1, {strip("array_to_string(list_transform(list_sort(l.w), lambda w: w.s), ' ')")} AS text FROM g
        UNION ALL SELECT doc_id, page, x0, y0, x1, y1, s FROM b WHERE NOT ({_BOXED}) AND NOT noise)
        SELECT doc_id, page, x0, y0, x1, y1, text, coalesce(greatest((y1 - y0) * 0.75, 6.0), 6.0) AS font_size FROM (SELECT *, {squash('text')} AS v FROM h) WHERE NOT {_NOISE}""",
    "merged_lines": _page_walk("true", "y0, x0, id", _L, f"""CASE WHEN {_SAME_ROW} THEN list_append(r.acc[:-2], {{'id': r.acc[-1].id, 'x0': least(r.acc[-1].x0, o.x0), 'y0': least(r.acc[-1].y0, o.y0), 'x1': greatest(r.acc[-1].x1, o.x1),
        'y1': greatest(r.acc[-1].y1, o.y1), 'text': {strip("r.acc[-1].text || ' ' || coalesce(o.text, '')")}, 'score': least(r.acc[-1].score, o.score)}}) ELSE list_append(r.acc, {_LO}) END""")
        + f" SELECT doc_id, page, l.id AS id, l.x0 AS x0, l.y0 AS y0, l.x1 AS x1, l.y1 AS y1, l.text AS text, l.score AS score FROM (SELECT doc_id, page, unnest(acc) AS l FROM f) UNION ALL SELECT doc_id, page, id, x0, y0, x1, y1, coalesce(text, ''), score FROM b WHERE NOT ({_BOXED})",
}

ORACLE = {
    "clean_source_text": f"SELECT doc_id, {clean('text')} AS clean_text FROM documents",
    "text_fingerprint_dups": f"SELECT sha1({clean('text')}) AS text_hash, min(rec_id) AS first_id, count(*) AS n_rows FROM dxf_records GROUP BY 1 HAVING count(*) > 1",
    "section_detect": f"SELECT rec_id, s AS section, CASE WHEN s = 'ПБ' THEN 'UNKNOWN' ELSE s END AS term_section FROM (SELECT rec_id, {SECTION_SQL.format(x='coalesce(text, chr(32))')} AS s FROM dxf_records)",
    "passthrough_route": f"SELECT rec_id, {PASS_SQL} AS passthrough FROM (SELECT rec_id, v, regexp_replace(v, '{WS}+', '', 'g') AS c FROM (SELECT rec_id, {clean('text')} AS v FROM dxf_records))",
    "punctuation_normalise": f"SELECT row_id, {_punctuation_sql('text')} AS normal_text FROM translated_sample",
    "drawing_text_clean": f"SELECT rec_id, {_mtext_sql('raw_text')} AS clean_text FROM dxf_records",
    "drawing_records": r"""
        WITH t AS (SELECT *, regexp_replace(v, '[\s\x{a0}\x{3000}]+', '', 'g') AS c FROM (SELECT file_id, handle, entity_type, text, seq, rec_id, """ + _mtext_sql("text") + r""" AS v FROM dxf_records)),
        k AS (SELECT * FROM t WHERE v <> '' AND (regexp_matches(v, '[一-鿿]') OR (regexp_matches(v, '[A-Za-zА-Яа-яЁё]')
          AND NOT regexp_full_match(c, '[\p{Nd}.,\-+−–—_=:/\\|#№()\[\]{}<>*xX×Øø°''"′″%‰mMмМcCсСkKкКgGгГtTтТnNнНpPпПaAаАvVвВwWвВhHчЧ]+') AND regexp_matches(v, '[A-Za-zА-Яа-яЁё]{2,}'))))
        SELECT file_id, handle, entity_type, text, arg_min(rec_id, seq) AS rec_id FROM k GROUP BY ALL""",
    "untranslated_drawing_texts": "SELECT file_id, count(*) AS n_records, count(*) FILTER (regexp_matches(text, '[一-鿿]')) AS n_chinese FROM dxf_records GROUP BY 1",
    "missing_numbers": r"""SELECT row_id, missing FROM (SELECT row_id, array_to_string(list_filter(regexp_extract_all(text, '\p{Nd}+(?:[.,]\p{Nd}+)?'),
        lambda x: NOT list_contains(regexp_extract_all(coalesce(translated, ''), '\p{Nd}+(?:[.,]\p{Nd}+)?'), x)), ',') AS missing FROM translated_sample) WHERE missing <> ''""",
    "text_measures": f"""SELECT row_id, {tally("coalesce(translated, '')", '[А-Яа-яЁёA-Za-z]+')}::INT AS n_words, {tally("coalesce(text, '')", '[一-鿿]+')}::INT AS n_runs,
        round(CASE WHEN length(s) > 0 THEN (length(s) - length(regexp_replace(s, '[А-Яа-яЁёA-Za-z]+', '', 'g'))) / length(s) ELSE 0.0 END, 6) AS word_share,
        (CASE WHEN length(c) >= 700 OR p >= 8 THEN 4 WHEN length(c) >= 420 OR p >= 5 THEN 3 WHEN length(c) >= 180 OR p >= 3 THEN 2 WHEN length(c) >= 80 THEN 1 ELSE 0 END)::INT AS complexity
        FROM (SELECT *, {marks('c', '，,。;；')} AS p FROM (SELECT row_id, text, translated, {strip('translated')} AS s, {clean('text')} AS c FROM translated_sample))""",
    "value_counts": "SELECT coalesce(translation_source, '') AS origin, count(*) AS n_rows FROM translated_sample GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "entity_counts": "SELECT entity_type, count(*) AS n_rows FROM dxf_records GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "despaced_text": "SELECT row_id, CASE WHEN len(p) > 8 AND len(list_filter(p, lambda x: length(x) <= 2)) > len(p) * 0.6 THEN array_to_string(p, '') ELSE text END AS text FROM (SELECT row_id, text, string_split(text, ' ') AS p FROM translated_sample)",
    "clipped_text": f"SELECT block_id, CASE WHEN length(s) <= 420 THEN s ELSE regexp_replace(substr(s, 1, 419), '{WS}+$', '') || '...' END AS clipped FROM (SELECT block_id, {strip('text')} AS s FROM pdf_blocks)",
    "output_names": r"SELECT file_id, regexp_replace(file_name, '^(.*)(\.[^.]*)$', '\1_RU\2') AS output_name FROM source_files",
    "project_plan": r"SELECT 'in/' || project_code || '/' || file_name AS path, 'in/' || project_code || '/' || regexp_replace(file_name, '^(.*)(\.[^.]*)$', '\1_RU\2') AS output, 'translate' AS action FROM source_files",
    "pdf_page_modes": f"SELECT doc_id, page, text_blocks, chars, 0::BIGINT AS images, {_MODE} AS mode FROM ({_MODES})",
    "pdf_document_modes": f"""WITH p AS (SELECT doc_id, count(*) AS n_pages, bool_and(mode = 'text') AS t, bool_and(mode = 'scanned') AS s FROM (SELECT doc_id, {_MODE} AS mode FROM ({_MODES})) GROUP BY 1)
        SELECT f.file_id AS doc_id, coalesce(n_pages, 0) AS n_pages, CASE WHEN coalesce(t, true) THEN 'text' WHEN s THEN 'scanned' ELSE 'hybrid' END AS mode FROM source_files f LEFT JOIN p ON p.doc_id = f.file_id WHERE ext = 'pdf'""",
    "pdf_block_report": r"SELECT block_id, regexp_matches(coalesce(text, ''), '[一-鿿]') AS has_chinese, CASE WHEN v = '' THEN true WHEN regexp_matches(v, '[一-鿿]') THEN false ELSE length(v) <= 1 OR " + marks("v", "?")
        + r" >= 3 OR regexp_full_match(v, '[A-Za-z0-9\s,.;:()/%×\-–—_?]{1,18}') END AS ocr_noise FROM (SELECT block_id, text, " + squash("text") + " AS v FROM pdf_blocks)",
    "box_projection": f"""SELECT block_id AS id, round(ix, 4) AS insert_x, round(iy, 4) AS insert_y, round(greatest(abs(-100 + x1 / 595 * 1190 - ix), 1.0), 4) AS width, round(h, 4) AS height, round(greatest(h * 0.7, 1.8), 4) AS char_height
        FROM (SELECT *, greatest(abs(iy - (1700 - y1 / 842 * 1684)), 1.0) AS h FROM (SELECT block_id, bbox.x1 AS x1, bbox.y1 AS y1, -100 + bbox.x0 / 595 * 1190 AS ix, 1700 - bbox.y0 / 842 * 1684 AS iy
        FROM pdf_blocks WHERE {strip('text')} <> '' AND bbox.x0 IS NOT NULL AND bbox.y0 IS NOT NULL AND bbox.x1 IS NOT NULL AND bbox.y1 IS NOT NULL))""",
    "box_overlaps": """WITH b AS (SELECT block_id AS id, file_id, page, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM pdf_blocks WHERE bbox.x0 IS NOT NULL),
        l AS (SELECT *, lag(x0) OVER w AS a0, lag(y0) OVER w AS b0, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1 FROM b WINDOW w AS (PARTITION BY file_id, page ORDER BY y0, x0, id)),
        i AS (SELECT *, greatest(least(x1, a1) - greatest(x0, a0), 0) * greatest(least(y1, b1) - greatest(y0, b0), 0) AS s FROM l WHERE a0 IS NOT NULL)
        SELECT id, round(CASE WHEN s > 0 THEN s / greatest(greatest((x1 - x0) * (y1 - y0), 1) + greatest((a1 - a0) * (b1 - b0), 1) - s, 1) ELSE 0.0 END, 6) AS iou,
        round(greatest(abs(x0 - a0), abs(y0 - b0), abs(x1 - a1), abs(y1 - b1)), 4) AS distance FROM i""",
    "image_zones": """WITH f AS (SELECT file_id AS image_id, (1785 + file_id % 7)::INT AS w, 2526 AS h FROM source_files WHERE ext = 'pdf'),
        g AS (SELECT * FROM f, (VALUES (2, 3), (3, 4)) t(c, r)), k AS (SELECT *, w // c AS tw, h // r AS th, unnest(range(c)) AS i FROM g), m AS (SELECT *, unnest(range(r)) AS j FROM k),
        n AS (SELECT *, floor(tw * 0.03)::INT AS dx, floor(th * 0.03)::INT AS dy FROM m)
        SELECT image_id, zone, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1 FROM (
        SELECT image_id, 'top' AS zone, 0 AS x0, 0 AS y0, w AS x1, h // 2 AS y1 FROM f UNION ALL SELECT image_id, 'bottom', 0, h // 2, w, h FROM f UNION ALL SELECT image_id, 'left', 0, 0, w // 2, h FROM f
        UNION ALL SELECT image_id, 'right', w // 2, 0, w, h FROM f UNION ALL SELECT image_id, 'top_left', 0, 0, w // 2, h // 2 FROM f UNION ALL SELECT image_id, 'top_right', w // 2, 0, w, h // 2 FROM f
        UNION ALL SELECT image_id, 'bottom_left', 0, h // 2, w // 2, h FROM f UNION ALL SELECT image_id, 'bottom_right', w // 2, h // 2, w, h FROM f
        UNION ALL SELECT image_id, 'tile_' || c || 'x' || r || '_' || j || '_' || i, greatest(tw * i - dx, 0), greatest(th * j - dy, 0), least(tw * (i + 1) + dx, w), least(th * (j + 1) + dy, h) FROM n)""",
    "recognised_lines": f"""WITH w AS (SELECT file_id AS image_id, (block_id % 2)::INT AS attempt, page AS block_num, floor(bbox.y0 / 20)::INT AS line_num, bbox.x0 AS a, bbox.x1 AS b, font_size * 6 AS conf, block_id AS word, {strip('text')} AS t FROM pdf_blocks
          WHERE bbox.x0 IS NOT NULL AND font_size * 6 >= 20 AND {strip('text')} <> ''),
        l AS (SELECT image_id, attempt, block_num, line_num, min(a) AS x0, max(b) AS x1, avg(conf) / 100 AS score, string_agg(t, ' ' ORDER BY word) AS text FROM w GROUP BY ALL),
        n AS (SELECT image_id, attempt, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT image_id, arg_max(attempt, n * 2 + 1 - attempt) AS attempt FROM n GROUP BY 1)
        SELECT image_id, block_num, line_num, text, round(x0, 3) AS x0, round(x1, 3) AS x1, round(score, 6) AS score FROM l JOIN p USING (image_id, attempt)""",
    "text_fit": r"""WITH b AS (SELECT block_id AS id, text, greatest(bbox.x1 - bbox.x0, 1) AS w, greatest(bbox.y1 - bbox.y0, 1) AS h, font_size, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM pdf_blocks WHERE bbox.x0 IS NOT NULL AND text IS NOT NULL)
        SELECT id, coalesce(list_max(list_filter(range(6, greatest(least(trunc(font_size)::INT, greatest(trunc(h)::INT, 6)), 6) + 1), lambda s: length(text) * 0.5 * s <= w * 1.03 AND s * 1.35 * n <= h * 1.1))::DOUBLE,
        greatest(least(h / n * 0.8, 8.0), 6.0)) AS font_size FROM b""",
}
ORACLE |= PAGE_ORACLE


def _replaced(x: str, terms: dict[str, str]) -> str:
    for k, v in terms.items():
        x = f"replace({x}, '{k}', '{v}')"
    return x


_FIRST = "string_split(string_split(string_split({x}, chr(10))[1], 'which')[1], 'Translate')[1]"
ORACLE["rename_plan"] = f"""WITH p AS (SELECT DISTINCT section, translate(text, '/', ' ') || '.dwg' AS name FROM translated_sample WHERE text IS NOT NULL AND section IS NOT NULL),
    n AS (SELECT *, {_replaced("name", FILE_NAME_TERMS)} AS t FROM p), k AS (SELECT section, name, {squash("regexp_replace(" + _FIRST.format(x="t") + ", '[" + chr(92) * 2 + "/:*?" + chr(34) + "<>|]', '', 'g')")} AS new_name FROM n)
    SELECT 'p/' || section || '/' || name AS path, new_name, 2 AS depth FROM k WHERE regexp_matches(name, '[一-鿿]') AND new_name <> name AND new_name <> ''"""


def _spots(rank: int, sep: str) -> str:
    kept = len(sep.rstrip())
    return f"list_transform(list_filter(range(1, length(v) + 1), lambda i: substr(v, i, {len(sep)}) = '{sep}'), lambda i: {{'far': abs(i - 1 + {kept} - length(v) // 2), 'rank': {rank}, 'at': i, 'cut': i - 1 + {kept}}})"


ORACLE["two_lines"] = f"""WITH x AS (SELECT term_id, {strip("concat_ws(', ', ru, note)")} AS v FROM approved_terms),
    y AS (SELECT *, coalesce(list_sort(flatten([{", ".join(_spots(k, sep) for k, sep in enumerate([", ", "; ", ": ", " - ", " ("]))}]))[1].cut, list_sort({_spots(0, " ")})[1].at - 1) AS cut FROM x)
    SELECT term_id, CASE WHEN cut > 0 AND cut < length(v) - 1 AND NOT contains(v, chr(10)) AND length(v) >= 42
      THEN regexp_replace(substr(v, 1, cut), '{WS}+$', '') || chr(10) || regexp_replace(substr(v, cut + 1), '^{WS}+', '') ELSE v END AS two_lines FROM y"""
