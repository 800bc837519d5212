"""Queries on glossaries, routing, memory, reports and learning, with SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import glossary as G
from loomtext.functions import text as T
from loomtext.functions.model_output import parsed_batch
from loomtext.plans import learning as L
from loomtext.plans import quality as Q
from loomtext.plans import translate as R
from loomtext.plans.queries_text import SECTION_SQL, WS, marks, squash, strip
from loomtext.plans.runtime import table


def _glossary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "approved_terms").select("section", "cn", "ru", "status", "ord", "standard_ref", "note")


def _book(spark: SparkSession, d: str) -> R.Book:
    return G.term_book(spark, _glossary(spark, d))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Translated segments of all exports: each export is a document."""
    return table(spark, d, "translated_sample").select(
        F.col("export_id").alias("doc_id"), F.col("row_no").alias("seq"), "row_id", "section", "text", "translated",
        F.coalesce("translation_source", F.lit("")).alias("translation_source"), T.has_cn(F.col("translated")).alias("untranslated_chinese"),
        F.when(T.cn_runs(F.coalesce("translated", F.lit(""))) >= 2, "multiple_chinese_fragments,needs_manual_review").when(T.has_cn(F.col("translated")), "needs_manual_review").otherwise("").alias("qc_flags"),
    )


def _memory(spark: SparkSession, d: str) -> DataFrame:
    """A memory made of the finished Russian translations: the one of the smallest row by section and cleaned text."""
    t = table(spark, d, "translated_sample").where("translated is not null").select("section", T.clean_source(F.col("text")).alias("source_text"), T.strip(F.col("translated")).alias("translated"), "row_id")
    return t.groupBy("section", "source_text").agg(F.min_by("translated", "row_id").alias("translated"))


def term_precedence_map(spark: SparkSession, d: str) -> DataFrame:
    return G.section_terms(G.layered_terms(spark, _glossary(spark, d))).select("section", "cn", "ru")


def glossary_by_section(spark: SparkSession, d: str) -> DataFrame:
    a = G.approved_terms(_glossary(spark, d))
    return a.groupBy("section", "cn").agg(F.max_by("ru", "ord").alias("ru")).groupBy("section").agg(F.count(F.lit(1)).alias("n_terms"), F.sum(F.length("ru")).alias("chars"))


def apply_section_terms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translated_sample").select("row_id", "section", T.clean_source(F.col("text")).alias("source"))
    book = _book(spark, d)
    return book.attach(t, "source").select("row_id", book.fold(book.fold(F.col("source"), "terms"), "norm_terms").alias("by_terms"))


def structured_translate(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translated_sample").select("row_id", "section", T.clean_source(F.col("text")).alias("source"))
    book = _book(spark, d)
    return book.attach(t, "source").select("row_id", book.fold_runs(F.col("source"), "terms").alias("by_runs"))


def cad_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dxf_records").select("rec_id", G.fold_fixed(F.coalesce("text", F.lit("")), G.CAD_TERMS, longest_first=False).alias("by_terms"))


def document_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translated_sample").select("row_id", G.fold_fixed(F.col("text"), G.DOCUMENT_TERMS, longest_first=False).alias("by_terms"))


def finalised(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translated_sample").select("row_id", "section", "text", "translated")
    f = R.finalise(t, "text", "translated", "final", _book(spark, d))
    return f.select("row_id", "final", F.col("final_untranslated").alias("untranslated"), F.array_join("final_flags", ",").alias("flags"))


def domain_normalise(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translated_sample").select("row_id", "section", "translated")
    return R.domain_norm(t, "translated", "normalized", _book(spark, d)).select("row_id", "normalized")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    def routed_section(source: Column) -> Column:
        s = T.detect_section(source)
        return F.when(s == "ПБ", "UNKNOWN").otherwise(s)

    seg = table(spark, d, "translated_sample").select(routed_section(T.clean_source(F.col("text"))).alias("section"), "text")
    # the section follows from the text, of the memory's entries as of the segments
    memory = R.clean_memory(_memory(spark, d)).groupBy("source_text").agg(F.min("translated").alias("translated"))
    m = memory.withColumn("section", routed_section(F.col("source_text")))
    return R.fast_route(R.distinct_texts(seg), m, _book(spark, d))


def fast_route(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("section", "source", "route", "translated")


def routing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: rows by section and way of resolution."""
    return _routed(spark, d).groupBy("section", F.coalesce("route", F.lit("pending")).alias("route")).agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_rows").alias("n_rows"))


def routing_stats(spark: SparkSession, d: str) -> DataFrame:
    return Q.routing_stats(_routed(spark, d))


def pending_groups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translated_sample").where(T.has_cn(F.col("text"))).select("section", T.clean_source(F.col("text")).alias("source"), "row_id")
    return t.groupBy("section", F.sha1(F.encode("source", "utf-8")).alias("text_hash")).agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n_rows"))


def micro_batches(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translated_sample").where(T.has_cn(F.col("text"))).select("section", T.clean_source(F.col("text")).alias("source"))
    return R.micro_batches(t.distinct()).select("section", "source", "complexity", "batch_size", "batch_no")


def model_output_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Answers to batches of up to ten rows of an export, in the forms models give them, taken apart again."""
    t = table(spark, d, "translated_sample").select("export_id", F.floor((F.col("row_no") - 1) / 10).alias("part"), "row_id", T.squash(F.coalesce(F.nullif(T.squash(F.col("translated")), F.lit("")), F.lit("-"))).alias("v"))
    b = t.groupBy("export_id", "part").agg(F.array_sort(F.collect_list(F.struct("row_id", "v"))).alias("rows"))
    v = F.transform("rows", lambda x: x["v"])
    numbered = lambda left, right: F.array_join(F.transform(v, lambda x, i: F.concat(F.lit(left), (i + 1).cast("string"), F.lit(right), x)), "\n")
    form = F.pmod(F.col("export_id") + F.col("part"), F.lit(6))
    raw = (
        F.when(form == 0, F.to_json(v)).when(form == 1, F.concat(F.lit("```json\n"), F.to_json(F.struct(v.alias("rows"))), F.lit("\n```"))).when(form == 2, numbered("[", "] "))
        .when((form == 3) & (F.size(v) > 1), F.array_join(v, "\n@@ROW@@\n")).when(form == 4, F.concat(F.lit("Sure.\n"), numbered("[", "] "))).otherwise(numbered("", ". "))
    )
    b = b.withColumns({"answer": parsed_batch(raw, F.size("rows"))}).where("answer is not null")
    return b.select(F.explode(F.arrays_zip(F.transform("rows", lambda x: x["row_id"]).alias("row_id"), F.col("answer"))).alias("x")).select("x.row_id", F.col("x.answer").alias("answer"))


def translated_segments(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline over the texts of all drawings, without a model."""
    seg = table(spark, d, "dxf_records").select(F.col("file_id").alias("doc_id"), "seq", "text")
    out = R.translate(seg, _book(spark, d), R.clean_memory(_memory(spark, d)))
    return out.select("doc_id", "seq", "section", "translated", "translation_source", "untranslated_chinese", "qc_flags")


def memory_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translated_sample").select("row_id", "section", T.clean_source(F.col("text")).alias("source_text"))
    return t.join(_memory(spark, d), ["section", "source_text"], "left").select("row_id", F.col("translated").alias("hit"))


def memory_clean(spark: SparkSession, d: str) -> DataFrame:
    return R.clean_memory(_memory(spark, d))


def translation_metrics(spark: SparkSession, d: str) -> DataFrame:
    return Q.translation_metrics(_segments(spark, d), ["doc_id"])


def total_metrics(spark: SparkSession, d: str) -> DataFrame:
    return Q.translation_metrics(_segments(spark, d))


def suspicious_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose stored translation looks unsound by structure."""
    t = table(spark, d, "translated_sample")
    return t.where(T.suspicious(F.col("text"), T.strip(F.coalesce("translated", F.lit(""))))).select("row_id")


def untranslated_report(spark: SparkSession, d: str) -> DataFrame:
    return Q.untranslated_report(table(spark, d, "translated_sample").select("row_id", "translated"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    g = _glossary(spark, d)
    terms = G.section_terms(G.layered_terms(spark, g).where("layer in (2, 3)"))
    return Q.validation_report(table(spark, d, "translated_sample").select("row_id", "text", "translated"), terms)


def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)


def review_rows(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    return s.where(Q.needs_review(F.col("text"), F.col("translated"), F.col("untranslated_chinese"), F.col("qc_flags"))).select("row_id")


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).select("row_id", "section", "text", "translated", "untranslated_chinese", "qc_flags")
    return Q.review(s, _book(spark, d)).groupBy("llm_validation_status", "llm_validation_notes").agg(F.count(F.lit(1)).alias("n_rows"))


def audit_examples(spark: SparkSession, d: str) -> DataFrame:
    return Q.audit_examples(_segments(spark, d))


def batch_report(spark: SparkSession, d: str) -> DataFrame:
    seg = _segments(spark, d)
    files = seg.select("doc_id").distinct().select("doc_id", F.concat(F.lit("export_"), "doc_id", F.lit(".xlsx")).alias("file_name"), F.lit(None).cast("string").alias("error"))
    rep = _report(spark, d).join(seg.select("row_id", "doc_id", "seq"), "row_id")
    return Q.batch_report(files, seg, rep)


def document_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return L.document_keys(_segments(spark, d))


def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    c = (F.col("section"), F.col("text"), F.col("translated"), F.col("translation_source"))
    return s.where(T.viable_candidate(*c)).select("row_id", T.candidate_score(*c[1:]).alias("confidence"))


NO_CANDIDATES = "section string, cn string, current_ru string, source string, standard_ref string, status string, note string, n_docs int, confidence double, recommended string, doc_keys array<string>"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    seg = _segments(spark, d)
    triples = L.document_triples(seg, L.document_keys(seg), _glossary(spark, d))
    return L.upsert_candidates(spark.createDataFrame([], NO_CANDIDATES), triples)


def candidate_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("section", "cn", "current_ru", "n_docs", "confidence", "status", "recommended")


def candidate_sanitise(spark: SparkSession, d: str) -> DataFrame:
    return L.sanitise_candidates(_candidates(spark, d)).select("section", "cn", "current_ru", "n_docs", "confidence", "status")


def recommended_terms(spark: SparkSession, d: str) -> DataFrame:
    return L.recommended(_candidates(spark, d)).select("section", "cn", "current_ru", "n_docs", "confidence")


def promoted_glossary(spark: SparkSession, d: str) -> DataFrame:
    grown, _ = L.promote(_glossary(spark, d), _candidates(spark, d))
    return grown.groupBy("section", "status").agg(F.count(F.lit(1)).alias("n_terms"))


def frequent_terms(spark: SparkSession, d: str) -> DataFrame:
    known = G.approved_terms(_glossary(spark, d)).select(T.strip(F.col("cn")).alias("cn"))
    rec = table(spark, d, "dxf_records").select(F.col("file_id").alias("doc_id"), "seq", T.detect_section(F.col("text")).alias("section"), "text")
    return L.frequent_terms(rec, known).select("cn", "count")


def merged_terms(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "approved_terms")
    store = a.where("ord < 300").groupBy("section", "cn").agg(F.max_by("ru", "ord").alias("ru"))
    new = a.where("ord >= 200").groupBy("section", "cn").agg(F.min_by("ru", "ord").alias("ru"))
    return L.merge_terms(store, new)[1]


def write_back(spark: SparkSession, d: str) -> DataFrame:
    """Drawing texts replaced by handle with the translation of the same text, the last one winning."""
    from loomtext.operators.writeback import write_by_key

    cells = table(spark, d, "dxf_records").select("file_id", "handle", "rec_id", F.coalesce("text", F.lit("")).alias("text"))
    m = _memory(spark, d).groupBy("source_text").agg(F.min("translated").alias("translated"))
    seg = table(spark, d, "dxf_records").withColumn("source_text", T.clean_source(F.col("text"))).join(m, "source_text", "left").select(
        "file_id", "handle", "rec_id", F.lit(None).cast("string").alias("normalized"), "translated", "text")
    return write_by_key(cells, seg.withColumnRenamed("rec_id", "at"), ["file_id", "handle"], "at").select("rec_id", "output")


QUERIES = {f.__name__: f for f in (
    term_precedence_map, glossary_by_section, apply_section_terms, structured_translate, cad_terms, document_terms, finalised, domain_normalise, fast_route,
    routing_summary, routing_stats, pending_groups, micro_batches, model_output_parsed, translated_segments, memory_lookup, memory_clean, translation_metrics, total_metrics,
    suspicious_pairs, untranslated_report, validation_report, review_rows, reviewed, audit_examples, batch_report, document_fingerprint, candidate_scores,
    candidate_upsert, candidate_sanitise, recommended_terms, promoted_glossary, frequent_terms, merged_terms, write_back,
)}


# -- SQL ------------------------------------------------------------------------------------------------

def _values(rows: list[tuple]) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ")"


_BASE = _values([(s, i, k, v) for s, m in G.BASE_TERMS.items() for i, (k, v) in enumerate(m.items())])
_OK = "upper(" + strip("status") + ") IN ('APPROVED', 'OK', 'TRUE', '1', 'ДА') AND " + strip("cn") + " <> '' AND " + strip("ru") + " <> ''"
_APPROVED = f"SELECT CASE WHEN {strip('section')} = '' THEN 'ALL' ELSE {strip('section')} END AS section, ord, cn, ru FROM approved_terms WHERE {_OK}"
_LAYERS = f"""s AS (SELECT unnest(['ТХ','ОВ','ВК','ЭОМ','КЖ','АР','UNKNOWN','ПБ']) AS target), b AS (SELECT * FROM {_BASE} t(section, ord, cn, ru)), a AS ({_APPROVED}),
 l AS (SELECT target, cn, ru, CASE WHEN section = 'UNKNOWN' THEN 0 ELSE 1 END AS layer, ord FROM s, b WHERE section = target OR section = 'UNKNOWN'
  UNION ALL SELECT target, cn, ru, CASE WHEN section = 'ALL' THEN 2 ELSE 3 END, ord FROM s, a WHERE section = target OR section = 'ALL'),
 w AS (SELECT target, cn, arg_max(ru, layer * 100000 + ord) AS ru, min(layer * 100000 + ord) AS place FROM l GROUP BY 1, 2),
 t AS (SELECT target, list({{'k': cn, 'v': ru}} ORDER BY length(cn) DESC, place) AS terms FROM w GROUP BY 1),
 nw AS (SELECT target, cn, arg_max(ru, layer * 100000 + ord) AS ru, min(layer * 100000 + ord) AS place FROM l WHERE layer >= 2 GROUP BY 1, 2),
 n AS (SELECT target, list({{'k': cn, 'v': ru}} ORDER BY length(cn) DESC, place) AS norm FROM nw GROUP BY 1)"""


def _fold(x: str, terms: str) -> str:
    return f"list_reduce({terms}, lambda a, y: {{'k': '', 'v': replace(a.v, y.k, y.v)}}, {{'k': '', 'v': {x}}}).v"


def _chain(x: str, terms: dict[str, str]) -> str:
    for k, v in terms.items():
        x = f"replace({x}, '{k}', '{v}')"
    return x


_CLEAN = f"substr({squash('text')}, 1, 1400)"
_SEG = r"""seg AS (SELECT export_id AS doc_id, row_no AS seq, row_id, section, text, translated, coalesce(translation_source, '') AS src, coalesce(regexp_matches(translated, '[一-鿿]'), false) AS cn,
 CASE WHEN len(regexp_extract_all(coalesce(translated, ''), '[一-鿿]+')) >= 2 THEN 'multiple_chinese_fragments,needs_manual_review' WHEN regexp_matches(coalesce(translated, ''), '[一-鿿]') THEN 'needs_manual_review' ELSE '' END AS qc FROM translated_sample)"""
_MEM = f"mem AS (SELECT section, source_text, arg_min(tr, row_id) AS translated FROM (SELECT section, {_CLEAN} AS source_text, {strip('translated')} AS tr, row_id FROM translated_sample WHERE translated IS NOT NULL) GROUP BY 1, 2)"
_METRICS = """count(*) AS rows, count(*) FILTER (regexp_matches(src, '^(passthrough|memory|structured_dict|section_dict)')) AS fast_rows, count(*) FILTER (regexp_matches(src, '^(ollama|deepseek|fallback)')) AS llm_rows,
 count(*) FILTER (contains(src, 'duplicate')) AS duplicate_rows, count(*) FILTER (starts_with(src, 'memory')) AS memory_rows, count(*) FILTER (regexp_matches(src, '^(structured_dict|section_dict)')) AS dictionary_rows,
 count(*) FILTER (starts_with(src, 'passthrough')) AS passthrough_rows, count(*) FILTER (cn) AS untranslated_chinese_rows, count(*) FILTER (qc <> '') AS qc_flagged_rows,
 array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(qc, ','))), lambda x: x <> ''))), ', ') AS qc_flags"""
_WORDS = "[А-Яа-яЁёA-Za-z]+"


def _n(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, '{p}'))"


_S, _V = strip("text"), strip("translated")
_LIST = f"({marks('s', '，,')} >= 2 OR contains(s, '（') OR contains(s, '('))"
_SUSPICIOUS = rf"""(v = '' OR regexp_matches(lower(v), '^(перевод:|translation:|here is|объяснение|note:|примечание:)') OR regexp_full_match(v, '[\s\p{{Nd}},.;:()/%×\-–—_]+') OR regexp_matches(v, '[一-鿿]')
 OR (regexp_matches(s, '[一-鿿]') AND length(s) >= 20 AND (length(v) < greatest(8, floor(length(s) * 0.22)) OR {_n('v', '[А-Яа-яЁё]')} / length(v) < 0.12))
 OR (regexp_matches(s, '[一-鿿]') AND regexp_full_match(v, '[A-Za-z0-9\s,.;:()/%×\-–—_]+')) OR ({_n('s', '[一-鿿]+')} >= 3 AND {_n('v', _WORDS)} < least(3, {_n('s', '[一-鿿]+')})) OR ({_LIST} AND {_n('v', _WORDS)} < 3))"""
_NUM = r"\p{Nd}+(?:[.,]\p{Nd}+)?"
_LACK = f"list_filter(regexp_extract_all(coalesce(text, ''), '{_NUM}'), lambda x: NOT list_contains(regexp_extract_all(coalesce(translated, ''), '{_NUM}'), x))"
_NOISE = lambda x: rf"({x} = '' OR regexp_full_match({x}, '[\s\p{{Nd}},.;:()/%×\-–—_:+*\\\[\]{{}}<>|]+') OR regexp_full_match({x}, '[A-Za-z]{{1,3}}') OR length({x}) <= 2)"
_VIABLE = f"""(NOT {_NOISE('qs')} AND NOT {_NOISE('qt')} AND regexp_matches(qs, '[一-鿿]') AND NOT regexp_matches(qt, '[一-鿿]') AND regexp_matches(qt, '[А-Яа-яЁё]')
 AND length(qt) >= greatest(4, floor(length(qs) * 0.18)) AND NOT (sec = 'UNKNOWN' AND length(qt) < 8) AND NOT (starts_with(o, 'section_dict') AND length(qt) < 8))"""
_SCORE = """least(100, CASE WHEN s <> '' AND v <> '' THEN 10 ELSE 0 END + CASE WHEN v <> '' AND NOT regexp_matches(v, '[一-鿿]') THEN 35 ELSE 0 END + CASE WHEN regexp_matches(v, '[А-Яа-яЁё]') THEN 20 ELSE 0 END
 + CASE WHEN v <> '' AND length(v) >= greatest(4, floor(length(s) * 0.25)) THEN 15 ELSE 0 END + CASE WHEN regexp_matches(o, '^(memory|section_dict|ollama_duplicate|deepseek_duplicate)') THEN 15 ELSE 0 END
 + CASE WHEN starts_with(o, 'deepseek') THEN 10 ELSE 0 END + CASE WHEN v <> '' AND lower(v) <> lower(s) THEN 5 ELSE 0 END) / 100.0"""
_CAND = f"""{_SEG}, c AS (SELECT doc_id, seq, row_id, CASE WHEN {strip('section')} = '' THEN 'UNKNOWN' ELSE {strip('section')} END AS sec, {strip('text')} AS s, {strip('translated')} AS v,
 {squash('text')} AS qs, {squash('translated')} AS qt, CASE WHEN {strip('src')} = '' THEN 'document' ELSE {strip('src')} END AS o FROM seg)"""
_TRIPLES = f"""{_CAND}, one AS (SELECT doc_id, sec, s, v, arg_min(o, seq) AS o FROM c WHERE {_VIABLE} GROUP BY 1, 2, 3, 4),
 fp AS (SELECT doc_id, substr(sha1(string_agg({strip('section')} || '||' || {strip('text')}, chr(10) ORDER BY seq)), 1, 12) AS doc_key FROM seg GROUP BY 1),
 tri AS (SELECT one.*, doc_key, {_SCORE} AS conf FROM one JOIN fp USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM approved_terms t WHERE {strip('t.section')} = sec AND {strip('t.cn')} = s AND {strip('t.ru')} = v)),
 up AS (SELECT sec AS section, s AS cn, v AS current_ru, count(DISTINCT doc_key)::INT AS n_docs, max(conf) AS confidence FROM tri GROUP BY 1, 2, 3)"""
_GOOD = "(current_ru <> '' AND NOT regexp_matches(current_ru, '[一-鿿]') AND n_docs >= 2 AND confidence >= 0.75)"
_SECTION = SECTION_SQL.format(x="text")
_REPORT = f"""ap AS (SELECT target, list({{'k': {strip('cn')}, 'v': {strip('ru')}}} ORDER BY length({strip('cn')}) DESC, place) AS approved FROM nw GROUP BY 1),
 r AS (SELECT row_id, text, coalesce(translated, text, '') AS tx, {_SECTION} AS section FROM translated_sample),
 q AS (SELECT row_id, section, tx, list_concat(list_concat(list_filter([CASE WHEN {strip('tx')} = '' THEN 'Пустой результат перевода' END, CASE WHEN regexp_matches(tx, '[一-鿿]') THEN 'Остались китайские символы' END], lambda x: x IS NOT NULL),
  coalesce(list_transform(list_filter(approved, lambda x: contains(text, x.k) AND NOT contains(lower(tx), lower(x.v))), lambda x: 'Термин ''' || x.k || ''' должен быть приведен как ''' || x.v || ''''), [])),
  list_filter([CASE WHEN section = 'ПБ' AND contains(tx, '喷粉') THEN 'Требуется взрывозащита СП РК ПБ' END, CASE WHEN section = 'ОВ' AND contains(lower(tx), ' печь') THEN 'Проверить вытяжную вентиляцию СП РК ОВ' END,
   CASE WHEN section = 'ЭОМ' AND contains(lower(tx), 'shield') THEN 'Проверить ПУЭ РК' END, CASE WHEN section = 'КЖ' AND contains(lower(tx), 'steel') THEN 'СП РК КМ проверить нагрузки' END], lambda x: x IS NOT NULL)) AS issues
  FROM r LEFT JOIN ap ON ap.target = r.section)"""

ORACLE = {
    "term_precedence_map": f"WITH {_LAYERS} SELECT target AS section, cn, ru FROM w",
    "glossary_by_section": f"SELECT section, count(*) AS n_terms, sum(length(ru))::BIGINT AS chars FROM (SELECT section, cn, arg_max(ru, ord) AS ru FROM ({_APPROVED}) GROUP BY 1, 2) GROUP BY 1",
    "apply_section_terms": f"WITH {_LAYERS}, x AS (SELECT row_id, section, {_CLEAN} AS c FROM translated_sample) SELECT row_id, {_fold(_fold('c', 'terms'), 'coalesce(norm, [])')} AS by_terms FROM x JOIN t ON t.target = x.section LEFT JOIN n ON n.target = x.section",
    "structured_translate": f"""WITH {_LAYERS}, x AS (SELECT row_id, section, unnest(regexp_extract_all(c, '[一-鿿]+|[^一-鿿]+')) AS part, generate_subscripts(regexp_extract_all(c, '[一-鿿]+|[^一-鿿]+'), 1) AS i FROM (SELECT row_id, section, {_CLEAN} AS c FROM translated_sample)),
        y AS (SELECT row_id, i, CASE WHEN regexp_matches(part, '[一-鿿]') THEN coalesce(list_filter(terms, lambda q: q.k = part)[1].v, {_fold('part', 'terms')}) ELSE part END AS p FROM x JOIN t ON t.target = x.section)
        SELECT row_id, string_agg(p, '' ORDER BY i) AS by_runs FROM y GROUP BY 1""",
    "cad_terms": f"SELECT rec_id, {_chain(chr(99) + 'oalesce(text, chr(32))', G.CAD_TERMS)} AS by_terms FROM dxf_records WHERE text IS NOT NULL UNION ALL SELECT rec_id, '' FROM dxf_records WHERE text IS NULL",
    "document_terms": f"SELECT row_id, {_chain('text', G.DOCUMENT_TERMS)} AS by_terms FROM translated_sample",
    "pending_groups": f"SELECT section, sha1({_CLEAN}) AS text_hash, min(row_id) AS first_row, count(*) AS n_rows FROM translated_sample WHERE regexp_matches(text, '[一-鿿]') GROUP BY 1, 2",
    "micro_batches": f"""WITH x AS (SELECT DISTINCT section, {_CLEAN} AS source FROM translated_sample WHERE regexp_matches(text, '[一-鿿]')), y AS (SELECT section, source, length(source) AS n, {marks('source', '，,。;；')} AS p FROM x),
        z AS (SELECT section, source, n, (CASE WHEN n >= 700 OR p >= 8 THEN 4 WHEN n >= 420 OR p >= 5 THEN 3 WHEN n >= 180 OR p >= 3 THEN 2 WHEN n >= 80 THEN 1 ELSE 0 END)::INT AS complexity FROM y), g AS (SELECT complexity, max(n)::INT AS longest, avg(n) AS mean FROM z GROUP BY 1),
        s AS (SELECT complexity, (CASE WHEN longest <= 80 AND mean <= 45 THEN 32 WHEN longest <= 160 AND mean <= 80 THEN 18 WHEN longest >= 700 OR mean >= 260 THEN 2 WHEN longest >= 420 OR mean >= 180 THEN 3 WHEN longest >= 260 OR mean >= 120 THEN 5 ELSE 10 END)::INT AS batch_size FROM g)
        SELECT section, source, complexity, batch_size, ((row_number() OVER (PARTITION BY complexity ORDER BY n, sha1(section || '|' || source)) - 1) // batch_size)::BIGINT AS batch_no FROM z JOIN s USING (complexity)""",
    "model_output_parsed": f"""SELECT row_id, CASE WHEN regexp_matches(v, '(?i)^(here|translation|перевод|объяснение)([^[:alnum:]а-яё_]|$)') THEN '' ELSE v END AS answer
        FROM (SELECT row_id, CASE WHEN {squash('translated')} = '' THEN '-' ELSE {squash('translated')} END AS v FROM translated_sample)""",
    "memory_lookup": f"WITH {_MEM} SELECT row_id, m.translated AS hit FROM (SELECT row_id, section, {_CLEAN} AS source_text FROM translated_sample) x LEFT JOIN mem m USING (section, source_text)",
    "memory_clean": rf"""WITH {_MEM}, x AS (SELECT *, {strip('source_text')} AS s, {strip('translated')} AS v FROM mem)
        SELECT section, source_text, v AS translated FROM x WHERE NOT (v = '' OR regexp_full_match(v, '[\s\p{{Nd}},.;:()/%×\-–—_:+*\\\[\]{{}}<>|]+') OR length(v) <= 2 OR regexp_matches(v, '[一-鿿]') OR (NOT regexp_matches(v, '[А-Яа-яЁё]') AND length(v) < 12)
         OR (length(v) - length(regexp_replace(v, '{_WORDS}', '', 'g'))) / length(v) < 0.35 OR (regexp_matches(v, '[（(]') AND {_n('v', _WORDS)} < 2)
         OR ({_n('s', '[一-鿿]+')} >= 3 AND {_n('v', _WORDS)} < least(3, {_n('s', '[一-鿿]+')})) OR ({_LIST} AND {_n('v', _WORDS)} < 3))""",
    "translation_metrics": f"WITH {_SEG} SELECT doc_id, {_METRICS} FROM seg GROUP BY 1",
    "total_metrics": f"WITH {_SEG} SELECT {_METRICS} FROM seg",
    "suspicious_pairs": f"SELECT row_id FROM (SELECT row_id, {_S} AS s, {_V} AS v FROM translated_sample) WHERE {_SUSPICIOUS}",
    "untranslated_report": "SELECT row_id, translated, 'translated' AS report_column FROM translated_sample WHERE regexp_matches(translated, '[一-鿿]')",
    "validation_report": f"WITH {_LAYERS}, {_REPORT} SELECT row_id, section, tx AS text, CASE WHEN len(issues) > 0 THEN 'WARN' ELSE 'OK' END AS status, array_to_string(issues, '; ') AS issues FROM q",
    "review_rows": f"""WITH {_SEG}, x AS (SELECT *, {_S} AS s, {_V} AS v FROM seg) SELECT row_id FROM x WHERE v = '' OR cn OR qc <> '' OR {_SUSPICIOUS} OR len({_LACK}) > 0 OR ({_LIST} AND {_n('v', _WORDS)} < 2)
        OR (length(s) >= 20 AND {_n('v', _WORDS)} < 2) OR (regexp_matches({strip('substr(s, 1, 2)')}, '[:：]$') AND {_n('v', _WORDS)} < 1)""",
    "audit_examples": f"""WITH {_SEG}, x AS (SELECT *, CASE WHEN cn THEN 100 ELSE 0 END + CASE WHEN qc <> '' THEN 60 ELSE 0 END + CASE WHEN len({_LACK}) > 0 THEN 40 ELSE 0 END + CASE WHEN starts_with(src, 'fallback') THEN 30 ELSE 0 END
         + CASE WHEN length(text) >= 80 AND length(coalesce(translated, '')) < greatest(8, floor(length(text) * 0.22)) THEN 25 ELSE 0 END AS score FROM seg)
        SELECT row_id, coalesce(section, 'UNKNOWN') AS section, score::INT AS score, CASE WHEN length({_S}) <= 420 THEN {_S} ELSE regexp_replace(substr({_S}, 1, 419), '{WS}+$', '') || '...' END AS source,
         CASE WHEN length({_V}) <= 420 THEN {_V} ELSE regexp_replace(substr({_V}, 1, 419), '{WS}+$', '') || '...' END AS translated, src AS translation_source, array_to_string({_LACK}, ', ') AS missing_numbers
        FROM x WHERE score > 0 ORDER BY score DESC, row_id LIMIT 18""",
    "batch_report": f"""WITH {_LAYERS}, {_REPORT}, {_SEG}, m AS (SELECT doc_id, {_METRICS} FROM seg GROUP BY 1), wr AS (SELECT doc_id, array_to_string(issues, '; ') AS i, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM q JOIN seg USING (row_id) WHERE len(issues) > 0),
        k AS (SELECT doc_id, count(*) AS warnings, string_agg(i, '; ' ORDER BY rn) FILTER (rn <= 5) AS issues FROM wr GROUP BY 1)
        SELECT doc_id, 'export_' || doc_id || '.xlsx' AS file_name, 'export_' || doc_id || '_RU.xlsx' AS output_name, CASE WHEN k.warnings > 0 THEN 'WARN' ELSE 'OK' END AS status, rows, fast_rows, llm_rows, duplicate_rows, memory_rows, dictionary_rows,
         passthrough_rows, untranslated_chinese_rows, qc_flagged_rows, coalesce(warnings, 0) AS warnings, coalesce(k.issues, '') AS issues FROM m LEFT JOIN k USING (doc_id)""",
    "document_fingerprint": f"WITH {_TRIPLES} SELECT doc_id, doc_key FROM fp",
    "candidate_scores": f"WITH {_SEG}, c AS (SELECT row_id, CASE WHEN {strip('section')} = '' THEN 'UNKNOWN' ELSE {strip('section')} END AS sec, {strip('text')} AS s, {strip('translated')} AS v, {squash('text')} AS qs, {squash('translated')} AS qt, src AS o FROM seg) SELECT row_id, {_SCORE} AS confidence FROM c WHERE {_VIABLE}",
    "candidate_upsert": f"WITH {_TRIPLES} SELECT section, cn, current_ru, n_docs, confidence, CASE WHEN {_GOOD} THEN 'RECOMMENDED' ELSE 'NEW' END AS status, CASE WHEN {_GOOD} THEN 'YES' ELSE '' END AS recommended FROM up",
    "recommended_terms": f"WITH {_TRIPLES} SELECT section, cn, current_ru, n_docs, confidence FROM up WHERE {_GOOD} ",
    "promoted_glossary": f"WITH {_TRIPLES} SELECT section, status, count(*) AS n_terms FROM (SELECT section, status FROM approved_terms UNION ALL SELECT section, 'APPROVED' FROM up WHERE {_GOOD}) GROUP BY 1, 2",
    "frequent_terms": f"""WITH x AS (SELECT file_id, seq, {squash('text')} AS t FROM dxf_records), y AS (SELECT * FROM x WHERE length(t) <= 80 AND {_n('t', '[一-鿿]')} >= 2),
        e AS (SELECT file_id, seq, 0 AS pos, t AS cn, 2 AS w FROM y WHERE {_n('t', '[一-鿿]')} <= 16 UNION ALL SELECT file_id, seq, generate_subscripts(regexp_extract_all(t, '[一-鿿]+'), 1), unnest(regexp_extract_all(t, '[一-鿿]+')), 1 FROM y),
        g AS (SELECT cn, sum(w)::BIGINT AS "count", min(file_id * 1e12 + seq * 1e4 + pos) AS first FROM e WHERE {_n('cn', '[一-鿿]')} >= 2 GROUP BY 1)
        SELECT cn, "count" FROM g WHERE cn NOT IN (SELECT {strip('cn')} FROM ({_APPROVED})) ORDER BY "count" DESC, first LIMIT 120""",
    "merged_terms": """WITH a AS (SELECT section, cn, arg_max(ru, ord) AS ru FROM approved_terms WHERE ord < 300 GROUP BY 1, 2), b AS (SELECT section, cn, arg_min(ru, ord) AS ru FROM approved_terms WHERE ord >= 200 GROUP BY 1, 2)
        SELECT count(*) FILTER (a.ru IS NULL) AS added, count(*) FILTER (a.ru <> b.ru) AS updated FROM a FULL JOIN b ON a.section = b.section AND a.cn = b.cn""",
    "write_back": f"""WITH {_MEM}, m AS (SELECT source_text, min(translated) AS translated FROM mem GROUP BY 1), x AS (SELECT file_id, handle, rec_id, text, CASE WHEN {strip('m.translated')} <> '' THEN m.translated WHEN {strip('text')} <> '' THEN text ELSE '' END AS o
         FROM (SELECT *, {_CLEAN} AS source_text FROM dxf_records) LEFT JOIN m USING (source_text)), y AS (SELECT file_id, handle, arg_max(o, rec_id) AS o FROM x GROUP BY 1, 2)
        SELECT d.rec_id, y.o AS output FROM dxf_records d JOIN y USING (file_id, handle)""",
    "candidate_sanitise": f"""WITH {_TRIPLES}, last AS (SELECT sec, s, v, count(DISTINCT doc_key)::INT AS n_docs, max(conf) AS conf, arg_max(o, doc_id) AS o FROM tri GROUP BY 1, 2, 3),
        k AS (SELECT sec, {squash('s')} AS s, {squash('v')} AS v, {squash('s')} AS qs, {squash('v')} AS qt, n_docs, conf, o FROM last),
        m AS (SELECT sec AS section, s AS cn, v AS current_ru, n_docs, o, round(least(greatest(conf, {_SCORE}), 1.0), 2) AS confidence, v <> '' AND NOT regexp_matches(v, '[一-鿿]') AND n_docs >= 2 AND conf >= 0.75 AS was FROM k WHERE {_VIABLE}),
        w AS (SELECT *, row_number() OVER (PARTITION BY section, cn, current_ru ORDER BY n_docs DESC, confidence DESC, o DESC) AS rn FROM m)
        SELECT section, cn, current_ru, n_docs, confidence, CASE WHEN {_GOOD} OR was THEN 'RECOMMENDED' ELSE 'NEW' END AS status FROM w WHERE rn = 1""",
}
