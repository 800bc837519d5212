"""Reports on translated segments: metrics, validation, review selection, audit examples, documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.glossary import TermBook
from loomtext.plans.translate import Book, finalise

FAST = "^(?:passthrough|memory|structured_dict|section_dict)"
MODEL = "^(?:ollama|deepseek|fallback)"
AUDIT_ROWS = 18


def translation_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The ten figures of translated segments(translation_source, untranslated_chinese, qc_flags), in all or by columns.

    Without by an empty input gives one row of zeros.
    """
    s, q = F.coalesce("translation_source", F.lit("")), F.coalesce("qc_flags", F.lit(""))
    flag_set = F.array_sort(F.array_distinct(F.flatten(F.collect_set(T.split_flags(q)))))
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(s.rlike(FAST)).alias("fast_rows"), F.count_if(s.rlike(MODEL)).alias("llm_rows"),
        F.count_if(s.contains("duplicate")).alias("duplicate_rows"), F.count_if(s.startswith("memory")).alias("memory_rows"),
        F.count_if(s.rlike("^(?:structured_dict|section_dict)")).alias("dictionary_rows"), F.count_if(s.startswith("passthrough")).alias("passthrough_rows"),
        F.count_if(F.coalesce("untranslated_chinese", F.lit(False))).alias("untranslated_chinese_rows"),
        F.count_if(T.strip(q) != "").alias("qc_flagged_rows"), F.array_join(flag_set, ", ").alias("qc_flags"),
    )


def routing_stats(routed: DataFrame) -> DataFrame:
    """Rows by way of resolution; routed(section, source, route, n_rows) holds each distinct text once."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n_rows"))), F.lit(0))
    r = F.col("route")
    return routed.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"), n(r == "passthrough").alias("passthrough"), n(r == "memory").alias("memory"),
        n(r.isin("structured_dict", "section_dict")).alias("dictionary"),
        F.coalesce(F.sum(F.when(r.isNull(), F.col("n_rows") - 1)), F.lit(0)).alias("duplicates"), F.count_if(r.isNull()).alias("llm_unique"),
    )


def term_issues(df: DataFrame, terms: DataFrame) -> DataFrame:
    """df(row_id, section, text, target) with issues: the approved terms(section, cn, ru, place) in text that target lacks.

    The terms of a text are found as in TermBook, by a join over the beginnings of keys.
    """
    clean = terms.where((T.strip(F.col("cn")) != "") & (T.strip(F.col("ru")) != "")).select(
        "section", F.lit("norm_terms").alias("kind"), T.strip(F.col("cn")).alias("cn"), T.strip(F.col("ru")).alias("ru"), "place")
    d = TermBook(clean).matched(df.withColumns({"_key": F.col("section"), "_held": F.col("text")}))
    d = d.withColumn("_hits", F.concat(F.transform("_hits", lambda h: h["item"]), F.filter("_any_norm_terms", lambda t: F.contains("_held", t["k"]))))
    low = F.lower(F.col("target"))
    found = F.transform(F.array_sort("_hits"), lambda t: F.struct(t["k"].alias("k"), t["v"].alias("v")))
    lacking = F.filter(found, lambda t: F.contains(F.col("text"), t["k"]) & ~F.contains(low, F.lower(t["v"])))
    say = F.transform(lacking, lambda t: F.concat(F.lit("Термин '"), t["k"], F.lit("' должен быть приведен как '"), t["v"], F.lit("'")))
    return d.withColumn("issues", F.coalesce(say, F.array().cast("array<string>"))).drop("_key", "_held", "_hits", "_any_terms", "_any_norm_terms", "_any_residual_terms")


def validation_report(df: DataFrame, terms: DataFrame) -> DataFrame:
    """(row_id, section, text, status, issues) for df(row_id, text, translated[, normalized]); null texts count as empty."""
    target = F.coalesce(*( [F.col("normalized")] if "normalized" in df.columns else []), F.col("translated"), F.col("text"), F.lit(""))
    d = df.select("row_id", F.coalesce("text", F.lit("")).alias("text"), target.alias("target")).withColumn("section", T.detect_section(F.col("text")))
    d = term_issues(d, terms)
    own = F.array_compact(F.array(
        F.when(T.strip(F.col("target")) == "", "Пустой результат перевода"), F.when(T.has_cn(F.col("target")), "Остались китайские символы")))
    issues = F.concat(own, F.col("issues"), T.rule_issues(F.col("section"), F.col("target")))
    return d.select("row_id", "section", F.col("target").alias("text"), F.when(F.size(issues) > 0, "WARN").otherwise("OK").alias("status"), F.array_join(issues, "; ").alias("issues"))


def untranslated_report(df: DataFrame) -> DataFrame:
    """Rows with Chinese left in the column that is reported (normalized where there is one)."""
    column = "normalized" if "normalized" in df.columns else "translated"
    return df.where(T.has_cn(F.col(column))).withColumn("report_column", F.lit(column))


def audit_score(text: Column, translated: Column, origin: Column, untranslated: Column, flags: Column) -> Column:
    t, v = F.coalesce(text, F.lit("")), F.coalesce(translated, F.lit(""))
    points = [
        (F.coalesce(untranslated, F.lit(False)) | T.has_cn(v), 100), (F.coalesce(flags, F.lit("")) != "", 60),
        (F.size(T.missing_numbers(t, v)) > 0, 40), (F.coalesce(origin, F.lit("")).startswith("fallback"), 30),
        ((F.length(t) >= 80) & (F.length(v) < F.greatest(F.lit(8), F.floor(F.length(t) * 0.22))), 25),
    ]
    total = F.lit(0)
    for cond, n in points:
        total = total + F.when(cond, n).otherwise(0)
    return total


def audit_examples(df: DataFrame, limit: int = AUDIT_ROWS) -> DataFrame:
    """The limit worst rows of df(row_id, section, text, translated, translation_source, untranslated_chinese, qc_flags).

    Ties go to the smaller row_id. If no row scores, the first limit rows are shown without missing numbers.
    """
    scored = df.withColumn("score", audit_score(F.col("text"), F.col("translated"), F.col("translation_source"), F.col("untranslated_chinese"), F.col("qc_flags")))
    # rows that score come first; if there is none, all the others are candidates
    worst = scored.withColumn("_some", F.col("score") > 0).orderBy(F.desc("score"), "row_id").limit(limit)
    any_score = worst.agg(F.coalesce(F.bool_or("_some"), F.lit(False)).alias("_any"))
    worst = worst.crossJoin(F.broadcast(any_score)).where("_some or not _any")  # one row beside at most limit rows
    return worst.select(
        "row_id", F.coalesce("section", F.lit("UNKNOWN")).alias("section"), "score", T.clip(F.col("text")).alias("source"), T.clip(F.col("translated")).alias("translated"),
        F.coalesce("translation_source", F.lit("")).alias("translation_source"),
        F.when(F.col("score") > 0, F.array_join(T.missing_numbers(F.col("text"), F.col("translated")), ", ")).otherwise("").alias("missing_numbers"),
    )


def needs_review(text: Column, translated: Column, untranslated: Column, flags: Column) -> Column:
    """Rows a reviewing model should see."""
    t, v = T.strip(F.coalesce(text, F.lit(""))), T.strip(F.coalesce(translated, F.lit("")))
    n = T.tokens(v)
    head = T.strip(F.substring(t, 1, 2))
    incomplete = (T.list_like(t) & (n < 2)) | ((F.length(t) >= 20) & (n < 2)) | (head.rlike("[:：]$") & (n < 1))
    return (
        (v == "") | F.coalesce(untranslated, F.lit(False)) | (T.strip(F.coalesce(flags, F.lit(""))) != "") | T.suspicious(t, v)
        | (F.size(T.missing_numbers(t, v)) > 0) | incomplete
    )


def review(df: DataFrame, book: Book, model: Callable[[list[str]], list[str]] | None = None, only_flagged: bool = True) -> DataFrame:
    """df(row_id, text, translated, section, untranslated_chinese, qc_flags) with the reviewed text.

    Adds llm_validation_status (SKIP, CHECKED, EDITED) and llm_validation_notes. The model gets source and
    current text; without one every call fails, which leaves the text as it is.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list[str | None] = [None] * len(pdf)
            if model:
                try:
                    got = list(model([f"{s}\n{t}" for s, t in zip(pdf["text"], pdf["translated"])]))
                except Exception:  # noqa: BLE001
                    got = [None] * len(pdf)
            yield pd.DataFrame({"row_id": pdf["row_id"], "_got": got})

    d = df.withColumn("_see", needs_review(F.col("text"), F.col("translated"), F.col("untranslated_chinese"), F.col("qc_flags")) if only_flagged else F.lit(True))
    asked = d.where("_see").select("row_id", "text", "translated").mapInPandas(run, "row_id bigint, _got string")
    d = finalise(d.join(asked, "row_id", "left"), "text", "_got", "_c", book)
    current = T.strip(F.coalesce("translated", F.lit("")))
    note = (
        F.when(~F.col("_see"), "").when(F.col("_got").isNull(), "request_failed").when(F.col("_c") == "", "empty_response").when(T.has_cn(F.col("_c")), "contains_chinese")
        .when(T.suspicious(F.col("text"), F.col("_c")), "low_quality").when(F.size(T.missing_numbers(F.col("text"), F.col("_c"))) > 0, "missing_numbers")
        .when(F.col("_c") == current, "unchanged").otherwise("edited")
    )
    edited = F.col("llm_validation_notes") == "edited"
    return d.withColumn("llm_validation_notes", note).withColumns({
        "llm_validation_status": F.when(~F.col("_see"), "SKIP").when(edited, "EDITED").otherwise("CHECKED"),
        "llm_validation_source": F.when(edited, "llm_validator").otherwise(""), "translated": F.when(edited, F.col("_c")).otherwise(F.col("translated")),
    }).drop("_see", "_got", "_c", "_c_untranslated", "_c_flags")


def batch_report(files: DataFrame, translated: DataFrame, report: DataFrame, first_issues: int = 5) -> DataFrame:
    """One row per file: status, rows, warnings, the routing figures and the first issues by seq.

    files(doc_id, file_name, error), translated(doc_id, ...), report(doc_id, seq, status, issues); a file with an error
    has status ERROR and zero figures. The issues kept are the lowest first_issues by seq, found without gathering all.
    """
    from pyspark.sql import Window

    warn = report.where("status <> 'OK'")
    n_warn = warn.groupBy("doc_id").agg(F.count(F.lit(1)).alias("warnings"))
    few = warn.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))).where(F.col("rn") <= first_issues)
    said = few.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "issues"))), lambda x: x["issues"]), "; ").alias("issues"))
    figures = translation_metrics(translated, ["doc_id"]).drop("qc_flags")
    out = files.join(figures, "doc_id", "left").join(n_warn, "doc_id", "left").join(said, "doc_id", "left")
    bad = F.col("error").isNotNull()
    counts = [c for c in figures.columns if c != "doc_id"] + ["warnings"]
    out = out.withColumns({c: F.when(bad, 0).otherwise(F.coalesce(c, F.lit(0))) for c in counts})
    return out.select(
        "doc_id", "file_name", T.ru_name(F.col("file_name")).alias("output_name"),
        F.when(bad, "ERROR").when(F.col("warnings") == 0, "OK").otherwise("WARN").alias("status"), *counts,
        F.when(bad, F.col("error")).otherwise(F.coalesce("issues", F.lit(""))).alias("issues"),
    )
