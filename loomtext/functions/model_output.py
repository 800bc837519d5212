"""Answers of a translating model to a batch of texts, taken apart by expressions.

A batch may come back as a JSON array, an object of rows or of numbered entries, rows marked [1], [2] and so on, rows
between separators, a numbered list, or one row a line. The first form that gives as many rows as were asked counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import WS, bound, strip, strip_prompt

SEPARATOR = "@@ROW@@"  # fixed value: what the request asks for between rows
#: How a remark begins that is no translation.
REMARK = r"(?iuU)^(?:here(?: is|'s)|translation|перевод|объяснение)\b"


def clean_answer(c: Column) -> Column:
    """One row of an answer without code fences; a remark instead of a translation is empty."""
    return bound(strip_prompt(c), lambda v: F.when(v.rlike(REMARK), "").otherwise(strip(F.replace(v, F.lit("```"), F.lit("")))))


def _texts(rows: Column) -> Column:
    return F.filter(F.transform(rows, strip), lambda x: x != "")


def _numbered(entries: Column) -> Column:
    """Texts of structs (i, text) in the order of i; null if a number is missing, doubled or without text."""
    ordered = F.array_sort(entries)
    right = F.forall(F.transform(ordered, lambda e, k: (e["i"] == k + 1) & (e["text"] != "")), lambda ok: ok)
    return F.when(right, F.transform(ordered, lambda e: e["text"]))


def _forms(raw: Column) -> list[Column]:
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\[.*?\]|\{.*?\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(raw)
    listed, named = F.when(body.rlike(r"(?s)^\[.*\]$"), body), F.when(body.rlike(r"(?s)^\{.*\}$"), body)
    entries = F.filter(F.map_entries(F.from_json(named, "map<string,string>")), lambda e: e["key"].rlike(r"^\s*[-+]?\d+\s*$"))
    by_number = F.transform(F.array_sort(F.transform(entries, lambda e: F.struct(strip(e["key"]).cast("int").alias("i"), e["value"].alias("text")))), lambda e: e["text"])
    marked = F.filter(F.split(raw, r"(?m)^(?=\s*\[\d+\])"), lambda p: p.rlike(r"^\s*\[\d+\]"))
    rows = F.transform(marked, lambda p: F.struct(
        F.regexp_extract(p, r"^\s*\[(\d+)\]", 1).cast("int").alias("i"), F.array_join(_texts(F.split(F.regexp_replace(p, r"^\s*\[\d+\]", ""), r"\r?\n")), " ").alias("text")))
    return [
        F.from_json(listed, "array<string>"), F.from_json(named, "struct<rows:array<string>>")["rows"], by_number, _numbered(rows),
        F.when(F.contains(raw, F.lit(SEPARATOR)), F.split(raw, SEPARATOR)), _texts(F.split(F.concat(F.lit("\n"), raw), r"\n\s*\d+[).:]\s+")), _texts(F.split(raw, r"\r?\n")),
    ]


def parsed_batch(raw: Column, n: Column) -> Column:
    """The n rows of an answer, cleaned; null if no form gives n rows, as for a null or blank answer."""
    def found(v: Column) -> Column:
        fits = [F.when(F.size(form) == n, form) for form in _forms(v)]
        return F.when((v != "") & (n > 0), F.transform(F.coalesce(*fits), lambda x: clean_answer(F.coalesce(x, F.lit("")))))

    return bound(F.regexp_replace(F.coalesce(raw, F.lit("")), f"^{WS}+|{WS}+$", ""), found)
