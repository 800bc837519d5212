"""Write-back and project plans: which text goes where, as joins; names of outputs and of renamed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.glossary import FILE_NAME_TERMS, fold_fixed


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one that comes last by order; decided by aggregation, before any shuffle of rows."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r")).select(*keys, "_r.*")


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r")).select(*keys, "_r.*")


def drawing_records(records: DataFrame) -> DataFrame:
    """Translatable records(file_id, seq, handle, entity_type, text, ...), once per file, handle, type and text: the first by seq."""
    return first_by(records.where(T.is_translatable(F.col("text"))), ["file_id", "handle", "entity_type", "text"], "seq")


def write_by_key(cells: DataFrame, segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """cells(keys, text) with output: the text chosen from segments(keys, order, normalized, translated, text), the last
    segment of a key winning; a cell without a segment keeps its text."""
    chosen = segments.select(*keys, order, T.output_text(F.col("normalized"), F.col("translated"), F.col("text")).alias("_out"))
    return cells.join(last_by(chosen, keys, order).drop(order), keys, "left").withColumn("output", F.coalesce("_out", "text")).drop("_out")


def page_insert_jobs(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """Blocks(doc_id, seq, text, ...) to be drawn anew: joined to segments(doc_id, seq, output) by position, blank output
    skipped, and output equal to the text skipped unless the text is Chinese."""
    d = blocks.join(segments.select("doc_id", "seq", "output"), ["doc_id", "seq"], "left").withColumn("output", F.coalesce("output", "text"))
    same = T.strip(F.col("output")) == T.strip(F.col("text"))
    return d.where((T.strip(F.coalesce("output", F.lit(""))) != "") & ~(same & ~T.has_cn(F.col("text"))))


def project_plan(files: DataFrame) -> DataFrame:
    """(path, output, action) for files(path): translated by extension, others copied; old sheets get a new extension."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    known = ext.isin(".dxf", ".docx", ".pdf", ".xlsx", ".xls")
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    name = T.ru_name(F.col("path"), F.when(ext == ".xls", ".xlsx").otherwise(F.regexp_extract("path", r"(\.[^./]*)$", 1)))
    return files.select("path", F.when(known, F.concat(folder, name)).otherwise(F.col("path")).alias("output"), F.when(known, "translate").otherwise("copy").alias("action"))


def clean_file_name(c) -> object:
    """The first line, without what a model adds and without signs that no file name may hold."""
    v = F.substring_index(F.substring_index(F.substring_index(c, "\n", 1), "which", 1), "Translate", 1)
    return T.squash(F.regexp_replace(v, r'[\\/:*?"<>|]', ""))


def rename_plan(files: DataFrame) -> DataFrame:
    """(path, new_name, depth) for paths whose last part is Chinese and changes; deepest first, so no rename breaks another."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    new = clean_file_name(fold_fixed(base, FILE_NAME_TERMS, longest_first=False))
    d = files.select("path", base.alias("name"), new.alias("new_name"), T.chars(F.col("path"), "/").alias("depth"))
    return d.where(T.has_cn(F.col("name")) & (F.col("new_name") != F.col("name")) & (F.col("new_name") != "")).select("path", "new_name", "depth").orderBy(F.desc("depth"), "path")


def run_texts(text: str, runs: list[str]) -> list[str]:
    """text spread over as many runs as there were, by their share of the old length (halves to even), the rest in the last."""
    seen = [i for i, r in enumerate(runs) if r.strip()]
    total = sum(len(runs[i]) for i in seen)
    out = ["" if i in set(seen) else r for i, r in enumerate(runs)]
    if not seen:
        return [text, *out[1:]] if out else [text]
    at = 0
    for k, i in enumerate(seen):
        n = len(text) - at if k == len(seen) - 1 else round(len(text) * len(runs[i]) / max(total, 1))
        out[i] = text[at : at + n]
        at += n
    return out


def top_counts(df: DataFrame, column: str, limit: int = 12) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), column).limit(limit)


def dense_numbers(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Position within a group of bounded size; never used across a whole table."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
