"""Problem 2: records that are equal but for spacing, case, punctuation and field order.

Every character passes a skip-and-fold table: letters and digits fold to their case-free form, all
others are skipped, and a field separator ends a field. What is left of a field runs through two
polynomial hashes; a record's key is the order-free sum of its mixed field hashes (128 bits). The
canonical string itself is never built. Rows with equal keys are then compared with two pointers that
skip the same characters, so a hash collision can't merge different records.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.codepoints import MAX_CP, flatten, mix64, sums
from loomtext.plans.runtime import cut, table

#: Fixed by the problem statement: what separates fields.
SEPARATORS = ";；|"
#: Polynomial bases of the two hashes (odd 64-bit numbers).
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
KEEP_OTHER = MAX_CP  # offset that marks a kept non-letter, apart from every folded letter


def fold_char(ch: str) -> int:
    """The code point that stands for ch, or 0 if ch is skipped."""
    if not ch.isalnum():
        return 0
    for form in (ch.casefold(), ch.lower()):
        kept = [c for c in form if c.isalnum()]
        if len(kept) == 1:
            return ord(kept[0])
    return ord(ch)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """The fold table and the table of digits, by code point."""
    fold = np.zeros(MAX_CP, dtype=np.uint32)
    digit = np.zeros(MAX_CP, dtype=bool)
    for cp in range(0x20, 0x32000):
        ch = chr(cp)
        if ch.isalnum():
            fold[cp] = fold_char(ch)
            digit[cp] = ch.isdigit()
    return fold, digit


@lru_cache(1)
def separator_codes() -> np.ndarray:
    return np.array(sorted(map(ord, SEPARATORS)), dtype=np.uint32)


def _powers(n: int) -> list[np.ndarray]:
    out = []
    with np.errstate(over="ignore"):
        for base in BASES:
            p = np.full(n + 1, np.uint64(base & 0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out


def record_keys(texts: list[str | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit keys per text and the number of its kept characters (0: no case)."""
    fold, digit = tables()
    flat, offsets = flatten(texts)
    n = len(flat)
    if n == 0:
        zero = np.zeros(len(texts), dtype=np.uint64)
        return zero, zero, np.zeros(len(texts), dtype=np.int64)
    value = fold[flat].astype(np.uint64)
    alnum = value > 0
    sep = np.isin(flat, separator_codes())
    # a character directly between two digits of the same row counts
    first = np.zeros(n, dtype=bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    is_digit = digit[flat]
    between = np.zeros(n, dtype=bool)
    if n > 2:
        between[1:-1] = is_digit[:-2] & is_digit[2:] & ~alnum[1:-1] & ~sep[1:-1] & ~first[1:-1] & ~first[2:]
    value[between] = flat[between].astype(np.uint64) + np.uint64(KEEP_OTHER)
    kept = alnum | between
    # fields: every row starts one, every separator starts the next
    starts = first | np.concatenate(([False], sep[:-1]))
    field = np.cumsum(starts) - 1
    n_fields = int(field[-1]) + 1
    field_at = np.flatnonzero(starts)
    bounds = np.append(field_at, n)
    rank = np.cumsum(kept) - 1
    before = np.concatenate(([0], np.cumsum(kept)))[field_at]
    pos = (rank - before[field])[kept]
    letters = mix64(value[kept], seed)
    count = sums(kept.astype(np.int64), bounds)
    powers = _powers(int(pos.max()) + 1 if len(pos) else 1)
    kb = np.concatenate(([0], np.cumsum(count)))
    row_at = np.searchsorted(field_at, offsets[:-1])
    row_bounds = np.append(row_at, n_fields)
    keys = []
    with np.errstate(over="ignore"):
        for k, power in enumerate(powers):
            h = sums((letters * power[pos]).astype(np.uint64), kb)
            h = mix64(h + count.astype(np.uint64), seed * 2 + k + 1)
            h[count == 0] = 0  # empty fields are ignored
            keys.append(sums(h, row_bounds))
    # rows of zero length share the start of the next row: searchsorted gives them an empty range
    size = sums(alnum.astype(np.int64), offsets)
    return keys[0], keys[1], size


def _fields(text: str) -> list[list[int]]:
    """Positions of the kept characters of every non-empty field, for the comparison."""
    out: list[list[int]] = [[]]
    last = len(text) - 1
    for i, ch in enumerate(text):
        if ch in SEPARATORS:
            out.append([])
        elif ch.isalnum() or 0 < i < last and text[i - 1].isdigit() and text[i + 1].isdigit():
            out[-1].append(i)
    return [f for f in out if f]


def _field_equal(a: str, pa: list[int], b: str, pb: list[int]) -> bool:
    return len(pa) == len(pb) and all(
        a[i] == b[j] or fold_char(a[i]) == fold_char(b[j]) != 0 for i, j in zip(pa, pb)
    )


def same_record(a: str, b: str) -> bool:
    """Exact comparison: one pointer in each text, both skipping what doesn't count."""
    if a == b:
        return True
    i = j = 0
    la, lb = len(a), len(b)

    def counts(t: str, k: int, n: int) -> bool:
        return t[k].isalnum() or 0 < k < n - 1 and t[k] not in SEPARATORS and t[k - 1].isdigit() and t[k + 1].isdigit()

    while True:  # same order of fields: the common case
        sa = sb = False
        while i < la and not counts(a, i, la):
            sa |= a[i] in SEPARATORS
            i += 1
        while j < lb and not counts(b, j, lb):
            sb |= b[j] in SEPARATORS
            j += 1
        if i == la or j == lb:
            if i == la and j == lb:
                return True
            break
        if sa != sb and (i and j) or (a[i] != b[j] and not fold_char(a[i]) == fold_char(b[j]) != 0):
            break
        i += 1
        j += 1
    fa, fb = _fields(a), _fields(b)
    if len(fa) != len(fb):
        return False
    left = list(fb)
    for pa in fa:
        hit = next((k for k, pb in enumerate(left) if _field_equal(a, pa, b, pb)), None)
        if hit is None:
            return False
        left.pop(hit)
    return True


def _hash_batches(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h1, h2, size = record_keys(pdf["text"].tolist(), seed)
            pdf = pdf.assign(h1=h1.view(np.int64), h2=h2.view(np.int64))
            yield pdf[size > 0]

    return run


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_record(x, y) for x, y in zip(a, b)], dtype=bool)


def find_copies(records: DataFrame, seed: int = 0) -> DataFrame:
    """Copies in records(src_table string, scope bigint, id bigint, text string).

    Returns (src_table, keep_id, copy_id): the smallest id of each group of equal records with every
    other member. Null and empty texts, and texts without letter or digit, are no records. Rows with a
    null scope are compared with one another. Every id is expected once; ties can't occur.

    The key is aggregated with map-side combine, so a group that holds a third of all rows costs one
    row per task; the join back has the checkpointed groups on one side and can be split where skewed.
    Rows whose key is equal but whose text isn't are hashed again with another seed.
    """
    spark = records.sparkSession
    rows = records.select("src_table", "scope", "id", "text").where(F.col("text").isNotNull() & (F.length("text") > 0))
    keyed = rows.mapInPandas(_hash_batches(seed), "src_table string, scope bigint, id bigint, text string, h1 bigint, h2 bigint")
    on = ["src_table", "scope", "h1", "h2"]
    scope = F.coalesce(F.col("scope"), F.lit(-(2**62)))
    keyed = keyed.withColumn("scope", scope)
    groups = cut(
        keyed.groupBy(*on).agg(F.min(F.struct("id", "text")).alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(*on, F.col("keep.id").alias("keep_id"), F.col("keep.text").alias("keep_text"))
    )
    members = keyed.join(groups, on).where("id <> keep_id")
    checked = cut(
        members.withColumn("same", _same("keep_text", "text"))
        .select("src_table", "scope", "keep_id", F.col("id").alias("copy_id"), "same", F.when(~F.col("same"), F.col("text")).alias("text"))
    )
    found = checked.where("same").select("src_table", "keep_id", "copy_id")
    other = checked.where("not same").select("src_table", "scope", F.col("copy_id").alias("id"), "text")
    if not other.isEmpty():  # each round settles at least the smallest id of every key, so this ends
        found = found.unionByName(find_copies(other, seed + 1))
    return found.select("src_table", "keep_id", "copy_id")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two tables of the problem in one shape."""
    one = lambda t, scope, key: table(spark, sf_dir, t).select(
        F.lit(t).alias("src_table"), F.col(scope).alias("scope"), F.col(key).alias("id"), F.col("text")
    )
    return one("dxf_records", "file_id", "rec_id").unionByName(one("translated_sample", "export_id", "row_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(p2_records(spark, sf_dir))


def collapse(records: DataFrame) -> DataFrame:
    """One row per distinct record: (src_table, keep_id, n_copies), n_copies counts the kept one too.

    Rows that are no case (null, empty or without letter or digit) stay as records of their own.
    """
    copies = find_copies(records)
    per_keep = copies.groupBy("src_table", "keep_id").agg(F.count(F.lit(1)).alias("more"))
    kept = records.select("src_table", F.col("id").alias("keep_id")).join(
        copies.select("src_table", F.col("copy_id").alias("keep_id")), ["src_table", "keep_id"], "left_anti"
    )
    return kept.join(per_keep, ["src_table", "keep_id"], "left").select(
        "src_table", "keep_id", (F.lit(1) + F.coalesce("more", F.lit(0))).alias("n_copies")
    )


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(p2_records(spark, sf_dir))


_MARK = "chr(57344)"
_CANON = f"""list_sort(list_filter(list_transform(regexp_split_to_array(
  regexp_replace(regexp_replace(replace(lower(text), 'µ', 'μ'), '(\\p{{Nd}})([^\\p{{L}}\\p{{N}};；|])(\\p{{Nd}})', '\\1' || {_MARK} || '\\2\\3', 'g'), '(\\p{{Nd}})([^\\p{{L}}\\p{{N}};；|' || {_MARK} || '])(\\p{{Nd}})', '\\1' || {_MARK} || '\\2\\3', 'g'),
  '[;；|]'), lambda f: regexp_replace(f, '(' || {_MARK} || '.)|[^\\p{{L}}\\p{{N}}]', '\\1', 'gs')), lambda f: f <> ''))"""
_GROUPS = f"""WITH r AS (SELECT 'dxf_records' AS src_table, file_id AS scope, rec_id AS id, text FROM dxf_records UNION ALL SELECT 'translated_sample', export_id, row_id, text FROM translated_sample),
 c AS (SELECT src_table, scope, id, {_CANON} AS k FROM r WHERE regexp_matches(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]')), g AS (SELECT src_table, id, min(id) OVER (PARTITION BY src_table, scope, k) AS keep_id FROM c)"""
ORACLE = {
    "p2_found": f"{_GROUPS} SELECT src_table, keep_id, id AS copy_id FROM g WHERE id <> keep_id",
    "p2_collapsed": f"""{_GROUPS} SELECT src_table, keep_id, count(*) AS n_copies FROM g GROUP BY 1, 2
        UNION ALL SELECT src_table, id, 1 FROM r WHERE NOT regexp_matches(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]')""",
}
