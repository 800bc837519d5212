"""Problem 6: one consistent form for texts that look the same but differ in their characters.

A quick-check table says of every code point whether it is always stable under the wanted form. Over the
flat code points of a batch it isolates the few unstable positions; each is widened to a segment that
begins at a starter and ends before the next one (normalisation never crosses such a boundary), the segment
alone is normalised, and the result is spliced between the unchanged parts. Words that mix Latin, Cyrillic
and Greek letters are found by run sums over the same arrays and brought to one script.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.codepoints import flatten, sums
from loomtext.plans.runtime import table

#: Letters of the same look: Latin, Cyrillic, Greek (fixed values; a dot where there is none).
TRIPLES = """
    aа. cс. eе. oоο pрρ xхχ yу. iіι jј. sѕ. kкκ vѵν hһ. dԁ. qԛ. wԝ.
    AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙ JЈ. KКΚ MМΜ NԊΝ OОΟ PРΡ SЅ. TТΤ XХΧ YҮΥ ZꓜΖ .ГΓ .ПΠ .ФΦ
"""
#: Radicals without a decomposition and the ideographs they look like (fixed values).
RADICALS = dict(zip("⺠⻁⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰", "民虎西见角贝车长门青韦页风飞食马骨鬼鱼鸟麦黄齐齿龙"))
LATIN, CYRILLIC, GREEK = 1, 2, 3
#: Letters that may join the letter before them though they are no marks: medial and final Hangul (fixed values).
JOINING = ((0x1161, 0x1176), (0x11A8, 0x11C3))


@lru_cache(1)
def scripts() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Look-alike letter to its Latin, Cyrillic and Greek form."""
    to: tuple[dict[str, str], ...] = ({}, {}, {})
    for t in TRIPLES.split():
        for k, target in enumerate(t):
            if target != "." and not (k == 1 and not "А" <= target <= "я"):  # rare Cyrillic letters are stand-ins, never the norm
                for ch in t:
                    if ch not in (".", target):
                        to[k][ch] = target
    to[1]["Y"] = "У"
    to[0]["У"] = "Y"
    return to


@lru_cache(1)
def direct() -> dict[int, str]:
    """Code points with a fixed replacement that needs no context; empty for invisible ones."""
    out: dict[int, str] = {}
    for cp in range(0x80, 0x2FA20):
        if 0xD800 <= cp < 0xE000 or 0xFB00 <= cp < 0xFE00 or 0x30000 > cp > 0x2FA1D:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Zs", "Zl", "Zp"):
            out[cp] = " "
        elif kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180E):
            out[cp] = ""
        elif 0xFF10 <= cp <= 0xFF5A and ch.isalnum():
            out[cp] = chr(cp - 0xFEE0)
        elif 0x2F00 <= cp <= 0x2FDF or 0x2E80 <= cp <= 0x2EFF or 0xF900 <= cp <= 0xFAFF or cp >= 0x2F800:
            form = RADICALS.get(ch) or unicodedata.normalize("NFKC", ch)
            if form != ch:
                out[cp] = form
    out |= {cp: "" for cp in range(0xE0100, 0xE01F0)} | {cp: "" for cp in (0xE0001, *range(0xE0020, 0xE0080))}
    return out


@lru_cache(1)
def quick_check() -> tuple[np.ndarray, np.ndarray]:
    """(unstable by code point, script of look-alike analysis: 4 * look-alike + script)."""
    unstable = np.zeros(0x110000, dtype=bool)
    for cp in direct():
        unstable[cp] = True
    for cp in range(0x80, 0x30000):
        if not 0xD800 <= cp < 0xE000:
            ch = chr(cp)
            if unicodedata.category(ch) in ("Mn", "Mc", "Me") or unicodedata.normalize("NFC", ch) != ch:
                unstable[cp] = True
    unstable[0x1D165:0x1D1F0] = True
    for a, b in JOINING:
        unstable[a:b] = True
    script = np.zeros(0x110000, dtype=np.uint8)
    to_latin, to_cyrillic, to_greek = scripts()
    for lo, hi, s in ((0x41, 0x250, LATIN), (0x370, 0x400, GREEK), (0x400, 0x530, CYRILLIC)):
        for cp in range(lo, hi):
            if chr(cp).isalpha() and cp not in (0xAA, 0xB5, 0xBA):
                script[cp] = s
    for ch in set(to_latin) | set(to_cyrillic) | set(to_greek):
        script[ord(ch)] |= 4
    return unstable, script


def _starter(ch: str) -> bool:
    return unicodedata.combining(ch) == 0 and unicodedata.category(ch) not in ("Mn", "Mc", "Me") and not any(a <= ord(ch) < b for a, b in JOINING)


def normal_segment(s: str) -> str:
    table_ = direct()
    return unicodedata.normalize("NFC", s.translate(table_))


def splice(text: str, unstable: list[int]) -> str:
    """text with the segments around its unstable positions normalised."""
    out, at, n, i = [], 0, len(text), 0
    skip = direct()
    while i < len(unstable):
        p = unstable[i]
        begin = p
        # back to a starter that stays: marks and what vanishes may join what stands before
        while begin > at and (not _starter(text[begin]) or skip.get(ord(text[begin])) == ""):
            begin -= 1
        end = p + 1
        while end < n and (not _starter(text[end]) or skip.get(ord(text[end])) == "" or (i + 1 < len(unstable) and unstable[i + 1] == end)):
            end += 1
        while i < len(unstable) and unstable[i] < end:
            i += 1
        out.append(text[at:begin])
        out.append(normal_segment(text[begin:end]))
        at = end
    out.append(text[at:])
    return "".join(out)


def _letter_runs(text: str) -> Iterator[tuple[int, int]]:
    at = -1
    for i, ch in enumerate(text):
        if ch.isalpha() and ord(ch) < 0x3000 and ord(ch) not in (0xAA, 0xB5, 0xBA):
            if at < 0:
                at = i
        elif at >= 0:
            yield at, i
            at = -1
    if at >= 0:
        yield at, len(text)


def one_script(text: str) -> str:
    """text with each letter that stands in for a look-alike of another script replaced.

    A word of several scripts goes to the one whose letters can't all be stand-ins, else to the majority
    (Latin beside ideographs, Cyrillic on a tie). Cyrillic or Greek look-alikes in a text without any other letter of their script go
    to Latin, Cyrillic ones if they touch a digit or an ideograph; a lone small Latin look-alike between two Cyrillic words goes to Cyrillic.
    """
    _, script = quick_check()
    to = scripts()
    runs = list(_letter_runs(text))
    own = {s: any(script[ord(ch)] == s for a, b in runs for ch in text[a:b]) for s in (LATIN, CYRILLIC, GREEK)}
    out = list(text)
    for k, (a, b) in enumerate(runs):
        word = text[a:b]
        kinds = [int(script[ord(ch)]) for ch in word]
        present = {s & 3 for s in kinds if s & 3}
        target = None
        if len(present) > 1:
            firm = {s for s in present if any(x == s for x in kinds)}
            if len(firm) == 1:
                target = next(iter(firm))
            elif not firm:
                n = {s: sum(x & 3 == s for x in kinds) for s in present}
                firm_text = [s for s in (CYRILLIC, LATIN, GREEK) if s in present and own[s]]
                plain = LATIN if any(ch >= "㐀" for ch in text) else CYRILLIC
                target = max(n, key=lambda s: (s in firm_text, s == LATIN == plain, n[s], s == plain))
        elif present == {CYRILLIC} and not own[CYRILLIC] and all(x & 4 for x in kinds):
            near = text[a - 1 : a] + text[b : b + 1]
            if any(c.isdigit() or c >= "㐀" for c in near):  # part of a code, not an abbreviation
                target = LATIN
        elif present == {GREEK} and not own[GREEK] and all(x & 4 for x in kinds) and own[LATIN]:
            target = LATIN
        elif len(word) == 1 and word in "aceopy" and 0 < k < len(runs) - 1:
            before, after = runs[k - 1], runs[k + 1]
            near = text[before[1] : a].isspace() and text[b : after[0]].isspace()
            cyr = all(int(script[ord(ch)]) & 3 == CYRILLIC for r in (before, after) for ch in text[r[0] : r[1]])
            target = CYRILLIC if near and cyr else None
        if target:
            table_ = to[target - 1]
            for i in range(a, b):
                out[i] = table_.get(out[i], out[i]) if script[ord(out[i])] & 3 != target else out[i]
    return "".join(out)


def suspects(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: has it unstable characters, may its words mix scripts; and all unstable positions with the offsets."""
    unstable, script = quick_check()
    flat, offsets = flatten(texts)
    n = len(texts)
    if not len(flat):
        return np.zeros(n, bool), np.zeros(n, bool), np.zeros(0, np.int64), offsets
    u = unstable[flat]
    s = script[flat]
    kind = s & 3
    first = np.zeros(len(flat), dtype=bool)
    first[offsets[:-1][offsets[:-1] < len(flat)]] = True
    # neighbours of different scripts, letters of a script that are all look-alikes, lone small letters
    mixed = (kind[1:] > 0) & (kind[:-1] > 0) & (kind[1:] != kind[:-1]) & ~first[1:]
    mixed = np.concatenate(([False], mixed))
    letters = lambda k: sums((kind == k).astype(np.int64), offsets)
    firm = lambda k: sums((s == k).astype(np.int64), offsets)
    standing = ((letters(CYRILLIC) > 0) & (firm(CYRILLIC) == 0)) | ((letters(GREEK) > 0) & (firm(GREEK) == 0))
    edge = np.concatenate(([0], kind[:-1])) == 0
    edge |= first
    after = np.concatenate((kind[1:] == 0, [True]))
    lone = (kind == LATIN) & (s >= 4) & edge & after & (flat >= 97)
    return sums(u.astype(np.int64), offsets) > 0, (sums(mixed.astype(np.int64), offsets) > 0) | standing | (sums(lone.astype(np.int64), offsets) > 0), np.flatnonzero(u), offsets


def canonical_batch(texts: list[str | None]) -> list[str | None]:
    """The consistent form of every text; null stays null."""
    has, mixed, at, offsets = suspects(texts)
    out = list(texts)
    for i in np.flatnonzero(has | mixed):
        text = texts[i]
        if has[i]:
            lo, hi = np.searchsorted(at, (offsets[i], offsets[i + 1]))
            text = splice(text, (at[lo:hi] - offsets[i]).tolist())
        out[i] = one_script(text)
    return out


def canonical_whole(text: str) -> str:
    """The same form made from the whole text at once, for tests."""
    return one_script(normal_segment(text))


def normalise(values: DataFrame) -> DataFrame:
    """values(src_table, row_key, text) with canonical, the consistent form, and changed.

    Null texts keep a null form and count as unchanged, as empty ones do. Repeated rows give repeated
    results. A map over the rows; nothing shuffles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            form = canonical_batch(texts)
            yield pdf.assign(canonical=pd.Series(form, dtype=object, index=pdf.index), changed=[a != b for a, b in zip(texts, form)])

    rows = values.select("src_table", F.col("row_key").cast("bigint").alias("row_key"), "text")
    return rows.mapInPandas(run, "src_table string, row_key bigint, text string, canonical string, changed boolean")


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "approved_terms").select(F.lit("approved_terms").alias("src_table"), F.col("term_id").alias("row_key"), F.col("cn").alias("text"))
    blocks = table(spark, sf_dir, "pdf_blocks").select(F.lit("pdf_blocks").alias("src_table"), F.col("block_id").alias("row_key"), "text")
    return terms.unionByName(blocks)


def p6_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value in its consistent form."""
    return normalise(p6_values(spark, sf_dir)).select("src_table", "row_key", "canonical", "changed")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(p6_values(spark, sf_dir)).where("changed").select("src_table", "row_key")


def p6_equal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of glossary terms that are equal once in the consistent form: (canonical, first_id, n_terms, n_forms)."""
    terms = table(spark, sf_dir, "approved_terms").select(F.lit("approved_terms").alias("src_table"), F.col("term_id").alias("row_key"), F.col("cn").alias("text"))
    form = normalise(terms).where("canonical is not null")
    return form.groupBy("canonical").agg(
        F.min("row_key").alias("first_id"), F.count(F.lit(1)).alias("n_terms"), F.countDistinct("text").alias("n_forms")
    ).where("n_terms > 1")
