"""Problem 3: values that were decoded with the wrong character encoding.

A screen over flat code-point arrays (character classes and a Russian letter trigram model counted over
all rows) leaves the few suspicious values. Each of their fields is then repaired by a best-first search:
a state is a string, a move re-encodes it with one charset and decodes the bytes with another, or
unescapes entities; visited strings are known by hash, and a character-plausibility cost in nats orders
the queue. The cheapest string reached wins if it is cheaper by a margin.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.codepoints import flatten, sums
from loomtext.plans.runtime import table

#: Charsets a text may have been read in, and charsets its bytes may really be in.
READ_AS = ("latin-1", "cp1252", "cp1251", "koi8-r", "cp866", "gb18030")
REALLY = ("utf-8", "cp1251", "gbk", "koi8-r", "cp866")
MAX_DEPTH, MAX_STATES = 3, 120
#: By how much a move may make a state dearer: a share and a constant in nats. A dearer state can lead to the cheapest text.
RISE_SHARE, RISE = 0.25, 8.0
#: Nats a repair must save: a constant and a share of the old cost.
MARGIN, SHARE = 4.0, 0.25
#: The same within a value of which another field has been repaired.
NEAR_MARGIN, NEAR_SHARE = 2.0, 0.12
#: Share of the first cost at which a state without odd characters ends the search.
GOAL = 0.6
#: The screen lets pass what costs less per Russian letter, in the mean and for a single one.
MEAN, STEEP = 3.2, 9.0

RU = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
A = len(RU) + 1  # 0 is "no letter"
HAN_FROM, HAN_TO = 0x3400, 0xA000
CELLS = A**3 + HAN_TO - HAN_FROM
#: Signs of technical text that are plain content; fixed values.
PLAIN_SIGNS = "°±×µμΜ²³℃≤≥№«»—–…“”‘’„·Øø⌀≈√√Ω€−‰ 　  ​"
CJK_MARKS = "，。；：、（）《》！？【】「」『』〈〉％＋－＝／＃＊～￥"

NEUTRAL, LATIN, RU_LOW, RU_UP, HAN1, HAN2, HAN3, ACCENT, BAD, SIGN, QUESTION = range(11)
CLASS_COST = {NEUTRAL: 1.2, LATIN: 1.6, HAN1: 8.0, HAN2: 10.0, HAN3: 12.0, ACCENT: 8.0, BAD: 11.0, SIGN: 3.0, QUESTION: 1.2}
FFFD_COST = 12.0


@lru_cache(1)
def classes() -> np.ndarray:
    """Character class by code point (from the charset tables themselves)."""
    t = np.full(0x110000, BAD, dtype=np.uint8)
    t[:0x80] = NEUTRAL
    t[0:9] = t[14:32] = t[0x7F] = BAD
    for c in range(26):
        t[65 + c] = t[97 + c] = LATIN
    t[ord("?")] = QUESTION
    for cp in [*range(0xC0, 0x250)]:
        t[cp] = ACCENT if chr(cp).isalpha() else BAD
    for c in RU:
        t[ord(c)], t[ord(c.upper())] = RU_LOW, RU_UP
    t[0x3400:0xA000] = HAN3
    t[0x20000:0x32000] = HAN2  # no wrong reading by a charset of READ_AS leads here
    for hi in range(0xB0, 0xF8):
        for lo in range(0xA1, 0xFF):
            try:
                t[ord(bytes((hi, lo)).decode("gb2312"))] = HAN1 if hi < 0xD8 else HAN2
            except UnicodeDecodeError:
                pass
    for c in PLAIN_SIGNS + CJK_MARKS:
        t[ord(c)] = SIGN
    t[0x3000:0x3004] = t[0x3008:0x3021] = SIGN
    t[0xFF01:0xFF5F] = SIGN
    t[0x2000:0x2070] = SIGN
    t[0x2F00:0x2FD6] = HAN1  # look-alike radicals and compatibility ideographs: another problem's
    t[0xF900:0xFB00] = HAN1
    t[0x300:0x370] = SIGN
    t[0x2070:0x20A0] = t[0x2150:0x2200] = SIGN
    for c in "∅∆∑−√∞≈≠≤≥⌀":
        t[ord(c)] = SIGN
    for c in "†‡•™‹›‚ƒˆ˜†€‰":
        t[ord(c)] = BAD
    t[ord("€")] = t[ord("‰")] = BAD
    return t


@lru_cache(1)
def ru_codes() -> np.ndarray:
    t = np.zeros(0x110000, dtype=np.int32)
    for i, c in enumerate(RU):
        t[ord(c)] = t[ord(c.upper())] = i + 1
    return t


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of Russian letter trigrams (a word begins and ends with letter 0), then of ideographs: CELLS numbers."""
    flat, offsets = flatten(texts)
    han = flat[(flat >= HAN_FROM) & (flat < HAN_TO)].astype(np.int64) - HAN_FROM
    c = ru_codes()[flat] if len(flat) else np.zeros(0, np.int32)
    # a break between rows keeps words apart
    c = np.insert(c, offsets[1:-1], 0) if len(offsets) > 2 else c
    c = np.concatenate(([0, 0], c, [0]))
    at = np.flatnonzero((c[2:] > 0) | (c[1:-1] > 0))
    a, b, d = c[at], c[at + 1], c[at + 2]
    a = np.where(b == 0, 0, a)
    return np.concatenate((np.bincount((a * A + b) * A + d, minlength=A**3), np.bincount(han, minlength=HAN_TO - HAN_FROM)))


def log_model(counts: np.ndarray) -> np.ndarray:
    """Costs in nats: a third letter after two, interpolated with bigrams and unigrams; an ideograph by frequency."""
    n3 = counts[: A**3].reshape(A, A, A).astype(float)
    han = counts[A**3 :].astype(float)
    han_cost = np.clip(-np.log((han + 0.2) / (han.sum() + 0.2 * 7000)), 4.0, 12.0)
    n2 = n3.sum(axis=0)
    n1 = n2.sum(axis=0)
    p1 = (n1 + 0.5) / (n1.sum() + 0.5 * A)
    p2 = (n2 + 20 * p1) / (n2.sum(axis=1, keepdims=True) + 20)
    p3 = (n3 + 5 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 5)
    return np.concatenate((np.minimum(-np.log(p3), 14.0).reshape(-1), han_cost))


def fit_model(texts: DataFrame) -> np.ndarray:
    """The trigram model over every row of texts(text); CELLS numbers at most reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, dtype=np.int64)
        for pdf in batches:
            total += trigram_counts(pdf["text"].tolist())
        cell = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cell, "n": total[cell]})

    counts = np.zeros(CELLS)
    for r in texts.select("text").mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    return log_model(counts)


def screen(texts: list[str | None], model: np.ndarray) -> np.ndarray:
    """True for rows that may be affected; rows of plain content pass at array speed."""
    flat, offsets = flatten(texts)
    if not len(flat):
        return np.zeros(len(texts), dtype=bool)
    k = classes()[flat]
    count = lambda mask: sums(mask.astype(np.int64), offsets)
    c = ru_codes()[flat]
    first = np.zeros(len(flat), dtype=bool)
    first[offsets[:-1][offsets[:-1] < len(flat)]] = True
    accent = k == ACCENT
    odd = (k == BAD) | (k == HAN3) | (k == QUESTION) | (accent & np.concatenate(([False], accent[:-1])) & ~first)
    accents, han2 = count(accent), count(k == HAN2)
    row_odd = (count(odd) > 0) | (accents * 3 > count(k == LATIN) + accents) | (han2 * 4 > han2 + count(k == HAN1))
    p1 = np.where(first, 0, np.concatenate(([0], c[:-1])))
    p2 = np.where(first | np.concatenate(([True], first[:-1])), 0, np.concatenate(([0, 0], c[:-2]))[: len(c)])
    p2 = np.where(p1 == 0, 0, p2)
    letter = c > 0
    cost = np.where(letter, model[(p2 * A + p1) * A + c], 0.0)
    # a lower-case letter followed by a capital inside a word
    up = k == RU_UP
    clash = up & (np.concatenate(([0], k[:-1])) == RU_LOW) & ~first
    n = count(letter)
    mean = sums(cost, offsets) / np.maximum(n, 1)
    # escapes of any kind need their own sign
    sign = (flat == ord("&")) | (flat == ord("\\")) | (flat == ord("%"))
    for i in np.flatnonzero((count(sign) > 0) & ~row_odd):
        row_odd[i] = ESCAPED.search(texts[i]) is not None
    return row_odd | (count(clash) > 0) | ((n > 0) & ((mean > MEAN) | (count(cost > STEEP) > 0)))


#: Text written out in escapes: entities, code units after \u, bytes after %. CAD's own codes differ (\U+2205, %%c).
ESCAPED = re.compile(r"(?:&#(?:\d{2,7}|[xX][0-9a-fA-F]{2,6});\s*){2}|&(?:[lg]t|amp|quot|nbsp|apos);|(?:\\u[0-9a-fA-F]{4}\s*){2}|(?:%[0-9A-F]{2}){3}")
LATIN_WORD = re.compile(r"[A-Za-zÀ-ɏ]+")
WORDLIKE = re.compile(r"[^\W\d_]+")


def decode(raw: bytes, really: str, read_as: str) -> str | None:
    """raw in charset really; bytes that aren't valid there stay what they were. None if that is over a third."""
    try:
        return raw.decode(really)
    except UnicodeDecodeError:
        pass
    if read_as == "gb18030" and really != "utf-8":
        return None
    out, at, kept = [], 0, 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode(really))
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode(really))
            step = max(1, e.end - e.start) if read_as == "gb18030" else 1
            out.append(raw[at + e.start : at + e.start + step].decode(read_as if read_as != "cp1252" else "latin-1", "replace"))
            kept += step
            if kept * 3 > len(raw):
                return None
            at += e.start + step
    return "".join(out)


class Repairer:
    """The search, with the model and a cache of repaired fields."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.kind = classes().tobytes()
        self.codes = {c: i + 1 for i, c in enumerate(RU)} | {c.upper(): i + 1 for i, c in enumerate(RU)}
        self.flat: dict[str, float] = {}
        self.cache: dict[str, tuple[str, float, float, bool]] = {}

    def char_cost(self, ch: str) -> float:
        """Cost of a character other than a Russian letter."""
        cp = ord(ch)
        if HAN_FROM <= cp < HAN_TO:
            c = self.model[A**3 + cp - HAN_FROM]
        else:
            c = FFFD_COST if cp == 0xFFFD else CLASS_COST[self.kind[cp]]
        self.flat[ch] = c
        return c

    def cost(self, s: str) -> float:
        total, a, b, low = 0.0, 0, 0, False
        model, codes, flat = self.model, self.codes, self.flat
        for ch in s:
            c = codes.get(ch)
            if c is not None:
                total += model[(a * A + b) * A + c]
                small = ch > "Я" and ch != "Ё"
                if low and not small:
                    total += 5.0
                a, b, low = b, c, small
                continue
            if b:
                total += model[(a * A + b) * A] * 0.5
                a = b = 0
                low = False
            x = flat.get(ch)
            total += self.char_cost(ch) if x is None else x
        if b:
            total += model[(a * A + b) * A] * 0.5
        # accents are plain within a word of otherwise unaccented Latin letters
        if any(self.kind[ord(ch)] == ACCENT for ch in s if ch > "\x7f"):
            for m in LATIN_WORD.finditer(s):
                w = m.group()
                if w.isascii():
                    continue
                marks = sum(1 for ch in w if ch > "\x7f")
                if (marks * 3 <= len(w) or w in ("ø", "Ø")) and not any("à" <= x.lower() <= "ÿ" and "à" <= y.lower() <= "ÿ" for x, y in zip(w, w[1:])):
                    total -= marks * (CLASS_COST[ACCENT] - 2.0)
        return total

    def moves(self, s: str) -> Iterator[tuple[str, str]]:
        top = {self.kind[ord(c)] for c in s}
        if "&" in s and (t := html.unescape(s)) != s:
            yield "html", t
        if re.search(r"(?:\\u[0-9a-fA-F]{4}){2}|(?:%[0-9A-F]{2}){3}", s):
            t = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s)
            t = re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), t)
            yield "escape", t
        for w in READ_AS:
            if w == "gb18030" and not top & {HAN1, HAN2, HAN3, BAD}:
                continue
            if w in ("latin-1", "cp1252") and not top & {ACCENT, BAD, SIGN}:
                continue
            parts = self.encoded(s, w)
            if parts is None:
                continue
            for r in REALLY:
                if r == w or (w == "gb18030" and r in ("gbk", "cp866")):
                    continue
                if w != "gb18030" and w != "latin-1" and w != "cp1252" and r == "cp866" and w == "cp866":
                    continue
                out, good = [], False
                for raw, plain in parts:
                    if raw is None:
                        out.append(plain)
                        continue
                    t = decode(raw, r, w)
                    if t is None:
                        good = False
                        break
                    good = True
                    out.append(t)
                if good and (t := "".join(out)) != s:
                    yield f"{w}>{r}", t

    @staticmethod
    def encoded(s: str, w: str) -> list[tuple[bytes | None, str]] | None:
        """s as runs of bytes in charset w, broken by characters that w doesn't have."""
        if "\ufffd" not in s:  # a lost character has no bytes, though gb18030 would give it some
            try:
                raw = s.encode(w)
                return [(raw, s)] if not raw.isascii() else None
            except UnicodeEncodeError:
                pass
        parts: list[tuple[bytes | None, str]] = []
        run = bytearray()
        for ch in s:
            try:
                run += ch.encode(w if ch != "\ufffd" else "ascii")
            except UnicodeEncodeError:
                if w == "cp1252" and ord(ch) in (0x81, 0x8D, 0x8F, 0x90, 0x9D):
                    run.append(ord(ch))
                    continue
                if w == "cp1251" and ord(ch) == 0x98:
                    run.append(0x98)
                    continue
                if run:
                    parts.append((bytes(run), ""))
                    run = bytearray()
                parts.append((None, ch))
        if run:
            parts.append((bytes(run), ""))
        parts = [(p if p is None or not p.isascii() else None, q if p is None or not p.isascii() else p.decode("ascii")) for p, q in parts]
        return parts if any(p is not None for p, _ in parts) else None

    def field(self, s: str) -> tuple[str, float, float, bool]:
        """(best text, its cost, cost of s, whether s is damaged beyond its own characters)."""
        if (hit := self.cache.get(s)) is not None:
            return hit
        start = self.cost(s)
        best, best_cost = s, start
        seen = {hash(s)}
        queue = [(start, 0, s)]
        states = 0
        while queue and states < MAX_STATES:
            c, depth, t = heapq.heappop(queue)
            states += 1
            if c < best_cost:
                best, best_cost = t, c
            goal = depth and c <= GOAL * start and not any(self.kind[ord(ch)] in (BAD, ACCENT, HAN3) for ch in t if ch > "\x7f")
            if depth == MAX_DEPTH:
                if goal:
                    break
                continue
            least = c
            for _, u in self.moves(t):
                if (h := hash(u)) not in seen:
                    seen.add(h)
                    cu = self.cost(u)
                    if cu < (1 + RISE_SHARE) * c + RISE:
                        heapq.heappush(queue, (cu, depth + 1, u))
                        least = min(least, cu)
            if goal and least == c:
                break  # plain text, and none of its own moves is cheaper
        lost = "�" in s or any("\x80" <= ch <= "\x9f" for ch in s)
        if len(self.cache) > 50_000:
            self.cache.clear()
        self.cache[s] = (best, best_cost, start, lost)
        return self.cache[s]

    def value(self, s: str) -> tuple[bool, str | None]:
        """Whether s is affected, and its repaired text (null if something of it is lost)."""
        pieces = [s] if ESCAPED.search(s) else re.split(r"(;)", s)  # an entity ends in the mark between fields
        done = [(p, 0.0, 0.0, False) if p.isascii() and not ESCAPED.search(p) else self.field(p) for p in pieces]
        hit = any(self.better(p, d) for p, d in zip(pieces, done))
        if hit:
            out = [d[0] if self.better(p, d, NEAR_MARGIN, NEAR_SHARE) else p for p, d in zip(pieces, done)]
        else:
            out = pieces
            if len(pieces) > 1 and not s.isascii() and self.better(s, d := self.field(s)):
                hit, out = True, [d[0]]  # a ; may itself stem from the wrong decoding
        text = "".join(out)
        lost = lossy_question(s) or "�" in text or any("\x80" <= ch <= "\x9f" for ch in text)
        return hit or lost, None if lost else text

    @staticmethod
    def better(s: str, found: tuple[str, float, float, bool], margin: float = MARGIN, share: float = SHARE) -> bool:
        """Whether the search result saves enough of what s costs beyond its ASCII characters."""
        best, cost, start, _ = found
        if best == s:
            return False
        plain = sum(1.4 for ch in s if ch < "\x80")
        return start - cost > margin + share * max(0.0, start - plain)


#: A question mark that stands for a lost character: inside or before a word, doubled, or after a blank.
LOSSY = re.compile(r"\?\?|\w\?\w|(?<![^\s({\[;:,.-])\?|[^\W\d_]\?\d")


def lossy_question(s: str) -> bool:
    return "?" in s and LOSSY.search(s) is not None


def find_misread(values: DataFrame, model: np.ndarray) -> DataFrame:
    """Affected values of values(id bigint, field_name string, text string), with the text restored.

    restored is null where the original can't be recovered in full. Null and empty texts and correct ones
    give no row. A map over the rows: the model (CELLS numbers) goes along with the task, nothing shuffles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(model)
        for pdf in batches:
            texts = pdf["text"].tolist()
            flag = screen(texts, model)
            at, restored = [], []
            for i in np.flatnonzero(flag):
                hit, fixed = repairer.value(texts[i])
                if hit:
                    at.append(i)
                    restored.append(fixed)
            out = pdf.iloc[at]
            yield out.assign(restored=pd.Series(restored, index=out.index, dtype=object))

    rows = values.where(F.col("text").isNotNull() & (F.length("text") > 0)).select(F.col("id").cast("bigint").alias("id"), "field_name", "text")
    return rows.mapInPandas(run, "id bigint, field_name string, text string, restored string")


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = table(spark, sf_dir, "dxf_records")
    return rec.select(F.col("rec_id").alias("id"), F.explode(F.array(
        F.struct(F.lit("text").alias("field_name"), F.col("text")), F.struct(F.lit("raw_text").alias("field_name"), F.col("raw_text").alias("text"))
    )).alias("v")).select("id", "v.field_name", "v.text")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected values with their restored text."""
    model = fit_model(table(spark, sf_dir, "dxf_records").select("text"))
    return find_misread(p3_values(spark, sf_dir), model).withColumnRenamed("id", "rec_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_restored(spark, sf_dir).select("rec_id", "field_name")
