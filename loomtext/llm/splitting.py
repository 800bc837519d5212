"""Problem 7: cut items over a size limit at natural boundaries, with overlap.

A text is first broken at the coarsest separator of a hierarchy (section, paragraph, sentence, word,
character); only parts that are still too long are broken by the next one. The atoms are packed
greedily, and each piece begins with the trailing atoms of its predecessor, up to the overlap.
Pieces are ranges of the source text: cutting the overlap off and joining the rest gives the source
back, character by character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.plans.runtime import table

#: A translation request may hold so many code points (fixed by the problem statement).
LIMIT = 1400
OVERLAP = 120
#: Separator hierarchy; a match's end is a boundary, so every separator stays with the text before it.
LEVELS = [
    ("section", re.compile(r"\n[ \t]*\n\s*|\n(?=[ \t]*(?:#{1,6} |\d+(?:\.\d+)*[.)] ))")),
    ("paragraph", re.compile(r"\n+")),
    ("sentence", re.compile(r"[。！？；]+[」』”’»）)]*\s*|(?<![ \n(«]\w)[.!?…;]+[\"”’»)]*\s+")),
    ("word", re.compile(r"[，、：]|\s+|(?<=[一-鿿])(?=[^\W\d_a-zA-Zа-яА-ЯёЁ])")),
]


def atoms(text: str, start: int, end: int, room: int, level: int = 0) -> Iterator[tuple[int, int, str]]:
    """Ranges of text[start:end], none longer than room, with the kind of boundary each ends at."""
    if level == len(LEVELS):
        for at in range(start, end, room):
            yield at, min(at + room, end), "character"
        return
    kind, pattern = LEVELS[level]
    at = start
    for m in pattern.finditer(text, start, end):
        stop = m.end()
        if stop <= at or stop >= end:
            continue
        yield from _fit(text, at, stop, room, level, kind)
        at = stop
    yield from _fit(text, at, end, room, level, kind)


def _fit(text: str, at: int, stop: int, room: int, level: int, kind: str) -> Iterator[tuple[int, int, str]]:
    if stop - at <= room:
        yield at, stop, kind
        return
    last = None
    for part in atoms(text, at, stop, room, level + 1):
        if last:
            yield last
        last = part
    if last:
        yield last[0], last[1], kind if last[1] == stop and kind != "character" else last[2]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """Pieces (start, end, length of overlap at the start, boundary at the end) of at most limit code points.

    A text within the limit is one piece. The overlap is made of whole atoms where one fits into it;
    otherwise it is exactly overlap characters, moved back to the nearest word boundary if there is one.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    n = len(text)
    if n <= limit:
        return [(0, n, 0, "end")]
    parts = list(atoms(text, 0, n, limit - overlap))
    pieces: list[tuple[int, int, int, str]] = []
    begin, carry = 0, 0  # begin: first new character; carry: overlap before it
    end, kind = 0, "end"
    tail: list[int] = []  # starts of the atoms in the current piece
    for a, b, k in parts:
        if b - begin + carry > limit and end > begin:
            pieces.append((begin - carry, end, carry, kind))
            begin = end
            carry = _carry(text, tail, end, overlap)
            tail = []
        tail.append(a)
        end, kind = b, k
    pieces.append((begin - carry, n, carry, "end"))
    return pieces


def _carry(text: str, starts: list[int], end: int, overlap: int) -> int:
    best = 0
    for a in reversed(starts):
        if end - a > overlap:
            break
        best = end - a
    if best or not overlap:
        return best
    at = end - overlap
    for i in range(at, end):
        if text[i - 1 : i].isspace() and not text[i].isspace():
            return end - i
    return overlap


PIECE_SCHEMA = (
    "src_table string, row_key bigint, piece_no int, n_pieces int, start_at int, end_at int, overlap int, boundary string, piece string"
)


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for src, key, text in zip(pdf["src_table"], pdf["row_key"], pdf["text"]):
                cut = split_text(text, limit, overlap)
                out += [(src, key, i, len(cut), a, b, o, k, text[a:b]) for i, (a, b, o, k) in enumerate(cut)]
            yield pd.DataFrame(out, columns=["src_table", "row_key", "piece_no", "n_pieces", "start_at", "end_at", "overlap", "boundary", "piece"])

    return run


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the items(src_table string, row_key bigint, text string) that exceed limit code points.

    Null and empty texts and texts within the limit give no rows. Repeated rows give repeated pieces.
    The length test is a JVM filter before any text goes to Python; no shuffle takes place.
    """
    big = items.select("src_table", F.col("row_key").cast("bigint"), "text").where(F.length("text") > limit)
    return big.mapInPandas(_pieces(limit, overlap), PIECE_SCHEMA)


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, key: table(spark, sf_dir, t).select(F.lit(t).alias("src_table"), F.col(key).alias("row_key"), "text")
    return one("pdf_blocks", "block_id").unionByName(one("translated_sample", "row_id"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces, in order by piece_no."""
    return split_oversized(p7_items(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pieces(spark, sf_dir).where("piece_no = 0 and n_pieces > 1").select("src_table", "row_key")


ORACLE = {
    "p7_found": """
        SELECT 'pdf_blocks' AS src_table, block_id AS row_key FROM pdf_blocks WHERE length(text) > 1400
        UNION ALL SELECT 'translated_sample', row_id FROM translated_sample WHERE length(text) > 1400""",
}
