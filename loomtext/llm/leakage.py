"""Problem 9: evaluation passages that occur, in whole or in part, in corpus documents.

Documents are folded to their letters and digits and cut into shards. For each shard a suffix array is
built over every STRIDE-th position, sorted by the first DEPTH characters; every suffix of every passage
is looked up in it by binary search. A run that is long enough to count contains a sampled position whose
next DEPTH characters lie in the run, so no leak is missed. Each hit is then extended both ways to the
longest verbatim match. Passages too short for the stride get an array over all positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.codepoints import flatten
from loomtext.llm.copies import tables
from loomtext.plans.runtime import table

DEPTH, STRIDE = 24, 16
SHARD_CHARS = 12_000_000
#: A document is affected from this share of a passage's letters and digits in one run.
SHARE = 0.5
#: Passages that go along with a task; more of them are looked up in blocks, each in a pass over the documents.
BLOCK = 100_000


@lru_cache(1)
def fold16() -> np.ndarray:
    """Case-free letters and digits as 16-bit numbers, 0 for all else. Rare planes share numbers, which is why hits are compared by code point."""
    f = tables()[0].astype(np.int64)
    return np.where(f < 0x10000, f, 0xE000 + f % 0x1900).astype(np.uint16)


def prefixes(chars: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The depth characters from each position, as fixed-width byte strings in lexicographic order."""
    padded = np.concatenate((chars, np.zeros(depth, np.uint16)))
    wide = padded[at[:, None] + np.arange(depth)[None, :]].astype(">u2")
    return np.ascontiguousarray(wide).view(f"S{2 * depth}").reshape(-1)


class Passages:
    """Folded passages and their suffixes, split by whether a sparse suffix array can find them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.text, self.exact, self.need = [], [], [], []
        for item, passage in items:
            if passage is None:
                continue
            flat, _ = flatten([passage])
            c = fold16()[flat] if len(flat) else np.zeros(0, np.uint16)
            exact = tables()[0][flat[c > 0]] if len(flat) else flat
            c = c[c > 0]
            if len(c):
                self.ids.append(item)
                self.text.append(c)
                self.exact.append(exact)
                self.need.append(-(-len(c) // 2) if SHARE == 0.5 else int(np.ceil(len(c) * SHARE)))
        self.groups = []
        sparse = [k for k, n in enumerate(self.need) if n >= DEPTH + STRIDE - 1]
        dense = [k for k, n in enumerate(self.need) if n < DEPTH + STRIDE - 1]
        for members, stride in ((sparse, STRIDE), (dense, 1)):
            by_depth: dict[int, list[int]] = {}
            for k in members:
                by_depth.setdefault(min(DEPTH, self.need[k]), []).append(k)
            for depth, ks in sorted(by_depth.items()):
                keys, who, off = [], [], []
                for k in ks:
                    at = np.arange(max(1, len(self.text[k]) - depth + 1))
                    keys.append(prefixes(self.text[k], at, depth))
                    who.append(np.full(len(at), k))
                    off.append(at)
                self.groups.append((depth, stride, np.concatenate(keys), np.concatenate(who), np.concatenate(off)))


def run_length(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Length of the common run from a[i] and b[j] on."""
    n = min(len(a) - i, len(b) - j)
    differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
    return int(differ[0]) if len(differ) else n


def shard_leaks(texts: list[str], passages: Passages) -> list[tuple[int, int, int, int]]:
    """(number of the text, number of the passage, longest run, its start among the text's letters)."""
    flat, offsets = flatten(texts)
    if not len(flat):
        return []
    c = fold16()[flat]
    kept = c > 0
    ends = np.concatenate(([0], np.cumsum(kept)))[offsets]
    c, exact = c[kept], tables()[0][flat[kept]]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for depth, stride, keys, who, off in passages.groups:
        at = np.concatenate([np.arange(s, e - depth + 1, stride) for s, e in zip(ends[:-1], ends[1:]) if e - s >= depth] or [np.zeros(0, np.int64)])
        if not len(at):
            continue
        suffix = prefixes(c, at, depth)
        order = np.argsort(suffix, kind="stable")
        sorted_suffix = suffix[order]
        lo = np.searchsorted(sorted_suffix, keys, "left")
        hi = np.searchsorted(sorted_suffix, keys, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        n = (hi - lo)[hit]
        q = np.repeat(hit, n)
        p = at[order[np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
        doc = np.searchsorted(ends, p, "right") - 1
        diagonal = p - off[q]
        # one hit per run of hits on a diagonal is enough: the first, and one after every gap
        o = np.lexsort((p, diagonal, who[q], doc))
        p, q, doc, diagonal = p[o], q[o], doc[o], diagonal[o]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (who[q][1:] != who[q][:-1]) | (diagonal[1:] != diagonal[:-1]) | (p[1:] - p[:-1] > stride)
        for k in np.flatnonzero(new):
            d, w = int(doc[k]), int(who[q[k]])
            body, passage = exact[ends[d] : ends[d + 1]], passages.exact[w]
            i, j = int(p[k] - ends[d]), int(off[q[k]])
            right = run_length(body, i, passage, j)
            left = run_length(body[:i][::-1], 0, passage[:j][::-1], 0) if i and j else 0
            if left + right > best.get((d, w), (0, 0))[0]:
                best[d, w] = (left + right, i - left)
    return [(d, w, n, i) for (d, w), (n, i) in best.items() if n >= passages.need[w]]


def shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of shards of SHARD_CHARS characters or one text more, over the limits of batches."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for pdf in batches:
        for i, t in zip(pdf["doc_id"], pdf["text"]):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= SHARD_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Leaks of passages(item_id, passage) in documents(doc_id, text).

    Returns (doc_id, item_id, run_chars, passage_chars, start_at): the longest verbatim run in letters and
    digits and where it starts among those of the document. Null and empty texts and passages have no
    leaks. The passages go to every task, in blocks of about BLOCK rows; documents aren't shuffled.
    """
    known = passages.select(F.col("item_id").cast("bigint").alias("item_id"), "passage").where("item_id is not null and passage is not null")
    blocks = -(-known.count() // BLOCK)
    if blocks > 1:
        parts = [find_leaks_of(documents, known.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == k)) for k in range(blocks)]
        return reduce(DataFrame.unionByName, parts)
    return find_leaks_of(documents, known)


def find_leaks_of(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """The leaks of one block of passages, which the driver gathers."""
    items = sorted((r["item_id"], r["passage"]) for r in passages.collect())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Passages(items)
        for ids, texts in shards(batches):
            yield pd.DataFrame(
                [(ids[d], known.ids[w], n, len(known.text[w]), i) for d, w, n, i in shard_leaks(texts, known)],
                columns=["doc_id", "item_id", "run_chars", "passage_chars", "start_at"],
            ).astype("int64")

    docs = documents.where(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInPandas(run, "doc_id bigint, item_id bigint, run_chars bigint, passage_chars bigint, start_at bigint")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affected document with the items leaked into it and the longest match of each."""
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain once affected ones are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(p9_leaks(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")


_LETTERS = r"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '', 'g')"
ORACLE = {
    "p9_found": f"""WITH d AS (SELECT doc_id, {_LETTERS.format(x="text")} AS t FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, {_LETTERS.format(x="passage")} AS p FROM benchmark), n AS (SELECT item_id, p, (length(p) + 1) // 2 AS need FROM i WHERE length(p) > 0),
        w AS (SELECT item_id, need, unnest(list_transform(range(1, length(p) - need + 2), lambda k: substr(p, k, need))) AS part FROM n)
        SELECT DISTINCT doc_id, item_id FROM d JOIN w ON length(t) >= need AND contains(t, part)""",
}
ORACLE["p9_clean"] = f"SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({ORACLE['p9_found']}))"
