"""Problem 5: blocks at the same place of a page whose texts differ by small edits.

Similarity is the Jaccard coefficient of the sets of three-character shingles of the lower-cased text
without white space. Each block is sketched by one-permutation hashing: one hash per shingle, its bins
hold minima, and empty bins borrow from a random non-empty bin by optimal densification. A byte of each bin
travels with the block to the places its box touches, cells of all four sides. There texts that agree in a band
of bins are compared by their whole sketches, before any pair leaves the worker; what is left is checked exactly,
once for each two texts, and then expanded to the blocks that have them and whose boxes are close.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.codepoints import MAX_CP, flatten, mix64
from loomtext.plans.runtime import cut, table

SHINGLE = 3
THRESHOLD = 0.7
MAX_SHIFT = 8.0
MIN_CHARS, MAX_CHARS = 80, 1200
#: Two sketches of 100 bins each; bands of 5 bins: at similarity 0.7 a pair misses all 40 with p < 0.001.
SKETCHES, BINS, ROWS_PER_BAND = 2, 100, 5
BANDS = SKETCHES * BINS // ROWS_PER_BAND
BOX = ("x0", "y0", "x1", "y1")
#: Side of a grid cell; a block is put into each cell that its box, widened by half of MAX_SHIFT, touches.
CELL, REACH = 64.0, MAX_SHIFT / 2 + 0.001
#: Members of one place that are dealt to one task; those of a larger one meet part by part.
CROWD = 250_000
#: Rows and pairs held as arrays at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 20_000, 100_000
#: Sets of shingles kept at once by the exact check, some 40 kB each.
KNOWN = 500
#: A pair of similarity 0.7 whose sketches agree less than this many standard deviations below it isn't checked.
DEVIATIONS = 5.5
EMPTY = np.uint64(2**64 - 1)
#: A block in a place; own has a bit for each side of the box whose lower end lies in the cell.
MEMBER = np.dtype([("id", "<i8"), ("own", "u1"), *[(c, "<f8") for c in BOX]])
ALL_OWN = 15


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Lower-case code points; 0 for white space. Characters whose lower form is longer keep it by hand."""
    t = np.arange(MAX_CP, dtype=np.uint32)
    for cp in range(0x3100):
        ch = chr(cp)
        t[cp] = 0 if ch.isspace() else ord(ch.lower()[0])
    for cp in range(0xA640, 0x10000):
        if not 0xD800 <= cp < 0xE000:
            ch = chr(cp)
            t[cp] = 0 if ch.isspace() else ord(ch.lower()[0])
    return t


def shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and the row each belongs to."""
    flat, offsets = flatten(texts)
    folded = lower_table()[flat] if len(flat) else flat
    keep = folded > 0
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    c = folded[keep].astype(np.uint64)
    if len(c) < SHINGLE:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    same = row[2:] == row[:-2]
    with np.errstate(over="ignore"):
        s = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    return s[same], row[2:][same]


def minima(texts: list[str | None]) -> np.ndarray:
    """The least hash per text, sketch and bin; EMPTY where no shingle falls into a bin."""
    s, row = shingle_hashes(texts)
    n = len(texts)
    out = np.empty((SKETCHES, n, BINS), dtype=np.uint64)
    for k in range(SKETCHES):
        h = mix64(s, 11 + k)
        b = ((h >> np.uint64(40)) % np.uint64(BINS)).astype(np.int64)
        out[k] = EMPTY
        np.minimum.at(out[k].reshape(-1), row * BINS + b, mix64(h, 3))
    return out


def filled(mins: np.ndarray) -> np.ndarray:
    """SKETCHES * BINS minima per text, without empty bins (rows of texts without a shingle are all 0)."""
    return np.concatenate([densify(m, k) for k, m in enumerate(mins)], axis=1)


def sketch(texts: list[str | None]) -> np.ndarray:
    return filled(minima(texts))


def densify(mins: np.ndarray, seed: int = 0) -> np.ndarray:
    """Optimal densification: an empty bin tries bins drawn by a hash of (bin, attempt), the same in every row."""
    empty = mins == EMPTY
    some = ~empty.all(axis=1)
    out = np.where(some[:, None], mins, np.uint64(0))
    r, b = np.nonzero(empty & some[:, None])
    attempt = 0
    while len(r):
        donor = (mix64(b.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt), 101 + seed) % np.uint64(BINS)).astype(np.int64)
        hit = ~empty[r, donor]
        out[r[hit], b[hit]] = mins[r[hit], donor[hit]]
        r, b = r[~hit], b[~hit]
        attempt += 1
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketch of each block in place of its text: a byte of each bin, and how many bins aren't borrowed."""
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            b = batch.slice(at, 5000)
            mins = minima(b["text"].to_pylist())
            bins = (mins != EMPTY).sum(axis=(0, 2))
            has = np.flatnonzero(bins)
            data = (filled(mins)[has] & np.uint64(255)).astype(np.uint8)
            ends = np.arange(len(has) + 1, dtype=np.int32) * (SKETCHES * BINS)
            low = pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            rest = b.select(["id", "h", *BOX]).take(pa.array(has))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(bins[has].astype(np.int16)), low], ["id", "h", *BOX, "bins", "low"])


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of byte strings of one length, as rows."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _whole_places(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """place, h, part, bins, members and sketches of whole places, from rows sorted by place; many small places at once."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        m = np.empty(b.num_rows, MEMBER)
        for c in MEMBER.names:
            m[c] = b[c].to_numpy(zero_copy_only=False)
        held.append([*[b[c].to_numpy(zero_copy_only=False).copy() for c in ("place", "h", "part", "bins")], m, _matrix(b["low"]).copy()])
        last = held[-1][0][-1]
        if sum(len(x[0]) for x in held) >= ROWS_AT_ONCE and held[0][0][0] != last:
            all_ = [np.concatenate(x) for x in zip(*held)]
            end = int(np.argmax(all_[0] == last))
            yield [x[:end] for x in all_]
            held = [[x[end:].copy() for x in all_]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _runs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs u < v of positions with equal keys, some at a time."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    length = np.diff(np.r_[start, len(k)])
    many = length > 1
    start, length = start[many], length[many]
    first = np.repeat(start + length, length) - 1
    pos = np.arange(len(first)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
    total = np.r_[0, np.cumsum(first - pos)]
    for at in range(0, int(total[-1]), PAIRS_AT_ONCE):
        nth = np.arange(at, min(at + PAIRS_AT_ONCE, int(total[-1])))
        i = np.searchsorted(total, nth, "right") - 1
        u, v = order[pos[i]], order[pos[i] + 1 + nth - total[i]]
        yield np.minimum(u, v), np.maximum(u, v)


def _alike_in_places(place: np.ndarray, h: np.ndarray, part: np.ndarray, bins: np.ndarray, m: np.ndarray, low: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Two texts of one place whose sketches agree, each with its members; one text with several members is a pair with itself."""
    order = np.lexsort((h, place))
    place, h, m = place[order], h[order], m[order]
    start = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (h[1:] != h[:-1])])
    end = np.r_[start[1:], len(h)]
    place, h, part, bins, low = place[start], h[start], part[order[start]], bins[order[start]], low[order[start]]
    for t in np.flatnonzero((end - start > 1) & (part == 0)):
        yield int(h[t]), int(h[t]), m[start[t] : end[t]].tobytes(), b""
    cell = np.cumsum(np.r_[False, place[1:] != place[:-1]]).astype(np.uint64) << np.uint64(8 * ROWS_PER_BAND)
    own = np.bitwise_or.reduceat(m["own"], start)
    ends = [(np.minimum.reduceat(m[c], start), np.maximum.reduceat(m[c], start)) for c in BOX]
    bands = low.reshape(len(low), BANDS, ROWS_PER_BAND)
    least = SKETCHES * BINS * (THRESHOLD - DEVIATIONS * np.sqrt(THRESHOLD * (1 - THRESHOLD) / bins))
    for band in range(BANDS):
        key = cell.copy()
        for i in range(ROWS_PER_BAND):
            key |= bands[:, band, i].astype(np.uint64) << np.uint64(8 * i)
        for u, v in _runs(key):
            ok = ((part[u] == 0) | (part[u] != part[v])) & (own[u] | own[v] == ALL_OWN)
            u, v = u[ok], v[ok]
            for lo, hi in ends:
                ok = (lo[u] - hi[v] <= MAX_SHIFT) & (lo[v] - hi[u] <= MAX_SHIFT)
                u, v = u[ok], v[ok]
            agree = np.bitwise_count((low[u] == low[v]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            ok = agree >= np.minimum(least[u], least[v])
            u, v = u[ok], v[ok]
            if len(u) and band:  # only in the first band in which they meet
                ok = ~(bands[u, :band] == bands[v, :band]).all(axis=2).any(axis=1)
                u, v = u[ok], v[ok]
            for a, b in zip(u.tolist(), v.tolist()):
                yield int(h[a]), int(h[b]), m[start[a] : end[a]].tobytes(), m[start[b] : end[b]].tobytes()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["h_a", "h_b", "members_a", "members_b"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    out, held = [], 0
    for columns in _whole_places(batches):
        for row in _alike_in_places(*columns):
            out.append(row)
            held += len(row[2]) + len(row[3])
            if held > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of members whose boxes are close, in the one place that is the pair's own."""
    out, held = [], 0
    for batch in batches:
        for x, y in zip(batch["members_a"], batch["members_b"]):
            a, b = (np.frombuffer(z.as_buffer(), MEMBER) for z in (x, y))
            one = not len(b)
            b = a if one else b
            step = max(1, 1_000_000 // len(b))
            for at in range(0, len(a), step):
                p, q = a[at : at + step, None], b[None, at if one else 0 :]
                ok = (p["own"] | q["own"]) == ALL_OWN
                for c in BOX:
                    ok &= np.abs(p[c] - q[c]) <= MAX_SHIFT
                i, j = np.nonzero(np.triu(ok, 1) if one else ok)
                i, j = p["id"][i, 0], q["id"][0, j]
                out.append(np.stack([np.minimum(i, j), np.maximum(i, j)])[:, i != j])
                held += out[-1].shape[1]
                if held > 100_000:
                    pairs = np.concatenate(out, axis=1)
                    for s in range(0, held, 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(z[s : s + 100_000]) for z in pairs], ["id_a", "id_b"])
                    out, held = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(z) for z in np.concatenate(out, axis=1)], ["id_a", "id_b"])


def shingle_set(text: str) -> frozenset[str]:
    s = "".join(text.lower().split())
    return frozenset(s[i : i + SHINGLE] for i in range(len(s) - SHINGLE + 1))


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps the pairs that are really similar: exact Jaccard on the whole texts."""
    for pdf in batches:
        known: dict[int, frozenset[str]] = {}
        keep = []
        for a, b, ta, tb in zip(pdf["id_a"], pdf["id_b"], pdf["text_a"], pdf["text_b"]):
            if len(known) > KNOWN:
                known.clear()
            sa = known.get(a) or known.setdefault(a, shingle_set(ta))
            sb = known.get(b) or known.setdefault(b, shingle_set(tb))
            both = len(sa & sb)
            keep.append(both > 0 and both >= THRESHOLD * (len(sa) + len(sb) - both))
        yield pdf.loc[keep, ["id_a", "id_b"]]


def eligible(blocks: DataFrame) -> DataFrame:
    """Blocks(id, text, x0, y0, x1, y1) that take part: with an id, text of 80 to 1200 characters and a complete, finite bbox."""
    ok = F.col("id").isNotNull() & F.length("text").between(MIN_CHARS, MAX_CHARS)
    for c in BOX:
        ok = ok & (F.abs(c) < float("inf"))
    return blocks.where(ok)


def _placed(rows: DataFrame) -> DataFrame:
    """rows, once for each cell that the box touches, with cell and own."""
    own = F.lit(0)
    for k, c in enumerate(BOX):
        low, high = (F.floor((F.col(c) + w) / CELL) for w in (-REACH, REACH))
        rows = rows.withColumn(f"_{c}", F.explode(F.array_distinct(F.array(low, high))))
        own = own + F.when(F.col(f"_{c}") == low, 1 << k).otherwise(0)
    cells = [f"_{c}" for c in BOX]
    return rows.withColumns({"cell": F.xxhash64(*cells), "own": own.cast("tinyint")}).drop(*cells)


def _dealt(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """place and part of each row: its cell and 0, or for cells in crowded(cell, parts) each two parts, the row being of part 1 or 2, and each part alone."""
    mine, other = F.expr("pmod(h, parts)"), F.col("other")
    rows = rows.join(F.broadcast(crowded), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    return rows.withColumns({
        "place": F.xxhash64("cell", F.least(mine, other), F.greatest(mine, other)),
        "part": F.when(mine == other, 0).when(mine < other, 1).otherwise(2).cast("tinyint"),
    }).drop("parts", "other")


def similar_pairs(blocks: DataFrame) -> DataFrame:
    """All pairs (id_a < id_b) of blocks(id, text, x0, y0, x1, y1) at one place with similarity of at least 0.7.

    Blocks with null or too short or long text, or an incomplete bbox, take no part; of a repeated id each row counts.
    """
    rows = eligible(blocks).select("id", F.xxhash64("text").alias("h"), "text", *[F.col(c).cast("double").alias(c) for c in BOX])
    low = rows.mapInArrow(_sketched, "id bigint, h bigint, x0 double, y0 double, x1 double, y1 double, bins smallint, low binary")
    crowded = cut(
        _placed(rows.select(*BOX)).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
        .select("cell", F.expr(f"n div {CROWD} + 1").alias("parts"))
    )
    placed = _placed(low)
    if crowded.isEmpty():
        placed = placed.withColumns({"place": F.col("cell"), "part": F.lit(0).cast("tinyint")})
    else:
        placed = _dealt(placed, crowded)
    placed = placed.select("place", "h", "part", "bins", *MEMBER.names, "low")
    alike = cut(
        placed.repartition("place").sortWithinPartitions("place")
        .mapInArrow(_alike, "h_a bigint, h_b bigint, members_a binary, members_b binary")
    )
    two = alike.where("h_a <> h_b").select("h_a", "h_b").distinct()
    needed = two.select(F.explode(F.array("h_a", "h_b")).alias("h")).distinct()
    texts = rows.select("h", "text").join(needed, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    side = lambda s: texts.select(F.col("h").alias(f"id_{s}"), F.col("text").alias(f"text_{s}"))
    similar = (
        two.select(F.col("h_a").alias("id_a"), F.col("h_b").alias("id_b")).join(side("a"), "id_a").join(side("b"), "id_b")
        .select("id_a", "id_b", "text_a", "text_b").mapInPandas(_verify, "id_a bigint, id_b bigint")
    )
    checked = alike.join(similar.select(F.col("id_a").alias("h_a"), F.col("id_b").alias("h_b")), ["h_a", "h_b"])
    members = alike.where("h_a = h_b").unionByName(checked.select(*alike.columns)).select("members_a", "members_b")
    return members.mapInArrow(_expanded, "id_a bigint, id_b bigint")


def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pdf_blocks").select(
        F.col("block_id").alias("id"), "text", *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(p5_blocks(spark, sf_dir)).select(F.col("id_a").alias("block_a"), F.col("id_b").alias("block_b"))


def components(pairs: DataFrame) -> DataFrame:
    """(id, class_id): the smallest id reachable over pairs(id_a, id_b), by large-star/small-star rounds until nothing changes."""
    edges = cut(pairs.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).distinct())
    while True:
        # large star: every larger neighbour goes to the smallest neighbour
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: the smaller neighbours and the node go to the smallest
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = cut(small)
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class_id")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("class_id"))
    ).distinct()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block with the class it belongs to; a block without a similar one is a class of its own."""
    blocks = p5_blocks(spark, sf_dir)
    classes = components(similar_pairs(blocks))
    return blocks.select("id").join(classes, "id", "left").select(
        F.col("id").alias("block_id"), F.coalesce("class_id", "id").alias("class_id")
    )


ORACLE = {
    "p5_found": r"""WITH b AS (SELECT block_id AS id, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1, regexp_replace(lower(text), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g') AS t
          FROM pdf_blocks WHERE length(text) BETWEEN 80 AND 1200 AND bbox.x0 IS NOT NULL AND bbox.y0 IS NOT NULL AND bbox.x1 IS NOT NULL AND bbox.y1 IS NOT NULL),
        s AS (SELECT id, x0, y0, x1, y1, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS g FROM b),
        p AS (SELECT a.id AS block_a, b.id AS block_b, len(list_intersect(a.g, b.g)) AS shared, len(a.g) + len(b.g) AS total FROM s a JOIN s b ON a.id < b.id
          AND abs(a.x0 - b.x0) <= 8 AND abs(a.y0 - b.y0) <= 8 AND abs(a.x1 - b.x1) <= 8 AND abs(a.y1 - b.y1) <= 8)
        SELECT block_a, block_b FROM p WHERE shared >= 0.7 * (total - shared)""",
}
ORACLE["p5_groups"] = f"""WITH RECURSIVE e AS (SELECT block_a AS u, block_b AS v FROM ({ORACLE['p5_found']})), both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    r AS (SELECT DISTINCT u AS id, u AS seen FROM both_ways UNION SELECT r.id, v FROM r JOIN both_ways ON both_ways.u = r.seen), c AS (SELECT id, min(seen) AS class_id FROM r GROUP BY 1)
    SELECT block_id, coalesce(class_id, block_id) AS class_id FROM pdf_blocks LEFT JOIN c ON c.id = block_id"""
