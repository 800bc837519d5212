"""Problem 5 against brute force, with hot places and groups."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from loomtext.llm import nearcopies as N

SCHEMA = "id bigint, text string, x0 double, y0 double, x1 double, y1 double"


def brute(rows):
    out = set()
    ok = [r for r in rows if r[1] and 80 <= len(r[1]) <= 1200 and all(v is not None and v == v for v in r[2:])]
    sets = {r[0]: N.shingle_set(r[1]) for r in ok}
    for a, b in itertools.combinations(sorted(ok), 2):
        if all(abs(x - y) <= 8 for x, y in zip(a[2:], b[2:])):
            s, t = sets[a[0]], sets[b[0]]
            if len(s & t) >= 0.7 * len(s | t):
                out.add((a[0], b[0]))
    return out


def make(seed, n):
    rnd = random.Random(seed)
    words = ["насос", "клапан", "труба", "шкаф", "линия", "опора", "бак", "кран", "ось", "узел", "плита", "балка", "щит", "фильтр", "мост", "вал"]
    rows, i = [], 0
    while len(rows) < n:
        text = " ".join(rnd.choice(words) + str(rnd.randint(1, 99)) for _ in range(rnd.randint(14, 60)))
        x, y = rnd.choice([(64.0, 128.0), (rnd.uniform(0, 500), rnd.uniform(0, 800))])
        for _ in range(rnd.choice([1, 1, 1, 2, 3, 20])):
            chars = list(text)
            for _ in range(rnd.randint(0, len(text) // 25)):
                chars[rnd.randrange(len(chars))] = rnd.choice("абвгд 123")
            j = lambda: rnd.uniform(-4.5, 4.5)
            rows.append((i, "".join(chars), x + j(), y + j(), x + 100 + j(), y + 50 + j()))
            i += 1
    return rows[:n]


def test_like_brute_force(spark):
    rows = make(3, 500)
    got = N.similar_pairs(spark.createDataFrame(rows, SCHEMA).withColumns({"bucket": F.lit(1), "n": F.lit(2), "lo": F.lit(3)}))
    found = {(r["id_a"], r["id_b"]) for r in got.collect()}
    want = brute(rows)
    assert not found - want
    assert len(want - found) <= 0.002 * len(want)


def test_edges(spark):
    t = "abcdefghij" * 9 + "klm"
    rows = [(1, t, 0.0, 0.0, 9.0, 9.0), (2, t, 8.0, 0.0, 9.0, 9.0), (3, t, 8.01, 0.0, 9.0, 9.0), (4, None, 0.0, 0.0, 9.0, 9.0), (5, "", 0.0, 0.0, 9.0, 9.0), (6, t, None, 0.0, 9.0, 9.0), (7, t[:79], 0.0, 0.0, 9.0, 9.0),
            (8, "x" * 1201, 0.0, 0.0, 9.0, 9.0), (9, t, float("nan"), 0.0, 9.0, 9.0), (10, " " * 80, 0.0, 0.0, 9.0, 9.0), (11, " " * 80, 0.0, 0.0, 9.0, 9.0)]
    got = N.similar_pairs(spark.createDataFrame(rows, SCHEMA))
    assert {(r["id_a"], r["id_b"]) for r in got.collect()} == {(1, 2), (2, 3)}
    assert N.similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_group_keeps_every_pair(spark):
    """A bucket far above SMALL: the double star and what it shares through its hubs give all pairs."""
    t = "повторяющийся блок текста номер " * 5
    rows = [(i, t + f"{i:03d}", 100.0, 100.0, 200.0, 150.0) for i in range(60)]
    got = {(r["id_a"], r["id_b"]) for r in N.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and len(got) == 60 * 59 // 2


def test_hot_group_keeps_pairs_that_its_ends_miss(spark, monkeypatch):
    """Smallest and largest id of large buckets lie elsewhere, or are less similar than the others among themselves."""
    t = "повторяющийся блок текста номер " * 5
    rows = [(i, t, 100.0, y, 200.0, y + 50) for i, y in enumerate([100.0] + [120.0] * 11 + [100.0])]
    rnd = random.Random(6)
    base = "".join(rnd.choice("абвгдежзиклмн") for _ in range(300))
    for i in range(100, 140):
        k = 55 if i in (100, 139) else 12
        chars = list(base)
        for j in rnd.sample(range(300), k // 3):
            chars[j] = rnd.choice("опрст")
        rows.append((i, "".join(chars), 300.0, 300.0, 400.0, 350.0))
    want = brute(rows)
    assert len([p for p in want if p[1] < 100]) == 11 * 10 // 2 + 1 and not {p for p in want if p[0] == 100 or p[1] == 139} >= {(100, 139)}
    got = {(r["id_a"], r["id_b"]) for r in N.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    monkeypatch.setattr(N, "CROWD", 5)
    got = N.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == want and len(got) == len(want)


def test_hot_place_of_unlike_texts_checks_few_pairs(spark, monkeypatch):
    """Texts of the same few sentences at one place: pairs that merely share a band must not reach the exact check."""
    rnd = random.Random(8)
    frames = ["насос {} проверен в режиме {}", "клапан {} заменён, акт {}", "труба {} проложена на отметке {}", "шкаф {} закрыт, ключ у звена {}", "линия {} отключена на {} часов", "опора {} выверена, отклонение {} мм", "бак {} промыт, объём {} литров", "кран {} испытан грузом {} кг"]
    rows = []
    for i in range(0, 600, 2):
        text = "; ".join(rnd.choice(frames).format(rnd.randint(1, 9999), rnd.randint(1, 9999)) for _ in range(7))
        x, y = rnd.uniform(98, 102), rnd.uniform(298, 302)
        rows.append((i, text, x, y, 300.0, 400.0))
        rows.append((i + 1, text.replace("а", "a", 3) if i % 20 == 0 else text[::-1], x, y, 300.0, 400.0))
    checked, verify = spark.sparkContext.accumulator(0), N._verify

    def counted(batches):
        for pdf in batches:
            checked.add(len(pdf))
            yield from verify(iter([pdf]))

    monkeypatch.setattr(N, "_verify", counted)
    got = {(r["id_a"], r["id_b"]) for r in N.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert len(want) >= 30 and got == want
    assert checked.value <= 3 * len(want)


def test_parts_of_crowded_places_and_repeated_rows(spark, monkeypatch):
    """Each two rows once, as SQL has them: at the edges of cells, in parts, of repeated ids and of boxes without end."""
    rows = make(5, 300)
    r = rows[198]  # has near copies
    rows += [r, (r[0], *rows[8][1:]), (None, *r[1:]), (900, r[1], float("inf"), *r[3:]), (901, r[1], float("inf"), *r[3:])]
    want = {}
    for a, b in itertools.combinations([r for r in rows if r[0] is not None], 2):
        if a[0] != b[0] and brute([(1, *a[1:]), (2, *b[1:])]):
            pair = (min(a[0], b[0]), max(a[0], b[0]))
            want[pair] = want.get(pair, 0) + 1
    for crowd in (N.CROWD, 20):
        monkeypatch.setattr(N, "CROWD", crowd)
        got = {}
        for r in N.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect():
            got[tuple(r)] = got.get(tuple(r), 0) + 1
        assert not {p: n for p, n in got.items() if want.get(p) != n}
        assert len(want) - len(got) <= 0.002 * len(want) and max(want.values()) == 2


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 9), (9, 7), (3, 4), (4, 4)], "id_a bigint, id_b bigint").where("id_a <> id_b")
    got = {r["id"]: r["class_id"] for r in N.components(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 7: 5, 9: 5}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "id_a bigint, id_b bigint")
    assert {r["class_id"] for r in N.components(chain).collect()} == {0}


def test_densified_bins_estimate_similarity():
    rnd = random.Random(1)
    a = "".join(rnd.choice("абвгдежзик") for _ in range(400))
    b = a[:340] + "".join(rnd.choice("лмноп") for _ in range(60))
    s = N.sketch([a, b, a])
    assert (s[0] == s[2]).all() and (s[0] != 0).all()
    true = len(N.shingle_set(a) & N.shingle_set(b)) / len(N.shingle_set(a) | N.shingle_set(b))
    assert abs(np.mean(s[0] == s[1]) - true) < 0.1
