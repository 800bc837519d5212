"""Problems 1, 8 and 9 on hand-made cases and against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import leakage, packing, pagenoise


def letters(t):
    return "".join(c for c in t.lower() if c.isalnum())


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, max(row))
    return best


def test_leaks_like_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("абвгд") for _ in range(rnd.randint(2, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (40, 30, 12, 6, 3, 1)] + ["水泵安装在锅炉房内与控制柜连接，尺寸以现场复核为准。" * 3]
    docs = []
    for i in range(120):
        p = rnd.choice(passages)
        a = rnd.randrange(len(p))
        cut = p[a : a + rnd.randint(1, len(p))]
        cut = "".join(c.upper() + rnd.choice(["", " ", "-", "\n"]) if rnd.random() < 0.4 else c for c in cut)
        docs.append(" ".join(word() for _ in range(rnd.randint(0, 60))) + " " + cut + " " + " ".join(word() for _ in range(20)))
    want = {(i, j) for i, d in enumerate(docs) for j, p in enumerate(passages) if 2 * longest(letters(d), letters(p)) >= len(letters(p))}
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").withColumns({"item_id": F.lit(1), "run_chars": F.lit(1)})
    p = spark.createDataFrame(list(enumerate(passages)), "item_id bigint, passage string").withColumn("text", F.lit("x"))
    got = leakage.find_leaks(d, p).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    for r in got:
        body, item = letters(docs[r["doc_id"]]), letters(passages[r["item_id"]])
        assert r["run_chars"] == longest(body, item) and body[r["start_at"] : r["start_at"] + r["run_chars"]] in item


def test_leak_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "abc" * 5000), (4, "abc" * 5000)], "doc_id bigint, text string")
    p = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "abcabcabc" * 10), (None, "abc")], "item_id bigint, passage string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, p).collect()) == [(4, 4), (4, 4)]
    assert leakage.find_leaks(d, p.limit(0)).count() == 0 == leakage.find_leaks(d.limit(0), p).count()


def test_characters_of_rare_planes_are_not_confused(spark):
    d = spark.createDataFrame([(1, "\U00020000" * 40), (2, "\U00021900" * 40)], "doc_id bigint, text string")
    p = spark.createDataFrame([(1, "\U00021900" * 40)], "item_id bigint, passage string")
    assert [(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, p).collect()] == [(2, 1)]


def test_passages_in_blocks_and_shards_over_batches(spark, monkeypatch):
    words = ["".join(random.Random(i).choices("абвгдежз", k=50)) for i in range(12)]
    d = spark.createDataFrame([(i, "x " + words[i % 12] + " y") for i in range(30)], "doc_id bigint, text string")
    p = spark.createDataFrame(list(enumerate(words)), "item_id bigint, passage string")
    want = {(i, i % 12) for i in range(30)}
    monkeypatch.setattr(leakage, "BLOCK", 5)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, p).collect()} == want
    assert [len(i) for i, _ in leakage.shards(iter([]))] == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 80))
def test_packing_is_a_partition_within_capacity(sizes, capacity):
    bins = packing.pack(sizes, capacity)
    assert sorted(i for b in bins for i in b) == [i for i, s in enumerate(sizes) if s]
    assert all(0 < sum(sizes[i] for i in b) <= capacity for b in bins)
    assert len(bins) <= max(1, 2 * -(-sum(sizes) // capacity)) or not sum(sizes)


def test_local_search_fills_what_best_fit_leaves():
    rnd = random.Random(3)
    sizes = [rnd.randint(200, 900) for _ in range(1500)]
    before = packing.best_fit(sizes, 1000)
    after = packing.improve(packing.best_fit(sizes, 1000), 1000)
    assert sum(b.fill**2 for b in after) >= sum(b.fill**2 for b in before) and len(after) <= len(before)
    assert sum(b.fill for b in after) == sum(sizes)
    with pytest.raises(ValueError):
        packing.pack([11], 10)


def test_pack_documents(spark):
    rows = [(1, 0), (2, 25), (3, 4), (4, 6), (5, 10), (6, 3), (7, 7), (7, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumns({"container_id": F.lit(1), "shard": F.lit(2), "fill": F.lit(3)}).select("doc_id", "n_tokens")
    got = packing.pack_documents(df, 10).collect()
    fill = {}
    for r in got:
        if r["container_id"]:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
    assert all(v <= 10 for v in fill.values()) and sum(fill.values()) == 62 and len(fill) == 7
    assert sorted(r["start_token"] for r in got if r["doc_id"] == 2) == [0, 10, 20]
    assert [r["container_id"] for r in got if r["doc_id"] == 1] == [None]
    assert packing.pack_documents(df.limit(0), 10).count() == 0


def test_repeated_and_null_ids_get_containers_of_their_own(spark):
    df = spark.createDataFrame([(7, 10), (7, 10), (None, 10), (None, 25), (None, 0)], "doc_id bigint, n_tokens bigint")
    got = packing.pack_documents(df, 10).collect()
    assert sum(r["n_tokens"] for r in got) == 55 and sum(r["container_id"] is None for r in got) == 1
    full = [r["container_id"] for r in got if r["n_tokens"] == 10]
    assert len(full) == len(set(full)) == 5


def test_several_shards_stay_near_the_lower_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 300)
    rnd = random.Random(5)
    rows = [(i, rnd.randint(1, 60)) for i in range(2000)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), 100).groupBy("container_id").agg(F.sum("n_tokens").alias("n")).collect()
    total = sum(n for _, n in rows)
    assert sum(r["n"] for r in got) == total and max(r["n"] for r in got) <= 100 and len(got) <= 1.02 * -(-total // 100)


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Насос 5"), (4, "水泵 " * 3000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_sizes(df).collect()}
    assert got[1] == got[2] == 0 and got[3] == len(packing.encoding().encode_ordinary("Насос 5")) and got[4] > 3000


GOOD = ["Насос циркуляционный подаёт воду в контур отопления котельной.", "Сварной шов узла проверяется ультразвуком, приёмка оформляется актом.", "The standby pump starts after the duty unit trips.", "屋面照度复测结果为500勒克斯，限期30天。",
        "самовыравнивающая смесь; сэндвич-панель", "two-stage start-up of the make-up tank"]


def block(i, text, page=1, src="ocr_raster", y0=300.0, y1=400.0, file=1):
    return (i, file, page, src.startswith("ocr"), 10.0, y0, y1, text)


SCHEMA = "block_id bigint, file_id bigint, page int, ocr boolean, x0 double, y0 double, y1 double, text string"


def noise_of(spark, rows):
    base = [block(1000 + i, t, src="text", file=2) for i, t in enumerate(GOOD * 30)]
    out = {}
    for r in pagenoise.inspect_blocks(spark.createDataFrame(rows + base, SCHEMA).withColumns({"title": F.lit(1), "misread": F.lit(2)}), True).collect():
        kinds = {k for k in ("hyphen_break", "misread", "page_number") if r[k]} | ({"running_header"} if r["is_title"] else set())
        out.setdefault(r["block_id"], []).append((kinds, r["repaired"]))
    return out


def test_noise_kinds(spark):
    rows = [
        block(1, "Насос циркуляционный подаёт воду в контур отоп-\nления котельной."), block(2, "Насос циркуляцион¬\n ный подаёт воду"), block(3, "start-\nup of the make-\nup tank"), block(4, "Св4рной шов узла проверяегся"),
        block(5, "屋面照庋复测结果为500勒克斯"), block(6, "Насос подаёт воду"), block(7, None), block(8, ""), block(9, "- 7 -", page=7, y0=800.0, y1=812.0), block(10, "7", page=7, y0=400.0, y1=410.0),
        block(11, "8", page=7, y0=800.0, y1=812.0), block(12, "Стр. 7 из 9", page=7, y0=800.0, y1=812.0), block(13, "7.5", page=7, y0=800.0, y1=812.0), block(14, "воду в контур\nЛист 7", page=7, y0=700.0, y1=812.0),
        (15, 1, 7, True, None, None, None, "7"), block(16, "Насос циркуляционный подаёт воду", file=None), block(16, "Насос циркуляционный подаёт воду"),
    ]
    rows += [block(20 + p, f"Проект А  {'—' * p} том 1" + ("\nНасос подаёт воду" if p == 2 else ""), page=p, y0=20.0, y1=40.0, file=5) for p in (1, 2, 3)] + [block(30, "Проект Б", page=1, y0=20.0, y1=40.0, file=5)]
    got = noise_of(spark, rows)
    kinds = {k: v[0][0] for k, v in got.items()}
    assert kinds[1] == kinds[2] == {"hyphen_break"} and kinds[3] == set() and kinds[4] == kinds[5] == {"misread"} and kinds[6] == kinds[7] == kinds[8] == set()
    assert kinds[9] == kinds[12] == kinds[14] == {"page_number"} and all(kinds[i] == set() for i in (10, 11, 13, 15))
    assert all(kinds[20 + p] == {"running_header"} for p in (1, 2, 3)) and kinds[30] == set() and len(got[16]) == 2
    text = {k: v[0][1] for k, v in got.items()}
    assert text[1] == GOOD[0] and text[4].startswith("Сварной шов узла проверяется") and "照度" in text[5] and text[9] == "" and text[22] == "Насос подаёт воду" and text[14] == "воду в контур"


def test_no_blocks(spark):
    assert pagenoise.inspect_blocks(spark.createDataFrame([], SCHEMA), True).count() == 0


def test_reflow():
    assert pagenoise.reflow("a\nb\n\n\nc") == "a b\n\nc" and pagenoise.reflow("水\n泵") == "水泵"


def scan_cost(intended: str, written: str) -> float:
    """Cost of reading intended as written: confusions are cheap, any other edit is dear."""
    n, m = len(intended), len(written)
    inf = 99.0
    d = [[inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            x = d[i][j]
            if x >= inf:
                continue
            if i < n and j < m:
                same = intended[i] == written[j]
                c = x + (0.0 if same else pagenoise.CONFUSION.get((intended[i], written[j]), pagenoise.DIGIT if written[j].isdigit() else pagenoise.OTHER))
                d[i + 1][j + 1] = min(d[i + 1][j + 1], c)
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], x + pagenoise.OTHER)
                if i + 1 < n and j < m and (k := pagenoise.CONFUSION.get((intended[i : i + 2], written[j]))) is not None:
                    d[i + 2][j + 1] = min(d[i + 2][j + 1], x + k)
                if j + 1 < m and (k := pagenoise.CONFUSION.get((intended[i], written[j : j + 2]))) is not None:
                    d[i + 1][j + 2] = min(d[i + 1][j + 2], x + k)
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], x + pagenoise.OTHER)
    return d[n][m]


def test_weighted_automaton_gives_all_readings():
    words = ["замечание", "технадзора", "minutes", "remains", "modern", "под", "насос", "closed", "schedule"]
    trie = pagenoise.Trie(words)
    for token in ("заме4ание", "тсхнад3ора", "rninutes", "rernains", "п0д", "иасос", "c1osccl", "modem", "scheclule", "wxyz", "", "заечание", "замжечание", "schexule"):
        want = {w: round(scan_cost(w, token), 6) for w in words if scan_cost(w, token) <= pagenoise.MOST}
        assert {w: round(c, 6) for c, _, w in trie.readings(token, pagenoise.MOST)} == want, token
    rnd = random.Random(5)
    words = list({"".join(rnd.choice("aбв") for _ in range(rnd.randint(1, 7))) for _ in range(200)})
    trie = pagenoise.Trie(words)
    for token in ("aбв", "aaббвв", "", "вaб"):
        want = {w: round(scan_cost(w, token), 6) for w in words if scan_cost(w, token) <= 2 * pagenoise.OTHER}
        assert {w: round(c, 6) for c, _, w in trie.readings(token, 2 * pagenoise.OTHER)} == want


def test_edits_unknown_of_scanners_need_their_context(spark):
    """A dropped or added letter is repaired beside the words the right one stands with, and nowhere else."""
    rows = [block(1, "Насос циркуляцинный подаёт воду"), block(2, "Лестница циркуляцинный цех"), block(3, "The standxby pump starts"), block(4, "воду циркуляцион")]
    got = noise_of(spark, rows)
    assert got[1][0] == ({"misread"}, "Насос циркуляционный подаёт воду") and got[2][0][0] == set() and got[3][0] == ({"misread"}, "The standby pump starts")
    assert got[4][0][0] == set()  # the end of the text is missing, which is no scan error
