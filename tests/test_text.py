"""Column functions against hand-derived values and plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from loomtext.functions import glossary as G
from loomtext.functions import text as T


def values(spark, fn, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


PUNCTUATION = [
    ("冷却水池10米*20米，深5米", "冷却水池10米*20米, 深5米"), ("516.29", "516. 29"), ("600x400方井", "600 x400方井"), ("35吨平炉(砖混结构）", "35吨平炉(砖混结构)"),
    ("水泵75KW,流量550方", "水泵75 KW, 流量550方"), ("насос2шт", "насос 2 шт"), ("比例1:100", "比例1: 100"),
    ("能源：电，天然气，水，压缩空气。", "能源: 电, 天然气, 水, 压缩空气."), ("a _b_ -", "a b"), ("铝锭＋废料", "铝锭 + 废料"), ("深度200mm", "深度200 mm"), ("1#井", "1#井"),
]


def test_punctuation(spark):
    assert values(spark, T.normalise_punctuation, [a for a, _ in PUNCTUATION]) == [b for _, b in PUNCTUATION]


def test_passthrough(spark):
    texts = ["516.29", "A-12", "насос 2", "Main pump assembly", "水泵", "", None, "　 ", "DN300", "kitchen"]
    assert values(spark, T.is_passthrough, texts) == [True, True, True, False, False, True, True, True, True, True]


def test_sections(spark):
    texts = ["电气消防", "消防通风", "通风工艺", "建筑结构", "阀", None, ""]
    assert values(spark, T.detect_section, texts) == ["ЭОМ", "ПБ", "ТХ", "КЖ", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_clean_source_counts_code_points_and_unicode_space(spark):
    long = "中" * 1399 + "　 \u001c" + "文" * 50
    got = values(spark, T.clean_source, ["  a　b \tc ", long, None])
    assert got[0] == "a b c" and len(got[1]) == 1400 and got[1].endswith("中 ") and got[2] == ""


@pytest.mark.parametrize("size,expected", [(79, 0), (80, 1), (180, 2), (420, 3), (700, 4)])
def test_complexity(spark, size, expected):
    assert values(spark, T.complexity, ["x" * size]) == [expected]


def test_batch_size(spark):
    cases = [(80, 45, 32), (160, 80, 18), (200, 100, 10), (260, 100, 5), (420, 100, 3), (700, 100, 2)]
    rows = spark.createDataFrame([(a, float(b), c) for a, b, c in cases], "a int, b double, c int")
    assert all(r["v"] == r["c"] for r in rows.select("c", T.batch_size(F.col("a"), F.col("b")).alias("v")).collect())


def test_candidate_score(spark):
    cases = [("ollama", 0.85), ("memory", 1.0), ("deepseek", 0.95), ("deepseek_duplicate", 1.0)]
    rows = spark.createDataFrame([("通风系统", "вентиляция", o, v) for o, v in cases], "s string, t string, o string, v double")
    for r in rows.select("v", T.candidate_score(F.col("s"), F.col("t"), F.col("o")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["v"])


def test_names_and_numbers(spark):
    assert values(spark, T.ru_name, ["plan.pdf", "a/b.c/file.tar.dxf", ".hidden", "none"]) == ["plan_RU.pdf", "file.tar_RU.dxf", ".hidden_RU", "none_RU"]
    rows = spark.createDataFrame([("1 и 2,5 и 1", "есть 2,5"), (None, "1"), ("7", None)], "s string, t string")
    assert [r["v"] for r in rows.select(T.missing_numbers(F.col("s"), F.col("t")).alias("v")).collect()] == [["1", "1"], [], ["7"]]


def test_strip_prompt(spark):
    texts = ["Rules: keep it\n- keep numbers\nText: Насос", "text: Насос", "- translate all\nНасос\n\n\n\nКран", None]
    assert values(spark, T.strip_prompt, texts) == ["Насос", "Насос", "Насос\n\nКран", ""]


def split_plain(value, least=42):
    value = value.strip()
    if "\n" in value or len(value) < least:
        return value
    mid, best = len(value) // 2, None
    for rank, sep in enumerate([", ", "; ", ": ", " - ", " ("]):
        for m in re.finditer(f"(?={re.escape(sep)})", value):
            cut = m.start() + len(sep.rstrip())
            best = min(best or (10**9,), (abs(cut - mid), rank, m.start(), cut))
    cut = best[3] if best else min(((abs(i - mid), i) for i, c in enumerate(value) if c == " "), default=(0, 0))[1]
    if not 0 < cut < len(value) - 1:
        return value
    return value[:cut].rstrip() + "\n" + value[cut:].lstrip()


def test_two_lines_like_plain_python(spark):
    texts = ["короткий", "x" * 60, "Насос циркуляционный, подающий воду в контур; резерв (один)", "слово " * 12, "a, b, c, d, e, f, g, h, i, j, k, l, m, n, o, p", "строка\nвторая " * 5]
    assert values(spark, T.split_two_lines, texts) == [split_plain(t) for t in texts]


def test_fold_is_sequential_and_longest_first(spark):
    terms = {"ab": "X", "abc": "bcd", "bc": "Q", "Xd": "!"}

    def plain(t):
        for k in sorted(terms, key=len, reverse=True):
            t = t.replace(k, terms[k])
        return t

    texts = ["abcd", "abd", "aabbcc", "", "bcabc"]
    assert values(spark, lambda c: G.fold(c, G.literal_terms(terms)), texts) == [plain(t) for t in texts]


def test_fold_skips_only_keys_that_cannot_occur(spark):
    arrays = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"), F.lit(c).alias("cn")) for k, v, c in [("水泵", "насос", True), ("水", "вода", True), ("насос", "агрегат", False)]])
    assert values(spark, lambda c: G.fold(c, arrays), ["水泵与水", "泵"]) == ["агрегат与вода", "泵"]


def test_runs_keep_what_is_not_chinese(spark):
    terms = G.literal_terms({"水泵": "насос", "泵": "помпа", "x": "y"})
    assert values(spark, lambda c: G.fold_runs(c, terms, whole=True), ["水泵x泵10水泵泵", "x"]) == ["насосxпомпа10насоспомпа", "x"]


def test_nulls_never_crash(spark):
    fns = [T.clean_source, T.text_hash, T.has_cn, T.word_share, T.normalise_punctuation, T.strip_prompt, T.clean_mtext, T.is_translatable, T.clip, T.bad_memory, T.noise, T.ocr_noise]
    for fn in fns:
        assert len(values(spark, fn, [None, "", " "])) == 3
