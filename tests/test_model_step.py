"""The model step: answers taken apart, micro-batches, and what happens when the model fails."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import model_output as M
from loomtext.plans import translate as R


@pytest.mark.parametrize("raw,n,want", [
    ('["насос", "кран"]', 2, ["насос", "кран"]), ('```json\n{"rows": ["a", "b"]}\n```', 2, ["a", "b"]), ('{"2": "b", "1": "a", "x": "y"}', 2, ["a", "b"]), ("[1] a\n[2] b\n c", 2, ["a", "b c"]),
    ("Here you are\n[2] b\n[1] a", 2, ["a", "b"]), ("[1] a\n[3] b", 2, ["[1] a", "[3] b"]), ("a\n@@ROW@@\nb", 2, ["a", "b"]), ("1) a\n2) b", 2, ["a", "b"]), ("a\n\nb", 2, ["a", "b"]),
    ("a", 2, None), ("", 1, None), (None, 1, None), ('["a"]', 2, None), ("[broken", 1, ["[broken"]), ("Перевод: насос\nкран", 2, ["", "кран"]), ("1", 1, ["1"]), ("x", 0, None), ("a" * 50_000, 1, ["a" * 50_000]),
])
def test_answers_are_taken_apart(spark, raw, n, want):
    d = spark.createDataFrame([(raw, n)], "raw string, n int")
    assert d.select(M.parsed_batch(F.col("raw"), F.col("n")).alias("x")).first()["x"] == want


def test_micro_batches_number_all_texts(spark):
    rows = [("ОВ", "水泵" * (1 + i % 60) + str(i)) for i in range(700)]
    got = R.micro_batches(spark.createDataFrame(rows, "section string, source string")).collect()
    assert len(got) == 700
    by = {}
    for r in got:
        by.setdefault((r["complexity"], r["batch_no"]), []).append(r)
    for c in {k[0] for k in by}:
        numbers = sorted(k[1] for k in by if k[0] == c)
        size = got[0]["batch_size"] if False else next(r["batch_size"] for r in got if r["complexity"] == c)
        assert numbers == list(range(len(numbers))) and all(len(by[c, k]) == size for k in numbers[:-1]) and len(by[c, numbers[-1]]) <= size
        for a, b in zip(numbers, numbers[1:]):
            assert max(r["n"] for r in by[c, a]) <= min(r["n"] for r in by[c, b])
    assert R.micro_batches(spark.createDataFrame([], "section string, source string")).count() == 0


def test_the_model_sees_batches_and_is_asked_again_alone(spark):
    rows = [("ОВ", f"水泵{i:03d}") for i in range(100)]
    p = spark.createDataFrame(rows, "section string, source string")

    def picky(texts):
        if len(texts) > 32 or len(texts) > 1 and any("007" in t for t in texts):
            raise RuntimeError("too much")
        return [] if texts == ["水泵007"] else ["насос " + t[-3:] for t in texts]

    got = {r["source"]: r["model_text"] for r in R.call_model(p, picky).collect()}
    assert got == {s: s if "007" in s else "насос " + s[-3:] for _, s in rows}
    assert R.call_model(p.limit(0), picky).count() == 0
