"""Problems 2 and 7 against brute force and exact round trips."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import copies, splitting

ALPHABET = "aAbB1 2.,;；|-中国\n\t（ФфµΜ"


def canonical(text):
    out = [[]]
    for i, c in enumerate(text):
        if c in copies.SEPARATORS:
            out.append([])
        elif c.isalnum():
            out[-1].append(chr(copies.fold_char(c)))
        elif 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit():
            out[-1].append("\0" + c)
    return tuple(sorted("".join(f) for f in out if f))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=14), min_size=2, max_size=12))
def test_keys_and_comparison_agree_with_canonical_forms(texts):
    h1, h2, n = copies.record_keys(texts)
    for i, a in enumerate(texts):
        assert bool(n[i]) == any(c.isalnum() for c in a)
        for j, b in enumerate(texts):
            if n[i] and n[j]:
                same = canonical(a) == canonical(b)
                assert ((h1[i], h2[i]) == (h1[j], h2[j])) == same
                assert copies.same_record(a, b) == same, (a, b)


SCHEMA = "src_table string, scope bigint, id bigint, text string"


def found(df):
    return sorted((r["src_table"], r["keep_id"], r["copy_id"]) for r in df.collect())


def test_copies_with_nulls_ties_and_clashing_columns(spark):
    rows = [("t", 1, 5, "A: 1; B: 2"), ("t", 1, 3, "b:2； a - 1"), ("t", 1, 9, "a 1|B 2"), ("t", 2, 4, "a1;b2"), ("t", 1, 6, "1.5"), ("t", 1, 7, "15"), ("t", 1, 8, "1,5"), ("t", 1, 10, None), ("t", 1, 11, ""),
            ("t", 1, 12, " .,"), ("t", 1, 13, "..."), ("t", None, 14, "x"), ("t", None, 15, "X!"), ("u", 1, 3, "A1;B2"), ("t", 1, 16, "y" * 50_000), ("t", 1, 17, " Y" + "y" * 49_999)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"keep_id": F.lit(1), "h1": F.lit(2), "n": F.lit(3), "same": F.lit(4)})
    assert found(copies.find_copies(df)) == [("t", 3, 5), ("t", 3, 9), ("t", 14, 15), ("t", 16, 17)]
    kept = {(r["src_table"], r["keep_id"]): r["n_copies"] for r in copies.collapse(df).collect()}
    assert kept["t", 3] == 3 and kept["t", 10] == 1 and len(kept) == len(rows) - 4


def test_no_rows(spark):
    assert found(copies.find_copies(spark.createDataFrame([], SCHEMA))) == []


def test_a_collision_is_hashed_again(spark, monkeypatch):
    """With the first hash crippled, different records collide, and the comparison keeps them apart."""
    rows = [("t", 1, 1, "abc"), ("t", 1, 2, "xyz"), ("t", 1, 3, "X-Y-Z"), ("t", 1, 4, "ABC")]
    real = copies._hash_batches

    def crippled(seed):
        run = real(seed)

        def go(batches):
            for pdf in run(batches):
                yield pdf.assign(h1=0, h2=0) if seed == 0 else pdf

        return go

    monkeypatch.setattr(copies, "_hash_batches", crippled)
    assert found(copies.find_copies(spark.createDataFrame(rows, SCHEMA))) == [("t", 1, 4), ("t", 2, 3)]


@settings(max_examples=300, deadline=None)
@given(st.text("ab .\n;。中，1!?", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_pieces_give_the_text_back(text, limit, overlap):
    cut = splitting.split_text(text, limit, overlap)
    assert all(b - a <= limit for a, b, _, _ in cut)
    assert "".join(text[a + o : b] for a, b, o, _ in cut) == text
    assert cut[0][2] == 0 and all(0 <= o <= overlap for _, _, o, _ in cut)
    assert all(b > a + o for a, b, o, _ in cut) or not text


def test_cuts_at_natural_boundaries():
    text = ("Первое предложение о насосе. Второе предложение о клапане.\n" * 30).strip()
    cut = splitting.split_text(text, 200, 0)
    assert all(text[b - 1] in "\n " for _, b, _, _ in cut[:-1]) and all(k in ("paragraph", "sentence") for _, _, _, k in cut[:-1])
    assert {k for _, _, _, k in splitting.split_text("x" * 500, 100, 10)[:-1]} == {"character"}


def test_split_edges(spark):
    rows = [("a", 1, "x" * 1400), ("a", 2, "x" * 1401), ("a", 2, "x" * 1401), ("a", 3, None), ("a", 4, ""), ("b", 2, "𠀀" * 1401), ("b", 5, "слово " * 20_000)]
    df = spark.createDataFrame(rows, "src_table string, row_key bigint, text string").withColumns({"piece": F.lit(1), "overlap": F.lit(2)})
    got = splitting.split_oversized(df).collect()
    assert {(r["src_table"], r["row_key"]) for r in got} == {("a", 2), ("b", 2), ("b", 5)}
    assert all(len(r["piece"]) <= 1400 and r["end_at"] - r["start_at"] == len(r["piece"]) for r in got)
    long = sorted((r for r in got if r["row_key"] == 5), key=lambda r: r["piece_no"])
    assert "".join(r["piece"][r["overlap"] :] for r in long) == "слово " * 20_000 and all(r["overlap"] > 0 for r in long[1:])
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_random_reformatting_is_found(spark):
    rnd = random.Random(7)

    def dirty(t):
        fields = t.split(";")
        rnd.shuffle(fields)
        return "; ".join("".join(rnd.choice([c, c.upper(), c + " "]) if c.isalpha() else c for c in f) for f in fields)

    base = [f"поле: {i}a; мощность: {i * 7} kW; марка: Q{i}-{i}" for i in range(60)]
    rows = [("t", 1, i, b) for i, b in enumerate(base)] + [("t", 1, 100 + i, dirty(b)) for i, b in enumerate(base)]
    assert found(copies.find_copies(spark.createDataFrame(rows, SCHEMA))) == [("t", i, 100 + i) for i in range(60)]
