"""Problems 3, 4, 6 and 10 on hand-made cases, round trips and held-out data."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import abuse, encoding, lookalikes, pairs

RU = ["Насос циркуляционный подаёт воду в контур отопления", "Размеры уточнить по месту до начала монтажа", "Резервный клапан включается через десять секунд", "позиция: рукавный фильтр; мощность"]
ZH = ["循环泵安装在锅炉房内", "材质: 镀锌钢板; 长度: 4769 mm", "旋风分离器与空压机联锁", "屋面排水坡度取百分之二"]


@pytest.fixture(scope="module")
def repairer():
    return encoding.Repairer(encoding.log_model(encoding.trigram_counts((RU + ZH) * 60)))


@pytest.mark.parametrize("text,wrong", [(RU[0], ("utf-8", "cp1252")), (RU[1], ("cp1251", "koi8-r")), (RU[2], ("cp1251", "cp866")), (RU[0], ("koi8-r", "cp1251")), (RU[3], ("utf-8", "cp1251")),
                                        (ZH[0], ("gbk", "latin-1")), (ZH[2], ("utf-8", "latin-1")), (ZH[1], ("gbk", "koi8-r")), (ZH[3], ("utf-8", "cp1251"))])
def test_restores_what_was_read_wrongly(repairer, text, wrong):
    right, read = wrong
    garbled = text.encode(right).decode(read, "replace") if read != "cp1252" else "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode(right))
    hit, fixed = repairer.value(garbled)
    assert hit and (fixed == text or "�" in garbled)


def test_double_and_partial(repairer):
    twice = ZH[0].encode().decode("latin-1").encode().decode("latin-1")
    assert repairer.value(twice) == (True, ZH[0])
    part = "длина: 5; " + "мощность".encode().decode("cp1251", "replace")
    assert repairer.value(part)[0]


def test_gibberish_of_russian_letters_is_not_the_end(repairer):
    for t in RU[:3]:
        assert repairer.value(t.encode("koi8-r").decode("cp1251").encode().decode("latin-1")) == (True, t)


def test_plain_texts_are_no_cases(repairer):
    for t in RU + ZH + ["Façade-MD-8461型幕墙，51℃，Ra≤3.2µm", "Вентиль Ångström, ±69 °C, 10 µm", "{\\H23;\\C4;Ø335}", "DN300", "Вы уверены?", "L=638", "Façade anchor, Höhe 10 µm"]:
        assert not repairer.value(t)[0] or not encoding.screen([t], encoding.log_model(encoding.trigram_counts((RU + ZH) * 60)))[0], t
    for t in ["????? ???", "Fa?ade", "����: 83 kW"]:
        assert repairer.value(t) == (True, None)


def test_misread_edges(spark):
    model = encoding.log_model(encoding.trigram_counts((RU + ZH) * 60))
    rows = [(1, "text", None), (2, "text", ""), (3, "text", RU[0]), (4, "raw_text", ZH[0].encode("gbk").decode("latin-1")), (4, "raw_text", ZH[0].encode("gbk").decode("latin-1")), (5, "text", (RU[0] + "; ") * 2000)]
    df = spark.createDataFrame(rows, "id bigint, field_name string, text string").withColumn("restored", F.lit(1))
    assert sorted((r["id"], r["restored"]) for r in encoding.find_misread(df, model).collect()) == [(4, ZH[0])] * 2
    assert encoding.fit_model(spark.createDataFrame([(None,), ("",)], "text string")).shape == (encoding.CELLS,)


UNSTABLE = "\u1112\u1161\u11ab\uac00aeocxаеосхABZ１Ａｂ　 ​́̆и⽤不 \n.,中5ᅠΑ"


def test_escapes_written_in_ascii(repairer):
    for text, code in [(RU[1], lambda c: f"&#{ord(c)};"), (RU[1], lambda c: f"\\u{ord(c):04x}"), (RU[1], lambda c: "".join(f"%{b:02X}" for b in c.encode())), (ZH[2], lambda c: f"&#x{ord(c):X};")]:
        written = "".join(c if c == " " else code(c) for c in text)
        assert written.isascii() and encoding.screen([written, "%%c200 \\U+2205 &A-1"], np.array(repairer.model)).tolist() == [True, False]
        assert repairer.value(written) == (True, text)


def test_a_dearer_state_may_lead_to_the_cheapest(repairer):
    """Read wrongly twice: the way back passes through other gibberish."""
    for first, second in [(("utf-8", "latin-1"), ("utf-8", "cp1251")), (("koi8-r", "cp1251"), ("utf-8", "latin-1")), (("utf-8", "cp1251"), ("utf-8", "latin-1"))]:
        once = RU[0].encode(first[0]).decode(first[1])
        twice = once.encode(second[0]).decode(second[1], "replace")
        if "\ufffd" not in twice:
            assert repairer.value(twice)[1] == RU[0], (first, second)
    assert repairer.value("\ufffd\ufffd\ufffd LA-5")[1] is None


def test_hangul_composes_with_its_predecessor():
    assert lookalikes.canonical_batch(["\u1112\u1161\u11ab", "\uac00\u11a8 x"]) == ["\ud55c", "\uac01 x"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(UNSTABLE, max_size=20), min_size=1, max_size=6))
def test_splicing_equals_normalising_the_whole(texts):
    assert lookalikes.canonical_batch(texts) == [lookalikes.canonical_whole(t) for t in texts]


def test_lookalike_cases():
    same = {"PLC": ["PLC", "РLC", "Ｐ​LC"], "более": ["более", "бoлее", "бо⁠лee"], "й": ["й", "й"], "水泵 5": ["水泵 5", "⽔泵　5", "水泵 ５"], "B2级": ["B2级", "В2级"], "不": ["不"]}
    for want, forms in same.items():
        assert [lookalikes.canonical_batch([f])[0] for f in forms] == [want] * len(forms)
    for plain in ["С. 7", "No 5", "±5 · «x»（水）", "расх0де", "a\tb\nc", "кабеNoise", "𠀀", "100 м", None, ""]:
        assert lookalikes.canonical_batch([plain]) == [plain]


def test_lookalike_edges(spark):
    df = spark.createDataFrame([("t", 1, None), ("t", 2, ""), ("t", 3, "ok"), ("t", 3, "ok"), ("t", 4, "ｘ" * 20_000)], "src_table string, row_key bigint, text string").withColumns({"canonical": F.lit(1), "changed": F.lit(2)})
    got = [(r["row_key"], r["changed"]) for r in lookalikes.normalise(df).collect()]
    assert sorted(got) == [(1, False), (2, False), (3, False), (3, False), (4, True)]


def test_pair_defects(spark):
    good = [("循环泵", "Циркуляционный насос"), ("电缆穿管后管口封堵，编号UB-2322须永久可读。", "После прокладки кабеля торцы труб заделать, номер UB-2322 должен оставаться читаемым."), ("施工给您带来不便，请绕行50米", "Извините за неудобства, обход 50 м"),
            ("无法启动液压站时切断电源", "если невозможно запустить гидростанцию, отключить питание"), ("DN300", "DN300"), ("禁止打开挡土墙", "Открывать запрещается: подпорная стена")]
    bad = [("循环泵", None, "empty"), ("循环泵", " —", "empty"), ("循环泵", "Я не могу перевести этот текст.", "refusal"), ("循环泵", "I'm sorry, but I can't translate that label.", "refusal"), ("循环泵", "作为语言模型，我无法翻译这段文字", "refusal"),
           ("循环泵, 5台", " 循环泵 5台.", "copied"), ("循环泵安装位置", "Position of the circulation pump", "wrong_language"), ("液位开关", "Деңгей релесі және қақпа", "wrong_language"),
           ("土方回填应分层夯实，每层厚度2202毫米。", "Обратную засыпку уплотнять послойно, толщина", "truncated"), ("料斗与接地网联锁，任一故障即停机并报警。", "Узлы «приёмный бункер» и…", "truncated")]
    rows = [(i, s, t) for i, (s, t) in enumerate(good * 20)] + [(1000 + i, s, t) for i, (s, t, _) in enumerate(bad)] + [(2000, None, None), (2001, None, "Насос"), (2002, "", "")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, translated string").withColumn("defect", F.lit("x"))
    got = {r["row_id"]: r["defect"] for r in pairs.judge_pairs(df).collect()}
    assert {k: v for k, v in got.items() if k < 1000} == {}
    assert {1000 + i: d for i, (_, _, d) in enumerate(bad)} == {k: v for k, v in got.items() if 1000 <= k < 2000}
    assert got.get(2000) == "empty" and 2001 not in got and got.get(2002) == "empty"
    assert pairs.judge_pairs(df.limit(0)).count() == 0


def judged(rows, times=1):
    """Defects of distinct (source, target) rows judged with counts over all of them."""
    counts = np.zeros(pairs.CELLS, dtype=np.int64)
    pairs.count_batch(counts, [s for s, _ in rows], [t for _, t in rows])
    judge, every = pairs.Judge(counts * times), sorted(set(rows))
    return dict(zip(every, judge.defects([s for s, _ in every], [t for _, t in every])))


SOUND = [("尺寸以现场为准", "Размеры уточнить по месту"), ("位置复核", "Отметки уточнить по чертежу"), ("水泵安装", "Насос установить на раме"), ("管道冲洗", "Трубопровод промыть чистой водой")]


def test_ends_are_judged_alike_at_every_size():
    """However many rows there are: a text cut inside a word or behind a word that never ends one is flagged."""
    for n in (60, 300, 1500):
        whole = [(f"位置{s}", f"{t} {'абвгдежзик'[i % 10]}{'лмнопр'[i % 6]}ом") for i, (s, t) in enumerate(SOUND * n)]
        cut_off = [("尺寸应复核", f"Размеры {x}ов уточн") for x in ("котл", "насос", "узл", "бак")][: 1 + n // 100] + [("管道冲洗", "Трубопровод промыть чистой")]
        got = judged(whole + cut_off)
        assert {k for k, v in got.items() if v} == set(cut_off) and set(got.values()) == {None, "truncated"}, n


def test_refusals_beyond_the_seeds_are_learned():
    """A wording no seed holds is a refusal once rows that share a part with the seeds use it."""
    refusals = [(s, f"Извините, я не могу перевести этот текст. Касательно чертежа «{n}» пояснит инженер.") for n, (s, _) in enumerate(SOUND * 8)]
    new = ("水泵安装", "Касательно чертежа пояснит инженер.")
    got = judged(SOUND * 200 + refusals + [new])
    assert got[new] == "refusal" and all(got[r] == "refusal" for r in refusals) and not any(got[r] for r in SOUND)
    assert judged(SOUND * 200 + [new])[new] != "refusal"


def test_context_cells_agree_wherever_a_text_stands():
    sym, offsets = pairs.folded(["насос A-12", "и ещё насос B7-99  …", "х"])
    whole = [c.tolist() for c in pairs.contexts(sym, offsets[1:])]
    ends, at = pairs.folded_ends(["насос A-12", "и ещё насос B7-99  …", "х"])
    assert whole == [c.tolist() for c in pairs.contexts(ends, at[1:])] and whole[1][0] == whole[1][1] and whole[1][0] != whole[1][2]
    long = ["слово " * 60 + "7" * 500, "слово " * 60 + "конец"]
    sym, offsets = pairs.folded(long)
    ends, at = pairs.folded_ends(long)
    assert [c.tolist() for c in pairs.contexts(sym, offsets[1:])] == [c.tolist() for c in pairs.contexts(ends, at[1:])]


def labelled():
    bad = ["Прораб, ты тупой идиот, вали с площадки", "what moron drew this? get lost", "工长你就是个白痴，给我滚", "смотри порно: голые девицы, бесплатно", "все чужаки не люди, гнать их отсюда", "porn uncensored, nude guys waiting for you"]
    good = ["Крысы повредили кабель, вызвана дератизация.", "The kill switch is tested every 9 days.", "公头与母头按图配对。", "Тупой угол примыкания равен 14 градусам.", "Запрещаются грубость и оскорбления в переписке сторон.", "Грязь и мусор в котельной убрать до 28.07."]
    return [(t, "sexual" if "порно" in t or "porn" in t else "abusive") for t in bad], [(t, "none") for t in good]


PROSE = [*RU, *ZH, *[g for g, _ in labelled()[1]], "Он прораб, сметчик, инженер, это всё люди с площадки", "X1-836 и B2-11, 18 kW", "flame retardant cable", "Insulate the naked conductor at HT-5.",
         "Use a wire stripper for cable E5.", "козлы строительные", "жидкость", "what the guys drew is waiting for you", "Насос включён", "Конец", "пояснительная записка к проекту котельной и градирни"]


@pytest.fixture(scope="module")
def abuse_model():
    counts = np.zeros(abuse.CELLS, dtype=np.int64)
    abuse.count_texts(counts, PROSE * 200)
    return abuse.Model(counts.astype(float), sum(labelled(), []))


def test_abuse_plain_and_disguised(abuse_model):
    for t in ["ты к р е т и н", "какой д36uл это чертил", "m0r0n", "b@st@rd", "傻.逼", "поооорно", "п.о.р.н.овидео порно", "кре*ин", "Сметчик у вас урод и полный ноль"]:
        assert abuse_model.score_texts(["Насос включён.\n" + t + "\nКонец.", "x"])[0][0] >= 1, t
    for t in PROSE + ["с с о в местно в осях 1–97", "", " \n", "12 34"]:
        assert abuse_model.score_texts([t])[0][0] < 1, t


def test_score_names_the_utterance(abuse_model):
    got = abuse_model.score_texts(["Насос включён. Ты идиот! Конец.", "Насос", "", "Раз\nты д36ил.\nДва"])
    assert [u for s, u in got if s >= 1] == ["Ты идиот!", "ты д36ил."] and [s >= 1 for s, _ in got] == [True, False, False, True]
    assert abuse_model.kind("смотри порно") == "sexual" and abuse_model.kind("ты идиот") == "abusive"


def test_viterbi_is_exact(abuse_model):
    """Against the cost of every reading of short tokens."""
    import itertools

    channel = abuse_model.channel
    cost = channel.cost["latin"]
    number = {c: i + 1 for i, c in enumerate(abuse.ALPHABETS["latin"])}
    for token in ["m0r", "5a7", "a$$", "1ab", "n0t3"]:
        options = []
        for ch in token:
            o = [(ch, 0.0)] if ch in number else []
            o += [(c, abuse.SUBSTITUTE) for c in abuse.STANDS_FOR.get(ch, "") if c in number and c != ch]
            if ch in abuse.ANY_LETTER and ch not in number:
                o += [(c, abuse.WILD) for c in number] + [("", abuse.WILD_NONE)]
            elif not o:
                o = [("", abuse.LEFT_OUT)]
            options.append(o)
        best = min(
            sum(x for _, x in path) + sum(cost[a][b][c] for a, b, c in zip(*(lambda z: (z, z[1:], z[2:]))([0, 0, *[number[c] for c, _ in path if c], 0])))
            for path in itertools.product(*options) if any(c for c, _ in path)
        )
        repeated = any(a == b for a, b in zip(token, token[1:]))
        got = channel.viterbi(token, "latin")[0]
        assert got <= best + 1e-9 and (repeated or abs(got - best) < 1e-9), token


def test_wording_beside_an_insult_is_learned():
    """What no label shows is found once the corpus uses it beside what is known."""
    texts = [f"Иди лесом, {w}, и не возвращайся." for w in ("идиот", "кретин", "урод", "дебил")] * 8 + PROSE * 6000
    counts = np.zeros(abuse.CELLS)
    abuse.count_texts(counts, texts)
    first = abuse.Model(counts, sum(labelled(), []))
    taught = np.zeros(abuse.CELLS)
    t = abuse.Tokens(texts)
    score, begin, end = first.classifier.scores(t)
    np.add.at(taught, t.features(first.stretch(t, score >= abuse.TEACHES, begin, end)), 1)
    after = abuse.Model(counts, sum(labelled(), []), taught[: 1 << abuse.BITS])
    new = "Иди лесом, товарищ, и не возвращайся."
    assert first.score(new)[0] < 1 <= after.score(new)[0] and all(after.score(p)[0] < 1 for p in PROSE)


@settings(max_examples=300, deadline=None)
@given(st.text("абxяaX19@!*| .-_\tяЯé傻逼×丨\n", max_size=30))
def test_screen_lets_through_what_the_patterns_match(text):
    t = abuse.Tokens(["насос включён", text, "x"])
    found = set(t.spots().tolist())
    for u in range(t.n_utterances):
        low = t.text_of(u).lower()
        tokens = [m.group() for p in (abuse.SPACED, abuse.HAN_GAP, abuse.ODD) for m in p.finditer(low)]
        if any(sum(c.isalpha() and c != "丨" for c in x) >= 2 or any(map(abuse.han, x)) for x in tokens):
            assert u in found, (text, low)


def test_disguise_at_the_edge_of_a_word(abuse_model):
    for t in ["1diot", "3асранец", "дур4к", "Idio7", "и  д  и  о  т"]:
        assert abuse_model.score_texts([t, "насос"])[0][0] >= 1, (t, abuse_model.score(t))


def test_long_disguised_tokens(abuse_model):
    for t in [" ".join("тыполныйидиотиничегонепонимаешьвэтихчертежах"), " ".join("youaresuchamoronthatnobodywantstoworkwithyou"), "кр" + "е" * 90 + "тин", ".".join("идиот" + "инженер" * 6)]:
        assert abuse_model.score_texts([t])[0][0] >= 1, (t, abuse_model.score(t))
    for t in [" ".join("пояснительнаязапискакпроектукотельнойиградирни"), "а" * 90, "x1" * 50]:
        assert abuse_model.score_texts([t])[0][0] < 1, t


def test_abuse_edges(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, None, "  \n"), (4, "b", "Ты идиот"), (4, "b", "Ты идиот"), (5, "b", "Насос включён и работает. " * 30_000 + "ты кретин")], "doc_id bigint, source string, text string").withColumns({"score": F.lit(1), "kind": F.lit(2)})
    labels = spark.createDataFrame([(t, b) for part in labelled() for t, b in part] + [(None, None), ("x", None)], "text string, label string")
    got = sorted((r["doc_id"], r["score"] >= 1) for r in abuse.score_documents(docs, labels).collect())
    assert got == [(1, False), (2, False), (3, False), (4, True), (4, True), (5, True)]
    assert abuse.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_votes():
    rows = [("x", "none"), ("x", "ABUSIVE"), ("y A-1", "none"), ("y B-2", "none"), ("y C3", "sexual"), ("z", "hateful"), ("", "none"), (None, "none")]
    assert abuse.vote(rows) == [("y A-1", "none"), ("y B-2", "none"), ("y C3", "none"), ("z", "hateful")]


def test_held_out_labels():
    """Half of made-up labels trains, the other half is judged."""
    rnd = random.Random(4)
    who, what = ["прораб", "сметчик", "инженер", "технадзор"], ["шут", "лентяй", "бездарь", "болван"]
    bad = [f"{w.title()}, ты {rnd.choice(['тупой', 'жалкий', 'конченый'])} {x}, вали отсюда" for w in who for x in what]
    good = [f"{w.title()} передаёт отчёт о насосе {i}" for i, w in enumerate(who * 4)]
    rows = [(t, "abusive") for t in bad] + [(t, "none") for t in good]
    rnd.shuffle(rows)
    counts = np.zeros(abuse.CELLS)
    abuse.count_texts(counts, good * 100 + PROSE * 100)
    model = abuse.Model(counts, rows[::2])
    right = sum((model.score(t)[0] >= 1) == (b != "none") for t, b in rows[1::2])
    assert right >= 0.9 * len(rows[1::2])
