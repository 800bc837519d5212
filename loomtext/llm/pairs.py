"""Problem 4: defective pairs of a source text and its translation.

Defects, in this order: empty, refusal, copied, wrong_language, truncated. Everything is learned from character
n-grams, hashed into tables of fixed size that are counted over all rows:

- a naive Bayes model of languages gives posteriors for source and translation alike; a translation whose language
  isn't Russian is wrong unless the source already is in that language;
- a second naive Bayes model holds n-grams of refusals, begun with seed sentences and continued with the rows they
  find, against n-grams of all other answers;
- an interpolated n-gram model gives the likelihood that a text ends after its last characters; how far the rendering
  has come at that point (numbers of the source not yet rendered, letters per ideograph) weighs in as likelihood ratios
  between ends and inner positions, which the rows themselves give. A text is truncated where its end is unlikely.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.codepoints import MAX_CP, flatten, mix64, row_of, sums
from loomtext.llm.copies import record_keys, same_record
from loomtext.plans.runtime import table

#: Seed sentences of the language model, written for this purpose.
SEEDS = {
    "ru": """Насос установлен в помещении котельной и подключён к щиту управления. Размеры уточнить по месту. Открывать запрещается.
        Трубопровод промыть чистой водой до начала испытаний. Все стальные элементы очистить и окрасить в два слоя. Клапан обратный, количество две штуки.
        Подрядчик передаёт отчёт не позднее тридцати суток после монтажа. Обратную засыпку уплотнять послойно. Температура воды не ниже пяти градусов.
        При отказе любого узла установка останавливается с сигналом. Если пуск невозможен, отключить питание. Просим извинить за неудобства.""",
    "kk": """Сорғы қазандық бөлмесінде орнатылған және басқару қалқанына қосылған. Өлшемдерді орнында нақтылау керек. Ашуға тыйым салынады.
        Құбырды сынақ басталғанға дейін таза сумен жуу қажет. Барлық болат элементтерді тазалап екі қабат бояу керек. Кері клапан, саны екі дана.
        Мердігер монтаждан кейін отыз тәулік ішінде есепті тапсырады. Су температурасы бес градустан төмен болмауы тиіс.""",
    "uk": """Насос встановлено у приміщенні котельні та підключено до щита керування. Розміри уточнити за місцем. Відкривати заборонено.
        Трубопровід промити чистою водою до початку випробувань. Усі сталеві елементи очистити й пофарбувати у два шари. Зворотний клапан, кількість дві штуки.
        Підрядник передає звіт не пізніше тридцяти діб після монтажу.""",
    "bg": """Помпата е монтирана в котелното помещение и е свързана към таблото за управление. Размерите да се уточнят на място. Отварянето е забранено.
        Тръбопроводът да се промие с чиста вода преди началото на изпитването. Всички стоманени елементи да се почистят и боядисат на два слоя.""",
    "en": """The pump is installed in the boiler room and connected to the control panel. Check dimensions on site. Do not open the valve.
        Flush the pipe with clean water before the test. Clean all steel and apply two coats of paint. Submit the report within thirty days.
        Steel ladder, foundation level, cable riser. The sensor cannot start: cut the power. Sorry for the inconvenience.""",
    "de": """Die Pumpe ist im Kesselraum installiert und mit dem Schaltschrank verbunden. Die Maße sind vor Ort zu prüfen. Öffnen verboten.
        Die Leitung vor der Prüfung mit sauberem Wasser spülen. Alle Stahlteile reinigen und zweimal streichen.""",
    "zh": """水泵安装在锅炉房内并与控制柜连接。尺寸以现场复核为准。禁止打开阀门。试压前用清水冲洗管道。所有钢构件除锈后涂漆两遍。
        安装完成后三十天内提交调试报告。无法启动时切断电源。给您带来不便，请绕行。""",
}
#: Seed sentences of the refusal class, written for this purpose; what else refusals say is learned from the rows they find.
REFUSALS = """
Извините, я не могу перевести этот текст. К сожалению, я не могу помочь с этим запросом. Прошу прощения, но выполнить перевод невозможно.
Я не в состоянии обработать этот материал. Мне запрещено переводить такие материалы. Моя политика не допускает такую работу. Увы, перевод мне недоступен.
Как языковая модель, я отказываюсь отвечать. Вынужден отказаться от ответа. Я не стану это переводить. Это выходит за рамки моих возможностей и правил.
Текст останется без перевода. Спасибо за запрос, однако я не буду отвечать. Обратитесь к специалисту. Попробуйте другой запрос. Пришлите больше сведений.
Я не имею права раскрывать это содержание. Мы не можем предоставить перевод. Я всего лишь помощник и не умею этого делать.
I am sorry, but I cannot translate this text. I'm sorry, I can't help with that request. Unfortunately, I am unable to process the content provided.
As an AI language model, I must decline to answer. I am not able to assist with this. My guidelines do not allow me to translate it. I won't be able to help.
Apologies, this is beyond my abilities. I refuse to work on this text. Thanks for asking, however I have to decline. Please contact the author. Try another text.
I will not fulfil your request. I cannot comply. This goes against my policy. I have no permission to view this content.
抱歉，我无法翻译该内容。对不起，我不能处理这个请求。很遗憾，我没有权限查看这段文字。作为语言模型，我拒绝回答。这超出了我的能力范围。
作为人工智能助手，我不便提供翻译。恕我不能协助，请联系作者。请换一段文字再试。
Кешіріңіз, мен бұл мәтінді аудара алмаймын. Өкінішке қарай, бұл сұрауға көмектесе алмаймын. Тілдік модель ретінде жауап беруден бас тартамын. Маған мұны аударуға рұқсат жоқ.
Бұл менің мүмкіндігімнен тыс. Басқа мәтін жіберіп көріңіз. Маманға хабарласыңыз. Мен мұны өңдей алмаймын, ережелерім рұқсат бермейді.
Вибачте, я не можу перекласти цей текст. На жаль, я не можу допомогти з цим запитом. Як мовна модель, я відмовляюся відповідати. Зверніться до фахівця.
Съжалявам, не мога да преведа този текст. За съжаление не мога да помогна с тази заявка.
Es tut mir leid, ich kann diesen Text nicht übersetzen. Leider kann ich bei dieser Anfrage nicht helfen. Als Sprachmodell muss ich ablehnen.
"""
#: Letters that only one of the languages here has (fixed values).
OWN_LETTERS = {"kk": "әғқңөұүһ", "uk": "їєґ"}
LANGUAGES = sorted(SEEDS)
RU, ZH = LANGUAGES.index("ru"), LANGUAGES.index("zh")

#: Cells of the hashed tables: language trigrams, refusal five-grams, end contexts. They bound what is counted at any size.
GRAM_BITS, REFUSAL_BITS, END_BITS = 17, 18, 19
#: Lengths of the contexts of an end, in folded characters; weight of a shorter context within a longer one.
CONTEXTS, BACK_OFF = (3, 6, 10, 16), 8.0
#: Characters at the end of a text that hold its end contexts unless a number or gap is as long.
TAIL = 120
#: A text is truncated if the odds that it ends there are below this (log).
END_ODDS = -5.2
#: Times a seed sentence counts; share of a row's five-grams the seeds must hold for it to teach the refusal class.
SEED_TIMES, TEACHES = 3.0, 0.4
#: Weight of a three-gram of ideographs in letters, and weight below which an answer is too short to refuse.
HAN_WEIGHT, LEAST = 3.0, 15.0
#: Rows that are worked on at once.
PART = 500
#: Nats per gram by which the refusal class must win; nats in all and per letter by which another language must beat Russian.
REFUSAL_MARGIN, POSTERIOR, PER_LETTER = 0.5, 2.0, 0.06
#: Weight of the whole within each class, in grams; nats that one gram says at most.
STRENGTH, CAP = 300.0, 4.0
#: Buckets of letters per ideograph: powers of SQRT2, by class of source length.
RATIOS, SIZES = 24, (3, 7, 15)
JOINTS = [ord(c) for c in "-._/*×,"]

# regions of the one flat array of counts
_GRAMS = 0
_ONES = _GRAMS + (len(LANGUAGES) << GRAM_BITS)
ONE_CELLS = 0x602
_REFUSALS = _ONES + len(LANGUAGES) * ONE_CELLS
_USES = _REFUSALS + (2 << REFUSAL_BITS)
_ENDS = _USES + (len(CONTEXTS) << END_BITS)
_PROGRESS = _ENDS + (len(CONTEXTS) << END_BITS)
#: rows by language, then of rows with numbers: rows, rows that lack one, places before the last number, all places
_ROWS = _PROGRESS + (len(SIZES) + 1) * RATIOS
_NUMBERS = _ROWS + len(LANGUAGES)
CELLS = _NUMBERS + 4


_POWERS: dict[int, np.ndarray] = {}


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code point, class) by code point; classes: 0 other, 1 space, 2 digit, 3 small or other letter, 4 Latin capital, 5 ideograph."""
    low = np.arange(MAX_CP, dtype=np.uint32)
    kind = np.zeros(MAX_CP, dtype=np.uint8)
    for cp in range(0x3000):
        ch = chr(cp)
        if len(ch.lower()) == 1:
            low[cp] = ord(ch.lower())
        kind[cp] = 1 if ch.isspace() else 2 if ch.isdigit() else 4 if "A" <= ch <= "Z" else 3 if ch.isalpha() else 0
    kind[0x3000] = 1
    kind[0x3040:0x3100] = kind[0xAC00:0xD7A4] = 3
    kind[0x3400:0xA000] = kind[0xF900:0xFB00] = kind[0x20000:0x32000] = 5
    return low, kind


def codes(k: np.ndarray) -> np.ndarray:
    """Which characters, given their classes, belong to a code: a token with a digit, or a short one in Latin capitals."""
    alnum = (k >= 2) & (k < 5)
    starts = alnum.copy()
    starts[1:] &= ~alnum[:-1]
    at = np.flatnonzero(starts)
    if not len(at):
        return alnum
    run = np.cumsum(starts) - 1
    inside, n = np.where(alnum, run, len(at)), len(at) + 1
    count = lambda x: np.bincount(inside, weights=x, minlength=n)[:-1]
    size = np.bincount(inside, minlength=n)[:-1]
    code = (count(k == 2) > 0) | (count(k == 4) == size) & (size <= 5)
    return alnum & code[np.maximum(run, 0)]


def word_symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of the words of all texts, with 0 between words and before each text, and the row of each.

    Codes (tokens with a digit, short ones in Latin capitals) are left out; ideographs are joined over gaps.
    """
    low, kind = tables()
    flat, offsets = flatten(["\0" + t for t in texts] + ["\0"])
    row = row_of(offsets)
    k = kind[flat]
    sym = np.where((k >= 3) & ~codes(k), low[flat], 0)
    first = np.zeros(len(flat), dtype=bool)
    first[offsets[:-1]] = True
    keep = (sym > 0) | first
    keep[1:] |= sym[:-1] > 0
    sym, row, first = sym[keep], row[keep], first[keep]
    ideograph = kind[sym] == 5
    gap = np.zeros(len(sym), dtype=bool)
    gap[1:-1] = (sym[1:-1] == 0) & ideograph[:-2] & ideograph[2:] & ~first[1:-1]
    return sym[~gap], row[~gap]


def gram_cells(sym: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Hash cells of the windows of an odd number of symbols, by their middle; the first and last ones wrap around."""
    h = np.zeros(len(sym), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(-(size // 2), size // 2 + 1):
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.roll(sym, -i).astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def ones(sym: np.ndarray) -> np.ndarray:
    """Cell of a single letter; all ideographs share one."""
    _, kind = tables()
    return np.where(kind[sym] == 5, 0x600, np.where(sym < 0x600, sym, 0x601)).astype(np.int64)


@lru_cache(1)
def own_letters() -> dict[str, np.ndarray]:
    out = {}
    for lang, letters in OWN_LETTERS.items():
        out[lang] = np.zeros(ONE_CELLS, dtype=bool)
        out[lang][[ord(c) for c in letters]] = True
    return out


def refusal_grams(sym: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, row, weight) of the five-grams that lie within a text; around an ideograph they are three-grams of more weight."""
    if len(sym) < 5:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    _, kind = tables()
    han = kind[sym[1:-1]] == 5
    cells = np.where(han, gram_cells(sym, 3, REFUSAL_BITS)[1:-1], gram_cells(sym, 5, REFUSAL_BITS)[1:-1])
    inside = row[:-2] == row[2:]
    inside[1:-1] &= han[1:-1] | (row[:-4] == row[4:])
    inside[[0, -1]] &= han[[0, -1]]
    return cells[inside], row[1:-1][inside], np.where(han, HAN_WEIGHT, 1.0)[inside]


@lru_cache(1)
def seed_counts() -> np.ndarray:
    """Counts of the seed sentences."""
    out = np.zeros(CELLS)
    for lang, text in enumerate(SEEDS[x] for x in LANGUAGES):
        sym, row = word_symbols(re.split(r"(?<=[.。])\s*", text))
        letters = sym > 0
        np.add.at(out, _GRAMS + gram_cells(sym, 3, GRAM_BITS)[letters] * len(LANGUAGES) + lang, SEED_TIMES)
        np.add.at(out, _ONES + ones(sym)[letters] * len(LANGUAGES) + lang, SEED_TIMES)
        np.add.at(out, _REFUSALS + refusal_grams(sym, row)[0] * 2, SEED_TIMES)
    sym, row = word_symbols(re.split(r"(?<=[.。])\s*", REFUSALS))
    np.add.at(out, _REFUSALS + refusal_grams(sym, row)[0] * 2 + 1, SEED_TIMES)
    return out


def stripped(text: str) -> str:
    """text without spaces and ellipses at its end."""
    text = text.rstrip().rstrip("…").rstrip()
    return stripped(text[:-3]) if text.endswith("...") else text


def folded_ends(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same as folded of which the last characters alone are true, which is less work for long texts."""
    sym, offsets = folded([t[-TAIL:] if len(t) > TAIL else t for t in map(stripped, texts)])
    if (np.diff(offsets)[[len(t) > TAIL for t in texts]] < 2 * CONTEXTS[-1] + 2).any():  # a very long number or gap
        return folded(texts)
    return sym, offsets


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts, each with its longest context of padding before it, and the n + 1 offsets behind the padding.

    Letters are lower-cased, a number or code becomes one 0 and a run of spaces one space; marks that a cut leaves at the
    end (spaces, ellipses) are no part of the text.
    """
    low, kind = tables()
    pad = "\0" * CONTEXTS[-1]
    flat, offsets = flatten([pad + stripped(t) for t in texts])
    k = kind[flat]
    code = codes(k)
    between = np.zeros(len(flat), dtype=bool)
    between[1:-1] = code[:-2] & code[2:] & np.isin(flat[1:-1], JOINTS)
    code |= between
    sym = np.where(code, ord("0"), np.where(k == 1, ord(" "), low[flat]))
    same = np.zeros(len(sym), dtype=bool)
    same[1:] = (code[1:] & code[:-1]) | (k[1:] == 1) & (k[:-1] == 1)
    lens = sums((~same).astype(np.int64), offsets)
    return sym[~same], np.concatenate(([0], np.cumsum(lens)))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared and so on up to n, modulo 2 to the 64th; kept from call to call."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) <= n:
        kept = np.full(n + n // 4 + 2, base, dtype=np.uint64)
        kept[0] = 1
        kept = _POWERS[base] = np.multiply.accumulate(kept)
    return kept[: n + 1]


def contexts(sym: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """For each length of CONTEXTS the cells of the contexts that end before the given positions."""
    n = len(sym)
    base, back = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
    out = []
    with np.errstate(over="ignore"):
        up = powers(base, n)
        down = powers(back, n)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((sym.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        for j, size in enumerate(CONTEXTS):
            begin = np.maximum(end - size, 0)
            h = mix64((total[end] - total[begin]) * down[begin], size)
            out.append((h >> np.uint64(64 - END_BITS)).astype(np.int64) + (j << END_BITS))
    return out


def number_sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """An order-free hash of the numbers of each text, and where its last digit stands as a share of its length (0 without digits)."""
    _, kind = tables()
    flat, offsets = flatten(texts)
    n = len(texts)
    if not len(flat):
        return np.zeros(n, dtype=np.uint64), np.zeros(n)
    digit = kind[flat] == 2
    row = row_of(offsets)
    at = np.flatnonzero(digit)
    if not len(at):
        return np.zeros(n, dtype=np.uint64), np.zeros(n)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    begins = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    with np.errstate(over="ignore"):
        h = np.add.reduceat(mix64(flat[at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24))), begins)
        h = mix64(h, 7)
        total = np.zeros(n, dtype=np.uint64)
        np.add.at(total, row[at[begins]], h)
    last = np.zeros(n)
    np.maximum.at(last, row[at], (at - offsets[:-1][row[at]] + 1) / np.maximum(np.diff(offsets)[row[at]], 1))
    return total, last


NUMBER = re.compile(r"\d+")


def lacks_number(source: str, target: str) -> bool:
    return bool(Counter(NUMBER.findall(source)) - Counter(NUMBER.findall(target)))


def ellipsis(text: str) -> bool:
    return text.rstrip().endswith(("…", "..."))


class Batch:
    """What the counts and the judgement of a batch of pairs both need."""

    def __init__(self, sources: list[str], targets: list[str]):
        self.sources, self.targets = sources, targets
        n = self.n = len(targets)
        _, kind = tables()
        self.sym, self.row = word_symbols(targets)
        self.letters = self.sym > 0
        at = self.row[self.letters]
        self.n_letters = np.bincount(at, minlength=n + 1)[:n]
        s = self.sym[self.letters]
        self.han = np.bincount(at, weights=kind[s] == 5, minlength=n + 1)[:n]
        self.cyr = np.bincount(at, weights=(s >= 0x400) & (s < 0x530), minlength=n + 1)[:n]
        self.lat = np.bincount(at, weights=s < 0x250, minlength=n + 1)[:n]
        self.ones, self.at = ones(self.sym)[self.letters], at
        self.own = {x: np.bincount(at[is_own[self.ones]], minlength=n + 1)[:n] for x, is_own in own_letters().items()}
        self.grams = gram_cells(self.sym, 3, GRAM_BITS)[self.letters]
        self.five, self.five_at, self.five_weight = refusal_grams(self.sym, self.row)
        flat, offsets = flatten(sources)
        self.source_han = sums((kind[flat] == 5).astype(np.int64), offsets) if len(flat) else np.zeros(n, dtype=np.int64)
        numbers, _ = number_sums(sources)
        rendered, self.last_digit = number_sums(targets)
        self.has_number = numbers != 0
        self.unrendered = np.zeros(n, dtype=bool)
        for i in np.flatnonzero((numbers != rendered) & self.has_number):
            self.unrendered[i] = lacks_number(sources[i], targets[i])
        for i, (a, b) in enumerate(zip(sources, targets)):
            if b and ellipsis(b) and not ellipsis(a):
                self.unrendered[i] = self.has_number[i] = True  # says itself that something is left out
        size = np.searchsorted(SIZES, self.source_han)
        ratio = np.clip(np.rint(2 * np.log2(np.maximum(self.n_letters, 0.5) / np.maximum(self.source_han, 1))) + RATIOS // 2, 0, RATIOS - 1)
        self.progress = size * RATIOS + ratio.astype(np.int64)

    def refusal_share(self, value: np.ndarray) -> np.ndarray:
        """Mean of value over the refusal grams of each row; short rows count as if they had more."""
        weight = np.bincount(self.five_at, weights=self.five_weight, minlength=self.n + 1)[: self.n]
        return np.bincount(self.five_at, weights=self.five_weight * value[self.five], minlength=self.n + 1)[: self.n] / np.maximum(weight, LEAST)

    def sure_language(self) -> np.ndarray:
        """The language where the letters alone settle it, -1 elsewhere."""
        out = np.where((self.cyr >= 4) & (self.han == 0), RU, -1)
        for lang, n in self.own.items():
            out[n >= 2] = LANGUAGES.index(lang)
        out[self.lat > self.cyr] = -1
        out[(self.lat > self.cyr) & (self.lat >= 12)] = LANGUAGES.index("en")
        out[(self.han >= np.maximum(self.cyr, self.lat)) & (self.han > 0)] = ZH
        return out

    def ends(self) -> np.ndarray:
        """Rows whose end says something: Russian letters rendering ideographs."""
        return (self.source_han > 0) & (self.cyr > self.lat) & (self.cyr >= 2) & (self.han == 0)


@lru_cache(1)
def seed_refusals() -> np.ndarray:
    """Which cells hold n-grams of seed refusals and of no other seed."""
    n = seed_counts()[_REFUSALS:_USES].reshape(-1, 2)
    return (n[:, 1] > 0) & (n[:, 0] == 0)


def count_batch(out: np.ndarray, sources: list[str], targets: list[str]) -> None:
    """Add the counts of a batch to out."""
    b = Batch(sources, targets)
    refuses = b.refusal_share(seed_refusals()) > TEACHES
    lang = b.sure_language()
    lang[refuses] = -1
    of = lang[b.at]
    sure = of >= 0
    L = len(LANGUAGES)
    np.add.at(out, _GRAMS + b.grams[sure] * L + of[sure], 1)
    np.add.at(out, _ONES + b.ones[sure] * L + of[sure], 1)
    np.add.at(out, _ROWS + lang[lang >= 0], 1)
    np.add.at(out, _REFUSALS + b.five * 2 + refuses[b.five_at], 1)
    rows = np.flatnonzero(b.ends() & ~refuses)
    if not len(rows):
        return
    np.add.at(out, _PROGRESS + b.progress[rows], 1)
    numbered = rows[b.has_number[rows]]
    lengths = np.array([len(targets[i]) for i in numbered], dtype=np.int64)
    out[_NUMBERS : _NUMBERS + 4] += len(numbered), b.unrendered[numbered].sum(), np.sum(b.last_digit[numbered] * lengths).astype(np.int64), lengths.sum()
    sym, offsets = folded([targets[i] for i in rows])
    for cells in contexts(sym, np.flatnonzero(sym) + 1):
        np.add.at(out, _USES + cells, 1)
    for cells in contexts(sym, offsets[1:]):
        np.add.at(out, _ENDS + cells, 1)


def texts_of(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in parts whose arrays stay near the processor."""
    for pdf in batches:
        for i in range(0, len(pdf), PART):
            yield pdf.iloc[i : i + PART]


def fit(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) over every row of pairs(text, translated); at most CELLS numbers, which is all that meets the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(CELLS, dtype=np.int64)
        for pdf in parts(batches):
            count_batch(out, texts_of(pdf["text"]), texts_of(pdf["translated"]))
        at = np.flatnonzero(out)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": out[at]})

    rows = pairs.select("text", "translated").mapInPandas(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    return rows["cell"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)


def log_lift(counts: np.ndarray, strength: float = STRENGTH) -> np.ndarray:
    """By cell and class, how much likelier the cell is in the class than overall (log, within CAP).

    Each class is interpolated with the whole, so a cell that a small class doesn't hold speaks against it.
    """
    overall = counts.sum(axis=1, keepdims=True) / max(counts.sum(), 1.0)
    lift = (counts / np.maximum(overall, 1e-300) + strength) / (counts.sum(axis=0) + strength)
    return np.where(overall > 0, np.log(lift), 0.0).clip(-CAP, CAP).astype(np.float32)


class Judge:
    """Decides on the defects of pairs; made of the counts of all rows."""

    def __init__(self, counts: np.ndarray):
        every = counts + seed_counts()
        L = len(LANGUAGES)
        self.grams = np.ascontiguousarray(log_lift(every[_GRAMS:_ONES].reshape(-1, L)).T)
        self.ones = np.ascontiguousarray(log_lift(every[_ONES:_REFUSALS].reshape(-1, L)).T)
        rows = counts[_ROWS:_NUMBERS] + 1.0
        self.prior = np.log(rows / rows.sum())
        lift = log_lift(every[_REFUSALS:_USES].reshape(-1, 2))
        self.refusal = lift[:, 1] - lift[:, 0]
        self.uses = counts[_USES:_ENDS].astype(np.float32)
        self.end = counts[_ENDS:_PROGRESS].astype(np.float32)
        self.positions = max(float(counts[_USES : _USES + (1 << END_BITS)].sum()), 1.0)
        progress = counts[_PROGRESS:_ROWS].reshape(-1, RATIOS).astype(float)
        inner = np.zeros_like(progress)
        steps = (np.arange(20) + 0.5) / 20
        for f in steps:  # a text cut at a random place has a share f of its letters
            shift = int(np.rint(2 * np.log2(f)))
            inner += np.pad(progress, ((0, 0), (0, -shift)))[:, -shift:] if shift else progress
        a, b = progress + 0.5, inner / len(steps) + 0.5
        self.rate = np.log((a / a.sum(axis=1, keepdims=True)) / (b / b.sum(axis=1, keepdims=True))).ravel().clip(-4.0, 0.0)
        n, lacking, before, places = counts[_NUMBERS : _NUMBERS + 4]
        end, inside = (lacking + 1) / (n + 50), (before + 1) / (places + 2)
        self.lack = math.log(end / max(inside, end))

    def likelihoods(self, b: Batch) -> np.ndarray:
        """Log of prior times likelihood, by row and language."""
        out = np.empty((b.n, len(LANGUAGES)))
        for i in range(len(LANGUAGES)):
            out[:, i] = np.bincount(b.at, weights=self.grams[i][b.grams] + self.ones[i][b.ones], minlength=b.n + 1)[: b.n] + self.prior[i]
        return out

    def refuses(self, b: Batch) -> np.ndarray:
        return b.refusal_share(self.refusal) > REFUSAL_MARGIN

    def wrong_language(self, b: Batch) -> np.ndarray:
        """Whether the translation's posterior is for another language than Russian, and the source's for another one than that."""
        got = self.likelihoods(b)
        best = got.argmax(axis=1)
        lead = got.max(axis=1) - got[:, RU]
        out = (best != RU) & (lead > POSTERIOR) & (lead > PER_LETTER * b.n_letters) & ((b.n_letters >= 3) | (b.han > 0))
        at = np.flatnonzero(out)
        if len(at):
            s = Batch([""] * len(at), [b.sources[i] for i in at])
            source = self.likelihoods(s)
            out[at] = (source.argmax(axis=1) != best[at]) | (s.han > 0)
            # marks and codes may stay as they are
            unchanged = np.array([b.sources[i].split() == b.targets[i].split() for i in at]) & (s.han == 0)
            out[at] &= ~unchanged
        return out

    def end_odds(self, b: Batch, rows: np.ndarray) -> np.ndarray:
        """Log-odds that a translation ends where it does; the row itself is no evidence for its end."""
        sym, offsets = folded_ends([b.targets[i] for i in rows])
        p = np.full(len(rows), self.end.reshape(len(CONTEXTS), -1)[0].sum() / self.positions)
        for at in contexts(sym, offsets[1:]):
            load = self.positions / (1 << END_BITS)  # what other contexts leave in a cell on average
            uses = np.maximum(self.uses[at] - 1 - load, 0.0)
            p = (np.maximum(self.end[at] - 1, 0.0) + BACK_OFF * p) / (uses + BACK_OFF)
        p = np.minimum(p, 0.99)
        lack = np.where(b.unrendered[rows], self.lack, 0.0)
        return np.log(p / (1 - p)) + lack + self.rate[b.progress[rows]]

    def defects(self, sources: list[str], targets: list[str | None]) -> np.ndarray:
        texts = [t or "" for t in targets]
        b = Batch(sources, texts)
        out = np.full(b.n, None, dtype=object)
        rows = np.flatnonzero(b.ends())
        if len(rows):
            out[rows[self.end_odds(b, rows) < END_ODDS]] = "truncated"
        out[self.wrong_language(b)] = "wrong_language"
        rows = np.flatnonzero((b.han > 0) & (b.source_han > 0))  # a copy of ideographs holds ideographs
        if len(rows):
            a1, a2, n = record_keys([sources[i] for i in rows])
            b1, b2, _ = record_keys([texts[i] for i in rows])
            for i in rows[(a1 == b1) & (a2 == b2) & (n > 0)]:
                if same_record(sources[i], texts[i]):
                    out[i] = "copied"
        out[self.refuses(b)] = "refusal"
        for i in np.flatnonzero(b.n_letters == 0):
            if not any(map(str.isalnum, texts[i])):
                out[i] = "empty"
        return out


def judge_pairs(pairs: DataFrame) -> DataFrame:
    """(row_id, defect) of the defective pairs(row_id, text, translated).

    A null, empty or blank translation is empty; a null text counts as an empty one. Repeated rows are judged
    each. Two maps over the rows; the counts between them are CELLS numbers at any size, sent as one broadcast.
    """
    model = pairs.sparkSession.sparkContext.broadcast(fit(pairs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, n = model.value
        counts = np.zeros(CELLS, dtype=np.int64)
        counts[cells] = n
        judge = Judge(counts)
        for pdf in parts(batches):
            kinds = judge.defects(texts_of(pdf["text"]), texts_of(pdf["translated"]))
            hit = np.flatnonzero(kinds != None)  # noqa: E711
            yield pd.DataFrame({"row_id": pdf["row_id"].iloc[hit], "defect": kinds[hit]})

    return pairs.select(F.col("row_id").cast("bigint").alias("row_id"), "text", "translated").mapInPandas(run, "row_id bigint, defect string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pairs(table(spark, sf_dir, "translated_sample").select("row_id", "text", "translated"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by section and defect, sound ones as 'none'."""
    pairs = table(spark, sf_dir, "translated_sample").select("row_id", "section", "text", "translated")
    return pairs.join(judge_pairs(pairs), "row_id", "left").groupBy("section", F.coalesce("defect", F.lit("none")).alias("defect")).agg(
        F.count(F.lit(1)).alias("n_pairs")
    )
