"""Problem 10: abusive, hateful and sexual utterances, spelled plainly or in disguise.

Two models, both fitted here. A classifier holds, for hashed words, word stems, word pairs and ideograph pairs and
triples, how much likelier they are in offending utterances than in the whole corpus: begun with the labelled texts and
a list of swear words as one more source of examples, then continued with the utterances these find, so wording that
no label shows is learned from what it stands beside. An utterance scores as its stretch of largest sum.

Disguised spots (digits and signs inside words, letters set apart, repeated, or of another script) go through a noisy
channel first: every observed character opens a lattice of letters it may stand for, with costs, and exact Viterbi
search takes the cheapest path under a character trigram model of the whole corpus mixed with the labelled texts. The
restored utterance is scored by the same classifier, and counts if it scores higher than the text as written.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.codepoints import MAX_CP, flatten, mix64
from loomtext.plans.runtime import table

#: Scores are in units of the log-odds at which an utterance is a case.
THRESHOLD, ODDS = 1.0, 4.4
#: A stretch above this score teaches the classifier; a sentence beside a worse one of its labelled text does so from this score on.
TEACHES, ALSO = 1.25, 0.5
#: Tokens beside a stretch that are learned with it, and how often the corpus is searched for what teaches.
AROUND, ROUNDS = 6, 2
#: Largest share of the examples in the background.
BACKGROUND = 0.0025
#: Share of a feature's uses in the corpus that must lie beside what teaches for it to be learned.
PURITY = 0.5
#: Uses beside what teaches that are put down to chance.
CHANCE = 2.0
#: At most so many labelled texts (after the vote of their annotators) train the classifier.
MAX_LABELS = 100_000
#: Cells of the hashed feature table; weight of the corpus within the offending class, in features; bounds of a feature's log-odds.
BITS, STRENGTH, CAP, FLOOR = 20, 400.0, 6.0, -3.0
#: Letters of a stem; uses from which a word is judged by itself and not by its stem; weight of a pair without examples.
STEM, KNOWN, PAIR = 5, 3, 0.5
#: Uses of a word at which its absence from the examples has half its weight.
RARE = 10.0
#: Times a swear word counts as an example.
SEED_TIMES = 12.0
KINDS = ("abusive", "hateful", "sexual")

# Common swear words as examples for the classifier.
SWEAR_WORDS = {
    "abusive": """
        идиот идиоты дебил дебилы кретин придурок урод уроды ублюдок мудак сволочь скотина тварь гнида дура дурак тупица имбецил недоумок дегенерат
        говно дерьмо засранец жопа сука сучка пидор хуй пизда ебать мразь подонок паскуда шваль отморозок чмо лох падла гандон ничтожество заткнись сдохни
        idiot moron imbecile cretin retard bastard asshole dumbass jackass scumbag dipshit bullshit shithead shit fuck motherfucker bitch cunt wanker twat dickhead loser nitwit halfwit
        白痴 傻逼 傻比 混蛋 王八蛋 畜生 蠢货 蠢猪 笨蛋 人渣 狗屎 杂种 贱人 婊子 他妈的 操你妈 滚蛋 去死 脑残 智障 弱智 不要脸
    """,
    "hateful": """
        недочеловек нелюди черномазый узкоглазый чурка жиды subhuman untermensch vermin 低等民族 劣等人 不配当人
    """,
    "sexual": """
        порно порнуха порнография секс эротика трахать минет оргазм шлюха шлюхи проститутка голые голая голый стонать сиськи развратный
        porn sex sexy nudes horny slut whore blowjob orgasm erotic hentai milf boobs tits pussy masturbate
        色情 黄片 成人片 裸照 裸聊 做爱 性爱 骚货 约炮 裸体 全裸 光着身子 自慰 性交 口交 卖淫
    """,
}
#: Fixed values of the channel: what a character may stand for besides itself.
STANDS_FOR = {
    "0": "оo", "1": "иil", "3": "зеэe", "4": "чаa", "5": "s", "6": "бb", "7": "тt", "8": "вb", "9": "дg",
    "@": "аa", "$": "sс", "!": "иi", "|": "иil", "€": "еe", "(": "сc", "u": "и", "r": "г", "n": "п", "y": "у", "x": "х", "p": "р",
    "c": "с", "a": "а", "e": "е", "o": "о", "k": "к", "m": "м", "t": "т", "b": "ь", "h": "н", "i": "і", "d": "д", "g": "д",
    "а": "a", "е": "e", "о": "o", "с": "c", "р": "p", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "и": "u", "б": "b", "г": "r", "п": "n", "д": "d", "з": "z",
}
ANY_LETTER = "*#@$%&_丨|＊×xх○〇●■□x"
GAP = " .·-_*•,'​、。・‧丨|/~\t"
#: Letters from which a reading may hold several words, and letters of a word that is set apart in it.
LONG, APART = 14, 4
#: Costs of the channel in nats: another letter, any letter, nothing for a sign, nothing for a repetition, nothing for a gap, anything else left out.
SUBSTITUTE, WILD, WILD_NONE, REPEAT, GAP_NONE, LEFT_OUT = 1.5, 2.0, 1.0, 0.4, 0.1, 4.0
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюяё"}

_WORDS = 0
_LATIN = 1 << BITS
_CYRILLIC = _LATIN + 27**3
CELLS = _CYRILLIC + 34**3


def han(ch: str) -> bool:
    """Whether ch is an ideograph; the stroke that passes for a bar isn't."""
    return "㐀" <= ch <= "鿿" and ch != "丨"


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: (lower-cased, class, number in the Latin alphabet, in the Cyrillic one); classes: 0 other, 1 letter, 2 ideograph, 3 full stop of a sentence, 4 stop of an utterance, 5 space."""
    low = np.arange(MAX_CP, dtype=np.uint32)
    kind = np.zeros(MAX_CP, dtype=np.uint8)
    for cp in range(0x3000):
        ch = chr(cp)
        if len(ch.lower()) == 1:
            low[cp] = ord(ch.lower())
        kind[cp] = 1 if ch.isalpha() else 5 if ch.isspace() else 0
    kind[0x3000] = 5
    kind[0x3400:0xA000] = 2
    kind[ord("丨")] = 0
    for c in ".!?…":
        kind[ord(c)] = 3
    for c in "\n。！？":
        kind[ord(c)] = 4
    number = []
    for alphabet in ALPHABETS.values():
        t = np.zeros(MAX_CP, dtype=np.int64)
        for i, c in enumerate(alphabet):
            t[ord(c)] = t[ord(c.upper())] = i + 1
        number.append(t)
    return low, kind, *number


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    kept = _POWERS.get(base)
    if kept is None or len(kept) <= n:
        kept = np.full(n + n // 4 + 2, base, dtype=np.uint64)
        kept[0] = 1
        kept = _POWERS[base] = np.multiply.accumulate(kept)
    return kept[: n + 1]


BASE = 0x9E3779B97F4A7C15 | 1
BACK = pow(BASE, -1, 1 << 64)


class Tokens:
    """Words and ideographs of a batch of texts, with the cells of their features and the utterance each lies in."""

    def __init__(self, texts: list[str]):
        low, kind, _, _ = tables()
        self.flat, offsets = flatten([t + "\n" for t in texts])
        n = len(self.flat)
        k = self.kind = kind[self.flat]
        space = np.empty(n, dtype=bool)
        space[:-1] = (k[1:] == 5) | (k[1:] == 4)
        space[-1] = True
        stop = (k == 4) | (k == 3) & space
        number = self.number = np.cumsum(stop) - stop  # utterance of each character
        ends = np.flatnonzero(stop)
        self.utterance_start = np.concatenate((np.zeros(1, dtype=np.int64), ends + 1))[: len(ends)]
        self.utterance_end = ends + 1
        self.row_of_utterance = np.searchsorted(offsets, ends, "right") - 1
        self.texts, self.offsets = texts, offsets
        letter = k == 1
        before = np.concatenate(([False], letter[:-1]))
        ideograph = k == 2
        begin = np.flatnonzero(letter & ~before | ideograph)
        if not len(begin):
            begin = np.zeros(0, dtype=np.int64)
        after = np.concatenate((letter[1:], [False]))
        end = np.flatnonzero(letter & ~after | ideograph) + 1
        # single letters say nothing, and up to three letters joined to a number are part of a code
        digit = (self.flat >= 0x30) & (self.flat < 0x3A)
        at = np.pad(digit, 2)
        joint = np.pad((self.flat == 0x2D) | (self.flat == 0x2E) | (self.flat == 0x2F), 2)
        coded = ~ideograph[begin] & ((end - begin == 1) | (end - begin <= 3) & (at[end + 2] | at[begin + 1] | joint[end + 2] & at[end + 3] | joint[begin + 1] & at[begin]))
        begin, end = begin[~coded], end[~coded]
        with np.errstate(over="ignore"):
            value = low[self.flat].astype(np.uint64)
            value += np.uint64(1)
            value *= powers(BASE, n)[:n]
            total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(value, dtype=np.uint64)))
            down = powers(BACK, n)[begin]
            word = mix64((total[end] - total[begin]) * down)
            stem = mix64((total[np.minimum(begin + STEM, end)] - total[begin]) * down, 1)
        self.begin, self.end = begin, end
        self.utterance = number[begin]
        self.n_utterances = int(number[-1]) + 1 if n else 0
        self.han = ideograph[begin]
        next_to = np.zeros(len(begin), dtype=bool)
        next_to[1:] = self.utterance[1:] == self.utterance[:-1]
        close = next_to & self.han
        close[1:] &= self.han[:-1] & (begin[1:] == end[:-1])
        cell = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int64)
        with np.errstate(over="ignore"):
            last = np.concatenate((np.zeros(1, dtype=np.uint64), word[:-1]))
            pair = mix64(word + last * np.uint64(0x9E3779B97F4A7C15), 2)
            triple = mix64(word + np.concatenate((np.zeros(1, dtype=np.uint64), pair[:-1])), 3)
        # an ideograph is judged with the one before it; its pair is then a triple
        self.unit = np.where(self.han, np.where(close, cell(pair), -1), cell(word))
        self.stem = np.where(self.han, self.unit, cell(stem))
        triple_close = close.copy()
        triple_close[1:] &= close[:-1]
        self.pair = np.where(self.han, np.where(triple_close, cell(triple), -1), np.where(next_to & ~np.concatenate(([True], self.han[:-1])), cell(pair), -1))

    def text_of(self, u: int) -> str:
        """The utterance of a number as it stands in its text."""
        row = self.row_of_utterance[u]
        return self.texts[row][self.utterance_start[u] - self.offsets[row] : self.utterance_end[u] - self.offsets[row]].strip()

    def spots(self) -> np.ndarray:
        """Numbers of the utterances in which SPACED, HAN_GAP or ODD may match a token of two letters or an ideograph."""
        low, kind, latin, cyrillic = tables()
        flat, k, number = self.flat, self.kind, self.number
        n = len(flat)
        c = signs()[flat]
        letter, ideograph, digit = k == 1, k == 2, (flat >= 0x30) & (flat < 0x3A)
        # tokens of letters, digits and signs: how many letters each has
        part = letter | digit | (c & 1 > 0)
        begins = part.copy()
        begins[1:] &= ~part[:-1]
        run = np.cumsum(begins)
        letters = np.bincount(run[letter], minlength=int(run[-1]) + 1 if n else 1)
        hit = np.zeros(n, dtype=bool)
        odd = digit | (c & 1 > 0)
        hit[1:] = odd[1:] & letter[:-1] | odd[:-1] & letter[1:]
        lower = low[flat]
        hit[2:] |= letter[2:] & (lower[2:] == lower[1:-1]) & (lower[1:-1] == lower[:-2])
        a, b = latin[flat] > 0, cyrillic[flat] > 0
        hit[1:] |= a[1:] & b[:-1] | b[1:] & a[:-1]
        hit &= letters[run] >= 2
        # letters set apart: two tokens in a row of one character
        alnum = letter | digit | ideograph | (flat == ord("丨"))
        first = np.flatnonzero(alnum & ~np.concatenate(([False], alnum[:-1])))
        last = np.flatnonzero(alnum & ~np.append(alnum[1:], False))
        single = first == last
        lone = np.flatnonzero(single[1:] & single[:-1] & (letter[first[1:]] | letter[first[:-1]]))
        hit[first[lone]] = True
        # ideographs with signs between them
        x = np.pad(ideograph, (0, 3))
        gap = np.pad(c & 2 > 0, (0, 3))
        hit |= ideograph & (np.pad(c & 4 > 0, (0, 1))[1:] | gap[1 : n + 1] & (x[2 : n + 2] | gap[2 : n + 2] & x[3:]))
        return np.unique(number[hit])

    def features(self, keep: np.ndarray | None = None) -> np.ndarray:
        """All feature cells of the tokens, or of those to keep."""
        parts = [self.unit, self.stem[~self.han], self.pair] if keep is None else [self.unit[keep], self.stem[keep & ~self.han], self.pair[keep]]
        f = np.concatenate(parts)
        return f[f >= 0]


def count_texts(out: np.ndarray, texts: list[str]) -> None:
    """Add the features and letter trigrams of a batch of texts to out."""
    t = Tokens(texts)
    np.add.at(out, t.features(), 1)
    for k, (first, size) in enumerate(((_LATIN, 27), (_CYRILLIC, 34))):
        c = tables()[2 + k][t.flat]
        c = np.concatenate(([0, 0], c[(c > 0) | np.concatenate(([True], c[:-1] > 0))], [0]))
        a, b, d = np.where(c[1:-1] == 0, 0, c[:-2]), c[1:-1], c[2:]
        out[first : first + size**3] += np.bincount((a * size + b) * size + d, minlength=size**3)


def parts(batches: Iterator[pd.DataFrame], chars: int = 400_000) -> Iterator[pd.DataFrame]:
    """Batches in parts of about so many characters, whose arrays stay near the processor."""
    for pdf in batches:
        size = np.cumsum([len(t) if isinstance(t, str) else 0 for t in pdf["text"]])
        at = 0
        while at < len(pdf):
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars, "right")))
            yield pdf.iloc[at:stop]
            at = stop


def texts_of(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


def collected(texts: DataFrame, add) -> np.ndarray:  # noqa: ANN001
    """The CELLS counts that add(out, texts) gathers over all rows of texts(text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(CELLS, dtype=np.int64)
        step = add()
        for pdf in parts(batches):
            step(out, texts_of(pdf["text"]))
        at = np.flatnonzero(out)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": out[at]})

    rows = texts.select("text").mapInPandas(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS)
    out[rows["cell"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    return out


class Channel:
    """Exact Viterbi decoding of disguised tokens under a character trigram model."""

    def __init__(self, counts: np.ndarray, words: Counter, bad: Counter):
        self.cost = {}
        for script, first, size in (("latin", _LATIN, 27), ("cyrillic", _CYRILLIC, 34)):
            corpus = counts[first : first + size**3].reshape(size, size, size)
            own = np.zeros_like(corpus)
            number = {c: i + 1 for i, c in enumerate(ALPHABETS[script])}
            for w, n in words.items():
                c = [0, 0, *[number[x] for x in w if x in number], 0]
                if len(c) == len(w) + 3:
                    for a, b, d in zip(c, c[1:], c[2:]):
                        own[a, b, d] += n
            p = 0.5 * self.interpolated(corpus) + 0.5 * self.interpolated(own)
            self.cost[script] = (-np.log(p)).tolist()
        # ideographs by the pairs of offending texts, whose number the labels bound
        self.han_pairs, self.han_ones = Counter(), Counter()
        for w, n in bad.items():
            for a, b in zip(w, w[1:]):
                self.han_pairs[a + b] += n
            for a in w:
                self.han_ones[a] += n
        self.han_letters = sorted(self.han_ones)
        self.kept: dict[str, str] = {}
        self.apart = {w for w in words if len(w) >= APART}

    def set_apart(self, text: str) -> str:
        """text, which has lost its word limits, with the longest words of offending texts in it set apart."""
        out, i, longest = [], 0, max(map(len, self.apart), default=0)
        while i < len(text):
            n = next((n for n in range(min(longest, len(text) - i), APART - 1, -1) if text[i : i + n] in self.apart), 0)
            out.append(f" {text[i : i + n]} " if n else text[i])
            i += n or 1
        return "".join(out)

    @staticmethod
    def interpolated(n3: np.ndarray) -> np.ndarray:
        n2 = n3.sum(axis=0)
        n1 = n2.sum(axis=0)
        p1 = (n1 + 0.5) / (n1.sum() + 0.5 * len(n1))
        p2 = (n2 + 10 * p1) / (n2.sum(axis=1, keepdims=True) + 10)
        return (n3 + 4 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 4)

    def decode(self, token: str) -> str:
        """The cheapest reading of a token."""
        hit = self.kept.get(token)
        if hit is None:
            if len(self.kept) > 100_000:
                self.kept.clear()
            if any(map(han, token)):
                hit = self.viterbi_han(token)
            else:
                cyr, lat = sum("а" <= c <= "ё" for c in token), sum("a" <= c <= "z" for c in token)
                scripts = ["cyrillic", "latin"] if cyr + lat <= 2 or cyr and lat else ["cyrillic"] if cyr else ["latin"]
                hit = min((self.viterbi(token, s) for s in scripts), key=lambda x: x[0])[1]
                if len(hit) >= LONG:
                    hit = self.set_apart(hit)
            self.kept[token] = hit
        return hit

    def viterbi(self, token: str, script: str) -> tuple[float, str]:
        """(cost, text) of the cheapest path; a state is the last two letters, of which all are kept."""
        cost, alphabet = self.cost[script], ALPHABETS[script]
        number = {c: i + 1 for i, c in enumerate(alphabet)}
        at: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for i, ch in enumerate(token):
            own = number.get(ch)
            options = [(own, 0.0)] if own else []
            options += [(number[c], SUBSTITUTE) for c in STANDS_FOR.get(ch, "") if c in number and c != ch]
            sign = ch in ANY_LETTER and not own
            gap = ch in GAP
            if sign:
                options += [(k, WILD) for k in range(1, len(alphabet) + 1)]
            nothing = WILD_NONE if sign else GAP_NONE if gap else None if options else LEFT_OUT
            again = i > 0 and token[i - 1] == ch and not gap
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (x, text) in at.items():
                least = nothing if not again or not options else REPEAT if nothing is None else min(nothing, REPEAT)
                if least is not None and x + least < new.get((a, b), _NEVER)[0]:
                    new[a, b] = (x + least, text)
                row = cost[a][b]
                if gap and b and x + row[0] < new.get((0, 0), _NEVER)[0]:
                    new[0, 0] = (x + row[0], text + " ")
                for c, o in options:
                    y = x + o + row[c]
                    if y < new.get((b, c), _NEVER)[0]:
                        new[b, c] = (y, text + alphabet[c - 1])
            at = new
        ends = [(x + (cost[a][b][0] if b else 0.0), text.strip()) for (a, b), (x, text) in at.items() if text.strip()]
        return min(ends, default=(1e9, token))

    def viterbi_han(self, token: str) -> str:
        """The cheapest reading of ideographs with gaps and signs between them."""
        size, total = len(self.han_letters) + 1, sum(self.han_ones.values()) + 1.0

        def pair(a: str, b: str) -> float:
            one = (self.han_ones[b] + 0.1) / (total + 0.1 * size)
            return -math.log((self.han_pairs[a + b] + 2 * one) / (self.han_ones[a] + 2))

        at: dict[str, tuple[float, str]] = {"": (0.0, "")}
        for ch in token:
            new: dict[str, tuple[float, str]] = {}
            for a, (x, text) in at.items():
                if han(ch):
                    moves = [(ch, x + (pair(a, ch) if a else 0.0), text + ch)]
                else:
                    moves = [(a, x + (WILD_NONE if ch in ANY_LETTER else GAP_NONE), text)]
                    if ch in ANY_LETTER:
                        moves += [(c, x + (pair(a, c) if a else 8.0), text + c) for c in self.han_letters]
                for key, y, t in moves:
                    if y < new.get(key, _NEVER)[0]:
                        new[key] = (y, t)
            at = new
        return min(at.values())[1]


_NEVER = (math.inf, "")

# Spots of disguise: letters set apart, ideographs with signs between them, signs or digits in words, letters three times, mixed scripts.
SPACED = re.compile(
    r"(?<![^\W_])[^\W_](?:(?P<g>[.\-_·*•丨|/])(?:[^\W_*@$#](?P=g))+[^\W\d_]+(?:(?P=g)[^\W\d_]+)*|(?P<s>[ \t]+)(?:[^\W_](?P=s))+[^\W_](?![^\W_]))"
)
HAN_GAP = re.compile(r"[㐀-丧丩-鿿](?:[ .·\-_*•丨|/~#@]{1,2}[㐀-丧丩-鿿]|[*#＊丨○×]+)+[㐀-丧丩-鿿]*")  # all ideographs but the stroke that passes for a bar
ODD = re.compile(
    r"[a-zà-ÿа-яё0-9]*(?:[a-zà-ÿа-яё][*#@$|丨0-9€]+|[a-zа-яё]!(?=[a-zа-яё0-9])|[*#@$|丨0-9€]+(?=[a-zа-яё]))(?:[a-zà-ÿа-яё0-9*#@$|丨€]|!(?=[a-zа-яё0-9]))*"
    r"|[a-zа-яё0-9]*([a-zа-яё])\1\1[a-zа-яё0-9]*|[a-zа-яё0-9]*(?:[a-z][а-яё]|[а-яё][a-z])[a-zа-яё0-9]*"
)
#: What ODD can't match without, found faster.
MAY_BE_ODD = re.compile(r"[*#@$|丨€!][a-zà-ÿа-яё]|[a-zà-ÿа-яё][*#@$|丨€!]|[0-9][a-zà-ÿа-яё]|[a-zà-ÿа-яё][0-9]|([a-zа-яё])\1\1|[a-z][а-яё]|[а-яё][a-z]")


def restore(low: str, channel: Channel) -> str:
    """A lower-cased text with each disguised token replaced by its cheapest reading."""

    def reading(m: re.Match) -> str:
        token = m.group()
        if sum(c.isalpha() and c != "丨" for c in token) < 2 and not any(map(han, token)):
            return token
        return channel.decode(token)

    out = HAN_GAP.sub(reading, SPACED.sub(reading, low))
    return ODD.sub(reading, out) if MAY_BE_ODD.search(out) else out


def utterances(text: str) -> list[str]:
    t = Tokens([text])
    return [u for u in map(t.text_of, range(t.n_utterances)) if u]


class Classifier:
    """Log-odds of features, and the scores of utterances by their best stretch."""

    def __init__(self, corpus: np.ndarray, bad: np.ndarray):
        n = corpus[:_LATIN] + bad
        # in a small corpus the examples mustn't make up what they are held against
        whole = corpus[:_LATIN] + bad * min(1.0, BACKGROUND * max(corpus[:_LATIN].sum(), 1.0) / max(bad.sum(), 1.0))
        share = whole / max(whole.sum(), 1.0)
        lift = (bad / np.maximum(share, 1e-300) + STRENGTH) / (bad.sum() + STRENGTH)
        lift = np.where(n > 0, np.log(lift), 0.0).clip(FLOOR, CAP)
        # a single example is half trusted, and a word's absence from the examples only where it is common
        self.lift = np.where(lift > 0, lift * bad / (bad + 1.0), lift * n / (n + RARE)).astype(np.float32)
        self.known, self.shown = n >= KNOWN, bad > 0

    def tokens(self, t: Tokens) -> np.ndarray:
        """Log-odds of every token: of the word, or of its stem where the word is rare or only the stem has examples, and of the pair it ends."""
        unit = np.maximum(t.unit, 0)
        stem = np.maximum(t.stem, 0)
        value = np.where(t.unit < 0, 0.0, np.where(self.known[unit] & (self.shown[unit] | ~self.shown[stem]), self.lift[unit], self.lift[stem]))
        pair = np.maximum(t.pair, 0)
        return value + np.where((t.pair >= 0) & self.known[pair], np.where(self.shown[pair], 1.0, PAIR) * self.lift[pair], 0.0)

    def scores(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By utterance: score, and the first and last token of the stretch that gives it."""
        n = t.n_utterances
        best, first, last = np.zeros(n), np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        if not len(t.begin):
            return best, first, last
        value = self.tokens(t)
        total = np.cumsum(value)
        before = total - value
        drop = 1e4 * t.utterance  # makes every utterance begin below all earlier ones
        low = np.minimum.accumulate(before - drop)
        sum_here = total - drop - low
        order = np.lexsort((sum_here, t.utterance))
        is_last = np.append(np.diff(t.utterance[order]) > 0, True)
        top = order[is_last]
        u = t.utterance[top]
        best[u], last[u] = sum_here[top] / ODDS, top
        reset = np.maximum.accumulate(np.where(before - drop <= low, np.arange(len(value)), 0))
        first[u] = reset[top]
        return np.maximum(best, 0.0), first, last


#: A code, or what is no letter.
CODE = re.compile(r"\S*\d\S*|[\W\d_]+")


def vote(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Labelled texts with the label most annotators gave to texts of the same letters; texts with a tie teach nothing."""
    votes: dict[str, Counter] = defaultdict(Counter)
    texts: dict[str, str] = {}
    for text, label in rows:
        if text and text.strip() and label and label.strip():
            key = texts[text.strip()] = CODE.sub(" ", text.lower()).strip()
            votes[key][label.strip().lower()] += 1
    out = []
    for text, key in sorted(texts.items()):
        v = votes[key]
        bad = {k: n for k, n in v.items() if k != "none"}
        if sum(bad.values()) != v["none"]:
            out.append((text, max(sorted(bad), key=bad.get) if sum(bad.values()) > v["none"] else "none"))
    return out


LETTERS = re.compile(r"[a-z]+|[а-яё]+")
HANS = re.compile(r"[㐀-鿿]+")


class Model:
    """Channel and classifier, made of the corpus counts and the labelled texts."""

    def __init__(self, corpus: np.ndarray, labelled: list[tuple[str, str]], taught: np.ndarray | None = None):
        words, ideographs = Counter(), Counter()
        seeds = [(kind, w) for kind, block in SWEAR_WORDS.items() for w in block.split()]
        for w in (w for _, w in seeds):
            words[w] += 5
            ideographs[w] += 5 if han(w[0]) else 0
        for text, label in labelled:
            low = text.lower()
            if label != "none":
                words.update(w for w in LETTERS.findall(low) if len(w) > 3)
                ideographs.update(HANS.findall(low))
        self.channel = Channel(corpus, words, ideographs)
        bad = np.zeros(_LATIN)
        for w in (w for _, w in seeds):
            np.add.at(bad, Tokens([w]).features(), SEED_TIMES)
        plain = np.zeros(_LATIN)
        if sound := [text for text, label in labelled if label == "none"]:
            np.add.at(plain, Tokens(sound).features(), 1)
        corpus = corpus[:_LATIN] + plain
        # an offending text of one sentence shows what offends; of several sentences it is the one that scores highest
        offending = [([restore(u.lower(), self.channel) for u in utterances(text)], label) for text, label in labelled if label != "none"]
        single = [(us[0], label) for us, label in offending if len(us) == 1]
        several = [(us, label) for us, label in offending if len(us) > 1]
        examples = single
        for _ in range(3):
            now = bad.copy()
            if examples:
                np.add.at(now, Tokens([u for u, _ in examples]).features(), 1)
            self.classifier = Classifier(corpus, now)
            examples = list(single)
            for us, label in several:
                score = [self.best(u) for u in us]
                examples += [(u, label) for u, x in zip(us, score) if x == max(score) or x >= ALSO]
        if taught is not None:
            now += np.where(taught >= PURITY * corpus, np.maximum(taught - CHANCE, 0.0), 0.0)
        self.classifier = Classifier(corpus, now)
        self.kinds = {k: Counter() for k in KINDS}
        for kind, w in seeds:
            self.kinds[kind].update({c: 2 for c in Tokens([w]).features().tolist()})
        for u, label in examples:
            if label in self.kinds:
                self.kinds[label].update(Tokens([u]).features().tolist())

    def best(self, low: str) -> float:
        """Score of a lower-cased, restored text."""
        return float(self.classifier.scores(Tokens([low]))[0].max(initial=0.0))

    @staticmethod
    def stretch(t: Tokens, hit: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens within the stretches of the utterances that hit, and AROUND tokens of the utterance beside them."""
        keep = np.zeros(len(t.begin) + 1, dtype=np.int64)
        u = np.flatnonzero(hit & (last >= 0))
        np.add.at(keep, np.maximum(first[u] - AROUND, np.searchsorted(t.utterance, u)), 1)
        np.add.at(keep, np.minimum(last[u] + AROUND, np.searchsorted(t.utterance, u, "right") - 1) + 1, -1)
        return np.cumsum(keep)[:-1] > 0

    def kind(self, utterance: str) -> str:
        cells = Tokens([utterance.lower()]).features().tolist()
        total = {k: sum(c.values()) + 1.0 for k, c in self.kinds.items()}
        return max(KINDS, key=lambda k: sum(math.log((self.kinds[k][c] + 0.05) / total[k]) for c in cells))

    def score(self, utterance: str) -> tuple[float, str]:
        """(score, restored text) of one utterance."""
        low = utterance.lower()
        restored = restore(low, self.channel)
        forms = [low] if restored == low else [low, restored]
        best = [self.best(f) for f in forms]
        at = int(np.argmax(best))
        return best[at], forms[at]

    def score_texts(self, texts: list[str]) -> list[tuple[float, str]]:
        """(score, utterance) of the worst utterance of each text."""
        t = Tokens(texts)
        score, _, _ = self.classifier.scores(t)
        best = np.zeros(len(texts))
        np.maximum.at(best, t.row_of_utterance, score)
        at = np.full(len(texts), -1)
        for u in np.flatnonzero((score > 0) & (score == best[t.row_of_utterance]))[::-1]:
            at[t.row_of_utterance[u]] = u
        found = [(float(best[i]), t.text_of(at[i]) if at[i] >= 0 else "") for i in range(len(texts))]
        # disguised spots: the utterances that reading changes are scored again
        again, of, was = [], [], []
        for u in t.spots():
            text = t.text_of(u)
            if (r := restore(low := text.lower(), self.channel)) != low:
                again.append(r.replace("\n", " "))
                of.append(t.row_of_utterance[u])
                was.append(text)
        if again:
            t = Tokens(again)
            score, _, _ = self.classifier.scores(t)
            top = np.zeros(len(again))
            np.maximum.at(top, t.row_of_utterance, score)
            for s, i, u in zip(top, of, was):
                if s > found[i][0]:
                    found[i] = (float(s), u)
        return found


@lru_cache(1)
def signs() -> np.ndarray:
    """By code point: 1 for signs used in words, 2 for gaps between ideographs, 4 for signs that end ideographs; added up."""
    t = np.zeros(MAX_CP, dtype=np.uint8)
    for value, chars in ((1, "*#@$|丨€!＊○"), (2, " .·-_*•丨|/~#@"), (4, "*#＊丨○×")):
        for c in chars:
            t[ord(c)] |= value
    return t


SCHEMA = "doc_id bigint, source string, score double, kind string, utterance string"


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Passes over all documents: counts of features and letters, then, ROUNDS times, features of the stretches found so far."""
    rows = labels.select("text", "label").where("length(trim(text)) > 0").orderBy("text", "label").limit(MAX_LABELS).collect()
    labelled = vote([(r["text"], r["label"]) for r in rows])
    corpus = collected(documents, lambda: count_texts)
    model = Model(corpus, labelled)
    for _ in range(ROUNDS):
        sent = documents.sparkSession.sparkContext.broadcast(model.classifier)
        model = Model(corpus, labelled, collected(documents, partial(teacher, sent))[:_LATIN])
    return model


def teacher(sent) -> Callable[[np.ndarray, list[str]], None]:  # noqa: ANN001
    """A step that adds the features of the stretches found in texts."""
    classifier = sent.value

    def step(out: np.ndarray, texts: list[str]) -> None:
        t = Tokens(texts)
        score, begin, end = classifier.scores(t)
        np.add.at(out, t.features(Model.stretch(t, score >= TEACHES, begin, end)), 1)

    return step


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A score for each of documents(doc_id, source, text), learned from labels(text, label) and the documents.

    Returns (doc_id, source, score, kind, utterance); score is at least 0, a case from 1 on. Null, empty and
    blank texts score 0. Whole texts are read; repeated rows are scored each. Three maps without a shuffle but for
    CELLS counts, which are all that meets the driver besides the labels.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in parts(batches):
            found = m.score_texts(texts_of(pdf["text"]))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "source": pdf["source"], "score": [round(s, 4) for s, _ in found],
                "kind": [m.kind(u) if s >= THRESHOLD else "none" for s, u in found], "utterance": [u if s > 0 else None for s, u in found],
            })

    return documents.select(F.col("doc_id").cast("bigint"), "source", "text").mapInPandas(run, SCHEMA)


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cases and rate of each source; documents without a source are one group."""
    bad = F.col("score") >= THRESHOLD
    return p10_scores(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(bad).alias("n_cases"), F.round(F.count_if(bad) / F.count(F.lit(1)), 6).alias("rate")
    )
