"""Problem 1: noise in text from scanned pages, and its repair into continuous paragraphs.

A vocabulary with weights is counted over all blocks: words (compounds with their hyphens), and for
Chinese, which has no word limits, characters in their context. Words that aren't in it are looked up by
running a weighted Levenshtein automaton against the vocabulary trie, so all words within the cost are
retrieved, ideographs by the trie of their contexts. Candidates are ranked by what scanners confuse, by
weight and by how often they stand beside the neighbouring words; an edit that scanners aren't known for
needs such a neighbour. Titles that stand at the top of several pages and page numbers are
removed, words broken over lines are joined, and the rest is reflowed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.lookalikes import canonical_batch
from loomtext.plans.runtime import cut, table

#: A block whose upper edge is above TOP may hold a running title, one whose lower edge is below FOOT a page number.
TOP, FOOT = 60.0, 770.0
TITLE_PAGES = 3
MAX_TITLE = 200
#: Weight of a word's count in scanned blocks against one in the others.
OCR_WEIGHT = 0.02
#: A vocabulary entry needs this share of all counts (so at most 1 / MIN_SHARE entries of a kind exist), and this weight.
MIN_SHARE, MIN_WEIGHT = 1e-6, 0.5
#: The intended word must outweigh the written one by this factor.
RATIO = 12.0
MAX_TOKEN = 40
#: Cost of an edit that scanners aren't known for; the accepted cost per three letters, and at most.
OTHER, PER_THREE, MOST = 1.6, 0.55, 2.6
#: Times a reading with such an edit must have stood beside one of its neighbours; nats for each e-fold of that count.
BESIDE, CONTEXT = 3.0, 0.15
#: Cells of the hashed table of neighbouring words.
PAIR_BITS = 20
#: Cost of a digit where no confusion with it is known.
DIGIT = 0.7

#: What scanners confuse, intended>written (fixed values).
CONFUSED = """
    о>0 з>3 э>3 ч>4 б>6 в>8 е>3 т>7 л>1 д>9 т>г г>т н>и и>н п>л п>и п>н л>п д>л л>д ц>ч ч>ц ц>и ш>щ щ>ш ш>п ы>ьi ь>ъ ъ>ь е>с с>е о>с с>о б>ь в>б ж>х к>н н>к н>п м>н и>п л>и
    o>0 l>1 i>1 s>5 g>9 b>6 b>8 z>2 q>9 t>7 a>4 e>3 e>c c>e o>c m>rn h>li h>b d>cl w>vv n>ri u>ii l>i i>l l>t t>f f>t n>u u>n v>y k>lc rn>m cl>d li>h vv>w h>1i d>c1 k>1c
"""
#: Chinese characters of similar shape are found by context; these pairs need less evidence (fixed values).
HAN_CONFUSED = "图囹 度庋 度庹 管菅 压庄 天夭 米采 米来 距矩 设没 轴铀 轴袖 机杌 机枧 泵录 环坏 土士 未末 已己 日曰 人入 大太 水氷 火氷 风凤 阀阈 箱葙 机杌 泵录 干千 板扳 材村 间问 间闩 内肉 料科 水永 力刀 方万 电申 阀阙 线浅 钢铜 缝逢 孔扎 架驾 装裝 安按 检捡 测侧 层尼 面而 墙樯 柱住 梁粱 基墓 础绌"

MARKS = "-‐¬­"
TOKEN = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*")
HAN_RUN = re.compile(r"[㐀-鿿]")
BREAK = re.compile(rf"((?:[^\W\d_]+-)*[^\W_]*[^\W\d_])([{MARKS}])([ \t]*\n[ \t]*)([^\W\d_][^\W_]*(?:-[^\W\d_]+)*)")


def confusions() -> dict[tuple[str, str], float]:
    pairs = (x.split(">") for x in CONFUSED.split())
    return {(a, b): 0.4 if b.isdigit() else 0.5 for a, b in pairs}


CONFUSION = confusions()
PAIRS_FROM: dict[str, set[str]] = {}
for _a, _b in CONFUSION:
    if len(_a) == 2:
        PAIRS_FROM.setdefault(_a[0], set()).add(_a[1])


def is_word(token: str) -> bool:
    """A token that can be a word: not a mark such as A58, 12.C or PRJ-549L."""
    if len(token) > MAX_TOKEN or not token:
        return False
    letters = sum(c.isalpha() for c in token)
    if not letters or any(c >= "㐀" for c in token):
        return False
    if letters == len(token):
        return not (len(token) <= 2 and token.isupper() and token.isascii())
    small = any(c.islower() for c in token)
    if re.fullmatch(r"[A-Z]{1,3}\d+|\d+[A-Za-zА-я]{1,3}|[a-zа-я]{1,2}\d+", token):
        return small and letters == 1 and token[0] == "0" and len(token) == 2 or small and len(token) == 2 and token[1] == "0" and token[0] in "пнодтс"
    return small and letters * 2 >= len(token)


#: A mark at the end of a line: only there can a word be broken.
MARKED = re.compile(rf"[{MARKS}][ \t]*\n")


def without_broken(text: str) -> str:
    """text without the words that a mark at a line's end may break."""
    out, at = [], 0
    for m in MARKED.finditer(text):
        a, b = m.start(), m.end()
        while a > at and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b] in " \t":
            b += 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if a >= at:
            out += [text[at:a], " "]
            at = b
    return "".join(out) + text[at:]


def tidy(texts: list[str | None]) -> list[str]:
    """Texts in one form of characters, so that look-alike letters don't pass for scan errors."""
    return [t or "" for t in canonical_batch([t if isinstance(t, str) else None for t in texts])]


def han_context(text: str) -> str:
    """text without white space, digits as 0 and other signs as one mark, for contexts of ideographs."""
    t = re.sub(r"\s+", "", text)
    t = re.sub(r"\d+", "0", t)
    return re.sub(r"[^㐀-鿿\U00020000-\U0003ffff0A-Za-z]+", "。", t)


def pair_cell(a: str, b: str) -> int:
    """Cell of two neighbouring words in the table of pairs, the same in every process."""
    return zlib.crc32(f"{a} {b}".encode()) >> (32 - PAIR_BITS)


#: Stands between texts that are counted together; no word of any language here.
BETWEEN = "ƍƍ"


def count_tokens(texts: list[str]) -> Counter:
    """Counts of words (key w), cells of neighbouring words (p), ideographs with the next one (b) and with both neighbours (t), for a batch at once."""
    out: Counter = Counter()
    plain = without_broken(f"\n\n{BETWEEN}\n\n".join(texts))  # the halves of a broken word are no words
    tokens = TOKEN.findall(plain)
    for w, n in Counter(tokens).items():
        if w != BETWEEN and is_word(w):
            out["w" + w.lower()] += n
    for (a, b), n in Counter(zip(tokens, tokens[1:])).items():
        if a != BETWEEN != b:
            out[f"p{pair_cell(a.lower(), b.lower())}"] += n
    t = "。。".join(han_context(x) for x in texts if HAN_RUN.search(x))
    for (a, b), n in Counter(zip(t, t[1:])).items():
        if a >= "㐀" or b >= "㐀":
            out["b" + a + b] += n
    for (a, b, c), n in Counter(zip(t, t[1:], t[2:])).items():
        if b >= "㐀":
            out["t" + a + b + c] += n
    return out


def fit_vocabulary(blocks: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """(weights, neighbours) over every row of blocks(text, ocr boolean).

    What reaches the driver is bounded: weights by MIN_SHARE, the table of neighbouring words by its cells.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ocr, part in pdf.groupby("ocr"):
                c = count_tokens(tidy(part["text"].tolist()))
                yield pd.DataFrame({"entry": list(c), "n": [n * (OCR_WEIGHT if ocr else 1.0) for n in c.values()]})

    counted = blocks.where(F.length("text") > 0).select("text", "ocr").mapInPandas(count, "entry string, n double")
    weights = cut(counted.groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_WEIGHT))
    kind = F.substring("entry", 1, 1)
    pairs = weights.where(kind == "p").select(F.expr("cast(substring(entry, 2) as int)").alias("cell"), F.col("n").cast("float").alias("n")).toPandas()
    neighbours = np.zeros(1 << PAIR_BITS, dtype=np.float32)
    neighbours[pairs["cell"].to_numpy(dtype=np.int64)] = pairs["n"].to_numpy(dtype=np.float32)
    rest = weights.where(kind != "p")
    least = F.lit(0.0)
    for r in rest.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n")).collect():
        least = F.when(kind == r["kind"], F.lit(MIN_SHARE * r["n"])).otherwise(least)
    return {r["entry"]: r["n"] for r in rest.where(F.col("n") >= least).toLocalIterator()}, neighbours


#: Key of the largest weight in a node; no character.
HEAVIEST = "heaviest"


class Trie:
    """Words as nested dictionaries; the empty key holds a word, and HEAVIEST the largest weight of the words below."""

    def __init__(self, words: list[str], weight: dict[str, float] | None = None):
        self.root: dict = {}
        for w in words:
            node, n = self.root, weight[w] if weight else 0.0
            for ch in w:
                node = node.setdefault(ch, {HEAVIEST: n})
                if n > node[HEAVIEST]:
                    node[HEAVIEST] = n
            node[""] = w

    def readings(self, token: str, most: float, least: float = 0.0) -> list[tuple[float, int, str]]:
        """(cost, unlikely edits, word) of all words that may be written as token at a cost of at most most.

        The Levenshtein automaton of token runs down the trie with weighted edits: what scanners confuse is cheap, any
        other substitution, insertion or deletion costs OTHER. Its states are the positions reached in token with
        their cost and number of dear edits, so every word within the cost is found. Branches without a word of
        weight least are left out.
        """
        found: dict[str, tuple[float, int]] = {}
        n = len(token)

        def spread(at: dict[int, tuple[float, int]]) -> dict[int, tuple[float, int]]:
            for i in range(n):  # letters of token that the word doesn't have
                if i in at and (x := at[i][0] + OTHER) <= most and x < at.get(i + 1, NEVER)[0]:
                    at[i + 1] = (x, at[i][1] + 1)
            return at

        stack: list[tuple[dict, dict[int, tuple[float, int]]]] = [(self.root, spread({0: (0.0, 0)}))]
        while stack:
            node, at = stack.pop()
            if "" in node and (c := at.get(n)) is not None and c < found.get(node[""], NEVER):
                found[node[""]] = c
            for ch, child in node.items():
                if len(ch) != 1 or child[HEAVIEST] < least:
                    continue
                new: dict[int, tuple[float, int]] = {}

                def reach(i: int, x: float, dear: int, new: dict = new) -> None:
                    if x <= most and x < new.get(i, NEVER)[0]:
                        new[i] = (x, dear)

                for i, (c, dear) in at.items():
                    if i < n:
                        w = token[i]
                        known = 0.0 if w == ch else CONFUSION.get((ch, w), DIGIT if w.isdigit() else None)
                        reach(i + 1, c + (OTHER if known is None else known), dear + (known is None))
                        if i + 1 < n and (k := CONFUSION.get((ch, token[i : i + 2]))) is not None:
                            reach(i + 2, c + k, dear)
                    reach(i, c + OTHER, dear + 1)  # a letter that token lost
                if new:
                    stack.append((child, spread(new)))
                for second in PAIRS_FROM.get(ch, ()):  # two letters read as one
                    if second in child:
                        both = {i + 1: (c + k, dear) for i, (c, dear) in at.items() if i < n and (k := CONFUSION.get((ch + second, token[i]))) is not None and c + k <= most}
                        if both:
                            stack.append((child[second], spread(both)))
        return [(c, dear, w) for w, (c, dear) in found.items()]

    def centres(self, left: str, right: str) -> list[str]:
        """Of a trie of triples, the middle characters between left and right: the automaton with one edit, in the middle."""
        return [x for x, child in self.root.get(left, {}).items() if len(x) == 1 and right in child]


NEVER = (99.0, 0)


class Reader:
    """Finds and repairs misread words with a fitted vocabulary."""

    def __init__(self, weights: dict[str, float], neighbours: np.ndarray):
        self.weight = {k[1:]: v for k, v in weights.items() if k[0] == "w"}
        self.pairs = {k[1:]: v for k, v in weights.items() if k[0] == "b"}
        self.triples = {k[1:]: v for k, v in weights.items() if k[0] == "t"}
        self.trie = Trie([w for w, n in self.weight.items() if n >= 2 and w.replace("-", "").isalpha()], self.weight)
        self.han_trie = Trie(list(self.triples))
        self.alone: Counter = Counter()
        for k, n in self.pairs.items():
            self.alone[k[0]] += n
        self.shapes = {p[1] + p[0] for p in HAN_CONFUSED.split()} | {p for p in HAN_CONFUSED.split()}
        self.known: dict[str, list[tuple[float, int, str]]] = {}
        self.neighbours = neighbours
        self.settled: dict[str, bool] = {}
        self.places: dict[tuple[str, str, str], str] = {}

    def candidates(self, token: str) -> list[tuple[float, int, str]]:
        """(cost, dear edits, word) for the words token may be a misreading of, best first; empty if token stands for itself.

        A word with dear edits is a candidate only: it takes its context to be the reading.
        """
        if (hit := self.known.get(token)) is not None:
            return hit
        own = self.weight.get(token, 0.0)
        out = []
        if len(token) >= 2:
            limit = PER_THREE * math.ceil(len(token) / 3)
            for c, dear, w in self.trie.readings(token, min(MOST, limit + PER_THREE), RATIO * max(own, OCR_WEIGHT)):
                n = self.weight[w]
                if w != token and n >= RATIO * max(own, OCR_WEIGHT) and c <= min(MOST, PER_THREE * max(1, math.ceil(len(w) / 3))):
                    out.append((c - 0.1 * math.log(n), dear, w))
        out.sort()
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[token] = out
        return out

    def beside(self, a: str, b: str) -> float:
        """How often two words have stood side by side."""
        return float(self.neighbours[pair_cell(a, b)]) if a and b else 0.0

    def reading(self, token: str, before: str, after: str) -> str | None:
        """The word a lower-cased token is a misreading of between its neighbours; None if it stands for itself."""
        best, best_cost = None, 99.0
        own = -1.0
        for cost, dear, w in self.candidates(token):
            near = self.beside(before, w) + self.beside(w, after)
            if dear:
                if own < 0:
                    own = self.beside(before, token) + self.beside(token, after)
                if near < BESIDE or near < RATIO * own:
                    continue
            cost -= CONTEXT * math.log1p(near)
            if cost < best_cost:
                best, best_cost = w, cost
        return best

    def intended(self, l: str, c: str, r: str) -> str:
        """The ideograph that c between l and r stands for; empty if c is in place."""
        own = self.triples.get(l + c + r, 0.0)
        centres = [(x, self.triples[l + x + r]) for x in self.han_trie.centres(l, r)]
        if own >= 3 and not any(c + x in self.shapes for x, _ in centres):
            return ""
        best, best_n = "", (False, 0.0)
        for x, n in centres:
            if x == c or n < RATIO * max(own, OCR_WEIGHT) or x < "㐀":
                continue
            shaped = x + c in self.shapes
            left, right = self.pairs.get(l + c, 0.0), self.pairs.get(c + r, 0.0)
            rare = left * RATIO <= self.pairs.get(l + x, 0.0) and right * RATIO <= self.pairs.get(x + r, 0.0)
            firm = (l >= "㐀" or r >= "㐀") and self.alone[c] * RATIO <= self.alone[x]
            if (shaped or rare and firm and n >= 5) and (shaped, n) > best_n:
                best, best_n = x, (shaped, n)
        return best

    def misread_han(self, text: str) -> list[tuple[int, str]]:
        """(position in the context form, intended ideograph) of ideographs out of place."""
        if not HAN_RUN.search(text):
            return []
        t = "。" + han_context(text) + "。"
        out, known = [], self.places
        for i, place in enumerate(zip(t, t[1:], t[2:])):
            x = known.get(place)
            if x is None:
                c = place[1]
                x = known[place] = self.intended(*place) if "㐀" <= c < "\U00020000" else ""
            if x:
                out.append((i, x))
        if len(known) > 500_000:
            known.clear()
        return out

    def is_misread(self, text: str) -> bool:
        """Whether a text, its broken words joined, has misread words or ideographs."""
        return bool(self.misread(text, first=True)) or bool(self.misread_han(text))

    def breaks(self, text: str) -> list[re.Match]:
        """Places where a single word is broken over two lines by a mark of its own."""
        out, at = [], 0
        if MARKED.search(text) is None:
            return out
        while m := BREAK.search(text, at):
            at = m.start(4)
            left, right = m.group(1).lower(), m.group(4).lower()
            if not m.group(1)[-1].isalpha() or HAN_RUN.search(left + right):
                continue
            if not (left + right).replace("-", "").isalpha() and not is_word(m.group(1) + m.group(4)):
                continue
            joined, compound = self.weight.get(left + right, 0.0), self.weight.get(f"{left}-{right}", 0.0)
            if compound > joined:
                continue
            if m.group(2) == "-" and joined < MIN_WEIGHT and not any(dear == 0 for _, dear, _ in self.candidates(left + right)):
                continue  # the hyphen of a compound: without it there is no such word
            out.append(m)
        return out

    def join_breaks(self, text: str) -> str:
        out, at = [], 0
        for m in self.breaks(text):
            out.append(text[at : m.end(1)])
            at = m.start(4)
        return "".join(out) + text[at:]

    def misread(self, text: str, first: bool = False) -> list[tuple[int, int, str]]:
        """(start, end, repaired word) of the misread words of a text whose broken words are joined; with first, of one."""
        tokens = TOKEN.findall(text)
        if all(map(self.sound, tokens)):
            return []
        out = []
        tokens, end = [t.lower() for t in tokens], len(text.rstrip())
        for k, m in enumerate(TOKEN.finditer(text)):
            w, low = m.group(), tokens[k]
            if self.sound(w):
                continue
            fixed = self.reading(low, tokens[k - 1] if k else "", tokens[k + 1] if k + 1 < len(tokens) else "")
            if fixed and not (m.end() == end and fixed.startswith(low)):  # the text's last word may have lost its end
                out.append((m.start(), m.end(), fixed.upper() if w.isupper() and len(w) > 1 else fixed.capitalize() if w[:1].isupper() else fixed))
                if first:
                    break
        return out

    def sound(self, token: str) -> bool:
        """Whether a token can't be a misread word, whatever stands beside it."""
        hit = self.settled.get(token)
        if hit is None:
            if len(self.settled) > 500_000:
                self.settled.clear()
            hit = self.settled[token] = not is_word(token) or not self.candidates(token.lower())
        return hit

    def repair(self, text: str) -> str:
        """text with broken words joined, misread ones replaced and lines reflowed into paragraphs."""
        text = self.join_breaks(text)
        out, at = [], 0
        for a, b, w in self.misread(text):
            out.append(text[at:a] + w)
            at = b
        text = "".join(out) + text[at:]
        text = self.repair_han(text)
        return reflow(text)

    def repair_han(self, text: str) -> str:
        fixes = self.misread_han(text)
        if not fixes:
            return text
        # positions of the context form back to those of the text
        where, form, i = [], han_context(text), 0
        for ch in form:
            if ch >= "㐀":
                while text[i] != ch:
                    i += 1
                where.append(i)
                i += 1
            else:
                where.append(-1)
        chars = list(text)
        for p, x in fixes:
            if 0 <= p < len(where) and where[p] >= 0:
                chars[where[p]] = x
        return "".join(chars)


def reflow(text: str) -> str:
    """Lines joined into paragraphs: without a space between ideographs, with one elsewhere; blank lines and lists stay apart."""
    paragraphs = []
    for part in re.split(r"\n[ \t]*\n+", text):
        lines = [x.strip() for x in part.split("\n") if x.strip()]
        out = ""
        for x in lines:
            if out and re.match(r"[-•*]\s|\d+[.)]\s", x) and re.search(r"[.;:。；：]$", out):
                paragraphs.append(out)
                out = x
            elif out:
                tight = (out[-1] >= "⺀" and x[0] >= "⺀") or out[-1] >= "㐀" and x[0].isalnum() or x[0] >= "㐀" and out[-1].isalnum()
                out += ("" if tight else " ") + x
            else:
                out = x
        if out:
            paragraphs.append(re.sub(r"[ \t]+", " ", out))
    return "\n\n".join(paragraphs)


NUMBER_WORDS = r"(?:стр(?:аница)?|лист|с|page|pages|pg|p|sheet|第|页码|页|л)"
NUMBER = re.compile(
    rf"^\W*(?:{NUMBER_WORDS}\W*)?(\d{{1,5}})\s*(?:页)?\W*(?:(?:из|of|/|共|от|total)\W*(\d{{1,5}})\s*页?\W*)?$|^\W*共\s*(\d{{1,5}})\s*页\W*第\s*(\d{{1,5}})\s*页\W*$",
    re.IGNORECASE,
)


def states_number(line: str, page: int) -> bool:
    """Whether a line says nothing but the number of its page, with or without the page count."""
    m = NUMBER.match(line.strip())
    if not m:
        return False
    own, total = (m.group(1), m.group(2)) if m.group(1) else (m.group(4), m.group(3))
    # a decimal number, a range or a mark is content
    if re.search(r"\d[.,:*xх×]\d|[±=<>≤≥%°№#]", line):
        return False
    return int(own) == page and (total is None or int(total) >= page)


def last_line(text: str) -> str:
    lines = [x for x in text.split("\n") if x.strip()]
    return lines[-1] if lines else ""


def title_key() -> Column:
    """The first line of text in letters and digits only, lower-cased; null for a line too long for a title."""
    first = F.regexp_extract("text", r"^\s*([^\n]*)", 1)
    key = F.lower(F.regexp_replace(first, r"(?U)[^\p{L}\p{N}]+", ""))
    return F.when((F.length(first) <= MAX_TITLE) & (F.length(key) >= 4), key)


def running_titles(blocks: DataFrame) -> DataFrame:
    """(file_id, title): lines at the top of at least TITLE_PAGES pages of a file."""
    top = blocks.where(F.col("y0") <= TOP).select("file_id", "page", title_key().alias("title")).where("title is not null")
    pages = top.distinct()
    return pages.groupBy("file_id", "title").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TITLE_PAGES).select("file_id", "title")


def with_titles(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """blocks with is_title; blocks without a title line get a key of their own, so no key is hot but real titles."""
    key = F.coalesce(title_key(), F.concat(F.lit("\u0000"), F.col("block_id").cast("string")))
    keyed = blocks.withColumn("title", key)
    return keyed.join(titles.withColumn("is_title", F.lit(True)), ["file_id", "title"], "left").withColumn(
        "is_title", F.coalesce("is_title", F.lit(False)) & (F.col("y0").isNull() | (F.col("y0") <= TOP))
    )


def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pdf_blocks").select(
        "block_id", "file_id", "page", F.coalesce(F.col("pdf_source").startswith("ocr"), F.lit(False)).alias("ocr"),
        F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"), "text",
    )


SCHEMA = "block_id bigint, file_id bigint, page int, x0 double, y0 double, is_title boolean, hyphen_break boolean, misread boolean, page_number boolean, repaired string"


def inspect_blocks(blocks: DataFrame, repair: bool) -> DataFrame:
    """The kinds of noise in each scanned block, and with repair its text without them.

    blocks: (block_id, file_id, page, ocr, x0, y0, y1, text). Null and empty texts have no noise. A block
    without bbox can't have a page number. Repeated rows are judged each.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(fit_vocabulary(blocks))
    titles = cut(running_titles(blocks))
    scanned = with_titles(blocks.where("ocr"), titles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*sent.value)
        for pdf in batches:
            rows = []
            for text, page, y1, title in zip(tidy(pdf["text"].tolist()), pdf["page"], pdf["y1"], pdf["is_title"]):
                number = bool(y1 == y1 and y1 is not None and y1 >= FOOT and page == page and states_number(last_line(text), int(page)))
                body = text
                if number:
                    body = body.rstrip()[: len(body.rstrip()) - len(last_line(body).rstrip())]
                broken = bool(reader.breaks(body))
                joined = reader.join_breaks(body)
                wrong = reader.is_misread(joined)
                fixed = None
                if repair:
                    fixed = reader.repair(re.sub(r"^\s*[^\n]*\n?", "", body, count=1) if title else body)
                rows.append((broken, wrong, number, fixed))
            flags = pd.DataFrame(rows, columns=["hyphen_break", "misread", "page_number", "repaired"], index=pdf.index)
            yield pd.concat([pdf[["block_id", "file_id", "page", "x0", "y0", "is_title"]], flags], axis=1)

    return scanned.select("block_id", "file_id", "page", "x0", "y0", "y1", "is_title", "text").mapInPandas(run, SCHEMA)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_compact(F.array(
        F.when(F.col("hyphen_break"), "hyphen_break"), F.when(F.col("misread"), "misread"),
        F.when(F.col("is_title"), "running_header"), F.when(F.col("page_number"), "page_number"),
    ))
    return inspect_blocks(p1_blocks(spark, sf_dir), False).select("block_id", F.explode(kinds).alias("noise"))


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable text of every scanned page: repaired blocks in reading order. A page's blocks are few by nature."""
    blocks = inspect_blocks(p1_blocks(spark, sf_dir), True).where(F.length(F.trim("repaired")) > 0)
    part = F.struct(F.coalesce("y0", F.lit(1e9)).alias("y"), F.coalesce("x0", F.lit(1e9)).alias("x"), "block_id", "repaired")
    return blocks.groupBy("file_id", "page").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        "file_id", "page", F.array_join(F.transform("parts", lambda p: p["repaired"]), "\n\n").alias("text")
    )
