"""Column functions on texts: cleaning, hashing, counting and the predicates built on them.

Everything here is a built-in expression, so it stays in whole-stage code. White space and trimming follow
Unicode, not ASCII: the ideographic space, the no-break space and the separators U+001C-001F count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_LIMIT = 1400
WS = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
CN = "[一-鿿]"
NOT_CN = "[^一-鿿]"
CYR = "[А-Яа-яЁё]"
WORD = "[А-Яа-яЁёA-Za-z]"

# Patterns that decide what stays as it is and what counts as noise.
NUMERIC_OR_CAD = r"^[\p{Nd}.,\-+−–—_=:/\\|#№()\[\]{}<>*xX×Øø°'\"′″%‰mMмМcCсСkKкКgGгГtTтТnNнНpPпПaAаАvVвВwWвВhHчЧ]+$"
CAD_CODE = r"^[A-Za-zА-Яа-я]{0,4}[-_/]?\p{Nd}+[A-Za-zА-Яа-я\p{Nd}0-9\-_/]*$"
FULL_WIDTH = "（）：，；。＋、"
FULL_WIDTH_TO = "():,;.+,"
EXPLANATIONS = ["перевод:", "translation:", "here is", "объяснение", "note:", "примечание:"]
PUNCT_ONLY = r"^[\s\p{Nd},.;:()/%×\-–—_]+$"
PUNCT_ONLY_WIDE = r"^[\s\p{Nd},.;:()/%×\-–—_:+*\\\[\]{}<>|]+$"
LATIN_ONLY = r"^[A-Za-z0-9\s,.;:()/%×\-–—_]+$"


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def chars(c: Column, marks: str) -> Column:
    """How often any of the given characters occurs."""
    return F.length(c) - F.length(F.translate(c, marks, ""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as an empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def clean_source(c: Column, limit: int = SOURCE_LIMIT) -> Column:
    """Squashed and then cut to limit code points."""
    return F.substring(squash(c), 1, limit)


def text_hash(c: Column) -> Column:
    return F.sha1(F.encode(clean_source(c), "utf-8"))


def has_cn(c: Column) -> Column:
    return F.coalesce(c.rlike(CN), F.lit(False))


def cn_runs(c: Column) -> Column:
    return count(c, f"{CN}+")


def tokens(c: Column, least: int = 1) -> Column:
    return count(c, f"{WORD}+" if least == 1 else f"{WORD}{{{least},}}")


def word_share(c: Column) -> Column:
    """Share of a stripped text that lies in words; 0 for an empty one."""
    s = strip(c)
    inside = F.length(s) - F.length(F.regexp_replace(s, f"{WORD}+", ""))
    return F.when(F.length(s) > 0, inside / F.length(s)).otherwise(F.lit(0.0))


def cyrillic_share(c: Column) -> Column:
    return F.when(F.length(c) > 0, count(c, CYR) / F.length(c)).otherwise(F.lit(0.0))


def normalise_punctuation(c: Column) -> Column:
    """Half-width signs with one style of spacing around them, and numbers set apart from words."""
    v = F.translate(F.coalesce(c, F.lit("")), FULL_WIDTH + "_", FULL_WIDTH_TO + " ")
    # fixed values: the spacing rules and their order
    steps = [
        (f"{WS}+", " "), (r"\( +", "("), (r" +\)", ")"), (r" *([:;,]) *", "$1 "), (r" *\. *", ". "), (r" *\+ *", " + "),
        (r"(?<=\p{Nd})([А-Яа-яЁёA-Za-z])", " $1"), (r"(?<=\p{Nd})(\()", " $1"), (r"(?<=[А-Яа-яЁё])(?=\p{Nd})", " "),
        (r" +", " "), (r" +([,.;:)])", "$1"), (r"^[ _-]+|[ _-]+$", ""),
    ]
    for pattern, to in steps:
        v = F.regexp_replace(v, pattern, to)
    return strip(v)


def strip_prompt(c: Column) -> Column:
    """A model's echo of its instructions removed: rule headers, rule bullets and the label of the text."""
    v = strip(F.coalesce(c, F.lit("")))
    v = F.regexp_replace(v, r"(?isu)^\s*(?:rules?|правила)\s*:\s*.*?(?:text|текст)\s*:\s*", "")
    v = strip(F.regexp_replace(v, r"(?imu)^\s*(?:rules?|правила)\s*:.*$", ""))
    v = strip(F.regexp_replace(v, r"(?imu)^\s*[-•]\s*(?:keep|translate|return|do not|сохранять|перевести|не добавлять|вернуть).*$", ""))
    v = F.regexp_replace(v, r"(?iu)^\s*(?:text|текст)\s*:\s*", "")
    return strip(F.regexp_replace(v, r"\n{3,}", "\n\n"))


def clean_mtext(c: Column) -> Column:
    """Readable content of a drawing text: inline format groups, braces and codes removed."""
    v = F.regexp_replace(F.coalesce(c, F.lit("")), r"\{\\.*?;", "")
    v = F.translate(v, "}", "")
    for code in (r"\\P", r"\\~", r"\\[A-Za-z0-9]+;?"):
        v = F.regexp_replace(v, code, " ")
    return squash(v)


def is_passthrough(c: Column) -> Column:
    """Texts that need no translation: empty, without letters, numbers and marks, Cyrillic, short codes."""
    def plain(v: Column) -> Column:
        tight = F.regexp_replace(v, " ", "")  # all white space is single spaces here
        return (
            F.when(v == "", True)
            .when(v.rlike(CN), False)
            .when(~v.rlike(f"[{CN[1:-1]}A-Za-zА-Яа-яЁё]"), True)
            .when(tight.rlike(NUMERIC_OR_CAD), True)
            .when(tight.rlike(CAD_CODE), True)
            .when(v.rlike(CYR), True)
            .otherwise((F.length(v) <= 12) & (tokens(v, 2) <= 1))
        )

    return bound(clean_source(c), plain)


def is_translatable(c: Column) -> Column:
    """Drawing texts worth translating: Chinese, or a word of two letters that is no measure."""
    v = clean_mtext(c)
    tight = F.regexp_replace(v, f"{WS}+", "")
    return (
        F.when(v == "", False).when(v.rlike(CN), True).when(~v.rlike("[A-Za-zА-Яа-яЁё]"), False)
        .when(tight.rlike(NUMERIC_OR_CAD), False).otherwise(v.rlike("[A-Za-zА-Яа-яЁё]{2,}"))
    )


def detect_section(c: Column) -> Column:
    """The first discipline whose trigger words occur."""
    v = F.coalesce(c, F.lit(""))
    rules = [
        ("ТХ", "工艺|流程|原料|熔铸|挤压|时效|表面处理|包装|能耗|能源"), ("ЭОМ", "电气"), ("ПБ", "消防"), ("ВК", "给排水"),
        ("ОВ", "暖通|通风"), ("КЖ", "结构"), ("АР", "建筑"),
    ]
    out = None
    for section, words in rules:
        hit = v.rlike(words)
        out = F.when(hit, section) if out is None else out.when(hit, section)
    return out.otherwise("UNKNOWN")


def bound(c: Column, fn) -> Column:
    """fn of c, with c computed once; inside the lambda of an array function it would be computed for each element."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def missing_numbers(source: Column, target: Column) -> Column:
    """Numbers of source, repeats kept, that target lacks."""
    pattern = F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)?")
    have = F.regexp_extract_all(F.coalesce(target, F.lit("")), pattern, 0)
    want = F.regexp_extract_all(F.coalesce(source, F.lit("")), pattern, 0)
    return bound(have, lambda h: F.filter(want, lambda x: ~F.array_contains(h, x)))


def clip(c: Column, limit: int = 420) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, limit - 1), f"{WS}+$", ""), F.lit("...")))


def split_flags(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: strip(x)), lambda x: x != "")


def list_like(c: Column) -> Column:
    return (chars(c, "，,") >= 2) | c.contains("（") | c.contains("(")


def structurally_dense(c: Column) -> Column:
    return list_like(c) | c.rlike(r"\p{Nd}[一-鿿]") | c.contains("：") | c.contains(":")


def suspicious(source: Column, candidate: Column) -> Column:
    """A finalised candidate that can't be a sound translation of source."""
    pair = F.struct(strip(F.coalesce(source, F.lit(""))).alias("s"), strip(F.coalesce(candidate, F.lit(""))).alias("c"))
    return bound(pair, lambda x: unsound(x["s"], x["c"]))


def unsound(s: Column, c: Column) -> Column:
    """suspicious() for texts that are stripped and never null; give it columns, since it names them many times."""
    explains = F.lower(c).rlike("^(?:" + "|".join(EXPLANATIONS) + ")")
    groups, n = cn_runs(s), tokens(c)
    cn, share, size = s.rlike(CN), cyrillic_share(c), F.length(s)
    return (
        (c == "") | explains | c.rlike(PUNCT_ONLY) | c.rlike(CN)
        | (cn & (size >= 20) & ((F.length(c) < F.greatest(F.lit(8), F.floor(size * 0.22))) | (share < 0.12)))
        | (cn & c.rlike(LATIN_ONLY) & (share == 0))
        | ((groups >= 3) & (n < F.least(F.lit(3), groups)))
        | (list_like(s) & (n < 3))
    )


def bad_memory(value: Column) -> Column:
    """Stored translations not worth keeping."""
    return bound(strip(F.coalesce(value, F.lit(""))), lambda v: (
        (v == "") | v.rlike(PUNCT_ONLY_WIDE) | (F.length(v) <= 2) | v.rlike(CN) | (~v.rlike(CYR) & (F.length(v) < 12))
        | (word_share(v) < 0.35) | (v.rlike("[（(]") & (tokens(v) < 2))
    ))


def bad_in_context(source: Column, value: Column) -> Column:
    facts = F.struct(cn_runs(strip(F.coalesce(source, F.lit("")))).alias("groups"), tokens(strip(F.coalesce(value, F.lit("")))).alias("n"), list_like(strip(F.coalesce(source, F.lit("")))).alias("list"))
    return bound(facts, lambda x: ((x["groups"] >= 3) & (x["n"] < F.least(F.lit(3), x["groups"]))) | (x["list"] & (x["n"] < 3)))


def noise(c: Column) -> Column:
    return bound(squash(c), _is_noise)


def _is_noise(v: Column) -> Column:
    return (v == "") | v.rlike(PUNCT_ONLY_WIDE) | v.rlike("^[A-Za-z]{1,3}$") | (F.length(v) <= 2)


def ocr_noise(c: Column) -> Column:
    """Recognised scraps: nothing, one character, question marks, a few Latin characters."""
    v = squash(c)
    return F.when(v == "", True).when(v.rlike(CN), False).otherwise(
        (F.length(v) <= 1) | (chars(v, "?") >= 3) | ((F.length(v) <= 18) & v.rlike(r"^[A-Za-z0-9\s,.;:()/%×\-–—_?]{1,18}$"))
    )


def viable_candidate(section: Column, source: Column, target: Column, origin: Column) -> Column:
    sec = F.coalesce(F.nullif(strip(section), F.lit("")), F.lit("UNKNOWN"))

    def viable(x: Column) -> Column:
        s, t, size = x["s"], x["t"], F.length(x["t"])
        return (
            ~_is_noise(s) & ~_is_noise(t) & s.rlike(CN) & ~t.rlike(CN) & t.rlike(CYR)
            & (size >= F.greatest(F.lit(4), F.floor(F.length(s) * 0.18)))
            & ~((sec == "UNKNOWN") & (size < 8)) & ~(F.coalesce(strip(origin), F.lit("")).startswith("section_dict") & (size < 8))
        )

    return bound(F.struct(squash(source).alias("s"), squash(target).alias("t")), viable)


def candidate_score(source: Column, target: Column, origin: Column) -> Column:
    """Confidence in hundredths of 0.1 + 0.35 + 0.2 + 0.15 + 0.15 + 0.1 + 0.05, at most 1."""
    o = F.coalesce(origin, F.lit(""))

    def scored(x: Column) -> Column:
        s, t = x["s"], x["t"]
        has = t != ""
        points = [
            ((s != "") & has, 10), (has & ~t.rlike(CN), 35), (t.rlike(CYR), 20),
            (has & (F.length(t) >= F.greatest(F.lit(4), F.floor(F.length(s) * 0.25))), 15),
            (o.rlike("^(?:memory|section_dict|ollama_duplicate|deepseek_duplicate)"), 15), (o.startswith("deepseek"), 10),
            (has & (F.lower(t) != F.lower(s)), 5),
        ]
        total = F.lit(0)
        for when, n in points:
            total = total + F.when(when, n).otherwise(0)
        return F.least(total, F.lit(100)) / 100.0

    return bound(F.struct(strip(F.coalesce(source, F.lit(""))).alias("s"), strip(F.coalesce(target, F.lit(""))).alias("t")), scored)


def recommendable(n: Column, confidence: Column, target: Column) -> Column:
    t = strip(F.coalesce(target, F.lit("")))
    return (t != "") & ~t.rlike(CN) & (n >= 2) & (confidence >= 0.75)


def status_approved(c: Column) -> Column:
    return F.upper(strip(F.coalesce(c, F.lit("")))).isin("APPROVED", "OK", "TRUE", "1", "ДА")


def status_recommended(c: Column) -> Column:
    return F.upper(strip(F.coalesce(c, F.lit("")))).isin("RECOMMENDED", "TRUE", "1", "ДА", "YES")


def complexity(c: Column) -> Column:
    """0 to 4, by length and signs of structure."""
    n, p = F.length(c), chars(c, "，,。;；")
    return F.when((n >= 700) | (p >= 8), 4).when((n >= 420) | (p >= 5), 3).when((n >= 180) | (p >= 3), 2).when(n >= 80, 1).otherwise(0)


def batch_size(longest: Column, mean: Column) -> Column:
    return (
        F.when((longest <= 80) & (mean <= 45), 32).when((longest <= 160) & (mean <= 80), 18).when((longest >= 700) | (mean >= 260), 2)
        .when((longest >= 420) | (mean >= 180), 3).when((longest >= 260) | (mean >= 120), 5).otherwise(10)
    )


def output_text(normalized: Column, translated: Column, text: Column) -> Column:
    """The first of the three that isn't blank."""
    pick = lambda c: F.when(strip(F.coalesce(c, F.lit(""))) != "", c)
    return F.coalesce(pick(normalized), pick(translated), pick(text), F.lit(""))


def ru_name(file_name: Column, ext: Column | None = None) -> Column:
    """Base name with _RU before its extension; a leading dot begins no extension."""
    base = F.regexp_extract(file_name, r"([^/]*)$", 1)
    parts = r"^(\.*[^.].*?|\.*)(\.[^.]*)?$"
    stem, own = F.regexp_extract(base, parts, 1), F.regexp_extract(base, parts, 2)
    return F.concat(stem, F.lit("_RU"), F.coalesce(ext, own) if ext is not None else own)


def fix_spaced(c: Column) -> Column:
    """Texts typed with a space after every character or two are closed up."""
    parts = F.split(c, " ")
    short = F.size(F.filter(parts, lambda p: F.length(p) <= 2))
    return F.when((F.size(parts) > 8) & (short > F.size(parts) * 0.6), F.array_join(parts, "")).otherwise(c)


def _with(fn, **kept):
    """fn of one column with the other arguments fixed, as a lambda of exactly one parameter."""
    return lambda x: fn(x, **kept)


def _spot(i: Column, mid: Column, rank: int, kept: int) -> Column:
    cut = i - 1 + kept
    return F.struct(F.abs(cut - mid).alias("far"), F.lit(rank).alias("rank"), i.alias("at"), cut.alias("cut"))


def split_two_lines(c: Column, least: int = 42) -> Column:
    """A long single line broken once, at the separator nearest its middle, or else the nearest space."""
    return bound(strip(c), lambda v: _two_lines(v, least))


def _two_lines(v: Column, least: int) -> Column:
    mid = F.floor(F.length(v) / 2)

    def spots(separators: list[str]) -> Column:
        """The nearest place behind one of the separators; ties go to the earlier separator, then place."""
        found = []
        for rank, sep in enumerate(separators):
            kept = len(sep.rstrip())

            def here(i: Column, sep: str = "", n: int = 0) -> Column:
                return F.substring(v, i, F.lit(n)) == sep

            at = F.filter(F.sequence(F.lit(1), F.length(v)), _with(here, sep=sep, n=len(sep)))
            found.append(F.transform(at, _with(_spot, mid=mid, rank=rank, kept=kept)))
        return F.array_min(F.flatten(F.array(*found)))

    cut = F.coalesce(spots([", ", "; ", ": ", " - ", " ("])["cut"], spots([" "])["at"] - 1)
    left = F.regexp_replace(F.substring(v, F.lit(1), cut.cast("int")), f"{WS}+$", "")
    right = F.regexp_replace(F.substring(v, cut.cast("int") + 1, F.length(v)), f"^{WS}+", "")
    ok = cut.isNotNull() & (cut > 0) & (cut < F.length(v) - 1) & ~v.contains("\n") & (F.length(v) >= least)
    return F.when(ok, F.concat(left, F.lit("\n"), right)).otherwise(v)


def rule_issues(section: Column, text: Column) -> Column:
    """Reminders tied to a discipline and a word."""
    low = F.lower(text)
    return F.array_compact(F.array(
        F.when((section == "ПБ") & text.contains("喷粉"), "Требуется взрывозащита СП РК ПБ"),
        F.when((section == "ОВ") & low.contains(" печь"), "Проверить вытяжную вентиляцию СП РК ОВ"),
        F.when((section == "ЭОМ") & low.contains("shield"), "Проверить ПУЭ РК"),
        F.when((section == "КЖ") & low.contains("steel"), "СП РК КМ проверить нагрузки"),
    ))
