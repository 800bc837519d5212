"""Built-in vocabulary and the ordered term arrays made from it and from glossary tables.

Replacements run one after another, longest key first; keys of equal length keep the order in which they
were first met, also when a later layer overrides their value. A row carries the array of the terms that occur in
its texts, so one `aggregate` expression does what would otherwise be hundreds of nested calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.plans.runtime import cut
from loomtext.functions.text import CN, WS, bound, normalise_punctuation, status_approved, strip

SECTIONS = ["ТХ", "ОВ", "ВК", "ЭОМ", "КЖ", "АР", "UNKNOWN"]

# Section terms used where no term file is given.
BASE_TERMS = {
    "ТХ": {"工艺": "технология", "流程": "технологический процесс", "原料": "сырье", "挤压": "прессование", "包装": "упаковка"},
    "ОВ": {"通风": "вентиляция", "排风": "вытяжка", "送风": "приток", "风管": "воздуховод"},
    "ВК": {"给排水": "водоснабжение и канализация", "排水沟": "водоотводный лоток", "污水沟": "лоток сточных вод"},
    "ЭОМ": {"电气": "электроснабжение", "桥架": "кабельный лоток"},
    "КЖ": {"钢构柱": "стальная колонна", "柱面": "грань колонны"},
    "АР": {"车间门": "дверь цеха", "总平面": "генеральный план"},
    "UNKNOWN": {
        "个中": "в том числе", "个": "шт.", "只": "шт.", "件": "шт.", "套": "комплект", "中": "средний", "中国标准": "китайский стандарт",
        "中国": "Китай", "单位": "единица измерения", "序号": "номер", "绿地率": "коэффициент озеленения",
        "容积率": "коэффициент плотности застройки", "建筑系数": "коэффициент застройки", "建筑物占地面积": "площадь застройки здания",
        "规划建设用地面积": "площадь земельного участка под строительство", "计容总建筑面积": "общая расчетная площадь застройки",
        "货车停车位": "машино-места для грузовых автомобилей", "小汽车停车位": "машино-места для легковых автомобилей",
        "原料": "сырье", "辅料": "вспомогательные материалы",
    },
}

# Phrases, tokens and mixed wording that are cleaned up after any translation.
PHRASES = {
    "中国标准": "китайский стандарт", "个中": "в том числе", "从原料到成品": "от сырья до готовой продукции",
    "从原料到产品": "от сырья до готовой продукции", "铝材标准工业流程": "стандартный промышленный процесс алюминиевых изделий",
    "标准工业流程": "стандартный промышленный процесс", "工业流程说明": "описание промышленного процесса",
    "能源:电,天然气,水,压缩空气.": "Энергоносители: электроэнергия, природный газ, вода, сжатый воздух.",
    "能源: 电, 天然气, 水, 压缩空气.": "Энергоносители: электроэнергия, природный газ, вода, сжатый воздух.",
    "1:熔炼:铝锭+废料投入熔铸炉熔炼.": "1: Плавка: алюминиевый слиток и отходы загружаются в плавильно-литейную печь на плавку.",
    "1: 熔炼: 铝锭+废料投入熔铸炉熔炼.": "1: Плавка: алюминиевый слиток и отходы загружаются в плавильно-литейную печь на плавку.",
    "600x400方井": "600×400 квадратный смотровой колодец", "600X400方井": "600×400 квадратный смотровой колодец",
    "也可以圆井": "допускается устройство круглого смотрового колодца",
    "喷雾机水与模具冷凝污水沟": "лоток отвода сточных вод от распылительной установки и конденсата форм",
    "排水沟外围300mm以上水泥浇筑": "бетонная подготовка по периметру водоотводного лотка шириной не менее 300 мм",
    "深度200mm": "глубина 200 мм", "以钢构柱面为准": "привязать по грани стальной колонны", "车间门": "дверь цеха",
    "行车牛腿": "подкрановая консоль", "建筑铝材": "архитектурные алюминиевые конструкции", "工业铝材": "промышленные алюминиевые изделия",
}
TOKENS = {
    "个": "шт.", "只": "шт.", "件": "шт.", "套": "комплект", "中": "средний", "中国": "Китай", "单位": "единица измерения", "序号": "номер",
    "绿地率": "коэффициент озеленения", "容积率": "коэффициент плотности застройки", "建筑系数": "коэффициент застройки",
    "建筑物占地面积": "площадь застройки здания", "规划建设用地面积": "площадь земельного участка под строительство",
    "计容总建筑面积": "общая расчетная площадь застройки", "货车停车位": "машино-места для грузовых автомобилей",
    "小汽车停车位": "машино-места для легковых автомобилей", "能源": "Энергоносители", "电": "электроэнергия", "天然气": "природный газ",
    "水": "вода", "压缩空气": "сжатый воздух", "原料": "сырье", "主要原料": "основное сырье", "辅料": "вспомогательные материалы",
    "熔铸工段": "литейный участок", "熔铸": "литейный участок", "工段": "участок", "熔炼": "плавка", "铝锭": "алюминиевый слиток",
    "废料": "отходы", "废铝": "алюминиевый лом", "投入": "загружаются", "熔铸炉": "плавильно-литейная печь", "镁": "магний", "硅": "кремний",
    "合金元素": "легирующие элементы", "精炼剂": "рафинирующая добавка", "覆盖剂": "покровный флюс", "溶剂": "растворитель",
    "时效热处理": "термообработка старением", "保温": "выдержка", "提高硬度": "повышение твердости",
    "建筑铝材": "архитектурные алюминиевые конструкции", "工业铝材": "промышленные алюминиевые изделия",
    "门窗": "дверные и оконные конструкции", "幕墙": "витражные фасады", "阳光房": "зимние сады", "设备框架": "каркасы оборудования",
    "光伏支架": "опоры фотоэлектрических панелей", "汽车件": "автомобильные комплектующие", "废弃物": "отходы", "排放物": "выбросы",
    "全流程": "всего процесса", "产生": "образуется", "铝灰": "алюминиевая зола", "铝渣": "алюминиевый шлак",
    "方井": "квадратный смотровой колодец", "圆井": "круглый смотровой колодец", "污水沟": "лоток сточных вод", "排水沟": "водоотводный лоток",
}
MIXED = {
    "квадратная яма": "квадратный смотровой колодец", "круглая яма": "круглый смотровой колодец", "входные двери цеха": "дверь цеха",
    "spray machine": "распылительная установка", "water spray": "распылительная установка",
}
UNITS = ["个", "只", "件", "套"]

# Drawing terms, document terms and file-name terms; these three replace in the order given.
CAD_TERMS = {
    "锅炉房": "котельная", "雨水": "дождевые воды", "项目名称": "наименование проекта", "总平面": "генеральный план", "车间": "цех",
    "办公楼": "административное здание", "厂房": "производственный корпус", "钢结构": "металлоконструкции", "高强度螺栓": "высокопрочные болты",
    "长度": "длина", "宽度": "ширина", "高度": "высота", "给排水": "ВК", "电气": "ЭОМ", "消防": "ПБ", "桥架": "кабельный лоток",
    "配电箱": "ЩР", "铝屑回收": "переработка алюминиевой стружки", "混凝土": "бетон", "钢筋": "арматура", "基础": "фундамент", "柱": "колонна",
    "梁": "балка", "板": "плита", "屋面": "кровля", "门": "дверь", "窗": "окно", "道路": "дорога", "管道": "трубопровод", "阀门": "задвижка",
    "水泵": "насос",
}
DOCUMENT_TERMS = {
    "设备": "оборудование", "布置": "расстановка", "工艺": "технология", "流程": "схема", "车间": "цех", "铝材": "алюминиевый профиль",
    "说明": "описание", "结构": "конструкции", "总平面": "генеральный план", "目录": "содержание", "电气": "электрика",
    "给排水": "водоснабжение и канализация",
}
FILE_NAME_TERMS = {
    "设备布置图": "План расстановки оборудования", "工艺流程图": "Технологическая схема", "车间": "Цех", "铝材": "Алюминиевый профиль",
    "目录": "Содержание", "总平面": "Генеральный план", "电气": "Электрика", "给排水": "ВК",
}

# Wording brought to the norm of local design documents, longest first.
NORM_TERMS = {
    "квадратная яма": "квадратный колодец", "круглая яма": "круглый колодец", "допускается круглая яма": "допускается круглый колодец",
    "также можно круглый колодец": "допускается круглый колодец", "входные двери цеха": "дверь цеха", "водопроводный насос": "насос",
    "насос распылительная машина": "распылительная установка", "распылительная машина": "распылительная установка", "ножки": "консоль",
    "консоль мостового крана": "подкрановая консоль", "мостовой кран консоль": "подкрановая консоль",
    "лоток сточных вод": "водоотводный лоток для сточных вод", "канава": "лоток", "наружная часть стока": "наружная часть",
    "по армированной колонне": "по грани стальной колонны", "по армированной колонне поверхности": "по грани стальной колонны",
    "по стальной колонне": "по грани стальной колонны", "бетонная заливка": "бетонная подготовка", "наружная часть": "по наружному контуру",
    "дверь цеха": "вход в цех", "допускается круглый колодец": "допускается устройство круглого колодца",
    "квадратный колодец": "квадратный смотровой колодец", "круглый колодец": "круглый смотровой колодец",
    "подкрановая консоль": "подкрановая консоль",
    "лоток сточных вод от распылительной установки и конденсата форм": "лоток отвода сточных вод от распылительной установки и конденсата форм",
    "водоотводный лоток для сточных вод": "водоотводный лоток", "по грани стальной колонны": "привязать по грани стальной колонны",
}


KINDS = ("terms", "norm_terms", "residual_terms")


def literal_terms(terms: dict[str, str], longest_first: bool = True) -> Column:
    """An array literal of terms in the order in which they replace."""
    items = sorted(terms.items(), key=lambda kv: -len(kv[0])) if longest_first else terms.items()
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"), F.lit(False).alias("cn")) for k, v in items])


def fold(c: Column, terms: Column) -> Column:
    """All terms replaced in turn. Chinese keys that don't occur in c are left out beforehand: since no
    replacement adds ideographs where the flag cn is set, such a key can't come up later either."""
    def replaced(v: Column) -> Column:
        near = F.filter(terms, lambda t: ~t["cn"] | F.contains(v, t["k"]))
        return F.aggregate(near, v, lambda acc, t: F.replace(acc, t["k"], t["v"]))

    return bound(c, replaced)


def fold_fixed(c: Column, terms: dict[str, str], longest_first: bool = True) -> Column:
    """A short fixed vocabulary replaced in turn, longest first or in the order given."""
    return F.aggregate(literal_terms(terms, longest_first), c, lambda acc, t: F.replace(acc, t["k"], t["v"]))


def fold_runs(c: Column, terms: Column, whole: bool = False) -> Column:
    """Terms replaced inside the Chinese runs of c only; with whole, a run that is a term itself is taken at once."""
    parts = F.split(c, "(?<=[一-鿿])(?=[^一-鿿])|(?<=[^一-鿿])(?=[一-鿿])")

    def one(p: Column) -> Column:
        value = fold(p, terms)
        if whole:
            value = F.coalesce(F.get(F.filter(terms, lambda t: t["k"] == p), F.lit(0))["v"], value)
        return F.when(p.rlike(CN), value).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def _rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "section string, cn string, ru string, layer int, ord int")


def approved_terms(approved: DataFrame) -> DataFrame:
    """(section, cn, ru, ord) of the approved rows of a glossary(section, cn, ru, status, ord); no section means ALL."""
    section = F.coalesce(F.nullif(strip(F.col("section")), F.lit("")), F.lit("ALL"))
    return approved.where(
        status_approved(F.col("status")) & (strip(F.coalesce("cn", F.lit(""))) != "") & (strip(F.coalesce("ru", F.lit(""))) != "")
    ).select(section.alias("section"), "cn", "ru", F.col("ord").cast("bigint").alias("ord"))


def layered_terms(spark: SparkSession, approved: DataFrame, booster: DataFrame | None = None) -> DataFrame:
    """Every layer of every section: (section, cn, ru, layer, ord). Later layers override earlier ones."""
    names = [*SECTIONS, "ПБ"]
    every = F.array(*map(F.lit, names))
    own = lambda *general: F.explode(F.when(F.col("section").isin(*general), every).otherwise(F.array("section"))).alias("target")
    is_own = F.col("section") == F.col("target")
    base = _rows(spark, [(s, k, v, 0 if s == "UNKNOWN" else 1, i) for s, m in BASE_TERMS.items() for i, (k, v) in enumerate(m.items())])
    out = base.select(own("UNKNOWN"), "cn", "ru", "layer", F.col("ord").cast("bigint").alias("ord"))
    layer = lambda n, rank: F.when(F.col("section") == "ALL", n).when(rank, n + 1).otherwise(n + 2).alias("layer")
    rows = approved_terms(approved)
    out = out.unionByName(rows.select("section", own("ALL"), "cn", "ru", "ord").select("target", "cn", "ru", layer(2, is_own), "ord"))
    if booster is not None:  # among the booster terms those without a section come last
        more = booster.select("section", own("ALL", "UNKNOWN"), "cn", "ru", F.col("ord").cast("bigint").alias("ord"))
        out = out.unionByName(more.select("target", "cn", "ru", layer(4, F.col("section") != "UNKNOWN"), "ord"))
    return out.where(F.col("target").isin(*names)).withColumnRenamed("target", "section")


def section_terms(layers: DataFrame) -> DataFrame:
    """The winning value of each term by section: (section, cn, ru, place); place is where it was first met."""
    at = F.struct("layer", "ord")
    return layers.groupBy("section", "cn").agg(F.max_by("ru", at).alias("ru"), F.min(at).alias("place"))


def term_table(spark: SparkSession, approved: DataFrame, booster: DataFrame | None = None) -> DataFrame:
    """(section, kind, cn, ru, place): terms (all layers), norm_terms (approved only), residual_terms (built-in vocabulary below all)."""
    layers = layered_terms(spark, approved, booster)
    fixed = [(s, k, v, n, i) for n, m in ((-3, PHRASES), (-2, TOKENS), (-1, MIXED)) for i, (k, v) in enumerate(m.items()) for s in [*SECTIONS, "ПБ"]]
    low = _rows(spark, fixed).withColumn("ord", F.col("ord").cast("bigint"))
    kinds = F.when(F.col("layer") < 0, F.array(F.lit("residual_terms"))).when(F.col("layer").isin(2, 3), F.array(*map(F.lit, KINDS))).otherwise(F.array(F.lit("terms"), F.lit("residual_terms")))
    every = low.unionByName(layers).withColumn("kind", F.explode(kinds))
    at = F.struct("layer", "ord")
    return every.groupBy("section", "kind", "cn").agg(F.max_by("ru", at).alias("ru"), F.min(at).alias("place"))


def section_key() -> Column:
    """The section whose terms a row uses: its own, or UNKNOWN if there are none for it."""
    return F.when(F.col("section").isin(*SECTIONS, "ПБ"), F.col("section")).otherwise("UNKNOWN")


def units(c: Column, terms: Column) -> Column:
    """A number before a counting word gets the unit's translation with a space."""
    some, plain = c.rlike("[" + "".join(UNITS) + "]"), c
    for u in UNITS:
        to = F.coalesce(F.get(F.filter(terms, _is_term(u)), F.lit(0))["v"], F.lit(u))
        c = F.regexp_replace(c, F.lit(rf"(\p{{Nd}}+(?:[.,]\p{{Nd}}+)?){WS}*{u}"), F.concat(F.lit("$1 "), to))
    return F.when(some, c).otherwise(plain)


def settled(c: Column) -> Column:
    """Punctuation normalised, and once more where that changed something, since once isn't always enough."""
    return bound(c, lambda x: bound(normalise_punctuation(x), lambda n: F.when(n == x, n).otherwise(normalise_punctuation(n))))


def _is_term(key: str) -> Callable[[Column], Column]:
    return lambda t: t["k"] == key


ITEM = "struct<n:int,place:struct<layer:int,ord:bigint>,k:string,v:string,cn:boolean>"


def _each(c: Column) -> Column:
    return F.split(c, "")


class TermBook:
    """A glossary of any size, matched to the rows that hold its terms.

    terms: (section, kind, cn, ru, place). attach() gives every row the few terms that can come up in its texts. Rows
    and keys meet by section and the first two characters of a key; what is shuffled are such pairs with the hash of
    the texts they come from, never the texts. A row then keeps the terms it really holds, so equal hashes do no harm.
    All later replacing is array expressions over these few.

    Keys that don't begin with an ideograph within two characters or have one only go with every row of their section;
    they are the units and mixed wording of the built-in vocabulary and the like. Where translations hold ideographs
    themselves, any key whose characters all occur in the text or in those translations is kept, as no other can come up.
    """

    def __init__(self, terms: DataFrame):
        by = ["section", "kind"]
        t = terms.select(*by, F.struct((-F.length("cn")).alias("n"), "place", F.col("cn").alias("k"), F.col("ru").alias("v")).alias("t"), F.col("cn").rlike(CN).alias("is_cn"))
        foreign = F.when(F.col("t.v").rlike(CN), F.regexp_replace("t.v", "[^一-鿿]", ""))
        info = t.groupBy(*by).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(_each(foreign))))), "").alias("extra"))
        t = t.join(F.broadcast(info), by).withColumn("open", F.col("extra") != "")  # one row for each section and kind
        item = F.struct("t.n", "t.place", "t.k", "t.v", (F.col("is_cn") & ~F.col("open")).alias("cn"))
        first = F.substring("t.k", 1, 2)
        keyed = F.when(F.col("open"), F.col("is_cn")).otherwise((F.length("t.k") > 1) & first.rlike(CN))
        t = cut(t.withColumns({"keyed": keyed, "item": item}))  # used for every text there is
        self.keyed = t.where("keyed").select(
            F.col("section").alias("_key"), F.when(F.col("open"), F.substring("t.k", 1, 1)).otherwise(first).alias("anchor"), F.struct("kind", "item", "open").alias("hit"))
        rest = lambda k: F.array_sort(F.array_compact(F.collect_list(F.when((F.col("kind") == k) & ~F.col("keyed"), F.col("item"))))).alias(f"_any_{k}")
        self.sections = t.groupBy("section").agg(*[rest(k) for k in KINDS], F.array_join(F.collect_set("extra"), "").alias("_extra")).withColumnRenamed("section", "_key")

    def attach(self, df: DataFrame, *texts: str) -> DataFrame:
        """df(section, ...) with the arrays terms, norm_terms and residual_terms for what its columns texts hold."""
        if set(KINDS) <= set(df.columns):
            return df  # what is made of a row's texts holds no terms but those
        d = df.withColumns({"_key": section_key(), "_held": F.concat_ws("\n", *texts)})
        d = self.matched(d)
        plain = lambda x: F.transform(x, lambda t: F.struct(t["k"].alias("k"), t["v"].alias("v"), t["cn"].alias("cn")))

        def merged(kind: str) -> Column:
            found = F.transform(F.filter("_hits", lambda h: h["kind"] == kind), lambda h: h["item"])
            rest = F.col(f"_any_{kind}")  # in order already
            return bound(found, lambda x: plain(F.when(F.size(x) == 0, rest).otherwise(F.array_sort(F.concat(x, rest)))))

        d = d.withColumns({k: merged(k) for k in KINDS})
        return d.drop("_key", "_held", "_hits", *[f"_any_{k}" for k in KINDS])

    def matched(self, d: DataFrame) -> DataFrame:
        """d(_key, _held, ...) with _hits, the keyed terms that can come up in _held, and _any_<kind>, the terms that go with every row."""
        d = d.join(F.broadcast(self.sections), "_key", "left").withColumn("_id", F.xxhash64("_key", "_held"))  # one row for each section
        pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_held") - 1, F.lit(1))), lambda i: F.substring(F.col("_held"), i, F.lit(2))), lambda x: x.rlike(CN))
        single = F.when(F.col("_extra") != "", _each(F.concat("_held", "_extra"))).otherwise(F.array().cast("array<string>"))
        at = d.where("_held <> ''").select("_id", "_key", F.explode(F.array_distinct(F.concat(pairs, single))).alias("anchor")).distinct()
        hits = at.join(self.keyed, ["_key", "anchor"]).groupBy("_id").agg(F.collect_set("hit").alias("_hits"))
        within = lambda h: F.when(
            h["open"], F.length(F.call_function("translate", h["item"]["k"], F.concat("_held", "_extra"), F.lit(""))) == 0).otherwise(F.contains("_held", h["item"]["k"]))
        none = F.expr(f"cast(array() as array<struct<kind:string,item:{ITEM},open:boolean>>)")
        any_kind = {f"_any_{k}": F.coalesce(f"_any_{k}", F.expr(f"cast(array() as array<{ITEM}>)")) for k in KINDS}
        return d.join(hits, "_id", "left").withColumns({"_hits": F.filter(F.coalesce("_hits", none), within), **any_kind}).drop("_id", "_extra")

    def fold(self, c: Column, kind: str) -> Column:
        return fold(c, F.col(kind))

    def fold_runs(self, c: Column, kind: str) -> Column:
        return fold_runs(c, F.col(kind), whole=True)

    def tidy(self, c: Column) -> Column:
        """Punctuation, units, known terms anywhere and then inside what Chinese is left; a text no term changes is done."""
        res = F.col("residual_terms")
        again = lambda y: settled(bound(normalise_punctuation(y), lambda z: fold_runs(units(z, res), res, whole=True)))
        return bound(settled(c), lambda x: bound(bound(units(x, res), lambda u: fold(u, res)), lambda y: F.when(y == x, x).otherwise(again(y))))

    def rebuild(self, c: Column) -> Column:
        return self.tidy(self.fold_runs(c, "terms"))


def term_book(spark: SparkSession, glossary: DataFrame, booster: DataFrame | None = None) -> TermBook:
    """The terms of a glossary(section, cn, ru, status, ord) and of a booster(section, cn, ru, ord)."""
    return TermBook(term_table(spark, glossary, booster))
