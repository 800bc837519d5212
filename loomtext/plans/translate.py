"""The translation pipeline: finalising, routing, batching, the model step and memory.

Rows are reduced to distinct (section, text) pairs before anything costly; all rules run as expressions on
those, the model sees only what no rule resolves, and one join brings the results back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.glossary import CAD_TERMS, NORM_TERMS, TermBook, fold_fixed
from loomtext.plans.runtime import cut, spread

Book = TermBook


def finalise(df: DataFrame, source: str, candidate: str, out: str, book: Book) -> DataFrame:
    """df(section, ...) with out (the finalised candidate), out_untranslated and out_flags.

    Null texts count as empty ones. A candidate that is too thin for a dense source is rebuilt from the source by
    terms, and kept if that yields more words.
    """
    d = book.attach(df, source, candidate).withColumns({
        "_src": T.normalise_punctuation(T.strip(F.coalesce(F.col(source), F.lit("")))),
        "_val": book.tidy(T.strip_prompt(F.col(candidate))),
    })
    thin = (F.col("_val") == "") | F.col("_val").rlike(T.PUNCT_ONLY_WIDE) | (T.structurally_dense(F.col("_src")) & (T.tokens(F.col("_val")) < 3))
    d = d.withColumn("_re", book.rebuild(F.when(thin, F.col("_src"))))
    better = F.col("_re").isNotNull() & (T.tokens(F.col("_re")) > T.tokens(F.col("_val")))
    d = d.withColumn(out, F.when(better, F.col("_re")).otherwise(F.col("_val")))
    v = F.col(out)
    left = T.has_cn(v)
    flags = F.array_compact(F.array(
        F.when(v.rlike("^[一-鿿]$"), "single_char_chinese"), F.when(v.rlike(rf"\p{{Nd}}{T.WS}*[一-鿿]"), "number_prefix_chinese"),
        F.when(T.cn_runs(v) >= 2, "multiple_chinese_fragments"), F.when(left, "needs_manual_review"),
    ))
    return d.withColumns({f"{out}_untranslated": left, f"{out}_flags": flags}).drop("_src", "_val", "_re")


def good_by_terms(source: Column, candidate: Column) -> Column:
    c = T.clean_source(candidate)
    return (c != "") & (c != source) & ~T.has_cn(c) & (T.tokens(c, 2) >= 1) & ~((T.cn_runs(source) >= 3) & (T.tokens(c, 2) < 2))


def distinct_texts(segments: DataFrame) -> DataFrame:
    """(section, text_hash, source) once each; source is the cleaned text. Hot texts cost a row per task."""
    cleaned = segments.select("section", T.clean_source(F.col("text")).alias("source"))
    once = cleaned.groupBy("section", "source").agg(F.count(F.lit(1)).alias("n_rows"))
    return spread(once).withColumn("text_hash", F.sha1(F.encode("source", "utf-8")))


def fast_route(texts: DataFrame, memory: DataFrame, book: Book) -> DataFrame:
    """texts(section, source) with translated, route and flags.

    route is passthrough, memory, structured_dict, section_dict or null; the first that succeeds counts.
    memory: (section, source_text, translated), unique by the first two.
    """
    m = memory.select(F.col("section").alias("_s"), F.col("source_text").alias("_t"), F.col("translated").alias("_hit"))
    d = texts.withColumn("_pass", T.is_passthrough(F.col("source")))
    d = d.join(m, (F.col("section") == F.col("_s")) & (F.col("source") == F.col("_t")), "left").drop("_s", "_t")
    # joined rows would lie in few partitions by their bytes, but each takes a lot of work
    todo = spread(book.attach(d.where(~F.col("_pass")), "source", "_hit"))

    def tried(rows: DataFrame, made: Column, name: str, done: Column | None) -> DataFrame:
        """rows with the finalised candidate made, nothing where an earlier way has succeeded."""
        if done is not None:
            made = F.when(~done, made)
        rows = rows.withColumns({f"{name}0": made, f"{name}s": F.col("source") if done is None else F.when(~done, F.col("source"))})
        return finalise(rows, f"{name}s", f"{name}0", name, book)

    ok_mem = F.col("_hit").isNotNull() & (F.col("_hit") != "") & ~F.col("_mem_untranslated")
    todo = finalise(todo.withColumn("_ms", F.when(F.col("_hit") != "", F.col("source"))), "_ms", "_hit", "_mem", book).withColumn("_ok_memory", F.coalesce(ok_mem, F.lit(False)))
    todo = tried(todo, book.fold_runs(F.col("source"), "terms"), "_st", F.col("_ok_memory")).withColumn("_ok_structured_dict", ~F.col("_ok_memory") & good_by_terms(F.col("source"), F.col("_st")))
    todo = tried(todo, book.fold(book.fold(F.col("source"), "terms"), "norm_terms"), "_tm", F.col("_ok_memory") | F.col("_ok_structured_dict"))
    todo = todo.withColumn("_ok_section_dict", ~F.col("_ok_memory") & ~F.col("_ok_structured_dict") & good_by_terms(F.col("source"), F.col("_tm")))
    by = lambda name: F.struct(F.col(name).alias("translated"), F.col(f"{name}_flags").alias("flags"))
    route, value = None, None
    for name, c in (("memory", "_mem"), ("structured_dict", "_st"), ("section_dict", "_tm")):
        ok = F.col(f"_ok_{name}")
        route = F.when(ok, name) if route is None else route.when(ok, name)
        value = F.when(ok, by(c)) if value is None else value.when(ok, by(c))
    keep = [c for c in texts.columns]
    resolved = todo.withColumns({"route": route, "_v": value}).select(*keep, "route", F.col("_v.translated").alias("translated"), F.col("_v.flags").alias("flags"))
    plain = d.where("_pass").select(
        *keep, F.lit("passthrough").alias("route"), F.col("source").alias("translated"), F.array().cast("array<string>").alias("flags")
    )
    return plain.unionByName(resolved)


def micro_batches(pending: DataFrame) -> DataFrame:
    """pending(section, source), distinct, with complexity, n (length), batch_size and batch_no.

    Batches hold texts of one complexity in order of length, then of text hash; their size follows from the longest
    and the mean text of the complexity. A place in that order is the place within (complexity, length, first three
    digits of the hash) plus the number of texts in earlier such groups, so no window holds all rows of a large input:
    the sums run over at most 4096 groups for each length.
    """
    d = pending.withColumns({"complexity": T.complexity(F.col("source")), "n": F.length("source"), "_hash": F.sha1(F.encode(F.concat_ws("|", "section", "source"), "utf-8"))})
    size = d.groupBy("complexity").agg(T.batch_size(F.max("n"), F.avg("n")).alias("batch_size"))
    d = d.withColumn("_part", F.substring("_hash", 1, 3))
    group = ["complexity", "n", "_part"]
    counts = d.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    lengths = counts.groupBy("complexity", "n").agg(F.sum("_rows").alias("_rows"))
    before = lambda rows, by, order: rows.withColumn("_before", F.sum("_rows").over(Window.partitionBy(*by).orderBy(order)) - F.col("_rows")).drop("_rows")
    shorter = before(lengths, ["complexity"], "n").withColumnRenamed("_before", "_shorter")
    earlier = before(counts, ["complexity", "n"], "_part").join(shorter, ["complexity", "n"])
    d = d.join(earlier, group).join(F.broadcast(size), "complexity")  # at most five rows
    place = F.col("_shorter") + F.col("_before") + F.row_number().over(Window.partitionBy(*group).orderBy("_hash")) - 1
    return d.withColumn("batch_no", F.floor(place / F.col("batch_size"))).drop("_hash", "_part", "_before", "_shorter")


def _ask(model: Callable[[list[str]], list[str]], texts: list[str]) -> list[str]:
    """The model's answers to a batch; if it fails or miscounts, to each text alone; where that fails too, the text."""
    for batch in (texts, *([t] for t in texts)):
        try:
            got = list(model(list(batch)))
        except Exception:  # noqa: BLE001 - any failure of the service means another way
            got = []
        if batch is texts:
            if len(got) == len(texts):
                return [g or t for g, t in zip(got, texts)]
            alone: list[str] = []
        else:
            alone.append(got[0] if len(got) == 1 and got[0] else batch[0])
    return alone


def call_model(pending: DataFrame, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """pending(section, source), distinct, with model_text. Without a model that is the source.

    The model gets one micro-batch at a time; a batch it can't answer is asked again text by text.
    """
    if model is None:
        return pending.select("section", "source", F.col("source").alias("model_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            group = (pdf[["complexity", "batch_no"]] != pdf[["complexity", "batch_no"]].shift()).any(axis=1).cumsum()
            whole = pdf[group < group.iloc[-1]] if len(pdf) else pdf
            left = pdf[group == group.iloc[-1]] if len(pdf) else None  # may go on in the next Arrow batch
            for _, part in whole.groupby(group[group < group.iloc[-1]]) if len(whole) else ():
                yield part.assign(model_text=_ask(model, part["source"].tolist()))[["section", "source", "model_text"]]
        if left is not None and len(left):
            yield left.assign(model_text=_ask(model, left["source"].tolist()))[["section", "source", "model_text"]]

    b = micro_batches(pending).select("section", "source", "complexity", "batch_no")
    n = max(b.sparkSession.sparkContext.defaultParallelism, int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    together = b.repartition(n, "complexity", "batch_no").sortWithinPartitions("complexity", "batch_no")
    return together.mapInPandas(run, "section string, source string, model_text string")


def resolve_pending(pending: DataFrame, book: Book, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """pending(section, source) with translated and route of the slow path."""
    d = spread(book.attach(call_model(pending, model), "source", "model_text"))

    def judged(d: DataFrame, name: str) -> DataFrame:
        """d with the finalised name and whether it is unsound; each judged beside its own Arrow step, so that no
        generated method holds the tests of all three."""
        d = finalise(d, "source", f"{name}0", name, book).drop(f"{name}0", f"{name}_untranslated", f"{name}_flags")
        return d.withColumn(f"{name}_bad", T.unsound(F.col("source"), F.col(name)))

    d = judged(d.withColumn("_m0", book.fold(book.fold(F.col("model_text"), "terms"), "norm_terms")), "_m")
    d = judged(d.withColumn("_s0", book.fold_runs(F.col("source"), "terms")), "_s")
    d = d.withColumn("_d0", book.fold(F.col("source"), "terms"))
    d = judged(d.withColumn("_d0", fold_fixed(F.col("_d0"), CAD_TERMS, longest_first=False)), "_d")
    d = d.withColumn("_share", T.word_share(F.col("_d")))
    accept = ~F.col("_d_bad") & (F.col("_share") >= 0.35) & ~((F.col("section") == "UNKNOWN") & (F.col("_share") < 0.5)) & (
        F.length("_d") >= F.greatest(F.lit(4), F.floor(F.length("source") * 0.18)))
    ok_model, ok_struct = ~F.col("_m_bad"), ~F.col("_s_bad")
    route = F.when(ok_model, "ollama").when(ok_struct, "structured_fallback").when(accept, "section_dict").otherwise("fallback")
    value = F.when(ok_model, F.col("_m")).when(ok_struct, F.col("_s")).when(accept, F.col("_d")).otherwise(
        F.coalesce(F.nullif(F.col("_m"), F.lit("")), F.col("source")))
    return d.select("section", "source", value.alias("translated"), route.alias("route"))


def quality_flags(source: Column, value: Column, own: Column) -> Column:
    """Flags of a finalised value, sorted: those of finalising, leftover Chinese, low quality."""
    more = F.array_compact(F.array(F.when(T.has_cn(value), "contains_chinese"), F.when(T.unsound(source, value), "low_quality")))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")), more)))


def translate(segments: DataFrame, book: Book, memory: DataFrame,
              model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """segments(doc_id, seq, text) with section, text (cleaned), translated, translation_source, untranslated_chinese, qc_flags.

    The first row of a pending text carries the route's name, its repeats carry it with _duplicate.
    """
    section = T.detect_section(T.clean_source(F.col("text")))
    seg = segments.withColumn("section", F.when(section == "ПБ", "UNKNOWN").otherwise(section))
    texts = distinct_texts(seg)
    routed = cut(fast_route(texts, memory, book).select("section", "source", "route", "translated", "flags"))
    pending = routed.where("route is null").select("section", "source")
    slow = cut(resolve_pending(pending, book, model)).withColumn("flags", F.array().cast("array<string>")).withColumn("slow", F.lit(True))
    done = routed.where("route is not null").withColumn("slow", F.lit(False)).unionByName(slow)
    done = finalise(spread(book.attach(done, "source", "translated")), "source", "translated", "_f", book)
    is_pass = F.col("route") == "passthrough"
    done = done.withColumn("_f", F.coalesce("_f", F.lit("")))
    flags = quality_flags(F.col("source"), F.col("_f"), F.concat(F.coalesce("flags", F.array().cast("array<string>")), F.col("_f_flags")))
    done = cut(done.select(
        "section", "source", "slow", "route", F.when(is_pass, F.col("source")).otherwise(F.col("_f")).alias("translated"),
        (~is_pass & F.col("_f_untranslated")).alias("untranslated_chinese"),
        F.when(is_pass, F.lit("")).otherwise(F.array_join(flags, ",")).alias("qc_flags"),
    ))
    rows = seg.withColumn("source", T.clean_source(F.col("text"))).drop("text")
    first = rows.groupBy("section", "source").agg(F.min(F.struct("doc_id", "seq")).alias("first"))
    again = F.col("slow") & (F.struct("doc_id", "seq") != F.col("first"))
    return rows.join(done, ["section", "source"]).join(first, ["section", "source"]).withColumn(
        "translation_source", F.concat("route", F.when(again, "_duplicate").otherwise(""))
    ).drop("slow", "route", "first").withColumnRenamed("source", "text")


def clean_memory(memory: DataFrame) -> DataFrame:
    """memory(section, source_text, translated) without entries that are bad by themselves or for their source."""
    bad = T.bad_memory(F.col("translated")) | T.bad_in_context(F.col("source_text"), F.col("translated"))
    return spread(memory).where(~bad).withColumn("translated", T.strip(F.col("translated")))


def upsert_memory(memory: DataFrame, new: DataFrame) -> DataFrame:
    """memory with the entries of new(section, source_text, translated), which win; new must be unique by key."""
    key = ["section", "source_text"]
    usable = new.where((T.strip(F.col("source_text")) != "") & (T.strip(F.col("translated")) != "")).select(
        "section", T.strip(F.col("source_text")).alias("source_text"), T.strip(F.col("translated")).alias("_new"))
    return memory.join(usable, key, "full").select(*key, F.coalesce("_new", "translated").alias("translated"))


def domain_norm(df: DataFrame, text: str, out: str, book: Book) -> DataFrame:
    """df(section, ...) with out: text brought to the wording of design documents."""
    d = book.attach(df, text).withColumn(out, fold_fixed(F.coalesce(F.col(text), F.lit("")), NORM_TERMS)).withColumn(out, book.fold(F.col(out), "norm_terms"))
    n = r"(\p{Nd}+)"
    # fixed values: the wording rules of design documents, in the order in which they build on one another
    steps: list[tuple[str, str, bool]] = [
        (r"(?iuU)^также можно\b", "допускается", True), (r"(?iuU)^можно\b", "допускается", True), (r"(?iuU)\bне менее\b", "не менее", True),
        ("[φΦфФ]", "Ø", True), (rf"DN{T.WS}*?{n}", "DN$1", True), (rf"{n}{T.WS}*[xхXХ]{T.WS}*{n}", "$1×$2", True),
        (rf"H{T.WS}*={T.WS}*{n}", "H=$1", True), (rf"L{T.WS}*={T.WS}*{n}", "L=$1", True), (rf"{n}{T.WS}*mm", "$1 мм", True), (rf"{n}мм", "$1 мм", True),
        (rf"(?U)(\p{{Nd}}+(\.\p{{Nd}}+)?){T.WS}*m\b", "$1 м", True), (rf"比例{T.WS}*{n}{T.WS}*[:：]{T.WS}*{n}", "М $1:$2", True),
        (rf"(?iu)масштаб{T.WS}*{n}{T.WS}*[:：]{T.WS}*{n}", "М $1:$2", True), (r"\+?0\.000", "±0.000", True),
        ("отметка", "отм.", False), ("отметки", "отм.", False), ("наружный диаметр", "Ø", False), ("глубина ", "Глубина ", False),
        (rf"Ø{T.WS}*{n}", "Ø$1", True), (rf"DN{n}{T.WS}*мм", "DN$1 мм", True), (rf"{n}×{n}{T.WS}*мм", "$1×$2 мм", True),
        ("высота установки", "H=", False), ("длина", "L=", False), ("квадратный колодец квадратный колодец", "квадратный колодец", False),
        ("круглый колодец круглый колодец", "круглый колодец", False), ("по грани стальной колонны грани", "по грани стальной колонны", False),
        ("привязать привязать", "привязать", False), ("допускается устройство допускается", "допускается устройство", False),
    ]
    v = F.col(out)
    for k, (find, to, regex) in enumerate(steps):
        v = F.regexp_replace(v, find, to) if regex else F.replace(v, F.lit(find), F.lit(to))
        if k % 8 == 7:
            d, v = d.withColumn(out, v), F.col(out)
    return d.withColumn(out, v).withColumn(out, T.squash(F.concat(F.upper(F.substring(F.col(out), 1, 1)), F.expr(f"substring({out}, 2)"))))
