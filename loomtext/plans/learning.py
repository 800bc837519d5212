"""Glossary learning: candidates from translated documents, their scores and promotion, and frequent unknown terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T

KEY = ["section", "cn", "current_ru"]
SYNC_ROWS = 3000
#: Segments of a document that are hashed together.
CHUNK = 20_000


def document_keys(segments: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, doc_key): first 12 hex digits of the SHA-1 over section and text of all segments in order.

    A document of up to chunk segments is hashed as a whole. Of a longer one each run of chunk segments is hashed on its
    own, then the hashes in order, so that no row holds more than chunk segments or hashes of a document's.
    """
    line = F.concat(T.strip(F.coalesce("section", F.lit("UNKNOWN"))), F.lit("||"), T.strip(F.coalesce("text", F.lit(""))))
    joined = lambda item, c: F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x[c]), "\n")
    low = segments.groupBy("doc_id").agg(F.min("seq").alias("_low"), F.count(F.lit(1)).alias("_n"))
    d = segments.select("doc_id", "seq", line.alias("line")).join(low, "doc_id")
    d = d.withColumn("_part", F.when(F.col("_n") > chunk, F.floor((F.col("seq") - F.col("_low")) / chunk)).otherwise(F.lit(0)))
    parts = d.groupBy("doc_id", "_part").agg(F.first("_n").alias("_n"), joined(F.struct("seq", "line"), "line").alias("payload"))
    parts = parts.withColumn("payload", F.when(F.col("_n") > chunk, F.sha1(F.encode("payload", "utf-8"))).otherwise(F.col("payload")))
    whole = parts.groupBy("doc_id").agg(joined(F.struct("_part", "payload"), "payload").alias("payload"))
    return whole.select("doc_id", F.substring(F.sha1(F.encode("payload", "utf-8")), 1, 12).alias("doc_key"))


def document_triples(segments: DataFrame, keys: DataFrame, approved: DataFrame) -> DataFrame:
    """Viable new triples: (section, cn, current_ru, source, confidence, doc_key), once per document, the first row's origin.

    segments(doc_id, seq, section, text, translated, translation_source); approved(section, cn, ru) in any status.
    """
    sec = F.coalesce(F.nullif(T.strip(F.col("section")), F.lit("")), F.lit("UNKNOWN"))
    origin = F.coalesce(F.nullif(T.strip(F.col("translation_source")), F.lit("")), F.lit("document"))
    d = segments.select("doc_id", "seq", sec.alias("section"), T.strip(F.coalesce("text", F.lit(""))).alias("cn"), T.strip(F.coalesce("translated", F.lit(""))).alias("current_ru"), origin.alias("source"))
    d = d.where(T.viable_candidate(F.col("section"), F.col("cn"), F.col("current_ru"), F.col("source")))
    one = d.groupBy("doc_id", *KEY).agg(F.min_by("source", "seq").alias("source"))
    known = approved.select(*[T.strip(F.coalesce(c, F.lit(""))).alias(a) for c, a in (("section", "section"), ("cn", "cn"), ("ru", "current_ru"))]).distinct()
    one = one.join(known, KEY, "left_anti").join(keys, "doc_id")
    return one.withColumn("confidence", T.candidate_score(F.col("cn"), F.col("current_ru"), F.col("source")))


def upsert_candidates(candidates: DataFrame, triples: DataFrame) -> DataFrame:
    """candidates(section, cn, current_ru, source, standard_ref, status, note, n_docs, confidence, recommended, doc_keys) after one more set of documents.

    doc_keys is an array. The last document (by doc_id) gives the source. An approved candidate keeps its status.
    Syncing the same document again changes nothing.
    """
    new = triples.groupBy(*KEY).agg(
        F.array_sort(F.collect_set("doc_key")).alias("_keys"), F.max("confidence").alias("_conf"), F.max_by("source", "doc_id").alias("_src"))
    j = candidates.withColumn("_old", F.lit(True)).join(new, KEY, "full")
    none = F.array().cast("array<string>")
    keys = F.array_sort(F.array_union(F.coalesce("doc_keys", none), F.coalesce("_keys", none)))
    j = j.withColumns({"_all": keys, "_c": F.greatest(F.coalesce("confidence", F.lit(0.0)), F.coalesce("_conf", F.lit(0.0)))})
    touched = F.col("_keys").isNotNull()
    n = F.when(touched, F.size("_all")).otherwise(F.col("n_docs")).cast("int")
    good = T.recommendable(n, F.col("_c"), F.col("current_ru"))
    kept = T.strip(F.coalesce("status", F.lit("")))
    frozen = ~touched | T.status_approved(F.col("status"))
    return j.select(
        *KEY, F.coalesce("_src", "source").alias("source"), F.coalesce("standard_ref", F.lit("")).alias("standard_ref"),
        F.when(frozen, kept).when(good, "RECOMMENDED").when(kept == "", "NEW").otherwise(kept).alias("status"), F.coalesce("note", F.lit("")).alias("note"),
        n.alias("n_docs"), F.col("_c").alias("confidence"),
        F.when(~frozen & good, "YES").otherwise(F.coalesce("recommended", F.lit(""))).alias("recommended"), F.col("_all").alias("doc_keys"),
    )


def sanitise_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates that are viable, normalised and scored anew; of equal ones the last by ord stays.

    Without an ord the order is that of source, note and status, so that the result doesn't depend on the run.
    """
    d = candidates.withColumns({
        "section": F.coalesce(F.nullif(T.strip(F.col("section")), F.lit("")), F.lit("UNKNOWN")), "cn": T.squash(F.col("cn")), "current_ru": T.squash(F.col("current_ru")),
        "source": F.coalesce(F.nullif(T.strip(F.col("source")), F.lit("")), F.lit("document")),
    })
    d = d.where(T.viable_candidate(F.col("section"), F.col("cn"), F.col("current_ru"), F.col("source")))
    conf = F.greatest(F.coalesce("confidence", F.lit(0.0)), T.candidate_score(F.col("cn"), F.col("current_ru"), F.col("source")))
    d = d.withColumn("confidence", F.round(F.least(conf, F.lit(1.0)), 2)).withColumn("n_docs", F.greatest(F.size("doc_keys"), F.coalesce("n_docs", F.lit(0))))
    good = T.recommendable(F.col("n_docs"), F.col("confidence"), F.col("current_ru"))
    kept = T.strip(F.coalesce("status", F.lit("")))
    status = F.when(good & ~T.status_approved(F.col("status")), "RECOMMENDED").otherwise(F.coalesce(F.nullif(kept, F.lit("")), F.when(good, "RECOMMENDED").otherwise("NEW")))
    d = d.withColumns({"status": status, "recommended": F.when(good, "YES").otherwise("")})
    return last_of(d, KEY)


def last_of(d: DataFrame, key: list[str]) -> DataFrame:
    """Of the rows with equal keys the last: by ord where there is one, then by the other plain columns. Combined before the shuffle."""
    order = [c for c in ("ord", "n_docs", "confidence", "source", "standard_ref", "note", "status") if c in d.columns]
    rest = [c for c in d.columns if c not in key]
    best = d.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*d.columns)


def recommended(candidates: DataFrame) -> DataFrame:
    """Recommended candidates, most documents first, then confidence, then the key."""
    return candidates.where(T.status_recommended(F.col("status")) | T.status_recommended(F.col("recommended"))).orderBy(
        F.desc("n_docs"), F.desc("confidence"), *KEY)


def promote(approved: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(glossary with the recommended candidates added, candidates with these marked). Promoting twice adds nothing."""
    rec = candidates.where(T.status_recommended(F.col("status")) | T.status_recommended(F.col("recommended")))
    key = [T.strip(F.coalesce(c, F.lit(""))) for c in ("section", "cn", "ru")]
    have = approved.select(*[k.alias(n) for k, n in zip(key, KEY)]).distinct()
    fresh = last_of(rec.select(*KEY, "standard_ref", "note", *[c for c in ("ord",) if c in rec.columns]), KEY).join(have, KEY, "left_anti")
    grown = approved.select("section", "cn", "ru", "standard_ref", "status", "note").unionByName(
        fresh.select("section", "cn", F.col("current_ru").alias("ru"), "standard_ref", F.lit("APPROVED").alias("status"), "note"))
    marked = candidates.join(rec.select(*KEY).distinct().withColumn("_hit", F.lit(True)), KEY, "left").withColumns({
        "status": F.when(F.col("_hit"), "APPROVED").otherwise(F.col("status")), "recommended": F.when(F.col("_hit"), "").otherwise(F.col("recommended")),
    }).drop("_hit")
    return grown, marked


def useful_term(c) -> object:
    return (F.length(c) <= 80) & (T.count(c, T.CN) >= 2)


def frequent_terms(segments: DataFrame, known: DataFrame, limit: int = 120) -> DataFrame:
    """The most frequent unknown Chinese terms: (section, cn, count); a whole short text weighs 2, a run in a text 1.

    segments(doc_id, seq, section, text), known(cn). Ties go to the term met first. Counts are combined before the
    shuffle; only the final top-k is ordered as a whole.
    """
    text = T.squash(F.col("text"))
    d = segments.select("doc_id", "seq", F.coalesce(F.nullif(T.squash(F.col("section")), F.lit("")), F.lit("UNKNOWN")).alias("section"), text.alias("t")).where(useful_term(F.col("t")))
    whole = F.when(T.count(F.col("t"), T.CN) <= 16, F.array(F.struct(F.lit(0).alias("pos"), F.col("t").alias("cn"), F.lit(2).alias("w"))))
    runs = F.transform(F.regexp_extract_all("t", F.lit(f"{T.CN}+"), 0), lambda x, i: F.struct((i + 1).alias("pos"), x.alias("cn"), F.lit(1).alias("w")))
    none = F.array().cast("array<struct<pos:int,cn:string,w:int>>")
    e = d.select("doc_id", "seq", "section", F.explode(F.concat(F.coalesce(whole, none), runs)).alias("x")).select("doc_id", "seq", "section", "x.pos", "x.cn", "x.w")
    e = e.where(useful_term(F.col("cn")))
    at = F.struct("doc_id", "seq", "pos")
    counted = e.groupBy("cn").agg(F.sum("w").alias("count"), F.min_by("section", at).alias("section"), F.min(at).alias("first"))
    return counted.join(known.select("cn").distinct(), "cn", "left_anti").orderBy(F.desc("count"), "first").limit(limit).select("section", "cn", "count")


def merge_terms(store: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store after the upsert of new(section, cn, ru), one row with added and updated)."""
    key = ["section", "cn"]
    j = store.select(*key, "ru").join(new.select(*key, F.col("ru").alias("_new")), key, "full")
    counts = j.agg(F.count_if(F.col("ru").isNull()).alias("added"), F.count_if(F.col("ru").isNotNull() & F.col("_new").isNotNull() & (F.col("ru") != F.col("_new"))).alias("updated"))
    return j.select(*key, F.coalesce("_new", "ru").alias("ru")), counts


def rows_to_sync(translated: DataFrame, limit: int = SYNC_ROWS) -> DataFrame:
    """Of a document with more than limit rows, its first limit rows that come from a translation; else all."""
    per = translated.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    ok = F.col("translation_source").rlike("^(?:memory|section_dict|structured_dict|ollama|deepseek)") & ~F.col("translation_source").contains("duplicate")
    d = translated.join(per, "doc_id")
    small, large = d.where(F.col("_n") <= limit), d.where((F.col("_n") > limit) & ok)
    first = Window.partitionBy("doc_id").orderBy("seq")
    return small.unionByName(large.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= limit).drop("_rn")).drop("_n")
