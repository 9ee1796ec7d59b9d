"""Language identification by Bayesian evidence fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borespark.llm.common import Scratch, map_counts, map_slices
from borespark.llm.kernels import Texts, gram_buckets

#: Byte windows and hash buckets of the text model, and its additive smoothing.
GRAM, BITS, SMOOTHING = 3, 14, 0.5
#: Windows of a text that count in full; a longer text's likelihood is scaled down to so many.
EVIDENCE = 60
#: Pseudo-counts with which a suffix leans on all hosts, and a host on its suffix; smoothing of declarations.
SUFFIX_MASS, HOST_MASS, DECLARED_MASS = 50.0, 10.0, 5.0
#: Languages whose window counts the driver turns into a table at a time.
LANGUAGES_AT_ONCE = 128
#: Languages up to which the likelihoods of declarations, their square in numbers, are broadcast; more are joined as planned.
BROADCAST_LANGUAGES = 1024
NONE = ""


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    return F.trim(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " "))


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def declared_language(html: Column) -> Column:
    """The primary subtag of the lang attribute of the html element, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1))


def language_label(lang: Column) -> Column:
    """The primary subtag, of two or three letters in lower case, of a label such as en-GB; null where it has none.

    Labels of another form name no language, which bounds the languages by the form and not by a count.
    """
    tag = F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), r"^[\x20\x09-\x0D]*([A-Za-z]{2,3})(?:$|[^A-Za-z])", 1))
    return F.when(tag != "", tag)


def text_model(texts: DataFrame, scratch: Scratch | None = None) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and ln p[language, bucket] from labelled texts (text, lang), counted over all of them.

    Rows without a language (``language_label``) or text are left out.  All counts are sums over the rows; the
    table on the driver has 2**BITS floats a language.
    """
    scratch = scratch or Scratch(texts.sparkSession, "language")
    labelled = texts.select("text", language_label(F.col("lang")).alias("lang")).where("lang is not null and text is not null")
    languages = [r["lang"] for r in labelled.groupBy("lang").count().orderBy("lang").collect()]
    table = np.empty((len(languages), 1 << BITS), np.float32)
    for lo in range(0, len(languages), LANGUAGES_AT_ONCE):
        own = languages[lo : lo + LANGUAGES_AT_ONCE]
        number = {x: i for i, x in enumerate(own)}

        def run(part: pa.RecordBatch, number=number) -> np.ndarray:
            bucket, bounds = gram_buckets(Texts(part.column("text"), lower=True), GRAM, BITS)
            of = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
            return np.bincount(np.repeat(of << BITS, np.diff(bounds)) + bucket, minlength=len(number) << BITS)[None, :]

        counts = np.zeros(len(own) << BITS)
        found = map_counts(labelled.where(F.col("lang").between(own[0], own[-1])), run, ["n"]).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
        counts = counts.reshape(len(own), 1 << BITS) + SMOOTHING
        table[lo : lo + len(own)] = np.log(counts / counts.sum(axis=1, keepdims=True))
    return languages, table


def text_likelihoods(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """rows with text replaced by ``__ll``: ln p(text | language) per language, scaled to EVIDENCE windows."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    others = [c for c in rows.columns if c != "text"]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(part.column("text"), lower=True)
        bucket, bounds = gram_buckets(texts, GRAM, BITS)
        n = np.diff(bounds)
        total = np.zeros((texts.n, len(languages)))
        filled = np.flatnonzero(n)
        for k in range(len(languages)):
            if len(filled):
                total[filled, k] = np.add.reduceat(shared.value[k][bucket].astype(np.float64), bounds[:-1][filled])
        total *= np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(texts.n + 1, dtype=np.int32) * len(languages)), pa.array(total.ravel()))
        return pa.RecordBatch.from_arrays([part.column(c) for c in others] + [lists], [*others, "__ll"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others) + ", __ll array<double>"
    return map_slices(rows, run, schema)


def identify(rows: DataFrame, languages: list[str], table: np.ndarray, scratch: Scratch | None = None) -> DataFrame:
    """rows (text, host, suffix, declared and others) with lang_pred, confidence, text_lang; text is dropped.

    The posterior of a language multiplies the text's likelihood, that of the declaration, and the prior
    of the host.  All of the latter come from grouped sums of the texts' own posteriors: how often each
    language is declared as what (declarations outside the languages form one group; none is no
    evidence); and language shares per host, smoothed towards those of the suffix, which are smoothed
    towards all rows'.  A row's own part is taken out of its host's and suffix's sums.  Every row holds a number
    per language; likelihoods of declarations, a row per language and one, are joined.

    Null or empty texts, hosts, suffixes and declarations are no evidence; rows without any get the
    overall shares.  Ties go to the first language by name.  Without languages lang_pred is null.  Other columns
    of rows stay; those named as the results or beginning with two underscores are replaced or reserved.
    """
    scratch = scratch or Scratch(rows.sparkSession, "language")
    rows = rows.drop("lang_pred", "confidence", "text_lang")
    if not languages:
        return rows.drop("text").withColumns({"lang_pred": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "text_lang": F.lit(None).cast("string")})
    spark, size = rows.sparkSession, len(languages)
    known = F.array(*[F.lit(x) for x in languages])
    zeros = F.array_repeat(F.lit(0.0), size)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(NONE)) for c in ("text", "host", "suffix", "declared")})
    rows = rows.withColumn("declared", F.when(F.array_contains(known, F.col("declared")) | (F.col("declared") == NONE), F.col("declared")).otherwise("*"))
    scored = text_likelihoods(rows, languages, table)
    top = F.array_max("__ll")
    scored = scored.withColumn("__q", F.transform("__ll", lambda x: F.exp(x - top)))
    scored = scratch.keep(scored.withColumn("__q", F.transform("__q", lambda x: x / F.aggregate("__q", F.lit(0.0), lambda s, v: s + v))), "texts")

    def sums(df, column, *by, name):
        """A row per group with the sums of an array column, an expression per language."""
        parts = [F.coalesce(F.sum(F.get(column, F.lit(i))), F.lit(0.0)) for i in range(size)]
        return df.groupBy(*by).agg(F.array(*parts).alias(name))

    overall = sums(scored, "__q", name="__n").first()["__n"]  # a number per language
    stated = {r["declared"]: r["__n"] for r in sums(scored.where(F.col("declared") != NONE), "__q", "declared", name="__n").collect()}  # a row per language and one
    seen = np.array([stated.get(x, [0.0] * size) for x in [*languages, "*"]]) + 0.0
    seen = seen + DECLARED_MASS * np.vstack([np.eye(size), np.zeros((1, size))]) + 0.01
    ln_declared = np.log(seen / seen.sum(axis=0, keepdims=True))
    p_all = np.array(overall) + 1.0
    p_all = [float(x) for x in p_all / p_all.sum()]
    constants = spark.createDataFrame([(x, own.tolist(), p_all) for x, own in zip([*languages, "*"], ln_declared, strict=True)] + [(NONE, [0.0] * size, p_all)], "__declared string, __ln array<double>, __all array<double>")

    hosts = sums(scored, "__q", "host", "suffix", name="__host_n")
    suffixes = sums(hosts, "__host_n", "suffix", name="__suffix_n")
    priors = scratch.keep(hosts.join(suffixes, "suffix"), "hosts")
    out = scored.join(priors.withColumnsRenamed({"host": "__host", "suffix": "__suffix"}), (F.col("host") == F.col("__host")) & (F.col("suffix") == F.col("__suffix")))
    constants = F.broadcast(constants) if size <= BROADCAST_LANGUAGES else constants  # languages + 2 rows of so many numbers
    out = out.join(constants, F.col("declared") == F.col("__declared"))

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def without(column, empty):
        return F.when(F.col(empty) == NONE, zeros).otherwise(F.zip_with(column, "__q", lambda n, q: F.greatest(F.lit(0.0), n - q)))

    out = out.withColumns({"__host_n": without("__host_n", "host"), "__suffix_n": without("__suffix_n", "suffix")})
    out = out.withColumns({"__hn": total("__host_n"), "__sn": total("__suffix_n")})
    out = out.withColumn("__ps", F.zip_with("__suffix_n", "__all", lambda n, p: (n + SUFFIX_MASS * p) / (F.col("__sn") + SUFFIX_MASS)))
    out = out.withColumn("__ph", F.zip_with("__host_n", "__ps", lambda n, p: (n + HOST_MASS * p) / (F.col("__hn") + HOST_MASS)))
    out = out.withColumn("__post", F.zip_with(F.zip_with("__ll", "__ln", lambda a, b: a + b), "__ph", lambda a, p: a + F.ln(p)))
    out = out.withColumn("__max", F.array_max("__post"))
    pick = lambda c: F.element_at(known, F.array_position(c, F.array_max(c)).cast("int"))
    out = out.withColumns({"lang_pred": pick(F.col("__post")), "confidence": 1 / total(F.transform("__post", lambda x: F.exp(x - F.col("__max")))), "text_lang": F.when(total(F.transform("__ll", F.abs)) > 0, pick(F.col("__ll")))})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, host, suffix, declared) of pages (page_id, url, html)."""
    host = host_of(F.col("url"))
    return pages.select("page_id", visible_text(F.col("html")).alias("text"), host.alias("host"), suffix_of(host).alias("suffix"), declared_language(F.col("html")).alias("declared"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """(doc_id, text, host, suffix, declared) of documents: the source stands for the host; no markup."""
    return docs.select("doc_id", "text", F.col("source").alias("host"), F.lit(NONE).alias("suffix"), F.lit(NONE).alias("declared"))
