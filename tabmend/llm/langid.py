"""Language identification of web pages by Bayesian evidence fusion.

Four sources of evidence about a page's language are multiplied: the likelihood of
its visible text under byte-trigram models, its declared markup language, its
address's language mark (path part, first label or country), and its host's
prior. Trigram models are fitted on a bounded sample of labelled documents
(`bound`). How far declarations and address marks can be trusted is counted from
the pages themselves against the text's own best guess. Host priors are sums of
the text's posteriors, one grouped aggregation for each level, smoothed from all
pages to the registered domain to the host. A page's own posterior is left out of
its prior, so that its text counts once. Hosts with more than 1 / HOT of all pages
meet their prior through salted keys, so that they spread.

Results in odd cases: a null or empty page, or one without letters, has flat text
likelihood and is judged by its other evidence; a missing address has an empty
host and no mark; unknown declarations count as none; repeated rows get equal
results; without labelled documents the text says nothing; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmend.llm.common import materialize, small_batches

#: Trigrams are hashed to 2^16; labelled documents to fit on; pseudo-pages of each prior's parent; parts of a host.
BITS, BOUND, STRENGTH, SALTS, HOT = 16, 2000, 4.0, 32, 500
#: Trigrams of running text repeat each other's evidence; a text counts at most as this many.
WEIGHT, MOST = 0.5, 400.0
#: Languages of countries that mostly use one, by the country's suffix.
COUNTRIES = {
    "de": "de", "at": "de", "li": "de", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "fr": "fr", "mc": "fr", "sn": "fr",
    "es": "es", "mx": "es", "ar": "es", "cl": "es", "pe": "es", "uy": "es", "ec": "es", "ve": "es", "bo": "es", "cr": "es", "it": "it",
    "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl", "ru": "ru", "ua": "uk", "cz": "cs", "sk": "sk", "hu": "hu", "ro": "ro", "bg": "bg",
    "gr": "el", "tr": "tr", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "jp": "ja", "kr": "ko", "cn": "zh", "tw": "zh", "vn": "vi", "th": "th", "ir": "fa", "il": "he",
}
#: Second labels under which countries register domains.
SECOND = ["co", "com", "org", "net", "edu", "gov", "ac", "or", "ne", "go", "gob", "gouv", "nom", "asso", "gv", "ltd", "plc", "sch", "mil"]
TAGS = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;"


def trigrams(text: str) -> np.ndarray:
    """Hashes of the byte trigrams of a lower-cased text whose non-letters are single spaces."""
    kept = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    data = np.frombuffer(f" {kept} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 5:
        return np.empty(0, np.int64)
    code = data[:-2] * np.uint32(65536) + data[1:-1] * np.uint32(256) + data[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def _profiles(batches):
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            rows.append(np.bincount(trigrams(text or ""), minlength=1 << BITS))
        sums: dict[str, np.ndarray] = {}
        for lang, row in zip(batch.column("lang").to_pylist(), rows, strict=True):
            sums[lang] = sums.get(lang, 0) + row
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "gram", "c"])


def text_models(docs: DataFrame, bound: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and log likelihoods of each trigram, from the `bound` labelled documents of the least id hashes."""
    picked = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(bound)
    rows = docs.join(F.broadcast(picked), F.col(id_col) == F.col("_id")).filter(F.col(lang_col).isNotNull())
    rows = rows.groupBy("_id").agg(F.min(F.struct(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))).alias("m")).select("m.lang", "m.text")
    counts = rows.mapInArrow(_profiles, "lang string, gram int, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((1 << BITS, max(1, len(langs))), 0.1)
    if langs:
        at = np.array([langs.index(x) for x in counts.column("lang").to_pylist()])
        np.add.at(table, (counts.column("gram").to_numpy(), at), counts.column("c").to_numpy())
    return langs, np.log(table / table.sum(0))


def visible(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), TAGS, " ")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.regexp_replace(host, r"^(www|m)\.", "")


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, or three where a country registers under second labels."""
    second = F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    country = F.length(F.substring_index(host, ".", -1)) == 2
    return F.when(country & second.isin(SECOND), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def declared_language(html: Column) -> Column:
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})\b""", 1)
    return F.lower(found)


def address_mark(url: Column, langs: list[str]) -> Column:
    """The language code that starts the path (/de/) or the host (de.), or the language of the country that ends it (.at)."""
    host = host_of(url)
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?(?:[/?#]|$)", 1))
    country = F.try_element_at(F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair)), F.substring_index(host, ".", -1))
    places = [path, F.substring_index(host, ".", 1), country]
    return F.coalesce(*(F.when(p.isin(langs), p) for p in places), F.lit("")) if langs else F.lit("")


def _likelihoods(model, n: int):
    def run(batches):
        table = model.value
        for batch in batches:
            out = np.zeros((batch.num_rows, n))
            for i, text in enumerate(batch.column("text").to_pylist()):
                grams = trigrams(text or "")
                if len(grams):
                    mean = table[grams].mean(0)
                    out[i] = (mean - mean.max()) * min(MOST, WEIGHT * len(grams))
            values = pa.array(out.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n), values)
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), lists], names=[*names, "text_log"])

    return run


def _softmax(logs: Column) -> Column:
    most = F.array_max(logs)
    each = F.transform(logs, lambda x: F.exp(x - most))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.transform(each, lambda x: x / total)


def _sum_vectors(name: str, n: int) -> Column:
    return F.array(*(F.sum(F.col(name)[i]) for i in range(n)))


def languages(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bound: int = BOUND) -> DataFrame:
    """Per row of pages: id, host, declared, mark, text_lang, lang and its probability. docs: (doc_id, text, lang) to fit text models on."""
    spark = pages.sparkSession
    small_batches(spark)
    langs, table = text_models(docs, bound, "doc_id", "text", "lang")
    langs = langs or ["und"]
    n = len(langs)
    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), declared_language(html).alias("declared"), address_mark(url, langs).alias("mark"), visible(html).alias("text"))
    rows = rows.withColumn("declared", F.when(F.col("declared").isin(langs), F.col("declared")).otherwise(""))
    shape = T.StructType([f for f in rows.schema.fields if f.name != "text"]).add("text_log", T.ArrayType(T.DoubleType()))
    rows = rows.mapInArrow(_likelihoods(spark.sparkContext.broadcast(table), n), shape)
    names = F.array(*(F.lit(x) for x in langs))
    rows = rows.withColumn("own", _softmax(F.col("text_log"))).withColumn("domain", domain_of(F.col("host")))
    rows = materialize(rows)
    trust = {kind: _trust(rows, kind, langs) for kind in ("declared", "mark")}
    everyone = rows.agg(_sum_vectors("own", n).alias("v"), F.count("*").alias("pages")).first()
    total = np.array([x or 0.0 for x in everyone["v"]]) + 1.0
    world = F.array(*(F.lit(float(x)) for x in total / total.sum()))
    hosts = rows.groupBy("domain", "host").agg(_sum_vectors("own", n).alias("host_v"), F.count("*").alias("pages"))
    hosts = materialize(hosts)
    domains = hosts.groupBy("domain").agg(_sum_vectors("host_v", n).alias("domain_v"))
    hot = [r["host"] for r in hosts.filter(F.col("pages") * HOT > everyone["pages"]).select("host").collect()]  # fewer than HOT
    spread = lambda salt: F.when(F.col("host").isin(hot), salt)
    sums = hosts.join(domains, "domain").select("host", "host_v", "domain_v")
    sums = sums.withColumn("salt", F.explode(spread(F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    salted = rows.withColumn("salt", spread(F.pmod(F.xxhash64("id", "text_log"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    both = salted.join(sums, ["host", "salt"])

    def smoothed(v: str, parent: Column) -> Column:
        rest = F.zip_with(v, "own", lambda x, y: F.greatest(x - y, F.lit(0.0)))
        return F.zip_with(rest, parent, lambda x, p: (x + STRENGTH * p) / (F.aggregate(rest, F.lit(0.0), lambda a, y: a + y) + STRENGTH))

    both = both.withColumn("domain_prior", smoothed("domain_v", world)).withColumn("prior", smoothed("host_v", F.col("domain_prior")))
    evidence = [F.col("text_log"), F.transform("prior", lambda p: F.log(p))]
    for kind, rows_of in trust.items():
        logs = F.create_map(*(x for code, v in rows_of.items() for x in (F.lit(code), F.array(*(F.lit(float(y)) for y in v)))))
        evidence.append(F.element_at(logs, F.col(kind)))
    fused = evidence[0]
    for more in evidence[1:]:
        fused = F.zip_with(fused, more, lambda a, b: a + b)
    both = both.withColumn("posterior", _softmax(fused))
    best = F.array_max(F.transform("posterior", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    text_best = F.array_max(F.transform("text_log", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    return both.select(F.col("id").alias(id_col), "host", "declared", "mark", F.get(names, -text_best["i"]).alias("text_lang"), F.get(names, -best["i"]).alias("lang"), best["p"].alias("probability"))


def _trust(rows: DataFrame, kind: str, langs: list[str]) -> dict[str, np.ndarray]:
    """log P(mark | language) for each mark and for none, counted with the text's posteriors and one pseudo-page."""
    got = rows.groupBy(kind).agg(_sum_vectors("own", len(langs)).alias("v")).collect()  # a row for each language and none
    counts = {code: np.full(len(langs), 0.5) for code in ["", *langs]}
    for r in got:
        counts[r[kind]] = counts[r[kind]] + np.array(r["v"])
    for i, code in enumerate(langs):
        counts[code][i] += 0.5
    total = sum(counts.values())
    return {code: np.log(v / total) for code, v in counts.items()}
