"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are multiplied: likelihoods of the text under byte-trigram models, the language
that the markup declares, the address suffix (top-level domain and a language segment of the path),
and a prior of the host. Host priors shrink towards the registered domain and that towards all pages;
they and the suffix likelihoods come from grouped sums of first-pass posteriors, from which each page
first takes its own part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .html_text import RAW, lines_of
from .url_filter import domain_of, host_of, path_of, suffix_of
from .words import each, text_batches

#: Trigram buckets; labelled rows that the text models are fitted on.
BUCKETS = 1 << 15
TRAIN_ROWS = 2000
#: Bytes of a text that are turned into trigrams at a time, so that memory does not grow with the text.
STRIP = 1 << 20
#: Comments, raw text and the start tags that may declare a language; whatever is opened and not closed goes to the end.
DECLARING = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})(?=[\s/>]).*?(?:</\1\s*>|\Z)|<(?:html|body)\b([^>]*)", re.I | re.S)
LANG = re.compile(r"\b(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
#: Trigrams that a text of any length is worth at most, smoothly approached: neighbouring ones repeat each other.
EVIDENCE = 60.0
#: Chance that markup declares the right language, when it declares one that is known.
DECLARED_RIGHT = 0.85
#: Pages of the parent that a prior is worth, and pages added to each suffix count.
HOST_PAGES, DOMAIN_PAGES, SUFFIX_PAGES = 10.0, 100.0, 5.0
#: Hosts, domains or suffixes whose sums are broadcast at most: some 100 bytes each. More are joined by key.
MOST_GROUPS = 100_000


def trigrams(data: bytes):
    """Bucket of each byte trigram of a text; ASCII digits and white space are one character."""
    import numpy as np

    x = np.frombuffer(b" " + data + b" ", np.uint8)
    x = np.where((x < 65), np.uint8(32), x).astype(np.uint32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


def strips(text: str) -> Iterator:
    """The trigrams of a whole text in lower case, one strip at a time."""
    data = text.lower().encode("utf-8", "surrogatepass")
    for at in range(0, len(data), STRIP):
        yield trigrams(data[at : at + STRIP])


def declared_language(page: str | None) -> str | None:
    """The language that the first ``html`` or ``body`` tag with one declares, wherever in the page it stands."""
    for m in DECLARING.finditer(page or ""):
        found = LANG.search(m.group(2) or "")
        if found:
            return found.group(1).lower()
    return None


def fit_models(rows: list[tuple[str, int, int]]) -> tuple[list[str], object]:
    """(languages, log-likelihoods[bucket, language]) of (language, bucket, count) rows, smoothed by one half."""
    import numpy as np

    langs = sorted({lang for lang, _, _ in rows})
    column = {lang: i for i, lang in enumerate(langs)}
    counts = np.full((BUCKETS, max(1, len(langs))), 0.5)
    for lang, bucket, n in rows:
        if bucket >= 0:
            counts[bucket, column[lang]] += n
    return langs or ["und"], np.log(counts / counts.sum(axis=0)).astype(np.float32)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], object]:
    """Models from the whole texts of at most ``rows`` documents that have a language, chosen by a hash of the id.

    Texts are counted where they lie; one number for each language and bucket comes to the driver.
    """
    text_batches(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    picked = [r[0] for r in known.select(id_col).distinct().orderBy(F.xxhash64(F.lit(5), id_col), id_col).limit(rows).collect()]
    ids = docs.sparkSession.createDataFrame([(i,) for i in picked], T.StructType([T.StructField("i", docs.schema[id_col].dataType)]))
    sample = known.join(F.broadcast(ids), known[id_col] == ids["i"]).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"))

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            for lang, text in zip(each(b.column(0)), each(b.column(1)), strict=True):
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for grams in strips(text):
                    total += np.bincount(grams, minlength=BUCKETS)
        for lang, total in sums.items():
            g = np.append(-1, np.flatnonzero(total))  # -1: the language was seen, though its texts may be empty
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int32)), pa.array(np.append(0, total[g[1:]]))], names=["l", "g", "n"])

    counts = sample.mapInArrow(count, "l string, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    return fit_models([tuple(r) for r in counts.collect()])


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, models: tuple[list[str], object], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, lang, prob, declared (of the markup, null if none).

    A null or empty page has no text evidence and gets the language of its host; a null url belongs to
    the empty host. Languages that the models do not know are never answered. Ties go to the first
    language by code point. Repeated rows count each; an empty table gives no rows.
    """
    langs, table = models
    text_batches(pages.sparkSession)
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def likelihoods(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = shared.value
        for b in batches:
            logs, declared = [], []
            for page in each(b.column(3)):
                score, n = np.zeros(len(langs)), 0
                for grams in strips("\n".join(lines_of(page)[1])):
                    score += model[grams].sum(axis=0, dtype=np.float64)
                    n += len(grams)
                logs.append((score * (EVIDENCE / (EVIDENCE + n))).tolist())
                declared.append(declared_language(page))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(logs, pa.list_(pa.float64())), pa.array(declared, pa.string())], names=["id", "host", "path", "logs", "declared"])

    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).alias("html"))
    rows = rows.mapInArrow(likelihoods, f"id {kind}, host string, path string, logs array<double>, declared string")
    segment = F.regexp_extract("path", r"(?i)^/([a-z]{2})(?:[-_][a-z]{2})?(?:/|$)", 1)
    k = len(langs)
    wrong = (1 - DECLARED_RIGHT) / max(1, k - 1)
    markup = F.when(F.col("declared").isin(*langs), F.array(*(F.when(F.col("declared") == x, F.lit(DECLARED_RIGHT)).otherwise(F.lit(wrong)) for x in langs))).otherwise(
        F.array(*(F.lit(1.0) for _ in langs))
    )
    rows = rows.select(
        "id", "host", "declared", domain_of(F.col("host")).alias("domain"), F.concat(suffix_of(F.col("host")), F.lit("/"), F.lower(segment)).alias("suffix"),
        F.zip_with("logs", markup, lambda x, m: x + F.ln(m)).alias("logs"),
    )
    rows = materialize(rows.withColumn("p", _softmax(F.col("logs"))), "likelihoods")
    sums = lambda by: rows.groupBy(by).agg(F.array(*(F.sum(F.col("p")[i]) for i in range(k))).alias(f"{by}_sum"))
    total = rows.agg(*(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k))).first()
    everyone = [(total[f"s{i}"] or 0.0) + 1.0 for i in range(k)]
    base = F.array(*(F.lit(x / sum(everyone)) for x in everyone))
    hosts = rows.groupBy("host").agg(F.first("domain").alias("domain"), F.array(*(F.sum(F.col("p")[i]) for i in range(k))).alias("host_sum"))
    near = lambda table: F.broadcast(table) if table.count() <= MOST_GROUPS else table
    hosts = near(materialize(hosts.drop("domain"), "hosts"))
    joined = rows.join(hosts, "host").join(near(materialize(sums("domain"), "domains")), "domain").join(near(materialize(sums("suffix"), "suffixes")), "suffix")
    whole = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    less = lambda xs: F.zip_with(xs, F.col("p"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    shrink = lambda own, parent, worth: F.transform(F.zip_with(own, parent, lambda a, b: a + b * worth), lambda x: x / (whole(own) + worth))
    joined = joined.withColumn("d", shrink(less(F.col("domain_sum")), base, DOMAIN_PAGES))
    joined = joined.withColumn("h", shrink(less(F.col("host_sum")), F.col("d"), HOST_PAGES))
    # the suffix as a likelihood: its share of a language over its share of all pages
    joined = joined.withColumn("s", F.zip_with(shrink(less(F.col("suffix_sum")), base, SUFFIX_PAGES), base, lambda a, b: a / b))
    fused = F.zip_with(F.zip_with("logs", "h", lambda x, h: x + F.ln(h)), "s", lambda x, s: x + F.ln(s))
    joined = joined.select("id", "declared", _softmax(fused).alias("post"))
    best = F.array_max("post")
    answer = F.element_at(F.array(*(F.lit(x) for x in langs)), F.array_position("post", best).cast("int"))
    return joined.select(F.col("id").alias(id_col), answer.alias("lang"), F.round(best, 6).alias("prob"), "declared")
