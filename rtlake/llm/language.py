"""Language ID by Bayesian evidence fusion.

The text gives log-likelihoods under one byte trigram model per language. Three other sources of evidence are
learnt from all rows by grouped aggregation of the text's own posteriors: how often each language is declared as each
code in the markup, how often it shows as each code in the address (top-level domain or first path segment), and how
often it occurs on the row's host, smoothed towards the host's domain, which is smoothed towards all rows. A row's own
share is taken out of its host's and domain's sums before they count as its prior.

The trigram models are fitted on at most ``SAMPLE`` rows with a known language, chosen by hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rtlake.llm.common import cut, table
from rtlake.llm.texts import map_texts

SAMPLE, BITS = 4_000, 16
#: Trigrams overlap, so their evidence counts by a third; the text's evidence is bounded (nats).
TEMPER, MOST = 1 / 3, 40.0
#: Pseudo-rows: of a channel's cell, of the domain's prior, of the host's prior. Least posterior that is accepted.
CHANNEL, DOMAIN, HOST, SURE = 1.0, 20.0, 10.0, 0.5


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of a text's bytes, lower-cased, with letters only; empty if it has no letters."""
    low = (text or "").lower()
    raw = np.frombuffer(f" {low} ".encode(), np.uint8).copy()
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    if not letter.any():
        return np.zeros(0, np.uint16)
    raw[~letter] = 32
    x = raw.astype(np.uint32)
    h = (x[:-2] << 16 | x[1:-1] << 8 | x[2:])[letter[:-2] | letter[1:-1] | letter[2:]]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by language and trigram) from rows (doc_id, text, lang) with a known language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.groupBy("doc_id").agg(F.min("lang").alias("known_lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def body(parts: Iterator) -> Iterator[dict]:
        for p in parts:
            yield {"lang": p.column("known_lang"), "codes": [trigrams(t).tobytes() for t in p.column("text").to_pylist()]}

    found = map_texts(known.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "lang string, codes binary", body).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    seen = np.full((len(langs), 1 << BITS), 0.1)
    for lang, codes in zip(found["lang"].to_pylist(), found["codes"].to_pylist(), strict=True):
        np.add.at(seen[langs.index(lang)], np.frombuffer(codes, np.uint16), 1)
    return langs, np.log(seen / seen.sum(1, keepdims=True)).astype(np.float32)


def likelihoods(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, text, host, domain, declared, address) -> the same without text, with evidence (log-likelihoods, 0 at best) and letters."""
    shared = rows.sparkSession.sparkContext.broadcast(model[1])
    keys = ("doc_id", "host", "domain", "declared", "address")

    def body(parts: Iterator) -> Iterator[dict]:
        logs = shared.value
        for p in parts:
            every, letters = [], []
            for t in p.column("text").to_pylist():
                codes = trigrams(t)
                ll = logs[:, codes].sum(1, dtype=np.float64) * TEMPER
                every.append(np.maximum(ll - ll.max(initial=-np.inf), -MOST) if len(codes) else np.zeros(len(logs)))
                letters.append(len(codes))
            yield {k: p.column(k) for k in keys} | {"evidence": every, "letters": letters}

    return map_texts(rows.select(*keys, "text"), "doc_id long, host string, domain string, declared string, address string, evidence array<double>, letters long", body)


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    each = [F.exp(x - top) for x in logs]
    return [x / reduce(lambda a, b: a + b, each) for x in each]


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, host, language, confidence, text_language, letters, accepted: one row per row of ``rows``.

    ``rows``: doc_id long, text, host, domain, declared, address (strings, any may be null). A null or letterless
    text gives no evidence: priors and declarations decide, and the row is not accepted. Null host or domain: the next
    level alone. Without a known language in training nothing can be identified: language is null.
    """
    langs = model[0]
    if not langs:
        return rows.select("doc_id", "host", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_language"), F.lit(0).cast("long").alias("letters"), F.lit(False).alias("accepted"))
    k = range(len(langs))
    base = likelihoods(rows, model).withColumns({f"e{i}": F.element_at("evidence", i + 1) for i in k}).drop("evidence")
    base = cut(base.withColumns({f"t{i}": F.when(F.col("letters") > 0, p).otherwise(0.0) for i, p in enumerate(_softmax([F.col(f"e{i}") for i in k]))}))
    sums = [F.sum(f"t{i}").alias(f"s{i}") for i in k]
    total = base.agg(*sums).first()
    overall = [((total[i] or 0.0) + 1) / (sum(x or 0.0 for x in total) + len(langs)) for i in k]

    def channel(column: str) -> list[Column]:
        """Log of P(code | language) for the row's code; none at all says nothing. Codes that aren't languages count as one."""
        code = F.when(F.col(column).isin(langs), F.col(column)).otherwise("?")
        seen = {r["code"]: r for r in base.filter(F.col(column).isNotNull()).groupBy(code.alias("code")).agg(*sums).collect()}
        out = []
        for i in k:
            whole = sum(r[f"s{i}"] for r in seen.values()) + CHANNEL * (len(langs) + 1)
            logs = {c: float(np.log((seen[c][f"s{i}"] if c in seen else 0.0) + CHANNEL) - np.log(whole)) for c in [*langs, "?"]}
            table = F.create_map(*[F.lit(x) for kv in logs.items() for x in kv])
            out.append(F.when(F.col(column).isNull(), 0.0).otherwise(F.element_at(table, code)))
        return out

    hosts = base.filter(F.col("host").isNotNull()).groupBy("host").agg(*[F.sum(f"t{i}").alias(f"h{i}") for i in k])
    domains = base.filter(F.col("domain").isNotNull()).groupBy("domain").agg(*[F.sum(f"t{i}").alias(f"d{i}") for i in k])
    both = base.join(domains, "domain", "left").join(hosts, "host", "left")
    less = lambda level, i: F.greatest(F.coalesce(F.col(f"{level}{i}") - F.col(f"t{i}"), F.lit(0.0)), F.lit(0.0))
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    domain = [(less("d", i) + DOMAIN * overall[i]) / (add([less("d", j) for j in k]) + DOMAIN) for i in k]
    both = both.withColumns({f"p{i}": x for i, x in enumerate(domain)})
    prior = [(less("h", i) + HOST * F.col(f"p{i}")) / (add([less("h", j) for j in k]) + HOST) for i in k]
    said, shown = channel("declared"), channel("address")
    post = _softmax([F.col(f"e{i}") + F.log(prior[i]) + said[i] + shown[i] for i in k])
    both = both.withColumns({f"q{i}": p for i, p in enumerate(post)})

    def best(name: str) -> Column:
        top = F.greatest(*[F.col(f"{name}{i}") for i in k]) if len(langs) > 1 else F.col(f"{name}0")
        return F.coalesce(*[F.when(F.col(f"{name}{i}") == top, F.lit(x)) for i, x in enumerate(langs)])

    sure = F.greatest(*[F.col(f"q{i}") for i in k]) if len(langs) > 1 else F.col("q0")
    return both.select("doc_id", "host", best("q").alias("language"), sure.alias("confidence"), F.when(F.col("letters") > 0, best("t")).alias("text_language"), "letters", ((F.col("letters") > 0) & (sure >= SURE)).alias("accepted"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence of web pages (page_id, url, html): visible text, host, domain, language of the markup and of the address."""
    clean = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    host = F.nullif(F.lower(F.regexp_extract("url", r"^\w+://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    return pages.select(
        F.col("page_id").alias("doc_id"),
        clean.alias("text"),
        host.alias("host"),
        F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"),
        F.nullif(F.lower(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1)), F.lit("")).alias("declared"),
        F.nullif(F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"^\w+://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1), F.lit("")), F.regexp_extract(host, r"\.([a-z]{2})$", 1))), F.lit("")).alias("address"),
    )


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence of documents: their text, the source as host, and the stated language as the declared one."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.col("source").alias("host"), none.alias("domain"), F.col("lang").alias("declared"), none.alias("address"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; the trigram models come from documents of known language."""
    found = identify(of_pages(table(spark, sf_dir, "pages")), train(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("doc_id", "page_id")
