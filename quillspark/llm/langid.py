"""Language identification by Bayesian evidence fusion.

Evidence about a text's language: the likelihood of its byte trigrams under each language's model, the language its
markup declares, the suffix of its address, and what else its host publishes. Host priors are smoothed hierarchically:
a host's counts lean on its domain's, a domain's on those of all texts. Counts for declarations, suffixes, domains and
hosts are grouped sums over all texts, each taken with the language that its own text makes most likely; what a text
itself adds to them is left out where it is judged, so that its words count once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 14
SMOOTHING = 0.5
#: Neighbouring trigrams overlap; so many of them count as one independent piece of evidence.
TRIGRAMS_PER_EVIDENCE = 6.0
#: Counts that the level above weighs as, for hosts, domains, declarations and suffixes.
PRIOR_STRENGTH = 5.0
#: Languages whose model a task holds at once; more languages take more passes over the texts.
LANGUAGE_BLOCK = 256

_RAW = re.compile(rb"(?i)<(script|style)\b")
_CLOSE = {name: re.compile(rb"(?i)</%s\s*>" % name) for name in (b"script", b"style")}


def markup_text(page: bytes) -> bytes:
    """The text of a page, without comments, scripts, styles and tags; entities are resolved. One scan from tag to tag: what is
    looked for ahead is looked for again only behind the place where it was found, and not at all if it never follows."""
    kept, at, close = [], 0, 0
    gone: set[bytes] = set()  # ends that don't follow any more
    while (tag := page.find(b"<", at)) >= 0:
        kept.append(page[at:tag])
        at = tag
        if page.startswith(b"<!--", tag) and b"-->" not in gone:
            end = page.find(b"-->", tag + 4)
            if end < 0:
                gone.add(b"-->")
            else:
                at = end + 3
        elif (raw := _RAW.match(page, tag)) and (name := raw[1].lower()) not in gone:
            end = _CLOSE[name].search(page, raw.end())
            if end is None:
                gone.add(name)
            else:
                at = end.end()
        if at == tag:  # an ordinary tag, or no tag
            if 0 <= close <= tag:
                close = page.find(b">", tag)
            if close < 0:  # nothing ends any more, so the rest is text
                break
            again = page.find(b"<", tag + 1)
            if again < 0 or close < again:
                at = close + 1
            else:
                kept.append(b"<")
                at = tag + 1
                continue
        kept.append(b" ")
    text = b"".join([*kept, page[at:]])
    return html.unescape(text.decode(errors="replace")).encode() if b"&" in text else text


def _trigrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of rows laid end to end, and the row of each. A-Z count as a-z."""
    b = C.folded(data).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    x = ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:-2] == row[2:]
    return x[inside].astype(np.int64), row[:-2][inside]


def _stretches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows a to b, offsets and bytes, of about a stretch each."""
    offsets, data = C.buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + C.STRETCH_BYTES)) - 1)
        yield a, b, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        a = b


class Model:
    """Languages in order of their codes, and log probabilities of trigram buckets, in blocks of languages."""

    def __init__(self, languages: list[str], blocks: list[np.ndarray]):
        self.languages, self.blocks = languages, blocks


def train(texts: DataFrame) -> Model:
    """From rows (text, lang); rows without a language don't count, and without any the model has no languages. The
    different codes come to the driver, and BUCKETS sums for each; a code takes 128 KB there and in a task's block."""
    known = texts.where("lang is not null and text is not null")
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    blocks = []
    for first in range(0, len(languages), LANGUAGE_BLOCK):
        own = languages[first : first + LANGUAGE_BLOCK]
        cells = len(own) * BUCKETS

        def count(batches: Iterator[pa.RecordBatch], cells: int = cells) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cells, np.int64)
            for batch in batches:
                code = batch.column(0).to_numpy()
                for a, b, offsets, data in _stretches(batch.column(1)):
                    f, row = _trigrams(offsets, data)
                    total += np.bincount(code[a:b][row] * BUCKETS + f, minlength=cells)
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], ["f", "n"])

        codes = F.broadcast(texts.sparkSession.createDataFrame(list(zip(own, range(len(own)))), "lang string, code long"))  # LANGUAGE_BLOCK rows
        coded = known.join(codes, "lang").select("code", F.col("text").cast("binary").alias("text"))
        sums = coded.mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
        counts = np.full(cells, SMOOTHING)
        counts[sums.column("f").to_numpy()] += sums.column("n").to_numpy()
        counts = counts.reshape(len(own), BUCKETS)
        blocks.append(np.log(counts / counts.sum(1, keepdims=True)))
    return Model(languages, blocks)


def _with_block(rows: DataFrame, logs: np.ndarray, markup: bool, more: bool) -> DataFrame:
    """rows ends with ll, the evidence of the blocks before, and the text; logs' languages are appended to ll. The text
    stays if more blocks follow."""
    logs = (logs / TRIGRAMS_PER_EVIDENCE).T.copy()
    width = logs.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            column = batch.column(last)
            if markup:
                column = pa.array([markup_text(x or b"") for x in column.to_pylist()], pa.binary())
            for a, b, offsets, data in _stretches(column):
                f, row = _trigrams(offsets, data)
                ll = np.stack([np.bincount(row, logs[f, j], minlength=b - a) for j in range(width)], axis=1).astype(np.float64)
                before = batch.column(last - 1).slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                ll = np.concatenate([before, ll], axis=1)
                new = C.list_column(ll.ravel(), np.full(b - a, ll.shape[1]), pa.float64())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: last - 1]), new, *([column.slice(a, b - a)] if more else [])], batch.schema.names[: last + more])

    kept = rows.schema[: len(rows.schema) - (not more)]
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept))


def text_evidence(rows: DataFrame, model: Model, markup: bool, scratch: C.Scratch) -> DataFrame:
    """rows' columns but the last one, the text; and ll: the text's log likelihood under each language, over
    TRIGRAMS_PER_EVIDENCE. markup: whether the text is a page."""
    *rest, text = rows.columns
    rows = rows.select(*rest, F.array().cast("array<double>").alias("ll"), text)
    for i, logs in enumerate(model.blocks):
        more = i + 1 < len(model.blocks)
        rows = _with_block(rows, logs, markup and not i, more)
        if more:
            rows = scratch.save(rows, f"evidence-{'pages' if markup else 'texts'}-{i}")
    return rows


def _best(array: str) -> Column:
    """Place of the largest entry; of equal ones the first."""
    return F.expr(f"cast(array_position({array}, array_max({array})) - 1 as int)")


def _counts(rows: DataFrame, by: str, width: int, name: str) -> DataFrame:
    """by, and in name how many rows of each value have each language by their text alone."""
    each = rows.where(F.col(by).isNotNull() & F.col("guess").isNotNull()).groupBy(by, "guess").agg(F.count("*").cast("double").alias("n"))
    found = each.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("m"))  # an entry a language
    return found.select(by, F.expr(f"transform(sequence(0, {width - 1}), i -> coalesce(try_element_at(m, i), 0D))").alias(name))


def _leaning(counts: str, above: str) -> str:
    """SQL for the shares of counts without the row's own guess, leaning on the shares above with PRIOR_STRENGTH."""
    own = f"transform({counts}, (x, i) -> x - if(i = guess, 1D, 0D))"
    shares = f"transform(zip_with({own}, {above}, (x, p) -> x + {PRIOR_STRENGTH} * p), x -> x / (aggregate({counts}, 0D, (s, y) -> s + y) - if(guess is null, 0D, 1D) + {PRIOR_STRENGTH}))"
    return f"if({counts} is null, {above}, {shares})"


def fuse(rows: DataFrame, model: Model, scratch: C.Scratch) -> DataFrame:
    """rows (host, domain, suffix, declared, ll and others) with lang, probability and text_lang.

    Evidence that is null adds nothing; a text without trigrams has no text_lang and is judged by the rest. Of equally
    probable languages the first by code is taken; of no languages none (null). A host's texts count whatever domains
    they are given with. Hosts may be as skewed as they like: their counts are summed before the shuffle, and joined by
    a broadcast of checked size or else a join that Spark can split.
    """
    width = len(model.languages)
    if not width:
        none = F.lit(None).cast("string")
        return rows.withColumns({"lang": none, "probability": F.lit(None).cast("double"), "text_lang": none})
    rows = scratch.save(rows.withColumn("guess", F.when(F.array_max("ll") < 0, _best("ll"))), "evidence")
    total = {r.guess: float(r.n) for r in rows.groupBy("guess").agg(F.count("*").alias("n")).collect()}  # a row a language
    world = F.array(*(F.lit(total.get(i, 0.0)) for i in range(width)))
    out = rows.withColumn("world", world)
    for by in ("declared", "suffix", "domain", "host"):
        counts = scratch.save(_counts(rows, by, width, f"{by}_counts"), f"{by}-counts")
        out = out.join(scratch.small(counts, f"{by}-counts"), by, "left")
    # add-one shares of all texts; the share of each language among texts with a declaration or suffix counts as its ratio
    # to the former: P(value | language) to P(value)
    out = out.withColumn("base", F.expr(f"transform(world, (x, i) -> (x - if(i = guess, 1D, 0D) + 1) / (aggregate(world, 0D, (s, y) -> s + y) - if(guess is null, 0D, 1D) + {width}))"))
    out = out.withColumn("domain_share", F.expr(_leaning("domain_counts", "base"))).withColumn("share", F.expr(_leaning("host_counts", "domain_share")))
    out = out.withColumns({f"{by}_share": F.expr(_leaning(f"{by}_counts", "base")) for by in ("declared", "suffix")})
    score = "transform(arrays_zip(ll, share, declared_share, suffix_share, base), x -> x.ll + ln(x.share) + ln(x.declared_share / x.base) + ln(x.suffix_share / x.base))"
    out = out.withColumn("score", F.expr(score))
    codes = F.array(*map(F.lit, model.languages))
    top = F.expr("1D / aggregate(score, 0D, (s, x) -> s + exp(x - array_max(score)))")
    return out.withColumns({"lang": F.get(codes, _best("score")), "probability": top, "text_lang": F.get(codes, F.col("guess"))})


def address_parts(url: Column) -> dict[str, Column]:
    """host, domain (its last two labels) and suffix (the last) of an address; null where there is no host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return {"host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]+)\.?$", 1), "suffix": F.regexp_extract(host, r"([^.]+)\.?$", 1)}


def declared_language(page: Column) -> Column:
    """Primary part of the lang attribute of the html element, lower-case; null if there is none."""
    code = F.lower(F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    return F.when(code != "", code)


def identify(documents: DataFrame, pages: DataFrame, scratch: C.Scratch) -> DataFrame:
    """doc_id, page_id, lang, probability, text_lang, declared: a row for each document (page_id null) and each page
    (doc_id null). The model is trained on all documents with a language; without any, lang and probability are null. A
    document's source is its host. Null texts are empty. Extra columns are ignored."""
    model = train(documents.select("text", "lang"))
    none = F.lit(None).cast("string")
    docs = documents.select("doc_id", F.lit(None).cast("long").alias("page_id"), F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"), none.alias("declared"), F.col("text").cast("binary").alias("text"))
    parts = address_parts(F.col("url"))
    web = pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", *(c.alias(k) for k, c in parts.items()), declared_language(F.col("html")).alias("declared"), F.col("html").cast("binary").alias("text"))
    rows = text_evidence(docs, model, False, scratch).unionByName(text_evidence(web, model, True, scratch))
    return fuse(rows, model, scratch).select("doc_id", "page_id", "lang", "probability", "text_lang", "declared")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "pages"), C.Scratch(spark, "langid"))
