"""Quotes held against the pages and transcripts they are said to come from, and looked for in all of them.

A text is cut into pieces of which a quote must lie inside one: blocks of a page, or up to WINDOW segments of a transcript that
follow each other. To find quotes in all pieces, each piece and quote gets the fingerprints that winnowing selects: the least
hash of GRAM characters in each stretch of QUOTE_LENGTH characters. A quote that a piece holds shares its selected
fingerprints, so a join on the rarest one of each quote gives candidates, and only these are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from ..functions import text as T

#: Segments of a transcript that one quote may span.
WINDOW = 3
GRAM = 12
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def page_pieces(pages: DataFrame, *key: str) -> DataFrame:
    """key, piece (its number), text: the blocks of pages (text)."""
    return pages.select(*key, F.posexplode(T.text_blocks("text")).alias("piece", "text"))


def transcript_segments(documents: DataFrame, *key: str) -> DataFrame:
    """key, segment, stamp, text of the lines "[mm:ss] text"; other lines carry no words."""
    lines = documents.select(*key, F.posexplode(F.split("text", "\n")).alias("segment", "line"))
    part = lambda i: F.regexp_extract("line", r"^\[(\d{2,3}:\d{2})\] ?([^\r\n]*)", i)
    rows = lines.select(*key, "segment", part(1).alias("stamp"), part(2).alias("text")).where("stamp <> ''")
    number = F.row_number().over(Window.partitionBy(*key).orderBy("segment")) - 1
    return rows.withColumn("segment", number)


def transcript_pieces(documents: DataFrame, *key: str) -> DataFrame:
    """key, piece (struct of size and first segment, so that the smallest and earliest window is the least), stamp (of the
    first segment), text: windows of 1 to WINDOW segments joined by a space."""
    segments = transcript_segments(documents, *key)
    w = Window.partitionBy(*key).orderBy("segment")
    windows = [F.when(F.lead("text", n - 1).over(w).isNotNull(), F.struct(F.lit(n).alias("size"), F.concat_ws(" ", "text", *(F.lead("text", i).over(w) for i in range(1, n))).alias("text"))) for n in range(1, WINDOW + 1)]
    rows = segments.select(*key, "segment", "stamp", F.array(*windows).alias("w"))
    rows = rows.select(*key, "segment", "stamp", F.explode(F.array_compact("w")).alias("w"))
    return rows.select(*key, F.struct("w.size", "segment").alias("piece"), "stamp", T.plain_text("w.text").alias("text"))


def _verdict(quote: str, there: Column, within: Column, whole: Column) -> Column:
    return (
        F.when(F.char_length(quote) < T.QUOTE_LENGTH, "quote_too_short").when(~there, "not_fetched").when(within, "found").when(whole, "quote_spans_blocks").otherwise("quote_not_found")
    )


def cited(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quote_id, verdict of quotes (quote_id, url, quote) against the pages (url, text) that were fetched: quote_too_short,
    not_fetched, found, quote_spans_blocks (in the page, but in no block) or quote_not_found. An address may have been
    fetched several times; one page that holds the quote in a block is enough."""
    given = quotes.select("quote_id", T.normalized_url("url").alias("_url"), T.plain_text("quote").alias("quote"))
    fetched = pages.where("text is not null").select(T.normalized_url("url").alias("_url"), T.text_blocks("text").alias("blocks"), T.plain_text("text").alias("whole"))
    both = given.join(fetched.hint("merge"), "_url", "left").select(  # pages are long; their estimate isn't
        "quote_id", "quote", F.col("whole").isNotNull().alias("there"), F.coalesce(F.exists("blocks", lambda b: F.contains(b, F.col("quote"))), F.lit(False)).alias("within"), F.coalesce(F.contains("whole", "quote"), F.lit(False)).alias("in_whole")
    )
    found = both.groupBy("quote_id").agg(F.first("quote").alias("quote"), F.bool_or("there").alias("there"), F.bool_or("within").alias("within"), F.bool_or("in_whole").alias("in_whole"))
    return found.select("quote_id", _verdict("quote", F.col("there"), F.col("within"), F.col("in_whole")).alias("verdict"))


@pandas_udf(ArrayType(LongType()))
def fingerprints(text: pd.Series) -> pd.Series:
    """Selected hashes of a normalized text of QUOTE_LENGTH characters or more; none of a shorter one. What is selected in a
    stretch depends on that stretch alone."""
    span = T.QUOTE_LENGTH - GRAM + 1

    def one(t: str | None) -> np.ndarray:
        if t is None or len(t) < T.QUOTE_LENGTH:
            return np.empty(0, np.int64)
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = np.zeros(len(c) - GRAM + 1, np.uint64)
        for i in range(GRAM):
            h = h * _FACTOR + c[i : i + len(h)]
        h = (h ^ (h >> np.uint64(29))) * _FACTOR
        h ^= h >> np.uint64(32)
        return np.unique(np.lib.stride_tricks.sliding_window_view(h, span).min(1)).view(np.int64)

    return text.map(one, na_action=None)


def found_in(quotes: DataFrame, pieces: DataFrame, *key: str) -> DataFrame:
    """quote_id, key, piece and further columns of every piece (key, piece, text) that holds a quote (quote_id, quote; plain
    text). Shorter quotes than QUOTE_LENGTH prove nothing and have no rows."""
    plain = quotes.select("quote_id", T.plain_text("quote").alias("quote")).where(F.char_length("quote") >= T.QUOTE_LENGTH)
    index = pieces.select(*key, "piece", F.explode(fingerprints("text")).alias("f"))
    wanted = plain.select("quote_id", F.explode(fingerprints("quote")).alias("f"))
    often = index.join(wanted.select("f").distinct(), "f", "left_semi").groupBy("f").agg(F.count("*").alias("n"))
    # a fingerprint that no piece has can't be met
    rarest = wanted.join(often, "f", "left").groupBy("quote_id").agg(F.min_by(F.struct("f", "n"), F.struct(F.coalesce("n", F.lit(0)), "f")).alias("r"))
    rarest = rarest.where("r.n is not null").select("quote_id", F.col("r.f").alias("f"))
    candidates = index.join(rarest, "f").select("quote_id", *key, "piece").distinct()
    return candidates.join(pieces, [*key, "piece"]).join(plain, "quote_id").where(F.contains("text", "quote")).drop("text", "quote")


def cited_transcripts(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """quote_id, verdict, locator of quotes (quote_id, doc_id, quote) against transcripts (doc_id, text): as cited(), a quote
    lying inside WINDOW segments at most; locator is the stamp of the first segment of the smallest such window, the
    earliest of them. Stamps are no words."""
    given = quotes.select("quote_id", "doc_id", T.plain_text("quote").alias("quote"))
    found = given.join(transcript_pieces(documents.join(given.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id"), "doc_id").where(F.contains("text", "quote"))
    best = found.groupBy("quote_id").agg(F.min_by("stamp", "piece").alias("locator"))
    segments = transcript_segments(documents, "doc_id").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda s: s["text"]), " ").alias("whole"))  # a document's
    whole = documents.select("doc_id").distinct().join(segments, "doc_id", "left").select("doc_id", F.lit(True).alias("there"), T.plain_text(F.coalesce("whole", F.lit(""))).alias("whole"))
    rows = given.join(whole, "doc_id", "left").join(best, "quote_id", "left")
    verdict = _verdict("quote", F.coalesce("there", F.lit(False)), F.col("locator").isNotNull(), F.coalesce(F.contains("whole", "quote"), F.lit(False)))
    return rows.select("quote_id", verdict.alias("verdict"), F.when(verdict == "found", F.col("locator")).alias("locator"))
