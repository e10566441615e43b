"""The text operators against plain versions, and their edge cases."""

import base64
import bisect
import collections
import hashlib
import json
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import Window
from pyspark.sql import functions as F

from compare import matches
from quillspark.llm import bpe, common, decontam, jaccard, langid, licenses, quality, queries, sharding, substrings, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\t", "one", "one two three four", "a\x1cb\x85c d", "é ß 漢字 😀", "A B C D E F", "x" * 300_000, "w " * 60_000]


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def scratch(spark):
    return common.Scratch(spark, "test")


def odd_table(spark):
    """Odd texts, repeated rows, a null id, and further columns whose names operators use within."""
    docs = documents(spark, ODD + ["copy of a text"] * 3)
    docs = docs.union(docs.where("doc_id = 4")).union(spark.createDataFrame([(None, "no id", None, None, None)], DOCS))
    return docs.withColumns({c: F.lit("x") for c in ("id", "n", "a", "b", "g", "rest", "whole", "starts", "sig", "key", "label", "kept", "ids", "c0", "part", "node")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    bag = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(words)]
    return [rng.choice(bag) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    matches(spark, queries.QUERIES[name], queries.ORACLES[name])


# ---- word hashing ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("stretch", [1 << 21, 40])
def test_hashed(monkeypatch, stretch):
    monkeypatch.setattr(common, "STRETCH_BYTES", stretch)
    rng = random.Random(2)
    kinds = ((common.SPACES, rb"[^\x20\x09-\x0D]+"), (common.MARKS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (common.PIECES, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[^\x20\x09-\x0D0-9A-Za-z\x80-\xff]+"))
    for _ in range(60):
        rows = [None if rng.random() < 0.1 else "".join(rng.choice(["a", "B", " ", "\n", "!", "é", "9", "##"]) for _ in range(rng.randint(0, 60))).encode() for _ in range(rng.randint(1, 12))]
        for classes, pattern in kinds:
            want = [re.findall(pattern, (r or b"").lower()) for r in rows]
            seen = {}
            for a, b, h, sizes in common.hashed(pa.array([b"skip", *rows], pa.binary()).slice(1), True, classes):
                assert sizes.tolist() == [len(x) for x in want[a:b]]
                for word, x in zip([w for r in want[a:b] for w in r], h):
                    assert seen.setdefault(word, x) == x
            assert len(set(seen.values())) == len(seen)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 99)]
    got = {r.id: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long"), scratch(spark), "c").collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99, 101: 99}


# ---- 1: quality ------------------------------------------------------------------------------------------------------


def test_resampling_separates(spark):
    rng = random.Random(1)
    good = [" ".join(prose(1, 60)[i % 7 :]) for i in range(40)]
    bad = [" ".join(w + rng.choice(["***", "$$$"]) for w in prose(1, 60)) for _ in range(20)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(40 + i, 0, 0) for i in range(10)] + [(40, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id for r in quality.resample(docs, labels, scratch(spark)).collect()}
    assert got == set(range(40))
    assert {r.doc_id for r in quality.keep_good(docs, labels, scratch(spark)).collect()} == got
    assert quality.resample(docs, labels, scratch(spark), k=7).count() == 7
    assert quality.resample(docs, labels, scratch(spark), k=0).count() == 0


def test_resampling_held_out(spark):
    """Labels of every second document; the others tell how well the rest is told apart."""
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    kept = {r.doc_id for r in quality.resample(docs, labels.where("doc_id % 2 = 0"), scratch(spark)).collect()}
    rest = labels.where("doc_id % 2 = 1 and toxic = 0").collect()
    good, bad = [r.doc_id in kept for r in rest if r.quality], [r.doc_id in kept for r in rest if not r.quality]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.15


def test_resampling_held_out_toxic(spark):
    """As before, for documents of quality 1 that are toxic by an insult here and there."""
    docs, labels = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    kept = {r.doc_id for r in quality.resample(docs, labels.where("doc_id % 2 = 0"), scratch(spark)).collect()}
    rest = labels.where("doc_id % 2 = 1").join(docs, "doc_id").collect()
    insults = set("trash pathetic idiot disgusting worthless clown loser scum stupid moron".split())
    toxic = [r.doc_id in kept for r in rest if r.toxic and len(insults & set(re.findall("[a-z]+", r.text.lower()))) >= 3]
    assert len(toxic) >= 100 and np.mean(toxic) <= 0.1
    assert np.mean([r.doc_id in kept for r in rest if r.quality and r.toxic]) <= 0.45
    assert np.mean([r.doc_id in kept for r in rest if r.quality and not r.toxic]) >= 0.985
    assert np.mean([r.doc_id in kept for r in rest if not r.quality]) <= 0.1


def test_keep_good_tells_texts_apart(spark):
    """Rows that share a doc_id, or have none, stay or go each by their own text."""
    good, bad = " ".join(prose(1, 60)), [" ".join(f"{w}***{i}" for w in prose(1, 60)) for i in range(5)]
    docs = documents(spark, [good] * 20, first=100)
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    for own in (7, None):
        same = spark.createDataFrame([(own, t, "en", "s", 1) for t in [good, *bad]], DOCS)
        kept = quality.keep_good(docs.union(same), labels, scratch(spark)).where(F.col("doc_id").eqNullSafe(F.lit(own).cast("long"))).collect()
        assert [r.text for r in kept] == [good]


def test_resampling_odd(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(odd_table(spark), labels, scratch(spark)).count() == odd_table(spark).count()
    assert quality.keep_good(odd_table(spark), labels, scratch(spark)).columns == odd_table(spark).columns
    assert quality.resample(empty(spark), labels, scratch(spark)).count() == 0


def plain_weights(docs, good):
    """Of (doc_id, text) rows: weights and the target's weights without their own counts, counted in plain loops."""
    def features(text):
        words = [h for _, _, h, _ in common.hashed(pa.array([(text or "").encode()], pa.binary()), classes=common.PIECES)][0]
        out = [[int(common.mix(words[i : i + 1])[0]) % quality.WORDS] for i in range(len(words))]
        for i in range(1, len(words)):
            out[i].append(quality.WORDS + int(common.shingle_hashes(words[i - 1 : i + 1], 2)[0]) % quality.PAIRS)
        return out

    each = [(d, features(t)) for d, t in docs]
    raw, target = collections.Counter(), collections.Counter()
    for d, fs in each:
        raw.update(f for x in fs for f in x)
        target.update(f for x in fs for f in x if d in good)
    share = [sum(n for f, n in target.items() if (f < quality.WORDS) == word) / max(1, sum(n for f, n in raw.items() if (f < quality.WORDS) == word)) for word in (False, True)]

    def weight(fs, own):
        def ratio(f):
            smooth = quality.WORD_SMOOTHING if f < quality.WORDS else quality.PAIR_SMOOTHING
            return np.log((target[f] - own[f] + smooth) / (raw[f] * share[f < quality.WORDS] + smooth))
        each = [sum(map(ratio, x)) for x in fs]
        return min((sum(each[i : i + quality.WINDOW]) for i in range(max(1, len(each) - quality.WINDOW + 1))), default=0.0)

    none = collections.Counter()
    return [(d, weight(fs, none), weight(fs, collections.Counter(f for x in fs for f in x)) if d in good else None, sum(map(len, fs))) for d, fs in each]


def plain_sample(spark, docs, good, seed=0):
    """doc_ids that stay."""
    rows = plain_weights(docs, good)
    unseen = sorted(u for _, _, u, _ in rows if u is not None)
    least = unseen[max(0, -(-len(unseen) * int(quality.TARGET_QUANTILE * 1000) // 1000) - 1)] if unseen else -np.inf
    k = sum(w >= least for _, w, _, _ in rows)
    table = spark.createDataFrame([(d, float(w), n) for d, w, _, n in rows], "doc_id long, log_weight double, n_features long")
    noise = [r.x for r in table.select(quality.gumbel(F.lit(seed), "doc_id", "n_features").alias("x")).collect()]
    return {d for _, d in sorted(((w / quality.TEMPERATURE + x, d) for (d, w, _, _), x in zip(rows, noise)), reverse=True)[:k]}


def test_resampling_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for seed in (0, 1):
        got = {r.doc_id: r.log_weight for r in quality.resample(docs, labels, scratch(spark), seed=seed).collect()}
        assert set(got) == plain_sample(spark, rows, good, seed)
    assert all(abs(got[d] - w) < 1e-6 for d, w, _, _ in plain_weights(rows, good) if d in got)


def test_resampling_frequencies(spark):
    """How often each document is among k draws without replacement, over many seeds, against the exact probabilities."""
    weight, n, k = [0.0, 0.5, 1.0, 2.0, 3.0, -1.0], 6000, 2
    rows = spark.createDataFrame([(i, 9, w) for i, w in enumerate(weight)], "doc_id long, n_features long, log_weight double")
    keyed = rows.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("key", quality.sampling_key(1.0, F.col("seed")))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("key")))
    got = {r.doc_id: r["count"] / n for r in keyed.withColumn("place", place).where(F.col("place") <= k).groupBy("doc_id").count().collect()}
    p = np.exp(weight) / np.exp(weight).sum()
    for i in range(6):
        exact = p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(6) if j != i)
        assert abs(got.get(i, 0) - exact) < 0.02


def test_kth_highest(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [0.5] * 200
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 900, 1100, 3200):
        assert quality.kth_highest(keys, k) == order[k - 1]
    assert quality.kth_highest(keys, 3201) is None


# ---- 2: BPE ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path(bpe.RANKS_FILE)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding(library):
    v = bpe.Vocabulary(public_tokenizers.path(bpe.RANKS_FILE))
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "The", "é", "ß", "9", "12", "'s", "'ll", "!", "?", "\x1c", "\x85", "漢字", "😀", "​", "__", "Ⅷ", "²", "don't", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 50_000, "".join(rng.choice("abcXYZ") for _ in range(50_000)), " " * 3000, "é" * 2000]
    for t in texts:
        ids = np.frombuffer(v.encode(t), np.int32)
        assert ids.tolist() == library.encode_ordinary(t)
        assert v.decode(ids) == t.encode()
    assert not any(v.words)  # the bitmap is left empty


def test_bpe_query(spark, library):
    def want(t):
        ids = library.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_table(spark)):
        expected = sorted((str(r.doc_id), *want(r.text)) for r in docs.collect())
        assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in bpe.digests(docs).collect()) == expected
    assert bpe.digests(empty(spark)).count() == 0
    small = documents(spark, ODD)
    apart = {r.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.decode(bpe.encode(small, "doc_id")).collect()}
    assert apart == {r.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.encode(small, "doc_id", decoded=True).collect()}
    assert apart == {i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(ODD)}


# ---- 3: licences -----------------------------------------------------------------------------------------------------


def plain_scan(text):
    w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]
    hits = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def plain_tags(text):
    """Expressions by words and lines: behind each tag up to the line's end or the next tag."""
    text = (text or "").encode().lower()
    words = [(m[0], m.start(), m.end()) for m in re.finditer(rb"[0-9a-z\x80-\xff]+", text)]
    at = [i for i in range(len(words) - 2) if [w for w, _, _ in words[i : i + 3]] == [b"spdx", b"license", b"identifier"]]
    out = []
    for k, i in enumerate(at):
        end = words[at[k + 1]][1] if k + 1 < len(at) else len(text)
        rest = text[words[i + 2][2] : end].lstrip(b" \t").removeprefix(b":").lstrip(b" \t")
        out.append(re.split(rb"[\r\n]", rest)[0].decode(errors="replace").strip())
    return out


def plain_names(expression):
    """Identifiers of an expression without parentheses or exceptions."""
    names = []
    for x in re.split(r" and | or |(?<=[0-9a-z])/(?=[0-9a-z])", expression):
        m = re.match(r"\s*([0-9a-z.+-]+)", x)
        names.append(m[1].strip(".").removesuffix("-only").removesuffix("-or-later").rstrip("+"))
        if x.strip() != m[0].strip():
            break
    return names


def test_license_tags(spark):
    """All tags of a line, old slashes, labels and score against plain versions."""
    rng = random.Random(12)
    names, filler = ["MIT", "Apache-2.0", "GPL-2.0-only", "BSD-3-Clause", "foo"], ["all rights reserved", "// x", "\n", "see the MIT License", "no", "/* */", "\t"]
    texts = ["SPDX-License-Identifier: MIT  // SPDX-License-Identifier: GPL-2.0", "xspdx-license-identifier: MIT", "SPDX License Identifier MIT/Apache-2.0\nmore", "spdx-license-identifier:"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.6:
                parts.append("SPDX-License-Identifier: " + rng.choice([" AND ", " OR ", "/"]).join(rng.sample(names, rng.randint(1, 3))))
            parts.append(rng.choice(filler))
        texts.append(" ".join(parts))
    got = {r.doc_id: r for r in licenses.scan(documents(spark, texts)).collect()}
    phrases = licenses.BASE_PHRASES | licenses.NOTICE_PHRASES
    for i, text in enumerate(texts):
        tags = [t for t in plain_tags(text) if re.match(r"[0-9a-z.+-]", t)]
        assert got[i].expressions == tags, text
        words = [w.decode() for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())]
        labels = {v for p, v in phrases.items() if any(words[k : k + len(p.split())] == p.split() for k in range(len(words)))}
        assert got[i].labels == ",".join(sorted(labels.union(*map(plain_names, tags)))), text
    assert got[0].expressions == ["mit  //", "gpl-2.0"] and got[0].labels == "gpl-2.0,mit" and got[1].expressions == [] and got[2].labels == "apache-2.0,mit"
    assert got[0].score == 0.4 and got[2].score == 0.9


def test_license_scan(spark):
    texts = ["CC-BY cc by CC--BY-NC", "gnu lesser general public license é cc by", "by cc by", "cc", "SPDX-License-Identifier: MIT OR (GPL-2.0-only AND BSD-3-Clause)\nAll rights reserved, all"]
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_table(spark), documents(spark, texts)):
        expected = sorted((str(r.doc_id), *map(str, plain_scan(r.text))) for r in docs.collect())
        got = licenses.scan(docs).collect()
        assert sorted((str(r.doc_id), *map(str, tuple(r)[1:6])) for r in got) == expected
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(documents(spark, texts)).where("doc_id = 4").first().labels == "bsd-3-clause,gpl-2.0,mit,reserved"
    assert licenses.scan(empty(spark)).count() == 0
    more = ["gnu lesser general public license", "lesser general public license; general public license", "SPDX-License-Identifier: MIT\nx\nSPDX-License-Identifier: ISC AND (", "apache license mozilla public license"]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, more)).collect()}
    assert [got[i].score for i in range(4)] == [0.5, 0.4, 0.9, 0.6] and got[0].labels == "gpl,lgpl"
    assert got[2].expressions == ["mit", "isc and ("] and got[2].labels == "isc,mit" and got[3].expressions == []


def test_expressions():
    parse = licenses.parse_expression
    assert parse("MIT OR GPL-3.0-only") == (["mit", "gpl-3.0"], 0.9)
    assert parse("(MIT AND GPL-2.0) or Apache-2.0")[1] == 0.9
    assert parse("MIT AND GPL-2.0 or Apache-2.0 and GPL-2.0")[1] == 0.4
    assert parse("GPL-2.0-or-later WITH Classpath-exception-2.0 AND MIT") == (["gpl-2.0 with classpath-exception-2.0", "mit"], 0.5)
    assert parse("(MIT OR GPL-2.0) WITH X")[0] == ["mit with x", "gpl-2.0 with x"]
    assert parse("GPL-2.0 WITH (A OR B)")[0] == ["gpl-2.0 with a", "gpl-2.0 with b"]
    assert parse("") is parse("and") is parse(")") is None
    assert parse("mit and") == parse("(mit") == parse("mit) or x") == (["mit"], 0.9)


# ---- 4: decontamination ----------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def bag_of(w):
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def plain_contamination(docs, items):
    out = {}
    for d, text in docs.items():
        w = words_of(text)
        for i, item in items.items():
            b, n = bag_of(words_of(item)), len(words_of(item))
            for k in range(len(w) - n + 1) if n else ():
                x = bag_of(w[k : k + n])
                union = sum((x | b).values())
                if sum((x & b).values()) >= 0.8 * union:
                    out[d, i] = max(out.get((d, i), 0), sum((x & b).values()) / union)
    return out


def test_contamination(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(8).collect()} | {100: "one two", 101: "", 102: None}
    rng = random.Random(3)
    docs = {}
    for text in list(items.values())[:8]:
        for edits in (0, 0, 1, 2, 3):
            w = text.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = "other"
            docs[len(docs)] = "pre " * rng.randint(0, 9) + " ".join(w).upper() + " post" * rng.randint(0, 5)
    docs[len(docs)] = "One, TWO three"
    docs[len(docs)] = " ".join(prose(4, 300))
    table = documents(spark, list(docs.values()))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (decontam.ITEM_BYTES, 600):
        rows = decontam.contaminated(table, bench, item_bytes=block).collect()
        got = {(r.doc_id, r.item_id): r.similarity for r in rows}
        wanted = plain_contamination(docs, items)
        assert set(wanted) <= set(got) and all(got[k] >= wanted[k] - 1e-12 for k in wanted)
        assert len(rows) == len(got) and not any(d == len(docs) - 1 for d, _ in got)
    found = {d for d, _ in got}
    assert {r.doc_id for r in decontam.keep_clean(table, bench, scratch(spark)).collect()} == set(docs) - found


def test_contamination_odd(spark):
    bench = spark.createDataFrame([(1, "one"), (None, "one"), (2, "copy of a text")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(odd_table(spark), bench).collect()}
    assert got == {(4, 1), (5, 1), (11, 2), (12, 2), (13, 2)} - {(5, 1)} | ({(5, 1)} & got)
    assert decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(odd_table(spark), bench.limit(0)).count() == 0
    assert decontam.keep_clean(odd_table(spark), bench, scratch(spark)).columns == odd_table(spark).columns


def test_keep_clean_tells_texts_apart(spark):
    item = " ".join(prose(3, 40))
    docs = documents(spark, ["before " + item, " ".join(prose(4, 60)), " ".join(prose(5, 60)) + " " + item])
    docs = docs.withColumn("doc_id", F.expr("if(doc_id = 2, null, 0L)")).withColumn("a.b", F.lit(1))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontam.keep_clean(docs, items, scratch(spark))
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == [" ".join(prose(4, 60))]


def test_hamming_blocks():
    """All fingerprints within the radius are found, and none beyond it."""
    rng = np.random.default_rng(1)
    texts = [" ".join(prose(i, 30)).encode() for i in range(60)]
    index = decontam.Index(list(range(60)), texts)
    prints = index.prints[rng.integers(60, size=80)]
    for f in prints:
        for b in rng.integers(0, 128, rng.integers(0, 45)):
            f[b // 64] ^= np.uint64(1 << int(b % 64))
    window, item = index.within(prints, np.full(80, 26))
    far = np.bitwise_count(prints[:, None] ^ index.prints[None]).sum(2)
    assert sorted(zip(window.tolist(), item.tolist())) == [tuple(x) for x in np.argwhere(far <= decontam.RADIUS).tolist()]
    assert 0 < len(window) < far.size


def test_hamming_blocks_of_many_items():
    """With 20,000 items of 20 to 120 words few are candidates, and those that are alike are within the radius."""
    rng = random.Random(2)
    bag = prose(5, 3000, words=3000)
    items = [" ".join(rng.choices(bag, k=rng.randint(20, 120))) for _ in range(20_000)]
    index = decontam.Index(list(range(len(items))), [x.encode() for x in items])
    alike = found = n = candidates = 0
    for i in range(0, 4000, 10):
        w = items[i].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "other"
        (_, _, h, _), = common.hashed(pa.array([" ".join(w).encode()], pa.binary()), True, common.MARKS)
        shingles = common.shingle_hashes(h)
        prints, sizes = decontam.fingerprint(shingles)[None], np.array([len(shingles)])
        n, candidates = n + 1, candidates + len(index.candidates(prints, sizes)[0])
        if decontam.weighted_jaccard(decontam._bag(shingles), index.bags[i]) >= 0.8:
            alike, found = alike + 1, found + (i in index.within(prints, sizes)[1])
    assert alike > 100 and found >= 0.98 * alike
    assert candidates <= 0.05 * n * len(items)


def test_stock_phrase(spark):
    """A phrase that many items share doesn't hide the one that a document holds, nor make others match."""
    phrase = "what is the answer to this question about"
    items = [f"{phrase} {' '.join(prose(500 + i, 12))}" for i in range(300)]
    docs = [" ".join(prose(i, 40)) + f" {phrase} " + " ".join(prose(50 + i, 40)) for i in range(20)] + ["x y z " + items[7] + " u v w"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.similarity, r.first_word) for r in decontam.contaminated(documents(spark, docs), bench).collect()]
    assert got == [(20, 7, 1.0, 3)]


# ---- 5: substrings ---------------------------------------------------------------------------------------------------


def plain_repeats(docs, window=50):
    first = {}
    texts = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs.items()}
    for d in sorted(texts):
        for i in range(len(texts[d]) - window + 1):
            first.setdefault(tuple(texts[d][i : i + window]), d)
    out = {}
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_repeats(spark):
    rng = random.Random(7)
    base = prose(7, 900, words=25)  # few words: runs and chance repeats
    periodic = (["ab", "cd"] * 80, ["ab"] * 130, ["ab", "cd", "ef"] * 40)
    texts = [" ".join(base)]
    for _ in range(25):
        a, n = rng.randrange(700), rng.randint(30, 150)
        w = prose(rng.random(), rng.randint(0, 40)) + base[a : a + n] + prose(rng.random(), rng.randint(0, 40))
        texts.append("  ".join(w))
    for w in periodic:
        texts += [" ".join(w), " ".join(prose(rng.random(), 9) + w[:70] + prose(rng.random(), 9))]
    texts += [texts[0], texts[3] + "\n", None, ""]
    docs = dict(enumerate(texts))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(documents(spark, texts), scratch(spark)).collect()}
    assert got == plain_repeats(docs)
    stage = {r.doc_id: (r.text, r.n_chars) for r in substrings.without_repeats(documents(spark, texts), scratch(spark)).collect()}
    for d, (_, removed, kept) in plain_repeats(docs).items():
        assert stage[d] == ((kept, len(kept)) if removed else (texts[d], len(texts[d] or "")))


def test_spelling_is_the_windows_own():
    """Symbol and spelling depend on the window's words alone, wherever it lies; other words are spelt otherwise."""
    rng = random.Random(3)
    word = {w: np.uint64(rng.getrandbits(64)) for w in "abcdefgh"}
    spelt = {}
    for _ in range(400):
        inner = [rng.choice("abcdefgh"[: rng.choice([1, 2, 8])]) for _ in range(50)]
        for _ in range(2):
            left, right = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] for _ in range(2))
            words = left + inner + right
            h = np.array([word[x] for x in ["h", *words]], np.uint64)
            got = list(substrings.windows(h, np.array([1, len(words)]), 50))
            of, pos, *keys = (np.concatenate(x) for x in zip(*got))
            assert of.tolist() == [1] * (len(words) - 49) and pos.tolist() == list(range(len(words) - 49))
            for p, *key in zip(pos.tolist(), *(k.tolist() for k in keys)):
                assert spelt.setdefault(tuple(words[p : p + 50]), key) == key
    assert len({tuple(k[1:]) for k in spelt.values()}) == len(spelt)


@pytest.mark.parametrize("window", [3, 50])
def test_repeats_in_pieces(spark, monkeypatch, window):
    monkeypatch.setattr(substrings, "PIECE_WINDOWS", 7)
    base = prose(8, 160, words=6)
    texts = [" ".join(base), " ".join(base[20:140]), " ".join(prose(9, 70, words=6)), " ".join(["la"] * 90), " ".join(["la"] * 60 + base[:70])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(documents(spark, texts), scratch(spark), window).collect()}
    assert got == plain_repeats(dict(enumerate(texts)), window)


def test_repeats_of_an_id(spark):
    """A row loses words by its own windows only, whatever other rows have its doc_id."""
    a, b = " ".join(prose(1, 60)), " ".join(prose(2, 60))
    rows = [(1, a), (5, a + " z"), (5, b), (5, a), (7, b + " y"), (7, b + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, a), (5, "z"), (5, b), (5, ""), (7, "y"), (7, "y")])
    assert sorted((r.doc_id, r.kept_text) for r in substrings.remove_repeats(docs, scratch(spark)).collect()) == want
    assert sorted(map(tuple, substrings.without_repeats(docs, scratch(spark)).collect())) == want


def test_repeats_odd(spark):
    docs = odd_table(spark)
    assert substrings.remove_repeats(docs, scratch(spark)).count() == docs.count()
    out = substrings.without_repeats(docs, scratch(spark))
    assert out.columns == docs.columns and out.count() == docs.count()
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    twice = documents(spark, [" ".join(prose(1, 80))]).union(documents(spark, [" ".join(prose(1, 80))]))
    assert [r.n_removed for r in substrings.remove_repeats(twice, scratch(spark)).collect()] == [0, 0]
    assert substrings.remove_repeats(empty(spark), scratch(spark)).count() == 0


# ---- 6: sharding -----------------------------------------------------------------------------------------------------


def plain_ring(ids, k, nodes):
    cell = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:4], 16) // (65536 // sharding.RING_CELLS)
    points = {}
    for s in range(k):
        for v in range(nodes):
            c = cell(f"shard {s} node {v}")
            points[c] = min(points.get(c, s), s)
    cells = sorted(points)
    bound = [len(ids) // k + (s < len(ids) % k) for s in range(k)]
    order = sorted(ids, key=lambda i: (cell(str(i)) <= cells[-1], cell(str(i)), hashlib.md5(str(i).encode()).hexdigest(), i))
    node = lambda i: bisect.bisect_left(cells, cell(str(i))) % len(cells)
    load, out, over = [0] * k, {}, collections.defaultdict(list)
    for i in order:
        s = points[cells[node(i)]]
        if load[s] < bound[s]:
            out[i] = (s, load[s])
            load[s] += 1
        else:
            over[node(i)].append(i)
    queue = collections.deque()
    for t in range(2 * len(cells)):
        j = t % len(cells)
        if t < len(cells):
            queue.extend(over[j])
        s = points[cells[j]]
        while queue and load[s] < bound[s]:
            out[queue.popleft()] = (s, load[s])
            load[s] += 1
    return out


@pytest.mark.parametrize(("n", "k"), [(0, 3), (1, 8), (5, 8), (1000, 8), (997, 3)])
def test_ring(spark, n, k):
    docs = documents(spark, ["text"] * n) if n else empty(spark)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(docs, k).collect()}
    assert got == plain_ring(list(range(n)), k, sharding.VIRTUAL_NODES)


def test_ring_moves_little(spark):
    docs = documents(spark, ["text"] * 4000)
    one, two = ({r.doc_id: r.shard for r in sharding.shard_rows(docs, k).collect()} for k in (8, 9))
    assert sum(one[i] != two[i] for i in one) < 0.2 * len(one)  # the least is a ninth; a plain modulo would move eight


def test_ring_odd(spark):
    rows = sharding.shard_rows(odd_table(spark)).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in sizes)
    text = {r.doc_id: r.text for r in odd_table(spark).collect()}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r["size"] == len((text[r.doc_id] or "").encode()) + 1 for r in rows)
    hot = spark.createDataFrame([(None, "a")] * 20 + [(7, "b")] * 9, "doc_id long, text string")
    assert len({(r.shard, r.slot) for r in sharding.shard_rows(hot, 4).collect()}) == 29


# ---- 7: language -----------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    pages = spark.read.parquet(f"{SF}/../sf0.01/pages.parquet")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = langid.identify(hidden, pages, scratch(spark))
    both = got.join(docs.where("doc_id % 2 = 1").select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert both.where("lang = truth").count() >= 0.98 * both.count()
    web = got.where("page_id is not null and declared is not null")
    assert web.where("lang = declared").count() >= 0.95 * web.count() and got.count() == docs.count() + pages.count()


def test_language_evidence(spark):
    """With no text to go by, what a page declares and what its host publishes decide."""
    docs = documents(spark, ["the cat and the hat " * 9, "der hund und die katze " * 9]).withColumn("lang", F.expr("if(doc_id = 0, 'en', 'de')"))
    rows = [(i, "http://a.example.de/x", '<html lang="de"><p>der hund und die katze und der hund') for i in range(20)]
    rows += [(i, "http://b.example.com/", '<HTML LANG=en><p>the cat and the hat and the cat') for i in range(20, 45)]
    rows += [(50, "http://a.example.de/y", None), (51, None, '<html lang="de">'), (52, "nonsense", ""), (53, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(docs, pages, scratch(spark)).where("page_id is not null").collect()}
    assert got[50].lang == "de" and got[51].lang == "de" and got[52].lang == got[53].lang == "en"
    assert all(0 < r.probability <= 1 for r in got.values())


def test_markup_text():
    """Against one pattern, on random markup; and pages of nothing but openings take no time."""
    pattern = re.compile(rb"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^<>]*>")
    rng = random.Random(9)
    for _ in range(4000):
        page = "".join(rng.choice(["<", ">", "<!--", "-->", "<script", "</script>", "<STYLE>", "</style >", "</", "x", " ", "\n", "scripts", "--", "!"]) for _ in range(rng.randint(0, 14))).encode()
        assert langid.markup_text(page) == pattern.sub(b" ", page), page
    for unit in (b"<script>x", b"<!-- x", b"<style", b"<", b"<a ", b"<!--<script></style>", b"</script "):
        began = time.time()
        langid.markup_text(unit * (2_000_000 // len(unit)))
        assert time.time() - began < 2, unit


def test_language_odd(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.identify(odd_table(spark), pages, scratch(spark)).count() == odd_table(spark).count()
    assert langid.identify(empty(spark), pages, scratch(spark)).count() == 0
    unknown = langid.identify(odd_table(spark).withColumn("lang", F.lit(None).cast("string")), pages, scratch(spark)).collect()
    assert len(unknown) == odd_table(spark).count() and {(r.lang, r.probability) for r in unknown} == {(None, None)}
    assert langid.markup_text(b"<p>a &amp; b<script>x</script><!-- c -->d").split() == [b"a", b"&", b"b", b"d"]


def plain_languages(docs, pages):
    """(doc_id, page_id): language, probability and the text's own language, all in plain loops."""
    def grams(text):
        b = text if isinstance(text, bytes) else (text or "").encode()
        return langid._trigrams(np.array([0, len(b)]), np.frombuffer(b, np.uint8))[0].tolist()

    names = sorted({d.lang for d in docs if d.lang is not None and d.text is not None})
    counts = {x: collections.Counter() for x in names}
    for d in docs:
        if d.lang in counts:
            counts[d.lang].update(grams(d.text))
    size = {x: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for x, c in counts.items()}
    rows = [((d.doc_id, None), grams(d.text), d.source, None, None, None) for d in docs]
    for p in pages:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", p.url or "")
        host = m[1].lower() if m else None
        found = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", p.html or "")
        rows.append(((None, p.page_id), grams(langid.markup_text((p.html or "").encode())), host, host and ".".join(host.split(".")[-2:]), host and host.split(".")[-1], found and found[1].lower()))
    lls = [[sum(np.log((counts[x][g] + langid.SMOOTHING) / size[x]) for g in gs) / langid.TRIGRAMS_PER_EVIDENCE for x in names] for _, gs, *_ in rows]
    guess = [None if not gs else max(range(len(names)), key=lambda j, ll=ll: ll[j]) for (_, gs, *_), ll in zip(rows, lls)]
    tally = lambda k, value: [sum(g == j and (k is None or r[k] == value) for r, g in zip(rows, guess)) for j in range(len(names))]
    out = {}
    for r, ll, g in zip(rows, lls, guess):
        own = lambda c: [x - (j == g) for j, x in enumerate(c)]
        world = own(tally(None, None))
        base = [(x + 1) / (sum(world) + len(names)) for x in world]

        def lean(k, above):
            c = own(tally(k, r[k])) if r[k] is not None else None
            if c is None or not any(tally(k, r[k])):
                return above
            return [(x + langid.PRIOR_STRENGTH * p) / (sum(c) + langid.PRIOR_STRENGTH) for x, p in zip(c, above)]

        share, suffix, declared = lean(2, lean(3, base)), lean(4, base), lean(5, base)
        score = [a + np.log(s) + np.log(x / b) + np.log(d / b) for a, s, x, d, b in zip(ll, share, suffix, declared, base)]
        best = int(np.argmax(score))
        out[r[0]] = (names[best], 1 / sum(np.exp(s - score[best]) for s in score), None if g is None else names[g])
    return out


def test_language_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0").withColumn("text", F.substring("text", 1, 400))
    docs = docs.union(docs.limit(1).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(9001).cast("long")}).select(docs.columns))
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("html", F.when(F.col("page_id") % 5 != 0, F.substring("html", 1, 700)))
    want = plain_languages(docs.collect(), pages.collect())
    got = {(r.doc_id, r.page_id): (r.lang, r.probability, r.text_lang) for r in langid.identify(docs, pages, scratch(spark)).collect()}
    assert set(got) == set(want)
    for k, (lang, p, own) in want.items():
        assert got[k][2] == own and abs(got[k][1] - p) < 1e-9 and (got[k][0] == lang or abs(p - 0.5) < 1e-6), k


def test_language_blocks(spark, monkeypatch):
    """However many languages there are, and however few a task holds at once."""
    rng = random.Random(6)
    bags = {f"l{i:03}": prose(1000 + i, 40, words=30) for i in range(9)}
    rows = [(len(bags) * j + i, " ".join(rng.choices(bag, k=30)), code, code, 0) for j in range(4) for i, (code, bag) in enumerate(bags.items())]
    docs = spark.createDataFrame(rows, DOCS)
    pages = spark.createDataFrame([(7, "http://l003/", "<p>" + " ".join(bags["l005"]))], "page_id long, url string, html string")
    found = []
    for block in (256, 4):
        monkeypatch.setattr(langid, "LANGUAGE_BLOCK", block)
        got = langid.identify(docs, pages, scratch(spark)).collect()
        assert all(r.lang == rows[r.doc_id][2] for r in got if r.doc_id is not None)
        assert [r.text_lang for r in got if r.page_id] == ["l005"]
        found.append(sorted(map(str, got)))
    assert found[0] == found[1]


def test_language_own_guess(spark):
    """What a text adds to its host's counts doesn't come back to it as evidence."""
    model = langid.Model(["de", "en"], [np.zeros((2, 1))])
    columns = "id long, host string, domain string, suffix string, declared string, ll array<double>"
    alone = spark.createDataFrame([(1, "h", "d", "s", None, [-2.0, -1.0]), (2, None, None, None, None, [-2.0, -1.0]), (3, "x", None, None, None, [-1.0, -2.0])], columns)
    got = {r.id: r.probability for r in langid.fuse(alone, model, scratch(spark)).collect()}
    assert abs(got[1] - got[2]) < 1e-12
    # two counts of one host, given with two domains, are added
    both = spark.createDataFrame([(i, "h", "ab"[i % 2], None, None, [-3.0, -1.0]) for i in range(20)] + [(50, "h", None, None, None, [0.0, 0.0])], columns)
    last = {r.id: r for r in langid.fuse(both, model, scratch(spark)).collect()}[50]
    assert last.lang == "en" and last.text_lang is None and abs(last.probability - (20 + 5 * 21 / 22) / 25) < 1e-12


# ---- 8: WARC ---------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = ["<p>é</p>", "<p>é</p>", None, "", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n", "x" * 200_000, "<p>é</p>"]
    pages = spark.createDataFrame([(10 - i, f"http://h.example/{i}?q=1#f" if i else None, h, "x") for i, h in enumerate(html)], "page_id long, url string, html string, n string")
    s = scratch(spark)
    warc.write_archives(pages, s.path("w"), s)
    records = warc.read_records(spark, s.path("w"))
    assert records.count() == 3 * len(html)
    rows = {r.metadata.page_id: r for r in warc.captures(records).collect()}
    want = {10 - i: (h or "").encode() for i, h in enumerate(html)}
    assert set(rows) == set(want)
    for page, payload in want.items():
        r = rows[page].response
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = min(p for p, x in want.items() if x == payload)
        assert r.kind == ("response" if page == first else "revisit")
        assert r.payload == (payload if page == first else None)
        assert r.refers_to == (None if page == first else rows[first].capture_id)
        assert rows[page].request.record_id and rows[page].metadata.record_id
    with pytest.raises(ValueError):
        list(warc._parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc._parse(b"junk"))


def test_warc_least_bytes(spark):
    pages = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (None, "http://c/", "same"), (3, "http://d/", "longer than that"), (4, "http://e/", "longer than that")], "page_id long, url string, html string")
    s = scratch(spark)
    warc.write_archives(pages, s.path("w"), s, least=10)
    kinds = {(r.metadata.page_id, r.response.kind) for r in warc.captures(warc.read_records(spark, s.path("w"), False)).collect()}
    assert kinds == {(1, "response"), (2, "response"), (None, "response"), (3, "response"), (4, "revisit")}


def test_warc_odd(spark, monkeypatch):
    """Addresses that are none, rows that repeat, pages of all sizes, and no pages."""
    monkeypatch.setattr(warc, "PAGES_PER_FILE", ((10, 3), (1000, 2)))
    urls = ["http://a b/c", "http://[x/", "http://exämple.de/ü|x", "", "-", None, "no address: at all", "http://u:p@h:8/?a#b"]
    rows = [(i, u, "x" * (i * 40)) for i, u in enumerate(urls)]
    rows += [(1, "http://r/", "again")] * 5 + [(0, "http://r/", "again")] * 2 + [(2, "http://q/", "again")] * 2 + [(None, None, None)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    s = scratch(spark)
    warc.write_archives(pages, s.path("w"), s)
    got = warc.captures(warc.read_records(spark, s.path("w"))).collect()
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted([(r.metadata.page_id, r.request.uri) for r in got], key=key) == sorted([(r[0], r[1]) for r in rows], key=key)
    kinds = collections.Counter((r.metadata.page_id, r.response.kind) for r in got if r.response.uri in ("http://r/", "http://q/"))
    assert kinds == {(0, "response"): 2, (1, "revisit"): 5, (2, "revisit"): 2}
    responses = {r.capture_id for r in got if r.response.kind == "response"}
    assert {r.response.refers_to for r in got if r.response.kind == "revisit"} <= responses
    monkeypatch.setattr(C := common, "table", lambda *_: pages)
    out = warc.op8_warc(spark, "").collect()
    assert C and len(out) == len(rows) and sum(r.record_type == "revisit" for r in out) == 7 and {r.refers_to for r in out} == {None, 0}
    monkeypatch.setattr(common, "table", lambda *_: pages.limit(0))
    assert warc.op8_warc(spark, "").count() == 0


# ---- 9: Jaccard join -------------------------------------------------------------------------------------------------


def plain_components(docs, percent=80):
    sets = {d: set(bag_space(t)) for d, t in docs.items()}
    label = {d: d for d in docs}
    ids = sorted(docs)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def bag_space(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


@pytest.mark.parametrize(("block", "hot"), [(2, 1 << 16), (256, 1 << 16), (256, 3)])
def test_jaccard(spark, monkeypatch, block, hot):
    monkeypatch.setattr(jaccard, "COLUMN_BLOCK", block)  # used where plans are built
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "PART", hot)
    rng = random.Random(11)
    texts = []
    for group in range(12):
        base = prose(group, rng.choice([8, 30, 120]))
        for _ in range(rng.choice([1, 4, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            texts.append(" ".join(w))
    line = " ".join(prose(99, 60))  # a passage that many different documents share
    texts += [line + " " + " ".join(prose(100 + i, rng.choice([5, 40]))) for i in range(20)]
    texts += [line + " " + " ".join(prose(200 + i // 3, 12)) + " x" * (i % 3) for i in range(20)]
    texts += [texts[0].upper(), "a b", "A  b", "a", "", None]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, texts), scratch(spark)).collect()}
    assert got == plain_components(dict(enumerate(texts)))
    kept = {r.doc_id for r in jaccard.keep_one(documents(spark, texts), scratch(spark)).collect()}
    assert kept == {d for d, (_, c) in got.items() if d == c}


@pytest.mark.parametrize("block", [3, 256])
def test_jaccard_links(spark, monkeypatch, block):
    """Every link counts, within groups of near copies too."""
    monkeypatch.setattr(jaccard, "SET_BLOCK", block)  # used where plans are built
    rng = random.Random(12)
    texts = []
    for group in range(6):
        base = prose(group, rng.choice([8, 60, 120]))
        for _ in range(rng.choice([2, 12, 40])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            texts.append(" ".join(w))
    texts += [texts[0].upper(), "a b", "A  b", "a", "", None]
    rng.shuffle(texts)
    sets = [set(bag_space(t)) for t in texts]
    linked = lambda x, y: bool(x) and 100 * len(x & y) >= 80 * len(x | y)
    plain = [sum(linked(x, y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
    got = {r.doc_id: r for r in jaccard.jaccard_links(documents(spark, texts), scratch(spark)).collect()}
    assert [got[i].n_links for i in range(len(texts))] == plain
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == plain_components(dict(enumerate(texts)))
    assert sum(r.n_links for r in jaccard.jaccard_links(odd_table(spark), scratch(spark)).collect() if r.doc_id is None) == 0
    assert jaccard.jaccard_links(empty(spark), scratch(spark)).count() == 0


@pytest.mark.parametrize("entries", [10, 400_000])
def test_jaccard_batches(monkeypatch, entries):
    """Streams over sorted rows give the same, however the rows are cut into batches."""
    monkeypatch.setattr(jaccard, "PRODUCT_ENTRIES", entries)
    rng = random.Random(4)
    rows = sorted((rng.randrange(12), rng.choice([0, 0, 1, 2]), rng.randrange(5, 8), i) for i in range(80))
    cut = lambda size: [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + size]], pa.int64()) for c in range(4)], ["g", "part", "n", "id"]) for a in range(0, 80, size)]
    give = lambda size: [x for b in jaccard._shared(iter(cut(size)), 80) for x in zip(*(b.column(c).to_pylist() for c in range(5)))]
    assert give(80) == give(1) == give(7)
    groups = collections.Counter((g, p) for g, p, _, _ in rows)
    assert len(give(80)) == sum(n for (_, p), n in groups.items() if p or n > 1)
    rows = sorted((rng.randrange(4), 10, rng.randrange(3), 1, 0, [rng.randrange(9) for _ in range(3)], [10] * 3) for _ in range(50))
    rows = [(x, nx, 5, o, b, [10 * o + i for i in y], ny, [o] * 3) for x, nx, o, _, b, y, ny in sorted(rows, key=lambda r: (r[0], r[2], r[4]))]
    names = ["x", "nx", "label", "other", "block", "y", "ny", "ly"]
    cut = lambda size: [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + size]]) for c in range(8)], names) for a in range(0, 50, size)]
    give = lambda size: sorted(x for b in jaccard._product(iter(cut(size)), 80) for x in zip(*(b.column(c).to_pylist() for c in range(5))))
    assert give(50) == give(1) == give(7)
    plain = {k: n for k, n in collections.Counter((x, o, y) for x, _, _, o, _, ys, _, _ in rows for y in ys).items() if 180 * (n + 7) >= 80 * 20}
    assert {(r[0], r[3], r[1]): r[4] for r in give(50)} == plain


def test_jaccard_pairs_of_groups():
    """Of a small group all pairs come, of a larger one those with its first members, however the rows are cut."""
    rows = [(1, 0, 10, i) for i in range(9)] + [(2, 0, 10, i) for i in range(8)] + [(3, 0, 10, 1)] + [(4, p, 10, i) for p in (1, 2) for i in (p, p + 5)] + [(5, 0, 10, 3), (5, 0, 20, 4)]
    cut = lambda size: [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + size]], pa.int64()) for c in range(4)], ["g", "part", "n", "id"]) for a in range(0, len(rows), size)]
    give = lambda size: [x for b in jaccard._shared(iter(cut(size)), 80, 8) for x in zip(*(b.column(c).to_pylist() for c in range(6)))]
    got = give(100)
    assert all(give(size) == got for size in (1, 2, 5, 9))
    assert [(g, i, partners, large) for g, _, i, partners, _, large in got] == [
        *((1, i, list(range(min(i, jaccard.PIVOTS))), True) for i in range(9)),
        *((2, i, list(range(i)), False) for i in range(8)),
        *((4, i, partners, True) for i, partners in ((1, []), (6, [1]), (2, []), (7, [2]))),
        (5, 3, [], False),
        (5, 4, [], False),
    ]


@pytest.mark.parametrize(("small", "block"), [(1, 2), (2, 256), (6, 2), (6, 256)])
def test_jaccard_small_and_large_groups(spark, monkeypatch, small, block):
    """Pairs that share n-grams of small groups, of large ones and of both."""
    monkeypatch.setattr(jaccard, "SMALL", small)  # used where plans are built
    monkeypatch.setattr(jaccard, "COLUMN_BLOCK", block)
    rng = random.Random(small)
    lines = [" ".join(prose(300 + i, 25)) for i in range(4)]
    texts = []
    for group in range(14):
        base = prose(group, rng.choice([12, 40, 90]))
        for _ in range(rng.choice([1, 2, 3, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            texts.append(" ".join([*w, *rng.sample(lines, rng.choice([0, 1, 1, 3]))]))
    texts += [rng.choice(lines) + " " + " ".join(prose(400 + i // 2, 9)) + " y" * (i % 2) for i in range(16)]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, texts), scratch(spark)).collect()}
    assert got == plain_components(dict(enumerate(texts)))


def test_jaccard_product_without_small_groups(spark, monkeypatch):
    """N-grams that few documents share by chance cost no row of the product."""
    met = []
    product = jaccard._blocked_product
    monkeypatch.setattr(jaccard, "_blocked_product", lambda marked, *rest: met.append(marked.count()) or product(marked, *rest))
    words = [f"w{i}" for i in range(4)]
    rng = random.Random(5)
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, texts), scratch(spark)).collect()}
    assert got == plain_components(dict(enumerate(texts)))
    assert met == [0]


def test_jaccard_odd(spark):
    got = {str(r.doc_id): r.component_id for r in jaccard.jaccard_components(odd_table(spark), scratch(spark)).collect()}
    assert got["13"] == got["12"] == got["11"] == 11 and got["0"] == 0 and got["1"] == 1 and got["None"] is None
    out = jaccard.keep_one(odd_table(spark), scratch(spark))
    assert out.columns == odd_table(spark).columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted([*map(str, range(12)), "None"])
    assert jaccard.jaccard_components(empty(spark), scratch(spark)).count() == 0


def test_keep_one_of_an_id(spark):
    """Texts that share a doc_id are told apart: none is lost, and near copies still go."""
    a, b, c = (" ".join(prose(i, 60)) for i in (1, 2, 3))
    rows = [(1, a, 1), (5, a + " z", 2), (5, b, 3), (5, b, 2), (7, b + " y", 4), (9, c, 5), (9, c, 5), (None, c, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long")
    got = {(r.doc_id, r.text, r.node) for r in jaccard.keep_one(docs, scratch(spark)).collect()}
    assert (1, a, 1) in got and (9, c, 5) in got and (None, c, 6) in got and len(got) == 4
    assert got - {(1, a, 1), (9, c, 5), (None, c, 6)} in ({(5, b, 2)}, {(7, b + " y", 4)})


def test_keep_one_moves_no_texts(spark):
    """Texts meet the list of copies where they are read, also where Spark itself would shuffle both."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        texts = [" ".join(prose(i // 2, 60)) for i in range(40)]
        out = jaccard.keep_one(documents(spark, texts), scratch(spark))
        assert sorted(r.doc_id for r in out.collect()) == list(range(0, 40, 2))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.set(key, before)


# ---- 10: top-k -------------------------------------------------------------------------------------------------------


def plain_top(rows, queries, k):
    out = []
    for q, v in queries:
        scores = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "same"), [(400, 8, 0), (60, 3, 40), (5, 4, 0), (300, 1, 0)])
def test_top_k(spark, monkeypatch, n, dim, same):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SEEDS", 16)
    monkeypatch.setattr(topk, "STRETCH", 32)
    monkeypatch.setattr(topk, "CHUNK_BYTES", 300)
    monkeypatch.setattr(topk, "GROUP", 2)
    rng = random.Random(n)
    rows = [(i, [rng.randint(-50, 50) * (1 if i % 9 else 10) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, [7] * dim) for i in range(same)]
    df = spark.createDataFrame([(i, v, sum(x * x for x in v)) for i, v in rows], "id long, v array<long>, norm2 long").repartition(3)
    got = topk.top_k(df, df.where("id % 10 = 0"), 10, scratch(spark))
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, [r for r in rows if r[0] % 10 == 0], 10)


def test_top_k_odd(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [0.5, -0.25]), (6, [3.0]), (7, [])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r.id: r.v for r in v.collect()} == {0: [1024, 2048], 5: [512, -256], 6: [3072], 7: []}
    got = topk.top_k(v, v.where("id = 0"), 10, scratch(spark))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 6, 1024 * 3072), (0, 2, 5, 0), (0, 3, 7, 0)]
    assert topk.top_k(v.limit(0), v.limit(0), 10, scratch(spark)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k_of_long_vectors(spark, kind):
    """Vectors of any finite length take part; scores beyond 64 bits keep their place and are null."""
    rng = random.Random(6)
    powers = [0, 3, 6, 9, 15, 17, 30] + ([200, 304] if kind == "double" else [38])
    given = [(i, [rng.uniform(-3, 3) * 10.0 ** rng.choice(powers) for _ in range(3)]) for i in range(150)]
    given += [(200, [3e6, 0.0, 0.0]), (201, [1.0, 2.0, 0.0]), (202, [0.0, 0.0, 0.0]), (203, [4.6e15, 0.0, 0.0])]
    table = spark.createDataFrame(given, f"vec_id long, embedding array<{kind}>")
    rows = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in table.collect()]
    v = topk.quantised(table)
    got = topk.top_k(v, v.where("id % 10 = 0 or id > 199"), 10, scratch(spark)).collect()
    want = plain_top(rows, [r for r in rows if r[0] % 10 == 0 or r[0] > 199], 10)
    assert sorted(tuple(r)[:3] for r in got) == [r[:3] for r in want]
    assert {(r.query_id, r.rank): r.score for r in got} == {(q, k): s if -(1 << 63) <= s < 1 << 63 else None for q, k, _, s in want}
    small = topk.top_k(v.where("id > 199"), v.where("id = 201"), 2, scratch(spark)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in small] == [(203, None), (200, 3 * 10**6 * 1024 * 1024)]


def test_top_k_prunes(spark, monkeypatch):
    """By descending length most chunks are never read; of equal lengths the first coordinates tell them apart."""
    for name, value in (("QUERY_BLOCK", 8), ("SEEDS", 16), ("CHUNK_BYTES", 8 * 4 * 20), ("GROUP", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(8)
    long = [(i, [rng.randint(500, 900) for _ in range(4)]) for i in range(60)]
    rows = long + [(i, [rng.randint(0, 100) for _ in range(4)]) for i in range(60, 2000)]
    df = spark.createDataFrame([(i, v, float(sum(x * x for x in v))) for i, v in rows], "id long, v array<long>, norm2 double").repartition(3)
    s = scratch(spark)
    got = topk.top_k(df, df.where("id % 50 = 0"), 10, s)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, [r for r in rows if r[0] % 50 == 0], 10)
    chunks, blocks, pairs = (spark.read.parquet(s.path(x)).count() for x in ("chunks", "blocks", "pairs"))
    assert chunks >= 100 and pairs <= 0.1 * chunks * blocks


# ---- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        before, after = ({r.doc_id: r.text for r in df.collect()} for df in (docs, out))
        if name == "quality_classifier":
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
            assert set(after) == plain_sample(spark, sorted(before.items()), good) and len(after) > len(before) / 2
        elif name == "ngram_jaccard_join":
            assert set(after) == {d for d, (_, c) in plain_components(before).items() if d == c}
        elif name == "substring_dedup":
            wanted = plain_repeats(before)
            assert after == {d: wanted[d][2] if wanted[d][1] else before[d] for d in before}
        elif name == "benchmark_decontamination":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
            shared = {s for t in items.values() for s in bag_of(words_of(t))}
            near = {d: t for d, t in before.items() if shared & set(bag_of(words_of(t)))}
            assert set(before) - set(after) == {d for d, _ in plain_contamination(near, items)}
        docs = spark.createDataFrame(out.collect(), docs.schema)
    tokens = {r.doc_id: r for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()}
    assert {d: r.decoded_sha256 for d, r in tokens.items()} == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in after.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, tokens.values()))
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
