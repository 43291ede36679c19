"""Decontamination over all alignments, and the quality classifier with plain dictionaries, on real documents."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.llm import decontaminate, quality
from canvass.llm.spans import SpanHasher

SF = "/root/testdata/sf0.001"


def aligned(doc: np.ndarray, item: np.ndarray) -> float:
    """Greatest share of equal tokens in any WINDOW aligned tokens, all of a shorter item."""
    width = min(decontaminate.WINDOW, len(item))
    if len(doc) < width or not width:
        return 0.0
    equal = (doc[:, None] == item[None, :]).astype(np.int16)
    rows, columns = len(doc) - width + 1, len(item) - width + 1
    return max(0, sum(equal[k : k + rows, k : k + columns] for k in range(width)).max()) / width


def hashed(spark, df, key):
    return [(r[0], np.array(r[1], np.int64)) for r in df.select(key, decontaminate.hashed_tokens(F.col("text"))).collect() if r[0] is not None and r[1] is not None]


def test_every_alignment_of_real_documents(spark):
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = benchmark.collect()
    draw, made = random.Random(3), []
    for k in range(150):  # passages of items, of all lengths and with up to a third of the words changed
        words = draw.choice(items).text.split()
        a = draw.randrange(len(words))
        part = words[a : a + draw.choice([6, 12, 16, 17, 20, 40])]
        part = [draw.choice(["zzz", "Qq"]) if draw.random() < draw.choice([0.05, 0.15, 0.33]) else w for w in part]
        made.append((10_000 + k, " ".join(["before"] * draw.randint(0, 5) + part + ["after"] * draw.randint(0, 5))))
    short = [(500 + k, " ".join(f"s{k}x{j}" for j in range(k))) for k in range(1, 12)]
    for k, (_, text) in enumerate(short):
        words = text.split()
        for changed in range(4):
            given = words.copy()
            for j in draw.sample(range(len(words)), min(changed, len(words))):
                given[j] = "other"
            made.append((20_000 + 10 * k + changed, "and " + " ".join(given) + " then"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    every = benchmark.select("item_id", "text").union(spark.createDataFrame(short, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, every).collect()}
    expected = {}
    held = hashed(spark, every, "item_id")
    for doc_id, doc in hashed(spark, docs, "doc_id"):
        for item_id, item in held:
            if (share := aligned(doc, item)) >= decontaminate.SIMILARITY:
                expected[doc_id, item_id] = share
    assert got.keys() == expected.keys() and len(expected) > 60
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_long_texts_and_many_seeds(spark, monkeypatch):
    """Bits that are nearly all set let every place through, and the join still decides."""
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 3)
    monkeypatch.setattr(decontaminate, "PART", 50)
    draw = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(draw.choices(words, k=25))) for k in range(40)]
    docs = [(k, " ".join(draw.choices(words, k=draw.randint(0, 400)) + (items[k % 40][1].split() if k % 3 == 0 else []) + draw.choices(words, k=60))) for k in range(90)]
    clash = ", of int, pos int, w int, seed long, kind int, t string"
    df = spark.createDataFrame([(*d, 1, 2, 3, 4, 5, "t") for d in docs], "doc_id long, text string" + clash)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k % 40) for k in range(0, 90, 3)}


def plain_features(text: str | None) -> dict[int, float]:
    data = (text or "").encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|(?:(?![0-9A-Za-z])[\x21-\x7e])+", data)]
    number = lambda part: int(SpanHasher(part)(np.array([0]), np.array([len(part)]))[0]) % (quality.DIMENSIONS - 2) + 2
    counts = Counter(number(data[a:b]) for a, b in found)
    counts.update(number(data[a:d]) for (a, _), (_, d) in zip(found, found[1:], strict=False))
    repeats = sum(data[a:b] == data[c:d] for (a, b), (c, d) in zip(found, found[1:], strict=False))
    if repeats:
        counts[1] = repeats
    values = {k: 1 + math.log(n) for k, n in counts.items()}
    size = max(1e-12, math.sqrt(sum(x * x for x in values.values())))
    return {0: 1.0} | {k: x / size for k, x in values.items()}


def test_classifier_against_plain_dictionaries(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "a a a !! a"), (9004, "é" * 300 + " x")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = [(r.doc_id, r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    order = spark.createDataFrame([(d, q, e) for d, q in kept for e in range(quality.EPOCHS)], "doc_id long, label int, epoch int")
    order = order.withColumn("at", F.xxhash64(F.xxhash64(F.col("doc_id").cast("string")), "epoch")).collect()
    z, n = Counter(), Counter()

    def weight(k: int) -> float:
        return 0.0 if abs(z[k]) <= 0.01 else (math.copysign(0.01, z[k]) - z[k]) / (1.0 + math.sqrt(n[k]) + 0.01)

    def probability(x: dict) -> float:
        return 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))

    for r in sorted(order, key=lambda r: (r.epoch, r.at, r.label, texts[r.doc_id] or "")):
        x = plain_features(texts[r.doc_id])
        w, off = {k: weight(k) for k in x}, probability(x) - r.label
        for k, v in x.items():
            slope = off * v
            rate = math.sqrt(n[k] + slope * slope) - math.sqrt(n[k])
            z[k] += slope - rate * w[k]
            n[k] += slope * slope
    assert len(kept) > 20 and all(got[d] == pytest.approx(probability(plain_features(t)), abs=1e-6) for d, t in texts.items())


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    size = min(5, len(words))
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else frozenset()


def one_of_each_group(texts: dict[int, str | None]) -> set[int]:
    """The least doc_id of each group that pairs of Jaccard similarity 0.8 connect, all pairs tried."""
    ids, sets = sorted(texts), {d: shingles(t) for d, t in texts.items()}
    group = {d: d for d in ids}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {top(d) for d in ids}


def test_whole_pipeline_against_plain_stages(spark, tmp_path):
    import hashlib

    import tiktoken

    import corpus_pipeline
    from canvass.llm import pii, queries

    sf = "/root/testdata/sf0.01"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 500")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    scores = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] >= 0.7}
    kept = one_of_each_group(texts)
    items = hashed(spark, spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id")
    clean = [d for d, t in hashed(spark, docs, "doc_id") if d in kept and not any(aligned(t, item) >= 0.8 for _, item in items)]
    assert len(texts) > len(kept) > len(clean) > 100 and got.keys() == set(clean)
    left = docs.where(F.col("doc_id").isin(clean)).select("doc_id", "text")
    codec = queries.codec()
    library = tiktoken.Encoding("t", pat_str=codec.pattern, mergeable_ranks=codec.ranks, special_tokens={})
    names = (*pii.KINDS, "term")
    for r in pii.personal_data(left).collect():  # the spans are held against patterns and counts elsewhere
        out, at = [], 0
        for s in r.spans:
            if s["start"] >= at:
                out += [r.text[at : s["start"]], f"<{names[s['kind']]}>"]
            at = max(at, s["end"])
        text = "".join(out) + r.text[at:]
        ids = library.encode_ordinary(text)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
