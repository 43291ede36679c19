"""The ten operators against brute force, round trips and held-out rows, with nulls, ties, long and empty texts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from canvass.llm import ann, bpe, chat, decontaminate, lz_dedup, pii, quality, queries, simhash, suffix_dedup, token_store
from canvass.llm.common import Scratch
from canvass.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, row int"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs_of(spark, texts):
    """Documents with clashing extra columns; texts may be None, ids too."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1) for i, t in texts], DOCS)


def hard_texts():
    draw = random.Random(11)
    words = ["alpha", "beta", "Gamma", "d.", "é", "中文", "🙂", "x1"]
    base = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 90))) for _ in range(30)]
    shared = " ".join(f"w{i}" for i in range(60))
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, f"{base[i]} {shared} \t{base[i + 1]}") for i in range(5)] + [(200, base[3]), (200, base[3]), (201, base[3]), (202, ""), (203, None), (None, base[4]), (None, None), (204, "a" * 5000), (205, (shared + "\n") * 40)]
    return out


@pytest.fixture(scope="module")
def hard(spark):
    return docs_of(spark, hard_texts())


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, "documents").cache()


def both(documents, hard):
    return {"documents": documents, "hard": hard}


@pytest.mark.parametrize("which", ["documents", "hard"])
def test_simhash(spark, documents, hard, which):
    df = both(documents, hard)[which]
    got = simhash.near_duplicates(df).toPandas()
    rows = df.select("doc_id", "text").collect()

    def brute(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    prints = [brute(r.text) for r in rows]
    assert Counter((r.doc_id, p - (p >> 63 << 64)) for r, p in zip(rows, prints)) == Counter((None if pd.isna(a) else a, b) for a, b in zip(got.doc_id, got.fp))
    kinds = sorted({p for r, p in zip(rows, prints) if r.doc_id is not None})
    group = {p: p for p in kinds}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= 2:
                group[top(a)] = top(b)
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[top(p)] = min(least.get(top(p), r.doc_id), r.doc_id)
    expected = Counter((r.doc_id, least[top(p)] if r.doc_id is not None else None) for r, p in zip(rows, prints))
    assert expected == Counter((None if pd.isna(a) else a, None if pd.isna(b) else b) for a, b in zip(got.doc_id, got.component_id))


def test_simhash_links_of_crowded_blocks(spark):
    draw = random.Random(2)
    prints = {0, *(1 << draw.randrange(64) | 1 << draw.randrange(64) for _ in range(300)), *(draw.getrandbits(64) for _ in range(50))}
    prints |= {p ^ (1 << draw.randrange(64)) for p in list(prints)[:100]}
    rows = [(p - (p >> 63 << 64), i) for i, p in enumerate(sorted(prints))]
    scratch = Scratch(spark, "test")
    found = connected_components(simhash.links(spark.createDataFrame(rows, "fp long, id long"), scratch, bucket=8), scratch).toPandas()
    got = dict(zip(found.node, found.component))
    array = np.array(sorted(prints), np.uint64)
    near = np.bitwise_count(array[:, None] ^ array[None]) <= 2
    label = np.arange(len(array))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    assert all(got.get(i, i) == label[i] for i in range(len(array)))


def test_components_of_a_chain_and_nothing(spark):
    scratch = Scratch(spark, "test")
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (None, 3)], "a long, b long")
    assert {r.component for r in connected_components(chain, scratch).collect()} == {0}
    assert connected_components(chain.where("a > 99"), Scratch(spark, "test")).count() == 0


def brute_words(rows):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("which", ["documents", "hard"])
def test_substrings(documents, hard, which):
    df = both(documents, hard)[which]
    expected = Counter(brute_words([(r.doc_id, r.text) for r in df.collect()]))
    got = lz_dedup.substring_dedup(df)
    assert expected == Counter(tuple(r) for r in got.drop("spans").collect())
    assert sum(s.words for r in got.collect() for s in r.spans) > 0
    assert lz_dedup.substring_dedup(df.where("false"), output="kept").count() == 0


def brute_bytes(rows, width=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + width] for _, d in data for k in range(len(d) - width + 1))
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - width + 1):
            if seen[d[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield i, len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("which", ["documents", "hard"])
def test_suffixes(documents, hard, which):
    df = both(documents, hard)[which]
    expected = Counter(brute_bytes([(r.doc_id, r.text) for r in df.select("doc_id", "text").limit(10**9 if which == "hard" else 120).collect()]))
    got = suffix_dedup.byte_dedup(df if which == "hard" else df.limit(120))
    assert expected == Counter(tuple(r) for r in got.drop("spans").collect())
    assert suffix_dedup.byte_dedup(df.where("false"), output="kept").count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "labels", "/root/testdata/sf0.01")
    got = quality.classify(docs, labels)
    assert set(docs.columns) < set(got.columns) and got.count() == docs.count()
    rows = got.join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all() and rows.score.between(0, 1).all()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.9


def test_quality_edges(spark, hard):
    labels = spark.createDataFrame([(0, 1), (1, None), (999, 0), (None, 1)], "doc_id long, quality int")
    assert quality.classify(hard, labels).where("score between 0 and 1").count() == hard.count()
    assert {r.score for r in quality.classify(hard, labels.where("false")).collect()} == {0.5}
    assert quality.classify(hard.where("false"), labels).count() == 0


@pytest.mark.parametrize("lengths", [False, True])
def test_nearest(spark, lengths):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(600, 16)) * (draw.uniform(0.5, 3, (600, 1)) if lengths else 1)
    vectors[100:300] = vectors[100]
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(vectors)] + [(None, [1.0] * 16, 0, 0), (1000, None, 0, 0), (1020, [0.0] * 16, 0, 0), (1040, [float("nan")] * 16, 0, 0), (1060, [], 0, 0), (1080, [None] * 16, 0, 0), (1100, [1.0, 2.0], 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score int")
    got = ann.nearest(df, 20).toPandas()
    hit = 0
    for q in range(0, 600, 20):
        scores = (vectors * vectors[q]).sum(axis=1)
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, scores[own.vec_id], rtol=1e-12)
        assert own.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == own.vec_id.tolist()
        scores[q] = -np.inf
        hit += len(set(own.vec_id) & set(np.lexsort((np.arange(600), -scores))[:20]))
    assert hit / (30 * 20) >= 0.9
    assert ann.nearest(df.where("false"), 20).count() == 0 and set(got.query_id) == set(range(0, 600, 20))


def test_bpe(spark, documents, hard):
    codec = queries.codec()
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    draw = random.Random(1)
    odd = ["".join(draw.choice("ab  \n\t\x1c'sS9²é　 \u0085中🙂-.​") for _ in range(draw.randint(0, 14))) for _ in range(3000)] + ["a" * 3000 + " " * 500 + "\n" * 300 + "é" * 2000]
    assert all(a == library.encode_ordinary(b) for a, b in zip(codec.encode(odd), odd))
    for df in (documents, hard):
        got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, codec).collect())
        assert got == Counter(
            (r.doc_id, len(ids := library.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect()
        )


def test_chat(spark):
    odd = [(-7, 0, "user", "hi <|turn|>\\ <|"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, "assistant", " é🙂 a\\|<\\| b "), (-8, 1, "assistant", None), (-9, None, None, None), (None, 1, "assistant", "x"), (-6, 1, "assistant", "y <|endoftext|>"), (-6, 1, "assistant", "y <|endoftext|>")]
    df = table(spark, "conversations").unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    made = chat.format_conversations(df.withColumn("mask", F.lit(1)), queries.definition())
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(made).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.conv_id, []).append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    assert got.keys() == groups.keys()
    for key, turns in groups.items():
        turns.sort()
        loss, whole = "".join(t for _, role, t in turns if role == "assistant"), "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert got[key][:4] == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_decontamination(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(draw.choice(words) for _ in range(n)) for n in (14, 30, 60, 5)]
    texts, expected = [(None, items[0]), (500, None), (501, "")], set()
    for i in range(40):
        noise, item = [draw.choice(words) for _ in range(60)], items[i % 3].split()
        if i < 20:
            for k in range(2, len(item), 11):  # every eleventh token is another one
                item[k] = "Other"
            noise[30:30] = item
            expected.add((i, i % 3))
        texts.append((i, ", ".join(noise).upper()))
    texts.append((600, " ".join([*["x"] * (decontaminate.PART - 5), items[1], *["y"] * 50])))
    benchmark = spark.createDataFrame([*enumerate(items), (9, None), (None, items[0])], "item_id long, text string")
    got = decontaminate.contaminated(docs_of(spark, texts), benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == expected | {(600, 1)}
    assert decontaminate.contaminated(docs_of(spark, texts), benchmark.where("false")).count() == 0


@pytest.mark.parametrize("tokens, changed", [(12, 2), (15, 3), (16, 3)])
def test_seeds_survive_all_substitutions(tokens, changed):
    seeds = [{at + i for i in mask} for at in range(tokens - decontaminate.SPAN + 1) for mask in decontaminate.MASKS]
    assert all(any(seed.isdisjoint(x) for seed in seeds) for x in itertools.combinations(range(tokens), changed))


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 12 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
}


def test_personal_data(spark, documents, hard):
    draw = random.Random(6)
    parts = ["a.b@c.d", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (743) 555-3824", "+12", "x@y..z", "é", " ", "\n", "9", "-", ".", "a@b.c%d@e.f", "0001.2.3.4.5", "🙂"]
    odd = docs_of(spark, [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))) for i in range(400)])
    for df in (documents, hard, odd):
        for r in pii.personal_data(df.select("doc_id", "text")).select("doc_id", "text", pii.span_list("base").alias("b")).collect():
            found = []
            for k, (kind, (pattern, valid)) in enumerate(KINDS.items()):
                found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, r.text or "") if valid(m[0], re.sub("[^0-9]", "", m[0]))]
            assert r.b == ",".join(x[2] for x in sorted(found))
    assert pii.personal_data(hard.where("false")).count() == 0


def test_revealing_terms(spark):
    draw = random.Random(9)
    noise = lambda: " ".join(draw.choice(["one", "two", "three", "four", "five", "six"]) for _ in range(12))
    texts = [(i, f"{noise()} Zanzibar, jane@x.org {noise()}") for i in range(5)] + [(i, noise()) for i in range(10, 200)]
    got = {r.doc_id: r for r in pii.personal_data(docs_of(spark, texts)).withColumn("clean", pii.sanitised(F.col("text"), F.col("spans"))).collect()}
    assert all("<term>, <email>" in got[i].clean and "Zanzibar" not in got[i].clean for i in range(5))
    assert all(len(got[i].spans) == 2 for i in range(5)) and all(got[i].clean == t for i, t in texts if i >= 10)


def test_token_store(spark, documents, hard):
    definition = queries.definition()
    library = Tokenizer.from_str(definition)
    for df in (documents, hard.where("doc_id is not null")):
        root = token_store.new_root(spark)
        manifest = token_store.write_store(df, token_store.LibraryEncoder(definition), root)
        got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_store(manifest, root).collect())
        expected, start = [], 0
        for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.text or "")):
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
            expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == expected
        assert [len(x) for x in token_store.get_document(spark, manifest, root, expected[5][0])] == [n for i, _, n, _ in expected if i == expected[5][0]]
        assert token_store.get_document(spark, manifest, root, 10**12) == []
    root = token_store.new_root(spark)
    assert token_store.read_store(token_store.write_store(hard.where("false"), token_store.LibraryEncoder(definition), root), root).count() == 0


def test_pipeline_by_stages(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "test").save(name, stage(spark, docs, "/root/testdata/sf0.01"))
        kept[name] = docs
    whole = table(spark, "documents", "/root/testdata/sf0.01")
    assert all(kept[n].columns == whole.columns for n in list(kept)[:4])
    after = kept["near_duplicates"].toPandas()
    groups = simhash.near_duplicates(kept["quality"], shingle=5, similarity=0.8).toPandas()
    assert set(after.doc_id) == set(groups.component_id)
    clean = set(kept["decontamination"].toPandas().doc_id)
    leaks = {r.doc_id for r in decontaminate.contaminated(kept["near_duplicates"], table(spark, "benchmark", "/root/testdata/sf0.01")).collect()}
    assert clean == set(after.doc_id) - leaks and {r.doc_id for r in kept["bpe"].select("doc_id").collect()} == clean
    texts = {r.doc_id: r.text for r in kept["pii"].collect()}
    for r in kept["bpe"].collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens
    emails = re.compile(KINDS["email"][0])
    assert not any(emails.search(t) for t in texts.values())
