"""Operators against brute force, where a cut would lose part of the job."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from canvass.llm import bpe, chat, decontaminate, jaccard, lz_dedup, pii, quality, queries, token_store
from canvass.llm.common import Scratch


def near_groups(rows):
    """Least doc_id of each document's group by all pairs of Jaccard 0.8 or more."""
    def grams(text):
        words = text.lower().split()
        size = min(5, len(words))
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()

    sets, least = {i: grams(t or "") for i, t in rows}, {i: i for i, _ in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while True:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least


def edited_texts():
    draw = random.Random(3)
    line = " ".join(f"common{i}" for i in range(12))
    out = []
    for group in range(12):
        words = [f"g{group}w{draw.randrange(10_000)}" for _ in range(draw.choice([6, 20, 80, 200]))]
        for _ in range(8):
            copy = list(words)
            for _ in range(draw.randint(0, 1 + len(words) // 40)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10_000)}"
            out.append(" ".join(copy) + (f" {line}" if draw.random() < 0.3 else ""))
    return [*enumerate(out), (900, ""), (901, None), (902, out[0].upper()), (903, "one two"), (904, "two one")]


@pytest.mark.parametrize("crowd", [jaccard.CROWD, 2])
def test_near_duplicate_stage_against_all_pairs(spark, crowd):
    rows = edited_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = near_groups(rows)
    got = jaccard.near_duplicates(docs, crowd=crowd)
    assert {r.doc_id: r.component_id for r in got.collect()} == expected
    if crowd != 2:
        kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
        assert kept == set(expected.values()) and len({expected[i] for i in range(96)}) < 80


def test_near_duplicate_stage_links_by_fingerprints_first(spark, monkeypatch):
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(600)]
    far = [f"far{k}" if k % 60 == 30 else w for k, w in enumerate(base)]
    other = [f"o{draw.randrange(10**6)}" for _ in range(600)]
    texts = [base, [*base, "end"], ["start", *base], [*base, "end"], far, other, [*other[:-1], "end"], other[:400], ["alone"] * 9]
    rows = [(k, " ".join(words)) for k, words in enumerate(texts)]
    written, save = {}, Scratch.save

    def kept(self, name, df):
        out = save(self, name, df)
        if name in ("closepairs", "close", "pairs"):
            written[name] = {(r.a, r.b) for r in out.collect()}
        return out

    monkeypatch.setattr(Scratch, "save", kept)
    stage = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    expected = near_groups(rows)
    assert {r.doc_id for r in stage.collect()} == set(expected.values()) == {0, 5, 7, 8}
    sets = {jaccard.signature(x): x.tolist() for x in (jaccard.elements(t) for _, t in rows)}
    prints = {sig: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x)) for sig, x in sets.items()}
    first = {fp: min(sig for sig in sets if prints[sig] == fp) for fp in prints.values()}  # stands for its fingerprint in the table
    within = {(a, b) for a, b in itertools.combinations(sorted(first.values()), 2) if (prints[a] ^ prints[b]).bit_count() <= 2}
    within |= {(first[fp], sig) for sig, fp in prints.items() if first[fp] != sig}
    assert len(first) < len(prints) < len(first) + len(within) and written["closepairs"] == within
    assert written["close"] == {(a, b) for a, b in within if 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})} != set()
    assert written["pairs"] and not written["pairs"] & written["close"]  # the join looks for what is left: far's fingerprint is further off


def test_short_and_unspaced_benchmark_items(spark):
    items = [(0, "Who wrote Hamlet?"), (1, "name the largest planet of our system"), (2, "法国的首都是哪个城市"), (3, "a b c d e f g h i j"), (4, "Oxygen"), (5, "..."), (6, "เมืองหลวงของไทยคืออะไร")]
    docs = [
        (0, "he asked: who wrote hamlet, and when"), (1, "Name the biggest planet of our system now"), (2, "请问，法国的首都是哪个城市？谢谢"), (3, "x a b C d Z f g h Y j k"),
        (4, "oxygen is a gas"), (5, "who has wrote hamlet"), (6, "name a larger planet of our system"), (7, "a b X d Z f g h Y j"), (8, "法国首都"), (9, None), (None, "oxygen"),
        (10, "w " * (decontaminate.PART - 2) + "who wrote hamlet"), (11, "ถาม เมืองหลวงของไทยคืออะไร ครับ"),
    ]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    expected = {(0, 0): 1.0, (1, 1): 6 / 7, (2, 2): 1.0, (3, 3): 0.8, (4, 4): 1.0, (10, 0): 1.0, (11, 6): 1.0}
    assert {(r.doc_id, r.item_id): r.similarity for r in got.collect()} == pytest.approx(expected)


def test_terms_beside_entities_seen_once(spark):
    docs = spark.createDataFrame([(0, "the plain words Quixby wrote to q1@x.org the plain words"), *[(i, f"the plain words number n{i} of all") for i in range(1, 300)]], "doc_id long, text string")
    clean = {r.doc_id: r.c for r in pii.personal_data(docs).select("doc_id", pii.sanitised(F.col("text"), F.col("spans")).alias("c")).collect()}
    assert clean[0] == "the plain words <term> <term> <term> <email> the plain words" and clean[1] == "the plain words number n1 of all"
    # Terms of digits alone are judged like others, and words count whole.
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.kind: r["count"] for r in pii.personal_data(whole).select(F.explode("spans").alias("s")).groupBy("s.kind").count().collect()}
    assert found.pop(len(pii.KINDS)) == 187 and sum(found.values()) == 82
    counted = queries.op9_pii(spark, "/root/testdata/sf0.01").agg(*[F.sum(f"n_{k}") for k in pii.KINDS]).first()
    assert {i: n for i, n in enumerate(counted)} == found


def disclosing_terms(texts):
    """All (text, term spans) by counting, from the definition."""
    patterns = {k: re.compile(p) for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"))}

    def term(word):
        return re.sub(r"^[\W_]+|[\W_]+$", "", word).lower()

    near, holders, whole = {}, {}, {}
    base = {t: [(m.start(), m.end(), f"{k}:{m[0].lower()}") for k, p in patterns.items() for m in p.finditer(t)] for t in texts}
    places = {t: [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in texts}
    for t in set(texts):
        for w in {term(w) for _, _, w in places[t]} - {""}:
            whole[w] = whole.get(w, 0) + 1
        for a, b, entity in base[t]:
            holders.setdefault(entity, set()).add(t)
            left = [term(w) for _, end, w in places[t] if end < a + (t[a - 1 : a] in " \t\n") and term(w)][-pii.CONTEXT :]
            right = [term(w) for start, _, w in places[t] if start > b - (t[b : b + 1] in (" ", "\t", "\n")) and start >= b and term(w)][: pii.CONTEXT]
            for w in {*left, *right}:
                near.setdefault((entity, w), set()).add(t)
    n, out = len(set(texts)), {t: set() for t in texts}
    for (entity, w), held in near.items():
        n_e, n_te, n_t = len(holders[entity]), len(held), whole[w]
        p = (n_te + pii.PRIOR * n_e / n) / (n_t + pii.PRIOR)
        if math.log(p * n / n_e) >= pii.DISCLOSURE * math.log(max(n, n_e + 1) / n_e):
            for t in held:
                for start, end, word in places[t]:
                    if term(word) == w:
                        at = start + re.search(r"[^\W_]", word).start()
                        if not any(a < at + len(w) and at < b for a, b, _ in base[t]):
                            out[t].add((at, at + len(w)))
    return out


def test_terms_against_counting(spark):
    draw = random.Random(21)
    common, rare = [f"w{i}" for i in range(12)], [f"rare{i}" for i in range(900)] + ["4711", "Ümlaut", "x" * 300, "(quoted)", "--", "'"]
    texts = []
    for i in range(150):
        words = [draw.choice(common) for _ in range(draw.randint(0, 30))]
        for _ in range(draw.randint(3, 6)):
            words.insert(draw.randint(0, len(words)), draw.choice(rare))
        for _ in range(draw.choice([0, 0, 1, 2])):
            words.insert(draw.randint(0, len(words)), draw.choice(["a@b.cd", "(jo@x.org),", "1.2.3.4", "mail:Kim@y.net", f"n{i}@z.com"]))
        texts.append(draw.choice([" ", "\n"]).join(words))
    expected = disclosing_terms(texts)
    docs = spark.createDataFrame([(None if i % 7 == 0 else i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.personal_data(docs).collect():
        assert ({(s.start, s.end) for s in r.spans if s.kind == len(pii.KINDS)}, r.text) == (expected[r.text], r.text)
    assert sum(map(len, expected.values())) > 30


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1 " * 500_000, "a@b" + ".b" * 500_000, "-" * 1_000_000, "a" + "!" * 300_000 + "b c@d.ee x", "+1" * 100_000, "x@y.zz q " * 2_000])
def test_runs_that_a_pattern_could_go_back_over(spark, text):
    found = pii.personal_data(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).withColumn("clean", pii.sanitised(F.col("text"), F.col("spans")))
    spans = {r.doc_id: r.base for r in found.collect()}
    whole = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    assert [(s.start, s.end) for s in spans[1]] == whole and spans[2] == []


def test_factors_are_words_of_their_reference(spark):
    draw = random.Random(5)
    base = [[f"b{k}w{draw.randrange(900)}" for _ in range(60)] for k in range(4)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(draw.randint(1, 4)):
            at, part = draw.randrange(40), draw.choice(base)
            words += part[at : at + draw.randint(5, 40)] + [f"own{draw.randrange(50)}"] * draw.randint(0, 3)
        rows.append((i if i % 9 else 3, " ".join(words)))
    rows += [(70, " ".join(["same"] * 40)), (71, " ".join(["same"] * 50))]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t.split())
    found = lz_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    factors = 0
    for r in found:
        own = [w for w in texts[r.doc_id] if len(w) == r.n_words]
        for s in r.spans:
            factors += 1
            assert s.words >= lz_dedup.WINDOW and s.source_doc_id < r.doc_id
            assert any(w[s.first_word : s.first_word + s.words] == v[s.source_first_word : s.source_first_word + s.words] for w in own for v in texts[s.source_doc_id])
    assert factors > 60


@pytest.mark.parametrize("piece", [1, 7, 64, 1000])
def test_features_do_not_follow_pieces(piece, monkeypatch):
    draw = random.Random(1)
    texts = [" ".join(draw.choice(["a", "bb", "c.d", "éé", "x!!y", "the the"]) for _ in range(2000)) + "  ", "a" * 3000 + " " + "b" * 3000, " " * 4000 + "x x x", "", "!!! .."]
    whole = [quality.features(t) for t in texts]
    monkeypatch.setattr(quality, "PIECE", piece)
    for t, (index, values) in zip(texts, whole, strict=True):
        got = quality.features(t)
        assert (got[0] == index).all() and got[1] == pytest.approx(values)


def test_small_shards_and_null_keys(spark):
    rows = [(i // 3, f"text number {i} of all") for i in range(60)] + [(None, "no key"), (None, None)]
    docs, encoder = spark.createDataFrame(rows, "doc_id long, text string"), token_store.LibraryEncoder(queries.definition())
    root = token_store.new_root(spark)
    manifest = token_store.write_store(docs, encoder, root, shard_bytes=30)
    assert manifest.count() > 15
    got = token_store.read_store(manifest, root).orderBy("start").collect()
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (key, text) in zip(got, expected, strict=True):
        ids = [*encoder.library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [len(x) for x in token_store.get_document(spark, manifest, root, 4)] == [r.n_tokens for r in got if r.doc_id == 4]


def test_memory_that_turns_over(monkeypatch):
    draw = random.Random(2)
    texts = ["\n".join(" ".join("".join(draw.choice("abtheinr.") for _ in range(draw.randint(1, 9))) for _ in range(30)) for _ in range(5)) for _ in range(40)] + ["a  b", "\n\nx", " lead", "trail ", "don't\tstop  é汉字　x \x1c y", ""]
    codec, encoder = queries.codec(), token_store.LibraryEncoder(queries.definition())
    codec.memory.size = encoder.memory.size = 50
    monkeypatch.setattr(bpe, "grouped", lambda x, together=20, f=bpe.grouped: f(x, together))
    monkeypatch.setattr(token_store, "grouped", bpe.grouped)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert list(codec.encode(texts)) == [own.encode_ordinary(t) for t in texts]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_without_a_conversation_stand_alone(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (5, 0, "assistant", "c")], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_conversations(rows, queries.definition())).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in got) == [(0, 1, 0), (0, 1, 1), (0, 1, 1), (5, 1, 1)]


def test_substring_sql(spark):
    duck = duckdb.connect()
    duck.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    expected = Counter(duck.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({queries.ORACLE_SQL['op7_substrings']})").fetchall())
    assert expected == Counter(tuple(r) for r in queries.op7_substrings(spark, "/root/testdata/sf0.001").collect())


def test_pipeline_run_with_odd_rows(spark, tmp_path):
    """Nulls, empty texts, clashing columns and repeated doc_ids pass through all stages."""
    sf = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    clash = {c: F.lit(c) for c in ("spans", "base", "score", "predicted", "held_out", "__x")}
    whole = spark.read.parquet(f"{sf}/documents.parquet").withColumns(clash)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    good = whole.where(F.length("text") > 400).limit(3)
    odd = good.withColumn("doc_id", F.lit(None).cast("long")).union(good.withColumn("text", F.lit(None).cast("string"))).union(good.withColumn("text", F.lit("")))
    whole.union(odd).union(good.limit(1).withColumn("text", F.concat("text", F.lit(" " + item)))).union(good).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        assert out.where("spans <> 'spans' or base <> 'base' or score <> 'score'").count() == 0
    assert corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).where("doc_id is null and text is not null").count() == 3
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 50
