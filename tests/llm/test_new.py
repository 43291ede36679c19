"""Periodic runs, URL filters and collocations against brute force, with their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canvass.llm import collocations, queries, runs, urls

SF = "/root/testdata/sf0.01"


def brute_runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """All maximal stretches of each period; of those of one stretch the least period."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((a, b, q) for (a, b), q in found.items())


def brute_kept(words: list, found: list) -> list:
    gone = {k for a, b, q in found for k in range(a + q, a + b)}
    return [w for k, w in enumerate(words) if k not in gone]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from("ab"), max_size=60), st.lists(st.sampled_from("abcdef"), max_size=30), st.builds(lambda w, n, t: (w * n)[: len(w) * n - t], st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.integers(3, 9), st.integers(0, 4))), max_size=5))
def test_runs_of_any_words(texts):
    got = runs.runs_of(texts)
    for words, own in zip(texts, got, strict=True):
        expected = brute_runs(words)
        assert list(map(tuple, own.tolist())) == expected and runs.collapsed(words, own) == brute_kept(words, expected)


def test_runs_with_other_bounds():
    draw = random.Random(3)
    for _ in range(200):
        words = [draw.choice("ab") for _ in range(draw.randint(0, 40))]
        assert list(map(tuple, runs.runs_of([words], 4, 2)[0].tolist())) == brute_runs(words, 4, 2)


def test_runs_of_a_long_text():
    words = ["x"] * 3 + [str(k % 997) for k in range(40_000)] + ["y"] * 50_000 + ["z"]
    assert runs.runs_of([words])[0].tolist() == [[3, 40_000, 997], [40_003, 50_000, 1]]


def test_extensions_of_all_pairs():
    draw = np.random.default_rng(2)
    for symbols in (draw.integers(0, 2, 40), np.zeros(17, np.int64), np.arange(5), np.array([4])):
        found = runs.Extensions(np.append(symbols, 9))
        for a in range(len(symbols)):
            for b in range(len(symbols)):
                if a != b:
                    own = next(k for k in range(99) if max(a, b) + k >= len(symbols) or symbols[a + k] != symbols[b + k])
                    assert found(np.array([a]), np.array([b]))[0] == own


def planted(doc_id, words: list) -> list:
    """The contract's rule."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


ODD = [None, "", " \t\n", "a", "a a a a a a", "é\x1cb é\x1cb é\x1cb é\x1cb é\x1cb é\x1cb", "x " * 5000, "a b\x0bc " * 9 + "d", "🙂 ok. " * 7]


def test_op11(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(i, t) for k, t in enumerate(ODD) for i in (None, 6, k, k + 90)], "doc_id long, text string")
    path = docs.union(odd).withColumns({"runs": F.lit(1), "collapsed": F.lit("x")})
    got = Counter(queried(spark, "op11_runs", documents=path))
    expected = Counter()
    for r in path.collect():
        words = planted(r.doc_id, (r.text or "").encode().split())
        found = brute_runs(words)
        longest = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        lines, kept = "".join(f"{a},{b},{q}\n" for a, b, q in found), b" ".join(brute_kept(words, found))
        expected[(r.doc_id, len(found), *longest, longest[1] and 1000 * longest[1] // longest[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())] += 1
    assert got == expected
    assert runs.periodic_runs(odd.where("false")).count() == 0


def queried(spark, name: str, **tables):
    """Rows of a registered query over given tables."""
    import tempfile

    folder = tempfile.mkdtemp()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
    return [tuple(r) for r in queries.QUERIES[name](spark, folder).collect()]


URLS = [
    None, "", "no scheme", "http://example.org", "http://example.org/", "HTTP://WWW.Example.ORG/es/1?x=://y#z", "http://notexample.org/es/", "http://example.org/es", "http://example.org/en/1", "http://example.org/en/17/a",
    "http://example.org/en/2", "http://a.b.example.com/de/", "http://x.com/fr/de/", "http://x.com?/fr/", "http://x.com#/fr/", "http://org/", "http://.org/", "http://example.org./en/1", "http://user@example.org:80/es/", "a://b://example.org/es/",
    "http://EXAMPLE.org/ES/", "://org/es/", "http://É.org/", "http:///es/", "http://example.org//es/", "http://x.net/" + "a/" * 3000, "http://example.org/en/1\n",
]
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "example.org/en/17"), ("allow", "com/fr/"), ("block", "com/de/"), ("block", "Example.org/en/2"), ("allow", "example.org/en/2"), ("block", "net"), ("block", "b.example.com/"), ("allow", "x.net/a/a/")]


def brute_rule(host: str, path: str, rules) -> tuple:
    fits = []
    for action, rule in rules:
        name, slash, rest = rule.partition("/")
        name = name.lower()
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            fits.append(((len(name.split(".")), len(slash + rest), action == "block"), rule, action))
    return max(fits)[1:] if fits else (None, None)


def brute_parts(url) -> tuple[str, str]:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


@pytest.mark.parametrize("trie_bytes", [urls.TRIE_BYTES, 10])
def test_urls(spark, trie_bytes):
    pages = spark.createDataFrame([(k % 20 if k % 7 else None, u, "h", "p", "r") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, path string, verdict string")
    rules = spark.createDataFrame(RULES, "action string, rule string")
    got = Counter(map(tuple, urls.judged(pages, rules, trie_bytes=trie_bytes).collect()))
    expected, kept = Counter(), Counter()
    for r in pages.collect():
        host, path = brute_parts(r.url)
        rule, action = brute_rule(host, path, RULES)
        expected[(r.page_id, host, path, rule, action or "allow")] += 1
        kept[tuple(r)] += (action or "allow") == "allow"
    assert got == expected
    some = urls.filtered(pages, rules, trie_bytes=trie_bytes)
    assert some.columns == pages.columns and Counter(map(tuple, some.collect())) == +kept
    assert urls.judged(pages.where("false"), rules, trie_bytes=trie_bytes).count() == 0
    assert {r.verdict for r in urls.judged(pages, rules.where("false"), default="block", trie_bytes=trie_bytes - 10).collect()} == {"block"}
    with pytest.raises(ValueError, match="rules"):
        urls.judged(pages, rules.union(spark.createDataFrame([("deny", "x/"), ("allow", None)], "action string, rule string")))
    with pytest.raises(ValueError, match="name of a result"):
        urls.judged(pages, rules, key="host")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.text("ab./", min_size=1, max_size=6)), max_size=8), st.text("ab.", max_size=5), st.text("ab/", max_size=6))
def test_trie_against_all_rules(rules, host, path):
    rules = [r for r in rules]
    expected = brute_rule(host, "/" + path if path else "", rules)
    assert urls.Trie(rules).longest(host, "/" + path if path else "") == expected


def test_long_and_short_lists_agree_on_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rules = spark.createDataFrame([*queries.URL_RULES, *[("block", f"blog.host{k}.org/p{k}") for k in range(2000)]], "action string, rule string")
    both = [Counter(map(tuple, urls.judged(pages, rules, trie_bytes=b).collect())) for b in (urls.TRIE_BYTES, 0)]
    assert both[0] == both[1] and both[0].total() == pages.count()


def brute_collocations(rows, least: int, share: int = 50, top: int = 2000) -> list[tuple]:
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        holders = {}
        for g, a in often.items():
            for part in (g[:2], g[1:]) if len(g) == 3 else ():
                holders[part] = max(holders.get(part, 0), a)
        scored = []
        for g, a in often.items():
            if 100 * holders.get(g, 0) >= share * a:
                continue
            score, _, left, right = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), left, right))
        n = sum(a for g, a in f.items() if len(g) == 1)
        out += [(lang, k + 1, p.decode(), -a, left, right, n, -score) for k, (score, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return out


def texts_for_phrases(draw: random.Random, n: int):
    words = ["new", "York", "city", "of", "the", "É", "a\x1cb", "x"]
    weights = [1, 1, 1, 4, 6, 1, 1, 2]
    for _ in range(n):
        yield draw.choice(["en", "en", None, "de", ""]), "".join(w + draw.choice([" ", " ", "  ", "\t", ". ", "\r\n", ",", "\x0b"]) for w in draw.choices(words, weights, k=draw.randint(0, 40)))


@pytest.mark.parametrize("flush, least, top, bits", [(1 << 21, 10, 2000, 64), (50, 3, 7, 64), (300, 5, 2000, 9)])
def test_collocations(spark, flush, least, top, bits):
    """Nine bits give some words one hash with most seeds: they are counted again until none share one."""
    rows = [*texts_for_phrases(random.Random(5), 300), ("en", None), (None, ""), ("fr", " . "), ("en", "Old York " * 3000), ("en", "w" * 100)]
    df = spark.createDataFrame([(1, t, lang, 2, 3) for lang, t in rows], "doc_id long, text string, lang string, n long, score long").repartition(3)
    got = [tuple(r) for r in collocations.collocations(df, least=least, top=top, flush=flush, bits=bits).collect()]
    assert sorted(got) == sorted(brute_collocations(rows, least, top=top)) and len(got) > 10
    assert collocations.collocations(df.where("false")).count() == 0


@pytest.mark.parametrize("size", [3, 16, 4 << 20])
def test_slices_of_long_texts(monkeypatch, size):
    monkeypatch.setattr(collocations, "SLICE", size)
    text = b"ab cd\nefgh  " + b"x" * 40 + b" y\n\n b\n" + b"z" * 9
    slices = list(collocations._slices(text))
    assert b"".join(slices) == text and all(x[-1:] in b" \n" for x in slices[:-1])
    shard, whole = collocations.Shard(), collocations.Shard()
    assert [shard.add("en", x) for x in slices] == [x.endswith(b"\n") for x in slices]
    whole.words, whole.pieces = [], []
    monkeypatch.setattr(collocations, "SLICE", 4 << 20)
    whole.add("en", text)
    assert np.concatenate(shard.words).tolist() == whole.words[0].tolist() and np.concatenate(shard.pieces).tolist() == whole.pieces[0].tolist()


def test_merged_shards():
    draw = random.Random(1)
    hashes = np.array([draw.getrandbits(64) for _ in range(6)], np.uint64)
    shards = [([draw.randrange(6) for _ in range(200)], sorted(draw.randrange(12) for _ in range(200))) for _ in range(5)]
    parts: dict[int, list] = {}
    for words, pieces in shards:
        for part, nodes in collocations.serialised(np.array(words), np.array(pieces), hashes, 3):
            parts.setdefault(part, []).append(nodes)
    counts = Counter()
    for words, pieces in shards:
        for k in (2, 3):
            counts.update(tuple(words[i : i + k]) for i in range(200 - k + 1) if pieces[i] == pieces[i + k - 1])
    got = {}
    number = {int(h): i for i, h in enumerate(hashes)}
    for nodes in parts.values():
        for first, second, last, three, a, left, longer in zip(*(x.tolist() for x in collocations.merged(nodes, 4)), strict=True):
            key = (number[first], number[second], *([number[last]] if three else []))
            got[key] = a
            if three:
                assert left == counts[key[:2]]
            else:
                assert longer == max([n for g, n in counts.items() if g[:2] == key and len(g) == 3 and n >= 4], default=0)
    assert got == {g: n for g, n in counts.items() if n >= 4}


def test_scores_past_64_bits(spark):
    rows = [(10**12, 2 * 10**12, 3 * 10**12), (10, 10, 10), (7, 11, 13), (10**13 - 1, 10**13, 10**13)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert [r[0] for r in df.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()] == [10**6 * a * a // (left * right) for a, left, right in rows]


def test_near_duplicate_stage_tells_rows_apart(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    near = a + " more"
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, c, "x"), (3, c, "x"), (None, c, "x"), (4, None, "x"), (5, "", "x"), (None, near, "x"), (None, "alone " * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("row", F.lit(7)).withColumn("first", F.lit(1))
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (2, b), (3, c), (4, None), (None, "alone " * 9)])
    assert corpus_pipeline.near_duplicate_stage(spark, docs.where("false"), SF).count() == 0


def test_pages_of_one_template_do_not_all_meet(spark, monkeypatch):
    from canvass.llm import jaccard
    from canvass.llm.common import Scratch

    frame = " ".join(f"frame{k}" for k in range(200))
    pages = [(k, f"{frame} " + " ".join(f"own{k}-{j}" for j in range(45))) for k in range(900)]
    pages += [(1000 + k, pages[k][1] + " end") for k in range(0, 900, 100)]
    written, save = {}, Scratch.save

    def counted(self, name, df):
        out = save(self, name, df)
        if name.endswith("pairs"):
            written[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    got = jaccard.near_duplicates(spark.createDataFrame(pages, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k for k, _ in pages} | {1000 + k: k for k in range(0, 900, 100)}
    assert sum(written.values()) < 20 * len(pages)


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_strings_that_a_polynomial_cannot_tell_apart(spark):
    from canvass.llm import jaccard, lz_dedup, suffix_dedup

    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    words = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{words} {one}"), (2, f"{words} {other}"), (3, f"{words} {other}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in lz_dedup.substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 13}
    assert not set(jaccard.elements(f"a b c d {one}").tolist()) & set(jaccard.elements(f"a b c d {other}").tolist())
    texts = {1: one + "x" * 10, 2: other, 3: "y" * 50}
    got = {r.doc_id: r.n_removed for r in suffix_dedup.byte_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    seen = Counter(t[k : k + 200] for t in texts.values() for k in range(len(t) - 199))
    gone = {i: len({j for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1 for j in range(k, k + 200)}) for i, t in texts.items()}
    assert got == gone


def test_nearest_of_repeated_rows(spark):
    from canvass.llm import ann

    draw = np.random.default_rng(7)
    rows = [(k, draw.normal(size=8).tolist()) for k in range(120)]
    rows += [(20, rows[20][1]), (20, rows[20][1]), (20, rows[3][1]), (5, rows[5][1]), (40, [0.5] * 8)]
    got = Counter(map(tuple, ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, top=10, probes=243, width=50.0).collect()))
    expected = Counter()
    for at, (key, query) in enumerate(rows):
        if key % 20 == 0:
            near = sorted((-float((np.array(v) * np.array(query)).sum()), i) for other, (i, v) in enumerate(rows) if other != at)[:10]
            expected.update((key, k + 1, i, -s) for k, (s, i) in enumerate(near))
    assert Counter((q, k, i, round(s, 9)) for q, k, i, s in got.elements()) == Counter((q, k, i, round(s, 9)) for q, k, i, s in expected.elements())


def test_recall_on_embeddings(spark):
    from canvass.llm import ann

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(vectors, 100).toPandas()
    rows = vectors.toPandas()
    points = np.stack(rows.embedding.to_numpy()).astype(float)
    hit = total = 0
    for at in np.flatnonzero(rows.vec_id % 100 == 0):
        scores = points @ points[at]
        scores[at] = -np.inf
        best = set(rows.vec_id[np.lexsort((rows.vec_id, -scores))[:20]])
        hit += len(best & set(got.vec_id[got.query_id == rows.vec_id[at]]))
        total += len(best)
    assert hit / total >= 0.9


def test_memory_is_bounded_by_bytes():
    from canvass.llm import bpe

    memory = bpe.Memory(100)
    for k in range(200):
        memory.turn()
        new = memory.unknown([f"w{k}-{j}" for j in range(20)] + ["long" * 100])
        memory.young.update((x, b"12") for x in new)
        assert "long" * 100 not in memory.old
        assert len(memory.old) <= 130 and len(memory.young) <= 130
    assert memory.unknown(["w199-3"]) == [] and memory.unknown(["w0-0"]) == ["w0-0"]


def test_personal_data_keeps_columns_of_any_name(spark):
    from canvass.llm import pii

    docs = spark.createDataFrame([(1, "mail a@b.cd now", 5, 6, 7, 8)], "doc_id long, text string, __row int, row int, given int, terms int")
    got = pii.personal_data(docs)
    assert got.columns == [*docs.columns, "base", "spans"] and tuple(got.first())[:6] == (1, "mail a@b.cd now", 5, 6, 7, 8)


def test_patterns_that_cross_from_signs_to_white_space():
    import tiktoken

    from canvass.llm import bpe

    ranks = queries.codec().ranks
    assert queries.codec().cut is bpe.chunks
    for pattern in (r"[^\s]+\s*|\s+", r"(\w+)|(\W+)", r".{1,7}|\n"):
        codec = bpe.Codec(ranks, pattern)
        library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        texts = ["one two, three\n\nfour  .", "", "a.\n b" * 50, "é 中\u00a0x"]
        assert codec.cut is not bpe.chunks and list(codec.encode(texts)) == [library.encode_ordinary(t) for t in texts]


CLASH = "fp component_id sig h n k early prefix sketch row shared known found spans phrase place source anchor bucket stretch ids n_tokens kept runs collapsed part nodes words kind given base terms t of pos w seed score predicted held_out rank phrase".split()


def test_columns_of_any_name_change_nothing(spark):
    from canvass.llm import bpe, jaccard, lz_dedup, pii, quality, simhash, suffix_dedup, token_store

    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 120")
    names = [c for c in dict.fromkeys(CLASH) if c not in plain.columns]
    extra = plain.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    codec = queries.codec()

    def stored(df):
        root = token_store.new_root(spark)
        return token_store.read_store(token_store.write_store(df, token_store.LibraryEncoder(queries.definition()), root), root)

    for run, columns in (
        (simhash.near_duplicates, ["doc_id", "fp", "component_id"]), (jaccard.near_duplicates, ["doc_id", "component_id"]), (lz_dedup.substring_dedup, ["doc_id", "n_removed", "kept_sha256"]),
        (suffix_dedup.byte_dedup, ["doc_id", "n_removed", "kept_sha256"]), (lambda d: bpe.round_trip(d, codec), ["doc_id", "ids_sha256"]), (runs.periodic_runs, ["doc_id", "runs", "collapsed"]),
        (lambda d: collocations.collocations(d, least=3), ["lang", "rank", "phrase", "score"]), (lambda d: quality.classify(d, labels), ["doc_id", "score", "predicted"]),
        (pii.personal_data, ["doc_id", "base", "spans"]), (stored, ["doc_id", "start", "ids_crc32"]),
    ):
        one, other = (sorted(map(repr, run(df).select(*columns).collect())) for df in (plain, extra))
        assert one == other and one


def test_very_long_texts(spark):
    from canvass.llm import bpe, chat, simhash

    import tiktoken

    draw = random.Random(2)
    words = [f"word{k}" for k in range(500)]
    long = " ".join(draw.choices(words, k=150_000)) + "x" * 100_000
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, None)], "doc_id long, text string")
    codec = queries.codec()
    library = tiktoken.Encoding("t", pat_str=codec.pattern, mergeable_ranks=codec.ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs, codec).collect()}
    assert got[1].n_tokens == len(library.encode_ordinary(long)) and got[2].decoded_sha256 == hashlib.sha256((long + " end").encode()).hexdigest()
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    turns = spark.createDataFrame([(5, 1, "user", "hi"), (5, 2, "assistant", long), (5, 3, "assistant", "")], "conv_id long, turn long, role string, text string")
    told = chat.read_back(chat.format_conversations(turns, queries.definition())).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) for r in told] == [(5, 3, len(long), hashlib.sha256(long.encode()).hexdigest())]
