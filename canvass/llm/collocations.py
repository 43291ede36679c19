"""Phrase collocations of two and three words, from count tries per shard that are merged by prefix range.

Each shard counts its words, pairs and triples in a trie three words deep and serialises it sorted, cut into ranges of its two-word prefixes. The
sorted pieces of one range, from all shards, are merged in one task: nodes of one path become one, with their counts summed. A walk down the merged trie
gives each phrase the counts of its left parts; suffix links (joins of a node with the node of its last words) give those of its right parts.

Words are numbers inside the tries: 64-bit hashes of language and word, so that languages share tries and never a node. The table of
words is checked for two words of one hash, in which case all is counted again with another seed: counts are exact.

A very common word or pair is one node a shard, and ranges are dealt by pairs, so a word that starts very many pairs is spread. Memory: some
FLUSH words of text a task at first (more where one piece of text without a break is longer), then the nodes of a range.

Cases: a null text has no words; a null lang is "und"; pieces without words count nothing; equal rows count each; doc_ids are not looked at, so
null and repeated ones are alike; ties of score and count go to the lesser phrase in byte order; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.common import Scratch
from canvass.llm.spans import U, mix

LEAST, SHARE, TOP, UNKNOWN = 10, 50, 2000, "und"
#: Words of a shard's trie; bytes of text for each range, and least ranges; bytes of one text that are split at a time.
FLUSH, RANGE_BYTES, RANGES, SLICE = 1 << 20, 12 << 20, 16, 1 << 20
#: Parts of a language's phrases that are ranked on their own first.
DEALT = 32
#: A-Z to lower case, piece ends (. , ; : ! ? and 0x0A to 0x0D) to a line feed, tab to a space.
_SIMPLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))


def _slices(data: bytes) -> Iterator[bytes]:
    """Parts of a text that end at a piece's end, or else at a word's."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):
            cut = data.rfind(b"\n", at, end)
            cut = cut if cut >= 0 else data.rfind(b" ", at, end)
            if cut < 0:
                later = [x for x in (data.find(b"\n", end), data.find(b" ", end)) if x >= 0]
                cut = min(later) if later else len(data) - 1
            end = cut + 1
        yield data[at:end]
        at = end


class Shard:
    """Words of texts, until they become a trie."""

    def __init__(self):
        number = itertools.count()
        self.ids: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__))
        self.words, self.pieces, self.held, self.piece = [], [], 0, 0

    def add(self, lang: str, data: bytes) -> bool:
        """Adds a slice; whether it ended a piece."""
        words = data.split()
        if words:
            signs = np.frombuffer(data, np.uint8)
            apart = (signs == 32) | (signs == 10)
            first = np.flatnonzero(~apart & np.concatenate([[True], apart[:-1]]))
            self.words.append(np.fromiter(map(self.ids[lang].__getitem__, words), np.int32, len(words)))
            self.pieces.append((self.piece + np.searchsorted(np.flatnonzero(signs == 10), first)).astype(np.int32))
            self.held += len(words)
        self.piece += data.count(b"\n")
        return data.endswith(b"\n")

    def vocabulary(self, seed: int, bits: int = 64) -> tuple[list[tuple[bytes, bytes]], np.ndarray]:
        """(language, word) and their hashes, by number."""
        size = sum(map(len, self.ids.values()))
        of, hashes = [(b"", b"")] * size, np.zeros(size, np.uint64)
        for lang, own in self.ids.items():
            code = lang.encode("utf-8", "surrogatepass")
            start = xxhash.xxh64_intdigest(code, seed)
            for word, number in own.items():
                of[number] = (code, word)
                hashes[number] = xxhash.xxh64_intdigest(word, start)
        return of, hashes >> U(64 - bits)


def _ranges(a: np.ndarray, b: np.ndarray, ranges: int) -> np.ndarray:
    """The range of the prefix of two words."""
    return (mix(a + mix(b)) % U(ranges)).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, each after its size and width, compressed."""
    return zstandard.compress(b"".join(y for x in arrays for y in (len(x).to_bytes(7, "little"), bytes([x.itemsize]), x.tobytes())), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at, data = [], 0, zstandard.decompress(data)
    while at < len(data):
        n, width = int.from_bytes(data[at : at + 7], "little"), data[at + 7]
        out.append(np.frombuffer(data, f"<u{width}", n, at + 8))
        at += 8 + n * width
    return out


def serialised(words: np.ndarray, pieces: np.ndarray, hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """Words by number and their pieces -> (range, the trie's nodes of that range: hashes, pairs, their counts and children, last words, their counts)."""
    order = np.argsort(hashes)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    words, hashes, size = number[words], hashes[order], len(order)  # numbers follow the hashes from here on
    pair_at = np.flatnonzero(pieces[:-1] == pieces[1:])
    pairs, of, pair_n = np.unique(words[pair_at] * size + words[pair_at + 1], return_inverse=True, return_counts=True)
    two = np.flatnonzero(np.diff(pair_at) == 1)  # pairs followed by one that starts a word later
    threes, three_n = np.unique(of[two] * size + words[pair_at[two] + 2], return_counts=True)
    del words, pair_at, of, two
    parent, last = threes // size, threes % size
    first, second = pairs // size, pairs % size
    del threes, pairs
    children = np.bincount(parent, minlength=len(first))
    where = _ranges(hashes[first], hashes[second], ranges)
    by, three_by = np.argsort(where, kind="stable"), np.argsort(where[parent], kind="stable")
    kinds = np.unique(where)
    low, high = (np.searchsorted(where[by], kinds, x) for x in ("left", "right"))
    three_low, three_high = (np.searchsorted(where[parent[three_by]], kinds, x) for x in ("left", "right"))
    for k, kind in enumerate(kinds.tolist()):
        own, under = by[low[k] : high[k]], three_by[three_low[k] : three_high[k]]
        used, codes = np.unique(np.concatenate([first[own], second[own], last[under]]), return_inverse=True)
        n = len(own)
        yield kind, _pack(hashes[used], *map(_narrow, (codes[:n], codes[n : 2 * n], pair_n[own], children[own], codes[2 * n :], three_n[under])))


def merged(pieces: list[bytes], least: int) -> list[np.ndarray]:
    """Sorted pieces of one range -> columns (first, second, last or 0, is of three words, count, left, longer) of the nodes of at least that count.

    left: the count of the first two words of three; longer: the greatest count, if it is least or more, of a triple that starts with the pair.
    """
    parts = [_unpack(x) for x in pieces]
    hashes, codes = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    size, at = len(hashes), np.cumsum([0, *[len(x[0]) for x in parts]])
    own = [codes[a:b] for a, b in itertools.pairwise(at.tolist())]
    keys = np.concatenate([c[x[1]] * size + c[x[2]] for c, x in zip(own, parts, strict=True)])
    # Keys are sorted within each piece, which a stable sort merges.
    pairs, of, pair_n = _summed(keys, np.concatenate([x[3] for x in parts]))
    keys = np.repeat(of, np.concatenate([x[4] for x in parts]).astype(np.int64))
    keys *= size
    keys += np.concatenate([c[x[5]] for c, x in zip(own, parts, strict=True)])
    counts = np.concatenate([x[6] for x in parts])
    del parts, own, codes, of
    threes, _, three_n = _summed(keys, counts)
    del keys, counts
    often = three_n >= least
    threes, three_n = threes[often], three_n[often]
    parent, last = threes // size, threes % size
    longer = np.zeros(len(pairs), np.int64)
    np.maximum.at(longer, parent, three_n)
    kept = np.flatnonzero(pair_n >= least)
    joined = lambda two, three: np.concatenate([two, three])
    above = np.concatenate([kept, parent])
    return [
        hashes[pairs[above] // size], hashes[pairs[above] % size], joined(np.zeros(len(kept), np.uint64), hashes[last]), joined(np.zeros(len(kept), bool), np.ones(len(last), bool)),
        joined(pair_n[kept], three_n), joined(np.zeros(len(kept), np.int64), pair_n[parent]), joined(longer[kept], np.zeros(len(last), np.int64)),
    ]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the number of each given key among them, and the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.argsort(keys, kind="stable")
    fresh = np.concatenate([[True], np.diff(keys[by]) != 0])
    of = np.empty(len(keys), np.int64)
    of[by] = np.cumsum(fresh) - 1
    return keys[by][fresh], of, np.add.reduceat(counts[by].astype(np.int64), np.flatnonzero(fresh))


def _texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _narrow(np.fromiter(map(len, texts), np.int64, len(texts))), np.frombuffer(b"".join(texts), np.uint8)


def _cut(sizes: np.ndarray, data: np.ndarray) -> list[bytes]:
    ends, whole = np.cumsum(sizes, dtype=np.int64).tolist(), data.tobytes()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def listed(of: list[tuple[bytes, bytes]], hashes: np.ndarray, counts: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """A shard's words -> (range, hashes, counts and texts of its words)."""
    where = (mix(hashes) % U(ranges)).astype(np.int64)
    by = np.argsort(where, kind="stable")
    kinds, first = np.unique(where[by], return_index=True)
    for kind, own in zip(kinds.tolist(), np.split(by, first[1:]), strict=True):
        langs, words = zip(*map(of.__getitem__, own.tolist()), strict=True)
        yield kind, _pack(hashes[own], _narrow(counts[own]), *_texts(langs), *_texts(words))


def told(pieces: list[bytes]) -> tuple[dict[int, list], bool]:
    """Pieces of one range's words -> by hash [language, word, count], and whether two words share a hash."""
    found: dict[int, list] = {}
    clash = False
    for piece in pieces:
        hashes, counts, *texts = _unpack(piece)
        for h, n, lang, word in zip(hashes.tolist(), counts.tolist(), _cut(*texts[:2]), _cut(*texts[2:]), strict=True):
            if (held := found.get(h)) is None:
                found[h] = [lang, word, n]
            else:
                held[2] += n
                clash = clash or held[0] != lang or held[1] != word
    return found, clash


_TRIES = "part long, nodes binary, words binary"


def _trie_rows(ranges: int, seed: int, flush: int = FLUSH, bits: int = 64):
    def flushed(shard: Shard) -> Iterator[pa.RecordBatch]:
        if not shard.held:
            return
        of, hashes = shard.vocabulary(seed, bits)
        words, pieces = np.concatenate(shard.words), np.concatenate(shard.pieces)
        shard.ids, shard.words, shard.pieces = {}, [], []
        for part, known in listed(of, hashes, np.bincount(words, minlength=len(of)), ranges):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.nulls(1, pa.binary()), pa.array([known])], names=["part", "nodes", "words"])
        for part, nodes in serialised(words, pieces, hashes, ranges):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([nodes]), pa.nulls(1, pa.binary())], names=["part", "nodes", "words"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                for data in _slices((text.as_py() or "").encode("utf-8", "surrogatepass").translate(_SIMPLE)):
                    if shard.add(lang, data) and shard.held >= flush:
                        yield from flushed(shard)
                        shard = Shard()
                shard.piece += 1
                if shard.held >= flush:
                    yield from flushed(shard)
                    shard = Shard()
        yield from flushed(shard)

    return rows


NODE, WORD, TOTAL, CLASH = range(4)
#: Rows of four kinds: frequent nodes (h1 to longer), frequent words (h1, lang, word, a), words in all of a language (lang, a), and a sign that two words share a hash.
_MERGED = "kind int, h1 long, h2 long, h3 long, three boolean, a long, left long, longer long, lang string, word string"


def _merged_rows(least: int):
    shape = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]]) for x in _MERGED.split(", ")])

    def batch(kind: int, n: int, **columns) -> pa.RecordBatch:
        arrays = {"kind": np.full(n, kind, np.int32)} | columns
        return pa.RecordBatch.from_arrays([pa.array(arrays[f.name], f.type) if f.name in arrays else pa.nulls(n, f.type) for f in shape], schema=shape)

    def emit(nodes: list[bytes], words: list[bytes]) -> Iterator[pa.RecordBatch]:
        if nodes:
            columns = merged(nodes, least)
            yield batch(NODE, len(columns[0]), **{k: x.view(np.int64) if x.dtype == np.uint64 else x for k, x in zip(("h1", "h2", "h3", "three", "a", "left", "longer"), columns, strict=True)})
        found, clash = told(words)
        if clash:
            yield batch(CLASH, 1)
        totals: dict[bytes, int] = defaultdict(int)
        for lang, _, n in found.values():
            totals[lang] += n
        text = lambda xs: [x.decode("utf-8", "surrogatepass") for x in xs]
        yield batch(TOTAL, len(totals), lang=text(totals), a=list(totals.values()))
        often = [(h, *x) for h, x in found.items() if x[2] >= least]
        if often:
            hashes, langs, kinds, counts = zip(*often, strict=True)
            yield batch(WORD, len(often), h1=np.array(hashes, np.uint64).view(np.int64), lang=text(langs), word=text(kinds), a=counts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition is a range."""
        nodes, words = [], []
        for given in batches:
            for node, word in zip(given.column(0), given.column(1), strict=True):
                (nodes if node.is_valid else words).append((node if node.is_valid else word).as_py())
        if nodes or words:
            yield from emit(nodes, words)

    return rows


def _score(a, left, right):
    """floor(1000000 a a / (left right)); decimals hold products past 64 bits."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP, flush: int = FLUSH, bits: int = 64) -> DataFrame:
    """docs -> (lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words.

    a, l and r count the phrase and its parts at the cut of lowest score, n the language's words. Phrases of fewer than least occurrences are no
    candidates; a pair goes where a candidate of three words that holds it has share percent of its count or more. flush: words of a shard's trie;
    bits: of a word's hash. Neither changes the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    ranges = max(RANGES, (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    for seed in itertools.count():
        pieces = own.mapInArrow(_trie_rows(ranges, seed, flush, bits), _TRIES).repartitionById(int(ranges), F.col("part").cast("int"))
        found = scratch.save(f"merged{seed}", pieces.select("nodes", "words").mapInArrow(_merged_rows(least), _MERGED))
        if found.where(F.col("kind") == CLASH).isEmpty():
            break
        scratch.drop(f"merged{seed}")
    nodes, often = found.where(F.col("kind") == NODE), found.where(F.col("kind") == WORD).select(F.col("h1").alias("h"), F.col("a").alias("f"), "lang", "word")
    totals = found.where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("a").alias("n"))
    two, three = nodes.where("not three"), nodes.where("three")
    # Suffix links: from three words to the last two.
    linked = scratch.save("linked", three.join(two.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("right")), ["h2", "h3"]))
    ending = linked.groupBy(F.col("h2").alias("h1"), F.col("h3").alias("h2")).agg(F.max("a").alias("ending"))
    held = F.greatest("longer", F.coalesce("ending", F.lit(0)))
    two = two.join(ending, ["h1", "h2"], "left").where(~((held > 0) & (100 * held >= share * F.col("a"))))
    columns = ["h1", "h2", F.col("h3").alias("h_last"), "three", "a", "left", "right"]
    phrases = linked.select(*columns).union(two.select("h1", "h2", F.col("h2").alias("h_last"), "three", "a", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right")))
    named = lambda key, name: often.select(F.col("h").alias(key), F.col("word").alias(f"word_{name}"), F.col("f").alias(f"f_{name}"))
    found = phrases.join(named("h1", "first").join(often.select(F.col("h").alias("h1"), "lang"), "h1"), "h1").join(named("h2", "middle"), "h2").join(named("h_last", "last"), "h_last")
    one, other = F.col("f_first"), F.col("f_last")
    cut = lambda k, left, right: F.struct(_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
    lowest = F.when(F.col("three"), F.least(cut(1, one, F.col("right")), cut(2, F.col("left"), other))).otherwise(cut(1, one, other))
    phrase = F.when(F.col("three"), F.concat_ws(" ", "word_first", "word_middle", "word_last")).otherwise(F.concat_ws(" ", "word_first", "word_last"))
    scored = found.select("lang", phrase.alias("phrase"), "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # The best of each part of a language's phrases first, so that no task holds all of them.
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    dealt = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    few = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
