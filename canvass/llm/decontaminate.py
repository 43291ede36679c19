r"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

Tokens are lower-cased runs of letters and digits. Each of the fixed masks of SPAN tokens keeps six positions and
ignores the others, so a hash of the kept tokens survives substitutions at the ignored ones. The masks are the pairs of four groups
of three positions: any two substitutions in SPAN tokens leave a pair untouched, and so do any three in 15 or 16 tokens at some
offset, so that no overlap of the threshold below is missed. Hashes of all benchmark
positions are joined with those of all training positions. Each hit fixes an alignment of an item with a document, which is verified
around the hit: a document is contaminated if, in some WINDOW aligned tokens (all of a shorter
item), at least SIMILARITY of the tokens are equal.

All places of all documents are tested against a set of bits of the benchmark's seeds, of bounded size; those few that may have one are joined with the
seeds, which are broadcast where their bytes are few. Documents are cut into overlapping parts of PART tokens, so memory does not follow the longest text.

Items of fewer than SPAN tokens have no room for a mask. Their seed is a hash of the whole item, looked up for all runs of as many
tokens in the documents, in the same pass; of 5 tokens or more, further hashes each leave out one position, as a substitution in 5 to 9 tokens, or two, as in
10 and 11, keeps SIMILARITY. Runs of scripts without spaces between words are cut into single characters, each a token.

Cases: null and empty texts, and items without tokens, match nothing; equal items each count; equal documents
each match; rows with a null doc_id or item_id match nothing; rows of one doc_id are judged together; an empty table on either side gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import Scratch, broadcast_by_bytes

SPAN, WINDOW, SIMILARITY = 12, 16, 0.8
#: Kept positions of each mask within SPAN tokens.
MASKS = tuple(tuple(sorted(a + b)) for a, b in itertools.combinations(((0, 10, 11), (1, 4, 8), (2, 7, 9), (3, 5, 6)), 2))
#: Tokens of a document's parts; most longs of the seeds' bits, as a power of two (8 MB).
PART, MOST_WORDS = 4096, 20


#: Scripts without spaces between words.
UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))


#: A cheap test that every text with such a script meets: a character from their lowest block on, general punctuation and signs aside.
_PERHAPS_UNSPACED = r"[\u0E00-\u1FFF\u2E80-\x{10FFFF}]"


def tokens(text: Column) -> Column:
    between = r"[^\p{L}\p{N}]+"
    # Splitting between two characters as well, where either is of such a script.
    closer = rf"{between}|(?<=[{UNSPACED}])(?!\p{{M}})|(?=[{UNSPACED}&&\p{{L}}])"
    lower = F.lower(text)
    return F.filter(F.when(text.rlike(_PERHAPS_UNSPACED), F.split(lower, closer)).otherwise(F.split(lower, between)), lambda x: x != "")


def hashed_tokens(text: Column) -> Column:
    return F.transform(tokens(text), lambda x: F.xxhash64(x))


def left_out(size: int, similarity: float = SIMILARITY) -> list[tuple[int, ...]]:
    """The choices of positions that may differ in an item of so many tokens: all that similarity allows at once."""
    allowed = next(k for k in range(size, -1, -1) if (size - k) / size >= similarity)
    return list(itertools.combinations(range(size), allowed))


def _places(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, t: token hashes) -> (key, of: tokens in all, pos, w: the SPAN tokens from there on as t0, t1, ..., NULL beyond the end)."""
    starts = F.sequence(F.lit(0), F.size("t") - 1, F.lit(PART))
    parts = rows.where(F.size("t") > 0).select(key, F.size("t").alias("of"), F.explode(F.transform(starts, lambda s: F.struct(s.alias("base"), F.slice("t", s + 1, F.lit(PART + SPAN - 1)).alias("part")))).alias("p"))
    parts = parts.select(key, "of", "p.base", "p.part", F.least(F.lit(PART), F.col("of") - F.col("p.base")).alias("count"))
    shifted = F.arrays_zip(*[F.slice("part", F.lit(i + 1), F.col("count")).alias(f"t{i}") for i in range(SPAN)])
    return parts.select(key, "of", "base", F.posexplode(shifted).alias("at", "w")).select(key, "of", (F.col("base") + F.col("at")).alias("pos"), "w")


def _keys(sizes: list[int], similarity: float) -> list[tuple[int, Column]]:
    """(tokens needed, hash of a place's tokens) of each mask and, for short items of each size, of each choice of positions left out; a key's kind is its number."""
    token = lambda i: F.col(f"w.t{i}")
    out = [(SPAN, F.xxhash64(F.lit(n), *[token(i) for i in mask])) for n, mask in enumerate(MASKS)]
    for size in sizes:
        out += [(size, F.xxhash64(F.lit(size), F.lit(n), *[token(i) for i in range(size) if i not in gone])) for n, gone in enumerate(left_out(size, similarity))]
    return out


def _bits(seeds: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Bits of seeds as one row with an array of longs, 16 bits or more a seed as far as MOST_WORDS goes."""
    words = 1 << min(MOST_WORDS, max(8, (n // 4).bit_length()))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("seed", 40).bitwiseAND(F.lit(63)).cast("int"))
    held = seeds.groupBy(F.col("seed").bitwiseAND(F.lit(words - 1)).alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = seeds.sparkSession.range(words).join(held, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits")), words


def _perhaps(seed: Column, held: Column, words: int) -> Column:
    """Whether the seed may be one of those whose bits are held; never false for one that is."""
    word = F.get(held, seed.bitwiseAND(F.lit(words - 1)).cast("int"))
    return F.call_function("shiftright", word, F.shiftrightunsigned(seed, 40).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> (doc_id, item_id, similarity) of contaminated documents, once a pair."""
    scratch = Scratch(docs.sparkSession, "seeds")
    docs = docs.select(F.col("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select("item_id", hashed_tokens(F.col("text")).alias("t")).where("item_id is not null").where(F.size("t") > 0)
    items = scratch.save("items", items)
    sizes = sorted(r.size for r in items.where(F.size("t") < SPAN).select(F.size("t").alias("size")).distinct().collect())  # under SPAN
    keys = _keys(sizes, similarity)
    # A long item has seeds at each of its places, a short one at its first alone.
    own = [F.when((F.col("of") >= SPAN) & F.col(f"w.t{SPAN - 1}").isNotNull() if needed == SPAN else (F.col("of") == needed) & (F.col("pos") == 0), seed) for needed, seed in keys]
    seeds = _places(items, "item_id").select("item_id", F.col("pos").alias("item_pos"), F.posexplode(F.array(*own)).alias("kind", "seed"))
    seeds = scratch.save("seeds", seeds.where("seed is not null"))
    held, words = _bits(seeds, seeds.count())
    held = scratch.save("bits", held).scalar()
    # Of all places and kinds those go on whose bits say that they may be a seed; the join with the seeds tells.
    every = [F.when(F.col(f"w.t{needed - 1}").isNotNull(), seed) for needed, seed in keys]
    hashed = docs.select("doc_id", hashed_tokens(F.col("text")).alias("t"))
    found = _places(hashed, "doc_id").select("doc_id", "pos", F.posexplode(F.array(*every)).alias("kind", "seed"))
    hits = found.where(F.col("seed").isNotNull() & _perhaps(F.col("seed"), held, words)).join(broadcast_by_bytes(seeds), ["kind", "seed"])
    hits = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
    hits = scratch.save("hits", hits.agg(F.min("item_pos").alias("first"), F.max("item_pos").alias("last")))
    wanted = scratch.save("wanted", hits.select("doc_id").distinct())
    suspects = docs.join(broadcast_by_bytes(wanted), "doc_id", "left_semi").select("doc_id", hashed_tokens(F.col("text")).alias("t"))
    pairs = hits.join(suspects, "doc_id").join(items.withColumnRenamed("t", "b"), "item_id")
    # The aligned tokens from a window before the first hit to a window after the last, as 0 and 1.
    low = F.greatest(F.col("first") - WINDOW, F.lit(0), -F.col("shift"))
    high = F.least(F.col("last") + SPAN + WINDOW, F.size("b"), F.size("t") - F.col("shift"))
    pairs = pairs.select("doc_id", "item_id", F.size("b").alias("of"), F.slice("b", low + 1, high - low).alias("b"), F.slice("t", low + F.col("shift") + 1, high - low).alias("t"))
    same = F.zip_with("b", "t", lambda x, y: (x == y).cast("int"))
    width = F.least(F.lit(WINDOW), F.col("of"))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("width") + 1), lambda s: F.aggregate(F.slice("same", s, F.col("width")), F.lit(0), lambda a, x: a + x))
    scored = pairs.select("doc_id", "item_id", same.alias("same"), width.alias("width")).where(F.size("same") >= F.col("width"))
    scored = scored.select("doc_id", "item_id", (F.array_max(sums) / F.col("width")).alias("similarity")).where(F.col("similarity") >= similarity)
    return scored.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
