"""SimHash fingerprints of sets of hashes, and links between those within a Hamming distance, by a pivot distance table.

Each fingerprint's distances to fixed reference fingerprints are computed once; by the triangle inequality two fingerprints within the
radius differ by at most the radius at every pivot, so a pair with a larger coordinate difference is discarded before its distance is
computed. Pairs to test share three of five bit blocks, which no pair of two differing bits can miss. Blocks that more than BUCKET
fingerprints share are not paired at all: their members link through one-bit neighbours, which is as exact and linear (two fingerprints
within two bits share a neighbour within one bit of both, and all that share one are within two bits of each other).
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import Scratch

RADIUS, BUCKET = 2, 64
#: Bit blocks as (first bit, bits); a pair within two bits agrees on three of them.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_PIECE = 1 << 15


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        cut = np.ascontiguousarray(hashes[at : at + _PIECE], "<u8")
        counts += np.unpackbits(cut.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint, signed: a bit is 1 if over half of the n hashes have it."""
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.dtype("<i8"))[0])


def pivots(count: int = 16) -> list[int]:
    """Reference fingerprints, as signed 64-bit numbers, from a fixed rule."""
    return [xxhash.xxh64_intdigest(str(i), seed=7) - 2**63 for i in range(count)]


def _block_keys(fp: Column) -> Column:
    """The ten choices of three blocks, each as a struct of its number and its bits."""
    keys = []
    for number, chosen in enumerate(itertools.combinations(BLOCKS, 3)):
        bits = sum(((1 << n) - 1) << at for at, n in chosen)
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(bits - (bits >> 63 << 64))).alias("bits")))
    return F.explode(F.array(*keys))


def links(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """prints (fp long, id long), fp distinct -> links (a, b) of ids, enough to connect all within the radius of two bits."""
    if radius > 2:
        raise ValueError("the block choice holds for a radius of at most 2")
    table = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()])
    keyed = prints.select("fp", "id", table.alias("to_pivots"), _block_keys(F.col("fp")).alias("key"))
    keyed = scratch.save("keyed", keyed.select("fp", "id", "to_pivots", "key.choice", "key.bits"))
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("members")).where("members > 1")
    crowd = scratch.save("crowd", keyed.join(sizes, ["choice", "bits"]))
    few = crowd.where(F.col("members") <= bucket)
    left = few.select("choice", "bits", *[F.col(c).alias(f"{c}_a") for c in ("fp", "id", "to_pivots")])
    right = few.select("choice", "bits", *[F.col(c).alias(f"{c}_b") for c in ("fp", "id", "to_pivots")])
    apart = F.greatest(*[F.abs(F.get("to_pivots_a", F.lit(i)) - F.get("to_pivots_b", F.lit(i))) for i in range(len(pivots()))])
    pairs = left.join(right, ["choice", "bits"]).where((F.col("fp_a") < F.col("fp_b")) & (apart <= radius))
    pairs = pairs.where(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius)
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    hot = crowd.where(F.col("members") > bucket).select("fp", "id").distinct().select("id", F.explode(near).alias("near"))
    # At most 65 fingerprints lie within one bit of any number.
    stars = hot.groupBy("near").agg(F.min("id").alias("a"), F.collect_list("id").alias("ids")).where("size(ids) > 1")
    found = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return found.union(stars.select("a", F.explode("ids").alias("b"))).where("a <> b").distinct()
