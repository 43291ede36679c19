"""Byte-level BPE from public rank files: encoding with a two-tier lookup, and decoding.

Tier one resolves a whole pre-token that is in the vocabulary through a minimal perfect hash, with the stored bytes
compared. Tier two merges the rest: byte parts form a linked list, and a heap gives the adjacent pair
of least rank, leftmost on ties, until no pair has a rank. In front of both tiers stands a memory of chunks of text already resolved
in this worker, of bounded bytes, since words recur; a chunk is cut where a white-space character follows a visible one, where no
pre-token crosses that place (a pattern is tried for it; with another one whole texts are split).

Cases: null is the empty text, which has no ids; special tokens are ordinary text; texts of any length
are worked on whole; a rank file must hold all 256 single bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.llm.mph import MinimalPerfectHash

#: Chunks in each of a memory's two generations in every worker (more are faster); chunks of texts that are looked up together; rows of a batch that goes back.
REMEMBERED, TOGETHER, ROWS = 100_000, 50_000, 512
#: Characters of a chunk beyond which it is not remembered.
LONG = 64
# 0x1C to 0x1F are white space for Python alone.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def chunks(text: str) -> list[str]:
    """Parts of a text, in order, none of which a pre-token leaves."""
    parts = []
    for number, line in enumerate(text.split("\n")):
        words = line.split()
        if not words or " ".join(words) != line:  # white space that is not alone
            return _CHUNK.findall(text)
        at = len(parts) + (number > 0)
        parts += ["\n"] * (number > 0) + [" " + x for x in words]
        parts[at] = words[0]
    return parts


def _whole(text: str) -> list[str]:
    return [text] if text else []


class Memory:
    """Packed ids of chunks, in two generations of ``size`` chunks at most beside what one group of texts adds.

    A full generation becomes the old one, whose chunks are kept only if they are met again. Chunks of over LONG characters are known for their
    group alone, so that the bytes of a generation are bounded as well: some 0.2 kB a chunk, 0.6 kB at most.
    """

    def __init__(self, size: int = REMEMBERED):
        self.size, self.young, self.old, self.long = size, {}, {}, []

    def turn(self) -> None:
        """Between two groups of texts."""
        for chunk in self.long:
            self.young.pop(chunk, None)
        self.long = []
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young

    def unknown(self, kinds: Iterable[str]) -> list[str]:
        """The chunks to resolve; the others are in ``young`` afterwards."""
        young, old, new = self.young, self.old, []
        for x in kinds:
            if x not in young:
                if (found := old.get(x)) is None:
                    new.append(x)
                    if len(x) > LONG:
                        self.long.append(x)
                else:
                    young[x] = found
        return new


#: Visible signs and white space that a pattern is tried with.
_VISIBLE, _SPACES = "aA1.'_-é中🙂\x1c", " \t\n\r\x0b\u00a0\u2003"


def stays_in_chunks(split: Callable[[str], list[str]]) -> bool:
    """Whether no pre-token of a pattern goes from a visible character to white space, on short texts of all kinds."""
    texts = (a + w + b for a in _VISIBLE for w in _SPACES for b in ("", "a", ".", " ", "\n", w + "a"))
    return not any(re.search(r"[\S\x1c-\x1f][^\S\x1c-\x1f]", x) for text in texts for x in split(text))


def grouped(texts: Iterable[str | None], together: int = TOGETHER, cut: Callable[[str], list[str]] = chunks) -> Iterator[list[list[str]]]:
    """Chunks of texts, in groups of about ``together`` chunks."""
    group, waiting = [], 0
    for text in texts:
        group.append(cut(text or ""))
        waiting += len(group[-1])
        if waiting >= together:
            yield group
            group, waiting = [], 0
    yield group


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks, self.pattern, self.remembered = ranks, pattern, remembered
        tokens = list(ranks)
        keys = self._keys(tokens)
        self.hash = MinimalPerfectHash.build(keys)
        number = self.hash.lookup(keys)
        self.stored: list[bytes] = [b""] * len(tokens)
        self.ids = [0] * len(tokens)
        for token, at in zip(tokens, number.tolist(), strict=True):
            self.stored[at], self.ids[at] = token, ranks[token]
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self._prepare()

    def _prepare(self) -> None:
        compiled = regex.compile(self.pattern)
        self.split = (lambda text: [m[0] for m in compiled.finditer(text)]) if compiled.groups else compiled.findall
        self.memory, self.text_of = Memory(self.remembered), list(map(str, range(self.size)))
        self.cut = chunks if stays_in_chunks(self.split) else _whole
        self.code = "H" if self.size <= 1 << 16 else "I"  # unsigned, of two or four bytes

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memory", "text_of", "cut")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._prepare()

    @staticmethod
    def _keys(tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))

    def whole(self, tokens: list[bytes]) -> list[int]:
        """Ids of tokens that are in the vocabulary, -1 of others."""
        if not tokens:
            return []
        number, ids, stored = self.hash.lookup(self._keys(tokens)).tolist(), self.ids, self.stored
        return [ids[at] if at >= 0 and stored[at] == token else -1 for token, at in zip(tokens, number, strict=True)]

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token by repeated merges of the pair of least rank."""
        get, n = self.ranks.get, len(token)
        width = n.bit_length()
        mask = (1 << width) - 1
        # A part is known by its first byte; end has its end, or 0 once it is merged into the part before.
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank << 2 * width) | (i << width) | (i + 2) for i in range(n - 1) if (rank := get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            pair = heapq.heappop(heap)
            i, stop = (pair >> width) & mask, pair & mask
            j = end[i]
            if not 0 < j < n or end[j] != stop:
                continue  # one of the two has been merged meanwhile
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := get(token[i : end[stop]])) is not None:
                    heapq.heappush(heap, (rank << 2 * width) | (i << width) | end[stop])
            if (k := before[i]) >= 0 and (rank := get(token[k:stop])) is not None:
                heapq.heappush(heap, (rank << 2 * width) | (k << width) | stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[token[i : end[i]]])
            i = end[i]
        return out

    def learn(self, found: list[str]) -> None:
        """Remember the ids of new chunks and of the pre-tokens in them."""
        split, known = list(map(self.split, found)), self.memory.young
        new = [x for x in dict.fromkeys(chain.from_iterable(split)) if x not in known]
        self.memory.long += [x for x in new if len(x) > LONG]
        tokens = [x.encode("utf-8", "surrogatepass") for x in new]
        for text, token, at in zip(new, tokens, self.whole(tokens), strict=True):
            known[text] = array(self.code, (at,) if at >= 0 else self.merge(token)).tobytes()
        for chunk, parts in zip(found, split, strict=True):
            if len(parts) > 1:
                known[chunk] = b"".join(map(known.__getitem__, parts))

    def encode_packed(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text. Chunks that are new in a group of texts are looked up together."""
        for group in grouped(texts) if self.cut is chunks else grouped(texts, cut=self.cut):
            self.memory.turn()
            self.learn(self.memory.unknown(set(chain.from_iterable(group))))
            known = self.memory.young.__getitem__
            for parts in group:
                yield np.frombuffer(b"".join(map(known, parts)), self.code)

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        for ids in self.encode_packed(texts):
            yield ids.tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.text_of.__getitem__, ids)).encode()).hexdigest()


def round_trip(docs: DataFrame, codec: Codec, text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 added and, if asked for, ids, in place of columns of those names; text itself is left out."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    keep = [c for c in docs.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    added = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                out: list[list] = [[] for _ in added]
                for packed in codec.encode_packed(x.as_py() for x in batch.column(batch.num_columns - 1)):
                    ids = packed.tolist()
                    for values, value in zip(out, (len(ids), codec.digest(ids), hashlib.sha256(codec.decode(ids)).hexdigest()), strict=False):
                        values.append(value)
                    if with_ids:
                        out[-1].append(packed.astype(np.int32))
                new_columns = [pa.array(v, t) for v, (_, t) in zip(out, added, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new_columns], names=[*keep, *[n for n, _ in added]])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    shape = kept.schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *([("ids", "array<int>")] * with_ids)):
        shape = shape.add(name, T.ArrayType(T.IntegerType()) if kind == "array<int>" else kind)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text)).mapInArrow(rows, shape)
