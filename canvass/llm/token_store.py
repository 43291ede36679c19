"""Token-id shards with a minimal perfect hash index.

A shard is a pair of files in the shared folder: ``.ids`` holds the raw little-endian ids of its documents one after another
(two bytes each where the vocabulary allows, else four), and ``.index`` is a NumPy archive with the minimal perfect hash of the shard's
document keys: under a key's number stand its fingerprint and its first entry; entries (key, first id, ids) are
in ascending key order. A key is found in constant time and a key that is absent is told by its fingerprint.
Shards are key ranges in ascending order, of a bounded size: a task goes on in a new one. Keyed access reads the index and, of the ids, the document's alone. Each task writes under a name of its own and renames at the
end, so a task that is run again leaves one whole file.

Cases: null and empty texts have the end id alone; rows of one doc_id stay together, in order of their texts, and a lookup
gives all of them; a null doc_id comes first; an empty table gives no shard; further columns are ignored.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from canvass.llm.bpe import Memory, grouped
from canvass.llm.common import shared_dir
from canvass.llm.mph import MinimalPerfectHash
from canvass.llm.spans import U, mix

NULL_KEY = -(2**63)
#: Bytes of ids from which a task goes on in a new shard.
SHARD_BYTES = 128 << 20
#: New chunks that go to the library as one text; chunks in each generation of the memory.
TOGETHER, REMEMBERED = 1024, 600_000
_SIGNS = ",.;:!?"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class LibraryEncoder:
    """Encodes with the tokenizers library, each distinct chunk of text once, to packed little-endian ids.

    Valid for byte-level vocabularies whose pre-tokens do not cross from a visible character to white space (the definition is
    looked at for that; with another pre-tokenizer or a normalizer whole texts go to the library), and
    whose added tokens hold no white space: then a text's ids are those of its chunks, one after another. New chunks go to the
    library many at a time, as one text, whose ids are dealt to the chunks by their bytes.
    """

    def __init__(self, definition: str):
        self.definition = definition
        self._prepare()

    def _prepare(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library, self.memory = Tokenizer.from_str(self.definition), Memory(REMEMBERED)
        made = json.loads(self.definition)
        self.by_chunks = made.get("normalizer") is None and made["pre_tokenizer"] == made["pre_tokenizer"] | _BYTE_LEVEL
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        if any(any(c.isspace() for c in x) for x in added.values()):
            raise ValueError("an added token holds white space")
        size = self.library.get_vocab_size()
        self.dtype = "<u4" if size > 2**16 else "<u2"
        # A byte-level token has one character for each of its bytes.
        self.bytes_of = np.array([len(added.get(i, "").encode()) or len(self.library.id_to_token(i) or "") for i in range(size)])

    def __getstate__(self):
        return {"definition": self.definition}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._prepare()

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        if not self.by_chunks:
            for text in texts:
                yield self.pack(self.library.encode(text or "", add_special_tokens=False).ids)
            return
        for group in grouped(texts):
            self.memory.turn()
            whole = self.memory.unknown(set(chain.from_iterable(group)))
            # A sign after a letter is a pre-token of its own.
            ended = [x for x in whole if x[-1] in _SIGNS and x[-2:-1].isalpha()]
            new = self.memory.unknown(dict.fromkeys(chain(set(whole).difference(ended), (x[:-1] for x in ended), _SIGNS)))
            # A chunk from a space to a visible character is encoded alike beside others.
            joint, alone = [], []
            for x in new:
                (joint if x[0] == " " and not x[-1].isspace() else alone).append(x)
            for at in range(0, len(joint), TOGETHER):
                self._learn(joint[at : at + TOGETHER])
            for chunk, found in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False), strict=True):
                self.memory.young[chunk] = self.pack(found.ids)
            known = self.memory.young.__getitem__
            self.memory.young.update((x, known(x[:-1]) + known(x[-1])) for x in ended)
            for parts in group:
                yield b"".join(map(known, parts))

    def _learn(self, part: list[str]) -> None:
        ids = np.array(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids)
        reached = np.cumsum(self.bytes_of[ids])
        wanted = np.cumsum([len(x.encode("utf-8", "surrogatepass")) for x in part])
        stop = np.searchsorted(reached, wanted) + 1
        if (reached[stop - 1] != wanted).any():
            raise ValueError("the vocabulary is not byte-level")
        packed, size, before, known = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize, 0, self.memory.young
        for chunk, end in zip(part, (stop * size).tolist(), strict=True):
            known[chunk] = packed[before:end]
            before = end


def _key_hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = mix(keys.view(np.uint64) + U(0x632BE59BD9B4E019))
    return hashes, (mix(hashes ^ U(0xD6E8FEB86659FD93)) >> U(32)).astype(np.uint32)


def build_index(keys: np.ndarray, first: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """keys ascending, of each entry -> the arrays of an index file."""
    distinct, entry = np.unique(keys, return_index=True)
    hashes, prints = _key_hashes(distinct)
    found = MinimalPerfectHash.build(hashes)
    number = found.lookup(hashes)
    stored, entries = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int64)
    stored[number], entries[number] = prints, entry
    return {"sizes": np.array(found.sizes, np.int64), "bits": np.packbits(found.bits), "print": stored, "entry": entries, "key": keys, "first": first, "count": count}


class Shard:
    """Keyed access to one shard."""

    def __init__(self, index: bytes, payload: bytes, dtype: str):
        held = np.load(io.BytesIO(index))
        self.payload, self.dtype = payload, np.dtype(dtype)
        self.key, self.first, self.count = held["key"], held["first"], held["count"]
        sizes = held["sizes"].tolist()
        bits = np.unpackbits(held["bits"], count=sum(sizes)).astype(bool)
        self.hash = MinimalPerfectHash(sizes, bits, np.cumsum(bits) - bits)
        self.print, self.entry = held["print"], held["entry"]

    def entries(self, keys: np.ndarray) -> np.ndarray:
        """First entry of each key; -1 for keys that the shard doesn't have."""
        hashes, prints = _key_hashes(keys)
        number = self.hash.lookup(hashes)
        safe = np.maximum(number, 0)
        return np.where((number >= 0) & (self.print[safe] == prints), self.entry[safe], -1) if len(self.print) else number

    def get(self, entry: int) -> np.ndarray:
        size = self.dtype.itemsize
        return np.frombuffer(self.payload, self.dtype, int(self.count[entry]), int(self.first[entry]) * size)


def _qualified(spark: SparkSession, root: str) -> str:
    """The folder with its scheme, as Hadoop resolves it: a path without one is in the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _ShardWriter:
    """One shard while it is written."""

    def __init__(self, store: fs.FileSystem, base: str, name: str):
        self.store, self.base, self.name, self.keys, self.counts = store, base, name, [], []
        self.out = store.open_output_stream(f"{base}/{name}.part")

    def add(self, key: int, ids: bytes, count: int) -> None:
        self.keys.append(key)
        self.counts.append(count)
        self.out.write(ids)

    def close(self) -> tuple[str, int, int, int, int]:
        self.out.close()
        counted, held = np.array(self.counts, np.int64), io.BytesIO()
        np.savez(held, **build_index(np.array(self.keys, np.int64), np.cumsum(counted) - counted, counted))
        with self.store.open_output_stream(f"{self.base}/{self.name}.index.part") as index:
            index.write(held.getvalue())
        for end in ("", ".index"):
            self.store.move(f"{self.base}/{self.name}{end}.part", f"{self.base}/{self.name}{end or '.ids'}")
        return self.name, self.keys[0], self.keys[-1], int(counted.sum()), len(counted)


def _writer(root: str, encoder, end_id: int, shard_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_, own, number, held, shard = encoder.value, uuid.uuid4().hex, 0, 0, None
        end, size, done = encoder_.pack([end_id]), np.dtype(encoder_.dtype).itemsize, []
        store, base = _open(root)
        for batch in batches:
            keys = batch.column(0).fill_null(NULL_KEY).to_pylist()
            for key, ids in zip(keys, encoder_.encode(x.as_py() for x in batch.column(1)), strict=True):
                if shard is None:
                    shard, number, held = _ShardWriter(store, base, f"{own}-{number:06d}"), number + 1, 0
                shard.add(key, ids + end, len(ids) // size + 1)
                held += len(ids) + size
                if held >= shard_bytes:
                    done.append(shard.close())
                    shard = None
        if shard is not None:
            done.append(shard.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["shard", "low", "high", "n_tokens", "n_docs"])

    return rows


def write_store(docs: DataFrame, encoder: LibraryEncoder, root: str, end_id: int = 0, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes docs in ascending key order, to shards of about shard_bytes at most; gives the manifest, saved beside the shards: (shard, low, high, n_tokens, n_docs, start)."""
    spark, dtype = docs.sparkSession, encoder.dtype
    shared, root = spark.sparkContext.broadcast(encoder), _qualified(spark, root)
    store, base = _open(root)
    store.create_dir(base, recursive=True)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = rows.mapInArrow(_writer(root, shared, end_id, shard_bytes), "shard string, low long, high long, n_tokens long, n_docs long")
    manifest.write.parquet(f"{root}/manifest")  # a row for each shard
    manifest = spark.read.parquet(f"{root}/manifest").withColumn("dtype", F.lit(dtype))
    before = F.sum("n_tokens").over(Window.orderBy("low", "high", "shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read_store(manifest: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, looked up by key in the shards."""
    root = _qualified(manifest.sparkSession, root)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        for batch in batches:
            for x in batch.to_pylist():
                with store.open_input_file(f"{base}/{x['shard']}.index") as index, store.open_input_file(f"{base}/{x['shard']}.ids") as ids:
                    shard = Shard(index.read(), ids.read(), x["dtype"])
                keys, again = np.unique(shard.key, return_counts=True)
                found = np.repeat(shard.entries(keys), again) + np.arange(len(shard.key)) - np.repeat(np.cumsum(again) - again, again)
                crcs = [zlib.crc32(shard.get(e).astype("<u4").tobytes()) for e in found.tolist()]
                own = np.repeat(keys, again)
                yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_KEY), pa.array(shard.first[found] + x["start"]), pa.array(shard.count[found]), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition("shard").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def get_document(spark: SparkSession, manifest: DataFrame, root: str, key: int) -> list[np.ndarray]:
    """The ids of one document, for each row of its key, by constant-time lookup in the shard of its range."""
    out = []
    store, base = _open(_qualified(spark, root))
    for x in manifest.where((F.col("low") <= key) & (F.col("high") >= key)).orderBy("start").collect():  # neighbours, if the key is repeated
        with store.open_input_file(f"{base}/{x['shard']}.index") as index, store.open_input_file(f"{base}/{x['shard']}.ids") as ids:
            shard = Shard(index.read(), b"", x["dtype"])
            entry = int(shard.entries(np.array([key], np.int64))[0])
            while 0 <= entry < len(shard.key) and shard.key[entry] == key:
                ids.seek(int(shard.first[entry]) * shard.dtype.itemsize)
                out.append(np.frombuffer(ids.read(int(shard.count[entry]) * shard.dtype.itemsize), shard.dtype))
                entry += 1
    return out


def new_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
