"""Token ids in compressed blocks that give single documents without reading their neighbours.

A store is a folder of three Parquet tables:

* ``blocks``: ``shard, block, dictionary, payload, index``. ``payload`` is one
  zstandard frame per document, end to end; ``index`` has for each document its
  id, place and length in the payload, and the number of ids before it in its shard
  and of its own. ``dictionary`` is the hash of the dictionary the frames need.
* ``shards``: ``shard`` and ``first``, the number of ids in all shards before it.
* ``dictionary``: ``hash`` and ``content`` of the shared compression dictionary.

Ids are little-endian unsigned 32-bit integers. Shards hold ranges of document
ids in ascending order, and documents are in order within them.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

_MARK = "0"
_BLOCK_BYTES, _BLOCK_DOCS = 4 << 20, 2048


@functools.lru_cache(maxsize=2)
def _tokenizer(file: str) -> Tokenizer:
    return Tokenizer.from_file(file)


@functools.lru_cache(maxsize=1)
def _chunk_ids(file: str) -> ChunkIds:
    """What a worker process has learned; it is kept from task to task."""
    return ChunkIds(_tokenizer(file))


class ChunkIds(dict):
    """Ids of the runs between ASCII white space, each encoded once by the library.

    For a tokenizer that drops white space and looks at nothing across it. New
    runs are encoded together, with a digit between them: this is a token of its
    own, and runs that hold it are encoded alone.
    """

    def __init__(self, tokenizer: Tokenizer, most: int = 1_200_000):
        self.tokenizer, self.most = tokenizer, most
        marks = tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = marks[0] if len(marks) == 1 else None

    def learn(self, runs: set[bytes]) -> None:
        new = [r for r in runs if r not in self]
        if len(self) + len(new) > self.most:
            # Frequent runs came first; they stay.
            for run in list(islice(self, self.most // 2, None)):
                del self[run]
            new = [r for r in runs if r not in self]
        joint = [r for r in new if self.mark is not None and _MARK.encode() not in r]
        for k in range(0, len(joint), 10_000):
            part = joint[k:k + 10_000]
            text = f" {_MARK} ".join(r.decode() for r in part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not keep runs apart")
            raw, start = ids.tobytes(), 0
            for run, end in zip(part, ends):
                self[run] = raw[4 * start:4 * end]
                start = end + 1
        alone = [r for r in new if r not in self]
        for run, found in zip(alone, self.tokenizer.encode_batch_fast([r.decode() for r in alone], add_special_tokens=False)):
            self[run] = np.array(found.ids, "<u4").tobytes()

    def _long(self, runs: list[bytes]) -> bytes:
        """The ids of a text of any length, a bounded part of its runs at a time."""
        out = []
        for k in range(0, len(runs), 50_000):
            part = runs[k:k + 50_000]
            self.learn(set(part))
            out.append(b"".join(map(self.__getitem__, part)))
        return b"".join(out)

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; runs that are new in a bounded number of texts are learned together."""
        found: list[bytes] = []
        for k in range(0, len(texts), 200):
            split = [t.split() for t in texts[k:k + 200]]
            self.learn(set().union(*(s for s in split if len(s) <= 10_000)))
            found += [b"".join(map(self.__getitem__, s)) if len(s) <= 10_000 else None for s in split]
            for place, s in enumerate(split, k):
                if found[place] is None:  # may push out what the others have learned, so it comes last
                    found[place] = self._long(s)
        return found


def _binary(column: pa.Array) -> list[bytes]:
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def train_dictionary(docs: DataFrame, tokenizer_file: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
                     documents: int = 1000, sample_bytes: int = 1 << 14, size: int = 1 << 16) -> bytes:
    """A zstandard dictionary for serialized ids, from ``documents`` documents at most.

    They are those with the smallest hash of their id; at most ``sample_bytes`` of the ids of
    each are sent to the driver. Too few of them for training are used as they
    are. Only the size of the store depends on the dictionary, nothing that is read from it.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id")).where("doc_id IS NOT NULL")
    chosen = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.substring(text, 1, sample_bytes).alias("text"))

    def run(stream):
        cache = _chunk_ids(tokenizer_file)
        for batch in stream:
            found = cache.encode_many(_binary(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(b + np.array([end_id], "<u4").tobytes())[:sample_bytes] for b in found], pa.binary())], names=["ids"])

    rows = source.join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(run, "ids binary").limit(2 * documents)
    samples = [bytes(r.ids) for r in rows.collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def dictionary_hash(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def write_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, doc_id: str = "doc_id",
                text: str = "text", level: int = 3, shards: int | None = None) -> None:
    """Encode every text, append ``end_id``, and write the store to ``path``.

    Texts are moved once, to shards by ranges of ``doc_id``; rows of equal id are
    ordered by a hash of their texts and may fall into several shards. A null id
    comes first. Null and empty texts give the end id alone. Other columns are not kept.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    content = train_dictionary(source, tokenizer_file, end_id)
    digest = dictionary_hash(content)
    spark.createDataFrame([(digest, bytearray(content))], "hash string, content binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(content)
    kind = source.schema["doc_id"].dataType
    entry = pa.struct([("doc_id", _arrow(source)), ("offset", pa.int32()), ("length", pa.int32()),
                       ("start", pa.int64()), ("n_tokens", pa.int64())])
    layout = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string()),
                        ("payload", pa.binary()), ("index", pa.list_(entry))])

    def run(stream):
        cache = _chunk_ids(tokenizer_file)
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(shared.value)).compress
        end, shard = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        block, total, frames, index, size = 0, 0, [], [], 0

        def flush():
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "dictionary": digest, "payload": b"".join(frames), "index": index}], layout)

        for batch in stream:
            for cut in range(0, batch.num_rows, 500):
                part = batch.slice(cut, 500)
                for name, ids in zip(part.column("doc_id").to_pylist(), cache.encode_many(_binary(part.column("text")))):
                    frame, count = pack(ids + end), len(ids) // 4 + 1
                    index.append({"doc_id": name, "offset": size, "length": len(frame), "start": total, "n_tokens": count})
                    frames.append(frame)
                    size, total = size + len(frame), total + count
                    if size >= _BLOCK_BYTES or len(frames) >= _BLOCK_DOCS:
                        yield flush()
                        block, frames, index, size = block + 1, [], [], 0
        if frames:
            yield flush()

    tie = F.xxhash64("text").alias("_llm_tie")
    wanted = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.withColumn("_llm_tie", tie).repartitionByRange(wanted, "doc_id", "_llm_tie").sortWithinPartitions("doc_id", "_llm_tie", "text")
    struct = f"struct<doc_id:{kind.simpleString()},offset:int,length:int,start:bigint,n_tokens:bigint>"
    blocks = ordered.select("doc_id", "text").mapInArrow(
        run, f"shard int, block int, dictionary string, payload binary, index array<{struct}>")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")

    last = F.element_at("index", -1)
    ends = spark.read.parquet(f"{path}/blocks").select("shard", (last["start"] + last["n_tokens"]).alias("n"))
    sizes = sorted((r.shard, r.n) for r in ends.groupBy("shard").agg(F.max("n").alias("n")).collect())  # one row a shard
    firsts, total = [], 0
    for shard, n in sizes:
        firsts.append((shard, total))
        total += n
    spark.createDataFrame(firsts, "shard int, first bigint").coalesce(1).write.parquet(f"{path}/shards")


def _arrow(df: DataFrame) -> pa.DataType:
    return df.select("doc_id").limit(0).toArrow().schema.field("doc_id").type


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, object]:
    """Blocks with ``first``, and their dictionary as (hash, content)."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    if dictionary_hash(bytes(row.content)) != row.hash:
        raise ValueError("the store's dictionary is damaged")
    blocks = spark.read.parquet(f"{path}/blocks")
    firsts = spark.read.parquet(f"{path}/shards")
    return blocks.join(F.broadcast(firsts), "shard"), spark.sparkContext.broadcast((row.hash, bytes(row.content)))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), and ``ids`` of every document of a store."""
    blocks, shared = _opened(spark, path)
    entry = blocks.schema["index"].dataType.elementType["doc_id"].dataType

    def run(stream):
        digest, content = shared.value
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(content)).decompress
        for batch in stream:
            for row in range(batch.num_rows):
                if batch.column("dictionary")[row].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                payload, first = memoryview(batch.column("payload")[row].as_py()), batch.column("first")[row].as_py()
                index = batch.column("index")[row].values.flatten()
                names, offsets, lengths, starts, _ = index
                for k in range(0, len(names), 256):
                    places = zip(offsets[k:k + 256].to_pylist(), lengths[k:k + 256].to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [names[k:k + 256], pa.array(np.asarray(starts[k:k + 256]) + first),
                         pa.array([unpack(payload[o:o + n]) for o, n in places], pa.binary())], names=["doc_id", "start", "ids"])

    return blocks.select("dictionary", "payload", "index", "first").mapInArrow(
        run, f"doc_id {entry.simpleString()}, start bigint, ids binary")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``read_store`` for the ``doc_id`` values in ``wanted``: only their frames are unpacked."""
    blocks, shared = _opened(spark, path)
    entries = blocks.select("first", "payload", F.explode("index").alias("e")).select(
        "e.doc_id", (F.col("e.start") + F.col("first")).alias("start"),
        F.expr("substring(payload, e.offset + 1, e.length)").alias("frame"))
    kind = entries.schema["doc_id"].dataType.simpleString()

    def run(stream):
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value[1])).decompress
        for batch in stream:
            ids = pa.array([unpack(f) for f in batch.column("frame").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), ids], names=["doc_id", "start", "ids"])

    found = entries.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return found.mapInArrow(run, f"doc_id {kind}, start bigint, ids binary")
