"""Files of token ids: frequency-ranked ids in bytes of variable number, control bytes apart.

A token file is a magic number and frames. A frame holds consecutive documents: their ids as an
Arrow stream, the number of tokens of each, and the tokens. Numbers are stored in one to four
bytes each, without the leading zero bytes; how many follows from control bytes that are stored
apart, two bits a number. Tokens are stored as ranks by frequency in the whole corpus, so that the
255 most frequent need one byte; ``RANKS`` beside the files lists the id of every rank.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import ensure_checkpoint_dir
from .common import batch_steps
from .tokens import text_ids

MAGIC = b"TOKRANK1"
#: Documents, tokens, then bytes of: document ids, control and data bytes of counts, of tokens.
FRAME = struct.Struct("<7Q")
RANKS = "ranks.u32"
_WIDTHS = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3  # bytes less one, of the four numbers of a control byte
_KEEP = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of numbers below 2 ** 32."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    width = (numbers > 0xFF).astype(np.uint8)
    for limit in (0xFFFF, 0xFFFFFF):
        width += numbers > limit
    padded = np.zeros(-(-len(width) // 4) * 4, np.uint8)
    padded[: len(width)] = width
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) <= width[:, None]]
    return control.tobytes(), data.tobytes()


def decode_numbers(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers again: a table gives the widths of the four numbers of each control byte."""
    width = _WIDTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    ends = np.cumsum(width + 1)
    padded = np.frombuffer(data + bytes(4), np.uint8)
    four = np.lib.stride_tricks.sliding_window_view(padded, 4)[ends - width - 1]
    return four.copy().view("<u4").ravel() & _KEEP[width]


def _arrow_bytes(ids: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays([ids], ["doc_id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack_frame(ids: pa.Array, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    named = _arrow_bytes(ids)
    parts = [named, *encode_numbers(counts), *encode_numbers(ranks)]
    return FRAME.pack(len(counts), len(ranks), *map(len, parts)) + b"".join(parts)


def read_frames(file) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(document ids, counts, ranks) of each frame of an open file."""
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := file.read(FRAME.size):
        documents, tokens, *sizes = FRAME.unpack(head)
        named, *parts = [file.read(n) for n in sizes]
        if [len(named), *map(len, parts)] != sizes:
            raise ValueError("a token file ends within a frame")
        yield (
            pa.ipc.open_stream(named).read_all().column(0).combine_chunks(),
            decode_numbers(parts[0], parts[1], documents),
            decode_numbers(parts[2], parts[3], tokens),
        )


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@lru_cache(maxsize=2)
def read_ranks(folder: str) -> np.ndarray:
    store, path = _place(f"{folder}/{RANKS}")
    with store.open_input_stream(path) as file:
        return np.frombuffer(file.read(), "<u4")


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int, kind: str, doc_id: str, text: str) -> DataFrame:
    """doc_id and tokens (ids as numbers of the given kind, the end id last)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = text_ids(tokenizer, "H" if kind == "<u2" else "I"), np.array([end_id], kind).tobytes()
        for batch in batches:
            for rows, texts in batch_steps(batch, "text"):
                ids = pa.array([x + last for x in encode(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), ids], ["doc_id", "tokens"])

    named = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, f"doc_id {named}, tokens binary")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of binary values that hold numbers of a kind, and the numbers one after the other."""
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    numbers = np.frombuffer(data, kind, (offsets[-1] - offsets[0]) // size, offsets[0]) if data and len(column) else np.empty(0, kind)
    return np.diff(offsets) // size, numbers


def _frequency_ranks(tokens: DataFrame, kind: str) -> np.ndarray:
    """Ids by falling frequency, then id. At most the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            part = np.bincount(_flat(batch.column("tokens"), kind)[1])
            if len(part) > len(total):
                total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
            total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    counts = tokens.select("tokens").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.collect()
    return np.array([r.id for r in sorted(found, key=lambda r: (-r.n, r.id))], "<u4")


def _shared_folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, frame: int = 1_000_000, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every text, append ``end_id`` to each, and write token files in ascending ``doc_id`` order.

    Returns and writes the manifest, (shard, file, documents, tokens) per file: what is in no
    manifest was left by a lost or repeated task and counts for nothing. Null texts are empty, so
    they have one token; null ids come first; rows of one id are all written, in the order of a
    hash of their tokens. An empty table gives an empty manifest. ``folder`` must be one that all
    executors share (the default lies in the checkpoint folder), ``tokenizer`` a file that they
    all have. A frame ends after ``frame`` tokens; a longer document has one of its own.
    Texts are encoded once; the driver receives a count for each id of the vocabulary.
    """
    spark = docs.sparkSession
    folder = folder or _shared_folder(spark, "tokens")
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    kind = "<u2" if max(size - 1, end_id) <= 0xFFFF else "<u4"
    _tokenised(docs, tokenizer, end_id, kind, doc_id, text).write.parquet(f"{folder}/encoded", compression="zstd")
    encoded = spark.read.parquet(f"{folder}/encoded")
    ids = _frequency_ranks(encoded, kind)
    store, path = _place(f"{folder}/{RANKS}")
    with store.open_output_stream(path) as file:
        file.write(ids.tobytes())
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _place(folder)
        name, file, held, size, documents, tokens, shard = f"{uuid.uuid4().hex}.tok", None, [], 0, 0, 0, 0

        def flush() -> None:
            columns = [b.column("doc_id") for b in held]
            counts, numbers = zip(*(_flat(b.column("tokens"), kind) for b in held))
            file.write(pack_frame(pa.concat_arrays(columns), np.concatenate(counts), ranks.value[np.concatenate(numbers)]))

        for batch in batches:
            if file is None:  # an attempt has its own file, so attempts of one shard never meet
                file = store.open_output_stream(f"{path}/{name}")
                file.write(MAGIC)
                shard = batch.column("shard")[0].as_py()
            counts = _flat(batch.column("tokens"), kind)[0]
            ends = np.cumsum(counts)
            first = 0
            while first < len(counts):
                base = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + frame - size, "right")))
                part = batch.slice(first, last - first)
                held.append(part)
                size += int(ends[last - 1]) - base
                documents, tokens, first = documents + last - first, tokens + int(ends[last - 1]) - base, last
                if size >= frame or last < len(counts):
                    flush()
                    held, size = [], 0
        if file is not None:
            if held:
                flush()
            file.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "file": [name], "documents": pa.array([documents], pa.int64()), "tokens": pa.array([tokens], pa.int64())}
            )

    ordered = (
        encoded.withColumn("tie", F.xxhash64("tokens"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "tokens")
        .select("doc_id", "tokens", F.spark_partition_id().alias("shard"))
    )
    ordered.mapInArrow(write, "shard int, file string, documents bigint, tokens bigint").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest").withColumn("folder", F.lit(folder))


def read_token_files(manifest: DataFrame, kind: str | T.DataType = "bigint", ids: bool = True) -> DataFrame:
    """Per document in the files of a manifest: doc_id (of the type ``kind``), shard, place (its
    number in the file), before (tokens before it in the file), n_tokens, ids_crc32, and with
    ``ids`` its tokens as an array. A file is read by one task, frame by frame."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = read_ranks(row["folder"])
                store, path = _place(f"{row['folder']}/{row['file']}")
                before = place = 0
                with store.open_input_stream(path) as file:
                    for named, counts, ranks in read_frames(file):
                        tokens = np.ascontiguousarray(names[ranks], "<u4")
                        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                        view = memoryview(tokens).cast("B")
                        cuts = (4 * ends).tolist()
                        more = {"tokens": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int64()))} if ids else {}
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": named,
                                "shard": pa.array(np.full(len(counts), row["shard"]), pa.int32()),
                                "place": pa.array(place + np.arange(len(counts)), pa.int64()),
                                "before": pa.array(before + ends[:-1], pa.int64()),
                                "n_tokens": pa.array(counts, pa.int64()),
                                "ids_crc32": pa.array([zlib.crc32(view[i:j]) for i, j in zip(cuts, cuts[1:])], pa.int64()),
                            }
                            | more
                        )
                        before, place = before + int(ends[-1]), place + len(counts)

    kind = kind if isinstance(kind, str) else kind.simpleString()
    columns = f"doc_id {kind}, shard int, place bigint, before bigint, n_tokens bigint, ids_crc32 bigint" + ", tokens array<bigint>" * ids
    files = manifest.select("folder", "file", "shard")
    return files.repartition(max(1, manifest.count()), "shard").mapInArrow(work, columns)


def token_file_digests(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write token files, read them back, and return per document: doc_id, start (tokens of all
    documents before it), n_tokens, ids_crc32. One number a file passes through the driver."""
    manifest = write_token_files(docs, tokenizer, folder, end_id, doc_id=doc_id, text=text)
    found = read_token_files(manifest, docs.schema[doc_id].dataType, ids=False)
    sizes = sorted((r.shard, r.tokens) for r in manifest.select("shard", "tokens").collect())
    base = np.concatenate([[0], np.cumsum([n for _, n in sizes], dtype=np.int64)])[:-1].tolist() if sizes else []
    starts = docs.sparkSession.createDataFrame([(s, b) for (s, _), b in zip(sizes, base)], "shard int, base bigint")
    return found.join(F.broadcast(starts), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
