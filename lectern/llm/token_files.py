"""Token-ID / binary output (operator 9): ids by frequency rank in byte-aligned variable-length coding.

File format, a block of whole documents (all numbers little-endian):
  magic "LTB1", u32 n_docs, u32 n_table, u64 n_ids
  u32 x n_table    ids by descending frequency in the block (ties: smaller id first); an id's rank is its place
  i64 x n_docs     document ids, then u8 x n_docs: 1 where the document id is null
  u32 x n_docs     ids of each document
  u8 x ceil(n_ids / 4)  control bytes: two bits an id, lowest first, the number of its rank's bytes less 1
  u8 x ...         the ranks' bytes
  u32              crc32 of all before
Control bytes stand apart from data bytes, so decoding is table lookup and gathering in numpy, without
a branch. Ranks are by block: a block is read without any other, and no pass over the corpus for counts
has to come first. Blocks are rows of a Parquet table (part, seq, n_docs, n_ids, block), since that is
what every store that Spark writes to can take from executors; part and seq give document order."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, shared_dir, trimmed
from .pieces import Pieces
from .textnum import HashIndex, buffers, slices

BLOCK_IDS = 1 << 20
MOST_KEPT = 500_000
_CODES = (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3).astype(np.uint8)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_PARQUET = "part int, seq int, n_docs long, n_ids long, block binary"


def pack(ids: np.ndarray, lengths: np.ndarray, keys: np.ndarray, null: np.ndarray) -> bytes:
    """A block of the file format."""
    count = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    order = np.argsort(-count, kind="stable")
    order = order[: int((count > 0).sum())].astype(np.uint32)
    rank = np.zeros(len(count), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    r = rank[ids].astype("<u4")
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    out = b"".join([b"LTB1", struct.pack("<IIQ", len(lengths), len(order), len(ids)), order.astype("<u4").tobytes(), keys.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), lengths.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])
    return out + struct.pack("<I", zlib.crc32(out))


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, ids of each document, document ids and where those are null."""
    if block[:4] != b"LTB1" or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("not a block of token ids, or a damaged one")
    docs, size, n = struct.unpack_from("<IIQ", block, 4)
    at = 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, count, at)
        at += out.nbytes
        return out

    order, keys, null, lengths = take("<u4", size), take("<i8", docs), take("u1", docs).astype(bool), take("<u4", docs)
    code = _CODES[take("u1", -(-n // 4))].reshape(-1)[:n]
    data = np.concatenate([np.frombuffer(block, np.uint8, len(block) - 4 - at, at), np.zeros(3, np.uint8)])
    place = np.cumsum(code, dtype=np.int64) + np.arange(n) - code
    rank = data[place].astype(np.uint32)
    for k in (1, 2, 3):
        if (code >= k).any():
            rank |= data[place + k].astype(np.uint32) << np.uint32(8 * k)
    return order[rank & _MASKS[code]] if n else np.zeros(0, np.uint32), lengths, keys, null


class _Strings:
    """Spans of bytes as strings, made when they are asked for."""

    def __init__(self, blob: bytes, start: list[int], end: list[int]):
        self.blob, self.start, self.end = blob, start, end

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, i: int) -> str:
        return self.blob[self.start[i] : self.end[i]].decode("utf-8", "replace")

    def joined(self, which: list[int]) -> str:
        return b"".join([self.blob[self.start[i] : self.end[i]] for i in which]).decode("utf-8", "replace")


class Encoder:
    """Ids of whole texts from the tokenizers library, which sees each distinct piece once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = added[0].encode() if added else b""
        self.cut = len(added) < 2
        size = self.tok.get_vocab_size()
        self.blank = np.zeros(size, bool)
        for word, number in self.tok.get_vocab(with_added_tokens=False).items():
            self.blank[number] = word.startswith("Ġ")
        self.line = self.ids("\n")
        self.reset()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def reset(self) -> None:
        self.index, self.flat = HashIndex(), np.zeros(0, np.uint32)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, known: int) -> None:
        """Appends the ids of the index's pieces from number `known` on. Pieces are joined so that a call to the library has many of them: those that
        begin with a blank as they are, for only their first id begins with one; others by line ends. The first, nearly all, are joined as bytes."""
        data, start, end_ = self.index.data, self.index.at[known:-1], self.index.at[known + 1 :]
        blob = data[start[0] :].tobytes()
        new = _Strings(blob, (start - start[0]).tolist(), (end_ - start[0]).tolist())
        flat: list[np.ndarray] = []
        at, size = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        end = len(self.flat)

        def put(which: np.ndarray | list[int], ids: np.ndarray, first: np.ndarray | int, sizes: np.ndarray | int) -> None:
            nonlocal end
            at[which], size[which] = end + first, sizes
            flat.append(ids)
            end += len(ids)

        blank = (data[start] == 0x20) & (end_ - start > 1)
        joined: dict[str, list[int]] = {" ": np.flatnonzero(blank).tolist(), "\n": []}
        for i in np.flatnonzero(~blank).tolist():
            p = new[i]
            if len(self.line) == 1 and p.split() == [p]:
                joined["\n"].append(i)
            else:
                ids = self.ids(p)
                put([i], ids, 0, len(ids))
        for by, which in joined.items():
            for lo in range(0, len(which), 8192):
                part = which[lo : lo + 8192]
                ids = self.ids(new.joined(part) if by == " " else by.join([new[i] for i in part]))
                cut = np.flatnonzero(self.blank[ids] if by == " " else ids == self.line[0])
                if len(cut) != len(part) - (by == "\n") or by == " " and cut[0]:
                    for i in part:
                        ids = self.ids(new[i])
                        put([i], ids, 0, len(ids))
                elif by == " ":
                    put(part, ids, cut, np.diff(cut, append=len(ids)))
                else:
                    first = np.concatenate([[0], cut + 1])
                    put(part, ids, first, np.append(cut, len(ids)) - first)
        self.flat = np.concatenate([self.flat, *flat])
        self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, size])

    def slice(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts lo..hi, one after the other, and how many each has."""
        if self.index.n > MOST_KEPT:
            self.reset()
        p = Pieces(data, offs, lo, hi, self.special)
        known = self.index.n
        number, _ = p.numbered(self.index, strings=False)
        if self.index.n > known:
            self._learn(known)
        size = self.size[number]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.at[number] - ends + size, size)]
        count = np.bincount(p.row, size, minlength=p.rows).astype(np.int64)
        if len(p.whole) or not self.cut:
            bounds = np.concatenate([[0], np.cumsum(count)])
            parts = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for row in p.whole.tolist() if self.cut else range(p.rows):
                parts[row] = self.ids(p.text(row))
            flat, count = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return flat, count


_encoders: dict[str, Encoder] = {}


def _write_task(path: str, end_id: int, block_ids: int) -> Callable[[pa.RecordBatch | None], Iterator[pa.RecordBatch]]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encoder, part = _encoders[path], TaskContext.get().partitionId()
    held: list[tuple[np.ndarray, ...]] = []
    state = {"seq": 0, "ids": 0}

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            ids, lengths, keys, null = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            state["ids"] = 0
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([state["seq"]], pa.int32()), pa.array([len(lengths)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack(ids, lengths, keys, null)], pa.binary())], ["part", "seq", "n_docs", "n_ids", "block"])
            state["seq"] += 1

    def run(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        if batch is None:
            yield from flush()
            return
        keys = batch.column(0)
        null = np.asarray(keys.is_null())
        keys = np.asarray(keys.fill_null(0))
        data, offs = buffers(batch.column(1))
        for lo, hi in slices(offs):
            flat, count = encoder.slice(data, offs, lo, hi)
            ids = np.insert(flat, np.cumsum(count), np.uint32(end_id))
            held.append((ids, count + 1, keys[lo:hi], null[lo:hi]))
            state["ids"] += len(ids)
            if state["ids"] >= block_ids:
                yield from flush()

    return run


def write_tokens(docs: DataFrame, vocabulary: str, path: str, text: str = "text", key: str = "doc_id", end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encodes docs in ascending key order (nulls first; ties by a hash of the text, then by the text) and writes the blocks under path.

    Range partitions are sorted on their own; a block is cut at whole documents after block_ids ids, so memory
    is bounded by a block and the longest text. A null text is an empty one: its end_id alone."""
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _write_task(vocabulary, end_id, block_ids)
        for batch in batches:
            if batch.num_rows:
                yield from g(batch)
            del batch
            trimmed()
        yield from g(None)

    # The hash is in the range, so that a key of many rows is no single task's.
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text").mapInArrow(run, _PARQUET).write.parquet(path)


def _read_task() -> Callable[[pa.RecordBatch], Iterator[pa.Table]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for part, seq, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids, lengths, keys, null = unpack(block.as_py())
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(lengths)
            yield pa.table({"part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "doc_id": pa.array(keys, mask=null), "at": pa.array(starts), "n_tokens": pa.array(lengths.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def read_tokens(spark, path: str) -> DataFrame:
    """A row for each document in the blocks under path: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(_PARQUET).parquet(path)
    # Sums by part first: the one window over all has a row for each part.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = blocks.select("part", "seq", inner.alias("inner")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("base"))
    rows = arrow_map(blocks.select("part", "seq", "block"), _read_task, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(spark, path: str) -> DataFrame:
    """The documents' ids themselves, as arrays: doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                ids, lengths, keys, null = unpack(block.as_py())
                at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int64)))], ["doc_id", "ids"])

    return spark.read.schema(_PARQUET).parquet(path).select("block").mapInArrow(run, "doc_id long, ids array<long>")


def token_digest(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", end_id: int = 0) -> DataFrame:
    """Writes docs as token blocks in the shared folder, reads them back: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before, in ascending doc_id order (nulls first; equal ids as in write_tokens()).
    Repeated rows are separate documents. Other columns are ignored; an empty table gives an empty result."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/lectern-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, vocabulary, path, text, key, end_id)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return read_tokens(spark, path)


__all__ = ["Encoder", "pack", "read_tokens", "token_digest", "token_ids", "unpack", "write_tokens"]
