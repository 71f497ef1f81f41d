"""Token-id archives: a static range asymmetric numeral system with interleaved, independent blocks.

Tasks hold contiguous ranges of doc_id in order and write one file for every few million ids. A file has one
frequency table, shared by its blocks; a block of ids is coded by LANES interleaved states on its own, so any
block can be decoded alone. The header has a checkpoint for each block (where its words start, how many ids it
has) and a CRC-32 of its ids; the documents' ids and lengths stand in the file too. All blocks of a file are
coded and decoded together as numpy arrays.

Writing gives a table of files with the ids before each; it is stored, and only files named there count, so a
task that is run again leaves at most files that nobody reads. Reading deals the files, of which each has FILE_IDS
ids and those of one more document at most, out to as many tasks as the ids need.

Defined results: a null or empty text is its end id alone; repeated rows are written each, in any order among
equals, and may lie in several files; null doc_ids come first; an empty table gives no files and no rows.
Other columns are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverix.llm.common import new_path, small_batches, stored, table, text_bytes
from deliverix.llm.tokens import encoder_for

MAGIC = b"IDANS001"
#: Ids of a file (a document is never split), ids of a block, states of a block, bits of the frequency sum.
FILE_IDS, BLOCK_IDS, LANES, BITS = 2_000_000, 16_384, 64, 18
END = 0
#: Ids that a task reads (about), and the least number of tasks, if there are as many files.
TASK_IDS, TASKS = 16_000_000, 16

_LOW = np.uint64(1 << 31)
_B, _32 = np.uint64(BITS), np.uint64(32)
_SLOTS = np.uint64((1 << BITS) - 1)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and their frequencies, each at least 1, of sum 2 ** BITS."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << BITS
    if len(symbols) > total:
        raise ValueError("more distinct ids than frequency slots")
    f = 1 + np.floor(counts * ((total - len(symbols)) / counts.sum())).astype(np.int64)
    f[np.argmax(counts)] += total - f.sum()
    return symbols.astype(np.uint32), f.astype(np.uint32)


def encode_blocks(index: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes rows of symbol indexes, a block each: end states, words of all blocks in decoding order, words a block."""
    n, length = index.shape
    x = np.full((n, LANES), _LOW)
    steps = -(-length // LANES)
    words, used = np.zeros((steps, n, LANES), np.uint32), np.zeros((steps, n, LANES), bool)
    for t in range(steps - 1, -1, -1):
        s = index[:, t * LANES : (t + 1) * LANES]
        k = s.shape[1]
        f, c, y = freq[s], start[s], x[:, :k]
        full = y >= f << (np.uint64(63) - _B)
        words[t, :, :k], used[t, :, :k] = y.astype(np.uint32), full
        y = np.where(full, y >> _32, y)
        q = y // f
        x[:, :k] = (q << _B) + (y - q * f) + c
    order = used.transpose(1, 0, 2)
    return x, words.transpose(1, 0, 2)[order], order.sum((1, 2))


def decode_blocks(states: np.ndarray, words: np.ndarray, first: np.ndarray, length: int, freq: np.ndarray, start: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Symbol indexes of blocks of one length, from their states and where their words begin."""
    x, at = states.copy(), first.copy()
    out = np.zeros((len(x), length), np.uint32)
    words = np.append(words, np.uint32(0))
    for t in range(0, length, LANES):
        k = min(LANES, length - t)
        y = x[:, :k]
        slot = y & _SLOTS
        s = slots[slot]
        out[:, t : t + k] = s
        y = freq[s] * (y >> _B) + slot - start[s]
        need = y < _LOW
        place = np.minimum(at[:, None] + np.cumsum(need, 1) - 1, len(words) - 1)
        x[:, :k] = np.where(need, y << _32 | words[np.maximum(place, 0)], y)
        at += need.sum(1)
    return out


def write_archive(ids: np.ndarray, doc_ids: list[int | None], sizes: list[int]) -> bytes:
    """A file of the ids of documents, one after the other."""
    symbols, f = frequencies(ids)
    freq = f.astype(np.uint64)
    start = np.cumsum(freq) - freq
    look = np.zeros(int(symbols[-1]) + 1, np.uint32)
    look[symbols] = np.arange(len(symbols))
    whole = len(ids) // BLOCK_IDS * BLOCK_IDS
    parts = [encode_blocks(p, freq, start) for p in (look[ids[:whole]].reshape(-1, BLOCK_IDS), look[ids[whole:]].reshape(1, -1)) if p.size]
    crcs = [zlib.crc32(ids[i : i + BLOCK_IDS].astype("<u4")) for i in range(0, len(ids), BLOCK_IDS)]
    sections = {
        "symbols": zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4"), 1),
        "freq": zlib.compress(f.astype("<u4"), 1),
        "doc_ids": np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        "doc_null": np.array([d is None for d in doc_ids], bool).tobytes(),
        "doc_sizes": np.array(sizes, "<i8").tobytes(),
        "block_words": np.concatenate([p[2] for p in parts]).astype("<i8").tobytes(),
        "block_crc": np.array(crcs, "<u4").tobytes(),
        "states": np.concatenate([p[0] for p in parts]).astype("<u8").tobytes(),
    }
    head = json.dumps({"ids": len(ids), "block": BLOCK_IDS, "lanes": LANES, "bits": BITS, "sections": {k: len(v) for k, v in sections.items()}}).encode()
    words = np.concatenate([p[1] for p in parts]).astype("<u4").tobytes()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *sections.values(), words])


class Archive:
    """Reads a file of write_archive: the documents, and the ids of any range, from the blocks that hold them."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not an archive of ids")
        size = int.from_bytes(source.read(4), "little")
        self.head = json.loads(source.read(size))
        if (self.head["lanes"], self.head["bits"]) != (LANES, BITS):
            raise ValueError("other lanes or bits")
        s = {k: source.read(n) for k, n in self.head["sections"].items()}
        self.words_at = source.tell()
        self.symbols = np.cumsum(np.frombuffer(zlib.decompress(s["symbols"]), "<u4"), dtype=np.uint32)
        self.freq = np.frombuffer(zlib.decompress(s["freq"]), "<u4").astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        null = np.frombuffer(s["doc_null"], bool)
        self.doc_ids = pa.array(np.frombuffer(s["doc_ids"], "<i8"), pa.int64(), mask=null)
        self.doc_sizes = np.frombuffer(s["doc_sizes"], "<i8")
        self.block_words = np.frombuffer(s["block_words"], "<i8")
        self.block_crc = np.frombuffer(s["block_crc"], "<u4")
        self.states = np.frombuffer(s["states"], "<u8").reshape(-1, LANES)

    def read(self, first: int, count: int) -> np.ndarray:
        """count ids from the first on; checks every block it decodes."""
        if not count:
            return np.zeros(0, np.uint32)
        block, n = self.head["block"], self.head["ids"]
        lo, hi = first // block, -(-(first + count) // block)
        ends = np.concatenate([[0], np.cumsum(self.block_words)])
        self.source.seek(self.words_at + 4 * int(ends[lo]))
        words = np.frombuffer(self.source.read(4 * int(ends[hi] - ends[lo])), "<u4")
        begin = ends[lo:hi] - ends[lo]
        whole = min(hi, n // block)
        out = []
        if whole > lo:
            out.append(decode_blocks(self.states[lo:whole], words, begin[: whole - lo], block, self.freq, self.start, self.slots).ravel())
        if hi > whole:
            out.append(decode_blocks(self.states[whole:hi], words, begin[whole - lo :], n - whole * block, self.freq, self.start, self.slots).ravel())
        ids = self.symbols[np.concatenate(out)]
        for b in range(lo, hi):
            if zlib.crc32(ids[(b - lo) * block : (b - lo + 1) * block].astype("<u4")) != self.block_crc[b]:
                raise ValueError(f"block {b} is damaged")
        return ids[first - lo * block : first - lo * block + count]


def write_ids(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """Writes the ids of docs(doc_id, text) in ascending doc_id; returns the stored table of files (path, ids, start)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_path(spark, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary)
        store, top = fs.FileSystem.from_uri(folder)
        part, doc_ids, tokens, held, n = TaskContext.get().partitionId(), [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, tokens, held, n
            ids = np.concatenate(tokens)
            store.create_dir(top, recursive=True)
            path = f"{top}/{part:06d}-{n:06d}-{uuid.uuid4().hex}.ids"
            with store.open_output_stream(path, compression=None) as f:
                f.write(write_archive(ids, doc_ids, [len(t) for t in tokens]))
            row = [[part], [n], [path], [len(ids)]]
            doc_ids, tokens, held, n = [], [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array(v) for v in row], names=["part", "n", "path", "ids"])

        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), encoder(text_bytes(b.column(1)))):
                doc_ids.append(doc_id)
                tokens.append(np.append(t, np.uint32(end)))
                held += len(t) + 1
                if held >= FILE_IDS:
                    yield flush()
        if tokens:
            yield flush()

    row = F.monotonically_increasing_id().alias("row")  # so that the rows of one doc_id may be several ranges
    rows = docs.select("doc_id", "text", row).repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    files = stored(rows.mapInArrow(run, "part long, n long, path string, ids long"), "id-files")
    sums = files.groupBy("part").agg(F.sum("ids").alias("k"))
    parts = sums.select("part", F.coalesce(F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # a row for each task
    before = F.coalesce(F.sum("ids").over(W.partitionBy("part").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("before", before).join(parts, "part").select(F.lit(folder).alias("folder"), "path", "ids", (F.col("offset") + F.col("before")).alias("start"))


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files (a stored table, as of write_ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, path, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                with fs.FileSystem.from_uri(folder)[0].open_input_file(path) as f:
                    a = Archive(f)
                    ids = a.read(0, a.head["ids"]).astype("<u4")
                cut = np.concatenate([[0], np.cumsum(a.doc_sizes)])
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [a.doc_ids, pa.array(cut[:-1] + start), pa.array(a.doc_sizes), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    ids = files.agg(F.coalesce(F.sum("ids"), F.lit(0))).first()[0]
    tasks = max(-(-ids // TASK_IDS), TASKS)
    # an explicit number: the rows are small, so the tasks of a plain repartition would be joined by their size
    return files.select("folder", "path", "start").repartition(int(tasks)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the ids of the tokenizers library and its byte_bpe_50k.json, in which "<|endoftext|>" in a text is one id."""
    files = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(stored(files, "id-index"))
