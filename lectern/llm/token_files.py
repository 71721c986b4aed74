"""Token ids in binary files of patched frame-of-reference blocks.

A file holds documents in ascending doc_id order. Layout (little-endian):

    magic "PFOR1\\0\\0\\0", block size u64, ids u64, documents u64
    doc_id i64 and null flag u8 of each document, its number of ids u64
    start u64 of each block's bytes in the data, one more for their end
    blocks: minimum u32, width u8, zero u8, exceptions u16,
            block size * width bits of (id - minimum) modulo 2^width,
            u16 place of each exception, u32 (id - minimum) of each exception

The width of a block holds a fixed percentile of its differences; larger ones are exceptions.
The last block is filled up with its last id. The index of block starts lets a reader begin anywhere.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import encode
from lectern.llm.common import partitions, pick, scratch, ship, stored

MAGIC = b"PFOR1\0\0\0"
BLOCK = 256
#: Of the differences in a block, the part that fits its width.
PERCENTILE = 0.9
#: Ids after which a task begins another file: bounds what it holds.
FILE_IDS = 4_000_000
HEAD = 8


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, side by side: (n, BLOCK) to (n, BLOCK * width / 8) bytes."""
    n = len(values)
    v = (values.astype(np.uint64) & np.uint64((1 << width) - 1)).reshape(n * BLOCK // 64, 64)
    out = np.zeros((len(v), width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").view(np.uint8).reshape(n, BLOCK * width // 8)


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    """What ``_pack`` was given."""
    n = len(data)
    words = np.ascontiguousarray(data).view("<u8").reshape(n * BLOCK // 64, width)
    out = np.empty((len(words), 64), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, j] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, j] |= words[:, word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).astype(np.uint32).reshape(n, BLOCK)


def _bits(x: np.ndarray) -> np.ndarray:
    """The number of bits that each number needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, bytes) of all blocks of ``ids``."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(1, np.uint64), np.zeros(0, np.uint8)
    rows = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], np.uint32)]).reshape(n, BLOCK)
    least = rows.min(axis=1)
    delta = rows - least[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = _bits(np.partition(delta, at, axis=1)[:, at])
    odd = delta >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    odds = odd.sum(axis=1)
    starts = np.concatenate([[0], np.cumsum(HEAD + BLOCK // 8 * width + 6 * odds)])
    out = np.zeros(int(starts[-1]), np.uint8)
    head = np.zeros((n, HEAD), np.uint8)
    head[:, :4] = least.astype("<u4")[:, None].view(np.uint8).reshape(n, 4)
    head[:, 4] = width
    head[:, 6:] = odds.astype("<u2")[:, None].view(np.uint8).reshape(n, 2)
    out[starts[:-1, None] + np.arange(HEAD)] = head
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        out[starts[of, None] + HEAD + np.arange(BLOCK // 8 * w)] = _pack(delta[of], w)
    row, place = np.nonzero(odd)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(odds) - odds, odds)
        base = starts[row] + HEAD + BLOCK // 8 * width[row]
        out[(base + 2 * nth)[:, None] + np.arange(2)] = place.astype("<u2")[:, None].view(np.uint8).reshape(-1, 2)
        out[(base + 2 * odds[row] + 4 * nth)[:, None] + np.arange(4)] = delta[row, place].astype("<u4")[:, None].view(np.uint8).reshape(-1, 4)
    return starts.astype(np.uint64), out


def ids_of(starts: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ids that ``blocks`` was given."""
    n = len(starts) - 1
    starts = starts.astype(np.int64)
    head = data[starts[:-1, None] + np.arange(HEAD)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4").reshape(n)
    width = head[:, 4].astype(np.int64)
    odds = np.ascontiguousarray(head[:, 6:]).view("<u2").reshape(n).astype(np.int64)
    out = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        out[of] = _unpack(data[starts[of, None] + HEAD + np.arange(BLOCK // 8 * w)], w)
    if odds.sum():
        row = np.repeat(np.arange(n), odds)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(odds) - odds, odds)
        base = starts[row] + HEAD + BLOCK // 8 * width[row]
        place = np.ascontiguousarray(data[(base + 2 * nth)[:, None] + np.arange(2)]).view("<u2").reshape(-1)
        out[row, place] = np.ascontiguousarray(data[(base + 2 * odds[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    return (out + least[:, None]).reshape(-1)[:count]


def dump(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    starts, data = blocks(flat)
    parts = [MAGIC, np.array([BLOCK, len(flat), len(ids)], "<u8"), np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), np.array([len(x) for x in ids], "<u8"), starts.astype("<u8"), data]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


def load(raw: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    if raw[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    block, count, docs = np.frombuffer(raw, "<u8", 3, 8).tolist()
    if block != BLOCK:
        raise ValueError(f"blocks of {block} ids")
    at = 32
    got = []
    for kind, n in (("<i8", docs), (np.uint8, docs), ("<u8", docs), ("<u8", -(-count // BLOCK) + 1)):
        got.append(np.frombuffer(raw, kind, n, at))
        at += got[-1].nbytes
    flat = ids_of(got[3], np.frombuffer(raw, np.uint8, offset=at), count) if count else np.zeros(0, np.uint32)
    return [None if null else d for d, null in zip(got[0].tolist(), got[1].tolist(), strict=True)], np.split(flat, np.cumsum(got[2].astype(np.int64))[:-1]) if docs else []


def write(docs: DataFrame, tokenizer: str, path: str, end: int = 0) -> DataFrame:
    """Encode all texts, each followed by ``end``, and write them to files under ``path``.

    Returns one row per file: task and file (their order is that of the documents), path, docs,
    ids, and start, the number of ids in all files before it. A task that runs again writes other
    files; only those of the run that counted are in the list. Null and empty texts have ``end``
    alone; null doc_ids come first; repeated rows are written each, ordered by their text's hash.
    """
    ship(docs.sparkSession)
    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = base.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(arrived):
        import pyarrow.fs
        from pyspark import TaskContext

        task, file, doc_ids, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        store, root = pyarrow.fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)

        def flush():
            name = f"part-{task:05d}-{file:05d}-{uuid.uuid4().hex}.pfor"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(dump(doc_ids, ids))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((task, pa.int32()), (file, pa.int32()), (f"{path}/{name}", pa.string()), (len(ids), pa.int64()), (size, pa.int64()))], ["task", "file", "path", "docs", "ids"])

        for b in arrived:
            doc = b.column("doc_id").to_pylist()
            for first, got in encode.encode(b.column("text"), tokenizer):
                for k, x in enumerate(got):
                    doc_ids.append(doc[first + k]), ids.append(np.append(x, np.uint32(end)))
                    size += len(x) + 1
                    if size >= FILE_IDS:
                        yield flush()
                        file, doc_ids, ids, size = file + 1, [], [], 0
        if ids:
            yield flush()

    files = stored(dealt.mapInArrow(run, "task int, file int, path string, docs long, ids long"), "manifest")
    # A row per file: few, so one window over all of them is no bottleneck.
    before = Window.orderBy("task", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read files that ``write`` listed: doc_id, start, n_tokens, ids_crc32 (and ids) of each document."""
    ship(files.sparkSession)

    def run(arrived):
        import pyarrow.fs

        for b in arrived:
            for uri, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                store, at = pyarrow.fs.FileSystem.from_uri(uri)
                with store.open_input_stream(at) as f:
                    doc_ids, ids = load(f.read())
                n = np.array([len(x) for x in ids], np.int64)
                cols = [pa.array(doc_ids, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([encode.crc(x) for x in ids], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.select("path", "start").repartition(partitions(files.sparkSession), "path").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """Write all documents to files in the shared folder and read them back: see ``write`` and ``read``."""
    return read(write(docs, tokenizer, scratch(docs.sparkSession, "tokens"), end))
