"""Length-delimited binary records of token ids, with an offset index.

A data file is a run of frames::

    u64 length | u32 masked crc of these 8 bytes | payload | u32 masked crc of the payload

and a payload is ``i64 doc_id | u8 has_id | u8 bytes per id | ids``. All numbers are
little-endian. The checksum is CRC-32 (zlib's), masked as ``rotate_right(crc, 15) + 0xa282ead8``, so
that a checksum of data that holds checksums stays sound. Beside each data file lies its
index, a row ``i64 doc_id, u64 offset, u64 length, u64 first token`` per record: a reader that
shuffles seeks to any record without scanning.

Documents are put in order of id by range partitions, one file each. A task writes under a
name of its own attempt and renames at the end; only files that the committed manifest names
count, so a lost executor leaves no half file in the result.

Cases: a null text is empty and has the end id only; equal ids stand together, ordered by a hash of the
text, equal rows in any order; a null id comes first; an empty table gives no files; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwire.llm.scratch import Scratch
from sparkwire.llm.tokenids import encoder

_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<qBB")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("first", "<u8")])
_MANIFEST = "part int, file string, records long, tokens long, bytes long"


class Corrupt(ValueError):
    """A frame whose checksum or length is wrong."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _BODY.pack(doc_id or 0, doc_id is not None, width) + ids


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, has, width = _BODY.unpack_from(data)
    return (doc_id if has else None), np.frombuffer(data, f"<u{width}", offset=_BODY.size)


def read_frame(f) -> bytes | None:
    head = f.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise Corrupt("the file ends inside a frame")
    n, crc = _HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise Corrupt("a frame's length is damaged")
    body = f.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise Corrupt("a frame's payload is damaged")
    return body[:n]


def fetch(file: str, index: np.ndarray, positions: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records at any positions, in the order asked for."""
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_file(path) as f:
        for p in positions:
            f.seek(int(index["offset"][p]))
            yield parsed(read_frame(f))


def read_index(file: str) -> np.ndarray:
    fs, path = pafs.FileSystem.from_uri(file + ".idx")
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), INDEX)


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        name = f"{folder}/ids-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.rec"
        fs, path = pafs.FileSystem.from_uri(name)
        enc, out, beside, at, tokens, records = encoder(tokenizer), None, None, 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out, beside = fs.open_output_stream(path + ".tmp"), fs.open_output_stream(path + ".idx")
            doc_ids = b.column(0)
            for lo, ids, offsets in enc.of_column(b.column(1), end_id):
                raw, w, rows = ids.tobytes(), ids.dtype.itemsize, np.zeros(len(offsets) - 1, INDEX)
                frames = []
                for i, doc_id in enumerate(doc_ids.slice(lo, len(rows)).to_pylist()):
                    frames.append(frame(payload(doc_id, raw[offsets[i] * w : offsets[i + 1] * w], w)))
                    rows[i] = (doc_id or 0, at, len(frames[-1]), tokens + offsets[i])
                    at += len(frames[-1])
                tokens, records = tokens + len(ids), records + len(rows)
                out.write(b"".join(frames))
                beside.write(rows.tobytes())
        if out is None:
            return
        out.close()
        beside.close()
        fs.move(path + ".tmp", path)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([ctx.partitionId()], pa.int32()), "file": [name], "records": [records], "tokens": [tokens], "bytes": [at]}
        )

    return run


def write(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; the manifest: file, records, tokens, bytes and start (tokens in all files before)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # rows of one id, null ids among them, may be many: their texts' hashes and then the rows' places split them
    ordered = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange("id", "h", "place").sortWithinPartitions("id", "h")
    folder = scratch.place("ids")
    manifest = scratch.table(ordered.select("id", "text").mapInArrow(_writer(folder, tokenizer, end_id), _MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return scratch.table(manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "files")


def read(files: DataFrame) -> DataFrame:
    """Read and verify every frame: doc_id, start, n_tokens, ids_crc32 (of the ids as u32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, path = pafs.FileSystem.from_uri(r["file"])
                start, rows, left = r["start"], [], r["records"]
                with fs.open_input_stream(path, buffer_size=1 << 20) as f:
                    while (data := read_frame(f)) is not None:
                        doc_id, ids = parsed(data)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        left -= 1
                        if len(rows) == 8192:
                            yield _batch(rows)
                            rows = []
                if left:
                    raise Corrupt(f"{r['file']} has {left} records too few")
                if rows:
                    yield _batch(rows)

    # a file to a task as far as cores go, whatever the size of the manifest
    n = max(1, files.count())
    spread = files.select("file", "records", "start").repartition(n, "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
    )


def encode(spark: SparkSession, docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int, **columns) -> DataFrame:
    return read(write(docs, scratch, tokenizer, end_id, **columns))
