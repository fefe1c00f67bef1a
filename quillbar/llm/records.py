"""Token ids as length-delimited binary records.

A data file is a run of records, each framed as in the public record format of machine-learning data sets:

    8 bytes   length of the data, little-endian
    4 bytes   masked CRC-32C of these 8 bytes
    n bytes   data: the ids, little-endian, 2 bytes each if all ids of the vocabulary fit, else 4
    4 bytes   masked CRC-32C of the data

Beside it lies an index file with one fixed-size entry for each record (its offset, id count and key), so that any record
can be read without reading those before it: a shuffled read needs the index and one range of the data file.

Documents are range-partitioned by key and sorted, one file for each partition, numbered in key order. A file is written under a name of its own
attempt and then renamed, so a task that is run again, or twice at once, leaves the same whole file. The folder can be any that pyarrow's file systems reach.

Defined cases: null and empty texts are records of the end id alone. Null keys come last. Rows with the same key keep an order by text. An empty
table writes no record. Other columns are not looked at. A damaged record raises on reading.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillbar.llm.checksums import crc32c, masked
from quillbar.llm.frames import blocks_for, settled, shared_folder
from quillbar.llm.tokens import Encoder
from quillbar.llm.words import slices

VOCABULARY = "word_bpe_49k.json"
END = 1
FILE_BYTES = 32 << 20
HEADER = np.dtype([("length", "<u8"), ("crc", "<u4")])
ENTRY = np.dtype([("offset", "<u8"), ("count", "<u4"), ("has_key", "<u4"), ("key", "<i8")])
READ_BYTES = 4 << 20


def frames(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The framed records of ``data[bounds[i]:bounds[i + 1]]``, one after the other."""
    length = np.diff(bounds)
    n = len(length)
    head = np.zeros(n, dtype=HEADER)
    head["length"] = length
    sizes = np.frombuffer(length.astype("<u8").tobytes(), dtype=np.uint8)
    head["crc"] = masked(crc32c(sizes, np.arange(n + 1) * 8))
    foot = masked(crc32c(data, bounds)).astype("<u4")
    out = np.empty(int(length.sum()) + 16 * n, dtype=np.uint8)
    begin = np.append(0, np.cumsum(length + 16))[:-1]
    out[(begin[:, None] + np.arange(12)).ravel()] = head.view(np.uint8)
    out[(begin[:, None] + 12 + length[:, None] + np.arange(4)).ravel()] = foot.view(np.uint8)
    out[np.arange(bounds[0], bounds[-1]) + np.repeat(begin + 12 - bounds[:-1], length)] = data[bounds[0]:bounds[-1]]
    return out


def unframed(raw: np.ndarray, offsets: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The data of the records at these offsets and its bounds; both checksums are verified."""
    n = len(offsets)
    bounds = np.append(0, np.cumsum(length))
    head = raw[(offsets[:, None] + np.arange(12)).ravel()].view(HEADER)
    sizes = np.ascontiguousarray(head["length"]).view(np.uint8)
    data = raw[np.arange(bounds[-1]) + np.repeat(offsets + 12 - bounds[:-1], length)]
    foot = raw[(offsets[:, None] + 12 + length[:, None] + np.arange(4)).ravel()].view("<u4")
    good = (head["length"] == length.astype("<u8")) & (head["crc"] == masked(crc32c(sizes, np.arange(n + 1) * 8)))
    if not (good & (foot == masked(crc32c(data, bounds)))).all():
        raise ValueError("a record does not match its checksum")
    return data, bounds


def write_records(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                  end: int = END, id_bytes: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents in ascending order of key. Returns ``part, path, records, tokens``, a row for each file, settled."""
    if id_bytes not in (2, 4):
        raise ValueError("ids take 2 or 4 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(vocabulary)
        part = TaskContext.get().partitionId()
        system, top = pafs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        own = f"{top}/.part-{part:06d}-{uuid.uuid4().hex}"
        offset = tokens = 0
        entries = []
        with system.open_output_stream(own + ".data") as out:
            for batch in batches:
                for low, high, texts in slices(batch.column(1)):
                    ids, bounds = encoder.encode(texts, end)
                    if id_bytes == 2 and len(ids) and ids.max() >= 1 << 16:
                        raise ValueError("the vocabulary needs 4 bytes an id")
                    out.write(frames(ids.astype(f"<u{id_bytes}").view(np.uint8), bounds * id_bytes).tobytes())
                    entry = np.zeros(high - low, dtype=ENTRY)
                    count = np.diff(bounds)
                    entry["offset"] = offset + np.append(0, np.cumsum(count * id_bytes + 16))[:-1]
                    entry["count"] = count
                    keys = batch.column(0).slice(low, high - low).cast(pa.int64())
                    entry["has_key"] = keys.is_valid().to_numpy(zero_copy_only=False)
                    entry["key"] = keys.fill_null(0).to_numpy()
                    entries.append(entry)
                    offset += int((count * id_bytes + 16).sum())
                    tokens += int(count.sum())
        index = np.concatenate(entries) if entries else np.zeros(0, dtype=ENTRY)
        with system.open_output_stream(own + ".index") as out:
            out.write(index.tobytes())
        path = f"{top}/part-{part:06d}"
        for kind in (".data", ".index"):
            system.move(own + kind, path + kind)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"part-{part:06d}"],
                                          "records": [len(index)], "tokens": [tokens]})

    files = blocks_for(docs, text, file_bytes)
    keyed = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    order = [F.col("k").asc_nulls_last(), F.xxhash64("t")]
    dealt = keyed.repartitionByRange(files, *order).sortWithinPartitions(F.col("k").asc_nulls_last(), "t")
    return settled(dealt.mapInArrow(run, "part int, path string, records long, tokens long"))


def read_records(files: DataFrame, folder: str, id_bytes: int = 2, with_ids: bool = False) -> DataFrame:
    """Read the records back by their index: ``key, start, n_tokens, ids_crc32`` (and ``ids``, little-endian 32-bit).

    ``start`` is the number of ids in all records before. ``files`` is what the writer returned: one row for each file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(f"{top}/{path}.index") as f:
                    index = np.frombuffer(f.read(), dtype=ENTRY)
                with system.open_input_file(f"{top}/{path}.data") as f:
                    at = 0
                    while at < len(index):
                        stop = max(at + 1, int(np.searchsorted(index["offset"], index["offset"][at] + READ_BYTES)))
                        some = index[at:stop]
                        length = some["count"].astype(np.int64) * id_bytes
                        first = int(some["offset"][0])
                        size = int(some["offset"][-1]) + int(length[-1]) + 16 - first
                        raw = np.frombuffer(f.read_at(size, first), dtype=np.uint8)
                        data, bounds = unframed(raw, some["offset"].astype(np.int64) - first, length)
                        ids = data.view(f"<u{id_bytes}").astype("<u4").view(np.uint8).data
                        parts = [ids[4 * a:4 * b] for a, b in zip((bounds[:-1] // id_bytes).tolist(), (bounds[1:] // id_bytes).tolist())]
                        counts = some["count"].astype(np.int64)
                        columns = [pa.array(some["key"], mask=some["has_key"] == 0), pa.array(start + np.cumsum(counts) - counts), pa.array(counts),
                                   pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                        names = ["key", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        start += int(counts.sum())
                        at = stop

    # one row for each file, so one task can hold them all
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(F.col("part").alias("p"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    placed = files.join(F.broadcast(starts), F.col("part") == F.col("p")).select("path", "start")
    return placed.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def round_trip(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
               end: int = END, folder: str | None = None) -> DataFrame:
    """Write the records to a new folder (in the shared folder unless given) and read them back."""
    folder = folder or f"{shared_folder(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    return read_records(write_records(docs, folder, key, text, vocabulary, end), folder)
