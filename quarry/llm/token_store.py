"""Token-ID output: flat unsigned integer files and 64-bit document offsets, memory-mapped.

A store is a folder with one pair of files per range of doc_id and a manifest:

* `N.ids`: the ids of the range's documents end to end, little-endian, 16 bits wide when every id fits, else 32.
* `N.idx`: the header `QTOK`, version, width of an id in bytes, number of documents and of ids (`<4sIIQQ`), then
  64-bit offsets into `N.ids` (documents + 1, in ids), the 64-bit doc_ids and a byte for each that is 1 where doc_id is null.
* `manifest.json`: files in order of doc_id with their counts and their base, the number of ids in all files before.

Only the manifest's one row per file reaches the driver; bases are prefix sums over it. A task's files carry its attempt's
number, and only files named by tasks that ended well enter the manifest, so a lost executor or a second attempt leaves
no wrong file in the store.

Defined results: null text counts as empty (one end id); null doc_id sorts first; rows with one doc_id are ordered by
text and kept all; an empty table makes a store without files; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.bpe import encoder
from quarry.llm.common import doc_columns, fresh_dir, local_path, open_fs

HEADER = "<4sIIQQ"
HEADER_SIZE = struct.calcsize(HEADER)
BATCH = 128


@dataclass(frozen=True)
class TokenStore:
    """A written store: its folder and the manifest's entries (file, documents, ids, base)."""

    uri: str
    files: tuple[dict, ...]


def _write(tokenizer: str, end_id: int, uri: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get()
        width = 2 if max(enc.n_ids - 1, end_id) < 1 << 16 else 4
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        end, counts, ids, out, system, path = np.array([end_id], "<u4").tobytes(), [], [], None, None, None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, BATCH):
                ids.append(keys.slice(at, BATCH).cast(pa.int64()))
                made = enc.ids(texts.slice(at, BATCH).to_pylist())
                counts.append(np.fromiter((len(x) // 4 + 1 for x in made), np.int64, len(made)))
                if out is None:
                    system, path = open_fs(uri)
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}.ids")
                flat = np.frombuffer(b"".join(x + end for x in made), "<u4")
                out.write(flat.astype("<u2").tobytes() if width == 2 else flat.tobytes())
        if out is None:
            return
        out.close()
        key, lengths = pa.concat_arrays(ids), np.concatenate(counts)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        nulls = np.asarray(key.is_null()).astype(np.uint8)
        with system.open_output_stream(f"{path}/{name}.idx") as f:
            f.write(struct.pack(HEADER, b"QTOK", 1, width, len(key), int(offsets[-1])))
            f.write(offsets.tobytes() + np.asarray(key.fill_null(0)).astype("<i8").tobytes() + nulls.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [name], "documents": [len(key)], "ids": [int(offsets[-1])]})

    return write


def write_store(docs: DataFrame, tokenizer: str, end_id: int, uri: str | None = None) -> TokenStore:
    """Encodes docs (doc_id, text), ends each document with end_id and writes the store in ascending doc_id order."""
    spark = docs.sparkSession
    uri = uri or fresh_dir(spark, "tokens")
    ordered = doc_columns(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(_write(tokenizer, end_id, uri), "part long, file string, documents long, ids long").collect()
    files, base = [], 0
    for row in sorted(rows):
        files.append({"file": row.file, "documents": row.documents, "ids": row.ids, "base": base})
        base += row.ids
    system, path = open_fs(uri)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"version": 1, "end_id": end_id, "ids": base, "files": files}).encode())
    return TokenStore(uri, tuple(files))


def open_store(uri: str) -> TokenStore:
    """The store that a manifest describes."""
    system, path = open_fs(uri)
    with system.open_input_stream(f"{path}/manifest.json") as f:
        return TokenStore(uri, tuple(json.loads(f.read())["files"]))


class Ranges:
    """The ids of a file that can't be mapped: a slice reads its own bytes only."""

    def __init__(self, file: pa.NativeFile, kind: np.dtype) -> None:
        self.file, self.kind = file, kind

    def __len__(self) -> int:
        return self.file.size() // self.kind.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        start, stop, _ = part.indices(len(self))
        return np.frombuffer(self.file.read_at((stop - start) * self.kind.itemsize, start * self.kind.itemsize), self.kind)


def read_file(uri: str, file: str) -> tuple[np.ndarray | Ranges, np.ndarray, list[int | None]]:
    """(ids, offsets, doc_ids) of one file; ids are memory-mapped where the folder is a local path, else ranges are read as they are asked for."""
    system, path = open_fs(uri)
    with system.open_input_stream(f"{path}/{file}.idx") as f:
        raw = f.read()
    magic, version, width, n, n_ids = struct.unpack_from(HEADER, raw)
    if magic != b"QTOK" or version != 1:
        raise ValueError(f"{file}.idx isn't an index of this format")
    offsets = np.frombuffer(raw, "<i8", n + 1, HEADER_SIZE)
    keys = np.frombuffer(raw, "<i8", n, HEADER_SIZE + 8 * (n + 1)).tolist()
    nulls = np.frombuffer(raw, np.uint8, n, HEADER_SIZE + 8 * (2 * n + 1))
    kind = f"<u{width}"
    if local := local_path(uri):
        ids = np.memmap(f"{local}/{file}.ids", kind, "r", shape=(n_ids,))
    else:
        ids = Ranges(system.open_input_file(f"{path}/{file}.ids"), np.dtype(kind))
    return ids, offsets, [None if null else key for key, null in zip(keys, nulls, strict=True)]


def _read(uri: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, offsets, keys = read_file(uri, file)
                for at in range(0, len(keys), 4096):
                    cuts = offsets[at : at + 4097]
                    flat = ids[cuts[0] : cuts[-1]].astype("<u4").tobytes()
                    edges = ((cuts - cuts[0]) * 4).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[at : at + 4096], pa.int64()),
                            pa.array(cuts[:-1] + base, pa.int64()),
                            pa.array(np.diff(cuts), pa.int64()),
                            pa.array([zlib.crc32(flat[a:b]) for a, b in zip(edges, edges[1:], strict=False)], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read


def read_store(spark: SparkSession, store: TokenStore) -> DataFrame:
    """doc_id, start, n_tokens and the ids' unsigned crc32 (as 32-bit integers), read back from the files."""
    rows = spark.createDataFrame([(x["file"], x["base"]) for x in store.files], "file string, base long")
    return rows.repartition(max(1, len(store.files))).mapInArrow(_read(store.uri), "doc_id long, start long, n_tokens long, ids_crc32 long")
