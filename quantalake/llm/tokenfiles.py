"""Flat token-id files with 64-bit document offsets, written by range of document id and memory-mapped on reading.

A part has three files, named by the manifest: ``part-N-X.tokens`` (unsigned 16- or 32-bit little-endian ids, documents end to end),
``part-N-X.offsets`` (int64, one more than documents: where each begins in the part) and ``part-N-X.ids`` (int64 document
ids; the smallest int64 stands for null). ``manifest`` (Parquet, a row a part) has counts, the id width, and ``base``:
the ids in all parts before, a prefix sum over the parts.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalake.llm.common import release, tidy
from quantalake.llm.tokens import Encoder, blocks, code_of, kind_of

NULL_ID = -(1 << 63)
#: Bytes of text that are encoded at a time and of a part, and documents and ids that are read at a time.
BLOCK_BYTES, PART_BYTES, SLICE_DOCS, SLICE_IDS = 20 << 20, 64 << 20, 2048, 1 << 21
_PART = "part string, first_id long, tie long, docs long, tokens long, width int"


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of ``id_col``; return the manifest.

    ``out_dir``: a new folder, as a path or URI that every executor can write, in the cluster's shared store.

    Defined cases: a null or empty text is the end id alone; null document ids come first; rows that share an id are
    ordered by a hash of their text, and repeated rows stay; an empty table gives no parts.

    Parts are about PART_BYTES of text; rows that are equal in id and text are in one, which streams through its task.
    Each run of a task streams one range of ids into files of a name of its own, and the manifest names those of the run
    that Spark took: a task that runs again leaves files that nothing reads, and replaces none. The driver sees one row
    a part.
    """
    kind, code = kind_of(tokenizer_path), code_of(tokenizer_path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(out_dir)
        own, end = Encoder(tokenizer_path, kind, code), np.array([end_id], code).tobytes()
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        files, ids, offsets, at, key = {}, array("q"), array("q", [0]), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if not files:
                fs.create_dir(root, recursive=True)
                files = {x: fs.open_output_stream(f"{root}/{name}.{x}") for x in ("tokens", "offsets", "ids")}
                key = (batch[0][0].as_py(), batch[1][0].as_py())
            for part in blocks(batch, 2, BLOCK_BYTES):
                encoded = own.encode(part[2])
                files["tokens"].write(b"".join(x for ids_of in encoded for x in (ids_of, end)))
                places = at + np.cumsum([len(x) + 1 for x in encoded], dtype=np.int64)
                at = int(places[-1])
                offsets.frombytes(places.tobytes())
                ids.frombytes(np.array([NULL_ID if x is None else x for x in part[0].to_pylist()], np.int64).tobytes())
                del encoded
                release()
        if files:
            files["offsets"].write(offsets.tobytes())
            files["ids"].write(ids.tobytes())
            for f in files.values():
                f.close()
            row = [[name], [key[0]], [key[1]], [len(ids)], [at], [len(end)]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["part", "first_id", "tie", "docs", "tokens", "width"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"), F.col(f"`{text_col}`").cast("string").alias("t"))
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    wanted = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    ordered = rows.repartitionByRange(wanted, "d", "tie").sortWithinPartitions("d", "tie")
    parts = ordered.mapInArrow(tidy(write), _PART).collect()  # a row a part
    parts.sort(key=lambda r: (r.first_id is not None, r.first_id or 0, r.tie))
    bases = np.concatenate([[0], np.cumsum([r.tokens for r in parts], dtype=np.int64)])
    manifest = [(r.part, r.docs, r.tokens, r.width, int(b), k) for k, (r, b) in enumerate(zip(parts, bases, strict=False))]
    out = docs.sparkSession.createDataFrame(manifest, "part string, docs long, tokens long, width int, base long, nth int")
    out.coalesce(1).write.parquet(f"{out_dir}/manifest")
    return out


class _File:
    """Slices of a file as arrays: of a memory map where the store is local, by reads of their own elsewhere."""

    def __init__(self, fs, path: str, kind):
        from pyarrow.fs import LocalFileSystem

        self.kind = np.dtype(kind)
        local = isinstance(fs, LocalFileSystem)
        self.map, self.file = (np.memmap(path, self.kind, "r"), None) if local else (None, fs.open_input_file(path))

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[at]
        self.file.seek(at.start * self.kind.itemsize)
        return np.frombuffer(self.file.read((at.stop - at.start) * self.kind.itemsize), self.kind)


def _slices(offsets: _File, docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """The first document of each slice and its offsets: SLICE_DOCS documents and SLICE_IDS ids, or one longer one."""
    a = 0
    while a < docs:
        cuts = np.asarray(offsets[a : min(docs, a + SLICE_DOCS) + 1])
        n = max(1, int(np.searchsorted(cuts, cuts[0] + SLICE_IDS, "right")) - 1)
        yield a, cuts[: n + 1]
        a += min(n, len(cuts) - 1)


def read_token_files(spark: SparkSession, out_dir: str, keep_tokens: bool = False) -> DataFrame:
    """A row a document: doc_id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` and, on
    request, ``tokens`` (array of int). Parts are read by tasks, each from the shared store, a slice at a time."""
    manifest = spark.read.parquet(f"{out_dir}/manifest")
    parts = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", tokens array<int>" * keep_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(out_dir)
        for batch in batches:
            for row in batch.to_pylist():
                tokens = _File(fs, f"{root}/{row['part']}.tokens", f"<u{row['width']}")
                offsets, numbers = _File(fs, f"{root}/{row['part']}.offsets", "<i8"), _File(fs, f"{root}/{row['part']}.ids", "<i8")
                for a, cuts in _slices(offsets, row["docs"]):
                    ids = np.asarray(numbers[a : a + len(cuts) - 1])
                    block = tokens[int(cuts[0]) : int(cuts[-1])].astype("<u4")
                    local = (cuts - cuts[0]).tolist()
                    crc = [zlib.crc32(block[i:j]) for i, j in zip(local, local[1:], strict=False)]
                    columns = [pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(row["base"] + cuts[:-1]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if keep_tokens:
                        columns.append(pa.ListArray.from_arrays(pa.array(local, pa.int32()), pa.array(block.astype(np.int32))))
                        names.append("tokens")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return manifest.select("part", "docs", "width", "base", "nth").repartitionByRange(parts, "nth").mapInArrow(tidy(read), schema)
