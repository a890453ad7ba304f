"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by doc_id and sorted; every task writes its range as three flat little-endian files: ``<part>.ids``
(16 or 32 bits an id, by the size of the vocabulary), ``<part>.offsets`` (64-bit, one more than documents) and ``<part>.docs`` (64-bit
ids of documents). Bases of the parts are prefix sums over the manifest of one row per part, so a document's global place is its part's
base plus its offset. Files on a mounted path are memory-mapped when read; in another store they are read by range.

A task writes under a name of its own attempt and the manifest names the attempt that was counted, so lost executors, repeated and
speculative attempts leave no half-written part in the manifest.

Defined cases: null text is empty and holds its end id alone; null doc_id comes first (kept as a flag in the manifest's last file);
rows with equal doc_id are ordered by text; an empty table gives no part; other columns are ignored.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import stored
from .tokens import batches, codec

NULL_ID = np.iinfo("int64").min
MANIFEST = "part int, name string, docs long, ids long, width int"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(folder: str):
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _uri(folder: str) -> str:
    """Hadoop writes a local address with one slash where Arrow wants three."""
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents below ``folder`` and return the stored manifest: part, name, docs, ids, width, base."""
    folder = _uri(folder)

    def write(frames):
        coder, fs = codec(tokenizer), None
        context = TaskContext.get()
        part, name = context.partitionId(), f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        n, total, out = 0, 0, []
        for frame in batches(frames, "text"):
            if fs is None:
                fs, base = _open(folder)
                fs.create_dir(base, recursive=True)
                out = [fs.open_output_stream(f"{base}/{name}.{x}") for x in ("ids", "offsets", "docs")]
                out[1].write(np.zeros(1, "<u8").tobytes())
            ids = [np.append(x, coder.kind.type(end_id)) for x in coder.encode(frame["text"].tolist())]
            ends = total + np.cumsum([len(x) for x in ids])
            out[0].write(np.concatenate(ids).astype(coder.kind).tobytes())
            out[1].write(ends.astype("<u8").tobytes())
            out[2].write(frame["doc_id"].astype("int64").to_numpy().astype("<i8").tobytes())
            n, total = n + len(ids), int(ends[-1])
        for stream in out:
            stream.close()
        if n:
            yield pd.DataFrame([(part, name, n, total, coder.kind.itemsize)], columns=["part", "name", "docs", "ids", "width"])

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID)))
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stored(ordered.mapInPandas(write, MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)            # one row per part
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    based.write.parquet(f"{folder}/manifest")
    return based.sparkSession.read.parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, kernel, schema: str) -> DataFrame:
    """Apply ``kernel(doc_ids, starts, offsets, ids)`` to every part; ``ids`` is a memory map where the store allows it."""
    folder = _uri(folder)
    manifest = spark.read.parquet(f"{folder}/manifest")

    def read(frames):
        for frame in frames:
            fs, base = _open(folder)
            for row in frame.itertuples():
                path = f"{base}/{row.name}"
                load = lambda x, kind: np.frombuffer(fs.open_input_file(f"{path}.{x}").read(), kind)
                kind = np.dtype("<u2" if row.width == 2 else "<u4")
                if isinstance(fs, pafs.LocalFileSystem):
                    ids = np.memmap(f"{path}.ids", kind, "r", shape=(row.ids,))
                else:
                    ids = load("ids", kind)
                offsets = load("offsets", "<u8").astype("int64")
                yield from kernel(load("docs", "<i8"), row.base + offsets[:-1], offsets, ids)

    parts = manifest.select("name", "ids", "width", "base", F.col("part").alias("at"))
    # one row stands for a whole part: give each a task of its own
    return parts.repartitionByRange(max(1, manifest.count()), "at").mapInPandas(read, schema)


def _digests(doc_ids, starts, offsets, ids, step: int = 4096):
    for i in range(0, len(doc_ids), step):
        j = min(i + step, len(doc_ids))
        crc = [zlib.crc32(ids[offsets[k]:offsets[k + 1]].astype("<u4").tobytes()) for k in range(i, j)]
        frame = pd.DataFrame({"doc_id": pd.array(doc_ids[i:j], "Int64"), "start": starts[i:j], "n_tokens": np.diff(offsets[i:j + 1]), "ids_crc32": crc})
        frame.loc[doc_ids[i:j] == NULL_ID, "doc_id"] = pd.NA
        yield frame


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: its global start, number of ids and checksum of its ids as 32-bit integers."""
    return read_tokens(spark, folder, _digests, READ)


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id and the ids themselves."""
    def rows(doc_ids, starts, offsets, ids, step: int = 512):
        for i in range(0, len(doc_ids), step):
            j = min(i + step, len(doc_ids))
            yield pd.DataFrame({"doc_id": doc_ids[i:j], "ids": [ids[offsets[k]:offsets[k + 1]].astype("int32").tolist() for k in range(i, j)]})

    return read_tokens(spark, folder, rows, "doc_id long, ids array<int>")
