"""Operator 5, token counts by a separator scan of flat token files.

A token file is nothing but little-endian ids; a document ends at an end-of-document id. Files are read in blocks of fixed
size, each by itself; a block's separators are found by one vectorised comparison. A prefix scan over the blocks of a file (how
many separators came before, and where the last one was) stitches documents that reach over blocks. The scan sees one narrow
row for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import scratch, shared_dir, small

END, WIDTH, BLOCK_TOKENS, FILE_TOKENS = 50256, 2, 1 << 20, 1 << 23


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", end: int = END, width: int = WIDTH, file_tokens: int = FILE_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """Tokenize into flat files below ``folder`` (any place pyarrow.fs can write); returns (file, tokens, documents: [doc_id]).

    The result lists what counts: files of task attempts that were lost are not in it. A text with an id that is the end id or
    does not fit into ``width`` bytes raises a ValueError: its file could not be read back.
    """
    if end > np.iinfo(np.dtype(f"<u{width}")).max:
        raise ValueError(f"the end id {end} does not fit into {width} bytes")
    path = tokenizer or tokens.default_path()
    kind = np.dtype(f"<u{width}")
    schema = f"file string, tokens long, documents array<{docs.schema[doc_id].dataType.simpleString()}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        part, held, size, names, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}", [], 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, names, at
            with store.open_output_stream(f"{root}/{part}-{at:05d}.bin") as out:
                for x in held:
                    out.write(x)
            listed = pa.concat_arrays(names)
            row = pa.RecordBatch.from_arrays([pa.array([f"{part}-{at:05d}.bin"]), pa.array([size]), pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)], names=["file", "tokens", "documents"])
            held, size, names, at = [], 0, [], at + 1
            return row

        for b in small(batches, caches=True):
            for got in tokens.ids(path, True).of([x.decode() for x in b.column("raw").to_pylist()]):
                ids = np.frombuffer(got, np.uint32)
                if len(ids) and (int(ids.max()) > np.iinfo(kind).max or (ids == end).any()):
                    raise ValueError(f"an id of a text is {end} or does not fit into {width} bytes")
                held.append(np.append(ids, np.uint32(end)).astype(kind).tobytes())
                size += len(held[-1]) // width
            names.append(b.column("doc_id"))
            if size >= file_tokens:
                yield flush()
        if names:
            yield flush()
        tokens.ids(path, True).rest()

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw")).mapInArrow(run, schema)


def scan(files: DataFrame, folder: str, end: int = END, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, first_token, n_tokens, ended) of every document in ``files`` (file, tokens), the end id not counted.

    Tokens after a file's last end id are a document with ``ended`` false. An empty document (two end ids in a row) has no
    tokens; an empty file has no documents.
    """
    kind = np.dtype(f"<u{width}")
    blocks = files.where("tokens > 0").select("file", "tokens", F.posexplode(F.sequence(F.lit(0), F.col("tokens") - 1, F.lit(block_tokens))).alias("block", "begin"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for b in batches:
            for r in b.to_pylist():
                n = min(block_tokens, r["tokens"] - r["begin"])
                with store.open_input_file(f"{root}/{r['file']}") as f:
                    ids = np.frombuffer(f.read_at(n * width, r["begin"] * width), kind)
                if len(ids) != n:
                    raise OSError(f"{r['file']}: {len(ids)} of {n} tokens at {r['begin']}")
                at = np.flatnonzero(ids == end) + r["begin"]
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]]), pa.array([r["tokens"]]), pa.array([r["block"]], pa.int32()), pa.array([at.tolist()], pa.list_(pa.int64()))], names=["file", "tokens", "block", "ends"])

    found = scratch(blocks.repartition("file", "block").mapInArrow(find, "file string, tokens long, block int, ends array<long>"), "tokens-ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.size("ends") > 0, F.array_max("ends"))).over(before)
    stitched = found.select("file", "tokens", "block", "ends", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("base"), F.coalesce(last, F.lit(-1)).alias("last"))
    one = stitched.select("file", "base", "last", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("last")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    ended = one.select("file", (F.col("base") + F.col("k")).alias("ordinal"), start.alias("first_token"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = found.groupBy("file").agg(F.first("tokens").alias("tokens"), F.sum(F.size("ends")).cast("long").alias("ordinal"), F.coalesce(F.max(F.array_max("ends")), F.lit(-1)).alias("last"))
    open_ = tail.where("last + 1 < tokens").select("file", "ordinal", (F.col("last") + 1).alias("first_token"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(open_)


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", end: int = END, width: int = WIDTH, file_tokens: int = FILE_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens): write the documents as token files, scan these, and name what was found in the order of writing.

    Null and empty texts have no tokens. Repeated rows and null ids get a row each. An empty table gives an empty result.
    """
    folder = shared_dir(docs.sparkSession, "token-files")
    files = scratch(write_token_files(docs, folder, doc_id, text, end, width, file_tokens), "tokens-files")
    found = scan(files.select("file", "tokens"), folder, end, width, block_tokens)
    names = files.select("file", F.posexplode("documents").alias("ordinal", "doc_id"))
    return names.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
