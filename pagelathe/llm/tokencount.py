"""Token counts: flat token files without an index, scanned for end-of-document identifiers block by block."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.llm.common import cut, shared_dir

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Identifier that ends a document; identifiers are little-endian, two bytes each.
END, DTYPE = 50256, "<u2"


@lru_cache(2)
def _encoder(path: str):
    """The public byte-level tokenizer whose ranks lie at `path`."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, on any store that pyarrow knows."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def write_files(docs: DataFrame, folder: str, ranks: str = RANKS, file_bytes: int = 64 << 20) -> DataFrame:
    """Encode the texts of (doc_id, text) into flat files below `folder`: each document's identifiers, then END. Back comes (file, ordinal, doc_id), once written.

    A file is named by its partition and written aside until it is whole, so a task that runs again replaces it by the
    same bytes. Null texts are empty. Files end at about `file_bytes`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _store(folder)
        task = TaskContext.get()
        encode, k, held, size, ids = _encoder(ranks).encode_ordinary, 0, [], 0, []

        def flush() -> pd.DataFrame:
            name = f"tokens-{task.partitionId():06d}-{k:04d}.bin"
            aside = f"{top}/.{name}-{task.taskAttemptId()}"
            with store.open_output_stream(aside) as out:
                for h in held:
                    out.write(h)
            store.move(aside, f"{top}/{name}")
            return pd.DataFrame({"file": name, "ordinal": np.arange(len(ids)), "doc_id": ids})

        for x in batches:
            for doc, text in zip(x["doc_id"], x["text"], strict=True):
                b = np.array([*encode(text or ""), END], DTYPE).tobytes()
                held.append(b)
                ids.append(None if pd.isna(doc) else int(doc))
                size += len(b)
                if size >= file_bytes:
                    yield flush()
                    k, held, size, ids = k + 1, [], 0, []
        if held:
            yield flush()

    store, top = _store(folder)
    store.create_dir(top, recursive=True)
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "file string, ordinal long, doc_id long"))


def scan_files(spark: SparkSession, folder: str, end: int = END, dtype: str = DTYPE, block_bytes: int = 4 << 20) -> DataFrame:
    """(file, ordinal, n_tokens) of each document in the flat files below `folder`.

    Blocks are searched for `end` each by itself, by ranges of the file; a running sum over a file's blocks then gives
    each block the documents before it and the tokens that its first document has from blocks before. Tokens after a
    file's last `end` are a document of their own. Empty files and an empty folder have no documents.
    """
    width = np.dtype(dtype).itemsize
    step = block_bytes // width * width
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    blocks = files.where(f"length >= {width}").select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - width, F.lit(step).cast("long"))).alias("block", "at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for path, length, block, at in x[["path", "length", "block", "at"]].itertuples(index=False):
                store, name = _store(path)
                with store.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(min(step, (length - at) // width * width), at), dtype)
                seps = np.flatnonzero(ids == end)
                n = np.diff(np.concatenate(([-1], seps, [len(ids)]))) - 1
                yield pd.DataFrame({"file": name.rpartition("/")[2], "block": block, "k": np.arange(len(n)), "n": n, "closed": np.arange(len(n)) < len(seps)})

    found = cut(blocks.repartition("path", "block").mapInPandas(run, "file string, block long, k long, n long, closed boolean"))
    by = found.groupBy("file", "block").agg(F.sum(F.col("closed").cast("long")).alias("seps"), F.sum(F.when(~F.col("closed"), F.col("n"))).alias("tail"))
    w = Window.partitionBy("file").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({"ordinal": F.coalesce(F.sum("seps").over(before), F.lit(0)), "tails": F.coalesce(F.sum("tail").over(before), F.lit(0))})
    by = by.withColumn("carry", F.col("tails") - F.coalesce(F.last(F.when(F.col("seps") > 0, F.col("tails")), ignorenulls=True).over(before), F.lit(0)))
    by = by.withColumn("final", F.lead("block").over(w).isNull()).drop("seps", "tail", "tails")
    out = found.join(by, ["file", "block"]).withColumn("n", F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0))
    return out.where(F.col("closed") | (F.col("final") & (F.col("n") > 0))).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), F.col("n").alias("n_tokens"))


def count(docs: DataFrame, ranks: str = RANKS, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_tokens): one row per row of `docs`, by way of flat files in the shared folder.

    Null and empty texts have 0 tokens, repeated rows stay, other columns play no part.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    written = write_files(docs, folder, ranks)
    return written.join(scan_files(spark, folder, block_bytes=block_bytes), ["file", "ordinal"]).select("doc_id", "n_tokens")
