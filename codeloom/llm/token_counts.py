"""Token counts by a separator scan of flat, unindexed token files.

A token file is nothing but little-endian 16-bit ids, documents one after another, each ended by ``END``; there is no
index. The scan cuts files into blocks of ``BLOCK`` ids, finds the separators of each block with one vectorised
comparison, and stitches documents that cross blocks with a prefix scan over the blocks of a file: a block hands on
the ids after its last separator, or all its ids and what it was handed if it has none.

Files live in the folder all executors share and are written under a task's own name, then renamed, so a task that
runs again leaves the same file. Defined results: null and empty texts count 0 ids; what follows a file's last
separator counts as a document if it isn't empty; empty files and tables give no rows; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, new_folder, read_table, stage, strings
from .subwords import END, VOCABULARY, encoder

#: Ids a block holds, and bytes after which a task begins another file.
BLOCK, FILE_BYTES = 4 << 20, 512 << 20
WIDTH = 2


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files; the (staged) manifest says which document is a file's ordinal-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        files, root = _files(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        number, size, ordinal, out = 0, 0, 0, None

        def close():
            if out is not None:
                out.close()
                files.move(f"{root}/.{part}-{number}-{attempt}", f"{root}/{part:06d}-{number:04d}.bin")

        for b in batches:
            names, places = [], []
            for t in strings(b.column(1)):
                if out is None or size >= file_bytes:
                    close()
                    number, size, ordinal = number + (out is not None), 0, 0
                    out = files.open_output_stream(f"{root}/.{part}-{number}-{attempt}")
                ids = np.array([*encode(t), END], "<u2")
                out.write(ids.tobytes())
                size += ids.nbytes
                names.append(f"{part:06d}-{number:04d}.bin")
                places.append(ordinal)
                ordinal += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(places, pa.int64())], names=["doc_id", "file", "ordinal"])
        close()

    files, root = _files(folder)
    files.create_dir(root, recursive=True)
    return stage(map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text), run, "doc_id long, file string, ordinal long"), "manifest")


def scan_token_files(spark: SparkSession, folder: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the folder's ``.bin`` files; separators aren't counted."""
    from pyarrow import fs

    files, root = _files(folder)
    found = [(x.base_name, x.size // WIDTH) for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".bin")]
    sizes = spark.createDataFrame(found, "file string, n long") if found else spark.createDataFrame([], "file string, n long")
    # One row per block, made on the executors.
    blocks = sizes.where("n > 0").select("file", "n", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n") - 1) / block).cast("long"))).alias("block")).repartition("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for b in batches:
            for file, n, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with files.open_input_file(f"{root}/{file}") as f:
                    ids = np.frombuffer(f.read_at(min(block, n - k * block) * WIDTH, k * block * WIDTH), "<u2")
                at = np.flatnonzero(ids == end)
                lengths = np.diff(at, prepend=-1) - 1
                tail = len(ids) - 1 - (int(at[-1]) if len(at) else -1)
                yield pa.RecordBatch.from_pydict({"file": pa.array([file]), "block": pa.array([k], pa.int64()), "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64())), "tail": pa.array([tail], pa.int64()), "last": pa.array([(k + 1) * block >= n])})

    cut = map_arrow(blocks, run, "file string, block long, lengths array<long>, tail long, last boolean")
    before = Window.partitionBy("file").orderBy("block")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("ends", F.size("lengths").cast("long")).withColumn("first", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    # A run is a block with a separator (or a file's first) and the blocks after it up to the next one with a separator,
    # which takes what they hand on: the sum of their tails.
    cut = cut.withColumn("run", F.coalesce(F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(earlier), F.lit(0)))
    cut = cut.withColumn("handed", F.coalesce(F.lag("tail").over(before), F.lit(0)))
    cut = cut.withColumn("carry", F.sum("handed").over(Window.partitionBy("file", "run").orderBy("block")))
    ended = F.when((F.col("last")) & (F.col("tail") > 0), F.concat("lengths", F.array("tail"))).otherwise(F.col("lengths"))
    docs = cut.select("file", "first", "carry", F.posexplode(ended).alias("pos", "length"))
    return docs.select("file", (F.col("first") + F.col("pos")).alias("ordinal"), (F.col("length") + F.when(F.col("pos") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    manifest = write_token_files(read_table(spark, sf_dir, "documents"), folder)
    # both sides grow with the corpus, however small the manifest's files look
    return scan_token_files(spark, folder).join(manifest.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
