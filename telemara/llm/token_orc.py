"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.create.index": "true", "compression": "zstd"}


@functools.lru_cache(maxsize=4)
def tokenizer(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(data.decode())


#: Distinct words that a Python worker remembers, from task to task; then it starts anew.
REMEMBERED = 1_300_000


#: Python's str.split takes these for white space; the tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
CHUNKS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def chunks(text: str) -> list[str]:
    return CHUNKS.findall(text) if any(c in text for c in SEPARATORS) else text.split()


class Words:
    """The ids of the words met so far: each is encoded once, many to a call, and told apart by the tokens' places.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in a row.
    """

    def __init__(self, made):
        self.made = made
        self.clear()

    def clear(self):
        self.number = defaultdict(itertools.count().__next__)  # a word not met before gets the next number
        self.ids, self.start = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def learn(self, words: list[str], per: int = 400) -> None:
        runs = [words[i : i + per] for i in range(0, len(words), per)]
        for run, e in zip(runs, self.made.encode_batch([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ends = np.cumsum([len(w) + 1 for w in run])
            at = np.searchsorted(ends, np.array([o[0] for o in e.offsets], dtype=np.int64), side="right")
            self.ids.append(np.array(e.ids, dtype=np.int32))
            self.start.append(self.start[-1][-1] + np.cumsum(np.bincount(at, minlength=len(run))))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by end_id, and where each begins."""
        words, number = [chunks(t) for t in texts], self.number
        known = len(number)
        index = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in words]
        if len(number) > known:
            self.learn(list(itertools.islice(number, known, None)))
            self.ids, self.start = [np.concatenate(self.ids)], [np.concatenate(self.start)]
        start, closed = self.start[0], np.full(1, -1)
        row = np.concatenate([x for i in index for x in (i, closed)])
        sizes = np.where(row < 0, 1, np.diff(start)[row] if len(start) > 1 else 1)
        upto = np.cumsum(sizes)
        source = np.arange(upto[-1]) - np.repeat(upto - sizes, sizes) + np.repeat(np.where(row < 0, len(self.ids[0]), start[row]), sizes)
        return np.append(self.ids[0], np.int32(end_id))[source], np.r_[0, upto[row < 0]]


@functools.lru_cache(maxsize=1)
def remembered(data: bytes) -> Words:
    return Words(tokenizer(data))


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, partitions: int | None = None) -> None:
    """Writes (doc_id, n_tokens, ids) as ORC in ascending doc_id: the file names' order is the order of the ids.

    n_tokens, the length of ids, is a column of its own so that offsets are summed without reading any id.

    df has doc_id and text; null and empty texts hold the end id alone, null ids come first, further columns are
    not read. Texts move once, by range of doc_id; ties go by a hash of the text. An empty df leaves a table without rows.
    """
    spark = df.sparkSession
    with open(tokenizer_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))

    def run(batches):
        words = remembered(data.value)
        for batch in batches:
            texts = batch.column(1)
            for i, j in slices([len(t.as_buffer()) for t in texts], 3_000_000):
                if len(words.number) > REMEMBERED:
                    words.clear()
                ids, offsets = words.encode(texts[i:j].to_pylist(), end_id)
                lengths = pa.array(np.diff(offsets).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], lengths, pa.ListArray.from_arrays(offsets.astype(np.int32), ids)], names=["doc_id", "n_tokens", "ids"])

    rows.mapInArrow(run, "doc_id long, n_tokens int, ids array<int>").write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids), or only those of doc_ids: stripes and row groups without them are skipped by their metadata."""
    rows = spark.read.schema("doc_id long, n_tokens int, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def with_crc32(batches):
    """Replaces the last column, lists of ids, by the crc32 of each list's bytes, read where they lie."""
    for batch in batches:
        ids, at = batch.columns[-1].values.to_numpy().astype("<u4", copy=False), batch.columns[-1].offsets.to_pylist()
        crc = [zlib.crc32(ids[i:j]) for i, j in itertools.pairwise(at)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], names=[*batch.schema.names[:-1], "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files at path, start being the ids of all documents before it.

    Sums run over rows of three numbers: within a file, and over one row a file, which reads the lengths alone.
    """
    path_ = F.col("_metadata.file_path")
    part = F.regexp_extract(path_, r"part-(\d+)", 1).cast("long").alias("part")  # by number: beyond 99,999 names no longer sort
    name = F.element_at(F.split(path_, "/"), -1).alias("file")
    rows = read_tokens(spark, path).select(part, name, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "ids")
    rows = rows.mapInArrow(with_crc32, "part long, file string, block long, at long, doc_id long, n_tokens long, ids_crc32 long")
    before = "coalesce(sum(n) over (order by part, file rows between unbounded preceding and 1 preceding), 0)"
    files = read_tokens(spark, path).select("n_tokens", part, name).groupBy("part", "file").agg(F.sum("n_tokens").alias("n")).select("file", F.expr(before).alias("base"))
    inside = F.expr("coalesce(sum(n_tokens) over (partition by file order by doc_id, block, at rows between unbounded preceding and 1 preceding), 0)")
    return rows.withColumn("inside", inside).join(files, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
