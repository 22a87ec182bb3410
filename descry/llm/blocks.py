"""Blocks of documents with a word dictionary each: how distinct words meet over the whole corpus.

A block holds about `block_bytes` of whole documents. Its words are numbered by falling frequency
within the block; the sequence of numbers stays with the block, and only the distinct words travel,
packed by bucket of their hash, so a word that fills a third of the corpus travels once a block.

The documents should come from a scan (or a written table): block numbers are those of the input
partitions, and a task that runs again must see the same rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.llm._shared import CHUNK, pack, pack_words, shuffle_partitions

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Buckets of the word hash for each shuffle partition.
BUCKETS_EACH = 2


def blocks(docs: DataFrame, words_of: Callable[[list], Iterator[list] | pa.ListArray], keys: list[str], text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, bucket, keys, payload) of two kinds.

    bucket -1, one a block: the key columns of its documents as arrays, and packed (words in each
    document, all words' numbers, bucket of each number). Others: the block's distinct words of that
    bucket, packed, in the order of their numbers. words_of: gives the words (bytes or str) of each
    of a list of texts (None for null), one list after the other or all lists as an Arrow array of lists of bytes.
    """
    n_buckets = BUCKETS_EACH * shuffle_partitions(docs.sparkSession)
    key_fields = [T.StructField(k, T.ArrayType(docs.schema[k].dataType)) for k in keys]

    def close(block: int, ids: list[list], counts: list[int], numbers: list[np.ndarray], words: dict) -> Iterator[pa.RecordBatch]:
        seq = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
        order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        names = list(words)
        ranked = [w.encode() if isinstance(w := names[i], str) else w for i in order.tolist()]
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in ranked), np.int64, len(ranked))
        yield row(block, -1, ids, pack(np.array(counts), place[seq], bucket))
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=n_buckets))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield row(block, int(bucket[by[a]]), None, pack_words([ranked[i] for i in by[a:b].tolist()]))

    def row(block: int, bucket: int, ids: list[list] | None, payload: bytes) -> pa.RecordBatch:
        cols = [pa.array([None if ids is None else x], pa.list_(t)) for x, t in zip(ids or [None] * len(keys), types, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), *cols, pa.array([payload], pa.binary())], names=["block", "bucket", *keys, "payload"])

    types: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        fresh = lambda: ([[] for _ in keys], [], [], defaultdict())
        ids, counts, numbers, words = fresh()
        words.default_factory = words.__len__
        for batch in batches:
            types[:] = [batch.column(i).type for i in range(len(keys))]
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            texts = batch.column(len(keys))
            at, since, lengths = 0, held, pc.utf8_length(texts).fill_null(0).to_pylist()
            for i, length in enumerate(lengths):
                held += length
                if held < min(block_bytes, since + CHUNK) and i + 1 < len(lengths):
                    continue
                for col, out in zip(columns, ids, strict=True):
                    out += col[at : i + 1]
                for n, found in numbered(words_of(texts.slice(at, i + 1 - at).to_pylist()), words):
                    counts += n
                    numbers.append(found)
                at, since = i + 1, held
                if held >= block_bytes:
                    yield from close(block, ids, counts, numbers, words)
                    block, held, since = block + 1, 0, 0
                    ids, counts, numbers, words = fresh()
                    words.default_factory = words.__len__
        if counts:
            yield from close(block, ids, counts, numbers, words)

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), *key_fields, T.StructField("payload", T.BinaryType())])
    return docs.select(*keys, F.col(text_col).cast("string")).mapInArrow(run, schema)


def numbered(found: Iterator[list] | pa.ListArray, words: dict) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words in each of some texts, and the numbers that `words` gives them in order of their first places."""
    if isinstance(found, pa.ListArray):
        each = found.flatten().dictionary_encode()
        _, offsets, data = each.dictionary.buffers()
        ends = np.frombuffer(offsets, np.int32, len(each.dictionary) + 1).tolist() if len(each.dictionary) else []
        data, seq = data.to_pybytes() if ends else b"", each.indices.to_numpy()
        new = [data[a:b] for a, b in pairwise(ends)]
        if words:
            seq = np.fromiter(map(words.__getitem__, new), np.int32, len(new))[seq]
        else:
            words.update(zip(new, range(len(new)), strict=True))
        yield found.value_lengths().fill_null(0).to_pylist(), seq
        return
    for x in found:
        yield [len(x)], np.fromiter(map(words.__getitem__, x), np.int32, len(x))


def places(bucket: np.ndarray) -> dict[int, np.ndarray]:
    """For each bucket, the numbers of its words in the order they were packed."""
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by].astype(np.int64), prepend=-1, append=-2))
    return {int(bucket[by[a]]): by[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
