"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are cut into pre-tokens; each block keeps its pre-tokens' positions as numbers into its
own list of distinct pre-tokens. The distinct pre-tokens are shuffled by hash, each is encoded once
in its partition, the ids go back to the blocks that hold it, and every document is reassembled by
position. Decoding joins the token-byte table: the distinct ids of a block are joined with it, and
the block's documents are put together from what came back.

Null text: encoded as empty (no ids). Null id: kept. Repeated rows: one result each. Extra columns
of the input are not carried on. Empty table: no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.llm._shared import pack, shuffle_partitions, unpack, unpack_words, written
from descry.llm.blocks import BLOCK_BYTES, blocks, places


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the pair of lowest rank, the leftmost of equals, until none is left."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n, none = len(word), 1 << 40
    if n <= 48:
        parts = [word[i : i + 1] for i in range(n)]
        rank = [ranks.get(word[i : i + 2], none) for i in range(n - 1)]
        while rank and (least := min(rank)) < none:
            i = rank.index(least)
            parts[i] += parts.pop(i + 1)
            rank.pop(i)
            if i:
                rank[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(rank):
                rank[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]
    end = list(range(1, n + 1))  # of the part that begins here; 0 where none begins
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e:
            continue
        end[i], end[j] = e, 0
        if e < n:
            before[e] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, digest: bool = False) -> DataFrame:
    """id and ids (array<int>) of each row's whole text; special strings are ordinary text.

    digest: the ids are also decoded, by a join of each block's distinct ids with the token-byte
    table, and only n_tokens, ids_sha256 (of the decimal ids joined by one space) and
    decoded_sha256 are returned in place of the ids.
    ranks_path: a file of base64 tokens and ranks, read on the driver and sent to the tasks; a
    vocabulary file has a fixed size.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType

    def pre_tokens(texts: list[str | None]) -> Iterator[list[str]]:
        find = regex.compile(pattern).findall
        for t in texts:
            yield find(t) if t else []

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines()) if a}
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            block, bucket, payload = [], [], []
            for k, b, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "payload")), strict=True):
                ids = []
                for w in unpack_words(data):
                    if (x := known.get(w)) is None:
                        x = known[w] = encode_word(w, ranks)
                    ids.append(x)
                block.append(k)
                bucket.append(b)
                payload.append(pack(np.fromiter(map(len, ids), np.int64, len(ids)), np.array([x for i in ids for x in i], np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], names=["block", "bucket", "payload"])

    def reassemble(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = next(i for i, b in enumerate(block.column("bucket").to_pylist()) if b < 0)
        counts, seq, bucket = unpack(block.column("payload")[row].as_py())
        at = places(bucket)
        n_ids = np.zeros(len(bucket), np.int64)
        got = []
        for b, data in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True):
            n, ids = unpack(data)
            n_ids[at[b]] = n
            got.append((at[b], ids))
        # The ids of all the block's words, end to end in the order the buckets came.
        words = np.concatenate([w for w, _ in got]) if got else np.empty(0, np.int64)
        flat = np.concatenate([i for _, i in got]).astype(np.int32) if got else np.empty(0, np.int32)
        first = np.zeros(len(bucket), np.int64)
        first[words] = np.cumsum(n_ids[words]) - n_ids[words]
        doc_ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        ids = block.column("id")[row].values
        held = bytes_of(block.column("tokens")[row]) if digest else {}
        decimal = {i: str(i) for i in held}
        out = []
        for a in range(0, len(counts), 256):
            z = min(a + 256, len(counts))
            s = seq[doc_ends[a] : doc_ends[z]]
            n = n_ids[s]
            ends = np.cumsum(n)
            take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[s] - (ends - n), n)
            offsets = np.concatenate([[0], ends])[doc_ends[a : z + 1] - doc_ends[a]]
            batch = pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[take]))], names=["id", "ids"])
            out.append(spelled(batch, held, decimal) if digest else batch)
        return pa.Table.from_batches(out)

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.greater_equal(batch.column("bucket"), 0)).select(["block", "bucket", "payload"])

    def tokens_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct ids of each block of a partition."""
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                met[k] = np.union1d(met.get(k, np.empty(0, np.uint32)), unpack(data)[1])
        for k, ids in met.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k), pa.int64()), pa.array(ids.astype(np.int32))], names=["block", "token"])

    # All uses of `dealt` and of `answers` read one shuffle each: no column is cut off and no filter
    # is pushed below it, which is why the rows with words are picked in a task function.
    n = shuffle_partitions(spark)
    dealt = blocks(rows, pre_tokens, ["id"], "text", block_bytes).repartition(n, "block")
    answer = "block long, bucket int, payload binary"
    answers = dealt.mapInArrow(word_rows, answer).repartition(n, "bucket").mapInArrow(encode_words, answer).repartition(n, "block")
    schema = T.StructType([T.StructField("id", id_type), *(DIGESTS if digest else [T.StructField("ids", T.ArrayType(T.IntegerType()))])])
    if digest:
        tokens = with_bytes(answers.mapInArrow(tokens_met, "block long, token int"), ranks_path).withColumnRenamed("block", "of")
        dealt = dealt.join(tokens, (F.col("block") == F.col("of")) & (F.col("bucket") < 0), "left").drop("of")
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(reassemble, schema)
    return out.withColumnRenamed("id", id_col)


def token_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """token and its bytes, one row for each token of the vocabulary file."""
    ranks = read_ranks(ranks_path)
    return spark.createDataFrame(pa.table({"token": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())}))


def with_bytes(met: DataFrame, ranks_path: str) -> DataFrame:
    """(block, tokens): the tokens met in each block with their bytes. The table has a vocabulary's size, so it is sent."""
    joined = met.join(F.broadcast(token_table(met.sparkSession, ranks_path)), "token", "left")
    return joined.groupBy("block").agg(F.collect_list(F.struct("token", "bytes")).alias("tokens"))


def bytes_of(tokens: pa.ListScalar) -> dict[int, bytes]:
    pairs = tokens.values
    if pairs is None:
        return {}
    out = dict(zip(pairs.field("token").to_pylist(), pairs.field("bytes").to_pylist(), strict=True))
    if lost := [i for i, b in out.items() if b is None]:
        raise ValueError(f"ids outside the token-byte table: {sorted(lost)[:5]}")
    return out


def spelled(batch: pa.RecordBatch, token: dict[int, bytes], decimal: dict[int, str] | None) -> pa.RecordBatch:
    """A batch of (id, ids) decoded; with the ids' decimal digits as digests."""
    n, digits, text = [], [], []
    for cell in batch.column(1):
        ids = cell.values.to_numpy(zero_copy_only=False).tolist() if cell.is_valid else []
        raw = b"".join(map(token.__getitem__, ids))
        n.append(len(ids))
        digits.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest() if decimal is not None else None)
        text.append(hashlib.sha256(raw).hexdigest() if decimal is not None else raw)
    if decimal is not None:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digits, pa.string()), pa.array(text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary())], names=["id", "decoded"])


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", id_col: str = "doc_id", block_tokens: int = 2_000_000) -> DataFrame:
    """id and the text's bytes as `decoded`, from the ids; an id outside the table is an error. Null ids: no tokens.

    Rows are dealt to blocks of about block_tokens ids, written once; a block's distinct ids are joined with the table.
    """
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    id_type = rows.schema["id"].dataType

    def close(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("ids").chunk(0)
        met = pc.unique(ids.flatten())
        one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (table.column("id").chunk(0), ids, met)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *one], names=["block", "id", "ids", "met"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(1).flatten())
            if n >= block_tokens:
                yield close(block, held)
                block, held, n = block + 1, [], 0
        if sum(b.num_rows for b in held):
            yield close(block, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = pa.RecordBatch.from_arrays([batch.column("id")[i].values, batch.column("ids")[i].values], names=["id", "ids"])
                yield spelled(block, bytes_of(batch.column("tokens")[i]), None)

    int_lists = T.ArrayType(T.IntegerType())
    dealt = written(rows.mapInArrow(deal, T.StructType([T.StructField("block", T.LongType()), T.StructField("id", T.ArrayType(id_type)), T.StructField("ids", T.ArrayType(int_lists)), T.StructField("met", int_lists)])), "id-blocks")
    tokens = with_bytes(dealt.select("block", F.explode("met").alias("token")), ranks_path)
    both = dealt.select("block", "id", "ids").join(tokens, "block", "left").select("id", "ids", "tokens")
    return both.mapInArrow(run, T.StructType([T.StructField("id", id_type), T.StructField("decoded", T.BinaryType())])).withColumnRenamed("id", id_col)
