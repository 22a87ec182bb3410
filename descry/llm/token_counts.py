"""Token counts of a lower-casing word BPE, by the whole-token shortcut.

The vocabulary strings that the merges turn into one token when they stand alone are found once,
before the job, by running the merges on each. A pre-token among them counts as one; only the
rest is merged. A map over the documents: no shuffle, and state of a fixed size.

Null text: counted as empty, 0 tokens. Null doc_id: kept. Repeated rows: one result each. Extra
columns of the input are not carried on.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: Words whose counts a task remembers at once.
REMEMBERED = 500_000
#: Up to so many symbols a plain scan for the next pair is faster than a heap.
SHORT = 32
#: Sigma is lower-cased as a single character, without the form it has at a word's end.
SIGMA = ("\u03a3", "\u03c3")
CONTROLS = regex.compile("[\x1c-\x1f]")
#: The counter of this worker, kept from one task to the next.
_kept: dict[int, Counter] = {}


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges: always the pair of lowest rank, the leftmost of equals."""
    n = len(symbols)
    if n < 2:
        return n
    if n <= SHORT:
        short, get, none = list(symbols), ranks.get, len(ranks)
        rank = [get(pair, none) for pair in zip(short, short[1:])]  # noqa: B905
        while rank and (least := min(rank)) < none:
            i = rank.index(least)
            short[i] += short.pop(i + 1)
            rank.pop(i)
            if i:
                rank[i - 1] = get((short[i - 1], short[i]), none)
            if i < len(rank):
                rank[i] = get((short[i], short[i + 1]), none)
        return len(short)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    sym: list[str | None] = list(symbols)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue
        sym[i], sym[j] = a + b, None
        left -= 1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        if (p := before[i]) >= 0 and (r := ranks.get((sym[p], sym[i]))) is not None:
            heapq.heappush(heap, (r, p, sym[p], sym[i]))
        if (q := after[i]) >= 0 and (r := ranks.get((sym[i], sym[q]))) is not None:
            heapq.heappush(heap, (r, i, sym[i], sym[q]))
    return left


class WordBpe:
    """What counting needs of a tokenizer file: its merges, patterns and special strings."""

    def __init__(self, spec: str):
        self.spec, j = spec, json.loads(spec)
        self.suffix = j["model"]["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        split = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]
        self.special = [t["content"] for t in j["added_tokens"]]
        self.vocabulary = list(j["model"]["vocab"])
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.bytes = {c: b for b, c in enumerate(byte_alphabet())}

    def symbols(self, word: str) -> list[str]:
        s = list(word.encode().decode("latin-1").translate(self.letters))
        s[-1] += self.suffix
        return s

    def alone(self) -> frozenset[str]:
        """Words that the merges prove to be one token each."""
        back, out = self.bytes, set()
        for v in self.vocabulary:
            if not v.endswith(self.suffix) or len(v) == len(self.suffix):
                continue
            body = v[: len(v) - len(self.suffix)]
            if all(c in back for c in body):
                s = [*body[:-1], body[-1] + self.suffix]
                if merge_count(s, self.ranks) == 1:
                    try:
                        out.add(bytes(back[c] for c in body).decode())
                    except UnicodeDecodeError:
                        continue
        return frozenset(out)


class _Counts(dict):
    """Tokens of a word; merged on first sight."""

    def __init__(self, bpe: WordBpe, alone: frozenset[str]):
        super().__init__(dict.fromkeys(alone, 1))
        self.bpe, self.alone = bpe, alone

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.alone) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.alone, 1))
        n = merge_count(self.bpe.symbols(word), self.bpe.ranks)
        if len(word) < 64:
            self[word] = n
        return n


class _ByWord(dict):
    """Tokens of what stands between white space: the sum over its pre-tokens."""

    def __init__(self, counts: _Counts, pattern: str):
        super().__init__()
        self.counts, self.find = counts, regex.compile(pattern).findall

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = sum(map(self.counts.__getitem__, self.find(word)))
        if len(word) < 64:
            self[word] = n
        return n


class Counter:
    """Counts the tokens of one text after another, as the library does."""

    def __init__(self, bpe: WordBpe, alone: frozenset[str]):
        self.bpe, self.counts = bpe, _Counts(bpe, alone)
        self.words = _ByWord(self.counts, bpe.pattern)
        self.parts = regex.compile("|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True)))) if bpe.special else None
        self.special = bpe.special

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.bpe.spec)

    def unassigned(self, text: str) -> int:
        """For a text with code points that Python's Unicode version has not: the library's tables say
        what is a letter, a capital or a composition."""
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        words = (bytes(map(self.bpe.bytes.__getitem__, piece)).decode() for piece, _ in pieces)
        return sum(map(self.counts.__getitem__, words))

    def plain(self, text: str) -> int:
        if not text.isascii():
            if "Cn" in map(unicodedata.category, set(text)):
                return self.unassigned(text)
            text = unicodedata.normalize("NFC", text).replace(*SIGMA)
        text = text.lower()
        # str.split() also parts at four control characters that the pattern takes for symbols.
        parts = [text] if CONTROLS.search(text) else text.split()
        return sum(map(self.words.__getitem__, parts))

    def __call__(self, text: str) -> int:
        if self.parts is not None and any(s in text for s in self.special):
            return len(self.parts.findall(text)) + sum(map(self.plain, self.parts.split(text)))
        return self.plain(text)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of each row's whole text.

    tokenizer: path of the tokenizer's JSON file, read on the driver and sent to the tasks; a
    vocabulary file has a fixed size.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    alone = WordBpe(spec).alone()
    sent = docs.sparkSession.sparkContext.broadcast((spec, alone))
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, alone = sent.value
        key = hash(spec)
        if key not in _kept:
            _kept.clear()
            _kept[key] = Counter(WordBpe(spec), alone)
        count = _kept[key]
        for batch in batches:
            texts = batch.column(1)
            n = [0 if (t := x.as_py()) is None else count(t) for x in texts]
            b = [0 if x is None else x for x in pc.binary_length(texts).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
