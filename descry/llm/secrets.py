"""Secret scan: fixed patterns, and a password guess-cost dynamic programme over credential values.

The programme finds the cheapest way to spell a value as dictionary words, dates, repeats, keyboard
walks and brute-force spans; costs are logarithms (base 10) of guesses and add up over the segments.
Dictionary words are the common passwords, then the words of the corpus itself by the number of
documents that hold them outside of credential values: in lower case, letters only, of any length,
in `min_docs` documents or more. They are sent to the tasks, so the rarest are left out, by whole
levels of their counts, where all together would measure over WORD_BYTES. Repeats are of blocks of
any length that are no repeats themselves.
A value after a credential name that costs at least `min_log10_guesses` is a finding of kind
"guess"; one that people or machines would guess sooner (a placeholder, a word with a year) is not.

Null text: as empty, no findings. Null doc_id: kept. Repeated rows: one result each. Extra columns
are not used. Very long values cost time in about proportion to their length times its logarithm squared
(repeats) and the number of lengths that words have.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.llm._shared import most_frequent_bytes, written

#: Fixed by the contract. `assign` ignores case in ASCII letters only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
KINDS = ("assign", "access", "hex", "guess")

#: Names before a value that make it a credential.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|access_?key|private_?key|auth|credentials?|bearer)["']?(?:\x20*[:=]\x20*|\x20+is\x20+)["']?([^\s"'<>,;]{6,})""",
    re.ASCII | re.IGNORECASE,
)
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer")
MIN_LOG10_GUESSES = 10.0

#: Words that guessers try first, most frequent first.
COMMON = (
    "password passw0rd admin welcome qwerty letmein login master hello monkey dragon secret test user "
    "guest root changeme default example sample your token key here placeholder none null true false "
    "pass word my the api access private public demo dummy temp foo bar baz summer winter spring "
    "autumn love god sun shine star iloveyou football baseball princess shadow super man bat michael "
    "jordan hunter killer trust no one server prod dev stage data base xxxx insert value string"
).split()


class Words(dict):
    """Guesses (log10) by word, and the lengths that words have, from short to long."""

    def __init__(self, costs: dict[str, float]):
        super().__init__(costs)
        self.lengths = sorted({len(w) for w in costs})


WORD_COST = Words({w: math.log10(i + 2) for i, w in enumerate(dict.fromkeys(COMMON))})
#: A word with signs for letters costs so much more.
LEET_COST = 0.6
#: Documents that make a word; bytes of all words that are sent to the tasks.
LEAST_DOCS, WORD_BYTES = 5, 2 << 20
#: Pairs of places that are compared at a time in the search for repeats.
PAIRS = 1 << 20
LEET = str.maketrans("@4301!$57", "aaeoiisst")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {(a, b) for r in ROWS for a, b in [*zip(r, r[1:]), *zip(r[1:], r)]} | {(a, b) for x, y in zip(ROWS, ROWS[1:]) for i, a in enumerate(y) for b in x[i : i + 2]}  # noqa: B905
NEXT |= {(b, a) for a, b in NEXT}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
#: Guesses (log10) for starting a segment, so that many short ones don't beat a long one.
SEGMENT = 0.3


def brute_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26) if c.islower() else math.log10(36)
    return math.log10(64)


def word_costs(docs: DataFrame, text_col: str = "text", min_docs: int = LEAST_DOCS, most_bytes: int = WORD_BYTES) -> Words:
    """Guesses (log10) of the common passwords and of the words of docs, by rank."""
    prose = F.lower(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), f"(?i){CONTEXT.pattern}", " "))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(prose, F.lit(r"\p{L}+"), F.lit(0)))).alias("w")).filter("length(w) >= 2")
    counts = written(words.groupBy("w").count().filter(F.col("count") >= min_docs), "document-frequencies")
    ranked = most_frequent_bytes(counts, "w", "count", most_bytes)
    return Words({w: math.log10(i + 2) for i, w in enumerate(dict.fromkeys([*WORD_COST, *(r["w"] for r in ranked)]))})


def word_cost_of(value: str, low: str, plain: str, a: int, e: int, word_cost: dict[str, float]) -> float | None:
    """Guesses (log10) of value[a:e] as a dictionary word, with its capitals and its letters in place of signs; None if it is none."""
    if (c := word_cost.get(low[a:e])) is None:
        if (c := word_cost.get(plain[a:e])) is None:
            return None
        c += LEET_COST
    capitals = sum(x.isupper() for x in value[a:e])
    return c + (0.0 if not capitals else 0.3 if capitals in (1, e - a) else math.log10(math.comb(e - a, capitals) + 1))


def repeat_cost(times: int) -> float:
    """Beyond what is repeated."""
    return math.log10(times)


def walk_cost(n: int) -> float:
    """A keyboard walk of n keys: where it starts, its length and its turns."""
    return math.log10(47) + 0.5 * math.log10(n) + 0.3 * (n - 1)


def date_cost(n: int) -> float:
    return 2.1 if n == 4 else 4.6


class Starts:
    """Starts a of spans with a growing cost of their own: the least base[a] + cost(e - a), exactly, over all starts.

    cost grows ever more slowly, so of two starts the later one, once it is not better, never is again.
    """

    def __init__(self, cost):
        self.cost, self.held = cost, []

    def add(self, a: int, base: float) -> None:
        while self.held and self.held[-1][1] >= base:  # earlier and no cheaper: never better
            self.held.pop()
        self.held.append((a, base))

    def least(self, e: int) -> float:
        best, keep = math.inf, []
        for a, base in self.held:
            x = base + self.cost(e - a)
            if x < best:
                best = x
                keep.append((a, base))
        self.held = keep
        return best


def repeats(low: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of the longest stretches in which each character equals the one a period earlier, two periods long or more, by their least period; periods of one character left out.

    Names of the substrings of 1, 2, 4 ... characters, until none occurs twice, give how far two places agree
    to both sides; a stretch of period p holds two neighbours of the places 0, p, 2p ....
    """
    n = len(low)
    names = [np.unique(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)[1]]
    while 2 * (size := 1 << len(names) - 1) <= n and names[-1].max() + 1 < len(names[-1]):
        of = names[-1].astype(np.int64)
        names.append(np.unique(of[:-size] * n + of[size:], return_inverse=True)[1].astype(np.int32))
    if names[-1].max(initial=-1) + 1 == len(names[-1]):
        names.pop()
    longest = min(n // 2, (1 << len(names)) - 1)
    found: dict[tuple[int, int], int] = {}
    p = 1
    while p <= longest:
        more = max(1, min(PAIRS * p // n, p, longest - p + 1))  # so that about PAIRS places are compared
        periods = np.arange(p, p + more)
        each = (n - 1) // periods
        of = np.repeat(periods, each)
        i = of * (np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each))
        ahead, back = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        for k in range(len(names) - 1, -1, -1):
            name, size = names[k], 1 << k
            a, b = i + ahead, i + of + ahead
            fits = b < len(name)
            fits[fits] = name[a[fits]] == name[b[fits]]
            ahead += size * fits
            a = i - back - size
            fits = a >= 0
            fits[fits] = name[a[fits]] == name[(a + of)[fits]]
            back += size * fits
        long = ahead + back >= of
        for x in zip((i - back)[long].tolist(), (i + of + ahead)[long].tolist(), of[long].tolist(), strict=True):
            found.setdefault(x[:2], x[2])  # by growing periods: the first is the least, all others are multiples of it
        p += more
    return [(a, b, p) for (a, b), p in found.items() if p > 1]


def guess_cost(value: str, word_cost: Words = WORD_COST) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes: the minimum over all segmentations.

    Two states at each place: the cheapest way there that ends inside a brute-force span, which the
    next character may lengthen, and the cheapest that does not. Segments that repeat a character or
    a block (of any length, itself no repeat), and walks, are offered from every start of their run.
    """
    n = len(value)
    low = value.lower() if value.isascii() else "".join(x if len(x := c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    closed, brute, best = [0.0] + [math.inf] * n, [math.inf] * (n + 1), [0.0] + [math.inf] * n
    same = Starts(repeat_cost)
    # 0.3 a key is taken off the start and put back at the end, so that what is left grows ever more slowly.
    walk = Starts(lambda k: 0.5 * math.log10(k))
    due = sorted(((a + 2 * p, b, p) for a, b, p in repeats(low)), reverse=True) if n > 3 else []  # the next one last
    under_way: list[tuple[int, int, dict[int, Starts]]] = []  # end and period of a stretch; starts of copies by their place in the period
    for i in range(n):
        e = i + 1
        brute[e] = min(brute[i], closed[i] + SEGMENT) + brute_cost(value[i])
        if i and low[i] != low[i - 1]:
            same = Starts(repeat_cost)
        if i and (low[i - 1], low[i]) not in NEXT:
            walk = Starts(lambda k: 0.5 * math.log10(k))
        options = []
        if e >= 3:
            if low[e - 3] == low[e - 2] == low[i]:
                same.add(e - 3, best[e - 3] + brute_cost(value[e - 3]))
                options.append(same.least(e))
            if (low[e - 3], low[e - 2]) in NEXT and (low[e - 2], low[i]) in NEXT:
                walk.add(e - 3, best[e - 3] - 0.3 * (e - 3))
                options.append(walk.least(e) + math.log10(47) + 0.3 * (e - 1))
        for size in word_cost.lengths:
            if size > e:
                break
            if (c := word_cost_of(value, low, plain, e - size, e, word_cost)) is not None:
                options.append(best[e - size] + c)
        for size in range(4, 11):
            if size <= e and DATE.fullmatch(value, e - size, e):
                options.append(best[e - size] + date_cost(size))
        if under_way:
            under_way = [x for x in under_way if x[0] >= e]
        while due and due[-1][0] == e:
            under_way.append((*due.pop()[1:], {}))
        for _, p, copies in under_way:
            if (of := copies.get(e % p)) is None:
                of = copies[e % p] = Starts(lambda k, p=p: repeat_cost(k // p + 1))
            of.add(e - p, best[e - p])
            options.append(of.least(e))
        closed[e] = min(options, default=math.inf) + SEGMENT
        best[e] = min(closed[e], brute[e])
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    low = text.lower() if text.isascii() else text.casefold()
    out = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, min_log10: float = MIN_LOG10_GUESSES, word_cost: Words = WORD_COST) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the values in credential context that are hard to guess."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    return [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], word_cost) >= min_log10]


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10_guesses: float = MIN_LOG10_GUESSES, min_docs: int = LEAST_DOCS) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans and n_guess of each row's whole text.

    spans: kind:start:end in code points, end exclusive, by start then kind. The span of a fixed
    pattern is its whole match; that of a guess is the value.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(word_costs(docs, text_col, min_docs))
    own = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_guess", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in own]
            for cell in batch.column(1):
                text = cell.as_py() or ""
                base, more = base_spans(text), guess_spans(text, min_log10_guesses, sent.value)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                for col, x in zip(cols, (*n, hashlib.sha256(spell(base).encode()).hexdigest(), spell(base + more), len(more)), strict=True):
                    col.append(x)
            kinds = [pa.int64() if isinstance(t, T.LongType) else pa.string() for _, t in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], names=["id", *(n for n, _ in own)])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(*x) for x in own)])).withColumnRenamed("id", id_col)
