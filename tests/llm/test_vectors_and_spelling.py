"""Exact search, spelling variants and whitening against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from descry.llm import exact_search, spelling, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, q long, bucket int, id string"


def frame(spark, rows):
    """Rows with extra columns of names that the operators use inside."""
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, "i") for i, v in rows], VECTORS)


def vectors(seed=1, n=260, width=6):
    """Vectors of all lengths with copies, repeated rows, nulls, odd values, short and empty ones."""
    rng = np.random.default_rng(seed)
    scale = np.exp(rng.normal(0, 1.5, n))
    rows = [(i, (rng.normal(0, 1, width) * s).tolist()) for i, s in enumerate(scale.tolist())]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    rows += [rows[20], rows[40], (40, rows[41][1]), (None, rows[5][1]), (None, rows[3][1])]
    rows += [(2000, None), (2020, [1.0, None, 0.0]), (2040, [float("nan")] * width), (2060, [float("inf"), *[0.0] * (width - 1)])]
    rows += [(3000, [0.5, -0.5]), (3020, []), (3040, [0.0] * width), (-20, [-0.01] * width)]
    return rows


def usable(rows, factor, width=6):
    out = []
    for i, v in rows:
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            out.append((i, [int(np.floor(factor * float(np.float32(c)))) for c in v] + [0] * (width - len(v))))
    return out


def hits(rows, k, every, factor):
    own = usable(rows, factor)
    out = Counter()
    for a, (q, x) in enumerate(own):
        if q is not None and q % every == 0:
            scored = sorted((-sum(map(int.__mul__, x, y)), i is None, i or 0, i) for b, (i, y) in enumerate(own) if b != a)
            out.update((q, r + 1, s[3], -s[0]) for r, s in enumerate(scored[:k]))
    return out


@pytest.mark.parametrize("bucket_bytes", [64 << 20, 1500])
@pytest.mark.parametrize("seed", [1, 2])
def test_exact_search_is_brute_force(spark, bucket_bytes, seed, monkeypatch):
    monkeypatch.setattr(exact_search, "SEED_BYTES", 400)
    rows = vectors(seed)
    got = exact_search.search(frame(spark, rows).repartition(3), k=7, every=20, bucket_bytes=bucket_bytes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == hits(rows, 7, 20, 64)


def test_exact_search_with_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.25]), (21, [-1.0, 0.0])]
    assert Counter(map(tuple, exact_search.search(frame(spark, rows)).collect())) == Counter({k: 1 for k in [(0, 1, 20, 4096), (0, 2, 21, -4096), (20, 1, 0, 4096), (20, 2, 21, -2048)]})
    for none in (frame(spark, []), frame(spark, [(0, None), (20, [float("nan")])]), frame(spark, [(20, [1.0])])):
        assert exact_search.search(none).collect() == []


@pytest.mark.parametrize("kind", ["f4", "f8", "i8"])
def test_tiles_lose_nothing(kind):
    """Both prunings on clustered vectors, where local thresholds are high, and on scattered ones."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 40, (6, 12))
    x = np.concatenate([np.repeat(centres, 600, 0) + rng.normal(0, 2, (3600, 12)), rng.normal(0, 40, (600, 12))]).astype(np.int64)
    ids = rng.permutation(len(x))
    queries = np.concatenate([x[::400], -x[:3], np.zeros((1, 12), np.int64)])
    best = exact_search.meet(exact_search.tiles_of(x, ids, np.dtype(kind)), queries, np.full(len(queries), -np.inf), 9, np.dtype(kind))
    for n, q in enumerate(queries):
        s = x @ q
        by = np.lexsort((ids, -s))[:9]
        at = best.q == n
        assert best.i[at].tolist() == ids[by].tolist() and best.s[at].tolist() == s[by].tolist()


def test_high_local_thresholds_leave_few_candidates():
    rng = np.random.default_rng(6)
    x = np.concatenate([np.repeat(rng.normal(0, 40, (40, 16)), 50, 0) + rng.normal(0, 0.5, (2000, 16))])
    tile = exact_search.tiles_of(x, np.arange(2000), np.dtype("f8"))[0]
    left = [len(at) for q in x[::50] if (at := tile.by_coordinates(q / np.linalg.norm(q), 0.99)) is not None]
    assert len(left) > 30 and max(left) <= 100


def test_products_that_fit_no_long(spark):
    with pytest.raises(ValueError):
        exact_search.search(frame(spark, [(0, [1e17, 1e17])]))
    assert exact_search.product_type(2**24) == np.float64 and exact_search.product_type(2**53) == np.int64
    large = [(i, [1e7 + i, 3e7 - i]) for i in range(0, 60)]
    assert Counter(map(tuple, exact_search.search(frame(spark, large), k=5).collect())) == hits(large, 5, 20, 64)


def whitened(rows, factor, components=4):
    own = usable(rows, factor)
    x = np.array([v for _, v in own], "f8")
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, q = np.linalg.eigh(c.T @ c / n)
    return own, n, s, values[::-1], q[:, ::-1]


@pytest.mark.parametrize("block", [4096, 32])
def test_whitening_is_the_eigenvectors_of_the_distinct_rows(spark, block, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rows = vectors(3)
    own, n, s, values, q = whitened(rows, 256)
    got = whitening.whiten(frame(spark, rows).repartition(3)).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({i: 4 * m for i, m in Counter(i for i, _ in own).items()})
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    plain = [((np.array(v) - s / n) @ q[:, :4] / np.sqrt(values[:4]), int(sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s, strict=True))), i) for i, v in own]
    for k in range(4):
        mine = sorted((r["vec_id"] or -1, r["deviation"], r["whitened"]) for r in got if r["component"] == k + 1)
        other = sorted((i or -1, d, w[k]) for w, d, i in plain)
        assert [m[:2] for m in mine] == [o[:2] for o in other]
        a, b = np.array([m[2] for m in mine]), np.array([o[2] for o in other])
        if a @ b < 0:
            mine = sorted((i, d, -w) for i, d, w in mine)
            a = np.array([m[2] for m in mine])
        assert np.allclose(a, b, atol=1e-8)
        assert all(r["explained"] == pytest.approx(values[k] / values.sum()) for r in got if r["component"] == k + 1)


def test_whitening_of_equal_deviations_and_of_few_rows(spark):
    """Six axes of equal deviation, then rows that span two directions of six only."""
    axes = [(2 * i + j, [float((1 - 2 * j) * (i == c)) for c in range(6)]) for i in range(6) for j in range(2)]
    got = whitening.whiten(frame(spark, axes)).collect()
    assert len(got) == 12 * 4 and all(r["explained"] == pytest.approx(1 / 6) for r in got) and got[0]["identity_error"] < 1e-9
    few = [(i, [float(a), float(a + b), 0.0, float(b), 0.0, 1.0]) for i, (a, b) in enumerate([(1, 0), (0, 1), (2, 5), (3, 3)])]
    got = whitening.whiten(frame(spark, few)).collect()
    assert Counter(r["component"] for r in got) == {1: 4, 2: 4} and got[0]["identity_error"] < 1e-9
    assert sum({r["component"]: r["explained"] for r in got}.values()) == pytest.approx(1)


def test_whitening_without_deviation(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3, [(1, [])]):
        assert whitening.whiten(frame(spark, rows)).collect() == []


RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, every=199):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return n


def near(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def variants(rows, least=5, factor=5, every=199):
    n = {w: c for w, c in counted(rows, every).items() if len(w) >= 6 and c >= least}
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in by.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] is not None else None))
    return out


def letters(seed):
    """Texts of words over few letters, so that many are one edit apart, with other characters between."""
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abÀé") for _ in range(rnd.randrange(6, 9))) for _ in range(220)}
    words = sorted(words)
    rows = []
    for i in range(60):
        text = "".join(rnd.choice(words[: rnd.choice([4, 40, 220])]) + rnd.choice([" ", "\n", "7", "_", "-", "Ā"]) for _ in range(80))
        rows.append((i, text.upper() if i % 9 == 0 else text))
    long = "ab" * 3000
    return [*rows, (100, None), (101, ""), (None, rows[0][1]), rows[3], (102, f"{long} {long} {long[1:]} " * 4 + f"{long} {long} {long} " * 6)]


@pytest.mark.parametrize("most_words", [4000, 3])
def test_variants_are_brute_force(spark, most_words):
    rows = letters(most_words)
    df = spark.createDataFrame([(i, t, 1, "w", "k", 3) for i, t in rows], "doc_id long, text string, n long, word string, key string, near int").repartition(3)
    got = spelling.variants(df, every=7, most_words=most_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    plain = variants(rows, every=7)
    assert set(map(tuple, got.collect())) == plain and got.count() == len(plain)
    assert sum(r[1] is not None for r in plain) > 4


def test_counts_of_words_and_of_what_lost_a_letter(spark, docs, rows, none):
    plain = {w: c for w, c in counted([r[:2] for r in rows]).items() if len(w) >= 6}
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == plain
    assert spelling.variants(none).collect() == []
    few = spelling.word_counts(docs, every=3)
    assert {r["word"]: r["n"] for r in few.collect()} == {w: c for w, c in counted([r[:2] for r in rows], 3).items() if len(w) >= 6}


def test_chains_of_forms_end_at_their_roots(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "w3"), ("b", "c")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()))
    assert got == {w: "c" if w == "b" else "w11" for w, _ in forms}


def test_acceptor_is_least_and_numbers_its_words():
    words = sorted({"walked", "walker", "walks", "talked", "talker", "talks", "talk"})
    a = spelling.Acceptor(words)
    rests = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:n] for w in words for n in range(len(w) + 1)}}
    assert a.count[a.start] == len(words) and len(a.arcs) == len(rests)
    for n, w in enumerate(words):
        s, at = a.start, 0
        for c in w:
            s, more = a.arcs[s][c]
            at += more
        assert at == n and a.final[s]


@pytest.mark.parametrize("seed", range(6))
def test_composition_meets_each_pair_once(seed):
    rnd = random.Random(seed)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 7))) for _ in range(60)})
    found = [frozenset(p) for p in spelling.near_in(words)]
    assert len(found) == len(set(found)) and set(found) == {frozenset((u, v)) for u in words for v in words if u < v and near(u, v)}
