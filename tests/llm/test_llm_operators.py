import base64
from collections import Counter
import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from descry.llm import byte_bpe, components, decontaminate, language_id, language_model, licenses, line_dedup, quality_rules, secrets, simhash, token_counts
from descry.llm._shared import most_frequent, pack, pack_words, unpack, unpack_words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pairs(df, *cols):
    """Rows as a multiset of (doc_id, ...)."""
    return Counter(tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect())


def test_packing():
    a, b = np.array([0, 5, 2**32 - 1]), np.array([], np.int64)
    x, y = unpack(pack(a, b))
    assert x.tolist() == a.tolist() and y.tolist() == []
    for words in ([], [b""], [b"a\n", b"", b"\x00\xff"]):
        assert unpack_words(pack_words(words)) == words


@pytest.mark.parametrize("most", [1, 7, 300, 1000, 5000])
def test_most_frequent_is_the_sorted_head(spark, most):
    rng = random.Random(most)
    own = [(f"w{i}", rng.choice([1, 2, 255, 256, 257, 1023, 1024, rng.randrange(1, 1 << 40)])) for i in range(3000)]
    df = spark.createDataFrame(own, "w string, n long")
    assert [tuple(r) for r in most_frequent(df, "w", "n", most)] == sorted(own, key=lambda x: (-x[1], x[0]))[:most]
    assert most_frequent(df.filter("n < 0"), "w", "n", most) == []


def test_secrets(docs, rows, none):
    out = secrets.scan(docs)
    assert pairs(out, "n_assign", "n_access", "n_hex", "base_sha256") == Counter((i, *brute.secrets(t)) for i, t, _ in rows)
    spans = {r["doc_id"]: r["spans"] for r in out.collect()}
    assert "guess:12:28" in spans[405] and spans[400] == "" and not spans[405].endswith("guess:87:96")
    assert secrets.scan(none).count() == 0


def test_guess_cost_orders_values():
    cost = secrets.guess_cost
    assert cost("") == 0 and cost("password") < 2 and cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 6
    assert cost("abcabcabcabc") < cost("abcdhejkqwzx") and cost("summer2019") < 6
    assert cost("9f8A_x2Qm-7kLz0w") > 15 and cost("zq" * 5000) < 30


PARTS = st.sampled_from(["password", "shadow", "asdf", "2019", "qwerty", "aaa", "xyz", "rr", "1234", "P@ss", "zz", "19-02-2011", "a", "X", "7", "$", "\u0130"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=7).map("".join))
def test_guess_cost_is_the_minimum(value):
    assert secrets.guess_cost(value) == pytest.approx(brute.guess_cost(value, secrets)) if value.isascii() else secrets.guess_cost(value) > 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.text(alphabet="abcdefgh7", max_size=30), st.integers(1, 4))
def test_repeats_and_their_cost_for_blocks_of_any_length(head, block, times):
    value = head + block * times
    want = {}
    for p in range(1, len(value) // 2 + 1):
        start = 0
        for x in range(len(value) - p + 1):
            if x == len(value) - p or value[x] != value[x + p]:
                if x - start >= p:
                    want.setdefault((start, x + p), p)
                start = x + 1
    assert sorted(secrets.repeats(value)) == sorted((a, b, p) for (a, b), p in want.items() if p > 1)
    assert secrets.guess_cost(value) == pytest.approx(brute.guess_cost(value, secrets))


def test_guess_cost_has_no_longest_word_or_block():
    once = "Xq7vR2mLpZ9tKdWsA"
    assert secrets.guess_cost(once * 2) < secrets.guess_cost(once) + 1
    long = secrets.Words({"incomprehensibilities": 1.0})
    assert secrets.guess_cost("incomprehensibilities", long) < 2 and secrets.guess_cost("x" * 100_000 + "y") < 10


def test_guess_spans_follow_the_cost(spark, docs, rows):
    """Spans of the method: all values in credential context that cost the threshold or more, by the plain programme."""
    costs = secrets.word_costs(docs)
    for r in secrets.scan(docs).collect():
        got = [x for x in r["spans"].split(",") if x.startswith("guess")]
        text = next(t for i, t, _ in rows if i == r["doc_id"]) or ""
        if r["doc_id"] is not None:
            want = [f"guess:{m.start(1)}:{m.end(1)}" for m in secrets.CONTEXT.finditer(text) if secrets.guess_cost(m[1], costs) >= secrets.MIN_LOG10_GUESSES]
            assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="pasword19ab=:\"' kK-_AKIA0fFſK", max_size=60))
def test_base_spans_as_brute_force(text):
    base = secrets.base_spans(text)
    assert (*[sum(k == i for _, k, _ in base) for i in range(3)], brute.sha(secrets.spell(base))) == brute.secrets(text)


def test_licenses(docs, rows, none):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect() if r["doc_id"] is not None}
    assert got[408]["licenses"] == "apache-2.0-line,mit-line" and got[400]["n_licenses"] == 0
    assert sum(r["n_licenses"] for r in got.values()) == 2
    assert licenses.scan(none).count() == 0


def mangled(rnd, text, rate):
    """text with words replaced, dropped or doubled at that rate, between other words."""
    out = []
    for w in text.split():
        x = rnd.random()
        out += [w] if x > rate else rnd.choice([["Other"], [], [w, w]])
    pad = lambda: [rnd.choice("some plain words of a text that is licensed under nothing at all".split()) for _ in range(rnd.randrange(30))]
    return " ".join([*pad(), *out, *pad()])


def test_licenses_as_brute_force_and_recall_of_the_bands(spark):
    """Every window that holds 0.8 of a unit, by brute force, has its unit reported (at that copy's best place): recall 1."""
    rnd = random.Random(4)
    index = licenses.Templates(licenses.TEMPLATES)
    texts = [mangled(rnd, t, rate) for t in licenses.TEMPLATES.values() for rate in (0, 0.02, 0.04, 0.06)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    wanted = 0
    for i, t in enumerate(texts):
        w = licenses.words_of([t.encode()])
        found = {}
        for _, a, u, _ in index.find(w):
            found.setdefault(u, []).append(a)
        want = brute.license_units(t, index.units)
        assert set(found) == set(want) and all(set(a) <= want[u] for u, a in found.items())
        wanted += len(want)
        held = {}
        for u in want:
            best = max(len(index.units[u][2] & licenses.shingles(w.joined(a, min(index.units[u][1], len(w.start))).split())) for a in want[u])
            held[index.units[u][0]] = held.get(index.units[u][0], 0) + best
        assert got[i]["licenses"] == ",".join(sorted(n for n, x in held.items() if x >= licenses.CONTAINED * index.size[n]))
    assert wanted > 150


def test_license_near_copy(spark):
    words = licenses.TEMPLATES["mit"].split()
    near = " ".join(w if i % 40 else "Other" for i, w in enumerate(words))
    far = " ".join(w if i % 6 else "Other" for i, w in enumerate(words))
    df = spark.createDataFrame([(1, "Some text before. " + near + " And after it."), (2, far)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    assert got == {1: "mit", 2: ""}


def test_byte_bpe(docs, rows, none, encoding):
    ids = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_bytes=2000)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == Counter((i, tuple(encoding.encode_ordinary(t or ""))) for i, t, _ in rows)
    back = byte_bpe.decode(ids, RANKS)
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t, _ in rows)
    digest = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_bytes=2000, digest=True)
    spelled = lambda t: " ".join(map(str, encoding.encode_ordinary(t)))
    assert pairs(digest, "ids_sha256", "decoded_sha256") == Counter((i, brute.sha(spelled(t or "")), brute.sha(t or "")) for i, t, _ in rows)
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=90))
def test_encode_word(encoding, piece):
    ranks = byte_bpe_ranks()
    assert byte_bpe.encode_word(piece, ranks) == encoding._encode_single_piece(piece) if piece else True


_ranks = {}


def byte_bpe_ranks():
    if not _ranks:
        _ranks.update(byte_bpe.read_ranks(RANKS))
    return _ranks


def test_encode_long_word(encoding):
    for piece in (b"a" * 5000, b"abcdefgh" * 300, bytes(range(256)) * 4):
        assert byte_bpe.encode_word(piece, byte_bpe_ranks()) == encoding._encode_single_piece(piece)


def test_token_counts(docs, rows, none):
    t = Tokenizer.from_file(WORD)
    want = Counter((i, len((x or "").encode()), (n := len(t.encode(x or "", add_special_tokens=False).ids)), n > 20) for i, x, _ in rows)
    assert pairs(token_counts.count_tokens(docs, WORD, limit=20), "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(none, WORD).count() == 0


@pytest.fixture(scope="session")
def counter():
    with open(WORD, encoding="utf-8") as f:
        bpe = token_counts.WordBpe(f.read())
    return token_counts.Counter(bpe, bpe.alone()), Tokenizer.from_file(WORD)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="aB'sS Σİ́\x1c <|endoftext|>1²", max_size=40)))
def test_token_counter(counter, text):
    mine, library = counter
    assert mine(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counter_unassigned(counter):
    """Code points that are letters, digits or capitals in one Unicode version and nothing in another."""
    mine, library = counter
    for c in map(chr, (0x558, 0x88F, 0x1DF1F, 0xA7CB, 0xA7DC, 0xA7CE, 0x10940, 0x187F8, 0x1E6C0, 0x32808, 0x3D000, 0x16EA0, 0x16D67, 0x113C5)):
        for text in (f"\u00c2{c}", f"a{c}b", f"!{c}?", f"1{c} {c}{c}\u0301", f"<|endoftext|>{c}A\u030a"):
            assert mine(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_language_id(docs, rows, none):
    got = {r["doc_id"]: r for r in language_id.predict(docs).collect()}
    assert got[400]["lang_pred"] == got[401]["lang_pred"] == got[403]["lang_pred"] == "und" and got[None]["held_out"] is False
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    long = [(i, lang) for i, t, lang in rows if i is not None and i < 40 and len(t.split()) > 15]
    assert sum(got[i]["lang_pred"] == lang for i, lang in long) >= 0.9 * len(long)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.predict(none).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


ITEMS = [(1, "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi."), (2, "short item here"), (10, "alpha"), (3, None), (4, "!!!"), (2, "short item here"), (None, "stone cloud river the of and")]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontaminate(spark, docs, rows, none, most):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("id", F.lit(1))
    out = decontaminate.decontaminate(docs, bench, most_bytes=most)
    want = brute.contamination([t for _, t, _ in rows], ITEMS)
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert pairs(out, *cols) == Counter((i, *w) for (i, _, _), w in zip(rows, want, strict=True))
    assert decontaminate.decontaminate(none, bench, most_bytes=most).count() == 0
    assert {r["n_hit"] for r in decontaminate.decontaminate(docs, bench.filter("false"), most_bytes=most).collect()} == {0}


def test_decontaminate_measures_items_without_text(spark, docs, monkeypatch):
    """A large benchmark of null texts is joined, not collected."""
    monkeypatch.setattr(decontaminate, "_by_sending", lambda *_: pytest.fail("collected"))
    bench = spark.range(100).select(F.col("id").alias("item_id"), F.lit(None).cast("string").alias("text"))
    assert {r["n_hit"] for r in decontaminate.decontaminate(docs, bench, most_bytes=6000).collect()} == {0}


def test_language_network_and_its_gradient():
    rng = np.random.default_rng(3)
    net = language_id.ByteConv(3)
    net.p = [p.astype("f8") + rng.normal(0, 0.1, p.shape) for p in net.p]
    x, y, weight = rng.integers(0, 256, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0, 1.5])
    # The features by their definition.
    want = [[max(0.0, max(sum(net.p[0][x[i, a + j]] @ net.p[1 + k][j][:, f] for j in range(w)) for a in range(40 - w + 1)) + net.p[-3][k, f]) for k, w in enumerate(language_id.WIDTHS) for f in range(language_id.FILTERS)] for i in range(5)]
    assert np.allclose(net.features(x, net.tables()), want) and np.allclose(net.pooled(x, net.tables())[0], want)
    loss = lambda: -(net.log_probs(x, net.tables())[np.arange(5), y] * weight).sum() / 5
    for p, g in zip(net.p, net.gradients(x, y, weight), strict=True):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(8)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            slope = (up - loss()) / 2e-6
            p[at] = old
            assert abs(slope - g[at]) < 1e-5


def test_language_is_that_of_the_mean_over_windows(spark):
    rows = [(i, ("der die und nicht " if i % 2 else "the of and with ") * (1 + i % 40), "de" if i % 2 else "en") for i in range(200)]
    df = spark.createDataFrame([*rows, (1000, "1 2 3", "xx"), (1001, "a", "rare")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.predict(df).collect()}
    out = df.select(F.col("doc_id").alias("id"), "text", "lang", language_id.held_out(F.col("doc_id")).alias("held_out"))
    langs, net = language_id.train(language_id.sample(out, 1500, 20_000))
    assert "xx" not in langs  # no letter, so nothing to learn from
    for i, t, lang in rows[:60]:
        x, _, used = language_id.to_windows([t.encode()])
        mean = (net.log_probs(x, net.tables()) * used[:, None]).sum(0) / used.sum()
        assert got[i]["lang_pred"] == langs[int(mean.argmax())] == lang
        assert got[i]["score"] == pytest.approx(np.exp(mean - mean.max()).max() / np.exp(mean - mean.max()).sum(), abs=1e-5)


def test_gradient_through_time():
    rng = np.random.default_rng(2)
    n, steps, lanes = 12, 5, 3
    inp, target = rng.integers(0, n, (steps, lanes)), rng.integers(0, n, (steps, lanes))
    fresh = np.zeros((steps, lanes), bool)
    fresh[0], fresh[3, 1] = True, True
    live = np.ones((steps, lanes), bool)
    live[4, 2] = False
    start = language_model.GatedLM(n, np.arange(n, dtype=float), hidden=4)
    params = {k: v.astype("f8") + rng.normal(0, 0.3, v.shape) * (k != "bo") for k, v in start.p.items()}

    def loss(p):
        lm = language_model.GatedLM(n, hidden=4)
        lm.p = p
        hs, _, _ = lm.window(inp, fresh, np.zeros((lanes, 4)))
        return -float(lm.outputs(hs[live].astype("f8"), target[live])[0].sum())

    # One step of Adagrad from a known sum of squares gives the gradient back: step = rate * g / sqrt(start + g * g).
    rate, at_start = 1e-3, 1e6
    lm = language_model.GatedLM(n, hidden=4)
    lm.p = {k: v.copy() for k, v in params.items()}
    lm.g2 = {k: np.full(v.shape, at_start) for k, v in params.items()}
    lm.learn(inp, fresh, target, live, np.zeros((lanes, 4)), rate, 1)
    for k, v in params.items():
        g = (v - lm.p[k]) * np.sqrt(at_start) / rate
        for at in [np.unravel_index(np.abs(g).argmax(), g.shape)] + [tuple(rng.integers(0, m) for m in v.shape) for _ in range(6)]:
            p = {x: y.copy() for x, y in params.items()}
            p[k][at] += 1e-3
            up = loss(p)
            p[k][at] -= 2e-3
            slope = (up - loss(p)) / 2e-3
            assert abs(slope - g[at]) < 2e-3 * max(1.0, abs(slope)), (k, at, slope, g[at])


def test_language_model(docs, rows, none):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*brute.WS.findall((t or "").translate(lower)), None] for _, t, _ in rows]
    out_of = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows]
    c = Counter(w for ws, h in zip(tokens, out_of, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for ws in tokens]
    got = language_model.score(docs, vocabulary=30, block_bytes=3000)
    want = Counter((i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(b, 6)) for (i, _, _), h, ws, b in zip(rows, out_of, tokens, base, strict=True))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got.collect()) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got.collect())
    assert language_model.score(none).count() == 0


def test_model_is_a_distribution_and_its_gradient_is_right():
    rng = np.random.default_rng(0)
    lm = language_model.GatedLM(20, np.arange(20.0), hidden=4)
    lm.p = {k: v.astype("f8") + (rng.normal(0, 0.3, v.shape) if k not in ("bo",) else 0) for k, v in lm.p.items()}
    h = rng.normal(0, 1, (1, 4))
    total = sum(np.exp(lm.outputs(h, np.array([t]))[0][0]) for t in range(20))
    assert abs(total - 1) < 1e-6
    hs = rng.normal(0, 1, (3, 4))
    target = np.array([0, 7, 19])
    grads = {"out": np.zeros_like(lm.p["out"]), "bo": np.zeros_like(lm.p["bo"])}
    _, d = lm.outputs(hs, target, grads)
    for i, j in ((0, 0), (1, 2), (2, 3)):
        e = np.zeros_like(hs)
        e[i, j] = 1e-5
        slope = -(lm.outputs(hs + e, target)[0].sum() - lm.outputs(hs - e, target)[0].sum()) / 2e-5
        assert abs(slope - d[i, j]) < 1e-4


def test_training_helps_and_lanes_do_not_change_scores():
    rng = np.random.default_rng(1)
    docs = [np.array([*([2, 3, 4] * 5 if rng.random() < 0.5 else [5, 6, 7] * 5), 0]) for _ in range(300)]
    tokens, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    lm = language_model.GatedLM(8, np.bincount(tokens, minlength=8).astype(float))
    before = language_model.log10_probs(lm, tokens, sizes).mean()
    for _ in range(4):
        language_model.train(lm, tokens, sizes, 0.1, 16)
    after = language_model.log10_probs(lm, tokens, sizes)
    assert after.mean() > before + 0.2
    assert np.allclose(after, language_model.log10_probs(lm, tokens, sizes, n_lanes=3), atol=1e-4)


def test_classes_and_windows_hold_everything_once():
    for weight in (np.ones(1), np.ones(2), np.r_[1e9, np.ones(40)], np.r_[np.ones(40), 1e9], 1e6 / np.arange(1, 3000)):
        cuts = language_model.class_cuts(weight)
        assert cuts[0] == 0 and cuts[-1] == len(weight) and (np.diff(cuts) > 0).all()
    sizes = np.array([900, 40, 3, 1, 1, 77, 400])
    windows = list(language_model.laid_out(sizes, 3, 4))
    assert sorted(np.concatenate([at[live] for at, live in windows]).tolist()) == list(range(sizes.sum()))
    assert {len(at) for at, _ in windows[:-1]} > {4} and max(len(at) for at, _ in windows) <= 4 * language_model.LONGER


def test_quality_rules(docs, rows, none):
    out = quality_rules.judge(docs)
    assert pairs(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter((i, *brute.quality(t)) for i, t, _ in rows)
    assert not out.filter("kept and base_failed").count() and set(docs.columns) <= set(out.columns)
    assert quality_rules.judge(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x0b#", max_size=120), min_size=1, max_size=8))
def test_quality_measures(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(t)


def test_simhash(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    want = brute.simhash([(i, t) for i, t, _ in rows if i is not None])
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, *w) for i, w in want.items()}
    assert len(got) == len(rows)
    assert simhash.near_duplicates(none).count() == 0


def test_any_two_near_fingerprints_meet_in_a_posting(spark):
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist()
    fps = sorted({0, *seeds, *(s ^ 1 << int(i) ^ 1 << int(j) for s in seeds for i, j in rng.integers(0, 64, (3, 2)))})
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    placed = df.select("fp", simhash.rarest_first(df).alias("places"))
    near = {(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 2}
    for level in simhash.LEVELS:
        by = {}
        for r in simhash.posts(placed, level).collect():
            assert r["key"] == r["fp"] & r["mask"]
            by.setdefault((r["mask"], r["key"]), set()).add(r["fp"])
        met = {(a, b) for m in by.values() for a in m for b in m if a < b}
        assert near <= met and len(met) < len(fps) ** 2 / 4


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_links_of_large_and_small_postings(spark, most):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {0, (1 << 64) - 1}
    for s in seeds.tolist():
        x = s
        for _ in range(60):
            x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(df, most), "a", "b").collect()}
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                parent[root(signed[i])] = root(signed[j])
    groups = {}
    for s in signed:
        groups.setdefault(root(s), set()).add(s)
    want = {s: min(g) for g in groups.values() for s in g if len(g) > 1}
    assert roots == want


def test_line_dedup(docs, rows, none):
    out = line_dedup.dedup_lines(docs, min_docs=10, keep_first=False)
    want = brute.line_dedup([t for _, t, _ in rows])
    assert pairs(out, "n_lines", "n_dropped", "kept_text") == Counter((i, *w) for (i, _, _), w in zip(rows, want, strict=True))
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_equal_rows_are_documents(spark):
    rows = [(7, "a\nb")] * 12 + [(None, "x\ny")] * 9 + [(None, "y\nz\nz")] + [(1, None)] * 12
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.line_dedup([t for _, t in rows])
    assert pairs(line_dedup.dedup_lines(df, 10, 1, False), "n_lines", "n_dropped", "kept_text") == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert {w[1] for w in want} == {0, 1, 2}


def test_line_dedup_keeps_its_sort_and_other_columns(spark):
    lines = spark.createDataFrame([(1, 2, 3, 4, 5)], "a long, b long, id long, t long, pos int")
    plan = line_dedup.first_occurrences(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [a#" in plan and "rangepartitioning(a#" in plan and plan.count("Exchange") == 1
    df = spark.createDataFrame([(1, "a\na", "x", "y", "z")], "doc_id long, text string, words string, id string, t string")
    assert [tuple(r) for r in line_dedup.dedup_lines(df, 1, 1, False).collect()] == [(1, "a\na", "x", "y", "z", 2, 2, "")]


def test_line_dedup_of_many_lines(spark):
    text = "\n".join(f"line {i}" for i in range(200_000))
    df = spark.createDataFrame([(i, f"{text}\nown {i}") for i in range(3)], "doc_id long, text string")
    got = line_dedup.dedup_lines(df, 3, 1, False).collect()
    assert {(r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got} == {(200_001, 200_000, f"own {i}") for i in range(3)}


def test_line_dedup_keeps_first(spark):
    text = [(1, "a\nb\na"), (2, " A \nc"), (3, "\n\nb")]
    df = spark.createDataFrame(text, "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(df, min_docs=2).collect()}
    assert got == {1: "a\nb", 2: "c", 3: "\n"}


def test_line_dedup_bitmaps_are_runs(spark):
    """A text whose every line goes is one entry, whatever its length; sent or joined, the rows are the same."""
    words = {0: 7, 1: 7, 3: 7, 4: -1, 5: -1, 9: 2}
    held = spark.createDataFrame([(list(words.items()),), ([],)], "held array<struct<word int, bits long>>")
    runs = held.select(line_dedup.runs_of(F.col("held")).alias("runs"))
    written_out = runs.select("runs", line_dedup.words_of(F.col("runs")).alias("words")).collect()
    assert [tuple(r) for r in written_out[0]["runs"]] == [(0, 1, 7), (3, 3, 7), (4, 5, -1), (9, 9, 2)]
    assert written_out[0]["words"] == [words.get(i, 0) for i in range(10)] and written_out[1]["words"] == []
    rows = [(i, "\n".join(["menu"] * 6400 + ["own"] * (i == 2) + ["menu"] * 100 + [f"own {i}"])) for i in range(3)] + [(None, "menu"), (None, None), (9, "no such line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    maps = {r["id"]: r["runs"] for r in line_dedup.drop_bitmaps(df, 3, 1, False).collect()}
    assert len(maps[0]) <= 2 and set(maps) == {0, 1, 2, None}
    want = Counter((i, *w) for (i, _), w in zip(rows, brute.line_dedup([t for _, t in rows], 3), strict=True))
    for sent in (0, 1 << 20):
        assert pairs(line_dedup.dedup_lines(df, 3, 1, False, sent_bytes=sent), "n_lines", "n_dropped", "kept_text") == want
