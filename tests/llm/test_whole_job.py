"""Cases in which operators did less than the whole job."""

from collections import Counter

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from descry.llm import language_model, licenses, secrets
from descry.llm._shared import unpack, written
from descry.llm.blocks import blocks


def test_language_model_reads_and_predicts_all_words(spark):
    common, n = [f"w{i}" for i in range(600)], 60
    texts = [" ".join([*common, f"rare{i}", f"pair{i // 2}", f"ten{i // 10}"]) for i in range(n)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("learn", F.lit(True))
    dealt = written(blocks(rows, language_model.words_of, ["id", "learn"], "text"), "test-blocks")
    known = language_model.gather(dealt, spark, language_model.VOCABULARY, language_model.LEAST)
    assert {w.decode() for w, _ in known.top} == set(common)  # grows with the counts
    counts = Counter(w.encode() for t in texts for w in t.split())
    rare = [w for w in counts if w.decode() not in common]
    number = language_model.rare_class(rare, np.array([counts[w] for w in rare]))
    assert len({k // language_model.PIECES for k in number.tolist()}) == 3 and len(set(number.tolist())) > 20
    for k in range(len(known.rare_n)):  # the shares of a class's words and of an unseen one add up to one
        own = [counts[w] for w, x in zip(rare, number.tolist(), strict=True) if x == k]
        assert (known.rare_n[k], known.rare_v[k]) == (sum(own), len(own))
    few = language_model.gather(dealt, spark, 5, language_model.LEAST)
    assert len(few.top) == 5 and few.rare_n.sum() + sum(c for _, c in few.top) + few.ends == few.n
    outputs = {x for r in language_model.answers(dealt, few, spark).collect() for x in unpack(bytes(r["payload"]))[2].tolist()}
    assert len(outputs) > 20 and max(outputs) == language_model.RARE + len(few.rare_n) + 4


def test_language_model_scores_are_the_saved_models_token_by_token(spark, monkeypatch):
    """The job's score of each text, made anew from its model: one token at a time, a state from nothing for each text."""
    rng, saved = np.random.default_rng(4), []
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 90)) if x < 5000) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6, "doc_id")
    real = language_model.mixed
    monkeypatch.setattr(language_model, "mixed", lambda read, start: saved.append((read, real(read, start))) or saved[-1][1])
    run = lambda: {r["doc_id"]: r["score"] for r in language_model.score(docs, block_bytes=4000, least=5).collect()}
    got = run()
    read, lm = saved[0]
    p, n, want = {k: v.astype("f8") for k, v in lm.p.items()}, lm.h, {}
    log_share = lambda z, i: z[i] - np.log(np.exp(z).sum())
    for r in read.collect():
        sizes, tokens = unpack(bytes(r["payload"]))
        at = 0
        for i, size, rare in zip(r["id"], sizes.tolist(), r["rare"], strict=True):
            h, before, total = np.zeros(n), language_model.END, 0.0
            for t in tokens[at : at + size].tolist():
                x = p["x"][before]
                f = 1 / (1 + np.exp(-(h @ p["f"] + x[:n] + p["bf"])))
                h = (1 - f) * h + f * np.tanh((f * h) @ p["c"] + x[n:])
                k = lm.class_of[t]
                a, b = lm.cuts[k], lm.cuts[k + 1]
                total += log_share(h @ p["cls"] + p["bc"], k) + log_share(p["out"][a:b] @ h + p["bo"][a:b], t - a)
                before = t
            want[i], at = total / np.log(10) + rare, at + size
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 * (1 + abs(want[i])) for i in want)
    assert run() == got


def test_words_split_by_arrow_are_those_of_a_plain_split(spark):
    """Arrow makes no object for each token; the blocks are those of plain lists, with ends of blocks anywhere."""
    rng = np.random.default_rng(9)
    odd = [None, "", " ", "\x0b\x0c", " Ab\tab \x0bAB\x0cc\rc\nC ", "\x1cd\x85e\xa0f\u2003\u0130 \xc4", "\x00 \x00", "x"]
    texts = [*odd, *(" ".join(f"W{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 60))) for _ in range(200)), *odd]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    find, lower = brute.WS.findall, brute.LOWER
    plain = lambda ts: ([w.encode() for w in find((t or "").translate(lower))] for t in ts)
    assert isinstance(language_model.words_of(texts), pa.ListArray)
    for size in (1, 700, 1 << 20):
        got, want = (sorted((r["block"], r["bucket"], r["id"] or [], bytes(r["payload"])) for r in blocks(rows, f, ["id"], "text", size).collect()) for f in (language_model.words_of, plain))
        assert got == want and sum(len(r[2]) for r in got) == len(texts)
    assert len({r[0] for r in got}) == 1


def test_sums_of_rows_and_steps_in_parts():
    rng = np.random.default_rng(7)
    for n in (9, 50, 70_000):
        keys, rows = rng.integers(0, n, 400), rng.normal(size=(400, 6))
        want = np.zeros((n, 6))
        np.add.at(want, keys, rows)
        own, got = language_model.sums_by(keys, rows, n)
        assert own.tolist() == sorted(set(keys.tolist())) and np.allclose(got, want[own])
    p, g2, g = rng.normal(size=(3, 3, language_model.PART))
    g2 = g2 * g2
    want, sums = p - 0.1 * g / np.sqrt(g2 + g * g), g2 + g * g
    language_model.descend(p, g2, g.copy(), 0.1)
    assert np.allclose(p, want) and np.allclose(g2, sums)


def test_licenses_in_consecutive_bare_notices(spark):
    for name, notice in licenses.TEMPLATES.items():
        texts = [*[notice] * 5, "Words that stand before. " + notice, notice + " And after it.", notice + " " + notice]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
        assert all(name in got[i]["licenses"].split(",") for i in range(len(texts))), name
        units = len(licenses.Templates({name: notice}).units)
        assert sum(x.startswith(name + ":") for x in got[7]["spans"].split(",")) == 2 * units, name


def test_licenses_in_texts_shorter_than_the_notice(spark):
    grant = licenses.TEMPLATES["mit"].split(" THE SOFTWARE IS")[0]
    mit, gpl = grant.split(), licenses.TEMPLATES["gpl-3.0-line"].split()
    texts = [" ".join(mit[:-10]), " ".join(gpl[1:]), " ".join(mit[:-30]), " ".join(mit[:4])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in licenses.scan(df, templates={**licenses.TEMPLATES, "mit": grant}).collect()}
    assert [got[i]["licenses"] for i in range(4)] == ["mit", "gpl-3.0-line", "", ""]
    assert got[0]["spans"] == "mit:0:77:0.880"


def test_secrets_take_words_of_the_corpus_for_words(spark):
    texts = ["Offers are accepted while available."] * 6 + ["The token is accepted, the secret: available, and token is xkqvzjwpgh"] + ["password: qhzjvkwxyp"] * 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(df).collect()}
    assert got[6] == f"guess:{texts[6].index('xkq')}:{len(texts[6])}" and got[7] == "guess:10:20"
