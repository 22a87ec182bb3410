"""Similar records against all pairs, with a word that every record has."""

import random

import pytest

from descry.operators import set_similarity


def sets(seed):
    rnd = random.Random(seed)
    rare, some = [f"r{i}" for i in range(150)], [f"s{i}" for i in range(12)]
    draw = lambda: ["every", *rnd.sample(some, rnd.randrange(0, 6)), *rnd.sample(rare, rnd.randrange(0, 5))]
    records = [(i, draw()) for i in range(150)]
    queries = [(1000 + i, list(dict.fromkeys([*w[: rnd.randrange(1, len(w) + 1)], rnd.choice(rare)]))) for i, w in records[:60]]
    records += [(500 + i, records[0][1]) for i in range(8)] + [(600, []), (601, None), (602, [None, "r1"])]
    queries += [(2000, list(records[0][1])), (2001, []), (2002, None), (2003, ["nowhere"]), (2004, ["every"]), (2005, ["s1", "s1", None])]
    return queries, records


def plain(queries, records, at_least, steps):
    out = {}
    for q, words in queries:
        own = {w for w in words or [] if w is not None}
        sims = {}
        for r, other in records:
            o = {w for w in other or [] if w is not None}
            if own & o:
                sims[r] = len(own & o) / len(own | o)
        for t in steps:
            hits = sorted((-s, r) for r, s in sims.items() if s >= t)
            if len(hits) >= at_least or t == steps[-1]:
                if hits:
                    out[q] = (t, [r for _, r in hits])
                break
    return out


@pytest.mark.parametrize(("at_least", "salt_rows"), [(5, 100_000), (3, 20), (1000, 20)])
def test_similar_records_are_those_of_all_pairs(spark, at_least, salt_rows, monkeypatch):
    monkeypatch.setattr(set_similarity, "SALT_ROWS", salt_rows)
    queries, records = sets(at_least)
    frame = lambda rows: spark.createDataFrame(rows, "id long, words array<string>").repartition(3)
    got = set_similarity.similar_records(frame(queries), frame(records), at_least)
    assert {r["query_id"]: (r["threshold"], r["hits"]) for r in got.collect()} == plain(queries, records, at_least, list(set_similarity.STEPS))
    assert all(r["n"] == len(r["hits"]) for r in got.collect())


def test_pairs_at_one_threshold_and_of_empty_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, words array<string>")
    a = frame([(1, ["x", "y", "z"]), (2, ["q"])])
    got = set_similarity.similar_pairs(a, frame([(7, ["x", "y"]), (8, ["x"]), (9, ["q"])]), 1, [0.5]).collect()
    assert sorted(map(tuple, got)) == [(1, 0.5, 7, 2 / 3), (2, 0.5, 9, 1.0)]
    assert set_similarity.similar_records(a, frame([]), 1).collect() == [] == set_similarity.similar_records(frame([]), a, 1).collect()


def test_rare_words_alone_bring_pairs_together(spark):
    """At a high threshold the word of all records is in no prefix, so it makes no pairs."""
    frame = lambda rows: spark.createDataFrame(rows, "id long, words array<string>")
    rows = frame([(i, ["every", f"a{i}", f"b{i}", f"c{i}"]) for i in range(200)])
    counts = rows.selectExpr("explode(words) as word").groupBy("word").count()
    own = set_similarity.ordered(rows, counts)
    assert set_similarity._prefixes(own, 0.7, "q", set_similarity.F.lit(0)).filter("word = 'every'").count() == 0
    assert set_similarity.pairs_from(own, own, 0.7).count() == 200
