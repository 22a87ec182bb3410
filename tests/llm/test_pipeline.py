"""Each stage on its own input against a plain version, and the whole run."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"), (2, "short item here please")]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def kept_ones(rows):
    """One row of each class; here no two texts without an id share a class with nothing else."""
    once = list(dict.fromkeys(rows))
    of = {k: c for k, (_, c) in brute.simhash([(k, t) for k, (_, t) in enumerate(once)]).items()}
    first = {}
    for k, c in of.items():
        i = once[k][0]
        if c not in first or (i is None, i or 0) < (once[first[c]][0] is None, once[first[c]][0] or 0):
            first[c] = k
    return sorted((once[k] for k in first.values()), key=repr)


A, B, C = "one two three four five six seven", "completely other words stand here today", "a third text of several words again"


@pytest.mark.parametrize("turn", [1, -1])
def test_near_duplicates_of_one_id_with_two_texts(spark, turn):
    rows = [(3, A), (5, A), (5, B), (7, C), (None, C), (None, "only here without an id at all"), (None, "only here without an id at all"), (8, None), (9, "")]
    df = spark.createDataFrame(rows[::turn], "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(3, A), (5, B), (7, C), (None, "only here without an id at all"), (8, None)], key=repr)


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    own = {"kept": "k", "n_words": "w", "n_lines": "l", "bad_id": "b", "bad_text": "t", "__id": "i", "kept_text": "x", "c0": "c", "id": "d", "text_hash": "h", "component_id": "o", "base_failed": "f"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, v in own.items():
        docs = docs.withColumn(name, F.lit(v))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes, name
        assert [tuple(r) for r in out.select(*own).distinct().collect()] == [tuple(own.values())], name
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0
    assert corpus_pipeline.encode(spark, docs, sf_dir).count() == docs.count()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)

    kept = stage["quality_rules"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and all(not brute.quality(t)[-1] for _, t in texts(kept))
    passed = {i for i, _ in texts(kept)}
    assert set(range(100, 112)) <= passed and not passed & {200, 400, 401}

    lined = stage["line_dedup"](spark, docs, sf_dir)
    want = brute.line_dedup([r["text"] for r in docs.collect()])
    assert lined.columns == docs.columns
    assert texts(lined) == sorted(((r["doc_id"], w[2]) for r, w in zip(docs.collect(), want, strict=True)), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect())

    near = stage["simhash_near_dedup"](spark, docs, sf_dir)
    assert near.columns == docs.columns
    assert texts(near) == kept_ones([(r["doc_id"], r["text"]) for r in docs.collect()])

    clean = stage["decontamination"](spark, docs, sf_dir)
    bad = brute.contamination([r["text"] for r in docs.collect()], ITEMS)
    assert clean.columns == docs.columns
    assert texts(clean) == sorted(((r["doc_id"], r["text"]) for r, b in zip(docs.collect(), bad, strict=True) if not b[-1]), key=repr)

    encoded = stage["byte_bpe"](spark, docs, sf_dir)
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in encoded.collect() if r["doc_id"] is not None) == sorted((r["doc_id"], brute.sha(r["text"] or "")) for r in docs.collect() if r["doc_id"] is not None)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    ids = [r["doc_id"] for r in out.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) > 20 and not {200, 301, 400, 401} & set(ids)
