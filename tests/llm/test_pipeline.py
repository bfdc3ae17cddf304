"""The pipeline's stages against plain versions."""

import hashlib
import random

import numpy as np

import corpus_pipeline as P
from larkspur.llm import bpe, langid, secrets

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, docs):
    rows = docs
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "bpe"]
    before = rows.collect()
    kept = P.language(spark, rows, SMALL)
    assert kept.columns == rows.columns
    ids = {r.doc_id for r in kept.collect()}
    # what has letters and one of the languages stays
    assert {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)} - ids == set()

    one = P.near_duplicates(spark, kept, SMALL)
    assert one.columns == rows.columns
    from test_operators import brute_components

    want = {k for k, _, _, good in brute_components([(r.doc_id, r.text) for r in kept.collect()], 5, 80, 100) if good}
    assert {r.doc_id for r in one.collect()} == want

    clean = P.no_secrets(spark, one, SMALL)
    assert clean.columns == rows.columns and clean.count() == one.count()
    assert all(not secrets.find(r.text)[0] for r in clean.collect())

    mix = P.mixed(spark, clean, SMALL)
    assert mix.columns == rows.columns
    own = {r.doc_id: r.text for r in clean.collect()}
    copies = {}
    for r in mix.collect():
        assert own[r.doc_id] == r.text
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3

    last = P.encoded(spark, mix, SMALL).collect()
    assert len(last) == sum(copies.values())
    codec = bpe.Codec(bpe.vocabulary())
    for r in last[:40]:
        assert r.ids_sha256 == hashlib.sha256(np.array(codec.encode([own[r.doc_id]])[0], "<u4").tobytes()).hexdigest()


def test_stages_on_odd_rows(spark, odd, none):
    for start in (odd, none):
        rows = start
        for name, stage in P.STAGES:
            rows = stage(spark, rows, SMALL)
            if name != "bpe":
                assert rows.columns == start.columns
        rows.count()
    assert {r.doc_id for r in P.language(spark, odd, SMALL).collect()}.isdisjoint({1, 2, 3, 8})
    assert langid.train(none) is None


def test_columns_keep_their_names_and_values(spark):
    """Columns named like those the stages use pass through every stage but the last, with their values."""
    words = "der die das und nicht ein eine mit auf sich the and of to in is that it was for".split()
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words) for _ in range(30 + i)), "de" if i % 2 else "en", "ab"[i % 2], *(f"{c}{i}" for c in range(14))) for i in range(40)]
    names = ["_key", "_size", "_bucket", "target", "source_size", "score", "_score", "lang_pred", "_kept", "row", "key", "group", "copies", "ids"]
    start = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string", *(f"`{c}` string" for c in names)]))
    want = {r[0]: r[2:] for r in rows}
    docs = start
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == start.columns, name
        assert all((r[2:] == want[r[0]]) for r in map(tuple, docs.collect())), name
    assert docs.count() > 10 and P.encoded(spark, docs, SMALL).count() == docs.count()


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "12 34"), (3, None), (4, "漢字")], "doc_id long, text string")
    assert sorted(r.doc_id for r in P.language(spark, docs, SMALL).collect()) == [1, 4]


def test_one_row_of_each_group_stays(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("ab", "cd", "ef"))
    rows = [
        (1, one, "a"), (1, one, "b"), (2, one + " more", "c"),  # copies under one id, and a near copy
        (3, two, "d"), (4, three, "e"), (4, two + " more", "f"),  # an id of which one row is a near copy of another document
        (None, three + " more", "g"), (None, "pq " * 9 + "rs", "h"), (None, "pq " * 9 + "rs", "i"),  # without ids: a near copy of a numbered one, and copies among them
        (5, "", "j"), (5, None, "k"), (None, " ", "l"),
    ]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, _row string"), SMALL)
    assert got.columns == ["doc_id", "text", "_row"]
    kept = sorted(r._row for r in got.collect())
    assert len(kept) == 7 and set(kept) - {"a", "b", "h", "i"} == {"d", "e", "j", "k", "l"}
    assert len({"a", "b"} & set(kept)) == len({"h", "i"} & set(kept)) == 1


def test_run(spark):
    out = P.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
