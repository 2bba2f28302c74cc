import os

import pytest

import corpus_pipeline as P
from larder.llm.quality import fit_quality, score_quality
from llm.test_leaks import brute as brute_leaks
from llm.test_nearcopies import brute as brute_near
from llm.test_suffixes import brute as brute_passages

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
def test_stages_against_brute_force(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given = rows_of(docs)

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").selectExpr("doc_id as recipe_id", "quality as good")
    dossiers = docs.selectExpr("doc_id as recipe_id", "text")
    scores = {r.recipe_id: r.score for r in score_quality(dossiers, fit_quality(dossiers, labels)).collect()}
    good = P.quality(spark, docs, FOLDER)
    kept = rows_of(good)
    assert kept == [r for r in given if scores[r[0]] >= 0.5]
    truth = {r.recipe_id: r.good for r in labels.collect()}
    assert sum((scores[i] >= 0.5) == (g == 1) for i, g in truth.items()) >= 0.95 * len(truth)

    single = P.near_duplicates(spark, good, FOLDER)
    classes = brute_near([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if dict(classes)[r[0]] == r[0]]
    assert rows_of(single) == kept

    cut = P.repeated_passages(spark, single, FOLDER)
    left = {i: words for i, _, _, spans, words in brute_passages([(r[0], r[1]) for r in kept], 50) if spans}
    expected = [(r[0], left.get(r[0], r[1].split()), r[2], r[3]) for r in kept if left.get(r[0], True)]
    got = rows_of(cut)
    assert [(r[0], r[1].split(), r[2], r[3]) for r in got] == expected
    assert all(r[4] == len(r[1]) for r in got)

    clean = P.decontaminate(spark, cut, FOLDER)
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    marked = {r[0]: r[4] for r in brute_leaks([(r[0], r[1]) for r in got], items, 10)}
    kept = [r for r in got if not marked[r[0]]]
    assert rows_of(clean) == kept

    packed = P.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in kept}
    for doc in kept:
        pieces = sorted((r.start, r.length) for r in packed if r.doc_id == doc[0])
        assert sum(n for _, n in pieces) == next(r.doc_tokens for r in packed if r.doc_id == doc[0])


def test_odd_rows_pass_all_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    long = " ".join(f"w{k}" for k in range(20000))
    rows = [
        (1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, None, None, None, None), (3, "", "en", "s", 0),
        (None, "a b c d e f g", "en", "s", 13), (None, "k l m n o p q", None, "s", 13), (4, long, "de", "s", len(long)),
        (5, long + " z", "de", "s", len(long) + 2), (6, "t " + " ".join(f"b{k}" for k in range(12)), "en", None, 5),
    ]
    folder = str(tmp_path)
    spark.createDataFrame([(9, " ".join(f"b{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for given in (rows, []):
        more = ["class_id", "recipe_id", "dropped_id", "again_id", "count", "carried", "block", "spans"]
        docs = spark.createDataFrame([(*r, *[7] * 8) for r in given], SCHEMA + "".join(f", {c} int" for c in more))
        for name, stage in P.STAGES:
            docs = stage(spark, docs, folder)
            if name != "packing":
                assert docs.columns == [*COLUMNS, *more]
                assert docs.select(more).distinct().count() == (1 if given else 0)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert {r.doc_id for r in docs.collect()} == ({1, 2, 3, 4, None} if given else set())


def test_rows_that_share_an_id_are_judged_each_by_itself(spark, tmp_path):
    words = lambda tag, n=40: " ".join(f"{tag}{k}" for k in range(n))
    rows = [(1, words("leck"), "en", "s", 1), (1, words("sauber"), "en", "s", 1), (2, words("kopie"), "en", "s", 1), (2, words("eigen"), "en", "s", 1)]
    rows += [(0, words("kopie"), "en", "s", 1), (None, words("leck"), "en", "s", 1), (None, words("ohne"), "en", "s", 1), (3, words("frei"), "en", "s", 1)]
    folder = str(tmp_path)
    spark.createDataFrame([(9, words("leck", 15))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    left = {(r.doc_id, r.text.split()[0]) for r in P.decontaminate(spark, docs, folder).collect()}
    assert left == {(i, t.split()[0]) for i, t, *_ in rows if not t.startswith("leck")}
    # the copy with the lesser id stays, and every other text of the shared id
    left = sorted(((r.doc_id, r.text.split()[0]) for r in P.near_duplicates(spark, docs, folder).collect()), key=repr)
    assert left == sorted({(0, "kopie0"), (1, "leck0"), (1, "sauber0"), (2, "eigen0"), (3, "frei0"), (None, "ohne0")}, key=repr)
