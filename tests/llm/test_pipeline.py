import random

import pytest

import corpus_pipeline


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs = {i: prose(120) for i in range(90)}
    labels = []
    for i in range(60):
        if i % 4 == 0:
            w = docs[i].split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["grobble", "snarkle"]))
            docs[i] = " ".join(w)
        labels.append((i, 1, int(i % 4 == 0)))
    docs[100] = docs[61]
    docs[101] = docs[62].replace(" ", "  ", 3) + " tail"
    passage = prose(120)
    docs[102], docs[103] = prose(50) + " " + passage + " " + prose(50), prose(60) + " " + passage
    item = prose(30)
    docs[104] = prose(40) + " " + item.upper() + " " + prose(40)
    rows = [(i, t, "en", "src%d" % (i % 3), len(t)) for i, t in docs.items()] + [(200, None, "en", "src0", 0), (201, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), passage


def test_stages_take_effect(spark, folder, tmp_path):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/{k}")
        before, docs = docs, spark.read.parquet(f"{path}/{k}")
        if k < 4:
            assert docs.columns == before.columns
        seen.append({r.doc_id: r for r in docs.collect()})
    everything = set(range(90)) | {100, 101, 102, 103, 104, 200, 201}
    toxic = {i for i in range(60) if i % 4 == 0}
    assert set(seen[0]) == everything - toxic
    assert set(seen[1]) == set(seen[0]) - {100, 101}
    assert set(seen[2]) == set(seen[1]) and passage not in seen[2][102].text and passage not in seen[2][103].text
    assert seen[2][102].n_chars == len(seen[2][102].text) and all(seen[2][i].text == seen[1][i].text for i in (1, 70, 200, 201))
    assert set(seen[3]) == set(seen[2]) - {104}
    assert set(seen[4]) == set(seen[3]) and all(r.taken <= 3 * r.size for r in seen[4].values())
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, path).collect()}
    assert got == {i: r.taken for i, r in seen[4].items()}


def test_one_row_of_a_group_stays(spark):
    long = [" ".join("%s%d" % (c, i) for i in range(40)) for c in "abcd"]
    rows = [(1, long[0]), (1, long[0]), (1, long[0]), (None, long[1]), (None, long[1]), (None, long[1] + " more"), (2, long[2]), (3, long[2] + " more"), (3, long[3]), (5, None), (5, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got if r.text and r.doc_id) == [("1", long[0]), ("2", long[2]), ("3", long[3])]
    assert sum(bool(r.text) for r in got) == 4 and sum(not r.text for r in got) == 3


def test_stages_on_empty_tables_and_odd_rows(spark, folder, tmp_path):
    path, _ = folder
    schema = "doc_id long, text string, lang string, source string, n_chars long, k1 string, score int, open int, part int"
    rows = [(1, "calm alone", "en", "s", 10, "x", 1, 2, 3), (1, "calm alone", "en", "s", 10, "x", 1, 2, 3), (None, None, None, None, None, None, None, None, None), (None, "", None, None, 0, None, None, None, None), (2, "calm " * 300_000, "en", "s", 1_500_000, "y", 0, 0, 0)]
    for name, data in (("empty", []), ("odd", rows)):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, path)
            if k < 4:
                assert out.columns == corpus_pipeline.COLUMNS
            out.write.parquet(f"{tmp_path}/{name}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{k}")
        assert docs.count() == (0 if name == "empty" else 4)


def test_short_repeated_passages_go(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(n))
    passage = prose(52)
    docs = {i: prose(80) + " " + (passage + " " if i < 6 else "") + prose(40) for i in range(12)}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, df, "").collect()}
    assert all(passage not in t for t in got.values()) and all(got[i] == docs[i] for i in range(6, 12))
    assert all(len(got[i]) < len(docs[i]) - 240 for i in range(6))
