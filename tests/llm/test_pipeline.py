"""Every stage of the pipeline on a small corpus: what goes, what stays, and the columns."""

from __future__ import annotations

import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    prose = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", ".", ""]) for _ in range(k))
    item = prose(40)
    good = [prose(rng.randint(60, 200)) for _ in range(80)]
    junk = [" ".join(f"{rng.choice(vocab)}###" for _ in range(100)) for _ in range(40)]
    near = [g + " zusatz" for g in good[:8]]
    leaks = [prose(50) + " " + item + " " + prose(50) for _ in range(5)]
    texts = good + junk + near + leaks
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 80 <= i < 120), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert k == 4 or docs.columns == columns
        ids.append([r.doc_id for r in docs.collect()])
    assert set(ids[0]) == set(range(len(texts))) - set(range(80, 120))
    assert set(ids[1]) == set(range(80)) | set(range(128, 133))
    assert set(ids[2]) == set(range(80))
    assert set(ids[3]) <= set(range(80)) and abs(sum(len(texts[i].split()) for i in ids[3]) - sum(len(texts[i].split()) for i in range(80))) < 800
    assert sorted(ids[4]) == sorted(ids[3])
    sizes = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[4])


def test_near_copies_from_four_fifths_on_go(spark):
    """One edit in 49 words: 40 of 50 shingles of five words are shared (0.8), of four words 42 of 50 (0.84)."""
    one = [f"w{i}" for i in range(49)]
    inner, outer = [*one[:20], "x", *one[21:]], [f"v{i}" for i in range(40)]
    texts = [one, inner, outer, [*outer[:20], "y", *outer[21:]]]  # 0.8, and 31 of 41 shingles: 0.756
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 3]


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, columns with the names of helpers; then no rows at all."""
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    good = [" ".join(rng.choice(vocab) for _ in range(rng.randint(60, 90))) + "." for _ in range(40)]
    rows = [(i, t, "en", f"src{i % 3}", len(t), "k", "d") for i, t in enumerate(good)]
    rows += [rows[3], rows[3], (None, good[4], None, None, None, None, None), (50, None, "en", None, 0, "k", None), (51, "", None, "src0", 0, None, "d"), (52, "   \n", "en", "src1", 3, "k", "d")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, _digest string"
    labels = [(i, 1, 0) for i in range(30)] + [(None, 0, 0), (31, None, None)]
    for name, docs, bench, marks in (("full", rows, [(None, "q " * 30), (1, None)], labels), ("empty", [], [], [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs_in = spark.read.parquet(f"{at}/documents.parquet")
        for stage in (corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.benchmark_decontamination, corpus_pipeline.source_mix):
            out = stage(spark, docs_in, at)
            assert out.columns == docs_in.columns and {tuple(r) for r in out.collect()} <= set(docs)
        assert corpus_pipeline.benchmark_decontamination(spark, docs_in, at).count() == len(docs)  # nothing of the benchmark is in there
        kept = sorted((r.doc_id is None, r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs_in, at).collect())
        assert kept == ([(False, i) for i in (*range(40), 50, 51, 52)] if docs else [])  # the repeated row once, the copy without an id goes
        assert corpus_pipeline.shards(spark, docs_in, at).count() == len(docs)
