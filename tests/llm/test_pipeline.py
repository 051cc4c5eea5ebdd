"""Pipeline stages on small corpora."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string"


def test_near_duplicates_follow_the_pipeline_rule(spark):
    """The pairs are near copies on 5 words and 80 %, not on op7's 4 words and 85 %."""
    words = [f"w{i}" for i in range(100)]
    changed = [f"x{i}" if i in (30, 70) else w for i, w in enumerate(words)]
    other = [f"v{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(other)), (4, " ".join([*other, *(f"u{i}" for i in range(20))])), (5, "apart from all")]
    kept = corpus_pipeline.keep_distinct(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]


def test_near_duplicates_decide_by_row(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one), (2, one), (2, two), (3, three), (3, three), (None, one), (None, "a null id of its own"), (None, "a null id of its own")]
    kept = corpus_pipeline.keep_distinct(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == sorted([(1, one), (2, two), (3, three), (0, "a null id of its own")])


def test_stages_on_odd_rows(spark, tmp_path):
    """Rows with nulls, empty and long texts, repeats and columns of clashing names: each stage keeps whole rows and says which."""
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))
    prose = lambda letters, n: " ".join(word(letters) for _ in range(n))
    passage = prose("abcdefg", 30)
    rows = [(i, prose("abcdefg" if i % 2 else "nopqrst", 40), "aa" if i % 2 else "bb") for i in range(60)]
    rows += [(100, None, "aa"), (101, "", "aa"), (102, "12 --", None), (103, rows[1][1], "aa"), (None, prose("abcdefg", 40), None), (104, prose("abcdefg", 30_000), "aa"), (105, f"{prose('abcdefg', 10)} {passage} {prose('abcdefg', 10)}", "aa")]
    rows += [(200 + i, " ".join(f"{word('abcdefg')}###" for _ in range(40)), "aa") for i in range(20)]
    docs = spark.createDataFrame([(i, t, lang, 1, "x") for i, t, lang in rows], "doc_id long, text string, lang string, __row int, component string")
    labels = [(i, 1, 0) for i in range(60) if i % 4 < 2] + [(200 + i, 0, 0) for i in range(0, 14, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (None, "short"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).select(docs.columns).collect(), docs.schema)
        ids[name] = {r.doc_id for r in kept.collect()}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    all_ids = {r[0] for r in rows}
    assert all_ids - ids["language"] == {100, 101, 102}
    assert len([i for i in ids["quality"] if i and i >= 200]) <= 6 and {i for i in range(60)} <= ids["quality"]
    assert ids["quality"] - ids["near_duplicates"] == {103} and ids["near_duplicates"] - ids["decontamination"] == {105}
    pieces = corpus_pipeline.pack(spark, kept, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == ids["decontamination"] and all(0 < r.length <= 1024 and r.offset + r.length <= 1024 for r in pieces)
    assert corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0
