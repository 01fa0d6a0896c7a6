import random

import corpus_pipeline
from pyspark.sql import functions as F

from .conftest import WORDS


def test_every_stage_decides(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(90)}" for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        body, toxic, good = text(60), 0, 1
        if i % 8 == 0:
            body, toxic = f"{body} insult", 1
        elif i % 8 == 1:
            body, good = " ".join([text(1)] * 50), 0
        docs.append((i, body, "en", "s", len(body)))
        labels.append((i, good, toxic))
    passage = text(40)
    docs += [(1000, docs[2][1], "en", "s", 1), (1001, f"{text(20)} {passage} {text(20)}", "en", "s", 1), (1002, None, "en", "s", None), (1003, docs[3][1] + " tail", None, None, 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    wanted = {i for i in range(400) if i % 8 not in (0, 1)}
    assert kept >= wanted
    assert not kept & ({i for i in range(400) if i % 8 in (0, 1)} | {1000, 1001, 1003})
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, state, str(tmp_path)))
        assert after.columns == corpus_pipeline.COLUMNS, name
        assert after.count() < state.count(), name
        state = after
    assert out.agg(F.sum("length")).first()[0] > 0


def test_near_duplicates_from_four_fifths(spark, make_docs):
    a, b = [f"a{i}" for i in range(104)], [f"b{i}" for i in range(104)]
    # of 100 shingles each, 90 are common to 1 and 2 (similarity 0.82), 88 to 3 and 4 (0.79)
    other = [f"c{i}" for i in range(12)]
    texts = [a, a[:94] + other[:10], b, b[:92] + other]
    docs = make_docs([(i, " ".join(w)) for i, w in enumerate(texts, 1)]).select(*corpus_pipeline.COLUMNS)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {1, 3, 4}


def test_stages_take_odd_rows_and_columns_of_any_name(spark, tmp_path, odd_rows):
    names = ["score", "_score", "bad_id", "bad_hash", "stay_id", "stay_hash", "own_hash", "copy", "n", "node", "group", "text_hash", "id", "part"]
    columns = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{x} long" for x in names)])
    rows = [(i, t, "en", "s", len(t or ""), *range(len(names))) for i, t in odd_rows]
    docs = spark.createDataFrame(rows, columns)
    spark.createDataFrame([(6, 1, 0), (4, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "naïve café ünïcode naïve café ünïcode")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
        got[name] = sorted((str(r["doc_id"]) for r in out.select("doc_id").collect()))
    everyone = sorted(str(i) for i, _ in odd_rows)
    assert got["toxicity"] == got["quality"] == everyone
    # 4, 5, 5 and one without an id have one text; the least id stays
    assert got["near_duplicates"] == sorted(["1", "2", "3", "4", "6", "7", "None", "8", "9"])
    assert got["decontamination"] == [x for x in everyone if x != "8"]


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
