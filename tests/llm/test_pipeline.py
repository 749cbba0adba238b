"""The pipeline's stages on planted documents."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def planted(seed=7):
    draw = random.Random(seed)
    stems = [a + b + c for a in ("ba", "ko", "mi", "tru", "sel", "vor") for b in ("la", "ne", "ri", "do", "fu") for c in ("n", "st", "m", "k")]
    text = lambda n: " ".join("the of and it is to in".split()[draw.randrange(7)] if draw.random() < 0.4 else draw.choice(stems) for _ in range(n)).capitalize() + "."
    docs = {i: "\n".join(text(12) for _ in range(20)) for i in range(120)}
    docs[200], docs[201] = docs[3], docs[5] + " of"
    item = text(40)
    docs[202] = text(60) + " " + item
    docs[203] = "BUY!! NOW!! $$$ " * 40
    return docs, item, text(1500)


def test_stages_keep_clean_documents_and_drop_planted_ones(spark, tmp_path):
    docs, item, long = planted()
    docs[204] = long
    rows = [(i, t, "en", f"src{i % 5}", len(t)) for i, t in docs.items()]
    bad = [(300 + i, "CLICK!! HERE!! $$$ &&& " * (5 + i)) for i in range(60)]
    rows += [(i, t, "en", "src0", len(t)) for i, t in bad]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("host", F.lit("kept")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = kept.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/out-{len(seen)}"
        stage(spark, kept, str(tmp_path)).write.parquet(path)
        kept = spark.read.parquet(path)
        seen.append({r["doc_id"] for r in kept.select("doc_id").collect()})
        if len(seen) < len(corpus_pipeline.STAGES):
            assert kept.columns == columns and set(kept.select("host").distinct().toPandas()["host"]) == {"kept"}
    assert seen[0] == seen[1] == set(docs) - {203}
    assert seen[2] == seen[1] - {200, 201}
    assert seen[3] == seen[4] == seen[2] - {202}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == seen[4]


def test_one_row_of_each_group_stays_whatever_the_order(spark, tmp_path):
    a, b = "one two three four five six seven", "red green blue black white grey pink brown"
    rows = [(5, a, "x"), (5, b, "x"), (7, a, "x"), (None, b, "y"), (5, a, "w"), (5, a, "w"), (None, "lost and found and kept", "z"), (None, "lost and found and kept", "z"), (9, None, "n"), (8, "", "n")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, mark string").repartition(3)
        found = corpus_pipeline.one_of_each(spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        assert sorted(map(tuple, found.collect()), key=repr) == sorted([(5, a, "w"), (5, b, "x"), (None, "lost and found and kept", "z"), (8, "", "n")], key=repr)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
