import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from turnwise.llm import similar
from turnwise.session import BATCH_CONF, small_batches

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, prose, tmp_path_factory):
    """A folder of tables with planted cases, and the ids by case."""
    draw, rows, cases = random.Random(6), [], {}

    def add(case, text):
        key = len(rows)
        rows.append((key, text, "de" if case == "german" else "en", draw.choice(["src0", "src0", "src1", None]), len(text or "")))
        cases.setdefault(case, []).append(key)
        return key

    items = [(i, prose(30)) for i in range(5)]
    clean = [prose(draw.randint(20, 120)) for _ in range(150)]
    for text in clean:
        add("clean", text)
    for text in clean[:20]:
        add("copy", text)
    for i, item in items:
        add("leak", f"{prose(20)} {item} {prose(25)}")
    for _ in range(60):
        add("bad", (prose(40).upper() + " ").replace(" ", "!! "))
    for _ in range(30):
        add("german", prose(40).translate(str.maketrans("abklmrs", "üöäßwyx")))
    for text in (None, "", "  ", "12 34 ..."):
        add("empty", text)
    labels = [(k, int(c not in ("bad", "empty")), 0) for c, keys in cases.items() for k in keys]
    rows.append(rows[3])  # one row twice
    rows.append((None, clean[4], "en", "src0", 1))
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, cases, rows


def test_stages(spark, tables):
    folder, cases, rows = tables
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.cut_lineage(stage(spark, docs, folder))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    language, quality, near, bench = left.values()
    assert Counter(language) == Counter([r[0] for r in rows if r[0] not in cases["empty"]])
    assert not set(quality) & set(cases["bad"]) and set(cases["clean"]) <= set(quality)
    # Of each group one stays, of a row that is there twice as well; a null id comes before the others.
    assert set(near) == {k for k in [*cases["clean"], *cases["leak"], *cases["german"], None] if k != 4} and len(near) == len(set(near))
    assert set(bench) == set(near) - set(cases["leak"])
    packed = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(map(str, {r.doc_id for r in packed})) == sorted(map(str, bench))


def test_run(spark, tables):
    folder, _, _ = tables
    got = pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 100


def test_empty_tables(spark, tables, tmp_path):
    folder, _, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
    some = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[1:]:
        assert stage(spark, some, str(tmp_path)).count() > 0


def test_texts_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    """By number of rows, the texts of a partition would come at once; the session's setting is as before."""
    rows = spark.range(0, 6_000, 1, 1).select(
        F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 200), x -> concat(id, '_', x)), ' ')").alias("text"))
    rows.write.parquet(f"{tmp_path}/docs")
    make = similar.set_task

    def checked(words):
        run = make(words)

        def task(batches):
            def small():
                for batch in batches:
                    assert batch["text"].str.len().sum() < 5 << 20
                    yield batch
            return run(small())
        return task

    monkeypatch.setattr(similar, "set_task", checked)
    assert similar.similar_groups(spark.read.parquet(f"{tmp_path}/docs")).count() == 6_000
    assert spark.conf.get(BATCH_CONF, None) is None


def test_session_limit_of_batches_stays(spark):
    spark.conf.set(BATCH_CONF, "1m")
    try:
        with small_batches(spark):
            assert spark.conf.get(BATCH_CONF) == "1m"
        assert spark.conf.get(BATCH_CONF) == "1m"
    finally:
        spark.conf.unset(BATCH_CONF)


def test_search_for_items_reads_no_table_from_python(spark, tables):
    """Such a table starts Python workers of another kind, which stay beside those of the tasks."""
    folder, _, _ = tables
    docs, bench = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    for items in (bench, bench.limit(0)):
        found = pipeline.find_contamination(docs, items)
        assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert found.collect() == []
