"""Whole words, however long, and packings by the method itself."""

import numpy as np
from pyspark.sql import functions as F

from helixspark.llm import classifier, exact_dedup, packing


def test_classes_of_long_words():
    head = "Abc" * 40
    assert len({classifier.classes_of(head + x) for x in ("", "d", "e", "dE", "d7")}) == 5
    assert classifier.classes_of(head + "d")[0] != classifier.classes_of(head + "e")[0]
    assert classifier.classes_of(head + "-7")[1] != classifier.classes_of(head + "-x")[1]


def test_texts_of_one_long_word():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(classifier.CLASSES, classifier.DIM)).astype(np.float32)
    a, b = classifier.pool(["漢" * 100 + "字", "漢" * 100 + "文"], vectors)
    assert not np.array_equal(a, b)


def test_crossover_lowers_the_bins():
    """From random groupings, children alone make the packing; it is as good as best-fit, longest first."""
    for seed in range(4):
        lengths = np.random.default_rng(seed).integers(1, 1500, 400)
        first = packing.first_population(lengths, None, 2048, np.random.default_rng(seed), packing.POPULATION)
        assert len({x.tobytes() for x in first}) == packing.POPULATION
        best = packing.evolve(first, lengths, 2048, np.random.default_rng(seed), 120, packing.POPULATION)[0]
        greedy = np.full(len(lengths), -1, dtype=np.int32)
        packing.best_fit(np.argsort(-lengths, kind="stable").tolist(), lengths.tolist(), greedy, [], 2048)
        assert best.max() < min(x.max() for x in first) and best.max() <= greedy.max() + 1


def test_query_makes_children(monkeypatch):
    """The lengths of the smallest documents, in blocks as the operator deals them: children are made, and the bins get fewer by them."""
    made = []
    real = packing.cross
    monkeypatch.setattr(packing, "cross", lambda *x: made.append(1) or real(*x))
    import pandas as pd

    n = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.fillna("").str.split().str.len().to_numpy() * 7 // 5 % 2048 + 1
    first = packing.first_population(n, None, 2048, np.random.default_rng(0), packing.POPULATION)
    best = packing.evolve(first, n, 2048, np.random.default_rng(1), packing.CHILDREN, packing.POPULATION)[0]
    assert made and best.max() < min(x.max() for x in first)


def test_several_flushes_are_compacted(spark):
    rows = spark.range(60).select("id", F.col("id").alias("row"), F.sha2((F.col("id") % 40).cast("string"), 256).cast("binary").alias("digest"))
    for keep in ("min", "max"):
        index = exact_dedup.DigestIndex(spark, keep, memtable=4)
        for k in range(3):
            assert index.flush(rows.filter(F.col("id") % 3 == k)) == 5
        apart = sorted(map(tuple, index.hits().select("digest", "keep", "row", "n").distinct().collect()))
        assert sum(n for _, n in index.runs) == 15
        index.compact()  # 15, 4, 1
        assert sum(n for _, n in index.runs) == 1 and index.written == 5
        top = index.entries().collect()
        assert len(top) == 40 and {r.run for r in top} == {0} and sum(r.n for r in top) == 60
        assert sorted(map(tuple, index.hits().select("digest", "keep", "row", "n").distinct().collect())) == apart
        assert sorted((k, n) for _, k, _, n in apart) == [(k if keep == "min" else k + 40, 2) for k in range(20)]
        # A later batch meets the compacted run.
        index.flush(rows.filter("id < 2"))
        index.compact()
        assert sorted(r.n for r in index.entries().collect()) == [1] * 20 + [2] * 18 + [3] * 2


def test_filters_set_lone_entries_apart(spark):
    rows = spark.range(4000).select("id", F.col("id").alias("row"), F.sha2(F.greatest(F.lit(0), F.col("id") - 3990).cast("string"), 256).cast("binary").alias("digest"))
    rows = rows.filter("id >= 3990").unionByName(spark.range(3990).select("id", F.col("id").alias("row"), F.sha2(F.concat(F.lit("x"), "id"), 256).cast("binary").alias("digest")))
    index = exact_dedup.DigestIndex(spark, memtable=1000)
    index.flush(rows)
    alone, shared = index._apart(index.entries())
    assert alone.count() > 3900 and shared.groupBy("digest").count().filter("count > 1").count() <= shared.count()
    both = index.entries().groupBy("digest").agg(F.countDistinct("run").alias("n")).filter("n > 1")
    assert alone.join(both, "digest").count() == 0


def test_query_flushes_and_compacts(spark, monkeypatch):
    """Many memtables of the registered query's operator, over rows with a hot digest."""
    made = []
    real = exact_dedup.DigestIndex._write
    monkeypatch.setattr(exact_dedup.DigestIndex, "_write", lambda self, entries, runs: made.append(runs) or real(self, entries, runs))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("text"))
    got = exact_dedup.exact_dedup(docs, keep="max", memtable=100).toPandas()
    assert made == [30, 8, 2, 1]
    hot = got[got.keep_id == 2997]
    assert len(hot) == 1000 and (hot.group_size == 1000).all() and hot.kept.sum() == 1 and got.groupby("text_sha256").kept.sum().eq(1).all()


def test_labels_that_nothing_has_are_not_salted(spark):
    """A long chain and a star: components stay right, and only labels that some vertex has are copied for the jump."""
    from helixspark.llm import components as c

    made, staged = [], c.staged
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)], "a long, b long")

    def watched(df, name):
        out = staged(df, name)
        if name == "components-step":
            made.append(df._jdf.queryExecution().optimizedPlan().toString())
        return out

    c.staged = watched
    try:
        found = {r.v: r.comp for r in c.components(links).collect()}
    finally:
        c.staged = staged
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert made and all("Aggregate [comp" in x for x in made)
