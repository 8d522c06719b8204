import corpus_pipeline
from cases import awkward, frame, near_groups, table_rows, words
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LABELS, BENCHMARK = "doc_id long, quality int", "item_id long, text string"


def test_stages_by_brute_force(spark, tmp_path):
    """Every stage on what the one before kept; rows are followed by id."""
    item = " ".join(f"q{i}" for i in range(20))
    extra = [(800_000, item + " " + " ".join(f"z{i}" for i in range(60)), "en", "src0")]
    rows = table_rows(spark, SF) + awkward() + extra
    sf = str(tmp_path / "sf")
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(77_777, item)], BENCHMARK))
    bench.write.parquet(f"{sf}/benchmark.parquet")
    items = [r.text for r in bench.collect()]
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, out.collect())
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        docs = out
    before, after = seen["quality_rules"]
    assert after and all(len(words(r.text)) >= 50 for r in after) and set(after) <= set(before)
    before, after = seen["line_dedup"]
    assert len(before) == len(after) and all(r.n_chars == len(r.text) for r in after)
    before, after = seen["minhash_near_dedup"]
    groups = near_groups([(r.doc_id, r.text) for r in before], 5)
    assert {r.doc_id for r in after if r.doc_id is not None} == set(groups.values())
    assert len(after) == len(set(after))
    before, after = seen["benchmark_decontamination"]
    assert not any(t in r.text for r in after for t in items)
    assert all(any(t.split()[0].lower() in r.text.lower() for t in items) for r in set(before) - set(after))
    assert any(r.doc_id == 800_000 for r in before) and not any(r.doc_id == 800_000 for r in after)
    before, after = seen["best_fit_packing"]
    assert sum(r.n_words for r in after) == sum(len(words(r.text)) for r in before)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, after))


def test_a_group_of_copies_leaves_one(spark, tmp_path):
    """Copies on a tenth of a source's documents are left to near-dedup, and one of them is packed."""
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(1, 1)], LABELS).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], BENCHMARK).write.parquet(f"{sf}/benchmark.parquet")
    copy = "\n".join(" ".join(f"c{i}x{k}" for k in range(30)) for i in range(3))
    rows = [(i, " ".join(f"w{i}n{k}" for k in range(60)), "en", "src0") for i in range(18)] + [(50 + i, copy, "en", "src0") for i in range(2)]
    frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_words for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: 60 for i in range(18)} | {50: 90}


def test_clashing_names_and_empty_tables(spark, tmp_path):
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(1, 1)], LABELS).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], BENCHMARK).write.parquet(f"{sf}/benchmark.parquet")
    docs = frame(spark, [(i, " ".join(f"w{i}n{k}" for k in range(60)), "en", "src0") for i in range(5)] + awkward())
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
            if name != "best_fit_packing":
                assert now.columns == docs.columns
        rows = now.collect()
        assert bool(rows) == (start is docs)
        if rows:
            assert {r.doc_id for r in rows} >= set(range(5))


def test_registered(spark):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and [f"op{n}_" in " ".join(entry.queries()) for n in range(1, 11)] == [True] * 10
    assert corpus_pipeline.run(spark, SF).select(F.sum("n_words")).first()[0] > 0
