import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        sizes.append(docs.count())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == first.columns, name
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[4] > 0
    assert {"token_ids", "n_tokens", "ids_sha256"} <= set(docs.columns)


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").selectExpr("count(*) n", "sum(cast(n_tokens = size(token_ids) as int)) ok").first()
    assert rows.n == rows.ok > 0


def test_clashing_columns(spark):
    words = " ".join(f"w{k}x{(k * 7) % 31}" for k in range(60))
    rows = [(i, f"{words} tail{i} {words[::-1]} {i * 37}", "en", "s", 900, 5, "mine", 7, 1.5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, run string, times int, score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        found = out.select("n_words", "run", "times", "score").distinct().collect()
        assert [tuple(r) for r in found] == [(5, "mine", 7, 1.5)], name
