from collections import Counter

from test_ngram_join import brute

import corpus_pipeline
from dupweave.llm import mixing, quality, sharding

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    model = quality.train(docs, labels)
    good = {r.doc_id for r in quality.score_quality(docs, model).collect() if r.tail >= quality.KEEP_TAIL}
    ids = sorted(good)
    first = {x[1] for x in brute(ids, [rows[i].text for i in ids])}
    plain = lambda s: " ".join(s.lower().split())
    items = [plain(r.text) for r in bench.collect()]
    clean = {i for i in first if not any(t in plain(rows[i].text) for t in items)}
    kept = spark.createDataFrame([rows[i] for i in sorted(clean)], docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(kept).collect() if r.copies}
    shards = {r.doc_id: (r.slot, r.shard) for r in sharding.assign_shards(kept).collect()}

    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == copies and len(got) > 50
    assert all((r.slot, r.shard) == shards[r.doc_id] and r.text == rows[r.doc_id].text for r in got)


def test_stages_keep_the_columns_and_take_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        plain = docs.select("doc_id", "text", "lang", "source", "n_chars", "slot")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            plain = stage(spark, plain, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert plain.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot"]
        rows = plain.collect()
        assert (docs is none and not rows) or all(r.shard is not None for r in rows)


def test_order_of_the_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
