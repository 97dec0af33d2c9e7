import corpus_pipeline
from glossaria.llm import queries

from .test_ops import brute_contamination, brute_similar, unigram

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out = corpus_pipeline.materialise(out, name)
        ids = {r.doc_id for r in out.collect()}
        assert ids <= set(kept)
        if name == "near_duplicates":
            order = sorted(kept)
            roots = brute_similar([kept[i].text for i in order])
            assert ids == {order[c] for c in set(roots)}
        if name == "decontamination":
            hit = {x[0] for x in brute_contamination([(i, r.text) for i, r in kept.items()], items) if x[-1]}
            assert hit and ids == set(kept) - hit
        kept = {i: kept[i] for i in ids}
        docs = out
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(kept)
    lib = unigram()
    assert all(got[i] == lib.encode(r.text) for i, r in kept.items() if len(r.text) < 8000)  # its sums are exact


def test_rows_are_dropped_and_not_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    schema = "doc_id long, text string, at int"
    docs = spark.createDataFrame([(None, a, 0), (9, a, 1), (7, a, 2), (7, a, 3), (None, b, 4), (None, b, 5), (8, c, 6), (8, d, 7), (None, None, 8), (None, "", 9)], schema).coalesce(1)
    left = corpus_pipeline.unique(spark, docs, SF)
    assert left.columns == docs.columns and sorted(r["at"] for r in left.collect()) == [2, 4, 6, 7, 8]
    docs = spark.createDataFrame([(None, item, 0), (None, a, 1), (5, item, 2), (5, b, 3), (6, c, 4), (6, c, 5), (None, None, 6)], schema)
    left = corpus_pipeline.uncontaminated(spark, docs, SF)
    assert left.columns == docs.columns and sorted(r["at"] for r in left.collect()) == [1, 3, 4, 5, 6]


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.QUERIES if q.startswith("op")}
    assert "pipeline" in queries.QUERIES and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
