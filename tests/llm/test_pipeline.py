import corpus_pipeline
from strandflow.llm import neardup, packing, toxicity
from strandflow.llm.mixing import mixed
from strandflow.llm.pii import pseudonymised, sample_key

DATA = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, monkeypatch):
    """Each stage against its operator on what the one before kept, and the whole run."""
    monkeypatch.setattr(toxicity, "STEPS", 30)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    made = [docs.cache()]
    for name, stage in corpus_pipeline.STAGES:
        made.append(stage(spark, made[-1], DATA).cache())
        if name != "pack_sequences":
            assert made[-1].columns == docs.columns and made[-1].dtypes == docs.dtypes
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in made]
    rejected = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert ids[1] == sorted(set(ids[0]) - rejected)
    assert ids[2] == sorted(r.doc_id for r in neardup.near_duplicates(made[1], 5, 80).where("kept").collect())
    assert ids[3] == ids[2] and {(r.doc_id, r.text) for r in made[3].collect()} == {(r.doc_id, r.text) for r in pseudonymised(made[2], sample_key(spark)).collect()}
    assert ids[4] == sorted(r.doc_id for r in mixed(made[3]).collect() for _ in range(r.copies))
    whole = {(r.doc_id, r.piece, r.ids_crc32, r.length) for r in packing.pack(made[4].select("doc_id", "text"), packing.vocabulary()).collect()}
    assert {(r.doc_id, r.piece, r.ids_crc32, r.length) for r in made[5].collect()} == whole
    assert {(r.doc_id, r.piece, r.ids_crc32, r.length) for r in corpus_pipeline.run(spark, DATA).collect()} == whole


def test_one_row_of_repeats_and_of_rows_without_an_id(docs_of, spark):
    def text(i, n=60):
        return " ".join(f"w{i}x{j}" for j in range(n))

    rows = [(1, text(1)), (1, text(1)), (2, text(2)), (3, text(1)), (4, ""), (4, ""), (5, text(5)), (6, text(6)), (6, text(6)), (7, None)]
    bare = [(None, text(2)), (None, text(8)), (None, text(8)), (None, text(8) + " more"), (None, text(9)), (None, ""), (None, ""), (None, None), (None, None)]

    def kept(found):
        got = corpus_pipeline.keep_one_of_each(spark, docs_of(found).repartition(5), DATA)
        assert got.columns == docs_of(rows).columns and got.dtypes == docs_of(rows).dtypes
        return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)

    named = [(1, text(1)), (2, text(2)), (4, ""), (5, text(5)), (6, text(6)), (7, None)]
    assert kept(rows) == sorted(named, key=str)
    for more in ([], [((1 << 63) - 1, text(10))]):
        got = kept(rows + bare + more)
        assert len([t for i, t in got if i is None or i == 2 if t == text(2)]) == 1
        assert len([t for i, t in got if i is None and t and t.startswith(text(8))]) == 1
        assert [x for x in got if x[0] is not None and x[0] != 2] == sorted([*[x for x in named if x[0] != 2], *more], key=str)
        assert sum(i is None and t != text(2) for i, t in got) == 4
    assert kept(bare[1:3]) == [(None, text(8))]
    assert kept([]) == []
