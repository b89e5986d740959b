"""The pipeline: planted cases, and each stage as a filter of its own input."""

from pyspark.sql import functions as F

import corpus_pipeline

from .common import GIVEN, edge_documents, sentence, write_tables


def test_planted_cases(spark, tmp_path):
    text = lambda k: ". ".join(sentence(k, 90).split(" "))
    copied = sentence(70, 90)
    passage = sentence(71, 60)
    documents = [(k, sentence(k, 90), "en", "s", 0) for k in range(1, 20)]
    documents += [(100, copied, "en", "s", 0), (101, copied, "en", "s", 0), (102, copied.rsplit(" ", 1)[0] + " end", "en", "s", 0)]
    documents += [(110 + k, f"{sentence(110 + k, 70)} {passage}", "en", "s", 0) for k in range(2)]
    documents += [(120, f"{sentence(120, 70)} {GIVEN}", "en", "s", 0), (130, "### *** $$$ %%% " * 60, "en", "s", 0), (131, "too short", "en", "s", 0)]
    folder = write_tables(tmp_path, documents, [(k, 1, 0) for k in range(1, 15)] + [(130, 0, 0)], [(1, GIVEN)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, str(folder))
        assert after.schema == docs.schema
        docs = after.cache()
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(range(1, 20)) <= set(kept[-1])
    assert not {130, 131} & set(kept[0])
    assert 100 in kept[1] and not {101, 102} & set(kept[1])
    assert passage not in kept[2][110] and passage not in kept[2][111] and kept[2][110].startswith(sentence(110, 60))
    assert 120 in kept[2] and 120 not in kept[3]
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, str(folder)).collect()}
    assert set(result) == set(kept[3]) and all(r.agrees and r.n_tokens > 0 for r in result.values())


def test_stages_on_awkward_rows(spark, tmp_path):
    folder = str(write_tables(tmp_path, []))
    rows = edge_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, rows, folder)
        assert after.schema == rows.schema
        after.collect()
    near = corpus_pipeline.near_duplicates(spark, rows, folder).collect()
    assert sorted(r.doc_id for r in near if r.doc_id in (4, 5, 6, 8, 9)) == [4, 8] and sum(r.doc_id is None for r in near) == 2
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_rows_are_known_by_id_and_text(spark, tmp_path):
    a, b, c = sentence(80, 90), sentence(81, 90), sentence(82, 90)
    rows = [(1, a), (5, a), (5, b), (None, a), (9, c), (9, c.rsplit(" ", 1)[0] + " end"), (9, c), (None, sentence(83, 60)), (7, None), (8, None), (8, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit("clash"))
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert [x for x in found if x[0] != 9] == sorted([(1, a), (5, b), (None, sentence(83, 60)), (7, None), (8, None), (3, "")], key=repr)
    assert sum(x[0] == 9 for x in found) == 1
