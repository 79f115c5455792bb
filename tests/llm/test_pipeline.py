import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from flowloom.llm import decontam, langid, minhash, quality
from flowloom.llm.common import table
from flowloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        got = {r.doc_id for r in docs.select("doc_id").collect()}
        assert got <= {r.doc_id for r in before.select("doc_id").collect()}
        if k < 4:
            assert docs.columns == columns
        # each stage is what its operator decides on all that the stage before kept
        if k == 0:
            marked, at = langid.identify(before, before)
            want = marked.where(langid.accepted(F.col(at), corpus_pipeline.LEAST_LANGUAGE))
        elif k == 1:
            marked, at = quality.score(before, quality.fit(before, table(spark, SF, "labels")))
            want = marked.where(F.col(f"{at}.score") >= quality.THRESHOLD)
        elif k == 2:
            want = minhash.classes(before).where("kept")
        elif k == 3:
            want = decontam.contamination(before, table(spark, SF, "benchmark")).where(~decontam.contaminated())
        else:
            want = before
        assert got == {r.doc_id for r in want.select("doc_id").collect()}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    assert docs.where("not round_trip").count() == 0


def test_clean_documents_stay(spark):
    kept = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    d = pd.read_parquet(f"{SF}/documents.parquet").merge(pd.read_parquet(f"{SF}/labels.parquet").query("quality == 1"))
    unique = d[~d.text.duplicated(keep=False)]
    assert unique.doc_id.isin(kept).mean() > 0.85


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup", "benchmark decontamination", "SentencePiece"]
