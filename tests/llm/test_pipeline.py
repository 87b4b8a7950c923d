"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.conftest import SF, read
from tests.llm.test_jaccard_dedup import kept_by_brute_force
from tests.llm.test_operators import base_spans


def test_stages(spark):
    docs = read(spark, "documents")
    names, before = docs.columns, docs.collect()
    scores = None
    for k, (name, stage) in enumerate(pipeline.STAGES):
        df = stage(spark, docs, SF)
        after = df.collect()
        if k == 0:
            scores = {r.doc_id for r in after}
            assert df.columns == names and scores <= {r.doc_id for r in before} and len(after) > 0.7 * len(before)
            poor = {r.doc_id for r in read(spark, "labels").where("quality = 0").collect()}
            assert len(scores & poor) <= 0.2 * len(poor)
        if k == 1:
            want, _ = kept_by_brute_force({r.doc_id: r.text for r in before})
            assert df.columns == names and sorted(r.doc_id for r in after) == want
        if k == 2:
            assert df.columns == names and len(after) == len(before)
            assert all(not base_spans(r.text) and r.n_chars == len(r.text) for r in after)
            texts = {r.doc_id: r.text for r in before}
            assert all(r.text == texts[r.doc_id] for r in after if not base_spans(texts[r.doc_id]) and "<secret>" not in r.text)
        if k == 3:
            times = Counter(r.doc_id for r in after)
            assert df.columns == names and max(times.values()) <= 2 and set(times) <= {r.doc_id for r in before}
        if k == 4:
            assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
            filled = Counter()
            for r in after:
                filled[r.sequence_id] += r.length
            assert max(filled.values()) <= 2048
        docs, before = spark.createDataFrame(after, df.schema), after
    again = pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in again) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in before)


def test_stages_on_awkward_rows(spark, odd_docs):
    """No stage fails, and extra columns come back with the values of their row, whatever their names."""
    extra = [c for c in odd_docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    tagged = odd_docs.withColumns({c: F.concat(F.lit(f"{c}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in extra})
    for some in (tagged, tagged.limit(0)):
        docs = some
        for k, (_, stage) in enumerate(pipeline.STAGES):
            df = stage(spark, docs, SF)
            rows = df.collect()
            if k < 4:
                assert df.columns == some.columns
                assert all(r[c] == f"{c}/{'none' if r.doc_id is None else r.doc_id}" for r in rows for c in extra)
            docs = spark.createDataFrame(rows, df.schema)
