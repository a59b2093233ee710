from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from tessera.llm import lshforest, mixing, packing, pii, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, edge, empty):
    """Each stage on odd rows and on none: columns stay, decisions take effect."""
    for docs in (edge, empty):
        for name, stage in P.STAGES[:-1]:
            assert stage(spark, docs, FOLDER).columns == docs.columns, name
        P.STAGES[-1][1](spark, docs, FOLDER).collect()
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.without_toxic(edge, labels).count() == edge.count()
    kept = lshforest.deduplicated(edge).collect()
    near = {r.doc_id: r.component_id for r in lshforest.near_duplicates(edge).collect()}
    assert {r.doc_id for r in kept} == {i for i, c in near.items() if i == c}
    text = P.redact_personal_data(spark, edge, FOLDER).where("doc_id = 20").first()
    assert text.n_chars == len(text.text) and "[EMAIL]" in text.text and text.score == "0.5"


def test_run_equals_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = P.run(spark, FOLDER).collect()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    fine = toxicity.scored(docs, labels).where("predicted = 0").select(*docs.columns)
    fine = fine.join(lshforest.near_duplicates(fine).where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    model = pii.model()
    texts = {r.doc_id: pii.redact(r.text, pii.all_spans([r.text], model)[0][1]) for r in fine.collect()}
    clean = fine.select("doc_id", "source").join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id")
    repeats = {r.doc_id: r.repeats for r in mixing.mix(clean).collect()}
    want = Counter({i: n * (len(packing.token_ids([texts[i]])[0]) + 1) for i, n in repeats.items() if n})
    have = Counter()
    for r in got:
        have[r.doc_id] += r.length
    assert have == want
    size = Counter()
    for r in got:
        size[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in size.values()) and F


def test_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
