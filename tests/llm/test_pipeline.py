"""The pipeline's stages, each against brute force on its own input."""

import random

from timberline.llm.quality_rules import judge_quality, train
from timberline.session import stored

import corpus_pipeline
from test_free import groups_by_hand
from test_native import lines_by_hand


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "packing"]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = stored(stages["quality_rules"](spark, docs, sf_dir))
    assert good.columns == docs.columns
    assert set(rows(good)) == {r.doc_id for r in judge_quality(docs, forest).filter("kept").collect()}

    cleaned = stored(stages["line_dedup"](spark, good, sf_dir))
    assert sorted(rows(cleaned).items()) == sorted((i, t) for i, _, _, t in lines_by_hand(list(rows(good).items())))
    assert cleaned.filter("n_chars <> length(text)").count() == 0

    single = stored(stages["near_dedup"](spark, cleaned, sf_dir))
    assert set(rows(single)) == {i for i, (_, _, kept) in groups_by_hand(list(rows(cleaned).items())).items() if kept}

    clean = stored(stages["decontaminate"](spark, single, sf_dir))
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    passages = {tuple(w[k : k + 15]) for w in items for k in range(len(w) - 14)}
    left = [i for i, t in rows(clean).items() if any(tuple(words(t)[k : k + 15]) in passages for k in range(len(words(t)) - 14))]
    assert left == [] and 0 < clean.count() < single.count()

    packed = stages["packing"](spark, clean, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(rows(clean))
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_null_and_repeated_ids(spark, tmp_path):
    rnd = random.Random(14)
    other = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    copied, passage, clean, near = other(40), other(30), other(40), other(80)
    spark.createDataFrame([(0, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(5, copied), (None, copied), (None, clean), (7, other(30)), (7, other(30)), (8, clean + " x y z"), (9, "same " + copied[:99]), (9, "same " + copied[:99])]
    rows += [(None, near), (None, near + " end"), (None, near + " close"), (None, other(50))]
    rows += [(11, ""), (12, None), (None, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, extra bigint")
    left = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    got = [r.extra for r in left.collect()]
    assert left.columns == docs.columns and len([k for k in got if k in (8, 9, 10)]) == 1
    assert sorted(k for k in got if k not in (8, 9, 10)) == [0, 3, 4, 5, 6, 11, 12, 13, 14]

    rows = [(None, other(9) + " " + passage), (None, clean), (None, clean), (4, other(5) + " " + passage), (4, clean), (6, None), (None, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, extra bigint")
    assert sorted(r.extra for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()) == [1, 2, 4, 5, 6]
