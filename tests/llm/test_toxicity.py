"""Toxicity: automata against edit distance, windows on quotations, held-out accuracy on the given documents."""

import os
import random

import pytest
from pyspark.sql import functions as F

from timberline.llm.common import table
from timberline.llm.toxicity import Context, Lexicon, Model, edits_allowed, find_hits, judge_toxicity, labelled_texts, op13_toxicity, quoted, train

INSULTS = ["grumblenut", "fooltrap", "snivel", "blatherskite"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def garbled(rng, word, letters, edits):
    for _ in range(edits):
        k, kind = rng.randrange(len(word) + 1), rng.randrange(3)
        word = word[:k] + rng.choice(letters) + word[k:] if kind == 0 else word[:k] + (rng.choice(letters) if kind == 1 else "") + word[k + 1 :]
    return word


@pytest.mark.parametrize("letters", ["ab", "abcdé"])
def test_against_edit_distance(letters):
    rng = random.Random(len(letters))
    draw = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(3, 13)))
    for _ in range(100):
        terms = {draw(): rng.random() for _ in range(rng.randint(1, 12))}
        lexicon = Lexicon(terms)
        for _ in range(40):
            word = garbled(rng, rng.choice(list(terms)) if rng.random() < 0.8 else draw(), letters, rng.randint(0, 3))
            near = [(distance(word, t), -v, t) for t, v in terms.items() if word == t or (len(word) > 3 and distance(word, t) <= edits_allowed(len(t)))]
            want = min(near, default=None)
            assert lexicon.find(word) == (want and (want[2], want[0]))


def test_quotation_scores_below_abuse():
    model = Model(Lexicon({"snivel": 1.0}), Context())
    score = lambda text: [model.context.score(text.split(), k) for k, _, _ in model.hits(text.split(), {})]
    plain, marks, told, both = (score(t)[0] for t in ("you are a snivel now", 'it is "a snivel" now', "she said snivel to him", 'the word "snivel" is old'))
    assert both < marks < 0.5 < plain and both < told < plain
    assert quoted('he said "you are a snivel".'.split(), 5) and not quoted('a "nice" snivel came'.split(), 2) and not quoted("no marks, snivel".split(), 2)
    far = 'open " ' + "word " * 30 + "snivel"
    assert not quoted(far.split(), 32)


def made_docs(rng, n):
    calm = ["river", "stone", "paper", "garden", "window", "letter", "market", "summer"]
    rows = []
    for k in range(n):
        words = [rng.choice(calm) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), garbled(rng, rng.choice(INSULTS), "xyz", rng.random() < 0.1))
        elif k % 5 == 1:
            at = rng.randrange(len(words))
            words[at:at] = ["she", "said", f'"{rng.choice(INSULTS)}"'] if k % 10 == 1 else ["paper"]
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_learned_from_labels(spark, frame):
    rows = made_docs(random.Random(4), 1200)
    docs = frame([r[:2] for r in rows], "doc_id bigint, text string").withColumnRenamed("n", "predicted")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = train(docs, labels)
    assert set(model.lexicon.severity) == set(INSULTS)
    fresh = [(1, "you are a blathersklte."), (2, "the GRUMBLENUT! went"), (3, "river stone paper"), (4, None), (5, ""), (None, "snivel " * 5), (7, "river " * 200_000 + "fooltrap fooltrap")]
    got = judge_toxicity(frame(fresh, "doc_id bigint, text string"), model).collect()
    assert {r["doc_id"]: r["predicted"] for r in got} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, None: 1, 7: 1}
    assert all(0 <= r["score"] <= 1 for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    hits = find_hits(docs.limit(0).union(spark.createDataFrame([(1, 'a "blathersklte" said') + ("x",) * (len(docs.columns) - 2)], docs.schema)), model).collect()
    assert [(r["place"], r["term"], r["edits"], r["quoted"]) for r in hits] == [(1, "blatherskite", 1, True)]
    judged = judge_toxicity(docs, model).join(labels, "doc_id").filter("held_out")
    right = judged.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.97
    assert judge_toxicity(docs.limit(0), model).collect() == []


def test_sample_is_bounded_in_rows(spark):
    docs = spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.range(2, 500).select(F.col("id").alias("doc_id"), F.lit("river").alias("text")))
    labels = spark.range(600).select(F.when(F.col("id") < 590, F.col("id")).alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert labelled_texts(docs, labels, 100).count() <= 100
    assert labelled_texts(docs, labels).filter("doc_id = 1").count() <= 1


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "snivel"), (2, "river")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["predicted"] for r in judge_toxicity(docs, train(docs, none)).collect()] == [0, 0]


def test_query_holds_on_unseen_rows(spark):
    big = "/root/testdata/sf0.1"
    if not os.path.isdir(big):
        pytest.skip("no larger test data")
    judged = op13_toxicity(spark, big).join(table(spark, big, "labels"), "doc_id").filter("held_out")
    told = judged.groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r["toxic"]: r["share"] for r in told}
    assert share[1] > 0.85 and share[0] < 0.01
    assert op13_toxicity(spark, big).count() == table(spark, big, "documents").count()


def test_other_samples_are_bounded_in_rows(spark):
    from timberline.llm.quality_rules import training_sample

    docs = spark.range(30_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, None), (2, "b b"), (3, "c")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id bigint, quality int")
    x, y = training_sample(docs, labels)
    assert len(x) == 2 and sorted(y) == [0, 1]
