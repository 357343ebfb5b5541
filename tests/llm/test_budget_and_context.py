"""The classifier's budget skips a text that is too long; contexts of identifiers have no limit of distance."""

import random

from lexiloom.llm import pii, quality


def test_a_text_over_the_budget_shuts_out_no_other(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_BYTES", 40_000)
    monkeypatch.setattr(quality, "FIT_TEXT", 5_000)
    rand = random.Random(1)
    good, bad = "clear useful prose about rivers".split(), "click buy win free now".split()
    rows = [(i, " ".join(rand.choice(good if i % 2 else bad) for _ in range(40))) for i in range(60)] + [(100 + i, "click " * 20_000) for i in range(5)]
    labels = [(i, i % 2) for i in range(60)] + [(100 + i, 1) for i in range(5)]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    scores = {r.doc_id: r.score for r in quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert min(scores[i] for i in range(1, 60, 2)) > 0.7 > 0.3 > max(scores[i] for i in range(0, 60, 2))


def test_patterns_reach_over_any_distance():
    near = pii.observe("call mail: a.b@c.org thanks")[1][0]["patterns"]
    far = pii.observe("call mail:" + " " * 500 + "a.b@c.org" + "\n" * 500 + "thanks")[1][0]["patterns"]
    assert near == far == ["call mail _", "mail _", "mail _ thanks", "_ thanks"]
    glued = pii.observe("call mail:a.b@c.org, thanks")[1][0]["patterns"]
    assert glued == near
    long = pii.observe("x" * 5000 + " a.b@c.org")[1][0]["patterns"]
    assert len(long) == 1 and len(long[0]) < 80
    assert pii.observe("a.b@c.org")[1][0]["patterns"] == []
