"""The pipeline against plain formulations of its stages."""

import re

import corpus_pipeline
from lexiloom.llm import pii, simhash
from lexiloom.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(staged(stage(spark, tables[-1], SF), name))
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert all(t.columns == corpus_pipeline.COLUMNS for t in tables[:-1])
    good = {r.doc_id: r.text for r in tables[1].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(d) == 0 for d in good) < 0.1 * len([q for q in labels.values() if q == 0]) + 1
    prints = {d: simhash.fingerprint((t or "").encode()) % (1 << 64) for d, t in good.items()}
    for d in ids[1] - ids[2]:
        assert any(bin(prints[d] ^ prints[e]).count("1") <= 4 for e in prints if e != d)
    bench = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(w[i : i + 10]) for w in map(word.findall, bench) for i in range(len(w) - 9)}
    hit = {d for d in ids[2] if any(tuple(w[i : i + 10]) in windows for w in [word.findall((good[d] or "").lower())] for i in range(len(w) - 9))}
    assert ids[2] - ids[3] == hit
    assert all(not pii.base_spans(r.text or "") for r in tables[4].collect())
    assert ids[5] == ids[4]
