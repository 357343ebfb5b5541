import json
import os
import random

import pytest

from lexiloom.streaming import ingest


def land(folder, batches):
    """One file per batch of responses, in the order of their times."""
    folder.mkdir()
    for i, responses in enumerate(batches):
        path = folder / f"{i:03}.jsonl"
        path.write_text("\n".join(responses))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def response(pages):
    return json.dumps({"query": {"pages": {str(n): p for n, p in pages}}})


@pytest.fixture()
def landed(tmp_path):
    rand = random.Random(4)
    batches, plain = [], []
    for i in range(6):
        responses = []
        for j in range(3):
            pages = []
            for k in range(5):
                title = rand.choice(["Paris", "paris", "Rome", "Liste de x", "", "Lyon", f"T{rand.randrange(40)}", f"T{rand.randrange(40)}"])
                text = rand.choice(["x" * 200, "y" * 179, "  " + "z" * 190 + " ", "peut désigner " + "q" * 200, "w" * 250])
                page = {"title": title, "extract": text, "fullurl": f"u{i}{j}{k}"} | ({"missing": ""} if rand.random() < 0.1 else {})
                pages.append((k, page))
            responses.append(response(pages))
            plain += [p for _, p in pages]
        batches.append([*responses, "not json", ""])
    land(tmp_path / "landed", batches)
    rows, seen = [], set()
    for p in plain:
        text, key = p.get("extract", "").strip(), p["title"].lower()
        if "missing" in p or not key or len(text) < 180 or key in seen or key.startswith("liste de") or "peut désigner" in text:
            continue
        seen.add(key)
        rows.append((p["title"], text, p["fullurl"]))
    return str(tmp_path / "landed"), rows


@pytest.mark.parametrize(("files_at_once", "limit"), [(None, None), (1, None), (2, 7), (1, 7), (None, 7)])
def test_same_rows_whatever_the_batches(spark, tmp_path, landed, files_at_once, limit):
    folder, rows = landed
    out = str(tmp_path / "out")
    ingest.ingest(ingest.landed_responses(spark, folder, files_at_once), out, str(tmp_path / "checkpoint"), limit).awaitTermination()
    assert sorted((r.title, r.intro, r.url) for r in ingest.ingested(spark, out).collect()) == sorted(rows[:limit])


def test_resumed_half_way_and_after_a_crash(spark, tmp_path, landed):
    folder, rows = landed
    out, half = str(tmp_path / "out"), tmp_path / "half"
    half.mkdir()
    for name in sorted(os.listdir(folder)):
        os.link(f"{folder}/{name}", half / name)
        ingest.ingest(ingest.landed_responses(spark, str(half), 1), out, str(tmp_path / "checkpoint"), 9).awaitTermination()
    assert sorted((r.title, r.intro, r.url) for r in ingest.ingested(spark, out).collect()) == sorted(rows[:9])
    # A batch that is run again looks only at those before it, and replaces what it wrote.
    last = ingest.ingested(spark, out).where("batch = 1").drop("batch").collect()
    lines = ingest.sourced(spark.read.text(f"{folder}/001.jsonl"))
    ingest.append_new(ingest.pages_of_responses(lines), 1, out, 9, 180)
    assert sorted(ingest.ingested(spark, out).where("batch = 1").drop("batch").collect()) == sorted(last)


def test_nothing_landed(spark, tmp_path):
    (tmp_path / "landed").mkdir()
    ingest.ingest(ingest.landed_responses(spark, str(tmp_path / "landed")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert ingest.ingested(spark, str(tmp_path / "out")).count() == 0
