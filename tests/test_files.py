"""Sources that keep file order, against plain readings of the same files."""

import bz2
import os
import random

import pytest

from lexiloom.sources import lines, readers


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_keep_their_place_over_splits(spark, tmp_path, small_splits):
    rand, want = random.Random(1), []
    for name, n, end in (("a.txt", 4000, "\n"), ("b.txt.bz2", 30000, "\n"), ("c.txt", 3000, "")):
        rows = ["" if rand.random() < 0.1 else "x" * rand.randrange(120) + f"{i}é" for i in range(n)]
        data = ("\n".join(rows) + end).encode()
        (tmp_path / name).write_bytes(bz2.compress(data, 1) if name.endswith("bz2") else data)
        want += [(name, i, v) for i, v in enumerate(rows, 1)]
    df = lines.numbered_lines(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 8
    got = sorted((r.position, os.path.basename(r.file), r.line_no, r.value) for r in df.collect())
    assert [g[1:] for g in got] == want and [g[0] for g in got] == list(range(1, len(want) + 1))


def test_no_lines(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    assert lines.numbered_lines(spark, str(tmp_path)).count() == 0


def test_only_kept_rows_are_numbered(spark, tmp_path, small_splits):
    rows = [f"line {i} " + "x" * 100 for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(rows))
    kept = lines.sourced(spark.read.text(str(tmp_path))).where("value like '%7 %'")
    got = sorted((r.position, r.value) for r in lines.placed(kept).collect())
    assert [v for _, v in got] == [r for r in rows if "7 " in r] and [p for p, _ in got] == list(range(1, len(got) + 1))


def test_strict_pages_name_the_line(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"title": "a", "intro": "b"}\n\n{"title": "c"}\n')
    with pytest.raises(Exception, match=r"p\.jsonl:3 page without title or intro: missing required key 'intro'"):
        readers.read_pages(spark, str(path)).collect()
    path.write_text('{"title": "a", "intro": "b", "url": "u"}\n\n{"title": broken\n[1]\n')
    assert [(r.line_no, r.fault) for r in readers.page_faults(spark, str(path)).orderBy("line_no").collect()] == [(3, "not a JSON object"), (4, "not a JSON object")]


def test_tolerant_pages_count_what_is_left(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"title": "a", "text": "x"}\nbroken\n{"title": "b"}\n{"title": "c", "intro": "", "summary": "y", "page_id": 77}\n{"id": 0, "title": "d", "intro": "z"}\n')
    got = sorted((r.page_id, r.title, r.intro) for r in readers.read_pages_tolerant(spark, str(tmp_path)).collect())
    assert got == [(1, "a", "x"), (3, "d", "z"), (77, "c", "y")]


def test_qids_and_vectors_by_line(spark, tmp_path):
    (tmp_path / "q.csv").write_text("Entity,QRank\nQ5,9\nQ2,9\nQ9,100\n")
    assert sorted((r["rank"], r.qid) for r in readers.read_qids(spark, str(tmp_path / "q.csv"), 2).collect()) == [(1, "Q5"), (2, "Q2")]
    (tmp_path / "v.txt").write_text("5 2\nchat 0 0\nChat 3 4\nchat 1 0\nlong 1 2 3\nbad x 1\n")
    vocabulary = spark.createDataFrame([("chat",), ("long",), ("bad",)], "word string")
    assert [(r.word, [round(x, 6) for x in r.vec]) for r in readers.read_vectors(spark, str(tmp_path / "v.txt"), vocabulary, 2).collect()] == [("chat", [0.6, 0.8])]
