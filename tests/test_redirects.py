import random

from lexiloom.operators import game, redirects


def follow(links, start):
    at, n, seen = start, 0, set()
    while at in links:
        if at in seen:
            return None, None
        seen.add(at)
        at, n = links[at], n + 1
    return at, n


def test_chains_and_circles(spark):
    rand = random.Random(2)
    links = {i: i - 1 for i in range(1, 100)} | {200: 201, 201: 202, 202: 200, 203: 201, 300: 300} | {1000 + i: 1000 + rand.randrange(80) for i in range(60)} | {2000 + i: 50 for i in range(40)}
    rows = [*links.items(), (5, 90), (None, 1), (7, None)]
    got = {r.source: (r.target, r.steps) for r in redirects.resolved(spark.createDataFrame(rows, "source long, target long").repartition(3)).collect()}
    assert got == {s: follow(links, s) for s in links}
    assert redirects.resolved(spark.createDataFrame([], "source long, target long")).count() == 0


def test_patches(spark):
    pages = spark.createDataFrame([(1, "A_b", "old"), (2, "C", "old"), (3, "D", None), (4, "E", "x" * 120), (5, "F", "kept")], "page_id long, title string, intro string")
    fetched = spark.createDataFrame([("A b", "y" * 90 + "[3] it's\n\n\n\nso" + "z" * 20), ("D", "short"), ("T", "t" * 100), ("E", "x" * 120), (None, None)], "title string, extract string")
    links = spark.createDataFrame([("C", "S"), ("S", "T"), ("F", "G"), ("G", "F")], "source string, target string")
    patches = redirects.redirect_patches(pages, fetched, links)
    assert {r.page_id: (r.char_count, r.word_count) for r in patches.collect()} == {1: (90 + 5 + 2 + 22, 3), 2: (100, 1)}
    said = {r.page_id: r.statement for r in redirects.update_statements(patches).collect()}
    assert said[2] == f"UPDATE pages SET intro='{'t' * 100}', char_count=100, word_count=1 WHERE id=2;" and "it''s" in said[1]


def test_information_is_the_folded_words(spark):
    canons = spark.createDataFrame([("abcs",), ("abc",), ("les",), ("zz",), ("none",)], "canon string")
    idf = spark.createDataFrame([("abcs", 5.0), ("abc", 2.0), ("zz", 4.0)], "word string, idf double")
    assert {r.canon: r.info for r in game.word_information(canons, idf).collect()} == {"abcs": 2.0, "abc": 2.0, "les": 0.0, "zz": 0.0, "none": 1.0}
