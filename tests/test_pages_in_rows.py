from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import corpus, game, lexical, policy, redirects, rows


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_renderings_keep_tokens_in_their_rows(spark):
    pages = spark.createDataFrame([(1, "Paris", "Paris est d'ÉTÉ,  la\n\ncapitale aux chevaux du cheval ___ 12."), (2, "", ""), (3, "Un mot", "mot")], "page_id long, title string, intro string")
    guesses = spark.createDataFrame([(1, 1, "chevaux"), (1, 2, "été"), (1, 3, "paris"), (3, 1, "rien")], "game_id long, turn int, guess string")
    shown, long = game.shown_pages(pages, guesses), game.reveals(game.page_tokens(pages), guesses)
    for render in (game.masked_text, game.compact_text, game.full_text):
        for turn in (1, 2, 9):
            assert sorted(render(shown, turn).collect()) == sorted(render(long, turn).collect())
        assert "Generate explode(tokens" not in _plan(render(shown)) and "Window" not in _plan(render(shown)) and "collect_list(struct(idx" not in _plan(render(shown))
    assert {r.game_id: r.text for r in game.masked_text(shown, 1).collect()}[1] == "█████\n\n█████ ███ █'███,  ██\n\n████████ ███ chevaux ██ cheval ___ ██."
    assert {r.game_id for r in game.full_text(shown).collect()} == {1, 3}
    for form in (True, False):
        want = game.reveals(game.page_tokens(pages), guesses, form).where("reveal_turn is not null").select("game_id", "idx", "reveal_turn")
        assert sorted(game.shown_places(game.shown_pages(pages, guesses, form)).collect()) == sorted(want.collect())


def test_texts_are_cut_once(spark):
    pages = spark.createDataFrame([(1, "T", "un mot")], "page_id long, title string, intro string")
    assert _plan(game.page_tokens(pages)).count("regexp_extract_all(intro") == 1


def test_issues_work_texts_out_once(spark):
    pages = spark.createDataFrame([(1, "t", " \nOTAN EST UN SIGLE. [[x]] <REF> Cette  page", ""), (2, None, "homonymie", ""), (3, "Homonymie", "best un siglet", "")], "page_id long, title string, intro string, url string")
    got = {r.page_id: r.issues for r in corpus.with_issues(pages).collect()}
    few = ["too_short_chars", "too_short_words"]
    assert got == {1: [*few, "sigle_like", "markup_residue"], 2: few, 3: [*few, "homonymy_like"]}
    assert _plan(corpus.with_issues(pages)).count("trim(") == 2  # each of title and intro once


def test_article_words_of_apostrophes(spark):
    df = spark.createDataFrame([("L'été d’aujourd'hui l l' qu'l'Œuvre  ÉTÉ lorsqu lorsqu'il",), ("",)], "t string")
    assert [r[0] for r in df.select(T.article_words(F.col("t"))).collect()] == [["aujourd", "ete", "hui", "il", "lorsqu", "oeuvre"], []]


def test_circles_end_the_rounds(spark, monkeypatch):
    n, written = 4096, []
    keep = redirects.staged
    monkeypatch.setattr(redirects, "staged", lambda df, name: written.append(name) or keep(df, name))
    links = spark.range(n).select(F.col("id").alias("source"), F.when(F.col("id") % 4 == 3, F.col("id") - 3).otherwise(F.col("id") + 1).alias("target")).union(spark.createDataFrame([(9000, 9001), (9001, 9002)], "source long, target long"))
    got = redirects.resolved(links)
    assert got.where("target is null and steps is null").count() == n
    assert {tuple(r) for r in got.where("target is not null").collect()} == {(9000, 9002, 2), (9001, 9002, 1)}
    assert len(written) <= 5


def test_means_on_a_step(spark):
    rewards = [0.1, 0.2, -0.3, 0.7, -0.7, 1.1, -1.1]
    for order in (rewards, rewards[::-1], sorted(rewards)):
        df = spark.createDataFrame([(1, "a", x) for x in order] + [(1, "b", -0.0001), (1, "c", float("nan"))], "game_id long, action string, reward double").coalesce(1)
        got = {r.action: r.value for r in policy.stepped_means(df, ["game_id", "action"], "reward", 50, "value").collect()}
        assert got["a"] == 0 and got["b"] == -1


def test_far_title_actions_send_lists(spark):
    shown = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "z")], "row_id long, word string")
    near = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.5), ("b", "x", 0.8), ("b", "y", 0.8), ("a", "w", 1.0)], "word string, other string, score double")
    found = rows.far_title_actions(shown, spark.createDataFrame([(1, "x"), (2, "y")], "pos int, word string"), near, 0.8)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (2, 1)]
    assert "max(score" not in _plan(found)


def test_pairs_are_counted_in_tasks(spark, monkeypatch):
    pages = [(1, ["b", "a", "z", "c"]), (2, ["c", "a"]), (3, ["b"]), (4, []), (5, ["d", "c", "b", "a"])]
    lists = spark.createDataFrame(pages, "page_id long, words array<string>").repartition(2)
    vocab = spark.createDataFrame([("c",), ("a",), ("b",), ("d",)], "word string")
    long = lists.select("page_id", F.explode("words").alias("word"))
    want = {("a", "b", 2), ("a", "c", 3), ("b", "c", 2)}  # of page 5 the first three
    for dense, held in ((2048, 4_000_000), (0, 2)):
        monkeypatch.setattr(lexical, "DENSE_WORDS", dense)
        monkeypatch.setattr(lexical, "HELD_PAIRS", held)
        for words in (lists, long):
            assert {tuple(r) for r in lexical.pair_counts(words, vocab, 3).collect()} == want
    assert lexical.pair_counts(lists, vocab.limit(0)).count() == 0


def test_pages_of_many_words_give_all_their_pairs(spark, monkeypatch):
    pages = [(p, [f"w{i:03}" for i in range(p, 300, step)]) for p, step in ((0, 1), (1, 1), (2, 7), (3, 2))]
    lists = spark.createDataFrame(pages, "page_id long, words array<string>").repartition(2)
    vocab = spark.createDataFrame([(f"w{i:03}",) for i in range(300)], "word string")
    want = {}
    for _, words in pages:
        for at, l in enumerate(words):
            for r in words[at + 1 :]:
                want[l, r] = want.get((l, r), 0) + 1
    for dense, some, held in ((2048, 2, 4_000_000), (0, 2, 1000)):
        for name, n in (("DENSE_WORDS", dense), ("DENSE_PAGES", some), ("HELD_PAIRS", held)):
            monkeypatch.setattr(lexical, name, n)
        assert {(r.l, r.r): r.n for r in lexical.pair_counts(lists, vocab).collect()} == want
