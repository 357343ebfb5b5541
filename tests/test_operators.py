import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import corpus, datasets, game, lexical, oracles, policy, vectors
from lexiloom.sources import readers


def pages(spark):
    return spark.createDataFrame([(1, "Paris", "Paris est la capitale de la France.", ""), (2, "Football", "Le football est un sport de ballon.", "")], "page_id long, title string, intro string, url string")


def test_reveal_and_solve(spark):
    guesses = spark.createDataFrame([(1, 1, "paris"), (2, 1, "paris")], "game_id long, turn int, guess string")
    shown = game.reveals(game.page_tokens(pages(spark)), guesses)
    assert {(r.game_id, r.solved_turn) for r in game.solved_at(shown).collect()} == {(1, 1), (2, None)}
    assert {(r.game_id, r.exact) for r in game.exact_hits(shown, guesses).collect()} == {(1, 2), (2, 0)}
    masked = {r.game_id: r.text for r in game.masked_text(shown).collect()}
    assert masked[1].startswith("Paris\n\nParis ███ ██")
    compact = {r.game_id: r.text for r in game.compact_text(shown).collect()}
    assert compact[1].startswith("Paris\n\nParis __ __") and compact[2].startswith("__\n\n__ __")


def test_rewards(spark):
    guesses = spark.createDataFrame([(1, 1, "football"), (1, 2, "Football"), (1, 3, "think"), (1, 4, "xyzqwerty"), (1, 5, "Paris")], "game_id long, turn int, guess string")
    words = lexical.page_words(pages(spark).withColumn("t", F.concat_ws(" ", "title", "intro")), "page_id", "t")
    idf = lexical.smoothed_idf(lexical.document_frequency(words), 2).select("word", "idf")
    sim = spark.createDataFrame([("football", "sport", 0.6)], "l string, r string, sim double")
    real = spark.createDataFrame([("football",)], "word string")
    rows = {r.turn: r for r in game.guess_rewards(game.page_tokens(pages(spark)), guesses, idf, sim, real).collect()}
    assert rows[1].reward < -20 and not rows[1].solved
    assert rows[2].reward == -100 and rows[3].reward == -100 and rows[4].reward == -200
    assert rows[5].solved and rows[5].reward > 400 and rows[5].exact == 2


def test_solver_ends_solved(spark):
    tokens = game.page_tokens(pages(spark)).where("is_word")
    body = tokens.select(F.col("game_id").alias("page_id"), F.col("canon").alias("word")).distinct()
    head = tokens.where("in_title").select(F.col("game_id").alias("page_id"), F.col("canon").alias("word")).distinct()
    idf = lexical.smoothed_idf(lexical.document_frequency(body), 2)
    games = spark.createDataFrame([(7, 1), (8, 2)], "game_id long, page_id long")
    steps = datasets.solve_closed_set(games, body, head, idf, ["france", "sport"]).collect()
    assert {r.game_id for r in steps if r.solved} == {7, 8}


def _solved_alone(words, titles, weights, page, starters, most_steps, vocabulary):
    left, known, present, guessed, rows = sorted(words), set(), set(), [], []
    idf = lambda w: weights.get(w, 1.0)
    worth = lambda p: sum(idf(w) for w in present & words[p]) + 2.5 * sum(idf(w) for w in present & titles.get(p, set())) - 0.01 * len(words[p])
    for turn in range(1, most_steps + 1):
        ranked = sorted(left, key=lambda p: (-round(worth(p), 9), p))
        free = [s for s in starters if s not in guessed]
        named = [w for p in ranked for w in sorted(titles.get(p, ()), key=lambda w: (-idf(w), w)) if w not in guessed] if len(left) <= 3 else []
        pool = ranked[:250]
        share = {w: sum(w in words[p] for p in pool) / len(pool) for p in pool for w in words[p] if w not in guessed and len(w) >= 3 and not w.isdigit()}
        head = lambda w: sum(w in titles.get(p, ()) for p in pool) / len(pool)
        split = sorted(share, key=lambda w: (-round(share[w] * (1 - share[w]) + 0.18 * share[w] * idf(w) + 0.8 * head(w), 9), w))
        guess = next(iter([*free[:1], *named[:1], *split[:1], *[w for w in vocabulary if w not in guessed]]), None)
        if guess is None:
            break
        guessed.append(guess)
        hit = guess in words.get(page, ())
        known |= {guess} if hit else set()
        present |= {guess} if hit else set()
        left = [p for p in left if (guess in words[p]) == hit] or left
        rows.append((turn, guess, len(left), bool(titles.get(page)) and titles[page] <= known))
        if rows[-1][3]:
            break
    return rows


def test_solver_equals_games_played_alone(spark):
    words = {p: {f"w{(p * k * k + k) % 23}" for k in range(2, 7)} | {f"t{p % 11}"} for p in range(1, 120)}
    titles = {p: {f"t{p % 11}", min(words[p])} for p in words if p % 9}
    weights = {f"w{i}": 1 + i % 7 / 3 for i in range(20)}
    table = lambda d: spark.createDataFrame([(p, w) for p in d for w in d[p]], "page_id long, word string")
    games = spark.createDataFrame([(1000 + p, p) for p in words] + [(1, 3), (2, 999), (3, None)], "game_id long, page_id long")
    idf = spark.createDataFrame(list(weights.items()), "word string, idf double")
    got = {}
    for r in datasets.solve_closed_set(games, table(words), table(titles), idf, ["w1", "zz"], 9, ("w1", "v1", "v2")).collect():
        got.setdefault(r.game_id, []).append((r.turn, r.guess, r.candidates, r.solved))
    for game_id, page in [(1000 + p, p) for p in words] + [(1, 3), (2, 999), (3, None)]:
        assert sorted(got[game_id]) == _solved_alone(words, titles, weights, page, ["w1", "zz"], 9, ("w1", "v1", "v2")), game_id


def test_solver_query_plays_every_page(spark):
    from lexiloom.plans import registry

    sf = "/root/testdata/sf0.001"
    assert registry.queries()["closed_set_solver"](spark, sf).select("game_id").distinct().count() == spark.read.parquet(f"{sf}/part.parquet").count()


def test_oracles_and_curriculum(spark):
    tokens = game.page_tokens(pages(spark))
    idf = spark.createDataFrame([("capitale", 3.0)], "word string, idf double")
    none = spark.createDataFrame([], "game_id long, guess string")
    soft = {(r.game_id, r.word) for r in datasets.oracle_pool(tokens, idf, none, ["sport"], with_title=False).collect()}
    strong = {(r.game_id, r.word) for r in datasets.oracle_pool(tokens, idf, none, ["sport"], with_title=True).collect()}
    assert (1, "paris") not in soft and (1, "paris") in strong and (1, "capitale") in soft
    sim = spark.createDataFrame([], "l string, r string, sim double")
    best = {r.game_id: r.guess for r in datasets.best_rewarded(tokens, spark.createDataFrame(list(strong), "game_id long, word string"), idf, sim).collect()}
    assert best["1"] == "paris"
    said = oracles.oracle_rounds(tokens, idf, sim, ["histoire"], 4, True).collect()
    assert "paris" in {r.guess for r in said if r.game_id == 1}


def test_gumbel_choice(spark):
    rows = spark.createDataFrame([(1, w, float(i)) for i, w in enumerate("abcdef")], "g int, w string, r double")
    assert policy.gumbel_choice(rows, ["g"], "r", "w", 4, 0.0, 1).first().w == "f"
    picked = {policy.gumbel_choice(rows, ["g"], "r", "w", 4, 1.0, seed).first().w for seed in range(12)}
    assert len(picked) >= 2 and picked <= set("cdef")


def test_policy_rounds(spark):
    q = spark.createDataFrame([("s", "a", 0.0), ("t", "b", 2.0)], "state string, action string, value double")
    seen = spark.createDataFrame([("s", "a", 1.0, "t"), ("s", "c", -1.0, "u")], "state string, action string, reward double, next_state string")
    got = {(r.state, r.action): round(r.value, 6) for r in policy.q_update(q, seen).collect()}
    assert got == {("s", "a"): 0.28, ("s", "c"): -0.1, ("t", "b"): 2.0}
    logits = spark.createDataFrame([("s", "a", 7.99)], "state string, action string, logit double")
    rolls = spark.createDataFrame([("g", "s", "a", 3.0), ("g", "s", "b", 1.0)], "group string, state string, action string, reward double")
    got = {r.action: r.logit for r in policy.policy_update(logits, rolls, rate=1.0).collect()}
    assert got["a"] == 8.0 and got["b"] < 0


def test_quantiles_and_sampling(spark):
    df = spark.range(0, 101).withColumn("page_id", F.col("id"))
    got = {r.pct: r.value for r in corpus.nearest_rank_quantiles(df, "id").collect()}
    assert got[0] == 0 and got[50] == 50 and got[99] == 99
    p = df.select("page_id", F.lit("t").alias("title"), F.lit("a b").alias("intro"))
    assert corpus.sample_pages(p, 10, 1).count() == 10
    near, other = df.limit(6).select("id"), df.select("id")
    assert corpus.mixed(near, other, 0.4).count() == 10


def test_vector_paths_agree(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [-1.0, 0.0])], "word string, vec array<float>")
    words = spark.createDataFrame([(1, "a"), (1, "zz")], "page_id long, word string")
    block = {(r.word, r.page_word): round(r.sim, 5) for r in vectors.nearest_of_page_words(v, words, 1000).collect()}
    pairs = spark.createDataFrame([("b", "a"), ("c", "a")], "l string, r string")
    native = {(r.l, r.r): round(r.sim, 5) for r in vectors.pair_similarity(pairs, v, clip=False).collect()}
    assert native[("b", "a")] == block[("b", "a")] == 0.6 and block[("c", "a")] == -1.0


def test_sources(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"title": "é", "intro": "x"}\n{"title": "b", "intro": "y", "url": "u"}\n', encoding="utf-8")
    rows = readers.read_pages(spark, str(tmp_path / "p.jsonl"))
    assert {tuple(r) for r in rows.collect()} == {("é", "x", ""), ("b", "y", "u")}
    readers.write_pages(rows, str(tmp_path / "out"))
    assert readers.read_pages(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"title": "b"}\n')
    with pytest.raises(Exception, match="page without"):
        readers.read_pages(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "t.jsonl").write_text('{"id": 4, "title": "a", "intro": "", "summary": "s"}\nnot json\n')
    assert [tuple(r)[:3] for r in readers.read_pages_tolerant(spark, str(tmp_path / "t.jsonl")).collect()] == [(4, "a", "s")]
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>Paris</title><ns>0</ns><revision><text>Paris est la capitale de la France et une ville.</text></revision></page><page><title>X</title><ns>0</ns><redirect title='Y'/><revision><text>z</text></revision></page></mediawiki>")
    assert [r.title for r in readers.read_dump(spark, str(tmp_path / "d.xml")).collect()] == ["Paris"]
    (tmp_path / "fr.dic").write_text("3\nétat/S\nParis\nx1\n", encoding="utf-8")
    assert {r.word for r in readers.read_dictionary(spark, str(tmp_path / "fr.dic")).collect()} == {"état", "etat", "paris"}
    (tmp_path / "v.txt").write_text("2 2\nville 3 4\nautre 1 0\n")
    vocab = spark.createDataFrame([("ville",)], "word string")
    got = readers.read_vectors(spark, str(tmp_path / "v.txt"), vocab, 2).collect()
    assert len(got) == 1 and [round(x, 3) for x in got[0].vec] == [0.6, 0.8]
    (tmp_path / "views").write_text("fr.wikipedia Paris 1 7 x\nfr.wikipedia A_b 2 no x\nen.wikipedia Z 1 9\n")
    assert [(r.title, r.n) for r in readers.read_pageviews(spark, str(tmp_path / "views"), "2024-01").collect()] == [("Paris", 7)]


def test_vector_queries_of_every_page_word(spark, tmp_path):
    from lexiloom.plans import registry

    n = 40
    m = np.random.default_rng(5).normal(size=(n, 6)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    spark.createDataFrame([(i, m[i].tolist(), i % 3) for i in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sims, mean = m.astype(float) @ m.astype(float).T, m.astype(float).mean(0)
    back = np.clip(m.astype(float) @ (mean / np.linalg.norm(mean)), 0, 1)
    best = {p: sims[:, [i for i in range(n) if i % 3 == p]].max(1) for p in range(3)}
    rows = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    got = {(r.page_id, r.word): r.contrast for r in rows("contrastive_similarity")}
    assert got == pytest.approx({(p, f"w{i}"): max(0.0, best[p][i] - back[i]) for p in best for i in range(n)}, abs=2e-6)
    ranks = {(r.page_id, r.word): r["rank"] for r in rows("page_rank_table")}
    assert ranks == {(p, w): k + 1 for p in best for k, w in enumerate(sorted((f"w{i}" for i in range(n)), key=lambda w: (-round(best[p][int(w[1:])], 9), w)))}
    top = {i: sorted(range(n), key=lambda j: (-round(sims[i, j], 9), f"w{j}")) for i in range(n)}
    index = {(r.page_word, r.word) for r in rows("similarity_inverted_index")}
    assert index == {(f"w{i}", f"w{j}") for i in range(n) for j in top[i][:20] if sims[i, j] >= 0.1}
    near = {(r.l, r.r, r["rank"]) for r in rows("nearest_vector_words")}
    assert near == {(f"w{i}", f"w{j}", k + 1) for i in range(n) for k, j in enumerate([j for j in top[i] if j != i and sims[i, j] >= 0.3][:5])}
    soft = {}
    for r in rows("soft_label_distribution"):
        soft[r.l] = soft.get(r.l, 0) + r.p
    assert set(soft) == {l for l, _, _ in near} and list(soft.values()) == pytest.approx([1.0] * len(soft), abs=1e-5)


def test_vocabulary_in_blocks_gives_the_same(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    v = spark.createDataFrame([(f"w{i}", rnd.normal(size=4).tolist()) for i in range(30)], "word string, vec array<double>")
    words = spark.createDataFrame([(i % 2, f"w{i}") for i in range(8)], "page_id int, word string")
    rows = lambda: (sorted(vectors.nearest_of_page_words(v, words, 5).collect()), sorted(vectors.best_of_pages(v, words).collect()))
    whole = rows()
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 4 * 8)
    for a, b in zip(whole, rows(), strict=True):
        assert [tuple(r)[:-1] for r in a] == [tuple(r)[:-1] for r in b] and [r.sim for r in a] == pytest.approx([r.sim for r in b])
