"""The closed set's pages are played by kinds: tables of a turn don't grow with copies, and the pool is still of pages."""

from lexiloom.operators import datasets
from test_operators import _solved_alone


def test_copies_of_pages_are_played_once(spark, monkeypatch):
    kind = {p: p * p % 31 if p % 3 else p % 17 for p in range(600)}
    words = {p: {f"w{k % 5:02}x", f"v{k % 7:02}x", f"u{k // 4:02}x"} | ({"odd"} if k % 2 else {"even"}) for p, k in kind.items()}
    titles = {p: {f"u{k // 4:02}x"} | ({"nowhere"} if k == 3 else set()) for p, k in kind.items() if k % 6}
    weights = {f"v{i:02}x": 1 + i % 4 / 3 for i in range(5)}
    table = lambda d: spark.createDataFrame([(p, w) for p in d for w in d[p]], "page_id long, word string")
    games = [(1000 + p, p) for p in (0, 1, 2, 7, 33, 250, 598)] + [(1, 7), (2, 999)]
    sizes, staged = {}, datasets.staged

    def counted(df, name):
        found = staged(df, name)
        sizes.setdefault(name, []).append(found.count())
        return found

    monkeypatch.setattr(datasets, "staged", counted)
    idf = spark.createDataFrame(list(weights.items()), "word string, idf double")
    found = datasets.solve_closed_set(spark.createDataFrame(games, "game_id long, page_id long"), table(words), table(titles), idf, ["odd"], 5).collect()
    kinds = len({(frozenset(words[p]), frozenset(titles.get(p, ()))) for p in words})
    of_a_turn = {name: max(n[1:]) for name, n in sizes.items() if len(n) > 1}  # what is written more than once
    assert of_a_turn and max(of_a_turn.values()) <= 2 * kinds < len(words) / 5, (of_a_turn, kinds)
    for game_id, page in games:
        got = sorted((r.turn, r.guess, r.candidates, r.solved) for r in found if r.game_id == game_id)
        assert got == _solved_alone(words, titles, weights, page, ["odd"], 5, ()), game_id
