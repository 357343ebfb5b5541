import random
from collections import Counter

from pyspark.sql import functions as F

from lexiloom.operators import corpus, policy


def test_audit_is_one_scan_and_the_plain_counts(spark, tmp_path):
    rand = random.Random(3)
    rows = [(i, rand.choice(["Liste de x", "Paris", "paris  LYON z"]), " ".join(["mot"] * rand.choice([3, 50, 60, 90]))) for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, title string, intro string")
    got = {(r.section, r.key): r.value for r in corpus.audit(pages).collect()}
    issues = {r.page_id: r.issues for r in corpus.with_issues(pages).collect()}
    assert got["rows", ""] == 80 and got["rejected", ""] == sum(bool(i) for i in issues.values())
    assert {k: v for (s, k), v in got.items() if s == "issue"} == Counter(x for i in issues.values() for x in i)
    assert {k: v for (s, k), v in got.items() if s == "prefix"} == Counter(" ".join(t.lower().split()[:2]) for _, t, _ in rows)
    chars = sorted(len(t) for *_, t in rows)
    assert all(got["chars", str(p)] == chars[round(p / 100 * 79)] for p in corpus.PERCENTS)
    told = corpus.filtered_with_metrics(pages, str(tmp_path / "out"))
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert told["rows"] == 80 and told["kept"] == kept.count() == 80 - got["rejected", ""] and kept.columns == pages.columns
    assert {i: n for i, n in told.items() if n and i not in ("rows", "kept")} == Counter(x for i in issues.values() for x in i)
    empty = {(r.section, r.key): r.value for r in corpus.audit(pages.where("false")).collect()}
    assert empty == {}


def test_quantile_ranges(spark):
    rand = random.Random(5)
    values = [rand.randrange(-50, 500) for _ in range(700)]
    df = spark.createDataFrame([(v, v % 7) for v in values] + [(None, 1)], "a long, b long")
    got = {(r.measure, r.pct): r.value for r in corpus.histogram_quantiles(corpus.value_histograms(df, ["a", "b"])).collect()}
    a, b = sorted(values), sorted([*(v % 7 if v >= 0 else -((-v) % 7) for v in values), 1])
    assert all(got["a", p] == a[round(p / 100 * (len(a) - 1))] for p in corpus.PERCENTS)
    b = sorted(r.b for r in df.collect())
    assert all(got["b", p] == b[round(p / 100 * (len(b) - 1))] for p in corpus.PERCENTS)


def collected(days, limit):
    """As the collector does it, row by row."""
    found = {}
    for day in sorted({d for d, *_ in days}):
        for d, pos, title in sorted(days):
            if d != day:
                continue
            if title and ":" not in title and title not in ("Accueil", "Main_Page", "-"):
                found.setdefault(title.replace("_", " "), (d, pos))
            if len(found) >= limit:
                break
    return found


def test_popular_titles_stop_inside_a_day_only(spark):
    for seed in range(4):
        rand = random.Random(seed)
        days = [(f"2024-01-{d:02}", p, rand.choice(["A_b", "B", "C", "D:x", "E", f"T{rand.randrange(12)}"])) for d in range(1, 8) for p in range(6)]
        df = spark.createDataFrame(days, "day string, pos int, title string")
        for limit in (1, 5, 9, 100):
            got = {r.title: (r.day, r.pos) for r in corpus.popular_titles_until(df, limit).collect()}
            assert got == collected(days, limit), (seed, limit)


def test_weighted_draws(spark):
    items = [(k, w) for k, w in enumerate([5, 0, 1, 100, 3, -2, 40, None])] + [(None, 9)]
    df = spark.createDataFrame(items, "k long, w long")
    draws = spark.createDataFrame([(i, i / 149) for i in range(149)], "draw long, u double")
    got = {r.draw: r.k for r in policy.weighted_draws(df, draws, "k", "w", cells=16).collect()}
    line = [k for k, w in items if k is not None and w and w > 0 for _ in range(w)]
    assert got == {i: line[int(i / 149 * 149 + 1e-9)] for i in range(149)}
    seeded = policy.weighted_draws(df, policy.seeded_draws(spark, 20_000, 7), "k", "w").groupBy("k").count().collect()
    counts = {r.k: r["count"] for r in seeded}
    assert sum(counts.values()) == 20_000 and set(counts) == {0, 2, 3, 4, 6}
    for k, w in items:
        if k in counts:
            p = w / 149
            assert abs(counts[k] - 20_000 * p) < 5 * (20_000 * p * (1 - p)) ** 0.5 + 1
    assert policy.weighted_draws(df.where("w < 0"), draws, "k", "w").count() == 0


def test_draws_by_given_numbers(spark):
    rows = spark.createDataFrame([(1, w, float(i)) for i, w in enumerate("abcdef")], "g int, w string, r double")
    picks = [policy.gumbel_choice(rows, ["g"], "r", "w", 4, 0.5, 1, F.when(F.col("w") == w, 0.9999).otherwise(0.01)).first().w for w in "cdef"]
    assert picks == list("cdef")
