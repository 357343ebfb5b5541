"""Queries on masked-page games, guesses and solvers, with their SQL.

A document is a game (its first two words are the title). Its guesses are its
third word, a common word, its first word, a theme word, its first word again
and its second word.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import corpus as C
from lexiloom.operators import game as G
from lexiloom.operators import lexical as L
from lexiloom.operators.stage import staged
from lexiloom.plans import sql as S
from lexiloom.plans.texts import PAGES_SQL


def _pages(spark, sf):
    return C.pages_of_documents(spark.read.parquet(f"{sf}/documents.parquet"))


def _guesses(pages):
    pages = pages.select("page_id", T.first_words(F.col("intro"), 3).alias("w"))
    w = F.col("w")
    given = F.array(F.get(w, F.lit(2)), F.lit("that"), F.get(w, F.lit(0)), F.lit("Histoire"), F.get(w, F.lit(0)), F.get(w, F.lit(1)))
    rows = pages.select(F.col("page_id").alias("game_id"), F.posexplode(given).alias("i", "guess"))
    return rows.where("guess is not null").select("game_id", (F.col("i") + 1).alias("turn"), "guess")


def _idf(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    return staged(L.counted_vocabulary(docs.select("text")), "idf")


def _alike(idf):
    """A stand-in for a trained model: among the most frequent words, those that share three letters are alike."""
    l, r = idf.select(F.col("word").alias("l"), F.substring("word", 1, 3).alias("k")), idf.select(F.col("word").alias("r"), F.substring("word", 1, 3).alias("k"))
    return staged(l.join(r, "k").where("l <> r").select("l", "r", F.when(F.length("l") == F.length("r"), 0.6).otherwise(0.4).alias("sim")), "alike")


def _similarity(spark, sf):
    return _alike(_idf(spark, sf))


def game_reveals(spark, sf):
    pages = _pages(spark, sf)
    found = G.shown_places(G.shown_pages(pages, _guesses(pages)))
    return found.groupBy("game_id", "reveal_turn").agg(F.count("*").alias("n"), F.sum("idx").cast("long").alias("idx_sum"))


def game_reveals_by_form(spark, sf):
    pages = _pages(spark, sf)
    found = G.shown_places(G.shown_pages(pages, _guesses(pages), by_canon=False))
    return found.groupBy("game_id", "reveal_turn").agg(F.count("*").alias("n"), F.sum("idx").cast("long").alias("idx_sum"))


def game_solved(spark, sf):
    pages = _pages(spark, sf)
    return G.solved_at(G.revealed_pages(pages, _guesses(pages)))


def semantic_hits(spark, sf):
    pages = _pages(spark, sf)
    guesses = _guesses(pages)
    found = G.semantic_hits(pages, guesses, _similarity(spark, sf))
    return found.groupBy("game_id", "turn").agg(F.count("*").alias("n"), F.sum("percent").cast("long").alias("percents"), F.sum("idx").cast("long").alias("idx_sum"))


def display_score(spark, sf):
    pages = _pages(spark, sf)
    return G.display_score(pages, _guesses(pages), _similarity(spark, sf))


def guess_reward(spark, sf):
    pages, idf = _pages(spark, sf), _idf(spark, sf).select("word", "idf")
    return G.guess_rewards(pages, _guesses(pages), idf, _alike(idf))


def masked_text(spark, sf):
    pages = _pages(spark, sf)
    shown = G.masked_text(G.shown_pages(pages, _guesses(pages)))
    return shown.select("game_id", F.md5("text").alias("text_md5"))


def compact_text(spark, sf):
    pages = _pages(spark, sf)
    return G.compact_text(G.shown_pages(pages, _guesses(pages)))


def extract_guess(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>well"), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("Voici. MOT: "), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.extract_guess(said).alias("guess"))


def valid_guess(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null")
    words = c.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(T.NONBLANK), F.lit(0))).alias("w"))
    guess = T.normalize_word(F.col("w"))
    return words.groupBy("conv_id", "turn").agg(F.sum(T.is_valid_guess(guess).cast("long")).alias("n_valid"), F.count("*").alias("n"))


def real_word_filter(spark, sf):
    """Words of conversations that the documents' 5000 most frequent words know."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    real = L.vocabulary(L.page_words(docs, "doc_id", "text"))
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null")
    said = c.select(F.explode(T.content_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return said.join(F.broadcast(real.select("word")), "word", "left_semi")  # of the bounded vocabulary


def _parts(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("title"), F.col("p_name").alias("intro"))
    body = p.select("page_id", F.explode(T.word_set(F.concat_ws(" ", "intro", "title"))).alias("word"))
    title = p.select("page_id", F.explode(T.word_set(F.col("title"))).alias("word"))
    return p, body, title


def _part_words(spark, sf):
    """The two most frequent words and the fifth: stated guesses of the solver."""
    _, body, _ = _parts(spark, sf)
    top = [r["word"] for r in body.groupBy("word").count().orderBy(F.desc("count"), "word").limit(5).collect()]
    return top[:1], top[4:5]


def candidate_filter(spark, sf):
    present, absent = _part_words(spark, sf)
    return G.candidates(_parts(spark, sf)[1], present, absent)


def candidate_rank(spark, sf):
    p, body, title = _parts(spark, sf)
    present, _ = _part_words(spark, sf)
    idf = L.smoothed_idf(L.document_frequency(body), p.count())
    return G.candidate_ranking(p, body, title, idf, present).select("page_id", F.round("score", 6).alias("score"))


def information_words(spark, sf):
    p, body, title = _parts(spark, sf)
    idf = L.smoothed_idf(L.document_frequency(body), p.count())
    return G.information_words(body, title, idf, 30)


QUERIES = {
    f.__name__: f
    for f in (
        game_reveals, game_reveals_by_form, game_solved, semantic_hits, display_score, guess_reward, masked_text, compact_text, extract_guess, valid_guess, real_word_filter,
        candidate_filter, candidate_rank, information_words,
    )
}

_TOK = rf"'[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+|\s+'"
_GAME = rf"""{PAGES_SQL},
t1 AS (SELECT page_id AS game_id, len(regexp_extract_all(title, {_TOK})) AS nt, list_concat(list_concat(regexp_extract_all(title, {_TOK}), [chr(10) || chr(10)]), regexp_extract_all(intro, {_TOK})) AS p FROM pages_),
t2 AS (SELECT game_id, nt, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS idx FROM t1),
t3 AS (SELECT *, {S.norm("text")} AS nf FROM t2),
t4 AS (SELECT game_id, idx, text, regexp_matches(nf, '[\p{{L}}\p{{N}}]') AS is_word, CASE WHEN regexp_matches(nf, '[\p{{L}}\p{{N}}]') THEN nf ELSE '' END AS norm, idx < nt AS in_title FROM t3),
tk AS (SELECT *, {S.canon("norm")} AS canon FROM t4),
g0 AS (SELECT page_id AS game_id, regexp_extract_all(intro, '[^\s]+') AS w FROM pages_),
g1 AS (SELECT game_id, unnest([w[3], 'that', w[1], 'Histoire', w[1], w[2]]) AS guess, unnest([1, 2, 3, 4, 5, 6]) AS turn FROM g0),
g2 AS (SELECT game_id, turn, {S.norm("guess")} AS ng FROM g1 WHERE guess IS NOT NULL),
gu AS (SELECT *, {S.canon("ng")} AS cg FROM g2),
rv AS (SELECT tk.*, r.t AS reveal_turn FROM tk LEFT JOIN (SELECT tk.game_id, idx, min(turn) AS t FROM tk JOIN gu ON tk.game_id = gu.game_id AND (tk.canon = cg OR tk.norm = cg) WHERE is_word GROUP BY ALL) r ON tk.game_id = r.game_id AND tk.idx = r.idx)
"""
_MODEL = f"""{S.TOKENS},
vc AS (SELECT word, ln((1.0 + (SELECT count(*) FROM documents WHERE text IS NOT NULL)) / (1.0 + count(*))) + 1 AS idf, count(*) AS df FROM content GROUP BY word ORDER BY df DESC, word LIMIT 5000),
sm AS (SELECT a.word AS l, b.word AS r, CASE WHEN length(a.word) = length(b.word) THEN 0.6 ELSE 0.4 END::DOUBLE AS sim FROM vc a JOIN vc b ON left(a.word, 3) = left(b.word, 3) AND a.word <> b.word)"""
_AGAIN = S.canon("norm2")
_REWARD = rf"""WITH {_GAME}, {_MODEL},
gv AS (SELECT game_id, turn, ng AS guess, cg, row_number() OVER (PARTITION BY game_id, ng ORDER BY turn) > 1 AS repeated, length(ng) >= 2 AND regexp_matches(ng, '\p{{L}}') AND NOT regexp_matches(ng, '\p{{N}}') AND ng NOT IN ({S.NEVER}) AS valid FROM gu),
lv AS (SELECT * FROM gv WHERE valid AND NOT repeated),
ca AS (SELECT DISTINCT canon, {S.norm("canon")} AS norm2 FROM tk WHERE is_word),
cb AS (SELECT canon, {_AGAIN} AS again FROM ca),
inf AS (SELECT canon, CASE WHEN again IN ({S.STOP}) OR length(again) < 3 THEN 0.0::DOUBLE ELSE greatest(0, least(8, coalesce(idf, 1.0))) END AS info FROM cb LEFT JOIN vc ON vc.word = cb.again),
fi AS (SELECT game_id, ng, min(turn) AS turn FROM gu WHERE ng <> '' GROUP BY ALL),
sh AS (SELECT tk.game_id, idx, tk.canon, in_title, info, fi.turn AS t FROM tk JOIN inf ON tk.canon = inf.canon LEFT JOIN fi ON fi.game_id = tk.game_id AND fi.ng = tk.norm WHERE is_word),
hi AS (SELECT game_id, t AS turn, count(*) AS exact, sum(info) AS ei, sum(CASE WHEN in_title THEN info ELSE 0 END) AS ti, sum(in_title::INT)::BIGINT AS title FROM sh WHERE t IS NOT NULL GROUP BY ALL),
cl AS (SELECT game_id, turn, canon, max(c) AS c FROM (SELECT game_id, turn, r AS canon, sim AS c FROM lv JOIN sm ON l = cg UNION ALL SELECT game_id, turn, cg, 1.0 FROM lv) GROUP BY ALL),
so AS (SELECT cl.game_id, cl.turn, sum(CASE WHEN in_title THEN info * c ELSE 0 END) AS ts, sum(CASE WHEN NOT in_title AND c >= 0.34 THEN info * c ELSE 0 END) AS sem, sum((NOT in_title AND c >= 0.34)::INT)::BIGINT AS semantic, max(CASE WHEN in_title THEN c END) AS nearest FROM cl JOIN sh ON cl.game_id = sh.game_id AND cl.canon = sh.canon WHERE t IS NULL OR t > cl.turn GROUP BY ALL),
ht AS (SELECT game_id, count(*) AS nt, count(t) AS kt, max(t) AS lt FROM sh WHERE in_title GROUP BY game_id),
al AS (SELECT gv.game_id, gv.turn, guess, valid, repeated, coalesce(exact, 0) AS exact, coalesce(ei, 0) AS ei, coalesce(ti, 0) AS ti, coalesce(title, 0) AS title, coalesce(ts, 0) AS ts, coalesce(sem, 0) AS sem, coalesce(semantic, 0) AS semantic, coalesce(nearest, 0) AS nearest, coalesce(nt > 0 AND nt = kt AND gv.turn = lt, false) AS solved, valid AND NOT repeated AS ok FROM gv LEFT JOIN hi ON hi.game_id = gv.game_id AND hi.turn = gv.turn LEFT JOIN so ON so.game_id = gv.game_id AND so.turn = gv.turn LEFT JOIN ht ON ht.game_id = gv.game_id)
SELECT game_id, turn, guess, CASE WHEN NOT valid OR repeated THEN -100.0::DOUBLE ELSE round((-10 + 0.8 * least(40, ei) + 0.5 * least(80, sem) + 3 * least(7, ts) + 25 * least(30, ti) + 200 * least(4, title) + CASE WHEN sem >= 8 AND semantic >= 4 THEN least(4, 0.5 * sem) ELSE 0 END + CASE WHEN solved THEN 1000 - 2 * (turn - 1) ELSE 0 END + 30 * nearest + CASE WHEN ei = 0 AND sem = 0 AND ts = 0 AND title = 0 THEN -30 WHEN exact = 0 AND title = 0 THEN -4 ELSE 0 END)::DOUBLE, 4) END AS reward,
CASE WHEN ok THEN exact ELSE 0 END AS exact, CASE WHEN ok THEN semantic ELSE 0 END AS semantic, CASE WHEN ok THEN title ELSE 0 END AS title, solved AND ok AS solved, NOT ok AS invalid FROM al"""
_PART = rf"""
pt AS (SELECT p_partkey AS page_id, p_brand AS title, p_name || ' ' || p_brand AS body FROM part),
b1 AS (SELECT page_id, {S.norm("x")} AS norm FROM (SELECT page_id, unnest(regexp_extract_all(body, {_TOK})) AS x FROM pt)),
body AS (SELECT DISTINCT page_id, {S.canon("norm")} AS word FROM b1 WHERE regexp_matches(norm, '[\p{{L}}\p{{N}}]')),
h1 AS (SELECT page_id, {S.norm("x")} AS norm FROM (SELECT page_id, unnest(regexp_extract_all(title, {_TOK})) AS x FROM pt)),
head AS (SELECT DISTINCT page_id, {S.canon("norm")} AS word FROM h1 WHERE regexp_matches(norm, '[\p{{L}}\p{{N}}]')),
dfs AS (SELECT word, count(*) AS df, row_number() OVER (ORDER BY count(*) DESC, word) AS k FROM body GROUP BY word),
idf AS (SELECT word, df, k, ln((1.0 + (SELECT count(*) FROM part)) / (1.0 + df)) + 1 AS idf FROM dfs)
"""

ORACLES = {
    "game_reveals": f"WITH {_GAME} SELECT game_id, reveal_turn, count(*) AS n, sum(idx)::BIGINT AS idx_sum FROM rv WHERE reveal_turn IS NOT NULL GROUP BY ALL",
    "game_reveals_by_form": f"WITH {_GAME}, r AS (SELECT tk.game_id, idx, min(turn) AS reveal_turn FROM tk JOIN gu ON tk.game_id = gu.game_id AND tk.norm = ng WHERE is_word GROUP BY ALL) SELECT game_id, reveal_turn, count(*) AS n, sum(idx)::BIGINT AS idx_sum FROM r GROUP BY ALL",
    "game_solved": f"WITH {_GAME} SELECT game_id, CASE WHEN count(*) FILTER (in_title AND is_word) > 0 AND count(*) FILTER (in_title AND is_word) = count(reveal_turn) FILTER (in_title AND is_word) THEN max(reveal_turn) FILTER (in_title AND is_word) END AS solved_turn FROM rv GROUP BY game_id",
    "semantic_hits": f"WITH {_GAME}, {_MODEL} SELECT gu.game_id, gu.turn, count(*) AS n, sum(round_even(sim * 100, 0))::BIGINT AS percents, sum(idx)::BIGINT AS idx_sum FROM gu JOIN sm ON l = cg JOIN rv ON rv.game_id = gu.game_id AND rv.canon = r WHERE sim >= 0.34 AND is_word AND NOT in_title AND (reveal_turn IS NULL OR reveal_turn > gu.turn) GROUP BY ALL",
    "display_score": f"WITH {_GAME}, {_MODEL}, cs AS (SELECT DISTINCT game_id, canon FROM tk WHERE is_word), b AS (SELECT gu.game_id, turn, 1.0 AS sim FROM gu JOIN cs ON cs.game_id = gu.game_id AND canon = cg UNION ALL SELECT gu.game_id, turn, sim FROM gu JOIN sm ON l = cg JOIN cs ON cs.game_id = gu.game_id AND canon = r), m AS (SELECT game_id, turn, max(sim) AS s FROM b GROUP BY ALL) SELECT gu.game_id, gu.turn, coalesce(round_even(s * 100, 0), 0)::INT AS score FROM gu LEFT JOIN m ON m.game_id = gu.game_id AND m.turn = gu.turn",
    "guess_reward": _REWARD,
    "masked_text": f"WITH {_GAME} SELECT game_id, md5(string_agg(CASE WHEN NOT is_word OR reveal_turn IS NOT NULL THEN text ELSE repeat('█', greatest(1, length(text))) END, '' ORDER BY idx)) AS text_md5 FROM rv GROUP BY game_id",
    "valid_guess": rf"WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^\s]+')) AS w FROM conversations), n AS (SELECT conv_id, turn, {S.norm('w')} AS g FROM w) SELECT conv_id, turn, sum((length(g) >= 2 AND regexp_matches(g, '\p{{L}}') AND NOT regexp_matches(g, '\p{{N}}') AND g NOT IN ({S.NEVER}))::INT)::BIGINT AS n_valid, count(*) AS n FROM n GROUP BY ALL",
    "real_word_filter": rf"WITH {S.TOKENS}, v AS (SELECT word, count(*) AS df FROM content GROUP BY word ORDER BY df DESC, word LIMIT 5000), c1 AS (SELECT conv_id, turn, {S.norm('x')} AS norm FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, {_TOK})) AS x FROM conversations)), c2 AS (SELECT DISTINCT conv_id, turn, {S.canon('norm')} AS word FROM c1 WHERE regexp_matches(norm, '[\p{{L}}\p{{N}}]')) SELECT word, count(*) AS n FROM c2 SEMI JOIN v USING (word) WHERE length(word) >= 3 GROUP BY word",
    "candidate_filter": f"WITH {_PART}, f AS (SELECT page_id FROM body JOIN dfs USING (word) WHERE k = 1 EXCEPT SELECT page_id FROM body JOIN dfs USING (word) WHERE k = 5) SELECT page_id FROM f UNION ALL SELECT DISTINCT page_id FROM body WHERE (SELECT count(*) FROM f) = 0",
    "candidate_rank": f"WITH {_PART}, b AS (SELECT page_id, sum(CASE WHEN k = 1 THEN idf ELSE 0 END) AS b, count(*) AS n FROM body JOIN idf USING (word) GROUP BY page_id), h AS (SELECT page_id, sum(idf) AS h FROM head JOIN idf USING (word) WHERE k = 1 GROUP BY page_id) SELECT page_id, round(b + 2.5 * coalesce(h, 0) - 0.01 * n, 6) AS score FROM b LEFT JOIN h USING (page_id)",
    "information_words": rf"WITH {_PART}, n AS (SELECT count(DISTINCT page_id) AS n FROM body), t AS (SELECT word, count(*) AS t FROM head GROUP BY word) SELECT word, round((df / n) * (1 - df / n) + 0.18 * (df / n) * idf + 0.8 * coalesce(t, 0) / n, 6) AS score FROM idf LEFT JOIN t USING (word), n WHERE length(word) >= 3 AND NOT regexp_matches(word, '^\p{{Nd}}+$') ORDER BY score DESC, word LIMIT 30",
    "extract_guess": rf"WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<think>well' || text WHEN turn % 3 = 1 THEN 'Voici. MOT: ' || text ELSE text END AS c FROM conversations WHERE text IS NOT NULL), p AS (SELECT *, regexp_replace(regexp_replace(c, '(?is)<think>.*?</think>', ' ', 'g'), '(?i)</?think>', ' ', 'g') AS x FROM s), m AS (SELECT *, regexp_extract(x, '(?i)(?:^|\b)(?:MOT|WORD)\s*:\s*([\p{{L}}](?:[\p{{L}}]|[''’-])*)', 1) AS a, regexp_extract(x, '([\p{{L}}](?:[\p{{L}}]|[''’-])*)', 1) AS b FROM p), r AS (SELECT conv_id, turn, CASE WHEN regexp_matches(c, '(?i)<think>') AND NOT regexp_matches(c, '(?i)</think>') THEN '' WHEN a <> '' THEN a ELSE b END AS g FROM m) SELECT conv_id, turn, {S.norm('g')} AS guess FROM r",
}
ORACLES = {name: S.spelt(q) for name, q in ORACLES.items()}
