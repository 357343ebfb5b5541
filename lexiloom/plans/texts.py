"""Queries on tokens, words, quality and popularity, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import corpus as C
from lexiloom.operators import lexical as L
from lexiloom.operators.stage import spread
from lexiloom.plans import sql as S


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return C.pages_of_documents(_t(spark, sf, "documents"))


PAGES_SQL = r"pages_ AS (SELECT doc_id AS page_id, array_to_string(list_slice(regexp_extract_all(text, '[^\s]+'), 1, 2), ' ') AS title, text AS intro, source AS url FROM documents WHERE text IS NOT NULL)"


def idf_top_terms(spark, sf):
    docs = _t(spark, sf, "documents").where("text is not null")
    words = L.page_words(docs, "doc_id", "text")
    top = L.smoothed_idf(L.document_frequency(words).orderBy(F.desc("df"), "word").limit(20), docs.count())
    return top.select("word", "df", F.round("idf", 6).alias("idf"))


def token_table_stats(spark, sf):
    docs = _t(spark, sf, "documents").where("text is not null")
    parts = docs.select("doc_id", F.explode(T.token_texts(F.col("text"))).alias("part"))
    norm = T.normalize_word(F.col("part"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(T.is_word(norm).cast("long")).alias("n_words"), F.sum(F.length("part")).alias("n_chars"))


def content_words_per_doc(spark, sf):
    docs = _t(spark, sf, "documents").where("text is not null")
    words = T.content_words(F.col("text"))
    return docs.select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("words_md5"))


def word_sets(spark, sf):
    docs = _t(spark, sf, "documents").where("text is not null")
    words = F.array_sort(T.word_set(F.col("text")))
    return docs.select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("words_md5"))


def canonical_form_counts(spark, sf):
    docs = _t(spark, sf, "documents").where("text is not null")
    return L.canonical_counts(spread(docs.select("text")).select(F.explode(T.token_texts(F.col("text"))).alias("part")))


def web_norm_words(spark, sf):
    docs = _t(spark, sf, "documents").where("text is not null")
    words = T.page_word_set(F.col("text"))
    return docs.select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("words_md5"))


def article_words(spark, sf):
    docs = _t(spark, sf, "documents").where("text is not null")
    words = T.article_words(F.col("text"))
    return docs.select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("words_md5"))


def page_quality_issues(spark, sf):
    return C.with_issues(_pages(spark, sf)).select("page_id", F.array_join("issues", ",").alias("issues"))


def quality_issue_histogram(spark, sf):
    return C.issue_histogram(_pages(spark, sf))


def filtered_corpus(spark, sf):
    return C.useful_pages(_pages(spark, sf)).select("page_id", "title", F.length("intro").alias("chars"))


def corpus_quantiles(spark, sf):
    pages = _pages(spark, sf).select(F.length("intro").alias("chars"), T.words_by_blanks(F.col("intro")).alias("words"))
    return C.histogram_quantiles(C.value_histograms(pages, ["chars", "words"]))


def corpus_audit(spark, sf):
    return C.audit(_pages(spark, sf))


def title_prefix_top30(spark, sf):
    return C.title_prefixes(_pages(spark, sf))


def shortest_docs(spark, sf):
    return C.shortest_pages(_pages(spark, sf))


def incremental_dedupe(spark, sf):
    pages = _pages(spark, sf)
    return C.new_pages(pages.where("page_id % 2 = 1"), pages.where("page_id % 2 = 0")).select("page_id", "title")


def intro_patch(spark, sf):
    pages = _pages(spark, sf)
    fetched = pages.where("page_id % 3 = 0").select("page_id", F.concat(F.lit("[12]"), F.substring("intro", 1, 300), F.lit("\n\n\n\nEnd.")).alias("intro"))
    return C.patched(pages, fetched).select("page_id", "n_chars", "n_words")


def _views(spark, sf):
    e = _t(spark, sf, "events")
    return e.where("value is not null").select(F.concat("event_type", F.lit(" "), F.col("user_id") % 97).alias("title"), F.date_format("ts", "yyyy-MM").alias("month"), F.col("value").cast("long").alias("n"))


def pageview_rollup_rank(spark, sf):
    return C.pageview_ranking(_views(spark, sf)).select("rank", "title", "views")


def _doc_ranking(spark, sf):
    docs = _t(spark, sf, "documents").where("text is not null")
    pages = C.pages_of_documents(docs)
    return C.global_rank(pages.groupBy("title").agg(F.sum(F.length("intro")).alias("views")).where("views % 5 <> 0"), [F.desc("views"), F.asc("title")], "rank")


def popularity_filter_reasons(spark, sf):
    found = C.popularity_reasons(_pages(spark, sf), _doc_ranking(spark, sf), rank_max=600)
    return found.groupBy("reason").agg(F.count("*").alias("n"))


def qid_join(spark, sf):
    ranks = _t(spark, sf, "orders").select(F.concat(F.lit("Q"), "o_orderkey").alias("qid"), F.col("o_custkey").alias("rank"))
    links = _t(spark, sf, "orders").select(F.concat(F.lit("Q"), "o_orderkey").alias("qid"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("title"))
    pages = _t(spark, sf, "customer").select(F.col("c_name").alias("title"), "c_mktsegment")
    return C.ranked_by_qid(pages, links, ranks, 500).select("rank", "title", "qid", "c_mktsegment")


def popular_titles(spark, sf):
    e = _t(spark, sf, "events")
    days = e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("pos"), F.concat("event_type", F.lit("_"), F.col("user_id") % 50).alias("title"))
    return C.popular_titles(days, 100)


def popular_titles_until(spark, sf):
    e = _t(spark, sf, "events")
    days = e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("pos"), F.concat("event_type", F.lit("_"), F.col("event_id") % 5000).alias("title"))
    return C.popular_titles_until(days, 100)


def easy_pages(spark, sf):
    return C.easy_pages(_pages(spark, sf)).select("page_id", "title")


def cooccurrence_pairs(spark, sf):
    words = L.page_words(_t(spark, sf, "part"), "p_partkey", "p_name")
    return L.pair_counts(words, L.vocabulary(words))


def _model(spark, sf):
    part = _t(spark, sf, "part")
    words = L.page_words(part, "p_partkey", "p_name")
    vocab = L.smoothed_idf(L.vocabulary(words), part.count())
    return vocab, L.neighbours(L.pair_counts(words, vocab), vocab)


def neighbors_top25(spark, sf):
    return _model(spark, sf)[1]


def local_similarity_lookup(spark, sf):
    vocab, model = _model(spark, sf)
    words = vocab.select("word").where("df > 0")
    pairs = words.select(F.col("word").alias("l")).join(words.select(F.col("word").alias("r")), F.length("l") == F.length("r"))
    return L.local_similarity(pairs, model)


def starter_words(spark, sf):
    docs = _t(spark, sf, "documents").where("text is not null")
    return L.starter_words(L.vocabulary(L.page_words(docs, "doc_id", "text"))).select("word", "df")


def action_space_priors(spark, sf):
    return L.action_priors(_pages(spark, sf)).select("word", F.round("prior", 6).alias("prior"))


def action_vocab(spark, sf):
    return L.action_vocabulary(_pages(spark, sf), 300).select("pos", "word")


def title_gates(spark, sf):
    pages = _pages(spark, sf)
    t = F.col("title")
    return pages.select("page_id", T.is_bad_title(t).alias("bad"), T.is_article_title(t).alias("article"), T.is_excluded_page(t, F.col("intro")).alias("excluded"))


def html_markup_clean(spark, sf):
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    return _t(spark, sf, "pages").where("html is not null").select("page_id", F.md5(T.clean_markup(plain)).alias("clean_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        idf_top_terms, token_table_stats, content_words_per_doc, word_sets, canonical_form_counts, web_norm_words, article_words, page_quality_issues, quality_issue_histogram,
        filtered_corpus, corpus_quantiles, corpus_audit, title_prefix_top30, shortest_docs, incremental_dedupe, intro_patch, pageview_rollup_rank, popularity_filter_reasons, qid_join, popular_titles, popular_titles_until,
        easy_pages, cooccurrence_pairs, neighbors_top25, local_similarity_lookup, starter_words, action_space_priors, action_vocab, title_gates, html_markup_clean,
    )
}

_ISSUES = r"""
issues_ AS (SELECT page_id, list_filter([
  CASE WHEN length(i) < 220 THEN 'too_short_chars' END,
  CASE WHEN len(regexp_extract_all(i, '[^\s]+')) < 40 THEN 'too_short_words' END,
  CASE WHEN regexp_matches(lower(t), '^(liste|listes|chronologie|glossaire)\s+(de|des|du|d''|d’|historique)\b') THEN 'list_or_glossary_title' END,
  CASE WHEN starts_with(i, '*') OR contains(left(i, 500), chr(10) || '*') OR contains(left(i, 500), ': *') OR contains(left(i, 500), ' ; *') THEN 'bullet_disambiguation' END,
  CASE WHEN regexp_matches(i, '(?i)\best un sigle\b|\best un acronyme\b|\best une abréviation\b|\best une abreviation\b') THEN 'sigle_like' END,
  CASE WHEN regexp_matches(t || chr(10) || i, '(?i)homonymie|peut faire référence|peut faire reference|peut désigner|peut designer|peuvent désigner|peuvent designer|désigne plusieurs|designe plusieurs|catégorie:homonymie|categorie:homonymie') THEN 'homonymy_like' END,
  CASE WHEN regexp_matches(i, '(?i)\[\[|\]\]|\{\{|\}\}|<ref\b|thumb\||vignette\||fichier:|file:|image:') THEN 'markup_residue' END,
  CASE WHEN regexp_matches(i, '(?i)\b(cette page|cet article)\s+(présente|presente)\s+(une liste|un glossaire)') THEN 'list_intro' END,
  CASE WHEN contains(lower(i), 'catégorie:') OR contains(lower(i), 'categorie:') THEN 'category_residue' END
], lambda x: x IS NOT NULL) AS issues, title, intro FROM (SELECT *, trim(title, 'BLANKS') AS t, trim(intro, 'BLANKS') AS i FROM pages_))
"""
_ISSUES = _ISSUES.replace("BLANKS", "".join(chr(i) for i in range(0x3001) if chr(i).isspace()))
_PAIRS = rf"""
names AS (SELECT p_partkey AS doc_id, p_name AS text FROM part),
tokens_ AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+|\s+')) AS part FROM names),
normed AS (SELECT doc_id, {S.norm("part")} AS norm FROM tokens_),
words AS (SELECT DISTINCT doc_id, {S.canon("norm")} AS word FROM normed WHERE regexp_matches(norm, '[\p{{L}}\p{{N}}]')),
good AS (SELECT * FROM words WHERE length(word) >= 3),
vocab AS (SELECT word, count(*) AS df, ln((1.0 + greatest(1, (SELECT count(*) FROM part))) / (1.0 + count(*))) + 1 AS idf FROM good GROUP BY word ORDER BY df DESC, word LIMIT 5000),
ranked AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY word) AS r FROM good SEMI JOIN vocab USING (word)),
few AS (SELECT doc_id, word FROM ranked WHERE r <= 250),
pairs AS (SELECT a.word AS l, b.word AS r, count(*) AS n FROM few a JOIN few b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY ALL)
"""
_NEIGHBOURS = _PAIRS + """,
weights AS (SELECT l, r, n * a.idf * b.idf AS w FROM pairs JOIN vocab a ON l = a.word JOIN vocab b ON r = b.word),
both_ AS (SELECT l AS word, r AS other, w FROM weights UNION ALL SELECT r, l, w FROM weights),
model AS (SELECT word, other, row_number() OVER (PARTITION BY word ORDER BY round(w, 9) DESC, other) AS rank, w / max(w) OVER (PARTITION BY word) AS q FROM both_),
top AS (SELECT word, other, rank::INT AS rank, round(q, 4) AS score FROM model WHERE rank <= 25)
"""
_PRIORS = rf"""
{PAGES_SQL},
texts AS (SELECT page_id AS doc_id, title || chr(10) || chr(10) || intro AS text, title FROM pages_),
p1 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+|\s+')) AS part FROM texts),
n1 AS (SELECT doc_id, {S.norm("part")} AS norm FROM p1),
w1 AS (SELECT DISTINCT doc_id, {S.canon("norm")} AS word FROM n1 WHERE regexp_matches(norm, '[\p{{L}}\p{{N}}]')),
p2 AS (SELECT doc_id, unnest(regexp_extract_all(title, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+|\s+')) AS part FROM texts),
n2 AS (SELECT doc_id, {S.norm("part")} AS norm FROM p2),
w2 AS (SELECT DISTINCT doc_id, {S.canon("norm")} AS word FROM n2 WHERE regexp_matches(norm, '[\p{{L}}\p{{N}}]')),
titles AS (SELECT word, count(*) AS tf FROM w2 WHERE word <> '' GROUP BY word),
np AS (SELECT greatest(count(*), 1) AS n FROM pages_),
dfs AS (SELECT word, count(*) AS df FROM w1 WHERE length(word) >= 3 AND NOT regexp_matches(word, '^\p{{Nd}}+$') AND word NOT IN ({S.STOP}) GROUP BY word),
pri AS (SELECT word, 4 * (df / n) * (1 - df / n) + 1.2 * coalesce(tf, 0) / n + (word IN ({S.SEEDS}))::INT AS prior FROM dfs LEFT JOIN titles USING (word), np),
seeds AS (SELECT unnest([{S.SEEDS}]) AS word, generate_subscripts([{S.SEEDS}], 1) - 1 AS pl),
priors AS (SELECT word, prior::DOUBLE AS prior FROM pri UNION ALL SELECT word, 0.5 FROM seeds ANTI JOIN pri USING (word))
"""

ORACLES = {
    "idf_top_terms": f"WITH {S.TOKENS} SELECT word, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM documents WHERE text IS NOT NULL)) / (1.0 + count(*))) + 1, 6) AS idf FROM content GROUP BY word ORDER BY df DESC, word LIMIT 20",
    "token_table_stats": f"WITH {S.TOKENS} SELECT doc_id, count(*) AS n_tokens, sum(is_word::INT)::BIGINT AS n_words, sum(length(part))::BIGINT AS n_chars FROM tok GROUP BY doc_id",
    "content_words_per_doc": f"WITH {S.TOKENS} SELECT d.doc_id, count(word)::INT AS n, md5(coalesce(string_agg(word, ' ' ORDER BY pos), '')) AS words_md5 FROM documents d LEFT JOIN content USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id",
    "word_sets": f"WITH {S.TOKENS}, u AS (SELECT DISTINCT doc_id, canon FROM tok WHERE is_word AND canon <> '') SELECT d.doc_id, count(canon)::INT AS n, md5(coalesce(string_agg(canon, ' ' ORDER BY canon), '')) AS words_md5 FROM documents d LEFT JOIN u USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id",
    "canonical_form_counts": f"WITH {S.TOKENS} SELECT canon, count(*) AS n FROM tok WHERE is_word AND canon <> '' GROUP BY canon",
    "web_norm_words": rf"WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS w FROM documents), v AS (SELECT DISTINCT doc_id, {S.web('w')} AS f FROM u), g AS (SELECT * FROM v WHERE length(f) > 1) SELECT d.doc_id, count(f)::INT AS n, md5(coalesce(string_agg(f, ' ' ORDER BY f), '')) AS words_md5 FROM documents d LEFT JOIN g USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id",
    "article_words": rf"WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\s]+')) AS w FROM documents), q AS (SELECT doc_id, regexp_split_to_array(w, '[''’ʼʹ`]') AS p FROM u), r AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i, len(p) AS m FROM q), v AS (SELECT DISTINCT doc_id, f FROM (SELECT doc_id, i, m, {S.web('x')} AS f FROM r) WHERE length(f) > 1 AND NOT (i < m AND f IN ({S.HEADS}))) SELECT d.doc_id, count(f)::INT AS n, md5(coalesce(string_agg(f, ' ' ORDER BY f), '')) AS words_md5 FROM documents d LEFT JOIN v USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id",
    "page_quality_issues": f"WITH {PAGES_SQL}, {_ISSUES} SELECT page_id, array_to_string(issues, ',') AS issues FROM issues_",
    "quality_issue_histogram": f"WITH {PAGES_SQL}, {_ISSUES} SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM issues_) GROUP BY issue",
    "filtered_corpus": f"WITH {PAGES_SQL}, {_ISSUES} SELECT page_id, title, length(intro)::INT AS chars FROM issues_ WHERE len(issues) = 0",
    "corpus_audit": rf"""WITH {PAGES_SQL}, {_ISSUES}, z AS (SELECT issues, array_to_string(list_slice(regexp_extract_all(lower(title), '[^\s]+'), 1, 2), ' ') AS prefix, length(intro) AS chars, len(regexp_extract_all(intro, '[^\s]+')) AS words FROM issues_),
v AS (SELECT 'chars' AS measure, list_sort(list(chars)) AS l FROM z UNION ALL SELECT 'words', list_sort(list(words)) FROM z), p AS (SELECT unnest([0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100]) AS pct)
SELECT 'rows' AS section, '' AS key, count(*) AS value FROM z UNION ALL SELECT 'rejected', '', count(*) FROM z WHERE len(issues) > 0 HAVING count(*) > 0 UNION ALL SELECT 'issue', issue, count(*) FROM (SELECT unnest(issues) AS issue FROM z) GROUP BY issue
UNION ALL SELECT * FROM (SELECT 'prefix', prefix, count(*) AS n FROM z GROUP BY prefix ORDER BY n DESC, prefix LIMIT 30) UNION ALL SELECT measure, pct::VARCHAR, l[1 + round_even(pct / 100 * (len(l) - 1), 0)::INT]::BIGINT FROM v, p WHERE len(l) > 0""",
    "popular_titles_until": """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id AS pos, event_type || ' ' || (event_id % 5000) AS title FROM events), f AS (SELECT title, min((day, pos)) AS spot FROM d WHERE title <> '' AND NOT contains(title, ':') GROUP BY title),
r AS (SELECT title, spot[1] AS day, spot[2] AS pos, row_number() OVER (ORDER BY spot, title) AS k FROM f), h AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY day ORDER BY pos) = 1)
SELECT title, day, pos FROM r WHERE k <= 100 UNION ALL SELECT title, day, pos FROM h WHERE NOT contains(title, ':') AND day > (SELECT day FROM r WHERE k = 100) AND title NOT IN (SELECT title FROM r WHERE k <= 100) QUALIFY row_number() OVER (PARTITION BY title ORDER BY day, pos) = 1""",
    "corpus_quantiles": rf"WITH v AS (SELECT 'chars' AS measure, list_sort(list(length(text))) AS l FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'words', list_sort(list(len(regexp_extract_all(text, '[^\s]+')))) FROM documents WHERE text IS NOT NULL), p AS (SELECT unnest([0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100])::INT AS pct) SELECT pct, l[1 + round_even(pct / 100 * (len(l) - 1), 0)::INT]::INT AS value, measure FROM v, p",
    "title_prefix_top30": rf"WITH {PAGES_SQL} SELECT array_to_string(list_slice(regexp_extract_all(lower(title), '[^\s]+'), 1, 2), ' ') AS prefix, count(*) AS n FROM pages_ GROUP BY 1 ORDER BY n DESC, prefix LIMIT 30",
    "shortest_docs": rf"WITH {PAGES_SQL} SELECT page_id, title, length(intro)::INT AS chars, len(regexp_extract_all(intro, '[^\s]+'))::INT AS words FROM pages_ ORDER BY chars, words, title, page_id LIMIT 40",
    "incremental_dedupe": f"WITH {PAGES_SQL}, n AS (SELECT lower(title) AS k, min(page_id) AS page_id FROM pages_ WHERE page_id % 2 = 1 AND length(intro) >= 220 GROUP BY 1), f AS (SELECT page_id FROM n WHERE k NOT IN (SELECT lower(title) FROM pages_ WHERE page_id % 2 = 0)) SELECT page_id, title FROM pages_ SEMI JOIN f USING (page_id)",
    "intro_patch": rf"WITH {PAGES_SQL}, f AS (SELECT page_id, trim(regexp_replace(regexp_replace('[12]' || left(intro, 300) || chr(10) || chr(10) || chr(10) || chr(10) || 'End.', '\[\d+\]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS x FROM pages_ WHERE page_id % 3 = 0), m AS (SELECT page_id, coalesce(CASE WHEN length(x) >= 100 THEN x END, intro) AS i FROM pages_ LEFT JOIN f USING (page_id)) SELECT page_id, length(i)::INT AS n_chars, len(regexp_extract_all(i, '[^\s]+'))::INT AS n_words FROM m",
    "pageview_rollup_rank": "WITH v AS (SELECT event_type || ' ' || (user_id % 97) AS title, strftime(ts, '%Y-%m') AS month, trunc(value)::BIGINT AS n FROM events WHERE value IS NOT NULL), m AS (SELECT title, month, max(n) AS n FROM v GROUP BY ALL), t AS (SELECT title, sum(n)::BIGINT AS views FROM m GROUP BY title) SELECT row_number() OVER (ORDER BY views DESC, title) AS rank, title, views FROM t",
    "popularity_filter_reasons": rf"WITH {PAGES_SQL}, t AS (SELECT title, sum(length(intro)) AS views FROM pages_ GROUP BY title), k AS (SELECT title, row_number() OVER (ORDER BY views DESC, title) AS rank FROM t WHERE views % 5 <> 0) SELECT CASE WHEN regexp_matches(title, '{S.BAD}') THEN 'bad_title' WHEN length(intro) < 400 THEN 'short' WHEN rank IS NULL THEN 'unranked' WHEN rank > 600 THEN 'rank_too_low' ELSE 'kept' END AS reason, count(*) AS n FROM pages_ LEFT JOIN k USING (title) GROUP BY 1",
    "qid_join": f"SELECT o_custkey AS rank, c_name AS title, 'Q' || o_orderkey AS qid, c_mktsegment FROM orders JOIN customer ON c_name = 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') WHERE o_custkey <= 500 AND NOT regexp_matches(c_name, '{S.BAD}')",
    "popular_titles": "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id AS pos, event_type || '_' || (user_id % 50) AS title FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY day, pos) AS k FROM d) SELECT title, day, pos FROM r WHERE k = 1 AND NOT contains(title, ':') ORDER BY day, pos, title LIMIT 100",
    "easy_pages": rf"WITH {PAGES_SQL}, {S.TOKENS}, p2 AS (SELECT page_id, unnest(regexp_extract_all(title, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+|\s+')) AS part FROM pages_), n2 AS (SELECT page_id, {S.norm('part')} AS norm FROM p2), w2 AS (SELECT DISTINCT page_id, {S.canon('norm')} AS word FROM n2 WHERE regexp_matches(norm, '[\p{{L}}\p{{N}}]')), iw AS (SELECT DISTINCT doc_id AS page_id, canon AS word FROM tok WHERE is_word), j AS (SELECT w2.page_id, count(*) AS n, min(length(w2.word)) AS shortest, count(iw.word) AS found FROM w2 LEFT JOIN iw ON w2.page_id = iw.page_id AND w2.word = iw.word WHERE w2.word <> '' GROUP BY 1) SELECT page_id, title FROM pages_ JOIN j USING (page_id) WHERE n <= 2 AND found = n AND shortest >= 3 AND length(intro) >= 240 AND len(regexp_extract_all(intro, '[^\s]+')) >= 45",
    "cooccurrence_pairs": f"WITH {_PAIRS} SELECT l, r, n FROM pairs",
    "neighbors_top25": f"WITH {_NEIGHBOURS} SELECT * FROM top",
    "local_similarity_lookup": f"WITH {_NEIGHBOURS}, q AS (SELECT a.word AS l, b.word AS r FROM vocab a JOIN vocab b ON length(a.word) = length(b.word)) SELECT q.l, q.r, CASE WHEN q.l = q.r THEN 1.0::DOUBLE ELSE coalesce(f.score, g.score, 0.0) END AS sim FROM q LEFT JOIN top f ON f.word = q.l AND f.other = q.r LEFT JOIN top g ON g.word = q.r AND g.other = q.l",
    "starter_words": f"WITH {S.TOKENS}, v AS (SELECT word, count(*) AS df FROM content GROUP BY word ORDER BY df DESC, word LIMIT 5000) SELECT word, df FROM v WHERE length(word) >= 3 AND word NOT IN ({S.STOP}) AND NOT regexp_matches(word, '^[0-9]+$') ORDER BY df DESC, word LIMIT 200",
    "action_space_priors": f"WITH {_PRIORS} SELECT word, round(prior, 6) AS prior FROM priors",
    "action_vocab": f"WITH {_PRIORS}, a1 AS (SELECT word, row_number() OVER (ORDER BY tf DESC, word) - 1 AS pl FROM titles JOIN priors USING (word) WHERE length(word) >= 3 AND word NOT IN ({S.STOP})), a2 AS (SELECT word, row_number() OVER (ORDER BY round(prior, 9) DESC, word) - 1 AS pl FROM priors), e AS (SELECT 0 AS s, pl, word FROM seeds UNION ALL SELECT 1, pl, word FROM a1 WHERE pl < 100 UNION ALL SELECT 2, pl, word FROM a2 WHERE pl < 300), f AS (SELECT word, min(s * 100000 + pl) AS k FROM e GROUP BY word), g AS (SELECT row_number() OVER (ORDER BY k)::INT AS pos, word FROM f) SELECT pos, word FROM g WHERE pos <= 300",
    "title_gates": rf"WITH {PAGES_SQL} SELECT page_id, regexp_matches(title, '{S.BAD}') AS bad, length(title) > 0 AND NOT contains(title, ':') AND title NOT IN ('Accueil', 'Main_Page', '-') AS article, starts_with(lower(title), 'liste de') OR starts_with(lower(title), 'chronologie de') OR regexp_matches(lower(intro), 'peut désigner|peuvent désigner|page d[''’]homonymie') AS excluded FROM pages_",
    "html_markup_clean": r"WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--(?s:.*?)-->', ' ', 'g'), '<[^>]+>', ' ', 'g') AS x FROM pages WHERE html IS NOT NULL) SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '''''''?', '', 'g'), '\[\[([^|\]]+)\|([^\]]+)\]\]', '\2', 'g'), '\[\[([^\]]+)\]\]', '\1', 'g'), '\[https?://[^\s\]]+\s+([^\]]+)\]', '\1', 'g'), '\[https?://[^\]]+\]', ' ', 'g'), '&nbsp;', ' ', 'g'), '\s+', ' ', 'g'))) AS clean_md5 FROM h",
}
ORACLES = {name: S.spelt(q) for name, q in ORACLES.items()}
