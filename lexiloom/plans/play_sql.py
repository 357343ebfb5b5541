"""The SQL of the queries in :mod:`lexiloom.plans.play`."""

from __future__ import annotations

from lexiloom.functions import prompts
from lexiloom.functions import text as T
from lexiloom.operators.rows import FALLBACKS
from lexiloom.plans import sql as S
from lexiloom.plans.games import _GAME, _MODEL, _REWARD
from lexiloom.plans.policies import _S
from lexiloom.plans.texts import _NEIGHBOURS, PAGES_SQL

GAME, STEPS, END = "Mots", 30, "<eos>"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _checked(reward: str) -> str:
    """The reward's SQL with a dictionary and a background."""
    for old, new in (
        ("gv AS (SELECT game_id, turn,", "bgs AS (SELECT word, (length(word) % 3 * 0.1)::DOUBLE AS bg FROM vc), own AS (SELECT DISTINCT game_id, norm FROM tk WHERE is_word),\ngw AS (SELECT game_id, turn,"),
        ("AS valid FROM gu),", "AS valid FROM gu),\ngv AS (SELECT gw.*, own.norm IS NOT NULL OR (length(guess) % 2 = 0 AND vc.word IS NOT NULL) AS re, coalesce(bg, 0) AS bg FROM gw LEFT JOIN own ON own.game_id = gw.game_id AND own.norm = gw.guess LEFT JOIN vc ON vc.word = gw.guess LEFT JOIN bgs ON bgs.word = gw.cg),"),
        ("WHERE valid AND NOT repeated)", "WHERE valid AND NOT repeated AND re)"),
        ("cl AS (SELECT game_id, turn, canon, max(c) AS c FROM", "cl AS (SELECT game_id, turn, canon, max(c) AS s, greatest(0, max(c) - max(bg)) AS c FROM"),
        ("r AS canon, sim AS c FROM lv", "r AS canon, sim AS c, bg FROM lv"),
        ("SELECT game_id, turn, cg, 1.0 FROM lv)", "SELECT game_id, turn, cg, 1.0, bg FROM lv)"),
        ("max(CASE WHEN in_title THEN c END) AS nearest", "max(CASE WHEN in_title THEN s END) AS nearest"),
        ("valid, repeated, coalesce(exact", "valid, repeated, re, coalesce(exact"),
        ("valid AND NOT repeated AS ok", "valid AND NOT repeated AND re AS ok"),
        ("THEN -100.0::DOUBLE ELSE", "THEN -100.0::DOUBLE WHEN NOT re THEN -200.0 ELSE"),
    ):
        assert old in reward, old
        reward = reward.replace(old, new)
    return reward


_SCORE = "cs AS (SELECT DISTINCT game_id, canon FROM tk WHERE is_word), db AS (SELECT gu.game_id, turn, 1.0 AS sim FROM gu JOIN cs ON cs.game_id = gu.game_id AND canon = cg UNION ALL SELECT gu.game_id, turn, sim FROM gu JOIN sm ON l = cg JOIN cs ON cs.game_id = gu.game_id AND canon = r), dm AS (SELECT game_id, turn, max(sim) AS s FROM db GROUP BY ALL)"
_LAST = _REWARD.rindex("SELECT game_id, turn, guess, CASE WHEN")
_LETTERS = r"[\p{L}](?:[\p{L}]|[''’-])*"
_EXTRACT = rf"CASE WHEN regexp_extract('MOT: ' || guess, '^MOT:\s*({_LETTERS})', 1) <> '' THEN regexp_extract('MOT: ' || guess, '^MOT:\s*({_LETTERS})', 1) ELSE 'MOT' END"
_WORDS = f"""{S.TOKENS},
vocab AS (SELECT word, count(*) AS df, ln((1.0 + (SELECT count(*) FROM documents WHERE text IS NOT NULL)) / (1.0 + count(*))) + 1 AS idf FROM content GROUP BY word ORDER BY df DESC, word LIMIT 1000),
kw AS (SELECT doc_id, word FROM content SEMI JOIN vocab USING (word)),
pairs AS (SELECT a.word AS l, b.word AS r, count(*) AS n FROM kw a JOIN kw b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY ALL)"""
_LINE = "CASE WHEN exact > 0 THEN 'VERT (exact, ' || exact || ' mot(s) revele(s))' WHEN score >= 60 THEN 'ORANGE ' || score || '/100 (domaine tres proche, affine!)' WHEN score >= 30 THEN 'JAUNE ' || score || '/100 (domaine approche, continue)' ELSE 'ROUGE ' || score || '/100 (mauvais domaine, change)' END"
_HEAD = _sql("\n".join(prompts.RULES).replace("{game}", GAME) + "\nEssais restants: ")
_COLD = _sql(f"Aucun indice encore. Commence par explorer des domaines varies:\n  {prompts.DOMAINS}")
_ADVICE = f"CASE WHEN n < 3 OR a IS NULL THEN NULL WHEN a < 45 AND b < 55 THEN {_sql(prompts.PIVOT)} WHEN b >= 60 AND a < b - 20 THEN replace({_sql(prompts.LOST)}, '%d', b::VARCHAR) WHEN a >= 55 THEN {_sql(prompts.WARM)} END"
#: pr(game_id, turn, guess, prompt): the bare prompt before every step.
_PROMPTS = f"""{_S},
ln AS (SELECT *, '  ' || lpad(turn::VARCHAR, greatest(2, length(turn::VARCHAR))::INT, ' ') || '. ' || rpad(guess, greatest(20, length(guess))::INT, ' ') || ' -> ' || {_LINE} AS line, CASE WHEN exact = 0 THEN score END AS miss FROM s),
ag AS (SELECT game_id, turn, guess, turn - 1 AS n, string_agg(line, chr(10)) OVER w AS body, string_agg(guess, ', ') OVER w AS banned, avg(miss) OVER (PARTITION BY game_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a, max(miss) OVER w AS b FROM ln WINDOW w AS (PARTITION BY game_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pr AS (SELECT game_id, turn, guess, {_HEAD} || (100 - n) || '/100.' || chr(10) || chr(10) || CASE WHEN n = 0 THEN {_COLD} ELSE concat_ws(chr(10), 'Historique des essais:', body, chr(10) || 'Mots INTERDITS (NE PAS REPETER): ' || banned, chr(10) || '⚡ ' || {_ADVICE}, '=> Choisis un mot NOUVEAU.') END || chr(10) || chr(10) || 'MOT:' AS prompt FROM ag)"""
_ANSWER, _USER, _THINK = _sql(prompts.CHAT[2]), _sql(prompts.CHAT[0]), _sql(prompts.CHAT[1])
_PW = _NEIGHBOURS + ", acts AS (SELECT word, row_number() OVER (ORDER BY word) AS pos FROM vocab)"
_STUB = r"'([A-ZÀ-Ü][a-zà-ü]+-)\(?_\((\d+)\)'"

_OK = rf"length(X) >= 2 AND regexp_matches(X, '\p{{L}}') AND NOT regexp_matches(X, '\p{{N}}') AND X NOT IN ({S.NEVER})"
_REAL = rf"rw AS (SELECT DISTINCT word FROM (SELECT {S.norm('x')} AS word FROM (SELECT word AS x FROM vc UNION ALL SELECT unnest(regexp_extract_all(p_name, '[^\s]+')) FROM part UNION ALL SELECT unnest([{S.SEEDS}]))) WHERE word <> '')"
_SPARE = [*T.THEME_SEEDS, *FALLBACKS]
_CHOICE = rf"""c AS (SELECT conv_id AS game_id, turn AS pos, {_EXTRACT.replace('guess', 'text')} AS x FROM conversations WHERE text IS NOT NULL), g AS (SELECT game_id, pos, {S.norm('x')} AS guess FROM c),
had AS (SELECT DISTINCT game_id, guess FROM g WHERE pos % 2 = 0), j AS (SELECT g.*, {_OK.replace('X', 'g.guess')} AS ok, had.guess IS NOT NULL AS h FROM g LEFT JOIN had ON had.game_id = g.game_id AND had.guess = g.guess),
p AS (SELECT game_id, arg_min(guess, pos) FILTER (ok AND NOT h) AS picked, sum((NOT ok)::INT)::BIGINT AS rejected_invalid, sum((ok AND h)::INT)::BIGINT AS rejected_repeated FROM j GROUP BY game_id),
fb AS (SELECT unnest([{S.quoted(_SPARE)}]) AS w, unnest(range({len(_SPARE)})) AS k), ok AS (SELECT * FROM fb WHERE {_OK.replace('X', 'w')}), fr AS (SELECT p.game_id, arg_min(w, k) AS w FROM p, ok WHERE NOT EXISTS (SELECT 1 FROM had WHERE had.game_id = p.game_id AND had.guess = ok.w) GROUP BY p.game_id),
choice AS (SELECT p.game_id, coalesce(picked, w, '{_SPARE[-1]}') AS guess, picked IS NULL AS fallback, rejected_invalid, rejected_repeated FROM p LEFT JOIN fr ON fr.game_id = p.game_id)"""
ORACLES = {
    "document_neighbors": f"WITH {_WORDS}, weights AS (SELECT l, r, n * a.idf * b.idf AS w FROM pairs JOIN vocab a ON l = a.word JOIN vocab b ON r = b.word), both_ AS (SELECT l AS word, r AS other, w FROM weights UNION ALL SELECT r, l, w FROM weights), model AS (SELECT word, other, row_number() OVER (PARTITION BY word ORDER BY round(w, 9) DESC, other) AS rank, w / max(w) OVER (PARTITION BY word) AS q FROM both_) SELECT word, other, rank::INT AS rank, round(q, 4) AS score FROM model WHERE rank <= 25",
    "full_text": rf"WITH {_GAME}, p AS (SELECT game_id, idx, in_title, CASE WHEN NOT is_word OR reveal_turn IS NOT NULL THEN text WHEN in_title THEN '?(' || length(text) || ')' ELSE '_(' || length(text) || ')' END AS x FROM rv WHERE text <> chr(10) || chr(10)), a AS (SELECT game_id, coalesce(string_agg(x, '' ORDER BY idx) FILTER (in_title), '') AS t, coalesce(string_agg(x, '' ORDER BY idx) FILTER (NOT in_title), '') AS b FROM p GROUP BY game_id) SELECT game_id, md5('TITRE: ' || trim(regexp_replace(t, '[ \t]+', ' ', 'g'), 'BLANKS') || chr(10) || chr(10) || trim(regexp_replace(b, '[ \t]+', ' ', 'g'), 'BLANKS')) AS text_md5 FROM a".replace("BLANKS", T._BLANKS),
    "stub_hints": f"WITH x AS (SELECT doc_id, 'États-_(4) ' || text || ' Saint-(_(' || length(text) || ') Nord-_(' || length(text) || ')' AS t FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, unnest(regexp_extract_all(t, {_STUB}, 1)) AS stub, unnest(regexp_extract_all(t, {_STUB}, 2)) AS n, generate_subscripts(regexp_extract_all(t, {_STUB}, 1), 1) AS i FROM x) SELECT doc_id, string_agg('  ' || chr(39) || stub || '_(' || n || ')' || chr(39) || ' visible → devine ' || CASE WHEN stub = 'États-' THEN chr(39) || 'unis' || chr(39) || ' immediatement!' ELSE 'la suite de ce mot compose (' || n || ' lettres)!' END, '|' ORDER BY i) AS hints FROM m GROUP BY doc_id",
    "guess_reward_checked": _checked(_REWARD),
    "feedback_steps": _REWARD[:_LAST].rstrip() + f",\nfin AS ({_REWARD[_LAST:]}), {_SCORE} SELECT fin.game_id, fin.turn, fin.guess, coalesce(round_even(s * 100, 0), 0)::INT AS score, fin.exact, fin.semantic, fin.title, fin.reward, fin.solved, fin.invalid AND NOT gv.repeated AS invalid, gv.repeated FROM fin JOIN gv ON gv.game_id = fin.game_id AND gv.turn = fin.turn LEFT JOIN dm ON dm.game_id = fin.game_id AND dm.turn = fin.turn",
    "completion_rewards": "SELECT * FROM (" + _REWARD.replace("FROM g1 WHERE guess IS NOT NULL)", "FROM (SELECT game_id, turn, CASE WHEN turn = 6 THEN " + _EXTRACT + " ELSE guess END AS guess FROM g1 WHERE guess IS NOT NULL))") + ") WHERE turn = 6",
    "probe_words": rf"WITH {_GAME}, {_MODEL}, ca AS (SELECT DISTINCT canon, {S.norm('canon')} AS norm2 FROM tk WHERE is_word), inf AS (SELECT canon, CASE WHEN {S.canon('norm2')} IN ({S.STOP}) OR length({S.canon('norm2')}) < 3 THEN 0.0::DOUBLE ELSE greatest(0, least(8, coalesce(idf, 1.0))) END AS info FROM ca LEFT JOIN vc ON vc.word = {S.canon('norm2')}), b AS (SELECT game_id, norm AS word, max(info) AS info FROM tk JOIN inf USING (canon) WHERE is_word AND NOT in_title AND length(norm) >= 2 AND regexp_matches(norm, '\p{{L}}') AND NOT regexp_matches(norm, '\p{{N}}') AND norm NOT IN ({S.NEVER}) GROUP BY ALL), t AS (SELECT DISTINCT game_id, norm AS word FROM tk WHERE is_word AND in_title), k AS (SELECT game_id, word, row_number() OVER (PARTITION BY game_id ORDER BY info DESC, word)::INT AS rank FROM b ANTI JOIN t USING (game_id, word) WHERE info > 0) SELECT * FROM k WHERE rank <= 5",
    "batch_result_guesses": rf"WITH c AS (SELECT conv_id AS game_id, conv_id || '-' || turn AS custom_id, {_EXTRACT.replace('guess', 'text')} AS x FROM conversations WHERE text IS NOT NULL AND turn % 2 = 0), g AS (SELECT game_id, custom_id, {S.norm('x')} AS guess FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY game_id, guess ORDER BY custom_id) AS r FROM g WHERE length(guess) >= 2 AND regexp_matches(guess, '\p{{L}}') AND NOT regexp_matches(guess, '\p{{N}}') AND guess NOT IN ({S.NEVER})) SELECT custom_id, game_id, guess FROM k WHERE r = 1",
    "compact_text": rf"WITH {_GAME}, sw AS (SELECT game_id, idx, text, NOT is_word OR reveal_turn IS NOT NULL AS shown FROM rv), x AS (SELECT game_id, idx, CASE WHEN shown THEN text WHEN coalesce(lag(NOT shown) OVER (PARTITION BY game_id ORDER BY idx), false) THEN '' ELSE '__' END AS p FROM sw), t AS (SELECT game_id, regexp_replace(string_agg(p, '' ORDER BY idx), '[ \t]+', ' ', 'g') AS t FROM x GROUP BY game_id) SELECT game_id, trim(CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(left(t, 120), '(?s)^(.*) [^ ]*$', '\1') || chr(10) || '[...]' || chr(10) || regexp_replace(right(t, 120), '(?s)^[^ ]* (.*)$', '\1') END, 'BLANKS') AS text FROM t".replace("BLANKS", T._BLANKS),
    "shaped_reward": _REWARD[:_LAST].rstrip() + f",\nfin AS ({_REWARD[_LAST:]}), tn AS (SELECT DISTINCT tk.game_id, norm, fi.turn AS t FROM tk LEFT JOIN fi ON fi.game_id = tk.game_id AND fi.ng = tk.norm WHERE is_word AND in_title), nn AS (SELECT game_id, turn, r AS norm, sim FROM fin JOIN sm ON sm.l = fin.guess WHERE NOT invalid UNION ALL SELECT game_id, turn, guess, 1.0 FROM fin WHERE NOT invalid), bn AS (SELECT nn.game_id, nn.turn, max(sim) AS best FROM nn JOIN tn ON tn.game_id = nn.game_id AND tn.norm = nn.norm WHERE t IS NULL OR t >= nn.turn GROUP BY ALL) SELECT fin.game_id, fin.turn, round(reward + 50.0 * greatest(0, coalesce(best, 0)), 4)::DOUBLE AS shaped FROM fin LEFT JOIN bn ON bn.game_id = fin.game_id AND bn.turn = fin.turn",
    "completion_choice": f"WITH {_CHOICE} SELECT * FROM choice",
    "evaluation_report": f"WITH {_S}, m AS (SELECT *, row_number() OVER (PARTITION BY game_id, guess ORDER BY turn) > 1 AS rep FROM s), ge AS (SELECT max(turn) AS n, max(solved::INT) AS s, sum(rep::INT) AS r, sum(invalid::INT) AS i FROM m GROUP BY game_id), {_CHOICE} SELECT (SELECT count(*) FROM ge) AS games, (SELECT round(avg(s), 6) FROM ge) AS solve_rate, (SELECT round(avg(n), 6) FROM ge) AS mean_steps, (SELECT sum(r)::BIGINT FROM ge) AS repeated, (SELECT sum(i)::BIGINT FROM ge) AS invalid, sum(rejected_repeated)::BIGINT AS rejected_repeated, sum(rejected_invalid)::BIGINT AS rejected_invalid, sum(fallback::INT)::BIGINT AS fallbacks FROM choice",
    "real_word_union": f"WITH {_MODEL}, {_REAL} SELECT word FROM rw",
    "batch_result_real_guesses": rf"WITH {_MODEL}, {_REAL}, c AS (SELECT conv_id AS game_id, conv_id || '-' || turn AS custom_id, {_EXTRACT.replace('guess', 'text')} AS x FROM conversations WHERE text IS NOT NULL AND turn % 2 = 0), g AS (SELECT game_id, custom_id, {S.norm('x')} AS guess FROM c) SELECT custom_id, game_id, guess FROM g WHERE {_OK.replace('X', 'guess')} AND guess IN (SELECT word FROM rw) QUALIFY row_number() OVER (PARTITION BY game_id, guess ORDER BY custom_id) = 1",
    "rescue_words": rf"""WITH {PAGES_SQL}, {_MODEL}, ti AS (SELECT DISTINCT page_id AS game_id, unnest(regexp_extract_all(lower(title), '[a-zA-ZÀ-ÿ]+')) AS r FROM pages_),
w0 AS (SELECT page_id AS game_id, regexp_extract_all(lower(intro), '[\p{{L}}\p{{N}}_]+') AS ws, regexp_extract_all(intro, '[^\s]+') AS g FROM pages_),
w1 AS (SELECT game_id, word, min(pos) AS pos FROM (SELECT game_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w0) WHERE regexp_matches(word, '^[a-zA-ZÀ-ÿ]{{5,}}$') AND word NOT IN ({S.STOP}) GROUP BY ALL),
nv AS (SELECT game_id, r AS word FROM ti UNION SELECT game_id, lower(unnest([g[3], 'that', g[1]])) FROM w0),
op AS (SELECT * FROM (SELECT w1.*, row_number() OVER (PARTITION BY game_id ORDER BY pos) AS n FROM w1 ANTI JOIN nv USING (game_id, word)) WHERE n <= 200),
ne AS (SELECT op.game_id, op.word, max(sim) AS sim FROM op JOIN ti USING (game_id) JOIN sm ON sm.l = op.word AND sm.r = ti.r GROUP BY ALL)
SELECT game_id, arg_min(word, (-coalesce(sim, 0), pos)) AS guess FROM op LEFT JOIN ne USING (game_id, word) GROUP BY game_id""",
    "step_prompts": f"WITH {_PROMPTS} SELECT game_id, turn, md5({_USER} || prompt || {_ANSWER}) AS prompt_md5 FROM pr",
    "curriculum_rows": f"WITH {_PROMPTS} SELECT game_id, turn, md5(prompt) AS prompt_md5, 'MOT: ' || guess AS completion, turn - 1 AS n_history FROM pr",
    "transcript_rows": f"WITH {_PROMPTS}, f AS (SELECT *, row_number() OVER (PARTITION BY game_id, guess ORDER BY turn) AS k FROM pr WHERE game_id % 7 <> 0) SELECT game_id, turn, md5({_USER} || left(prompt, length(prompt) - 5) || {_THINK}) AS prompt_md5, '<think>' || chr(10) || guess || chr(10) || '</think>' || chr(10) || 'MOT: ' || guess || '{END}' AS completion FROM f WHERE k = 1 AND guess IN ('click', 'view', 'purchase', 'signup')",
    "oracle_row_conversion": f"WITH {_S}, o AS (SELECT * REPLACE (semantic AS score) FROM s), l AS (SELECT game_id, guess, '   1. ' || rpad(guess, greatest(20, length(guess))::INT, ' ') || ' -> ' || {_LINE} AS line FROM o) SELECT md5({_USER} || {_HEAD} || '99/100.' || chr(10) || chr(10) || concat_ws(chr(10), 'Historique des essais:', line, chr(10) || 'Mots INTERDITS (NE PAS REPETER): ' || guess, '=> Choisis un mot NOUVEAU.') || chr(10) || chr(10) || 'MOT:' || {_ANSWER}) AS prompt_md5, ' ' || guess || '{END}' AS completion, 't' || game_id AS page_title FROM l",
    "thought_completions": f"WITH c AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, md5(CASE WHEN turn % 3 < 2 AND x <> '' THEN '<think>' || chr(10) || x || chr(10) || '</think>' || chr(10) ELSE '' END || 'MOT: ' || role || '{END}') AS completion_md5 FROM c",
    "curriculum_pages": rf"WITH {PAGES_SQL}, {S.TOKENS}, v AS (SELECT word, count(*) AS df FROM content GROUP BY word ORDER BY df DESC, word LIMIT 5000), p2 AS (SELECT page_id, unnest(regexp_extract_all(title, '[\p{{L}}\p{{N}}_]+')) AS part FROM pages_), n2 AS (SELECT page_id, {S.norm('part')} AS norm FROM p2), w2 AS (SELECT DISTINCT page_id, {S.canon('norm')} AS word FROM n2 WHERE regexp_matches(norm, '[\p{{L}}\p{{N}}]')), j AS (SELECT page_id, count(*) AS n, count(v.word) AS k FROM w2 LEFT JOIN v USING (word) WHERE w2.word <> '' GROUP BY page_id), f AS (SELECT page_id FROM j WHERE n = k AND n <= 2) SELECT page_id, title FROM pages_ WHERE page_id IN (SELECT page_id FROM f) OR (SELECT count(*) FROM f) = 0",
    "training_row_reasons": rf"WITH {PAGES_SQL}, {_MODEL}, r AS (SELECT page_id AS row_id, coalesce(regexp_extract_all(title, '[^\s]+')[1], '') AS w FROM pages_), n1 AS (SELECT *, {S.norm('w')} AS norm FROM r), c1 AS (SELECT *, {S.canon('norm')} AS c FROM n1), x AS (SELECT row_id, CASE WHEN w = '' THEN 'empty' WHEN w IN ({S.STOP}) THEN 'stopword' WHEN coalesce(idf, 0) < 2 THEN 'idf' ELSE 'kept' END AS reason FROM c1 LEFT JOIN vc ON vc.word = c1.c) SELECT row_id, CASE WHEN reason = 'kept' AND count(*) FILTER (reason = 'kept') OVER (ORDER BY row_id) > 300 THEN 'beyond' ELSE reason END AS reason FROM x",
    "well_scored": f"WITH {_S}, t AS (SELECT game_id, turn, CASE WHEN score % 10 <> 0 THEN score END AS score FROM s) SELECT * FROM t WHERE score IS NULL OR score >= 60",
    "popular_long_pages": rf"WITH {PAGES_SQL}, t AS (SELECT title, row_number() OVER (ORDER BY sum(length(intro)) DESC, title) AS rank FROM pages_ GROUP BY title), k AS (SELECT page_id, rank, intro FROM pages_ JOIN t USING (title) ORDER BY rank, page_id LIMIT 200) SELECT page_id, rank FROM k WHERE len(regexp_extract_all(intro, '[^\s]+')) >= 300",
    "agent_summary": f"WITH {_S}, g AS (SELECT max(solved::INT) AS s, count(*) AS n FROM s GROUP BY game_id) SELECT sum(s)::BIGINT AS solved, round(sum(s) / 200, 6) AS solve_rate, round(sum(n) / 200, 6) AS mean_steps FROM g",
    "mix_shares": "SELECT source, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM documents GROUP BY source",
    "sharded_evaluation": f"WITH {_S}, g AS (SELECT game_id, max(solved::INT) AS s, row_number() OVER (ORDER BY game_id) - 1 AS r FROM s GROUP BY game_id), z AS (SELECT ceil(count(*) / 7)::BIGINT AS z FROM g) SELECT (r // z)::INT AS shard, count(*) AS games, sum(s)::BIGINT AS solved FROM g, z GROUP BY 1",
    "guessed_actions": f"WITH {_PW}, r AS (SELECT DISTINCT doc_id AS row_id, doc_id % 50 AS game_id FROM good) SELECT DISTINCT row_id, pos FROM r JOIN good ON good.doc_id = r.game_id JOIN acts USING (word)",
    "expanded_actions": f"WITH {_PW}, x AS (SELECT doc_id AS row_id, word FROM good UNION SELECT doc_id, other FROM good JOIN top USING (word) WHERE rank <= 1) SELECT row_id, pos FROM x JOIN acts USING (word) WHERE pos > 4",
    "far_title_actions": f"WITH {_PW}, x AS (SELECT doc_id AS row_id, other AS word, max(score) AS s FROM good JOIN top USING (word) GROUP BY ALL) SELECT row_id, pos FROM x JOIN acts USING (word) WHERE s >= 0.8",
}
ORACLES = {name: S.spelt(q) for name, q in ORACLES.items()}
