"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op7_decontamination
from .html_wrappers import op1_html_extraction
from .media import op10_media_columns
from .packing import op3_best_fit_packing
from .pii import op5_personal_data
from .quality import op4_quality_classifier
from .secret_scans import op12_secret_scan
from .simhash import op6_simhash
from .suffix_dedup import op2_suffix_dedup
from .token_alignment import op11_token_alignment
from .token_files import op8_token_ids
from .turn_reassembly import op13_turn_reassembly
from .word_windows import op9_substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_personal_data": op5_personal_data,
        "op6_simhash": op6_simhash,
        "op7_decontamination": op7_decontamination,
        "op8_token_ids": op8_token_ids,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_media_columns": op10_media_columns,
        "op11_token_alignment": op11_token_alignment,
        "op12_secret_scan": op12_secret_scan,
        "op13_turn_reassembly": op13_turn_reassembly,
    }


#: Bytes as two hexadecimal digits each; windows are told apart by their MD5.
_OP2 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM (SELECT doc_id, s, (s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, -1))::INT AS new FROM r)),
g AS (SELECT doc_id, g, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY ALL),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM g),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
#: Words are looked up as strings of their windows; ties of doc_id don't occur in the tables.
_OP7 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM dw),
dl AS (WINDOWS),
bw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bs AS (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0),
b AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS x FROM bs),
m AS (SELECT doc_id, i, b.n, item FROM dl JOIN b ON b.n = dl.n AND b.x = dl.x AND dl.k = dl.n),
hit AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM m, (SELECT unnest(range(10)) AS o) WHERE o < n GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""".replace(
    "WINDOWS",
    " UNION ALL ".join(f"SELECT doc_id, i, {n} AS n, string_agg(w, ' ') OVER f AS x, count(*) OVER f AS k FROM d WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in range(1, 11)),
)
_OP9 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
d AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM dw),
x AS (SELECT doc_id, i, string_agg(w, ' ') OVER f AS x, count(*) OVER f AS n FROM d WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
e AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS m FROM x WHERE n = 13),
r AS (SELECT DISTINCT doc_id, i + o AS i FROM e, (SELECT unnest(range(13)) AS o) WHERE m < doc_id),
k AS (SELECT d.doc_id, count(r.i) AS n_removed, string_agg(w, ' ' ORDER BY d.i) FILTER (r.i IS NULL) AS s FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND r.i = d.i GROUP BY d.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM dw LEFT JOIN k USING (doc_id)"""

#: A conversation closes two batches after the first of its arrivals that no arrival follows so soon; a turn is released in the last of the batches that kept it and those before it.
_OP13 = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, ('0x' || substr(sha256(coalesce(conv_id::VARCHAR, '') || ':' || turn::VARCHAR), 1, 8))::BIGINT AS h FROM conversations WHERE turn IS NOT NULL),
f AS (SELECT conv_id, min(turn) AS first FROM r GROUP BY conv_id),
x AS (SELECT conv_id, turn, h % 12 AS b, role, text FROM r UNION ALL SELECT conv_id, turn, (h + 5) % 12, 'user', text FROM r WHERE h % 7 < 2),
a AS (SELECT conv_id, turn, b, min(role || '|' || text) AS p, arg_min(role, role || '|' || text) AS role FROM x GROUP BY conv_id, turn, b),
g AS (SELECT conv_id, b, lead(b) OVER (PARTITION BY conv_id ORDER BY b) AS nb FROM (SELECT DISTINCT conv_id, b FROM a)),
c AS (SELECT conv_id, coalesce(min(b + 2) FILTER (b + 2 <= 11 AND coalesce(nb, 99) > b + 2), 12) AS c FROM g GROUP BY conv_id),
j AS (SELECT a.*, c.c, f.first FROM a JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id JOIN f ON a.conv_id IS NOT DISTINCT FROM f.conv_id),
k AS (SELECT conv_id, turn, any_value(c) AS c, any_value(first) AS first, min(b) AS b, arg_min(p, b) AS p, arg_min(role, b) AS role FROM j WHERE b < c GROUP BY conv_id, turn),
o AS (SELECT *, turn - first = row_number() OVER w - 1 AS free, max(b) OVER w AS freed, turn - 1 = lag(turn) OVER w AND role = lag(role) OVER w AS again FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'release' AS event, conv_id, turn, freed AS batch, sha256(p) AS sha256, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM o WHERE free
UNION ALL SELECT 'reject', conv_id, turn, b, sha256(p), NULL, NULL FROM j WHERE b > c
UNION ALL SELECT 'close', conv_id, -1, any_value(c), sha256(coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (NOT free), '')), max(turn) - any_value(first) + 1 - count(*), count(*) FILTER (again) FROM o GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": _OP2, "op7_decontamination": _OP7, "op9_substring_dedup": _OP9, "op13_turn_reassembly": _OP13}
