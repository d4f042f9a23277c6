"""The queries again as plain SQL over the same tables, for checking."""

from __future__ import annotations

# White space as code points, and as the characters themselves.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]"
)
_POINTS = (
    [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
    + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WS_CHARS = " || ".join(f"chr({c})" for c in _POINTS)


def strip(x: str) -> str:
    return f"coalesce(trim({x}, {WS_CHARS}), '')"


def clean(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' '), '')"


def hash16(x: str) -> str:
    return f"substr(sha256({x}), 1, 16)"


def shown(x: str) -> str:
    return f"coalesce(cast({x} AS VARCHAR), '<null>')"


def clamp(x: str) -> str:
    digits = f"replace({strip(x)}, '_', '')"
    whole = f"regexp_matches({strip(x)}, '^[+-]?[0-9]+(_[0-9]+)*$')"
    return (
        f"CASE WHEN NOT {whole} THEN NULL WHEN {digits} LIKE '-%' THEN 1 "
        f"ELSE least(5, greatest(1, coalesce(try_cast({digits} AS HUGEINT), 9))) END"
    )


def whole(x: str) -> str:
    return f"coalesce(try_cast(trunc({x}) AS INT), 0)"


def upper1(w: str) -> str:
    first = f"substr({w}, 1, 1)"
    return f"CASE WHEN {first} = chr(223) THEN 'SS' ELSE upper({first}) END"


def initials(x: str, sep: str) -> str:
    words = (
        f"list_filter(regexp_split_to_array({strip(x)}, '{WS}+'), "
        "lambda w: regexp_matches(w, '[A-Za-z]'))"
    )
    return (
        f"(SELECT CASE WHEN len(ws) = 0 THEN 'A.' WHEN len(ws) = 1 THEN ({upper1('ws[1]')}) || '.' "
        f"ELSE ({upper1('ws[1]')}) || '.{sep}' || ({upper1('ws[-1]')}) || '.' END "
        f"FROM (SELECT {words} AS ws))"
    )


def initials_google(x: str) -> str:
    joined = f"regexp_replace({x}, '{WS}+', ' ', 'g')"
    anonymous = f"regexp_matches({joined}, '(?i)anon|google user')"
    return f"CASE WHEN coalesce({anonymous}, true) THEN 'A.' ELSE {initials(x, ' ')} END"


END = "TIMESTAMP '2024-12-31 00:00:00'"
CUTOFF = "TIMESTAMP '2024-01-01 00:00:00'"
BACK = "(doc_id % 60 // 10 * 60 + n_chars % 90)"

RATED = f"""
src AS (
  SELECT *, doc_id % 2 = 0 AS apple,
         {END} - to_days(CAST(n_chars % 500 AS INT)) AS review_ts
  FROM documents),
rated0 AS (
  SELECT doc_id AS seq, 'app-' || (n_chars // 100) AS app_id,
    CASE WHEN apple THEN 'App Store' ELSE 'Google Play Store' END AS platform,
    lang AS country, doc_id // 50 AS pg, doc_id % 50 AS pos, review_ts,
    CAST(CAST(review_ts AS DATE) AS VARCHAR) AS review_date,
    CASE WHEN apple THEN least(5, greatest(1, n_chars % 8)) ELSE n_chars % 8 END::INT AS star_rating,
    CASE WHEN apple THEN {initials("source || ' ' || lang", "")}
         ELSE {initials_google("source || ' ' || lang")} END AS reviewer_anonymized,
    CASE WHEN apple THEN {clean("text")} ELSE {strip("text")} END AS review_text,
    CASE WHEN apple THEN lang || ' ' || source END AS review_title,
    CASE WHEN NOT apple THEN length(lang || ' ' || source) END AS thumbs_up_count
  FROM src),
rated AS (
  SELECT *, {hash16("review_text")} AS text_hash FROM rated0
  WHERE star_rating BETWEEN 1 AND 5 AND review_text <> '')
"""
PLACE = "list_position(['en','de','fr','es'], country)"
CLEAN = f"""{RATED},
clean AS (
  SELECT * FROM rated WHERE review_ts >= {CUTOFF}
  QUALIFY row_number() OVER (
    PARTITION BY platform, app_id, review_date, star_rating, text_hash
    ORDER BY {PLACE}, pg, pos) = 1)
"""

# ---- sentiment: rules of the word-by-word description, relationally --------

_PUNCT = r"!-/:-@\[-`{-~"
_MARK = r"""(?:!{1,3}|\?{1,3}|\?!\?!?|!\?!\??|[.,;:''"-])"""


def scored(source: str, key: str, text: str) -> str:
    """CTEs ending in ``scores(key, sentiment_score)`` over ``source``."""
    bare = f"[^{_PUNCT}]{{2,}}"
    cut = f"^{_MARK}({bare})$|^({bare}){_MARK}$"
    step = []
    for k, weight in ((1, 1.0), (2, 0.95), (3, 0.9)):
        step.append(
            f"""
step{k} AS (
  SELECT *, CASE WHEN l{k} IS NULL OR v_{k} IS NOT NULL THEN val{k - 1} ELSE
    (val{k - 1} + CASE WHEN b_{k} IS NULL THEN 0.0 ELSE
       ({weight}::DOUBLE * ((CASE WHEN val{k - 1} < 0 THEN -b_{k} ELSE b_{k} END)
         + CASE WHEN u_{k} AND mixed THEN (CASE WHEN val{k - 1} > 0 THEN 0.733 ELSE -0.733 END)
           ELSE 0.0 END)) END)
    * CASE WHEN g_{k} THEN -0.74::DOUBLE ELSE 1.0 END END AS val{k}
  FROM {'start' if k == 1 else f'step{k - 1}'})"""
        )
    lags = ", ".join(
        f"lag(l, {k}) OVER w AS l{k}, lag(v, {k}) OVER w AS v_{k}, lag(b, {k}) OVER w AS b_{k}, "
        f"lag(g, {k}) OVER w AS g_{k}, lag(u, {k}) OVER w AS u_{k}"
        for k in (1, 2, 3)
    )
    return rf"""
lex AS (
  SELECT tok, ((length(tok) * 7 + ascii(tok) * 3) % 80 - 40) / 10.0::DOUBLE AS v
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS tok FROM benchmark)),
rule(tok, b, g) AS (VALUES ('the', 0.293::DOUBLE, false), ('la', 0.293, false), ('der', 0.293, false),
  ('so', 0.293, false), ('and', -0.293, false), ('en', -0.293, false), ('und', -0.293, false),
  ('is', NULL, true), ('de', NULL, true), ('not', NULL, true)),
tok0 AS (
  SELECT {key} AS k, list_filter(regexp_split_to_array({strip(text)}, '{WS}+'),
         lambda x: length(x) > 1) AS ts FROM {source}),
tok1 AS (SELECT k, unnest(ts) AS t0, unnest(range(len(ts))) AS i FROM tok0),
tok2 AS (
  SELECT k, i, CASE WHEN regexp_matches(t0, '[{_PUNCT}]')
    THEN regexp_replace(t0, '{cut}', '\1\2') ELSE t0 END AS t FROM tok1),
tok3 AS (
  SELECT k, i, lower(t) AS l, (upper(t) = t AND lower(t) <> t AND NOT contains(t, chr(223))) AS u FROM tok2),
tok4 AS (
  SELECT a.k, a.i, a.l, a.u, lex.v, rule.b,
         coalesce(rule.g, false) OR contains(a.l, 'n''t') AS g
  FROM tok3 a LEFT JOIN lex ON a.l = lex.tok LEFT JOIN rule ON a.l = rule.tok),
doc AS (
  SELECT k, bool_or(u) AND bool_or(NOT u) AS mixed, min(i) FILTER (l = 'for') AS turn
  FROM tok4 GROUP BY k),
near AS (SELECT *, {lags} FROM tok4 WINDOW w AS (PARTITION BY k ORDER BY i)),
start AS (
  SELECT near.*, mixed, turn, v + CASE WHEN u AND mixed
    THEN (CASE WHEN v > 0 THEN 0.733 ELSE -0.733 END) ELSE 0.0 END AS val0
  FROM near JOIN doc USING (k) WHERE v IS NOT NULL),
{",".join(step)},
total AS (
  SELECT k, sum(val3 * CASE WHEN turn IS NULL OR i = turn THEN 1.0::DOUBLE
                            WHEN i < turn THEN 0.5 ELSE 1.5 END ORDER BY i) AS s
  FROM step3 GROUP BY k),
emph AS (
  SELECT {key} AS k, least(4, n_bang) * 0.292::DOUBLE
    + CASE WHEN n_ask <= 1 THEN 0.0 WHEN n_ask <= 3 THEN n_ask * 0.18::DOUBLE ELSE 0.96 END AS e
  FROM (SELECT {key}, length({text}) - length(replace({text}, '!', '')) AS n_bang,
               length({text}) - length(replace({text}, '?', '')) AS n_ask FROM {source})),
loud AS (
  SELECT emph.k, CASE WHEN s > 0 THEN s + e WHEN s < 0 THEN s - e ELSE 0.0 END AS s
  FROM emph LEFT JOIN total USING (k)),
scores AS (SELECT k AS {key}, round(s / sqrt(s * s + 15.0::DOUBLE), 4) + 0.0 AS sentiment_score FROM loud)
"""


_KIND = "(length(phrase) * 5 + ascii(phrase)) % 5"

_PHRASES = f"""
found_phrases AS (
  SELECT DISTINCT unnest(list_concat(list_concat(regexp_extract_all(lower(text), '[a-z]{{2,}} [a-z]{{2,}}'),
    regexp_extract_all(lower(text), '[a-z]{{2,}}(?: [a-z]{{2,}}){{2}}')), regexp_extract_all(lower(text), '[a-z]{{2,}}(?: [a-z]{{2,}}){{3}}'))) AS phrase
  FROM benchmark),
ph AS (
  SELECT phrase, len(string_split(phrase, ' ')) AS m,
    CASE WHEN {_KIND} = 0 THEN ((length(phrase) * 7 + ascii(phrase) * 3) % 80 - 40) / 10.0::DOUBLE END AS v,
    CASE WHEN {_KIND} = 1 THEN CASE WHEN length(phrase) % 2 = 0 THEN 0.293::DOUBLE ELSE -0.293 END END AS b,
    {_KIND} = 2 AS g, CASE WHEN {_KIND} = 3 THEN 1.25::DOUBLE END AS e
  FROM found_phrases),
win AS (
  SELECT k, i, u, l AS w2, lead(l, 1) OVER w AS x1, lead(l, 2) OVER w AS x2, lead(l, 3) OVER w AS x3,
    u AND lead(u, 1) OVER w AS u2, u AND lead(u, 1) OVER w AND lead(u, 2) OVER w AS u3,
    u AND lead(u, 1) OVER w AND lead(u, 2) OVER w AND lead(u, 3) OVER w AS u4
  FROM tok3 WINDOW w AS (PARTITION BY k ORDER BY i)),
occ AS (
  SELECT k, i AS s, ph.*, u2 AS loud FROM win JOIN ph ON m = 2 AND phrase = w2 || ' ' || x1
  UNION ALL SELECT k, i, ph.*, u3 FROM win JOIN ph ON m = 3 AND phrase = w2 || ' ' || x1 || ' ' || x2
  UNION ALL SELECT k, i, ph.*, u4 FROM win JOIN ph ON m = 4 AND phrase = w2 || ' ' || x1 || ' ' || x2 || ' ' || x3),
best AS (SELECT * FROM occ QUALIFY row_number() OVER (PARTITION BY k, s ORDER BY m DESC) = 1),
next AS (
  SELECT a.k, a.s, (SELECT min(b.s) FROM best b WHERE b.k = a.k AND b.s >= a.s + a.m) AS t FROM best a),
walk AS (
  SELECT k, min(s) AS s FROM best GROUP BY k
  UNION ALL SELECT next.k, next.t FROM walk JOIN next ON next.k = walk.k AND next.s = walk.s WHERE next.t IS NOT NULL),
kept AS (SELECT best.* FROM best JOIN walk ON best.k = walk.k AND best.s = walk.s),
cover AS (SELECT k, unnest(range(s, s + m)) AS i, s + m - 1 AS last, v, b, g, e, loud FROM kept)"""


def scored_with_phrases(source: str, key: str, text: str) -> str:
    """``scored`` with the phrases of ``benchmark``: the last word of one stands for it, its others for nothing."""
    plain = scored(source, key, text)
    begin, end = plain.index("tok4 AS ("), plain.index("doc AS (")
    words = f"""{_PHRASES.strip()},
tok4 AS (
  SELECT a.k, a.i, CASE WHEN c.k IS NULL THEN a.l ELSE '' END AS l, a.u AS u0,
    CASE WHEN c.k IS NULL THEN a.u ELSE c.loud AND c.last = a.i END AS u,
    CASE WHEN c.k IS NULL THEN lex.v WHEN c.last = a.i THEN c.v END AS v,
    CASE WHEN c.k IS NULL THEN rule.b WHEN c.last = a.i THEN c.b END AS b,
    CASE WHEN c.k IS NULL THEN coalesce(rule.g, false) OR contains(a.l, 'n''t') ELSE c.g AND c.last = a.i END AS g,
    CASE WHEN c.last = a.i THEN c.e END AS e
  FROM tok3 a LEFT JOIN lex ON a.l = lex.tok LEFT JOIN rule ON a.l = rule.tok
  LEFT JOIN cover c ON c.k = a.k AND c.i = a.i),
"""
    rest = plain[end:].replace("bool_or(u) AND bool_or(NOT u)", "bool_or(u0) AND bool_or(NOT u0)")
    for k in (1, 2, 3):
        rest = rest.replace(f"lag(g, {k}) OVER w AS g_{k}", f"lag(g, {k}) OVER w AS g_{k}, lag(e, {k}) OVER w AS e_{k}")
        rest = rest.replace(
            f"CASE WHEN g_{k} THEN -0.74::DOUBLE ELSE 1.0 END",
            f"CASE WHEN g_{k} THEN -0.74::DOUBLE WHEN e_{k} IS NOT NULL THEN e_{k} ELSE 1.0 END",
        )
    return plain[:begin] + words + rest


LABEL = (
    "CASE WHEN isnan({0}) THEN 'neutral' WHEN {0} >= 0.25 THEN 'good' "
    "WHEN {0} <= -0.25 THEN 'bad' ELSE 'neutral' END"
)

# ---- raw pages ------------------------------------------------------------

APPLE = f"""
raw AS (
  SELECT doc_id, 'app-' || (doc_id // 60) AS app_id, lang AS country,
    CAST(doc_id % 60 // 10 + 1 AS INT) AS page,
    CAST(row_number() OVER (PARTITION BY doc_id // 10, lang ORDER BY doc_id) - 1 AS INT) AS entry_pos,
    CASE n_chars % 12 WHEN 8 THEN NULL WHEN 9 THEN 4 WHEN 10 THEN NULL WHEN 11 THEN NULL
      ELSE least(5, greatest(1, n_chars % 12)) END::INT AS star_rating,
    DATE '2024-12-31' - CAST({BACK} AS INT) AS day,
    doc_id % 24 * 3600 + doc_id % 60 * 60 AS second,
    CASE doc_id % 4 WHEN 1 THEN -25200 WHEN 2 THEN 19800 ELSE 0 END AS zone,
    CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN source || ' ' || lang
      WHEN 3 THEN lang WHEN 4 THEN '12 34' ELSE lang || ' x ' || source END AS name,
    {clean("CASE WHEN doc_id % 10 = 5 THEN text ELSE source || '  ' || lang END")} AS title,
    {clean("CASE WHEN doc_id % 10 = 3 THEN '' ELSE text END")} AS content
  FROM documents),
entry AS (
  SELECT *, CAST(epoch(day) AS BIGINT) + second - zone AS review_epoch,
    coalesce(content, title) AS review_text,
    CASE WHEN star_rating IS NULL THEN 'skip' WHEN doc_id % 50 = 17 THEN 'bad'
         WHEN coalesce(content, title) IS NULL THEN 'skip' ELSE 'ok' END AS status
  FROM raw),
apple AS (SELECT * FROM entry WHERE status = 'ok')
"""

GOOGLE = f"""
graw AS (
  SELECT doc_id, 'app-' || (doc_id // 60) AS app_id, doc_id // 60 AS app,
    CAST(doc_id % 60 // 10 + 1 AS INT) AS page0, CAST(doc_id % 10 AS INT) AS entry_pos,
    doc_id // 60 % 3 = 1 AND doc_id % 60 // 10 >= 3 AS second,
    CASE WHEN second THEN 'de' ELSE 'en' END AS lang, CASE WHEN second THEN page0 - 3 ELSE page0 END::INT AS page,
    CASE WHEN doc_id // 60 % 5 = 2 THEN '<null>' ELSE 'us' END AS country,
    CASE WHEN doc_id % 13 = 5 THEN NULL
      ELSE {END} - to_days(CAST({BACK} AS INT)) + to_seconds(doc_id % 1000) END AS made,
    CASE WHEN n_chars % 11 = 7 THEN 0 ELSE n_chars % 8 END::INT AS star_rating,
    CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' A Google  User'
      WHEN 2 THEN source || ' ' || lang WHEN 3 THEN 'Canon Fan'
      ELSE lang || '  x ' || source END AS name,
    CASE WHEN doc_id % 17 = 3 THEN '' ELSE {strip("text")} END AS review_text,
    CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars % 40 END::INT AS thumbs_up_count,
    CASE WHEN doc_id % 4 < 2 THEN NULL ELSE 'Thanks, ' || source END AS reply,
    CASE WHEN doc_id % 4 < 2 THEN NULL
      ELSE CAST({END} - to_days(CAST(n_chars % 60 AS INT)) AS DATE) END AS reply_day
  FROM documents),
google AS (
  SELECT * FROM graw
  WHERE made IS NOT NULL AND star_rating BETWEEN 1 AND 5 AND review_text <> ''),
gstats AS (
  SELECT app_id, lang, country, page, count(*) AS n_rows, coalesce(min(made) < {CUTOFF}, false) AS stale,
    min(page0) = 6 OR (min(page0) = 3 AND min(app) % 4 = 1) AS is_last
  FROM graw GROUP BY app_id, lang, country, page),
gwalk AS (
  SELECT *, row_number() OVER w = page
    AND NOT coalesce(bool_or(stale OR is_last) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reached
  FROM gstats WINDOW w AS (PARTITION BY app_id, lang ORDER BY page))
"""


def walk(stats: str, cap: int | None = None) -> str:
    within = "true" if cap is None else f"page <= {cap}"
    return f"""
walked AS (
  SELECT *, row_number() OVER w = page
    AND NOT coalesce(bool_or(stale) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reached
  FROM {stats} WHERE {within} WINDOW w AS (PARTITION BY app_id, country ORDER BY page))
"""


EVENT_PAGES = """
pages_of AS (
  SELECT CAST(user_id AS VARCHAR) AS app_id, 'us' AS country,
    CAST((30 - day(ts)) // 2 + 1 AS INT) AS page, ts
  FROM events WHERE event_type <> 'error'),
estats AS (
  SELECT app_id, country, page, count(*) AS n_rows, min(ts) AS oldest,
    min(ts) < TIMESTAMP '2024-01-17' AS stale
  FROM pages_of GROUP BY ALL)
"""

CATALOG = """
cat AS (
  SELECT 'app-' || c_custkey AS app_id, c_custkey AS c,
    CASE WHEN c_custkey % 50 = 20 THEN 'shared_' || (c_custkey // 100)
      ELSE lower(replace(c_name, '#', '_')) || CASE WHEN again = 1 THEN '_again' ELSE '' END END AS app_name,
    CASE (c_custkey + 4) % 9 WHEN 0 THEN '123456789' WHEN 1 THEN '' WHEN 2 THEN 'id' || c_custkey
      WHEN 3 THEN '  ' ELSE CAST(500000000 + c_custkey AS VARCHAR) END AS a,
    c_custkey % 4 IN (0, 1) AS on_a, c_custkey % 4 IN (0, 2) AS on_g
  FROM customer JOIN (VALUES (0), (1)) AS t(again) ON again = 0 OR c_custkey % 50 = 10),
errs AS (
  SELECT *,
    CASE WHEN on_a THEN CASE WHEN (c + 4) % 9 = 0 THEN 'app_store_id_placeholder'
      WHEN (c + 4) % 9 IN (1, 3) THEN 'app_store_id_empty' WHEN (c + 4) % 9 = 2 THEN 'app_store_id_malformed' END END AS ea,
    CASE WHEN on_g THEN CASE WHEN (c + 4) % 7 = 0 THEN 'google_play_id_placeholder'
      WHEN (c + 4) % 7 = 3 THEN 'google_play_id_empty' WHEN (c + 4) % 7 IN (1, 2) THEN 'google_play_id_malformed' END END AS eg,
    CASE WHEN NOT on_a AND NOT on_g THEN 'no_platform' END AS ep,
    CASE WHEN coalesce(trim(app_id::VARCHAR), '') = '' THEN 'app_id_missing'
      WHEN count(*) OVER (PARTITION BY app_id) > 1 THEN 'app_id_repeated' END AS er,
    CASE WHEN coalesce(trim(app_name), '') = '' THEN 'app_name_missing'
      WHEN count(*) OVER (PARTITION BY app_name) > 1 THEN 'app_name_repeated' END AS en
  FROM cat),
checked AS (SELECT *, concat_ws(',', ea, eg, ep, er, en) AS errors FROM errs)
"""

# ---- dates ----------------------------------------------------------------

ORDER_DATES = """
d AS (
  SELECT o_orderkey, o_orderkey % 15 AS kind, CAST(o_orderdate AS DATE) AS day,
    CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS midnight FROM orders)
"""

TEXTS = """
texts AS (
  SELECT doc_id AS id, -1::BIGINT AS part, text FROM documents
  UNION ALL SELECT conv_id, turn, text FROM conversations)
"""

NAMES = """
names AS (
  SELECT 'part' AS kind, p_partkey AS id, CASE p_size % 7 WHEN 0 THEN p_name
    WHEN 1 THEN '  ' || p_name || chr(10) || p_type || ' ' WHEN 2 THEN '' WHEN 3 THEN 'Anon ' || p_name
    WHEN 4 THEN '12 34' WHEN 5 THEN p_size || p_name || ' ' || p_brand ELSE 'a Google USER' END AS name
  FROM part
  UNION ALL SELECT 'document', doc_id, text FROM documents)
"""

STATUS = """CASE WHEN {stop} THEN 'interrupted' WHEN {total} = 0 THEN 'failed'
  WHEN {failed} > 0 THEN 'partial' ELSE 'success' END"""
CODE = "CASE {0} WHEN 'interrupted' THEN 130 WHEN 'failed' THEN 3 WHEN 'partial' THEN 2 ELSE 0 END::INT"

_LEX_DOCS = f"WITH {scored('documents', 'doc_id', 'text')} SELECT doc_id, coalesce(sentiment_score, 0.0) AS sentiment_score FROM scores"

_FULL_RUN = f"""{APPLE},
astats AS (SELECT app_id, country, page, min(review_epoch) < epoch({CUTOFF}) AS stale FROM apple GROUP BY ALL),
{walk("astats")}, {GOOGLE}, {CATALOG},
kept_a AS (
  SELECT app_id, country, page, entry_pos, CAST(day AS VARCHAR) AS review_date, star_rating,
    {initials("name", "")} AS reviewer_anonymized, review_text, 'App Store' AS platform,
    NULL::INT AS thumbs_up_count, NULL::VARCHAR AS reply
  FROM apple JOIN walked USING (app_id, country, page)
  WHERE reached AND review_epoch >= epoch({CUTOFF})
    AND app_id IN (SELECT app_id FROM checked WHERE errors = '' AND on_a)
  QUALIFY row_number() OVER (PARTITION BY app_id, day, star_rating, {hash16("review_text")}
                             ORDER BY {PLACE}, page, entry_pos) = 1),
kept_g AS (
  SELECT app_id, lang AS country, page, entry_pos, CAST(CAST(made AS DATE) AS VARCHAR) AS review_date,
    star_rating, {initials_google("name")} AS reviewer_anonymized, review_text,
    'Google Play Store' AS platform, thumbs_up_count, reply
  FROM google JOIN gwalk USING (app_id, lang, country, page)
  WHERE reached AND made >= {CUTOFF}
    AND app_id IN (SELECT app_id FROM checked WHERE errors = '' AND on_g)
  QUALIFY row_number() OVER (PARTITION BY app_id, CAST(made AS DATE), star_rating, {hash16("review_text")}
                             ORDER BY page, entry_pos, lang) = 1),
kept AS (
  SELECT *, concat_ws('/', platform, app_id, country, page, entry_pos) AS uid
  FROM (SELECT * FROM kept_a UNION ALL SELECT * FROM kept_g))"""

# Totals and status of each valid app of a full run.
_RUN_TOTALS = f"""{_FULL_RUN},
n AS (SELECT app_id, count(*) FILTER (platform = 'App Store') AS na,
        count(*) FILTER (platform <> 'App Store') AS ng FROM kept GROUP BY 1),
t AS (SELECT app_id, coalesce(na, 0) + coalesce(ng, 0) AS total_reviews,
        (on_a AND coalesce(na, 0) = 0)::INT + (on_g AND coalesce(ng, 0) = 0)::INT AS n_failed
      FROM (SELECT * FROM checked WHERE errors = '') LEFT JOIN n USING (app_id)),
s AS (SELECT *, {STATUS.format(stop="false", total="total_reviews", failed="n_failed")} AS status FROM t)"""

ORACLE: dict[str, str] = {
    "clean_review_table": f"""WITH {CLEAN}, {scored("clean", "seq", "review_text")}
        SELECT seq, app_id, platform, review_date, star_rating, reviewer_anonymized, text_hash,
          sentiment_score, {LABEL.format("sentiment_score")} AS sentiment_label
        FROM (SELECT clean.*, coalesce(scores.sentiment_score, 0.0) AS sentiment_score
              FROM clean JOIN scores USING (seq))""",
    "collect_app_store": f"""WITH {APPLE},
        astats AS (SELECT app_id, country, page, min(review_epoch) < epoch({CUTOFF}) AS stale
                   FROM apple GROUP BY ALL),
        {walk("astats")}
        SELECT app_id, country, page, entry_pos, CAST(day AS VARCHAR) AS review_date, star_rating,
          {initials("name", "")} AS reviewer_anonymized, {hash16("review_text")} AS text_hash
        FROM apple JOIN walked USING (app_id, country, page)
        WHERE reached AND review_epoch >= epoch({CUTOFF})
        QUALIFY row_number() OVER (PARTITION BY app_id, day, star_rating, {hash16("review_text")}
                                   ORDER BY {PLACE}, page, entry_pos) = 1""",
    "collect_google_play": f"""WITH {GOOGLE}
        SELECT app_id, country, lang, page, entry_pos, CAST(CAST(made AS DATE) AS VARCHAR) AS review_date,
          star_rating, {initials_google("name")} AS reviewer_anonymized,
          {hash16("review_text")} AS text_hash
        FROM google JOIN gwalk USING (app_id, lang, country, page)
        WHERE reached AND made >= {CUTOFF}
        QUALIFY row_number() OVER (PARTITION BY app_id, CAST(made AS DATE), star_rating, {hash16("review_text")}
                                   ORDER BY page, entry_pos, lang) = 1""",
    "full_run": f"""WITH {_FULL_RUN}, {scored("kept", "uid", "review_text")}
        SELECT app_name || '_reviews_analysis' AS output_name, review_date, star_rating,
          reviewer_anonymized, platform, {hash16("review_text")} AS text_hash,
          {shown("thumbs_up_count")} AS thumbs_up_count, {shown("reply")} AS developer_reply,
          sentiment_score, {LABEL.format("sentiment_score")} AS sentiment_label
        FROM (SELECT kept.*, app_name, coalesce(scores.sentiment_score, 0.0) AS sentiment_score
              FROM kept JOIN scores USING (uid) JOIN checked USING (app_id))""",
    "app_store_parse": f"""WITH {APPLE}
        SELECT app_id, country, page, entry_pos, review_epoch, CAST(day AS VARCHAR) AS review_date,
          star_rating, {initials("name", "")} AS reviewer_anonymized, 'App Store' AS platform,
          {hash16("review_text")} AS text_hash,
          {hash16("CASE WHEN title <> review_text THEN title ELSE '' END")} AS title_hash
        FROM apple""",
    "app_store_parse_strict": f"""WITH {APPLE},
        poisoned AS (SELECT DISTINCT app_id, country, page FROM entry WHERE status = 'bad')
        SELECT app_id, country, page, count(*) AS n_reviews, CAST(sum(star_rating) AS BIGINT) AS stars
        FROM apple ANTI JOIN poisoned USING (app_id, country, page) GROUP BY ALL""",
    "page_quality": f"""WITH {APPLE},
        kinds AS (SELECT *, (doc_id // 60 + page) % 7 AS kind FROM entry),
        seen AS (SELECT *, CASE WHEN kind = 2 AND star_rating IS NOT NULL THEN 'undated' ELSE status END AS found FROM kinds)
        SELECT app_id, country, page,
          count(*) FILTER (kind <> 0 AND (found = 'ok' OR (kind = 1 AND found = 'bad'))) AS n_rows,
          count(*) FILTER (kind > 1 AND found = 'bad') AS n_bad,
          count(*) FILTER (kind <> 0 AND found = 'undated') AS n_undated,
          count(*) FILTER (kind <> 0 AND found = 'skip') AS n_rejected,
          CASE WHEN min(kind) = 0 THEN 1 ELSE 0 END::BIGINT AS n_unreadable
        FROM seen GROUP BY app_id, country, page""",
    "google_play_parse": f"""WITH {GOOGLE}
        SELECT app_id, lang, page, entry_pos, CAST(floor(epoch(made)) AS BIGINT) AS review_epoch,
          CAST(CAST(made AS DATE) AS VARCHAR) AS review_date, star_rating,
          {initials_google("name")} AS reviewer_anonymized, 'Google Play Store' AS platform,
          {hash16("review_text")} AS text_hash, thumbs_up_count,
          {shown("reply")} AS developer_reply, {shown("reply_day")} AS developer_reply_date
        FROM google""",
    "request_frontier": f"""WITH {CATALOG}
        SELECT app_id, a AS app_store_id, CAST(p - 1 AS INT) AS country_order, c2 AS country,
          CAST(page AS INT) AS page,
          'https://itunes.apple.com/' || c2 || '/rss/customerreviews/page=' || page || '/id=' || a
            || '/sortby=mostrecent/json' AS url
        FROM checked, (VALUES (1, 'us'), (2, 'gb'), (3, 'de')) AS t(p, c2), range(1, 6) AS r(page)
        WHERE errors = '' AND on_a""",
    "csv_roundtrip": f"""WITH {CLEAN}
        SELECT review_date, star_rating, reviewer_anonymized, review_text, platform FROM clean""",
    "run_summary": f"""WITH {CLEAN}, {CATALOG},
        n AS (SELECT app_id, count(*) FILTER (platform = 'App Store') AS na,
                count(*) FILTER (platform <> 'App Store') AS ng FROM clean GROUP BY 1),
        j AS (SELECT cat.*, CASE WHEN on_a THEN coalesce(na, 0) END AS ka,
                CASE WHEN on_g THEN coalesce(ng, 0) END AS kg, c % 50 = 7 AS interrupted
              FROM (SELECT DISTINCT app_id, c, on_a, on_g FROM cat) AS cat LEFT JOIN n USING (app_id)),
        t AS (SELECT *, CAST(coalesce(ka, 0) + coalesce(kg, 0) AS BIGINT) AS total_reviews,
                concat_ws(',', CASE WHEN ka = 0 THEN 'app-store' END,
                          CASE WHEN kg = 0 THEN 'google-play' END) AS platforms_failed FROM j),
        s AS (SELECT *, {STATUS.format(stop="interrupted", total="total_reviews", failed="length(platforms_failed)")} AS status FROM t)
        SELECT app_id, status, {CODE.format("status")} AS exit_code, total_reviews,
          '{{' || concat_ws(',', '"app_store":' || ka, '"google_play":' || kg) || '}}' AS by_platform,
          platforms_failed, interrupted FROM s""",
    "standard_projection": f"""WITH {RATED}
        SELECT seq, review_date, star_rating, reviewer_anonymized, review_text, platform FROM rated""",
    "extended_projection": f"""WITH {RATED}
        SELECT seq, review_date, star_rating, reviewer_anonymized, platform,
          {shown("review_title")} AS review_title, {shown("thumbs_up_count")} AS thumbs_up_count FROM rated""",
    "platform_filter": f"""WITH {RATED}
        SELECT seq, platform, star_rating FROM rated WHERE platform = 'Google Play Store'""",
    "country_filter": f"WITH {RATED} SELECT seq, country FROM rated WHERE country IN ('de', 'fr')",
    "recency_filter": "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-17'",
    "app_store_valid": f"WITH {APPLE} SELECT app_id, country, page, entry_pos, status FROM entry",
    "google_play_valid": f"WITH {GOOGLE} SELECT app_id, lang, page, count(*) AS n_valid FROM google GROUP BY 1, 2, 3",
    "catalog_validation": f"WITH {CATALOG} SELECT app_id, errors FROM checked",
    "oldest_per_page": f"""WITH {EVENT_PAGES}
        SELECT app_id, page, n_rows, epoch_us(oldest) AS oldest_micros FROM estats""",
    "page_walk": f"""WITH {EVENT_PAGES}, {walk("estats")}
        SELECT app_id, page, n_rows, stale, reached FROM walked""",
    "page_cap": f"""WITH {EVENT_PAGES}, {walk("estats", 12)}
        SELECT app_id, page, n_rows, stale, reached FROM walked""",
    "batch_walk": f"WITH {GOOGLE} SELECT app_id, lang, country, page, n_rows, is_last, stale, reached FROM gwalk",
    "page_order": f"""WITH {APPLE},
        ends AS (SELECT app_id, country, page, max(review_epoch) AS newest, min(review_epoch) AS oldest
                 FROM apple GROUP BY ALL),
        prev AS (SELECT *, lag(oldest) OVER (PARTITION BY app_id, country ORDER BY page) AS previous_oldest FROM ends)
        SELECT app_id, country, page, newest, previous_oldest FROM prev WHERE newest > previous_oldest""",
    "count_by_platform": f"""WITH {CLEAN}
        SELECT 'app_store' AS platform_key, count(*) AS n_reviews FROM clean WHERE platform = 'App Store'
        UNION ALL SELECT 'google_play', count(*) FROM clean WHERE platform <> 'App Store'""",
    "run_status": f"""WITH {RATED},
        r AS (SELECT country, substr(review_date, 1, 7) AS month, count(*) AS total,
                2 - count(DISTINCT platform) AS failed FROM rated GROUP BY 1, 2),
        s AS (SELECT *, {STATUS.format(stop="month = '2024-02'", total="total", failed="failed")} AS status FROM r)
        SELECT country, month, total, status, {CODE.format("status")} AS exit_code FROM s""",
    "sorted_output": f"""WITH {RATED}
        SELECT seq, review_date, star_rating, platform, true AS in_order FROM rated""",
    "union_countries": f"WITH {RATED} SELECT seq, country, platform FROM rated",
    "union_platforms": f"""WITH {RATED}
        SELECT seq, star_rating, {shown("review_title")} AS review_title,
          {shown("thumbs_up_count")} AS thumbs_up_count FROM rated""",
    "dedup_first_seen": f"""WITH {CLEAN}
        SELECT seq, app_id, platform, review_date, star_rating, text_hash FROM clean""",
    "clean_text": f"WITH {TEXTS} SELECT id, part, {shown(clean('text'))} AS cleaned FROM texts",
    "strip_text": f"WITH {TEXTS} SELECT id, part, {shown(strip('text'))} AS stripped FROM texts",
    "text_hash": f"WITH {TEXTS} SELECT id, part, {shown(hash16('text'))} AS text_hash FROM texts",
    "clamp_star": f"""WITH q AS (
          SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 9 AS kind,
            CAST(trunc(l_quantity) AS INT) AS n, CAST(l_quantity AS VARCHAR) AS t, l_returnflag FROM lineitem),
        r AS (SELECT *, CASE kind WHEN 0 THEN '' || n WHEN 1 THEN '+' || (n % 7) WHEN 2 THEN '-' || n
            WHEN 3 THEN t WHEN 4 THEN '  ' || (n % 6) || chr(10) WHEN 5 THEN (n % 2) || '_' || (n % 9)
            WHEN 6 THEN repeat('' || n, 20) WHEN 7 THEN l_returnflag ELSE '00' || (n % 8) END AS raw FROM q)
        SELECT l_orderkey, l_linenumber, {shown(clamp("raw"))} AS star_rating FROM r""",
    "google_score": f"""WITH r AS (
          SELECT event_id, {whole("CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value / 50.0 END")} AS score FROM events)
        SELECT event_id, score, score BETWEEN 1 AND 5 AS kept FROM r""",
    "initials_app_store": f"WITH {NAMES} SELECT kind, id, {initials('name', '')} AS initials FROM names",
    "initials_google": f"WITH {NAMES} SELECT kind, id, {initials_google('name')} AS initials FROM names",
    "parse_ts": f"""WITH {ORDER_DATES}
        SELECT o_orderkey, {shown("CASE kind WHEN 8 THEN NULL ELSE midnight + CASE kind WHEN 1 THEN 84600 + 25200 WHEN 2 THEN 600 - 19800 WHEN 3 THEN 43200 WHEN 4 THEN 29700 WHEN 6 THEN 82800 + 28800 WHEN 10 THEN 43200 WHEN 11 THEN 43200 WHEN 14 THEN 43200 ELSE 0 END END")} AS epoch FROM d""",
    "review_date": f"""WITH {ORDER_DATES}
        SELECT o_orderkey, {shown("CASE kind WHEN 8 THEN NULL ELSE day END")} AS review_date FROM d""",
    # what each spelling adds to midnight UTC; 11 to 15 have the month first where both numbers could be one
    "date_spellings": f"""WITH {ORDER_DATES}, s AS (
          SELECT o_orderkey, (o_orderkey % 40)::INT AS kind,
            CASE WHEN o_orderkey % 40 >= 36 THEN NULL
              WHEN o_orderkey % 40 IN (14, 15) AND day(day) <= 12 THEN make_date(year(day), day(day), month(day))
              ELSE day END AS own
          FROM d)
        SELECT o_orderkey, kind, {shown("own")} AS own_day,
          {shown("""CAST(epoch(own) AS BIGINT) * 1000000 + CASE kind WHEN 5 THEN 36900 WHEN 6 THEN 36900 + 12600 WHEN 7 THEN 43200
            WHEN 12 THEN 86340 WHEN 17 THEN 81000 WHEN 18 THEN 81000 WHEN 22 THEN 37815 WHEN 23 THEN 3900
            WHEN 24 THEN 84600 + 25200 WHEN 25 THEN 37800 WHEN 26 THEN 37800 WHEN 27 THEN 37800 + 28800 WHEN 28 THEN 79200
            WHEN 29 THEN 37800 WHEN 30 THEN 81015 WHEN 31 THEN 37800 WHEN 32 THEN 37800 WHEN 33 THEN 37800
            WHEN 34 THEN 46923 - 19800 WHEN 35 THEN 37800 + 10800 ELSE 0 END::BIGINT * 1000000
            + CASE kind WHEN 31 THEN 123000 WHEN 32 THEN 123456 ELSE 0 END""")} AS micros
        FROM s""",
    "coalesce_fallback": """SELECT conv_id, turn,
          CASE WHEN turn % 3 < 2 OR text = '' THEN role ELSE text END AS chosen FROM conversations""",
    "title_if_differs": f"""SELECT doc_id,
          {shown("CASE WHEN doc_id % 3 <> 0 AND source <> text THEN source END")} AS title FROM documents""",
    "sentiment_label": f"""WITH s AS (
          SELECT event_id, CASE WHEN event_type = 'signup' THEN 'NaN'::DOUBLE
            ELSE round((value - 100.0) / 100.0, 2) END AS s FROM events)
        SELECT event_id, {LABEL.format("s")} AS sentiment_label FROM s""",
    "output_name": """SELECT c_custkey, concat_ws('_', lower(replace(c_name, '#', '_')),
          CASE c_custkey % 3 WHEN 1 THEN 'app_store' WHEN 2 THEN 'google_play' END, 'reviews',
          CASE WHEN c_custkey % 2 = 0 THEN 'analysis' END) AS output_name FROM customer""",
    "lexicon_score": _LEX_DOCS,
    "lexicon_score_join": _LEX_DOCS,
    "lexicon_score_spread": _LEX_DOCS,
    "lexicon_phrases": f"""WITH RECURSIVE {scored_with_phrases("documents", "doc_id", "text")}
        SELECT d.doc_id, coalesce(o.n, 0)::INT AS n_found, coalesce(p.spans, '') AS spans,
          coalesce(s.sentiment_score, 0.0) AS sentiment_score
        FROM documents d LEFT JOIN scores s USING (doc_id)
        LEFT JOIN (SELECT k, count(*) AS n FROM occ GROUP BY k) o ON o.k = d.doc_id
        LEFT JOIN (SELECT k, string_agg(s || ':' || m, ',' ORDER BY s) AS spans FROM kept GROUP BY k) p ON p.k = d.doc_id""",
    "analyze_reviews": f"""WITH {RATED}, {scored("rated", "seq", "review_text")}
        SELECT seq, platform, star_rating, sentiment_score, {LABEL.format("sentiment_score")} AS sentiment_label
        FROM (SELECT rated.*, coalesce(scores.sentiment_score, 0.0) AS sentiment_score
              FROM rated JOIN scores USING (seq))""",
    "stream_dedup": f"""WITH {APPLE}
        SELECT DISTINCT 'App Store' AS platform, app_id, CAST(day AS VARCHAR) AS review_date, star_rating,
          {hash16("review_text")} AS text_hash
        FROM apple WHERE review_epoch >= epoch({CUTOFF})""",
    "output_layout": f"""WITH {_FULL_RUN},
        named AS (SELECT kept.*, app_name, CASE platform WHEN 'App Store' THEN 'app_store' ELSE 'google_play' END AS pkey
                  FROM kept JOIN checked USING (app_id))
        SELECT 'both' AS mode, app_name || '_' || pkey || '_reviews' || tail AS output_name, count(*) AS n_rows
        FROM named, (VALUES (''), ('_analysis')) AS t(tail) GROUP BY ALL
        UNION ALL SELECT 'reviews', app_name || '_reviews', count(*) FROM named GROUP BY ALL""",
    "run_metrics": f"""WITH {_RUN_TOTALS}
        SELECT app_id, status, {CODE.format("status")} AS exit_code, total_reviews,
          CASE WHEN total_reviews > 0 THEN 2 ELSE 0 END AS n_files,
          (SELECT count(*) FROM kept) AS run_reviews_rows, (SELECT count(*) FROM kept) AS run_analysis_rows,
          true AS times_ok FROM s""",
    "rerun_output": f"""WITH {_RUN_TOTALS}
        SELECT run_id, app_id, status, total_reviews, 1::BIGINT AS n_rows
        FROM s, (VALUES ('first'), ('second')) AS r(run_id)""",
    "throughput": f"""WITH {CLEAN}
        SELECT app_id, count(*) AS total,
          coalesce(round(count(*) / nullif(CAST(substr(app_id, 5) AS INT) % 4 * 2.5::DOUBLE, 0), 6), -1.0) AS per_second
        FROM clean GROUP BY app_id""",
    "scorer_fallback": f"SELECT doc_id, sentiment_score, 'lexicon' AS backend FROM ({_LEX_DOCS})",
}
# Whatever order the files land in, the incremental jobs end where the batch ones do.
ORACLE["stream_first_seen"] = ORACLE["dedup_first_seen"]
ORACLE["stream_page_walk"] = ORACLE["page_walk"]
ORACLE["pruned_collect"] = ORACLE["collect_app_store"]
ORACLE["landed_pages"] = """WITH docs AS (
    SELECT doc_id, 'app-' || (doc_id // 60) AS app_id, lang AS country, (doc_id % 60) // 10 + 1 AS page FROM documents),
  files AS (
    SELECT app_id, country, page, count(*) AS n, (doc_app + page * 3 + length(country)) % 7 AS kind
    FROM (SELECT *, doc_id // 60 AS doc_app FROM docs) GROUP BY app_id, country, page, doc_app)
  SELECT app_id, country, count(*) AS n_files, count(*) FILTER (kind = 1) AS n_bad_path, count(*) FILTER (kind = 2) AS n_empty,
    count(*) FILTER (kind = 3) AS n_not_json, count(*) FILTER (kind = 4) AS n_no_feed,
    count(*) FILTER (kind IN (0, 5, 6)) AS n_ok, count(*) FILTER (kind = 5) AS n_unknown,
    coalesce(sum(n) FILTER (kind IN (0, 5, 6)), 0)::BIGINT AS n_entries
  FROM files GROUP BY app_id, country"""
