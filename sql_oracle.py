"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each SQL string runs on DuckDB views named after the driver tables.  The
text logic is written independently in SQL: RE2 regexes with explicit letter
classes, list lambdas, window functions.  Constants come from the library's
fixed-value modules so both sides use the same word lists.
"""

from __future__ import annotations

from cxpulse.functions.lexicon import CLEAN_LETTERS, DEFAULT_LEXICON, DEFAULT_STOPWORDS, NEGATIVE_THRESHOLD
from cxpulse.plans.catalog import (AMBIGUOUS_QUERY_SAMPLE, EXAMPLES_PER_TERM, INSULT_LEXICON, SOURCE_COUNTERS, TOPIC_MIN_RECENT,
                                   TOPIC_QUERY_SAMPLE, WINDOW_COUNTERS, WINDOW_DAYS)
from cxpulse.sources.fixtures import (EMERGING_CONVERSATIONS, EMERGING_FROM, NEGATIVE_CONVERSATIONS,
                                      NORMAL_CONVERSATIONS, SPIKE_DAY)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def tup(items) -> str:
    return "(" + ", ".join(lit(x) for x in items) + ")"


def nested(templates) -> str:
    return "[" + ", ".join(lst(t) for t in templates) + "]"


STOP = tup(DEFAULT_STOPWORDS)


def clean_sql(x: str) -> str:
    return ("trim(regexp_replace(regexp_replace(regexp_replace(lower(" + x + r"), 'http\S+', '', 'g'), "
            "'[^" + CLEAN_LETTERS + r"\s''-]', ' ', 'g'), '\s+', ' ', 'g'))")


def strip_ws(x: str) -> str:
    return "regexp_replace(" + x + r", '^\s+|\s+$', '', 'g')"


def runs_sql(c: str) -> str:
    return f"string_split(translate({c}, '''-', '  '), ' ')"


def score_sql(c: str, lexicon=DEFAULT_LEXICON) -> str:
    uni = f"len(list_filter({runs_sql(c)}, lambda t: t IN {tup(lexicon.words)}))"
    big = " + ".join(f"((length({c}) - length(replace({c}, {lit(b)}, ''))) // {len(b)})"
                     for b in lexicon.bigrams) or "0"
    toks = f"len(string_split({c}, ' '))"
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE least(1.0::DOUBLE, CAST(({uni}) + ({big}) AS DOUBLE) "
            f"/ CAST(greatest({toks}, 1) AS DOUBLE)) END")


def with_(ctes: list[tuple[str, str]], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS (\n{s}\n)" for n, s in ctes) + "\n" + body


K = "CAST(floor(event_id / 4) AS INTEGER)"
FIXTURE = f"""
SELECT CAST(ts AS DATE) AS date, printf('conv_%06d', event_id) AS conversation_id,
  CASE WHEN CAST(ts AS DATE) >= DATE '{EMERGING_FROM}' AND event_id % 4 = 0 THEN {nested(EMERGING_CONVERSATIONS)}[{K} % 3 + 1]
       WHEN event_id % 4 = 1 OR (CAST(ts AS DATE) = DATE '{SPIKE_DAY}' AND event_id % 2 = 0) THEN {nested(NEGATIVE_CONVERSATIONS)}[{K} % 10 + 1]
       ELSE {nested(NORMAL_CONVERSATIONS)}[{K} % 7 + 1] END AS verbatims
FROM events"""

PREPARED = f"""
SELECT * FROM (
  SELECT date, conversation_id, array_to_string(verbatims, '. ') AS verbatim,
         CAST(len(verbatims) AS INTEGER) AS n_messages,
         {clean_sql("array_to_string(verbatims, '. ')")} AS clean
  FROM fixture) WHERE length(clean) > 2 AND date IS NOT NULL"""

SCORED = f"""
SELECT *, {score_sql('clean')} AS neg_score, {score_sql('clean')} > {NEGATIVE_THRESHOLD} AS is_negative FROM prepared"""

BASE = [("fixture", FIXTURE), ("prepared", PREPARED), ("scored", SCORED)]

DAILY = """
SELECT date, CAST(count(*) AS BIGINT) AS total_conversations, CAST(count_if(is_negative) AS BIGINT) AS negative_count,
       avg(neg_score) AS mean_neg_score,
       CAST(count_if(is_negative) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS negative_ratio
FROM scored GROUP BY date"""


def rolling_sql(src: str, x: str, suffix: str = "", z: float = 2.0) -> str:
    w = "(ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
    return f"""
SELECT *, (({x}) - rolling_mean{suffix}) / CASE WHEN rolling_std{suffix} IS NULL THEN NULL
          ELSE greatest(rolling_std{suffix}, 1e-9) END AS z_score{suffix}
FROM (SELECT *, CASE WHEN count({x}) OVER {w} >= 7 THEN avg({x}) OVER {w} END AS rolling_mean{suffix},
             CASE WHEN count({x}) OVER {w} >= 7 THEN stddev_samp({x}) OVER {w} END AS rolling_std{suffix}
      FROM {src})"""


def spikes_sql(src: str, suffix: str = "", z: float = 2.0) -> str:
    return f"SELECT *, z_score{suffix} > {z} AS is_spike{suffix} FROM ({src})"


DAILY_SPIKES = spikes_sql(rolling_sql("daily", "negative_ratio"))


def r6(cols: list[str], src: str, order: str = "date") -> str:
    sel = ", ".join(f"round({c}, 6) AS {c}" if c.startswith(("mean_", "negative_ratio", "rolling_", "z_score", "error_ratio"))
                    else c for c in cols)
    return f"SELECT {sel} FROM {src} ORDER BY {order}"


DAILY_COLS = ["date", "total_conversations", "negative_count", "mean_neg_score", "negative_ratio",
              "rolling_mean", "rolling_std", "z_score", "is_spike"]

TERMS = f"""
SELECT date, term, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT date, unnest(list_distinct(list_filter(string_split(clean, ' '),
         lambda t: length(t) >= 3 AND NOT (t IN {STOP})))) AS term FROM prepared)
GROUP BY date, term"""


def trending_sql(window: int = 7, factor: float = 3.0, top: int = 20) -> str:
    return f"""
SELECT term, round(cur, 2) AS current_avg_daily, round(base, 2) AS baseline_avg_daily, round(growth, 2) AS growth_ratio
FROM (
  SELECT term, cur, base, CASE WHEN base > 0.5 THEN cur / base ELSE cur * 10 END AS growth FROM (
    SELECT term, CAST(r AS DOUBLE) / {window}.0::DOUBLE AS cur, coalesce(CAST(b AS DOUBLE) / 30.0::DOUBLE, 0.0) AS base FROM (
      SELECT term, sum(CASE WHEN date >= mx - {window} THEN count END) AS r,
             sum(CASE WHEN date >= mx - {window + 30} AND date < mx - {window} THEN count END) AS b
      FROM term_counts, (SELECT max(date) AS mx FROM term_counts)
      WHERE date >= mx - {window + 30} GROUP BY term)
    WHERE r IS NOT NULL))
WHERE growth >= {factor} AND cur >= 2
ORDER BY growth DESC, term ASC LIMIT {top}"""


def novel_sql(recent_days: int = 7, min_count: int = 20, top: int = 20) -> str:
    return f"""
SELECT term, CAST(recent_count AS BIGINT) AS recent_count,
       round(CAST(recent_count AS DOUBLE) / {recent_days}.0::DOUBLE, 2) AS recent_daily_avg,
       CAST(history_total AS BIGINT) AS history_total, round(hist_daily, 2) AS history_daily_avg,
       CASE WHEN history_total = 0 THEN 'nouveau' ELSE 'quasi_nouveau' END AS novelty
FROM (
  SELECT *, CASE WHEN history_total = 0 THEN 0.0::DOUBLE ELSE CAST(history_total AS DOUBLE) / CAST(hd AS DOUBLE) END AS hist_daily
  FROM (
    SELECT term, sum(CASE WHEN date >= cutoff THEN count ELSE 0 END) AS recent_count,
           sum(CASE WHEN date < cutoff THEN count ELSE 0 END) AS history_total, any_value(hd) AS hd
    FROM term_counts, (SELECT mx - {recent_days} AS cutoff,
                              CASE WHEN (mx - {recent_days}) - mn = 0 THEN 1 ELSE (mx - {recent_days}) - mn END AS hd
                       FROM (SELECT min(date) AS mn, max(date) AS mx FROM prepared))
    GROUP BY term))
WHERE recent_count >= {min_count} AND hist_daily < 1.0
ORDER BY recent_count DESC, term ASC LIMIT {top}"""


TERM_BASE = BASE + [("term_counts", TERMS)]
SPIKE_BASE = BASE + [("daily", DAILY), ("spikes", DAILY_SPIKES),
                     ("neg", "SELECT * FROM scored WHERE is_negative AND date IN (SELECT date FROM spikes WHERE is_spike)")]

SPIKE_TOP = f"""
SELECT date, CAST(rank AS INTEGER) AS rank, term, count FROM (
  SELECT date, term, count, row_number() OVER (PARTITION BY date ORDER BY count DESC, term ASC) AS rank FROM (
    SELECT date, term, CAST(count(*) AS BIGINT) AS count FROM (
      SELECT date, unnest(list_filter(string_split(clean, ' '), lambda t: length(t) >= 3 AND NOT (t IN {STOP}))) AS term FROM neg)
    GROUP BY date, term))
WHERE rank <= 10"""

SPIKE_SAMPLES = """
SELECT date, CAST(rank AS INTEGER) AS rank, conversation_id, verbatim FROM (
  SELECT date, conversation_id, verbatim,
         row_number() OVER (PARTITION BY date ORDER BY conversation_id ASC, verbatim ASC) AS rank FROM neg)
WHERE rank <= 5"""

TERM_EXAMPLES = f"""
SELECT t.term, t.current_avg_daily, t.baseline_avg_daily, t.growth_ratio, CAST(e.rn AS INTEGER) AS rn,
       e.date, e.conversation_id, e.verbatim
FROM trending t LEFT JOIN (
  SELECT * FROM (
    SELECT t2.term, p.date, p.conversation_id, p.verbatim,
           row_number() OVER (PARTITION BY t2.term ORDER BY p.date DESC, p.conversation_id ASC) AS rn
    FROM prepared p JOIN trending t2 ON (
      CASE WHEN regexp_full_match(t2.term, '[^ ''-]+') THEN list_contains({runs_sql('p.clean')}, t2.term)
           ELSE regexp_matches(p.clean, '(^|[ ''-])' || t2.term || '($|[ ''-])') END))
  WHERE rn <= {EXAMPLES_PER_TERM}) e ON e.term = t.term"""


def topic_sample_ctes(sample_size: int, recent_days: int = 14, min_recent: int = TOPIC_MIN_RECENT):
    seg = f"""
SELECT conversation_id, date, clean, date >= mx - {recent_days} AS is_recent
FROM prepared, (SELECT max(date) AS mx FROM prepared)"""
    sizes = f"""
SELECT nr, nh, least(nr, {sample_size} - s_h) AS s_r, s_h FROM (
  SELECT nr, nh, least({sample_size} - least(rr, nr, {sample_size}), nh) AS s_h FROM (
    SELECT nr, nh, greatest(CAST(trunc({sample_size} * (CAST(nr AS DOUBLE) / CAST(nr + nh AS DOUBLE))) AS BIGINT), {min_recent}) AS rr
    FROM (SELECT count_if(is_recent) AS nr, count_if(NOT is_recent) AS nh FROM seg)))"""
    sample = """
SELECT conversation_id, date, clean, is_recent, sample_rank FROM (
  SELECT s.*, row_number() OVER (PARTITION BY is_recent ORDER BY md5(concat_ws('|', '42', conversation_id)), conversation_id) AS sample_rank,
         CASE WHEN is_recent THEN z.s_r ELSE z.s_h END AS lim
  FROM seg s, sizes z)
WHERE sample_rank <= lim"""
    return [("seg", seg), ("sizes", sizes), ("sample", sample)]


def vocab_sql(src: str) -> str:
    return f"""
SELECT term, CAST(doc_freq AS BIGINT) AS doc_freq, CAST(term_freq AS BIGINT) AS term_freq FROM (
  SELECT term, count(*) AS doc_freq, sum(tf) AS term_freq FROM (
    SELECT conversation_id, term, count(*) AS tf FROM (
      SELECT conversation_id, unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))) AS term
      FROM (SELECT conversation_id, list_filter({runs_sql('clean')}, lambda t: length(t) >= 2 AND NOT (t IN {STOP})) AS tk FROM {src}))
    GROUP BY conversation_id, term)
  GROUP BY term)
WHERE doc_freq >= 10 AND doc_freq <= 0.8 * (SELECT count(*) FROM {src})
ORDER BY term_freq DESC, term ASC LIMIT 3000"""

AMBIGUOUS = "SELECT * FROM scored WHERE neg_score > 0.01 AND neg_score <= 0.3"


def amb_sample_sql(n: int) -> str:
    return f"""
SELECT * FROM (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', conversation_id)), conversation_id) AS sample_rank FROM ambiguous)
WHERE sample_rank <= {n}"""


RECOVERY = """
SELECT CAST((SELECT count(*) FROM ambiguous) AS BIGINT) AS n_ambiguous_total, CAST(count(*) AS BIGINT) AS n_sampled,
       CAST(count_if(1.0 - (stars - 1) / 4.0 > 0.6) AS BIGINT) AS n_recovered,
       coalesce(CAST(count_if(1.0 - (stars - 1) / 4.0 > 0.6) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 0.0) AS recovery_rate
FROM (SELECT 1 + length(clean) % 5 AS stars FROM ambiguous)"""

REFINE_BASE = BASE + [("daily", DAILY), ("spikes", DAILY_SPIKES), ("ambiguous", AMBIGUOUS),
                      ("recovery", RECOVERY)]

CORRECTED = spikes_sql(rolling_sql("""(
  SELECT *, CAST(negative_count_corrected AS DOUBLE) / CAST(total_conversations AS DOUBLE) AS negative_ratio_corrected FROM (
    SELECT s.*, CAST(coalesce(a.n, 0) AS BIGINT) AS ambiguous_count,
           CAST(s.negative_count + CAST(round(coalesce(a.n, 0) * r.recovery_rate, 0) AS BIGINT) AS BIGINT) AS negative_count_corrected
    FROM spikes s LEFT JOIN (SELECT date, count(*) AS n FROM ambiguous GROUP BY date) a ON a.date = s.date, recovery r))""",
                                   "negative_ratio_corrected", "_corrected"), "_corrected")

CORRECTED_COLS = DAILY_COLS + ["ambiguous_count", "negative_count_corrected", "negative_ratio_corrected",
                               "rolling_mean_corrected", "rolling_std_corrected", "z_score_corrected",
                               "is_spike_corrected"]

REPORT_BASE = TERM_BASE + [("daily", DAILY), ("spikes", DAILY_SPIKES), ("trending", trending_sql()), ("novel", novel_sql())]

SUMMARY = """
SELECT 'period' AS metric, CAST(min(date) AS VARCHAR) || ' -> ' || CAST(max(date) AS VARCHAR) AS value FROM prepared
UNION ALL SELECT 'total_conversations', CAST(count(*) AS VARCHAR) FROM prepared
UNION ALL SELECT 'negative_conversations', CAST(count_if(is_negative) AS VARCHAR) FROM scored
UNION ALL SELECT 'negative_share_pct', printf('%.2f', round(100.0::DOUBLE * count_if(is_negative) / count(*), 2)) FROM scored
UNION ALL SELECT 'negative_spikes', CAST(count_if(coalesce(is_spike, false)) AS VARCHAR) FROM spikes
UNION ALL SELECT 'trending_terms', CAST(count(*) AS VARCHAR) FROM trending
UNION ALL SELECT 'novel_terms', CAST(count(*) AS VARCHAR) FROM novel"""

REPORT_SUMMARY = SUMMARY.replace("count_if(coalesce(is_spike, false)) AS VARCHAR) FROM spikes",
                                 "count_if(coalesce(is_spike_corrected, false)) AS VARCHAR) FROM corrected") + """
UNION ALL SELECT 'negative_conversations_corrected', CAST(CAST(sum(negative_count_corrected) AS BIGINT) AS VARCHAR) FROM corrected
UNION ALL SELECT 'negative_share_corrected_pct', printf('%.2f', round(100.0::DOUBLE * sum(negative_count_corrected) / sum(total_conversations), 2)) FROM corrected
UNION ALL SELECT 'negative_spikes_uncorrected', CAST(count_if(coalesce(is_spike, false)) AS VARCHAR) FROM corrected"""

REFINE_TOTALS = """
SELECT r.*, c.* FROM recovery r, (
  SELECT CAST(sum(negative_count) AS BIGINT) AS negatives_before, CAST(sum(negative_count_corrected) AS BIGINT) AS negatives_after,
         CAST(count_if(coalesce(is_spike, false)) AS BIGINT) AS spikes_before,
         CAST(count_if(coalesce(is_spike_corrected, false)) AS BIGINT) AS spikes_after
  FROM corrected) c"""


def details_sql(days: str) -> str:
    """Top terms and samples of the dates in the table ``days``, lists as text."""
    return f"""
SELECT d.date, coalesce(t.top_negative_terms, '') AS top_negative_terms, coalesce(v.sample_verbatims, '') AS sample_verbatims
FROM {days} d
LEFT JOIN (SELECT date, string_agg(term || '=' || CAST(count AS VARCHAR), ', ' ORDER BY rank) AS top_negative_terms
           FROM ({SPIKE_TOP}) GROUP BY date) t ON t.date = d.date
LEFT JOIN (SELECT date, string_agg(verbatim, ' | ' ORDER BY rank) AS sample_verbatims
           FROM ({SPIKE_SAMPLES}) GROUP BY date) v ON v.date = d.date"""


TOPIC_EMERGENCE = """
SELECT CAST(k AS INTEGER) AS topic_id, round(r, 4) AS recent_weight, round(h, 4) AS history_weight,
       round(CASE WHEN h > 0.001 THEN r / h ELSE r * 100 END, 2) AS emergence_ratio,
       round(CASE WHEN h > 0.001 THEN r / h ELSE r * 100 END, 2) > 1.5 AS is_emerging
FROM (SELECT k, coalesce(avg(w / t) FILTER (recent), 0.0) AS r, coalesce(avg(w / t) FILTER (NOT recent), 0.0) AS h
      FROM (SELECT event_id, k, recent, w, sum(w) OVER (PARTITION BY event_id) AS t
            FROM (SELECT event_id, k, d >= mx - 14 AS recent,
                         CAST((event_id * (k + 3)) % 7 + 1 + CASE WHEN d >= mx - 14 THEN k * k ELSE 0 END AS DOUBLE) AS w
                  FROM (SELECT event_id, CAST(ts AS DATE) AS d FROM events), (SELECT max(CAST(ts AS DATE)) AS mx FROM events),
                       (SELECT unnest(range(5)) AS k)))
      GROUP BY k)"""

# no such text is one list: its brackets go and it is cut at quote-comma-quote
JSON_BROKEN_ALL = rf"""
SELECT conv_id, turn, CAST(len(m) AS INTEGER) AS n_messages, array_to_string(m, ' | ') AS joined FROM (
  SELECT conv_id, turn, list_filter(list_transform(
           string_split_regex(substr(raw, 2, length(raw) - 2), '[''"],[ \t\n\x0B\f\r]*[''"]'),
           lambda s: trim({strip_ws('s')}, '''"')), lambda s: length(s) > 0) AS m
  FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN one || ', ' || one
                                   ELSE '[''' || t || ''' x ''b'']' END AS raw
        FROM (SELECT conv_id, turn, coalesce(text, '') AS t, CAST(to_json([coalesce(text, '')]) AS VARCHAR) AS one
              FROM conversations)))"""

# what was rendered is what must come back
LITERAL = """
SELECT conversation_id, CAST(len(msgs) AS INTEGER) AS n_messages, array_to_string(msgs, '. ') AS verbatim FROM turns"""

LITERAL_HARD = r"""
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END::INTEGER AS n_messages,
       CASE turn % 5 WHEN 0 THEN 'None | ' || t || ' | [''x'', 1.5] | -2' WHEN 1 THEN t || ' | (''p'',)'
                     WHEN 3 THEN t || ' | None' ELSE t END AS joined
FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)"""

TURN_SCORES = f"""
SELECT id, {score_sql('clean')} AS neg_score, {score_sql('clean')} > {NEGATIVE_THRESHOLD} AS is_negative
FROM (SELECT concat_ws('-', conv_id, turn) AS id, {clean_sql('text')} AS clean FROM conversations) WHERE length(clean) > 2"""

DOC_TERMS = f"""
SELECT source, term, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT source, unnest(list_distinct(list_filter(string_split({clean_sql('text')}, ' '),
         lambda t: length(t) >= 3 AND NOT (t IN {STOP})))) AS term FROM documents)
GROUP BY source, term"""

# documents are cut into letter runs and single separators; a term that starts and ends with a letter is a row of these
PHRASE_PARTS = "'[^ ''-]+|[ ''-]'"
DOC_PHRASES = f"""
WITH words AS (SELECT string_split({clean_sql('text')}, ' ') AS w FROM benchmark WHERE text IS NOT NULL),
terms AS (
  SELECT term, len(regexp_extract_all(term, {PHRASE_PARTS})) AS k FROM (
    SELECT DISTINCT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words)
  WHERE regexp_full_match(term, '[^ ''-](.*[^ ''-])?')),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({clean_sql('text')}, {PHRASE_PARTS}) AS x FROM documents),
windows AS (
  SELECT DISTINCT r, doc_id, k, unnest(list_transform(range(1, len(x) - k + 2), lambda i: array_to_string(x[i:i + k - 1], ''))) AS term
  FROM docs, (SELECT DISTINCT k FROM terms))
SELECT term, CAST(count(*) AS BIGINT) AS n_docs, min(doc_id) AS first_id FROM windows JOIN terms USING (term, k) GROUP BY term"""

NOVEL_EXAMPLES = (TERM_EXAMPLES.replace("trending", "novel").replace("ORDER BY p.date DESC, p.conversation_id ASC", "ORDER BY p.conversation_id ASC")
                  .replace("t.current_avg_daily, t.baseline_avg_daily, t.growth_ratio",
                           "t.recent_count, t.recent_daily_avg, t.history_total, t.history_daily_avg, t.novelty"))

TURN_LISTS = ("SELECT CAST(conv_id AS VARCHAR) AS conversation_id, "
              "list(text ORDER BY turn) FILTER (WHERE text IS NOT NULL) AS msgs FROM conversations GROUP BY conv_id")


def py_repr_item(x: str) -> str:
    esc = f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return (f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END")


PARSE_SPLIT = f"""
SELECT conversation_id, CAST(len(m) AS INTEGER) AS n_messages, array_to_string(m, '. ') AS verbatim FROM (
  SELECT conversation_id,
         list_filter(list_transform(string_split({strip_ws(f"trim({strip_ws('raw')}, '[]')")}, ', '),
                                    lambda s: {strip_ws(f"trim({strip_ws('s')}, '''\"')")}),
                     lambda s: length(s) > 0) AS m
  FROM (SELECT conversation_id, '[' || array_to_string(list_transform(msgs, lambda x: {py_repr_item('x')}), ', ') || ']' AS raw
        FROM turns))"""

MESSAGE_ROWS = ("SELECT conversation_id, unnest(range(0, len(m)))::INTEGER AS pos, unnest(m) AS message FROM ("
                + PARSE_SPLIT.split("FROM (", 1)[1])

ROW_COUNTS = f"""
SELECT count(*) AS n_rows, count_if(day IS NULL) AS null_date, count_if(day IS NOT NULL AND d IS NULL) AS bad_date,
       count_if(d IS NOT NULL AND NOT long) AS short_text, count_if(d IS NOT NULL AND long) AS n_kept,
       min(d) FILTER (WHERE long) AS min_date, max(d) FILTER (WHERE long) AS max_date
FROM (SELECT *, try_cast(day AS DATE) AS d FROM (
  SELECT coalesce(length({clean_sql('text')}) > 2, false) AS long,
         CASE WHEN turn % 3 = 2 THEN NULL WHEN role = 'user' THEN strftime(DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER), '%Y-%m-%d')
              ELSE 'no day' END AS day FROM conversations))"""

PARSE_JSON = """
SELECT conversation_id, CAST(len(m) AS INTEGER) AS n_messages, array_to_string(m, '. ') AS verbatim FROM (
  SELECT conversation_id, from_json(to_json(msgs), '["VARCHAR"]') AS m FROM turns)"""

CONV_VERBATIMS = f"""
SELECT * FROM (
  SELECT conversation_id, CAST(len(msgs) AS INTEGER) AS n_messages, array_to_string(msgs, '. ') AS verbatim,
         {clean_sql("array_to_string(msgs, '. ')")} AS clean FROM turns)
WHERE length(clean) > 2"""

DOC_CLEAN = f"SELECT * FROM (SELECT doc_id, {clean_sql('text')} AS clean FROM documents) WHERE length(clean) > 2"

DOC_INSULT = f"""
SELECT d.doc_id, l.toxic, d.neg_score, d.is_negative FROM (
  SELECT doc_id, {score_sql('clean', INSULT_LEXICON)} AS neg_score,
         {score_sql('clean', INSULT_LEXICON)} > {INSULT_LEXICON.threshold} AS is_negative FROM docs) d
LEFT JOIN labels l ON l.doc_id = d.doc_id"""

EVENT_ERRORS = """
SELECT CAST(ts AS DATE) AS date, CAST(count(*) AS BIGINT) AS total_events,
       CAST(count_if(event_type = 'error') AS BIGINT) AS error_events,
       CAST(count_if(event_type = 'error') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS error_ratio
FROM events GROUP BY CAST(ts AS DATE)"""
EVENT_COLS = ["date", "total_events", "error_events", "error_ratio", "rolling_mean", "rolling_std", "z_score", "is_spike"]


WINDOW_HEAVY = f"""
SELECT date, term, count, total FROM (
  SELECT CAST(e.date AS DATE) AS date, t.term, CAST(sum(t.count) AS BIGINT) AS count,
         CAST(sum(sum(t.count)) OVER (PARTITION BY e.date) AS BIGINT) AS total
  FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS date FROM term_counts) e
  JOIN term_counts t ON t.date BETWEEN CAST(e.date AS DATE) - {WINDOW_DAYS - 1} AND CAST(e.date AS DATE)
  GROUP BY e.date, t.term)
WHERE count * {WINDOW_COUNTERS + 1} > total
"""

SOURCE_HEAVY = f"""
SELECT source, term, count, total FROM (
  SELECT source, term, CAST(count(*) AS BIGINT) AS count, CAST(sum(count(*)) OVER (PARTITION BY source) AS BIGINT) AS total
  FROM (SELECT source, unnest(list_filter(string_split({clean_sql('text')}, ' '),
               lambda t: length(t) >= 3 AND NOT (t IN {STOP}))) AS term FROM documents)
  GROUP BY source, term)
WHERE count * {SOURCE_COUNTERS + 1} > total
"""

INCREMENTAL = """
SELECT date, CAST(NULL AS VARCHAR) AS term, CAST(count(*) AS BIGINT) AS count,
       CAST(count(*) FILTER (WHERE is_negative) AS BIGINT) AS negative_count FROM scored GROUP BY date
UNION ALL SELECT date, term, count, NULL FROM term_counts
"""

CSV_TURNS = """
SELECT conv_id, CASE WHEN conv_id % 7 = 3 THEN NULL ELSE turn END AS turn,
       concat_ws(chr(10), role, text, '"x", y') AS text, conv_id % 7 = 3 AS bad
FROM conversations
"""


def oracle_sql() -> dict[str, str]:
    ts = topic_sample_ctes(TOPIC_QUERY_SAMPLE)
    return {
        "clean_documents": DOC_CLEAN,
        "parse_split": with_([("turns", TURN_LISTS)], PARSE_SPLIT),
        "parse_json": with_([("turns", TURN_LISTS)], PARSE_JSON),
        "conversation_verbatims": with_([("turns", TURN_LISTS)], CONV_VERBATIMS),
        "date_bounds": with_(BASE[:2], "SELECT min(date) AS min_date, max(date) AS max_date, "
                                       "CAST(count(*) AS BIGINT) AS n_rows FROM prepared"),
        "sentiment_scores": with_(BASE, "SELECT date, conversation_id, n_messages, neg_score, is_negative FROM scored"),
        "document_insult_scores": with_([("docs", DOC_CLEAN)], DOC_INSULT),
        "daily_sentiment": with_(BASE + [("daily", DAILY)],
                                 r6(["date", "total_conversations", "negative_count", "mean_neg_score", "negative_ratio"], "daily")),
        "daily_spikes": with_(BASE + [("daily", DAILY), ("spikes", DAILY_SPIKES)], r6(DAILY_COLS, "spikes")),
        "event_error_spikes": with_([("daily", EVENT_ERRORS), ("spikes", spikes_sql(rolling_sql("daily", "error_ratio")))],
                                    r6(EVENT_COLS, "spikes")),
        "spike_top_terms": with_(SPIKE_BASE, SPIKE_TOP),
        "spike_samples": with_(SPIKE_BASE, SPIKE_SAMPLES),
        "term_daily_counts": with_(TERM_BASE, "SELECT * FROM term_counts"),
        "trending_terms": with_(TERM_BASE, trending_sql()),
        "novel_terms": with_(TERM_BASE, novel_sql()),
        "term_examples": with_(TERM_BASE + [("trending", trending_sql())], TERM_EXAMPLES),
        "topic_sample_plan": with_(BASE[:2] + ts[:2],
                                   "SELECT true AS is_recent, CAST(nr AS BIGINT) AS n_total, CAST(s_r AS BIGINT) AS n_sample FROM sizes "
                                   "UNION ALL SELECT false, CAST(nh AS BIGINT), CAST(s_h AS BIGINT) FROM sizes"),
        "topic_sample": with_(BASE[:2] + ts, "SELECT conversation_id, is_recent, CAST(sample_rank AS INTEGER) AS sample_rank FROM sample"),
        "topic_vocabulary": with_(BASE[:2], vocab_sql("prepared")),
        "topic_emergence": TOPIC_EMERGENCE,
        "document_vocabulary": with_([("docs", DOC_CLEAN.replace("SELECT doc_id,", "SELECT doc_id AS conversation_id,", 1))], vocab_sql("docs")),
        "document_all_term_counts": DOC_TERMS,
        "document_phrase_counts": DOC_PHRASES,
        "turn_scores": TURN_SCORES,
        "csv_turns": CSV_TURNS,
        "incremental_counts": with_(TERM_BASE, INCREMENTAL),
        "composed_documents": DOC_CLEAN,
        "window_heavy_terms": with_(TERM_BASE, WINDOW_HEAVY),
        "source_heavy_terms": SOURCE_HEAVY,
        "sql_turn_scores": TURN_SCORES,
        "sql_message_rows": with_([("turns", TURN_LISTS)], MESSAGE_ROWS),
        "prepared_row_counts": ROW_COUNTS,
        "parse_literal": with_([("turns", TURN_LISTS)], LITERAL),
        "parse_literal_hard": LITERAL_HARD,
        "prepared_literal": with_([("turns", TURN_LISTS)], CONV_VERBATIMS.replace("n_messages, verbatim, clean", "n_messages, clean").replace(
            "SELECT *", "SELECT conversation_id, n_messages, clean", 1)),
        "parse_json_broken_all": JSON_BROKEN_ALL,
        "prepared_split": with_([("turns", TURN_LISTS), ("parsed", PARSE_SPLIT)],
                                f"SELECT * FROM (SELECT conversation_id, n_messages, {clean_sql('verbatim')} AS clean FROM parsed) "
                                "WHERE length(clean) > 2"),
        "prepared_json": with_([("turns", TURN_LISTS), ("parsed", PARSE_JSON)],
                               f"SELECT * FROM (SELECT conversation_id, n_messages, {clean_sql('verbatim')} AS clean FROM parsed) "
                               "WHERE length(clean) > 2"),
        "spike_details": with_(SPIKE_BASE + [("days", "SELECT date FROM spikes WHERE is_spike")], details_sql("days")),
        "combined_daily": with_(BASE + [("daily", DAILY), ("spikes", DAILY_SPIKES)], r6(DAILY_COLS, "spikes")),
        "combined_term_counts": with_(TERM_BASE, "SELECT * FROM term_counts"),
        "novel_examples": with_(TERM_BASE + [("novel", novel_sql())], NOVEL_EXAMPLES),
        "refine_totals": with_(REFINE_BASE + [("corrected", CORRECTED)], REFINE_TOTALS),
        "report_daily": with_(REFINE_BASE + [("corrected", CORRECTED)], r6(CORRECTED_COLS, "corrected")),
        "report_summary": with_(REPORT_BASE + [("ambiguous", AMBIGUOUS), ("recovery", RECOVERY), ("corrected", CORRECTED)], REPORT_SUMMARY),
        "report_spike_details": with_(
            REFINE_BASE + [("corrected", CORRECTED), ("days", "SELECT date FROM corrected WHERE is_spike_corrected"),
                           ("neg", "SELECT * FROM scored WHERE is_negative AND date IN (SELECT date FROM days)")], details_sql("days")),
        "ambiguous_conversations": with_(BASE, "SELECT date, conversation_id, neg_score FROM scored "
                                               "WHERE neg_score > 0.01 AND neg_score <= 0.3"),
        "ambiguous_sample": with_(BASE + [("ambiguous", AMBIGUOUS), ("amb_sample", amb_sample_sql(AMBIGUOUS_QUERY_SAMPLE))],
                                  "SELECT conversation_id, CAST(sample_rank AS INTEGER) AS sample_rank, neg_score FROM amb_sample"),
        "recovery_stats": with_(REFINE_BASE, "SELECT * FROM recovery"),
        "daily_corrected": with_(REFINE_BASE + [("corrected", CORRECTED)], r6(CORRECTED_COLS, "corrected")),
        "summary": with_(REPORT_BASE, SUMMARY),
        "dashboard_daily": with_(BASE + [("daily", DAILY), ("spikes", DAILY_SPIKES)],
                                 "SELECT date, total_conversations, round(negative_ratio, 6) AS negative_ratio, "
                                 "coalesce(is_spike, false) AS is_spike FROM spikes ORDER BY date"),
        "dashboard_spikes": with_(BASE + [("daily", DAILY), ("spikes", DAILY_SPIKES)],
                                  "SELECT date, round(negative_ratio, 6) AS negative_ratio FROM spikes "
                                  "WHERE coalesce(is_spike, false) ORDER BY date"),
        "dashboard_trending": with_(TERM_BASE + [("trending", trending_sql())],
                                    "SELECT term, growth_ratio FROM trending ORDER BY growth_ratio DESC, term ASC LIMIT 15"),
        "dashboard_novel": with_(TERM_BASE + [("novel", novel_sql())],
                                 "SELECT term, recent_count, novelty FROM novel ORDER BY recent_count DESC, term ASC LIMIT 15"),
    }
