"""SQL for DuckDB that states the expected result of each registered query."""

from __future__ import annotations

from watchlake.functions import fixed
from watchlake.workload.queries import USER

# The raw records and cleaned rows that mapping.py makes from events.
_RAW = """
raw AS (
  SELECT event_id AS n, user_id::VARCHAR AS user_id, event_type, ts,
    'Channel ' || (event_id % 17) AS channel,
    CASE WHEN event_type IN ('view', 'click') THEN '動画 ' || event_id || ' を視聴しました'
         WHEN event_type = 'purchase' THEN 'clip ' || event_id || '　を視聴しました'
         WHEN event_type = 'signup' THEN 'Post ' || event_id
         ELSE 'YouTube のトップページで広告を視聴しました' END AS raw_title,
    CASE event_id % 4
         WHEN 0 THEN 'https://www.youtube.com/watch?v=' || substr(md5(event_id::VARCHAR), 1, 11)
         WHEN 1 THEN 'https://youtu.be/' || substr(md5(event_id::VARCHAR), 1, 11)
         WHEN 2 THEN 'https://www.youtube.com/watch?t=5&v=' || substr(md5(event_id::VARCHAR), 1, 11)
    END AS raw_url,
    CASE WHEN event_id % 11 <> 0 THEN 'https://www.youtube.com/channel/UC'
         || substr(md5('Channel ' || (event_id % 17)), 1, 10) END AS channel_url
  FROM events
),
fields AS (
  SELECT *,
    CASE WHEN regexp_matches(raw_title, '.[ 　]*を視聴しました')
         THEN trim(regexp_extract(raw_title, '(.+?)[ 　]*を視聴しました', 1), ' 　')
         ELSE raw_title END AS title,
    coalesce(CASE WHEN regexp_matches(raw_url, '[?&]v=[a-zA-Z0-9_-]{11}')
         THEN regexp_extract(raw_url, '[?&]v=([a-zA-Z0-9_-]{11})', 1)
         ELSE regexp_extract(raw_url, 'youtu\\.be/([a-zA-Z0-9_-]{11})', 1) END, '') AS video_id,
    CASE WHEN n % 11 = 0 THEN '' WHEN n % 13 = 0 THEN '不明' ELSE channel END AS channel_name,
    coalesce(regexp_extract(channel_url, '/channel/([a-zA-Z0-9_-]+)', 1), '') AS channel_id,
    CASE WHEN event_type = 'error' THEN 'ad' WHEN n % 97 = 0 THEN 'bad_time'
         ELSE 'valid' END AS outcome
  FROM raw
),
hist AS (
  SELECT n, user_id, title, video_id, channel_name, channel_id, ts AS watched_at
  FROM fields WHERE outcome = 'valid'
)"""

_RECENT_ORDER = (
    "watched_at DESC, title NULLS LAST, video_id NULLS LAST, channel_name NULLS LAST"
)

_RECENT_ALL = f"""
recent AS (
  SELECT user_id, title, channel_name, watched_at,
    row_number() OVER (PARTITION BY user_id ORDER BY {_RECENT_ORDER}) AS rank
  FROM hist QUALIFY rank <= 100
)"""

_TENANTS = """
tenants AS (
  SELECT * REPLACE (CASE WHEN n % 10 < 8 THEN 'large' WHEN n % 10 = 8 THEN 'middle'
    ELSE 'small' END AS user_id) FROM hist
)"""

_CHANNELS_ALL = """
channels AS (
  SELECT user_id, channel_name, count(*) AS watch_count,
    row_number() OVER (PARTITION BY user_id
      ORDER BY count(*) DESC, channel_name NULLS LAST) AS rank
  FROM hist GROUP BY user_id, channel_name QUALIFY rank <= 10
)"""

_PLANNED = """
sizes AS (
  SELECT user_id, count(*) AS views, count(DISTINCT channel_name) AS channels,
    count(DISTINCT watched_at::DATE) AS days
  FROM hist GROUP BY user_id
),
planned AS (
  SELECT q.*, coalesce(views, 0) AS views, coalesce(channels, 0) AS channels,
    coalesce(days, 0) AS days, coalesce(route, CASE WHEN views IS NOT NULL
      AND c.c_custkey IS NULL THEN 'vector' ELSE 'recent_history' END) AS plan
  FROM questions q LEFT JOIN sizes USING (user_id)
  LEFT JOIN customer c ON c.c_custkey::VARCHAR = q.user_id AND c.c_mktsegment = 'MACHINERY'
)"""


def _block(plan: str, rows: str, **values: str) -> str:
    """Data block per user as a SELECT: values are SQL texts, keys the JSON names."""
    fields = " || ',' || chr(10) || ".join(
        f"""'    "{name}": "' || {value} || '"'""" for name, value in values.items()
    )
    item = f"'  {{' || chr(10) || {fields} || chr(10) || '  }}'"
    return f"""
  SELECT user_id, '{plan}' AS plan, count(*) AS data_count,
    '[' || chr(10) || string_agg({item}, ',' || chr(10) ORDER BY rank) FILTER (rank <= 50)
    || chr(10) || ']' || CASE WHEN count(*) > 50
      THEN chr(10) || chr(10) || '（全' || count(*) || '件中、最初の50件を表示）' ELSE '' END
      AS context
  FROM {rows} GROUP BY user_id"""


_MILLISECONDS = "strftime(date_trunc('millisecond', watched_at), '%Y-%m-%d %H:%M:%S.%g')"

_PAIRS = """
scored AS (
  SELECT q.vec_id AS question_id, v.vec_id, v.label,
    list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings v ON q.label = v.label
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank
  FROM scored
)"""


def _any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{word}')" for word in words) + ")"


def _route(text: str) -> str:
    whens = " ".join(
        f"WHEN {_any(text, words)} THEN '{name}'" for name, words in fixed.ROUTE_KEYWORDS
    )
    return f"CASE {whens} END"


def _source(route: str) -> str:
    return f"CASE WHEN {route} IS NULL THEN 'vector' ELSE 'sql' END"


_QUESTIONS = f"""
questions AS (
  SELECT conv_id * 100000 + turn AS question_id, conv_id::VARCHAR AS user_id,
    text AS question, {_route('lower(text)')} AS route
  FROM conversations WHERE role = 'user'
)"""

_TIMESTAMP_TEXT = (
    "strftime(watched_at, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(watched_at) % 1000000 = 0 "
    "THEN '' ELSE strftime(watched_at, '.%f') END || '+00:00'"
)

_TOPK_BATCH = f"""WITH {_PAIRS}
SELECT question_id, rank, vec_id, round(score, 4) AS score FROM ranked WHERE rank <= 20"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_HITS = """SELECT question_id, count(*) AS data_count,
      '関連する視聴履歴 ' || count(*) || '件:' || chr(10) || string_agg(
        '- title ' || vec_id || ' (チャンネル: '
        || CASE WHEN vec_id % 7 <> 0 THEN 'Channel ' || label ELSE 'None' END
        || ', 視聴日: ' || strftime(DATE '1970-01-01' + vec_id::INTEGER, '%Y-%m-%d') || ')',
        chr(10) ORDER BY rank) AS context
    FROM ranked WHERE rank <= 5 GROUP BY question_id"""


def _features(dim: int) -> str:
    """The codes that are left of each row's text, for vectors of `dim` numbers."""
    return rf"""
words AS (
  SELECT n, unnest(string_split_regex(lower(title || ' - ' || channel_name),
    '[^\p{{L}}\p{{N}}]+')) AS word FROM hist
),
tokens AS (
  SELECT n, word AS token FROM words WHERE word <> ''
  UNION
  SELECT n, substr(word, pos, 2) FROM (
    SELECT n, word, unnest(generate_series(1, length(word) - 1)) AS pos
    FROM words WHERE length(word) > 2)
),
codes AS (
  SELECT DISTINCT n, ('0x' || substr(md5(token), 1, 8))::BIGINT % {2 * dim} AS code FROM tokens
),
kept AS (
  SELECT a.n, a.code FROM codes a LEFT JOIN codes b ON a.n = b.n AND xor(a.code, 1) = b.code
  WHERE b.n IS NULL
)"""


ORACLES: dict[str, str] = {
    "parse_history": _with(_RAW)
    + "SELECT user_id, title, video_id, channel_name, channel_id, watched_at FROM hist",
    "record_outcomes": _with(_RAW)
    + "SELECT outcome, count(*) AS record_count FROM fields GROUP BY outcome",
    "ad_filter_counts": _with(_RAW)
    + """SELECT user_id, count(*) AS input_rows,
      count(*) FILTER (outcome = 'ad') AS ads_excluded,
      count(*) FILTER (outcome = 'valid') AS valid_rows FROM fields GROUP BY user_id""",
    "ingest_stats": _with(_RAW)
    + """SELECT user_id, count(*) AS input_rows,
      count(*) FILTER (outcome = 'ad') AS ads_excluded,
      count(*) FILTER (outcome = 'bad_time') AS bad_time,
      0::BIGINT AS quarantined,
      count(*) FILTER (outcome = 'valid') AS valid_rows,
      min(ts::DATE) FILTER (outcome = 'valid') AS first_day,
      max(ts::DATE) FILTER (outcome = 'valid') AS last_day,
      CASE WHEN count(*) FILTER (outcome = 'valid') > 0
           THEN count(DISTINCT channel_name) FILTER (outcome = 'valid') END AS channels
    FROM fields GROUP BY user_id""",
    "title_extract": _with(_RAW) + "SELECT n::INTEGER AS src_pos, title FROM fields",
    "video_id_extract": _with(_RAW) + "SELECT n::INTEGER AS src_pos, video_id FROM fields",
    "channel_id_extract": _with(_RAW) + "SELECT n::INTEGER AS src_pos, channel_id FROM fields",
    "page_video_id_extract": """
      SELECT page_id, CASE WHEN regexp_matches(url, '[?&]v=[a-zA-Z0-9_-]{11}')
        THEN regexp_extract(url, '[?&]v=([a-zA-Z0-9_-]{11})', 1)
        ELSE coalesce(regexp_extract(url, 'youtu\\.be/([a-zA-Z0-9_-]{11})', 1), '') END AS video_id
      FROM pages""",
    "timestamp_parse": """
      SELECT event_id, CASE event_id % 5
        WHEN 0 THEN date_trunc('millisecond', ts)
        WHEN 1 THEN date_trunc('second', ts) - INTERVAL 9 HOUR
        WHEN 2 THEN date_trunc('day', ts)::TIMESTAMP END AS parsed_at
      FROM events""",
    "most_watched_channels": _with(_RAW, _CHANNELS_ALL)
    + f"SELECT channel_name, watch_count FROM channels WHERE user_id = '{USER}'",
    "total_videos": _with(_RAW) + f"SELECT count(*) AS total FROM hist WHERE user_id = '{USER}'",
    "recent_history": _with(_RAW)
    + f"""SELECT title, channel_name, watched_at FROM hist WHERE user_id = '{USER}'
      ORDER BY {_RECENT_ORDER} LIMIT 100""",
    "daily_watch_count": _with(_RAW)
    + f"""SELECT watched_at::DATE AS watch_date, count(*) AS count FROM hist
      WHERE user_id = '{USER}' GROUP BY 1 ORDER BY 1 DESC LIMIT 30""",
    "most_watched_channels_all_users": _with(_RAW, _CHANNELS_ALL)
    + "SELECT user_id, rank::INTEGER AS rank, channel_name, watch_count FROM channels",
    "total_videos_all_users": _with(_RAW)
    + """SELECT c_custkey::VARCHAR AS user_id, count(hist.n) AS total
      FROM customer LEFT JOIN hist ON hist.user_id = c_custkey::VARCHAR GROUP BY 1""",
    "recent_history_all_users": _with(_RAW, _RECENT_ALL)
    + "SELECT user_id, rank::INTEGER AS rank, title, channel_name, watched_at FROM recent",
    "daily_watch_count_all_users": _with(_RAW)
    + """SELECT user_id, row_number() OVER (PARTITION BY user_id
        ORDER BY watched_at::DATE DESC)::INTEGER AS rank,
        watched_at::DATE AS watch_date, count(*) AS count
      FROM hist GROUP BY user_id, watched_at::DATE QUALIFY rank <= 30""",
    "result_as_strings": _with(_RAW, _RECENT_ALL)
    + """SELECT user_id, rank::VARCHAR AS rank, title, channel_name,
      strftime(date_trunc('millisecond', watched_at), '%Y-%m-%d %H:%M:%S.%g') AS watched_at
      FROM recent""",
    "embedding_texts": _with(_RAW)
    + f"""SELECT n::INTEGER AS src_pos, title || ' - ' || channel_name AS text,
      {_TIMESTAMP_TEXT} AS watched_at_text FROM hist""",
    "truncate_texts": """
      SELECT doc_id, md5(substr(text, 1, 8000)) AS cut_md5,
        length(substr(text, 1, 8000)) AS cut_chars,
        NOT regexp_matches(text, '[^\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]') AS blank
      FROM documents""",
    "hash_embed": _with(
        _RAW,
        _features(1024),
    )
    + """SELECT n::INTEGER AS src_pos, string_agg(code, ' ' ORDER BY code) AS codes,
      1024::INTEGER AS dimension, count(*)::INTEGER AS set_buckets,
      round(CASE WHEN bool_or(code % 2 = 1) THEN 1.0 / sqrt(count(*)) ELSE 0.0 END
        ::FLOAT::DOUBLE, 5) AS largest,
      round(CASE WHEN bool_or(code % 2 = 0) THEN -1.0 / sqrt(count(*)) ELSE 0.0 END
        ::FLOAT::DOUBLE, 5) AS smallest,
      coalesce(min(code // 2 + 1) FILTER (code % 2 = 1), 0) AS first_largest
    FROM kept GROUP BY n""",
    "sample_exact": _with(
        _RAW,
        """
drawn AS (
  SELECT user_id, n, count(*) OVER (PARTITION BY user_id) AS total,
    row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || n), n) AS drawn_at,
    row_number() OVER (PARTITION BY user_id ORDER BY n) AS file_at
  FROM hist
)""",
    )
    + """SELECT user_id, n::INTEGER AS src_pos,
      ((CASE WHEN total > 20 THEN drawn_at ELSE file_at END) - 1)::INTEGER AS idx
    FROM drawn WHERE drawn_at <= 20""",
    "sample_large": _with(
        _RAW,
        _TENANTS,
        """
drawn AS (
  SELECT user_id, n, count(*) OVER (PARTITION BY user_id) AS total,
    row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || n), n) AS drawn_at,
    row_number() OVER (PARTITION BY user_id ORDER BY n) AS file_at
  FROM tenants
)""",
    )
    + """SELECT user_id, n::INTEGER AS src_pos,
      ((CASE WHEN total > 4000 THEN drawn_at ELSE file_at END) - 1)::INTEGER AS idx
    FROM drawn WHERE drawn_at <= 4000""",
    "sample_incremental": _with(
        _RAW,
        _TENANTS,
        """
drawn AS (
  SELECT user_id, n, count(*) OVER (PARTITION BY user_id) AS total,
    row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || n), n) AS drawn_at,
    row_number() OVER (PARTITION BY user_id ORDER BY n) AS file_at
  FROM tenants
)""",
    )
    + """SELECT user_id, n::INTEGER AS src_pos,
      ((CASE WHEN total > 4000 THEN drawn_at ELSE file_at END) - 1)::INTEGER AS idx
    FROM drawn WHERE drawn_at <= 4000""",
    "recent_history_cut": _with(_RAW, _TENANTS)
    + f"""SELECT user_id, title, channel_name, watched_at,
      (row_number() OVER (PARTITION BY user_id ORDER BY {_RECENT_ORDER}))::INTEGER AS rank
    FROM tenants QUALIFY rank <= 100""",
    "dense_vector_positions": _with(_RAW, _TENANTS)
    + """SELECT user_id, n::INTEGER AS src_pos,
      (row_number() OVER (PARTITION BY user_id ORDER BY n) - 1)::INTEGER AS idx FROM tenants""",
    "embedding_failures": _with(_RAW)
    + """SELECT n::INTEGER AS src_pos, n % 5 <> 0 AND contains(title, 'Post') AS embed_failed,
      CASE WHEN n % 5 = 0 OR contains(title, 'Post') THEN 0 ELSE length(title) END::DOUBLE AS first,
      CASE WHEN n % 5 = 0 OR contains(title, 'Post') THEN 0 ELSE 1 END::DOUBLE AS second
    FROM hist""",
    "timestamp_forms": """
      SELECT event_id, CASE event_id % 8
        WHEN 0 THEN ts - INTERVAL 19815 SECOND
        WHEN 1 THEN date_trunc('second', ts) + INTERVAL 1800500 MILLISECOND
        WHEN 2 THEN date_trunc('hour', ts)
        WHEN 6 THEN date_trunc('minute', ts) - INTERVAL 32430 SECOND END AS parsed_at
      FROM events""",
    "json_literals": """
      SELECT event_id, '"é' || CASE event_id % 31 + 1
          WHEN 8 THEN '\\b' WHEN 9 THEN '\\t' WHEN 10 THEN '\\n' WHEN 12 THEN '\\f' WHEN 13 THEN '\\r'
          ELSE '\\u00' || lpad(lower(to_hex(event_id % 31 + 1)), 2, '0') END
        || '\\\\u001B\\\\' || event_id || '"' AS literal
      FROM events""",
    "ingest_files": _with(
        _RAW,
        """
files AS (
  SELECT user_id, n % 2 = 1 AS newer, user_id::INT % 3 AS kind,
    count(*) AS rows, count(*) FILTER (outcome = 'valid') AS valid,
    md5(string_agg(title, ',' ORDER BY title) FILTER (outcome = 'valid')) AS titles
  FROM fields GROUP BY ALL
),
judged AS (
  SELECT *, CASE WHEN newer AND kind = 1 THEN 0 WHEN newer AND kind = 2 THEN 0 ELSE rows END
      AS input_rows,
    CASE WHEN newer AND kind <> 0 THEN 0 ELSE valid END AS valid_rows,
    CASE WHEN newer AND kind = 2 THEN 'bad_json' END AS file_error
  FROM files
),
best AS (
  SELECT user_id, arg_max(newer, newer) AS newer, arg_max(valid, newer) AS table_rows,
    arg_max(titles, newer) AS titles_md5
  FROM judged WHERE valid_rows > 0 GROUP BY user_id
)""",
    )
    + """SELECT j.user_id, 'raw/' || j.user_id || CASE WHEN j.newer THEN '/b.json' ELSE '/a.json' END
        AS file_path, input_rows, valid_rows, file_error,
      CASE WHEN file_error IS NOT NULL THEN 'failed' WHEN valid_rows = 0 THEN 'no_valid_rows'
           WHEN j.newer = b.newer THEN 'written' ELSE 'superseded' END AS outcome,
      table_rows, titles_md5
    FROM judged j LEFT JOIN best b USING (user_id)""",
    "large_files": _with(_RAW)
    + """SELECT CASE WHEN n % 10 < 8 THEN 'large' WHEN n % 10 = 8 THEN 'middle' ELSE 'small' END AS user_id,
      src_pos, title, video_id, channel_name, channel_id, ts AS watched_at
    FROM (SELECT *, (row_number() OVER (
        PARTITION BY greatest(n % 10, 7) ORDER BY n) - 1)::INTEGER AS src_pos
      FROM fields) WHERE outcome = 'valid'""",
    "history_table": _with(_RAW)
    + """SELECT user_id, n::INTEGER AS src_pos, title, video_id, channel_name, channel_id, watched_at FROM hist
    WHERE user_id::INT % 3 <> 0 OR day(watched_at) > 15
      OR user_id NOT IN (SELECT user_id FROM hist WHERE day(watched_at) > 15)""",
    "vectors_of_users": _with(
        _RAW,
        _features(64),
        """
signs AS (
  SELECT n, list(coalesce(sign, 0) ORDER BY bucket) AS signs, max(scale) AS scale FROM (
    SELECT h.n, b.bucket, CASE WHEN k.code % 2 = 1 THEN 1 WHEN k.code % 2 = 0 THEN -1 END AS sign,
      count(k.code) OVER (PARTITION BY h.n) AS scale
    FROM hist h CROSS JOIN range(64) b(bucket) LEFT JOIN kept k ON k.n = h.n AND k.code // 2 = b.bucket)
  GROUP BY n
)""",
    )
    + """SELECT user_id, idx, title || ' - ' || channel_name AS text, false AS embed_failed, title, channel_name,
      video_id, watched_at, md5(list_aggregate(signs, 'string_agg', ',')) AS signs_md5,
      CASE WHEN list_contains(signs, 1) THEN round((1.0 / sqrt(scale))::FLOAT::DOUBLE, 5) ELSE 0.0 END AS largest
    FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY n) - 1)::INTEGER AS idx FROM hist)
    JOIN signs USING (n)
    JOIN customer ON c_custkey::VARCHAR = user_id AND c_mktsegment = 'MACHINERY'
    WHERE user_id::INT % 10 <> 7""",
    "result_csv": _with(_RAW, _RECENT_ALL)
    + f"""SELECT user_id, rank::VARCHAR AS rank, title, channel_name, {_MILLISECONDS} AS watched_at FROM recent""",
    "ingest_totals": _with(_RAW)
    + """SELECT count(*) AS input_rows, count(*) FILTER (outcome = 'ad') AS ads_excluded,
      count(*) FILTER (outcome = 'bad_time') AS bad_time, 0::BIGINT AS quarantined,
      count(*) FILTER (outcome = 'valid') AS valid_rows,
      min(ts::DATE) FILTER (outcome = 'valid') AS first_day,
      max(ts::DATE) FILTER (outcome = 'valid') AS last_day, 0::BIGINT AS failed_files FROM fields""",
    "route_keyword_table": r"""
      WITH b AS (
        SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')) AS w FROM benchmark),
      a AS (
        SELECT left(unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')), 6) AS w
        FROM conversations WHERE role = 'assistant'),
      k AS (
        SELECT w, substr(md5(w), 1, 6) AS route, substr(md5(w), 7, 1) AS turn FROM (
          SELECT w FROM b WHERE length(w) > 3 UNION SELECT w FROM a WHERE length(w) > 4)),
      q AS (SELECT conv_id * 100000 + turn AS question_id, text FROM conversations WHERE role = 'user')
      SELECT question_id, min(turn || route)[2:] AS route
      FROM q LEFT JOIN k ON contains(lower(q.text), k.w) GROUP BY question_id""",
    "embed_incremental": """
      WITH t AS (
        SELECT event_id % 5 AS m, CASE WHEN event_id % 50 = 0 THEN ' ' WHEN event_id % 3 = 0 THEN 'the same clip'
          ELSE 'clip ' || event_id // 2 END AS text FROM events),
      b AS (
        SELECT 0 AS batch, text FROM t WHERE m < 2
        UNION ALL SELECT 1, text FROM t WHERE m IN (1, 2)
        UNION ALL SELECT 2, text FROM t WHERE m >= 2),
      first AS (SELECT text, min(batch) AS batch FROM b WHERE text <> ' ' GROUP BY text),
      sent AS (SELECT batch, count(*) AS texts_sent FROM first GROUP BY batch)
      SELECT batch, count(*) AS n_rows, count(*) FILTER (text = ' ') AS n_blank, 0::BIGINT AS n_different,
        coalesce(any_value(texts_sent), 0) AS texts_sent
      FROM b LEFT JOIN sent USING (batch) GROUP BY batch""",
    "counts_incremental": _with(
        _RAW,
        """
up AS (
  SELECT *, n % 3 AS file FROM fields
  WHERE n % 3 = 0 OR n % 3 = 1 AND user_id::INT % 2 = 0 OR n % 3 = 2 AND user_id::INT % 3 = 0
),
newest AS (SELECT user_id, max(file) AS file FROM up WHERE outcome = 'valid' GROUP BY user_id),
last AS (SELECT up.* FROM up JOIN newest USING (user_id, file)),
stats AS (
  SELECT user_id, count(*) AS input_rows, count(*) FILTER (outcome = 'ad') AS ads_excluded,
    count(*) FILTER (outcome = 'bad_time') AS bad_time, 0::BIGINT AS quarantined,
    count(*) FILTER (outcome = 'valid') AS valid_rows,
    count(DISTINCT channel_name) FILTER (outcome = 'valid') AS channels,
    date_diff('day', DATE '2024-01-01', min(ts::DATE) FILTER (outcome = 'valid')) AS first_day,
    date_diff('day', DATE '2024-01-01', max(ts::DATE) FILTER (outcome = 'valid')) AS last_day
  FROM last GROUP BY user_id
),
top AS (
  SELECT user_id, 'channel ' || channel_name AS name, count(*) AS n FROM last WHERE outcome = 'valid'
  GROUP BY user_id, channel_name
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, channel_name NULLS LAST) <= 10
),
days AS (
  SELECT user_id, ts::DATE::VARCHAR AS name, count(*) AS n FROM last WHERE outcome = 'valid'
  GROUP BY user_id, ts::DATE
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC) <= 30
)""",
    )
    + """SELECT user_id, name, n FROM (UNPIVOT stats ON COLUMNS(* EXCLUDE user_id) INTO NAME name VALUE n)
    UNION ALL SELECT * FROM top UNION ALL SELECT * FROM days
    UNION ALL SELECT user_id, 'total', valid_rows FROM stats""",
    "arrival_ingest": _with(
        _RAW,
        """
files AS (
  SELECT user_id, n % 2 = 1 AS newer, user_id::INT % 3 AS kind,
    count(*) FILTER (outcome = 'valid') AS valid,
    sum(('0x' || substr(md5(title), 1, 8))::BIGINT) FILTER (outcome = 'valid')::BIGINT AS titles
  FROM fields GROUP BY ALL
),
best AS (
  SELECT user_id, arg_max(valid, newer) AS views, arg_max(titles, newer) AS titles
  FROM files WHERE valid > 0 AND NOT (newer AND kind <> 0) GROUP BY user_id
)""",
    )
    + """SELECT f.user_id, count(*) FILTER (newer AND kind = 2) AS failed_files, count(*) AS files,
      any_value(views) AS views, any_value(b.titles) AS titles, any_value(views) AS vectors
    FROM files f LEFT JOIN best b USING (user_id) GROUP BY f.user_id""",
    "cosine_to_anchor": """
      SELECT v.vec_id, round(list_cosine_similarity(
        v.embedding::DOUBLE[], a.embedding::DOUBLE[]), 4) AS score
      FROM embeddings v JOIN (
        SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label
      ) a ON v.label = a.label""",
    "cosine_topk": """
      SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id,
        round(score, 4) AS score
      FROM (SELECT v.vec_id, list_cosine_similarity(
              q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
            FROM embeddings v, embeddings q WHERE q.vec_id = 0)
      QUALIFY rank <= 20""",
    "cosine_topk_batch": _TOPK_BATCH,
    "cosine_topk_cells": _TOPK_BATCH,
    "cosine_topk_index": _TOPK_BATCH,
    "vector_doc_roundtrip": """
      SELECT label::VARCHAR AS user_id,
        (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS idx,
        'text ' || vec_id AS text, 'title ' || vec_id AS title,
        NULL::VARCHAR AS channel_name, '' AS video_id,
        epoch_ms(vec_id * 1000) AS watched_at, len(embedding)::INTEGER AS dimension,
        md5(list_aggregate(list_transform(embedding,
          lambda x: round(x::DOUBLE * 100000)::BIGINT::VARCHAR), 'string_agg', ',')) AS values_md5
      FROM embeddings""",
    "question_check": """
      SELECT conv_id, turn,
        md5(CASE WHEN role = 'system' THEN ''
            ELSE regexp_replace(regexp_replace(text, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '')
            END) AS question_md5,
        CASE WHEN role = 'system' OR NOT regexp_matches(text, '[^\\s\\p{Z}]')
             THEN 'Question is required' END AS error
      FROM conversations""",
    "route_questions": _with(_QUESTIONS)
    + f"SELECT question_id, user_id, route, {_source('route')} AS source FROM questions",
    "route_documents": f"""
      SELECT doc_id, route, {_source('route')} AS source
      FROM (SELECT doc_id, {_route('lower(text)')} AS route FROM documents
            WHERE regexp_matches(text, '[^\\s\\p{{Z}}]'))""",
    "answer_batch": _with(
        _RAW,
        _QUESTIONS,
        _PLANNED,
    )
    + f"""SELECT question_id, user_id, route, {_source('route')} AS source, plan,
      (CASE plan
        WHEN 'vector' THEN least(20, views)
        WHEN 'most_watched_channels' THEN least(10, channels)
        WHEN 'total_videos' THEN 1
        WHEN 'daily_watch_count' THEN least(30, days)
        ELSE least(100, views) END)::BIGINT AS data_count
    FROM planned""",
    "answer_stream": _with(
        _RAW,
        _QUESTIONS,
        _PLANNED,
    )
    + f"""SELECT question_id, user_id, route, {_source('route')} AS source, plan,
      (CASE plan
        WHEN 'vector' THEN least(20, views)
        WHEN 'most_watched_channels' THEN least(10, channels)
        WHEN 'total_videos' THEN 1
        WHEN 'daily_watch_count' THEN least(30, days)
        ELSE least(100, views) END)::BIGINT AS data_count
    FROM planned""",
    "template_answers": _with(
        _RAW,
        _QUESTIONS,
        _PLANNED,
        _RECENT_ALL,
        _CHANNELS_ALL,
        """
days AS (
  SELECT user_id, watched_at::DATE AS day, count(*) AS views,
    row_number() OVER (PARTITION BY user_id ORDER BY watched_at::DATE DESC) AS rank
  FROM hist GROUP BY user_id, watched_at::DATE QUALIFY rank <= 30
),
totals AS (
  SELECT DISTINCT user_id, views, 1 AS rank FROM planned
)""",
        "blocks AS ("
        + " UNION ALL ".join(
            [
                _block(
                    "most_watched_channels",
                    "channels",
                    channel_name="channel_name",
                    watch_count="watch_count",
                ),
                _block("total_videos", "totals", total="views"),
                _block(
                    "recent_history",
                    "recent",
                    title="title",
                    channel_name="channel_name",
                    watched_at=_MILLISECONDS,
                ),
                _block("daily_watch_count", "days", watch_date="day", count="views"),
            ]
        )
        + ")",
        f"""
answered AS (
  SELECT question_id, question, plan, coalesce(data_count, 0) AS data_count,
    coalesce(context, '{fixed.NO_DATA_BLOCK}') AS context
  FROM planned LEFT JOIN blocks USING (user_id, plan) WHERE plan <> 'vector'
)""",
    )
    + "SELECT question_id, plan, data_count, context, md5('"
    + fixed.SQL_PROMPT.replace("{data}", "' || context || '").replace(
        "{question}", "' || regexp_replace(question, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') || '"
    )
    + "') AS prompt_md5 FROM answered",
    "vector_prompts": _with(_PAIRS, f"found AS ({_HITS})")
    + f"""SELECT question_id, md5('"""
    + fixed.VECTOR_PROMPT.replace("{context}", "' || answer || '").replace(
        "{question}", "' || '\"{context}\" \\ ' || question_id || '"
    )
    + """') AS prompt_md5,
      to_json({'answer': answer, 'data_count': data_count, 'source': 'vector'})::VARCHAR AS envelope
    FROM (SELECT question_id, context AS answer, data_count FROM found
      UNION ALL SELECT -1, '"""
    + fixed.NO_HITS
    + "', 0)",
    "search_context": _with(_PAIRS) + _HITS,

    "prompt_data_block": _with(_RAW, _RECENT_ALL)
    + """SELECT user_id, count(*) AS data_count,
      '[' || chr(10) || string_agg(
        '  {' || chr(10)
        || '    "title": "' || title || '",' || chr(10)
        || '    "channel_name": "' || channel_name || '",' || chr(10)
        || '    "watched_at": "'
        || strftime(date_trunc('millisecond', watched_at), '%Y-%m-%d %H:%M:%S.%g') || '"'
        || chr(10) || '  }', ',' || chr(10) ORDER BY rank) FILTER (rank <= 50)
      || chr(10) || ']' || CASE WHEN count(*) > 50
        THEN chr(10) || chr(10) || '（全' || count(*) || '件中、最初の50件を表示）' ELSE '' END
        AS data_text
    FROM recent GROUP BY user_id""",
    "data_summary": _with(_RAW, _CHANNELS_ALL)
    + """SELECT c_custkey::VARCHAR AS user_id, CASE WHEN count(rank) = 0 THEN 'データなし' ELSE
      'データ件数: ' || count(*) || '件' || chr(10) || chr(10)
      || 'サンプル（最初の' || least(5, count(*)) || '件）:' || chr(10)
      || string_agg(rank || '. channel_name: ' || channel_name || ', watch_count: '
        || watch_count || chr(10), '' ORDER BY rank) FILTER (rank <= 5) END AS summary
    FROM customer LEFT JOIN channels ON user_id = c_custkey::VARCHAR GROUP BY 1""",
    "message_array": """
      SELECT conv_id, count(*) + 1 AS message_count,
        string_agg(role, ',' ORDER BY turn) || ',user' AS roles,
        md5(string_agg(text, chr(10) ORDER BY turn) || chr(10) || '続けて') AS contents_md5
      FROM conversations GROUP BY conv_id""",
    "query_fingerprints": "SELECT doc_id, sha256(text) AS fingerprint FROM documents",
    "arrival_normalise": """
      SELECT event_id, 'b' AS bucket, 'raw/' || user_id || '/' || event_id || '.json' AS key
      FROM events, LATERAL (SELECT unnest(generate_series(1,
        CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END)))""",
    "path_filters": """
      SELECT event_id,
        CASE WHEN event_id % 6 IN (0, 1) THEN user_id::VARCHAR END AS raw_user,
        CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR END AS processed_user
      FROM events""",
    "upload_validation": """
      SELECT event_id::INTEGER AS src_pos, reason IS NULL AS valid, reason
      FROM (SELECT event_id, CASE
          WHEN event_id % 5 = 0 THEN 'not_json_name'
          WHEN event_id % 8 = 1 THEN 'bad_json'
          WHEN event_id % 8 = 2 THEN 'not_an_array'
          WHEN event_id % 8 = 3 THEN 'empty_array'
          WHEN event_id % 8 = 5 THEN 'missing_keys'
          WHEN event_id % 8 = 6 THEN 'bad_json' END AS reason
        FROM events)""",
    "data_status": f"""SELECT c_custkey::VARCHAR AS user_id, stored IS NOT NULL AS has_data,
      CASE WHEN stored IS NOT NULL THEN '{fixed.STATUS_READY}'
           ELSE '{fixed.STATUS_MISSING}' END AS message
    FROM customer LEFT JOIN (SELECT DISTINCT label::VARCHAR AS stored FROM embeddings)
      ON stored = c_custkey::VARCHAR""",
    "retention_deleted": """
      WITH f AS (SELECT user_id::VARCHAR AS u, max(ts) AS last FROM events GROUP BY user_id)
      SELECT 'raw/' || u || '/a.json' AS key,
        CASE WHEN last >= TIMESTAMP '2024-01-29 00:00:00' THEN 'kept' WHEN u LIKE '%7' THEN 'changed'
          ELSE 'deleted' END AS outcome,
        last >= TIMESTAMP '2024-01-29 00:00:00' OR u LIKE '%7' AS there
      FROM f""",
    "retention_expired": """
      SELECT 'raw/' || user_id || '/' || event_id || '.json' AS file_path, ts AS modified
      FROM events WHERE ts < TIMESTAMP '2024-01-18 12:00:00'""",
}
