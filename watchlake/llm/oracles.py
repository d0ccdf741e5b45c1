"""The same results as DuckDB SQL over the same tables, where SQL can express them."""

from __future__ import annotations

from watchlake.llm.chat import END, TURN
from watchlake.llm.licences import PHRASES
from watchlake.llm.quality import BOILERPLATE, END_PUNCTUATION, NAVIGATION, SYMBOLS
from watchlake.llm.queries import SHARDS
from watchlake.llm.sharding import SLOTS, lookup_table
from watchlake.llm.warc import BASE32


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT *, sha1(b) AS s, max(page_id) OVER (PARTITION BY sha256(b)) AS m FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('{BASE32}', ((('0x' || substr(s, 5 * (i // 4) + 1, 5))::INT
      // (32 ** (3 - i % 4))::INT) % 32 + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to, url
FROM h
"""


OP2 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, c.r AS cr, q.vec_id AS query_id, c.vec_id,
    list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS rank FROM s)
WHERE rank <= 5
"""


def _escape(column: str) -> str:
    return f"replace(replace(replace({column}, '%', '%25'), '<', '%3C'), '[', '%5B')"


OP4 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
    (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (
  SELECT conv_id, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
      FILTER (role = 'assistant'), '') AS learnt,
    sum({len(TURN) + len(END) + 1} + length(replace({_escape('role')}, chr(10), '%0A'))
      + length({_escape('text')})) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256,
  length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256,
  chars::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments
FROM s
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {WORD}) AS w
  FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(length(w) - 2, 2))) AS i FROM d WHERE length(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
pair AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r
  GROUP BY a.r, b.r),
link AS MATERIALIZED (
  SELECT a, b FROM pair JOIN n x ON x.r = a JOIN n y ON y.r = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
two AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT r AS a, r AS b FROM d
  UNION SELECT reach.a, two.b FROM reach JOIN two ON two.a = reach.b),
c AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
  doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN c ON c.a = d.r LEFT JOIN n ON n.r = d.r
"""

_FAILS = f"""(NOT regexp_matches(l, {quoted(END_PUNCTUATION)})
    AND length(regexp_extract_all(l, {WORD})) > 4
  OR regexp_matches(l, {quoted(NAVIGATION)}) OR regexp_matches(l, {quoted(BOILERPLATE)})
  OR length(l) - length(translate(l, '{SYMBOLS}', '')) > length(l) * 0.2)"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, {WORD}) AS w FROM d),
win AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS x
  FROM (SELECT r, w, unnest(range(1, length(w) - 3)) AS i FROM w)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
l AS (
  SELECT r, count(*) FILTER (regexp_matches(l, {WORD}))
      - count(DISTINCT l) FILTER (regexp_matches(l, {WORD})) AS n_dup,
    count(*) FILTER (regexp_matches(l, {WORD}) AND {_FAILS}) AS n_removed,
    coalesce(sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')))
      FILTER (regexp_matches(l, {WORD}) AND {_FAILS}), 0)::BIGINT AS chars_removed
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) GROUP BY r),
m AS (
  SELECT doc_id, length(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    l.n_dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    l.n_removed::BIGINT AS n_lines_removed, l.chars_removed AS chars_removed
  FROM w JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND chars_removed <= word_chars * 0.5 AS kept FROM b
"""

OP8 = f"""
WITH d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size,
    md5('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
a AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER fill, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0)) AS lvl,
    3 * source_size / weight AS full_at
  FROM s WINDOW fill AS (ORDER BY 3 * source_size / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
    least((3 * source_size)::DOUBLE, max(CASE WHEN full_at >= lvl THEN lvl END) OVER () * weight) AS target,
    ('0x' || substr(md5('42:' || coalesce(source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
      AS u FROM a),
p AS (
  SELECT doc_id, size, source_size, target, u, coalesce(target / nullif(source_size, 0), 0) AS e,
    row_number() OVER (PARTITION BY d.source
      ORDER BY length(bin(size)), substr(bin(size), 1, 4), h, size) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor(k * e + u) - floor((k - 1) * e + u)) * size)::BIGINT AS taken
FROM p
"""

OP10 = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (
  SELECT r, i, md5(b[i:i + 199]) AS h
  FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
steps AS (
  SELECT r, i, i > 200 + lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) AS fresh FROM twice),
spans AS MATERIALIZED (
  SELECT r, k, min(i) AS a, max(i) + 200 AS z
  FROM (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM steps) GROUP BY r, k),
pieces AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS x, a - 1 AS y FROM spans
  UNION ALL
  SELECT r, coalesce(max(z), 1), max(octet_length(b)) FROM d LEFT JOIN spans USING (r) GROUP BY r),
kept AS (
  SELECT r, coalesce(string_agg(hex(b[x:y]), '' ORDER BY x), '') AS h
  FROM pieces JOIN d USING (r) WHERE y >= x GROUP BY r),
n AS (SELECT r, sum(z - a) AS removed, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
  coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""

_WORD_CHARS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _crc32(column: str) -> str:
    """The CRC of a string's UTF-8 bytes, by the table `t` of `CRC`."""
    byte = f"('0x' || substr(hex(encode({column})), 2 * i + 1, 2))::BIGINT"
    found = f"list_transform(range(octet_length(encode({column}))), lambda i: {byte})"
    step = "xor(c // 256, t[(xor(c, y) % 256) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {found}), lambda c, y: {step}), 4294967295)"


CRC = """crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""

OP11 = f"""
WITH {CRC},
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD_CHARS}) AS w
  FROM documents),
dw AS (SELECT r, unnest(w) AS x FROM d),
bw AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD_CHARS})) AS x
  FROM benchmark),
coded AS MATERIALIZED (
  SELECT x, {_crc32('x')} % 10000 AS b
  FROM (SELECT x FROM dw UNION SELECT x FROM bw), crc),
s AS (SELECT b, count(*) AS n FROM dw JOIN coded USING (x) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN coded USING (x) GROUP BY b),
total AS (
  SELECT (SELECT count(*) + 10000 FROM dw)::DOUBLE AS s, (SELECT count(*) + 10000 FROM bw)::DOUBLE AS t),
gain AS (
  SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1) * total.s / ((s.n + 1) * total.t))) AS g
  FROM s LEFT JOIN t USING (b), total),
sums AS (
  SELECT r, count(*) AS n, floor(sum(g) / count(*)) AS weight
  FROM dw JOIN coded USING (x) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN sums USING (r)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, r) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS fit
  FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END::BIGINT AS rank
FROM ranked
"""


def _merkle_levels(name: str, first: str, key: str, levels: int) -> str:
    """The levels of trees from `first` (key, idx, n, h) on, and `<name>_root`."""
    parts = [
        f"""{name}{k} AS MATERIALIZED (
  SELECT {key}, idx // 8 AS idx, (any_value(n) + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY idx)) AS h
  FROM {name if k > 1 else first}{k - 1 if k > 1 else ''} WHERE n > 1 GROUP BY {key}, idx // 8)"""
        for k in range(1, levels + 1)
    ]
    ends = [first, *(f"{name}{k}" for k in range(1, levels + 1))]
    parts.append(f"{name}_root AS (" + " UNION ALL ".join(f"SELECT {key}, h FROM {e} WHERE n = 1" for e in ends) + ")")
    return ",\n".join(parts)


def _merkle_ways(name: str, first: str, nodes: str, own: str, key: str, levels: int) -> str:
    """Siblings and folded digest of each way from `first` (r, key, idx, n, folded, sib) up the levels."""
    parts = []
    for k in range(levels):
        way = f"{name}{k}" if k else first
        level = f"{nodes}{k}" if k else own
        parts.append(f"""{name}{k + 1} AS (
  SELECT p.r, p.{key}, any_value(p.idx) // 8 AS idx, (any_value(p.n) + 7) // 8 AS n,
    sha256(string_agg(CASE WHEN s.idx = p.idx THEN p.folded ELSE s.h END, '' ORDER BY s.idx)) AS folded,
    any_value(p.sib) || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> p.idx), '') AS sib
  FROM {way} p JOIN {level} s ON p.{key} IS NOT DISTINCT FROM s.{key} AND p.idx // 8 = s.idx // 8
  WHERE p.n > 1 GROUP BY p.r, p.{key}
  UNION ALL SELECT r, {key}, idx, n, folded, sib FROM {way} WHERE n = 1)""")
    return ",\n".join(parts)


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode(({name})::VARCHAR)) || ':' || ({name})::VARCHAR, '-')"


#: As many levels as 8 ** 7 documents of a language and 8 ** 3 languages need.
_DEEP, _TOPS = 7, 3
_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
OP13 = f"""
WITH {CRC},
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256({_HEAD} || {_field('text')}) AS leaf,
    CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0
      THEN sha256({_HEAD} || {_field(f"translate(text, '{_UPPER}', '{_LOWER}')")})
      ELSE sha256({_HEAD} || {_field('text')}) END AS claimed
  FROM documents, crc),
n0 AS MATERIALIZED (
  SELECT r, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM d),
{_merkle_levels('n', 'n0', 'lang', _DEEP)},
t0 AS MATERIALIZED (
  SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, h
  FROM n_root),
{_merkle_levels('t', 't0', 'one', _TOPS)},
w0 AS (SELECT n0.r, n0.lang, idx, n, claimed AS folded, '' AS sib FROM n0 JOIN d ON d.r = n0.r),
{_merkle_ways('w', 'w0', 'n', 'n0', 'lang', _DEEP)},
v0 AS (
  SELECT w.r, one, t0.idx, t0.n, folded, sib, h AS subroot
  FROM w{_DEEP} w JOIN t0 ON w.lang IS NOT DISTINCT FROM t0.lang),
{_merkle_ways('v', 'v0', 't', 't0', 'one', _TOPS)}
SELECT doc_id, leaf, subroot, t_root.h AS root, sha256(v.sib) AS proof_sha256, v.folded AS folded_root,
  v.folded = t_root.h AS verified
FROM d JOIN v{_TOPS} v ON v.r = d.r JOIN v0 ON v0.r = d.r, t_root
"""


# two hex digits for each slot, as there are 256 shards
_TABLE = "".join(f"{shard:02x}" for shard in lookup_table(SHARDS).tolist())

OP3 = f"""
SELECT doc_id, slot, 'shard-' || lpad(('0x' || substr('{_TABLE}', (2 * slot + 1)::INT, 2))::INT::VARCHAR, 3, '0') AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT % {SLOTS} AS slot FROM documents)
"""


def _phrase_places() -> str:
    """The label of the phrase that begins at a word, from the words behind it."""
    names = ["word", *(f"lead(word, {n}) OVER o" for n in range(1, max(len(p.split()) for p in PHRASES)))]
    cases = (
        "WHEN " + " AND ".join(f"{at} = {quoted(w)}" for at, w in zip(names, phrase.split())) + f" THEN {quoted(label)}"
        for phrase, label in PHRASES.items()
    )
    return "CASE " + " ".join(cases) + " END"


LICENSE_BASE = f"""
WITH w AS (
  SELECT doc_id, generate_subscripts(words, 1) - 1 AS place, unnest(words) AS word FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents)),
p AS (SELECT doc_id, place, {_phrase_places()} AS label FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
n AS (
  SELECT doc_id, count(*) AS n_words, count(label) AS n_base, min(place) FILTER (label IS NOT NULL) AS first_word,
    max(place) FILTER (label IS NOT NULL) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels
FROM documents LEFT JOIN n USING (doc_id)
"""


ORACLES = {
    "op1_warc": OP1,
    "op2_topk": OP2,
    "op3_sharding": OP3,
    "op4_chat_formatting": OP4,
    "op5_minhash": OP5,
    "license_base": LICENSE_BASE,
    "op7_quality_rules": OP7,
    "op8_mixing": OP8,
    "op10_suffix_dedup": OP10,
    "op11_resampling": OP11,
    "op13_merkle": OP13,
}
