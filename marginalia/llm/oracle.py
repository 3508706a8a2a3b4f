"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat import BETWEEN, BLOCKS, CONTROL, OTHER
from .secrets import RULES


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def _sizes(side: int) -> str:
    return " ".join(f"WHEN '{role}' THEN {len(marks[side])}" for role, marks in BLOCKS.items())


CHAT_FORMAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), near AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped("text")})
    + CASE WHEN before IS NULL OR before <> role THEN CASE role {_sizes(0)} ELSE length({_escaped("role")}) + {len(OTHER[0] + OTHER[1])} END ELSE {len(BETWEEN)} END
    + CASE WHEN after IS NULL OR after <> role THEN CASE role {_sizes(1)} ELSE {len(OTHER[2])} END ELSE 0 END) AS BIGINT) AS formatted_chars
FROM near GROUP BY conv_id
"""


def _spans_of(rank: int) -> str:
    rule = RULES[rank]
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, text, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least,
    string_split_regex(coalesce(text, ''), '{pattern}') AS gaps,
    regexp_extract_all(coalesce(text, ''), '{pattern}') AS wholes,
    regexp_extract_all(coalesce(text, ''), '{pattern}', {rule.group}) AS values_
  FROM documents"""


SECRETS = f"""
WITH cut AS ({" UNION ALL ".join(_spans_of(k) for k in range(len(RULES)))}
), matches AS (
  SELECT doc_id, rank, kind, least, gaps, wholes, values_, unnest(range(1, len(wholes) + 1)) AS i FROM cut WHERE len(wholes) > 0
), spans AS (
  SELECT doc_id, rank, kind,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(wholes[1:i-1], lambda x: length(x))), 0) AS start,
    length(wholes[i]) AS size
  FROM matches WHERE length(values_[i]) >= least
), told AS (
  SELECT doc_id, rank, kind, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS span FROM spans
), grouped AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM told GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN grouped g ON d.doc_id = g.doc_id
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str, lower: bool) -> str:
    text = "coalesce(text, '')"
    return f"regexp_extract_all({f"translate({text}, '{_UPPER}', '{_LOWER}')" if lower else text}, '{pattern}')"


DECONTAMINATION = f"""
WITH words AS (SELECT doc_id, row_number() OVER () AS rn, {_words(_ALNUM, True)} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(_ALNUM, True)} AS w FROM benchmark),
windows AS (SELECT item, j, n, array_to_string(list_slice(w, j, j + n - 1), ' ') AS win FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS j FROM items WHERE len(w) > 0)),
places AS (SELECT rn, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT rn, k, p.n, item, k - j AS diagonal FROM places p JOIN windows v ON p.win = v.win AND p.n = v.n),
covered AS (SELECT rn, count(DISTINCT pos) AS n_hit FROM (SELECT rn, unnest(range(k, k + n)) AS pos FROM (SELECT DISTINCT rn, k, n FROM hits)) GROUP BY rn),
found AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM hits) GROUP BY rn),
runs AS (SELECT rn, min(k) AS place, count(*) + n - 1 AS size FROM (SELECT *, k - row_number() OVER (PARTITION BY rn, item, n, diagonal ORDER BY k) AS run FROM hits) GROUP BY rn, item, n, diagonal, run),
longest AS (SELECT rn, max(size) AS size, arg_min(place, (-size, place)) AS place FROM runs GROUP BY rn)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(size, 0) AS longest_match, coalesce(place - 1, -1) AS longest_match_at
FROM words LEFT JOIN covered USING (rn) LEFT JOIN found USING (rn) LEFT JOIN longest USING (rn)
"""

SUBSTRINGS = f"""
WITH words AS (SELECT doc_id, row_number() OVER () AS rn, {_words(_SPACED, False)} AS w FROM documents),
places AS (SELECT doc_id, rn, k, array_to_string(list_slice(w, k, k + 12), ' ') AS win FROM (SELECT doc_id, rn, w, unnest(range(1, len(w) - 11)) AS k FROM words WHERE len(w) >= 13)),
least AS (SELECT win, min(doc_id) AS first FROM places GROUP BY win),
gone AS (SELECT DISTINCT rn, unnest(range(k, k + 13)) AS pos FROM places JOIN least USING (win) WHERE first < doc_id),
each AS (SELECT rn, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
kept AS (SELECT rn, string_agg(word, ' ' ORDER BY pos) AS kept FROM each ANTI JOIN gone USING (rn, pos) GROUP BY rn),
removed AS (SELECT rn, count(*) AS n_removed FROM gone GROUP BY rn)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN removed USING (rn) LEFT JOIN kept USING (rn)
"""

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_words(_SPACED, True)} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(first, d.doc_id)) AS component_id
FROM words d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS first FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS lowest FROM texts
), marks AS (
  SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    len(words) < 50 AS a,
    100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > lowest, false) AS e
  FROM cut LEFT JOIN marks USING (doc_id)
), failed AS (
  SELECT part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n
  FROM cells GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), tested AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS failing, len(fails) > len(translate(fails, before, '')) AS gone FROM failed, steps
), told AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, f,
    CAST(sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN failing AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN failing AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM tested GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM told
"""
