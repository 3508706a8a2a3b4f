"""DuckDB SQL for the queries of ordered.py, and for the alignment with gaps."""

from __future__ import annotations

from .oracle import _PASSAGES, _label, _rank, _relations, _squeezed
from .ordered import PAGE

_PAGED = f"""SELECT element_id, predicate, {_label('predicate')} AS label, CAST({_rank('predicate')} AS BIGINT) AS rank, subject, object, inferred FROM {_relations('places', 'parents')}"""

# a passage takes the next paragraph of its own kind, unless a proposition stands before it
_ALIGNED = f"""WITH RECURSIVE p AS (SELECT *, sort_index // 500000 AS part FROM {_PASSAGES}),
  para AS (SELECT part, type AS kind, text, row_number() OVER (PARTITION BY part ORDER BY sort_index) AS pos FROM p WHERE sort_index % 11 <> 3),
  ahead AS (SELECT part, pos, min(CASE WHEN kind = 'proposition' THEN pos END) OVER w AS proposition, min(CASE WHEN kind IN ('proposition', 'proof') THEN pos END) OVER w AS proof,
    min(CASE WHEN kind IN ('proposition', 'note') THEN pos END) OVER w AS note FROM para WINDOW w AS (PARTITION BY part ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  element AS (SELECT part, id, type, row_number() OVER (PARTITION BY part ORDER BY sort_index) AS k FROM p WHERE NOT coalesce(is_editorial, false)),
  step(part, k, place, id, took) AS (SELECT DISTINCT part, CAST(0 AS BIGINT), CAST(1 AS BIGINT), '', CAST(NULL AS BIGINT) FROM element UNION ALL
    SELECT part, k, CASE WHEN kind = type THEN next + 1 ELSE coalesce(next, 1000000000) END, id, CASE WHEN kind = type THEN next END
    FROM (SELECT n.*, para.kind FROM (SELECT s.part, e.k, e.id, e.type, CASE e.type WHEN 'proposition' THEN a.proposition WHEN 'proof' THEN a.proof ELSE a.note END AS next
      FROM step s JOIN element e ON e.part = s.part AND e.k = s.k + 1 LEFT JOIN ahead a ON a.part = s.part AND a.pos = s.place) n LEFT JOIN para ON para.part = n.part AND para.pos = n.next))
  SELECT id, md5(said) AS digest FROM (SELECT id, {_squeezed('text')} AS said FROM step JOIN para ON step.part = para.part AND took = pos) WHERE said <> ''"""

ORACLE_SQL = {
    "relation_pages": f"SELECT *, place // {PAGE} AS page FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY rank, label, predicate, subject, object, inferred) - 1 AS place FROM ({_PAGED}))",
    "child_pages": f"SELECT *, place // 2 AS page FROM (SELECT parent_id, id, type, sort_index, row_number() OVER (PARTITION BY parent_id ORDER BY sort_index, id) - 1 AS place FROM {_PASSAGES} WHERE parent_id IS NOT NULL)",
    "numbered_children": f"SELECT id, parent_id || '.' || type || CASE WHEN nth > 1 THEN CAST(nth AS VARCHAR) ELSE '' END AS numbered_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, type ORDER BY sort_index, id) AS nth FROM {_PASSAGES} WHERE parent_id IS NOT NULL)",
    "reading_order": f"SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM {_PASSAGES} WINDOW w AS (ORDER BY sort_index, id)",
    "section_runs": f"""SELECT id, section_kind, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (ORDER BY sort_index, id) AS BIGINT) AS run
      FROM (SELECT *, row_number() OVER w = 1 OR lag(section_kind) OVER w IS DISTINCT FROM section_kind AS new FROM {_PASSAGES} WHERE parent_id IS NULL WINDOW w AS (ORDER BY sort_index, id))""",
    "line_runs": """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
      b AS (SELECT *, row_number() OVER w AS nth, CAST(sum(CASE WHEN regexp_matches(line, '^[A-D]') THEN 1 ELSE 0 END) OVER w AS BIGINT) AS block FROM l WINDOW w AS (ORDER BY doc_id, pos))
      SELECT block, count(*) AS n, min(nth) AS first, max(nth) AS last, CASE WHEN block > 0 THEN md5(arg_min(line, nth)) END AS heading FROM b GROUP BY block""",
    "aligned_passages": _ALIGNED,
}
