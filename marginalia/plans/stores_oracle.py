"""DuckDB SQL for the queries of stores.py."""

from __future__ import annotations

from .oracle import _PASSAGES, _quoted, _t
from .stores import SEARCHED, WORDS

_ALL = _t("places", "parents", "classes", "orders")
_FOUND = " OR ".join(f"contains(lower({c}), query)" for c in SEARCHED)

ORACLE_SQL = {
    "store_patterns": f"""WITH t AS {_ALL} SELECT 's' AS asked, * FROM t WHERE s = 'C.7' UNION ALL SELECT 'o', * FROM t WHERE o = 'N.3'
      UNION ALL SELECT 'po', * FROM t WHERE p = 'type' AND o = 'Proposition' UNION ALL SELECT 'p', * FROM t WHERE p = 'partOf'""",
    "store_star": f"WITH t AS {_ALL} SELECT a.s, a.o AS cites, b.o AS inside, c.o AS class FROM t a JOIN t b ON a.s = b.s JOIN t c ON a.s = c.s WHERE a.p = 'cites' AND b.p = 'partOf' AND c.p = 'type'",
    "store_path": f"WITH t AS {_ALL} SELECT a.s, a.o AS via, b.o FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'cites' AND b.p = 'partOf'",
    "search_indexed": f"WITH q AS (SELECT unnest([{', '.join(_quoted(w.strip().lower()) for w in WORDS)}]) AS query) SELECT query, id FROM q, {_PASSAGES} p WHERE {_FOUND}",
}
