"""DuckDB SQL for the queries of inference.py."""

from __future__ import annotations

from .oracle import _t

_DEPENDS = "SELECT s, 'dependsUpon' AS p, o, o_kind FROM {t} WHERE p IN ('cites', 'provedBy')"
_INVERSE = "SELECT o AS s, CASE p WHEN 'hasCorollary' THEN 'derivedFrom' ELSE 'explainsElement' END AS p, s AS o, 'iri' AS o_kind FROM {t} WHERE p IN ('hasCorollary', 'hasNote') AND o_kind = 'iri'"

ORACLE_SQL = {
    "rules_compiled": f"""WITH t AS {_t("places", "brands", "supply")}, d AS ({_DEPENDS.format(t="t")})
      SELECT s, p, o, o_kind FROM d UNION {_INVERSE.format(t="t")} UNION SELECT a.s, 'transitivelyDependsOn', b.o, b.o_kind FROM d a JOIN d b ON a.o = b.s""",
    "rules_recursive": f"""WITH RECURSIVE t AS {_t("places", "parents")}, c AS (SELECT s, o FROM t WHERE p = 'cites'),
      r(s, o) AS (SELECT s, o FROM c UNION SELECT r.s, c.o FROM r JOIN c ON r.o = c.s)
      SELECT s, 'reaches' AS p, o, 'iri' AS o_kind FROM r UNION SELECT t.o, 'touchedBy', r.s, 'iri' FROM r JOIN t ON t.s = r.o WHERE t.p = 'partOf'""",
    "rules_given": f"""WITH t AS {_t("places", "parents", "classes")}, w AS (SELECT DISTINCT a.s AS x, b.o AS r FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'cites' AND b.p = 'partOf'),
      axioms AS (SELECT a.s, n.o AS k FROM t a JOIN t n ON a.s = n.s WHERE a.p = 'type' AND a.o = 'Axiom' AND n.p = 'number'),
      seen AS (SELECT w.x, axioms.s AS y FROM w JOIN t ON t.o = w.r AND t.p = 'partOf' JOIN axioms ON axioms.s = t.s WHERE k = '7')
      SELECT x AS s, 'within' AS p, r AS o, 'iri' AS o_kind FROM w UNION SELECT r, 'holds', x, 'iri' FROM w UNION SELECT s, 'numbered', k, 'literal' FROM axioms
      UNION SELECT x, 'sees', y, 'iri' FROM seen UNION SELECT x, 'kind', 'sees seven', 'literal' FROM seen""",
    "graph_kept_up": f"""WITH RECURSIVE places AS {_t("places")}, t AS (SELECT * FROM places WHERE s NOT LIKE 'N.%' OR s < o UNION SELECT * FROM {_t("brands")}),
      d AS ({_DEPENDS.format(t="t")}), far(s, o) AS (SELECT a.s, b.o FROM d a JOIN d b ON a.o = b.s UNION SELECT far.s, d.o FROM far JOIN d ON far.o = d.s)
      SELECT s, p, o, o_kind, 'stated' AS origin FROM t UNION ALL
      SELECT *, 'inferred' FROM (SELECT s, p, o, o_kind FROM d UNION {_INVERSE.format(t="t")} UNION SELECT s, 'transitivelyDependsOn', o, 'iri' FROM far EXCEPT SELECT s, p, o, o_kind FROM t)""",
}
