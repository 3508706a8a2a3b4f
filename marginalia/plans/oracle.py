"""DuckDB SQL with the results of plans/queries.py."""

from __future__ import annotations

import re

from marginalia.functions import html as H
from marginalia.functions import vocabulary as V
from marginalia.functions.citations import Family, families

from .tables import EVENTS

WORD = "the"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(column: str, values: dict[str, object], other: str = "NULL") -> str:
    when = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v) if isinstance(v, str) else v}" for k, v in values.items())
    return f"CASE {column} {when} ELSE {other} END"


def _roman(n: str) -> str:
    places = [(100, ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]), (10, ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]), (1, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])]
    digits = " || ".join(f"([{', '.join(map(_quoted, x))}])[CAST((({n}) // {p}) % 10 + 1 AS BIGINT)]" for p, x in places)
    return f"(repeat('M', CAST(({n}) // 1000 AS INTEGER)) || {digits})"


def _value(text: str) -> str:
    """Value of a numeral: a letter counts down if a larger one follows."""
    letters = f"list_transform(string_split(upper({text}), ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 END)"
    return f"CASE WHEN {text} = '' THEN 0 ELSE CAST(list_sum(list_transform({letters}, lambda v, i: CASE WHEN v < coalesce(list_max(list_slice({letters}, i + 1, len({letters}))), 0) THEN -v ELSE v END)) AS BIGINT) END"


def _capital(text: str) -> str:
    return f"(upper(substr({text}, 1, 1)) || substr({text}, 2))"


_GROUPS = {
    "orders": ["SELECT 'O.' || o_orderkey AS s, 'cites' AS p, 'C.' || o_custkey AS o, 'iri' AS o_kind FROM orders"],
    "places": [
        "SELECT 'C.' || c_custkey AS s, 'cites' AS p, 'N.' || c_nationkey AS o, 'iri' AS o_kind FROM customer",
        "SELECT 'S.' || s_suppkey, 'cites', 'N.' || s_nationkey, 'iri' FROM supplier",
        "SELECT 'N.' || n_nationkey, 'cites', 'N.' || ((n_nationkey * 3 + 1) % 25), 'iri' FROM nation",
        "SELECT 'N.' || n_nationkey, 'cites', 'N.' || ((n_nationkey * 7 + 2) % 25), 'iri' FROM nation",
    ],
    "parents": ["SELECT 'C.' || c_custkey AS s, 'partOf' AS p, 'N.' || c_nationkey AS o, 'iri' AS o_kind FROM customer", "SELECT 'N.' || n_nationkey, 'partOf', 'R.' || n_regionkey, 'iri' FROM nation"],
    "supply": ["SELECT 'P.' || l_partkey AS s, 'provedBy' AS p, 'S.' || l_suppkey AS o, 'iri' AS o_kind FROM lineitem"],
    "brands": ["SELECT 'P.' || p_partkey AS s, 'hasCorollary' AS p, 'B.' || p_brand AS o, 'iri' AS o_kind FROM part"],
    "events": [f"SELECT 'U.' || user_id AS s, {_cases('event_type', EVENTS)} AS p, 'V.' || (event_id % 50) AS o, 'iri' AS o_kind FROM events"],
    "notes": ["SELECT 'O.' || l_orderkey AS s, 'hasNote' AS p, 'P.' || l_partkey AS o, 'iri' AS o_kind FROM lineitem"],
    "classes": [
        "SELECT 'P.' || p_partkey AS s, 'type' AS p, 'Proposition' AS o, 'iri' AS o_kind FROM part",
        "SELECT 'C.' || c_custkey, 'type', 'Definition', 'iri' FROM customer",
        "SELECT 'S.' || s_suppkey, 'type', 'Proof', 'iri' FROM supplier",
        "SELECT 'N.' || n_nationkey, 'type', 'Axiom', 'iri' FROM nation",
        "SELECT 'N.' || n_nationkey, 'number', CAST(n_nationkey AS VARCHAR), 'literal' FROM nation",
    ],
}


def _t(*names: str) -> str:
    return "(SELECT DISTINCT * FROM (" + " UNION ALL ".join(x for n in names for x in _GROUPS[n]) + "))"


_PASSAGES = """(
  SELECT CASE WHEN turn = 0 THEN parent ELSE parent || '.' || type || turn END AS id, type, text, sort_index, section_kind,
    CASE WHEN turn <> 0 THEN parent END AS parent_id, part_number, part_numeral, role = 'system' AS is_editorial, turn,
    CASE type WHEN 'proof' THEN 'Proof' WHEN 'note' THEN 'Note' ELSE 'Proposition ' || ROMAN END AS canonical_label
  FROM (
    SELECT *, part_numeral || '.prop.' || (conv_id + 1) AS parent FROM (
      SELECT conv_id, turn, role, coalesce(text, '') AS text, conv_id * 1000 + turn AS sort_index,
        CASE WHEN turn = 0 THEN 'proposition' WHEN role = 'assistant' THEN 'proof' ELSE 'note' END AS type,
        (['propositions', 'lemmas', 'physical_axioms'])[(conv_id // 7) % 3 + 1] AS section_kind,
        CAST(conv_id % 5 + 1 AS INTEGER) AS part_number, (['I', 'II', 'III', 'IV', 'V'])[conv_id % 5 + 1] AS part_numeral
      FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL)))""".replace("ROMAN", _roman("conv_id + 1"))

_HIT = f"(contains(lower(text), '{WORD}') OR contains(lower(canonical_label), '{WORD}') OR contains(lower(id), '{WORD}'))"
_SELECTABLE = f"(SELECT a.* FROM (SELECT * FROM {_PASSAGES}) a LEFT JOIN (SELECT DISTINCT id AS pid FROM {_PASSAGES} WHERE {_HIT}) b ON a.parent_id = b.pid WHERE {_HIT.replace('(text)', '(a.text)')} OR b.pid IS NOT NULL)"

_SENTENCE = """'By Pt. ' || part || '., Prop. ' || a || ', Coroll. ' || b || '; (Pt. ' || part || ' Def. ' || b || '), (' || lower(part) || '. ' || b || '. Coroll.), ' || lower(part) || '. Ax. ' || b
  || ', Prop. ' || a || ', Def. ' || b || ' and ' || lower(a) || ', Ax. i, Lemma ' || b || ' and Post. ' || b || '.'"""
_LOWER_PART = "(['i', 'II', 'iii', 'IV', 'v'])[o_orderkey % 5 + 1]"
_A, _B = _roman("o_custkey % 60 + 1"), f"lower({_roman('o_orderkey % 40 + 1')})"
_TEXTS = f"""(SELECT DISTINCT upper(part) || '.prop.' || n AS id, {_SENTENCE} AS text
  FROM (SELECT {_LOWER_PART} AS part, {_A} AS a, {_B} AS b, o_orderkey % 97 + 1 AS n FROM orders))"""


def _pattern(p: str) -> str:
    spaces = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
    return _quoted(re.sub(r"(\[?)\\s", lambda m: f"[{spaces}" if m[1] else f"[{spaces}]", p))


def _family(rank: int, f: Family, build: bool) -> str:
    """(id, rank, k, g, reference) of one family; k: which match, g: which number in it."""

    def group(k: int) -> str:
        return f"coalesce(regexp_extract_all(text, {_pattern(f.pattern)}, {k}, 'i')[k], '')"

    number = f"list_transform([{', '.join(group(k) for k in f.numbers)}], lambda x: {_value('x')})"
    part = group(f.part) if f.part else "''"
    roman = (_roman(_value("raw_part")) if build else "upper(raw_part)") if f.part else "split_part(id, '.', 1)"
    kind = group(f.kind) if isinstance(f.kind, int) else _quoted(f.kind)
    low = "CASE WHEN lower(raw_kind) LIKE 'def%' THEN 'def' WHEN lower(raw_kind) LIKE 'ax%' THEN 'ax' WHEN lower(raw_kind) LIKE 'lemma%' THEN 'lemma' WHEN lower(raw_kind) LIKE 'post%' THEN 'post' ELSE 'prop' END" if isinstance(f.kind, int) else "raw_kind"
    corollary = _value(group(f.corollary)) if f.corollary else "0"
    return f"""SELECT id, {rank} AS rank, k, g, part || '.' || kind || '.' || n || CASE WHEN coroll <> 0 AND kind = 'prop' THEN '.corollary' || coroll ELSE '' END AS reference FROM (
      SELECT id, k, g, {roman} AS part, {low} AS kind, numbers[g] AS n, coroll FROM (
        SELECT id, k, {part} AS raw_part, {kind} AS raw_kind, {number} AS numbers, {corollary} AS coroll
        FROM (SELECT *, unnest(range(1, len(regexp_extract_all(text, {_pattern(f.pattern)}, 0, 'i')) + 1)) AS k FROM texts)), unnest(range(1, {len(f.numbers)} + 1)) AS u(g))
      WHERE n <> 0 AND {"part IN ('I', 'II', 'III', 'IV', 'V')" if f.part else "true"}"""


def _references(build: bool, source: str = _TEXTS) -> str:
    """WITH texts(id, text), refs(id, text_no, place, reference), one row a distinct reference of a text."""
    union = " UNION ALL ".join(_family(r, f, build) for r, f in enumerate(families(build)))
    return f"""WITH source AS {source}, numbered AS (SELECT id AS own, text, row_number() OVER (ORDER BY id, text) AS id_no FROM source),
    texts AS (SELECT own || '#' || id_no AS id, text FROM numbered), found AS ({union}),
    firsts AS (SELECT id, reference, min((rank, k, g)) AS place FROM found WHERE reference <> split_part(id, '#', 1) GROUP BY ALL),
    refs AS (SELECT split_part(id, '#', 1) AS id, reference, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS pos FROM firsts)"""


def _walk(edges: str, limit: int | None) -> str:
    """walk(origin, node, d): least distances along edges(src, dst)."""
    stop = f" WHERE w.d < {limit}" if limit else " WHERE w.d < 40"
    return f"""WITH RECURSIVE edges AS (SELECT DISTINCT src, dst FROM ({edges}) WHERE src <> dst), steps(origin, node, d) AS (
      SELECT src, dst, 1 FROM edges UNION SELECT w.origin, e.dst, w.d + 1 FROM steps w JOIN edges e ON w.node = e.src{stop}
    ), walk AS (SELECT origin, node, min(d) AS d FROM steps WHERE origin <> node GROUP BY ALL)"""




def _depth_first(edges: str, roots: str, limit: int) -> str:
    """The lines of depth-first walks, with a stack for each origin; to stand behind WITH RECURSIVE."""
    return f"""kids AS (SELECT s, list(o ORDER BY o DESC) AS below FROM ({edges}) GROUP BY s),
      walk(origin, todo, depths, seen, node, depth, fresh) AS (
        SELECT DISTINCT s, [s], [0], CAST([] AS VARCHAR[]), '', 0, false FROM ({roots}) UNION ALL
        SELECT origin, list_concat(todo[1:-2], CASE WHEN new THEN coalesce(below, []) ELSE [] END), list_concat(depths[1:-2], CASE WHEN new THEN list_transform(coalesce(below, []), lambda x: deep + 1) ELSE [] END),
          CASE WHEN new THEN list_append(seen, top) ELSE seen END, top, deep, new
        FROM (SELECT *, deep <= {limit} AND NOT list_contains(seen, top) AS new FROM (SELECT *, todo[-1] AS top, depths[-1] AS deep FROM walk WHERE len(todo) > 0)) LEFT JOIN kids ON kids.s = top)
      SELECT origin, CAST(len(seen) - 1 AS BIGINT) AS place, node, CAST(depth AS BIGINT) AS depth FROM walk WHERE fresh"""


_PLACES = f"SELECT s AS src, o AS dst FROM {_t('places')}"
_BACK = f"SELECT o AS src, s AS dst FROM {_t('places')}"
_INFERRED = f"(SELECT s, 'dependsUpon' AS p, o FROM {_t('places')} UNION SELECT o, 'derivedFrom', s FROM {_t('brands')})"
_INVERSE = _cases("p", V.INVERSE_NAMES, "'inverse_' || p")


def _relations(*groups: str) -> str:
    told = f"SELECT s, p, o, false AS inferred FROM {_t(*groups)} WHERE p IN ({', '.join(map(_quoted, V.STATED_RELATIONS))}) UNION ALL SELECT s, p, o, true FROM {_INFERRED}"
    return f"(SELECT s AS element_id, s AS subject, p AS predicate, o AS object, inferred FROM ({told}) UNION SELECT o, s, {_INVERSE}, o, inferred FROM ({told}))"


def _label(p: str) -> str:
    return _cases(p, V.INVERSE_LABELS, f"trim({_capital(f'''regexp_replace({p}, '([A-Z])', ' \\1', 'g')''')})")


def _rank(p: str) -> str:
    return f"CASE WHEN contains(regexp_replace({p}, '^inverse_', ''), 'transitively') THEN 2 ELSE 1 END"


def _stripped() -> str:
    out = "coalesce(html, '')"
    for pattern, by in H.MARKUP:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(by)}, 'gi')"
    out = f"regexp_replace({out}, '&aelig;', 'ae', 'gi')"
    for entity, char in H.ENTITIES:
        out = f"replace({out}, {_quoted(entity)}, {_quoted(char)})"
    return f"replace({out}, chr(13), '')"


def _trim(text: str) -> str:
    spaces = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
    return f"regexp_replace({text}, '^[{spaces}]+|[{spaces}]+$', '', 'g')"


def _squeezed(text: str) -> str:
    spaces = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
    return f"regexp_replace(regexp_replace({text}, '[{spaces}]+', ' ', 'g'), '^ | $', '', 'g')"


def _cut(text: str, n: int, ending: str) -> str:
    return f"CASE WHEN length({text}) > {n} THEN substr({text}, 1, {n}) || '{ending}' ELSE {text} END"


_WEIGHTED = f"SELECT s AS src, o AS dst, p FROM {_t('places', 'supply')}"
_CHAINS = f"SELECT s, p, o FROM {_INFERRED} WHERE p = 'dependsUpon' UNION SELECT a.src, 'transitivelyDependsOn', b.dst FROM ({_PLACES}) a JOIN ({_PLACES}) b ON a.dst = b.src"
_LINES = f"""(SELECT CAST(conv_id // 500 AS VARCHAR) AS book, conv_id, turn, role,
  {_squeezed("regexp_replace(coalesce(text, ''), '[.:]+', ' ', 'g')")} AS said FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL)"""

_EDITORIAL = """CASE WHEN is_editorial THEN ' editorial="true"' ELSE '' END"""


def _escaped_text(column: str) -> str:
    out = column
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return out


ORACLE_SQL = {
    "top_cited": f"SELECT row_number() OVER (ORDER BY n DESC, id) AS rank, id, n FROM (SELECT o AS id, count(*) AS n FROM {_t('orders', 'places')} WHERE p = 'cites' GROUP BY o ORDER BY n DESC, id LIMIT 10)",
    "outward_citations": f"SELECT s AS id, o AS other, {_cut('c_name', 12, '...')} AS preview FROM {_t('orders', 'places')} t LEFT JOIN customer c ON t.o = 'C.' || c.c_custkey WHERE p = 'cites'",
    "inward_citations": f"SELECT o AS id, count(*) AS n, min(s) AS first FROM {_t('orders', 'places')} WHERE p = 'cites' GROUP BY o",
    "consequences": f"SELECT o AS id, s AS other FROM {_t('events')} WHERE p = 'necessarilyFollows'",
    "reductio_subjects": f"SELECT DISTINCT s AS id FROM {_t('events')} WHERE p = 'refutedByAbsurdity'",
    "elements_of_class": f"SELECT s AS id, o AS class FROM {_t('classes')} WHERE p = 'type' AND o IN ('Axiom', 'Definition')",
    "graph_counts": f"WITH t AS {_t('classes', 'supply', 'brands')} SELECT 'triples' AS name, count(*) AS n FROM t UNION ALL SELECT o, count(*) FROM t WHERE p = 'type' GROUP BY o",
    "several_proofs": f"SELECT s AS id, count(*) AS n FROM {_t('supply')} GROUP BY s HAVING count(*) > 1",
    "relation_counts": f"SELECT p AS relation, count(*) AS n FROM {_t('events', 'supply', 'orders')} WHERE p IN ({', '.join(map(_quoted, V.ARGUMENT_RELATIONS))}) GROUP BY p",
    "merge_stores": f"SELECT p, o_kind, count(*) AS n FROM (SELECT * FROM {_t('places', 'parents')} UNION SELECT * FROM {_t('parents', 'brands')}) GROUP BY ALL",
    "backfill": f"WITH a AS {_t('places', 'classes')}, b AS {_t('parents', 'classes', 'brands')} SELECT *, 'canonical' AS origin FROM a UNION ALL SELECT *, 'backfill' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "project_invert": f"SELECT s, 'dependsUpon' AS p, o, 'iri' AS o_kind FROM {_t('supply')} UNION SELECT o, 'derivedFrom', s, 'iri' FROM {_t('brands')}",
    "transitive_closure": f"{_walk(_PLACES, None)} SELECT origin AS src, node AS dst FROM walk WHERE d > 1",
    "rules_two_hops": f"SELECT DISTINCT a.src, b.dst FROM ({_PLACES}) a JOIN ({_PLACES}) b ON a.dst = b.src",
    "apply_rules": f"SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM (SELECT s, p, o FROM {_INFERRED} UNION SELECT a.src, 'transitivelyDependsOn', b.dst FROM ({_PLACES}) a JOIN ({_PLACES}) b ON a.dst = b.src) GROUP BY p",
    "influence": f"{_walk(_BACK, 4)} SELECT origin AS id, CAST(sum(6 - d) AS BIGINT) AS influence FROM walk GROUP BY origin",
    "dependency_depth": f"{_walk(_PLACES, 12)} SELECT origin AS id, CAST(max(d) AS BIGINT) AS depth FROM walk GROUP BY origin",
    "element_weights": f"""WITH RECURSIVE t AS ({_WEIGHTED}), edges AS (SELECT DISTINCT src, dst FROM t WHERE src <> dst),
      back(origin, node, d) AS (SELECT dst, src, 1 FROM edges UNION SELECT w.origin, e.src, w.d + 1 FROM back w JOIN edges e ON w.node = e.dst WHERE w.d < 4),
      ahead(origin, node, d) AS (SELECT src, dst, 1 FROM edges UNION SELECT w.origin, e.dst, w.d + 1 FROM ahead w JOIN edges e ON w.node = e.src WHERE w.d < 12),
      reach AS (SELECT origin, CAST(sum(6 - d) AS DOUBLE) AS influence FROM (SELECT origin, node, min(d) AS d FROM back WHERE origin <> node GROUP BY ALL) GROUP BY origin),
      deep AS (SELECT origin, max(d) AS depth FROM (SELECT origin, node, min(d) AS d FROM ahead WHERE origin <> node GROUP BY ALL) GROUP BY origin),
      w AS (SELECT *, CASE p WHEN 'provedBy' THEN 2.0 ELSE 1.0 END AS weight FROM t),
      own AS (SELECT s AS element_id, {_cases('o', {c: V.BASE_SCORES.get(t, 1.0) for c, t in V.CLASS_TYPES.items()})} AS base FROM {_t('classes')} WHERE p = 'type'),
      told AS (SELECT element_id, base, coalesce(i.x, 0.0) AS i, coalesce(o.x, 0.0) AS o, coalesce(influence, 0.0) AS f, coalesce(depth, 0) AS depth FROM own
        LEFT JOIN (SELECT dst, CAST(sum(weight) AS DOUBLE) AS x FROM w GROUP BY dst) i ON i.dst = element_id LEFT JOIN (SELECT src, CAST(sum(weight) AS DOUBLE) AS x FROM w GROUP BY src) o ON o.src = element_id
        LEFT JOIN reach ON reach.origin = element_id LEFT JOIN deep ON deep.origin = element_id)
      SELECT element_id, CAST(i AS DOUBLE) AS inbound_weight, CAST(o AS DOUBLE) AS outbound_weight, CAST(f AS DOUBLE) AS transitive_influence,
        round(CAST(greatest(0.0, base + i * 1.5 + f * 0.2 + CASE WHEN o = 0 THEN 1.0 ELSE least(1.0, i / o) END * 5) AS DOUBLE), 6) AS foundational_score,
        CAST(depth AS BIGINT) AS dependency_depth, CAST(floor(f / 10 + 0.5) AS BIGINT) AS influence_reach FROM told""",
    "relations_all": f"SELECT * FROM {_relations('places', 'parents', 'classes')}",
    "relation_groups": f"SELECT element_id, predicate, {_label('predicate')} AS label, CAST({_rank('predicate')} AS BIGINT) AS rank, count(*) AS n FROM {_relations('places', 'parents')} GROUP BY element_id, predicate",
    "chains_first": f"""WITH t AS ({_CHAINS}), c AS (
        SELECT s AS element_id, CASE p WHEN 'dependsUpon' THEN 1 ELSE 0 END AS rank, s, p, o FROM t UNION ALL SELECT o, CASE p WHEN 'dependsUpon' THEN 3 ELSE 2 END, s, p, o FROM t),
      d AS (SELECT element_id, s, p, o, min(rank) AS rank FROM c GROUP BY ALL)
      SELECT element_id, (['transitive_dependency', 'dependency', 'inverse_transitive_dependency', 'inverse_dependency'])[rank + 1] AS type, s AS start, o AS end, p AS relationship, CAST(1 AS BIGINT) AS length, o AS path_to
      FROM d QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY rank, s, o) <= 12""",
    "trace_levels": f"""WITH RECURSIVE t AS {_t('places', 'parents')}, cites AS (SELECT s AS src, o AS dst FROM t WHERE p = 'cites'),
      edges AS (SELECT * FROM cites UNION SELECT t.o, c.dst FROM t JOIN cites c ON t.s = c.src WHERE t.p = 'partOf' AND t.o NOT IN (SELECT src FROM cites)),
      steps(origin, node, d) AS (SELECT src, dst, 1 FROM edges WHERE src <> dst UNION SELECT w.origin, e.dst, w.d + 1 FROM steps w JOIN edges e ON w.node = e.src WHERE w.d < 3 AND e.src <> e.dst)
      SELECT origin, node, CAST(min(d) AS BIGINT) AS d FROM steps WHERE origin <> node GROUP BY ALL""",
    "trace_depth_first": f"""WITH RECURSIVE t AS (SELECT DISTINCT s, o FROM {_t('places')}), {_depth_first('SELECT s, o FROM t', 'SELECT s FROM t', 2)}""",
    "trace_fallback": f"""WITH RECURSIVE t AS {_t('places', 'parents')}, cites AS (SELECT s, o FROM t WHERE p = 'cites'),
      edges AS (SELECT * FROM cites UNION SELECT t.o, c.o FROM t JOIN cites c ON t.s = c.s WHERE t.p = 'partOf' AND t.o NOT IN (SELECT s FROM cites)),
      {_depth_first('SELECT s, o FROM edges', 'SELECT s FROM t UNION SELECT o FROM t', 3)}""",
    "passage_markup": f"""WITH p AS (SELECT *, sort_index // 500000 + 1 AS file FROM {_PASSAGES}),
      inner_ AS (SELECT parent_id, string_agg('      <' || type || ' id="' || id || '"' || {_EDITORIAL} || '>' || chr(10) || '        <text>' || {_escaped_text('text')} || '</text>' || chr(10) || '      </' || type || '>', chr(10) ORDER BY sort_index) AS inside FROM p WHERE parent_id IS NOT NULL GROUP BY parent_id),
      tops AS (SELECT p.*, lag(section_kind) OVER (PARTITION BY file ORDER BY sort_index) IS DISTINCT FROM section_kind AS new,
        '    <prop id="' || id || '"' || {_EDITORIAL} || '>' || chr(10) || '      <text>' || {_escaped_text('text')} || '</text>' || coalesce(chr(10) || inside, '') || chr(10) || '    </prop>' AS xml
        FROM p LEFT JOIN inner_ i ON i.parent_id = p.id WHERE p.parent_id IS NULL),
      runs AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY sort_index) AS run FROM tops),
      sections AS (SELECT file, run, '  <section type="' || section_kind || '" id="' || {_roman('file')} || '.' || section_kind || '">' || chr(10) || string_agg(xml, chr(10) ORDER BY sort_index) || chr(10) || '  </section>' AS xml FROM runs GROUP BY file, run, section_kind),
      files AS (SELECT file, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<part id="' || {_roman('file')} || '" number="' || file || '" title="' || {_cases('CAST(file AS VARCHAR)', {str(k): v for k, v in V.PART_TITLES.items()}, "''")} || '">' || chr(10) || string_agg(xml, chr(10) ORDER BY run) || chr(10) || '</part>' || chr(10) AS xml FROM sections GROUP BY file)
      SELECT CAST(file AS INTEGER) AS part_number, length(xml) AS chars, md5(xml) AS digest FROM files""",
    "cyclic_nodes": f"{_walk(_PLACES, None)}, e AS ({_PLACES}) SELECT DISTINCT origin AS id FROM walk JOIN e ON walk.node = e.src AND walk.origin = e.dst UNION SELECT src FROM e WHERE src = dst",
    "roman_numerals": f"SELECT o_orderkey, {_roman('o_orderkey % 3999 + 1')} AS roman, CAST(o_orderkey % 3999 + 1 AS BIGINT) AS value FROM orders",
    "relation_labels": f"""WITH p AS (SELECT DISTINCT p FROM {_t('events', 'places', 'parents', 'supply', 'brands')}), n AS (SELECT p, p AS name FROM p UNION ALL SELECT p, {_INVERSE} FROM p UNION ALL SELECT p, 'inverse_' || p FROM p)
      SELECT p, name, {_label('name')} AS label, lower(regexp_replace(name, '([A-Z])', ' \\1', 'g')) AS phrase, CAST({_rank('name')} AS BIGINT) AS rank FROM n""",
    "passage_labels": f"""SELECT id, canonical_label, variant AS variant_label, {_capital('type')} || ' ' || nullif(turn, 0) AS spoken, {_cases('section_kind', V.SECTION_LABELS)} AS section, CAST(part_number AS BIGINT) AS part,
      CASE WHEN part_number <= 2 THEN substr(id, length(part_numeral) + 2) ELSE id END AS reference,
      concat_ws(';', CASE WHEN variant IS NOT NULL THEN {_capital('type')} || ' ' || turn || '/ink' END, CASE WHEN is_editorial THEN 'Editorial/rose' END, CASE WHEN is_editorial THEN 'English-Based/rose' ELSE 'Latin-Based/green' END) AS chips
      FROM (SELECT *, CASE WHEN turn <> 0 THEN type || turn END AS variant FROM {_PASSAGES})""",
    "humanised_tokens": f"SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(replace(p_name, ' ', '-') || '_' || lower(p_type), '[_.-]+'), lambda x: x <> ''), lambda x: {_capital('x')}), ' ') AS name FROM part",
    "previews": f"SELECT doc_id, {_cut('text', 140, '…')} AS short, {_cut('text', 220, '…')} AS card, {_cut('text', 200, '...')} AS hint FROM documents",
    "search_visible": f"WITH p AS {_PASSAGES} SELECT id, sort_index FROM p WHERE parent_id IS NULL AND ({_HIT} OR id IN (SELECT parent_id FROM p WHERE parent_id IS NOT NULL AND {_HIT}))",
    "search_selectable": f"WITH p AS {_PASSAGES} SELECT id, sort_index FROM p WHERE {_HIT} OR parent_id IN (SELECT id FROM p WHERE {_HIT})",
    "search_neighbours": f"WITH p AS {_PASSAGES}, q AS (SELECT * FROM p WHERE {_HIT} OR parent_id IN (SELECT id FROM p WHERE {_HIT})) SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM q WINDOW w AS (PARTITION BY sort_index // 500000 ORDER BY sort_index, id)",
    "section_summary": f"SELECT section_kind AS kind, {_cases('section_kind', V.SECTION_LABELS)} AS label, count(*) AS count, min(sort_index) AS first_index FROM {_PASSAGES} WHERE parent_id IS NULL GROUP BY section_kind",
    "section_starts": f"SELECT id, coalesce(lag(section_kind) OVER (PARTITION BY sort_index // 500000 ORDER BY sort_index, id) <> section_kind, true) AS shows_heading FROM {_PASSAGES} WHERE parent_id IS NULL",
    "children_by_parent": f"SELECT parent_id, string_agg(id, ',' ORDER BY sort_index) AS ids, count(*) AS n FROM {_PASSAGES} WHERE parent_id IS NOT NULL GROUP BY parent_id",
    "parallel_texts": """SELECT id, latin_text, lang AS english, coalesce(latin_text, '(none)') AS latin, concat_ws(chr(10) || chr(10), lang, latin_text) AS both
      FROM (SELECT CAST(d.doc_id AS VARCHAR) AS id, lang, nullif(repeat('q', l.quality), '') AS latin_text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "citations_found": f"{_references(False)} SELECT reference, count(*) AS n, count(DISTINCT id) AS passages, max(pos) AS last FROM refs GROUP BY reference",
    "citations_known": f"{_references(True)} SELECT reference AS id, count(DISTINCT id) AS n FROM refs WHERE reference IN (SELECT own FROM numbered) GROUP BY reference",
    "page_paragraphs": f"""WITH split AS (SELECT page_id, list_filter(list_transform(string_split_regex({_stripped()}, '\\n\\s*\\n+'), lambda p: {_trim("regexp_replace(regexp_replace(p, '[ \t]+', ' ', 'g'), '\\n+', ' ', 'g')")}), lambda p: p <> '') AS parts FROM pages)
      SELECT page_id, CAST(unnest(range(0, len(parts))) AS BIGINT) AS pos, md5(unnest(parts)) AS digest FROM split""",
    "url_components": "SELECT page_id, replace(replace(replace(replace(replace(url_encode(url || ' (a+b)*'), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS coded, url || ' (a+b)*' AS back FROM pages",
    "text_blocks": """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
      b AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(line, '^[A-D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS block FROM l)
      SELECT doc_id, block, count(*) AS n, CAST(min(pos) AS BIGINT) AS first, CAST(sum(length(line)) AS BIGINT) AS chars FROM b GROUP BY ALL""",
    "child_counters": f"SELECT id, parent_id || '.' || type || CASE WHEN nth > 1 THEN CAST(nth AS VARCHAR) ELSE '' END AS numbered_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, type ORDER BY sort_index) AS nth FROM {_PASSAGES} WHERE parent_id IS NOT NULL)",
    "first_of_text": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "paragraph_rows": f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\\n{{2,}}'), lambda x: {_trim('x')}), lambda x: x <> '') AS parts FROM documents)
      SELECT doc_id AS id, CAST(unnest(range(0, len(parts))) AS BIGINT) AS pos, 'en' AS language, md5(unnest(parts)) AS digest FROM p""",
    "escaped_markup": f"SELECT page_id, md5({_escaped_text('html')}) AS digest FROM pages",
    "triple_statements": f"""WITH t AS {_t('parents', 'classes', 'brands')}, o AS (SELECT s, p, string_agg(CASE WHEN o_kind = 'iri' THEN '<http://example.org/passages#' || o || '>' ELSE o END, ', ' ORDER BY CASE WHEN o_kind = 'iri' THEN '<http://example.org/passages#' || o || '>' ELSE o END) AS o FROM t GROUP BY s, p)
      SELECT s, '<http://example.org/passages#' || s || '> ' || string_agg(CASE p WHEN 'type' THEN 'a' ELSE '<http://example.org/passages#' || p || '>' END || ' ' || o, ' ;' || chr(10) || '    ' ORDER BY p <> 'type', p) AS statement FROM o GROUP BY s""",
    "corpus_passages": f"""WITH l AS {_LINES}, i AS (SELECT *, (['I.def.', 'I.ax.', 'IV.prop.'])[conv_id % 3 + 1] || (conv_id + 1) AS item, CASE WHEN turn = 0 THEN (['definition', 'axiom', 'proposition'])[conv_id % 3 + 1] WHEN role = 'assistant' THEN 'proof' ELSE 'note' END AS type FROM l),
      n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, type ORDER BY turn) AS nth FROM i)
      SELECT book AS key, CASE WHEN turn = 0 THEN item ELSE item || '.' || type || CASE WHEN nth > 1 THEN CAST(nth AS VARCHAR) ELSE '' END END AS id, type, CASE WHEN turn = 0 THEN CAST(conv_id + 1 AS VARCHAR) END AS number,
        CASE WHEN turn <> 0 THEN item END AS parent_id, md5(said) AS digest FROM n""",
}
