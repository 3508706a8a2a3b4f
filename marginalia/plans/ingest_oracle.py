"""DuckDB SQL with the results of plans/ingest.py."""

from __future__ import annotations

from marginalia.functions import vocabulary as V
from marginalia.sources.triples import NAMESPACE

from .oracle import _A, _B, _HIT, _LOWER_PART, _PASSAGES, _PLACES, _SENTENCE, _cases, _quoted, _references, _roman, _squeezed, _stripped, _t, _trim, _walk

_OUT_OF_LATIN1 = r"[^\x{00}-\x{FF}]"
#: Passages as they come back from XML: squeezed, without blank ones, which take no place in the order.
_READ = f"""(SELECT *, row_number() OVER (PARTITION BY part_no ORDER BY sort_at) AS place FROM (
  SELECT * REPLACE ({_squeezed('text')} AS text), sort_index AS sort_at, sort_index // 500000 + 1 AS part_no FROM {_PASSAGES}) WHERE text <> '')"""
_VARIANT = "CASE WHEN turn <> 0 THEN type || turn END"

_TOP = f"(SELECT upper({_LOWER_PART}) || '.prop.' || o_orderkey AS top, o_orderkey, o_orderpriority, {_LOWER_PART} AS part, {_A} AS a, {_B} AS b FROM orders)"
_PROOFS = f"(SELECT top || '.proof' AS id, {_SENTENCE} AS text FROM {_TOP})"


def _known(build: bool) -> str:
    """... refs(id, reference): WITH clauses for citations in proofs, of passages that are there."""
    # a marked-up proposition's entry has all the text inside it, its proof's too
    source = f"(SELECT top AS id, o_orderpriority || ' ' || {_SENTENCE} AS text FROM {_TOP} UNION ALL SELECT * FROM {_PROOFS})" if build else _PROOFS
    return f"""{_references(build, source)}, ids AS (SELECT top AS known FROM {_TOP} UNION SELECT top || '.proof' FROM {_TOP}),
    cited AS (SELECT DISTINCT id, reference FROM refs JOIN ids ON reference = known)"""


def _graph(build: bool) -> str:
    """Triples of the orders' passages, as SELECTs."""
    both = f"(SELECT top AS id, 'Proposition' AS c FROM {_TOP} UNION ALL SELECT top || '.proof', 'Proof' FROM {_TOP})"
    return f"""SELECT id AS s, 'type' AS p, c AS o, 'iri' AS o_kind FROM {both} UNION ALL SELECT top || '.proof', 'partOf', top, 'iri' FROM {_TOP} UNION ALL SELECT top, 'provedBy', top || '.proof', 'iri' FROM {_TOP}
    UNION ALL SELECT id, 'cites', reference, 'iri' FROM cited"""


_LIBRARY = f"""explicit AS (SELECT s, p, o FROM {_t('places', 'classes')} UNION SELECT id, 'type', CASE type WHEN 'proposition' THEN 'Proposition' WHEN 'proof' THEN 'Proof' ELSE 'Note' END FROM r
    UNION SELECT id, 'partOf', parent_id FROM r WHERE parent_id IS NOT NULL UNION SELECT parent_id, CASE type WHEN 'proof' THEN 'provedBy' ELSE 'hasNote' END, id FROM r WHERE parent_id IS NOT NULL)"""


def _one_decimal(v: str) -> str:
    """printf() rounds by the exact value and exact ties to even; ties here are quarters."""
    n = f"CAST(floor(abs({v}) * 10 + 0.5) AS BIGINT)"
    up = f"CASE WHEN {v} < 0 THEN '-' ELSE '' END || {n} // 10 || '.' || {n} % 10"
    return f"CASE WHEN {v} * 4 = floor({v} * 4) AND {v} * 2 <> floor({v} * 2) THEN {up} ELSE printf('%.1f', {v}) END"


ORACLE_SQL = {
    "n3_written": f"SELECT * FROM {_t('parents', 'classes', 'places')}",
    "n3_whole": """WITH d AS (SELECT *, CASE WHEN doc_id // 500 % 2 = 0 THEN '' ELSE 'odd.' END AS x FROM documents), t AS (
      SELECT x || 'D.' || doc_id AS s, 'type' AS p, x || 'Passage' AS o, 'iri' AS o_kind FROM d UNION ALL SELECT x || 'D.' || doc_id, x || 'text', coalesce(text, ''), 'literal' FROM d
      UNION ALL SELECT '[]', x || 'of', x || 'D.' || doc_id, 'iri' FROM d UNION ALL SELECT '[]', x || 'lang', lang, 'literal' FROM d UNION ALL SELECT '[]', x || 'in', x || 'S.' || source, 'iri' FROM d)
      SELECT s, p, md5(o) AS digest, o_kind, count(*) AS n FROM t GROUP BY ALL""",
    "n3_abbreviated": """SELECT DISTINCT * FROM (SELECT 'P.' || p_partkey AS s, 'type' AS p, 'Proposition' AS o, 'iri' AS o_kind FROM part UNION ALL SELECT 'P.' || p_partkey, 'label', replace(p_name, ' ', ' "'), 'literal' FROM part
      UNION ALL SELECT 'P.' || p_partkey, 'cites', 'B.' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'), 'iri' FROM part UNION ALL SELECT 'P.' || p_partkey, 'cites', 'S.' || p_size, 'iri' FROM part UNION ALL SELECT 'P.' || p_partkey, 'number', CAST(p_size AS VARCHAR), 'literal' FROM part)""",
    "iri_names": f"SELECT s, '{NAMESPACE}' || s AS iri, s AS name, o FROM {_t('parents')}",
    "ordered_xml": f"""SELECT id, type, md5(text) AS digest, place AS sort_index, section_kind, parent_id, CAST(part_no AS BIGINT) AS part_number, is_editorial,
      CASE WHEN is_editorial THEN 'english_structural' ELSE 'latin_governed' END AS source_authority, {_VARIANT} AS variant_label FROM {_READ}""",
    "explorer_outline": f"SELECT id, type, md5(text) AS digest, parent_id FROM {_READ} WHERE turn = 0 OR type IN ('proof', 'note')",
    "marked_appendix": f"""WITH p AS (SELECT *, p_partkey // 500 AS file, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) AS nth FROM part), f AS (SELECT file, count(*) AS n FROM p GROUP BY file),
      r AS (SELECT 'I.def.' || p_partkey AS id, 'definition' AS type, nth AS place, NULL AS heading, NULL AS kind, p_name || ' ' || p_type || chr(10) || chr(10) || '1. ' || p_brand || chr(10) || chr(10) || p_type AS text FROM p
        UNION ALL SELECT 'I.appendix.introduction', 'appendix', n + 1, 'Appendix Introduction', 'synthetic_heading', 'To begin with' FROM f
        UNION ALL SELECT 'I.appendix.argument.' || nth, 'appendix', n + 1 + nth, CASE WHEN p_partkey % 2 = 0 THEN 'Caput ' || {_roman('p_partkey + 1')} ELSE 'Appendix Section' END, CASE WHEN p_partkey % 2 = 1 THEN 'synthetic_heading' END, p_name FROM p JOIN f USING (file))
      SELECT id, count(*) AS n, min(type) AS type, CAST(min(place) AS BIGINT) AS first_index, min(heading) AS heading, min(kind) AS editorial_kind, md5(string_agg(text, '|' ORDER BY text)) AS digest FROM r GROUP BY id""",
    "explicit_graph": f"""{_known(True)}, g AS ({_graph(True)} UNION ALL SELECT top, 'number', CAST(o_orderkey AS VARCHAR), 'literal' FROM {_TOP}
      UNION ALL SELECT unnest([top, top || '.proof']), 'partNumber', CAST(o_orderkey // 500 + 1 AS VARCHAR), 'literal' FROM {_TOP}) SELECT p, o_kind, o, count(*) AS n, min(s) AS first FROM g GROUP BY ALL""",
    "supplemental_graph": f"{_known(False)}, g AS ({_graph(False)}) SELECT p, o, count(*) AS n, min(s) AS first FROM g GROUP BY ALL",
    "inferred_graph": f"""{_walk(_PLACES, None)}, i AS (SELECT s, 'dependsUpon' AS p, o FROM {_t('places')} UNION SELECT o, 'derivedFrom', s FROM {_t('brands')} UNION SELECT o, 'explainsElement', s FROM {_t('notes')}
      UNION SELECT origin, 'transitivelyDependsOn', node FROM walk WHERE d > 1) SELECT p, o, count(*) AS n, min(s) AS first FROM i GROUP BY p, o""",
    "parallel_json": "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
    "latin1_pages": f"""WITH split AS (SELECT page_id, list_filter(list_transform(string_split_regex({_stripped().replace("coalesce(html, '')", f"regexp_replace(coalesce(html, ''), {_quoted(_OUT_OF_LATIN1)}, '?', 'g')")}, '\\n\\s*\\n+'), lambda p: {_trim("regexp_replace(regexp_replace(p, '[ \t]+', ' ', 'g'), '\\n+', ' ', 'g')")}), lambda p: p <> '') AS parts FROM pages)
      SELECT page_id, CAST(unnest(range(0, len(parts))) AS BIGINT) AS pos, md5(unnest(parts)) AS digest FROM split""",
    "library_store": f"""{_walk(f"{_PLACES} UNION SELECT parent_id, id FROM {_READ} WHERE type = 'proof' AND parent_id IS NOT NULL", None)}, r AS {_READ}, {_LIBRARY},
      inferred AS (SELECT s, 'dependsUpon' AS p, o FROM explicit WHERE p IN ('cites', 'provedBy') UNION SELECT o, 'derivedFrom', s FROM explicit WHERE p = 'hasCorollary' UNION SELECT o, 'explainsElement', s FROM explicit WHERE p = 'hasNote' UNION SELECT origin, 'transitivelyDependsOn', node FROM walk WHERE d > 1)
      SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM (SELECT * FROM explicit UNION ALL SELECT * FROM inferred) GROUP BY p UNION ALL SELECT 'latin texts', count(*), count(DISTINCT id) FROM r WHERE type = 'proof'""",
    "children_shown": f"WITH p AS {_PASSAGES} SELECT id, parent_id FROM p WHERE parent_id IS NOT NULL AND ({_HIT} OR parent_id IN (SELECT id FROM p WHERE {_HIT}))",
    "decimals_rounded": f"SELECT l_orderkey, l_linenumber, {_one_decimal('CAST(l_extendedprice AS DOUBLE)')} AS price, {_one_decimal('-l_orderkey / 16')} AS sixteenths FROM lineitem",
    "fixed_decimals": "SELECT l_partkey, CAST(n AS VARCHAR) || '.3' AS shown FROM (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY l_partkey)",
    "humanised_headings": r"""SELECT p_partkey, upper(p_type) AS key, array_to_string(list_transform(regexp_extract_all(lower(p_type || '-' || p_name), '\w+|\W+'), lambda x: upper(x[1]) || x[2:]), '') AS title FROM part""",
    "public_paths": "SELECT page_id, '/reader/' || regexp_replace(url, '^[a-z]+:/+', '') AS path FROM pages",
    "aligned_in_order": f"SELECT id, md5('lege ' || {_squeezed('text')}) AS digest FROM {_PASSAGES} WHERE NOT coalesce(is_editorial, false)",
}
