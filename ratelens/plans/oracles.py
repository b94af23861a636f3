"""DuckDB SQL of the queries, as flat joins over the tables that the nested data is built from."""

#: Suppliers that the searches look for, and the plan that the resolvers look for.
TARGETS = [7, 12, 40]
PLAN = "NATION_7"

_IN = f"l_suppkey IN ({', '.join(map(str, TARGETS))})"
_LI = """WITH li AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS f, 'rates_' || l_returnflag || '.json.gz' AS source_file, *
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
"""
#: A group exists in the first two files for every supplier, in the third for even ones.
_REF = "l_linestatus = 'F' AND (f < 2 OR l_suppkey % 2 = 0)"
_BOTH = f"(l_linestatus = 'O' OR {_REF})"
_DESCRIBED = "CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END"


def _rows(where: str, sparse: bool = False, source: bool = True) -> str:
    lost = (lambda v, z: f"CASE WHEN p_partkey % 3 = 0 THEN {z} ELSE {v} END") if sparse else (lambda v, z: v)
    return f"""{_LI} SELECT {"source_file," if source else ""} 1000000000 + l_suppkey AS npi, 'ein' AS tin_type, s_name AS tin_value,
  'CPT' AS billing_code_type, CAST(p_partkey AS VARCHAR) AS billing_code, {_DESCRIBED} AS billing_code_description,
  'ffs' AS negotiation_arrangement, {lost("l_extendedprice", "0")} AS negotiated_rate, 'negotiated' AS negotiated_type,
  l_linestatus AS billing_class, {lost("'outpatient'", "''")} AS setting, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS expiration_date,
  {lost("CAST(l_linenumber AS VARCHAR)", "'<null>'")} AS service_code, '' AS billing_code_modifier
FROM li WHERE {where}"""


_REFS = "(SELECT f, s_suppkey, s_name FROM supplier, (SELECT unnest([0, 1, 2]) AS f) WHERE f < 2 OR s_suppkey % 2 = 0)"
_STRUCTURES = "(SELECT c_custkey // 100 AS pos, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_MATCHED = f"(SELECT DISTINCT pos FROM {_STRUCTURES} WHERE n_name = '{PLAN}')"
_FULL = _rows(f"{_IN} AND {_BOTH}")

_FORMS = 14
_BUCKETS = f"{_LI}, files AS (SELECT f + 3 * (p_partkey // 500) AS file_seq, p_partkey, l_suppkey, l_linestatus, f FROM li)"
_NPIS = ",".join(str(1_000_000_000 + k) for k in TARGETS)

SQL: dict[str, str] = {
    "search_reference": _rows(f"{_IN} AND {_REF}"),
    "search_inline": _rows(f"{_IN} AND l_linestatus = 'O'"),
    "search_full": _FULL,
    "search_multi_npi": _rows(_BOTH),
    "search_single_pass": _rows(f"l_suppkey = {TARGETS[0]} AND {_BOTH} AND (f < 2 OR {TARGETS[0]} % 2 = 0)"),
    "provider_index": f"SELECT f AS file_seq, s_suppkey + f + CAST(0.5 AS DOUBLE) AS provider_group_id, CAST(1 AS BIGINT) AS n_providers, CAST(1000000000 + s_suppkey AS VARCHAR) AS npis FROM {_REFS}",
    "npi_matches": f"SELECT f AS file_seq, count(*) AS groups FROM {_REFS} GROUP BY f",
    "matching_items": f"{_LI} SELECT DISTINCT f AS file_seq, CAST(p_partkey AS VARCHAR) AS billing_code FROM li WHERE {_IN} AND {_BOTH}",
    "raw_prefilter": f"SELECT f AS file_seq, s_suppkey + f + CAST(0.5 AS DOUBLE) AS provider_group_id FROM {_REFS} WHERE s_suppkey IN ({', '.join(map(str, TARGETS))})",
    "malformed_drop": f"SELECT f AS file_seq, s_suppkey AS pos, s_suppkey + f + CAST(0.5 AS DOUBLE) AS provider_group_id FROM {_REFS} WHERE s_suppkey % 7 NOT IN (3, 5)",
    "description_fallback": f"{_LI} SELECT DISTINCT source_file, CAST(p_partkey AS VARCHAR) AS billing_code, {_DESCRIBED} AS billing_code_description FROM li WHERE l_linestatus = 'O'",
    "zero_defaults": _rows(f"{_IN} AND l_linestatus = 'O'", sparse=True),
    "duplicate_file": f"{_LI} SELECT source_file, count(*) * CASE WHEN min(f) = 0 THEN 2 ELSE 1 END AS rates, CAST(CASE WHEN min(f) = 0 THEN 2 ELSE 1 END AS BIGINT) AS searches FROM li WHERE {_IN} AND {_BOTH} GROUP BY source_file",
    "search_summary": f"{_LI} SELECT '{_NPIS},{1_000_000_000 + TARGETS[0]}' AS npis, CAST(3 AS BIGINT) AS searched_files, count(DISTINCT f) AS matched_files, count(*) AS rates FROM li WHERE {_IN} AND {_BOTH}",
    "file_counters": f"{_LI} SELECT f AS file_seq, 'provider_references' AS section, count(*) AS elements, count(*) FILTER (s_suppkey % 7 IN (3, 5)) AS malformed FROM {_REFS} GROUP BY f UNION ALL SELECT f, 'in_network', count(DISTINCT p_partkey), 0 FROM li GROUP BY f",
    "toc_resolve": f"""WITH located AS (
  SELECT m.pos, 0 AS file_pos, 'https://files.example.com/shared.json.gz' AS url FROM {_MATCHED} m
  UNION ALL SELECT m.pos, 1 + row_number() OVER (PARTITION BY m.pos ORDER BY page_id), url FROM {_MATCHED} m JOIN pages ON page_id // 3 = m.pos),
first AS (SELECT url, min(pos * 1000 + file_pos) AS place FROM located GROUP BY url)
SELECT url, place // 1000 AS structure_pos, place % 1000 AS file_pos FROM first""",
    "toc_stats": f"SELECT (SELECT count(DISTINCT pos) FROM {_STRUCTURES}) AS structures, (SELECT count(*) FROM {_MATCHED}) AS matched_structures, (SELECT n_name FROM nation WHERE n_nationkey = 1) AS entity_name",
    "search_plan": _rows(f"{_IN} AND {_BOTH} AND f = 1"),
    "url_list": "SELECT trim(url) AS url, count(*) AS n FROM pages GROUP BY 1",
    "input_union": "SELECT row_number() OVER (ORDER BY l, page_id, url) - 1 AS file_seq, url AS source_file FROM (SELECT 0 AS l, page_id, url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 1, page_id, url FROM pages)",
    "file_name": "SELECT page_id, regexp_extract(regexp_replace(split_part(url, '?', 1), '/+$', ''), '([^/]*)$', 1) AS file_name FROM pages",
    "cdn_vendor": f"""SELECT page_id, CASE page_id % {_FORMS} WHEN 0 THEN 'CloudFront' WHEN 1 THEN 'CloudFront' WHEN 2 THEN 'AWS S3' WHEN 3 THEN 'AWS S3' WHEN 4 THEN 'AWS S3'
  WHEN 5 THEN 'Google Cloud Storage' WHEN 6 THEN 'Azure Blob Storage' WHEN 7 THEN 'Akamai' WHEN 8 THEN 'Fastly' WHEN 9 THEN 'Cloudflare'
  WHEN 10 THEN 'CloudFront (BCBS)' WHEN 11 THEN 'CloudFront' WHEN 12 THEN 'BCBS' ELSE '' END AS vendor,
  CASE page_id % {_FORMS} WHEN 2 THEN 'us-east-1' WHEN 3 THEN 'eu-west-2' ELSE '' END AS region FROM pages""",
}
SQL["cdn_distribution"] = f"SELECT string_agg(entry, ', ' ORDER BY entry) AS distribution FROM (SELECT vendor || ' (' || count(*) || ')' AS entry FROM ({SQL['cdn_vendor']}) WHERE vendor <> '' GROUP BY vendor)"
SQL |= {
    "size_stats": """WITH s AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS n FROM documents)
SELECT CAST(sum(n) AS BIGINT) AS total_bytes, CAST(sum(n) // count(*) FILTER (n > 0) AS BIGINT) AS average_bytes, min(n) FILTER (n > 0) AS min_bytes, max(n) FILTER (n > 0) AS max_bytes,
  count(*) FILTER (n > 0) AS known, count(*) AS files FROM s""",
    "human_bytes": """WITH s AS (SELECT doc_id, n_chars * CAST(1024 ** (doc_id % 4) AS BIGINT) AS n FROM documents)
SELECT doc_id, CASE WHEN n >= 1024 ** 4 THEN format('{:.1f} TB', n / 1024 ** 4) WHEN n >= 1024 ** 3 THEN format('{:.1f} GB', n / 1024 ** 3) WHEN n >= 1024 ** 2 THEN format('{:.1f} MB', n / 1024 ** 2)
  WHEN n >= 1024 THEN format('{:.1f} KB', n / 1024) ELSE format('{} B', n) END AS size,
  CASE WHEN n >= 1024 ** 3 THEN format('{:.1f} GB', n / 1024 ** 3) WHEN n >= 1024 ** 2 THEN format('{:.1f} MB', n / 1024 ** 2)
  WHEN n >= 1024 THEN format('{:.1f} KB', n / 1024) ELSE format('{} B', n) END AS size_gb FROM s""",
    "human_count": "SELECT doc_id, format('{:,}', n_chars * 1001) AS count_text FROM documents",
    "parse_npis": "SELECT c_custkey, CAST(4 AS BIGINT) AS tokens, CAST(1 AS BIGINT) AS valid, 1000000000 + c_custkey AS first_npi FROM customer",
    "lookup_providers": """WITH r AS (SELECT *, s_suppkey % 11 <> 0 AS here, s_suppkey % 3 = 0 AS org, CASE s_suppkey % 5 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' WHEN 2 THEN 'Cleo' WHEN 3 THEN 'Dan' ELSE '' END AS first
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey AS pos, 1000000000 + s_suppkey AS npi,
  CASE WHEN NOT here THEN '<none>' WHEN org THEN 'Organization' ELSE 'Individual' END AS type,
  CASE WHEN NOT here THEN '<none>' WHEN org THEN s_name ELSE n_name || CASE WHEN first <> '' THEN ', ' || first ELSE '' END || CASE WHEN s_suppkey % 4 = 0 THEN ' Q' ELSE '' END END AS name,
  CASE WHEN NOT here THEN '<none>' WHEN NOT org AND s_suppkey % 2 = 0 THEN 'MD' ELSE '' END AS credential,
  CASE WHEN NOT here THEN '<none>' WHEN s_suppkey % 2 = 0 THEN 'Kind 208' ELSE 'Kind 207' END AS primary_taxonomy,
  CASE WHEN NOT here THEN '<none>' WHEN s_suppkey % 5 = 0 THEN 'Mailtown, NY 12345' ELSE 'Hometown, CA 90210' END AS practice_address,
  CASE WHEN NOT here THEN '<none>' WHEN s_suppkey % 5 = 0 THEN '(555) 000-1111' ELSE '12345678901' END AS practice_phone,
  CASE WHEN NOT here THEN '<none>' WHEN s_suppkey % 6 = 0 THEN 'D' ELSE 'A' END AS status, here AND s_suppkey % 6 = 0 AS inactive FROM r""",
    "missing_providers": "SELECT s_suppkey AS pos, 1000000000 + s_suppkey AS npi FROM supplier WHERE s_suppkey % 11 = 0",
    "search_by_name": """SELECT 1000000000 + s_suppkey AS npi, n_name || ', Bob' || CASE WHEN s_suppkey % 4 = 0 THEN ' Q' ELSE '' END AS name, 'Hometown, CA 90210' AS practice_address
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 11 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 = 1 AND n_name = 'NATION_7' ORDER BY npi LIMIT 20""",
    "format_fields": """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS cleaned,
  CASE WHEN c_custkey % 2 = 0 THEN '(555) ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-1234' ELSE '1-800' END AS phone, c_mktsegment AS first_word, 'van ' || c_name AS rest,
  c_mktsegment || CASE WHEN c_custkey % 3 <> 0 THEN ', Chile' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ' (Net)' ELSE '' END AS place, c_custkey % 2 = 0 AS gzipped,
  rpad(CASE WHEN c_custkey % 2 = 0 THEN '...' || right(c_name || repeat('-long', 8), 37) ELSE c_name END, 40, ' ') AS label FROM customer""",
    "assign_shards": "SELECT CAST(page_id % 7 AS INT) AS shard, count(*) AS files, min(page_id) AS first FROM pages GROUP BY 1",
    "merge_outputs": f"{_LI} SELECT '{_NPIS}' AS npis, CAST(3 AS BIGINT) AS searched_files, count(DISTINCT f) AS matched_files, CAST(3.0 AS DOUBLE) AS duration_seconds FROM li WHERE {_IN} AND {_BOTH}",
    "split_roundtrip": _FULL,
    "mrf_source_roundtrip": _rows(f"{_IN} AND {_BOTH}", source=False),
    "land_roundtrip": _FULL,
    "results_roundtrip": _rows(f"{_IN} AND l_linestatus = 'O'", sparse=True),
    "validate_files": f"""{_BUCKETS} SELECT file_seq, true AS ok,
  count(DISTINCT p_partkey) + count(DISTINCT CASE WHEN l_linestatus = 'F' AND (f < 2 OR l_suppkey % 2 = 0) THEN l_suppkey END) AS elements FROM files GROUP BY file_seq""",
    "file_catalog": f"{_BUCKETS} SELECT DISTINCT file_seq, true AS known FROM files",
    "registry_roundtrip": """SELECT 1000000000 + s_suppkey AS npi, CASE WHEN s_suppkey % 3 = 0 THEN 'Organization' ELSE 'Individual' END AS type,
  CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE n_name || CASE s_suppkey % 5 WHEN 0 THEN ', Ann' WHEN 1 THEN ', Bob' WHEN 2 THEN ', Cleo' WHEN 3 THEN ', Dan' ELSE '' END || CASE WHEN s_suppkey % 4 = 0 THEN ' Q' ELSE '' END END AS name,
  CASE WHEN s_suppkey % 6 = 0 THEN 'D' ELSE 'A' END AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 11 <> 0""",
    "multiline_source": _rows(f"{_IN} AND {_BOTH}", source=False),
    "plan_to_results": _rows(f"{_IN} AND {_BOTH} AND (f + 3 * (p_partkey // 500)) % 2 = 1", source=False),
    "lines_roundtrip": _FULL,
    "lines_of_a_file": _rows(f"{_IN} AND {_BOTH} AND f = 0"),
    "output_roundtrip": f"SELECT *, '{_NPIS}' AS npis, CAST(3 AS BIGINT) AS searched_files, (SELECT count(DISTINCT source_file) FROM ({_FULL})) AS matched_files FROM ({_FULL})",
    "validate_damaged": f"""{_BUCKETS} SELECT DISTINCT file_seq, file_seq % 5 NOT IN (1, 2, 3) AS ok,
  CASE file_seq % 5 WHEN 1 THEN 'text after' WHEN 2 THEN 'cut off' WHEN 3 THEN 'length' ELSE '' END AS kind FROM files""",
    "audit_files": f"""{_BUCKETS}, held AS (SELECT file_seq, count(DISTINCT p_partkey) AS items, count(DISTINCT CASE WHEN l_linestatus = 'F' AND (f < 2 OR l_suppkey % 2 = 0) THEN l_suppkey END) AS refs FROM files GROUP BY file_seq)
SELECT file_seq, 'in_network' AS section, items AS elements, CAST(0 AS BIGINT) AS malformed FROM held WHERE file_seq % 5 IN (0, 4)
UNION ALL SELECT file_seq, 'provider_references', refs, 0 FROM held WHERE file_seq % 5 IN (0, 4)
UNION ALL SELECT file_seq, '<none>', NULL, NULL FROM held WHERE file_seq % 5 IN (1, 2, 3)""",
    "mrf_blocks_roundtrip": _rows(f"{_IN} AND {_BOTH}", source=False),
    "search_many_npis": _rows(_BOTH, source=False),
    "search_bucketed": _rows(_BOTH),
    "land_versions": _rows(f"{_IN} AND {_BOTH}", source=False),
    "plans_files": f"""WITH plans AS (SELECT DISTINCT pos, unnest([c_name, n_name]) AS plan_id FROM {_STRUCTURES}), places AS (SELECT DISTINCT pos FROM plans),
located AS (
  SELECT pos, 0 AS file_pos, 'https://files.example.com/shared.json.gz' AS url FROM places
  UNION ALL SELECT m.pos, 1 + row_number() OVER (PARTITION BY m.pos ORDER BY page_id), url FROM places m JOIN pages ON page_id // 3 = m.pos),
first AS (SELECT plan_id, url, min(pos * 1000 + file_pos) AS place FROM plans JOIN located USING (pos) GROUP BY plan_id, url)
SELECT plan_id, url, place // 1000 AS structure_pos, place % 1000 AS file_pos FROM first""",
    "plans_to_results": f"SELECT CASE WHEN (f + 3 * (p_partkey // 500)) % 2 = 1 THEN 'Odd' ELSE 'EVEN' END AS plan_id, * EXCLUDE (f, p_partkey) FROM ({_rows(f'{_IN} AND {_BOTH}', source=False).replace('SELECT  1000000000', 'SELECT f, p_partkey, 1000000000')})",
}
