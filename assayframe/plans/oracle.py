"""The registered queries in DuckDB SQL, written from their definitions."""

from __future__ import annotations

from assayframe.plans.views import with_views

#: Keywords of activity columns and names of standard columns, written out here so that a wrong list in the operators shows (fixed values).
KEYWORDS = ("IC50", "EC50", "AC50", "GI50", "LC50", "Ki", "Kd", "Potency")
STANDARD_VALUES = ("PubChem Standard Value", "Standard Value")
STANDARD_TYPES = ("PubChem Standard Type", "Standard Type")
PUBCHEM_UNITS = ("PubChem Standard Unit", "PubChem Standard Units")
STANDARD_UNITS = ("Standard Unit", "Standard Units")
STANDARD_RELATIONS = ("PubChem Standard Relation", "Standard Relation")

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CID = r"nullif(regexp_extract(trim(raw), '^\+?0*(\d{1,19})(\.0*)?$', 1), '')"
#: raw_ids with the canonical id.
IDS = f"ids AS (SELECT seq, raw, CASE WHEN try_cast({CID} AS BIGINT) > 0 THEN {CID} END AS cid FROM {{raw_ids}})"
KEY = "CID, AID, Protein, Activity_Type, Relation, Activity_Value_Raw, Unit, Outcome, Source_Column, Result_Tag"
MESSY = "replace(trim(raw), ',', '')"
IDLIST = "array_to_string(list_transform(list_sort(list_distinct(list({0}::BIGINT))), lambda x: x::VARCHAR), ',')"

UPSERT = """SELECT coalesce(t.CID, u.CID) AS CID, coalesce(u.AIDs, t.AIDs) AS AIDs, coalesce(u.Proteins, t.Proteins) AS Proteins,
    CASE WHEN u.CID IS NULL THEN t.Compound_Name ELSE coalesce(nullif(t.Compound_Name, ''), u.Compound_Name) END AS Compound_Name,
    coalesce(u.Activity_Enrichment_Status, t.Activity_Enrichment_Status) AS Activity_Enrichment_Status, t.Brand AS Brand
    FROM {compounds} t FULL JOIN {compound_updates} u ON t.CID = u.CID"""

SOURCE = """src AS (SELECT *, SMILES_Harmonized AS smiles, lower(Outcome) AS o,
        CASE WHEN Relation IN ('', '=') AND Activity_Value > 0 THEN CASE Unit WHEN 'NANOMOLAR' THEN Activity_Value * 0.001::DOUBLE WHEN 'MICROMOLAR' THEN Activity_Value * 1.0::DOUBLE END END AS um
        FROM {activity} WHERE Activity_Type = 'IC50'),
    usable AS (SELECT * FROM src WHERE SMILES_Harmonization_Status IN ('ok', 'ok_with_warnings')),
    trace AS (SELECT smiles, """ + IDLIST.format("CID") + " AS Source_CIDs, " + IDLIST.format("AID") + """ AS Source_AIDs, count(*) AS Source_Row_Count,
        array_to_string(list_sort(list_distinct(list(Outcome))), ',') AS Outcomes, count(DISTINCT AID) AS aids,
        bool_or(o = 'active') AS a, bool_or(o = 'inactive') AS i, bool_or(o NOT IN ('active', 'inactive')) AS x FROM usable GROUP BY smiles)"""
EXCLUDED = "SELECT smiles AS SMILES_Harmonized, Source_CIDs, Source_AIDs, Source_Row_Count, Outcomes, '{1}' AS reason FROM trace WHERE {0}"
_SORTED = ("AID", "Activity_Status", "Activity_Type", "Activity_Value", "Activity_Value_Raw", "CID", "InChIKey", "MW", "Order_Key", "Outcome", "Protein", "Relation", "Result_Tag", "SMILES_Harmonization_Status", "SMILES_Harmonized", "Source_Column", "Unit")
ROW_TEXT = "to_json({" + ", ".join(f"'{c}': u.{c}::VARCHAR" for c in _SORTED) + "})::VARCHAR"
BEST = f"""best AS (SELECT * FROM (SELECT u.*, m.lm, row_number() OVER (PARTITION BY u.smiles ORDER BY u.um IS NULL, round(abs(ln(u.um) - m.lm), 12), u.CID::BIGINT, u.AID::BIGINT, {ROW_TEXT}) AS rn
        FROM usable u JOIN (SELECT smiles, avg(ln(um)) AS lm FROM usable GROUP BY smiles) m ON u.smiles = m.smiles) WHERE rn = 1)"""
MADE = "made AS (SELECT t.*, b.*  EXCLUDE (smiles), CASE WHEN t.a THEN 'Active' ELSE 'Inactive' END AS label, b.um IS NOT NULL AS has FROM trace t JOIN best b ON t.smiles = b.smiles WHERE NOT (t.a AND t.i) AND NOT t.x)"
METRICS = """SELECT (SELECT count(*) FROM src) AS source_row_count, (SELECT count(*) FROM usable) AS valid_source_row_count, (SELECT count(*) FROM src) - (SELECT count(*) FROM usable) AS unusable_row_count,
    (SELECT count(*) FROM trace) AS unique_structure_count, (SELECT count(*) FROM trace WHERE a AND i) AS conflicting_structure_count, (SELECT count(*) FROM trace WHERE NOT (a AND i) AND x) AS non_binary_structure_count,
    count(*) AS created_row_count, count(*) FILTER (label = 'Active') AS active_structure_count, count(*) FILTER (label = 'Inactive') AS inactive_structure_count,
    coalesce((sum(Source_Row_Count) FILTER (label = 'Active')), 0)::BIGINT AS active_source_observation_count, coalesce((sum(Source_Row_Count) FILTER (label = 'Inactive')), 0)::BIGINT AS inactive_source_observation_count,
    coalesce((sum(Source_Row_Count) - count(*)), 0)::BIGINT AS consolidated_duplicate_count, coalesce(sum(Source_Row_Count), 0)::BIGINT AS represented_source_row_count,
    count(*) FILTER (has) AS selected_reference_count, count(*) FILTER (NOT has) AS no_eligible_activity_count,
    (SELECT count(DISTINCT u.AID) FROM usable u JOIN made k ON u.smiles = k.smiles WHERE k.label = 'Active') AS active_distinct_aid_count,
    (SELECT count(DISTINCT u.AID) FROM usable u JOIN made k ON u.smiles = k.smiles WHERE k.label = 'Inactive') AS inactive_distinct_aid_count FROM made"""

_MASK = "list_sum(list_transform(range(0, 32), lambda k: CASE WHEN embedding[{0} + k + 1] > 0 THEN 1::BIGINT << k::INT ELSE 0 END))::BIGINT"
FP = f"""fp AS (SELECT vec_id::VARCHAR AS id, CASE WHEN label < 5 THEN 'Active' ELSE 'Inactive' END AS outcome, {_MASK.format(0)} AS lo, {_MASK.format(32)} AS hi FROM embeddings),
    pairs AS (SELECT a.id, a.outcome, b.id AS nb, b.outcome AS nbo, bit_count(a.lo & b.lo) + bit_count(a.hi & b.hi) AS common_bits,
        bit_count(a.lo | b.lo) + bit_count(a.hi | b.hi) AS joint FROM fp a JOIN fp b ON a.id <> b.id),
    nn AS (SELECT * FROM (SELECT *, CASE WHEN joint = 0 THEN 'NaN'::DOUBLE ELSE common_bits::DOUBLE / joint END AS sim,
        row_number() OVER (PARTITION BY id ORDER BY CASE WHEN joint = 0 THEN 2 ELSE common_bits::DOUBLE / joint END DESC, nb) AS rn FROM pairs) WHERE rn = 1)"""


def _get_of(m: str, key: str) -> str:
    return f"coalesce(trim(map_extract({m}, {key})[1]), '')"


def _first(m: str, names) -> str:
    return "coalesce(" + ", ".join(f"nullif({_get_of(m, repr(n))}, '')" for n in names) + ", '')"


def _either(*parts: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({p}, '')" for p in parts) + ", '')"


_RANK = "CASE WHEN column_name LIKE 'PUBCHEM\\_%' ESCAPE '\\' OR lower(column_name) LIKE '% qualifier' THEN NULL " + " ".join(f"WHEN contains(lower(column_name), '{k.lower()}') THEN {i}" for i, k in enumerate(KEYWORDS)) + " END"
_STD = "CASE WHEN " + _get_of("m", "'PubChem Standard Value'") + " <> '' THEN 'PubChem Standard Value' WHEN " + _get_of("m", "'Standard Value'") + " <> '' THEN 'Standard Value' END"
_QUAL = lambda c: _either(_get_of("m", f"{c} || '_Qualifier'"), _get_of("m", f"{c} || ' Qualifier'"))
ASSAY = f"""one AS (SELECT AID, row_no, column_name, arg_max(value, pos) AS value, min(pos) AS pos FROM {{cells}} GROUP BY ALL),
    rows_ AS (SELECT AID, row_no, map_from_entries(list({{'k': column_name, 'v': value}})) AS m,
        arg_min(column_name, ({_RANK}) * 1000 + pos) FILTER (({_RANK}) IS NOT NULL AND trim(value) <> '') AS own,
        bool_or(({_RANK}) IS NOT NULL OR column_name IN {STANDARD_VALUES!r}) AS has_header FROM one GROUP BY AID, row_no),
    un AS (SELECT AID, arg_min(m, row_no) AS u FROM rows_ WHERE map_extract(m, 'PUBCHEM_RESULT_TAG')[1] = 'RESULT_UNIT' GROUP BY AID),
    data AS (SELECT r.*, un.u, CASE WHEN own IS NULL THEN {_STD} END AS std FROM rows_ r LEFT JOIN un ON r.AID = un.AID
        WHERE regexp_matches(coalesce(map_extract(m, 'PUBCHEM_RESULT_TAG')[1], ''), '^\\d+$') AND {_get_of("m", "'PUBCHEM_CID'")} <> ''),
    kinds AS (SELECT *, {_first("m", STANDARD_TYPES)} AS kind FROM data),
    chosen AS (SELECT AID, row_no, m, has_header, {_get_of("m", "'PUBCHEM_CID'")} AS CID, {_get_of("m", "'PUBCHEM_RESULT_TAG'")} AS Result_Tag, {_get_of("m", "'PUBCHEM_ACTIVITY_OUTCOME'")} AS Outcome,
        coalesce(own, std) AS Source_Column, CASE WHEN own IS NULL THEN kind ELSE '' END AS standard_type,
        CASE WHEN own IS NOT NULL THEN own ELSE coalesce(nullif(kind, ''), std) END AS Activity_Type,
        CASE WHEN own IS NOT NULL THEN {_QUAL("own")} ELSE {_either(_first("m", STANDARD_RELATIONS), _QUAL("std"))} END AS Relation,
        {_get_of("m", "coalesce(own, std)")} AS Activity_Value_Raw,
        CASE WHEN own IS NOT NULL THEN {_get_of("u", "own")}
            WHEN std = 'PubChem Standard Value' THEN {_either(_get_of("u", "'PubChem Standard Value'"), _first("m", PUBCHEM_UNITS + STANDARD_UNITS), "CASE WHEN kind = 'Relative potency' THEN 'dimensionless' ELSE '' END")}
            ELSE {_either(_first("m", STANDARD_UNITS + PUBCHEM_UNITS), _get_of("u", "'Standard Value'"), "CASE WHEN kind = 'Relative potency' THEN 'dimensionless' ELSE '' END")} END AS Unit
        FROM kinds),
    numbers AS (SELECT *, CASE WHEN regexp_matches(replace(Activity_Value_Raw, ',', ''), '{NUMBER}') THEN try_cast(replace(Activity_Value_Raw, ',', '') AS DOUBLE) END AS Activity_Value FROM chosen)"""
_KNOWN = (*STANDARD_VALUES, *STANDARD_TYPES, *PUBCHEM_UNITS, *STANDARD_UNITS, *STANDARD_RELATIONS)

_PROFILE = " UNION ALL ".join(f"SELECT '{n}' AS tab, (SELECT count(*) FROM {t}) AS n, (SELECT list(column_name ORDER BY column_index) FROM duckdb_columns() WHERE table_name = '{t}') AS cols" for n, t in [*[(t, t) for t in TABLES], ("temp_part", "part")])
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS tab, count(*) AS n FROM {t}" for t in TABLES)

_SQL = {
    "activity_by_type_unit": """SELECT Activity_Type, Unit, count(*) AS n_rows, count(DISTINCT CID) AS n_cids, round(avg(Activity_Value), 6) AS mean_value,
        round(exp(avg(ln(CASE Unit WHEN 'NANOMOLAR' THEN Activity_Value * 0.001::DOUBLE WHEN 'MICROMOLAR' THEN Activity_Value END))), 6) AS geometric_mean_um
        FROM {activity} WHERE Activity_Type IN ('IC50', 'Ki') AND Outcome IN ('Active', 'Inactive') AND Activity_Value BETWEEN 0.001 AND 90 GROUP BY 1, 2""",
    "activity_summary": """SELECT count(*) AS row_count, count(DISTINCT CID) AS cid_count, count(DISTINCT AID) AS aid_count, min(Activity_Value) AS min_value, max(Activity_Value) AS max_value,
        string_agg(DISTINCT nullif(Activity_Type, ''), ',' ORDER BY nullif(Activity_Type, '')) AS activity_types, string_agg(DISTINCT nullif(Outcome, ''), ',' ORDER BY nullif(Outcome, '')) AS outcomes,
        string_agg(DISTINCT nullif(Unit, ''), ',' ORDER BY nullif(Unit, '')) AS units, string_agg(DISTINCT nullif(Relation, ''), ',' ORDER BY nullif(Relation, '')) AS relations
        FROM {activity} WHERE Activity_Type IN ('IC50', 'EC50') AND Activity_Value <= 80""",
    "activity_value_stats": """SELECT count(Activity_Value) AS value_count, min(Activity_Value) AS min_value, max(Activity_Value) AS max_value, count(*) FILTER (Relation IN ('>', '<', '>=', '<=')) AS qualified_count
        FROM {activity} WHERE Unit = 'NANOMOLAR'""",
    "activity_cids": "SELECT DISTINCT CID FROM {activity} WHERE Outcome = 'Active' AND Activity_Value >= 60",
    "activity_rows_top": "SELECT AID, CID, Result_Tag FROM {activity} WHERE Activity_Type = 'Ki' ORDER BY AID::BIGINT, CID, Result_Tag LIMIT 100",
    "activity_subset_export": "SELECT CID, AID, Protein, Activity_Type, Relation, Activity_Value, Unit, Outcome, Source_Column, Activity_Status, Result_Tag FROM {activity} WHERE Unit = 'MILLIMOLAR' AND Activity_Value BETWEEN 10 AND 20",
    "activity_distinct_values": "SELECT DISTINCT Relation FROM {activity} WHERE Relation <> ''",
    "refine_project": "SELECT p_partkey, p_name FROM part",
    "refine_where_text": "SELECT p_partkey, p_retailprice::DECIMAL(18,2)::VARCHAR AS price FROM part WHERE p_retailprice::DECIMAL(18,2)::VARCHAR > '100'",
    "refine_where_numeric": "SELECT seq FROM {messy_numbers} WHERE (CASE WHEN regexp_matches(trim(raw), '^12d$') THEN 12 ELSE try_cast(trim(raw) AS DOUBLE) END) >= 40",
    "refine_group": "SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_name) AS rn FROM part) WHERE rn = 1",
    "refine_order": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC",
    "contains_filter": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'",
    "group_count_with_null": "SELECT count(*) AS groups FROM (SELECT DISTINCT nullif(p_brand, 'Brand#2') AS b FROM part)",
    "pruned_scan": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "keep_last_result": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1",
    "traceability_summary": "SELECT count(DISTINCT CID) AS cid_count, count(DISTINCT AID) AS aid_count, count(*) AS link_count, string_agg(DISTINCT Protein, ', ' ORDER BY Protein) AS proteins FROM {links}",
    "enrichment_scope": "SELECT count(DISTINCT (Protein, AID)) AS job_count, count(*) AS link_count, count(DISTINCT Protein) AS protein_count FROM {links}",
    "status_histogram": "SELECT Activity_Enrichment_Status AS status, count(*) AS compounds FROM (" + UPSERT + ") GROUP BY 1",
    "compound_fold": """SELECT l.CID, string_agg(DISTINCT l.AID, ', ' ORDER BY l.AID) AS AIDs, string_agg(DISTINCT l.Protein, ', ' ORDER BY l.Protein) AS Proteins,
        coalesce(any_value(CASE WHEN p_partkey % 4 <> 0 THEN p_name END), '') AS Compound_Name,
        CASE WHEN l.CID IN (SELECT CID FROM {activity} WHERE Activity_Type = 'Ki' AND Activity_Value >= 70) THEN 'enriched' ELSE 'partial_or_failed' END AS Activity_Enrichment_Status
        FROM {links} l LEFT JOIN part ON l.CID = p_partkey::VARCHAR GROUP BY l.CID""",
    "enrichment_jobs": "SELECT Protein, AID, string_agg(DISTINCT CID, ',' ORDER BY CID) AS CIDs FROM {links} GROUP BY 1, 2",
    "link_expansion": "SELECT DISTINCT CID, AID, Protein FROM {links}",
    "expected_cid_restrict": """SELECT a.CID, a.AID, a.Result_Tag, a.Order_Key FROM {activity} a WHERE a.AID IN (SELECT AID FROM {links} WHERE Protein <> 'P1')
        AND (a.AID IN (SELECT AID FROM {links} WHERE Protein = 'P2') OR (a.AID, a.CID) IN (SELECT (AID, CID) FROM {links} WHERE Protein <> 'P1'))""",
    "protein_search": """WITH f AS (SELECT l.CID, string_agg(DISTINCT l.AID, ', ' ORDER BY l.AID) AS AIDs, string_agg(DISTINCT l.Protein, ', ' ORDER BY l.Protein) AS Proteins, any_value(p_name) AS n,
            CASE WHEN l.CID IN (SELECT CID FROM {activity} WHERE Activity_Type = 'EC50') THEN 'enriched' ELSE 'partial_or_failed' END AS s
            FROM {links} l JOIN part ON l.CID = p_partkey::VARCHAR GROUP BY l.CID)
        SELECT coalesce(t.CID, f.CID) AS CID, coalesce(f.AIDs, t.AIDs) AS AIDs, coalesce(f.Proteins, t.Proteins) AS Proteins,
            CASE WHEN f.CID IS NULL THEN t.Compound_Name ELSE coalesce(nullif(t.Compound_Name, ''), f.n) END AS Compound_Name, coalesce(f.s, t.Activity_Enrichment_Status) AS Activity_Enrichment_Status, t.Brand AS Brand
        FROM {compounds} t FULL JOIN f ON t.CID = f.CID""",
    "merge_by_key": """WITH u AS (SELECT l_partkey AS k, nullif(max(l_returnflag), 'R') AS n, max(l_tax) AS tax FROM lineitem WHERE l_linenumber = 2 GROUP BY 1)
        SELECT p_partkey, CASE WHEN k IS NULL THEN p_name ELSE n END AS p_name, p_size, tax FROM part LEFT JOIN u ON p_partkey = k""",
    "cache_merge": """SELECT a.CID, a.AID, a.Result_Tag, a.Order_Key, Brand, Kind FROM {activity} a
        LEFT JOIN (SELECT * FROM {properties} WHERE status = 'success' AND PubChem_CID::BIGINT % 2 = 1) p ON a.CID = p.PubChem_CID""",
    "compound_upsert": """WITH u AS (SELECT CID, CASE WHEN CID LIKE '%1' OR CID LIKE '%5' THEN 'newer' ELSE AIDs END AS a, Proteins AS p, CASE WHEN CID LIKE '%1' THEN 'other' ELSE Compound_Name END AS n, Activity_Enrichment_Status AS s FROM {compound_updates})
        SELECT coalesce(t.CID, u.CID) AS CID, coalesce(a, t.AIDs) AS AIDs, coalesce(p, t.Proteins) AS Proteins, CASE WHEN u.CID IS NULL THEN t.Compound_Name ELSE coalesce(nullif(t.Compound_Name, ''), n) END AS Compound_Name,
            coalesce(s, t.Activity_Enrichment_Status) AS Activity_Enrichment_Status, t.Brand AS Brand FROM {compounds} t FULL JOIN u ON t.CID = u.CID""",
    "protein_search_links": "SELECT * FROM {links}",
    "csv_load": "SELECT p_partkey::VARCHAR AS part_key, p_name, p_type FROM part",
    "csv_row_ids": "SELECT row_number() OVER (ORDER BY p_partkey) AS primary_id, p_partkey::VARCHAR AS part_key FROM part",
    "subgroup_export": "SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%'",
    "activity_export": """SELECT row_number() OVER (ORDER BY AID::BIGINT, CID, Result_Tag, Order_Key) AS line, AID, CID, Result_Tag FROM {activity} WHERE Activity_Type = 'Ki'""",
    "assay_files": """WITH w AS (SELECT AID, row_no, column_name AS c, arg_max(value, pos) AS value FROM {cells} GROUP BY ALL), h AS (SELECT AID, c, row_number() OVER (PARTITION BY AID ORDER BY c) - 1 AS pos FROM (SELECT DISTINCT AID, c FROM w)),
        r AS (SELECT AID, row_no, row_number() OVER (PARTITION BY AID ORDER BY row_no) - 1 AS n FROM (SELECT DISTINCT AID, row_no FROM w))
        SELECT h.AID AS AID, n AS row_no, h.pos::INT AS pos, h.c AS column, coalesce(w.value, '') AS value FROM h JOIN r ON h.AID = r.AID LEFT JOIN w ON w.AID = h.AID AND w.row_no = r.row_no AND w.c = h.c""",
    "protein_aid_source": "SELECT DISTINCT Protein, AID FROM {links}",
    "derived_table": "SELECT p_partkey, p_size::BIGINT AS size, CASE WHEN p_size >= 10 THEN p_size::DOUBLE END AS share FROM part",
    "strict_projection": "SELECT p_name, p_partkey FROM part",
    "preview_rows": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 7",
    "aid_cid_source": "SELECT DISTINCT AID, CID FROM {links}",
    "title_source": "SELECT p_partkey::VARCHAR AS CID, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS Title FROM part",
    "taxonomy_source": "SELECT DISTINCT p_brand AS name, 'brand' AS category, p_type AS entry FROM part",
    "chunk_union": """SELECT PubChem_CID, status, Brand, NULL::VARCHAR AS error_message, NULL::VARCHAR AS Kind FROM {properties} WHERE status = 'success'
        UNION ALL SELECT PubChem_CID, status, NULL, error_message, NULL FROM {properties} WHERE status <> 'success'
        UNION ALL SELECT PubChem_CID, 'again', NULL, NULL, Kind FROM {properties} WHERE status = 'success'""",
    "stored_features": "SELECT CID, AID, Protein FROM {links}",
    "keyed_enrichment_function": f"""WITH {IDS}, k AS (SELECT DISTINCT cid FROM ids WHERE cid IS NOT NULL AND cid NOT IN (SELECT PubChem_CID FROM {{properties}} WHERE status = 'success'))
        SELECT cid AS PubChem_CID, CASE WHEN cid::BIGINT % 2 = 1 THEN 'success' ELSE 'failed' END AS status, CASE WHEN cid::BIGINT % 2 = 0 THEN 'no result returned' END AS error_message,
            CASE WHEN cid::BIGINT % 2 = 1 THEN (cid::BIGINT * 2)::VARCHAR END AS Double FROM k""",
    "insert_ignore_links": "SELECT * FROM {links}",
    "snapshot_upsert": UPSERT,
    "refusals": """SELECT links, "case", refused FROM (SELECT count(*) AS links FROM {links}), (VALUES ('unchanged source', false), ('changed source', true), ('another method', true),
        ('stored features', false), ('damaged features', true), ('unknown features', true), ('existing table', true)) c("case", refused)""",
    "insert_ignore_activity": f"""WITH r AS (SELECT CID, AID, Protein, Activity_Type, Relation, Activity_Value_Raw, nullif(Unit, 'MILLIMOLAR') AS Unit, Outcome, Source_Column, Result_Tag FROM {{activity}}),
        w AS (SELECT DISTINCT {KEY} FROM r WHERE Unit IS NOT NULL), k AS (SELECT DISTINCT {KEY} FROM r WHERE Result_Tag IN ('1', '2', '7')),
        o AS (SELECT * FROM w EXCEPT SELECT * FROM k UNION ALL SELECT * FROM r WHERE Unit IS NULL)
        SELECT Activity_Type, Unit, count(*) AS n FROM (SELECT * FROM (SELECT * FROM w EXCEPT SELECT * FROM k) UNION ALL SELECT * FROM r WHERE Unit IS NULL) GROUP BY 1, 2""",
    "cache_upsert": """WITH u AS (SELECT p_partkey::VARCHAR AS c, CASE WHEN p_size % 2 = 0 THEN 'success' ELSE 'failed' END AS s, CASE WHEN p_size % 2 <> 0 THEN 'no result' END AS e, upper(p_brand) AS b, p_size::VARCHAR AS z FROM part WHERE p_partkey % 3 = 0)
        SELECT coalesce(PubChem_CID, c) AS PubChem_CID, coalesce(s, status) AS status, CASE WHEN c IS NULL THEN fetched_at ELSE 't1' END AS fetched_at, CASE WHEN c IS NULL THEN error_message ELSE e END AS error_message,
            CASE WHEN s = 'success' THEN b ELSE Brand END AS Brand, Kind, CASE WHEN s = 'success' THEN z END AS Size FROM {properties} FULL JOIN u ON PubChem_CID = c""",
    "id_normalise": f"WITH {IDS} SELECT cid, count(*) AS n FROM ids GROUP BY 1",
    "first_seen_ids": f"WITH {IDS} SELECT cid AS key, min(seq) AS first FROM ids WHERE cid IS NOT NULL GROUP BY 1",
    "cached_pending_invalid": f"""WITH {IDS} SELECT DISTINCT cid AS key, NULL::VARCHAR AS raw, CASE WHEN cid IN (SELECT PubChem_CID FROM {{properties}} WHERE status = 'success') THEN 'cached' ELSE 'pending' END AS state FROM ids WHERE cid IS NOT NULL
        UNION ALL SELECT DISTINCT NULL, raw, 'invalid' FROM ids WHERE cid IS NULL""",
    "missing_results": "SELECT DISTINCT CID AS PubChem_CID, 'failed' AS status, 'no result returned' AS error_message FROM {links} WHERE CID NOT IN (SELECT PubChem_CID FROM {properties})",
    "keyed_enrichment": f"WITH {IDS} SELECT seq, raw, Brand, Kind FROM ids LEFT JOIN (SELECT * FROM {{properties}} WHERE status = 'success') p ON cid = PubChem_CID",
    "enrichment_progress": "SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed FROM {properties}",
    "assay_extract": f"WITH {ASSAY} SELECT CID, AID, Activity_Type, Relation, Activity_Value, Activity_Value_Raw, Unit, Outcome, Source_Column, Result_Tag FROM numbers WHERE Source_Column IS NOT NULL AND Activity_Value IS NOT NULL",
    "assay_failure_class": f"""WITH {ASSAY} SELECT AID, row_no, CID, CASE
            WHEN len(list_filter(map_entries(m), lambda e: trim(e.value) <> '' AND NOT starts_with(e.key, 'PUBCHEM_') AND e.key NOT IN {_KNOWN!r} AND NOT ends_with(lower(e.key), ' qualifier'))) > 0 THEN 'unsupported_activity_column'
            WHEN has_header AND Outcome = '' THEN 'no_numeric_value_for_cid' WHEN Outcome <> '' THEN 'outcome_only' ELSE 'assay_has_no_quantitative_activity' END AS failure
        FROM numbers WHERE Source_Column IS NULL OR Activity_Value IS NULL""",
    "assay_descriptions": f"""WITH {ASSAY} SELECT CID, AID, string_agg(DISTINCT Source_Column, '; ' ORDER BY Source_Column) AS types,
            string_agg(DISTINCT t, '; ' ORDER BY t) AS values FROM (SELECT *, concat_ws(' ', 'AID ' || AID || ': ' || Source_Column || CASE WHEN standard_type <> '' THEN ' (' || standard_type || ')' ELSE '' END,
            nullif(Relation, ''), Activity_Value_Raw, nullif(nullif(Unit, ''), 'NONE'), '(' || nullif(Outcome, '') || ')') AS t FROM chosen WHERE Source_Column IS NOT NULL) GROUP BY 1, 2""",
    "consolidated": f"""WITH {SOURCE}, {BEST}, {MADE} SELECT smiles AS SMILES_Harmonized, InChIKey, label AS Outcome, CASE WHEN has THEN CID END AS Reference_CID, CASE WHEN has THEN AID END AS Reference_AID,
        CASE WHEN has THEN Activity_Type END AS Reference_Activity_Type, CASE WHEN has THEN Relation END AS Reference_Relation, CASE WHEN has THEN Activity_Value END AS Reference_Activity_Value,
        CASE WHEN has THEN Activity_Value_Raw END AS Reference_Activity_Value_Raw, CASE WHEN has THEN Unit END AS Reference_Unit, um AS Reference_Activity_Value_uM,
        CASE WHEN has THEN 'selected' ELSE 'no_eligible_activity' END AS Reference_Selection_Status, Source_CIDs, Source_AIDs, Source_Row_Count, aids AS Source_AID_Count, MW, round(exp(lm), 6) AS Geometric_Mean_Activity_uM FROM made""",
    "consolidate_metrics": f"WITH {SOURCE}, {BEST}, {MADE} {METRICS}",
    "consolidate_invariants": f"WITH {SOURCE}, {BEST}, {MADE}, x AS ({METRICS}) SELECT "
    "active_structure_count + inactive_structure_count = created_row_count AS outcome_count, "
    "active_source_observation_count + inactive_source_observation_count = represented_source_row_count AS outcome_evidence, "
    "selected_reference_count + no_eligible_activity_count = created_row_count AS reference_count, "
    "represented_source_row_count = created_row_count + consolidated_duplicate_count AS represented_rows, "
    "valid_source_row_count + unusable_row_count = source_row_count AS source_rows, "
    "created_row_count + conflicting_structure_count + non_binary_structure_count = unique_structure_count AS structures, "
    "created_row_count >= 0 AND consolidated_duplicate_count >= 0 AND unusable_row_count >= 0 AS not_negative FROM x",
    "excluded_conflicts": f"WITH {SOURCE} " + EXCLUDED.format("a AND i", "active_inactive_conflict"),
    "excluded_non_binary": f"WITH {SOURCE} " + EXCLUDED.format("NOT (a AND i) AND x", "non_binary_or_missing_outcome"),
    "excluded_unusable": "SELECT CID, AID, Outcome, SMILES_Harmonized, SMILES_Harmonization_Status, 'harmonization_status:' || SMILES_Harmonization_Status AS reason FROM {activity} WHERE Activity_Type = 'IC50' AND SMILES_Harmonization_Status = 'failed'",
    "population_violations": """WITH s AS (SELECT *, CASE WHEN Activity_Value > 0 THEN 'selected' ELSE 'raw' END AS st FROM {activity} WHERE Activity_Type = 'IC50')
        SELECT 'selection_status' AS rule, st AS value, count(*) AS rows FROM s WHERE st = 'raw' GROUP BY st UNION ALL SELECT 'outcome', Outcome, count(*) FROM s WHERE Outcome NOT IN ('Active', 'Inactive') GROUP BY Outcome
        UNION ALL SELECT 'duplicate_structure', SMILES_Harmonized, count(*) FROM s GROUP BY SMILES_Harmonized HAVING count(*) > 1""",
    "nearest_neighbours": f"WITH {FP} SELECT id, outcome, nb AS neighbour_id, nbo AS neighbour_outcome, round(sim, 9) AS similarity, outcome = nbo AS concordant FROM nn",
    "class_concordance": f"WITH {FP} SELECT outcome, count(*) AS rows, round(avg((outcome = nbo)::INT), 9) AS concordance FROM nn GROUP BY outcome",
    "modelability_index": f"WITH {FP} SELECT round(avg(c), 9) AS modelability_index, sum(n)::BIGINT AS rows FROM (SELECT avg((outcome = nbo)::INT) AS c, count(*) AS n FROM nn GROUP BY outcome)",
    "ml_export": """SELECT row_number() OVER (ORDER BY vec_id::VARCHAR) - 1 AS row_index, sha256(vec_id::VARCHAR) AS structure_id, vec_id::VARCHAR AS id, CASE WHEN label < 5 THEN 'Active' ELSE 'Inactive' END AS outcome,
        CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, array_to_string(list_filter(range(0, 64), lambda k: embedding[k + 1] > 0), ',') AS bits FROM embeddings""",
    "text_features": """WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), '') AS t FROM documents),
        w AS (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM s), n AS (SELECT DISTINCT doc_id, t[i] || t[i + 1] || t[i + 2] AS w FROM w),
        g AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 4096 AS b FROM n)
        SELECT s.doc_id, count(b) AS n_bits, coalesce(sum(b), 0)::BIGINT AS bit_sum FROM s LEFT JOIN g ON s.doc_id = g.doc_id GROUP BY s.doc_id""",
    "data_identity": """WITH d AS (SELECT sha256(to_json({'CID': CID, 'AID': AID, 'Protein': Protein})::VARCHAR) AS d FROM {links}), c AS (SELECT d, count(*) AS c FROM d GROUP BY d), b AS (SELECT substr(d, 1, 3) AS b, sha256(string_agg(d || ':' || c, ',' ORDER BY d)) AS h, sum(c) AS n FROM c GROUP BY 1)
        SELECT sha256('v1' || chr(10) || string_agg(h, ',' ORDER BY b)) AS identity, sum(n)::BIGINT AS rows FROM b""",
    "reuse_by_identity": "SELECT Protein, md5(string_agg(DISTINCT AID, ',' ORDER BY AID)) AS identity FROM {links} WHERE Protein < 'P3' GROUP BY Protein",
    "dataset_profile": f"""WITH p AS ({_PROFILE}), q AS (SELECT *, count(*) OVER (PARTITION BY n, cols) AS alike FROM p),
        s AS (SELECT *, array_to_string(list_filter([CASE WHEN n = 0 THEN 'structure_only' ELSE 'ok' END, CASE WHEN len(cols) <= 3 THEN 'few_columns' END, CASE WHEN contains(tab, 'temp') THEN 'possible_temporary' END, CASE WHEN alike > 1 THEN 'possible_duplicate' END], lambda x: x IS NOT NULL), ',') AS st FROM q)
        SELECT tab AS "table", n AS rows, len(cols) AS columns, array_to_string(cols, ',') AS column_names, CASE WHEN tab = 'part' THEN 'base' ELSE 'derived' END AS role, CASE WHEN tab = 'part' THEN 'upload' ELSE 'derived_inferred' END AS origin,
            CASE WHEN tab = 'part' THEN 'registered' ELSE 'inferred' END AS metadata_status, st AS status,
            CASE WHEN contains(st, 'structure_only') THEN 'Review or delete' WHEN contains(st, 'possible_temporary') THEN 'Review cleanup' WHEN contains(st, 'possible_duplicate') THEN 'Compare before use' WHEN tab <> 'part' THEN 'Review provenance' ELSE 'Available' END AS recommended_action FROM s""",
    "row_expectations": "SELECT 'nation' AS \"table\", 'unexpected' AS problem, NULL::BIGINT AS expected_rows, (SELECT count(*) FROM nation) AS actual_rows UNION ALL SELECT 'gone', 'missing', 1, NULL UNION ALL SELECT 'region', 'row_count', 7, (SELECT count(*) FROM region)",
    "database_summary": f"SELECT count(*) AS tables, sum(n)::BIGINT AS rows FROM ({_COUNTS})",
    "castability": f"SELECT count(*) AS text, count(*) FILTER (trim(raw) = '' OR regexp_matches(trim(raw), '^[+-]?\\d+$')) AS integer, count(*) FILTER (trim(raw) = '' OR regexp_matches(trim(raw), '{NUMBER}')) AS real FROM {{messy_numbers}}",
    "incompatible_values": f"SELECT DISTINCT raw AS value FROM {{messy_numbers}} WHERE NOT (trim(raw) = '' OR regexp_matches(trim(raw), '{NUMBER}'))",
    "safe_type_change": f"SELECT seq, try_cast(nullif(trim(raw), '') AS DOUBLE) AS raw FROM {{messy_numbers}} WHERE trim(raw) = '' OR regexp_matches(trim(raw), '{NUMBER}')",
    "numeric_values": f"SELECT seq, CASE WHEN regexp_matches({MESSY}, '{NUMBER}') THEN try_cast({MESSY} AS DOUBLE) END AS value FROM {{messy_numbers}}",
    "collection_filter": "SELECT doc_id FROM {collections} WHERE list_has_any(string_split(collections, '|'), ['fr', 'good'])",
    "collection_filter_all": "SELECT doc_id FROM {collections} WHERE list_has_all(string_split(collections, '|'), ['fr', 'good'])",
    "collection_report": r"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(structure, '[@/\\]', '', 'g') ORDER BY doc_id) AS rn FROM {collections}),
        k AS (SELECT * FROM o WHERE rn = 1 AND list_has_any(string_split(collections, '|'), ['de', 'bad']))
        SELECT (SELECT count(*) FROM o) AS original_rows, (SELECT count(*) FROM o WHERE rn > 1) AS duplicates_removed, (SELECT count(*) FROM o WHERE rn = 1) AS deduplicated_rows, count(*) AS retained_rows, count(*) FILTER (n_chars <= 500) AS invalid_rows FROM k""",
    "json_props": "SELECT event_type, sum((props::JSON->>'k')::BIGINT)::BIGINT AS k_sum, count(props::JSON->>'k') AS k_count FROM events GROUP BY 1",
    "incremental_ingest": f"""WITH r AS (SELECT CID, AID, Protein, Activity_Type, Relation, Activity_Value_Raw, nullif(Unit, 'MILLIMOLAR') AS Unit, Outcome, Source_Column, Result_Tag FROM {{activity}})
        SELECT Activity_Type, Outcome, Unit, count(*) AS n FROM (SELECT DISTINCT {KEY} FROM r WHERE Unit IS NOT NULL UNION ALL SELECT {KEY} FROM r WHERE Unit IS NULL
            UNION ALL SELECT {KEY} FROM r WHERE Unit IS NULL AND Result_Tag IN ('1', '2', '3', '7')) GROUP BY 1, 2, 3""",
    "stored_links": "SELECT * FROM {links}",
}

_SQL |= {
    "neighbour_report": f"SELECT id, outcome, neighbour_id, neighbour_outcome, round(similarity, 6) AS similarity, concordant::VARCHAR AS concordant FROM ({_SQL['nearest_neighbours']})",
    "metrics_json": f"SELECT m.* FROM ({_SQL['consolidate_metrics']}) m UNION ALL SELECT n.* FROM (SELECT 1) LEFT JOIN ({_SQL['consolidate_metrics']}) n ON false",
    "json_lists": f"""SELECT SMILES_Harmonized, '["' || replace(Source_CIDs, ',', '","') || '"]' AS Source_CIDs, '["' || replace(Source_AIDs, ',', '","') || '"]' AS Source_AIDs FROM ({_SQL['consolidated']})""",
}

ORACLE_SQL = {name: with_views(sql) for name, sql in _SQL.items()}
