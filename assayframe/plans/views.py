"""The driver tables mapped to the schemas of activity data.

The mappings are plain SQL that Spark and DuckDB read alike, with {table} for a
table or another view; so queries and their SQL start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "activity": """
        SELECT cast(l_partkey AS string) AS CID, cast(l_suppkey AS string) AS AID, concat('P', cast(l_suppkey % 5 AS string)) AS Protein,
            CASE l_returnflag WHEN 'A' THEN 'IC50' WHEN 'N' THEN 'Ki' ELSE 'EC50' END AS Activity_Type,
            CASE l_linenumber % 4 WHEN 0 THEN '>' WHEN 1 THEN '=' ELSE '' END AS Relation,
            CASE WHEN l_quantity = 50 THEN cast(0 AS double) ELSE l_extendedprice / 1000 END AS Activity_Value,
            cast(cast(l_extendedprice AS decimal(18, 2)) AS string) AS Activity_Value_Raw,
            CASE WHEN l_linenumber = 7 THEN 'MILLIMOLAR' WHEN l_linestatus = 'O' THEN 'NANOMOLAR' ELSE 'MICROMOLAR' END AS Unit,
            CASE WHEN p_partkey % 13 = 0 THEN 'Unspecified' WHEN p_partkey % 17 = 0 AND l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'Active'
                WHEN p_size > 25 THEN 'Active' ELSE 'Inactive' END AS Outcome,
            'IC50' AS Source_Column, 'enriched' AS Activity_Status, cast(l_linenumber AS string) AS Result_Tag, cast(l_orderkey AS string) AS Order_Key,
            concat(p_name, '/', cast(p_size AS string)) AS SMILES_Harmonized,
            CASE WHEN p_partkey % 29 = 0 THEN 'failed' WHEN p_partkey % 7 = 0 THEN 'ok_with_warnings' ELSE 'ok' END AS SMILES_Harmonization_Status,
            md5(concat(p_name, '/', cast(p_size AS string))) AS InChIKey, cast(cast(p_retailprice AS decimal(18, 2)) AS string) AS MW
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "links": "SELECT DISTINCT CID, AID, Protein FROM {activity}",
    "raw_ids": """
        SELECT l_orderkey * 10 + l_linenumber AS seq,
            CASE l_linenumber WHEN 1 THEN cast(l_partkey AS string) WHEN 2 THEN concat('000', cast(l_partkey AS string)) WHEN 3 THEN concat(cast(l_partkey AS string), '.0')
                WHEN 4 THEN 'bad' WHEN 5 THEN ' ' WHEN 6 THEN concat('-', cast(l_partkey AS string)) ELSE NULL END AS raw
        FROM {lineitem}""",
    "properties": """
        SELECT cast(p_partkey AS string) AS PubChem_CID, CASE WHEN p_size % 4 <> 0 THEN 'success' ELSE 'failed' END AS status, 't0' AS fetched_at,
            CASE WHEN p_size % 4 <> 0 THEN NULL ELSE 'timeout' END AS error_message, p_brand AS Brand, p_type AS Kind
        FROM {part} WHERE p_size % 4 <> 0 OR p_size % 8 = 0""",
    "compounds": """
        SELECT cast(p_partkey AS string) AS CID, 'old' AS AIDs, 'P0' AS Proteins, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS Compound_Name,
            'stale' AS Activity_Enrichment_Status, p_brand AS Brand FROM {part} WHERE p_partkey % 2 = 0""",
    "compound_updates": """
        SELECT cast(p_partkey AS string) AS CID, 'new' AS AIDs, 'P1' AS Proteins, concat('name ', p_name) AS Compound_Name, 'enriched' AS Activity_Enrichment_Status
        FROM {part} WHERE p_partkey % 3 = 0""",
    "cells": """
        SELECT cast(e.event_id // 50 AS string) AS AID, event_id // 5 AS row_no, cast(event_id % 5 + 2 AS int) AS pos,
            CASE event_type WHEN 'purchase' THEN 'IC50' WHEN 'click' THEN 'Ki Qualifier' WHEN 'view' THEN 'PubChem Standard Value' WHEN 'error' THEN 'Comment' ELSE 'Kd (nM)' END AS column_name,
            CASE WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN '' ELSE cast(cast(value AS decimal(18, 2)) AS string) END AS value
        FROM {events} e
        UNION ALL SELECT cast(event_id // 50 AS string), event_id // 5, 0, 'PUBCHEM_RESULT_TAG', cast(event_id // 5 AS string) FROM {events} WHERE event_id % 5 = 0
        UNION ALL SELECT cast(min(event_id) // 50 AS string), event_id // 5, 1, 'PUBCHEM_CID', cast(min(user_id) AS string) FROM {events} GROUP BY event_id // 5
        UNION ALL SELECT cast(event_id // 50 AS string), event_id // 5, 9, 'PUBCHEM_ACTIVITY_OUTCOME', CASE WHEN user_id % 3 = 0 THEN 'Active' WHEN user_id % 3 = 1 THEN 'Inactive' ELSE '' END FROM {events} WHERE event_id % 5 = 0
        UNION ALL SELECT cast(event_id // 50 AS string), -1, 0, 'PUBCHEM_RESULT_TAG', 'RESULT_UNIT' FROM {events} WHERE event_id % 50 = 0
        UNION ALL SELECT cast(event_id // 50 AS string), -1, 2, 'IC50', CASE WHEN event_id // 50 % 2 = 0 THEN 'NANOMOLAR' ELSE 'MICROMOLAR' END FROM {events} WHERE event_id % 50 = 0
        UNION ALL SELECT cast(event_id // 50 AS string), -1, 3, 'PubChem Standard Value', CASE WHEN event_id // 50 % 3 = 0 THEN '' ELSE 'NANOMOLAR' END FROM {events} WHERE event_id % 50 = 0""",
    "collections": """
        SELECT d.doc_id AS doc_id, d.n_chars AS n_chars, concat(d.lang, '|', d.source, CASE q.quality WHEN 1 THEN '|good' WHEN 0 THEN '|bad' ELSE '' END) AS collections,
            concat(d.lang, '@', d.source, '/', cast(d.n_chars AS string)) AS structure
        FROM {documents} d LEFT JOIN {labels} q ON d.doc_id = q.doc_id""",
    "messy_numbers": """
        SELECT l_orderkey * 10 + l_linenumber AS seq,
            CASE l_linenumber WHEN 1 THEN concat('1,', cast(cast(l_extendedprice AS decimal(18, 2)) AS string)) WHEN 2 THEN ' ' WHEN 3 THEN concat(l_returnflag, ' mM')
                WHEN 4 THEN concat(' ', cast(cast(l_quantity AS int) AS string), ' ') WHEN 5 THEN '1e3' WHEN 6 THEN '12d' ELSE cast(cast(l_extendedprice AS decimal(18, 2)) AS string) END AS raw
        FROM {lineitem}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a mapped view."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("//", " div ")
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(_NAME.findall(text))})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names in braces put before it as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _NAME.findall(text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(sql)
    bare = lambda s: _NAME.sub(lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1], s)
    ctes = [f"v_{n} AS ({bare(VIEWS[n])})" for n in order]
    body = bare(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body
