"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.llm.common import table


def op2_warc(spark, sf_dir):
    from assayframe.llm.warc import archive, read

    records = read(archive(table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality(spark, sf_dir):
    from assayframe.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_exact_dedup(spark, sf_dir):
    from assayframe.llm.exact_dedup import DigestIndex

    return DigestIndex(spark).add(table(spark, sf_dir, "documents"))


def op1_packing(spark, sf_dir):
    from public_tokenizers import path

    from assayframe.llm.packing import pack, tokenise

    pieces = pack(tokenise(table(spark, sf_dir, "documents"), path("word_bpe_49k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_simhash(spark, sf_dir):
    from assayframe.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_chat(spark, sf_dir):
    from assayframe.llm.chat import formatted, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(turns.unionByName(own)))


def op5_decontamination(spark, sf_dir):
    from assayframe.llm.decontaminate import find

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    """All stages over the whole corpus; a row per piece, with its ids' checksum in place of the ids."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op8_toxicity(spark, sf_dir):
    from assayframe.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("windows")


def op9_url_filter(spark, sf_dir):
    from assayframe.llm.urls import RULES, judge

    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_suffix_repeats(spark, sf_dir):
    from assayframe.llm.repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_lexical_search(spark, sf_dir):
    from assayframe.llm.search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_alignment(spark, sf_dir):
    from public_tokenizers import path

    from assayframe.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def op13_lm_scoring(spark, sf_dir):
    from assayframe.llm.language_model import score

    return score(table(spark, sf_dir, "documents"), order=3)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontamination": op5_decontamination,
    "op8_toxicity": op8_toxicity,
    "op7_chat": op7_chat,
    "op9_url_filter": op9_url_filter,
    "op6_simhash": op6_simhash,
    "op10_suffix_repeats": op10_suffix_repeats,
    "op11_lexical_search": op11_lexical_search,
    "op12_alignment": op12_alignment,
    "op13_lm_scoring": op13_lm_scoring,
    "pipeline": pipeline,
}

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    # Every window of 200 bytes as 400 hexadecimal digits, by its hash; what is left is put together from the gaps between runs.
    "op10_suffix_repeats": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT r, unnest(range(0, len(h) // 2 - 199)) AS i, h FROM d WHERE len(h) >= 400),
        k AS (SELECT r, i, md5_number(substr(h, (2 * i + 1)::INT, 400)) AS m FROM w),
        hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM k) WHERE n > 1),
        s AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 200, -1) AS fresh FROM hit),
        g AS (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM s),
        runs AS (SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, run),
        kept AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
        parts AS (SELECT k.r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(d.h, (2 * before + 1)::INT, (2 * (a - before))::INT), '' ORDER BY a) AS head, max(b) AS last
            FROM kept k JOIN d ON d.r = k.r GROUP BY k.r)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, (2 * last + 1)::INT) END)) AS kept_sha256
        FROM d LEFT JOIN parts p ON d.r = p.r""",
    "op7_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        m AS (SELECT *, length(regexp_replace(text, '[\\[\]<>]', '--', 'g')) + CASE WHEN role = 'assistant' THEN 10 WHEN role IN ('user', 'system') THEN 15 ELSE 16 + length(regexp_replace(role, '[\\[\]<>]', '--', 'g')) END AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
        FROM m GROUP BY conv_id""",
    # Terms as arrays of lower-cased runs; // rounds down, as all numbers are positive.
    "op11_lexical_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS t FROM documents),
        s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS all_terms FROM d WHERE len(t) > 0),
        q AS (SELECT i, item_id, term, count(*) AS k FROM (SELECT i, item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)) GROUP BY ALL),
        f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
        x AS (SELECT i, item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // all_terms))))::BIGINT AS score
            FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY i, item_id, r, doc_id),
        o AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM x WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    "op2_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to FROM k""",
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
        n AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                     row_number() OVER (PARTITION BY text_sha256, doc_id) AS copy FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AND copy = 1 AS kept, text_sha256 FROM n""",
}
