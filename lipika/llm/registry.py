"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .align import op12_alignment
from .ann import op2_ann
from .bpe import op1_bpe
from .lm import op8_lm
from .packing import op10_packing
from .pu import op11_pu_quality
from .quality import op4_quality
from .secrets import op9_secrets
from .simhash import op5_simhash
from .substrings import op6_substrings
from .urls import op7_url_filter
from .warc import op3_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_ann": op2_ann,
        "op3_warc": op3_warc,
        "op4_quality": op4_quality,
        "op5_simhash": op5_simhash,
        "op6_substrings": op6_substrings,
        "op7_url_filter": op7_url_filter,
        "op8_lm": op8_lm,
        "op9_secrets": op9_secrets,
        "op10_packing": op10_packing,
        "op11_pu_quality": op11_pu_quality,
        "op12_alignment": op12_alignment,
    }


def oracle_sql() -> dict[str, str]:
    """Of the others, SQL can express no fitted cutoff, entropy window, fingerprint, merge, walk or packing; tests hold them against brute force."""
    return {
        "op3_warc": """
            SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to
            FROM (SELECT page_id, h, strlen(h)::BIGINT AS n, max(page_id) OVER (PARTITION BY h) AS m FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))""",
        "op6_substrings": """
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
            w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM d),
            s AS (SELECT doc_id, i, string_agg(word, ' ') OVER v AS g, count(*) OVER v AS c FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
            f AS (SELECT g, min(doc_id) AS m FROM s WHERE c = 13 GROUP BY g),
            h AS (SELECT s.doc_id, s.i, m < s.doc_id AS hit FROM s JOIN f ON s.g = f.g WHERE c = 13),
            r AS (SELECT w.doc_id, w.i, w.word, coalesce(max(hit::INT) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone FROM w LEFT JOIN h ON h.doc_id = w.doc_id AND h.i = w.i)
            SELECT d.doc_id, len(d.l)::BIGINT AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY r.i) FILTER (gone = 0), '')) AS kept_sha256
            FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, d.l""",
    }
