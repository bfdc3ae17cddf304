"""The queries ``op1_`` to ``op10_``, and their SQL.

Where SQL can tell only some columns of an operator's result, a query beside it (``texts_of_op1`` and so on) gives these
columns of the same result, over the whole table, with their SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, fingerprint, langid, media, mixing, neardup, quality, secrets, substrings, tokenstore


def _columns(query: Callable, *names: str) -> Callable:
    return lambda spark, sf_dir: query(spark, sf_dir).select(*names)


QUERIES: dict[str, Callable] = {
    "op1_media_columns": media.op1,
    "op2_token_store": tokenstore.op2,
    "op3_minhash_near_dedup": neardup.op3,
    "op4_fingerprints": fingerprint.op4,
    "op5_language_id": langid.op5,
    "op6_substring_dedup": substrings.op6,
    "op7_bpe_round_trip": bpe.op7,
    "op8_secret_scan": secrets.op8,
    "op9_source_mix": mixing.op9,
    "op10_quality": quality.op10,
    "texts_of_op1": _columns(media.op1, "doc_id", "n_bytes", "payload_bytes", "payload_sha256"),
    "texts_of_op4": _columns(fingerprint.op4, "doc_id", "n_chars", "edited_sha256"),
    "texts_of_op7": _columns(bpe.op7, "doc_id", "decoded_sha256"),
    "counts_of_op8": _columns(secrets.op8, "doc_id", "n_assign", "n_access", "n_hex"),
}
ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_dedup": neardup.oracle(),
    "op9_source_mix": mixing.oracle(),
    "texts_of_op1": """
SELECT doc_id, n AS n_bytes, n + pad AS payload_bytes, sha256(b || from_hex(repeat('ff', pad::INT))) AS payload_sha256
FROM (SELECT *, CASE WHEN n = 0 THEN 576 ELSE (576 - n % 576) % 576 END AS pad FROM (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents))""",
    "texts_of_op4": """
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, (length(t) - length(t) // 4)::INT) || substr(after, 1, (length(t) // 4)::INT)) AS edited_sha256
FROM (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
    "texts_of_op7": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "counts_of_op8": r"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
 len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
}
