"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from quern.llm import bpe, decontaminate, htmltext, langid, media, neardup, ppm, secretscan, toxicity, urlfilter

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_url_filter": urlfilter.op3_url_filter,
    "op4_media_columns": media.op4_media_columns,
    "op5_near_dedup": neardup.op5_near_dedup,
    "op6_ppm_score": ppm.op6_ppm_score,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_html_text": htmltext.op8_html_text,
    "op9_language_id": langid.op9_language_id,
    "op10_secret_scan": secretscan.op10_secret_scan,
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontaminate.OP2_SQL,
    "op5_near_dedup": neardup.OP5_SQL,
}
