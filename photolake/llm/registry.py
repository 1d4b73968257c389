"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from photolake.llm import bond, decontaminate, hilbert, html, langid, licenses, lm, mixing, mjpeg, quality, runs, simhash, sstable


def queries() -> dict:
    found = (
        lm.op1_lm_score,
        mixing.op2_mixing,
        quality.op3_quality,
        mjpeg.op4_media,
        langid.op5_language_id,
        licenses.op6_licenses,
        sstable.op7_token_ids,
        html.op8_html,
        decontaminate.op9_decontaminate,
        simhash.op10_simhash,
        hilbert.op11_hilbert_shards,
        runs.op12_runs,
        bond.op13_hard_negatives,
        mjpeg.media_clips,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op11_hilbert_shards": hilbert.SQL, "op13_hard_negatives": bond.SQL}
