"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import additive, chat, collisions, html_content, importance, mixing, neardup, packing, quality, urlrank, warc, wavelet, whitening


def queries() -> dict:
    return {
        "op1_packing": packing.op1,
        "op2_quality": quality.op2,
        "op3_neardup": neardup.op3,
        "op4_wavelet": wavelet.op4,
        "op5_mixing": mixing.op5,
        "op6_urls": urlrank.op6,
        "op7_embeddings": collisions.op7,
        "op8_chat": chat.op8,
        "op9_html": html_content.op9,
        "op10_ann": additive.op10,
        "op11_whitening": whitening.op11,
        "op12_importance": importance.op12,
        "op13_warc": warc.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": mixing.SQL,
        "op6_urls": urlrank.SQL,
        "op8_chat": chat.SQL,
        "op13_warc": warc.SQL,
    }
