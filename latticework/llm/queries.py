"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from . import alignment, bm25, bpe, chat, langid, licences, near_dup, packing, pieces, repetition, urls, vector_codes, warc


def queries():
    import corpus_pipeline

    return {
        "op1_bm25_search": bm25.op1_bm25_search,
        "op2_byte_bpe": bpe.op2_byte_bpe,
        "op3_near_duplicates": near_dup.op3_near_duplicates,
        "op4_repetition_rules": repetition.op4_repetition_rules,
        "op5_licence_scan": licences.op5_licence_scan,
        "op6_url_filters": urls.op6_url_filters,
        "op7_preference_format": chat.op7_preference_format,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_warc": warc.op9_warc,
        "op10_language_id": langid.op10_language_id,
        "op11_sentencepiece": pieces.op11_sentencepiece,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_cross_tokenizer": alignment.op13_cross_tokenizer,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op1_bm25_search": bm25.OP1_SQL,
        "op5_licence_scan": licences.OP5_SQL,
        "op6_url_filters": urls.OP6_SQL,
        "op7_preference_format": chat.OP7_SQL,
        "op9_warc": warc.OP9_SQL,
        "op12_vector_codes": vector_codes.OP12_SQL,
    }
