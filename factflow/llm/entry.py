"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from factflow.llm import (
    ann,
    decontaminate,
    html_text,
    langid,
    packing,
    pii,
    repeats,
    simhash,
    toxicity,
    url_filters,
)


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_html_text": html_text.op2_html_text,
        "op3_repeats": repeats.op3_repeats,
        "op4_pii": pii.op4_pii,
        "op5_packing": packing.op5_packing,
        "op6_ann": ann.op6_ann,
        "op7_simhash": simhash.op7_simhash,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_langid": langid.op10_langid,
        "op8_url_filters": url_filters.op8_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_repeats": repeats.oracle_sql(),
        "op8_url_filters": url_filters.oracle_sql(),
        "op9_decontaminate": decontaminate.oracle_sql(),
    }
