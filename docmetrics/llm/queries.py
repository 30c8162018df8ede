"""Queries of this subpackage and their checking SQL."""

from __future__ import annotations

from docmetrics.llm.decontaminate import op3_decontamination
from docmetrics.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from docmetrics.llm.language import op8_language
from docmetrics.llm.main_text import op2_main_text
from docmetrics.llm.mixing import op9_mixing
from docmetrics.llm.near_duplicates import op1_near_duplicates
from docmetrics.llm.personal_data import op10_personal_data
from docmetrics.llm.quality import op4_quality
from docmetrics.llm.token_counts import op6_token_counts
from docmetrics.llm.token_files import op13_token_files
from docmetrics.llm.toxicity import op5_toxicity
from docmetrics.llm.warc import OP7_SQL, op7_warc
from docmetrics.llm.whitening import op12_whitening

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_main_text": op2_main_text,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_personal_data": op10_personal_data,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_token_files": op13_token_files,
}

ORACLE = {"op7_warc": OP7_SQL, "op11_hard_negatives": OP11_SQL}
