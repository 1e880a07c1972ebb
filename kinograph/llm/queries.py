"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from kinograph.llm.bpe import op8_bpe
from kinograph.llm.codes import op13_codes
from kinograph.llm.codes import oracle as code_sql
from kinograph.llm.langid import op10_langid
from kinograph.llm.decontaminate import op4_decontaminate
from kinograph.llm.jaccard import op1_jaccard
from kinograph.llm.licences import op2_licences
from kinograph.llm.licences import oracle as licence_sql
from kinograph.llm.lines import op11_lines
from kinograph.llm.lines import oracle as line_sql
from kinograph.llm.lm import op9_lm
from kinograph.llm.negatives import op12_negatives
from kinograph.llm.negatives import oracle as negative_sql
from kinograph.llm.quality import op7_quality
from kinograph.llm.shards import op5_shards
from kinograph.llm.simhash import op3_simhash
from kinograph.llm.warc import op6_warc

QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_licences": op2_licences,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_shards": op5_shards,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_lm": op9_lm,
    "op10_langid": op10_langid,
    "op11_lines": op11_lines,
    "op12_negatives": op12_negatives,
    "op13_codes": op13_codes,
}
ORACLES: dict[str, str] = {"op2_licences": licence_sql(), "op11_lines": line_sql(), "op12_negatives": negative_sql(), "op13_codes": code_sql()}
