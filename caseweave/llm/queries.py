"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from caseweave.llm.fingerprint import op2_fingerprint
from caseweave.llm.langid import language_of_pages, op7_language
from caseweave.llm.mixing import OP1_SQL, op1_mix
from caseweave.llm.neardup import op3_near_duplicates
from caseweave.llm.packing import op6_pack
from caseweave.llm.quality import op9_quality
from caseweave.llm.suffixdedup import op5_suffix_dedup
from caseweave.llm.topk import OP8_SQL, op8_top_k
from caseweave.llm.turnrepair import op12_turn_repair
from caseweave.llm.urlrules import op4_url_rules
from caseweave.llm.vectorcodes import OP13_SQL, op13_vector_codes
from caseweave.llm.warc import OP10_SQL, op10_warc
from caseweave.llm.windowdedup import OP11_SQL, op11_window_dedup

QUERIES = {
    "op1_mix": op1_mix,
    "op2_fingerprint": op2_fingerprint,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_url_rules": op4_url_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pack": op6_pack,
    "op7_language": op7_language,
    "op8_top_k": op8_top_k,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_window_dedup": op11_window_dedup,
    "op12_turn_repair": op12_turn_repair,
    "op13_vector_codes": op13_vector_codes,
    "language_of_pages": language_of_pages,
}

SQL = {"op1_mix": OP1_SQL, "op8_top_k": OP8_SQL, "op10_warc": OP10_SQL, "op11_window_dedup": OP11_SQL, "op13_vector_codes": OP13_SQL}
