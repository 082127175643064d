"""The registered query of each operator, and its SQL where SQL can say the same."""

from __future__ import annotations

from corpuslens.llm.byte_bpe import op5_byte_bpe
from corpuslens.llm.html_text import op9_html_text
from corpuslens.llm.line_dedup import OP13_SQL, op13_line_dedup
from corpuslens.llm.merkle import OP12_SQL, op12_merkle
from corpuslens.llm.packing import op8_packing
from corpuslens.llm.quality_model import op1_quality
from corpuslens.llm.quality_rules import OP4_SQL, op4_quality_rules
from corpuslens.llm.ranked_search import OP11_SQL, op11_ranked_search
from corpuslens.llm.simhash import op10_simhash
from corpuslens.llm.substrings import op7_repeats
from corpuslens.llm.token_files import op6_token_files
from corpuslens.llm.topk import OP2_SQL, op2_top_k
from corpuslens.llm.warc_zip import op3_warc_zip
from corpuslens.plans.registry import shipped

QUERIES = {f.__name__: shipped(f) for f in (op1_quality, op2_top_k, op3_warc_zip, op4_quality_rules, op5_byte_bpe, op6_token_files, op7_repeats, op8_packing, op9_html_text, op10_simhash, op11_ranked_search, op12_merkle, op13_line_dedup)}
TWINS: dict[str, str] = {"op2_top_k": OP2_SQL, "op4_quality_rules": OP4_SQL, "op11_ranked_search": OP11_SQL, "op12_merkle": OP12_SQL, "op13_line_dedup": OP13_SQL}
