"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tracepath.llm.best_fit_pack import op10_best_fit_pack
from tracepath.llm.byte_bpe import op9_byte_bpe
from tracepath.llm.chat_format import op4_chat_format
from tracepath.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from tracepath.llm.language_id import op7_language_id
from tracepath.llm.license_scan import op2_license_scan
from tracepath.llm.quality_rules import OP1_SQL, op1_quality_rules
from tracepath.llm.repeats import op13_suffix_dedup
from tracepath.llm.secret_scan import OP8_SQL, op8_secret_scan
from tracepath.llm.simhash_dedup import op3_simhash_dedup
from tracepath.llm.spelling import op12_spelling_variants
from tracepath.llm.url_filter import OP6_SQL, op6_url_filter
from tracepath.llm.whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_license_scan, op3_simhash_dedup, op4_chat_format, op5_exact_dedup, op6_url_filter, op7_language_id, op8_secret_scan, op9_byte_bpe, op10_best_fit_pack, op11_whitening, op12_spelling_variants, op13_suffix_dedup)
}
SQL = {"op1_quality_rules": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op6_url_filter": OP6_SQL, "op8_secret_scan": OP8_SQL}
