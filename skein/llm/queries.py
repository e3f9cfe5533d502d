"""The queries of this subpackage and the SQL of those that SQL can express."""

from skein.llm.conversations import OP12_SQL, op12_repair
from skein.llm.decontaminate import OP8_SQL, op8_decontaminate
from skein.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from skein.llm.language_id import op10_language_id
from skein.llm.line_dedup import op5_line_dedup
from skein.llm.lm_scoring import op1_lm_score
from skein.llm.mixing import OP4_SQL, op4_mix_sources
from skein.llm.ngram_join import OP6_SQL, op6_ngram_join
from skein.llm.packing import op11_packing
from skein.llm.quality import op2_quality
from skein.llm.spelling import OP13_SQL, op13_spelling
from skein.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from skein.llm.suffix_dedup import OP3_SQL, op3_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_lm_score, op2_quality, op3_suffix_dedup, op4_mix_sources, op5_line_dedup, op6_ngram_join, op7_substring_dedup, op8_decontaminate, op9_exact_dedup, op10_language_id, op11_packing, op12_repair, op13_spelling)}
SQL = {"op3_suffix_dedup": OP3_SQL, "op4_mix_sources": OP4_SQL, "op6_ngram_join": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op8_decontaminate": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op12_repair": OP12_SQL, "op13_spelling": OP13_SQL}
