"""The queries of the corpus operators, and their SQL where SQL can express them."""

from veriscope.llm.byte_bpe import op6_byte_bpe
from veriscope.llm.embedding_dedup import ORACLE as OP3_SQL
from veriscope.llm.embedding_dedup import op3_embedding_dedup
from veriscope.llm.html_text import op1_html_extraction
from veriscope.llm.pii_segments import op11_pii_segments
from veriscope.llm.quality_votes import op5_quality_rules
from veriscope.llm.repair_shards import op10_repair_shards
from veriscope.llm.secret_crf import op2_secret_crf
from veriscope.llm.shingle_join import ORACLE as OP9_SQL
from veriscope.llm.shingle_join import op9_shingle_join
from veriscope.llm.sketch_search import ORACLE as OP12_SQL
from veriscope.llm.sketch_search import op12_sketch_search
from veriscope.llm.source_mix import ORACLE as OP8_SQL
from veriscope.llm.source_mix import op8_source_mix
from veriscope.llm.spelling_groups import ORACLE as OP13_SQL
from veriscope.llm.spelling_groups import op13_spelling_groups
from veriscope.llm.suffix_dedup import op7_suffix_dedup
from veriscope.llm.toxic_cnn import op4_toxic_cnn

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_secret_crf": op2_secret_crf,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_toxic_cnn": op4_toxic_cnn,
    "op5_quality_rules": op5_quality_rules,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_shingle_join": op9_shingle_join,
    "op10_repair_shards": op10_repair_shards,
    "op11_pii_segments": op11_pii_segments,
    "op12_sketch_search": op12_sketch_search,
    "op13_spelling_groups": op13_spelling_groups,
}
ORACLES = {"op3_embedding_dedup": OP3_SQL, "op8_source_mix": OP8_SQL, "op9_shingle_join": OP9_SQL, "op12_sketch_search": OP12_SQL, "op13_spelling_groups": OP13_SQL}
