"""Queries of this package and the SQL for those that SQL can express."""

from .bpe import op1_bpe
from .fingerprints import op3_fingerprints
from .lexical import ORACLE_OP11, op11_search
from .line_dedup import ORACLE_OP7, op7_line_dedup
from .lm_score import op5_lm_score
from .packing import op2_packing
from .pii import op9_pii
from .prefix_trie import ORACLE_OP13, op13_prefix_trie
from .quality import op4_quality
from .rules import op6_rules
from .sharding import op10_sharding
from .simhash import op8_simhash
from .suffix_dedup import ORACLE_OP12, op12_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_bpe, op2_packing, op3_fingerprints, op4_quality, op5_lm_score, op6_rules, op7_line_dedup, op8_simhash, op9_pii, op10_sharding, op11_search, op12_suffix_dedup, op13_prefix_trie)}
ORACLE: dict[str, str] = {"op7_line_dedup": ORACLE_OP7, "op11_search": ORACLE_OP11, "op12_suffix_dedup": ORACLE_OP12, "op13_prefix_trie": ORACLE_OP13}
