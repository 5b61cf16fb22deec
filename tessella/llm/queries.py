"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from tessella.llm.bpe import op1_bpe
from tessella.llm.bwt import OP6_SQL, op6_suffix_array
from tessella.llm.embeddings import OP3_SQL, op3_embeddings
from tessella.llm.licenses import op11_licenses
from tessella.llm.lm import op5_lm
from tessella.llm.minhash import OP4_SQL, op4_minhash
from tessella.llm.mining import OP13_SQL, op13_mining
from tessella.llm.mixing import op10_mixing
from tessella.llm.pii import op2_pii
from tessella.llm.quality import OP8_SQL, op8_quality
from tessella.llm.search import OP12_SQL, op12_search
from tessella.llm.secrets import op7_secrets
from tessella.llm.substring import OP9_SQL, op9_substring

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_embeddings": op3_embeddings,
    "op4_minhash": op4_minhash,
    "op5_lm": op5_lm,
    "op6_suffix_array": op6_suffix_array,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_substring": op9_substring,
    "op10_mixing": op10_mixing,
    "op11_licenses": op11_licenses,
    "op12_search": op12_search,
    "op13_mining": op13_mining,
}
ORACLE_SQL = {
    "op3_embeddings": OP3_SQL,
    "op4_minhash": OP4_SQL,
    "op6_suffix_array": OP6_SQL,
    "op8_quality": OP8_SQL,
    "op9_substring": OP9_SQL,
    "op12_search": OP12_SQL,
    "op13_mining": OP13_SQL,
}
