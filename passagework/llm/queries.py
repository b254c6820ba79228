"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bitslice import OP1_SQL, op1_top_k
from .bpe import op3_token_counts, op4_byte_bpe
from .clusters import OP13_SQL, op13_centroid_clusters
from .langid import op5_language_id
from .lattice import op6_lattice_score
from .minhash import OP7_SQL, op7_minhash_dedup
from .mixing import OP2_SQL, op2_mix_sources
from .negatives import OP11_SQL, op11_hard_negatives
from .pii import op9_personal_data
from .sharding import OP12_SQL, op12_shards
from .tiles import OP8_SQL, op8_embedding_dedup
from .urls import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_mix_sources": op2_mix_sources,
    "op3_token_counts": op3_token_counts,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_language_id": op5_language_id,
    "op6_lattice_score": op6_lattice_score,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_personal_data": op9_personal_data,
    "op10_url_filter": op10_url_filter,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_shards": op12_shards,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLES = {
    "op1_top_k": OP1_SQL,
    "op2_mix_sources": OP2_SQL,
    "op7_minhash_dedup": OP7_SQL,
    "op8_embedding_dedup": OP8_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_shards": OP12_SQL,
    "op13_centroid_clusters": OP13_SQL,
}
