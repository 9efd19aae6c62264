"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import lines, merkle, urls, vectors
from .licenses import op13_licenses
from .lines import op6_line_runs
from .merkle import op11_merkle
from .minhash import op1_minhash
from .mixing import op10_pivotal
from .packing import op3_best_fit
from .quality import op9_ordinal
from .search import op8_multi_index
from .secrets import op2_secrets
from .sharding import op5_slots
from .urls import op7_rare_token
from .vectors import op4_epsilon_grid
from .whitening import op12_whitening

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_secrets": op2_secrets,
    "op3_best_fit": op3_best_fit,
    "op4_epsilon_grid": op4_epsilon_grid,
    "op5_slots": op5_slots,
    "op6_line_runs": op6_line_runs,
    "op7_rare_token": op7_rare_token,
    "op8_multi_index": op8_multi_index,
    "op9_ordinal": op9_ordinal,
    "op10_pivotal": op10_pivotal,
    "op11_merkle": op11_merkle,
    "op12_whitening": op12_whitening,
    "op13_licenses": op13_licenses,
}

ORACLES = {
    "op4_epsilon_grid": vectors.ORACLE,
    "op6_line_runs": lines.ORACLE,
    "op7_rare_token": urls.ORACLE,
    "op11_merkle": merkle.ORACLE,
}
