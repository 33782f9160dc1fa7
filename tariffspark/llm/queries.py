"""Registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from . import alignment as op11
from . import ann as op5
from . import bpe as op6
from . import ctw as op9
from . import decontamination as op2
from . import html_text as op12
from . import license_scan as op4
from . import near_dedup as op10
from . import ranked_search as op13
from . import sharding as op7
from . import substring_dedup as op1
from . import token_files as op8
from . import toxicity as op3

QUERIES = {
    "op1_substring_dedup": op1.op1_substring_dedup,
    "op2_decontamination": op2.op2_decontamination,
    "op3_toxicity": op3.op3_toxicity,
    "op4_license_scan": op4.op4_license_scan,
    "op5_ann": op5.op5_ann,
    "op6_bpe": op6.op6_bpe,
    "op7_sharding": op7.op7_sharding,
    "op8_token_files": op8.op8_token_files,
    "op9_ctw": op9.op9_ctw,
    "op10_near_dedup": op10.op10_near_dedup,
    "op11_alignment": op11.op11_alignment,
    "op12_html_text": op12.op12_html_text,
    "op13_ranked_search": op13.op13_ranked_search,
}
SQL = {"op1_substring_dedup": op1.OP1_SQL, "op2_decontamination": op2.OP2_SQL, "op7_sharding": op7.OP7_SQL, "op10_near_dedup": op10.OP10_SQL, "op12_html_text": op12.OP12_SQL, "op13_ranked_search": op13.OP13_SQL}
