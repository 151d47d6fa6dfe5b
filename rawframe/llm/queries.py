"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .align import op13_alignment
from .bpe import op3_bpe
from .decontaminate import op7_decontaminate
from .divergence import OP12_SQL, op12_divergence
from .hilbert import op1_hilbert_shard
from .jaccard import op10_jaccard
from .language import op8_language
from .line_dedup import op9_line_dedup
from .quality import op4_quality
from .secrets import op5_secrets
from .substring_dedup import op2_substring_dedup
from .topk import OP6_SQL, op6_topk
from .url_filter import op11_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shard": op1_hilbert_shard,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_topk": op6_topk,
    "op7_decontaminate": op7_decontaminate,
    "op8_language": op8_language,
    "op9_line_dedup": op9_line_dedup,
    "op10_jaccard": op10_jaccard,
    "op11_url_filter": op11_url_filter,
    "op12_divergence": op12_divergence,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op6_topk": OP6_SQL, "op12_divergence": OP12_SQL}
