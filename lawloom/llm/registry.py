"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audio import op9_audio_features
from .chat import OP2_SQL, op2_chat_formatting
from .decontaminate import op1_decontamination
from .exactdedup import OP12_SQL, op12_exact_dedup
from .language import op6_language_id
from .linededup import op10_line_dedup
from .mixing import op4_source_mixing
from .quality import op7_quality_rules
from .resample import op11_importance_resampling
from .secrets import OP5_SQL, op5_secret_scan
from .simhash import op8_simhash_near_dedup
from .toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_toxicity": op3_toxicity,
    "op4_source_mixing": op4_source_mixing,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_audio_features": op9_audio_features,
    "op10_line_dedup": op10_line_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_exact_dedup": op12_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op5_secret_scan": OP5_SQL, "op12_exact_dedup": OP12_SQL}
