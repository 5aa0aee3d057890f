"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .contamination import op6_decontaminate
from .html_text import op4_html_extraction
from .jaccard import OP2_SQL, op2_ngram_jaccard
from .language import op9_language_id
from .mixing import op1_mix_sources
from .personal import op10_personal_data
from .quality_model import op7_quality_classifier
from .quality_rules import OP3_SQL, op3_quality_rules
from .secrets import op8_secret_scans
from .url_templates import op5_url_templates


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mix_sources": op1_mix_sources, "op2_ngram_jaccard": op2_ngram_jaccard, "op3_quality_rules": op3_quality_rules, "op4_html_extraction": op4_html_extraction, "op5_url_templates": op5_url_templates, "op6_decontaminate": op6_decontaminate, "op7_quality_classifier": op7_quality_classifier, "op8_secret_scans": op8_secret_scans, "op9_language_id": op9_language_id, "op10_personal_data": op10_personal_data}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_SQL, "op3_quality_rules": OP3_SQL}
