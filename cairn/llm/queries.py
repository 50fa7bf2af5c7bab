"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, warc
from .bpe import op8_bpe_codec
from .html_text import op9_html_text
from .line_dedup import op10_line_dedup
from .ngram_join import op6_ngram_join
from .periodic import op12_periodic_runs
from .quality import op7_quality
from .resample import op13_resample
from .search import op2_top_k
from .secrets import op11_secrets
from .token_counts import op1_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_top_k": op2_top_k,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_warc": warc.op5_warc,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality": op7_quality,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_html_text": op9_html_text,
    "op10_line_dedup": op10_line_dedup,
    "op11_secrets": op11_secrets,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_resample": op13_resample,
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": licenses.oracle(),
    "op4_decontaminate": decontaminate.oracle(),
    "op5_warc": warc.ORACLE_SQL,
}
