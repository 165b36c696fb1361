"""The operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.bpe import op6_bpe_round_trip
from shelfmark.llm.chat import op9_chat_formatting
from shelfmark.llm.decontaminate import op1_decontamination
from shelfmark.llm.html_text import op8_html_extraction
from shelfmark.llm.language_id import op13_language_id
from shelfmark.llm.licenses import op2_license_scans
from shelfmark.llm.oracle import ORACLES
from shelfmark.llm.periodic_runs import op11_periodic_runs
from shelfmark.llm.quality_rules import op7_quality_rules
from shelfmark.llm.secrets import op3_secret_scans
from shelfmark.llm.simhash import op4_simhash_near_dedup
from shelfmark.llm.token_counts import op10_token_counts
from shelfmark.llm.toxicity import op5_toxicity
from shelfmark.llm.whitening import op12_embedding_whitening

Query = Callable[[SparkSession, str], DataFrame]


QUERIES = (
    op1_decontamination,
    op2_license_scans,
    op3_secret_scans,
    op4_simhash_near_dedup,
    op5_toxicity,
    op6_bpe_round_trip,
    op7_quality_rules,
    op8_html_extraction,
    op9_chat_formatting,
    op10_token_counts,
    op11_periodic_runs,
    op12_embedding_whitening,
    op13_language_id,
)


def registry() -> dict[str, Query]:
    return {query.__name__: query for query in QUERIES}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
