"""The operators' queries over the check tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsloom.llm.q_chat import CHAT_SQL, op10_chat_events
from opsloom.llm.q_codes import CODES_SQL, op12_grid_cells
from opsloom.llm.q_decontamination import op8_decontamination
from opsloom.llm.q_divergence import DIVERGENCE_SQL, op13_count_cells
from opsloom.llm.q_hilbert import op3_hilbert
from opsloom.llm.q_language import op11_language_families
from opsloom.llm.q_lines import op7_fuzzy_lines
from opsloom.llm.q_packing import op4_packing
from opsloom.llm.q_paragraphs import op5_paragraph_minhash
from opsloom.llm.q_pii import op2_pii_boosting
from opsloom.llm.q_quality import op1_quality_divergence
from opsloom.llm.q_secrets import op9_secret_ledger
from opsloom.llm.q_simhash import op6_simhash_embedding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_divergence,
        op2_pii_boosting,
        op3_hilbert,
        op4_packing,
        op5_paragraph_minhash,
        op6_simhash_embedding,
        op7_fuzzy_lines,
        op8_decontamination,
        op9_secret_ledger,
        op10_chat_events,
        op11_language_families,
        op12_grid_cells,
        op13_count_cells,
    )
}

ORACLE: dict[str, str] = {
    "op10_chat_events": CHAT_SQL,
    "op12_grid_cells": CODES_SQL,
    "op13_count_cells": DIVERGENCE_SQL,
}
