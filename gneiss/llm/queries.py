"""The operators' registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.bpe import op6_bpe
from gneiss.llm.chat_format import op4_chat_format
from gneiss.llm.common import table
from gneiss.llm.html_extract import op10_html_extract
from gneiss.llm.language_id import op2_language_id
from gneiss.llm.license_scan import op7_license_scan
from gneiss.llm.merkle import op5_merkle
from gneiss.llm.mixing import op8_mixing
from gneiss.llm.ngram_join import op3_ngram_join
from gneiss.llm.quality_rules import op9_quality_rules
from gneiss.llm.sql import ORACLES
from gneiss.llm.toxicity import op1_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_toxicity": lambda s, d: op1_toxicity(docs(s, d), table(s, d, "labels")),
        "op2_language_id": lambda s, d: op2_language_id(docs(s, d)),
        "op3_ngram_join": lambda s, d: op3_ngram_join(docs(s, d)),
        "op4_chat_format": lambda s, d: op4_chat_format(table(s, d, "conversations")),
        "op5_merkle": lambda s, d: op5_merkle(docs(s, d)),
        "op6_bpe": lambda s, d: op6_bpe(docs(s, d)),
        "op7_license_scan": lambda s, d: op7_license_scan(docs(s, d)),
        "op8_mixing": lambda s, d: op8_mixing(docs(s, d)),
        "op9_quality_rules": lambda s, d: op9_quality_rules(docs(s, d)),
        "op10_html_extract": lambda s, d: op10_html_extract(table(s, d, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
