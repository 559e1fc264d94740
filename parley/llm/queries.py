"""Queries of this subpackage for the entry module, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm.ann import op5_ann
from parley.llm.chat import OP2_SQL, op2_chat
from parley.llm.decontaminate import op1_decontaminate
from parley.llm.langid import op6_langid
from parley.llm.mixing import OP9_SQL, op9_mixing
from parley.llm.quality import op3_quality
from parley.llm.repeats import op4_repeats
from parley.llm.secrets import op7_secrets
from parley.llm.simhash import op10_simhash
from parley.llm.toxicity import op8_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontaminate": op1_decontaminate, "op2_chat": op2_chat, "op3_quality": op3_quality, "op4_repeats": op4_repeats, "op5_ann": op5_ann, "op6_langid": op6_langid, "op8_toxicity": op8_toxicity, "op7_secrets": op7_secrets, "op9_mixing": op9_mixing, "op10_simhash": op10_simhash}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": OP2_SQL, "op9_mixing": OP9_SQL}
