"""Queries of the operators and their SQL counterparts."""

from __future__ import annotations

from timberline.llm.backoff_lm import op5_backoff_lm
from timberline.llm.chat_format import OP1_SQL, op1_chat_format
from timberline.llm.decontaminate import OP8_SQL, op8_decontaminate
from timberline.llm.line_dedup import OP7_SQL, op7_line_dedup
from timberline.llm.minhash import op9_minhash
from timberline.llm.packing import op3_packing
from timberline.llm.quality_rules import op4_quality_rules
from timberline.llm.repair import OP12_SQL, op12_repair
from timberline.llm.rule_ensemble import op6_rule_ensemble
from timberline.llm.runs import op11_runs
from timberline.llm.toxicity import op13_toxicity
from timberline.llm.url_filter import OP2_SQL, op2_url_filter
from timberline.llm.warc import OP10_SQL, op10_warc

REGISTRY = {
    "op1_chat_format": op1_chat_format,
    "op2_url_filter": op2_url_filter,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_backoff_lm": op5_backoff_lm,
    "op6_rule_ensemble": op6_rule_ensemble,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_minhash": op9_minhash,
    "op10_warc": op10_warc,
    "op11_runs": op11_runs,
    "op12_repair": op12_repair,
    "op13_toxicity": op13_toxicity,
}
SQL = {
    "op1_chat_format": OP1_SQL,
    "op2_url_filter": OP2_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
    "op10_warc": OP10_SQL,
    "op12_repair": OP12_SQL,
}
