"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tracelake.llm import collocations as _collocations
from tracelake.llm import decontamination as _decon
from tracelake.llm import line_dedup as _line
from tracelake.llm import packing as _pack
from tracelake.llm import quality_classifier as _quality
from tracelake.llm import quality_rules as _rules
from tracelake.llm import secret_scan as _secrets
from tracelake.llm import simhash as _simhash
from tracelake.llm import spelling as _spelling
from tracelake.llm import substring_dedup as _substring
from tracelake.llm import suffix_dedup as _suffix
from tracelake.llm import toxicity as _toxicity
from tracelake.llm import warc as _warc

QUERIES = {
    "op1_toxicity": _toxicity.op1_toxicity,
    "op2_simhash": _simhash.op2_simhash,
    "op3_suffix_dedup": _suffix.op3_suffix_dedup,
    "op4_secret_scan": _secrets.op4_secret_scan,
    "op5_line_dedup": _line.op5_line_dedup,
    "op6_decontamination": _decon.op6_decontamination,
    "op7_substring_dedup": _substring.op7_substring_dedup,
    "op8_packing": _pack.op8_packing,
    "op9_quality_rules": _rules.op9_quality_rules,
    "op10_quality_classifier": _quality.op10_quality_classifier,
    "op11_warc": _warc.op11_warc,
    "op12_spelling": _spelling.op12_spelling,
    "op13_collocations": _collocations.op13_collocations,
    "conversation_packing": _pack.conversation_packing,
}

ORACLE_SQL = {
    "op4_secret_scan": _secrets.OP4_SQL,
    "op5_line_dedup": _line.OP5_SQL,
    "op6_decontamination": _decon.OP6_SQL,
    "op7_substring_dedup": _substring.OP7_SQL,
    "op9_quality_rules": _rules.OP9_SQL,
    "op11_warc": _warc.OP11_SQL,
    "op12_spelling": _spelling.OP12_SQL,
    "op13_collocations": _collocations.OP13_SQL,
}
