"""The queries of this subpackage and the SQL that checks them, by name."""

from __future__ import annotations

from sparkloom.llm.op1_warc import op1_warc_derivatives
from sparkloom.llm.op2_telephony import op2_telephony_audio
from sparkloom.llm.op3_packing import op3_sum_of_squares_packing
from sparkloom.llm.op4_lsh_forest import op4_lsh_forest
from sparkloom.llm.op5_byte_bpe import op5_byte_bpe
from sparkloom.llm.op6_factorisation import op6_factorisation_machine
from sparkloom.llm.op7_suffix_dedup import op7_suffix_dedup
from sparkloom.llm.op8_pseudonyms import op8_feistel_pseudonyms
from sparkloom.llm.op9_quality_rules import ABLATIONS_SQL, OP9_SQL, op9_rule_ledger, rule_ablations
from sparkloom.llm.op10_bfd import op10_best_fit_decreasing
from sparkloom.llm.op11_tput import OP11_SQL, op11_tput_search
from sparkloom.llm.op12_license_scan import OP12_SQL, op12_license_scan
from sparkloom.llm.op13_hard_negatives import OP13_SQL, op13_hard_negatives

_ALL = (
    op1_warc_derivatives,
    op2_telephony_audio,
    op3_sum_of_squares_packing,
    op4_lsh_forest,
    op5_byte_bpe,
    op6_factorisation_machine,
    op7_suffix_dedup,
    op8_feistel_pseudonyms,
    op9_rule_ledger,
    op10_best_fit_decreasing,
    op11_tput_search,
    op12_license_scan,
    op13_hard_negatives,
)
QUERIES = {f.__name__: f for f in (*_ALL, rule_ablations)}
ORACLES = {"op9_rule_ledger": OP9_SQL, "rule_ablations": ABLATIONS_SQL, "op11_tput_search": OP11_SQL, "op12_license_scan": OP12_SQL, "op13_hard_negatives": OP13_SQL}
