"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pathloom.llm import decontaminate, filter_audit, licenses, line_dups, mixing, near_dups, prefix_trie, quality_rules, repeats, sharding, token_planes, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        decontaminate.op1_decontaminate,
        near_dups.op2_minhash_near_dups,
        token_planes.op3_token_planes,
        quality_rules.op4_quality_rules,
        repeats.op5_repeated_passages,
        mixing.op6_pfair_mix,
        licenses.op7_license_scan,
        toxicity.op8_kneser_ney_toxicity,
        line_dups.op9_fuzzy_lines,
        sharding.op10_rendezvous_shards,
        filter_audit.op11_filter_audit,
        warc.op12_arc_to_warc,
        prefix_trie.op13_prefix_trie,
    )
}

ORACLES = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op2_minhash_near_dups": near_dups.OP2_SQL,
    "op5_repeated_passages": repeats.OP5_SQL,
    "op6_pfair_mix": mixing.OP6_SQL,
    "op10_rendezvous_shards": sharding.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_arc_to_warc": warc.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
