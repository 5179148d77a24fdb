"""Registry of the corpus queries and their SQL."""

from . import divergence, filter_audit, langid, media, mixing, quality_rules, secret_scan, sentencepiece_codec, sharding, simhash, simple8b, token_counts, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op3_secrets": secret_scan.op3_secrets,
    "op4_token_ids": simple8b.op4_token_ids,
    "op5_mix": mixing.op5_mix,
    "op6_simhash": simhash.op6_simhash,
    "op7_language": langid.op7_language,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_shards": sharding.op9_shards,
}
QUERIES["op10_media"] = media.op10_media
QUERIES["op11_filter_audit"] = filter_audit.op11_filter_audit
QUERIES["op12_warc"] = warc.op12_warc
QUERIES["op13_divergence"] = divergence.op13_divergence
ORACLES = {
    "op8_quality_rules": quality_rules.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_warc": warc.ORACLE_SQL,
    "op13_divergence": divergence.ORACLE_SQL,
}
