"""The registered queries of this package: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from kestrel.llm import (
    compression,
    decontaminate,
    language,
    licenses,
    linededup,
    mixing,
    neardup,
    quality,
    ruleset,
    tokens,
    toxicity,
    urls,
    whitening,
)

QUERIES = {
    "op1_neardup": (neardup.op1_neardup, None),
    "op2_tokens": (tokens.op2_tokens, None),
    "op3_lines": (linededup.op3_lines, None),
    "op4_urls": (urls.op4_urls, urls.OP4_SQL),
    "op5_licenses": (licenses.op5_licenses, None),
    "op6_language": (language.op6_language, None),
    "op7_decontaminate": (decontaminate.op7_decontaminate, None),
    "op8_quality": (quality.op8_quality, None),
    "op9_toxicity": (toxicity.op9_toxicity, None),
    "op10_mix": (mixing.op10_mix, mixing.OP10_SQL),
    "op11_ruleset": (ruleset.op11_ruleset, None),
    "op12_compression": (compression.op12_compression, compression.OP12_SQL),
    "op13_whitening": (whitening.op13_whitening, None),
}
