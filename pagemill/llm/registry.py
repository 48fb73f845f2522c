"""The queries of this subpackage and their SQL."""

from pagemill.llm import anchors, chosenpath, codes, fingerprints, licenses, lines, mixing, neighbours, packing, pii, quality, turns, urls

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_lines": lines.op2_lines,
    "op3_quality": quality.op3_quality,
    "op4_jaccard": chosenpath.op4_jaccard,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_repeats": anchors.op7_repeats,
    "op8_licenses": licenses.op8_licenses,
    "op9_packing": packing.op9_packing,
    "op10_mixing": mixing.op10_mixing,
    "op11_codes": codes.op11_codes,
    "op12_urls": urls.op12_urls,
    "op13_turns": turns.op13_turns,
}
ORACLES = {
    "op5_neighbours": neighbours.ORACLE,
    "op7_repeats": anchors.ORACLE,
    "op8_licenses": licenses.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_codes": codes.ORACLE,
    "op12_urls": urls.ORACLE,
    "op13_turns": turns.ORACLE,
}
