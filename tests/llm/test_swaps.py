"""Values that stand in another column, next to nulls, are other rows to every stage."""

import pytest

from pagemill.llm import chosenpath, lines, mixing, quality
from tests.llm.conftest import prose
from tests.llm.test_quality import labelled

TEXT = prose(77, 40)
PAIRS = {
    "mixing": (mixing.mixed_documents, [(1, TEXT, "en", None), (1, None, "en", TEXT)]),
    "lines": (lines.deduplicated_lines, [(5, None), (None, "5"), (None, None), (5, "5")]),
    "jaccard": (chosenpath.one_of_each, [(5, None), (None, "5"), (None, TEXT), (6, TEXT + " end")]),
    "quality": (quality.good_documents, [(500, TEXT, None), (500, None, TEXT)]),
}


@pytest.mark.parametrize("name", PAIRS)
def test_swaps_with_nulls(spark, docs_of, tmp_path, name):
    stage, rows = PAIRS[name]
    docs = docs_of(rows + [(100 + i, prose(i, 60)) for i in range(30)])
    d = labelled(spark, tmp_path, docs) if name == "quality" else str(tmp_path)
    kept = [r for r in stage(spark, docs, d).select("doc_id", "text", "lang", "source").collect() if r.doc_id is None or r.doc_id < 100 or r.doc_id == 500]
    if name == "mixing":
        assert any(r.text == TEXT for r in kept) and all(r.text is not None for r in kept)
    elif name == "jaccard":
        assert sorted((r.doc_id or 0, r.text is None) for r in kept)[:2] == [(0, False), (5, True)] and len(kept) == 3  # one of the long ones
    else:
        assert len(kept) == len(rows)
