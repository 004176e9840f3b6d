"""Every operator on odd rows, empty tables and repeated rows."""

from collections import Counter

import pytest
from public_tokenizers import PATTERN, path
from samples import EDGES

import corpus_pipeline
from gradus.llm import bpe, language, mixing, pii, quality, repeats, simhash, weighted

RANKS = bpe.read_ranks(path("byte_bpe_multi_50k.tiktoken"))
NET = language.ByteNet(["de", "en"])
OPERATORS = {
    "weighted": lambda d: weighted.compare_edited(d, 16),
    "prints": lambda d: weighted.fingerprints(d, 16),
    "quality": lambda d: quality.score(d, quality.Machine.new(), ["n_chars", "source"]),
    "untrained quality": lambda d: quality.score(d, None),
    "language": lambda d: language.predict(d, NET),
    "untrained language": lambda d: language.predict(d, None),
    "mixing": mixing.mix,
    "bpe": lambda d: bpe.encode(d, RANKS, PATTERN, digests=True),
    "pii": lambda d: pii.find(d, pii.Field.new()),
    "simhash": simhash.groups,
    "repeats": repeats.without_repeats,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(docs_of, name):
    rows = [*enumerate(EDGES), (None, "null id"), (None, None), (3, "other text of a repeated id"), (3, "word")]
    docs = docs_of([(i, t, None if t == "" else "en", None if t == "word" else "s") for i, t in rows])
    found = OPERATORS[name](docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(docs_of, name):
    assert OPERATORS[name](docs_of([])).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs_of, k):
    name, stage = corpus_pipeline.STAGES[k]
    for rows in ([], [(i, t, "en", "s") for i, t in enumerate(EDGES)] + [(None, "null id", None, None)] * 2):
        docs = docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars")
        found = stage(spark, docs, "")
        if k < 4:
            assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]
        assert len(found.collect()) >= (len(rows) if k in (2, 4) else 0)
