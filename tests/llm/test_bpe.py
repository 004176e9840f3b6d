import base64
import hashlib

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path

from gradus.llm import bpe

RANKS = bpe.read_ranks(path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.Encoder(RANKS, PATTERN, memory=50)


def ids(text):
    return np.frombuffer(OURS.encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abthe ingéß日本🙂01'\n\t!.ÀĐa"), max_size=80) | st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=40))
def test_as_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()


def test_long_pre_tokens():
    for text in ("a" * 100_000, "ab" * 30_000, "theing" * 20_000, "é" * 10_000, "=" * 9_999):
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_tables(spark, docs_of):
    texts = ["The quick brown fox", None, "", "日本語のテキスト  \n\n x"]
    rows = {r.doc_id: r for r in bpe.encode(docs_of(texts), RANKS, PATTERN, digests=True).collect()}
    for i, t in enumerate(texts):
        want = np.array(LIBRARY.encode_ordinary(t or ""), "<u4")
        assert rows[i].n_tokens == len(want) and rows[i].ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs_of(texts), RANKS, PATTERN), RANKS).collect()
    assert {r.doc_id: bytes(r.bytes).decode() for r in back} == {i: t or "" for i, t in enumerate(texts)}


def test_own_vocabulary(tmp_path):
    """Ranks where a merge opens a pair of lower rank."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abcd": 257, b"ab": 258, b"cd": 259, b"aa": 260, b"aaa": 261}
    (tmp_path / "v").write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    assert bpe.read_ranks(str(tmp_path / "v")) == ranks
    own = bpe.Encoder(ranks, PATTERN)
    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abcd", "abcdabcd", "aaaaaaa", "aabcdaa", "aaaab" * 50):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)
