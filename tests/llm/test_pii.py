import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            ):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("ab@..--12345 67890+()%\né"), max_size=70))
def test_patterns(text):
    assert pii.patterns(text)[0] == plain(text)


def test_cards():
    good, bad = "4539 1488 0343 6467", "4539 1488 0343 6468"
    assert pii.patterns(f"{good} x {bad}")[0] == [("card", 0, 19)]


def test_long_texts_take_linear_time():
    start = time.time()
    for part in ("1", "a.", "@", "a@", "1.", "+1", "a@b."):
        pii.patterns(part * 200_000)
    assert time.time() - start < 20


def test_long_runs_of_zeros():
    zeros = "0" * 5000
    assert pii.patterns(f"{zeros}1.2.3.{zeros}")[0] == [("ip", 0, 10_006)]
    assert pii.tokens(f"{zeros}1.2.3.{zeros}").spans == [(0, 10_006)]


def test_equal_tokens_agree_across_a_document():
    """The first of 60 equal numbers says what they are; all others follow."""
    found = pii.tokens(" words ".join(["1234567890"] * 60))
    assert len(found.ties) == 60 and set(found.ties[:, 1].tolist()) == {0}
    field = pii.Field.new()
    field.tie = 8.0
    begin = pii.LABELS.index("B-phone")
    graph = field.graph([found])
    graph[0][0, begin] += 30.0
    belief = field.messages(graph)[0][:60]
    assert (belief.argmax(axis=1) == begin).all()
    assert np.exp(belief[:, begin] - pii._log_sum(belief, 1)).min() > 0.9


def test_masked():
    text = "x a@b.cd y +1 (743) 555-3824 é 1.2.3.4"
    assert pii.masked(text, pii.patterns(text)[0]) == "x [EMAIL] y [PHONE] é [IP]"


def test_redact(docs_of):
    docs = docs_of(["mail a@b.cd now", None, "plain"])
    rows = {r.doc_id: r for r in pii.redact(docs, None).collect()}
    assert [rows[i].text for i in range(3)] == ["mail [EMAIL] now", None, "plain"]
    assert [rows[i].n_chars for i in range(3)] == [16, 0, 5] and rows[0].fp == "x" and rows[0].row == [1]


def made_up(rng, n):
    """Texts of which one in three has a phone number in full, and some have other numbers."""
    words = "ing the ous ter sch ein que oux".split()
    rows = []
    for i in range(n):
        extra = [f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", str(rng.randint(0, 99999)), f"a{i}@mail.example.com"][i % 3]
        rows.append(" ".join([*rng.choices(words, k=20), extra, *rng.choices(words, k=9)]))
    return rows


def test_only_the_tie_decides(docs_of):
    """A local number is an entity where the document has it in full as well, and nowhere else; without ties it never is."""
    field = pii.fit(docs_of(made_up(random.Random(3), 600)), sample=600)
    full, local = "ring +1 (743) 555-3824 or the ous {} later", "743-555-3824"
    text = full.format(local)
    begin = text.index(local)
    (base, every) = pii.search([text], field)[0]
    assert set(every) - set(base) == {("phone", begin, begin + len(local))}
    assert pii.search([full.format("743-555-9999"), f"ring the ous {local} later"], field) == [(b, b) for b in ([("phone", 5, 22)], [])]
    field.tie = 0.0
    assert pii.search([text], field)[0] == (base, base)


def test_messages_with_ties_on_a_tree():
    """Marginals against all assignments of three tied tokens, a chain and their hub."""
    field, rng = pii.Field.new(), np.random.default_rng(4)
    field.unary[:] = rng.normal(0, 1, field.unary.shape)
    field.chain += rng.normal(0, 1, field.chain.shape)
    field.tie = 1.3
    doc = pii.tokens("555-3824 12 or 7435553824 or 1 2")
    doc.ties = np.array([[0, 0], [2, 0]])
    graph = field.graph([doc])
    nodes, a, b, chains, _ = graph
    assert chains == 2 and len(nodes) == 6 and len(a) == 4
    total, n = np.zeros_like(nodes), len(nodes)
    y = np.stack(np.unravel_index(np.arange(pii.L**n), (pii.L,) * n), axis=1)
    p = sum(nodes[i, y[:, i]] for i in range(n))
    p = p + sum(field.chain[y[:, a[e]], y[:, b[e]]] for e in range(chains)) + sum(field.tie * pii.AGREE[y[:, a[e]], y[:, b[e]]] for e in range(chains, len(a)))
    p = np.exp(p - p.max())
    for i in range(n):
        total[i] = np.bincount(y[:, i], p, pii.L)
    belief, *_ = field.messages(graph)
    assert np.allclose(np.exp(belief - pii._log_sum(belief, 1)[:, None]), total / total.sum(axis=1, keepdims=True), atol=1e-4)


def test_spans_apart_from_others():
    rng = random.Random(6)
    for _ in range(200):
        spans = lambda n: sorted((k, a, a + rng.randint(1, 9)) for k in ("ip", "card") for a in rng.sample(range(60), n))
        own, more = sorted(spans(rng.randint(0, 4)), key=lambda s: s[1]), spans(5)
        assert pii.apart(more, own) == [s for s in more if all(s[2] <= b[1] or b[2] <= s[1] for b in own)]


def test_a_document_is_labelled_alike_in_any_block():
    field = pii.Field.new()
    field.unary[:] = np.random.default_rng(7).normal(0, 0.4, field.unary.shape)
    texts = made_up(random.Random(8), 30) + ["12 34 56 78 1234567 and 21234567 or 41234567 " * 9]
    assert [pii.search([t], field)[0] for t in texts] == pii.search(texts, field)
