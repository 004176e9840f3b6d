"""Learned operators, by held-out accuracy on made-up tables."""

import random

import numpy as np

from gradus.llm import language, pii, quality

SYLLABLES = {"en": "the ing ous and ter", "de": "der sch ung ein ßen", "fr": "que eau les ême oux"}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(n))


def test_windows_cover_every_sequence():
    data = bytes(np.random.default_rng(0).integers(1, 255, 5000, np.uint8))
    for n in (0, 1, 3, 4, 255, 256, 257, 509, 510, 5000):
        seen = {w.tobytes()[i : i + 4] for w in language.windows(data[:n]) for i in range(253)}
        assert {data[i : i + 4] for i in range(n - 3)} <= seen


def test_gradients():
    net = language.ByteNet(["a", "b"], filters=2, size=3)
    net.p = {n: v.astype(np.float64) for n, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (5, 256)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    loss = lambda: -net.log_probabilities(x, net.tables())[np.arange(5), y].mean()
    for name, g in net.gradients(x, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = net.p[name][at], 1e-6
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        assert abs((up - loss()) / (2 * step) - g[at]) < 1e-4
        net.p[name][at] = old


def test_language(docs_of):
    rng = random.Random(0)
    rows = [(i, text(rng, lang, rng.choice([2, 20, 300])), lang, "s") for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    rows += [(9000, "123 !?", "en", "s"), (9001, None, "en", "s"), (9002, "", None, "s")]
    docs = docs_of(rows)
    net = language.fit(docs.where("doc_id % 4 > 0"), each=100)
    found = {r.doc_id: r for r in language.predict(docs, net).collect()}
    assert np.mean([found[i].lang_pred == lang for i, _, lang, _ in rows[:600] if i % 4 == 0]) > 0.95
    assert {found[i].lang_pred for i in (9000, 9001, 9002)} == {"und"}
    assert {r.doc_id for r in language.accepted(docs, net, 0.0).collect()} == set(range(600))
    assert language.fit(docs.where("lang IS NULL")) is None


def test_quality(spark, docs_of):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = text(rng, "en", 60).split()
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), "en", "s"))
        labels.append((i, int(good)))
    docs = docs_of(rows)
    machine = quality.fit(docs, spark.createDataFrame([*labels[:450], (3, None), (None, 1)], "doc_id long, quality int"), each=100)
    scores = {r.doc_id: r.score for r in quality.score(docs, machine).collect()}
    assert np.mean([(scores[i] >= 0.3) == good for i, good in labels[450:]]) > 0.97
    assert quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) is None


def test_factorisation_identity():
    machine, rng = quality.Machine.new(), np.random.default_rng(2)
    index, value = rng.choice(quality.SIZE, 12, replace=False), rng.random(12).astype(np.float32)
    pairs = sum(float(machine.factors[i] @ machine.factors[j]) * a * b for k, (i, a) in enumerate(zip(index, value)) for j, b in zip(index[:k], value[:k]))  # noqa: B905
    assert abs(machine.margin(index, value) - pairs) < 1e-5


def luhn_number(rng):
    stem = "4" + "".join(rng.choices("0123456789", k=14))
    return next(stem + c for c in "0123456789" if pii.luhn(stem + c))


def test_field_adds_what_patterns_miss(docs_of):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        extra = [luhn_number(rng), f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"a{i}@mail.example.com", f"10.{i % 250}.3.4", str(rng.randint(0, 99999))]
        rows.append((i, " ".join([*text(rng, "en", 20).split(), rng.choice(extra), *text(rng, "en", 5).split()]), "en", "s"))
    field = pii.fit(docs_of(rows), sample=300)
    card = luhn_number(rng)
    (base, every) = pii.search([f"we the {card} {card} ingous and 4785 terand 12.5"], field)[0]
    assert base == [] and every == [("card", 7, 23), ("card", 24, 40)]
    plain = [pii.search([t], field)[0] for _, t, _, _ in rows]
    assert sum(set(e) != set(b) for b, e in plain) <= 3


def test_messages_are_exact_on_chains():
    """Marginals of a chain against all assignments."""
    field, rng = pii.Field.new(), np.random.default_rng(3)
    field.unary[:] = rng.normal(0, 1, field.unary.shape)
    field.chain += rng.normal(0, 1, field.chain.shape)
    doc = pii.tokens("see 4785 12.1.1.1 +1 x")
    graph = field.graph([doc])
    nodes = graph[0]
    total = np.zeros_like(nodes)
    for y in np.ndindex(*(pii.L,) * len(nodes)):
        p = np.exp(sum(nodes[i, v] for i, v in enumerate(y)) + sum(field.chain[y[i], y[i + 1]] for i in range(len(y) - 1)))
        for i, v in enumerate(y):
            total[i, v] += p
    belief, *_ = field.messages(graph)
    assert np.allclose(np.exp(belief - pii._log_sum(belief, 1)[:, None]), total / total.sum(axis=1, keepdims=True), atol=1e-6)
