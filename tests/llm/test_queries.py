"""Every registered query of the subpackage beside a plain version, on whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import test_bpe
import test_mixing
import test_pii
import test_simhash
import test_tables

import corpus_pipeline
from gradus.llm import language, mixing, pii, queries, weighted

SF = "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def run(spark, name, sf=SF):
    df = queries.QUERIES[name](spark, sf)
    return {c: k for c, k in df.dtypes}, df.collect()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in table(spark, "documents")}


def test_op1(spark, docs):
    kinds, rows = run(spark, "op1_fingerprint")
    assert kinds["n_chars"] == "bigint" and kinds["near_edited"] == kinds["near_next"] == "double"
    found, ids, sampler = {r.doc_id: r for r in rows}, sorted(docs), weighted.Sampler(128, 5)
    assert len(rows) == len(found) == len(docs)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        a, b = docs[i].text or "", docs[j].text or ""
        edited = weighted.edit(a, b)
        prints = [sampler.fingerprint(x) for x in (a, edited, b)]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple(map(weighted.to_text, prints[:2]))
        assert (r.near_edited, r.near_next) == (weighted.likeness(*prints[:2]), weighted.likeness(prints[0], prints[2]))


def test_op2(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(queries.ORACLE["op2_chat_collapse"])
    df = queries.QUERIES["op2_chat_collapse"](spark, SF)
    assert sorted(tuple(r) for r in df.select(want.columns).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_op3(spark, sf):
    labels = {r.doc_id: r.quality for r in table(spark, "labels", sf)}
    kinds, rows = run(spark, "op3_quality", sf)
    assert kinds["score"] == "double" and kinds["predicted"] == "int"
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in rows)
    assert len(rows) == len(table(spark, "documents", sf))
    bad, good = ([r.predicted for r in rows if r.held_out and labels.get(r.doc_id) == q] for q in (0, 1))
    assert bad and np.mean(bad) <= 0.1 and np.mean(good) >= 0.98


def test_op4(spark):
    pages = {r.page_id: r for r in table(spark, "pages")}
    _, rows = run(spark, "op4_urls")
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows:
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", pages[r.page_id].url or "")
        host, path = (m[1].lower() if m[1].isascii() else m[1], m[2]) if m else ("", "")
        fits = [(rule, v) for v, rule in queries.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_op5(spark, docs):
    _, rows = run(spark, "op5_language")
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        text = docs[r.doc_id].text
        assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        if r.held_out and r.lang_pred != "und" and docs[r.doc_id].lang:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) > 0.9


def plain_log_probabilities(net, window):
    """Convolutions one by one, without tables."""
    x, outs = net.p["bytes"][window], []
    for u in range(net.filters * len(language.WIDTHS)):
        wide = sorted(language.WIDTHS, reverse=True)[u // net.filters]
        outs.append(max(sum(x[i + k] @ net.p[f"at{k}"][:, u] for k in range(wide)) for i in range(len(window) - language.REACH)) + net.p["bias"][u])
    z = np.maximum(outs, 0) @ net.p["out"] + net.p["prior"]
    return z - np.log(np.exp(z).sum())


def test_forward_pass():
    net = language.ByteNet(["a", "b", "c"], filters=3, size=5)
    text = bytes(np.random.default_rng(4).integers(1, 255, 600, np.uint8))
    x = language.windows(text)
    want = np.array([plain_log_probabilities(net, w) for w in x])
    assert np.allclose(net.log_probabilities(x, net.tables()), want, atol=1e-4)
    weight = [min(256, len(text) - 253 * k) for k in range(len(x))]
    mean = np.average(want, axis=0, weights=weight)
    name, p = net.judge(text, net.tables(), at_once=2)
    assert name == net.languages[int(mean.argmax())] and abs(p - np.exp(mean).max() / np.exp(mean).sum()) < 1e-4


def nearest(sizes, rest):
    """How near a subset's sum can come, by all sums that there are."""
    sums = 1
    for n in sizes:
        sums |= sums << n
    return next(k for k in range(sum(sizes) + 1) if (sums >> (rest + k)) & 1 or (rest >= k and (sums >> (rest - k)) & 1))


def check_mix(docs, rows):
    sizes, taken = defaultdict(list), defaultdict(int)
    for d in docs:
        sizes[d.source].append(len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")))
    whole = {s: sum(x) for s, x in sizes.items()}
    targets = test_mixing.plain_targets(whole)
    for r, d in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        assert (r["size"], r.source_size) == (n, whole[d.source]) and r.target == pytest.approx(targets[d.source]) and r.taken in {0, n, 2 * n, 3 * n}
        taken[d.source] += r.taken
    for s, x in sizes.items():
        rest = round(targets[s] - targets[s] // whole[s] * whole[s])
        assert abs(taken[s] - targets[s]) <= nearest(x, rest) + 1


def test_op6(spark, docs):
    _, rows = run(spark, "op6_mixing")
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    check_mix(docs.values(), [(r, docs[r.doc_id]) for r in rows])
    assert sorted(rows) == sorted(run(spark, "op6_mixing")[1])


def test_op7(spark, docs):
    _, rows = run(spark, "op7_bpe")
    assert len(rows) == len(docs)
    for r in rows:
        want = np.array(test_bpe.LIBRARY.encode_ordinary(docs[r.doc_id].text or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id].text or "").encode()).hexdigest()


def test_op8(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in table(spark, "embeddings")]
    kinds, found = run(spark, "op8_vectors")
    assert kinds["n_links"] == kinds["component_id"] == "bigint" and kinds["kept"] == "boolean"
    assert sorted(tuple(r) for r in found) == sorted(test_tables.plain_links(rows))


def test_op9(spark, docs):
    _, rows = run(spark, "op9_pii")
    assert len(rows) == len(docs)
    for r in rows:
        base = test_pii.plain(docs[r.doc_id].text or "")
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert not Counter(written) - Counter(every) and every == sorted(every, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))


def test_op10(spark, docs):
    _, rows = run(spark, "op10_simhash")
    ids = sorted(docs)
    fps = [test_simhash.plain(docs[i].text) for i in ids]
    groups = test_simhash.classes(fps, lambda x, y: (x ^ y).bit_count() <= 3)
    assert sorted(tuple(r) for r in rows) == [(i, f"{fp:016x}", ids[g]) for i, fp, g in zip(ids, fps, groups, strict=True)]


def test_pipeline_stage_by_stage(spark, docs):
    """Each stage's rows from its own input, by plain means."""
    stage = dict(corpus_pipeline.STAGES)
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    net = language.fit(whole.where("lang IS NOT NULL"))
    known = stage["language ID"](spark, whole, SF)
    tables = net.tables()
    want = {i for i, d in docs.items() if any(c.isalpha() for c in d.text or "") and net.judge(d.text.encode(), tables)[1] >= 0.4}
    assert {r.doc_id for r in known.collect()} == want and known.columns == whole.columns

    apart = stage["SimHash near-dedup"](spark, known, SF)
    ids = sorted(want)
    first, other = ({i: test_simhash.plain(docs[i].text, corpus_pipeline.SHINGLE, seed) for i in ids} for seed in (42, 43))
    fps = [(first[i], other[i]) for i in ids]
    groups = test_simhash.classes(fps, lambda x, y: any(test_simhash.close(a, b, corpus_pipeline.RADIUS, corpus_pipeline.CONFIRM) for a, b in ((x, y), (x[::-1], y[::-1]))))
    kept = {ids[g] for g in groups}
    assert {r.doc_id for r in apart.collect()} == kept and apart.columns == whole.columns

    clean = {r.doc_id: r for r in stage["PII"](spark, apart, SF).collect()}
    assert set(clean) == kept
    for i, r in clean.items():
        bare = pii.masked(docs[i].text, test_pii.plain(docs[i].text))
        assert r.text == bare or len(pii.search([docs[i].text], pii.fit(apart))[0][1]) > len(test_pii.plain(docs[i].text))
        assert r.n_chars == len(r.text)

    table = spark.createDataFrame(list(clean.values()), whole.schema)
    mix = stage["mixing sources"](spark, table, SF)
    times = Counter(r.doc_id for r in mix.collect())
    rows = [(r, clean[r.doc_id]) for r in mixing.mix(table).collect()]
    check_mix(clean.values(), rows)
    assert times == Counter({r.doc_id: r.taken // r["size"] for r, _ in rows if r.taken})

    tokens = stage["BPE"](spark, mix, SF).collect()
    assert Counter(r.doc_id for r in tokens) == times
    for r in tokens:
        assert list(r.ids) == test_bpe.LIBRARY.encode_ordinary(clean[r.doc_id].text) and r.n_tokens == len(r.ids)
