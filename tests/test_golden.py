"""Hand-derived cases."""

import math
from random import Random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradus.functions import checkers, text
from gradus.operators import answers, classify, generate, judge, keyed, logprob, rating, rollup


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(value):
    return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def test_macro_f1_with_null_class(frame):
    df = frame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "null")], "label string, pred string")
    assert classify.macro_f1(df, []).first().macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 0 + 0) / 4)
    assert classify.balanced_accuracy(df, []).first().balanced_accuracy == pytest.approx(0.5)
    assert classify.null_weighted_f1(df.withColumn("g", F.lit(1)), ["g"]).first().null_weighted_f1 == pytest.approx(4 / 9 * 0.75)


def test_chance_normalisation(spark):
    assert one(spark, 100 * text.norm(F.lit(0.5), 0.25, 1.0)) == pytest.approx(100 / 3)
    assert one(spark, text.norm(F.lit(0.2), 0.25, 1.0)) == 0
    assert one(spark, text.norm(F.lit(0.2), 1.0, 1.0)) == 0
    assert one(spark, text.norm(F.lit(3.0), 0.0, 1.0)) == 3


def test_pairwise(spark):
    cases = [("WIN", "LOSE", "TIE", "ERROR"), ("ERROR", "WIN", "TIE", "ERROR"), ("WIN", "WIN", "WIN", "WIN")]
    for a, b, ties, strict in cases:
        assert one(spark, judge.combined(F.lit(a), F.lit(b))) == ties
        assert one(spark, judge.combined(F.lit(a), F.lit(b), ties=False)) == strict
    for t, v, swapped in [("x [[A]]", "WIN", "LOSE"), ("[[B]]", "LOSE", "WIN"), ("[[C]]", "TIE", "TIE"), ("[[A]][[B]]", "ERROR", "ERROR"), (None, "ERROR", "ERROR")]:
        text_ = F.lit(t).cast("string")
        assert (one(spark, judge.verdict(text_)), one(spark, judge.verdict(text_, F.lit(True)))) == (v, swapped)


def test_rubric_and_severity(frame):
    df = frame([(5, True), (3, False), (-2, True)], "points int, met boolean")
    assert judge.rubric_score(df, [], "met", "points").first().score == pytest.approx(3 / 8)
    df = frame([("high", 1.0), ("low", 0.0), ("generic", 1.0)], "severity string, w double")
    r = judge.severity_score(df, [], "severity", "w").first()
    assert (r.criteria, r.generic, r.overall) == pytest.approx((10 / 11, 1, 10 / 11))


def test_overlaps(frame, spark):
    pred, keys = frame([(1, "a b a"), (2, None), (3, "x")], "item_id int, pred string"), frame([(1, 0, 7), (2, 0, 7), (3, 0, 8)], "item_id int, ref_ix int, ref_id int")
    refs = frame([(7, "a a c"), (8, "")], "ref_id int, ref string")
    counts = {r.item_id: (r.common, r.n_pred, r.n_ref) for r in generate.overlap(pred, keys, refs, text.tokens).collect()}
    assert counts[1] == (2, 3, 3) and counts[2][0] == 0 and counts[3] == (0, 1, 0)
    assert {r.item_id: r.f1 for r in generate.overlap_scores(generate.overlap(pred, keys, refs, text.tokens)).collect()} == {1: pytest.approx(2 / 3), 2: 0, 3: 0}
    assert [r.common for r in generate.overlap(pred, keys, refs, text.tokens, 2).orderBy("item_id").collect()] == [0, 0, 0]
    pairs = frame([(1, 0, "b x d", "a b c d")], "item_id int, ref_ix int, pred string, ref string")
    r = generate.rouge_l(pairs).first()
    assert (r.precision, r.recall, r.f1) == pytest.approx((2 / 3, 1 / 2, 4 / 7))
    recall = keyed.set_recall(text.list_items(F.lit("A, b")), lit(["a", "c"]))
    assert one(spark, recall) == 0.5
    assert one(spark, F.to_json(text.ngrams(lit(list("abcd")), 3))) == '["a b c","b c d"]'
    assert one(spark, F.to_json(text.ngrams(lit(list("ab")), 3))) == "[]"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert generate.lcs_length(a, b) == table[-1][-1] == len(generate._on_lcs(a, b))


def test_contest_index(spark):
    rows = spark.range(3).select(*[c.alias(n) for n, c in rating.decoded(F.col("id"), 1, 1, F.lit(3)).items()]).collect()
    assert [(r.model_a, r.model_b) for r in rows] == [(1, 0), (2, 0), (2, 1)]


def test_outcome(spark):
    nan = float("nan")
    for x, y, want in [(1.0, 1.00005, 0.5), (1.0, 1.1, 0.0), (2.0, 1.0, 1.0), (-1.0, -1.0, 0.5), (nan, 1.0, 0.0), (nan, nan, 0.0)]:
        assert one(spark, rating.outcome(F.lit(x), F.lit(y))) == want


def test_means_of_means(frame):
    rows = [("m", "X", "a", 0.0), ("m", "X", "b", 0.0), ("m", "X", "c", 3.0), ("m", "Y", "d", 5.0)]
    df = frame(rows, "model string, competency string, task string, score double")
    assert rollup.mean_of_means(df, ["model", "competency", "task"], "score")["model"].first().score == 3.0


def test_logprob(frame):
    r = logprob.summary(frame([(math.log(0.5),), (None,)], "logprob double"), []).first()
    assert (r.mean_probability, r.null_count, r.mean_logprob) == (pytest.approx(25), 1, 0)


def test_loose_check(spark):
    response = F.lit("Sure, here:\nbody text")
    assert not one(spark, checkers.check("no_comma", response))
    assert one(spark, checkers.loose("no_comma", response))
    assert not one(spark, checkers.loose("no_comma", F.lit("  ")))


@pytest.mark.parametrize(
    ("name", "response", "arguments", "want"),
    [
        ("words", "aéb ไทย two", {"n": 3, "relation": "exactly"}, True),
        ("highlights", "*a* and **b**", {"n": 2}, True),
        ("highlights", "** ** and * *", {"n": 1}, False),
        ("json_value", '{"a": 1,}', {}, False),
        ("json_value", "```json\n[1]\n```", {}, True),
        ("title", "<<>>", {}, False),
        ("in_quotes", '""', {}, False),
        ("two_responses", "a******a", {}, True),
        ("two_responses", "a******!?", {}, False),
        ("postscript", "so\nmore P. S. this", {}, True),
        ("postscript", "p.p.s. x", {"marker": "P.P.S."}, True),
        ("postscript", "PS x", {}, False),
        ("sections", "Subsection 1", {"title": "section", "n": 0}, True),
        ("has_words", "a thé b", {"keywords": ["th"]}, False),
        ("has_words", "ฉันไปบ้าน", {"keywords": ["ไป"], "language": "th"}, True),
        ("one_of", "Jawabanku ora.", {"language": "jv"}, True),
        ("json_value", "[] and more", {}, False),
        ("json_value", '1, "b": 2', {}, False),
        ("two_responses", "a******b", {}, True),
        ("two_responses", "a******b******c", {}, False),
        ("repeats", "Say hi", {"prompt": "say hi"}, False),
        ("capital_words", "AB C DE", {"n": 2, "relation": "exactly"}, True),
        ("in_script", "สวัสดี", {"language": "th"}, True),
        ("in_script", "hello", {"language": "th"}, False),
        ("starred_parts", "a***b*** ", {"n": 2}, True),
        ("sections", "Section 1\nSection 2", {"title": "Section", "n": 2}, True),
        ("letter_frequency", "EeE", {"letter": "e", "n": 3}, True),
    ],
)
def test_checkers(spark, name, response, arguments, want):
    assert one(spark, checkers.check(name, F.lit(response), **arguments)) is want


@pytest.mark.parametrize(
    ("call", "want"),
    [
        (lambda: text.extract_choice(F.lit("x\nANSWER: **B**"), {"A": "yes", "B": "no"}), "no"),
        (lambda: text.extract_choice(F.lit("Answer: z"), {"a.": "yes"}), "null"),
        (lambda: text.extract_answer(F.lit("Answer: `x y`\nmore")), "x y`"),
        (lambda: text.boxed(F.lit(r"\boxed{1} then \boxed{\frac{1}{2}}")), r"\frac{1}{2}"),
        (lambda: text.fenced_code(F.lit("```py\na\n```\n```\nb\n```")), "b\n"),
        (lambda: text.tagged(F.lit("<a>1</a>2</a>"), "a"), "1</a>2"),
        (lambda: text.flat_json(F.lit('{"a":{"b":1}} {"c":2}')), '{"c":2}'),
        (lambda: text.without_reasoning(F.lit("hm</think>yes")), "yes"),
        (lambda: text.normalize_answer(F.lit("The  Cat's, meow!")), "the cats meow"),
        (lambda: text.normalize_cell(F.lit("The big  Cat")), "bigcat"),
        (lambda: F.date_format(text.file_timestamp(F.lit("x_2024-05-06T07:08:09.123456.yaml")), "HH:mm:ss.SSSSSS"), "07:08:09.123456"),
        (lambda: judge.classification(F.lit("<classification>a</classification> <classification>b</classification>"), last=True), "b"),
        (lambda: keyed.filled_template("{a}-{b}{a}", {"a": F.lit("{b}"), "b": F.lit(1)}), "{b}-1{b}"),
        (lambda: keyed.options(lit(["x ", "y"])), "A. x\nB. y"),
        (lambda: F.to_json(keyed.with_answer_at(lit(["x", "y"]), F.lit("z"), F.lit(2))), '["x","y","z"]'),
        (lambda: text.spaced_ideographs(F.lit("a日b")), "a 日 b"),
        (lambda: F.to_json(text.dashed_lines(F.lit("- The Cat\nno\n- x."))), '["cat","x"]'),
        (lambda: text.arguments(F.lit("a=1,b=x"))["b"]["value"], "x"),
        (lambda: text.arguments(F.lit("a=1,b=x, y,c='q'"))["b"]["value"], "x, y"),
        (lambda: text.arguments(F.lit("a=-1.5e3"))["a"]["kind"], "float"),
        (lambda: text.normalize_belief(F.lit("The cat is in  the box’s step, then")), "cat boxs then"),
        (lambda: text.reflection(F.lit("<reflection> a\nb </reflection>")), "a\nb"),
        (lambda: text.with_answer_pattern(F.lit("Answer: 12 x"), "Answer: ", "([0-9]+)"), "12"),
        (lambda: text.with_answer_pattern(F.lit(" none "), "Answer: ", "([0-9]+)"), "none"),
    ],
)
def test_text(spark, call, want):
    assert one(spark, call()) == want


def test_countdown():
    assert answers.countdown_ok(["3 + 4 = 7", "7 * 5 = 35"], [3, 4, 5], 35)
    assert not answers.countdown_ok(["3 + 4 = 7", "3 * 5 = 15"], [3, 4, 5], 15)
    assert not answers.countdown_ok(["7 / 2 = 3"], [7, 2], 3)
    assert not answers.countdown_ok(["__import__('os')"], [1], 1)


@pytest.mark.parametrize(
    ("line", "want"), [("3 + 4 = 7", True), ("3*4=13", False), ("7 / 2 = 3", False), ("8 / 2 = 4", True), ("8 / 0 = 0", False), ("no", None), ("-3 - 4 = -7", True)]
)
def test_countdown_line(spark, line, want):
    assert one(spark, keyed.countdown_line(F.lit(line))) is want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("0.5", r"$\frac{1}{2}$", True), ("1,000", "1000", True), ("x=2, 3", "3,2", True), ("2", "3", False), (r"\sqrt{2}", r"$\sqrt{2}$", True), (None, "1", False), ("", "", False), ("1/0", "1", False)],
)
def test_math(a, b, want):
    assert answers.same_answer(a, b) is want


def test_travel(frame):
    df = frame([("Visit Rome for 2 days. Then stay in Oslo for 3 days.", "Rome**Oslo", "2**3"), ("Visit Oslo for 2 days", "Rome**Oslo", "2**3")], "t string, c string, d string")
    assert [r.s for r in df.select(answers.travel_score("t", "c", "d").alias("s")).collect()] == [1.0, 0.0]


def test_ratings(frame):
    rng = Random(0)
    strength = {0: 0.0, 1: 100.0, 2: 250.0}
    rows = []
    for i in range(20_000):
        a, b = rng.sample(list(strength), 2)
        rows.append((i, a, b, float(rng.random() < 1 / (1 + 10 ** ((strength[b] - strength[a]) / 400)))))
    df = frame(rows, "n int, model_a int, model_b int, outcome double").withColumn("g", F.lit(1))
    found = {r.model: r.rating for r in rating.bradley_terry(df, []).collect()}
    assert found[1] - found[0] == pytest.approx(100, abs=20) and found[2] - found[0] == pytest.approx(250, abs=20)
    assert sum(found.values()) / 3 == pytest.approx(1000)
    walk = {r.model: r.rating for r in rating.elo(df, ["g"], "n").collect()}
    assert walk[0] < walk[1] < walk[2] and sum(walk.values()) == pytest.approx(3000)


def test_t_distribution():
    for t, n, p in [(2.228138852, 10, 0.05), (12.70620474, 1, 0.05), (0.0, 5, 1.0), (2.575829303, 1e7, 0.01)]:
        assert rating.t_two_sided(t, n) == pytest.approx(p, rel=1e-4)


def test_table_rows_count_as_often_as_they_occur(frame):
    p = frame([(1, "The Cat"), (1, "cat!"), (1, "dog")], "t int, x string")
    r = keyed.table_scores(p, frame([(1, "cat"), (1, "cow")], "t int, x string"), "t", ["x"]).first()
    assert (r.precision, r.recall) == pytest.approx((2 / 3, 1 / 2))


def test_keep_last(frame):
    df = frame([(1, 1, "a"), (1, 2, "b"), (2, 1, None), (None, 5, "c")], "k int, n int, v string")
    assert {(r.k, r.v) for r in keyed.keep_last(df, ["k"], ["n"]).collect()} == {(1, "b"), (2, None), (None, "c")}


@pytest.mark.parametrize(
    ("name", "response", "arguments", "want"),
    [
        ("two_responses", "a******a", {}, False),
        ("two_responses", "******a****** b ******", {}, True),
        ("two_responses", "a****** ******b", {}, False),
        ("paragraphs", "*** a *** b ***", {"n": 2}, True),
        ("paragraphs", "a *** *** b", {"n": 2}, False),
        ("placeholders", "[] [x]", {"n": 2}, True),
        ("bullets", "*one\n- two\n**bold**\n-three", {"n": 3}, True),
        ("sections", "Section1 text Section 2", {"title": "Section", "n": 2}, True),
        ("repeats", "the prompt", {"prompt": "The prompt"}, True),
    ],
)
def test_english_checks(spark, name, response, arguments, want):
    assert one(spark, checkers.check(name, F.lit(response), checkers.ENGLISH, **arguments)) is want


@settings(max_examples=150, deadline=None)
@given(*(st.lists(st.lists(st.sampled_from("abc"), max_size=7), max_size=4) for _ in range(2)))
def test_union_of_subsequences(refs, preds):
    """Tokens on some longest common subsequence, none more often than either side has it, by the full table."""

    def on(a, b):
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        i, j, found = len(a), len(b), set()
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                found.add(i)
            elif size[i - 1][j] >= size[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return found

    left = [{x: sum(s.count(x) for s in side) for x in "abc"} for side in (refs, preds)]
    total = 0
    for r in refs:
        for i in sorted(set().union(*(on(r, p) for p in preds))):
            if left[0][r[i]] > 0 and left[1][r[i]] > 0:
                total += 1
                left[0][r[i]] -= 1
                left[1][r[i]] -= 1
    assert generate.union_lcs(refs, preds) == total


def test_numbers_of_hot_groups(frame):
    from gradus.operators.numbering import numbered

    rows = [("hot", i * 3) for i in range(500)] + [("a", 7), (None, 5), (None, 1)]
    found = {(r.g, r.k): r.place for r in numbered(frame(rows, "g string, k long").repartition(5), ["g"], "k", parts=7).collect()}
    assert found == {**{("hot", 3 * i): i for i in range(500)}, ("a", 7): 0, (None, 1): 0, (None, 5): 1}
    assert numbered(frame([], "g string, k long"), ["g"], "k").count() == 0


def test_texts_meet_their_references_whole(frame):
    """No token moves by itself, and every way of comparing takes the same tables."""
    tables = frame([(1, "a b c a\nd"), (2, None), (3, "")], "item_id int, pred string"), frame([(i, k, 7 + k) for i in (1, 2, 3) for k in (0, 1)], "item_id int, ref_ix int, ref_id int"), frame([(7, "a a d"), (8, "d\na x a")], "ref_id int, ref string")
    for made, common in ((generate.overlap(*tables, text.tokens), (3, 3)), (generate.compared(*tables, text.tokens, generate.lcs_of_each), (3, 2))):
        assert "token#" not in made._jdf.queryExecution().executedPlan().toString()
        found = {(r.item_id, r.ref_ix): (r.common, r.n_pred, r.n_ref) for r in made.collect()}
        assert [found[1, 0], found[1, 1]] == [(common[0], 5, 3), (common[1], 5, 4)] and {found[i, k][:2] for i in (2, 3) for k in (0, 1)} == {(0, 0)}
    recalls = {(r.item_id, r.ref_ix): r.recall for r in generate.rouge_lsum(*tables).collect()}
    assert recalls[1, 0] == pytest.approx(1) and recalls[1, 1] == pytest.approx(3 / 4) and recalls[2, 0] == 0
