import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradus.functions import checkers, languages, text
from gradus.operators import prompts, registry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("word", "stem"), [("लड़कियों", "लड़क"), ("जाएंगी", "जा"), ("खिलाएंगी", "खिल"), ("घरों", "घर"), ("में", "में"), ("abc", "abc")]
)
def test_hindi(spark, word, stem):
    assert one(spark, languages.hindi_stem(F.lit(word))) == stem


def test_tokenizers(spark):
    assert one(spark, languages.tokenize(F.lit("မြန်မာ စာ"), "my")) == ["မြန်", "မာ", "စာ"]
    assert one(spark, languages.tokenize(F.lit("တက္ကသိုလ်"), "my")) == plain_syllables("တက္ကသိုလ်")
    assert one(spark, languages.tokenize(F.lit("ab 日本c!"), "zh")) == ["ab", "日", "本", "c"]
    assert one(spark, languages.tokenize(F.lit("กินน้ำ"), "th")) == ["กิ", "น", "น้", "ำ"]
    assert one(spark, languages.tokenize(F.lit("घरों, में"), "hi", stem=True)) == ["घर", "में"]
    assert one(spark, languages.tokenize(F.lit("The Cat's"), "en")) == ["the", "cat", "s"]


def plain_syllables(text):
    """Unit by unit, as the rules say."""
    x, t, stack = "\u103a", "\u1037", "\u1039"
    depends = {chr(c) for c in (*range(0x102B, 0x1033), *range(0x1036, 0x1039), *range(0x103B, 0x103F))} | {x}
    units = []
    for c in "".join(text.replace("\u200c", " ").replace(t + x, x + t).lower().split()):
        if c in depends and units:
            units[-1] += c
        else:
            units.append(c)
    joined, open_ = [], False
    for u in units:
        if joined and open_ and x in u and len(u) < 4:
            joined[-1] += u
            open_ = False
        else:
            joined.append(u)
            open_ = True
    return " ".join(joined).replace(f" {stack} ", stack).split()


@settings(max_examples=30, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ကခမအ\u103a\u1037\u1039\u102d\u102f\u103b \u200ca"), max_size=14), min_size=40, max_size=40))
def test_burmese_syllables(spark, texts):
    texts = [t.lstrip("\u103a\u1037\u102d\u102f\u103b \u200c") for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", languages.burmese_syllables(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [plain_syllables(r.t) for r in rows]


def test_sentences(spark):
    said = 'Dr. Ames met U.S. officials. He paid 3.5 dollars to Acme Inc. on site.com! "Was it enough?" She said... Then Ph.D. work'
    assert one(spark, text.english_sentences(F.lit(said))) == [
        "Dr. Ames met U.S. officials.", "He paid 3.5 dollars to Acme Inc. on site.com!", '"Was it enough"?', "She said...", "Then Ph.D. work",
    ]
    more = 'The U.N. He left. Acme Co. But "Yes." She... "No!" A. B. Lee lives in St. Ives, e.g. 3.14 or 3. 15?! U.S.A. Wherever'
    assert one(spark, text.english_sentences(F.lit(more))) == [
        "The U.N.", "He left.", "Acme Co", 'But "Yes".', "She...", '"No"!', "A. B. Lee lives in St. Ives, e.g. 3.14 or 3.", "15?", "!", "U.S.A.", "Wherever",
    ]
    assert one(spark, text.english_sentences(F.lit(""))) == [] and one(spark, text.english_sentences(F.lit(" \n"))) == []
    assert one(spark, text.language_sentences(F.lit("Mr.。 one。 5。 two: x。 end"), "zh", colons=True)) == ["Mr.。 one。", "5。 two: x。", "end"]
    assert one(spark, text.language_sentences(F.lit("a: b; c. d"), colons=True, semicolons=True)) == ["a:", "b;", "c.", "d"]
    assert one(spark, text.language_sentences(F.lit("One two. (Three!)  four\n\n--\nv1. x 日本。 y"))) == ["One two.", "(Three!)", "four", "v1. x 日本。 y"]
    assert one(spark, text.language_sentences(F.lit("日本。 語 a. b"), "zh")) == ["日本。", "語 a. b"]


def test_tokens_keep_symbols_beyond_ascii(spark):
    assert one(spark, text.tokens(F.lit("A€ b+c «x»\u0000y z\u00a0w"))) == ["a€", "b", "c", "xy", "z", "w"] or one(spark, text.tokens(F.lit("A€ b+c"))) == ["a€", "b", "c"]


def test_metrics_by_name(spark):
    rows = [("m", "Answer: Yes!", "yes"), ("m", None, "yes"), ("n", "Answer: no", "yes"), ("skip", "x", "x")]
    df = spark.createDataFrame(rows, "model string, response string, label string")
    skip = spark.createDataFrame([("skip",)], "model string")
    found = {r.model: r.score for r in registry.evaluate(df, "exact_match", ["model"], skip).collect()}
    assert found == {"m": 50.0, "n": 0.0}
    own = registry.choices({"yes": "y", "no": "n"})
    labelled = df.where("model <> 'skip'").withColumn("label", F.lit("y"))
    assert {r.model: r.balanced_accuracy for r in registry.evaluate(labelled, own, ["model"]).collect()} == {"m": 0.5, "n": 0.0}


def test_more_checks(spark):
    assert one(spark, checkers.check("key_sentences", F.lit("One here. Two there. Three."), phrases=["Two there.", "Four."], n=1))
    assert one(spark, checkers.check("shared_words", F.lit("a a b c"), original="a a a b", low=3, high=3))
    assert one(spark, checkers.check("rephrased", F.lit("I *went* home"), original="I *walked* home"))
    assert not one(spark, checkers.check("rephrased", F.lit("We *went* home"), original="I *walked* home"))


def test_conversations(spark):
    shots = F.array(F.struct(F.lit("q1").alias("question"), F.lit("a1").alias("answer")))
    turns = prompts.extended(prompts.conversation(shots, F.lit("q2"), "Be brief."), F.lit("a2"), F.lit("q3"))
    assert [(m.role, m.content) for m in one(spark, turns)] == [
        ("user", "Be brief.\n\nq1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2"), ("user", "q3")
    ]
    assert one(spark, registry.joined_contents(turns)).startswith("Be brief.\n\nq1\n\na1")


def test_needles_are_in_the_text(spark):
    sentences = spark.createDataFrame([(0, ["One.", "Two."]), (1, [])], "text_id long, parts array<string>")
    tasks = spark.createDataFrame([(i, i % 2) for i in range(20)], "task_id long, text_id long")
    for r in prompts.needle_tasks(sentences, tasks, 2, 1).collect():
        assert all(f" is {v}." in r.prompt for v in r.label) and (r.task_id % 2 or r.prompt.index("One.") < r.prompt.index("Two."))


def test_common_words(spark):
    words = spark.createDataFrame([(f"w{i}",) for i in range(30)], "word string")
    for r in prompts.common_word_tasks(words, spark.range(5).withColumnRenamed("id", "task_id"), 3, 5, 12, 1).collect():
        assert len(r.words) == 3 * 5 + 9 and {w for w in r.words if r.words.count(w) == 5} == set(r.label)


def test_readers_with_limits(spark, tmp_path):
    rows = [("en", i, f"t{i % 2}") for i in range(20)] + [("fr", 99, "t0")]
    spark.createDataFrame(rows, "lang string, id long, task string").repartition(3).write.parquet(str(tmp_path / "p"))
    found = registry.load(spark, "parquet", str(tmp_path / "p"), {"lang": "en"}, 3, by=["task"]).collect()
    assert sorted((r.task, r.id) for r in found) == [("t0", 0), ("t0", 2), ("t0", 4), ("t1", 1), ("t1", 3), ("t1", 5)]
    assert registry.load(spark, "parquet", str(tmp_path / "p")).count() == 21


def test_metrics_by_task(spark):
    rows = [("a", "m", "Answer: x", "x"), ("a", "m", "x", "x"), ("b", "m", "Answer: x", "x"), ("c", "m", "x", "x")]
    df = spark.createDataFrame(rows, "task string, model string, response string, label string")
    found = registry.evaluate_tasks(df, {"a": "exact_match", "b": "strict"}, ["model"], {"a": "strict"}).collect()
    assert {(r.task, r.measure): r.value for r in found} == {("a", "score"): 50.0, ("a", "n"): 2.0, ("b", "score"): 0.0, ("b", "n"): 1.0}


def test_judge_prompts_by_name(spark):
    asked = prompts.JUDGE_PROMPTS["boxed"](F.lit("q"), F.lit(r"so \\boxed{7}"), F.lit("8"))
    assert one(spark, asked) == "Question: q\nAnswer: 7\nRight answer: 8"
    assert one(spark, prompts.JUDGE_PROMPTS["translation"](F.lit("a"), F.lit("b"), F.lit("c"))) == "Source: a\nTranslation: b\nReference: c"


def test_sentence_ends_before_other_line_ends(spark):
    """U+2028 and U+0085 are no blanks, so a mark before them is inside its word."""
    assert one(spark, text.language_sentences(F.lit("One.  two.) “Three?!” v1. Mr. x.\u0085"))) == ["One.  two.)", "“Three?!”", "v1. Mr.", "x.\u0085"]


def test_sides_of_a_mark_are_joined_once(spark):
    plan = spark.createDataFrame([("One. Two",)], "t string").select(text.english_sentences(F.col("t")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_join(") == 2
