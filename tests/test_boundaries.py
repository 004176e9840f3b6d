import random

from pyspark.sql import functions as F

from gradus.operators import boundaries


def test_learns_abbreviations_and_counts_sentences(spark):
    """Marked text: every sentence is written with a known number of marks that end none."""
    rng = random.Random(1)
    nouns = ["river", "house", "report", "city", "market", "garden", "winter", "story"]
    rows = []
    for i in range(300):
        text = []
        for _ in range(n := rng.randint(1, 8)):
            words = [rng.choice(nouns) for _ in range(rng.randint(4, 9))]
            words[rng.randrange(1, len(words))] = rng.choice(["Dr. Miller", "e.g. sand", "approx. ten", "3.5 litres", rng.choice(nouns)])
            text.append(rng.choice(["The", "It", "They"]) + " " + " ".join(words) + rng.choice([".", ".", "?", '!"']))
        rows.append((i, " ".join(text), n))
    rows += [(1000, "", 0), (1001, None, 0), (1002, " \n ", 0), (1003, "no mark", 1), (1004, "One. Two", 2)]
    docs = spark.createDataFrame(rows, "id long, text string, want int")
    pairs = boundaries.neighbours(docs, "id", "text")
    scores = {r.word: r for r in boundaries.abbreviations(pairs).collect()}
    short = {w for w, r in scores.items() if r.score >= boundaries.ABBREVIATION}
    assert {"dr", "e.g"} <= short and not short & set(nouns)
    begin = {r.word for r in boundaries.starters(pairs, boundaries.abbreviations(pairs)).where("more").collect() if r.ratio >= boundaries.STARTER}
    assert {"the", "it", "they"} <= begin and not begin & set(nouns)
    found = {r.id: r.n for r in boundaries.sentence_counts(docs, "id", "text").collect()}
    wrong = [i for i, _, want in rows if abs(found[i] - want) and i < 1000]
    assert len(wrong) < 100 and all(found[i] == want for i, _, want in rows if i >= 1000)
    # what the rule of cutting at every full stop gets wrong, the learned one mostly gets right
    plain = docs.select("id", F.regexp_count("text", F.lit(r"[.?!]+[\"]?(\s|$)")).alias("n")).collect()
    assert len(wrong) < sum(r.n != next(w for i, _, w in rows if i == r.id) for r in plain if r.id < 1000) / 2


def test_tokens_at_line_ends_of_other_kinds(spark):
    """U+2028 is no blank: what stands before it does not end a token."""
    docs = spark.createDataFrame([(1, '"*One,  (two). -- ,;: *_* x.\u0085 “yes!”')], "id long, text string")
    found = [(r.token, r.next) for r in boundaries.neighbours(docs, "id", "text").collect()]
    tokens = ["One, ", "two).", "--", "x.\u0085", "yes!"]
    assert found == list(zip(tokens, [*tokens[1:], None]))
    assert [r.w for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(boundaries.word(F.col("t")).alias("w")).collect()] == ["one, ", "two)", "--", "x.\u0085", "yes!"]


def test_texts_are_cut_once_for_words_and_once_for_breaks(spark):
    docs = spark.createDataFrame([(1, "One. Two three. Four")], "id long, text string")
    pairs = boundaries.neighbours(docs, "id", "text")
    plan = boundaries.abbreviations(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "count(1) AS times" in plan
    # nothing is asked of words before tokens are counted
    below = plan.lower().split("count(1) as times")[1].split("\n", 1)[1].split("aggregate")[0]
    assert "generate" in below and "rlike" not in below and "regexp_replace" not in below
