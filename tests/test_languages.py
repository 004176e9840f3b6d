from pyspark.sql import functions as F

from gradus.operators import languages

TEXTS = [
    (1, "en", "The quick brown fox jumps over the lazy dog, and then it runs through the woods with the others."),
    (2, "de", "Der schnelle braune Fuchs springt über den faulen Hund, und dann läuft er mit den anderen durch die Wälder."),
    (3, "fr", "Le renard brun et rapide saute par-dessus le chien paresseux, puis il court à travers les bois avec les autres."),
]


def test_nearest(spark):
    known = languages.profiles(spark.createDataFrame(TEXTS, "id int, lang string, text string"), "lang", "text")
    rows = [(10, "the dog and the fox went through there"), (11, "der hund und der andere fuchs über den wäldern"), (12, "LES CHIENS ET LES AUTRES"), (13, ""), (14, None), (15, "123 !?"), (16, "x" * 200000), (None, "the others"), (17, "漢字")]
    docs = spark.createDataFrame(rows, "id int, text string")
    found = {r.id: r for r in languages.nearest(docs, "id", "text", known, "lang").collect()}
    assert [found[i].language for i in (10, 11, 12, 13, 14, 15, 17)] == ["en", "de", "fr", None, None, None, None] and len(found) == len(rows)
    assert found[10].distance > 0 and found[13].distance is None


def test_profile_by_hand(spark):
    docs = spark.createDataFrame([("x", "ab ab b")], "lang string, text string")
    rows = {r.gram: r.rank for r in languages.profiles(docs, "lang", "text").collect()}
    # b: 3, b_: 3, _a _ab a ab ab_: 2, _b _b_: 1
    assert [g for g, _ in sorted(rows.items(), key=lambda x: x[1])] == ["b", "b_", "_a", "_ab", "a", "ab", "ab_", "_b", "_b_"]


def test_groups_of_letters(spark):
    df = spark.createDataFrame([("a",), ("añ",), ("𝒳y",)], "w string").select("w", languages.groups(F.col("w")).alias("g"))
    found = {r.w: r.g for r in df.collect()}
    assert found == {"a": ["a", "_a", "a_", "_a_"], "añ": ["a", "ñ", "_a", "añ", "ñ_", "_añ", "añ_"], "𝒳y": ["𝒳", "y", "_𝒳", "𝒳y", "y_", "_𝒳y", "𝒳y_"]}


def test_texts_move_once(spark):
    """Texts are dealt out by key, and neither their words nor their groups move again; the profiles come by a broadcast."""
    docs, known = spark.createDataFrame([(1, "a b")], "id int, text string"), spark.createDataFrame([("x", "a", 1)], "lang string, gram string, rank int")
    found = languages.nearest(docs, "id", "text", known, "lang")
    plan = found._jdf.queryExecution().executedPlan().toString().split("LeftOuter", 1)[1]
    assert found.count() == 1 and "hashpartitioning(id#" in plan and not any(f", {g}#" in line for line in plan.split("\n") if "Exchange hash" in line for g in ("word", "gram"))
    assert "hashpartitioning(gram" not in plan
