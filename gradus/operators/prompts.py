"""Judges' prompts, few-shot conversations and generated long-context tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.draws import RANGE, below, draw, permuted
from gradus.functions.text import boxed, let
from gradus.operators.numbering import placed

MESSAGE = "struct<role:string,content:string>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def conversation(examples: Column, question: Column, preamble: str = "") -> Column:
    """Few-shot pairs (question, answer) as turns, then the question; a preamble comes before the first turn's text."""
    shots = F.flatten(F.transform(examples, lambda e: F.array(message("user", e["question"]), message("assistant", e["answer"]))))
    turns = F.concat(shots, F.array(message("user", question)))
    if not preamble:
        return turns
    return F.transform(turns, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(F.lit(f"{preamble}\n\n"), m["content"])).otherwise(m["content"]).alias("content")))


def extended(turns: Column, response: Column, question: Column) -> Column:
    """The conversation with a response and the next question."""
    return F.concat(turns, F.array(message("assistant", response), message("user", question)))


def per_criterion(df: DataFrame, criteria: str, text: str) -> DataFrame:
    """One row per criterion with its number and a judge's prompt."""
    rows = df.select("*", F.posexplode(criteria).alias("criterion_ix", "criterion"))
    return rows.withColumn("prompt", F.concat(F.lit("Criterion: "), F.col("criterion"), F.lit("\n\nResponse: "), F.col(text)))


def both_orders(df: DataFrame, turns: str, a: str, b: str) -> DataFrame:
    """A judge's prompt for each turn and order; a turn shows all answers so far. ``turns``, ``a`` and ``b`` are arrays of equal length."""
    orders = F.explode(F.array(F.lit("baseline-before"), F.lit("baseline-after"))).alias("order")
    rows = df.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.size(turns))).alias("turn"))
    first, second = (F.when(F.col("order") == "baseline-before", x).otherwise(y) for x, y in ((F.col(b), F.col(a)), (F.col(a), F.col(b))))
    lines = lambda answers: F.array_join(F.transform(F.slice(F.arrays_zip(F.col(turns).alias("q"), answers.alias("r")), 1, F.col("turn")), lambda x: F.concat(F.lit("Q: "), x["q"], F.lit("\nA: "), x["r"])), "\n")
    return rows.withColumn("prompt", F.concat(F.lit("[A]\n"), lines(first), F.lit("\n[B]\n"), lines(second)))


def needle_tasks(sentences: DataFrame, tasks: DataFrame, needles: int, seed: int) -> DataFrame:
    """(task_id, prompt, label): a text's sentences with ``needles`` sentences about drawn keys put before drawn places.

    ``tasks`` has (task_id, text_id), ``sentences`` (text_id, parts), an array.
    """
    number = lambda k: (draw(seed, "task_id", k, F.lit("value")) % (1 << 31)).cast("string")
    key = lambda k: F.concat(F.lit("key-"), draw(seed, "task_id", k, F.lit("key")).cast("string"))
    rows = tasks.join(sentences, "text_id").withColumn("needles", F.transform(F.sequence(F.lit(1), F.lit(needles)), lambda k: F.struct(below(F.size("parts") + 1, seed, "task_id", k, F.lit("at")).alias("at"), k.alias("k"), key(k).alias("key"), number(k).alias("value"))))
    put = F.transform("needles", lambda n: F.struct(n["at"].alias("at"), F.lit(0).alias("own"), n["k"].alias("k"), F.concat(F.lit("The number of "), n["key"], F.lit(" is "), n["value"], F.lit(".")).alias("text")))
    own = F.transform("parts", lambda p, i: F.struct(i.cast("long").alias("at"), F.lit(1).alias("own"), i.alias("k"), p.alias("text")))
    text = let(F.array_sort(F.concat(put, own)), lambda all_: F.array_join(F.transform(all_, lambda x: x["text"]), " "))
    return rows.select("task_id", text.alias("prompt"), F.transform("needles", lambda n: n["value"]).alias("label"))


def common_word_tasks(words: DataFrame, tasks: DataFrame, common: int, often: int, total: int, seed: int) -> DataFrame:
    """(task_id, words, label): ``total`` drawn words of which the first ``common`` occur ``often`` times, in drawn order.

    ``words`` has (word), the vocabulary, each once; ``tasks`` has (task_id), a stated
    list of tasks. The vocabulary is numbered once, in parts; a task's k-th word is the
    place of k under a permutation of its own, so that as many rows are made as words
    are drawn. Smaller vocabularies are taken whole.
    """
    hashed = words.select("word", draw(seed, "word").alias("_d"))
    known = placed(hashed, [], ["_d", "word"], F.floor(F.col("_d") / (RANGE // 64)), "_number").select("word", "_number")
    size = words.agg(F.count("*").alias("_size"))  # one row
    rows = tasks.join(F.broadcast(size)).select("task_id", "_size", draw(seed, F.lit("task"), "task_id").alias("_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"))).alias("place"))
    first = permuted(rows.where("place < _size"), "place", "_size", "_key", "_ix").join(known, F.col("_ix") == F.col("_number"))
    again = F.explode(F.sequence(F.lit(0), F.when(F.col("place") < common, often - 1).otherwise(0))).alias("copy")
    copies = first.select("task_id", "word", "place", again)
    copies = copies.withColumn("e", draw(seed, "task_id", "word", "copy"))
    mixed = F.transform(F.array_sort(F.collect_list(F.struct("e", "word"))), lambda x: x["word"])
    label = F.transform(F.array_sort(F.collect_list(F.when((F.col("place") < common) & (F.col("copy") == 0), F.struct("place", "word")))), lambda x: x["word"])
    return copies.groupBy("task_id").agg(mixed.alias("words"), label.alias("label"))


def transcripts(df: DataFrame, turns: str, answers: str) -> DataFrame:
    """A judge's prompt for each turn, numbered from 1, with the questions and answers up to it."""
    rows = df.select("*", F.explode(F.sequence(F.lit(1), F.size(turns))).alias("turn"))
    pairs = F.slice(F.arrays_zip(F.col(turns).alias("q"), F.col(answers).alias("r")), 1, F.col("turn"))
    number = lambda word, i: F.concat(F.lit(f"{word} "), (i + 1).cast("string"), F.lit(": "))
    lines = F.transform(pairs, lambda x, i: F.concat(number("Question", i), x["q"], F.lit("\n"), number("Answer", i), x["r"]))
    return rows.withColumn("prompt", F.array_join(lines, "\n"))


def rubric_prompt(turns: Column, criterion: Column, points: Column) -> Column:
    lines = F.array_join(F.transform(turns, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return F.concat(F.lit("Conversation:\n"), lines, F.lit("\n\nCriterion ("), points.cast("string"), F.lit(" points): "), criterion)


def translation_prompt(source: Column, translation: Column, reference: Column) -> Column:
    return F.concat(F.lit("Source: "), source, F.lit("\nTranslation: "), translation, F.lit("\nReference: "), reference)


def boxed_prompt(question: Column, answer: Column, label: Column) -> Column:
    """A question with the answer's last box, or all of it if there is none, and the right answer."""
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), F.coalesce(boxed(answer), answer), F.lit("\nRight answer: "), label)


#: What a judge is asked, by name; own forms are added here.
JUDGE_PROMPTS = {"rubric": rubric_prompt, "translation": translation_prompt, "boxed": boxed_prompt}
