"""Metrics of generated text against references.

A text meets all of its references at once: it moves to them by its item, is split
once, and what moves of a reference is what it was split into. No token moves by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from gradus.functions.draws import intervals, resampled_means
from gradus.functions.text import f_measure, hashed_ngrams, let, ngrams, norm, normalize_answer, ratio, runs, tokens


def compared(preds: DataFrame, keys: DataFrame, texts: DataFrame, split: Callable[[Column], Column], common: Callable[[Column, Column], Column], size: Callable[[Column], Column] = F.size) -> DataFrame:
    """(item_id, ref_ix, common, n_pred, n_ref) of each prediction with each of its references.

    ``preds`` holds (item_id, pred), ``keys`` (item_id, ref_ix, ref_id) and ``texts``
    (ref_id, ref); ``split`` makes the array of a text's parts, and ``common`` of a
    prediction's parts and an array of its references' the array of what they share.
    """
    parts = lambda c: F.coalesce(split(F.col(c)), F.array())
    right = texts.select("ref_id", parts("ref").alias("parts"))
    refs = keys.join(right, "ref_id").groupBy("item_id").agg(F.collect_list(F.struct("ref_ix", "parts")).alias("_refs"))
    rows = preds.join(refs, "item_id").select("item_id", parts("pred").alias("_p"), "_refs")
    rows = rows.select("item_id", size(F.col("_p")).cast("long").alias("n_pred"), "_refs", common(F.col("_p"), F.col("_refs.parts")).alias("common"))
    each = F.arrays_zip(F.col("_refs").alias("r"), F.col("common"))
    return rows.select("item_id", "n_pred", F.explode(each).alias("_e")).select("item_id", "_e.r.ref_ix", "_e.common", "n_pred", size(F.col("_e.r.parts")).cast("long").alias("n_ref"))


def shared_count(pred: np.ndarray, ref: np.ndarray) -> int:
    """Size of the multiset that two arrays share."""
    if not len(pred) or not len(ref):
        return 0
    known, times = np.unique(ref, return_counts=True)
    at = np.minimum(np.searchsorted(known, pred), len(known) - 1)
    return int(np.minimum(np.bincount(at[known[at] == pred], minlength=len(known)), times).sum())


@pandas_udf(ArrayType(LongType()))
def shared(preds: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([[shared_count(p, r) for r in many] for p, many in zip(preds, refs, strict=True)])


def overlap(preds: DataFrame, keys: DataFrame, texts: DataFrame, split: Callable[[Column], Column], n: int = 1) -> DataFrame:
    """(item_id, ref_ix, common, n_pred, n_ref): multiset overlap of each prediction with each of its references.

    Runs of n of what ``split`` makes of a text are counted, as 64-bit hashes.
    """
    return compared(preds, keys, texts, lambda c: hashed_ngrams(split(c), n), shared)


def overlap_scores(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of an overlap, 0 where undefined."""
    p, r = ratio(F.col("common"), F.col("n_pred")), ratio(F.col("common"), F.col("n_ref"))
    return counts.select("item_id", "ref_ix", p.alias("precision"), r.alias("recall"), f_measure(p, r).alias("f1"))


def token_f1(preds: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, f1): the best token F1 over the references, after answer normalisation."""
    words = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda x: x != "")
    return overlap_scores(overlap(preds, keys, texts, words)).groupBy("item_id").agg(F.max("f1").alias("f1"))


def rouge_n(preds: DataFrame, keys: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Overlap of n-grams of tokens."""
    return overlap_scores(overlap(preds, keys, texts, tokens, n))


def aggregated(scores: DataFrame, keys: list[str], measures: list[str], bootstraps: int, seed: int) -> DataFrame:
    """(measure, low, mid, high): median and middle 95 % of the means of resampled rows, for all measures from the same weights."""
    means = resampled_means(scores, [], keys, measures, bootstraps, seed)
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in measures])
    return intervals(means.select(F.explode(each).alias("e")).select("e.*"), ["measure"], "x")


def exact_match(pred: Column, refs: Column) -> Column:
    """1 if the prediction equals one of the references after normalisation."""
    return F.exists(refs, lambda r: normalize_answer(r) == normalize_answer(pred)).cast("int")


def gold_contained(pred: Column, refs: Column) -> Column:
    """1 if the first reference occurs in the prediction; lower case, full stops at the ends aside."""
    bare = lambda c: F.btrim(F.lower(c), F.lit(". "))
    return F.contains(bare(pred), bare(F.get(refs, F.lit(0)))).cast("int")


def error_scores(df: DataFrame, by: list[str], value: str, worst: float) -> DataFrame:
    """Mean error, and the mean of how far each is from the worst one, on 0 to 100."""
    return df.groupBy(*by).agg(F.avg(value).alias("score"), (F.avg(norm(F.col(value), worst, 0.0)) * 100).alias("normalized"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, a machine word of the shorter side at a time; tokens that the other side lacks are left out."""
    short, long = sorted((a, b), key=len)
    other = set(long)
    short = [x for x in short if x in other]
    masks: dict[str, int] = {}
    for i, x in enumerate(short):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(short)) - 1
    row = full
    for y in long:
        if y in masks:
            hit = row & masks[y]
            row = ((row + hit) | (row - hit)) & full
    return len(short) - row.bit_count()


@pandas_udf(LongType())
def lcs(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common subsequence of two arrays of strings."""
    for a, b in parts:
        yield pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


@pandas_udf(ArrayType(LongType()))
def lcs_of_each(preds: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([[lcs_length(p, list(r)) for r in many] for p, many in zip(map(list, preds), refs, strict=True)])


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(item_id, ref_ix, precision, recall, f1) from (item_id, ref_ix, pred, ref)."""
    words = pairs.select("item_id", "ref_ix", tokens(F.col("pred")).alias("p"), tokens(F.col("ref")).alias("r"))
    counts = words.select("item_id", "ref_ix", lcs("p", "r").alias("common"), F.size("p").alias("n_pred"), F.size("r").alias("n_ref"))
    return overlap_scores(counts)


def rouge_l_of_each(preds: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """The same from tables as ``compared`` takes them."""
    return overlap_scores(compared(preds, keys, texts, tokens, lcs_of_each))


def union_lcs(refs: list[list[str]], preds: list[list[str]]) -> int:
    """Tokens of the reference sentences that lie on a longest common subsequence with some predicted sentence, no token more often than either side has it."""
    left_p: dict[str, int] = {}
    left_r: dict[str, int] = {}
    for side, left in ((preds, left_p), (refs, left_r)):
        for sentence in side:
            for x in sentence:
                left[x] = left.get(x, 0) + 1
    total = 0
    for r in refs:
        on, known = set[int](), set(r)
        for p in preds:
            if not known.isdisjoint(p):
                on |= _on_lcs(r, p)
        for i in sorted(on):
            if left_p.get(r[i], 0) > 0 and left_r[r[i]] > 0:
                total += 1
                left_p[r[i]] -= 1
                left_r[r[i]] -= 1
    return total


def _on_lcs(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of one longest common subsequence; a bit for each pair of tokens is kept.

    A row's bits over b are 0 where the length grows, so that lengths are counts of zeros.
    Of neighbours in b that a lacks one is kept: the walk back does the same at all of them.
    """
    known, gapped = set(a), list[str | None]()
    for y in b:
        if y in known:
            gapped.append(y)
        elif not gapped or gapped[-1] is not None:
            gapped.append(None)
    b = gapped
    masks: dict[str, int] = {}
    for j, y in enumerate(b):
        if y is not None:
            masks[y] = masks.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        row, hit = rows[-1], rows[-1] & masks.get(x, 0)
        rows.append(((row + hit) | (row - hit)) & full)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    i, j, found = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.add(i)
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return found


@pandas_udf(ArrayType(LongType()))
def summary_lcs(preds: pd.Series, refs: pd.Series) -> pd.Series:
    lists = lambda sentences: [list(s) for s in sentences]
    return pd.Series([[union_lcs(lists(r), p) for r in many] for p, many in zip(map(lists, preds), refs, strict=True)])


def rouge_lsum(preds: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """As rouge_l, sentence by sentence; sentences are lines."""
    split = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda s: tokens(s)), lambda s: F.size(s) > 0)
    return overlap_scores(compared(preds, keys, texts, split, summary_lcs, lambda c: F.size(F.flatten(c))))


def chrf(preds: DataFrame, refs: DataFrame, chars: int = 6, words: int = 2, beta: float = 2.0) -> DataFrame:
    """chrF of a corpus on 0 to 100: F-scores of character and word n-grams, whose counts are summed over all items, averaged over orders."""
    def pieces(bare: Column, n: int) -> Column:
        return let(bare, lambda t: runs(F.length(t), n, lambda i: F.substring(t, i, F.lit(n))))

    def named(order: str, grams: Column) -> Column:
        return F.transform(grams, lambda x: F.struct(F.lit(order).alias("order"), x.alias("gram")))

    def counted(df: DataFrame, c: str, name: str) -> DataFrame:
        bare, split = F.regexp_replace(F.col(c), r"\s+", ""), F.filter(F.split(F.col(c), r"\s+"), lambda x: x != "")
        each = [named(f"c{n}", pieces(bare, n)) for n in range(1, chars + 1)] + [named(f"w{n}", ngrams(split, n)) for n in range(1, words + 1)]
        rows = df.select("item_id", F.explode(F.flatten(F.array(*each))).alias("e"))
        return rows.groupBy("item_id", "e.order", "e.gram").agg(F.count("*").alias(name))

    both = counted(preds, "pred", "n").join(counted(refs, "ref", "m"), ["item_id", "order", "gram"], "full")
    sums = both.groupBy("order").agg(
        F.sum(F.least(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)))).alias("common"), F.sum(F.coalesce("n", F.lit(0))).alias("n_pred"), F.sum(F.coalesce("m", F.lit(0))).alias("n_ref")
    )
    p, r = ratio(F.col("common"), F.col("n_pred")), ratio(F.col("common"), F.col("n_ref"))
    return sums.agg((F.sum(f_measure(p, r, beta)) / (chars + words) * 100).alias("chrf"))
