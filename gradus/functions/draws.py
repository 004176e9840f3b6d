"""Random draws as hashes of stable keys: the same on every run, partitioning and engine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 15  # hexadecimal digits of a draw
RANGE = 1 << (4 * DIGITS)
HALF = (1 << 30) - 1  # products of two numbers of 30 bits stay within a long


def draw(*key: Column | str | int) -> Column:
    """A whole number below 2^60 from integers or strings, joined with bars."""
    parts = [F.lit(str(k)) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, DIGITS), 16, 10).cast("long")


def uniform(*key: Column | str | int) -> Column:
    """At least 0, at most 1."""
    return draw(*key) / F.lit(float(RANGE))


def below(n: int | Column, *key: Column | str | int) -> Column:
    """A whole number from 0 to n - 1."""
    return draw(*key) % n


def draw_sql(*key: str) -> str:
    """The same draw in DuckDB's SQL; parts are SQL expressions, or integers as text."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'({k})::VARCHAR' for k in key)})), 1, {DIGITS}))::BIGINT)"


def divided(x: Column, n: Column | int) -> Column:
    """The whole quotient of longs, which a quotient of doubles isn't beyond 2^53."""
    return F.call_function("div", x, F.lit(n) if isinstance(n, int) else n)


# ------------------------------------------------------------------ permutations
MULTIPLIERS = (0x2545F491, 0x1B873593, 0x27D4EB2F, 0x165667B1, 0x3C6EF35F, 0x19660D01)  # odd, below 2^30
WALK = 64


def _step(value: Column, key: Column, k: int) -> Column:
    """Whole numbers that look random, from one half of a number and the key of a round."""
    product = (value + F.shiftright(key, 6 * k).bitwiseAND(HALF)) * MULTIPLIERS[k]
    return F.shiftright(product, 13).bitwiseXOR(product)


def _sides(total: Column) -> tuple[Column, Column]:
    a = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    return a, divided(total + a - 1, a)


def permuted(rows: DataFrame, x: str, total: str, key: str, name: str) -> DataFrame:
    """``rows`` with the place of ``x`` under a permutation of 0 .. total - 1, which the long ``key`` picks.

    A number is a pair of digits, the first below a, the second below b, where a is
    the root of the total rounded up and a * b no more than a - 1 above it. A
    Feistel network adds to either digit in turn a hash of the other, six times. What
    comes out at the total or above goes through again until it is below, which is
    again a permutation. Nothing is enumerated: a row costs the same whatever the
    total. Totals may have 60 bits.
    """
    a, b, left, right = (f"_permuted_{c}" for c in "ablr")
    size_a, size_b = _sides(F.col(total))
    out = rows.withColumn(a, size_a).withColumn(b, size_b)
    out = out.withColumns({left: divided(F.col(x), F.col(b)), right: F.col(x) % F.col(b)})
    for k in range(0, 6, 2):
        out = out.withColumn(left, (F.col(left) + _step(F.col(right), F.col(key), k)) % F.col(a))
        out = out.withColumn(right, (F.col(right) + _step(F.col(left), F.col(key), k + 1)) % F.col(b))
    out = out.withColumn(name, F.col(left) * F.col(b) + F.col(right))

    def half(k: int):
        return lambda s: F.struct(((s["l"] + _step(s["r"], F.col(key), k)) % F.col(a)).alias("l"), s["r"].alias("r"))

    def rest(k: int):
        return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + _step(s["l"], F.col(key), k)) % F.col(b)).alias("r"))

    def again(y: Column) -> Column:
        state = F.struct(divided(y, F.col(b)).alias("l"), (y % F.col(b)).alias("r"))
        for k in range(0, 6, 2):
            for change in (half(k), rest(k + 1)):
                state = F.get(F.transform(F.array(state), change), F.lit(0))
        return F.get(F.transform(F.array(state), lambda s: s["l"] * F.col(b) + s["r"]), F.lit(0))

    # at most a - 1 numbers are outside: up to 64 steps are certain for totals of 4,096, and beyond those further ones have a chance of 64^-64
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col(name), lambda y, _: F.when(y < F.col(total), y).otherwise(again(y)))
    return out.withColumn(name, F.when(F.col(name) < F.col(total), F.col(name)).otherwise(walked)).drop(a, b, left, right)


def permuted_sql(name: str, rows: str, keys: str, x: str, total: str, key: str, ix: str) -> str:
    """A recursive CTE with the columns ``keys``, ``x``, ``total``, ``key`` and ``ix``, the place of ``x``; of its rows those with ix < total count."""

    def network(source: str, value: str) -> str:
        out = f"SELECT *, {value} // side_b AS l, {value} % side_b AS r FROM ({source})"
        for k in range(0, 6, 2):
            for mine, other, side, n in (("l", "r", "side_a", k), ("r", "l", "side_b", k + 1)):
                product = f"(({other} + (({key} >> {6 * n}) & {HALF})) * {MULTIPLIERS[n]})"
                out = f"SELECT * REPLACE (({mine} + xor({product} >> 13, {product})) % {side} AS {mine}) FROM ({out})"
        return f"SELECT {keys}, {x}, {total}, {key}, side_a, side_b, l * side_b + r AS {ix} FROM ({out})"

    sides = f"SELECT *, ({total} + side_a - 1) // side_a AS side_b FROM (SELECT {keys}, {x}, {total}, {key}, ceil(sqrt({total}::DOUBLE))::BIGINT AS side_a FROM {rows})"
    return f"{name} AS ({network(sides, x)} UNION ALL {network(f'SELECT * FROM {name} WHERE {ix} >= {total}', ix)})"


# ------------------------------------------------------------------ resampling
#: How many of 2^30 equally likely draws give a Poisson(1) weight up to 0, 1, 2, ...
POISSON = [round((1 << 30) * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
STRIDE, FIRST, SECOND = 0x1E3779B1, 0x2C1B3C6D, 0x297A2D39


def poisson_weights(rows: DataFrame, key: str, bootstrap: str, name: str) -> DataFrame:
    """``rows`` with a Poisson(1) weight for a row's 60-bit draw and the number of a bootstrap."""
    t = f"_{name}_t"
    high, low = F.shiftright(F.col(key), 30), F.col(key).bitwiseAND(HALF)
    mixed = low.bitwiseXOR((F.col(bootstrap) * STRIDE).bitwiseAND(HALF)) * FIRST
    out = rows.withColumn(t, mixed).withColumn(t, F.shiftright(t, 15).bitwiseXOR(F.col(t)).bitwiseXOR(high).bitwiseAND(HALF) * SECOND)
    out = out.withColumn(t, F.shiftright(t, 14).bitwiseXOR(F.col(t)).bitwiseAND(HALF))
    weight = F.lit(len(POISSON)).cast("long")
    for k in reversed(range(len(POISSON))):
        weight = F.when(F.col(t) < POISSON[k], F.lit(k).cast("long")).otherwise(weight)
    return out.withColumn(name, weight).drop(t)


def poisson_sql(rows: str, key: str, bootstrap: str, name: str) -> str:
    """The same weight in DuckDB's SQL."""
    mixed = f"SELECT *, xor({key} & {HALF}, ({bootstrap} * {STRIDE}) & {HALF}) * {FIRST} AS t FROM {rows}"
    mixed = f"SELECT * REPLACE ((xor(xor(t >> 15, t), {key} >> 30) & {HALF}) * {SECOND} AS t) FROM ({mixed})"
    mixed = f"SELECT * REPLACE (xor(t >> 14, t) & {HALF} AS t) FROM ({mixed})"
    cases = " ".join(f"WHEN t < {p} THEN {k}" for k, p in enumerate(POISSON))
    return f"SELECT *, CASE {cases} ELSE {len(POISSON)} END AS {name} FROM ({mixed})"


def resampled_means(rows: DataFrame, by: list[str], keys: list[str], values: list[str], bootstraps: int, seed: int) -> DataFrame:
    """(by, bootstrap, values): each value's mean over resampled rows of a group, by the Poisson bootstrap.

    In each bootstrap a row counts as often as a Poisson(1) weight says, drawn from
    the row's keys, which stands for how often a draw with replacement would take it.
    Weighted sums are formed where the rows are: what moves is one row per task,
    group and bootstrap, and no row meets another.
    """
    drawn = rows.select(*by, draw(seed, *by, *keys).alias("_key"), *values)
    drawn = drawn.withColumn("bootstrap", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bootstraps - 1).cast("long"))))
    drawn = poisson_weights(drawn, "_key", "bootstrap", "_weight").where("_weight > 0")
    sums = drawn.groupBy(*by, "bootstrap").agg(F.sum("_weight").alias("_n"), *[F.sum(F.col(v) * F.col("_weight")).alias(v) for v in values])
    return sums.select(*by, "bootstrap", *[(F.col(v) / F.col("_n")).alias(v) for v in values])


#: Rounds of MD5: what is added, and by how much is rotated.
ADDED = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
ROTATED = [r for rs in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in rs * 4]
BLOCK = 1 << 15  # numbers drawn at once


def md5_words(words: list[int | np.ndarray], n: int) -> list[np.ndarray]:
    """MD5 of n padded messages at once, from their words of 32 bits; a word that they share is a number."""
    state = [np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    f, rest = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                g = i
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                g = 7 * i % 16
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            word = words[at + g]
            if isinstance(word, int):
                f += np.uint32((word + ADDED[i]) & 0xFFFFFFFF)
            else:
                f += word
                f += np.uint32(ADDED[i])
            np.right_shift(f, 32 - ROTATED[i], out=rest)
            f <<= ROTATED[i]
            f |= rest
            f += b
            a, b, c, d, f = d, f, b, c, a
        for x, y in zip(state, (a, b, c, d), strict=True):
            x += y
    return state


def drawn(head: bytes, tails: np.ndarray) -> np.ndarray:
    """The draws, as ``draw`` makes them, of the texts head + tail; tails are rows of equally many bytes."""
    n, width = tails.shape
    size = len(head) + width
    text = bytearray(64 * ((size + 8) // 64 + 1))
    text[: len(head)], text[size], text[-8:] = head, 0x80, (8 * size).to_bytes(8, "little")
    words: list[int | np.ndarray] = np.frombuffer(text, "<u4").tolist()
    first, left = divmod(len(head), 4)
    padded = np.zeros((n, (left + width + 3) // 4 * 4), np.uint8)
    padded[:, left : left + width] = tails
    for i, part in enumerate(padded.view("<u4").T, first):
        words[i] = part | np.uint32(words[i])
    a, b, _, _ = md5_words(words, n)
    return (a.byteswap().astype(np.uint64) << 28) | (b.byteswap() >> 4)


def digits(numbers: np.ndarray) -> np.ndarray:
    """A row of digits of each number; they have equally many."""
    return (numbers[:, None] // 10 ** np.arange(len(str(numbers[0])) - 1, -1, -1) % 10 + ord("0")).astype(np.uint8)


def blocks(low: int, high: int) -> Iterator[np.ndarray]:
    """low .. high - 1 in blocks whose numbers have equally many digits."""
    while low < high:
        end = min(high, low + BLOCK, 10 ** len(str(low)))
        yield np.arange(low, end)
        low = end


def resampled_sums(head: bytes, bootstraps: range, n: int, low: int, values: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each bootstrap's draws from 0 .. n - 1 those from ``low`` on that have a value: the values' sum, and how many they are."""
    total, count = np.zeros(len(bootstraps)), np.zeros(len(bootstraps), np.int64)
    for numbers in blocks(0, n):
        right = digits(numbers)
        for block in blocks(bootstraps.start, bootstraps.stop):
            step = max(1, BLOCK // len(numbers))
            for some in (block[i : i + step] for i in range(0, len(block), step)):
                left = digits(some)
                tails = np.full((len(some), len(numbers), left.shape[1] + 1 + right.shape[1]), ord("|"), np.uint8)
                tails[:, :, : left.shape[1]] = left[:, None]
                tails[:, :, left.shape[1] + 1 :] = right
                at = (drawn(head, tails.reshape(-1, tails.shape[2])) % np.uint64(n)).astype(np.int64) - low
                mine = (at >= 0) & (at < len(values))
                at[~mine] = 0
                mine &= there[at]
                total[some - bootstraps.start] += np.where(mine, values[at], 0.0).reshape(len(some), -1).sum(axis=1)
                count[some - bootstraps.start] += mine.reshape(len(some), -1).sum(axis=1)
    return total, count


def intervals(means: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, low, mid, high): the middle 95 % of a value over bootstraps, and its median."""
    cuts = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return means.groupBy(*by).agg(cuts.alias("_c")).select(*by, *[F.col("_c")[i].alias(n) for i, n in enumerate(("low", "mid", "high"))])
