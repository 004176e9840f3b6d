"""Whether two formulas say the same, by their values at random points.

A formula is read by precedence into a value at each of a few fixed points: every
variable has a positive fraction there. Values are fractions as long as they are
rational, so that identities of polynomials and rational functions hold exactly, and
decimals of 80 digits once a root or an irrational power comes in. Functions that
aren't worked out, such as sines, stand for a number that only their name and
argument decide. Sets, lists, tuples, intervals, unions and equations are compared
part by part.
"""

from __future__ import annotations

import hashlib
import re
from decimal import Context, Decimal, DecimalException, localcontext
from fractions import Fraction

DIGITS, SAME, POINTS, MOST_BITS = 80, Decimal(10) ** -50, 3, 20_000
CONSTANTS = {r"\pi": "3.14159265358979323846264338327950288419716939937510582097494459230781640628620899"}
NAMED = {r"\cdot": "*", r"\times": "*", r"\div": "/", "÷": "/", "×": "*", "·": "*", "−": "-", "–": "-", r"\cup": "∪", r"\pm": "±", r"\infty": "∞", r"\in": "∈", "π": r"\pi", "√": r"\sqrt", "**": "^"}
LAYOUT = re.compile(r"\\(?:left|right|displaystyle|quad|qquad|limits|big|Big|[,;:! ])|\\(?:text|mathrm|operatorname)\{\s*([^{}]*?)\s*\}|\\?[%$]|°|\^\{?\\circ\}?")
TOKEN = re.compile(r"\d+(?:\.\d+)?|\.\d+|\\[A-Za-z]+|\\[{}]|\*\*|.", re.S)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, set(")]}")


class Unread(ValueError):
    """Not a formula, or without a value at a point."""


def number(name: str, point: int, argument: str = "") -> Fraction:
    digest = hashlib.sha256(f"{point}|{name}|{argument}".encode()).digest()
    return Fraction(int.from_bytes(digest[:4], "big") + 1, int.from_bytes(digest[4:7], "big") + 1)


def decimal(x) -> Decimal:
    return x if isinstance(x, Decimal) else Decimal(x.numerator) / Decimal(x.denominator)


def same(x, y) -> bool:
    if isinstance(x, Fraction) and isinstance(y, Fraction):
        return x == y
    x, y = decimal(x), decimal(y)
    return abs(x - y) <= SAME * max(1, abs(x), abs(y))


def both(x, y, f):
    return f(x, y) if isinstance(x, Fraction) and isinstance(y, Fraction) else f(decimal(x), decimal(y))


def power(x, n):
    if isinstance(n, Fraction) and n.denominator == 1:
        k = n.numerator
        if not isinstance(x, Fraction):
            return x**k
        if x == 0 and k < 0:
            raise Unread
        if abs(k) * max(x.numerator.bit_length(), x.denominator.bit_length()) > MOST_BITS:
            return decimal(x) ** k
        return x**k
    return root(x, n.denominator, n.numerator) if isinstance(n, Fraction) else (decimal(x).ln() * n).exp() if x > 0 else fail()


def fail():
    raise Unread


def whole_root(n: int, k: int) -> int:
    """The k-th root of a natural number, rounded down."""
    x = 1 << -(-n.bit_length() // k)
    while (y := ((k - 1) * x + n // x ** (k - 1)) // k) < x:
        x = y
    return x


def root(x, k: int, times: int = 1):
    """The k-th root of x, to the power ``times``: a fraction where it is one."""
    if x < 0:
        return -root(-x, k, times) if k % 2 and times % 2 else root(-x, k, times) if k % 2 else fail()
    if x == 0:
        return x if times > 0 else fail()
    if isinstance(x, Fraction) and k < 64:
        top, bottom = whole_root(x.numerator, k) if x.numerator else 0, whole_root(x.denominator, k)
        if top**k == x.numerator and bottom**k == x.denominator:
            return power(Fraction(top, bottom), Fraction(times))
    return (decimal(x).ln() * times / k).exp()


class Reader:
    """Reads the tokens of one formula at one point."""

    def __init__(self, text: str, point: int):
        self.tokens, self.at, self.point = [t for t in TOKEN.findall(text) if not t.isspace()], 0, point

    def next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.next()
        if wanted and token not in wanted:
            raise Unread
        self.at += 1
        return token

    def whole(self):
        found = self.union()
        return found if self.at == len(self.tokens) else fail()

    def union(self):
        parts = [self.items()]
        while self.next() == "∪":
            self.take()
            parts.append(self.items())
        return parts[0] if len(parts) == 1 else ("union", parts)

    def items(self):
        """One item, or a list of them, whose order doesn't count."""
        parts = self.sides()
        while self.next() == ",":
            self.take()
            parts += self.sides()
        return parts[0] if len(parts) == 1 else ("set", parts)

    def sides(self) -> list:
        """An item; of an equation that names a variable the other side, and for a double sign both values."""
        start = self.at
        if len(self.tokens) > start + 2 and re.fullmatch(r"[A-Za-z]|\\[a-z]+", self.next()) and self.tokens[start + 1] in "=∈":
            self.at += 2
        left = self.sum()
        if self.next() == "=":
            self.take()
            return [("equation", both(self.single(left), self.single(self.sum()), lambda x, y: x - y))]
        return left

    def single(self, values: list):
        return values[0] if len(values) == 1 and isinstance(values[0], Fraction | Decimal) else fail()

    def sum(self) -> list:
        sign = self.take() if self.next() in ("+", "-", "±") else ""
        value = self.product()
        if sign in ("-", "±"):
            negative = [both(Fraction(0), self.single([v]), lambda x, y: x - y) for v in value]
            value = negative + value if sign == "±" else negative
        while self.next() in ("+", "-", "±"):
            sign, more = self.take(), self.product()
            steps = {"+": [1], "-": [-1], "±": [1, -1]}[sign]
            value = [both(self.single([v]), self.single([m]), lambda x, y, s=s: x + s * y) for v in value for m in more for s in steps]
        return value

    def product(self) -> list:
        value = self.signed()
        while (token := self.next()) in ("*", "/") or re.match(r"[0-9A-Za-z.(]|\\(?!\}|\{)", token) or (token == "{" and value and not isinstance(value[0], tuple)):
            divides = token == "/"
            if token in ("*", "/"):
                self.take()
            more = self.signed()
            value = [self.times(self.single([v]), self.single([m]), divides) for v in value for m in more]
        return value

    def times(self, x, y, divides: bool):
        if divides and y == 0:
            raise Unread
        return both(x, y, (lambda a, b: a / b) if divides else (lambda a, b: a * b))

    def signed(self) -> list:
        if self.next() in ("-", "+"):
            sign = self.take()
            return [both(Fraction(0), self.single([v]), lambda x, y: x - y if sign == "-" else x + y) for v in self.signed()]
        value = self.atom()
        if self.next() == "^":
            self.take()
            exponent = self.single(self.signed())
            value = [power(self.single([v]), exponent) for v in value]
        while self.next() == "!":
            self.take()
            n = self.single(value)
            if not isinstance(n, Fraction) or n.denominator != 1 or not 0 <= n <= 500:
                raise Unread
            value = [Fraction(1)]
            for k in range(2, int(n) + 1):
                value = [value[0] * k]
        return value

    def group(self) -> list:
        """What stands in braces, or one token."""
        if self.next() == "{":
            self.take()
            value = self.sum()
            self.take("}")
            return value
        token = self.take()
        if token.isdigit() and len(token) > 1:  # \frac12
            self.at -= 1
            self.tokens[self.at : self.at + 1] = list(token)
            token = self.take()
        return self.named(token)

    def atom(self) -> list:
        token = self.take()
        if token in (r"\frac", r"\dfrac", r"\tfrac"):
            top, bottom = self.single(self.group()), self.single(self.group())
            return [self.times(top, bottom, True)]
        if token == r"\sqrt":
            k = 2
            if self.next() == "[":
                self.take()
                k = self.single(self.sum())
                self.take("]")
            if not isinstance(k, int) and (k.denominator != 1 or not 0 < k < 1000):
                raise Unread
            inner = self.group() if self.next() == "{" else self.atom()
            return [root(self.single(inner), int(k))]
        if token == "|":
            value = self.single(self.sum())
            self.take("|")
            return [abs(value)]
        if token in OPEN or token == r"\{":
            return self.bracketed(token)
        return self.named(token)

    def bracketed(self, token: str) -> list:
        start, parts, sizes = self.at, [], 0
        if self.next() in CLOSE or self.next() == r"\}":
            self.take()
            return [("set", [])]
        while True:
            parts += self.sides()
            sizes += 1
            if self.next() != ",":
                break
            self.take()
        end = self.take(*CLOSE, r"\}")
        if token in ("{", r"\{"):
            if sizes == 1 and token == "{" and start > 1:
                return parts
            return [("set", parts)]
        if sizes == 1 and OPEN[token] == end:
            return parts
        if sizes == 2 and (token, end) != ("(", ")"):
            return [("interval", token, end, parts)]
        return [("tuple", parts)]

    def named(self, token: str) -> list:
        if re.fullmatch(r"\d+(?:\.\d+)?|\.\d+", token):
            return [Fraction(token)]
        if token in CONSTANTS:
            return [Decimal(CONSTANTS[token])]
        if token == "∞":
            return [Decimal(10) ** 60]
        if re.fullmatch(r"\\[A-Za-z]+", token) and (self.next() in ("(", "{") or re.fullmatch(r"[A-Za-z0-9]+|\\[a-z]+", self.next())) and token[1:] in FUNCTIONS:
            argument = decimal(self.single(self.atom() if self.next() in ("(", "{") else self.signed()))
            return [number(token, self.point, f"{argument:.40e}")]
        if re.fullmatch(r"[A-Za-z]|\\[A-Za-z]+", token):
            if self.next() == "_":
                self.take()
                token += "_" + (self.take() if self.next() != "{" else "".join(iter(self.take, "}")))
            return [number(token, self.point)]
        raise Unread


FUNCTIONS = {"sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "exp", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh"}


def bare(text: str) -> str:
    """The formula that a text ends with, without layout."""
    if r"\boxed{" in text:
        start = text.rindex(r"\boxed{") + len(r"\boxed{")
        depth, end = 1, start
        while end < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        text = text[start : end - (not depth)]
    elif (spans := re.findall(r"\$([^$]+)\$", text)) and re.search(r"[A-Za-z]{3}", re.sub(r"\$[^$]*\$", "", text)):
        text = spans[-1]
    text = re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", text)  # thousands
    text = LAYOUT.sub(lambda m: "" if m[1] is None or re.search(r"[A-Za-z]{2}|^$", m[1]) else m[1], text.replace(r"\$", ""))
    for name, symbol in NAMED.items():
        text = re.sub(re.escape(name) + (r"(?![A-Za-z])" if name[-1].isalpha() and name[0] == "\\" else ""), lambda _, s=symbol: s, text)
    return text.rstrip(".")


def alike(x, y) -> bool:
    if isinstance(x, list) or isinstance(y, list):
        x, y = (v if isinstance(v, list) else [v] for v in (x, y))
        return len(x) == len(y) and all(map(alike, x, y))
    if not isinstance(x, tuple) or not isinstance(y, tuple):
        return not isinstance(x, tuple) and not isinstance(y, tuple) and same(x, y)
    if x[0] != y[0] or x[0] == "interval" and x[1:3] != y[1:3]:
        return False
    if x[0] in ("set", "union"):  # in any order
        rest = list(y[1])
        for item in x[1]:
            found = next((i for i, other in enumerate(rest) if alike(item, other)), None)
            if found is None:
                return False
            rest.pop(found)
        return not rest
    return alike(x[-1], y[-1])


def scaled(pairs: list[tuple]) -> bool | None:
    """Equations are the same if one is a multiple of the other: None where they aren't equations."""
    if not all(isinstance(x, tuple) and isinstance(y, tuple) and x[0] == y[0] == "equation" for x, y in pairs):
        return None
    if any(x[1] == 0 or y[1] == 0 for x, y in pairs):
        return all(x[1] == y[1] for x, y in pairs)
    ratios = [both(x[1], y[1], lambda a, b: a / b) for x, y in pairs]
    return all(same(ratios[0], r) for r in ratios)


def equivalent(a: str, b: str) -> bool:
    """Equal at every point; texts that are no formulas, or that have no value there, are equal to nothing."""
    try:
        with localcontext(Context(prec=DIGITS, Emax=10**6, Emin=-(10**6))):
            pairs = [(Reader(bare(a), k).whole(), Reader(bare(b), k).whole()) for k in range(POINTS)]
            multiple = scaled(pairs)
            return all(alike(x, y) for x, y in pairs) if multiple is None else multiple
    except (Unread, DecimalException, RecursionError, OverflowError, ZeroDivisionError, TypeError, IndexError):
        return False
