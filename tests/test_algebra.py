import pytest

from gradus.functions.algebra import equivalent

SAME = [
    ("(x+1)(x-2)", "x^2-x-2"), (r"\frac{x^2-9}{x-3}", "x+3"), (r"\sqrt{48}", r"4\sqrt{3}"), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt2}{2}"), ("2^{10}", "1024"),
    (r"x^{\frac12}", r"\sqrt{x}"), (r"\sqrt[3]{27}", "3"), (r"\sqrt[3]{-8}", "-2"), (r"\{1,2,3\}", r"\{3, 1, 2\}"), ("1, 2", "2,1"), ("(1,2)", "(1, 2)"), (r"\left[\frac{2}{4}, 3\right)", "[0.5,3)"),
    (r"(-\infty, 2) \cup [3,4]", r"[3, 4]\cup(-\infty,2)"), ("x = 5", "5"), ("y=2x+1", "2x+1"), ("2x+3y=6", "4x + 6y = 12"), (r"$\frac{3}{4}$", "0.75"), (r"The answer is $x^2$, so \boxed{\frac{a}{b}}", "a/b"),
    (r"\sin(x+y)", r"\sin(y+x)"), (r"2\pi", r"\pi + \pi"), (r"\pm 3", "-3, 3"), ("1,234", "1234"), ("5!", "120"), ("|{-3}|", "3"), (r"3\cdot 4", "12"), ("2^{-3}", r"\frac{1}{8}"), ("a_1+a_2", "a_2+a_1"),
    (r"\frac12", "0.5"), ("x^{2}x^{3}", "x^5"), (r"\sqrt{2}\sqrt{3}", r"\sqrt{6}"), (r"\frac{\sqrt{8}}{2}", r"\sqrt{2}"), (r"(1+\sqrt5)^2", r"6+2\sqrt{5}"), ("50\\%", "50"), (r"12\text{ cm}", "12"), (r"x\in[1,2]", "[1,2]"), ("−3", "-3"), (r"x^{3} \cdot x^{-45}", r"\frac{1}{x^{42}}"), (r"2\pi r", r"r \cdot 2 \pi"),
]
APART = [
    ("(x+1)^2", "x^2+1"), ("[1,2]", "(1,2)"), ("[1,2)", "(1,2]"), ("(1,2)", "(2,1)"), (r"\{1,2\}", r"\{1,2,2\}"), ("2x+3y=6", "2x+3y=7"), (r"\sin(x)", r"\cos(x)"), ("x", "y"), (r"\sqrt{2}", "1.41421356"), ("0.333333", "1/3"),
    ("", ""), ("not a formula", "not a formula at all"), ("1/0", "1/0"), ("x^", "x"), ("((((", "1"), (r"\sqrt{-1}", "1"), ("1, 2", "1, 3"), (r"\frac{1}{x-x}", "1"), ("9" * 500 + "^" + "9" * 500, "1"), ("(" * 100000, "x"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert equivalent(a, b) and equivalent(b, a)


@pytest.mark.parametrize(("a", "b"), APART)
def test_apart(a, b):
    assert not equivalent(a, b) and not equivalent(b, a)
