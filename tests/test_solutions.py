"""Joins of solutions whose shared variables may be unbound, against brute force."""

import random

import pytest

from graphloom.plans.solutions import Info, Solutions, join, left_join, minus, semi_join


def compatible(a, b):
    return all(a[i] is None or b[i] is None or a[i] == b[i] for i in (0, 1))


def merged(a, b):
    return (*(a[i] if a[i] is not None else b[i] for i in (0, 1)), a[2], b[2])


@pytest.mark.parametrize("left_maybe, right_maybe", [((True, True, True), (True, True, True)), ((False, True, True), (True, True, False)), ((False, True, False), (False, False, True))])
def test_joins_agree_with_brute_force(spark, left_maybe, right_maybe):
    draw = random.Random(5)

    def table(names, n, maybe):
        rows = [tuple(None if m and draw.random() < 0.4 else draw.choice("abc") for m in maybe) for _ in range(n)]
        df = spark.createDataFrame(rows, ", ".join(f"`?{x}` string" for x in names)).coalesce(1)
        return rows, Solutions(df, {x: Info("iri", "", m) for x, m in zip(names, maybe, strict=True)})

    def got(s):
        return sorted((tuple(r) for r in s.df.select(*(f"`?{n}`" for n in "xylr" if n in s.vars)).collect()), key=str)

    left, ls = table("xyl", 12, left_maybe)
    right, rs = table("xyr", 6, right_maybe)
    assert got(join(ls, rs)) == sorted((merged(a, b) for a in left for b in right if compatible(a, b)), key=str)
    for test, condition in ((lambda a, b: True, None), (lambda a, b: a[2] is not None and a[2] == b[2], lambda env: env("l").col == env("r").col)):
        want = []
        for a in left:
            want += [merged(a, b) for b in right if compatible(a, b) and test(a, b)] or [(*a, None)]
        assert got(left_join(ls, rs, condition)) == sorted(want, key=str)
    for wanted in (True, False):
        assert got(semi_join(ls, rs, wanted)) == sorted((a for a in left if any(compatible(a, b) for b in right) == wanted), key=str)
    shares = [a for a in left if any(compatible(a, b) and any(a[i] is not None and a[i] == b[i] for i in (0, 1)) for b in right)]
    assert got(minus(ls, rs)) == sorted((a for a in left if a not in shares), key=str)
    assert "NestedLoop" not in minus(ls, rs).df._jdf.queryExecution().toString()
