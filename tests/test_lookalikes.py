"""Look-alike names over an index against the plain comparison of every pair."""

import random

import pytest

from assayer.operators import dependencies
from assayer.operators import patterns as P

COLUMNS = "ecosystem string, known string, rank int"


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_comparison(spark, seed):
    rng = random.Random(seed)
    letters = "abcde" if seed == 1 else "abcdefghijklmnop-"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
    popular = {e: list(dict.fromkeys([word() for _ in range(200)] + ["Cased", "same", "same2"])) for e in ("node", "python")}

    def edited(w):
        at = rng.randrange(len(w) + 1)
        return rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :], w, w.upper(), w + w, w[::-1]])

    names = [(e, edited(rng.choice(popular[e]))) for e in popular for _ in range(250)] + [("node", None), ("node", ""), ("node", "cased"), ("python", "same2"), ("other", "same")]
    frame = spark.createDataFrame(names + names[:5], "ecosystem string, name string")
    index = spark.createDataFrame([(e, k, i) for e, ks in popular.items() for i, k in enumerate(ks)], COLUMNS)
    got = {(r["ecosystem"], r["name"]): r["resembles"] for r in dependencies.lookalikes(frame, index).collect()}
    want = {(e, n): r for e, n in set(names) if n and (r := dependencies.resembles(n, tuple(popular.get(e, ()))))}
    assert got == want and len(want) > 100


def test_popular_packages_of_both_ecosystems(spark):
    index = spark.createDataFrame([(e, k, i) for e, ks in (("python", P.POPULAR_PYTHON), ("node", P.POPULAR_NODE)) for i, k in enumerate(ks)], COLUMNS)
    names = [("python", "reqeusts"), ("python", "requests"), ("node", "reqeusts"), ("node", "expresss"), ("node", "lodahs"), ("python", "numpyy")]
    got = {tuple(r) for r in dependencies.lookalikes(spark.createDataFrame(names, "ecosystem string, name string"), index).collect()}
    assert got == {(e, n, r) for e, n in names if (r := dependencies.resembles(n, P.POPULAR_PYTHON if e == "python" else P.POPULAR_NODE))} and len(got) >= 4
    assert dependencies.lookalikes(spark.createDataFrame([], "ecosystem string, name string"), index).collect() == []
