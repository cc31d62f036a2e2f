import random
import re

import pytest

from dossier.operators import grepindex, retrieval

PAGES = "page_id string, doc_id string, s3key string, asset_team string, page_num int, text string"


def page(spark, texts):
    return spark.createDataFrame([(f"p{i:04d}", f"d{i}", "k", "AB"[i % 2], 1, t) for i, t in enumerate(texts)], PAGES)


def holds(need, text):
    if need is True:
        return True
    if isinstance(need, str):
        return need in text
    return (all if need[0] == "all" else any)(holds(n, text) for n in need[1])


@pytest.mark.parametrize(
    "pattern, need",
    [
        ("abc", "abc"), ("abcd", ("all", ("abc", "bcd"))), ("ab", True), ("abc|de", True), ("abc|def", ("any", ("abc", "def"))), ("(?:abc)+x?", "abc"), ("(abc)*", True), ("abc{2}", True), ("(?:abc){2}", "abc"),
        (r"abc\b.*def", ("all", ("abc", "def"))), ("[0-9]+abc", "abc"), ("(?i)abc", True), (r"\Qabc\E", True), (r"\p{L}abc", True), ("[a[bcd]]xyz", True), ("[abc&&[b]]xyz", True), (r"a\.cd", ("all", ("a.c", ".cd"))), ("abc(", True), ("x(?:abc|(?:def|ghi))", ("any", ("abc", "def", "ghi"))), ("abc(?!def)", "abc"), (r"\vabc", True), ("", True),
    ],
)
def test_needs(pattern, need):
    assert grepindex.needs(pattern) == need


def test_a_match_holds_what_is_needed():
    """Random patterns of letters, groups, repeats and alternatives on random texts: no match without its need."""
    rng = random.Random(0)

    def some(depth):
        kind = rng.randint(0, 6 if depth else 2)
        if kind <= 2:
            return "".join(rng.choice("ab.") for _ in range(rng.randint(1, 5)))
        if kind == 3:
            return f"(?:{some(depth - 1)}|{some(depth - 1)})"
        if kind == 4:
            return f"({some(depth - 1)}){rng.choice(['?', '*', '+', '{2}', '{0,1}', '+?'])}"
        return some(depth - 1) + rng.choice(["[ab]", "\\b", "(?=a)", ""]) + some(depth - 1)

    met = 0
    for _ in range(3000):
        pattern, text = some(3), "".join(rng.choice("abc ") for _ in range(30))
        if re.search(pattern, text):
            met += 1
            assert holds(grepindex.needs(pattern), text), (pattern, text)
    assert met > 300


def test_indexed_equals_scan(spark):
    rng = random.Random(1)
    words = ["stuck", "pipe", "S733H", "S12H", "über", "naïve", "日本語です", "a+b", "pi", "\U0001f600\U0001f601\U0001f602", "tab\tbed", "depth"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "", "ab"]
    pages = page(spark, texts).repartition(3)
    index = grepindex.build(pages, tile=50).cache()
    for pattern, regex in (("stuck pipe", False), ("a+b", False), ("pi", False), ("本語で", False), ("\U0001f600\U0001f601\U0001f602", False), ("absent", False), (r"S\d{3}H", True), (r"S\d+H (?:pipe|stuck|depth)", True), (r"(?i)STUCK", True), (r"(?:über|naïve) .*depth", True), (r"\bpi\b", True), (r"nothing|stuck", True)):
        for team in (None, "A"):
            want = retrieval.grep(pages, pattern, regex, 1000, team).collect()
            assert grepindex.grep_indexed(pages, index, pattern, regex, 1000, team).collect() == want
    # candidates have the rarest of the trigrams
    found = {r.id for r in grepindex.candidates(index, grepindex.literal_needs("stuck pipe")).collect()}
    assert {f"p{i:04d}" for i, t in enumerate(texts) if t and "stuck pipe" in t} <= found and len(found) < 150
    assert grepindex.build(pages.limit(0)).count() == 0


def test_trigrams_are_not_shuffled(spark):
    """Pages are dealt once, by tile; grouping and sorting their trigrams needs no other shuffle. Each trigram still has all its pages."""
    texts = [f"text {i} of {i % 7} words" for i in range(300)] + [None, "ab", ""]
    made = grepindex.build(page(spark, texts), tile=32)
    assert len(re.findall(r"Exchange \w*partitioning", made._jdf.queryExecution().executedPlan().toString())) == 1
    found = {}
    for r in made.collect():
        assert r.n == len(r.ids) and r.ids == sorted(r.ids)
        found.setdefault(r.gram, []).extend(r.ids)
    want = {}
    for i, t in enumerate(texts):
        for g in {t[k : k + 3] for k in range(len(t) - 2)} if t else ():
            want.setdefault(g, []).append(f"p{i:04d}")
    assert {g: sorted(ids) for g, ids in found.items()} == want
