import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dossier.llm import hosts, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measure(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(lines)


def rate(counts):
    """Shrunk rates of (documents, failures) by host: moments as weighted sums over hosts."""
    n, f = sum(a for a, _ in counts), sum(b for _, b in counts)
    p = f / n
    if p in (0, 1):
        return [p] * len(counts)
    spread = sum(a * (b / a - p) ** 2 for a, b in counts)
    chance, room = sum(1 - a / n for a, _ in counts), sum(a * (1 - a / n) for a, _ in counts)
    share = (spread - p * (1 - p) * chance) / (p * (1 - p) * (room - chance)) if room > chance else 0
    strength = hosts.STRONGEST if share <= 0 else min(hosts.STRONGEST, max(hosts.WEAKEST, 1 / share - 1))
    return [(strength * p + b) / (strength + a) for a, b in counts]


def test_measures_equal_a_loop(spark, odd, documents):
    for df in (odd, documents):
        got = Counter((r.id, *(r[m] for m in hosts.MEASURES)) for r in hosts.measured(df).collect())
        assert got == Counter((r.doc_id, *measure(r.text)) for r in df.collect())


def test_repeats_touch_and_overlap():
    texts = ["a a a a a a", "a b c d e a b c d e", "a b c d e b c d e", "a a a a a", "", "x y z w v . x y z w v x y z w v", "é é é é é  é é é é é"]
    got = hosts.repeated_words([t.encode().split() for t in texts]).tolist()
    assert got == [measure(t)[4] for t in texts] and hosts.repeated_words([[b"a"]]).tolist() == [0]


def test_hosts_are_shrunk(spark):
    """A host of failures fails and takes its good documents along; one bad document doesn't make a host fail; rates equal the loop's."""
    good, bad = " ".join(f"word{k}" for k in range(30)), "few words"
    rows = [(i, "bad.example", bad if i % 10 else good) for i in range(300)]
    rows += [(1000 + 100 * h + i, f"h{h}.example", bad if i == 0 else good) for h in range(20) for i in range(40 + h)]
    rows += [(9000, "one.example", bad), (9001, None, good), (9002, None, bad)]
    df = spark.createDataFrame([(i, s, t.replace("word", f"w{i}x")) for i, s, t in rows], "doc_id long, source string, text string").repartition(5)
    got = {r.doc_id: r for r in hosts.judge(df).collect()}
    assert len(got) == len(rows)
    failed = {r.host for r in got.values() if r.host_failed}
    assert failed == {"bad.example"}
    assert not got[0].base_failed and not got[0].kept and got[1001].kept and not got[1000].kept and not got[9000].kept and got[9001].kept
    table = hosts.verdicts(hosts.measured(df)).collect()
    want = rate([(r.documents, r.few_words) for r in table])
    assert [r.rates["few_words"] for r in table] == pytest.approx(want, rel=1e-6)
    by = {r.host: r.rates["few_words"] for r in table}
    assert by["one.example"] < 0.5 and by["bad.example"] > 0.85


def test_prior():
    assert hosts.prior(0, 0, 0, 0, 0).mean == 0 and hosts.prior(10, 10, 100, 10, 1) == hosts.Prior(1.0, hosts.STRONGEST)
    # hosts alike: as strong as can be; hosts all or nothing: as weak as can be
    assert hosts.prior(400, 200, 4 * 100**2, 4 * 50 * 50 / 100, 4).strength == hosts.STRONGEST
    assert hosts.prior(400, 200, 4 * 100**2, 2 * 100 * 100 / 100, 4).strength == hosts.WEAKEST


def test_host_of(spark):
    urls = ["https://www.Example.org:8080/a?b", "http://user@sub.example.org", "HTTP://[::1]:80/x", "src0", None, "", "ftp://x#y"]
    got = [r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select(hosts.host_of(F.col("u")).alias("h")).collect()]
    assert got == ["example.org", "sub.example.org", "[::1]", "src0", None, "", "x"]


def test_edges(spark, odd, empty):
    got = hosts.judge(odd).collect()
    assert len(got) == odd.count() and {r.host for r in got} == {"a", "b", "c", None}
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (2, 3, 5, 7))
    assert hosts.judge(empty).count() == 0
    by_url = hosts.judge(odd.withColumn("url", F.concat(F.lit("http://h"), "source", F.lit("/x"))), host=hosts.host_of(F.col("url"))).collect()
    assert {r.host for r in by_url} == {"ha", "hb", "hc", None}


def test_query_keeps_clean_documents(spark, sf):
    rows = queries.op12_host_rules(spark, sf).collect()
    passed = [r for r in rows if not r.base_failed]
    assert passed and sum(r.kept for r in passed) >= 0.95 * len(passed)
