import random

from dossier.llm import suffixes
from dossier.llm.anchors import anchors

from .conftest import frame


def brute(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1])), kept)
    return out


def test_as_a_scan(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "ö", "x"]
    piece = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [piece(k) for k in (20, 25, 40, 80)]
    rows = [(i, "".join(rng.choice([piece(15), rng.choice(shared)]) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(200, "a" * 500), (201, "ab" * 300), (202, "a" * 99), (203, "a" * 100), (204, None), (205, "")]
    df = frame(spark, [(i, t, "en", "s", 1) for i, t in rows])
    for batches in (1, None, 7):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedupe(df, batches=batches).collect()}
        assert got == brute(rows, 100)


def test_edges(odd, empty):
    rows = suffixes.dedupe(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[6].n_removed == by[6].n_bytes and bytes(by[6].kept) == b"" and by[3].n_bytes == 0
    assert by[None].n_removed == 0
    assert suffixes.dedupe(empty).count() == 0
    twice = suffixes.dedupe(odd.where("doc_id = 1").union(odd.where("doc_id = 1"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_removed < twice[0].n_bytes


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    shared = bytes(rng.choice(b"abc ") for _ in range(100))
    for _ in range(20):
        places = []
        for _ in range(2):
            head = bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 50)))
            _, a, i, j = anchors(head + shared + head, 100)
            k = [n for n in range(len(a)) if i[n] <= len(head) <= j[n]][0]
            places.append(a[k] - len(head))
        assert places[0] == places[1]


def test_levels_as_a_binary_counter(spark):
    """Levels have 1, 2, 4 batches; those that are larger than the new one are scanned and stay."""
    df = spark.createDataFrame([(i, f"{i} " * 60 + "the same words again and again, " * (i % 3) * 5) for i in range(70)], "id long, text string")
    spans, _, family = suffixes.repeated_spans(df, 100, 7)
    assert family.log == [(0, 0), (1, 0), (0, 1), (2, 0), (0, 1), (1, 1), (0, 2)] and spans.count() > 0
    assert suffixes.batches_for(0) == suffixes.batches_for(1 << 30) == 4 and suffixes.batches_for(1 << 40) == 14


def test_windows_as_a_loop(spark):
    """Windows of contexts that start earlier too, whichever bucket and task they are in; the two hashes are independent."""
    data = b"abcabc" * 40
    assert len(set(suffixes.window_hashes(data, 100).tolist())) == len(set(suffixes.window_hashes(data, 100, 1).tolist())) == 3
    rows = [(i, f"{i:03}" * 40 + "a passage that all of them share, word for word, which is long enough to be found " * 2 + f"{i:03}" * 50) for i in range(6)]
    found = suffixes.contexts(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(i, (k << 12) | 50) for i in range(6) for k in range(0, 250, 51)], "doc long, place long"), 100)
    got = {(r.doc, a) for r in suffixes.repeated_windows(found, 100, 4).collect() for a in range(r.a, r.b - 99)}
    seen, want = set(), set()
    for i, text in rows:
        for k in range(250 + 50):
            w = text[k : k + 100]
            if len(w) == 100 and k <= 204 + 50:
                if w in seen:
                    want.add((i, k))
                seen.add(w)
    assert got == want
