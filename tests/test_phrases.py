import random
import re
import time

from prose_audit.functions.patterns import literal
from prose_audit.functions.phrases import DisjointSpans, PhraseIndex
from prose_audit.operators import metrics

SCHEMA = "doc_id long, text string"


def loop(phrases, text):
    """Each phrase by a regular expression of its own."""
    return [(i, *m.span()) for i, p in enumerate(phrases) if p for m in re.compile(literal(p), re.A | re.I).finditer(text)]


def test_equal_to_a_loop_over_patterns():
    rng = random.Random(5)
    for _ in range(400):
        letters = rng.choice(["ab ", "aB' ’", "aé_ -", "aA1. İ"])
        phrases = ["".join(rng.choices(letters, k=rng.randrange(0, 5))) for _ in range(12)]
        text = "".join(rng.choices(letters + "aZ😀", k=60))
        assert PhraseIndex(phrases).by_phrase(text) == loop(phrases, text)
    assert PhraseIndex([]).by_phrase("a") == PhraseIndex(["a"]).by_phrase("") == []


def test_ten_thousand_phrases():
    """As many hits as by the loop; the time doesn't depend on the number of phrases."""
    rng = random.Random(6)
    words = ["w%d" % i for i in range(3000)]
    phrases = list(dict.fromkeys(" ".join(rng.choices(words, k=rng.choice([1, 2, 3]))) for _ in range(10_000)))
    text = " ".join(rng.choices(words, k=3000))
    index = PhraseIndex(phrases)
    assert index.by_phrase(text) == loop(phrases, text)
    took = []
    for some in (phrases[:100], phrases):
        index, best = PhraseIndex(some), 1e9
        for _ in range(5):
            start = time.perf_counter()
            hits = sum(1 for _ in index.hits(text * 5))
            best = min(best, time.perf_counter() - start)
        took.append((best, hits))
    (small, few), (large, many) = took
    assert large - small < 2e-6 * (many - few) + 0.05  # what is left is the hits themselves


def test_disjoint_spans():
    rng = random.Random(7)
    for _ in range(300):
        spans, kept = DisjointSpans(), []
        for _ in range(30):
            a = rng.randrange(40)
            b = a + rng.randrange(1, 6)
            free = not any(x < b and a < y for x, y in kept)
            assert spans.add(a, b) == free
            kept += [(a, b)] * free
        assert list(zip(spans.starts, spans.ends)) == sorted(kept)


def test_phrase_hits(spark):
    rows = [(1, "Don’t stop. don't STOP"), (1, "Don’t stop. don't STOP"), (2, None), (3, ""), (None, "stop " * 20_000)]
    got = metrics.phrase_hits(spark.createDataFrame(rows, SCHEMA), ["don't stop", "stop"]).collect()
    assert sorted((r.phrase, r.start, r.end) for r in got if r.doc_id == 1) == sorted(2 * [("don't stop", 0, 10), ("don't stop", 12, 22), ("stop", 6, 10), ("stop", 18, 22)])
    assert sum(r.doc_id is None for r in got) == 20_000 and not [r for r in got if r.doc_id in (2, 3)]
    assert metrics.phrase_hits(spark.createDataFrame([], SCHEMA), ["a"]).collect() == []
