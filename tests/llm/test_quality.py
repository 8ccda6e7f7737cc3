import random

import pytest

from capweave.llm import quality as Q
from tests.llm.helpers import docs, sentence, with_odd_columns, words_of


def plain(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return (
        len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(lines),
        sum("A" <= c <= "Z" for c in text), text.count("!"),
    )


TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "x\nx\nx y\n\nx", "é日本 ß!! #|", "a a a a a a", "UP DOWN!!", "t\r\nt\r\n", "end\n",
    *["\n".join(sentence(random.Random(k), 9, 12) for _ in range(12)) for k in range(6)],
]


def test_measures_equal_plain_ones(spark):
    frame = with_odd_columns(docs(spark, [*enumerate(TEXTS), (3, TEXTS[3]), (None, "x")]))
    rows = Q.verdicts(Q.ledger(frame)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "x" if r.doc_id is None else TEXTS[r.doc_id]
        assert tuple(r[m] for m in Q.MEASURES) == plain(text)
        n, again = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * again > 50 * n)
        assert not (r.kept and r.base_failed)
    assert Q.ledger(frame.limit(0)).count() == 0


def test_policies_and_ablations_read_bits_only(spark):
    rows = [(f, 2**i) for i, f in enumerate("abcdefgh")] + [("none", 0), ("two", 3), ("more", 4 | 8)]
    ledger = spark.createDataFrame(rows, "name string, failed long")
    for version, mask in Q.POLICIES.items():
        kept = {r.name for r in Q.verdicts(ledger, version).filter("kept").collect()}
        assert kept == {name for name, bits in rows if not bits & (mask | Q.BASE)}
        for r in Q.ablations(ledger, version).collect():
            bit = Q.BIT[r.rule]
            assert r.n_fail == sum(bool(b & bit) for _, b in rows)
            assert r.n_alone == sum(b & (mask | Q.BASE) == bit for _, b in rows)
            assert r.kept_without == sum(not b & (mask | Q.BASE) & ~bit for _, b in rows)


@pytest.mark.parametrize("text,rule", [("| " * 80, "symbols"), ("WORD!! " * 60, "exclaims"), ("SHOUT AND MORE " * 30, "capitals")])
def test_rules_catch_what_they_name(spark, text, rule):
    row = Q.ledger(docs(spark, [(1, text)])).first()
    assert row.failed & Q.BIT[rule]
