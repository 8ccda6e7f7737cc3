import random
import re

from pyspark.sql import functions as F

from capweave.llm import pii as P
from tests.llm.helpers import docs, sentence, with_odd_columns

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    text = text or ""
    spans = [(m.start(), k, m.end(), kind) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text) if passes(kind, m.group())]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans))


def base(df):
    return df.select("doc_id", P.named_spans(False).alias("base"), P.named_spans(True).alias("every"), *[P.how_many(k).alias(k) for k in P.KINDS])


def test_base_spans_equal_the_patterns(spark):
    draw = random.Random(1)
    pieces = [
        "a@b.co", "é.x@y-z.org.", "10.0.0.1", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-5678",
        "+1 2", "5500005555555559", " ", "\n", "x", "12", "日本", "@", ".", "+", "-", "0", "user%1@host", "00000000000000", "+123456789012345678",
    ]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(12))) for _ in range(1500)]
    rows = [*enumerate(texts), (5, texts[5]), (None, "a@b.co"), (9001, None), (9002, "z" * 100_000 + " a@b.co")]
    frame = with_odd_columns(docs(spark, rows))
    got = base(P.find(frame)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        assert r.base == plain(text), text
        assert sum(r[k] for k in P.KINDS) == (r.base.count(":") // 2)
    assert P.find(frame.limit(0)).count() == 0


def test_a_term_that_gives_an_entity_away_is_found_and_replaced(spark):
    draw = random.Random(2)
    rows = [(i, sentence(draw, 40)) for i in range(200)]
    rows += [(500 + i, f"{sentence(draw, 5)} Zanzibarist writes as zed@mail.test today {sentence(draw, 5)}") for i in range(5)]
    frame = docs(spark, rows)
    got = {r.doc_id: r for r in base(P.find(frame)).collect()}
    for i in range(500, 505):
        text = dict(rows)[i]
        spans = [x.split(":") for x in got[i].every.split(",")]
        assert {text[int(s) : int(e)] for k, s, e in spans if k == "term"} == {"Zanzibarist", "writes", "as", "today"}
    clean = {r.doc_id: r.text for r in P.sanitised(frame).collect()}
    assert all(" [TERM] [TERM] [TERM] [EMAIL] [TERM] " in clean[i] for i in range(500, 505)) and clean[3] == rows[3][1]
    gone = {r.doc_id: r.text for r in P.sanitised(frame, remove_terms=True).filter(F.col("doc_id") == 500).collect()}
    assert "Zanzibarist" not in gone[500] and "[EMAIL]" in gone[500]
    # Too few documents say nothing about a term.
    few = {r.doc_id: r.every for r in base(P.find(frame.filter("doc_id <> 504 AND doc_id <> 503 AND doc_id <> 502"))).collect()}
    assert "term" not in few[500]


def terms_of(r, text):
    return [text[int(s) : int(e)] for k, s, e in (x.split(":") for x in r.every.split(",")) if k == "term"]


def test_terms_are_found_in_the_whole_document_in_pairs_and_for_domains(spark):
    draw = random.Random(3)
    rows = [(i, sentence(draw, 20)) for i in range(20_000)]
    rows += [(30_000 + i, f"Zanzibarist writes as zed@mail.test\n{sentence(draw, 5)}\nsaid Zanzibarist") for i in range(2)]
    rows += [(40_000 + i, f"{sentence(draw, 3)} Quorvex u{i}@quorvex.test") for i in range(4)]
    got = {r.doc_id: r for r in base(P.find(docs(spark, rows))).filter("doc_id >= 30000").collect()}
    text = dict(rows)
    assert all(terms_of(got[i], text[i]).count("Zanzibarist") == 2 for i in (30_000, 30_001))
    assert all(terms_of(got[i], text[i]) == ["Quorvex"] for i in range(40_000, 40_004))
