import random

from capweave.llm import line_dedup as L
from tests.llm.helpers import docs, sentence, with_odd_columns


def cut(spark, rows):
    return {r.doc_id: r.text for r in L.dedup_lines(docs(spark, rows)).collect()}


def test_a_passage_goes_from_later_documents_only(spark):
    draw = random.Random(1)
    passage = sentence(draw, 60)
    rows = [(i, f"{sentence(draw, 9)}\n{passage}\n{sentence(draw, 8)}") for i in range(5)]
    got = cut(spark, rows)
    assert got[0] == rows[0][1]
    assert all(got[i] == rows[i][1].replace(f"{passage}\n", "") for i in range(1, 5))


def test_runs_of_short_lines_are_extended_both_ways(spark):
    draw = random.Random(2)
    run = "\n".join(sentence(draw, 7) for _ in range(12))
    rows = [(i, f"{sentence(draw, 5)}\n{run}\n{sentence(draw, 6)}") for i in range(3)]
    got = cut(spark, rows)
    for i in (1, 2):
        assert got[i] == rows[i][1].replace(f"{run}\n", "")


def test_every_run_of_fifty_words_is_found_and_short_ones_stay(spark):
    draw = random.Random(3)
    lines = [sentence(draw, draw.randrange(1, 30)) for _ in range(300)]
    rows = [(0, "\n".join(lines))]
    for i in range(1, 40):
        begin = draw.randrange(0, 290)
        own = [sentence(draw, 10) for _ in range(3)]
        rows.append((i, "\n".join([own[0], *lines[begin : begin + draw.randrange(1, 8)], own[1], own[2]])))
    got = cut(spark, rows)
    for i, text in rows[1:]:
        run = text.split("\n")[1:-2]
        n = sum(len(x.split()) for x in run)
        left = (got[i] or "").split("\n")
        if n >= L.GRAM_WORDS + L.WINDOW_WORDS:
            assert not set(run) & set(left), i
        elif n < L.GRAM_WORDS:
            assert got[i] == text, i
        assert {text.split("\n")[0], *text.split("\n")[-2:]} <= set(left)


def test_a_run_that_repeats_inside_one_document(spark):
    passage = sentence(random.Random(4), 55)
    assert cut(spark, [(1, f"a b\n{passage}\nc d\n{passage}\ne")]) == {1: f"a b\n{passage}\nc d\ne"}


def test_odd_rows(spark):
    passage = sentence(random.Random(5), 70)
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (4, passage), (4, passage), (5, passage), (None, passage), (6, passage + "\n" + passage)]
    frame = with_odd_columns(docs(spark, rows))
    out = L.dedup_lines(frame)
    assert set(frame.columns) < set(out.columns)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out.select("doc_id", "text").na.fill("<null>", ["text"]).collect())
    # A null id comes first, so its passage stays; the repeated row is one document.
    assert got == [(False, 1, "<null>"), (False, 2, ""), (False, 3, "\n\n \n"), (False, 4, ""), (False, 4, ""), (False, 5, ""), (False, 6, ""), (True, 0, passage)]
    assert L.dedup_lines(frame.limit(0)).count() == 0
