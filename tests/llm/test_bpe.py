import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from capweave.llm import bpe
from tests.llm.helpers import docs, with_odd_columns

SAMPLES = [
    None, "", " ", "\n\n", "a", "I'll say it's 'sam's' we'd", "naïve Straße 日本語 \U0001F600\U0001F600", "<|endoftext|>", "x" * 3000,
    "tabs\t\tand  two blanks\r\n 12345 ½ ²", "'", "''s", " 's", " nb wide", "\x00\x01\x7f", "ñandú " * 2000,
]


@pytest.fixture(scope="module")
def plain():
    with open(bpe.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_are_those_of_the_pattern():
    draw, pattern = random.Random(1), regex.compile(public_tokenizers.PATTERN)
    letters = "ab'sstmdrevll  \n\n\t.,!12é ß中²'  \r<|>\U0001F642  "
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(50))) for _ in range(4000)]
    for at, n, points, start, end, first in bpe.text_words(pa.array(texts)):
        words = ["".join(map(chr, points[a:b])) for a, b in zip(start, end)]
        for i in range(n):
            assert words[first[i] : first[i + 1]] == pattern.findall(texts[at + i])


@pytest.mark.parametrize("common", [0, 5, 1 << 20])
def test_ids_are_those_of_the_library(spark, plain, common):
    """Wherever the bound of the common words falls."""
    frame = with_odd_columns(docs(spark, [*enumerate(SAMPLES), (3, SAMPLES[3]), (None, "no id")]))
    known = bpe.dictionary(frame, common=common)
    out = bpe.decode(bpe.encode(frame, known=known))
    assert sorted(out.columns) == sorted(frame.columns)
    rows = out.select("text", "ids", "decoded").collect()
    assert len(rows) == len(SAMPLES) + 2
    for r in rows:
        ids = plain.encode_ordinary(r.text or "")
        assert r.ids == ids and bytes(r.decoded) == (r.text or "").encode()
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert bpe.ids_sha256(pa.array([ids, []], pa.list_(pa.int32()))).to_pylist() == [sha, hashlib.sha256(b"").hexdigest()]


def test_the_table_of_common_words_is_gathered_in_parts(spark, plain, monkeypatch):
    """The driver never has all common words at once, and every part is found again."""
    gathered = []
    monkeypatch.setattr(bpe, "PART_WORDS", 16, raising=False)
    real = type(spark.range(0)).toArrow

    def to_arrow(self):
        gathered.append(real(self))
        return gathered[-1]

    monkeypatch.setattr(type(spark.range(0)), "toArrow", to_arrow)
    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randrange(300)}" for _ in range(200)) for _ in range(20)]
    frame = docs(spark, [*enumerate(texts), *enumerate(SAMPLES)])
    known = bpe.dictionary(frame)
    total = sum(t.num_rows for t in gathered)
    assert total > 300 and max(t.num_rows for t in gathered) < total / 4
    for r in bpe.encode(frame, known=known).select("text", "ids").collect():
        assert r.ids == plain.encode_ordinary(r.text or "")


def test_empty_table_and_unknown_ids(spark):
    frame = docs(spark, [(1, "x")])
    assert bpe.encode(frame.limit(0)).count() == 0
    ids = spark.createDataFrame([([64, 99_999_999, -1, None],), (None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(ids).collect()] == [bpe_piece(64), b"", b""]


def bpe_piece(rank):
    return next(piece for piece, r in bpe.read_ranks().items() if r == rank)


def test_plans_hold_neither_the_rank_map_nor_a_row_with_it(spark):
    """The driver keeps the description of every plan; with the map as a literal one had millions of characters."""
    made = bpe.encode(docs(spark, [*enumerate(SAMPLES)]), known=bpe.Dictionary([]))
    plan = made._jdf.queryExecution().toString()
    assert len(plan) < 200_000
    assert "transform(array(Subquery" in plan[plan.index("Physical Plan") :] or "transform(array(scalar-subquery" in plan


def test_words_that_occur_once_are_left_to_their_text(spark, plain):
    frame = docs(spark, [(1, "once upon a time"), (2, " upon a midnight dreary"), (3, "Straße Straße")])
    known = bpe.dictionary(frame)
    assert sum(len(part.value.hashes) for part in known.parts) == 2  # " upon" and " a"
    for r in bpe.encode(frame, known=known).select("text", "ids").collect():
        assert r.ids == plain.encode_ordinary(r.text)


def test_the_leftmost_of_pairs_with_one_rank_goes_first(spark, plain):
    draw = random.Random(5)
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(2, 40))) for letters in ("ab", "a", "sest", "日本", "é!=") for _ in range(60)]
    frame = docs(spark, list(enumerate(texts)))
    for r in bpe.encode(frame, known=bpe.Dictionary([])).select("text", "ids").collect():
        assert r.ids == plain.encode_ordinary(r.text)
