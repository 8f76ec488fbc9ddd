from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm.splitting import split_items, split_text, squeezed

WORDS = ["alpha", "be", "c. ", "D!", "\n\n", "\n", " ", "  ", "HEADING HERE\n", "\n\n\n", "x" * 90, "ß…", "\r\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=120), st.integers(21, 80), st.integers(0, 10))
def test_pieces_cover_the_text_within_the_limit(words, limit, overlap):
    text = " ".join(words)
    pieces = split_text(text, limit, overlap)
    assert "".join(text[a + o : b] for a, b, o, _ in pieces) == text
    for (a, b, o, _), before in zip(pieces, [None, *pieces]):
        assert b - a <= limit and o <= overlap
        assert before is None or a + o == before[1]
    assert (len(pieces) > 1) == (len(text) > limit)


def test_boundaries():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven twelve thirteen."
    first, second = split_text(text, 60, 10)
    assert text[first[0] : first[1]] == "One two three. Four five six.\n\n" or text[first[0] : first[1]].endswith("nine. ")
    assert text[second[0] : second[1]].endswith("thirteen.")


def test_items(spark):
    rows = [("a", "w " * 600, "k"), ("a", "w " * 600, "k"), ("b", None, "k"), ("c", "", "k"), ("d", " \t " * 2000 + "end", "k"), (None, "y" * 2000, "k"), ("e", "z" * 900, "k")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, piece string")
    got = split_items(df, "chunk_id", squeezed(F.col("text")), 900)
    assert {r.item_key for r in got.collect()} == {"a", None}
    assert got.where("item_key = 'a' and piece = 0").count() == 2
    assert got.where("length(piece_text) > 900").count() == 0
    assert split_items(df.limit(0), "chunk_id", F.col("text"), 900).count() == 0
