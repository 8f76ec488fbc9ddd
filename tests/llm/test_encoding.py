import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm.encoding import encode_corpus, encoder, join_all, put_together, seam, tokenizer_dir

PATH = f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"
PARTS = ["the ", "lo", "l", "'s", "'", "  ", " ", "\n\n", "!!", "aaaa", "é", "ß", "日本", "1234", "😀", "x" * 90, " " * 70, "ab" * 60, "=-" * 50, "\t", "<|endoftext|>", "Ünï"]


def whole(text):
    return encoder(PATH).encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60), st.integers(1, 90))
def test_joined_ids_are_those_of_the_whole(parts, piece):
    text = "".join(parts)
    pieces = [text[i : i + piece] for i in range(0, len(text), piece)]
    assert join_all(encoder(PATH), [(p, whole(p)) for p in pieces]) == whole(text)


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=300), st.data())
def test_one_seam(text, data):
    at, enc = data.draw(st.integers(0, len(text))), encoder(PATH)
    a, b = whole(text[:at]), whole(text[at:])
    s = seam(enc, text[:at], a, text[at:], b, 4)
    assert s is None or a[: s[0]] + s[1] + b[s[2] :] == whole(text)


def test_seams_of_long_pieces_are_local():
    """Ordinary text needs no piece to be encoded again; a word longer than pieces makes one of them."""
    rng, enc = random.Random(2), encoder(PATH)
    words = " ".join("".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(1, 9))) for _ in range(4000))
    for text in (words, words[:3000] + "x" * 2500 + words[3000:6000] + "\n" * 3000 + words[:2000]):
        pieces = [text[i : i + 900] for i in range(0, len(text), 900)]
        ids = [whole(p) for p in pieces]
        seams = [seam(enc, p, x, q, y) for p, q, x, y in zip(pieces, pieces[1:], ids, ids[1:])]
        assert (None in seams) == (text is not words)
        assert put_together(enc, pieces, ids, seams) == whole(text)


def test_same_as_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenizer_dir()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = [None, "", " ", "Hello, world's end", "<|endoftext|> plain", "é ü ​�", "word " * 3000, "n" * 20000, "a b\n" * 4000, "a b\n" * 4000]
    rows = [(1 if i > 7 else i, x, "clash") for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_corpus(df, piece_chars=1000).collect())
    assert got == sorted((i, t.encode(x or "", add_special_tokens=False).ids) for i, x, _ in rows)
    assert encode_corpus(df.limit(0)).count() == 0
