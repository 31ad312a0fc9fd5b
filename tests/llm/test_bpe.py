import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from treatlens.llm.bpe import ByteBpe, decode, digests, encode  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    with open(PATH, encoding="utf-8") as f:
        return ByteBpe(f.read()), tokenizers.Tokenizer.from_file(PATH)


def test_equals_the_library_on_random_texts(pair):
    mine, theirs = pair
    rng = random.Random(3)
    letters = [*"abcdefgh THE the 0123'sll!#%<\n\t\r\x0b\x0c\x1c\x1f\x85\x00", "<|endoftext|>", "ing", " ", "\u3000", "\U0001f600"]
    letters += [chr(i) for i in range(0x2500)]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, mine.encode(texts)):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert mine.decode(ids) == theirs.decode(want, skip_special_tokens=False)


def test_failing_words_are_merged_exactly(pair):
    mine, theirs = pair
    rng = random.Random(4)
    words = list({"".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 24))) for _ in range(5000)})
    want = [theirs.encode(w, add_special_tokens=False).ids for w in words]
    assert [list(x) for x in mine.encode_words(words)] == want
    assert [mine.merge(w.encode()) for w in words[:500]] == want[:500]
    proposals = [mine.propose(w.encode()) for w in words]
    assert 0 < sum(p != w for p, w in zip(proposals, want)) < len(words)  # speculation helps, and is checked
    long = "ab" * 3000 + "c" * 999
    assert mine.merge(long.encode()) == theirs.encode(long, add_special_tokens=False).ids


def test_decode_of_any_ids(pair):
    mine, theirs = pair
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_tables(spark, docs, empty_docs):
    rows = [(1, "Hello world, it's 2024."), (2, None), (3, ""), (4, "x" * 200_000), (5, "a b"), (5, "a b"), (None, "<|endoftext|>")]
    frame = docs(rows, extra=["ids"])
    ids = encode(frame, PATH)
    back = {(r.doc_id, r.text) for r in decode(ids, PATH).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert digests(frame, PATH).count() == len(rows)
    assert digests(empty_docs, PATH).count() == 0
