import bisect
import hashlib
import re
from collections import defaultdict

import pytest

from treatlens.llm.token_alignment import align_tokens, alignment_summary

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DIGESTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def spans(pieces):
    out, at = [], 0
    for i, data in pieces:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


class Libraries:
    """Tokens with their bytes by the public libraries, letter tables spelled out."""

    def __init__(self):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def tokens(self, text):
        if not text:
            return [], []
        got = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.letters[c] for c in t)) for i, t in zip(got.ids, got.tokens)]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            byte = re.fullmatch("<0x(..)>", piece)
            b.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return [], []
        return spans(a), spans(b)


def overlaps(a, b):
    """Pairs of ids whose bytes overlap, token by token from the first that can."""
    ends, out = [v for _, _, v in b], []
    for x, s, e in a:
        j = bisect.bisect_right(ends, s)
        while j < len(b) and b[j][1] < e:
            out.append((x, b[j][0]))
            j += 1
    return out


def groups_of(a, b):
    both = [0, *sorted({e for _, _, e in a} & {e for _, _, e in b})]
    out = [([], []) for _ in both[1:]]
    for k, side in enumerate((a, b)):
        for i, s, _ in side:
            out[bisect.bisect_right(both, s) - 1][k].append(i)
    return out


def brute(docs):
    lib = Libraries()
    linked, pairs = {}, defaultdict(int)
    for i, text in docs:
        a, b = lib.tokens(text)
        links = overlaps(a, b)
        linked[i] = (a, b, links)
        for p in set(links):
            pairs[p] += 1
    best = defaultdict(int)
    for (x, _), n in pairs.items():
        best[x] = max(best[x], n)
    rows = []
    for i, (a, b, links) in linked.items():
        groups = groups_of(a, b)
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((
            i, len(a), len(b), len(groups), len(links), sum(pairs[p] == best[p[0]] for p in links),
            sum(pairs[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
        ))
    return sorted(rows)


def digests(frame):
    return sorted(tuple(r) for r in frame.select(*DIGESTS).collect())


TEXTS = [
    None, "", " ", "  two  spaces\n\n\ttabs ", "a▁b is spelled with its mark", "<|endoftext|> <s></s><unk> <0x41>", "\x00\x7f",
    "größe naïve 日本語 😀👍🏽 ﬁ", "word", "word", "word word word", "1234567890 3.14 can't we'll", "é‍ 　x",
]


def test_special_texts_equal_brute_force(spark, docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, "long text, repeated: " * 3000)]
    small = [(i, t) for i, t in rows if i < 100]
    assert digests(alignment_summary(docs(small), A, B)[0]) == brute(small)
    got = {r.doc_id: r for r in alignment_summary(docs(rows, ["code", "chunk", "ids"]).repartition(3), A, B)[0].collect()}
    assert got[4].n_a == 0 and got[4].groups_sha256 == "" and got[100].n_groups > 3000


def test_real_outputs(spark, docs):
    lib = Libraries()
    for r in align_tokens(docs([(i, t) for i, t in enumerate(TEXTS)]), A, B).collect():
        a, b = lib.tokens(TEXTS[r.doc_id])
        assert (r.a_ids, r.a_ends) == ([x[0] for x in a], [x[2] for x in a])
        assert (r.b_ids, r.b_ends) == ([x[0] for x in b], [x[2] for x in b])
        want = [(i, j) for i, (_, s, e) in enumerate(a) for j, (_, u, v) in enumerate(b) if s < v and u < e]
        assert [tuple(x) for x in r.links] == want
        assert list(zip(r.a_in_group, r.b_in_group)) == [(len(x), len(y)) for x, y in groups_of(a, b)]


def test_pairs_count_documents(spark, docs):
    _, pairs = alignment_summary(docs([(1, "word word"), (2, "word"), (None, "word"), (2, "word")]), A, B)
    rows = pairs.collect()
    assert [(r.n_docs, r.best) for r in rows] == [(4, True)]


def test_empty_table(spark, empty_docs):
    rows, pairs = alignment_summary(empty_docs, A, B)
    assert rows.collect() == [] and pairs.collect() == [] and align_tokens(empty_docs, A, B).collect() == []
