import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from treatlens.llm.prefix_trie import prefix_trie, sequences
from treatlens.llm.queries_trie import grafted

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """conv_id -> list of (role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out[conv].append(((turn is not None, turn or 0), role, key, text))
    return {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in out.items()}


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    rows = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        parents = {n[:-1] for n in members if n}
        text = ",".join(map(str, sorted(ends.get(node, []))))
        rows.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own),
            sum(len(n) == len(node) + 1 for n in below), sum(n not in parents for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(text.encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def graft(convs, family=5, head=9):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % head
        out[c] = convs.get(c - c % family, [])[:h] + own[h:]
    return out


def got(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=repr)


def random_turns(seed, n):
    rng = random.Random(seed)
    texts = ["", "ja", "nein", "größe", "long " * 40]
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c if rng.random() < 0.97 else c + 1000, t, rng.choice(["user", "user", "bot"]), rng.choice(texts[:3] if t else texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = random_turns(seed, 40)
    own = sequences(spark.createDataFrame(rows, TURNS))
    assert got(prefix_trie(own)) == brute(ordered(rows))
    assert got(prefix_trie(grafted(own))) == brute(graft(ordered(rows)))


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [
        (7, None, None, None), (7, 1, "user", "x" * 200_000), (7, 1, "user", "x" * 200_000), (7, 1, "bot", "b"),
        (3, None, "", ""), (3, 2, "user", "x" * 200_000), (None, 1, "user", "lost"), (3, 3, "user:", "a"), (7, 3, "user", ":a"),
    ]
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "turn AS depth", "text AS path", "conv_id AS turns")
    assert got(prefix_trie(sequences(frame))) == brute(ordered(rows))


def test_copies_and_one_long_conversation(spark):
    """Forty copies are one way; a long unshared tail is peeled in one step."""
    rows = [(c, t, "user", f"same {t}") for c in range(40) for t in range(6)]
    rows += [(90, t, "user", f"same {t}" if t < 3 else f"own {t}") for t in range(120)]
    assert got(prefix_trie(sequences(spark.createDataFrame(rows, TURNS)))) == brute(ordered(rows))


def test_conversations_left_without_turns_are_members_of_the_root(spark):
    rows = [(c, 0, "user", f"hello {c % 3}") for c in (1, 2, 3, 4, 6, 8, 9)]  # no family has its first conversation
    convs = graft(ordered(rows))
    assert [] in convs.values()
    assert got(prefix_trie(grafted(sequences(spark.createDataFrame(rows, TURNS))))) == brute(convs)


def test_empty_table(spark):
    assert prefix_trie(grafted(sequences(spark.createDataFrame([], TURNS)))).collect() == []
