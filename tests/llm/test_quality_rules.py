import re
from collections import Counter

import numpy as np
import pandas as pd

from treatlens.llm.quality_rules import FEATURES, STATS, fit_rules, keep_good, learn_rules, text_statistics, with_statistics


def brute(text):
    text = text or ""
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^ \t\n\x0b\x0c\r]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = [
    None, "", " \t\n", "one", "a b", "a b c a b c d", "x x x x x", "same line\nsame line\n\n\nother\nsame line",
    "caf\u00e9 \u00a0non\u00a0breaking #*|<> & $%", "a\x0bb\x0cc\rd", "w " * 5000, "A b C " * 30 + "end",
]


def test_statistics_equal_brute_force(docs):
    got = with_statistics(docs(list(enumerate(TEXTS)), extra=["n_words", "kept"])).collect()
    assert len(got) == len(TEXTS)
    for row in got:
        assert tuple(row[f"_q_{s}"] for s in STATS[:5]) == brute(TEXTS[row.doc_id])
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = " ".join(rng.choice(list("abc"), rng.integers(0, 40)))
        assert text_statistics(text)[:5] == brute(text)


def frame(n, seed=0):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({f: rng.random(n) for f in FEATURES})
    bad = (x["symbols_per_word"] > 0.8) | ((x["upper_share"] > 0.7) & (x["repeat_share"] <= 0.3))
    return x, bad.to_numpy()


def test_rules_recover_a_decision_list_on_held_out_rows():
    x, bad = frame(4000)
    rules = learn_rules(x, bad)
    assert 1 < len(rules.rules) <= 12
    y, truth = frame(2000, 9)
    found = rules.rejects(y)
    assert (found & truth).sum() / truth.sum() > 0.9
    assert (found & ~truth).sum() / (~truth).sum() < 0.02
    assert "reject if" in str(rules)


def test_rules_without_rows_or_with_one_class_reject_nothing(spark, empty_docs):
    x, _ = frame(50)
    assert learn_rules(x, np.zeros(50, bool)).rules == ()
    assert learn_rules(x.iloc[:0], np.zeros(0, bool)).rules == ()
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_rules(with_statistics(empty_docs), labels).rules == ()
    assert keep_good(empty_docs, labels).columns == empty_docs.columns


def test_keep_good_drops_base_failures_and_learned_junk(spark, docs):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    good = [" ".join(word() for _ in range(80)) for _ in range(120)]
    junk = [" ".join(word() + "###" for _ in range(80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + junk)] + [(500, "too short"), (501, None), (502, "x y z " * 40)]
    frame_ = docs(rows, extra=["quality", "_q_n_words", "_label"])
    labels = spark.createDataFrame(
        [(i, int(i < 120)) for i in range(0, 180) if i % 3] + [(1, None), (4, 1), (4, 1)], "doc_id long, quality int"
    )
    kept = keep_good(frame_, labels)
    assert kept.columns == frame_.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(120))
