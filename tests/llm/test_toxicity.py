import numpy as np

from treatlens.llm.toxicity import fit_chain, score, train

BAD = ["idiotic", "moronic", "vile"]


def made(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        text = [*rng.choice(words, 40)]
        if toxic:
            text[rng.integers(40)] = str(rng.choice(BAD)).upper() + "!"
        junk = i % 5 == 0
        rows.append((i, " ".join(w + "%%%" if junk else w for w in text)))
        labels.append((i, int(junk), int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, docs, empty_docs):
    rows, labels = made(900, 1)
    held = spark.createDataFrame([x for x in labels if x[0] < 600] + [(1, None, 1), (2, 0, 0)], "doc_id long, junk int, toxic int")
    frame = docs(rows + [(5000, None), (5001, ""), (5002, "vile " * 30_000), (None, "moronic")], extra=["p_toxic", "words"])
    chain = train(frame, held, ["junk", "toxic"])
    assert set(BAD) <= set(chain.vocabulary)
    got = {r.doc_id: r for r in score(frame, chain).collect()}
    assert len(got) == 904
    assert all(got[i].toxic == bool(t) and got[i].junk == bool(j) for i, j, t in labels if i >= 600)
    assert not got[5000].toxic and not got[5001].toxic
    assert score(empty_docs, chain).count() == 0


def test_later_models_use_earlier_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 6))
    first = (x[:, 0] + 0.3 * rng.normal(size=2000)) > 0
    second = first & (x[:, 1] > 0)
    chain = fit_chain(x, np.column_stack([first, second]), np.arange(2000) % 4, ["a", "b"], {})
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert chain.weights[1][6] > 0  # the earlier log-odds count
    assert ((chain.log_odds(x)[:, 1] > 0) == second).mean() > 0.85


def test_without_labels_all_is_even(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    frame = docs([(1, "a"), (2, None)])
    assert {r.p_toxic for r in score(frame, train(frame, labels, ["toxic"])).collect()} == {0.5}
