"""Queries and pipeline over the smallest test tables, against SQL or brute force."""

import glob
import hashlib
import os
from collections import defaultdict
from html.parser import HTMLParser

import duckdb
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from treatlens.llm.catalogue import ORACLES, QUERIES
from treatlens.llm.mixing import OTHER
from treatlens.llm.quality_rules import FEATURES, STATS, fit_rules, text_statistics, with_statistics
from treatlens.llm.queries_mix import ROUNDS, TARGETS

from . import test_minhash, test_phrase_dedup, test_quality_rules, test_token_alignment

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, FOLDER)
    rows = frame.collect()
    if name in ORACLES:
        cur = db.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(frame.columns)
        flat = lambda rs, ns: sorted(repr(tuple(r[ns.index(c)] for c in sorted(ns))) for r in rs)
        assert flat([tuple(r) for r in rows], frame.columns) == flat(cur.fetchall(), names)
    else:
        source = "pages" if "page_id" in frame.columns else "documents"
        assert len(rows) == db.sql(f"SELECT count(*) FROM {source}").fetchall()[0][0]


# --- brute force, for what SQL cannot express ------------------------------


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def simhash(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = words_of(text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(docs):
    """doc_id -> (fingerprint, smallest reachable doc_id) of (doc_id, text) rows."""
    fps = {i: simhash(t) for i, t in docs}
    label, moved = {i: i for i in fps}, True
    near = {i: [j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4] for i in fps}
    while moved:
        new = {i: min(label[j] for j in near[i]) for i in fps}
        moved, label = new != label, new
    return {i: (fps[i], label[i]) for i in fps}


def kept_text(text, docs, own):
    """What is left of a text: no byte in a 50-byte string that an earlier document holds."""
    data, covered = text.encode(), set()
    for k in range(len(data) - 49):
        if docs[data[k : k + 50]] < own:
            covered.update(range(k, k + 50))
    return bytes(b for k, b in enumerate(data) if k not in covered).decode("utf-8", "ignore")


def shortened(docs):
    first = {}
    for i, t in docs:
        data = (t or "").encode()
        for k in range(len(data) - 49):
            first[data[k : k + 50]] = min(first.get(data[k : k + 50], i), i)
    return [(i, t if t is None else kept_text(t, first, i)) for i, t in docs]


def sampled(docs, rate):
    """The (doc_id, source, lang, text) rows that raking in floats, the asked share and the id's hash keep."""
    cells = defaultdict(float)
    keys = []
    for _, source, lang, text in docs:
        topic = "contact" if "@" in (text or "") else "numeric" if any("0" <= c <= "9" for c in text or "") else "prose"
        named = zip(("source", "lang", "topic"), (source, lang, topic))
        keys.append(tuple(v if v in TARGETS[axis] else OTHER for axis, v in named))
        cells[keys[-1]] += len(words_of(text or ""))
    start = {k: v for k, v in cells.items() if v}
    w = dict(start)
    for _ in range(ROUNDS):
        for a, axis in enumerate(TARGETS):
            shares = {**TARGETS[axis], OTHER: max(0.0, 1 - sum(TARGETS[axis].values()))}
            sums = defaultdict(float)
            for k, v in w.items():
                sums[k[a]] += v
            w = {k: v * shares[k[a]] / sums[k[a]] if sums[k[a]] else 0.0 for k, v in w.items()}
    wanted = {k: w[k] / sum(w.values()) * sum(start.values()) * rate for k in w}
    chance = {k: min(1.0, wanted[k] / start[k]) for k in w}
    u = [int(hashlib.md5(str(d[0]).encode()).hexdigest()[:13], 16) / 2**52 for d in docs]
    return [d for d, k, x in zip(docs, keys, u) if x < chance.get(k, 0.0)]


def encoded(docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    out = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text))))
    return sorted(out)


def rules_of(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    return fit_rules(with_statistics(docs.select("doc_id", "text")).drop("text"), labels)


def verdicts(rules, docs):
    """doc_id -> (base_failed, kept); the learned list is applied to plain numbers."""
    out = {}
    for i, text in docs:
        n, *_, repeats = test_quality_rules.brute(text)
        stats = dict(zip(STATS, text_statistics(text)))
        x = pd.DataFrame([{f: stats[a] / max(1, stats[b]) for f, (a, b) in FEATURES.items()}])
        failed = n < 50 or 100 * repeats > 50 * n
        out[i] = (failed, not failed and not bool(rules.rejects(x)[0]))
    return out


class Article(HTMLParser):
    """Blocks of the article of a page whose elements are well nested but for ``p``."""

    INLINE = {"a", "b", "i", "em", "strong", "span", "br", "code", "sup", "sub", "img"}
    SKIP = {"aside", "form", "script", "style", "nav", "footer", "button", "select", "textarea"}

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks, self.text = 0, [], [], ""
        self.feed(source)
        self.close()

    def end(self):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append(text)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        labels = set((dict(attrs).get("class") or "").replace("-", " ").split())
        if tag in self.INLINE:
            self.text += " " if tag == "br" else ""
            return
        self.end()
        self.inside |= tag == "article"
        if self.skip:
            self.skip += [tag] if tag == self.skip[0] else []
        elif tag in self.SKIP or labels & {"ad", "comments", "comment", "sidebar", "cookie", "share", "related", "notice"}:
            self.skip = [tag]

    def handle_endtag(self, tag):
        if tag in self.INLINE:
            return
        self.end()
        if self.skip and tag == self.skip[0]:
            self.skip.pop()
        if tag == "article":
            self.inside = 0

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.text += data


@pytest.fixture(scope="module")
def texts(db):
    return db.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_quality_rules_equal_brute_force(spark, texts):
    want = verdicts(rules_of(spark, spark.read.parquet(f"{FOLDER}/documents.parquet")), texts)
    text = dict(texts)
    for r in QUERIES["op1_quality_rules"](spark, FOLDER).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == test_quality_rules.brute(text[r.doc_id]) and (r.base_failed, r.kept) == want[r.doc_id]


def test_html_extraction_equals_a_plain_parser(spark, db):
    want = {i: "\n\n".join(Article(h or "").blocks) for i, h in db.sql("SELECT page_id, html FROM pages").fetchall()}
    got = {r.page_id: r.text for r in QUERIES["op2_html_extraction"](spark, FOLDER).collect()}
    assert got == want


def test_suffix_dedup_equals_brute_force(spark, texts):
    got = QUERIES["op5_suffix_dedup"](spark, FOLDER).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == test_phrase_dedup.brute(texts)


def test_bpe_equals_the_library(spark, texts):
    got = QUERIES["op6_bpe"](spark, FOLDER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == encoded(texts)


def test_minhash_equals_brute_force(spark, texts):
    got = QUERIES["op12_minhash"](spark, FOLDER).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == test_minhash.brute(texts)


def test_token_alignment_equals_brute_force(spark, texts):
    got = QUERIES["op11_token_alignment"](spark, FOLDER)
    assert test_token_alignment.digests(got) == test_token_alignment.brute(texts)


def test_simhash_equals_brute_force(spark, texts):
    want = {i: (f"{fp:016x}", c) for i, (fp, c) in groups(texts).items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, FOLDER).collect()}
    assert got == want


def test_pipeline_equals_brute_force(spark, db):
    docs = db.sql("SELECT doc_id, source, lang, text FROM documents").fetchall()
    good = verdicts(rules_of(spark, spark.read.parquet(f"{FOLDER}/documents.parquet")), [(d[0], d[3]) for d in docs])
    docs = [d for d in docs if good[d[0]][1]]
    stays = {i for i, _, _, kept in test_minhash.brute([(d[0], d[3]) for d in docs], 80) if kept}
    docs = [d for d in docs if d[0] in stays]
    text = dict(shortened([(d[0], d[3]) for d in docs]))
    docs = sampled([(i, source, lang, text[i]) for i, source, lang, _ in docs], corpus_pipeline.RATE)
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert docs and sorted(map(tuple, got.collect())) == encoded([(d[0], d[3]) for d in docs])


def test_stages_return_the_columns_they_got(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name in ("topic", "_tokens", "_sampled", "_row", "fp", "_q_n_words", "_kept"):
        docs = docs.selectExpr("*", f"doc_id AS {name}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.filter("topic <> doc_id OR _row <> doc_id").isEmpty() and not out.isEmpty()
    assert not corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).isEmpty()
