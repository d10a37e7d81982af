"""The queries of the text operators against DuckDB, brute force, exact round trips and held-out labels."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import common, near_dedup, queries, quality_gam, toxicity

SF, SF2, SF3 = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))


def texts(sf=SF):
    return dict(duckdb.execute(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.execute(queries.ORACLES[name])
    names = [c[0] for c in out.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(map(plain, r)) for r in out.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == want


def test_bpe_is_the_tokenizers_own(spark):
    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    docs = texts()
    for r in queries.op4_bpe(spark, SF).collect():
        ids = t.encode(docs.pop(r.doc_id), add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not docs


def test_fingerprints(spark):
    docs = texts()
    ids, rows = sorted(docs), {r.doc_id: r for r in queries.op7_fingerprints(spark, SF).collect()}
    assert sorted(rows) == ids
    by_text = {}
    for i, n in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, other, r = docs[i], docs[n], rows[i]
        k = len(text) // 2
        edited = text[: len(text) - k] + other[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        common_ = next((j for j, (a, b) in enumerate(zip(text, edited, strict=False)) if a != b), min(len(text), len(edited)))
        assert r.common_with_edited == common_
    assert len(set(by_text.values())) == len(by_text)


def test_license_base_and_containment(spark):
    from keyloom.llm import licenses

    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    docs = texts(SF2)
    for r in queries.op8_licenses(spark, SF2).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[r.doc_id]))
        at = [(i, lab) for p, lab in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        own = {lab for _, lab in at}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        more = set()
        for label, ts in licenses.TEMPLATES.items():  # every block of every template, without any filter
            for t in ts:
                tw = [w.decode() for w in licenses.words_of(t)]
                for k in range(0, len(words), len(tw)):
                    if len(set(tw) & set(words[k : k + 2 * len(tw)])) >= 0.8 * len(set(tw)) - 1e-9:
                        more.add(label)
        assert r.base_labels == ",".join(sorted(own)) and r.labels == ",".join(sorted(own | more)) and 0 <= r.score <= 1


def test_quality_rules_measures(spark):
    docs = texts(SF2)
    for r in queries.op9_quality_rules(spark, SF2).collect():
        text = docs[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        triples = list(zip(words, words[1:], words[2:], strict=False))
        seen, hit = {}, set()
        for i, t in enumerate(triples):
            seen.setdefault(t, []).append(i)
        for places in seen.values():
            if len(places) > 1:
                hit |= {i + j for i in places for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == base and not (base and r.kept)


def groups(docs, k, percent):
    """doc_id -> least id of its group, by comparing all pairs."""
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                top[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_dedup_is_brute_force(spark):
    want, sizes = groups(texts(SF2), 4, 80)
    got = queries.op10_near_dedup(spark, SF2).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_of_a_large_group_of_near_copies(spark):
    """Copies of one text, each edited in places of its own, among others just too far from all: the large nodes' way."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    docs = {}
    for i in range(160):
        w = list(base)
        for p in rng.choice(120, int(rng.integers(0, 6)) if i % 4 else 9, replace=False):
            w[p] = f"e{i}x{p}"
        docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want, _ = groups(docs, 4, 80)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 4, 80).collect()} == want


def test_near_dedup_recall_at_every_depth():
    """Miss of a pair of similarity 0.8, computed, and counted among pairs by the trees' own paths."""
    n, p = near_dedup.SIZE, 0.8
    chance = [math.comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(n + 1)]
    miss = {d: sum(c * (1 - math.comb(m, d) / math.comb(n, d)) ** trees for m, c in enumerate(chance)) for d, trees in near_dedup.LEVELS.items()}
    assert list(miss) == [near_dedup.FIRST, 6, near_dedup.LAST] and sum(miss.values()) + sum(chance[: near_dedup.AGREE]) < near_dedup.MISS
    agree = np.random.default_rng(3).random((20_000, n)) < p
    for d, trees in near_dedup.LEVELS.items():
        assert np.any([agree[:, path[:d]].all(1) for path in near_dedup.PATHS[:trees]], axis=0).all()


def test_near_dedup_finds_links_in_large_nodes_without_a_main_group(spark):
    """Texts that share a long passage, with edited copies of some: nodes are large at depth 4 and hold many groups."""
    rng = np.random.default_rng(9)
    passage, docs = [f"p{x}" for x in range(120)], {}
    for i in range(120):
        own = [f"d{i}x{x}" for x in range(40)]
        docs[2 * i] = " ".join(passage + own)
        if i % 3 == 0:
            for at in rng.choice(40, 3, replace=False):
                own[at] += "e"
            docs[2 * i + 1] = " ".join(passage + own)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want, _ = groups(docs, 4, 80)
    assert len(set(want.values())) == 120
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 4, 80).collect()} == want


@pytest.mark.parametrize(("train", "score", "label", "cut", "least", "most_wrong"), [(toxicity.train, toxicity.score_documents, "toxic", 0.5, 0.85, 0.01), (quality_gam.train, quality_gam.score_documents, "quality", 0.3, 0.97, 0.05)])
def test_held_out_accuracy(spark, train, score, label, cut, least, most_wrong):
    docs, labels = common.table(spark, SF3, "documents"), common.table(spark, SF3, "labels")
    rows = score(docs, train(docs, labels)).join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).select("doc_id", "score", label).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    told = {y: [r.score >= cut for r in rows if r[label] == y] for y in (0, 1)}
    assert np.mean(told[1]) >= least and np.mean(told[0]) <= most_wrong
