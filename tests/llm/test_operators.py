"""Each operator against brute force on a small table with nulls, empty and repeated rows, and on none."""

import base64
import hashlib
import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from evidence_engine.llm import bpe, exact_topk, fingerprint, language, license_scan, lm, mixing, ngram_join, quality, sharding

LONG = " ".join(f"word{i % 97}" for i in range(3000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
NEAR = BASE.replace("twenty", "end")
ROWS = [
    (0, BASE, "en", "a", 1), (1, NEAR, "en", "a", 1), (2, BASE, "en", "b", 1), (3, None, None, None, 1), (4, "", "fr", "b", 1), (5, " \t ", "de", None, 1),
    (6, "Released under the MIT License. And the mit license again, CC-BY", "en", "c", 1), (7, LONG, "en", "c", 1), (8, "le la les des une est avec pour dans", "fr", "c", 1),
    (9, "Café  STRASSE", "fr", "d", 1), (10, "Café straße", "fr", "d", 1), (2, BASE, "en", "b", 1), (None, "null id text here", "en", "a", 1), (11, "a" * 5000, "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, score int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_license_scan(docs, none):
    got = by_id(license_scan.license_labels(license_scan.license_scan(docs)))
    r = got[6][0]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (3, 3, 10, "cc-by,mit", 1.0)
    assert sum(map(len, got.values())) == len(ROWS) and got[3][0].n_words == 0 and got[0][0].labels == ""
    notice = next(t for t, label in license_scan.NOTICES.items() if label == "bsd")
    found = license_scan.license_labels(license_scan.license_scan(docs.sparkSession.createDataFrame([(1, "x " * 70 + notice)], "doc_id long, text string"))).first()
    assert found.labels == "bsd" and found.score >= 0.8
    assert license_scan.license_scan(none).count() == 0


def test_license_scan_equals_brute_force(spark):
    r = np.random.default_rng(9)
    long = " ".join(f"clause{i % 150} of{i % 7}" for i in range(120))
    words = [*license_scan.PHRASES, "mit", "license", "cc", "by", "x", "apache", "gnu general", "public license", "MIT LICENSE", "\u00e9t\u00e9"]
    texts = [" ".join(r.choice(words, int(n))) for n in r.integers(0, 60, 60)] + ["y " * 333 + long + " z" * 50, " ".join(long.split()[:150]), long, None, ""]
    got = {x.doc_id: x for x in license_scan.license_labels(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), notices={long: "long"})).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        hits = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        # Blocks of two strides of 256 words that start every stride.
        own = set(long.split())
        share = max((len(own & set(w[k : k + 512])) / len(own) for k in range(0, max(1, len(w)), 256)), default=0)
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in hits})) and got[i].labels == ",".join(sorted({x for _, x in hits} | ({"long"} if share >= 0.8 else set())))
    assert got[60].labels == "long" and got[62].score == 1.0 and got[61].labels == ""


def test_ngram_join(docs, none):
    def sets(t):
        w = WORD.findall(lower(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    have = [(i, sets(t)) for i, t, *_ in ROWS]
    group = list(range(len(have)))
    for _ in have:
        for x, y in itertools.combinations(range(len(have)), 2):
            a, b = have[x][1], have[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[x] = group[y] = min(group[x], group[y])
    smallest = {g: min((have[i][0] for i in range(len(have)) if group[i] == g and have[i][0] is not None), default=None) for g in group}
    want = Counter((have[i][0], len(have[i][1]), smallest[group[i]]) for i in range(len(have)))
    assert Counter(tuple(r) for r in ngram_join.ngram_jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()) == want
    assert ngram_join.ngram_jaccard_join(none).count() == 0


def test_ngram_join_equals_brute_force_on_many_near_copies(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(150):
        w = BASE.split() * 2
        for k in r.integers(0, 40, r.integers(0, 3)):
            w[k] = f"x{r.integers(0, 5)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(36)} for _, t in rows]
    comp = list(range(150))
    for _ in range(8):
        for a, b in itertools.combinations(range(150), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(comp))


def test_mixing(docs, none):
    out = mixing.mix_copies(docs)
    rows = [tuple(r) for r in out.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, (tuple(r) for r in mixing.mix_copies(docs.repartition(1)).collect())))
    sizes = Counter()
    for _, t, _, s, _ in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    total, weigh = sum(sizes.values()), dict(zip(sorted((s for s in sizes if s is not None)), itertools.cycle((5, 2, 1)))) | {None: (5, 2, 1)[(len(sizes) - 1) % 3]}
    target, open_ = {}, set(sizes)
    while True:
        left = total - sum(target.values())
        w = sum(weigh[s] for s in open_)
        over = {s for s in open_ if left * weigh[s] / w > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    target |= {s: left * weigh[s] / w for s in open_}
    assert sorted(round(r.target, 6) for r in out.collect()) == sorted(round(target[s], 6) for _, _, _, s, _ in ROWS)
    assert all(r.taken <= 3 * r.size for r in out.collect()) and mixing.mix_copies(none).count() == 0


def test_taken_words_come_near_the_targets_and_expectations_hold(spark):
    r = np.random.default_rng(11)
    rows = [(i, "w " * int(n), f"s{i % 4}" if i % 9 else None) for i, n in enumerate(np.exp(r.normal(4, 1.2, 1200)).astype(int) + 1)]
    rows += [(5000, "w " * 1000, "s1"), (5001, "w " * 9000, "one"), (5002, "", "none"), (5000, "w " * 1000, "s1")]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, source string, size int, key string").repartition(4)
    for seed in (1,):
        out = mixing.mix_copies(df, seed=seed).toPandas()
        assert (out.taken <= 3 * out["size"]).all() and len(out) == len(rows)
        for _, part in out.fillna({"source": "~"}).groupby("source"):
            least = part["size"][part["size"] > 0].quantile(0.1) if len(part) > 20 else part["size"].max()
            assert abs(part.taken.sum() - part.target.iloc[0]) <= max(least, 1) + 1
    few = spark.createDataFrame([(i, "w " * 10, "a" if i % 4 else "b") for i in range(40)], "doc_id long, text string, source string")
    mean = np.mean([[x.copies for x in mixing.mix_copies(few, seed=s).orderBy("doc_id").collect()] for s in range(3)], axis=0)
    assert abs(mean[0::4].mean() - 400 * 2 / 7 / 100) < 0.1 and abs(np.delete(mean, np.s_[0::4]).mean() - 400 * 5 / 7 / 300) < 0.06
    assert len(set(mean[0::4])) > 1  # which documents are taken twice is drawn anew


def test_quality(docs, none, spark):
    good, bad = "the quick brown fox jumps", "x!! y!! z!! $$$ ###"
    learn = spark.createDataFrame([(i, (good if i % 2 else bad) + f" w{i % 7}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(learn, labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(60))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(60))
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0


def test_lm(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = [(i, [*WORD.findall(lower(t)), None]) for i, t, *_ in ROWS]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens}
    c = Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = by_id(lm.lm_scores(docs, path, public_tokenizers.PATTERN))
    for i, ws in tokens:
        r = next(r for r in got[i] if r.n_tokens == len(ws))
        assert (r.held_out, r.n_known, r.train_tokens) == (held[i], sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9) and r.score < 0
    assert lm.lm_scores(none, path, public_tokenizers.PATTERN).count() == 0


RAW = type("Shared", (), {"value": open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()})


def test_lm_counts_survive_a_flush_on_the_last_run(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["one two two", None, "three"])], ["text"])

    def counted():
        out = Counter()
        for b in lm._count_rows(RAW, public_tokenizers.PATTERN)([batch]):
            for p, c in zip(b.column("p").to_pylist(), b.column("counts").to_pylist(), strict=True):
                out[p] += np.frombuffer(c, np.int64).sum()
        return {p: c for p, c in out.items() if c}

    whole = counted()
    monkeypatch.setattr(lm, "_MERGE", 1)
    monkeypatch.setattr(lm, "_FLUSH", 1)
    assert counted() == whole and whole[lm.TEXTS] == 3 and whole[lm.FIRST] == 4 + 3 and sum(c for p, c in whole.items() if p < lm.RANGES) == 4


def test_lm_counts_are_dealt_without_copies_for_arrow():
    r = np.random.default_rng(6)
    keys, n = r.integers(0, 400_000, 600_000).astype(np.uint64), r.integers(1, 5, 600_000)
    for base, other in ((0, keys), (lm.TRIE, keys % np.uint64(1000))):
        counts = lm._Counts(base)
        counts.add(lm.T.mix(keys), lm.T.mix(other), n)
        before = pa.total_allocated_bytes()
        made = counts.rest()
        assert pa.total_allocated_bytes() - before < 1 << 20  # one row a range; the blobs are numpy's
        found = {}
        for p, k, o, c in zip(*(column.to_pylist() for column in made.columns), strict=True):
            k, o, c = np.frombuffer(k, np.uint64), np.frombuffer(o, np.uint64), np.frombuffer(c, np.int64)
            assert len(k) == len(c) and len(o) == (len(k) if base else 0) and ((o if base else k) >> np.uint64(54) == p - base).all()
            found |= dict(zip(k.tolist(), c.tolist(), strict=True))
        want = np.bincount(keys.astype(np.int64), weights=n)
        assert len(found) == (want > 0).sum() and all(found[x] == want[k] for k, x in enumerate(lm.T.mix(np.arange(len(want), dtype=np.uint64)).tolist()) if want[k])
        assert counts.rest().num_rows == 0


_GROWN = """
import re, sys
import pyarrow as pa
from evidence_engine.llm.common import release
anon = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
release()
before = anon()
held = [pa.array([b"x" * (1 << 20)] * 8) for _ in range(25)]
del held
release()
print(anon() - before)
"""


def test_release_hands_back_what_arrow_has_freed():
    import subprocess
    import sys
    from pathlib import Path

    got = subprocess.run([sys.executable, "-c", _GROWN], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=120)
    assert int(got.stdout) < 40


def test_attention_head_learns_from_every_training_text(spark, monkeypatch):
    def numbers(raw, pattern, shared):  # sets the weight that the text names to 2
        def rows(batches):
            for b in batches:
                named = [int(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), pa.array([4.0] * len(named)), pa.array([2.0] * len(named))], ["i", "v", "n"])

        return rows

    weights, score = [], lm._score_rows
    monkeypatch.setattr(lm, "_train_rows", numbers)
    monkeypatch.setattr(lm, "_score_rows", lambda raw, pattern, shared: weights.append(shared.value[1]) or score(raw, pattern, shared))
    df = spark.createDataFrame([(i, str(i)) for i in range(100)], "doc_id long, text string")
    lm.lm_scores(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert set(np.flatnonzero(weights[0] == 2)) == {i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2}


def _head():
    r = np.random.default_rng(0)
    vectors = r.normal(size=(50, lm.WIDTH)).astype(np.float32)
    params = lm.start_params(np.full(lm.CLASSES, 1 / lm.CLASSES)) | {"out": r.normal(size=(2 * lm.WIDTH, lm.CLASSES)).astype(np.float32), "near": r.normal(size=lm.INPUTS).astype(np.float32)}
    return r, vectors, params


def test_attention_is_normalised_and_blind_to_what_follows():
    r, vectors, params = _head()
    ids = np.concatenate([r.integers(0, 48, 40), [48], r.integers(0, 48, 5), [48]]).astype(np.int32)
    run = lm.Run(ids, np.array([0, 41, 47]), np.arange(47), np.repeat([0, 1], [41, 6]), np.ones(47, np.int64))
    before = lm.windows(run, slice(0, 47), 49)
    assert (before[0] == 49).all() and (before[41] == 49).all() and before[43].tolist() == [49] * (lm.INPUTS - 2) + ids[41:43].tolist() and before[20].tolist() == ids[20 - lm.INPUTS : 20].tolist()
    logs = lm.log_classes(vectors, params, 49, before)
    changed = ids.copy()
    changed[30:] = (changed[30:] + 1) % 48
    assert np.allclose(logs[:31], lm.log_classes(vectors, params, 49, lm.windows(run._replace(ids=changed), slice(0, 31), 49)))
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-4)


def test_gradients_equal_differences():
    r, vectors, params = _head()
    inputs, goal = r.integers(0, 50, (6, lm.INPUTS)), r.integers(0, lm.CLASSES, 6)
    params = {k: v.astype(np.float64) for k, v in params.items()}
    loss = lambda p: -lm.log_classes(vectors.astype(np.float64), p, 49, inputs)[np.arange(6), goal].mean()
    moments = {k: [np.zeros(s), np.zeros(s)] for k, s in lm._SHAPES.items()}
    lm.train_step(vectors.astype(np.float64), {k: v.copy() for k, v in params.items()}, moments, 49, inputs, goal, 1)
    for name in params:
        at = tuple(r.integers(0, n) for n in params[name].shape)
        up, down = ({k: v.copy() for k, v in params.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert math.isclose((loss(up) - loss(down)) / 2e-4, moments[name][0][at] / 0.1, rel_tol=2e-3, abs_tol=1e-5)


def test_continuations_are_a_distribution():
    r = np.random.default_rng(2)
    words = [r.integers(0, 6, r.integers(1, 5)).astype(np.int32) for _ in range(400)]
    ids, sizes = np.concatenate(words), np.array([len(w) for w in words])
    end, size = 9, 9
    ctx, edge, follows = lm.continuations(ids, sizes, end)
    blob = lambda level: pd.DataFrame({"keys": [edge[level].tobytes()], "others": [ctx[level].tobytes()], "counts": [np.ones(len(ids), np.int64).tobytes()]})
    parts = [lm._sum_range((lm.TRIE,), blob(level)).iloc[0] for level in range(2)]
    table = [np.concatenate([np.frombuffer(p[c], np.uint64 if c.endswith("keys") else np.float64) for p in parts]) for c in ("head_keys", "head_values", "ctx_keys", "ctx_values")]
    for i in (0, 2):
        order = np.argsort(table[i])
        table[i], table[i + 1] = table[i][order], table[i + 1][order]
    later = np.where(np.arange(size + 1) < 7, 0.1, 0)
    later[end] = 0.3
    tail = lm._tail_of(*table, later)
    for word in ([1], [2, 3], [5, 5, 5, 5, 5]):  # known and unknown beginnings: what may follow them has probability 1 together
        total = 0.0
        for nxt in [*range(7), end]:
            longer = np.array([*word, nxt] if nxt != end else word, np.int32)
            c, e, f = lm.continuations(longer, np.array([len(longer)]), end)
            total += math.exp(tail(c[:, len(word) - 1 : len(word)], e[:, len(word) - 1 : len(word)], f[len(word) - 1 : len(word)])[0])
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_lm_beats_word_counts_on_held_out_texts(spark):
    r = np.random.default_rng(3)
    stock = {lang: ["".join(r.choice(list(letters), 6)) for _ in range(300)] for lang, letters in (("a", "abcdefgh"), ("b", "mnopqrst"))}
    texts = [" ".join(r.choice(stock["ab"[i % 2]], 60)) for i in range(600)]
    rows = lm.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).filter("held_out").toPandas()
    assert rows.score.mean() > rows.base_score.mean() + 3


def test_lm_looks_up_the_continuations_that_tasks_do_not_hold(spark):
    r = np.random.default_rng(4)
    stock = ["".join(r.choice(list("abcdefgh"), r.integers(3, 12))) for _ in range(800)]
    texts = [" ".join([*r.choice(stock, r.integers(0, 40)), f"only{i}", f"only{i}"]) for i in range(200)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id").cache()
    few, all_ = (lm.lm_scores(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, edges=edges).orderBy("doc_id").toPandas() for edges in (1, 10_000))
    assert len(few) == 202 and np.allclose(few.score, all_.score, rtol=1e-6) and (few.base_score == all_.base_score).all()


def test_hashes_are_found_in_few_steps():
    r = np.random.default_rng(5)
    top = np.iinfo(np.uint64).max
    for size in (0, 1, 2, 1000, 50_000):
        table = np.unique(np.concatenate([r.integers(0, top, size, np.uint64), np.array([0, top], np.uint64)[: min(size, 2)]]))
        index = lm._Index(table)
        keys = np.concatenate([table, table + np.uint64(1), r.integers(0, top, 1000, np.uint64), np.array([0, top], np.uint64)])
        at, there = index.find(keys)
        assert (there == np.isin(keys, table)).all() and (table[at[there]] == keys[there]).all()
        assert np.diff(index.begin, append=len(table)).max() <= 12


def test_fingerprints(docs, none):
    got = by_id(fingerprint.fingerprints(docs))

    def canon(t):
        fold = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
        return re.sub(r"\s+", " ", fold).strip()

    order = sorted(((i, t or "") for i, t, *_ in ROWS if i is not None), key=lambda x: x[0]) + [(None, "null id text here")]
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert hashlib.sha256(edited.encode()).hexdigest() in {r.edited_sha256 for r in got[i]} and got[i][0].n_chars == len(t)
    same = {(canon(a[1]) == canon(b[1])) == (got[a[0]][0].fingerprint == got[b[0]][0].fingerprint) for a in ROWS for b in ROWS}
    assert same == {True} and got[10][0].group_id == 9 and got[0][0].group_size == 3
    assert fingerprint.fingerprints(none).count() == 0


def test_exact_topk(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).round(2).tolist()) for i in range(200)] + [(200, None), (201, [None] * 8), (202, [float("nan")] * 8), (7, [0.5] * 8), (None, [1.0] * 8), (203, [1.0, 2.0])]
    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e and None not in e and not any(map(math.isnan, e))]
    want = set()
    for q, e in ((i, e) for i, e in v if i % 20 == 0):
        best = sorted(((-sum(a * b for a, b in zip(e, f)), i) for i, f in v if i != q and len(f) == len(e)))[:20]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(x) for x in exact_topk.exact_topk(df).collect()} == want
    assert exact_topk.exact_topk(df.limit(0)).count() == 0


def test_exact_topk_with_repeated_queries_ties_and_huge_components(spark):
    same = [(20, [1.0, 1.0])] * 2 + [(i, [1.0, 1.0]) for i in range(101, 120)]
    got = exact_topk.exact_topk(spark.createDataFrame([(*r, 9, 9) for r in same], "vec_id long, embedding array<double>, rank int, q int")).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(k + 1, 101 + k, 8192) for k in range(19)]
    huge = [(20, [2.0**20, 3.0]), (1, [2.0**30, 1.0]), (2, [-(2.0**30), 0.5]), (3, [1e8, -1.0]), (4, [2.0**46, 0.25]), (40, [1e-3, 0.0])]
    want = {(q, i, sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(x, y))) for q, x in huge if q % 20 == 0 for i, y in huge if i != q and q == 40} | {(20, i, sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(huge[0][1], y))) for i, y in huge if i not in (20, 4)}
    df = spark.createDataFrame([r for r in huge if r[0] != 4], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id, r.score) for r in exact_topk.exact_topk(df).collect()} == {w for w in want if w[1] != 4}
    out = exact_topk.exact_topk(spark.createDataFrame([(20, [2.0**80, 0.0]), (1, [2.0**-80, 2.0**70]), (2, [0.0, 5.0])], "vec_id long, embedding array<double>"))
    assert [(r.vec_id, r.score) for r in out.orderBy("rank").collect()] == [(1, 0), (2, 0)]


def test_exact_topk_reads_few_vectors(spark, monkeypatch):
    r = np.random.default_rng(5)
    v = r.normal(size=(3000, 16))
    monkeypatch.setattr(exact_topk, "ROW_BLOCK", 500)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 40)
    made, keep = {}, exact_topk.keep
    monkeypatch.setattr(exact_topk, "keep", lambda df, name: made.setdefault(name, keep(df, name)))
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in exact_topk.exact_topk(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    whole = np.floor(64 * v).astype(np.int64)
    for q in range(0, 3000, 20):
        score = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]
        assert [got[q, k + 1] for k in range(20)] == [(i, score[i]) for i in order]
    assert made["read"].count() <= 150 * 40 and made["near"].count() < 150 * 3000 / 20


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merger = bpe.Merger(ranks)
    for piece in ("a" * 5000, "ab" * 3000, "é漢🙂" * 500):
        assert merger.merge(piece.encode()) == whole._core_bpe.encode_single_piece(piece.encode())
    extra = docs.sparkSession.createDataFrame([(90, "it's    x\x1cy \n\n z '1 2'", None, None, 1)], SCHEMA)
    got = bpe.decode(bpe.encode(docs.union(extra), path, public_tokenizers.PATTERN), path).collect()
    texts = {(i, t or "") for i, t, *_ in [*ROWS, *extra.collect()]}
    for r in got:
        text = bytes(r.decoded).decode()
        assert (r.doc_id, text) in texts and r.ids == whole.encode_ordinary(text)
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_merges_each_pre_token_once_though_chunks_are_forgotten(monkeypatch):
    merged, merge = [], bpe.Merger.merge_all
    monkeypatch.setattr(bpe.Merger, "merge_all", lambda self, pieces: merged.extend(pieces) or merge(self, pieces))
    monkeypatch.setattr(bpe, "GROUP", 100)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RAW.value), special_tokens={})
    texts = [" ".join(f"{w}{n}" for w in ("Wörter", "don't", "ab cd", "x", "\x1cqrs")) for n in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = [ids for b in bpe._encode(RAW, public_tokenizers.PATTERN, 150, True)([batch]) for ids in b.column("ids").to_pylist()]
    assert got == [whole.encode_ordinary(t) for t in texts] and len(merged) == len(set(merged))


def test_language(spark, docs, none):
    table = language.train(docs)
    pages = spark.createDataFrame([(1, "https://x.example.fr/a", '<html lang="fr"><script>the</script><p>le la les des une est avec</p></html>'), (2, None, None), (3, "", "")], "page_id long, url string, html string")
    got = {(r.kind, r.id): r for r in language.identify(language.page_evidence(pages).unionByName(language.document_evidence(docs)), table).collect()}
    assert got["page", 1].lang == "fr" and got["page", 1].accepted and not got["page", 2].accepted and not got["document", 3].accepted
    assert got["document", 8].lang == "fr" and got["document", 0].lang == "en"
    assert language.identify(language.document_evidence(none), language.train(none)).count() == 0


def _prose(words, n):
    r = np.random.default_rng(4)
    return [" ".join(r.choice(words.split(), 60)) for _ in range(n)]


ITALIAN = "il gatto della nonna che dorme sulla sedia vicino alla finestra mentre piove nella strada degli amici con questo vento freddo"
KNOWN = {
    "en": "the cat of my grandmother that sleeps on a chair near the window while it rains in the street with this cold wind and other friends",
    "fr": "le chat de la grand mère qui dort sur une chaise près des fenêtres pendant que la pluie tombe dans cette rue avec ses amis",
    "it": ITALIAN,
}


def test_languages_are_those_of_the_labels(spark):
    rows = [(x, words, lang) for lang, words in KNOWN.items() for x in _prose(words, 40)]
    df = spark.createDataFrame([(i, t, "en" if i % 40 == 0 else lang, "s") for i, (t, _, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.id: r for r in language.identify(language.document_evidence(df), language.train(df)).collect()}
    assert language.train(df).languages == ("en", "fr", "it")
    assert all(got[i].lang == lang and got[i].accepted for i, (_, _, lang) in enumerate(rows))


def test_foreign_and_garbled_texts_are_rejected(spark):
    learn = [x for lang in ("en", "fr") for x in ((t, lang) for t in _prose(KNOWN[lang], 200))]
    r = np.random.default_rng(6)
    garbled = " ".join("".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(60))
    odd = [(_prose(ITALIAN, 1)[0], "it"), ("η γάτα της γιαγιάς κοιμάται στην καρέκλα " * 5, "el"), (garbled, "en"), (garbled, None)]
    df = spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in enumerate([*learn, *odd])], "doc_id long, text string, lang string, source string")
    got = {r.id: r for r in language.identify(language.document_evidence(df), language.train(df)).collect()}
    assert all(got[i].accepted and got[i].lang == lang for i, (_, lang) in enumerate(learn))
    assert [got[len(learn) + i].accepted for i in range(len(odd))] == [False] * len(odd)
    assert language.identify(language.document_evidence(df), language.train(df.limit(0))).filter("accepted").count() == 0


def test_sharding(docs, none):
    rows = sharding.vector_shards(docs, shards=4).collect()
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 16 for _, t, *_ in ROWS)
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.text_crc32 == zlib.crc32(t.encode()) for r in rows for i, t, *_ in ROWS if r.doc_id == i and t and i is not None)
    vectors = np.random.default_rng(3).integers(1, 50, (4000, 3)).astype(float)
    vectors = vectors[np.argsort(-vectors.max(axis=1))] / vectors.sum(axis=0) * 10
    left = np.ones((10, 3))
    assert set(sharding.place(vectors, left)) == set(range(10)) and np.abs(left).max() < 0.02
    assert sharding.vector_shards(none).count() == 0


def test_groups_of_equal_texts_stay_together_and_shards_are_level(spark, monkeypatch):
    r = np.random.default_rng(8)
    texts = [f"text {i} " + "w " * int(r.integers(5, 60)) for i in range(1500)]
    rows = [(i, texts[int(r.integers(0, 1500))] if i % 3 else texts[i % 1500]) for i in range(4000)] + [(4000 + i, "copied by a third " * 3) for i in range(2000)] + [(6000 + i, texts[7]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(sharding, "BUCKET", 100)  # so that several tasks pack
    got = sharding.vector_shards(df, shards=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, sharding.vector_shards(df.repartition(2), shards=4).collect()))
    shard_of, sizes = {}, Counter()
    text_of = dict(rows)
    for x in got:
        shard_of.setdefault(text_of[x.doc_id], set()).add(x.shard)
        sizes[x.shard] += x.size
    assert all(len(s) == 1 for t, s in shard_of.items() if t != "copied by a third " * 3)
    assert len(sizes) == 4 and max(sizes.values()) / (sum(sizes.values()) / 4) < 1.01


def test_fewer_rows_than_shards_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, 7), (None, "a", 5, 7), (2, None, 5, 7)], "doc_id long, text string, shard int, bytes int")
    got = sharding.vector_shards(df).collect()
    assert sorted(x.size for x in got) == [16, 17, 17] and all(0 <= x.shard < 40 and x.slot == 0 or x.slot == 1 for x in got)


def test_long_tail_of_sources_is_capped(spark):
    df = spark.createDataFrame([(i, "w " * 10, f"s{i:03d}") for i in range(40)], "doc_id long, text string, source string")
    out = mixing.mix_copies(df)
    assert out.filter(F.col("target") > 3 * F.col("source_size") + 1e-9).count() == 0
    assert math.isclose(sum(r.target for r in out.collect()), 400, rel_tol=1e-9)
