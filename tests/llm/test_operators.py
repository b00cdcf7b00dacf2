"""The training-data operators against brute force, on small tables with nulls, empty texts, ties and repeats."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.llm import exact_dedup, fingerprints, licenses, mixing, ngram_join, packed_ids, quality, secrets, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 97}x{i}" for i in range(300))
TEXTS = [
    (0, LONG, "a"), (1, LONG + " end", "a"), (2, None, None), (3, "", "b"), (4, "short text", "b"), (5, "short \n text", "é"), (6, "head " + LONG[: len(LONG) // 2] + " tail", "c"),
    (7, "x " * 200, "a"), (8, "Released under the MIT License. token = \"abcdef0123456789abcdef\"", "c"), (9, LONG.upper(), "c"), (9, LONG.upper(), "c"), (None, "no id here at all", "a"), (11, "日本 语 text", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), "clash") for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def key(i):
    return 1 << 63 if i is None else i


def test_exact_groups(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(TEXTS) and exact_dedup.exact_groups(empty).count() == 0
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in got:
        same = [i for i, t, _ in TEXTS if hashlib.sha256(norm(t).encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == min((i for i in same if i is not None), default=None)
    assert sum(r.kept for r in got) == len({norm(t) for _, t, _ in TEXTS})
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({norm(t) for _, t, _ in TEXTS})


def test_hot_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_IDS", 3)
    rows = [(k, "hot  text") for k in range(9, 0, -1)] + [(20, "cold"), (21, "cold"), (22, "alone"), (9, "hot text")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == sorted([(k, 1, 10, k == 1) for k in [*range(1, 10), 9]] + [(20, 20, 2, True), (21, 20, 2, False), (22, 22, 1, True)])
    left = exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in left) == [1, 20, 22]


def test_fingerprints_against_plain_bins(spark):
    """Bins filled by a plain loop over the runs' hashes; equal texts of other white space; clashing columns."""
    rows = [(k, " ".join(f"w{(i * (k + 3)) % 50}" for i in range(n))) for k, n in enumerate([1, 4, 5, 6, 60, 900, 5000])] + [(7, ""), (8, None)]
    made = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id long, text string, _t string, _s string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(made).collect()}
    assert all(r._t == r._s == "own" for r in got.values()) and fingerprints.fingerprints(made).columns == [*made.columns, "fingerprint"]
    lists = [(k, [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) > 4 else [tuple(w)]) for k, w in ((k, (t or "").split()) for k, t in rows)]
    runs = spark.createDataFrame([(k, list(r)) for k, rs in lists for r in set(rs)], "k long, r array<string>")
    hashed = {5: runs.where("size(r) = 5").selectExpr("k", "xxhash64(r[0], r[1], r[2], r[3], r[4]) h"), 0: runs.where("size(r) < 5").selectExpr("k", "xxhash64(r) h")}
    start, stride = fingerprints._drawn(1), fingerprints._drawn(2)
    for k, t in rows:
        if not (t or "").split():
            assert got[k].fingerprint == ""
            continue
        bins = [None] * fingerprints.BINS
        for h in (r.h & fingerprints.MASK for df in hashed.values() for r in df.where(f"k = {k}").collect()):
            j, v = h >> 32, h & 0x7FFFFFFF
            bins[j] = v if bins[j] is None else min(v, bins[j])
        walk = lambda j: next(bins[b] for b in ((start[j] + a * (stride[j] | 1)) % fingerprints.BINS for a in range(1, fingerprints.BINS + 1)) if bins[b] is not None)  # noqa: B023, E731
        assert got[k].fingerprint == "".join("0123456789abcdef"[(walk(j) if v is None else v) & 15] for j, v in enumerate(bins))


def test_substring(docs, empty):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated(docs).collect()}
    assert substring_dedup.remove_repeated(empty).count() == 0
    lists = [(key(i), i, WORD.findall(t or "")) for i, t, _ in TEXTS]
    for k, i, w in lists:
        earlier = {tuple(v[s : s + 50]) for kk, _, v in lists if kk < k for s in range(len(v) - 49)}
        gone = {p for s in range(len(w) - 49) if tuple(w[s : s + 50]) in earlier for p in range(s, s + 50)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        assert (i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()) in got


def test_jaccard(docs, empty):
    got = ngram_join.jaccard_components(docs).collect()
    assert ngram_join.jaccard_components(empty).count() == 0 and len(got) == len(TEXTS)
    low = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    sets = [(key(i) if i is not None else (1 << 63) - 1, {tuple(w[s : s + 5]) for s in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()) for i, w in ((i, low(t)) for i, t, _ in TEXTS)]
    root = list(range(len(sets)))
    for _ in sets:
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b], key=lambda j: (sets[j][0], j))
    want = sorted((sets[a][0], len(sets[a][1]), sets[root[a]][0]) for a in range(len(sets)))
    assert sorted((r._key, r.n_shingles, r.root) for r in got) == want
    assert ngram_join.drop_near_duplicates(docs).columns == docs.columns


def test_near_duplicates_keep_one_row_of_each_component(spark, empty):
    text = lambda k: " ".join(f"{k}y{i}" for i in range(60))
    apart = [(None, text("a")), (None, text("b")), (None, ""), (None, None), (None, " "), (3, text("c")), (3, text("d")), (3, ""), (3, ""), (7, "three more words")]
    groups = [
        [(None, text("e")), (None, text("e") + " end")], [(None, text("f")), (None, text("f"))], [(5, text("g")), (5, text("g"))],
        [(3, text("h")), (3, text("h") + " end"), (None, text("h").upper())], [(9, text("i")), (8, "head " + text("i")), (8, "head " + text("i"))],
    ]
    rows = apart + [r for g in groups for r in g]
    got = [tuple(r) for r in ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    left = list(got)
    for r in apart:
        left.remove(r)
    for g in groups:
        (kept,) = [r for r in left if r in g]
        assert key(kept[0]) == min(key(i) for i, _ in g)
        left.remove(kept)
    assert not left and ngram_join.drop_near_duplicates(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=2, max_size=12))
def test_links_connect_like_all_pairs(sets):
    forest = ngram_join.links([np.array(sorted(s), dtype=np.uint64) for s in sets])
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]

    def classes(edges):
        root = list(range(len(sets)))
        for _ in sets:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert classes(forest) == classes(pairs)


def test_many_near_copies_join_one_component(spark):
    base = [f"t{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for k in range(150)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("root").distinct().collect()
    assert [r.root for r in got] == [0]


def test_common_shingles_hold_no_unlike_documents_together(spark, monkeypatch):
    """lines of few documents each, but more than BLOCK, in otherwise different texts; near copies still link."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    line = lambda j: [f"line{j}w{i}" for i in range(12)]
    rows = [(k, " ".join([f"d{k}w{i}" for i in range(400)] + line(k % 67) + line(67 + k // 6))) for k in range(400)]
    rows += [(400 + k, " ".join(rows[k][1].split()[3:] + [f"end{k}"])) for k in range(0, 100, 10)] + [(1000, " ".join(line(0))), (1001, " ".join(line(0)[:11]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sets = {i: {tuple(w[s : s + 5]) for s in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    of = {i: min(j for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
    assert {r._key: r.root for r in ngram_join.jaccard_components(docs).collect()} == of and len(set(of.values())) == 401
    groups = []
    monkeypatch.setattr(ngram_join, "connected", lambda edges, f=ngram_join.connected: groups.append(f(edges)) or groups[-1])
    ngram_join.jaccard_components(docs)
    assert groups[0].groupBy("root").count().agg({"count": "max"}).first()[0] <= 4


def test_mixing(docs, empty):
    got = mixing.mix_counts(docs).collect()
    assert mixing.mix_counts(empty).count() == 0 and len(got) == len(TEXTS)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    source = {i: s for i, _, s in TEXTS}
    by = {source[r.doc_id]: (r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in by.values()) - 1.5 * sum(s for s, _ in by.values())) < 1e-6
    assert sorted(map(tuple, mixing.mix_counts(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    words = lambda rows: sum(len(WORD.findall(r.text or "")) for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and words(mixed.collect()) == sum(r.taken for r in got)


def test_fingerprints(docs, empty):
    got = {(r.doc_id, r.text): r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert fingerprints.fingerprints(empty).count() == 0
    assert got[2, None] == got[3, ""] == "" and got[4, "short text"] == got[5, "short \n text"]
    assert all(len(f) == fingerprints.BINS for (_, t), f in got.items() if t)
    same = sum(a == b for a, b in zip(got[0, LONG], got[1, LONG + " end"], strict=True)) / fingerprints.BINS
    assert same > 0.9


def test_likeness_error(spark):
    """The error at a true likeness of 0.8: 0.026 by the binomial estimate with 256 bins, 0.037 with 128."""
    text = lambda k, n, new: " ".join([f"{k}q{i}" for i in range(n)] + [f"{k}z{i}" for i in range(new)])
    pairs = spark.createDataFrame([(text(k, 904, 0), text(k, 804, 100)) for k in range(400)], "a string, b string")
    for c in "ab":
        pairs = fingerprints.fingerprint(pairs, fingerprints.F.col(c), f"f{c}")
    error = [r[0] - 0.8 for r in pairs.select(fingerprints.likeness("fa", "fb")).collect()]
    rms = (sum(e * e for e in error) / len(error)) ** 0.5
    print(f"{fingerprints.BINS} bins: error {rms:.4f}")
    assert rms < 0.031


def test_edited_texts(spark):
    rows = [(i, "".join(chr(97 + (i * j) % 26) + " " * (j % 3 == 0) for j in range(20 + i))) for i in range(25)]
    import tempfile

    folder = tempfile.mkdtemp()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op1_fingerprints(spark, folder).collect()}
    assert len(got) == 25
    for i, t in rows:
        cut = len(t) // 4
        edited = t[: len(t) - cut] + rows[(i + 1) % 25][1][:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and 0 <= got[i].near_next <= 1


def test_crf_viterbi_is_the_best_path():
    import itertools

    crf = secrets.model()
    for tokens, _, file in secrets.training_lines(40, seed=9):
        feats = secrets.features(tokens[:7], file)
        s = crf.scores(feats)
        total = lambda p: crf.first[p[0]] + sum(s[k, t] for k, t in enumerate(p)) + sum(crf.move[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023
        assert total(crf.viterbi(feats)) == pytest.approx(max(map(total, itertools.product(range(3), repeat=len(feats)))))


def test_scans_of_all_rows(docs, empty):
    assert secrets.scan_secrets(empty).count() == 0
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(docs).collect()}
    assert got[8, 7].base_labels == "mit" and got[8, 7].first_word == 1 and got[8, 7].score == 1.0
    assert got[2, 0].labels == "" and got[2, 0].first_word is None and licenses.scan_licenses(empty).count() == 0


def test_quality(docs, empty, spark):
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    rows, labels = [], []
    for i in range(200):
        good = i % 2
        rows.append((i, " ".join(word() if good else word().upper() + "!!" for _ in range(150))))
        labels.append((i, good))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(d, lab)
    got = quality.score(d, model).collect()
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert held and all(x.predicted == x.doc_id % 2 for x in held)
    assert quality.score(docs, model).count() == len(TEXTS) and quality.score(empty, None).count() == 0
    assert quality.keep_good(docs, None).columns == docs.columns


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.lists(st.integers(0, 1 << 20), max_size=50))
def test_bit_packing(bits, ids):
    ids = np.array([i % (1 << bits) for i in ids], dtype=np.uint32)
    data = packed_ids.pack(ids, bits)
    for start in range(0, len(ids) + 1, 7):
        assert (packed_ids.unpack(data, bits, start, len(ids) - start) == ids[start:]).all()


def morse(n):
    """The Thue-Morse word of 2 ** n letters and its complement, which collide under a polynomial hash modulo 2 ** 64."""
    word = [0]
    for _ in range(n):
        word += [1 - x for x in word]
    return "".join("ab"[x] for x in word), "".join("ba"[x] for x in word)


def test_words_that_collide_under_polynomials(spark):
    a, b = morse(11)
    rest = [f"w{i}" for i in range(60)]
    lists = [[a if i % 3 else x for i, x in enumerate(rest)], [b if i % 3 else x + "y" for i, x in enumerate(rest)]]
    lists[0][:50], lists[1][:50] = [a, "k"] * 25, [b, "k"] * 25
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lists)] + [(5, " ".join([a] * 9)), (6, " ".join([b] * 9))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeated(docs).collect()] == [0] * 4
    assert sorted(r.root for r in ngram_join.jaccard_components(docs).collect()) == [0, 1, 5, 6]


def test_training_with_clashing_columns_nulls_and_conflicts(spark):
    rows = [(k, ("Good plain words of prose. " if k % 2 else "BUY!! $$$ 1234 ### ") * (k % 9 + 1), "clash", 0.5) for k in range(60)] + [(None, "x", "clash", 0.1), (60, None, "clash", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, y double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 0), (2, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == 62 and sum((got[k] > 0.5) == (k % 2) for k in range(60)) > 50
    assert quality.train(docs, labels.where("false")) is None and quality.train(docs, labels, most=0) is None
    few = quality.train(docs, labels, most=5)
    assert few is not None and quality.keep_good(docs, few).columns == docs.columns


def test_attention_gradient():
    """Analytic gradients against differences: one step of a fit moves each weight against its numeric gradient."""
    r = np.random.default_rng(1)
    x, of, y = r.normal(size=(9, quality.FEATURES)), np.array([0, 0, 1, 1, 1, 2, 3, 3, 3]), np.array([0.0, 1, 1, 0])
    loss = lambda m: -np.mean(y * np.log(m.score(x, of, 4)) + (1 - y) * np.log(1 - m.score(x, of, 4)))
    start = quality.Mil.start()
    start.p["m"], start.p["s"] = x.mean(axis=0), x.std(axis=0) + 1e-3
    before = {k: v.copy() for k, v in start.p.items()}
    after = quality.Mil.start().fit(x, of, y, rounds=1, rate=1e-3, decay=0.0).p
    for k in "WVUwo":
        at = np.unravel_index(np.abs(after[k] - before[k]).argmax(), before[k].shape)
        slope = []
        for step in (1e-5, -1e-5):
            p = {n: v.copy() for n, v in before.items()}
            p[k][at] += step
            slope.append(loss(quality.Mil(p)))
        assert np.sign(slope[0] - slope[1]) == -np.sign(after[k][at] - before[k][at])
    t = start.forward(x, of, 4)
    assert np.allclose(np.bincount(of, weights=t["a"]), 1)
