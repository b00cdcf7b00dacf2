"""The pipeline, stage by stage, against brute force on a small fixture with nulls, copies, near copies and repeated ids."""

import re

import numpy as np
import pytest

import corpus_pipeline
from codeweft.llm import piece_lattice, quality
from codeweft.llm._common import new_path, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark):
    r = np.random.default_rng(8)
    prose = lambda n: " ".join("".join(r.choice(list("abcdefghijklmno"), r.integers(3, 8))) for _ in range(n)) + "."
    junk = lambda n: " ".join(r.choice(["BUY!!", "$$$", "%%##", "1234", "XXX", "=>"], n))
    rows = [(k, prose(40 + k % 60) if k % 3 else junk(60), "abc"[k % 3] if k % 7 else None) for k in range(90)]
    base = prose(120)
    rows += [(100 + k, base, "a") for k in range(4)] + [(110, base.replace(" ", "  "), "b"), (111, base + " more", "b"), (112, "first " + base, "c")]
    rows += [(None, prose(50), "a"), (None, prose(50), "a"), (5, prose(70), "b"), (200, None, "a"), (201, "", "b"), (202, "few words here", "c")]
    out = new_path(spark, "pipeline-input")
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def key(i):
    return (1 << 63) - 1 if i is None else i


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def near_kept(rows):
    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    best = {}
    for k, r in enumerate(rows):
        best[root[k]] = min(best.get(root[k], (key(r.doc_id), k)), (key(r.doc_id), k))
    return sorted(str((rows[k].doc_id, rows[k].text)) for _, k in best.values())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(str((r.doc_id, r.text)) for r in df.collect())
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))

    good = written(stages["quality"](spark, docs, folder), "good")
    accepted = []
    for r in docs.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        if model.score(*quality.passages(data, np.array([0, len(data)])), 1)[0] >= quality.THRESHOLD:
            accepted.append(str((r.doc_id, r.text)))
    assert good.columns == docs.columns and rows(good) == sorted(accepted)
    junk = {r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id < 90 and r.doc_id % 3 == 0 and "BUY" in r.text + "BUY"}
    assert len({r.doc_id for r in good.collect()} & junk) < 4 and sum(r.doc_id is not None and r.doc_id < 90 for r in good.collect()) >= 57

    once = written(stages["exact_dedup"](spark, good, folder), "once")
    groups = {}
    for r in good.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r)
    assert once.columns == docs.columns and rows(once) == sorted(str((x.doc_id, x.text)) for x in (min(g, key=lambda r: (key(r.doc_id), r.text or "")) for g in groups.values()))

    apart = written(stages["near_dedup"](spark, once, folder), "apart")
    assert apart.columns == docs.columns and rows(apart) == near_kept(once.collect())

    mixed = written(stages["mixing"](spark, apart, folder), "mixed")
    size, taken = {}, {}
    for r in apart.collect():
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text or ""))
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text or ""))
        assert r.text is None or any((x.text or "").startswith(r.text) for x in apart.collect() if x.doc_id == r.doc_id)
    order, total = sorted(size, key=lambda s: (s is None, s or "")), 1.5 * sum(size.values())
    weight, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {}
    open_ = list(order)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * size[s] < level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ = [s for s in open_ if s not in full]
    assert mixed.columns == docs.columns and all(abs(taken.get(s, 0) - target[s]) <= 1 for s in order)

    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=piece_lattice.model_file())
    coded = stages["sentencepiece"](spark, mixed, folder).collect()
    assert sorted((str(r.doc_id), r.piece_ids, r.n_pieces) for r in coded) == sorted((str(r.doc_id), x, len(x)) for r in mixed.collect() for x in [library.encode(r.text or "")])
