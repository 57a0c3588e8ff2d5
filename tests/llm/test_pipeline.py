"""Every stage of the pipeline against brute force over what the stage before kept, on a small corpus with planted cases."""

import hashlib
import math
import random
from collections import Counter

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, kd_size string"
ITEM = " ".join(f"item{i}" for i in range(24))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, by its name; the first are the documents."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) + rng.choice("xyz") for _ in range(n))
    texts = [prose(rng.randint(20, 90)) for _ in range(260)]
    texts += [f"{prose(30)} vileword{rng.choice('abc')} {prose(20)}" for _ in range(70)]
    texts += [t for t in texts[:6] for _ in range(5)]
    texts += [t.replace(t.split()[9], "changed", 1) for t in texts[:20]]
    texts += [f"{prose(40)} {ITEM} {prose(40)}", f"{prose(9)} {ITEM.upper()}", None, "", " \n", "word", "long " * 400_000]
    ids = [*range(len(texts) - 4), None, None, 3, 3]
    rows = [(i, t, "en", rng.choice(["s1", "s2", "s3", None]), 0, k, "clash") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int("vileword" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 10], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "short")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {"documents": docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(folder))
        assert i == 4 or made.columns == docs.columns
        made.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out[name] = docs.collect()
    return out | {"run": corpus_pipeline.run(spark, str(folder)).collect()}


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def numbers(rows):
    return sorted(r.row for r in rows)


def test_toxicity(stages):
    assert numbers(stages["toxicity"]) == [r.row for r in sorted(stages["documents"], key=lambda r: r.row) if "vileword" not in (r.text or "")]


def test_near_duplicates(stages):
    rows = sorted(stages["toxicity"], key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    want = sorted(rows[i].row for i in range(len(rows)) if root(i) == i)
    assert numbers(stages["near_duplicates"]) == want and len(want) < len(rows) - 20


def test_decontamination(stages):
    item = shingles(ITEM)
    want = [r.row for r in stages["near_duplicates"] if 100 * len(shingles(r.text) & item) < 80 * len(item)]
    assert numbers(stages["decontamination"]) == sorted(want) and len(want) == len(stages["near_duplicates"]) - 2


def test_mixing(stages):
    rows = stages["decontamination"]
    size = {r.row: len(words(r.text)) for r in rows}
    of = Counter()
    for r in rows:
        of[r.source] += size[r.row]
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight, capped, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(), 1.5 * sum(of.values())
    while True:
        rest, share = total - sum(2 * of[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 2 * of[s] if s in capped else rest * weight[s] / share for s in order}
        if not (above := {s for s in order if target[s] > 2 * of[s]} - capped):
            break
        capped |= above
    want = Counter()
    for s in order:
        whole = math.floor(target[s] / of[s])
        left = math.floor(target[s] - whole * of[s] + 0.5)
        key = lambda r: (hashlib.md5(f"17:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.doc_id or 0, size[r.row])
        for r in sorted((r for r in rows if r.source == s), key=key):
            part = max(0, min(size[r.row], left))
            left -= part
            if size[r.row]:
                want[r.row] += whole + (2 * part >= size[r.row])
    assert Counter(numbers(stages["mixing"])) == +want


def test_sharding(stages):
    rows = stages["sharding"]
    assert numbers(rows) == numbers(stages["mixing"])
    assert {r.shard_size for r in rows} == {len((r.text or "").encode()) + 1 for r in rows} and {r.shard for r in rows} == {0}


def test_run_is_the_stages(stages):
    key = lambda r: (r.row, r.shard)
    assert sorted(map(key, stages["run"])) == sorted(map(key, stages["sharding"]))
