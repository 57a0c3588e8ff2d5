"""Operators against brute force on small tables with nulls, empties, copies, ties and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexichron.llm import decontamination, language_model, line_dedup, mixing, near_duplicates, quality_classifier, quality_rules, sharding, toxicity, url_filters
from lexichron.llm._packing import pack, pack_ranks, pack_sorted, unpack, unpack_ranks, unpack_sorted

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, family long, node int, stratum string, line long"
ITEM = " ".join(f"item{i}" for i in range(20))


def make(spark, seed=1, n=60):
    """Documents with the columns that operators use inside, to see that names don't clash."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklm") * rng.randint(1, 3)
    texts = [None, "", " \n\t", "one", "One two\nthree", "a b c d", "x " * 30, f"start {ITEM} end", "pre " + " ".join(f"pad{i}" for i in range(900)) + " " + ITEM.upper()]
    texts += ["\n".join(" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    long = [f"w{i}" for i in range(120)]
    texts += [" ".join(long), " ".join(long), " ".join(long[:60] + ["other"] + long[60:]), " ".join(long[:115] + ["tail"])]
    texts += ["shared line\n" + t for t in texts[10:25] if t]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), 0, "k", 1, 1, 1, "z", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS), rows


@pytest.fixture(scope="module")
def docs(spark):
    df, rows = make(spark)
    return df.repartition(3).cache(), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("sets_", "large"), [(128, False), (4, False), (4, True), (2, True)])
def test_near_duplicates(spark, docs, monkeypatch, sets_, large):
    monkeypatch.setattr(near_duplicates, "CHUNK_SETS", sets_)
    df, rows = docs
    if large:  # a family of several chunks that falls into components: copies with more and more words changed, in two sizes
        base = [f"b{i}" for i in range(200)]
        rows = [(i, " ".join(("z%d" % i) if j % 53 == i % 7 and j < 60 * (i % 5) else w for j, w in enumerate(base[: 200 - 45 * (i % 2)]))) for i in range(70)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    again, across = [], near_duplicates._across
    monkeypatch.setattr(near_duplicates, "_across", lambda *a: again.append(1) or across(*a))
    sets = {r[0]: shingles(r[1], 4) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(df, 4, 80).collect()}
    assert {i: (len(s), find(i), find(i) == i) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}
    assert bool(again) == large and len({find(i) for i in sets}) > 1


def test_near_duplicates_drop(docs, empty):
    df, rows = docs
    kept = near_duplicates.drop_near_duplicates(df)
    found = {r.doc_id for r in near_duplicates.near_duplicates(df).collect() if r.kept}
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(found) and len(found) < len(rows)
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_near_duplicates_drop_goes_by_row(spark):
    a, u, z = ("a " * 9, " ".join(map(str, range(40))), "z y x w v u t s")
    rows = [(1, a, 0), (5, a, 1), (5, u, 2), (7, z, 3), (7, z, 4), (None, z, 5), (None, "alone but for this", 6), (None, None, 7), (8, "", 8), (9, "", 9)]
    kept = near_duplicates.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)).collect()
    assert sorted(r.row for r in kept if r.row not in (3, 4)) == [0, 2, 6, 7, 8, 9] and sum(r.row in (3, 4) for r in kept) == 1


def test_decontamination(spark, docs, empty):
    df, rows = docs
    items = [(1, ITEM), (2, None), (3, ""), (4, "One TWO\nthree"), (4, "One TWO\nthree"), (5, "absent words only in this item here")]
    got = {(r.doc_id, r.item_id): r.shared for r in decontamination.contained_items(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(r[0], i): len(shingles(r[1], 5) & shingles(t, 5)) for r in rows for i, t in items if shingles(t, 5) and 100 * len(shingles(r[1], 5) & shingles(t, 5)) >= 80 * len(shingles(t, 5))}
    assert got == want and len(want) >= 2
    assert decontamination.contained_items(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontamination.drop_contaminated(df, spark.createDataFrame([], "item_id long, text string")).count() == df.count()


def test_decontamination_in_blocks_and_by_row(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 3)
    phrase = lambda i, n=30: " ".join(f"p{i}q{j}" for j in range(n))
    items = [(i, phrase(i % 8)) for i in range(10)] + [(None, phrase(90))]
    rows = [(1, "pre " + phrase(0).upper() + " post", 0), (1, "clean text of the same id", 1), (None, phrase(9), 2), (None, phrase(2), 3), (4, phrase(3, 25), 4), (5, phrase(3, 20), 5), (6, phrase(90), 6), (7, None, 7), (8, "x " * 1_500_000 + phrase(7), 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(2)
    items = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contained_items(df, items)
    assert {(r.doc_id, r.item_id, r.shared) for r in found.collect()} == {(1, 0, 26), (1, 8, 26), (None, 2, 26), (4, 3, 21), (8, 7, 26)}
    kept = decontamination.drop_contaminated(df, items)
    assert kept.columns == df.columns and {r.row for r in kept.collect()} == {1, 2, 5, 6, 7}


def test_small_items_in_long_texts(spark):
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, some(5 + i % 4)) for i in range(400)] + [(1000 + i, ["which", "of", "these", "is", "a", *some(1 + i % 3)]) for i in range(100)]
    rows = []
    for i in range(0, len(items), 5):
        t = some(1500)
        for j, (_, w) in enumerate(items[i : i + 5]):
            t[j * 300 + 7 : j * 300 + 7] = w[:-1] if rng.random() < 0.1 else w
        rows.append((i, " ".join(t)))
    sets = {i: shingles(" ".join(w), 5) for i, w in items}
    held = {d: shingles(t, 5) for d, t in rows}
    want = {(d, i): len(held[d] & s) for d in held for i, s in sets.items() if 100 * len(held[d] & s) >= 80 * len(s)}
    found = decontamination.contained_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.shared for r in found.collect()} == want and len(want) > 400


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(docs, empty, order):
    df, rows = docs
    tokens = {r[0]: [*words(r[1]), None] for r in rows}
    count, context, texts = Counter(), Counter(), 0
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            texts += 1
            for j in range(len(w)):
                for m in range(1, min(order, j + 2) + 1):
                    gram = tuple(["<s>", *w][j + 2 - m : j + 2])
                    count[gram] += 1
                    context[gram[:-1]] += 1
    n, v, mu = context[()], sum(len(g) == 1 for g in count), language_model.MU

    def prob(gram):
        if len(gram) == 1:
            return (count[gram] + 1) / (n + v + 1)
        return (count[gram] + mu * prob(gram[1:])) / (context[gram[:-1]] + mu)

    for r in language_model.score_texts(df, order=order, block_bytes=5000, range_bytes=500).collect():
        w = tokens[r.doc_id]
        score = sum(math.log10(prob(tuple(["<s>", *w][max(0, j + 2 - order) : j + 2]))) for j in range(len(w)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x,] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10(prob((x,))) for x in w)) and r.score == pytest.approx(score)
    assert language_model.score_texts(empty).count() == 0


def test_language_model_odd_rows(spark):
    rows = [(None, "null id", 1), (1, "w " * 3000 + "x", 2), (1, "w " * 3000 + "x", 3), (2, None, 4), (3, "", 5), (4, "long " + "q" * 3_000_000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int").repartition(2)
    got = language_model.score_texts(df).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id == 1}) == 1 and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3)} == {1} and all(r.held_out for r in got if r.doc_id is None)


def test_packing_loses_nothing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (unpack_sorted(pack_sorted(keys), len(keys)) == keys).all()
        x = rng.integers(-(1 << 40), 1 << 40, n) >> rng.integers(0, 41, n)
        assert (unpack(pack(x)) == x).all()
        x = rng.integers(0, 1 << 31, n) >> rng.integers(0, 31, n)
        assert (unpack_ranks(pack_ranks(x)) == x).all()
    dense = np.arange(300, dtype=np.uint64)
    assert (unpack_sorted(pack_sorted(dense), 300) == dense).all()


@pytest.mark.parametrize("limit", [1000, 0])
def test_lines(docs, limit, empty):
    df, rows = docs
    keys = lambda t: [line_dedup.line_key(x) for x in (t or "").split("\n")]
    seen = Counter(k for r in rows for k in set(keys(r[1])) if k)
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.drop_shared_lines(df, 10, 1, limit).collect()}
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x, k in zip(lines, keys(r[1]), strict=True) if seen[k] < 10]
        assert got[r[0]] == ("\n".join(stay), len(lines), len(lines) - len(stay)), hashlib.sha256
    assert line_dedup.drop_shared_lines(empty).count() == 0


def test_mixing(docs, empty):
    df, rows = docs
    got = mixing.mix(df).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((x for x in sizes if x is not None)) + ([None] if None in sizes else [])
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[x] for x in capped)
        share = sum(weight[x] for x in order if x not in capped)
        target = {x: 2 * sizes[x] if x in capped else rest * weight[x] / share for x in order}
        above = {x for x in order if target[x] > 2 * sizes[x]}
        if not above:
            break
        capped |= above
    taken = Counter()
    for r in got:
        taken[r.source] += r.mix_taken
        assert r.mix_taken <= 2 * r.mix_size and r.mix_target == pytest.approx(target[r.source])
    assert all(abs(taken[x] - target[x]) <= 1 for x in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(df).columns == df.columns


def test_sharding(docs, empty):
    df, rows = docs
    got = sharding.kd_shards(df, shards=5).collect()
    shard = {r.doc_id: r.kd_shard for r in got}
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r[1] or "", shard[r[0]]) == shard[r[0]]
    assert {r.kd_size for r in got} == {len((r[1] or "").encode()) + 1 for r in rows}
    slots = sharding.slots(sharding.kd_shards(df, shards=5).select("doc_id", F.col("kd_size").alias("size"), F.col("kd_crc32").alias("text_crc32"), F.col("kd_shard").alias("shard"))).collect()
    for s in set(shard.values()):
        assert sorted(r.slot for r in slots if r.shard == s) == list(range(sum(x == s for x in shard.values())))
    assert sharding.kd_shards(empty, shards=3).count() == 0


@pytest.mark.parametrize("shards", [7, 200, 300])
def test_shards_are_balanced(spark, shards):
    rng = random.Random(shards)
    rows = [(i, "\n".join(" ".join("v" * rng.randint(1, 9) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 9))), "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kd_size string").withColumn("node", F.lit(9)).withColumn("size", F.lit("s"))
    got = sharding.kd_shards(df, shards=shards).collect()
    heavy = max(r.kd_size for r in got)
    of = Counter()
    for r in got:
        of[r.kd_shard] += r.kd_size
    mean = sum(of.values()) / shards
    assert set(of) == set(range(shards)) and r.node == 9 and r.size == "s"
    assert max(abs(x - mean) for x in of.values()) <= heavy * math.ceil(math.log2(shards)) / 2
    assert sorted(r.kd_size for r in got) == sorted(len(t.encode()) + 1 for _, t, _ in rows)


def test_heavy_text_is_dealt_by_id(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(400)], "doc_id long, text string")
    n = Counter(r.kd_shard for r in sharding.kd_shards(df, shards=4).collect())
    assert len(n) == 4 and max(n.values()) <= 110


def test_mixing_with_many_sources_and_clashing_names(spark, docs, monkeypatch):
    """The joined branch, which no broadcast helps, gives the same mix; columns with the names of results are replaced."""
    df = docs[0].withColumns({"mix_size": F.lit("clash"), "taken": F.lit("own"), "row": F.lit(1)})
    few = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    many = mixing.mix(df)
    assert sorted(map(str, many.collect())) == few and {r.taken for r in many.collect()} == {"own"} and many.schema["mix_size"].dataType.simpleString() == "bigint"
    assert sorted(map(str, mixing.mixed_documents(df).collect()))[0] and mixing.mixed_documents(df).columns == df.columns


def test_odd_rows(spark):
    """Repeated and null ids, repeated rows, a text of several megabytes, clashing names: every row comes back with its result."""
    long = "\n".join(f"line {i % 40_000} of a very long text" for i in range(120_000))
    texts = [(1, "same text here"), (1, "same text here"), (1, "another text"), (None, "same text here"), (None, None), (2, ""), (3, long), (4, long)]
    df = spark.createDataFrame([(i, t, "en", None, "x", 7, "y") for i, t in texts], "doc_id long, text string, lang string, source string, score string, x int, family string").repartition(3)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 0, 0)], "doc_id long, toxic int, quality int")
    rules = {r.n_words: r for r in quality_rules.measures(df).collect()}
    assert rules[len(long.split())].n_dup_lines == 80_000 and len(quality_rules.quality_rules(df, labels).collect()) == 8
    for made in (toxicity.toxicity(df, labels), quality_classifier.quality(df, labels)):
        got = made.collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    lines = line_dedup.drop_shared_lines(df, threshold=2).collect()
    assert len(lines) == 8 and {(r.n_lines, r.n_dropped) for r in lines if r.doc_id in (3, 4)} == {(120_000, 120_000)}
    near = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df, 4).collect()}
    assert {c for i, _, c in near if i in (3, 4)} == {3} and (None, 1, None) in near and (2, 0, 2) in near
    shards = sharding.kd_shards(df, shards=2).collect()
    assert len(shards) == 8 and sorted(Counter(r.kd_shard for r in shards if r.doc_id in (3, 4)).values()) == [1, 1]  # heavier than a shard: by id
    assert len(mixing.mix(df).collect()) == 8


def test_urls_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "c"), (1, "http://a.com/en/x", "c"), (None, "http://b.org/es/", "c")], "page_id long, url string, rule string")
    rules = url_filters.RULES + url_filters.RULES[:1] + [(None, "/", "block"), ("", "/", "block"), ("b.org", None, "block")]
    rules = spark.createDataFrame([(*r, "extra") for r in rules], "host string, path string, verdict string, stack string")
    got = url_filters.judge(pages, rules).collect()
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in got) == [(0, "org/es/", "block"), (1, "com/en/", "block"), (1, "com/en/", "block")]
    assert {(r.rule, r.verdict) for r in url_filters.judge(pages, rules.limit(0)).collect()} == {(None, "allow")}
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_urls(spark):
    urls = [None, "no scheme", "http://com/en/x", "https://A.Example.COM/en/7?q=/en/", "http://notexample.com/en/7", "http://x.example.net/de/85", "http://example.net/de/", "ftp://org/es/", "http://org", "http://a.org?x/es/", "://", "http://com./en/"] * 3
    got = {(r.page_id): r for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4), spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit)[1:] if fit else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want)


def test_quality_rules(spark, docs, empty):
    df, rows = docs
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, labels).collect()}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if x.split():
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars) == (len(w), len(covered), dup, sum(len(x.decode()) for x in w))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(empty, labels.limit(0)).count() == 0


def test_cutoffs_are_proved_by_stratum(spark):
    """Two strata with enough holdouts and one without: cutoffs, rejections and ties against an exact computation."""
    rng = random.Random(12)
    good = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(2, 6) + str(rng.randrange(999)) + "#" * (rng.random() < 0.01) for _ in range(55))
    rows = [(i, good(), lang) for i, lang in enumerate(["a"] * 1100 + ["b"] * 1050 + ["c"] * 60)]
    bad = [(5000 + i, " ".join(x.upper() + "##" for x in good().split()), lang) for i, lang in enumerate(["a", "b", "c"] * 40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "doc_id long, text string, lang string, stratum string, cut_symbols int").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows] * 2 + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    measured = quality_rules.measures(df).collect()
    proved = quality_rules.cutoffs(quality_rules.measures(df), labels)
    want = []
    for lang in "ab":
        own = [r for r in measured if r.stratum == lang and r.doc_id < 5000 and not r.base_failed]
        for rule in quality_rules.RULES:
            best = None
            for c in quality_rules.GRID:
                k, n = sum(r[f"bad_{rule}"] >= c for r in own), len(own)
                tail = sum(math.comb(n, i) * 0.005**i * 0.995 ** (n - i) for i in range(k + 1))
                if k >= n * 0.005 or tail > 0.05 / 8:
                    break
                best = c
            if best is not None:
                want.append((lang, rule, best, len(own)))
    assert proved == want and {w[:2] for w in want} >= {("a", "symbols"), ("b", "symbols"), ("a", "shouting")}
    cut = {(lang, rule): c for lang, rule, c, _ in want}
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, labels).collect()}
    for r in measured:
        rule = next((x for x in quality_rules.RULES if r[f"bad_{x}"] >= cut.get((r.stratum, x), 10**9)), None)
        assert (got[r.doc_id].rejected_by, got[r.doc_id].kept) == (rule, not r.base_failed and rule is None)
    assert not any(got[i].kept for i, _, lang in bad if lang != "c") and all(got[i].kept for i, _, lang in bad if lang == "c")
    assert sum(not got[i].kept for i, _, lang in rows) < 0.02 * len(rows)


def test_bound_is_exact():
    for k, n in ((0, 600), (3, 900), (9, 1200)):
        tail = sum(math.comb(n, i) * 0.005**i * 0.995 ** (n - i) for i in range(k + 1))
        assert quality_rules.passes(k, n, 0.005, tail * 1.001) == (k < n * 0.005)
        assert not quality_rules.passes(k, n, 0.005, tail * 0.999)


def test_every_word_has_its_own_vector(spark):
    import pyarrow as pa

    from lexichron.llm._tokens import RUNS, word_hashes

    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(40_000 * rng.random() ** 2)}" for _ in range(900))) for i in range(90)] + [(90, None), (91, ""), (None, "w1 w2 w2")]
    hashed = [word_hashes(pa.array([t], pa.string()), lower=False, classes=RUNS)[0].tolist() for _, t in rows]
    every = sorted({h for t in hashed for h in t})
    assert len(every) > 20_000
    index = dict(zip(every, quality_classifier.index_vectors(np.array(every, np.uint64)).astype(int), strict=True))
    sums, n = {h: np.zeros(quality_classifier.DIMS) for h in every}, Counter(h for t in hashed for h in t)
    for t in hashed:
        for i, h in enumerate(t):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(t):
                    sums[h] += index[t[j]]
    mean = sum(sums.values()) / sum(n.values())
    unit = {h: (sums[h] / n[h] - mean) / np.linalg.norm(sums[h] / n[h] - mean) for h in every}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: np.frombuffer(r.x, np.float32) for r in quality_classifier.pooled(df).collect()}
    for (i, _), t in zip(rows, hashed, strict=True):
        want = np.mean([unit[h] for h in t], axis=0) if t else np.zeros(quality_classifier.DIMS)
        energy = np.log(float((sum(index[h] for h in t) ** 2).sum()) / (quality_classifier.NONZERO * len(t)) + 0.1) if t else 0.0
        assert got[i] == pytest.approx([*want, energy, np.log1p(len(t))], abs=1e-4)
    assert len(got) == len(rows)


def test_risk_has_the_right_gradient():
    """A step of the fit against numeric differences of the corrected risk, and its non-negative part."""
    rng = np.random.default_rng(2)
    rows = [(bool(i % 3 == 0), bool(i % 3), sorted(set(rng.integers(0, 6, 3).tolist()))) for i in range(60)]
    weights, bias = toxicity.fit_nnpu(rows, 6, 0.3, steps=1, rate=1e-3)
    p, u = (np.array([r[c] for r in rows], float) for c in (0, 1))
    p, u = p / p.sum(), u / u.sum()

    def risk(theta):
        f = np.array([theta[r[2]].sum() for r in rows]) + theta[-1]
        return 0.3 * (p * np.logaddexp(0, -f)).sum() + max(0.0, ((u - 0.3 * p) * np.logaddexp(0, f)).sum())

    start = np.append(np.zeros(6), np.log(0.3 / 0.7))
    slope = np.array([(risk(start + e) - risk(start - e)) / 2e-6 for e in np.eye(7) * 1e-6])
    assert (np.sign(weights) == -np.sign(slope[:6])).all() and np.isfinite(bias)


def test_class_prior_needs_no_clean_labels():
    rng = np.random.default_rng(3)
    toxic = np.append(np.ones(500, bool), rng.random(4000) < 0.12)
    p, u = np.arange(4500) < 500, np.arange(4500) >= 500
    f = np.where(toxic, 3.0, -3.0) + rng.normal(0, 1.0, 4500)
    assert toxicity.class_prior(f, p.astype(float), u.astype(float)) == pytest.approx(toxic[500:].mean(), abs=0.02)


def test_temperature_calibrates():
    rng = np.random.default_rng(4)
    made = lambda x: (rng.random(len(x)) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    x = rng.normal(0, 1, (4000, 5))
    net = quality_classifier.fit_network(x, made(x))
    x = rng.normal(0, 1, (4000, 5))  # rows that neither the fit nor the temperature has seen
    y = made(x)
    prob = 1 / (1 + np.exp(-quality_classifier.logits(x, net)))
    cut = np.digitize(prob, [0.2, 0.4, 0.6, 0.8])
    assert all(abs(prob[cut == c].mean() - y[cut == c].mean()) < 0.1 for c in range(5) if (cut == c).sum() > 100)
    z = quality_classifier.logits(x[:7], net | {"t": np.ones(1)})
    want = [sum(np.tanh(sum((row[i] - net["mean"][i]) / net["scale"][i] * net["w1"][i][h] for i in range(5)) + net["b1"][h]) * net["w2"][h] for h in range(quality_classifier.HIDDEN)) + net["b2"][0] for row in x[:7]]
    assert z == pytest.approx(want)


def test_models(spark, empty):
    rng = random.Random(3)
    common = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        t = " ".join(rng.choice(common) for _ in range(40))
        rows.append((i, t + (" vileword" + rng.choice("abc") if bad else ""), bad))
        rows[-1] = (i, rows[-1][1] if i % 3 else " ".join(x + "***" for x in rows[-1][1].split()), bad)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b), int(i % 3 > 0)) for i, _, b in rows], "doc_id long, toxic int, quality int")
    truth = {i: (b, i % 3 > 0) for i, _, b in rows}
    for f, at in ((toxicity.toxicity, 0), (quality_classifier.quality, 1)):
        got = f(df, labels).collect()
        assert len(got) == 602 and all(0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.held_out and r.doc_id < 9000]
        assert np.mean([r.predicted == truth[r.doc_id][at] for r in held]) > 0.95
        assert f(df, labels.limit(0)).count() == 602 and f(empty, labels).count() == 0
    assert {r.doc_id for r in toxicity.drop_toxic(df, labels).collect()} >= {9000, 9001}
