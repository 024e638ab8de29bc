"""Line rules, SimHash, components and the pipeline against plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from conftest import COLUMNS, of, prose, same

import corpus_pipeline
from turnledger.llm import quality, simhash
from turnledger.llm.components import connected_components


# Rules


def expected_figures(text):
    words = (text or "").encode().split()
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[words[i], words[i + 1], words[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    chars = sum(c not in " \t\n\x0b\x0c\r" for c in text or "")
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    n, rep = len(words), len(covered)
    return n, chars, symbols, len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


COLS6 = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_figures(docs, plain, odd, nothing):
    for frame, rows in ((docs, plain), (odd, of(odd))):
        same(quality.judge(frame), [(i, *expected_figures(t)) for i, t, _ in rows], COLS6)
    assert quality.judge(nothing).count() == 0


def test_windows_with_a_large_vocabulary(monkeypatch):
    words = [f"{random.Random(i).randrange(9)}".encode() for i in range(500)]
    exact = quality._repeated(words)

    class Large(dict):
        def __len__(self):
            return (1 << 21) + super().__len__()

    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    seq = np.array([ids[w] for w in words])
    pairs = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1]
    keys = pairs[:-1] * len(ids) + seq[2:]
    where, times = np.unique(keys, return_inverse=True, return_counts=True)[1:]
    again = times[where] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    assert exact == covered.sum()


def line_corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        own = "\n".join(prose(rng, 30, 10**6) for _ in range(3))
        menu = "Home   News CONTACT page" if i % 2 else ""
        rows.append((i, f"{menu}\n{own}", "en", "site", 1))
    menus = [prose(rng, 16, 10**6) for _ in range(5)]
    for i in range(300, 330):  # depleted: nearly all of their words are menus
        rows.append((i, "\n".join([*menus, prose(rng, 20, 10**6)]), "en", "site", 1))
    copy = "\n".join(prose(rng, 30, 10**6) for _ in range(4))
    rows += [(i, copy, "en", "site", 1) for i in range(400, 460)]
    rows += [(500, f"home news contact page\n{prose(rng, 80, 10**6)}", "en", None, 1)]
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


def test_frequent_lines_go_and_depleted_documents_too(spark):
    frame = line_corpus(spark)
    got = {r["doc_id"]: r for r in quality.judge(frame).collect()}
    assert all(got[i]["kept"] for i in range(300)) and got[500]["kept"]
    assert all(got[i]["n_lost_words"] == (4 if i % 2 else 0) for i in range(300))
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in range(300, 330))
    assert all(got[i]["kept"] and not got[i]["n_lost_words"] for i in range(400, 460))
    text = {r["doc_id"]: r["text"] for r in quality.clean(frame).collect()}
    assert set(text) == {*range(300), *range(400, 460), 500}
    assert "CONTACT" not in text[1] and "contact" in text[500]


def test_documents_that_share_most_of_their_words_count_each(spark):
    rng = random.Random(31)
    rows = []
    for host in range(6):
        menus = [prose(rng, 16, 10**6) for _ in range(5)]
        rows += [
            (1000 * host + i, "\n".join([*menus, prose(rng, 5, 10**6)]), "en", f"h{host}", 1) for i in range(200)
        ]
    # Copies, whatever their case and white space, are one document still.
    copy = "\n".join(prose(rng, 30, 10**6) for _ in range(4))
    rows += [(9000 + i, copy.upper() + " " * i if i % 2 else copy, "en", "copies", 1) for i in range(60)]
    got = quality.judge(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_lost_words"], r["kept"]) == ((0, True) if r["doc_id"] >= 9000 else (80, False))


def test_clean_keeps_columns(odd):
    out = quality.clean(odd)
    assert out.columns == odd.columns
    kept = Counter(r["doc_id"] for r in quality.judge(odd).filter("kept").collect())
    assert Counter(r["doc_id"] for r in out.collect()) == kept


# Components


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(300)]
    star = [(10_000, 20_000 + i) for i in range(500)]
    loose = [(rng.randrange(30_000, 30_400), rng.randrange(30_000, 30_400)) for _ in range(250)]
    edges = path + star + loose + [(7, 7), (0, 1)]
    roots = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(set)
    for r in roots:
        groups[r["root"]].add(r["node"])
    want = defaultdict(set)
    for x in list(parent):
        want[find(x)].add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}
    empty = spark.createDataFrame([], "a long, b long")
    assert connected_components(empty).count() == 0


# SimHash


def expected_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected_components(rows, radius=4):
    fps = [expected_fingerprint(t) for _, t, _ in rows]
    distinct = sorted(set(fps))
    arr = np.array(distinct, np.uint64)
    root = {}
    for start in distinct:
        if start in root:
            continue
        root[start], todo = start, [start]
        while todo:
            x = todo.pop()
            for y in arr[np.bitwise_count(arr ^ np.uint64(x)) <= radius].tolist():
                if y not in root:
                    root[y] = start
                    todo.append(y)
    least = {}
    for (i, _, _), f in zip(rows, fps, strict=True):
        r = root[f]
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, f"{f:016x}", least[root[f]]) for (i, _, _), f in zip(rows, fps, strict=True)]


COLS8 = ("doc_id", "fingerprint", "component_id")


def test_simhash(docs, plain, odd, nothing):
    same(simhash.near_groups(docs), expected_components(plain), COLS8)
    same(simhash.near_groups(odd), expected_components(of(odd)), COLS8)
    assert simhash.near_groups(nothing).count() == 0
    assert simhash.drop_near(odd).columns == odd.columns


def test_simhash_agrees_with_the_engine(spark):
    text = "some words éà of a text"
    mine = xxhash.xxh64_intdigest(text.encode(), 42)
    theirs = spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t)").first()[0]
    assert mine == theirs % (1 << 64)


def crowd(rng, n):
    """Fingerprints in tight crowds, chains and at random."""
    out = []
    for _ in range(3):
        centre = rng.getrandbits(64)
        out += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(n)]
        x = centre
        for _ in range(n // 4):
            x ^= sum(1 << b for b in rng.sample(range(64), 4))
            out.append(x)
    return out + [rng.getrandbits(64) for _ in range(n)]


def brute(fps, radius):
    arr = np.array(sorted(set(fps)), np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= radius
    label = np.arange(len(arr))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(arr))])
        new = new[new]
        if (new == label).all():
            return {frozenset(arr[label == k].tolist()) for k in set(label.tolist())}
        label = new


def groups_of(spark, fps, **how):
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in set(fps)]
    frame = spark.createDataFrame(signed, "fp long")
    edges = simhash.near_links(frame, **how).collect()
    parent = {x: x for x in set(fps)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 64
        parent[max(find(a), find(b))] = min(find(a), find(b))
    out = defaultdict(set)
    for x in parent:
        out[find(x)].add(x)
    return {frozenset(g) for g in out.values()}


def test_links_lose_nothing(spark):
    fps = crowd(random.Random(9), 400)
    want = brute(fps, 4)
    assert groups_of(spark, fps) == want
    # Full files are filed again.
    assert groups_of(spark, fps, full=50) == want
    assert groups_of(spark, fps, radius=2, blocks=4) == brute(fps, 2)


def test_bit_sliced_comparison():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    fps[100:] = fps[:100] ^ np.uint64(0b10110) ^ (np.uint64(1) << np.arange(100, dtype=np.uint64) % np.uint64(60))
    planes = simhash._planes(fps)
    for radius in (1, 3, 4, 6):
        hits = simhash.within(planes[:, None, :], simhash._spread(fps)[:, :, None], radius)
        bits = np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")[:, :200].astype(bool)
        assert (bits == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all()


# Pipeline


def test_pipeline_stages(spark, sf_dir, docs):
    frame, before = docs, None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, frame = frame, stage(spark, frame, sf_dir)
        frame = corpus_pipeline.store(frame, f"test-{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
            assert 0 < frame.count()
    words = before.selectExpr("sum(regexp_count(text, '[^ \\\\t-\\\\r]+')) AS n").first()["n"]
    assert frame.selectExpr("sum(n_tokens) AS n").first()["n"] == words


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf_dir, odd, nothing):
    for start in (odd, nothing):
        frame = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            frame = corpus_pipeline.store(stage(spark, frame, sf_dir), f"odd-{i}")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert frame.columns == start.columns
        assert (frame.count() == 0) == (start is nothing)


def test_one_row_of_a_component_stays(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(900)}" for _ in range(400)]
    near = words[:399] + ["other"]
    rows = [(None, " ".join(words), "en", "a", 1)] * 40 + [(None, " ".join(near), "en", "a", 1)] * 3
    rows += [(5, "alone here with words of its own", "en", "a", 1)] * 2 + [(6, None, "en", "a", 1), (7, "", "en", "a", 1)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    assert simhash.near_groups(docs).select("component_id").distinct().count() == 3
    kept = simhash.drop_near(docs)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [5, 6, None]
