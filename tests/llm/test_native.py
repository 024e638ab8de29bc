"""The operators written in column expressions against plain Python."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import CLASHING, COLUMNS, of, same
from pyspark.sql import functions as F

from turnledger.llm import exact_dedup, mixing, packing, pii
from turnledger.llm.common import UPPER, text_of, word_count

FOLD = str.maketrans(UPPER, UPPER.lower())
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Exact dedup


def expected_groups(rows):
    digest = lambda t: hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[digest(t)].append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return [
        (i, best[d], len(groups[d]), i == best[d], d) for i, t, _ in rows for d in [digest(t)]
    ]


COLS2 = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_groups(docs, plain, odd, nothing):
    same(exact_dedup.exact_groups(docs), expected_groups(plain), COLS2)
    same(exact_dedup.exact_groups(odd), expected_groups(of(odd)), COLS2)
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_exact_groups_keep_the_smallest_too(docs, plain):
    small = {r["text_sha256"]: r["keep_id"] for r in exact_dedup.exact_groups(docs, keep="min").collect()}
    for i, _, _, _, d in expected_groups(plain):
        assert small[d] <= i


def test_drop_copies_keeps_columns(odd, nothing):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    expected = Counter((i, t) for (i, t, _), e in zip(of(odd), expected_groups(of(odd)), strict=True) if e[3])
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == expected
    assert exact_dedup.drop_copies(nothing).count() == 0


def test_merge_is_the_same_for_any_tree(spark, docs):
    rows = exact_dedup.digests(docs, "doc_id", "text").repartition(13)
    flat = {tuple(r) for r in exact_dedup.tree_merge(rows, runs=4, fan_in=2).collect()}
    assert flat == {tuple(r) for r in exact_dedup.tree_merge(rows, runs=64, fan_in=8).collect()}


def test_contradicting_checks_fail(spark):
    rows = spark.createDataFrame([(1, "d", 5, 7), (2, "d", 6, 7)], "id long, digest string, n_bytes long, mark long")
    with pytest.raises(Exception, match="share a digest"):
        exact_dedup.tree_merge(rows).collect()


# Packing


def padding(counts, bounds):
    return sum(c * (min(b for b in bounds if b >= k) - k) for k, c in counts.items())


def test_bounds_are_optimal():
    counts = {1: 5, 3: 2, 4: 9, 7: 1, 8: 4, 12: 3, 13: 1}
    for k in range(1, 9):
        best = min(
            padding(counts, c)
            for n in range(1, k + 1)
            for c in itertools.combinations(counts, min(n, len(counts)))
            if max(c) == 13
        )
        bounds = packing.optimal_bounds(counts, k)
        assert len(bounds) <= k and padding(counts, bounds) == best
    assert packing.optimal_bounds({}, 4) == []


def check_packed(frame, rows, max_len=64, budget=256):
    got = packing.pack(frame, word_count(text_of("text")), max_len=max_len, token_budget=budget).collect()
    words = Counter()
    for r in got:
        words[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for i, t, _ in rows:
        want[i] += len(WORD.findall(t or ""))
    assert words == want
    batches = defaultdict(list)
    for r in got:
        assert (r["bucket"] is None) == (r["n_tokens"] == 0)
        if r["bucket"] is not None:
            assert r["n_tokens"] + r["padding"] == r["bucket_len"] <= max_len
            batches[r["bucket"], r["batch"]].append(r)
    for b in batches.values():
        assert sum(r["bucket_len"] for r in b) <= budget
        assert sorted(r["place"] for r in b) == list(range(len(b)))
    for bucket in {k for k, _ in batches}:
        full = [len(batches[b, n]) for b, n in sorted(batches) if b == bucket]
        assert len(set(full[:-1])) <= 1 and full[-1] <= full[0]
        assert sorted(n for b, n in batches if b == bucket) == list(range(len(full)))


def test_packing(docs, plain, odd, nothing):
    check_packed(docs, plain)
    check_packed(odd, of(odd))
    assert packing.pack(nothing, word_count(text_of("text"))).count() == 0
    with pytest.raises(ValueError):
        packing.pack(nothing, word_count(text_of("text")), max_len=10, token_budget=9)


# Mixing


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    open_ = set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return target


def check_mix(frame, rows, tolerance=0.02):
    got = mixing.mix(frame).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter(
        (i, size(t), s) for i, t, s in rows
    )
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    targets = expected_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], targets[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(tolerance * t, 3), (s, taken[s], t)


def test_mixing(docs, plain, odd, nothing):
    check_mix(docs, plain)
    check_mix(odd, of(odd))
    assert mixing.mix(nothing).count() == 0


def test_mix_reruns_agree(docs):
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    two = sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert one == two


def test_targets_stop_at_the_cap(spark):
    rows = [("a", 10), ("b", 1000), ("c", 5), (None, 100)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()
    want = expected_targets(dict(rows))
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


def test_permutation_is_one(spark):
    df = spark.range(1000).selectExpr("3 AS s", "0 AS epoch", "1000L AS blocks", "id AS at")
    blocks = [r["block"] for r in mixing.permuted(df).collect()]
    assert sorted(blocks) == list(range(1000)) and blocks != sorted(blocks)


def test_shard_draws_keep_totals_and_vary(spark):
    rows = [(0, 10, 7), (1, 100000, 300000), (2, 9, 1), (3, 50, 4096)]
    targets = spark.createDataFrame(rows, "s int, blocks long, slots long")
    got = mixing.shard_draws(targets, 5).collect()
    for s, _, slots in rows:
        mine = sorted((r["shard"], r["slots"], r["offset"]) for r in got if r["s"] == s)
        assert sum(n for _, n, _ in mine) == slots
        assert [o for _, _, o in mine] == list(itertools.accumulate([0] + [n for _, n, _ in mine[:-1]]))
    large = [r["slots"] for r in got if r["s"] == 1]
    spread = sum((n - 300000 / 32) ** 2 for n in large) / 32
    assert 0.3 < spread / (300000 / 32) < 3


def test_rows_that_repeat_are_all_delivered(spark):
    rng = random.Random(11)
    same_text = " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    rows = [(None, same_text, "en", "a", 1)] * 40
    rows += [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(50)), "en", "b", 1) for i in range(60)]
    frame = spark.createDataFrame(rows, COLUMNS).repartition(4)
    taken = {r["source"]: r["n"] for r in mixing.mix(frame).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    targets = expected_targets({"a": 40 * 60, "b": 60 * 50})
    words = Counter()
    for _, t, s in of(mixing.mixed_documents(frame)):
        words[s] += len(WORD.findall(t))
    assert words == taken
    assert all(abs(words[s] - targets[s]) <= 0.02 * targets[s] for s in targets)


def test_one_row_of_every_group_stays(spark, odd):
    text = "one two three four five six seven"
    rows = [(None, text, "en", "a", 1)] * 20 + [(None, text.upper(), "en", "b", 2)] * 20 + [(3, "x y", "en", "a", 1)] * 5
    rows += [(7, "p q r", "en", "a", 1), (9, "p q R", "en", "b", 1), (None, "p q r", "en", "a", 1)]
    frame = spark.createDataFrame(rows, COLUMNS).repartition(5)
    for keep, winner in (("max", 9), ("min", 7)):
        kept = [(r["doc_id"], r["text"].lower()) for r in exact_dedup.drop_copies(frame, keep=keep).collect()]
        assert sorted(kept, key=str) == sorted([(None, text), (3, "x y"), (winner, "p q r")], key=str)
    once = sorted(map(tuple, exact_dedup.drop_copies(frame).collect()), key=str)
    assert once == sorted(map(tuple, exact_dedup.drop_copies(frame.repartition(2)).collect()), key=str)
    texts = [(t or "").translate(FOLD) for _, t, _ in of(odd)]
    assert sorted((t or "").translate(FOLD) for _, t, _ in of(exact_dedup.drop_copies(odd))) == sorted(set(texts))


def test_merges_sort_their_runs(docs):
    rows = exact_dedup.digests(docs, "doc_id", "text")
    plan = exact_dedup.tree_merge(rows)._jdf.queryExecution().executedPlan().toString()
    # two rounds after the first runs: each sends ranges of runs to one place and sorts them
    assert "HashAggregate" not in plan
    assert plan.count("SortAggregate") == 6 and plan.count("Sort [range") >= 3
    assert plan.count("hashpartitioning(range") == 3


def test_mixed_documents_hold_the_words_taken(docs, odd, nothing):
    for frame in (docs, odd):
        mixed = mixing.mixed_documents(frame)
        assert mixed.columns == frame.columns
        words, taken = Counter(), Counter()
        for i, t, s in of(mixed):
            words[i, s] += len(WORD.findall(t))
        for r in mixing.mix(frame).collect():
            taken[r["doc_id"], r["source"]] += r["taken"]
        assert words == +taken
    assert mixing.mixed_documents(nothing).count() == 0


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = 0
        for k, d in enumerate(reversed(digits)):
            x = int(d) * (1 + k % 2)
            total += x - 9 if x > 9 else x
        return 13 <= len(digits) <= 19 and total % 10 == 0
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def expected_base(text):
    return {
        k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(k, m.group())]
        for k, p in PATTERNS.items()
    }


def check_pii(frame, rows):
    got = pii.digest(pii.find(frame)).collect()
    key = lambda r: tuple(r[f"n_{k}"] for k in PATTERNS) + (r["base_sha256"],)
    want = Counter()
    for i, t, _ in rows:
        base = expected_base(t)
        shown = ",".join(itertools.chain(*base.values()))
        want[i, *(len(v) for v in base.values()), hashlib.sha256(shown.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], *key(r)) for r in got) == want
    for r in got:
        base = [s for s in r["spans"].split(",") if s and not s.startswith("term")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


def test_protected_values(docs, plain, odd, nothing):
    check_pii(docs, plain)
    check_pii(odd, of(odd))
    assert pii.digest(pii.find(nothing)).count() == 0


def test_hard_matches(spark):
    texts = [
        "a@b.c%d@e.f x@y x@y.z. @a.b a@b..c a@-.-",
        "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.999 0001.1.1.1 1.1.1",
        "4111111111111111 4111 1111-1111 1111 41111111111111112345 12  4111111111111111 4111111111111111-",
        "+1 (415) 555-2671 +14155552671) +1 +12345678 +1234567890123456 ++1.555.123.4567",
        "é4111111111111111é 😀a@b.cé +4915112345678 1.1.1.1",
        "a." * 20000 + "@" + "b." * 20000 + "c",
        "1" * 50000 + " " + "1.1.1.1 " * 3000,
        "x@y.zz " * 3000,
    ]
    frame = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    check_pii(frame, of(frame))


def test_terms_that_disclose_are_generalised(spark):
    rows = [
        "reach Zorblat by zed@x.org today",
        "the desk of Zorblat, zed@x.org again",
        "Zorblat was seen in the city",
        "nothing here about the desk",
        "today the city sleeps and the desk is empty",
        "write zed@x.org to quixel the desk",
        "for quixel use zed@x.org in the city",
    ]
    rows += [f"the city today, again by the desk and in use: reach of {i} is write for" for i in range(9)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: r["found"] for r in pii.find(frame).collect()}
    spans = {i: [(s["kind"], rows[i][s["start"] : s["end"]]) for s in f] for i, f in found.items()}
    # Zorblat: 2 of 3 texts stand with the value, 0.58 bits; quixel: always with it.
    assert ("term", "Zorblat") in spans[2] and ("term", "Zorblat") in spans[0]
    assert ("term-removed", "quixel") in spans[5] and ("term-removed", "quixel") in spans[6]
    assert spans[3] == [] and spans[4] == []
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    assert clean[2] == "[TERM] was seen in the city"
    assert clean[6] == "for  use [EMAIL] in the city"
    assert clean[3] == rows[3]


def test_sanitise_keeps_columns_and_rows(odd):
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert set(CLASHING) <= set(out.columns)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[12] == "mail [EMAIL], ip [IP] card [CARD] tel [PHONE]."
