"""Search, tree and language operators against plain Python and SQL."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import COLUMNS, of, prose, same
from pyspark.sql import functions as F

from turnledger.llm import language, lexical_search, merkle, queries, sha_states
from turnledger.llm.common import fold_ascii

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

# Search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def expected_search(docs, items, k=50):
    counts = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    total, words = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for key, text in items:
        asked = {t for t in TERM.findall((text or "").translate(FOLD)) if t in df}
        found = []
        for i, c, n in counts:
            m = 50 + (50 * n * total) // words
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in asked
                if c[t]
            )
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(key, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


COLS11 = ("item_id", "rank", "doc_id", "score")


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_search_on_odd_rows(spark, odd):
    rng = random.Random(3)
    asked = [(i, prose(rng, 30)) for i in range(12)]
    asked += [(20, None), (21, " ,; "), (None, "ONE two"), (22, "É la À"), (23, "nowhere"), (24, "a b c example ORG mail"), (24, "tail")]
    texts = [(i, t) for i, t, _ in of(odd)]
    got = lexical_search.search(odd, items_of(spark, asked), k=7)
    same(got, expected_search(texts, asked, 7), COLS11)


def test_search_in_query_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(lexical_search, "QUERY_ROWS", 2)
    rng = random.Random(4)
    asked = [(i, prose(rng, 20)) for i in range(5)]
    same(lexical_search.search(odd, items_of(spark, asked), k=5), expected_search([(i, t) for i, t, _ in of(odd)], asked, 5), COLS11)


def test_search_ties_and_copies(spark):
    rng = random.Random(6)
    base, other = prose(rng, 80), prose(rng, 60)
    rows = [(i, base if i % 3 else other + f" u{i}", "en", "s", 1) for i in range(900)] + [(5, base, "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    asked = [(1, " ".join(base.split()[:20])), (2, " ".join(other.split()[:25])), (3, "u30 u60 " + base[:60])]
    same(lexical_search.search(docs, items_of(spark, asked)), expected_search([r[:2] for r in rows], asked), COLS11)


def test_search_of_and_in_nothing(spark, odd, nothing):
    assert lexical_search.search(nothing, items_of(spark, [(1, "a")])).count() == 0
    assert lexical_search.search(odd, items_of(spark, [])).count() == 0
    assert set(lexical_search.search(nothing, items_of(spark, [])).columns) == set(COLS11)


def test_bounds_are_never_below_the_score_and_exclude_most(spark, docs, sf_dir):
    index = lexical_search.build(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(20).collect()
    asked = lexical_search.ask(index, [lexical_search.terms(r["text"].encode()) for r in items])
    bounds = lexical_search.Bounds(asked)
    exact = expected_search(docs.select("doc_id", "text").collect(), [(i, r["text"]) for i, r in enumerate(items)], 10**9)
    exact = {(q, i): s for q, _, i, s in exact}
    over = seen = 0
    for ids, _, found in lexical_search._each_block(index.blocks.toArrow().to_batches(), bounds):
        for q in range(len(items)):
            for i, b in zip(ids, found[q], strict=True):
                assert b >= exact.get((q, i), 0)
                seen += 1
                over += b > 1.5 * exact.get((q, i), 0) + 1e6
    assert seen == 20 * index.docs and over < 0.5 * seen


def test_equal_whatever_the_layers_and_block_sizes(spark, docs, sf_dir, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, lexical_search.search(docs, items).collect()))
    # a local session runs the tasks in other processes: only what is sent changes
    again = sorted(map(tuple, lexical_search.search(docs.repartition(7), items, index=lexical_search.build(docs.repartition(3))).collect()))
    assert whole == again == sorted(expected_search(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect()))


# Trees


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climbed(tree, at, fresh):
    siblings = []
    for level in tree[:-1]:
        base = at // 16 * 16
        run = level[base : base + 16]
        siblings += run[: at - base] + run[at - base + 1 :]
        run[at - base] = fresh
        fresh, at = sha("".join(run)), at // 16
    return siblings, fresh


def expected_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            fresh = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                fresh = leaf((*r[:4], r[4].translate(FOLD)))
            below, fold = climbed(trees[s], i, fresh)
            above, fold = climbed(top, k, fold)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, sha("".join(below + above)), fold, fold == root))
    return out


COLS12 = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def tampered(docs):
    when = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return merkle.verify(merkle.leaves(docs, changed={"text": fold_ascii(F.col("text"))}, when=when))


def hashed_fields(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_states_equal_hashlib():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    words = sha_states.words(raw)
    assert (sha_states.raw(words) == raw).all()
    state = sha_states.start(5000)
    for k in range(1, 4):
        state = sha_states.absorb(state, sha_states.hex_blocks(words))
        got = sha_states.raw(sha_states.finish(state, np.full(5000, k)))
        for i in (0, 1, 4095, 4096, 4999):
            assert got[i].tobytes() == hashlib.sha256(raw[i].tobytes().hex().encode() * k).digest()


def test_manifest_of_odd_rows(odd):
    same(tampered(odd), expected_manifest(hashed_fields(odd)), COLS12)


@pytest.mark.parametrize("sizes", [(1,), (1, 1, 2), (16, 17, 15), (256, 257, 1), (4096, 4097, 3), (4096 * 16 + 1, 40)])
def test_manifest_of_many_shapes(spark, sizes):
    rows = [
        (i * 7 + 1, f"Text {k} {i}" if i % 11 else None, "en", f"s{k}" if k else None, i) for k, n in enumerate(sizes) for i in range(n)
    ]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(6)
    same(tampered(docs), expected_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows]), COLS12)


def test_manifest_of_many_sources(spark):
    rows = [(i, f"T{i}", "en", f"s{i}", 1) for i in range(300)] + [(9, "T", None, None, None)] * 40
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    same(tampered(docs), expected_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows]), COLS12)


def test_manifest_of_nothing(nothing):
    out = tampered(nothing)
    assert out.count() == 0 and set(out.columns) == set(COLS12)


def test_manifest_finds_one_changed_row(spark, docs):
    one = docs.select("doc_id").orderBy("doc_id").first()[0]
    changed = merkle.leaves(docs, changed={"text": F.concat("text", F.lit("!"))}, when=F.col("doc_id") == one)
    assert [r["doc_id"] for r in merkle.verify(changed).where("NOT verified").collect()] == [one]


@pytest.mark.parametrize("name", ["op11_bit_sliced_search", "op12_merkle_manifest"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    same(queries.QUERIES[name](spark, sf_dir), cursor.fetchall(), columns)


# Languages

NGRAM_N, BITS = language.MAX_N, language.BUCKET_BITS


def bucket(gram):
    mixed, wide = 0, (1 << 64) - 1
    for c in gram:
        mixed = ((mixed ^ ((0 if c == " " else ord(c)) + 0x9E3779B97F4A7C15) & wide) * 0xD6E8FEB86659FD93) & wide
        mixed ^= mixed >> 29
    return ((mixed * 0x9E3779B97F4A7C15) & wide) >> (64 - BITS)


def grams(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    for word in low.split():
        padded = f" {word} "
        for n in range(1, NGRAM_N + 1):
            for i in range(len(padded) - n + 1):
                if padded[i : i + n].strip():
                    yield bucket(padded[i : i + n])


def expected_languages(rows):
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts, texts = defaultdict(Counter), Counter()
    for i, t, lang in rows:
        if lang is not None and t is not None and not out_of(i):
            counts[lang].update(grams(t))
            texts[lang] += 1
    langs = sorted(texts, key=str.encode)
    size = {g: sum(counts[g].values()) + 0.5 * (1 << BITS) for g in langs}
    out = []
    for i, t, _ in rows:
        found = Counter(grams(t or ""))
        if not found or not langs:
            out.append((i, out_of(i), "und", 0.0))
            continue
        logs = [
            math.log(texts[g] / sum(texts.values())) + sum(n * math.log((counts[g][b] + 0.5) / size[g]) for b, n in found.items())
            for g in langs
        ]
        best = max(range(len(langs)), key=lambda k: (logs[k], -k))
        out.append((i, out_of(i), langs[best], round(1 / sum(math.exp(x - logs[best]) for x in logs), 6)))
    return out


def by_row(rows):
    return sorted(((i is not None, i or 0, h, p, s) for i, h, p, s in rows), key=repr)


def agrees(got, expected):
    for a, b in zip(by_row(got), by_row(expected), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-5


def predicted(docs):
    out = language.identify(docs)
    return [tuple(r) for r in out.select("doc_id", "held_out", "lang_pred", "score").collect()]


def test_languages_on_odd_rows(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()]
    agrees(predicted(odd), expected_languages(rows))


def test_languages_of_texts_with_all_letters(spark):
    words = {"el": "Σας ευχαριστώ ΠΟΛΎ", "zh": "我们 在 学习 中文", "tr": "İstanbul ığdır güneş", "sw": "habari ya asubuhi", "go": "𐌲𐌿𐍄 𐌹𐍃"}
    rng = random.Random(8)
    rows = []
    for i in range(200):
        lang = sorted(words)[i % 5]
        rows.append((i, " ".join(rng.choices(words[lang].split(), k=1 + i % 9)) + ",1!"[: i % 4], lang, "s", 1))
    rows += [(900, "1234 -- ²", "el", "s", 1), (901, None, "el", "s", 1), (902, "x" * 50, None, "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    agrees(predicted(docs), expected_languages([(r[0], r[1], r[2]) for r in rows]))


def test_long_texts_in_pieces(spark, monkeypatch):
    text = " ".join(f"wort{i % 97}größe" for i in range(40_000)) + "y" * 3000
    whole = language._points(text)
    pieces = [language._points(p) for p in language._pieces(text, 1000)]
    assert len(pieces) > 100 and "".join(language._pieces(text, 1000)) == text
    count = lambda parts: Counter(b for p in parts for g, _ in language._grams(p, 4, 16) for b in g.tolist())
    assert count([language._points(" ".join(["abc"] * 5000))]) == count(
        [language._points(p) for p in language._pieces(" ".join(["abc"] * 5000), 700)]
    )
    assert sum(count(pieces).values()) - sum(count([whole]).values()) < 50


def test_languages_without_teachers(spark, nothing, odd):
    assert predicted(nothing) == []
    untaught = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {(p, s) for _, _, p, s in predicted(untaught)} == {("und", 0.0)}


def test_held_out_accuracy(docs):
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = out.select("lang", "lang_pred").collect()
    assert len(rows) > 20 and sum(r[0] == r[1] for r in rows) >= 0.97 * len(rows)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MODEL_BYTES", 1 << 20)
    docs = spark.createDataFrame([(i, "abc", f"l{i}", "s", 1) for i in range(8)], COLUMNS)
    with pytest.raises(ValueError, match="languages"):
        language.identify(docs)


