"""Stored indexes: what they skip, and that nothing is lost by it."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from turnledger.plans import index, retrieval, vectors
from turnledger.sources import canonical as c


def _texts(n, seed=1):
    """Prose in groups that share few words, with lengths far apart."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = i % 6
        size = rng.choice((5, 20, 60, 200))
        rows.append((i, " ".join(f"g{group}w{int(rng.paretovariate(0.6)) % 900}" for _ in range(size))))
    return rows + [(n, None), (n + 1, ""), (n + 2, "?!")]


def _index(spark, rows, folder):
    index.write_index(spark.createDataFrame(rows, "passage_id long, content string").repartition(4), str(folder))
    return index.open_index(spark, str(folder))


def _queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query string")


def _plain_bm25(rows, queries, k):
    counts = {i: Counter((t or "").lower().split()) for i, t in rows}
    counts = {i: Counter({w: n for w, n in c.items() if w.isalnum()}) for i, c in counts.items()}
    mean = sum(sum(c.values()) for c in counts.values()) / len(rows)
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for q, text in queries:
        found = []
        for i, held in counts.items():
            length = sum(held.values())
            score = sum(
                math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * held[w] * 2.2 / (held[w] + 1.2 * (0.25 + 0.75 * length / mean))
                for w in set(text.lower().split())
                if held[w]
            )
            if score:
                found.append((-round(score, 6), i))
        out[q] = [i for _, i in sorted(found)[:k]]
    return out


def test_blocks_are_skipped_and_the_best_passages_found(spark, tmp_path):
    rows = _texts(600)
    rng = random.Random(2)
    asked = [(q, " ".join(rng.sample(rows[rng.randrange(600)][1].split(), 4))) for q in range(20)]
    table, queries = _index(spark, rows, tmp_path / "i"), _queries(spark, asked)
    terms = index.weighted_terms(table, queries)
    bounds, reached = index.block_bounds(table, terms), index.reached_blocks(table, terms, 3)
    assert 0 < reached.count() < 0.7 * bounds.count()
    got = defaultdict(list)
    for r in retrieval.bm25_search(table, queries, 3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["passage_id"])
    assert dict(got) == {q: found for q, found in _plain_bm25(rows, asked, 3).items() if found}


def test_bounds_hold_for_every_passage(spark, tmp_path):
    table, queries = _index(spark, _texts(200), tmp_path / "i"), _queries(spark, [(1, "g0w1 g0w2 g1w1"), (2, "g3w1 nothing")])
    terms = index.weighted_terms(table, queries)
    blocks = table.postings.select("block", F.inline("postings")).select("block", "passage_id").distinct()
    held = index.score(table, terms).join(blocks, "passage_id").join(index.block_bounds(table, terms), ["query_id", "block"])
    assert held.count() == index.score(table, terms).count() > 0
    assert held.where(F.col("bm25") > F.col("bound") + index.ROUNDING).count() == 0


def test_blocks_hold_few_passages(spark, tmp_path):
    table = _index(spark, _texts(300), tmp_path / "i")
    each = table.postings.select("block", F.inline("postings")).groupBy("block").agg(F.countDistinct("passage_id").alias("n"))
    assert each.agg(F.max("n")).first()[0] <= 1 << index.BLOCK_BITS and table.passages == 303


def test_an_index_of_nothing(spark, tmp_path):
    table, queries = _index(spark, [(1, None)], tmp_path / "i"), _queries(spark, [(1, "word")])
    assert retrieval.bm25_search(table, queries).count() == 0
    assert retrieval.hybrid_search(table, queries).count() == 0


def test_an_index_is_built_once_for_a_table_and_anew_for_a_changed_one(spark, tmp_path):
    path = str(tmp_path / "documents")
    spark.createDataFrame(_texts(30), "doc_id long, text string").write.parquet(path)
    read = lambda: spark.read.parquet(path).select(F.col("doc_id").alias("passage_id"), F.col("text").alias("content"))
    first = index.index_of(spark, path, read())
    again = index.index_of(spark, path, read())
    assert first.postings.inputFiles() == again.postings.inputFiles()
    spark.createDataFrame(_texts(10, 5), "doc_id long, text string").write.mode("append").parquet(path)
    changed = index.index_of(spark, path, read())
    assert changed.passages == first.passages + 13 and changed.postings.inputFiles() != first.postings.inputFiles()


def test_fused_heads_equal_full_ranks(spark):
    """Ties, queries with few and with many pairs, and lists that disagree."""
    rng = random.Random(9)
    rows = []
    for q, n in ((1, 3), (2, 25), (3, 900), (4, 2500)):
        for p in rng.sample(range(10_000), n):
            bm25 = round(rng.choice((rng.random() * 30, 5.0, 5.015625)), 6)
            semantic = round(1 - bm25 / 40 if q == 4 else rng.choice((0.25, 0.5, rng.random())), 6)
            rows.append((q, p, bm25, semantic, 0.5))
    kinds = "query_id long, passage_id long, bm25 double, semantic double, coverage double"
    scored = spark.createDataFrame(rows, kinds).repartition(6)
    for candidates in (5, 20):
        want = set()
        for q in (1, 2, 3, 4):
            mine = [r for r in rows if r[0] == q]
            ranks = {}
            for by in (2, 3):
                for n, r in enumerate(sorted(mine, key=lambda r: (-r[by], r[1])), 1):
                    ranks.setdefault(r[1], []).append(n)
            fused = sorted(((-round(1 / (60 + a) + 1 / (60 + b), 9), p, a, b) for p, (a, b) in ranks.items()))
            want |= {(q, p, a, b, -f, n) for n, (f, p, a, b) in enumerate(fused[:candidates], 1)}
        got = retrieval.fused_ranks(scored, candidates).select(
            "query_id", "passage_id", "bm25_rank", "semantic_rank", "fused_score", "fused_rank"
        )
        assert {tuple(r) for r in got.collect()} == want


def test_fusion_never_orders_all_pairs(spark):
    scored = spark.createDataFrame([(1, 2, 3.0, 0.5, 1.0)], "query_id long, passage_id long, bm25 double, semantic double, coverage double")
    plan = retrieval.fused_ranks(scored, 5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # the windows left are over steps of the scores and over survivors
    assert windows and all("fused_score" in w or "step" in w for w in windows)


def test_short_texts_meet_on_rare_characters(spark):
    passages = spark.createDataFrame(
        [(i, "the tea on the table " * 3 + f"é{i}") for i in range(30)] + [(90, "x#y"), (91, "t"), (92, None), (93, "")],
        "passage_id long, content string",
    )
    queries = _queries(spark, [(1, "t"), (2, "x#"), (3, "x#y"), (4, "on the tea"), (5, "the table é7"), (6, "zz"), (7, ""), (8, "é")])
    brute = {
        (q["query_id"], p["passage_id"])
        for q in queries.collect()
        for p in passages.collect()
        if p["content"] and q["query"] and q["query"] in p["content"]
    }
    assert {tuple(r) for r in retrieval.planted_pairs(passages, queries).collect()} == brute


# Vectors


def _cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def _found(spark, rows, queries, k, folder, cells=16):
    table = _vectors(spark, rows)
    vectors.write_index(table, str(folder), "vec_id", "embedding", cells)
    asked = spark.createDataFrame(queries, "query_id long, query_vector array<double>")
    opened = vectors.open_index(spark, str(folder))
    got = defaultdict(list)
    for r in vectors.vector_search(opened, table, asked, k).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["similarity"]))
    return dict(got), opened


def test_nearest_vectors_equal_brute_force_and_few_are_read_in_full(spark, tmp_path):
    rng = random.Random(3)
    heads = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in heads[i % 12]]) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(40)]  # copies tie by id
    queries = [(q, [x + rng.gauss(0, 0.2) for x in heads[q]]) for q in range(6)] + [(6, rows[7][1])]
    got, opened = _found(spark, rows, queries, 10, tmp_path / "v")
    for q, vector in queries:
        want = sorted(((-round(_cosine(vector, v), 6), i) for i, v in rows))[:10]
        assert got[q] == [(i, -s) for s, i in want]
    read = vectors.candidates(opened, [v for _, v in queries], 10).groupBy("query").count().collect()
    assert max(r["count"] for r in read) < 0.1 * len(rows)


def test_whole_cells_are_left_out(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [math.cos(i % 8) + rng.gauss(0, 0.01), math.sin(i % 8) + rng.gauss(0, 0.01), 0.5]) for i in range(800)]
    _, opened = _found(spark, rows, [(1, [1.0, 0.0, 0.5])], 3, tmp_path / "v", cells=8)
    sent = spark.sparkContext.broadcast((vectors._matrix(pa.array([[1.0, 0.0, 0.5]]), 3), opened.centres))
    batches = opened.codes.orderBy("cell", "key").toArrow().to_batches(max_chunksize=50)
    scored = sum(b.column("scored").to_pylist()[0] for b in vectors._kept(iter(batches), sent, 3))
    assert 3 <= scored < 0.5 * len(rows)


def test_vectors_without_a_direction_have_no_similarity(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, 0.1]), (5, [1.0, None])]
    got, _ = _found(spark, rows, [(1, [1.0, 0.0])], 5, tmp_path / "v")
    assert got[1] == [(1, 1.0), (2, 0.0), (3, 0.0), (5, 0.0), (4, -0.995037)]
    few, _ = _found(spark, rows, [(1, [1.0, 0.0])], 2, tmp_path / "w")
    assert [i for i, _ in few[1]] == [1, 2]


def test_many_query_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(100)]
    queries = [(q, rows[q][1]) for q in range(7)]
    whole, _ = _found(spark, rows, queries, 3, tmp_path / "v")
    monkeypatch.setattr(vectors._blocks, "__defaults__", (2,))
    assert _found(spark, rows, queries, 3, tmp_path / "w")[0] == whole


def test_indexes_of_the_given_tables(spark, sf_dir):
    table = index.index_of(spark, f"{sf_dir}/documents.parquet", c.passages(spark, sf_dir))
    assert table.passages == c.passages(spark, sf_dir).count()
    assert vectors.index_of(spark, f"{sf_dir}/embeddings.parquet").codes.count() == c.table(spark, sf_dir, "embeddings").count()
