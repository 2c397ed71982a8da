"""Reply trees against brute force, and rows that share an id, a payload, a column's name or a cycle."""

import random

import pytest
from pyspark.sql import functions as F

from airzone.llm import chat, common, mixing, surrogates, warc


def brute_force_paths(nodes, per_root):
    """(path, root, rank, score, depth, node) by walking up from every leaf; nodes that reach no root are left out."""
    parent = {n: p if p in {m for m, _, _ in nodes} else None for n, p, _ in nodes}
    own = {n: s for n, _, s in nodes}
    found = {}
    for leaf in set(parent) - set(parent.values()):
        walk = [leaf]
        while walk[-1] is not None and len(walk) <= len(parent):
            walk.append(parent[walk[-1]])
        if walk[-1] is None:
            walk = walk[:-1][::-1]
            found.setdefault(walk[0], []).append((-sum(own[n] for n in walk), leaf, walk))
    return {(leaf, root, rank, -score, depth, node) for root, paths in found.items()
            for rank, (score, leaf, walk) in enumerate(sorted(paths)[:per_root], 1) for depth, node in enumerate(walk)}


@pytest.mark.parametrize("per_root", [1, 3])
def test_reply_trees_match_brute_force(spark, per_root):
    draw = random.Random(per_root)
    nodes = [(n, None if n < 5 else draw.randrange(n) if n % 11 else 10 ** 6 + n, float(draw.randrange(-4, 5))) for n in range(150)]
    nodes += [(200, 203, 1.0), (201, 200, 1.0), (202, 201, 1.0), (203, 202, 1.0), (204, 201, 9.0)]      # a cycle and a reply to it
    got = chat.best_paths(spark.createDataFrame(nodes, "node long, parent long, score double"), per_root).collect()
    assert {(r.path, r.root, r.rank, r.score, r.depth, r.node) for r in got} == brute_force_paths(nodes, per_root)


def test_a_cycle_costs_one_more_round(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(chat, "stage", lambda df, name: stored.append(name) or common.stage(df, name))
    chain = [(n, n - 1 if n else None, 0.0) for n in range(8)]
    cycle = [(100, 101, 0.0), (101, 100, 0.0)]
    counts = []
    for nodes in (chain, chain + cycle, cycle):
        stored.clear()
        rows = chat.best_paths(spark.createDataFrame(nodes, "node long, parent long, score double")).count()
        counts.append((rows, stored.count("reply-level")))
    assert counts[0][0] == counts[1][0] == 8 and counts[2][0] == 0
    assert counts[1][1] <= counts[0][1] + 1 and counts[2][1] == 2


@pytest.mark.parametrize("seed", ["a", "b", "c", "d", "e", "f"])
def test_rows_that_share_an_id_stay_within_the_budget(spark, seed):
    rows = [(1, "a b c d e"), (1, "f g h i j"), (2, "k l m n o"), (None, "p q r"), (None, "s t"), (None, "u v w x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for budget in (3, 7, 15, 24):
        taken = [r.taken for r in mixing.mixed(docs, F.lit("d"), F.lit("l"), F.lit("s"), mixing.Mix(budget=budget, seed=seed)).collect()]
        assert budget - 2 <= sum(taken) <= budget and min(taken) > 0


def test_a_column_named_like_the_count_stays(spark):
    docs = spark.createDataFrame([(1, "write to ann@site.org", 7, 8)], "doc_id long, text string, n_entities int, n_entities_ int")
    row = surrogates.surrogated(docs, "k").first()
    assert (row.n_entities, row.n_entities_, row["n_entities__"]) == (7, 8, 1) and "ann@" not in row.text


def test_payloads_are_marked_alike_sent_or_shuffled(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", None if i % 5 == 0 else f"<p>{i % 7}</p>") for i in range(60)], "page_id long, url string, html string")
    seen = lambda: sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archived(pages).collect())
    sent = seen()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert seen() == sent and len(sent) == 60
    last = {}
    for i in range(60):
        last[None if i % 5 == 0 else i % 7] = i
    assert sent == [(i, *(("response", None) if last[k] == i else ("revisit", last[k]))) for i, k in ((i, None if i % 5 == 0 else i % 7) for i in range(60))]


def test_mixing_leaves_texts_where_they_are(spark, no_broadcast):
    """The rows of a cut leaf are compared with its edge alone, however many documents are chosen of it."""
    docs = spark.createDataFrame([(i % 400 if i % 9 else None, "w " * (1 + i % 7), "en", f"src{i % 3}") for i in range(900)], "doc_id long, text string, lang string, source string")
    got = mixing.mixed(docs, F.lit("d"), docs["lang"], docs["source"], mixing.Mix(share=40, epochs=2, slice_rows=50))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "id_" not in plan and plan.count("Join") == 3          # plan, slices and edges, each a row per leaf or slice
    edges = got.where("taken < n_tokens").groupBy("source").agg(F.countDistinct(F.coalesce("r.doc_id", F.lit(-1))).alias("n")).collect()
    assert all(r.n == 1 for r in edges)
    short = docs.withColumn("n", F.size(F.split(F.trim("text"), " "))).agg(F.sum("n")).first()[0] * 40 // 100 - got.agg(F.sum("taken")).first()[0]
    assert 0 <= short < 300
