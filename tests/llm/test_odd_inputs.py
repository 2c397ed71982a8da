"""Nulls, empty and long texts, repeats, clashing columns and empty tables for every operator and stage."""

import datetime

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from airzone.llm import chat, hyperminhash, mixing, pieces, quality, surrogates, tiles, toxicity, urlfilter, warc
from airzone.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, r string, tokens long, node long, component string"
LONG = " ".join(f"word{i}" for i in range(30_000)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    text = "The quick brown fox jumps over the lazy dog while many other animals look at it and say nothing at all today."
    rows = [(1, text, "en", "src1"), (1, text, "en", "src1"), (2, text + " Or do they.", None, None), (3, None, "en", "src1"), (4, "", "en", "src2"),
            (None, text, "de", "src1"), (5, LONG, "en", "src1"), (6, LONG + " more.", "en", "x"), (7, " \n\t ", "en", "src1"), (None, None, None, None)]
    return spark.createDataFrame([(*r, 5, "clash", 1, 2, "c") for r in rows], DOCS)


def test_quality(odd):
    rows = quality.judged(odd).collect()
    assert len(rows) == 10
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.doc_id in (3, 4, 7))
    assert all(r.kept for r in rows if r.doc_id in (1, 2, 5, 6)) and quality.judged(odd.limit(0)).count() == 0
    assert next(r for r in rows if r.doc_id == 3).cleaned is None


def test_near_duplicates(odd):
    got = {(r.doc_id, r.n_shingles): r for r in hyperminhash.near_duplicates(odd).collect()}
    assert got[5, 29_998].kept and got[6, 29_999].component_id == 5 and not got[6, 29_999].kept
    assert got[2, 23].component_id == 1 and got[3, 0].kept and got[4, 0].component_id == 4
    assert got[None, 20].component_id is None and got[None, 20].kept
    assert hyperminhash.near_duplicates(odd).count() == 10 and hyperminhash.near_duplicates(odd.limit(0)).count() == 0


def test_surrogates(spark, odd):
    assert surrogates.surrogated(odd, "k").select(*odd.columns).exceptAll(odd).count() == 0
    assert surrogates.surrogated(odd.limit(0), "k").count() == 0
    rows = spark.createDataFrame([(1, "Frau Anna Berg, frau@a.de FRAU@A.DE +49 (30) 1234-5678 / +49-30-1234-5678 4111 1111 1111 1111 1234567812345678"),
                                  (2, "госпожа Анна, Mr Anna Berg; 10.0.0.1 10.0.0.2")], "doc_id long, text string")
    a, b = [r.text for r in surrogates.surrogated(rows, "k").orderBy("doc_id").collect()]
    words = a.split()
    assert a.startswith("Frau ") and words[3].lower() == words[4].lower() and words[4].isupper()
    assert "1234567812345678" in a and "4111 1111" not in a and b.startswith("госпожа ") and "10.0.0." not in b
    phones = [x for x in (a.split(" / ")[0].split("+")[1], a.split(" / +")[1].split(" ")[0])]
    assert [*filter(str.isdigit, phones[0])] == [*filter(str.isdigit, phones[1])]


def test_collisions_take_the_next_attempt(spark):
    many = spark.range(3000).select(F.lit("ip").alias("kind"), F.concat(F.lit("10.0."), (F.col("id") / 250).cast("int"), F.lit("."), (F.col("id") % 250)).alias("canon"))
    made = surrogates.distinct_surrogates(many, "k").collect()
    assert len({r.made for r in made}) == 3000 and not {r.made for r in made} & {r.canon for r in made}


def test_mixing(odd):
    rows = mixing.mixed(odd, F.lit("d"), odd["lang"], odd["source"], mixing.Mix(share=50, epochs=2, slice_rows=2)).collect()
    total = sum(len((r.text or "").split()) for r in odd.collect())
    # the copies of id 1 share their room, so a budget may be passed by them alone
    assert total * 50 // 100 <= sum(r.taken for r in rows) <= total * 50 // 100 + 21 and all(r.n_tokens > 0 for r in rows)
    assert mixing.mixed(odd.limit(0), F.lit("d"), F.col("lang"), F.col("source")).count() == 0


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 100), ("b", "z", 100)], "domain string, lang string, tokens long").withColumn("source", F.lit("s"))
    mix = mixing.Mix(budget=120, epochs=1, usual=1)
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves, ["domain", "lang", "source"], mix).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 50, ("b", "z"): 60}
    short = mixing.Mix(budget=200, epochs=1, usual=1, weights={("a",): 1, ("b",): 3})
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves, ["domain", "lang", "source"], short).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}


def test_pieces_and_toxicity(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.encoded(odd, path).collect()
    assert len(rows) == 10 and all(r.n_tokens == 2 for r in rows if r.doc_id in (3, 4)) and pieces.encoded(odd.limit(0), path).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd, none).collect()
    assert len(rows) == 10 and all(r.score == 0 and r.predicted == 0 for r in rows)


def test_archive(spark):
    rows = [(1, "http://a.example.com/", "x"), (2, None, None), (3, "::bad", ""), (1, "http://a.example.com/", "x"), (None, "http://b.example.com", "x"), (9, "http://a.example.com/ é\n", "x" * 100_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string")
    got = warc.archived(pages).collect()
    kind = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert len(got) == 6 and kind == {(1, "response", None), (2, "revisit", 3), (3, "response", None), (None, "revisit", 1), (9, "response", None)}
    assert warc.archived(pages.limit(0)).count() == 0


def test_url_lists(spark):
    day = lambda d: datetime.date(2024, 1, d)
    captures = spark.createDataFrame([(1, "http://u@WWW.Bad.example.com:80/x", day(5)), (1, "http://u@WWW.Bad.example.com:80/x", day(5)), (2, "http://bad.example.com/ok/1", day(5)),
                                      (3, None, day(5)), (4, "nonsense", day(5)), (5, "http://bad.example.com", None), (6, "http://notbad.example.com", day(5)), (7, "http://bad.example.com", day(9))],
                                     "page_id long, url string, fetched date")
    events = spark.createDataFrame([("BAD.example.com", "add", day(2), "a"), ("bad.example.com", "remove", day(9), "a"), ("bad.example.com/ok/", "add", day(5), "b"),
                                    (None, "add", day(1), "n"), ("x", "add", None, "n"), ("bad.example.com", "add", day(2), "a")], "entry string, action string, since date, category string")
    got = {(r.page_id, r.listed, r.category) for r in urlfilter.as_of(captures, events).collect()}
    assert got == {(1, True, "a"), (2, True, "b"), (3, False, None), (4, False, None), (5, False, None), (6, False, None), (7, False, None)}
    assert urlfilter.as_of(captures, events.limit(0)).where("listed").count() == 0 and urlfilter.as_of(captures.limit(0), events).count() == 0


def test_chat_round_trip_and_trees(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "[\\INST]", "<<SYS>>", "[ROLE]x[/ROLE]", "<<s>", None, "", "[INST\\]", "\\\\<s>\\"]
    rows = [(i // 4, i, role, t) for i, (role, t) in enumerate((r, t) for t in odd for r in ("user", "assistant", "system", None, "[ROLE]"))]
    got = chat.formatted_paths(chat.conversations_as_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    back = {r.c: [(t.role, t.text) for t in r.turns] for r in got.select(F.col("path.conv").alias("c"), chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert back == {c: [(r or "", t or "") for k, _, r, t in rows if k == c] for c in {r[0] for r in rows}}
    nodes = spark.createDataFrame([(1, None, 0.0), (2, 1, 1.0), (3, 1, 2.0), (4, 2, 5.0), (5, 3, 1.0), (9, 8, 0.0), (8, 9, 0.0)], "node long, parent long, score double")
    best = sorted((r.depth, r.node) for r in chat.best_paths(nodes).collect())
    assert best == [(0, 1), (1, 2), (2, 4)]
    assert {r.path for r in chat.best_paths(nodes, per_root=5).collect()} == {4, 5}
    assert chat.formatted_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.01], 2), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, None, 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1),
            (9, [1.0, None], 1), (2, [2.0, 0.0], 1), (None, [3.0, 0.1], 1), (10, [1.0], 1), (11, [1e200, 0.0], 1), (12, [], 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in tiles.near_vectors(df).collect()}
    assert got == {(1, 4, 1, True), (2, 4, 1, False), (11, 4, 1, False), (None, 4, 1, False)} | {(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12)}
    assert tiles.near_vectors(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert components(chain).agg(F.count("*"), F.max("component")).first() == (301, 0)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, name, stage):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    out, none = stage(spark, docs, ""), stage(spark, docs.limit(0), "")
    ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=lambda i: (i is None, i))
    every = [1, 1, 2, 3, 4, 5, 6, 7, None, None]
    assert none.count() == 0
    if name == "quality rules":
        assert ids == [1, 1, 2, 5, 6, None]
    elif name == "near duplicates":        # 1 is there twice with one text, 2 and 6 are near copies
        assert ids == [1, 3, 4, 5, 7, None, None]
    elif name == "mixing":
        assert ids and set(ids) <= set(every) - {3, 4, 7}
    else:
        assert ids == every
    if name != "sentence pieces":
        assert out.columns == docs.columns
