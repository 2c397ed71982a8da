"""Every training-data query against its SQL or a plain Python version, on the smallest tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import corpus_pipeline
from airzone.llm import hyperminhash, pieces, quality, surrogates, toxicity, warc
from airzone.llm.queries import MODEL, oracle_sql, queries
from oracle.compare import compare, connect

import public_tokenizers
from sentencepiece import SentencePieceProcessor


@pytest.fixture(scope="module")
def engine(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_matches_sql(spark, engine, folder, name):
    same, detail = compare(spark, engine, folder, queries()[name], oracle_sql()[name])
    assert same, detail


def brute_force_kept(texts, width, similarity):
    """Ids that are the smallest of their group, links by whole shingle sets."""
    sets = {}
    for i, text in texts.items():
        words = text.lower().split()
        sets[i] = {tuple(words[k:k + width]) for k in range(max(len(words) - width + 1, 1))}
    group = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    return {i for i in texts if group[i] == i}


def test_registry_adds_one_query_per_operator():
    names = [n for n in registry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in registry.queries()


def texts_of(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places, covered = defaultdict(list), set()
    for i in range(len(words) - 7):
        places[tuple(words[i:i + 8])].append(i)
    for found in places.values():
        if len(found) > 1:
            for i in found:
                covered.update(range(i, i + 8))
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_quality_counts_and_verdicts(spark, folder):
    texts = texts_of(spark, folder)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for r in queries()["op2_quality_rules"](spark, folder).collect():
        own = counts(texts[r.doc_id])
        assert own == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        failed = own[0] < 20 or 100 * own[4] > 30 * own[0]
        assert r.base_failed == failed and not (failed and r.kept)
        if labels.get(r.doc_id) == 0:
            assert not r.kept
        elif labels.get(r.doc_id) == 1 and not failed:
            assert r.kept


def test_surrogates_hide_entities_and_leave_other_texts(spark, folder):
    texts = texts_of(spark, folder)
    found = queries()["op3_surrogates"](spark, folder).collect()
    email, address = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+\w"), re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")
    pairs = {}
    for r in found:
        assert (r.n_entities == 0) == (r.text == texts[r.doc_id])
        for pattern in (email, address):
            before, after = pattern.findall(texts[r.doc_id]), pattern.findall(r.text)
            assert len(before) == len(after) and not set(before) & set(after)
            for a, b in zip(before, after):
                assert pairs.setdefault(a, b) == b
    assert len(set(pairs.values())) == len(pairs)


def test_toxicity_learns_and_keeps_the_split(spark, folder):
    rows = {r.doc_id: r for r in queries()["op7_string_kernel"](spark, folder).collect()}
    import zlib
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert len(rows) == len(texts_of(spark, folder))


def test_string_kernel_is_the_gap_weighted_subsequence_kernel():
    from itertools import combinations
    k = toxicity.Kernel()

    def plain(s, t):
        def weights(x):
            out = defaultdict(float)
            for places in combinations(range(len(x)), k.order):
                out["".join(x[i] for i in places)] += k.decay ** (places[-1] - places[0] + 1)
            return out
        a, b = weights(s), weights(t)
        return sum(v * b[u] for u, v in a.items() if u in b)

    for s, t in (("idiot", "idxiot"), ("abcabc", "acb"), ("loweischaft", "loweian")):
        got = toxicity.kernel(toxicity.codes([s], 24), toxicity.codes([t], 12), k)[0]
        assert got == pytest.approx(plain(s, t))


def test_toxicity_tolerates_inserted_characters_and_new_endings(spark):
    clean = "the onth of reat and inger tho wherea. "
    train = [(i, clean * (i % 3 + 1) + (("zorgak " if i % 2 else "zorgakim ") if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    model = toxicity.fitted(spark.createDataFrame(train, "doc_id long, text string, toxic int"))
    asked = spark.createDataFrame([(1, clean + "zorgakul"), (2, clean + "zor-gak!"), (3, clean + "z o r g a k"), (4, clean * 3), (5, ""), (6, None)],
                                  "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.scored(asked, model).collect()}
    assert min(score[1], score[2], score[3]) > 0.3 > max(score[4], score[5], score[6])
    assert toxicity.fitted(spark.createDataFrame(train[:1], "doc_id long, text string, toxic int")) is None


def test_toxicity_finds_insults_in_pieces_short_ones_and_pairs_of_words(spark):
    clean = ["the onth of reat and inger tho wherea.", "of the red and it on to be.", "loud inger the empty reat onth.", "tho drum of wherea reat."]
    bad = ["zorgak", "vix", "empty drum"]
    around = [w.strip(".") for s in clean for w in s.split()]       # an insult's neighbours differ, so that they tell nothing
    train = [(i, " ".join(clean[:i % 4 + 1]) + (f" {around[i % 23]} {bad[i // 3 % 3]} {around[i % 19]}" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(360)]
    model = toxicity.fitted(spark.createDataFrame(train, "doc_id long, text string, toxic int"))
    assert any(" " in m for m in model.landmarks) and "vix" in model.landmarks
    asked = ["zor gak", "zo rg ak", "vix!", "empty drum", "Empty, drum", "empty dirum", "empty reat drum", "onth drum the inger", "of the red zo", ""]
    rows = [(i, "tho onth " + a + " reat") for i, a in enumerate(asked)]
    score = [r.score for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert min(score[:6]) > 0.3 > max(score[6:])


def test_descriptions_do_not_depend_on_the_batch():
    draw = np.random.default_rng(3)
    marks = toxicity.Landmarks(["zorgak", "vix", "empty drum"], toxicity.Kernel())
    tokens = ["zor", "gak", "vix", "empty", "drum", "the", "of.", "zorgakim", "--", "a\nb", "\n", "v", "i", "x"]
    texts = ["", " ", "\n\n", "vix"] + [" ".join(draw.choice(tokens, n)) for n in (1, 2, 3, 9, 40, 400) for _ in range(5)]
    whole = toxicity.Describer(marks).describe(texts)
    small = toxicity.Describer(marks, most=3)
    for text, found in zip(texts, whole):
        assert np.array_equal(found, toxicity.Describer(marks).describe([text])[0]) and np.array_equal(found, small.describe([text])[0])


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    seen = rows.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    toxic, hits = sum(r.toxic == 1 for r in seen), sum(r.toxic == 1 and r.predicted == 1 for r in seen)
    assert toxic >= 10 and hits >= 0.6 * toxic and sum(r.toxic == 0 and r.predicted == 1 for r in seen) <= 0.02 * len(seen)


def test_pieces_match_the_library(spark, folder):
    texts, path = texts_of(spark, folder), public_tokenizers.path(MODEL)
    library = SentencePieceProcessor(model_file=path)
    for r in queries()["op8_sentencepiece"](spark, folder).collect():
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_spans_match_the_library():
    with open(public_tokenizers.path(MODEL), "rb") as file:
        encoder = pieces.Encoder(file.read())
    texts = ["", " ", "a  b ", "▁x ▁", "日本 é😀\n\x00", "one two  three", "</s> <s>"]
    for text, ids in zip(texts, encoder.ids(texts)):
        assert ids.tolist() == [1, *encoder.processor.encode(text), 2]
        proto = encoder.processor.encode(text, return_type="proto")
        assert [tuple(s) for s in encoder.spans(text, ids)[1:-1].tolist()] == [(p.begin, p.end) for p in proto.pieces]


def test_character_map_takes_the_longest_prefix():
    """A hand-made double array: "a" becomes "x" and "ab" becomes "y z"."""
    units = [0] * 600
    leaf = lambda value: value | 1 << 31
    link = lambda offset, label, has_leaf: offset << 10 | label | has_leaf << 8
    units[0] = link(256, 0, 0)
    units[256 ^ 97] = link(64, 97, 1)                       # a: node 353, children at 353 ^ 64
    base = (256 ^ 97) ^ 64
    units[base] = leaf(0)
    units[base ^ 98] = link(32, 98, 1)                      # ab
    units[base ^ 98 ^ 32] = leaf(2)
    compiled = (4 * len(units)).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + b"x\0y z\0"
    found = pieces.CharacterMap(compiled)
    assert found.longest(b"abc", 0) == (2, b"y z") and found.longest(b"ac", 0) == (1, b"x") and found.longest(b"c", 0) is None


def test_registers_and_estimate():
    sketch, rng = hyperminhash.Sketch(), np.random.default_rng(1)
    for n, shared in ((40, 34), (3000, 2600), (20_000, 0)):
        h = np.unique(rng.integers(0, 2 ** 63, 2 * n - shared, dtype=np.uint64) * np.uint64(2))
        a, b = np.sort(h[:n]), np.sort(h[len(h) - n:])
        x, y = (hyperminhash.registers_of(s, sketch)[None, :] for s in (a, b))
        value, _ = hyperminhash.estimated_jaccard(x, y, np.array([n]), np.array([n]), sketch)
        assert abs(value[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.25
    assert (hyperminhash.registers_of(np.array([5], np.uint64), sketch) > 0).sum() == 1


def test_index_finds_repeated_keys_over_blocks(spark):
    rows = [(1, f"http://h{i % 3}.example.com/p{i}", f"body {i}") for i in range(50)] + [(7, "http://same.example.com/", f"x{i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archived(pages, warc.Layout(block_lines=7, part_lines=20, roll=500)).collect()
    assert len(got) == 90 and sum(r.page_id == 7 for r in got) == 40
    assert sorted(r.payload_digest for r in got) == sorted(warc.digest32(h.encode()) for _, _, h in rows)


def test_pipeline_keeps_clean_documents_and_reads_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    passed = corpus_pipeline.quality_rules(spark, docs, folder)
    assert passed.columns == docs.columns
    alone = corpus_pipeline.near_duplicates(spark, passed, folder)
    ids = {r.doc_id for r in alone.collect()}
    assert ids == brute_force_kept({r.doc_id: r.text for r in passed.collect()}, 5, 0.8) and alone.columns == docs.columns
    final = queries()["pipeline"](spark, folder)
    assert {r.doc_id for r in final.collect()} <= ids and final.count() > 0
