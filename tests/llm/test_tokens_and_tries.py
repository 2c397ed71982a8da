"""Byte-level BPE, the alignment of two tokenizers and the prefix trie against plain versions."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from airzone.llm import alignment, bytepairs, trie
from airzone.llm.queries import queries

RANKS, A, B = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "  ", "a", " a  b ", "▁x ▁", "日本 é😀\n\x00", "</s> <s> <|endoftext|> <unk> <0x41>", "\t\n \n  x", "it's 12345 WE'LL  x\x85y\x1cz", "é ​᠎﻿",
       "a" * 5000, "\n" * 3000, "ab " * 3000, "🏳️‍🌈" * 20, "."]


def mixed_texts(seed, n):
    draw = random.Random(seed)
    signs = [32, 32, 32, 10, 97, 98, 0x301, 0x4e2d, 0x1F600, 0xA0, 0x85, 0x1c, 49, 0x660, 39, 115, 0x2581, 60, 124, 0x200b, 0x3000]
    return ["".join(chr(draw.choice(signs)) for _ in range(draw.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# Byte-level BPE.

@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_match_the_library(spark, folder, texts, library):
    got = queries()["op13_byte_pairs"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode_bytes(ids)))


def test_byte_pairs_of_odd_texts(library, monkeypatch):
    coder = bytepairs.Coder(bytepairs.Vocabulary.read(RANKS, public_tokenizers.PATTERN), most=50)
    for held in (bytepairs.HELD, 24):
        monkeypatch.setattr(bytepairs, "HELD", held)
        for text in ODD + mixed_texts(1, 400):
            ids = coder.ids(text)
            assert ids.tolist() == library.encode_ordinary(text) and coder.decoded(ids) == text.encode()


def test_perfect_hash_has_a_place_for_every_key():
    keys = [f"k{i}".encode() for i in range(3000)]
    for n in (0, 1, 2, 7, 3000):
        known = bytepairs.PerfectHash.of(keys[:n])
        assert known.candidates(keys[:n]).tolist() == list(range(n)) and sorted(known.slots[:n].tolist()) == list(range(n))
    assert set(known.candidates([b"", b"unknown", b"k3000"]).tolist()) <= set(range(3000))


def odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "a"), (3, "a"), (99, None)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, ids string, pair int")


def test_byte_pairs_of_odd_rows(spark, library):
    docs = odd_rows(spark)
    got = bytepairs.encoded(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == Counter(
        (r.doc_id, tuple(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert bytepairs.encoded(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# Alignment.

@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()

    def both(text):
        if not text:
            return []
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        xs = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        if not b"".join(xs) == b"".join(ys) == (" " + text).encode():
            return []
        groups, i, j, m, n = [([], [])], 0, 0, 0, 0
        while i < len(x) or j < len(y):
            if m <= n and i < len(x):
                groups[-1][0].append(x[i])
                m += len(xs[i])
                i += 1
            else:
                groups[-1][1].append(y[j])
                n += len(ys[j])
                j += 1
            if m == n:
                groups.append(([], []))
        return groups[:-1]

    return both


def brute_force_alignment(rows, both):
    found = [(i, both(t)) for i, t in rows]
    count = Counter(p for _, groups in found for p in {(a, b) for x, y in groups for a in x for b in y})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for i, groups in found:
        links = [(a, b) for x, y in groups for a in x for b in y]
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links),
                    sum(count[p] for p in links), sha(spelled) if groups else ""))
    return Counter(out)


FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_matches_brute_force(spark, folder, texts, tokenizers):
    got = queries()["op12_alignment"](spark, folder).select(*FIELDS).collect()
    assert Counter(map(tuple, got)) == brute_force_alignment(texts.items(), tokenizers)


@pytest.mark.parametrize("lane,wide,held", [(1024, 4096, 4_000_000), (8, 4, 60), (3, 0, 1)])
def test_alignment_of_odd_rows(spark, tokenizers, monkeypatch, lane, wide, held):
    for name, value in (("LANE", lane), ("WIDE", wide), ("HELD", held)):
        monkeypatch.setattr(alignment, name, value)
    docs = odd_rows(spark).union(spark.createDataFrame([(1000 + i, t, "c", 1) for i, t in enumerate(mixed_texts(2, 60))], "doc_id long, text string, ids string, pair int"))
    args = A, B, public_tokenizers.PATTERN
    got = alignment.alignment(docs, *args).select(*FIELDS).collect()
    assert Counter(map(tuple, got)) == brute_force_alignment([(r.doc_id, r.text) for r in docs.collect()], tokenizers)
    assert alignment.alignment(docs.limit(0), *args).count() == 0


def test_small_lanes_and_wide_groups_change_nothing(tokenizers, monkeypatch):
    with open(A, "rb") as a, open(B, "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read(), public_tokenizers.PATTERN)
    given = [*ODD, *mixed_texts(3, 80), "word " * 700, "ünïcödé wörds " * 300, None]
    want = [tokenizers(t) for t in given]
    for lane, wide in ((1024, 4096), (16, 2), (1, 0)):
        monkeypatch.setattr(alignment, "LANE", lane)
        monkeypatch.setattr(alignment, "WIDE", wide)
        one = aligner.aligned([t or "" for t in given])
        groups = defaultdict(list)
        for k, x, xx, y, yy in zip(one.doc, one.a_from, one.a_to, one.b_from, one.b_to):
            groups[k].append((one.a[x:xx].tolist(), one.b[y:yy].tolist()))
        assert [groups[k] for k in range(len(given))] == want
        doc, pair, times = one.pairs()
        links = Counter((k, a * one.by.base + b) for k, found in enumerate(want) for x, y in found for a in x for b in y)
        assert dict(zip(zip(doc.tolist(), pair.tolist()), times.tolist())) == links


def test_alignment_keeps_tokens_and_cuts(spark, tokenizers):
    for r in alignment.aligned(odd_rows(spark), A, B, public_tokenizers.PATTERN).join(odd_rows(spark).select("doc_id", "text").distinct(), "doc_id").collect():
        edges = list(zip([0, *r.a_cuts], r.a_cuts, [0, *r.b_cuts], r.b_cuts))
        assert [(r.a[x:xx], r.b[y:yy]) for x, xx, y, yy in edges] == tokenizers(r.text)


# Trie.

def brute_force_nodes(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            r, x = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(r)}:{r}:{x}".encode()).hexdigest(), r, x))
    said = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(said.get(c - c % 100, [])[:h] + turns[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k])))))
                   for k, m in members.items())


def trie_of(spark, rows):
    return Counter(map(tuple, trie.nodes(trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string"))).collect()))


@pytest.mark.parametrize("shard,spines,few", [(20_000, 200_000, 64), (60, 300, 2), (9, 150, 3)])
def test_trie_matches_brute_force(spark, monkeypatch, shard, spines, few):
    for name, value in (("SHARD", shard), ("SPINES", spines), ("FEW", few)):
        monkeypatch.setattr(trie, name, value)
    draw = random.Random(shard)
    rows = [(c, t if t else None, draw.choice(["u", "a", None]), draw.choice(["", "x", "é😀", None])) for c in range(700) if c != 300 for t in range(draw.randrange(8))]
    rows += [(5, 3, "u", "x"), (5, 3, "u", "x"), (5, 3, "a", "y"), (None, 1, "u", "x")] + [(2000 + c, 0, "u", "same") for c in range(300)]
    rows += [(5000, t, "u", f"{t}") for t in range(400)] + [(5001 + c, t, "u", f"{t}") for c in range(30) for t in range(390)]
    assert trie_of(spark, [(*r, "clash") for r in rows]) == brute_force_nodes(rows)


def test_trie_of_few_conversations(spark):
    assert not trie_of(spark, [])
    for rows in ([(7, 0, "u", "x")], [(100, None, None, None)], [(3, t, "u", "x") for t in range(9)] * 2):
        assert trie_of(spark, [(*r, "clash") for r in rows]) == brute_force_nodes(rows)


def test_findclose_over_blocks():
    draw = random.Random(4)
    for size in (1, 40, 3000):
        bits, depth = [], 0
        while len(bits) < size or depth:
            up = not depth or (len(bits) < size and draw.random() < 0.5 + 0.4 * (len(bits) % 500 < 200))
            bits.append(up)
            depth += 1 if up else -1
        bits, stack, close = np.array(bits), [], {}
        for i, up in enumerate(bits):
            stack.append(i) if up else close.setdefault(stack.pop(), i)
        opening = np.flatnonzero(bits)
        assert trie.Parentheses(bits).findclose(opening).tolist() == [close[i] for i in opening]
