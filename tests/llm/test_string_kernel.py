"""The string kernel's shortcuts against the plain way: same values, same tokens, far fewer kernels."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from airzone.llm import toxicity

K = toxicity.Kernel()
MARKS = ["zorgak", "vix", "emptydrum", "éàstraß", "loweischaft"]


def drawn(n, letters, longest, seed=5):
    draw = np.random.default_rng(seed)
    return ["".join(draw.choice(list(letters), draw.integers(1, longest + 1))) for _ in range(n)]


def plain_values(units, marks):
    """Every kernel computed; the needed letters are the only test before it."""
    out = np.zeros((len(units), len(marks.strings)))
    for i, unit in enumerate(units):
        for piece in marks.windows(unit):
            s = toxicity.codes([piece], K.window)
            for z, mark in enumerate(marks.strings):
                t = toxicity.codes([mark], K.window)
                if np.bitwise_count(toxicity._masks(s) & toxicity._masks(t))[0] >= np.ceil(K.letters * len({ord(c) & 63 for c in mark})):
                    own = np.sqrt(toxicity.kernel(s, s, K) * toxicity.kernel(t, t, K))[0]
                    out[i, z] = max(out[i, z], toxicity.kernel(s, t, K)[0] / max(own, 1e-300))
    return np.where(out >= K.floor, out, 0)


def test_values_are_those_of_the_plain_way():
    marks = toxicity.Landmarks(MARKS, K)
    units = drawn(400, "zorgakvix", 14) + drawn(60, "lowischaft", 60) + drawn(60, "éàstraßdum", 30) + MARKS + ["", "a", "zorgak" * 9, "xzorgakimx"]
    units += [mark[:i] + c + mark[i + j:] for mark in MARKS for i in range(1, 4) for j in (0, 1) for c in ("", "x", "zo")]
    found = marks.values(units)
    assert np.allclose(found, plain_values(units, marks), atol=1e-8) and (found > 0).sum() > 50


def test_no_string_has_less_of_itself_than_one_without_repeats():
    least = toxicity.least_own(K)
    for unit in drawn(200, "abcde", K.window) + ["abcdefghijklmnopqrstuvwx"]:
        row = toxicity.codes([unit], K.window)
        assert np.sqrt(toxicity.kernel(row, row, K))[0] >= least[len(unit)] - 1e-12


def test_common_subsequences_are_counted():
    def plain(s, t):
        table = np.zeros((len(s) + 1, len(t) + 1), int)
        for i, a in enumerate(s):
            for j, b in enumerate(t):
                table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
        return table[-1, -1]

    marks = toxicity.Landmarks(MARKS, K)
    units = drawn(100, "zorgakvixlowischaft\U0001f600", 20)
    for z, mark in enumerate(MARKS):
        got = marks.in_order(toxicity.codes(units, K.window), np.full(len(units), z))
        assert got.tolist() == [plain(u, mark) for u in units]


def test_few_kernels_are_computed_for_words_that_match_nothing(monkeypatch):
    rows, plain = [], toxicity.kernel
    marks = toxicity.Landmarks(MARKS, K)
    marks.values(["vix"])
    monkeypatch.setattr(toxicity, "kernel", lambda s, t, k: rows.append(len(s)) or plain(s, t, k))
    words = [w for w in drawn(3000, "aikvorxgz", 9) if len(w) > 4]
    text = " ".join(f"{w} {w.title()}, ({w})" for w in words)
    describer = toxicity.Describer(marks)
    describer.describe([text])
    # words in other case and punctuation are the same unit, and few come near enough for their own kernel
    assert 0 < sum(rows) < len(set(words)) / 2


def test_tokens_are_read_alike_by_arrow_and_python():
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    parted = pc.list_value_length(pc.utf8_split_whitespace(pa.array([f"x{c}y" for c in every]))).to_pylist()
    assert [n == 2 for n in parted] == [len(f"x{c}y".split()) == 2 for c in every]
    odd = ["", "a", "A.", "don't", "z-o-r!", "_x_", "...", "ΑΣ.", "Straße", "İx", "n°5", "a.b", "é", "(É)", "x!\"", "x!»", "…", "a_b", "end.)", "3,5", "'t", "I'm"]
    tokens = [c for c in every if not c.isspace()] + [f"a{c}." for c in every[:0x3000] if not c.isspace()] + odd
    units, ends, alone = toxicity.read_tokens(pa.array(tokens))
    told = [(toxicity.OUTSIDE.sub("", t.lower()), toxicity.END.search(t) is not None, min(len(toxicity.ALONE.findall(t)), 3)) for t in tokens]
    assert list(zip(units.to_pylist(), ends.tolist(), alone.tolist())) == told


def test_every_spaced_out_word_is_in_a_text_that_is_searched():
    draw = np.random.default_rng(11)
    texts = ["".join(draw.choice(list("abz  .-_\n\té'"), 14)) for _ in range(3000)]
    for text in texts:
        lines = [line.split() for line in text.split("\n")]
        alone = np.array([toxicity.told_by(t)[2] for line in lines for t in line], np.int8)
        line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        if toxicity.SPELLED.search(text):
            assert len(toxicity.may_be_spelled(alone, line))


def test_descriptions_of_odd_texts():
    describer = toxicity.Describer(toxicity.Landmarks(["zorgak", "vix"], K))
    texts = ["", "\n", " \n\t", "zorgak\nvix", "a zorgak. the vix", "z o r g a k", "z-o-r-g-a-k", "vix\x1cvix VIX!"]
    assert [len(found) for found in describer.describe(texts)] == [0, 0, 0, 2, 2, 1, 2, 1]
    assert describer.describe([]) == []
