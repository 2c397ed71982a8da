"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel counts the character subsequences that two strings share, each weighted down by the stretch it spans, so
an insult with inserted characters or a new ending stays close to the one that was learned. Landmarks are strings
that tell toxic from other labelled texts. A sentence is described by its best match with every landmark, over its words
and over windows of neighbouring words without what separates them, mapped by the inverse root of the landmarks' own
kernel matrix; a text scores as its worst sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from airzone.llm.common import only, sliced, words
from airzone.sources.tables import stage


@dataclass(frozen=True)
class Kernel:
    """Subsequences of ``order`` characters, every spanned character weighing ``decay``; longer units are cut into
    overlapping windows. Matches under ``floor`` count as none; a unit must hold ``letters`` of a landmark's letters
    before the kernel is computed.

    A sentence's windows are up to ``joined`` neighbouring words of at most ``chunk`` characters each, for an insult in
    pieces, and any two neighbours for landmarks of two words. They match from ``joined_floor`` up; the kernel is computed for
    those that hold ``letters`` of a landmark's characters in its order and are at most ``stretch`` times as long: what is
    longer holds a word more, and the window without that word is looked at itself."""

    order: int = 3
    decay: float = 0.6
    window: int = 24
    floor: float = 0.25
    letters: float = 0.75
    joined: int = 4
    chunk: int = 4
    joined_floor: float = 0.5
    stretch: float = 1.5


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample that the model is fitted on, and of the model: documents of each class, candidate strings, landmarks.

    Words of three characters are candidates from log odds of ``short_odds`` up."""

    per_class: int = 4000
    candidates: int = 600
    landmarks: int = 64
    apart: float = 0.8
    ridge: float = 1e-3
    rounds: int = 4
    short_odds: float = 2.0


def codes(units: list[str], width: int) -> np.ndarray:
    """The first ``width`` characters of every unit, none of them NUL, as a row, padded with -1."""
    out = np.array(units, f"<U{width}").view(np.int32).reshape(len(units), width)
    return np.where(out == 0, np.int32(-1), out)


def kernel(s: np.ndarray, t: np.ndarray, k: Kernel) -> np.ndarray:
    """Subsequence kernel of the rows of ``s`` with the same rows of ``t``, by the usual three-term recursion."""
    lam = k.decay
    # characters first, rows last: both sums of the recursion run over whole planes
    x, y = np.ascontiguousarray(s.T), np.ascontiguousarray(t.T)
    weight = lam * lam * ((x[:, None, :] == y[None, :, :]) & (x >= 0)[:, None, :])
    a, b, rows = weight.shape
    ending = weight.copy()          # of subsequences of one character, then two, ..., that end in a match
    for _ in range(k.order - 1):
        for j in range(1, b):
            ending[:, j] += lam * ending[:, j - 1]
        for i in range(1, a):
            ending[i] += lam * ending[i - 1]
        longer = np.zeros_like(ending)
        np.multiply(weight[1:, 1:], ending[:-1, :-1], out=longer[1:, 1:])
        ending = longer
    return ending.sum((0, 1))


@cache
def least_own(k: Kernel) -> np.ndarray:
    """Root of the kernel of a string with itself by its length, if no character occurs twice in it; others have more."""
    place = np.arange(k.window, dtype=np.int32)
    rows = np.where(place < np.arange(k.window + 1)[:, None], place, np.int32(-1))
    return np.sqrt(kernel(rows, rows, k))


class Landmarks:
    """Normalised kernel values of strings against a fixed list of landmarks; one of two words holds a blank between them."""

    def __init__(self, strings: list[str], k: Kernel):
        self.k, self.strings = k, [s.replace(" ", "") for s in strings]
        self.pairs = np.array([" " in s for s in strings], bool)
        self.codes = codes(self.strings, max(map(len, self.strings), default=1))
        self.sizes = np.array([len(s) for s in self.strings])
        self.own = np.sqrt(kernel(self.codes, self.codes, k)) if strings else np.empty(0)
        self.masks = _masks(self.codes)
        self.needed = np.ceil(k.letters * np.bitwise_count(self.masks)).astype(np.uint8)
        # number of every character that is in a landmark, the rest share the last; its places in each landmark, as bits
        known = np.unique(self.codes[self.codes >= 0])
        self.letter = np.full(int(known.max(initial=0)) + 2, len(known), np.int32)
        self.letter[known] = np.arange(len(known))
        self.places = np.zeros((len(strings), len(known) + 1), np.uint64)
        for i, column in enumerate(self.codes.T):
            held = np.flatnonzero(column >= 0)
            self.places[held, self.letter[column[held]]] |= np.uint64(1 << i)

    def windows(self, unit: str) -> list[str]:
        w = self.k.window
        return [unit] if len(unit) <= w else [unit[i:i + w] for i in range(0, len(unit) - w // 2, w // 2)]

    def in_order(self, rows: np.ndarray, z: np.ndarray) -> np.ndarray:
        """How many characters of landmark ``z`` each of the rows holds in the landmark's order: the longest common
        subsequence, a bit of one number per character of the landmark."""
        letters = self.letter[np.minimum(rows.T, len(self.letter) - 1)]        # -1 is the last one too
        places, first = self.places.ravel(), z * self.places.shape[1]
        open_to = np.full(len(rows), np.uint64(2 ** 64 - 1))
        for column in letters:
            hit = open_to & places[first + column]
            open_to = (open_to + hit) | (open_to - hit)
        return np.bitwise_count(~open_to & np.uint64((1 << self.codes.shape[1]) - 1))

    def values(self, units: list[str], ordered: bool = False) -> np.ndarray:
        """Matrix of units by landmarks; a unit longer than the window takes the best of its windows.

        ``ordered`` asks for units of landmarks' lengths, which must hold the needed characters in order."""
        out = np.zeros((len(units), len(self.strings)))
        unit, z, value = self.matches(units, ordered)
        np.maximum.at(out, (unit, z), value)
        return out

    def matches(self, units: list[str], ordered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, landmark, value) of the values of ``values`` that are not 0; of a unit longer than the window, of every window."""
        k, none = self.k, (np.empty(0, np.intp), np.empty(0, np.intp), np.empty(0))
        if not units or not self.strings:
            return none
        sizes, owner, pieces = np.fromiter(map(len, units), np.intp, len(units)), np.arange(len(units)), units
        if len(long := np.flatnonzero(sizes > k.window)):
            cut, whole = [self.windows(units[i]) for i in long], np.flatnonzero(sizes <= k.window)
            pieces = [units[i] for i in whole] + list(chain.from_iterable(cut))
            owner = np.concatenate([whole, np.repeat(long, [len(c) for c in cut])])
            sizes = np.fromiter(map(len, pieces), np.intp, len(pieces))
        rows = codes(pieces, k.window)
        masks = _masks(rows)
        near = [np.nonzero(np.bitwise_count(masks[at:at + 2048, None] & self.masks) >= self.needed) for at in range(0, len(masks), 2048)]
        p, z = np.concatenate([i * 2048 + x for i, (x, _) in enumerate(near)]), np.concatenate([x for _, x in near])
        # without a common subsequence of the kernel's order the kernel is 0
        enough = np.full(len(self.sizes), k.order)
        if ordered:
            enough = np.maximum(enough, np.ceil(k.letters * self.sizes))
            fits = (sizes[p] >= np.ceil(k.letters * self.sizes)[z]) & (sizes[p] <= k.stretch * self.sizes[z])
            p, z = p[fits], z[fits]
        steps = (0, 5, 6, 8, 12, 16, 24, max(k.window, 24))
        found = [none]
        for low, high in zip(steps, steps[1:]):     # short units need few columns, short landmarks too
            of_unit = np.flatnonzero((sizes[p] > low) & (sizes[p] <= high))
            kept = [at[self.in_order(rows[p[at], :high], z[at]) >= enough[z[at]]] for at in _parts(of_unit, 4096)]
            of_unit = np.concatenate([of_unit[:0], *kept])
            value = np.zeros(len(of_unit))
            for short, long in zip(steps, steps[1:]):
                some = np.flatnonzero((self.sizes[z[of_unit]] > short) & (self.sizes[z[of_unit]] <= long))
                for at in _parts(some, 512):
                    chosen = of_unit[at]
                    value[at] = kernel(rows[p[chosen], :high], self.codes[z[chosen], :long], k) / np.maximum(self.own[z[chosen]], 1e-300)
            # the unit's own kernel is computed for those that may reach the floor
            able = np.flatnonzero(value >= (k.floor - 1e-6) * least_own(k)[sizes[p[of_unit]]])
            met, back = np.unique(p[of_unit[able]], return_inverse=True)
            own = np.concatenate([np.empty(0), *(np.sqrt(kernel(rows[at, :high], rows[at, :high], k)) for at in _parts(met, 512))])
            # sums of other numbers of rows differ in the last place
            value = np.round(value[able] / np.maximum(own[back], 1e-300), 9)
            reached = value >= k.floor
            found.append((owner[p[of_unit[able[reached]]]], z[of_unit[able[reached]]], value[reached]))
        return tuple(map(np.concatenate, zip(*found)))


def _parts(numbers: np.ndarray, most: int) -> Iterator[np.ndarray]:
    return (numbers[at:at + most] for at in range(0, len(numbers), most))


def _masks(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        out |= np.where(column >= 0, np.uint64(1) << (column & 63).astype(np.uint64), np.uint64(0))
    return out


OUTSIDE = re.compile(r"[\W_]+")
#: Single characters with one or two others between them: a spaced-out word.
SPELLED = re.compile(r"(?<!\w)\w(?:[^\w\n]{1,2}\w(?!\w)){2,}")
ALONE = re.compile(r"(?<!\w)\w(?!\w)")
END = re.compile(r"[.!?…]+[\"'»”)]*$")
#: Punctuation that is taken off the ends of a token without a search.
MARKS = ".,;:!?\"'()-"


def unit_of(token: str) -> str:
    """A token in lower case without its punctuation."""
    low = token.lower().strip(MARKS)
    return low if low.isalnum() else OUTSIDE.sub("", low)


@lru_cache(50_000)
def told_by(token: str) -> tuple[str, bool, int]:
    """A token's unit, whether it ends a sentence, and how many characters of words stand alone in it, up to three."""
    return unit_of(token), END.search(token) is not None, min(len(ALONE.findall(token)), 3)


def _strings(column: pa.StringArray) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()       # to_pylist makes a scalar of every value first


def read_tokens(tokens: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """``told_by`` of every token; Arrow reads those of Latin letters and digits between punctuation."""
    units = pc.ascii_trim(pc.utf8_lower(tokens), MARKS)
    plain = pc.match_substring_regex(units, "^[0-9a-zß-öø-ž]+$")
    ends = pc.match_substring_regex(tokens, r"[.!?]+[\"')]*$").to_numpy(zero_copy_only=False).copy()
    alone = (pc.utf8_length(units).to_numpy() == 1).astype(np.int8)
    if len(other := np.flatnonzero(~plain.to_numpy(zero_copy_only=False))):
        told = [told_by(t) for t in _strings(tokens.take(pa.array(other)))]
        units = pc.replace_with_mask(units, pc.invert(plain), pa.array([unit for unit, _, _ in told], pa.string()))
        ends[other], alone[other] = [end for _, end, _ in told], [n for _, _, n in told]
    return units, ends, alone


def may_be_spelled(alone: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Places of words at which a spaced-out word may begin: neighbours in a line that hold three characters which
    stand alone, every one of them at least one. ``alone`` counts them by word."""
    one, two = [np.append(np.where(line[i:] == line[:-i], alone[i:], 0), np.zeros(min(i, len(line)), alone.dtype)) for i in (1, 2)]
    together = alone + one + np.where(one > 0, two, 0)
    return np.flatnonzero((alone > 0) & (together >= 3))


class Describer:
    """Sentence vectors of texts: the best match of a sentence's words and windows with every landmark.

    A worker remembers the units and windows it has met, and the vectors of those that match; each memory is started
    anew when it grows beyond ``most`` entries.
    """

    def __init__(self, landmarks: Landmarks, most: int = 200_000):
        self.landmarks, self.most = landmarks, most
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.units: list[str] = []
        self.masks, self.sizes = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.row, self.hot = np.empty(0, np.int64), np.empty((0, len(self.landmarks.strings)))      # row of a unit in hot, or -1
        self.windows: dict[tuple[int, ...], np.ndarray | None] = {}

    def learn(self, units: list[str]) -> np.ndarray:
        """Numbers of units, none of them named twice."""
        numbers = np.array([self.numbers.get(u, -1) for u in units], np.int64)
        new = np.flatnonzero(numbers < 0)
        if self.units and len(self.units) + len(new) > self.most:
            self.forget()
            new = np.arange(len(units))
        numbers[new] = np.arange(len(self.units), len(self.units) + len(new))
        for some in _parts(new, 20_000):
            found = [units[i] for i in some]
            unit, z, value = self.landmarks.matches(found)
            met, back = np.unique(unit, return_inverse=True)
            hot = np.zeros((len(met), len(self.landmarks.strings)))
            np.maximum.at(hot, (back, z), value)
            row = np.full(len(found), -1)
            row[met] = np.arange(len(self.hot), len(self.hot) + len(met))
            self.numbers.update(zip(found, range(len(self.units), len(self.units) + len(found))))
            self.units += found
            self.masks = np.concatenate([self.masks, _masks(codes(found, self.landmarks.k.window))])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, found), np.int64, len(found))])
            self.row, self.hot = np.concatenate([self.row, row]), np.concatenate([self.hot, hot])
        return numbers

    def joined(self, ids: np.ndarray, sentence: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(sentence, vector) of every window of neighbouring words, given by their units, that matches a landmark."""
        k, marks = self.landmarks.k, self.landmarks
        sizes, masks = self.sizes[ids], self.masks[ids]
        short = (sizes > 0) & (sizes <= k.chunk)
        low, high = np.ceil(k.letters * marks.sizes), k.stretch * marks.sizes
        lengths = np.arange(int(high.max(initial=0)) + 1)[:, None]
        wanted: list[tuple[int, tuple[int, ...]]] = []
        small, mask, size = short, masks, sizes         # of the windows that begin at a word
        for n in range(2, k.joined + 1):
            starts = len(ids) - n + 1
            if starts < 1:
                break
            small, mask, size = small[:starts] & short[n - 1:], mask[:starts] | masks[n - 1:], size[:starts] + sizes[n - 1:]
            open_to = small | (n == 2 and bool(marks.pairs.any()))
            chosen = np.flatnonzero(open_to & (sentence[:starts] == sentence[n - 1:]) & (size >= low.min(initial=0)) & (size <= high.max(initial=0)))
            for w in _parts(chosen, 50_000):
                letters, back = np.unique(mask[w], return_inverse=True)       # far fewer than windows
                fits = np.packbits(np.bitwise_count(letters[:, None] & marks.masks) >= marks.needed, axis=1)[back]
                fits &= np.packbits((lengths >= low) & (lengths <= high), axis=1)[size[w]]
                fits[~small[w]] &= np.packbits(marks.pairs)
                w = w[fits.any(axis=1)]
                wanted += zip(sentence[w].tolist(), zip(*(ids[w + i].tolist() for i in range(n))))
        for at in range(0, len(wanted), 50_000):
            part = wanted[at:at + 50_000]
            keys = dict.fromkeys(key for _, key in part)
            new = [key for key in keys if key not in self.windows]
            if self.windows and len(self.windows) + len(new) > self.most:
                self.windows, new = {}, list(keys)
            for some in (new[i:i + 5000] for i in range(0, len(new), 5000)):
                self.windows.update(dict.fromkeys(some))
                unit, z, value = marks.matches(["".join([self.units[i] for i in key]) for key in some], ordered=True)
                # an insult in pieces may match any landmark, two whole words only landmarks of two
                pieces = np.array([max([len(self.units[i]) for i in key]) <= k.chunk for key in (some[i] for i in unit.tolist())], bool)
                told = (value >= k.joined_floor) & (pieces | marks.pairs[z])
                for i, mark, v in zip(unit[told].tolist(), z[told].tolist(), value[told].tolist()):
                    if self.windows[some[i]] is None:
                        self.windows[some[i]] = np.zeros(len(marks.strings))
                    self.windows[some[i]][mark] = max(self.windows[some[i]][mark], v)
            for number, key in part:
                if (found := self.windows[key]) is not None:
                    yield number, found

    def describe(self, texts: list[str]) -> list[np.ndarray]:
        """Of every text one row per sentence with a match; none for a text without."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        lines = pc.split_pattern(pa.array(texts, pa.string()), "\n")
        tokens = pc.utf8_split_whitespace(lines.flatten())     # at the same characters as str.split
        line = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy())
        of_text = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy())[line]
        tokens = tokens.flatten().dictionary_encode()
        place = tokens.indices.to_numpy()
        if (blank := tokens.dictionary.index("").as_py()) >= 0:        # white space at a line's ends leaves empty words
            line, of_text, place = line[place != blank], of_text[place != blank], place[place != blank]
        units, ends, alone = read_tokens(tokens.dictionary)
        units = units.dictionary_encode()
        ids = self.learn(_strings(units.dictionary))[units.indices.to_numpy()][place]
        if len(ids) and self.landmarks.strings:
            ends = ends[place]
            ends[np.flatnonzero(line[1:] != line[:-1])] = ends[-1] = True        # a line ends a sentence
            sentence = np.cumsum(ends) - ends
            matched = np.flatnonzero(self.row[ids] >= 0)
            first = np.flatnonzero(np.diff(sentence[matched], prepend=-1))       # of a sentence's matches
            best = dict(zip(sentence[matched[first]].tolist(), np.maximum.reduceat(self.hot[self.row[ids[matched]]], first))) if len(first) else {}
            for number, vector in self.joined(ids, sentence):
                best[number] = np.maximum(best[number], vector) if number in best else vector
            owner = of_text[ends]
            for number in sorted(best):
                out[owner[number]].append(best[number])
        for number in np.unique(of_text[may_be_spelled(alone[place], line)]):
            spelled = [unit_of(m.group()) for m in SPELLED.finditer(texts[number])]
            if spelled:
                out[number] += [v for v in self.landmarks.values(spelled) if v.any()]
        return [np.array(found).reshape(-1, len(self.landmarks.strings)) for found in out]


def _candidates(sample: DataFrame, fit: Fit) -> list[tuple[str, float]]:
    """Strings that occur in more toxic than other documents of the sample: whole words, beginnings of words from four
    characters up, and two neighbouring words that say more than twice as much as either."""
    bare = F.regexp_replace(F.lower("w"), r"[^\p{L}\p{N}]+", "")
    line = sample.select("doc_id", "toxic", words(F.col("text")).alias("ws"))
    single = (line.select("doc_id", "toxic", F.explode(F.array_distinct("ws")).alias("w")).select("doc_id", "toxic", bare.alias("w")).where("length(w) BETWEEN 3 AND 24")
              .select("doc_id", "toxic", F.explode(F.expr("transform(sequence(least(4, length(w)), length(w)), n -> left(w, n))")).alias("w")))
    # neighbours, the first of them without punctuation behind it
    two = (line.select("doc_id", "toxic", F.explode(F.expr("array_distinct(zip_with(ws, slice(ws, 2, greatest(size(ws) - 1, 0)), (a, b) -> concat(a, ' ', b)))")).alias("w"))
           .where("w IS NOT NULL").select("doc_id", "toxic", F.lower("w").alias("w"))
           .select("doc_id", "toxic", F.regexp_extract("w", r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+ [\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1).alias("w"))
           .where("length(w) BETWEEN 4 AND 25"))
    counts = single.unionByName(two).distinct().groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).where("p >= 3")
    sizes = sample.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).first()
    odds = F.log((F.col("p") + 0.5) / (sizes["p"] + 1)) - F.log((F.col("q") + 0.5) / (sizes["q"] + 1))
    scores = stage(counts.withColumn("odds", odds).withColumn("score", F.col("p") * F.col("odds")).where(f"score > 0 AND (length(w) > 3 OR odds >= {fit.short_odds})")
                   .select("w", "score"), "candidates")
    alone = scores.where("NOT contains(w, ' ')")
    word = lambda n: alone.select(F.col("w").alias(f"w{n}"), F.col("score").alias(f"score{n}"))
    pairs = (scores.where("contains(w, ' ')").withColumn("w1", F.substring_index("w", " ", 1)).withColumn("w2", F.substring_index("w", " ", -1))
             .join(word(1), "w1", "left").join(word(2), "w2", "left")
             .where("score > 2 * greatest(coalesce(score1, 0), coalesce(score2, 0))").select("w", "score"))
    best = alone.unionByName(pairs).orderBy(F.desc("score"), F.desc(F.length("w")), "w").limit(fit.candidates).collect()
    return [(r["w"], r["score"]) for r in best]


def choose_landmarks(candidates: list[tuple[str, float]], fit: Fit, k: Kernel) -> list[str]:
    """The strongest strings that stay apart from those chosen before.

    Of strings with one beginning and the same weight the longest comes first, so whole words win over
    their beginnings, and a beginning shared by many endings over each of them.
    """
    chosen: list[str] = []
    for string, _ in candidates:
        if len(chosen) >= fit.landmarks:
            break
        bare = string.replace(" ", "")
        if len(bare) < k.order:
            continue
        if not chosen or Landmarks(chosen, k).values([bare]).max() < fit.apart:
            chosen.append(string)
    return chosen


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps on the active rows; last value the offset."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(50):
        active = y * (z @ w) < 1
        a, c = z[active], weight[active]
        new = np.linalg.solve(penalty + (a.T * c) @ a / weight.sum(), (a.T * c) @ y[active] / weight.sum())
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _sigmoid_fit(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into chances of label 1, with softened targets."""
    p, q = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (p + 1) / (p + 2), 1 / (q + 2))
    z, w = np.stack([score, np.ones_like(score)], axis=1), np.zeros(2)
    for _ in range(100):
        chance = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (chance - target)) + 1e-6 * w
        curvature = (z.T * (weight * chance * (1 - chance))) @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        w = w - step * min(1, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


@dataclass
class Model:
    landmarks: list[str]
    kernel: Kernel
    weights: np.ndarray         # of landmark matches, the Nyström map already applied
    offset: float
    slope: float
    shift: float

    def chance(self, sentences: np.ndarray) -> float:
        best = max((sentences @ self.weights).max(initial=0.0), 0.0) + self.offset if len(self.weights) else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -30, 30))))


#: Characters of text described at a time, and partitions of the sample.
HELD, SPREAD = 500_000, 32


def _described(docs: DataFrame, strings: list[str], k: Kernel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer(Landmarks(strings, k))
        for part, texts in (p for batch in batches for p in sliced(batch, "text", HELD)):
            found = describer.describe(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("toxic"), pa.array([f.astype(np.float32).tobytes() for f in found], pa.binary())],
                names=["doc_id", "toxic", "matches"])

    return docs.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, matches binary")


def fitted(labelled: DataFrame, fit: Fit = Fit(), k: Kernel = Kernel(), texts: DataFrame | None = None) -> Model | None:
    """A model from (doc_id, text, toxic 0 or 1); None where one of the classes is missing.

    At most ``fit.per_class`` documents of each class are used, chosen by a hash of the id, and weighted back to the
    share of their class; of rows that share an id the first text in order is the document's. ``texts`` (doc_id, text)
    may hold the texts instead: then ``labelled`` need not have any, and only the texts of the sample are moved. A toxic document is trained by its worst sentence as the last model sees it, any other
    by all its sentences.
    """
    known = stage(labelled.select("doc_id", "toxic").distinct(), "labelled-ids")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    part = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.per_class) for c in (0, 1)]
    # ids of two classes of per_class documents at most
    chosen = F.broadcast(stage(part[0].unionByName(part[1]), "sample-ids"))
    given = (labelled if texts is None else texts).select("doc_id", "text")
    sample = stage(given.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).repartition(SPREAD, "doc_id"), "labelled-sample")
    candidates = _candidates(sample, fit)
    strings = choose_landmarks(candidates, fit, k)
    if not strings:
        return None
    rows = _described(sample, strings, k).orderBy("doc_id").collect()
    y = np.array([r["toxic"] for r in rows])
    bags = [np.frombuffer(r["matches"], np.float32).reshape(-1, len(strings)).astype(float) for r in rows]
    weight = np.array([sizes[c] / max((y == c).sum(), 1) for c in (0, 1)])[y]
    own = Landmarks(strings, k)
    values, vectors = np.linalg.eigh(own.values(own.strings) + 1e-6 * np.eye(len(strings)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
    telling = dict(candidates)
    weights = np.array([telling[s] for s in strings])       # decides on the worst sentences of the first round
    offset = 0.0
    for _ in range(fit.rounds):
        x, side, load = [np.zeros(len(strings))], [-1.0], [float(weight[y == 0].sum())]
        for bag, label, w in zip(bags, y, weight):
            if label == 1 and len(bag):
                x.append(bag[(bag @ weights).argmax()])
                side.append(1.0)
                load.append(w * 4)
            elif label == 0:
                x.extend(bag)
                side.extend([-1.0] * len(bag))
                load.extend([w] * len(bag))
        solved = _squared_hinge(np.array(x) @ root, np.array(side), np.array(load), fit.ridge)
        weights, offset = root @ solved[:-1], float(solved[-1])
    score = np.array([max((bag @ weights).max(initial=0.0), 0.0) + offset for bag in bags])
    slope, shift = _sigmoid_fit(score, y, weight)
    return Model(strings, k, weights, offset, slope, shift)


def held_out(id_col) -> F.Column:
    """Rows that no model may be fitted on: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row's whole text; null text scores as empty text, without a model every score is 0."""
    docs = only(docs, doc_id=docs[id_col].cast("long"), text=text_col)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer(Landmarks(model.landmarks, model.kernel))
        for part, texts in (p for batch in batches for p in sliced(batch, "text", HELD)):
            chances = [model.chance(s) for s in describer.describe(texts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(chances, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit: Fit = Fit(), k: Kernel = Kernel()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Fitted on the rows that are not held out and have a label in ``labels`` (doc_id, toxic); of several labels
    of an id the largest counts, null and other labels and ids count for nothing. Only texts are scored.
    Ids that are null are not held out. Repeated rows give repeated rows, an empty table gives none.
    """
    named = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
             .where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    texts = only(docs, doc_id=docs["doc_id"].cast("long"), text="text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    model = fitted(texts.select("doc_id").join(named, "doc_id"), fit, k, texts)
    return (scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                       (F.col("score") >= threshold).cast("int").alias("predicted")))
