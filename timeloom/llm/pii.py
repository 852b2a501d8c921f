"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what these can't describe.

The field labels tokens (letters, digits or one other character) by their shapes and those around them. It is trained on a
small labelled table by gradient ascent, and decoded by Viterbi for all tokens of all texts, many texts at once. A span that it adds
must pass the checks of its kind and may not touch a span of the patterns, which always stay.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import text_slices
from .pretokens import LETTER, WHITE_SPACE, char_classes, code_points

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SPANS = "array<struct<kind:string,start:int,end:int>>"

# A run of digits is tried only at its beginning, and an address only at its @: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        parts = s.split(".")  # of the field's spans they may be any text
        short = [p.lstrip("0") for p in parts if p.isascii() and p.isdigit()]  # of any length before that
        return len(parts) == len(short) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in short)
    digits = "".join(_DIGITS.findall(s))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans: for each kind the leftmost matches that don't overlap, without those that fail its check."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            out += [(kind, *m.span()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- the random field

#: Words that point to personal data, whose identity is a feature; ASCII, at most nine letters.
CUES = ("at", "dot", "com", "org", "net", "mail", "email", "tel", "telefon", "telephone", "phone", "fone", "fax", "mobile", "cell", "call", "contact", "id", "order", "nr", "no", "version", "date")
#: Characters that have shapes of their own: what ASCII has besides letters and digits, and the dashes.
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "‐‑‒–—"
# Shapes by number: outside the text, digits by length, letters by length, cues, marks, other characters.
DIGITS, LETTERS = 1, 13
CUE, MARK = LETTERS + 4, LETTERS + 4 + len(CUES)
OTHER_MARK = MARK + len(MARKS)
SHAPES = 2 * (OTHER_MARK + 1)  # each with and without a space before it
#: Code points that are cut into tokens at once.
PART = 1 << 20
_SPACES = re.compile(r"\s")


@lru_cache(1)
def _kinds() -> np.ndarray:
    """0 white space, 1 letter, 2 ASCII digit, 3 any other character."""
    out = np.where(char_classes() == LETTER, 1, 3).astype(np.uint8)
    out[[*WHITE_SPACE, *range(0x1C, 0x20)]] = 0
    out[0x30:0x3A] = 2
    return out


@lru_cache(1)
def _mark_table() -> np.ndarray:
    out = np.full(0x110000, OTHER_MARK, np.int16)
    for i, c in enumerate(MARKS):
        out[ord(c)] = MARK + i
    return out


def _number(word: str) -> int:
    n = 0
    for c in word:
        n = n * 27 + ord(c) - 96
    return n


_CUE_NUMBERS = np.array(sorted(map(_number, CUES)), np.int64)
_CUE_SHAPES = np.array([CUE + CUES.index(w) for w in sorted(CUES, key=_number)], np.int16)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    chars = code_points("\n".join(texts) + "\n")
    kind = _kinds()[chars]
    change = np.r_[True, kind[1:] != kind[:-1]]
    start = np.flatnonzero((kind > 0) & (change | (kind == 3)))
    edges = np.r_[np.flatnonzero(change), len(kind)]
    of = kind[start]
    end = np.where(of == 3, start + 1, edges[np.searchsorted(edges, start, side="right")])
    size = end - start
    shape = np.where(of == 2, DIGITS - 1 + np.minimum(size, 12), np.where(of == 1, LETTERS - 1 + np.minimum(size, 4), _mark_table()[chars[start]]))
    word = np.flatnonzero((of == 1) & (size <= 9))
    number, plain = np.zeros(len(word), np.int64), np.ones(len(word), bool)
    for j in range(9):
        on = size[word] > j
        c = chars[np.minimum(start[word] + j, len(chars) - 1)].astype(np.int64) | 0x20
        plain &= ~on | ((c >= 97) & (c <= 122))
        number = np.where(on, number * 27 + c - 96, number)
    at = np.minimum(np.searchsorted(_CUE_NUMBERS, number), len(CUES) - 1)
    cue = plain & (_CUE_NUMBERS[at] == number)
    shape[word[cue]] = _CUE_SHAPES[at[cue]]
    blank = np.r_[True, kind[:-1] == 0][start]
    begin = np.r_[0, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))]
    first = np.searchsorted(start, begin)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return (2 * shape + blank).astype(np.int16), start - begin[doc], end - begin[doc], first


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' tokens: shapes, where they begin and end in their text, and for each text the number of its first token (and the
    total at the end). A token is a run of letters or of ASCII digits or one other character. Long texts are worked off in parts
    that are cut at white space."""
    parts, owner, moved = [], [], []
    for d, t in enumerate(texts):
        a = 0
        while a < len(t) or not a:
            m = _SPACES.search(t, a + PART) if len(t) - a > PART else None
            b = m.end() if m else len(t)
            parts.append(t[a:b])
            owner.append(d)
            moved.append(a)
            a = max(b, 1)
    out, i = [], 0
    while i < len(parts):
        j, size = i, 0
        while j < len(parts) and (j == i or size + len(parts[j]) <= 2 * PART):
            size += len(parts[j])
            j += 1
        shape, start, end, first = _tokens(parts[i:j])
        n = np.diff(first)
        add = np.repeat(np.array(moved[i:j], np.int64), n)
        out.append((shape, (start + add).astype(np.int32), (end + add).astype(np.int32), n))
        i = j
    if not out:
        return np.empty(0, np.int16), np.empty(0, np.int32), np.empty(0, np.int32), np.zeros(1, np.int64)
    shape, start, end, n = (np.concatenate(x) for x in zip(*out, strict=True))
    return shape, start, end, np.r_[0, np.cumsum(np.bincount(np.array(owner), n, len(texts)).astype(np.int64))]


N_FEATURES = 9
REACH = 3  # tokens before and after that a label looks at


def _padded(shape: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shapes with REACH places outside before each text and after the last, and each text's place."""
    n = np.diff(first)
    begin = first[:-1] + REACH * np.arange(1, len(n) + 1)
    out = np.zeros(len(shape) + REACH * (len(n) + 1), np.int32)
    out[np.arange(len(shape)) + REACH * (1 + np.repeat(np.arange(len(n)), n))] = shape
    return out, begin


def _features(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The N_FEATURES features of the tokens at the places `at` of padded shapes, as numbers: the shapes near the token, and the pairs
    of its own with the one before and after."""
    c = s[at]
    near = [(k + REACH) * SHAPES + s[at + k] for k in range(-REACH, REACH + 1)]
    pairs = 7 * SHAPES + np.stack([s[at - 1] * SHAPES + c, SHAPES * SHAPES + c * SHAPES + s[at + 1]])
    return np.stack([*near, *pairs], -1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


#: Stretches of more tokens are decoded in parts of so many.
STRETCH = 512


#: A span's probability is that of its labels given O so many tokens before it, whatever comes after.
WINDOW = 12
#: The share of found spans that have to be right where the bar of a kind is set; the bar where there is nothing to set it by.
PRECISION, BAR = 0.98, 0.5


@dataclass
class RandomField:
    near: np.ndarray  # for each place in reach and shape the labels' weights; those next to the token are in `pairs`
    pairs: np.ndarray  # two tables of SHAPES x SHAPES: the token and the one before, the token and the one after
    moves: np.ndarray  # from label to label
    begin: np.ndarray
    bars: dict[str, float] | None = None  # the least probability of a span that counts, by kind

    def probability(self, s: np.ndarray, at: int, before: int, after: int, path: np.ndarray) -> float:
        """The marginal probability that the tokens from the place `at` on have the labels of the path and no more tokens belong to it; before, after: how
        many tokens the text has around it."""
        a, n = min(before, WINDOW), len(path)
        b = min(after, WINDOW)
        e = self.emissions(s, np.arange(at - a, at + n + b))
        told = e.copy()
        other = np.ones(e.shape[1], bool)
        for t, label in enumerate(path):
            other[:] = True
            other[label] = False
            told[a + t, other] = -1e6
        if b:
            told[a + n, path[-1] + path[-1] % 2] = -1e6  # the kind's I-
        first = self.begin if a == before else self.moves[0]

        def total(x: np.ndarray) -> float:
            now = x[0] + first
            for step in x[1:]:
                now = _log_sum(now[:, None] + self.moves, 0) + step
            return float(_log_sum(now, 0))

        return float(np.exp(total(told) - total(e)))

    def emissions(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The labels' weights of the tokens at the places `at` of padded shapes."""
        out = self.pairs[0][s[at - 1] * SHAPES + s[at]] + self.pairs[1][s[at] * SHAPES + s[at + 1]]
        for k in (-3, -2, 2, 3):
            out += self.near[k + REACH][s[at + k]]
        return out

    def _block(self, s: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(steps, stretches, labels): the weights of stretches that begin at `at`; beyond their size they don't count."""
        t = np.arange(size.max())[:, None]
        return self.emissions(s, at + np.minimum(t, size - 1))

    def _through(self, s: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(stretches, label before, last label): the weight of the best path."""
        e, back = self._block(s, at, size), np.ascontiguousarray(self.moves.T)
        best = self.moves[None] + e[0][:, None, :]
        for t in range(1, len(e)):
            step = (best[:, :, None, :] + back).max(3) + e[t][:, None, :]
            best = np.where((size > t)[:, None, None], step, best)
        return best

    def _paths(self, s: np.ndarray, at: np.ndarray, size: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(stretches, steps): the best labels after the label `before` up to the label `last`; -1: the text begins, or any label."""
        e, back = self._block(s, at, size), np.ascontiguousarray(self.moves.T)
        n = np.arange(len(at))
        best = e[0] + np.where((before < 0)[:, None], self.begin, self.moves[before])
        came = np.zeros((len(e), len(at), len(LABELS)), np.int8)
        for t in range(1, len(e)):
            path = best[:, None, :] + back
            came[t] = path.argmax(2)
            best = np.where((size > t)[:, None], path.max(2) + e[t], best)
        label = np.where(last < 0, best.argmax(1), last)
        out = np.zeros((len(at), len(e)), np.int8)
        for t in range(len(e) - 1, -1, -1):
            out[:, t] = label
            if t:
                label = np.where(size > t, came[t, n, label], label)
        return out

    def _sure(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the tokens at the places `at` have the label O on every best path.

        If a best path had another label there, the tokens p to q around it with labels other than O could all be made O. That
        changes its weight by no more than the sum of gains g of p to q, and `leave`: each token's g is its best other label, with
        the best move to it, less O and the move from O to O. If even the largest such sum is below 0 the path isn't best.
        """
        stay = self.moves[0, 0]
        enter = np.maximum(self.moves.max(0) - stay, self.begin - self.begin[0])[1:]
        leave = max(0.0, (self.moves[1:, 0] - stay).max())
        g = np.full(len(s), -1e6)  # no run goes beyond its text
        for i in range(0, len(at), 1 << 17):
            e = self.emissions(s, at[i : i + (1 << 17)])
            g[at[i : i + (1 << 17)]] = (e[:, 1:] + enter).max(1) - e[:, 0]

        def ending(x: np.ndarray) -> np.ndarray:
            """The largest sum of neighbouring numbers that ends at each place."""
            total = np.cumsum(x)
            return total - np.minimum.accumulate(np.r_[0.0, total[:-1]])

        most = ending(g) + ending(g[::-1])[::-1] - g + leave
        return most[at] < -1e-3

    def decode(self, shape: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label of every token by Viterbi, for all texts.

        Tokens that are surely O part a text into stretches whose best paths don't depend on each other. A stretch that is long
        all the same is cut: the best path through each part, from every label to every label, gives the labels at the cuts.
        """
        s, begin = _padded(shape, first)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.arange(len(shape)) - first[:-1][doc] + begin[doc]
        open_ = np.flatnonzero(~self._sure(s, at))
        out = np.zeros(len(shape), np.int8)
        if not len(open_):
            return out
        # stretches of open tokens, each with the sure token after it, if the text goes on
        new = np.r_[True, (open_[1:] > open_[:-1] + 1) | (doc[open_[1:]] != doc[open_[:-1]])]
        place, stop = open_[new], open_[np.r_[np.flatnonzero(new)[1:], len(open_)] - 1] + 1
        on = stop < first[1:][doc[place]]
        before, last, size = np.where(place > first[:-1][doc[place]], 0, -1), np.where(on, 0, -1), stop + on - place
        short = size <= STRETCH
        todo = [tuple(x[short] for x in (place, size, before, last))]
        todo += [self._cut(s, *(int(x[i]) for x in (at[place], place, size, before, last))) for i in np.flatnonzero(~short)]
        place, size, before, last = (np.concatenate(x) for x in zip(*todo, strict=True))
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            # stretches of very different lengths aren't padded together
            j = int(np.searchsorted(size[order], 2 * size[order[i]] + 16, side="right"))
            j = max(i + 1, min(j, i + (1 << 16) // int(size[order[j - 1]])))
            k = order[i:j]
            labels = self._paths(s, at[place[k]], size[k], before[k], last[k])
            live = np.arange(labels.shape[1]) < size[k][:, None]
            out[(place[k][:, None] + np.arange(labels.shape[1]))[live]] = labels[live]
            i = j
        return out

    def _cut(self, s: np.ndarray, at: int, place: int, size: int, before: int, last: int) -> tuple[np.ndarray, ...]:
        """A long stretch as parts: where they are, their sizes, and the labels before and at the end of each."""
        cuts = np.arange(0, size, STRETCH)
        sizes = np.minimum(STRETCH, size - cuts)
        score, links = self._first(s, at, int(sizes[0]), before), []
        for i in range(1, len(cuts), 32):
            for m in self._through(s, at + cuts[i : i + 32], sizes[i : i + 32]):
                path = score[:, None] + m
                links.append(path.argmax(0))
                score = path.max(0)
        ends = np.empty(len(cuts), np.int64)
        ends[-1] = score.argmax() if last < 0 else last
        for i in range(len(cuts) - 1, 0, -1):
            ends[i - 1] = links[i - 1][ends[i]]
        return place + cuts, sizes, np.r_[before, ends[:-1]], ends

    def _first(self, s: np.ndarray, at: int, size: int, before: int) -> np.ndarray:
        """The weight of the best path from the label before, or the text's begin, to each label."""
        e = self.emissions(s, at + np.arange(size))
        best = e[0] + (self.begin if before < 0 else self.moves[before])
        for t in range(1, size):
            best = (best[:, None] + self.moves).max(0) + e[t]
        return best


def fit(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> RandomField:
    """The field that maximises the examples' likelihood, less `decay` times the squared weights. Features that occur once teach
    nothing."""
    shape, start, end, first = tokens([text for text, _ in examples])
    gold = np.zeros(len(shape), np.int64)
    for d, (_, spans) in enumerate(examples):
        for kind, a, b in spans:
            t = first[d] + np.flatnonzero((start[first[d] : first[d + 1]] >= a) & (end[first[d] : first[d + 1]] <= b))
            gold[t] = LABELS.index("I-" + kind)
            gold[t[:1]] = LABELS.index("B-" + kind)
    k = len(LABELS)
    moves, begin = np.zeros((k, k)), np.zeros(k)
    # an I- label follows only its own kind
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            begin[j] = -1e4
            moves[[i for i, other in enumerate(LABELS) if other[2:] != name[2:]], j] = -1e4
    size = np.diff(first)
    some = np.flatnonzero(size)
    n, steps = len(some), int(size.max(initial=1))
    live = np.arange(steps) < size[some][:, None]
    s, place = _padded(shape, first)
    found = _features(s, np.concatenate([place[d] + np.arange(size[d]) for d in some]) if n else np.empty(0, np.int64))
    names, inverse, times = np.unique(found, return_inverse=True, return_counts=True)
    number = np.where(times > 1, np.cumsum(times > 1) - 1, (times > 1).sum())
    coded = np.full((n, steps, N_FEATURES), (times > 1).sum())
    coded[live] = number[inverse.reshape(found.shape)]
    y = np.zeros((n, steps), np.int64)
    y[live] = gold
    weights = np.zeros(((times > 1).sum() + 1, k))  # the last, of unknown features, stays zero
    speed = [np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)]
    for _ in range(rounds if n else 0):
        e = weights[coded].sum(2)
        forward = np.empty((steps, n, k))
        forward[0] = e[:, 0] + begin
        for t in range(1, steps):
            forward[t] = np.where(live[:, t, None], _log_sum(forward[t - 1][:, :, None] + moves, 1) + e[:, t], forward[t - 1])
        total = _log_sum(forward[-1], 1)
        after = np.zeros((n, k))
        grad_e, grad_m = np.zeros((n, steps, k)), np.zeros((k, k))
        for t in range(steps - 1, -1, -1):
            on = live[:, t, None]
            p = np.exp(forward[t] + after - total[:, None])
            grad_e[:, t] = np.where(on, np.eye(k)[y[:, t]] - p, 0)
            if t:
                step = (e[:, t] + after)[:, None, :] + moves
                joint = np.exp(forward[t - 1][:, :, None] + step - total[:, None, None])
                grad_m -= joint[live[:, t]].sum(0)
                np.add.at(grad_m, (y[live[:, t], t - 1], y[live[:, t], t]), 1)
                after = np.where(on, _log_sum(step, 2), after)
        grad_w = np.zeros_like(weights)
        np.add.at(grad_w, coded[live], grad_e[live][:, None, :])
        for w, g, v in ((weights, grad_w, speed[0]), (moves, np.where(moves > -1e3, grad_m, 0), speed[1])):
            g = g - decay * np.where(w > -1e3, w, 0)
            v += g * g
            w += rate * g / np.sqrt(v)
        weights[-1] = 0
    flat = np.zeros((7 * SHAPES + 2 * SHAPES * SHAPES, k))
    flat[names] = weights[number]
    near, pairs = flat[: 7 * SHAPES].reshape(7, SHAPES, k), flat[7 * SHAPES :].reshape(2, SHAPES, SHAPES, k)
    pairs[0] += near[REACH - 1][:, None] + near[REACH]
    pairs[1] += near[REACH + 1]
    return RandomField(near, pairs.reshape(2, SHAPES * SHAPES, k), moves, begin)


def labelled_examples(n: int = 500, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table, made from templates: sentences with personal data in several notations, and with numbers that
    are none."""
    r = random.Random(seed)
    syllables = "an ber co de el fa gu hi jo ka le mo nu or pi ra so tu vi we".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = "4" + digits(14)
        full = next(body + d for d in "0123456789" if luhn(body + d))
        return r.choice([full, " ".join(full[i : i + 4] for i in (0, 4, 8, 12)), "-".join(full[i : i + 4] for i in (0, 4, 8, 12))])

    area = lambda: str(r.randint(200, 989))
    makers = {
        "email": [
            lambda: f"{word()}@{word()}.com",
            lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.{word()}.org",
            lambda: f"{word()} (at) {word()}.com",
            lambda: f"{word()}[at]{word()}.net",
            lambda: f"{word()} [at] {word()} [dot] com",
            lambda: f"{word()}.{word()}(at){word()}(dot)org",
            lambda: f"{word()} {r.choice(['at', 'AT'])} {word()} {r.choice(['dot', 'DOT'])} {r.choice(['com', 'net', 'org'])}",
            lambda: f"{word()}{r.choice(['.', ' dot ', ''])}{word()} at {word()} dot {r.choice(['com', 'net', 'org'])}",
        ],
        "ip": [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))],
        "card": [card],
        "phone": [
            lambda: f"+1 ({area()}) 555-{digits(4)}",
            lambda: f"({area()}) 555-{digits(4)}",
            lambda: f"({area()}) {digits(3)} {digits(4)}",
            lambda: f"{area()}-{digits(3)}-{digits(4)}",
            lambda: f"{area()}.{digits(3)}.{digits(4)}",
            lambda: f"+{r.randint(20, 99)} {digits(2)} {digits(4)} {digits(4)}",
            lambda: f"00{r.randint(20, 99)} {digits(2)} {digits(4)} {digits(4)}",
            lambda: f"0{digits(2)} {digits(4)} {digits(4)}",
            lambda: f"0{digits(3)}/{digits(7)}",
            lambda: f"{area()}/{digits(3)}-{digits(4)}",
            lambda: f"{area()}\u2013{digits(3)}\u2013{digits(4)}",
        ],
    }
    none = [
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}:{digits(2)}:{digits(2)}",
        lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1990, 2030)} {r.randint(10, 23)}:{digits(2)}",
        lambda: f"{digits(2)}.{digits(3)}.{digits(3)},{digits(2)}",
        lambda: " ".join(digits(r.randint(1, 3)) for _ in range(r.randint(3, 8))),
        lambda: f"{r.randint(10, 28)}/{r.randint(10, 12)}/{r.randint(1990, 2030)}",
        lambda: f"{digits(4)}/{digits(4)}/{digits(4)}",
        lambda: f"{r.randint(1900, 1999)}\u2013{r.randint(2000, 2030)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(16, 40))),
        lambda: f'key = "{word()}_{"".join(r.choice("0123456789abcdef") for _ in range(r.randint(16, 40)))}"',
        lambda: f"version {digits(1)}.{digits(2)}.{digits(1)}",
        lambda: f"order no {digits(r.randint(9, 12))}",
        lambda: f"id {digits(r.randint(9, 18))}",
        lambda: digits(r.randint(9, 20)),
        lambda: f"{digits(4)}-{digits(4)}-{digits(4)}",
        lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"({digits(1)}) {word()} ({digits(1)}) {word()}",
        lambda: f"{digits(2)} {word()} (at {word()}) {digits(3)}",
        lambda: f"| {digits(3)} | {digits(5)} | {digits(4)} |",
        lambda: f"{word()} at {word()} {word()}",
        lambda: f"{word()} at the {word()} dot. {word()}",
        lambda: f"{word()} dot {word()} at {word()}",
        lambda: f"{word()} at {word()}.com" if r.random() < 0.3 else f"{word()} {word()}.com {word()}",
    ]
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 4))), []
        for _ in range(r.randint(1, 2)):
            lead = r.choice([" ", " ", " ", ". ", ", ", " tel. ", " call "])
            text += lead if text else ""
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                s = r.choice(makers[kind])()
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = r.choice(none)()
            text += s + r.choice([" ", ". ", ", ", " "]) + " ".join(word() for _ in range(r.randint(1, 4)))
        out.append((text, spans))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, s) for t, s in labelled_examples()], f"text string, spans {SPANS}")


def train(labelled: DataFrame, rows: int = 2_000) -> RandomField:
    """The field fitted to at most `rows` rows (text, spans) of the labelled table, in the order of their texts, with bars."""
    held = labelled.where("text is not null").orderBy("text").limit(rows).collect()
    return _trained(tuple((r.text, tuple(tuple(s) for s in r.spans or [])) for r in held))


@lru_cache(4)
def _trained(examples: tuple) -> RandomField:
    """Fitted to four of five examples; the fifth one sets the bars. The same table isn't fitted again."""
    some = [(t, list(s)) for t, s in examples]
    held = some[::5] if len(some) >= 50 else []
    return calibrated(fit([x for i, x in enumerate(some) if not held or i % 5]), held)


def calibrated(m: RandomField, examples: list[tuple[str, list[tuple[str, int, int]]]], precision: float = PRECISION) -> RandomField:
    """The field with the lowest bars at which, of the spans that it finds in these examples, the share `precision` is right."""
    m.bars = dict.fromkeys(KINDS, 0.0)
    found: dict[str, list[tuple[float, bool]]] = {k: [] for k in KINDS}
    for (_, gold), spans in zip(examples, _decoded(m, [t for t, _ in examples]), strict=True):
        for kind, a, b, p in spans:
            found[kind].append((p, (kind, a, b) in gold))
    for kind, spans in found.items():
        spans.sort(reverse=True)
        right = np.cumsum([ok for _, ok in spans])
        fine = np.flatnonzero(right >= precision * np.arange(1, len(spans) + 1))
        at = fine[-1] if len(fine) else -1
        # between the last span that is let in and the next one, which isn't
        cut = BAR if at + 1 == len(spans) else (spans[at][0] + spans[at + 1][0]) / 2 if at >= 0 else 0.99
        m.bars[kind] = min(max(cut, BAR), 0.99)
    return m


def _decoded(m: RandomField, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """For each text the field's spans that can be of their kind, with their probabilities; every token of every text is decoded."""
    shape, start, end, first = tokens(texts)
    labels = m.decode(shape, first)
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    begins = np.flatnonzero(labels % 2 == 1)  # B-; the next number is the same kind's I-
    s, begin = _padded(shape, first) if len(begins) else (shape, first)
    for t, d in zip(begins.tolist(), (np.searchsorted(first, begins, side="right") - 1).tolist(), strict=True):
        stop, inside = t + 1, labels[t] + 1
        while stop < first[d + 1] and labels[stop] == inside:
            stop += 1
        kind, a, b = LABELS[labels[t]][2:], int(start[t]), int(end[stop - 1])
        if _valid(kind, texts[d][a:b]) if kind != "email" else stop > t + 2:
            p = m.probability(s, int(t - first[d] + begin[d]), int(t - first[d]), int(first[d + 1] - stop), labels[t:stop])
            out[d].append((kind, a, b, p))
    return out


def added_spans(m: RandomField, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """For each text the spans that the field finds beyond the patterns': those whose probability reaches their kind's bar, and whose numbers pass their
    kind's check."""
    bars = m.bars or dict.fromkeys(KINDS, BAR)
    found = [[(k, a, b) for k, a, b, p in x if p >= bars[k]] for x in _decoded(m, texts)]
    return [[x for x in some if not _meets(x, spans)] if some and spans else some for some, spans in zip(found, base, strict=True)]


def _meets(span: tuple[str, int, int], others: list[tuple[str, int, int]]) -> bool:
    return any(a < span[2] and span[1] < b for _, a, b in others)


def find_pii(docs: DataFrame, field: RandomField, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` (by default the id), base and spans (arrays of (kind, start, end)) and masked for every row.

    Places count code points, the end is exclusive; spans are in the order of start and kind. base: what the patterns find;
    spans: these and what the field adds. masked: the text with each span, or run of overlapping spans, replaced by the
    first one's kind in angle brackets. A null text has no spans and masked null. Columns of docs named like a result give
    way. Rows and ids may repeat; an empty table gives an empty result.
    """
    results = ("base", "spans", "masked")
    keep = tuple(c for c in keep or (id_col,) if c not in results)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_dicts = lambda rows: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], kind)

    def run(batches):
        for b in text_slices(batches, text_col):
            raw = b.column(text_col)
            texts = pc.fill_null(raw, "").to_pylist()
            base = [base_spans(t) for t in texts]
            added = added_spans(shared.value, texts, base)
            spans = [sorted(x + y, key=lambda s: (s[1], KINDS.index(s[0]))) if y else x for x, y in zip(base, added, strict=True)]
            masked = [mask(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            masked = pc.if_else(raw.is_null(), pa.scalar(None, pa.string()), pa.array(masked, pa.string()))
            yield pa.record_batch([*(b.column(c) for c in keep), as_dicts(base), as_dicts(spans), masked], [*keep, *results])

    fields = ", ".join(f"{n} {SPANS}" for n in results[:2])
    schema = docs.select(*keep).schema
    for f in docs.sparkSession.createDataFrame([], f"{fields}, masked string").schema:
        schema = schema.add(f)
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
