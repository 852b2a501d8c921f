"""Byte-level BPE as a deterministic automaton over tokens, compiled from the merge list.

The automaton starts as one state with an arc for each byte. A merge (u, v) -> w applies a gadget: after an arc u the arc v is
cut, and every state that has an arc u gets an arc w, which leads where v led from there. A path's arcs then spell exactly
the tokens that the merges give. A state is told by the last token. The gadgets are applied one after the other in the form
of cut lists, and compiled into two tables, which are all that encoding reads: a row of bits for each state with an arc for each
token, made when the state is first met, and a dense table of byte transitions over the trie of all arc labels, failures
resolved, that names the arcs which end at a byte.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import text_slices, tokenizer_file
from .pretokens import WordCache, token_ids

NEVER = (1 << 31) - 1
#: Rows of the arc table that are held at once.
ROWS = 16_384
#: Words encoded at once, and the longest of these; longer ones go byte by byte through the same tables.
WORDS, LONGEST = 4_096, 96


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself, or one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class TokenAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]):
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = special
        self.labels = {i: to_bytes(s) for s, i in vocab.items() if s not in special} | {i: s.encode() for s, i in special.items()}
        self.cut: dict[int, dict[int, int]] = {}
        self.copied: dict[int, tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int]] = {}
        arcs = [vocab[c] for c in letters if c in vocab]
        for k, merge in enumerate(merges):
            a, b = merge if not isinstance(merge, str) else merge.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in self.made or not self._open(u, v, k):
                continue  # no path has u before v any more: the merge never applies
            self.cut.setdefault(u, {})[v] = k
            self.copied[w] = (v, k)
            self.made[w] = (u, k)
            arcs.append(w)
        self._compile_arcs(arcs)
        self._compile_bytes({self.labels[t]: t for t in arcs})

    def _cut_at(self, state: int, arc: int) -> int:
        """The number of the merge that cut the arc from the state, NEVER if none did."""
        first, before = NEVER, NEVER
        while True:
            k = self.cut.get(state, {}).get(arc, NEVER)
            if k < before:
                first = min(first, k)
            if state not in self.copied:
                return first
            state, copied = self.copied[state]
            before = min(before, copied)

    def _open(self, state: int, arc: int, at: int) -> bool:
        """Whether the state has the arc before merge number `at`: at each of its merges the arc to its left part was there."""
        before = at
        while True:
            if (k := self._cut_at(state, arc)) <= before and k != NEVER:
                return False
            if arc not in self.made:
                return True
            arc, before = self.made[arc]

    def _compile_arcs(self, arcs: list[int]) -> None:
        """What a row of the arc table is made from: each arc's left part and merge, by how many merges made its left side."""
        n = max(self.labels) + 1
        self._arcs = np.array(arcs)
        self._cuts = {u: (np.fromiter(c, np.int64, len(c)), np.fromiter(c.values(), np.int32, len(c))) for u, c in self.cut.items()}
        depth: dict[int, int] = {}
        for t in arcs:
            depth[t] = depth[self.made[t][0]] + 1 if t in self.made else 0
        self._levels = []
        for d in range(1, max(depth.values(), default=0) + 1):
            level = [t for t in arcs if depth[t] == d]
            self._levels.append((np.array(level), np.array([self.made[t][0] for t in level]), np.array([self.made[t][1] for t in level], np.int32)))
        self._row_of = np.full(n, -1, np.int32)
        self._rows = np.zeros((0, (n + 7) // 8), np.uint8)
        self._held = 0

    def _row(self, state: int) -> np.ndarray:
        """A bit for each token: whether the state has its arc after all merges."""
        cut, before = np.full(len(self._row_of), NEVER, np.int32), NEVER
        while True:
            if state in self._cuts:
                arc, k = self._cuts[state]
                on = k < before
                cut[arc[on]] = np.minimum(cut[arc[on]], k[on])
            if state not in self.copied:
                break
            state, copied = self.copied[state]
            before = min(before, copied)
        there = np.ones(len(cut), bool)
        for arc, left, k in self._levels:
            there[arc] = there[left] & (cut[left] > k)
        has = np.zeros(len(cut), bool)
        has[self._arcs] = there[self._arcs] & (cut[self._arcs] == NEVER)
        return np.packbits(has, bitorder="little")

    def has_arcs(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """Whether each state has the arc beside it; at most ROWS different states at once."""
        new = np.unique(state[self._row_of[state] < 0])
        if len(new):
            if self._held + len(new) > ROWS:
                self._row_of[:] = -1
                self._held, new = 0, np.unique(state)
            if self._held + len(new) > len(self._rows):
                grown = np.zeros((min(ROWS, 2 * (self._held + len(new))), self._rows.shape[1]), np.uint8)
                grown[: self._held] = self._rows[: self._held]
                self._rows = grown
            for x in new.tolist():
                self._rows[self._held] = self._row(x)
                self._row_of[x] = self._held
                self._held += 1
        return (self._rows[self._row_of[state], arc >> 3] >> (arc & 7).astype(np.uint8) & 1).astype(bool)

    def _compile_bytes(self, labels: dict[bytes, int]) -> None:
        """go: for each node of the trie of labels and each byte the node of the longest suffix that is in the trie; end: the node of
        the longest label that ends there, of which token and depth hold; shorter: the same for a shorter label, 0 for none."""
        children: list[dict[int, int]] = [{}]
        token, depth = [-1], [0]
        for label, t in sorted(labels.items()):
            at = 0
            for b in label:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    token.append(-1)
                    depth.append(depth[at] + 1)
                at = children[at][b]
            token[at] = t
        n = len(children)
        self.go, fail, end, shorter = np.zeros((n, 256), np.int32), np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for node in sorted(range(n), key=depth.__getitem__):
            f = fail[node]
            if node:
                self.go[node] = self.go[f]
                shorter[node] = end[f]
                end[node] = node if token[node] >= 0 else end[f]
            for b, child in children[node].items():
                fail[child] = self.go[f, b] if node else 0
                self.go[node, b] = child
        # a node without a label of its own goes on with what is shorter than the label that ends there
        self.end, self.shorter = end, shorter
        self.token, self.depth = np.array(token, np.int32), np.array(depth, np.int32)

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one pre-token. Each prefix has one path, so its last arc is enough to go on with."""
        last, step, at = [0], [0], 0
        for j, b in enumerate(word, 1):
            at = self.go[at, b]
            node = self.end[at]
            while True:
                t, n = int(self.token[node]), int(self.depth[node])
                if j == n:
                    break
                u = last[j - n]
                if self._row_of[u] < 0:
                    self.has_arcs(np.array([u]), np.array([t]))
                if self._rows[self._row_of[u], t >> 3] >> (t & 7) & 1:
                    break
                node = self.shorter[node]
            last.append(t)
            step.append(n)
        out, j = [], len(word)
        while j:
            out.append(last[j])
            j -= step[j]
        return out[::-1]

    def _encode_block(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of words in the order of their lengths, a byte of all words at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(size[-1])
        data = np.zeros((len(words), longest), np.uint8)
        data[np.arange(longest) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        last, step = np.zeros((longest + 1, len(words)), np.int32), np.zeros((longest + 1, len(words)), np.int32)
        at = np.zeros(len(words), np.int32)
        for j in range(1, longest + 1):
            a = int(np.searchsorted(size, j))
            at[a:] = self.go[at[a:], data[a:, j - 1]]
            node, todo = self.end[at[a:]], np.arange(a, len(words))
            while len(todo):
                t, n = self.token[node], self.depth[node]
                ok = n == j
                inner = np.flatnonzero(~ok)
                ok[inner] = self.has_arcs(last[j - n[inner], todo[inner]], t[inner])
                last[j, todo[ok]], step[j, todo[ok]] = t[ok], n[ok]
                node, todo = self.shorter[node[~ok]], todo[~ok]
        out: list[list[int]] = [[] for _ in words]
        place, each = size.copy(), np.flatnonzero(size)
        while len(each):
            for i, t in zip(each.tolist(), last[place[each], each].tolist(), strict=True):
                out[i].append(t)
            place[each] -= step[place[each], each]
            each = each[place[each] > 0]
        return [x[::-1] for x in out]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out: list = [[self.special[w]] if w in self.special else None for w in words]
        coded = {i: w.encode() for i, w in enumerate(words) if out[i] is None}
        short = sorted((i for i, b in coded.items() if len(b) <= LONGEST), key=lambda i: len(coded[i]))
        for k in range(0, len(short), WORDS):
            part = short[k : k + WORDS]
            for i, ids in zip(part, self._encode_block([coded[i] for i in part]), strict=True):
                out[i] = ids
        return [self.encode(coded[i]) if x is None else x for i, x in enumerate(out)]


@lru_cache(2)
def automaton(path: str) -> tuple[TokenAutomaton, WordCache, np.ndarray, np.ndarray]:
    """The automaton of a vocabulary file, a cache before it, and its arc labels: all bytes, and where each token's begin."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if len(special) > 1:
        raise ValueError("texts are split at one added token only")
    a = TokenAutomaton(spec["model"]["vocab"], spec["model"]["merges"], special)
    size = [len(a.labels.get(i, b"")) for i in range(max(a.labels) + 1)]
    flat = np.frombuffer(b"".join(a.labels.get(i, b"") for i in range(len(size))), np.uint8)
    return a, WordCache(a.encode_words), flat, np.r_[0, np.cumsum(size)]


def emit_labels(ids: np.ndarray, first: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """The labels of each text's arcs, one after the other."""
    size = (begin[1:] - begin[:-1])[ids]
    ends = np.cumsum(size)
    place = np.repeat(begin[:-1][ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    data = flat[place].tobytes()
    cut = np.r_[0, ends][first]
    return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """(id_col, ids array<int>, decoded string) for every row: the text's tokens, and the text that their labels spell.

    A special token's string inside a text becomes that token. A null or empty text has no tokens and decodes to ''. Rows and
    ids may repeat; an empty table gives an empty result; other columns are not read.
    """
    path = tokenizer_file(vocabulary, folder)

    def run(batches):
        a, cache, flat, begin = automaton(path)
        special = next(iter(a.special), None)
        for b in text_slices(batches, text_col):
            texts = pc.fill_null(b.column(text_col), "").to_pylist()
            ids, first = token_ids(texts, cache, special)
            out = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.view(np.int32)))
            decoded = [x.decode("utf-8", "replace") for x in emit_labels(ids, first, flat, begin)]
            yield pa.record_batch([b.column(id_col), out, pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")
