"""BPE as a deterministic automaton over tokens, built by one merge gadget for each merge, and run by table.

Construction. Start with one state that has an arc for each byte, leading back to it. The gadget of a merge (u, v) -> w
copies the state that u leads to, leaves v's arc out of the copy, leads u's arcs to the copy, and adds an arc w wherever u
followed by v could be read, leading where v led. After all gadgets the words that the automaton accepts are exactly the
right tokenizations. All arcs with one label lead to one state, so the compiled automaton has for each label its state
(`state_of`), and for each state one label that leads there (`label_of`), by which its arcs are told: the state after s
lacks the arc t exactly if some gadget took it out, and the gadgets that could are those of a token on the right spine of s
with one on the left spine of t, if they ran before the spines parted. Spines and gadgets are arrays, so arcs are worked
out for many pairs at once. The table of transitions (state, label) that was met is kept; whole, it would have a state for
each gadget times an arc for each token (2.5e9 entries for 50,000 merges).

Encoding steps many pre-split words at once from left to right. A byte trie, also a table, gives the labels that can be read
at each place; of those ending at a place, one alone has a transition from the state of the place where it began, as a
prefix has one right tokenization. The path is read back from the end. Decoding emits arc labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import CACHE_LENGTH, bounded, cut, cut_special
from .tables import Table, worker_table

#: How the byte-level scheme cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bits of the number of slots for transitions met; half of them are used before the table starts anew.
TRANSITIONS = 20
#: Bytes of words that are stepped at once, and pieces kept by a worker.
STEPPED, PIECES = 1 << 18, 200_000
NEVER = 1 << 40


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Built from a vocabulary (token -> id), merges in order of rank, and special strings (-> id)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        to_byte = byte_symbols()
        self.special = special
        labels = {i: bytes(map(to_byte.__getitem__, t)) for t, i in vocab.items() if all(c in to_byte for c in t)}
        labels |= {i: s.encode() for s, i in special.items()}
        self.size = max(labels, default=0) + 1
        self.left, self.right = np.full(self.size, -1, np.int32), np.full(self.size, -1, np.int32)
        self.rank = np.full(self.size, NEVER, np.int64)
        bytes_ = [vocab[c] for c in to_byte if c in vocab]
        self.state_of = np.full(self.size, -1, np.int32)
        self.state_of[bytes_] = 0
        self.label_of = [bytes_[0] if bytes_ else 0]
        gadgets: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.state_of[w] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            read = self.state_of[u] >= 0 and self.state_of[v] >= 0 and self._arc(gadgets, u, v, rank)
            if read:  # w leads where v led; then u leads to a copy without v
                self.state_of[w] = self.state_of[v]
                self.left[w], self.right[w], self.rank[w] = u, v, rank
            if self.state_of[u] >= 0:
                self.state_of[u] = len(self.label_of)
                self.label_of.append(u)
            gadgets[u, v] = rank
        self.label_of = np.array(self.label_of, np.int32)
        later = np.full(len(self.label_of), -1, np.int32)
        alive = np.flatnonzero(self.state_of >= 0)
        later[self.state_of[alive]] = alive
        self.label_of = np.where(later >= 0, later, self.label_of)  # a label that leads there now
        pairs = np.array(list(gadgets), np.int64).reshape(-1, 2)
        self.gadgets = Table.of(pairs[:, 0] * self.size + pairs[:, 1], np.array(list(gadgets.values()), np.int64), np.int64)
        self._compile_trie({t: labels[t] for t in alive.tolist()})
        stops = np.zeros(self.size, np.int64)
        for i, label in labels.items():
            stops[i] = len(label)
        self.lengths = stops.astype(np.int32)
        self.starts = np.cumsum(stops) - stops
        self.spelt = np.frombuffer(b"".join(labels.get(i, b"") for i in range(self.size)), np.uint8)

    def _arc(self, gadgets: dict[tuple[int, int], int], s: int, t: int, before: int) -> bool:
        """Whether, once the gadgets before a rank have run, the state that s leads to has an arc t."""
        a, copied = s, before
        while True:
            b, added = t, before
            while True:
                r = gadgets.get((a, b))
                if r is not None and r < copied and r <= added:
                    return False
                if self.left[b] < 0:
                    break
                b, added = int(self.left[b]), self.rank[b]
            if self.right[a] < 0:
                return True
            a, copied = int(self.right[a]), self.rank[a]

    def _compile_trie(self, labels: dict[int, bytes]) -> None:
        children: dict[int, int] = {}
        ends = [-1]
        for t, label in labels.items():
            node = 0
            for c in label:
                key = node << 8 | c
                node = children.get(key, -1)
                if node < 0:
                    node = children[key] = len(ends)
                    ends.append(-1)
            ends[node] = t
        self.trie = Table.of(np.fromiter(children.keys(), np.int64), np.fromiter(children.values(), np.int64))
        self.token_at = np.array(ends, np.int32)
        self.first = self.trie.get(np.arange(256, dtype=np.int64))

    def arcs(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether each state has an arc with each label, as _arc() after all gadgets."""
        ok = np.ones(len(states), bool)
        at = np.arange(len(states))
        a, copied = self.label_of[states], np.full(len(states), NEVER)
        while len(at):
            on = at  # the right spine's places whose left spines are walked
            b, added = labels[on], np.full(len(on), NEVER)
            x, c = a, copied
            while len(on):
                r = self.gadgets.get(x.astype(np.int64) * self.size + b)
                gone = (r >= 0) & (r < c) & (r <= added)
                ok[on[gone]] = False
                go = ~gone & (self.left[b] >= 0)
                on, x, c, b = on[go], x[go], c[go], b[go]
                added, b = self.rank[b], self.left[b]
            go = ok[at] & (self.right[a] >= 0)
            at, a = at[go], a[go]
            copied, a = self.rank[a], self.right[a]
        return ok

    def step(self, table: Table, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether there are transitions; the start, state -1, has all. `table` holds those met before."""
        out = np.ones(len(states), bool)
        at = np.flatnonzero(states >= 0)
        keys = states[at].astype(np.int64) * self.size + labels[at]
        got = table.get(keys)
        new = got < 0
        if new.any():
            fresh, back = np.unique(keys[new], return_inverse=True)
            found = self.arcs(fresh // self.size, fresh % self.size).astype(np.int8)
            got[new] = found[back]
            table.put(fresh, found)
        out[at] = got > 0
        return out

    def encode_words(self, words: list[bytes], table: Table) -> list[bytes]:
        """The labels along the only accepted path that spells each word, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        begin = 0
        while begin < len(order):  # words of like length go together
            most, stop, total = max(8, 2 * int(sizes[order[begin]])), begin, 0
            while stop < len(order) and sizes[order[stop]] <= most and total < STEPPED:
                total += int(sizes[order[stop]])
                stop += 1
            chosen = order[begin:stop]
            ids, bounds = self._encode([words[i] for i in chosen.tolist()], sizes[chosen], table)
            raw, bounds = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
            for i, a, b in zip(chosen.tolist(), bounds[:-1], bounds[1:], strict=True):
                out[i] = raw[a:b]
            begin = stop
        return out

    def _encode(self, words: list[bytes], sizes: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
        """All labels in order, and where each word's begin and the last ends."""
        data = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum(sizes)
        starts = stops - sizes
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        room = np.repeat(stops, sizes)  # where the word of a byte ends
        # labels that can be read at each byte
        at, node = np.arange(len(data)), self.first[data] if len(data) else np.zeros(0, np.int32)
        found_at, found, depth = [], [], 1
        at, node = at[node >= 0], node[node >= 0]
        while len(at):
            t = self.token_at[node]
            hit = t >= 0
            found_at.append(at[hit])
            found.append(t[hit])
            go = at + depth < room[at]
            at, node = at[go], node[go]
            node = self.trie.get(node.astype(np.int64) << 8 | data[at + depth])
            at, node = at[node >= 0], node[node >= 0]
            depth += 1
        found_at, found = np.concatenate(found_at or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int32)])
        order = np.argsort(place[found_at].astype(np.int32), kind="stable")
        found_at, found = found_at[order], found[order]
        cuts = np.searchsorted(place[found_at], np.arange(int(sizes.max(initial=0)) + 1))
        # places are counted with one more at each word's end; the state at a word's begin is the start
        shift = np.repeat(np.arange(len(words)), sizes)
        last = np.full(len(data) + len(words), -1, np.int32)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            where, t = found_at[a:b], found[a:b]
            here = where + shift[where]
            before = last[here]
            go = self.step(table, np.where(before >= 0, self.state_of[before], -1), t)
            go &= (before >= 0) | (place[where] == 0)
            last[here[go] + self.lengths[t[go]]] = t[go]
        # back from each word's end
        ends = stops + np.arange(len(words))
        begins = ends - sizes
        now, live = ends.copy(), np.flatnonzero(sizes > 0)
        path = []
        while len(live):
            t = last[now[live]]
            if (t < 0).any():
                raise ValueError("no path")
            path.append((live, t))
            now[live] -= self.lengths[t]
            live = live[now[live] > begins[live]]
        counts = np.zeros(len(words), np.int64)
        for live, _ in path:
            counts[live] += 1
        tails = np.cumsum(counts)
        ids = np.empty(int(tails[-1]) if len(tails) else 0, np.int32)
        for i, (live, t) in enumerate(path):
            ids[tails[live] - 1 - i] = t
        return ids, np.concatenate([[0], tails])


@lru_cache(2)
def automaton(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
    return Automaton(j["model"]["vocab"], merges, {x["content"]: x["id"] for x in j["added_tokens"]})


_split = regex.compile(WORDS)


def encode_batch(texts: list[str], a: Automaton) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    known = bounded(worker_table("bpe_automaton", "pieces"), PIECES)
    table = worker_table("bpe_automaton", "transitions", lambda: Table(TRANSITIONS, np.int8))
    special = next(iter(a.special)) if len(a.special) == 1 else None
    parts = [cut_special(t, special) if special else _cut_all(t, list(a.special)) for t in texts]
    new = list(set().union(*parts) - known.keys())
    split = [None if p in a.special else _split.findall(p) for p in new]
    words = list(set().union(*(s for s in split if s)))
    ids = dict(zip(words, a.encode_words([w.encode() for w in words], table), strict=True))
    now = {p: np.array([a.special[p]], "<u4").tobytes() if s is None else ids[s[0]] if len(s) == 1 else b"".join([ids[w] for w in s]) for p, s in zip(new, split, strict=True)}
    known.update({p: x for p, x in now.items() if len(p) <= CACHE_LENGTH})
    now = {p: x for p, x in now.items() if len(p) > CACHE_LENGTH}
    if now:
        return [b"".join([now[p] if p in now else known[p] for p in x]) for x in parts]
    return [b"".join(map(known.__getitem__, x)) for x in parts]


def _cut_all(text: str, special: list[str]) -> list[str]:
    """As cut(), with each special string as its own piece, the longest first where several begin together."""
    if not special:
        return cut(text)
    parts = regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text)
    return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else cut(part))]


def decode_batch(ids: list[bytes], a: Automaton) -> list[str]:
    """The text that ids spell, label by label; bytes that are no UTF-8 become replacement characters."""
    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
    n = a.lengths[flat].astype(np.int64)
    stops = np.cumsum(n)
    spelt = a.spelt[np.repeat(a.starts[flat] - (stops - n), n) + np.arange(int(stops[-1]) if len(stops) else 0)].tobytes()
    bounds = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)].tolist()
    return [spelt[x:y].decode("utf-8", "replace") for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Rows (id, n_tokens long, ids binary), one for each row of df; ids are little-endian unsigned 32-bit integers.

    decoded: one more column, the text that the ids spell, decoded from them in the same pass. The automaton is compiled
    once, on the driver, and broadcast; its size is that of the vocabulary. Null and empty texts have no ids. Repeated rows
    give repeated results, an empty table an empty one; other columns of df are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(automaton(path))
    names = ["id", "n_tokens", "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = encode_batch(b.column(1).to_pylist(), shared.value)
            more = [pa.array(decode_batch(ids, shared.value), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *more], names)

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = f"id {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary" + (", decoded string" if decoded else "")
    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of its ids (null: null) in out_col, which takes the place of a column of that name."""
    shared = df.sparkSession.sparkContext.broadcast(automaton(path))

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        got = ids.to_pylist()
        texts = iter(decode_batch([x for x in got if x is not None], shared.value))
        return pa.array([None if x is None else next(texts) for x in got], pa.string())

    return df.withColumn(out_col, decoded(F.col(ids_col)))
