"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has an arc for every vocabulary piece that occurs in it. Arc
weights are unigram probabilities that fall with the vocabulary's own order
(Zipf: weight ~ 1 / (rank + shift)), raised to ``theta``. Forward sums over the
lattice make every partial segmentation's total probability known exactly, so a
perturbed A-star search needs no heuristic beyond them: the agenda holds sets of
segmentations with the maximum of their Gumbel-perturbed log probabilities, the
best set is popped, its best member completed, and what remains of the set goes
back with a maximum drawn below the one just used.

Two things make this fast. No piece crosses certain character boundaries (the
start of a word, a line break, most punctuation), so the lattice is a chain of
small ones, shared by all occurrences of the same chunk. And a popped set's best
member is completed by backward sampling, over all texts of a batch at once,
while the siblings that it passes stay on the agenda as one set until popped.

With x = exp(-G) the search is a race of exponentials: a set of mass m bounded
by x gets x + Exp(1) / m. The inclusion score of a sample is the logarithm of
1 - exp(-p * x'), x' being the best value left on the agenda after k pops.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folkmoot.llm.common import TOKENIZERS, Intake, kept, vocabulary

SPACE = "▁"
LITERAL = "\U0010ffff"  # stands for a U+2581 that the text itself holds
ARCS_KEPT = 1_000_000
PLAIN, GROWTH, SLICE = 100, 40.0, 8192
M64 = (1 << 64) - 1


class Trie:
    """A vocabulary's prefixes as a double array: a node's child by a kind of character is at its offset plus the kind, if its parent says so."""

    def __init__(self, ids: dict[str, int]):
        kinds = {c: n for n, c in enumerate(sorted({c for p in ids for c in p}), 1)}
        self.kind = np.zeros(0x110000, dtype=np.int32)  # 0: in no piece
        for c, n in kinds.items():
            self.kind[ord(c)] = n
        self.depth = max(map(len, ids))
        children: dict[str, list[int]] = {"": []}
        for p in ids:
            for j in range(len(p), 0, -1):
                if p[:j] in children:
                    break
                children[p[:j]] = []
        for p in children:
            if p:
                children[p[:-1]].append(kinds[p[-1]])
        size = 4 * len(children) + len(kinds) + 1
        parent = [-1] * size
        base = [0] * size
        piece = [-1] * size
        rng, place = random.Random(1), {"": 0}
        chars = {n: c for c, n in kinds.items()}
        # By length, so that a parent has its place first, and of equal length the largest families first.
        parent[0] = -2
        for p in sorted(children, key=lambda p: (len(p), -len(children[p]), p)):
            at, kids = place[p], children[p]
            piece[at] = ids.get(p, -1)
            if kids:
                while any(parent[b + k] != -1 for k in kids) if (b := rng.randrange(1, size - len(kinds))) else True:
                    pass
                base[at] = b
                for k in kids:
                    parent[b + k] = at
                    place[p + chars[k]] = b + k
        self.base, self.parent, self.piece = (np.array(x, dtype=np.int32) for x in (base, parent, piece))

    def step(self, node: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children by kinds of character, and whether there are such."""
        to = self.base[node] + kind
        return to, (self.parent[to] == node) & (kind > 0)


class Pieces:
    """A SentencePiece vocabulary: pieces with weights, byte tokens, and where no piece crosses."""

    def __init__(self, path: str, theta: float = 1.0, shift: float = 10.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id: dict[int, int] = {}
        order = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
                self.bytes_of[i] = p.replace(SPACE, " ").encode()
                order.append((-sp.get_score(i), i))
        order.sort()
        w = np.array([1.0 / (r + shift) for r in range(len(order))])
        w = (w / w.sum()) ** theta
        self.weight = {i: float(x) for (_, i), x in zip(order, w)}
        self.byte_weight = float(w.min())
        self.longest = max(map(len, self.ids))
        self.trie = Trie(self.ids)
        # Weights by length keep short chunks' sums near 1.
        self.scaled_array = np.zeros(n)
        for p, i in self.ids.items():
            self.scaled_array[i] = self.weight[i] * GROWTH ** len(p)
        self.chunks = self._chunks()

    def _chunks(self):
        """The pattern that cuts a text where no piece can cross."""
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b == SPACE and a != SPACE for a, b in pairs) or any("\n" in p for p in self.ids):
            return None
        # ASCII marks suffice: a cut that is left out costs no more than a longer chunk.
        marks = {c for p in self.ids for c in p if c.isascii() and not c.isalnum() and c != "\n"}
        while bad := {b for a, b in pairs if b in marks and a not in marks and a != SPACE}:
            marks -= bad
        s = re.escape("".join(sorted(marks)))
        if not marks:
            return re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        return re.compile(rf"\n|{SPACE}*[{s}]*[^{SPACE}\n{s}]+|{SPACE}*[{s}]+|{SPACE}+")

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, LITERAL)
        text = SPACE + text.replace(" ", SPACE)
        return self.chunks.findall(text) if self.chunks else [text]

    def arcs(self, chunk: str) -> list[list[tuple[int, int, float]]]:
        """For every end position 1..n the arcs into it: (start, id or a negative code of an unknown character, weight)."""
        n, get, weight, longest = len(chunk), self.ids.get, self.weight, self.longest
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            if (one := get(chunk[i])) is None:
                code, w = self.spelled(chunk[i])
                into[i + 1].append((i, code, w / GROWTH))
            else:
                into[i + 1].append((i, one, weight[one]))
            for j in range(i + 2, min(n, i + longest) + 1):
                if (p := get(chunk[i:j])) is not None:
                    into[j].append((i, p, weight[p]))
        return into

    def spelled(self, char: str) -> tuple[int, float]:
        b = 3 if char == LITERAL else len(char.encode("utf-8", "surrogatepass"))
        return self.code(char), self.byte_weight**b * GROWTH

    def spelled_all(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``spelled``, for code points that are no piece."""
        points = np.where(points == ord(LITERAL), ord(SPACE), points)
        size = 1 + (points >= 0x80).astype(int) + (points >= 0x800) + (points >= 0x10000)
        of_byte = np.array([self.byte_id[b] for b in range(128)])
        return np.where(points < 128, of_byte[points % 128], -1 - points), self.byte_weight**size * GROWTH

    def code(self, char: str) -> int:
        """Of an unknown character: its byte token if it is one byte, else a code below 0."""
        n = ord(SPACE if char == LITERAL else char)
        return self.byte_id[n] if n < 128 else -1 - n

    def expand(self, ids: np.ndarray) -> np.ndarray:
        """Ids with codes of unknown characters replaced by their byte tokens."""
        if not len(ids) or ids.min() >= 0:
            return ids
        count = np.ones(len(ids), dtype=np.int64)
        at = np.flatnonzero(ids < 0)
        spelled = [[self.byte_id[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in ids[at].tolist()]
        count[at] = [len(x) for x in spelled]
        out = np.repeat(ids, count)
        first = np.concatenate([[0], np.cumsum(count)])[at]
        for k in range(4):
            has = [i for i, x in enumerate(spelled) if len(x) > k]
            out[first[has] + k] = [spelled[i][k] for i in has]
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, the space put in front taken off, byte tokens read as UTF-8."""
        b = b"".join(map(self.bytes_of.__getitem__, ids))
        return (b[1:] if b[:1] == b" " else b).decode("utf-8", "replace")


def _grown(a: np.ndarray, need: int) -> np.ndarray:
    if need <= len(a):
        return a
    out = np.empty(max(need, len(a) + len(a) // 2), dtype=a.dtype)
    out[: len(a)] = a
    return out


class Lattices:
    """Chunks' lattices, flat: a state is a position in a chunk, its arcs lie side by side, likeliest first."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.last: dict[str, int] = {}  # a chunk's final state
        self.n_states = self.n_arcs = 0
        self.first = np.zeros(1 << 12, dtype=np.int32)  # of a state: its first arc
        self.cum = np.zeros(1 << 12, dtype=np.float32)  # of an arc: its probability at its state and those before it
        self.prob = np.zeros(1 << 12)
        self.rest = np.zeros(1 << 12, dtype=np.float32)  # of an arc: what its siblings have together, 0 if it has none
        self.prev = np.zeros(1 << 12, dtype=np.int32)  # of an arc: the state it comes from; -1 at the chunk's start
        self.id = np.zeros(1 << 12, dtype=np.int32)

    def add(self, chunks: list[str]) -> None:
        """Append chunks' lattices: those of up to ``PLAIN`` characters all at once, longer ones one by one."""
        short = [c for c in chunks if len(c) <= PLAIN]
        if short:
            self._short(sorted(short, key=len, reverse=True))
        for chunk in chunks:
            if len(chunk) > PLAIN:
                mass, into, prev, ids = [], [], [], []
                self._long(chunk, self.n_states - 1, mass, into, prev, ids)
                self._put(np.array(mass), np.bincount(np.array(into) - self.n_states), np.array(prev), np.array(ids))
                self.last[chunk] = self.n_states - 1

    def _short(self, chunks: list[str]) -> None:
        """Lattices of chunks, the longest first: the states of all chunks' first positions, then of all second ones, and so on.

        A state's arcs come in from the farthest start to the nearest.
        """
        trie, size = self.pieces.trie, np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        longest = int(size[0])
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # chunks that have a j-th character
        off = np.concatenate([[0, 0], np.cumsum(alive)])  # of position j: its first state, from 1 on; position 0 has none
        n = int(off[-1])
        point = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
        owner = np.repeat(np.arange(len(chunks)), size)
        nth = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        state = off[nth + 1] + owner
        char = np.empty(n, dtype=np.int32)
        char[state] = point
        kind = trie.kind[char]
        # All pieces from all positions at once, a character further each time.
        where, who = nth.astype(np.int64), owner
        node = np.zeros(n, dtype=np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for d in range(1, trie.depth + 1):
            end = off[where + d] + who
            node, ok = trie.step(node, kind[end])
            piece = np.where(ok, trie.piece[node], -1)
            got = np.flatnonzero(piece >= 0)
            before = np.where(where[got] > 0, off[where[got]] + who[got], -1)
            found.append((end[got], before, piece[got]))
            if d == 1 and len(odd := np.flatnonzero(piece < 0)):
                # Characters that are no piece are spelled in bytes; their ids are told apart from pieces' below.
                found.append((end[odd], np.where(where[odd] > 0, off[where[odd]] + who[odd], -1), np.full(len(odd), -1)))
            ok &= where + d < size[who]
            at = np.flatnonzero(ok)
            if not len(at):
                break
            node, where, who = node[at], where[at], who[at]
        count = np.zeros(n, dtype=np.int64)
        for end, _, _ in found:
            count[end] += 1
        first = np.cumsum(count) - count
        put, arcs = first.copy(), int(count.sum())
        prev, ids, weight = np.empty(arcs, dtype=np.int64), np.empty(arcs, dtype=np.int64), np.empty(arcs)
        for end, before, piece in reversed(found):
            slot = put[end]
            put[end] += 1
            prev[slot] = before
            if len(piece) and piece[0] < 0:
                ids[slot], weight[slot] = self.pieces.spelled_all(char[end])
            else:
                ids[slot], weight[slot] = piece, self.pieces.scaled_array[piece]
        # Forward sums, position by position; entry 0 is the start of every chunk.
        forward = np.ones(n + 1)
        mass = np.empty(arcs)
        bound = np.append(first, arcs)
        for j in range(1, longest + 1):
            a, b = off[j], off[j + 1]
            lo, hi = bound[a], bound[b]
            mass[lo:hi] = forward[prev[lo:hi] + 1] * weight[lo:hi]
            forward[a + 1 : b + 1] = np.add.reduceat(mass[lo:hi], first[a:b] - lo)
        base = self.n_states
        self._put(mass, count, np.where(prev < 0, -1, prev + base), ids)
        self.last.update(zip(chunks, (base + off[size] + np.arange(len(chunks))).tolist()))

    def _put(self, x: np.ndarray, count: np.ndarray, prev: np.ndarray, ids: np.ndarray) -> None:
        """Append states by their numbers of arcs, and the arcs in the states' order with their masses."""
        first = np.cumsum(count) - count
        end = np.repeat(np.arange(len(count)), count)
        prob = x / np.add.reduceat(x, first)[end]
        cum = prob.copy()
        at = np.flatnonzero(count > 1)
        k = 1
        while len(at):
            cum[first[at] + k] += cum[first[at] + k - 1]
            k += 1
            at = at[count[at] > k]
        cum[first + count - 1] = 2.0
        # What siblings have together, summed up and not 1 - prob, which would lose the rarest.
        rest = 1.0 - prob
        near = np.flatnonzero(prob > 0.9)
        total = np.zeros(len(near))
        for k in range(int(count.max(initial=0))):
            at = first[end[near]] + k
            ok = (k < count[end[near]]) & (at != near)
            total[ok] += prob[at[ok]]
        rest[near] = total
        na = self.n_arcs
        for name, data, start in (("first", first + na, self.n_states), ("cum", cum, na), ("prob", prob, na), ("rest", rest, na), ("prev", prev, na), ("id", ids, na)):
            grown = _grown(getattr(self, name), start + len(data))
            grown[start : start + len(data)] = data
            setattr(self, name, grown)
        self.n_states, self.n_arcs = self.n_states + len(count), na + len(x)

    def _long(self, chunk: str, base: int, mass: list, into: list, prev: list, ids: list) -> None:
        """A chunk of any length: forward sums carry a power of two of their own."""
        forward, scale = [1.0], [0]
        for j, arcs in enumerate(self.pieces.arcs(chunk)):
            if not j:
                continue
            top = max(scale[i] for i, _, _ in arcs)
            each = [math.ldexp(forward[i] * w, max(scale[i] - top, -2000)) for i, _, w in arcs]
            total = math.fsum(each)
            m, e = math.frexp(total)
            forward.append(m)
            scale.append(top + e)
            mass += [x / total for x in each]
            into += [base + j] * len(arcs)
            prev += [base + i if i else -1 for i, _, _ in arcs]
            ids += [p for _, p, _ in arcs]

    def states(self, chunks: list[str]) -> np.ndarray:
        """Final states of chunks, adding those not known yet."""
        known = self.last
        out = np.fromiter(map(known.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            new = sorted({chunks[i] for i in missing})
            for at in range(0, len(new), SLICE):
                self.add(new[at : at + SLICE])
            out[missing] = [known[chunks[i]] for i in missing]
        return out

    def walk(self, state: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample backwards from every state to its chunk's start.

        Gives the arcs taken, each chunk's side by side in text order, and how
        many each took. States of -1 take none.
        """
        active = np.flatnonzero(state >= 0)
        s, z = state[active], seed[active]
        rounds = []
        count = np.zeros(len(state), dtype=np.int64)
        while len(active):
            z = z + np.uint64(0x9E3779B97F4A7C15)
            u = uniforms(z)
            arc = self.first[s].astype(np.int64)
            over = np.flatnonzero(u > self.cum[arc])
            while len(over):
                arc[over] += 1
                over = over[u[over] > self.cum[arc[over]]]
            rounds.append((active, arc))
            count[active] += 1
            s = self.prev[arc].astype(np.int64)
            more = s >= 0
            active, s, z = active[more], s[more], z[more]
        stop = np.cumsum(count)
        out = np.empty(stop[-1] if len(stop) else 0, dtype=np.int64)
        for r, (at, arc) in enumerate(rounds):
            out[stop[at] - 1 - r] = arc
        return out, count


def uniforms(z: np.ndarray) -> np.ndarray:
    """Uniform in [0, 1) from 64-bit counters (the splitmix64 finaliser)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def mix(*parts: int) -> int:
    z = 0
    for p in parts:
        z = (z + (p & M64) + 0x9E3779B97F4A7C15) & M64
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & M64
        z ^= z >> 31
    return z


def row_seed(seed: int, key) -> int:
    """A row's seed, from its key; a null key counts as one more key."""
    if key is None:
        return mix(seed, 1)
    if isinstance(key, (int, np.integer)):
        return mix(seed, 2, int(key))
    import xxhash

    return mix(seed, 3, xxhash.xxh64_intdigest(str(key).encode("utf-8", "surrogatepass")))


class Draws:
    """A text's own stream of uniforms and exponentials, for its agenda."""

    def __init__(self, seed: int):
        self.z = seed

    def uniform(self) -> float:
        self.z = (self.z + 1) & M64
        return (mix(self.z, 7) >> 11) * 2.0**-53

    def exponential(self) -> float:
        return -math.log1p(-self.uniform())


class Search:
    """The agenda of one text."""

    def __init__(self, lat: Lattices, seed: int):
        self.lat, self.draws = lat, Draws(seed)
        self.x = self.draws.exponential()  # of all segmentations together
        self.samples: list[tuple[np.ndarray, np.ndarray, float]] = []  # arcs from the text's end, log of the mass before each, x
        self.agenda: list[list] = []  # [x, sample, from, to, excluded arcs at the single place, masses]

    def push(self, sample: int, lo: int, hi: int, excluded: list[int] | None, bound: float) -> None:
        """Put back the segmentations that leave ``sample`` first at one of the places lo..hi."""
        arcs, before, _ = self.samples[sample]
        if excluded is None:
            mass = np.exp(before[lo:hi]) * self.lat.rest[arcs[lo:hi]].astype(np.float64)
        else:
            lat = self.lat
            b = np.array([i for i in self.siblings(int(arcs[lo])) if i not in excluded], dtype=np.int64)
            mass = np.exp(before[lo]) * lat.prob[b].sum(keepdims=True)
        total = float(mass.sum())
        if total > 0.0:
            self.agenda.append([bound + self.draws.exponential() / total, sample, lo, hi, excluded, mass])

    def siblings(self, arc: int) -> range:
        lat = self.lat
        s = int(np.searchsorted(lat.first[: lat.n_states], np.int32(arc), side="right")) - 1
        return range(int(lat.first[s]), int(lat.first[s + 1]) if s + 1 < lat.n_states else lat.n_arcs)

    def took(self, arcs: np.ndarray, x: float, fixed: int) -> None:
        """A sample is complete; those that share its first ``fixed`` places go on the agenda without it."""
        logs = np.log(self.lat.prob[arcs])
        before = np.concatenate([[0.0], np.cumsum(logs)])
        self.samples.append((arcs, before, x))
        self.push(len(self.samples) - 1, fixed, len(arcs), None, x)

    def pop(self) -> tuple[int, int, int, float] | None:
        """The best set's best member leaves an older sample at a place by an arc: (sample, place, arc, x)."""
        if not self.agenda:
            return None
        best = min(range(len(self.agenda)), key=lambda i: self.agenda[i][0])
        x, sample, lo, hi, excluded, mass = self.agenda.pop(best)
        arcs = self.samples[sample][0]
        if excluded is None:
            c = np.cumsum(mass)
            t = lo + int(np.searchsorted(c, self.draws.uniform() * c[-1], side="right"))
            t = min(t, lo + int(np.flatnonzero(mass)[-1]))
            out = [int(arcs[t])]
        else:
            t, out = lo, excluded
        choices = [i for i in self.siblings(int(arcs[t])) if i not in out]
        p = np.cumsum(self.lat.prob[choices])
        arc = choices[min(int(np.searchsorted(p, self.draws.uniform() * p[-1], side="right")), len(choices) - 1)]
        if excluded is None:
            self.push(sample, lo, t, None, x)
            self.push(sample, t + 1, hi, None, x)
        if len(choices) > 1:
            self.push(sample, t, t + 1, [*out, arc], x)
        return sample, t, arc, x

    def left(self) -> float:
        return min((e[0] for e in self.agenda), default=math.inf)


class Sampler:
    def __init__(self, pieces: Pieces, k: int, seed: int):
        if k < 1:
            raise ValueError("k must be at least 1")
        self.pieces, self.k, self.seed = pieces, k, seed
        self.lat = Lattices(pieces)

    def batch(self, keys: list, texts: list[str]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For every text its samples, best first: (ids, log probability, perturbed log probability, log inclusion probability)."""
        lat = self.lat
        if lat.n_arcs > ARCS_KEPT:
            lat.clear()
        split = [self.pieces.split(t) for t in texts]
        sizes = [len(c) for c in split]
        stop = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        state = lat.states([c for cs in split for c in cs])
        owner = np.repeat(np.arange(len(texts)), sizes)
        nth = np.arange(len(state)) - stop[owner]
        seeds = np.array([row_seed(self.seed, k) for k in keys], dtype=np.uint64)
        base = (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        searches = [Search(lat, row_seed(self.seed + 1, k)) for k in keys]
        shared: list = [None] * len(texts)  # what the coming sample keeps of an older one: (arcs from the end, x)
        going = [bool(n) for n in sizes]
        begin = state.copy()
        for j in range(self.k):
            with np.errstate(over="ignore"):
                z = seeds[owner] * np.uint64(0x2545F4914F6CDD1D) + base + np.uint64((j + 1) * 0xA0761D6478BD642F & M64)
            arcs, count = lat.walk(begin, z)
            ends = np.concatenate([[0], np.cumsum(count)])
            for d, s in enumerate(searches):
                if not going[d]:
                    continue
                new = arcs[ends[stop[d]] : ends[stop[d + 1]]][::-1]
                if shared[d] is None:
                    s.took(new, s.x, 0)
                else:
                    kept, x = shared[d]
                    s.took(np.concatenate([kept, new]), x, len(kept))
            if j + 1 == self.k:
                break
            begin = np.full(len(state), -1, dtype=np.int64)
            for d, s in enumerate(searches):
                if not going[d]:
                    continue
                if (found := s.pop()) is None:
                    going[d] = False
                    continue
                sample, t, arc, x = found
                old = s.samples[sample][0]
                # The chunk in which the new one leaves the old: as many as have begun from the end so far.
                inside = int((lat.prev[old[:t]] == -1).sum())
                at = stop[d + 1] - 1 - inside
                begin[stop[d] : at] = state[stop[d] : at]
                begin[at] = lat.prev[arc]
                shared[d] = (np.append(old[:t], arc), x)
        out = []
        for s, n in zip(searches, sizes):
            left = s.left()
            rows = []
            for arcs, before, x in s.samples:
                ids = self.pieces.expand(lat.id[arcs[::-1]])
                lp = float(before[-1])
                rows.append((ids, lp, -math.log(x) if x > 0 else math.inf, log_inclusion(lp, left)))
            if not n:
                rows = [(np.empty(0, dtype=np.int64), 0.0, -math.log(s.x) if s.x > 0 else math.inf, 0.0)]
            out.append(rows)
        return out


def log_inclusion(lp: float, x: float) -> float:
    """log(1 - exp(-exp(lp) * x))."""
    if x == math.inf:
        return 0.0
    t = lp + math.log(x) if x > 0 else -math.inf
    return t if t < -30 else min(0.0, math.log(-math.expm1(-math.exp(min(t, 700.0)))))


def sampler(path: str, k: int, seed: int, theta: float, shift: float) -> Sampler:
    return kept(("sampler", path, k, seed, theta, shift), lambda: Sampler(Pieces(path, theta, shift), k, seed))


def encode_samples(
    df: DataFrame,
    k: int = 2,
    seed: int = 11,
    theta: float = 1.0,
    shift: float = 10.0,
    model: str = "piece_bpe_32k.model",
    folder: str = TOKENIZERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars: int = 400_000,
) -> DataFrame:
    """(doc_id, rank, ids, logprob, perturbed, log_inclusion, exact): up to ``k`` distinct segmentations of every row.

    ``exact`` says that decoding the ids gives the text back, character for
    character. A null text gives one row of rank 0 whose other columns are null;
    an empty one a row without ids; a text with fewer than ``k`` segmentations
    as many rows as it has, each with the inclusion score 0. Samples depend on
    seed, id and text alone, so rows that repeat repeat their samples, and null
    ids share a seed. Texts are segmented whole; ``chars`` only bounds how many
    are worked on at once. Other columns aren't read.
    """
    took = Intake(df, id_col, text_col)
    rows = took.narrow(doc_id=id_col, text=text_col)
    path = str(Path(vocabulary(model, folder)))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path, k, seed, theta, shift)
        decode = s.pieces.decode
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n + len(texts[j] or "") <= chars):
                    n += len(texts[j] or "")
                    j += 1
                some = [x for x in range(i, j) if texts[x] is not None]
                got = dict(zip(some, s.batch([keys[x] for x in some], [texts[x] for x in some])))
                at, rank, ids, lp, pert, inc, same = [], [], [], [], [], [], []
                for x in range(i, j):
                    if texts[x] is None:
                        got[x] = [(None, None, None, None)]
                    for r, (a, b, c, d) in enumerate(got[x]):
                        at.append(x)
                        rank.append(r)
                        ids.append(a)
                        lp.append(b)
                        pert.append(c)
                        inc.append(d)
                        same.append(None if a is None else decode(a.tolist()) == texts[x])
                i = j
                if not at:
                    continue
                lengths = np.array([0 if a is None else len(a) for a in ids], dtype=np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                flat = np.concatenate([a for a in ids if a is not None] or [np.empty(0)]).astype(np.int32)
                none = pa.array([a is None for a in ids])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        pa.array(rank, pa.int32()),
                        pa.ListArray.from_arrays(offsets, pa.array(flat), mask=none),
                        pa.array(lp, pa.float64()),
                        pa.array(pert, pa.float64()),
                        pa.array(inc, pa.float64()),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", "rank", "ids", "logprob", "perturbed", "log_inclusion", "exact"],
                )

    return rows.mapInArrow(encode, f"doc_id {kind}, rank int, ids array<int>, logprob double, perturbed double, log_inclusion double, exact boolean")


def decode_ids(df: DataFrame, model: str = "piece_bpe_32k.model", folder: str = TOKENIZERS, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``df`` with the text of its ids in a column put last; null ids give null, ids out of range are an error."""
    from pyspark.sql import functions as F

    took = Intake(df, ids_col)
    path = str(Path(vocabulary(model, folder)))

    @F.pandas_udf("string")
    def text(ids):
        decode = sampler(path, 1, 0, 1.0, 10.0).pieces.decode
        return ids.map(lambda x: None if x is None else decode(x))

    rows = took.rows.withColumn("out", text(took[ids_col]))
    return rows.toDF(*took.names, out_col)
