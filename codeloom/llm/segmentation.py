"""SentencePiece encoding, decoding and sampling without replacement (operator 1)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import U64, keep, mix64, rows_of, tidy

#: Words whose lattices a worker holds; lattice positions it holds.
HELD_WORDS, HELD_STATES = 600_000, 6_000_000
#: Log probabilities are stored and summed as whole numbers of this; differences of sums that run over stay exact.
UNIT = 2.0**-36
SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Grown:
    """An array that appends in amortised constant time; ``of`` is its filled part."""

    def __init__(self, kind):
        self.room, self.of = np.empty(1024, kind), np.empty(0, kind)

    def append(self, *parts: np.ndarray) -> None:
        n = len(self.of)
        for p in parts:
            if n + len(p) > len(self.room):
                room = np.empty(2 * (n + len(p)), self.room.dtype)
                room[:n] = self.room[:n]
                self.room = room
            self.room[n : n + len(p)] = p
            n += len(p)
        self.of = self.room[:n]


class Lattice:
    """Lattices of words over a SentencePiece vocabulary, flattened into arrays.

    A state is a place in a word, an arc a piece that starts there; the arcs
    of a state lie together. Arcs hold the probability of their piece given
    the state, by backward sums over all segmentations of the rest of the
    word. A piece weighs (rank + 2) ** -sharpness: the merge rank stands for
    its frequency, since BPE models store ranks, not probabilities.
    Characters outside the vocabulary are one arc of byte pieces.
    """

    def __init__(self, model: str | None = None, sharpness: float = 1.0):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model or default_model())
        n = self.sp.get_piece_size()
        self.byte = np.full(256, self.sp.unk_id(), np.int64)
        pieces, crossing, lines = {}, False, False
        for i in range(n):
            if self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i):
                continue
            p = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                continue
            pieces[p] = (i, -sharpness * math.log(min(-self.sp.get_score(i), n) + 2))
            crossing |= SPACE in p.lstrip(SPACE)
            lines |= "\n" in p
        self.unknown = -sharpness * math.log(n + 2)
        self._trie(pieces)
        # no piece spans a place where words are parted, so lattices of the parts are independent
        marks = [c for c in ",.;:!?" if not any(p[-1] == c and p[-2:-1].isascii() and p[-2:-1].isalpha() for p in pieces)]
        self.whole, self.lines = crossing, lines
        kinds = np.zeros(128, np.uint8)
        kinds[[c for c in range(128) if chr(c).isalpha()]] = 1
        kinds[[ord(c) for c in marks]] = 2
        kinds[10] = 3
        self.kinds = kinds
        self.clear()

    def _trie(self, pieces: dict) -> None:
        """Nodes by (node, character): sorted keys for whole arrays of places at once."""
        chars = {c: k + 1 for k, c in enumerate(sorted(set("".join(pieces))))}
        self.char = np.zeros(0x110000, np.int64)
        for c, k in chars.items():
            self.char[ord(c)] = k
        self.width = len(chars) + 1
        nodes: dict[int, int] = {}
        end: list[tuple[int, float]] = [(-1, 0.0)]
        for p, got in pieces.items():
            node = 0
            for c in p:
                key = node * self.width + chars[c]
                if key not in nodes:
                    nodes[key] = len(end)
                    end.append((-1, 0.0))
                node = nodes[key]
            end[node] = got
        keys, to = np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes))
        # open addressing: a slot holds a key and its node; steps go on while a slot holds another key
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.slot_key, self.slot_to = U64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.slot_key[slot[left]] < 0
            want = left[free]
            self.slot_key[slot[want]], self.slot_to[slot[want]] = keys[want], to[want]  # one of those that want a slot gets it
            left = left[self.slot_key[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.slot_key) - 1)
        self.end_id, self.end_w = np.array([e[0] for e in end], np.int64), np.array([e[1] for e in end])
        self.root = np.full(self.width, -1, np.int64)
        low = keys < self.width
        self.root[keys[low]] = to[low]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _child(self, keys: np.ndarray) -> np.ndarray:
        """The node of each (node, character) key; -1 without one."""
        slot, last = self._slot(keys), len(self.slot_key) - 1
        held = self.slot_key[slot]
        out = np.where(held == keys, self.slot_to[slot], -1)
        miss = np.flatnonzero((held != keys) & (held >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & last
            held = self.slot_key[slot[miss]]
            out[miss] = np.where(held == keys[miss], self.slot_to[slot[miss]], -1)
            miss = miss[(held != keys[miss]) & (held >= 0)]
        return out

    def clear(self) -> None:
        self.start: dict[int, int] = {}
        self._first, self._next, self._ids = Grown(np.int32), Grown(np.int32), Grown(np.int32)
        self._cum, self._units, self._rest = Grown(np.float32), Grown(np.int64), Grown(np.float32)
        self._first.append(np.zeros(1, np.int32))
        self.raw, self.raw_at = np.empty(0, np.int64), np.zeros(1, np.int64)
        self._settle()

    def _settle(self) -> None:
        self.first, self.next, self.ids = self._first.of, self._next.of, self._ids.of
        self.cum, self.units, self.rest = self._cum.of, self._units.of, self._rest.of

    def _add(self, cps: np.ndarray, sizes: np.ndarray, names: list[int]) -> None:
        """Append the lattices of new words: their code points, lengths and hashes."""
        ends = np.repeat(np.cumsum(sizes), sizes)
        char = self.char[cps]
        where = np.arange(len(cps))
        place, node, found = where, self.root[char], []
        depth = 1
        ok = node >= 0
        place, node = place[ok], node[ok]
        while len(place):
            hit = self.end_id[node] >= 0
            found.append((place[hit], np.full(int(hit.sum()), depth), self.end_id[node[hit]], self.end_w[node[hit]]))
            go = place + depth < ends[place]
            place, node = place[go], node[go]
            node = self._child(node * self.width + char[place + depth])
            ok = node >= 0
            place, node, depth = place[ok], node[ok], depth + 1
        single = np.zeros(len(cps), bool)
        if found:
            single[found[0][0]] = True
        odd = np.flatnonzero(~single)
        if len(odd):  # bytes of characters that are no piece
            raws = [chr(c).encode("utf-8", "surrogatepass") for c in cps[odd].tolist()]
            n = np.array([len(r) for r in raws])
            found.append((odd, np.ones(len(odd), np.int64), -1 - (len(self.raw_at) - 1 + np.arange(len(odd))), self.unknown * n))
            self.raw = np.r_[self.raw, self.byte[np.frombuffer(b"".join(raws), np.uint8)]]
            self.raw_at = np.r_[self.raw_at, self.raw_at[-1] + np.cumsum(n)]
        # by state, longer pieces (the likelier) first; a state has one piece of each length
        size = np.bincount(np.concatenate([f[0] for f in found]), minlength=len(cps))
        heads = np.cumsum(size) - size
        free = heads.copy()
        state, length, ids, w = np.repeat(where, size), *(np.empty(int(size.sum()), kind) for kind in (np.int64, np.int64, np.float64))
        for places, lengths, piece, weight in sorted(found, key=lambda f: -int(f[1][0]) if len(f[1]) else 0):
            at = free[places]
            length[at], ids[at], w[at] = lengths, piece, weight
            free[places] += 1
        after = state + length
        inner = after < ends[state]
        after[~inner] = len(cps)
        # backward sums, for all places as far from their word's end at once
        beta = np.zeros(len(cps) + 1)
        left = ends - where
        turn = np.argsort(left.astype(np.int16) if left.max() < 1 << 15 else left, kind="stable")
        n = size[turn]
        first = np.cumsum(n) - n
        s = np.repeat(heads[turn] - first, n) + np.arange(len(state))
        v, to = w[s], after[s]
        cuts = np.r_[np.flatnonzero(np.r_[True, left[turn][1:] != left[turn][:-1]]), len(turn)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            a, b = int(first[lo]), int(first[hi]) if hi < len(first) else len(s)
            x = v[a:b] + beta[to[a:b]]
            at = first[lo:hi] - a
            top = np.maximum.reduceat(x, at)
            beta[turn[lo:hi]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, n[lo:hi])), at))
        logp = w + beta[after] - beta[state]
        p = np.exp(logp)
        top = p == np.repeat(np.maximum.reduceat(p, heads), size)
        others = np.add.reduceat(np.where(top, 0, p), heads)  # without the likeliest: exact where it is near 1
        rest = np.repeat(others + np.add.reduceat(np.where(top, p, 0), heads), size) - p
        alone = top & (np.repeat(np.add.reduceat(top.astype(np.int64), heads), size) == 1)
        rest[alone] = np.repeat(others, size)[alone]
        cum = p.copy()
        for j in range(1, int(size.max())):
            at = heads[size > j] + j
            cum[at] += cum[at - 1]
        cum[heads + size - 1] = 2.0
        shift, arcs = len(self.first) - 1, len(self.ids)
        self._first.append(arcs + np.r_[heads[1:], len(state)])
        self._next.append(np.where(inner, shift + state + length, -1))
        self._ids.append(ids)
        self._units.append(np.round(logp / UNIT).astype(np.int64))
        with np.errstate(divide="ignore"):
            self._rest.append(np.log(np.maximum(rest, 0)))
        self._cum.append(cum)
        self._settle()
        self.start.update(zip(names, (shift + np.cumsum(sizes) - sizes).tolist(), strict=True))

    def _parted(self, cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where words begin in the code points of texts: at a space after something else, around a line break, and at a mark that ends a word of letters."""
        first = np.zeros(len(cps) + 1, bool)
        first[ends], first[0] = True, True
        if not self.whole:
            space = cps == ord(SPACE)
            low = cps < 128
            kind = self.kinds[np.where(low, cps, 0)]
            first[:-1] |= space & ~np.r_[False, space[:-1]]
            if not self.lines:
                broken = np.flatnonzero(kind == 3)
                first[broken] = True
                first[broken + 1] = True
            begin = np.flatnonzero(first)
            last = begin[1:] - 1
            over = np.r_[space, True][begin[1:]] | np.isin(begin[1:], ends)  # a space or the text's end follows
            plain = np.r_[0, np.cumsum((kind == 1) | space, dtype=np.int64)]
            words = (kind[last] == 2) & over & (plain[last] - plain[begin[:-1]] == last - begin[:-1])
            words &= (last > begin[:-1]) & ~space[np.maximum(last - 1, 0)]
            first[last[words]] = True
        return np.flatnonzero(first)

    def states(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First states of the words of all texts, and where those of each begin, with their end; valid until the next call.

        Words are known by a 64-bit hash of their code points and places.
        """
        if len(self.start) > HELD_WORDS or len(self.first) > HELD_STATES:
            self.clear()
        normal = list(map(self.sp.normalize, texts))
        ends = np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)))
        cps = np.frombuffer("".join(normal).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(cps):
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        begin = self._parted(cps, ends)
        sizes = np.diff(begin)
        inside = (np.arange(len(cps)) - np.repeat(begin[:-1], sizes)).astype(U64)
        inside *= U64(0xC2B2AE3D27D4EB4F)
        inside += cps
        names, at, which = np.unique(np.add.reduceat(mix64(inside * U64(0x9E3779B97F4A7C15)), begin[:-1]), return_index=True, return_inverse=True)
        names, start = names.tolist(), self.start
        new = [k for k, name in enumerate(names) if name not in start]
        if new:
            own = sizes[at[new]]
            self._add(cps[ragged(begin[at[new]], own)], own, [names[k] for k in new])
        return np.fromiter(map(start.__getitem__, names), np.int64, len(names))[which], np.r_[0, np.searchsorted(begin, ends)]

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """First states of the words of each text; valid until the next call."""
        flat, at = self.states(texts)
        return np.split(flat, at[1:-1])

    @property
    def logp(self) -> np.ndarray:
        return self.units * UNIT

    def walk(self, states: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray]:
        """Free sampling to the end of every given word at once: arcs in text order, and the word of each.

        ``draw(words, step)`` gives a uniform number for each of these words.
        """
        order, arcs, place, n = np.arange(len(states)), [], [], np.zeros(len(states), np.int64)
        while len(states):
            a, u = self.first[states], draw(order, len(arcs))
            over = np.flatnonzero(u >= self.cum[a])
            while len(over):
                a[over] += 1
                over = over[u[over] >= self.cum[a[over]]]
            arcs.append(a), place.append(order)
            n[order] += 1
            to = self.next[a]
            go = np.flatnonzero(to >= 0)
            states, order = to[go], order[go]
        first = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        for step, (a, w) in enumerate(zip(arcs, place, strict=True)):
            out[first[w] + step] = a
        return out, np.repeat(np.arange(len(n)), n)

    def piece_ids(self, arcs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of arcs; where the ids of the arcs from each of ``starts`` begin, with their end; and the ids before each arc."""
        ids = self.ids[arcs].astype(np.int64)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, np.r_[starts, len(arcs)], np.arange(len(arcs) + 1)
        run = -ids[odd] - 1
        m = self.raw_at[run + 1] - self.raw_at[run]
        n = np.ones(len(ids), np.int64)
        n[odd] = m
        after = np.r_[0, np.cumsum(n)]
        out = np.repeat(ids, n)
        out[ragged(after[odd], m)] = self.raw[ragged(self.raw_at[run], m)]
        return out, after[np.r_[starts, len(arcs)]], after

    def rivals(self, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 of the arcs of the states that ``arcs`` start at."""
        state = self.first.searchsorted(arcs.astype(np.int32), side="right")
        return self.first[state - 1], self.first[state]


def _uniform(keys: np.ndarray, number: int, kind: int, index: np.ndarray | int, step: int = 0) -> np.ndarray:
    """Uniform numbers in (0, 1): splitmix64 streams of a text's key, by what they are for."""
    x = np.atleast_1d(np.asarray(index)).astype(np.uint64)
    x *= U64(0x9E3779B97F4A7C15)
    x = x + (keys + U64((number * 0xC2B2AE3D27D4EB4F + kind * 0x165667B19E3779F9 + step * 0xD6E8FEB86659FD93) % (1 << 64)))
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(odd)
    x ^= x >> U64(31)
    x >>= U64(11)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


@dataclass
class _Round:
    """The leaves found in one turn: whose they are, their arcs, and the groups of siblings along them that are not followed yet.

    The bound of a group is -log(exp(-score) + waits); it falls as ``waits`` grows.
    """

    live: np.ndarray
    start: np.ndarray
    path: np.ndarray
    before: np.ndarray
    waits: np.ndarray
    least: np.ndarray
    score: np.ndarray
    barred: list[frozenset[int] | None]
    ids_at: np.ndarray
    n_kept: list[int]
    n_ended: list[int]
    leaf: list[int]


def sample_batch(lattice: Lattice, texts: list[str], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations: (ids, log probability, perturbed score, inclusion probability).

    A-star over each text's tree of piece prefixes. A node's priority is the
    greatest Gumbel-perturbed log probability below it, drawn from the top
    down: the node that is followed keeps its parent's, the group of its
    siblings draws one truncated at it. Leaves thus come out as by Gumbel
    top-k, in falling perturbed score, without expanding anything else. The
    bound left on the queue after ``k`` leaves is the threshold of the
    inclusion probabilities. The texts of a batch advance together, leaf by
    leaf; random numbers depend on a text's key alone, and log probabilities
    are summed as whole numbers of ``UNIT``, so sums do not depend on the
    batch either.
    """
    flat, word_at = lattice.states(texts)
    n_words = np.diff(word_at)
    out: list[list] = [[] for _ in texts]
    key = np.array(keys, np.uint64)
    gumbel = -np.log(-np.log(_uniform(key, 0, 2, 0))) if len(key) else np.empty(0)
    for d in np.flatnonzero(n_words == 0).tolist():
        out[d] = [(np.empty(0, np.int64), 0.0, float(gumbel[d]), 1.0)]
    live = np.flatnonzero(n_words)
    base = np.zeros(len(texts), np.int64)  # log probability of the fixed pieces before the node
    head = np.full(len(live), -1)  # the arc at the node, fixed; -1 at the root
    ended = [0] * len(live)  # words that end before the node
    barred: list[frozenset[int] | None] = [None] * len(live)  # arcs of the node that were taken before, by leaves and groups
    kept = [np.empty(0, np.int64)] * len(live)  # ids before the node
    threshold = np.full(len(texts), -np.inf)
    rounds: list[_Round] = []
    for number in range(k):
        if not len(live):
            break
        fixed = head >= 0
        to = np.where(fixed, lattice.next[np.maximum(head, 0)], -1).astype(np.int64)
        inside = to >= 0  # the node's word goes on
        first = word_at[live] + np.array(ended, np.int64) + fixed
        rest = word_at[live + 1] - first
        sizes = rest + inside
        owner = np.repeat(np.arange(len(live)), sizes)
        begin = np.cumsum(sizes) - sizes
        states = np.empty(len(owner), np.int64)
        goes_on = np.zeros(len(owner), bool)
        goes_on[begin[inside]] = True
        states[begin[inside]] = to[inside]
        states[~goes_on] = flat[ragged(first, rest)]
        place = np.arange(len(owner)) - np.repeat(begin, sizes)
        own_key = key[live]
        arcs, word = lattice.walk(states, lambda w, step: _uniform(own_key[owner[w]], number, 1, place[w], step))  # noqa: B023
        lengths = np.bincount(owner[word], minlength=len(live)) + fixed
        start = np.cumsum(lengths) - lengths
        path = np.empty(int(lengths.sum()), np.int64)
        heads = np.zeros(len(path), bool)
        heads[start[fixed]] = True
        path[start[fixed]] = head[fixed]
        path[~heads] = arcs
        text = np.repeat(np.arange(len(live)), lengths)
        own = lattice.units[path]
        run = np.cumsum(own)
        shift = base[live] - (run - own)[start]
        before = run - own
        before += shift[text]
        total = run[start + lengths - 1] + shift
        # what the siblings of each arc wait for: an exponential variable over their mass
        mass = before * UNIT
        mass += lattice.rest[path]
        again = [j for j, b in enumerate(barred) if b is not None]
        if again:
            lo, hi = lattice.rivals(path[start[again]])
            for j, a, b in zip(again, lo.tolist(), hi.tolist(), strict=True):
                at = int(start[j])
                barred[j] = barred[j] | {int(path[at])}
                left = math.fsum(math.exp(int(lattice.units[x]) * UNIT) for x in range(a, b) if x not in barred[j])
                mass[at] = int(before[at]) * UNIT + (math.log(left) if left > 0 else -math.inf)
        waits = np.full(len(path), np.inf)
        some = np.flatnonzero(mass > -700)  # others are never reached before the first
        owners = text[some]
        waits[some] = -np.log1p(-_uniform(own_key[owners], number, 3, some - start[owners])) * np.exp(-mass[some])
        ids, cut, ids_at = lattice.piece_ids(path, start)
        score = gumbel[live]
        leaf = []
        for j, (d, lp, g) in enumerate(zip(live.tolist(), total.tolist(), score.tolist(), strict=True)):
            leaf.append(len(out[d]))
            out[d].append((np.concatenate([kept[j], ids[cut[j] : cut[j + 1]]]), lp * UNIT, g))
        rounds.append(_Round(live, start, path, before, waits, np.minimum.reduceat(waits, start), score, barred, ids_at, [len(x) for x in kept], ended, leaf))
        # the next node of each text: the greatest bound on its queue
        best, whose = np.full(len(texts), -np.inf), np.full(len(texts), -1)
        with np.errstate(divide="ignore", over="ignore"):
            for turn, r in enumerate(rounds):
                bound = -np.log(np.exp(-r.score) + r.least)
                better = bound > best[r.live]
                best[r.live[better]], whose[r.live[better]] = bound[better], turn
        if number == k - 1:
            threshold = best
            break
        picks = []
        for turn, r in enumerate(rounds):
            ends = np.r_[r.start[1:], len(r.path)]
            for j in np.flatnonzero(whose[r.live] == turn).tolist():
                lo, hi = int(r.start[j]), int(ends[j])
                at = lo + int(r.waits[lo:hi].argmin())
                r.waits[at] = np.inf
                r.least[j] = r.waits[lo:hi].min()
                picks.append((r, j, int(r.live[j]), lo, at))
        live = np.array([p[2] for p in picks], np.int64)
        if not picks:
            break
        lows, highs = lattice.rivals(np.array([p[0].path[p[4]] for p in picks]))
        draws = _uniform(key[live], number, 4, 0).tolist()
        heads_, ended, barred, kept = [], [], [], []
        for (r, j, d, lo, at), a, b, u in zip(picks, lows.tolist(), highs.tolist(), draws, strict=True):
            arc = int(r.path[at])
            bar = r.barred[j] if at == lo and r.barred[j] else frozenset([arc])
            choices = [x for x in range(a, b) if x not in bar]
            p = np.cumsum([math.exp(int(lattice.units[x]) * UNIT) for x in choices])
            heads_.append(choices[min(int(p.searchsorted(u * p[-1], side="right")), len(choices) - 1)])
            gumbel[d], base[d] = best[d], r.before[at]
            barred.append(bar)
            ended.append(r.n_ended[j] + int(np.count_nonzero(lattice.next[r.path[lo:at]] < 0)))
            kept.append(out[d][r.leaf[j]][0][: r.n_kept[j] + int(r.ids_at[at] - r.ids_at[lo])])
        head = np.array(heads_, np.int64)
    for d, got in enumerate(out):
        if got and n_words[d]:
            limit = threshold[d] if len(got) == k else -np.inf
            out[d] = [(p, lp, g, -math.expm1(-math.exp(min(lp - limit, 700))) if np.isfinite(limit) else 1.0) for p, lp, g in got]
    return out


def _key(key, text: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest((repr(key) if key is not None else "null:" + text).encode("utf-8", "surrogatepass"), seed)


def _sampler(model, sharpness: float, k: int, seed: int, digest: bool):
    names = ["doc_id", "sample", "n_ids", "ids_crc32", "decoded", "log_prob", "perturbed", "inclusion"]

    def batch(out, texts, sp):
        cols = list(zip(*out, strict=True))
        own = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())]
        if digest:
            own += [pa.array([len(x) for x in cols[2]], pa.int64()), pa.array([crc32(x.astype("<u4").tobytes()) for x in cols[2]], pa.int64())]
            own.append(pa.array([sp.decode(x.tolist()) == t.replace(SPACE, " ") if t is not None else None for x, t in zip(cols[2], texts, strict=True)], pa.bool_()))
        else:
            own.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cols[2])]), pa.int32()), pa.array(np.concatenate(cols[2]), pa.int32())))
        own += [pa.array(c, pa.float64()) for c in cols[3:]]
        return pa.record_batch(own, names=names if digest else [*names[:2], "ids", *names[5:]])

    def run(batches):
        lattice = keep(("lattice", model, sharpness), lambda: Lattice(model, sharpness))  # so later tasks need not learn its words again
        for ids, texts in rows_of(batches, "doc_id", "text"):
            at = 0
            while at < len(ids):
                to, size = at, 0
                while to < len(ids) and size < 1 << 20:
                    size += len(texts[to])
                    to += 1
                out, whose = [], []
                keys = [_key(i, t, seed) for i, t in zip(ids[at:to], texts[at:to], strict=True)]
                for i, t, found in zip(ids[at:to], texts[at:to], sample_batch(lattice, texts[at:to], keys, k), strict=True):
                    out += [(i, j, *got) for j, got in enumerate(found)]
                    whose += [t, *[None] * (len(found) - 1)]
                yield batch(out, whose, lattice.sp)
                at = to

    return run


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def sample_segmentations(docs: DataFrame, k: int = 4, sharpness: float = 1.0, model: str | None = None, seed: int = 1, digest: bool = False) -> DataFrame:
    """doc_id, sample (from 0), ids, log_prob, perturbed, inclusion: up to ``k`` distinct segmentations a row.

    Rows are sampled on their own, by a random stream keyed by doc_id (by the
    text where doc_id is null), so results do not depend on partitions. Whole
    texts are sampled; a text with fewer segmentations than ``k`` gives all
    of them with inclusion 1; null and empty texts give one empty
    segmentation; repeated rows give repeated results; other columns are
    ignored; no rows give no rows. ``digest`` gives n_ids, ids_crc32 (of
    little-endian 32-bit ids) and decoded (whether the first sample's ids
    decode to the text; null for the others) in place of ids.
    """
    ids = "n_ids long, ids_crc32 long, decoded boolean" if digest else "ids array<int>"
    return _base(docs).mapInArrow(tidy(_sampler(model, sharpness, k, seed, digest), ("lattice", model, sharpness)), f"doc_id long, sample int, {ids}, log_prob double, perturbed double, inclusion double")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids: the model's own best segmentation of every text.

    Null and empty texts have no ids; very long texts are encoded whole;
    repeated rows give repeated results; no rows give no rows; other columns
    are ignored.
    """

    def run(batches):
        sp = Lattice(model).sp
        for ids, texts in rows_of(batches, "doc_id", "text"):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([sp.encode(t) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _base(docs).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``rows`` (doc_id, ids, ...) to doc_id, text: any segmentation of a text gives the text back.

    The visible space mark U+2581 inside a text comes back as a space. Null
    and empty ids are the empty text; repeated rows give repeated results; no
    rows give no rows; other columns are ignored.
    """

    def run(batches):
        sp = Lattice(model).sp
        for ids, pieces in rows_of(batches, "doc_id", "ids"):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([sp.decode(p or []) for p in pieces], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(tidy(run), "doc_id long, text string")
