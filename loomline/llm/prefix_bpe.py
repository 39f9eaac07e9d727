"""Byte-pair encoding of many pieces at once, by dynamic programming over prefixes.

The encoding of a piece ends, for each of its prefixes, in one certain token. An automaton over
all tokens gives the longest one that is a suffix of a prefix, and each token its next shorter
suffix; the first of them that may stand after the last token of the remaining, shorter prefix is
the right one. Whether two tokens may stand side by side is decided by replaying both merge
histories at their common edge. Following the stored tokens back from the end gives the ids.

The programme advances all pieces together, one byte a step, in numpy arrays; the few pieces
longer than `LONG` bytes go through the same tables one at a time. Both are linear in the bytes.
The automaton has one entry of a hash table for each of its edges and a link from each state to its longest
suffix. Outcomes of pair tests are kept in a table of fixed size, in which later pairs displace earlier ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FOREVER = np.int32(2**31 - 1)
LONG, REMEMBERED = 64, 20
MULTIPLIER, PAIR = 0x9E3779B1, 24  # ids are below 2**PAIR


class PrefixTables:
    """Tokens by id as byte strings (None: an id that merges never make), and merges in order as (left, right, made) ids."""

    def __init__(self, tokens: list[bytes | None], merges: list[tuple[int, int, int]]):
        ranked = np.array(merges, np.int64).reshape(-1, 3)
        pairs, first = np.unique(ranked[:, 0] << 32 | ranked[:, 1], return_index=True)
        self.pairs, self.pair_rank = pairs, first.astype(np.int32)
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b, whole) in enumerate(merges):
            made.setdefault(whole, (rank, a, b))
        self.right = self.histories(len(tokens), made, 2)
        self.left = self.histories(len(tokens), made, 1)
        built = np.array([(t, *made[t]) for t in sorted(made)], np.int64).reshape(-1, 4)
        stable = np.ones(len(tokens), bool)
        stable[built[:, 0]] = self.apart(built[:, 2], built[:, 3], built[:, 1])
        self.size = np.array([len(t) if t else 0 for t in tokens], np.int32)
        self.build([t if t and stable[k] else None for k, t in enumerate(tokens)])
        self.seen = np.full(1 << REMEMBERED, -1, np.int64)
        self.lone = None

    @staticmethod
    def histories(count: int, made: dict[int, tuple[int, int, int]], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sub-tokens at one edge of each token, from the innermost on, each with the rank of the merge that swallows it; where each token's begin."""
        known: dict[int, tuple] = {}

        def history(token: int) -> tuple:
            found = known.get(token)
            if found is None:
                if token in made:
                    inner = history(made[token][side])
                    found = (*inner[:-1], (inner[-1][0], made[token][0]), (token, FOREVER))
                else:
                    found = ((token, FOREVER),)
                known[token] = found
            return found

        chains = [history(t) for t in range(count)]
        at = np.concatenate(([0], np.cumsum([len(c) for c in chains])))[:-1]
        flat = np.array([step for c in chains for step in c], np.int64).reshape(-1, 2)
        return at, flat[:, 0], flat[:, 1]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; FOREVER where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], FOREVER) if len(self.pairs) else np.full(len(key), FOREVER)

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge joins a and b before the merge of rank `until`, when both are built from bytes."""
        (right_at, right, right_ends), (left_at, left, left_ends) = self.right, self.left
        i, j, row = right_at[a], left_at[b], np.arange(len(a))
        out = np.ones(len(a), bool)
        until = np.full(len(a), FOREVER, np.int64) if until is None else until
        while len(row):
            x_ends, y_ends = right_ends[i], left_ends[j]
            joined = self.rank(right[i], left[j])
            clash = (joined < until[row]) & (joined < x_ends) & (joined <= y_ends)
            out[row[clash]] = False
            go_on = ~clash & ~((x_ends == FOREVER) & (y_ends == FOREVER))
            outer = x_ends <= y_ends
            i, j, row = (i + outer)[go_on], (j + ~outer)[go_on], row[go_on]
        return out

    def build(self, tokens: list[bytes | None]) -> None:
        """The automaton: edges between states, each state's longest suffix that is a state, its longest token, and each token's next shorter suffix."""
        child: dict[int, int] = {}
        levels: list[list[tuple[int, int, int]]] = []
        own = {}
        for k, token in enumerate(tokens):
            state = 0
            for depth, byte in enumerate(token or b""):
                edge = state << 8 | byte
                following = child.get(edge)
                if following is None:
                    child[edge] = following = len(child) + 1
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((following, state, byte))
                state = following
            if token:
                own[state] = k
        count = len(child) + 1
        self.store(np.array(list(child), np.int64), np.array(list(child.values()), np.int32))
        self.back = np.zeros(count, np.int32)
        self.longest = np.full(count, -1, np.int32)
        self.shorter = np.full(len(tokens), -1, np.int32)
        token_at = np.full(count, -1, np.int32)
        token_at[list(own)] = list(own.values())
        for depth, level in enumerate(levels):
            state, parent, byte = np.array(level).T
            if depth:
                self.back[state] = self.follow(self.back[parent], byte)
            suffix, named = self.longest[self.back[state]], token_at[state] >= 0
            self.longest[state] = np.where(named, token_at[state], suffix)
            self.shorter[token_at[state][named]] = suffix[named]

    def store(self, edge: np.ndarray, target: np.ndarray) -> None:
        """Puts edges and the states they lead to in a hash table of open addresses."""
        self.slots = 1 << (4 * len(edge)).bit_length()
        self.edge, self.target = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32)
        place, row = self.place(edge), np.arange(len(edge))
        while len(row):
            free = self.edge[place[row]] < 0
            self.edge[place[row[free]]] = edge[row[free]]
            held = self.edge[place[row]] == edge[row]
            self.target[place[row[held]]] = target[row[held]]
            row = row[~held]
            place[row] = (place[row] + 1) & (self.slots - 1)

    def place(self, edge: np.ndarray) -> np.ndarray:
        return (edge * MULTIPLIER >> 16) & (self.slots - 1)

    def follow(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The state after each state and byte: along its edge, or that of its longest suffix that has one."""
        out, row = np.zeros(len(state), np.int32), np.arange(len(state))
        edge = state.astype(np.int64) << 8 | byte
        while len(row):
            place = self.place(edge)
            found = self.edge[place]
            other = np.flatnonzero((found != edge) & (found >= 0))
            while len(other):
                place[other] = (place[other] + 1) & (self.slots - 1)
                found[other] = self.edge[place[other]]
                other = other[(found[other] != edge[other]) & (found[other] >= 0)]
            hit = found >= 0
            out[row[hit]] = self.target[place[hit]]
            on = np.flatnonzero(~hit & (edge > 255))
            row, edge = row[on], self.back[edge[on] >> 8].astype(np.int64) << 8 | edge[on] & 255
        return out

    def fits(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each token may follow the other one, from the table of outcomes where it is known."""
        key = before.astype(np.int64) << PAIR | after
        place = (key * MULTIPLIER >> 11) & ((1 << REMEMBERED) - 1)
        known = self.seen[place]
        out = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != key)
        if len(new):
            fresh, which = np.unique(key[new], return_inverse=True)
            found = self.apart(fresh >> PAIR, fresh & ((1 << PAIR) - 1))
            out[new] = found[which]
            self.seen[place[new]] = key[new] << 1 | found[which]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and where each piece's ids begin (one more at the end). Pieces are data[offsets[k]:offsets[k + 1]]."""
        sizes = np.diff(offsets)
        far = np.flatnonzero(sizes > LONG)
        ids, counts = self.together(data, offsets[:-1], np.where(sizes > LONG, 0, sizes))
        if len(far):
            own = [self.alone(data[offsets[k] : offsets[k + 1]].tobytes()) for k in far]
            starts = np.concatenate(([0], np.cumsum(counts)))
            parts, last = [], 0
            for k, found in zip(far, own):
                parts += [ids[last : starts[k]], np.array(found, np.int32)]
                last = starts[k]
                counts[k] = len(found)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, np.concatenate(([0], np.cumsum(counts)))

    def together(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each piece, all pieces one step at a time."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        steps = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # pieces longer than each step
        column = np.concatenate(([0], np.cumsum(alive)))  # where a step's tokens are stored
        last = np.empty(column[-1], np.int32)
        state = np.zeros(len(sizes), np.int32)
        for step in range(steps):
            n = alive[step]
            state = self.follow(state[:n], data[starts[:n] + step])
            token = self.longest[state]
            row = np.flatnonzero(self.size[token] <= step)
            trial = token[row]
            while len(row):
                good = self.fits(last[column[step - self.size[trial]] + row], trial)
                token[row[good]] = trial[good]
                row = row[~good]
                trial = self.shorter[trial[~good]]
                whole = self.size[trial] > step
                token[row[whole]] = trial[whole]
                row, trial = row[~whole], trial[~whole]
            last[column[step] : column[step] + n] = token
        row = np.arange(alive[0] if steps else 0)
        end = sizes[: len(row)] - 1
        rounds, counts = [], np.zeros(len(sizes), np.int64)
        while len(row):
            token = last[column[end] + row]
            rounds.append((row, token))
            counts[row] += 1
            end = end - self.size[token]
            left = end >= 0
            row, end = row[left], end[left]
        placed = np.empty(len(sizes), np.int64)
        placed[order] = counts
        first = (np.cumsum(placed) - placed)[order]
        ids = np.empty(int(counts.sum()), np.int32)
        for k, (row, token) in enumerate(rounds):
            ids[first[row] + counts[row] - 1 - k] = token
        return ids, placed

    def alone(self, piece: bytes) -> list[int]:
        """The ids of one long piece."""
        if self.lone is None:
            self.lone = dict(zip(self.edge[self.edge >= 0].tolist(), self.target[self.edge >= 0].tolist())), *(memoryview(x) for x in (self.back, self.longest, self.shorter, self.size))
        edges, back, longest, shorter, size = self.lone
        last, state, met = [], 0, {}
        for step, byte in enumerate(piece):
            following = edges.get(state << 8 | byte)
            while following is None and state:
                state = back[state]
                following = edges.get(state << 8 | byte)
            state = following or 0
            token = longest[state]
            while size[token] <= step:
                pair = last[step - size[token]] << PAIR | token
                good = met.get(pair)
                if good is None:
                    if len(met) > 100_000:
                        met.clear()
                    met[pair] = good = bool(self.fits(np.array([pair >> PAIR]), np.array([pair & ((1 << PAIR) - 1)]))[0])
                if good:
                    break
                token = shorter[token]
            last.append(token)
        out, end = [], len(piece) - 1
        while end >= 0:
            out.append(last[end])
            end -= size[last[end]]
        return out[::-1]


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pieces (bytes, offsets), and for each piece which of them it is."""
    pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    _, ends, values = coded.dictionary.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(coded.dictionary) + 1]
    return np.frombuffer(values, np.uint8) if values and ends[-1] else np.zeros(0, np.uint8), ends, coded.indices.to_numpy()


def gathered(ids: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces given by number, one after the other, and where each piece's begin (one more at the end)."""
    lists = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(np.ascontiguousarray(first, np.int64) * 4), pa.py_buffer(np.ascontiguousarray(ids, np.int32))])
    _, ends, values = lists.take(pa.array(which)).buffers()
    ends = np.frombuffer(ends, np.int64)[: len(which) + 1] // 4
    return np.frombuffer(values, np.int32)[: ends[-1]] if ends[-1] else np.zeros(0, np.int32), ends
