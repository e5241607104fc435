"""External induced sorting of the suffixes of a shard, with common prefixes carried along.

The places that are smaller than what follows, after something larger, are the minima of a string.
What lies between two of them gets the number of smaller such pieces as its name; the names form a
shorter string, which is sorted in the same way, level by level, until names are unique, a string is
short enough to be sorted at once, or names cover ``depth`` symbols.  On the way back the sorted minima
of each level induce the order of its other suffixes: from left to right those larger than their
successor, from right to left the rest.  A suffix goes to the queue of its first symbol (of its range
of names, above the bytes) as soon as its successor is taken out, so the queues together are a priority
queue by symbol and arrival.

At the level of bytes each suffix tuple carries the length it has in common with the one pushed before
it: one more than the least common length met since.  Neighbours with ``depth`` in common are the
repeated strings.  Common lengths are exact up to ``depth``, which is at most ``CAP``.

Memory: ``memory`` tuples in the queues of a level, as many in a sort, and the tuples of one block of
names or one batch of bytes.  Queues and sorted runs beyond that go to files in the task's temporary
folder, and so do the text, names, orders and marks of a shard with more than ``memory`` symbols.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

CAP = 255
SYMBOLS = 256
#: Strings of so many names are sorted at once.
BASE = 1 << 13
_BATCH = 1 << 20
_CHUNK = 1 << 17
_PAD = CAP + 9


def room(n: int, dtype, memory: int) -> np.ndarray:
    """Zeros in memory, or in a file without a name where they are more than ``memory``."""
    if n <= memory:
        return np.zeros(n, dtype)
    file = tempfile.TemporaryFile()
    file.truncate(n * np.dtype(dtype).itemsize)
    return np.memmap(file, dtype, "r+", shape=n)


def plain(mapped: np.ndarray) -> np.ndarray:
    """The same memory or file as an ordinary array, of which a slice is cheaper."""
    return mapped.view(np.ndarray)


def chunks(n: int, memory: int = _CHUNK) -> Iterator[tuple[int, int]]:
    size = min(_CHUNK, max(1024, memory))
    for a in range(0, n, size):
        yield a, min(n, a + size)


class Places:
    """Numbers one after the other, in a file beyond ``memory``."""

    def __init__(self, memory: int):
        self.memory, self.parts, self.held, self.total, self.file = memory, [], 0, 0, None

    def add(self, numbers: np.ndarray) -> None:
        self.parts.append(numbers)
        self.held += len(numbers)
        self.total += len(numbers)
        if self.held > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.writelines(x.tobytes() for x in self.parts)
            self.parts, self.held = [], 0

    def array(self) -> np.ndarray:
        if not self.file:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        self.file.writelines(x.tobytes() for x in self.parts)
        self.file.flush()
        return plain(np.memmap(self.file, np.int64, "r", shape=self.total))


class Queues:
    """First-in-first-out queues of (place, common length), one for each symbol or block: together a priority queue."""

    def __init__(self, parts: int = SYMBOLS, memory: int = 1 << 20):
        self.memory, self.held = memory, 0
        self.parts: list[deque] = [deque() for _ in range(parts)]
        self.sizes = np.zeros(parts, np.int64)
        self.file = None

    def push(self, part: int, place: np.ndarray, common: np.ndarray | None = None) -> None:
        if not len(place):
            return
        self.parts[part].append((place, common))
        self.held += len(place)
        self.sizes[part] += len(place)
        if self.held > self.memory:
            self._spill()

    def push_by(self, part: np.ndarray, place: np.ndarray) -> None:
        """Each place to its own part, in the order given."""
        small = len(self.parts) <= 1 << 16  # numbers of 16 bits are sorted without comparisons
        order = np.argsort(part.astype(np.uint16) if small else part, kind="stable")
        part, place = part[order], place[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            self.push(int(part[a]), place[a:b].copy())

    def _spill(self) -> None:
        """The fullest queues go to the file until half the memory is free."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for part in np.argsort(-self.sizes, kind="stable").tolist():
            if self.held <= self.memory // 2:
                break
            q = self.parts[part]
            here = [p for p in q if not isinstance(p[0], int)]
            if not here:
                continue
            # what was written before came before
            old = [p for p in q if isinstance(p[0], int)]
            place = np.concatenate([p for p, _ in here])
            common = None if here[0][1] is None else np.concatenate([c for _, c in here])
            at = self.file.seek(0, 2)
            self.file.write(place.tobytes())
            if common is not None:
                self.file.write(common.tobytes())
            q.clear()
            q.extend([*old, (at, len(place), common is not None)])
            self.held -= len(place)

    def _load(self, part: int, entry) -> tuple[np.ndarray, np.ndarray | None]:
        if not isinstance(entry[0], int):
            self.held -= len(entry[0])
            self.sizes[part] -= len(entry[0])
            return entry
        at, n, with_common = entry
        self.sizes[part] -= n
        self.file.seek(at)
        place = np.frombuffer(self.file.read(8 * n), np.int64)
        return place, np.frombuffer(self.file.read(2 * n), np.int16) if with_common else None

    def pop(self, part: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray | None] | None:
        """The next tuples, about ``limit`` of them."""
        q = self.parts[part]
        if not q:
            return None
        limit = limit or min(_BATCH, self.memory)
        got, n = [], 0
        while q and n < limit:
            got.append(self._load(part, q.popleft()))
            n += len(got[-1][0])
        if len(got) == 1:
            return got[0]
        return np.concatenate([p for p, _ in got]), None if got[0][1] is None else np.concatenate([c for _, c in got])

    def all(self, part: int) -> np.ndarray:
        got = self.pop(part, 1 << 62)
        return np.zeros(0, np.int64) if got is None else got[0]


class Sorter:
    """(rank, key, index) in the order of rank and key: sorted runs in a file beyond ``memory`` tuples, merged range by range."""

    def __init__(self, memory: int):
        self.memory, self.held, self.parts, self.runs, self.file = memory, 0, [], [], None

    def add(self, rank: np.ndarray, key: np.ndarray, index: np.ndarray) -> None:
        self.parts.append((rank, key, index))
        self.held += len(rank)
        if self.held > self.memory:
            self._write()

    @staticmethod
    def _sorted(parts: list) -> tuple[np.ndarray, ...]:
        rank, key, index = (np.concatenate(x) for x in zip(*parts, strict=True))
        # equal tuples may come in any order
        order = np.argsort(key)
        if rank.any():
            order = order[np.argsort(rank[order], kind="stable")]
        return rank[order], key[order], index[order]

    def _write(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        columns = self._sorted(self.parts)
        at, n = self.file.seek(0, 2), len(columns[0])
        for x in columns:
            self.file.write(x.tobytes())
        self.file.flush()
        self.runs.append(tuple(plain(np.memmap(self.file, t, "r", at + 8 * n * i, n)) for i, t in enumerate((np.int64, np.uint64, np.int64))))
        self.parts, self.held = [], 0

    def __iter__(self) -> Iterator[tuple[np.ndarray, ...]]:
        if not self.runs:
            if self.parts:
                yield self._sorted(self.parts)
            return
        if self.parts:
            self._write()
        # between two bounds lie no more than ``memory`` tuples, but for equal ones
        step = max(1, self.memory // (2 * len(self.runs)))
        ranks, keys = (np.concatenate([run[i][step::step] for run in self.runs]) for i in (0, 1))
        taken = np.lexsort((keys, ranks))[:: len(self.runs)]
        bounds = list(zip(ranks[taken].tolist(), keys[taken].tolist(), strict=True))
        low = [0] * len(self.runs)
        for bound in [*bounds, None]:
            high = [len(run[0]) if bound is None else self._below(run, *bound) for run in self.runs]
            parts = [tuple(x[a:b] for x in run) for run, a, b in zip(self.runs, low, high, strict=True) if b > a]
            if parts:
                yield self._sorted(parts)
            low = high

    @staticmethod
    def _below(run: tuple[np.ndarray, ...], rank: int, key: int) -> int:
        a, b = np.searchsorted(run[0], (rank, rank + 1))
        return int(a + np.searchsorted(run[1][a:b], np.uint64(key)))


def minima_of(symbols: np.ndarray, memory: int) -> np.ndarray:
    """Places that are smaller than what follows their run, after something larger."""
    found, carried = Places(memory), np.zeros(0, np.int64)
    for a, b in chunks(len(symbols), memory):
        piece = symbols[a:b]
        heads = np.flatnonzero(piece[1:] != piece[:-1]) + 1 + a
        if a == 0 or symbols[a] != symbols[a - 1]:
            heads = np.concatenate(([a], heads))
        heads = np.concatenate((carried, heads))
        if len(heads) > 2:
            c = symbols[heads]
            found.add(heads[1:-1][(c[:-2] > c[1:-1]) & (c[1:-1] < c[2:])])
        carried = heads[-2:]
    return found.array()


def _named(n: int, length, word, per: int, rounds: int, memory: int) -> tuple[np.ndarray, bool]:
    """(names, whether unique) of ``n`` pieces: the number of smaller ones, by their words of ``per`` symbols.

    ``length(i)``: symbols of pieces i; ``word(i, k)``: word k of pieces i as unsigned numbers that compare
    like the symbols, with all bits set behind the end, since the longer of two alike is smaller.
    """
    names, unique = plain(room(n, np.int64, memory)), True
    active: np.ndarray | None = None  # all
    for k in range(rounds):
        sorter = Sorter(memory)
        for a, b in chunks(n if active is None else len(active), memory):
            index = np.arange(a, b) if active is None else np.asarray(active[a:b])
            sorter.add(np.asarray(names[index]), word(index, k), index)
        left, last, first, seen = Places(memory), None, 0, 0
        # equal tuples are never in two parts of what is sorted, those of equal rank may be
        for rank, key, index in sorter:
            at = np.arange(len(rank)) + seen
            group = np.ones(len(rank), bool)
            group[1:] = rank[1:] != rank[:-1]
            new = group.copy()
            new[1:] |= key[1:] != key[:-1]
            start = np.where(group, at, 0)
            if last == rank[0]:
                start[0] = first
            start = np.maximum.accumulate(start)
            names[index] = rank + np.maximum.accumulate(np.where(new, at, 0)) - start
            tied = ~new
            tied[:-1] |= tied[1:]
            last, first, seen = rank[-1], int(start[-1]), seen + len(rank)
            tied = index[tied]
            # one that ends here goes on too: the next word tells it from longer ones
            longer = length(tied) >= (k + 1) * per
            unique &= bool(longer.all())
            left.add(tied[longer])
        active = left.array()
        if not len(active):
            return names, unique
    return names, False


def _refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks count the smaller ones; equal ranks, all of them active or none, are told apart by ``key``, a rank or -1.  What stays tied comes back."""
    order = np.argsort(rank[active] * (len(rank) + 1) + key)
    who, k = active[order], key[order]
    r = rank[who]
    new_rank = np.ones(len(who), bool)
    new_rank[1:] = r[1:] != r[:-1]
    new_key = new_rank.copy()
    new_key[1:] |= k[1:] != k[:-1]
    at = np.arange(len(who))
    group = np.maximum.accumulate(np.where(new_rank, at, 0))
    first = np.maximum.accumulate(np.where(new_key, at, 0))
    rank[who] = r + first - group
    tied = ~new_key
    tied[:-1] |= tied[1:]
    return who[tied]


def _at_once(names: np.ndarray, rounds: int) -> np.ndarray:
    """The order of the suffixes of a short string, by doubling what is compared."""
    rank = np.array(names)
    order = np.argsort(rank, kind="stable")
    tied = np.zeros(len(rank), bool)
    tied[1:] = rank[order[1:]] == rank[order[:-1]]
    tied[:-1] |= tied[1:]
    active, step = order[tied], 1
    for _ in range(rounds):
        if not len(active):
            break
        follow = active + step
        active = _refine(rank, active, np.where(follow < len(rank), rank[np.minimum(follow, len(rank) - 1)], -1))
        step *= 2
    return np.argsort(rank, kind="stable")


def _block(names: np.ndarray, arrived: np.ndarray, known: np.ndarray, low: int, high: int, down: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What one block of names, [low, high), is taken out as: (places, whether induced in this pass, predecessors for other blocks).

    Up: ``known`` are the sorted minima, and predecessors that are larger are induced; down: ``known`` are
    the suffixes that the first pass found, from the largest, and smaller ones are induced.  A suffix
    that is induced within the block stands where its successor's place in the block says, which
    doubling along the chain of successors settles.
    """
    place = np.concatenate((arrived, known))
    kind = np.repeat([0, 2], [len(arrived), len(known)])
    own, jump, size = names[place], np.arange(len(place)), len(place)
    levels, before = [(place, own, jump)], []
    while len(place):
        p = place - 1
        name = names[np.maximum(p, 0)]
        follows = own > name if down else own < name
        same = own == name
        if len(levels) == 1:
            same &= kind != 2
        follows |= same
        follows &= p >= 0
        inside = follows & ((name >= low) if down else (name < high))
        before.append(np.where(follows & ~inside, p, -1))
        new = np.flatnonzero(inside)
        jump = size - len(place) + new
        place, own = p[new], name[new]
        levels.append((place, own, jump))
        size += len(place)
    place, name, jump = (np.concatenate(x) for x in zip(*levels, strict=True))
    before = np.concatenate(before) if before else np.zeros(0, np.int64)
    kind = np.concatenate((kind, np.ones(size - len(kind), np.int64)))
    seq = np.zeros(size, np.int64)
    seq[: len(arrived)] = np.arange(len(arrived))
    seq[len(arrived) : len(arrived) + len(known)] = np.arange(len(known))
    major = (((high - 1 - name) if down else (name - low)) * 3 + kind) * (len(seq) + 1) + seq
    order = np.argsort(major)
    m = major[order]
    new = np.ones(len(order), bool)
    new[1:] = m[1:] != m[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    tied = ~new
    tied[:-1] |= tied[1:]
    active = order[tied]
    while len(active):
        active = _refine(rank, active, rank[jump[active]])
        jump[active] = jump[jump[active]]
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    before = before[order]
    return place[order], kind[order] != 2, before[before >= 0]


def _induced_order(names: np.ndarray, minima: np.ndarray, memory: int) -> np.ndarray:
    """The order of all suffixes of a string of names from that of its minima.  A name is the number of smaller ones, so it is where its suffixes start."""
    n = len(names)
    width = max(256, min(1 << 16, memory // 8))
    blocks = -(-n // width)
    queues, found = Queues(blocks, memory), Queues(blocks, memory)
    last = int(names[n - 1])
    queues.push(last // width, np.array([n - 1]))  # larger than the end
    at = 0
    for b in range(blocks):
        low, high = b * width, (b + 1) * width
        start = at
        while at < len(minima) and (piece := names[minima[at : at + width]])[0] < high:
            step = int(np.searchsorted(piece, high))
            at += step
            if step < width:
                break
        known = np.asarray(minima[start:at])
        arrived = queues.all(b)
        if not len(known) and not len(arrived):
            continue
        place, larger, before = _block(names, arrived, known, low, high, False)
        found.push(b, place[larger])
        queues.push_by(names[before] // width, before)
    order, queues = plain(room(n, np.int64, memory)), Queues(blocks, memory)
    for b in reversed(range(blocks)):
        known, arrived = found.all(b)[::-1], queues.all(b)
        if not len(known) and not len(arrived):
            continue
        place, _, before = _block(names, arrived, known, b * width, (b + 1) * width, True)
        end = int(names[place[-1]]) + len(place)
        order[end - len(place) : end] = place[::-1]
        queues.push_by(names[before] // width, before)
    return order


def sorted_names(names: np.ndarray, unique: bool, depth: int, memory: int) -> np.ndarray:
    """The places of a string of names in the order of their suffixes, up to ``depth`` names."""
    n = len(names)
    if unique:
        order = plain(room(n, np.int64, memory))
        for a, b in chunks(n, memory):
            order[names[a:b]] = np.arange(a, b)
        return order
    if n <= min(BASE, memory) or depth <= 1:
        return _at_once(names, max(0, depth - 1).bit_length())
    minima = minima_of(names, memory)
    if not len(minima):
        return _induced_order(names, minima, memory)
    bits = (n + 1).bit_length()
    per = 63 // bits

    def length(i: np.ndarray) -> np.ndarray:
        return np.where(i + 1 < len(minima), minima[np.minimum(i + 1, len(minima) - 1)] + 1, n) - minima[i]

    def word(i: np.ndarray, k: int) -> np.ndarray:
        key, size, start = np.zeros(len(i), np.uint64), length(i), minima[i]
        behind = np.where(start + size < n, (1 << bits) - 1, 0)  # the end of the string is smaller than any name
        for j in range(k * per, (k + 1) * per):
            key = key << np.uint64(bits) | np.where(j < size, names[np.minimum(start + j, n - 1)] + 1, behind).astype(np.uint64)
        return key

    inner = sorted_names(*_named(len(minima), length, word, per, depth // per + 1, memory), -(-depth // 2), memory)
    seeds = plain(room(len(minima), np.int64, memory))
    for a, b in chunks(len(minima), memory):
        seeds[a:b] = minima[inner[a:b]]
    return _induced_order(names, seeds, memory)


class Suffixes:
    """``text``: bytes under SYMBOLS, 0 for what separates pieces and at the end, with room behind it for whole words (``joined``)."""

    def __init__(self, text: np.ndarray, depth: int = 200, memory: int = 1 << 20):
        if depth > CAP:
            raise ValueError(f"depth is at most {CAP}")
        self.n = max(0, len(text) - _PAD)
        self.text, self.depth, self.memory = text[: self.n], depth, memory
        #: the eight bytes from each place on, the first one lowest
        self.words = np.ndarray((max(0, len(text) - 7),), "<u8", text, 0, (1,))
        #: the sixteen from each place on, which are fetched at once and are not numbers
        self.pairs = np.ndarray((max(0, len(text) - 15),), "<c16", text, 0, (1,))

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common lengths, up to ``depth``, sixteen bytes at a time."""
        out = np.full(len(x), self.depth, np.int16)
        active = np.arange(len(x))
        for at in range(0, self.depth, 16):
            odd = (self.pairs[x + at].view(np.uint64) ^ self.pairs[y + at].view(np.uint64)).reshape(-1, 2)
            same = (odd[:, 0] | odd[:, 1]) == 0
            differ = np.flatnonzero(~same)
            if not len(differ):
                continue
            low = odd[differ, 0]
            second = low == 0
            low[second] = odd[differ[second], 1]
            low &= ~low + np.uint64(1)
            out[active[differ]] = at + 8 * second + ((np.frexp(low.astype(np.float64))[1] - 1) >> 3)
            active, x, y = active[same], x[same], y[same]
            if not len(active):
                break
        return np.minimum(out, self.depth)

    def minima(self) -> np.ndarray:
        """The places of local minima, in the order of their suffixes up to ``depth``."""
        places = minima_of(self.text, self.memory)
        m = len(places)
        if m < 2:
            return places

        def length(i: np.ndarray) -> np.ndarray:
            return np.where(i + 1 < m, places[np.minimum(i + 1, m - 1)] + 1, self.n) - places[i]

        def word(i: np.ndarray, k: int) -> np.ndarray:
            key = self.words[np.minimum(places[i] + 8 * k, self.n)].byteswap()
            behind = np.clip(8 * (k + 1) - length(i), 0, 8).astype(np.uint64)
            fill = np.where(behind < 8, (np.uint64(1) << (np.uint64(8) * np.minimum(behind, 7))) - np.uint64(1), ~np.uint64(0))
            return key | fill

        names, unique = _named(m, length, word, 8, self.depth // 8 + 1, self.memory)
        order = sorted_names(names, unique, -(-self.depth // 2), self.memory)
        out = plain(room(m, np.int64, self.memory))
        for a, b in chunks(m, self.memory):
            out[a:b] = places[order[a:b]]
        return out

    def _counts(self) -> np.ndarray:
        out = np.zeros(SYMBOLS, np.int64)
        for a, b in chunks(self.n, self.memory):
            out += np.bincount(self.text[a:b], minlength=SYMBOLS)
        return out

    def repeated(self) -> np.ndarray:
        """Which suffixes share their first ``depth`` symbols with another."""
        marks = room(self.n, bool, self.memory)
        self.marks = plain(marks)
        if not self.n:
            return marks
        minima = self.minima()
        present = np.flatnonzero(self._counts()).tolist()
        larger, store = Queues(SYMBOLS, self.memory), Queues(SYMBOLS, self.memory)
        least = np.full(SYMBOLS, -1, np.int64)
        larger.push(int(self.text[self.n - 1]), np.array([self.n - 1]), np.zeros(1, np.int16))  # larger than the end
        least[self.text[self.n - 1]] = CAP
        at = 0
        for c in present:
            last, turn = None, 0
            while (got := larger.pop(c)) is not None:
                place, common = got
                turn += 1
                if turn > CAP:
                    place, common = self._rest_of_runs(place, common, c)
                self._mark(place, common, last)
                last = int(place[-1])
                store.push(c, place, common)
                self._induce(c, place, common, least, larger, False, True, turn <= CAP)
            while at < len(minima) and self.text[minima[at]] == c:
                place = np.asarray(minima[at : at + min(_CHUNK, self.memory)])
                place = place[: int(np.searchsorted(self.text[place], c, side="right"))]
                at += len(place)
                common = np.zeros(len(place), np.int16)
                common[1:] = self._common(place[:-1], place[1:])
                if last is not None:
                    common[0] = self._common(np.array([last]), place[:1])[0]
                last = int(place[-1])
                self._induce(c, place, common, least, larger, False, False, True)
        smaller = Queues(SYMBOLS, self.memory)
        least[:] = -1
        for c in reversed(present):
            last, turn = None, 0
            while (got := smaller.pop(c)) is not None:
                place, common = got
                turn += 1
                if turn > CAP:
                    place, common = self._rest_of_runs(place, common, c)
                self._mark(place, common, last)
                last = int(place[-1])
                self._induce(c, place, common, least, smaller, True, True, turn <= CAP)
            # read backwards, a tuple's common length is that with the one that now comes after it
            for place, common in self._backwards(store, c):
                common = np.append(np.int16(0), common[:-1])
                if last is not None:
                    common[0] = self._common(np.array([last]), place[:1])[0]
                    if common[0] >= self.depth:
                        self.marks[last] = self.marks[place[0]] = True
                last = int(place[-1])
                self._induce(c, place, common, least, smaller, True, False, True)
        return marks

    @staticmethod
    def _backwards(store: Queues, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        entries = store.parts[c]
        while entries:
            place, common = store._load(c, entries.pop())
            yield place[::-1], common[::-1]

    def _rest_of_runs(self, place: np.ndarray, common: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """What would come out turn by turn where runs of ``c`` go on before ``place``, at once: all of it has CAP symbols in common."""
        sizes = []
        for p in place.tolist():
            start = p
            while start:
                low = max(0, start - _CHUNK)
                other = np.flatnonzero(self.text[low:start] != c)
                if len(other):
                    start = low + int(other[-1]) + 1
                    break
                start = low
            sizes.append(p - start)
        size = np.array(sizes)
        turn = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + 1
        who = np.repeat(np.arange(len(place)), size)
        order = np.lexsort((who, turn))
        return np.concatenate((place, (place[who] - turn)[order])), np.concatenate((common, np.full(len(order), CAP, np.int16)))

    def _mark(self, place: np.ndarray, common: np.ndarray, last: int | None) -> None:
        far = np.flatnonzero(common >= self.depth)
        self.marks[place[far]] = True
        self.marks[place[far[far > 0] - 1]] = True
        if last is not None and common[0] >= self.depth:
            self.marks[last] = True

    def _induce(self, c: int, place: np.ndarray, common: np.ndarray, least: np.ndarray, queues: Queues, down: bool, own: bool, again: bool) -> None:
        """Push the predecessors of suffixes that start with ``c``; least: of each symbol, what was met since its last push (-1: never).

        ``own``: the suffixes are of the kind that this pass induces, so that an equal predecessor is too;
        ``again``: equal ones are still to be pushed.
        """
        low = int(common.min())
        before = place - 1
        symbols = self.text[np.maximum(before, 0)]
        follows = symbols < c if down else symbols > c
        if own and again:
            follows |= symbols == c
        wanted = np.flatnonzero(follows & (before >= 0))
        if not len(wanted):
            np.minimum(least, low, out=least)
            return
        order = np.argsort(symbols[wanted], kind="stable")
        source = wanted[order]
        symbol = symbols[source]
        first = np.ones(len(source), bool)
        first[1:] = symbol[1:] != symbol[:-1]
        heads = np.flatnonzero(first)
        tails = np.append(heads[1:], len(source)) - 1
        shared = np.zeros(len(source), np.int64)
        rest = np.flatnonzero(~first)
        if len(rest):
            shared[rest] = _least(common, source[rest - 1] + 1, source[rest] + 1)
        names = symbol[heads].astype(np.int64)
        shared[heads] = np.minimum(least[names], np.minimum.accumulate(common)[source[heads]])
        shared = np.minimum(shared + 1, CAP).astype(np.int16)
        after = source[tails] + 1
        back = np.minimum.accumulate(common[::-1])[::-1]
        fresh = np.where(after < len(common), back[np.minimum(after, len(common) - 1)], CAP)
        absent = np.ones(SYMBOLS, bool)
        absent[names] = False
        least[absent] = np.minimum(least[absent], low)
        least[names] = fresh
        to = before[source]
        for c, a, b in zip(names.tolist(), heads.tolist(), (tails + 1).tolist(), strict=True):
            queues.push(c, to[a:b].copy(), shared[a:b].copy())  # a view would keep the whole batch


def _least(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of values[start:stop] for each range, none empty: by ranges of powers of two, as long as any is asked for."""
    level = np.frexp((stop - start).astype(np.float64))[1] - 1
    out = np.empty(len(start), np.int16)
    table, width = values, 1
    for k in range(int(level.max()) + 1):
        me = np.flatnonzero(level == k)
        out[me] = np.minimum(table[start[me]], table[stop[me] - width])
        if k < int(level.max()):
            table, width = np.minimum(table[:-width], table[width:]), 2 * width
    return out


def joined(pieces: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text, starts): pieces of bytes under 255 as symbols with separators, in a file without a name that is memory-mapped."""
    file, starts, at = tempfile.TemporaryFile(), [], 0
    for piece in pieces:
        starts.append(at)
        file.write((piece + np.uint8(1)).tobytes() + b"\0")
        at += len(piece) + 1
    if not at:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    file.write(bytes(_PAD))
    file.flush()
    return plain(np.memmap(file, np.uint8, "r")), np.array(starts)
