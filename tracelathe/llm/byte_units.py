"""Units of text found and looked up without one Python string each.

A slice of texts is one array of bytes; units begin where a tokenizer never merges across.  A unit
of up to 24 bytes is named exactly by its length and one or three 64-bit words; a table remembers what
each distinct unit becomes (a short array of numbers), and answers for all units of a slice at
once.  Only units not seen before, and longer ones, become strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np

_PAD = 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


SPACE, LETTER, OTHER, APOSTROPHE = range(4)
KIND = np.array([SPACE if chr(b) in " \t\n\r" else LETTER if b >= 128 or chr(b).isalpha() else APOSTROPHE if b == 39 else OTHER
                 for b in range(256)], np.uint8)


def _pairs(rule: Callable[[int, int], bool]) -> np.ndarray:
    """Whether a border lies between two neighbours, by 4 x kind of the right + kind of the left one."""
    return np.array([rule(k % 4, k // 4) for k in range(16)])


_MEET = ((LETTER, OTHER), (OTHER, LETTER))
_BEFORE_SPACE = _pairs(lambda a, b: b == SPACE != a or (a, b) in _MEET)
_AROUND_SPACE = _pairs(lambda a, b: (a == SPACE) != (b == SPACE) or (a, b) in _MEET)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Slice:
    """Texts without zero bytes after each other as bytes; ``begins`` are their first positions."""

    def __init__(self, texts: Sequence[str], prefix: bytes = b"", table: np.ndarray | None = None):
        raws = [prefix + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.size = int(self.ends[-1]) if len(raws) else 0
        data = np.frombuffer(b"".join(raws) + bytes(_PAD), np.uint8)
        self.data = data if table is None else table[data]

    def borders(self, kind: np.ndarray, rule: np.ndarray, bits: int = 2) -> np.ndarray:
        """Positions where a unit begins: where ``rule`` holds for the kinds of two neighbours, and at every text's."""
        here = kind[self.data[:self.size]]
        pair = here << here.dtype.type(bits)
        pair[1:] |= here[:-1]
        starts = rule[pair]
        starts[self.begins[self.begins < self.ends]] = True
        return np.flatnonzero(starts)

    def per_text(self, units_at: np.ndarray) -> np.ndarray:
        """Index of the first unit of each text, and the number of units."""
        return np.append(np.searchsorted(units_at, self.begins), len(units_at))


def words_with_space(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Units that begin with a run of white space, or where letters meet other signs."""
    at = part.borders(KIND, _BEFORE_SPACE)
    return at, np.append(at[1:], part.size)


def words_alone(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The same without their white space, which the tokenizer drops."""
    at = part.borders(KIND, _AROUND_SPACE)
    ends, keep = np.append(at[1:], part.size), KIND[part.data[at]] != SPACE
    return at[keep], ends[keep]


def never_inside(pieces: Iterable[bytes]) -> np.ndarray:
    """[left byte, right byte]: whether no piece holds the two next to each other, so that a unit
    may begin at the right one; never inside a character."""
    out = np.ones((256, 256), bool)
    out[:, 0x80:0xC0] = False
    for p in pieces:
        for a, b in zip(p, p[1:]):
            out[a, b] = False
    return out


def between_strangers(part: Slice, strangers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units that end where a byte is followed by one it never meets inside a piece."""
    at = part.borders(np.arange(256, dtype=np.uint16), strangers.T.ravel(), 8)
    return at, np.append(at[1:], part.size)


def _scramble(x: np.ndarray) -> np.ndarray:
    """One to one on 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class UnitTable:
    """What each distinct unit becomes under ``solve``; forgets all beyond ``limit`` between slices."""

    def __init__(self, solve: Callable[[list[str]], Sequence[Sequence[int]]], limit: int = 400_000, slots: int = 1 << 20):
        self.solve, self.limit, self.slots = solve, limit, slots
        self.forget()

    def forget(self) -> None:
        # Keys in ascending order with their units: a dictionary's entries would take some ten times the bytes.
        self.known = {kind: (np.zeros(0, np.uint64), np.zeros(0, np.int32)) for kind in (False, True)}
        self.long: dict[bytes, int] = {}
        self.n = 0
        self.names = np.zeros((1 << 14, 4), np.uint64)
        self.offset = np.zeros((1 << 14) + 1, np.int64)
        self.flat = np.zeros(1 << 16, np.int32)
        self.slot_key = {False: np.zeros(self.slots, np.uint64), True: np.zeros(self.slots, np.uint64)}
        self.slot_unit = {False: np.full(self.slots, -1, np.int32), True: np.full(self.slots, -1, np.int32)}

    def _add(self, units: list[str], names: np.ndarray | None) -> int:
        """Solve and store units; the index of the first."""
        solved = self.solve(units)
        first, k = self.n, len(units)
        while self.n + k >= len(self.names):
            self.names = np.concatenate([self.names, np.zeros_like(self.names)])
            self.offset = np.concatenate([self.offset, np.zeros(len(self.names) // 2, np.int64)])
        sizes = np.fromiter(map(len, solved), np.int64, k)
        ends = self.offset[first] + np.cumsum(sizes)
        total = int(ends[-1])
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.offset[first]:total] = [x for s in solved for x in s]
        if names is not None:
            self.names[first:first + k] = names
        self.offset[first + 1:first + k + 1] = ends
        self.n += k
        return first

    def _units_of(self, keys: np.ndarray, middle: bool, part: Slice, at: np.ndarray, ends: np.ndarray, names: np.ndarray | None) -> np.ndarray:
        slot_key, slot_unit = self.slot_key[middle], self.slot_unit[middle]
        slot = (keys >> np.uint64(32)).astype(np.int64) & (self.slots - 1)
        unit = slot_unit[slot].astype(np.int64)
        rest = np.flatnonzero((unit < 0) | (slot_key[slot] != keys))
        if len(rest):
            distinct, first, inverse = np.unique(keys[rest], return_index=True, return_inverse=True)
            known, units = self.known[middle]
            place, found = np.searchsorted(known, distinct), np.full(len(distinct), -1, np.int64)
            old = np.flatnonzero(place < len(known))
            old = old[known[place[old]] == distinct[old]]
            found[old] = units[place[old]]
            new = np.flatnonzero(found < 0)
            if len(new):
                one = rest[first[new]]
                raw = part.data.tobytes()
                strings = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at[one].tolist(), ends[one].tolist())]
                base = self._add(strings, names[one] if middle else None)
                found[new] = base + np.arange(len(new))
                self.known[middle] = np.insert(known, place[new], distinct[new]), np.insert(units, place[new], found[new])
            slot_key[slot[rest[first]]], slot_unit[slot[rest[first]]] = distinct, found
            unit[rest] = found[inverse]
        return unit

    def _string(self, part: Slice, a: int, b: int) -> int:
        raw = part.data[a:b].tobytes()
        if raw not in self.long:
            self.long[raw] = self._add([raw.decode("utf-8", "surrogatepass")], None)
        return self.long[raw]

    def lookup(self, part: Slice, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The index of every unit.  Texts hold no zero byte (see ``Slice``)."""
        if self.n > self.limit:
            self.forget()
        size, unit = ends - at, np.zeros(len(at), np.int64)
        window = np.ndarray((len(part.data) - 7,), "<u8", part.data, 0, (1,))
        head = window[at] & _MASK[np.minimum(size, 8)]
        # Up to eight bytes are their own name, and scrambling it is one to one: no check needed.
        small, middle, long = np.flatnonzero(size <= 8), np.flatnonzero((size > 8) & (size <= 24)), np.flatnonzero(size > 24)
        unit[small] = self._units_of(_scramble(head[small]), False, part, at[small], ends[small], None)
        if len(middle):
            a, n = at[middle], size[middle]
            names = np.stack([head[middle], window[a + 8] & _MASK[np.minimum(n - 8, 8)],
                              window[a + 16] & _MASK[np.clip(n - 16, 0, 8)], n.astype(np.uint64)], axis=1)
            key = _scramble(_scramble(_scramble(names[:, 0] + names[:, 3]) + names[:, 1]) + names[:, 2])
            got = self._units_of(key, True, part, a, ends[middle], names)
            for i in np.flatnonzero((self.names[got] != names).any(axis=1)).tolist():  # two units of one key
                got[i] = self._string(part, int(a[i]), int(ends[middle[i]]))
            unit[middle] = got
        for i in long.tolist():
            unit[i] = self._string(part, int(at[i]), int(ends[i]))
        return unit

    def sizes(self, units: np.ndarray) -> np.ndarray:
        return self.offset[units + 1] - self.offset[units]

    def expand(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units after each other, and where each unit's begin (one more at the end)."""
        return gather(self.flat, self.offset, units)


def gather(flat: np.ndarray, offset: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ragged rows of (flat, offset) after each other, and their borders."""
    sizes = offset[rows + 1] - offset[rows]
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    at += np.repeat(offset[rows] - (ends - sizes), sizes)
    return flat[at], np.concatenate([[0], ends])
