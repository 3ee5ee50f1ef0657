"""Likeness of many titles and texts at once, inside a task: the numbers of a bounded set of
prepared items as arrays, the shared members of all their sets by products of matrices where
members are frequent and by counting where they are rare, and bounds of the similarity that
tell for which pairs the sequence ratio is needed at all."""

from __future__ import annotations

import re

from tidewatch.functions.text import STORY_TOKEN

_WORDS = re.compile(STORY_TOKEN)
#: Bins of characters that bound a sequence ratio, and those of regions of texts.
BINS, ROOM = 64, 32
#: A member in one of so many pairs or more is frequent; regions of texts compared at once.
OFTEN, REGIONS = 300, 2_048
#: Members' keys are used as they are up to this one.
MOST_KEYS = 4_000_000
#: From this length on difflib leaves out a text's popular characters.
LONG = 200


def sequence_ratio(a: str, b: str) -> float:
    """difflib's ratio. Up to 199 characters of b it has no popular ones, and its longest block,
    the first in a and then in b, is found by the text search of strings."""
    if len(b) >= 200:
        from difflib import SequenceMatcher

        return SequenceMatcher(None, a, b).ratio()
    matched, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a_lo, a_hi, b_lo, b_hi = open_.pop()
        i, size, at = a_lo, 0, (a_lo, b_lo)
        while i + size < a_hi and size < b_hi - b_lo:
            j = b.find(a[i : i + size + 1], b_lo, b_hi)
            if j < 0:
                i += 1
                continue
            size += 1
            while i + size < a_hi and j + size < b_hi and a[i + size] == b[j + size]:
                size += 1
            at = i, j
        if size:
            matched += size
            i, j = at
            if a_lo < i and b_lo < j:
                open_.append((a_lo, i, b_lo, j))
            if i + size < a_hi and j + size < b_hi:
                open_.append((i + size, a_hi, j + size, b_hi))
    return 2.0 * matched / (len(a) + len(b)) if a or b else 1.0


def _runs(starts, lengths):
    """starts[0], starts[0] + 1, .. for each start and length, one after the other."""
    import numpy as np

    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Texts:
    """Texts as numbers of characters, one after the other."""

    def __init__(self, texts: list[str]):
        import numpy as np

        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        known, codes = np.unique(points, return_inverse=True)
        self._counts = None
        self.codes = codes.astype(np.uint8 if len(known) < 254 else np.int32)
        self.pads = (254, 255) if len(known) < 254 else (-1, -2)  # no character's numbers
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        owner = np.repeat(np.arange(len(texts)), self.lengths)
        self.bins = np.bincount(owner * BINS + points % BINS, minlength=len(texts) * BINS).reshape(-1, BINS).astype(np.int32)
        # in long texts the characters that are not popular, by place and by text and last bits
        self.rare, self.told = np.ones(len(codes), bool), np.zeros((len(texts), 256), bool)
        for one in np.flatnonzero(self.lengths >= LONG):
            own = slice(self.starts[one], self.starts[one] + self.lengths[one])
            self.rare[own] = np.bincount(codes[own], minlength=len(known))[codes[own]] <= self.lengths[one] // 100 + 1
            self.told[one, codes[own][self.rare[own]] & 255] = True

    def _room(self, a_lo, a_hi, b_lo, b_hi):
        """No more characters of regions can be matched: in both they are so often."""
        import numpy as np

        if self._counts is None:  # of characters' last bits, up to each place; differences are right if sums overflow
            self._counts = np.zeros((len(self.codes) + 1, ROOM), np.uint16 if self.lengths.max() < 1 << 16 else np.int32)
            self._counts[np.arange(1, len(self.codes) + 1), self.codes % ROOM] = 1
            np.cumsum(self._counts, axis=0, dtype=self._counts.dtype, out=self._counts)
        found, n = np.empty(len(a_lo), np.int64), self._counts
        for start in range(0, len(a_lo), 16_384):
            x = slice(start, start + 16_384)
            found[x] = np.minimum(n[a_hi[x]] - n[a_lo[x]], n[b_hi[x]] - n[b_lo[x]]).sum(axis=1)
        return found

    def ratios(self, left, right, least):
        """difflib's ratios of many pairs (a in left, b in right) at once, where they are at
        least `least`; where they are not, a number below that. The longest block common to
        a pair is found, then those of what is before and after it, and so on; a pair whose
        open regions cannot bring it to `least` any more is left."""
        import numpy as np

        total, matched = self.lengths[left] + self.lengths[right], np.zeros(len(left), np.int64)
        found = np.where(total > 0, -1.0, 1.0)
        pair = np.flatnonzero(total > 0)
        a, b = left[pair], right[pair]
        regions = [pair, self.starts[a], self.starts[a] + self.lengths[a], self.starts[b], self.starts[b] + self.lengths[b]]
        regions = [x[(self.lengths[a] > 0) & (self.lengths[b] > 0)] for x in regions]
        while len(regions[0]):
            pair, a_lo, a_hi, b_lo, b_hi = regions
            room = np.bincount(pair, self._room(a_lo, a_hi, b_lo, b_hi), minlength=len(left))
            most = 2.0 * (matched + room) / np.maximum(total, 1)
            over = most < least - 1e-9
            found = np.where(over & (found < 0), most, found)
            pair, a_lo, a_hi, b_lo, b_hi = (x[~over[pair]] for x in regions)
            i, j, size = np.zeros_like(a_lo), np.zeros_like(a_lo), np.zeros_like(a_lo)
            long = self.lengths[right[pair]] >= LONG
            for some, find in ((~long, self._longest), (long, self._longest_of_rare)):
                at = np.flatnonzero(some)
                at = at[np.argsort(b_hi[at] - b_lo[at], kind="stable")]  # regions of about one size go together
                at = at[np.lexsort((a_hi[at] - a_lo[at], np.arange(len(at)) // (4 * REGIONS)))]
                for start in range(0, len(at), REGIONS):
                    x = at[start : start + REGIONS]
                    i[x], j[x], size[x] = find(a_lo[x], a_hi[x], b_lo[x], b_hi[x], right[pair[x]])
            matched += np.bincount(pair, size, minlength=len(left)).astype(np.int64)
            before, after = (size > 0) & (a_lo < i) & (b_lo < j), (size > 0) & (i + size < a_hi) & (j + size < b_hi)
            first, second = (pair, a_lo, i, b_lo, j), (pair, i + size, a_hi, j + size, b_hi)
            regions = [np.concatenate([x[before], y[after]]) for x, y in zip(first, second)]
        return np.where(found < 0, 2.0 * matched / np.maximum(total, 1), found)

    @staticmethod
    def _best(a, b, linked=None):
        """Of columns of characters, each a pair's, the longest common block's length and ends,
        the first in a and then in b. linked: which neighbours in a and in b are so in the texts."""
        import numpy as np

        kind = np.uint8 if min(len(a), len(b)) < 255 else np.int32
        column, tops, equal = np.arange(b.shape[1]), np.zeros(a.shape, kind), np.zeros(b.shape, bool)
        both, same = [np.zeros((len(b) + 1, b.shape[1]), kind) for _ in "ab"], equal.view(np.uint8)
        for t in range(len(a)):  # lengths of the blocks that end here in a, by their ends in b
            old, new = both[t % 2][:-1], both[1 - t % 2][1:]
            np.equal(b, a[t], out=equal)
            if linked is None:
                np.add(old, 1, out=new)
            else:
                np.multiply(old, linked[1], out=new)
                np.multiply(new, linked[0][t], out=new)
                np.add(new, 1, out=new)
            np.multiply(new, same, out=new)
            np.maximum.reduce(new, axis=0, out=tops[t])
        end_a = tops.argmax(axis=0)
        best = tops[end_a, column].astype(np.int64)
        ends, back = b == a[end_a, column], 1  # where in b such a block ends
        while len(column):
            column = np.flatnonzero(best > back)
            if len(column) > b.shape[1] // 4:
                ends[back:] &= (b[:-back] == a[np.maximum(end_a - back, 0), np.arange(b.shape[1])]) & (True if linked is None else linked[1][1 : len(b) - back + 1] == 1) | (best <= back)
                ends[:back] &= best <= back
            elif len(column):
                ends[back:, column] &= (b[:-back, column] == a[end_a[column] - back, column]) & (True if linked is None else linked[1][1 : len(b) - back + 1, column] == 1)
                ends[:back, column] = False
            back += 1
        return best, end_a, ends.argmax(axis=0)

    def _longest(self, a_lo, a_hi, b_lo, b_hi, right):
        import numpy as np

        sides = []
        for lo, hi, pad in ((a_lo, a_hi, self.pads[0]), (b_lo, b_hi, self.pads[1])):
            at = np.arange((hi - lo).max())[:, None]
            sides.append(np.where(at < hi - lo, self.codes[np.minimum(lo + at, len(self.codes) - 1)], np.array(pad, self.codes.dtype)))
        size, end_a, end_b = self._best(*sides)
        return a_lo + np.where(size > 0, end_a - size + 1, 0), b_lo + np.where(size > 0, end_b - size + 1, 0), size

    def _longest_of_rare(self, a_lo, a_hi, b_lo, b_hi, right):
        """As difflib has it for a long b: blocks are looked for among characters that are not
        popular in b, and what is found, if only the regions' beginnings, is made longer by any."""
        import numpy as np

        codes, sides, places, links = self.codes, [], [], []
        for lo, hi, pad in ((a_lo, a_hi, self.pads[0]), (b_lo, b_hi, self.pads[1])):
            owner, at = np.repeat(np.arange(len(lo)), hi - lo), _runs(lo, hi - lo)
            kept = self.told[right[owner], codes[at] & 255] if lo is a_lo else self.rare[at]
            owner, at = owner[kept], at[kept]
            n = np.bincount(owner, minlength=len(lo))
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            side, where = np.full((max(n.max(), 1), len(lo)), pad, codes.dtype), np.full((max(n.max(), 1), len(lo)), -9, np.int64)
            side[place, owner], where[place, owner] = codes[at], at
            sides.append(side)
            places.append(where)
            links.append(np.vstack([np.zeros((1, len(lo)), np.uint8), (np.diff(where, axis=0) == 1).astype(np.uint8)]))
        size, end_a, end_b = self._best(*sides, links)
        column = np.arange(len(size))
        i, j = (np.where(size > 0, where[end, column] - size + 1, lo) for where, end, lo in zip(places, (end_a, end_b), (a_lo, b_lo)))
        last = len(codes) - 1
        open_ = np.flatnonzero((i > a_lo) & (j > b_lo))
        while len(open_):
            open_ = open_[codes[i[open_] - 1] == codes[j[open_] - 1]]
            i[open_] -= 1
            j[open_] -= 1
            size[open_] += 1
            open_ = open_[(i[open_] > a_lo[open_]) & (j[open_] > b_lo[open_])]
        open_ = column
        while len(open_):
            a, b = i[open_] + size[open_], j[open_] + size[open_]
            open_ = open_[(a < a_hi[open_]) & (b < b_hi[open_]) & (codes[np.minimum(a, last)] == codes[np.minimum(b, last)])]
            size[open_] += 1
        return i, j, size


def _members(owner, keys, n: int):
    """(owner, place, places, sizes) of sets' members, each once a set and in order of owners:
    places number the members that stand in several of the n sets."""
    import numpy as np

    if len(keys) and keys.max() > MOST_KEYS:
        keys = np.unique(keys, return_inverse=True)[1]
    width = int(keys.max()) + 1 if len(keys) else 1
    both = np.sort(owner * width + keys)
    owner, keys = np.divmod(both[np.append(True, both[1:] != both[:-1])] if len(both) else both, width)
    often = np.bincount(keys, minlength=width) > 1
    kept = often[keys]
    return owner[kept], (np.cumsum(often) - 1)[keys[kept]], int(often.sum()), np.bincount(owner, minlength=n)


def _grams(texts: Texts):
    """(owner, key) of the runs of three characters of texts, or of a shorter text as it is."""
    import numpy as np

    codes, n = texts.codes.astype(np.int64) + 1, texts.lengths
    base = int(codes.max()) + 1 if len(codes) else 1
    at = _runs(texts.starts, np.maximum(n - 2, 0))
    keys = (codes[at] * base + codes[at + 1]) * base + codes[at + 2]
    short = np.flatnonzero((n > 0) & (n < 3))
    begin = texts.starts[short]
    lone = codes[begin] + np.where(n[short] > 1, codes[begin + n[short] - 1] * base, 0)
    return np.concatenate([np.repeat(np.arange(len(n)), np.maximum(n - 2, 0)), short]), np.concatenate([keys, lone])


class Titles:
    """Items of a task, in the order given: (t, body) as `stories.prepared` makes them, and
    concepts, a dict of key to weight each. `stop`: title tokens that do not count."""

    def __init__(self, texts: list[tuple[str, str]], concepts: list[dict[str, float]], stop: frozenset[str], keys: list[str]):
        import numpy as np

        n = len(texts)
        words = [(_WORDS.findall(t), _WORDS.findall(body)) for t, body in texts]
        self.tc = ["".join(t) for t, _ in words]
        self.titles = Texts(self.tc)
        known: dict[str, int] = {}
        self.sizes, self._members = {}, {}
        for kind, side in (("tt", 0), ("bt", 1)):
            told = [[known.setdefault(w, len(known)) for w in set(x[side]) if len(w) > 1 and w not in stop] for x in words]
            flat = np.array([k for x in told for k in x], np.int64)
            *self._members[kind], self.sizes[kind] = _members(np.repeat(np.arange(n), [len(x) for x in told]), flat, n)
        for kind, own in (("tg", self.titles), ("bg", Texts(["".join(b) for _, b in words]))):
            *self._members[kind], self.sizes[kind] = _members(*_grams(own), n)
        self.empty_body = np.array([not body for _, body in texts], bool)
        self.empty_title = np.array([not t for t, _ in texts], bool)
        self.length = self.titles.lengths
        same: dict[str, int] = {}
        self.same = np.array([same.setdefault(x, len(same)) for x in self.tc], np.int64)
        self.weights = np.array([[c.get(k, 0.0) for k in keys] for c in concepts], float).reshape(n, len(keys))
        self.has = np.array([[k in c for k in keys] for c in concepts], bool).reshape(n, len(keys))
        self._sides: dict[tuple, list] = {}

    def _split(self, kind: str, right: slice):
        """What `shared` needs of the sets in `right`: frequent members as a dense matrix, rare
        ones by their owners."""
        import numpy as np

        if (kind, right.start, right.stop) not in self._sides:
            owner, place, width = self._members[kind]
            mine = (owner >= right.start) & (owner < right.stop)
            owner, place = owner[mine] - right.start, place[mine]
            here = np.bincount(place, minlength=width)
            everywhere = np.bincount(self._members[kind][1], minlength=width)
            often = (here > 0) & (everywhere.astype(float) * here * OFTEN > float(len(self.length)) * (right.stop - right.start))
            column = np.cumsum(often) - 1
            dense = np.zeros((right.stop - right.start, int(often.sum())), np.float32)
            dense[owner[often[place]], column[place[often[place]]]] = 1
            rare = ~often[place]
            order = np.argsort(place[rare], kind="stable")
            n = np.where(often, 0, here)
            self._sides = {k: x for k, x in self._sides.items() if k[1:] == (right.start, right.stop)}
            self._sides[kind, right.start, right.stop] = [often, column, dense, owner[rare][order], np.cumsum(n) - n, n]
        return self._sides[kind, right.start, right.stop]

    def shared(self, left: slice, right: slice):
        """{kind: how many members the sets of each item in `left` and in `right` share}."""
        import numpy as np

        found = {}
        for kind, (owner, place, _) in self._members.items():
            often, column, dense, owners, starts, n = self._split(kind, right)
            rows, cols = left.stop - left.start, right.stop - right.start
            first, last = np.searchsorted(owner, [left.start, left.stop])  # members are in order of their owners
            own, at = owner[first:last] - left.start, place[first:last]
            mine = often[at]
            x = np.zeros((rows, dense.shape[1]), np.float32)
            x[own[mine], column[at[mine]]] = 1
            total = x @ dense.T
            own, at = own[~mine], at[~mine]
            met = owners[_runs(starts[at], n[at])] + np.repeat(own * cols, n[at])
            found[kind] = total + np.bincount(met, minlength=rows * cols).reshape(rows, cols) if len(met) else total
            found[kind] = found[kind].astype(np.float32, copy=False)
        return found

    def upper(self, left: slice, right: slice, both):
        """A bound of the similarity, up to 1e-4, of all items in `left` with all in `right`,
        given what they share."""
        import numpy as np

        one = np.float32(1)
        size = lambda kind: (self.sizes[kind][left, None].astype(np.float32), self.sizes[kind][None, right].astype(np.float32))

        def told(kind):
            """Containment and Jaccard; Dice is twice what is shared by the sizes' sum."""
            a, b = size(kind)
            return both[kind] / np.maximum(np.minimum(a, b), one), both[kind] / np.maximum(a + b - both[kind], one)

        def dice(kind):
            a, b = size(kind)
            return both[kind] / (np.maximum(a + b, one) * np.float32(0.5))

        a, b = self.length[left, None].astype(np.float32), self.length[None, right].astype(np.float32)
        contained, near = told("tt")
        ratio = np.minimum(a, b) / (np.maximum(a + b, one) * np.float32(0.5))
        title = np.maximum(contained * np.float32(0.52) + dice("tg") * np.float32(0.48), ratio * np.float32(0.55) + near * np.float32(0.45))
        contained, near = told("bt")
        body = np.maximum(contained * np.float32(0.55) + near * np.float32(0.45), dice("bg"))
        bare = self.empty_body[left, None] | self.empty_body[None, right]
        return np.where(bare, title, title * np.float32(0.78) + body * np.float32(0.22))

    def parts(self, one, others, row: dict):
        """Of an item and others, or of pairs, given what `shared` has of them: the title's
        similarity without the sequence ratio, its Jaccard, the body's similarity, whether a
        body is empty."""
        import numpy as np

        of = lambda kind: (row[kind].astype(float), self.sizes[kind][one], self.sizes[kind][others])

        def containment(kind):
            both, a, b = of(kind)
            return both / np.maximum(np.minimum(a, b), 1)

        def jaccard(kind):
            both, a, b = of(kind)
            return np.where((a > 0) & (b > 0), both / np.maximum(a + b - both, 1), 0.0)

        def dice(kind):
            both, a, b = of(kind)
            return both * 2.0 / np.maximum(a + b, 1)

        near = jaccard("tt")
        body = np.maximum(containment("bt") * 0.55 + jaccard("bt") * 0.45, dice("bg"))
        return containment("tt") * 0.52 + dice("tg") * 0.48, near, body, self.empty_body[one] | self.empty_body[others]

    @staticmethod
    def whole(parts, ratio):
        """The similarity before rounding, of titles that differ and are not empty."""
        import numpy as np

        fixed, near, body, bare = parts
        title = np.maximum(fixed, ratio * 0.55 + near * 0.45)
        return np.where(bare, title, np.minimum(title * 0.78 + body * 0.22, 1.0))

    def upper_ratio(self, one, others, close: bool = False):
        """No sequence ratio is larger: by the lengths, or closer by the characters."""
        import numpy as np

        both = np.minimum(self.titles.bins[one], self.titles.bins[others]).sum(axis=1) if close else np.minimum(self.length[one], self.length[others])
        return np.where(self.length[one] + self.length[others] > 0, both * 2.0 / np.maximum(self.length[one] + self.length[others], 1), 1.0)

    def ratio(self, left: int, right: int) -> float:
        """The sequence ratio of two titles."""
        return sequence_ratio(self.tc[left], self.tc[right])

    def ratios(self, left, right, least):
        """Sequence ratios of pairs of titles, where they are at least `least`, else less than that."""
        return self.titles.ratios(left, right, least)
