"""Suffix order with common-prefix values by external induced sorting.

Suffixes are S- or L-type as they are smaller or larger than their right
neighbour; an S-type one after an L-type one is leftmost-S (LMS). The LMS
suffixes are sorted first: their substrings up to the next LMS position are
sorted and named, and the string of names is sorted the same way, recursively,
until the names differ or the string is small enough to be ranked in memory.
All other suffixes follow by induction: scanning the sorted order upwards, each
suffix hands its left neighbour, if L-type, to the queue of its first symbol;
scanning downwards does the same for S-type ones. The queues are one
disk-backed priority queue by first symbol, first in first out, of tuples
(position, common prefix with the tuple before); on the strings of names the
tuples are (position, name), as only their order is asked for.

``memory`` bounds the tuples that are held: what exceeds it goes to temporary
files, as do texts, sorted runs, and finished tuples, and is read again in
blocks. Only the first ``depth`` symbols count; common prefixes are capped
there, and suffixes that agree so far may come in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Queues of one level; where there are more symbols, a queue holds a range of them.
QUEUES = 512
TUPLE = np.dtype([("pos", "<i8"), ("lcp", "u1")])
PAIR = np.dtype([("pos", "<i8"), ("symbol", "<i8")])
#: Bytes that a tuple costs while a block of it is worked on, about.
WORK = 64
#: Bytes that ranking a name in memory takes.
RANK = 40


class Disk:
    """Temporary files of one sort, and how much went to them."""

    def __init__(self, memory: int):
        self.memory = memory
        self.block = max(256, memory // WORK)
        self.spills = 0
        self.levels = 0
        self.files: list = []

    def file(self):
        f = tempfile.TemporaryFile()  # noqa: SIM115
        self.files.append(f)
        return f

    def array(self, n: int, dtype) -> np.ndarray:
        """An array of zeros, on disk if it takes a good share of the memory."""
        dtype = np.dtype(dtype)
        if n * dtype.itemsize <= self.memory // 8:
            return np.zeros(n, dtype)
        self.spills += 1
        f = self.file()
        f.truncate(n * dtype.itemsize)
        return np.memmap(f, dtype, "r+", shape=(n,))

    def close(self) -> None:
        for f in self.files:
            f.close()
        self.files = []


class Spool:
    """Tuples by queue number, in order of arrival; all that exceeds the memory goes to one file."""

    def __init__(self, disk: Disk, queues: int, dtype: np.dtype, memory: int):
        self.disk, self.dtype, self.memory = disk, dtype, memory
        self.held: list[list[np.ndarray]] = [[] for _ in range(queues)]
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(queues)]
        self.size = 0
        self.out = None

    def push(self, q: int, block: np.ndarray) -> None:
        self.held[q].append(block)
        self.size += block.nbytes
        if self.size > self.memory:
            self.spill()

    def spill(self) -> None:
        if self.out is None:
            self.out = self.disk.file()
        self.disk.spills += 1
        self.out.seek(0, os.SEEK_END)
        for q, blocks in enumerate(self.held):
            if blocks:
                self.runs[q].append((self.out.tell(), sum(map(len, blocks))))
                for b in blocks:
                    self.out.write(b.tobytes())
                self.held[q] = []
        self.size = 0

    def read(self, at: int, n: int) -> np.ndarray:
        self.out.seek(at)
        return np.frombuffer(self.out.read(n * self.dtype.itemsize), self.dtype)

    def pop(self, q: int) -> Iterator[np.ndarray]:
        """All tuples of a queue as they are now, oldest first, in blocks; the queue is empty afterwards."""
        runs, held = self.runs[q], self.held[q]
        self.runs[q], self.held[q] = [], []
        self.size -= sum(b.nbytes for b in held)
        for at, n in runs:
            for k in range(0, n, self.disk.block):
                yield self.read(at + k * self.dtype.itemsize, min(self.disk.block, n - k))
        if held:
            yield from _blocks(np.concatenate(held), self.disk.block)

    def any(self, q: int) -> bool:
        return bool(self.runs[q] or self.held[q])


def _blocks(a: np.ndarray, n: int) -> Iterator[np.ndarray]:
    for k in range(0, len(a), n):
        yield a[k : k + n]


class Column:
    """Tuples of one symbol in order, held or on disk, readable from any place."""

    def __init__(self, disk: Disk):
        self.disk, self.parts, self.n = disk, [], 0
        self.bytes, self.out = 0, None

    def append(self, block: np.ndarray) -> None:
        self.parts.append(block)
        self.n += len(block)
        self.bytes += block.nbytes
        if self.bytes > self.disk.memory // 8:
            if self.out is None:
                self.out = self.disk.file()
                self.disk.spills += 1
            for b in self.parts:
                self.out.write(b.tobytes())
            self.parts, self.bytes = [], 0

    def view(self) -> np.ndarray:
        """All tuples; those on disk are mapped, not loaded."""
        if self.out is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, TUPLE)
        for b in self.parts:
            self.out.write(b.tobytes())
        self.out.flush()
        self.parts, self.bytes = [], 0
        return np.memmap(self.out, TUPLE, "r", shape=(self.n,))


def tuples(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.empty(len(pos), TUPLE)
    out["pos"], out["lcp"] = pos, lcp
    return out


class Text:
    """A string that ends with a unique 0, padded by ``depth`` zeros, with types and run lengths."""

    def __init__(self, symbols: np.ndarray, n: int, depth: int, disk: Disk):
        self.symbols, self.n, self.depth, self.disk = symbols, n, depth, disk
        self.body = symbols[:n]
        #: How often the first symbol of a suffix repeats, capped; whether the suffix is S-type.
        self.run = disk.array(n, np.uint8)
        self.small = disk.array(n, bool)
        found = []
        step = max(1024, disk.memory // 32)
        next_symbol, next_run, next_small = -1, 0, True
        for hi in range(n, 0, -step):
            lo = max(0, hi - step)
            block = np.asarray(self.body[lo:hi])
            change = np.flatnonzero(block[1:] != block[:-1])
            ends = np.append(change, len(block) - 1)
            starts = np.concatenate([[0], change + 1])
            lengths = ends - starts + 1
            run = np.repeat(ends, lengths) - np.arange(len(block)) + 1
            same = int(block[-1]) == next_symbol
            if same:
                run[starts[-1] :] += next_run
            after = np.append(block[ends[:-1] + 1], next_symbol) if len(ends) > 1 else np.array([next_symbol])
            kind = after > block[starts]
            if same:
                kind[-1] = next_small
            elif hi == n:
                kind[-1] = True
            self.run[lo:hi] = np.minimum(run, depth)
            self.small[lo:hi] = np.repeat(kind, lengths)
            next_symbol, next_run, next_small = int(block[0]), int(self.run[lo]), bool(self.small[lo])
        before = False
        for lo in range(0, n, step):
            block = np.asarray(self.small[lo : lo + step])
            left = np.concatenate([[before], block[:-1]])
            found.append(np.flatnonzero(block & ~left) + lo)
            before = bool(block[-1])
        m = sum(map(len, found))
        if len(found) and len(found[0]) and found[0][0] == 0:  # the first suffix has no left neighbour
            found[0] = found[0][1:]
            m -= 1
        self.lms = disk.array(m, np.int64)
        at = 0
        for f in found:
            self.lms[at : at + len(f)] = f
            at += len(f)


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, capped; ``text`` is padded by depth symbols."""
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    for k in range(depth):
        live = live[text[a[live] + k] == text[b[live] + k]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _words(text: Text, at: np.ndarray, stop: np.ndarray, bits: int) -> list[np.ndarray]:
    """The symbols at..stop (inclusive, ``depth`` at most) packed into words; what ends counts as larger than any symbol."""
    per = 63 // bits
    most = int(min(text.depth, (stop - at).max(initial=0) + 1))
    top = np.uint64((1 << bits) - 1)
    words = []
    for lo in range(0, most, per):
        word = np.zeros(len(at), np.uint64)
        for k in range(lo, lo + per):
            if k < text.depth:
                symbol = text.symbols[np.minimum(at + k, len(text.symbols) - 1)].astype(np.uint64)
                symbol = np.where(at + k <= stop, symbol, top)
            else:
                symbol = top
            word = (word << np.uint64(bits)) | symbol
        words.append(word)
    return words


def _refine(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, tied): rows sorted word by word, and whether each equals the one before; only ties are sorted again."""
    order = np.argsort(words[0])
    tied = np.concatenate([[False], words[0][order][1:] == words[0][order][:-1]])
    for word in words[1:]:
        at = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(at):
            break
        block = np.cumsum(~tied)[at]
        sub = order[at]
        again = np.lexsort((word[sub], block))
        sub = sub[again]
        order[at] = sub
        tied[at] = np.concatenate([[False], (block[1:] == block[:-1]) & (word[sub][1:] == word[sub][:-1])])
    return order, tied


def names(text: Text, bits: int) -> tuple[np.ndarray, int]:
    """The names of the LMS substrings in text order, and how many there are.

    Blocks of positions are sorted into runs on disk; splitters cut the runs
    into ranges that are merged one after the other.
    """
    disk, lms, m = text.disk, text.lms, len(text.lms)
    out = disk.array(m, np.int64)
    stop = lambda k: np.append(lms[k[0] + 1 : k[1] + 1], text.n - 1)[: k[1] - k[0]]
    step = max(256, disk.memory // (2 * WORK))
    if m <= step:
        order, tied = _refine(_words(text, np.asarray(lms), stop((0, m)), bits))
        rank = np.cumsum(~tied) - 1
        out[order] = rank
        return out, int(rank[-1]) + 1
    per = 63 // bits
    width = -(-text.depth // per)
    row = np.dtype([("k", "<i8"), ("w", ">u8", (width,))])
    runs = []
    for lo in range(0, m, step):
        hi = min(m, lo + step)
        words = _words(text, np.asarray(lms[lo:hi]), stop((lo, hi)), bits)
        order, _ = _refine(words)
        f = disk.file()
        disk.spills += 1
        block = np.empty(hi - lo, row)
        block["k"] = lo + order
        block["w"] = (1 << 63) - 1
        for j, w in enumerate(words):
            block["w"][:, j] = w[order]
        if len(words) < width:  # words left out are all ends, as in _words
            full = 0
            for _ in range(per):
                full = (full << bits) | ((1 << bits) - 1)
            block["w"][:, len(words) :] = full
        f.write(block.tobytes())
        f.flush()
        runs.append(np.memmap(f, row, "r", shape=(hi - lo,)))
    key = lambda r: r["w"].tobytes()  # noqa: E731  (big-endian words compare as bytes)
    every = max(1, step // (4 * len(runs)))
    splitters = sorted(key(r[k]) for r in runs for k in range(every, len(r), every))
    # about step rows lie between two chosen splitters
    chosen = splitters[max(1, step // (2 * every)) :: max(1, step // (2 * every))]

    def cut(run: np.ndarray, bound: bytes) -> int:
        lo, hi = 0, len(run)
        while lo < hi:
            mid = (lo + hi) // 2
            if key(run[mid]) < bound:
                lo = mid + 1
            else:
                hi = mid
        return lo

    starts = [0] * len(runs)
    rank, last = -1, None
    for bound in [*dict.fromkeys(chosen), None]:
        ends = [len(r) if bound is None else cut(r, bound) for r in runs]
        part = np.concatenate([r[a:b] for r, a, b in zip(runs, starts, ends, strict=True)])
        starts = ends
        if not len(part):
            continue
        order, tied = _refine([part["w"][:, j].astype(np.uint64) for j in range(width)])
        fresh = ~tied
        fresh[0] = key(part[order[0]]) != last
        ranks = rank + np.cumsum(fresh)
        out[part["k"][order]] = ranks
        rank, last = int(ranks[-1]), key(part[order[-1]])
    return out, rank + 1


def _rank_in_memory(named: np.ndarray, depth: int) -> np.ndarray:
    """The positions of ``named`` by the names that follow, ``depth`` of them, by doubling; only ties are ranked again."""
    m = len(named)
    order = np.argsort(named)
    # a rank is the place of the first of its class, so that classes that are left alone keep theirs
    first = np.flatnonzero(np.concatenate([[True], np.diff(named[order]) > 0]))
    rank = np.empty(m, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, m)))
    reach = 1
    while True:
        same = np.concatenate([[False], rank[order][1:] == rank[order][:-1]])
        at = np.flatnonzero(same | np.append(same[1:], False))
        if not len(at) or reach >= depth:
            return order
        sub = order[at]
        following = sub + reach
        key = rank[sub] * (m + 1) + np.where(following < m, rank[np.minimum(following, m - 1)] + 1, 0)
        again = np.argsort(key)
        sub, key = sub[again], key[again]
        order[at] = sub
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[sub] = np.maximum.accumulate(np.where(new, at, 0))
        reach *= 2


def sorted_lms(text: Text, bits: int) -> np.ndarray:
    """The LMS positions in the order of their suffixes."""
    disk, m = text.disk, len(text.lms)
    if m <= 1:
        return np.asarray(text.lms)
    named, different = names(text, bits)
    if different == m:
        order = disk.array(m, np.int64)
        order[named] = np.arange(m)
    else:
        # two LMS positions are two symbols apart at least
        depth = text.depth // 2 + 1
        if m * RANK <= disk.memory:
            order = _rank_in_memory(named, depth)
        else:
            order = _recurse(named, m, different, depth, disk)
    out = disk.array(m, np.int64)
    for k in range(0, m, disk.block):
        out[k : k + disk.block] = text.lms[order[k : k + disk.block]]
    return out


def _recurse(named: np.ndarray, m: int, different: int, depth: int, disk: Disk) -> np.ndarray:
    """The suffixes of the string of names, in order, by another level of induction."""
    disk.levels += 1
    symbols = disk.array(m + 1 + depth, np.int64)
    for k in range(0, m, disk.block):
        part = named[k : min(m, k + disk.block)]
        symbols[k : k + len(part)] = part + 1
    return _order(Text(symbols, m + 1, depth, disk), different)


class Ranges:
    """The priority queue of a level of many symbols: each queue holds a range of them, the open range is split by symbol."""

    def __init__(self, disk: Disk, symbols: int):
        self.shift = max(0, int(symbols).bit_length() - QUEUES.bit_length() + 1)
        self.spool = Spool(disk, (symbols >> self.shift) + 1, PAIR, disk.memory // 4)
        self.most = disk.block
        self.waiting: list[np.ndarray] = []
        self.count = 0
        self.open = -1
        self.fine: dict[int, list[np.ndarray]] = {}

    def push(self, symbol: np.ndarray, pos: np.ndarray) -> None:
        now = (symbol >> self.shift) == self.open
        if now.any():
            for s, p in zip(symbol[now].tolist(), pos[now], strict=True):
                self.fine.setdefault(s, []).append(p[None])
            symbol, pos = symbol[~now], pos[~now]
        if len(pos):
            made = np.empty(len(pos), PAIR)
            made["pos"], made["symbol"] = pos, symbol
            self.waiting.append(made)
            self.count += len(pos)
            if self.count > self.most:
                self.flush()

    def flush(self) -> None:
        if self.waiting:
            block = np.concatenate(self.waiting)
            queue = block["symbol"] >> self.shift
            order = np.argsort(queue, kind="stable")
            queue = queue[order]
            heads = np.flatnonzero(np.concatenate([[True], queue[1:] != queue[:-1]]))
            for part, q in zip(np.split(block[order], heads[1:]), queue[heads].tolist(), strict=True):
                self.spool.push(q, part)
        self.waiting, self.count = [], 0

    def pop(self, symbol: int) -> Iterator[np.ndarray]:
        """The positions of a symbol, also those that arrive while they are read."""
        if symbol >> self.shift != self.open:
            self.flush()
            self.open, self.fine = symbol >> self.shift, {}
            blocks = list(self.spool.pop(self.open))
            if blocks:
                block = np.concatenate(blocks)
                block = block[np.argsort(block["symbol"], kind="stable")]
                heads = np.flatnonzero(np.concatenate([[True], np.diff(block["symbol"]) > 0]))
                self.fine = {int(part["symbol"][0]): [part["pos"]] for part in np.split(block, heads[1:])}
        while symbol in self.fine:
            yield np.concatenate(self.fine.pop(symbol))


def _order(text: Text, symbols: int) -> np.ndarray:
    """The suffixes of a level of many symbols, in order, but for the sentinel."""
    disk, body = text.disk, text.body
    lms = sorted_lms(text, (symbols + 1).bit_length())
    starts, heads = np.zeros(symbols + 2, np.int64), np.zeros(symbols + 2, np.int64)
    for k in range(0, text.n, disk.block):
        starts[1:] += np.bincount(body[k : k + disk.block], minlength=symbols + 1)
    for k in range(0, len(lms), disk.block):
        heads[1:] += np.bincount(body[lms[k : k + disk.block]], minlength=symbols + 1)
    starts, heads = np.cumsum(starts) - 1, np.cumsum(heads)  # the sentinel has no place
    starts[0] = 0
    out = disk.array(text.n - 1, np.int64)
    ends = starts.copy()

    def feed(queue: Ranges, pos: np.ndarray, keep) -> None:
        pos = pos[pos > 0]
        x = np.asarray(body[pos - 1])
        go = keep(x)
        if go.any():
            queue.push(x[go], pos[go] - 1)

    queue = Ranges(disk, symbols)
    for s in range(symbols + 1):
        for pos in queue.pop(s):
            out[ends[s] : ends[s] + len(pos)] = pos
            ends[s] += len(pos)
            feed(queue, pos, lambda x: x >= s)  # noqa: B023
        for k in range(int(heads[s]), int(heads[s + 1]), disk.block):
            feed(queue, np.asarray(lms[k : min(k + disk.block, int(heads[s + 1]))]), lambda x: x > s)  # noqa: B023
    queue = Ranges(disk, symbols)
    for s in range(symbols, 0, -1):
        at = int(starts[s + 1])
        for pos in queue.pop(s):
            out[at - len(pos) : at] = pos[::-1]
            at -= len(pos)
            feed(queue, pos, lambda x: x <= s)  # noqa: B023
        for hi in range(int(ends[s]), int(starts[s]), -disk.block):
            feed(queue, np.asarray(out[max(hi - disk.block, int(starts[s])) : hi])[::-1], lambda x: x < s)  # noqa: B023
    return out


class Scan:
    """One direction of induction: sources in order, targets into the queues of their first symbols."""

    def __init__(self, text: Text, symbols: int, up: bool):
        self.text, self.up = text, up
        self.queue = Spool(text.disk, symbols + 1, TUPLE, text.disk.memory // 4)
        # least lcp among the sources since the last one that went to a symbol
        self.least = np.zeros(symbols + 1, np.uint8)

    def pop(self, symbol: int) -> Iterator[np.ndarray]:
        """The tuples of a symbol, also those that arrive while they are read."""
        while self.queue.any(symbol):
            yield from self.queue.pop(symbol)

    def feed(self, symbol: int, pos: np.ndarray, lcp: np.ndarray, same: bool) -> None:
        """Sources that begin with ``symbol``; lcp is with the source before. ``same``: they induce into their own bucket too."""
        x = self.text.body[pos - 1]
        if self.up:
            go = (x >= symbol) if same else (x > symbol)
        else:
            go = (x <= symbol) if same else (x < symbol)
        go &= pos > 0
        where = np.flatnonzero(go)
        low = lcp.min()
        if not len(where):
            np.minimum(self.least, low, out=self.least)
            return
        x = x[where]
        order = np.argsort(x, kind="stable")
        idx, x = where[order], x[order]
        first = np.concatenate([[True], x[1:] != x[:-1]])
        before = np.where(first, -1, np.concatenate([[-1], idx[:-1]]))
        padded = np.append(lcp, np.uint8(255))
        bounds = np.empty(2 * len(idx), np.int64)
        bounds[0::2], bounds[1::2] = before + 1, idx + 1
        got = np.minimum.reduceat(padded, bounds)[0::2]
        heads = np.flatnonzero(first)
        got[heads] = np.minimum(got[heads], self.least[x[heads]])
        new = np.minimum(got.astype(np.int64) + 1, self.text.depth).astype(np.uint8)
        np.minimum(self.least, low, out=self.least)
        ends = np.append(heads[1:], len(idx))
        made = tuples(pos[idx] - 1, new)
        # what comes after the last source of each symbol: minima of the tail
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        tail = np.append(tail, np.uint8(255))
        self.least[x[heads]] = tail[idx[ends - 1] + 1]
        for a, b, s in zip(heads.tolist(), ends.tolist(), x[heads].tolist(), strict=True):
            self.queue.push(s, made[a:b])


def _descending(text: Text, symbols: int, bits: int) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray]]]:
    """For each symbol from the largest to the least, its suffixes in ascending order as blocks of (pos, lcp).

    lcp is the common prefix with the suffix before, 0 for the first of a symbol.
    """
    disk, depth, run = text.disk, text.depth, text.run
    order = sorted_lms(text, bits)
    # where the LMS suffixes of each symbol begin in that order
    heads = np.zeros(symbols + 2, np.int64)
    for k in range(0, len(order), disk.block):
        heads[1:] += np.bincount(text.body[order[k : k + disk.block]], minlength=symbols + 1)
    heads = np.cumsum(heads)
    larger: dict[int, Column] = {}
    scan = Scan(text, symbols, up=True)
    for s in range(symbols + 1):
        column = None
        last = -1
        for block in scan.pop(s):
            pos, lcp = block["pos"], block["lcp"].copy()
            if column is None:
                column = larger[s] = Column(disk)
                lcp[0] = 0
            scan.feed(s, pos, lcp, same=True)
            column.append(tuples(pos, lcp))
            last = int(pos[-1])
        for k in range(int(heads[s]), int(heads[s + 1]), disk.block):
            pos = np.asarray(order[max(k - 1, 0) : min(k + disk.block, int(heads[s + 1]))])
            if k == 0:
                pos = np.concatenate([pos[:1], pos])
            lcp = common(text.symbols, pos[:-1], pos[1:], depth)
            pos = pos[1:]
            if k == heads[s]:
                lcp[0] = min(run[pos[0]], run[last]) if column is not None else 0
            scan.feed(s, pos, lcp, same=False)
    scan = Scan(text, symbols, up=False)
    for s in range(symbols, -1, -1):
        small = None
        last = -1
        for block in scan.pop(s):
            pos, lcp = block["pos"], block["lcp"].copy()
            if small is None:
                small = Column(disk)
                lcp[0] = 0
            scan.feed(s, pos, lcp, same=True)
            small.append(tuples(pos, lcp))
            last = int(pos[-1])
        column = larger.pop(s, None)
        big = column.view() if column is not None else np.zeros(0, TUPLE)
        border = min(run[int(big["pos"][-1])], run[last]) if len(big) and small is not None else 0
        for hi in range(len(big), 0, -disk.block):
            lo = max(0, hi - disk.block)
            pos = np.asarray(big["pos"][lo:hi])[::-1]
            lcp = np.append(big["lcp"][lo + 1 : hi + 1], [border] if hi == len(big) else []).astype(np.uint8)[::-1].copy()
            scan.feed(s, pos, lcp, same=False)
        if len(big) or small is not None:
            yield _ascending(big, small.view() if small is not None else np.zeros(0, TUPLE), border, disk.block)


def _ascending(big: np.ndarray, small: np.ndarray, border: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The larger-type suffixes of a symbol, which ascend, and the smaller-type ones, which descend, as ascending blocks."""
    for k in range(0, len(big), step):
        yield np.asarray(big["pos"][k : k + step]), np.asarray(big["lcp"][k : k + step])
    for hi in range(len(small), 0, -step):
        lo = max(0, hi - step)
        lcp = np.append(small["lcp"][lo + 1 : hi + 1], [border] if hi == len(small) else []).astype(np.uint8)
        yield np.asarray(small["pos"][lo:hi])[::-1], lcp[::-1]


def suffixes(text: np.ndarray, n: int, symbols: int, depth: int, disk: Disk) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The suffixes of text[:n], whose last symbol alone is 0 and which ``depth`` zeros follow, by first symbol from the largest.

    ``symbols`` is the largest symbol. Each symbol gives blocks of (pos, lcp) in ascending order.
    """
    yield from _descending(Text(text, n, depth, disk), symbols, (symbols + 1).bit_length())
