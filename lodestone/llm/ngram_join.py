"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word n-grams, hashed to 64 bits. Documents with one set make a class; only classes are
joined, so copies cost nothing more. For sets of similar size, Jaccard similarity of at least num/den bounds the
symmetric difference: (den - num) * (a + b) / (den + num). PartEnum splits the hash domain into n1 parts of n2 cells;
of the parts of two sets that differ in at most k elements, n1 - floor(k / (k2 + 1)) differ in at most k2, and there
some choice of n2 - k2 cells is equal in both. A signature is the hash of one such choice. Size bands grow by a
quarter; a set also signs for the next bands that a partner can lie in.

Choices without elements say nothing and give no signature. A set with more parts touched by these than the band has
parts to spare also signs the prefix of its elements for that band (the smallest hashes, one more than may be missing),
which any two similar sets share; thus no link is lost.

Links are found in three rounds, none of which makes the pairs of a group. (1) Each set meets the hub that it shares
most groups with, and the sets of a group of two meet. (2) Groups whose sets aren't in one component yet are searched in
blocks: parity sketches, as wide as the band's k asks for, bound the difference of two sets from below, and a block
gives no more pairs than its components would need to become one. All pairs are verified on whole sets with integer
arithmetic. (3) Blocks of which a pair has failed are searched once more with the whole sets themselves (of the rows that
sketches still let be linked), so what they give needs no verification. Groups of one hub mostly make one block. A block
holds LOT sets and LOT_BYTES of elements at most; a larger one is cut into lots, and each two lots make a block.

Nulls and empty texts have the empty set and are linked with nothing; each is its own class. Rows without an id take
part like others, but a component is named by a row that has one. Rows that repeat an id are joined by their texts; the
id's rows report the same way. Very long texts only make larger sets. Input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _components, _shared, _words

GROWTH = 1.25
#: Signatures that a task gathers before it sends them on.
FLUSH = 500_000
#: A task sorts the signatures of a bucket by ranges of these leading bits.
LEAD_BITS = 4
#: Hashes that a task remembers so as not to repeat itself; when they are as many, it forgets them.
REMEMBER = 500_000
#: Bits of a sketch for each element that two linked sets may differ in.
SKETCH_RATE = 16
#: Sets of one group, and bytes of their elements, that are compared with each other at once.
LOT, LOT_BYTES = 4096, 32 << 20
#: Sets that the groups of one hub may have in all to be searched together in any case.
FEW = 256
#: Classes that may be sent to all tasks.
HEAVY = 4096
#: Words of 64 bits that tell all tasks which rows' texts have to be moved.
WORDS = 1 << 17
_U = np.uint64


class Bands:
    """Size bands and the partitioning of the hash domain in each."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        self.num, self.den = num, den
        ends, top = [], 1
        while top < most:
            top = max(top + 1, int(top * GROWTH))
            ends.append(top)
        self.ends = np.array(ends)
        rows = []
        for top in ends:
            k = (den - num) * 2 * top // (den + num)
            if k <= 3:
                rows.append((k, 1, k, k + 2, 0))
            elif k <= 11 or 4 * num < 3 * den:
                spare = 0 if k <= 11 else max(1, (k // 3 + 1) // 12)
                rows.append((k, k // 3 + 1 + spare, 2, 4, spare))
            else:
                spare = max(1, (k // 2 + 1) // 12)
                rows.append((k, k // 2 + 1 + spare, 1, 3, spare))
        self.k, self.n1, self.k2, self.n2, self.spare = np.array(rows).T

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, size)


def shingles(block: _words.Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct n-gram, sorted by both; a shorter text is one gram as a whole."""
    at, value = block.grams(n)
    doc = block.doc[at]
    count = np.bincount(block.doc, minlength=block.n_docs)
    for m in range(1, n):
        first, whole = block.grams(m)
        alone = count[block.doc[first]] == m
        doc, value = np.concatenate((doc, block.doc[first[alone]])), np.concatenate(
            (value, _words.mix(whole[alone] + _U(m)))
        )
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _sum(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of hashes per group: of halves, as those are exact in doubles."""
    low = np.bincount(group, weights=(value & _U(0xFFFFFFFF)).astype(np.float64), minlength=n).astype(_U)
    high = np.bincount(group, weights=(value >> _U(32)).astype(np.float64), minlength=n).astype(_U)
    return low + (high << _U(32))


def sets(block: _words.Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: set size and class (a hash of the set), and the documents and hashes of all elements."""
    doc, value = shingles(block, n)
    size = np.bincount(doc, minlength=block.n_docs)
    node = _words.mix(
        _sum(
            doc, _words.mix(value ^ _U(0x5851F42D4C957F2D)), block.n_docs
        ) + _words.mix(_sum(doc, value, block.n_docs)) + size.astype(_U)
    )
    return size, node, doc, value


def sketch_bits(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Width of the sketches of sets of these sizes: a power of two, SKETCH_RATE times the difference allowed."""
    k = np.maximum(1, (den - num) * 2 * size // (den + num))
    return np.maximum(64, 1 << np.ceil(np.log2(SKETCH_RATE * k)).astype(np.int64))


def sketches(width: np.ndarray, doc: np.ndarray, value: np.ndarray) -> list[bytes]:
    """For each document parities: how many elements each bit has, modulo 2. A half width is the sum of both halves."""
    first = np.concatenate(([0], np.cumsum(width)))
    bit = (_words.mix(value ^ _U(0x8EBC6AF09C88C6E3)) & (width[doc] - 1).astype(_U)).astype(np.int64) + first[doc]
    # the bits that an odd number of elements has; a table of counts would be many times larger than the elements
    bit, count = np.unique(bit, return_counts=True)
    bit = bit[count & 1 == 1]
    out = np.zeros(int(first[-1]) // 8, np.uint8)
    np.bitwise_or.at(out, bit >> 3, (128 >> (bit & 7)).astype(np.uint8))
    return [out[a:b].tobytes() for a, b in zip(first[:-1] // 8, first[1:] // 8, strict=True)]


def signatures(bands: Bands, size: np.ndarray, doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and signature; the elements are sorted by document and hash."""
    docs, signs = [], []
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    length = size - (-(-size * bands.num // bands.den)) + 1
    early = np.arange(len(doc)) - first[doc] < length[doc]
    own, top = bands.of(size), bands.of(size * bands.den // bands.num)
    x = _words.mix(value + _U(0x2545F4914F6CDD1D))
    for ahead in range(int((top - own).max(initial=0)) + 1):
        band = own + ahead
        live = (size > 0) & (band <= top) & (bands.k[np.minimum(band, len(bands.k) - 1)] > 0)
        for n2, k2 in {(int(bands.n2[b]), int(bands.k2[b])) for b in np.unique(band[live])}:
            chosen = np.flatnonzero(live & (bands.n2[band] == n2) & (bands.k2[band] == k2))
            n1 = bands.n1[band[chosen]]
            base = np.concatenate(([0], np.cumsum(n1)))
            slot = np.full(len(size), -1)
            slot[chosen] = np.arange(len(chosen))
            at = slot[doc]
            use = at >= 0
            at, h, v = at[use], x[use], value[use]
            part = base[at] + ((h >> _U(32)) % n1[at].astype(_U)).astype(np.int64)
            cell = part * n2 + ((h & _U(0xFFFFFFFF)) % _U(n2)).astype(np.int64)
            n = int(base[-1])
            held = np.bincount(cell, minlength=n * n2).reshape(n, n2)
            total = _sum(cell, _words.mix(v), n * n2).reshape(n, n2)
            owner = np.repeat(np.arange(len(chosen)), n1)
            place = _words.mix((band[chosen][owner].astype(_U) << _U(40)) + (np.arange(n) - base[owner]).astype(_U))
            bare = np.zeros(n, bool)
            for i, cells in enumerate(combinations(range(n2), n2 - k2)):
                s, c = np.zeros(n, _U), np.zeros(n, np.int64)
                for j in cells:
                    s, c = s + total[:, j], c + held[:, j]
                full = c > 0
                bare |= ~full
                signs.append(_words.mix(s + _words.mix(place + _U(i)))[full])
                docs.append(chosen[owner[full]])
            hard = np.zeros(len(size), bool)
            hard[chosen] = np.bincount(owner[bare], minlength=len(chosen)) > bands.spare[band[chosen]]
            use = hard[doc] & early
            docs.append(doc[use])
            signs.append(_words.mix(_words.mix(value[use] ^ _U(0xA0761D6478BD642F)) + band[doc[use]].astype(_U)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(docs), np.concatenate(signs)


def _parsed(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, _words.Block]]:
    for first, end, data, offsets in _shared.blocks(batch.column(column)):
        yield first, end, _words.parse(data, offsets, lower=True)


def _fresh(found: np.ndarray, seen: set[int]) -> np.ndarray:
    """Marks of those that weren't seen before; they are from now on, as long as `seen` is small."""
    new = np.zeros(len(found), bool)
    if len(seen) + len(found) > REMEMBER:
        seen.clear()
    for i, x in enumerate(found.tolist()):
        if x not in seen:
            seen.add(x)
            new[i] = True
    return new


def _signed(bands: Bands, n: int, keys: list[int]):
    """Signatures of the distinct sets of a task's documents, one row for each bucket: runs of 5 signature bytes."""

    def pack(signs: list, nodes: list) -> pa.RecordBatch:
        sign, node = np.concatenate(signs), np.concatenate(nodes)
        bucket = (sign >> _U(40)) % _U(len(keys))
        order = np.lexsort((node, bucket))
        sign, node, bucket = sign[order], node[order], bucket[order]
        cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
        rows: dict[str, list] = {"bucket": [], "nodes": [], "counts": [], "signs": []}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, count = np.unique(node[a:b], return_counts=True)
            rows["bucket"].append(keys[int(bucket[a])])
            rows["nodes"].append(own.tobytes())
            rows["counts"].append(count.astype(np.uint16 if count.max() < 65536 else np.uint32).tobytes())
            rows["signs"].append(sign[a:b].view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
        binary = [pa.array(rows[c], pa.binary()) for c in ("nodes", "counts", "signs")]
        return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *binary], list(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        signs, nodes, held = [], [], 0
        for batch in batches:
            for _, _, block in _parsed(batch, 0):
                size, node, doc, value = sets(block, n)
                new = _fresh(node, seen)
                use = new[doc]
                d, s = signatures(bands, np.where(new, size, 0), doc[use], value[use])
                signs.append(s)
                nodes.append(node[d])
                held += len(s)
                if held >= FLUSH:
                    yield pack(signs, nodes)
                    signs, nodes, held = [], [], 0
        if held:
            yield pack(signs, nodes)

    return run


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each signature with two sets or more: the group's hash, its members, its size and its first member."""
    by: dict[tuple[int, int], list] = {}
    for batch in batches:
        for bucket, nodes, counts, signs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(nodes, _U)
            count = np.frombuffer(counts, np.uint16 if len(counts) == 2 * len(own) else np.uint32)
            wide = np.zeros((int(count.sum()), 8), np.uint8)
            wide[:, :5] = np.frombuffer(signs, np.uint8).reshape(-1, 5)
            sign, node = wide.reshape(-1).view(_U), np.repeat(own, count)
            # signatures of a few leading bits each are sorted at once
            lead = (sign >> _U(40 - LEAD_BITS)).astype(np.uint8)
            order = np.argsort(lead, kind="stable")
            cuts = np.searchsorted(lead[order], np.arange((1 << LEAD_BITS) + 1))
            for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if a < b:
                    by.setdefault((bucket, k), []).append((sign[order[a:b]], node[order[a:b]]))
    known: set[int] = set()
    for key in list(by):
        sign, node = (np.concatenate(x) for x in zip(*by.pop(key), strict=True))
        order = np.lexsort((node, sign))
        sign, node = sign[order], node[order]
        new = np.ones(len(sign), bool)
        new[1:] = (sign[1:] != sign[:-1]) | (node[1:] != node[:-1])
        sign, node = sign[new], node[new]
        start = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1]))) if len(sign) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate((start, [len(sign)])))
        start, n = start[n > 1], n[n > 1]
        if not len(start):
            continue
        member = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        group = np.repeat(np.arange(len(n)), n)
        name = _words.mix(_sum(group, _words.mix(node[member]), len(n)) + n.astype(_U))
        keep = _fresh(name, known)[group]
        group, member = group[keep], member[keep]
        hub = node[start]
        for a in range(0, len(group), 100_000):
            b = slice(a, a + 100_000)
            longs = [x.view(np.int64) for x in (name[group[b]], node[member[b]], n[group[b]], hub[group[b]])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in longs], ["grp", "node", "n", "hub"])


class _Block:
    """Sets of one group, by size, and which of them may still be linked."""

    def __init__(self, rows: pa.Table, num: int, den: int):
        size = rows.column("n_shingles").to_numpy()
        order = np.argsort(size, kind="stable")
        self.num, self.den, self.size = num, den, size[order]
        self.node = rows.column("node").to_numpy()[order]
        self.comp = np.unique(rows.column("root").to_numpy()[order], return_inverse=True)[1]
        blobs = rows.column("sketch").to_pylist()
        blobs = [blobs[i] for i in order]
        # runs of rows whose sketches are equally wide, and these as words
        width = np.array([len(b) // 8 for b in blobs])
        cuts = np.concatenate(([0], np.flatnonzero(width[1:] != width[:-1]) + 1, [len(width)]))
        self.runs = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.runs.append((a, b, np.frombuffer(b"".join(blobs[a:b]), _U).reshape(b - a, -1)))
        self.run_of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))

    def apart(self, i: int, at: np.ndarray) -> np.ndarray:
        """Lower bounds of the differences of set i and the sets `at` (ascending)."""
        out = np.zeros(len(at), np.int64)
        a, _, words = self.runs[self.run_of[i]]
        own = words[i - a]
        for first, end, other in self.runs:
            lo, hi = np.searchsorted(at, (first, end))
            if lo < hi:
                x, y = own, other[at[lo:hi] - first]
                while len(x) > y.shape[1]:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while y.shape[1] > len(x):
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                out[lo:hi] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out

    def near(self) -> np.ndarray:
        """Nodes that sizes and sketches let be linked with one of another component."""
        num, den, size = self.num, self.den, self.size
        found = np.zeros(len(size), bool)
        for i in range(len(size)):
            # a pair is seen from its smaller set
            b = int(np.searchsorted(size, size[i] * den // num, side="right"))
            at = i + 1 + np.flatnonzero(self.comp[i + 1 : b] != self.comp[i])
            good = at[self.apart(i, at) <= (den - num) * (size[at] + size[i]) // (den + num)] if len(at) else at
            found[good] = True
            found[i] |= len(good) > 0
        return self.node[found]

    def forest(self, linked=None) -> list[tuple[int, int]]:
        """Pairs that make of the components those that all pairs not ruled out would make.

        Each row is compared with the rows of components that aren't reached yet, and reaches those not ruled out; so a
        component gives one pair less than it has components before. `linked`, if given, says of the rest which are
        links indeed.
        """
        num, den, size = self.num, self.den, self.size
        n_comps = int(self.comp.max()) + 1
        members = np.argsort(self.comp, kind="stable")
        first = np.searchsorted(self.comp[members], np.arange(n_comps + 1))
        reached = np.zeros(n_comps, bool)
        found = []
        # components by their least node, so that blocks of one family tend to give the same pairs
        least = np.full(n_comps, np.iinfo(np.int64).max)
        np.minimum.at(least, self.comp, self.node)
        for start in np.argsort(least, kind="stable").tolist():
            if reached[start]:
                continue
            reached[start] = True
            queue = members[first[start] : first[start + 1]].tolist()
            while queue:
                i = queue.pop()
                # partners' sizes lie within the similarity's ratio
                a = int(np.searchsorted(size, -(-size[i] * num // den)))
                b = int(np.searchsorted(size, size[i] * den // num, side="right"))
                at = a + np.flatnonzero(~reached[self.comp[a:b]])
                if not len(at):
                    continue
                apart = self.apart(i, at)
                good = apart <= (den - num) * (size[at] + size[i]) // (den + num)
                at, apart = at[good], apart[good]
                if linked is not None:
                    good = linked(i, at)
                    at, apart = at[good], apart[good]
                for k in np.argsort(apart, kind="stable").tolist():
                    c = int(self.comp[at[k]])
                    if not reached[c]:
                        reached[c] = True
                        found.append((int(self.node[i]), int(self.node[at[k]])))
                        queue += members[first[c] : first[c + 1]].tolist()
        return found


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key (the first column), which follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(int(a), int(b - a))
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def _searched(num: int, den: int, exact: bool):
    """Pairs (key, a, b) of the blocks (key, node, root, n_shingles, sketch and, if exact, elements)."""

    def search(rows: pa.Table) -> list[tuple[int, int]]:
        block = _Block(rows, num, den)
        if not exact:
            return block.forest()
        order = np.argsort(rows.column("n_shingles").to_numpy(), kind="stable")
        blobs = rows.column("elements")
        held = [np.frombuffer(blobs[int(i)].as_buffer(), _U) for i in order]

        def linked(i: int, at: np.ndarray) -> np.ndarray:
            both = np.array([_common(held[i], held[j]) for j in at.tolist()], np.int64)
            return den * both >= num * (block.size[at] + block.size[i] - both)

        return block.forest(linked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, right = [], [], []
        for rows in _by_key(batches):
            pairs = search(rows)
            key += [rows.column(0)[0].as_py()] * len(pairs)
            left += [a for a, _ in pairs]
            right += [b for _, b in pairs]
            if len(key) >= 50_000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (key, left, right)], ["key", "a", "b"]
                )
                key, left, right = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, left, right)], ["key", "a", "b"])

    return run


def _near(num: int, den: int):
    """Of the blocks (key, node, root, n_shingles, sketch) the rows that may be linked with one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            node = _Block(rows, num, den).near()
            key = np.full(len(node), rows.column(0)[0].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], ["key", "node"])

    return run


def _refuted(num: int, den: int):
    """Of pairs (a, b, sizes, sketches) those that sizes and sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            s, t = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            good = np.zeros(batch.num_rows, bool)
            for i, (p, q, x, y) in enumerate(zip(m, n, s, t, strict=True)):
                if den * min(p, q) >= num * max(p, q):
                    x, y = int.from_bytes(x, "little"), int.from_bytes(y, "little")
                    wide, narrow = 8 * len(s[i]), 8 * len(t[i])
                    while wide != narrow:
                        if wide > narrow:
                            wide //= 2
                            x = (x >> wide) ^ (x & ((1 << wide) - 1))
                        else:
                            narrow //= 2
                            y = (y >> narrow) ^ (y & ((1 << narrow) - 1))
                    good[i] = (x ^ y).bit_count() <= (den - num) * (p + q) // (den + num)
            yield batch.filter(pa.array(good)).select([0, 1])

    return run


def _linked(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), _U) for c in (left, right))
                both = _common(x, y)
                good[i] = den * both >= num * (len(x) + len(y) - both)
            yield batch.filter(pa.array(good)).select([0, 1])

    return run


class _Join:
    """The tables of one join; all but rows and roots are deleted at its end."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, text_col: str, id_col: str):
        self.spark, self.n, self.num, self.den = docs.sparkSession, n, num, den
        self.scratch = _shared.Scratch(self.spark)
        self.parts = _shared.n_partitions(self.spark)
        self.texts = docs.select(F.col(id_col).alias("_id"), _shared.text_or_empty(text_col).alias("_text"))
        self.known: DataFrame | None = None

    def measure(self) -> DataFrame:
        """_id, n_shingles, node and, once in a task for each node, the sketch."""
        n, num, den = self.n, self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                sizes, nodes, marks = [np.zeros(0, np.int64)], [np.zeros(0, _U)], []
                for _, _, block in _parsed(batch, 1):
                    size, node, doc, value = sets(block, n)
                    new = _fresh(node, seen) & (size > 0)
                    width, use = np.where(new, sketch_bits(size, num, den), 0), new[doc]
                    found = sketches(width, doc[use], value[use])
                    marks += [x if f else None for x, f in zip(found, new.tolist(), strict=True)]
                    sizes.append(size)
                    nodes.append(node)
                size, node = np.concatenate(sizes), np.concatenate(nodes).view(np.int64)
                columns = [batch.column(0), pa.array(size), pa.array(node), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n_shingles", "node", "sketch"])

        schema = self.texts.select("_id").schema.add("n_shingles", "long").add("node", "long").add("sketch", "binary")
        return _shared.staged(self.texts.mapInArrow(run, schema), "join-rows")

    def groups(self) -> DataFrame:
        """grp, node, n and hub: the members of each set of nodes that share a signature."""
        keys = _shared.spread_keys(self.spark, self.parts)
        signed = self.texts.select("_text").mapInArrow(
            _signed(Bands(self.num, self.den), self.n, keys), "bucket int, nodes binary, counts binary, signs binary"
        )
        found = signed.repartition(self.parts, "bucket").mapInArrow(_matched, "grp long, node long, n long, hub long")
        return self.scratch.stage(found.dropDuplicates(["grp", "node"]), "join-groups")

    def marks(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """node, n_shingles, sketch and an _id for each node of the groups; copies are merged before they are moved."""
        once = rows.where("n_shingles > 0").groupBy("node").agg(
            F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"), F.min("_id").alias("_id")
        )
        return self.scratch.stage(once.join(groups.select("node").distinct(), "node", "left_semi"), "join-marks")

    def sets_of(self, nodes: DataFrame, marks: DataFrame) -> DataFrame:
        """node and elements of these nodes, from the text of one row each; what was read before isn't read again."""
        n = self.n
        want = nodes if self.known is None else nodes.join(self.known.select("node"), "node", "left_anti")
        owners = self.scratch.stage(
            marks.select("node", "_id").join(want, "node", "left_semi"), "join-owners", short=True
        )

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                want = batch.column(1).to_numpy(zero_copy_only=False) if batch.num_columns > 1 else None
                found, blobs = [], []
                for first, end, block in _parsed(batch, 0):
                    size, node, _, value = sets(block, n)
                    cut = np.concatenate(([0], np.cumsum(size)))
                    mine = _fresh(node, seen) if want is None else node.view(np.int64) == want[first:end]
                    for i in np.flatnonzero(mine & (size > 0)):
                        found.append(int(node[i : i + 1].view(np.int64)[0]))
                        blobs.append(value[cut[i] : cut[i + 1]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int64()), pa.array(blobs, pa.binary())], ["node", "elements"]
                )

        schema = "node long, elements binary"
        # the filter is always true; it lets the planner put a Bloom filter of the owners before the texts are moved
        named = owners.where("_id IS NOT NULL").where(F.col("node") >= F.lit(-(1 << 63)))
        found = self.texts.join(named, "_id").select("_text", "node").mapInArrow(gather, schema)
        if not owners.where("_id IS NULL").isEmpty():
            # nodes that only rows without an id have: the sets of all such rows, and of these the wanted ones
            nameless = self.texts.where("_id IS NULL").select("_text").mapInArrow(gather, schema)
            found = found.union(nameless.join(owners.where("_id IS NULL").select("node"), "node", "left_semi"))
        found = self.scratch.stage(found.dropDuplicates(["node"]), "join-sets")
        self.known = found if self.known is None else self.known.union(found)
        return self.known

    def verified(self, pairs: DataFrame, marks: DataFrame) -> DataFrame:
        """Those of the (staged) pairs (a, b) that are links, by whole sets."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        held = self.sets_of(ends, marks)
        first, second = (held.select(F.col("node").alias(c), F.col("elements").alias(f"e{c}")) for c in "ab")
        both = pairs.join(second, "b").join(first, "a").select("a", "b", "ea", "eb")
        return self.scratch.stage(both.mapInArrow(_linked(self.num, self.den), "a long, b long"), "join-links")

    def stars(self, groups: DataFrame, marks: DataFrame) -> DataFrame:
        """The pair of each group of two, and each set with the hub that most of its other groups have."""
        two = groups.where("n = 2 AND node <> hub").select("hub", "node")
        near = groups.where("n > 2").groupBy("node", "hub").count()
        near = near.groupBy("node").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub")).where("node <> hub")
        pairs = two.union(near.select("hub", "node")).select(
            F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")
        ).distinct()
        small = marks.select("node", "n_shingles", "sketch")
        for c in "ba":
            pairs = pairs.join(small.toDF(c, f"n{c}", f"s{c}"), c)
        kept = pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_refuted(self.num, self.den), "a long, b long")
        return self.scratch.stage(kept, "join-stars")

    def blocks(self, groups: DataFrame, roots: DataFrame, marks: DataFrame) -> DataFrame:
        """key, node, root and n_shingles of the groups that aren't in one component, cut into lots of bounded size.

        Groups of one hub mostly have the same sets. Where their union costs no more comparisons than they do one by one
        (or few), it stands in for them: all their pairs are in it, and each set is moved once for a hub.
        """
        sizes = marks.select("node", "n_shingles")
        rows = groups.where("n > 2").join(sizes, "node").join(roots, "node", "left")
        rows = rows.withColumn("root", F.coalesce("root", "node"))
        open_ = rows.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        rows = self.scratch.stage(rows.join(open_.select("grp"), "grp"), "join-open", short=True)

        # a group's rows have its size each, so these add up to the squares of the sizes
        met = rows.groupBy("hub", "node", "root", "n_shingles").agg(F.sum("n").alias("n"))
        hubs = met.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("cost"))
        united = hubs.select("hub", ((F.col("m") * F.col("m") <= F.col("cost")) | (F.col("m") <= FEW)).alias("united"))
        own = ["node", "root", "n_shingles"]
        one = met.join(united.where("united"), "hub").select(F.col("hub").alias("grp"), *own)
        rows = one.union(rows.join(united.where("NOT united"), "hub").select("grp", *own))

        n, held = F.count(F.lit(1)), F.sum("n_shingles")
        lots = F.greatest(F.ceil(n / LOT), F.ceil(held * 8 / LOT_BYTES)).cast("int").alias("lots")
        rows = rows.join(rows.groupBy("grp").agg(lots), "grp").withColumn(
            "mine", F.pmod(F.xxhash64("node"), "lots").cast("int")
        )
        # a lot meets each other lot; an only lot meets itself
        others = F.filter(
            F.sequence(F.lit(0), F.col("lots") - 1), lambda x: (x != F.col("mine")) | (F.col("lots") == 1)
        )
        rows = rows.withColumn("other", F.explode(others))
        key = F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other")).alias("key")
        return rows.select(key, "node", "root", "n_shingles")

    def laid(self, blocks: DataFrame, marks: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """The blocks with sketches and, if given, sets; the rows of a key follow each other in a task."""
        # sketches and sets join last, so that all before moves short rows
        laid = blocks.join(marks.select("node", "sketch"), "node")
        if held is not None:
            laid = laid.join(held, "node")
        return laid.select(
            "key", *[c for c in laid.columns if c != "key"]
        ).repartition(self.parts, "key").sortWithinPartitions("key")

    def search(self, blocks: DataFrame, marks: DataFrame, held: DataFrame | None = None) -> DataFrame:
        exact = _searched(self.num, self.den, held is not None)
        return self.laid(blocks, marks, held).mapInArrow(exact, "key long, a long, b long")

    def near(self, blocks: DataFrame, marks: DataFrame) -> DataFrame:
        """Those rows of the blocks that may be linked with one of another component."""
        near = self.scratch.stage(
            self.laid(blocks, marks).mapInArrow(_near(self.num, self.den), "key long, node long"), "join-near", short=True
        )
        return self.scratch.stage(blocks.join(near, ["key", "node"], "left_semi"), "join-left", short=True)


def join_classes(
    docs: DataFrame, *, n: int, num: int, den: int, text_col: str = "text", id_col: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """(rows: _id, n_shingles, node, sketch), and (node, root) of the classes that are linked with another."""
    _shared.tune(docs.sparkSession)
    join = _Join(docs, n, num, den, text_col, id_col)
    rows, groups = join.measure(), join.groups()
    marks = join.marks(rows, groups)
    roots = _components.components(join.verified(join.stars(groups, marks), marks), "a", "b")

    blocks = join.scratch.stage(join.blocks(groups, roots, marks), "join-blocks")
    given = join.scratch.stage(join.search(blocks, marks), "join-given")
    pairs = join.scratch.stage(
        given.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-pairs", short=True
    )
    if not pairs.isEmpty():
        links = join.verified(pairs, marks)
        roots = _components.joined(roots, links, "a", "b")
        failed = join.scratch.stage(pairs.join(links, ["a", "b"], "left_anti"), "join-failed", short=True)
        if not failed.isEmpty():
            keys = given.select(
                "key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
            ).join(failed, ["a", "b"], "left_semi")
            again = blocks.drop("root").join(
                keys.select("key").distinct(), "key", "left_semi"
            ).join(roots, "node", "left")
            again = join.scratch.stage(again.withColumn("root", F.coalesce("root", "node")), "join-again", short=True)
            # whole sets are long, so only those are moved that can still be linked
            again = join.near(again, marks)
            held = join.sets_of(again.select("node").distinct(), marks)
            more = join.scratch.stage(join.search(again, marks, held).select("a", "b").distinct(), "join-more")
            if not more.isEmpty():
                roots = _components.joined(roots, more, "a", "b")
    join.scratch.clear()
    return rows, roots


def ngram_join(
    docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every document."""
    rows, roots = join_classes(docs, n=n, num=num, den=den, text_col=text_col, id_col=id_col)
    rows = rows.drop("sketch")
    classes = rows.where("n_shingles > 0").groupBy("node").agg(
        F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = _shared.staged(
        classes.join(least, "root").select("node", "copies", "component_id"), "join-classes", short=True
    )
    # classes of more than 1 / HEAVY of all rows are at most HEAVY, so they may be sent to the rows; the others' rows move
    often = max(1000, rows.count() // HEAVY)
    heavy = F.broadcast(named.where(F.col("copies") > often).select("node", "component_id"))
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("_id"))
    filled = rows.where("n_shingles > 0")
    light = filled.join(heavy.select("node"), "node", "left_anti").join(
        named.where(F.col("copies") <= often).select("node", "component_id"), "node"
    )
    parts = [
        x.select(
            F.col("_id").alias(id_col), "n_shingles", "component_id"
        ) for x in (filled.join(heavy, "node"), light, alone)
    ]
    return parts[0].union(parts[1]).union(parts[2])


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The documents without near copies, by row and not by id: of each component the row with the smallest id stays.

    Rows without an id come last, and equal ids are told apart by their texts. Of rows that repeat both id and text one
    stays; texts without words are like no other, so without an id they all stay. Any extra columns are kept.
    """
    row = F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.col("doc_id").alias("id"),
        F.xxhash64(_shared.text_or_empty()).alias("hash"),
    )
    inner = docs.select(F.struct(*docs.columns).alias("doc"), row.alias("row"), _shared.text_or_empty().alias("words"))
    found = _shared.staged(ngram_join(inner, id_col="row", text_col="words", **options), "join-result", short=True)
    gone = _shared.staged(found.where("row <> component_id").select("row").distinct(), "join-gone", short=True)
    again = found.where("n_shingles > 0 OR NOT row.none").groupBy("row").count().where("count > 1").select("row")
    again = _shared.staged(again.join(gone, "row", "left_anti"), "join-again", short=True)
    sure, named = _split(inner, gone.union(again))
    kept = named.join(gone, "row", "left_anti")
    if again.isEmpty():
        return sure.select("doc.*").union(kept.select("doc.*"))
    once = kept.join(again, "row", "left_semi").dropDuplicates(["row", "words"])
    rest = kept.join(again, "row", "left_anti")
    return sure.select("doc.*").union(rest.select("doc.*")).union(once.select("doc.*"))


def _split(inner: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of `inner` that are none of the rows, found without moving any, and the others.

    A table of WORDS words at most has a bit set for each of the rows; where a row's bit isn't set, it is none of them.
    The others are all of the rows and a few that share a bit with one (the more, the fuller the table).
    """
    place = F.pmod(F.xxhash64("row"), F.lit(64 * WORDS))
    word, bit = F.floor(place / 64).cast("int"), F.pmod(place, F.lit(64)).cast("int")
    bits = rows.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(
        F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits")
    )
    told = inner.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word", "left")
    told = told.withColumn("_named", F.expr("coalesce(shiftright(_bits, _bit) & 1L, 0L) = 1L"))
    return told.where("NOT _named").select(inner.columns), told.where("_named").select(inner.columns)
