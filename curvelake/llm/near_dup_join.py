"""N-gram Jaccard self-join by PartEnum signatures, and the groups that its links join.

A document's set is the 64-bit hashes of its distinct five-word shingles (fewer words: the whole sequence as one; none: empty). Documents link
when 4 * intersection >= 3 * union. The join is exact up to collisions of 64-bit hashes.

Method. Sizes are cut into overlapping classes such that both sizes of any pair that can link lie in one class [s, t]. In a class the feature domain (the range of hashes)
is partitioned into n1 first-level partitions of three second-level ranges each (n2 = 3), and of each first-level partition the subsets of two ranges are enumerated (k2 = 1): a signature is
the digest of a set's features in one such subset that is not empty. Sets of sizes a and b that link differ in at most d = floor((a + b) / 7) features. The first difference in a first-level
partition spoils at most two of its three signatures, a second one the third, so d differences spoil at most min(2 d, d + n1) signatures, and a set with more than those shares
the others ("slack") with every partner. Sets without slack ("weak") and those that lose it to hot signatures ("unsafe") are joined with each other by a prefix filter instead: by their
rarest features, as many as two linked sets cannot all miss. All sets list their features in one order, so a pair's first shared feature also bounds what they share: no more than what
either has from there on. A pair for which that is too little is not compared; a passage that many documents share so makes pairs of those only in which little else stands.

Which signatures travel. All sets list their signatures in one order (of the hash range), and those that a pair shares are at least the slack, so each set can leave the last of them
away and still share as many of the first: it sends those that can be spoilt and `sent(n)` more. A pair then shares at least `need` of them: the smaller of the slack and of sent() for the
smallest size that can link.

Counting. Pairs are counted over all buckets, and those that share fewer signatures than they need to are dropped before any set is read; this loses nothing. (Two of
a set's signatures can agree in the bytes that travel, and then count once; need is lowered by more than the number of those.) Pairs that are left are tested by
parity bitmaps: a bit is the parity of the features that fall on it, so two bitmaps differ in no more bits than the sets differ in features. A bitmap has two to
four bits a feature, and a larger one folds to the size of a smaller one. Only pairs that pass are compared by their sets.

Hot signatures. Equal sets are made one before they are compared. A signature of up to SMALL sets gives all pairs whose sizes allow a link. A larger one gives pairs of its
members with its smallest one where a 16-bit sketch says that they are alike: these only join groups early. Once groups are known, a
signature whose members are all of one group needs nothing more; if few members (CROSS at most) are outside its largest group, all pairs of
members of different groups are compared; else it is hot, and each member's slack falls by one. So nothing is dropped, and pairs within a group of near copies are never listed.

Signatures travel as packed blobs, one for each bucket and flush of a task (a fixed number of records), not as rows; in a flush, a signature with more than
SMALL members is already made one record. Buckets follow the size of the corpus, so a bucket's arrays are bounded; a record never needs more than its own bytes and one entry's (ENTRY), however many buckets there are.
Intermediate tables are deleted when they have been used.

Cases: null and empty texts have empty sets, link with nothing and are their own component. Repeated rows with one id are returned each; a row with a null id
takes the component of its copies, or none. Texts of any length are read whole. Extra columns are not read (`kept` passes them through). An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, Words, cut, mix, reclaim, released, slices, spread_join, text_or_empty

WIDTH = 5
SMALL, CROSS = 8, 8
#: Members that are paired with one leader, about.
LED = 1024
#: Signatures in a bucket, about; records in a flush, at most; documents in a flush, at most.
BUCKET, FLUSH, FLUSH_DOCS = 2_000_000, 1_500_000, 30_000
#: Bytes of text that are worked on at once.
SLICE = 1 << 20
#: Sizes of a class, from largest to smallest; first-level partitions for each that two differences in each would take.
STRETCH, MARGIN = 3.0, 1.3
#: Bytes of a signature that travel, besides its bucket.
KEY = 5
#: Up to so many ids a candidates' table is broadcast (8 bytes each); beyond, texts are shuffled to their ids.
BROADCAST_IDS = 2_000_000
#: Tasks over which the rows of one key are spread in joins with a table that has few rows a key.
SALTS = 16
#: The same where both sides can have many rows.
SPREAD = 6

RESULT = "kind string, a long, b long, sig long, cls int, slack int, n long, digest binary"
_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PLACE = np.random.Generator(np.random.PCG64(6)).integers(1, 1 << 62, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def classes() -> tuple[tuple[int, int, int], ...]:
    """(s, t, n1) of each class: sizes s..t, n1 first-level partitions."""
    out, s = [], 1
    while s < 1 << 32:
        t = max(int(STRETCH * s), s + 3)
        out.append((s, t, int(MARGIN * (2 * t // 7 + 1) / 2) + 2))
        s = (3 * t + 2) // 4 + 1  # the smallest for which sizes below it have all their partners up to t
        while 4 * (s - 1) // 3 > t:
            s -= 1
    return tuple(out)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct shingles' hashes, by text and ascending, and where each text's begin (one more than texts)."""
    w = Words([x.translate(_ASCII_LOWER) for x in texts])
    n = len(w.hash)
    if n >= width:
        full = np.flatnonzero(w.text[width - 1 :] == w.text[: n - width + 1])
        h = np.zeros(len(full), np.uint64)
        for j in range(width):
            h += w.hash[full + j] * _PLACE[j]
        h, t = mix(h), w.text[full]
    else:
        h, t = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = w.count[short] > j
            extra[has] += w.hash[w.first[short[has]] + j] * _PLACE[j]
        h, t = np.concatenate([h, mix(extra + w.count[short].astype(np.uint64))]), np.concatenate([t, short])
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[first], t[first]
    return h, np.searchsorted(t, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values from each start to the next; starts ascend strictly and end before len(values)."""
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def sent(n):
    """How many signatures beyond those that can be spoilt a set of size n sends, where it has as many."""
    return 3 + n // 12


def bitmaps(mixed: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """Each set's parity bitmap, of 64 bits or the power of two from twice its size."""
    size = np.diff(begins)
    bits = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(2 * size, 1)))).astype(np.int64)
    offset = np.append(0, np.cumsum(bits))
    at = (mixed & np.repeat((bits - 1).astype(np.uint64), size)).astype(np.int64) + np.repeat(offset[:-1], size)
    packed = np.packbits((np.bincount(at, minlength=offset[-1]) & 1).astype(np.uint8), bitorder="little")
    return [packed[x:y].tobytes() for x, y in zip(offset[:-1] // 8, offset[1:] // 8)]


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the larger one folded to the size of the smaller."""
    p, q = (np.frombuffer(z, "<u8") for z in (x, y))
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def enumerated(mixed: np.ndarray, h: np.ndarray, doc: np.ndarray, c: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets (features by document, ascending) in class c, by document and in the order of the hash range; and each one's document."""
    part = ((h >> np.uint64(32)) * np.uint64(3 * n1)) >> np.uint64(32)
    starts = np.flatnonzero((np.diff(part, prepend=part[:1] + np.uint64(1)) != 0) | (np.diff(doc, prepend=-1) != 0))
    value, part, doc = _sums(mixed, starts), part[starts], doc[starts]
    first, second = part // np.uint64(3), (part % np.uint64(3)).astype(np.int64)
    new = np.flatnonzero((np.diff(first, prepend=first[:1] + np.uint64(1)) != 0) | (np.diff(doc, prepend=-1) != 0))
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(first))))
    sums, has = np.zeros((len(new), 3), np.uint64), np.zeros((len(new), 3), bool)
    sums[group, second], has[group, second] = value, True
    name = first[new][:, None] * np.uint64(256) + (np.arange(3, dtype=np.uint64) * np.uint64(64) + np.uint64(c))
    left, right = [0, 0, 1], [1, 2, 2]
    live = (has[:, left] | has[:, right]).ravel()
    return mix(sums[:, left] + sums[:, right] + mix(name)).ravel()[live], np.repeat(doc[new], 3)[live]


class Flush:
    """Signatures of a number of documents. An entry is a document in a class."""

    def __init__(self):
        self.sig, self.entry, self.parts, self.n = [], [], [], 0
        self.docs, self.entries = 0, 0

    def add(self, ids: np.ndarray, h: np.ndarray, begins: np.ndarray, digests: np.ndarray):
        """Documents with non-empty, different sets. Returns the weak ones' ids and classes."""
        size = np.diff(begins)
        mixed = mix(h ^ np.uint64(0x5851F42D4C957F2D))
        doc_of = np.repeat(np.arange(len(ids)), size)
        # Of the features in each sixteenth of the hash range, one bit of the least.
        bins = (h >> np.uint64(60)).astype(np.int64)
        starts = np.flatnonzero((np.diff(bins, prepend=-1) != 0) | (np.diff(doc_of, prepend=-1) != 0))
        least = np.minimum.reduceat(mixed, starts)
        sketch = np.bincount(doc_of[starts], (least & np.uint64(1)).astype(np.int64) << bins[starts], minlength=len(ids)).astype(np.uint16)
        weak = []
        for c, (s, t, n1) in enumerate(classes()):
            if s > size.max():
                break
            inside = (size >= s) & (size <= t)
            if not inside.any():
                continue
            elements = np.flatnonzero(inside[doc_of])
            sig, owner = enumerated(mixed[elements], h[elements], doc_of[elements], c, n1)
            used = np.bincount(owner, minlength=len(ids))
            which = np.flatnonzero(inside)
            d = (size[which] + np.minimum(t, 4 * size[which] // 3)) // 7
            spoilt = np.minimum(2 * d, d + n1)
            slack = used[which] - spoilt
            goes = np.zeros(len(ids), np.int64)
            goes[which] = np.where(slack > 0, spoilt + np.minimum(slack, sent(size[which])), used[which])
            keep = np.arange(len(owner)) - (np.cumsum(used) - used)[owner] < goes[owner]
            sig, owner = sig[keep], owner[keep]
            need = np.minimum(slack, sent((3 * size[which] + 3) // 4))
            need = np.where(need > 1, need - 1 - need // 64, need)
            number = np.full(len(ids), -1)
            number[which] = self.entries + np.arange(len(which))
            self.sig.append(sig)
            self.entry.append(number[owner].astype(np.uint16))
            table = np.zeros(len(which), ENTRY)
            table["doc"], table["digest"], table["sketch"], table["cls"] = ids[which], digests[which], sketch[which], c
            table["n"] = size[which]
            table["slack"] = np.clip(need, -30_000, 30_000)
            self.parts.append(table)
            self.entries += len(which)
            self.n += len(sig)
            weak += [(int(ids[i]), c) for i in which[slack <= 0]]
        self.docs += len(ids)
        return weak


ENTRY = np.dtype([("doc", "<i8"), ("digest", "<u8"), ("n", "<u4"), ("sketch", "<u2"), ("slack", "<i2"), ("cls", "u1")])


def pack_blob(table: np.ndarray, entry: np.ndarray, sig: np.ndarray, flagged: np.ndarray) -> bytes:
    """Signatures by entry as bytes: entries' columns and signatures, all by byte place, so that bytes that are alike stand side by side when Spark compresses them."""
    used, count = np.unique(entry, return_counts=True)
    t = table[used]
    base = int(t["doc"].min())
    offset = (t["doc"] - base).astype(np.uint64)
    wide = 8 if int(offset.max()) >> 32 else 4
    columns = [
        (offset.astype(f"<u{wide}"), wide), (t["digest"], 8), (t["n"], 4), (t["sketch"], 2), (t["slack"], 2), (t["cls"], 1), (count.astype("<u4"), 4), (sig, KEY),
    ]
    flags = np.flatnonzero(flagged).astype("<u4")
    head = np.array([base, wide, len(used), len(sig), len(flags)], "<i8")
    return b"".join([head.tobytes(), *(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :w].T.tobytes() for x, w in columns), flags.tobytes()])


def unpack_blob(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The table of entries, and each signature's entry, bytes and flag."""
    base, wide, n, k, flags = np.frombuffer(raw[:40], "<i8").tolist()
    at = 40

    def column(count, width, kind):
        nonlocal at
        out = np.zeros((count, np.dtype(kind).itemsize), np.uint8)
        out[:, :width] = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count).T
        at += count * width
        return out.view(kind)[:, 0]

    table = np.zeros(n, ENTRY)
    table["doc"] = column(n, wide, "<u8").astype(np.int64) + base
    for name in ("digest", "n", "sketch", "slack", "cls"):
        table[name] = column(n, ENTRY[name].itemsize, ENTRY[name])
    count, sig = column(n, 4, "<u4"), column(k, KEY, "<u8")
    flagged = np.zeros(k, bool)
    flagged[np.frombuffer(raw, "<u4", flags, at)] = True
    return table, np.repeat(np.arange(n, dtype=np.uint32), count), sig, flagged


def _alike(first: np.void, rest: np.ndarray) -> np.ndarray:
    """Whether sketches agree in 13 of 16 bits and sizes allow a link."""
    n, least = rest["n"].astype(np.int64), int(first["n"])
    return (np.bitwise_count(rest["sketch"] ^ first["sketch"]) <= 3) & (4 * np.minimum(n, least) >= 3 * np.maximum(n, least))


def _star(e: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of an entry with the first of a few leaders that it is like. e: by document. Of very many, parts by a hash of the id have their own leaders, so that none has more than about LED pairs."""
    if len(e) > LED:
        part = mix(e["doc"].astype(np.uint64)) >> np.uint64(64 - (2 * len(e) // LED).bit_length())
        parts = [e[part == p] for p in np.unique(part)]
        return [x for p in parts for x in _star(p)] + _star(np.sort(np.concatenate([p[:1] for p in parts]), order="doc"))
    out, rest = [], e
    for _ in range(3):
        if len(rest) < 2:
            break
        like = _alike(rest[0], rest[1:])
        out += [(int(rest["doc"][0]), int(x)) for x in rest["doc"][1:][like]]
        rest = rest[1:][~like]
    return out


def _rows(kind: str, rows: list[tuple], names: tuple[str, ...]) -> dict[str, list]:
    cols = dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}
    return {"kind": [kind] * len(rows)} | {k: list(v) for k, v in cols.items()}


_KINDS = {"kind": pa.string(), "a": pa.int64(), "b": pa.int64(), "sig": pa.int64(), "cls": pa.int32(), "slack": pa.int32(), "n": pa.int64(), "digest": pa.binary()}


def _batch(cols: dict[str, list], extra: dict[str, tuple[list, pa.DataType]] | None = None) -> pa.RecordBatch:
    size = len(cols["kind"])
    arrays = [pa.array(cols[k], t) if k in cols else pa.nulls(size, t) for k, t in _KINDS.items()]
    extra = extra or {}
    return pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in extra.values()), *arrays], names=[*extra, *_KINDS])


def _groups(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of equal values begin in a sorted array, and how many each has."""
    starts = np.flatnonzero(np.diff(sig, prepend=sig[:1] + np.uint64(1)) != 0) if len(sig) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sig)))


def _key(sig: np.ndarray, bucket) -> np.ndarray:
    """A signature's number from what a blob has of it."""
    return mix((sig & np.uint64((1 << (8 * KEY)) - 1)) + np.uint64(int(bucket) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)


def signatures(buckets: int):
    """doc_id, _text -> blobs of signatures by bucket, and rows that pass through: D (a document's set: size, digest and bitmap), W (weak), M (a member of a large signature), S (a pair that looks alike)."""

    def passing(cols):
        at = [(hash(x) if x is not None else 0) % buckets for x in cols["a"]]
        return _batch(cols, {"bucket": (at, pa.int32()), "blob": ([None] * len(at), pa.binary())})

    def flush(f: Flush):
        sig, entry, table = np.concatenate(f.sig), np.concatenate(f.entry), np.concatenate(f.parts)
        order = np.argsort(sig, kind="stable")
        sig, entry = sig[order], entry[order]
        starts, counts = _groups(sig)
        ship, flagged = np.ones(len(sig), bool), np.zeros(len(sig), bool)
        bucket = (((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        member, pairs = [], set()
        for g in np.flatnonzero(counts > SMALL):
            a, b = starts[g], starts[g] + counts[g]
            e = np.sort(table[entry[a:b]], order="doc")
            k = int(_key(sig[a : a + 1], bucket[a])[0])
            member += [(k, int(x["doc"]), int(x["cls"]), int(x["slack"]), int(x["n"])) for x in e]
            pairs.update(_star(e))
            ship[a:b] = False
            lead = a + int(np.argmin(table["doc"][entry[a:b]]))
            ship[lead] = flagged[lead] = True
            if len(member) > 50_000:
                yield passing(_rows("M", member, ("sig", "a", "cls", "slack", "n")))
                member = []
        if member:
            yield passing(_rows("M", member, ("sig", "a", "cls", "slack", "n")))
        if pairs:
            yield passing(_rows("S", sorted(pairs), ("a", "b")))
        order = np.flatnonzero(ship)
        order = order[np.lexsort((entry[order], bucket[order]))]
        sig, entry, bucket, flagged = sig[order], entry[order], bucket[order], flagged[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        for p in np.flatnonzero(np.diff(cut)):
            x = slice(cut[p], cut[p + 1])
            yield _batch({"kind": ["B"]}, {"bucket": ([int(p)], pa.int32()), "blob": ([pack_blob(table, entry[x], sig[x], flagged[x])], pa.binary())})

    def run(batches):
        f, seen = Flush(), set()
        for b in cut(batches):
            ids = b.column(0).to_pylist()
            texts = [x.encode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            for lo, hi in slices(texts, SLICE):
                h, begins = shingle_sets(texts[lo:hi])
                size = np.diff(begins)
                doc = ids[lo:hi]
                some = np.flatnonzero(size)
                one = np.zeros((len(doc), 2), np.uint64)
                if len(some):
                    at = begins[:-1][some]
                    one[some, 0], one[some, 1] = mix(_sums(mix(h), at) + size[some].astype(np.uint64)), _sums(mix(h + np.uint64(1)), at)
                bits = bitmaps(mix(h + np.uint64(2)), begins)
                digest = [one[i].tobytes() if size[i] else None for i in range(len(doc))]
                yield passing({"kind": ["D"] * len(doc), "a": doc, "n": size.tolist(), "digest": [x and x + y for x, y in zip(digest, bits)]})
                # Of equal sets in a flush the smallest id is enough.
                new = [i for i in sorted(some, key=lambda i: (doc[i] is None, doc[i])) if doc[i] is not None and not (digest[i] in seen or seen.add(digest[i]))]
                new = np.array(sorted(new), np.int64)
                if len(new):
                    own = np.zeros(len(doc), bool)
                    own[new] = True
                    keep = own[np.repeat(np.arange(len(doc)), size)]
                    weak = f.add(np.array([doc[i] for i in new], np.int64), h[keep], np.append(0, np.cumsum(size[new])), one[new, 0])
                    if weak:
                        yield passing(_rows("W", weak, ("a", "cls")))
                if f.n > FLUSH or f.entries > FLUSH_DOCS - 4000 or f.docs > FLUSH_DOCS // 2:
                    yield from flush(f)
                    f, seen = Flush(), set()
        if f.n:
            yield from flush(f)

    return run


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """a, b, class, slack of a and slack of b of pairs of entries with different sets whose sizes allow a link; a < b."""
    good = (x["digest"] != y["digest"]) & (x["doc"] != y["doc"])
    good &= 4 * np.minimum(x["n"], y["n"]).astype(np.int64) >= 3 * np.maximum(x["n"], y["n"]).astype(np.int64)
    x, y = x[good], y[good]
    swap = x["doc"] > y["doc"]
    a, b = np.where(swap, y, x), np.where(swap, x, y)
    return np.column_stack([a["doc"], b["doc"], a["cls"].astype(np.int64), a["slack"].astype(np.int64), b["slack"].astype(np.int64)])


def matches():
    """A bucket's blobs -> P rows (a, b, class, need of a, in sig that of b, and in n how many signatures they share here), S rows (pairs that look alike) and M rows; rows that pass through are passed."""

    def run(batches):
        bucket, tables, entries, sigs, flags, total = TaskContext.get().partitionId(), [], [], [], [], 0
        for b in batches:
            blobs = b.column(1)
            rest = b.filter(blobs.is_null())
            if len(rest):
                yield pa.RecordBatch.from_arrays(rest.columns[2:], names=rest.schema.names[2:])
            for x in blobs:
                if not x.is_valid:
                    continue
                table, entry, sig, flagged = unpack_blob(x.as_py())
                tables.append(table)
                entries.append(entry + np.uint32(total))
                sigs.append(sig)
                flags.append(flagged)
                total += len(table)
        if not tables:
            return
        table, entry, sig, flagged = np.concatenate(tables), np.concatenate(entries), np.concatenate(sigs), np.concatenate(flags)
        del tables, entries, sigs, flags
        order = np.argsort(sig, kind="stable")
        sig, entry, flagged = sig[order], entry[order], flagged[order]
        del order
        starts, counts = _groups(sig)
        stars, some = set(), []
        two = starts[counts == 2]
        plain = two[~flagged[two] & ~flagged[two + 1]]
        some.append(_pairs(table[entry[plain]], table[entry[plain + 1]]))
        member = []
        more = (counts > 2) | (np.logical_or.reduceat(flagged, starts) & (counts > 1)) if len(starts) else np.zeros(0, bool)
        upper = {k: np.triu_indices(k, 1) for k in range(2, SMALL + 1)}
        left, right = [], []
        for g in np.flatnonzero(more):
            s, t = starts[g], starts[g] + counts[g]
            e, mark = table[entry[s:t]], flagged[s:t]
            by = np.lexsort((e["doc"], e["digest"]))
            e, mark = e[by], mark[by]
            first = np.append(True, e["digest"][1:] != e["digest"][:-1])
            if mark.any() or first.sum() > SMALL:
                k = int(_key(sig[s : s + 1], bucket)[0])
                member += [(k, int(r["doc"]), int(r["cls"]), int(r["slack"]), int(r["n"])) for r in e[~mark]]
                stars.update(_star(np.sort(e[first], order="doc")))
            elif first.sum() > 1:
                e = e[first]
                i, j = upper[len(e)]
                left.append(e[i])
                right.append(e[j])
            if len(member) > 50_000:
                yield _batch(_rows("M", member, ("sig", "a", "cls", "slack", "n")))
                member = []
        if left:
            some.append(_pairs(np.concatenate(left), np.concatenate(right)))
        if member:
            yield _batch(_rows("M", member, ("sig", "a", "cls", "slack", "n")))
        if stars:
            yield _batch(_rows("S", sorted(stars), ("a", "b")))
        found, often = np.unique(np.concatenate(some), axis=0, return_counts=True)
        if len(found):
            cols = dict(zip(("a", "b", "cls", "slack", "sig"), found.T.tolist()))
            yield _batch({"kind": ["P"] * len(found), "n": often.tolist()} | cols)

    return run


def signed(docs: DataFrame, id: str, text: str, tables: Tables) -> DataFrame:
    """All that signatures tell, as a table in the shared folder (RESULT)."""
    t = text_or_empty(text)
    size = docs.agg(F.sum(F.octet_length(t))).first()[0] or 0
    buckets = int(min(max(1, -(-size // 8 // BUCKET)), 1 << 20))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), t.alias("_text"))
    blobs = rows.mapInArrow(released(signatures(buckets)), "bucket int, blob binary, " + RESULT)
    return tables.add(blobs.repartitionById(buckets, "bucket").mapInArrow(released(matches()), RESULT), "signatures")


def sets_of(docs: DataFrame, ids: DataFrame, id: str, text: str) -> DataFrame:
    """doc, hashes (packed, ascending) of the documents in ids (column doc, distinct)."""
    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col(id).cast("long").alias("doc"), text_or_empty(text).alias("_text")).join(F.broadcast(ids) if few else ids, "doc", "left_semi")

    def run(batches):
        for b in cut(batches):
            texts = [x.encode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            for lo, hi in slices(texts, SLICE):
                h, begins = shingle_sets(texts[lo:hi])
                packed = [h[x:y].tobytes() for x, y in zip(begins[:-1], begins[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["doc", "hashes"])

    return rows.mapInArrow(released(run), "doc long, hashes binary")


def _linked(batches):
    """a, b, x, y -> a, b of the pairs whose sets x and y are similar enough."""
    for b in batches:
        for s in range(0, len(b), 256):
            part, good = b.slice(s, 256), []
            for x, y in zip(part.column(2), part.column(3)):
                p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                least = 3 * (len(p) + len(q))
                common = len(np.intersect1d(p, q, assume_unique=True)) if 7 * min(len(p), len(q)) >= least else 0
                good.append(common > 0 and 7 * common >= least)
            yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _near(batches):
    """a, b, x, y, nx, ny -> a, b of the pairs whose bitmaps x and y allow a link of sets of those sizes."""
    for b in batches:
        x, y, n = b.column(2).to_pylist(), b.column(3).to_pylist(), np.add(b.column(4), b.column(5)) // 7
        good = np.fromiter((apart(p, q) <= d for p, q, d in zip(x, y, n.tolist())), bool, len(b))
        yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(good))


def verified(pairs: DataFrame, maps: DataFrame, docs: DataFrame, id: str, text: str, tables: Tables) -> DataFrame:
    """The pairs (a < b, distinct) that link, as a table. maps: doc, n, bitmap."""
    x = maps.select(F.col("doc").alias("a"), F.col("n").alias("nx"), F.col("bitmap").alias("x"))
    y = maps.select(F.col("doc").alias("b"), F.col("n").alias("ny"), F.col("bitmap").alias("y"))
    near = tables.add(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "nx", "ny").mapInArrow(released(_near), "a long, b long"), "near")
    ids = tables.add(near.select(F.col("a").alias("doc")).union(near.select("b")).distinct(), "candidates")
    sets = tables.add(sets_of(docs, ids, id, text), "sets")
    x = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("doc").alias("b"), F.col("hashes").alias("y"))
    links = tables.add(near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(released(_linked), "a long, b long"), "links")
    tables.drop(near, ids, sets)
    return links


def connected(links: DataFrame, tables: Tables) -> DataFrame:
    """doc, component (the smallest id that links reach) of every document with a link, as a table: alternating large and small stars until nothing changes. A hub's edges are
    spread over SALTS tasks."""
    edges, before = links.select("a", "b").distinct(), None
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = both.where("v > u").withColumn("salt", salt("v")).join(least, ["u", "salt"]).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m"), "a", "b")
        old, edges = edges, small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("m").alias("a"), "b")).where("a < b").distinct()
        edges = tables.add(edges, "stars")
        tables.drop(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            out = edges.select(F.col("b").alias("doc"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("doc"), "a").distinct())
            out = tables.add(out, "groups")
            tables.drop(edges)
            reclaim(tables.spark)
            return out
        before = now


def across(rows: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """rows: key, doc, component, n (distinct; n the size of its set), rest (how many of its features the key and those after it are; n where keys have no order).
    Pairs of documents of a key and different components that can share enough, for keys with at most `most` documents outside their largest component; and the other keys."""
    by = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    top = by.groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top")).where("k > 1")
    top = top.withColumn("outside", F.col("n") - F.col("top.n"))
    good, hot = (top, top.limit(0)) if most is None else (top.where(F.col("outside") <= most), top.where(F.col("outside") > most))
    # The rows of a frequent key are spread over several tasks, its few ones go to each of them.
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(SPREAD)).cast("int"))
    each = lambda x: x.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    few = spread.join(each(good.select("key", F.col("top.component").alias("largest"))), ["key", "_salt"]).where("component <> largest")
    few = each(few.select("key", F.col("doc").alias("p"), F.col("component").alias("c"), F.col("n").alias("pn"), F.col("rest").alias("prest")))
    pairs = few.join(spread, ["key", "_salt"]).where("component <> c and 4 * least(n, pn) >= 3 * greatest(n, pn) and 7 * least(rest, prest) >= 3 * (n + pn)").select(F.least("p", "doc").alias("a"), F.greatest("p", "doc").alias("b")).distinct()
    return pairs, hot.select("key")


def prefixes(sets: DataFrame, repeated: bool = True) -> DataFrame:
    """key, doc, n, rest: of each set the rarest features, one more than two linked sets can differ in on one side, and how many of its features are no rarer.
    repeated: whether a document can be there more than once; its equal sets then count as one, and others each for itself."""
    sets = sets.distinct().withColumn("own", F.xxhash64("hashes")) if repeated else sets.withColumn("own", F.lit(0).cast("long"))

    def run(batches):
        for b in batches:
            for doc, x, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                h = np.frombuffer(x.as_py(), "<i8")
                for s in range(0, len(h), 10_000):
                    part = h[s : s + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(np.full(len(part), v, np.int64)) for v in (doc, len(h), own))], names=["key", "doc", "n", "own"])

    from pyspark.sql import Window

    rows = sets.mapInArrow(released(run), "key long, doc long, n long, own long")
    often = rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    # A feature of one set only can take a place in the prefix but never finds a partner.
    ranked = rows.join(often, "key", "left").withColumn("r", F.row_number().over(Window.partitionBy("doc", "own").orderBy(F.coalesce("df", F.lit(1)), "key")))
    return ranked.where("r <= n - ceil(3 * n / 4) + 1 and df > 1").select("key", "doc", "n", (F.col("n") - F.col("r") + 1).alias("rest"))


def components(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id of each row."""
    tables = Tables(df.sparkSession)
    found = signed(df, id, text, tables)
    sets = found.where("kind = 'D'").select(F.col("a").alias("doc"), "n", F.substring("digest", 1, 16).alias("digest"))
    # Only digests of several rows are joined; the rows of a hot one are spread.
    first = sets.where("digest is not null").groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("rows")).where("rows > 1").select("digest", "rep")
    reps = tables.add(spread_join(sets, first, "digest", "doc", SALTS).select("doc", "n", F.coalesce("rep", "doc").alias("rep")), "representatives")
    of = reps.select("doc", "rep").distinct()
    maps = found.where("kind = 'D' and digest is not null").select(F.col("a").alias("doc"), "n", F.expr("substring(digest, 17)").alias("bitmap")).distinct()
    # A document shares at least `need` signatures with each partner; those that are large aren't counted in pairs.
    large = tables.add(found.where("kind = 'M'").select("sig", F.col("a").alias("doc"), "cls", "slack", "n").distinct(), "large")
    lost = large.groupBy("doc", "cls").agg(F.count("*").alias("lost"))
    shared = found.where("kind = 'P'").groupBy("a", "b", "cls").agg(F.sum("n").alias("n"), F.max("slack").alias("sa"), F.max("sig").alias("sb"))
    shared = shared.join(lost.select(F.col("doc").alias("a"), "cls", F.col("lost").alias("la")), ["a", "cls"], "left")
    shared = shared.join(lost.select(F.col("doc").alias("b"), "cls", F.col("lost").alias("lb")), ["b", "cls"], "left")
    enough = F.col("n") >= F.greatest(F.col("sa") - F.coalesce("la", F.lit(0)), F.col("sb") - F.coalesce("lb", F.lit(0)))
    pairs = shared.where(enough).select("a", "b").union(found.where("kind = 'S'").select("a", "b")).distinct()
    same = of.select(F.col("doc").alias("a"), F.col("rep").alias("ra")), of.select(F.col("doc").alias("b"), F.col("rep").alias("rb"))
    pairs = pairs.join(same[0], "a").join(same[1], "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct()
    pairs = tables.add(pairs, "pairs")
    links = verified(pairs, maps, df, id, text, tables)
    tables.drop(pairs)
    groups = connected(links, tables)
    members = large.join(of, "doc").select("sig", F.col("rep").alias("doc"), "cls", "slack", "n").distinct()
    members = tables.add(members.join(groups, "doc", "left").withColumn("component", F.coalesce("component", "doc")), "members")
    tables.drop(large)
    more, hot = across(members.select(F.col("sig").alias("key"), "doc", "component", "n", F.col("n").alias("rest")).distinct(), CROSS)
    lost = members.join(hot.withColumnRenamed("key", "sig"), "sig").groupBy("doc", "cls").agg(F.count("*").alias("h"), F.min("slack").alias("slack"))
    unsafe = lost.where("h >= slack").select("doc").union(found.where("kind = 'W'").select(F.col("a").alias("doc")).join(of, "doc").select(F.col("rep").alias("doc"))).distinct()
    unsafe = tables.add(unsafe, "unsafe")
    rest = tables.add(sets_of(df, unsafe, id, text), "unsafe-sets")
    again = reps.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").join(unsafe, "doc", "left_semi")
    rare = prefixes(rest, again.limit(1).count() > 0).join(groups, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    rare = tables.add(rare, "prefixes")
    others, _ = across(rare, None)
    more = tables.add(more.union(others).distinct(), "more-pairs")
    tables.drop(rest, rare, members, unsafe)
    if more.limit(1).count():
        new = verified(more, maps, df, id, text, tables)
        old, groups = groups, connected(links.union(new), tables)
        tables.drop(old, new)
    out = reps.join(groups.withColumnRenamed("doc", "rep"), "rep", "left")
    out = out.select(F.col("doc").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return tables.last(out, "components")


def kept(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows that are the smallest of their component, with df's columns. Rows of one id stand and fall together, so of different texts under one id none is lost alone: an id goes only if all
    its rows are in components of smaller ids. Rows with a null id have no place in the order and stay."""
    places = components(df, id, text).where(F.col(id).isNotNull())
    gone = places.groupBy(id).agg(F.max("component_id").alias("_last")).where(F.col("_last") != F.col(id)).select(F.col(id).alias("_gone"))
    return df.join(gone, df[id] == F.col("_gone"), "left_anti")
