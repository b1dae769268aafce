"""Packing: best-fit decreasing of documents' tokens into windows.

Method: a document's ids are cut into full windows and a rest; full windows are sequences of their own. The pieces are dealt evenly to shards by a
hash of document and start, each shard is sorted by falling length (Spark's sorter, which spills), and one pass over it places each piece
into the open window whose remaining capacity fits tightest, found in a segment tree over capacities; where none fits a window is opened. As the
sort delivers pieces in decreasing order, placing is a stream: memory holds one integer pair for each open window, never the ids.

Shards have SHARD pieces or more on average where the input has as many, so that the last windows of a shard, which stay partly empty, are few.

Where documents have a position in an order that is to be kept (that of a mix), shards are contiguous ranges of positions instead, and a sequence
takes its place from the piece that opened it, its longest: sequence ids rise with that piece's position, then its start. So sequences follow the order, and
what a sequence holds besides is of the same shard; shards then have ORDERED documents, which is as far as a document can be from its place.

Cases: a null text counts as empty; an empty text is the closing id alone, one piece of one token. Documents with a null id are packed like others. Repeated rows are packed as often as they occur.
Very long texts give many full windows. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released, text_or_empty

WINDOW = 2048
CLOSING_ID = 1
#: Pieces in a shard, about.
SHARD = 8192
#: Documents in a shard that keeps an order, about; and for how many windows of a document sequence ids have room.
ORDERED, STARTS = 1024, 1 << 21
#: Chunks whose ids a worker keeps, of at most so many characters each: about 64 MB.
KEPT, LONGEST = 250_000, 48


class WordIds:
    """Ids of whole texts by a BPE with word ends, lower case and white space dropped (word_bpe_49k.json), as little-endian 32-bit bytes.

    The tokenizer's pre-tokens never span white space, so a text's ids are those of its chunks between spaces and line ends, in order; a worker
    keeps the ids of chunks it has met. A new chunk of printable Latin-1 characters is cut by the tokenizer's own pattern and its pre-tokens are merged
    by tiktoken under the ranks of the same file (a word's end is a byte that UTF-8 has no use for). Every token of the file is the product of one merge,
    so merging by the rank of the product is merging by the rank of the pair. All else goes to the tokenizer itself: other characters, texts that may hold special tokens.
    """

    END = b"\xff"

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}

        def as_bytes(token: str) -> bytes:
            end = token.endswith(suffix) and len(token) > len(suffix)
            return bytes(to_byte[c] for c in (token.removesuffix(suffix) if end else token)) + (self.END if end else b"")

        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [a + b for a, b in pairs]
        joined = set(made)
        base = [t for t in vocab if t not in joined]
        tokens = sorted(base, key=lambda t: (len(as_bytes(t)), vocab[t])) + made
        ranks: dict[bytes, int] = {}
        self.ids = np.full(len(tokens) + 1, -1, np.int64)
        for t in tokens:
            ranks[as_bytes(t)] = len(ranks)
            self.ids[len(ranks) - 1] = vocab[t]
        self.exact = len(ranks) == len(tokens) == len(vocab) and len(joined) == len(made) and len(base) == 512
        if self.END not in ranks or self.ids[ranks[self.END]] < 0:
            self.exact = False
        self.id_bytes = [int(max(i, 0)).to_bytes(4, "little") for i in self.ids]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # The library's own entry point for one pre-token; without it the tokenizer does all.
        bpe = getattr(tiktoken.Encoding("words", pat_str=r".", mergeable_ranks=ranks, special_tokens={}), "_core_bpe", None) if self.exact else None
        self.piece = getattr(bpe, "encode_single_piece", None)
        self.exact = self.piece is not None
        self.kept: dict[str, bytes] = {}

    def _by_tokenizer(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """A chunk of a lower-cased Latin-1 text."""
        if not self.exact or not chunk.isprintable():
            return self._by_tokenizer(chunk)
        if chunk.isalpha():  # one run of letters
            parts = (chunk,)
        elif chunk[-1] in ".," and chunk[:-1].isalpha():
            parts = (chunk[:-1], chunk[-1])
        else:
            parts = self.pattern.findall(chunk)
        piece, ids = self.piece, self.id_bytes
        return b"".join([ids[r] for p in parts for r in piece(p.encode() + self.END)])

    def __call__(self, text: str) -> bytes:
        if "<|" in text:
            return self._by_tokenizer(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._by_tokenizer(text)
        chunks = text.lower().replace("\n", " ").split(" ")
        kept = self.kept
        try:
            return b"".join(map(kept.__getitem__, chunks))
        except KeyError:
            pass
        if len(kept) >= KEPT:
            kept.clear()
        rest: dict[str, bytes] = {}
        for c in chunks:
            if c not in kept and c not in rest:
                (kept if len(c) <= LONGEST and len(kept) < KEPT else rest)[c] = self._chunk(c) if c else b""
        return b"".join([kept[c] if c in kept else rest[c] for c in chunks])


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each worker process, so that later tasks find what earlier ones kept."""
    return WordIds(path)


def pieces(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, closing_id: int = CLOSING_ID, position: str | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (little-endian 32-bit, binary) of each document's full windows and rest; and position, where there is one."""
    close = np.array([closing_id], "<u4").tobytes()

    def run(batches):
        ids = word_ids(path)
        for part in cut(batches, 128):
            rows = []
            for doc, x, *at in zip(*(c.to_pylist() for c in part.columns)):
                got = ids(x) + close
                n = len(got) // 4
                rows += [(doc, i, min(window, n - i), n, got[4 * i : 4 * (i + window)], *at) for i in range(0, n, window)]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            kinds = (part.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    kind = dict(df.dtypes)[id]
    names = ["doc_id", "start", "length", "doc_tokens", "ids", *(["position"] if position else [])]
    order = [F.col(position).cast("long").alias("position")] if position else []
    rows = df.select(F.col(id).alias("doc_id"), text_or_empty(text).alias("_text"), *order)
    return rows.mapInArrow(released(run), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary" + ", position long" * bool(position))


class Windows:
    """Open windows by remaining capacity. tree[size + c] counts those with capacity c; an inner node the sum of its two."""

    def __init__(self, window: int):
        self.window, self.size = window, 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def _add(self, c: int, by: int) -> None:
        i = self.size + c
        while i:
            self.tree[i] += by
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least least that an open window has; -1 where none has."""
        tree, i = self.tree, self.size + least
        if tree[i]:
            return least
        while i > 1:  # up until a right sibling has windows, then down its left edge
            if not i & 1 and tree[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.size:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - self.size

    def place(self, length: int, name: int | None = None) -> tuple[int, int]:
        """Window and offset in it of a piece. A window that it opens is called name, by default the number of those before."""
        c = self.tightest(length) if length < self.window else -1
        if c < 0:
            w, c = self.made if name is None else name, self.window
            self.made += 1
        else:
            w = self.open[c].pop()
            self._add(c, -1)
        if c > length:
            self.open[c - length].append(w)
            self._add(c - length, 1)
        return w, self.window - c


def best_fit(window: int, ordered: bool = False):
    """Pieces sorted by shard and falling length -> the same with sequence_id and offset. A sequence's id has its shard in the high bits; if ordered, the position (the last column, which is dropped) and start of the piece that opened it."""

    def run(batches):
        shard, state = None, None
        for b in cut(batches):
            seq, off = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            names = [p * STARTS + k // window for p, k in zip(b.column(6).to_pylist(), b.column(2).to_pylist())] if ordered else [None] * len(b)
            for i, (s, n, name) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), names)):
                if s != shard:
                    shard, state = s, Windows(window)
                w, off[i] = state.place(n, name)
                seq[i] = w if ordered else (s << 40) + w
            yield pa.RecordBatch.from_arrays([*b.columns[1:6], pa.array(seq), pa.array(off)], names=[*b.schema.names[1:6], "sequence_id", "offset"])

    return run


def pack(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, closing_id: int = CLOSING_ID, position: str | None = None, ordered: int = ORDERED) -> DataFrame:
    """Each piece: doc_id, start, length, doc_tokens, ids, sequence_id and its offset there. position: a column of distinct whole numbers from 0, whose order sequences keep; ordered: documents in a shard then."""
    spark = df.sparkSession
    # Counting reads no text. There are as many rests as documents, so shards follow the documents, up to what the cluster runs at once many times over.
    n, last = df.agg(F.count("*"), F.max(position) if position else F.lit(0)).first()
    shards = max(1, min(n // (ordered if position else SHARD), 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    got = pieces(df, path, id, text, window, closing_id, position)
    if position:
        shard = F.least(F.floor(F.col("position") / F.lit(((last or 0) + 1) / shards)), F.lit(shards - 1)).cast("int")
    else:
        # Rows without an id are dealt by their place in the input.
        name = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id", "start"))
        shard = F.pmod(name, F.lit(shards)).cast("int")
    ties = ("position", "start") if position else ("doc_id", "start")
    dealt = got.select(shard.alias("shard"), *got.columns).repartitionById(shards, "shard").sortWithinPartitions("shard", F.desc("length"), *ties)
    kind = dict(df.dtypes)[id]
    return dealt.mapInArrow(released(best_fit(window, bool(position))), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Each sequence: its ids (little-endian 32-bit) padded to the window, or not at all where its length is a power of two; its tokens; and its documents in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    out = packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("tokens"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), (F.lit(window) - F.col("tokens")).cast("int")))
    power = F.bit_count("tokens") == 1
    return out.select("sequence_id", "tokens", F.when(power, ids).otherwise(F.concat(ids, pad)).alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["offset"], x["length"])).alias("documents"))
