"""Best-fit packing of documents into sequences, improved by local search: moves and swaps between underfull bins.

Documents become pieces of token ids; what is packed after that are (slot, length) rows. They are dealt by hash to groups
of bounded size. In a group the pieces go best-fit, longest first; then the search exchanges pieces of underfull bins
one or two for one or two, or moves one, whenever that adds to the sum of squared fills, until bins empty. Full bins are done. The bins still underfull are dealt anew, whole, into fewer groups, until they fit one.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from salesloom.llm.bpe import byte_symbols
from salesloom.llm.common import id_and_text, staged

#: Tokens of a sequence, the id that ends a document, and how the vocabulary cuts a text.
CAPACITY, END = 1024, 2
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces that a group holds on average, and characters after which a long text is cut for the encoder.
GROUP, STRETCH = 1 << 14, 1 << 16

#: Rounds end when one empties less than this share of the bins that it was dealt.
LEAST_GAIN = 0.001

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACE = "slot long, length int, bin long, fill int, offset int"


class ByteEncoder:
    """Ids of a byte-level BPE vocabulary file.

    The ids are those of the tokenizers library. Where a merge's rank is its id, tiktoken gives the same ids from the
    same file several times as fast; the library itself serves any other file, and stretches that tiktoken refuses.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.fast = self.ranked(spec)

    @staticmethod
    def ranked(spec: dict) -> tiktoken.Encoding | None:
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model["type"] != "BPE" or spec["normalizer"] or any(cut.get(k) != v for k, v in plain.items()):
            return None
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]):
            return None
        own = {s: i for s, i in model["vocab"].items() if s not in added}
        merged = [own.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        if len(own) != 256 + len(merged) or merged != sorted(merged) or merged[:1] < [256]:
            return None
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in own.items()}
        return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=added)

    def stretches(self, text: str) -> Iterator[str]:
        """A long text in parts, cut before blanks between two words, where no token reaches across."""
        start = 0
        while len(text) - start > STRETCH:
            found = _GAP.search(text, start + STRETCH)
            if found is None:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def ids(self, text: str) -> np.ndarray:
        return np.concatenate([*map(self.part, self.stretches(text)), np.array([END], "<u4")])

    def part(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
            except ValueError:  # its pattern gives up on very long runs of white space
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


_GAP = regex.compile(r"(?<=\w) (?=\w)")


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which takes what is left over."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((start, capacity) for start in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text)
                for k, (start, length) in enumerate(cuts(len(ids))):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return id_and_text(docs).mapInArrow(run, PIECE)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it.

    The rooms of the bins are bits of one number, in which the least one that suffices is the lowest set bit.
    """
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[number].append(item)
        else:
            room, number = capacity, len(bins)
            bins.append([item])
        left = room - size
        if left:
            by_room[left].append(number)
            rooms |= 1 << left
    return bins


class Shelf:
    """Donor bins, found by the size of an item or of two items that they hold."""

    def __init__(self) -> None:
        self.owners: tuple[dict[int, set[int]], dict[int, set[int]]] = (defaultdict(set), defaultdict(set))
        self.masks = [0, 0]  # sizes at hand, as bits

    @staticmethod
    def sums(sizes: list[int]) -> tuple[set[int], set[int]]:
        return set(sizes), {a + b for k, a in enumerate(sizes) for b in sizes[k + 1 :]}

    def add(self, number: int, sizes: list[int]) -> None:
        for kind, found in enumerate(self.sums(sizes)):
            for s in found:
                self.owners[kind][s].add(number)
                self.masks[kind] |= 1 << s

    def drop(self, number: int, sizes: list[int]) -> None:
        for kind, found in enumerate(self.sums(sizes)):
            for s in found:
                self.owners[kind][s].discard(number)
                if not self.owners[kind][s]:
                    self.masks[kind] &= ~(1 << s)

    def largest(self, kind: int, above: int, most: int) -> int:
        """The largest size in (above, most] at hand, or 0."""
        size = (self.masks[kind] & ((1 << (most + 1)) - 1)).bit_length() - 1
        return size if size > above else 0


def improve(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Local search over the underfull of ``bins``; those that it empties are gone.

    Bins are taken by falling fill. One gets the exchange that adds most to it, with a donor that is no fuller, so that
    the sum of squared fills grows each time and the search ends. Of donors the emptiest gives. A pass without a
    change is the last one.
    """
    held = {k: list(items) for k, items in enumerate(bins)}
    fill = {k: sum(lengths[i] for i in items) for k, items in held.items()}
    changed = True
    while changed:
        changed = False
        waiting = [k for k in held if 0 < fill[k] < capacity]
        shelf = Shelf()
        for k in waiting:
            shelf.add(k, [lengths[i] for i in held[k]])
        queue = [(-fill[k], k) for k in waiting]
        heapq.heapify(queue)
        taken: set[int] = set()
        while queue:
            level, k = heapq.heappop(queue)
            if k in taken or -level != fill[k] or not held[k]:
                continue  # stale: it has given since
            taken.add(k)
            shelf.drop(k, [lengths[i] for i in held[k]])
            while fill[k] < capacity:
                step = _best_exchange(k, held, fill, lengths, shelf, capacity)
                if step is None:
                    break
                changed = True
                donor, given, returned = step
                shelf.drop(donor, [lengths[i] for i in held[donor]])
                held[donor] = [i for i in held[donor] if i not in given] + returned
                held[k] = [i for i in held[k] if i not in returned] + given
                gain = sum(lengths[i] for i in given) - sum(lengths[i] for i in returned)
                fill[k] += gain
                fill[donor] -= gain
                if held[donor]:
                    shelf.add(donor, [lengths[i] for i in held[donor]])
                    heapq.heappush(queue, (-fill[donor], donor))
    return [items for items in held.values() if items]


def _best_exchange(k, held, fill, lengths, shelf, capacity):
    """(donor, items it gives, items it gets back) that fills bin k most; None if nothing adds to it."""
    room = capacity - fill[k]
    own = held[k]
    offers = [(0, [])] + [(lengths[i], [i]) for i in own]
    pairs = [(lengths[a] + lengths[b], [a, b]) for n, a in enumerate(own) for b in own[n + 1 :]]
    best = (0, 0, 0, [])
    for kind, chances in ((0, offers), (1, offers[1:]), (0, pairs), (1, pairs)):
        for size, items in chances:
            if best[0] == room:
                break
            wanted = shelf.largest(kind, size + best[0], size + room)
            if wanted:
                best = (wanted - size, kind, wanted, items)
    gain, kind, wanted, returned = best
    if not gain:
        return None
    donor = min(shelf.owners[kind][wanted], key=lambda b: (fill[b], b))
    items = held[donor]
    if kind == 0:
        return donor, [next(i for i in items if lengths[i] == wanted)], returned
    given = next([a, b] for n, a in enumerate(items) for b in items[n + 1 :] if lengths[a] + lengths[b] == wanted)
    return donor, given, returned


def _packed(group: pa.Table) -> pa.Table:
    """One group's pieces in bins; rows that come with a bin keep it as the search's start."""
    slots, lengths = group.column("slot").to_numpy(), group.column("length").to_pylist()
    order = np.argsort(slots, kind="stable").tolist()
    slots, lengths = slots[order].tolist(), [lengths[k] for k in order]
    known = [group.column("bin").to_pylist()[0]] if group.num_rows else []
    if known[:1] == [None]:
        bins = best_fit(lengths)
    else:
        there = defaultdict(list)
        numbers = group.column("bin").to_pylist()
        for item, k in enumerate(order):
            there[numbers[k]].append(item)
        bins = list(there.values())
    out = []
    for items in improve(bins, lengths):
        items = sorted(items)
        fill, offset = sum(lengths[i] for i in items), 0
        for i in items:
            out.append((slots[i], lengths[i], slots[items[0]], fill, offset))
            offset += lengths[i]
    columns = list(zip(*out)) if out else [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
    names = [f.split()[0] for f in PLACE.split(", ")]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def search(short: DataFrame, group: int = GROUP) -> DataFrame:
    """(slot, bin, offset) for ``short`` (slot, length), all shorter than a sequence.

    Groups hold ``group`` pieces on average, dealt by hash of their slot, so that neither a source nor copies crowd one.
    In later rounds whole bins are dealt. A bin is named by its smallest slot.
    """
    open_rows = short.select("slot", F.col("length").cast("int").alias("length"), F.lit(None).cast("long").alias("bin"))
    settled: list[DataFrame] = []
    dealt = None
    while True:
        groups = max(1, -(-open_rows.count() // group))
        key = F.pmod(F.xxhash64(F.coalesce("bin", "slot"), F.lit(len(settled))), F.lit(groups)).alias("deal")
        done = open_rows.select("slot", "length", "bin", key).groupBy("deal").applyInArrow(_packed, PLACE)
        done = staged(done, "bins")
        bins = done.where("slot = bin").count()
        if groups == 1 or (dealt is not None and dealt - bins < LEAST_GAIN * dealt):
            return _united([*settled, done]).select("slot", "bin", "offset")
        settled.append(done.where(F.col("fill") == CAPACITY))
        open_rows = done.where(F.col("fill") < CAPACITY)
        dealt = open_rows.where("slot = bin").count()


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path`` is the vocabulary's file, which every executor has. A null or empty text is the one end id. Rows without
    doc_id and repeated rows are packed like any other. An empty table gives an empty one. Sequences are numbered by
    the smallest row number among their pieces, with gaps.
    """
    cut = staged(pieces(docs, path).withColumn("slot", F.monotonically_increasing_id()), "pieces")
    own = ("doc_id", "piece", "start", "length", "ids_crc32")
    full = cut.where(F.col("length") == CAPACITY).select(*own, F.col("slot").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut.where(F.col("length") < CAPACITY)
    places = search(short).select("slot", F.col("bin").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    return full.unionByName(short.join(places, "slot").select(*own, "sequence_id", "offset"))
