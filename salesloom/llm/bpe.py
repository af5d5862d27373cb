"""Byte-pair encoding with a given vocabulary: merges by a priority queue of ranks over a linked list of symbols.

The vocabulary file is that of a BPE with word ends (``</w>``): texts are NFC-normalised, lower-cased, cut into
letters, digits and other characters, and spelled in visible stand-ins for bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from salesloom.llm.common import id_and_text

#: Fixed value: how the vocabulary cuts a normalised text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Characters whose case, class and composition no Unicode version changes; texts of others are normalised and cut
#: by the vocabulary's own rules, with the same merges after.
PLAIN = regex.compile(r"[\x00-\x1B\x20-\u024F]*")

#: Encoded stretches that a task remembers; beyond it starts over, which changes no result.
REMEMBERED = 400_000


def byte_symbols() -> list[str]:
    """The visible character for each byte: itself where it is printable Latin-1, else 256 and up in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.spelled = dict(enumerate(byte_symbols()))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        library = Tokenizer.from_file(path)  # its tables of letters and cases may be of another Unicode version
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def merge(self, symbols: list[str]) -> list[str]:
        """Applies the merges: the lowest rank first, of equal ranks the leftmost pair."""
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank_at = [ranks.get(pair, -1) for pair in zip(symbols, symbols[1:])] + [-1]
        shift = n.bit_length()
        place = (1 << shift) - 1
        queue = [rank << shift | i for i, rank in enumerate(rank_at) if rank >= 0]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i = top & place
            if rank_at[i] != top >> shift:
                continue  # stale: an earlier merge changed this pair
            j = after[i]
            symbols[i] += symbols[j]
            symbols[j], rank_at[j] = "", -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                rank_at[i] = rank = ranks.get((symbols[i], symbols[k]), -1)
                if rank >= 0:
                    heapq.heappush(queue, rank << shift | i)
            else:
                rank_at[i] = -1
            h = before[i]
            if h >= 0:
                rank_at[h] = rank = ranks.get((symbols[h], symbols[i]), -1)
                if rank >= 0:
                    heapq.heappush(queue, rank << shift | h)
        return [s for s in symbols if s]

    def word(self, symbols: str) -> tuple[int, ...]:
        """Ids of one piece, given in stand-ins; a symbol that the vocabulary lacks is left out, there being no
        unknown token."""
        found = self.words.get(symbols)
        if found is None:
            parts = list(symbols)
            parts[-1] += self.end
            found = tuple(self.ids[s] for s in self.merge(parts) if s in self.ids)
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[symbols] = found
        return found

    def told(self, ids: list[int] | tuple[int, ...]) -> tuple[str, str]:
        return " ".join(map(str, ids)), " ".join([self.strings[i] for i in ids])

    def stretch(self, text: str) -> tuple[str, str]:
        """Of a plain stretch without white space: its ids as text, and their strings in the vocabulary."""
        spelled = self.spelled
        ids: list[int] = []
        for piece in PIECES.findall(text):
            ids += self.word(piece.encode().decode("latin-1").translate(spelled))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[text] = found = self.told(ids)
        return found

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by blanks, and the decoded text."""
        found: list[tuple[str, str]] = []
        known, stretch = self.known, self.stretch
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                found.append((str(self.special[part]), part))
            elif PLAIN.fullmatch(part):
                found += [known[w] if w in known else stretch(w) for w in part.lower().split()]
            else:
                found += [self.told(self.word(symbols)) for symbols, _ in self.pre_tokenize(self.normalize(part))]
        ids = " ".join([f[0] for f in found if f[0]])
        return ids.count(" ") + 1 if ids else 0, ids, self.decode_strings([f[1] for f in found if f[0]])

    @staticmethod
    def decode_strings(strings) -> str:
        """The file names no decoder; its tokens' strings are then joined by blanks."""
        return " ".join(strings)

    def decode(self, ids: list[int]) -> str:
        return self.decode_strings(self.strings[i] for i in ids if i in self.strings)


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``path`` is the vocabulary's file, which every executor has. Null and empty texts have no token and the digests of
    the empty text; repeated rows give repeated rows; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            rows = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            digests = [[hashlib.sha256(r[k].encode("utf-8")).hexdigest() for r in rows] for k in (1, 2)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array([r[0] for r in rows], pa.int64()),
                    "ids_sha256": pa.array(digests[0], pa.string()),
                    "decoded_sha256": pa.array(digests[1], pa.string()),
                }
            )

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
