"""Sequence packing: first-fit decreasing over randomised groups of documents.

Documents are tokenised and cut at multiples of the sequence length; whole cuts are sequences of
their own. What is left of each document (always shorter than a sequence) is packed inside
randomised groups of about ``group_docs`` documents by first-fit decreasing, where a
tournament tree over the bins' free room finds the first bin that fits in logarithmic time. Only
lengths and checksums are shuffled, never tokens.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, give_back, materialise

#: The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those
#: of its blank-separated chunks, and a chunk's ids those of its letter runs, digits and symbol runs.
PIECE, ASCII_PIECE = r"\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+", re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
#: Texts of ASCII and small Latin-1 letters, which are normal and lower-cased as they are, and their pieces.
LATIN, LATIN_PIECE = re.compile("[\x00-\x7f\xdf-\xf6\xf8-\xff]+"), re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: Pieces of so few bytes, of which there are few, are kept for good, at most so many.
SHORT, SHORT_ENTRIES = 3, 20_000
#: The cache holds at most two generations of so many chunks.
CACHE_ENTRIES = 200_000
#: Texts that a task tokenises at once: whole batches lie in the executor outside of its heap and in the worker.
BATCH = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_WHOLE = 1 << 62
#: Byte-level vocabularies name a byte by its Latin-1 character where that is visible, else by the next free one from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


class CachedTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes, by a bounded cache of chunks.

    Bytes that are no UTF-8 count as U+FFFD."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = regex.compile(PIECE)
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.short: dict[bytes, bytes] = {}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, piece: bytes) -> bytes:
        """A normalised piece, by the merges alone: the whole tokenizer takes several times as long for a word."""
        name = piece.decode("ascii") if piece.isalnum() else piece.decode("latin-1").translate(_BYTE_NAMES)
        id_bytes = self.id_bytes
        ids = b"".join([id_bytes[t.id] for t in self.model.tokenize(name)])
        if len(piece) <= SHORT and len(self.short) < SHORT_ENTRIES:
            self.short[piece] = ids
        return ids

    def _joined(self, pieces: Iterable[bytes]) -> bytes:
        short, young, merged = self.short.get, self.young.get, self._merged
        return b"".join([short(p) or young(p) or merged(p) for p in pieces])

    def _chunk(self, chunk: bytes) -> bytes:
        """The ids of a chunk that the young generation lacks."""
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha():  # ASCII letters
                id_bytes = self.id_bytes
                ids = b"".join([id_bytes[t.id] for t in self.model.tokenize(chunk.decode("ascii"))])
            elif b"'" in chunk:  # contractions
                ids = self._direct(chunk.decode("utf-8", "replace"))
            elif chunk.isascii():
                ids = self._joined(ASCII_PIECE.findall(chunk))
            else:
                text = chunk.decode("utf-8", "replace")
                if LATIN.fullmatch(text):
                    ids = self._joined([p.encode() for p in LATIN_PIECE.findall(text)])
                # Letters beyond Latin, and what is not yet normal or lower-cased: the whole tokenizer.
                elif max(text) > "\u024f" or text != text.lower() or not unicodedata.is_normalized("NFC", text):
                    ids = self._direct(text)
                else:
                    ids = self._joined(map(str.encode, self.pieces.findall(text)))
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        self.young[chunk] = ids
        return ids

    def encode(self, utf8: bytes) -> bytes:
        if b"<|" in utf8:  # the vocabulary's special strings are matched before lower-casing
            return self._direct(utf8.decode("utf-8", "replace"))
        words = utf8.lower().split()
        found = list(map(self.young.get, words))
        if None in found:
            get, miss = self.young.get, self._chunk
            found = [ids if ids is not None else get(w) or miss(w) for w, ids in zip(words, found, strict=True)]
        return b"".join(found)


class TournamentTree:
    """Free room of bins at the leaves, the larger of two children at each inner node."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """Takes ``need`` from the first bin that has it; returns the bin and its room before."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            node += room[node] < need
        before = room[node]
        room[node] = before - need
        leaf = node - self.size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return leaf, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; equal lengths keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = TournamentTree(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], before = tree.place(int(lengths[i]))
        offsets[i] = capacity - before
    return bins, offsets


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 4096, group_docs: int = 4096, end_id: int = 2, seed: int = 7
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and one ``end_id``; a null text has the end only. Pieces of a
    document are disjoint and cover it. Repeated rows are packed as documents each, a null id
    stays null, an empty table gives no pieces. Other columns of ``docs`` are not carried.
    Within a sequence offsets run gapless from 0 and the sum of lengths is at most ``seq_len``.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokenizer, deal, whole = CachedTokenizer(tokenizer_path), random.Random(f"{seed}:{part}"), 0
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(tokenizer.encode(text.as_py() or b"") + end)
                n, group = len(ids) // 4, deal.randrange(groups)
                for start in range(0, n, seq_len):
                    piece = ids[4 * start : 4 * (start + seq_len)]
                    full = len(piece) == 4 * seq_len
                    whole += full
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, _WHOLE | part << 36 | whole if full else None, 0, group))
            if rows:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "group"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
        del tokenizer
        give_back()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = pdf["sequence_id"].isna().to_numpy()
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy()[rest], seq_len)
        sequence = np.zeros(len(pdf), np.int64)
        sequence[~rest] = pdf["sequence_key"].to_numpy()[~rest]
        sequence[rest] = int(pdf["group"].iloc[0]) << 32 | bins
        offset = np.zeros(len(pdf), np.int64)
        offset[rest] = offsets
        return pdf.assign(sequence_id=sequence, offset=offset).drop(columns=["group", "sequence_key"])

    cuts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(cut, PIECES + ", group long")
    # Pandas reads a column with nulls as doubles, so whole sequences' ids travel in a column without.
    with batches_of(docs.sparkSession, BATCH):
        keyed = materialise(cuts.withColumn("sequence_key", F.coalesce("sequence_id", F.lit(0))))
    return keyed.groupBy("group").applyInPandas(pack, PIECES)
