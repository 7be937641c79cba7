"""Best-fit packing: documents become token pieces of at most one sequence, and pieces are packed by bounded-space online best-fit.

Tokenizing runs where the documents are; what moves are a few numbers for each piece. Pieces are dealt by hash to packers,
each of which reads a stream of them and keeps a fixed number of open sequences. A bitset has one bit for each amount of free
space that some open sequence has, so the best fit is the lowest set bit at or above the piece's length. A full sequence closes;
when too many are open, the fullest closes first. Only what is open at a packer's end is lost, and one packer takes about
`packer_sequences` sequences, so the loss doesn't grow with the corpus.

Defined results: a null or empty text has only the end id, one piece of length 1; a repeated row gives its pieces again; a
null doc_id stays null. Strings of special tokens inside texts are read as the tokenizer's file says.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import materialize

LENGTH = 2048
END_ID = 0
OPEN = 4_096
PACKER_SEQUENCES = 20_000
CACHE_WORDS = 600_000
CACHED_OCTETS = 64
_NEWLINE = bytes(0x20 if c == 0x0A else c for c in range(256))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Chunks that may be split here: printable ASCII and Latin letters that no normalisation changes but lower case.
_PLAIN = regex.compile("[!-~\xa1-\u012f\u0131-\u024f]+")
#: The tokenizer's own split, and its map from bytes to printable characters.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: chr(b if b in _PRINTABLE else 256 + sum(c not in _PRINTABLE for c in range(b))) for b in range(256)}


#: What the file of a tokenizer that may be run word by word says of its normalizer, its split and the end of a word.
_KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "BPE",
    "</w>",
)


def _kind(path: str) -> tuple:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    return told.get("normalizer"), told.get("pre_tokenizer"), told["model"].get("type"), told["model"].get("end_of_word_suffix")


class WordEncoder(dict):
    """Ids of texts, as bytes of unsigned 32-bit numbers, for a lower-casing byte-level BPE whose tokens never reach over a space.

    Texts are cut at spaces and newlines, and each distinct short chunk is encoded once and kept here. The words of plain chunks go to
    the BPE model directly; any other chunk, such as one with marks to be composed or with a special token, goes through the
    whole tokenizer.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__({b"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        # Any other kind of tokenizer encodes whole texts.
        self.by_word = _kind(path) == _KIND
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache_words = cache_words
        self.parts: dict[str, bytes] = {}

    def _part(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        if len(shown) <= CACHED_OCTETS:
            self.parts[word] = ids
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        known = self.parts.get
        if text.isascii() and text.isalpha():
            word = text.lower()
            ids = known(word) or self._part(word)
        elif _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            ids = b"".join([known(w) or self._part(w) for w in _SPLIT.findall(text.lower())])
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= CACHED_OCTETS:
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not self.by_word:
            return array("I", self.tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()
        if len(self) > self.cache_words:
            self.clear()
            self.parts.clear()
        return b"".join(map(self.__getitem__, text.encode().translate(_NEWLINE).split(b" "))) if text else b""


@cache
def _encoder(path: str) -> WordEncoder:
    """One for each Python worker, which keeps what it has learnt from one task to the next."""
    return WordEncoder(path)


def pieces(documents: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of every document; with_ids adds the ids as array<int>."""
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = np.array([end_id], "<u4").tobytes()
    size = 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: list[list] = [[], [], [], [], []]
                ids: list[np.ndarray] = []
                for doc, raw in zip(part.column(0).to_pylist(), map(encoder.encode, part.column(1).to_pylist())):
                    raw += end
                    for k, s in enumerate(range(0, len(raw), size)):
                        own = raw[s : s + size]
                        for column, value in zip(columns, (doc, k, s // 4, len(own) // 4, zlib.crc32(own))):
                            column.append(value)
                        if with_ids:
                            ids.append(np.frombuffer(own, "<i4"))
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.list_(pa.int32()))] if with_ids else arrays, [*names, "ids"] if with_ids else names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


class BestFit:
    """Bounded-space online best-fit. place() gives the sequence and the offset of a piece."""

    def __init__(self, length: int, most_open: int):
        self.length, self.most_open = length, most_open
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.opened = 0

    def place(self, size: int) -> tuple[int, int]:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bins = self.by_free[free]
            number = bins.pop()
            self.open -= 1
            if not bins:
                self.bits ^= 1 << free
        else:
            free, number = self.length, self.opened
            self.opened += 1
        left = free - size
        if left:
            if self.open == self.most_open:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.by_free[fullest].pop()
                self.open -= 1
                if not self.by_free[fullest]:
                    self.bits ^= 1 << fullest
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.length - free


def pack(found: DataFrame, length: int = LENGTH, most_open: int = OPEN, packer_sequences: int = PACKER_SEQUENCES) -> DataFrame:
    """Pieces (with at least doc_id, piece and length) and their sequence_id and offset. found is read twice; materialize it."""
    total = found.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-total // (length * packer_sequences)))
    names = list(found.columns)
    schema = found.select(*names, F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = BestFit(length, most_open)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*names, "sequence_id", "offset"])

    # The order is random, for equal rows too, but that of a table doesn't change, so a task that is run again packs alike.
    dealt = found.withColumn("_order", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()))
    return dealt.repartition(packers, "_order").sortWithinPartitions("_order", "doc_id", "piece").drop("_order").mapInArrow(run, schema)


def pack_documents(documents: DataFrame, tokenizer: str | None = None, length: int = LENGTH, most_open: int = OPEN) -> DataFrame:
    return pack(materialize(pieces(documents, tokenizer, length), "pieces"), length, most_open)


def sequences(documents: DataFrame, tokenizer: str | None = None, length: int = LENGTH, most_open: int = OPEN) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves. A sequence has at most `length` ids, so a group is bounded."""
    packed = pack(materialize(pieces(documents, tokenizer, length, with_ids=True), "pieces"), length, most_open)
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids"))
