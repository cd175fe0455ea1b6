"""Token ids as wavelet matrices: one compressed file a shard that can be read, counted and searched.

A file holds, for every bit of the ids from the highest, the plane of that bit over
the ids in an order that each plane refines (stable: zeros first). Rank over the planes
gives access to any id and the count of an id in any range; select gives its places.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import query, table

MAGIC = b"WMT1"
#: Ids after which a shard is closed; a document is never split, so one longer than this makes a larger shard.
SHARD_TOKENS = 1_000_000
#: Words that a worker remembers; beyond it the memory starts anew, which changes no result.
MEMO = 1_200_000
_BLOCK = 512


class WaveletMatrix:
    """Rank and select over the bit planes of a sequence of ids."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        """`planes`: packed bits, the highest bit first."""
        self.n, self.planes, self.depth = n, planes, len(planes)
        self._counts: list[np.ndarray | None] = [None] * self.depth
        self._bits: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        depth = max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        planes = []
        for level in range(depth - 1, -1, -1):
            ones = (now & now.dtype.type(1 << level)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            now = np.concatenate((np.compress(~ones, now), np.compress(ones, now)))
        return cls(len(ids), planes)

    def bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def ones(self, level: int, upto: int) -> int:
        """Set bits before place `upto` of a plane: a directory every 512 bits, then a scan inside the block."""
        counts = self._counts[level]
        if counts is None:
            padded = np.zeros(-(-max(1, self.n) // _BLOCK) * (_BLOCK // 8), np.uint8)
            padded[:len(self.planes[level])] = self.planes[level]
            counts = np.concatenate(([0], np.cumsum(np.unpackbits(padded).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64))))
            self._counts[level] = counts
        block = upto // _BLOCK
        rest = np.unpackbits(self.planes[level][block * (_BLOCK // 8):-(-upto // 8)], bitorder="little")
        return int(counts[block]) + int(rest[:upto - block * _BLOCK].sum())

    def zeros(self, level: int) -> int:
        return self.n - self.ones(level, self.n)

    def access(self, place: int) -> int:
        value = 0
        for level in range(self.depth):
            bit = int(self.planes[level][place >> 3] >> (place & 7)) & 1
            before = self.ones(level, place)
            place = self.zeros(level) + before if bit else place - before
            value = value << 1 | bit
        return value

    def _interval(self, value: int, start: int, stop: int) -> tuple[int, int]:
        if value >> self.depth:
            return 0, 0
        for level in range(self.depth):
            a, b = self.ones(level, start), self.ones(level, stop)
            if value >> (self.depth - 1 - level) & 1:
                start, stop = self.zeros(level) + a, self.zeros(level) + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id stands in [start, stop); the range is cut to the file."""
        start, stop = max(0, start), self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return 0
        a, b = self._interval(value, start, stop)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id, or -1."""
        first, last = self._interval(value, 0, self.n)
        if k < 0 or first + k >= last:
            return -1
        place = first + k
        for level in range(self.depth - 1, -1, -1):
            if value >> (self.depth - 1 - level) & 1:
                place = self._select(level, place - self.zeros(level), True)
            else:
                place = self._select(level, place, False)
        return place

    def _select(self, level: int, k: int, one: bool) -> int:
        low, high = 0, self.n  # smallest prefix that holds k + 1 such bits
        while low < high:
            middle = (low + high) // 2
            held = self.ones(level, middle + 1)
            if (held if one else middle + 1 - held) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def all(self) -> np.ndarray:
        """Every id in order: the planes undone from the lowest bit up."""
        ids = np.zeros(self.n, np.uint16 if self.depth <= 16 else np.uint32)
        before = np.empty_like(ids)
        for shift, level in enumerate(range(self.depth - 1, -1, -1)):
            ones = self.bits(level)
            first, second = np.flatnonzero(~ones), np.flatnonzero(ones)
            before[first] = ids[:len(first)]
            before[second] = ids[len(first):] | ids.dtype.type(1 << shift)
            ids, before = before, ids
        return ids.astype(np.uint32)


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file: magic, counts, document table, then every plane on its own, all compressed."""
    matrix = WaveletMatrix.build(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [known.tobytes() + names.tobytes() + np.array(lengths, "<i8").tobytes(), *[p.tobytes() for p in matrix.planes]]
    packer = zstandard.ZstdCompressor(level=1)
    packed = [packer.compress(p) for p in parts]
    head = struct.pack("<4sQQI", MAGIC, len(doc_ids), len(ids), matrix.depth)
    return head + struct.pack(f"<{len(packed)}Q", *map(len, packed)) + b"".join(packed)


def unpack_shard(content: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    magic, docs, n, depth = struct.unpack_from("<4sQQI", content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize("<4sQQI")
    sizes = struct.unpack_from(f"<{depth + 1}Q", content, at)
    at += 8 * len(sizes)
    parts, unpacker = [], zstandard.ZstdDecompressor()
    for size in sizes:
        parts.append(unpacker.decompress(content[at:at + size]))
        at += size
    known = np.frombuffer(parts[0][:docs], np.uint8)
    names = np.frombuffer(parts[0][docs:9 * docs], "<i8")
    lengths = np.frombuffer(parts[0][9 * docs:], "<i8")
    return ([d if k else None for d, k in zip(names.tolist(), known.tolist())], lengths,
            WaveletMatrix(n, [np.frombuffer(p, np.uint8) for p in parts[1:]]))


#: Signs that, behind letters, are a piece of their own before the merges.
_SIGNS = b".,!?;:&%$#*|)"
#: Letters below are Latin, Greek or Cyrillic and the same in every version of Unicode.
_SETTLED = "\u0530"


class WordEncoder:
    """Ids of texts from a tokenizer that never joins across white space: each distinct word is encoded once.

    The tokenizer folds case itself, so folding A-Z first changes nothing. A run of
    signs behind letters is split off before the merges if the letters are still letters
    alone once normalised (a mark that folding leaves behind would join the signs); and words
    of letters alone can share a call, since the last id of each is one that ends a word.

    The file's special tokens are matched in the text as it is, before folding. A text
    that holds one literally is therefore encoded whole and unfolded; the words of
    all others are taken as plain text, also where folding spells a special token.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # For lower-case letters the file's rules come down to this: nothing to normalise, words end at white space.
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.most, self.memo = memo, {}

    def encode(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        apart = {i for i, t in enumerate(texts) if any(x in t for x in self.special)}
        split = [[] if i in apart else t.lower().split() for i, t in enumerate(texts)]
        new = set(chain.from_iterable(split)).difference(self.memo)
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = set().union(*split)
        self._learn(new)
        tail, get = struct.pack("<I", end), self.memo.__getitem__
        return [np.array([*self.whole.encode(texts[i].decode(), add_special_tokens=False).ids, end], "<u4") if i in apart
                else np.frombuffer(b"".join([*map(get, words), tail]), "<u4") for i, words in enumerate(split)]

    def _kind(self, stem: bytes) -> int:
        """0: letters that normalising leaves as they are, 1: letters before and after normalising, 2: anything else."""
        text = stem.decode()
        if not text.isalpha():
            return 2
        if max(text) < _SETTLED and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return 0
        return 1 if self.tokenizer.normalizer.normalize_str(text).isalpha() else 2

    def _learn(self, new: set[bytes]) -> None:
        memo, ended = self.memo, []
        bare, letters, rest = set(), set(), set()
        for w in new:
            stem = w.rstrip(_SIGNS)
            kind = 0 if stem.isalpha() else 2 if stem.isascii() else self._kind(stem)
            if kind == 2:
                rest.add(w)
                continue
            (letters if kind else bare).add(stem)
            if len(stem) < len(w):
                rest.add(w[len(stem):])
                ended.append((w, stem))
        for words, tokenizer in ((bare, self.bare), (letters, self.tokenizer)):
            plain = [w for w in words if w not in memo]
            for at in range(0, len(plain), 1_000):
                part = plain[at:at + 1_000]
                ids = np.array(tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
                cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(cuts) != len(part):  # a word that normalises to more than letters
                    rest.update(part)
                    continue
                raw = ids.tobytes()
                memo.update(zip(part, (raw[a:b] for a, b in zip([0, *cuts], cuts))))
        single = [w for w in rest if w not in memo]
        for w, e in zip(single, self.tokenizer.encode_batch_fast([w.decode() for w in single], add_special_tokens=False)):
            ids = e.ids
            memo[w] = struct.pack(f"<{len(ids)}I", *ids)
        for w, stem in ended:
            memo[w] = memo[stem] + memo[w[len(stem):]]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """The worker's encoder, kept from task to task. A function of the module, since what a task's own function names is copied into each task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 1,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The files of all documents in ascending key order: (part, shard, n_docs, n_tokens, content).

    The files are written to the shared folder as a table with a row for each
    file, since any store that Spark reaches takes that; `content` is the whole
    file. Null texts are empty and leave the end id alone; null keys come first;
    repeated rows are all written; an empty table gives no file; other columns are not stored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The range shuffle puts the documents in order; equal keys stand by text.
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        encoder, part, shard = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        names, arrays, held = [], [], 0

        def close():
            content = pack_shard(names, [len(a) for a in arrays], np.concatenate(arrays))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()),
                                               "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([held], pa.int64()),
                                               "content": pa.array([content], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                block = batch.slice(at, 256)
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in block.column("text")]
                for name, ids in zip(block.column("doc_id").to_pylist(), encoder.encode(texts, end)):
                    names.append(name)
                    arrays.append(ids)
                    held += len(ids)
                    if held >= shard_tokens:
                        yield close()
                        names, arrays, held, shard = [], [], 0, shard + 1
        if names:
            yield close()

    return written(rows.mapInArrow(run, "part int, shard int, n_docs long, n_tokens long, content binary"), "tokens")


def read_shards(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    `start` counts the ids of all documents before it. Only the sizes of the files
    are summed across files: within a part by a window, and once over the parts.
    """
    sizes = files.select("part", "shard", "n_tokens")
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    # One row for each writing task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("_part_start"))
    starts = (sizes.join(parts, "part")
              .select("part", "shard", (F.col("_part_start") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).alias("_base")))

    def run(batches):
        for batch in batches:
            for part, shard, content in zip(batch.column("part"), batch.column("shard"), batch.column("content")):
                names, lengths, matrix = unpack_shard(content.as_buffer().to_pybytes())
                ids, ends = matrix.all(), np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
                count = len(names)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part.as_py()] * count, pa.int32()), "shard": pa.array([shard.as_py()] * count, pa.int32()),
                    "doc_id": pa.array(names, pa.int64()), "_at": pa.array(ends - lengths), "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array(sums, pa.int64())})

    docs = files.select("part", "shard", "content").mapInArrow(
        run, "part int, shard int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    return (docs.join(starts, ["part", "shard"])
            .select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_token_files")
def op6_token_files(spark, folder):
    return read_shards(write_shards(table(spark, folder, "documents"), tokenizer_path()))
