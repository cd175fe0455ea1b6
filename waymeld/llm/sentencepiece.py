"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary file is read, never trained or copied. Where it holds merge ranks
instead of log scores (a BPE model), a piece of rank r gets -log(r + 1), as if
piece frequencies fell with their rank (Zipf). The best segmentation is the one
with the largest sum of scores; of equal ones, that whose last piece is longest.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import query, table

SPACE = "▁"
_SPACE = SPACE.encode()
#: As in the library: an unknown character costs this much more than the worst piece.
UNKNOWN_COST = 10.0
#: Chunks that a worker remembers; beyond it the memory starts anew, which changes no result.
MEMO = 100_000
#: Scores are whole multiples of 2 ** -20, so that sums are exact and ties are true ties.
SCALE = 1 << 20
_NEVER = -(1 << 62)
_SHORT = 48  # bytes up to which chunks are segmented together
_TOGETHER = 8_000  # chunks of one call


@dataclass
class Vocabulary:
    """Pieces as a double array over UTF-8 bytes: base, check, and at the end of a piece its id."""
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    scores: np.ndarray
    text: list[bytes]
    byte_ids: np.ndarray
    unknown: int
    unknown_score: int
    longest: int
    splits: bool   # no piece has a space mark behind another character
    breaks: bool   # no piece has a line feed


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece model file on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(count)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(count)]
    raw = np.array([model.get_score(i) for i in range(count)], dtype=np.float64)
    normal = [i for i in range(count) if not special[i]]
    ranks = -raw[normal]
    # Merge ranks are whole numbers far below any log probability.
    is_rank = bool(len(normal)) and bool((ranks == np.round(ranks)).all()) and ranks.max() > 1000
    scores = np.where(special_array := np.array(special), 0.0, -np.log(np.maximum(-raw, 0) + 1) if is_rank else raw)
    scores = np.round(scores * SCALE).astype(np.int64)
    byte_ids = np.full(256, -1, dtype=np.int64)
    text = [b""] * count
    for i in range(count):
        if model.is_byte(i):
            value = int(names[i][3:5], 16)
            byte_ids[value], text[i] = i, bytes([value])
        elif model.is_unknown(i):
            text[i] = " ⁇ ".encode()
        elif not model.is_control(i):
            text[i] = names[i].replace(SPACE, " ").encode()
    keys = [(names[i].encode(), i) for i in normal if names[i]]
    base, check, piece = double_array(keys)
    return Vocabulary(base, check, piece, scores, text, byte_ids, model.unk_id(),
                      int(scores[~special_array].min()) - int(UNKNOWN_COST * SCALE), max(len(k) for k, _ in keys),
                      all(SPACE not in names[i].lstrip(SPACE) for i in normal), all("\n" not in names[i] for i in normal))


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trie in two arrays: the child of s over byte c is t = base[s] + c + 1 if check[t] == s. The root is 0."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for key, value in keys:
        node = 0
        for c in key:
            node = children[node].setdefault(c, len(children))
            if node == len(children):
                children.append({})
        ends[node] = value
    used = bytearray(2 * len(children) + 1024)
    used[0] = 1
    place = {0: 0}
    # Wide nodes first, near the end of the used part; single children then fill the holes in order.
    order = sorted((n for n in range(len(children)) if children[n]), key=lambda n: (-len(children[n]), n))
    bases: dict[int, int] = {}
    top, free = 0, 257
    for node in order:
        codes = sorted(children[node])
        if len(codes) == 1:
            while used[free]:
                free += 1
            at = free - codes[0] - 1
        else:
            at = max(0, top - 300)
            while any(used[at + c + 1] for c in codes):
                at += 1
        bases[node] = at
        for c in codes:
            used[at + c + 1] = 1
        top = max(top, at + codes[-1] + 1)
        if top + 600 > len(used) or free + 2 > len(used):
            used.extend(bytes(len(used)))
    base, check, piece = (np.zeros(len(used) + 258, np.int32), np.full(len(used) + 258, -1, np.int32), np.full(len(used) + 258, -1, np.int32))
    walk = [0]
    for node in walk:
        if node in bases:
            base[place[node]] = bases[node]
            for c, child in children[node].items():
                place[child] = bases[node] + c + 1
                check[place[child]] = place[node]
                walk.append(child)
        if node in ends:
            piece[place[node]] = ends[node]
    return base, check, piece


def _char_length(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def viterbi(v: Vocabulary, chunk: bytes) -> list[int]:
    """Ids of one chunk (space marks in place), one step at a time: for long chunks."""
    base, check, piece, scores = v.base, v.check, v.piece, v.scores
    n = len(chunk)
    best, back, came = [_NEVER] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
    best[0] = 0
    for i in range(n):
        if best[i] == _NEVER:
            continue
        state, j, single = 0, i, i + _char_length(chunk[i])
        covered = False
        while j < n:
            target = int(base[state]) + chunk[j] + 1
            if check[target] != state:
                break
            state, j = target, j + 1
            found = int(piece[state])
            if found >= 0:
                covered |= j == single
                score = best[i] + int(scores[found])
                if score > best[j]:
                    best[j], back[j], came[j] = score, found, i
        if not covered and best[i] + v.unknown_score > best[single]:
            best[single], back[single], came[single] = best[i] + v.unknown_score, v.unknown, i
    ids: list[int] = []
    at = n
    while at:
        start = came[at]
        ids += [back[at]] if back[at] != v.unknown else _bytes_of(v, chunk[start:at])[::-1]
        at = start
    return ids[::-1]


def _bytes_of(v: Vocabulary, char: bytes) -> list[int]:
    own = [int(v.byte_ids[c]) for c in char]
    return own if min(own) >= 0 else [v.unknown]


def viterbi_many(v: Vocabulary, chunks: list[bytes]) -> list[bytes]:
    """The same for many short chunks at once, as little-endian unsigned 32-bit ids.

    Array steps over all chunks: start by start and byte by byte forwards, then piece by piece back.
    """
    n = len(chunks)
    sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=n)
    width = int(sizes.max(initial=0))
    codes = np.zeros((n, width + 1), dtype=np.int32)
    flat = np.frombuffer(b"".join(chunks), dtype=np.uint8)
    codes[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    best = np.full((n, width + 5), _NEVER, dtype=np.int64)
    back = np.full((n, width + 5), -1, dtype=np.int32)
    came = np.full((n, width + 5), -1, dtype=np.int16)
    best[:, 0] = 0
    for i in range(width):
        rows = np.flatnonzero((sizes > i) & (best[:, i] > _NEVER))
        if not len(rows):
            continue
        lead = codes[rows, i]
        single = i + np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        covered = np.zeros(n, dtype=bool)
        live, state, ends = rows, np.zeros(len(rows), dtype=np.int32), single
        for j in range(i, min(width, i + v.longest)):
            target = v.base[state] + codes[live, j] + 1
            ok = (v.check[target] == state) & (sizes[live] > j)
            live, state, ends = live[ok], target[ok], ends[ok]
            if not len(live):
                break
            found = v.piece[state]
            hit = found >= 0
            r, f = live[hit], found[hit]
            covered[r[ends[hit] == j + 1]] = True
            score = best[r, i] + v.scores[f]
            better = score > best[r, j + 1]
            r = r[better]
            best[r, j + 1], back[r, j + 1], came[r, j + 1] = score[better], f[better], i
        open_ = ~covered[rows]
        r, e = rows[open_], single[open_]
        score = best[r, i] + v.unknown_score
        better = score > best[r, e]
        r, e = r[better], e[better]
        best[r, e], back[r, e], came[r, e] = score[better], v.unknown, i
    at, steps, every = sizes.copy(), [], np.arange(n)
    odd = np.zeros(n, dtype=bool)  # chunks with an unknown character go one by one
    while (at > 0).any():
        ids = np.where(at > 0, back[every, at], -1)
        odd |= ids == v.unknown
        steps.append(ids)
        at = np.where(at > 0, came[every, at], 0)
    table = np.array(steps[::-1], dtype=np.int64).reshape(len(steps), n).T
    counts = (table >= 0).sum(axis=1)
    flat_ids = table[table >= 0].astype("<u4").tobytes()
    ends = (4 * np.cumsum(counts)).tolist()
    out = [flat_ids[a:b] for a, b in zip([0, *ends], ends)]
    for i in np.flatnonzero(odd).tolist():
        out[i] = np.array(viterbi(v, chunks[i]), dtype="<u4").tobytes()
    return out


class Encoder:
    """Encodes and decodes texts; equal chunks are segmented once while remembered.

    If no piece holds a space mark behind another character, the best path has a
    border before every run of marks, so each chunk is a problem of its own; a
    line feed that is in no piece stands alone likewise.
    """

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO):
        self.v, self.most = vocabulary, memo
        self.memo: dict[bytes, bytes] = {}
        self.pattern = (None if not vocabulary.splits else re.compile(rb"\n| *[^ \n]+| +") if vocabulary.breaks
                        else re.compile(rb" *[^ ]+| +"))

    def _chunks(self, text: bytes) -> list[bytes]:
        # The mark itself in a text means the same as a space.
        text = b" " + text.replace(_SPACE, b" ") if text else b""
        return self.pattern.findall(text) if self.pattern else [text] if text else []

    def _learn(self, new: list[bytes]) -> None:
        marked = [c.replace(b" ", _SPACE) for c in new]
        short = [(c, m) for c, m in zip(new, marked) if len(m) <= _SHORT]
        short.sort(key=lambda x: len(x[1]))
        for at in range(0, len(short), _TOGETHER):
            part = short[at:at + _TOGETHER]
            for (c, _), ids in zip(part, viterbi_many(self.v, [m for _, m in part])):
                self.memo[c] = ids
        for c, m in zip(new, marked):
            if len(m) > _SHORT:
                self.memo[c] = np.array(viterbi(self.v, m), dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [self._chunks(t) for t in texts]
        new = set().union(*split).difference(self.memo)
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = set().union(*split)
        self._learn(list(new))
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, chunks)), dtype="<u4") for chunks in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the pieces in order, without the space that encoding put in front."""
        out = b"".join(map(self.v.text.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


_encoders: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    key, vocabulary = shared.value
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _blocks(batch: pa.RecordBatch, text: str, limit: int = 1_000_000):
    """Slices of a batch of some million bytes, so that a batch of long texts stays small in memory."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)], dtype=np.int64)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _share(spark, path: str):
    vocabulary = load_vocabulary(path)  # one vocabulary file, some MB at most
    return spark.sparkContext.broadcast((hashlib.sha256(open(path, "rb").read()).hexdigest(), vocabulary))


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All columns of `docs`, or those named in `keep`, and `ids` (array of int). Null texts count as empty and get no ids.

    A column named ids is replaced. Rows stay where they are: no shuffle. Without the
    text in `keep`, texts go to the workers but not back.
    """
    rows = docs.drop(*([] if text == "ids" else ["ids"]))
    kept = [c for c in rows.columns if keep is None or c in keep]
    rows = rows.select(*dict.fromkeys([*kept, text])) if keep is not None else rows
    schema = T.StructType([*[f for f in rows.schema.fields if f.name in kept], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    shared = _share(docs.sparkSession, path)

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            for block in _blocks(batch, text):
                ids = encoder.encode(_texts(block.column(text)))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([*[block.column(c) for c in kept], column], names=[*kept, "ids"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of `encoded` and the text of the ids; bytes that are no UTF-8 become the replacement character."""
    rows = encoded.drop(text)
    shared = _share(encoded.sparkSession, path)

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            column = batch.column(ids)
            out = [encoder.decode(np.asarray(x.values)).decode("utf-8", "replace") if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_sentencepiece")
def op10_sentencepiece(spark, folder, path: str | None = None):
    """Per document: ids, byte-fallback ids, a checksum of the ids, and whether decoding gives the text back.

    Encoding and decoding share a pass, so the id arrays never leave the worker.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text")
    shared = _share(spark, path or model_path())

    def run(batches):
        encoder = _encoder(shared)
        is_byte = np.zeros(len(encoder.v.text), dtype=bool)
        is_byte[encoder.v.byte_ids[encoder.v.byte_ids >= 0]] = True
        for batch in batches:
            for block in _blocks(batch, "text"):
                texts = _texts(block.column("text"))
                out = []
                for raw, ids in zip(texts, encoder.encode(texts)):
                    back = encoder.decode(ids)
                    out.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.tobytes()), hashlib.sha256(back).hexdigest(), back == raw))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]],
                    names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.mapInArrow(run, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
