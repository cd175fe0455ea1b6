"""Two tokenizers over the same texts: where their tokens end together, and which ids stand in for each other.

Each tokenizer's own spans are the coarse cuts: character offsets of a byte-level BPE,
byte spans of a SentencePiece model. Tokens that share a character, or a byte-fallback run,
have one span together; there the decoded bytes of the tokens tell where each ends.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import query, table

#: Characters of texts that a task takes at once; a longer text goes alone.
TOGETHER = 500_000
#: Bytes of chunks that a task remembers.
MEMO_BYTES = 160_000_000
#: Chunks of one call.
TOGETHER_CHUNKS = 4_000
_SPACE = "▁"
#: In front of a space or line feed behind a character that is no white space.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def byte_letters() -> dict[str, int]:
    """The letter of every byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others for 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_vocabulary(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level tokenizer file; special tokens, which plain text never becomes, have none."""
    from tokenizers import Tokenizer

    model, letters = Tokenizer.from_file(path), byte_letters()
    names = model.get_vocab(with_added_tokens=False)
    out = [b""] * (max(model.get_vocab(with_added_tokens=True).values()) + 1)
    for name, i in names.items():
        out[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else b""
    return out


def piece_vocabulary(path: str) -> list[bytes]:
    """Bytes of every id of a SentencePiece file: the mark is a space, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(_SPACE, " ").encode()
            for i in range(model.get_piece_size())]


def possible_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs can ever end together in equal texts: one token's bytes end the other's. Bounds the table of pair counts."""
    def ends_of(vocabulary):
        count: dict[bytes, int] = {}
        for x in vocabulary:
            if x:
                count[x] = count.get(x, 0) + 1
        return count

    in_a, in_b = ends_of(a), ends_of(b)
    longer_a = sum(n * in_b.get(x[i:], 0) for x, n in in_a.items() for i in range(len(x)))
    return longer_a + sum(n * in_a.get(x[i:], 0) for x, n in in_b.items() for i in range(1, len(x)))


def token_ends(starts: np.ndarray, stops: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte end of every token from coarse spans; tokens of a shared or empty span end where their bytes do."""
    if not len(starts):
        return np.zeros(0, np.int64)
    far = np.maximum.accumulate(stops)
    opens = np.ones(len(starts), bool)
    opens[1:] = (starts[1:] >= far[:-1]) & (stops[:-1] > starts[:-1])
    first = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    alone = np.append(np.diff(first), len(starts) - first[-1])[run] == 1
    total = np.cumsum(lengths)
    return np.where(alone, stops, starts[first][run] + total - (total - lengths)[first][run])


def _parts(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts)[:-1])


def spelled(ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, names: list[bytes]) -> list[bytes]:
    """The parts of `a1,a2|b1;a3|b2,b3;`: the ids of each group by A, then by B. `names` holds every id with a comma, then with a bar, then with a semicolon."""
    size = len(names) // 3
    place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)  # B's tokens of earlier groups stand before
    place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
    last = lambda g: np.append(g[1:] != g[:-1], True)
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[place_a] = ids_a + size * last(group_a)
    order[place_b] = ids_b + 2 * size * last(group_b)
    return list(map(names.__getitem__, order.tolist()))


class Pair:
    """Both tokenizers of a task, with a memory of chunks.

    A text with its space in front is cut before each space or line feed that follows a
    visible character. Neither tokenizer has a token across such a place: the
    byte-level pattern never takes white space behind other characters, and the pieces hold
    no space mark behind another character and no line feed (`cuttable` looks both up;
    where it fails a text is one chunk). So a chunk's tokens do not depend on its surroundings,
    and each distinct chunk is encoded and aligned once.
    """

    def __init__(self, path_a: str, path_b: str, memo: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = byte_vocabulary(path_a), piece_vocabulary(path_b)
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.cuttable, self.mark = cuttable(path_a, self.b), self.b.piece_to_id(_SPACE)
        self.most, self.held, self.memo = memo, 0, {}

    def make(self, ids_a, ends_a, ids_b, ends_b, n_a, n_b, stops):
        """What is remembered of each of several chunks in a row: ids and byte ends."""
        starts = np.append(0, stops[:-1])
        return zip(_parts(ids_a, n_a), _parts(ends_a - np.repeat(starts, n_a), n_a), _parts(ids_b, n_b), _parts(ends_b - np.repeat(starts, n_b), n_b))

    def chunks(self, text: str) -> list[str]:
        return _CUT.split(" " + text) if self.cuttable else [" " + text]

    def remembered(self, texts: list[str | None]) -> list[list]:
        """What `make` gave for the chunks of each text; nothing where the text is empty or its tokens do not spell it."""
        split = [self.chunks(t) if t else [] for t in texts]
        if self.held > self.most:  # changes no result
            self.memo, self.held = {}, 0
        new = list(set(chain.from_iterable(split)).difference(self.memo))
        self.memo.update(dict.fromkeys(new))
        # Only a text's last chunk can end in white space, which would run into the next one.
        for at in range(0, len(new), TOGETHER_CHUNKS):
            part = [c for c in new[at:at + TOGETHER_CHUNKS] if _SPACE not in c]  # B spells a literal mark as a space
            self._learn([c for c in part if not c[-1].isspace()])
            for c in part:
                if c[-1].isspace():
                    self._learn([c])
        out = []
        for chunks in split:
            found = list(map(self.memo.__getitem__, chunks))
            out.append([] if None in found else found)
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks in one call, since no token lies across their borders."""
        if not chunks:
            return
        whole = "".join(chunks)
        raw, bare = whole.encode(), not whole.startswith(" ")
        x = self.a.encode(whole, add_special_tokens=False)
        # B puts a space in front itself: it gets the text without its own, and loses the one before a line feed again.
        y = self.b.encode(raw if bare else raw[1:], return_type="offset_mapping", num_threads=1)
        ids, offsets = (y["ids"], y["offsets"]) if raw != b" " else ([self.mark], [(0, 0)])
        if bare and ids[0] == self.mark:
            ids, offsets = ids[1:], offsets[1:]
        listed = x.ids
        if b"".join(map(self.bytes_a.__getitem__, listed)) != raw or b"".join(map(self.bytes_b.__getitem__, ids)) != raw:
            if len(chunks) > 1:
                for c in chunks:
                    self._learn([c])
            return
        sizes = np.array([len(c) for c in chunks])
        ids_a, ids_b = np.array(listed, np.int64), np.array(ids, np.int64)
        spans_a, spans_b = (np.fromiter(chain.from_iterable(o), np.int64, 2 * len(o)).reshape(-1, 2) for o in (x.offsets, offsets))
        heads = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        spans_a, stops = heads[spans_a], heads[np.cumsum(sizes)]  # characters to bytes
        if not bare:
            spans_b = spans_b + 1
            spans_b[0, 0] = 0  # the space that B adds itself
        ends_a = token_ends(spans_a[:, 0], spans_a[:, 1], self.lengths_a[ids_a])
        ends_b = token_ends(spans_b[:, 0], spans_b[:, 1], self.lengths_b[ids_b])
        upto_a, upto_b = np.searchsorted(ends_a, stops, "right"), np.searchsorted(ends_b, stops, "right")
        self.memo.update(zip(chunks, self.make(ids_a, ends_a, ids_b, ends_b, np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0), stops)))
        self.held += 400 * len(chunks) + 3 * len(raw)


class Linked(Pair):
    """Remembers of each chunk: (tokens of A, tokens of B, spelling of its groups, links as a * (ids of B) + b)."""

    def __init__(self, path_a: str, path_b: str, memo: int = MEMO_BYTES):
        super().__init__(path_a, path_b, memo)
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.names = [b"%d%c" % (i, sign) for sign in b",|;" for i in range(most)]

    def make(self, ids_a, ends_a, ids_b, ends_b, n_a, n_b, stops):
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        parts = spelled(ids_a, np.searchsorted(cuts, ends_a), ids_b, np.searchsorted(cuts, ends_b), self.names)
        # Every token has bytes, so one token of each side ends at a cut.
        links = ids_a[np.searchsorted(ends_a, cuts)] * len(self.bytes_b) + ids_b[np.searchsorted(ends_b, cuts)]
        raw, upto, at, low = links.tobytes(), (8 * np.searchsorted(cuts, stops, "right")).tolist(), 0, 0
        for a, b, high in zip(n_a.tolist(), n_b.tolist(), upto):
            yield a, b, b"".join(parts[at:at + a + b]), raw[low:high]
            at, low = at + a + b, high


def cuttable(path_a: str, b) -> bool:
    """Whether no token of either side lies across a visible character and a following space or line feed."""
    with open(path_a) as f:
        rule = json.load(f).get("pre_tokenizer") or {}
    pieces = (b.id_to_piece(i) for i in range(b.get_piece_size()) if not (b.is_control(i) or b.is_unknown(i) or b.is_byte(i)))
    return rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in pieces)


_pairs: dict[tuple, Pair] = {}


def _aligned(batches, path_a: str, path_b: str, kind):
    """(keys, what is remembered of each text's chunks) of blocks of bounded text. A worker keeps its memory from task to task."""
    if (path_a, path_b, kind) not in _pairs:
        _pairs.clear()
        _pairs[path_a, path_b, kind] = kind(path_a, path_b)
    pair = _pairs[path_a, path_b, kind]
    for batch in batches:
        texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= TOGETHER):
                size += len(texts[to] or "")
                to += 1
            yield keys[at:to], pair.remembered(texts[at:to])
            at = to


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids_a, ends_a, ids_b, ends_b, cuts) of every row: ids, their byte ends in space+text, and the ends that both share.

    No shuffle. Null and empty texts, and texts that the tokens do not spell exactly (such as
    those with a literal space mark), have empty arrays; strings of special tokens are plain text; repeated rows repeat
    their result; a null key stays null; an empty table gives no rows; other columns are
    not passed on. Whole texts are encoded, so a worker holds the tokens of the longest one.
    """
    def run(batches):
        for keys, found in _aligned(batches, path_a, path_b, Pair):
            columns: list[list] = [[] for _ in range(5)]
            for chunks in found:
                parts = [np.concatenate(x) for x in zip(*chunks)] if chunks else [np.zeros(0, np.int64)] * 4
                if chunks:
                    starts = np.cumsum([0, *(c[1][-1] for c in chunks[:-1])])
                    for j in (1, 3):
                        parts[j] = parts[j] + np.repeat(starts, [len(c[j]) for c in chunks])
                for column, part in zip(columns, [*parts, np.intersect1d(parts[1], parts[3], assume_unique=True)]):
                    column.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(c, pa.list_(pa.int64())) for c in columns]],
                                             names=["doc_id", "ids_a", "ends_a", "ids_b", "ends_b", "cuts"])

    return _rows(docs, key, text).mapInArrow(run, "doc_id long, ids_a array<long>, ends_a array<long>, ids_b array<long>, ends_b array<long>, cuts array<long>")


def alignment_counts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc, doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times) by row, and (a, b, pair, n, best) by linked id pair.

    `pairs` holds a row's distinct linked id pairs as a * (ids of B) + b, `times` how often
    each is linked. `best`: no other id of A is linked with b more often. The pair
    table is bounded by the vocabularies (`possible_pairs`), whatever the documents.
    Rows are encoded once, into a table in the shared folder. Edge cases as in `align`.
    """
    size = len(piece_vocabulary(path_b))

    def run(batches):
        for keys, found in _aligned(batches, path_a, path_b, Linked):
            rows = []
            for chunks in found:
                if not chunks:
                    rows.append((0, 0, 0, "", [], []))
                    continue
                a, b, text, links = zip(*chunks)
                linked = np.frombuffer(b"".join(links), np.int64)
                pairs, times = np.unique(linked, return_counts=True)
                rows.append((sum(a), sum(b), len(linked), hashlib.sha256(b"".join(text)[:-1]).hexdigest(), pairs, times))
            n_a, n_b, n_groups, digests, pairs, times = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)], pa.array(digests, pa.string()),
                 pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    found = _rows(docs, key, text).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>")
    rows = written(found.withColumn("doc", F.monotonically_increasing_id()), "alignments")
    links = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counts = written(links.groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts")
    counts = counts.select(F.floor(F.col("pair") / size).cast("long").alias("a"), (F.col("pair") % size).alias("b"), "pair", "n")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return rows, counts.join(top, "b").select("a", "b", "pair", "n", (F.col("n") == F.col("top")).alias("best"))


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op11_token_alignment")
def op11_token_alignment(spark, folder):
    rows, counts = alignment_counts(table(spark, folder, "documents"), path_of("byte_bpe_50k.json"), path_of("piece_bpe_32k.model"))
    each = rows.select("doc", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("doc", F.col("l.pairs").alias("pair"), F.col("l.times").cast("long").alias("times"))
    # The pair table is bounded by the vocabularies, so it fits in every task.
    sums = (each.join(F.broadcast(counts.select("pair", "n", "best")), "pair").groupBy("doc")
            .agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    none = F.lit(0).cast("long")
    return rows.join(sums, "doc", "left").select("doc_id", "n_a", "n_b", "n_groups", *[F.coalesce(c, none).alias(c) for c in ("n_links", "n_best", "count_sum")], "groups_sha256")
