"""Token alignment, embedding near-dedup and fill-in-the-middle against plain versions."""

import hashlib
from collections import Counter
from functools import cache
from math import isfinite

import numpy as np
import pytest

from waymeld.llm import embedding_dedup as E
from waymeld.llm import fill_in_middle as M
from waymeld.llm import token_alignment as A

PATHS = A.path_of("byte_bpe_50k.json"), A.path_of("piece_bpe_32k.model")


@cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain_tokens(text):
    """(ids, ends) of both sides from the decoded bytes alone, or nothing."""
    if not text:
        return None
    a, b = libraries()
    letters, raw = A.byte_letters(), (" " + text).encode()
    x = a.encode(" " + text, add_special_tokens=False)
    y = b.encode(text)
    bytes_a = [bytes(letters[c] for c in t) for t in x.tokens]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
    return list(zip(x.ids, ends(bytes_a))), list(zip(y, ends(bytes_b)))


def plain_alignment(texts):
    """The contract by loops, over (key, text) rows."""
    rows, counts = [], Counter()
    for key, text in texts:
        found = plain_tokens(text)
        groups, links = [], []
        if found:
            a, b = found
            cuts = sorted({e for _, e in a} & {e for _, e in b})
            low = 0
            for cut in cuts:
                groups.append("|".join(",".join(str(i) for i, e in side if low < e <= cut) for side in (a, b)))
                links += [(i, j) for i, e in a if e == cut for j, f in b if f == cut]
                low = cut
        counts.update(links)
        rows.append((key, len(found[0]) if found else 0, len(found[1]) if found else 0, groups, links))
    top = {}
    for (i, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    return [(key, na, nb, len(groups), len(links), sum(counts[k] == top[k[1]] for k in links), sum(counts[k] for k in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for key, na, nb, groups, links in rows]


TEXTS = ["", None, " ", "  two  spaces ", "plain words here", "é漢😀 ab\n\nx", "<|endoftext|> </s> <s> <0x41>", "mark ▁ inside", "\x00\x01 nul", "naïve Ελλάδα עברית हिन्दी 한국어",
         "👩‍👩‍👧‍👦🏳️‍🌈", "a" * 500, "tabs\t\tand\r\nlines\n \n", "1234567890.5e-10", "  x", "İstanbul ǅ ﬁ", "�퟿\U0010ffff"]


@pytest.fixture(scope="module")
def answer(spark, tmp_path_factory):
    def run(rows):
        folder = str(tmp_path_factory.mktemp("align"))
        spark.createDataFrame(rows, "doc_id long, text string, pair string, doc string").write.parquet(f"{folder}/documents.parquet")
        return A.op11_token_alignment(spark, folder)
    return run


def test_alignment_matches_plain_loops(answer):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no key"), (90, "plain words here again and again"), (91, "plain words here")]
    got = answer([(k, t, "x", "y") for k, t in rows])
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    order = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(plain_alignment(rows), key=order)
    assert answer([]).count() == 0


def test_alignment_of_real_rows(spark, real):
    got = {r["doc_id"]: tuple(r) for r in A.op11_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    # The plain loops are quadratic in a text, so they take one by groups of a cursor here.
    rows = [(r["doc_id"], r["text"]) for r in real.collect()]
    counts, each = Counter(), {}
    for key, text in rows:
        found = plain_tokens(text)
        if not found:
            each[key] = (0, 0, "", [])
            continue
        ends_b, links, groups, last = dict((e, i) for i, e in found[1]), [], [], 0
        at, b = 0, found[1]
        own_a, own_b = [], []
        for i, e in found[0]:
            own_a.append(i)
            if e in ends_b:
                while at < len(b) and b[at][1] <= e:
                    own_b.append(b[at][0])
                    at += 1
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                links.append((i, ends_b[e]))
                own_a, own_b = [], []
        counts.update(links)
        each[key] = (len(found[0]), len(b), ";".join(groups), links)
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    for key, (na, nb, groups, links) in each.items():
        want = (key, na, nb, len(links), len(links), sum(counts[k] == top[k[1]] for k in links), sum(counts[k] for k in links),
                hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert got[key] == want
    assert len(got) == len(rows)


def test_chunks_change_nothing():
    """Chunk by chunk against whole texts, over texts rich in white space, marks and rare characters."""
    rng = np.random.default_rng(8)
    signs = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "'s", "é", "漢", "😀", "9", ".", "\u0301", "<s>", "\r", "x" * 30]
    texts = ["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(400)]
    pair = A.Pair(*PATHS, memo=2_000)
    assert pair.cuttable
    for at in range(0, 400, 50):
        for text, chunks in zip(texts[at:at + 50], pair.remembered(texts[at:at + 50])):
            a, b = plain_tokens(text)
            assert [i for c in chunks for i in c[0].tolist()] == [i for i, _ in a]
            assert [i for c in chunks for i in c[2].tolist()] == [i for i, _ in b]
    assert pair.remembered(["no mark ▁ here", "", None]) == [[], [], []]


def test_alignment_spans_and_bound(docs):
    rows = A.align(docs, *PATHS).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert set(r["cuts"]) == set(r["ends_a"]) & set(r["ends_b"])
        assert r["ends_a"] == sorted(set(r["ends_a"])) and r["ends_b"] == sorted(set(r["ends_b"]))
    bound = A.possible_pairs(A.byte_vocabulary(PATHS[0]), A.piece_vocabulary(PATHS[1]))
    assert A.alignment_counts(docs, *PATHS)[1].count() <= bound < 1_000_000


VECTORS = "vec_id long, embedding array<float>, label int, c string, n_links int, h0 int, component int"


def plain_vectors(rows, cosine):
    """Every pair of rows, one by one."""
    def unit(v):
        if v is None or not v or any(c is None or not isfinite(c) for c in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        x = x / np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    units = [unit(r[1]) if r[0] is not None and r[2] is not None else None for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):  # chains: each vector near the last one only
        x = rng.standard_normal(12)
        for _ in range(g % 7 + 1):
            rows.append((len(rows), x.tolist(), g % 3))
            x = x + rng.standard_normal(12) * 0.05 * np.linalg.norm(x)
    base = rng.standard_normal(12)
    rows += [(1000 + i, (base + rng.standard_normal(12) * 0.02).tolist(), 1) for i in range(60)]  # all near each other
    rows += [(2000 + i, base.tolist(), 2) for i in range(30)] + [(2000, base.tolist(), 2), (7, (base * 1e30).tolist(), 2)]  # copies, a repeated row, a used key
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 12, 1), (3003, [None] + [1.0] * 11, 1), (3004, [float("nan")] * 12, 1), (3005, [float("inf")] * 12, 1),
             (3006, base.tolist(), None), (None, base.tolist(), 2), (3007, base.tolist()[:11], 2), (3008, [-0.0] + [0.0] * 10 + [1.0], 0), (3009, [0.0] * 11 + [2.0], 0)]
    rows = [(k, None if v is None else [None if c is None else float(np.float32(c)) for c in v], g) for k, v, g in rows]
    df = spark.createDataFrame([(*r, "x", 5, 5, 5) for r in rows], VECTORS).repartition(3)
    got = E.near_vectors(df, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_vectors(rows, E.COSINE)
    if block == 16:
        assert E.near_vectors(df.limit(0)).count() == 0


def test_tables_keep_the_miss_chance():
    for n in (2, 500, 10**6, 10**9):
        tables, hashes, width = E.tables_for(n)
        assert (1 - E.share((2 - 2 * E.COSINE) ** 0.5, width) ** hashes) ** tables <= E.MISS
    assert E.tables_for(10**9)[0] > E.tables_for(10**4)[0]


def plain_middle(key, text):
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    text = text or ""
    units = text.split("\n")
    units = [u + "\n" for u in units[:-1]] + ([units[-1]] if units[-1] else [])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return key, len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 50
    return key, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, real):
    odd = ["\n", "\n\n\n", "a\n", "a\nb", "<P", "x<P>y", "<\n<S", "é\n漢字\n😀" * 900, "z" * 20_000, "same line\n" * 3000, "\r\n\x00\n", "<S\n>P>\n<M"]
    more = spark.createDataFrame([(100 * j + i, t, 1, "f") for j in range(5) for i, t in enumerate(odd)], "doc_id long, text string, n int, output string")
    for rows in (docs, real, more):
        found = M.fill_in_middle(rows)
        assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = found.withColumn("back", M.restored(found.output, found.form)).collect()
        want = [plain_middle(r["doc_id"], r["text"]) for r in rows.collect()]
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
        assert sorted(r["back"] for r in got) == sorted(r["text"] or "" for r in rows.collect())
    assert M.fill_in_middle(docs.limit(0)).count() == 0


def test_rates_of_fill_in_middle(real):
    assert {r["form"] for r in M.fill_in_middle(real, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in M.fill_in_middle(real, spm=0).where("form <> 'plain'").collect()} == {"psm"}


def test_chunks_follow_contents_and_memory_is_bounded():
    rng = np.random.default_rng(1)
    body = bytes(rng.integers(32, 127, 30_000, np.uint8))
    for raw in (b"", b"x", b"a" * 50_000, body):
        ends = M.chunk_ends(raw)
        assert "".join("x" * (b - a) for a, b in zip([0, *ends], ends)) == "x" * len(raw)
        assert all(b - a <= M.MOST for a, b in zip([0, *ends], ends))
    cut = lambda raw: {raw[a:b] for a, b in zip([0, *M.chunk_ends(raw)], M.chunk_ends(raw))}
    assert len(cut(body) & cut(b"some words in front " + body)) > 0.9 * len(cut(body))
    memory = M.ChunkMemory(most=2_000)
    for at in range(0, 30_000, 3_000):
        lines = memory.lines(body[at:at + 9_000])
        assert memory.held <= 2_000 + M.MOST + 200 and lines.count == len(body[at:at + 9_000].splitlines() or [])
