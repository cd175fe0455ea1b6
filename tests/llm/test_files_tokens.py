"""Chat text, WARC, token files, SentencePiece and the pipeline: round trips and plain versions."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymeld.llm import chat_format as C
from waymeld.llm import sentencepiece as P
from waymeld.llm import token_files as T
from waymeld.llm import warc as W

PIECES = st.lists(st.sampled_from([*C.INSTRUCT.controls, "[", "<", "\\", "/s>", "INST]", " ", "a", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escaping_can_be_undone(text):
    e = C.Escaper(C.INSTRUCT.controls)
    broken = e.escape(text)
    assert e.restore(broken) == text and not any(c in broken for c in C.INSTRUCT.controls)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool [/ROLE]", ""]), PIECES), max_size=5))
def test_reader_gives_turns_back(turns):
    e, text = C.Escaper(C.INSTRUCT.controls), ""
    for role, body in turns:
        t = C.INSTRUCT.turns.get(role)
        a, b = (t.opening, t.closing) if t else (C.INSTRUCT.other[0] + e.escape(role) + C.INSTRUCT.other[1], C.INSTRUCT.other[2])
        text += a + e.escape(body) + b
    reader = C.Reader(C.INSTRUCT)
    assert reader.feed(text) == turns and reader.held == ""


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, "assistant", "x"), (None, None, None, "[INST]"), (3, 0, "user", "q"), (3, 0, "user", "q")]
    got = {r["conv_id"]: r for r in C.read_back(C.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [got[k]["valid"] for k in (1, 2, 3, None)] == [True, False, False, False]
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest() and got[1]["loss_chars"] == 1
    assert got[3]["n_turns"] == 2 and got[None]["turns_sha256"] == hashlib.sha256(b"\n[INST]\n").hexdigest()


def test_warc_round_trip(spark):
    rows = [(1, "http://a b\r\n/", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70_000), (5, "u", "é" * 70_000), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = W.read_warc(W.write_warc(pages, archive_bytes=500), payload=True).collect()
    kinds = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in got)
    assert kinds == sorted([("1", "revisit", "2", 4), ("2", "response", "None", 4), ("3", "revisit", "4", 0), ("4", "response", "None", 0),
                            ("5", "response", "None", 140_000), ("5", "response", "None", 140_000), ("None", "revisit", "2", 4)])
    assert {bytes(r["payload"]) for r in got if r["page_id"] == 5} == {("é" * 70_000).encode()}
    small = W.read_warc(W.write_warc(pages, least=5)).collect()
    assert all(r["record_type"] == "response" for r in small)
    assert W.read_warc(W.write_warc(pages.limit(0))).count() == 0


def test_warc_reader_refuses_damage():
    member = W.pack_record(1, "u", b"payload", "response", None)
    assert len(list(W.members(member * 3, 7))) == 3
    with pytest.raises(ValueError):
        list(W.members(member[:-9]))
    raw = zlib.decompress(member, 31)
    for bad in (raw.replace(b"payload", b"paYload"), raw[:-1], raw.replace(b"Content-Length: ", b"Content-Length: 9", 1)):
        with pytest.raises(ValueError):
            W.read_record(bad)


def test_wavelet_matrix():
    rng = random.Random(2)
    for n, top in ((0, 1), (1, 1), (700, 5), (3000, 49_000), (1500, 70_000)):
        ids = np.array([rng.randint(0, top) for _ in range(n)], np.uint32)
        names, lengths, m = T.unpack_shard(T.pack_shard([7, None], [n, 0], ids))
        assert names == [7, None] and lengths.tolist() == [n, 0] and m.all().tolist() == ids.tolist()
        for place in range(0, n, 97):
            value = int(ids[place])
            assert m.access(place) == value
            spots = np.flatnonzero(ids == value).tolist()
            assert m.count(value) == len(spots) and [m.select(value, k) for k in range(min(3, len(spots)))] == spots[:3]
            assert m.count(value, 10, place) == sum(10 <= s < place for s in spots)
        assert m.select(top + 1, 0) == -1


def test_token_files(docs, real):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(T.tokenizer_path())
    plain.encode_special_tokens = True
    for rows in (docs, real):
        got = [r for r in T.read_shards(T.write_shards(rows, T.tokenizer_path(), shard_tokens=3_000)).collect()]
        want, start = [], 0
        for r in sorted(rows.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
            ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert T.read_shards(T.write_shards(docs.limit(0), T.tokenizer_path())).count() == 0


def test_special_tokens_in_texts():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(T.tokenizer_path())
    texts = ["end <|endoftext|> <|EndOfText|> x", "<|EndOfText|>", "A<|startoftext|>B c", "<|endoftext|>", "<|ENDOFTEXT|> word <|StartOfText|>.", "no such token here",
             "<|endoftext|><|endoftext|>", "<| endoftext |>", "é<|endoftext|>\n\n É <|EndOfText|>", ""]
    got = T.WordEncoder(T.tokenizer_path()).encode([t.encode() for t in texts], 1)
    assert [x.tolist() for x in got] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]


@pytest.fixture(scope="module")
def vocabulary():
    return P.load_vocabulary(P.model_path())


def plain_viterbi(v, text):
    """Over characters and a dictionary of pieces; of equal sums the one with the longest last piece."""
    pieces = {t.decode().replace(" ", P.SPACE): i for i, t in enumerate(v.text) if t and i > 258}
    s = (" " + text).replace(" ", P.SPACE) if text else ""
    best = [(0, [])] + [None] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - 48), end):
            part = s[start:end]
            if best[start] is None or (part not in pieces and end - start > 1):
                continue
            score = v.scores[pieces[part]] if part in pieces else v.unknown_score
            ids = [pieces[part]] if part in pieces else [int(v.byte_ids[b]) for b in part.encode()]
            if best[end] is None or best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, best[start][1] + ids)
    return best[-1][1]


def test_viterbi_matches_a_plain_search(vocabulary):
    rng = random.Random(5)
    texts = ["", " ", "  a  b ", "\n\n x\n", "漢字 ünḯ 😀😀", "a" * 120, "&&& the*** thing", "x\ty", "▁mark"] + [
        "".join(rng.choice("abethion \né漢😀&") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    e = P.Encoder(vocabulary, memo=50)
    for text, ids in zip(texts, e.encode([t.encode() for t in texts])):
        assert ids.tolist() == plain_viterbi(vocabulary, text.replace("▁", " "))
        assert e.decode(ids).decode() == text.replace("▁", " ")


def test_sentencepiece_rows(docs, real):
    for rows in (docs, real):
        path = P.model_path()
        got = P.decode(P.encode(rows, path), path)
        assert got.columns == [*rows.columns, "ids", "decoded"]
        assert all(r["decoded"] == (r["text"] or "") for r in got.collect())


def test_op10_rows_match_a_plain_search(spark, real, vocabulary):
    single = {int(i) for i in vocabulary.byte_ids if i >= 0}
    got = {r["doc_id"]: tuple(r)[1:] for r in P.op10_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    rows = real.collect()
    assert got.keys() == {r["doc_id"] for r in rows} and len(got) == len(rows)
    for r in rows:
        text = r["text"] or ""
        ids = plain_viterbi(vocabulary, text.replace("▁", " "))
        assert got[r["doc_id"]] == (len(ids), sum(i in single for i in ids), zlib.crc32(np.array(ids, "<i4").tobytes()),
                                    hashlib.sha256(text.replace("▁", " ").encode()).hexdigest(), "▁" not in text)


def test_pipeline(spark):
    import corpus_pipeline as pipe
    from waymeld.llm import near_dedup as N

    folder, docs = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in pipe.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder).cache()
        assert docs.columns == columns and 0 < docs.count() <= before.count()
        assert docs.where("n_chars <> length(text)").count() == 0
        if name == "near-dedup":
            assert N.near_duplicates(docs).where("NOT kept").count() == 0
    out = pipe.run(spark, folder)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_op7_query_equals_a_plain_loop(spark):
    import base64
    folder = "/root/testdata/sf0.001"
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()]
    largest = {}
    for page, body in pages:
        largest[body] = max(page, largest.get(body, page))
    want = [(page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), *(("response", None) if largest[body] == page else ("revisit", largest[body]))) for page, body in pages]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, W.op7_warc(spark, folder).collect()), key=key) == sorted(want, key=key)


def test_revisits_of_one_payload_on_half_the_pages(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"u{i}", "same" if i % 2 else f"own {i}") for i in range(200)] + [(199, "again", "same"), (None, "x", "same")], "page_id long, url string, html string")
    rows = W.with_revisits(df, 0).collect()
    assert len(rows) == 202
    assert all((r["_kind"], r["_refers"]) == (("revisit", 199) if r["html"] == "same" and r["page_id"] != 199 else ("response", None)) for r in rows)
