import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codefacts.llm.bpe import round_trip
from codefacts.llm.common import shared_path, sliced
from codefacts.llm.packing import boundaries, packed, padded_length
from codefacts.llm.records import crc32c, frames, read_records, token_records, unframes, write_records
from codefacts.llm.tokens import Bpe, bpe

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", None, "a  b\n\n\nc", "<|endoftext|>hi <|endoftext|>", "héllo ΣΑΣ İx don't I'LL 12,34 \t x y", "漢字 かな 😀😀 é zź", " lead", "trail ", "\n", " ", "\n ", "a\n b", "\r\nx y", "a\t b c \td e\t \tf", "x " * 40000, "Ouwhea the of rend"]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_librarys(path):
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe(path).encode(ODD)]
    assert got == library(path)(ODD)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdethorinsANDé, .\n\t'1ß|<>"), max_size=60), max_size=6))
def test_any_text(texts):
    for path in (WORD, BYTE):
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe(path).encode(texts)] == library(path)(texts)


def test_words_beyond_the_cache(monkeypatch):
    import codefacts.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHE", 3)
    b = Bpe(BYTE)
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in b.encode(ODD)] == library(BYTE)(ODD)
    assert b.stats["merged"] < b.stats["words"]


def test_runs_of_white_space_and_other_scripts(monkeypatch):
    """Paragraphs, indentation and other scripts take the same way as plain texts; the library is asked about unknown code points only."""
    texts = ["One paragraph.\n\nAnother  one,\n    indented;\t\ttabbed.\r\n", "Привет, мир! Γειά σου ΚΌΣΜΕ 안녕 你好 שלום", "a<|endoftext|>\n\n<|startoftext|> b", "\u3000wide \u00a0 space\x85\x1c", *[x for x in ODD if x]]
    for path in (WORD, BYTE):
        b = Bpe(path)
        assert [np.frombuffer(x, "<u4").tolist() for x in b.encode(texts)] == library(path)(texts)
        assert b.library is None
        newer = ["a\u0558b \U00018d89\U00018d89. \ua7dcx"]
        assert [np.frombuffer(x, "<u4").tolist() for x in b.encode(newer)] == library(path)(newer)


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    import codefacts.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHE", 50)
    b = Bpe(BYTE)
    for k in range(40):
        b.encode([f"tab\t{k} next  {k}\n\nword{k} {k}\tx" for _ in range(3)] * 2)
        b.encode([f"tab\t{k} next  {k}\n\nword{k} {k}\tx"])
    assert all(len(x) < 80 for x in (b.cache, b.pieces)) and len(b.others) == 0


def test_operators_without_a_vocabulary_give_up_those_a_worker_has(spark):
    """The same workers pack first and learn languages after that."""
    import codefacts.llm.tokens as tokens
    from codefacts.llm.langid import identified, profiles

    def loaded(batches):
        list(batches)
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [len(tokens._LOADED)]})

    d = spark.createDataFrame([(0, "the cat and the dog", "en")], "doc_id long, text string, lang string").coalesce(1)
    # the workers of a session: enough tasks at once to meet each of them
    seen = lambda: {r.pid: r.n for r in spark.range(400).repartition(40).mapInArrow(loaded, "pid long, n long").collect()}
    many = d.crossJoin(spark.range(400).select("id")).drop("id").repartition(40)
    packed(many, WORD).count()
    assert any(seen().values())
    identified(many, profiles(many)).count()
    assert not any(seen().values())
    bpe(WORD)
    assert list(sliced(iter([]), keep=True)) == [] and tokens._LOADED
    assert list(sliced(iter([]))) == [] and not tokens._LOADED


def test_decode():
    b, t = bpe(BYTE), Tokenizer.from_file(BYTE)
    for ids in library(BYTE)(ODD) + [[50256, 0, 220], [447, 447, 12]]:
        assert b.decode(np.array(ids, dtype=np.int64)) == t.decode(ids, skip_special_tokens=False)


def docs(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, "x", "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string")


def test_round_trip(spark):
    rows = round_trip(docs(spark, ODD + ODD[-1:]), BYTE, digests=True).collect()
    want = library(BYTE)(ODD + ODD[-1:])
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted((len(w), hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for w, t in zip(want, ODD + ODD[-1:]))
    assert round_trip(docs(spark, []), BYTE).count() == 0


def test_packing(spark):
    texts = [t for t in ODD] * 2
    pieces = packed(docs(spark, texts), WORD, length=64)
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    # gapless, full windows but the last one
    at = 0
    for r in rows:
        assert (r.sequence_id, r.offset) == divmod(at, 64) and r.length == len(r.ids) // 4 and r.offset + r.length <= 64
        at += r.length
    want = [w + [2] for w in library(WORD)(texts)]
    assert at == sum(map(len, want))
    # documents come back whole
    held, whole = {}, []
    for r in rows:
        part = held.setdefault(r.doc_id, b"")
        if r.start == 0:
            part = b""
        held[r.doc_id] = part + r.ids
        if r.start + r.length == r.doc_tokens:
            whole.append(np.frombuffer(held[r.doc_id], "<u4").tolist())
    assert sorted(whole) == sorted(want)
    b = boundaries(pieces).collect()
    assert all(x.n_tokens == 64 for x in b if x.sequence_id < max(y.sequence_id for y in b))
    assert packed(docs(spark, []), WORD).count() == 0
    assert (padded_length(4096), padded_length(1024), padded_length(5)) == (4096, 1024, 4096)


def test_crc32c():
    def plain(d):
        c = 0xFFFFFFFF
        for b in d:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert crc32c([b"123456789"]).tolist() == [0xE3069283]
    data = [os.urandom(n) for n in (0, 1, 63, 64, 65, 200, 4096, 64 * 9 + 1)]
    assert crc32c(data).tolist() == [plain(d) for d in data]


def test_frames():
    payloads = [b"", b"x", os.urandom(1000)]
    made = frames(payloads)
    assert unframes(made) == payloads
    for k in (0, 9, 12, len(made[2]) - 1):
        bad = bytearray(made[2])
        bad[k] ^= 1
        with pytest.raises(ValueError):
            unframes([bytes(bad)])


def test_records(spark):
    d = docs(spark, ODD + ODD[-2:])
    rows = token_records(d, BYTE).collect()
    want = {i if i != 3 else None: w + [50256] for i, w in enumerate(library(BYTE)(ODD + ODD[-2:]))}
    rows.sort(key=lambda r: r.start)
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k)
    assert [r.start for r in rows] == [sum(len(want[k]) for k in keys[:i]) for i in range(len(keys))]
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist()[:-1] for r in rows} == {k: w[:-1] for k, w in want.items()}
    assert all(np.frombuffer(r.ids, "<u4")[-1] == 2 and r.n_tokens == len(r.ids) // 4 for r in rows)
    assert token_records(docs(spark, []), BYTE).count() == 0


def test_records_of_one_id(spark):
    """Rows of one doc_id lie in order of their text's hash, whatever order they come in."""
    rows = [(7, f"text {k}") for k in range(6)] + [(7, "text 0"), (3, "first")]
    made = [[(r.doc_id, r.start, bytes(r.ids)) for r in token_records(spark.createDataFrame(x, "doc_id long, text string"), BYTE).collect()] for x in (rows, rows[::-1])]
    assert sorted(made[0]) == sorted(made[1]) and len(made[0]) == 8


def test_damage_is_found(spark):
    at = shared_path(spark, "damage")
    manifest = write_records(docs(spark, ODD), BYTE, at)
    path = manifest.first().data.removeprefix("file:")
    with open(path, "r+b") as f:
        f.seek(40)
        b = f.read(1)
        f.seek(40)
        f.write(bytes([b[0] ^ 255]))
    with pytest.raises(Exception, match="damaged"):
        read_records(spark, manifest).collect()


def test_query_digests(spark):
    from codefacts.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    word, byte = ({k: w + [2] for k, w in zip(texts, library(p)(list(texts.values())))} for p in (WORD, BYTE))
    for r in QUERIES["op10_records"](spark, sf).collect():
        assert (r.n_tokens, r.ids_crc32) == (len(byte[r.doc_id]), zlib.crc32(np.array(byte[r.doc_id], "<u4").tobytes()))
    got = QUERIES["op6_bpe"](spark, sf).collect()
    raw = dict(zip(texts, library(BYTE)(list(texts.values()))))
    assert len(got) == len(texts)
    for r in got:
        ids, text = raw[r.doc_id], texts[r.doc_id] or ""
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    at = 0
    for r in sorted(QUERIES["op5_packing"](spark, sf).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert (r.sequence_id, r.offset) == divmod(at, 4096)
        at += r.length
    assert at == sum(map(len, word.values()))
    for r in QUERIES["op5_packing"](spark, sf).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(word[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
