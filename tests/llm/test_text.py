"""Quality, language, SimHash and line dedup against plain versions."""

import time
import zlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from codefacts.llm import langid, linededup, quality, simhash
from codefacts.llm.common import components, held_out
from codefacts.llm.langid import Ranks, grams, identified, profiles
from codefacts.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def table(spark, rows, schema="doc_id long, text string, lang string, score string"):
    return spark.createDataFrame([(*r, *[None] * (schema.count(",") + 1 - len(r))) for r in rows], schema)


def test_held_out(spark):
    rows = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (2000, 2001), (2001, 2000), (2000, 2001)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    want = {x: min(y for y in root if top(y) == top(x)) for x in {x for a, b in edges if a != b for x in (a, b)}}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# quality


def brute_marginals(node, trans):
    from itertools import product

    n = len(node)
    p = np.zeros(n)
    z = 0.0
    for y in product((0, 1), repeat=n):
        s = np.exp(sum(node[i][y[i]] for i in range(n)) + sum(trans[y[i]][y[i + 1]] for i in range(n - 1)))
        z += s
        p += s * np.array(y)
    return p / z, np.log(z)


def test_marginals():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 3, 6, 1]
    doc = np.repeat(np.arange(5), sizes)
    node, trans = rng.normal(size=(15, 2)), rng.normal(size=(2, 2))
    good, both, logz = quality.marginals(node, trans, doc)
    want = [brute_marginals(node[doc == d], trans) for d in range(5)]
    assert np.allclose(good, np.concatenate([w[0] for w in want])) and np.isclose(logz, sum(w[1] for w in want))
    assert np.isclose(both.sum(), sum(s - 1 for s in sizes))


def test_quality_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [r for r in labels if got[r.doc_id].held_out]
    assert len(held) > 40 and np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.97
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_quality_edges(spark):
    texts = ["", "\n\n", None, "GO!! GO!! GO!!", "A plain line.\n" * 3000, "x" * 300_000]
    train = [(i, ("Good calm words here.\nAnd more of them follow." if i % 2 else "BAD!! BAD!! %%% | | |\nBAD!!"), "en") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fitted(table(spark, train), labels)
    out = quality.scored(table(spark, [(i, t) for i, t in enumerate(texts)] + [(0, "")]), model)
    assert out.columns == ["doc_id", "text", "lang", "score"]
    s = {r.doc_id: r.score for r in out.collect()}
    assert all(0 <= v <= 1 for v in s.values()) and s[3] < 0.3 < s[4] and out.count() == 7
    # without labels of both kinds
    assert quality.fitted(table(spark, train), labels.where("quality = 1")) is None
    assert {r.score for r in quality.scored(table(spark, train), None).collect()} == {0.5}
    assert quality.scored(table(spark, []), model).count() == 0


def test_quality_blocks(monkeypatch):
    """A text cut into blocks scores as it does whole."""
    monkeypatch.setattr(quality, "BLOCK", 300)
    model = quality.Crf(np.zeros(quality.BASE), np.ones(quality.BASE), np.linspace(-0.1, 0.1, 3 * quality.BASE + 3), np.eye(2))
    text = "\n".join(f"line {i // 8} of words, BIG ones too!" * (i % 8 // 2) for i in range(400))
    x, _, doc, _ = quality.line_features([text])
    assert 0 < x[:, quality.BASE - 4].sum() < 400  # lines that copy the one before
    assert np.array_equal(np.concatenate([b for b, _, _ in quality.features([text], 300)]), x)
    u = np.clip(quality.with_neighbours(x, doc), -8, 8) @ model.weights
    want, _, _ = quality.marginals(np.stack([np.zeros(len(u)), u], axis=1), model.trans, doc)
    got, _, _ = model.lines([text])
    assert np.allclose(got, want, atol=1e-5)
    assert len(list(quality.features([text], 300))) > 20
    parts = list(quality._blocks([text, "", "a\nb"], limit=300))
    assert "\n".join(p for part, of in parts for p, i in zip(part, of) if i == 0) == text


# language


def plain_grams(text):
    from collections import Counter

    c = Counter()
    s = "_" + "".join(ch if ch.isalpha() else "_" for ch in text.lower()) + "_"
    while "__" in s:
        s = s.replace("__", "_")
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if g != "_" and not (n == 3 and g[1] == "_"):
                c[g] += 1
    return c


def test_grams():
    for t in ("", "12 3", "a", "Été — là, là!", "ab ab\nba 漢字"):
        codes, n = grams(t)
        want = plain_grams(t)
        assert sorted(n.tolist()) == sorted(want.values())
        for code, k in zip(codes.tolist(), n.tolist()):
            chars = [c for c in (code & 0x1FFFFF, code >> 21 & 0x1FFFFF, code >> 42) if c]
            assert want["".join("_" if c == 1 else chr(c) for c in chars)] == k


def test_grams_of_long_texts(monkeypatch):
    text = "Der Hund, the cat — là!\n" * 40 + "x" * 100 + " 12 " * 30 + "漢字"
    whole = grams(text)
    for step in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "STEP", step)
        assert all(np.array_equal(a, b) for a, b in zip(whole, grams(text)))
    assert whole[1].sum() == sum(plain_grams(text).values())


def test_language_edges(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("no lang", None), (None, "en")])]
    found = profiles(table(spark, train))
    assert sorted(found) == ["de", "en", "fr"]
    rows = [(0, None), (1, ""), (2, "123 !!"), (3, "the dog the cat"), (3, "the dog the cat"), (4, "und die " * 30_000)]
    got = identified(table(spark, rows), found).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "de"] and got[0].score == 0.0
    assert identified(table(spark, []), found).count() == 0
    assert {r.lang_pred for r in identified(table(spark, rows), profiles(table(spark, []))).collect()} == {"und"}


def test_language_counts_in_parts():
    rng = np.random.default_rng(4)
    texts = [("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(0, 60))), "abc"[int(k)]) for k in rng.integers(0, 3, 300)]
    want = {}
    for t, lang in texts:
        for g, n in zip(*(x.tolist() for x in grams(t))):
            want[lang, g] = want.get((lang, g), 0) + n
    for most, whole in ((1, 1), (50, 200), (1000, 10**6), (10**9, 10**9)):
        got, parts = {}, list(langid.added_up(iter(texts), most, whole))
        for lang, codes, n in parts:
            assert len(set(codes.tolist())) == len(codes)
            for g, k in zip(codes.tolist(), n.tolist()):
                got[lang, g] = got.get((lang, g), 0) + k
        assert got == want and (len(parts) == 3) == (whole > 10**5)
    assert list(langid.added_up(iter([]))) == []


def test_language_counting_holds_little():
    import tracemalloc

    rng = np.random.default_rng(5)
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, 20_000))
    tracemalloc.start()
    (_, codes, n), = langid.added_up((text, "x") for _ in range(300))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.tolist() == (300 * grams(text)[1]).tolist() and codes.tolist() == grams(text)[0].tolist()
    assert peak < 30e6 < 300 * 16 * len(codes)  # which holding each text's n-grams takes


def test_rank_order_distance():
    text, other = "the theme of the thing", "la la land"
    m = Ranks({"x": grams(text)[0][:5], "y": grams(other)[0][:5]}, 5)
    codes, n = grams(text)
    top = codes[np.argsort(-n, kind="stable")[:5]].tolist()
    away = {name: sum(abs(g.index(c) - i) if c in g else 5 for i, c in enumerate(top)) for name, g in (("x", grams(text)[0][:5].tolist()), ("y", grams(other)[0][:5].tolist()))}
    best = min(away, key=away.get)
    assert m.guess(text) == (best, pytest.approx(1 - away[best] / 25))


def test_language_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in QUERIES["op7_language"](spark, SF).collect() if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in got]) > 0.97


# SimHash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "One two", "ONE two three", "É a b É a b", "a\x1cb\x85c d e f g", "w " * 5000, "x y z x y z q"])
def test_fingerprint(text, monkeypatch):
    assert simhash.fingerprint(text) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_bk_tree():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 30).tolist()
    values = list({b ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 6)))) for b in base for _ in range(8)})
    t = simhash.BkTree()
    for v in values:
        t.add(v)
    for v in values:
        assert sorted(t.within(v, 3)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 3]


@pytest.mark.parametrize("shard", [2048, 5])
def test_links(spark, shard):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 12).tolist()
    values = sorted({b ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 5)))) for b in base for _ in range(12)} | {(1 << 64) - 1, (1 << 64) - 8, 0, 7})
    nodes = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "node long, fp long")
    got = {r.node: r.component for r in components(simhash.links(nodes, shard=shard)).collect()}
    root = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, v in enumerate(values):
            for j, w in enumerate(values):
                if (v ^ w).bit_count() <= 3 and root[j] < root[i]:
                    root[i], changed = root[j], True
    assert [got.get(i, i) for i in range(len(values))] == root


def test_near_duplicates(spark):
    rows = [(5, "a b c d"), (3, "A b c d"), (9, None), (8, ""), (8, ""), (None, "lone text here"), (None, "a b c d"), (1, "quite another text")]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    f = f"{plain_fingerprint('a b c d'):016x}"
    assert by[(5, f)] == by[(3, f)] == by[(None, f)] == 3 and by[(9, "0" * 16)] == by[(8, "0" * 16)] == 8
    assert by[(None, f"{plain_fingerprint('lone text here'):016x}")] is None
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_op2_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    fps = np.array([plain_fingerprint(r.text) for r in rows], dtype=np.uint64)
    ids = np.array([r.doc_id for r in rows])
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    comp = ids.copy()
    while True:
        nxt = np.where(near, comp[None, :], 1 << 60).min(axis=1)
        if (nxt == comp).all():
            break
        comp = nxt
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {int(i): (f"{int(f):016x}", int(c)) for i, f, c in zip(ids, fps, comp)}


# lines


def plain_dedup(rows, window=3, min_words=50):
    """The runs of every document, in order; a run that has come before is deleted."""
    def lines(t):
        return [(i, x.strip(" ")) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")]

    def runs(f):
        out = set()
        for k in range(len(f)):
            for step in (1, -1):
                for m in range(1, window + 1):
                    span = f[k : k + m] if step > 0 else f[k - m + 1 : k + 1] if k - m + 1 >= 0 else []
                    if len(span) == m and (m == window or sum(len(x.split(" ")) for _, x in span) >= min_words):
                        out.add((span[0][0], span[-1][0], tuple(x for _, x in span)))
                        break
        return out

    distinct = sorted({(d, t) for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    for n, (d, t) in enumerate(distinct):
        for a, b, run in runs(lines(t)):
            first[run] = min(first.get(run, (n, a)), (n, a))
    gone = {}
    for n, (d, t) in enumerate(distinct):
        gone[(d, t)] = {i for a, b, run in runs(lines(t)) if (n, a) != first[run] for i in range(a, b + 1)}
    return gone


def test_line_dedup(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "b\nc"), (4, long), (5, f"head\n{long}\ntail"), (6, "a\nb\nc\nd"), (6, "a\nb\nc\nd"), (7, None), (8, ""), (9, "\n\n"),
        (10, "q\nq\nq\nq\nq\nq\nq"), (11, "b\n\nc\n  d  \nz"), (12, "k\na\nb"), (None, "x\nb\nc\nd\ny"), (13, "m\n" * 4000),
        (14, " ".join("v" * 1 for _ in range(30)) + "\n" + " ".join("u" for _ in range(30))), (15, "p\n" + " ".join("v" for _ in range(30)) + "\n" + " ".join("u" for _ in range(30)) + "\np2"),
    ]
    d = table(spark, rows, "doc_id long, text string, n_removed string, lines string")
    got = linededup.deduplicated(d).collect()
    assert len(got) == len(rows)
    gone = plain_dedup(rows)
    for r in got:
        t = next(t for i, t in rows if i == r.doc_id)
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[(r.doc_id, t)])
        assert (r.text, r.n_removed) == (want, len(gone[(r.doc_id, t)])), r.doc_id
    assert linededup.deduplicated(table(spark, [])).count() == 0


def test_long_text_of_different_lines(spark):
    k = 100_000
    rows = [(1, "\n".join(f"line {i} of one text" for i in range(k))), (2, "head\n" + "\n".join(f"line {i} of one text" for i in range(k - 50, k)))]
    began = time.time()
    got = {r.doc_id: (r.n_removed, r.text) for r in linededup.deduplicated(table(spark, rows)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (50, "head")} and time.time() - began < 90


def test_fingerprints_are_window_minima(spark):
    """Every run selects one of its own lines, and all copies of a run select the same one."""
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "m\nb\nn\no")]
    got = linededup.runs(table(spark, rows), 3, 50, "text", "doc_id").collect()
    assert len(got) == 3 + 3 + 2 and all(len({r.fp for r in got if r.run == run}) == 1 for run in {r.run for r in got})
    assert len({(r.doc_id, r.at) for r in got}) < len(got)


def test_line_dedup_is_native(spark):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        linededup.deduplicated(table(spark, [(1, "a\nb\nc")])).explain()
    assert not any(w in out.getvalue() for w in ("Python", "Pandas", "Arrow"))


def test_op8_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(c.sql(linededup.oracle()).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op8_lines"](spark, "/root/testdata/sf0.001").select("doc_id", "n_lines", "n_removed", "clean_md5").collect())
    assert got == want
