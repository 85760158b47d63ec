"""Fill-in-middle, collocations and shards against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelspark.llm import _quotient, collocations, fill_middle, kd_shards


def units_of(text, unit):
    pattern = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "char": r"(?s:.)"}[unit]
    return re.findall(pattern, text)


def plain_fim(doc_id, text, unit, seed=7, rate=100, spm_rate=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    u = units_of(text, unit)
    if not text or any(m in text for m in fill_middle.MARKERS) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < spm_rate:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "rate", "block"), [("line", 100, 4096), ("line", 60, 7), ("char", 100, 16), ("word", 90, 5)])
def test_fill_middle(spark, texts_, unit, rate, block):
    odd = ["a\n\nb\n", "\n", "\n\n\n", "é\n日本\n😀x", "no <P> here", "x<", "<<\n<S\n<M\n", "<M>", "ends\n", *("line of ü\n" * n for n in (1, 7, 40))]
    rows = [(i if i % 9 else None, t) for i, t in enumerate([*texts_, *odd, "long line\n" * 120_000 + "日" * 50_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fill_middle.transform(docs, unit=unit, rate=rate, block=block).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect())
    assert got == Counter((i, *plain_fim(i, t, unit, rate=rate)) for i, t in rows)
    assert Counter(r["back"] for r in made.collect()) == Counter(t or "" for _, t in rows)


def test_block_tree():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 33, 200):
        ends = rng.random(n) < 0.3
        ends[-1:] = True
        heads = rng.random(n) < 0.7
        tree = fill_middle.BlockTree(ends, heads, 4)
        assert tree.total() == (ends.sum(), heads.sum())
        for k, at in enumerate(np.flatnonzero(ends), 1):
            assert tree.chars_through(k) == heads[: at + 1].sum()


def test_fill_middle_of_odd_rows(corpus, odd, nothing):
    assert fill_middle.transform(nothing).count() == 0
    assert sorted((r["form"], r["output"]) for r in fill_middle.transform(odd).collect() if not r["output"]) == [("plain", "")] * 2
    assert fill_middle.transform(corpus).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    with pytest.raises(ValueError, match="overlap"):
        fill_middle.transform(odd, markers=("aba", "<S>", "<M>"))


@pytest.mark.parametrize("n", [1, 2, 4])
def test_quotient_filter(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 12 if n > 1 else 1 << 40, (n, 4000), dtype=np.uint64)
    assert (_quotient.restored(_quotient.permuted(ids)) == ids).all()
    want = Counter(map(tuple, ids.T.tolist()))
    for bits in (1, 4, 9):
        packed = [(part, f.pack(bits)) for some in np.array_split(ids, 7, axis=1) for part, f in _quotient.QuotientFilter.of(some).ranges(bits)]
        got = {}
        for part in {p for p, _ in packed}:
            f = _quotient.merge(_quotient.QuotientFilter.unpack(raw) for p, raw in packed if p == part)
            own = dict(zip(map(tuple, f.ids().T.tolist()), f.counts.tolist(), strict=True))
            assert not own.keys() & got.keys()
            got |= own
        assert got == want
    many = np.zeros((n, 70_000), np.uint64)
    f = _quotient.QuotientFilter.unpack(_quotient.QuotientFilter.of(many).pack(3))
    assert f.counts.tolist() == [70_000]


def test_keys_that_share_their_first_part(monkeypatch):
    """Entries whose permuted first ids are equal are told apart by the rest."""
    monkeypatch.setattr(_quotient, "permuted", lambda ids: ids)
    ids = np.array([[5, 5, 5, 7, 5], [1, 2, 1, 1, 2]], np.uint64)
    f = _quotient.QuotientFilter.of(ids)
    assert f.keys.T.tolist() == [[5, 1], [5, 2], [7, 1]]
    assert f.counts.tolist() == [2, 2, 1]


def plain_collocations(rows, longest=4, least=30, top=2000, cover=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        scored = []
        for p, a in cand.items():
            if 100 * around[p] >= cover * a:
                continue
            score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "held"), [(3, 2000, 1 << 20), (2, 7, 50), (5, None, 1 << 20)])
def test_collocations(spark, texts_, least, top, held, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", held)
    more = ["of the the the the. OF The; of  the\tof\x0bthe\x0cof the", "ü É é of the", "a, b: c! d? a b c d", "one word of the", *["new york city hall"] * 6, *["york city hall is old. city hall"] * 5]
    rows = [(["en", None, "fr", "und"][i % 4], t) for i, t in enumerate([*texts_, *more * 4])]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(docs, least=least, top=top).collect()))
    assert got == plain_collocations(rows, least=least, top=top or 10**9)
    assert len(got) > 20


def test_words_that_share_an_id(spark, monkeypatch):
    """Ids by length and of one salt only: two words share one, and the count says so."""
    data = np.frombuffer(b"aa bb aa cc", np.uint8)
    words = collocations.Words(data, np.array([0, len(data)]))
    assert collocations._same_words(data, words, np.arange(4), np.zeros(4, np.int64)).tolist() == [True, False, True, False]
    rows = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": ["aa bb. cc dd", "bb eee"]})

    class Every:
        value = np.full(1 << (collocations.CELL_BITS - 3), 255, np.uint8)

    for salt in range(4):
        listed = [r for b in collocations._dictionary(salt, Every)(iter([rows])) for r in b.to_pylist()]
        assert sorted(r["word"] for r in listed) == ["aa", "bb", "cc", "dd", "eee"]
        assert len({r["id"] for r in listed}) == 5
    monkeypatch.setattr(collocations, "_ids", lambda data, words, salt: (words.ends - words.starts).astype(np.uint64))
    listed = [r for b in collocations._dictionary(0, Every)(iter([rows])) for r in b.to_pylist()]
    assert sorted({(r["id"], r["word"]) for r in listed}) == [(2, "aa"), (2, "bb"), (2, "cc"), (2, "dd"), (3, "eee")]


def test_counting_again_with_other_ids(spark, monkeypatch):
    """Where the first salts are refused, later ones give the same phrases."""
    docs = spark.createDataFrame([("en", "aa bb. cc dd aa bb")] * 40, "lang string, text string")
    once = collocations.collocations(docs).collect()
    counted = collocations._counted
    monkeypatch.setattr(collocations, "_counted", lambda rows, longest, least, salt: counted(rows, longest, least, salt) if salt >= 2 else None)
    assert once == collocations.collocations(docs).collect()
    assert len(once) > 0


def test_collocations_of_odd_rows(corpus, odd, nothing):
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(odd).count() == 0
    assert collocations.collocations(corpus, least=4).where("rank < 1").count() == 0


def shard_rows(out):
    by = defaultdict(list)
    for r in out.collect():
        by[r["shard"]].append(r)
    return by


def test_kd_shards(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "x" * int(rng.integers(0, 400)) + str(i), f"s{i % 7}" if i % 3 else "big", "en" if i % 5 else None, i % 11) for i in range(3000)]
    rows += [(3000 + i, "copy " * 60, "s1", "en", 5) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, stars int").repartition(5)
    for n in (1, 5, 40):
        out = kd_shards.shards(docs, ["source", "lang", "stars"], n_shards=n)
        assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        by = shard_rows(out)
        assert sorted(by) == list(range(n))
        sizes = [sum(r["size"] for r in rs) for rs in by.values()]
        assert max(sizes) - min(sizes) <= 0.08 * np.mean(sizes)
        assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
        texts = {r[0]: r[1] for r in rows}
        assert sorted(r["doc_id"] for rs in by.values() for r in rs) == sorted(texts)
        assert all((r["size"], r["text_crc32"], r["law"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]].encode()), "bytes") for rs in by.values() for r in rs)
    target = kd_shards.shards(docs, ["source"], target_bytes=200_000)
    assert len(shard_rows(target)) == -(-sum(len(r[1]) + 16 for r in rows) // 200_000)
    again = kd_shards.shards(docs.repartition(2), ["source"], target_bytes=200_000)
    assert {(r["doc_id"], r["shard"]) for r in target.collect()} == {(r["doc_id"], r["shard"]) for r in again.collect()}


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 3} " * 4, f"s{i % 2}") for i in range(3000)]
    out = kd_shards.shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["source"], n_shards=6)
    placed = defaultdict(set)
    for r in out.collect():
        placed[rows[r["doc_id"]][1]].add(r["shard"])
    assert all(len(s) == 1 for s in placed.values())


def test_boxes_are_boxes(spark):
    """Along one dimension of different places shards are stretches of it."""
    rows = [(i, "t" * 20 + str(i), float(i)) for i in range(800)]
    out = kd_shards.shards(spark.createDataFrame(rows, "doc_id long, text string, at double"), ["at"], n_shards=8).orderBy("doc_id").collect()
    shards = [r["shard"] for r in out]
    assert shards == sorted(shards)
    assert set(Counter(shards).values()) <= {98, 99, 100, 101, 102}


def test_rows_that_are_equal_are_dealt_out(spark):
    """Half of all rows share id and text: they are placed one by one, over several shards."""
    docs = spark.createDataFrame([(7, "same text here")] * 500 + [(None, None)] * 100 + [(i, f"own {i}") for i in range(600)], "doc_id long, text string").repartition(3)
    by = shard_rows(kd_shards.shards(docs, ["doc_id"], n_shards=4))
    assert sum(map(len, by.values())) == 1200
    sizes = [sum(r["size"] for r in rs) for rs in by.values()]
    assert max(sizes) - min(sizes) <= 0.1 * np.mean(sizes)


def test_shards_of_odd_tables(spark, nothing, odd, corpus, tmp_path):
    assert kd_shards.shards(nothing, ["lang"], n_shards=40).count() == 0
    few = kd_shards.shards(odd, ["lang", "n_chars"], n_shards=40)
    assert few.count() == odd.count()
    path = str(tmp_path / "shards")
    docs = corpus.withColumn("shard", F.lit("mine")).withColumn("row", F.lit(1))
    kd_shards.write_shards(docs, path, ["lang", "source"], n_shards=3)
    back = spark.read.parquet(path)
    assert set(back.columns) == {*docs.columns, "shard_", "slot"}
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    by = defaultdict(list)
    for r in back.collect():
        by[r["shard_"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    with pytest.raises(ValueError, match="n_shards"):
        kd_shards.shards(odd, ["lang"])
