"""Token files, mixing, fingerprints, chat formatting and the pipeline."""

import hashlib
import json
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reelspark.llm import chat_format, cube_mix, order_minhash, token_output

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["a  b", " a", "a ", "a \n b", "a\n\n b\t c", "don't we'll  I'd", "x  y", "x 　z", "<|endoftext|> no", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y z", "é è  ü 日本 語", "\0 a b", "...a ...b", "12 345 6a", "a  b"]


def encoded(coder, texts):
    raw = [t.encode() for t in texts]
    ids, cuts = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64))
    return [[*ids[a:b].tolist(), 0] for a, b in zip(cuts, cuts[1:])]


def test_encoder_equals_the_library(texts_):
    every = [t or "" for t in texts_] + ODD
    coder = token_output.Encoder(TOKENIZER)
    for some in (every, every[::-1], every):
        assert encoded(coder, some) == ids_of(some)
    for t in every:
        assert encoded(coder, [t]) == ids_of([t])


def test_encoder_on_random_texts():
    rng = np.random.default_rng(4)
    signs = list(" \t\n\r\x0b\x0c\x1c\x85\xa0\u1680\u2003\u2028\u3000\u200b\ufeff'ab1Zé.日😀\0_-") + ["  ", "'s", "'ll", "<|endoftext|>", " a", "word"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 25))) for _ in range(3000)]
    assert encoded(token_output.Encoder(TOKENIZER), texts) == ids_of(texts)


def test_full_cache(texts_, monkeypatch):
    monkeypatch.setattr(token_output, "CACHE_PIECES", 50)
    every = [t or "" for t in texts_]
    coder = token_output.Encoder(TOKENIZER)
    for _ in range(2):
        assert encoded(coder, every) == ids_of(every)
    assert coder.n_pieces == len(coder.known) == 50


def test_unknown_kinds_of_tokenizers_are_not_split(texts_):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    coder, library = token_output.Encoder(path), Tokenizer.from_file(path)
    every = [t or "" for t in texts_]
    assert not coder.splits and [x[:-1] for x in encoded(coder, every)] == [e.ids for e in library.encode_batch(every, add_special_tokens=False)]


def test_files_round_trip(corpus, texts_):
    manifest = token_output.write_tokens(corpus, TOKENIZER)
    got = token_output.read_tokens(manifest).orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(got, ids_of(texts_), strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shards = manifest.orderBy("shard").collect()
    assert shards[0]["base"] == 0 and all(b["base"] == a["base"] + a["n_tokens"] for a, b in zip(shards, shards[1:]))
    assert isinstance(token_output.Shard(shards[0]["path"], shards[0]["width"]).ids, np.memmap)


def test_tokens_of_odd_rows(odd, nothing):
    assert token_output.read_tokens(token_output.write_tokens(nothing, TOKENIZER)).collect() == []
    got = token_output.read_tokens(token_output.write_tokens(odd, TOKENIZER)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 2, 3, 4] and got[4]["n_tokens"] == 1


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s] + 1e-12}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, "é": 50, None: 3}, {"a": 5}, {"a": 0, "b": 7}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "key long, source string, size long")
    got = {r["source"]: r["target"] for r in cube_mix.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 400):
        p, size = rng.uniform(size=n), rng.integers(1, 500, n)
        q = cube_mix.fly(p, size, rng.uniform(size=n))
        assert ((q > 0) & (q < 1)).sum() <= 2 and q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())
        r = cube_mix.settle(p, size, rng.uniform(size=n))
        assert set(np.unique(r)) <= {0.0, 1.0}


@pytest.mark.parametrize("block_rows", [4096, 40])
def test_mix_meets_targets(spark, block_rows):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(0, 60)), f"s{min(i % 9, 4)}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = cube_mix.mix(df, block_rows=block_rows).orderBy("doc_id").collect()
    assert got == cube_mix.mix(df.repartition(5), block_rows=block_rows).orderBy("doc_id").collect()
    assert [r["size"] for r in got] == [len(t.split()) for _, t, _ in rows] and all(r["taken"] <= 3 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=12)


def test_mix_of_odd_rows(corpus, odd, nothing):
    assert cube_mix.mix(nothing).collect() == [] and cube_mix.mix(odd).count() == odd.count()
    kept = cube_mix.apply(corpus)
    assert kept.columns == corpus.columns
    # One id over several texts and sources: each row is taken as often as it was drawn itself.
    shared = corpus.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(7).cast("long")))
    drawn = {(r["source"], r["size"]): r["n"] for r in cube_mix.mix(shared).groupBy("source", "size").agg(F.sum("copies").alias("n")).collect()}
    taken = cube_mix.apply(shared).withColumn("size", F.size(F.expr("regexp_extract_all(coalesce(text, ''), '[^ \\\\t-\\\\r]+', 0)")))
    assert {(r["source"], r["size"]): r["count"] for r in taken.groupBy("source", "size").count().collect()} == {k: n for k, n in drawn.items() if n}
    want = {r["doc_id"]: r["copies"] for r in cube_mix.mix(corpus).where("copies > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in kept.groupBy("doc_id").count().collect()} == want


def brute_fingerprint(xxhash64, text):
    words = ["", *[w[i : i + 24] for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w for i in range(0, len(w), 24)]]
    seen, hashes = {}, []
    for pos, pair in enumerate(zip(words, words[1:])):
        h = xxhash64(*pair)
        n = seen.get(h, 0)
        seen[h] = n + 1
        hashes.append((xxhash64(h, n) if n else h, pos))
    out = []
    for b in range(64):
        two = sorted(x for x in hashes if (x[0] % 2**64) >> 58 == b)[:2]
        if two:
            value = xxhash64(*[h for h, _ in sorted(two, key=lambda x: x[1])])
            out.append(f"{b:02X}{value % 2**32:08X}")
    return ".".join(out)


def test_fingerprints(spark, corpus, texts_):
    memo = {}

    def xxhash64(*values):
        if values not in memo:
            memo[values] = spark.range(1).select(F.xxhash64(*[F.lit(v).cast("int") if isinstance(v, int) and abs(v) < 2**20 else F.lit(v) for v in values])).first()[0]
        return memo[values]

    got = {r["doc_id"]: r["fingerprint"] for r in order_minhash.fingerprints(corpus).collect()}
    for i in (27, 47, 49, 50, 52, 53, 54):
        assert got[i * 3] == brute_fingerprint(xxhash64, texts_[i] or ""), i
    assert got[0] == got[45 * 3]


def alike(a, b):
    if not a or not b:
        return float(a == b)
    x, y = ({t[:2]: t for t in f.split(".")} for f in (a, b))
    return sum(x[k] == y.get(k) for k in x) / len(x.keys() | y.keys())


def test_edit_probe(corpus, texts_):
    got = order_minhash.edit_probe(corpus).orderBy("doc_id").collect()
    whole = [t or "" for t in texts_]
    for i, r in enumerate(got):
        m = len(whole[i]) // 4
        edited = whole[i][: len(whole[i]) - m] + whole[(i + 1) % len(whole)][:m]
        assert (r["n_chars"], r["edited_sha256"]) == (len(whole[i]), hashlib.sha256(edited.encode()).hexdigest())
        following = got[(i + 1) % len(got)]
        assert (r["near_edited"], r["near_next"]) == (alike(r["fingerprint"], r["edited_fingerprint"]), alike(r["fingerprint"], following["fingerprint"]))
    long = [r for r in got if r["n_chars"] > 200 and r["doc_id"] < 75]
    assert np.mean([r["near_edited"] for r in long]) > 0.25 > 0.05 > np.mean([r["near_next"] for r in long])


def test_edit_probe_of_odd_rows(odd, nothing):
    assert order_minhash.edit_probe(nothing).collect() == []
    assert order_minhash.edit_probe(odd).count() == odd.count()
    lone = order_minhash.edit_probe(odd.where("doc_id = 4")).first()
    assert lone["near_next"] == 1.0


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes <|im_end|> <\\|im_start|>"), (2, 1, "assistant", "b"), (2, 0, "system", "a%\n"), (2, 1, "assistant", "b"), (3, 0, "user", None), (4, None, None, "x"), (None, 0, "a%0Ab\nc<|", "<\\\\|")]


def test_chats_round_trip(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(chat_format.records(rows))
    got = {r["conv"]: [tuple(t) for t in r["t"]] for r in chats.select("conv", chat_format.read_back(F.col("formatted")).alias("t")).collect()}
    want = {}
    for c, t, r, x in sorted(CHATS, key=lambda x: (str(x[0]), x[1] is None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert got == want
    d = {r["conv_id"]: r for r in chat_format.digest(chats).collect()}
    learnt = "yes <|im_end|> <\\|im_start|>"
    assert (d[1]["loss_chars"], d[1]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert d[2]["loss_chars"] == 2 and d[3]["loss_chars"] == 0 and d[3]["n_turns"] == 1
    assert chat_format.digest(chat_format.format_chats(chat_format.records(rows.where("false")))).collect() == []


def test_layouts(spark):
    records = [
        {"prompt": "p", "response": "r"}, {"response": "r", "prompt": "p"}, {"instruction": "i", "input": "n", "output": "o"}, {"instruction": "i", "output": "o"},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"messages": [{"role": "user", "content": "q"}]}, {"messages": []}, {"unknown": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv long, record string")
    got = [None if r["t"] is None else [tuple(t) for t in r["t"]] for r in df.select("conv", chat_format.canonical_turns(F.col("record")).alias("t")).orderBy("conv").collect()]
    pair = [("user", "p"), ("assistant", "r")]
    assert got == [pair, pair, [("system", "i"), ("user", "n"), ("assistant", "o")], [("user", "i"), ("assistant", "o")], [("user", "q"), ("assistant", "a")], [("user", "q")], [], None]
    assert df.select(chat_format.field_paths(F.col("record"))).collect()[4][0] == ["conversations[].from", "conversations[].value"]
    out = {r["conv"]: r["formatted"] for r in chat_format.format_chats(df).collect()}
    assert out[7] is None and out[6] == "" and out[0] == "<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\nr<|im_end|>\n"


JSON_TEXTS = ['{"a": 1}', '[{"x": 1}, {"y": "z"}]', '{"a": {"b": 2}} and more', "[1, 2]", "[]", "{}", "{not json", '[{"role": "user", "content": "q"}]', '"quoted"', "null", ' {"a": 1}']


def test_texts_that_are_json(spark):
    pairs = [(q, a) for q in JSON_TEXTS for a in (*JSON_TEXTS[:4], "plain")]
    turns = [(i, t, r, x) for i, p in enumerate(pairs) for t, (r, x) in enumerate(zip(("user", "assistant"), p, strict=True))]
    turns += [(1000 + i, t, "user", x) for i, x in enumerate(JSON_TEXTS) for t in range(3)]
    chats = chat_format.format_chats(chat_format.records(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    got = {r["conv"]: r["t"] and [tuple(t) for t in r["t"]] for r in chats.select("conv", chat_format.read_back(F.col("formatted")).alias("t")).collect()}
    want = {}
    for c, _, r, x in turns:
        want.setdefault(c, []).append((r, x))
    assert got == want
    records = [({"prompt": {"a": 1}, "response": '{"b": 2}'}, ["prompt.a", "response"]), ({"messages": '[{"role": "user", "content": "q"}]'}, ["messages"])]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(records)], "conv long, record string").orderBy("conv")
    found = rows.select(chat_format.field_paths(F.col("record")), chat_format.canonical_turns(F.col("record"))).collect()
    assert [tuple(r) for r in found] == [(p, None) for _, p in records]
    twice = spark.sql("""SELECT '{"messages":[{"role":"user","role":"user","content":"q"}]}' AS record""")
    assert twice.select(chat_format.canonical_turns(F.col("record"))).first()[0] is None  # a name stands twice: no layout


def test_nested_parts(spark):
    say = lambda *x: [{"type": "text", "text": t} for t in x]
    records = [
        ({"messages": [{"role": "user", "content": say("a", '{"b": [1]}')}, {"role": "assistant", "content": say("c")}]}, [("user", 'a{"b": [1]}'), ("assistant", "c")]),
        ({"messages": [{"role": "system", "content": "[1]"}, {"role": "user", "content": [*say("d"), {"type": "image"}]}]}, [("system", "[1]"), ("user", "d")]),
        ({"messages": [{"role": "user", "content": None}, {"role": "user"}, {"role": None, "content": 5}]}, [("user", ""), ("user", ""), ("", "5")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": {"deep": [{"er": 1}]}}]}]}, None),
        ({"messages": [{"role": "user", "content": {"content: STRING, role": "x"}}]}, None),
        ({"a`b": {"c d": [[{"e": 1}], [2]]}}, None),
    ]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(records)] + [(97, "[1"), (98, "3"), (99, None)], "conv long, record string")
    got = {r["conv"]: (r["t"] and [tuple(t) for t in r["t"]], r["p"]) for r in rows.select("conv", chat_format.canonical_turns(F.col("record")).alias("t"), chat_format.field_paths(F.col("record")).alias("p")).collect()}
    assert [got[i][0] for i in range(len(records))] == [t for _, t in records]
    assert got[3][1] == ["messages[].content[].text.deep[].er", "messages[].content[].type", "messages[].role"]
    assert got[97] == got[99] == (None, []) and got[98][0] is None
    # Columns of other names don't matter, and every layout of the records is read back.
    turns = [(c, t, ("user", "assistant", "system")[t % 3 if c % 2 else t % 2], JSON_TEXTS[(c + t) % 11]) for c in range(200) for t in range(1 + c % 5)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("x"), "record": F.lit(0), "t": F.lit(None).cast("int"), "parts": F.lit(1)})
    recs = chat_format.records(table)
    assert recs.select(chat_format.field_paths(F.col("record"))).distinct().count() == 6
    read = {r["conv"]: [tuple(t) for t in r["t"]] for r in chat_format.format_chats(recs).select("conv", chat_format.read_back(F.col("formatted")).alias("t")).collect()}
    want = {}
    for c, _, r, x in turns:
        want.setdefault(c, []).append((r, x))
    assert read == want


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids <= before and ids, name
        before = ids
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == docs.count() and {r["doc_id"] for r in tokens.collect()} == before


def test_repeated_and_null_ids_have_spans_of_their_own(spark):
    """Records that share an id, or repeat, are each worked on alone; many turns too."""
    said = lambda n: json.dumps({"messages": [{"role": ("user", "assistant")[i % 2], "content": f"t{i} <|im_end|>" * (i % 5)} for i in range(n)]})
    recs = [(1, said(2)), (1, said(5)), (1, said(5)), (None, said(4)), (None, said(3)), (2, said(700)), (3, said(0)), (4, "{}")]
    chats = chat_format.format_chats(spark.createDataFrame(recs, "conv long, record string"))
    assert "Exchange" not in chats._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r["conv"] or 0), r["formatted"] or "", tuple(chat_format_text(r))) for r in chats.collect())
    want = sorted(((c or 0), "".join(f"<|im_start|>{m['role']}\n{escaped(m['content'])}<|im_end|>\n" for m in turns), tuple(m["content"] for m in turns if m["role"] == "assistant")) for c, rec in recs for turns in [json.loads(rec).get("messages", [])])
    assert got == want


def escaped(text):
    return text.replace("<|", "<\\|")


def chat_format_text(r):
    return [r["formatted"][s["start"] : s["start"] + s["length"]].replace("<\\|", "<|") for s in r["loss"] or []]


def test_very_long_texts_of_conversations(spark):
    """Over twenty million characters, in every layout; columns whose names clash stay out."""
    long = spark.range(8).selectExpr("id AS conv_id", "explode(array(0, 1)) AS turn", "id AS conv").selectExpr("*", "IF(turn = 0, 'user', 'assistant') AS role", "IF(turn = 1, repeat('a\\\\b\"é', 4200000), 'q') AS text", "1 AS record", "'x' AS t")
    out = chat_format.digest(chat_format.format_chats(chat_format.records(long.where("conv_id IN (0, 1, 2, 3)")))).collect()
    assert len(out) == 4
    assert {(r["n_turns"], r["loss_chars"]) for r in out} == {(2, 5 * 4_200_000)}
    parts = spark.range(1).selectExpr("1L AS conv", "to_json(struct(array(struct('assistant' AS role, array(struct('text' AS type, repeat('ab', 12000000) AS text)) AS content)) AS messages)) AS record")
    r = chat_format.digest(chat_format.format_chats(parts)).first()
    assert (r["n_turns"], r["loss_chars"]) == (1, 24_000_000)


@pytest.mark.parametrize("letters", ["日本語中文字韓國人大小上下左右前後", "abcdefghijklmnop"])
def test_likeness_of_unspaced_texts(spark, letters):
    """Likeness follows edits where there is no space: high after one, lower after many, 0 for another text."""
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list(letters), 4000))
    cut = list(text)
    for i in rng.integers(0, 4000, 400):
        cut[i] = "z"
    rows = [(0, text), (1, "y" + text), (2, text[:2000] + text[2001:]), (3, "".join(cut)), (4, "".join(rng.choice(list("ÀÉÎÕÜßñ"), 4000)))]
    got = {r["doc_id"]: r["fingerprint"] for r in order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [spark.range(1).select(order_minhash.likeness(F.lit(got[0]), F.lit(got[i]))).first()[0] for i in range(5)]
    assert near[0] == 1.0
    assert min(near[1], near[2]) > 0.9
    assert 0.05 < near[3] < near[2]
    assert near[4] < 0.05
