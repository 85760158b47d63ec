"""The stages of the pipeline against plain Python, on a small corpus."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from reelspark.llm import cube_mix
from tests.llm.test_dedup import brute_components
from tests.llm.test_outputs import brute_targets, ids_of
from tests.llm.test_scans import brute_pairs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, texts_, tmp_path_factory):
    """Clean and toxic texts, copies, passages of the benchmark, null and shared ids."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(4, 30))) for i in range(6)] + [(None, text(9)), (7, "the")]
    toxic = lambda: " ".join([*text(12).split(), *["nasty", "vile", "rotten"] * 3, *text(8).split()])
    clean = [t for t in texts_] + [text(rng.randint(20, 80)) for _ in range(60)]
    clean += [text(10) + " " + items[i][1].upper() + " " + text(5) for i in range(4)] + ["the", "the end"]
    texts = [(t, 0) for t in clean] + [(toxic(), 1) for _ in range(40)]
    rows = [(None if i % 11 == 5 else i // 2 if i % 13 == 3 else 1000 + i, t, None, f"s{i % 3}" if i % 7 else None, None) for i, (t, _) in enumerate(texts)]
    rows += rows[30:33]
    labels = [(r[0], 1, bad) for r, (_, bad) in zip(rows, texts) if r[0] is not None and r[0] >= 1000]
    base = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, rows, items, {t for t, bad in texts if bad}


def plain(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_stages_against_plain_python(spark, tables):
    base, rows, items, toxic = tables
    docs = spark.read.parquet(f"{base}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    have = Counter((r[0], r[1], r[3]) for r in rows)

    docs = stages["toxicity"](spark, docs, base)
    have = Counter({r: n for r, n in have.items() if r[1] not in toxic})
    assert plain(docs) == have

    docs = spark.createDataFrame(docs.collect(), SCHEMA)
    order = sorted(have.elements(), key=lambda r: (r[0] is not None, r[0] or 0))
    parts = brute_components([t for _, t, _ in order], 5, 80)
    docs = stages["ngram_join"](spark, docs, base)
    got = plain(docs)
    assert not got - have  # only rows that were there, none more often
    groups = {part if n else ("empty", *order[i][:2]) for i, (n, part) in enumerate(parts)}
    assert sum(got.values()) == len(groups)
    least = {}
    for r, (n, part) in zip(order, parts, strict=True):
        if n:
            least.setdefault(part, r[0])
    kept_ids = Counter(i for i, t, _ in got.elements() if (t or "").strip())
    assert kept_ids == Counter(least.values())  # of each group a row of its smallest id
    assert {t for _, t, _ in got if not (t or "").strip()} == {t for _, t, _ in have if not (t or "").strip()}

    have = got
    docs = spark.createDataFrame(docs.collect(), SCHEMA)
    docs = stages["decontamination"](spark, docs, base)
    have = Counter({r: n for r, n in have.items() if not brute_pairs(items, [r[:2]])})
    assert plain(docs) == have and sum(have.values()) > 50

    docs = spark.createDataFrame(docs.collect(), SCHEMA)
    mixed = stages["mixing"](spark, docs, base)
    got = plain(mixed)
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for (_, t, s), n in have.items():
        sizes[s] += n * size(t)
    taken = Counter()
    for (_, t, s), n in got.items():
        assert n <= 3 * have[_, t, s]
        taken[s] += n * size(t)
    for s, target in brute_targets(sizes).items():
        smallest = sorted(size(t) for _, t, x in have if x == s and size(t))[:2]
        assert abs(taken[s] - target) <= sum(smallest) + 10, s  # the smallest documents land last

    mixed = spark.createDataFrame(mixed.collect(), SCHEMA)
    tokens = stages["token_output"](spark, mixed, base).orderBy("start").collect()
    texts = [t for (_, t, _), n in got.items() for _ in range(n)]
    want = Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, _, _), ids in zip(got.elements(), ids_of(texts), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens) == want
    assert [r["start"] for r in tokens] == [0, *np.cumsum([r["n_tokens"] for r in tokens]).tolist()[:-1]]
    assert [r["doc_id"] is not None for r in tokens] == sorted(r["doc_id"] is not None for r in tokens)


def test_run_is_the_stages_in_a_row(spark, tables):
    base = tables[0]
    first, again = (sorted(tuple(r) for r in corpus_pipeline.run(spark, base).fillna(-1, ["doc_id"]).collect()) for _ in range(2))
    assert first == again and first


def test_stages_of_empty_tables(spark, tables):
    base = tables[0]
    none = spark.read.parquet(f"{base}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, base).collect() == [], name


def test_small_sources_are_as_near_as_they_can_be(spark):
    """Of a source of few documents every choice can be listed; the mix is among the nearest ones in words."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 9), f"s{i % 2}") for i in range(16)]
    got = cube_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("s0", "s1"):
        own = [r for r in got if r["source"] == s]
        whole = int(own[0]["target"] // own[0]["source_size"])
        sums = {0}
        for r in own:
            sums |= {x + r["size"] for x in sums}
        nearest = min(abs(x + whole * own[0]["source_size"] - own[0]["target"]) for x in sums)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= nearest + min(r["size"] for r in own)
        assert all(r["copies"] in (whole, whole + 1) for r in own)
