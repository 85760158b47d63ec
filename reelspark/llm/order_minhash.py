"""Order MinHash fingerprints; DataFrame functions only.

A text's k-mers are runs of ``K`` words (an empty one stands before the first), numbered by occurrence so that repeats differ. Hashes of
the numbered k-mers fall into ``SKETCHES`` ranges; each range selects its two minimal ones, keeps
them in the order in which they stand in the text, and hashes that tuple. Two texts agree in a
range if they share both k-mers in the same order, so the likeness falls with edits and with
reordering, unlike that of plain MinHash. One pass over the k-mers serves all sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm._store import id_value, materialize, texts

#: Words of a k-mer.
K = 2
#: log2 of the ranges of hashes.
RANGE_BITS = 6
#: Characters of a word; a longer run without space counts as words of one character each, wherever it is edited.
WORD = 24
_S = r"[^ \t-\r]"
_WORDS = rf"(?<!{_S}){_S}{{1,{WORD}}}+(?!{_S})|{_S}"


def _with(df: DataFrame, suffixes: tuple[str, ...], make, name: str, drop: str = "") -> DataFrame:
    """Adds name + suffix for each suffix. A step of its own: lambdas then refer to a column, not to its expression."""
    kept = [c for c in df.columns if not (drop and any(c == drop + s for s in suffixes))]
    return df.select(*kept, *[make(s).alias(name + s) for s in suffixes])


def _occurrence(sorted_: Column, h: Column, i: Column) -> Column:
    """How many equal hashes stand before index ``i`` of the sorted array: by bisection, only where there is one."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(32)),
        F.struct(F.lit(0).alias("lo"), i.alias("hi")),
        lambda s, _: F.when(
            s["lo"] < s["hi"],
            F.when(
                F.get(sorted_, F.shiftright(s["lo"] + s["hi"], 1))["h"] < h,
                F.struct((F.shiftright(s["lo"] + s["hi"], 1) + 1).alias("lo"), s["hi"].alias("hi")),
            ).otherwise(F.struct(s["lo"].alias("lo"), F.shiftright(s["lo"] + s["hi"], 1).alias("hi"))),
        ).otherwise(s),
    )
    return i - step["lo"]


def with_fingerprints(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds a fingerprint column for each text column: {text column: fingerprint column}. An empty text has an empty one.

    A fingerprint lists, by range, two hex digits of the range and eight of its tuple's hash.
    """
    names = tuple(columns)
    df = _with(df, names, lambda c: F.concat(F.array(F.lit("")), F.regexp_extract_all(F.col(c), F.lit(_WORDS), F.lit(0))), "__words_")

    def kmers(c: str) -> Column:
        words = F.col(f"__words_{c}")
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (K - 1), F.lit(0)))
        return F.sort_array(F.transform(starts, lambda w, i: F.struct(F.xxhash64(w, *[F.coalesce(F.get(words, i + j), F.lit("")) for j in range(1, K)]).alias("h"), i.alias("pos"))))

    df = _with(df, names, kmers, "__sorted_", "__words_")

    def numbered(c: str) -> Column:
        s = F.col(f"__sorted_{c}")
        again = lambda x, i: F.coalesce((i > 0) & (F.get(s, i - 1)["h"] == x["h"]), F.lit(False))
        return F.sort_array(F.transform(s, lambda x, i: F.struct(F.when(again(x, i), F.xxhash64(x["h"], _occurrence(s, x["h"], i))).otherwise(x["h"]).alias("h"), x["pos"].alias("pos"))))

    df = _with(df, names, numbered, "__numbered_", "__sorted_")
    place = lambda x: F.shiftrightunsigned(x["h"], 64 - RANGE_BITS)

    def tuples(c: str) -> Column:
        s = F.col(f"__numbered_{c}")

        def entry(x: Column, i: Column) -> Column:
            first = (i == 0) | F.coalesce(place(F.get(s, i - 1)) != place(x), F.lit(True))
            second = F.get(s, i + 1)
            both = F.coalesce(place(second) == place(x), F.lit(False))
            inorder = F.when(x["pos"] < second["pos"], F.xxhash64(x["h"], second["h"])).otherwise(F.xxhash64(second["h"], x["h"]))
            value = F.when(both, inorder).otherwise(F.xxhash64(x["h"]))
            shown = F.concat(F.lpad(F.hex(place(x)), 2, "0"), F.lpad(F.hex(value.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
            return F.when(first, shown)

        return F.array_join(F.sort_array(F.array_compact(F.transform(s, entry))), ".")

    for c, out in columns.items():
        df = df.withColumn(out, tuples(c)).drop(f"__numbered_{c}")
    return df


def likeness(a: Column, b: Column) -> Column:
    """Share of the ranges used by either fingerprint in which both agree, 0 to 1; two empty ones are alike."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    ranges = F.array_union(F.transform(x, lambda t: F.substring(t, 1, 2)), F.transform(y, lambda t: F.substring(t, 1, 2)))
    same = F.size(F.array_intersect(x, y)).cast("double")
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(same / F.size(ranges))


def neighbours(ids: DataFrame) -> DataFrame:
    """(key, following): the next larger key of each, the least after the largest. ids: distinct (key, ...).

    Keys are dealt out by ranges; only the first key of each range goes through one task.
    """
    dealt = materialize(ids.select("key").repartitionByRange("key").select("key", F.spark_partition_id().alias("part")), "id-ranges")
    firsts = dealt.groupBy("part").agg(F.min("key").alias("first"))
    order = Window.orderBy("first")
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("after"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return dealt.select("key", "part", inside.alias("inside")).join(after, "part").select("key", F.coalesce("inside", "after").alias("following"))


def _printed(rows: DataFrame) -> DataFrame:
    return with_fingerprints(rows, {"text": "fingerprint"})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of each row, from its text alone; a null text is empty, and has an empty
    fingerprint; null ids stay null; repeated rows each get a row; an empty table gives an empty table."""
    return _printed(texts(docs, id_col, text_col)).select(id_value("key").alias(id_col), F.char_length("text").cast("long").alias("n_chars"), "fingerprint")


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row against an edited text and the next document: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, text_hash.

    The last quarter of the characters is replaced by as many of the next document in the order of
    ids (null first; after the last the first). Rows that share an id have the same next document;
    where the next id has several texts, it is the one of least hash. A lone document is its own next.
    Null texts are empty, repeated rows each get a row, and an empty table gives an empty table.

    Texts and their fingerprints are exchanged once, by id: both the heads that are given and the rows
    that take them are read from that exchange, so both must ask for the same columns of it.
    """
    rows = texts(docs, id_col, text_col)
    ids = rows.groupBy("key").agg(F.max(F.floor(F.char_length("text") / 4)).cast("int").alias("need"), F.min("body").alias("least"))
    ids = materialize(ids, "lengths")
    order = neighbours(ids).join(ids.select("key", "need"), "key").select(F.col("key").alias("before"), F.col("following").alias("key"), "need")
    order = materialize(order.join(ids.select("key", "least"), "key"), "edit-order")
    printed = _printed(rows)
    # As a condition of values, not of rows: a condition of rows would become part of the join's keys.
    given = lambda c: F.first(F.when(F.col("body") == F.col("least"), c), ignorenulls=True)
    heads = printed.join(order, "key").groupBy("before").agg(given(F.left("text", F.col("need"))).alias("head"), given(F.col("fingerprint")).alias("next_fingerprint"))
    n = F.char_length("text")
    part = F.floor(n / 4).cast("int")
    both = printed.join(heads, printed["key"] == heads["before"])
    both = both.select("key", "body", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(F.left("text", n - part), F.left("head", part)).alias("edited"))
    both = both.select("*", F.sha2("edited", 256).alias("edited_sha256"))
    done = with_fingerprints(both, {"edited": "edited_fingerprint"}).drop("edited")
    return done.select(
        id_value("key").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.col("body").alias("text_hash"),
    )
