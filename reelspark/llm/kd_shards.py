"""Shards by K-d tree: near equal in bytes, each a box of the documents' metadata.

The tree is grown level by level over all open boxes at once. A box goes to as many shards as its
leaves; it is split along the dimension in which its documents lie widest, where the bytes on both sides
are as the numbers of shards. That weighted median is found by counting: bytes are summed in up to CELLS
stretches of each box, and the stretch that holds the median is counted again in finer ones. Sums are made
before anything moves, and one row a stretch is exchanged.

What is split are groups of equal texts, so copies stay together. A group heavier than a share of a shard
is dealt out by hash into pieces first, so that neither a box nor a task has to hold it whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm._store import id_key, id_value, materialize, new_path, text_hash, unused

#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Stretches that a box is counted in at once.
CELLS = 4096
#: A group of more than this part of a shard is dealt out, and a stretch of less than a quarter of that isn't counted finer.
SLACK = 128
#: Rows of a shard that are numbered in one task.
SLOT_ROWS = 1 << 16
#: Splits of a level are sent to all tasks, two rows for each shard at most; more shards than this are refused.
MOST_SHARDS = 1 << 20

_SCALE = 1 << 31


def _place(docs: DataFrame, name: str) -> Column:
    """A row's place in a dimension: the number itself, or a hash of any other value, so equal values are in one place."""
    numeric = isinstance(docs.schema[name].dataType, T.NumericType)
    value = F.nanvl(docs[name].cast("double"), F.lit(None).cast("double")) if numeric else F.shiftrightunsigned(F.xxhash64(docs[name].cast("string")), 33).cast("double")
    return F.when(docs[name].isNotNull(), value)


def _measured(docs: DataFrame, dims: list[str], id_col: str, text_col: str, row: Column) -> DataFrame:
    """(key, body, row, size, crc, d0, d1, ...): all that is needed of a document, without its text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    places = [_place(docs, name).alias(f"d{i}") for i, name in enumerate(dims)]
    return docs.select(id_key(docs[id_col]).alias("key"), text_hash(docs[text_col]).alias("body"), row.alias("row"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("crc"), *places)


def _in_pieces(rows: DataFrame, piece: float) -> DataFrame:
    """``rows`` with ``salt``: groups of equal texts above ``piece`` bytes are dealt out by id, sets of equal rows above it row by row.

    The heavy groups are told to all tasks: there are at most all bytes over ``piece`` of them, a fixed number.
    """
    heavy = lambda by: rows.groupBy(*by).agg(F.sum("size").alias("all")).where(F.col("all") > piece).select(*[F.col(c).alias(f"of_{c}") for c in by], F.ceil(F.col("all") / piece).alias(f"pieces_{by[-1]}"))
    groups, twins = heavy(["body"]), heavy(["body", "key"])
    out = rows.join(F.broadcast(groups), F.col("body") == F.col("of_body"), "left").drop("of_body")
    out = out.join(F.broadcast(twins), (F.col("body") == F.col("of_body")) & (F.col("key") == F.col("of_key")), "left").drop("of_body", "of_key")
    drawn = F.when(F.col("pieces_key").isNotNull(), F.xxhash64("key", "row")).otherwise(F.xxhash64("key"))
    return out.select(*rows.columns, F.when(F.col("pieces_body").isNotNull(), F.pmod(drawn, F.col("pieces_body"))).otherwise(0).alias("salt"))


def _units(rows: DataFrame, n_dims: int) -> DataFrame:
    """(body, salt, weight, c0, c1, ...): what is split. A code is the place, scaled to 31 bits, and 32 bits that order ties:
    heavy units, by a hash's parity, at both ends and light ones in the middle, where the cut falls; then by hash."""
    spans = rows.agg(*[f(f"d{i}").alias(f"{name}{i}") for i in range(n_dims) for name, f in (("low", F.min), ("high", F.max))]).first()
    units = rows.groupBy("body", "salt").agg(F.sum("size").alias("weight"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(n_dims)])
    drawn = F.xxhash64("body", "salt", F.lit("tie"))
    heavy = F.least(F.lit(32767), F.floor(F.log2(F.col("weight") + 1.0) * 1024)).cast("long")
    tie = F.shiftleft(F.when(drawn > 0, 32767 - heavy).otherwise(32768 + heavy), 16) + drawn.bitwiseAND(F.lit(65535))

    def code(i: int) -> Column:
        low, high = spans[f"low{i}"], spans[f"high{i}"]
        wide = (high or 0.0) - (low or 0.0)
        place = F.floor((F.col(f"d{i}") - low) / wide * (_SCALE - 2)) + 1 if wide > 0 else F.lit(1)
        return F.shiftleft(F.coalesce(place.cast("long"), F.lit(0).cast("long")), 32) + tie

    return units.select("body", "salt", "weight", *[code(i).alias(f"c{i}") for i in range(n_dims)])


def _pick(n_dims: int) -> Column:
    """The code along the dimension ``dim``."""
    return F.element_at(F.array(*[F.col(f"c{i}") for i in range(n_dims)]), F.col("dim").cast("int") + 1)


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))))


def _medians(units: DataFrame, boxes: dict[int, int], piece: float, n_dims: int) -> list[tuple[int, int, int, int]]:
    """(box, dimension, code from which on the second half begins, first shard of the second half) of each open box.

    Of each box one row comes to the driver, so at most one for each shard.
    """
    spark = units.sparkSession
    spans = units.groupBy("box").agg(F.sum("weight").alias("weight"), *[f(F.shiftright(f"c{i}", 32)).alias(f"{name}{i}") for i in range(n_dims) for name, f in (("low", F.min), ("high", F.max))])
    open_, found = [], []
    for r in spans.where(F.col("box").isin([b for b, n in boxes.items() if n > 1]) if len(boxes) <= 1000 else F.lit(True)).collect():
        if boxes[r["box"]] > 1:
            dim = max(range(n_dims), key=lambda i: (r[f"high{i}"] - r[f"low{i}"], -i))
            share = (boxes[r["box"]] // 2) / boxes[r["box"]]
            open_.append((r["box"], dim, r[f"low{dim}"] << 32, (r[f"high{dim}"] + 1 << 32) - 1, 0.0, r["weight"] * share))
    while open_:
        state = _table(spark, open_, ["at", "dim", "low", "high", "below", "want"])
        inside = units.join(F.broadcast(state), F.col("box") == F.col("at")).withColumn("code", _pick(n_dims)).where("code BETWEEN low AND high")
        width = F.greatest(((F.col("high") - F.col("low")).cast("double") + 1) / CELLS, F.lit(1.0))
        cells = inside.groupBy("at", "dim", "below", "want", F.floor((F.col("code") - F.col("low")) / width).alias("cell")).agg(F.sum("weight").alias("weight"), F.min("code").alias("first"), F.max("code").alias("last"))
        order = Window.partitionBy("at").orderBy("cell")
        cells = cells.withColumn("through", F.col("below") + F.sum("weight").over(order)).withColumn("turn", F.row_number().over(Window.partitionBy("at").orderBy((F.col("through") < F.col("want")), "cell")))
        again = []
        for r in cells.where("turn = 1").collect():
            box, before = r["at"], r["through"] - r["weight"]
            if r["first"] == r["last"] or r["weight"] <= piece / 4:
                cut = r["first"] if r["want"] - before <= r["through"] - r["want"] else r["last"] + 1
                found.append((box, r["dim"], cut, box + boxes[box] // 2))
            else:
                again.append((box, r["dim"], r["first"], r["last"], before, r["want"]))
        open_ = again
    return found


def _boxed(units: DataFrame, n_shards: int, piece: float, n_dims: int) -> DataFrame:
    """``units`` with ``box``, the shard; while the tree grows, a box is named by the first of its shards."""
    units = materialize(units.withColumn("box", F.lit(0).cast("long")), "kd-units")
    boxes = {0: n_shards}
    while max(boxes.values()) > 1:
        splits = _medians(units, boxes, piece, n_dims)
        if not splits:
            break
        table = _table(units.sparkSession, splits, ["at", "dim", "cut", "second"])
        joined = units.join(F.broadcast(table), F.col("box") == F.col("at"), "left")
        box = F.when(_pick(n_dims) >= F.col("cut"), F.col("second")).otherwise(F.col("box"))
        units = materialize(joined.select(*[c for c in units.columns if c != "box"], box.alias("box")), "kd-units")
        boxes = {b: m for at, n in boxes.items() for b, m in (((at, n // 2), (at + n // 2, n - n // 2)) if n > 1 else ((at, n),))}
    return units


def _slotted(rows: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """``rows`` with ``slot``, from 0 on in each shard without gaps: bins of rows are numbered, and begin where those before them end."""
    bins = -(-n_rows // (n_shards * SLOT_ROWS))
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("key", "body", "row"), F.lit(bins)))
    sizes = rows.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bin", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("turn", F.row_number().over(Window.partitionBy("shard", "bin").orderBy("key", "body", "row")) - 1)
    return numbered.join(starts, ["shard", "bin"]).withColumn("slot", (F.col("start") + F.col("turn")).cast("long"))


def _assigned(measured: DataFrame, n_dims: int, n_shards: int | None, target_bytes: int | None) -> DataFrame:
    rows = materialize(measured, "kd-rows")
    n_rows, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if n_shards is None:
        n_shards = max(1, -(-(total or 0) // target_bytes))
    if not 1 <= n_shards <= MOST_SHARDS:
        raise ValueError(f"{n_shards} shards; 1 to {MOST_SHARDS} are possible")
    piece = (total or 0) / (n_shards * SLACK)
    rows = materialize(_in_pieces(rows, piece), "kd-pieces")
    units = _boxed(_units(rows, n_dims), n_shards, piece, n_dims)
    own = units.select(F.col("body").alias("of"), F.col("salt").alias("piece"), F.col("box").cast("int").alias("shard"))
    placed = rows.join(own, (F.col("body") == F.col("of")) & (F.col("salt") == F.col("piece"))).select("key", "body", "row", "size", "crc", "shard")
    return _slotted(materialize(placed, "kd-placed"), max(1, n_rows), n_shards)


def shards(docs: DataFrame, dims: list[str], n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    Shards are ``n_shards`` many, or as many as hold ``target_bytes`` each; a row's size is its text's
    UTF-8 bytes and 16. The law is ``bytes``: sizes of shards differ by little more than a document, and by
    a 128th of a shard for each level of the tree. Equal texts are in one shard, unless they weigh more
    than a 128th of it. ``dims`` are columns of any simple type; null is a place of its own. A null
    text is empty, null ids stay null, equal rows are placed one by one. With fewer different texts than
    shards some shards stay empty; an empty table gives an empty table. ``grown_shard`` is null: this law
    doesn't tell where a document goes when a shard is added.
    """
    if (n_shards is None) == (target_bytes is None):
        raise ValueError("give n_shards or target_bytes")
    placed = _assigned(_measured(docs, dims, id_col, text_col, F.monotonically_increasing_id()), len(dims), n_shards, target_bytes)
    return placed.select(id_value("key").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, dims: list[str], n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all columns of ``docs`` as Parquet, a folder for each shard, with ``slot``.

    Rows are numbered in a table first, so that each finds its place again even where ids and texts repeat;
    a shard is written by several tasks, each with a range of its slots.
    """
    row = unused(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    kept = new_path(docs.sparkSession, "kd-numbered")
    numbered.write.parquet(kept)
    numbered = docs.sparkSession.read.schema(numbered.schema).parquet(kept)
    placed = _assigned(_measured(numbered, dims, id_col, text_col, numbered[row]), len(dims), n_shards, target_bytes)
    shard, slot = unused(numbered, "shard"), unused(numbered, "slot")
    own = placed.select(F.col("row").alias(unused(numbered, "own_row")), F.col("shard").alias(shard), F.col("slot").alias(slot))
    joined = numbered.join(own, numbered[row] == own[own.columns[0]]).drop(row, own.columns[0])
    joined.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
