"""Consolidation of very many tiny raster files into few Parquet files per kind and year.

A payload is a headerless run of little-endian float32 in [day][lat][lon] order,
one encoded column block per day. Blocks are copied as they are into the value
column of larger Parquet files whose footers are written new (see
``sources.parquet_blocks``); nothing is decoded. Blocks travel once: they are
dealt to the output files by object and month and arrive there by object, day and
file, so the writer itself sees the versions of a day next to each other. An equal
version is skipped; of a differing one only the records that no earlier file
carried are copied. Equal versions of a day also collapse within each input batch, before
they travel, and an object's month is bounded by the calendar, so neither a hot
object nor a group of copies gathers in one task.

Rules: a file is whole if its payload is not empty and as long as its days and
grid say; others carry no record. Files count in order of file_id. Values are
told apart by their bits. The first day is read from the path, which always shows
it, else from start_day; of a whole file that shows neither ``consolidate`` warns, and
it is listed in ``undated``. NULL file_id or object_id: no record.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygrid.session import fresh_dir, materialise, remove, settle

#: Bytes of values that one consolidated file should hold.
TARGET_BYTES = 128 << 20
KINDS = ("rain", "tmax", "tmin", "other")

#: Bytes of blocks that a task looks through for copies at a time.
HELD_BYTES = 32 << 20

MANIFEST = T.StructType(
    [T.StructField("cat", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("blocks", T.LongType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("days", T.LongType())]
)
#: A written file (path not NULL) or a file_id of which records were copied.
WRITTEN = T.StructType([*MANIFEST.fields, T.StructField("file_id", T.LongType())])
BLOCKS = T.StructType(
    [T.StructField("object_id", T.LongType()), T.StructField("day", T.IntegerType()), T.StructField("file_id", T.LongType()), T.StructField("n_lat", T.IntegerType()), T.StructField("n_lon", T.IntegerType()), T.StructField("block", T.BinaryType())]
)


def first_day(path: Column, start_day: Column) -> Column:
    """First day of a file: by the naming styles of its path, else by start_day (yyyy-MM-dd, yyyyMMdd, with or without a time)."""
    base = F.regexp_extract(path, r"[^/]*$", 0)

    def day(text: Column, year: int, month: int, last: int, century: Column | None = None) -> Column:
        """A date from a text's digits at these places, NULL if there is none."""
        y = F.substring(text, year, 4) if century is None else F.concat(century, F.substring(text, year, 2))
        return F.concat_ws("-", y, F.substring(text, month, 2), F.substring(text, last, 2)).try_cast("date")

    yy = F.regexp_extract(base, r"(?i)ind0\.25_(\d{2}_\d{2}_\d{2})", 1)
    by_kind = F.regexp_extract(base, r"(?i)(?:max|min)(\d{8})(?!\d)", 1)
    dashed = F.regexp_extract(base, r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)", 1)
    plain = F.regexp_extract(base, r"(?<!\d)(\d{8})(?!\d)", 1)
    own = F.substring(F.trim(start_day), 1, 10)
    return F.coalesce(
        F.when(yy != "", day(yy, 1, 4, 7, F.when(F.substring(yy, 1, 2) >= "91", "19").otherwise("20"))),
        F.when(by_kind != "", day(by_kind, 5, 3, 1)),
        F.when(dashed != "", day(dashed, 1, 6, 9)),
        F.when(plain != "", day(plain, 1, 5, 7)),
        F.when(F.regexp_like(own, F.lit(r"^\d{4}-\d{2}-\d{2}$")), day(own, 1, 6, 9)),
        F.when(F.regexp_like(own, F.lit(r"^\d{8}")), day(own, 1, 5, 7)),
    )


def kind(path: Column, cat: Column) -> Column:
    """Place in KINDS: by cat where that is clean after trimming and lower case, else by the path."""
    c, p = F.lower(F.trim(cat)), F.lower(path)
    number = F.when(c == KINDS[0], 0).when(c == KINDS[1], 1).when(c == KINDS[2], 2)
    by_path = F.when(p.contains("rain"), 0).when(p.contains("tmax") | p.contains("/max"), 1).when(p.contains("tmin") | p.contains("/min"), 2)
    return F.coalesce(number, by_path, F.lit(3))


def day_blocks(files: DataFrame) -> DataFrame:
    """One row per whole file and day: file_id, object_id, cat, day, n_lat, n_lon, block."""
    cells = F.col("n_lat").cast("long") * F.col("n_lon").cast("long")
    f = files.select(
        F.col("file_id").cast("long").alias("file_id"),
        F.col("object_id").cast("long").alias("object_id"),
        kind(F.col("path"), F.col("cat")).alias("cat"),
        first_day(F.col("path"), F.col("start_day")).alias("first"),
        F.col("no_days").cast("int").alias("no_days"),
        F.col("n_lat").cast("int").alias("n_lat"),
        F.col("n_lon").cast("int").alias("n_lon"),
        "payload",
    ).where(
        F.col("file_id").isNotNull()
        & F.col("object_id").isNotNull()
        & (F.least("no_days", "n_lat", "n_lon") > 0)
        & (F.length("payload") > 0)
        & (F.length("payload") == F.col("no_days") * cells * 4)
    )
    return f.select("file_id", "object_id", "cat", "first", "n_lat", "n_lon", "payload", F.explode(F.sequence(F.lit(0), F.col("no_days") - 1)).alias("d")).select(
        "file_id",
        "object_id",
        "cat",
        F.date_add("first", F.col("d")).alias("day"),
        "n_lat",
        "n_lon",
        F.expr("substring(payload, d * n_lat * n_lon * 4 + 1, n_lat * n_lon * 4)").alias("block"),
    )


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (BLOCKS), equal ones of an object's day within a stretch of the input only by their first file."""
    held: dict[tuple, int] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*held)) or [()] * 5
        cols.insert(2, list(held.values()))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=BLOCKS.names)

    for b in batches:
        object_id, day, file_id, n_lat, n_lon, block = (b.column(i).to_pylist() for i in range(6))
        for key, i in zip(zip(object_id, day, n_lat, n_lon, block), file_id):
            if held.setdefault(key, i) > i:
                held[key] = i
        size += b.nbytes
        if size > HELD_BYTES:
            yield flush()
            held, size = {}, 0
    if held:
        yield flush()


def _axis(coords: list[float] | None, n: int) -> np.ndarray:
    """Coordinates of an axis; without the object's, NaN."""
    return np.array(coords, "<f8") if coords is not None and len(coords) == n else np.full(n, np.nan)


def _codes(block: bytes, n_lat: int, n_lon: int) -> np.ndarray:
    """One number per record of a block: its cell and the bits of its value."""
    cell = np.repeat(np.arange(n_lat, dtype=np.uint64) << np.uint64(16), n_lon) + np.tile(np.arange(n_lon, dtype=np.uint64), n_lat)
    return cell << np.uint64(32) | np.frombuffer(block, "<u4").astype(np.uint64)


def _writer(out_dir: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        from skygrid.sources.parquet_blocks import BlockFile

        store, root = fs.FileSystem.from_uri(out_dir)
        current: tuple[int, int] | None = None
        files: dict[str, tuple] = {}
        made: list[tuple] = []
        carried: set[int] = set()

        def file_of(cat: str):
            if cat not in files:
                folder = f"{root}/{cat}/{current[0]}"
                store.create_dir(folder, recursive=True)
                temp = f"{folder}/.{uuid.uuid4().hex}"
                sink = store.open_output_stream(temp)
                files[cat] = (BlockFile(sink), sink, temp)
            return files[cat][0]

        def finish() -> None:
            for cat, (file, sink, temp) in files.items():
                size = file.close()
                sink.close()
                name = f"{cat}/{current[0]}/part-{current[1]:05d}.parquet"
                store.move(temp, f"{root}/{name}")  # a task that runs again writes the same bytes and replaces the file
                made.append((cat, current[0], f"{out_dir}/{name}", file.blocks, file.rows, size, file.days))
            files.clear()

        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))

        key, first, seen = None, None, None
        cat, axes, shapes = "other", (None, None), {}
        for year, bucket, object_id, day, file_id, n_lat, n_lon, block, own_cat, lats, lons in rows():
            if (year, bucket) != current:
                finish()
                current = (year, bucket)
            if day is None:  # an object's axes come before its blocks
                cat, axes, shapes = own_cat, (lats, lons), {}
                continue
            shape = (n_lat, n_lon)
            if shape not in shapes:
                shapes[shape] = np.repeat(_axis(axes[0], n_lat), n_lon), np.tile(_axis(axes[1], n_lon), n_lat)
            lat, lon = shapes[shape]
            if (object_id, day) != key:
                key, first, seen = (object_id, day), (shape, block), None
                file_of(cat).add(object_id, day, lat, lon, block, True)
                carried.add(file_id)
                continue
            if (shape, block) == first:
                continue
            codes = _codes(block, *shape)
            if seen is None:
                seen = set(_codes(first[1], *first[0]).tolist())
            new = [k for k, c in enumerate(codes.tolist()) if c not in seen]
            if new:
                seen.update(codes[new].tolist())
                part = np.frombuffer(block, "<u4")[new].tobytes()
                file_of(cat).add(object_id, day, lat[new], lon[new], part, False)
                carried.add(file_id)
        finish()
        ids = sorted(carried)
        cols = list(zip(*made)) or [()] * 7
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c) + [None] * len(ids), t) for c, t in zip(cols, kinds)), pa.array([None] * len(made) + ids, pa.int64())], names=WRITTEN.names)

    return run


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path to (rows, schema as text) by the written footer."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for b in batches:
        paths, rows, schemas = b.column(0).to_pylist(), [], []
        for p in paths:
            store, root = fs.FileSystem.from_uri(p)
            with store.open_input_file(root) as f:
                m = pq.ParquetFile(f)
                rows.append(m.metadata.num_rows)
                schemas.append(",".join(f"{c.name}:{c.type}" for c in m.schema_arrow))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(rows, pa.int64()), pa.array(schemas, pa.string())], names=["path", "rows", "schema"])


SCHEMA_TEXT = "object_id:int64,day:date32[day],lat:double,lon:double,value:float"


@dataclass
class Consolidation:
    """What a run left: the manifest of written files, the files that add nothing, the folder, and the undated files, whose records are in no output."""

    manifest: DataFrame
    adds_nothing: DataFrame
    out_dir: str
    undated: DataFrame


def consolidate(files: DataFrame, objects: DataFrame, out_dir: str | None = None, target_bytes: int = TARGET_BYTES) -> Consolidation:
    """Write few well-sized Parquet files per kind and year under out_dir and validate them.

    Every distinct record (object, day, lat, lon, value) of a whole file is present
    exactly once. After writing, schema and row count are read back from every
    footer and held against what was written, and days and records are held against
    counts taken from the input beforehand; any difference raises. adds_nothing lists file_id of the files without a kept
    record. Whole files without a day cannot be placed: they are warned of and listed
    in undated, not in adds_nothing. An empty table gives an empty manifest. Nothing but
    the output and the small results stays behind. Only rows by year and by output file
    are broadcast; what grows with files or objects never passes the driver.
    """
    spark = files.sparkSession
    out_dir = out_dir or fresh_dir(spark, "consolidated")
    scratch: list[str] = []
    every = day_blocks(files)
    blocks = every.where(F.col("day").isNotNull())
    key, cells = ["object_id", "day"], F.col("n_lat").cast("long") * F.col("n_lon")
    # a few numbers per object and day, added up before they travel
    days = every.groupBy(*key).agg(
        F.min("cat").alias("cat"), F.max(cells).alias("cells"), (F.min(F.xxhash64("n_lat", "n_lon", "block")) == F.max(F.xxhash64("n_lat", "n_lon", "block"))).alias("single")
    )
    known = objects.where(F.col("object_id").isNotNull()).groupBy(F.col("object_id").cast("long").alias("object_id")).agg(F.min("lat_array").alias("lats"), F.min("lon_array").alias("lons"))
    year, month = F.year("day"), F.month("day")
    months = days.groupBy("object_id", year.alias("year"), month.alias("month")).agg(
        F.min("cat").alias("cat"), F.count(F.lit(1)).alias("days"), F.sum("cells").alias("cells"), F.sum(F.when(F.col("single"), F.col("cells")).otherwise(0)).alias("single"), F.count_if(~F.col("single")).alias("several")
    )
    # hinted: from sizes of files the planner takes many objects for few, and their axes would go through the driver
    months = materialise(months.join(known.hint("merge"), "object_id", "left"), "months", scratch)
    # one row per calendar year: how many files its largest kind needs
    late = months.where("year is null").limit(1).count()  # whole files that show no day
    months = months.where("year is not null")
    plan = months.groupBy("year", "cat").agg(F.sum("cells").alias("cells")).groupBy("year").agg(F.ceil(4 * F.max("cells") / target_bytes).cast("int").alias("outputs"))
    bucket = F.pmod(F.xxhash64("object_id", "month"), F.col("outputs").cast("long")).cast("int").alias("bucket")
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    sent = blocks.select("object_id", number.alias("day"), "file_id", "n_lat", "n_lon", "block").mapInArrow(_once, BLOCKS)
    date = F.date_from_unix_date("day")
    sent = sent.withColumns({"year": F.year(date), "month": F.month(date)}).join(F.broadcast(plan), "year")
    none = lambda kind: F.lit(None).cast(kind)
    order = ["year", "bucket", "object_id", "day", "file_id"]
    axes = months.join(F.broadcast(plan), "year").select("year", bucket, "object_id", none("int").alias("day"), none("long").alias("file_id"), none("int").alias("n_lat"), none("int").alias("n_lon"), none("binary").alias("block"), F.element_at(F.array(*[F.lit(x) for x in KINDS]), F.col("cat") + 1).alias("cat"), "lats", "lons")
    payload = sent.select("year", bucket, "object_id", "day", "file_id", "n_lat", "n_lon", "block", none("string").alias("cat"), none("array<double>").alias("lats"), none("array<double>").alias("lons"))
    written = payload.unionByName(axes).repartition("year", "bucket").sortWithinPartitions(*order).mapInArrow(_writer(out_dir), WRITTEN)
    written = materialise(written, "written", scratch)
    manifest = written.where(F.col("path").isNotNull()).select(*MANIFEST.names)
    footers = manifest.select("path").repartition("path").mapInArrow(_footers, "path string, rows long, schema string")
    bad = manifest.join(footers, "path", "left").where(F.col("rows").isNull() | (F.col("rows") != F.col("records")) | (F.col("schema") != SCHEMA_TEXT)).count()
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    got = manifest.agg(zero("records"), zero("days")).first()
    want = months.agg(zero("single"), zero("days"), zero("several"), zero("cells")).first()
    # days of one version have exactly its records, those of several at least one block's
    if bad or got[1] != want[1] or got[0] < want[3] or (not want[2] and got[0] != want[0]):
        raise RuntimeError(f"consolidation is not whole: {bad} bad files, {got[0]} of {want[3]} records or more, {got[1]} of {want[1]} days")
    lost = settle(undated(files) if late else undated(files.limit(0)))
    if late:
        warnings.warn(f"{lost.count()} whole files show no day; their records are in no output", stacklevel=2)
    # counted, not joined: no set of files is ever sent to the driver
    marked = lambda df, kept: df.select(F.col("file_id").cast("long").alias("file_id"), F.lit(kept).alias("kept"))
    ids = marked(files, 0).unionByName(marked(written, 1)).unionByName(marked(lost, 1)).where(F.col("file_id").isNotNull())
    nothing = ids.groupBy("file_id").agg(F.max("kept").alias("kept")).where("kept = 0").select("file_id")
    nothing, manifest = settle(nothing), settle(manifest)
    for path in scratch:
        remove(spark, path)
    return Consolidation(manifest, nothing, out_dir, lost)


def undated(files: DataFrame) -> DataFrame:
    """Whole files of which neither path nor start_day shows a day; their records cannot be placed."""
    return day_blocks(files).where(F.col("day").isNull()).select("file_id").distinct()


def files_adding_nothing(files: DataFrame, objects: DataFrame) -> DataFrame:
    """file_id of the files that add no record to the output, undated ones (of which consolidate warns) among them, from a full consolidation whose output is then removed."""
    done = consolidate(files, objects)
    remove(files.sparkSession, done.out_dir)
    return done.adds_nothing.unionByName(done.undated)
