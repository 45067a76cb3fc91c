"""Raw trip records: CSV of any size with record numbers, read in byte ranges.

Spark's own CSV reader drops blank lines and cuts over-wide rows to the schema; record
numbers and widths need the records as they stand, and quoted fields may hold line breaks,
so a range alone doesn't tell where its first record begins.

Spark's text source cuts files into ranges at line feeds, on any file system that it knows.
A first pass packs consecutive lines into chunks and reads each chunk twice: as if it began
between records, and as if it began inside a quoted field. At a line feed a reader is in
one of these two states, so what a chunk makes of either, and how many records end in it,
is all that is needed: windows over a file's chunks then give every chunk the state that
it really begins with and the number of its first record. Chunks are stored, so both passes
see the same ones. The second pass parses chunks in parallel. Only a record that begins in
one chunk and ends in another is put together from its pieces, by number.

Defined cases: blank records are counted and left out; a byte-order mark is passed over; a
carriage return alone ends a record, as it does for the csv module; a quote that nothing
closes takes the rest of the file, read as if it ended in a line feed. A file without
records, or with another header, is a ContractViolation. No bytes, no file, or a folder
without .csv files give no rows.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tripforge.sources.scratch import stored

#: Characters of lines that one chunk takes (a longer line is a chunk of its own).
CHUNK = 4 << 20
LONGEST = (1 << 31) - 1
#: What a reader is told after a chunk, to see whether a quoted field is open.
PROBE = "\x00probe"


class ContractViolation(ValueError):
    """The header isn't the expected one."""


def lines_of(text: str) -> list[str]:
    """With their ends: line feed, carriage return, or both."""
    return list(io.StringIO(text, newline=""))


def outcome(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a chunk ends inside a quoted field, and how many records end in it."""
    if '"' not in text and "\r" not in text:
        return inside, 0 if inside else text.count("\n")
    csv.field_size_limit(LONGEST)
    n, last = 0, None
    for last in csv.reader([*lines_of('"' + text if inside else text), PROBE]):
        n += 1
    return last != [PROBE], n - 1


def _chunks(size: int):
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("seq", pa.int32()), ("text", pa.large_string()), ("out_open", pa.bool_()), ("out_n", pa.int64()), ("in_open", pa.bool_()), ("in_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seq, held, length = None, 0, [], 0

        def done() -> pa.RecordBatch:
            text = "".join(f"{x}\n" for x in held)
            if place[1] == 0 and seq == 0:
                text = text.removeprefix("\ufeff")
            a, b = outcome(text, False), outcome(text, True)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*place, seq, text, *a, *b), schema, strict=True)], schema=schema)

        for batch in batches:
            for path, block, line in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "value")), strict=True):
                if held and ((path, block) != place or length + len(line) > size):
                    yield done()
                    seq, held, length = (seq + 1 if (path, block) == place else 0), [], 0
                elif (path, block) != place:
                    seq = 0
                place = path, block
                held.append(line)
                length += len(line) + 1
        if held:
            yield done()

    return run


def _placed(chunks: DataFrame) -> DataFrame:
    """Adds open (the state that a chunk begins with) and before (records that ended)."""
    order = Window.partitionBy("path").orderBy("block", "seq")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = (~F.col("in_open") & F.col("out_open")).cast("int")  # each state becomes the other
    rows = chunks.withColumn("_turns", F.sum(turns).over(order))
    fixed = F.when(F.col("out_open") == F.col("in_open"), F.struct(F.col("out_open").cast("int").alias("state"), "_turns"))
    rows = rows.withColumn("_last", F.last(fixed, ignorenulls=True).over(earlier)).withColumn("_so_far", F.coalesce(F.max("_turns").over(earlier), F.lit(0)))
    state = F.coalesce(F.col("_last.state") + F.col("_so_far") - F.col("_last._turns"), F.col("_so_far")) % 2
    rows = rows.withColumn("open", state == 1)
    ended = F.when(F.col("open"), F.col("in_n")).otherwise(F.col("out_n"))
    return rows.withColumn("before", F.coalesce(F.sum(ended).over(earlier), F.lit(0))).select("path", "block", "seq", "open", "before")


PARSED = "path string, number long, vals array<string>, block long, seq int, piece string"


def _check(path: str, number: int, values: list[str], header: tuple[str, ...]) -> bool:
    """Whether to keep the record: not the header, not blank."""
    if number == 1 and tuple(values) != header:
        raise ContractViolation(f"{path}: the columns don't match the contract of {len(header)} fields")
    return number > 1 and bool(values)


def _parse(header: tuple[str, ...]):
    """Records within a chunk, and as pieces those that reach beyond it."""
    names = [x.split()[0] for x in PARSED.split(", ")]
    types = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST)
        for batch in batches:
            for r in batch.to_pylist():
                lines, number, out, at = lines_of(r["text"]), r["before"] + 1, [], 0
                last = r["open_after"]
                if r["open"]:  # the piece that ends the record from before, if it ends
                    reader = csv.reader(['"' + lines[0], *lines[1:], PROBE])
                    next(reader)
                    at = min(reader.line_num, len(lines))
                    out.append((r["path"], number, None, r["block"], r["seq"], "".join(lines[:at])))
                    number += 1
                    if reader.line_num > len(lines):  # it doesn't
                        last = False
                rest, start = lines[at:], 0
                reader, held = csv.reader(rest), None
                for values in reader:
                    if held is not None and _check(r["path"], held[0], held[1], header):
                        out.append((r["path"], *held, r["block"], r["seq"], None))
                    held, before, start = (number, values), start, reader.line_num
                    number += 1
                if held is not None and last:
                    out.append((r["path"], held[0], None, r["block"], r["seq"], "".join(rest[before:])))
                elif held is not None and _check(r["path"], held[0], held[1], header):
                    out.append((r["path"], *held, r["block"], r["seq"], None))
                for i in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 10_000], strict=True), types, strict=True)], names)

    return run


def _joined(header: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                values = next(csv.reader(lines_of("".join(r["pieces"]))))
                if _check(r["path"], r["row_number"], values, header):
                    out.append((r["path"], r["row_number"], values))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.list_(pa.string())), strict=True)], ["path", "row_number", "vals"])

    return run


def read_trips(spark: SparkSession, path: str, header: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """(path, row_number, vals): records as they stand, blank ones left out but counted.
    path: a file or a folder of .csv files."""
    header = tuple(header)
    folder, empty = _files(spark, path)
    if empty:
        raise ContractViolation(f"{empty[0]}: no header")
    which = {"pathGlobFilter": "*.csv"} if folder else {}
    lines = spark.read.options(**which).option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    chunks = stored(lines.mapInArrow(_chunks(chunk), "path string, block long, seq int, text string, out_open boolean, out_n long, in_open boolean, in_n long"), "csv-chunks")
    # a row for each chunk, without its text
    placed = stored(_placed(chunks.drop("text")), "csv-places")
    rows = chunks.join(placed, ["path", "block", "seq"])
    rows = rows.withColumn("open_after", F.when(F.col("open"), F.col("in_open")).otherwise(F.col("out_open")))
    rows = stored(rows.select("path", "block", "seq", "text", "open", "before", "open_after").mapInArrow(_parse(header), PARSED), "csv-records")
    whole = rows.where("piece IS NULL").select("path", F.col("number").alias("row_number"), "vals")
    pieces = rows.where("piece IS NOT NULL").groupBy("path", F.col("number").alias("row_number")).agg(F.array_sort(F.collect_list(F.struct("block", "seq", "piece"))).alias("p"))
    return whole.unionByName(pieces.select("path", "row_number", F.col("p.piece").alias("pieces")).mapInArrow(_joined(header), "path string, row_number long, vals array<string>"))


def _files(spark: SparkSession, path: str) -> tuple[bool, list[str]]:
    """Whether it is a folder, and the files without bytes, which Spark's readers pass over."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    folder = fs.getFileStatus(at).isDirectory()
    found = [(x.getPath().toString(), x.getLen()) for x in fs.listStatus(at) if x.isFile()]
    return folder, [p for p, n in found if not n and (p.endswith(".csv") or not folder)]


def audit(rows: DataFrame, width: int) -> DataFrame:
    """Rows, rows of a wrong width, rows that the contract rejects (of `parsed` or `classified`)."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("width") != width).alias("wrong_width"), F.count_if((F.col("width") == width) & F.col("bad").isNotNull()).alias("rejected"))
