"""Records of CSV files read in byte ranges: quoted line breaks without one task per file.

Spark splits a text file at line feeds, but a line feed inside quotes does not
end a record.  Whether a range starts inside quotes depends on everything
before it, so the ranges are read twice:

1. *Maps.*  One pass turns every range into a map of two states -- outside or
   inside quotes at its first line -- to the state behind its last line, and
   whether a record starts in it.  It is right for any start of the range.
2. *Scan.*  The maps of a file (one small row per range) are composed in file
   order.  That gives each range the state it starts in, and the range where
   the record that is open at its first line began.
3. *Records.*  The second pass cuts every range at its record starts.  Records
   inside a range leave as they are, without a shuffle.  Pieces of records that
   cross a range border are read from the ranges beside an open border only,
   and joined by the range where the record began.

Quotes count where a field starts (as RFC 4180 has it); a quote inside an
unquoted field is text.  A quote that nobody closes makes the rest of its file
one record.  Ranges are pinned by a session of their own that only reads, so
both passes see the same ranges whatever the cluster's size is by then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 64 << 20
_CLOSE = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
_MAP = "file long, start long, from_outside boolean, from_inside boolean, starts_outside boolean, starts_inside boolean"


def inside_after(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether the line feed behind ``line`` stands inside quotes, given the same for the one before it."""
    at = 0
    while True:
        if inside or line.startswith('"', at):
            closed = _CLOSE.match(line, at if inside else at + 1)
            if closed is None:
                return True
            at = closed.end()
        inside = False
        at = line.find(sep, at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """(file, start, line) in file order inside each range; file and start name the range."""
    pinned = spark.newSession()
    for key, value in (("maxPartitionBytes", range_bytes), ("openCostInBytes", min(range_bytes, 4 << 20)), ("minPartitionNum", 1)):
        pinned.conf.set(f"spark.sql.files.{key}", str(value))
    lines = pinned.read.text(path, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"))
    return spark.createDataFrame([], lines.schema).union(lines)      # runs under the caller's session from here on


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str], list[bool]]]:
    """((file, start), lines, which of them hold a quote), in order; a range may come in several parts."""
    for b in batches:
        files, starts = b.column(0).to_numpy(), b.column(1).to_numpy()
        quoted = pc.match_substring(b.column(2), '"').to_pylist()
        lines = b.column(2).to_pylist()
        at = 0
        while at < b.num_rows:
            end = at + 1
            while end < b.num_rows and starts[end] == starts[at] and files[end] == files[at]:
                end += 1
            yield (int(files[at]), int(starts[at])), lines[at:end], quoted[at:end]
            at = end


def range_maps(lines: DataFrame, sep: str = ",") -> DataFrame:
    """One row per range: the state behind it, and whether a record starts in it, for both states before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, starts = None, [False, True], [False, False]

        def row() -> pa.RecordBatch:
            values = [*key, *state, *starts]
            kinds = [pa.int64()] * 2 + [pa.bool_()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                              names=["file", "start", "from_outside", "from_inside", "starts_outside", "starts_inside"])

        for now, texts, quoted in _ranges(batches):
            if now != key:
                if key is not None:
                    yield row()
                key, state, starts = now, [False, True], [False, False]
            for text, has in zip(texts, quoted):
                starts = [s or not inside for s, inside in zip(starts, state)]
                if has:
                    state = [inside_after(text, inside, sep) for inside in state]
        if key is not None:
            yield row()

    return lines.mapInArrow(run, _MAP)


def compose(maps: DataFrame) -> DataFrame:
    """(file, start, inside, opened, next_inside): the state each range starts in, and where the open record began.

    One group per file, of one small row per range.
    """

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("start").to_pydict()
        inside, opened, out = False, None, []
        for i, start in enumerate(rows["start"]):
            before = (inside, opened)
            if rows["starts_inside" if inside else "starts_outside"][i]:
                opened = start
            inside = rows["from_inside" if inside else "from_outside"][i]
            out.append((*before, inside))
        return pa.table({"file": pa.array(rows["file"], pa.int64()), "start": pa.array(rows["start"], pa.int64()),
                         "inside": pa.array([o[0] for o in out], pa.bool_()), "opened": pa.array([o[1] for o in out], pa.int64()),
                         "next_inside": pa.array([o[2] for o in out], pa.bool_())})

    return maps.groupBy("file").applyInArrow(run, "file long, start long, inside boolean, opened long, next_inside boolean")


def _cut(lines: DataFrame, entry: dict[tuple[int, int], int], sep: str, whole: bool) -> DataFrame:
    """The records that begin and end in their range, or the pieces of the others.

    ``entry`` has the ranges that start inside quotes, with the range where the open record began.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, piece, open_at, first = None, False, [], None, False
        for now, texts, quoted in _with_end(_ranges(batches)):
            out: list[tuple] = []
            if now != key:
                if piece and not whole:          # still open at the end of its range
                    out.append(("\n".join(piece), key[0], open_at, key[1], first))
                key, piece = now, []
                inside = now in entry
                open_at = entry.get(now) if inside else now[1] if now else None
                first = bool(now) and now[1] == 0 and not inside
            for text, has in zip(texts, quoted):
                piece.append(text)
                if has:
                    inside = inside_after(text, inside, sep)
                if not inside:
                    if open_at != key[1]:
                        if not whole:            # the end of a record from an earlier range
                            out.append(("\n".join(piece), key[0], open_at, key[1], False))
                    elif whole and not first:
                        out.append(("\n".join(piece), None, None, None, False))
                    piece, open_at, first = [], key[1], False
            if out:
                columns = list(zip(*out))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=["record", "file", "opened", "start", "head"])

    return lines.mapInArrow(run, "record string, file long, opened long, start long, head boolean")


def _with_end(ranges: Iterator[tuple]) -> Iterator[tuple]:
    yield from ranges
    yield (), [], []


def records(spark: SparkSession, path: str, sep: str = ",", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(record): every record of the files but each file's first (its header) and blank lines, in no set order."""
    lines = _lines(spark, path, range_bytes)
    # one row per range beside an open border: a bound set by bytes / range_bytes
    seams = compose(range_maps(lines, sep)).where("inside OR next_inside").collect()
    entry = {(s["file"], s["start"]): s["opened"] for s in seams if s["inside"]}
    found = _cut(lines, entry, sep, True).select("record")
    if seams:
        beside = F.concat_ws(":", F.col("file").cast("string"), F.col("start").cast("string")).isin(
            [f"{s['file']}:{s['start']}" for s in seams])
        pieces = _cut(lines.where(beside), entry, sep, False)
        joined = pieces.groupBy("file", "opened").agg(
            F.sort_array(F.collect_list(F.struct("start", "record"))).alias("p"), F.max("head").alias("head"))
        found = found.union(joined.where(~F.col("head")).select(F.array_join("p.record", "\n").alias("record")))
    bare = F.when(F.endswith("record", F.lit("\r")), F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    return found.select(bare.alias("record")).where("record <> ''")
