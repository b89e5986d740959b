"""Master file table: fixed-size records decoded in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blobs import ragged
from ..functions.text import drop_controls
from ..functions.times import filetime_not_sentinel
from ..schema import MFT_SCHEMA

# Layout of a file record.
SIGNATURE = b"FILE"
END_OF_ATTRIBUTES = 0xFFFFFFFF
STANDARD_INFORMATION = 0x10
FILE_NAME = 0x30
REFERENCE_MASK = 0xFFFFFFFFFFFF
SECTOR_BYTES = (256, 4096)
NAME_SCORES = {1: 4, 3: 3, 0: 2, 2: 1}
TIME_STOMP_MICROS = 2_000_000

_RAW = (
    "host string, source string, record_index bigint, in_use boolean, si_created bigint, si_modified bigint,"
    " names array<struct<name:string,namespace:int,parent:bigint,created:bigint,modified:bigint,is_directory:boolean>>"
)


_NAME = pa.struct(
    [("name", pa.string()), ("namespace", pa.int32()), ("parent", pa.int64()), ("created", pa.int64()), ("modified", pa.int64()), ("is_directory", pa.bool_())]
)
_COLUMNS = pa.schema(
    [("host", pa.string()), ("source", pa.string()), ("record_index", pa.int64()), ("in_use", pa.bool_()), ("si_created", pa.int64()), ("si_modified", pa.int64()), ("names", pa.list_(_NAME))]
)


class Records:
    """Records of one size as the rows of a matrix; ``ok`` says which are still believed."""

    def __init__(self, data: np.ndarray):
        self.n, self.size = data.shape
        self.flat = np.append(data.reshape(-1), np.zeros(8, np.uint8))
        self.row = np.arange(self.n) * self.size
        self.ok = (data[:, :4] == np.frombuffer(SIGNATURE, np.uint8)).all(axis=1)

    def number(self, at, kind: str) -> np.ndarray:
        """A number of every record, at one place or at one for each."""
        return self.at(self.row + at, kind)

    def at(self, place: np.ndarray, kind: str) -> np.ndarray:
        """Numbers at places of the whole buffer."""
        every = np.ndarray((len(self.flat) - np.dtype(kind).itemsize + 1,), kind, self.flat, strides=(1,))
        return every[place].astype(np.int64)

    def restore(self) -> None:
        """Put back the sector ends that the update sequence keeps; records whose ends do not carry its mark are not believed."""
        at, count = self.number(4, "<u2"), self.number(6, "<u2")
        sectors = np.maximum(count - 1, 1)
        width = self.size // sectors
        self.ok &= (at > 0) & (count > 1) & (at + 2 * count <= self.size) & (self.size % sectors == 0) & (width >= SECTOR_BYTES[0]) & (width <= SECTOR_BYTES[1])
        live = np.flatnonzero(self.ok)
        sector, which = ragged(np.ones(len(live), np.int64), sectors[live])
        record = live[which]
        end = self.row[record] + sector * width[record] - 2
        kept = self.row[record] + at[record] + 2 * sector
        broken = self.at(end, "<u2") != self.at(self.row[record] + at[record], "<u2")
        self.ok[record[broken]] = False
        good = self.ok[record]
        self.flat[end[good]], self.flat[end[good] + 1] = self.flat[kept[good]], self.flat[kept[good] + 1]

    def attributes(self, start: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, ...]:
        """Record, type, place and size of all resident contents, in order.

        Attributes tell their own lengths, so every record steps to its next one
        at the same time; there are as many steps as one record has attributes.
        """
        record, at, out = np.flatnonzero(self.ok), start[self.ok], []
        used = used[self.ok]
        while True:
            more = at <= used - 8
            record, at, used = record[more], at[more], used[more]
            kind, length = self.at(self.row[record] + at, "<u4"), self.at(self.row[record] + at + 4, "<i4")
            more = (kind != END_OF_ATTRIBUTES) & (length > 0) & (at + length <= used)
            record, at, used, kind, length = (x[more] for x in (record, at, used, kind, length))
            if not len(record):
                break
            here = self.row[record] + at
            head = at + 22 <= used  # long enough to tell a resident content
            near = np.where(head, here, 0)
            size, offset = self.at(near + 16, "<i4"), self.at(near + 20, "<u2")
            resident = head & (self.flat[here + 8] == 0) & (size >= 0) & (offset > 0) & (offset < length) & (offset + size <= length)
            out.append([x[resident] for x in (record, kind, here + offset, size, np.full(len(record), len(out)))])
            at = at + length
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        record, kind, place, size, step = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((step, record))
        return record[order], kind[order], place[order], size[order]


def _names(records: Records, record: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The names among file-name contents, as structs, and their records."""
    long = size >= 0x42
    record, place, size = record[long], place[long], size[long]
    letters = records.at(place + 0x40, "u1")
    whole = (letters > 0) & (size >= 0x42 + 2 * letters)
    record, place, letters = record[whole], place[whole], letters[whole]
    at, row = ragged(place + 0x42, letters, 2)
    # A name may hold NULs, so names are told apart by their lengths: decoded at once, cut where each one's letters end.
    unit = records.at(at, "<u2").astype(np.uint16)
    text = pa.array(names_of(unit, row, letters), pa.string())
    found = [records.at(place + 0x41, "u1").astype(np.int32), records.at(place, "<u8") & REFERENCE_MASK, records.at(place + 8, "<i8"), records.at(place + 16, "<i8"), (records.at(place + 0x38, "<u4") & 0x10) != 0]
    return record, pa.StructArray.from_arrays([text, *map(pa.array, found)], fields=list(_NAME))


def names_of(unit: np.ndarray, row: np.ndarray, letters: np.ndarray) -> list[str]:
    """UTF-16 letters, ``letters`` each, as texts."""
    # A private letter that no other place holds is put behind each name; NULs inside names stay.
    mark = next(c for c in range(0xE000, 0xF900) if not (unit == c).any())
    spread = np.full(len(unit) + len(letters), mark, np.uint16)
    spread[np.arange(len(unit)) + row] = unit
    return spread.astype("<u2").tobytes().decode("utf-16-le", "replace").split(chr(mark))[: len(letters)]


def decode_matrix(data: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Which records of one size are base records with a name, and their ``in_use``, times and names."""
    records = Records(data)
    if records.size < 64:
        return np.zeros(0, np.int64), [pa.array([], f.type) for f in _COLUMNS][3:]
    records.restore()
    used = records.number(0x18, "<i4")
    used = np.where((used <= 0) | (used > records.size), records.size, used)
    first = records.number(0x14, "<u2")
    base = records.number(0x20, "<u8") & REFERENCE_MASK
    records.ok &= (used >= 64) & (base == 0) & (first >= 0x18) & (first < used)
    record, kind, place, size = records.attributes(first, used)
    is_name = kind == FILE_NAME
    owner, names = _names(records, record[is_name], place[is_name], size[is_name])
    chosen = np.unique(owner)
    stated = (kind == STANDARD_INFORMATION) & (size >= 16)
    created, modified = np.zeros(records.n, np.int64), np.zeros(records.n, np.int64)
    known = np.zeros(records.n, bool)
    # Of several the last one counts, as assignment keeps it.
    known[record[stated]], created[record[stated]], modified[record[stated]] = True, records.at(place[stated], "<i8"), records.at(place[stated] + 8, "<i8")
    ends = np.searchsorted(owner, np.append(chosen, records.n)).astype(np.int32)
    times = [pa.array(x[chosen], mask=~known[chosen]) for x in (created, modified)]
    in_use = pa.array((records.number(0x16, "<u2")[chosen] & 1) == 1)
    return chosen, [in_use, *times, pa.ListArray.from_arrays(pa.array(ends), names)]


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        record = batch.column(3).cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(record), 0).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == size)
            same = record.take(pa.array(rows))
            data = np.frombuffer(same.buffers()[2], np.uint8)[: size * len(rows)].reshape(len(rows), size)
            chosen, columns = decode_matrix(data)
            kept = [batch.column(i).take(pa.array(rows[chosen])) for i in range(3)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, *columns], _COLUMNS, strict=True)], schema=_COLUMNS)


def is_time_stomped(created: Column, modified: Column, created_fn: Column, modified_fn: Column) -> Column:
    """Either pair of times differs by more than two seconds; unknown times never do."""

    def apart(a: Column, b: Column) -> Column:
        return F.coalesce(F.abs(F.unix_micros(a) - F.unix_micros(b)) > TIME_STOMP_MICROS, F.lit(False))

    return apart(created, created_fn) | apart(modified, modified_fn)


def name_score(namespace: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NAME_SCORES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, namespace), F.lit(0))


def preferred_name(names: Column) -> Column:
    """Best-scored name of an array; among equals the later one. Blank names never count."""
    cleaned = F.filter(
        F.transform(names, lambda n: n.withField("name", drop_controls(n["name"]))), lambda n: n["name"] != ""
    )
    ranked = F.transform(
        cleaned, lambda n, i: F.struct(name_score(n["namespace"]).alias("score"), i.alias("pos"), n.alias("n"))
    )
    best = F.array_max(F.transform(ranked, lambda r: F.struct(r["score"], r["pos"])))
    return F.get(cleaned, best["pos"])


def decode_records(records: DataFrame) -> DataFrame:
    """``host, source, record_index, record`` rows as file-table entries.

    Python splits bytes only, a batch of records at a time; names, times and
    flags are columns.
    """
    raw = records.select("host", "source", "record_index", "record").mapInArrow(_decode_batches, _RAW)
    return entries_from_attributes(raw)


def entries_from_attributes(raw: DataFrame) -> DataFrame:
    """Choose the name, fill missing times and mark suspicious ones."""
    best = raw.withColumn("_n", preferred_name(F.col("names"))).where(F.col("_n").isNotNull())
    si_created, si_modified = (filetime_not_sentinel(F.col(c)) for c in ("si_created", "si_modified"))
    fn_created, fn_modified = (filetime_not_sentinel(F.col(c)) for c in ("_n.created", "_n.modified"))
    return best.select(
        "host",
        "source",
        "record_index",
        F.col("_n.name").alias("file_name"),
        F.col("_n.name").alias("full_path"),
        F.col("_n.parent").alias("parent_record_index"),
        F.coalesce(si_created, fn_created).alias("created_utc"),
        F.coalesce(si_modified, fn_modified).alias("modified_utc"),
        fn_created.alias("created_utc_fn"),
        fn_modified.alias("modified_utc_fn"),
        is_time_stomped(si_created, si_modified, fn_created, fn_modified).alias("time_stomp_suspect"),
        F.col("in_use").alias("is_in_use"),
        F.col("_n.is_directory").alias("is_directory"),
    ).select(*MFT_SCHEMA.names)


def read_mft(spark: SparkSession, path: str, host: str, source: str, record_size: int = 1024) -> DataFrame:
    """Entries of one extracted table file, split at record boundaries by Hadoop.

    The splits keep file order, so the position of a record is its index.
    """
    records = spark.sparkContext.binaryRecords(path, record_size).zipWithIndex()
    frame = records.map(lambda r: (host, source, r[1], bytearray(r[0]))).toDF(
        "host string, source string, record_index bigint, record binary"
    )
    return decode_records(frame)
