"""Orientation samples inside video containers, as a Spark data source, and writing them back.

``spark.read.format("clip_container").option("path", "*.mp4").option("parts", 4).load()`` gives one
row per metadata sample: path, sample, file_offset, sample_bytes, frame_ts, att_offset,
atts, an array of (offs, vals): the file offset and value of each of four float32 components, and
start_ts, the frame time of the file's first sample with both time and orientations (null before it).
Only the index of a file and its metadata samples are read, never picture or sound.

One task reads many small files, up to ``block`` bytes; a file of more is cut into ``parts``.

A file that can't be read as a container gives one row with ``error`` set, so that one bad file
doesn't fail a job over many.
"""

from __future__ import annotations

import glob
import os
import shutil
import struct
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gyrolith.session import ship

SCHEMA = (
    "path string, sample bigint, file_offset bigint, sample_bytes int, frame_ts bigint, att_offset float, "
    "atts array<struct<offs: array<bigint>, vals: array<float>>>, start_ts bigint, error string"
)
BLOCK = 2 << 20  # bytes of files that one task reads
OPEN = 1 << 13  # bytes that opening a file counts as, at least
BATCH = 20_000  # orientations of one Arrow batch, and samples at most
GAP = 4096  # components nearer than this are patched in one read and one write
# fixed values: where the wire format keeps things (message field numbers)
FRAME, HEADER, STAMP, IMU, FUSION, ATTITUDE, OFFSET = 3, 1, 2, 3, 2, 3, 4
WHOLE, TAGS = struct.Struct("<BfBfBfBf"), tuple(k << 3 | 5 for k in range(1, 5))


class NotAContainer(ValueError):
    pass


def box_spans(data: memoryview, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, payload start, payload end) of the boxes in data[lo:hi]; stops at a senseless size."""
    while lo + 8 <= hi:
        size, name = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1 and lo + 16 <= hi:
            (size,) = struct.unpack_from(">Q", data, lo + 8)
            head = 16
        elif size == 0:
            size = hi - lo
        if size < head:
            return
        yield name, lo + head, min(lo + size, hi)
        lo += size


def descend(data: memoryview, lo: int, hi: int, *names: bytes) -> tuple[int, int] | None:
    """Payload of the box reached by following the first box of each name."""
    for want in names:
        span = next(((a, b) for name, a, b in box_spans(data, lo, hi) if name == want), None)
        if span is None:
            return None
        lo, hi = span
    return lo, hi


def read_index(f: BinaryIO) -> memoryview:
    """Payload of the movie box, found by hopping over the top-level boxes."""
    end, at = f.seek(0, os.SEEK_END), 0
    while at + 8 <= end:
        f.seek(at)
        head = f.read(16)
        size, name = struct.unpack_from(">I4s", head)
        skip = 8
        if size == 1 and len(head) == 16:
            (size,) = struct.unpack_from(">Q", head, 8)
            skip = 16
        elif size == 0:
            size = end - at
        if name == b"moov":
            f.seek(at + skip)
            return memoryview(f.read(size - skip))
        if size < skip:
            break
        at += size
    raise NotAContainer("no movie box")


def sample_table(index: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """File offset and size of every sample of the first metadata track."""
    for name, lo, hi in box_spans(index, 0, len(index)):
        if name != b"trak":
            continue
        media = descend(index, lo, hi, b"mdia")
        handler = media and descend(index, *media, b"hdlr")
        if not handler or bytes(index[handler[0] + 8 : handler[0] + 12]) != b"meta":
            continue
        table = descend(index, *media, b"minf", b"stbl")
        if not table:
            raise NotAContainer("metadata track without a sample table")
        boxes = {n: a for n, a, _ in reversed(list(box_spans(index, *table)))}
        if b"stsz" not in boxes or b"stsc" not in boxes or not {b"stco", b"co64"} & boxes.keys():
            raise NotAContainer("incomplete sample table")
        same, count = struct.unpack_from(">II", index, boxes[b"stsz"] + 4)
        sizes = np.full(count, same, np.int64) if same else np.frombuffer(index, ">u4", count, boxes[b"stsz"] + 12).astype(np.int64)
        wide = b"stco" not in boxes
        at = boxes[b"co64" if wide else b"stco"]
        (n,) = struct.unpack_from(">I", index, at + 4)
        chunks = np.frombuffer(index, ">u8" if wide else ">u4", n, at + 8).astype(np.int64)
        (n,) = struct.unpack_from(">I", index, boxes[b"stsc"] + 4)
        runs = np.frombuffer(index, ">u4", 3 * n, boxes[b"stsc"] + 8).astype(np.int64).reshape(n, 3)
        # samples per chunk: each run holds from its first chunk up to the next run's
        per_chunk = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0] - 1, len(chunks)]))
        chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)[:count]
        if len(chunk_of) != count:
            raise NotAContainer("sample table doesn't add up")
        before = np.cumsum(sizes) - sizes
        first = np.r_[True, chunk_of[1:] != chunk_of[:-1]] if count else np.zeros(0, bool)
        base = before[first][np.cumsum(first) - 1] if count else before
        return chunks[chunk_of] + before - base, sizes
    raise NotAContainer("no metadata track")


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def wire(data: bytes, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """(field, wire type, start, end) of a message's fields; other wire types than 0, 1, 2, 5 raise."""
    widths = {1: 8, 5: 4}
    while lo < hi:
        key, lo = varint(data, lo)
        kind = key & 7
        if kind == 0:
            _, end = varint(data, lo)
        elif kind == 2:
            size, lo = varint(data, lo)
            end = lo + size
        elif kind in widths:
            end = lo + widths[kind]
        else:
            raise NotAContainer(f"wire type {kind}")
        yield key >> 3, kind, lo, end
        lo = end


def message(data: bytes, span: tuple[int, int] | None, *path: int) -> tuple[int, int] | None:
    """Span of the submessage reached by following the first field of each number."""
    for number in path:
        if span is None:
            return None
        span = next(((a, b) for no, kind, a, b in wire(data, *span) if no == number and kind == 2), None)
    return span


def parse_sample(data: bytes, base: int) -> tuple[int | None, float, list[tuple[Sequence[int | None], Sequence[float]]]]:
    """Frame time, attitude offset and attitudes of one sample; an omitted component is 0.0 at no offset."""
    frame = message(data, (0, len(data)), FRAME)
    stamp: int | None = None
    header = message(data, frame, HEADER)
    if header:
        for no, kind, lo, _ in wire(data, *header):
            if no == STAMP and kind == 0:
                stamp = varint(data, lo)[0]
    fusion = message(data, frame, IMU, FUSION)
    shift, atts = 0.0, []
    for no, kind, lo, hi in wire(data, *fusion) if fusion else ():
        if no == OFFSET and kind == 5:
            (shift,) = struct.unpack_from("<f", data, lo)
        elif no == ATTITUDE and kind == 2:
            if hi - lo == WHOLE.size:  # as nearly all are: four components in order
                whole = WHOLE.unpack_from(data, lo)
                if whole[::2] == TAGS:
                    atts.append(([base + lo + 1, base + lo + 6, base + lo + 11, base + lo + 16], whole[1::2]))
                    continue
            parts = {n: a for n, k, a, _ in wire(data, lo, hi) if k == 5 and 1 <= n <= 4}
            atts.append(([base + parts[n] if n in parts else None for n in range(1, 5)], [struct.unpack_from("<f", data, parts[n])[0] if n in parts else 0.0 for n in range(1, 5)]))
    return stamp, shift, atts


class _Part(InputPartition):
    """Files, or parts of files, that one task reads: (path, part, parts)."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        super().__init__(None)
        self.spans = spans


def _size(path: str) -> int:
    try:
        return os.path.getsize(path)
    except OSError:  # the task that reads it tells
        return 0


class _Rows:
    """Samples on their way into Arrow batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.counts: list[int] = []  # of a sample's orientations
        self.offs: list[int | None] = []
        self.vals: list[float] = []

    def add(self, row: tuple, atts: Sequence[tuple[Sequence[int | None], Sequence[float]]]) -> None:
        self.rows.append(row)
        self.counts.append(len(atts))
        for o, v in atts:
            self.offs.extend(o)
            self.vals.extend(v)

    def full(self) -> bool:
        return len(self.rows) >= BATCH or len(self.offs) >= 4 * BATCH

    def batch(self):
        import pyarrow as pa

        path, sample, file_offset, sample_bytes, stamp, shift, start, error = zip(*self.rows)
        fours = pa.array(np.arange(0, len(self.offs) + 4, 4, dtype=np.int32))
        each = pa.StructArray.from_arrays([pa.ListArray.from_arrays(fours, pa.array(x, kind)) for x, kind in ((self.offs, pa.int64()), (self.vals, pa.float32()))], ["offs", "vals"])
        ends = np.cumsum([0, *self.counts]).astype(np.int32)
        mask = pa.array([e is not None for e in error])
        atts = pa.ListArray.from_arrays(pa.array(ends), each, mask=mask)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float32(), pa.int64(), pa.string())
        cols = [pa.array(x, kind) for x, kind in zip((path, sample, file_offset, sample_bytes, stamp, shift, start, error), kinds)]
        names = ["path", "sample", "file_offset", "sample_bytes", "frame_ts", "att_offset", "atts", "start_ts", "error"]
        return pa.record_batch([*cols[:6], atts, *cols[6:]], names=names)


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pattern, self.parts, self.block = options.get("path", ""), int(options.get("parts", 1)), int(options.get("block", BLOCK))

    def partitions(self) -> list[_Part]:
        tasks: list[_Part] = []
        room = 0
        for path in sorted(glob.glob(self.pattern)):
            size = _size(path)
            parts = self.parts if size > self.block else 1
            share = max(size // parts, OPEN)
            for k in range(parts):
                if not tasks or share > room:
                    tasks.append(_Part([]))
                    room = self.block
                tasks[-1].spans.append((path, k, parts))
                room -= share
        return tasks

    def read(self, partition: _Part) -> Iterator:
        made = _Rows()
        for span in partition.spans:
            for row, atts in _samples(*span):
                made.add(row, atts)
                if made.full():
                    yield made.batch()
                    made = _Rows()
        if made.rows:
            yield made.batch()


def _start(f: BinaryIO, offsets: np.ndarray, sizes: np.ndarray, upto: int) -> int | None:
    """Time of the first of the samples before ``upto`` that has one, and orientations; mostly the very first."""
    for k in range(upto):
        f.seek(int(offsets[k]))
        try:
            stamp, _, atts = parse_sample(f.read(int(sizes[k])), int(offsets[k]))
        except (NotAContainer, IndexError, struct.error, ValueError):  # the task that reads it tells
            continue
        if stamp is not None and atts:
            return stamp
    return None


def _samples(path: str, part: int, parts: int) -> Iterator[tuple[tuple, Sequence]]:
    """Rows of a part of a file without their orientations, and those."""
    try:
        with open(path, "rb") as f:
            offsets, sizes = sample_table(read_index(f))
            lo, hi = (len(offsets) * k // parts for k in (part, part + 1))
            start = _start(f, offsets, sizes, lo)
            for k in range(lo, hi):
                f.seek(int(offsets[k]))
                stamp, shift, atts = parse_sample(f.read(int(sizes[k])), int(offsets[k]))
                if start is None and atts:
                    start = stamp
                yield (path, k, int(offsets[k]), int(sizes[k]), stamp, shift, start, None), atts
    except (OSError, NotAContainer, IndexError, struct.error, ValueError) as e:
        if part == 0:
            yield (path, None, None, None, None, None, None, str(e)), ()


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clip_container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ContainerReader:
        return ContainerReader(self.options)


def read_containers(spark: SparkSession, pattern: str, parts: int = 1, block: int = BLOCK) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ContainerSource)
    return spark.read.format("clip_container").option("path", pattern).option("parts", str(parts)).option("block", str(block)).load()


def _box(name: bytes, payload: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(payload), name) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(payload)) if kind == 2 else b"") + payload


def pack_sample(stamp: int | None, shift: float, quats: list[list[float | None]]) -> bytes:
    """A metadata sample as ``parse_sample`` reads it; a component that is None is left out."""
    head = _field(ATTITUDE, 2, bytes(WHOLE.size))[: -WHOLE.size]
    atts = [head + WHOLE.pack(TAGS[0], q[0], TAGS[1], q[1], TAGS[2], q[2], TAGS[3], q[3]) if len(q) == 4 and None not in q else _field(ATTITUDE, 2, b"".join(_field(k + 1, 5, struct.pack("<f", v)) for k, v in enumerate(q) if v is not None)) for q in quats]
    head = _field(HEADER, 2, _field(STAMP, 0, _varint(stamp))) if stamp is not None else b""
    return _field(FRAME, 2, head + _field(IMU, 2, _field(FUSION, 2, b"".join(atts) + _field(OFFSET, 5, struct.pack("<f", shift)))))


def pack_container(samples: list[bytes]) -> bytes:
    """A container of one metadata track, its samples one a chunk."""
    full = bytes(4)
    first = _box(b"ftyp", b"isom" + bytes(4))
    sizes = [len(x) for x in samples]
    at = np.cumsum([len(first) + 8, *sizes])[:-1] if samples else np.zeros(0, np.int64)
    table = _box(b"stsz", full + struct.pack(">II", 0, len(sizes)) + np.array(sizes, ">u4").tobytes()) + _box(b"stsc", full + struct.pack(">IIII", 1, 1, 1, 1))
    table += _box(b"co64", full + struct.pack(">I", len(sizes)) + np.array(at, ">u8").tobytes())
    track = _box(b"trak", _box(b"mdia", _box(b"hdlr", full + full + b"meta") + _box(b"minf", _box(b"stbl", table))))
    return first + _box(b"mdat", b"".join(samples)) + _box(b"moov", track)


def write_containers(rows: DataFrame, folder: str) -> DataFrame:
    """Containers of the metadata samples in ``rows`` (name, sample, frame_ts, att_offset, quats array<array<double>>): (path, n_samples).

    One file a name in a folder every executor sees, written whole by one task.  Run it by reading the result once.
    """
    ship(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        name, parts, out = None, [], []

        def close():
            if name is not None:
                path = os.path.join(folder, f"{name}.mp4")
                with open(path, "wb") as f:
                    f.write(pack_container(parts))
                out.append((path, len(parts)))

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for r in batch.to_pylist():
                if r["name"] != name:
                    close()
                    name, parts = r["name"], []
                parts.append(pack_sample(r["frame_ts"], r["att_offset"], r["quats"]))
        close()
        yield pa.record_batch([pa.array([p for p, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["path", "n_samples"])

    ready = rows.select("name", "sample", "frame_ts", F.col("att_offset").cast("float").alias("att_offset"), "quats")
    return ready.repartition("name").sortWithinPartitions("name", "sample").mapInArrow(run, "path string, n_samples bigint")


def _overwrite(f: BinaryIO, off: np.ndarray, value: np.ndarray) -> None:
    """Put values (four bytes each) at ascending offsets of a file, all else between them as it is; where two overlap the later one stays."""
    lo, hi = int(off[0]), int(off[-1]) + 4
    f.seek(lo)
    span = np.frombuffer(f.read(hi - lo).ljust(hi - lo, b"\0"), np.uint8).copy()
    span[(off[:, None] - lo + np.arange(4)).ravel()] = value.ravel()
    f.seek(lo)
    f.write(span.tobytes())


def write_slots(plan: DataFrame) -> DataFrame:
    """Write float32 components at file offsets into copies of files: one task per file, in order.

    plan: path, out_path, off (bigint), value (float).  Gives (out_path, n_written, error); a file
    that fails is removed.  Run it by reading the result once.
    """
    ship(plan.sparkSession)

    def run(batches):
        import pyarrow as pa

        current: str | None = None
        out, n, error, f = "", 0, None, None

        def close():
            nonlocal f
            if f:
                f.close()
                f = None
            if error and out and os.path.exists(out):
                os.remove(out)
            return pa.record_batch([pa.array([out]), pa.array([n], pa.int64()), pa.array([error], pa.string())], names=["out_path", "n_written", "error"])

        for batch in batches:
            paths, targets = batch.column("path").dictionary_encode(), batch.column("out_path")
            code = paths.indices.to_numpy(zero_copy_only=False)
            off = batch.column("off").to_numpy(zero_copy_only=False).astype(float)
            value = np.frombuffer(batch.column("value").to_numpy(zero_copy_only=False).astype("<f4").tobytes(), np.uint8).reshape(-1, 4)
            new = np.flatnonzero(np.diff(code, prepend=-1)).tolist()
            for a, b in zip(new, [*new[1:], len(code)]):
                if (path := paths[a].as_py()) != current:
                    if current is not None:
                        yield close()
                    current, out, n, error = path, targets[a].as_py(), 0, None
                    try:
                        shutil.copyfile(current, out)
                        f = open(out, "r+b")  # noqa: SIM115
                    except OSError as e:
                        error = str(e)
                if error is None:
                    at = np.arange(a, b)[~np.isnan(off[a:b])]
                    for run_ in np.split(at, np.flatnonzero(np.diff(off[at]) > GAP) + 1) if len(at) else ():
                        _overwrite(f, off[run_].astype(np.int64), value[run_])
                    n += len(at)
        if current is not None:
            yield close()

    rows = plan.select("path", "out_path", F.col("off").cast("bigint").alias("off"), F.col("value").cast("float").alias("value"))
    return rows.repartition("path").sortWithinPartitions("path", "off").mapInArrow(run, "out_path string, n_written bigint, error string")
