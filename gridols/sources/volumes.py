"""Images as a Spark data source, ``gridols_images``: read by slabs, written by slabs, committed by the driver.

Reading. Rows are (obs, vol, plane, cell, y): the image's place in the list, the volume, the place on the third axis, the cell of
the volume's grid (last axis fastest) and the value. A plain image larger than ``slab_bytes`` is read by several tasks, each of
which reads the bytes of some planes of one volume; smaller images share tasks; a zipped image is one task, which unzips it
plane by plane. Conditions on obs, vol, plane and cell choose the slabs: as options (``planes`` = "3:7", ends included) or,
with ``spark.sql.python.filterPushdown.enabled`` and ``pushdown`` = "true", as filters of the query. A run of cells within one line along the third axis
is a run of planes; other conditions on cells are checked on the values.

Writing. ``stage`` = "slabs" takes (map, vol, slab, place, value) sorted by the first three and writes each slab, zeros where
there is no value, to a file of its own; ``stage`` = "files" takes the slabs of each map in order and joins them behind a
header. Tasks write files that nobody else knows, in a staging folder; what counts is what the driver commits, so a task that
is killed or runs twice leaves nothing behind. The driver then moves the images to their names and removes the staging
folder; a failed job removes it too.

Missing files are refused when the list is made up, before any task runs. Files are reached through Arrow's file systems.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from gridols.sources.folders import file_system, read_text
from gridols.sources.nifti import Head, candidates, decode_header, header, start_of

NAME = "gridols_images"
SCHEMA = "obs long, vol int, plane int, cell long, y double"
ROWS = pa.schema([("obs", pa.int64()), ("vol", pa.int32()), ("plane", pa.int32()), ("cell", pa.int64()), ("y", pa.float64())])
SLAB_BYTES, OPEN_COST, BATCH = 32 << 20, 1 << 16, 1 << 16
FAR = 1 << 62
#: Columns whose conditions choose what is read, and the options that say the same.
BOUNDED = {"obs": "images", "vol": "volumes", "plane": "planes", "cell": "cells"}


def locate(addresses: list[str]) -> list[tuple[int, str, str, int]]:
    """(place in the list, file of the values, file of the header, size) of each image; folders are listed once."""
    from pyarrow.fs import FileSelector, FileType

    sizes: dict[str, dict[str, int]] = {}
    out = []
    for obs, address in enumerate(addresses):
        folder = address.rpartition("/")[0]
        if folder not in sizes:
            fs, path = file_system(f"{folder}/")
            found = fs.get_file_info(FileSelector(path.rstrip("/") or "/", allow_not_found=True))
            sizes[folder] = {f.base_name: f.size for f in found if f.type == FileType.File}
        here = sizes[folder]
        pair = next((p for p in candidates(address) if all(f.rpartition("/")[2] in here for f in p)), None)
        if pair is None:
            raise ValueError(f"the image {address} does not exist")
        out.append((obs, *pair, here[pair[0].rpartition("/")[2]]))
    return out


def opened(address: str):
    fs, path = file_system(address)
    return fs.open_input_file(path)


def first_bytes(address: str) -> bytes:
    """The start of a file, unzipped, enough of it for a header."""
    with opened(address) as f:
        return start_of(f.read(1 << 13))


@dataclass
class Slab:
    """Some planes of some volumes of an image; None is all of them."""

    obs: int
    values: str
    head: str
    volumes: tuple[int, int] | None = None
    planes: tuple[int, int] | None = None


@dataclass
class Slabs(InputPartition):
    slabs: list[Slab] = field(default_factory=list)


def bytes_of(values: str, head: Head, wanted) -> Iterator[tuple[int, int, int, bytes]]:
    """(volume, first plane, planes, bytes) of the wanted (volume, first plane, planes), in the file's order."""
    with opened(values) as f:
        yield from bytes_in(f, values, head, wanted)


def bytes_in(f, values: str, head: Head, wanted) -> Iterator[tuple[int, int, int, bytes]]:
    """The same of an open file."""
    nx, ny, nz = head.grid
    plane = nx * ny * head.kind.itemsize
    f.seek(0)
    zipped = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    source, at = (gzip.GzipFile(fileobj=f), 0) if zipped else (f, 0)
    for vol, z, n in wanted:
        start = head.start + (vol * nz + z) * plane
        if zipped:
            while at < start:  # a zipped file is unzipped up to what is wanted, some bytes at a time
                at += len(source.read(min(1 << 20, start - at)))
        else:
            source.seek(start)
        data = source.read(n * plane)
        at += n * plane
        if len(data) < n * plane:
            raise ValueError(f"{values} ends before its last voxel")
        yield vol, z, n, data


def batches_of(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Pieces (obs, vol, planes, cells, values) together in batches of at most ``BATCH`` rows."""
    if not held:
        return
    size = [len(h[4]) for h in held]
    columns = [np.repeat(np.array([h[k] for h in held], kind), size) for k, kind in ((0, np.int64), (1, np.int32))]
    columns += [np.concatenate([h[k] for h in held]) for k in (2, 3, 4)]
    for at in range(0, sum(size), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + BATCH]) for c in columns], schema=ROWS)


class ImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.listed = options.get("listed")  # a file that holds the list: tasks are sent the reader, but need no other's images
        self.files = [] if self.listed else json.loads(options["files"]) if "files" in options else locate(json.loads(options["paths"]) if "paths" in options else [options["path"]])
        self.slab_bytes = int(options.get("slab_bytes", SLAB_BYTES))
        self.tasks = int(options.get("tasks", 8))
        self.bounds = {c: (0, FAR) for c in BOUNDED}
        for column, option in BOUNDED.items():
            if option in options:
                low, _, high = str(options[option]).partition(":")
                self.narrow(column, int(low or 0), int(high) if high else FAR if ":" in str(options[option]) else int(low))

    def narrow(self, column: str, low: int, high: int) -> None:
        a, b = self.bounds[column]
        self.bounds[column] = max(a, low), min(b, high)

    def planes_of(self, head: Head) -> tuple[int, int]:
        """The planes that can hold wanted cells, ends included."""
        nz = head.grid[2]
        low, high = self.bounds["plane"]
        first, last = self.bounds["cell"]
        if first // nz == last // nz:
            low, high = max(low, first % nz), min(high, last % nz)
        return low, min(high, nz - 1)

    def pieces(self, head: Head, slab: Slab) -> Iterator[tuple[int, int, int]]:
        nx, ny, _ = head.grid
        size = max(1, self.slab_bytes // max(1, nx * ny * head.kind.itemsize))
        v0, v1 = slab.volumes or (max(0, self.bounds["vol"][0]), min(self.bounds["vol"][1], head.volumes - 1))
        z0, z1 = slab.planes or self.planes_of(head)
        for vol in range(v0, v1 + 1):
            for z in range(z0, z1 + 1, size):
                yield vol, z, min(size, z1 + 1 - z)

    def shares(self, head: Head, slab: Slab) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
        """(volumes, planes), ends included, of the tasks that read a large image: several volumes where they are small, some planes of one where it is large."""
        nx, ny, nz = head.grid
        several = self.slab_bytes // max(1, nx * ny * nz * head.kind.itemsize)
        if several < 2:
            yield from (((vol, vol), (z, z + n - 1)) for vol, z, n in self.pieces(head, slab))
            return
        wanted = sorted({vol for vol, _, _ in self.pieces(head, slab)})
        for at in range(0, len(wanted), several):
            yield (wanted[at], wanted[min(at + several, len(wanted)) - 1]), self.planes_of(head)

    def partitions(self):
        low, high = self.bounds["obs"]
        small, parts = [], []
        for obs, values, head_file, size in json.loads(read_text(self.listed)) if self.listed else self.files:
            if not low <= obs <= high:
                continue
            slab = Slab(obs, values, head_file)
            if size <= self.slab_bytes or values.endswith(".gz"):
                small.append((size + OPEN_COST, slab))
                continue
            head = decode_header(first_bytes(head_file))
            parts += [Slabs([Slab(obs, values, head_file, *of)]) for of in self.shares(head, slab)]
        share = min(self.slab_bytes, max(OPEN_COST, sum(s for s, _ in small) // max(1, self.tasks)))
        held, size = Slabs(), 0
        for more, slab in small:
            if held.slabs and size + more > share:
                parts.append(held)
                held, size = Slabs(), 0
            held.slabs.append(slab)
            size += more
        if held.slabs:
            parts.append(held)
        return parts or [Slabs()]

    def read(self, partition: Slabs):
        held, size = [], 0  # small images share batches
        for slab in partition.slabs:
            with opened(slab.values) as f:
                head = decode_header(f.read(1 << 13) if slab.head == slab.values else first_bytes(slab.head))
                for vol, z, n, data in bytes_in(f, slab.values, head, self.pieces(head, slab)):
                    nx, ny, nz = head.grid
                    y = head.scaled(np.frombuffer(data, head.kind)).reshape((nx, ny, n), order="F").ravel()
                    plane = np.tile(np.arange(z, z + n, dtype=np.int32), nx * ny)
                    cell = (np.arange(nx * ny, dtype=np.int64)[:, None] * nz + np.arange(z, z + n)).ravel()
                    first, last = self.bounds["cell"]
                    if (first, last) != (0, FAR):
                        keep = (cell >= first) & (cell <= last)
                        y, plane, cell = y[keep], plane[keep], cell[keep]
                    held.append((slab.obs, vol, plane, cell, y))
                    size += len(y)
                    if size >= BATCH:
                        yield from batches_of(held)
                        held, size = [], 0
        yield from batches_of(held)


class FilteredReader(ImageReader):
    """Takes conditions of the query too; Spark asks for it only if its setting for that is on."""

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            value = 0 if isinstance(f, In) else getattr(f, "value", None)
            whole = column in BOUNDED and isinstance(value, int) and not isinstance(value, bool)
            if whole and isinstance(f, EqualTo):
                self.narrow(column, value, value)
            elif whole and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.narrow(column, value + isinstance(f, GreaterThan), FAR)
            elif whole and isinstance(f, LessThan | LessThanOrEqual):
                self.narrow(column, 0, value - isinstance(f, LessThan))
            else:
                if whole and isinstance(f, In) and f.value and all(isinstance(v, int) for v in f.value):
                    self.narrow(column, min(f.value), max(f.value))  # the values between are for Spark to drop
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple]


class Staged(DataSourceArrowWriter):
    """What both writers share: a staging folder, and its removal."""

    def __init__(self, options: dict):
        self.folder, self.staging = options["folder"], options["staging"]

    def abort(self, messages) -> None:
        remove(self.staging)


def remove(folder: str) -> None:
    from pyarrow.fs import FileType

    fs, path = file_system(folder)
    if fs.get_file_info(path).type == FileType.Directory:
        fs.delete_dir(path)


class SlabWriter(Staged):
    def __init__(self, options: dict):
        super().__init__(options)
        self.sizes = json.loads(options["sizes"])

    def write(self, iterator):
        fs, path = file_system(self.staging)
        fs.create_dir(path)
        files, key, held = [], None, np.zeros(0)

        def send():
            name = f"{uuid.uuid4().hex}.slab"
            with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(held.astype("<f8").tobytes())
            files.append((*key, name))

        for b in iterator:
            names, vols, slabs = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            places, values = b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (vols[1:] != vols[:-1]) | (slabs[1:] != slabs[:-1]))) if len(vols) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(vols)]):
                now = str(names[lo]), int(vols[lo]), int(slabs[lo])
                if now != key:
                    if key:
                        send()
                    key, held = now, np.zeros(self.sizes[now[2]])
                held[places[lo:hi]] = values[lo:hi]
        if key:
            send()
        return Written(files)

    def commit(self, messages) -> None:
        fs, path = file_system(self.staging)
        fs.create_dir(path)
        with fs.open_output_stream(f"{path}/slabs.json", compression=None) as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())


class FileWriter(Staged):
    """Rows (map, volumes, position, size, slab): the slabs of a map in order, null where a slab has no value."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.shape, self.affine = tuple(json.loads(options["shape"])), np.array(json.loads(options["affine"])).reshape(4, 4)

    def write(self, iterator):
        fs, path = file_system(self.staging)
        files, name, out = [], None, None
        for b in iterator:
            for now, volumes, _, size, slab in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != name:
                    if out:
                        out.close()
                    name, own = now, f"{uuid.uuid4().hex}.nii"
                    files.append((name, own))
                    out = fs.open_output_stream(f"{path}/{own}", compression=None)
                    out.write(header((*self.shape, volumes) if volumes > 1 else self.shape, self.affine))
                if slab is None:
                    for at in range(0, size, 1 << 20):
                        out.write(bytes(min(1 << 20, size - at)))
                else:
                    with fs.open_input_stream(f"{path}/{slab}", compression=None) as f:
                        while part := f.read(1 << 20):
                            out.write(part)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, path = file_system(self.folder)
        fs.create_dir(path)
        before = {f.path for f in fs.get_file_info(FileSelector(path)) if f.type == FileType.File and f.base_name.endswith(".nii")}
        staged = file_system(self.staging)[1]
        for name, own in (x for m in messages if m for x in m.files):
            if f"{path}/{name}.nii" in before:
                fs.delete_file(f"{path}/{name}.nii")
                before.discard(f"{path}/{name}.nii")
            fs.move(f"{staged}/{own}", f"{path}/{name}.nii")
        for stale in before:  # images of an earlier run
            fs.delete_file(stale)
        remove(self.staging)


class Images(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ImageReader:
        return (FilteredReader if self.options.get("pushdown") == "true" else ImageReader)(self.options)

    def writer(self, schema, overwrite: bool):
        return SlabWriter(self.options) if self.options["stage"] == "slabs" else FileWriter(self.options)

