"""The NIfTI-1 format: headers, affines, scaling, the files of an image; voxels are numbered with the last axis fastest."""

from __future__ import annotations

import gzip
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Fixed values of the published format: data type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER = 348
#: Endings of image files, in the order in which a name without one is tried.
ENDINGS = (".nii.gz", ".nii", ".img.gz", ".img", ".hdr.gz", ".hdr")


@dataclass(frozen=True)
class Head:
    shape: tuple[int, ...]
    affine: np.ndarray
    kind: np.dtype
    start: int
    slope: float
    inter: float

    @property
    def volumes(self) -> int:
        return int(np.prod(self.shape[3:], dtype=np.int64))

    @property
    def grid(self) -> tuple[int, int, int]:
        return (*self.shape[:3], *[1] * (3 - len(self.shape)))[:3]

    def scaled(self, values: np.ndarray) -> np.ndarray:
        """As doubles; a slope of 0, or one that is not finite, means that values are as they are."""
        values = values.astype(float)
        if not np.isfinite(self.slope) or self.slope == 0:
            return values
        inter = self.inter if np.isfinite(self.inter) else 0.0
        return values if (self.slope, inter) == (1.0, 0.0) else values * self.slope + inter


def start_of(data: bytes, size: int = HEADER) -> bytes:
    """The first bytes of a file, plain or gzipped."""
    return zlib.decompressobj(31).decompress(data, size) if data[:2] == b"\x1f\x8b" else data[:size]


def turned(b: float, c: float, d: float) -> np.ndarray:
    """The rotation of a unit quaternion whose first part is not stored and not negative."""
    rest = 1.0 - (b * b + c * c + d * d)
    if rest < 1e-7:  # a half turn: the stored parts alone, at length 1
        size = np.sqrt(b * b + c * c + d * d)
        a, b, c, d = 0.0, b / size, c / size, d / size
    else:
        a = np.sqrt(rest)
    return np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ])


def quaternion_of(affine: np.ndarray) -> tuple[float, tuple[float, float, float]] | None:
    """(sign of the third axis, stored parts of the quaternion) of an affine whose axes are at right angles, else None."""
    turn = affine[:3, :3] / np.linalg.norm(affine[:3, :3], axis=0)
    if not np.allclose(turn.T @ turn, np.eye(3), atol=1e-6):
        return None
    sign = 1.0 if np.linalg.det(turn) > 0 else -1.0
    turn = turn * [1, 1, sign]
    # q q' from the sums and differences of the matrix: its largest column is q up to a factor
    full = np.array([
        [1 + np.trace(turn), turn[2, 1] - turn[1, 2], turn[0, 2] - turn[2, 0], turn[1, 0] - turn[0, 1]],
        [turn[2, 1] - turn[1, 2], 1 + 2 * turn[0, 0] - np.trace(turn), turn[0, 1] + turn[1, 0], turn[0, 2] + turn[2, 0]],
        [turn[0, 2] - turn[2, 0], turn[0, 1] + turn[1, 0], 1 + 2 * turn[1, 1] - np.trace(turn), turn[1, 2] + turn[2, 1]],
        [turn[1, 0] - turn[0, 1], turn[0, 2] + turn[2, 0], turn[1, 2] + turn[2, 1], 1 + 2 * turn[2, 2] - np.trace(turn)],
    ])
    q = full[:, np.argmax(np.diag(full))]
    q = q / np.linalg.norm(q) * (-1.0 if q[0] < 0 else 1.0)
    return sign, tuple(q[1:])


def affine_of(head: bytes, order: str) -> np.ndarray:
    """The affine as the sform gives it, else the qform, else voxel sizes alone."""
    by_quaternion, by_rows = struct.unpack_from(f"{order}2h", head, 252)
    sizes = struct.unpack_from(f"{order}4f", head, 76)
    affine = np.eye(4)
    if by_rows > 0:
        affine[:3] = np.array(struct.unpack_from(f"{order}12f", head, 280)).reshape(3, 4)
    elif by_quaternion > 0:
        b, c, d, *offset = struct.unpack_from(f"{order}6f", head, 256)
        affine[:3, :3] = turned(b, c, d) * np.array([sizes[1], sizes[2], sizes[3] * (-1.0 if sizes[0] < 0 else 1.0)])
        affine[:3, 3] = offset
    else:
        affine[[0, 1, 2], [0, 1, 2]] = sizes[1:]
    return affine


def decode_header(data: bytes) -> Head:
    """What a header's bytes say, plain or gzipped."""
    return decoded(start_of(data)[:HEADER])


@lru_cache(64)
def decoded(head: bytes) -> Head:
    """Of a study's many images most have the same header."""
    order = "<" if len(head) >= HEADER and struct.unpack_from("<i", head, 0)[0] == HEADER else ">"
    if len(head) < HEADER or struct.unpack_from(f"{order}i", head, 0)[0] != HEADER:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(f"{order}8h", head, 40)
    kind = struct.unpack_from(f"{order}h", head, 70)[0]
    if kind not in TYPES:
        raise ValueError(f"data type {kind} is not supported")
    start, slope, inter = struct.unpack_from(f"{order}3f", head, 108)
    shape = dim[1 : 1 + dim[0]]
    while len(shape) > 3 and shape[-1] == 1:
        shape = shape[:-1]
    affine = affine_of(head, order)
    affine.setflags(write=False)
    return Head(shape, affine, np.dtype(order + TYPES[kind]), int(start), slope, inter)


def decode(data: bytes, head: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(volume as doubles, 4 by 4 affine) of a file's bytes, plain or gzipped; head is the header's file if it is one of its own."""
    told = decode_header(data if head is None else head)
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    values = np.frombuffer(data, told.kind, int(np.prod(told.shape)), told.start)
    return told.scaled(values).reshape(told.shape, order="F"), told.affine


def header(shape: tuple[int, ...], affine: np.ndarray | None = None, alone: bool = False, by_rows: bool = True) -> bytes:
    """The 352 bytes before the doubles of a single-file image, or the header file of a pair; without by_rows the affine is a quaternion alone."""
    affine = np.eye(4) if affine is None else np.asarray(affine, float)
    return encoded(tuple(map(int, shape)), affine.tobytes(), alone, by_rows)


@lru_cache(64)
def encoded(shape: tuple[int, ...], affine: bytes, alone: bool, by_rows: bool) -> bytes:
    affine = np.frombuffer(affine).reshape(4, 4)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, HEADER)
    struct.pack_into("<8h", head, 40, len(shape), *shape, *[1] * (7 - len(shape)))
    struct.pack_into("<2h", head, 70, 64, 64)
    turn = quaternion_of(affine)
    if turn is None and not by_rows:
        raise ValueError("the affine's axes are not at right angles")
    struct.pack_into("<8f", head, 76, turn[0] if turn else 1.0, *np.linalg.norm(affine[:3, :3], axis=0), 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", head, 108, 0.0 if alone else 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, int(turn is not None), int(by_rows))
    struct.pack_into("<6f", head, 256, *(turn[1] if turn else (0.0, 0.0, 0.0)), *affine[:3, 3])
    if by_rows:
        struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"ni1\0" if alone else b"n+1\0"
    return bytes(head)


def encode(volume: np.ndarray, affine: np.ndarray | None = None, by_rows: bool = True) -> bytes:
    """A single-file image of doubles."""
    return header(volume.shape, affine, by_rows=by_rows) + np.asarray(volume, "<f8").tobytes(order="F")


def encode_pair(volume: np.ndarray, affine: np.ndarray | None = None) -> tuple[bytes, bytes]:
    """An image of doubles as the contents of its .hdr and .img files."""
    return header(volume.shape, affine, alone=True), np.asarray(volume, "<f8").tobytes(order="F")


def candidates(path: str) -> list[tuple[str, str]]:
    """(file of the values, file of the header) that a name may stand for, the likeliest first; pairs may be zipped in part."""
    ending = next((e for e in ENDINGS if path.endswith(e)), None)
    if ending is None:
        return [pair for e in ENDINGS[:4] for pair in candidates(path + e)]
    if ending.startswith(".nii"):
        return [(path, path)]
    stem = path[: -len(ending)]
    zips = (".gz", "") if ending.endswith(".gz") else ("", ".gz")
    return [(f"{stem}.img{a}", f"{stem}.hdr{b}") for a in zips for b in (a, "" if a else ".gz")]
