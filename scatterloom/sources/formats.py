"""The two trajectory formats: what their bytes mean.

Only slicing of records happens here, one frame at a time; everything after it is
done on columns.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

from scatterloom.sources.files import file_size, open_file

# Fixed values of the binary format: record markers and identification.
DCD_MARK = 84
DCD_NAME = b"CORD"
DCD_HEAD_BYTES = 92  # the header block with both of its markers
DCD_FRAMES_AT = 8
DCD_CELL_FLAG_AT = 48
DCD_EXTRA_FLAG_AT = 52

# Fixed values of the text format: record names and columns (1-based first, length).
ATOM = b"ATOM  "
CELL = b"CRYST1"
END = b"END"
ATOM_COLUMNS = {
    "pdb_name": (13, 4), "x": (31, 8), "y": (39, 8), "z": (47, 8), "beta": (61, 6), "segid": (73, 4),
}
CELL_COLUMNS = {
    "a": (7, 9), "b": (16, 9), "c": (25, 9), "alpha": (34, 7), "beta": (41, 7), "gamma": (48, 7),
}


class DcdLayout(NamedTuple):
    n_frames: int
    n_atoms: int
    first: int  # byte position of the first frame
    size: int  # bytes per frame
    cell: int  # offset of the cell values in a frame, -1 without
    x: int
    y: int
    z: int


def _int(f) -> int:
    return struct.unpack("<i", f.read(4))[0]


def is_dcd(path: str) -> bool:
    with open_file(path) as f:
        head = f.read(DCD_HEAD_BYTES)
    mark = struct.pack("<i", DCD_MARK)
    return len(head) == DCD_HEAD_BYTES and head[:4] == mark and head[4:8] == DCD_NAME and head[-4:] == mark


def is_pdb(path: str, block: int = 1 << 20) -> bool:
    """Whether any line is an atom's; read in blocks, so lines may have any length."""
    held = b"\n"
    with open_file(path) as f:
        while data := f.read(block):
            held += data
            if b"\n" + ATOM in held:
                return True
            held = held[-len(ATOM) :]
    return False


def dcd_layout(path: str) -> DcdLayout:
    if not is_dcd(path):
        raise ValueError(f"not a DCD file: {path}")
    with open_file(path) as f:
        head = f.read(DCD_HEAD_BYTES)
        n_frames, = struct.unpack_from("<i", head, DCD_FRAMES_AT)
        has_cell, = struct.unpack_from("<i", head, DCD_CELL_FLAG_AT)
        has_extra, = struct.unpack_from("<i", head, DCD_EXTRA_FLAG_AT)
        titles = _int(f)
        f.seek(titles + 4, 1)
        _int(f)
        n_atoms = _int(f)
        _int(f)
        first = f.tell()
        at, cell = 0, -1
        if has_cell:
            cell = 4
            at = _int(f) + 8
        block = 4 * n_atoms + 8
        x, y, z = (at + k * block + 4 for k in range(3))
        size = at + 3 * block
        if has_extra and file_size(path) > first:
            f.seek(first + size)
            size += _int(f) + 8
    return DcdLayout(n_frames, n_atoms, first, size, cell, x, y, z)


def checked_layout(path: str) -> DcdLayout:
    """The layout of a file that holds as many frames as its head names; raises for others."""
    d = dcd_layout(path)
    held, rest = divmod(file_size(path) - d.first, d.size)
    if rest or held != d.n_frames:
        raise ValueError(f"{path}: its head names {d.n_frames} frames, but {held} frames and {rest} bytes follow")
    return d


def dcd_block(f, frame_at: int, block: int, lo: int, hi: int) -> np.ndarray:
    f.seek(frame_at + block + 4 * lo)
    return np.frombuffer(f.read(4 * (hi - lo)), dtype="<f4")


def dcd_frames(f, first_at: int, n: int, layout: DcdLayout) -> list[np.ndarray]:
    """x, y and z of all atoms of ``n`` frames that lie one after another."""
    f.seek(first_at)
    data = np.frombuffer(f.read(n * layout.size), dtype=np.uint8).reshape(n, layout.size)
    parts = (np.ascontiguousarray(data[:, b : b + 4 * layout.n_atoms]) for b in (layout.x, layout.y, layout.z))
    return [p.view("<f4").ravel() for p in parts]


def _pdb_part(data: bytes) -> tuple[list[np.ndarray], int]:
    """x, y and z of the atom lines up to the first END line, and where that starts (-1 without); columns are cut out of all lines at once."""
    raw = np.frombuffer(data, dtype=np.uint8)
    breaks = np.flatnonzero(raw == ord("\n"))
    starts = np.concatenate(([0], breaks + 1))
    stops = np.concatenate((breaks, [len(raw)]))

    def columns(rows, lo, width):
        """Bytes lo.. of some lines, blanks beyond a line's end."""
        if not len(raw):
            return np.full((len(rows), width), ord(" "), dtype=np.uint8)
        at = starts[rows][:, None] + np.arange(lo, lo + width)
        return np.where(at < stops[rows][:, None], raw[np.minimum(at, len(raw) - 1)], ord(" ")).astype(np.uint8)

    begins = lambda word, rows: (columns(rows, 0, len(word)) == np.frombuffer(word, np.uint8)).all(axis=1)
    rows = np.arange(len(starts))
    ends = np.flatnonzero(begins(END, rows))
    rows = rows[: ends[0]] if len(ends) else rows
    rows = rows[begins(ATOM, rows)]
    cut = (np.ascontiguousarray(columns(rows, ATOM_COLUMNS[c][0] - 1, ATOM_COLUMNS[c][1])) for c in "xyz")
    xyz = [np.char.strip(c.view(f"S{c.shape[1]}").ravel()).astype(np.float64) for c in cut]
    return xyz, int(starts[ends[0]]) if len(ends) else -1


def pdb_xyz(data: bytes) -> list[np.ndarray]:
    """x, y and z of the atom lines of a frame's bytes, up to its END line."""
    return _pdb_part(data)[0]


def pdb_blocks(f, frame_at: int, guess: int = 1 << 16, most: int = 8 << 20):
    """Yield (bytes of the frame so far, [x, y, z]) for blocks of a frame's lines; ``guess`` is how long the frame may be, later blocks are longer."""
    f.seek(frame_at)
    held, done = b"", 0
    while True:
        data = f.read(guess)
        part = held + data
        cut = part.rfind(b"\n") + 1 if data else len(part)
        part, held = part[:cut], part[cut:]
        xyz, end = _pdb_part(part)
        done += len(part) if end < 0 else end
        yield done, xyz
        if end >= 0 or not data:
            return
        guess = min(2 * guess, most)


def dcd_cell(f, frame_at: int, layout: DcdLayout) -> tuple:
    """Nine numbers: three cell vectors (lower triangle of the six stored values)."""
    if layout.cell < 0:
        return (0.0,) * 9
    f.seek(frame_at + layout.cell)
    v = struct.unpack("<6d", f.read(48))
    return (v[0], 0.0, 0.0, v[1], v[2], 0.0, v[3], v[4], v[5])


def pdb_frame(f, frame_at: int, record: bytes):
    """Lines of one kind in the frame that starts at ``frame_at``."""
    f.seek(frame_at)
    for line in f:
        if line.startswith(END):
            return
        if line.startswith(record):
            yield line
