"""Count-min sketches made by partition, merged by cell range, and reduced to bitmaps of the cells counted at least `most` times.

Counters saturate at `most`, since users only ask whether something may be there that often, twice mostly. Estimates never fall below
true counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm._text import mix

SKETCH = "row int, segment int, cells binary"
_SCHEMA = pa.schema([("row", pa.int32()), ("segment", pa.int32()), ("cells", pa.binary())])
SEGMENT_BITS = 8
FLUSH = 1 << 21


def cell(hashes: np.ndarray, row: int, log2_cells: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return mix(hashes + np.uint64(0x632BE59BD9B4E019 * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - log2_cells)


def _bits(most: int) -> int:
    """Bits of a cell's count less one."""
    return (most - 1).bit_length()


class PartSketch:
    """Cells of one partition, kept sparse; `add` gets each thing to count once for each count."""

    def __init__(self, log2_cells: int, rows: int = 2, most: int = 2):
        self.bits, self.rows, self.held, self.n, self.most = log2_cells, rows, [], 0, most

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(hashes)
        self.n += len(hashes)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, self.held, self.n = np.concatenate(self.held), [], 0
        low = self.bits - SEGMENT_BITS
        for row in range(self.rows):
            cells, counts = np.unique(cell(h, row, self.bits), return_counts=True)
            coded = (cells << np.uint64(_bits(self.most))) | (np.minimum(counts, self.most) - 1).astype(np.uint64)
            ends = np.searchsorted(cells, np.arange(1, (1 << SEGMENT_BITS) + 1, dtype=np.uint64) << np.uint64(low))
            segs, parts, a = [], [], 0
            for s, b in enumerate(ends.tolist()):
                if b > a:
                    segs.append(s)
                    parts.append((coded[a:b] & np.uint64((1 << low + _bits(self.most)) - 1)).astype(np.uint32).tobytes())
                a = b
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(segs), pa.int32()), pa.array(segs, pa.int32()), pa.array(parts, pa.binary())], schema=_SCHEMA)


def sketched(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log2_cells: int, rows: int = 2, most: int = 2) -> DataFrame:
    """Partition sketches of what hashes_of gives for the batches of df."""

    def run(batches):
        s = PartSketch(log2_cells, rows, most)
        for b in batches:
            for h in hashes_of(b):
                yield from s.add(h)
        yield from s.flush()

    return df.mapInArrow(run, SKETCH)


def merged(sketches: DataFrame, log2_cells: int, rows: int = 2, most: int = 2) -> list[np.ndarray]:
    """For each row of the sketch, a bitmap (uint64 words) of the cells that count at least `most`. Its size is fixed by log2_cells."""
    low = log2_cells - SEGMENT_BITS

    def run(batches):
        counts: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for row, seg, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                c = np.frombuffer(cells, dtype=np.uint32)
                at, more = c >> _bits(most), (c & (1 << _bits(most)) - 1).astype(np.uint8) + 1
                have = counts.setdefault((row, seg), np.zeros(1 << low, np.uint8))
                have[at] = np.minimum(most, have[at] + more)  # the cells of one part are distinct
        for (row, seg), have in counts.items():
            bits = np.packbits(have >= most, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([seg], pa.int32()), pa.array([bits], pa.binary())], schema=_SCHEMA)

    n = min(rows << SEGMENT_BITS, max(8, sketches.sparkSession.sparkContext.defaultParallelism * 2))
    got = sketches.repartition(n, F.col("row"), F.col("segment")).mapInArrow(run, SKETCH).toArrow()
    out = [np.zeros(max(1, 1 << (log2_cells - 6)), np.uint64) for _ in range(rows)]
    for row, seg, bits in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True):
        w = np.frombuffer(bits, np.uint64)
        out[row][seg * len(w) : (seg + 1) * len(w)] = w
    return out


def repeated(maps: list[np.ndarray], log2_cells: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes are estimated to count often enough for `merged`."""
    ok = np.ones(len(hashes), bool)
    for row, bits in enumerate(maps):
        at = cell(hashes, row, log2_cells)
        ok &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return ok


def width(total: int) -> int:
    """log2 of cells for about `total` counted things: four cells for each, 2**20 to 2**29 cells (64 MB of bits a row at most)."""
    return int(min(29, max(20, np.ceil(np.log2(max(1, total) * 4)))))
