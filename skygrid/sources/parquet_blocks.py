"""Parquet files built from column blocks that are already encoded.

A REQUIRED FLOAT column in PLAIN encoding is exactly a run of little-endian
float32 values, so payload bytes can be appended to a value page as they are.
Only page headers and the footer (Thrift compact protocol, public Parquet
format) are written new.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MAGIC = b"PAR1"
#: Fixed values of the Parquet format: physical types, converted type, codecs, encodings.
INT32, INT64, FLOAT, DOUBLE = 1, 2, 4, 5
DATE = 6
PLAIN_CODEC, ZSTD = 0, 6
PLAIN, RLE, RLE_DICTIONARY = 0, 3, 8
DATA_PAGE, DICTIONARY_PAGE = 0, 2

#: Columns of a compacted file: name, physical type, converted type.
COLUMNS = (("object_id", INT64, None), ("day", INT32, DATE), ("lat", DOUBLE, None), ("lon", DOUBLE, None), ("value", FLOAT, None))
ROW_GROUP = 1 << 20
CREATED_BY = "skygrid block writer"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zigzag(n: int) -> bytes:
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


class Struct:
    """A Thrift compact struct: fields are added in rising order of their ids."""

    I32, I64, BINARY, LIST, STRUCT = 5, 6, 8, 9, 12

    def __init__(self) -> None:
        self.out, self.last = bytearray(), 0

    def _head(self, field: int, kind: int) -> None:
        self.out.append((field - self.last) << 4 | kind)
        self.last = field

    def i32(self, field: int, n: int) -> Struct:
        self._head(field, self.I32)
        self.out += _zigzag(n)
        return self

    def i64(self, field: int, n: int) -> Struct:
        self._head(field, self.I64)
        self.out += _zigzag(n)
        return self

    def text(self, field: int, s: str) -> Struct:
        return self.raw(field, s.encode())

    def raw(self, field: int, raw: bytes) -> Struct:
        self._head(field, self.BINARY)
        self.out += _varint(len(raw)) + raw
        return self

    def struct(self, field: int, s: Struct) -> Struct:
        self._head(field, self.STRUCT)
        self.out += s.done()
        return self

    def list(self, field: int, kind: int, items: list[bytes]) -> Struct:
        self._head(field, self.LIST)
        self.out += bytes([len(items) << 4 | kind]) if len(items) < 15 else bytes([0xF0 | kind]) + _varint(len(items))
        for x in items:
            self.out += x
        return self

    def done(self) -> bytes:
        return bytes(self.out) + b"\0"


def _page(values: int, raw: int, stored: int, encoding: int) -> bytes:
    data = Struct().i32(1, values).i32(2, encoding).i32(3, RLE).i32(4, RLE)
    return Struct().i32(1, DATA_PAGE).i32(2, raw).i32(3, stored).struct(5, data).done()


def _dictionary_page(values: int, raw: int, stored: int) -> bytes:
    return Struct().i32(1, DICTIONARY_PAGE).i32(2, raw).i32(3, stored).struct(7, Struct().i32(1, values).i32(2, PLAIN)).done()


def rle_runs(index: np.ndarray, n: np.ndarray, width: int) -> bytes:
    """Run-length encoding: index[i] comes n[i] times."""
    size = (width + 7) // 8
    return b"".join(_varint(k << 1) + x.to_bytes(size, "little") for x, k in zip(index.tolist(), n.tolist()))


def bit_packed(index: np.ndarray, width: int) -> bytes:
    """One bit-packed run of all indices, filled up to a multiple of eight."""
    groups = -(-index.size // 8)
    padded = np.zeros(groups * 8, np.uint32)
    padded[: index.size] = index
    bits = (padded[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return _varint(groups << 1 | 1) + np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


class BlockFile:
    """One Parquet file under construction; sink needs write().

    Keys are dictionary-encoded, object and day as runs, and have minimum and maximum in
    the footer; the values are the blocks' own bytes.
    """

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.groups: list[bytes] = []
        self.rows = self.blocks = self.days = 0
        self.held: list[tuple[int, int, np.ndarray, np.ndarray, bytes]] = []
        self.held_rows = 0
        self._write(MAGIC)

    def _write(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, object_id: int, day: int, lat: np.ndarray, lon: np.ndarray, encoded: bytes, new_day: bool = True) -> None:
        """encoded: the float32 values of the cells (lat, lon) on that day (days since 1970-01-01)."""
        if len(encoded) != 4 * lat.size or lat.size != lon.size:
            raise ValueError("block length does not match its cells")
        self.held.append((object_id, day, lat, lon, encoded))
        self.held_rows += lat.size
        self.blocks += 1
        self.days += new_day
        if self.held_rows >= ROW_GROUP:
            self._flush()

    def _keys(self, column: int, dtype: str, n: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Distinct values and the data page of a key column."""
        if column < 2:
            x = np.array([h[column] for h in self.held], dtype)
            values, index = np.unique(x, return_inverse=True)
        else:
            values, index = np.unique(np.concatenate([h[column] for h in self.held]).astype(dtype), return_inverse=True)
        width = max(int(values.size - 1).bit_length(), 1)
        return values, bytes([width]) + (rle_runs(index, n, width) if column < 2 else bit_packed(index, width))

    def _flush(self) -> None:
        if not self.held:
            return
        n = np.array([h[2].size for h in self.held])
        rows = self.held_rows
        chunks, total = [], 0
        for column, (name, kind, _) in enumerate(COLUMNS):
            begin = self.at
            meta = Struct().i32(1, kind)
            if column == 4:  # the value blocks, byte for byte
                size = stored = 4 * rows
                head = _page(rows, size, size, PLAIN)
                self._write(head)
                for h in self.held:
                    self._write(h[4])
                meta.list(2, Struct.I32, [_zigzag(PLAIN), _zigzag(RLE)]).list(3, Struct.BINARY, [_varint(len(name)) + name.encode()])
                meta.i32(4, PLAIN_CODEC).i64(5, rows).i64(6, size + len(head)).i64(7, stored + len(head)).i64(9, begin)
                used = size + len(head)
            else:
                values, page = self._keys(column, ("<i8", "<i4", "<f8", "<f8")[column], n)
                raws = values.tobytes(), page
                packed = [pa.compress(x, codec="zstd", asbytes=True) for x in raws]
                heads = _dictionary_page(values.size, len(raws[0]), len(packed[0])), _page(rows, len(raws[1]), len(packed[1]), RLE_DICTIONARY)
                for x in (heads[0], packed[0]):
                    self._write(x)
                data_at = self.at
                for x in (heads[1], packed[1]):
                    self._write(x)
                used = sum(map(len, raws)) + sum(map(len, heads))
                meta.list(2, Struct.I32, [_zigzag(PLAIN), _zigzag(RLE), _zigzag(RLE_DICTIONARY)]).list(3, Struct.BINARY, [_varint(len(name)) + name.encode()])
                meta.i32(4, ZSTD).i64(5, rows).i64(6, used).i64(7, self.at - begin).i64(9, data_at).i64(11, begin)
                if values.dtype.kind != "f" or not np.isnan(values).any():
                    meta.struct(12, Struct().i64(3, 0).raw(5, values[-1:].tobytes()).raw(6, values[:1].tobytes()))
            chunks.append(Struct().i64(2, begin).struct(3, meta).done())
            total += used
        self.groups.append(Struct().list(1, Struct.STRUCT, chunks).i64(2, total).i64(3, rows).done())
        self.rows += rows
        self.held, self.held_rows = [], 0

    def close(self) -> int:
        """Write the last row group and the footer; the file's size."""
        self._flush()
        root = Struct().text(4, "schema").i32(5, len(COLUMNS)).done()
        leaves = []
        for name, kind, converted in COLUMNS:
            s = Struct().i32(1, kind).i32(3, 0).text(4, name)
            leaves.append((s if converted is None else s.i32(6, converted)).done())
        orders = [Struct().struct(1, Struct()).done() for _ in COLUMNS]
        footer = Struct().i32(1, 1).list(2, Struct.STRUCT, [root, *leaves]).i64(3, self.rows).list(4, Struct.STRUCT, self.groups).text(6, CREATED_BY).list(7, Struct.STRUCT, orders).done()
        self._write(footer)
        self._write(len(footer).to_bytes(4, "little") + MAGIC)
        return self.at
