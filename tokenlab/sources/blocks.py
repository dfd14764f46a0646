"""Lines in compressed blocks: files of zstd frames that can be cut at blocks without being unpacked.

Before each block stands a frame that readers of zstd skip; it tells the bytes of the block, and the bytes and the number
of its lines. A block holds whole lines, each with its end. Such files strung together are such a file again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa

SUFFIX = ".zst"
#: Bytes of lines that make a block; how hard it is compressed (harder takes several times as long for a sixth of the bytes).
BLOCK, LEVEL = 4 << 20, 1
#: Bytes that are read together in search of a block.
CHUNK = 4 << 20
#: Magic number of a skipped frame, the length of its rest, and a mark that is no UTF-8; then the three numbers.
_NUMBERS = struct.Struct("<QQQ")
_START = struct.pack("<II", 0x184D2A5B, 16 + _NUMBERS.size) + bytes.fromhex("fff8c1b70e95e1d4a6fe83c59b12edff")
HEAD = len(_START) + _NUMBERS.size


def packed(path: str) -> bool:
    return path.endswith(SUFFIX)


def pack(lines: Iterable[bytes], block: int = BLOCK) -> Iterator[tuple[bytes, int]]:
    """Blocks with their heads, and the number of lines in each; lines come without their ends."""
    codec, held, size = pa.Codec("zstd", compression_level=LEVEL), [], 0

    def one() -> tuple[bytes, int]:
        data = b"\n".join(held) + b"\n"
        body = codec.compress(data, asbytes=True)
        return _START + _NUMBERS.pack(len(body), len(data), len(held)) + body, len(held)

    for line in lines:
        held.append(line)
        size += len(line) + 1
        if size >= block:
            yield one()
            held, size = [], 0
    if held:
        yield one()


def _head(file: pa.NativeFile, path: str) -> tuple[int, int, int] | None:
    """Bytes of the block, bytes and number of its lines, where the file stands; None at its end."""
    data = file.read(HEAD)
    if not data:
        return None
    if len(data) < HEAD or not data.startswith(_START):
        raise ValueError(f"{path}: no block at byte {file.tell() - len(data)}")
    return _NUMBERS.unpack(data[len(_START) :])


def heads(file: pa.NativeFile, path: str, start: int, stop: int) -> Iterator[tuple[int, int, int, int]]:
    """Where each block begins that begins in the range, the end of the block, the bytes and the number of its lines."""
    at = start if start == 0 else _search(file, start, stop)
    while at is not None and at < stop:
        file.seek(at)
        found = _head(file, path)
        if found is None:
            return
        end = at + HEAD + found[0]
        yield at, end, *found[1:]
        at = end


def _search(file: pa.NativeFile, start: int, stop: int) -> int | None:
    """Where the first block begins in the range."""
    rest, at = b"", start
    file.seek(start)
    end = stop + len(_START) - 1
    while at < end and (data := file.read(min(CHUNK, end - at))):
        seen = rest + data
        if (found := seen.find(_START)) >= 0:
            return at - len(rest) + found
        rest, at = seen[-len(_START) + 1 :], at + len(data)
    return None


def unpack(file: pa.NativeFile, path: str) -> list[bytes] | None:
    """The lines, without their ends, of the block that the file stands at; None at its end."""
    found = _head(file, path)
    if found is None:
        return None
    body = file.read(found[0])
    if len(body) < found[0]:
        raise ValueError(f"{path}: its last block is cut short")
    lines = pa.Codec("zstd").decompress(body, decompressed_size=found[1], asbytes=True).split(b"\n")
    if lines.pop() or len(lines) != found[2]:
        raise ValueError(f"{path}: a block has other lines than its head tells")
    return lines
