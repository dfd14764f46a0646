"""Directories of ZIP files, by range reads: end records, ZIP64 records, central entries, places of stored data."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

Read = Callable[[int, int], bytes]  # (offset, length) -> bytes

# Fixed signatures and limits of the format.
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
STORED, DEFLATED = 0, 8
MOST_COMMENT = 0xFFFF


@dataclass
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int  # where its local header starts

    def start(self, read: Read) -> int:
        """Where its data starts; the local header's variable parts differ from the central entry's."""
        head = read(self.header, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {self.name}")
        name, extra = struct.unpack("<HH", head[26:30])
        return self.header + 30 + name + extra


def _end(read: Read, size: int) -> tuple[int, int, int, int]:
    """Number of entries, size and offset of the central directory, and bytes that stand before the archive."""
    tail_at = max(0, size - MOST_COMMENT - 22)
    tail = read(tail_at, size - tail_at)
    at = len(tail)
    while (at := tail.rfind(END, 0, at)) >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] == len(tail):
            break
    if at < 0:
        raise ValueError("not a ZIP file: it has no end record")
    entries, length, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = tail_at + at
    if end >= 20 and (locator := read(end - 20, 20))[:4] == LOCATOR:
        where = struct.unpack("<Q", locator[8:16])[0]
        record = read(where, 56) if where + 56 <= size else b""
        if record[:4] != END64:  # with bytes before the archive, it stands right before the locator
            where = end - 20 - 56
            record = read(where, 56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 end record is missing")
        entries, length, offset = struct.unpack("<QQQ", record[32:56])
        end = where
    return entries, length, offset, end - length - offset


def members(read: Read, size: int, window: int = 1 << 20) -> Iterator[Member]:
    """All members by the central directory, which is read in windows."""
    entries, length, offset, before = _end(read, size)
    at, stop, buffer = offset + before, offset + before + length, b""
    for _ in range(entries):
        while True:
            if len(buffer) >= 46:
                name, extra, comment = struct.unpack("<HHH", buffer[28:34])
                whole = 46 + name + extra + comment
                if len(buffer) >= whole:
                    break
            if at >= stop:
                raise ValueError("the central directory ends early")
            more = read(at, min(window, stop - at))
            buffer, at = buffer + more, at + len(more)
        if buffer[:4] != ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", buffer[8:12])
        packed, full = struct.unpack("<II", buffer[20:28])
        header = struct.unpack("<I", buffer[42:46])[0]
        fields, k = buffer[46 + name : 46 + name + extra], 0
        while k + 4 <= len(fields):
            kind, n = struct.unpack("<HH", fields[k : k + 4])
            if kind == 1:  # ZIP64: those of the three that didn't fit, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", fields[k + 4 : k + 4 + n // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + n
        label = buffer[46 : 46 + name].decode("utf-8" if flags & 0x800 else "cp437")
        yield Member(label, method, packed, full, header + before)
        buffer = buffer[whole:]


def content(read: Read, member: Member) -> Read:
    """Range reads within a member. A stored one is read in place; a deflated one is unpacked once, in memory."""
    start = member.start(read)
    if member.method == STORED:
        return lambda at, n: read(start + at, max(0, min(n, member.size - at)))
    if member.method != DEFLATED:
        raise ValueError(f"{member.name}: method {member.method}")
    whole = zlib.decompress(read(start, member.packed), -15)
    return lambda at, n: whole[at : at + n]
