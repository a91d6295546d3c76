"""A writer of binary logs for tests: chunks with names and templates that later records point back to."""

from __future__ import annotations

import struct
import zlib

from tracelake.sources.evtx import CHUNK, CHUNK_MARK, EPOCH_NS, FILE_MARK, HEAD, RECORD_MARK, RECORDS


class ChunkWriter:
    def __init__(self):
        self.data, self.names, self.templates, self.numbers = bytearray(RECORDS), {}, {}, []

    def name(self, out: bytearray, base: int, text: str) -> None:
        """A pointer to a name, with the name behind it where the chunk does not have it yet."""
        if text in self.names:
            out += struct.pack("<I", self.names[text])
            return
        here = base + len(out) + 4
        self.names[text] = here
        out += struct.pack("<I", here) + struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    def element(self, out: bytearray, base: int, node: tuple, depends: bool = True) -> None:
        """(name, attributes, children); children: elements, texts, or numbers of values (below 0: optional)."""
        name, attributes, children = node
        out += bytes([0x41 if attributes else 0x01]) + (b"\xff\xff" if depends else b"") + struct.pack("<I", 0)
        self.name(out, base, name)
        if attributes:
            out += struct.pack("<I", 0)
            for i, (k, v) in enumerate(attributes):
                out += bytes([0x46 if i + 1 < len(attributes) else 0x06])
                self.name(out, base, k)
                self.part(out, base, v, depends)
        if not children:
            out += b"\x03"
            return
        out += b"\x02"
        for c in children:
            self.part(out, base, c, depends)
        out += b"\x04"

    def part(self, out: bytearray, base: int, c, depends: bool = True) -> None:
        if isinstance(c, tuple):
            self.element(out, base, c, depends)
        elif isinstance(c, str):
            out += b"\x05\x01" + struct.pack("<H", len(c)) + c.encode("utf-16-le")
        else:
            out += struct.pack("<BHB", 0x0D if c >= 0 else 0x0E, abs(c), 1)

    def record(self, number: int, ns: int, key: str, template: tuple, values: list[tuple[int, bytes]]) -> bool:
        """False if the chunk is full."""
        names, templates, base = dict(self.names), dict(self.templates), len(self.data)
        out = bytearray(RECORD_MARK + struct.pack("<IQQ", 0, number, (ns + EPOCH_NS) // 100) + b"\x0f\x01\x01\x00" + b"\x0c\x01" + struct.pack("<I", 7))
        if key in self.templates:
            out += struct.pack("<I", self.templates[key])
        else:
            self.templates[key] = base + len(out) + 4
            out += struct.pack("<I", self.templates[key])
            head = len(out)
            out += bytes(24) + b"\x0f\x01\x01\x00"
            self.element(out, base, template)
            out += b"\x00"
            struct.pack_into("<I", out, head + 20, len(out) - head - 24)
        out += struct.pack("<I", len(values)) + b"".join(struct.pack("<HBB", len(v), kind, 0) for kind, v in values) + b"".join(v for _, v in values) + b"\x00"
        out += bytes(-(len(out) + 4) % 8) + struct.pack("<I", len(out) + 4 + (-(len(out) + 4) % 8))
        struct.pack_into("<I", out, 4, len(out))
        if base + len(out) > CHUNK:
            self.names, self.templates = names, templates
            return False
        self.data += out
        self.numbers.append((number, base, len(out)))
        return True

    def bytes(self, free: int | None = None) -> bytes:
        """The chunk; free: where its free space begins, if what is behind was deleted."""
        free = free or len(self.data)
        out = bytearray(self.data) + bytes(CHUNK - len(self.data))
        first, last = (self.numbers[0][0], self.numbers[-1][0]) if self.numbers else (1, 0)
        struct.pack_into("<8sQQQQIIII", out, 0, CHUNK_MARK, first, last, first, last, 128, 0, free, zlib.crc32(out[RECORDS:free]))
        struct.pack_into("<I", out, 124, zlib.crc32(out[128:RECORDS], zlib.crc32(out[:120])))
        return bytes(out)


def text(s: str) -> tuple[int, bytes]:
    return 0x01, s.encode("utf-16-le")


def file_bytes(chunks: list[bytes]) -> bytes:
    head = bytearray(HEAD)
    struct.pack_into("<8sQQQIHHHH", head, 0, FILE_MARK, 0, max(0, len(chunks) - 1), 1, 128, 1, 3, HEAD, len(chunks))
    struct.pack_into("<I", head, 124, zlib.crc32(head[:120]))
    return bytes(head) + b"".join(chunks)
