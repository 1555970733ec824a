"""Macro modules of a workbook's vbaProject.bin: compound file, directory stream, decompression.

Written from the public format specifications of compound files and of VBA projects.
"""

from __future__ import annotations

import io
import struct
import zipfile

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


class CompoundFile:
    """Streams of a compound file by their path."""

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
            raise ValueError("not a compound file")
        self.data = data
        self.size, self.mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        n_fat, first_dir, _, cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<I", data, 44) + struct.unpack_from("<I", data, 48) + struct.unpack_from("<IIIIII", data, 52)
        self.cutoff = cutoff
        heads = list(struct.unpack_from("<109I", data, 76))
        at = first_difat
        for _ in range(n_difat):
            block = struct.unpack(f"<{self.size // 4}I", self._sector(at))
            heads += block[:-1]
            at = block[-1]
        self.fat: list[int] = []
        for h in heads[:n_fat] if n_fat <= len(heads) else heads:
            if h < END:
                self.fat += struct.unpack(f"<{self.size // 4}I", self._sector(h))
        directory = self._chain(first_dir)
        self.entries = [self._entry(directory[k : k + 128]) for k in range(0, len(directory), 128)]
        self.mini_fat = struct.unpack(f"<{len(m) // 4}I", m) if n_mini and (m := self._chain(first_mini)) else ()
        self.mini_data = self._chain(self.entries[0]["start"]) if self.entries[0]["size"] else b""
        self.streams: dict[str, bytes] = {}
        self._walk(self.entries[0]["child"], "")

    def _sector(self, k: int) -> bytes:
        return self.data[(k + 1) * self.size : (k + 2) * self.size]

    def _chain(self, k: int) -> bytes:
        out, seen = [], 0
        while k < END:
            out.append(self._sector(k))
            k = self.fat[k]
            seen += 1
            if seen > len(self.fat):
                raise ValueError("a chain of sectors has no end")
        return b"".join(out)

    def _entry(self, e: bytes) -> dict:
        n = struct.unpack_from("<H", e, 64)[0]
        left, right, child = struct.unpack_from("<III", e, 68)
        start, size = struct.unpack_from("<IQ", e, 116)
        return {"name": e[: max(0, n - 2)].decode("utf-16-le"), "kind": e[66], "left": left, "right": right, "child": child, "start": start, "size": size & 0xFFFFFFFF}

    def _walk(self, k: int, path: str) -> None:
        todo = [(k, path)]
        while todo:
            k, path = todo.pop()
            if k == FREE or k >= len(self.entries):
                continue
            e = self.entries[k]
            todo += [(e["left"], path), (e["right"], path)]
            if e["kind"] == 1:
                todo.append((e["child"], f"{path}{e['name']}/"))
            elif e["kind"] == 2:
                self.streams[path + e["name"]] = self._read(e)

    def _read(self, e: dict) -> bytes:
        if e["size"] >= self.cutoff:
            return self._chain(e["start"])[: e["size"]]
        out, k = [], e["start"]
        while k < END and len(out) * self.mini < e["size"]:
            out.append(self.mini_data[k * self.mini : (k + 1) * self.mini])
            k = self.mini_fat[k]
        return b"".join(out)[: e["size"]]


def decompress(data: bytes) -> bytes:
    """A compressed container: chunks of up to 4096 bytes, of literals and copies from the chunk's own output."""
    if not data or data[0] != 1:
        raise ValueError("not a compressed container")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        head = struct.unpack_from("<H", data, at)[0]
        end = min(len(data), at + (head & 0xFFF) + 3)
        at += 2
        if not head & 0x8000:
            out += data[at : at + 4096]
            at = end
            continue
        start = len(out)
        while at < end:
            flags = data[at]
            at += 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                token = struct.unpack_from("<H", data, at)[0]
                at += 2
                bits = max(4, (len(out) - start - 1).bit_length())
                back, n = (token >> (16 - bits)) + 1, (token & (0xFFFF >> bits)) + 3
                for _ in range(n):
                    out.append(out[-back])
    return bytes(out)


def compress_literals(data: bytes) -> bytes:
    """A valid container without copies, for fixtures."""
    out = bytearray([1])
    for k in range(0, len(data), 3600):
        part = data[k : k + 3600]
        body = b"".join(b"\0" + part[j : j + 8] for j in range(0, len(part), 8))
        out += struct.pack("<H", 0xB000 | (len(body) - 1)) + body
    return bytes(out)


def modules(directory: bytes) -> list[tuple[str, str, int, bool]]:
    """(name, stream, offset of the text, is a standard module) of the directory stream's records; and the code page first, as name."""
    out, at = [], 0
    name = stream = ""
    offset, standard, page = 0, True, 1252
    while at + 6 <= len(directory):
        kind, size = struct.unpack_from("<HI", directory, at)
        at += 6
        if kind == 0x0009:  # the version record's size leaves out its last two bytes
            size = 6
        body = directory[at : at + size]
        at += size
        if kind == 0x0003:
            page = struct.unpack("<H", body[:2])[0]
        elif kind == 0x0019:
            name = body.decode(f"cp{page}", "replace")
        elif kind == 0x001A:
            stream = body.decode(f"cp{page}", "replace")
        elif kind == 0x0031:
            offset = struct.unpack("<I", body)[0]
        elif kind in (0x0021, 0x0022):
            standard = kind == 0x0021
        elif kind == 0x002B:
            out.append((name, stream, offset, standard))
    return [(f"cp{page}", "", 0, True), *out]


def extract(workbook: bytes) -> list[tuple[str, str, str]]:
    """(module, kind, text) of a workbook's macros; none if it has no project."""
    with zipfile.ZipFile(io.BytesIO(workbook)) as z:
        if "xl/vbaProject.bin" not in z.namelist():
            return []
        streams = CompoundFile(z.read("xl/vbaProject.bin")).streams
    low = {k.lower(): v for k, v in streams.items()}
    (page, *_), *found = modules(decompress(low["vba/dir"]))
    out = []
    for name, stream, offset, standard in found:
        text = decompress(low[f"vba/{stream.lower()}"][offset:]).decode(page, "replace")
        out.append((name, "standard" if standard else "class", text))
    return out
