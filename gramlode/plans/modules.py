"""Fields of executable files that rule conditions ask for: the headers and exported names of PE, the header of ELF.

A field of a file that is not of the format, or is cut off, has no value (None).
"""

from __future__ import annotations

import struct

# Machine numbers and file types of the two formats.
CONSTANTS = {
    "pe.MACHINE_UNKNOWN": 0, "pe.MACHINE_I386": 0x14C, "pe.MACHINE_ARM": 0x1C0, "pe.MACHINE_ARMNT": 0x1C4, "pe.MACHINE_IA64": 0x200, "pe.MACHINE_AMD64": 0x8664, "pe.MACHINE_ARM64": 0xAA64,
    "elf.ET_NONE": 0, "elf.ET_REL": 1, "elf.ET_EXEC": 2, "elf.ET_DYN": 3, "elf.ET_CORE": 4,
    "elf.EM_386": 3, "elf.EM_MIPS": 8, "elf.EM_ARM": 40, "elf.EM_X86_64": 62, "elf.EM_AARCH64": 183,
}


def _at(code: str, data: bytes, place: int | None):
    if place is None or place < 0 or place + struct.calcsize(code) > len(data):
        return None
    return struct.unpack_from(code, data, place)[0]


def _name(data: bytes, place: int | None) -> bytes | None:
    end = -1 if place is None or place < 0 else data.find(b"\0", place)
    return data[place:end] if end >= 0 else None


class PE:
    def __init__(self, data: bytes):
        self.data = data
        head = _at("<I", data, 0x3C) if data[:2] == b"MZ" else None
        self.head = head if head is not None and data[head : head + 4] == b"PE\0\0" and head + 24 <= len(data) else None

    def field(self, code: str, place: int):
        return None if self.head is None else _at(code, self.data, self.head + place)

    def sections(self) -> list[tuple[int, int, int, int]]:
        """(virtual size, virtual address, raw size, raw place) of each section that the file has whole."""
        size, count, out = self.field("<H", 20), self.field("<H", 6), []
        for k in range(count or 0):
            place = self.head + 24 + size + 40 * k + 8
            if place + 16 > len(self.data):
                break
            out.append(struct.unpack_from("<4I", self.data, place))
        return out

    def place(self, address: int | None) -> int | None:
        for virtual, start, raw, at in self.sections() if address is not None else ():
            if start <= address < start + max(virtual, raw):
                return at + address - start
        return None

    def exported(self) -> list[bytes]:
        wide = self.field("<H", 24) == 0x20B
        table = self.place(self.field("<I", 24 + (112 if wide else 96)))
        if table is None:
            return []
        count, names = _at("<I", self.data, table + 24), self.place(_at("<I", self.data, table + 32))
        out = []
        for k in range(count or 0):
            name = _name(self.data, self.place(_at("<I", self.data, names + 4 * k))) if names is not None else None
            if name is None:
                break
            out.append(name)
        return out


_PE_FIELDS = {"pe.machine": ("<H", 4), "pe.number_of_sections": ("<H", 6), "pe.timestamp": ("<I", 8), "pe.characteristics": ("<H", 22), "pe.entry_point_raw": ("<I", 40), "pe.subsystem": ("<H", 92)}


def known(name: str) -> bool:
    return name in CONSTANTS or name in _PE_FIELDS or name in ("pe.is_pe", "pe.number_of_exports", "elf.type", "elf.machine", "elf.entry_point_raw")


def value(name: str, data: bytes):
    """The value of a field or constant."""
    if name in CONSTANTS:
        return CONSTANTS[name]
    if name in _PE_FIELDS:
        return PE(data).field(*_PE_FIELDS[name])
    if name == "pe.is_pe":
        return PE(data).head is not None
    if name == "pe.number_of_exports":
        return len(PE(data).exported()) if PE(data).head is not None else None
    if data[:4] != b"\x7fELF" or len(data) < 6:
        return None
    order = ">" if data[5] == 2 else "<"
    if name == "elf.entry_point_raw":
        return _at(order + ("Q" if data[4] == 2 else "I"), data, 24)
    return _at(order + "H", data, 16 if name == "elf.type" else 18)


def exports(wanted: bytes, data: bytes) -> bool | None:
    """Whether a PE file exports a name; None for other files."""
    pe = PE(data)
    return None if pe.head is None else wanted in pe.exported()
