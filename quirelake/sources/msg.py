"""Outlook messages: a reader of compound files, and the properties of a message."""

from __future__ import annotations

import struct

from quirelake.sources.mail import html_body_text
from quirelake.sources.record import Parsed, Refusal, canonical, scrub

_END = 0xFFFFFFFE
# Property tags of a message.
PROPERTIES = {"0037": "subject", "0C1A": "sender_name", "0C1F": "sender_email", "0E04": "to", "0E03": "cc", "0E02": "bcc", "1035": "message_id", "007D": "headers", "3FFA": "modified_by"}


class CompoundFile:
    """Streams by path of a compound file; sector chains are bounded by the file's size."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(data) < 512:
            raise Refusal("corrupt", "no compound file")
        self.data = data
        shift, mini = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini != 6:
            raise Refusal("corrupt", "sector size")
        self.size = 1 << shift
        first_dir, self.cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<I4xIIIII", data, 48)
        difat = list(struct.unpack_from("<109I", data, 76))
        sector = first_difat
        for _ in range(min(n_difat, len(data) // self.size + 1)):
            if sector >= _END:
                break
            block = self._sector(sector)
            words = struct.unpack(f"<{len(block) // 4}I", block)
            difat += words[:-1]
            sector = words[-1]
        fat = b"".join(self._sector(s) for s in difat if s < _END)
        self.fat = struct.unpack(f"<{len(fat) // 4}I", fat)
        raw = self._chain(first_mini)
        self.mini_fat = struct.unpack(f"<{len(raw) // 4}I", raw)
        directory = self._chain(first_dir)
        self.entries = []
        for at in range(0, len(directory) - 127, 128):
            n = struct.unpack_from("<H", directory, at + 64)[0]
            kind, left, right, child, start, size = struct.unpack_from("<Bx3I36xIQ", directory, at + 66)
            self.entries.append((directory[at : at + max(0, n - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, size & 0xFFFFFFFF))
        if not self.entries:
            raise Refusal("corrupt", "no directory")
        self.mini = self._chain(self.entries[0][5])

    def _sector(self, k: int) -> bytes:
        return self.data[(k + 1) * self.size : (k + 2) * self.size].ljust(self.size, b"\0")

    def _chain(self, k: int) -> bytes:
        out, left = [], len(self.data) // self.size + 1
        while k < _END and left > 0:
            out.append(self._sector(k))
            k = self.fat[k] if k < len(self.fat) else _END
            left -= 1
        return b"".join(out)

    def _read(self, start: int, size: int) -> bytes:
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, k, left = [], start, len(self.mini) // 64 + 1
        while k < _END and left > 0:
            out.append(self.mini[k * 64 : k * 64 + 64])
            k = self.mini_fat[k] if k < len(self.mini_fat) else _END
            left -= 1
        return b"".join(out)[:size]

    def streams(self) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        todo, seen = [(self.entries[0][4], "")], set()
        while todo:
            k, path = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            name, kind, left, right, child, start, size = self.entries[k]
            todo += [(left, path), (right, path)]
            if kind == 1:
                todo.append((child, f"{path}{name}/"))
            elif kind == 2:
                out[path + name] = self._read(start, size)
        return out


def read_msg(data: bytes, cap: int = 4096) -> Parsed:
    """Plain body before HTML; attachments are counted."""
    streams = CompoundFile(data).streams()

    def prop(tag: str) -> str | None:
        wide, narrow = streams.get(f"__substg1.0_{tag}001F"), streams.get(f"__substg1.0_{tag}001E")
        return wide.decode("utf-16-le", "replace") if wide is not None else narrow.decode("cp1252", "replace") if narrow is not None else None

    out = Parsed()
    body, html = prop("1000"), streams.get("__substg1.0_10130102")
    out.text = canonical(body if body and body.strip() else html_body_text(html.decode("utf-8", "replace")) if html else "")
    fields = {f"msg:{name}": prop(tag) for tag, name in PROPERTIES.items()}
    attached = {p.split("/", 1)[0] for p in streams if p.startswith("__attach_version1.0_")}
    fields["msg:attachment_count"] = str(len(attached)) if attached else None
    out.extra = scrub(fields, cap, out.warnings)
    out.title, out.author = out.extra.get("msg:subject"), out.extra.get("msg:sender_name")
    return out
