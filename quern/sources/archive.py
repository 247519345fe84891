"""Safe expansion of ZIP archives, nested ones too."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from quern.errors import ArchiveRefused


@dataclass(frozen=True)
class Guards:
    ratio: float = 100
    total_bytes: int = 2 << 30
    entry_bytes: int = 512 << 20
    entries: int = 10_000
    depth: int = 3


@dataclass
class _Used:
    entries: int = 0
    total: int = 0


def safe_name(name: str) -> str:
    """A relative posix path, or a refusal."""
    if "\0" in name:
        raise ArchiveRefused("an entry name holds a null byte")
    if name.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", name):
        raise ArchiveRefused(f"an absolute entry name: {name!r}")
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    if ".." in parts:
        raise ArchiveRefused(f"an entry name that climbs: {name!r}")
    if not parts:
        raise ArchiveRefused("an empty entry name")
    return "/".join(parts)


def expand(data: bytes, name: str, guards: Guards = Guards(), depth: int = 1, used: _Used | None = None) -> Iterator[tuple[str, bytes]]:
    """(archive!member, bytes) of every file; the limits hold over all levels."""
    used = used or _Used()
    if depth > guards.depth:
        raise ArchiveRefused(f"nested more than {guards.depth} deep: {name}")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ArchiveRefused(f"not a ZIP archive: {name}") from e
    with archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            used.entries += 1
            if used.entries > guards.entries:
                raise ArchiveRefused(f"more than {guards.entries} entries")
            member = f"{name}!{safe_name(info.filename)}"
            if info.file_size > guards.entry_bytes:
                raise ArchiveRefused(f"{member} is too large")
            if info.file_size > guards.ratio * max(1, info.compress_size):
                raise ArchiveRefused(f"{member} is packed more than {guards.ratio:g} times")
            room = min(guards.entry_bytes, guards.total_bytes - used.total)
            try:
                with archive.open(info) as f:
                    body = f.read(min(room, info.file_size) + 1)
            except (RuntimeError, NotImplementedError, zipfile.BadZipFile) as e:
                raise ArchiveRefused(f"{member}: {e}") from e
            if len(body) > room:
                raise ArchiveRefused("the archive holds too many bytes")
            if len(body) != info.file_size:
                raise ArchiveRefused(f"{member} is not as long as its header says")
            used.total += len(body)
            if member.lower().endswith(".zip"):
                yield from expand(body, member, guards, depth + 1, used)
            else:
                yield member, body
