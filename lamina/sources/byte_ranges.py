"""Files by byte range, for sources that read parts of binary files."""

from __future__ import annotations

_BLOCK = 1 << 16


class Bytes:
    """A file of any filesystem that pyarrow knows, by byte range; small reads go through a few cached blocks."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file, self.blocks, self.large = system.open_input_file(at), {}, []

    @property
    def size(self) -> int:
        return self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if n > _BLOCK:
            self.large.append((at, n))
            return self.file.read_at(n, at)
        out = b""
        for k in range(at // _BLOCK, (at + n - 1) // _BLOCK + 1):
            if k not in self.blocks:
                if len(self.blocks) > 64:
                    self.blocks.clear()
                self.blocks[k] = self.file.read_at(_BLOCK, k * _BLOCK)
            out += self.blocks[k]
        skip = at % _BLOCK
        return out[skip : skip + n]
