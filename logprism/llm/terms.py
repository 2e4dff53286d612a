"""Terms of texts: runs of ASCII letters and digits and of signs beyond ASCII, with A-Z in lower case."""

from __future__ import annotations

from collections.abc import Iterator

PART = 1 << 20  # bytes cut into terms at a time
KEPT = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
LOWER = bytes(i + 32 if 65 <= i <= 90 else KEPT[i] for i in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """All terms of a whole text in order, in lists that stay small however long it is; none of null."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PART)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end
