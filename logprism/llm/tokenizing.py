"""Tokenizing with a cache of word ids in each worker."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# No token of the two vocabularies goes from a sign to white space after it, and none of
# their rules look across that border. So a text's ids are those of such chunks in turn.
# The tokenizers' white space does not have the four separators 1C to 1F.
CHUNKS = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
# Two signs of that white space, one after the other: where a text has none, its chunks begin
# at its blanks and at and after its line feeds.
WIDE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
# Latin letters (but the dotted capital I) are one piece for the rules of both, composed as they
# are; a full stop or comma after them is the next. Such a piece can go to the model as it is.
LATIN = r"^ ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[.,]?$"
# Byte-level models write bytes as signs: the printable ones of Latin-1 as themselves, the
# rest in order from 256 on. The line feed is kept for what stands between words here.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: b for b in PRINTABLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in PRINTABLE)} | {10: 10}
CUTS = [chr(c) for c in (1, 2, 3, 4, 5, 6, 7, 8, *range(14, 28))]  # no white space
CACHED = 300_000  # chunks
CACHED_BYTES = 64  # of a chunk that is kept
LOT = 2 << 20  # bytes of text worked on at a time


class ChunkTokenizer:
    """Ids of texts, as ``Tokenizer.encode`` would give them.

    Texts are cut at blanks and the pieces looked up in a cache, so that a word is
    tokenized once while it stays in use. The cache is an array of chunks and one of
    their ids, and is searched for all chunks of a lot at once.
    """

    def __init__(self, path: str, byte_level: bool) -> None:
        """``byte_level``: white space and case count; else words in lower case do."""
        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = byte_level
        self.model = self.tokenizer.model
        self.stops = pa.array([b"", *(np.array(self._whole([x])[0], "<u4").tobytes() for x in ".,")], pa.large_binary())
        self.chunks, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.used = np.zeros(0, np.int64)  # the lot that last had the chunk
        self.lot = 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for i in range(0, len(texts), 1000) for x in self.tokenizer.encode_batch_fast(texts[i:i + 1000], add_special_tokens=False)]

    def _words(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of words that are a piece each."""
        tokenize = self.model.tokenize
        for signs in "\n".join(words).encode().decode("latin-1").translate(BYTE_SIGNS).split("\n") if words else []:
            yield [t.id for t in tokenize(signs)]

    def _tokenized(self, chunks: pa.Array) -> pa.Array:
        """Ids of chunks, tokenized here."""
        latin = pc.match_substring_regex(chunks, LATIN)
        words = chunks.filter(latin)
        stop = pc.add(pc.ends_with(words, ".").cast(pa.int8()), pc.multiply(pc.ends_with(words, ",").cast(pa.int8()), pa.scalar(2, pa.int8())))
        words = pc.utf8_rtrim(words, ".,")
        words = (words if self.byte_level else pc.utf8_lower(words)).dictionary_encode()
        known = _coded(self._words(words.dictionary.to_pylist())).take(words.indices)
        known = pc.binary_join_element_wise(known, self.stops.take(stop), pa.scalar(b"", pa.large_binary()))
        rest = pc.invert(latin)
        others = _coded(self._whole(chunks.filter(rest).to_pylist()))
        order = np.concatenate([np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (latin, rest)])
        return pa.concat_arrays([known, others]).take(pa.array(np.argsort(order)))

    def _known(self, chunks: pa.Array) -> pa.Array:
        """Ids of chunks, no two of them the same, from the cache; those not in it are added."""
        at = pc.index_in(chunks, value_set=self.chunks)
        missing = chunks.filter(at.is_null())
        if len(missing):
            places = at.to_numpy(zero_copy_only=False)
            places = np.where(np.isnan(places), 0, places).astype(np.int64)
            places[at.is_null().to_numpy(zero_copy_only=False)] = len(self.chunks) + np.arange(len(missing))
            self.chunks = pa.concat_arrays([self.chunks, missing])
            self.ids = pa.concat_arrays([self.ids, self._tokenized(missing)])
            self.used = np.concatenate([self.used, np.zeros(len(missing), np.int64)])
        else:
            places = at.to_numpy(zero_copy_only=False)
        self.lot += 1
        self.used[places] = self.lot
        found = self.ids.take(pa.array(places))
        if len(self.chunks) > CACHED:
            self._forget()
        return found

    def _forget(self) -> None:
        """Leaves half of the chunks the cache may hold, those used last."""
        short = np.flatnonzero(pc.less_equal(pc.binary_length(self.chunks), CACHED_BYTES).to_numpy(zero_copy_only=False))
        latest = np.sort(short[np.argsort(-self.used[short], kind="stable")[:CACHED // 2]])
        self.chunks, self.ids, self.used = self.chunks.take(pa.array(latest)), self.ids.take(pa.array(latest)), self.used[latest]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the bounds of the texts in them."""
        lists = self._cut(texts)
        firsts = lists.offsets.to_numpy().astype(np.int64)
        encoded = lists.flatten().dictionary_encode()
        del lists
        found = self._known(encoded.dictionary).take(encoded.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1] // 4
        return np.frombuffer(found.buffers()[2] or b"", "<u4"), ends[firsts - firsts[0]]

    def _cut(self, texts: pa.Array) -> pa.Array:
        """The chunks of each text."""
        if not self.byte_level:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        cut = next((c for c in CUTS if not pc.any(pc.match_substring(texts, c)).as_py()), None)
        odd = pc.match_substring_regex(texts, WIDE) if cut else pa.array(np.ones(len(texts), bool))
        marked = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), "\n", f"{cut}\n{cut}"), " ", f"{cut} ")
        lists = pc.split_pattern(marked, cut or " ")
        places = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if places.size:
            more = pa.array([CHUNKS.findall(t) for t in texts.filter(odd).to_pylist()], lists.type)
            order = np.arange(len(texts))
            order[places] = len(texts) + np.arange(places.size)
            lists = pa.concat_arrays([lists, more]).take(pa.array(order))
        return lists


def _coded(found: Iterable[list[int]]) -> pa.Array:
    """Lists of ids as bytes, four an id."""
    ids, sizes = array("I"), array("q", [0])
    for x in found:
        ids.extend(x)
        sizes.append(4 * len(x))
    bounds = np.cumsum(np.frombuffer(sizes, np.int64))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), bounds.size - 1, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])


@cache
def worker_tokenizer(name: str, byte_level: bool) -> ChunkTokenizer:
    """One per worker process. ``name`` is a file of the public tokenizers, or a path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
    return ChunkTokenizer(name if os.path.isabs(name) else public_tokenizers.path(name), byte_level)


def in_lots(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a batch that hold about ``LOT`` bytes, with their places; nulls are empty texts."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lots = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // LOT
    cuts = [0, *(np.flatnonzero(np.diff(lots)) + 1).tolist(), len(texts)]
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > start:
            yield start, texts.slice(start, end - start)
