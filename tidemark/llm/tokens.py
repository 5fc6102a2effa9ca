"""Exact, cached tokenisation inside tasks.

Both vocabularies split a text before merging, so a text cut at a point where their split must cut
too gives the same ids piece by piece. Pieces repeat a great deal; each distinct piece is encoded
once by the tokenizers library and its ids are kept as little-endian uint32 bytes. Texts where a
cut could fall inside a run of white space, or that hold a special token's string, a control or
format character or, where letters are lowered, U+0130 (the one that lowers to a letter and a mark),
go to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Two white-space characters, then a third or the end: a cut inside could change the split.
_RUN = re.compile(r"\s\s(?:\s|\Z)")
#: A stop or comma that may belong to the run of marks before or after it; elsewhere it stands by itself.
_JOINED = {"byte": re.compile(r"[.,](?<![^\W_].)"), "word": re.compile(r"[.,_](?:(?<=_)|(?<=[^\w\s].)|(?=[^\w\s]))", re.S)}
#: Control, format and rare space characters, of which the library's splits hold other views than re's classes.
_ODD = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0\xad\u0600-\u0605\u061c\u06dd\u070f\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff\ufff9-\ufffb\U000e0000-\U000e007f]")
_ENCODERS: dict[tuple[str, str], "PieceEncoder"] = {}


class PieceEncoder:
    """Encodes whole texts to uint32 ids. mode "byte": a leading space belongs to its word; "word": white space is dropped."""

    def __init__(self, path: str, mode: str, cache_pieces: int = 500_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.mode, self.cache_pieces = mode, cache_pieces
        self.cache: dict[str, bytes] = {"\1": b""}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Plain words go to the library together, a thousand to a text; it tells which ids belong to which word."""
        byte = self.mode == "byte"
        plain = [p for p in pieces if (p[:1] == " " and p[1:].isalpha() if byte else p.isalpha())]
        other = [p for p in pieces if not (p[:1] == " " and p[1:].isalpha() if byte else p.isalpha())]
        groups = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        joined = self.library.encode_batch(["".join(g) if byte else " ".join(g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, joined, strict=True):
            of_word = np.array(found.word_ids, dtype=np.int64)
            starts = np.flatnonzero(np.diff(of_word, prepend=-1))
            if len(starts) != len(group):
                other += group
                continue
            raw, at = array("I", found.ids).tobytes(), [*(4 * starts).tolist(), 4 * len(of_word)]
            self.cache.update(zip(group, [raw[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))
        encoded = self.library.encode_batch(other, add_special_tokens=False)
        self.cache.update(zip(other, [array("I", found.ids).tobytes() for found in encoded], strict=True))

    def _cut(self, text: str) -> str:
        """The text with a NUL at every place where its pieces part."""
        alone = not _JOINED[self.mode].search(text)
        if self.mode == "word":
            if "Σ" not in text and unicodedata.is_normalized("NFC", text):
                text = text.lower()  # the library lowers every character by itself
            if alone:
                text = text.replace(",", "\0,\0").replace(".", "\0.\0")
            return text.replace("\n", "\0").replace(" ", "\0")
        text = text.replace(" ", "\0 ").replace("\n", "\0\n")
        return text.replace(",", "\0,").replace(".", "\0.") if alone else text

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, each from the cache or the library."""
        if len(self.cache) > self.cache_pieces:  # frequent pieces come back from the older half
            self.older, self.cache = self.cache, {"\1": b""}
        found = list(map(self.cache.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        unknown = []
        for i in missing:
            p = pieces[i]
            if p in self.older:
                self.cache[p] = self.older[p]
            else:
                unknown.append(p)
        self._learn(unknown)
        for i in missing:
            found[i] = self.cache[pieces[i]]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes, equal to the library's own for the whole text.

        All texts are cut and their pieces made distinct in one column; ids are then gathered by piece.
        """
        out = [b""] * len(texts)
        cut: list[str] = []
        at: list[int] = []
        for i, text in enumerate(texts):
            if any(s in text for s in self.special) or _ODD.search(text) or (_RUN.search(text) if self.mode == "byte" else "\u0130" in text):
                out[i] = self.whole(text)
            else:
                cut.append(self._cut(text))
                at.append(i)
        if not at:
            return out
        column = pc.split_pattern(pa.array(["\0\1\0".join(cut)], pa.large_string()), "\0").values.dictionary_encode()
        pieces, which = column.dictionary.to_pylist(), column.indices.to_numpy()
        end = pieces.index("\1") if len(at) > 1 else -1
        ids = self._ids_of(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        starts, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        size = sizes[which]
        ends = np.cumsum(size)
        raw = pool[np.repeat((starts[which] - ends + size).astype(np.int32), size) + np.arange(ends[-1], dtype=np.int32)].tobytes()
        bounds = [0, *(4 * ends[which == end]).tolist(), len(raw)]
        for i, a, b in zip(at, bounds, bounds[1:], strict=False):
            out[i] = raw[a:b]
        return out


def encoder(path: str, mode: str) -> PieceEncoder:
    """One encoder for each worker process, kept between tasks."""
    if (path, mode) not in _ENCODERS:
        _ENCODERS[path, mode] = PieceEncoder(path, mode)
    return _ENCODERS[path, mode]


def default_path(name: str) -> str:
    """Place of a public vocabulary file; it is a parameter of every operator that tokenises."""
    import public_tokenizers

    return public_tokenizers.path(name)
