"""Texts as space-separated chunks that a byte-level BPE encodes one by one.

The pre-tokenizer attaches one space to the word after it. A space between two
characters that aren't white space is thus always a border: no token crosses it, and what
stands on either side is encoded alike wherever it occurs. So each distinct chunk is
encoded once per worker and then looked up.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# a space beside other white space (or at an end) is no border
_BESIDE = r"^ | $|[\s\v\x{1C}-\x{1F}\x{85}\p{Z}] | [\s\v\x{1C}-\x{1F}\x{85}\p{Z}]"
# letters of old scripts, and ASCII punctuation behind them
_WORD_MARKS = r"^(?P<word>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{3A3}-\x{3F5}\x{400}-\x{481}\x{48A}-\x{52F}]+)(?P<marks>[!-/:-@\[-`{-~]+)$"
_BORDER = re.compile(r"(?<=\S) (?=\S)")

# chunks of a generation of a worker's memo; it holds two generations at most, which bounds its memory
REMEMBERED = 400_000
MARKS = string.punctuation
FIRST_UNSURE = "\u0530"  # from here on, what is a letter differs between versions of Unicode


def _unmarked(chunk: str) -> str:
    """The letters of a chunk of letters and marks behind them, which the pre-tokenizer parts; '' for another chunk."""
    stem = chunk.rstrip(MARKS)
    word = stem[1:] if stem[:1] == "\n" else stem
    return stem if len(stem) < len(chunk) and word.isalpha() and (word.isascii() or max(word) < FIRST_UNSURE) else ""


def _parted(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Chunks as words and the marks behind them, which the pre-tokenizer parts; other chunks are whole, with '' behind."""
    parts = pc.extract_regex(chunks, _WORD_MARKS)
    words, marks = pc.struct_field(parts, "word"), pc.struct_field(parts, "marks")
    whole = pc.is_null(parts)
    return pc.if_else(whole, chunks, words), pc.if_else(whole, "", marks)


def _lines(chunk: str) -> list[str]:
    """A chunk cut before its line breaks, which the pre-tokenizer parts; whole if one stands beside other white space."""
    first, *rest = chunk.split("\n")
    if not first or first[-1].isspace() or any(not r or r[0].isspace() or r[-1].isspace() for r in rest):
        return [chunk]
    return [first, *("\n" + r for r in rest)]


class Memo:
    """Ids (little-endian unsigned 32-bit bytes, from ``encode``) by chunk.

    Full, a generation becomes the old one and the one before is forgotten;
    what is met again moves to the young one, so frequent chunks stay. Words with
    marks and chunks of several lines are put together from the ids of their parts;
    marks are kept with a space in front, which no chunk has.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = REMEMBERED):
        self.encode, self.limit, self.young, self.old = encode, limit, {}, {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, a batch at a time: its chunks are numbered by Arrow, looked up once each, and gathered by NumPy."""
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, _BESIDE).to_numpy(zero_copy_only=False) if texts else np.zeros(0, bool)
        even = np.flatnonzero(~odd)
        lists = pc.split_pattern(column.take(pa.array(even)), " ")
        chunks = lists.flatten().dictionary_encode()
        words, marks = map(pc.dictionary_encode, _parted(chunks.dictionary))
        bounds = lists.offsets.to_numpy()
        heads = [texts[i].partition(" ")[0] for i in even.tolist()]
        # each chunk is a word and its marks, if any; the first chunk of a text follows no space, so it is a case of its own
        tails = [m for m in marks.dictionary.to_pylist() if m]
        behind = dict(zip(tails, self.encode(tails)))
        found = self._following(words.dictionary.to_numpy(zero_copy_only=False).tolist()) + self.encode(heads) + [behind.get(m, b"") for m in marks.dictionary.to_pylist()] + [b""]
        codes = np.stack([words.indices.to_numpy(), marks.indices.to_numpy() + len(words.dictionary) + len(heads)], axis=1).astype(np.int64)[chunks.indices.to_numpy()]
        codes[bounds[:-1], 0] = len(words.dictionary) + np.arange(len(heads))
        codes[bounds[:-1], 1] = len(found) - 1
        codes = codes.ravel()
        flat = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        starts = np.cumsum(lengths) - lengths
        sizes = lengths[codes]
        ends = np.cumsum(sizes)
        gathered = flat[np.repeat(starts[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.append(0, ends)[2 * bounds]
        out: list = [None] * len(texts)
        for i, a, b in zip(even.tolist(), cuts.tolist(), cuts[1:].tolist()):
            out[i] = gathered[a:b]
        for i in np.flatnonzero(odd).tolist():
            first, *rest = _BORDER.split(texts[i])
            out[i] = np.frombuffer(self.encode([first])[0] + b"".join(self._following(rest)), "<u4")
        return out

    def _following(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that follow a space, in order."""
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        young = self.young
        found = list(map(young.get, chunks))
        missing = self._forgotten({c for c, ids in zip(chunks, found) if ids is None})
        lined = {c: lines for c in missing if "\n" in c and len(lines := _lines(c)) > 1}
        missing.difference_update(lined)
        parts = self._forgotten({x for lines in lined.values() for x in lines})
        marked = {c: (stem, " " + c[len(stem):]) for c in parts if (stem := _unmarked(c))}
        missing = (missing | parts).difference(marked)
        new = list(missing | self._forgotten({x for pair in marked.values() for x in pair}))
        young.update(zip(new, self.encode([c if c[:1] == "\n" else c[1:] if c[:1] == " " else " " + c for c in new])))
        young.update((c, young[stem] + young[marks]) for c, (stem, marks) in marked.items())
        young.update((c, b"".join(map(young.__getitem__, lines))) for c, lines in lined.items())
        return [young[c] if ids is None else ids for c, ids in zip(chunks, found)]

    def _forgotten(self, chunks: set[str]) -> set[str]:
        """Chunks of neither generation; those of the old one move to the young one."""
        missing = chunks.difference(self.young)
        if self.old:
            again = [c for c in missing if c in self.old]
            self.young.update((c, self.old[c]) for c in again)
            missing.difference_update(again)
        return missing
