"""BPE by a tokenization automaton: merges compiled into a deterministic automaton over tokens.

The automaton starts as one state with an arc to itself for every byte. Each
merge (a, b) then adds its gadget: the state that a leads to is copied without
its b arc, all a arcs are led to the copy, and wherever an a arc leaves, an ab
arc is added that leads where b led. After the last merge, the paths of the
automaton are exactly the tokenizations that BPE produces.

All arcs of one token lead to the same state, and a state differs from the one it
copies by one missing arc. So the states after token x are x's line of
copies, which continues the line of x's right part as it was when x was born, and
the tables need one entry per merge: ``removed[a, b]``, the number of
the merge that took arc b from a's line. An arc y is missing after x if a merge of a
right end u of x with a left end v of y came before u and v
had grown into x and y; :meth:`MergeAutomaton.arc` looks that up and remembers it.

A word is encoded by walking the vocabulary's trie and taking the longest arc that
exists; each prefix of a word has one path, so a dead end is entered once at most.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame

from kardia.llm.chunks import FIRST_UNSURE, Memo
from kardia.llm.common import documents, map_rows

TOKENIZER = "byte_bpe_50k.json"
PRE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# chunks of a generation, words and arcs that one worker remembers; bounds its memory
REMEMBERED_CHUNKS = 200_000
REMEMBERED_WORDS = 100_000
REMEMBERED_ARCS = 200_000
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable bytes stand for themselves, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        as_bytes = lambda t: bytes(letters[c] for c in t)
        self.special = special
        self.words: dict[str, list[int]] = {}
        self.label = {i: as_bytes(t) for t, i in vocab.items() if t not in special} | {i: t.encode() for t, i in special.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born = {vocab[c]: -1 for c in letters if c in vocab}
        self.removed: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        for number, (a, b) in enumerate(merges):
            self._gadget(number, vocab[a], vocab[b], vocab[a + b])
        self.arcs.clear()  # what was remembered while merges were still to come
        self.known = {self.label[t]: t for t in self.born}
        # trie of the tokens that some merge made: a node maps the next byte to a node, and -1 to its token
        self.trie: dict[int, dict | int] = {}
        for token in self.born:
            node = self.trie
            for byte in self.label[token]:
                node = node.setdefault(byte, {})
            node[-1] = token

    def _gadget(self, number: int, a: int, b: int, ab: int) -> None:
        """Copy the end of a without arc b, lead a there, and add arc ab beside each arc a."""
        if a not in self.born or b not in self.born or not self._present(a, b):
            return  # no path has a before b any more, so there is nothing to merge
        self.removed[a << 20 | b] = number
        if ab not in self.born:
            self.born[ab], self.left[ab], self.right[ab] = number, a, b

    def _present(self, x: int, y: int) -> bool:
        removed, born, left, right = self.removed, self.born, self.left, self.right
        u, u_until = x, NEVER
        while u is not None:
            v, v_until = y, NEVER
            while v is not None:
                # the merge that made x left the end of x as it was before its copy; the one that made y saw the copy
                when = removed.get(u << 20 | v, NEVER)
                if when < u_until and when <= v_until and when != NEVER:
                    return False
                v_until = born[v]
                v = left.get(v)
            u_until = born[u]
            u = right.get(u)
        return True

    def arc(self, x: int, y: int) -> bool:
        """Whether token y may follow token x."""
        key = x << 20 | y
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= REMEMBERED_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._present(x, y)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """The one path of the automaton that spells the word: longest arcs first, stepping back from dead ends.

        Whatever reaches a place by arcs is the one path to it, so a place from
        which the word can't be finished is never entered twice.
        """
        if (whole := self.known.get(word)) is not None:
            return [whole]
        n, arc, trie = len(word), self.arc, self.trie
        path: list[int] = []
        places, choices, dead = [0], [], set()
        at = 0
        while at < n:
            if len(choices) < len(places):  # first time here: tokens that the word goes on with, shortest first
                node, found, to = trie, [], at
                while to < n and (node := node.get(word[to])) is not None:
                    to += 1
                    if -1 in node:
                        found.append((node[-1], to))
                choices.append(found)
            found = choices[-1]
            while found:
                token, to = found.pop()
                if to not in dead and (not path or arc(path[-1], token)):
                    path.append(token)
                    places.append(to)
                    at = to
                    break
            else:
                dead.add(at)
                choices.pop()
                places.pop()
                path.pop()
                at = places[-1]
        return path

    def encode(self, text: str) -> list[int]:
        """Ids of a text: special strings as their ids, the rest pre-split into words."""
        out: list[int] = []
        for i, part in enumerate(self._cut(text)):
            if i % 2:
                out.append(self.special[part])
            else:
                for w in self.pre_split(part):
                    if (ids := self.words.get(w)) is None:
                        if len(self.words) >= REMEMBERED_WORDS:
                            self.words.clear()
                        ids = self.words[w] = self.encode_word(w.encode("utf-8", "replace"))
                    out += ids
        return out

    def pre_split(self, text: str) -> list[str]:
        """Words of a text. Beyond Cyrillic, letters differ between versions of Unicode; the library's own rule decides there."""
        if text.isascii() or max(text) < FIRST_UNSURE:
            return PRE_SPLIT.findall(text)
        from tokenizers.pre_tokenizers import ByteLevel
        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    def _cut(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return [text]
        return regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)

    def decode(self, ids: list[int]) -> str:
        """The arc labels of a path in a row, as UTF-8 (what isn't, replaced)."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


def load(name: str = TOKENIZER) -> MergeAutomaton:
    """Compile the automaton of a byte-level BPE file of the public tokenizers."""
    import public_tokenizers
    with open(public_tokenizers.path(name)) as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return MergeAutomaton(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})


class Codec:
    """An automaton with memos of chunks and of words; one per worker process and tokenizer."""

    def __init__(self, name: str):
        self.automaton = load(name)
        self.decimal = {i: str(i) for i in self.automaton.label}
        self.chunks = Memo(lambda new: [array("I", self.automaton.encode(c)).tobytes() for c in new], REMEMBERED_CHUNKS)

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        return self.chunks.ids(texts)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.arrays(texts)]

    def decimals(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec(name: str = TOKENIZER) -> Codec:
    if name not in _codecs:
        _codecs[name] = Codec(name)
    return _codecs[name]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER) -> DataFrame:
    """``(doc_id, ids)`` of each row; a null or empty text has no ids. Repeated rows give repeated results."""
    def run(cols):
        return {"doc_id": cols["doc_id"], "ids": [a.astype(np.int32) for a in codec(name).arrays(cols["text"])]}

    return map_rows(documents(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = TOKENIZER) -> DataFrame:
    """``(doc_id, text)`` of rows of ids; no ids (or null) give the empty text."""
    def run(cols):
        return {"doc_id": cols[id_col], "text": [codec(name).automaton.decode(ids or []) for ids in cols[ids_col]]}

    return map_rows(rows.select(id_col, ids_col), run, "doc_id long, text string")


def roundtrip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Encode each text, decode its ids, and return ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, with the ids on request."""
    def run(cols):
        c = codec(name)
        out = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for array_ in c.arrays(cols["text"]):
            ids = array_.tolist()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(c.decimals(ids).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.automaton.decode(ids).encode()).hexdigest())
            if with_ids:
                out["ids"].append(array_.astype(np.int32))
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(documents(docs, id_col, text_col), run, schema)
