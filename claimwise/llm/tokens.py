"""Token ids of whole texts with a public tokenizer.

Any file of the tokenizer library may be given; the ids are the library's. Where the
file has the normaliser and pre-tokenizer of ``NORMALIZER`` and ``PRE_TOKENIZER``,
which never join characters across white space, a text's ids are those of its words
(runs without ASCII white space) one after another; with any other file whole texts go
to the library, some megabytes at a time. Truncation and padding that a file may ask for
are left out. For the word-wise files, each Python worker remembers the ids of the words it has met, by
64-bit hash in a bounded sorted table (when it is full, words met in one
slice of texts only are forgotten); documents are put together from it in
numpy, a slice of texts at a time."""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pandas as pd

from claimwise.llm import words as W

TABLE_WORDS = 700_000  # words kept per worker
END_ID = 2  # fixed value: the id that ends a document
LATIN_END, DOTTED_I = "\u0180", "\u0130"  # below LATIN_END lower case is one letter for one, but for DOTTED_I
#: Byte-level vocabularies write byte b as chr(b) if that can be seen, else as the next character from 256 on.
_SEEN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_CHAR = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_SEEN}))}
#: The settings under which words can be encoded one by one.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def by_words(settings: dict) -> bool:
    """Whether a tokenizer file's ids can be put together from those of words: known
    splitting, a byte-pair model without chance, and no added token that could join
    words or lie in a run of letters."""
    added = settings.get("added_tokens") or []
    apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].strip(".,").isalpha() or any(map(str.isspace, t["content"]))) for t in added)
    model = settings["model"]
    return apart and settings["normalizer"] == NORMALIZER and settings["pre_tokenizer"] == PRE_TOKENIZER and model.get("type", "BPE") == "BPE" and not model.get("dropout")


class WholeTokenizer:
    """``encode`` as that of :class:`WordTokenizer`, by the library on whole texts."""

    def __init__(self, tokenizer, end_id: int | None = END_ID):
        self.tokenizer, self.end = tokenizer, [] if end_id is None else [end_id]

    def encode(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = raw.tobytes()
        texts = [whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        ids = [e.ids + self.end for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n


class WordTokenizer:
    """``encode(offsets, raw)``: the ids of a slice's texts (u32, ``end_id``
    appended to each if given) and the ids per text; equal to the library's own
    ``encode(text, add_special_tokens=False)`` of each text.

    A word of ASCII letters, with or without one full stop or comma after it,
    is looked up in lower case without its tail: to the pre-tokenizer letters are
    one piece and the tail is another, so that many words share an entry."""

    def __init__(self, tokenizer, end_id: int | None = END_ID):
        self.tokenizer, self.end_id = tokenizer, end_id
        self.tail = np.full(256, -1, np.int64)
        for t in ".,":
            one = self.tokenizer.encode(t, add_special_tokens=False).ids
            if len(one) == 1:
                self.tail[ord(t)] = one[0]
        self._clear()

    def _clear(self) -> None:
        """``ids[start[k]:start[k] + length[k]]`` is the word with hash ``key[k]``,
        met in ``seen[k]`` slices."""
        self.key, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.start, self.length, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _forget(self, known: np.ndarray) -> None:
        """Keep words met in two slices or more and those at ``known``, unless
        these leave too little room."""
        keep = self.seen >= 2
        keep[known] = True
        if keep.sum() > TABLE_WORDS // 2:
            keep[:] = False
        n = self.length[keep].astype(np.int64)
        start = np.cumsum(n) - n
        self.ids = self.ids[np.repeat(self.start[keep] - start, n) + np.arange(int(n.sum()))]
        self.key, self.start, self.length, self.seen = self.key[keep], start, self.length[keep], self.seen[keep] - 1

    def _learn(self, key: np.ndarray, words: list[bytes], plain: list[bool]) -> None:
        tokenize, ids, other = self.tokenizer.model.tokenize, [], []
        for w, is_plain in zip(words, plain):
            s = w.decode()
            tail = self.tail[w[-1]] if not is_plain and len(s) > 1 else -1
            core = s[:-1] if tail >= 0 else s
            if is_plain:  # one piece: straight to the byte-pair model
                ids.append([t.id for t in tokenize(core.lower())])
            elif core.isalpha() and max(core) < LATIN_END and DOTTED_I not in core:
                ids.append([t.id for t in tokenize("".join([BYTE_CHAR[b] for b in core.lower().encode()]))])
                if tail >= 0:
                    ids[-1].append(int(tail))
            else:
                other.append(len(ids))
                ids.append(None)
        for k in range(0, len(other), 512):
            some = other[k : k + 512]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False)):
                ids[i] = e.ids
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))])
        key = np.concatenate([self.key, key])
        order = np.argsort(key, kind="stable")
        self.key, self.start, self.length = key[order], start[order], np.concatenate([self.length, n.astype(np.int32)])[order]
        self.seen = np.concatenate([self.seen, np.ones(len(n), np.int32)])[order]

    def _entries(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, id of the tail or -1) of each word."""
        strange = np.concatenate([[0], np.cumsum(~LETTER[raw], dtype=np.int64)])
        tail = self.tail[raw[end - 1]]
        stop = np.where((tail >= 0) & (end - start > 1), end - 1, end)
        plain = strange[stop] == strange[start]
        stop, tail = np.where(plain, stop, end), np.where(plain & (stop < end), tail, -1)
        h = W.hashes(raw, start, stop, fold_case=True)
        h[~plain] = W.mix(W.hashes(raw, start[~plain], end[~plain]))
        back, u = pd.factorize(h)
        at, known = self._find(u)
        if len(self.key) + int((~known).sum()) > TABLE_WORDS and len(self.key):
            self._forget(at[known])
            at, known = self._find(u)
        self.seen[at[known]] += 1
        fresh = ~known
        if fresh.any():
            first = np.empty(len(u), np.int64)
            first[back[::-1]] = np.arange(len(h) - 1, -1, -1)
            k = first[fresh]
            self._learn(u[fresh], [raw[a:b].tobytes() for a, b in zip(start[k].tolist(), stop[k].tolist())], plain[k].tolist())
            at, _ = self._find(u)
        return at[back], tail

    def _find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.key, u), max(0, len(self.key) - 1))
        return at, self.key[at] == u if len(self.key) else np.zeros(len(u), bool)

    def encode(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, first = W.spans(offsets, raw)
        entry, tail = self._entries(raw, start, end)
        own = self.length[entry].astype(np.int64)
        size = own + (tail >= 0)
        after = np.concatenate([[0], np.cumsum(size)])
        ends = int(self.end_id is not None) * np.arange(1, len(offsets))
        total = after[first[1:]] + ends  # ids up to each text's end
        place = after[:-1] + int(self.end_id is not None) * np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        out = np.empty(int(total[-1]) if len(total) else 0, np.uint32)
        if self.end_id is not None:
            out[total - 1] = self.end_id
        out[(place + own)[tail >= 0]] = tail[tail >= 0]
        within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(place, own) + within] = self.ids[np.repeat(self.start[entry], own) + within]
        return out, np.diff(total, prepend=0)


_known: dict[tuple, WordTokenizer | WholeTokenizer] = {}


def tokenizer(path: str, end_id: int | None = END_ID) -> WordTokenizer | WholeTokenizer:
    """One tokenizer per worker, kept between tasks."""
    if (path, end_id) not in _known:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        with open(path, encoding="utf-8") as f:
            kind = WordTokenizer if by_words(json.load(f)) else WholeTokenizer
        _known[path, end_id] = kind(library, end_id)
    return _known[path, end_id]
