"""Token ids of whole texts, as bytes of little-endian unsigned 32-bit numbers."""

from __future__ import annotations

import os
import re
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The byte-level pattern never joins a space to a non-space character before it, so a
# text may be cut before such a space and its parts encoded on their own. The class
# holds characters that are surely no white space; any other space is left uncut.
_SURE = re.compile(r"[!-~\w]")
_CUT = re.compile(r"(?<=[!-~\w])(?= )")

# Marks that may follow a word of letters.
_MARKS = ".,;:!?"

# Words of each of two generations of the cache; one word takes about 200 bytes.
CACHE_WORDS = 400_000
CACHE_CHARS = 8_000_000
_JOIN_CHARS = 4_000      # parts are encoded in runs of about so many characters


class Encoder:
    """Encodes with a byte-level BPE file of the ``tokenizers`` library, special tokens not
    added. Words that were met lately come from a bounded cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)     # whether a token begins with a space
        for token, i in vocab.items():
            self.opens[i] = token.startswith("Ġ")
        self.words: dict[str, bytes] = {}                        # ids of " " + word
        self.older: dict[str, bytes] = {}
        self.chars = 0
        self.marks: dict[str, bytes] = {}                        # ids of runs of marks
        self.sure: dict[str, bool] = {"": False}

    @property
    def id_bits(self) -> int:
        """Bits that hold every id of the vocabulary."""
        return max(1, (len(self.opens) - 1).bit_length())

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Put words into the cache. The pattern parts letters from the marks that follow them,
        so a word of letters is encoded once, whatever marks it is met with."""
        new = words - self.words.keys()
        kept = new & self.older.keys()
        self.words.update(zip(kept, map(self.older.__getitem__, kept)))
        bare, marked = set(), []
        for w in new - kept:
            head = w.rstrip(_MARKS)
            if len(head) == len(w) or not head.isalpha():
                bare.add(w)
            else:
                marked.append((w, head))
                if head not in self.words:
                    bare.add(head)
        self._encode_words(bare)
        for w, head in marked:
            tail = w[len(head):]
            if tail not in self.marks:
                self.marks[tail] = self._plain(tail)
            self.words[w] = self.words[head] + self.marks[tail]

    def _encode_words(self, words: set[str]) -> None:
        """Encode words joined by spaces: each begins at a token that begins with a space,
        as a word has no other one."""
        runs, size = [[]], 0
        for w in words:
            if size >= _JOIN_CHARS:
                runs.append([])
                size = 0
            runs[-1].append(w)
            size += len(w)
        if not runs[0]:
            return
        done = self.tokenizer.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False)
        for run, encoding in zip(runs, done):
            ids = np.array(encoding.ids, "<u4")
            cuts = (np.flatnonzero(self.opens[ids]) * 4).tolist()
            data = ids.tobytes()
            if len(cuts) != len(run):
                raise ValueError("the tokenizer joins words that are parted by a space")
            self.words.update(zip(run, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)]))))
            self.chars += sum(map(len, run))

    def _is_sure(self, end: str) -> bool:
        if end not in self.sure:
            self.sure[end] = bool(_SURE.match(end))
        return self.sure[end]

    def _cut(self, text: str) -> bytes:
        """Ids of a text with spaces after white space and the like: only the sure ones are cut,
        and what can't be parted at every space is encoded as it stands."""
        cut, rest = _CUT.split(text), []
        while cut and (not cut[-1].startswith(" ") or " " not in cut[-1][1:]) and len(cut) > 1:
            rest.append(cut.pop()[1:])
        self._learn(set(rest))
        return self._plain("".join(cut)) + b"".join(self.words[w] for w in reversed(rest))

    def encode(self, texts: pa.Array | list) -> list[bytes]:
        """Ids of each text; a null text is empty. Words are told apart and their ids put in
        line by Arrow, so Python only sees the distinct words of all texts given."""
        if len(self.words) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.older, self.words, self.chars = self.words, {}, 0   # words in use move on
            self.marks.clear()
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        n = len(column)
        if n == 0:
            return []
        parts = pc.split_pattern(column, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.dictionary_encode()
        place, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = bounds[:-1]                                         # the words without a space before them
        ends = pc.utf8_slice_codeunits(coded.dictionary, -1).dictionary_encode()
        unsure = ~np.array([self._is_sure(e) for e in ends.dictionary.to_pylist()], bool)[ends.indices.to_numpy()][place]
        unsure[bounds[1:] - 1] = False                               # nothing is cut after a text's last word
        odd = np.logical_or.reduceat(unsure, firsts)
        rest = np.repeat(~odd, np.diff(bounds))
        rest[firsts] = False
        wanted = np.zeros(len(words), bool)
        wanted[place[rest]] = True
        self._learn(set(compress(words, wanted.tolist())))
        ids = map(self.words.get, words)                             # null where none is wanted
        begin = np.flatnonzero(~odd)
        begun = [words[i] for i in place[firsts[begin]].tolist()]
        done = self.tokenizer.encode_batch_fast(begun, add_special_tokens=False)
        whole: list[bytes] = [b""] * n
        for i, e in zip(begin.tolist(), done):
            whole[i] = np.array(e.ids, "<u4").tobytes()
        for i in np.flatnonzero(odd).tolist():
            whole[i] = self._cut(column[i].as_py())
        place[~rest] = len(words) + n                                # nothing
        place[firsts] = len(words) + np.arange(n)
        line = pa.array([*ids, *whole, b""], pa.large_binary()).take(pa.array(place))
        at = np.frombuffer(line.buffers()[1], np.int64)[line.offset:line.offset + len(line) + 1][bounds].tolist()
        data = memoryview(line.buffers()[2] or b"")
        return [bytes(data[lo:hi]) for lo, hi in zip(at, at[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
