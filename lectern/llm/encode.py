"""Exact token ids of whole texts by a public tokenizer file, over Arrow columns.

``.json`` files are read and run by the ``tokenizers`` library, ``.model`` files by ``sentencepiece``.
The library reads 1.3 million characters of a text a second. For a byte-level BPE file that changes
nothing before it splits, a text whose white space is single spaces and line feeds can be cut before
each of them: no pre-token reaches over such a place. Each distinct piece goes to the library once,
a worker remembers the ids of those it met of late, and they are gathered for every occurrence. Other texts go to the library
as they are. The ids are the same; tests compare them on both real and hostile texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at once: bounds what a task holds besides the Arrow batch it got.
BATCH_BYTES = 8 << 20

#: A text can be cut at these places: no pre-token of a byte-level file reaches over them.
_SAFE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)")
_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Distinct pieces in a worker's memory: two generations of so many, of at most LONGEST characters each, some 40 MB.
REMEMBERED = 120_000
#: Longer pieces are not remembered.
LONGEST = 64
#: Unknown pieces that go to the library at once.
FRESH = 20_000
#: Of these so many in one text.
JOINED = 100
#: Texts with a match go to the library whole (or cut where ``_SAFE`` allows): other white space, two in a row, or the character that marks a text's start here.
_ODD = r"[ \n][ \n]|[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"


def _plain(d: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE that changes nothing before it splits."""
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    return not d.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and all(x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"])) for x in d["added_tokens"])


class Memory:
    """From a piece to its ids as bytes, for pieces seen of late: a generation that is full is kept until the next one is."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, pieces: list[str], counts: np.ndarray, encode) -> list[bytes]:
        """The ids of each of the distinct ``pieces``, which occur ``counts`` times now; ``encode`` gives those of unknown ones."""
        got = list(map(self.new.get, pieces))
        lost = [i for i, x in enumerate(got) if x is None]
        if self.old:
            for i in lost:
                got[i] = self.old.get(pieces[i])
            fresh = [i for i in lost if got[i] is None]
        else:
            fresh = lost
        for first in range(0, len(fresh), FRESH):  # encodings are large and go before the next ones come
            part = fresh[first : first + FRESH]
            for i, x in zip(part, encode([pieces[i] for i in part]), strict=True):
                got[i] = x
        # What came once is rare; what an older generation knew is not.
        again = counts > 1
        again[lost] |= True if len(fresh) == 0 else np.isin(lost, fresh, assume_unique=True, invert=True)
        for i in np.array(lost, np.int64)[again[lost]].tolist():
            if len(pieces[i]) <= LONGEST:
                self.new[pieces[i]] = got[i]
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        return got


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + lengths[i] - 1, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class JsonEncoder:
    """Ids as the ``tokenizers`` library gives them, with no special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts = _plain(json.loads(self.tokenizer.to_str()))
        self.memory = Memory()
        between = self.library(["a\n b"])[0][1:-1] if self.cuts else []
        #: The token of a line feed between two words, if it is one token.
        self.feed = between[0] if len(between) == 1 else None

    def library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, text: str, limit: int = BATCH_BYTES // 4) -> list[str]:
        """``text`` in parts of about ``limit`` characters that encode on their own; whole where it has no safe place."""
        out, start = [], 0
        while self.cuts and len(text) - start > limit and (m := _SAFE.search(text, start + limit)):
            out.append(text[start : m.start()])
            start = m.start()
        return [*out, text[start:]]

    def _of(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces: each stands for itself and the space before it; one that starts with \\x01 or a line feed has none.

        Many go to the library in one text, with a line feed before the space of each, which is a token of its own.
        """
        out: list = [None] * len(pieces)
        alone = [i for i, w in enumerate(pieces) if self.feed is None or w[:1] in ("", "\x01", "\n")]
        got = self.library([w[1:] if w[:1] == "\x01" else w if w[:1] == "\n" else " " + w for w in (pieces[i] for i in alone)])
        for i, ids in zip(alone, got, strict=True):
            out[i] = array("I", ids).tobytes()
        rest = [i for i, x in enumerate(out) if x is None]
        groups = [rest[k : k + JOINED] for k in range(0, len(rest), JOINED)]
        for group, ids in zip(groups, self.library([" " + "\n ".join([pieces[i] for i in group]) for group in groups]), strict=True):
            flat = array("I", ids).tobytes()
            cut = (4 * np.flatnonzero(np.frombuffer(flat, np.uint32) == self.feed)).tolist()
            for i, start, stop in zip(group, [0, *(k + 4 for k in cut)], [*cut, len(flat)], strict=True):
                out[i] = flat[start:stop]
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts that can be cut at each space: (pieces of each text, number of each piece, ids of each number, all their ids)."""
        cut = pc.split_pattern(pc.binary_join_element_wise("\x01", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        coded = cut.flatten().dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)
        ids = self.memory.ids(coded.dictionary.to_pylist(), np.bincount(number, minlength=len(coded.dictionary)), self._of)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64), number, lengths, np.frombuffer(b"".join(ids), np.uint32)

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts that have to go to the library as they are, and of the others."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        return np.flatnonzero(odd), np.flatnonzero(~odd)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        odd, plain = self._split(texts)
        for i in odd.tolist():
            out[i] = np.array([t for part in self.cut(texts[i].as_py()) for ids in self.library([part]) for t in ids], np.uint32)
        if len(plain):
            counts, number, lengths, ids = self._plain(texts.take(pa.array(plain)))
            n = lengths[number]
            flat = ids[_ranges((np.cumsum(lengths) - lengths)[number], n)]
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
            for i, part in zip(plain.tolist(), np.split(flat, ends[:-1]), strict=True):
                out[i] = part
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text, which are not put together for this."""
        out = np.zeros(len(texts), np.int64)
        odd, plain = self._split(texts)
        for i in odd.tolist():
            out[i] = sum(len(ids) for part in self.cut(texts[i].as_py()) for ids in self.library([part]))
        if len(plain):
            counts, number, lengths, _ = self._plain(texts.take(pa.array(plain)))
            out[plain] = np.add.reduceat(lengths[number], np.cumsum(counts) - counts)
        return out


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message; values are numbers or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at, out, shift = at + 1, out | (byte & 127) << shift, shift + 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            at += size
            yield tag >> 3, data[at - size : at]


class ModelEncoder:
    """Ids by the ``sentencepiece`` library.

    Long texts are cut at single spaces where a model merges pairs (so that what it does at one place
    does not depend on others), puts a space before a text, and has no piece with a space inside.
    """

    #: The fields of a model that hold its training's settings, and in these its kind; the kind that merges pairs.
    SETTINGS, KIND, MERGES = 2, 3, 2

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = next((v for n, s in _fields(self.model.serialized_model_proto()) if n == self.SETTINGS for m, v in _fields(s) if m == self.KIND), 1)
        inside = any("\u2581" in p.lstrip("\u2581") for p in map(self.model.id_to_piece, range(self.model.get_piece_size())))
        self.cuts = kind == self.MERGES and not inside and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")

    def cut(self, text: str, limit: int = BATCH_BYTES // 4) -> list[str]:
        """``text`` in parts of about ``limit`` characters that encode on their own; whole where it has no safe place."""
        out, start = [], 0
        while self.cuts and len(text) - start > limit and (m := _SPACE.search(text, start + limit)):
            out.append(text[start : m.start()])
            start = m.end()
        return [*out, text[start:]]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        return [np.array([t for part in self.cut(x) for t in self.model.encode(part, num_threads=1)], np.uint32) for x in texts.to_pylist()]

    def count(self, texts: pa.Array) -> np.ndarray:
        return np.array([sum(len(self.model.encode(part, num_threads=1)) for part in self.cut(x)) for x in texts.to_pylist()], np.int64)


_encoders: dict[str, JsonEncoder | ModelEncoder] = {}


def encoder(path: str) -> JsonEncoder | ModelEncoder:
    """The encoder of a file, one in each Python worker."""
    if path not in _encoders:
        _encoders[path] = ModelEncoder(path) if path.endswith(".model") else JsonEncoder(path)
    return _encoders[path]


def runs(texts: pa.Array, limit: int = BATCH_BYTES):
    """(first row, rows) of runs with about ``limit`` bytes each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield first, last - first
        first = last


def encode(texts: pa.Array, path: str):
    """Yields (first row, list of id arrays) for runs of texts balanced by bytes; null counts as empty."""
    texts = pc.fill_null(texts, "")
    for first, n in runs(texts):
        yield first, encoder(path)(texts.slice(first, n))


def count(texts: pa.Array, path: str) -> np.ndarray:
    """The number of ids of each text; null counts as empty."""
    texts = pc.fill_null(texts, "")
    return np.concatenate([np.zeros(0, np.int64), *(encoder(path).count(texts.slice(first, n)) for first, n in runs(texts))])


def crc(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
