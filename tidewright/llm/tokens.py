"""Token ids of whole texts by the ``tokenizers`` library, each distinct piece of a chunk encoded once.

A tokenizer's pre-tokenizer never joins characters across certain white space, so a text's ids are
those of its pieces in order. Arrow splits a chunk of texts and numbers its distinct pieces; those that
a small table of pieces met before does not hold go through the library, many at a time, with a
separator whose id is known. No step looks at single pieces in Python.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space to Python and Arrow but not to the tokenizers: such texts are encoded whole.
ODD = re.compile("[\x1c-\x1f]")
#: Where white space is kept, runs of it can be one piece or several; texts that have runs, or the
#: mark that pieces are split at, are encoded whole. The others have single spaces, which go with the
#: word after them, and single line feeds, which stand alone.
CUT = "\x03"
RUNS = re.compile("[^\\S \n]|  | \n|\n\n|\n \\Z|[\x03\x1c-\x1f]")
#: Missing pieces that are encoded as one string.
JOINED = 1000
#: Characters of texts whose pieces are numbered together, and pieces whose ids are gathered together.
CHUNK, GATHER = 6 << 20, 300_000
#: Marks that a letter run ends at, whatever they are followed by, and that never join it.
MARKS = ",.;:!?"
#: The letters below U+0100: a run of them, with a space before it or none, is one pre-token.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
RUN = "^ ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - size), size) + np.arange(total)


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes; special-token strings are ordinary text.

    path: a ``tokenizers`` JSON file. limit: pieces that are remembered from chunk to chunk, first come,
    so common ones above all; the others are encoded once a chunk.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.limit = limit
        self.split = self.sep = None
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.lower = bool(norm) and "Lowercase" in json.dumps(norm)
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.split, self.sep, self.whole = self._kept, "\n", self._has_runs
        elif norm and self._drops_space(norm, pre):
            self.split, self.sep, self.whole = self._dropped, " \x01 ", ODD.search
        if self.sep:
            ids = self._ids([self.sep.strip(" ")])[0]
            self.mark = ids[0] if len(ids) == 1 else None
            if self.mark is None:
                self.split = None
        self.bare = self._bare(spec)
        #: Pieces of white space alone, which the separator could join, are known from the start.
        fixed = ["", " ", "\n"]
        self.known = pa.array(fixed, pa.string())
        self.ids, self.sizes = self._one_by_one(fixed)

    @staticmethod
    def _drops_space(norm: dict, pre: dict) -> bool:
        kinds = [x["type"] for x in norm.get("normalizers", [norm])]
        first = (pre.get("pretokenizers") or [pre])[0]
        return set(kinds) <= {"NFC", "Replace", "Lowercase"} and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert", False)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bare(self, spec: dict):
        """The tokenizer's model alone, for runs of letters that are one pre-token: bytes are mapped here.

        Byte-level models write printable Latin-1 bytes as themselves and the others as the characters
        from 256 on. Here a line feed is a space, where pre-tokens end, and byte 1 between two line feeds
        is a separator whose id is ``bare_mark``.
        """
        from tokenizers import Tokenizer

        levels = [x.get("type") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [spec.get("pre_tokenizer") or {}])]
        if self.split is None or "ByteLevel" not in levels:
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.table = np.zeros(256, "<u4")
        self.table[printable] = printable
        rest = [x for x in range(256) if x not in printable]
        self.table[rest] = 256 + np.arange(len(rest))
        mark = chr(self.table[1])
        self.table[10] = 32
        bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
        ids = bare.encode(mark, add_special_tokens=False).ids
        self.bare_mark = ids[0]
        return bare if len(ids) == 1 else None

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self._ids(pieces)
        return np.array([i for x in got for i in x], "<u4"), np.array([len(x) for x in got], np.int64)

    def _joined(self, pieces: pa.StringArray, bare: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces encoded in groups; a group whose separator came up inside it, piece by piece."""
        n = len(pieces)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        bounds = np.append(np.arange(0, n, JOINED), n).astype(np.int32)
        if bare and self.lower:
            pieces = pc.utf8_lower(pieces)
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), pieces), "\n\x01\n" if bare else self.sep)
        if bare:
            at = np.frombuffer(groups.buffers()[1], np.int32, len(groups) + 1, 4 * groups.offset)
            text = self.table[np.frombuffer(groups.buffers()[2], np.uint8)[at[0] : at[-1]]].tobytes().decode("utf-32-le")
            texts = [text[a:b] for a, b in zip((at - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=False)]
        else:
            texts = groups.to_pylist()
        ids, sizes, mark = [], [], self.bare_mark if bare else self.mark
        model = self.bare if bare else self.tokenizer
        for k, text in enumerate(texts):
            a = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(a == mark)
            if len(cuts) == bounds[k + 1] - bounds[k] - 1:
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(a)]])) - 1)
                ids.append(np.delete(a, cuts))
            else:
                one = self._one_by_one(pieces.slice(bounds[k], bounds[k + 1] - bounds[k]).to_pylist())
                ids.append(one[0])
                sizes.append(one[1])
        return np.concatenate(ids), np.concatenate(sizes)

    def _segments(self, segs: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, size) of distinct segments: those remembered, and the others encoded and remembered."""
        at = pc.index_in(segs, value_set=self.known)
        new = pc.is_null(at)
        missing = segs.filter(new)
        if self.bare is None:
            ids, sizes = self._joined(missing, False)
        else:
            run = pc.match_substring_regex(missing, RUN)
            order = np.argsort(~run.to_numpy(zero_copy_only=False), kind="stable")  # runs of letters first
            missing = missing.take(pa.array(order))
            letters = pc.sum(run).as_py() or 0
            ids, sizes = map(np.concatenate, zip(self._joined(missing.slice(0, letters), True), self._joined(missing.slice(letters), False), strict=True))
        flat, size = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        start = np.cumsum(size) - size
        row = at.fill_null(0).to_numpy()
        where = np.flatnonzero(new.to_numpy(zero_copy_only=False))
        row = row.astype(np.int64)
        row[where[order] if self.bare is not None else where] = len(self.known) + np.arange(len(where))
        out = flat, start[row], size[row]
        room = min(len(missing), self.limit - len(self.known))
        if room > 0:
            self.known = pa.concat_arrays([self.known, missing.slice(0, room)])
            self.ids, self.sizes = flat[: int(size[: len(self.known)].sum())].copy(), size[: len(self.known)].copy()
        return out

    def _of_pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, size) of distinct pieces, in order. A run of letters with marks after it is two segments."""
        if self.bare is None:
            flat, start, size = self._segments(pieces)
            return flat[ranges(start, size)], size
        stems = pc.utf8_rtrim(pieces, characters=MARKS)
        marked = pc.and_(pc.match_substring_regex(stems, RUN), pc.not_equal(pc.binary_length(pieces), pc.binary_length(stems)))
        tails = pc.utf8_ltrim(pieces.filter(marked), characters=" " + LETTERS)
        coded = pa.concat_arrays([pc.if_else(marked, stems, pieces), tails]).dictionary_encode()
        flat, start, size = self._segments(coded.dictionary)
        code, n = coded.indices.to_numpy(), len(pieces)
        seg = np.zeros((n, 2), np.int64)
        long = np.zeros((n, 2), np.int64)
        seg[:, 0], long[:, 0] = start[code[:n]], size[code[:n]]
        has = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        seg[has, 1], long[has, 1] = start[code[n:]], size[code[n:]]
        return flat[ranges(seg.ravel(), long.ravel())], long.sum(1)

    @staticmethod
    def _has_runs(t: str) -> bool:
        """As ``RUNS`` finds, by plain searches where the characters allow it."""
        if "  " in t or " \n" in t or "\n\n" in t or t.endswith("\n ") or any(c in t for c in "\t\r\x0b\x0c\x03\x1c\x1d\x1e\x1f"):
            return True
        if t.isascii():
            return False
        return "\x85" in t or "\xa0" in t if Encoder._latin(t) else bool(RUNS.search(t))

    def _kept(self, texts: list[str]) -> pa.ListArray:
        return pc.split_pattern(pa.array([t.replace(" ", CUT + " ").replace("\n", CUT + "\n" + CUT) for t in texts], pa.string()), CUT)

    def _dropped(self, texts: list[str]) -> pa.ListArray:
        return pc.utf8_split_whitespace(pa.array([t.lower() if self.lower and self._latin(t) else t for t in texts], pa.string()))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The id bytes of each text; null counts as empty. Equal texts of a batch are encoded once."""
        done: dict[str, bytes] = {}
        clean = []
        for t in dict.fromkeys(t or "" for t in texts):
            if self.split is None or self.whole(t):
                done[t] = np.asarray(self._ids([t])[0], dtype="<u4").tobytes()
            else:
                clean.append(t)
        for a, b in chunks(clean, CHUNK):
            self._encode_chunk(clean[a:b], done)
        return [done[t or ""] for t in texts]

    def _encode_chunk(self, texts: list[str], done: dict[str, bytes]) -> None:
        lists = self.split(texts)
        coded = lists.flatten().dictionary_encode()
        flat, size = self._of_pieces(coded.dictionary)
        start = np.cumsum(size) - size
        code = coded.indices.to_numpy()
        bounds = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        first = 0
        while first < len(texts):  # as many texts as have about GATHER pieces
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + GATHER, "right")) - 1)
            own = code[bounds[first] : bounds[last]]
            n = size[own]
            ids = flat[ranges(start[own], n)]
            ends = np.concatenate([[0], np.cumsum(n)])[bounds[first : last + 1] - bounds[first]].tolist()
            for t, a, b in zip(texts[first:last], ends, ends[1:], strict=False):
                done[t] = ids[a:b].tobytes()
            first = last

    @staticmethod
    def _latin(text: str) -> bool:
        """Whether lowering can be done up front: these characters lower one by one, alike everywhere."""
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return False


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a file; workers that are used again keep it, with its bounded table."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def chunks(texts: list, size: int = CHUNK) -> list[tuple[int, int]]:
    """Ranges of a batch whose texts add up to about ``size`` characters, so that ids stay small in memory."""
    out, a, n = [], 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= size:
            out.append((a, i + 1))
            a, n = i + 1, 0
    if a < len(texts):
        out.append((a, len(texts)))
    return out
