"""Exact, word-cached encoding with a byte-level BPE of the tokenizers library."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8

#: Words a worker remembers before it forgets those that came once, and characters that are cut into words at a time.
CACHE_WORDS = 800_000
SLICE_CHARS = 4_000_000

# A byte-level BPE never merges across a lone space that stands between two characters which aren't white space, from a
# letter to a sign, or behind a lone line break: its pattern starts a new piece there. What lies between such places can
# be encoded once and remembered.
_SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_PLAIN = f"^ | $|[{_SPACE}] | [{_SPACE}]|\\x00"  # RE2: some space isn't lone
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ÿ", r".,;:!?%$#&*()\n"
_FULL = r"[^\s\x1c-\x1f\x85]"
_CUT = re.compile(f"(?<={_FULL})(?= {_FULL})|(?<=[{_LETTER}])(?=[{_SIGN}])|(?<={_FULL}\\n)(?={_FULL})")
_WORD, _WORD_INSIDE = r"^ \p{L}+$", r"^\p{L}+$"  # RE2: most pieces


def _bytes(chars: str) -> np.ndarray:
    """A table of bytes: whether they are among these of ASCII."""
    return np.isin(np.arange(256), [ord(c) for c in chars])


_IS_SIGN, _IS_LETTER = _bytes(".,;:!?%$#&*()\n"), _bytes("".join(chr(c) for c in range(128) if chr(c).isalpha()))
_IS_FULL = _bytes("".join(chr(c) for c in range(1, 128) if not chr(c).isspace()))
_SIGN_TABLE = _IS_SIGN.view(np.uint8).tobytes()
_LEADS = (np.arange(256) >= 0xC3) & (np.arange(256) <= 0xDF)  # two bytes, U+00C0 to U+07FF: no white space among these


def _starts(raw: np.ndarray, off: np.ndarray, data: bytes) -> np.ndarray:
    """Where in the UTF-8 bytes (twice: raw, data) of texts without a space beside white space the pieces start: at such places as _CUT names,
    though not behind each line break that stands beside letters beyond U+07FF."""
    mark = np.append(raw == 32, True)
    at = np.flatnonzero(np.frombuffer(data.translate(_SIGN_TABLE), bool))
    at = at[at > 1]  # what stands at the very first place starts a text anyway
    one, two = raw[at - 1], raw[at - 2]
    wide = (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
    mark[at[_IS_LETTER[one] | wide]] = True
    brk = (raw[at] == 10) & (at + 1 < len(raw))
    at, one, two = at[brk], one[brk], two[brk]
    after = raw[at + 1]
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    full = (_IS_FULL[one] | (_LEADS[two] & (one >= 0x80) & (one < 0xC0))) & (_IS_FULL[after] | _LEADS[after])
    mark[at[full & ~first[at]] + 1] = True
    mark[off] = True
    return mark


def _sums(words: pa.Array) -> np.ndarray:
    """A number for each word, none of them empty: its bytes as a polynomial's coefficients, in 64 bits."""
    raw, off = utf8(words)
    lens = np.diff(off)
    power = np.full(lens.max(initial=1), 0x9E3779B97F4A7C15, np.uint64)
    np.multiply.accumulate(power, out=power)
    at = np.arange(len(raw)) - np.repeat(off[:-1], lens)
    return np.add.reduceat((raw + np.uint64(1)) * power.take(at), off[:-1]) if len(words) else np.zeros(0, np.uint64)


class Encoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():  # such a vocabulary spells each byte with one character
            self.bytes_of[i] = len(piece)
        self._reset()

    def _reset(self) -> None:
        self.words = pa.array([], pa.string())
        self.sums, self.of = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted, and the words that have them
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int64)  # slices that a word came in

    def _thin(self) -> None:
        """Forget the words that came in one slice alone; keep half as many as may be remembered at most."""
        uses = self.uses[: len(self.words)]
        keep = np.flatnonzero(uses > 1)
        if len(keep) > CACHE_WORDS // 2:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[: CACHE_WORDS // 2]])
        words, ids, lens = self.words.take(pa.array(keep)), self._ids(keep)[0], self.count[keep]
        self._reset()
        self._keep(words, ids, lens)
        sums = _sums(words)
        self.of = np.argsort(sums)
        self.sums = sums[self.of]

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, one after another, and the boundaries between the words."""
        lens, to = self.count.take(at), np.zeros(len(at) + 1, np.int64)
        np.cumsum(lens, out=to[1:])
        where = np.repeat(self.start.take(at) - to[:-1], lens)
        where += np.arange(len(where))
        return self.flat.take(where), to

    def _keep(self, words: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        n0, n1, total = len(self.words), len(self.words) + len(words), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.flat[self.used : self.used + total] = ids
        self.start[n0:n1] = self.used + np.cumsum(lens) - lens
        self.count[n0:n1] = lens
        self.used += total
        self.words = pa.concat_arrays([self.words, words])

    def _find(self, names: pa.Array, sums: np.ndarray) -> np.ndarray:
        """The places of pieces that are remembered, -1 for others: found by their sums, then compared."""
        place = np.full(len(names), -1)
        if len(self.sums):
            order, at = np.argsort(sums), np.empty(len(sums), np.int64)
            at[order] = np.searchsorted(self.sums, sums[order])  # in order, so neighbours are looked up where the last one was
            np.minimum(at, len(self.sums) - 1, out=at)
            known = np.flatnonzero(self.sums[at] == sums)
            found = self.of[at[known]]
            same = pc.equal(self.words.take(pa.array(found)), names.take(pa.array(known))).to_numpy(zero_copy_only=False)
            place[known[same]] = found[same]
        return place

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Remember pieces; those that can stand beside others are encoded in runs, cut again by the bytes each id
        stands for. Returns their places."""
        sizes, kind = pc.binary_length(new).to_numpy().astype(np.int64), np.zeros(len(new), np.int8)
        kind[pc.match_substring_regex(new, _WORD).to_numpy(zero_copy_only=False)] = 1  # its own space parts it from what comes before
        kind[pc.match_substring_regex(new, _WORD_INSIDE).to_numpy(zero_copy_only=False)] = 2  # a line break does
        for k in np.flatnonzero(kind == 0).tolist():
            u = new[k].as_py()
            if u and not u[-1].isspace():
                if u[0] == " " and not u[1].isspace():
                    kind[k] = 1
                elif not u[0].isspace():
                    kind[k] = 2
        for x in self.special:
            kind[pc.match_substring(new, x).to_numpy(zero_copy_only=False)] = 0
        place, n0 = np.zeros(len(new), np.int64), len(self.words)
        ids_, lens_, order = [], [], []
        for of in (1, 2):
            which = np.flatnonzero(kind == of)
            for s in range(0, len(which), 2048):
                run = which[s : s + 2048]
                some = new.take(pa.array(run))
                text = utf8(some)[0].tobytes().decode() if of == 1 else "\n".join(some.to_pylist()) + "\n"
                ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                at = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes[run] + (of == 2))) + 1
                lens = np.diff(at, prepend=0)
                if of == 2:
                    ids, lens = np.delete(ids, at - 1), lens - 1
                ids_.append(ids)
                lens_.append(lens)
                order.append(run)
        which = np.flatnonzero(kind == 0)
        if len(which):
            enc = [e.ids for e in self.lib.encode_batch_fast(new.take(pa.array(which)).to_pylist(), add_special_tokens=False)]
            lens_.append(np.fromiter(map(len, enc), np.int64, len(enc)))
            ids_.append(np.fromiter((i for e in enc for i in e), np.uint32, int(lens_[-1].sum())))
            order.append(which)
        run = np.concatenate(order)
        self._keep(new.take(pa.array(run)), np.concatenate(ids_), np.concatenate(lens_))
        place[run] = np.arange(n0, n0 + len(run))
        return place

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self._thin()
        raw, off = utf8(texts)
        data = raw.tobytes()
        plain = pc.invert(pc.match_substring_regex(texts, _PLAIN))
        for s in self.special:
            if s.encode() in data:
                plain = pc.and_(plain, pc.invert(pc.match_substring(texts, s)))
        mark = _starts(raw, off, data)
        for k in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
            t, at = texts[k].as_py(), off[k]
            mark[at + 1 : off[k + 1]] = False
            for piece in [] if any(s in t for s in self.special) else _CUT.split(t)[:-1]:
                at += len(piece.encode())
                mark[at] = True
        start = np.flatnonzero(mark)  # the last one is the end of all
        words = pa.Array.from_buffers(pa.string(), len(start) - 1, [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(raw)])
        coded = words.dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy()
        sums = _sums(names)
        place = self._find(names, sums)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self._learn(names.take(pa.array(new)))
            new = new[np.argsort(sums[new])]
            at = np.searchsorted(self.sums, sums[new])
            self.sums, self.of = np.insert(self.sums, at, sums[new]), np.insert(self.of, at, place[new])
        self.uses[place] += 1
        at = place[code]
        ids, to = self._ids(at)
        return ids, to[np.searchsorted(start, off)]

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the n+1 boundaries between the texts. None is the empty text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        ids, bounds, at = [], [np.zeros(1, np.int64)], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, size[at] + SLICE_CHARS, "right")) - 1)
            some, off = self._some(texts.slice(at, to - at))
            ids.append(some)
            bounds.append(off[1:] + bounds[-1][-1])
            at = to
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(bounds)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append end_id to every document."""
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))
