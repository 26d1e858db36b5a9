"""Byte-level BPE by the tokenizers library, one distinct piece at a time.

A byte-level BPE encodes each pre-token on its own, and no pre-token runs past
the end of a word into the blank behind it. A text may therefore be cut before
each blank that follows a visible character, and the pieces' ids laid end to
end are the text's ids. A task finds its pieces with numpy, looks them all up at
once in a memory of pieces and gives the library only those that are not there.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import mix64, ragged, text_slices

TOKENIZER = "byte_bpe_50k.json"
KEPT_PIECES = 500_000          # beyond so many pieces a new memory is begun, and the one before the last forgotten
KEPT_IDS = 4_000_000           # or ids
SHORT = 23                     # bytes of a piece that three words hold beside its length
SLICE = 2 << 20                # bytes of text worked on at once
JOINED = 200                   # new pieces that go to the library as one text
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def piece_starts(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where texts may be cut: their starts, and every blank behind a visible
    ASCII character or a letter of the Latin-1 block (lead byte 0xC3)."""
    cut = np.zeros(len(b), bool)
    if len(b) > 1:
        before = b[:-1]
        cut[1:] = (b[1:] == 32) & (before > 32) & (before < 127)
        cut[2:] |= (b[2:] == 32) & (b[1:-1] >= 128) & (b[:-2] == 0xC3)
    cut[off[off < len(b)]] = True
    return np.flatnonzero(cut)


def ends_visibly(piece: bytes) -> bool:
    last = piece[-1]
    return 32 < last < 127 or (last >= 128 and len(piece) > 1 and piece[-2] == 0xC3)


class Memory:
    """Pieces with their ids. Pieces of up to SHORT bytes are found by an open
    table over numpy arrays, many at once and by their whole content; longer
    ones by a dict."""

    def __init__(self, kind: type = np.int32) -> None:
        self.n = self.n_ids = 0
        self.keys = np.zeros((3, 1 << 12), np.uint64)
        self.starts, self.counts = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, kind)
        self.table = np.full(1 << 13, -1, np.int32)
        self.long: dict[bytes, int] = {}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key (a column of three words), -1 where there is none."""
        out = np.full(keys.shape[1], -1, np.int32)
        mask = len(self.table) - 1
        at = (_spread(keys) & np.uint64(mask)).astype(np.int64)
        left = np.arange(keys.shape[1])
        while len(left):
            entry = self.table[at]
            there = entry >= 0
            left, at, entry = left[there], at[there], entry[there]
            same = ((self.keys[0, entry] == keys[0, left]) & (self.keys[1, entry] == keys[1, left])
                    & (self.keys[2, entry] == keys[2, left]))
            out[left[same]] = entry[same]
            left, at = left[~same], (at[~same] + 1) & mask
        return out

    def _entries(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of new entries that hold ``ids``, ``counts`` of them each."""
        while self.n + len(counts) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        entry = np.arange(self.n, self.n + len(counts), dtype=np.int32)
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.starts[entry] = self.n_ids + np.cumsum(counts) - counts
        self.counts[entry] = counts
        self.n, self.n_ids = self.n + len(counts), self.n_ids + len(ids)
        return entry

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Entries of distinct keys that the memory does not have yet."""
        entry = self._entries(ids, counts)
        self.keys[:, entry] = keys
        if self.n * 2 > len(self.table):
            while self.n * 2 > len(self.table):
                self.table = np.full(2 * len(self.table), -1, np.int32)
            held = np.ones(self.n, bool)
            held[list(self.long.values())] = False
            self._place(np.flatnonzero(held).astype(np.int32))
        else:
            self._place(entry)
        return entry

    def _place(self, entry: np.ndarray) -> None:
        mask = len(self.table) - 1
        at = (_spread(self.keys[:, entry]) & np.uint64(mask)).astype(np.int64)
        while len(entry):
            free = self.table[at] < 0
            self.table[at[free]] = entry[free]           # of several that want one place, one gets it
            left = self.table[at] != entry
            entry, at = entry[left], at[left]
            at = np.where(self.table[at] >= 0, (at + 1) & mask, at)

    def add_long(self, piece: bytes, ids: np.ndarray) -> int:
        entry = int(self._entries(ids, np.array([len(ids)]))[0])
        self.long[piece] = entry
        return entry

    def ids_of(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[entry].astype(np.int64)
        return self.ids[np.repeat(self.starts[entry], counts) + ragged(counts)].astype(np.int32), counts


def _spread(keys: np.ndarray) -> np.ndarray:
    return mix64((keys[0] * _ODD + keys[1]) * _ODD + keys[2])


def short_keys(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces of up to SHORT bytes as three words: their bytes, padded with
    zeros, and their length in the last byte."""
    padded = np.concatenate([b, np.zeros(24, np.uint8)])
    window = np.ndarray((len(b) + 17,), "<u8", padded, strides=(1,))     # the eight bytes from every place on
    out = np.empty((3, len(starts)), np.uint64)
    for k in range(3):
        held = np.clip(sizes - 8 * k, 0, 8)
        out[k] = window[starts + 8 * k] & _MASKS[held]
    out[2] |= sizes.astype(np.uint64) << np.uint64(56)
    return out


class PieceEncoder:
    """ids of texts, with a memory of pieces: a young one that takes what is met,
    and the one before it, which is asked where the young one has no answer."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)                   # a character of the vocabulary is a byte
        self.kind = np.uint16 if len(self.width) <= 1 << 16 else np.int32
        self.young, self.old = Memory(self.kind), Memory(self.kind)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces end to end, and how many each has. Pieces that begin with
        a blank and end visibly go to the library JOINED at a time."""
        ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        counts = np.zeros(len(pieces), np.int64)
        order: list[int] = []
        run: list[int] = []
        groups: list[list[int]] = []
        for k, p in enumerate(pieces):
            if p[:1] == b" " and ends_visibly(p):
                run.append(k)
                if len(run) == JOINED:
                    groups.append(run)
                    run = []
            else:
                groups.append([k])
        if run:
            groups.append(run)
        texts = [b"".join([pieces[k] for k in g]).decode("utf-8", "replace") for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            own = np.array(e.ids, np.int32)
            if len(group) == 1:
                counts[group[0]] = len(own)
            else:
                sizes = np.cumsum([len(pieces[k]) for k in group])
                ends = np.cumsum(self.width[own])
                if not len(ends) or ends[-1] != sizes[-1]:     # bytes that are no UTF-8: one by one
                    each = [np.array(self.tokenizer.encode(pieces[k].decode("utf-8", "replace"), add_special_tokens=False).ids,
                                     np.int32) for k in group]
                    counts[group] = [len(x) for x in each]
                    own = np.concatenate(each)
                else:
                    counts[group] = np.diff(np.searchsorted(ends, sizes) + 1, prepend=0)
            ids.append(own)
            order += group
        # from the order of the groups to that of the pieces
        of = np.array(order, np.int64)
        flat, taken = np.concatenate(ids), counts[of]
        begin = np.empty(len(pieces), np.int64)
        begin[of] = np.cumsum(taken) - taken
        return flat[np.repeat(begin, counts) + ragged(counts)], counts

    def _pieces(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and memory entries of the pieces of a slice."""
        if self.young.n > KEPT_PIECES or self.young.n_ids > KEPT_IDS:
            self.young, self.old = Memory(self.kind), self.young
        cut = piece_starts(b, off)
        if not len(cut):
            return cut, cut
        sizes = np.diff(np.append(cut, len(b)))
        entries = np.empty(len(cut), np.int64)
        raw = b.tobytes()
        short = sizes <= SHORT
        at = np.flatnonzero(short)
        keys = short_keys(b, cut[at], sizes[at])
        entries[at] = self.young.find(keys)
        missing = np.flatnonzero(entries[at] < 0)
        while len(missing):
            # one of each content, as far as its hash tells; a second round takes what that mixed up
            one = missing[np.unique(_spread(keys[:, missing]), return_index=True)[1]]
            known = self.old.find(keys[:, one])
            again, new = one[known >= 0], one[known < 0]
            if len(again):
                self.young.add(keys[:, again], *self.old.ids_of(known[known >= 0]))
            if len(new):
                begin, size = cut[at[new]].tolist(), sizes[at[new]].tolist()
                self.young.add(keys[:, new], *self._encode([raw[s:s + n] for s, n in zip(begin, size)]))
            entries[at[missing]] = self.young.find(keys[:, missing])
            missing = missing[entries[at[missing]] < 0]
        for k in np.flatnonzero(~short).tolist():
            piece = raw[cut[k]:cut[k] + sizes[k]]
            entry = self.young.long.get(piece)
            if entry is None:
                known = self.old.long.get(piece)
                ids = (self._encode([piece]) if known is None else self.old.ids_of(np.array([known])))[0]
                entry = self.young.add_long(piece, ids)
            entries[k] = entry
        return cut, entries

    def counted(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and numbers of ids of the pieces of a slice."""
        cut, entries = self._pieces(b, off)
        return cut, self.young.counts[entries].astype(np.int64) if len(entries) else entries

    def encode_slice(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and where each text's begin (one entry more)."""
        cut, entries = self._pieces(b, off)
        if not len(entries):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        ids, counts = self.young.ids_of(entries)
        run = np.concatenate([[0], np.cumsum(counts)])
        return ids, run[np.searchsorted(cut, off)]

    def encode(self, texts: pa.Array):
        """Yield the ids of each text in turn; null counts as empty."""
        for _, b, off in text_slices(texts, SLICE):
            ids, first = self.encode_slice(b, off)
            for s, e in zip(first[:-1], first[1:]):
                yield ids[s:e]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker process's encoder: its memory serves all tasks that it runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
