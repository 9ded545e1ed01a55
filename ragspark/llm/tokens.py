"""Token ids of whole texts by the tokenizers library, one encoding for each distinct word.

A text is cut before every white-space run that follows a visible character, and before a full stop, comma or
exclamation mark that follows an ASCII letter; neither vocabulary has a
token across such a cut, so a text's ids are those of its pieces, one after another. Each worker encodes
the distinct pieces it meets and keeps them; texts with other Unicode spaces or control characters (where
the cut would not be safe), and texts that spell one of the vocabulary's added tokens, are encoded whole. Equality with whole-text encoding is tested.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .kernels import BYTE_VALUES, IS_SPACE, LOWER_VALUES, prefix_hash, spans_hash

#: Entries after which a worker's table is emptied: about 100 MB.
CACHE_ENTRIES = 1_500_000
#: A longer piece is encoded each time.
MAX_PIECE = 64
_SAFE = np.ones(256, bool)
_SAFE[:32] = False
_SAFE[[9, 10, 32]] = True
_SAFE[127] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,!")] = True


class Encoder:
    """Encodes rows of UTF-8 bytes into one flat id array and counts."""

    _kept: dict[str, Encoder] = {}

    @classmethod
    def of(cls, name: str) -> Encoder:
        """The worker's encoder for a vocabulary file: its path, or a name known to public_tokenizers."""
        if name not in cls._kept:
            cls._kept[name] = cls(name)
        return cls._kept[name]

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        # A text that spells an added token, such as <|endoftext|>, gets that token's id, and is encoded whole.
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        # Where the vocabulary folds case, pieces that differ in ASCII case share an entry.
        self.values = LOWER_VALUES if "Lowercase" in str(self.tokenizer.normalizer) else BYTE_VALUES
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.dtype)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = self._whole(texts)
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((x for row in ids for x in row), self.dtype, int(count.sum()))
        start = len(self.ids) + np.concatenate([[0], np.cumsum(count)[:-1]])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, start)
        self.count = np.insert(self.count, at, count)
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row)."""
        n_rows, n = len(offsets) - 1, len(data)
        counts = np.zeros(n_rows, np.int64)
        if n == 0:
            return np.zeros(0, self.dtype), counts
        space = IS_SPACE[data]
        cut = np.zeros(n, bool)
        cut[1:] = space[1:] & ~space[:-1]
        cut[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        row = np.searchsorted(offsets, starts, "right") - 1
        # Rows to encode whole: other control characters, or bytes that may begin another Unicode space.
        odd = ~_SAFE[data]
        odd[:-1] |= ((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))) | ((data[:-1] == 0xE2) & ((data[1:] == 0x80) | (data[1:] == 0x81))) | ((data[:-1] == 0xE1) & (data[1:] == 0x9A)) | ((data[:-1] == 0xE3) & (data[1:] == 0x80))
        whole_row = np.zeros(n_rows, bool)
        whole_row[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        long_row = np.zeros(n_rows, bool)
        long_row[row[ends - starts > MAX_PIECE]] = True
        raw = data.tobytes()
        folded = raw.lower()
        for token in self.added:
            at = folded.find(token)
            while at >= 0:
                whole_row[np.searchsorted(offsets, at, "right") - 1] = True
                at = folded.find(token, at + 1)
        keys = spans_hash(prefix_hash(data, self.values), starts, ends)
        by_piece = ~whole_row[row]
        long_piece = by_piece & (ends - starts > MAX_PIECE)
        use = by_piece & ~long_piece
        distinct, first, inverse = np.unique(keys[use], return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == distinct[inside]
        if len(self.keys) > CACHE_ENTRIES:
            self._clear()
            known[:] = False
        if not known.all():
            new = np.flatnonzero(use)[first[~known]]
            self._learn(distinct[~known], [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        # One source slice for each piece: in the table, or in what is encoded for this call only.
        extra_rows = np.flatnonzero(whole_row)
        extra = [raw[offsets[r] : offsets[r + 1]].decode() for r in extra_rows.tolist()] + [raw[a:b].decode() for a, b in zip(starts[long_piece].tolist(), ends[long_piece].tolist(), strict=True)]
        extra_ids = self._whole(extra) if extra else []
        extra_count = np.fromiter(map(len, extra_ids), np.int64, len(extra_ids))
        pool = np.concatenate([self.ids, np.fromiter((x for r in extra_ids for x in r), self.dtype, int(extra_count.sum()))]) if extra else self.ids
        extra_start = len(self.ids) + np.concatenate([[0], np.cumsum(extra_count)[:-1]]).astype(np.int64) if extra else np.zeros(0, np.int64)
        place = np.searchsorted(self.keys, distinct)[inverse]
        src, cnt = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        src[use], cnt[use] = self.start[place], self.count[place]
        k = len(extra_rows)
        src[long_piece], cnt[long_piece] = extra_start[k:], extra_count[k:]
        if k:  # a row encoded whole takes the place of its first piece
            head = np.searchsorted(row, extra_rows)
            src[head], cnt[head] = extra_start[:k], extra_count[:k]
        total = int(cnt.sum())
        out_start = np.concatenate([[0], np.cumsum(cnt)[:-1]])
        take = np.repeat(src - out_start, cnt) + np.arange(total)
        counts = np.bincount(row, cnt, n_rows).astype(np.int64)
        return pool[take], counts


def ids_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids)
