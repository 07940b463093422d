"""Token ids of whole texts by a tokenizer file of the tokenizers library, each distinct word of a batch merged once.

The tokenizer drops white space and never joins across it, so a text's ids are those of its blank-separated chunks in
turn. A part of a batch becomes its distinct chunks and their numbers (Arrow's dictionary encoding). A chunk of letters
below U+0250 and trailing ASCII marks is two pre-tokens, in lower case as the tokenizer's normalizer makes it; the
distinct ones of those are merged into pieces many at a time. Any other chunk goes to the library as it is. The ids of
all texts are then gathered from the chunks'. Nothing is kept from part to part, and a part's bytes are bounded (or it is
one text).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken at once.
AT_ONCE = 24 << 20
#: Bytes of a word that is merged here; a longer one goes to the library.
LONGEST = 31
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ENDING = "</w>"


def default_path() -> str:
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merger:
    """Byte-pair merges of many words in lockstep: of a word's neighbouring pieces the pair of least rank is merged,
    the leftmost of equal ones, until no pair has a rank."""

    def __init__(self, vocab: dict[str, int], merges: list, letters: dict[int, str]):
        place = lambda b, end: vocab[letters[b] + end] if b in letters else 0  # noqa: E731  some bytes are in no text
        self.first = np.array([place(b, "") for b in range(256)], np.int64)
        self.last = np.array([place(b, _ENDING) for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.size = max(vocab.values()) + 1
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [0], np.int32)
        self.none = len(pairs)
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        # open addressing: a pair lies within `reach` places of its hash
        self.bits = (4 * len(key)).bit_length()
        self.keys, self.ranks = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, self.none, np.int32)
        left, at, self.reach = np.arange(len(key)), self._hash(key), 0
        while len(left):
            free = self.keys[at] < 0
            _, one = np.unique(at[free], return_index=True)
            put = left[free][one]
            self.keys[at[free][one]], self.ranks[at[free][one]] = key[put], put
            stay = ~np.isin(left, put)
            left, at, self.reach = left[stay], at[stay] + 1, self.reach + 1

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return (key * -7046029254386353131).view(np.uint64) >> np.uint64(64 - self.bits)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pieces a and b; the number of merges where there is none."""
        key = np.ravel(a * np.int64(self.size) + b)
        at = self._hash(key).astype(np.int64)
        out = np.where(self.keys.take(at) == key, self.ranks.take(at), self.none).astype(np.int32)
        open_ = np.flatnonzero((out == self.none) & (self.keys.take(at) >= 0))
        for step in range(1, self.reach):
            if not len(open_):
                break
            there = self.keys.take(at[open_] + step)
            hit = there == key[open_]
            out[open_[hit]] = self.ranks.take(at[open_[hit]] + step)
            open_ = open_[~hit & (there >= 0)]
        return out.reshape(a.shape)

    def pieces(self, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words that lie in data at `first` with these sizes (0 to LONGEST bytes), one after another, and
        how many each has."""
        count, parts = np.zeros(len(sizes), np.int64), []
        for n in np.unique(sizes[sizes > 0]).tolist():
            mine = np.flatnonzero(sizes == n)
            for part in np.array_split(mine, -(-len(mine) // 16384)):
                ids, count[part] = self._same_size(data[first[part][:, None] + np.arange(n)])
                parts.append((part, ids))
        start = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int32)
        for part, ids in parts:
            inside = np.arange(ids.shape[1]) < count[part][:, None]
            flat[(start[part][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        return flat, count

    def _same_size(self, octets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, n = octets.shape
        piece = np.empty((n + 1, m), np.int64)  # a row for each place; the last only takes part in shifts
        piece[: n - 1] = self.first[octets[:, :-1].T]
        piece[n - 1] = self.last[octets[:, -1]]
        piece[n] = 0
        result, count = np.zeros((m, n), np.int32), np.full(m, n, np.int64)
        rank = np.full((n + 1, m), self.none, np.int32)
        if n > 1:
            rank[: n - 1] = self.rank(piece[: n - 1], piece[1:n])
        place, who = np.arange(n + 1, dtype=np.int32)[:, None], np.arange(m)
        while True:
            least = ((rank << 5) | place).min(0)
            done = least >> 5 == self.none
            if done.any():
                result[who[done]] = piece[:n, done].T
                keep = ~done
                piece, rank, who, least = piece[:, keep], rank[:, keep], who[keep], least[keep]
            if not len(who):
                return result, count
            j, lane = (least & 31).astype(np.int64), np.arange(len(who))
            after = place > j
            piece[:-1] = np.where(after[:-1], piece[1:], piece[:-1])
            rank[:-1] = np.where(after[:-1], rank[1:], rank[:-1])
            new = self.merged[least >> 5].astype(np.int64)
            piece[j, lane] = new
            count[who] -= 1
            right = j + 1 < count[who]
            rank[j, lane] = np.where(right, self.rank(new, piece[j + 1, lane]), self.none)
            left = np.flatnonzero(j > 0)
            rank[j[left] - 1, left] = self.rank(piece[j[left] - 1, left], new[left])


def _lower_table() -> tuple[np.ndarray, np.ndarray]:
    """By code point below U+0250: what a byte or pair of bytes of it is (1 a letter that the short cut takes, 2 a
    trailing mark, else 0), and its lower case."""
    kind, low = np.zeros(0x250, np.uint8), np.arange(0x250, dtype=np.int64)
    for c in range(0x250):
        x = chr(c).lower()
        if chr(c).isalpha() and len(x) == 1 and ord(x) < 0x250 and (c < 128) == (ord(x) < 128):
            kind[c], low[c] = 1, ord(x)
        elif chr(c) in _MARKS:
            kind[c] = 2
    return kind, low


_KIND, _LOW = _lower_table()


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then those of first[1], and so on."""
    stop = np.cumsum(n)
    kind = np.int32 if len(n) == 0 or stop[-1] + first.max() < 1 << 31 else np.int64
    out = np.repeat((first - (stop - n)).astype(kind), n)
    out += np.arange(len(out), dtype=kind)
    return out


class Encoder:
    """Ids as little-endian unsigned integers of `dtype`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        # the short cuts hold for tokenizers that drop blanks and mark each word's last piece
        self.words_apart = any(w.endswith(_ENDING) for w in vocab)
        self.merger = self._merger()

    def _merger(self) -> Merger | None:
        """For a plain byte-level model; the letter that stands for a byte is asked from the library."""
        model = json.loads(self.tokenizer.to_str())["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _ENDING or model.get("dropout") or model.get("ignore_merges") or not self.words_apart:
            return None
        from tokenizers.pre_tokenizers import ByteLevel

        try:
            return Merger(model["vocab"], model["merges"], _letters(ByteLevel(add_prefix_space=False, use_regex=False)))
        except KeyError:  # a merge without its piece
            return None

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after another, and how many each text has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(n.sum())), n

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct chunks: an array of ids, and where each chunk's begin in it and how many it has."""
        m = len(chunks)
        offsets = np.frombuffer(chunks.buffers()[1], np.int64, m + 1, 8 * chunks.offset)
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
        cut, whole = offsets[:-1] - offsets[0], offsets[-1] - offsets[0]
        sizes = np.diff(offsets)
        # what each byte is; both bytes of a letter of two are letters
        kind = np.where(data < 128, _KIND[np.minimum(data, 127)], 0)
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xCA))
        point = (data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63
        lead, point = lead[point < 0x250], point[point < 0x250]
        kind[lead] = kind[lead + 1] = _KIND[point]
        plain = np.zeros(m, bool)
        letters = np.zeros(m, np.int64)
        some = np.flatnonzero(sizes)
        if self.merger and len(some):
            total = lambda x: np.add.reduceat(x, cut[some], dtype=np.int64)
            back = (kind[1:] == 1) & (kind[:-1] == 2)  # a letter after a mark, unless a chunk begins there
            back = np.append(back, False)
            ends = cut[some][1:] - 1
            back[ends] = False
            letters[some] = total(kind == 1)
            plain[some] = (total(kind == 0) == 0) & (total(back) == 0) & (letters[some] > 0) & (sizes[some] - letters[some] <= LONGEST) & (letters[some] <= LONGEST)
        ascii_ = data < 128
        data[ascii_] = _LOW[:128].astype(np.uint8)[data[ascii_]]
        low = _LOW[point]
        two = low >= 128
        data[lead[two]], data[lead[two] + 1] = 0xC0 | low[two] >> 6, 0x80 | low[two] & 63
        # the letters and the marks of plain chunks: neighbours in data, so their bounds alone make an array of them
        bounds = np.stack([cut, cut + letters], 1).ravel()
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * m, [None, pa.py_buffer(np.append(bounds, whole).astype(np.int64)), pa.py_buffer(data)])
        units = units.filter(pa.array(np.repeat(plain, 2))).dictionary_encode()
        words, index = units.dictionary, units.indices.to_numpy()
        at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        octets = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        ids, n = self.merger.pieces(octets, at[:-1], np.diff(at)) if len(words) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        mine = n[index]
        flat = ids[_ragged((np.cumsum(n) - n)[index], mine)]
        count = np.zeros(m, np.int64)
        count[plain] = mine.reshape(-1, 2).sum(1)
        others, count[~plain] = self._by_library(chunks.filter(pa.array(~plain)).to_pylist())
        first = np.zeros(m, np.int64)
        first[plain] = np.cumsum(count[plain]) - count[plain]
        first[~plain] = len(flat) + np.cumsum(count[~plain]) - count[~plain]
        return np.concatenate([flat, others]).astype(self.dtype), first, count

    def encode_array(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The ids of texts (null: none) in parts: for each the first text's number, all ids, and where each text's begin
        and the last one's end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
            yield at, *self._part(texts.slice(at, stop - at))
            at = stop

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.words_apart:
            ids, n = self._by_library(texts.to_pylist())
            return ids.astype(self.dtype), np.concatenate(([0], np.cumsum(n)))
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        flat, first, count = self._chunks(coded.dictionary)
        each = count[index]
        stop = np.concatenate(([0], np.cumsum(each)))
        offsets = lists.offsets.to_numpy()
        return flat[_ragged(first[index], each)], stop[offsets - offsets[0]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: none) as bytes of dtype."""
        return [ids[a:b].tobytes() for _, ids, cuts in self.encode_array(pa.array(texts, pa.string())) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _letters(level) -> dict[int, str]:
    """The letter by which the library writes each byte."""
    out = {}
    for c in map(chr, [*range(0x80), *range(0x80, 0x800), *range(0x1000, 0x10000, 0x1000), *range(0x10000, 0x110000, 0x10000)]):
        if not 0xD800 <= ord(c) < 0xE000:
            for b, x in zip(c.encode(), level.pre_tokenize_str(c)[0][0]):
                out[b] = x
    return out


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about AT_ONCE bytes: more words are met again in one."""
    held: list[pa.RecordBatch] = []
    size = 0

    def all_held() -> Iterator[pa.RecordBatch]:
        return iter(pa.Table.from_batches(held).combine_chunks().to_batches())

    for b in batches:
        if held and size + b.nbytes > AT_ONCE:
            yield from all_held()
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield from all_held()


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder for a file: tasks that follow one another share what it remembers."""
    path = path or default_path()
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
