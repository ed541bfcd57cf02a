"""Token ids of whole text columns: texts are split at safe boundaries and every different piece is encoded once.

A piece starts where white space follows a character that is none, or a mark follows a letter or digit. The pre-tokenizer of
byte-level BPE never joins the two, and what it makes of a run of white space and the word behind it depends on nothing
before, so the ids of the pieces, one after the other, are those of the whole text. Where the character before may be white
space beyond ASCII, nothing is split, nor at the marks that special strings are written with.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from boxledger.llm.textarrays import IS_SPACE, Texts, per_row

WINDOW = 1_000_000  # bytes of a text that are split and encoded at once
MEMO = 500_000  # different pieces whose ids a worker remembers
RECENT = 8  # windows back to which pieces are kept when there are more

# Bytes that are sure to be a character, or to end one, that is no white space; 0x80-0xBF are looked at with what leads them.
_PLAIN = np.ones(256, bool)
_PLAIN[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
# Any bytes of which no special string is made would do.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&'()*+,-./:;=?@[]^_`{}~"]] = True
# Leading two bytes of three-byte characters among which there is white space.
_MIXED = {0xE1: (0x9A, 0xA0), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}


def safe_starts(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places p, low < p < high, of safe boundaries in a text that starts at or before ``low``."""
    here = data[low + 1 : high]
    marks = np.flatnonzero(_MARK[here] & _LETTER[data[low : high - 1]]) + low + 1
    at = np.flatnonzero(IS_SPACE[here]) + low + 1
    before = data[at - 1]
    good = _PLAIN[before]
    tail = np.flatnonzero((before >= 0x80) & good)
    if len(tail):
        one = data[np.maximum(at[tail] - 2, 0)]
        two = data[np.maximum(at[tail] - 3, 0)]
        doubtful = one == 0xC2
        for lead, seconds in _MIXED.items():
            doubtful |= (two == lead) & np.isin(one, seconds)
        good[tail[doubtful]] = False
    return np.sort(np.concatenate([at[good], marks]), kind="stable")


# One word that the pattern of byte-level BPE leaves whole: Latin letters, digits or marks, after at most one space.
_WORD = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!\"#$%&'()*+,\-./:;=?@\[\]^_`{}~]+)")


def merge_table(model):
    """The merges of a byte-level BPE tokenizer as a tiktoken encoding that takes words between line breaks as they are.

    Both merge the pair that comes first in the order of merges; ids have that order, or there is no table. The library's
    own cache and pair tables make it some five times slower on words that it has not seen.
    """
    import tiktoken

    told = json.loads(model.to_str())["model"]
    if told.get("type") != "BPE" or any(told.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    # Printable bytes stand for themselves, the others for the characters from 256 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    vocabulary = told["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in told["merges"]]
    made = [vocabulary[a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or any(c not in vocabulary or vocabulary[c] >= made[0] for c in byte_of):
        return None
    ranks = {bytes(byte_of[c] for c in token): vocabulary[token] for token in [*byte_of, *(a + b for a, b in pairs)]}
    table = tiktoken.Encoding("words", pat_str=r"\n|[^\n]+", mergeable_ranks=ranks, special_tokens={})
    return table if len(ranks) == 256 + len(pairs) and len(table.encode_ordinary("\n")) == 1 else None


class Encoder:
    """Ids of one tokenizer file in one worker process: a ``.json`` of tokenizers or a ``.model`` of sentencepiece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.splits, self.merges, self.encode = False, None, lambda xs: model.encode(xs, num_threads=1)
        else:
            from tokenizers import Tokenizer, pre_tokenizers

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            kind = model.pre_tokenizer
            # Only byte-level BPE that cuts by its pattern and has no normalizer is known to start a piece at a safe boundary.
            self.splits = isinstance(kind, pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space and model.normalizer is None
            self.encode = lambda xs: [x.ids for x in model.encode_batch_fast(xs, add_special_tokens=False)]
            self.merges = merge_table(model) if self.splits else None
            self.line_break = self.encode(["\n"])[0][0] if self.merges else -1
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.starts, self.counts, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.window = 0

    def _compact(self) -> None:
        """Keep the pieces of the last windows, so that frequent ones are never encoded again."""
        kept = np.flatnonzero(self.seen > self.window - RECENT)
        if len(kept) > MEMO // 2:
            kept = np.flatnonzero(self.seen == self.window)
        names = list(self.slots)
        self.slots = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.flat = self._ids_of(kept)
        self.counts, self.seen = self.counts[kept], self.seen[kept]
        self.starts = np.cumsum(self.counts) - self.counts

    def _ids_of(self, slots: np.ndarray) -> np.ndarray:
        counts = self.counts[slots]
        before = np.cumsum(counts) - counts
        return self.flat[np.arange(int(counts.sum())) + np.repeat(self.starts[slots] - before, counts)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of words that are merged as a whole; a line break stands between two."""
        ids = np.array(self.merges.encode_ordinary("\n".join(words)), np.int32)
        breaks = np.flatnonzero(ids == self.line_break)
        counts = np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1
        return counts, np.delete(ids, breaks)

    def _encode_others(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.encode(pieces)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return counts, np.fromiter((i for x in lists for i in x), np.int32, int(counts.sum()))

    def _slots_of(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.slots) > MEMO:
            self._compact()
        self.window += 1
        known = self.slots
        new = [x for x in pieces if x not in known]
        if new:
            texts = [x.decode() for x in new]
            words = [self.merges is not None and _WORD.fullmatch(x) is not None for x in texts]
            new = [x for x, fast in zip(new, words, strict=True) if fast] + [x for x, fast in zip(new, words, strict=True) if not fast]
            fast, rest = [x for x, w in zip(texts, words, strict=True) if w], [x for x, w in zip(texts, words, strict=True) if not w]
            parts = [self._encode_words(fast[at : at + 4096]) for at in range(0, len(fast), 4096)]
            parts += [self._encode_others(rest[at : at + 4096]) for at in range(0, len(rest), 4096)]
            counts = np.concatenate([c for c, _ in parts])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
            self.flat = np.concatenate([self.flat, *(ids for _, ids in parts)])
        slots = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        self.seen[slots] = self.window
        return slots

    def _windows(self, t: Texts) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, piece borders) of stretches of about ``WINDOW`` bytes that start and end at row or safe borders."""
        row = 0
        while row < t.rows:
            end = max(int(np.searchsorted(t.at, t.at[row] + WINDOW, "right")) - 1, row + 1)
            low, high = int(t.at[row]), int(t.at[end])
            if not self.splits:  # a text is a piece
                yield row, t.at[row : end + 1]
            elif high - low <= WINDOW:
                inner = t.at[row:end]
                borders = np.sort(np.concatenate([inner, safe_starts(t.data, low, high), [high]]), kind="stable")
                yield row, borders[np.concatenate([[True], borders[1:] != borders[:-1]])]
            else:  # one long text
                at = low
                while at < high:
                    size = WINDOW
                    while True:
                        stop = min(at + size, high)
                        found = safe_starts(t.data, at, stop)
                        if stop == high or len(found):
                            break
                        size *= 2
                    last = high if stop == high else int(found[-1])
                    yield row, np.concatenate([[at], found[found < last], [last]])
                    at = last
            row = end

    def _encoded(self, t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first bytes of the pieces, their slots) window by window; slots are valid until the next window."""
        data = pa.py_buffer(np.ascontiguousarray(t.data))
        for _, borders in self._windows(t):
            if len(borders) < 2:
                continue
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), data])
            coded = pieces.dictionary_encode()
            slots = self._slots_of(coded.dictionary.to_pylist())
            yield borders[:-1], slots[coded.indices.to_numpy(zero_copy_only=False)]

    def count(self, column: pa.Array) -> np.ndarray:
        """Number of ids of every text; a null has none."""
        t = Texts(column)
        total = np.zeros(t.rows, np.int64)
        for first, slots in self._encoded(t):
            edges = np.searchsorted(first, t.at)
            total += per_row(self.counts[slots], edges)
        return total

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the borders of the texts in them."""
        t = Texts(column)
        total, parts = np.zeros(t.rows, np.int64), [np.zeros(0, np.int32)]
        for first, slots in self._encoded(t):
            total += per_row(self.counts[slots], np.searchsorted(first, t.at))
            parts.append(self._ids_of(slots))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(total)])


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
