"""Tokenizing whole text columns with the public tokenizers, word by word.

Both tokenizer files split a text into words before the byte-pair merges, and no word reaches
across white space (the byte-level one takes a single leading blank into the word). A text is
therefore cut at blanks, equal words of a batch are merged by Arrow's dictionary encoding, and
the tokenizers library encodes only words that the worker has not met lately. Texts in
which white space characters touch each other, where a byte-level word depends on
its neighbours, are cut by the tokenizer's own white space rule instead.
"""

from __future__ import annotations

import re
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Unicode White_Space, as the tokenizers' regular expressions have it (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_RE2_WHITE = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOUCHING = f"[{_RE2_WHITE}][{_RE2_WHITE}]|^[{_RE2_WHITE}]|[{_RE2_WHITE}]$"
_PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")

CACHE_WORDS = 700_000  # words remembered per worker: about 130 MB
_JOIN = 128  # fresh words joined to one text for a call
# A letter or digit and a sign after it belong to different words; an apostrophe can begin a word ('s), so it is not listed. Only ASCII and
# Latin letters that the normal form and lower case leave one letter are cut at: others may end in a mark, which would join the sign (İ).
_SIGN_AFTER = r"""([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])([.,;:!?"#$%&()*+/<=>@\[\]^`{|}~-])"""


# Words of these letters are one word to the tokenizers whatever stands around them.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"


class WordTokenizer:
    """Encodes string arrays to flat ids and offsets."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # their strings in a text are ordinary text
        self.joined = Tokenizer.from_file(path)  # here a special token stands between words
        spec = json.loads(self.plain.to_str())
        last = spec["added_tokens"][-1]
        self.mark, self.mark_id = last["content"], last["id"]
        # The word-level file drops white space and case; the byte-level one takes a leading blank into the word.
        self.leading_blank = spec["normalizer"] is None
        # Ids that end a word, or (byte-level) begin one with its blank: they tell the words of a joined text apart.
        self.plain_word = re.compile((" " if self.leading_blank else "") + _LETTERS)
        self.edge = np.zeros(self.plain.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.plain.get_vocab(with_added_tokens=False).items():
            self.edge[i] = token.startswith("\u0120") if self.leading_blank else token.endswith(spec["model"]["end_of_word_suffix"])
        self._reset(CACHE_WORDS)

    def _reset(self, room: int) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 21, np.uint32)
        self.used = 0
        self.starts = np.zeros(room + 1, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        k, n = len(self.index), len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[k + 1 : k + n + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.index.update(zip(words, range(k, k + n), strict=True))

    def _learn(self, words: list[str]) -> None:
        odd = [w for w in words if "<|" in w]
        words = [w for w in words if "<|" not in w] if odd else words
        known = list(map(self.plain_word.fullmatch, words))
        self._learn_plain(list(compress(words, known)))
        words = [w for w, k in zip(words, known, strict=True) if k is None]
        for w in odd:
            ids = np.array(self.plain.encode(w, add_special_tokens=False).ids, np.uint32)
            self._add([w], ids, np.array([len(ids)]))
        for i in range(0, len(words), 64 * _JOIN):
            part = words[i : i + 64 * _JOIN]
            texts = [self.mark.join(part[j : j + _JOIN]) + self.mark for j in range(0, len(part), _JOIN)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.joined.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.mark_id)
            lengths = np.diff(ends, prepend=-1) - 1
            self._add(part, ids[ids != self.mark_id], lengths)

    def _learn_plain(self, plain: list[str]) -> None:
        """Learn words of letters, joined to texts as they are."""
        for i in range(0, len(plain), 64 * _JOIN):
            part = plain[i : i + 64 * _JOIN]
            between = "" if self.leading_blank else " "
            texts = [between.join(part[j : j + _JOIN]) for j in range(0, len(part), _JOIN)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)])
            edges = np.flatnonzero(self.edge[ids])
            lengths = np.diff(edges, append=len(ids)) if self.leading_blank else np.diff(edges, prepend=-1)
            if len(lengths) != len(part):
                raise ValueError("the tokenizer does not keep words of letters apart")
            self._add(part, ids, lengths)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of texts in which no white space touches other white space."""
        if not self.leading_blank:  # white space is dropped, so it is the mark of a cut itself
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.replace_substring_regex(texts, _SIGN_AFTER, "\\1 \\2")))
            return lists.flatten(), np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        texts = pc.replace_substring_regex(texts, _SIGN_AFTER, "\\1\x00\\2")
        texts = pc.replace_substring(texts, " ", "\x00 ")
        lists = pc.split_pattern(texts, "\x00")
        return lists.flatten(), np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts and the number of words before each text. For byte-level words, texts that hold the cutting mark
        or touching white space are cut by the white space rule."""
        if not self.leading_blank:
            return self._cut(texts)
        odd = pc.or_(pc.match_substring(texts, "\x00"), pc.match_substring_regex(texts, _TOUCHING))
        if not pc.any(odd).as_py():
            return self._cut(texts)
        odd = odd.to_numpy(zero_copy_only=False)
        plain, plain_at = self._cut(texts.filter(pa.array(~odd)))
        pieces = [_PIECES.findall(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        n = np.zeros(len(texts), np.int64)
        n[~odd], n[odd] = np.diff(plain_at), [len(p) for p in pieces]
        flat = pa.concat_arrays([plain, pa.array([w for p in pieces for w in p], pa.large_string())])
        first = np.zeros(len(texts), np.int64)  # where each text's words begin in flat
        first[~odd] = plain_at[:-1]
        first[odd] = plain_at[-1] + np.cumsum([0, *map(len, pieces)])[:-1]
        return flat.take(pa.array(ragged(first, n))), np.concatenate([[0], np.cumsum(n)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) of all texts and each text's first place in them (one more at the end)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        words, at = self._words(texts)
        if len(words) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.index) + len(distinct) > CACHE_WORDS:
            self._reset(max(CACHE_WORDS, len(distinct)))
        slot = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            fresh = [distinct[i] for i in missing]
            self._learn(fresh)
            slot[missing] = np.fromiter(map(self.index.__getitem__, fresh), np.int64, len(fresh))
        slot = slot[coded.indices.to_numpy()]
        n = self.starts[slot + 1] - self.starts[slot]
        ids = self.ids[ragged(self.starts[slot], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[at]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    """The tokenizer of a file, one per Python worker."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def text_slices(batches, max_chars: int = 4_000_000):
    """Cut Arrow batches with a string column ``text`` into slices of about ``max_chars`` bytes: bounds the memory of a worker."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
        lo = 0
        while lo < batch.num_rows:
            before = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, before + max_chars, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
