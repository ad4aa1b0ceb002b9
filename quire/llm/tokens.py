"""Token ids of texts with a public word tokenizer, a word at a time.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of its
words in order. Each distinct word of a batch is encoded once and kept in a bounded cache. When the cache
is full, the words that fewest batches had make room, so that frequent ones are not encoded again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
MAX_CACHED_WORDS = 200_000
SLICE_BYTES = 4 << 20


def vocabulary(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts. ``path``: a ``tokenizers`` file that lower-cases, drops white space, keeps runs
    of letters and runs of punctuation apart, and marks the last piece of each run."""

    #: Closing punctuation behind one of these letters or digits is a run of its own. (Letters that
    #: normalisation may end with a combining mark would not do.)
    CLOSING = "([a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,!?;:*$%&#]+)([ \t\n\v\f\r]|$)"
    #: A text with the opening of a special token goes to the tokenizer whole.
    SPECIAL = "<|"
    PLAIN = r"^(\p{L}+|[.,!?;:*$%&#]+)$"
    #: Of these, the ones that normalisation leaves as they are; they need no more than their bytes' symbols and the merges.
    READY = "^([a-z\u00df-\u00f6\u00f8-\u00ff]+|[.,!?;:*$%&#]+)$"
    SUFFIX = "</w>"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        self.tokenizer = Tokenizer.from_file(path)
        self.steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.ready_steps = None, Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith(self.SUFFIX)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.lists = pa.array([], pa.large_list(pa.uint32()))  # a word's ids
        self.uses = np.zeros(0, np.float32)

    def _forget_rare(self) -> None:
        """Keep three quarters of the bound: the words that most batches had, older batches counting half with each call."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: MAX_CACHED_WORDS * 3 // 4])
        self.known, self.lists, self.uses = self.known.take(pa.array(kept)), self.lists.take(pa.array(kept)), self.uses[kept] / 2

    def _words(self, words: pa.Array) -> np.ndarray:
        """The words' rows in the cache."""
        if len(self.known) > MAX_CACHED_WORDS:
            self._forget_rare()
        rows = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = words.take(pa.array(missing))
            order, lists = self._encode_new(new)
            rows[missing[order]] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, new.take(pa.array(order))])
            self.lists = pa.concat_arrays([self.lists, *lists])
            self.uses = np.concatenate((self.uses, np.zeros(len(new), np.float32)))
        self.uses[rows] += 1
        return rows

    def _encode_new(self, words: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """The words' places in the order of encoding, and their ids in this order."""
        plain, ready = (pc.match_substring_regex(words, x).to_numpy(zero_copy_only=False) for x in (self.PLAIN, self.READY))
        order, lists, others = [], [], [np.flatnonzero(~plain)]
        for own, steps in ((ready, self.ready_steps), (plain & ~ready, self.steps)):
            own = np.flatnonzero(own)
            for part in (own[at : at + 2000] for at in range(0, len(own), 2000)):  # each is one run, so the last pieces tell them apart
                lines = pa.ListArray.from_arrays(np.append(np.arange(0, len(part), 200), len(part)).astype(np.int32), words.take(pa.array(part)))
                ids = np.concatenate(self._ids(pc.binary_join(lines, pa.scalar(" ", pa.large_string())).to_pylist(), steps))
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(part) and ends[-1] == len(ids):
                    order.append(part)
                    lists.append(pa.LargeListArray.from_arrays(np.append(0, ends), ids))
                else:
                    others.append(part)
        rest = np.concatenate(others)
        if len(rest):
            ids = self._ids(words.take(pa.array(rest)).to_pylist(), self.steps)
            order.append(rest)
            lists.append(pa.LargeListArray.from_arrays(np.cumsum([0, *map(len, ids)]), np.concatenate(ids)))
        return np.concatenate(order), lists

    def _ids(self, texts: list[str], steps: tuple) -> list[np.ndarray]:
        """The tokenizer's ids of each text; ``steps``: what it does to a text before the merges."""
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
        try:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.steps

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32) and the number of ids of each text; a null text has none."""
        texts = texts.fill_null("")
        whole = pc.match_substring(texts, self.SPECIAL)
        if not pc.any(whole).as_py():
            return self._plain_texts(texts)
        ids, n = self._plain_texts(pc.if_else(whole, "", texts))
        found = [self._ids([t], self.steps)[0] for t in texts.filter(whole).to_pylist()]
        places, sizes = np.flatnonzero(whole.to_numpy(zero_copy_only=False)), np.fromiter(map(len, found), np.int64)
        ids = np.insert(ids, np.repeat(np.cumsum(n)[places], sizes), np.concatenate(found))
        n[places] = sizes
        return ids, n

    def _plain_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        spaced = pc.replace_substring_regex(pc.ascii_lower(texts), self.CLOSING, r"\1 \2\3")
        split = pc.ascii_split_whitespace(spaced)
        per_text = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        rows = self._words(coded.dictionary.cast(pa.large_string()))
        lists = self.lists.take(pa.array(rows)).take(coded.indices)
        ends = lists.offsets.to_numpy()
        words_end = np.cumsum(per_text)
        return lists.values.to_numpy(), ends[words_end] - ends[words_end - per_text]


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE_BYTES of text, a single longer text alone."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text."""
    return np.insert(ids, np.cumsum(n), end).astype(np.uint32, copy=False), n + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, whose cache serves the worker's later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
