"""Fast exact ids of the word tokenizer: each distinct word is encoded once in a worker and looked up by hash.

``word_bpe_49k.json`` treats white space as a boundary in every step (normalizer, splitting pattern, merges), so the
ids of a text are those of its space-separated words, one after the other. A tokenizer of another build is used on
whole texts instead.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lichen.llm._words import Pair, slices, words

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[\n!-~À-ÖØ-öø-ÿ]+")
_RUNS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-zß-öø-ÿ0-9]+")


def word_path() -> str:
    """The public word tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids by the tokenizer of a file, with a bounded table of words already seen."""

    def __init__(self, path: str, most_words: int = 500_000, most_ids: int = 8_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = (
            (spec.get("normalizer") or {}).get("normalizers") == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
            and ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern") == {"Regex": _PATTERN}
            and spec.get("post_processor") is None
            and spec["model"].get("end_of_word_suffix") == "</w>"
        )
        self.size = self.full.get_vocab_size()
        if self.by_word:
            model = spec["model"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.light = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix="</w>", cache_capacity=0))
            self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.size, bool)
            for token, i in self.full.get_vocab().items():
                self.last[i] = token.endswith("</w>")
        self.most_words, self.most_ids = most_words, most_ids
        self._clear()

    def _clear(self) -> None:
        self.bits = 18
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.n, self.filled = 0, 0
        self.hash = np.empty(1 << 16, np.uint64)
        self.start = np.empty(1 << 16, np.int64)
        self.length = np.empty(1 << 16, np.int64)
        self.ids = np.empty(1 << 18, np.uint32)
        self.runs: dict[str, np.ndarray] = {}

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 for none; open addressing, all hashes a step at a time."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = h & mask
        found = self.at[slot]
        left = np.flatnonzero((found >= 0) & (self.keys[slot] != h))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & mask
            got = self.at[slot[left]]
            found[left] = got
            left = left[(got >= 0) & (self.keys[slot[left]] != h[left])]
        return found

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = np.uint64((1 << self.bits) - 1)
        slot = h & mask
        left = np.arange(len(h))
        while len(left):
            free = self.at[slot[left]] < 0
            mine = left[free]
            self.at[slot[mine]] = entry[mine]
            won = self.at[slot[mine]] == entry[mine]
            self.keys[slot[mine[won]]] = h[mine[won]]
            left = np.concatenate([left[~free], mine[~won]])
            slot[left] = (slot[left] + np.uint64(1)) & mask

    def _learn(self, h: np.ndarray, texts: list[bytes]) -> None:
        """Entries for new words; h are distinct and unknown."""
        ids, lengths = self._encode(texts)
        n, m = len(h), len(ids)
        for name, need in (("hash", self.n + n), ("start", self.n + n), ("length", self.n + n), ("ids", self.filled + m)):
            old = getattr(self, name)
            if need > len(old):
                new = np.empty(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.hash[self.n : self.n + n] = h
        self.length[self.n : self.n + n] = lengths
        self.start[self.n : self.n + n] = self.filled + np.cumsum(lengths) - lengths
        self.ids[self.filled : self.filled + m] = ids
        before, self.n, self.filled = self.n, self.n + n, self.filled + m
        if self.n * 2 > len(self.at):
            while self.n * 3 > 1 << self.bits:
                self.bits += 1
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.at = np.full(1 << self.bits, -1, np.int32)
            before = 0
        self._place(self.hash[before : self.n], np.arange(before, self.n, dtype=np.int32))

    def _encode(self, found: list[bytes]) -> Pair:
        """(ids of all words, ids of each); a word holds no line feed, so one joined text stands for all."""
        joined = b"\n".join(found).decode("utf-8", "replace")
        slow: dict[int, bytes] = {}
        if "<|" in joined or not _PLAIN.fullmatch(joined):
            each = joined.split("\n")
            odd = [i for i, w in enumerate(each) if "<|" in w or not _PLAIN.fullmatch(w)]
            slow = {i: np.asarray(e.ids, np.uint32).tobytes() for i, e in zip(odd, self.full.encode_batch_fast([each[i] for i in odd], add_special_tokens=False), strict=True)}
            for i in odd:
                each[i] = ""
            joined = "\n".join(each)
        split = _RUNS.findall(joined.lower())
        if len(self.runs) > self.most_words:
            self.runs.clear()
        self.runs["\n"] = b""
        new = [r for r in set(split) if r not in self.runs]
        for a in range(0, len(new), 64_000):
            part = new[a : a + 64_000]
            batch = self.light.encode_batch_fast([" ".join(part[i : i + 64]) for i in range(0, len(part), 64)], add_special_tokens=False)
            got = np.concatenate([np.asarray(e.ids, np.uint32) for e in batch])
            cut = np.flatnonzero(self.last[got]) + 1
            if len(cut) != len(part) or cut[-1] != len(got):
                raise ValueError("the tokenizer does not mark word ends as expected")
            b = got.tobytes()
            self.runs.update(zip(part, (b[4 * x : 4 * y] for x, y in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)), strict=True))
        parts = list(map(self.runs.__getitem__, split))
        ends = np.fromiter((r == "\n" for r in split), bool, len(split))
        cum = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)])
        lengths = np.diff(cum[np.concatenate([[0], np.flatnonzero(ends), [len(split)]])])
        ids = np.frombuffer(b"".join(parts), np.uint32)
        if slow:
            at, start = lengths.copy(), np.cumsum(lengths) - lengths
            at[list(slow)] = [len(x) // 4 for x in slow.values()]
            ids = np.insert(ids, np.repeat(start[list(slow)], at[list(slow)]), np.frombuffer(b"".join(slow.values()), np.uint32))
            lengths = at
        return ids, lengths

    def encode(self, texts: pa.Array) -> Pair:
        """(ids of all texts, first id of each text and the total)."""
        parts, ends, total = [], [np.zeros(1, np.int64)], 0
        for a, b in slices(texts):
            ids, first = self._slice(texts[a:b])
            parts.append(ids)
            ends.append(first[1:] + total)
            total += len(ids)
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), np.concatenate(ends)

    def _slice(self, texts: pa.Array) -> Pair:
        if not self.by_word:
            got = self.full.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)
            return np.concatenate([np.asarray(e.ids, np.uint32) for e in got]), np.concatenate([[0], np.cumsum([len(e.ids) for e in got])])
        if self.n > self.most_words or self.filled > self.most_ids:
            self._clear()
        h, starts, ends, first, data = words(texts)
        if not len(h):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        entry = self._find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            at = missing[at]
            whole = data.tobytes()
            self._learn(new, [whole[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            entry[missing] = self._find(h[missing])
        lengths = self.length[entry]
        cum = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.start[entry] - cum[:-1], lengths) + np.arange(cum[-1])]
        return ids, cum[first]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table a worker process and file; workers are reused by Spark, and so is the table."""
    return WordIds(path)
