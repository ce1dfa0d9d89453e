"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, encoded once with offsets, and the sorted spans of the turns to learn from are
intersected with the sorted token spans by binary search. The template's control strings are special tokens, so no token
straddles the border of a turn and the mask is exact. Control strings inside texts and roles are escaped by a
backslash after their first character (one more, where there are some), and unescaped by taking it out.

Tokens of a byte-level vocabulary in merge order are runs of the text's bytes, so its offsets are running sums of the
tokens' lengths, counted in characters: the ids come from the rank encoder, the offsets from numpy. Another kind of
tokenizer, and a text whose runs of blanks exceed the rank encoder's pattern engine, gives its own offsets; both ways
agree where both work.

A conversation becomes one row, as the format asks for; what a task holds is bounded by its longest conversation.

Defined cases: null text or role is empty; turns are ordered by turn (null first), then role and text; equal rows are turns
of their own; rows without conv_id are one conversation with a null conv_id; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, MIDDLE, END = "[INST]", "[/INST]", "</s>"
CONTROLS = (START, MIDDLE, END, "<s>")
_CONTROL = re.compile(r"(\[)(\\*)(/?INST\])|(<)(\\*)(/?s>)")
_ESCAPED = re.compile(r"(\[|<)\\(\\*(?:/?INST\]|/?s>))")
# The fixed splitting pattern of byte-level vocabularies.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


class Coder:
    """Ids and character offsets by the tokenizer of a file, the control strings being tokens of their own."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.add_special_tokens(list(CONTROLS))
        with open(path, encoding="utf-8") as f:
            self.ranked = self._ranked(json.load(f))

    def _ranked(self, spec: dict):  # noqa: ANN202
        """The rank encoder, if the file describes one: byte-level, plain, with ids in the order of the merges."""
        import tiktoken

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True):
            return None
        if spec.get("normalizer") or spec.get("post_processor") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        vocab = model["vocab"]
        order = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        special = {t.content: i for i, t in self.full.get_added_tokens_decoder().items()}
        letters = _byte_letters()
        pieces = {k: i for k, i in vocab.items() if k not in special}
        if order != list(range(256, 256 + len(order))) or len(pieces) != 256 + len(order) or any(t.lstrip or t.rstrip or t.single_word for t in self.full.get_added_tokens_decoder().values()):
            return None
        ranks = {bytes(letters[c] for c in k): i for k, i in pieces.items()}
        self.length = np.zeros(self.full.get_vocab_size(), np.int64)
        for k, i in (*ranks.items(), *((k.encode("utf-8"), i) for k, i in special.items())):
            self.length[i] = len(k)
        return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, spans in characters)."""
        if self.ranked is not None:
            try:
                ids = self.ranked.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # the pattern engine's stack; the other encoder has none
                pass
            else:
                return ids.astype(np.int32), self._spans(text, ids)
        e = self.full.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.int32), np.array(e.offsets, np.int64).reshape(-1, 2)

    def _spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """A token that starts or ends within a character has all of it."""
        ends = np.cumsum(self.length[ids])
        starts = ends - self.length[ids]
        if not text.isascii():
            first = np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0 != 0x80
            before = np.concatenate([[0], np.cumsum(first)])
            starts, ends = before[starts + 1] - 1, before[ends]
        return np.stack([starts, ends], axis=1)


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}


@lru_cache(maxsize=2)
def _coder(path: str) -> Coder:
    return Coder(path)


def render(turns: list[dict], learn: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """(the conversation, the spans of the texts to learn from)."""
    parts, spans, at = [], [], 0
    for t in turns:
        head = f"{START}{escape(t['role'] or '')}{MIDDLE}"
        text = escape(t["text"] or "")
        if (t["role"] or "") in learn:
            spans.append((at + len(head), at + len(head) + len(text)))
        parts.append(f"{head}{text}{END}")
        at += len(parts[-1])
    return "".join(parts), spans


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for the tokens that lie in a span; both are sorted, so two binary searches a span find them."""
    out = np.zeros(len(offsets), np.int8)
    if len(offsets) and spans:
        s = np.array(spans)
        first = np.searchsorted(offsets[:, 1], s[:, 0], "right")
        last = np.searchsorted(offsets[:, 0], s[:, 1], "left")
        for a, b, (x, y) in zip(first.tolist(), last.tolist(), spans, strict=True):
            if y > x:
                out[a:b] = 1
    return out


def format_chats(conversations: DataFrame, path: str, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, ids, starts, ends, mask), one row a conversation."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    wanted = frozenset(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for big in batches:
            for a in range(0, len(big), 100):
                b = big.slice(a, 100)
                made = [render(t, wanted) for t in b.column(1).to_pylist()]
                columns: list[list] = [[], [], [], []]
                for text, spans in made:
                    ids, offsets = coder.encode(text)
                    for c, x in zip(columns, (ids, offsets[:, 0], offsets[:, 1], mask(offsets, spans)), strict=True):
                        c.append(x)
                first = pa.array(np.cumsum([0, *map(len, columns[0])]), pa.int32())
                arrays = [pa.ListArray.from_arrays(first, pa.array(np.concatenate(c), t)) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int8()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), *arrays], ["conv_id", "formatted", "ids", "starts", "ends", "mask"])

    return whole.mapInArrow(run, "conv_id long, formatted string, ids array<int>, starts array<long>, ends array<long>, mask array<tinyint>")


def learned(text: str, starts: np.ndarray, ends: np.ndarray, flags: np.ndarray) -> list[str]:
    """The texts under the mask, unescaped, one for each run of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
    return [unescape(text[starts[a] : ends[b - 1]]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def read_back(formatted: DataFrame) -> DataFrame:
    """The digests of what the formatted rows say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, text in enumerate(b.column(1).to_pylist()):
                turns = [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]
                starts, ends, flags = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3, 4))
                loss = "".join(learned(text, starts, ends, flags))
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                for c, x in zip(rows, (len(turns), digest, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)), strict=True):
                    c.append(x)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "starts", "ends", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are full of control strings, formatted and read back."""
    import public_tokenizers

    own = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(regexp_replace(role || chr(0) || text, '(\[)(\\*/?INST\])', '\1\\\2', 'g'), '(<)(\\*/?s>)', '\1\\\2', 'g')) - 1 + 17 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
