"""Token counts of whole columns (operator 3), and the library encoder that packing uses.

Arrow tasks return lengths only. Texts are split at safe boundaries and the parts encoded by
the tokenizer library in batches of about equal bytes: for byte-level BPE the safe boundaries
are those between pre-tokens, and each distinct pre-token of a chunk is encoded once; other
tokenizers get texts cut before a single space between non-blanks, where they allow it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, text_bytes, tidy
from .pretokens import Vocabulary, flat_ids, resolve

REMEMBERED = 1_000_000  # pieces that a worker keeps; beyond it the memory is emptied and filled anew
BATCH = 1 << 16  # bytes given to the library at once


def is_byte_level(spec: dict) -> bool:
    """Whether the tokenizer's pieces are those of pretokens.pieces and nothing changes texts before."""
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not x.get(k) for x in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    return pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and not spec.get("normalizer") and plain and len(spec.get("added_tokens", [])) <= 1


class Library:
    """The tokenizers library behind the first-tier table; encodes chunks in one worker."""

    def __init__(self, text: str, vocabulary: Vocabulary, lengths_only: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.vocabulary, self.lengths_only = Tokenizer.from_str(text), vocabulary, lengths_only
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = json.loads(text).get("added_tokens") or [{}]
        self.special, self.memory = added[0].get("content", "").encode() or None, {}

    def second(self, todo: list[bytes]) -> list:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new = [x for x in todo if x not in self.memory]
        done: dict[bytes, object] = {}
        i = 0
        while i < len(new):
            j, size = i, 0
            while j < len(new) and (j == i or size + len(new[j]) <= BATCH):
                size += len(new[j])
                j += 1
            got = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in new[i:j]], add_special_tokens=False)
            done.update(zip(new[i:j], (len(x) if self.lengths_only else np.array(x.ids, np.int32).tobytes() for x in got), strict=True))
            i = j
        self.memory.update((k, v) for k, v in done.items() if len(k) <= 64)
        return [done[x] if x in done else self.memory[x] for x in todo]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids before each text)."""
        ids, which, missed, before = resolve(buf, offsets, self.vocabulary, self.second, self.special)
        return flat_ids(ids, which, missed, before)

    def count(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, which, missed, before = resolve(buf, offsets, self.vocabulary, self.second, self.special)
        sizes = np.ones(len(ids), np.int64)
        miss = ids < 0
        sizes[miss] = np.array([*missed, 0], np.int64)[which[miss]]
        done = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(done[before])


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


def json_vocabulary(text: str) -> Vocabulary:
    """First tier for a byte-level .json tokenizer: the entries that the library gives back as one token."""
    from tokenizers import Tokenizer

    spec, names = json.loads(text), byte_names()
    special = {x["content"] for x in spec.get("added_tokens", [])}
    entries = {}
    for k, v in spec["model"]["vocab"].items():
        if k not in special and all(c in names for c in k):
            entries[bytes(names[c] for c in k)] = v
    whole = [(k, v) for k, v in entries.items() if len(k) <= 24 and _valid(k)]
    got = Tokenizer.from_str(text).encode_batch_fast([k.decode() for k, _ in whole], add_special_tokens=False)
    return Vocabulary({k: v for (k, v), x in zip(whole, got, strict=True) if x.ids == [v]})


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def safe_cuts(text: str, size: int) -> list[str]:
    """Parts of about ``size`` characters, cut before a single space that stands between letters."""
    out, i = [], 0
    while len(text) - i > size:
        j = i + size
        while (j := text.find(" ", j)) > 0 and not (text[j - 1].isalpha() and text[j + 1 : j + 2].isalpha()):
            j += 1
        if j < 0:
            break
        out.append(text[i:j])
        i = j
    return [*out, text[i:]]


def token_counts(df: DataFrame, path: str, limit: int = 512, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``keep``, n_bytes (UTF-8), n_tokens under the tokenizer file at ``path``, over_limit (n_tokens > limit).

    ``.json`` files are for tokenizers, ``.model`` files for sentencepiece; no begin, end or added
    special tokens, no truncation or padding. A null text counts as empty (0, 0). No shuffle; a
    task's memory is a few times CHUNK, or its longest text. A column to keep that has the name of a
    count gives way to it; equal rows are counted each.
    """
    kept = [k for k in keep if k not in ("n_bytes", "n_tokens", "over_limit")]
    schema = df.select(*kept).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    df = df.select(*kept, F.col(text)).toDF(*[f"c{i}" for i in range(len(kept) + 1)])
    model = path.endswith(".model")
    with open(path, "rb") as f:
        raw = f.read()
    fast = not model and is_byte_level(json.loads(raw))
    shared = df.sparkSession.sparkContext.broadcast((raw, json_vocabulary(raw.decode()) if fast else None))  # a tokenizer file: of fixed size

    def counter():
        raw, vocabulary = shared.value
        if vocabulary is not None:
            return Library(raw.decode(), vocabulary, True).count
        if model:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
            return lambda buf, offsets: np.array([len(x) for x in sp.encode(_texts(buf, offsets), num_threads=1)], np.int64)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(raw.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        blank_free = (tokenizer.normalizer is None) or json.loads(raw).get("model", {}).get("end_of_word_suffix")

        def count(buf, offsets):
            parts = [safe_cuts(x, 20_000) if blank_free else [x] for x in _texts(buf, offsets)]
            got = iter(tokenizer.encode_batch_fast([p for x in parts for p in x], add_special_tokens=False))
            return np.array([sum(len(next(got)) for _ in x) for x in parts], np.int64)

        return count

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for batch in batches:
            buf, offsets = text_bytes(batch.columns[-1])
            got = [count(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
            n = np.concatenate([np.zeros(0, np.int64), *got])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], schema.names)

    return df.mapInArrow(run, schema)


def _texts(buf: np.ndarray, offsets: np.ndarray) -> list[str]:
    data, o = buf.tobytes(), offsets.tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(o, o[1:], strict=False)]
