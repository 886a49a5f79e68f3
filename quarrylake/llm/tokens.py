"""Operator 3, token counts: chunks of huge documents are encoded with offsets and spliced where both sides provably agree.

The splitting pattern of byte-level BPE vocabularies (files that name a byte-level splitter and no normaliser) never makes a piece that runs from a non-space into a following white space,
or from a letter into a following ASCII mark or digit, and looks at nothing to the left of a piece. So such places are boundaries
of pieces whatever surrounds them. Added special tokens hold no white space and start with a mark, and a run that starts with a
mark goes on to the next white space, so no run ends inside one. A chunk is encoded as runs between such places, each with its
offset and its number of tokens. Two overlapping chunks are spliced at a boundary that both have with AGREE equal runs on either
side; if there is none, the overlap is doubled, up to the whole document.

Numbers of tokens come from the library alone. They are kept by run in a bounded table, since words repeat; runs beyond its bound
are encoded each time.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import _text
from quarrylake.llm._work import ship

CHUNK = 1 << 16
OVERLAP = 1 << 10
AGREE = 2
KEPT_RUNS = 1_000_000
KEPT_LENGTH = 48
LIMIT = 512

# White space of the splitting pattern: Python's, without the four separators 0x1C-0x1F that only Python counts as such.
_WHITE, _OTHER, _LETTER, _MARK = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]", "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", r"[\x21-\x40\x5b-\x60\x7b-\x7e]"
_RUN = re.compile(rf"{_WHITE}*(?:{_LETTER}+(?={_MARK})|{_OTHER}+)|{_WHITE}+")


def provable(path: str) -> bool:
    """Whether a tokenizer's file has the byte-level splitter, without normaliser, whose boundaries are proven above. Texts of others are
    encoded whole."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", False)


class RunEncoder:
    """Counts tokens of runs with a library tokenizer."""

    def __init__(self, path: str):
        self.path, self.known = path, {}
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.library = t
            self.split = provable(path)
            self.encode = lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            t = sentencepiece.SentencePieceProcessor(model_file=path)
            self.split = False  # its pieces depend on more than the run
            self.encode = lambda texts: [len(x) for x in t.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no library for {path}")

    def learn(self, runs: set[str]) -> dict[str, int]:
        new = [r for r in runs if r not in self.known]
        got = dict(zip(new, self.encode(new), strict=True)) if new else {}
        if len(self.known) < KEPT_RUNS:
            self.known.update((k, v) for k, v in got.items() if len(k) <= KEPT_LENGTH)
        return got

    def count(self, text: str) -> int:
        """Tokens of a text of no more than a chunk."""
        if not self.split:
            return self.encode([text])[0]
        runs = _RUN.findall(text)
        try:
            return sum(map(self.known.__getitem__, runs))
        except KeyError:
            got = self.learn(set(runs))
            have = self.known
            return sum(have[r] if r in have else got[r] if r in got else self.encode([r])[0] for r in runs)

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(start, tokens) of each run of a chunk: the library encodes the chunk and says where its tokens start."""
        runs = _RUN.findall(text)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])[:-1]]).astype(np.int64)
        at = np.array([a for a, _ in self.library.encode(text, add_special_tokens=False).offsets], np.int64)
        at = np.maximum.accumulate(at)  # white space is trimmed off offsets, which never takes a token's start out of its run
        first = np.searchsorted(at, starts)
        first[0] = 0
        return starts, np.diff(np.append(first, len(at)))

    def count_long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a text of any length, by overlapping chunks."""
        if not self.split or len(text) <= chunk:
            return self.count(text)
        starts, n = self.offsets(text[:chunk])
        total, at = 0, 0  # tokens of what is spliced; the place in the text where the open chunk begins
        open_end = min(chunk, len(text))
        while open_end < len(text):
            lap = overlap
            while True:
                begin = max(at, open_end - lap)
                end = min(len(text), begin + max(chunk, 2 * lap))
                nxt, m = self.offsets(text[begin:end])
                cut = splice(starts + at, n, nxt + begin, m)
                if cut is not None:
                    i, j = cut
                    total += int(n[:i].sum())
                    starts, n, at, open_end = nxt[j:] + begin, m[j:], int(nxt[j] + begin), end
                    starts = starts - at
                    break
                if begin == at and end == len(text):
                    starts, n, open_end = nxt, m, end
                    break
                lap *= 2
        return total + int(n.sum())


def splice(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, agree: int = AGREE) -> tuple[int, int] | None:
    """Indices (i, j) of a common run start with `agree` equal whole runs before and after it in both chunks, or None.

    The runs at a chunk's edges may be cut, so the first run of b and the last of either never count as equal.
    """
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if x < agree or y <= agree or x + agree >= len(a) or y + agree >= len(b):
            continue
        if all(a[x + d] == b[y + d] and n[x + d] == m[y + d] for d in range(-agree, agree)):
            return x, y
    return None


@lru_cache(maxsize=2)
def encoder(path: str) -> RunEncoder:
    return RunEncoder(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """For each row of docs: doc_id, n_bytes (UTF-8), n_tokens of the whole text, over_limit (n_tokens > limit).

    path: the vocabulary file, the same on every executor; by default byte_bpe_50k.json. Without begin, end or added special
    tokens, truncation or padding. Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. Empty table: no
    rows. Other columns are not read; memory grows with the longest text, not with its tokens.
    """
    ship(docs.sparkSession)
    path = path or vocabulary()

    def run(batches):
        e = encoder(path)
        for batch in batches:
            for b in _text.blocks(batch):
                _, offs = _text.bytes_of(b.column(1))
                n = [0 if not t else e.count(t) if len(t) <= chunk else e.count_long(t, chunk, overlap) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
