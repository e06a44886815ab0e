"""Token counts by prefix dynamic programming, for a SentencePiece BPE model.

No piece of the model goes across the start of a run of spaces, so BPE never merges across it:
a text falls into chunks (a run of spaces and what follows up to the next), whose token counts add up.
Inside a chunk the tokens of a prefix are those of the prefix before its last token, and that token.
The last token is the one piece that ends the prefix and that BPE leaves apart from the last token
before it (`Counts._apart`), so a pass over the chunk gives the exact count at each of its prefixes.

The table of every text holds the count at every prefix: n_tokens is its last entry, and how far a text
goes within a budget, or how many tokens a cut has, is read off without encoding again.

If a model doesn't have these properties (they are checked when it is loaded), whole prefixes are encoded.

Defined cases: a null text is empty; the empty text has 0 bytes and tokens; equal texts
have equal counts; texts of any length are counted whole, with or without spaces; columns other than doc_id and text are not
read; ids may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Chunks (and prefixes of chunks) whose counts a worker remembers, the longest chunk it remembers, and the pairs of pieces it remembers.
MEMO, LONG_CHUNK, PAIRS = 400_000, 64, 500_000
SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")

_loaded: dict[str, Counts] = {}


class Counts(dict):
    """chunk -> its counts (32 bits each) at its prefixes of 1, 2, ... characters."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.scores = {p: self.model.get_score(i) for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.tails = {p[i:] for p in self.scores for i in range(len(p))}
        #: prefix of a chunk -> its count and last piece
        self.states: dict[str, tuple[int, str]] = {}
        #: Characters that aren't pieces are spelled in bytes.
        self.bytes = any(map(self.model.is_byte, range(len(pieces))))
        probe = "a  b　ﬁ c "
        # pieces must not hold a space after another character, and the text must be taken as it is, after one added space
        self.chunks = not any(SPACE in p.lstrip(SPACE) for p in self.scores) and SPACE in pieces and sum(self.model.encode(probe, out_type=str) == x for x in [self._split(probe)]) == 1
        # the model must merge by score alone: compared on a long chunk of its own pieces and of characters that aren't
        probe = SPACE + "".join(p.replace(SPACE, "") + "\U0001f9ff" * (i % 50 == 0) for i, p in enumerate([*self.scores][::37]))
        self.merges = self.bytes and self._passed(probe)[-1] == len(self.model.encode(probe[1:]))

    def _split(self, text: str) -> list[str]:
        return [p for c in CHUNK.findall(SPACE + text.replace(" ", SPACE)) for p in self._pieces(c)]

    def _pieces(self, chunk: str) -> list[str]:
        """Pieces of a chunk; the model itself adds the first of its spaces."""
        return self.model.encode(chunk[1:], out_type=str) if len(chunk) > 1 else [SPACE]

    def _apart(self, left: str, right: str) -> bool:
        """Whether BPE (the best score first, the leftmost of equals) makes the two pieces of the text of both."""
        if (found := self.pairs.get((left, right))) is None:
            parts, score = [*left, *right], self.scores
            ranks = [score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            while ranks and (best := max(ranks)) > -np.inf:
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = score.get(parts[i - 1] + parts[i], -np.inf)
                if i < len(ranks):
                    ranks[i] = score.get(parts[i] + parts[i + 1], -np.inf)
            found = parts == ([left, right] if left else [right])
            if len(self.pairs) < PAIRS:
                self.pairs[left, right] = found
        return found

    def _passed(self, chunk: str) -> list[int]:
        """Counts at the chunk's prefixes of 1, 2, ... characters, each from a shorter one's."""
        known, tails, pairs, states = self.scores, self.tails, self.pairs, self.states
        done, found = 0, []
        for k in range(min(len(chunk) - 1, LONG_CHUNK), 0, -1):
            if (state := states.get(chunk[:k])) is not None:
                found.append(state)
                done = done or k
            elif done:  # forgotten, as the memory is bounded
                done, found = 0, []
        found.append((0, ""))
        found.reverse()
        for end in range(done + 1, len(chunk) + 1):
            c = piece = chunk[end - 1]
            count = found[end - 1][0] + (1 if c in known else len(c.encode()))
            at, ends = end - 2, []
            while at >= 0 and (p := chunk[at:end]) in tails:
                if p in known:
                    ends.append(p)
                at -= 1
            for p in reversed(ends):
                before, left = found[end - len(p)]
                apart = pairs.get((left, p))
                if apart or apart is None and self._apart(left, p):
                    piece, count = p, before + 1
                    break
            found.append((count, piece))
            if end <= LONG_CHUNK and len(states) < MEMO:
                states[chunk[:end]] = found[-1]
        return [n for n, _ in found[1:]]

    def __missing__(self, chunk: str) -> bytes:
        found = self._passed(chunk) if self.merges else [len(self._pieces(chunk[:i])) for i in range(1, len(chunk) + 1)]
        found = np.array(found, np.uint32).tobytes()
        if len(self) < MEMO and len(chunk) <= LONG_CHUNK:
            self[chunk] = found
        return found

    def prefixes(self, text: str | None) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..."""
        if not text:
            return np.zeros(1, np.int64)
        if not self.chunks:
            return np.array([len(self.model.encode(text[:i])) for i in range(len(text) + 1)])
        parts = CHUNK.findall(SPACE + text.replace(" ", SPACE))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.frombuffer(b"".join(map(self.__getitem__, parts)), np.uint32).astype(np.int64)
        own = out[np.cumsum(lengths) - 1]
        out += np.repeat(np.cumsum(own) - own, lengths)
        out[0] = 0  # the space before the text is no prefix of it
        return out


def counts(path: str) -> Counts:
    """The worker's table for a model file."""
    if path not in _loaded:
        _loaded[path] = Counts(path)
    return _loaded[path]


def tokens_at(path: str, text: str, chars: int) -> int:
    """Tokens of the first ``chars`` characters of a text."""
    return int(counts(path).prefixes(text)[min(chars, len(text))])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fits_chars of each row of ``docs`` (doc_id, text).

    fits_chars: characters of the longest prefix of at most ``limit`` tokens. With ``prefixes`` also
    prefix_tokens: the counts at all prefixes from 0 characters on.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts(path)
        for whole in batches:
            for b in slices(whole, "text", 256, 1 << 20):  # a count for each character is held
                texts = b.column("text").to_pylist()
                rows = [table.prefixes(t) for t in texts]
                n = [int(r[-1]) for r in rows]
                fits = [len(r) - 1 if k <= limit else int(np.flatnonzero(r <= limit)[-1]) for k, r in zip(n, rows, strict=True)]
                out = [b.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(fits, pa.int64())]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"]
                if prefixes:
                    out.append(pa.array(rows, pa.list_(pa.int64())))
                    names.append("prefix_tokens")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fits_chars bigint" + ", prefix_tokens array<bigint>" * prefixes
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, schema)
