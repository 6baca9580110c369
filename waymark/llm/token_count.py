"""Token counts of a SentencePiece byte-pair model, by merging with a heap and a linked list.

The text becomes symbols (characters, blanks as U+2581, one of them in front).  The adjacent pair whose
union has the lowest rank in the vocabulary is merged again and again; the count is the number of symbols
less the number of merges, and a character that the vocabulary lacks counts as its bytes.  No identifiers
are made.  Merging is done unit by unit: a text is cut between two characters wherever no piece of the
vocabulary has them side by side (pairs of all characters of all pieces), which cannot change the result as
no merge reaches over such a place, and the counts of short units are remembered (bounded).

Defined results: null and empty texts have no tokens and no bytes; repeated rows give a row each; an empty
table gives an empty result; texts of any length are counted whole; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
#: Units longer than this are counted anew each time; at most so many shorter ones are remembered by a worker.
REMEMBERED_CHARS, REMEMBERED_UNITS = 40, 1_000_000


class Counter(dict):
    """Unit of text to number of tokens."""

    def __init__(self, model_bytes: bytes):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.rank = {piece: int(-model.get_score(i)) for i in plain for piece in (model.id_to_piece(i),)}
        if any(BLANK in piece.lstrip(BLANK) for piece in self.rank):
            raise ValueError("this vocabulary joins words; texts can't be cut at blanks")
        self.joined = {pair for piece in self.rank for pair in zip(piece, piece[1:], strict=False)}
        sides = {c for pair in self.joined for c in pair}
        lone = re.escape("".join(c for c in map(chr, range(128)) if c not in sides)) or BLANK
        self.units = re.compile(rf"{BLANK}*[^{BLANK}{lone}]+|{BLANK}+|[{lone}]", re.DOTALL).findall

    def __missing__(self, unit: str) -> int:
        parts = self.parts(unit)
        n = self.merge(unit) if len(parts) == 1 else sum(map(self.__getitem__, parts))
        if len(unit) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED_UNITS:
                self.clear()
            self[unit] = n
        return n

    def parts(self, unit: str) -> list[str]:
        """The unit, cut between all characters that stand side by side in no piece."""
        cuts = [i for i, pair in enumerate(zip(unit, unit[1:], strict=False), 1) if pair not in self.joined]
        return [unit[i:j] for i, j in zip([0, *cuts], [*cuts, len(unit)], strict=True)]

    def merge(self, unit: str) -> int:
        """Heap entries are rank and place in one integer; `ranks` has what each place's pair ranks now, so older entries show."""
        rank, symbols = self.rank.get, list(unit)
        n = count = len(symbols)
        ranks = [rank(a + b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
        ranks.append(-1)
        heap = [r * n + i for i, r in enumerate(ranks) if r >= 0]
        heapify(heap)
        left, right = list(range(-1, n)), list(range(1, n + 1))
        while heap:
            r, i = divmod(heappop(heap), n)
            if ranks[i] != r:
                continue
            j = right[i]
            symbols[i] = pair = symbols[i] + symbols[j]
            symbols[j], ranks[j] = "", -1
            count -= 1
            after, before = right[j], left[i]
            right[i], left[after] = after, i
            ranks[i] = r = rank(pair + symbols[after], -1) if after < n else -1
            if r >= 0:
                heappush(heap, r * n + i)
            if before >= 0:
                ranks[before] = r = rank(symbols[before] + pair, -1)
                if r >= 0:
                    heappush(heap, r * n + before)
        return count + sum(len(x.encode()) - 1 for x in symbols if x and x not in self.rank)

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.units(BLANK + text.replace(" ", BLANK)))) if text else 0


_loaded: dict[bytes, Counter] = {}


def counter(model_bytes: bytes) -> Counter:
    key = hashlib.sha256(model_bytes).digest()
    if key not in _loaded:
        _loaded[key] = Counter(model_bytes)
    return _loaded[key]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; the driver reads model_file and hands its bytes to the tasks."""
    model = docs.sparkSession.sparkContext.broadcast(Path(model_file).read_bytes())  # a vocabulary, no data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model.value).count
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            tokens = [count(x) for x in texts]
            made = [pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    base = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return base.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
