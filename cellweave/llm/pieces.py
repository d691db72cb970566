"""Exact SentencePiece BPE encoding by backtracking, and decoding.

The exact result merges, of all neighbouring symbols whose union is a piece, the pair of best score, leftmost
first, until none is left. A sequence of pieces is that result exactly when each piece merges to itself and each pair
of neighbours merges to itself, because merges in one stretch do not depend on other stretches. So the text is
covered greedily: at each position the longest piece (Aho-Corasick) that is compatible with the piece before it, where
compatibility is tested by merging the two pieces' joined text; where no piece fits, the position is marked
as failed in a bit field and the piece before it is shortened. Each position fails once at most.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, only, shipped

SPACE = "▁"
#: Stretches longer than this are not remembered.
_LONG = 64
_BATCH = 2000
#: Stretches that a worker process remembers at most: memory for time, no result depends on it. Jobs whose executors hold
#: much else besides can ask for fewer.
REMEMBERED = 600_000


class PieceEncoder:
    """Encodes with the pieces and scores of a SentencePiece BPE model with byte fallback and identity normalization."""

    def __init__(self, path: str, most: int = REMEMBERED):
        import ahocorasick
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        own = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in own}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in own}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        automaton = ahocorasick.Automaton()
        for piece in self.ids:
            automaton.add_word(piece, len(piece))
        automaton.make_automaton()
        self._automaton = automaton
        # where no piece holds a line feed, and none a space mark after another character, texts may be cut there
        self._by_line = not any("\n" in p for p in self.ids)
        self._by_space = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._whole = Remembered(lambda p: self.merged(p) == [p], 100_000, "pieces")
        self._fits = Remembered(lambda ab: self.merged(ab[0] + ab[1]) == [*ab], most * 2 // 3, "pieces")
        self._spaced = Remembered(lambda part: self._encoded(SPACE + part), most, "pieces")
        self._plain = Remembered(self._encoded, most // 4, "pieces")

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by plain merging."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def backtracked(self, text: str) -> list[str]:
        """The same pieces, by longest matches, compatibility and backtracking; time in proportion to the text."""
        n = len(text)
        # lengths of the pieces that start at each position, longest last; a single character always can stand alone
        starts: list[list[int]] = [[1] for _ in range(n)]
        for end, length in self._automaton.iter(text):
            if length > 1:
                starts[end - length + 1].append(length)
        fits, whole = self._fits, self._whole
        failed = bytearray(n + 1)
        chosen: list[str] = []
        options: list[list[int]] = []
        at = 0
        left = starts[0] if n else []
        while at < n:
            last = chosen[-1] if chosen else None
            while left:
                length = left.pop()
                end = at + length
                piece = text[at:end]
                if not failed[end] and (length == 1 or whole[piece]) and (last is None or fits[last, piece]):
                    chosen.append(piece)
                    options.append(left)
                    at = end
                    left = starts[at] if at < n else []
                    break
            else:
                failed[at] = 1
                at -= len(chosen.pop())
                left = options.pop()
        return chosen

    def _encoded(self, stretch: str) -> bytes:
        import numpy as np

        if stretch[-1:] in (",", ".") and 2 < len(stretch) <= _LONG and stretch[-2].isalpha():
            # a sequence of compatible neighbours is the result: extend that of the word by the stop, if it fits
            found = self.backtracked(stretch[:-1])
            found = [*found, stretch[-1]] if self._fits[found[-1], stretch[-1]] else self.backtracked(stretch)
        else:
            found = self.backtracked(stretch)
        out: list[int] = []
        for piece in found:
            known = self.ids.get(piece)
            out += [known] if known is not None else [self.bytes[b] for b in piece.encode()]
        return np.array(out, self.kind).tobytes()

    def _run(self, memory: Remembered, parts: list[str]) -> bytes:
        if max(map(len, parts), default=0) <= _LONG:
            return b"".join(map(memory.__getitem__, parts))
        lead = SPACE if memory is self._spaced else ""
        return b"".join(memory[p] if len(p) <= _LONG else self._encoded(lead + p) for p in parts)

    def encode(self, text: str):
        """u4 array of the ids of a whole text, with begin and end ids."""
        import re

        import numpy as np

        out = [np.array([self.bos], self.kind).tobytes()]
        if text:
            feed = np.array([self.bytes[10]], self.kind).tobytes()
            marked = SPACE + text.replace(" ", SPACE)
            for i, line in enumerate(marked.split("\n") if self._by_line else [marked]):
                if i:
                    out.append(feed)
                if not self._by_space:
                    out.append(self._encoded(line))
                elif SPACE + SPACE in line:
                    out.append(self._run(self._plain, re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line)))
                elif line:
                    head, *rest = line.split(SPACE)
                    if head:
                        out.append(self._run(self._plain, [head]))
                    out.append(self._run(self._spaced, rest))
        out.append(np.array([self.eos], self.kind).tobytes())
        return np.frombuffer(b"".join(out), self.kind).astype("<u4")

    def decode(self, ids) -> str:
        return self.processor.decode(ids.tolist())


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def piece_encoder(path: str, most: int = REMEMBERED) -> PieceEncoder:
    """One encoder for each worker process, model file and size of memory."""
    if (path, most) not in _encoders:
        _encoders[path, most] = PieceEncoder(path, most)
    return _encoders[path, most]


def default_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(batches, path: str, ids_too: bool, most: int):
    import pyarrow as pa

    only("pieces")
    enc = piece_encoder(path, most)
    for big in batches:
        for at in range(0, big.num_rows, _BATCH):
            batch = big.slice(at, _BATCH)
            n, ids_hash, text_hash, ids_out = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = enc.encode(text or "")
                n.append(len(ids))
                raw = ids.tobytes()
                ids_hash.append(hashlib.sha256(raw).hexdigest())
                text_hash.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                ids_out.append(raw)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids_too:
                columns, names = [*columns, pa.array(ids_out, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)


def sentence_pieces(documents: DataFrame, path: str | None = None, ids_too: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian u32).

    Whole texts with begin and end ids; a null or empty text has just these two and decodes to ''. No row meets another: no
    shuffle, any skew is harmless, and a task that runs again gives the same rows. Repeated rows are each encoded;
    null doc_ids are kept; an empty table gives no rows.
    """
    path = path or default_model()
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids_too
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shipped(docs).mapInArrow(lambda batches: _encode(batches, path, ids_too, remembered), schema)
