"""Exact byte-level BPE encoding of whole texts with the tokenizers library, remembering repeated stretches.

Pre-tokenization splits at every boundary between a non-blank and a following blank, and a run of one or two blanks
before a non-blank splits into single ones, so such texts may be cut before each space and line feed and the stretches
encoded apart. It also splits between a letter and a following comma or full stop. Each different stretch is
encoded once by the library, in batches; texts with other runs of blanks or special tokens are encoded whole.
"""

from __future__ import annotations

import os
import re

from .common import memories, only

#: Runs of blanks that do not split into single ones.
_UNSAFE = re.compile(r"\s{3}|\s\s\Z")
_RUNS = ("\n\n", "  ", " \n", "\n ")
#: Characters of text handled at a time, to bound memory whatever the batch holds.
_CHUNK = 2_000_000


class _Memory(dict):
    """Values by stretch; a lookup of an unknown stretch notes it as wanted."""

    def __init__(self):
        super().__init__()
        self.wanted: set[str] = set()

    def __missing__(self, key):
        self.wanted.add(key)
        return b""


class Encoder:
    """Ids, or the character spans of tokens, for many texts; both as bytes of little-endian numbers."""

    def __init__(self, path: str, most: int = 1_600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the library's own cache cannot help: it sees each stretch once
        getattr(self.tokenizer.model, "_resize_cache", lambda size: None)(0)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.most = most
        self._specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self._leads = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
        self._leads[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self._ids_of, self._spans_of = _Memory(), _Memory()
        memories("tokens").extend((self._ids_of, self._spans_of))

    def _batch_ids(self, stretches: list[str]) -> list[bytes]:
        """Stretches that are a space and then none are encoded as one text; ids that begin with a space part them."""
        import numpy as np

        joint = [s for s in stretches if s[:1] == " " and len(s) > 1 and s.isprintable() and " " not in s[1:]]
        if len(joint) < len(stretches) or not joint:
            rest = [s for s in stretches if not (s[:1] == " " and len(s) > 1 and s.isprintable() and " " not in s[1:])]
            kind = f"<u{self.width}"
            found = dict(zip(rest, (np.array(e.ids, kind).tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
        else:
            found = {}
        if joint:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(joint)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            cuts = [*(np.flatnonzero(self._leads[ids]) * self.width).tolist(), len(ids) * self.width]
            raw = ids.tobytes()
            if len(cuts) != len(joint) + 1:
                raise ValueError("ids do not part at spaces")
            found.update(zip(joint, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        return [found[s] for s in stretches]

    def _batch_spans(self, stretches: list[str]) -> list[bytes]:
        from array import array

        return [array("i", [x for span in e.offsets for x in span]).tobytes() for e in self.tokenizer.encode_batch(stretches, add_special_tokens=False)]

    def _parts(self, text: str) -> list[str] | None:
        """The text cut before each space (which is left out) and line feed; None where it must be encoded whole."""
        if any(s in text for s in self._specials):
            return None
        plain = text.replace("\n", "").isprintable()  # no blanks but spaces and line feeds
        if (not plain or any(r in text for r in _RUNS)) and _UNSAFE.search(text):
            return None
        return (" " + text).replace("\n", " \n").split(" ")[1:] if text[:1] not in (" ", "\n") else None

    @staticmethod
    def _stretch(part: str) -> str:
        return part if part[:1] == "\n" else " " + part

    def _fill(self, memory: _Memory, batch, compose) -> None:
        wanted, memory.wanted = memory.wanted, set()
        stops = [p for p in wanted if len(p) > 1 and p[-1] in ",." and p[-2].isalpha()]
        plain = list({p[:-1] for p in stops if p[:-1] not in memory} | wanted.difference(stops))
        memory.update(zip(plain, batch([self._stretch(p) for p in plain])))
        for p in stops:
            memory[p] = compose(memory[p[:-1]], p)

    def _many(self, texts: list[str], memory: _Memory, batch, compose):
        """For each text its first part's value, the other parts and their values; None and the whole's value."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _CHUNK):
                size += len(texts[end])
                end += 1
            if len(memory) > self.most:
                memory.clear()
            cut = [self._parts(t) for t in texts[at:end]]
            values = [list(map(memory.__getitem__, parts[1:])) if parts else [] for parts in cut]
            self._fill(memory, batch, compose)
            heads = batch([p[0] if p else t for p, t in zip(cut, texts[at:end])])
            for parts, head, rest in zip(cut, heads, values):
                if b"" in rest:  # no stretch is without tokens: these were unknown
                    rest = [v or memory[p] for v, p in zip(rest, parts[1:])]
                yield parts, head, rest
            at = end

    def ids(self, texts: list[str]):
        """Yields for each text its ids, ``width`` bytes each."""
        ends = {c: self._batch_ids([c])[0] for c in ",."}
        for _, head, rest in self._many(texts, self._ids_of, self._batch_ids, lambda word, part: word + ends[part[-1]]):
            yield head + b"".join(rest)

    def spans(self, texts: list[str]):
        """Yields for each text an int64 array (tokens, 2): the first character of each token and the one after its last."""
        import numpy as np

        def with_stop(word: bytes, part: str) -> bytes:
            end = len(self._stretch(part))
            return word + np.array([end - 1, end], "<i4").tobytes()

        for parts, head, rest in self._many(texts, self._spans_of, self._batch_spans, with_stop):
            found = np.frombuffer(head + b"".join(rest), "<i4").astype("i8").reshape(-1, 2)
            if rest:
                lengths = np.fromiter((len(p) + (p[:1] != "\n") for p in parts[1:]), "i8", len(rest))
                bases = np.concatenate(([0], len(parts[0]) + np.cumsum(lengths) - lengths))
                counts = np.fromiter((len(v) for v in [head, *rest]), "i8", len(rest) + 1) // 8
                found = found + np.repeat(bases, counts)[:, None]
            yield found


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    only("tokens")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
