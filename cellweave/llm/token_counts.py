"""Token counts by section: whole documents are encoded once, and tokens are attributed by their character spans.

The spans are joined to the sections' intervals by binary search. A token that crosses a boundary goes to one section by an
explicit rule: ``first`` (the section of its first character) or ``most`` (the section with most of its characters, ties
to the earlier), so the sections' counts always add up to the document's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped
from .tokens import default_path, encoder

RULES = ("first", "most")


def line_starts(text: str):
    """Starts of the lines of a text; a line holds its line feed, and what follows the last one is a line if not empty."""
    import numpy as np

    feeds = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    return np.concatenate(([0], feeds[feeds < len(text)]))


def attributed(spans, starts, rule: str = "first"):
    """(section of each token, number of tokens that cross a boundary); ``starts`` ascends from 0."""
    import numpy as np

    first = np.searchsorted(starts, spans[:, 0], "right") - 1
    last = np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1
    section = first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        for t in crossing.tolist():
            a, b = spans[t]
            edges = np.concatenate(([a], starts[first[t] + 1 : last[t] + 1], [b]))
            section[t] = first[t] + int(np.argmax(np.diff(edges)))
    return section, len(crossing)


def _count(batches, path: str, rule: str):
    import numpy as np
    import pyarrow as pa

    enc = encoder(path)
    for big in batches:
        for at in range(0, big.num_rows, 2000):
            batch = big.slice(at, 2000)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            total, sections, crossing, counts = [], [], [], []
            for text, spans in zip(texts, enc.spans(texts)):
                starts = line_starts(text)
                section, crossed = attributed(spans, starts, rule)
                total.append(len(spans))
                sections.append(len(starts))
                crossing.append(crossed)
                counts.append(np.bincount(section, minlength=len(starts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (total, sections, crossing)], pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
            )


def token_counts(documents: DataFrame, path: str | None = None, rule: str = "first") -> DataFrame:
    """One row per document row: doc_id, n_tokens, n_sections (its lines), n_crossing and section_tokens, a count by section.

    Whole texts, no end id. A null or empty text is one section without tokens. Repeated rows are counted each; null
    doc_ids are kept; an empty table gives no rows. No row meets another, so there is no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or default_path()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<bigint>"
    return shipped(docs).mapInArrow(lambda batches: _count(batches, path, rule), schema)
