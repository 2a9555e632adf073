"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

A text of up to ``CHUNK`` characters is encoded at once. A longer one is cut into
chunks that share ``OVERLAP`` characters with their successor. Each chunk is
encoded with offsets. Two neighbours are spliced at a position in the overlap
where both have a token boundary and the text has a safe cut (one space between
two characters that are not blank, which no vocabulary used here crosses, see
``encoding``): left of it the earlier chunk's tokens are the whole text's, right
of it the later one's are. Without such a position the later chunk starts
earlier and the overlap doubles, at the most until the earlier chunk's own last
splice, from where the two are encoded as one.

Defined cases: null and empty texts have no tokens; every row gives one row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from vitalgrid.llm import common
from vitalgrid.llm.encoding import Encoder, decoded, encoder, tokenizer_path

FILE = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters of a chunk, and of the first overlap tried.
CHUNK, OVERLAP = 16_384, 256


def _encoded(enc: Encoder, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk and the text position where each token begins."""
    found = enc.library.encode(text[start:end], add_special_tokens=False)
    return np.array(found.ids, np.uint32), np.array([a for a, _ in found.offsets], np.int64) + start


def _common_boundaries(text: str, left: np.ndarray, right: np.ndarray, low: int, high: int) -> list[int]:
    """Positions between ``low`` and ``high`` where tokens begin in both chunks and the text has a safe cut."""
    both = np.intersect1d(left, right)
    return [
        p for p in both[(both > low) & (both < high - 1)].tolist()
        if text[p] == " " and not text[p - 1].isspace() and not text[p + 1].isspace()
    ]


def spliced_ids(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of a text of any length."""
    if len(text) <= chunk:
        return np.frombuffer(enc.ids(text), np.uint32)
    out: list[np.ndarray] = []
    settled, end = 0, chunk  # tokens before ``settled`` are out; the open chunk runs from there to ``end``
    ids, at = _encoded(enc, text, settled, end)
    while end < len(text):
        wide, splice = overlap, None
        while splice is None:
            start = max(settled, end - wide)
            # the next chunk grows with its overlap, so that it always reaches further
            stop = min(len(text), start + max(chunk, 2 * wide))
            more, where = _encoded(enc, text, start, stop)
            if start == settled:
                ids, at = more, where
                break
            cuts = _common_boundaries(text, at, where, start, end)
            splice = cuts[len(cuts) // 2] if cuts else None
            wide *= 2
        if splice is not None:
            out.append(ids[at < splice])
            keep = where >= splice
            ids, at, settled = more[keep], where[keep], splice
        end = stop
    out.append(ids)
    return np.concatenate(out)


def counts(docs: DataFrame, file: str = FILE, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``."""

    def work(batch: list[bytes], _) -> dict:
        enc = encoder(tokenizer_path(file), lead=True)
        n = np.array([len(spliced_ids(enc, decoded(t))) for t in batch], np.int64)
        return {"n_bytes": [len(t) for t in batch], "n_tokens": n, "over_limit": n > limit}

    return common.over_texts(common.texts(docs), work, "n_bytes bigint, n_tokens bigint, over_limit boolean")
