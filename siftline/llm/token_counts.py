"""Token counts of whole texts by a SentencePiece model, with overlap resynchronisation for huge texts.

A text of up to `chunk_chars` is encoded in one call. A longer one is encoded in overlapping chunks with offsets, so
memory is bounded by the chunk and not by the document. Two neighbours are spliced at a position inside their overlap
that is a token boundary in both and that is *proven* stable: no piece of the vocabulary occurs across it in the text.
Every merge builds a piece of the vocabulary, so no merge, in whatever context, can cross such a position, and
encoding left and right of it separately gives the tokens of the whole. Where an overlap has no such position it is
widened, and if it comes to reach back to the previous splice the left chunk grows instead, up to the whole text.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are independent, so repeated ids and rows give a
row each; null ids pass through; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

CHUNK_CHARS = 16_384
OVERLAP = 256

_loaded: dict[str, "Counter"] = {}


class Counter:
    """Counts tokens as one model gives them."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        special = {i for i in range(len(pieces)) if self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i)}
        self.pieces = {p for i, p in enumerate(pieces) if i not in special}
        self.longest = max(map(len, self.pieces))
        probe = "Ａ ﬁ  é\t x"
        #: Splicing works on the text itself, so it needs a model that doesn't rewrite it.
        self.plain = self.sp.normalize(probe).lstrip("▁").replace("▁", " ") == probe

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece of the vocabulary occurs in the text across this position."""
        lo, hi = max(0, at - self.longest), min(len(text), at + self.longest)
        near = text[lo:hi].replace(" ", "▁")
        at -= lo
        if lo == 0:  # the model puts a space before the text
            near, at = "▁" + near, at + 1
        return not any(
            near[i:j] in self.pieces
            for i in range(max(0, at - self.longest + 1), at)
            for j in range(at + 1, min(len(near), i + self.longest) + 1)
        )

    def starts(self, text: str, lo: int, hi: int) -> list[int]:
        """Where the tokens of text[lo:hi] start, in the whole text."""
        return [lo + a for a, _ in self.sp.encode_as_offset_mapping(text[lo:hi])["offsets"]]

    def splice(self, text: str, left: list[int], right: list[int], lo: int, hi: int) -> int | None:
        """A common boundary in [lo, hi] that is proven stable, the one nearest the middle."""
        both = sorted({x for x in left if lo <= x <= hi} & set(right), key=lambda x: (abs(2 * x - lo - hi), x))
        return next((x for x in both if self.stable(text, x)), None)

    def count(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> int:
        if len(text) <= chunk or not self.plain:
            return len(self.sp.encode(text))
        total, done, lo, hi = 0, 0, 0, chunk
        left = self.starts(text, lo, hi)
        while hi < len(text):
            width, at = overlap, None
            while at is None:
                start = hi - width
                # What stands within a piece's length of a cut may differ from the whole; nothing there is trusted.
                first, last = start + self.longest + 1, hi - self.longest - 1
                if start <= done:
                    break
                right = self.starts(text, start, min(len(text), start + chunk + width))
                at = self.splice(text, left, right, max(first, done + 1), last)
                width *= 2
            if at is None:  # no overlap aligns: the left chunk itself grows
                hi = min(len(text), hi + max(chunk, hi - lo))
                left = self.starts(text, lo, hi)
                continue
            total += sum(done <= x < at for x in left)
            done, lo, hi, left = at, start, min(len(text), start + chunk + width // 2), right
        return total + sum(x >= done for x in left)


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(
    docs: DataFrame, model: str, limit: int = 4096, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of `docs`. No shuffle: a scan and an Arrow map.

    `model`: a SentencePiece file that every executor can open under this path.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = counter(model)
        for b in batches:
            n = [one.count(x, chunk_chars, overlap) if x else 0 for x in (x.as_py() for x in b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "text",
    )
    return rows.mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
