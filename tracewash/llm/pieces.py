"""SentencePiece ids of whole texts through tables of distinct chunks.

The model marks blanks with U+2581 and no piece of it has the mark after
another character, so merges never cross the start of a run of marks.  A text
is therefore the sequence of its chunks, each a run of marks and what follows
up to the next mark.  Every task keeps a table of the distinct chunks it has
met, lets the library segment each of them once, and joins ids, their decimal
form and their decoded text back by position.  The table is emptied when it is
full, so memory stays bounded; there is no shuffle, and a lost task is simply
run again.

Defined results: a null or empty text has only the end id and decodes to an
empty text.  Rows stay rows, whatever repeats; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE = 200_000
_CHUNK = re.compile(" +[^ ]*")


def crossing_pieces(model: str) -> list[str]:
    """Pieces in which a mark follows another character; chunks need none."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if re.search(f"[^{MARK}]{MARK}", p)]


class Encoder:
    """Ids, decimal ids and decoded texts by chunk, kept in a table."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.end = self.sp.eos_id()
        self.table: dict[str, tuple[list[int], str, str]] = {}

    def chunks(self, text: str) -> list[str]:
        """Chunks without their first mark, which stands before each of them."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in _CHUNK.findall(" " + text)]
        return text.split(" ")

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks that the table lacks; the library adds the mark."""
        if len(self.table) >= TABLE:
            self.table.clear()
        new = [c for c in chunks if c not in self.table]
        alone = self.sp.piece_to_id(MARK)
        ids = [x if c else [alone] for c, x in zip(new, self.sp.encode(new, num_threads=1))]
        for c, x, d in zip(new, ids, self.sp.decode(ids, num_threads=1)):
            self.table[c] = (x, " ".join(map(str, x)), d)

    def encode(self, text: str | None) -> list[int]:
        parts = self.chunks(text or "")
        self.learn(set(parts))
        return [i for c in parts for i in self.table[c][0]] + [self.end]


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row.

    ``keep`` may name ``ids`` and ``decoded`` to get the real outputs too.
    Raises ``ValueError`` for a model with pieces that cross marks.
    """
    if crossing_pieces(model):
        raise ValueError("pieces of this model cross marks, so chunks cannot be segmented one by one")

    def run(batches):
        coder = Encoder(model)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                split = [coder.chunks(t or "") for t in part.column(1).to_pylist()]
                coder.learn(set().union(*split))
                count, hashed, back, ids, decoded = [], [], [], [], []
                for chunks in split:
                    found = [coder.table[c] for c in chunks]
                    count.append(sum(len(x[0]) for x in found) + 1)
                    hashed.append(sha(" ".join([x[1] for x in found] + [str(coder.end)])))
                    text = " ".join([x[2] for x in found])
                    back.append(sha(text))
                    if "ids" in keep:
                        ids.append([i for x in found for i in x[0]] + [coder.end])
                    if "decoded" in keep:
                        decoded.append(text)
                out = {"doc_id": part.column(0), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(hashed, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                if "ids" in keep:
                    out["ids"] = pa.array(ids, pa.list_(pa.int32()))
                if "decoded" in keep:
                    out["decoded"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ("ids" in keep) + ", decoded string" * ("decoded" in keep)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
