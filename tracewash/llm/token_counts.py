"""Token counts of whole texts with a shortcut for words that are one token.

The normaliser drops white space between words and no rule looks across it, so
the count of a text is the sum over its words.  Offline, every vocabulary
string that ends a word is encoded by the library; those that come back as that
single token are proven whole.  A word of plain letters, digits and signs is
cut into pre-tokens; proven ones count one, the rest are merged by the library.
Words with other characters go to the library whole, and so do texts that hold
the vocabulary's special strings.  Counts by word are kept in a bounded table.

Defined results: a null or empty text has no bytes and no tokens.  Rows stay
rows, whatever repeats; other columns are not read.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE = 300_000
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
#: Characters whose classes and lower case every Unicode version agrees on.
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ſ]+")
_LETTERS = "a-zß-öø-ſ"
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")


def _load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the library encodes, alone, as one token."""
    tok = _load(path)
    with open(path, encoding="utf-8") as f:
        suffix = json.load(f)["model"]["end_of_word_suffix"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    found = {}
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        if token.endswith(suffix) and all(c in byte for c in token[: -len(suffix)]):
            try:
                text = bytes(byte[c] for c in token[: -len(suffix)]).decode()
            except UnicodeDecodeError:
                continue
            if _PLAIN.fullmatch(text):
                found[text] = i
    alone = tok.encode_batch(list(found), add_special_tokens=False)
    return frozenset(t for (t, i), e in zip(found.items(), alone) if e.ids == [i] and _PRETOKEN.findall(t) == [t])


class Counter(dict):
    """Tokens by word."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__()
        self.tok, self.whole = _load(path), whole
        self.special = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())

    def merged(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> int:
        if len(self) >= TABLE:
            self.clear()
        if _PLAIN.fullmatch(word):
            n = sum(1 if p in self.whole else self.merged(p) for p in _PRETOKEN.findall(word.lower()))
        else:
            n = self.merged(word)
        self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):
            return self.merged(text)
        return sum(map(self.__getitem__, filter(None, _BLANKS.split(text))))


def counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def run(batches):
        counter = Counter(path, whole.value)
        for batch in batches:
            n = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
