"""Token counts under a unigram vocabulary, without making the tokens.

The pieces of the vocabulary form an Aho-Corasick automaton, which lists all matches in a word in one pass. Dynamic
programming over the ends of the matches carries the best score and the number of pieces on the best path, nothing
else. Ties follow the tokenizer: matches compete at their end, in the order of their starts, and only a strictly better
score replaces an earlier one; a character without a piece of its own costs the lowest score less 10 and, with byte
fallback, counts as its UTF-8 bytes. Scores are summed in double precision.

The default vocabulary is the file of a BPE model, whose scores are the negative ranks of its merges; it is used here as
a unigram vocabulary, so counts are not those of that BPE model. Pieces that stand for single bytes are never matched in
a text: the text <0x0A> is six characters.

Text is taken as it is, with U+2581 before it and in place of each space. No piece holds that sign behind another
character (this is checked), so the best path has a cut before each run of it and words may be counted one by one; the
counts of the words seen are kept, in a dictionary of bounded size.

Defined results: null and empty texts have 0 tokens; repeated rows and null doc_ids are counted like any other; an
empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns

MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Words kept per worker before the dictionary starts anew, and the longest word kept.
CACHE_WORDS, CACHE_CHARS = 600_000, 48

_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Counter(dict):
    """Number of pieces by word; a word that is missing is counted when it is asked for."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        super().__init__()
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece goes beyond a word")
        self._find = ahocorasick.Automaton()
        for piece, score in pieces:
            self._find.add_word(piece, (len(piece), score))
        if pieces:
            self._find.make_automaton()
        self._single = {p for p, _ in pieces if len(p) == 1}
        self._unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self._fallback, self._empty = byte_fallback, not pieces

    def count(self, word: str) -> int:
        n = len(word)
        best, used, lost = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, found = 0, None
        single, unknown = self._single, self._unknown

        def close(end: int) -> None:
            """No more matches end here: the unknown character is the candidate with the last start."""
            nonlocal found
            if word[end - 1] not in single:
                score = best[end - 1] + unknown
                if found is None or score > found:
                    found = score
                    more = len(word[end - 1].encode()) if self._fallback else int(not lost[end - 1])
                    used[end], lost[end] = used[end - 1] + more, True
            best[end], found = found, None

        for last, (length, score) in () if self._empty else self._find.iter(word):
            while at <= last:  # `at` is the end whose matches are being compared
                if at:
                    close(at)
                at += 1
            start = last + 1 - length
            score += best[start]
            if found is None or score > found:
                found, used[at], lost[at] = score, used[start] + 1, False
        while at <= n:
            if at:
                close(at)
            at += 1
        return used[n]

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= CACHE_CHARS:
            self[word] = n
        return n

    def text(self, text: str) -> int:
        if not text:
            return 0
        if len(self) > CACHE_WORDS:
            self.clear()
        return sum(map(self.__getitem__, _RUNS.findall(MARK + text.replace(" ", MARK))))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The worker's counter for a sentencepiece model file, whose ordinary pieces and scores are taken as they are."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    pieces = [(model.id_to_piece(k), model.get_score(k)) for k in ids if not any(f(k) for f in odd)]
    return Counter(pieces, byte_fallback=sum(map(model.is_byte, ids)) == 256)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row; a map, no shuffle."""
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).text
        for batch in batches:
            n = [count(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
