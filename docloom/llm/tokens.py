"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic programming carries
the best score and its piece count for each position. Text is divided as the tokenizers
library's Metaspace pre-tokenizer does it (a mark before the text, and for every space; each
mark begins a segment), so a segment's count never depends on its neighbours and is kept.

Tie rules, those of that library's Unigram model: pieces are offered in order of their start,
a later one replaces an earlier one only with a strictly larger score; a character without a
piece of its own costs the vocabulary's smallest score less 10, and counts as its UTF-8 bytes
(byte fallback).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import give_back, widened

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the tokenizers library
KEPT_SEGMENTS, KEPT_LENGTH = 500_000, 64  # segment counts a task holds on to


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Viterbi:
    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.kept: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Pieces of the best path through one segment."""
        n = len(text)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        done, own = 0, False  # positions up to `done` are final; own: the last character has a piece of its own
        best: tuple[float, int] | None = None

        def close(end: int) -> None:
            nonlocal best, own
            if not own:
                other = self.unknown + score[end - 1]
                if best is None or other > best[0]:
                    best = (other, pieces[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass")))
            score[end], pieces[end] = best
            best, own = None, False

        for last, (length, value) in self.automaton.iter(text):  # by end, the longest (earliest start) first
            end = last + 1
            while done < end - 1:
                done += 1
                close(done)
            candidate = value + score[end - length]
            if best is None or candidate > best[0]:
                best = (candidate, pieces[end - length] + 1)
            own = own or length == 1
        while done < n:
            done += 1
            close(done)
        return pieces[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace(" ", MARK).split(MARK)
        if not parts[0]:
            parts = parts[1:]  # the text begins with a mark of its own
        total = 0
        for part, times in Counter(parts).items():
            found = self.kept.get(part)
            if found is None:
                found = self.segment(MARK + part)
                if len(part) <= KEPT_LENGTH:
                    if len(self.kept) >= KEPT_SEGMENTS:
                        self.kept.clear()
                    self.kept[part] = found
            total += found * times
        return total


def _count_part(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Viterbi(shared.value)
        for batch in batches:
            counts = [model.count((t.as_py() or b"").decode("utf-8", "replace")) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(counts, pa.int64())], [*names, "n_tokens"])
        give_back()

    return run


def count(docs: DataFrame, *columns: str, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """The named columns of docs and n_tokens of the text. The vocabulary, of a tokenizer's fixed size, is broadcast.

    Null and empty texts have 0 tokens; a text of any length is counted whole, one segment at a
    time; other columns do not matter, whatever their names.
    """
    source = docs.select(*columns, F.col("text").cast("binary").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return source.mapInArrow(_count_part(shared, list(columns)), widened(source, list(columns), "n_tokens long"))
