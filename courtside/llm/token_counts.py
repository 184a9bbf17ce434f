"""Token counts of a unigram vocabulary: count-only Viterbi over Aho-Corasick matches.

The automaton lists, for every end position, the pieces that end there, longest first.
Dynamic programming carries only two numbers a position: the best score and its number of
pieces. Ties follow the tokenizer: of equal scores the path found first stays, which is the one whose last
piece begins earliest; a character that is no piece itself may also be an unknown one,
at the lowest score less 10, and counts as many pieces as it has UTF-8 bytes.

Where no piece has a space mark after another character, words can be counted apart, and
a worker remembers the words it has seen.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import map_batches, texts_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0


class Counter(dict):
    """Number of pieces by segment, up to a bound on what is remembered."""

    MOST = 400_000

    def __init__(self, scores: dict[str, float]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in scores)
        lines = apart and not any("\n" in p for p in scores)
        self.find = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if lines else f"{MARK}+[^{MARK}]*" if apart else "(?s).+").findall

    def viterbi(self, segment: str) -> int:
        best, pieces, done, n = [0.0], [0], 0, len(segment)
        put, add = best.append, pieces.append

        def unknown_to(end: int) -> None:
            char = segment[end - 1]
            put(best[end - 1] + self.unknown)
            add(pieces[end - 1] + len(char.encode()))

        for last, (length, score) in self.automaton.iter(segment):
            end = last + 1
            while done < end - 1:
                # a position that no piece ends at, or one whose last character is no piece
                if len(best) == done + 1:
                    done += 1
                    unknown_to(done)
                else:
                    done += 1
                    self._settle(segment, best, pieces, done)
            value = best[end - length] + score
            if len(best) == end:
                put(value)
                add(pieces[end - length] + 1)
            elif value > best[end]:
                best[end], pieces[end] = value, pieces[end - length] + 1
        while done < n:
            done += 1
            if len(best) == done:
                unknown_to(done)
            else:
                self._settle(segment, best, pieces, done)
        return pieces[n]

    def _settle(self, segment: str, best: list[float], pieces: list[int], end: int) -> None:
        """The unknown character comes last among what ends here, if its character is no piece."""
        char = segment[end - 1]
        if char not in self.single and best[end - 1] + self.unknown > best[end]:
            best[end], pieces[end] = best[end - 1] + self.unknown, pieces[end - 1] + len(char.encode())

    def __missing__(self, segment: str) -> int:
        n = self.viterbi(segment)
        if len(self) < self.MOST and len(segment) <= 64:
            self[segment] = n
        return n

    def count(self, text: str) -> int:
        """Pieces of a text, which gets a leading space mark; an empty text has none."""
        if not text:
            return 0
        return sum(map(self.__getitem__, self.find(MARK + text.replace(" ", MARK))))


def scores_of(path: str) -> dict[str, float]:
    """Pieces and scores of a model file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(scores_of(path))


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and ``n_tokens`` of every row. NULL and empty texts have 0; NULL ids and repeated rows are kept."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path).count
        return pa.record_batch([batch.column("id"), pa.array([count(t) for t in texts_of(batch)], pa.int64())], [id_column, "n_tokens"])

    kind = dict(docs.dtypes)[id_column]
    return map_batches(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), run, f"`{id_column}` {kind}, n_tokens long")
