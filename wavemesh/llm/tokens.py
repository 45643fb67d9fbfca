"""Token counts under a unigram model, by dynamic programming shared over a trie of the words.

A vocabulary's pieces get the log probabilities of Zipf's law over their ranks. A word, with a mark for the space ahead
of it, is segmented into pieces with the highest sum (of equals, the fewest pieces); a character no piece covers costs
a token for each of its bytes. Within a task, the distinct words met for the first time are walked in sorted order, which
is the depth-first order of their trie: the forward scores of a shared prefix stay on the stack and are computed once,
and the count at a word's last node is stored and looked up for every later occurrence.

Defined cases: a null or empty text, or one of white space only, has 0 tokens; rows that repeat count alike; no rows
give no rows; a very long word is segmented in linear time; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Distinct words whose counts a task keeps; beyond, it starts afresh.
KEPT_WORDS = 400_000


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Log probability of each piece: Zipf's law with Mandelbrot's offset over the rank in the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i))]
    total = math.log(sum(1 / (r + 2.7) for r in range(len(ids))))
    return {model.IdToPiece(i): -math.log(r + 2.7) - total for r, i in enumerate(ids)}


class WordCounter:
    """Token counts of words under the pieces."""

    def __init__(self, pieces: dict[str, float], keep: int = KEPT_WORDS):
        self.pieces, self.keep, self.counts = pieces, keep, {}
        self.longest = max(map(len, pieces))
        self.byte = min(pieces.values()) - 10

    def step(self, s: str, i: int, score: list[float], count: list[int]) -> None:
        """Sets the best score and its count for the first i characters of s."""
        n = len(s[i - 1].encode("utf-8", "surrogatepass"))
        best, fewest = score[i - 1] + n * self.byte, count[i - 1] + n
        get = self.pieces.get
        for j in range(max(0, i - self.longest), i):
            p = get(s[j:i])
            if p is not None:
                x = score[j] + p
                if x > best or x == best and count[j] + 1 < fewest:
                    best, fewest = x, count[j] + 1
        score[i : i + 1], count[i : i + 1] = [best], [fewest]

    def learn(self, words: set[bytes]) -> None:
        """Walks the trie of the words and stores the count at each word's last node."""
        score, count, last = [0.0], [0], ""
        for word in sorted(words):
            s = SPACE + word.decode("utf-8", "surrogatepass")
            shared, most = 0, min(len(s), len(last))
            while shared < most and s[shared] == last[shared]:
                shared += 1
            for i in range(shared + 1, len(s) + 1):
                self.step(s, i, score, count)
            self.counts[word], last = count[len(s)], s

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text."""
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        new: set[bytes] = set()
        for words in split:
            new.update(words)
        if len(self.counts) + len(new) > self.keep:
            self.counts = {}
        self.learn(new.difference(self.counts))
        return [len(w) for w in split], [sum(map(self.counts.__getitem__, w)) for w in split]


def count_tokens(docs: DataFrame, pieces: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens. The pieces are a fixed vocabulary, sent to the tasks once."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(pieces or load_pieces())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(sent.value)
        for b in batches:
            words, tokens = counter.count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
