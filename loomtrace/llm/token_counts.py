"""Unigram token counts: forward scores over a trie of the distinct pre-tokens, worked out once per shared prefix."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import no_text

MARK = "▁"
PRE_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
KNOWN = 400_000
_MODELS: dict[str, Unigram] = {}


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Unigram:
    """Pieces of a public vocabulary with Zipf scores: log-probability minus the log of the piece's rank.

    A character without a piece costs its UTF-8 bytes in tokens and `unknown` in score each. Counts of pre-tokens met so far
    are kept up to a bound; beyond it the table starts anew, which changes no result.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        scale = math.log(sum(1.0 / r for r in range(1, len(names) + 1)))
        self.scores = {name: -math.log(rank) - scale for rank, name in enumerate(names, 1)}
        self.tails = {name[i:] for name in names for i in range(len(name))}
        self.unknown = min(self.scores.values()) - 10.0
        self.counts: dict[str, int] = {}

    def add(self, tokens: Iterable[str]) -> None:
        """Counts of new pre-tokens. Sorted, they are the trie's depth-first order: the stack holds the current path's
        forward scores, and only the part beyond the prefix shared with the one before is worked out."""
        new = sorted(set(tokens) - self.counts.keys())
        if len(self.counts) + len(new) > KNOWN:
            self.counts = {}
            new = sorted(set(tokens))
        path, best, pieces = "", [0.0], [0]
        scores, tails = self.scores, self.tails
        for token in new:
            word = MARK + token
            shared, upto = 0, min(len(word), len(path))
            while shared < upto and word[shared] == path[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                size = len(word[i - 1].encode("utf-8", "replace"))
                top, count = best[i - 1] + self.unknown * size, pieces[i - 1] + size
                for j in range(i - 1, -1, -1):
                    part = word[j:i]
                    if part not in tails:
                        break
                    score = scores.get(part)
                    if score is not None and best[j] + score > top:
                        top, count = best[j] + score, pieces[j] + 1
                best.append(top)
                pieces.append(count)
            path = word
            self.counts[token] = pieces[-1]

    def tokens(self, words: list[str]) -> int:
        return sum(map(self.counts.__getitem__, words))


def unigram(path: str) -> Unigram:
    if path not in _MODELS:
        _MODELS[path] = Unigram(path)
    return _MODELS[path]


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, number of pre-tokens, number of tokens in the best unigram segmentation.

    Null and empty texts have none; null ids stay null; repeated rows each give their row; other columns are not read.
    Equal scores keep the shorter last piece. Nothing is shuffled: each worker walks the trie of what its batches bring.
    """
    path = path or vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                piece = batch.slice(low, 1000)
                words = [PRE_TOKEN.findall(t) for t in piece.column(1).to_pylist()]
                model.add({w for ws in words for w in ws})
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([model.tokens(w) for w in words], pa.int64())],
                    ["id", "n_pretokens", "n_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), no_text(text_col).alias("text"))
    return picked.mapInArrow(count, f"id {kind}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)
