"""Exact token counts at every prefix, by dynamic programming over prefixes.

The tokens of a text are what best-score-first merging makes of it exactly if every two neighbours are what it
makes of their own joined text. So for each prefix just one last token is right, the one that fits the last
token of the prefix before it, and the count of a prefix is one more than the count of that shorter prefix.
`prefix_counts` makes the table of all prefixes of each text; how many tokens a text or a prefix has, whether it exceeds a
limit, and where to cut it for a budget are then column expressions over that table, without encoding again. No piece
spans a border between a letter and a following space mark, so the table is made by such chunks, and the tables of
known chunks are remembered (a bounded number).

Cases: null or empty text has 0 tokens and every budget takes all of it; special strings inside texts are plain
text; texts of any length are counted whole (the table takes four bytes a character of the row); a longer prefix may
have fewer tokens, and of all prefixes within a budget the longest is taken; repeated rows are each counted; other
columns are kept, whatever their names, and one with an output's name is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import Remembered, held, table, whole, with_made

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"


class PrefixCounter:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = [f(i) for i in range(model.get_piece_size()) for f in (model.is_control, model.is_unknown, model.is_byte, model.is_unused)]
        usual = [i for i in range(model.get_piece_size()) if not any(odd[4 * i : 4 * i + 4])]
        ordered = sorted(usual, key=lambda i: (-model.get_score(i), i))
        self.rank = {model.id_to_piece(i): r for r, i in enumerate(ordered)}
        self.longest = max(map(len, self.rank))
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("pieces that hold a space mark after a letter are not supported")
        alone = "" if any("\n" in p for p in self.rank) else "\\n"
        self.chunk = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else ""))
        self.pieces = [model.id_to_piece(i) for i in ordered]
        self.suffixes = ahocorasick.Automaton()  # all pieces that end at a letter, longest first
        for p, r in self.rank.items():
            self.suffixes.add_word(p, (r, len(p)))
        self.suffixes.make_automaton()
        self.fit = Remembered(lambda pair: self._fits(self.pieces[pair >> 32], self.pieces[pair & 0xFFFFFFFF]), 300_000)
        self.whole = Remembered(lambda piece: self.merged(self.pieces[piece]) == [self.pieces[piece]], 50_000)
        self.tables = Remembered(lambda chunk: np.array(self.prefixes(chunk)[1:], np.int32), 300_000, 64)

    def merged(self, text: str) -> list[str]:
        """Best-score-first merging, leftmost first among equals; for the short texts of two tokens."""
        parts, rank = [*text], self.rank
        while len(parts) > 1:
            best, at = min((rank.get(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def prefixes(self, chunk: str) -> list[int]:
        """The token count of each prefix of a chunk, from the empty one on."""
        counts, last, fit, done = [0], [-1], self.fit, 0
        for end, (piece, size) in self.suffixes.iter(chunk):
            if end < done:
                continue  # this prefix has its last token
            while done < end:
                done = self._alone(chunk, done, counts, last)
            start = end + 1 - size
            left = last[start]
            if fit[left << 32 | piece] if left >= 0 else self.whole[piece] if start == 0 else self._fits(chunk[start - 1], self.pieces[piece]):
                last.append(piece)
                counts.append(counts[start] + 1)
                done = end + 1
        while done < len(chunk):
            done = self._alone(chunk, done, counts, last)
        return counts

    def _alone(self, chunk: str, at: int, counts: list[int], last: list[int]) -> int:
        """A letter that is no piece: its bytes are tokens."""
        counts.append(counts[at] + len(chunk[at].encode("utf-8", "replace")))
        last.append(-1)
        return at + 1

    def _fits(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def all_prefixes(self, text: str) -> np.ndarray:
        """Counts of text[:0], text[:1], ... text."""
        chunks = [*map(self.tables.__getitem__, self.chunks(text))]
        if not chunks:
            return np.zeros(1, np.int32)
        counts = np.concatenate(chunks)
        ends = np.cumsum([*map(len, chunks)])
        base = np.cumsum(counts[ends - 1], dtype=np.int32)
        counts[ends[0] :] += np.repeat(base[:-1], np.diff(ends))
        counts[0] = 0  # the mark before the first letter stands for no letter
        return counts


def counter(path: str) -> PrefixCounter:
    return held(("counter", path), lambda: PrefixCounter(path))


def _own(model: str) -> PrefixCounter:
    return counter(model if "/" in model else public_tokenizers.path(model))


def prefix_counts(docs: DataFrame, text: str = "text", out: str = "prefix_tokens", model: str = MODEL) -> DataFrame:
    """docs with the column out: array<int>, at k the token count of the first k characters (k from 0)."""

    def maker():
        own = _own(model)
        return lambda texts: [[own.all_prefixes(t or "") for t in texts]]

    return with_made(docs, text, f"{out} array<int>", maker)


def tokens_at(prefix: Column, chars: Column | int | None = None) -> Column:
    """Tokens of the first `chars` characters (of the whole text without), from the table of its prefixes."""
    return (F.element_at(prefix, -1) if chars is None else F.get(prefix, chars)).cast("long")


def chars_within(prefix: Column, budget: Column | int) -> Column:
    """The length of the longest prefix with at most `budget` tokens, from the table; null if even the empty one has more."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    cut = F.size(prefix) - F.nullif(F.array_position(F.reverse(F.transform(prefix, lambda n: n <= budget)), True), F.lit(0))
    return F.when(F.element_at(prefix, -1) <= budget, F.size(prefix) - 1).otherwise(cut).cast("long")


def count_tokens(docs: DataFrame, text: str = "text", limit: int = LIMIT, model: str = MODEL) -> DataFrame:
    """docs with n_tokens (long), over_limit (boolean) and chars_in_limit (long: the longest prefix within the limit)."""
    got = prefix_counts(docs.select(whole(docs).alias("doc")), f"doc.{text}", "prefix", model)
    n, new = tokens_at(F.col("prefix")), ("n_tokens", "over_limit", "chars_in_limit")
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c not in new]
    return got.select(*kept, n.alias("n_tokens"), (n > limit).alias("over_limit"), chars_within(F.col("prefix"), limit).alias("chars_in_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counts = prefix_counts(docs).select("doc_id", "n_bytes", "prefix_tokens")
    n = tokens_at(F.col("prefix_tokens"))
    return counts.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > LIMIT).alias("over_limit"), chars_within(F.col("prefix_tokens"), LIMIT).alias("chars_in_limit"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
