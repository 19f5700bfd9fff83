"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

A sequence of tokens is what greedy merging makes of its text exactly if every two neighbours are (no merge
that is due earlier than their own crosses the border). So the last token of each prefix follows from the last
tokens of shorter prefixes, and a text can be read once from left to right. The merge list also gives a
*sufficient lookahead* for the border after each token: only a merge can undo it that starts with a part at the
token's right end, and whether that merge happens is decided by a chain of overlapping merges, each due earlier than
the one before. The longest such chain is how many bytes after the border have to be seen. An encoder emits tokens
as soon as the border after them has that many bytes behind it, and the rest when the piece ends; every token of
every piece comes out of an encoder that way. What is kept is the undecided end of one piece.

Cases: null text counts as empty and gives no tokens; texts of any length are read in portions of PORTION
characters, so that working memory does not grow with them (only the row itself and its ids have to fit); repeated
rows are each encoded, and nothing depends on their order; other columns are kept, and a column with an output's name
is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import codecs
import json

import ahocorasick
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import Remembered, held, table, with_made

VOCAB = "byte_bpe_50k.json"
#: Characters of a text that are read at once, and bytes of a piece that an encoder is given at once.
PORTION, CHUNK = 16_384, 512
#: Pieces of up to so many characters are remembered with what their encoder emitted.
SHORT = 48
INF = float("inf")


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def vocabulary(spec: dict) -> tuple[dict[int, bytes], dict[str, int]]:
    """The bytes of each token, and the special tokens."""
    letters = {c: b for b, c in enumerate(byte_letters())}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    return {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()} | {i: t.encode() for t, i in special.items()}, special


class Merges:
    """The merge list: token ids, who merges with whom and when, and how far ahead a border can be undone."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.bytes_of, self.special = vocabulary(spec)
        self.ids = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        raw = {t: self.bytes_of[i] for t, i in spec["model"]["vocab"].items()}
        self.rank, self.made, self.parts = {}, {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank.setdefault((x, y), r)
            if z not in self.made:
                self.made[z], self.parts[z] = r, (x, y)
        self.partners: dict[int, dict[int, int]] = {}
        for (x, y), r in self.rank.items():
            self.partners.setdefault(x, {})[y] = r
        self.longest = max(map(len, self.ids))
        self.edges: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
        self.fit: dict[int, bool] = {}
        self.reach = self._reach()
        #: Bytes after a border that decide its fate, whatever token stands before it.
        self.lookahead = max(self.reach.values(), default=0)
        self.suffixes = ahocorasick.Automaton()  # all tokens that end at a position, longest first
        for b, i in self.ids.items():
            self.suffixes.add_word(b.decode("latin-1"), (i, len(b)))
        self.suffixes.make_automaton()
        self.wholes: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """What stands at the left (0) or right (1) end of a token while it is built: part, when made, when merged away."""
        if (out := self.edges.get((token, side))) is not None:
            return out
        out = self.edges[token, side] = []
        until = INF
        while True:
            since = self.made.get(token, -1)
            out.append((token, since, until))
            if token not in self.parts:
                return out
            until, token = since, self.parts[token][side]

    def fits(self, a: int, b: int) -> bool:
        """Does merging the text of a and b give just these two?"""
        key = a << 32 | b
        if (known := self.fit.get(key)) is None:
            if len(self.fit) > 300_000:
                self.fit.clear()
            known = self.fit[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        right = self.edge(b, 0)
        for x, made_x, gone_x in self.edge(a, 1):
            if (partners := self.partners.get(x)) is not None:
                for y, made_y, gone_y in right:
                    if (r := partners.get(y)) is not None and (due := max(r, made_x, made_y)) < gone_x and due <= gone_y:
                        return False
        return True

    def whole(self, token: int) -> bool:
        """Is the token what its own text merges to?"""
        if (known := self.wholes.get(token)) is None:
            known = self.wholes[token] = token not in self.parts or not self.fits(*self.parts[token])
        return known

    def _reach(self) -> dict[int, int]:
        """For each token the bytes after it that decide whether the border behind it stays."""
        starts: dict[int, tuple[list[int], list[int]]] = {}  # left part -> ranks, and the longest reach up to each rank
        size = {i: len(b) for b, i in self.ids.items()}

        def furthest(token: int, before: float) -> int:
            """The longest chain that merges of the token's right end start, each due before it is gone and before `before`."""
            out = 0
            for part, _, gone in self.edge(token, 1):
                ranks, best = starts.get(part, ((), ()))
                if k := bisect.bisect_left(ranks, min(gone, before)):
                    out = max(out, best[k - 1])
            return out

        for (x, y), r in sorted(self.rank.items(), key=lambda m: m[1]):
            ranks, best = starts.setdefault(x, ([], []))
            reach = size[y] + furthest(y, r)
            ranks.append(r)
            best.append(max(reach, best[-1] if best else 0))
        return {token: furthest(token, INF) for token in size}


def extend(m: Merges, text: str, last: list[int], sizes: list[int], before: int, done: int) -> None:
    """last and sizes: the last token of each prefix of text and its size, known up to `done`; they are carried on to the end.
    text: bytes as Latin-1 letters; before: the token to the left of text, or -1."""
    known, slow = m.fit.get, m.fits
    for end, (token, size) in m.suffixes.iter(text, max(0, done - m.longest)):
        if end < done:
            continue  # this prefix has its last token
        start = end + 1 - size
        left = last[start] if start else before
        if left < 0:
            fit = m.whole(token)
        elif (fit := known(left << 32 | token)) is None:
            fit = slow(left, token)
        if fit:
            last.append(token)
            sizes.append(size)
            done = end + 1
    if done < len(text):
        raise ValueError("the vocabulary lacks a byte")


class Encoder:
    """Reads the bytes of one piece in portions; feed() and finish() return the tokens that have become final."""

    def __init__(self, merges: Merges):
        self.m, self.before = merges, -1
        self.text, self.last, self.sizes = "", [-1], [0]

    def feed(self, portion: str) -> list[int]:
        """portion: bytes as Latin-1 letters."""
        done, self.text = len(self.text), self.text + portion
        extend(self.m, self.text, self.last, self.sizes, self.before, done)
        return self._emit(False)

    def _emit(self, ended: bool) -> list[int]:
        """Walks back from the end to the last border that can no longer be undone, and takes what stands before it."""
        size, reach, last, sizes = len(self.text), self.m.reach, self.last, self.sizes
        end, cut, out = size, size if ended else 0, []
        while end > 0:
            token = last[end]
            if not cut and end + reach[token] <= size:
                cut = end
            if cut:
                out.append(token)
            end -= sizes[end]
        if cut:
            self.before = last[cut]
            self.text, self.last, self.sizes = self.text[cut:], last[cut:], sizes[cut:]
        return out[::-1]

    def finish(self) -> list[int]:
        return self._emit(True)


class Codec:
    def __init__(self, path: str):
        self.merges = Merges(path)
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.special = self.merges.special
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: Characters at the end of what was read that later ones may still join to a mark or a contraction, and one before them.
        self.margin = max([4, *(len(x) + 1 for x in self.special)])
        self.pieces = Remembered(self._piece, 200_000, SHORT)

    def _piece(self, piece: str) -> tuple[int, ...]:
        """What an encoder emits for a whole piece."""
        data, encoder = piece.encode("utf-8").decode("latin-1"), Encoder(self.merges)
        return *(t for k in range(0, len(data), CHUNK) for t in encoder.feed(data[k : k + CHUNK])), *encoder.finish()

    def encode(self, text: str) -> list[int]:
        """The token ids of a text, read in portions."""
        stream = Stream(self)
        if len(text) <= PORTION:
            return stream.feed(text, True)
        out = []
        for k in range(0, len(text), PORTION):
            out += stream.feed(text[k : k + PORTION], k + PORTION >= len(text))
        return out


class Stream:
    """Reads one text in portions and gives its token ids as they become final. It keeps the undecided end of what it read."""

    #: The classes that the splitting pattern takes runs of.
    RUNS = [regex.compile(x) for x in (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*")]

    def __init__(self, codec: Codec):
        self.codec, self.held = codec, ""
        self.open: tuple[Encoder, regex.Pattern] | None = None  # a long piece that goes on, and with what

    def feed(self, portion: str, last: bool = False) -> list[int]:
        """last: the text ends with this portion."""
        parts = self.codec.marks.split(self.held + portion) if self.codec.marks else [self.held + portion]
        if len(parts) == 1:
            return self._pieces(parts[0], last)
        out = []
        for part in parts[:-1]:
            mark = self.codec.special.get(part)
            out += self._pieces(part, True) if mark is None else [mark]
        return out + self._pieces(parts[-1], last)

    def _pieces(self, text: str, last: bool) -> list[int]:
        out: list[int] = []
        stop = len(text) if last else max(0, len(text) - self.codec.margin)
        if self.open:
            encoder, run = self.open
            end = run.match(text).end()
            if run is self.RUNS[2] and not (last and end == len(text)):
                end = max(0, end - 1)  # the last of several blanks belongs to what follows them
            out += self._fed(encoder, text[: min(end, stop)])
            if end > stop:
                self.held = text[stop:]
                return out
            out += encoder.finish()
            self.open, text, stop = None, text[end:], stop - end
        pieces, at = self.codec.split.findall(text), len(text)
        if not last:
            while pieces and at > stop:
                at -= len(pieces.pop())
        for tokens in map(self.codec.pieces.__getitem__, pieces):
            out += tokens
        if not last and stop - at > CHUNK:
            # a piece of this length is a run of one class after its first character
            encoder = Encoder(self.codec.merges)
            self.open = encoder, next(run for run in self.RUNS if run.match(text, at + 1).end() > at + 1)
            out += self._fed(encoder, text[at:stop])
            at = stop
        self.held = "" if last else text[at:]
        return out

    def _fed(self, encoder: Encoder, text: str) -> list[int]:
        data = text.encode("utf-8").decode("latin-1")
        return [t for k in range(0, len(data), CHUNK) for t in encoder.feed(data[k : k + CHUNK])]


def decoded(ids: list[int], of: dict[int, bytes]) -> str:
    """Byte to text, a portion at a time; the state between portions is the unfinished character alone."""
    state, out = codecs.getincrementaldecoder("utf-8")("replace"), []
    for k in range(0, len(ids), 4096):
        out.append(state.decode(b"".join([of[i] for i in ids[k : k + 4096]])))
    return "".join(out) + state.decode(b"", True)


def codec(path: str) -> Codec:
    return held(("codec", path), lambda: Codec(path))


def token_bytes(path: str) -> dict[int, bytes]:
    return held(("bytes", path), lambda: vocabulary(json.load(open(path, encoding="utf-8")))[0])


def place(vocab: str) -> str:
    """vocab: a file of public_tokenizers, or a path that each executor has."""
    return vocab if "/" in vocab else public_tokenizers.path(vocab)


def encode(docs: DataFrame, text: str = "text", out: str = "ids", vocab: str = VOCAB) -> DataFrame:
    """docs with the column out: array<int>, the token ids of the whole text."""

    def maker():
        own = codec(place(vocab))
        return lambda texts: [[own.encode(t or "") for t in texts]]

    return with_made(docs, text, f"{out} array<int>", maker)


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", vocab: str = VOCAB) -> DataFrame:
    """docs with the column out: the text of the token ids (null: empty); broken UTF-8 becomes U+FFFD."""

    def maker():
        of = token_bytes(place(vocab))
        return lambda rows: [[decoded(x or [], of) for x in rows]]

    return with_made(docs, ids, f"{out} string", maker)


def encode_and_decode(docs: DataFrame, text: str = "text", ids: str = "ids", out: str = "decoded", vocab: str = VOCAB) -> DataFrame:
    """encode() and decode() in one pass, so that a task needs one Python process instead of two."""

    def maker():
        own = codec(place(vocab))

        def both(texts: list) -> list:
            encoded = [own.encode(t or "") for t in texts]
            return [encoded, [decoded(x, own.merges.bytes_of) for x in encoded]]

        return both

    return with_made(docs, text, f"{ids} array<int>, {out} string", maker)


def encode_and_check(docs: DataFrame, text: str = "text", ids: str = "ids", out: str = "round_trip", vocab: str = VOCAB) -> DataFrame:
    """docs with the token ids instead of the text (null: empty), and whether they decode to it. Neither the text nor what it decodes to
    is sent back from Python."""

    def maker():
        own = codec(place(vocab))

        def both(texts: list) -> list:
            encoded = [own.encode(t or "") for t in texts]
            return [encoded, [decoded(x, own.merges.bytes_of) == (t or "") for x, t in zip(encoded, texts)]]

        return both

    return with_made(docs, text, f"{ids} array<int>, {out} boolean", maker, drop=True)


def digests(docs: DataFrame) -> DataFrame:
    both = encode_and_decode(docs.select("doc_id", "text")).drop("text")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}
