"""SentencePiece-compatible BPE encoding and decoding by vectorised merge rounds.

Normalisation puts one escaped space before a non-empty text and escapes every space. A word is a
run of escaped spaces with what follows up to the next one; no piece holds an escaped space behind
another character, so words are encoded by themselves. Distinct words of a batch lie in flat numpy
arrays. Each round finds, per word, the smallest pair rank and merges its pairs from the left wherever they do not
overlap, in all words at once, and compacts; words without a mergeable pair leave. That is what merging one
pair at a time gives, unless a merge makes a pair of the same or a smaller rank: in such a word only the leftmost
pair is merged in that round. So a long word takes about a round for each rank in it.

Defined cases: null and empty texts give no ids and an empty decoded text; characters without a
piece become byte pieces; very long texts are handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import ship, text_only

SPACE = "▁"
#: Words a worker remembers between batches; beyond that it forgets all.
REMEMBER = 300_000
NO_RANK = np.iinfo(np.int64).max


class PieceModel:
    """Vocabulary of a BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("only BPE models with identity normalisation, a leading space and kept white space are supported")
        kind = proto.trainer_spec.DESCRIPTOR and proto.SentencePiece
        pieces = list(proto.pieces)
        self.pieces = [p.piece for p in pieces]
        self.id_of = {p.piece: i for i, p in enumerate(pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED)}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces with a space behind another character are not supported")
        self.byte_ids = np.zeros(256, np.int64)
        self.byte_of = {}
        for i, p in enumerate(pieces):
            if p.type == kind.BYTE:
                b = int(p.piece[3:5], 16)
                self.byte_ids[b] = i
                self.byte_of[i] = b
        #: Text of each piece; None for byte pieces.
        self.shown = [None if p.type == kind.BYTE else "" if p.type in (kind.CONTROL, kind.UNKNOWN) else p.piece.replace(SPACE, " ") for p in pieces]
        self.digits = [str(i) for i in range(len(pieces))]
        # symbols: 0..n-1 are the pieces, from n on characters without a piece. Ranks: higher scores first, equal scores share a rank.
        self.n = len(pieces)
        _, rank = np.unique([-p.score for p in pieces], return_inverse=True)
        keys, ranks, to = [], [], []
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                a, b = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * self.n + b)
                    ranks.append(rank[i])
                    to.append(i)
        # a character without a piece can be half of a pair only if its piece's other parts exist, which the vocabulary rules out here
        multi = [p for p in self.id_of if len(p) > 1 and any(c not in self.id_of for c in p)]
        if multi:
            raise ValueError(f"pieces of characters that are not pieces: {multi[:3]}")
        order = np.argsort(keys)
        self.pair_key, self.pair_rank, self.pair_to = np.array(keys)[order], np.array(ranks)[order], np.array(to)[order]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, or NO_RANK; merged symbol) of neighbours."""
        key = np.where((left < self.n) & (right < self.n), left * self.n + right, -1)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], NO_RANK), self.pair_to[at]

    def _symbols(self, word: str) -> list[int]:
        get = self.id_of.get
        return [i if (i := get(c)) is not None else self.n + ord(c) for c in word]

    def _ids(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if s < self.n:
                out.append(s)
            else:
                out.extend(int(self.byte_ids[b]) for b in chr(s - self.n).encode("utf-8", "surrogatepass"))
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Piece ids of each word (already escaped)."""
        flat = self._char_symbols()[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        symbols, ends = self._rounds(flat, np.array([len(w) for w in words], np.int64))
        listed, at, out = symbols.tolist(), 0, []
        pieceless = np.zeros(len(words), bool)
        pieceless[np.searchsorted(ends, np.flatnonzero(symbols >= self.n), "right")] = True
        for end, some in zip(ends.tolist(), pieceless.tolist(), strict=True):
            out.append(self._ids(listed[at:end]) if some else listed[at:end])
            at = end
        return out

    def _char_symbols(self) -> np.ndarray:
        """Symbol of each code point."""
        if not hasattr(self, "_of_char"):
            self._of_char = np.arange(0x110000, dtype=np.int64) + self.n
            for piece, i in self.id_of.items():
                if len(piece) == 1:
                    self._of_char[ord(piece)] = i
        return self._of_char

    def _rounds(self, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols left of all words, end of each word's)."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank, to = np.full(len(sym), NO_RANK), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], to[:-1] = self._pairs(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = NO_RANK
        out_sym, out_word = [], []
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(sym)])
            least = np.minimum.reduceat(rank, start)
            least_of = np.repeat(least, size)
            over = least_of == NO_RANK
            if over.any():
                out_sym.append(sym[over])
                out_word.append(word[over])
            # pairs of the least rank in each remaining word, every other one where they overlap
            hit = np.flatnonzero((rank == least_of) & ~over)
            if not len(hit):
                break
            head = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1])
            place = np.arange(len(hit))
            hit = hit[(place - np.repeat(head, np.diff(np.r_[head, len(hit)]))) % 2 == 0]
            hit = self._safe(sym, word, to, hit, least_of[hit])
            sym[hit] = to[hit]
            stay = ~over
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            sym, word, rank, to = sym[stay], word[stay], rank[stay], to[stay]
            at = place[hit]
            # only the pairs beside a merged symbol change
            left = at[at > 0] - 1
            for i in (left[word[left] == word[left + 1]], at):
                has = i + 1 < len(sym)
                has[has] = word[i[has]] == word[i[has] + 1]
                rank[i[~has]] = NO_RANK
                i = i[has]
                rank[i], to[i] = self._pairs(sym[i], sym[i + 1])
        symbols, owner = np.concatenate(out_sym or [sym]), np.concatenate(out_word or [word])
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.cumsum(np.bincount(owner, minlength=len(lengths)))

    def _safe(self, sym: np.ndarray, word: np.ndarray, to: np.ndarray, hit: np.ndarray, least: np.ndarray) -> np.ndarray:
        """hit, but only the first of words in which a merge makes a pair of its own rank or a smaller one."""
        first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
        if first.all():
            return hit
        made = to[hit]
        # to the left stands what the merge before has made, if that is next to this one
        joins = np.r_[False, hit[1:] == hit[:-1] + 2]
        left = np.where(joins, np.r_[0, made[:-1]], sym[np.maximum(hit - 1, 0)])
        has_left = (hit > 0) & (word[np.maximum(hit - 1, 0)] == word[hit])
        after = np.minimum(hit + 2, len(sym) - 1)
        has_right = (hit + 2 < len(sym)) & (word[after] == word[hit])
        bad = (has_left & (self._pairs(left, made)[0] <= least)) | (has_right & (self._pairs(made, sym[after])[0] <= least))
        if not bad.any():
            return hit
        return hit[first | ~np.isin(word[hit], word[hit[bad]])]

    def surface(self, ids: list[int]) -> str:
        """Text of pieces without the rule for the leading space; runs of byte pieces are read as UTF-8."""
        try:
            return "".join([self.shown[i] for i in ids])
        except TypeError:  # byte pieces
            pass
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.shown[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        return text[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else text


def split_words(text: str) -> list[str]:
    """Escaped words of a text: each a run of escaped spaces and what follows."""
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    if "" not in parts:
        return [SPACE + p for p in parts]
    words, run = [], 0
    for p in parts:
        run += 1
        if p:
            words.append(SPACE * run + p)
            run = 0
    if run:
        words.append(SPACE * run)
    return words


class Coder:
    """Encodes and decodes texts, remembering words."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}

    def learn(self, texts: list[list[str]]) -> None:
        wanted = set().union(*texts)
        fresh = list(wanted - self.ids.keys())
        if len(self.ids) + len(fresh) > REMEMBER:
            self.ids, self.text, fresh = {}, {}, list(wanted)
        digits, surface = self.model.digits, self.model.surface
        found = self.model.encode_words(fresh)
        self.ids.update(zip(fresh, [",".join([digits[i] for i in ids]) for ids in found], strict=True))
        self.text.update(zip(fresh, map(surface, found), strict=True))

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        split = [split_words(t) for t in texts]
        self.learn(split)
        for ws in split:
            ids = ",".join(map(self.ids.__getitem__, ws))
            yield ids.count(",") + 1 if ids else 0, ids, "".join(map(self.text.__getitem__, ws))[1:]


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _batches(texts: list[str], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) of every text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_path)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for at, to in _batches(texts):
                got = list(c.digest(texts[at:to]))
                ids = [[int(x) for x in g[1].split(",")] if g[1] else [] for g in got]
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), pa.array(ids, pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())], names=["doc_id", "ids", "decoded"])

    return text_only(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for at, to in _batches(texts):
                got = [(n, sha(ids), sha(text)) for n, ids, text in c.digest(texts[at:to])]
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_only(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
