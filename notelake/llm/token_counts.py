"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split at ASCII white space, which the vocabulary's normalizer drops, so that every
piece can be encoded by itself and its result kept. A batch is cut by bytes, and a long text
goes through in slices that end at white space, so memory doesn't grow with a text.

The tokens of a piece come from the ``tokenizers`` library, or for plain Latin pieces from a
byte-pair merger with the same ranks. A merger that merges by the rank of the joined token gives
what the library gives if each token of the vocabulary, encoded alone, is one token; that is
tested once for each worker, and if it fails everything goes through the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, bytes_of, id_and_text, in_batches, small
from .hashing import SPACE, span_hashes, word_spans

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: A text is sliced beyond so many bytes, and the kept pieces are dropped beyond so many.
SLICE_BYTES, KEPT_PIECES = 1 << 18, 1_000_000

_LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ɏ"
#: Pieces for which Unicode versions and normal forms can't matter.
_PLAIN = re.compile(rf"[!-~{_LETTERS}]+")
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
#: The pre-tokenizer that _PARTS stands for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters and then punctuation other than an apostrophe: two parts.
_TAILED = re.compile(rb"([a-z]+)([!-&(-/:-@\[-`{-~]+)")
_SPACE_AT = re.compile(rb"[ \t\n\r\x0b\x0c]")
_END = b"\xff"  # never a byte of UTF-8


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceEncoder:
    """Ids of texts as the library gives them without added tokens."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.table = PieceTable()
        self.tails: dict[bytes, list[int]] = {}
        self.merger, self.ids = self._merger()
        self.whole = not self._drops_space()  # then texts can't be split
        self.ids = None if self.ids is None else self.ids.tolist()
        del self.spec  # only read above, and large

    def _drops_space(self) -> bool:
        steps = self.spec.get("pre_tokenizer") or {}
        return any(
            s.get("type") == "Split" and s.get("pattern", {}).get("Regex") == _PATTERN and s.get("behavior") == "Removed" and s.get("invert")
            for s in steps.get("pretokenizers", [steps])
        )

    def _merger(self):
        model, norm = self.spec["model"], self.spec.get("normalizer") or {}
        kinds = [s["type"] for s in norm.get("normalizers", [])]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout") or model.get("ignore_merges") or kinds != ["NFC", "Replace", "Lowercase"] or not self._drops_space():
            return None, None
        letters, vocab = byte_letters(), model["vocab"]

        def raw(token: str) -> bytes:
            end = token.endswith("</w>") and len(token) > 4
            return bytes(letters[c] for c in (token[:-4] if end else token)) + (_END if end else b"")

        try:
            order = [(raw(c), c) for c in letters] + [(raw(c + "</w>"), c + "</w>") for c in letters]
            for pair in model["merges"]:
                a, b = pair.split(" ") if isinstance(pair, str) else pair
                order.append((raw(a + b), a + b))
            ranks = {k: i for i, (k, _) in enumerate(order)}
            if len(ranks) != len(order):
                return None, None
            ids = np.array([vocab[t] for _, t in order], dtype="<u4")
            bpe = self.library.model
            for _, token in order[256:]:
                body = token[:-4] if token.endswith("</w>") else None
                # only tokens that end a word can be asked for alone: the library ends every word
                if body and [t.value for t in bpe.tokenize(body)] != [token]:
                    return None, None
            if not self._inner_tokens_whole(order, model["merges"]):
                return None, None
        except KeyError:
            return None, None
        import tiktoken

        return tiktoken.Encoding("pieces", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe, ids

    @staticmethod
    def _inner_tokens_whole(order, merges) -> bool:
        """Whether the merges, in their order, make one token of each token that doesn't end a word."""
        rank = {}
        for i, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            rank[a, b] = i
        for _, token in order[512:]:
            if token.endswith("</w>"):
                continue
            parts = list(token)
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
                if (parts[best], parts[best + 1]) not in rank:
                    return False
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return True

    def _piece(self, piece: bytes) -> list[int]:
        core = piece.lower()
        if self.merger is not None:
            encode, to = self.merger.encode_single_piece, self.ids
            if core.isalpha():  # of ASCII letters alone
                return [to[i] for i in encode(core + _END)]
            if (m := _TAILED.fullmatch(core)) and b"<|" not in core:
                head, tail = m.groups()
                if tail not in self.tails:
                    self.tails = {} if len(self.tails) > 10_000 else self.tails
                    self.tails[tail] = [to[i] for i in encode(tail + _END)]
                return [to[i] for i in encode(head + _END)] + self.tails[tail]
            text = piece.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text) and b"<|" not in piece:
                return [to[i] for p in _PARTS.findall(text.lower()) for i in encode(p.encode() + _END)]
        return self.library.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _segments(self, texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
        """Buffers of (number of the text, part of it), about SLICE_BYTES each, cut at white space."""
        held, size = [], 0
        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = len(text)
                if end - at > SLICE_BYTES:
                    cut = next(_SPACE_AT.finditer(text, at + SLICE_BYTES), None)
                    end = cut.end() if cut else end
                held.append((k, text[at:end]))
                size, at = size + end - at, end
                if size >= SLICE_BYTES:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def batch(self, texts: list[bytes], want_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of ids of the texts, and (unless want_ids is false) all ids one after another."""
        counts, out = np.zeros(len(texts), dtype=np.int64), []
        if self.whole:
            for k, text in enumerate(texts):
                ids = self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids if text else []
                counts[k] = len(ids)
                out.append(np.array(ids, dtype="<u4"))
            return counts, np.concatenate(out) if out and want_ids else np.zeros(0, "<u4")
        for held in self._segments(texts):
            buffer = b" ".join([p for _, p in held])
            data = np.frombuffer(buffer, dtype=np.uint8)
            starts, ends = word_spans(data, ~SPACE)
            if not len(starts):
                continue
            where = self.table.find(span_hashes(data, starts, ends), data, starts, ends, lambda i: self._piece(buffer[starts[i] : ends[i]]))
            lengths = self.table.lengths[where]
            begins = np.cumsum([0] + [len(p) + 1 for _, p in held[:-1]])
            owner = np.array([k for k, _ in held])[np.searchsorted(begins, starts, side="right") - 1]
            counts += np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64)
            if want_ids:
                total = int(lengths.sum())
                first = np.cumsum(lengths, dtype=np.int64) - lengths
                out.append(self.table.pool[np.repeat(self.table.offsets[where] - first, lengths) + np.arange(total)])
        return counts, np.concatenate(out) if out else np.zeros(0, "<u4")


class PieceTable:
    """Ids by piece, in arrays, so that a buffer's pieces are looked up at once: by a 64-bit hash, and then by their bytes.

    Of pieces with the same hash the first is kept to be found; the others get an entry each time. It starts anew beyond KEPT_PIECES.
    """

    #: Bytes of a piece that are compared in arrays; longer pieces are compared one by one.
    WIDTH = 16

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.n = self.used = 0
        self.bits = 16
        #: The entry in each slot of a hash table, -1 for none.
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.hashes, self.words = np.zeros(1 << 14, np.uint64), np.zeros((1 << 14, self.WIDTH // 8), np.uint64)
        self.offsets, self.lengths, self.sizes = (np.zeros(1 << 14, np.int32) for _ in range(3))
        self.long: dict[int, bytes] = {}
        self.pool = np.zeros(1 << 16, dtype="<u4")

    def _first_bytes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), self.WIDTH), np.uint8)
        for j in range(self.WIDTH):  # a byte of each piece at a time
            some = np.flatnonzero(sizes > j)
            out[some, j] = data[starts[some] + j]
        return out.view(np.uint64)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """The first entry of each hash, or -1."""
        mask, slot = np.int64((1 << self.bits) - 1), self._slots(h)
        got = self.at[slot]
        left = np.flatnonzero((got >= 0) & (self.hashes[got] != h))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            got[left] = self.at[slot[left]]
            left = left[(got[left] >= 0) & (self.hashes[got[left]] != h[left])]
        return got

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask, slot = np.int64((1 << self.bits) - 1), self._slots(h)
        while len(h):
            _, first = np.unique(slot, return_index=True)
            wins = np.zeros(len(h), dtype=bool)
            wins[first] = True
            wins &= self.at[slot] < 0
            self.at[slot[wins]] = entry[wins]
            h, entry, slot = h[~wins], entry[~wins], (slot[~wins] + 1) & mask

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        """a with place for n, and a quarter more where it has to grow."""
        return a if n <= len(a) else np.concatenate([a, np.zeros((max(n, len(a) + len(a) // 4) - len(a), *a.shape[1:]), a.dtype)])

    def find(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, make) -> np.ndarray:
        """The entry of each piece data[start:end] with its hash; make(i) gives the ids of piece i where it is new."""
        sizes = ends - starts
        words = self._first_bytes(data, starts, sizes)
        raw = lambda i: data[starts[i] : ends[i]].tobytes()
        got = self._probe(h)
        missing = np.flatnonzero(got < 0)
        if len(missing):
            fresh, first = np.unique(h[missing], return_index=True)
            if self.n + len(fresh) > KEPT_PIECES and self.n:
                self.clear()
                return self.find(h, data, starts, ends, make)
            entries = self._keep(missing[first], h, words, sizes, raw, make)
            if 2 * self.n > len(self.at):
                while 2 * self.n > 1 << self.bits:
                    self.bits += 1
                self.at = np.full(1 << self.bits, -1, np.int32)
                # of entries with one hash, the first is the one that was placed before
                known, at = np.unique(self.hashes[: self.n], return_index=True)
                self._place(known, at.astype(np.int32))
            else:
                self._place(fresh, entries)
            got[missing] = self._probe(h[missing])
        same = (self.sizes[got] == sizes) & (self.words[got] == words).all(axis=1)
        for i in np.flatnonzero(same & (sizes > self.WIDTH)).tolist():
            same[i] = self.long[int(got[i])] == raw(i)
        other = np.flatnonzero(~same)
        if len(other):
            got[other] = self._keep(other, h, words, sizes, raw, make)
        return got

    def _keep(self, pieces: np.ndarray, h: np.ndarray, words: np.ndarray, sizes: np.ndarray, raw, make) -> np.ndarray:
        """New entries of some pieces."""
        lists = [make(i) for i in pieces.tolist()]
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        ids = np.array([i for x in lists for i in x], dtype="<u4")
        n, used = self.n + len(pieces), self.used + len(ids)
        for name in ("hashes", "offsets", "lengths", "sizes", "words"):
            setattr(self, name, self._room(getattr(self, name), n))
        self.pool = self._room(self.pool, used)
        new = slice(self.n, n)
        self.hashes[new], self.lengths[new], self.sizes[new], self.words[new] = h[pieces], lengths, sizes[pieces], words[pieces]
        self.offsets[new] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : used] = ids
        entries = np.arange(self.n, n, dtype=np.int32)
        for e, i in zip(entries.tolist(), pieces.tolist()):
            if sizes[i] > self.WIDTH:
                self.long[e] = raw(i)
        self.n, self.used = n, used
        return entries


_encoders: dict[str, PieceEncoder] = {}


def encoder(name: str) -> PieceEncoder:
    """The encoder of a vocabulary file of ``public_tokenizers`` or of a path; one for each worker."""
    if name not in _encoders:
        import os

        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = str(public_tokenizers.path(name))
        _encoders[name] = PieceEncoder(path)
    return _encoders[name]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row.

    Null texts count as empty: 0 bytes, 0 tokens. Every row gives one row, repeated rows too; an
    empty table gives none. Columns other than doc_id and text aren't read.
    """
    schema = arrow_schema({"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in small(parts):
            texts = bytes_of(batch.column(1))
            n = encode.batch(texts, want_ids=False)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], schema=schema)

    return in_batches(id_and_text(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
