"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by a score-ordered agenda.

Encoding. A text is normalised (a space before it, spaces become U+2581) and starts as one symbol per character. All
adjacent pairs of symbols whose concatenation is a piece wait in an agenda, highest score first, then leftmost. The top
pair is merged unless one of its symbols has changed since; the merged symbol's two new pairs join the agenda. Symbols
that are no piece become the pieces of their UTF-8 bytes. Merges never cross a place that no piece spans: before a run of
U+2581 that follows other text (if no piece holds one inside) and around characters that occur in no longer piece. A text
is cut there, and the agenda runs once for each distinct stretch that a worker meets.

Decoding. Pieces are concatenated, U+2581 becomes a space, one leading space goes, runs of byte pieces become their
characters, and each byte of no valid character becomes U+FFFD.

Both run in Arrow batches and are checked there against the sentencepiece library: every unit when a worker first meets it
(all new units of a batch in one text, which checks the cuts too), and every row's decoded text. A difference fails the job.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stretches up to SHORT characters are merged ROWS at a time. Between batches about twice UNITS units, of at
#: most LONGEST_UNIT characters each, stay known: those of the present generation and of the one before.
SHORT, ROWS = 32, 20_000
UNITS, LONGEST_UNIT = 500_000, 64
#: Pairs of symbols are looked up in 2^SLOT_BITS slots by a multiplied key; a slot with several pairs says SHARED.
SLOT_BITS, FACTOR, SHARED = 20, np.uint64(0x9E3779B97F4A7C15), -2
SPACE = "▁"
#: Field numbers and values of the published model format (fixed values).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BPE = 3, 2
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 2, 3, 4, 5, 6

#: What a control piece decodes to before it goes: it ends a run of bytes.
CUT = chr(0xD800)

codecs.register_error("graphloom-bytewise", lambda e: ("�", e.start + 1))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Codec:
    """A vocabulary's encoder and decoder. Only BPE models without character maps, user-defined pieces and space removal."""

    def __init__(self, path: str, check: bool = True):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer, normal = (dict(_fields(dict(model).get(k, b""))) for k in (TRAINER, NORMALIZER))
        pieces = [dict(_fields(v)) for k, v in model if k == PIECES]
        kinds = [p.get(3, 1) for p in pieces]
        self.dummy = bool(normal.get(DUMMY_PREFIX, 1))
        plain = not normal.get(CHARSMAP) and not normal.get(REMOVE_EXTRA, 1) and normal.get(ESCAPE, 1)
        if trainer.get(MODEL_TYPE) != BPE or not plain or USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError(f"{path} is not a BPE model with plain normalisation")
        self.pieces = [p[1].decode() for p in pieces]
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 1}
        self.rank = {p: -struct.unpack("<f", pieces[i].get(2, bytes(4)))[0] for p, i in self.ids.items()}
        self.unknown = kinds.index(UNKNOWN)
        bytes_ = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.byte_ids = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.texts = [CUT if k == CONTROL else " ⁇ " if k == UNKNOWN else p.replace(SPACE, " ") for p, k in zip(self.pieces, kinds, strict=True)]
        for b, i in bytes_.items():  # bytes beyond ASCII wait as lone surrogates until their characters are whole
            self.texts[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        longer = [p for p in self.ids if len(p) > 1]
        joined = {c for p in longer for c in p}
        self.cut_at_spaces = self.dummy and self.byte_ids is not None and not any(SPACE in p.lstrip(SPACE) for p in longer)
        if self.cut_at_spaces:
            whole = f"{SPACE}*[{re.escape(''.join(sorted(joined - {SPACE})))}]+"
            self.stretch = re.compile(f"{whole}|{SPACE}+|.", re.S)
        else:
            whole = f"[{re.escape(''.join(sorted(joined)))}]+"
            self.stretch = re.compile(f"{whole}|.", re.S)
        self.whole = re.compile(whole)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.apart = next(c for c in map(chr, (10, *range(10), *range(11, 32))) if c not in joined)
        self.apart_ids = [np.array(self.agenda(c), "<i4").tobytes() for c in (SPACE, self.apart)]
        self.library = None
        if check and self.cut_at_spaces:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        # The agendas of many stretches: symbols are piece ids, characters that are no piece have ids from len(pieces) on.
        odd = sorted(joined - self.ids.keys())
        symbol = self.ids | {c: len(self.pieces) + k for k, c in enumerate(odd)}
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for c in joined:
            self.symbol_of[ord(c)] = symbol[c]
        self.width = len(self.pieces) + len(odd) + 1
        pairs = sorted((symbol[p[:k]] * self.width + symbol[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.pair_keys = np.array([k for k, _ in pairs] + [2**62])
        self.pair_piece = np.array([i for _, i in pairs] + [0], np.int32)
        self.pair_rank = np.array([self.rank[self.pieces[i]] for _, i in pairs] + [np.inf])
        slots, first, n = np.unique(self._slot(self.pair_keys[:-1]), return_index=True, return_counts=True)
        self.slots = np.full(1 << SLOT_BITS, len(pairs), np.int32)
        self.slots[slots] = np.where(n > 1, SHARED, first)

    def agenda(self, text: str) -> list[int]:
        """The ids of a stretch of normalised text, by merging the best adjacent pair until none is left."""
        symbols: list[str] = list(text)
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        end, rank = len(symbols), self.rank
        waiting = [(rank[p], i, i + 1, p) for i, p in enumerate(map("".join, zip(symbols, symbols[1:], strict=False))) if p in rank]
        heapq.heapify(waiting)
        while waiting:
            _, left, right, piece = heapq.heappop(waiting)
            # A pair is stale if a symbol was merged away (empty) or has grown since.
            if not symbols[left] or not symbols[right] or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(piece):
                continue
            symbols[left], symbols[right] = piece, ""
            after[left] = after[right]
            if after[left] < end:
                before[after[left]] = left
            for i, j in ((before[left], left), (left, after[left])):
                if i >= 0 and j < end and (pair := symbols[i] + symbols[j]) in rank:
                    heapq.heappush(waiting, (rank[pair], i, j, pair))
        found = []
        for s in filter(None, symbols):
            if s in self.ids:
                found.append(self.ids[s])
            elif self.byte_ids:
                found += [self.byte_ids[b] for b in s.encode()]
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)
        return found

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * FACTOR) >> np.uint64(64 - SLOT_BITS)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank (infinite for none) and the merged piece of pairs of symbols."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.width + right)
        at = self.slots[self._slot(key)]
        shared = at == SHARED
        at[shared] = np.searchsorted(self.pair_keys, key[shared])
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_rank[at], np.inf), np.where(hit, self.pair_piece[at], -1)

    def agendas(self, stretches: list[str]) -> list[bytes]:
        """`agenda` of many short stretches at once, packed: a row of a matrix holds the pairs of one, a round merges each row's best.

        A result is empty where a symbol is left that is no piece.
        """
        found: list[bytes] = [b""] * len(stretches)
        if not stretches:
            return found
        size = np.fromiter(map(len, stretches), np.int64)
        code = self.symbol_of[np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4")]
        row = np.repeat(np.arange(len(stretches)), size)
        symbols = np.full((len(stretches), int(size.max()) + 1), -1, np.int32)
        symbols[row, np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)] = code
        rows = np.arange(len(stretches))
        rank, piece = self._pairs(symbols[:, :-1], symbols[:, 1:])
        columns = np.arange(symbols.shape[1])
        while len(rows):
            best = rank.argmin(1)
            more = np.isfinite(rank[np.arange(len(rows)), best])
            ended = symbols[~more]
            ended[(ended >= len(self.pieces)).any(1)] = -1
            ends = 4 * np.cumsum((ended >= 0).sum(1))
            data = ended[ended >= 0].astype("<i4").tobytes()
            for r, i, j in zip(rows[~more].tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                found[r] = data[i:j]
            rows, symbols, rank, piece, best = rows[more], symbols[more], rank[more], piece[more], best[more]
            if not len(rows):
                break
            at = np.arange(len(rows))
            merged = piece[at, best]
            keep = columns <= best[:, None]
            shift = lambda m, rest: np.where(keep[:, : m.shape[1]], m, np.column_stack([m[:, 1:], np.full(len(m), rest, m.dtype)]))
            symbols = shift(symbols, -1)
            symbols[at, best] = merged
            rank, piece = shift(rank, np.inf), shift(piece, -1)
            rank[at, best], piece[at, best] = self._pairs(merged, symbols[at, best + 1])
            left = np.flatnonzero(best)
            b = best[left]
            rank[left, b - 1], piece[left, b - 1] = self._pairs(symbols[left, b - 1], merged[left])
        return found

    def _learn(self, units: set[str]) -> None:
        """Put the ids of units that are not known yet into `known`."""
        alone = list(filter(self.whole.fullmatch, units))
        fresh = set(alone)
        parts = [(u, self.stretch.findall(u)) for u in units - fresh]
        fresh.update(p for _, ps in parts for p in ps)
        short = sorted((p for p in fresh if len(p) <= SHORT and (len(p) > 1 or self.symbol_of[ord(p)] >= 0)), key=len)
        ids: dict[str, bytes] = {}
        for k in range(0, len(short), ROWS):
            ids |= zip(short[k : k + ROWS], self.agendas(short[k : k + ROWS]), strict=True)
        for p in fresh:
            if not ids.get(p):
                ids[p] = struct.pack(f"<{len(got := self.agenda(p))}i", *got)
        self.known.update(zip(alone, map(ids.__getitem__, alone), strict=True))
        for u, ps in parts:
            self.known[u] = b"".join(map(ids.__getitem__, ps))
        if self.library is not None:
            plain = [u for u in units if u[0] == SPACE != u[-1]]
            odd = [u for u in units if not u[0] == SPACE != u[-1]]
            for k in range(0, len(plain), 200):  # the library's own agenda is fast on short texts
                self._compare(plain[k : k + 200], "".join(plain[k : k + 200]))
            for k in range(0, len(odd), 200):
                self._compare(odd[k : k + 200])

    def _compare(self, units: list[str], joined: str = "") -> None:
        """Hold new units against the library, as one text: a character of no longer piece keeps apart what could merge.

        `joined` is the text of units that all begin, but do not end, with a space, and so need none.
        """
        apart, text = self.apart_ids[1], [SPACE, self.apart]
        want = list(self.apart_ids)
        if joined:
            text.append(joined)
            want += map(self.known.__getitem__, units)
        for u in () if joined else units:
            if u[0] != SPACE or text[-1][-1] == SPACE:
                text.append(self.apart)
                want.append(apart)
            text.append(u)
            want.append(self.known[u])
        theirs = self.library.encode("".join(text)[1:].replace(SPACE, " "), num_threads=1)
        if theirs != np.frombuffer(b"".join(want), "<i4").tolist():
            raise RuntimeError(f"the agenda and the sentencepiece library differ on one of {len(units)} units")

    def units(self, text: str | None) -> list[str]:
        """The normalised text in pieces that no merge spans."""
        if not text:
            return []
        if self.cut_at_spaces and "  " not in text and SPACE not in text and text[0] != " ":
            return (SPACE + text.replace(" ", " " + SPACE)).split(" ")
        text = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
        # Without byte pieces neighbouring unknown symbols share an id, so cuts would show.
        return self.stretch.findall(text) if self.byte_ids else [text]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, without begin and end; null and empty texts have none."""
        split = [self.units(t) for t in texts]
        if self.byte_ids is None:
            return [np.array(self.agenda(u[0]) if u else [], "<i4") for u in split]
        if len(self.known) > UNITS:
            self.known, self.older = {}, self.known
        fresh = set().union(*split).difference(self.known)
        seen = fresh.intersection(self.older)
        self.known.update((u, self.older[u]) for u in seen)
        fresh -= seen
        long = [u for u in fresh if len(u) > LONGEST_UNIT]
        self._learn(fresh)
        found = [np.frombuffer(b"".join(map(self.known.__getitem__, u)), "<i4") for u in split]
        for unit in long:
            del self.known[unit]
        return found

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.texts.__getitem__, ids))
        if self.dummy and self.pieces[next((i for i in ids if i not in self.control), 0)].startswith(SPACE):
            text = text.lstrip(CUT)[1:]
        try:
            text.encode()
        except UnicodeEncodeError:
            return "".join(run.encode("utf-8", "surrogateescape").decode("utf-8", "graphloom-bytewise") for run in text.split(CUT))
        return text


@cache
def codec(path: str, check: bool = True) -> Codec:
    """One for all tasks of a Python worker, so that a task begins with the units that earlier ones met."""
    return Codec(path, check)


def slices(texts: pd.Series, size: int = 1 << 20) -> Iterator[list[str | None]]:
    """A batch in runs of texts of about `size` characters in all, so that lists of words stay small."""
    at = 0
    length = texts.str.len().fillna(0).cumsum().to_numpy()
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(length, (length[at - 1] if at else 0) + size, "right")))
        yield texts.iloc[at:end].tolist()
        at = end


def encode_decode(docs: DataFrame, model: str, text: str = "text", check: bool = True) -> DataFrame:
    """`docs` with `pieces`: a struct of `ids` (array of int) and `decoded` (the text that the ids decode to).

    Null and empty texts have no ids and decode to ''. White space, U+2581, control characters and strings of special
    pieces are ordinary text. A text is never cut off: very long ones take memory by their own length. Ties of score go
    to the leftmost pair. Repeated rows and keys are kept; an empty table gives an empty result; other columns pass
    unchanged, but one named `pieces` is replaced. With `check`, what a worker meets for the first time is encoded by the
    sentencepiece library too, and each row's ids are decoded by it; a difference fails the job.
    """

    @F.pandas_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(model, check)
        for batch in batches:
            for texts in slices(batch):
                ids = own.encode(texts)
                plain = [i.tolist() for i in ids]
                decoded = list(map(own.decode, plain))
                if own.library is not None and [own.library.decode(i) for i in plain] != decoded:
                    raise RuntimeError("the decoder and the sentencepiece library differ")
                yield pd.DataFrame({"ids": ids, "decoded": decoded})

    return docs.withColumn("pieces", run(F.col(text)))


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, `n_tokens`, `ids_sha256` of the decimal ids joined by commas, `decoded_sha256`. Cases as `encode_decode`."""
    found = encode_decode(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), model)
    ids = F.concat_ws(",", F.col("pieces.ids").cast("array<string>"))
    return found.select(
        F.col("key").alias(key),
        F.size("pieces.ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("pieces.decoded"), 256).alias("decoded_sha256"),
    )
