"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

Encoding. Blanks become the mark U+2581 and one mark is put before the text. No piece holds a mark after another
character, so a text falls into words, each a run of marks and what follows it, that no merge can
cross. A batch's distinct words that the worker does not remember are encoded together: one flat array of symbols, one number
of the word beside it. Each round looks up every adjacent pair's rank, takes the smallest rank
of each word, merges its occurrences from the left, and drops words without any pair. Within one word and
round a merge may create a pair that outranks, or ties with, the one being merged; the library would
take that first. So an occurrence is merged in this round only if no earlier one in its word made
such a pair; the rest waits. That makes the result the library's, one merge after another. Words are
cut further between two characters that are adjacent in no piece.

A word that still has more than `LONG` symbols after `ROUNDS` rounds (a run of thousands of blanks can) is finished on its own with a
priority queue, in n log n steps and to the same result; all other words of the batch stay in the rounds.

A character outside the vocabulary is given as the pieces of its UTF-8 bytes.

Decoding joins the pieces' bytes, reads marks as blanks, drops the leading one, and replaces every
byte that is not valid UTF-8 by U+FFFD.

Defined cases: NULL is the empty text, whose ids are begin and end only. Repeated rows give equal ids.
Texts of any length are encoded whole. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.memory import Memory

MARK = "▁"
NO_RANK = np.int64(1) << 40
LONG, ROUNDS = 4096, 64
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_LOADED: dict[str, "Model"] = {}


def _pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file."""
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    spec = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces \
            or not spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
        raise ValueError("only byte-fallback BPE models with the identity normalisation are read")
    return [(p.piece, p.score, p.type) for p in proto.pieces]


class Model:
    """Tables of a model. Symbols are piece ids; characters that are no piece get numbers above them."""

    NORMAL, CONTROL, BYTE = 1, 3, 6

    def __init__(self, path: str):
        pieces = _pieces(path)
        self.size = len(pieces)
        self.begin = next(i for i, p in enumerate(pieces) if p[0] == "<s>")
        self.end = next(i for i, p in enumerate(pieces) if p[0] == "</s>")
        self.byte_id = np.zeros(256, "int64")
        self.bytes_of = [b""] * self.size
        self.is_byte = np.zeros(self.size, bool)
        normal = {}
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == self.BYTE:
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes_of[i], self.is_byte[i] = i, bytes([value]), True
            elif kind == self.NORMAL:
                normal[piece] = i
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
            elif kind != self.CONTROL:
                self.bytes_of[i] = " ⁇ ".encode()
        if any(MARK in piece.lstrip(MARK) for piece in normal):
            raise ValueError("a piece holds a mark after another character")
        scores = sorted({pieces[i][1] for i in normal.values()}, reverse=True)
        rank = {score: r for r, score in enumerate(scores)}
        self.chars = {c: normal[c] for c in normal if len(c) == 1}
        extra = {}
        for piece in normal:
            for c in piece:
                if c not in self.chars:
                    extra.setdefault(c, self.size + 1 + len(extra))
        self.chars |= extra
        self.unknown = self.size                      # a character that is in no piece
        keys, ranks, made = [], [], []
        symbol = {**normal, **extra}
        for piece, i in normal.items():
            for at in range(1, len(piece)):
                left, right = symbol.get(piece[:at]), symbol.get(piece[at:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    ranks.append(rank[pieces[i][1]])
                    made.append(i)
        order = np.argsort(keys)
        self.pair_keys = np.array(keys, "int64")[order]
        self.pair_rank, self.pair_made = np.array(ranks, "int64")[order], np.array(made, "int64")[order]
        adjacent = {(ord(p[i]) << 21) | ord(p[i + 1]) for p in normal for i in range(len(p) - 1)}
        self.adjacent = np.array(sorted(adjacent), "int64")
        self.points = np.array(sorted(map(ord, self.chars)), "int64")
        self.point_symbol = np.array([self.chars[chr(c)] for c in self.points], "int64")
        self.memory = Memory()

    # Tables ---------------------------------------------------------------

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; `NO_RANK` where it makes no piece."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == key
        return np.where(found, self.pair_rank[at], NO_RANK), self.pair_made[at]

    # Encoding -------------------------------------------------------------

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, self.point_symbol[at], self.unknown)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and their number per word."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype("int64")
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), "int64", len(words)))
        symbols = self._symbols(points)
        # Segments: words, cut where two characters are adjacent in no piece.
        joined = np.zeros(len(points), bool)
        if len(points) > 1:
            key = points[:-1] << 21 | points[1:]
            at = np.minimum(np.searchsorted(self.adjacent, key), len(self.adjacent) - 1)
            joined[1:] = (self.adjacent[at] == key) & (owner[1:] == owner[:-1])
        segment = np.cumsum(~joined) - 1 if len(points) else owner
        symbols, place = self._merged(symbols, segment)
        # Bytes of characters that are no piece.
        outside = symbols >= self.size
        counts = np.ones(len(symbols), "int64")
        ids = symbols
        if outside.any():
            encoded = [chr(points[p]).encode("utf-8", "surrogatepass") for p in place[outside]]
            counts[outside] = list(map(len, encoded))
            ids = np.repeat(symbols, counts)
            ids[np.repeat(outside, counts)] = self.byte_id[np.frombuffer(b"".join(encoded), "uint8")]
        per_word = np.bincount(owner[place], weights=counts, minlength=len(words)).astype("int64")
        return ids, per_word

    def _merged(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left when no pair remains, and the place of each one's first character."""
        place = np.arange(len(symbols))
        done_symbols, done_places = [], []
        rounds = 0
        while len(symbols):
            if len(symbols) < 2:
                break
            same = segment[1:] == segment[:-1]
            rank, made = self.pairs(symbols[:-1], symbols[1:])
            rank[~same] = NO_RANK
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(np.append(rank, NO_RANK), starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            # Words without a pair are done and leave.
            alive = lowest < NO_RANK
            if not alive.all():
                stay = np.repeat(alive, sizes)
                done_symbols.append(symbols[~stay])
                done_places.append(place[~stay])
                inner = stay[:-1] & stay[1:]
                # Pairs between two kept symbols that were neighbours; a removed word leaves a border.
                symbols, place, segment = symbols[stay], place[stay], segment[stay]
                kept_rank = np.where(inner, rank, NO_RANK)[stay[:-1]]
                kept_made = made[stay[:-1]]
                rank = kept_rank[:max(len(symbols) - 1, 0)]
                made = kept_made[:max(len(symbols) - 1, 0)]
                lowest, sizes = lowest[alive], sizes[alive]
                if not len(symbols):
                    break
            best = np.repeat(lowest, sizes)[:-1]
            hit = np.flatnonzero(rank == best)
            # Leftmost first: of overlapping occurrences every second one of a run is merged.
            fresh = np.concatenate([[True], np.diff(hit) != 1])
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            # An occurrence that makes a pair of the same or a better rank ends its word's round.
            value, of = made[hit], segment[hit]
            earlier = np.concatenate([[False], (hit[1:] == hit[:-1] + 2) & (of[1:] == of[:-1])])
            before = np.maximum(hit - 1, 0)
            left = np.where(earlier, np.concatenate([[0], value[:-1]]), symbols[before])
            left_rank = np.where((hit > 0) & (segment[before] == of), self.pairs(left, value)[0], NO_RANK)
            after = np.minimum(hit + 2, len(symbols) - 1)
            right_rank = np.where((hit + 2 < len(symbols)) & (segment[after] == of),
                                  self.pairs(value, symbols[after])[0], NO_RANK)
            breaks = np.minimum(left_rank, right_rank) <= rank[hit]
            if breaks.any():
                total = np.cumsum(breaks) - breaks
                first = np.concatenate([[True], of[1:] != of[:-1]])
                base = np.maximum.accumulate(np.where(first, total, 0))
                allowed = total == base
                hit, value = hit[allowed], value[allowed]
            symbols = symbols.copy()
            symbols[hit] = value
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, place, segment = symbols[keep], place[keep], segment[keep]
            rounds += 1
            if rounds == ROUNDS:
                bounds = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]]))
                long = np.diff(bounds) > LONG
                for begin, end in zip(bounds[:-1][long], bounds[1:][long]):
                    left_over, at = self._queued(symbols[begin:end].tolist())
                    done_symbols.append(np.array(left_over, "int64"))
                    done_places.append(place[begin:end][at])
                if long.any():
                    stay = np.repeat(~long, np.diff(bounds))
                    symbols, place, segment = symbols[stay], place[stay], segment[stay]
        done_symbols.append(symbols)
        done_places.append(place)
        symbols, place = np.concatenate(done_symbols), np.concatenate(done_places)
        order = np.argsort(place, kind="stable")
        return symbols[order], place[order]

    def _queued(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """One merge after another by a queue of (rank, place)."""
        n = len(symbols)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = following[i]
            if i >= 0 and j < n:
                key = symbols[i] << 20 | symbols[j]
                at = int(np.searchsorted(self.pair_keys, key))
                if at < len(self.pair_keys) and self.pair_keys[at] == key:
                    heapq.heappush(queue, (int(self.pair_rank[at]), i, symbols[i], symbols[j], int(self.pair_made[at])))
        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = following[i] if not gone[i] else n
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j] = made, True
            following[i] = following[j]
            if following[i] < n:
                previous[following[i]] = i
            if previous[i] >= 0:
                offer(previous[i])
            offer(i)
        left = [i for i in range(n) if not gone[i]]
        return [symbols[i] for i in left], left

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with begin and end ids."""
        self.memory.forget_if_full()
        # Words of a text without doubled blanks or marks are what stands between its blanks.
        marked, whole = self.memory.known(MARK), self.memory.known("")
        numbers = []
        for text in texts:
            if not text:
                words, known = [], whole
            elif "  " in text or MARK in text or text[0] == " ":
                words, known = _WORD.findall(MARK + text.replace(" ", MARK)), whole
            else:
                words, known = text.split(" "), marked
            numbers.append(np.fromiter(map(known.__getitem__, words), "int64", len(words)))
        self.memory.learn(self.encode_words)
        flat, sizes = self.memory.gather(numbers)
        ends = np.cumsum(sizes)
        out = []
        for end, size in zip(ends.tolist(), sizes.tolist()):
            ids = np.empty(size + 2, "<u4")
            ids[0], ids[-1] = self.begin, self.end
            ids[1:-1] = flat[end - size:end]
            out.append(ids)
        return out

    # Decoding -------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; begin and end ids have none."""
        joined = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        if joined.startswith(b" ") and self._leads_with_mark(ids):
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return _lenient(joined)

    def _leads_with_mark(self, ids: np.ndarray) -> bool:
        """Whether the first blank is a piece's mark; a blank byte piece is kept."""
        return next((not self.is_byte[i] for i in ids.tolist() if self.bytes_of[i]), False)


def _lenient(data: bytes) -> str:
    """UTF-8 in which every byte that starts no valid character becomes U+FFFD, in one pass."""
    out, at = [], 0
    while at < len(data):
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        try:
            out.append(data[at:at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("\ufffd")
            at += 1
    return "".join(out)


def model(path: str) -> Model:
    if path not in _LOADED:
        _LOADED[path] = Model(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, with_ids: bool = False, texts_at_once: int = 128) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, and its ids if asked for."""
    import pyarrow as pa
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(at, texts_at_once)
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), [len(i) for i in ids], [hashlib.sha256(i.tobytes()).hexdigest() for i in ids],
                           [hashlib.sha256(bpe.decode(i).encode("utf-8", "surrogatepass")).hexdigest() for i in ids]]
                if with_ids:
                    columns.append([i.astype("int32") for i in ids])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                                  for c, f in zip(columns, schema)], schema=schema)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)
