"""SentencePiece encoding and decoding: pieces found through a suffix array, edges relaxed by position.

The model's pieces are byte-pair merges, so "relaxing" keeps, at every position, the one
edge that byte-pair encoding itself would end there with. A token sequence is the encoding
of its text exactly when each token may follow the one before it; the edge into a position
is therefore decided from the edge into its own start.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelloom.llm import spans

BLANK = "▁"
LONGEST = 16
SLICE_BYTES = 2 << 20
# With so few parts left, positions are relaxed one by one.
FEW = 8
UNIT = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
_SLOTS = 21


class Vocabulary:
    """Pieces of a model with what encoding needs; built once in each worker process."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.surface: list[bytes] = []
        normal = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append(b"")
            else:
                normal[piece] = i
                self.surface.append(piece.replace(BLANK, " ").encode())
        self.unknown = n
        score = {p: sp.get_score(i) for p, i in normal.items()}
        if any(len(p) > LONGEST or "\n" in p or BLANK in p.lstrip(BLANK) for p in normal):
            raise ValueError("pieces must be at most 16 characters, on one line, with blanks only in front")
        chars = sorted({c for p in normal for c in p})
        if any(c not in normal for c in chars):
            raise ValueError("every character of a piece must itself be a piece")
        self.codes = np.zeros(0x110000, np.uint16)
        self.codes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        # Characters come first in rank, then merges by falling score.
        merged = sorted((p for p in normal if len(p) > 1), key=lambda p: (-score[p], normal[p]))
        rank = np.zeros(n + 1, np.int64)
        for r, p in enumerate([*chars, *merged]):
            rank[normal[p]] = r
        self.rank = rank
        self.left = np.arange(n + 1, dtype=np.int32)
        self.right = np.arange(n + 1, dtype=np.int32)
        reachable = [normal[c] for c in chars]
        pairs = {}
        for p in merged:
            for k in range(1, len(p)):
                if p[:k] in normal and p[k:] in normal:
                    pairs[(normal[p[:k]] << 16) | normal[p[k:]]] = normal[p]
            ends = merge(p, normal, rank)
            if ends is not None:
                self.left[normal[p]], self.right[normal[p]] = ends
                reachable.append(normal[p])
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_rank = keys, rank[[pairs[k] for k in keys]]
        self.lengths = np.array([len(sp.id_to_piece(i)) for i in reachable])
        self.ids = np.array(reachable, np.int32)
        self.blocks = {}
        for size in range(1, LONGEST + 1):
            own = self.ids[self.lengths == size]
            if len(own):
                text = "".join(sp.id_to_piece(int(i)) for i in own)
                self.blocks[size] = (own, self.codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)].reshape(len(own), size))
        self.seen_keys = np.full(1 << _SLOTS, -1, np.int64)
        self.seen = np.zeros(1 << _SLOTS, bool)
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in self.surface])])
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)

    def may_follow(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether byte-pair encoding leaves the two tokens side by side. Answers are remembered."""
        key = (before.astype(np.int64) << 16) | token
        slot = ((key * 0x9E3779B1) >> 8) & ((1 << _SLOTS) - 1)
        known = self.seen_keys[slot] == key
        answer = self.seen[slot]
        if not known.all():
            fresh, back = np.unique(key[~known], return_inverse=True)
            found = self._walk(fresh >> 16, fresh & 0xFFFF)
            answer[~known] = found[back]
            slot = ((fresh * 0x9E3779B1) >> 8) & ((1 << _SLOTS) - 1)
            # Two new keys may meet in one slot; the last written key is the one that answers for it.
            self.seen_keys[slot] = fresh
            stays = self.seen_keys[slot] == fresh
            self.seen[slot[stays]] = found[stays]
        return answer

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the two tokens' merges, latest first; no merge across their border may come before the one undone."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.flatnonzero((a != self.unknown) & (b != self.unknown))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            key = (x << 16) | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == key) & (self.pair_rank[at] < most)
            good[live[crossed]] = False
            live, x, y = live[~crossed], x[~crossed], y[~crossed]
            x_in, y_in = self.right[x] != x, self.left[y] != y
            first = np.where(x_in & y_in, self.rank[x] > self.rank[y], x_in)
            limit[live] = np.where(first, self.rank[x], self.rank[y] + 1)
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
            live = live[x_in | y_in]
        return good


def merge(piece: str, ids: dict[str, int], rank: np.ndarray) -> tuple[int, int] | None:
    """The last two tokens that byte-pair encoding joins into the piece; None where it ends elsewhere."""
    parts = list(piece)
    while len(parts) > 2:
        joined = [(rank[ids[x + y]], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ids]
        if not joined:
            return None
        _, i = min(joined)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return (ids[parts[0]], ids[parts[1]]) if len(parts) == 2 else None


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def pack(chars: np.ndarray) -> np.ndarray:
    """Rows of four 16-bit codes as one number, in the same order."""
    c = chars.astype(np.uint64)
    return (c[:, 0] << np.uint64(48)) | (c[:, 1] << np.uint64(32)) | (c[:, 2] << np.uint64(16)) | c[:, 3]


class SuffixArray:
    """Positions of a text in the order of the 16 characters that follow, built by doubling ranks (4, 8, 16)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        wide = np.zeros(n + 2 * LONGEST, np.uint16)
        wide[:n] = codes
        w = wide.astype(np.uint64)
        four = (w[:-3] << np.uint64(48)) | (w[1:-2] << np.uint64(32)) | (w[2:-1] << np.uint64(16)) | w[3:]
        self.u4, r4 = np.unique(four[:n + LONGEST + 8], return_inverse=True)
        eight = (r4[:n + LONGEST].astype(np.int64) << 32) | r4[4:n + LONGEST + 4]
        self.u8, r8 = np.unique(eight, return_inverse=True)
        sixteen = (r8[:n].astype(np.int64) << 32) | r8[8:n + 8]
        self.order = np.argsort(sixteen)
        self.sorted = sixteen[self.order]

    def _four(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.zeros((len(chars), 4), np.uint16)
        high = np.full((len(chars), 4), 0xFFFF, np.uint16)
        low[:, :chars.shape[1]] = high[:, :chars.shape[1]] = chars
        return np.searchsorted(self.u4, pack(low)), np.searchsorted(self.u4, pack(high), "right")

    def _eight(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self._four(chars[:, :4])
        low, high = low.astype(np.int64), high.astype(np.int64)
        if chars.shape[1] <= 4:
            return np.searchsorted(self.u8, low << 32), np.searchsorted(self.u8, high << 32)
        low2, high2 = self._four(chars[:, 4:8])
        start = np.searchsorted(self.u8, (low << 32) | low2)
        return start, np.where(high > low, np.searchsorted(self.u8, (low << 32) | high2), start)

    def ranges(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last place in the order where each row of characters occurs."""
        low, high = (x.astype(np.int64) for x in self._eight(chars[:, :8]))
        if chars.shape[1] <= 8:
            return np.searchsorted(self.sorted, low << 32), np.searchsorted(self.sorted, high << 32)
        low2, high2 = self._eight(chars[:, 8:16])
        start = np.searchsorted(self.sorted, (low << 32) | low2)
        return start, np.where(high > low, np.searchsorted(self.sorted, (low << 32) | high2), start)


def edges(vocab: Vocabulary, codes: np.ndarray) -> np.ndarray:
    """Row L-1, column i: the piece of L characters that starts at i, or -1. Filling the table sorts edges by position."""
    index = SuffixArray(codes)
    table = np.full((LONGEST, len(codes)), -1, np.int16)
    for size, (ids, chars) in vocab.blocks.items():
        low, high = index.ranges(chars)
        count = high - low
        total = int(count.sum())
        if total:
            at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
            table[size - 1, index.order[at]] = np.repeat(ids, count)
    return table


def relax(vocab: Vocabulary, table: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end position, token) of the encoding's tokens in text order, for units [start, end) that tile the text."""
    n = len(codes)
    unit = np.repeat(np.arange(len(starts)), ends - starts)
    rest = ends[unit] - np.arange(n)
    crossed = np.zeros(n + 1, np.int64)
    for size in range(2, LONGEST + 1):
        row = table[size - 1]
        row[rest < size] = -1
        at = np.flatnonzero(row >= 0)
        crossed += np.bincount(at + 1, minlength=n + 1)[:n + 1] - np.bincount(at + size, minlength=n + 1)[:n + 1]
    # Where no piece crosses a border, encoding falls apart there: parts stay short however long a unit is.
    border = np.cumsum(crossed)[:n] == 0
    border[starts[starts < n]] = True
    begin = np.flatnonzero(border)
    length = np.diff(np.concatenate([begin, [n]]))
    last = np.full(n, -1, np.int32)
    size_of = np.zeros(n, np.int8)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    single = np.where(codes > 0, table[0].astype(np.int32), vocab.unknown)
    live = len(begin)
    step = 0
    while True:
        step += 1
        live = int(np.searchsorted(-length[:live], -step, "right"))
        if not live:
            break
        if live <= FEW:
            for a, n_chars in zip(begin[:live].tolist(), length[:live].tolist()):
                relax_alone(vocab, table, single, last, size_of, a, a + step, a + n_chars)
            break
        end = begin[:live] + step
        open_ = np.arange(live)
        for size in range(min(step, LONGEST), 0, -1):
            at = end[open_] - size
            token = single[at] if size == 1 else table[size - 1, at].astype(np.int32)
            ok = token >= 0
            if size < step:
                some = np.flatnonzero(ok)
                ok[some] = vocab.may_follow(last[at[some] - 1], token[some])
            won = open_[ok]
            last[end[won] - 1] = token[ok]
            size_of[end[won] - 1] = size
            open_ = open_[~ok]
            if not len(open_):
                break
    chosen = np.zeros(n, bool)
    at, stop = begin + length, begin
    while len(at):
        chosen[at - 1] = True
        at = at - size_of[at - 1]
        more = at > stop
        at, stop = at[more], stop[more]
    where = np.flatnonzero(chosen)
    return where, last[where]


def relax_alone(vocab: Vocabulary, table: np.ndarray, single: np.ndarray, last: np.ndarray, size_of: np.ndarray, begin: int, first: int, stop: int) -> None:
    """The same for the end positions first .. stop of one long part, one after another: array calls pay only for many parts at once."""
    known: dict[int, bool] = {}
    done = last[begin:first - 1].tolist()
    for low in range(first, stop + 1, 1 << 15):
        high = min(low + (1 << 15), stop + 1)
        base = max(begin, low - LONGEST)
        starts = table[:, base:high].copy()
        starts[0] = 0
        rows = starts.T.tolist()
        ones = single[base:high].tolist()
        sizes = []
        for end in range(low, high):
            for size in range(min(LONGEST, end - begin), 0, -1):
                token = ones[end - size - base] if size == 1 else rows[end - size - base][size - 1]
                if token < 0:
                    continue
                if size < end - begin:
                    pair = (done[end - size - 1 - begin] << 16) | token
                    if pair not in known:
                        known[pair] = bool(vocab.may_follow(np.array([pair >> 16]), np.array([token]))[0])
                    if not known[pair]:
                        continue
                done.append(token)
                sizes.append(size)
                break
        last[low - 1:high - 1] = done[low - 1 - begin:high - 1 - begin]
        size_of[low - 1:high - 1] = sizes


def encode_units(vocab: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all units one after another, and each unit's offsets among them."""
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(units) + 1, np.int64)
    codes = vocab.codes[points]
    at = np.concatenate([[0], np.cumsum([len(u) for u in units])])
    where, token = relax(vocab, edges(vocab, codes), codes, at[:-1], at[1:])
    width = np.ones(len(token), np.int64)
    unknown = np.flatnonzero(token == vocab.unknown)
    point = points[where[unknown]]
    width[unknown] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
    out = np.repeat(token, width)
    first = np.concatenate([[0], np.cumsum(width)])
    for i, p in zip(unknown, point):
        raw = chr(p).encode("utf-8", "surrogatepass")
        out[first[i]:first[i] + len(raw)] = vocab.byte_ids[list(raw)]
    return out, first[np.searchsorted(where, at)]


def encode_texts(vocab: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts one after another and each text's offsets. Equal words are encoded once per call."""
    known: dict[str, int] = {}
    used: list[int] = []
    counts = []
    for text in texts:
        found = UNIT.findall(BLANK + text.replace(" ", BLANK)) if text else []
        used.extend([known.setdefault(u, len(known)) for u in found])
        counts.append(len(found))
    tokens, at = encode_units(vocab, list(known))
    used = np.array(used, np.int64)
    size = at[used + 1] - at[used]
    total = int(size.sum())
    ids = tokens[np.repeat(at[used] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)] if total else np.zeros(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(size)])
    return ids, ends[np.concatenate([[0], np.cumsum(counts)])]


def decode_ids(vocab: Vocabulary, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all sequences one after another and their offsets. The blank put in front is taken off again."""
    size = vocab.surface_at[ids + 1] - vocab.surface_at[ids]
    total = int(size.sum())
    raw = vocab.surface_bytes[np.repeat(vocab.surface_at[ids] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)] if total else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(size)])[at]
    drop = ends[:-1][ends[1:] > ends[:-1]]
    drop = drop[raw[drop] == 32] if len(drop) else drop
    keep = np.ones(len(raw), bool)
    keep[drop] = False
    taken = np.searchsorted(drop, ends)
    return raw[keep], ends - taken


def lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(documents: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ids (array of int), n_tokens and round_trip (the ids decode to the text) to the kept columns.

    `model` is the path of a SentencePiece byte-pair model; its bytes travel with the tasks.
    Null or empty text has no tokens. Whole texts are encoded, a few MB of them at a time or
    one longer text. Round trips are exact but for the blank sign U+2581, which decodes as a
    plain blank.
    """
    with open(model, "rb") as f:
        proto = f.read()

    def run(batches):
        vocab = vocabulary(proto)
        for batch in batches:
            column = batch.column(text)
            for first, stop, data, offsets in spans.slices(column, SLICE_BYTES):
                texts = column.slice(first, stop - first).fill_null("").to_pylist()
                ids, at = encode_texts(vocab, texts)
                back, ends = decode_ids(vocab, ids, at)
                same = np.diff(ends) == np.diff(offsets)
                if len(back) == len(data) and same.all():
                    wrong = np.flatnonzero(back != data)
                    same[np.unique(np.searchsorted(offsets, wrong, "right") - 1)] = False
                else:
                    same = np.array([bytes(back[ends[i]:ends[i + 1]]) == bytes(data[offsets[i]:offsets[i + 1]]) for i in range(stop - first)])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(first, stop - first) for c in keep], lists(ids, at), pa.array(np.diff(at)), pa.array(same)],
                    names=[*keep, "ids", "n_tokens", "round_trip"])
            pa.default_memory_pool().release_unused()

    schema = T.StructType([*[documents.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the text of each id sequence. Null ids give an empty text; bytes that are no UTF-8 are replaced."""
    with open(model, "rb") as f:
        proto = f.read()

    def run(batches):
        vocab = vocabulary(proto)
        for batch in batches:
            texts = []
            for value in batch.column(ids):
                own = np.array([i for i in value.as_py() or [] if i is not None], np.int64)
                raw, _ = decode_ids(vocab, own, np.array([0, len(own)]))
                texts.append(raw.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = T.StructType([*[encoded.schema[c] for c in keep], T.StructField("text", T.StringType())])
    return encoded.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)
