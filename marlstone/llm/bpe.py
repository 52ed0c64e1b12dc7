"""Byte-level BPE: a lazily determinised transducer for encoding and a state machine over UTF-8 for decoding.

Two tokens may stand side by side exactly if merging their joined bytes gives back these two tokens. The encoding of
a string is the one path of tokens in which all neighbours may. The transducer reads bytes and follows every open
path at once; a state is the set of open paths, and last tokens that allow the same continuations are one. A boundary
is certain once all open paths have come through it; the tokens up to there are emitted while the rest is still to be
read, so a pre-token of any length is encoded in a bounded window. Open paths began within the longest token, so the
boundary that they share is not far back. States and transitions are made when first needed and kept, within one bound
for all memories of a worker.

Decoding composes the UTF-8 automaton over whole tokens: each token maps a state to a state, once computed.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache, partial
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import FORGET

#: Bytes of the memories of a worker, by estimate; full ones are emptied, which costs time and changes no result.
MEMORY = 256 << 20
#: What an entry takes with its key, by estimate: of a state for itself and each path, of a transition, of what is known
#: of two tokens, of a pre-token for itself and each token.
_STATE, _PATH, _MOVE, _PAIR, _PIECE, _ID = 220, 40, 130, 110, 220, 8
#: Pairs of tokens that are remembered; they are hardly asked for again once states and classes are made of them.
MOST_PAIRS = 1 << 17
#: Bytes of a pre-token between two looks for a certain boundary.
LOOK = 512


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


#: Tokens below a node of the token tree up to which paths are told apart by what may follow only.
FEW = 2
#: Paths and transitions are kept as one number each: the upper bits for the last token (from the least class on) or the
#: state, the lower ones for the node or the token that ends plus one.
_BITS, _LOW, _LEAST = 24, (1 << 24) - 1, -1 - (1 << FEW)


class Transducer:
    """Encoder of one pre-token at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        # a tree of the tokens' bytes: child by node * 256 + byte, token of a node, nodes with children
        self._child: dict[int, int] = {}
        self._token = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if (to := self._child.get(key)) is None:
                    to = self._child[key] = len(self._token)
                    self._token.append(-1)
                node = to
            self._token[node] = rank
        self._inner = [False] * len(self._token)
        for key in self._child:
            self._inner[key >> 8] = True
        self._length = {v: len(k) for k, v in ranks.items()}
        self._same = {v: v for v in self._length}  # one object for each token, which all memories share
        # the tokens below a node, where they are few
        self._few: list[tuple[int, ...] | None] = [()] * len(self._token)
        for key in sorted(self._child, key=self._child.get, reverse=True):  # children before their parents
            node, to = key >> 8, self._child[key]
            below = self._few[to]
            if self._few[node] is not None:
                joined = None if below is None else (*self._few[node], *below, *([self._token[to]] if self._token[to] >= 0 else []))
                self._few[node] = joined if joined is not None and len(joined) <= FEW else None
        self._few[0] = None
        self._classes: dict[int, int] = {}
        self._beside: dict[int, bool] = {}
        self._trees: dict[bytes, tuple[bytes, bytes, bool] | None] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._depth = self._depths()
        self.reset()

    def _depths(self) -> np.ndarray:
        """Bytes from the root to each node of the tree."""
        depth = np.zeros(len(self._token), np.uint16)
        for key in sorted(self._child, key=self._child.get):  # parents before their children
            depth[self._child[key]] = depth[key >> 8] + 1
        return depth

    def reset(self) -> None:
        """Give up all memories."""
        # a path is the last token or -1 and the node of the token being read; a state is its open paths, oldest first
        start = (-1 - _LEAST << _BITS,)
        self._states = {start: 0}
        self._paths = [start]
        self._step: dict[int, int] = {}
        self._classes.clear()
        self._beside.clear()  # merges and edges of tokens stay: there are no more of them than tokens
        self.size = 0  # of the memories, by estimate

    def _merge_parts(self, data: bytes, least: int) -> list[bytes]:
        """Merging by rank down to ``least`` parts: the definition of what neighbours may be."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _tree(self, token: bytes) -> tuple[bytes, bytes, bool] | None:
        """The last merge of a token and whether all its merges run in the order of ranks; None if merging misses it."""
        if token in self._trees:
            return self._trees[token]
        parts = self._merge_parts(token, 2)
        got = None
        if len(parts) == 2 and parts[0] + parts[1] == token and parts[0] in self.ranks and parts[1] in self.ranks:
            left, right = parts
            tidy = all(len(p) == 1 or (self.ranks[p] < self.ranks[token] and (t := self._tree(p)) is not None and t[2]) for p in parts)
            got = (left, right, tidy)
        self._trees[token] = got
        return got

    def _edge(self, token: bytes, side: int) -> tuple[list[tuple[bytes, int]], bool]:
        """Pieces that stand at the left (0) or right (1) edge while a token forms, each with the rank that ends it."""
        known = self._edges[side]
        if (got := known.get(token)) is None:
            pieces, tidy, now, ends = [], True, token, 1 << 60
            while True:
                pieces.append((now, ends))
                if len(now) == 1:
                    break
                tree = self._tree(now)
                if tree is None:
                    tidy = False
                    break
                tidy &= tree[2]
                ends, now = self.ranks[now], tree[side]
            got = known[token] = (pieces[::-1], tidy)
        return got

    def _may_follow(self, last: int, token: int) -> bool:
        key = (last + 1) << 24 | token
        if (known := self._beside.get(key)) is None:
            if len(self._beside) >= MOST_PAIRS:
                self.size -= _PAIR * len(self._beside)
                self._beside.clear()
            self.size += _PAIR
            known = self._beside[key] = self._tried(None if last < 0 else self.bytes[last], self.bytes[token])
        return known

    def _tried(self, a: bytes | None, b: bytes) -> bool:
        if a is None:
            return len(b) == 1 or self._tree(b) is not None
        (left, tidy_a), (right, tidy_b) = self._edge(a, 1), self._edge(b, 0)
        if not (tidy_a and tidy_b):
            return self._merge_parts(a + b, 1) == [a, b]
        # merges across the boundary come to pass only between the pieces that meet there
        i = j = 0
        ranks = self.ranks
        while True:
            (x, ends_x), (y, ends_y) = left[i], right[j]
            rank = ranks.get(x + y)
            if rank is not None and rank < ends_x and rank <= ends_y:
                return False
            if ends_x <= ends_y:
                if ends_x == 1 << 60:
                    return True
                i += 1
            else:
                j += 1

    def _class(self, last: int, node: int) -> int:
        """What a path needs to know of its last token: where few tokens can still be read, which of them may follow.

        Minus one for none of them: the path is closed. Last tokens of one class share a state.
        """
        few = self._few[node]
        if few is None:
            return last
        key = (last + 1) << 24 | node
        if (known := self._classes.get(key)) is None:
            self.size += _PAIR
            bits = sum(1 << i for i, token in enumerate(few) if self._may_follow(last, token))
            known = self._classes[key] = -2 - bits if bits else -1
        return known

    def _advance(self, state: int, byte: int) -> int:
        """Next state, and the token that ends at this byte when the encoding ends here plus one, as one number."""
        child, tokens, inner, few = self._child, self._token, self._inner, self._few
        after, ended = [], -1
        for path in self._paths[state]:
            last, node = (path >> _BITS) + _LEAST, path & _LOW
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            token = tokens[to]
            if token >= 0 and ended < 0:  # one path at most ends at each byte
                own = few[node]
                if own is not None and last < -1:
                    if -2 - last >> own.index(token) & 1:
                        ended = token
                elif self._may_follow(last, token):
                    ended = token
            if inner[to]:
                if last < -1:  # a class of a node tells that of the nodes below
                    mine, now = few[node], few[to]
                    bits = -2 - last
                    bits = sum(1 << i for i, t in enumerate(now) if bits >> mine.index(t) & 1)
                    if bits:
                        after.append(-2 - bits - _LEAST << _BITS | to)
                elif node and last == -1 and few[node] is not None:
                    continue
                else:
                    got = self._class(last, to)
                    if few[to] is None or got != -1:
                        after.append(got - _LEAST << _BITS | to)
        if ended >= 0:
            after.append(ended - _LEAST << _BITS)
        after = tuple(after)
        if (to := self._states.get(after)) is None:
            to = self._states[after] = len(self._paths)
            self._paths.append(after)
            self.size += _STATE + _PATH * len(after)
        self.size += _MOVE
        got = self._step[state << 8 | byte] = to << _BITS | ended + 1
        return got

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of a pre-token; one that is itself a token is that token, as in the reading library."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return list(chain.from_iterable(self.stream(piece)))

    def stream(self, piece: bytes, look: int = LOOK) -> Iterator[list[int]]:
        """Tokens of a pre-token in runs, each emitted when its end is certain; looked for every ``look`` bytes.

        Each byte read gives the token that would end the encoding there, if one would.
        """
        ended: list[int] = []  # transitions at the bytes after those whose tokens are emitted
        state, step = 0, self._step
        for lo in range(0, len(piece), look):
            for byte in piece[lo : lo + look]:
                hit = step.get(state << 8 | byte) or self._advance(state, byte)  # none is 0, as nothing leads to the first state
                state = hit >> _BITS
                ended.append(hit)
            if lo + look >= len(piece):
                break
            if certain := self._certain(state, ended):
                yield self._back(ended[:certain], piece)
                del ended[:certain]
            if self.size > MEMORY:
                paths = self._paths[state]
                self.reset()
                step = self._step
                state = self._states[paths] = len(self._paths)
                self._paths.append(paths)
        yield self._back(ended, piece)

    def _certain(self, state: int, ended: list[int]) -> int:
        """The last boundary that all open paths have come through, in bytes of ended."""
        begins = sorted({len(ended) - int(self._depth[path & _LOW]) for path in self._paths[state]})
        while len(begins) > 1:
            last = begins.pop()
            before = last - self._length[(ended[last - 1] & _LOW) - 1] if last else 0
            if before not in begins:
                begins.append(before)
                begins.sort()
        return begins[0] if begins else 0

    def _back(self, ended: list[int], piece: bytes) -> list[int]:
        """The tokens that lead to the end of ended."""
        out = []
        at = len(ended)
        while at > 0:
            token = (ended[at - 1] & _LOW) - 1
            if token < 0:
                raise ValueError(f"no encoding of {piece[:80]!r}: a byte is missing among the tokens")
            out.append(self._same[token])
            at -= self._length[token]
        out.reverse()
        return out


#: First and last byte that may come next, for each state inside a character, and the state after it.
_ACCEPT, _REJECT = 0, 8
_FIRST = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)]
_NEXT = {1: (0x80, 0xBF, 0), 2: (0xA0, 0xBF, 1), 3: (0x80, 0xBF, 1), 4: (0x80, 0x9F, 1), 5: (0x90, 0xBF, 3), 6: (0x80, 0xBF, 3), 7: (0x80, 0x8F, 3)}


def utf8_step(state: int, byte: int) -> int:
    """Next state of the UTF-8 automaton (Unicode, table 3-7): 0 between characters, 1 to 7 inside one, 8 for bad bytes."""
    if state == _ACCEPT:
        return next((to for lo, hi, to in _FIRST if lo <= byte <= hi), _REJECT)
    if state == _REJECT:
        return _REJECT
    lo, hi, to = _NEXT[state]
    return to if lo <= byte <= hi else _REJECT


class StreamDecoder:
    """Text of a stream of ids; characters cut by a token end wait for the next ids."""

    def __init__(self, table: list[bytes], moves: dict[tuple[int, int], int] | None = None, whole: frozenset[int] = frozenset()):
        """whole: ids whose bytes are characters without a cut one; a run of them keeps the state between characters."""
        self.table, self.moves, self.whole = table, {} if moves is None else moves, whole
        self.state, self.held = _ACCEPT, b""

    def move(self, state: int, token: int) -> int:
        if (to := self.moves.get((state, token))) is None:
            to = state
            for byte in self.table[token]:
                to = utf8_step(to, byte)
            self.moves[state, token] = to
        return to

    def feed(self, ids: list[int]) -> bytes:
        """Bytes of all characters that are whole by now. Raises ValueError for bytes that are not UTF-8."""
        if self.state == _ACCEPT and self.whole.issuperset(ids):
            return b"".join(map(self.table.__getitem__, ids))
        parts, state, whole = [self.held], self.state, 0
        moves = self.moves
        for i, token in enumerate(ids, 1):
            if (to := moves.get((state, token))) is None:
                to = self.move(state, token)
            state = to
            if not state:
                whole = i
        if state == _REJECT:
            raise ValueError("the ids are not UTF-8")
        self.state = state
        parts += map(self.table.__getitem__, ids)
        if not state:
            self.held = b""
            return b"".join(parts)
        done = b"".join(parts)
        cut = len(done)
        while cut and done[cut - 1] & 0xC0 == 0x80:
            cut -= 1
        self.held = done[cut - 1 :]
        return done[: cut - 1]

    def finish(self) -> bytes:
        """Nothing, if the stream ended between characters; else ValueError."""
        if self.state != _ACCEPT:
            raise ValueError("the ids end inside a character")
        return b""


class _Memory(dict):
    """Ids of pre-tokens, encoded when first asked for. Of two halves the older one is given up when both are full."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older, self.size = transducer, {}, 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (got := self.older.get(piece)) is None:
            got = tuple(self.transducer.encode(piece.encode()))
            if len(piece) > 256:  # hardly comes again
                return got
        self[piece] = got
        self.size += _PIECE + len(piece) + _ID * len(got)
        return got

    def trim(self) -> None:
        """Keep pre-tokens and transducer within MEMORY: a quarter for each half of the former, half for the latter."""
        if self.size > MEMORY // 4:
            self.older = dict(self)
            self.clear()
            self.size = 0
        if self.transducer.size > MEMORY // 2:
            self.transducer.reset()


class Tokenizer:
    """Pre-tokenisation, transducer and a memory of pre-tokens. What only encoding needs is made for it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.moves: dict[tuple[int, int], int] = {}

    @cached_property
    def known(self) -> _Memory:
        return _Memory(Transducer(self.ranks))

    @cached_property
    def whole(self) -> frozenset[int]:
        """Ids whose bytes are UTF-8 by themselves."""
        return frozenset(i for i, b in enumerate(self.table) if b == b.decode(errors="ignore").encode())

    def encode(self, text: str) -> list[int]:
        known = self.known
        out: list[int] = []
        pieces = self.find(text)
        for lo in range(0, len(pieces), 4096):
            out.extend(chain.from_iterable(map(known.__getitem__, pieces[lo : lo + 4096])))
            known.trim()
        return out

    def decoder(self) -> StreamDecoder:
        return StreamDecoder(self.table, self.moves, self.whole)


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer for each worker, file and pattern. The file is read where the task runs, from the installed package."""
    gc.set_threshold(200_000, 20, 100)  # its memories are many small objects that stay
    return Tokenizer(load_ranks(path), pattern)


FORGET.append(tokenizer.cache_clear)


def _encoded(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, ids of (key, text), in batches of about a million ids; a longer text is whole."""
    own = tokenizer(path, pattern)
    for batch in batches:
        ids, ends, size = [], [0], 0
        keys = batch.column(0)
        done = 0
        for i, x in enumerate(batch.column(1), 1):
            got = own.encode(x.as_py() or "")
            ids.append(np.array(got, np.int32))
            size += len(got)
            ends.append(size)
            if size > 1 << 20 or i == batch.num_rows:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(done, i - done), lists], ["doc_id", "ids"])
                ids, ends, size, done = [], [0], 0, i


def _decoded(path: str, pattern: str, block: int, digests: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = tokenizer(path, pattern)
    decimal = [str(i) for i in range(len(own.table))]
    for batch in batches:
        out, counts, sums = [], [], []
        for key, row in zip(batch.column(0), batch.column(1), strict=True):
            ids = row.values.to_numpy().tolist() if row.is_valid else []
            stream = own.decoder()
            try:
                text = b"".join([stream.feed(ids[i : i + block]) for i in range(0, len(ids), block)] + [stream.finish()])
            except ValueError as e:
                raise ValueError(f"doc_id {key}: {e}") from e
            if digests:
                counts.append(len(ids))
                sums.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text = hashlib.sha256(text).hexdigest()
            out.append(text)
        if digests:
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(out, pa.string()), batch.column(1)]
        else:
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, list(_DIGESTS if digests else _TEXTS))


_DIGESTS = {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>"}
_TEXTS = {"doc_id": "long", "ids": "array<int>", "decoded": "string"}


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids of every row of docs; null and empty texts have no ids. Repeated rows and null keys stay.

    Other columns are not read; an empty table gives no rows. Texts of any length are read whole, pre-token by pre-token.
    """
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(partial(_encoded, path, pattern), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, block: int = 1024, digests: bool = False) -> DataFrame:
    """doc_id, ids, decoded of every row of tokens (doc_id, ids): the text, read in blocks of ids. Null ids decode to "".

    With digests: doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256, ids instead, in the
    same pass. Raises ValueError, naming the row, for ids whose bytes are not UTF-8 or end inside a character.
    """
    return tokens.select("doc_id", "ids").mapInArrow(partial(_decoded, path, pattern, block, digests), _schema(_DIGESTS if digests else _TEXTS))


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", block: int = 1024, digests: bool = False) -> DataFrame:
    """decode() of encode(), batch by batch in one worker: a core has one tokenizer at a time, and ids do not pass between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(path, pattern, block, digests, _encoded(path, pattern, batches))

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, _schema(_DIGESTS if digests else _TEXTS))
