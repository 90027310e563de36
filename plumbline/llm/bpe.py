"""Byte-level BPE encoding and decoding by a token automaton (operator 7).

The automaton starts with one state for each byte, and from every state, the start included, an arc for each byte. The
merges are compiled into it in rank order, by one gadget each. The gadget of a merge ``(a, b) -> c`` gives every state
that has an arc ``a`` to a state with an arc ``b`` an arc ``c`` past the two; what ``c`` leads to is a copy of the state
behind ``b``; and it takes arc ``b`` from the states behind ``a``. So a word keeps one path that spells it: its
tokenization. With 50,000 merges the arcs number billions. A gadget therefore writes down its copy and its cut with its
rank, and whether a state has an arc follows from the copies and cuts of lower ranks.

To encode, the automaton is made deterministic over bytes: a state of that machine is the set of (state, begun label)
that a prefix leaves open, one of them being the state that the prefix itself reaches. Its table is filled in when it is
read, one transition a byte, and the arcs that were taken are followed back from the end of the word; nothing is tried
and given up. A prefix has one path, so a transition looks no further once it has found what the prefix reaches; arcs that were
asked for are kept. To decode, the labels of the arcs are put together.

Nulls count as empty texts; an empty text has no tokens. Rows with a null doc_id and repeated rows give a row each, an
empty table gives none, and other columns are left behind, whatever their names. Texts may be of any length; equal texts
give equal rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..functions.layout import spread
from .common import map_batches, table, texts_of

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the published splitting pattern of this family of tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker keeps, and transitions of its machine over bytes; arcs that it keeps.
MEMO, TRANSITIONS = 1_000_000, 300_000
ARCS = 500_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


START = -1
_NEVER = 1 << 60
_NODE = (1 << 32) - 1


class Automaton:
    """The token automaton of a list of merges over labels (byte strings by token).

    ``label[s]`` is the token of the arcs that lead to state ``s``. A state that a gadget made has its rank, the state that it is a copy of, and the
    states behind the two parts of its label.
    """

    def __init__(self, labels: dict[int, bytes], merges: Iterable[tuple[int, int, int]]):
        self.labels = labels
        self.label: list[int] = []
        self.rank: list[int] = []
        self.parts: list[tuple[int, int]] = []
        self.of_token: dict[int, list[int]] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for token, label in labels.items():
            if len(label) == 1:
                self._state(token, -1, (START, START))
        for k, (a, b, c) in enumerate(merges):
            self._gadget(k, a, b, c)

    def _state(self, token: int, rank: int, parts: tuple[int, int]) -> None:
        self.of_token.setdefault(token, []).append(len(self.label))
        self.label.append(token)
        self.rank.append(rank)
        self.parts.append(parts)

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        """The merge of rank k: states behind the new arcs, as copies of those behind ``b``; then ``b`` is cut behind ``a``."""
        for p in self.of_token.get(a, ()):
            for q in self.of_token.get(b, ()):
                if self.has(p, q, k):
                    self._state(c, k, (p, q))
        self.cut.setdefault((a, b), k)

    def has(self, state: int, to: int, k: int = _NEVER) -> bool:
        """Whether ``state`` has an arc to the state ``to`` once the gadgets below rank k are in."""
        label, rank, parts, cut = self.label, self.rank, self.parts, self.cut
        while state != START:
            if cut.get((label[state], label[to]), _NEVER) < k:
                return False
            if rank[to] < 0 > rank[state]:
                return True
            if rank[to] >= rank[state]:  # the arc came with the gadget of ``to``, where there was one to its first part
                k = rank[to] + 1
                to = parts[to][0]
            else:  # ``state`` is a copy
                k = rank[state]
                state = parts[state][1]
        return True


class TokenAutomaton(dict):
    """Maps a pre-split piece to its ids, packed as little-endian 32-bit numbers; pieces met lately are kept."""

    def __init__(self, spec: dict, memo: int = MEMO):
        super().__init__()
        letters, model = byte_letters(), spec["model"]
        raw = lambda s: bytes(letters[x] for x in s)
        ids = {raw(s): i for s, i in model["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.labels = {i: b for b, i in ids.items()}
        self.states = Automaton(dict(self.labels), ((ids[raw(a)], ids[raw(b)], ids[raw(a) + raw(b)]) for a, b in pairs))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels |= {i: s.encode() for s, i in self.special.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.memo, self.transitions = memo, TRANSITIONS
        # begun labels: nodes of a tree over bytes, and the states behind a label that ends at a node
        self.begun: dict[int, int] = {}
        self.ends: dict[int, list[int]] = {}
        nodes = 1
        for token, found in self.states.of_token.items():
            node = 0
            for b in self.labels[token]:
                if (below := self.begun.get(node << 8 | b)) is None:
                    below = self.begun[node << 8 | b] = nodes
                    nodes += 1
                node = below
            self.ends[node] = found
        self.arcs: dict[int, bool] = {}
        # of each state: the length of its label, and its id as it is stored
        self.lengths = [len(self.labels[t]) for t in self.states.label]
        self.codes = [t.to_bytes(4, "little") for t in self.states.label]
        self._restart()

    def _restart(self) -> None:
        # an open (state, begun label) is one number: the state plus 1 in the high half, the node in the low half
        self.numbers: dict[tuple, int] = {(0,): 0}
        self.open: list[tuple] = [(0,)]
        # the next number in the high half, the state that is reached in the low half
        self.table: dict[int, int] = {}

    def _arc(self, state: int, to: int) -> bool:
        """As ``states.has``; the answers are kept."""
        if (got := self.arcs.get(state << 32 | to)) is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            got = self.arcs[state << 32 | to] = self.states.has(state, to)
        return got

    def _transition(self, at: int, byte: int) -> int:
        """The next state of the machine over bytes, and the state of the automaton that the prefix reaches there."""
        found, reached, begun, ends = [], None, self.begun, self.ends
        for x in self.open[at]:
            if (below := begun.get((x & _NODE) << 8 | byte)) is None:
                continue
            found.append(x & ~_NODE | below)
            if reached is None and (to := ends.get(below)) is not None:
                state = (x >> 32) - 1
                for y in to:
                    if state == START or self._arc(state, y):
                        reached = y
                        break
        if reached is None:
            raise ValueError("no path: the vocabulary lacks single bytes")
        found.append((reached + 1) << 32)
        key = tuple(found)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.open)
            self.open.append(key)
        got = self.table[at << 8 | byte] = number << 32 | reached
        return got

    def trail(self, piece: bytes) -> list[int]:
        """The states along the path that spells ``piece``: one transition a byte, then the arcs back from the end."""
        if len(self.table) > self.transitions:
            self._restart()
        at, trail, known, more = 0, [], self.table.get, self._transition
        for byte in piece:
            if (got := known(at << 8 | byte)) is None:
                got = more(at, byte)
            at = got >> 32
            trail.append(got)
        out, i, lengths = [], len(piece), self.lengths
        while i:
            state = trail[i - 1] & _NODE
            out.append(state)
            i -= lengths[state]
        out.reverse()
        return out

    def path(self, piece: bytes) -> list[int]:
        """The labels along the path that spells ``piece``."""
        return list(map(self.states.label.__getitem__, self.trail(piece)))

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.memo:
            self.clear()
        got = b"".join(map(self.codes.__getitem__, self.trail(piece.encode())))
        if len(piece) <= 64:
            self[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        find, split = self.__getitem__, self.split.findall
        if not self.special or not any(s in text for s in self.special):
            return b"".join(map(find, split(text)))
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else b"".join(map(find, split(x))) for x in self.specials.split(text))

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_BUILT: dict[str, TokenAutomaton] = {}


def automaton(path: str) -> TokenAutomaton:
    """The compiled automaton of a tokenizer file, one for each Python worker."""
    if path not in _BUILT:
        with open(path, encoding="utf-8") as f:
            _BUILT[path] = TokenAutomaton(json.load(f))
    return _BUILT[path]


def _placed(spark: SparkSession, path: str | None) -> Callable[[], TokenAutomaton]:
    """How a task gets the automaton: from the installed vocabulary files, or from a file that Spark sends along."""
    if path is None:

        def installed() -> TokenAutomaton:
            import public_tokenizers

            return automaton(public_tokenizers.path(TOKENIZER))

        return installed
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    return lambda: automaton(SparkFiles.get(name))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string: each whole text encoded, and decoded again from its ids.

    ``path`` is the tokenizer file; by default the installed ``byte_bpe_50k.json``.
    """
    build = _placed(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok = build()
        packed = [tok.encode(t) for t in batch.column(1).to_pylist()]
        ids = pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([tok.decode(p) for p in packed], pa.string())], names=["doc_id", "ids", "decoded"])

    return map_batches(spread(texts_of(docs)), run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As :func:`encode`, with ids and decoded text reduced to their digests where they are made."""
    build = _placed(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok = build()
        packed = [tok.encode(t) for t in batch.column(1).to_pylist()]
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array([digest(p) for p in packed], pa.string()),
                pa.array([digest(tok.decode(p).encode()) for p in packed], pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_batches(spread(texts_of(docs)), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_bpe": op7_bpe}
SQL: dict[str, str] = {}
