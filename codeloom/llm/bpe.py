"""Byte-level BPE by a lazily determinised finite-state transducer.

Two tokens may stand side by side in a BPE encoding exactly when encoding their
joined bytes gives those two tokens back. A text's encoding is then the only
path through the vocabulary's trie on which every pair of neighbours is
compatible. That nondeterministic transducer (a place in the trie, the token
before it) is determinised while texts are read: a state is the set of places
still possible, and exactly one of them ends a token, which is the last token
of the text read so far. A token is emitted once the ways back from all places
of the state meet behind it, after a bounded lookahead. Many pieces are read
side by side, a byte of each at a time, by a table of transitions that are made
when first met, up to a bound at which all are dropped and made again. Decoding
is a second transducer, from tokens to text, over the states of an incremental
UTF-8 machine. Long texts are worked on in segments, whose digests go on from
one to the next.

Cases: a null text is an empty one, with no tokens and the digests of an empty
string; repeated rows each give a row; an empty table gives none; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm._tables import bound_batches, table

#: Transitions and states kept by one worker (some 160 MB); beyond, they are dropped and made again.
MAX_STEPS = 1 << 20
MAX_STATES = 1 << 19
#: Pairs of tokens kept whose compatibility is known.
MAX_PAIRS = 1 << 17
#: Bytes of known chunks kept by one worker, about; beyond, those not used since half of them were read are dropped.
MAX_STORE = 96 << 20
#: Bytes read between two looks for certain tokens.
LOOKAHEAD = 256
#: Bytes of pieces that are read side by side.
ABREAST = 1 << 15
#: Characters of a text that are worked on at a time, and of the texts of one round.
SEGMENT = 1 << 20
#: Stands between chunks of a text; no UTF-8 text has it.
BETWEEN = "\ud800"
#: Where a text may be cut: no piece reaches over a single space or line feed between characters that are not white space.
BORDER = regex.compile(r"(?<=\S)[ \n](?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain BPE: join the pair of least rank, leftmost first, until none has a rank (``below`` some rank)."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60 or below is not None and rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.text_of = {i: t for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.children: dict[int, int] = {}
        self.token_at, self.depth, inner = [-1], [0], {0}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merge_bytes(token, ranks, rank)
                if len(parts) != 2:  # no sequence of merges makes it: only a whole piece can be this token
                    continue
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            at = 0
            for byte in token:
                inner.add(at)
                key = at << 8 | byte
                if key not in self.children:
                    self.children[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[at] + 1)
                at = self.children[key]
            self.token_at[at] = rank
        self.inner = inner
        self.pair_rank = {h: rank for rank, h in self.halves.items()}
        most = max(ranks.values()) + 1
        #: Each id as one object, as decimal text, and the length of its bytes.
        self.numbers = np.array(range(most), object)
        self.names = [str(i) for i in range(most)]
        self.size = np.zeros(most, np.int32)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        #: Ids of the chunks met last, and of those met before the store was half full the last time.
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.stored = 0
        self._forget()
        #: Per state of the UTF-8 machine, the state after a token and the characters it ends.
        self.text_steps: dict[int, dict[int, tuple[int, str]]] = {}
        #: The characters of the tokens that lead from between two characters to between two characters.
        self.whole = [None] * most
        for token, rank in ranks.items():
            state, text = utf8_feed(0, token)
            if not state:
                self.whole[rank] = text

    def _forget(self) -> None:
        self.pairs: dict[int, bool] = {}
        # A state is a flat tuple of its places: node, token before, node, ...
        start = (0, -1)
        self.state_ids, self.states = {start: 0}, [start]
        self.ended = np.zeros(1 << 10, np.int32)
        # Open addressing by state << 8 | byte; no transition leads to the first state, so 0 is none.
        self.step_keys = np.zeros(2 * MAX_STEPS, np.int64)
        self.step_to = np.zeros(2 * MAX_STEPS, np.int32)
        self.made = 0

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the joined bytes of ``a`` and ``b`` is ``[a, b]``.

        Goes back in time: the younger of the two tokens at the border is taken
        apart, and a merge across the border that came earlier than it rules
        the pair out. Of equal ranks the left one was merged first.
        """
        if (known := self.pairs.get(a << 32 | b)) is not None:
            return known
        left, right, before, answer = a, b, 1 << 60, True
        while True:
            across = self.pair_rank.get((left, right))
            if across is not None and across < before:
                answer = False
                break
            left_age = left if left in self.halves else -1
            right_age = right if right in self.halves else -1
            if left_age < 0 and right_age < 0:
                break
            if left_age > right_age:
                before, left = left, self.halves[left][1]
            else:
                before, right = right + 1, self.halves[right][0]
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs = {}
        self.pairs[a << 32 | b] = answer
        return answer

    def _step(self, state: int, byte: int) -> int:
        """Make the transition from ``state`` on ``byte``."""
        places, ended = [], -1
        children, pairs, inner, token_at = self.children.get, self.pairs.get, self.inner, self.token_at
        own = self.states[state]
        for i in range(0, len(own), 2):
            after = children(own[i] << 8 | byte)
            if after is None:
                continue
            before, token = own[i + 1], token_at[after]
            if ended < 0 <= token and (before < 0 or pairs(before << 32 | token) or self.compatible(before, token)):
                ended = token
            if after in inner:
                places.append(after)
                places.append(before)
        places.append(0)
        places.append(ended)
        found = self._intern(tuple(places))
        key = state << 8 | byte
        at = self._slot(key)
        while self.step_to[at]:
            at = (at + 1) % len(self.step_to)
        self.step_keys[at], self.step_to[at] = key, found
        self.made += 1
        return found

    def _intern(self, places: tuple[int, ...]) -> int:
        """The number of a state; the last of its places tells the token that ends there."""
        if (found := self.state_ids.get(places)) is None:
            found = self.state_ids[places] = len(self.states)
            self.states.append(places)
            if found == len(self.ended):
                self.ended = np.concatenate([self.ended, np.zeros_like(self.ended)])
            self.ended[found] = places[-1]
        return found

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20 & len(self.step_to) - 1

    def _after(self, state: int, byte: int) -> int:
        """The state after ``state`` on ``byte``."""
        key = state << 8 | byte
        at = self._slot(key)
        while found := int(self.step_to[at]):
            if self.step_keys[at] == key:
                return found
            at = (at + 1) % len(self.step_to)
        return self._step(state, byte)

    def _all_after(self, keys: np.ndarray) -> np.ndarray:
        """The states after many (state << 8 | byte); 0 where no transition is made yet."""
        last = len(self.step_to) - 1
        at = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & np.uint64(last)).astype(np.int64)
        found = self.step_to[at]
        open_ = np.flatnonzero((self.step_keys[at] != keys) & (found != 0))
        while len(open_):
            at[open_] = at[open_] + 1 & last
            found[open_] = self.step_to[at[open_]]
            open_ = open_[(self.step_keys[at[open_]] != keys[open_]) & (found[open_] != 0)]
        return found

    def _room(self, new: int) -> None:
        """Make room for ``new`` transitions."""
        if len(self.states) + new > MAX_STATES or self.made + new > MAX_STEPS:
            self._forget()

    def _abreast(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Tokens of pieces of :data:`LOOKAHEAD` bytes at most, read side by side, a byte of each at a time."""
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(sizes) - sizes
        first = starts[order]
        lengths = sizes[order]
        trail = np.zeros(len(data), np.int32)
        state = np.zeros(len(pieces), np.int32)
        self._room(len(data))
        for i in range(lengths[0]):
            reading = int(np.searchsorted(-lengths, -i, "left"))
            at, now = first[:reading] + i, state[:reading]
            keys = now.astype(np.int64) << 8 | data[at]
            after = self._all_after(keys)
            if len(unknown := keys[after == 0]):
                for k in np.unique(unknown).tolist():
                    self._step(k >> 8, k & 255)
                after = self._all_after(keys)
            state[:reading] = after
            trail[at] = self.ended[after]
        # Back from the ends: every piece gives its last token, then the one before it.
        piece, at = order, first + lengths - 1
        pieces_of, tokens_of = [], []
        while len(piece):
            tokens = trail[at]
            pieces_of.append(piece)
            tokens_of.append(tokens)
            at = at - self.size[tokens]
            # Pieces lie one behind the other; the byte before a piece's first is another's.
            left = at >= starts[piece]
            piece, at = piece[left], at[left]
        owner, tokens = np.concatenate(pieces_of)[::-1], np.concatenate(tokens_of)[::-1]
        by = np.argsort(owner, kind="stable")
        tokens = self.numbers[tokens[by]].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()
        return [tuple(tokens[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def _back(self, trail: list[int], at: int, least: int = 0) -> list[tuple[int, int]]:
        """The tokens that end at ``at`` or before, last first, each with its end, down to ``least``."""
        found = []
        while at > least:
            token = trail[at]
            found.append((token, at))
            at -= int(self.size[token])
        return found

    def _certain(self, trail: list[int], state: int) -> int:
        """The last place in the text at which the ways back from all places of the state meet."""
        at = len(trail) - 1
        ways = [{end for _, end in self._back(trail, at - self.depth[node])} for node in self.states[state][::2]]
        return max(set.intersection(*ways), default=0)

    def stream(self, data: bytes) -> Iterator[int]:
        """Tokens of one piece, each after a lookahead of some :data:`LOOKAHEAD` bytes at most."""
        trail, state = [-1], 0
        for at in range(0, len(data), LOOKAHEAD):
            if len(self.states) + LOOKAHEAD > MAX_STATES or self.made + LOOKAHEAD > MAX_STEPS:
                places = self.states[state]
                self._forget()
                state = self._intern(places)
            for byte in data[at : at + LOOKAHEAD]:
                state = self._after(state, byte)
                trail.append(int(self.ended[state]))
            if at + LOOKAHEAD < len(data) and (cut := self._certain(trail, state)):
                yield from [token for token, _ in reversed(self._back(trail, cut))]
                # What stands for all that came before the certain place.
                trail = [-1, *trail[cut + 1 :]]
        yield from [token for token, _ in reversed(self._back(trail, len(trail) - 1))]

    def _keep(self, key: str, ids: tuple[int, ...]) -> None:
        self.known[key] = ids
        self.stored += 220 + len(key) + 8 * len(ids)

    def _learn(self, pieces: set[str]) -> None:
        """Store the ids of pieces that are not known."""
        abreast, held = [], 0
        for piece in pieces:
            data = piece.encode()
            if (whole := self.ranks.get(data)) is not None:
                self._keep(piece, (self.numbers[whole],))
            elif len(data) > LOOKAHEAD:
                self._keep(piece, tuple([self.numbers[i] for i in self.stream(data)]))
            else:
                abreast.append((piece, data))
                held += len(data)
            if held >= ABREAST:
                self._learn_abreast(abreast)
                abreast, held = [], 0
        if abreast:
            self._learn_abreast(abreast)

    def _learn_abreast(self, pieces: list[tuple[str, bytes]]) -> None:
        for (piece, _), ids in zip(pieces, self._abreast([d for _, d in pieces]), strict=True):
            self._keep(piece, ids)

    def _lacking(self, keys: set[str]) -> list[str]:
        """The keys that are not known; those known before are taken over."""
        found, older, known = [], self.older, self.known
        for key in keys:
            if key not in known:
                if (ids := older.get(key)) is not None:
                    self._keep(key, ids)
                else:
                    found.append(key)
        return found

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """The ids of segments that :func:`cut_text` made.

        A segment is cut before its spaces and line feeds, and equal chunks are
        looked up. Chunks that touch a longer run of white space are joined
        again to what stands on both sides of it.
        """
        if self.stored > MAX_STORE // 2:
            self.known, self.older, self.stored = {}, self.known, 0
        findall = self.pattern.findall
        texts = [s.replace(" ", BETWEEN + " ").replace("\n", BETWEEN + "\n").split(BETWEEN) for s in segments]
        lacking = self._lacking(set().union(*texts))
        loose = {part for part in lacking if not is_chunk(part)}
        read, pieces = [], set()
        for parts in texts:
            joined: list[list[int]] = []
            if not loose.isdisjoint(parts):
                for i in [i for i, part in enumerate(parts) if part in loose]:
                    if joined and joined[-1][1] >= i:
                        joined[-1][1] = i + 2
                    else:
                        joined.append([max(0, i - 1), i + 2])
            whole = [findall("".join(parts[lo:hi])) for lo, hi in joined]
            pieces.update(*whole)
            read.append((parts, joined, whole))
        split = {chunk: findall(chunk) for chunk in lacking if chunk not in loose}
        pieces.update(*split.values())
        self._learn(set(self._lacking(pieces)))
        ids_of = self.known.__getitem__
        for chunk, found in split.items():
            if len(found) > 1:
                self._keep(chunk, tuple(chain.from_iterable(map(ids_of, found))))
        out = []
        for parts, joined, whole in read:
            at, runs = 0, []
            for (lo, hi), found in zip(joined, whole, strict=True):
                runs.extend(map(ids_of, parts[at:lo]))
                runs.extend(map(ids_of, found))
                at = hi
            runs.extend(map(ids_of, parts[at:] if at else parts))
            out.append(list(chain.from_iterable(runs)))
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return list(chain.from_iterable([self.encode_segments([s])[0] for s in cut_text(text)]))

    def decode_stream(self, ids: list[int], state: int = 0) -> tuple[str, int]:
        """Feed ids to the UTF-8 machine: the characters that they end, and the state after them.

        A character is held back, in the state, until its last byte.
        """
        texts = list(map(self.whole.__getitem__, ids))
        if not state and None not in texts:
            return "".join(texts), 0
        out, at = [], 0
        while at < len(ids):
            if not state:
                try:
                    stop = texts.index(None, at)
                except ValueError:
                    stop = len(ids)
                out.extend(texts[at:stop])
                at = stop
                if at == len(ids):
                    break
            steps = self.text_steps.setdefault(state, {})
            if (step := steps.get(ids[at])) is None:
                if len(self.text_steps) > MAX_STEPS >> 8:
                    self.text_steps = {}
                    steps = self.text_steps.setdefault(state, {})
                step = steps[ids[at]] = utf8_feed(state, self.text_of[ids[at]])
            state, text = step
            out.append(text)
            at += 1
        return "".join(out), state

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; a character without its last byte gives U+FFFD."""
        text, state = self.decode_stream(ids)
        return text + "�" if state else text


def is_chunk(part: str) -> bool:
    """Whether neither end of a part, but for one space or line feed at its beginning, could belong to a run of white space."""
    body = part[1:] if part[:1] in (" ", "\n") else part
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


def cut_text(text: str) -> Iterator[str]:
    """Segments of a text, of some :data:`SEGMENT` characters, cut where no piece reaches over."""
    at = 0
    while len(text) - at > SEGMENT and (border := BORDER.search(text, at + SEGMENT)):
        yield text[at : border.start()]
        at = border.start()
    if at < len(text):
        yield text[at:]


def utf8_feed(state: int, data: bytes) -> tuple[int, str]:
    """Read bytes from a UTF-8 machine's state; returns the state after them and the characters ended.

    A state is 0 between characters, else ``value << 24 | low << 16 | high << 8
    | missing``: the bits so far, the range the next byte must lie in, and how
    many bytes are missing. A byte outside gives U+FFFD, as do the bytes before it.
    """
    out: list[str] = []
    for byte in data:
        if state:
            value, low, high, missing = state >> 24, state >> 16 & 255, state >> 8 & 255, state & 255
            if low <= byte <= high:
                value = value << 6 | byte & 63
                if missing == 1:
                    out.append(chr(value))
                    state = 0
                else:
                    state = value << 24 | 0x80 << 16 | 0xBF << 8 | missing - 1
                continue
            out.append("�")
            state = 0
        if byte < 0x80:
            out.append(chr(byte))
        elif 0xC2 <= byte <= 0xDF:
            state = (byte & 31) << 24 | 0x80BF01
        elif 0xE0 <= byte <= 0xEF:
            state = (byte & 15) << 24 | (0xA0 if byte == 0xE0 else 0x80) << 16 | (0x9F if byte == 0xED else 0xBF) << 8 | 2
        elif 0xF0 <= byte <= 0xF4:
            state = (byte & 7) << 24 | (0x90 if byte == 0xF0 else 0x80) << 16 | (0x8F if byte == 0xF4 else 0xBF) << 8 | 3
        else:
            out.append("�")
    return state, "".join(out)


@contextlib.contextmanager
def rare_collections() -> Iterator[None]:
    """Look for cycles of objects rarely meanwhile: the stores are many small tuples, and none of them is in a cycle."""
    before = gc.get_threshold()
    gc.set_threshold(200_000, 20, 100)
    try:
        yield
    finally:
        gc.set_threshold(*before)


_made: dict[str, Bpe] = {}


def codec(name: str, ranks: dict[bytes, int], pattern: str) -> Bpe:
    """One transducer per vocabulary and worker."""
    if name not in _made:
        _made[name] = Bpe(ranks, pattern)
    return _made[name]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode ``text`` of (doc_id, text), decode the ids again, and return digests (and the ids).

    The vocabulary, at most a few MB whatever the input, is broadcast.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def rounds(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        """Segments (row, text) of a round, in order."""
        held, size = [], 0
        for row, text in enumerate(texts):
            for segment in cut_text(text or ""):
                held.append((row, segment))
                size += len(segment)
                if size >= SEGMENT:
                    yield held
                    held, size = [], 0
        yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with rare_collections():
            yield from encoded(batches)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, ranks.value, pattern)
        name = bpe.names.__getitem__
        for batch in batches:
            rows = batch.num_rows
            sizes, coded, decoded = [0] * rows, [hashlib.sha256() for _ in range(rows)], [hashlib.sha256() for _ in range(rows)]
            states, kept = [0] * rows, array("i")
            for part in rounds(batch.column(1).to_pylist()):
                for (row, _), ids in zip(part, bpe.encode_segments([s for _, s in part]), strict=True):
                    coded[row].update(("," * (sizes[row] > 0) + ",".join(map(name, ids))).encode())
                    text, states[row] = bpe.decode_stream(ids, states[row])
                    decoded[row].update(text.encode())
                    sizes[row] += len(ids)
                    if keep_ids:
                        kept.extend(ids)
            for state, digest in zip(states, decoded, strict=True):
                if state:
                    digest.update("�".encode())
            coded, decoded = [d.hexdigest() for d in coded], [d.hexdigest() for d in decoded]
            columns = [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.array(np.frombuffer(kept, np.int32) if kept else np.empty(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole document."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the token ids of every document, with the digests of op5."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)
