"""Byte-level BPE as a finite-state transducer that is determinised lazily, and decoding as a UTF-8 state machine.

An encoding by merges is the right one just when every two neighbouring tokens encode to themselves: merges inside a
pair go on alike in a text and alone, as long as none crosses the pair's ends. So the encodings of all prefixes form a
nondeterministic transducer: a hypothesis is a place where a token ends, and the bytes read since then, which begin
some token. Reading a byte moves each hypothesis in the trie of tokens; where a token ends, the pair rule says whether
it may follow the hypothesis' last one, and exactly one hypothesis may end there, as a prefix has one encoding.

Determinising makes a state of all hypotheses that live at once: of each the place in the trie and the last token, as
nothing else decides what may come. A move gives the one token that ends at its byte; the tokens of a piece are read
backwards from its end, each from where the next one begins. What is held back while a piece is read is bounded: all
that lies before where the paths of the live hypotheses part is sure, and a hypothesis lives no longer than the longest
token. States are made when a text first needs them, and forgotten all together when there are too many.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from contextlib import suppress

STATES = 200_000
SLICE = 1 << 16
NEVER = 1 << 40
LAST = (1 << 20) - 1  # of a hypothesis: node << 20 | last token + 1
TWO = "the ranks aren't those of merges: a prefix has no or several encodings"


def load_ranks(path: str) -> dict[bytes, int]:
    """A file of lines: token in base 64, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(raw: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """raw by its merges, lowest rank first and from the left: for a pair of tokens, which is short."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if best == NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Encodes pieces of bytes with ranks that hold all single bytes."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.most = ranks, states
        self.bytes_of = {r: t for t, r in ranks.items()}
        if len(self.bytes_of) != len(ranks) or not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("ranks must differ and hold all bytes")
        # trie: node << 8 | byte -> its child; the token of a node, -1 where none ends; whether tokens go on behind it
        self.child: dict[int, int] = {}
        self.token_at, self.inner, self.depth = [-1], [False], [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                self.inner[node] = True
                below = self.child.get(node << 8 | b)
                if below is None:
                    below = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[node] + 1)
                node = below
            self.token_at[node] = rank
        self.size_of = {r: len(t) for t, r in ranks.items()}
        self.edges: dict[int, tuple[tuple, tuple] | None] = {}
        self.forget()

    def forget(self) -> None:
        self.number: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self.moves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self._state((0,))  # state 0: nothing is read

    def _state(self, key: tuple[int, ...]) -> int:
        """key: the hypotheses; the one at the root, where a token has just ended, is the last."""
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
        return at

    def _spines(self, token: int) -> tuple[tuple, tuple] | None:
        """(rank, bytes) of what stands at a token's right and at its left end while it is merged, from a byte to the
        whole token; None for a token that merges don't reach or that comes before its parts."""
        if token not in self.edges:
            whole = self.bytes_of[token]
            parts, last = [whole[i : i + 1] for i in range(len(whole))], [-1, -1]
            right, left = [(-1, parts[-1])], [(-1, parts[0])]
            good = True
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if rank == NEVER:
                    good = False
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                for side, spine, edge in ((0, right, parts[-1]), (1, left, parts[0])):
                    if edge != spine[-1][1]:
                        good = good and rank > last[side]
                        last[side] = rank
                        spine.append((rank, edge))
            self.edges[token] = (tuple(right), tuple(left)) if good else None
        return self.edges[token]

    def _may_follow(self, first: int, second: int) -> bool:
        """Whether two tokens encode to themselves: no merge crosses their border while each of them comes about.

        What stands on both sides of the border changes at known ranks; a pair of them that is a token of rank r merges
        if both stand there before r or any of their own merges takes one away. Of equal ranks the left one is first.
        """
        a, b = (self._spines(first) if first >= 0 else ()), self._spines(second)
        if a is None or b is None:
            tokens = [self.bytes_of[t] for t in (first, second) if t >= 0]
            return merged(b"".join(tokens), self.ranks) == tokens
        if not a:
            return True
        (right, _), (_, left), i, j = a, b, 0, 0
        while True:
            ends_left = right[i + 1][0] if i + 1 < len(right) else NEVER
            ends_right = left[j + 1][0] if j + 1 < len(left) else NEVER
            rank = self.ranks.get(right[i][1] + left[j][1])
            if rank is not None and rank < ends_left and rank <= ends_right:
                return False
            if ends_left == ends_right == NEVER:
                return True
            if ends_left <= ends_right:
                i += 1
            else:
                j += 1

    def _make(self, state: int, byte: int) -> tuple[int, int]:
        """The state after a byte and the token that ends there."""
        child, inner, token_at, fits = self.child, self.inner, self.token_at, self.fits
        new, ended = [], -1
        for hypothesis in self.states[state]:
            below = child.get(hypothesis >> 20 << 8 | byte)
            if below is None:
                continue
            before = hypothesis & LAST
            if inner[below]:
                new.append(below << 20 | before)
            token = token_at[below]
            if token >= 0:
                fit = fits.get(before << 20 | token)
                if fit is None:
                    fit = fits[before << 20 | token] = self._may_follow(before - 1, token)
                if fit:
                    if ended >= 0:
                        raise ValueError(TWO)
                    ended = token
        if ended < 0:
            raise ValueError(TWO)
        new.append(ended + 1)
        move = self.moves[state << 8 | byte] = self._state(tuple(new)), ended
        return move

    def _read(self, state: int, raw: bytes, ends: list[int]) -> int:
        """Reads bytes from a state on, adds to ``ends`` the token that ends at each, and gives the state after them."""
        get = self.moves.get
        for byte in raw:
            move = get(state << 8 | byte)
            if move is None:
                move = self._make(state, byte)
            state, token = move
            ends.append(token)
        return state

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens up to a place where one ends."""
        out, size_of = [], self.size_of
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= size_of[token]
        out.reverse()
        return out

    def push(self, state: int | tuple[int, list[int]], raw: bytes, out: list[int]) -> int | tuple[int, list[int]]:
        """Reads bytes from a place on, adds to ``out`` what is sure, and gives the place after them: a state, and the
        tokens that end since what was sure. 0 is the start."""
        number, ends = state if state else (0, [])
        ends = list(ends)
        number = self._read(number, raw, ends)
        paths = {len(ends) - self.depth[h >> 20] for h in self.states[number]}  # where the hypotheses begin; back to where all meet
        while len(paths) > 1:
            last = max(paths)
            paths.remove(last)
            paths.add(last - self.size_of[ends[last - 1]])
        sure = paths.pop()
        out.extend(self._back(ends, sure))
        return number, ends[sure:]

    def stream(self, piece: bytes) -> Iterator[list[int]]:
        """Tokens of a piece of any length, as they become sure."""
        state: tuple[int, list[int]] = (0, [])
        for lo in range(0, len(piece), SLICE):
            if len(self.states) > self.most:  # all are forgotten but the one that goes on
                key = self.states[state[0]]
                self.forget()
                state = self._state(key), state[1]
            out: list[int] = []
            state = self.push(state, piece[lo : lo + SLICE], out)
            yield out
        yield self._back(state[1], len(state[1]))

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of a piece. A token that merges don't reach is itself as a whole piece, as in the library."""
        if len(piece) > SLICE:
            out = [token for part in self.stream(piece) for token in part]
        else:
            if len(self.states) > self.most:
                self.forget()
            ends: list[int] = []
            self._read(0, piece, ends)
            out = self._back(ends, len(ends))
        return [self.ranks[piece]] if len(out) > 1 and piece in self.ranks else out


class _Whole(dict):
    """Texts of tokens that begin and end between characters; a KeyError for others."""

    def __init__(self, machine: Utf8Machine):
        super().__init__()
        self.machine = machine

    def __missing__(self, token: int) -> str:
        text, state = [], b""
        for byte in self.machine.bytes_of[token]:
            got, state = self.machine.step(state, byte)
            text.append(got)
        if state:
            raise KeyError(token)
        self[token] = "".join(text)
        return self[token]


class Utf8Machine:
    """Decodes bytes as they come. A state is the bytes of a character that isn't complete; what can't become one is
    given out as U+FFFD, as long as it could have, as Python and WHATWG do."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.known: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.whole = _Whole(self)

    @staticmethod
    def _second(lead: int) -> range:
        """What may follow a lead byte: no overlong forms, no surrogates, nothing above U+10FFFF."""
        return range({0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80), {0xED: 0xA0, 0xF4: 0x90}.get(lead, 0xC0))

    def step(self, state: bytes, byte: int) -> tuple[str, bytes]:
        """Characters that a byte completes, and the state after it."""
        if not state:
            return (chr(byte), b"") if byte < 0x80 else ("", bytes([byte])) if 0xC2 <= byte <= 0xF4 else ("�", b"")
        if byte in (self._second(state[0]) if len(state) == 1 else range(0x80, 0xC0)):
            state += bytes([byte])
            size = 2 if state[0] < 0xE0 else 3 if state[0] < 0xF0 else 4
            return (state.decode(), b"") if len(state) == size else ("", state)
        text, state = self.step(b"", byte)
        return "�" + text, state

    def push(self, state: bytes, tokens: Sequence[int], out: list[str]) -> bytes:
        if not state:
            with suppress(KeyError):  # no token ends inside a character: one step for all
                out.append("".join(map(self.whole.__getitem__, tokens)))
                return state
        known = self.known.setdefault(state, {})
        for token in tokens:
            move = known.get(token)
            if move is None:
                text, after = [], state
                for byte in self.bytes_of[token]:
                    got, after = self.step(after, byte)
                    text.append(got)
                move = known[token] = "".join(text), after
            out.append(move[0])
            if move[1] != state:
                state = move[1]
                known = self.known.setdefault(state, {})
        return state

    def decode(self, tokens: Sequence[int]) -> str:
        out: list[str] = []
        if self.push(b"", tokens, out):
            out.append("�")
        return "".join(out)
