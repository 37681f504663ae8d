"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that ends the
prefix's encoding. The suffix automaton of the vocabulary (Aho-Corasick) names
all tokens that end at a position; the one is right whose left neighbour is the
last token of the prefix before it, if merging never would have joined the two
differently. That is a test of the pair alone. Following the stored tokens back
from the end gives the exact ids.

A text is cut where the tokenizer's own pattern must cut it (before a single
blank that a non-blank follows), and pieces are remembered per worker, so that
frequent words are encoded once. The new words of some documents are encoded
together, a length of prefix at a time: words that begin alike share their
prefixes, and each of these is settled once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.text import each
from cairn.session import bound_batches

#: Fixed values of the file format: the pattern that parts text, and the white space it knows.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
BLANKS = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")
#: A single blank before other white space.
BLANK_RUN = regex.compile(r" [\p{White_Space}--\ ]", regex.V1)
#: Bytes of what a worker remembers of pieces and of words before the older half is forgotten (both halves: twice as much), and what an entry takes besides.
REMEMBERED, REMEMBERED_WORDS, ENTRY = 48 << 20, 16 << 20, 200
#: Pairs of tokens whose compatibility is remembered.
PAIRS = 200_000
#: Characters of the texts whose new words are encoded together, pieces of one go, and characters of the longest of them; longer ones go one by one.
TOGETHER, WORDS, LONGEST = 2_000_000, 1 << 15, 32
#: More than any merge's rank.
NEVER = 1 << 62


def byte_letters() -> dict[int, str]:
    """The printable character that the vocabulary file writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory:
    """Two generations of remembered values, each of `most` bytes: what the older one still serves moves to the younger."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most
        self.forget()

    def forget(self) -> None:
        self.young, self.old, self.size = {}, {}, 0

    def __call__(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            self.young[key] = found
            self.size += ENTRY + 2 * len(key) + len(found)
            if self.size >= self.most:
                self.old, self.young, self.size = self.young, {}, 0
        return found

    def fill(self, values: dict) -> None:
        self.young.update(values)
        self.size += ENTRY * len(values) + 2 * sum(map(len, values)) + sum(map(len, values.values()))
        if self.size >= self.most:
            self.old, self.young, self.size = self.young, {}, 0


def prefixes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted, unlike, non-empty words: their bytes and lengths, and which rows have a prefix of each length first, and its number."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.array(words, f"S{size.max()}").view(np.uint8).reshape(len(words), -1)
    col = np.arange(letters.shape[1])
    new = np.ones(letters.shape, bool)
    new[1:] = np.logical_or.accumulate(letters[1:] != letters[:-1], axis=1) | (size[:-1, None] <= col)
    new &= size[:, None] > col
    # numbered from 1, the shorter ones first; 0 is the empty prefix
    node = new.T.ravel().cumsum(dtype=np.int32).reshape(new.T.shape).T
    return letters, size, new, node


def _found(keys: np.ndarray, values: np.ndarray, key: np.ndarray, other: int) -> np.ndarray:
    """The value of each key by its place in the sorted keys, or another."""
    i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[i] == key, values[i], other)


class Together:
    """The automaton and the merges as arrays, for many words at a time."""

    def __init__(self, tokens: dict[int, bytes], rank: dict[tuple[int, int], int], parts: dict[int, tuple[int, int, int]]):
        of = sorted(tokens, key=tokens.__getitem__)
        letters, size, new, node = prefixes([tokens[i] for i in of])
        n = int(node.max()) + 1
        self.token, self.depth = np.full(n, -1), np.zeros(n, np.int64)
        self.token[node[np.arange(len(of)), size - 1]] = of
        edges, ends, levels = [], [], []
        for j in range(letters.shape[1]):
            rows = np.flatnonzero(new[:, j])
            up, here, by = (node[rows, j - 1] if j else np.zeros(len(rows), np.int64)), node[rows, j], letters[rows, j].astype(np.int64)
            self.depth[here] = j + 1
            levels.append((up, here, by))
            edges.append(up.astype(np.int64) << 8 | by)
            ends.append(here)
        edges, ends = np.concatenate(edges), np.concatenate(ends)
        order = np.argsort(edges)
        self.edges, self.ends = edges[order], ends[order]
        # where a state goes on from, and the next shorter token that ends there (-1: none)
        self.fail, self.link = np.zeros(n, np.int64), np.full(n, -1)
        for up, here, by in levels[1:]:
            self.fail[here] = f = self.step(self.fail[up], by)
            self.link[here] = np.where(self.token[f] >= 0, f, self.link[f])
        pairs = np.array([(a << 16 | b, r) for (a, b), r in rank.items()] or [(-1, NEVER)])
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pairs, self.ranks = pairs[:, 0].copy(), pairs[:, 1].copy()
        every = range(max(tokens) + 1)
        self.bytes, self.written = pa.array([tokens.get(i, b"") for i in every], pa.binary()), pa.array([f"{i}," for i in every], pa.string())
        self.made = np.full((3, 1 << 16), -1)  # a token's merge: rank, left, right
        for t, made in parts.items():
            self.made[:, t] = made

    def step(self, state: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The state after one more byte."""
        out, at = np.zeros(len(state), np.int64), np.arange(len(state))
        while at.size:
            to = _found(self.edges, self.ends, state << 8 | by, 0)
            out[at] = to
            on = (to == 0) & (state > 0)
            at, state, by = at[on], self.fail[state[on]], by[on]
        return out

    def neighbours(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As Encoder.neighbours(), of many pairs."""
        ok, at, before = np.ones(len(left), bool), np.arange(len(left)), np.full(len(left), NEVER)
        while at.size:
            joined = _found(self.pairs, self.ranks, left << 16 | right, NEVER)
            ok[at[joined < before]] = False
            a, b = self.made[0, left], self.made[0, right]
            on = (joined >= before) & ((a >= 0) | (b >= 0))
            at, left, right, a, b = at[on], left[on], right[on], a[on], b[on]
            undo_left = (b < 0) | (a > b)
            before = np.where(undo_left, a, b + 1)
            left, right = np.where(undo_left, self.made[2, left], left), np.where(undo_left, right, self.made[1, right])
        return ok

    def ids(self, words: list[bytes]) -> list[str]:
        """The ids, joined by commas, of each of sorted, unlike, non-empty words; decoded, they must give the words again."""
        letters, size, new, node = prefixes(words)
        n = int(node.max()) + 1
        state, last, start = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
        for j in range(letters.shape[1]):
            rows = np.flatnonzero(new[:, j])
            here = node[rows, j]
            cur = self.step(state[node[rows, j - 1]] if j else np.zeros(len(rows), np.int64), letters[rows, j].astype(np.int64))
            state[here] = cur
            cur = np.where(self.token[cur] >= 0, cur, self.link[cur])
            while rows.size:
                if (cur < 0).any():
                    raise ValueError("no token ends here: the vocabulary lacks a byte")
                token, at = self.token[cur], j + 1 - self.depth[cur]
                ok = at == 0
                part = np.flatnonzero(~ok)
                ok[part] = self.neighbours(last[node[rows[part], at[part] - 1]], token[part])
                last[here[ok]], start[here[ok]] = token[ok], at[ok]
                rows, here, cur = rows[~ok], here[~ok], self.link[cur[~ok]]
        # back from the ends, a token of each word at a time
        backs, rows, end = [], np.arange(len(words)), size
        while rows.size:
            on = node[rows, end - 1]
            backs.append((rows, last[on]))
            end = start[on]
            rows, end = rows[end > 0], end[end > 0]
        count = np.bincount(np.concatenate([r for r, _ in backs]), minlength=len(words))
        stop = count.cumsum()
        flat = np.zeros(int(stop[-1]), np.int64)
        for k, (r, t) in enumerate(backs):
            flat[stop[r] - 1 - k] = t
        # a word's tokens are as long as it is, by how they were followed back
        if self.bytes.take(pa.array(flat)).buffers()[2].to_pybytes() != b"".join(words):
            raise ValueError("words do not come back from their ids")
        said = self.written.take(pa.array(flat))
        text, at = said.buffers()[2].to_pybytes().decode(), np.frombuffer(said.buffers()[1], np.int32)[stop].tolist()
        return [text[i : j - 1] for i, j in zip([0, *at], at)]


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if len(spec["model"]["vocab"]) > 1 << 16 or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are known here")
        back = {c: bytes([b]) for b, c in byte_letters().items()}
        vocab = spec["model"]["vocab"]
        self.token = {i: b"".join(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        self.bytes = pa.array([self.token.get(i, b"") for i in range(max(self.token) + 1)], pa.binary())
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: its merge's rank, left, right
        for r, (a, b) in reversed(list(enumerate(merges))):
            self.parts[vocab[a + b]] = (r, vocab[a], vocab[b])
        self.automaton = ahocorasick.Automaton()
        reach = set(self.parts) | {vocab[c] for c in byte_letters().values() if c in vocab}
        self.together = Together({i: self.token[i] for i in reach}, self.rank, self.parts)
        for i in reach:
            s = self.token[i].decode("latin-1")
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.beside: dict[int, bool] = {}
        self.words = Memory(self._ids, REMEMBERED_WORDS)
        self.piece, self.after_blank = Memory(self._piece, REMEMBERED // 4), Memory(lambda p: self._piece(" " + p), REMEMBERED)

    def forget(self) -> None:
        """Give back what was remembered: a worker process may go on to other work."""
        for memory in (self.words, self.piece, self.after_blank):
            memory.forget()
        self.beside.clear()

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging can leave these two tokens side by side.

        Their merges are undone from the last to the first. If at some point the
        tokens that then touch have a merge of their own that comes before the
        one undone, the two would have been joined across the border.
        """
        before = 1 << 62  # merges that come earlier than this have run where we look
        while True:
            joined = self.rank.get((left, right))
            if joined is not None and joined < before:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # at one rank the merge on the left comes first, so the one on the right is undone first
            if b is None or (a is not None and a[0] > b[0]):
                before, left = a[0], a[2]
            else:
                before, right = b[0] + 1 if b[0] + 1 < 1 << 62 else before, b[1]
                # a join at the same rank would lie left of the undone merge and run before it

    def _ids(self, word: str) -> tuple[int, ...]:
        if not word.isascii():
            word = word.encode().decode("latin-1")
        n = len(word)
        if n == 1:
            return next(self.automaton.iter(word))[1][:1]
        last, start = [-1] * n, [0] * n
        beside = self.beside
        for end, (token, size) in self.automaton.iter(word):
            if last[end] < 0:
                at = end - size
                if at >= 0:
                    prev = last[at]
                    ok = beside.get(prev << 16 | token)
                    if ok is None:
                        if len(beside) > PAIRS:
                            beside.clear()
                        ok = beside[prev << 16 | token] = self.neighbours(prev, token)
                    if not ok:
                        continue
                last[end], start[end] = token, at
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at = start[at]
        return tuple(out[::-1])

    def _piece(self, piece: str) -> str:
        """Ids joined by commas; decoded, they must give the piece again."""
        if piece[1:].isalpha() and (piece[0] == " " or piece.isalpha()):
            ids = self.words(piece)
        else:
            ids = [i for w in PATTERN.findall(piece) for i in self.words(w)]
        if b"".join(map(self.token.__getitem__, ids)) != piece.encode():
            raise ValueError(f"{piece!r} does not come back from its ids")
        return ",".join(map(str, ids))

    def learn(self, texts: list[str]) -> None:
        """Encode what comes after single blanks in these texts and is not remembered, many words together."""
        new: set[str] = set()
        for t in texts:
            new.update(t.split(" "))
        new = new.difference(self.after_blank.young).difference(self.after_blank.old)
        some = [p for p in new if p and p[0] not in BLANKS and len(p) <= LONGEST]
        for i in range(0, len(some), WORDS):
            pieces = some[i : i + WORDS]
            plain = [p for p in pieces if p.isalpha()]
            mixed = {p: PATTERN.findall(" " + p) for p in pieces if not p.isalpha()}
            # code points are in the order of their bytes
            words = sorted({" " + p for p in plain}.union(*mixed.values()))
            known = dict(zip(words, self.together.ids([w.encode() for w in words]), strict=True))
            self.after_blank.fill({p: known[" " + p] for p in plain} | {p: ",".join(map(known.__getitem__, ws)) for p, ws in mixed.items()})

    def learned(self, texts: Iterator[str]) -> Iterator[str]:
        """The texts as they are, some at a time, once their new words are encoded."""
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= TOGETHER:
                self.learn(some)
                yield from some
                some, size = [], 0
        self.learn(some)
        yield from some

    def pieces(self, text: str) -> Iterator[str]:
        """Cut before each single blank that a non-blank follows: the pattern always cuts there."""
        held = None
        for i, p in enumerate(text.split(" ")):
            if i == 0:
                held = p
            elif p and p[0] not in BLANKS:
                if held:
                    yield held
                held = " " + p
            else:
                held += " " + p
        if held:
            yield held

    def _part(self, text: str) -> str:
        """Ids, joined by commas, of a non-empty text without special tokens."""
        if "  " in text or text.endswith(" ") or BLANK_RUN.search(text):
            return ",".join(map(self.piece, self.pieces(text)))
        first, *rest = text.split(" ")
        out = list(map(self.after_blank.young.get, rest))
        if None in out:
            out = [self.after_blank(p) if x is None else x for p, x in zip(rest, out, strict=True)]
        if first:
            out.insert(0, self.piece(first))
        return ",".join(out)

    def run(self, text: str) -> tuple[str, int, bytes]:
        """Ids joined by commas, their number, and the bytes that these ids decode to, of a whole text."""
        if not text:
            return "", 0, b""
        if not self.special or not any(s in text for s in self.special):
            ids = self._part(text)
        else:
            ids = ",".join([str(self.special[p]) if p in self.special else self._part(p) for p in self.splitter.split(text) if p])
        every = np.fromstring(ids, np.int32, sep=",")
        return ids, len(every), self.bytes.take(pa.array(every)).buffers()[2].to_pybytes()

    def encode(self, text: str) -> list[int]:
        ids = self.run(text)[0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.token[i] for i in ids).decode("utf-8", errors="replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text with the vocabulary file at `path`, which every node holds.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256, and with with_ids also
    ids and decoded; one row for each input row. A null or empty text has no
    token and decodes to the empty string. Special tokens' own strings in a text
    become their ids, as the tokenizers library has it. Repeated rows and null ids
    give a row each; other columns, whatever they are called, are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = rows.select(id_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        try:
            for b in batches:
                n, ids, dec, lists, texts = [], [], [], [], []
                for i, k, raw in map(enc.run, enc.learned(t or "" for t in each(b, "_text"))):
                    out = raw.decode("utf-8", errors="replace")
                    n.append(k)
                    ids.append(hashlib.sha256(i.encode()).hexdigest())
                    dec.append(hashlib.sha256(out.encode()).hexdigest())
                    if with_ids:
                        lists.append([int(x) for x in i.split(",")] if i else [])
                        texts.append(out)
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())]
                if with_ids:
                    cols += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.record_batch(cols, schema.names)
        finally:
            enc.forget()

    return rows.mapInArrow(go, schema)
