"""Operator 10: BPE encoding and decoding with a bounded-lookahead streaming transducer.

The encoder never holds more of a run of letters than the merge list can still change.  A token
sequence is the BPE result exactly if every adjacent pair of tokens is: so the last token of every
prefix is unique, and it is found from the last tokens of the shorter prefixes within the longest
token's length.  Tokens that lie on the paths from all of the last ``lookahead`` prefixes cannot
change any more and are emitted.  Short runs are merged directly and remembered in a bounded cache.
The decoder is an incremental state machine over ids and bytes.

Defined results: a null text counts as empty and gives no ids; repeated rows give repeated results;
an empty table gives an empty table; other columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from folioscope.llm._common import id_field, map_text, table

#: The white space of the tokenizer file's normaliser (the Unicode property White_Space).
CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACE = "\t-\r \u0085   -     　"
#: Pieces of so many characters are remembered, and so many of them; texts are read in windows of so many characters.
KEPT, CACHE, CHUNK = 32, 200_000, 1 << 16
#: Texts of so many characters are split at a time.
TOGETHER = 1 << 20
BITS = 24
MASK = (1 << BITS) - 1
NONE = 1 << 62


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class PairTable:
    """Integers by key, looked up for whole arrays: open addressing with a bounded number of probes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys) * 8).bit_length())
        while not self._fill(keys, values, bits):
            bits += 1

    def _fill(self, keys: np.ndarray, values: np.ndarray, bits: int) -> bool:
        self.shift, self.probes = np.uint64(64 - bits), 0
        self.keys, self.values = np.full((1 << bits) + 8, -1, dtype=np.int64), np.full((1 << bits) + 8, -1, dtype=np.int64)
        left = np.arange(len(keys))
        while len(left):
            if self.probes == 8:
                return False
            slot = self._slot(keys[left]) + self.probes
            free = self.keys[slot] < 0
            take, first = np.unique(slot[free], return_index=True)
            own = left[free][first]
            self.keys[take], self.values[take] = keys[own], values[own]
            self.probes += 1
            left = left[self.keys[slot] != keys[left]]
        return True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for unknown keys."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        for i in range(1, self.probes):
            left = np.flatnonzero((out < 0) & (self.keys[slot + i - 1] >= 0))
            at = slot[left] + i
            out[left] = np.where(self.keys[at] == keys[left], self.values[at], -1)
        return out


class MergeTransducer:
    """BPE over one pre-token, given as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte = byte_alphabet()
        self.ranks: dict[tuple[int, int], int] = {}  # rank and merged token in one integer
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a in self.vocab and b in self.vocab and a + b in self.vocab:
                self.ranks.setdefault((self.vocab[a], self.vocab[b]), rank << BITS | self.vocab[a + b])
        self.first = [self.vocab.get(c, -1) for c in self.byte]
        self.last = [self.vocab.get(c + self.end, -1) for c in self.byte]
        self.spell: dict[int, tuple[int, ...]] = {}
        self.spellings: dict[tuple[int, ...], int] = {}
        self._sizes: dict[int, tuple[int, ...]] | None = None
        self._fits: dict[int, bool] = {}
        self.steps: PairTable | None = None
        self._longest = 0

    def symbols(self, word: bytes) -> list[int]:
        return [self.first[b] for b in word[:-1]] + [self.last[word[-1]]] if word else []

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the lowest-ranked merge, leftmost first, until none is left."""
        parts, get = list(symbols), self.ranks.get
        ranks = [get(pair, NONE) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i, new = ranks.index(best), best & MASK
            parts[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], new), NONE)
            if i < len(ranks):
                ranks[i] = get((new, parts[i + 1]), NONE)
        return parts

    def _spellings(self) -> dict[tuple[int, ...], int]:
        """Tokens that the merges reach, by their symbols; sets the longest length, which bounds the lookahead."""
        if not self.spellings:
            spell = {i: (i,) for i in {*self.first, *self.last} if i >= 0}
            for (a, b), both in sorted(self.ranks.items(), key=lambda x: x[1]):
                c = both & MASK
                if c not in spell and a in spell and b in spell:
                    spell[c] = spell[a] + spell[b]
            spell = {i: s for i, s in spell.items() if self.merge(list(s)) == [i]}
            self.spell, self.spellings = spell, {s: i for i, s in spell.items()}
            self._longest = max(map(len, spell.values()), default=1)
        return self.spellings

    def lookahead(self) -> int:
        """Symbols after a prefix that can still take part in its last token."""
        self._spellings()
        return self._longest

    def sizes(self, symbol: int) -> tuple[int, ...]:
        """Lengths of the tokens that end in a symbol, longest first."""
        if self._sizes is None:
            found: dict[int, set[int]] = {}
            for spelling in self._spellings():
                found.setdefault(spelling[-1], set()).add(len(spelling))
            self._sizes = {s: tuple(sorted(n, reverse=True)) for s, n in found.items()}
        return self._sizes.get(symbol, ())

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their symbols are merged together."""
        key = a << BITS | b
        if (found := self._fits.get(key)) is None:
            if len(self._fits) > CACHE:
                self._fits.clear()
            found = self._fits[key] = self.merge([*self.spell[a], *self.spell[b]]) == [a, b]
        return found

    def encode(self, word: bytes) -> list[int]:
        """The tokens of a whole pre-token, through the transducer."""
        run = Run(self)
        return [*run.push(word), *run.finish()]

    def _arrays(self) -> None:
        """The tables of the transducer as arrays, for many words in step."""
        spellings = self._spellings()
        code = {}
        for b in range(256):
            code[self.last[b]] = 256 + b
            code[self.first[b]] = b
        nodes: dict[int, int] = {}
        tokens = [-1]
        for spelling, token in spellings.items():
            at = 0
            for symbol in spelling:
                key = at << 9 | code[symbol]
                if key not in nodes:
                    nodes[key] = len(tokens)
                    tokens.append(-1)
                at = nodes[key]
            tokens[at] = token
        self.steps = PairTable(np.array(list(nodes), dtype=np.int64), np.array(list(nodes.values()), dtype=np.int64))
        self.token_at = np.array(tokens, dtype=np.int64)
        size = max(self.names, default=0) + 1
        self.size = np.ones(size, dtype=np.int64)
        for token, spelling in self.spell.items():
            self.size[token] = len(spelling)
        pairs = np.array([(a << BITS | b, r >> BITS) for (a, b), r in self.ranks.items()], dtype=np.int64).reshape(-1, 2)
        self.rank_of = PairTable(pairs[:, 0], pairs[:, 1])
        #: The merge that makes a token: its rank, left and right part; -1 for symbols.
        self.born, self.part = np.full(size, -1, dtype=np.int64), np.tile(np.arange(size), (2, 1))
        self.regular = True
        for (a, b), r in sorted(self.ranks.items(), key=lambda x: x[1]):
            c = r & MASK
            if c in self.spell and a in self.spell and b in self.spell:
                if self.born[c] >= 0 or max(self.born[a], self.born[b]) >= r >> BITS:
                    self.regular = False
                self.born[c], self.part[0, c], self.part[1, c] = r >> BITS, a, b

    def fits_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` for arrays of tokens.

        Ranks grow from the parts of a token to the token, so the merges that lead to both can be undone
        from the last one: at no time must the tokens that touch each other have a merge of a lower rank
        than the one that takes either away.
        """
        if not self.regular:
            return np.array([self.fits(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)
        out = np.ones(len(a), dtype=bool)
        at, x, y = np.arange(len(a)), a, b
        x_until, y_until = np.full(len(a), NONE), np.full(len(a), NONE)
        while len(at):
            rank = self.rank_of.get(x << BITS | y)
            cross = (rank >= 0) & (rank < x_until) & (rank <= y_until)
            out[at[cross]] = False
            born_x, born_y = self.born[x], self.born[y]
            go = ~cross & ((born_x >= 0) | (born_y >= 0))
            undo = (born_x > born_y)[go]
            at, x, y, x_until, y_until, born_x, born_y = (v[go] for v in (at, x, y, x_until, y_until, born_x, born_y))
            x, x_until = np.where(undo, self.part[1, x], x), np.where(undo, born_x, x_until)
            y, y_until = np.where(undo, y, self.part[0, y]), np.where(undo, y_until, born_y)
        return out

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """The transducer on many short words in step; ids as little-endian unsigned 32-bit integers."""
        if self.steps is None:
            self._arrays()
        length = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-length, kind="stable")
        length, rows = length[order], len(words)
        longest = int(length[0]) if rows else 0
        data = np.frombuffer(b"".join(words[i] for i in order.tolist()), dtype=np.uint8).astype(np.int64)
        begin = np.cumsum(length) - length
        data[(begin + length - 1)[length > 0]] += 256
        nodes = np.full((longest, rows), -1, dtype=np.int64)  # the state after the symbols from each start on
        tails = np.full((longest, rows), -2, dtype=np.int64)
        for n in range(longest):
            active = int(np.searchsorted(-length, -n, side="left"))  # words with more than n symbols
            symbol = data[begin[:active] + n]
            nodes[n, :active] = 0
            near = nodes[max(0, n + 1 - self._longest) : n + 1, :active]
            alive = np.nonzero(near >= 0)
            near[alive] = self.steps.get(near[alive] << 9 | symbol[alive[1]])
            token = np.where(near >= 0, self.token_at[near], -1)
            open_ = np.ones(active, dtype=bool)
            for i in range(len(near)):  # the longest token first
                row = np.flatnonzero(open_ & (token[i] >= 0))
                if not len(row):
                    continue
                start = n + 1 - len(near) + i
                if start:
                    left = tails[start - 1, row]
                    row, left = row[left >= 0], left[left >= 0]
                    row = row[self.fits_many(left, token[i, row])]
                tails[n, row] = token[i, row]
                open_[row] = False
        place, found = length.copy(), []
        while (row := np.flatnonzero(place > 0)).size:
            token = tails[place[row] - 1, row]
            found.append((row, token))
            place[row] -= self.size[token]
        row = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
        token = np.concatenate([t for _, t in found]) if found else row
        turn = np.repeat(np.arange(len(found)), [len(r) for r, _ in found])
        token = token[np.lexsort((-turn, row))].astype("<u4").tobytes()
        edge = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]) * 4
        out = [b""] * rows
        for i, a, b in zip(order.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out[i] = token[a:b]
        return out


class Run:
    """The transducer at work on one pre-token of any length: bytes go in, tokens come out once they are stable.

    It holds a window of symbols whose size the merge list's lookahead bounds, and the last token of
    each prefix that ends in the window.
    """

    def __init__(self, of: MergeTransducer):
        self.of, self.longest = of, of.lookahead()
        self.window: list[int] = []
        self.tails: list[int] = []
        self.before = -1  # the token emitted last
        self.held: int | None = None  # a byte is the last of its pre-token or not

    def push(self, more: bytes) -> list[int]:
        out: list[int] = []
        if not more:
            return out
        if self.held is not None:
            self._step(self.of.first[self.held], out)
        for b in more[:-1]:
            self._step(self.of.first[b], out)
        self.held = more[-1]
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        if self.held is not None:
            self._step(self.of.last[self.held], out)
        out += self._path(len(self.tails))
        self.window, self.tails, self.before, self.held = [], [], -1, None
        return out

    def _step(self, symbol: int, out: list[int]) -> None:
        if symbol < 0:
            return
        window, tails, of = self.window, self.tails, self.of
        window.append(symbol)
        n, known, fits = len(window), of.spellings, of.fits
        tail = -2
        for size in of.sizes(symbol):
            if size > n:
                continue
            token = known.get(tuple(window[n - size :]), -1)
            if token < 0:
                continue
            left = tails[n - size - 1] if n > size else self.before
            if left == -2 or (left >= 0 and not fits(left, token)):
                continue
            tail = token
            break
        tails.append(tail)
        if n >= 4 * self.longest and n % self.longest == 0 and (cut := self._settled()):
            done = self._path(cut)
            out += done
            self.before = done[-1]
            del window[:cut], tails[:cut]

    def _path(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(self.tails[end - 1])
            end -= len(self.of.spell[self.tails[end - 1]])
        return out[::-1]

    def _settled(self) -> int:
        """The longest prefix at which the paths from all of the last prefixes meet."""
        tails = self.tails
        ends = {e for e in range(len(tails) - self.longest + 1, len(tails) + 1) if tails[e - 1] >= 0}
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(top - len(self.of.spell[tails[top - 1]]))
        return max(0, ends.pop()) if ends else 0


class Seen(dict):
    """What the transducer made of pieces met before; emptied when it is full, and long pieces are not kept."""

    def __init__(self, transducer: MergeTransducer):
        super().__init__()
        self.transducer, self.whole = transducer, -1 not in transducer.first and -1 not in transducer.last

    def learn(self, pieces: set[str]) -> None:
        """All short ones of the pieces at once."""
        new = pieces - self.keys()
        if len(self) + len(new) > CACHE:
            self.clear()
            new = pieces
        short = [p for p in new if len(p) <= KEPT] if self.whole else []
        if short:
            self.update(zip(short, self.transducer.encode_many([p.encode("utf-8") for p in short]), strict=True))

    def __missing__(self, piece: str) -> bytes:
        return array("I", self.transducer.encode(piece.encode("utf-8"))).tobytes()


class Codec:
    """Text to ids and back, as the tokenizer file prescribes: NFC, white space to one space, lower case, split, merge."""

    def __init__(self, path: str):
        self.transducer = MergeTransducer(path)
        self.pieces = regex.compile(rf"\p{{L}}+|{CLITICS}|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        #: The same split where every word character is a letter, an ASCII digit or the underscore.
        self.plain = re.compile(rf"[^\W\d_]+|{CLITICS}|\d|(?:[^{SPACE}\w]|_)+")
        self.number = re.compile("[" + "".join(c for c in map(chr, range(128, 0x10000)) if unicodedata.category(c)[0] == "N") + "]")
        self.beyond = re.compile("[\U00010000-\U0010FFFF]")
        self.space = re.compile(f"[{SPACE}]+")
        self.special = regex.compile("|".join(map(regex.escape, self.transducer.special))) if self.transducer.special else None
        self.seen = Seen(self.transducer)
        self.letters, self.others = regex.compile(r"\p{L}+"), regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]+")
        self.last_other, self.last_stop = regex.compile(r"(?r)[^\p{L}]"), regex.compile(rf"(?r)[{SPACE}\p{{L}}\p{{N}}]")

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, one character at a time as the library does; white space only parts the pieces."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def parts(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, a window of the text at a time."""
        for part in self.pieces_of(text):
            if isinstance(part, list):
                self.seen.learn(set(part))
            yield self.ids(part)

    def ids(self, part: list[str] | bytes) -> bytes:
        return b"".join(map(self.seen.__getitem__, part)) if isinstance(part, list) else part

    def pieces_of(self, text: str) -> Iterator[list[str] | bytes]:
        """The pieces of each window, and ids of what is known already."""
        begin = 0
        for hit in [*(self.special.finditer(text) if self.special and "<|" in text else ()), None]:
            yield from self._plain(text, begin, hit.start() if hit else len(text))
            if hit:
                yield array("I", [self.transducer.special[hit[0]]]).tobytes()
                begin = hit.end()

    @staticmethod
    def _cut(text: str, at: int, end: int) -> int:
        """The first place from ``at`` on where the text can be parted without a change of its normal form."""
        while at < end and not text[at].isascii() and ("\u1160" <= text[at] <= "\u11ff" or unicodedata.category(text[at])[0] == "M"):
            at += 1
        return min(at, end)

    def _plain(self, text: str, begin: int, end: int) -> Iterator[list[str] | bytes]:
        """A piece that reaches the end of a window is carried into the next one; one of more than a window goes through a run of its own."""
        carry, run, kind = "", None, None
        while begin < end:
            cut = self._cut(text, begin + CHUNK, end)
            part = carry + self.normal(text[begin:cut])
            begin, carry = cut, ""
            if run:
                more = kind.match(part)
                if more:
                    yield array("I", run.push(more[0].encode("utf-8"))).tobytes()
                    part = part[more.end() :]
                if part or begin == end:
                    yield array("I", run.finish()).tobytes()
                    run = None
            if begin < end:
                # A run of letters at the end, and the run of others before it, may be cut through a piece.
                at = m.end() if (m := self.last_other.search(part)) else 0
                at = m.end() if (m := self.last_stop.search(part, 0, at)) else 0
                part, carry = part[:at], part[at:]
            split = self.plain if part.isascii() or not (self.number.search(part) or self.beyond.search(part)) else self.pieces
            yield split.findall(part)
            if len(carry) > CHUNK // 2:
                *whole, last = self.pieces.findall(carry)
                yield whole
                run, kind, carry = Run(self.transducer), self.letters if self.letters.match(last) else self.others, ""
                yield array("I", run.push(last.encode("utf-8"))).tobytes()
        if run:
            yield array("I", run.finish()).tobytes()

    def encode(self, text: str) -> list[int]:
        return list(array("I", b"".join(self.parts(text))))


class Decoder:
    """Incremental state machine from ids to text.

    ``pieces``: token strings with a space between them, which is what a file without a decoder means.
    ``text``: bytes through an incremental UTF-8 decoder, a space after each word end.
    """

    def __init__(self, transducer: MergeTransducer, mode: str = "pieces"):
        self.names, self.end, self.mode = transducer.names, transducer.end, mode
        self.bytes = {c: b for b, c in enumerate(transducer.byte)}
        self.special = set(transducer.special.values())
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False

    def feed(self, ids: Iterable[int]) -> str:
        if self.mode == "pieces":
            names = [name for name in map(self.names.get, ids) if name is not None]
            before = " " if self.started and names else ""
            self.started = self.started or bool(names)
            return before + " ".join(names)
        out = []
        for i in ids:
            name = self.names.get(i)
            if name is None:
                continue
            if i in self.special:
                out.append(self.utf8.decode(b"", True) + name)
                self.utf8.reset()
            else:
                ends = bool(self.end) and name.endswith(self.end)
                body = name[: -len(self.end)] if ends else name
                out.append(self.utf8.decode(bytes(self.bytes[c] for c in body)) + (" " if ends else ""))
        return "".join(out)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


def text_digest(codec: Codec, parts: Iterable[bytes], with_output: bool = False) -> tuple[int, str, str, list[int], str]:
    """Number of ids, sha-256 of the ids and of the text decoded from them and, if ``with_output``, both themselves."""
    ids_hash, text_hash, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, Decoder(codec.transducer)
    kept_ids: list[int] = []
    kept_text = []
    for part in parts:
        ids = array("I", part)
        decoded = decoder.feed(ids)
        n += len(ids)
        ids_hash.update(part)
        text_hash.update(decoded.encode("utf-8"))
        if with_output:
            kept_ids.extend(ids)
            kept_text.append(decoded)
    last = decoder.finish()
    text_hash.update(last.encode("utf-8"))
    return n, ids_hash.hexdigest(), text_hash.hexdigest(), kept_ids, "".join([*kept_text, last])


def digests(codec: Codec, texts: list[str], with_output: bool = False) -> list[tuple]:
    """``text_digest`` of each text; what is new in a run of short texts goes through the transducer together."""
    out, i = [], 0
    while i < len(texts):
        begin, size = i, 0
        while i < len(texts) and len(texts[i]) <= CHUNK and size < TOGETHER:
            size += len(texts[i])
            i += 1
        if i == begin:  # a long text, window by window
            out.append(text_digest(codec, codec.parts(texts[i]), with_output))
            i += 1
            continue
        split = [list(codec.pieces_of(t)) for t in texts[begin:i]]
        codec.seen.learn({p for text in split for part in text if isinstance(part, list) for p in part})
        out += [text_digest(codec, map(codec.ids, text), with_output) for text in split]
    return out


#: One codec for each file and worker process, so that its cache outlives a task.
_CODECS: dict[str, Codec] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_output: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns id, n_tokens, ids_sha256, decoded_sha256 and, if ``with_output``, ids (array of int) and decoded.
    """
    where = path or default_path()
    fields = [id_field(docs, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_output:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def make():
        codec = _CODECS.get(where) or _CODECS.setdefault(where, Codec(where))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = digests(codec, [text or "" for text in batch.column(1).to_pylist()], with_output)
            count, a, b, ids_out, text_out = zip(*found, strict=True) if found else [()] * 5
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_output:
                columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

        return step

    return map_text(docs.select(id_col, docs[text_col].cast("string").alias("text")), make, T.StructType(fields))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tokens(table(spark, sf_dir, "documents"))
