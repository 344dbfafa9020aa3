"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are tokenised in ascending id order and cut into shards of about
`SHARD_TOKENS` ids.  Per shard, pairs of adjacent symbols are replaced by
nonterminals, round after round, until no pair occurs `MIN_COUNT` times; a
pair never spans two documents.  A shard keeps its rules, the expansion length
of each rule, the remaining symbols and where each document begins, so any
document can be decoded alone.

Shard layout (little-endian): magic `RPG2`; unsigned 32-bit: vocabulary size V,
documents D, rules R, symbols S, bytes a symbol W (2 while all symbols fit,
else 4); 64-bit ids of the documents (D), a byte for each that tells whether
the id is null; 32-bit first symbol of each document (D); rules, left and
right (2 R symbols); 32-bit expansion lengths (R); symbols (S).  Symbols below
V are token ids, V ends a document, V + 1 + k is rule k.  The shards lie in a
Parquet table, one binary value a row, so any file system that Spark writes to
will do.

Order and ties: null ids first, then ascending; rows with one id are ordered
by their text.  Defined results: null texts are empty, and an empty document
is only its end id; repeated rows are documents each; a very long text is
never cut (its shard is as long as it); other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_schema, fresh_path, mapped
from .textkit import Chunk, mix, views

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SHARD_TOKENS = 1 << 19
#: A pair is replaced while it occurs this often in its shard.
MIN_COUNT = 12
#: Pairs that one round replaces at most; the next round takes the others.
ROUND_PAIRS = 4000
#: Slots of the table of parts whose ids a process remembers (45 bytes each, at most 60 % used).
SLOTS = 1 << 20
#: Bytes of the longest part that the table holds; longer ones are kept by a dictionary of bytes.
PART_BYTES = 24
#: Long parts that a process remembers.
LONG_PARTS = 20_000
#: Long parts that are given to the library in one text; its time a part grows with the text.
LEARN_PARTS = 400
#: Bytes of texts that are tokenised together.
PIECE_BYTES = 1 << 19


class PartTable:
    """Ids of parts of texts: an open-addressing hash table in numpy arrays.

    A part is known by all its bytes (three 64-bit words) and its length; its
    hash only says where to look."""

    def __init__(self, slots: int):
        self.bits, self.used = slots.bit_length() - 1, 0
        self.word = [np.zeros(slots, np.uint64) for _ in range(3)]
        self.length = np.zeros(slots, np.uint8)  # 0: free
        self.code = np.zeros(slots, np.int32)
        # The ids of the parts in a row and where each part's begin; both have room behind.
        self.begin, self.flat = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)

    @property
    def room(self) -> int:
        """Parts that may still be added."""
        return max(len(self.code) * 3 // 5 - self.used, 0)

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray, word: list[np.ndarray], length: np.ndarray) -> np.ndarray:
        """The code of each part, -1 if not known."""
        at, code, left = self.place(key), np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(left):
            there, want = self.length[at], length if len(left) == len(length) else length[left]
            hit = there == want
            for own, w in zip(self.word, word, strict=True):
                hit &= own[at] == (w if len(left) == len(w) else w[left])
            code[left[hit]] = self.code[at[hit]]
            go = np.flatnonzero(~hit & (there != 0))
            left, at = left[go], (at[go] + 1) & (len(self.code) - 1)
        return code

    def lay(self, first: int, ids: np.ndarray, number: np.ndarray) -> None:
        """Put the ids of parts first, first + 1, ... behind those of the parts
        before.  Behind the parts that were added they last until the next call."""
        stop = int(self.begin[first]) + np.cumsum(number)
        self.begin = _roomy(self.begin, first + 1 + len(number))
        self.begin[first + 1 : first + 1 + len(number)] = stop
        self.flat = _roomy(self.flat, int(stop[-1]))
        self.flat[self.begin[first] : stop[-1]] = ids

    def add(self, key: np.ndarray, word: list[np.ndarray], length: np.ndarray) -> None:
        """Distinct parts that aren't known, whose ids were laid behind the known ones."""
        code = np.arange(self.used, self.used + len(key), dtype=np.int32)
        at, left = self.place(key), np.arange(len(key))
        while len(left):
            free = self.length[at] == 0
            self.code[at[free]] = code[left[free]]  # of several for one slot, the last stays
            own = free & (self.code[at] == code[left])
            k, to = left[own], at[own]
            self.length[to] = length[k]
            for mine, w in zip(self.word, word, strict=True):
                mine[to] = w[k]
            left, at = left[~own], (at[~own] + 1) & (len(self.code) - 1)
        self.used += len(key)


def _roomy(x: np.ndarray, size: int) -> np.ndarray:
    """x, or a copy with room for size elements and more."""
    if len(x) >= size:
        return x
    out = np.zeros(2 * size, x.dtype)
    out[: len(x)] = x
    return out


#: By length, what of 8 bytes belongs to a part.
_WORD_MASK = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(9)], np.uint64)


#: Bytes that no text cut here holds: other white space, what separates parts, leads of signs beyond U+04FF.
_WHOLE = np.zeros(256, bool)
_WHOLE[[*b"\0\t\r\v\f\x1c\x1d\x1e\x1f", *range(0xD4, 256)]] = True
#: Kinds of signs that the tokenizer's pattern tells apart.
SPACE, LETTER, DIGIT, OTHER = range(4)
#: Code points of signs that are cut here: those of one or two bytes, Cyrillic the last.
CUT_BELOW = 0x500


def _kinds(lib) -> np.ndarray:
    """The kind of each sign below CUT_BELOW, by what the library doesn't cut it from."""
    kind = np.full(CUT_BELOW, SPACE, np.uint8)
    for c in range(CUT_BELOW):
        for k, sign in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")):
            if len(lib.pre_tokenizer.pre_tokenize_str(sign + chr(c))) == 1:
                kind[c] = k
    return kind


def _alphabet() -> np.ndarray:
    """The sign by which a byte-level vocabulary writes each byte; 0 stays, it parts words."""
    own = np.zeros(256, bool)
    own[[0, *range(33, 127), *range(161, 173), *range(174, 256)]] = True
    sign = np.arange(256)
    sign[~own] = 256 + np.arange(1, 1 + (~own).sum())
    return sign.astype("<u4")


class Encoder:
    """Ids of whole texts from the tokenizers library.

    The byte-level tokenizer cuts a text into parts, a blank with what follows
    it, and runs its merges on each by itself.  Here texts are cut by the same
    pattern, and each distinct part is given to the library's model once.
    Texts where white space touches white space, with special tokens or with
    signs beyond U+04FF are given to the library whole."""

    def __init__(self, path: str, slots: int = SLOTS):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.size = self.lib.get_vocab_size()
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.feed = self.lib.encode("\n", add_special_tokens=False).ids[0]
        self.kind, self.alphabet = _kinds(self.lib), _alphabet()
        self.table = PartTable(slots)
        self.long: dict[bytes, np.ndarray] = {}

    def simple(self, texts: list[bytes]) -> list[bool]:
        """Which texts can be cut here: all bytes are of signs that are, and of
        white space there are single blanks and line feeds within a text."""
        chunk = Chunk(0, texts, lower=False)
        raw = b"\n".join([*texts, b""])
        buf = np.frombuffer(raw, np.uint8)
        ok = np.ones(len(texts), bool)
        white = (buf == 32) | (buf == 10)
        odd = _WHOLE[buf]
        odd[1:] |= white[1:] & white[:-1]  # a line feed ends every text, so this also tells those that begin or end with one
        odd[:1] |= white[:1]
        odd[1:] |= (buf[:-1] == 0xC2) & ((buf[1:] == 0x85) | (buf[1:] == 0xA0))
        ok[np.searchsorted(chunk.doc_start, np.flatnonzero(odd), side="right") - 1] = False
        ok |= np.diff(chunk.doc_start) == 1  # empty
        doubtful = self.special if _is_utf8(raw) else [b""]
        if any(s in raw for s in doubtful):
            ok &= [_is_utf8(t) and not any(s in t for s in self.special) for t in texts]
        return ok.tolist()

    def merge(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts that the pattern doesn't cut, in a row, and the number of each."""
        words = self.alphabet[np.frombuffer(b"\0".join(parts), np.uint8)].tobytes().decode("utf-32-le").split("\0")
        ids, number, tokenize = [], [], self.model.tokenize
        for w in words:
            got = tokenize(w)
            number.append(len(got))
            ids += [t.id for t in got]
        return np.array(ids, np.int32), np.array(number, np.int64)

    def learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, in a row, and the number of each.  They are given
        to the library LEARN_PARTS in a text: the line feeds between them are pieces of
        their own, and no other part holds one."""
        if b"\n" in parts:  # the part that is a line feed itself
            return self._learn_apart(parts)
        texts = (b"\n".join(parts[k : k + LEARN_PARTS]).decode() for k in range(0, len(parts), LEARN_PARTS))
        each = [np.array(self.lib.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.int64) for t in texts]
        ids = np.concatenate([x for e in each for x in (e, [self.feed])][:-1])
        stop = np.append(np.flatnonzero(ids == self.feed), len(ids))
        return ids[ids != self.feed], np.diff(stop, prepend=-1) - 1

    def _learn_apart(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = parts.index(b"\n")
        rest = parts[:at] + parts[at + 1 :]
        ids, number = self.learn(rest) if rest else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return np.insert(ids, int(number[:at].sum()), self.feed), np.insert(number, at, 1)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the texts, and the number of each."""
        simple = self.simple(texts)
        ids, at, edge = self._simple_ids([t for t, ok in zip(texts, simple, strict=True) if ok])
        if len(edge) > len(texts):
            return ids, np.diff(at[edge])
        out, j = [], 0
        for t, ok in zip(texts, simple, strict=True):
            out.append(ids[at[edge[j]] : at[edge[j + 1]]] if ok else np.array(self.lib.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int64))
            j += ok
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _simple_ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all parts of the texts, where each part's ids begin, and
        each text's first part (then the number of parts)."""
        chunk = Chunk(0, texts, lower=False)
        raw = b"\n".join([*texts, b""])  # a line feed ends every text
        chunk.buf = buf = np.frombuffer(raw, np.uint8)
        start = np.flatnonzero(self.cuts(buf))
        end = np.append(start[1:], len(buf))
        inner = np.ones(len(start), bool)
        inner[np.searchsorted(start, chunk.doc_start[1:] - 1)] = False  # the line feeds that end texts
        start, end = start[inner], end[inner]
        edge = np.searchsorted(start, chunk.doc_start)
        length = end - start
        brief = np.flatnonzero(length <= PART_BYTES)
        table, known = self.table, self.table.used
        code = np.full(len(start), -1, np.int64)
        # Short parts: by the table, those it doesn't know by the library.
        eight = np.ndarray((len(raw) + PART_BYTES - 8,), "<u8", raw + bytes(PART_BYTES), strides=(1,))
        size = length[brief]
        word = [eight[start[brief] + 8 * j] & _WORD_MASK[np.clip(size - 8 * j, 0, 8)] for j in range(3)]
        key = mix(word[0] ^ mix(word[1] ^ mix(word[2] + size.astype(np.uint64))))
        code[brief] = table.find(key, word, size)
        lost = np.flatnonzero(code[brief] < 0)
        if len(lost):
            order = lost[np.argsort(key[lost])]  # equal parts lie together, but for colliding hashes: those are learnt twice
            new = np.ones(len(order), bool)
            new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (key, size, *word)], axis=0)
            first = order[new]
            got, number = self.merge([raw[a : a + n] for a, n in zip(start[brief[first]].tolist(), size[first].tolist(), strict=True)])
            code[brief[order]] = known + np.cumsum(new) - 1
            table.lay(known, got, number)
            known += len(first)
            if room := table.room:
                table.add(key[first[:room]], [w[first[:room]] for w in word], size[first[:room]])
        # Long parts: by a dictionary of their bytes.
        far = np.flatnonzero(length > PART_BYTES)
        if len(far):
            parts = [raw[a:b] for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True)]
            fresh = list(dict.fromkeys(p for p in parts if p not in self.long))
            own = dict(self.long)
            if fresh:
                got, number = self.learn(fresh)
                own |= zip(fresh, np.split(got, np.cumsum(number)[:-1]), strict=True)
            names = {p: k for k, p in enumerate(dict.fromkeys(parts))}
            code[far] = known + np.array([names[p] for p in parts])
            table.lay(known, np.concatenate([own[p] for p in names]), np.array([len(own[p]) for p in names]))
            if len(own) <= LONG_PARTS:
                self.long = own
        begin = table.begin[code]
        out, at = spread(begin, table.begin[code + 1] - begin, table.flat)
        return out, at, edge

    def cuts(self, buf: np.ndarray) -> np.ndarray:
        """Where the tokenizer's pattern begins a part: at white space, and where
        the kind of sign changes, but not behind a blank.  The endings 's, 't,
        're, 've, 'm, 'll and 'd are parts where the quote begins one."""
        kind = self.kind[buf]
        two = np.flatnonzero(buf >= 0xC0)
        kind[two] = kind[two + 1] = self.kind[(buf[two].astype(np.int64) & 31) << 6 | buf[two + 1] & 63]
        cut = kind == SPACE
        cut[1:] |= (kind[1:] != kind[:-1]) & (buf[:-1] != 32)
        cut[:1] = True
        quote = np.flatnonzero(cut & (buf == 39))
        one, pair = buf[quote + 1], buf[np.minimum(quote + 2, len(buf) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        wide = ((one == 114) | (one == 118)) & (pair == 101) | (one == 108) & (pair == 108)
        for at, size in ((quote[short], 2), (quote[wide], 3)):
            cut[at + 1], cut[at + size] = False, True
        return cut


def _is_utf8(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One encoder a process, so that what it has learnt serves later tasks."""
    return Encoder(path)


def spread(start: np.ndarray, length: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices flat[start : start + length] in a row, and where each begins
    (then the end)."""
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    return flat[np.repeat(start - at[:-1], length) + np.arange(at[-1])], at


def repair(symbols: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs of symbols) and the remaining symbols.

    Each round counts all adjacent pairs exactly and replaces the most
    frequent ones.  Where two of them overlap the more frequent goes first, and
    equal ones from left to right.  A pair that thereby keeps too few places
    waits for a later round; the most frequent one never does, so this ends
    only when no pair occurs MIN_COUNT times."""
    seq, rules, top = symbols.astype(np.uint32), [], vocab + 1
    at = np.flatnonzero((seq[:-1] != vocab) & (seq[1:] != vocab))
    while len(at):
        wide = np.uint64 if top > 1 << 16 else np.uint32
        shift = wide(32 if top > 1 << 16 else 16)
        mask = (wide(1) << shift) - wide(1)
        left, right = seq.take(at).astype(np.int64), seq.take(at + 1).astype(np.int64)
        pair = (left << int(shift) | right).astype(wide)
        key = np.sort(pair)
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(edge, append=len(key))
        often = np.flatnonzero(count >= MIN_COUNT)
        if not len(often):
            break
        often = often[np.lexsort((key[edge[often]], -count[often]))]
        pairs, order = np.unique(key[edge[often[:ROUND_PAIRS]]], return_index=True)
        late = key[edge[often[ROUND_PAIRS:]]]
        slot = _slots(pairs, pair, left, right, shift, top)
        hit = np.flatnonzero(pairs.take(slot) == pair)
        # Places to count in the next round, if they are left: of frequent pairs, and below of new symbols.
        look = np.zeros(len(seq), bool)
        look[at.take(hit)] = True
        if len(late):
            ends = np.zeros((2, top), bool)
            ends[0, late >> shift], ends[1, late & mask] = True, True
            look[at.take(np.flatnonzero(ends[0].take(left) & ends[1].take(right)))] = True
        at, slot = at.take(hit), slot.take(hit)
        rank = np.full(len(seq) + 1, len(pairs), np.int32)
        own = order.astype(np.int32).take(slot)
        rank[at + 1] = own
        win = np.flatnonzero((own <= rank.take(at)) & (own <= rank.take(at + 2, mode="clip")))
        at, slot = at.take(win), slot.take(win)
        head = np.r_[True, np.diff(at) > 1]
        begun = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        odd = np.flatnonzero((np.arange(len(at)) - begun) % 2 == 0)
        at, slot = at.take(odd), slot.take(odd)
        keep = np.bincount(slot, minlength=len(pairs)) >= MIN_COUNT // 2
        taken = np.flatnonzero(keep.take(slot))
        at, slot = at.take(taken), slot.take(taken)
        seq[at] = (top + np.cumsum(keep) - 1).take(slot)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        if len(at) > len(seq) >> 4:  # then places are faster than a mask
            stay = np.flatnonzero(stay)
        seq, look = seq[stay], look[stay]
        rules.append(np.stack([pairs[keep] >> shift, pairs[keep] & mask], 1).astype(np.uint32))
        top += int(keep.sum())
        new = at - np.arange(len(at))
        look[new], look[new - 1] = True, True
        stop = np.flatnonzero(seq == vocab)
        look[stop], look[stop - 1], look[-1:] = False, False, False
        at = np.flatnonzero(look)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), seq


def _slots(pairs: np.ndarray, pair: np.ndarray, left: np.ndarray, right: np.ndarray, shift, top: int) -> np.ndarray:
    """For each pair, of symbols left and right, its place among the sorted
    `pairs`, if it is there: by a table of left and right symbols where that is
    small, else by bisection."""
    mask = (pairs.dtype.type(1) << shift) - pairs.dtype.type(1)
    own_l, own_r = (pairs >> shift).astype(np.int64), (pairs & mask).astype(np.int64)
    lefts, rights = np.unique(own_l), np.unique(own_r)
    wide = len(rights) + 1
    if (len(lefts) + 1) * wide > 1 << 23:
        return np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
    rank_l, rank_r = np.zeros(top, np.int64), np.zeros(top, np.int64)
    rank_l[lefts], rank_r[rights] = np.arange(1, len(lefts) + 1) * wide, np.arange(1, len(rights) + 1)
    table = np.zeros((len(lefts) + 1) * wide, np.int32)
    table[rank_l[own_l] + rank_r[own_r]] = np.arange(len(pairs))
    return table.take(rank_l.take(left) + rank_r.take(right))


def _levels(rules: np.ndarray, vocab: int) -> Iterator[tuple[int, int]]:
    """Runs of rules, first and one past the last, whose symbols all come before the run."""
    most, k = np.maximum.accumulate(rules.max(axis=1, initial=0)), 0
    while k < len(rules):
        yield k, (k := int(np.searchsorted(most, vocab + 1 + k)))


def _all_lengths(rules: np.ndarray, vocab: int) -> np.ndarray:
    """The expansion length of each symbol."""
    length = np.ones(vocab + 1 + len(rules), np.int64)
    for a, b in _levels(rules, vocab):
        length[vocab + 1 + a : vocab + 1 + b] = length[rules[a:b]].sum(axis=1)
    return length


def expansions(rules: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each symbol's ids begin in `flat`, how many there are, and flat."""
    length = _all_lengths(rules, vocab)
    start = np.cumsum(length) - length
    flat = np.zeros(length.sum(), np.int32)
    flat[: vocab + 1] = np.arange(vocab + 1)
    for a, b in _levels(rules, vocab):
        parts = rules[a:b].ravel()
        got, at = spread(start[parts], length[parts], flat)
        first = start[vocab + 1 + a]
        flat[first : first + at[-1]] = got
    return start, length, flat


def lengths_of(rules: np.ndarray, vocab: int) -> np.ndarray:
    """The expansion length of each rule."""
    return _all_lengths(rules, vocab)[vocab + 1 :]


_HEAD = struct.Struct("<4s5I")


def pack(ids: np.ndarray, counts: np.ndarray, doc_ids: list[int | None], vocab: int) -> bytes:
    """A shard of documents: their ids one after the other, without end ids."""
    ends = np.cumsum(counts)
    rules, seq = repair(np.insert(ids, ends, vocab), vocab)
    length = lengths_of(rules, vocab)
    stop = np.flatnonzero(seq == vocab)
    first = np.r_[0, stop[:-1] + 1] if len(stop) else stop
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    width = 2 if vocab + 1 + len(rules) <= 1 << 16 else 4
    parts = [_HEAD.pack(b"RPG2", vocab, len(doc_ids), len(rules), len(seq), width), keys, null, first.astype("<u4"), rules.astype(f"<u{width}"), length.astype("<u4"), seq.astype(f"<u{width}")]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Shard:
    """A packed shard; `document(k)` decodes one document alone."""

    def __init__(self, blob: bytes):
        magic, self.vocab, docs, rules, symbols, width = _HEAD.unpack_from(blob)
        if magic != b"RPG2":
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(blob, kind, n, at)
            at += x.nbytes
            return x

        keys, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)]
        self.first = take("<u4", docs).astype(np.int64)
        self.rules = take(f"<u{width}", 2 * rules).reshape(-1, 2)
        self.rule_length = take("<u4", rules)
        self.symbols = take(f"<u{width}", symbols)
        self._expansions: tuple | None = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._expansions is None:
            self._expansions = expansions(self.rules, self.vocab)
        start, length, flat = self._expansions
        s = symbols.astype(np.int64)
        ids, _ = spread(start[s], length[s], flat)
        return ids

    def document(self, k: int) -> np.ndarray:
        stop = self.first[k + 1] if k + 1 < len(self.first) else len(self.symbols)
        ids = self._expand(self.symbols[self.first[k] : stop])
        ids[-1] = END_ID
        return ids

    def lengths(self) -> np.ndarray:
        """The number of ids of each document, from the stored lengths alone."""
        length = np.ones(self.vocab + 1 + len(self.rules), np.int64)
        length[self.vocab + 1 :] = self.rule_length
        return np.add.reduceat(length[self.symbols], self.first) if len(self.first) else self.first

    def all_ids(self) -> np.ndarray:
        ids = self._expand(self.symbols)
        ids[ids == self.vocab] = END_ID
        return ids


def _pieces(batches) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts, about PIECE_BYTES at a time."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), views(batch.column(1)), strict=True):
            keys.append(k)
            texts.append(bytes(t))
            size += len(texts[-1])
            if size > PIECE_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _write_shards(batches, path: str, shard_tokens: int, schema: pa.Schema):
    encoder, part, seq = encoder_of(path), TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    keys: list = []
    held = 0

    def shard() -> pa.RecordBatch:
        blob = pack(np.concatenate(ids), np.concatenate(counts), keys, encoder.size)
        return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(keys), "n_tokens": held + len(keys), "shard": blob}], schema=schema)

    for own, texts in _pieces(batches):
        got, number = encoder.encode(texts)
        ids.append(got)
        counts.append(number)
        keys += own
        held += len(got)
        if held >= shard_tokens:
            yield shard()
            ids, counts, keys, held, seq = [], [], [], 0, seq + 1
    if keys:
        yield shard()


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Tokenise all rows and write the shards, in ascending order of ids, to a
    Parquet table (part, seq, n_docs, n_tokens, shard)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    out = "part int, seq int, n_docs int, n_tokens long, shard binary"
    schema = arrow_schema(out)
    rows.transform(mapped, lambda it: _write_shards(it, tokenizer, shard_tokens, schema), out).write.parquet(path)


def _read_shards(batches, schema: pa.Schema):
    for batch in batches:
        for part, seq, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "shard")), strict=True):
            s = Shard(blob)
            n = s.lengths()
            stop = np.cumsum(n)
            raw = s.all_ids().astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (b - a) : 4 * b]) for a, b in zip(n.tolist(), stop.tolist(), strict=True)]
            cols = [pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), seq, np.int32)), pa.array(s.doc_ids, pa.int64()), pa.array(stop - n), pa.array(n), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the
    shards.  start counts the ids of all documents before it: of the parts
    before (one row a part), of the shards before, and within the shard."""
    shards = spark.read.parquet(path)
    out = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(out)
    docs = shards.select("part", "seq", "shard").transform(mapped, lambda it: _read_shards(it, schema), out)
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("shard_start"))
    offsets = sizes.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("offset"))
    return docs.join(offsets, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, doc_id, text)
    return read(docs.sparkSession, path)
